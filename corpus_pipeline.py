"""The corpus pipeline: documents whose language is known, without near duplicates and secrets, mixed and encoded.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the docs of
the next. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcela.llm import lang_id, mixing, order_minhash, pieces, secret_scan
from parcela.llm.common import small_batches, written
from parcela.llm.queries import PIECES

#: No SQL expresses the stages; tests/llm compares them with brute-force versions.
ORACLE_SQL = None
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Ids of dropped rows that are sent to all tasks at most; with more of them, whole rows are shuffled instead.
SENT_IDS = 4_000_000


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language can't be told (no text, or no letter in it); a null lang becomes the predicted one."""
    small_batches(spark)
    found = lang_id.identified(docs, lang_id.learned(docs), keep=COLUMNS)
    return found.where(F.col("lang_pred") != lang_id.UNDETERMINED).select("doc_id", "text", F.coalesce("lang", "lang_pred").alias("lang"), "source", "n_chars")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each class of near duplicates: that with the smallest doc_id (null ids last), then text digest.

    Ids that a single row has tell their row; rows that share an id, or have none, are told apart by their texts' digests.
    Where each id has a single row, the ids of dropped rows go to all tasks, and no text is shuffled.
    """
    small_batches(spark)
    classes = order_minhash.near_duplicates(docs, keep=("key", "node", "label"))
    first = F.min(F.struct(F.col("key").isNull(), "key", "node")).alias("first")
    kept = written(classes.groupBy("label").agg(first).select(F.col("first.key").alias("key"), F.col("first.node").alias("kept_node")), "kept")
    docs = docs.select(*COLUMNS)
    again = written(docs.groupBy("doc_id").count().where("count > 1 or doc_id is null").select(F.col("doc_id").alias("again")), "repeated")
    same, repeated = F.col("doc_id").eqNullSafe(F.col("key")), F.col("doc_id").eqNullSafe(F.col("again"))
    if again.limit(1).count() == 0:
        dropped = written(classes.select("key").join(kept.select("key"), "key", "left_anti"), "dropped")
        if dropped.count() <= SENT_IDS:
            return docs.join(F.broadcast(dropped), F.col("doc_id") == F.col("key"), "left_anti")
        return docs.join(kept, same, "left_semi")
    many = order_minhash.with_nodes(docs.join(again, repeated, "left_semi"), node="node")
    many = many.join(kept, same & (F.col("node") == F.col("kept_node")), "left_semi")
    whole = F.min(F.struct(*COLUMNS[1:])).alias("row")  # rows of one id and text: one of them stays
    many = many.groupBy("doc_id", "node").agg(whole).select("doc_id", "row.*")
    return docs.join(again, repeated, "left_anti").join(kept, same, "left_semi").union(many)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every secret in the texts by a mark; documents without secrets stay as they are.

    No text comes twice after near-dedup, so texts are scanned where they lie; one that did would be scanned twice."""
    small_batches(spark)
    found = secret_scan.scan_secrets(docs, keep=COLUMNS, repeated=False)
    some = F.size("found") > 0
    found = found.withColumn("clean", F.when(some, secret_scan.redacted(F.col("text"), F.col("found"))).otherwise(F.col("text")))
    size = F.when(some, F.length("clean").cast("long")).otherwise(F.col("n_chars"))
    return found.select("doc_id", F.col("clean").alias("text"), "lang", "source", size.alias("n_chars"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each pass over a document that the mix takes, in training order; a last pass has the words it takes.

    The mix is planned over rows without texts; these join their turns afterwards, by digests of the whole row, of which
    rows that repeat are one.
    """
    named = docs.withColumns({f"row_{k}": F.xxhash64(F.lit(k), *COLUMNS) for k in (0, 1)})
    turns = mixing.training_turns(mixing.mixed(named, keep=("row_0", "row_1")))
    whole = named.groupBy("row_0", "row_1").agg(*[F.first(c).alias(c) for c in COLUMNS])
    rows = turns.join(whole, ["row_0", "row_1"]).orderBy("position")
    words = F.regexp_extract_all("text", F.lit(r"([\x20\x09-\x0D]*[^\x20\x09-\x0D]+)"))
    all_ = F.col("words") == F.col("size")
    text = F.when(all_, F.col("text")).otherwise(F.array_join(F.slice(words, F.lit(1), F.col("words").cast("int")), ""))
    rows = rows.withColumn("taken", text)
    size = F.when(all_, F.col("n_chars")).otherwise(F.length("taken").cast("long"))
    return rows.select("doc_id", F.col("taken").alias("text"), "lang", "source", size.alias("n_chars"))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The SentencePiece ids of every row."""
    small_batches(spark)
    return pieces.encoded(docs, public_tokenizers.path(PIECES), keep=("doc_id", "lang", "source", "n_chars"))


STAGES = [
    ("language ID", identify_languages),
    ("MinHash near-dedup", drop_near_duplicates),
    ("secret scans", redact_secrets),
    ("mixing sources to target weights", mix_sources),
    ("SentencePiece encoding", encode_pieces),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to the documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
