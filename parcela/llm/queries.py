"""The queries of the operators in this subpackage, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcela.llm import fingerprints, lang_id, license_scan, mixing, neighbours, order_minhash, pieces, secret_scan, token_planes, warc
from parcela.llm.common import small_batches

WORDS, PIECES = "word_bpe_49k.json", "piece_bpe_32k.model"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[function.__name__] = function
    return function


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document: counts by kind and the spans' digest."""
    found = secret_scan.scan_secrets(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    spans = secret_scan.span_list(F.col("found"))
    return found.select("doc_id", *[count(r.kind) for r in secret_scan.RULES], F.sha2(spans, 256).alias("base_sha256"), spans.alias("spans"))


def secret_scan_sql() -> str:
    """Starts of matches follow from the lengths of the matches and of the pieces between them."""
    kinds = []
    for i, r in enumerate(secret_scan.RULES):
        pattern = r.pattern.replace("'", "''")
        kinds.append(f"""
        SELECT doc_id, n, {i} AS place, '{r.kind}' AS kind, unnest(list_transform(range(1, len(ms) + 1), lambda k: struct_pack(
            b := coalesce(list_sum(list_transform(ps[1:k], lambda p: length(p))), 0) + coalesce(list_sum(list_transform(ms[1:k-1], lambda m: length(m))), 0),
            w := length(ms[k]), g := length(gs[k])))) AS hit
        FROM (SELECT doc_id, n, regexp_extract_all(t, '{pattern}') AS ms, regexp_extract_all(t, '{pattern}', {r.group}) AS gs, string_split_regex(t, '{pattern}') AS ps FROM d)
        """)
    least = " ".join(f"WHEN {i} THEN {r.least}" for i, r in enumerate(secret_scan.RULES))
    return f"""
    WITH d AS (SELECT doc_id, row_number() OVER () AS n, coalesce(text, '') AS t FROM documents),
    hits AS ({" UNION ALL ".join(kinds)}),
    f AS (SELECT n, place, kind, hit.b AS b, hit.b + hit.w AS e FROM hits WHERE hit.g >= CASE place {least} END),
    j AS (SELECT n, {", ".join(f"count(*) FILTER (WHERE place = {i}) AS n_{r.kind}" for i, r in enumerate(secret_scan.RULES))},
        string_agg(kind || ':' || CAST(b AS BIGINT) || ':' || CAST(e AS BIGINT), ',' ORDER BY b, place) AS spans FROM f GROUP BY n)
    SELECT doc_id, {", ".join(f"CAST(coalesce(n_{r.kind}, 0) AS BIGINT) AS n_{r.kind}" for r in secret_scan.RULES)},
        sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
    FROM d LEFT JOIN j USING (n)
    """


ORACLES["op1_secret_scan"] = secret_scan_sql()


@query
def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words that the mix takes of every document, and the position of its first turn."""
    mix = mixing.mixed(table(spark, sf_dir, "documents"))
    return mix.select("doc_id", "size", "source_size", "target", "taken", F.get("turns", F.lit(0))["position"].alias("position"))


ORACLES["op6_mixing"] = """
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS digest FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
p AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM s),
w AS (SELECT *, CASE place % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight, 2 * source_size AS most FROM p),
l AS (SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) * 1.5 - coalesce(CAST(sum(most) OVER (ORDER BY most / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS DOUBLE), 0))
    / CAST(sum(weight) OVER (ORDER BY most / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level FROM w),
t AS (SELECT source, source_size, place, least(CAST(most AS DOUBLE), coalesce(
    (SELECT level FROM l AS o WHERE o.most > o.level * o.weight ORDER BY o.most / o.weight, o.place LIMIT 1) * weight, CAST(most AS DOUBLE))) AS target FROM l),
r AS (SELECT d.doc_id, d.size, t.source_size, t.target, t.place, CAST(floor(t.target) AS BIGINT) AS due,
    coalesce(CAST(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.digest, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS begins
    FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
k AS (SELECT *, greatest(0, least(size, due - begins)) AS one, greatest(0, least(size, due - begins - source_size)) AS two, CAST(begins AS DOUBLE) / nullif(due, 0) AS part FROM r),
z AS (SELECT *, CASE place % 3 WHEN 0 THEN 2.0::DOUBLE * part / (1.5::DOUBLE + sqrt(2.25::DOUBLE + (-2.0)::DOUBLE * part))
    WHEN 1 THEN 2.0::DOUBLE * part / (0.5::DOUBLE + sqrt(0.25::DOUBLE + 2.0::DOUBLE * part))
    ELSE CASE WHEN part * 1.125::DOUBLE < 0.625::DOUBLE THEN 2.0::DOUBLE * (part * 1.125::DOUBLE) / (1.0::DOUBLE + sqrt(1.0::DOUBLE + 2.0::DOUBLE * (part * 1.125::DOUBLE)))
        ELSE 0.5::DOUBLE + 2.0::DOUBLE * (part * 1.125::DOUBLE - 0.625::DOUBLE) / (1.5::DOUBLE + sqrt(2.25::DOUBLE + (-4.0)::DOUBLE * (part * 1.125::DOUBLE - 0.625::DOUBLE))) END END AS position FROM k)
SELECT doc_id, size, source_size, target, CAST(one + two AS BIGINT) AS taken, CASE WHEN one > 0 THEN position END AS position FROM z
"""


@query
def op10_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids, written as byte planes and read back: where they start, how many, and their checksum."""
    return token_planes.stored(table(spark, sf_dir, "documents"), public_tokenizers.path(WORDS)).withColumnRenamed("key", "doc_id")


@query
def op4_lang_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language, by machines that learned from the documents that are not held out."""
    docs = table(spark, sf_dir, "documents")
    found = lang_id.identified(docs, lang_id.learned(docs))
    return found.select("doc_id", lang_id.held_out("doc_id").alias("held_out"), "lang_pred", "score")


@query
def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page, written as a WARC record and read back."""
    return warc.archived(table(spark, sf_dir, "pages")).drop("payload", "url")


ORACLES["op7_warc"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS digest, CAST(strlen(coalesce(html, '')) AS BIGINT) AS size FROM pages),
m AS (SELECT digest, max(page_id) AS first FROM p WHERE size >= 1000 GROUP BY digest HAVING count(*) > 1)
SELECT page_id, size AS payload_bytes, digest AS payload_digest,
    CASE WHEN size >= 1000 AND first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN size >= 1000 AND page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM p LEFT JOIN m USING (digest)
"""


@query
def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's canonical digest, the known licence that it is, and those of its lines."""
    return license_scan.licensed(table(spark, sf_dir, "documents"))


ORACLES["op2_license_scan"] = license_scan.licensed_sql()


@query
def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and its edited text's, and how near they and the next document's are."""
    return fingerprints.fingerprinted(table(spark, sf_dir, "documents")).withColumnRenamed("key", "doc_id")


@query
def op8_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's SentencePiece ids, and whether decoding them gives the text again."""
    return pieces.encoded(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECES))


@query
def op5_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the class of near duplicates that it belongs to (its smallest doc_id)."""
    return order_minhash.near_duplicates(table(spark, sf_dir, "documents")).withColumnRenamed("key", "doc_id")


@query
def op3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors found for every vector whose id is divisible by 20."""
    return neighbours.nearest_neighbours(table(spark, sf_dir, "embeddings"), 20, lambda key: key % 20 == 0)
