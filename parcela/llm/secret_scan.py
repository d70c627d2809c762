"""Secret scans over a ledger of blobs.

Every version of every path is addressed by the SHA-256 of its content. The ledger is a table with one row for each pair
of blob and rule version that has been scanned: the spans found, or none. A scan writes the addresses of all versions,
asks the ledger which pairs it lacks, and only then fetches contents: of each blob that has such pairs once, however many
paths hold it. It adds their rows to the ledger and joins the findings back to all paths. A new rule version makes the
pairs of that rule unseen again and leaves the others alone. Where nothing is unseen, no content is fetched or shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parcela.llm.common import text_or_empty, written
from parcela.sources.shared import scratch


@dataclass(frozen=True)
class Rule:
    """A kind of secret. Matches are taken from the left without overlap; then those whose group is too short fail."""

    kind: str
    version: int
    pattern: str
    group: int
    least: int

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"

    def scanner(self) -> Callable[[str], list[tuple[int, int]]]:
        found, group, least = re.compile(self.pattern).finditer, self.group, self.least
        return lambda text: [m.span() for m in found(text) if m.end(group) - m.start(group) >= least]


def any_case(word: str) -> str:
    """The word with each ASCII letter in either case, and no other letters that fold to it."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


KEYWORDS = "|".join(any_case(w).replace("_", "_?") for w in ("password", "passwd", "secret", "token", "api_key"))
#: The rules in production, in the order in which spans with one start are listed.
RULES = (
    Rule("assign", 1, rf"""({KEYWORDS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", 1, r"[0-9a-f]+", 0, 24),
)

LEDGER = "blob binary, rule string, spans array<struct<begin:int,finish:int>>"
SPAN = pa.struct([("begin", pa.int32()), ("finish", pa.int32())])


def blob_address(text: str = "text") -> Column:
    """The content's address; null counts as an empty text."""
    return F.unhex(F.sha2(text_or_empty(text), 256))


def scanned(blobs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """Ledger rows for blobs(blob, content, pending): one for each blob and pending rule, with spans in code points."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = {r.key: r.scanner() for r in rules}
        for batch in batches:
            addresses, keys, spans = [], [], []
            for blob, content, pending in zip(*(batch.column(i) for i in range(3)), strict=True):
                text = content.as_py()
                for key in pending.as_py():
                    addresses.append(blob.as_py())
                    keys.append(key)
                    spans.append([{"begin": a, "finish": b} for a, b in scan[key](text)])
            yield pa.RecordBatch.from_arrays([pa.array(addresses, pa.binary()), pa.array(keys, pa.string()), pa.array(spans, pa.list_(SPAN))], ["blob", "rule", "spans"])

    return blobs.select("blob", "content", "pending").mapInArrow(run, LEDGER)


def unseen(spark: SparkSession, addresses: DataFrame, ledger: str | None, rules: tuple[Rule, ...]) -> DataFrame:
    """blob and pending (keys of rules) of the blobs that the ledger lacks pairs of; None for a ledger that is yet empty."""
    every = F.array(*[F.lit(r.key) for r in rules])
    blobs = addresses.select("blob").distinct()
    if ledger is None:
        return blobs.withColumn("pending", every)
    seen = spark.read.schema(LEDGER).parquet(ledger).groupBy("blob").agg(F.collect_set("rule").alias("seen"))
    pending = F.array_except(every, F.coalesce("seen", F.array().cast("array<string>")))
    return blobs.join(seen, "blob", "left").select("blob", pending.alias("pending")).where(F.size("pending") > 0)


def update_ledger(spark: SparkSession, versions: DataFrame, ledger: str, text: str = "text", rules: tuple[Rule, ...] = RULES, known: bool = True, addresses: DataFrame | None = None, repeated: bool = True) -> DataFrame:
    """Scans what the ledger at this path lacks of all versions, appends it there, and returns the ledger.

    known: False for a ledger that doesn't exist yet. addresses: a written table of the versions' blobs, if there is one.
    Contents of unseen blobs cross one shuffle, in which each task first reduces a blob that many paths hold to one row,
    so a blob that a third of all rows hold does not gather in one task. Unseen blobs whose table is small, as the planner
    judges by its size, meet their contents without a shuffle. Two scans at one time may both add a pair; its findings
    are equal and count once. repeated: False if few contents come twice: they are scanned where they lie, without that
    shuffle, and those that do come twice add their pairs twice.
    """
    contents = versions.select(blob_address(text).alias("blob"), text_or_empty(text).alias("content"))
    if known:
        addresses = contents.select("blob") if addresses is None else addresses
        table = written(unseen(spark, addresses, ledger, rules), "unseen")
        if table.limit(1).count() == 0:
            return spark.read.schema(LEDGER).parquet(ledger)
        contents = contents.join(table, "blob")
    else:
        contents = contents.withColumn("pending", F.array(*[F.lit(r.key) for r in rules]))
    if repeated:
        contents = contents.groupBy("blob").agg(F.first("content").alias("content"), F.first("pending").alias("pending"))
    scanned(contents, rules).write.mode("append").parquet(ledger)
    return spark.read.schema(LEDGER).parquet(ledger)


def blob_findings(ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row for each blob with findings of the given rules: blob, found (structs of begin, at, finish and kind, sorted)."""
    place = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(r.key), F.struct(F.lit(i).alias("at"), F.lit(r.kind).alias("kind")))])
    hits = ledger.where(F.col("rule").isin([r.key for r in rules]) & (F.size("spans") > 0)).withColumn("rule", place[F.col("rule")])
    each = hits.select("blob", F.transform("spans", lambda s: F.struct(s["begin"].alias("begin"), F.col("rule.at").alias("at"), s["finish"].alias("finish"), F.col("rule.kind").alias("kind"))).alias("found"))
    return each.groupBy("blob").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("found")))).alias("found"))


def span_list(found: Column) -> Column:
    """kind:start:end of all spans, joined by commas."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["begin"].cast("string"), s["finish"].cast("string"))), ",")


def scan_secrets(versions: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), ledger: str | None = None, rules: tuple[Rule, ...] = RULES, repeated: bool = True) -> DataFrame:
    """The kept columns of every version, with blob (its address) and found (its sorted findings, empty if none).

    Null texts count as empty and have no findings; repeated rows each keep their row; an empty table gives an empty
    result. Column names of the input clash with nothing, since only those named are read. Without a ledger path the scan
    starts a new ledger in the shared folder. repeated: as in update_ledger().
    """
    spark = versions.sparkSession
    paths = versions.select(F.struct(*keep).alias("kept"), blob_address(text).alias("blob"))
    if ledger is not None and text not in keep:
        paths = written(paths, "paths")
    table = update_ledger(spark, versions, ledger or scratch(spark, "ledger"), text, rules, ledger is not None, paths, repeated)
    joined = paths.join(blob_findings(table, rules), "blob", "left")
    nothing = F.array().cast("array<struct<begin:int,at:int,finish:int,kind:string>>")
    return joined.select("kept.*", "blob", F.coalesce("found", nothing).alias("found"))


def merged_spans(found: Column) -> Column:
    """The findings' spans (begin, finish), with those that overlap or touch made one."""
    spans = F.transform(found, lambda s: F.struct(s["begin"].alias("begin"), s["finish"].alias("finish")))
    empty = F.array().cast("array<struct<begin:int,finish:int>>")

    def add(done: Column, span: Column) -> Column:
        last = F.element_at(done, -1)
        grown = F.struct(last["begin"].alias("begin"), F.greatest(last["finish"], span["finish"]).alias("finish"))
        return F.when((F.size(done) > 0) & (F.get(done, F.size(done) - 1)["finish"] >= span["begin"]), F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(grown))).otherwise(F.concat(done, F.array(span)))

    return F.aggregate(spans, empty, add)


def redacted(text: Column, found: Column, mark: str = "[SECRET]") -> Column:
    """The text with every finding replaced by the mark."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def add(acc: Column, span: Column) -> Column:
        return F.struct(F.concat(acc["out"], F.substring(text, acc["at"] + 1, span["begin"] - acc["at"]), F.lit(mark)).alias("out"), span["finish"].alias("at"))

    return F.aggregate(merged_spans(found), start, add, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
