"""Mixing sources to target weights, as a curriculum that varies over time. DataFrame functions only.

Sizes are counted in words. Each source gets a share of the words that the mix takes by its weight; a share stops at a
number of passes over its source, and the excess goes to the others by weight (a water level, found in one pass over the
sources in the order in which they fill up). Within a source the documents lie in the order of a digest of their id, end
to end and pass after pass, so the words taken are a prefix of that line. The weight schedule of the source, integrated
over the run, gives the words it has delivered at each time; the inverse of that curve gives each document its training
position, from 0 (the start) to 1, and the mix is range-sorted by position.

Where a document lies on its source's line is a prefix sum. No task sees a whole source for it: the line is cut into
buckets of the digest and these into spans of SPAN buckets; sums of spans are summed first, then those of buckets within a
span, and each row adds its place within its bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcela.llm.common import written

#: Weights of the sources in their order, repeating.
WEIGHTS = (3, 1, 2)
#: Words that the mix takes, as a share of all words, and the most passes over a source.
SHARE, PASSES = 1.5, 2
#: Factors on the weight over the run (time, factor), straight between these points; dealt to the sources like weights.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 0.5), (1.0, 1.5)), ((0.0, 1.0), (0.5, 1.5), (1.0, 0.5)))
#: Rows of the table for each bucket of the digest.
BUCKET_ROWS = 500
#: Buckets in a span.
SPAN = 1024
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def dealt(values: tuple, place: Column, use=F.lit) -> Column:
    """One of the values by the place of the source (from 0), repeating."""
    turn = F.pmod(place, F.lit(len(values)))
    chosen = F.when(turn == 0, use(values[0]))
    for i, v in enumerate(values[1:], 1):
        chosen = chosen.when(turn == i, use(v))
    return chosen


def time_of(schedule: tuple[tuple[float, float], ...], delivered: Column) -> Column:
    """The time at which a source with this schedule has delivered that fraction of its words."""
    areas = [0.0]
    for (t0, w0), (t1, w1) in zip(schedule, schedule[1:], strict=False):
        areas.append(areas[-1] + (w0 + w1) / 2 * (t1 - t0))
    area, out = delivered * F.lit(areas[-1]), None
    for k, ((t0, w0), (t1, w1)) in enumerate(zip(schedule, schedule[1:], strict=False)):
        rest = F.greatest(area - F.lit(areas[k]), F.lit(0.0))
        here = F.lit(t0) + F.lit(2.0) * rest / (F.lit(w0) + F.sqrt(F.greatest(F.lit(w0 * w0) + F.lit(2 * (w1 - w0) / (t1 - t0)) * rest, F.lit(1e-300))))
        here = F.least(here, F.lit(t1))
        last = k == len(schedule) - 2
        out = here if out is None and last else F.when(area < F.lit(areas[k + 1]), here) if out is None else out.otherwise(here) if last else out.when(area < F.lit(areas[k + 1]), here)
    return out


def source_targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, passes: int = PASSES) -> DataFrame:
    """Adds place (from 0, by code point, null last), weight and target to sources(source, source_size)."""
    everything = Window.partitionBy(F.lit(0))
    placed = sources.withColumn("place", F.row_number().over(everything.orderBy(F.col("source").asc_nulls_last())) - 1)
    placed = placed.withColumn("weight", dealt(weights, F.col("place"))).withColumn("most", passes * F.col("source_size"))
    filling = everything.orderBy(F.col("most") / F.col("weight"), "place")
    before, onward = filling.rowsBetween(Window.unboundedPreceding, -1), filling.rowsBetween(0, Window.unboundedFollowing)
    level = (F.sum("source_size").over(everything) * F.lit(share) - F.coalesce(F.sum("most").over(before), F.lit(0))) / F.sum("weight").over(onward)
    placed = placed.withColumn("level", level)
    open_ = F.when(F.col("most") > F.col("level") * F.col("weight"), F.struct(F.col("most") / F.col("weight"), "place", "level"))
    water = F.min(open_).over(everything)["level"]
    target = F.least(F.col("most").cast("double"), F.coalesce(water * F.col("weight"), F.col("most").cast("double")))
    return placed.select("source", "source_size", "place", "weight", target.alias("target"))


def mixed(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", keep: tuple[str, ...] = ("doc_id",), weights: tuple[int, ...] = WEIGHTS, schedules: tuple = SCHEDULES, share: float = SHARE, passes: int = PASSES) -> DataFrame:
    """The kept columns of every row, with size, source_size, target, taken and turns, range-sorted by position.

    turns holds a struct (position, words) for each pass that takes words of the row; the last row that a source reaches
    gives only the words that its target still lacks. A null text has size 0 and takes nothing; a null source is a source
    of its own, after all others; rows with one key and size lie side by side in any order, so repeated rows share their
    words between them. An empty table gives an empty result. Only the named columns are read.
    """
    small = written(docs.select(F.struct(*keep).alias("kept"), F.col(source).alias("source"), F.coalesce(F.concat(F.lit("="), F.col(source)), F.lit("")).alias("own"), word_count(F.col(text)).alias("size"), F.md5(F.coalesce(F.col(key).cast("string"), F.lit(""))).alias("digest")), "sizes")
    buckets = max(1, -(-small.count() // BUCKET_ROWS))
    small = small.withColumn("bucket", F.pmod(F.floor(F.conv(F.substring("digest", 1, 8), 16, 10).cast("long") * F.lit(buckets) / F.lit(1 << 32)), F.lit(buckets)).cast("long"))
    sums = small.groupBy("own", "bucket").agg(F.first("source").alias("source"), F.sum("size").alias("words"))
    sources = source_targets(sums.groupBy("own").agg(F.first("source").alias("source"), F.sum("words").alias("source_size")).select("source", "source_size"), weights, share, passes)
    sources = sources.withColumn("own", F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))).drop("source")
    sums = sums.withColumn("span", F.floor(F.col("bucket") / SPAN))
    before = lambda column, by, order: F.coalesce(F.sum(column).over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = sums.groupBy("own", "span").agg(F.sum("words").alias("words")).select("own", "span", before("words", ["own"], "span").alias("base"))
    starts = sums.withColumn("start", before("words", ["own", "span"], "bucket")).join(spans, ["own", "span"])
    starts = starts.select("own", "bucket", (F.col("start") + F.col("base")).alias("start")).join(sources, "own")
    within = Window.partitionBy("own", "bucket").orderBy("digest", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = small.join(starts, ["own", "bucket"]).withColumn("at", F.col("start") + F.coalesce(F.sum("size").over(within), F.lit(0)))
    due = F.floor(F.col("target")).cast("long")

    def turn(k: int) -> Column:
        begin = F.col("at") + k * F.col("source_size")
        words = F.greatest(F.lit(0), F.least(F.col("size"), due - begin))
        when = dealt(tuple(schedules), F.col("place"), lambda s: time_of(s, begin.cast("double") / F.nullif(due, F.lit(0))))
        return F.when(words > 0, F.struct(when.alias("position"), words.cast("long").alias("words")))

    turns = F.array_compact(F.array(*[turn(k) for k in range(passes)]))
    taken = F.aggregate("turns", F.lit(0).cast("long"), lambda a, t: a + t["words"])
    out = rows.withColumn("turns", turns).select("kept", "size", "source_size", "target", taken.alias("taken"), "turns", "digest")
    return out.orderBy(F.get("turns", F.lit(0))["position"].asc_nulls_last(), "digest").select("kept.*", "size", "source_size", "target", "taken", "turns")


def training_turns(mix: DataFrame) -> DataFrame:
    """A row for each pass over each row that the mix takes, with position and words."""
    rows = mix.select("*", F.explode("turns").alias("turn")).drop("turns")
    return rows.select(*[c for c in rows.columns if c != "turn"], F.col("turn.position").alias("position"), F.col("turn.words").alias("words"))


def training_rows(mix: DataFrame) -> DataFrame:
    """training_turns(), range-sorted by position."""
    return training_turns(mix).orderBy("position")
