"""What the operators share: the shared folder, written tables and Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parcela.sources.shared import scratch

#: Rows in one Arrow batch. Documents are long, so the default of 10,000 rows would hold too much text at once.
BATCH_ROWS = 500


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and returns it as read again: cuts the lineage, survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Steps:
    """Written tables of one operation, in a folder that is deleted when its result has been written elsewhere."""

    def __init__(self, spark: SparkSession, name: str, within: str | None = None) -> None:
        path = scratch(spark, name)
        self.spark, self.path, self.n = spark, f"{within}/{path.rpartition('/')[2]}" if within else path, 0

    def write(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.path}/{self.n}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, n: int) -> None:
        """Deletes the n-th table, which nothing reads any more."""
        drop_path(self.spark, f"{self.path}/{n}")

    def result(self, df: DataFrame, name: str) -> DataFrame:
        """Writes the result, and deletes the steps."""
        out = written(df, name)
        drop_path(self.spark, self.path)
        return out


def drop_path(spark: SparkSession, path: str) -> None:
    """Deletes a path of the shared folder, whatever store it is in."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def small_batches(spark: SparkSession) -> None:
    """Keeps the Arrow batches of whole documents small."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def sized_parts(column: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """Row ranges of a string column that hold at most so many bytes each (a longer row stands alone)."""
    ends = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, 4 * column.offset) if len(column) else np.zeros(1, np.int32)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(ends, ends[first] + most, "right")) - 1)
        yield first, last
        first = last


def list_array(values: pa.Array | np.ndarray, counts: np.ndarray) -> pa.ListArray:
    """A list column from concatenated values and each row's count."""
    ends = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=ends[1:])
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values))


def range_part(docs: DataFrame, key: str, parts: int) -> Column:
    """The part of each row, from 0, by ranges of an integer key that hold about as many rows; null keys come first.

    The bounds are found from the keys alone, so nothing else of the rows has to be computed twice, as it would be to
    sample rows for repartitionByRange(). A row finds its part by halving.
    """
    cuts = docs.agg(F.percentile_approx(F.col(key).cast("long"), [i / parts for i in range(1, parts)] or [0.5], 100 * parts)).first()[0] or []
    cuts = sorted(set(cuts)) if parts > 1 else []
    if not cuts:
        return F.lit(0)
    bounds, steps = F.array(*[F.lit(c).cast("long") for c in cuts]), [1 << i for i in reversed(range(len(cuts).bit_length()))]
    halve = lambda at, step: F.when(F.get(bounds, at + step - 1) <= F.col(key), at + step).otherwise(at)
    return F.aggregate(F.array(*[F.lit(x) for x in steps]), F.lit(0), halve)
