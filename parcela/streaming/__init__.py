"""Filters on streams, and streams into tables."""

from __future__ import annotations

from pyspark.sql import DataFrame

from parcela.operators.filters import QueryFilter
from parcela.sources.workspace import Workspace


def matching(stream: DataFrame, where: QueryFilter, **how) -> DataFrame:
    """The rows of a stream that a filter holds for; filters are narrow, so any stream keeps its state and its order."""
    return stream.where(where.condition(stream.schema, **how))


def into_table(stream: DataFrame, workspace: Workspace, name: str, checkpoint: str, **trigger):
    """Starts a query that adds each batch of a stream to a table, under new object ids.

    A batch is one commit, whose manifest names the batch too, so a batch that comes again after a failure, wherever that
    was, is not added twice.
    """
    source = f"{name} from {checkpoint}"

    def add(rows: DataFrame, batch: int) -> None:
        if workspace.last_batch(source) < batch:
            workspace.commit({name: workspace.open(name).inserted(rows)}, batch=(source, batch))

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
