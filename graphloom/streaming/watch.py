"""File changes as a stream: what a change invalidates, debounced per micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from graphloom.functions.columns import source_kind


def invalidation(path: Column) -> Column:
    """What a changed file invalidates; null if nothing."""
    name = F.substring_index(path, "/", -1)
    return (
        F.when(name == "package.json", "manifest").when(name.rlike(r"^tsconfig.*\.json$"), "tsconfig").when(name == "CODEOWNERS", "codeowners")
        .when(name.rlike(r"\.config\.[^/]*$"), "framework").when(name.rlike(r"schema.*\.json$"), "schema").when(name.rlike(r"config.*\.json$"), "config")
        .when(source_kind(path).isNotNull(), "source")
    )


def rebuild_on_change(changes: DataFrame, rebuild: Callable[[DataFrame, int], None], checkpoint: str, **trigger: object) -> StreamingQuery:
    """Calls ``rebuild`` once per micro-batch with the distinct (path, invalidates) of a stream of changed paths; the batch id is the generation."""
    relevant = changes.select("path", invalidation(F.col("path")).alias("invalidates")).where("invalidates is not null")

    def batch(rows: DataFrame, generation: int) -> None:
        distinct = rows.distinct()
        if not distinct.isEmpty():
            rebuild(distinct, generation)

    return relevant.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
