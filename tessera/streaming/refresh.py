"""Lags and local Moran kept up to date while values arrive in a stream.

Not an operator of the batch API: each micro-batch brings (id, value, ts); the newest value of
each id is kept in a table, and the statistic is computed anew from it with the batch operator.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.lisa import local_moran
from ..operators.weights import Weights
from ..plans.iterate import kept


def latest(values: DataFrame) -> DataFrame:
    """The newest row of each id; ties by the larger value."""
    w = Window.partitionBy("id").orderBy(F.desc("ts"), F.desc("value"))
    return values.withColumn("k", F.row_number().over(w)).where("k = 1").drop("k")


def refreshed_moran(stream: DataFrame, w: Weights, out: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Call out(result, batch number) with (id, lisa, nn, quadrant) after every micro-batch of stream (id, value, ts)."""
    state: dict[str, DataFrame] = {}

    def each(batch: DataFrame, number: int) -> None:
        rows = batch.select("id", F.col("value").cast("double").alias("value"), "ts")
        state["rows"] = kept(latest(rows if "rows" not in state else state["rows"].unionByName(rows)))
        out(local_moran(w, state["rows"], "value").values(), number)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).start()
