"""Nearest neighbours in attribute space and the local neighbour match test."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from ..functions.scale import scaled
from ..plans.iterate import apart, kept, scope
from .weights import knn_weights, nearest_in, squares

DISTANCES = ("euclidean", "manhattan")
#: Columns up to which nested cells prune (a cell has 3 ** FEW with those around it).
FEW = 4
#: Beyond that, rows that are sent to all tasks at once, and the most rows that are held against all.
BLOCK, MOST = 1 << 15, 1 << 18


def attribute_nearest(data: DataFrame, columns: list[str], k: int, distance_method: str = "euclidean") -> DataFrame:
    """(i, j, d, rank): the k rows nearest in the columns, ties by id; rows with a null are left out.

    With up to FEW columns the search is that of points, on nested cells. In more dimensions no cells prune, so rows
    are held against all: in blocks of BLOCK rows, each sent to the tasks, which keep the k best of
    it. That work grows with the square of the rows, so it is refused beyond MOST rows.
    """
    if distance_method not in DISTANCES:
        raise ValueError(f"distance_method must be one of {', '.join(DISTANCES)}")
    if len(columns) <= FEW:
        dims = [f"v{n}" for n in range(len(columns))]
        p = data.select("id", *((F.col(c).cast("double") + F.lit(0.0)).alias(v) for c, v in zip(columns, dims, strict=True)))
        manhattan = lambda ds: sum((F.abs(F.col(f"a_{c}") - F.col(f"b_{c}")) for c in ds), F.lit(0.0))
        with scope() as needed:
            out = needed(kept(nearest_in(p, dims, k, squares if distance_method == "euclidean" else manhattan, distance_method == "euclidean")))
        return out.select("i", "j", (F.sqrt("s") if distance_method == "euclidean" else F.col("s")).alias("d"), "rank")
    if (n := data.count()) > MOST:
        raise ValueError(f"{n} rows in {len(columns)} columns; with over {FEW} columns at most {MOST} rows are held against each other")
    x = data.select("id", *(F.col(c).cast("double").alias(f"v{n}") for n, c in enumerate(columns))).na.drop()
    x = kept(x.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(max(1, -(-x.count() // BLOCK))))))
    out = None
    for (b,) in sorted(x.select("block").distinct().collect()):
        part = x.where(F.col("block") == b).drop("block").orderBy("id").toPandas()
        sent = data.sparkSession.sparkContext.broadcast((part["id"].to_numpy(), part.drop(columns="id").to_numpy(float)))

        def run(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            ids, there = sent.value
            for pdf in batches:
                mine, own = pdf.drop(columns="id").to_numpy(float), pdf["id"].to_numpy()
                step = max(1, (1 << 22) // max(1, len(ids)))
                for a in range(0, len(own), step):
                    d = np.zeros((len(own[a : a + step]), len(ids)))
                    for c in range(there.shape[1]):
                        diff = mine[a : a + step, c, None] - there[None, :, c]
                        d += np.abs(diff) if distance_method == "manhattan" else diff * diff
                    d[own[a : a + step, None] == ids[None, :]] = np.inf
                    take = min(k, d.shape[1])
                    edge = np.partition(d, take - 1, 1)[:, take - 1 : take]
                    i, j = np.nonzero((d <= edge) & np.isfinite(d))
                    yield pd.DataFrame({"i": own[a : a + step][i], "j": ids[j], "s": d[i, j]})

        got = x.drop("block").mapInPandas(run, "i bigint, j bigint, s double")
        out = got if out is None else out.unionByName(got)
    if out is None:
        out = x.select(F.col("id").alias("i"), F.col("id").alias("j"), F.lit(0.0).alias("s")).limit(0)
    out = out.withColumn("rank", F.row_number().over(Window.partitionBy("i").orderBy("s", "j"))).where(F.col("rank") <= k)
    return out.select("i", "j", (F.sqrt("s") if distance_method == "euclidean" else F.col("s")).alias("d"), "rank")


def neighbor_match_test(layer: DataFrame, columns: list[str], k: int, scale_method: str = "standardize", distance_method: str = "euclidean", power: float = 1.0, is_inverse: bool = False, is_arc: bool = False, is_mile: bool = True) -> DataFrame:
    """(id, cardinality, probability): how many of the k nearest in space are among the k nearest in the columns,
    and the hypergeometric probability of just so many (null for none)."""
    if k < 1:
        raise ValueError("k must be 1 or more")
    near = knn_weights(layer, k, power, is_inverse, is_arc, is_mile).edges.select("i", "j")
    like = attribute_nearest(scaled(layer, columns, scale_method), columns, k, distance_method).select("i", "j")
    both = near.join(apart(like), ["i", "j"]).groupBy(F.col("i").alias("id")).agg(F.count(F.lit(1)).alias("v"))
    x = layer.select("id").join(apart(both), "id", "left").select("id", F.coalesce("v", F.lit(0)).alias("cardinality"))
    x = x.crossJoin(F.broadcast(layer.agg(F.count(F.lit(1)).alias("n"))))  # one row
    log_choose = lambda a, b: F.aggregate(F.sequence(F.lit(1).cast("bigint"), b.cast("bigint")), F.lit(0.0), lambda s, i: s + F.log((a - b + i).cast("double")) - F.log(i.cast("double")))
    choose = lambda a, b: F.when((b < 0) | (b > a), None).when(b == 0, 0.0).otherwise(log_choose(a, b))
    v, kk, rest = F.col("cardinality"), F.lit(k).cast("bigint"), F.col("n") - 1
    p = F.exp(choose(kk, v) + choose(rest - kk, kk - v) - choose(rest, kk))
    return x.select("id", "cardinality", F.when(v > 0, p).alias("probability"))
