"""Map classification: cut points of one numeric column. Nulls are left out.

Quantiles are taken from counts of distinct values: one aggregation, then a running count
over the distinct values. The running count is made per range partition and shifted by the
totals of the partitions before, so no task sorts all values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..plans.iterate import kept

#: Distinct values that natural_breaks takes at most, in one task.
EXACT_VALUES = 1_000_000


def counted(df: DataFrame, column: str) -> DataFrame:
    """(x, n): the distinct values and how often each occurs."""
    return df.select(F.col(column).cast("double").alias("x")).where("x is not null and not isnan(x)").groupBy("x").agg(F.count(F.lit(1)).alias("n"))


def ranked(counts: DataFrame) -> DataFrame:
    """(x, n, upto): with the number of rows with at most x."""
    parts = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Written once: range bounds are sampled, and a second run must not draw others.
    dealt = kept(counts.repartitionByRange(parts, "x").withColumn("part", F.spark_partition_id()))
    totals = dealt.groupBy("part").agg(F.sum("n").alias("t"))
    before = totals.select("part", (F.sum("t").over(Window.orderBy("part")) - F.col("t")).alias("before"))  # a row per partition
    own = F.sum("n").over(Window.partitionBy("part").orderBy("x"))
    return dealt.withColumn("own", own).join(F.broadcast(before), "part").select("x", "n", (F.col("own") + F.col("before")).alias("upto"))


def order_statistics(counts: DataFrame, positions: list) -> DataFrame:
    """One row: q0, q1 ... at 0-based fractional positions, columns made from `total`, linear between neighbours."""
    r = ranked(counts)
    total = r.agg(F.max("upto").alias("total"))
    at = total.select("total", *(F.greatest(F.lit(0.0), F.least(p(F.col("total")), F.col("total") - 1.0)).alias(f"p{k}") for k, p in enumerate(positions)))
    r = r.crossJoin(F.broadcast(at))  # one row
    aggs = []
    for k in range(len(positions)):
        lo = F.floor(F.col(f"p{k}"))
        here = lambda i: (F.col("upto") > i) & (F.col("upto") - F.col("n") <= i)
        hi = F.least(lo + 1, F.col("total") - 1)
        aggs += [F.max(F.when(here(lo), F.col("x"))).alias(f"a{k}"), F.max(F.when(here(hi), F.col("x"))).alias(f"b{k}"), F.max(F.col(f"p{k}") - lo).alias(f"f{k}")]
    row = r.agg(*aggs)
    return row.select(*((F.col(f"a{k}") + (F.col(f"b{k}") - F.col(f"a{k}")) * F.col(f"f{k}")).alias(f"q{k}") for k in range(len(positions))))


def _stacked(row: DataFrame, columns: list) -> DataFrame:
    """(position, value) from one row."""
    pairs = F.array(*[F.struct(F.lit(k).alias("position"), c.alias("value")) for k, c in enumerate(columns, 1)])
    return row.select(F.explode(pairs).alias("r")).select("r.position", "r.value")


def _hazen(share: float):
    return lambda total: total * share - 0.5


def quantile_breaks(df: DataFrame, column: str, k: int) -> DataFrame:
    """k - 1 cut points at i / k, by Hazen's rule: position p n - 1/2."""
    if k < 2:
        raise ValueError("k must be 2 or more")
    row = order_statistics(counted(df, column), [_hazen(i / k) for i in range(1, k)])
    return _stacked(row, [F.col(f"q{i}") for i in range(k - 1)])


def percentile_breaks(df: DataFrame, column: str) -> DataFrame:
    """Cut points at 1, 10, 50, 90 and 99 per cent, by Hazen's rule."""
    row = order_statistics(counted(df, column), [_hazen(p) for p in (0.01, 0.1, 0.5, 0.9, 0.99)])
    return _stacked(row, [F.col(f"q{i}") for i in range(5)])


def hinge_breaks(df: DataFrame, column: str, hinge: float) -> DataFrame:
    """Quartiles (position p (n - 1)) and fences at hinge times their range."""
    row = order_statistics(counted(df, column), [lambda t, p=p: (t - 1) * p for p in (0.25, 0.5, 0.75)])
    q1, q2, q3 = F.col("q0"), F.col("q1"), F.col("q2")
    return _stacked(row, [q1 - hinge * (q3 - q1), q1, q2, q3, q3 + hinge * (q3 - q1)])


def hinge15_breaks(df: DataFrame, column: str) -> DataFrame:
    return hinge_breaks(df, column, 1.5)


def hinge30_breaks(df: DataFrame, column: str) -> DataFrame:
    return hinge_breaks(df, column, 3.0)


def stddev_breaks(df: DataFrame, column: str) -> DataFrame:
    """The mean and one and two sample standard deviations to either side."""
    x = F.col(column).cast("double")
    row = df.agg(F.avg(x).alias("m"), F.stddev_samp(x).alias("s"))
    return _stacked(row, [F.col("m") + k * F.col("s") for k in (-2, -1, 0, 1, 2)])


def natural_breaks(df: DataFrame, column: str, k: int, bins: int | None = None) -> DataFrame:
    """The k classes with the least sum of squares within (Jenks), each cut the last value of the lower class.

    The optimum over distinct values and their counts, by dynamic programming with
    divide and conquer in one task; refused beyond EXACT_VALUES distinct values. With bins, values are first merged into that many
    bins of neighbouring values, each with its count, sum, sum of squares and largest value, and the optimum is that of the bins.
    """
    if k < 2:
        raise ValueError("k must be 2 or more")
    r = kept(ranked(counted(df, column)))
    top = r.agg(F.max("upto").alias("total"), F.count(F.lit(1)).alias("values")).first()
    if (bins or top["values"]) > EXACT_VALUES:
        raise ValueError(f"{top['values']} different values; natural breaks are found among {EXACT_VALUES} at most: give a number of bins")
    bin_ = F.floor((F.col("upto") - F.col("n")) * bins / F.lit(max(1, top.total or 1))) if bins else F.col("x")
    x = F.col("x")
    merged = r.groupBy(bin_.alias("bin")).agg(F.sum("n").cast("double").alias("n"), F.sum(x * F.col("n")).alias("s"), F.sum(x * x * F.col("n")).alias("q"), F.max("x").alias("x"))

    def run(pdf):
        import numpy as np
        import pandas as pd

        pdf = pdf.sort_values("x")
        v = pdf["x"].to_numpy()
        mean = (pdf["s"].sum() / pdf["n"].sum()) if len(v) else 0.0
        n = np.concatenate(([0], np.cumsum(pdf["n"].to_numpy())))
        s1 = (pdf["s"] - mean * pdf["n"]).to_numpy()
        s2 = (pdf["q"] - 2 * mean * pdf["s"] + mean * mean * pdf["n"]).to_numpy()
        s, q = np.concatenate(([0], np.cumsum(s1))), np.concatenate(([0], np.cumsum(s2)))
        m = len(v)
        classes = min(k, m)
        if classes < 2:
            return pd.DataFrame({"position": np.zeros(0, "int32"), "value": np.zeros(0)})
        best = np.full(m + 1, np.inf)
        best[1:] = q[1:] - s[1:] * s[1:] / n[1:]
        best[0] = 0
        cuts = []
        for c in range(2, classes + 1):
            new, cut = np.full(m + 1, np.inf), np.zeros(m + 1, int)
            todo = [(c, m, c - 1, m - 1)]
            while todo:
                lo, hi, a, b = todo.pop()
                if lo > hi:
                    continue
                mid = (lo + hi) // 2
                j = np.arange(a, min(b, mid - 1) + 1)
                cost = best[j] + (q[mid] - q[j]) - (s[mid] - s[j]) ** 2 / (n[mid] - n[j])
                at = int(cost.argmin())
                new[mid], cut[mid] = cost[at], j[at]
                todo += [(lo, mid - 1, a, int(j[at])), (mid + 1, hi, int(j[at]), b)]
            best = new
            cuts.append(cut)
        out, at = [], m
        for cut in reversed(cuts):
            at = cut[at]
            out.append(v[at - 1])
        return pd.DataFrame({"position": np.arange(1, classes, dtype="int32"), "value": out[::-1]})

    return merged.groupBy().applyInPandas(run, "position int, value double")
