"""Scaling of numeric columns by their moments."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

METHODS = ("raw", "standardize", "demean", "mad", "range_standardize", "range_adjust")


def scaled(df: DataFrame, columns: list[str], method: str = "standardize") -> DataFrame:
    """(id, columns...) as doubles, scaled; a column without spread becomes 0 (raw and demean but subtract or keep)."""
    if method not in METHODS:
        raise ValueError(f"scale_method must be one of {', '.join(METHODS)}")
    x = df.select("id", *(F.col(c).cast("double").alias(c) for c in columns))
    if method == "raw":
        return x
    t = x.agg(*(f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_samp), ("lo", F.min), ("hi", F.max))))
    x = x.crossJoin(F.broadcast(t))  # one row
    if method == "mad":
        t = x.agg(*(F.avg(F.abs(F.col(c) - F.col(f"_m_{c}"))).alias(f"_d_{c}") for c in columns))
        x = x.crossJoin(F.broadcast(t))
    out = []
    for c in columns:
        v, m, s, lo, hi = F.col(c), *(F.col(f"_{n}_{c}") for n in ("m", "s", "lo", "hi"))
        over = lambda a, b: F.when(F.col(c).isNotNull(), F.coalesce(F.try_divide(a, b), F.lit(0.0)))  # noqa: B023, E731
        value = {
            "standardize": lambda: over(v - m, s), "demean": lambda: v - m, "mad": lambda: over(v - m, F.col(f"_d_{c}")),
            "range_standardize": lambda: over(v - lo, hi - lo), "range_adjust": lambda: over(v, hi - lo),
        }[method]()
        out.append(value.alias(c))
    return x.select("id", *out)
