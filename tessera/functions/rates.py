"""Empirical Bayes rates of events over bases. Rows with a null or a base of 0 have a null rate."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def is_binary(df: DataFrame, column: str) -> DataFrame:
    """One row: whether all values are 0 or 1 (a null is neither)."""
    return df.agg(F.coalesce(F.bool_and(F.coalesce(F.col(column).isin(0, 1), F.lit(False))), F.lit(True)).alias("is_binary"))


def _with_totals(df: DataFrame, event: str, base: str) -> DataFrame:
    x = df.select("id", F.col(event).cast("double").alias("o"), F.col(base).cast("double").alias("p"))
    x = x.withColumn("r", F.when(F.col("p") > 0, F.try_divide("o", "p")))
    # b = sum o / sum p; sum p (r - b)^2 = sum o r - b sum o, as sum p r = sum o.
    good = F.col("r").isNotNull()
    one = lambda c: F.sum(F.when(good, c))
    t = x.agg(one(F.col("o")).alias("so"), one(F.col("p")).alias("sp"), one(F.col("o") * F.col("r")).alias("sor"), F.count_if(good).alias("n"))
    b = F.try_divide("so", "sp")
    t = t.select(b.alias("b"), (F.try_divide(F.col("sor") - b * F.col("so"), F.col("sp")) - F.try_divide(b, F.try_divide("sp", "n"))).alias("a"))
    return x.crossJoin(F.broadcast(t))  # one row


def eb_rates(df: DataFrame, event: str, base: str) -> DataFrame:
    """(id, eb_rate, is_null): rates shrunk towards the overall rate by the variance between them."""
    x = _with_totals(df, event, base)
    a = F.greatest(F.col("a"), F.lit(0.0))
    w = F.coalesce(F.try_divide(a, a + F.col("b") / F.col("p")), F.lit(0.0))
    return x.select("id", F.when(F.col("r").isNotNull(), w * F.col("r") + (1 - w) * F.col("b")).alias("eb_rate"), F.col("r").isNull().alias("is_null"))


def eb_rates_standardization(df: DataFrame, event: str, base: str) -> DataFrame:
    """(id, z): rates less the overall rate, over their standard error; without variance between them, b / base alone."""
    x = _with_totals(df, event, base)
    v = F.col("a") + F.col("b") / F.col("p")
    v = F.when(v > 0, v).otherwise(F.col("b") / F.col("p"))
    return x.select("id", F.try_divide(F.col("r") - F.col("b"), F.sqrt(v)).alias("z"))
