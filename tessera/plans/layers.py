"""Spatial layers derived from the driver's tables, by formulas that any SQL engine repeats.

A layer is a DataFrame with an `id` and either `rings` (polygons: an array of rings, each an
array of points) or `x`, `y` (points), beside its attributes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def square(x: Column, y: Column) -> Column:
    """The unit square whose lower left corner is (x, y), as one closed ring."""
    point = lambda a, b: F.struct((x + a).cast("double").alias("x"), (y + b).cast("double").alias("y"))
    return F.array(F.array(point(0, 0), point(1, 0), point(1, 1), point(0, 1), point(0, 0)))


def cents(c: str) -> Column:
    """An amount in whole cents, whose sums are exact in any order."""
    return F.round(F.col(c) * 100).cast("bigint")


def nation_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """25 unit squares; value: cents of its customers' balances; other: of its suppliers'; region."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint").alias("id"), F.col("n_regionkey").cast("bigint").alias("region"))
    c = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").cast("bigint").alias("id")).agg(F.sum(cents("c_acctbal")).alias("value"))
    s = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").cast("bigint").alias("id")).agg(F.sum(cents("s_acctbal")).alias("other"))
    x, y = F.col("id") % 5, F.floor(F.col("id") / 5)
    out = n.join(c, "id", "left").join(s, "id", "left")
    return out.select("id", x.alias("x"), y.alias("y"), F.coalesce("value", F.lit(0)).cast("double").alias("value"), F.coalesce("other", F.lit(0)).cast("double").alias("other"), "region", square(x, y).alias("rings"))


WIDTH = 40


def customer_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A square per customer, WIDTH to a row; value: balance; other: nation; hot: balance over 5000; mid: nation under 12."""
    x, y = F.col("id") % WIDTH, F.floor(F.col("id") / WIDTH)
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("bigint").alias("id"), F.col("c_acctbal").alias("value"), F.col("c_nationkey").cast("double").alias("other"), F.col("c_mktsegment").alias("segment"))
    return c.select("id", x.alias("x"), y.alias("y"), "value", "other", (F.col("value") > 5000).cast("int").alias("hot"), (F.col("other") < 12).cast("int").alias("mid"), "segment", square(x, y).alias("rings"))


def part_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A point per part, irregular; value: retail price."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("bigint").alias("id"), F.col("p_retailprice").alias("value"), F.col("p_size").cast("double").alias("other"))
    return p.select("id", (F.col("id") * 7919 % 1009).cast("double").alias("x"), (F.col("id") * 104729 % 1013).cast("double").alias("y"), "value", "other")


def part_globe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The points of parts as degrees of longitude (x) and latitude (y)."""
    p = part_points(spark, sf_dir)
    return p.select("id", (F.col("x") / 1009 * 360 - 180).alias("x"), (F.col("y") / 1013 * 160 - 80).alias("y"), "value", "other")


def supplier_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returned line items (event) of all line items (base) per supplier."""
    x = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").cast("bigint").alias("id"))
    return x.agg(F.count_if(F.col("l_returnflag") == "R").alias("event"), F.count(F.lit(1)).alias("base"))


#: The layers in DuckDB.
SQL = {
    "nation_grid": """nation_grid as (
        select cast(n_nationkey as bigint) as id, cast(n_nationkey % 5 as bigint) as x, cast(n_nationkey // 5 as bigint) as y,
            cast(coalesce((select sum(cast(round(c_acctbal * 100) as bigint)) from customer where c_nationkey = n_nationkey), 0) as double) as value,
            cast(coalesce((select sum(cast(round(s_acctbal * 100) as bigint)) from supplier where s_nationkey = n_nationkey), 0) as double) as other, cast(n_regionkey as bigint) as region
        from nation)""",
    "customer_grid": f"""customer_grid as (
        select cast(c_custkey as bigint) as id, cast(c_custkey % {WIDTH} as bigint) as x, cast(c_custkey // {WIDTH} as bigint) as y, c_acctbal as value, cast(c_nationkey as double) as other,
            cast(c_acctbal > 5000 as int) as hot, cast(c_nationkey < 12 as int) as mid, c_mktsegment as segment
        from customer)""",
    "part_points": """part_points as (
        select cast(p_partkey as bigint) as id, cast(cast(p_partkey as bigint) * 7919 % 1009 as double) as x, cast(cast(p_partkey as bigint) * 104729 % 1013 as double) as y, p_retailprice as value, cast(p_size as double) as other
        from part)""",
    "supplier_rates": """supplier_rates as (
        select cast(l_suppkey as bigint) as id, cast(count(*) filter (l_returnflag = 'R') as bigint) as event, cast(count(*) as bigint) as base from lineitem group by 1)""",
}
SQL["part_globe"] = SQL["part_points"] + ", part_globe as (select id, x / 1009 * 360 - 180 as x, y / 1013 * 160 - 80 as y, value, other from part_points)"
