"""What iterative plans share: written intermediate tables and connected components."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

#: Tables written by open scopes, the innermost last; the first list has those of no scope.
_written: list[list[tuple[SparkSession, str]]] = [[]]


def scratch(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset, a temporary one for a driver that runs its tasks itself, and an error for a cluster,
    whose executors wouldn't see it.
    """
    if not (d := spark.conf.get("spark.checkpoint.dir", None)):
        if not spark.sparkContext.master.partition("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and the executors share")
        d = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", d)
    return d.rstrip("/")


def new_path(spark: SparkSession) -> str:
    """A path in the shared folder, removed at the end of the scope or of the driver."""
    path = f"{scratch(spark)}/tessera/{uuid.uuid4().hex}"
    _written[-1].append((spark, path))
    return path


def kept(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tessera_path = path
    return out


def apart(df: DataFrame) -> DataFrame:
    """df for a join by plain exchanges of both sides: the size of its files says little about the rows made of them, and what is broadcast passes the driver."""
    return df.hint("merge")


def stored(spark: SparkSession, data: bytes, name: str) -> str:
    """The path of a file of that name in a new folder of the shared folder."""
    path = f"{new_path(spark)}/{name}"
    put(spark, data, path)
    return path


def put(spark: SparkSession, data: bytes, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark._jsparkSession.sparkContext().hadoopConfiguration()).create(p, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()


def _removed(tables: list[tuple[SparkSession, str]]) -> None:
    for spark, path in tables:
        with contextlib.suppress(Exception):  # a stopped session, or a table that was never written
            jvm = spark._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsparkSession.sparkContext().hadoopConfiguration()).delete(p, True)


@contextlib.contextmanager
def scope():
    """Tables kept inside are removed at its end, but for those handed to the function it gives, which the plan returned still reads."""
    stay: set[str] = set()

    def needed(df: DataFrame) -> DataFrame:
        stay.add(df._tessera_path)
        return df

    mine: list[tuple[SparkSession, str]] = []
    _written.append(mine)
    try:
        yield needed
    finally:
        _written.remove(mine)
        _written[-1].extend(x for x in mine if x[1] in stay)
        _removed([x for x in mine if x[1] not in stay])


@atexit.register
def _at_exit() -> None:
    """Tables that a returned plan may read until the driver ends."""
    for tables in _written:
        _removed(tables)
        tables.clear()


#: Edges up to which components are finished on the driver; their size there is bounded by this.
SMALL = 200_000


def _finished(e: DataFrame) -> DataFrame:
    """(id, component) of at most SMALL edges (u, v), by union-find."""
    up: dict = {}

    def root(i):
        while (p := up.setdefault(i, i)) != i:
            up[i] = i = up[p]
        return i

    for u, v in e.select("u", "v").collect():
        u, v = root(u), root(v)
        up[max(u, v)] = min(u, v)
    kind = dict(e.dtypes)["u"]
    return e.sparkSession.createDataFrame([(i, root(i)) for i in list(up)], f"id {kind}, component {kind}")


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable from each node over edges (i, j), taken both ways.

    Large-star and small-star steps in turn until nothing changes: O(log n) rounds, each a
    minimum per node with map-side combine and a join. What is left is finished on the
    driver once it is small.
    """
    with scope() as needed:
        found = needed(kept(_components(edges)))
    return nodes.select("id").join(found, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def _components(edges: DataFrame) -> DataFrame:
    e = kept(edges.where("i <> j").select(F.greatest("i", "j").alias("u"), F.least("i", "j").alias("v")).distinct())
    before, n = None, e.count()
    while n > SMALL:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = kept(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m")))
        large = kept(both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        low = kept(large.groupBy("u").agg(F.min("v").alias("m")))
        pair = F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")))
        e = kept(large.join(low, "u").select(F.explode(pair).alias("x")).select("x.u", "x.v").where("u <> v").distinct())
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            break
        before, n = now, now[0]
    return e.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("component")) if n > SMALL else _finished(e)
