"""Spatial weights: constructors, accessors, lag.

Weights are two DataFrames: nodes (id, and for kernels the diagonal) and edges (i, j, w). Nodes without edges are isolates
and stay in every result. All constructors are equi-joins on keys that Catalyst can shuffle:
contiguity on vertices or edges, distance bands on grid cells, nearest neighbours on nested cells,
fine where points are dense. None collects rows or joins all pairs.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..plans.iterate import apart, kept, scope
from .geometry import segments, with_points

EARTH_MILES, EARTH_KM = 3959.0, 6371.0
KERNELS = ("triangular", "uniform", "epanechnikov", "quartic", "gaussian", "quadratic")


@dataclass
class Weights:
    nodes: DataFrame
    edges: DataFrame

    def kept(self) -> Weights:
        """The same weights, written once, for plans that use them often."""
        return Weights(kept(self.nodes), kept(self.edges))


# Contiguity.


def _key(c: Column, eps: float) -> Column:
    """Equal coordinates have equal keys; -0.0 is 0.0."""
    return F.floor(c / eps) if eps else c + F.lit(0.0)


def _met(parts: DataFrame, coords: list[str], eps: float) -> DataFrame:
    """Distinct (i, j) of rows of parts (id, coords) that agree in all coords, within eps."""
    keys = [f"k{n}" for n in range(len(coords))]
    a = parts.select(F.col("id").alias("i"), *(F.col(c).alias(f"a{n}") for n, c in enumerate(coords)), *(_key(F.col(c), eps).alias(k) for c, k in zip(coords, keys, strict=True)))
    b = parts.select(F.col("id").alias("j"), *(F.col(c).alias(f"b{n}") for n, c in enumerate(coords)), *(_key(F.col(c), eps).alias(k) for c, k in zip(coords, keys, strict=True)))
    if eps:
        for k in keys:
            b = b.withColumn(k, F.explode(F.array(F.col(k) - 1, F.col(k), F.col(k) + 1)))
    out = a.join(apart(b), keys).where("i <> j")
    if eps:
        for n in range(len(coords)):
            out = out.where(F.abs(F.col(f"a{n}") - F.col(f"b{n}")) <= eps)
    return out.select("i", "j").distinct()


def _point_pairs(layer: DataFrame, rook: bool) -> DataFrame:
    from .voronoi import adjacent

    return adjacent(layer, rook)


def _contiguity(layer: DataFrame, pairs: DataFrame, order: int, include_lower_order: bool) -> Weights:
    nodes = layer.select("id")
    first = pairs
    if order > 1:
        first = kept(pairs)
        seen, frontier = first, first
        for _ in range(order - 1):
            step = frontier.join(first.select(F.col("i").alias("j"), F.col("j").alias("k")), "j").select("i", F.col("k").alias("j")).where("i <> j").distinct()
            frontier = kept(step.join(seen, ["i", "j"], "left_anti"))
            seen = seen.unionByName(frontier)
        pairs = seen if include_lower_order else frontier
    return Weights(nodes, pairs.select("i", "j", F.lit(1.0).alias("w")))


def _checked(order: int, precision_threshold: float) -> None:
    if order < 1:
        raise ValueError("order must be 1 or more")
    if precision_threshold < 0:
        raise ValueError("precision_threshold must be 0 or more")


def queen_weights(layer: DataFrame, order: int = 1, include_lower_order: bool = False, precision_threshold: float = 0.0) -> Weights:
    """Polygons (or Voronoi cells of points) that share a vertex. order k: those k steps away (all up to k with include_lower_order)."""
    _checked(order, precision_threshold)
    if "rings" not in layer.columns:
        return _contiguity(layer, _point_pairs(layer, False), order, include_lower_order)
    # A vertex once per polygon, without a shuffle; -0.0 is 0.0.
    own = F.array_distinct(F.transform(F.flatten("rings"), lambda p: F.struct((p.x + F.lit(0.0)).alias("x"), (p.y + F.lit(0.0)).alias("y"))))
    v = layer.select("id", F.explode(own).alias("p")).select("id", "p.x", "p.y")
    return _contiguity(layer, _met(v, ["x", "y"], precision_threshold), order, include_lower_order)


def rook_weights(layer: DataFrame, order: int = 1, include_lower_order: bool = False, precision_threshold: float = 0.0) -> Weights:
    """Polygons (or Voronoi cells of points) that share an edge between two vertices."""
    _checked(order, precision_threshold)
    if "rings" not in layer.columns:
        return _contiguity(layer, _point_pairs(layer, True), order, include_lower_order)
    end = lambda s, k: F.struct((s[f"x{k}"] + F.lit(0.0)).alias("x"), (s[f"y{k}"] + F.lit(0.0)).alias("y"))
    ends = lambda a, b: F.struct(a.alias("a"), b.alias("b"))
    if precision_threshold:
        # Which end of an edge comes first can differ within the tolerance, so both ways are sent.
        own = F.flatten(F.transform(segments(F.col("rings")), lambda s: F.array(ends(end(s, 1), end(s, 2)), ends(end(s, 2), end(s, 1)))))
    else:
        own = F.transform(segments(F.col("rings")), lambda s: ends(F.least(end(s, 1), end(s, 2)), F.greatest(end(s, 1), end(s, 2))))
    both = layer.select("id", F.explode(F.array_distinct(own)).alias("s")).select("id", F.col("s.a.x").alias("x1"), F.col("s.a.y").alias("y1"), F.col("s.b.x").alias("x2"), F.col("s.b.y").alias("y2"))
    return _contiguity(layer, _met(both, ["x1", "y1", "x2", "y2"], precision_threshold), order, include_lower_order)


# Distance.


def _space(layer: DataFrame, is_arc: bool) -> tuple[DataFrame, list[str]]:
    """(id, x, y ...): plane coordinates, or with is_arc those of the unit sphere of longitude x and latitude y."""
    p = with_points(layer)
    if not is_arc:
        return p, ["x", "y"]
    lon, lat = F.radians("x"), F.radians("y")
    return p.select("id", (F.cos(lat) * F.cos(lon)).alias("x"), (F.cos(lat) * F.sin(lon)).alias("y"), F.sin(lat).alias("z")), ["x", "y", "z"]


def _length(chord: Column, is_arc: bool, is_mile: bool) -> Column:
    """Of a chord in _space: itself, or along the great circle."""
    return 2 * (EARTH_MILES if is_mile else EARTH_KM) * F.asin(F.least(chord / 2, F.lit(1.0))) if is_arc else chord


def _reach(d: float, is_arc: bool, is_mile: bool) -> float:
    """d as a distance in _space, a little more to be safe from rounding."""
    if is_arc:
        d = 2 * math.sin(min(d / (EARTH_MILES if is_mile else EARTH_KM) / 2, math.pi / 2))
    return d * (1 + 1e-9)


def _named(p: DataFrame, dims: list[str], who: str, prefix: str) -> DataFrame:
    return p.select(F.col("id").alias(who), *(F.col(c).alias(f"{prefix}_{c}") for c in dims))


def _cells(p: DataFrame, dims: list[str], prefix: str, cell: float | Column, around: bool) -> DataFrame:
    """With the grid cell of each row as c_<dim>, or with around a row for it and each cell beside it."""
    for c in dims:
        k = F.floor(F.col(f"{prefix}_{c}") / cell)
        p = p.withColumn(f"c_{c}", F.explode(F.array(k - 1, k, k + 1)) if around else k)
    return p


def within(layer: DataFrame, reach: float, is_arc: bool = False, is_mile: bool = True) -> DataFrame:
    """(i, j, d) of all pairs at most `reach` apart: an equi-join on grid cells of that size, then the exact distance."""
    p, dims = _space(layer, is_arc)
    r = _reach(reach, is_arc, is_mile)
    # The side that is sent to the cells around is streamed: a task holds the rows of one cell, and few go around if only few i are asked for.
    a = _cells(_named(p, dims, "i", "a"), dims, "a", r, True)
    b = _cells(_named(p, dims, "j", "b"), dims, "b", r, False)
    out = a.join(apart(b), [f"c_{c}" for c in dims]).where("i <> j").select("i", "j", _length(F.sqrt(squares(dims)), is_arc, is_mile).alias("d"))
    return out.where(F.col("d") <= reach)


#: Cells are halved at most so often; two places closer than that are told apart by their distance only.
FINEST = 50


def nearest_in(p: DataFrame, dims: list[str], k: int, distance: Callable[[list[str]], Column], square: bool, only: DataFrame | None = None) -> DataFrame:
    """(i, j, s, rank): the k nearest other rows of each row of p (id, dims) (or of the ids in only) by s, ties by id.

    distance makes s of columns a_<dim> and b_<dim>: at least the largest difference in a dimension, or its square.
    Points at one place are searched once, and of a place only its k + 1 smallest ids can be
    neighbours; so a place that very many rows share costs no more than others. The box of all places is halved in each
    dimension again and again. A place starts at the finest such cell that still holds a few places, whether it is in a
    crowd or far from all others, and is joined with the cells around it. Those with enough neighbours nearer than the edge
    of that square are settled, the others go on with cells of twice the size. A cell in which many places start has few
    places, so few meet a crowd from outside.
    """
    if k < 1:
        raise ValueError("k must be 1 or more")
    each = k + 2
    p = kept(p.where(" and ".join(f"{c} is not null" for c in dims)).select("id", *dims))
    ids = kept(p.withColumn("n", F.row_number().over(Window.partitionBy(*dims).orderBy("id"))).where(F.col("n") <= k + 1).drop("n"))
    places = kept(ids.groupBy(*dims).agg(F.min("id").alias("id")))
    box = places.agg(F.count(F.lit(1)).alias("n"), *(F.min(c).alias(f"lo_{c}") for c in dims), *(F.max(c).alias(f"hi_{c}") for c in dims)).first()
    if not box.n:
        return p.select(F.col("id").alias("i"), F.col("id").alias("j"), F.lit(0.0).alias("s"), F.lit(1).alias("rank")).limit(0)
    wide = max(box[f"hi_{c}"] - box[f"lo_{c}"] for c in dims) or 1.0
    at = lambda c, prefix, level: F.floor((F.col(f"{prefix}_{c}") - F.lit(box[f"lo_{c}"])) / F.lit(wide) * F.pow(F.lit(2.0), level))
    cells = [f"c_{c}" for c in dims]

    def celled(q: DataFrame, prefix: str, levels: list[int]) -> DataFrame:
        """Each row of q once for each level, with its cell there."""
        q = q.withColumn("level", F.explode(F.array(*map(F.lit, levels))))
        return q.withColumns({f"c_{c}": at(c, prefix, F.col("level")) for c in dims})

    def poor(q: DataFrame) -> DataFrame:
        """The cells that hold under `each` places; written, so that a join with them has plain exchanges, whose skewed partitions Spark splits."""
        return kept(q.groupBy("level", *cells).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") < each).drop("n"))

    # First among every fifth level, then among those between: cells only get poorer with the level.
    all_ = _named(places, dims, "i", "a")
    split = celled(all_, "a", list(range(5, FINEST + 1, 5)))
    coarse = split.join(apart(poor(split)), ["level", *cells]).groupBy("i").agg(F.min("level").alias("first"))
    coarse = kept(all_.join(apart(coarse), "i", "left").select(*all_.columns, F.coalesce("first", F.lit(FINEST + 5)).alias("first")))
    between = coarse.withColumn("level", F.explode(F.sequence(F.col("first") - 4, F.least(F.col("first") - 1, F.lit(FINEST))))).withColumns({f"c_{c}": at(c, "a", F.col("level")) for c in dims})
    fine = between.join(apart(poor(between)), ["level", *cells]).groupBy("i").agg(F.min("level").alias("fine"))
    todo = coarse.join(apart(fine), "i", "left").select(*all_.columns, F.greatest(F.lit(0), F.least(F.lit(FINEST), F.coalesce("fine", "first") - 1)).cast("int").alias("level"))
    if only is not None:
        p = kept(p.join(apart(only.select("id")), "id", "left_semi"))
        todo = todo.join(apart(p.select(*(F.col(c).alias(f"a_{c}") for c in dims)).distinct()), [f"a_{c}" for c in dims], "left_semi")
    todo, done = kept(todo), []
    there = _named(ids, dims, "j", "b")
    top, all_of = Window.partitionBy("i").orderBy("s", "j"), Window.partitionBy("i")
    while levels := sorted(r.level for r in todo.select("level").distinct().collect()):  # FINEST + 1 at most
        a = todo.withColumns({f"c_{c}": at(c, "a", F.col("level")) for c in dims})
        for c in cells:
            a = a.withColumn(c, F.explode(F.array(F.col(c) - 1, F.col(c), F.col(c) + 1)))
        got = a.join(apart(celled(there, "b", levels)), ["level", *cells]).select("i", "level", *(f"a_{c}" for c in dims), "j", distance(dims).alias("s"))
        got = got.withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= k + 1)
        # The nearest side of the square is at least one cell away.
        size = F.lit(wide) / F.pow(F.lit(2.0), "level") * (1 - 1e-9)
        good = (F.col("level") == 0) | (F.count(F.lit(1)).over(all_of) == k + 1) & (F.max("s").over(all_of) < (size * size if square else size))
        got = kept(got.withColumn("good", good))
        done.append(got.where("good").drop("level", "good"))
        # Each place has a row, its own at least.
        todo = kept(got.where("not good and rank = 1").select("i", *(f"a_{c}" for c in dims), (F.col("level") - 1).alias("level")))
    found = done[0]
    for more in done[1:]:
        found = found.unionByName(more)
    # Every point of a place takes the place's list without itself.
    own = p.select(F.col("id").alias("own"), *(F.col(c).alias(f"a_{c}") for c in dims))
    out = own.join(apart(found.drop("rank")), [f"a_{c}" for c in dims]).where("own <> j").select(F.col("own").alias("i"), "j", "s")
    return out.withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= k)


def squares(dims: list[str]) -> Column:
    """The squared distance, which decides nearness, so that ties are those of the coordinates."""
    return sum(((F.col(f"a_{c}") - F.col(f"b_{c}")) * (F.col(f"a_{c}") - F.col(f"b_{c}")) for c in dims), F.lit(0.0))


def nearest(layer: DataFrame, k: int, is_arc: bool = False, is_mile: bool = True, only: DataFrame | None = None) -> DataFrame:
    """(i, j, d, rank): the k nearest other points of each (or of the ids in only), ties by id."""
    p, dims = _space(layer, is_arc)
    with scope() as needed:
        out = needed(kept(nearest_in(p, dims, k, squares, True, only)))
    return out.select("i", "j", _length(F.sqrt("s"), is_arc, is_mile).alias("d"), "rank")


def min_distthreshold(layer: DataFrame, is_arc: bool = False, is_mile: bool = True) -> DataFrame:
    """One row with `threshold`: the least distance at which every point has a neighbour."""
    return nearest(layer, 1, is_arc, is_mile).agg(F.max("d").alias("threshold"))


def _weight(power: float, is_inverse: bool) -> Column:
    return F.when(F.col("d") > 0, F.pow(F.col("d"), F.lit(-float(power)))).otherwise(F.lit(1.0)) if is_inverse else F.lit(1.0)


def distance_weights(layer: DataFrame, dist_thres: float, power: float = 1.0, is_inverse: bool = False, is_arc: bool = False, is_mile: bool = True) -> Weights:
    """Points at most dist_thres apart, with weight 1 or d ** -power (1 at distance 0)."""
    if dist_thres <= 0:
        raise ValueError("dist_thres must be over 0")
    return Weights(layer.select("id"), within(layer, dist_thres, is_arc, is_mile).select("i", "j", _weight(power, is_inverse).alias("w")))


def knn_weights(layer: DataFrame, k: int, power: float = 1.0, is_inverse: bool = False, is_arc: bool = False, is_mile: bool = True) -> Weights:
    """Exactly the k nearest of each point (fewer only if there are fewer points)."""
    return Weights(layer.select("id"), nearest(layer, k, is_arc, is_mile).select("i", "j", _weight(power, is_inverse).alias("w")))


def kernel(z: Column, kind: str) -> Column:
    """The kernel's value at z = d / bandwidth, 0 beyond 1."""
    if kind not in KERNELS:
        raise ValueError(f"kernel_method must be one of {', '.join(KERNELS)}")
    value = {
        "triangular": 1 - z,
        "uniform": F.lit(0.5),
        "epanechnikov": 0.75 * (1 - z * z),
        "quadratic": 0.75 * (1 - z * z),
        "quartic": 15 / 16 * (1 - z * z) * (1 - z * z),
        "gaussian": F.exp(-z * z / 2) / math.sqrt(2 * math.pi),
    }[kind]
    return F.when(z <= 1, value).otherwise(0.0)


def _with_diagonal(nodes: DataFrame, edges: DataFrame, kind: str, use_kernel_diagonals: bool) -> Weights:
    """The weight of each point itself is a column `diagonal` of the nodes, the kernel's value at 0 or, without use_kernel_diagonals, 1. It is no link."""
    own = kernel(F.lit(0.0), kind) if use_kernel_diagonals else F.lit(1.0)
    return Weights(nodes.withColumn("diagonal", own), edges)


def kernel_weights(layer: DataFrame, bandwidth: float, kernel_method: str, use_kernel_diagonals: bool = False, power: float = 1.0, is_inverse: bool = False, is_arc: bool = False, is_mile: bool = True) -> Weights:
    """Kernel of the distance over a fixed bandwidth (of d ** -power with is_inverse), for points within it."""
    if bandwidth <= 0:
        raise ValueError("bandwidth must be over 0")
    d = F.when(F.col("d") > 0, F.pow("d", F.lit(-float(power)))).otherwise(0.0) if is_inverse else F.col("d")
    edges = within(layer, bandwidth, is_arc, is_mile).select("i", "j", kernel(d / bandwidth, kernel_method).alias("w"))
    return _with_diagonal(layer.select("id"), edges, kernel_method, use_kernel_diagonals)


def kernel_knn_weights(layer: DataFrame, k: int, kernel_method: str, adaptive_bandwidth: bool = True, use_kernel_diagonals: bool = False, power: float = 1.0, is_inverse: bool = False, is_arc: bool = False, is_mile: bool = True) -> Weights:
    """Kernel over the k nearest; the bandwidth is each point's own k-th distance, or the largest of all."""
    near = nearest(layer, k, is_arc, is_mile)
    if adaptive_bandwidth:
        near = near.withColumn("h", F.max("d").over(Window.partitionBy("i")))
    else:
        near = kept(near)
        near = near.crossJoin(F.broadcast(near.agg(F.max("d").alias("h"))))  # one row
    d = F.when(F.col("d") > 0, F.pow("d", F.lit(-float(power)))).otherwise(0.0) if is_inverse else F.col("d")
    z = F.coalesce(F.try_divide(d, F.col("h")), F.lit(0.0))
    return _with_diagonal(layer.select("id"), near.select("i", "j", kernel(z, kernel_method).alias("w")), kernel_method, use_kernel_diagonals)


# By hand.


def create_weights(spark: SparkSession, num_obs: int) -> Weights:
    """Nodes 1 ... num_obs without edges."""
    return Weights(spark.range(1, num_obs + 1), spark.createDataFrame([], "i long, j long, w double"))


def set_neighbors(w: Weights, idx: int, nbrs: list[int], wvals: list[float] | None = None) -> Weights:
    """w with the neighbours of idx replaced; an idx under 1 changes nothing."""
    if idx < 1:
        return w
    if wvals is not None and len(wvals) != len(nbrs):
        raise ValueError("nbrs and wvals must have the same length")
    spark = w.edges.sparkSession
    new = spark.createDataFrame([(idx, j, float(x)) for j, x in zip(nbrs, wvals or [1.0] * len(nbrs), strict=True)], "i long, j long, w double")
    return Weights(w.nodes, w.edges.where(F.col("i") != idx).unionByName(new))


def set_neighbors_with_weights(w: Weights, idx: int, nbrs: list[int], wvals: list[float]) -> Weights:
    return set_neighbors(w, idx, nbrs, wvals)


def update_weights(w: Weights) -> Weights:
    """Statistics are computed when asked for; nothing is stale."""
    return w


# Accessors.


def degrees(w: Weights) -> DataFrame:
    """(id, n): the number of neighbours, 0 for isolates."""
    d = w.edges.groupBy(F.col("i").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return w.nodes.join(d, "id", "left").select("id", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def asymmetric_links(w: Weights) -> DataFrame:
    """(i, j) of the links without a link back."""
    e = w.edges.select("i", "j")
    return e.join(apart(e.select(F.col("j").alias("i"), F.col("i").alias("j"))), ["i", "j"], "left_anti")


def is_symmetric(w: Weights) -> DataFrame:
    return asymmetric_links(w).agg((F.count(F.lit(1)) == 0).alias("is_symmetric"))


def has_isolates(w: Weights) -> DataFrame:
    return degrees(w).agg((F.count_if(F.col("n") == 0) > 0).alias("has_isolates"))


def weights_stats(w: Weights) -> DataFrame:
    """One row: num_obs, sparsity, min, max, mean and median neighbours, has_isolates."""
    n = F.count(F.lit(1))
    return degrees(w).agg(
        n.alias("num_obs"), F.try_divide(F.sum("n"), n.cast("double") * n).alias("sparsity"), F.min("n").alias("min_neighbors"), F.max("n").alias("max_neighbors"), F.avg("n").alias("mean_neighbors"), F.median("n").alias("median_neighbors"), (F.count_if(F.col("n") == 0) > 0).alias("has_isolates")
    )


def weights_sparsity(w: Weights) -> DataFrame:
    return weights_stats(w).select("sparsity")


def min_neighbors(w: Weights) -> DataFrame:
    return weights_stats(w).select("min_neighbors")


def max_neighbors(w: Weights) -> DataFrame:
    return weights_stats(w).select("max_neighbors")


def mean_neighbors(w: Weights) -> DataFrame:
    return weights_stats(w).select("mean_neighbors")


def median_neighbors(w: Weights) -> DataFrame:
    return weights_stats(w).select("median_neighbors")


def weights_summary(w: Weights) -> DataFrame:
    """(position, name, value): eight rows, values as strings; fractions in the fewest digits that name them, with an exponent only under 0.0001 or from 1e16 on."""
    one = weights_stats(w).crossJoin(F.broadcast(is_symmetric(w)))
    # Java's text of a double has an exponent from 0.001 down, and at times a digit too many.
    plain = F.udf(lambda x: None if x is None else repr(float(x)), "string")
    kinds = dict(one.dtypes)
    text = lambda c: plain(c) if kinds[c] == "double" else F.col(c).cast("string")
    names = ["number of observations:", "is symmetric:", "sparsity:", "# min neighbors:", "# max neighbors:", "# mean neighbors:", "# median neighbors:", "has isolates:"]
    cols = ["num_obs", "is_symmetric", "sparsity", "min_neighbors", "max_neighbors", "mean_neighbors", "median_neighbors", "has_isolates"]
    rows = F.array(*[F.struct(F.lit(k).alias("position"), F.lit(a).alias("name"), text(c).alias("value")) for k, (a, c) in enumerate(zip(names, cols, strict=True), 1)])
    return one.select(F.explode(rows).alias("r")).select("r.*")


def get_neighbors(w: Weights, idx: int) -> DataFrame:
    return w.edges.where(F.col("i") == idx).select("j")


def get_neighbors_weights(w: Weights, idx: int) -> DataFrame:
    return w.edges.where(F.col("i") == idx).select("j", "w")


def spatial_lag(w: Weights, data: DataFrame, column: str, standardize: bool = True) -> DataFrame:
    """(id, lag): the weighted mean (or sum) of the neighbours' values; null for isolates.

    Neighbours with a null value are left out.
    """
    x = data.select(F.col("id").alias("j"), F.col(column).cast("double").alias("x")).where("x is not null")
    total = F.sum(F.col("w") * F.col("x"))
    got = w.edges.join(x, "j").groupBy(F.col("i").alias("id")).agg((F.try_divide(total, F.sum("w")) if standardize else total).alias("lag"))
    return w.nodes.join(got, "id", "left")


def as_matrix(w: Weights, most: int = 2000) -> DataFrame:
    """A row per node with a column per node (the id as its name), 0 where there is no link; refused beyond `most` nodes."""
    ids = [r.id for r in w.nodes.orderBy("id").limit(most + 1).collect()]
    if len(ids) > most:
        raise ValueError(f"a dense matrix of over {most} nodes; use the edges")
    wide = w.edges.groupBy("i").pivot("j", ids).agg(F.sum("w"))
    return w.nodes.join(wide, w.nodes["id"] == wide["i"], "left").drop("i").na.fill(0.0, [str(i) for i in ids])
