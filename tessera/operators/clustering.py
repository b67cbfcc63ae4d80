"""Spatially constrained clustering: regions of contiguous units that are alike.

Sums of squares, join counts, fragmentation and the spanning tree of `skater` are DataFrame
plans. Pruning, linkage and search follow one decision after the other, so a graph is sent to
one task, and is refused beyond UNITS units (MATRIX for linkages that need all pairs);
restarts of a search are rows, each of which any task can take.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from ..functions.scale import scaled
from ..plans.iterate import components, kept, scope
from . import regions as R
from .geometry import area, perimeter
from .weights import Weights

UNITS, MATRIX = 2_000_000, 6_000
SEED = 123456789
REDCAP = ("firstorder-singlelinkage", "fullorder-completelinkage", "fullorder-averagelinkage", "fullorder-singlelinkage", "fullorder-wardlinkage")
SCHC = ("single", "complete", "average", "ward")


class Graph:
    """Scaled variables and links of all units, by ascending id."""

    def __init__(self, w: Weights, data: DataFrame, columns: list[str], scale_method: str, bound_variable: str | None, distances: DataFrame | None, links: DataFrame | None = None, most: int = UNITS) -> None:
        x = scaled(data, columns, scale_method)
        if bound_variable:
            x = x.join(data.select("id", F.col(bound_variable).cast("double").alias("_bound")), "id")
        n = x.count()
        if n > most:
            raise ValueError(f"{n} units; this method takes at most {most}")
        rows = x.orderBy("id").toPandas()
        if rows.isna().any().any():
            raise ValueError("the variables must not be null")
        self.ids = rows["id"].to_numpy()
        self.x = rows[columns].to_numpy(float)
        self.bound = rows["_bound"].to_numpy() if bound_variable else None
        e = (links if links is not None else w.edges).select("i", "j").where("i <> j").toPandas()
        i, j = np.searchsorted(self.ids, e["i"]), np.searchsorted(self.ids, e["j"])
        self.links: list[list[int]] = [[] for _ in self.ids]
        for a, b in sorted({*zip(i.tolist(), j.tolist(), strict=True), *zip(j.tolist(), i.tolist(), strict=True)}):
            self.links[a].append(b)
        self.given = None
        if distances is not None:
            if n > MATRIX:
                raise ValueError(f"given distances are for at most {MATRIX} units")
            d = distances.select("i", "j", "d").toPandas()
            a, b = np.searchsorted(self.ids, d["i"]), np.searchsorted(self.ids, d["j"])
            self.given = np.zeros((n, n))
            self.given[a, b] = self.given[b, a] = d["d"]


def _solved(w: Weights, g: Graph, solve: Callable[[Graph], np.ndarray]) -> DataFrame:
    """(id, cluster) from one task."""
    spark = w.nodes.sparkSession
    sent = spark.sparkContext.broadcast(g)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _ in batches:
            g = sent.value
            yield pd.DataFrame({"id": g.ids, "cluster": R.ranked_labels(solve(g))})

    return spark.range(0, 1, 1, 1).mapInPandas(run, "id bigint, cluster bigint")


def _checked_k(k: int, w: Weights) -> None:
    if k < 1 or k > w.nodes.count():
        raise ValueError("k must be from 1 to the number of units")


def minimum_spanning_tree(edges: DataFrame) -> DataFrame:
    """(i, j, d): a least spanning forest of edges (i, j, d), i < j, by Boruvka's rounds.

    Each round takes every component's least edge (ties by i, then j), a minimum per
    component with map-side combine, and joins the components; there are O(log n) rounds.
    """
    e = kept(edges.select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), "d").where("i <> j").distinct())
    nodes = e.select(F.col("i").alias("id")).union(e.select("j")).distinct()
    label = kept(nodes.select("id", F.col("id").alias("component")))
    chosen = None
    while True:
        a = label.select(F.col("id").alias("i"), F.col("component").alias("ci"))
        b = label.select(F.col("id").alias("j"), F.col("component").alias("cj"))
        open_ = kept(e.join(a, "i").join(b, "j").where("ci <> cj").select("i", "j", "d", "ci", "cj"))
        both = open_.select("i", "j", "d", "ci", "cj", F.col("ci").alias("c")).union(open_.select("i", "j", "d", "ci", "cj", "cj"))
        new = kept(both.groupBy("c").agg(F.min(F.struct("d", "i", "j", "ci", "cj")).alias("m")).select("m.*").distinct())
        if new.isEmpty():
            return chosen if chosen is not None else new.select("i", "j", "d")
        chosen = new.select("i", "j", "d") if chosen is None else chosen.unionByName(new.select("i", "j", "d"))
        e = open_.select("i", "j", "d")
        # Only components are joined, which are at most half as many each round.
        met = new.select(F.col("ci").alias("id")).union(new.select("cj")).distinct()
        merged = components(met, new.select(F.col("ci").alias("i"), F.col("cj").alias("j"))).withColumnRenamed("component", "to").withColumnRenamed("id", "component")
        label = kept(label.join(merged, "component", "left").select("id", F.coalesce("to", "component").alias("component")))


def _distances(w: Weights, x: DataFrame, columns: list[str], distance_method: str) -> DataFrame:
    e = w.edges.select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")).where("i <> j").distinct()
    e = e.join(x.select(F.col("id").alias("i"), *(F.col(c).alias(f"a_{c}") for c in columns)), "i").join(x.select(F.col("id").alias("j"), *(F.col(c).alias(f"b_{c}") for c in columns)), "j")
    diff = [F.col(f"a_{c}") - F.col(f"b_{c}") for c in columns]
    d = sum((F.abs(v) for v in diff), F.lit(0.0)) if distance_method == "manhattan" else F.sqrt(sum((v * v for v in diff), F.lit(0.0)))
    return e.select("i", "j", d.alias("d"))


def skater(k: int, w: Weights, data: DataFrame, columns: list[str], bound_variable: str | None = None, min_bound: float = 0.0, scale_method: str = "standardize", distance_method: str = "euclidean", distances: DataFrame | None = None) -> DataFrame:
    """(id, cluster): the least spanning tree of the links, cut k - 1 times where the sum of squares falls most."""
    _checked_k(k, w)
    e = _distances(w, scaled(data, columns, scale_method), columns, distance_method)
    if distances is not None:
        e = e.drop("d").join(distances.select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), "d"), ["i", "j"])
    g = Graph(w, data, columns, scale_method, bound_variable, None, links=minimum_spanning_tree(e))
    return _solved(w, g, lambda g: R.pruned(g.x, R.pairs(g.links).tolist(), k, g.bound, min_bound))


def redcap(k: int, w: Weights, data: DataFrame, columns: list[str], method: str = "fullorder-averagelinkage", bound_variable: str | None = None, min_bound: float = 0.0, scale_method: str = "standardize", distance_method: str = "euclidean", distances: DataFrame | None = None) -> DataFrame:
    """As skater, with the spanning tree from contiguity-constrained linkage."""
    if method not in REDCAP:
        raise ValueError(f"method must be one of {', '.join(REDCAP)}")
    if method == REDCAP[0]:
        return skater(k, w, data, columns, bound_variable, min_bound, scale_method, distance_method, distances)
    _checked_k(k, w)
    kind = method.split("-")[1].removesuffix("linkage")
    g = Graph(w, data, columns, scale_method, bound_variable, distances, most=UNITS if kind == "ward" else MATRIX)
    return _solved(w, g, lambda g: R.pruned(g.x, R.linkage(g.x, g.links, kind, 1, distance_method == "manhattan", g.given)[0], k, g.bound, min_bound))


def schc(k: int, w: Weights, data: DataFrame, columns: list[str], method: str = "average", bound_variable: str | None = None, min_bound: float = 0.0, scale_method: str = "standardize", distance_method: str = "euclidean", distances: DataFrame | None = None) -> DataFrame:
    """Contiguity-constrained agglomerative clustering, cut at k clusters.

    With a bound, the merges' tree is cut as in redcap, so that each cluster has min_bound.
    """
    if method not in SCHC:
        raise ValueError(f"method must be one of {', '.join(SCHC)}")
    _checked_k(k, w)
    g = Graph(w, data, columns, scale_method, bound_variable, distances, most=UNITS if method == "ward" else MATRIX)
    manhattan = distance_method == "manhattan"
    if bound_variable and min_bound > 0:
        return _solved(w, g, lambda g: R.pruned(g.x, R.linkage(g.x, g.links, method, 1, manhattan, g.given)[0], k, g.bound, min_bound))
    return _solved(w, g, lambda g: R.linkage(g.x, g.links, method, k, manhattan, g.given)[1])


def _searched(w: Weights, g: Graph, starts: int, seed: int, start: Callable, improve: Callable, key: Callable) -> DataFrame:
    """(id, cluster) of the best of many random starts, each a row; ties by the number of the start."""
    spark = w.nodes.sparkSession
    sent = spark.sparkContext.broadcast(g)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g = sent.value
        for pdf in batches:
            for s in pdf["id"].tolist():
                rng = np.random.default_rng([seed, s])
                label = start(g, rng, s)
                if label is None:
                    continue
                label = improve(g, label, rng)
                yield pd.DataFrame({"start": [s], "rank": [key(g, label)], "labels": [R.ranked_labels(label).tolist()]})

    parts = min(starts, 8 * spark.sparkContext.defaultParallelism)
    tried = kept(spark.range(0, starts, 1, parts).mapInPandas(run, "start bigint, rank array<double>, labels array<bigint>"))
    best = tried.select("rank", "start").orderBy("rank", "start").first()
    if best is None:
        raise ValueError("no start satisfied the bound")
    labels = np.array(tried.where(F.col("start") == best.start).first().labels)
    return spark.createDataFrame(pd.DataFrame({"id": g.ids, "cluster": labels}), "id bigint, cluster bigint")


def _objective(g: Graph, label: np.ndarray) -> float:
    return sum(R.cost(g.x[label == c]) for c in np.unique(label))


def _azp(p: int, w: Weights, data: DataFrame, columns: list[str], improve: Callable, inits: int, initial_regions: DataFrame | None, bound_variable: str | None, min_bound: float, scale_method: str, seed: int) -> DataFrame:
    _checked_k(p, w)
    g = Graph(w, data, columns, scale_method, bound_variable, None)
    given = None
    if initial_regions is not None:
        rows = initial_regions.select("id", "cluster").orderBy("id").toPandas()
        if len(rows) != len(g.ids):
            raise ValueError("initial_regions must have a row for each unit")
        given = rows["cluster"].to_numpy()

    def start(g: Graph, rng: np.random.Generator, s: int):
        if given is not None and s == 0:
            return given
        label = R.grown(g.links, p, rng)
        if g.bound is not None and min_bound > 0:
            for _ in range(200):
                held = np.bincount(label, g.bound, p)
                if (held >= min_bound).all():
                    return label
                label = R.grown(g.links, p, rng)
            # A tree cut under the bound is a start that satisfies it, if there is one at all.
            tree = R.spanning_tree(g.x, g.links, False)
            label = R.pruned(g.x, tree, p, g.bound, min_bound)
            return label if len(np.unique(label)) == p else None
        return label

    bound = lambda g: g.bound if min_bound > 0 else None
    return _searched(w, g, max(1, inits + 1), seed, start, lambda g, label, rng: improve(R.Regions(g.x, g.links, label, bound(g), min_bound), rng), lambda g, label: [_objective(g, label)])


def _greedily(r: R.Regions, rng: np.random.Generator) -> np.ndarray:
    R.greedy(r, rng)
    return r.label


def azp_greedy(p: int, w: Weights, data: DataFrame, columns: list[str], bound_variable: str | None = None, min_bound: float = 0.0, inits: int = 0, initial_regions: DataFrame | None = None, scale_method: str = "standardize", random_seed: int = SEED) -> DataFrame:
    """(id, cluster): p regions improved by moves of single units; inits further random starts."""
    return _azp(p, w, data, columns, _greedily, inits, initial_regions, bound_variable, min_bound, scale_method, random_seed)


def azp_sa(p: int, w: Weights, data: DataFrame, columns: list[str], cooling_rate: float = 0.85, sa_maxit: int = 1, bound_variable: str | None = None, min_bound: float = 0.0, inits: int = 0, initial_regions: DataFrame | None = None, scale_method: str = "standardize", random_seed: int = SEED) -> DataFrame:
    """As azp_greedy, by simulated annealing."""
    if not 0 < cooling_rate < 1:
        raise ValueError("cooling_rate must be between 0 and 1")
    return _azp(p, w, data, columns, lambda r, rng: R.annealed(r, rng, cooling_rate, sa_maxit), inits, initial_regions, bound_variable, min_bound, scale_method, random_seed)


def azp_tabu(p: int, w: Weights, data: DataFrame, columns: list[str], tabu_length: int = 10, conv_tabu: int = 10, bound_variable: str | None = None, min_bound: float = 0.0, inits: int = 0, initial_regions: DataFrame | None = None, scale_method: str = "standardize", random_seed: int = SEED) -> DataFrame:
    """As azp_greedy, by tabu search."""
    return _azp(p, w, data, columns, lambda r, rng: R.tabu(r, rng, tabu_length, conv_tabu), inits, initial_regions, bound_variable, min_bound, scale_method, random_seed)


def _maxp(w: Weights, data: DataFrame, columns: list[str], bound_variable: str, min_bound: float, iterations: int, improve: Callable, initial_regions: DataFrame | None, scale_method: str, seed: int) -> DataFrame:
    if min_bound <= 0:
        raise ValueError("min_bound must be over 0")
    g = Graph(w, data, columns, scale_method, bound_variable, None)
    given = None
    if initial_regions is not None:
        given = initial_regions.select("id", "cluster").orderBy("id").toPandas()["cluster"].to_numpy()

    def start(g: Graph, rng: np.random.Generator, s: int):
        return given if given is not None and s == 0 else R.grown_to_bound(g.x, g.links, g.bound, min_bound, rng)

    return _searched(w, g, max(1, iterations), seed, start, lambda g, label, rng: improve(R.Regions(g.x, g.links, label, g.bound, min_bound), rng), lambda g, label: [-float(len(np.unique(label))), _objective(g, label)])


def maxp_greedy(w: Weights, data: DataFrame, columns: list[str], bound_variable: str, min_bound: float, iterations: int = 99, initial_regions: DataFrame | None = None, scale_method: str = "standardize", random_seed: int = SEED) -> DataFrame:
    """(id, cluster): as many regions as possible with at least min_bound each, then the least sum of squares."""
    return _maxp(w, data, columns, bound_variable, min_bound, iterations, _greedily, initial_regions, scale_method, random_seed)


def maxp_sa(w: Weights, data: DataFrame, columns: list[str], bound_variable: str, min_bound: float, cooling_rate: float = 0.85, sa_maxit: int = 1, iterations: int = 99, initial_regions: DataFrame | None = None, scale_method: str = "standardize", random_seed: int = SEED) -> DataFrame:
    return _maxp(w, data, columns, bound_variable, min_bound, iterations, lambda r, rng: R.annealed(r, rng, cooling_rate, sa_maxit), initial_regions, scale_method, random_seed)


def maxp_tabu(w: Weights, data: DataFrame, columns: list[str], bound_variable: str, min_bound: float, tabu_length: int = 10, conv_tabu: int = 10, iterations: int = 99, initial_regions: DataFrame | None = None, scale_method: str = "standardize", random_seed: int = SEED) -> DataFrame:
    return _maxp(w, data, columns, bound_variable, min_bound, iterations, lambda r, rng: R.tabu(r, rng, tabu_length, conv_tabu), initial_regions, scale_method, random_seed)


# What a clustering is worth.


def sums_of_squares(clusters: DataFrame, data: DataFrame, columns: list[str], scale_method: str = "standardize") -> DataFrame:
    """(variable, total_ss, within_ss) of each scaled variable."""
    x = scaled(data, columns, scale_method).join(clusters.select("id", "cluster"), "id")
    long = x.select("cluster", F.explode(F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).alias("v")) for c in columns])).alias("r")).select("cluster", "r.variable", "r.v")
    per = long.groupBy("variable", "cluster").agg(F.count("v").alias("n"), F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("q"))
    total = F.sum("q") - F.sum("s") * F.sum("s") / F.sum("n")
    return per.groupBy("variable").agg(total.alias("total_ss"), F.sum(F.col("q") - F.col("s") * F.col("s") / F.col("n")).alias("within_ss"))


def clustering_stats(clusters: DataFrame, data: DataFrame, columns: list[str], scale_method: str = "standardize") -> DataFrame:
    """One row: total_ss, within_ss, between_ss and their ratio between / total."""
    s = sums_of_squares(clusters, data, columns, scale_method).agg(F.sum("total_ss").alias("total_ss"), F.sum("within_ss").alias("within_ss"))
    between = F.col("total_ss") - F.col("within_ss")
    return s.select("total_ss", "within_ss", between.alias("between_ss"), F.try_divide(between, "total_ss").alias("ratio"))


def _links(clusters: DataFrame, w: Weights) -> DataFrame:
    c = clusters.select("id", "cluster")
    e = w.edges.where("i <> j").select("i", "j")
    return e.join(c.select(F.col("id").alias("i"), F.col("cluster").alias("ci")), "i").join(c.select(F.col("id").alias("j"), F.col("cluster").alias("cj")), "j")


def join_count_ratio(clusters: DataFrame, w: Weights) -> DataFrame:
    """(cluster, n, neighbors, join_count, ratio) per cluster and, with a null cluster, over all."""
    per = _links(clusters, w).groupBy(F.col("ci").alias("cluster")).agg(F.count(F.lit(1)).alias("neighbors"), F.count_if(F.col("ci") == F.col("cj")).alias("join_count"))
    size = clusters.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    x = size.join(per, "cluster", "left").select("cluster", "n", F.coalesce("neighbors", F.lit(0)).alias("neighbors"), F.coalesce("join_count", F.lit(0)).alias("join_count"))
    total = x.agg(F.lit(None).cast(dict(x.dtypes)["cluster"]).alias("cluster"), F.sum("n").alias("n"), F.sum("neighbors").alias("neighbors"), F.sum("join_count").alias("join_count"))
    return x.unionByName(total).withColumn("ratio", F.coalesce(F.try_divide("join_count", "neighbors"), F.lit(0.0)))


def fragmentation(clusters: DataFrame, of: str = "cluster") -> DataFrame:
    """One row: n, entropy, entropy_star (over its maximum), simpson, simpson_star of the sizes of the clusters."""
    size = clusters.groupBy(of).agg(F.count(F.lit(1)).cast("double").alias("c"))
    # With p = c / t: -sum(p ln p) = ln t - sum(c ln c) / t.
    s = size.agg(F.count(F.lit(1)).alias("n"), F.sum("c").alias("t"), F.sum(F.col("c") * F.log("c")).alias("cl"), F.sum(F.col("c") * F.col("c")).alias("cc"))
    entropy, simpson = F.log("t") - F.col("cl") / F.col("t"), F.col("cc") / (F.col("t") * F.col("t"))
    return s.select("n", entropy.alias("entropy"), F.coalesce(F.try_divide(entropy, F.log(F.col("n").cast("double"))), F.lit(0.0)).alias("entropy_star"), simpson.alias("simpson"), (simpson * F.col("n")).alias("simpson_star"))


def pieces(clusters: DataFrame, w: Weights) -> DataFrame:
    """(id, cluster, piece): piece is the smallest id of the connected part of the cluster."""
    same = _links(clusters, w).where("ci = cj").select("i", "j")
    return clusters.select("id", "cluster").join(components(clusters.select("id"), same).withColumnRenamed("component", "piece"), "id")


def is_spatially_constrained(clusters: DataFrame, w: Weights) -> DataFrame:
    """One row: whether each cluster is one connected part."""
    x = pieces(clusters, w).groupBy("cluster").agg((F.min("piece") == F.max("piece")).alias("one"))
    return x.agg(F.bool_and("one").alias("spatially_constrained"))


def subcluster_fragmentation(clusters: DataFrame, w: Weights) -> DataFrame:
    """(cluster, n, entropy, entropy_star, simpson, simpson_star, min, max, mean) of the sizes of each cluster's pieces."""
    size = pieces(clusters, w).groupBy("cluster", "piece").agg(F.count(F.lit(1)).cast("double").alias("c"))
    s = size.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.sum("c").alias("t"), F.sum(F.col("c") * F.log("c")).alias("cl"), F.sum(F.col("c") * F.col("c")).alias("cc"), F.min("c").alias("min"), F.max("c").alias("max"), F.avg("c").alias("mean"))
    entropy, simpson = F.log("t") - F.col("cl") / F.col("t"), F.col("cc") / (F.col("t") * F.col("t"))
    return s.select("cluster", "n", entropy.alias("entropy"), F.coalesce(F.try_divide(entropy, F.log(F.col("n").cast("double"))), F.lit(0.0)).alias("entropy_star"), simpson.alias("simpson"), (simpson * F.col("n")).alias("simpson_star"), "min", "max", "mean")


def compactness(layer: DataFrame, clusters: DataFrame) -> DataFrame:
    """(cluster, area, perimeter, ipc): isoperimetric quotient of the sums of the members' areas and perimeters."""
    x = layer.select("id", area(F.col("rings")).alias("a"), perimeter(F.col("rings")).alias("p")).join(clusters.select("id", "cluster"), "id")
    s = x.groupBy("cluster").agg(F.sum("a").alias("area"), F.sum("p").alias("perimeter"))
    return s.select("cluster", "area", "perimeter", (4 * F.pi() * F.try_divide(F.col("area"), F.col("perimeter") * F.col("perimeter"))).alias("ipc"))


#: Units of each cluster from which paths are searched at once.
SOURCES = 16


def diameter(clusters: DataFrame, w: Weights) -> DataFrame:
    """(cluster, steps, ratio): the longest shortest path within each cluster, and over its size.

    A unit's eccentricity is bounded from both sides by its distance to units whose eccentricity is known. In each round paths
    are searched from SOURCES units of each cluster, those with the highest bounds, until no unit
    can be farther from another than what has been found; so a round holds SOURCES rows a unit, and not all pairs.
    """
    with scope() as needed:
        return needed(kept(_diameter(clusters, w)))


def _diameter(clusters: DataFrame, w: Weights) -> DataFrame:
    c = kept(clusters.select("id", "cluster"))
    same = kept(_links(c, w).where("ci = cj").select("i", "j"))
    size = kept(c.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")))
    # Bounds of each unit that may still matter; the first sources are any units, later ones by their bounds.
    open_ = kept(c.join(size, "cluster").select("id", "cluster", F.lit(0).cast("bigint").alias("low"), F.col("n").alias("high")))
    best = kept(size.select("cluster", F.lit(0).cast("bigint").alias("steps")))
    while True:
        rank = F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("high"), "low", F.xxhash64("id"), "id"))
        sources = kept(open_.withColumn("k", rank).where(F.col("k") <= SOURCES).select("id", "cluster"))
        if sources.isEmpty():
            break
        frontier = kept(sources.select(F.col("id").alias("a"), F.col("id").alias("i"), F.lit(0).cast("bigint").alias("d")))
        seen = frontier
        while True:
            step = frontier.join(same, "i").select("a", F.col("j").alias("i"), (F.col("d") + 1).alias("d")).distinct()
            frontier = kept(step.join(seen, ["a", "i"], "left_anti"))
            if frontier.isEmpty():
                break
            seen = seen.unionByName(frontier)
        far = kept(seen.groupBy("a").agg(F.max("d").alias("far")))
        best = kept(best.join(far.join(sources, F.col("a") == F.col("id")).groupBy("cluster").agg(F.max("far").alias("now")), "cluster", "left").select("cluster", F.greatest("steps", F.coalesce("now", "steps")).alias("steps")))
        near = seen.join(far, "a").groupBy(F.col("i").alias("id")).agg(F.max(F.greatest("d", F.col("far") - F.col("d"))).alias("above"), F.min(F.col("far") + F.col("d")).alias("below"))
        rest = open_.join(sources.select("id"), "id", "left_anti").join(near, "id", "left").join(best, "cluster")
        rest = rest.select("id", "cluster", F.greatest("low", F.coalesce("above", "low")).alias("low"), F.least("high", F.coalesce("below", "high")).alias("high"), "steps")
        open_ = kept(rest.where("high > steps").drop("steps"))
    return best.join(size, "cluster").select("cluster", F.col("steps").cast("int").alias("steps"), (F.col("steps") / F.col("n")).alias("ratio"))


def spatial_validation(layer: DataFrame, clusters: DataFrame, w: Weights) -> dict[str, DataFrame | None]:
    """All measures; compactness and diameter only of contiguous clusters, fragments of clusters only of others."""
    one = is_spatially_constrained(clusters, w)
    good = bool(one.first()[0])
    return {
        "spatially_constrained": one, "fragmentation": fragmentation(clusters), "join_count_ratio": join_count_ratio(clusters, w),
        "subcluster_fragmentation": None if good else subcluster_fragmentation(clusters, w),
        "compactness": compactness(layer, clusters) if good else None, "diameter": diameter(clusters, w) if good else None,
    }


def make_spatial(clusters: DataFrame, w: Weights) -> DataFrame:
    """(id, cluster): each cluster's largest connected part keeps its id; the other parts move as a whole.

    The smallest part moves first (then that of the smallest cluster, then that with the smallest id), to the adjacent cluster that is largest
    at that time, counting what has moved; ties go to that with most links, then to the smallest id. A part that no cluster
    reaches yet waits for the next round; one that none ever reaches keeps its cluster. Parts, not units, go
    to the driver, UNITS at most.
    """
    if clusters.count() != w.nodes.count():
        raise ValueError("there must be a cluster for each unit")
    p = kept(pieces(clusters, w))
    size = kept(p.groupBy("cluster", "piece").agg(F.count(F.lit(1)).alias("n")))
    main = size.withColumn("k", F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("n"), "piece")))
    main = kept(main.select("cluster", "piece", "n", (F.col("k") == 1).alias("main")))
    if (n := main.where("not main").count()) > UNITS:
        raise ValueError(f"{n} separate parts; at most {UNITS} can be moved")
    end = lambda who, name: p.join(main.drop("n"), ["cluster", "piece"]).select(F.col("id").alias(who), F.col("piece").alias(name), F.when(F.col("main"), F.col("cluster")).alias(f"{name}_main"))
    links = w.edges.where("i <> j").select("i", "j").join(end("i", "a"), "i").join(end("j", "b"), "j").where("a <> b and a_main is null")
    links = links.groupBy("a", "b_main", F.when(F.col("b_main").isNull(), F.col("b")).alias("b")).agg(F.count(F.lit(1)).alias("n")).collect()
    rows = main.where("not main").collect()
    settled = {r.cluster: r.n for r in main.where("main").collect()}
    total = Counter(settled)
    for r in rows:
        total[r.cluster] += r.n
    near: dict = defaultdict(list)
    for r in links:
        near[r.a].append((r.b_main, r.b, r.n))
    todo = sorted(rows, key=lambda r: (r.n, total[r.cluster], r.piece))
    to: dict = {}
    while todo:
        wait = []
        for r in todo:
            met: Counter = Counter()
            for cluster, piece, n in near[r.piece]:
                cluster = cluster if piece is None else to.get(piece)
                if cluster is not None:
                    met[cluster] += n
            if not met:
                wait.append(r)
                continue
            to[r.piece] = best = min(met, key=lambda c: (-settled[c], -met[c], c))
            settled[best] += r.n
        if len(wait) == len(todo):
            break
        todo = wait
    kind = dict(p.dtypes)
    moved = p.sparkSession.createDataFrame(list(to.items()), f"piece {kind['piece']}, to {kind['cluster']}")
    return p.join(moved, "piece", "left").select("id", F.coalesce("to", "cluster").alias("cluster"))
