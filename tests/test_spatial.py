"""Golden values on the 85-unit fixture of FIXTURES.md, and brute force on small random layers."""

import itertools
import math
import random
import re
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import breaks, rates, scale
from tessera.operators import clustering as C, lisa as L, match, regions as R, weights as W
from tessera.plans import iterate

TEXT = (Path(__file__).parent.parent / "FIXTURES.md").read_text()
ROWS = [x.split(",") for x in re.findall(r"^\d+,\d+,\d+,[\d ]+$", TEXT, re.M)]


@pytest.fixture(scope="module")
def guerry(spark):
    df = spark.createDataFrame([(int(a), float(b), float(c)) for a, b, c, _ in ROWS], "id long, crm double, lit double").cache()
    edges = spark.createDataFrame([(int(a), int(j), 1.0) for a, _, _, n in ROWS for j in n.split()], "i long, j long, w double").cache()
    return df, W.Weights(df.select("id"), edges)


def column(df, name, n=None):
    out = [r[name] for r in df.orderBy("id").collect()]
    return out[:n]


def test_summary(guerry):
    _, w = guerry
    s = W.weights_stats(w).first()
    assert (s.num_obs, s.min_neighbors, s.max_neighbors, s.median_neighbors, s.has_isolates) == (85, 2, 8, 5.0, False)
    assert abs(s.sparsity - 0.0581314878892734) < 1e-15 and abs(s.mean_neighbors - 4.94117647058824) < 1e-12
    assert W.is_symmetric(w).first()[0]
    assert [r.value for r in W.weights_summary(w).orderBy("position").collect()][:2] == ["85", "true"]


def test_summary_of_few_links(spark):
    """A sparsity under 0.001 is written without an exponent, as SQL does."""
    w = W.Weights(spark.range(100), spark.createDataFrame([(1, 2, 1.0), (2, 1, 1.0)], "i long, j long, w double"))
    assert [r.value for r in W.weights_summary(w).orderBy("position").collect()] == ["100", "true", "0.0002", "0", "1", "0.02", "0.0", "true"]


@pytest.mark.parametrize(
    ("f", "want"),
    [(L.local_moran, [0.516120231, 0.818275138, 0.794086560, 0.733161543, 0.228467334]), (L.local_geary, [0.987725319, 0.838345145, 0.702801925, 0.100402310, 0.244977901]), (L.local_g, [0.013819020, 0.016115180, 0.015686557, 0.008553106]), (L.local_gstar, [0.014270222, 0.015807678, 0.015485705, 0.008315062])],
)
def test_golden_statistics(guerry, f, want):
    df, w = guerry
    assert np.allclose(column(f(w, df, "crm").values(), "lisa", len(want)), want, atol=6e-10)


def test_golden_inference(guerry):
    df, w = guerry
    moran = L.permuted(L.local_moran(w, df, "crm"))
    assert abs(column(moran, "p", 1)[0] - 0.197) < 0.04
    lookup = L.permuted(L.local_moran(w, df, "crm"), permutation_method="lookup")
    assert abs(column(lookup, "p", 1)[0] - 0.197) < 0.05
    bi = L.local_bimoran(w, df, "crm", "lit")
    assert abs(column(bi.values(), "lisa", 1)[0] - 0.392663447638106) < 1e-9
    assert abs(column(L.permuted(bi), "p", 1)[0] - 0.269) < 0.04
    p = column(moran, "p")
    assert all(1 / 1000 <= x <= 0.5005 for x in p)
    again = L.permuted(L.local_moran(w, df.repartition(7), "crm"))
    assert column(again, "p") == p
    assert column(L.permuted(L.local_moran(w, df, "crm"), 99, seed=5), "p") != p
    c = L.lisa_clusters(moran, L.MORAN)
    assert set(column(c, "cluster")) <= {0, 1, 2, 3, 4} and 0 in column(c, "cluster")
    assert [r.label for r in L.lisa_labels(df, L.MORAN).orderBy("cluster").collect()] == ["Not significant", "High-High", "Low-Low", "Low-High", "High-Low", "Undefined", "Isolated"]


def test_golden_join_counts(spark, guerry):
    df, w = guerry
    top = {r.id for r in df.orderBy(F.desc("crm"), "id").limit(28).collect()}
    x = df.withColumn("t", F.col("id").isin(top).cast("int")).withColumn("u", 1 - F.col("t"))
    significant = lambda found: [r.id for r in found.where("p <= 0.05").orderBy("id").collect()]
    for f in (L.exact_joins, L.permuted):
        uni = f(L.local_joincount(w, x, "t"))
        assert significant(uni) == [51, 57, 69, 76] and abs(column(uni, "p", 1)[0] - 0.395) < 0.04
        assert significant(f(L.local_bijoincount(w, x, "t", "u"))) == [2, 3, 7, 19, 20, 37, 51, 53, 69, 76]
        assert {4, 11, 12, 28, 32, 79, 80} - {4} <= set(significant(f(L.local_quantilelisa(w, df, "crm", 4, 1)))) <= {4, 6, 11, 12, 28, 32, 79, 80}
    with pytest.raises(ValueError):
        L.local_bijoincount(w, x, "t", "t")
    with pytest.raises(ValueError):
        L.local_joincount(w, df, "crm")
    with pytest.raises(ValueError):
        L.local_quantilelisa(w, df, "crm", 4, 5)
    with pytest.raises(ValueError):
        L.local_multijoincount(w, x, ["t", "u"])
    with pytest.raises(ValueError):
        L.local_multiquantilelisa(w, df, ["crm", "lit"], [4], [1, 2])


def test_golden_breaks(guerry):
    df, _ = guerry
    got = lambda x: [r.value for r in x.orderBy("position").collect()]
    assert got(breaks.natural_breaks(df, "crm", 5)) == [9474, 16722, 23316, 29872]
    assert got(breaks.quantile_breaks(df, "crm", 5)) == [13270.5, 17704.5, 21476.5, 26743.5]
    assert got(breaks.hinge15_breaks(df, "crm")) == [-2356.5, 14790, 18785, 26221, 43367.5]
    assert got(breaks.hinge30_breaks(df, "crm")) == [-19503, 14790, 18785, 26221, 60514]
    assert np.allclose(got(breaks.percentile_breaks(df, "crm")), [5984.5, 12153, 18785, 29692, 36380.15])
    assert np.allclose(got(breaks.stddev_breaks(df, "crm")), [5362.458, 12661.699, 19960.941, 27260.183, 34559.425], atol=1e-3)


def test_natural_breaks_are_best(spark, monkeypatch):
    r = random.Random(0)
    for n in (1, 2, 3, 9):
        v = [float(r.randrange(30)) for _ in range(n)]
        df = spark.createDataFrame([(x,) for x in [*v, None]], "v double")
        got = [x.value for x in breaks.natural_breaks(df, "v", 3).orderBy("position").collect()]
        values = sorted(set(v))
        k = min(3, len(values))
        sse = lambda cuts: sum(float(np.var(g) * len(g)) for g in ([x for x in v if lo < x <= hi] for lo, hi in zip([-1, *cuts], [*cuts, 99])) if g)  # noqa: E731, B023
        best = min(sse(c) for c in itertools.combinations(values[:-1], k - 1))
        assert len(got) == k - 1 and abs(sse(got) - best) < 1e-9
    monkeypatch.setattr(breaks, "EXACT_VALUES", 50)
    df = spark.range(1000).select((F.col("id") % 500 + F.when(F.col("id") % 500 >= 250, 10_000).otherwise(0)).cast("double").alias("v"))
    with pytest.raises(ValueError):
        breaks.natural_breaks(df, "v", 2)
    assert abs([x.value for x in breaks.natural_breaks(df, "v", 2, bins=50).collect()][0] - 249) <= 10


def test_nearest_with_an_outlier(spark):
    """Points far from a crowd, and crowds within crowds, by brute force."""
    r = random.Random(3)
    rows = [(r.gauss(0, 1), r.gauss(0, 1)) for _ in range(150)] + [(5 + r.gauss(0, 1e-6), 5.0) for _ in range(60)] + [(1e9, 1e9), (1e9 + 1, 1e9), (-3e4, 2.0)] + [(7.0, 7.0)] * 9
    rows = [(i, x, y) for i, (x, y) in enumerate(rows)]
    df = spark.createDataFrame(rows, "id long, x double, y double")
    want = {i: [j for _, j in sorted(((x - a) * (x - a) + (y - b) * (y - b), j) for j, a, b in rows if j != i)[:5]] for i, x, y in rows}
    got = {}
    for e in W.nearest(df, 5).orderBy("i", "rank").collect():
        got.setdefault(e.i, []).append(e.j)
    assert got == want
    few = W.nearest(df, 5, only=df.where("id in (3, 210, 212)").select("id")).orderBy("i", "rank").collect()
    assert [e.j for e in few] == [j for i in (3, 210, 212) for j in want[i]]


def test_fragmentation(spark):
    c = spark.createDataFrame([(k, c) for c, n in enumerate((29, 28, 11, 8, 5, 4)) for k in range(n)], "id long, cluster long")
    f = C.fragmentation(c).first()
    assert np.allclose([f.entropy, f.entropy_star, f.simpson, f.simpson_star], [1.5302035777210896, 0.8540228775128775, 0.2561937716262976, 1.5371626297577854])


def test_make_spatial(spark, guerry):
    _, w = guerry
    before, after = ([int(v) for v in x.split(",")] for x in re.findall(r"^(?:in |out): ([\d,]+)$", TEXT, re.M))
    c = spark.createDataFrame(list(enumerate(before, 1)), "id long, cluster long")
    got = C.make_spatial(c, w)
    assert C.is_spatially_constrained(got, w).first()[0] and got.count() == 85
    p = C.pieces(c, w).groupBy("cluster", "piece").agg(F.collect_list("id").alias("ids")).collect()
    kept = {r.id: r.cluster for r in got.collect()}
    for k in set(before):
        largest = max((r for r in p if r.cluster == k), key=lambda r: len(r.ids))
        assert all(kept[i] == k for i in largest.ids)
    assert [kept[i] for i in range(1, 86)] == after
    assert not C.is_spatially_constrained(c, w).first()[0]


METHODS = {
    "skater": lambda w, x: C.skater(5, w, x, ["crm", "lit"]), **{m: lambda w, x, m=m: C.redcap(5, w, x, ["crm", "lit"], m) for m in C.REDCAP[1:]}, **{f"schc {m}": lambda w, x, m=m: C.schc(5, w, x, ["crm", "lit"], m) for m in C.SCHC},
    "azp_greedy": lambda w, x: C.azp_greedy(5, w, x, ["crm", "lit"]), "azp_sa": lambda w, x: C.azp_sa(5, w, x, ["crm", "lit"]), "azp_tabu": lambda w, x: C.azp_tabu(5, w, x, ["crm", "lit"], inits=2),
}


@pytest.mark.parametrize("name", METHODS)
def test_regions_are_contiguous(guerry, name):
    df, w = guerry
    c = METHODS[name](w, df).cache()
    assert sorted({r.cluster for r in c.collect()}) == [1, 2, 3, 4, 5] and c.count() == 85
    assert C.is_spatially_constrained(c, w).first()[0]
    sizes = [r["count"] for r in c.groupBy("cluster").count().orderBy("cluster").collect()]
    assert sizes == sorted(sizes, reverse=True)
    s = C.clustering_stats(c, df, ["crm", "lit"]).first()
    assert abs(s.total_ss - 2 * 84) < 1e-9 and 0 < s.ratio < 1 and abs(s.within_ss + s.between_ss - s.total_ss) < 1e-9
    if name not in ("schc single", "schc average"):
        assert s.ratio > 0.5
    assert C.redcap is not C.skater and (name != "skater" or column(C.redcap(5, w, df, ["crm", "lit"], C.REDCAP[0]), "cluster") == column(c, "cluster"))


def test_bounds(guerry):
    df, w = guerry
    held = lambda c: [r.s for r in c.join(df, "id").groupBy("cluster").agg(F.sum("crm").alias("s")).collect()]
    for c in (C.skater(4, w, df, ["lit"], "crm", 200000.0), C.schc(4, w, df, ["lit"], "ward", "crm", 200000.0), C.azp_greedy(4, w, df, ["lit"], "crm", 200000.0)):
        assert len(held(c)) == 4 and min(held(c)) >= 200000
    for f in (C.maxp_greedy, C.maxp_sa, C.maxp_tabu):
        c = f(w, df, ["lit"], "crm", 160000.0, iterations=6)
        assert min(held(c)) >= 160000 and len(held(c)) >= 6 and C.is_spatially_constrained(c, w).first()[0]
    start = C.skater(5, w, df, ["crm"])
    s = lambda c: C.clustering_stats(c, df, ["crm"]).first().ratio
    assert s(C.azp_tabu(5, w, df, ["crm"], initial_regions=start)) >= s(start) - 1e-9
    for bad in (lambda: C.skater(0, w, df, ["crm"]), lambda: C.skater(86, w, df, ["crm"]), lambda: C.redcap(3, w, df, ["crm"], "x"), lambda: C.maxp_greedy(w, df, ["crm"], "crm", 0.0)):
        with pytest.raises(ValueError):
            bad()


def test_spanning_tree_against_kruskal(spark, guerry):
    df, w = guerry
    t = {(r.i, r.j) for r in C.minimum_spanning_tree(C._distances(w, df, ["crm", "lit"], "euclidean")).collect()}
    x = np.array([[float(b), float(c)] for _, b, c, _ in ROWS])
    want = R.spanning_tree(x, [[int(j) - 1 for j in n.split()] for *_, n in ROWS], False)
    assert t == {(i + 1, j + 1) for i, j in want} and len(t) == 84


def test_linkage_against_plain_search():
    r = np.random.default_rng(2)
    n = 24
    x = r.normal(size=(n, 2))
    links = [[j for j in (i - 1, i + 1, i - 6, i + 6) if 0 <= j < n] for i in range(n)]
    for method in ("single", "complete", "average", "ward"):
        groups = {i: [i] for i in range(n)}

        def d(a, b, method=method):
            if method == "ward":
                u, v = x[a].mean(0), x[b].mean(0)
                return 2 * len(a) * len(b) / (len(a) + len(b)) * ((u - v) ** 2).sum()
            m = np.sqrt(((x[a][:, None] - x[b][None]) ** 2).sum(2))
            return {"single": m.min(), "complete": m.max(), "average": m.mean()}[method]

        while len(groups) > 4:
            near = [(d(groups[a], groups[b]), a, b) for a, b in itertools.combinations(sorted(groups), 2) if any(j in links[i] for i in groups[a] for j in groups[b])]
            _, a, b = min(near)
            groups[a] += groups.pop(b)
        _, got = R.linkage(x, links, method, 4)
        assert {frozenset(np.flatnonzero(got == k).tolist()) for k in set(got.tolist())} == {frozenset(g) for g in groups.values()}


@pytest.fixture(scope="module")
def points(spark):
    r = random.Random(6)
    rows = [(i, float(r.randrange(30)), float(r.randrange(30))) for i in range(150)] + [(1000 + i, 3.0, 3.0) for i in range(12)]
    return rows, spark.createDataFrame(rows, "id long, x double, y double")


def test_nearest_against_brute_force(points):
    rows, df = points
    for k in (1, 5, 200):
        want = set()
        for i, x, y in rows:
            near = sorted(((x - a) ** 2 + (y - b) ** 2, j) for j, a, b in rows if j != i)[:k]
            want |= {(i, j) for _, j in near}
        assert {(r.i, r.j) for r in W.knn_weights(df, k).edges.collect()} == want
    d = {r.i: r.d for r in W.nearest(df, 1).collect()}
    assert abs(W.min_distthreshold(df).first()[0] - max(d.values())) < 1e-12


def test_distance_against_brute_force(points):
    rows, df = points
    want = {(i, j) for i, x, y in rows for j, a, b in rows if i != j and math.hypot(x - a, y - b) <= 4}
    assert {(r.i, r.j) for r in W.distance_weights(df, 4.0).edges.collect()} == want
    arc = {(i, j) for i, x, y in rows for j, a, b in rows if i != j and 2 * 6371 * math.asin(math.sqrt(math.sin(math.radians(b - y) / 2) ** 2 + math.cos(math.radians(y)) * math.cos(math.radians(b)) * math.sin(math.radians(a - x) / 2) ** 2)) <= 300}
    assert {(r.i, r.j) for r in W.distance_weights(df, 300.0, is_arc=True, is_mile=False).edges.collect()} == arc
    w = W.kernel_weights(df, 4.0, "uniform")
    assert {(r.i, r.j) for r in w.edges.collect()} == want and [r.diagonal for r in w.nodes.select("diagonal").distinct().collect()] == [1.0]
    assert [r.diagonal for r in W.kernel_weights(df, 4.0, "uniform", True).nodes.select("diagonal").distinct().collect()] == [0.5]
    # The published summaries: the counts of the distance band, and k neighbours of each.
    same = lambda a, b: W.weights_stats(a).first() == W.weights_stats(b).first()
    assert same(w, W.distance_weights(df, 4.0)) and same(W.kernel_knn_weights(df, 6, "uniform"), W.knn_weights(df, 6))
    for bad in (lambda: W.distance_weights(df, 0.0), lambda: W.knn_weights(df, 0), lambda: W.kernel_weights(df, 1.0, "x"), lambda: W.queen_weights(df, 0), lambda: W.queen_weights(df, 1, False, -1.0)):
        with pytest.raises(ValueError):
            bad()


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_distance_joins_pass_the_driver_by(points, tmp_path):
    """A small file makes many rows around cells; estimates of its size must not lead to a broadcast."""
    points[1].write.parquet(str(tmp_path / "p"))
    df = points[1].sparkSession.read.parquet(str(tmp_path / "p"))
    w = W.distance_weights(df, 4.0, 1.0, True)
    for x in (w.edges, W.get_neighbors_weights(w, 12), W.kernel_weights(df, 4.0, "gaussian").edges, W.distance_weights(df, 300.0, is_arc=True, is_mile=False).edges):
        assert "Broadcast" not in plan_of(x) and "SortMergeJoin" in plan_of(x)
    want = {i for i, a, b in points[0] if i != 12 and math.dist(points[0][12][1:], (a, b)) <= 4}
    assert {r.j for r in W.get_neighbors_weights(w, 12).collect()} == want


def test_weights_of_links_are_rounded_like_round(spark, tmp_path):
    """Links by the billion are rounded without printing each weight, to the very values of F.round, also at ties and where a product is unsafe."""
    from tessera.plans import queries as Q

    r = random.Random(2)
    odd = [0.0, -0.0, -1e-7, 0.0000005, -0.0000005, 1.0000015, 2.5e-6, 0.9999995, 999.9999985, 1e9, 123456789.1234565, 1e300, -1e300, 5e-324, math.inf, -math.inf, math.nan, None]
    values = odd + [k / 1e6 + 5e-7 for k in range(500)] + [math.nextafter(k / 1e6 + 5e-7, 1 - k % 2 * 2) for k in range(500)] + [r.uniform(-1, 1) * 10.0 ** r.randrange(-9, 12) for _ in range(3000)]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "i long, w double")
    rows = [dict((x.i, repr(x.w)) for x in f(df).collect()) for f in (Q.rounded, Q.rounded_links)]
    assert rows[0] == rows[1] and len(rows[1]) == len(values)
    spark.sql("select cast(id as bigint) p_partkey, 1.0D p_retailprice, 1 p_size from range(50)").write.parquet(str(tmp_path / "part.parquet"))
    for name in ("distance_weights_inverse", *(f"kernel_weights_{k}" for k in ("epanechnikov", "gaussian", "quartic", "triangular"))):
        assert "rint" in plan_of(Q.QUERIES[name](spark, str(tmp_path))).lower(), name


def test_triangular_kernel_passes_the_driver_by(spark, tmp_path):
    """The registered query on a small file, two parts to a place: plain exchanges, and all links with their weights."""
    from tessera.plans import queries as Q

    spark.sql("select id div 2 + id % 2 * 1009 * 1013 p_partkey, 1.0D p_retailprice, 1 p_size from range(600)").write.parquet(str(tmp_path / "part.parquet"))
    df = Q.QUERIES["kernel_weights_triangular"](spark, str(tmp_path))
    assert "Broadcast" not in plan_of(df) and "SortMergeJoin" in plan_of(df)
    at = {i: (i * 7919 % 1009, i * 104729 % 1013) for k in range(300) for i in (k, k + 1009 * 1013)}
    want = {(i, j): round(1 - d / 40, 6) for i, j in itertools.permutations(at, 2) if (d := math.dist(at[i], at[j])) <= 40}
    rows = df.collect()
    assert {(x.i, x.j): x.w for x in rows} == want and len(rows) == len(want) and want[0, 1009 * 1013] == 1.0


def test_nearest_joins_pass_the_driver_by(points, monkeypatch):
    plans = []
    monkeypatch.setattr(W, "kept", lambda df: (plans.append(plan_of(df)), iterate.kept(df))[1])
    near = W.knn_weights(points[1], 5)
    few = W.nearest(points[1], 5, only=points[1].where("id < 9").select("id"))
    assert near.edges.count() == 5 * points[1].count() and few.count() == 45
    plans.append(plan_of(W.asymmetric_links(near)))
    like = match.neighbor_match_test(points[1], ["x", "y"], 5, "raw")
    assert like.agg(F.min("cardinality")).first()[0] == 5
    assert not any("BroadcastHashJoin" in x for x in [*plans, plan_of(like)]) and any("SortMergeJoin" in x for x in plans)


def test_kernels_of_nearest_pass_the_driver_by(points, monkeypatch):
    """Only a single row, the largest distance, is broadcast."""
    rows, df = points
    plans = []
    monkeypatch.setattr(W, "kept", lambda df: (plans.append(plan_of(df)), iterate.kept(df))[1])
    near = {i: sorted(((x - a) ** 2 + (y - b) ** 2, j) for j, a, b in rows if j != i)[:6] for i, x, y in rows}
    largest = max(math.sqrt(n[-1][0]) for n in near.values())
    for adaptive in (True, False):
        w = W.kernel_knn_weights(df, 6, "triangular", adaptive).edges
        plans.append(plan_of(w))
        got = {(r.i, r.j): r.w for r in w.collect()}
        want = {(i, j): 1 - math.sqrt(s) / h if (h := math.sqrt(n[-1][0]) if adaptive else largest) else 1.0 for i, n in near.items() for s, j in n}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    assert not any("BroadcastHashJoin" in x for x in plans) and any("SortMergeJoin" in x for x in plans)


def test_voronoi_contiguity(spark):
    grid = [(y * 4 + x, float(x), float(y)) for y in range(4) for x in range(4)]
    e = lambda w: {(r.i, r.j) for r in w.edges.collect()}
    df = spark.createDataFrame(grid, "id long, x double, y double")
    assert e(W.rook_weights(df)) == {(i, j) for i, x, y in grid for j, a, b in grid if abs(x - a) + abs(y - b) == 1}
    assert e(W.queen_weights(df)) == {(i, j) for i, x, y in grid for j, a, b in grid if i != j and max(abs(x - a), abs(y - b)) == 1}
    r = random.Random(5)
    rows = [(i, r.random(), r.random() ** 3) for i in range(120)]
    got = e(W.queen_weights(spark.createDataFrame([*rows, (500, *rows[7][1:])], "id long, x double, y double")))
    pts = np.array([x[1:] for x in rows])
    box = [*(pts.min(0) - 0.1 * np.ptp(pts, 0).max()), *(pts.max(0) + 0.1 * np.ptp(pts, 0).max())]
    # Adjacent: some point of their bisector in the box is nearer to both than to all others.
    want = set()
    for i, j in itertools.combinations(range(120), 2):
        mid, n = (pts[i] + pts[j]) / 2, pts[j] - pts[i]
        way, lo, hi = np.array([-n[1], n[0]]), -1e9, 1e9
        for q in [k for k in range(120) if k not in (i, j)]:
            # |mid + t way - q| >= |mid + t way - pi|  is linear in t.
            c = 2 * (way @ (pts[i] - pts[q]))
            s = pts[i] @ pts[i] - pts[q] @ pts[q] - 2 * (mid @ (pts[i] - pts[q]))
            if c > 0:
                lo = max(lo, s / c)
            elif c < 0:
                hi = min(hi, s / c)
        for d in range(2):
            if way[d]:
                a, b = sorted(((box[d] - mid[d]) / way[d], (box[d + 2] - mid[d]) / way[d]))
                lo, hi = max(lo, a), min(hi, b)
        if lo < hi:
            want |= {(i, j), (j, i)}
    twin = {(500 if i == 7 else i, 500 if j == 7 else j) for i, j in want} | {(7, 500), (500, 7)}
    assert got == want | twin


def test_voronoi_searches_nearest_once(spark, monkeypatch):
    """Cells at the border, which very many points are near, are cut by their corners' points instead of ever more neighbours."""
    from tessera.operators import voronoi

    calls = []
    monkeypatch.setattr(voronoi, "nearest", lambda *a, **b: (calls.append(a), W.nearest(*a, **b))[1])
    grid = [(y * 7 + x, float(x), float(y)) for y in range(7) for x in range(7)]
    got = {(r.i, r.j) for r in voronoi.adjacent(spark.createDataFrame(grid, "id long, x double, y double"), False).collect()}
    assert got == {(i, j) for i, x, y in grid for j, a, b in grid if i != j and max(abs(x - a), abs(y - b)) == 1} and len(calls) == 1


def test_voronoi_cells_are_settled_by_tiles(spark, monkeypatch):
    """Few corners look for points in their discs, which at the border hold very many; tiles beside a crowd go another way to the same cells."""
    from tessera.operators import voronoi

    r = np.random.default_rng(3)
    pts = np.concatenate([r.random((400, 2)), 0.3 + r.random((200, 2)) / 500])
    w = np.ptp(pts, axis=0).max()
    box, eps, want = np.array([*(pts.min(0) - 0.1 * w), *(pts.max(0) + 0.1 * w)]), voronoi.TOUCH * w, set()
    for i, me in enumerate(pts):
        d = np.sqrt(((pts - me) ** 2).sum(1))
        near = np.argsort(d)[1:]
        poly, _ = voronoi.cell(me, pts[near], box)
        side = np.abs(((poly[:, None] - ((me + pts[near]) / 2)[None]) * (pts[near] - me)[None] / d[near, None]).sum(2)) <= eps
        want |= {(i, int(j)) for j in near[side.any(0)]}
    want |= {(j, i) for i, j in want}
    layer = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(pts)], "id long, x double, y double")
    discs, real = [], voronoi.kept
    monkeypatch.setattr(voronoi, "kept", lambda df: (out := real(df), "corner" in df.columns and discs.append(out.count()))[0])
    assert {(r.i, r.j) for r in voronoi.adjacent(layer, False).collect()} == want and sum(discs) < 100
    monkeypatch.setattr(voronoi, "TILE", 40, raising=False)
    monkeypatch.setattr(voronoi, "AROUND", 60, raising=False)
    assert {(r.i, r.j) for r in voronoi.adjacent(layer, False).collect()} == want and sum(discs) > 100


def test_precision_threshold(spark):
    square = lambda x, y: [[(x, y), (x + 1, y), (x + 1, y + 1), (x, y + 1), (x, y)]]
    rows = [(1, square(0.0, 0.0)), (2, square(1.004, 0.0)), (3, square(1.0, 1.0)), (4, square(9.0, 9.0))]
    df = spark.createDataFrame(rows, "id long, rings array<array<struct<x: double, y: double>>>")
    e = lambda w: {(r.i, r.j) for r in w.edges.collect() if r.i < r.j}
    assert e(W.queen_weights(df)) == {(1, 3)}
    assert e(W.queen_weights(df, precision_threshold=0.01)) == {(1, 2), (1, 3), (2, 3)}
    assert e(W.rook_weights(df, precision_threshold=0.01)) == {(1, 2), (2, 3)}
    assert W.has_isolates(W.queen_weights(df)).first()[0]


def test_nulls_and_isolates(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 5.0), (3, None), (4, 2.0), (5, 7.0)], "id long, v double")
    w = W.Weights(df.select("id"), spark.createDataFrame([(1, 2, 1.0), (2, 1, 1.0), (2, 3, 1.0), (3, 2, 1.0), (4, 3, 1.0)], "i long, j long, w double"))
    x = L.local_moran(w, df, "v")
    got = {r.id: r for r in x.values().collect()}
    assert got[3].quadrant == 5 and got[3].lisa is None and got[4].quadrant == got[5].quadrant == 6 and got[2].nn == 1
    p = {r.id: r.p for r in L.permuted(x, 99).collect()}
    assert p[3] is p[4] is p[5] is None and p[1] is not None
    assert {r.id: r.cluster for r in L.lisa_clusters(L.permuted(x, 99), L.MORAN).collect()}[3] == 5
    lag = {r.id: r.lag for r in W.spatial_lag(w, df, "v").collect()}
    assert lag == {1: 5.0, 2: 1.0, 3: 5.0, 4: None, 5: None}
    r = {x.id: x for x in rates.eb_rates(spark.createDataFrame([(1, 20, 100), (2, 0, 0), (3, 50, 100), (4, None, 3)], "id long, o int, p int"), "o", "p").collect()}
    assert r[2].is_null and r[2].eb_rate is None and r[4].is_null and 0.2 < r[1].eb_rate < r[3].eb_rate < 0.5


def test_draws_are_distinct_and_even():
    d = L.draws(np.arange(40, dtype=np.uint64), 500, 3, 6)
    assert (np.sort(d, 2)[:, :, 1:] != np.sort(d, 2)[:, :, :-1]).all() and d.min() == 0 and d.max() == 5
    share = np.bincount(d.ravel(), minlength=6) / d.size
    assert abs(share - 1 / 6).max() < 0.01


def test_scaling(spark):
    df = spark.createDataFrame([(1, 1.0, 4.0), (2, 3.0, 4.0), (3, None, 4.0)], "id long, a double, b double")
    got = {r.id: r for r in scale.scaled(df, ["a", "b"]).collect()}
    assert got[3].a is None and got[1].b == 0 and abs(got[2].a - math.sqrt(0.5)) < 1e-12
    assert [r.a for r in scale.scaled(df, ["a"], "mad").orderBy("id").collect()] == [-1, 1, None]


def test_neighbor_match(spark):
    r = random.Random(1)
    rows = [(i, r.random(), r.random(), r.random(), r.random()) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, x double, y double, a double, b double")
    a = np.array([x[3:] for x in rows])
    z = (a - a.mean(0)) / a.std(0, ddof=1)
    best = lambda v, i: set(np.argsort(((v - v[i]) ** 2).sum(1) + (np.arange(60) == i) * 1e9)[:5].tolist())
    s = np.array([x[1:3] for x in rows])
    for x in match.neighbor_match_test(df, ["a", "b"], 5).collect():
        v = len(best(z, x.id) & best(s, x.id))
        want = math.comb(5, v) * math.comb(54, 5 - v) / math.comb(59, 5)
        assert x.cardinality == v and (x.probability is None if not v else abs(x.probability - want) < 1e-9)


def test_components_by_star_steps(spark, monkeypatch):
    r = random.Random(3)
    e = [(r.randrange(300), r.randrange(300)) for _ in range(220)]
    nodes, edges = spark.range(300), spark.createDataFrame(e, "i long, j long")
    s = R.Sets(300)
    for i, j in e:
        s.join(i, j)
    want = {(i, s.root(i)) for i in range(300)}
    assert {tuple(x) for x in iterate.components(nodes, edges).collect()} == want
    monkeypatch.setattr(iterate, "SMALL", 0)
    assert {tuple(x) for x in iterate.components(nodes, edges).collect()} == want


def test_streaming_refresh(spark, guerry, tmp_path):
    from tessera.streaming.refresh import refreshed_moran

    df, w = guerry
    df.select("id", F.col("lit").alias("value"), F.lit("2024-01-01").cast("timestamp").alias("ts")).write.parquet(str(tmp_path / "in"))
    df.select("id", F.col("crm").alias("value"), F.lit("2024-01-02").cast("timestamp").alias("ts")).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long, value double, ts timestamp").parquet(str(tmp_path / "in"))
    out = {}
    q = refreshed_moran(stream, w, lambda x, n: out.update({n: column(x, "lisa", 1)[0]}), str(tmp_path / "check"))
    q.processAllAvailable()
    q.stop()
    assert abs(out[max(out)] - 0.516120231) < 1e-9


def test_diameter_by_bounds(spark, monkeypatch):
    monkeypatch.setattr(C, "SOURCES", 2)
    rows = [(i, i // 6) for i in range(18)]
    links = {(i, i + 1) for i in range(17) if (i + 1) % 6} | {(0, 3), (6, 11)}
    both = [(i, j, 1.0) for a, b in links for i, j in ((a, b), (b, a))]
    near = {}
    for i, j, _ in both:
        near.setdefault(i, []).append(j)

    def far(i):
        d, todo = {i: 0}, [i]
        for x in todo:
            for y in near[x]:
                if y not in d:
                    d[y] = d[x] + 1
                    todo.append(y)
        return max(d.values())

    w = W.Weights(spark.createDataFrame([(i,) for i, _ in rows], "id long"), spark.createDataFrame(both, "i long, j long, w double"))
    got = {x.cluster: x.steps for x in C.diameter(spark.createDataFrame(rows, "id long, cluster long"), w).collect()}
    assert got == {c: max(far(i) for i, k in rows if k == c) for c in range(3)}
