"""Local indicators of spatial association.

A statistic is joins and aggregates over the edges: `lisa`, `nn` and the cluster code of each
node. Inference adds `p`, a pseudo p-value by conditional permutation: the node keeps its
own value and its neighbours' values are replaced, `permutations` times, by values drawn
without replacement from all other nodes. With L permuted statistics at least as large as
the observed one, p = (min(L, P - L) + 1) / (P + 1).

Draws come from a hash of (seed, id, permutation, place), so they don't depend on
partitions, and nothing but the drawn-from values is sent to tasks: all values, of POOL nodes at most. Beyond, `pool` says
from how many to draw, chosen by hash (a uniform sample without replacement, from
which draws have the same law up to 1 / pool). The method "lookup" uses one set of draws
for all nodes, "complete" a set for each.

Nodes with a null value are undefined (code 5) and are nobody's neighbours; nodes
without a defined neighbour are isolated (code 6). Both have null p.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.breaks import order_statistics, counted
from ..functions.rates import eb_rates_standardization, is_binary
from ..plans.iterate import kept
from .weights import Weights

POOL = 1 << 20
PERMUTATIONS, CUTOFF, SEED = 999, 0.05, 123456789
#: Draws held at once in a task: nodes x permutations x neighbours.
AT_ONCE = 1 << 22

NOT, UNDEFINED, ISOLATED = "Not significant", "Undefined", "Isolated"
#: Codes and labels, in the order of the codes.
MORAN = [NOT, "High-High", "Low-Low", "Low-High", "High-Low", UNDEFINED, ISOLATED]
GEARY = [NOT, "High-High", "Low-Low", "Other Positive", "Negative", UNDEFINED, ISOLATED]
MULTI_GEARY = [NOT, "Positive", "Negative", UNDEFINED, ISOLATED]
GETIS = [NOT, "High-High", "Low-Low", UNDEFINED, ISOLATED]
JOIN = [NOT, "Significant", UNDEFINED, ISOLATED]
COLORS = {NOT: "#eeeeee", "High-High": "#FF0000", "Low-Low": "#0000FF", "Low-High": "#a7adf9", "High-Low": "#f4ada8", "Other Positive": "#f4ada8", "Negative": "#a7adf9", "Positive": "#336ea1", "Significant": "#348124", UNDEFINED: "#464646", ISOLATED: "#999999"}


@dataclass
class Lisa:
    """A statistic: table (id, lisa, nn, quadrant, own values, statistics for permutations) and how to run inference."""

    table: DataFrame
    labels: list[str]
    kind: str
    columns: list[str]
    options: dict = field(default_factory=dict)

    def values(self) -> DataFrame:
        """(id, lisa, nn, quadrant): quadrant is the code that a significant node has."""
        return self.table.select("id", "lisa", "nn", "quadrant")


def _defined(data: DataFrame, columns: list[str]) -> DataFrame:
    x = data.select("id", *(F.col(c).cast("double").alias(f"v{k}") for k, c in enumerate(columns)))
    names = [f"v{k}" for k in range(len(columns))]
    bad = F.lit(False)
    for n in names:
        bad = bad | F.col(n).isNull() | F.isnan(n)
    return x.withColumn("bad", bad)


def _standard(x: DataFrame, names: list[str]) -> DataFrame:
    """The names as z-scores by the sample standard deviation over defined rows; 0 where there is no spread."""
    good = lambda c: F.when(~F.col("bad"), F.col(c))
    t = x.agg(*(f(good(n)).alias(f"{k}_{n}") for n in names for k, f in (("m", F.avg), ("s", F.stddev_samp))))
    x = x.crossJoin(F.broadcast(t))  # one row
    return x.select("id", "bad", *(F.when(~F.col("bad"), F.coalesce(F.try_divide(F.col(n) - F.col(f"m_{n}"), F.col(f"s_{n}")), F.lit(0.0))).alias(n) for n in names))


def _around(w: Weights, x: DataFrame, names: list[str], links: list[Column] | None = None) -> DataFrame:
    """x with nn and, of the defined neighbours, the sums s_<name> of each name; links: further sums over the links, of columns i_<name> and j_<name>."""
    good = x.where(~F.col("bad")).select("id", *names)
    e = w.edges.where("i <> j").select("i", "j").join(good.select(F.col("id").alias("j"), *(F.col(n).alias(f"j_{n}") for n in names)), "j")
    if links:
        e = e.join(good.select(F.col("id").alias("i"), *(F.col(n).alias(f"i_{n}") for n in names)), "i")
    got = e.groupBy(F.col("i").alias("id")).agg(F.count(F.lit(1)).alias("nn"), *(F.sum(f"j_{n}").alias(f"s_{n}") for n in names), *(F.sum(c).alias(f"l{k}") for k, c in enumerate(links or [])))
    out = w.nodes.join(x, "id", "left").join(got, "id", "left")
    return out.withColumns({"bad": F.coalesce("bad", F.lit(True)), "nn": F.coalesce("nn", F.lit(0)).cast("bigint")})


def _finished(x: DataFrame, value: Column, quadrant: Column, labels: list[str], kind: str, columns: list[str], own: list[str], **options) -> Lisa:
    undefined, isolated = labels.index(UNDEFINED), labels.index(ISOLATED)
    lisa = F.when(F.col("bad"), None).when(F.col("nn") == 0, 0.0).otherwise(value).cast("double")
    code = F.when(F.col("bad"), undefined).when(F.col("nn") == 0, isolated).otherwise(quadrant)
    return Lisa(x.select("id", "bad", "nn", lisa.alias("lisa"), code.cast("int").alias("quadrant"), *own), labels, kind, columns, options)


def _moran_quadrant(z: Column, lag: Column) -> Column:
    return F.when((z >= 0) & (lag >= 0), 1).when((z < 0) & (lag < 0), 2).when((z < 0) & (lag >= 0), 3).otherwise(4)


def local_moran(w: Weights, data: DataFrame, column: str) -> Lisa:
    """z_i times the mean of the neighbours' z."""
    x = _around(w, _standard(_defined(data, [column]), ["v0"]), ["v0"])
    lag = F.try_divide("s_v0", "nn")
    return _finished(x, F.col("v0") * lag, _moran_quadrant(F.col("v0"), lag), MORAN, "moran", [column], ["v0"])


def local_bimoran(w: Weights, data: DataFrame, column1: str, column2: str) -> Lisa:
    """z1_i times the mean of the neighbours' z2; a row with either null is undefined."""
    x = _around(w, _standard(_defined(data, [column1, column2]), ["v0", "v1"]), ["v0", "v1"])
    lag = F.try_divide("s_v1", "nn")
    return _finished(x, F.col("v0") * lag, _moran_quadrant(F.col("v0"), lag), MORAN, "bimoran", [column1, column2], ["v0", "v1"])


def local_moran_eb(w: Weights, data: DataFrame, event: str, base: str) -> Lisa:
    """Local Moran of empirical Bayes standardized rates."""
    return local_moran(w, eb_rates_standardization(data, event, base), "z")


def local_geary(w: Weights, data: DataFrame, column: str) -> Lisa:
    """The mean squared difference of z to the neighbours'. A value below 1, the mean under independence, is positive association."""
    x = _standard(_defined(data, [column]), ["v0"])
    x = _around(w, x, ["v0"], [(F.col("i_v0") - F.col("j_v0")) * (F.col("i_v0") - F.col("j_v0"))])
    lag, z = F.try_divide("s_v0", "nn"), F.col("v0")
    positive = F.when((z > 0) & (lag > 0), 1).when((z < 0) & (lag < 0), 2).otherwise(3)
    return _finished(x, F.try_divide("l0", "nn"), F.when(F.try_divide("l0", "nn") <= 1, positive).otherwise(4), GEARY, "geary", [column], ["v0"])


def local_multigeary(w: Weights, data: DataFrame, columns: list[str]) -> Lisa:
    """The mean over the variables of their local Geary."""
    names = [f"v{k}" for k in range(len(columns))]
    x = _standard(_defined(data, columns), names)
    square = sum(((F.col(f"i_{n}") - F.col(f"j_{n}")) * (F.col(f"i_{n}") - F.col(f"j_{n}")) for n in names), F.lit(0.0))
    x = _around(w, x, names, [square])
    value = F.try_divide("l0", F.col("nn") * len(columns))
    return _finished(x, value, F.when(value <= 1, 1).otherwise(2), MULTI_GEARY, "geary", columns, names)


def _getis(w: Weights, data: DataFrame, column: str, star: bool) -> Lisa:
    x = _around(w, _defined(data, [column]), ["v0"])
    t = x.where(~F.col("bad")).agg(F.sum("v0").alias("total"), F.count(F.lit(1)).alias("n"))
    x = x.crossJoin(F.broadcast(t))  # one row
    v, s, nn = F.col("v0"), F.col("s_v0"), F.col("nn")
    value = F.try_divide((s + v) / (nn + 1), F.col("total")) if star else F.try_divide(F.try_divide(s, nn), F.col("total") - v)
    mean = F.try_divide(F.lit(1.0), F.col("n") if star else F.col("n") - 1)
    return _finished(x, value, F.when(value >= mean, 1).otherwise(2), GETIS, "gstar" if star else "g", [column], ["v0", "total"])


def local_g(w: Weights, data: DataFrame, column: str) -> Lisa:
    """The neighbours' mean over the sum of all others."""
    return _getis(w, data, column, False)


def local_gstar(w: Weights, data: DataFrame, column: str) -> Lisa:
    """The mean of the neighbours and the node itself over the sum of all."""
    return _getis(w, data, column, True)


def _binary(data: DataFrame, columns: list[str]) -> None:
    for c in columns:
        if not is_binary(data, c).first()[0]:
            raise ValueError(f"{c} must be 0 or 1")


def _joins(w: Weights, data: DataFrame, columns: list[str], first: Column, second: Column) -> Lisa:
    """first_i times the sum of the neighbours' second; both are columns of v0, v1 ..."""
    x = _defined(data, columns).select("id", "bad", first.alias("a"), second.alias("b"))
    x = _around(w, x, ["a", "b"])
    return _finished(x, F.col("a") * F.col("s_b"), F.lit(1), JOIN, "join", columns, ["a", "b"])


def local_joincount(w: Weights, data: DataFrame, column: str) -> Lisa:
    """For a 0/1 column: of a node with 1, how many neighbours have 1."""
    _binary(data, [column])
    return _joins(w, data, [column], F.col("v0"), F.col("v0"))


def local_bijoincount(w: Weights, data: DataFrame, column1: str, column2: str) -> Lisa:
    """For two 0/1 columns that never are 1 together nor 0 together: of a node with the first, how many neighbours have the second."""
    _binary(data, [column1, column2])
    n, s = data.agg(F.count(F.lit(1)), F.sum(F.col(column1) + F.col(column2))).first()
    if n != (s or 0):
        raise ValueError("the bivariate local join count is for two variables without colocation")
    return _joins(w, data, [column1, column2], F.col("v0"), F.col("v1"))


def local_multijoincount(w: Weights, data: DataFrame, columns: list[str]) -> Lisa:
    """For 0/1 columns: of a node with 1 in all, how many neighbours have 1 in all."""
    if len(columns) < 2:
        raise ValueError("two or more variables are needed")
    _binary(data, columns)
    if len(columns) == 2 and not data.where((F.col(columns[0]) == 1) & (F.col(columns[1]) == 1)).limit(1).count():
        raise ValueError("two variables without colocation: use local_bijoincount")
    both = F.lit(1.0)
    for k in range(len(columns)):
        both = both * F.col(f"v{k}")
    return _joins(w, data, columns, both, both)


def quantile_indicator(data: DataFrame, column: str, k: int, q: int) -> DataFrame:
    """(id, hit): whether the value is in the q-th of k quantiles (Hazen), above the lower cut (or the first class) and at most the upper."""
    if not 1 <= q <= k:
        raise ValueError("q must be from 1 to k")
    ends = [lambda t, i=i: t * (i / k) - 0.5 for i in (q - 1, q)]
    cuts = order_statistics(counted(data, column), ends)
    x = data.select("id", F.col(column).cast("double").alias("x")).crossJoin(F.broadcast(cuts))  # one row
    low = F.lit(True) if q == 1 else F.col("x") >= F.col("q0")
    high = F.lit(True) if q == k else F.col("x") < F.col("q1")
    return x.select("id", F.when(F.col("x").isNotNull(), (low & high).cast("int")).alias("hit"))


def local_quantilelisa(w: Weights, data: DataFrame, column: str, k: int, q: int) -> Lisa:
    """Local join count of the q-th of k quantiles."""
    return _joins(w, quantile_indicator(data, column, k, q), ["hit"], F.col("v0"), F.col("v0"))


def local_multiquantilelisa(w: Weights, data: DataFrame, columns: list[str], k: list[int], q: list[int]) -> Lisa:
    """Multivariate local join count of quantiles; of two without colocation, the bivariate one."""
    if not len(columns) == len(k) == len(q):
        raise ValueError("columns, k and q must have the same length")
    hits = None
    for n, (c, kk, qq) in enumerate(zip(columns, k, q, strict=True)):
        h = quantile_indicator(data, c, kk, qq).withColumnRenamed("hit", f"h{n}")
        hits = h if hits is None else hits.join(h, "id")
    names = [f"h{n}" for n in range(len(columns))]
    both = F.lit(1.0)
    for n in range(len(names)):
        both = both * F.col(f"v{n}")
    hits = kept(hits)
    if len(columns) == 2 and not hits.where("h0 = 1 and h1 = 1").limit(1).count():
        return _joins(w, hits, names, F.col("v0"), F.col("v1"))
    return _joins(w, hits, names, both, both)


# Inference.


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def draws(keys: np.ndarray, permutations: int, k: int, n: int) -> np.ndarray:
    """(keys, permutations, k): distinct numbers below n, by Floyd's method on hashed numbers."""
    out = np.empty((len(keys), permutations, k), np.int64)
    r = _mixed(_mixed(keys.astype(np.uint64))[:, None] + np.arange(permutations, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    for c in range(k):
        top = n - k + c
        u = _mixed(r + np.uint64((c + 1) * 0x632BE59BD9B4E019 % 2**64)) >> np.uint64(11)
        t = (u.astype(np.float64) * (2.0**-53) * (top + 1)).astype(np.int64)
        taken = (out[:, :, :c] == t[:, :, None]).any(2)
        out[:, :, c] = np.where(taken, top, t)
    return out


def permuted(l: Lisa, permutations: int = PERMUTATIONS, permutation_method: str = "complete", seed: int = SEED, pool: int | None = None) -> DataFrame:
    """(id, lisa, nn, quadrant, p)."""
    if not 1 <= permutations <= 999_999:
        raise ValueError("permutations must be from 1 to 999999")
    if permutation_method not in ("complete", "lookup"):
        raise ValueError("permutation_method must be complete or lookup")
    own = [c for c in l.table.columns if c not in ("id", "bad", "nn", "lisa", "quadrant", "total")]
    table = kept(l.table)
    good = table.where(~F.col("bad"))
    n = good.count()
    if (pool or n) > POOL:
        raise ValueError(f"{n} nodes; values of at most {POOL} are sent to tasks: say with pool from how many to draw")
    drawn = good.select("id", *own)
    if pool:
        drawn = drawn.orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(pool)
    rows = drawn.orderBy("id").toPandas()
    ids, values = rows["id"].to_numpy(), rows[own].to_numpy(float).T.copy()
    spark = table.sparkSession
    sent = spark.sparkContext.broadcast((ids, values))  # at most POOL rows
    kind, names = l.kind, own

    def statistic(mine: dict[str, np.ndarray], drawn: np.ndarray, v: np.ndarray) -> np.ndarray:
        k = drawn.shape[2]
        if kind == "moran":
            return mine["v0"][:, None] * (v[0][drawn].sum(2) / k)
        if kind == "bimoran":
            return mine["v0"][:, None] * (v[1][drawn].sum(2) / k)
        if kind == "geary":
            return sum(((v[m][drawn] - mine[c][:, None, None]) ** 2).sum(2) for m, c in enumerate(names)) / k / len(names)
        if kind == "g":
            return v[0][drawn].sum(2) / k / (mine["total"] - mine["v0"])[:, None]
        if kind == "gstar":
            return (v[0][drawn].sum(2) + mine["v0"][:, None]) / (k + 1) / mine["total"][:, None]
        return mine["a"][:, None] * v[names.index("b")][drawn].sum(2)

    def run(batches: Iterator) -> Iterator:
        ids, values = sent.value
        for pdf in batches:
            p = np.full(len(pdf), np.nan)
            nn = pdf["nn"].to_numpy()
            use = (~pdf["bad"].to_numpy()) & (nn > 0)
            if kind == "join":
                use &= pdf["lisa"].to_numpy() > 0
            key = pdf["id"].to_numpy()
            for k in np.unique(nn[use]):
                rows = np.flatnonzero(use & (nn == k))
                step = max(1, AT_ONCE // (permutations * int(k)))
                for a in range(0, len(rows), step):
                    r = rows[a : a + step]
                    at = np.searchsorted(ids, key[r])
                    inside = (at < len(ids)) & (ids[np.minimum(at, len(ids) - 1)] == key[r])
                    others = len(ids) - 1 if inside.all() else len(ids) - int(inside.any())
                    kk = min(int(k), others)
                    if kk < 1:
                        continue
                    base = key[r].astype(np.uint64) if permutation_method == "complete" else np.zeros(1, np.uint64)
                    d = draws(_mixed(base + np.uint64(seed % 2**64)), permutations, kk, others)
                    # Places from a node's own on stand one further, so that it never draws itself.
                    d = d + (inside[:, None, None] & (d >= at[:, None, None]))
                    mine = {c: pdf[c].to_numpy(float)[r] for c in pdf.columns if c not in ("id", "bad")}
                    got, seen = statistic(mine, d, values), mine["lisa"][:, None]
                    larger = (got >= seen - 1e-12 * np.abs(seen)).sum(1)
                    p[r] = (np.minimum(larger, permutations - larger) + 1) / (permutations + 1)
            out = pdf[["id", "lisa", "nn", "quadrant"]].copy()
            out["p"] = p
            yield out

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = table.repartition(parts, "id").mapInPandas(run, "id bigint, lisa double, nn bigint, quadrant int, p double")
    return found.withColumn("p", F.when(~F.isnan("p"), F.col("p")))


def exact_joins(l: Lisa) -> DataFrame:
    """(id, lisa, nn, quadrant, p) of a join count, with its exact conditional tail.

    Under permutation the count among k neighbours is hypergeometric: of n - 1 others, m have
    the second mark. p is the smaller of P(count >= observed) and P(count < observed), as the folded
    permutation rule estimates; null where the count is 0.
    """
    if l.kind != "join":
        raise ValueError("only join counts have an exact tail")
    good = l.table.where(~F.col("bad"))
    t = good.agg(F.count(F.lit(1)).alias("n"), F.sum("b").alias("marks"))
    x = l.table.crossJoin(F.broadcast(t))  # one row
    rest, m = F.col("n") - 1, (F.col("marks") - F.col("b")).cast("bigint")
    log_choose = lambda a, b: F.aggregate(F.sequence(F.lit(1), b), F.lit(0.0), lambda s, i: s + F.log((a - b + i).cast("double")) - F.log(i.cast("double")))
    choose = lambda a, b: F.when((b < 0) | (b > a), None).when(b == 0, 0.0).otherwise(log_choose(a, b))
    k = F.col("nn")
    mass = lambda v: F.coalesce(F.exp(choose(m, v) + choose(rest - m, k - v) - choose(rest, k)), F.lit(0.0))
    upper = F.aggregate(F.sequence(F.col("lisa").cast("bigint"), k), F.lit(0.0), lambda s, v: s + mass(v))
    p = F.when((F.col("lisa") > 0) & ~F.col("bad") & (k > 0), F.least(upper, F.greatest(1 - upper, F.lit(0.0))))
    return x.select("id", "lisa", "nn", "quadrant", p.alias("p"))


# Results.


def lisa_values(found: DataFrame) -> DataFrame:
    return found.select("id", "lisa")


def lisa_pvalues(found: DataFrame) -> DataFrame:
    return found.select("id", "p")


def lisa_num_nbrs(found: DataFrame) -> DataFrame:
    return found.select("id", "nn")


def lisa_clusters(found: DataFrame, labels: list[str], cutoff: float = CUTOFF) -> DataFrame:
    """(id, cluster): the node's code if p is at most cutoff, 0 if it is not significant; undefined and isolated nodes keep their codes."""
    fixed = [labels.index(UNDEFINED), labels.index(ISOLATED)]
    return found.select("id", F.when(F.col("quadrant").isin(fixed), F.col("quadrant")).when(F.col("p") <= cutoff, F.col("quadrant")).otherwise(0).alias("cluster"))


def _dictionary(found: DataFrame, rows: list[tuple]) -> DataFrame:
    return found.sparkSession.createDataFrame(rows, "cluster int, label string, color string")


def lisa_labels(found: DataFrame, labels: list[str]) -> DataFrame:
    """(cluster, label)."""
    return _dictionary(found, [(k, x, COLORS[x]) for k, x in enumerate(labels)]).select("cluster", "label")


def lisa_colors(found: DataFrame, labels: list[str]) -> DataFrame:
    """(cluster, color)."""
    return _dictionary(found, [(k, x, COLORS[x]) for k, x in enumerate(labels)]).select("cluster", "color")


def lisa_bo(found: DataFrame, alpha: float = CUTOFF) -> DataFrame:
    """One row: the Bonferroni bound alpha / n, n the number of defined p."""
    return found.agg(F.try_divide(F.lit(alpha), F.count("p")).alias("bo"))


def lisa_fdr(found: DataFrame, alpha: float = CUTOFF) -> DataFrame:
    """One row: the largest p_(i) with p_(i) <= alpha i / n, 0 if there is none; equal p share the last rank."""
    from ..functions.breaks import ranked

    r = ranked(found.where("p is not null").groupBy(F.col("p").alias("x")).agg(F.count(F.lit(1)).alias("n")))
    total = r.agg(F.max("upto").alias("total"))
    r = r.crossJoin(F.broadcast(total))  # one row
    return r.agg(F.coalesce(F.max(F.when(F.col("x") <= alpha * F.col("upto") / F.col("total"), F.col("x"))), F.lit(0.0)).alias("fdr"))
