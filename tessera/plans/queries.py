"""The registered queries: every operator over a layer of the driver's tables, and its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import breaks, rates, scale
from ..operators import clustering, lisa, match, weights as W
from ..operators.geometry import area, centroid, perimeter
from ..sources import shapefile, weights_io, wkb
from . import layers as L
from .iterate import new_path, put, stored

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            SQL[key] = sql
        return f

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*((F.round(c, digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def rounded_links(df: DataFrame, digits: int = 6) -> DataFrame:
    """As rounded(), for results of billions of rows: F.round prints and reads each value, here only those near a tie or large, whose product isn't safe."""
    scale = 10.0**digits

    def quick(c: str) -> Column:
        x = F.col(c) * scale
        sure = (F.abs(x - F.rint(x)) < 0.499) & (F.abs(x) < 1e9)
        return F.when(sure, F.rint(x) / scale).otherwise(F.round(c, digits)) + F.lit(0.0)

    return df.select(*(quick(c).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def r(x: str, digits: int = 6) -> str:
    return f"round({x}, {digits}) + 0.0"


# Layers with the edges that both engines can state.

QUEEN = "abs(a.x - b.x) <= 1 and abs(a.y - b.y) <= 1 and a.id <> b.id"
ROOK = "abs(a.x - b.x) + abs(a.y - b.y) = 1"


def edges(layer: str, on: str, name: str = "e") -> str:
    return f"{name} as (select a.id as i, b.id as j from {layer} a join {layer} b on {on})"


def sql_with(*parts: str, select: str) -> str:
    return "with " + ", ".join(parts) + " " + select


SUPPLIER_GRID = L.SQL["supplier_rates"] + ", supplier_grid as (select id, id % 10 as x, id // 10 as y, event, base from supplier_rates)"


def supplier_grid(spark: SparkSession, d: str) -> DataFrame:
    s = L.supplier_rates(spark, d)
    return s.withColumn("rings", L.square(F.col("id") % 10, F.floor(F.col("id") / 10)))


def customer_queen(spark: SparkSession, d: str) -> tuple[DataFrame, W.Weights]:
    layer = L.customer_grid(spark, d)
    return layer, W.queen_weights(layer)


def nation_queen(spark: SparkSession, d: str) -> tuple[DataFrame, W.Weights]:
    layer = L.nation_grid(spark, d)
    return layer, W.queen_weights(layer)


CUSTOMER = (L.SQL["customer_grid"], edges("customer_grid", QUEEN))
NATION = (L.SQL["nation_grid"], edges("nation_grid", QUEEN))

# Weights.


@query(sql_with(*CUSTOMER, select="select i, j, 1.0::double as w from e"))
def queen_weights(spark, d):
    return customer_queen(spark, d)[1].edges


@query(sql_with(L.SQL["customer_grid"], edges("customer_grid", ROOK), select="select i, j, 1.0::double as w from e"))
def rook_weights(spark, d):
    return W.rook_weights(L.customer_grid(spark, d)).edges


@query(sql_with(*NATION, select="select i, j, 1.0::double as w from e"))
def queen_precision(spark, d):
    return W.queen_weights(L.nation_grid(spark, d), precision_threshold=0.01).edges


_steps = "select distinct a.i, b.j from e a join e b on a.j = b.i where a.i <> b.j"
SQL["queen_order2"] = sql_with(*CUSTOMER, select=f"select i, j, 1.0::double as w from ({_steps} except select i, j from e)")
SQL["queen_order2_incl"] = sql_with(*CUSTOMER, select=f"select i, j, 1.0::double as w from ({_steps} union select i, j from e)")
SQL["rook_order2"] = sql_with(L.SQL["customer_grid"], edges("customer_grid", ROOK), select=f"select i, j, 1.0::double as w from ({_steps} except select i, j from e)")
QUERIES["queen_order2"] = lambda spark, d: W.queen_weights(L.customer_grid(spark, d), 2).edges
QUERIES["queen_order2_incl"] = lambda spark, d: W.queen_weights(L.customer_grid(spark, d), 2, True).edges
QUERIES["rook_order2"] = lambda spark, d: W.rook_weights(L.customer_grid(spark, d), 2).edges

NEAR = """near as (select a.id as i, b.id as j, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) as d, (a.x - b.x) ** 2 + (a.y - b.y) ** 2 as s
    from part_points a join part_points b on a.id <> b.id and abs(a.x - b.x) <= {0} and abs(a.y - b.y) <= {0})"""
ALL_NEAR = (L.SQL["part_points"], NEAR.format(120))
KNN = "knn as (select i, j, d, s from near qualify row_number() over (partition by i order by s, j) <= 6)"
BAND = 40.0


@query(sql_with(*ALL_NEAR, select=f"select {r('max(m)')} as threshold from (select min(d) as m from near group by i)"))
def min_distthreshold(spark, d):
    return rounded(W.min_distthreshold(L.part_points(spark, d)))


@query(sql_with(*ALL_NEAR, select=f"select i, j, 1.0::double as w from near where d <= {BAND}"))
def distance_weights(spark, d):
    return W.distance_weights(L.part_points(spark, d), BAND).edges


@query(sql_with(*ALL_NEAR, select=f"select i, j, {r('d ** -2.0')} as w from near where d <= {BAND}"))
def distance_weights_inverse(spark, d):
    return rounded_links(W.distance_weights(L.part_points(spark, d), BAND, 2.0, True).edges)


_globe = """g as (select id, cos(radians(y)) * cos(radians(x)) as x, cos(radians(y)) * sin(radians(x)) as y, sin(radians(y)) as z from part_globe),
    arc as (select a.id as i, b.id as j, 2 * 6371.0 * asin(least(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) / 2, 1.0)) as d, (a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2 as s from g a join g b on a.id <> b.id)"""


@query(sql_with(L.SQL["part_globe"], _globe, select="select i, j, 1.0::double as w from arc where d <= 700"))
def distance_weights_arc(spark, d):
    return W.distance_weights(L.part_globe(spark, d), 700.0, is_arc=True, is_mile=False).edges


@query(sql_with(*ALL_NEAR, KNN, select="select i, j, 1.0::double as w from knn"))
def knn_weights(spark, d):
    return W.knn_weights(L.part_points(spark, d), 6).edges


@query(sql_with(*ALL_NEAR, KNN, select=f"select i, j, {r('d ** -1.0')} as w from knn"))
def knn_weights_inverse(spark, d):
    return rounded(W.knn_weights(L.part_points(spark, d), 6, 1.0, True).edges)


@query(sql_with(L.SQL["part_globe"], _globe, select="select i, j, 1.0::double as w from arc qualify row_number() over (partition by i order by s, j) <= 4"))
def knn_weights_arc(spark, d):
    return W.knn_weights(L.part_globe(spark, d), 4, is_arc=True, is_mile=False).edges


QUERIES["voronoi_queen_points"] = lambda spark, d: W.queen_weights(L.part_points(spark, d)).edges
QUERIES["voronoi_queen"] = lambda spark, d: W.queen_weights(L.nation_grid(spark, d).select("id", "x", "y")).edges
SQL["voronoi_queen"] = sql_with(L.SQL["nation_grid"], edges("nation_grid", QUEEN), select="select i, j, 1.0::double as w from e")
QUERIES["voronoi_rook"] = lambda spark, d: W.rook_weights(L.nation_grid(spark, d).select("id", "x", "y")).edges
# Cells of points on a full grid are squares.
SQL["voronoi_rook"] = sql_with(L.SQL["nation_grid"], edges("nation_grid", ROOK), select="select i, j, 1.0::double as w from e")

_kernel = {"triangular": "1 - z", "uniform": "0.5::double", "epanechnikov": "0.75 * (1 - z * z)", "quartic": "15 / 16 * (1 - z * z) ** 2", "gaussian": "exp(-z * z / 2) / sqrt(2 * pi())"}
_own = {"triangular": "1.0::double", "uniform": "0.5::double", "epanechnikov": "0.75::double", "quartic": "0.9375::double", "gaussian": "1 / sqrt(2 * pi())"}
for _k, _f in _kernel.items():
    QUERIES[f"kernel_weights_{_k}"] = lambda spark, d, k=_k: rounded_links(W.kernel_weights(L.part_points(spark, d), BAND, k).edges)
    SQL[f"kernel_weights_{_k}"] = sql_with(*ALL_NEAR, select=f"select i, j, {r(_f)} as w from (select i, j, d / {BAND} as z from near where d <= {BAND})")
    QUERIES[f"kernel_knn_weights_{_k}"] = lambda spark, d, k=_k: rounded(W.kernel_knn_weights(L.part_points(spark, d), 6, k, use_kernel_diagonals=True).edges)
    SQL[f"kernel_knn_weights_{_k}"] = sql_with(*ALL_NEAR, KNN, select=f"select i, j, {r(_f)} as w from (select i, j, d / max(d) over (partition by i) as z from knn)")
QUERIES["kernel_knn_weights_fixed"] = lambda spark, d: rounded(W.kernel_knn_weights(L.part_points(spark, d), 6, "triangular", False).edges)
SQL["kernel_knn_weights_fixed"] = sql_with(*ALL_NEAR, KNN, select=f"select i, j, {r('1 - z')} as w from (select i, j, d / max(d) over () as z from knn)")


@query("select cast(n_nationkey + 1 as bigint) as id, cast(0 as bigint) as n from nation")
def create_weights(spark, d):
    return W.degrees(W.create_weights(spark, 25))


_set = sql_with(*NATION, select="select i, j, 1.0::double as w from e where i <> 7 union all select * from (values {}) as t(i, j, w)")


@query(_set.format("(7::bigint, 1::bigint, 1.0::double), (7, 24, 1.0)"))
def set_neighbors(spark, d):
    return W.update_weights(W.set_neighbors(nation_queen(spark, d)[1], 7, [1, 24])).edges


@query(_set.format("(7::bigint, 1::bigint, 0.25::double), (7, 24, 2.5)"))
def set_neighbors_with_weights(spark, d):
    return W.set_neighbors_with_weights(nation_queen(spark, d)[1], 7, [1, 24], [0.25, 2.5]).edges


DEGREE = "deg as (select id, (select count(*) from e where i = id) as n from {0}), st as (select count(*) as num_obs, sum(n) / (count(*) * count(*)::double) as sparsity, min(n) as min_neighbors, max(n) as max_neighbors, avg(n) as mean_neighbors, median(n) as median_neighbors, count(*) filter (n = 0) > 0 as has_isolates from deg)"
_stats = (*CUSTOMER, DEGREE.format("customer_grid"))


@query(sql_with(*_stats, select=f"select num_obs, {r('sparsity', 9)} as sparsity, min_neighbors, max_neighbors, {r('mean_neighbors')} as mean_neighbors, median_neighbors, has_isolates from st"))
def weights_stats(spark, d):
    s = W.weights_stats(customer_queen(spark, d)[1])
    return s.withColumn("sparsity", F.round("sparsity", 9) + F.lit(0.0)).withColumn("mean_neighbors", F.round("mean_neighbors", 6) + F.lit(0.0))


_names = ["number of observations:", "is symmetric:", "sparsity:", "# min neighbors:", "# max neighbors:", "# mean neighbors:", "# median neighbors:", "has isolates:"]
_texts = ["num_obs", "(select not exists (select 1 from e a where not exists (select 1 from e b where b.i = a.j and b.j = a.i)))", "sparsity", "min_neighbors", "max_neighbors", "mean_neighbors", "median_neighbors", "has_isolates"]


@query(sql_with(*_stats, select=" union all ".join(f"select {k} as position, '{n}' as name, ({t})::varchar as value from st" for k, (n, t) in enumerate(zip(_names, _texts, strict=True), 1))))
def weights_summary(spark, d):
    return W.weights_summary(customer_queen(spark, d)[1])


for _c in ("min_neighbors", "max_neighbors", "mean_neighbors", "median_neighbors", "weights_sparsity"):
    _col = _c.removeprefix("weights_")
    QUERIES[_c] = lambda spark, d, f=getattr(W, _c): rounded(f(nation_queen(spark, d)[1]))
    SQL[_c] = sql_with(*NATION, DEGREE.format("nation_grid"), select=f"select {_col if _col[:3] in ('min', 'max') else r(_col)} as {_col} from st")


@query(sql_with(*CUSTOMER, select="select not exists (select 1 from e a where not exists (select 1 from e b where b.i = a.j and b.j = a.i)) as is_symmetric"))
def is_symmetric(spark, d):
    return W.is_symmetric(customer_queen(spark, d)[1])


@query(sql_with(*ALL_NEAR, KNN, select="select count(*) as n from knn a where not exists (select 1 from knn b where b.i = a.j and b.j = a.i)"))
def asymmetric_links(spark, d):
    return W.asymmetric_links(W.knn_weights(L.part_points(spark, d), 6)).agg(F.count(F.lit(1)).alias("n"))


@query(sql_with(*_stats, select="select has_isolates from st"))
def has_isolates(spark, d):
    return W.has_isolates(customer_queen(spark, d)[1])


@query(sql_with(*NATION, select="select j from e where i = 12"))
def get_neighbors(spark, d):
    return W.get_neighbors(nation_queen(spark, d)[1], 12)


@query(sql_with(*ALL_NEAR, select=f"select j, {r('d ** -1.0')} as w from near where d <= {BAND} and i = 12"))
def get_neighbors_weights(spark, d):
    return rounded(W.get_neighbors_weights(W.distance_weights(L.part_points(spark, d), BAND, 1.0, True), 12))


@query(sql_with(*CUSTOMER, select=f"select c.id, {r('avg(b.value)')} as lag from customer_grid c left join e on e.i = c.id left join customer_grid b on b.id = e.j group by 1"))
def spatial_lag(spark, d):
    layer, w = customer_queen(spark, d)
    return rounded(W.spatial_lag(w, layer, "value"))


@query(sql_with(*NATION, select="select id, " + ", ".join(f"(select count(*) from e where i = id and j = {k})::double as \"{k}\"" for k in range(25)) + " from nation_grid"))
def as_matrix(spark, d):
    return W.as_matrix(nation_queen(spark, d)[1])


# Local statistics.

_z = "z as (select *, coalesce((value - avg(value) over ()) / nullif(stddev_samp(value) over (), 0), 0) as z1, coalesce((other - avg(other) over ()) / nullif(stddev_samp(other) over (), 0), 0) as z2 from {0})"
_moran = "case when {0} >= 0 and {1} >= 0 then 1 when {0} < 0 and {1} < 0 then 2 when {0} < 0 and {1} >= 0 then 3 else 4 end"
_lag = "l as (select a.id, a.value, any_value(a.z1) as z1, any_value(a.z2) as z2, count(*) as nn, avg(b.z1) as l1, avg(b.z2) as l2, avg((a.z1 - b.z1) ** 2) as g1, avg((a.z2 - b.z2) ** 2) as g2, sum(b.value) as sv from z a join e on e.i = a.id join z b on b.id = e.j group by 1, 2)"
LISA = (*CUSTOMER, _z.format("customer_grid"), _lag)


def _lisa(value: str, code: str, parts: tuple = LISA, of: str = "l", digits: int = 6) -> str:
    return sql_with(*parts, select=f"select id, {r(value, digits)} as lisa, nn, ({code})::int as quadrant from {of}")


@query(_lisa("z1 * l1", _moran.format("z1", "l1")))
def local_moran(spark, d):
    layer, w = customer_queen(spark, d)
    return rounded(lisa.local_moran(w, layer, "value").values())


@query(_lisa("z1 * l2", _moran.format("z1", "l2")))
def local_bimoran(spark, d):
    layer, w = customer_queen(spark, d)
    return rounded(lisa.local_bimoran(w, layer, "value", "other").values())


@query(_lisa("g1", "case when g1 > 1 then 4 when z1 > 0 and l1 > 0 then 1 when z1 < 0 and l1 < 0 then 2 else 3 end"))
def local_geary(spark, d):
    layer, w = customer_queen(spark, d)
    return rounded(lisa.local_geary(w, layer, "value").values())


@query(_lisa("(g1 + g2) / 2", "case when (g1 + g2) / 2 <= 1 then 1 else 2 end"))
def local_multigeary(spark, d):
    layer, w = customer_queen(spark, d)
    return rounded(lisa.local_multigeary(w, layer, ["value", "other"]).values())


_total = "t as (select sum(value) as total, count(*) as n from customer_grid)"


@query(_lisa("sv / nn / (total - value)", "case when sv / nn / (total - value) >= 1.0 / (n - 1) then 1 else 2 end", (*LISA, _total), "l, t", 9))
def local_g(spark, d):
    layer, w = customer_queen(spark, d)
    return rounded(lisa.local_g(w, layer, "value").values(), 9)


@query(_lisa("(sv + value) / (nn + 1) / total", "case when (sv + value) / (nn + 1) / total >= 1.0 / n then 1 else 2 end", (*LISA, _total), "l, t", 9))
def local_gstar(spark, d):
    layer, w = customer_queen(spark, d)
    return rounded(lisa.local_gstar(w, layer, "value").values(), 9)


def _join(first: str, second: str, layer: str = "customer_grid", more: tuple = CUSTOMER) -> tuple[str, ...]:
    return (*more, f"jc as (select a.id, any_value({first}) as a, any_value({second.replace('b.', 'a.')}) as m, count(*) as nn, sum({second}) as s from {layer} a join e on e.i = a.id join {layer} b on b.id = e.j group by 1)")


_count = "select id, (a * s)::double as lisa, nn, 1 as quadrant from jc"
HOT = _join("a.hot", "b.hot")


@query(sql_with(*HOT, select=_count))
def local_joincount(spark, d):
    layer, w = customer_queen(spark, d)
    return lisa.local_joincount(w, layer, "hot").values()


@query(sql_with(*_join("a.hot", "1 - b.hot"), select=_count))
def local_bijoincount(spark, d):
    layer, w = customer_queen(spark, d)
    return lisa.local_bijoincount(w, layer.withColumn("cold", 1 - F.col("hot")), "hot", "cold").values()


@query(sql_with(*_join("a.hot * a.mid", "b.hot * b.mid"), select=_count))
def local_multijoincount(spark, d):
    layer, w = customer_queen(spark, d)
    return lisa.local_multijoincount(w, layer, ["hot", "mid"]).values()


def hazen(share: str, column: str = "value", layer: str = "customer_grid") -> str:
    """A quantile at position p n - 1/2, linear between neighbours, as a scalar subquery."""
    at = f"greatest(0, least(n * {share} - 0.5, n - 1))"
    return f"""(select any_value(v[floor({at})::bigint + 1] + (v[least(floor({at})::bigint + 2, n)] - v[floor({at})::bigint + 1]) * ({at} - floor({at})))
        from (select list({column} order by {column}) as v, count(*) as n from {layer}))"""


_qgrid = (L.SQL["customer_grid"], f"cut as (select {hazen('0.25')} as c1, {hazen('0.75')} as c3, {hazen('0.5', 'other')} as o2)", "q as (select id, x, y, (value < c1)::int as q1, (value >= c3)::int as q4, (other >= o2)::int as o from customer_grid, cut)", edges("q", QUEEN))


@query(sql_with(*_join("a.q1", "b.q1", "q", _qgrid), select=_count))
def local_quantilelisa(spark, d):
    layer, w = customer_queen(spark, d)
    return lisa.local_quantilelisa(w, layer, "value", 4, 1).values()


@query(sql_with(*_join("a.q4 * a.o", "b.q4 * b.o", "q", _qgrid), select=_count))
def local_multiquantilelisa(spark, d):
    layer, w = customer_queen(spark, d)
    return lisa.local_multiquantilelisa(w, layer, ["value", "other"], [4, 2], [4, 2]).values()


_eb = "rt as (select *, event / base::double as rate from {0}), tt as (select sum(event) / sum(base)::double as b, sum(base * (rate - sb) ** 2) / sum(base) - sb / (sum(base) / count(*)) as a from rt, (select sum(event) / sum(base)::double as sb from {0}) group by sb)"
_ebz = _eb + ", zz as (select {1} id, (rate - b) / sqrt(case when a + b / base > 0 then a + b / base else b / base end) as zr from rt, tt)"


@query(sql_with(SUPPLIER_GRID, _eb.format("supplier_grid"), select=f"select id, {r('w * rate + (1 - w) * b')} as eb_rate, false as is_null from (select *, greatest(a, 0) / (greatest(a, 0) + b / base) as w from rt, tt)"))
def eb_rates(spark, d):
    return rounded(rates.eb_rates(L.supplier_rates(spark, d), "event", "base"))


@query(sql_with(SUPPLIER_GRID, _ebz.format("supplier_grid", ""), select=f"select id, {r('zr')} as z from zz"))
def eb_rates_standardization(spark, d):
    return rounded(rates.eb_rates_standardization(L.supplier_rates(spark, d), "event", "base"))


@query(_lisa("z1 * l1", _moran.format("z1", "l1"), (SUPPLIER_GRID, edges("supplier_grid", QUEEN), _ebz.format("supplier_grid", ""), "m as (select id, zr as value, zr as other from zz)", _z.format("m"), _lag)))
def local_moran_eb(spark, d):
    layer = supplier_grid(spark, d)
    return rounded(lisa.local_moran_eb(W.queen_weights(layer), layer, "event", "base").values())


_match = """zs as (select *, (value - avg(value) over ()) / stddev_samp(value) over () as z1, (other - avg(other) over ()) / stddev_samp(other) over () as z2 from part_points),
    att as (select a.id as i, b.id as j from zs a join zs b on a.id <> b.id qualify row_number() over (partition by a.id order by (a.z1 - b.z1) ** 2 + (a.z2 - b.z2) ** 2, b.id) <= 6),
    mt as (select p.id, (select count(*) from knn join att using (i, j) where i = p.id) as v, (select count(*) from part_points) as n from part_points p)"""
_choose = "lgamma({0} + 1) - lgamma({1} + 1) - lgamma({0} - ({1}) + 1)"


@query(sql_with(*ALL_NEAR, KNN, _match, select=f"select id, v as cardinality, case when v > 0 then {r('exp(' + _choose.format('6', 'v') + ' + ' + _choose.format('(n - 7)', '(6 - v)') + ' - (' + _choose.format('(n - 1)', '6') + '))')} end as probability from mt"))
def neighbor_match_test(spark, d):
    return rounded(match.neighbor_match_test(L.part_points(spark, d), ["value", "other"], 6))


# Inference. Join counts have an exact tail; other statistics are permuted by a generator that SQL doesn't have.

_tail = "pv as (select *, case when a * s > 0 then least(up, greatest(1 - up, 0)) end as p from (select id, a, s, nn, (select sum(exp({0} + {1} - ({2}))) from range(s::bigint, (least(nn, t.m - jc.m) + 1)::bigint) as v(v) where nn - v <= rest - (t.m - jc.m)) as up from jc, (select count(*) - 1 as rest, sum(m)::bigint as m from jc) t))".format(
    _choose.format("(t.m - jc.m)", "v"), _choose.format("(rest - (t.m - jc.m))", "(nn - v)"), _choose.format("rest", "nn")
)
EXACT = (*HOT, _tail)


def _exact(spark: SparkSession, d: str) -> DataFrame:
    layer, w = customer_queen(spark, d)
    return lisa.exact_joins(lisa.local_joincount(w, layer, "hot"))


@query(sql_with(*EXACT, select=f"select id, {r('p')} as p from pv"))
def lisa_pvalues(spark, d):
    return rounded(lisa.lisa_pvalues(_exact(spark, d)))


@query(sql_with(*EXACT, select="select id, (a * s)::double as lisa from pv"))
def lisa_values(spark, d):
    return lisa.lisa_values(_exact(spark, d))


@query(sql_with(*EXACT, select="select id, nn from pv"))
def lisa_num_nbrs(spark, d):
    return lisa.lisa_num_nbrs(_exact(spark, d))


@query(sql_with(*EXACT, select="select id, case when p <= 0.05 then 1 else 0 end as cluster from pv"))
def lisa_clusters(spark, d):
    return lisa.lisa_clusters(_exact(spark, d), lisa.JOIN)


@query(sql_with(*EXACT, select="select 0.05 / count(p) as bo from pv"))
def lisa_bo(spark, d):
    return lisa.lisa_bo(_exact(spark, d))


@query(sql_with(*EXACT, select=f"select coalesce({r('max(p)')}, 0) as fdr from (select p, count(*) over (order by round(p, 12)) as k, count(*) over () as n from pv where p is not null) where p <= 0.05 * k / n"))
def lisa_fdr(spark, d):
    x = _exact(spark, d)
    return rounded(lisa.lisa_fdr(x.withColumn("p", F.round("p", 12))))


@query("select * from (values (0, 'Not significant'), (1, 'High-High'), (2, 'Low-Low'), (3, 'Low-High'), (4, 'High-Low'), (5, 'Undefined'), (6, 'Isolated')) as t(cluster, label)")
def lisa_labels(spark, d):
    return lisa.lisa_labels(spark.range(0), lisa.MORAN)


@query("select * from (values (0, '#eeeeee'), (1, '#FF0000'), (2, '#0000FF'), (3, '#a7adf9'), (4, '#f4ada8'), (5, '#464646'), (6, '#999999')) as t(cluster, color)")
def lisa_colors(spark, d):
    return lisa.lisa_colors(spark.range(0), lisa.MORAN)


_PERMUTED = {
    "local_moran": lambda w, x: lisa.local_moran(w, x, "value"), "local_bimoran": lambda w, x: lisa.local_bimoran(w, x, "value", "other"), "local_geary": lambda w, x: lisa.local_geary(w, x, "value"),
    "local_multigeary": lambda w, x: lisa.local_multigeary(w, x, ["value", "other"]), "local_g": lambda w, x: lisa.local_g(w, x, "value"), "local_gstar": lambda w, x: lisa.local_gstar(w, x, "value"), "local_joincount": lambda w, x: lisa.local_joincount(w, x, "hot"),
}
_PERMUTED |= {
    "local_bijoincount": lambda w, x: lisa.local_bijoincount(w, x.withColumn("cold", 1 - F.col("hot")), "hot", "cold"), "local_multijoincount": lambda w, x: lisa.local_multijoincount(w, x, ["hot", "mid"]),
    "local_quantilelisa": lambda w, x: lisa.local_quantilelisa(w, x, "value", 4, 1), "local_multiquantilelisa": lambda w, x: lisa.local_multiquantilelisa(w, x, ["value", "other"], [4, 4], [1, 1]),
}
for _k, _l in _PERMUTED.items():
    QUERIES[f"{_k}_permuted"] = lambda spark, d, f=_l: lisa.permuted(f(*reversed(customer_queen(spark, d))))
QUERIES["local_moran_lookup"] = lambda spark, d: lisa.permuted(_PERMUTED["local_moran"](*reversed(customer_queen(spark, d))), permutation_method="lookup")


@query()
def local_moran_clusters(spark, d):
    layer, w = customer_queen(spark, d)
    return lisa.lisa_clusters(lisa.permuted(lisa.local_moran(w, layer, "value")), lisa.MORAN)


# Breaks.


def _rows(*values: str) -> str:
    return sql_with(L.SQL["customer_grid"], select=" union all ".join(f"select {k} as position, {r(v, 4)} as value" for k, v in enumerate(values, 1)))


def _customers(spark: SparkSession, d: str) -> DataFrame:
    return L.customer_grid(spark, d)


SQL["quantile_breaks"] = _rows(*(hazen(f"({k} / 5)") for k in range(1, 5)))
QUERIES["quantile_breaks"] = lambda spark, d: rounded(breaks.quantile_breaks(_customers(spark, d), "value", 5), 4)
SQL["percentile_breaks"] = _rows(*(hazen(p) for p in ("0.01", "0.1", "0.5", "0.9", "0.99")))
QUERIES["percentile_breaks"] = lambda spark, d: rounded(breaks.percentile_breaks(_customers(spark, d), "value"), 4)
_q = "(select quantile_cont(value, {}) from customer_grid)"
for _n, _h in (("hinge15_breaks", 1.5), ("hinge30_breaks", 3.0)):
    _a, _b, _c = (_q.format(p) for p in (0.25, 0.5, 0.75))
    SQL[_n] = _rows(f"({_a} - {_h} * ({_c} - {_a}))", _a, _b, _c, f"({_c} + {_h} * ({_c} - {_a}))")
    QUERIES[_n] = lambda spark, d, f=getattr(breaks, _n): rounded(f(_customers(spark, d), "value"), 4)
SQL["stddev_breaks"] = _rows(*(f"(select avg(value) + {k} * stddev_samp(value) from customer_grid)" for k in (-2, -1, 0, 1, 2)))
QUERIES["stddev_breaks"] = lambda spark, d: rounded(breaks.stddev_breaks(_customers(spark, d), "value"), 4)
QUERIES["natural_breaks"] = lambda spark, d: breaks.natural_breaks(_customers(spark, d), "value", 5)
# Three cuts of the 25 nations' values can be tried one by one.
QUERIES["natural_breaks_small"] = lambda spark, d: breaks.natural_breaks(L.nation_grid(spark, d), "value", 3)
SQL["natural_breaks_small"] = sql_with(
    L.SQL["nation_grid"], "v as (select distinct value from nation_grid)", "c as (select a.value as a, b.value as b from v a join v b on a.value < b.value where b.value < (select max(value) from v))",
    "s as (select a, b, sum(q) as q from (select a, b, case when value <= a then 1 when value <= b then 2 else 3 end as k, var_pop(value) * count(*) as q from c, nation_grid group by all) group by a, b order by q limit 1)",
    select="select 1 as position, a as value from s union all select 2, b from s",
)
QUERIES["is_binary"] = lambda spark, d: rates.is_binary(_customers(spark, d), "hot")
SQL["is_binary"] = sql_with(L.SQL["customer_grid"], select="select bool_and(hot in (0, 1)) as is_binary from customer_grid")

# Scaling.

_over = {"raw": "value", "standardize": "(value - avg(value) over ()) / stddev_samp(value) over ()", "demean": "value - avg(value) over ()", "range_standardize": "(value - min(value) over ()) / (max(value) over () - min(value) over ())", "range_adjust": "value / (max(value) over () - min(value) over ())", "mad": "(value - m) / avg(abs(value - m)) over ()"}
for _k, _f in _over.items():
    QUERIES[f"scale_{_k}"] = lambda spark, d, k=_k: rounded(scale.scaled(_customers(spark, d), ["value"], k))
    SQL[f"scale_{_k}"] = sql_with(L.SQL["customer_grid"], select=f"select id, {r(_f)} as value from (select id, value, avg(value) over () as m from customer_grid)")

# Clustering.


def _segments(layer: DataFrame) -> DataFrame:
    return layer.select("id", F.col("segment").alias("cluster"))


_jc = "jr as (select a.segment as cluster, count(*) as neighbors, count(*) filter (a.segment = b.segment) as join_count from customer_grid a join e on e.i = a.id join customer_grid b on b.id = e.j group by 1), sz as (select segment as cluster, count(*) as n from customer_grid group by 1), al as (select * from sz join jr using (cluster) union all select null, (select sum(n) from sz), sum(neighbors), sum(join_count) from jr)"


@query(sql_with(*CUSTOMER, _jc, select=f"select cluster, n::bigint as n, neighbors::bigint as neighbors, join_count::bigint as join_count, {r('join_count / neighbors::double')} as ratio from al"))
def join_count_ratio(spark, d):
    layer, w = customer_queen(spark, d)
    return rounded(clustering.join_count_ratio(_segments(layer), w))


@query(sql_with(L.SQL["customer_grid"], "s as (select count(*)::double / sum(count(*)) over () as p from customer_grid group by segment)", select=f"select count(*) as n, {r('-sum(p * ln(p))')} as entropy, {r('-sum(p * ln(p)) / ln(count(*))')} as entropy_star, {r('sum(p * p)')} as simpson, {r('sum(p * p) * count(*)')} as simpson_star from s"))
def fragmentation(spark, d):
    return rounded(clustering.fragmentation(_segments(_customers(spark, d))))


def _regions(layer: DataFrame) -> DataFrame:
    return layer.select("id", F.col("region").alias("cluster"))


_parts = """recursive same as (select e.i, e.j, a.region from e join nation_grid a on a.id = e.i join nation_grid b on b.id = e.j and b.region = a.region),
    walk as (select id, id as spot, region from nation_grid union select w.id, s.j, w.region from walk w join same s on s.i = w.spot),
    piece as (select id, region as cluster, min(spot) as piece from walk group by 1, 2)"""


def _recursive(*parts: str, select: str) -> str:
    return "with recursive " + ", ".join(p.removeprefix("recursive ") for p in parts) + " " + select


@query(_recursive(*NATION, _parts, select="select * from piece"))
def cluster_pieces(spark, d):
    layer, w = nation_queen(spark, d)
    return clustering.pieces(_regions(layer), w)


@query(_recursive(*NATION, _parts, select="select bool_and(k = 1) as spatially_constrained from (select count(distinct piece) as k from piece group by cluster)"))
def spatially_constrained(spark, d):
    layer, w = nation_queen(spark, d)
    return clustering.is_spatially_constrained(_regions(layer), w)


@query(_recursive(*NATION, _parts, "s as (select cluster, count(*)::double as c, count(*)::double / sum(count(*)) over (partition by cluster) as p from piece group by cluster, piece)",
    select=f"select cluster, count(*) as n, {r('-sum(p * ln(p))')} as entropy, {r('coalesce(-sum(p * ln(p)) / nullif(ln(count(*)), 0), 0)')} as entropy_star, {r('sum(p * p)')} as simpson, {r('sum(p * p) * count(*)')} as simpson_star, min(c) as min, max(c) as max, {r('avg(c)')} as mean from s group by cluster"))
def subcluster_fragmentation(spark, d):
    layer, w = nation_queen(spark, d)
    return rounded(clustering.subcluster_fragmentation(_regions(layer), w))


def _bands(layer: DataFrame) -> DataFrame:
    """Rows of squares, two and two: clusters that are contiguous."""
    return layer.select("id", F.floor(F.col("y") / 2).alias("cluster"))


@query(sql_with(L.SQL["nation_grid"], select=f"select y // 2 as cluster, count(*)::double as area, 4 * count(*)::double as perimeter, {r('4 * pi() * count(*) / (4 * count(*)) ** 2')} as ipc from nation_grid group by 1"))
def compactness(spark, d):
    layer = L.nation_grid(spark, d)
    return rounded(clustering.compactness(layer, _bands(layer)))


_steps_of = """hop as (select a.id as s, a.id as t, 0 as k, a.y // 2 as cluster from nation_grid a
        union select h.s, b.id, h.k + 1, h.cluster from hop h join e on e.i = h.t join nation_grid b on b.id = e.j and b.y // 2 = h.cluster where h.k < 12)"""


@query(_recursive(*NATION, _steps_of, select=f"select cluster, max(k)::int as steps, {r('max(k)::double / count(distinct s)')} as ratio from (select cluster, s, t, min(k) as k from hop group by all) group by 1"))
def cluster_diameter(spark, d):
    layer, w = nation_queen(spark, d)
    return rounded(clustering.diameter(_bands(layer), w))


@query(sql_with(L.SQL["customer_grid"], "z as (select segment, (value - avg(value) over ()) / stddev_samp(value) over () as value, (other - avg(other) over ()) / stddev_samp(other) over () as other from customer_grid)", "u as (unpivot z on value, other into name variable value v)",
    select=f"select variable, {r('any_value(t)', 4)} as total_ss, {r('sum(w)', 4)} as within_ss from (select variable, segment, var_pop(v) * count(*) as w from u group by 1, 2) join (select variable, var_pop(v) * count(*) as t from u group by 1) using (variable) group by 1"))
def sums_of_squares(spark, d):
    layer = _customers(spark, d)
    return rounded(clustering.sums_of_squares(_segments(layer), layer, ["value", "other"]), 4)


@query(sql_with(L.SQL["customer_grid"], "z as (select segment, (value - avg(value) over ()) / stddev_samp(value) over () as v from customer_grid)", "p as (select (select var_pop(v) * count(*) from z) as t, (select sum(w) from (select var_pop(v) * count(*) as w from z group by segment)) as w)",
    select=f"select {r('t', 4)} as total_ss, {r('w', 4)} as within_ss, {r('t - w', 4)} as between_ss, {r('(t - w) / t', 4)} as ratio from p"))
def clustering_stats(spark, d):
    layer = _customers(spark, d)
    return rounded(clustering.clustering_stats(_segments(layer), layer, ["value"]), 4)


VARIABLES = ["value", "other"]


def _nations(f: Callable) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        layer, w = nation_queen(spark, d)
        return f(layer, w)

    return run


QUERIES["skater"] = _nations(lambda x, w: clustering.skater(4, w, x, VARIABLES))
QUERIES["skater_customers"] = lambda spark, d: clustering.skater(8, customer_queen(spark, d)[1], _customers(spark, d), VARIABLES)
for _m in clustering.REDCAP:
    QUERIES[f"redcap_{_m.replace('-', '_')}"] = _nations(lambda x, w, m=_m: clustering.redcap(4, w, x, VARIABLES, m))
for _m in clustering.SCHC:
    QUERIES[f"schc_{_m}"] = _nations(lambda x, w, m=_m: clustering.schc(4, w, x, VARIABLES, m))
QUERIES["azp_greedy"] = _nations(lambda x, w: clustering.azp_greedy(4, w, x, VARIABLES))
QUERIES["azp_sa"] = _nations(lambda x, w: clustering.azp_sa(4, w, x, VARIABLES))
QUERIES["azp_tabu"] = _nations(lambda x, w: clustering.azp_tabu(4, w, x, VARIABLES))


def _bounded(f: Callable) -> Query:
    return _nations(lambda x, w: f(w, x.withColumn("one", F.lit(1.0)), VARIABLES, "one", 4.0, iterations=20))


QUERIES["maxp_greedy"] = _bounded(clustering.maxp_greedy)
QUERIES["maxp_sa"] = _bounded(clustering.maxp_sa)
QUERIES["maxp_tabu"] = _bounded(clustering.maxp_tabu)
QUERIES["make_spatial"] = _nations(lambda x, w: clustering.make_spatial(_regions(x), w))
QUERIES["minimum_spanning_tree"] = lambda spark, d: clustering.minimum_spanning_tree(clustering._distances(customer_queen(spark, d)[1], _customers(spark, d).select("id", "value"), ["value"], "euclidean"))


def _tree_links(spark: SparkSession, d: str) -> DataFrame:
    layer, w = nation_queen(spark, d)
    return clustering._distances(w, layer.select("id", "value"), ["value"], "euclidean")


# A link is in the tree if its ends aren't connected by smaller links.
QUERIES["minimum_spanning_tree_small"] = lambda spark, d: clustering.minimum_spanning_tree(_tree_links(spark, d))
SQL["minimum_spanning_tree_small"] = _recursive(
    *NATION, "und as (select e.i, e.j, abs(a.value - b.value) as d from e join nation_grid a on a.id = e.i join nation_grid b on b.id = e.j where e.i < e.j)",
    "walk as (select i as ei, j as ej, d, i as node from und union select w.ei, w.ej, w.d, case when v.i = w.node then v.j else v.i end from walk w join und v on w.node in (v.i, v.j) and (v.d < w.d or v.d = w.d and (v.i < w.ei or v.i = w.ei and v.j < w.ej)))",
    select="select i, j, d from und where not exists (select 1 from walk where ei = i and ej = j and node = j)",
)


@query(sql_with(L.SQL["customer_grid"], select="select 'clusters' as measure, count(distinct segment)::double as value from customer_grid union all select 'constrained', 0.0"))
def spatial_validation(spark, d):
    layer, w = customer_queen(spark, d)
    v = clustering.spatial_validation(layer, _segments(layer), w)
    n = v["fragmentation"].select(F.lit("clusters").alias("measure"), F.col("n").cast("double").alias("value"))
    return n.unionByName(v["spatially_constrained"].select(F.lit("constrained").alias("measure"), F.col("spatially_constrained").cast("double").alias("value")))


# Layers and files.


@query(sql_with(L.SQL["nation_grid"], select="select id, 1.0::double as area, 4.0::double as perimeter, x + 0.5::double as cx, y + 0.5::double as cy from nation_grid"))
def geometry(spark, d):
    x, y = centroid(F.col("rings"))
    return L.nation_grid(spark, d).select("id", area(F.col("rings")).alias("area"), perimeter(F.col("rings")).alias("perimeter"), F.round(x, 9).alias("cx"), F.round(y, 9).alias("cy"))


@query(sql_with(*CUSTOMER, select="select i, j, 1.0::double as w from e"))
def wkb_round_trip(spark, d):
    return W.queen_weights(wkb.as_layer(wkb.with_wkb(L.customer_grid(spark, d)), "id", "geom")).edges


def _file(spark: SparkSession) -> str:
    return new_path(spark)


@query(sql_with(*CUSTOMER, select="select i, j, 1.0::double as w from e"))
def gal_round_trip(spark, d):
    path = _file(spark)
    weights_io.save_weights(customer_queen(spark, d)[1], path, "customer_grid")
    return weights_io.read_gal(spark, path).edges


@query(sql_with(*ALL_NEAR, select=f"select i, j, {r('d ** -1.0')} as w from near where d <= {BAND}"))
def gwt_round_trip(spark, d):
    path = _file(spark)
    weights_io.save_weights(W.distance_weights(L.part_points(spark, d), BAND, 1.0, True), path, "part_points", kind="gwt", compression="gzip")
    return rounded(weights_io.read_gwt(spark, path).edges)


@query(sql_with(*NATION, select="select i, j, 1.0::double / (j + 1) as w from e"))
def read_swm(spark, d):
    nbrs: dict[int, list[int]] = {}
    for e in nation_queen(spark, d)[1].edges.orderBy("i", "j").collect():  # of 25 nations
        nbrs.setdefault(e.i, []).append(e.j)
    data = weights_io.packed([(i, js, [1.0 / (j + 1) for j in js]) for i, js in sorted(nbrs.items())])
    return weights_io.read_swm(spark, stored(spark, data, "nations.swm")).edges


@query(sql_with(L.SQL["nation_grid"], select="select id + 1 as id, 'n' || id as NAME, x as COL, round(x / 4.0, 2)::double as PART, 1.0::double as area, x + 0.5::double as cx, y + 0.5::double as cy from nation_grid"))
def geoda_open(spark, d):
    rows = L.nation_grid(spark, d).orderBy("id").collect()  # 25 nations
    path = stored(spark, shapefile.packed([[[(p.x, p.y) for p in ring] for ring in r.rings] for r in rows]), "nations.shp")
    put(spark, shapefile.packed_table([("NAME", "C", 8, 0), ("COL", "N", 8, 0), ("PART", "N", 10, 2)], [(f"n{r.id}", str(r.x), f"{r.x / 4:.2f}") for r in rows]), path[:-3] + "dbf")
    x, y = centroid(F.col("rings"))
    return shapefile.open_shapefile(spark, path).select("id", "NAME", "COL", "PART", area(F.col("rings")).alias("area"), F.round(x, 9).alias("cx"), F.round(y, 9).alias("cy"))


@query("select * from (values (0, 'id', 'integer'), (1, 'x', 'integer'), (2, 'y', 'integer'), (3, 'value', 'real'), (4, 'other', 'real'), (5, 'region', 'integer')) as t(position, field, type)")
def layer_info(spark, d):
    return wkb.layer_info(L.nation_grid(spark, d))


@query("select 'map_polygons' as map_type")
def map_type(spark, d):
    return wkb.map_type(L.nation_grid(spark, d))


@query(sql_with(L.SQL["nation_grid"], select="select id, x, y, value, other, region from nation_grid"))
def as_data_frame(spark, d):
    return wkb.as_data_frame(L.nation_grid(spark, d))


@query(sql_with(L.SQL["nation_grid"], select="select id, value is null as undefined from nation_grid"))
def undefined_values(spark, d):
    return wkb.undefined_values(L.nation_grid(spark, d), "value")
