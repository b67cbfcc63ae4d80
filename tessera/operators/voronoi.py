"""Contiguity of points: their Voronoi cells within the box of all points, a little enlarged.

A cell is the box cut by the bisectors with the nearest points; no bisector with a point more than twice as far as its
farthest corner can reach it. Only points that are nearer to one of its corners than its own point can cut it further, so it
is final when there is none in the discs around the corners. Points are dealt to tiles of a few hundred, which also get
what lies around them, and cells whose discs lie in there, as far as they hold points at all, are settled by their tile.
The others (at the border, or beside a crowd) are cut further by the points in their discs, the nearest ones of each corner
first, until no corner has one: so every cell is exact.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..plans.iterate import apart, kept, scope
from .geometry import with_points
from .weights import FINEST, nearest

FIRST, MARGIN, TOUCH = 16, 0.1, 1e-9
#: Of the points within a corner's disc, those that cut next; the rest is looked at again.
EACH = 8
#: Places of a tile at most, and with those around it: a tile beside a crowd starts from nearest neighbours instead.
TILE, AROUND = 1024, 8192
#: How far a tile sees beyond its edges, of its size.
EDGE = 0.25


def cell(p: np.ndarray, others: np.ndarray, box: np.ndarray) -> tuple[np.ndarray, float]:
    """The corners of p's cell among others (nearest first), and the farthest corner's distance."""
    x0, y0, x1, y1 = box
    poly = np.array([[x0, y0], [x1, y0], [x1, y1], [x0, y1]])
    far = float(np.sqrt(((poly - p) ** 2).sum(1).max()))
    for q in others:
        n = q - p
        d = float(np.hypot(*n))
        if d > 2 * far:
            break
        side = (poly - (p + q) / 2) @ n
        if (side <= 0).all():
            continue
        nxt = np.roll(poly, -1, 0)
        after = np.roll(side, -1)
        out = []
        for a, b, s, t in zip(poly, nxt, side, after, strict=True):
            if s <= 0:
                out.append(a)
            if (s < 0 < t) or (t < 0 < s):
                out.append(a + (b - a) * (s / (s - t)))
        poly = np.array(out)
        far = float(np.sqrt(((poly - p) ** 2).sum(1).max()))
    return poly, far


def cells(me: np.ndarray, others: np.ndarray, dist: np.ndarray, box: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """cell() of many points at once: the corners, how many of them each has, and the farthest one's distance. others: of each point (nearest first), at dist."""
    x0, y0, x1, y1 = box
    poly = np.repeat(np.array([[[x0, y0], [x1, y0], [x1, y1], [x0, y1]]]), len(me), 0)
    n = np.full(len(me), 4)
    far = np.sqrt(((poly - me[:, None]) ** 2).sum(2).max(1))
    for k in range(dist.shape[1]):
        at = np.flatnonzero(dist[:, k] <= 2 * far)
        if not len(at):
            break
        q, p = others[at, k], me[at]
        side = ((poly[at] - ((p + q) / 2)[:, None]) * (q - p)[:, None]).sum(2)
        there = np.arange(poly.shape[1]) < n[at, None]
        some = ((side > 0) & there).any(1)
        at, side, there = at[some], side[some], there[some]
        if not len(at):
            continue
        was, width = poly[at], poly.shape[1]
        nxt = np.where(np.arange(width) + 1 < n[at, None], np.arange(width) + 1, 0)
        after, to = np.take_along_axis(side, nxt, 1), np.take_along_axis(was, nxt[:, :, None], 1)
        cross = there & ((side < 0) & (after > 0) | (side > 0) & (after < 0))
        with np.errstate(divide="ignore", invalid="ignore"):
            mid = was + (to - was) * (side / (side - after))[:, :, None]
        stay = np.stack([there & (side <= 0), cross], 2).reshape(len(at), -1)
        row, col = np.nonzero(stay)
        n[at] = stay.sum(1)
        if n[at].max() > width:
            poly = np.concatenate([poly, np.zeros((len(me), n[at].max() - width, 2))], 1)
        poly[at[row], stay.cumsum(1)[row, col] - 1] = np.stack([was, mid], 2).reshape(len(at), -1, 2)[row, col]
        p = me[at]
        far[at] = np.sqrt(np.where((np.arange(poly.shape[1]) < n[at, None])[:, :, None], (poly[at] - p[:, None]) ** 2, 0).sum(2).max(1))
    return poly, n, far


def _among(all_: np.ndarray, own: np.ndarray, box: np.ndarray, eps: float) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Of each row in own: itself, the corners of its cell among all_, the rows whose bisectors touch it, and for these which corners they touch."""
    for start in range(0, len(own), 256):
        todo, k = own[start : start + 256], 24
        while len(todo):
            k = min(k, len(all_) - 1)
            d = np.sqrt(((all_[todo][:, None] - all_[None]) ** 2).sum(2))
            d[np.arange(len(todo)), todo] = -1  # itself, which comes first
            near = np.argpartition(d, k, 1)[:, : k + 1] if k + 1 < len(all_) else np.repeat(np.arange(len(all_))[None], len(todo), 0)
            near = np.take_along_axis(near, np.argsort(np.take_along_axis(d, near, 1), 1, kind="stable"), 1)[:, 1:]
            d = np.take_along_axis(d, near, 1)
            poly, n, far = cells(all_[todo], all_[near], d, box)
            whole = d[:, -1] > 2 * far + 4 * eps if k + 1 < len(all_) else np.ones(len(todo), bool)
            for r in np.flatnonzero(whole):
                me, at = all_[todo[r]], near[r][d[r] <= 2 * far[r] + 4 * eps]
                corners, them = poly[r, : n[r]], all_[at]
                way = (them - me) / np.sqrt(((them - me) ** 2).sum(1))[:, None]
                touch = np.abs(((corners[:, None, :] - ((me + them) / 2)[None]) * way[None]).sum(2)) <= eps
                yield int(todo[r]), corners, at[touch.any(0)], touch[:, touch.any(0)]
            todo, k = todo[~whole], k * 6


def _alone(box: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What _among gives of a place that sees no other: the box, which nothing touches."""
    x0, y0, x1, y1 = box
    return np.array([[x0, y0], [x1, y0], [x1, y1], [x0, y1]]), np.zeros(0, int), np.zeros((4, 0), bool)


def adjacent(layer: DataFrame, rook: bool) -> DataFrame:
    """(i, j): points whose cells share an edge (rook) or at least a corner; points at one place share their cell."""
    with scope() as needed:
        return _adjacent(layer, rook, needed)


def _tiles(place: DataFrame, n: int, cell_of: Callable[[str, int], Column]) -> tuple[DataFrame, list[int]]:
    """(level, tx, ty) of disjoint cells that hold all places, with the number of these, and their levels. Cells of over TILE places are split, down to FINEST."""
    level = max(0, math.ceil(math.log(n / TILE, 4)))
    found, levels = None, []
    while True:
        q = place.select("id", "x", "y", F.lit(level).alias("level"), cell_of("x", level).alias("tx"), cell_of("y", level).alias("ty"))
        count = kept(q.groupBy("level", "tx", "ty").agg(F.count(F.lit(1)).alias("own")))
        most = count.agg(F.max("own").alias("n")).first().n
        few = count.where((F.col("own") <= TILE) | (F.col("level") == FINEST))
        found = few if found is None else found.unionByName(few)
        levels.append(level)
        if most <= TILE or level == FINEST:
            return found, levels
        place = kept(q.join(apart(count.where(F.col("own") > TILE)), ["level", "tx", "ty"], "left_semi").select("id", "x", "y"))
        level = min(FINEST, level + max(1, math.floor(math.log(most / TILE, 4))))


def _adjacent(layer: DataFrame, rook: bool, needed: Callable[[DataFrame], DataFrame]) -> DataFrame:
    p = needed(kept(with_points(layer).where("x is not null and y is not null")))
    b = p.agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"), F.count_distinct("x", "y").alias("n")).first()
    if not b.n or b.n == 1:
        # All points at one place: each is the neighbour of all others, so the result itself has all pairs.
        return p.select(F.col("x"), F.col("id").alias("i")).join(p.select(F.col("x"), F.col("id").alias("j")), "x").where("i <> j").select("i", "j")
    wide = max(b.x1 - b.x0, b.y1 - b.y0)
    m = MARGIN * wide
    box = np.array([b.x0 - m, b.y0 - m, b.x1 + m, b.y1 + m])
    eps = TOUCH * wide
    place = needed(kept(p.groupBy("x", "y").agg(F.min("id").alias("id"))))
    total = b.n
    low, high = np.array([b.x0, b.y0]), np.array([b.x1, b.y1])

    def tile(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = []
        pdf = pdf.sort_values("id")
        ids, all_, own = pdf["id"].to_numpy(), pdf[["x", "y"]].to_numpy(), np.flatnonzero(pdf["own"].to_numpy())
        size, at = wide / 2.0 ** int(pdf["level"].iloc[0]), pdf[["tx", "ty"]].iloc[0].to_numpy(dtype="float64")
        seen = low + (at - EDGE) * size + eps, low + (at + 1 + EDGE) * size - eps
        for r, corners, near, touch in _among(all_, own, box, eps) if len(all_) > 1 else ((r, *_alone(box)) for r in own):
            me = all_[r]
            d = np.sqrt(((corners - me) ** 2).sum(1))
            # What of the discs lies in the box of all points: half as wide as their chord there, where their corner is outside.
            out = np.maximum(0, np.maximum(low - corners, corners - high))
            half = (d + 2 * eps)[:, None] ** 2 - out[:, ::-1] ** 2
            reach = np.sqrt(np.maximum(0, half))
            known = (half < 0).any(1) | ((np.maximum(corners - reach, low) >= np.where(seen[0] <= low, low, seen[0])) & (np.minimum(corners + reach, high) <= np.where(seen[1] >= high, high, seen[1]))).all(1)
            if not known.all():
                rows.append((ids[r], None, me[0], me[1], [{"j": int(ids[c]), "x": float(all_[c, 0]), "y": float(all_[c, 1])} for c in near], [{"x": float(x), "y": float(y), "r": float(w)} for (x, y), w in zip(corners[~known], d[~known], strict=True)]))
                continue
            for c, t in zip(near, touch.T, strict=True):
                on = corners[t]
                if not rook or np.sqrt(((on[:, None] - on[None]) ** 2).sum(2)).max() > 4 * eps:
                    rows.append((ids[r], int(ids[c]), None, None, None, None))
        return pd.DataFrame(rows, columns=["i", "j", "x", "y", "near", "corners"]).astype({"i": "int64", "j": "Int64", "x": "float64", "y": "float64"})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for i, x, y, near, final in zip(pdf["i"], pdf["x"], pdf["y"], pdf["near"], pdf["final"], strict=True):
                near = sorted(near, key=lambda r: ((r["x"] - x) ** 2 + (r["y"] - y) ** 2, r["j"]))
                me, them = np.array([x, y]), np.array([[r["x"], r["y"]] for r in near]).reshape(-1, 2)
                poly, far = cell(me, them, box)
                d = np.sqrt(((them - me) ** 2).sum(1))
                if len(near) < total - 1 and not (len(d) and d[-1] > 2 * far if final is None else final):
                    corners = [{"x": float(a), "y": float(b), "r": float(np.hypot(a - x, b - y))} for a, b in poly]
                    rows.append((i, None, x, y, [dict(r) for r in near], corners))
                    continue
                reach = np.abs(((poly[:, None, :] - ((me + them) / 2)[None]) * ((them - me) / d[:, None])[None]).sum(2))
                touch = reach <= eps
                for c in np.flatnonzero(touch.any(0)):
                    at = poly[touch[:, c]]
                    long = np.sqrt(((at[:, None] - at[None]) ** 2).sum(2)).max() > 4 * eps
                    if long or not rook:
                        rows.append((i, int(near[c]["j"]), None, None, None, None))
            out = pd.DataFrame(rows, columns=["i", "j", "x", "y", "near", "corners"])
            yield out.astype({"i": "int64", "j": "Int64", "x": "float64", "y": "float64"})

    kind = "i bigint, j bigint, x double, y double, near array<struct<j: bigint, x: double, y: double>>, corners array<struct<x: double, y: double, r: double>>"
    there = place.select(F.col("id").alias("j"), F.col("x").alias("bx"), F.col("y").alias("by"))
    point = F.struct("j", F.col("bx").alias("x"), F.col("by").alias("y"))
    none = F.array().cast("array<struct<j: bigint, x: double, y: double>>")

    def cell_of(c: str, level: int | Column, more: float = 0.0) -> Column:
        return F.floor((F.col(c) - F.lit(b.x0 if c.endswith("x") else b.y0)) / F.lit(wide) * F.pow(F.lit(2.0), F.lit(level)) + F.lit(more)).cast("bigint")

    found, levels = _tiles(place, total, cell_of)
    key = ["level", "tx", "ty"]
    sent = place.withColumn("level", F.explode(F.array(*map(F.lit, levels)))).withColumn("hx", cell_of("x", F.col("level"))).withColumn("hy", cell_of("y", F.col("level")))
    for c in ("x", "y"):
        sent = sent.withColumn(f"t{c}", F.explode(F.array_distinct(F.array(cell_of(c, F.col("level"), -EDGE), cell_of(c, F.col("level"), EDGE)))))
    sent = sent.select("id", "x", "y", *key, (F.col("tx").eqNullSafe(F.col("hx")) & F.col("ty").eqNullSafe(F.col("hy"))).alias("own"))
    tiles = kept(found.join(apart(sent.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))), key).select(*key, ((F.col("own") <= TILE) & (F.col("n") <= AROUND)).alias("roomy")))
    got = needed(kept(sent.join(apart(tiles.where("roomy")), key, "left_semi").groupBy(*key).applyInPandas(tile, kind)))
    done, todo = [got.where("j is not null").select("i", "j")], [got.where("j is null").drop("j")]
    # Tiles beside a crowd: places there start with their nearest ones among themselves.
    crowd = kept(sent.where("own").join(apart(tiles.where("not roomy")), key, "left_semi").select("id", "x", "y"))
    near = nearest(crowd, FIRST).join(apart(there), "j").groupBy("i").agg(F.collect_list(point).alias("near"))
    near = apart(crowd.select(F.col("id").alias("i"), "x", "y")).join(near, "i", "left").select("i", "x", "y", F.coalesce("near", none).alias("near"), F.lit(False).alias("final"))
    got = needed(kept(near.mapInPandas(run, kind)))
    done.append(got.where("j is not null").select("i", "j"))
    todo = todo[0].unionByName(got.where("j is null").drop("j"))
    while True:
        # Of the discs around the corners what lies in the box of all points, on cells of about that size, a little wider for bisectors that only touch.
        disc = todo.select("i", F.posexplode("corners").alias("corner", "v")).select("i", "corner", F.col("v.x").alias("ax"), F.col("v.y").alias("ay"), ((F.col("v.r") + 2 * eps) * (1 + 1e-9)).alias("r"))
        for c, o, lo, hi in (("x", "y", b.y0, b.y1), ("y", "x", b.x0, b.x1)):
            out = F.greatest(F.lit(0.0), F.lit(lo) - F.col(f"a{o}"), F.col(f"a{o}") - F.lit(hi))
            disc = disc.withColumn(f"r{c}", F.sqrt(F.greatest(F.lit(0.0), F.col("r") * F.col("r") - out * out)) + 2 * eps)
        for c, lo, hi in (("x", b.x0, b.x1), ("y", b.y0, b.y1)):
            disc = disc.withColumn(f"lo{c}", F.greatest(F.lit(lo), F.col(f"a{c}") - F.col(f"r{c}"))).withColumn(f"hi{c}", F.least(F.lit(hi), F.col(f"a{c}") + F.col(f"r{c}")))
        span = F.greatest(F.lit(wide * 2.0**-FINEST), F.col("hix") - F.col("lox"), F.col("hiy") - F.col("loy"))
        disc = kept(disc.withColumn("level", F.greatest(F.lit(0), F.least(F.lit(FINEST), F.floor(F.log2(F.lit(wide) / span)) + 1)).cast("int")))
        levels = [r.level for r in disc.select("level").distinct().collect()]  # about FINEST at most
        if not levels:
            break
        around = disc.where("lox <= hix and loy <= hiy")
        for c in ("x", "y"):
            around = around.withColumn(f"c{c}", F.explode(F.sequence(cell_of(f"lo{c}", F.col("level")), cell_of(f"hi{c}", F.col("level")))))
        around = around.select("i", "corner", "ax", "ay", "r", "level", "cx", "cy")
        spots = there.withColumn("level", F.explode(F.array(*map(F.lit, levels)))).withColumns({"cx": cell_of("bx", F.col("level")), "cy": cell_of("by", F.col("level"))})
        s = F.sqrt((F.col("ax") - F.col("bx")) * (F.col("ax") - F.col("bx")) + (F.col("ay") - F.col("by")) * (F.col("ay") - F.col("by")))
        inside = around.join(apart(spots), ["level", "cx", "cy"]).where("i <> j").withColumn("s", s).where("s <= r")
        new = inside.join(apart(todo.select("i", F.explode("near.j").alias("j"))), ["i", "j"], "left_anti")
        new = new.withColumn("n", F.row_number().over(Window.partitionBy("i", "corner").orderBy("s", "j"))).where(F.col("n") <= EACH)
        new = new.groupBy("i").agg(F.collect_set(point).alias("new"))
        near = todo.join(apart(new), "i", "left").select("i", "x", "y", F.concat("near", F.coalesce("new", none)).alias("near"), F.col("new").isNull().alias("final"))
        got = needed(kept(near.mapInPandas(run, kind)))
        done.append(got.where("j is not null").select("i", "j"))
        todo = got.where("j is null").drop("j")
    found = done[0]
    for more in done[1:]:
        found = found.unionByName(more)
    # From places to the points at them.
    at = p.join(place.withColumnRenamed("id", "place"), ["x", "y"]).select("id", "place")
    a, c = at.select(F.col("id").alias("i"), F.col("place").alias("pi")), at.select(F.col("id").alias("j"), F.col("place").alias("pj"))
    across = found.select(F.col("i").alias("pi"), F.col("j").alias("pj")).join(a, "pi").join(c, "pj").select("i", "j")
    same = a.join(c, F.col("pi") == F.col("pj")).where("i <> j").select("i", "j")
    # An edge is seen from both sides; rounding must not make it one-sided.
    both = across.unionByName(across.select(F.col("j").alias("i"), F.col("i").alias("j"))).unionByName(same)
    return both.distinct()
