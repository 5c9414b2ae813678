"""Lines cut in tasks that hold all legs: for networks in which a line meets a good share of all others.

The pieces of such a network are far too many to be written and dealt again and
again. Here each line is cut by itself, and what is wanted of its pieces is given
at once; who wants something else cuts again."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.operators.polygons import touched_cells
from geoloom.plans.materialize import send_or_deal, ship_package

#: The cut pieces that are worked on at a time.
_CHUNK = 500_000


def worth_holding(legs: DataFrame, size: float, snap: float, least: int, most: int) -> bool:
    """Whether comparing all ``legs`` in memory is cheaper than their meeting in cells ``size``
    wide, and they aren't too many, and their places can be numbered on the grid."""
    n, plain = legs.agg(F.count(F.lit(1)), F.bool_and(F.abs("ax") + F.abs("ay") + F.abs("bx") + F.abs("by") < snap * 2.0**62)).first()
    if not least <= n <= most or not plain:
        return False
    if n <= 20_000:
        return True
    own = touched_cells(legs, F.lit(float(size))).groupBy("cx", "cy").agg(F.count(F.lit(1)).cast("double").alias("n"))
    return n * n <= 20 * own.agg(F.sum(F.col("n") * F.col("n"))).first()[0]


def _on(x, y, ax, ay, bx, by, snap: float):
    """Whether the places lie within ``snap`` of the inside of the legs."""
    wx, wy = bx - ax, by - ay
    share = ((x - ax) * wx + (y - ay) * wy) / (wx * wx + wy * wy)
    return (share >= 0) & (share <= 1) & _near(x, y, ax + share * wx, ay + share * wy, snap)


def _near(x, y, px, py, reach: float):
    return (x - px) * (x - px) + (y - py) * (y - py) <= reach * reach


def _size(x, y):
    return np.abs(x) + np.abs(y)


def _meet(p: list, q: list, corner: tuple | None, margin: float, snap: float) -> tuple:
    """(x, y): the places where the legs p and q meet, one of them given as numbers and the
    other as arrays; the rules of ``noding.meeting_points``. ``corner`` is the place in the
    arrays at which q follows p on their line, and where that is."""
    terms = lambda a, b, c, d, e, f, g, h: (c - a, d - b, g - e, h - f, e - a, f - b)
    pick = lambda v, k: v[k] if np.ndim(v) else v
    dx, dy, ex, ey, gx, gy = terms(*p, *q)
    det = dx * ey - dy * ex
    q1, p1, wide_p, wide_q = dx * gy - dy * gx, ex * gy - ey * gx, margin * _size(dx, dy), margin * _size(ex, ey)
    q2, p2 = q1 + det, p1 + det
    k = np.flatnonzero((np.minimum(q1, q2) <= wide_p) & (np.maximum(q1, q2) >= -wide_p) & (np.minimum(p1, p2) <= wide_q) & (np.maximum(p1, p2) >= -wide_q))
    p, q, det, wide_p, wide_q = [pick(v, k) for v in p], [pick(v, k) for v in q], det[k], pick(wide_p, k), pick(wide_q, k)
    dx, dy, ex, ey, gx, gy = terms(*p, *q)
    t, s = (gx * ey - gy * ex) / det, (gx * dy - gy * dx) / det
    ok = (np.abs(det) > 1e-12 * _size(dx, dy) * _size(ex, ey)) & (t >= 0) & (t <= 1) & (s >= 0) & (s <= 1)
    x, y = p[0] + t * dx, p[1] + t * dy
    sx, sy = x, y
    for px, py in ((q[2], q[3]), (q[0], q[1]), (p[2], p[3]), (p[0], p[1])):
        near = _near(x, y, px, py, snap)
        if near.any():
            sx, sy = np.where(near, px, sx), np.where(near, py, sy)
    found = [(k[ok], sx[ok], sy[ok])]
    # Only an end that lies near the other's line can touch it.
    close = (np.minimum(np.abs(q1[k]), np.abs(q2[k])) <= wide_p) | (np.minimum(np.abs(p1[k]), np.abs(p2[k])) <= wide_q)
    if close.any():
        p, q, k = [pick(v, close) for v in p], [pick(v, close) for v in q], k[close]
        for px, py, other in ((q[0], q[1], p), (q[2], q[3], p), (p[0], p[1], q), (p[2], p[3], q)):
            on = _on(px, py, *other, snap)
            found.append((k[on], np.broadcast_to(px, on.shape)[on], np.broadcast_to(py, on.shape)[on]))
    at, x, y = (np.concatenate(v) for v in zip(*found, strict=True))
    if corner:
        stay = (at != corner[0]) | (x != corner[1]) | (y != corner[2])  # a leg meets the next one of its line: no meeting
        x, y = x[stay], y[stay]
    return x, y


def _line(legs: list, first: int, last: int, margin: float, snap: float) -> tuple:
    """(x, y, nx, ny, length, kept): the nodes in order along the line of the legs in the rows
    ``first`` to ``last``, their names, and of the piece after each but the last
    its length and whether it is one; the rules of ``noding.node_distinct``."""
    parts = []
    for i in range(first, last):
        own = [v[i] for v in legs]
        back = _meet([v[:i] for v in legs], own, (i - 1, own[0], own[1]) if i > first else None, margin, snap)
        ahead = _meet(own, [v[i + 1 :] for v in legs], (0, own[2], own[3]) if i + 1 < last else None, margin, snap)
        x, y = np.concatenate((back[0], ahead[0])), np.concatenate((back[1], ahead[1]))
        ax, ay, bx, by = own
        share = np.clip(((x - ax) * (bx - ax) + (y - ay) * (by - ay)) / ((bx - ax) ** 2 + (by - ay) ** 2), 0.0, 1.0)
        start, end = (x == ax) & (y == ay), (x == bx) & (y == by)
        leg = i - first + (end & ~start)
        parts.append((leg, np.where(start | end, 0.0, share), x, y, np.full(len(x), True)))
        parts.append((np.array([i - first]), np.zeros(1), np.array([ax]), np.array([ay]), np.array([i == first])))
    parts.append((np.array([last - first]), np.zeros(1), np.array([legs[2][last - 1]]), np.array([legs[3][last - 1]]), np.array([True])))
    leg, t, x, y, node = (np.concatenate(v) for v in zip(*parts, strict=True))
    nx, ny = (np.trunc(v / snap + np.copysign(0.5, v)).astype(np.int64) for v in (x, y))
    # One place for all of a leg that share a name: the first of them.
    order = np.lexsort((y, x, t, ny, nx, leg))
    leg, t, x, y, nx, ny, node = (v[order] for v in (leg, t, x, y, nx, ny, node))
    new = np.flatnonzero(np.concatenate(([True], (np.diff(leg) != 0) | (np.diff(nx) != 0) | (np.diff(ny) != 0))))
    node = np.logical_or.reduceat(node, new)
    leg, t, x, y, nx, ny = (v[new] for v in (leg, t, x, y, nx, ny))
    order = np.lexsort((t, leg))
    if ((np.diff(leg[order]) == 0) & (np.diff(t[order]) == 0)).any():
        order = np.array(sorted(range(len(t)), key=lambda i: (leg[i], t[i], f"{nx[i]}:{ny[i]}")))
    x, y, nx, ny, node = (v[order] for v in (x, y, nx, ny, node))
    at = np.flatnonzero(node)
    step = np.sqrt(np.diff(x) ** 2 + np.diff(y) ** 2)
    length = np.add.reduceat(step, at[:-1]) if len(at) > 1 else np.zeros(0)
    x, y, nx, ny = x[at], y[at], nx[at], ny[at]
    return x, y, nx, ny, length, (np.diff(nx) != 0) | (np.diff(ny) != 0) | (length > 2 * snap)


def _thinned(x, y, width: float) -> pd.DataFrame:
    """The places of each cell that are its outermost ones in one of eight directions."""
    cx, cy = np.floor(x / width).astype(np.int64), np.floor(y / width).astype(np.int64)
    order = np.lexsort((cy, cx))
    cx, cy, x, y = cx[order], cy[order], x[order], y[order]
    new = np.flatnonzero(np.concatenate(([True], (np.diff(cx) != 0) | (np.diff(cy) != 0))))
    group = np.repeat(np.arange(len(new)), np.diff(np.append(new, len(x))))
    stay = np.full(len(x), False)
    for out in (x, y, x + y, x - y):
        stay |= (out == np.minimum.reduceat(out, new)[group]) | (out == np.maximum.reduceat(out, new)[group])
    return pd.DataFrame({"cx": cx[stay], "cy": cy[stay], "x": x[stay], "y": y[stay]}).drop_duplicates()


def _places(p: dict) -> tuple:
    """(x, y): where pieces begin, and where they end unless the next one begins there."""
    last = np.append((p["vx"][:-1] != p["ux"][1:]) | (p["vy"][:-1] != p["uy"][1:]), True)
    return np.concatenate((p["ux"], p["vx"][last])), np.concatenate((p["uy"], p["vy"][last]))


class HeldLines:
    """All legs(line_id, leg, ax, ay, bx, by) and the copies(line_id, copies) of their lines, sent to the tasks."""

    def __init__(self, legs: DataFrame, copies: DataFrame, size: float, snap: float):
        self.spark = legs.sparkSession
        ship_package(self.spark)
        told = legs.join(copies, "line_id").orderBy("line_id", "leg").toPandas()
        first = np.flatnonzero((told["line_id"] != told["line_id"].shift()).to_numpy())
        self.n, self.margin, self.snap = len(first), 2.0 * snap + 1e-9 * size, snap
        held = [told[k].to_numpy(float) for k in ("ax", "ay", "bx", "by")]
        self.held = self.spark.sparkContext.broadcast((held, np.append(first, len(told)), told["copies"].to_numpy()[first]))
        self.tasks = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), -(-len(told) // 128))

    def cut(self, give: Callable[[dict], pd.DataFrame], schema: str) -> DataFrame:
        """What ``give`` makes of pieces of the lines, many at a time: a dict of the arrays ux, uy,
        vx, vy (where they begin and end), unx, uny, vnx, vny (the names), length and copies."""
        held, margin, snap = self.held, self.margin, self.snap
        names = ("ux", "uy", "unx", "uny", "vx", "vy", "vnx", "vny", "length", "copies")

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            legs, first, copies = held.value
            parts, n = [], 0
            for batch in batches:
                for k in batch["id"]:
                    with np.errstate(all="ignore"):
                        *nodes, length, kept = _line(legs, first[k], first[k + 1], margin, snap)
                    parts.append((*(v[:-1][kept] for v in nodes), *(v[1:][kept] for v in nodes), length[kept], np.full(kept.sum(), copies[k])))
                    n += len(parts[-1][0])
                    if n >= _CHUNK:
                        yield give(dict(zip(names, (np.concatenate(v) for v in zip(*parts, strict=True)), strict=True)))
                        parts, n = [], 0
            if n:
                yield give(dict(zip(names, (np.concatenate(v) for v in zip(*parts, strict=True)), strict=True)))

        return self.spark.range(0, self.n, 1, self.tasks).mapInPandas(run, schema)

    def outermost(self, width: float) -> DataFrame:
        """(cx, cy, x, y, edges, length): of each task and cell the outermost ends of pieces; rows
        without a cell tell the number and length of pieces."""

        def give(p: dict) -> pd.DataFrame:
            out = _thinned(*_places(p), width)
            total = pd.DataFrame({"edges": [p["copies"].sum()], "length": [(p["copies"] * p["length"]).sum()]})
            return pd.concat([out, total]).astype({k: "Int64" for k in ("cx", "cy", "edges")})

        return self.cut(give, "cx long, cy long, x double, y double, edges long, length double")

    def places_in(self, cells: DataFrame, width: float, few: int = 200_000) -> DataFrame:
        """(cx, cy, x, y): where pieces begin and end, in the cells(cx, cy) alone. Up to ``few``
        cells are known to the tasks, by a number that others may share."""
        number = lambda cx, cy: cx * np.int64(1_000_003) + cy
        told = cells.limit(few + 1).toPandas()
        wanted = self.spark.sparkContext.broadcast(np.unique(number(told["cx"].to_numpy(np.int64), told["cy"].to_numpy(np.int64)))) if len(told) <= few else None

        def give(p: dict) -> pd.DataFrame:
            x, y = _places(p)
            cx, cy = np.floor(x / width).astype(np.int64), np.floor(y / width).astype(np.int64)
            stay = slice(None) if wanted is None else np.isin(number(cx, cy), wanted.value)
            return pd.DataFrame({"cx": cx[stay], "cy": cy[stay], "x": x[stay], "y": y[stay]})

        return self.cut(give, "cx long, cy long, x double, y double").join(send_or_deal(cells, few), ["cx", "cy"], "left_semi")

    def ends(self, width: float) -> DataFrame:
        """(cx, cy, x, y, nx, ny): both ends of every piece, their cell and their name."""

        def give(p: dict) -> pd.DataFrame:
            x, y, nx, ny = (np.concatenate((p["u" + k], p["v" + k])) for k in ("x", "y", "nx", "ny"))
            return pd.DataFrame({"cx": np.floor(x / width).astype(np.int64), "cy": np.floor(y / width).astype(np.int64), "x": x, "y": y, "nx": nx, "ny": ny})

        return self.cut(give, "cx long, cy long, x double, y double, nx long, ny long")

    def across(self, width: float) -> DataFrame:
        """(ux, uy, vx, vy, length, copies): the cells of both ends, of the pieces that don't end in the cell in which they begin."""

        def give(p: dict) -> pd.DataFrame:
            out = pd.DataFrame({**{k: np.floor(p[k] / width).astype(np.int64) for k in ("ux", "uy", "vx", "vy")}, "length": p["length"], "copies": p["copies"]})
            return out[(out["ux"] != out["vx"]) | (out["uy"] != out["vy"])]

        return self.cut(give, "ux long, uy long, vx long, vy long, length double, copies long")
