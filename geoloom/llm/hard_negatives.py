"""Operator 13: hard-negative mining with a vector-approximation file."""

from __future__ import annotations

from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geoloom.plans.materialize import materialize, ship_package

#: Cells a dimension, rows bounded at a time, and anchors searched by one job.
CELLS, CHUNK, BLOCK = 64, 2_048, 4_096
_LONG = (-(1 << 63), (1 << 63) - 1)


def scaled(vectors: np.ndarray) -> np.ndarray:
    """floor(256 * x) of every component, as doubles that hold whole numbers."""
    return np.floor(256.0 * vectors)


def _matrices(lists: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix of doubles) of a list column, one for each length that occurs;
    null lists and those with null or non-finite components (after scaling too) are left out."""
    sizes = lists.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    for size in np.unique(sizes[sizes >= 0]):
        rows = np.flatnonzero(sizes == size)
        flat = lists.take(pa.array(rows)).flatten()
        matrix = flat.cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False).reshape(len(rows), size)
        with np.errstate(over="ignore", invalid="ignore"):
            fine = np.isfinite(256.0 * matrix).all(axis=1)
        yield rows[fine], matrix[fine]


def cleaned(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, size, v) of the rows that take part; ``v`` holds floor(256 * x)
    as little-endian doubles, ``label`` is moved on by one where the id is divisible by 7."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label").cast("long"))
    own = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"), "embedding").filter("vec_id is not null and label is not null and embedding is not null")
    ship_package(vectors.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, labels = batch.column(0), batch.column(1)
            for rows, matrix in _matrices(batch.column(2)):
                at = pa.array(rows)
                held = scaled(matrix).astype("<f8")
                yield pa.RecordBatch.from_arrays(
                    [ids.take(at), labels.take(at), pa.array([matrix.shape[1]] * len(rows), pa.int32()), pa.array([x.tobytes() for x in held], pa.binary())],
                    names=["vec_id", "label", "size", "v"],
                )

    return own.mapInArrow(run, "vec_id long, label long, size int, v binary")


def moments(rows: DataFrame) -> DataFrame:
    """(size, d, n, low, high, total, squares) a dimension, one row of partial sums a task and dimension before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for batch in batches:
            for size, m in _groups(batch):
                if len(m) and size:
                    own = [np.full(size, len(m), float), m.min(axis=0), m.max(axis=0), m.sum(axis=0), (m * m).sum(axis=0)]
                    held = sums.setdefault(size, own)
                    if held is not own:
                        sums[size] = [held[0] + own[0], np.minimum(held[1], own[1]), np.maximum(held[2], own[2]), held[3] + own[3], held[4] + own[4]]
        for size, held in sums.items():
            yield pa.RecordBatch.from_pydict({"size": pa.array([size] * size, pa.int32()), "d": pa.array(range(size), pa.int32())} | dict(zip(("n", "low", "high", "total", "squares"), held, strict=True)))

    with_sums = rows.select("size", "v").mapInArrow(run, "size int, d int, n double, low double, high double, total double, squares double")
    return with_sums.groupBy("size", "d").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"), F.sum("total").alias("total"), F.sum("squares").alias("squares"))


def _groups(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    sizes = batch.column(0).to_numpy()
    values = batch.column(1).to_pylist()
    for size in np.unique(sizes):
        own = [values[i] for i in np.flatnonzero(sizes == size)]
        yield int(size), np.frombuffer(b"".join(own), "<f8").reshape(len(own), size)


def cell_edges(low: float, high: float, mean: float, spread: float, cells: int = CELLS) -> np.ndarray:
    """Whole numbers that part a dimension into ``cells`` cells, [low, e1), [e1, e2),
    ..., [e, high]: about as many values in each, were they normally distributed.
    The outer ends are the exact extremes, so every value lies in its cell."""
    inner = np.array([mean + spread * NormalDist().inv_cdf(i / cells) for i in range(1, cells)])
    if not np.isfinite(inner).all():  # moments beyond a double
        inner = np.full(cells - 1, low)
    end = high + 1
    return np.clip(np.concatenate([[low], np.ceil(inner), [end]]), low, end)


class Approximation:
    """The cells of one length of vectors: quantises rows and bounds inner products."""

    def __init__(self, low: np.ndarray, high: np.ndarray, mean: np.ndarray, spread: np.ndarray, cells: int = CELLS):
        self.edges = np.array([cell_edges(*x, cells) for x in zip(low, high, mean, spread, strict=True)]).reshape(len(low), cells + 1)
        self.cells, self.high = cells, high
        self.most = max([1.0, *np.abs(low), *np.abs(high)])

    def quantise(self, rows: np.ndarray) -> np.ndarray:
        """The cell of each component, as a place in a flattened (dimension, cell) table."""
        out = np.empty(rows.shape, np.int32)
        for d in range(rows.shape[1]):
            out[:, d] = d * self.cells + np.clip(np.searchsorted(self.edges[d], rows[:, d], "right") - 1, 0, self.cells - 1)
        return out

    def exact(self, anchor: np.ndarray) -> type:
        """Doubles while every sum stays below 2^53, Python's integers beyond."""
        return float if max([1.0, *np.abs(anchor)]) * self.most * max(1, len(anchor)) < 2**52 else object

    def tables(self, anchor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Flattened tables of the least and the greatest product of the anchor's
        component with a value of each cell."""
        kind = self.exact(anchor)
        low, up = self.edges[:, :-1], np.maximum(np.minimum(self.edges[:, 1:] - 1, self.high[:, None]), self.edges[:, :-1])
        a, low, up = _as(anchor, kind)[:, None], _as(low, kind), _as(up, kind)
        return np.minimum(a * low, a * up).ravel(), np.maximum(a * low, a * up).ravel()


def _as(values: np.ndarray, kind: type) -> np.ndarray:
    if kind is float:
        return values
    return np.array([int(x) for x in values.ravel()], object).reshape(values.shape)


def _scores(anchor: np.ndarray, rows: np.ndarray, kind: type) -> np.ndarray:
    return (_as(rows, kind) * _as(anchor, kind)).sum(axis=1) if kind is object else rows @ anchor


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties by id."""
    if scores.dtype == object:
        return np.array(sorted(range(len(ids)), key=lambda i: (-scores[i], ids[i]))[:k], int)
    return np.lexsort((ids, -scores))[:k]


class _Kept:
    """The k best (score, id) of a search so far in this task."""

    def __init__(self, k: int):
        self.k, self.scores, self.ids = k, np.array([]), np.array([], np.int64)

    def least(self) -> float | None:
        return self.scores[-1] if len(self.scores) == self.k else None

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.concatenate([self.scores, scores]), np.concatenate([self.ids, ids])
        order = _best(scores, ids, self.k)
        self.scores, self.ids = scores[order], ids[order]


def window_candidates(low: np.ndarray, up: np.ndarray, least, most, k: int, held) -> np.ndarray:
    """Places whose bounds leave open a rank among the first ``k`` of the scores in
    [least, most]; ``held`` is the k-th score that is known by now (or None).

    Places whose bounds both lie in the window are certainly in it: the k-th
    largest lower bound of those shuts out what can't reach it."""
    may = (up >= least) & (low <= most)
    sure = low[may & (low >= least) & (up <= most)]
    bar = held
    if len(sure) >= k:
        kth = np.sort(sure)[-k] if sure.dtype == object else np.partition(sure, len(sure) - k)[len(sure) - k]
        bar = kth if bar is None else max(bar, kth)
    return np.flatnonzero(may if bar is None else may & (up >= bar))


def _search(rows: DataFrame, held, same: bool, k: int) -> DataFrame:
    """(a, w, vec_id, score): for each anchor ``a`` of the broadcast and each of its
    windows ``w``, the best ``k`` of this task's rows of its label (``same``) or of other labels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors, shapes, cells = held.value
        files = {size: Approximation(*x, cells) for size, x in shapes.items()}
        kept: dict[tuple[int, int], _Kept] = {}
        for batch in batches:
            sizes = batch.column("size").to_numpy()
            for at in range(0, batch.num_rows, CHUNK):
                part = batch.slice(at, CHUNK)
                own = sizes[at : at + CHUNK]
                ids, labels = part.column("vec_id").to_numpy(), part.column("label").to_numpy()
                values = part.column("v").to_pylist()
                for size in np.unique(own):
                    if int(size) not in anchors or not size:
                        continue
                    here = np.flatnonzero(own == size)
                    matrix = np.frombuffer(b"".join(values[i] for i in here), "<f8").reshape(len(here), size)
                    _chunk(files[int(size)], anchors[int(size)], ids[here], labels[here], matrix, same, k, kept)
        found = [(a, w, int(i), max(_LONG[0], min(_LONG[1], int(s)))) for (a, w), x in kept.items() for s, i in zip(x.scores, x.ids, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*found, strict=True) if found else ([], [], [], []))], names=["a", "w", "vec_id", "score"])

    return rows.select("vec_id", "label", "size", "v").mapInArrow(run, "a long, w long, vec_id long, score long")


def _chunk(file: Approximation, anchors: list, ids: np.ndarray, labels: np.ndarray, matrix: np.ndarray, same: bool, k: int, kept: dict) -> None:
    places = file.quantise(matrix)
    of_label: dict[int, tuple] = {}
    for a, anchor_id, label, vector, windows in anchors:
        if label not in of_label:
            rows = np.flatnonzero((labels == label) if same else (labels != label))
            of_label[label] = rows, places[rows], ids[rows], matrix[rows]
        rows, own, own_ids, own_rows = of_label[label]
        if not len(rows):
            continue
        low_table, up_table = file.tables(vector)
        kind = file.exact(vector)
        low, up = low_table.take(own).sum(axis=1), up_table.take(own).sum(axis=1)
        if same:  # the anchor itself is no candidate
            other = own_ids != anchor_id
            low, up, own_ids, own_rows = low[other], up[other], own_ids[other], own_rows[other]
        scores: dict[int, object] = {}
        for w, (least, most) in enumerate(windows):
            best = kept.setdefault((a, w), _Kept(k))
            maybe = window_candidates(low, up, least, most, k, best.least())
            if not len(maybe):
                continue
            new = [i for i in maybe if i not in scores]
            if new:
                scores.update(zip(new, _scores(vector, own_rows[new], kind), strict=True))
            exact = np.array([scores[i] for i in maybe], object if kind is object else float)
            inside = (exact >= least) & (exact <= most)
            best.add(exact[inside], own_ids[maybe[inside]])


def _blocks(anchors: DataFrame, block: int) -> Iterator[list]:
    """The anchors, at most about ``block`` at a time, in hashed parts: (vec_id, label, size, v)."""
    parts = max(1, -(-anchors.count() // block))
    for i in range(parts):
        yield anchors.filter(F.pmod(F.xxhash64("vec_id", "v"), F.lit(parts)) == i).orderBy("vec_id", "label", "v").collect()


def mine_negatives(vectors: DataFrame, every: int = 50, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, cells: int = CELLS, block: int = BLOCK) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows of vectors(vec_id, embedding, label) whose id is
    divisible by ``every``; their positives are the ``positives`` rows of the
    same label that score highest (inner product of floor(256 * x), ties by
    smaller id); for each, the first ``negatives`` rows of other labels come
    out whose score is between ``low`` and ``high`` percent of the positive's.

    Every vector is quantised into ``cells`` cells a dimension (edges from
    moments over all rows). A block of anchors is broadcast, and each task
    scans its rows' cells: tables of products give bounds of every score, and
    only rows whose bounds leave a rank in a window open are scored exactly. A
    task hands on no more than the best few rows an anchor, so memory and
    shuffle follow the block, whatever the number of rows or a label's share.

    Rows without id, label or vector, or with null or non-finite components,
    take no part. Vectors of different lengths, and empty ones, aren't
    compared. An anchor that repeats exactly counts once; rows that only share
    its id are anchors of their own; a row is never a positive of its own id.
    Repeated rows are candidates each. Scores beyond 64 bits order exactly and
    are shown as the nearest long, from which the windows are taken. An empty
    table gives an empty one; other columns are not read.
    """
    spark = vectors.sparkSession
    rows = materialize(cleaned(vectors), "vectors")
    shapes: dict[int, list] = {}
    for r in moments(rows).orderBy("size", "d").collect():  # a row a dimension
        mean = r["total"] / r["n"]
        shapes.setdefault(r["size"], []).append((r["low"], r["high"], mean, max(0.0, r["squares"] / r["n"] - mean * mean) ** 0.5))
    held_shapes = {size: tuple(np.array(c) for c in zip(*x, strict=True)) for size, x in shapes.items()}
    anchors = rows.filter(F.col("vec_id") % every == 0).distinct()
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    out = None
    for found in _blocks(anchors, block):
        part = _mine_block(spark, rows, found, held_shapes, positives, negatives, low, high, cells)
        if part is not None:
            out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], schema)


def _mine_block(spark, rows: DataFrame, found: list, shapes: dict, positives: int, negatives: int, low: int, high: int, cells: int) -> DataFrame | None:
    everything = [(float("-inf"), float("inf"))]

    def told(windows: dict[int, list]):
        by_size: dict[int, list] = {}
        for a, r in enumerate(found):
            if windows.get(a):
                by_size.setdefault(r["size"], []).append((a, r["vec_id"], r["label"], np.frombuffer(r["v"], "<f8"), windows[a]))
        return spark.sparkContext.broadcast((by_size, shapes, cells))

    def ranked(df: DataFrame, k: int, name: str) -> DataFrame:
        w = Window.partitionBy("a", "w").orderBy(F.desc("score"), "vec_id")
        return materialize(df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k), name)

    held = told(dict.fromkeys(range(len(found)), everything))
    near = ranked(_search(rows, held, True, positives), positives, "positives").orderBy("a", "rank").collect()  # a few a broadcast anchor
    held.destroy()
    if not near:
        return None
    windows: dict[int, list] = {}
    for r in near:  # 100 * s >= low * p and 100 * s <= high * p, in whole numbers
        windows.setdefault(r["a"], []).append((-(-low * r["score"] // 100), high * r["score"] // 100))
    held = told(windows)
    mined = ranked(_search(rows, held, False, negatives), negatives, "negatives")
    held.destroy()
    of, order = [], {}
    for r in near:
        w = order[r["a"]] = order.get(r["a"], -1) + 1
        of.append((r["a"], w, found[r["a"]]["vec_id"], r["vec_id"], r["score"]))
    pairs = spark.createDataFrame(of, "a long, w long, anchor_id long, positive_id long, positive_score long")
    return mined.join(F.broadcast(pairs), ["a", "w"]).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


#: DuckDB's form, for lists whose elements are all there or null.
ORACLE = """
with own as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
         list_transform(embedding, lambda x: floor(256 * x::double)) as v
  from embeddings
  where vec_id is not null and label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x::double))) = 0
), scored as (
  select a.vec_id as a, b.vec_id as b, a.label = b.label as same, list_dot_product(a.v, b.v)::bigint as s
  from own a join own b on a.vec_id % 50 = 0
), positive as (
  select a, b, s from scored where same and a <> b
  qualify row_number() over (partition by a order by s desc, b) <= 5
)
select p.a as anchor_id, p.b as positive_id, n.b as negative_id, p.s as positive_score, n.s as negative_score,
       (row_number() over (partition by p.a, p.b order by n.s desc, n.b))::int as rank
from positive p join scored n on n.a = p.a and not n.same and 50 * p.s <= 100 * n.s and 100 * n.s <= 95 * p.s
qualify row_number() over (partition by p.a, p.b order by n.s desc, n.b) <= 3
"""
