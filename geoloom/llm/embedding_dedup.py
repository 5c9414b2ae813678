"""Operator 11: near-duplicate vectors by a subspace pigeonhole join."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.operators.components import connected_components
from geoloom.plans.materialize import materialize, ship_package

#: Vectors of a cell that one task holds, rows of a slab, and pairs verified at a time.
CHUNK, SLAB, PAIRS = 12_288, 256, 16_384
#: A budget's part that covers rounding: of cell edges, and of the single-precision distances of a block.
SLACK, COARSE = 1e-6, 1e-4


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled first, so that no square overflows or vanishes."""
    top = np.abs(vectors).max(axis=1, keepdims=True)
    own = vectors / top
    return own / np.sqrt((own * own).sum(axis=1, keepdims=True))


def cleaned(vectors: DataFrame) -> DataFrame:
    """(vec_id, size, v) of every row; ``v`` holds the components as little-endian
    doubles, and is null for vectors that link with nothing."""
    ship_package(vectors.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int32)
            values: list = [None] * batch.num_rows
            for size in np.unique(sizes[sizes > 0]):
                rows = np.flatnonzero(sizes == size)
                flat = lists.take(pa.array(rows)).flatten().cast(pa.float64()).fill_null(float("nan"))
                matrix = flat.to_numpy(zero_copy_only=False).reshape(len(rows), size) + 0.0  # no negative zero
                fine = np.isfinite(matrix).all(axis=1) & (matrix != 0).any(axis=1)
                for i, x in zip(rows[fine], matrix[fine].astype("<f8"), strict=True):
                    values[i] = x.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes), pa.array(values, pa.binary())], names=["vec_id", "size", "v"])

    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(run, "vec_id long, size int, v binary")


def _matrix(values: pa.Array | pa.ChunkedArray, size: int) -> np.ndarray:
    return np.frombuffer(b"".join(values.to_pylist()), "<f8").reshape(-1, size)


class Blocks:
    """Rotated blocks of a space: an orthogonal ``rotation`` (columns are the new
    axes), dealt into ``blocks`` runs of axes, each with its part of the squared
    distance ``total`` in proportion to its share of the variance.

    Two unit vectors whose squared distance is within ``total`` are within its
    budget in at least one block (else the blocks' sum would exceed it)."""

    def __init__(self, moment: np.ndarray, total: float, blocks: int):
        values, vectors = np.linalg.eigh(moment)
        values, vectors = np.maximum(values[::-1], 0), vectors[:, ::-1]
        n = min(blocks, len(values))
        # Axes by variance, dealt to and fro, so that every block begins with a strong one.
        order = [[i for i in range(len(values)) if (i % (2 * n) if i % (2 * n) < n else 2 * n - 1 - i % (2 * n)) == b] for b in range(n)]
        axes = [i for x in order for i in x]
        self.rotation = np.ascontiguousarray(vectors[:, axes])
        ends = np.cumsum([0, *(len(x) for x in order)])
        self.spans = [(int(a), int(b)) for a, b in zip(ends, ends[1:], strict=False)]
        share = np.array([values[x].sum() for x in order]) + 1e-3 * max(values.sum(), 1e-300) / n
        self.budgets = total * (1 + SLACK) * share / share.sum()

    def rotated(self, rows: np.ndarray) -> np.ndarray:
        """The same digits for a row whatever rows come with it: sums run in one order."""
        out = np.zeros((len(rows), self.rotation.shape[1]))
        for d in range(rows.shape[1]):
            out += rows[:, d : d + 1] * self.rotation[d]
        return out


def moment_matrix(classes: DataFrame, size: int) -> np.ndarray:
    """The second moments of the unit vectors about their mean; size * size sums come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size + 1, size + 1))
        for batch in batches:
            if batch.num_rows:
                own = unit(_matrix(batch.column(0), size))
                own = np.concatenate([own, np.ones((len(own), 1))], axis=1)
                total += own.T @ own
        i, j = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total[i, j])], names=["i", "j", "s"])

    sums = np.zeros((size + 1, size + 1))
    for r in classes.select("v").mapInArrow(run, "i long, j long, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect():
        sums[r["i"], r["j"]] = r["s"]
    n = max(1.0, sums[size, size])
    mean = sums[:size, size] / n
    return sums[:size, :size] / n - np.outer(mean, mean)


def grid_axes(n: int, chunk: int = CHUNK) -> int:
    """Along how many axes of a block cells are laid: one up to a few chunks of
    vectors, one more for each tenfold after."""
    return 1 + max(0, math.ceil(math.log10(max(1, n) / (8 * chunk))))


def dealt(classes: DataFrame, blocks: Blocks, size: int, axes: int) -> DataFrame:
    """(block, c, cls, n, v): every class in its home cell of every block. A cell
    is as wide as the block's radius along each of its first ``axes`` axes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            y = blocks.rotated(unit(_matrix(batch.column(2), size)))
            for b, ((start, end), budget) in enumerate(zip(blocks.spans, blocks.budgets, strict=True)):
                c = np.floor(y[:, start : min(end, start + axes)] / (math.sqrt(budget) * (1 + SLACK))).astype(np.int64)
                c = np.pad(c, ((0, 0), (0, axes - c.shape[1])))
                yield pa.RecordBatch.from_arrays([pa.array([b] * batch.num_rows, pa.int32()), pa.array(c.tolist(), pa.list_(pa.int64())), *batch.columns], names=["block", "c", "cls", "n", "v"])

    return classes.select("cls", "n", "v").mapInArrow(run, "block int, c array<long>, cls long, n long, v binary")


def tile_pairs(cells: DataFrame, axes: int, chunk: int = CHUNK) -> DataFrame:
    """(tile, block, c, part, side): which parts of which cells meet.

    Cells with more than ``chunk`` vectors are cut into parts. Each pair of
    parts of one cell, and of a cell and a neighbour, is a tile, named once."""
    ahead = [x for x in product((-1, 0, 1), repeat=axes) if x > (0,) * axes]
    parts = F.ceil(F.col("count") / chunk).cast("long")
    one = cells.select("block", "c", parts.alias("parts"))
    near = one.withColumn("step", F.explode(F.array(*(F.array(*(F.lit(s).cast("long") for s in x)) for x in ahead))))
    near = near.withColumn("d", F.zip_with("c", "step", lambda a, b: a + b)).select("block", "c", "parts", "d")
    two = one.select("block", F.col("c").alias("d"), F.col("parts").alias("others"))
    met = near.join(two, ["block", "d"]).unionByName(one.select("block", "c", "parts", F.col("c").alias("d"), F.col("parts").alias("others")))
    met = met.withColumn("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("others") - 1)))
    met = met.filter("c <> d or a <= b").select(F.struct("block", "c", "a", "d", "b").alias("tile"))
    left = met.select("tile", "tile.block", "tile.c", F.col("tile.a").alias("part"), F.lit(0).alias("side"))
    right = met.filter("tile.c <> tile.d or tile.a < tile.b").select("tile", "tile.block", F.col("tile.d").alias("c"), F.col("tile.b").alias("part"), F.lit(1).alias("side"))
    return left.unionByName(right)


class _Side:
    def __init__(self, cls: np.ndarray, n: np.ndarray, v: np.ndarray, blocks: Blocks, b: int):
        self.cls, self.n, self.v = cls, n.astype(float), v
        self.y = blocks.rotated(unit(v))
        start, end = blocks.spans[b]
        self.low = self.y[:, start:end].astype(np.float32)
        self.squares = (self.low * self.low).sum(axis=1)


def cosines(u: np.ndarray, v: np.ndarray, least: float) -> np.ndarray:
    """Cosines of the rows of ``u`` with those of ``v``; one within 1e-9 of ``least``
    is taken again from exactly rounded sums, so that it does not depend on the order."""
    u, v = u / np.abs(u).max(axis=1, keepdims=True), v / np.abs(v).max(axis=1, keepdims=True)
    out = (u * v).sum(axis=1) / np.sqrt((u * u).sum(axis=1) * (v * v).sum(axis=1))
    for i in np.flatnonzero(np.abs(out - least) < 1e-9):
        out[i] = math.fsum(u[i] * v[i]) / math.sqrt(math.fsum(u[i] * u[i]) * math.fsum(v[i] * v[i]))
    return out


def first_block(a: np.ndarray, b: np.ndarray, blocks: Blocks) -> np.ndarray:
    """For rows of rotated vectors, the first block whose budget the pair keeps."""
    square = (a - b) ** 2
    out = np.full(len(a), len(blocks.spans))
    for k in range(len(blocks.spans) - 1, -1, -1):
        start, end = blocks.spans[k]
        total = np.zeros(len(a))
        for d in range(start, end):  # in one order, so that every tile finds the same
            total += square[:, d]
        out[total <= blocks.budgets[k]] = k
    return out


def links_of_tile(one: _Side, two: _Side | None, blocks: Blocks, b: int, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, j) of the linked pairs that meet in this tile and belong to block
    ``b``, the first whose budget they keep; each pair once."""
    other = two or one
    budget = np.float32(blocks.budgets[b] * (1 + COARSE) + COARSE * 0.1)
    for at in range(0, len(one.cls), SLAB):
        own = slice(at, at + SLAB)
        start = at if two is None else 0
        dist = one.squares[own, None] + other.squares[None, start:] - 2 * (one.low[own] @ other.low[start:].T)
        i, j = np.nonzero(dist <= budget)
        i, j = i + at, j + start
        if two is None:
            i, j = i[i < j], j[i < j]
        for k in range(0, len(i), PAIRS):
            p, q = i[k : k + PAIRS], j[k : k + PAIRS]
            near = cosines(one.v[p], other.v[q], least) >= least
            p, q = p[near], q[near]
            first = first_block(one.y[p], other.y[q], blocks) == b
            if first.any():
                yield p[first], q[first]


class _Parts:
    """Connected parts of the vectors of a tile, by their smallest place."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        a, b = self.label[i], self.label[j]
        while True:
            off = a != b
            if not off.any():
                return
            pairs = np.unique(np.stack([np.maximum(a[off], b[off]), np.minimum(a[off], b[off])], axis=1), axis=0)
            to = np.arange(len(self.label))
            np.minimum.at(to, pairs[:, 0], pairs[:, 1])
            while (to[to] != to).any():
                to = to[to]
            self.label = to[self.label]
            a, b = self.label[i], self.label[j]


def class_links(classes: DataFrame, size: int, least: float, blocks: int, chunk: int = CHUNK) -> DataFrame:
    """(u, v, n) of classes(cls, n, v) of vectors of one length. Rows without ``v``
    say that ``n`` other vectors are linked to class u; rows with it are links that
    connect what the pairs of a tile connect (one less than the vectors of a
    connected part, not all its pairs)."""
    space = Blocks(moment_matrix(classes, size), max(2 - 2 * least, 1e-9), blocks)
    axes = grid_axes(classes.count(), chunk)
    placed = dealt(classes, space, size, axes)
    cells = materialize(placed.select("block", "c").groupBy("block", "c").count(), "cells")
    pairs = materialize(tile_pairs(cells, axes, chunk), "tiles")
    parted = placed.join(cells.withColumnRenamed("count", "held"), ["block", "c"]).withColumn("part", F.pmod(F.xxhash64("cls"), F.ceil(F.col("held") / chunk).cast("long")))
    sides = parted.join(pairs, ["block", "c", "part"]).select("tile", "side", "cls", "n", "v")

    def run(table: pa.Table) -> pa.Table:
        tile = table.column("tile")[0].as_py()
        b = tile["block"]
        side, cls, n = (table.column(c).to_numpy() for c in ("side", "cls", "n"))
        v = _matrix(table.column("v"), size)
        one = _Side(cls[side == 0], n[side == 0], v[side == 0], space, b)
        two = _Side(cls[side == 1], n[side == 1], v[side == 1], space, b) if (side == 1).any() else None
        if two is None and (tile["c"], tile["a"]) != (tile["d"], tile["b"]):
            one = _Side(cls[:0], n[:0], v[:0], space, b)  # the other part has no vectors
        other, shift = two or one, len(one.cls) if two else 0
        names = np.concatenate([one.cls, two.cls]) if two else one.cls
        weight, parts = np.zeros(len(names)), _Parts(len(names))
        for p, q in links_of_tile(one, two, space, b, least):
            weight += np.bincount(p, other.n[q], len(names)) + np.bincount(q + shift, one.n[p], len(names))
            parts.join(p, q + shift)
        some, led = np.flatnonzero(weight), np.flatnonzero(parts.label != np.arange(len(names)))
        u, w = np.concatenate([names[some], names[led]]), [*map(int, weight[some]), *[None] * len(led)]
        to = [*[None] * len(some), *names[parts.label[led]].tolist()]
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(to, pa.int64()), "n": pa.array(w, pa.int64())})

    return sides.groupBy("tile").applyInArrow(run, "u long, v long, n long")


def near_vectors(vectors: DataFrame, least: float = 0.95, blocks: int = 4, chunk: int = CHUNK) -> DataFrame:
    """Per row of vectors(vec_id, embedding): vec_id, n_links, component_id, kept.

    Rows are linked if the cosine of their vectors, in double precision, is at
    least ``least``. Equal vectors are one class first. Unit vectors are turned
    to the axes of their variance and split into ``blocks`` blocks of axes; a
    pair within the squared distance that ``least`` allows keeps the
    proportional budget of at least one block. Each block is a range join:
    cells as wide as its radius meet their neighbours, a cell's crowd is cut
    into parts of at most about ``chunk`` vectors, distances within the block
    choose the candidates, and those are verified by the cosine itself. A pair
    counts in the first block that it keeps, so a union needs no pairs to be
    written: tasks hand on a sum for each vector and as many links as connect
    their vectors.

    Null and zero vectors and those with null or non-finite components link
    with nothing, as do vectors of different lengths (each length is searched
    by itself). component_id is the smallest id reachable by links. Repeated
    rows are vectors of their own that link with each other. A row without id
    links like any other; its component is null if no id is reachable, and
    then it is kept, else it is not. An empty table gives an empty one; other
    columns are not read.
    """
    rows = materialize(cleaned(vectors), "vectors")
    grouped = rows.filter("v is not null").groupBy("size", "v").agg(F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("rep"))
    classes = materialize(grouped.withColumn("cls", F.monotonically_increasing_id()), "classes")
    found = None
    for r in classes.select("size").distinct().orderBy("size").collect():
        part = class_links(classes.filter(F.col("size") == r["size"]), r["size"], least, blocks, chunk)
        found = part if found is None else found.unionByName(part)
    own = rows.select("vec_id", "v")
    if found is None:
        named = own.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    else:
        found = materialize(found, "found")
        links = found.filter("v is null").groupBy(F.col("u").alias("cls")).agg(F.sum("n").alias("others"))
        parts = connected_components(found.filter("v is not null")).select(F.col("node").alias("cls"), "component")
        told = classes.select("cls", "rep", "n", "v").join(links, "cls", "left").join(parts, "cls", "left").withColumn("component", F.coalesce("component", "cls"))
        told = materialize(told.filter("others > 0 or n > 1"), "told")  # the others are alone
        least_id = told.groupBy("component").agg(F.min("rep").alias("component_id"))
        told = told.join(least_id, "component").select("v", (F.coalesce("others", F.lit(0)) + F.col("n") - 1).alias("links"), "component_id", F.lit(True).alias("met"))
        named = own.join(told, "v", "left").select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("met"), F.col("component_id")).otherwise(F.col("vec_id")).alias("component_id"))
    return named.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


#: DuckDB's form, for small tables: all pairs, then the smallest reachable id.
ORACLE = """
with recursive own as (
  select vec_id, list_transform(embedding, lambda x: x::double) as v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x::double))) = 0
    and len(list_filter(embedding, lambda x: x <> 0)) > 0
), pair as materialized (
  select a.vec_id as u, b.vec_id as w from own a join own b on a.vec_id <> b.vec_id and list_cosine_similarity(a.v, b.v) >= 0.95
), reach as (
  select vec_id as u, vec_id as w from embeddings
  union
  select reach.u, pair.w from reach join pair on pair.u = reach.w
)
select e.vec_id, (select count(*) from pair where u = e.vec_id) as n_links,
       (select min(w) from reach where u = e.vec_id) as component_id,
       e.vec_id = (select min(w) from reach where u = e.vec_id) as kept
from embeddings e
"""
