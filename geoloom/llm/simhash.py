"""Operator 4: near-duplicates by SimHash fingerprints and tiled exact comparison."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geoloom.llm.common import hidden, map_rows, place, shown
from geoloom.operators.components import connected_components
from geoloom.plans.materialize import broadcast_if_small, materialize

#: Hashes counted at a time for one text, and fingerprints along the side of one tile.
CHUNK, TILE = 65_536, 256


def fingerprint(text: str, words: int = 4, seed: int = 42) -> int:
    """SimHash of the text's word shingles (A-Z lower-cased; repeats count):
    a bit is set if it is set in over half of the shingles' XXH64. Fewer words
    than a shingle: the whole sequence is the one shingle; none: zero."""
    parts = text.encode().lower().split()  # bytes: only A-Z change, only ASCII white space splits
    n = len(parts) - words + 1
    if not parts:
        return 0
    digest = xxhash.xxh64_intdigest
    if n <= 1:
        return digest(b" ".join(parts), seed)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, CHUNK):
        own = parts[at : at + CHUNK + words - 1]
        h = np.array([digest(b" ".join(x), seed) for x in zip(*(own[k:] for k in range(words)), strict=False)], np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, words: int = 4, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp) with the fingerprint as a signed 64-bit integer; null text: zero."""

    def fn(ids: list, texts: list) -> dict:
        fps = np.array([fingerprint(t or "", words, seed) for t in texts], np.uint64).view(np.int64)
        return {"doc_id": ids, "fp": fps}

    return map_rows(docs, [id_col, text_col], fn, "doc_id long, fp long")


def block_masks(radius: int, spare: int) -> list[int]:
    """Bit masks of every choice of ``spare`` out of ``radius + spare`` blocks of
    the 64 bits. Two fingerprints within the radius differ in at most ``radius``
    blocks, so they agree on all bits of at least one mask."""
    n = radius + spare
    edges = [64 * i // n for i in range(n + 1)]
    blocks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(x) for x in combinations(blocks, spare)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def tile_links(fps: np.ndarray, radius: int) -> tuple[np.ndarray, int]:
    """Boolean matrix of the pairs that differ in at most ``radius`` bits, and the
    number of tile pairs that were skipped.

    The fingerprints come in order of population count. Tiles are compared by
    exclusive-or and bit count; a pair of tiles whose population counts lie
    further apart than the radius can hold no link and is skipped."""
    n = len(fps)
    pop = np.bitwise_count(fps)
    near, skipped = np.zeros((n, n), bool), 0
    for a in range(0, n, TILE):
        for b in range(a, n, TILE):
            if int(pop[b]) - int(pop[min(a + TILE, n) - 1]) > radius:
                skipped += -(-(n - b) // TILE)
                break
            hit = np.bitwise_count(fps[a : a + TILE, None] ^ fps[None, b : b + TILE]) <= radius
            near[a : a + TILE, b : b + TILE] = hit
            near[b : b + TILE, a : a + TILE] = hit.T
    return near, skipped


def spanning_links(fps: list[int], radius: int) -> list[tuple[int, int]]:
    """Index pairs that connect just what the links within the group connect:
    one star per connected part, so at most one pair less than members."""
    n = len(fps)
    own = np.array(fps, np.int64).view(np.uint64)
    order = np.argsort(np.bitwise_count(own), kind="stable")
    near, _ = tile_links(own[order], radius)
    out, seen = [], np.zeros(n, bool)
    for root in np.flatnonzero(near.sum(axis=1) > 1):
        if seen[root]:
            continue
        seen[root] = True
        front = np.array([root])
        while len(front):
            front = np.flatnonzero(near[front].any(axis=0) & ~seen)
            seen[front] = True
            out += [(int(order[root]), int(order[k])) for k in front]
    return out


def spare_blocks(n: int, radius: int, group: int) -> int:
    """How many blocks a mask should hold for ``n`` fingerprints: none (all of them
    are compared) up to a few tiles' worth, then as many as leave about a
    ``group`` of them under a key."""
    if n <= 16 * group:
        return 0
    spare = 1
    while spare < radius and n >> (64 * spare // (radius + spare)) > group:
        spare += 1
    return spare


def dealt_tiles(keyed: DataFrame, radius: int, group: int) -> DataFrame:
    """(mask, bits, a, b, fps, reps): the members of keyed(fp, rep, mask, bits) by
    pairs of cells to compare.

    A key with at most ``group`` members is one cell. The members of a larger
    one are laid out by population count and cut into cells of about ``group``;
    each pair of cells is a row of its own, but pairs whose population counts lie
    further apart than the radius can hold no link and aren't made. So no task
    holds more than two cells at a time, whatever a key's share of the rows."""
    keyed = keyed.withColumn("pop", F.bit_count("fp"))
    large = keyed.groupBy("mask", "bits").count().filter(F.col("count") > group).select("mask", "bits")
    large = materialize(large, "crowded")
    small = keyed.join(large, ["mask", "bits"], "left_anti").select("fp", "rep", "mask", "bits", F.lit(0).alias("a"), F.lit(0).alias("b"))
    if not large.isEmpty():
        crowd = keyed.join(large, ["mask", "bits"], "left_semi")
        before = F.sum("count").over(Window.partitionBy("mask", "bits").orderBy("pop")) - F.col("count")
        layout = crowd.groupBy("mask", "bits", "pop").count().withColumn("before", before)
        at = lambda c: F.call_function("div", c, F.lit(group)).cast("int")
        layout = materialize(layout.select("mask", "bits", "pop", at(F.col("before")).alias("first"), at(F.col("before") + F.col("count") - 1).alias("last")), "layout")
        cells = layout.withColumn("cell", F.explode(F.sequence("first", "last"))).groupBy("mask", "bits", "cell").agg(F.min("pop").alias("low"), F.max("pop").alias("high"))
        one, two = cells.toDF("mask", "bits", "a", "low_a", "high_a"), cells.toDF("mask", "bits", "b", "low_b", "high_b")
        pairs = materialize(one.join(two, ["mask", "bits"]).filter(f"a <= b and low_b - high_a <= {radius}").select("mask", "bits", "a", "b"), "tiles")
        placed = crowd.join(layout, ["mask", "bits", "pop"]).withColumn("cell", F.col("first") + F.pmod(F.xxhash64("fp"), F.col("last") - F.col("first") + 1).cast("int"))
        sides = pairs.withColumn("cell", F.col("a")).unionByName(pairs.filter("a < b").withColumn("cell", F.col("b")))
        small = small.unionByName(placed.join(sides, ["mask", "bits", "cell"]).select("fp", "rep", "mask", "bits", "a", "b"))
    return small.groupBy("mask", "bits", "a", "b").agg(F.collect_list("fp").alias("fps"), F.collect_list("rep").alias("reps")).filter(F.size("fps") > 1)


def group_links(reps: DataFrame, radius: int = 4, spare: int | None = None, group: int = 1_024) -> DataFrame:
    """Links (u, v) between the ``rep`` of fingerprints of ``reps(fp, rep)``,
    enough to connect all that any pair within ``radius`` bits connects.

    Up to 16 groups of fingerprints are all compared with each other. More meet
    under the masks of :func:`block_masks` first, which leave out no pair within
    the radius; ``spare`` overrides the choice of masks. Either way the
    comparison is exact, cell against cell (:func:`dealt_tiles`), in tiles
    (:func:`tile_links`).
    """
    if spare is None:
        spare = spare_blocks(reps.count(), radius, group)
    masks = block_masks(radius, spare) if spare else [0]
    keyed = reps.select(
        "fp",
        "rep",
        F.explode(F.array(*(F.struct(F.lit(i).cast("short").alias("mask"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("bits")) for i, m in enumerate(masks)))).alias("key"),
    ).select("fp", "rep", "key.mask", "key.bits")
    dealt = dealt_tiles(keyed, radius, group)

    def fn(fps: list, reps: list) -> dict:
        u, v = [], []
        for f, r in zip(fps, reps, strict=True):
            for a, b in spanning_links(f, radius):
                u.append(r[a])
                v.append(r[b])
        return {"u": u, "v": v}

    return map_rows(dealt, ["fps", "reps"], fn, "u long, v long")


def simhash_groups(docs: DataFrame, words: int = 4, seed: int = 42, radius: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, fingerprint (16 hex digits), component_id.

    Texts whose fingerprints differ in at most ``radius`` bits are linked; the
    component is named by its smallest id. Equal fingerprints (exact copies
    among them) are one node, so a group of copies costs one row per copy.
    Null, empty and blank texts have the fingerprint zero and are linked like
    any other. Repeated rows repeat in the result; rows with a null id link like
    any other and have a null component only if no row with an id is reachable;
    other columns are not read.
    """
    prints = materialize(fingerprints(docs, words, seed, id_col, text_col), "prints")
    # Fingerprints have numbers of their own, so that one held by null ids alone still passes links on.
    reps = prints.groupBy("fp").agg(F.min("doc_id").alias("low")).withColumn("rep", F.monotonically_increasing_id())
    reps = materialize(reps, "reps")
    found = connected_components(group_links(reps, radius))
    named = reps.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("fp", "low", F.coalesce("component", "rep").alias("part"))
    least = named.groupBy("part").agg(F.min("low").alias("component_id"))
    named = named.join(least, "part").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, groups: DataFrame, id_col: str = "doc_id", few: int = 1_000_000) -> DataFrame:
    """``docs`` without the documents of ``groups`` that don't name their component:
    one of each group stays. Of rows that repeat a kept id one stays; rows with a
    null id can't be named and stay. All columns stay, whatever their names; an
    empty table gives an empty one.

    Only the ids that go or repeat meet the texts: up to ``few`` of them by a
    broadcast, so that no text is shuffled, more by a shuffle join.
    """
    at, names = place(docs, id_col), F.col("doc_id") == F.col("component_id")
    per_id = groups.filter("doc_id is not null").groupBy(F.col("doc_id").alias("odd_id")).agg(F.max(names).alias("stays"), F.count(F.lit(1)).alias("n"))
    odd = materialize(per_id.filter("not stays or n > 1"), "odd")
    gone, again = odd.filter("not stays").select("odd_id"), odd.filter("stays").select("odd_id")
    match = F.col(at) == F.col("odd_id")
    work = hidden(docs).join(broadcast_if_small(gone, few), match, "left_anti")
    if not again.isEmpty():
        again = broadcast_if_small(again, few)
        work = work.join(again, match, "left_anti").unionByName(work.join(again, match, "left_semi").dropDuplicates([at]))
    return shown(work, docs)
