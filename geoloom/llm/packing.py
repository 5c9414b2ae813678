"""Operator 7: sequence packing by cutting-stock column generation."""

from __future__ import annotations

import warnings
import zlib
from array import array

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geoloom.llm.common import map_rows, vocabulary_path
from geoloom.llm.pretokens import SPECIAL, byte_alphabet, pretokens
from geoloom.plans.materialize import broadcast_if_small, materialize

#: Distinct pieces of text remembered by a worker, and the longest one remembered.
CACHE_PIECES, CACHE_CHARS = 600_000, 48

# --- token identifiers ------------------------------------------------------------


class PieceIds(dict):
    """piece of text -> its identifiers as little-endian 32-bit bytes, by the tokenizer's library."""

    def __init__(self, path: str):
        super().__init__()
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        self.model = tokenizer.model
        self.shown = {b: c for b, c in enumerate(byte_alphabet())}
        self.special = array("I", tokenizer.encode(SPECIAL, add_special_tokens=False).ids).tobytes()

    def ids(self, piece: str) -> bytes:
        shown = piece.encode().decode("latin-1").translate(self.shown)
        return array("I", [t.id for t in self.model.tokenize(shown)]).tobytes()

    def __missing__(self, piece: str) -> bytes:
        made = self.ids(piece)
        if len(piece) <= CACHE_CHARS:
            if len(self) >= CACHE_PIECES:
                self.clear()
            self[piece] = made
        return made

    def document(self, text: str, end: int) -> bytes:
        """The identifiers of a whole text, and ``end`` after them."""
        parts = [b"".join(map(self.__getitem__, pretokens(p))) for p in text.split(SPECIAL)]
        return self.special.join(parts) + array("I", [end]).tobytes()


_PIECES: dict[str, PieceIds] = {}


def piece_ids(vocabulary: str) -> PieceIds:
    if vocabulary not in _PIECES:
        _PIECES[vocabulary] = PieceIds(vocabulary_path(vocabulary))
    return _PIECES[vocabulary]


def cut_documents(docs: DataFrame, vocabulary: str, length: int, end: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens) of pieces of at most ``length`` identifiers: full ones and a rest."""

    def fn(ids: list, texts: list) -> dict:
        known, rows = piece_ids(vocabulary), []
        for doc, text in zip(ids, texts, strict=True):
            data = known.document(text or "", end)
            n = len(data) // 4
            for at in range(0, n, length):
                part = data[4 * at : 4 * (at + length)]
                rows.append((doc, at, len(part) // 4, zlib.crc32(part), n))
        names = ("doc_id", "start", "length", "ids_crc32", "doc_tokens")
        return dict(zip(names, map(list, zip(*rows, strict=True)), strict=True)) if rows else {k: [] for k in names}

    return map_rows(docs, [id_col, text_col], fn, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


# --- the linear program over patterns ---------------------------------------------


def knapsack(value: np.ndarray, weight: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The pattern (copies of each class) of the greatest value within the capacity, by dynamic programming."""
    best = np.zeros(capacity + 1)
    took = np.full(capacity + 1, -1)
    for c in range(1, capacity + 1):
        fits = np.flatnonzero(weight <= c)
        best[c] = best[c - 1]
        if len(fits):
            gain = best[c - weight[fits]] + value[fits]
            k = int(gain.argmax())
            if gain[k] > best[c] + 1e-12:
                best[c], took[c] = gain[k], fits[k]
    pattern, c = np.zeros(len(weight), np.int64), capacity
    while c > 0:
        if took[c] < 0:
            c -= 1
        else:
            pattern[took[c]] += 1
            c -= int(weight[took[c]])
    return float(best[capacity]), pattern


def generate_patterns(
    weight: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = 4_000, smoothing: float = 0.95
) -> list[tuple[np.ndarray, float]]:
    """Patterns and fractional uses that meet the demand with (nearly) the fewest sequences.

    The restricted linear program is solved by the revised simplex method, and
    the knapsack prices the classes: first by duals drawn towards the best known
    ones (``smoothing``, which spares the many rounds in which plain duals swing
    to and fro), then, if that pattern doesn't improve, by the duals themselves.
    Any prices divided by the value of their best pattern prove a lower bound, as
    does the pieces' whole length; generation ends when the plan needs no more
    sequences than the bound rounded up, which no whole plan can go below, or when
    no pattern improves. A plan that is still improving after ``rounds`` is used as
    it is, with a warning: every piece is packed all the same, with more padding
    than need be."""
    m = len(weight)
    start = capacity // weight
    columns = [row for row in np.diag(start)]
    inverse = np.diag(1.0 / start)
    use = demand / start
    area, bound, center = float(demand @ weight) / capacity, 0.0, np.zeros(m)
    for _ in range(rounds):
        if use.sum() <= np.ceil(max(area, bound) - 1e-6) + 1e-9:
            break
        duals = inverse.sum(axis=0)
        for pull in (smoothing, 0.0) if bound else (0.0,):
            prices = np.maximum(pull * center + (1 - pull) * duals, 0.0)
            value, pattern = knapsack(prices, weight, capacity)
            if demand @ prices / value > bound:
                bound, center = float(demand @ prices / value), prices / value
            if duals @ pattern > 1 + 1e-7:
                break
        else:
            break
        step = inverse @ pattern
        ok = step > 1e-10
        if not ok.any():
            break
        ratio = np.where(ok, use / np.where(ok, step, 1.0), np.inf)
        out = int(ratio.argmin())
        columns[out] = pattern
        theta = ratio[out]
        use = np.maximum(use - theta * step, 0.0)
        use[out] = theta
        row = inverse[out] / step[out]
        inverse -= np.outer(step, row)
        inverse[out] = row
    else:
        warnings.warn(f"column generation stopped after {rounds} rounds while still improving", stacklevel=2)
    return [(columns[k], float(use[k])) for k in range(m) if use[k] > 0]


def round_patterns(plan: list[tuple[np.ndarray, float]], weight: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """Whole uses that cover every piece just once: uses are rounded down (never
    beyond what is left), and the few pieces left over, at most a handful a
    pattern, go first-fit into sequences, longest first."""
    left, out = demand.copy(), []
    for pattern, use in sorted(plan, key=lambda x: -x[1]):
        has = pattern > 0
        n = min(int(use + 1e-6), int((left[has] // pattern[has]).min()))
        if n > 0:
            out.append((pattern, n))
            left -= n * pattern
    for _ in range(2):  # what is left, by whole patterns while these still fit
        for pattern, _use in sorted(plan, key=lambda x: -float(x[0] @ weight)):
            has = pattern > 0
            n = int((left[has] // pattern[has]).min())
            if n > 0:
                out.append((pattern, n))
                left -= n * pattern
    while left.any():
        # A greedy pattern from the longest class left, as often as it fits.
        pattern, room = np.zeros(len(weight), np.int64), capacity
        for k in np.argsort(-weight, kind="stable"):
            n = min(int(left[k]), room // int(weight[k]))
            pattern[k], room = n, room - n * int(weight[k])
        has = pattern > 0
        n = int((left[has] // pattern[has]).min())
        out.append((pattern, n))
        left -= n * pattern
    return out


def slot_table(patterns: list[tuple[np.ndarray, int]], classes: list[int]) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (class, first rank, end rank, first sequence, copies, first slot): the
    pieces of a class, by rank, fill the slots of one pattern after another."""
    rows, rank, sequence = [], [0] * len(classes), 0
    for pattern, n in patterns:
        slot = 0
        for k in np.flatnonzero(pattern):
            a = int(pattern[k])
            rows.append((classes[k], rank[k], rank[k] + a * n, sequence, a, slot))
            rank[k] += a * n
            slot += a
        sequence += n
    return rows


# --- the distributed assignment ----------------------------------------------------


def ranked(pieces: DataFrame) -> DataFrame:
    """``pieces`` with ``rank``, the place (from 0) of each within its class by
    (doc_id, start). Rows are dealt by range, so a class that holds a third of
    them is spread over many tasks; each task numbers its own rows and learns
    its offset from a table of one row a task and class."""
    order = ["class", "doc_id", "start", "ids_crc32"]
    spark = pieces.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    dealt = pieces.repartitionByRange(n, *order).sortWithinPartitions(*order)
    at = F.monotonically_increasing_id()  # the task's number in the upper bits, the row's below, as of the sorted order
    dealt = materialize(dealt.withColumn("_at", at).withColumn("_task", F.shiftright("_at", 33)), "ranked")
    own = materialize(dealt.groupBy("class", "_task").agg(F.count(F.lit(1)).alias("n"), F.min("_at").alias("_first")), "tasks")
    offset = F.coalesce(F.sum("n").over(Window.partitionBy("class").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    table = broadcast_if_small(own.withColumn("_offset", offset).drop("n"), 500_000)
    return dealt.join(table, ["class", "_task"]).withColumn("rank", F.col("_at") - F.col("_first") + F.col("_offset")).drop("_at", "_task", "_first", "_offset")


def pack(
    docs: DataFrame,
    vocabulary: str = "byte_bpe_50k.json",
    length: int = 2_048,
    grain: int = 8,
    end: int = 1,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Documents are cut every ``length`` identifiers. The lengths, rounded up to
    ``grain``, make a histogram of ``length / grain`` classes; column generation
    over it finds patterns of classes that fill sequences, their uses are
    rounded, and ranked pieces take the slots. Only the histogram and the
    patterns, both bounded by the number of classes, reach the driver. A null or
    empty text is the end identifier alone; repeated rows are packed each; an
    empty table gives no piece; other columns are not read.
    """
    spark = docs.sparkSession
    pieces = cut_documents(docs, vocabulary, length, end, id_col, text_col).withColumn("class", F.ceil(F.col("length") / grain).cast("int"))
    pieces = materialize(pieces, "pieces")
    counted = pieces.groupBy("class").count().orderBy("class").collect()
    classes, demand = [r["class"] for r in counted], np.array([r["count"] for r in counted], np.int64)
    rows = []
    if classes:
        weight, capacity = np.array(classes, np.int64), length // grain
        plan = generate_patterns(weight, demand.astype(float), capacity)
        rows = slot_table(round_patterns(plan, weight, demand, capacity), classes)
    slots = F.broadcast(spark.createDataFrame(rows, "class int, _low long, _high long, _sequence long, _copies int, _slot int"))
    placed = (
        ranked(pieces)
        .join(slots, "class")
        .filter("rank >= _low and rank < _high")
        .withColumn("_nth", F.col("rank") - F.col("_low"))
        .withColumn("sequence_id", F.col("_sequence") + F.floor(F.col("_nth") / F.col("_copies")))
        .withColumn("_place", F.col("_slot") + F.pmod("_nth", F.col("_copies").cast("long")))
    )
    before = Window.partitionBy("sequence_id").orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("length").over(before), F.lit(0)).alias("offset")
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", offset)
