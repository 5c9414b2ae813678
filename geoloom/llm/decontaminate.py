"""Operator 9: benchmark decontamination by BM25 with block-max WAND."""

from __future__ import annotations

import math
import string
import uuid
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.llm.common import ROWS, hidden, map_rows, place, shown
from geoloom.plans.materialize import broadcast_if_small, materialize, ship_package

# BM25 parameters, items of a block at least, blocks at most, and blocks of a coarse block.
K1, B, BLOCK, MOST_BLOCKS, COARSE = 1.2, 0.75, 2, 128, 4

# Signs that don't belong to a word when they stand at its ends.
_SIGNS = string.punctuation + "“”„‘’«»‹›¿¡…–—·"


def term(word: str) -> str:
    """A word as the index knows it: lower case, no signs at its ends."""
    return word.lower().strip(_SIGNS)


def split_item(words: list[str]) -> tuple[list[str], list[str]]:
    """Question and answer of a test item: the answer is its last sentence, or
    the last third of the words where there is only one."""
    cut = max((i + 1 for i, w in enumerate(words[:-1]) if w[-1:] in ".?!:"), default=0) or len(words) - max(1, len(words) // 3)
    return words[:cut], words[cut:]


class Index:
    """An inverted index of test items whose impacts are BM25 term scores over
    the item's own total, so that a passage holding all of an item scores 1.

    Items lie in blocks of consecutive numbers; ``most[t, b]`` is the largest
    impact of term t within block b, ``coarse[t, c]`` that within COARSE blocks.
    """

    def __init__(self, items: list[tuple[int, str]], n: int | None = None, mean: float | None = None, longest: int | None = None, df: dict[str, int] | None = None):
        """``n``, ``mean`` length, ``longest`` and document counts ``df`` are those of the
        whole benchmark, where the items are but a part of it."""
        self.ids = [i for i, _ in items]
        words = [text.split() for _, text in items]
        terms = [[t for t in map(term, w) if t] for w in words]
        self.number = {t: k for k, t in enumerate(sorted({t for x in terms for t in x}))}
        self.longest = longest or max((len(w) for w in words), default=1)
        n, mean = n or len(items), mean or sum(map(len, terms)) / max(1, len(items)) or 1.0
        df = df or Counter(t for x in terms for t in set(x))
        self.size = max(BLOCK, -(-len(items) // MOST_BLOCKS))
        self.postings: list[list[tuple[int, float]]] = [[] for _ in self.number]
        self.most = np.zeros((len(self.number) + 1, max(1, -(-len(items) // self.size))), np.float32)
        self.parts: list[tuple[set, set]] = []
        for k, (w, x) in enumerate(zip(words, terms, strict=True)):
            own = {
                t: math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * f * (K1 + 1) / (f + K1 * (1 - B + B * len(x) / mean)) for t, f in Counter(x).items()
            }
            total = sum(own.values()) or 1.0
            for t in sorted(own):
                v = own[t] / total
                self.postings[self.number[t]].append((k, v))
                at = (self.number[t], k // self.size)
                self.most[at] = max(self.most[at], v)
            question, answer = split_item(w)
            self.parts.append((self.grams(question), self.grams(answer)))
        self.coarse = np.maximum.reduceat(self.most, np.arange(0, self.most.shape[1], COARSE), axis=1)

    def numbers(self, text: str) -> np.ndarray:
        """The term number of each word; one past the last for a word of no item."""
        get, none, signs = self.number.get, len(self.number), _SIGNS
        own = [get(w.strip(signs), none) for w in text.lower().split()]
        return np.array(own, np.int32)

    def grams(self, words: list[str]) -> set[tuple[int, ...]]:
        """Runs of three words (fewer: the whole), as term numbers."""
        own = [self.number.get(term(w), -1) for w in words]
        n = min(3, len(own))
        return {tuple(own[i : i + n]) for i in range(len(own) - n + 1)} if n else set()

    def search(self, terms: list[int], block: int, least: float) -> list[tuple[int, float]]:
        """Items of one block that score ``least`` or more for the query terms.

        WAND: cursors in order of their current item; the pivot is the first
        at which the summed block maxima reach the bound; items before it can't
        and are skipped, the pivot is scored in full."""
        low, high = block * self.size, (block + 1) * self.size
        lists = []
        for t in terms:
            listed = self.postings[t]
            own = listed[bisect_left(listed, (low,)) : bisect_left(listed, (high,))]
            if own:
                lists.append([own, 0, float(self.most[t, block])])
        out = []
        while lists:
            lists.sort(key=lambda x: x[0][x[1]][0])
            bound, pivot = 0.0, None
            for own, at, most in lists:
                bound += most
                if bound >= least - 1e-6:
                    pivot = own[at][0]
                    break
            if pivot is None:
                break
            if lists[0][0][lists[0][1]][0] == pivot:
                score = sum(own[at][1] for own, at, _ in lists if own[at][0] == pivot)
                if score >= least:
                    out.append((pivot, score))
                pivot += 1
            for x in lists:
                while x[1] < len(x[0]) and x[0][x[1]][0] < pivot:
                    x[1] += 1
            lists = [x for x in lists if x[1] < len(x[0])]
        return out


def leaks(index: Index, texts: list[str], least: float, overlap: float) -> list[dict[int, float]]:
    """For each text: the items found in it and their best scores.

    Every passage is queried: two neighbouring stretches as long as the longest
    item, so that each place where an item can lie is inside one passage. The
    block maxima of all passages are summed at once; blocks that can't reach
    ``least`` are skipped, the rest searched by WAND, and hits verified by the
    shares of the question's and the answer's word triples that the passage holds.
    """
    found: list[dict[int, float]] = [{} for _ in texts]
    span, none = index.longest, len(index.number)
    own = [index.numbers(t) for t in texts]
    first = np.cumsum([0] + [max(1, -(-len(x) // span) - 1) for x in own])
    wins, nums = [], []
    for k, x in enumerate(own):
        at = np.flatnonzero(x != none)
        chunk, last = at // span, first[k + 1] - first[k] - 1
        for back in (0, 1):
            w = chunk - back
            ok = (w >= 0) & (w <= last)
            wins.append(first[k] + w[ok])
            nums.append(x[at[ok]])
    win, num = np.concatenate(wins or [[]]).astype(np.int64), np.concatenate(nums or [[]]).astype(np.int64)
    if not len(win):
        return found
    key = np.unique(win * (none + 1) + num)
    win, num = key // (none + 1), key % (none + 1)
    start = np.flatnonzero(np.r_[True, win[1:] != win[:-1]])
    sizes = np.diff(np.r_[start, len(win)])
    live = (np.add.reduceat(index.coarse[num], start, axis=0) >= least - 1e-4).any(axis=1)
    if not live.any():
        return found
    held_by = np.repeat(live, sizes)
    win, num, sizes = win[held_by], num[held_by], sizes[live]
    start = np.r_[0, np.cumsum(sizes)[:-1]]
    stop = start + sizes
    bound = np.add.reduceat(index.most[num], start, axis=0)
    for p, block in zip(*np.nonzero(bound >= least - 1e-4), strict=True):
        w = int(win[start[p]])
        hits = index.search(num[start[p] : stop[p]].tolist(), int(block), least)
        if not hits:
            continue
        k = int(np.searchsorted(first, w, side="right")) - 1
        at = (w - int(first[k])) * span
        passage = own[k][at : at + 2 * span].tolist()
        held: dict[int, set] = {}
        for item, score in hits:
            shares = []
            for part in index.parts[item]:
                n = len(next(iter(part), ()))
                if n and n not in held:
                    held[n] = {tuple(passage[i : i + n]) for i in range(len(passage) - n + 1)}
                shares.append(len(part & held[n]) / len(part) if n else 1.0)
            if min(shares) >= overlap:
                found[k][item] = max(score, found[k].get(item, 0.0))
    return found


def _items(benchmark: DataFrame) -> DataFrame:
    return benchmark.select("item_id", "text").filter("item_id is not null and text is not null").distinct()


_INDEXES: dict[str, Index] = {}


def _index(key: str, held: tuple) -> Index:
    """The index of some items, built once per worker process. Passes follow each
    other, so one is kept at a time."""
    if key not in _INDEXES:
        _INDEXES.clear()
        _INDEXES[key] = Index(*held)
    return _INDEXES[key]


def _passes(items: DataFrame, max_items: int) -> Iterator[tuple[str, Broadcast]]:
    """Broadcasts of at most about ``max_items`` items each that together hold all
    of them, each with the statistics of the whole benchmark."""
    spark = items.sparkSession
    count = items.count()
    rounds = max(1, -(-count // max_items))

    def terms_of(ids: list, texts: list) -> dict:
        made = [text.split() for text in texts]
        return {"item_id": ids, "text": texts, "terms": [[t for t in map(term, w) if t] for w in made], "n_words": [len(w) for w in made]}

    split = map_rows(items, ["item_id", "text"], terms_of, "item_id long, text string, terms array<string>, n_words long").filter("n_words > 0")
    if rounds == 1:  # the index counts for itself
        rows = [(r["item_id"], r["text"]) for r in split.orderBy("item_id", "text").collect()]
        yield uuid.uuid4().hex, spark.sparkContext.broadcast((rows,))
        return
    split = materialize(split.withColumn("part", F.pmod(F.xxhash64("item_id", "text"), F.lit(rounds))), "items")
    whole = split.agg(F.count(F.lit(1)).alias("n"), F.avg(F.size("terms")).alias("mean"), F.max("n_words").alias("longest")).first()
    own = split.select("part", F.explode(F.array_distinct("terms")).alias("term"))
    df = materialize(own.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.collect_set("part").alias("parts")), "terms")
    for i in range(rounds):
        rows = [(r["item_id"], r["text"]) for r in split.filter(F.col("part") == i).select("item_id", "text").orderBy("item_id", "text").collect()]
        counts = {r["term"]: r["df"] for r in df.filter(F.array_contains("parts", F.lit(i).cast("long"))).select("term", "df").collect()}
        yield uuid.uuid4().hex, spark.sparkContext.broadcast((rows, whole["n"], whole["mean"], whole["longest"], counts))


def _searcher(key: str, held: Broadcast, least: float, overlap: float) -> Callable:
    """A pandas UDF: the items found in each text, and the best score."""

    def search(texts: pd.Series) -> pd.DataFrame:
        index = _index(key, held.value)
        items, scores = [], []
        for at in range(0, len(texts), ROWS):
            for x in leaks(index, [t or "" for t in texts.iloc[at : at + ROWS]], least, overlap):
                items.append(sorted({index.ids[k] for k in x}))
                scores.append(round(max(x.values()), 6) if x else None)
        return pd.DataFrame({"items": pd.Series(items, dtype=object), "score": pd.Series(scores, dtype="float64")})

    return F.pandas_udf(search, "items array<bigint>, score double")


def _searched(docs: DataFrame, benchmark: DataFrame, least: float, overlap: float, max_items: int, text_col: str) -> DataFrame:
    """``hidden(docs)`` with leak_items and leak_score.

    One pass adds them in place. Of more, each is a job of its own, so that a
    worker holds one index at a time: it writes the few texts in which it finds
    something, by their digests, and these are joined to the rows in the end."""
    work, text = hidden(docs), F.col(place(docs, text_col))
    ship_package(docs.sparkSession)
    parts = list(_passes(_items(benchmark), max_items))
    if len(parts) == 1:
        work = work.withColumn("found", _searcher(*parts[0], least, overlap)(text))
        return work.withColumns({"leak_items": F.coalesce("found.items", F.array().cast("array<bigint>")), "leak_score": F.col("found.score")}).drop("found")
    hits = None
    for key, held in parts:
        one = work.select(text.alias("text")).withColumn("found", _searcher(key, held, least, overlap)(F.col("text")))
        one = materialize(one.filter(F.size("found.items") > 0).select(F.md5("text").alias("digest"), "found.items", "found.score").distinct(), "hits")
        hits = one if hits is None else hits.unionByName(one)
        held.unpersist()
    found = hits.groupBy("digest").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("leak_items"), F.max("score").alias("leak_score"))
    joined = work.join(broadcast_if_small(materialize(found, "found"), 100_000), F.md5(text) == F.col("digest"), "left").drop("digest")
    return joined.withColumn("leak_items", F.coalesce("leak_items", F.array().cast("array<bigint>")))


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    least: float = 0.6,
    overlap: float = 0.5,
    max_items: int = 20_000,
    text_col: str = "text",
) -> DataFrame:
    """The rows of ``docs`` with _leak_items (item ids, ascending) and
    _leak_score (the best; null without one) appended.

    Every passage of every text is a query against a BM25 index of the test
    items; all items scoring ``least`` or more are retrieved by block-max WAND
    and verified by their question and answer. The index is broadcast: it holds
    about ``max_items`` items, and a larger benchmark is worked through in as
    many passes, all by the statistics of the whole. Null and wordless texts and
    items find nothing; very long texts are searched whole; repeated items count
    once by id and text; each row is judged by its own text, so null or repeated
    ids do no harm. An input column named like an appended one gives way to it,
    any other stays; an empty table or benchmark gives no find. Narrow passes:
    no shuffle of texts.
    """
    work = _searched(docs, benchmark, least, overlap, max_items, text_col)
    return shown(work, docs, _leak_items=F.col("leak_items"), _leak_score=F.col("leak_score"))


def leak_digest(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """Per document: doc_id, contaminated, n_items, items (ids, comma-joined), score."""
    df = find_leaks(docs.select("doc_id", "text"), benchmark, **how)
    n = F.size("_leak_items").cast("long")
    return df.select("doc_id", (n > 0).alias("contaminated"), n.alias("n_items"), F.array_join("_leak_items", ",").alias("items"), F.col("_leak_score").alias("score"))


def drop_leaks(docs: DataFrame, benchmark: DataFrame, least: float = 0.6, overlap: float = 0.5, max_items: int = 20_000, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` in which no test item was found, with their own columns, whatever those are called."""
    return shown(_searched(docs, benchmark, least, overlap, max_items, text_col).filter(F.size("leak_items") == 0), docs)
