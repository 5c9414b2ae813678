"""Operator 12: phrase collocations, mined by pivot partitions."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geoloom.plans.materialize import materialize, ship_package

#: A-Z lower-cased, piece ends as line feeds; other bytes stay.
_FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0b\x0c\x0d", b"abcdefghijklmnopqrstuvwxyz" + b"\n" * 9)
#: Tokens encoded at a time, distinct entries of a task's counter, and the most slots of the word table and bits of the others.
TOKENS, ENTRIES, WORD_SLOTS, GRAM_BITS = 1 << 20, 1 << 19, 1 << 24, 1 << 27


def pieces(text: bytes) -> Iterator[list[bytes]]:
    """The words of each piece of a text."""
    for piece in text.translate(_FOLD).split(b"\n"):
        words = piece.split()  # of white space only blanks and tabs are left
        if words:
            yield words


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
    for batch in batches:
        langs = batch.column(0).to_pylist()
        for i in range(0, batch.num_rows, 64):
            for lang, text in zip(langs[i : i + 64], batch.column(1).slice(i, 64).cast(pa.binary()).to_pylist(), strict=True):
                if text:
                    yield lang, text


def _own(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, word, f) over docs(lang, text); tasks count before the shuffle."""
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = {}

        def told() -> Iterator[pa.RecordBatch]:
            for lang, own in counts.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(own)), pa.array(list(own), pa.binary()).cast(pa.string()), pa.array(list(own.values()), pa.int64())], names=["lang", "word", "f"])
            counts.clear()

        for lang, text in _texts(batches):
            own = counts.setdefault(lang, Counter())
            for words in pieces(text):
                own.update(words)
            if sum(map(len, counts.values())) > ENTRIES:
                yield from told()
        yield from told()

    return docs.mapInArrow(run, "lang string, word string, f long").groupBy("lang", "word").agg(F.sum("f").alias("f"))


def word_hash(lang: bytes, word: bytes) -> int:
    return xxhash.xxh64_intdigest(word, xxhash.xxh64_intdigest(lang) & 0xFFFFFFFF)


def pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of two words from their own hashes, in order."""
    x = a * np.uint64(0x9E3779B97F4A7C15) + (b ^ (b >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def slots(n: int, least: int, most: int) -> int:
    """A power of two of about 16 slots an entry, within bounds."""
    return min(most, max(least, 1 << (16 * max(1, n)).bit_length()))


def word_table(frequent: DataFrame, size: int) -> np.ndarray:
    """One byte a slot: 0 where no frequent word has its hash, else four times the
    binary logarithm of the most frequent one's count, plus one. ``size`` bounds
    what comes to the driver and is broadcast, whatever the number of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, word = (batch.column(i).cast(pa.binary()).to_pylist() for i in (0, 1))
            slot = np.array([word_hash(a, b) & (size - 1) for a, b in zip(lang, word, strict=True)], np.int64)
            level = (1 + np.floor(4 * np.log2(batch.column(2).to_numpy().astype(float)))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(level)], names=["slot", "level"])

    out = np.zeros(size, np.uint8)
    got = frequent.select("lang", "word", "f").mapInArrow(run, "slot long, level int").groupBy("slot").agg(F.max("level").alias("level")).toArrow()
    out[got.column("slot").to_numpy()] = got.column("level").to_numpy()
    return out


def bit_table(grams: DataFrame, size: int) -> np.ndarray:
    """A bit a slot, set where a frequent pair or triple of words may be; ``size`` bits bound it."""
    slot = F.col("h").bitwiseAND(F.lit(size - 1))
    bits = grams.groupBy(F.shiftright(slot, 5).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(h & 31 as int))")).alias("bits"))
    out = np.zeros(max(1, size >> 5), np.uint32)
    got = bits.toArrow()
    out[got.column("at").to_numpy()] = got.column("bits").to_numpy().astype(np.uint32)
    return out


class Encoder:
    """Words of a task as small numbers: 0 for ends of pieces and for words that are
    surely too rare. ``order`` is the same total order of words in every task, the
    more frequent ones first (by the word table, then by hash)."""

    def __init__(self, table: np.ndarray, most: int = 1 << 20):
        self.table, self.most = table, most
        self.clear()

    def clear(self) -> None:
        self.ids: dict[tuple, dict] = {}
        self.words, self.hashes, self.orders, self.crowds = [b""], [0], [(1 << 64) - 1], [0.0]

    def _new(self, lang: str, own: dict, word: bytes) -> int:
        h = word_hash(lang.encode(), word)
        level = int(self.table[h & (len(self.table) - 1)])
        at = 0
        if level:
            at = len(self.words)
            self.words.append(word)
            self.hashes.append(h)
            self.orders.append(((255 - level) << 56) | (h >> 8))
            self.crowds.append(2.0 ** (level / 4))  # at least the word's count
        own[word] = at
        return at

    def stretches(self, texts: Iterator[tuple[str, bytes]]) -> Iterator[tuple[str, np.ndarray | None]]:
        """(lang, numbers) of about a million tokens at a time; a piece is never cut in
        two. None in place of numbers: those given so far will mean other words from here on."""
        held: dict[str, list] = {}
        for lang, text in texts:
            out = held.setdefault(lang, [])
            own = self.ids.setdefault(lang, {})
            get = own.get
            for words in pieces(text):
                found = [get(w) for w in words]
                if None in found:
                    found = [self._new(lang, own, w) if (x := get(w)) is None else x for w in words]
                out += found
                out.append(0)
                if len(out) > TOKENS:
                    yield lang, np.array(out, np.int32)
                    out.clear()
            if sum(map(len, self.ids.values())) > self.most:  # numbers are forgotten only when none is held
                for k, x in held.items():
                    if x:
                        yield k, np.array(x, np.int32)
                yield "", None
                held.clear()
                self.clear()
        for k, x in held.items():
            if x:
                yield k, np.array(x, np.int32)


class Grams:
    """The pairs and triples of adjacent words of a stretch that may be frequent, by
    the word table (one byte a slot) and the pair and triple tables (bits)."""

    def __init__(self, ids: np.ndarray, hashes: np.ndarray, pairs: np.ndarray | None, triples: np.ndarray | None = None):
        h = hashes[ids]
        self.pair = pair_hash(h[:-1], h[1:])
        self.linked = (ids[:-1] > 0) & (ids[1:] > 0)
        if pairs is not None:
            self.linked &= _set(pairs, self.pair)
            self.triple = pair_hash(self.pair[:-1], h[2:])
            self.trebled = self.linked[:-1] & self.linked[1:]
        if triples is not None:
            self.trebled &= _set(triples, self.triple)


def _set(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    slot = h & np.uint64(32 * len(bits) - 1)
    return (bits[(slot >> np.uint64(5)).astype(np.int64)] >> (slot & np.uint64(31)).astype(np.uint32)) & 1 == 1


def gram_counts(docs: DataFrame, held) -> DataFrame:
    """(h, f): occurrences, by hash, of pairs of adjacent words that may be frequent,
    or of triples where the broadcast has a pair table; tasks count before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, pairs = held.value
        code, kept, n = Encoder(table), [], 0

        def told() -> pa.RecordBatch:
            h, at = np.unique(np.concatenate([x for x, _ in kept]), return_inverse=True)
            f = np.bincount(at, np.concatenate([x for _, x in kept]), len(h)).astype(np.int64)
            kept.clear()
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(f)], names=["h", "f"])

        for _, ids in code.stretches(_texts(batches)):
            if ids is None:
                continue
            own = Grams(ids, np.array(code.hashes, np.uint64), pairs)
            kept.append(np.unique(own.pair[own.linked] if pairs is None else own.triple[own.trebled], return_counts=True))
            n += len(kept[-1][0])
            if n > 4 * TOKENS:
                yield told()
                n = 0
        if kept:
            yield told()

    return docs.mapInArrow(run, "h long, f long").groupBy("h").agg(F.sum("f").alias("f"))


def reaches(ids: np.ndarray, order: np.ndarray, linked: np.ndarray, trebled: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """How far the fragment of each token reaches to the left, over words that come
    strictly before its own in the order, and to the right, over words that don't
    come after it. So an n-gram lies in the fragment of one of its tokens: the
    leftmost of its rarest word. ``linked[i]`` and ``trebled[i]``: the pair and the
    triple from i on may be frequent; a fragment ends where one is not."""
    n = len(ids)
    left, right = np.zeros(n, np.int8), np.zeros(n, np.int8)
    on = ids > 0
    ok_l, ok_r = on.copy(), on.copy()
    for d in range(1, most):
        ok_l[:d] = False
        ok_r[n - d :] = False
        if d < n:
            ok_l[d:] &= linked[: n - d] & (order[: n - d] < order[d:])
            ok_r[: n - d] &= linked[d - 1 : n - 1] & (order[d:] <= order[: n - d])
            if d > 1:
                ok_l[d:] &= trebled[: n - d]
                ok_r[: n - d] &= trebled[d - 2 : n - 2]
        left += ok_l
        right += ok_r
    return left, right


def fragments(docs: DataFrame, held, most: int, buckets: int, crowd: int) -> DataFrame:
    """(bucket, lang, whole, fragment, at, n): the rewritten texts around the words of
    a bucket of pivots, bundled: lists of fragments, of the pivot's place in each
    and of how often it occurs, counted in the task before the shuffle.

    A pivot lies in one bucket by its hash; one that may occur over ``crowd`` times
    by the word table, the same in every task, is dealt to several (not whole)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, pairs, triples = held.value
        code = Encoder(table)
        span, steps = 2 * most - 1, np.arange(-(most - 1), most)
        counts: dict[str, Counter] = {}

        def told(lang: str) -> Iterator[pa.RecordBatch]:
            items, words = iter(counts.pop(lang).items()), code.words
            while own := list(islice(items, 1 << 18)):
                found = np.frombuffer(b"".join(k for k, _ in own), np.int32).reshape(-1, span)
                pivot = found[:, most - 1]
                parts = 1 + (np.array(code.crowds)[pivot] / crowd).astype(np.uint64)
                h = np.array(code.hashes, np.uint64)[pivot]
                part = np.array([xxhash.xxh64_intdigest(k) for k, _ in own], np.uint64) % parts
                bucket = ((h ^ (h >> np.uint64(31))) + part) % np.uint64(buckets)
                for whole in (True, False):
                    rows = np.flatnonzero((parts == 1) == whole)
                    rows = rows[np.argsort(bucket[rows], kind="stable")]
                    if not len(rows):
                        continue
                    names, first = np.unique(bucket[rows], return_index=True)
                    ends = pa.array(np.append(first, len(rows)).astype(np.int32))
                    texts = [b" ".join([words[x] for x in r if x]) for r in found[rows].tolist()]
                    lists = (pa.array(texts, pa.binary()).cast(pa.string()), pa.array((found[rows, : most - 1] > 0).sum(axis=1).astype(np.int32)), pa.array([own[i][1] for i in rows.tolist()], pa.int64()))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(names.astype(np.int32)), pa.array([lang] * len(names)), pa.array([whole] * len(names)), *(pa.ListArray.from_arrays(ends, x) for x in lists)],
                        names=["bucket", "lang", "whole", "fragment", "at", "n"],
                    )

        for lang, ids in code.stretches(_texts(batches)):
            if ids is None:  # the numbers are about to be given anew
                for k in list(counts):
                    yield from told(k)
                continue
            own = Grams(ids, np.array(code.hashes, np.uint64), pairs, triples)
            left, right = reaches(ids, np.array(code.orders, np.uint64)[ids], own.linked, own.trebled, most)
            # Where the word before, the word itself and the one after are no frequent triple, no n-gram holds all three: two fragments.
            across = np.zeros(len(ids), bool)
            across[1:-1] = own.trebled
            padded, counted = np.pad(ids, most - 1), counts.setdefault(lang, Counter())
            for at, to_left, to_right in ((across & (left + right > 0), True, True), (~across & (left > 0), True, False), (~across & (right > 0), False, True)):
                at = np.flatnonzero(at)
                rows = padded[at[:, None] + (most - 1) + steps]
                rows[(steps < -left[at, None] * to_left) | (steps > right[at, None] * to_right)] = 0
                counted.update(np.ascontiguousarray(rows, np.int32).view(np.dtype((np.void, 4 * span))).ravel().tolist())
            if sum(map(len, counts.values())) > 2 * ENTRIES:
                for k in list(counts):
                    yield from told(k)
        for k in list(counts):
            yield from told(k)

    return docs.mapInArrow(run, "bucket int, lang string, whole boolean, fragment array<string>, at array<int>, n array<long>")


def owned(words: list[str], at: int, most: int) -> Iterator[str]:
    """The n-grams of a fragment that hold the word at ``at``, of two words up."""
    for a in range(max(0, at - most + 1), at + 1):
        for b in range(max(a + 2, at + 1), min(len(words), a + most) + 1):
            yield " ".join(words[a:b])


def mined(routed: DataFrame, most: int, least: int) -> DataFrame:
    """(lang, phrase, a) of the bundles of :func:`fragments` that come sorted by
    bucket: one bucket's n-grams are counted at a time. Those of whole pivots go on
    only if they are frequent; a count that grows too large goes on in parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, counts, cut = None, Counter(), False

        def told() -> Iterator[pa.RecordBatch]:
            items = iter(counts.items())
            while own := list(islice(((k, n) for k, n in items if cut or n >= least or not now[2]), 1 << 16)):
                yield pa.RecordBatch.from_arrays([pa.array([now[1]] * len(own)), pa.array([k for k, _ in own]), pa.array([n for _, n in own], pa.int64())], names=["lang", "phrase", "a"])
            counts.clear()

        for batch in batches:
            for row in range(batch.num_rows):
                bucket, lang, whole, texts, places, times = (c[row].as_py() for c in batch.columns)
                if now != (bucket, lang, whole):
                    if now:
                        yield from told()
                    now, cut = (bucket, lang, whole), False
                for fragment, at, n in zip(texts, places, times, strict=True):
                    for phrase in owned(fragment.split(" "), at, most):
                        counts[phrase] += n
                if len(counts) > 4 * ENTRIES:
                    cut = True
                    yield from told()
        if now:
            yield from told()

    return routed.select("bucket", "lang", "whole", "fragment", "at", "n").mapInArrow(run, "lang string, phrase string, a long")


def _counted_bits(docs: DataFrame, table: np.ndarray, pairs: np.ndarray | None, least: int) -> np.ndarray:
    """The pair table, or with it the triple table, by a pass over the texts."""
    held = docs.sparkSession.sparkContext.broadcast((table, pairs))
    grams = materialize(gram_counts(docs, held).filter(F.col("f") >= least).select("h"), "grams")
    held.destroy()
    return bit_table(grams, slots(grams.count(), 1 << 20, GRAM_BITS))


def frequent_phrases(docs: DataFrame, least: int = 100, most: int = 5, crowd: int = 10_000_000) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, a) of the phrases of 2 to ``most`` words that occur ``least``
    times or more in docs(lang, text), and (lang, word, f) of all words."""
    spark = docs.sparkSession
    words = materialize(word_counts(docs), "words")
    often = words.filter(F.col("f") >= least)
    n = often.count()
    table = word_table(often, slots(n, 1 << 16, WORD_SLOTS))
    pairs = _counted_bits(docs, table, None, least)
    triples = _counted_bits(docs, table, pairs, least)
    held = spark.sparkContext.broadcast((table, pairs, triples))
    tokens = words.agg(F.sum("f")).first()[0] or 0
    buckets = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), tokens >> 20)
    made = materialize(fragments(docs, held, most, buckets, crowd), "fragments")
    held.destroy()
    routed = made.repartition("bucket").sortWithinPartitions("bucket", "lang", "whole")
    phrases = mined(routed, most, least).groupBy("lang", "phrase").agg(F.sum("a").alias("a")).filter(F.col("a") >= least)
    return materialize(phrases, "phrases"), words


def collocations(docs: DataFrame, least: int = 100, most: int = 5, top: int = 2_000, crowd: int = 10_000_000, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's ``top`` collocations.

    Texts are lower-cased (A-Z), split at ``.,;:!?`` and line ends into pieces and
    those into words. Phrases of 2 to ``most`` words that occur ``least`` times
    or more within pieces are candidates. Cut after its first k words, a
    candidate scores floor(1000 * a * n / (l * r)) by the counts of itself, of
    its two parts and of all words of the language; its lowest score counts,
    that of the smallest k among equals. Candidates that lie inside a longer
    one that occurs as often are dropped.

    Every n-gram belongs to its rarest word, the pivot. Tasks rewrite the text
    around each word into the fragment of the words more frequent than it, cut
    where a word, a pair or a triple of words is too rare (an n-gram can't occur
    more often than what it holds), count equal fragments and send them to the
    pivot, where n-grams that hold it are counted; a crowded pivot is split.
    Which ones are too rare is told by tables of hashes of bounded size, each
    from a pass over the texts; a clash lets a word through and changes no count.

    A null language is ``und``, a null or empty text has no words, repeated
    rows count each, ties are ordered by a, then by the phrase's bytes. An
    empty table gives an empty one; other columns are not read.
    """
    found, words = frequent_phrases(_own(docs, text_col, lang_col), least, most, crowd)
    total = words.groupBy("lang").agg(F.sum("f").alias("n"))
    parts = materialize(found.unionByName(words.filter(F.col("f") >= least).select("lang", F.col("word").alias("phrase"), F.col("f").alias("a"))), "parts")
    split = F.split("phrase", " ")
    # Only the phrases one word longer need a look: what lies inside a longer one that occurs as often also lies inside such a one.
    inner = found.withColumn("w", split).filter(F.size("w") > 2)
    inside = inner.select("lang", "a", F.explode(F.array(*(F.array_join(F.slice("w", F.lit(at), F.size("w") - 1), " ") for at in (1, 2)))).alias("phrase"))
    inside = inside.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    left = found.join(inside, ["lang", "phrase"], "left").filter("longer is null or longer < a").select("lang", "phrase", "a")
    cuts = left.withColumn("w", split).withColumn("k", F.explode(F.sequence(F.lit(1), F.size("w") - 1)))
    cuts = cuts.select("lang", "phrase", "a", "k", F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("first"), F.array_join(F.slice("w", F.col("k") + 1, F.size("w") - F.col("k")), " ").alias("rest"))
    count = lambda of, to: parts.select("lang", F.col("phrase").alias(of), F.col("a").alias(to))
    cuts = cuts.join(count("first", "l"), ["lang", "first"]).join(count("rest", "r"), ["lang", "rest"]).join(F.broadcast(total), "lang")
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    score = F.call_function("div", F.lit(1000).cast("decimal(4,0)") * wide("a") * wide("n"), wide("l") * wide("r"))
    cuts = cuts.withColumn("score", score)
    best = cuts.groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.first("n").alias("n"), F.min(F.struct("score", "k", "l", "r")).alias("best"))
    scored = materialize(best.select("lang", "phrase", "a", F.col("best.l").alias("l"), F.col("best.r").alias("r"), "n", F.col("best.score").alias("score")), "scored")
    order = [F.desc("score"), F.desc("a"), "phrase"]
    # A language's first ones are among the first ones of each of its 64 hashed shares.
    share = Window.partitionBy("lang", "share").orderBy(*order)
    few = scored.withColumn("share", F.pmod(F.xxhash64("phrase"), F.lit(64))).withColumn("rank", F.row_number().over(share)).filter(F.col("rank") <= top)
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


#: DuckDB's form.
ORACLE = r"""
with doc as (
  select coalesce(lang, 'und') as lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents
), piece as (
  select lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) as p from doc
), sentence as (
  select lang, regexp_extract_all(p, '[^\x20\x09]+') as w from piece
), spot as (
  select lang, w, unnest(range(1, len(w) + 1)) as i from sentence
), gram as (
  select lang, k, array_to_string(w[i : i + k - 1], ' ') as phrase
  from spot, (select unnest([1, 2, 3, 4, 5]) as k) where i + k - 1 <= len(w)
), f as materialized (
  select lang, k, phrase, count(*) as a from gram group by all having count(*) >= 100
), n as (
  select lang, sum(len(w))::hugeint as n from sentence group by lang
), candidate as (
  select * from f where k >= 2
), inside as (
  select c.lang, array_to_string(string_split(c.phrase, ' ')[j : j + m - 1], ' ') as phrase, max(a) as longer
  from candidate c, (select unnest([1, 2, 3, 4]) as j) jj, (select unnest([2, 3, 4]) as m) mm
  where m < k and j + m - 1 <= k group by all
), cut as (
  select c.lang, c.phrase, c.a, n.n, l.a as l, r.a as r, x.k, (1000::hugeint * c.a * n.n) // (l.a::hugeint * r.a) as score
  from candidate c join (select unnest([1, 2, 3, 4]) as k) x on x.k < c.k
  join f l on l.lang = c.lang and l.phrase = array_to_string(string_split(c.phrase, ' ')[1 : x.k], ' ')
  join f r on r.lang = c.lang and r.phrase = array_to_string(string_split(c.phrase, ' ')[x.k + 1 : c.k], ' ')
  join n on n.lang = c.lang
  left join inside i on i.lang = c.lang and i.phrase = c.phrase
  where i.longer is null or 100 * i.longer < 100 * c.a
), best as (
  select * from cut qualify row_number() over (partition by lang, phrase order by score, k) = 1
)
select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase,
       a::bigint as a, l::bigint as l, r::bigint as r, n::bigint as n, score::bigint as score
from best qualify row_number() over (partition by lang order by score desc, a desc, phrase) <= 2000
"""
