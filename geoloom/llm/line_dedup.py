"""Operator 3: line deduplication by a segment-partition edit join (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoloom.llm.common import hidden, place, shown
from geoloom.operators.components import connected_components
from geoloom.plans.materialize import broadcast_if_small, materialize

_BLANKS = " \t\n\x0b\f\r"


def lines_of(docs: DataFrame, min_chars: int) -> DataFrame:
    """(doc_id, text_key, pos, line) of the lines, trimmed, with ``min_chars``
    characters or more; id and text_key, a hash of the whole text, name the row."""
    every = docs.filter("doc_id is not null").select("doc_id", F.xxhash64("text").alias("text_key"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return every.select("doc_id", "text_key", "pos", F.btrim("line", F.lit(_BLANKS)).alias("line")).filter(F.length("line") >= min_chars)


def _cut(length: Column, k: int, parts: int) -> Column:
    """Where segment ``k`` of an even partition of ``length`` characters starts (from 0)."""
    return F.call_function("div", length * k, F.lit(parts)).cast("int")


def segment_keys(wide: Column, length: Column, edits: int) -> tuple[list[Column], list[Column]]:
    """The hashed index keys of a line (its ``edits + 1`` segments) and its probe
    keys: for each partner length from its own down to ``edits`` less, and each
    segment of such a partner, the substrings where that segment can lie if the
    errors left and right of it number at most ``edits`` in all. Two lines
    within ``edits`` share an index key of the shorter and a probe key of the
    longer one. ``wide`` is the line in four bytes a character, so that a
    substring is cut out without counting characters."""
    parts = edits + 1

    def key(less: int, i: int, shift: int) -> Column:
        at, end = _cut(length - less, i, parts), _cut(length - less, i + 1, parts)
        return F.xxhash64(length - less, F.lit(i), F.substring(wide, (at + shift) * 4 + 1, (end - at) * 4))

    index = [key(0, i, 0) for i in range(parts)]
    probes = []
    for less in range(edits + 1):
        for i in range(parts):
            for shift in range(max(-i, less - (edits - i)), min(i, less + (edits - i)) + 1):
                probes.append(key(less, i, shift))
    return index, probes


#: Letters counted for the signature, five bits each, twelve an integer.
LETTERS = ("etnaoirshdlu", "cmfpgwybvkxj")


def signature(line: Column) -> Column:
    """The counts of the LETTERS, modulo 32, as a struct of two integers."""

    def packed(letters: str) -> Column:
        counts = [F.shiftleft((F.length(line) - F.length(F.replace(line, F.lit(c), F.lit("")))).cast("long").bitwiseAND(31), 5 * k) for k, c in enumerate(letters)]
        total = counts[0]
        for c in counts[1:]:
            total = total.bitwiseOR(c)
        return total

    return F.struct(*(packed(x).alias(f"s{i}") for i, x in enumerate(LETTERS)))


def may_be_near(a: Column, b: Column, edits: int) -> Column:
    """False only if the letter counts behind two signatures differ by more than
    ``edits`` edits can make them: an edit moves at most two counts by one, and
    the nearer way round modulo 32 never exceeds the true difference."""
    total = F.lit(0).cast("long")
    for i, letters in enumerate(LETTERS):
        for k in range(len(letters)):
            gap = F.abs(F.shiftright(a[f"s{i}"], 5 * k).bitwiseAND(31) - F.shiftright(b[f"s{i}"], 5 * k).bitwiseAND(31))
            total = total + F.least(gap, 32 - gap)
    return total <= 2 * edits


def banded_distance(long: Column, short: Column, edits: int) -> Column:
    """Edit distance of two arrays of characters, exact where it is ``edits`` or
    less (else some larger number); ``long`` is no shorter than ``short``.

    Bit-parallel over a band: bit b of the words at column j stands for row
    j - edits + b, so a word of 2 * edits + 1 bits slides down the diagonal and
    each column takes a fixed number of word operations: vertical differences
    of +1 (vp) and -1 (vn), the cells equal to their upper left neighbour (d0),
    horizontal differences (hp, hn).
    """
    width = 2 * edits + 1
    full = (1 << width) - 1
    more = F.size(long) - F.size(short)

    def match(c: Column, j: Column) -> Column:
        bits = [F.when(F.get(long, j - edits + b) == c, F.lit(1 << b)).otherwise(F.lit(0)) for b in range(width)]
        return sum(bits[1:], bits[0])

    def step(s: Column, x: Column) -> Column:
        vp, vn = s["vp"], s["vn"]
        d0 = (x.bitwiseAND(vp) + vp).bitwiseXOR(vp).bitwiseOR(x).bitwiseOR(vn).bitwiseAND(full)
        hp = vn.bitwiseOR(F.bitwise_not(d0.bitwiseOR(vp))).bitwiseAND(full)
        hn = d0.bitwiseAND(vp)
        down = F.shiftright(d0, 1)
        same = F.call_function("shiftright", d0, F.lit(edits) + more).bitwiseAND(1)
        return F.struct(
            hn.bitwiseOR(F.bitwise_not(down.bitwiseOR(hp))).bitwiseAND(full).alias("vp"),
            down.bitwiseAND(hp).alias("vn"),
            (s["d"] + 1 - same).alias("d"),
        )

    start = F.struct(F.lit(full ^ ((1 << edits) - 1)).alias("vp"), F.lit(0).alias("vn"), more.alias("d"))
    return F.aggregate(F.transform(short, match), start, step)["d"]


def edit_links(docs: DataFrame, edits: int, min_chars: int, crowd: int = 4) -> DataFrame:
    """(u, v): every pair of different lines within ``edits`` of each other, each once, by the lines' digests.

    Distinct lines are hashed to their keys before any shuffle, so a line that
    fills a third of the corpus counts once a task. The join on keys is an
    equi-join that adaptive execution splits where a key is frequent. Lines
    under a key with more than ``crowd`` lines carry their letter counts into
    the join's condition, so that lines of such a group which share a segment
    and differ elsewhere don't come out as pairs. Texts are read again for the
    candidates alone, and those that their letter counts allow are compared in
    full.
    """
    lines = lines_of(docs, min_chars).select("line", F.xxhash64("line").alias("h"))
    wide = lines.select("h", F.encode("line", "UTF-32").alias("wide")).select("h", "wide", F.shiftright(F.length("wide"), 2).alias("n"))
    index, probes = segment_keys(F.col("wide"), F.col("n"), edits)
    keyed = materialize(wide.select("h", F.array(*index, *probes).alias("keys")).distinct(), "keys")
    each = keyed.select("h", F.posexplode("keys").alias("slot", "key"))
    hot = materialize(each.filter(F.col("slot") < len(index)).groupBy("key").count().filter(F.col("count") > crowd).select("key"), "hot")
    crowded = each.join(broadcast_if_small(hot, 1_000_000), "key", "left_semi").select("h").distinct()
    sigs = lines.join(broadcast_if_small(materialize(crowded, "crowded"), 1_000_000), "h", "left_semi").select("h", signature(F.col("line")).alias("sig"))
    sigs = broadcast_if_small(materialize(sigs.distinct(), "sigs"), 1_000_000)
    signed = keyed.join(sigs, "h", "left").select("h", "sig", F.posexplode("keys").alias("slot", "key"))
    left = signed.filter(F.col("slot") < len(index)).select("key", F.col("h").alias("a"), F.col("sig").alias("sa"))
    right = signed.filter(F.col("slot") >= len(index)).select("key", F.col("h").alias("b"), F.col("sig").alias("sb"))
    fits = F.coalesce(may_be_near(F.col("sa"), F.col("sb"), edits), F.lit(True))
    found = left.join(right, (left["key"] == right["key"]) & (F.col("a") != F.col("b")) & fits)
    pairs = materialize(found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
    ends = broadcast_if_small(pairs.select(F.col("a").alias("h")).union(pairs.select("b")).distinct(), 1_000_000)
    own = lines.join(ends, "h", "left_semi").distinct()
    texts = materialize(own.select("h", F.unhex(F.md5("line")).alias("id"), "line", signature(F.col("line")).alias("sig")), "texts")
    a = texts.select(F.col("h").alias("a"), F.col("id").alias("u"), F.col("line").alias("lu"), F.col("sig").alias("sa"))
    b = texts.select(F.col("h").alias("b"), F.col("id").alias("v"), F.col("line").alias("lv"), F.col("sig").alias("sb"))
    first = F.length("lu") >= F.length("lv")
    chars = lambda line: F.regexp_extract_all(line, F.lit("(?s)."), F.lit(0))
    keep = may_be_near(F.col("sa"), F.col("sb"), edits) & (F.abs(F.length("lu") - F.length("lv")) <= edits)
    both = pairs.join(a, "a").join(b, (pairs["b"] == b["b"]) & keep)
    both = both.select("u", "v", chars(F.when(first, F.col("lu")).otherwise(F.col("lv"))).alias("cl"), chars(F.when(first, F.col("lv")).otherwise(F.col("lu"))).alias("cs"))
    # The task's number keeps the filter above the two arrays, which are then made once a pair.
    both = both.withColumn("_task", F.spark_partition_id())
    near = (banded_distance(F.col("cl"), F.col("cs"), edits) <= edits) & (F.col("_task") >= 0)
    return materialize(both.filter(near).select("u", "v").distinct(), "links")


def dedup_lines(docs: DataFrame, edits: int = 2, min_chars: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with later copies and near copies of lines removed from ``text``,
    and the columns _n_lines, _n_removed and _n_links appended.

    Lines of ``min_chars`` or more characters (blank ends trimmed) are linked at
    an edit distance of ``edits`` or less; linked lines form a class, and of
    each class the first occurrence, by id, then line number, stays. Shorter
    lines stay. ``_n_links`` sums, over a row's lines, the number of other
    different lines within the distance. Null and empty texts stay as they are
    (null has no line); rows with a null id are left alone. Every row is treated
    by its own text: of rows that repeat an id with other texts each keeps what
    is new in it, and of rows that repeat an id and its text one keeps its lines
    and the others lose those of ``min_chars`` or more. Other columns are carried
    along whatever their names, but one named like an appended column gives way
    to it. An empty table gives an empty one.
    """
    work = _deduped(docs, edits, min_chars, id_col, text_col)
    return shown(work, docs, _n_lines=F.col("n_lines"), _n_removed=F.col("n_removed"), _n_links=F.col("n_links"))


def drop_repeats(docs: DataFrame, edits: int = 2, min_chars: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` as :func:`dedup_lines` leaves them, without the rows of whose words
    nothing is left by that; with their own columns, whatever those are called."""
    work = _deduped(docs, edits, min_chars, id_col, text_col)
    return shown(work.filter((F.col("n_removed") == 0) | F.col(place(docs, text_col)).rlike(r"[^\x20\x09-\x0D]")), docs)


def _deduped(docs: DataFrame, edits: int, min_chars: int, id_col: str, text_col: str, few: int = 1_000_000) -> DataFrame:
    """``hidden(docs)`` with the new text in its place, n_lines, n_removed and n_links."""
    texts = hidden(docs).select(F.col(place(docs, id_col)).alias("doc_id"), F.col(place(docs, text_col)).alias("text"))
    narrow = materialize(lines_of(texts, min_chars).select("doc_id", "text_key", "pos", F.unhex(F.md5("line")).alias("id")), "lines")
    links = edit_links(texts, edits, min_chars)
    linked = links.select(F.col("u").alias("id")).union(links.select("v")).groupBy("id").agg(F.count(F.lit(1)).alias("n_links"))
    classes = connected_components(links).select(F.col("node").alias("id"), F.col("component").alias("class"))
    firsts = narrow.groupBy("id").agg(F.min(F.struct("doc_id", "pos", "text_key")).alias("first"), F.count(F.lit(1)).alias("n"))
    known = materialize(
        firsts.join(linked, "id", "left").join(classes, "id", "left").filter("n > 1 or n_links > 0").select("id", "first", F.coalesce("class", "id").alias("class"), F.coalesce("n_links", F.lit(0)).alias("n_links")),
        "known",
    )
    best = known.groupBy("class").agg(F.min("first").alias("best"))
    seen = narrow.join(known.join(best, "class").select("id", "best", "n_links"), "id")
    later = F.when(F.struct("doc_id", "pos", "text_key") != F.col("best"), F.col("pos"))
    per_row = seen.groupBy("doc_id", "text_key").agg(F.collect_set(later).alias("gone"), F.collect_set("pos").alias("every"), F.sum("n_links").alias("links"), F.count(F.lit(1)).alias("met"))
    copies = F.call_function("div", F.col("met"), F.size("every"))  # how many rows bear this id and text
    per_row = materialize(per_row.select("doc_id", "text_key", "gone", F.when(copies > 1, F.col("every")).alias("every"), F.call_function("div", "links", copies).alias("links"), copies.alias("copies")), "rows")

    work = hidden(docs).withColumn("row_id", F.col(place(docs, id_col))).withColumn("row_key", F.xxhash64(place(docs, text_col)))
    # Only rows that lose a line, repeat or have links need to meet their texts. Up to ``few`` of them, with up to four
    # times as many line numbers, are broadcast, so that no text is shuffled.
    touched = materialize(per_row.filter("size(gone) > 0 or copies > 1 or links > 0"), "touched")
    match = (F.col("row_id") == F.col("doc_id")) & (F.col("row_key") == F.col("text_key"))
    n, numbers = touched.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("gone") + F.coalesce(F.size("every"), F.lit(0))), F.lit(0))).first()
    if n <= few and numbers <= 4 * few:
        joined = work.join(F.broadcast(touched), match, "left")
    else:
        joined = work.join(touched, match, "left")
    if not per_row.filter("copies > 1").isEmpty():
        again = materialize(joined.filter("copies > 1").withColumn("nth", F.monotonically_increasing_id()), "again")
        one = again.groupBy(F.col("doc_id").alias("one_id"), F.col("text_key").alias("one_key")).agg(F.min("nth").alias("one"))
        again = again.join(one, (F.col("doc_id") == F.col("one_id")) & (F.col("text_key") == F.col("one_key")))
        again = again.withColumn("gone", F.when(F.col("nth") == F.col("one"), F.col("gone")).otherwise(F.col("every"))).select(*joined.columns)
        joined = joined.filter("copies is null or copies = 1").unionByName(again)
    text = F.col(place(docs, text_col))
    # Generated as a column, so that the text is split once and not for every line that stays.
    joined = joined.withColumn("parts", F.explode(F.array(F.when(F.size("gone") > 0, F.split(text, "\n")))))
    left = F.array_except(F.sequence(F.lit(0), F.size("parts") - 1), "gone")
    kept = F.when(F.col("parts").isNotNull(), F.array_join(F.transform(left, lambda i: F.get("parts", i)), "\n")).otherwise(text)
    breaks = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1
    joined = joined.withColumn("kept_text", kept).withColumn("n_parts", F.coalesce(breaks, F.lit(0)))
    count = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    joined = joined.withColumns({place(docs, text_col): F.col("kept_text"), "n_lines": count("n_parts"), "n_removed": count(F.size("gone")), "n_links": count("links")})
    return joined


def line_digest(docs: DataFrame, **how) -> DataFrame:
    """Per document: doc_id, n_lines, n_removed, n_links, n_chars and SHA-256 of the text that is left (null text: null)."""
    df = dedup_lines(docs.select("doc_id", "text"), **how)
    return df.select(
        "doc_id",
        F.col("_n_lines").alias("n_lines"),
        F.col("_n_removed").alias("n_removed"),
        F.col("_n_links").alias("n_links"),
        F.length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"),
    )
