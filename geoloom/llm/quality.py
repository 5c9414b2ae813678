"""Operator 1: quality rules by a hashed n-gram log-likelihood ratio (DataFrame functions only)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoloom.llm.common import hashed_share, hidden, place, shown

# Fixed values of the base rules.
_BLANKS = " \t\n\x0b\f\r"
_BLANK_RUN = "[\\x20\\x09-\\x0D]+"
_NO_SYMBOL = "[^#*$%&|<>]+"
WINDOW = 8


def words_of(text: Column) -> Column:
    """The words of a text, in order; none for a null or blank text."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(_BLANKS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, _BLANK_RUN))


def _joined(hashes: Column, other: Column, by: int) -> Column:
    """Element i hashed together with element i + by."""
    n = F.greatest(F.size(hashes) - by, F.lit(0))
    return F.zip_with(F.slice(hashes, 1, n), F.slice(other, by + 1, n), lambda a, b: F.xxhash64(a, b))


def with_measures(docs: DataFrame, text_col: str) -> DataFrame:
    """``docs`` with the columns _n_words, _word_chars, _n_symbols, _n_dup_lines, _n_repeat_words and _grams
    (the hashes of all single words and pairs of neighbours)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    df = docs.withColumn("_words", words_of(F.col(text_col)))
    df = df.withColumn("_h1", F.transform("_words", lambda w: F.xxhash64(w)))
    df = df.withColumn("_h2", _joined(F.col("_h1"), F.col("_h1"), 1))
    df = df.withColumn("_h4", _joined(F.col("_h2"), F.col("_h2"), 2))
    df = df.withColumn("_h8", _joined(F.col("_h4"), F.col("_h4"), 4))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(_BLANKS)) != "")
    df = df.withColumn("_lines", lines)

    # Windows whose hash occurs twice or more: neighbours after a sort by hash. Texts without any skip the work.
    twice = F.size(F.array_distinct("_h8")) < F.size("_h8")
    df = df.withColumn("_placed", F.when(twice, F.sort_array(F.transform("_h8", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    same = lambda x, j: F.coalesce(x["h"] == F.get("_placed", j)["h"], F.lit(False))
    df = df.withColumn("_at", F.filter("_placed", lambda x, j: same(x, j - 1) | same(x, j + 1)))
    df = df.withColumn("_at", F.sort_array(F.transform("_at", lambda x: x["i"])))
    fresh = F.transform("_at", lambda a, j: F.least(F.coalesce(F.get("_at", j + 1) - a, F.lit(WINDOW)), F.lit(WINDOW)))
    covered = F.aggregate(fresh, F.lit(0).cast("long"), lambda s, x: s + x)

    return df.select(
        *docs.columns,
        F.size("_words").cast("long").alias("_n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("_word_chars"),
        F.length(F.regexp_replace(text, _NO_SYMBOL, "")).cast("long").alias("_n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("_n_dup_lines"),
        F.coalesce(covered, F.lit(0).cast("long")).alias("_n_repeat_words"),
        F.concat("_h1", "_h2").alias("_grams"),
    )


def gram_weights(docs: DataFrame, labels: DataFrame, buckets: int, trusted: int, smooth: float, text_col: str) -> list[float]:
    """log p(bucket | trusted target) - log p(bucket | raw corpus), smoothed.

    The raw counts cover every document. The target is about ``trusted``
    documents labelled of quality 1 (chosen by their hashed ids; all, if there
    are no more), which bounds the broadcast list of ids. Only one count per bucket is collected.
    """
    good = labels.filter("quality = 1 and doc_id is not null").select("doc_id").distinct()
    good = hashed_share(good, "doc_id", trusted)
    own = hidden(docs).select(F.col(place(docs, "doc_id")).alias("doc_id"), F.col(place(docs, text_col)).alias("_text")).join(F.broadcast(good.withColumn("_trusted", F.lit(1))), "doc_id", "left").select("_trusted", "_text")
    h1 = own.withColumn("_h1", F.transform(words_of(F.col("_text")), lambda w: F.xxhash64(w)))
    grams = h1.select("_trusted", F.explode(F.concat("_h1", _joined(F.col("_h1"), F.col("_h1"), 1))).alias("_g"))
    rows = (
        grams.groupBy(F.pmod("_g", F.lit(buckets)).cast("int").alias("b")).agg(F.count(F.lit(1)).alias("raw"), F.coalesce(F.sum("_trusted"), F.lit(0)).alias("good")).collect()
    )
    raw, target = [0] * buckets, [0] * buckets
    for r in rows:
        raw[r["b"]], target[r["b"]] = r["raw"], r["good"]
    all_raw, all_target = sum(raw) + smooth * buckets, sum(target) + smooth * buckets
    return [round(math.log((t + smooth) / all_target) - math.log((r + smooth) / all_raw), 6) for t, r in zip(target, raw, strict=True)]


def judge_quality(
    docs: DataFrame,
    labels: DataFrame,
    buckets: int = 1 << 14,
    trusted: int = 50_000,
    threshold: float = -0.1,
    smooth: float = 1.0,
    text_col: str = "text",
) -> DataFrame:
    """Every row of ``docs`` with n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, score and kept appended, prefixed by ``_q_``; an
    input column of just such a name gives way, any other stays as it is.

    ``score`` is the log-likelihood ratio of the text's hashed words and word
    pairs between the trusted-target and the raw-corpus multinomials, divided
    by their number; ``kept`` means that the base rules pass and the score is at
    least ``threshold``. A null, empty or blank text has no words and fails the
    base rules; a very long one is judged whole. With no trusted documents all
    scores follow the raw corpus alone. Null ids do no harm; repeated rows count
    once each, repeated labels once; an empty table gives an empty one.
    Two narrow passes; the only shuffle holds ``buckets`` counters a task.
    """
    work = _judged(docs, labels, buckets, trusted, threshold, smooth, text_col)
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "kept")
    return shown(work, docs, **{f"_q_{c}": F.col(c) for c in names})


def keep_good(docs: DataFrame, labels: DataFrame, text_col: str = "text", **how) -> DataFrame:
    """The rows of ``docs`` that :func:`judge_quality` keeps, with their own columns, whatever those are called."""
    given = {"buckets": 1 << 14, "trusted": 50_000, "threshold": -0.1, "smooth": 1.0, **how}
    return shown(_judged(docs, labels, text_col=text_col, **given).filter("kept"), docs)


def _judged(docs: DataFrame, labels: DataFrame, buckets: int, trusted: int, threshold: float, smooth: float, text_col: str) -> DataFrame:
    """``hidden(docs)`` with the measures, the score and the verdict of each row."""
    weights = gram_weights(docs, labels, buckets, trusted, smooth, text_col)
    table = F.from_json(F.lit("[" + ",".join(map(repr, weights)) + "]"), "array<double>")
    total = F.aggregate("_grams", F.lit(0.0), lambda s, g: s + F.element_at(table, F.pmod(g, F.lit(buckets)).cast("int") + 1))
    work = hidden(docs)
    df = with_measures(work, place(docs, text_col))
    failed = (F.col("_n_words") < 20) | (100 * F.col("_n_repeat_words") > 30 * F.col("_n_words"))
    score = F.when(F.size("_grams") > 0, total / F.size("_grams")).otherwise(F.lit(0.0))
    df = df.select(
        *work.columns,
        *(F.col(f"_{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
        failed.alias("base_failed"),
        F.round(score, 6).alias("score"),
        F.spark_partition_id().alias("task"),
    )
    # Always true, but bound to the task, which keeps the optimizer from writing the nested expressions
    # above out into a filter on the verdict; written out they grow exponentially.
    here = F.col("task") >= 0
    return df.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold) & here)


def quality_digest(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """The contract's columns of :func:`judge_quality`, with the score."""
    df = judge_quality(docs.select("doc_id", "text"), labels, **how)
    return df.select("doc_id", *(F.col(f"_q_{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")))
