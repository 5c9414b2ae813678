"""Operator 12 against counting every n-gram by hand."""

from __future__ import annotations

import collections
import re

import numpy as np
import pytest


def told_phrases(rows, least, most, top):
    f, n = collections.defaultdict(collections.Counter), collections.Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, most + 1):
                f[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, own in f.items():
        candidates = {p: a for p, a in own.items() if len(p) > 1 and a >= least}
        dropped = {p[i : i + k] for p, a in candidates.items() for k in range(2, len(p)) for i in range(len(p) - k + 1) if a >= own[p[i : i + k]]}
        found = []
        for p, a in candidates.items():
            if p not in dropped:
                score, k = min((1000 * a * n[lang] // (own[p[:k]] * own[p[k:]]), k) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), own[p[:k]], own[p[k:]]))
        out += [(lang, r, p.decode(), -a, left, right, n[lang], -s) for r, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


def texts(rng, n, vocabulary=40):
    """Words by rank, repeated passages, and texts that try the splitting."""
    words = np.array(["the", "of", "Über", "日本", "x|y", "a b", "\x1cz", *(f"w{i}" for i in range(vocabulary))])
    share = 1 / np.arange(1, len(words) + 1)
    passages = [" ".join(rng.choice(words, rng.integers(3, 12))) for _ in range(6)]
    rows = []
    for i in range(n):
        parts = [str(rng.choice(passages)) if rng.random() < 0.3 else " ".join(rng.choice(words, rng.integers(1, 15), p=share / share.sum())) for _ in range(rng.integers(1, 6))]
        rows.append((i, str(rng.choice([". ", "\n", " ", "\t", "?!", "\r\n", " , "])).join(parts), [None, "en", "und", "de"][i % 4]))
    hard = [None, "", " \t\n", "the the the the the the", "THE the. the the", "of the of the of the of", "a" * 50_000, "w1 w2 " * 5_000]
    return rows + [(n + i, t, "en") for i, t in enumerate(hard)] + rows[:20]


@pytest.mark.parametrize(("least", "most", "top", "crowd"), [(2, 5, 2_000, 10_000_000), (10, 5, 30, 1), (5, 3, 7, 40), (1, 4, 50, 7)])
def test_phrases_equal_a_count_by_hand(spark, least, most, top, crowd):
    from geoloom.llm.phrases import collocations

    rows = texts(np.random.default_rng(least), 300)
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, lang string, n int, phrase string").repartition(3)
    got = collocations(df, least=least, most=most, top=top, crowd=crowd)
    assert sorted(tuple(r) for r in got.collect()) == told_phrases(rows, least, most, top)


def test_small_memory_and_crowded_tables_change_nothing(spark, monkeypatch):
    """Counters that overflow and tables in which all hashes clash."""
    from geoloom.llm import phrases

    rows = texts(np.random.default_rng(9), 200)
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    monkeypatch.setattr(phrases, "slots", lambda n, least, most: 64)
    got = phrases.collocations(df, least=3)
    assert sorted(tuple(r) for r in got.collect()) == told_phrases(rows, 3, 5, 2_000)


def test_the_encoder_forgets_only_between_stretches():
    from geoloom.llm.phrases import Encoder

    code = Encoder(np.full(64, 5, np.uint8), most=3)
    seen = []
    for lang, ids in code.stretches(iter([("en", b"a b c d. e a"), ("de", b"a f g"), ("en", b"a a")])):
        seen.append(None if ids is None else (lang, [code.words[i] for i in ids]))
    assert [x for x in seen if x] == [("en", [b"a", b"b", b"c", b"d", b"", b"e", b"a", b""]), ("de", [b"a", b"f", b"g", b""]), ("en", [b"a", b"a", b""])]


def test_scores_pass_64_bits(spark):
    from pyspark.sql import functions as F

    big = 9_000_000_000_000
    df = spark.createDataFrame([(big, 9 * big, big, big + 1)], "a long, n long, l long, r long")
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    got = df.select(F.call_function("div", F.lit(1000).cast("decimal(4,0)") * wide("a") * wide("n"), wide("l") * wide("r"))).first()[0]
    assert got == 1000 * big * 9 * big // (big * (big + 1))


def test_no_documents(spark):
    from geoloom.llm.phrases import collocations

    df = spark.createDataFrame([], "text string, lang string")
    assert collocations(df).collect() == []


def test_phrase_query_equals_its_sql(spark, duck, sf):
    from geoloom.llm import registry

    got, told = registry.QUERIES["op12_phrases"](spark, sf), duck.sql(registry.ORACLES["op12_phrases"])
    order = [told.columns.index(c) for c in got.columns]
    assert sorted(tuple(r) for r in got.collect()) == sorted(tuple(r[i] for i in order) for r in told.fetchall())
