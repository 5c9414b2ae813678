"""Repeated ids, repeated rows, clashing column names and long texts for the operators on rows."""

from __future__ import annotations

import collections

import numpy as np
import pytest

# Names used inside the operators, and the names of their appended columns.
CLASHES = "in0 in1 _words _h1 _h2 _h4 _h8 _lines _placed _at _grams kept score task n_words base_failed row_id row_key text_key gone links copies every nth kept_text n_parts n_lines n_removed found new leak_items leak_score digest kept_id _kept _new _n_lines _q_kept _leak_items line pos h"


def frame(spark, rows):
    """rows(doc_id, text) with a column for each clashing name."""
    names = CLASHES.split()
    return spark.createDataFrame([(*r, *(["x"] * len(names))) for r in rows], "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names))


LINE = ["A first line that is certainly long enough.", "Another, wholly different, that has its length as well.", "Third of the lines, and no kin to any of the others."]


def test_lines_of_repeated_ids_and_rows_are_not_lost(spark):
    from geoloom.llm.line_dedup import dedup_lines, drop_repeats

    a, b, c = LINE
    rows = [(1, f"{a}\n{b}"), (1, f"{c}\n{a}"), (2, f"{b}\nshort"), (2, f"{b}\nshort"), (3, f"{c}\nown"), (None, a), (4, None), (5, ""), (6, "z" * 3_000_000 + "\n" + a)]
    df = frame(spark, rows)
    got = collections.Counter((r["doc_id"], r["text"] if r["doc_id"] != 6 else len(r["text"])) for r in dedup_lines(df).collect())
    # Ties: at (1, line 0) stand a and c, each new; b's first place is (1, line 1), where a comes again.
    assert got == collections.Counter([(1, f"{a}\n{b}"), (1, c), (2, "short"), (2, "short"), (3, "own"), (None, a), (4, None), (5, ""), (6, 3_000_000)])
    out = drop_repeats(df)
    assert out.columns == df.columns and out.count() == len(rows) and {r["_n_lines"] for r in out.collect()} == {"x"}


def test_exact_repeats_of_a_row_keep_one_set_of_lines(spark):
    from geoloom.llm.line_dedup import dedup_lines

    a, b, _ = LINE
    got = sorted((r["doc_id"], r["text"], r["_n_removed"], r["_n_links"]) for r in dedup_lines(frame(spark, [(7, f"{a}\n{b}\nend")] * 3)).collect())
    assert got == [(7, f"{a}\n{b}\nend", 0, 0), (7, "end", 2, 0), (7, "end", 2, 0)]
    near = f"{a}\n{a}!"
    got = {(r["text"], r["_n_links"]) for r in dedup_lines(frame(spark, [(7, near)] * 2)).collect()}
    assert got == {(a, 2), ("", 2)}


def test_filters_keep_columns_whatever_their_names(spark):
    from geoloom.llm.decontaminate import drop_leaks, find_leaks
    from geoloom.llm.quality import judge_quality, keep_good
    from geoloom.llm.simhash import keep_first, simhash_groups

    prose = " ".join(f"word{i}" for i in range(40))
    item = "Which river runs by the old town of the two bridges? It is the slow and muddy river of the north."
    df = frame(spark, [(1, prose), (2, prose), (3, f"{prose} {item} and more"), (4, None), (None, "")])
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    bench = spark.createDataFrame([(9, item), (9, item), (None, "x"), (8, None)], "item_id long, text string")
    inside = lambda out: {r[c] for r in out.collect() for c in df.columns[2:]} == {"x"}
    good = keep_good(df, labels, threshold=-99.0)
    assert good.columns == df.columns and sorted(r["doc_id"] for r in good.collect()) == [1, 2, 3] and inside(good)
    judged = judge_quality(df, labels)
    assert {r["_words"] for r in judged.collect()} == {"x"} and {r["_q_kept"] for r in judged.collect()} <= {True, False}
    clean = drop_leaks(df, bench)
    assert clean.columns == df.columns and collections.Counter(r["doc_id"] for r in clean.collect()) == collections.Counter([1, 2, 4, None]) and inside(clean)
    assert {r["doc_id"]: r["_leak_items"] for r in find_leaks(df, bench).collect()}[3] == [9]
    once = keep_first(df, simhash_groups(df))
    assert once.columns == df.columns and collections.Counter(r["doc_id"] for r in once.collect()) == collections.Counter([1, 3, 4, None]) and inside(once)


@pytest.mark.parametrize("name", ["op1_quality", "op2_secret_scan", "op6_token_counts", "op7_packing", "op8_pii_scan", "op9_decontaminate"])
def test_repeated_ids_and_long_texts(spark, name):
    from geoloom.llm.decontaminate import leak_digest
    from geoloom.llm.packing import pack
    from geoloom.llm.pii_scan import pii_digest
    from geoloom.llm.quality import quality_digest
    from geoloom.llm.secret_scan import secret_digest
    from geoloom.llm.token_counts import count_tokens

    long = "Some words and a@b.org 10.1.2.3 again. " * 60_000
    df = frame(spark, [(1, "one text"), (1, "one text"), (1, "another text of that id"), (2, long), (3, None)])
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    bench = spark.createDataFrame([(1, "Again some words? And a.")], "item_id long, text string")
    run = {
        "op1_quality": lambda d: quality_digest(d, labels), "op2_secret_scan": secret_digest, "op6_token_counts": count_tokens,
        "op7_packing": pack, "op8_pii_scan": pii_digest, "op9_decontaminate": lambda d: leak_digest(d, bench),
    }[name]
    rows = [r.asDict() for r in run(df).collect()]
    n = collections.Counter(r["doc_id"] for r in rows)
    assert (n[1], n[3]) == (3, 1)
    if name == "op1_quality":
        assert {r["n_words"] for r in rows if r["doc_id"] == 2} == {6 * 60_000}
    if name == "op6_token_counts":
        assert {r["n_bytes"] for r in rows if r["doc_id"] == 2} == {len(long)}
    if name == "op7_packing":
        assert sum(r["length"] for r in rows if r["doc_id"] == 2) == next(r["doc_tokens"] for r in rows if r["doc_id"] == 2)
    if name == "op8_pii_scan":
        assert {(r["n_email"], r["n_ip"]) for r in rows if r["doc_id"] == 2} == {(60_000, 60_000)}


def test_many_passes_of_a_benchmark_give_the_result_of_one(spark):
    import random

    from geoloom.llm.decontaminate import find_leaks

    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(300)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randrange(8, 25))) + ". " + " ".join(rng.choices(vocabulary, k=6))) for i in range(60)]
    texts = []
    for i in range(80):
        words = rng.choices(vocabulary, k=120)
        if i % 2:  # items of which some words are exchanged: scores all about the bound
            own = rng.choice(items)[1].split()
            words[30:30] = [w if rng.random() < 0.8 else rng.choice(vocabulary) for w in own]
        texts.append((i, " ".join(words)))
    docs, bench = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    whole = {r["doc_id"]: (r["_leak_items"], r["_leak_score"]) for r in find_leaks(docs, bench, overlap=0.2).collect()}
    three = find_leaks(docs, bench, overlap=0.2, max_items=20)
    assert {r["doc_id"]: (r["_leak_items"], r["_leak_score"]) for r in three.collect()} == whole and sum(bool(v[0]) for v in whole.values()) > 10
    plan = three._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in plan  # each pass has been a job of its own


def test_tiles_far_apart_in_population_are_skipped_and_no_link_is_lost(spark):
    from geoloom.llm.simhash import group_links, spare_blocks, tile_links
    from geoloom.operators.components import connected_components

    rng = np.random.default_rng(7)
    thin = [sum(1 << int(b) for b in rng.choice(62, 8, replace=False)) for _ in range(700)]
    thick = [sum(1 << int(b) for b in rng.choice(62, 50, replace=False)) for _ in range(700)]
    near = [x ^ (1 << int(rng.integers(62))) ^ (1 << int(rng.integers(62))) for x in thin[:100] + thick[:100]]
    fps = sorted({*thin, *thick, *near})
    own = np.array(fps, np.uint64)
    own = own[np.argsort(np.bitwise_count(own), kind="stable")]
    hit, skipped = tile_links(own, 4)
    assert skipped > 0 and (hit == (np.bitwise_count(own[:, None] ^ own[None, :]) <= 4)).all()
    df = spark.createDataFrame(list(zip(map(int, own), range(len(own)))), "fp long, rep long")
    root = list(range(len(own)))
    for i, j in zip(*np.nonzero(np.triu(hit, 1))):
        if root[i] != root[j]:
            low, high = sorted((root[i], root[j]))
            root = [low if r == high else r for r in root]
    for how in ({}, {"group": 128}, {"spare": 1, "group": 64}, {"spare": 2}):
        got = {r["node"]: r["component"] for r in connected_components(group_links(df, 4, **how)).collect()}
        assert {i: got.get(i, i) for i in range(len(own))} == dict(enumerate(root)), how
    assert [spare_blocks(n, 4, 1024) for n in (10, 16_384, 16_385, 10**7, 10**10)] == [0, 0, 1, 2, 3]


def test_cells_of_a_crowded_key_meet_only_within_the_radius(spark):
    from pyspark.sql import functions as F

    from geoloom.llm.simhash import dealt_tiles

    fps = [((1 << k) - 1) ^ (i << 40) for k in (4, 6, 30, 36) for i in range(40)]
    df = spark.createDataFrame([(f, i) for i, f in enumerate(fps)], "fp long, rep long").withColumns({"mask": F.lit(0), "bits": F.lit(0).cast("long")})
    rows = dealt_tiles(df, 4, 32).collect()
    met = {(f, g) for r in rows for f in r["fps"] for g in r["fps"]}
    want = {(f, g) for f in fps for g in fps if abs(f.bit_count() - g.bit_count()) <= 4}
    cells = max(r["b"] for r in rows) + 1
    assert want <= met and len(rows) < cells * (cells + 1) / 2


def test_windows_of_one_long_piece_take_linear_time():
    import time

    from geoloom.llm.secret_scan import dense_windows, encoder, random_spans

    began = time.monotonic()
    for lengths in ([4, 1, 2, 1] * 500_000, [1, 3] * 500_000, [1] * 1_000_000 + [9] * 1_000):
        windows = dense_windows(lengths, 2.0)
        assert all(a < b for a, b in windows) and all(x[1] <= y[0] for x, y in zip(windows, windows[1:]))
    text = "aaaa.bb-" * 250_000  # two million characters without a blank
    random_spans(text, encoder("byte_bpe_50k.tiktoken"), 2.0)
    assert time.monotonic() - began < 60


def test_fingerprints_of_null_ids_pass_links_on(spark, monkeypatch):
    from geoloom.llm import simhash

    made = spark.createDataFrame([(1, 0x0), (None, 0xF), (2, 0xFF), (None, -1), (None, 1 << 40 | 0xFFFF << 20), (7, 0x0)], "doc_id long, fp long")
    monkeypatch.setattr(simhash, "fingerprints", lambda *a: made)
    got = sorted(((r["doc_id"], int(r["fingerprint"], 16), r["component_id"]) for r in simhash.simhash_groups(made).collect()), key=str)
    told = [(1, 0x0, 1), (None, 0xF, 1), (2, 0xFF, 1), (None, (1 << 64) - 1, None), (None, 1 << 40 | 0xFFFF << 20, None), (7, 0x0, 1)]
    assert got == sorted(told, key=str)


def test_lines_alike_whether_few_rows_or_many_are_touched(spark, sf):
    from geoloom.llm import line_dedup

    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    one, two = (sorted(tuple(r) for r in line_dedup._deduped(docs, 2, 20, "doc_id", "text", few).select("row_id", "in1", "n_lines", "n_removed", "n_links").collect()) for few in (1_000_000, 0))
    assert one == two and any(r[3] for r in one)
