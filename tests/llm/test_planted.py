"""Planted secrets and personal data: what share the added spans find, and what they report in plain texts."""

from __future__ import annotations

import random
import string

import pytest

WORDS = "the river and its old town of stone where a market was held in winter by people who came down from every village around".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


SECRETS = {
    "mixed": lambda rng, s: s(string.ascii_letters + string.digits, rng.randrange(20, 41)),
    "in a path": lambda rng, s: f"https://{rng.choice(WORDS)}.example.com/{rng.choice(WORDS)}/" + s(string.ascii_letters + string.digits, 28) + "?page=2",
    "in a query": lambda rng, s: f"http://example.org/{rng.choice(WORDS)}?id=7&sig=" + s(string.ascii_letters + string.digits, 32) + "&lang=en",
    "letters": lambda rng, s: s(string.ascii_letters, rng.randrange(18, 33)),
    "lower": lambda rng, s: s(string.ascii_lowercase, rng.randrange(18, 33)),
    "signs": lambda rng, s: s(string.ascii_letters + string.digits + "!@#$", rng.randrange(20, 33)),
    "base64": lambda rng, s: s(string.ascii_letters + string.digits + "+/", 40) + "==",
    "after words": lambda rng, s: f"{rng.choice(WORDS)}-{rng.choice(WORDS)}." + s(string.ascii_letters + string.digits, 32),
}


@pytest.mark.parametrize("kind", SECRETS)
def test_planted_secrets_are_found(kind):
    from geoloom.llm.secret_scan import encoder, random_spans

    enc, rng = encoder("byte_bpe_50k.tiktoken"), random.Random(kind)
    found = 0
    for _ in range(200):
        drawn = []

        def draw(chars, n):
            drawn.append("".join(rng.choice(chars) for _ in range(n)))
            return drawn[-1]

        planted = SECRETS[kind](rng, draw)
        before = prose(rng, 8) + " "
        text = f"{before}{planted} {prose(rng, 8)}"
        a = text.index(drawn[0])
        b = a + len(drawn[0])
        found += any(min(b, y) - max(a, x) >= 0.8 * (b - a) and y - x <= 1.5 * (b - a) + 24 for _, x, y in random_spans(text, enc, 2.0))
    print(kind, found / 200)
    assert found >= 180, (kind, found)


def test_plain_texts_hold_no_random_strings(spark, sf):
    from geoloom.llm.secret_scan import encoder, random_spans

    enc = encoder("byte_bpe_50k.tiktoken")
    fine = [
        "https://www.example.com/articles/2024/01/31/how-the-river-made-the-town.html?utm_source=feed&utm_medium=rss", "see docs/reference/configuration-options.v2.1.3-rc4.md for it", "mail john.smith1970@mail.example.co.uk or +1-202-555-0199",
        "my_project.module_name.ClassName.method_name_with_parts", "10.0.255.255:8080 and 2024-01-31T10:20:30.123456Z and 3.141592653589793238462643", "!!!!!!!!!!!!!!!!!!!!!!!! --------------------- *********************",
        "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855", "https://cdn.example.com/assets/123e4567-e89b-12d3-a456-426614174000.png", "Donaudampfschifffahrtsgesellschaftskapitän und Rechtsschutzversicherungsgesellschaften",
        "for(i=0;i<n;i++){a[i]=b[i]+c[i*2];f(x,y,z);}", "window.requestAnimationFrame=window.webkitRequestAnimationFrame||fallback", "|---|---|---|---| | a | b | c | d |",
    ]
    for text in fine:
        assert [text[a:b] for _, a, b in random_spans(text, enc, 2.0)] == [], text
    texts = [r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    assert sum(bool(random_spans(t, enc, 2.0)) for t in texts) <= 0.02 * len(texts)


def test_windows_are_the_best_scoring_stretches():
    from geoloom.llm.secret_scan import dense_windows

    rng = random.Random(4)
    for _ in range(200):
        lengths = [rng.choice((1, 1, 2, 3, 5)) for _ in range(rng.randrange(1, 12))]
        got = dense_windows(lengths, 2.0)
        ends = [0]
        for n in lengths:
            ends.append(ends[-1] + n)
        score = lambda i, j: sum(2.0 - n for n in lengths[i:j])  # noqa: B023, E731
        best = max(score(i, j) for i in range(len(lengths)) for j in range(i + 1, len(lengths) + 1))
        scores = [score(ends.index(a), ends.index(b)) for a, b in got]
        assert (max(scores) == pytest.approx(best)) if best > 0 else not got
        assert all(b <= c for (_, b), (c, _) in zip(got, got[1:]))


def personal(rng):
    """A respelt entity that no base rule knows, with its kind."""
    d = "".join(rng.choice("23456789") for _ in range(16))
    name, host = rng.choice(WORDS) + rng.choice(("", ".")) + rng.choice(WORDS), rng.choice(WORDS) + rng.choice((".org", ".net", ".co.uk"))
    card = next(c for c in (f"4{d[:14]}{k}" for k in range(10)) if sum(int(x) if i % 2 == 0 else sum(divmod(2 * int(x), 10)) for i, x in enumerate(reversed(c))) % 10 == 0)
    four = [card[i : i + 4] for i in (0, 4, 8, 12)]
    return rng.choice([
        ("email", f"{name} at {host.replace('.', ' dot ')}"), ("email", f"{name} (at) {host.replace('.', ' (dot) ')}"), ("email", f"{name}[at]{host.replace('.', '[dot]')}"),
        ("phone", f"({d[:3]}) {d[3:6]}-{d[6:10]}"), ("phone", f"{d[:3]}-{d[3:6]}-{d[6:10]}"), ("phone", f"{d[:3]}.{d[3:6]}.{d[6:10]}"), ("phone", f"0044 {d[:3]} {d[3:10]}"),
        ("card", ".".join(four)), ("card", "/".join(four)), ("ip", "[.]".join(str(rng.randrange(1, 256)) for _ in range(4))), ("ip", " dot ".join(str(rng.randrange(1, 256)) for _ in range(4))),
    ])


def test_planted_personal_data_in_other_spellings(spark, sf):
    from geoloom.llm.pii_scan import scan_pii

    rng = random.Random(11)
    hints = {"email": "write to", "phone": "call", "card": "card", "ip": "host"}
    rows, want = [], {}
    for i in range(400):
        kind, token = personal(rng)
        start = f"{prose(rng, 6)} {hints[kind] if i % 2 else 'with'} "
        rows.append((i, f"{start}{token} {prose(rng, 6)}"))
        want[i] = (kind, len(start), len(start) + len(token))
    none = ["in 1914-1918 and 1939-1945", "on 2021-03-04 or 31.12.1999", "ISBN 978-3-16-148410-0", "order 10293847 of 5512345", "version 4.15.0-112 build 20190", "look at me dot", "we met at noon", "page 1234 of 5678", "the sum of 12345678901"]
    rows += [(1_000 + i, f"{prose(rng, 5)} {none[i % len(none)]} {prose(rng, 5)}") for i in range(90)]
    docs = spark.read.parquet(f"{sf}/documents.parquet").select((10_000 + __import__("pyspark").sql.functions.col("doc_id")).alias("doc_id"), "text")
    out = {r["doc_id"]: [tuple(s) for s in r["extra"]] for r in scan_pii(docs.union(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    caught = sum(want[i] in out[i] for i in want)
    reported = sum(len(out[i]) for i in range(400)) + sum(len(out[1_000 + i]) for i in range(90))
    print("recall", caught / 400, "precision", caught / max(1, reported), "missed", [rows[i][1] for i in want if want[i] not in out[i]][:5])
    assert caught >= 360 and caught >= 0.95 * reported
    assert sum(bool(out[10_000 + d]) for d in range(200) if 10_000 + d in out) <= 4


def test_ties_are_learnt_and_flip_labels():
    import numpy as np

    from geoloom.llm.pii_scan import LABELS, examples, fit_field, marginals

    none = [0] * len(LABELS)
    phone = [0, 0, 0, 0, 1]
    base = [(x, y, none, none, 1.0) for x, y in examples()]
    odd = [1.0] + [0.0] * (len(base[0][0]) - 1)  # no evidence of its own: its neighbours tell
    rows = base + [(odd, 4, none, phone, 200.0), (odd, 0, none, [1, 0, 0, 0, 0], 200.0), (odd, 4, [1, 0, 0, 0, 0], none, 50.0), (odd, 0, phone, none, 50.0)]
    w, chain, skip = fit_field(rows)
    assert skip > 1 > chain
    unary = np.array([[0.0, 0, 0, 0, 20.0], [1.0, 0, 0, 0, 0.5]])
    assert marginals(unary, [], []).argmax(axis=1).tolist() == [4, 0] and marginals(unary, [(0, 1)], [skip]).argmax(axis=1).tolist() == [4, 4]
