"""Operators 11 and 13 against all pairs, on hard little tables and on the given one."""

from __future__ import annotations

import math

import numpy as np
import pytest

SCHEMA = "vec_id long, embedding array<double>, label int, v int, n string"


def told_links(rows, least):
    """vec_id, links, component by row, from exactly rounded sums."""

    def fine(v):
        return v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)

    def cosine(a, b):
        a, b = ([x / max(map(abs, v)) for x in v] for v in (a, b))
        return math.fsum(x * y for x, y in zip(a, b)) / math.sqrt(math.fsum(x * x for x in a) * math.fsum(x * x for x in b))

    n = len(rows)
    near = [[i != j and fine(rows[i][1]) and fine(rows[j][1]) and len(rows[i][1]) == len(rows[j][1]) and cosine(rows[i][1], rows[j][1]) >= least for j in range(n)] for i in range(n)]
    out = []
    for i in range(n):
        seen, front = {i}, [i]
        while front:
            front = [j for k in front for j in range(n) if near[k][j] and j not in seen]
            seen |= set(front)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        c = min(ids) if ids else None
        out.append((rows[i][0], sum(near[i]), c, rows[i][0] == c))
    return sorted(out, key=str)


def hard_vectors(rng, dims=12):
    rows = []
    for k in range(25):  # groups of near copies, chains and scaled copies
        base = rng.normal(size=dims)
        for _ in range(rng.integers(1, 7)):
            rows.append(base + rng.normal(size=dims) * rng.choice([0.0, 0.02, 0.1, 0.2]))
        rows.append(base * 1e200)
        rows.append(base * 1e-200)
    walk = rng.normal(size=dims)
    for _ in range(12):  # each linked with the next ones only
        walk = walk / np.linalg.norm(walk) + rng.normal(size=dims) * 0.05
        rows.append(walk)
    vectors = [[float(x) for x in r] for r in rows]
    vectors += [None, [], [0.0] * dims, [-0.0] * dims, [float("nan")] + [1.0] * (dims - 1), [float("inf")] + [1.0] * (dims - 1), [None] + [1.0] * (dims - 1)]
    vectors += [[1.0, 2.0, 3.0], [1.0, 2.0, 3.0], [1.0, 2.0, 3.1], [5.0], [6.0], [-5.0]]
    vectors += [[19.0, 6.0, 1.0, 1.0, 0.0], [20.0, 0.0, 0.0, 0.0, 0.0], [19.0, 6.0, 1.0, 1.0, 1.0]]  # cosines around and at 0.95
    order = rng.permutation(len(vectors))
    out = [(int(i), vectors[k], int(k % 3), 1, "x") for i, k in enumerate(order)]
    out += [(None, out[0][1], 1, 1, "x"), (None, [9.0, -9.0, 1.0], 1, 1, "x"), (3, out[3][1], 1, 1, "x"), (4, out[9][1], 1, 1, "x")]
    return out


@pytest.mark.parametrize(("blocks", "chunk"), [(4, 12_288), (3, 7), (1, 20), (64, 50)])
def test_near_vectors_equal_all_pairs(spark, blocks, chunk):
    from geoloom.llm.embedding_dedup import near_vectors

    rows = hard_vectors(np.random.default_rng(blocks))
    got = near_vectors(spark.createDataFrame(rows, SCHEMA), blocks=blocks, chunk=chunk)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    told = [(a, n, c, a == c) for a, n, c, _ in told_links(rows, 0.95)]
    assert sorted((tuple(r) for r in got.collect()), key=str) == told


def test_near_vectors_of_a_large_group(spark):
    from geoloom.llm.embedding_dedup import near_vectors

    rng = np.random.default_rng(5)
    base = rng.normal(size=16)
    vectors = np.concatenate([base + rng.normal(size=(300, 16)) * 0.12, rng.normal(size=(300, 16)), np.repeat(base[None], 100, axis=0)]).astype(np.float32)
    got = near_vectors(spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>"), chunk=64)
    unit = vectors.astype(float) / np.linalg.norm(vectors.astype(float), axis=1, keepdims=True)
    assert {r["vec_id"]: r["n_links"] for r in got.collect()} == dict(enumerate(((unit @ unit.T >= 0.95).sum(axis=1) - 1).tolist()))


def test_empty_tables_of_vectors(spark):
    from geoloom.llm.embedding_dedup import near_vectors
    from geoloom.llm.hard_negatives import mine_negatives

    for rows in ([], [(1, None, 2, 1, "x"), (50, [0.0, float("nan")], 2, 1, "x")]):
        df = spark.createDataFrame(rows, SCHEMA)
        assert near_vectors(df).count() == len(rows)
        assert mine_negatives(df).collect() == []


def told_negatives(rows, every, positives, negatives):
    own = []
    for i, v, label, *_ in rows:
        if i is None or label is None or v is None or not all(x is not None and math.isfinite(x) and math.isfinite(256 * x) for x in v):
            continue
        own.append((i, (label + 1) % 10 if i % 7 == 0 else label, tuple(math.floor(256 * x) for x in v)))
    out = []
    for a in {x for x in own if x[0] % every == 0}:
        score = lambda b: sum(x * y for x, y in zip(a[2], b[2]))
        others = [(-score(b), b[0], b[1]) for b in own if len(b[2]) == len(a[2]) and a[2]]
        best = sorted(x for x in others if x[2] == a[1] and x[1] != a[0])[:positives]
        for s, i, _ in best:
            window = sorted(x for x in others if x[2] != a[1] and 50 * -s <= 100 * -x[0] <= 95 * -s)[:negatives]
            clip = lambda x: max(-(1 << 63), min((1 << 63) - 1, x))
            out += [(a[0], i, k + 1, x[1], clip(-s), clip(-x[0])) for k, x in enumerate(window)]
    return sorted(out)


@pytest.mark.parametrize(("cells", "block"), [(64, 4_096), (4, 3), (2, 1)])
def test_negatives_equal_all_pairs(spark, cells, block):
    from geoloom.llm.hard_negatives import mine_negatives

    rng = np.random.default_rng(cells)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 6) / 4], int(rng.integers(0, 4)), 1, "x") for i in range(300)]  # many ties
    rows += [(300 + i, [float(x) for x in rng.normal(size=9)], int(rng.integers(0, 3)), 1, "x") for i in range(200)]
    rows += [(500 + i, [float(x) for x in rng.normal(size=3) * 2.0**20], i % 2, 1, "x") for i in range(40)]
    rows += [(700, None, 1, 1, "x"), (750, [], 1, 1, "x"), (800, [float("nan")] * 6, 1, 1, "x"), (850, [None] * 6, 1, 1, "x"), (900, [1.0] * 6, None, 1, "x"), (None, [1.0] * 6, 1, 1, "x"), (950, [1e307] * 6, 1, 1, "x")]
    rows += [rows[0], rows[50], (50, rows[51][1], 3, 1, "x"), (7, rows[8][1], 2, 1, "x")]
    got = mine_negatives(spark.createDataFrame(rows, SCHEMA), every=10, cells=cells, block=block)
    assert sorted(tuple(r) for r in got.collect()) == told_negatives(rows, 10, 5, 3)


def test_scores_beyond_doubles_are_exact(spark):
    from geoloom.llm.hard_negatives import mine_negatives

    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.integers(1, 2**29, 4) / 256], i % 2, 1, "x") for i in range(60)]
    got = mine_negatives(spark.createDataFrame(rows, SCHEMA), every=10)
    assert sorted(tuple(r) for r in got.collect()) == told_negatives(rows, 10, 5, 3)


def test_bounds_hold_and_shut_out_rows():
    from geoloom.llm.hard_negatives import Approximation, scaled

    rng = np.random.default_rng(3)
    rows = scaled(rng.normal(size=(2_000, 16)))
    file = Approximation(rows.min(axis=0), rows.max(axis=0), rows.mean(axis=0), rows.std(axis=0))
    places = file.quantise(rows)
    for anchor in rows[:20]:
        low, up = (t.take(places).sum(axis=1) for t in file.tables(anchor))
        exact = rows @ anchor
        assert (low <= exact).all() and (exact <= up).all()
        assert (up >= np.sort(low)[-5]).sum() < 200


@pytest.mark.parametrize("name", ["op11_embedding_dedup", "op13_hard_negatives"])
def test_vector_queries_equal_their_sql(spark, duck, sf, name):
    from geoloom.llm import registry

    got, told = registry.QUERIES[name](spark, sf), duck.sql(registry.ORACLES[name])
    order = [told.columns.index(c) for c in got.columns]
    assert sorted(tuple(r) for r in got.collect()) == sorted(tuple(r[i] for i in order) for r in told.fetchall())
