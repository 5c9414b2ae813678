"""Kernels, thresholds and bodies of cells against brute force."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest

CELLS = "zone string, cx long, cy long, value double"


def surface(rng, n=260):
    own = {}
    while len(own) < n:
        own[rng.randint(-14, 15), rng.randint(-9, 12)] = round(rng.uniform(-5, 9), 3)
    return own


@pytest.mark.parametrize("tile", [4, 256])
def test_kernels_over_tiles(spark, tile):
    from geoloom.operators.kernels import SOBEL_X, SOBEL_Y, annulus, box_sums, convolved, decay

    rng = random.Random(tile)
    zones = {"a": surface(rng), "b": surface(rng, 90)}
    df = spark.createDataFrame([(z, x, y, v) for z, own in zones.items() for (x, y), v in own.items()] + [("a", 40, 40, None)], CELLS)
    zones["a"][40, 40] = 0.0
    kernels = {"sx": SOBEL_X, "sy": SOBEL_Y, "ring": annulus(1.5, 3), "near": decay(3, 0.5)}
    got = {(r["zone"], r["cx"], r["cy"]): r for r in convolved(df, kernels, ["zone"], tile).collect()}
    boxes = {(r["zone"], r["cx"], r["cy"]): r["total"] for r in box_sums(df, 3, ["zone"], tile).collect()}
    assert set(got) == set(boxes) == {(z, *c) for z, own in zones.items() for c in own}
    for z, own in zones.items():
        for x, y in own:
            for name, kernel in kernels.items():
                assert got[z, x, y][name] == pytest.approx(sum(w * own.get((x + dx, y + dy), 0.0) for dx, dy, w in kernel), abs=1e-9)
            assert boxes[z, x, y] == pytest.approx(sum(own.get((x + a, y + b), 0.0) for a in range(-3, 4) for b in range(-3, 4)), abs=1e-9)
    assert sorted((w, dx, dy) for dx, dy, w in SOBEL_X) == sorted([(-1, -1, -1), (-2, -1, 0), (-1, -1, 1), (1, 1, -1), (2, 1, 0), (1, 1, 1)])
    with pytest.raises(ValueError):
        convolved(df, {"wide": annulus(0, 9)}, [], 4)


def test_otsu_parts_two_heaps(spark):
    from geoloom.operators.kernels import otsu

    rng = random.Random(4)
    values = [rng.gauss(0, 1) for _ in range(300)] + [rng.gauss(9, 1) for _ in range(200)]
    got = otsu(spark.createDataFrame([(v,) for v in values] + [(None,)], "value double")).first()[0]
    low, high = min(values), max(values)
    bins = np.minimum(((np.array(values) - low) / ((high - low) / 256)).astype(int), 255)
    best = max(range(255), key=lambda k: (round((bins <= k).mean() * (bins > k).mean() * (bins[bins <= k].mean() - bins[bins > k].mean()) ** 2, 9) if (bins > k).any() else -1, -k))
    assert got == pytest.approx(low + (best + 1) * (high - low) / 256)
    assert otsu(spark.createDataFrame([(3.0,), (3.0,)], "value double")).first()[0] is None


def test_bodies_and_their_shores(spark):
    from geoloom.operators.kernels import bodies, body_shapes, water

    lake = {(x, y) for x in range(3, 13) for y in range(4, 8)}
    pond = {(18, 10), (19, 11), (20, 12)}
    cells = [(x, y, 5.0 if (x, y) in lake | pond else -5.0) for x in range(24) for y in range(16)]
    found, shore = water(spark.createDataFrame(cells, "cx long, cy long, value double"), 10.0, 1)
    got = {r["cells"]: r for r in found.collect()}
    assert set(got) == {40, 3} and got[40]["area"] == 4_000.0 and (got[40]["x"], got[40]["y"]) == (80.0, 60.0)
    assert got[40]["major"] == pytest.approx(4 * math.sqrt(99 / 12 + 1 / 12) * 10) and got[40]["minor"] == pytest.approx(4 * math.sqrt(15 / 12 + 1 / 12) * 10)
    assert got[3]["eccentricity"] > 0.9 > 0
    dry = {(x, y) for x in range(24) for y in range(16)} - lake - pond
    wet = lake | pond
    sob = lambda x, y: math.hypot(sum(a * (2 - abs(b)) * ((x + a, y + b) in wet) for a in (-1, 1) for b in (-1, 0, 1)), sum(b * (2 - abs(a)) * ((x + a, y + b) in wet) for b in (-1, 1) for a in (-1, 0, 1)))
    edge = {(x, y) for x in range(24) for y in range(16) if sob(x, y) >= 1}
    assert {(r["cx"], r["cy"]) for r in shore.collect()} == {c for c in dry if any((c[0] + a, c[1] + b) in edge for a in (-1, 0, 1) for b in (-1, 0, 1))}
    assert bodies(spark.createDataFrame(sorted(pond), "cx long, cy long"), corners=False).select("body").distinct().count() == 3
    assert body_shapes(bodies(spark.createDataFrame([(1, 1)], "cx long, cy long"))).first()["eccentricity"] == 0.0
