"""Changes of home in a table, by hand, and in a stream, against the table."""

from __future__ import annotations

import datetime as dt
import math
import random

import pytest


def pings(rng):
    """Users that settle, move near or far, have gaps, or never stay."""
    start, rows = dt.datetime(2024, 1, 1), []
    for user in range(12):
        day, x, y = rng.randint(0, 3), 0.0, 0.0
        for _ in range(rng.randint(2, 5)):
            x, y = x + rng.choice([0, 3_000, 80_000, -120_000]), y + rng.choice([0, 500, 60_000])
            for _ in range(rng.choice([2, 4, 6, 9])):
                for _ in range(rng.randint(1, 3)):
                    rows.append((user, start + dt.timedelta(days=day, hours=rng.randint(0, 23)), x + rng.uniform(-200, 200), y + rng.uniform(-200, 200)))
                day += 1
            day += rng.choice([0, 0, 2])
    return rows


def told(rows, min_days, day_move, far):
    out, by = [], {}
    for u, t, x, y in rows:
        by.setdefault(u, {}).setdefault(t.date(), []).append((x, y))
    for u, days in by.items():
        runs = []
        for d in sorted(days):
            xs, ys = zip(*days[d])
            c = ((min(xs) + max(xs)) / 2, (min(ys) + max(ys)) / 2)
            if runs and (d - runs[-1][-1][0]).days == 1 and math.dist(c, runs[-1][-1][1]) < day_move:
                runs[-1].append((d, c))
            else:
                runs.append([(d, c)])
        stays = [(r[0][0], r[-1][0], sum(c[0] for _, c in r) / len(r), sum(c[1] for _, c in r) / len(r)) for r in runs if len(r) >= min_days]
        out += [(u, a[1], b[0], round(math.dist(a[2:], b[2:]), 3)) for a, b in zip(stays, stays[1:]) if math.dist(a[2:], b[2:]) > far]
    return sorted(out)


SCHEMA = "user_id long, ts timestamp, x double, y double"


def shown(rows):
    return sorted((r["user_id"], r["left_day"], r["arrived_day"], round(r["distance"], 3)) for r in rows)


def test_changes_of_home_in_a_table(spark):
    from geoloom.streaming.migration import migrations

    rows = pings(random.Random(2))
    t = told(rows, 5, 1_000, 50_000)
    assert len(t) > 3 and shown(migrations(spark.createDataFrame(rows + [(1, rows[0][1], None, 1.0)], SCHEMA)).collect()) == t


def test_changes_of_home_in_a_stream(spark, tmp_path):
    from geoloom.streaming.migration import migrations

    rows = sorted(pings(random.Random(2)), key=lambda r: r[1])
    end = [(99, rows[-1][1] + dt.timedelta(days=k), 0.0, 0.0) for k in (40, 41)]  # moves the watermark past all days
    size = len(rows) // 3 + 1
    parts = [rows[:size], rows[size : 2 * size], rows[2 * size :], end[:1], end[1:]]
    got = []
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for part in parts:  # the stream stops after each and goes on from its checkpoint
            spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
            q = migrations(stream).writeStream.outputMode("append").foreachBatch(lambda df, _: got.extend(df.collect())).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
            q.awaitTermination(240)
            assert q.exception() is None
    finally:
        if before is None:
            spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
        else:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    assert shown(got) == told(rows, 5, 1_000, 50_000)
