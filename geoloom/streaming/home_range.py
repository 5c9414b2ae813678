"""Home range: each user's most visited cell, kept as state of a stream or counted over a table."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.plans.materialize import ship_package

_OUT = "user_id long, home long, pings long, away long"


def _step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    """Adds a batch's visits to the user's counts by cell and tells the home so far."""
    counts: dict[int, int] = dict(zip(*state.get, strict=True)) if state.exists else {}
    for batch in batches:
        for cell, n in batch["cell"].value_counts().items():
            counts[int(cell)] = counts.get(int(cell), 0) + int(n)
    cells = sorted(counts)
    state.update((cells, [counts[c] for c in cells]))
    home, pings = min(counts, key=lambda c: (-counts[c], c)), sum(counts.values())
    yield pd.DataFrame({"user_id": [key[0]], "home": [home], "pings": [pings], "away": [pings - counts[home]]})


def home_range(visits: DataFrame, cell: str) -> DataFrame:
    """(user_id, home, pings, away) of visits(user_id, <cell>): the most visited cell
    (ties: the smallest), all visits, and those elsewhere.

    A stream keeps one count a user and cell as state and gives, with each
    batch, the new standing of the users met in it; a table is counted once."""
    own = visits.select("user_id", F.col(cell).cast("long").alias("cell"))
    if visits.isStreaming:
        ship_package(visits.sparkSession)
        return own.groupBy("user_id").applyInPandasWithState(_step, _OUT, "cells array<long>, counts array<long>", "update", "NoTimeout")
    counted = own.groupBy("user_id", "cell").agg(F.count(F.lit(1)).alias("n"))
    best = counted.groupBy("user_id").agg(F.max(F.struct("n", (-F.col("cell")).alias("c"))).alias("x"), F.sum("n").alias("pings"))
    return best.select("user_id", (-F.col("x.c")).alias("home"), "pings", (F.col("pings") - F.col("x.n")).alias("away"))
