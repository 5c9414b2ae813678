"""Sequences of events: sessions, islands, rolling sums, daily summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoloom.functions.weights import mph


def seconds_between(later, earlier) -> Column:
    return (F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))) / 1_000_000


def sessions(events: DataFrame, user: str, ts: str, gap_seconds: float, tie: str) -> DataFrame:
    """``events`` with session (from 0): a new one after a gap longer than ``gap_seconds``."""
    w = Window.partitionBy(user).orderBy(ts, tie)
    fresh = (seconds_between(F.col(ts), F.lag(ts).over(w)) > gap_seconds).cast("int")
    return events.withColumn("_new", F.coalesce(fresh, F.lit(0))).withColumn("session", F.sum("_new").over(w)).drop("_new")


def islands(days: DataFrame, user: str, day: str) -> DataFrame:
    """(user, first_day, last_day, days) of runs of consecutive dates in days(user, day)."""
    w = Window.partitionBy(user).orderBy(day)
    run = F.date_sub(F.col(day), F.row_number().over(w))
    return (
        days.select(user, day).distinct().withColumn("_run", run).groupBy(user, "_run")
        .agg(F.min(day).alias("first_day"), F.max(day).alias("last_day"), F.count(F.lit(1)).alias("days")).drop("_run")
    )


def rolling_sum(df: DataFrame, by: str, order: list[str], value: str, n: int) -> DataFrame:
    """``df`` with rolling: the sum over the last n rows, null until there are n."""
    w = Window.partitionBy(by).orderBy(*order).rowsBetween(1 - n, 0)
    return df.withColumn("rolling", F.when(F.count(value).over(w) == n, F.sum(value).over(w)))


def daily(events: DataFrame, user: str, ts: str, value: str) -> DataFrame:
    """(user, day, n, low, high, total) for each user and day."""
    return events.groupBy(user, F.to_date(ts).alias("day")).agg(
        F.count(F.lit(1)).alias("n"), F.min(value).alias("low"), F.max(value).alias("high"), F.sum(value).alias("total")
    )


def accurate_pings(pings: DataFrame, accuracy: str, worst: float) -> DataFrame:
    """Pings whose accuracy in metres is known and better than ``worst``."""
    return pings.filter(F.col(accuracy) < worst)


def plausible_journeys(journeys: DataFrame, distance: str, seconds: str, slow: float = 0.1, fast: float = 120.0, least: float = 100.0) -> DataFrame:
    """``journeys`` with mph, of those over ``least`` metres whose speed lies between the bounds."""
    return journeys.withColumn("mph", mph(F.col(distance), F.col(seconds))).filter((F.col(distance) > least) & (F.col("mph") > slow) & (F.col("mph") < fast))
