"""Changes of home: where users settle for days on end, and when that place moves far."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from geoloom.plans.materialize import ship_package

_OUT = "user_id long, left_day date, arrived_day date, from_x double, from_y double, to_x double, to_y double, distance double"
_DAY = 86_400_000


def daily_centres(pings: DataFrame) -> DataFrame:
    """(user_id, day, x, y): the middle of the box around each user's pings(user_id, ts, x, y) of a day."""
    box = pings.filter("x is not null and y is not null").groupBy("user_id", F.to_date("ts").alias("day")).agg(*(f(c).alias(f"{n}_{c}") for c in "xy" for n, f in (("low", F.min), ("high", F.max))))
    return box.select("user_id", "day", *(((F.col(f"low_{c}") + F.col(f"high_{c}")) / 2).alias(c) for c in "xy"))


def homes(pings: DataFrame, min_days: int, day_move: float) -> DataFrame:
    """(user_id, first_day, last_day, days, x, y): the stays of each user: longest runs of
    days one after the other whose centres move by less than ``day_move``, of
    ``min_days`` days or more; their place is the mean of the days' centres."""
    w = Window.partitionBy("user_id").orderBy("day")
    before = daily_centres(pings).withColumns({"_d": F.lag("day").over(w), "_x": F.lag("x").over(w), "_y": F.lag("y").over(w)})
    moved = F.hypot(F.col("x") - F.col("_x"), F.col("y") - F.col("_y"))
    follows = F.coalesce((F.datediff("day", "_d") == 1) & (moved < day_move), F.lit(False))
    runs = before.withColumn("run", F.sum((~follows).cast("int")).over(w))
    stays = runs.groupBy("user_id", "run").agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.count(F.lit(1)).alias("days"), F.avg("x").alias("x"), F.avg("y").alias("y"))
    return stays.filter(F.col("days") >= min_days).drop("run")


def migrations(pings: DataFrame, min_days: int = 5, day_move: float = 1_000.0, far: float = 50_000.0, late: str = "1 day", forget_days: int = 365) -> DataFrame:
    """(user_id, left_day, arrived_day, from_x, from_y, to_x, to_y, distance): two stays of a
    user in a row (:func:`homes`) that are further than ``far`` apart.

    A table is judged as a whole. A stream keeps, by user, the boxes of days that
    the watermark (``late``) hasn't passed, the run of days so far and the last
    stay; a timer at the end of each day closes the day, a run ends when a day
    passes without following it, and a change of home comes out then. A user
    unseen for ``forget_days`` is forgotten. Stays that are still going on when a
    stream stops come out when it goes on."""
    if not pings.isStreaming:
        w = Window.partitionBy("user_id").orderBy("first_day")
        both = homes(pings, min_days, day_move).withColumns({"left_day": F.lag("last_day").over(w), "from_x": F.lag("x").over(w), "from_y": F.lag("y").over(w)})
        both = both.withColumn("distance", F.hypot(F.col("x") - F.col("from_x"), F.col("y") - F.col("from_y"))).filter(F.col("distance") > far)
        return both.select("user_id", "left_day", F.col("first_day").alias("arrived_day"), "from_x", "from_y", F.col("x").alias("to_x"), F.col("y").alias("to_y"), "distance")
    ship_package(pings.sparkSession)
    own = pings.filter("x is not null and y is not null").select(F.col("user_id").cast("long").alias("user_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    made = own.withWatermark("ts", late).groupBy("user_id").transformWithStateInPandas(_Stays(min_days, day_move, far, forget_days), _OUT, "Append", "EventTime")
    return made


class _Stays(StatefulProcessor):
    """A user's open days, run of days and last stay; days count from 1970."""

    def __init__(self, min_days: int, day_move: float, far: float, forget_days: int):
        self.min_days, self.day_move, self.far, self.forget_days = min_days, day_move, far, forget_days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.days = handle.getMapState("days", "day long", "x0 double, x1 double, y0 double, y1 double")
        self.run = handle.getValueState("run", "first long, last long, n long, sx double, sy double, x double, y double")
        self.home = handle.getValueState("home", "last long, x double, y double")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for batch in rows:
            day = (batch["ts"].astype("int64") // {"ns": 10**9, "us": 10**6, "ms": 10**3, "s": 1}[batch["ts"].dt.unit] // 86_400).astype("int64")
            boxes = batch.groupby(day).agg(x0=("x", "min"), x1=("x", "max"), y0=("y", "min"), y1=("y", "max"))
            for d, b in zip(boxes.index.tolist(), boxes.itertuples(index=False), strict=True):
                at, now = (d,), tuple(b)
                if self.days.containsKey(at):
                    old = self.days.getValue(at)
                    now = (min(old[0], now[0]), max(old[1], now[1]), min(old[2], now[2]), max(old[3], now[3]))
                self.days.updateValue(at, tuple(float(v) for v in now))
                self.handle.registerTimer((d + 1) * _DAY)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        day, out = expiredTimerInfo.getExpiryTimeInMs() // _DAY - 1, []
        run = tuple(self.run.get()) if self.run.exists() else None
        seen = self.days.containsKey((day,))
        if seen:
            x0, x1, y0, y1 = self.days.getValue((day,))
            self.days.removeKey((day,))
            x, y = (x0 + x1) / 2, (y0 + y1) / 2
            if run and run[1] == day - 1 and math.hypot(x - run[5], y - run[6]) < self.day_move:
                run = (run[0], day, run[2] + 1, run[3] + x, run[4] + y, x, y)
            else:
                out = self._close(key, run)
                run = (day, day, 1, x, y, x, y)
            self.run.update(run)
            self.handle.registerTimer((day + 2) * _DAY)  # a day that doesn't come ends the run
            self.handle.registerTimer((day + 1 + self.forget_days) * _DAY)
        elif run and run[1] < day:
            out = self._close(key, run)
            self.run.clear()
        if not seen and not self.run.exists() and self.home.exists() and self.home.get()[0] + self.forget_days <= day:
            self.home.clear()
        return iter([pd.DataFrame(out, columns=["user_id", "left_day", "arrived_day", "from_x", "from_y", "to_x", "to_y", "distance"])] if out else [])

    def _close(self, key: tuple, run: tuple | None) -> list[tuple]:
        """Ends a run: if it was a stay, it is the home from now on; tells a change that was far."""
        if run is None or run[2] < self.min_days:
            return []
        x, y, out = run[3] / run[2], run[4] / run[2], []
        if self.home.exists():
            last, hx, hy = self.home.get()
            distance = math.hypot(x - hx, y - hy)
            if distance > self.far:
                date = lambda d: pd.Timestamp(d, unit="D").date()
                out = [(key[0], date(last), date(run[0]), hx, hy, x, y, distance)]
        self.home.update((run[1], x, y))
        return out

    def close(self) -> None:
        pass


