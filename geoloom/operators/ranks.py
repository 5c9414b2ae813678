"""Ranks, running sums and exact percentiles of groups of any size, without a group in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geoloom.plans.materialize import broadcast_if_small, materialize


def running(df: DataFrame, by: list[str], order: list, value: str | None = None) -> DataFrame:
    """``df`` with rank (from 0) and, of ``value``, running (the sum up to and with
    the row) within each group of ``by``, in ``order``, which must be total.

    Rows are dealt by range, so one group spreads over many tasks; each task
    counts its own rows, and a table of one row a task and group gives the offsets."""
    keys = [*(F.col(c) for c in by), *(c if not isinstance(c, str) else F.col(c) for c in order)]
    dealt = df.repartitionByRange(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
    dealt = materialize(dealt.withColumn("_task", F.spark_partition_id()), "dealt")
    w = Window.partitionBy("_task", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    amount = F.col(value) if value else F.lit(0.0)
    own = dealt.groupBy("_task", *by).agg(F.count(F.lit(1)).alias("_n"), F.sum(amount).alias("_s"))
    before = Window.partitionBy(*by).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    table = own.select("_task", *(F.col(c).alias(f"_by_{c}") for c in by), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"), F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_s0"))
    table = broadcast_if_small(materialize(table.withColumnRenamed("_task", "_at"), "offsets"), 500_000)
    same = F.col("_task") == F.col("_at")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    local = dealt.withColumn("_k", F.row_number().over(w) - 1).withColumn("_r", F.sum(amount).over(w))
    out = local.join(table, same).withColumn("rank", F.col("_k") + F.col("_n0")).withColumn("running", F.col("_r") + F.col("_s0"))
    return out.select(*df.columns, "rank", *(["running"] if value else []))


def percentiles(df: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """One row a group with the exact, interpolated percentile of each of ``shares``
    (name: 0 to 1); nulls don't count. Only the rows at the wanted ranks meet."""
    own = df.filter(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_v"))
    # Equal values are counted first, so what is ranked is one row a value.
    counted = own.groupBy(*by, "_v").agg(F.count(F.lit(1)).alias("_c"))
    placed = materialize(running(counted, by, ["_v"], "_c").withColumn("_from", F.col("running") - F.col("_c")), "placed")
    total = placed.groupBy(*by).agg(F.sum("_c").alias("_all"))
    spots = F.array(*(F.struct(F.lit(k).alias("name"), (F.lit(float(q)) * (F.col("_all") - 1)).alias("at")) for k, q in shares.items()))
    want = broadcast_if_small(materialize(total.withColumn("_s", F.explode(spots)).select(*(F.col(c).alias(f"_by_{c}") for c in by), "_s.name", "_s.at"), "spots"), 500_000)
    same = (F.floor("at") < F.col("running")) & (F.ceil("at") >= F.col("_from"))
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    near = placed.join(want, same)
    low = F.max(F.when((F.floor("at") >= F.col("_from")) & (F.floor("at") < F.col("running")), F.col("_v")))
    high = F.max(F.when((F.ceil("at") >= F.col("_from")) & (F.ceil("at") < F.col("running")), F.col("_v")))
    found = near.groupBy(*by, "name", "at").agg(low.alias("low"), high.alias("high"))
    exact = F.col("low") + (F.col("high") - F.col("low")) * (F.col("at") - F.floor("at"))
    return found.groupBy(*by).agg(*(F.max(F.when(F.col("name") == k, exact)).alias(k) for k in shares))


def match_histogram(source: DataFrame, reference: DataFrame, value: str = "value") -> DataFrame:
    """(value, matched) of the distinct values of ``source``, moved to where the
    reference has the same cumulative share, linear between its values."""

    def shares(df: DataFrame) -> DataFrame:
        counted = df.filter(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("c"))
        placed = running(counted, [], ["v"], "c")
        return placed.crossJoin(F.broadcast(counted.agg(F.sum("c").alias("n")))).select("v", (F.col("running") / F.col("n")).alias("q"))

    own, other = shares(source), shares(reference)
    both = own.select("q", "v", F.lit(1).alias("own"), F.lit(None).cast("double").alias("to")).unionByName(other.select("q", F.lit(None).cast("double").alias("v"), F.lit(0).alias("own"), F.col("v").alias("to")))
    # The neighbours on either side come from ranges of shares: rows are dealt to 256 slots, and each slot
    # learns the last value before it and the first after it from a table of one row a slot.
    both = both.withColumn("slot", F.least(F.floor(F.col("q") * 256), F.lit(255)))
    ends = both.filter("own = 0").groupBy("slot").agg(F.max_by(F.struct("q", "to"), "q").alias("last"), F.min_by(F.struct("q", "to"), "q").alias("first"))
    slots = source.sparkSession.range(256).select(F.col("id").alias("slot")).join(ends, "slot", "left")
    up, down = Window.orderBy("slot").rowsBetween(Window.unboundedPreceding, -1), Window.orderBy("slot").rowsBetween(1, Window.unboundedFollowing)
    slots = slots.select("slot", F.last("last", True).over(up).alias("before"), F.first("first", True).over(down).alias("after"))
    w = Window.partitionBy("slot").orderBy("q", "own")
    back, on = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    point = F.when(F.col("own") == 0, F.struct("q", "to"))
    near = both.withColumn("lo", F.last(point, True).over(back)).withColumn("hi", F.first(point, True).over(on)).join(F.broadcast(slots), "slot").filter("own = 1")
    lo, hi = F.coalesce("lo", "before"), F.coalesce("hi", "after")
    df = near.select("v", "q", lo.alias("lo"), hi.alias("hi"))
    part = (F.col("q") - F.col("lo.q")) / (F.col("hi.q") - F.col("lo.q"))
    matched = F.when(F.col("lo").isNull(), F.col("hi.to")).when(F.col("hi").isNull() | (F.col("lo.q") == F.col("q")), F.col("lo.to")).otherwise(F.col("lo.to") + part * (F.col("hi.to") - F.col("lo.to")))
    return df.select(F.col("v").alias("value"), matched.alias("matched"))
