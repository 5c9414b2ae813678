"""Cutting lineage and sharing code in a way that survives lost executors."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one where the
    setting is absent and the session has no remote executors."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not found:
        found = getattr(spark.sparkContext, "_geoloom_dir", None)
        if not found:
            own = tempfile.mkdtemp(prefix="geoloom-")
            atexit.register(shutil.rmtree, own, ignore_errors=True)
            found = f"file://{own}"
            spark.sparkContext._geoloom_dir = found
    return found.rstrip("/")


def materialize(df: DataFrame, label: str = "part") -> DataFrame:
    """Write ``df`` as parquet to the shared folder and read it back.

    Later stages then start from files that every executor can read, so a lost
    executor costs a re-read rather than a recomputation, and the optimizer
    knows the real size.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, max_rows: int) -> DataFrame:
    """Hint a broadcast only if ``df`` (cheap to count) has at most ``max_rows``.

    Beyond the bound the join is left to the optimizer (a shuffle join that
    adaptive execution can split).
    """
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def send_or_deal(df: DataFrame, max_rows: int) -> DataFrame:
    """:func:`broadcast_if_small`, but a larger ``df`` asks for a merge join, so that the
    other side is not sent either: for one whose size the plan underrates."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df.hint("merge")


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors once per context, for sessions that
    were started without it on the executors' path."""
    sc = spark.sparkContext
    if getattr(sc, "_geoloom_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    target = os.path.join(tempfile.mkdtemp(prefix="geoloom-"), "geoloom_code.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(p.relative_to(root.parent)))
    sc.addPyFile(target)
    sc._geoloom_shipped = True
