"""A training-corpus pipeline: five stages, each one operator over all that the stage before has kept.

In every stage other columns are carried along whatever their names, very long
texts are handled whole, ties and repeated rows give the same result each time,
and an empty table gives an empty one. The stages say what becomes of nulls,
empty texts and repeated rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from geoloom.llm.decontaminate import drop_leaks
from geoloom.llm.line_dedup import drop_repeats
from geoloom.llm.packing import pack
from geoloom.llm.quality import keep_good
from geoloom.llm.simhash import keep_first, simhash_groups
from geoloom.plans.materialize import materialize
from geoloom.sources.tables import table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality rules reject: null, empty and blank texts
    among them (they have fewer than 20 words). Null ids stay; repeated rows are
    judged alike."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops later copies and near copies of lines, and documents of which nothing is
    left by that. Null and empty texts have no line and stay, as do rows with a
    null id; of repeated rows one keeps its lines."""
    return drop_repeats(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each SimHash group, the one with the smallest id. Null and
    empty texts form a group; rows with a null id stay; of rows that repeat an id
    one stays."""
    return keep_first(docs, simhash_groups(docs))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a benchmark item; null and empty texts hold none,
    null items are none; repeated rows are judged alike."""
    return drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of at most 2048 tokens; a null text counts as
    empty (its end token is packed), repeated rows are packed each."""
    return pack(docs)


STAGES = [
    ("quality", quality),
    ("lines", lines),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: Hashed n-grams, edit joins, SimHash components, WAND and linear programs have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
