"""Shared helpers of the training-data operators."""

from __future__ import annotations

import hashlib
import os
from bisect import bisect_left
from collections.abc import Callable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from geoloom.plans.materialize import ship_package

#: Rows handled at a time inside a task; a very long text is still whole.
ROWS = 512


def vocabulary_path(name: str) -> str:
    """A tokenizer file: an absolute path as it is, else by its public name."""
    if os.path.isabs(name):
        return name
    import public_tokenizers

    return str(public_tokenizers.path(name))


def map_rows(df: DataFrame, columns: list[str], fn: Callable[..., dict], schema: str) -> DataFrame:
    """Apply ``fn(*column_lists) -> {output column: list}`` to batches of rows.

    The batches are Arrow slices of at most ``ROWS`` rows, so memory follows
    the longest texts, not the partition.
    """
    ship_package(df.sparkSession)
    out: StructType = _parse_datatype_string(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = to_arrow_schema(out)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                made = fn(*(part.column(i).to_pylist() for i in range(part.num_columns)))
                yield pa.RecordBatch.from_pydict(made, schema=kind)

    return df.select(*columns).mapInArrow(run, out)


def hashed_share(df: DataFrame, id_col: str, rows: int) -> DataFrame:
    """About ``rows`` rows of ``df`` (all, if it has no more): those whose hashed
    id falls into the first part of the hash range. The same rows each time,
    found by a filter, so nothing is sorted or collected to choose them."""
    n = df.count()
    if n <= rows:
        return df
    parts = 1 << 40
    return df.filter(F.pmod(F.xxhash64(id_col), F.lit(parts)) < int(parts * rows / n))


def hidden(df: DataFrame) -> DataFrame:
    """``df`` with its columns renamed to in0, in1, ... by place, so that no name of
    an input, not even a repeated one, can clash with an operator's own columns."""
    return df.toDF(*(f"in{i}" for i in range(len(df.columns))))


def place(df: DataFrame, name: str) -> str:
    """The name that :func:`hidden` gives to a column."""
    return f"in{df.columns.index(name)}"


def shown(work: DataFrame, df: DataFrame, **added: Column) -> DataFrame:
    """The columns of ``df`` from ``work`` (made of ``hidden(df)``) under their own
    names, with ``added`` at the end; an input column named like an added one
    gives way to it."""
    new = {a.lower() for a in added}
    own = [F.col(f"in{i}").alias(c) for i, c in enumerate(df.columns) if c.lower() not in new]
    return work.select(*own, *(v.alias(k) for k, v in added.items()))


Span = tuple[str, int, int]


class Overlaps:
    """Spans (name, start, end) by where they lie, for questions about a stretch of the text."""

    def __init__(self, spans: list[Span]):
        self.spans = sorted(spans, key=lambda s: (s[1], s[2]))
        self.starts = [s[1] for s in self.spans]
        self.ends = list(accumulate((s[2] for s in self.spans), max))  # the furthest end so far

    def over(self, a: int, b: int) -> Iterator[Span]:
        """The spans that overlap [a, b), from the right."""
        k = bisect_left(self.starts, b) - 1
        while k >= 0 and self.ends[k] > a:
            if self.spans[k][2] > a:
                yield self.spans[k]
            k -= 1

    def any(self, a: int, b: int) -> bool:
        return next(self.over(a, b), None) is not None


def span_list(spans: list[Span], kinds: tuple[str, ...]) -> str:
    """kind:start:end, by start, then kind in the order of ``kinds``, then end."""
    order = {k: i for i, k in enumerate(kinds)}
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], order[s[0]], s[2])))


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
