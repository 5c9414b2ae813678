"""Every registered query with an oracle gives the oracle's rows."""

from __future__ import annotations

import math

import pytest

from geoloom.plans import catalog, catalog_more, catalog_network, catalog_shapes, catalog_weights  # noqa: F401


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "-"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (int, float)) or type(value).__name__ == "Decimal":
        return f"{float(value):.4f}".replace("-0.0000", "0.0000")
    return str(value).removesuffix(" 00:00:00")


def rows(names, found):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in found)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_matches_oracle(spark, duck, sf, name):
    own = catalog.QUERIES[name](spark, sf)
    told = duck.sql(catalog.ORACLES[name])
    assert sorted(own.columns) == sorted(told.columns)
    assert rows(own.columns, own.collect()) == rows(told.columns, told.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_runs(spark, sf, name):
    assert catalog.QUERIES[name](spark, sf).collect()
