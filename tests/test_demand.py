"""Demand and disruption measures on hand-checked cases."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from geoloom.operators import demand, routing


@pytest.fixture(scope="module")
def square(spark):
    rows = [(1, 2, 1.0), (2, 3, 1.0), (1, 4, 3.0), (4, 3, 3.0), (3, 5, 1.0)]
    trips = [(1, 3, 10.0), (1, 5, 5.0), (2, 3, 1.0)]
    return spark.createDataFrame(rows, "u long, v long, cost double"), spark.createDataFrame(trips, "o long, d long, flow double")


def test_attractions_are_scaled(spark):
    z = spark.createDataFrame([(1, 10.0, 2.0), (2, 20.0, None), (3, 30.0, 4.0)], "z int, p double, a double")
    got = {r["z"]: r["attraction"] for r in demand.productions_attractions(z, "p", "a").collect()}
    assert got == pytest.approx({1: 2 / 9 * 60, 2: 3 / 9 * 60, 3: 4 / 9 * 60})


def test_flows_share_out_the_production(spark):
    od = spark.createDataFrame([(1, 1, 1.0, 9.0, 1.0), (1, 2, 2.0, 9.0, 1.0), (1, 3, 4.0, 9.0, 1.0)], "o int, d int, cost double, p double, a double")
    got = {r["d"]: r["flow"] for r in demand.deterrence_flows(od, lambda c: 1 / c, "p", "a").collect()}
    assert got == pytest.approx({1: 0.0, 2: 6.0, 3: 3.0})


def test_products_combine(spark):
    f = spark.createDataFrame([("a", 1, 2, 3.0), ("b", 1, 2, 4.0), ("b", 2, 1, 1.0)], "product string, o int, d int, flow double")
    k = spark.createDataFrame([("a", 2.0), ("b", 0.5)], "product string, factor double")
    assert {(r["o"], r["d"]): r["flow"] for r in demand.combine_products(f, k).collect()} == {(1, 2): 8.0, (2, 1): 0.5}


def test_probit_without_spread_is_all_or_nothing(square):
    edges, trips = square
    got = {(r["u"], r["v"]): r["flow"] for r in demand.probit_assignment(edges, trips, 3, 0.0, 1).collect()}
    assert got == pytest.approx({(1, 2): 15.0, (2, 3): 16.0, (3, 5): 5.0})
    share = {(r["u"], r["v"]): r["betweenness"] for r in demand.betweenness(demand.probit_assignment(edges, trips, 2, 0.0, 1), trips).collect()}
    assert share[2, 3] == pytest.approx(1.0)


def test_probit_spreads_flow(square):
    edges, trips = square
    got = {(r["u"], r["v"]): r["flow"] for r in demand.probit_assignment(edges, trips, 20, 1.5, 7).collect()}
    assert got.get((1, 4), 0) > 0 and got[3, 5] == pytest.approx(5.0)


def test_broken_links_are_summed_up(square):
    edges, trips = square
    ends = lambda c: trips.select(F.col(c)).distinct()
    broken = routing.break_edges(edges, edges, ends("o"), ends("d"))
    got = {(r["edge_u"], r["edge_v"]): (r["extra"], r["isolated"]) for r in demand.criticality_summary(broken, trips).collect()}
    assert got[1, 2] == pytest.approx((60.0, 0.0)) and got[2, 3] == pytest.approx((60.0, 1.0)) and got[3, 5] == pytest.approx((0.0, 5.0))
    base = routing.od_matrix(edges, ends("o"), ends("d"))
    cases = broken.select(F.concat_ws(">", "edge_u", "edge_v").alias("scenario"), "o", "d", "cost")
    row = demand.disruption_summary(base, cases, trips).filter("scenario = '2>3'").first()
    assert row["isolated"] == pytest.approx(1 / 16) and row["slowed"] == pytest.approx(15 / 16)
