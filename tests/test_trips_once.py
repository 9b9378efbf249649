"""Queries on pairs of trips read the table of trips, not the lines it was made from, again and again."""

from wayveil.plans import catalog


def test_pairs_of_trips_read_trips_that_were_made_once(spark):
    found = catalog.queries()["t5_lcrs_next"](spark, "/root/testdata/sf0.001")
    assert "l_orderkey" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert found.count() > 0
