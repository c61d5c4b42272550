"""The report of missing slots holds all of them, however many there are."""

from tidemark.plans.catalog import ORACLE_SQL, QUERIES
from tidemark.plans.known_then import slots
from tidemark.plans.registry import Tables

SF = "/root/testdata/sf0.001"


def test_every_missing_slot_is_there(spark):
    expected = slots(Tables(spark, SF)).filter("status <> 'available'").count()
    got = QUERIES["q08_missing_slots"](spark, SF)
    assert expected > 50 and got.count() == expected
    assert [r["total"] for r in got.select("total").distinct().collect()] == [expected]
    assert "limit" not in ORACLE_SQL["q08_missing_slots"].lower()
