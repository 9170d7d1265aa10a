"""Tables that grow with the records never go through the driver."""

import pytest
from ledgerloom.llm import places


@pytest.fixture
def wide_threshold(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1g")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_spellings_and_homes_are_not_broadcast(spark, wide_threshold):
    spots = spark.createDataFrame([("NY", "ALBANY", 5), ("NY", "ALBANI", 1), ("NY", "TROY", 9)], "region string, town string, n long")
    fixes = places.settle(spots, "town", ["region"], 3)
    assert [tuple(r) for r in fixes.collect()] == [("NY", "ALBANI", "ALBANY")]
    step = places.corrections(spots, "town", ["region"], 3)
    columns = "place string, number string, street string, zip5 string, region string"
    placed = spark.createDataFrame([("NY|ALBANY", "1", "MAIN", "12207", "NY")], columns)
    late = places.settled_places(spark.createDataFrame([(None, "1", "MAIN", "12207", "NY")], columns).drop("place"), placed)
    assert [r.place for r in late.collect()] == ["NY|ALBANY"]
    found = spark.createDataFrame([("a", 1, "NY|ALBANY|1|MAIN||", "2"), ("b", 2, "NY|ALBANY|1|MAIN||", None)], "record_key string, w long, spot string, unit string")
    pairs = places.same_place_pairs(found)
    assert [tuple(r) for r in pairs.collect()] == [("a", "b")]
    for df in (step, late, pairs):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
