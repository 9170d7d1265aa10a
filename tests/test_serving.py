import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import html
from ledgerloom.operators import observations
from ledgerloom.plans import serving


def test_only_reading_statements_run(spark):
    assert serving.run_sql(spark, "SELECT :n AS x UNION ALL SELECT 2;", 1, {"n": 1}).count() == 1
    for bad in ("", "DROP TABLE t", "SELECT 1; SELECT 2", "WITH a AS (SELECT 1 AS x) INSERT INTO t SELECT * FROM a"):
        with pytest.raises(ValueError):
            serving.run_sql(spark, bad)


def test_pages(spark):
    page = "<p>Two words</p><script>no words</script><a href='/x#y'>go</a><a href='mailto:a@b.c'>m</a><td>City</td><td> New York</td>State NY Zip 10001-2 Country USA"
    df = spark.createDataFrame([("https://a.org/", page), (None, None)], "url string, html string")
    got = df.select(html.page_words("html").alias("w"), html.page_links("url", "html").alias("l"), html.page_addresses("html").alias("a")).collect()
    assert got[0].w > 4 and got[0].l == ["https://a.org/x"] and [tuple(a) for a in got[0].a] == [("NewYork", "NY", "10001-2", "USA")]
    assert got[1].w == 0 and got[1].l == [] and got[1].a == []


def test_changed_observations_retire_candidates(spark):
    c = "source_system string, source_record_id string, subject_role string, observed_name string, normalized_name string, native_identifier string, address string, city string, state string, zip_code string, irs_filing_id bigint, observed_at string"
    row = lambda k, name: ("LDA", k, "client", name, name, None, None, None, None, None, None, None)
    old = spark.createDataFrame([(1, *row("a", "x")), (2, *row("b", "y"))], "observation_id bigint, " + c)
    new = spark.createDataFrame([row("a", "X2"), row("b", "y"), row("c", "z")], c)
    pairs = spark.createDataFrame([(7, 1, 2, 1), (8, 2, 3, 1)], "candidate_id bigint, left_observation_id bigint, right_observation_id bigint, is_current bigint")
    obs, after = observations.synchronized(old, new, pairs)
    assert sorted((r.source_record_id, r.observed_name) for r in obs.collect()) == [("a", "X2"), ("b", "y"), ("c", "z")]
    assert obs.agg(F.count_distinct("observation_id")).first()[0] == 3
    assert sorted((r.candidate_id, r.is_current) for r in after.collect()) == [(7, 0), (8, 1)]
