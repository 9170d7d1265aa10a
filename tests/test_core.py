import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import text as T
from ledgerloom.operators import entities, graph, relational, similarity, skew


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_bill_references(spark):
    refs = one(spark, T.bill_refs(F.lit("HR 824 and S1001, plus H.J.Res. 5; HR 824 again")))
    assert [(r.bill_type, r.bill_number) for r in refs] == [("hr", 824), ("s", 1001), ("hjres", 5)]
    assert one(spark, T.bill_refs(F.lit(None).cast("string"))) is None


@pytest.mark.parametrize(
    ("given", "kept"),
    [(" WWW.Example.org ", "https://www.example.org/"), ("hhtp://a.b", "http://a.b/"), ("n/a", None), ("me@x.org", None), ("localhost", None), (None, None), ("see below.com", None), ("http:/x.org/a?b=1", "http://x.org/a?b=1"), ("https//x.org", "https://x.org/"), ("ftp://x.org", None), ("-x.org", None), ("10.0.0.1:80/p#f", "https://10.0.0.1:80/p"), ("httpbin.org", "https://httpbin.org/"), ("a..b", None)],
)
def test_addresses_of_pages(spark, given, kept):
    assert one(spark, T.url_key(F.lit(given).cast("string"))) == kept


def test_jaro_winkler():
    assert T.jaro_winkler("martha", "marhta") == pytest.approx(0.961111, abs=1e-6)
    assert T.jaro_winkler("abcx", "abzzzzzz") == pytest.approx(0.583333, abs=1e-6)
    assert T.jaro_winkler("", "") == 0.0
    assert T.jaro_winkler(None, "a") is None


def test_name_profile(spark):
    p = one(spark, T.name_profile(F.lit("The Café & Sons of North America, Inc.")))
    assert p.normalized == "cafe sons north america" and p.core == ["cafe", "sons"] and p.qualifiers == ["north", "america"]
    assert one(spark, T.name_profile(F.lit(None).cast("string"))).normalized == ""


def test_padding_never_cuts(spark):
    assert one(spark, T.filled(F.lit("12"), 4)) == "0012" and one(spark, T.filled(F.lit("12345"), 4)) == "12345"


def test_zip_scores(spark):
    assert [one(spark, T.zip_score(F.lit("12345"), F.lit(z))) for z in ("12345", "12340", "12399", "99999")] == [100, 90, 80, 0]
    assert one(spark, T.zip_score(F.lit("12345"), F.lit(None).cast("string"))) == 0


def test_identity_tiers(spark):
    o = spark.createDataFrame(
        [(1, "IRS990", "Blue River Trust", "1 Main Street", "X", "NY", "10001"), (2, "LDA", "BLUE RIVER TRUST INC", "1 main st", "x", "ny", "10001-1234"), (3, "FEC", "Blue River Trust PAC", None, None, "CA", None), (4, "LDA", None, None, None, None, None)],
        "observation_id long, source_system string, observed_name string, address string, city string, state string, zip_code string",
    )
    got = {r.r_id: (r.tier, r.score) for r in entities.exact_candidates(o).collect()}
    assert got == {2: ("corroborated", 1.0), 3: ("conflicting_location", 0.84)}


def test_upsert_and_friends(spark):
    old = spark.createDataFrame([(1, "a", "p"), (2, "b", "q")], "k int, v string, w string")
    new = spark.createDataFrame([(2, "B"), (3, "C")], "k int, v string")
    assert rows(relational.upsert(old, new, ["k"])) == [(1, "a", "p"), (2, "B", "q"), (3, "C", None)]
    again = relational.upsert(relational.upsert(old, new, ["k"]), new, ["k"])
    assert rows(again) == rows(relational.upsert(old, new, ["k"]))
    assert rows(relational.insert_ignore(old.select("k", "v"), new, ["k"])) == [(1, "a"), (2, "b"), (3, "C")]
    assert rows(relational.replace_children(old.select("k", "v"), new, "k")) == [(1, "a"), (2, "B"), (3, "C")]
    assert rows(relational.changed_rows(old.select("k", "v"), new, ["k"], ["v"])) == [(2, "B")]


def test_rank_share_and_mode(spark):
    df = spark.createDataFrame([(1.0,), (1.0,), (2.0,), (None,)], "v double")
    assert rows(relational.rank_share("v", "r", df)) == sorted([(1.0, 0.5), (1.0, 0.5), (2.0, 1.0), (None, None)], key=repr)
    m = spark.createDataFrame([("g", "b"), ("g", "a"), ("g", None), ("g", None), ("g", None)], "g string, v string")
    assert rows(relational.most_frequent(m, ["g"], "v", "mode")) == [("g", "a")]


def test_skewed_lookup_keeps_every_row(spark, monkeypatch):
    monkeypatch.setattr(skew, "ONE_TASK", 10)
    monkeypatch.setattr(skew, "HEAVY", 5)
    facts = spark.range(1000).select(F.when(F.col("id") < 700, 0).otherwise(F.col("id")).alias("k"), "id")
    per = facts.groupBy("k").agg(F.count("*").alias("n")).withColumn("label", F.col("k") * 2)
    got = skew.lookup(facts, "k", per, "n", 1000)
    assert got.count() == 1000 and got.where("label <> k * 2").count() == 0


def edges(spark, pairs):
    return spark.createDataFrame([(a, b, 1.0) for a, b in pairs], "src string, dst string, weight double")


def test_graph_operators(spark):
    e = edges(spark, [("a", "b"), ("b", "c"), ("d", "e")])
    assert sum(r.rank for r in graph.pagerank(e, 30).collect()) == pytest.approx(1.0, abs=1e-9)
    assert rows(graph.smallest_labels(e)) == [("a", "a"), ("b", "a"), ("c", "a"), ("d", "d"), ("e", "d")]
    assert dict(rows(graph.betweenness(edges(spark, [("a", "b"), ("b", "c")])))) == {"a": 0.0, "b": 1.0, "c": 0.0}


@pytest.mark.parametrize("most", [1000, 0])
def test_proximity_settles_for_all_seeds(spark, most):
    # x - y without weight: x has no way on; z is no seed's neighbour
    data = [("a", "b", 3.0), ("a", "c", 1.0), ("b", "a", 2.0), ("c", "d", 5.0), ("d", "a", 1.0), ("d", "x", 1.0), ("x", "y", 0.0), ("z", "z", 1.0)]
    e = spark.createDataFrame(data, "src string, dst string, weight double")
    got = dict(rows(graph.seed_proximity(e, spark.createDataFrame([("a",), ("x",), ("none",)], "node string"), most=most)))
    step = {"a": {"b": 0.75, "c": 0.25}, "b": {"a": 1.0}, "c": {"d": 1.0}, "d": {"a": 0.5, "x": 0.5}, "x": {}, "y": {}, "z": {"z": 1.0}}
    want = dict.fromkeys(step, 0.0)
    for s in ("a", "x"):
        ranks = {s: 1.0}
        for _ in range(400):
            after = dict.fromkeys(step, 0.0)
            for n, r in ranks.items():
                for m, part in (step[n] or {s: 1.0}).items():
                    after[m] += 0.85 * r * part
            after[s] += 0.15
            ranks = after
        for n, r in ranks.items():
            want[n] += r * (n != s)
    assert got == pytest.approx(want, abs=1e-4)


def test_term_cosine(spark):
    df = spark.createDataFrame([("x", "clean water for rivers"), ("y", "clean water for rivers"), ("z", "tax reform"), ("n", None)], "k string, t string")
    w = similarity.term_weights(df, "k", "t")
    got = {(r.a, r.b): round(r.cosine, 6) for r in similarity.cosine_pairs(w.withColumnRenamed("k", "a"), w.withColumnRenamed("k", "b"), "a", "b").collect()}
    assert got[("x", "y")] == 1.0 and ("x", "z") not in got
