"""The same shapes of question over the star-schema tables: people, related parties, channels and events stand in for record types that the domain tables lack."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.relational import running, first_per_group, most_frequent
from ..operators.similarity import dot
from ..session import table


def part_buyers(spark, sf_dir: str, most: int = 8) -> DataFrame:
    """Shared-person shape: for each part name up to ``most`` of the customers it went to, by key."""
    bought = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    pairs = bought.join(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, sf_dir, "part").select("p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey"))
    return first_per_group(pairs.select("p_name", "o_custkey").distinct(), ["p_name"], [F.asc("o_custkey")], most)


def related_suppliers(spark, sf_dir: str) -> DataFrame:
    """Related-party shape: customers and suppliers joined by returned lines, with counts."""
    back = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select("l_orderkey", "l_suppkey")
    both = back.join(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    return both.groupBy("o_custkey", "l_suppkey").agg(F.count("*").alias("n_lines"))


def largest_related(spark, sf_dir: str) -> DataFrame:
    """Filter-on-the-right shape: for each supplier the largest balance among customers of its own nation in one segment, if there is any."""
    c = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").groupBy(F.col("c_nationkey").alias("s_nationkey")).agg(F.max("c_acctbal").alias("largest"), F.count("*").alias("n_customers"))
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    return s.join(c, "s_nationkey", "left").select("s_suppkey", "s_nationkey", "largest", F.coalesce("n_customers", F.lit(0)).alias("n_customers"))


def channel_mode(spark, sf_dir: str) -> DataFrame:
    """The event type that each user has most often, ties by name."""
    return most_frequent(table(spark, sf_dir, "events"), ["user_id"], "event_type", "event_type_mode")


def event_payloads(spark, sf_dir: str) -> DataFrame:
    """Numbers in the payload by event type: how many there are, and their sum."""
    e = table(spark, sf_dir, "events").select("event_type", F.get_json_object("props", "$.k").try_cast("double").alias("k"))
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.count("k").alias("n_k"), F.round(F.sum("k"), 4).alias("sum_k"))


def priority_pivot(spark, sf_dir: str) -> DataFrame:
    """Orders by year and status as columns, with 0 where there are none."""
    o = table(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("year"), "o_orderstatus")
    return o.groupBy("year").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count(F.lit(1))).na.fill(0).withColumnsRenamed({"F": "n_f", "O": "n_o", "P": "n_p"})


def price_ecdf(spark, sf_dir: str) -> DataFrame:
    """The share of parts that cost at most as much, for each price."""
    counts = table(spark, sf_dir, "part").groupBy(F.col("p_retailprice").alias("price")).agg(F.count("*").alias("n"))
    total = table(spark, sf_dir, "part").where("p_retailprice IS NOT NULL").count()
    return running(counts, "price", {"n": "upto"}).select("price", F.round(F.col("upto") / F.lit(max(1, total)), 8).alias("share"))


def nearest_embeddings(spark, sf_dir: str, top: int = 5, every: int = 50) -> DataFrame:
    """The ``top`` nearest vectors by cosine of each stated query vector (ids divisible by ``every``), against all rows, in blocks."""
    e = table(spark, sf_dir, "embeddings")
    key = e.columns[0]
    v = e.select(F.col(key).alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    v = v.withColumn("v", F.transform("v", lambda x: x / F.sqrt(dot(F.col("v"), F.col("v")))))
    q = v.where(F.col("id") % every == 0).select(F.col("id").alias("query"), F.col("v").alias("w"))
    blocks = spark.sparkContext.defaultParallelism
    pairs = v.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks))).join(q.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))), "block").where("id <> query")
    best = pairs.select("query", F.col("id").alias("neighbour"), F.round(dot(F.col("v"), F.col("w")), 6).alias("cosine"))
    return first_per_group(best, ["query"], [F.desc("cosine"), F.asc("neighbour")], top)


QUERIES = {f.__name__: f for f in (part_buyers, related_suppliers, largest_related, channel_mode, event_payloads, priority_pivot, price_ecdf, nearest_embeddings)}
SQL = {
    "part_buyers": "SELECT p_name, o_custkey FROM (SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY o_custkey) AS rn FROM (SELECT DISTINCT p_name, o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)) WHERE rn <= 8",
    "related_suppliers": "SELECT o_custkey, l_suppkey, count(*) AS n_lines FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'R' GROUP BY 1, 2",
    "largest_related": "SELECT s_suppkey, s_nationkey, max(c_acctbal) AS largest, count(c_custkey) AS n_customers FROM supplier LEFT JOIN customer ON c_nationkey = s_nationkey AND c_mktsegment = 'BUILDING' GROUP BY 1, 2",
    "channel_mode": "SELECT user_id, event_type AS event_type_mode FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS rn FROM (SELECT user_id, event_type, count(*) AS n FROM events WHERE event_type IS NOT NULL GROUP BY 1, 2)) WHERE rn = 1",
    "event_payloads": "SELECT event_type, count(*) AS n, count(TRY_CAST(props ->> '$.k' AS DOUBLE)) AS n_k, round(sum(TRY_CAST(props ->> '$.k' AS DOUBLE)), 4) AS sum_k FROM events GROUP BY 1",
    "priority_pivot": "SELECT CAST(year(o_orderdate) AS INTEGER) AS year, count(*) FILTER (o_orderstatus = 'F') AS n_f, count(*) FILTER (o_orderstatus = 'O') AS n_o, count(*) FILTER (o_orderstatus = 'P') AS n_p FROM orders GROUP BY 1",
    "price_ecdf": "SELECT DISTINCT p_retailprice AS price, round(cume_dist() OVER (ORDER BY p_retailprice), 8) AS share FROM part",
}
