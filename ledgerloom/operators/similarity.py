"""Text similarity by term weights, and vector similarity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut, table

# English words that carry no topic.
STOP_WORDS = "a about above after again against all am an and any are as at be because been before being below between both but by could did do does doing down during each few for from further had has have having he her here hers him his how i if in into is it its me more most my no nor not of off on once only or other our out over own same she should so some such than that the their them then there these they this those through to too under until up very was we were what when where which while who whom why will with would you your".split()


def terms(text: Column) -> Column:
    """Words of two and more letters without stop words, and pairs of neighbours among them."""
    w = F.filter(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"\b\w\w+\b"), 0), lambda t: ~F.array_contains(F.array(*[F.lit(s) for s in STOP_WORDS]), t))
    pairs = F.transform(F.slice(w, F.lit(1), F.greatest(F.size(w) - 1, F.lit(0))), lambda t, i: F.concat(t, F.lit(" "), F.get(w, i + 1)))
    return F.concat(w, pairs)


def term_weights(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term, weight): term frequency times ln((1 + n) / (1 + df)) + 1, scaled to unit length per text."""
    tf = cut(df.select(F.col(key).alias("k"), F.explode(terms(F.col(text))).alias("term")).groupBy("k", "term").agg(F.count("*").alias("tf")))
    return weighted(tf, df.select(key).distinct().count(), key)


def weighted(tf: DataFrame, n: int, key: str) -> DataFrame:
    """(key, term, weight) of counted terms (k, term, tf) of ``n`` texts."""
    idf = tf.groupBy("term").agg((F.log(F.lit(1.0 + n) / (1 + F.count("*"))) + 1).alias("idf"))
    w = tf.join(idf, "term").select("k", "term", (F.col("tf") * F.col("idf")).alias("w"))
    norm = w.groupBy("k").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return w.join(norm, "k").select(F.col("k").alias(key), "term", (F.col("w") / F.col("norm")).alias("weight"))


def cosine_pairs(left: DataFrame, right: DataFrame, left_key: str, right_key: str, least: float = 0.1) -> DataFrame:
    """(left_key, right_key, cosine) of two tables from ``term_weights``: a join on shared terms, no pair without one."""
    a, b = left.withColumnRenamed("weight", "wa"), right.withColumnRenamed("weight", "wb")
    return a.join(b, "term").groupBy(left_key, right_key).agg(F.sum(F.col("wa") * F.col("wb")).alias("cosine")).where(F.col("cosine") >= least)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def title_topics(spark, sf_dir: str) -> DataFrame:
    """How near each bill's title is to each policy area's titles taken together, by term weights."""
    b = table(spark, sf_dir, "bills").where("title IS NOT NULL")
    found = cut(b.select("bill_id", "policy_area", F.explode(terms(F.col("title"))).alias("term")).groupBy("bill_id", "policy_area", "term").agg(F.count("*").alias("tf")))
    # an area's terms are counted from those of its bills, so its titles never come together in one row
    areas = found.where("policy_area IS NOT NULL").groupBy(F.concat(F.lit("a:"), "policy_area").alias("k"), "term").agg(F.sum("tf").alias("tf"))
    n = b.select("bill_id").distinct().count() + b.where("policy_area IS NOT NULL").select("policy_area").distinct().count()
    both = cut(weighted(cut(found.select(F.concat(F.lit("b:"), "bill_id").alias("k"), "term", "tf").unionByName(areas)), n, "key"))
    left = both.where("key LIKE 'b:%'").select(F.expr("substring(key, 3)").alias("bill_id"), "term", "weight")
    right = both.where("key LIKE 'a:%'").select(F.expr("substring(key, 3)").alias("policy_area"), "term", "weight")
    return cosine_pairs(left, right, "bill_id", "policy_area").select("bill_id", "policy_area", F.round("cosine", 6).alias("cosine"))


QUERIES = {"title_topics": title_topics}
_STOP = "(" + ", ".join(f"'{w}'" for w in STOP_WORDS) + ")"
SQL = {
    "title_topics": f"""WITH w AS (SELECT bill_id, policy_area, list_filter(regexp_extract_all(lower(title), '\\b\\w\\w+\\b'), lambda t: t NOT IN {_STOP}) AS w FROM bills WHERE title IS NOT NULL),
 t AS (SELECT bill_id, policy_area, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM w),
 tf AS (SELECT 'b:' || bill_id AS k, term, count(*) AS tf FROM t GROUP BY ALL UNION ALL SELECT 'a:' || policy_area, term, count(*) FROM t WHERE policy_area IS NOT NULL GROUP BY ALL),
 n AS (SELECT count(DISTINCT bill_id) + count(DISTINCT policy_area) AS n FROM bills WHERE title IS NOT NULL),
 idf AS (SELECT term, ln((1 + (SELECT n FROM n)) / (1 + count(*))) + 1 AS idf FROM tf GROUP BY 1),
 x AS (SELECT k, term, tf * idf AS w FROM tf JOIN idf USING (term)), m AS (SELECT k, sqrt(sum(w * w)) AS norm FROM x GROUP BY 1), v AS (SELECT k, term, w / norm AS w FROM x JOIN m USING (k))
 SELECT substring(a.k, 3) AS bill_id, substring(b.k, 3) AS policy_area, round(sum(a.w * b.w), 6) AS cosine FROM v a JOIN v b USING (term) WHERE a.k LIKE 'b:%' AND b.k LIKE 'a:%' GROUP BY 1, 2 HAVING sum(a.w * b.w) >= 0.1"""
}
