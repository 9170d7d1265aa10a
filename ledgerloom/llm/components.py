"""Problem 3: consolidating pairwise matches into groups by seed-tree pruning.

Every round, vertices connect to the minima of their neighbourhoods; a vertex that is nobody's
minimum drops out of the graph and hangs below the smallest minimum it saw, in a propagation
forest. What stays are fewer vertices each round, in the end one seed per group (its smallest
vertex); seed identifiers then flow down the forest, last round first.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.skew import lookup
from ..session import cut, table


def components(pairs: DataFrame, a: str, b: str, vertex: str = "node", group: str = "group") -> DataFrame:
    """One row (``vertex``, ``group``) for each value in columns ``a`` and ``b``; group = smallest member.

    Pairs with a NULL end are no links and add no vertex. A pair of a value with itself adds that
    vertex alone. Repeated pairs count once. An empty table gives an empty result. Other columns of
    ``pairs`` are ignored, whatever their names.
    """
    links = pairs.select(pairs[a].alias("u"), pairs[b].alias("v")).where("u IS NOT NULL AND v IS NOT NULL")
    edges = cut(links.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    everyone = edges.select(F.explode(F.array("u", "v")).alias("v")).distinct()
    forest = []
    edges = both_ways(edges.where("u <> v"))
    while total := edges.count():
        mins = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).withColumn("m", F.least("u", "m"))
        proposed = lookup(edges, "u", mins, "n", total).select("v", "m").unionByName(mins.select(F.col("u").alias("v"), "m")).distinct()
        proposed = cut(proposed)
        best = proposed.groupBy("v").agg(F.min("m").alias("best"), F.max(F.col("m") == F.col("v")).alias("stays"), F.count("*").alias("n"))
        kept = lookup(proposed, "v", best, "n", 2 * total).where("m <> best").select(F.col("m").alias("u"), F.col("best").alias("v"))
        forest.append(cut(best.where("NOT stays").select("v", F.col("best").alias("parent"))))
        edges = cut(both_ways(kept.distinct()))
    dropped = reduce(DataFrame.unionByName, [level.select("v") for level in forest], everyone.limit(0))
    settled = everyone.join(dropped, "v", "left_anti").select("v", F.col("v").alias("seed"))
    for level in reversed(forest):
        children = level.count()
        sizes = level.groupBy("parent").agg(F.count("*").alias("n"))
        seeds = sizes.join(settled.withColumnRenamed("v", "parent"), "parent")
        settled = cut(settled.unionByName(lookup(level, "parent", seeds, "n", children).select("v", "seed")))
    return settled.select(F.col("v").alias(vertex), F.col("seed").alias(group))


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.u", "e.v").distinct()


def counted_links(links: DataFrame, candidates: DataFrame) -> DataFrame:
    """Links (left_key, right_key) whose candidate is current, with keys written alike.

    A link without digits in its EIN, or without an external system or identifier, has no key and
    does not count; digits are filled up to nine with zeros on the left.
    """
    current = candidates.where("is_current = 1").select("candidate_id").where("candidate_id IS NOT NULL").distinct()
    digits = F.regexp_replace("ein", "[^0-9]", "")
    digits = F.when(F.length(digits) < 9, F.lpad(digits, 9, "0")).otherwise(digits)
    outer = F.trim("external_source_record_id")
    return (
        links.where(F.length(F.regexp_replace("ein", "[^0-9]", "")) > 0)
        .where(F.length(outer) > 0)
        .join(current, "candidate_id", "left_semi")
        .select(F.concat(F.lit("ein:"), digits).alias("left_key"), F.lower(F.concat(F.trim("external_source_system"), F.lit(":"), outer)).alias("right_key"))
        .where("left_key IS NOT NULL AND right_key IS NOT NULL")
    )


def p3_found(spark, sf_dir: str) -> DataFrame:
    links = counted_links(table(spark, sf_dir, "approved_external_entity_links"), table(spark, sf_dir, "entity_match_candidates"))
    return components(links, "left_key", "right_key", "record_key", "group_key")


P3_FOUND_SQL = """
WITH RECURSIVE links AS (
  SELECT DISTINCT 'ein:' || lpad(regexp_replace(l.ein, '[^0-9]', '', 'g'), 9, '0') AS a,
         lower(trim(l.external_source_system) || ':' || trim(l.external_source_record_id)) AS b
  FROM approved_external_entity_links l JOIN entity_match_candidates c ON c.candidate_id = l.candidate_id AND c.is_current = 1
  WHERE length(regexp_replace(l.ein, '[^0-9]', '', 'g')) > 0 AND length(trim(l.external_source_record_id)) > 0
), edges AS (SELECT a AS u, b AS v FROM links UNION SELECT b, a FROM links),
reach(s, v) AS (SELECT u, u FROM edges UNION SELECT r.s, e.v FROM reach r JOIN edges e ON e.u = r.v)
SELECT v AS record_key, min(s) AS group_key FROM reach GROUP BY v
"""
