"""Problem 4: the N best items of every group, by a bounded heap per group.

``collect_top_k`` is Spark's own aggregate over a bounded priority queue: each task keeps at most N
items of a group before the shuffle, the queues of a group are merged after it, and no group is ever
gathered as a whole, however many items it has.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.internal import InternalFunction

from ..session import table


def top_n(df: DataFrame, group: str, score: list[str], item: str, n: int, rank: str = "rank") -> DataFrame:
    """The ``n`` rows of each non-NULL ``group`` with the highest ``score`` columns, ties by highest ``item``.

    Result: group, item and ``rank`` from 1. NULL scores come last. Rows with a NULL group are left
    out. A row that repeats (same scores and item) takes a place each time. Groups with fewer than
    ``n`` rows give all of them; an empty table gives an empty result; other columns are ignored.
    """
    if n < 1:
        raise ValueError("n must be at least 1")
    entry = F.struct(*[df[c].alias(f"s{k}") for k, c in enumerate(score)], df[item].alias("item"))
    best = df.where(df[group].isNotNull()).groupBy(df[group].alias("g")).agg(InternalFunction.collect_top_k(entry, n, False).alias("best"))
    return best.select(F.col("g").alias(group), F.posexplode("best").alias("p", "e")).select(group, F.col("e.item").alias(item), (F.col("p") + 1).alias(rank))


def p4_found(spark, sf_dir: str) -> DataFrame:
    return top_n(table(spark, sf_dir, "irs990_filings"), "ein", ["tax_period_end_date"], "filing_id", 3).drop("rank")


P4_FOUND_SQL = """
SELECT ein, filing_id FROM (
  SELECT ein, filing_id, row_number() OVER (PARTITION BY ein ORDER BY tax_period_end_date DESC NULLS LAST, filing_id DESC) AS rn
  FROM irs990_filings WHERE ein IS NOT NULL) WHERE rn <= 3
"""
