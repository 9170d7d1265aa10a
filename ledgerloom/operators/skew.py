"""Joins of a large table with one row per key, safe against keys that hold much of the table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is heavy when it holds more than one part in HEAVY of all rows, so fewer than HEAVY keys are.
HEAVY = 1000
#: So many rows are no burden for one task, even if all have the same key.
ONE_TASK = 1_000_000


def lookup(facts: DataFrame, key: str, per_key: DataFrame, count: str, total: int) -> DataFrame:
    """``facts`` joined with ``per_key`` (unique on ``key``; ``count`` = its rows in facts).

    Heavy keys are fewer than ``HEAVY`` by counting (their counts add up to ``total`` at most), so
    their rows of ``per_key`` are broadcast and their facts stay where they are; only facts of light
    keys are shuffled. Tables that one task could hold are joined as they are.
    """
    if total <= ONE_TASK:
        return facts.join(per_key, key).drop(count)
    at_most = total // HEAVY
    heavy = F.broadcast(per_key.where(F.col(count) > at_most))
    light = per_key.where(F.col(count) <= at_most)
    held = facts.join(heavy, key)
    rest = facts.join(F.broadcast(heavy.select(key)), key, "left_anti").join(light, key)
    return held.unionByName(rest).drop(count)
