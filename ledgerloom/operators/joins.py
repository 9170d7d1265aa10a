"""Join helpers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` marked to be joined by shuffle and merge, whatever the planner takes its size to be.

    The planner goes by the written size, in which repeated values count once, and takes an exploded table to be as large as
    before; so it may broadcast, by way of the driver, many times what its threshold says.
    """
    return df.hint("merge")


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join on ``keys`` where NULL equals NULL; the result has the left keys once."""
    other = right.withColumnsRenamed({k: f"__{k}" for k in keys})
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])
    return left.join(other, same, how).drop(*[f"__{k}" for k in keys])
