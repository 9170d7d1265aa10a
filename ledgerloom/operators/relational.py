"""Relational operators that Spark has no single call for."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..session import cut


def first_per_group(df: DataFrame, group: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first ``n`` rows of each group in ``order``; Spark keeps only n per task before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return df.withColumn("__rank", rank).where(F.col("__rank") <= n).drop("__rank")


def most_frequent(df: DataFrame, group: list[str], value: str, out: str) -> DataFrame:
    """The value that each group has most often, ties by the smaller; NULL values don't count."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count("*").alias("n"))
    return counts.groupBy(*group).agg(F.min(F.struct((-F.col("n")).alias("n"), value))[value].alias(out))


def running(df: DataFrame, order: str, sums: dict[str, str], descending: bool = False) -> DataFrame:
    """``df`` (one row per value of ``order``) with running sums (column -> name) in that order, and nothing in one task.

    Ranges of values are cumulated each for itself; the sums of the ranges before are added. These are one row per task.
    """
    by = F.desc(order) if descending else F.asc(order)
    parts = cut(df.repartitionByRange(by).withColumn("__part", F.spark_partition_id()))
    whole = parts.groupBy("__part").agg(*[F.sum(c).alias(f"__{c}") for c in sums]).collect()
    before, total = {}, dict.fromkeys(sums, 0)
    for r in sorted(whole, key=lambda r: r["__part"]):
        before[r["__part"]] = dict(total)
        total = {c: total[c] + (r[f"__{c}"] or 0) for c in sums}
    within = Window.partitionBy("__part").orderBy(by)
    for c, name in sums.items():
        offset = F.element_at(F.create_map(*[F.lit(x) for p, t in before.items() for x in (p, t[c])]), F.col("__part")) if before else F.lit(0)
        parts = parts.withColumn(name, F.sum(c).over(within) + offset)
    return parts.drop("__part")


def rank_share(value: str, out: str, df: DataFrame) -> DataFrame:
    """Average rank of equal values over the number of rows, computed from counts per value."""
    counts = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("__n"))
    total = df.where(F.col(value).isNotNull()).count()
    upto = running(counts, value, {"__n": "__upto"})
    ranks = upto.select(value, ((F.col("__upto") - F.col("__n") + 1 + F.col("__upto")) / 2 / F.lit(max(1, total))).alias(out))
    return df.join(ranks, value, "left")


def placed_in_order(df: DataFrame, key: str, value: str, out: str = "place") -> DataFrame:
    """``df`` with the place 1..n of each row by ``value`` from the top, ties by ``key`` (unique); NULL values come last."""
    order = F.struct(F.col(value).isNotNull().alias("has"), F.col(value).alias("v"), F.struct(F.col(key)).alias("k"))
    ranked = running(df.select(key, order.alias("__o"), F.lit(1).alias("__one")), "__o", {"__one": "__from_below"})
    n = df.count()
    return df.join(ranked.select(key, (n + 1 - F.col("__from_below")).alias(out)), key)


def with_total(df: DataFrame, keys: list[str], aggs: list[Column], label: str = "TOTAL") -> DataFrame:
    """One row per key and a row over all, with ``label`` in the keys; distinct counts are counted anew for it."""
    detail = df.groupBy(*[F.col(k).cast("string").alias(k) for k in keys]).agg(*aggs)
    total = df.agg(*aggs).select(*[F.lit(label).alias(k) for k in keys], "*")
    return detail.unionByName(total)


def upsert(old: DataFrame, new: DataFrame, keys: list[str], columns: list[str] | None = None) -> DataFrame:
    """``old`` with the rows of ``new`` put in: rows with a known key take over ``columns`` (all of ``new``), others are added."""
    columns = columns or [c for c in new.columns if c not in keys]
    fresh = new.select(*[F.col(k).alias(f"__k{n}") for n, k in enumerate(keys)], *[F.col(c).alias(f"__{c}") for c in columns], F.lit(True).alias("__new"))
    joined = old.join(fresh, [old[k].eqNullSafe(F.col(f"__k{n}")) for n, k in enumerate(keys)], "full")
    pick = lambda c: F.when(F.col("__new"), F.col(f"__{c}")).otherwise(old[c]).alias(c)
    return joined.select(*[F.coalesce(old[c], F.col(f"__k{keys.index(c)}")).alias(c) if c in keys else pick(c) if c in columns else old[c] for c in old.columns])


def insert_ignore(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` and those rows of ``new`` whose key it lacks, each key once."""
    return old.unionByName(new.dropDuplicates(keys).join(old.select(*keys), keys, "left_anti"), allowMissingColumns=True)


def replace_children(old: DataFrame, new: DataFrame, parent: str) -> DataFrame:
    """``old`` without the rows of the parents in ``new``, and ``new``."""
    return old.join(new.select(parent).distinct(), parent, "left_anti").unionByName(new, allowMissingColumns=True)


def aligned(df: DataFrame, schema: T.StructType) -> DataFrame:
    """``df`` with exactly the columns of ``schema``: missing ones NULL, others cast where possible."""
    return df.select(*[(df[f.name].try_cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema])


def changed_rows(old: DataFrame, new: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Rows of ``new`` whose key ``old`` has with other values; NULL equals NULL."""
    differs = reduce(lambda a, b: a | b, [~F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}")) for c in columns])
    same = reduce(lambda a, b: a & b, [F.col(f"o.{k}") == F.col(f"n.{k}") for k in keys])
    return new.alias("n").join(old.alias("o"), same).where(differs).select("n.*")


def at_either_end(pairs: DataFrame, left: str, right: str, ids: DataFrame, id_: str) -> DataFrame:
    """Rows of ``pairs`` of which either end is in ``ids``, by an equi-join over both ends."""
    ends = pairs.withColumn("__end", F.explode(F.array(left, right)))
    return ends.join(ids.select(F.col(id_).alias("__end")).distinct(), "__end", "left_semi").drop("__end").distinct()


def ingest_outcomes(manifest: DataFrame, incoming: DataFrame, version: str) -> DataFrame:
    """(source_object_id, outcome) of incoming files: skipped if done with this version, conflict if the content differs, else pending."""
    m = manifest.select("source_object_id", F.col("content_sha256").alias("old_sha"), "parser_version", "ingest_status")
    joined = incoming.join(m, "source_object_id", "left")
    outcome = (
        F.when(F.col("old_sha").isNotNull() & (F.col("old_sha") != F.col("content_sha256")), "conflict")
        .when((F.col("parser_version") == version) & (F.col("ingest_status") == "succeeded"), "skipped")
        .otherwise("pending")
    )
    return joined.select("source_object_id", outcome.alias("outcome"))
