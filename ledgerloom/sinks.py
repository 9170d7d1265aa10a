"""Writing tables: sorted for pruning, by run, and with a manifest."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_sorted(df: DataFrame, path: str, keys: list[str], rows_per_file: int = 5_000_000) -> None:
    """Parquet in ranges of ``keys``, sorted inside, so that readers skip row groups by their bounds."""
    df.repartitionByRange(*keys).sortWithinPartitions(*keys).write.mode("overwrite").option("compression", "zstd").option("maxRecordsPerFile", rows_per_file).parquet(path)


def write_lookups(df: DataFrame, path: str, a: str, b: str) -> None:
    """The same set sorted by (a, b) and by (b, a), for lookups from either side."""
    pairs = df.distinct()
    write_sorted(pairs, f"{path}_by_{a}", [a, b])
    write_sorted(pairs, f"{path}_by_{b}", [b, a])


def write_by_year(df: DataFrame, path: str, rows_per_file: int = 5_000_000) -> None:
    """A folder per year, for the first year column there is; rows without a year get their own; without a year column one folder."""
    year = next((c for c in ("tax_year", "filing_year", "cycle", "year", "last_report_year") if c in df.columns), None)
    writer = df.write.mode("overwrite").option("compression", "zstd").option("maxRecordsPerFile", rows_per_file)
    (writer.partitionBy(year) if year else writer).parquet(path)


def write_run(df: DataFrame, path: str, run_id: str, version: str, generated_at: str) -> None:
    """One run's rows, replacing that run alone, and a line in the list of runs."""
    if df.isEmpty():
        raise ValueError("a run without rows is not written")
    df.withColumn("run_id", F.lit(run_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(path)
    spark = df.sparkSession
    line = json.dumps({"run_id": run_id, "version": version, "generated_at": generated_at})
    spark.createDataFrame([(run_id, version, generated_at, line)], "run_id string, version string, generated_at string, manifest string").write.mode("append").parquet(f"{path}_runs")


def latest_run(spark: SparkSession, path: str, version: str) -> str | None:
    """The run of a version generated last; ties by its name."""
    runs = spark.read.parquet(f"{path}_runs").where(F.col("version") == version)
    return runs.agg(F.max(F.struct("generated_at", "run_id"))["run_id"]).first()[0]


def replaced(df: DataFrame, path: str) -> None:
    """Write ``df`` beside ``path`` and put it there only when it is whole; readers see the old table or the new one, and a failed write leaves the old one."""
    spark = df.sparkSession
    jvm = spark._jvm
    new, old = f"{path}.new-{uuid.uuid4().hex}", f"{path}.old-{uuid.uuid4().hex}"
    at = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    system = at(path).getFileSystem(spark._jsc.hadoopConfiguration())
    try:
        df.write.parquet(new)
    except Exception:
        system.delete(at(new), True)
        raise
    if system.exists(at(path)):
        system.rename(at(path), at(old))
    system.rename(at(new), at(path))
    system.delete(at(old), True)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV parts with headers, texts quoted where they must be."""
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def export_run(scores: DataFrame, filings: DataFrame, path: str) -> None:
    """The scores of one run with the names of their filers; without scores, or without a filing for any of them, it is an error."""
    df = scores.join(filings.select("filing_id", "filer_name"), "filing_id")
    if scores.isEmpty() or df.isEmpty():
        raise ValueError("no scores, or no filings of theirs")
    replaced(df, path)


def import_run(spark: SparkSession, path: str, columns: list[str], version: str) -> DataFrame:
    """An exported run: it must have ``columns`` and one run_id; it counts as of ``version``."""
    df = spark.read.parquet(path)
    if missing := [c for c in [*columns, "run_id"] if c not in df.columns]:
        raise ValueError(f"columns are missing: {missing}")
    if df.select("run_id").distinct().limit(2).count() != 1:
        raise ValueError("not exactly one run")
    return df.withColumn("version", F.lit(version))
