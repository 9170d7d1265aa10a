"""What lies in a folder of tables, and what is still to be fetched."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from .files import pages

DISBURSEMENT_PAGE = "results array<struct<committee_id: string, sub_id: string, recipient_name: string, disbursement_amount: double, disbursement_date: string, disbursement_description: string>>"
DOMAIN = ["irs990_filings", "irs990_filing_grants", "lda_filings", "lda_filing_clients_sample_100", "lda_registrant_sample_100", "entity_observations", "entity_match_candidates", "approved_external_entity_links", "bills"]


def tables_in(spark: SparkSession, base: str) -> DataFrame:
    """(table_name, files, bytes) of the parquet tables in a folder of any file system, single files and folders of parts."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(base)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    rows = []
    for status in system.listStatus(path):
        name = status.getPath().getName()
        if name.endswith(".parquet"):
            held = system.getContentSummary(status.getPath())
            rows.append((name.removesuffix(".parquet"), int(held.getFileCount()), int(held.getLength())))
    return spark.createDataFrame(sorted(rows), "table_name string, files long, bytes long")


def columns_of(spark: SparkSession, base: str, names: list[str] | None = None) -> DataFrame:
    """(table_name, position, column_name, column_type) of the tables in a folder, or of those in ``names``."""
    names = names or [r.table_name for r in tables_in(spark, base).collect()]
    rows = [(n, k, f.name, f.dataType.simpleString()) for n in names for k, f in enumerate(table(spark, base, n).schema, 1)]
    return spark.createDataFrame(rows, "table_name string, position int, column_name string, column_type string")


def typed_csv(spark: SparkSession, path: str, schema: str, checks: dict[str, Callable[[], object]] | None = None, unique: list[str] | None = None) -> DataFrame:
    """A CSV with a header, read with ``schema``; rows that break one of ``checks`` (name -> condition Column) or repeat ``unique`` columns are an error."""
    df = spark.read.csv(path, header=True, schema=schema, mode="FAILFAST")
    for name, check in (checks or {}).items():
        if not df.where(~F.coalesce(check(), F.lit(False))).isEmpty():
            raise ValueError(f"{path}: {name}")
    if unique and not df.groupBy(*unique).agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        raise ValueError(f"{path}: {unique} repeat")
    return df


def disbursements(spark: SparkSession, path: str, committee_id: str | None = None) -> DataFrame:
    """Single disbursements from saved pages, each once; those of one committee, if it is given."""
    df = pages(spark, path, DISBURSEMENT_PAGE, "results").where("sub_id IS NOT NULL").dropDuplicates(["sub_id"])
    return df if committee_id is None else df.where(F.col("committee_id") == committee_id)


def bill_backfill(spark, sf_dir: str, most: int = 500) -> DataFrame:
    """Bills whose date or policy area is missing, those first that lobbying filings of their congress name; at most ``most``."""
    from ..plans.network import bill_links, congress

    f = table(spark, sf_dir, "lda_filings").select("filing_uuid", congress(F.col("filing_year")).alias("congress"))
    named = bill_links(spark, sf_dir).join(f, "filing_uuid").select("congress", "bill_type", "bill_number").distinct().withColumn("lobbied", F.lit(1))
    b = table(spark, sf_dir, "bills").where("introduced_date IS NULL OR policy_area IS NULL")
    b = b.join(named, ["congress", "bill_type", "bill_number"], "left").select("bill_id", F.coalesce("lobbied", F.lit(0)).alias("lobbied"))
    return b.orderBy(F.desc("lobbied"), "bill_id").limit(most)


def table_columns(spark, sf_dir: str) -> DataFrame:
    return columns_of(spark, sf_dir, DOMAIN).select("table_name", "position", "column_name")


QUERIES = {"table_columns": table_columns, "bill_backfill": bill_backfill}
_DOMAIN = "(" + ", ".join(f"'{n}'" for n in DOMAIN) + ")"
SQL = {"table_columns": f"SELECT table_name, CAST(ordinal_position AS INTEGER) AS position, column_name FROM information_schema.columns WHERE table_name IN {_DOMAIN}"}
