"""Tables from files: parquet folders that drift, registries in CSV, saved pages of JSON interfaces."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import blank_to_null, filled, number, zip5


def parquet_views(spark: SparkSession, base: str, names: list[str]) -> dict[str, DataFrame]:
    """Temporary views over the parquet folders that exist, columns united by name; missing ones are left out."""
    found = {}
    for name in names:
        try:
            df = spark.read.option("mergeSchema", True).parquet(f"{base}/{name}.parquet")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            continue
        df.createOrReplaceTempView(name)
        found[name] = df
    return found


def optional(df: DataFrame, name: str, kind: str = "string") -> Column:
    return (F.col(name) if name in df.columns else F.lit(None).cast(kind)).alias(name)


def registry(spark: SparkSession, path: str, amounts: tuple[str, ...] = ("asset_amt", "income_amt", "revenue_amt")) -> DataFrame:
    """A registry extract: all text trimmed, blank as NULL, EINs of nine digits, filler EINs dropped, amounts without commas; a later row of an EIN counts."""
    raw = spark.read.option("header", True).csv(path)
    df = raw.select(*[blank_to_null(F.col(c)).alias(c.lower()) for c in raw.columns]).withColumn("ein", filled(F.col("ein"), 9)).where("ein <> '000000000'")
    df = df.withColumns({c: number(F.col(c)) for c in amounts if c in df.columns})
    keep = [c for c in df.columns if c != "ein"]
    last = df.withColumn("__at", F.monotonically_increasing_id()).groupBy("ein").agg(F.max(F.struct("__at", *keep)).alias("r"))
    return last.select("ein", *[f"r.{c}" for c in keep])


def recovered_zips(spark: SparkSession, path: str) -> DataFrame:
    """(filing_uuid, client_id, state, zip5) of both addresses of each row of a recovery file."""
    df = spark.read.option("header", True).csv(path)
    both = F.array(*[F.struct(F.col(f"state_{n}").alias("state"), F.col(f"zip_{n}").alias("zip"), F.col(f"country_{n}").alias("country")) for n in (1, 2)])
    rows = df.select("filing_uuid", "client_id", F.inline(both)).where("country IS NULL OR upper(country) IN ('US', 'USA', 'UNITED STATES')")
    return rows.select("filing_uuid", "client_id", "state", zip5(F.col("zip")).alias("zip5")).where("zip5 IS NOT NULL").distinct()


LOBBYING_PAGE = """results array<struct<filing_uuid: string, filing_year: bigint, filing_period: string, income: string, expenses: string,
 client: struct<id: bigint, client_id: bigint, name: string, state: string>, registrant: struct<id: bigint, name: string>,
 lobbying_activities: array<struct<general_issue_code: string, description: string>>>>"""
BILL_PAGE = "bills array<struct<congress: bigint, type: string, number: string, title: string, introducedDate: string, latestAction: struct<text: string>, policyArea: struct<name: string>>>"
TOTALS_PAGE = "results array<struct<committee_id: string, committee_name: string, state: string, committee_state: string, committee_type: string, designation: string, party: string, cycle: bigint, receipts: double, disbursements: double, independent_expenditures: double, last_cash_on_hand_end_period: double>>"


def pages(spark: SparkSession, path: str, schema: str, field: str) -> DataFrame:
    """The records of saved response pages, one JSON object per file or line."""
    text = spark.read.text(path)
    return text.select(F.inline(F.from_json("value", schema)[field]))


def lobbying_filings(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Filings and their activities (by position, so that reading a page twice adds nothing) from saved pages."""
    raw = pages(spark, path, LOBBYING_PAGE, "results").dropDuplicates(["filing_uuid"])
    filings = raw.select("filing_uuid", F.col("client.name").alias("client_name"), F.coalesce("client.client_id", "client.id").cast("string").alias("client_id"), F.col("client.state").alias("client_state"), F.col("registrant.name").alias("registrant_name"), "filing_year", "filing_period", number(F.col("income")).alias("income"), number(F.col("expenses")).alias("expenses"))
    activities = raw.select("filing_uuid", F.posexplode("lobbying_activities").alias("position", "a")).select("filing_uuid", "position", "a.*")
    return filings, activities


def bills(spark: SparkSession, path: str) -> DataFrame:
    raw = pages(spark, path, BILL_PAGE, "bills").where("number IS NOT NULL")
    kind = F.lower("type")
    return raw.select(F.concat_ws("-", "congress", kind, "number").alias("bill_id"), "congress", kind.alias("bill_type"), F.col("number").try_cast("bigint").alias("bill_number"), "title", F.col("introducedDate").alias("introduced_date"), F.col("latestAction.text").alias("latest_action"), F.col("policyArea.name").alias("policy_area")).dropDuplicates(["bill_id"])


def committee_totals(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Committees, and one total row of disbursements for each committee and cycle."""
    raw = pages(spark, path, TOTALS_PAGE, "results")
    committees = raw.select("committee_id", F.col("committee_name").alias("name"), F.coalesce("state", "committee_state").alias("state"), "committee_type", "designation", "party", "cycle", F.col("receipts").alias("total_receipts"), F.col("disbursements").alias("total_disbursements"), "independent_expenditures", F.col("last_cash_on_hand_end_period").alias("cash_on_hand_end_period"))
    totals = raw.select(F.concat_ws("-", "committee_id", "cycle", F.lit("totals")).alias("sub_id"), "committee_id", F.lit("__CYCLE_TOTALS__").alias("recipient_name"), F.col("disbursements").alias("amount"))
    return committees, totals
