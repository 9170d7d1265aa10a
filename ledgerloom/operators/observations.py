"""Who was seen in which source: projecting observations, finding changes and retiring candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import name_profile
from ..session import table
from .relational import at_either_end, changed_rows, upsert

KEYS = ["source_system", "source_record_id", "subject_role"]
IDENTITY = ["observed_name", "normalized_name", "native_identifier", "address", "city", "state", "zip_code"]
COLUMNS = [*KEYS, *IDENTITY, "irs_filing_id", "observed_at"]


def projected(filings: DataFrame, lobbying: DataFrame, registry: DataFrame | None = None, committees: DataFrame | None = None) -> DataFrame:
    """Observations (``COLUMNS``) of filers, lobbying clients and committees; names from nowhere are left out.

    A filer's address falls back to the registry's, a client's identifier and state to the payload's.
    """
    f = filings.where("filer_name IS NOT NULL")
    place = {"address": "filer_address", "city": "filer_city", "state": "filer_state", "zip_code": "filer_zip_code"}
    if registry is not None:
        f = f.join(registry.select("ein", *[F.col(c).alias(f"m_{c}") for c in place]), "ein", "left")
    own = [F.coalesce(v, f"m_{c}").alias(c) if registry is not None else F.col(v).alias(c) for c, v in place.items()]
    lit, none = F.lit, lambda t: F.lit(None).cast(t)
    irs = f.select(lit("IRS990").alias("source_system"), F.col("source_object_id").alias("source_record_id"), lit("filer").alias("subject_role"), F.col("ein").alias("native_identifier"), F.col("filer_name").alias("observed_name"), *own, F.col("filing_id").alias("irs_filing_id"), F.col("return_timestamp").alias("observed_at"))
    c = lobbying.where("client_name IS NOT NULL")
    ident = F.coalesce("client_id", F.get_json_object("raw_json", "$.client.client_id"), F.get_json_object("raw_json", "$.client.id"))
    state = F.coalesce("client_state", F.get_json_object("raw_json", "$.client.state"))
    lda = c.select(lit("LDA").alias("source_system"), F.col("filing_uuid").alias("source_record_id"), lit("client").alias("subject_role"), ident.alias("native_identifier"), F.col("client_name").alias("observed_name"), F.col("client_address").alias("address"), F.col("client_city").alias("city"), state.alias("state"), F.col("client_zip_code").alias("zip_code"), none("bigint").alias("irs_filing_id"), none("string").alias("observed_at"))
    all_ = irs.unionByName(lda)
    if committees is not None:
        m = committees.where("name IS NOT NULL")
        fec = m.select(lit("FEC").alias("source_system"), F.col("committee_id").alias("source_record_id"), lit("committee").alias("subject_role"), F.col("committee_id").alias("native_identifier"), F.col("name").alias("observed_name"), none("string").alias("address"), none("string").alias("city"), "state", none("string").alias("zip_code"), none("bigint").alias("irs_filing_id"), none("string").alias("observed_at"))
        all_ = all_.unionByName(fec)
    return all_.withColumn("normalized_name", name_profile(F.col("observed_name"))["normalized"]).select(*COLUMNS)


def synchronized(old: DataFrame, new: DataFrame, candidates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(observations, candidates) after ``new`` came in: known observations are updated, others added under further ids, and candidates at either end of a changed one are no longer current."""
    changed = old.alias("o").join(changed_rows(old.select(*KEYS, *IDENTITY), new.select(*KEYS, *IDENTITY), KEYS, IDENTITY).select(*KEYS), KEYS, "left_semi").select("observation_id")
    lapsed = at_either_end(candidates.where("is_current = 1"), "left_observation_id", "right_observation_id", changed, "observation_id").select("candidate_id", F.lit(1).alias("__lapsed"))
    after = candidates.join(lapsed, "candidate_id", "left").withColumn("is_current", F.when(F.col("__lapsed") == 1, F.lit(0)).otherwise(F.col("is_current")).cast(candidates.schema["is_current"].dataType)).drop("__lapsed")
    merged = upsert(old, new, KEYS)
    top = F.max("observation_id").alias("__top")
    known = merged.where("observation_id IS NOT NULL")
    # ids are not consecutive, but unique and above all earlier ones
    fresh = merged.where("observation_id IS NULL").crossJoin(F.broadcast(old.agg(top))).withColumn("observation_id", F.coalesce("__top", F.lit(0)) + 1 + F.monotonically_increasing_id()).drop("__top")
    return known.unionByName(fresh), after


def projected_observations(spark, sf_dir: str) -> DataFrame:
    df = projected(table(spark, sf_dir, "irs990_filings"), table(spark, sf_dir, "lda_filings"))
    return df.select("source_system", "source_record_id", "native_identifier", "observed_name", "state", "zip_code")


def changed_observations(spark, sf_dir: str) -> DataFrame:
    """Stored observations that their sources now tell otherwise."""
    new = projected(table(spark, sf_dir, "irs990_filings"), table(spark, sf_dir, "lda_filings"))
    old = table(spark, sf_dir, "entity_observations")
    fields = ["observed_name", "native_identifier", "city", "state", "zip_code"]
    return changed_rows(old.select(*KEYS, *fields), new.select(*KEYS, *fields), KEYS, fields).select(*KEYS)


QUERIES = {"projected_observations": projected_observations, "changed_observations": changed_observations}
_NEW = """SELECT 'IRS990' AS source_system, source_object_id AS source_record_id, 'filer' AS subject_role, ein AS native_identifier, filer_name AS observed_name, filer_city AS city, filer_state AS state, filer_zip_code AS zip_code FROM irs990_filings WHERE filer_name IS NOT NULL
 UNION ALL SELECT 'LDA', filing_uuid, 'client', coalesce(client_id, CASE WHEN json_valid(raw_json) THEN coalesce(raw_json ->> '$.client.client_id', raw_json ->> '$.client.id') END), client_name, client_city, coalesce(client_state, CASE WHEN json_valid(raw_json) THEN raw_json ->> '$.client.state' END), client_zip_code FROM lda_filings WHERE client_name IS NOT NULL"""
SQL = {
    "projected_observations": f"SELECT source_system, source_record_id, native_identifier, observed_name, state, zip_code FROM ({_NEW})",
    "changed_observations": f"""SELECT n.source_system, n.source_record_id, n.subject_role FROM ({_NEW}) n JOIN entity_observations o USING (source_system, source_record_id, subject_role)
 WHERE o.observed_name IS DISTINCT FROM n.observed_name OR o.native_identifier IS DISTINCT FROM n.native_identifier OR o.city IS DISTINCT FROM n.city OR o.state IS DISTINCT FROM n.state OR o.zip_code IS DISTINCT FROM n.zip_code""",
}
