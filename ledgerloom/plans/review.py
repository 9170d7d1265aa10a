"""What reviewers decided and what follows: latest decisions, links to bills and committees, roll-ups of pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.relational import first_per_group
from ..session import cut, table
from . import network
from .network import activities, bill_facts


def latest_decisions(spark, sf_dir: str) -> DataFrame:
    """Of the decisions on each candidate the last one, ties by reviewer and rationale; links without a candidate are left out."""
    log = table(spark, sf_dir, "approved_external_entity_links").where("candidate_id IS NOT NULL")
    order = [F.desc_nulls_last("decided_at"), F.desc_nulls_last("reviewer"), F.desc_nulls_last("rationale"), F.desc_nulls_last("ein"), F.desc_nulls_last("external_source_record_id")]
    return first_per_group(log, ["candidate_id"], order).select("candidate_id", "reviewer", "rationale", "decided_at")


def _links(spark, sf_dir: str, source: str) -> DataFrame:
    """(ein, record): distinct links to records of a source whose candidate is current."""
    current = table(spark, sf_dir, "entity_match_candidates").where("is_current = 1").select("candidate_id")
    a = table(spark, sf_dir, "approved_external_entity_links").where(F.col("external_source_system") == source).join(current, "candidate_id", "left_semi")
    return a.select(F.lpad(F.regexp_replace("ein", r"\D", ""), 9, "0").alias("ein"), F.lower(F.trim("external_source_record_id")).alias("record")).where("ein IS NOT NULL AND record IS NOT NULL").distinct()


def policy_links(spark, sf_dir: str) -> DataFrame:
    """Organisations and the bills that their linked filings lobby on, by policy area."""
    facts = bill_facts(spark, sf_dir).withColumn("record", F.lower("filing_uuid"))
    return _links(spark, sf_dir, "LDA").join(facts, "record").groupBy("ein", "bill_id", "policy_area").agg(F.count_distinct("filing_uuid").alias("n_filings"), F.round(F.sum("reported_amount"), 2).alias("amount"))


def committee_links(spark, sf_dir: str) -> DataFrame:
    """Organisations and the committees linked to them, with the committee's name and state as observed."""
    o = table(spark, sf_dir, "entity_observations").where("source_system = 'FEC'").select(F.lower(F.trim("source_record_id")).alias("record"), F.col("native_identifier").alias("committee_id"), "observed_name", "state")
    return _links(spark, sf_dir, "FEC").join(o, "record").select("ein", "committee_id", "observed_name", "state").distinct()


def activity_facts(spark, sf_dir: str) -> DataFrame:
    """Bill facts with the issues of their filings; a filing without usable activities keeps its facts."""
    a = activities(spark, sf_dir).select("filing_uuid", "general_issue_code").distinct()
    return bill_facts(spark, sf_dir).select("filing_uuid", "bill_id").join(a, "filing_uuid", "left")


def policy_overview(spark, sf_dir: str) -> DataFrame:
    """By policy area: linked organisations, bills and what was spent, with the share of all organisations."""
    links = cut(policy_links(spark, sf_dir))
    total = links.select("ein").distinct().count()
    by = links.groupBy("policy_area").agg(F.count_distinct("ein").alias("n_orgs"), F.count_distinct("bill_id").alias("n_bills"), F.round(F.sum("amount"), 2).alias("amount"))
    return by.withColumn("share", F.round(F.col("n_orgs") / F.lit(max(1, total)), 6))


def pair_roll_up(spark, sf_dir: str) -> DataFrame:
    """Current candidates by the two names that they compare: the first candidate, how many there are, and the matchers."""
    c = table(spark, sf_dir, "entity_match_candidates").where("is_current = 1")
    o = table(spark, sf_dir, "entity_observations").select("observation_id", "normalized_name").where("normalized_name IS NOT NULL")
    side = lambda s: o.select(F.col("observation_id").alias(f"{s}_observation_id"), F.col("normalized_name").alias(f"{s}_name"))
    df = c.join(side("left"), "left_observation_id").join(side("right"), "right_observation_id")
    return df.groupBy("left_name", "right_name").agg(F.min("candidate_id").alias("first_candidate"), F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("matcher_name")), ", ").alias("matchers"), F.max("score").alias("score"))


def unlinked_filers(spark, sf_dir: str) -> DataFrame:
    """EINs of filers that no link names; links without an EIN exclude nobody."""
    linked = table(spark, sf_dir, "approved_external_entity_links").select(F.lpad(F.regexp_replace("ein", r"\D", ""), 9, "0").alias("ein")).where("ein IS NOT NULL")
    return table(spark, sf_dir, "irs990_filings").where("ein IS NOT NULL").select("ein").distinct().join(linked, "ein", "left_anti")


def client_profiles(spark, sf_dir: str, since: int | None = None) -> DataFrame:
    """By client: filings, money, issues, bills and the registrants hired; only years from ``since`` on, if it is given."""
    f = table(spark, sf_dir, "lda_filings").where("client_id IS NOT NULL")
    f = f if since is None else f.where(F.col("filing_year") >= since)
    issues = activities(spark, sf_dir).groupBy("filing_uuid").agg(F.collect_set("general_issue_code").alias("issues"))
    bills = network.bill_links(spark, sf_dir).groupBy("filing_uuid").agg(F.count("*").alias("bills"))
    df = f.join(issues, "filing_uuid", "left").join(bills, "filing_uuid", "left")
    money = network.reported(F.col("income"), F.col("expenses"))
    return df.groupBy("client_id").agg(
        F.count("*").alias("n_filings"), F.round(F.sum(money), 2).alias("amount"), F.size(F.array_distinct(F.flatten(F.collect_list("issues")))).alias("n_issues"), F.coalesce(F.sum("bills"), F.lit(0)).alias("n_bill_links"), F.count_distinct("registrant_name").alias("n_registrants"), F.max("filing_year").alias("last_year")
    )


QUERIES = {f.__name__: f for f in (latest_decisions, policy_links, committee_links, activity_facts, policy_overview, pair_roll_up, unlinked_filers, client_profiles)}

_NINE = "lpad(regexp_replace(ein, '\\D', '', 'g'), 9, '0')"
_LINK = f"(SELECT DISTINCT {_NINE} AS ein, lower(trim(external_source_record_id)) AS record FROM approved_external_entity_links WHERE external_source_system = '{{0}}' AND ein IS NOT NULL AND external_source_record_id IS NOT NULL AND candidate_id IN (SELECT candidate_id FROM entity_match_candidates WHERE is_current = 1))"
_POLICY = f"SELECT ein, bill_id, policy_area, count(DISTINCT filing_uuid) AS n_filings, round(sum(reported_amount), 2) AS amount FROM {_LINK.format('LDA')} l JOIN ({network._FACTS}) f ON l.record = lower(f.filing_uuid) GROUP BY 1, 2, 3"
SQL = {
    "latest_decisions": """SELECT candidate_id, reviewer, rationale, decided_at FROM approved_external_entity_links WHERE candidate_id IS NOT NULL
 QUALIFY row_number() OVER (PARTITION BY candidate_id ORDER BY decided_at DESC NULLS LAST, reviewer DESC NULLS LAST, rationale DESC NULLS LAST, ein DESC NULLS LAST, external_source_record_id DESC NULLS LAST) = 1""",
    "policy_links": _POLICY,
    "committee_links": f"SELECT DISTINCT ein, native_identifier AS committee_id, observed_name, state FROM {_LINK.format('FEC')} l JOIN entity_observations o ON o.source_system = 'FEC' AND lower(trim(o.source_record_id)) = l.record",
    "activity_facts": f"SELECT f.filing_uuid, f.bill_id, a.general_issue_code FROM ({network._FACTS}) f LEFT JOIN (SELECT DISTINCT filing_uuid, general_issue_code FROM ({network._ACT})) a USING (filing_uuid)",
    "policy_overview": f"WITH p AS ({_POLICY}) SELECT policy_area, count(DISTINCT ein) AS n_orgs, count(DISTINCT bill_id) AS n_bills, round(sum(amount), 2) AS amount, round(count(DISTINCT ein) / (SELECT count(DISTINCT ein) FROM p), 6) AS share FROM p GROUP BY 1",
    "pair_roll_up": """SELECT l.normalized_name AS left_name, r.normalized_name AS right_name, min(candidate_id) AS first_candidate, count(*) AS n, string_agg(DISTINCT matcher_name, ', ' ORDER BY matcher_name) AS matchers, max(score) AS score
 FROM entity_match_candidates c JOIN entity_observations l ON l.observation_id = left_observation_id JOIN entity_observations r ON r.observation_id = right_observation_id WHERE is_current = 1 AND l.normalized_name IS NOT NULL AND r.normalized_name IS NOT NULL GROUP BY 1, 2""",
    "unlinked_filers": f"SELECT DISTINCT ein FROM irs990_filings WHERE ein NOT IN (SELECT {_NINE} FROM approved_external_entity_links WHERE ein IS NOT NULL)",
    "client_profiles": f"""SELECT client_id, count(*) AS n_filings, round(sum(coalesce(nullif(income, 0), nullif(expenses, 0), 0)), 2) AS amount,
 (SELECT count(DISTINCT general_issue_code) FROM ({network._ACT}) a WHERE a.client_id = f.client_id) AS n_issues,
 (SELECT count(*) FROM ({network._LINKS}) k JOIN lda_filings g USING (filing_uuid) WHERE g.client_id = f.client_id) AS n_bill_links, count(DISTINCT registrant_name) AS n_registrants, max(filing_year) AS last_year FROM lda_filings f WHERE client_id IS NOT NULL GROUP BY client_id""",
}
SQL["bill_backfill"] = f"""SELECT bill_id, CASE WHEN EXISTS (SELECT 1 FROM ({network._LINKS}) k JOIN lda_filings f USING (filing_uuid) WHERE k.bill_type = b.bill_type AND k.bill_number = b.bill_number AND floor((f.filing_year - 1789) / 2) + 1 = b.congress) THEN 1 ELSE 0 END AS lobbied
 FROM bills b WHERE introduced_date IS NULL OR policy_area IS NULL ORDER BY lobbied DESC, bill_id LIMIT 500"""
