"""Edges between organisations, bills and sources, and the summaries shown of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import BATCH_BILL, bill_refs, blank_to_null
from ..operators.relational import first_per_group, most_frequent, rank_share, with_total
from ..session import table

ACTIVITIES = "struct<lobbying_activities: array<struct<general_issue_code: string, description: string>>>"


def congress(year: Column) -> Column:
    """The number of the congress that sits in a year."""
    return F.floor((year - 1789) / 2) + 1


def grants_with_filers(spark, sf_dir: str) -> DataFrame:
    f = table(spark, sf_dir, "irs990_filings").select("filing_id", "ein", "tax_year", "filer_name")
    return table(spark, sf_dir, "irs990_filing_grants").join(f, "filing_id")


def grant_edges(spark, sf_dir: str) -> DataFrame:
    """Grants summed by granting and receiving EIN; blank and missing ones are left out."""
    g = grants_with_filers(spark, sf_dir).select(F.col("ein").alias("source_ein"), blank_to_null(F.col("grantee_ein")).alias("target_ein"), "amount")
    g = g.where("source_ein IS NOT NULL AND target_ein IS NOT NULL").groupBy("source_ein", "target_ein")
    return g.agg(F.round(F.sum("amount"), 2).alias("total_amount"), F.count("*").alias("n_grants"))


def grant_web(spark, sf_dir: str, first: int = 2022, last: int = 2024) -> DataFrame:
    """Edges between filers in some years, without self-loops and filler EINs, with positive totals."""
    g = grants_with_filers(spark, sf_dir).where(F.col("tax_year").between(first, last) & (F.col("ein") != F.col("grantee_ein")) & ~F.col("grantee_ein").rlike(r"^(\d)\1{8}$"))
    filers = table(spark, sf_dir, "irs990_filings").select(F.col("ein").alias("grantee_ein")).where("grantee_ein IS NOT NULL").distinct()
    g = g.join(filers, "grantee_ein", "left_semi").groupBy(F.col("ein").alias("src"), F.col("grantee_ein").alias("dst"))
    return g.agg(F.round(F.sum("amount"), 2).alias("dollars")).where("dollars > 0")


def org_grants(spark, sf_dir: str) -> DataFrame:
    return grants_with_filers(spark, sf_dir).select("ein", "filer_name", "tax_year", "filing_id", "line_no", "grantee_ein", "grantee_name", "amount")


def activities(spark, sf_dir: str) -> DataFrame:
    """(filing_uuid, position, general_issue_code, description) of the lobbying filings' payloads that are JSON objects."""
    f = table(spark, sf_dir, "lda_filings").where(F.try_parse_json("raw_json").isNotNull())
    return f.select("filing_uuid", F.posexplode(F.from_json("raw_json", ACTIVITIES)["lobbying_activities"]).alias("position", "a")).select("filing_uuid", "position", "a.general_issue_code", "a.description")


def bill_links(spark, sf_dir: str, pattern: str = BATCH_BILL) -> DataFrame:
    """(filing_uuid, bill_type, bill_number), each once."""
    return activities(spark, sf_dir).select("filing_uuid", F.explode(bill_refs(F.col("description"), pattern)).alias("b")).select("filing_uuid", "b.*").distinct()


def reported(income: Column, expenses: Column) -> Column:
    return F.coalesce(F.nullif(income, F.lit(0.0)), F.nullif(expenses, F.lit(0.0)), F.lit(0.0))


def bill_facts(spark, sf_dir: str) -> DataFrame:
    """What was spent by whom on which bill: links joined to filings and to the bills of the congress then sitting."""
    f = table(spark, sf_dir, "lda_filings").select("filing_uuid", "client_id", "filing_year", congress(F.col("filing_year")).alias("congress"), reported(F.col("income"), F.col("expenses")).alias("reported_amount"))
    b = table(spark, sf_dir, "bills").select("bill_id", "congress", "bill_type", "bill_number", "policy_area")
    return bill_links(spark, sf_dir).join(f, "filing_uuid").join(b, ["congress", "bill_type", "bill_number"]).select("filing_uuid", "client_id", "filing_year", "bill_id", "policy_area", "reported_amount")


def most_lobbied(spark, sf_dir: str, n: int = 50) -> DataFrame:
    facts = bill_facts(spark, sf_dir).groupBy("bill_id").agg(F.count_distinct("filing_uuid").alias("n_filings"), F.count_distinct("client_id").alias("n_clients"), F.round(F.sum("reported_amount"), 2).alias("amount"))
    return facts.orderBy(F.desc("n_filings"), "bill_id").limit(n)


def shared_bills(spark, sf_dir: str, least: int = 2, most: int = 100) -> DataFrame:
    """Clients that lobby on the same bills, weighted by their number; only bills of ``least`` to ``most`` clients, which bounds the pairs."""
    edges = bill_facts(spark, sf_dir).select("client_id", "bill_id").where("client_id IS NOT NULL").distinct()
    degrees = edges.groupBy("bill_id").agg(F.count("*").alias("d")).where(F.col("d").between(least, most)).select("bill_id")
    e = edges.join(degrees, "bill_id")
    a, b = e.withColumnRenamed("client_id", "client_a"), e.withColumnRenamed("client_id", "client_b")
    return a.join(b, "bill_id").where("client_a < client_b").groupBy("client_a", "client_b").agg(F.count("*").alias("n_bills"))


def filings_by_year(spark, sf_dir: str) -> DataFrame:
    f = table(spark, sf_dir, "irs990_filings")
    return f.groupBy("tax_year").agg(F.count("*").alias("n_filings"), F.count_distinct("ein").alias("n_orgs"), F.round(F.sum("total_revenue"), 2).alias("revenue"))


def latest_names(spark, sf_dir: str) -> DataFrame:
    """The name on the latest filing of each EIN."""
    f = table(spark, sf_dir, "irs990_filings").where("ein IS NOT NULL AND filer_name IS NOT NULL")
    return first_per_group(f, ["ein"], [F.desc_nulls_last("tax_year"), F.desc("filing_id")]).select("ein", "filer_name", "tax_year")


def latest_state(spark, sf_dir: str) -> DataFrame:
    f = table(spark, sf_dir, "irs990_filings").withColumn("state", blank_to_null(F.col("filer_state"))).where("ein IS NOT NULL AND state IS NOT NULL AND form_type <> '990T'")
    when = F.coalesce(F.col("tax_period_end_date"), F.col("tax_year").cast("string"))
    return first_per_group(f, ["ein"], [when.desc_nulls_last(), F.desc("filing_id")]).select("ein", "state")


def modal_zip(spark, sf_dir: str) -> DataFrame:
    """The ZIP code that each client and state has most often."""
    f = table(spark, sf_dir, "lda_filings").withColumn("zip5", F.nullif(F.regexp_extract("client_zip_code", "([0-9]{5})", 1), F.lit("")))
    return most_frequent(f.where("client_id IS NOT NULL AND client_state IS NOT NULL"), ["client_id", "client_state"], "zip5", "zip5")


def sector_summary(spark, sf_dir: str) -> DataFrame:
    """By EIN: the name of the latest year, filings, and total revenue."""
    f = table(spark, sf_dir, "irs990_filings").where("ein IS NOT NULL")
    return f.groupBy("ein").agg(F.max(F.struct("tax_year", "filing_id", "filer_name"))["filer_name"].alias("filer_name"), F.max("tax_year").alias("last_year"), F.count("*").alias("n_filings"), F.round(F.sum("total_revenue"), 2).alias("revenue"))


def form_totals(spark, sf_dir: str) -> DataFrame:
    """Filings, organisations and revenue by form, with a row over all."""
    f = table(spark, sf_dir, "irs990_filings").where("form_type IS NOT NULL")
    return with_total(f, ["form_type"], [F.count("*").alias("n_filings"), F.count_distinct("ein").alias("n_orgs"), F.round(F.sum("total_revenue"), 2).alias("revenue")])


def revenue_ranks(spark, sf_dir: str) -> DataFrame:
    f = table(spark, sf_dir, "irs990_filings").select("filing_id", "total_revenue").where("total_revenue IS NOT NULL")
    return rank_share("total_revenue", "rank_share", f).select("filing_id", F.round("rank_share", 6).alias("rank_share"))


def year_quartiles(spark, sf_dir: str) -> DataFrame:
    f = table(spark, sf_dir, "irs990_filings").where("total_revenue IS NOT NULL").groupBy("tax_year")
    q = [F.round(F.percentile("total_revenue", p), 2).alias(n) for n, p in (("q1", 0.25), ("q2", 0.5), ("q3", 0.75))]
    return f.agg(*q, F.round(F.avg("total_revenue"), 2).alias("mean"), F.round(F.stddev_samp("total_revenue"), 2).alias("deviation"))


def network_degrees(spark, sf_dir: str) -> DataFrame:
    """Degrees and dollars by direction; ``conduit`` = the smaller over the larger of dollars in and out, where both flow."""
    e = grant_edges(spark, sf_dir)
    ends = e.select(F.explode(F.array(F.struct(F.col("source_ein").alias("ein"), F.lit(1).alias("out"), F.col("total_amount").alias("amount")), F.struct(F.col("target_ein").alias("ein"), F.lit(0).alias("out"), F.col("total_amount").alias("amount")))).alias("x")).select("x.*")
    d = ends.groupBy("ein").agg(F.count_if(F.col("out") == 1).alias("out_degree"), F.count_if(F.col("out") == 0).alias("in_degree"), F.round(F.sum(F.when(F.col("out") == 1, F.col("amount")).otherwise(0.0)), 2).alias("dollars_out"), F.round(F.sum(F.when(F.col("out") == 0, F.col("amount")).otherwise(0.0)), 2).alias("dollars_in"))
    both = (F.col("dollars_in") > 0) & (F.col("dollars_out") > 0)
    return d.withColumn("conduit", F.when(both, F.round(F.least("dollars_in", "dollars_out") / F.greatest("dollars_in", "dollars_out", F.lit(1.0)), 6)).otherwise(0.0))


def name_counts(spark, sf_dir: str) -> DataFrame:
    """How many identities bear each normalized name, by source."""
    o = table(spark, sf_dir, "entity_observations").where("normalized_name IS NOT NULL")
    who = F.coalesce(F.nullif(F.col("native_identifier"), F.lit("")), F.col("source_record_id"))
    return o.groupBy("source_system", "normalized_name").agg(F.count_distinct(who).alias("n_entities"))


def candidate_view(spark, sf_dir: str) -> DataFrame:
    """Current candidates with both observations and the number of identities that bear each name."""
    c = table(spark, sf_dir, "entity_match_candidates").where("is_current = 1").select("candidate_id", "left_observation_id", "right_observation_id", "matcher_name", "score")
    o = table(spark, sf_dir, "entity_observations").select("observation_id", "source_system", "normalized_name", "state")
    n = name_counts(spark, sf_dir)
    side = lambda s: o.join(n, ["source_system", "normalized_name"], "left").select(*[F.col(x).alias(f"{s}_{x}") for x in ("observation_id", "source_system", "normalized_name", "state", "n_entities")])
    df = c.join(side("left"), "left_observation_id").join(side("right"), "right_observation_id")
    ambiguous = (F.coalesce("left_n_entities", F.lit(0)) > 1) | (F.coalesce("right_n_entities", F.lit(0)) > 1)
    return df.select("candidate_id", "left_source_system", "right_source_system", "left_state", "right_state", "score", F.when(ambiguous, "ambiguous_name").otherwise("unique_name").alias("collision"))


def best_candidates(spark, sf_dir: str, n: int = 25) -> DataFrame:
    """The best ``n`` candidates of each observation on the left, ties by the right one."""
    c = table(spark, sf_dir, "entity_match_candidates").where("is_current = 1")
    return first_per_group(c, ["left_observation_id"], [F.desc("score"), F.asc("right_observation_id"), F.asc("candidate_id")], n).select("left_observation_id", "right_observation_id", "candidate_id", "score")


def unlinked_clients(spark, sf_dir: str) -> DataFrame:
    """Lobbying filings without an approved link."""
    links = table(spark, sf_dir, "approved_external_entity_links").select(F.lower(F.trim("external_source_record_id")).alias("filing_uuid")).where("filing_uuid IS NOT NULL")
    return table(spark, sf_dir, "lda_filings").select(F.lower("filing_uuid").alias("filing_uuid"), "client_name").join(links, "filing_uuid", "left_anti")


def receiving_filers(spark, sf_dir: str) -> DataFrame:
    """For each filing whether its EIN receives grants too."""
    got = table(spark, sf_dir, "irs990_filing_grants").select(F.col("grantee_ein").alias("ein")).where("ein IS NOT NULL").distinct().withColumn("receives", F.lit(1))
    f = table(spark, sf_dir, "irs990_filings").select("filing_id", "ein").join(got, "ein", "left")
    return f.select("filing_id", F.coalesce("receives", F.lit(0)).alias("receives"))


def grant_pool(spark, sf_dir: str) -> DataFrame:
    """EINs one grant away from those of politically active filers, with these."""
    seeds = table(spark, sf_dir, "irs990_filings").where("political_activity_flag = 1 AND ein IS NOT NULL").select("ein").distinct()
    e = grant_edges(spark, sf_dir)
    out = e.join(seeds.withColumnRenamed("ein", "source_ein"), "source_ein", "left_semi").select(F.col("target_ein").alias("ein"))
    into = e.join(seeds.withColumnRenamed("ein", "target_ein"), "target_ein", "left_semi").select(F.col("source_ein").alias("ein"))
    return seeds.union(out).union(into).distinct()


def funnel(spark, sf_dir: str) -> DataFrame:
    """Counts of the steps from candidates to links, one row each."""
    c, a = table(spark, sf_dir, "entity_match_candidates"), table(spark, sf_dir, "approved_external_entity_links")
    wide = c.agg(F.count("*").alias("candidates"), F.count_if(F.col("is_current") == 1).alias("current"), F.count_distinct("left_observation_id").alias("left_observations"))
    wide = wide.crossJoin(a.agg(F.count("*").alias("links"), F.count_distinct(F.struct("ein", "external_source_record_id")).alias("distinct_links")))
    return wide.unpivot([], ["candidates", "current", "left_observations", "links", "distinct_links"], "step", "n")


def issue_topics(spark, sf_dir: str) -> DataFrame:
    """Activities and clients by issue, with each issue's share of all activities."""
    f = table(spark, sf_dir, "lda_filings").select("filing_uuid", "client_id")
    a = activities(spark, sf_dir).where("general_issue_code IS NOT NULL").join(f, "filing_uuid")
    by = a.groupBy("general_issue_code").agg(F.count("*").alias("n_activities"), F.count_distinct("client_id").alias("n_clients"))
    return by.crossJoin(by.agg(F.sum("n_activities").alias("all"))).select("general_issue_code", "n_activities", "n_clients", F.round(F.col("n_activities") / F.col("all"), 6).alias("share"))


QUERIES = {
    f.__name__: f
    for f in (
        grant_edges, grant_web, org_grants, bill_links, bill_facts, most_lobbied, shared_bills, filings_by_year, latest_names, latest_state, modal_zip, sector_summary, form_totals, revenue_ranks,
        year_quartiles, network_degrees, name_counts, candidate_view, best_candidates, unlinked_clients, receiving_filers, grant_pool, funnel, issue_topics,
    )
}

_G = "SELECT g.*, f.ein, f.tax_year, f.filer_name FROM irs990_filing_grants g JOIN irs990_filings f ON f.filing_id = g.filing_id"
_EDGES = f"SELECT ein AS source_ein, trim(grantee_ein) AS target_ein, round(sum(amount), 2) AS total_amount, count(*) AS n_grants FROM ({_G}) WHERE ein IS NOT NULL AND trim(grantee_ein) <> '' GROUP BY 1, 2"
_ACT = """SELECT l.filing_uuid, l.client_id, a.value ->> 'general_issue_code' AS general_issue_code, a.value ->> 'description' AS description
  FROM (SELECT * FROM lda_filings WHERE CASE WHEN json_valid(raw_json) THEN json_type(raw_json) = 'OBJECT' ELSE false END) l, json_each(l.raw_json, '$.lobbying_activities') a"""
_LINKS = f"""SELECT DISTINCT filing_uuid, lower(regexp_replace(kind, '[.]', '', 'g')) AS bill_type, CAST(num AS BIGINT) AS bill_number FROM (
  SELECT filing_uuid, unnest(regexp_extract_all(description, '(?i)\\b(H\\.?R\\.?|S\\.?|H\\.?Res\\.?|S\\.?Res\\.?|H\\.?Con\\.?Res\\.?|S\\.?Con\\.?Res\\.?)\\s*(\\d+)\\b', 1)) AS kind,
         unnest(regexp_extract_all(description, '(?i)\\b(H\\.?R\\.?|S\\.?|H\\.?Res\\.?|S\\.?Res\\.?|H\\.?Con\\.?Res\\.?|S\\.?Con\\.?Res\\.?)\\s*(\\d+)\\b', 2)) AS num FROM ({_ACT}))"""
_FACTS = f"""SELECT k.filing_uuid, f.client_id, f.filing_year, b.bill_id, b.policy_area, coalesce(nullif(f.income, 0), nullif(f.expenses, 0), 0) AS reported_amount
  FROM ({_LINKS}) k JOIN lda_filings f USING (filing_uuid)
  JOIN bills b ON b.bill_type = k.bill_type AND b.bill_number = k.bill_number AND b.congress = floor((f.filing_year - 1789) / 2) + 1"""
_NAMES = "SELECT source_system, normalized_name, count(DISTINCT coalesce(nullif(native_identifier, ''), source_record_id)) AS n_entities FROM entity_observations WHERE normalized_name IS NOT NULL GROUP BY 1, 2"

SQL = {
    "grant_edges": _EDGES,
    "grant_web": f"""SELECT ein AS src, grantee_ein AS dst, round(sum(amount), 2) AS dollars FROM ({_G})
 WHERE tax_year BETWEEN 2022 AND 2024 AND ein <> grantee_ein AND grantee_ein NOT IN ('000000000','111111111','222222222','333333333','444444444','555555555','666666666','777777777','888888888','999999999')
 AND grantee_ein IN (SELECT ein FROM irs990_filings WHERE ein IS NOT NULL) GROUP BY 1, 2 HAVING round(sum(amount), 2) > 0""",
    "org_grants": f"SELECT ein, filer_name, tax_year, filing_id, line_no, grantee_ein, grantee_name, amount FROM ({_G})",
    "bill_links": _LINKS,
    "bill_facts": _FACTS,
    "most_lobbied": f"SELECT bill_id, count(DISTINCT filing_uuid) AS n_filings, count(DISTINCT client_id) AS n_clients, round(sum(reported_amount), 2) AS amount FROM ({_FACTS}) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50",
    "shared_bills": f"""WITH e AS (SELECT DISTINCT client_id, bill_id FROM ({_FACTS}) WHERE client_id IS NOT NULL),
 d AS (SELECT bill_id FROM e GROUP BY 1 HAVING count(*) BETWEEN 2 AND 100)
 SELECT a.client_id AS client_a, b.client_id AS client_b, count(*) AS n_bills FROM e a JOIN e b ON a.bill_id = b.bill_id AND a.client_id < b.client_id WHERE a.bill_id IN (SELECT bill_id FROM d) GROUP BY 1, 2""",
    "filings_by_year": "SELECT tax_year, count(*) AS n_filings, count(DISTINCT ein) AS n_orgs, round(sum(total_revenue), 2) AS revenue FROM irs990_filings GROUP BY 1",
    "latest_names": "SELECT ein, filer_name, tax_year FROM (SELECT *, row_number() OVER (PARTITION BY ein ORDER BY tax_year DESC NULLS LAST, filing_id DESC) AS rn FROM irs990_filings WHERE ein IS NOT NULL AND filer_name IS NOT NULL) WHERE rn = 1",
    "latest_state": """SELECT ein, state FROM (SELECT ein, trim(filer_state) AS state, row_number() OVER (PARTITION BY ein ORDER BY coalesce(tax_period_end_date, CAST(tax_year AS VARCHAR)) DESC NULLS LAST, filing_id DESC) AS rn
 FROM irs990_filings WHERE ein IS NOT NULL AND trim(filer_state) <> '' AND form_type <> '990T') WHERE rn = 1""",
    "modal_zip": """SELECT client_id, client_state, z AS zip5 FROM (SELECT client_id, client_state, z, row_number() OVER (PARTITION BY client_id, client_state ORDER BY n DESC, z) AS rn FROM (
 SELECT client_id, client_state, nullif(regexp_extract(client_zip_code, '([0-9]{5})', 1), '') AS z, count(*) AS n FROM lda_filings WHERE client_id IS NOT NULL AND client_state IS NOT NULL GROUP BY 1, 2, 3) WHERE z IS NOT NULL) WHERE rn = 1""",
    "sector_summary": """SELECT ein, (SELECT g.filer_name FROM irs990_filings g WHERE g.ein = f.ein ORDER BY g.tax_year DESC NULLS LAST, g.filing_id DESC LIMIT 1) AS filer_name, max(tax_year) AS last_year, count(*) AS n_filings, round(sum(total_revenue), 2) AS revenue
 FROM irs990_filings f WHERE ein IS NOT NULL GROUP BY ein""",
    "form_totals": """SELECT form_type, count(*) AS n_filings, count(DISTINCT ein) AS n_orgs, round(sum(total_revenue), 2) AS revenue FROM irs990_filings WHERE form_type IS NOT NULL GROUP BY 1
 UNION ALL SELECT 'TOTAL', count(*), count(DISTINCT ein), round(sum(total_revenue), 2) FROM irs990_filings WHERE form_type IS NOT NULL""",
    "revenue_ranks": "SELECT filing_id, round((rank() OVER (ORDER BY total_revenue) + (count(*) OVER (PARTITION BY total_revenue) - 1) / 2.0) / count(*) OVER (), 6) AS rank_share FROM irs990_filings WHERE total_revenue IS NOT NULL",
    "year_quartiles": """SELECT tax_year, round(quantile_cont(total_revenue, 0.25), 2) AS q1, round(quantile_cont(total_revenue, 0.5), 2) AS q2, round(quantile_cont(total_revenue, 0.75), 2) AS q3,
 round(avg(total_revenue), 2) AS mean, round(stddev_samp(total_revenue), 2) AS deviation FROM irs990_filings WHERE total_revenue IS NOT NULL GROUP BY 1""",
    "network_degrees": f"""WITH e AS ({_EDGES}), x AS (SELECT source_ein AS ein, 1 AS o, total_amount AS a FROM e UNION ALL SELECT target_ein, 0, total_amount FROM e),
 d AS (SELECT ein, count(*) FILTER (o = 1) AS out_degree, count(*) FILTER (o = 0) AS in_degree, round(sum(CASE WHEN o = 1 THEN a ELSE 0 END), 2) AS dollars_out, round(sum(CASE WHEN o = 0 THEN a ELSE 0 END), 2) AS dollars_in FROM x GROUP BY 1)
 SELECT *, CASE WHEN dollars_in > 0 AND dollars_out > 0 THEN round(least(dollars_in, dollars_out) / greatest(dollars_in, dollars_out, 1), 6) ELSE 0 END AS conduit FROM d""",
    "name_counts": _NAMES,
    "candidate_view": f"""WITH n AS ({_NAMES}), o AS (SELECT e.observation_id, e.source_system, e.state, n.n_entities FROM entity_observations e LEFT JOIN n USING (source_system, normalized_name))
 SELECT c.candidate_id, l.source_system AS left_source_system, r.source_system AS right_source_system, l.state AS left_state, r.state AS right_state, c.score,
 CASE WHEN coalesce(l.n_entities, 0) > 1 OR coalesce(r.n_entities, 0) > 1 THEN 'ambiguous_name' ELSE 'unique_name' END AS collision
 FROM entity_match_candidates c JOIN o l ON l.observation_id = c.left_observation_id JOIN o r ON r.observation_id = c.right_observation_id WHERE c.is_current = 1""",
    "best_candidates": "SELECT left_observation_id, right_observation_id, candidate_id, score FROM (SELECT *, row_number() OVER (PARTITION BY left_observation_id ORDER BY score DESC, right_observation_id, candidate_id) AS rn FROM entity_match_candidates WHERE is_current = 1) WHERE rn <= 25",
    "unlinked_clients": "SELECT lower(filing_uuid) AS filing_uuid, client_name FROM lda_filings f WHERE NOT EXISTS (SELECT 1 FROM approved_external_entity_links a WHERE lower(trim(a.external_source_record_id)) = lower(f.filing_uuid))",
    "receiving_filers": "SELECT filing_id, CASE WHEN EXISTS (SELECT 1 FROM irs990_filing_grants g WHERE g.grantee_ein = f.ein) THEN 1 ELSE 0 END AS receives FROM irs990_filings f",
    "grant_pool": f"""WITH s AS (SELECT DISTINCT ein FROM irs990_filings WHERE political_activity_flag = 1 AND ein IS NOT NULL), e AS ({_EDGES})
 SELECT ein FROM s UNION SELECT target_ein FROM e WHERE source_ein IN (SELECT ein FROM s) UNION SELECT source_ein FROM e WHERE target_ein IN (SELECT ein FROM s)""",
    "funnel": """SELECT 'candidates' AS step, count(*) AS n FROM entity_match_candidates UNION ALL SELECT 'current', count(*) FROM entity_match_candidates WHERE is_current = 1
 UNION ALL SELECT 'left_observations', count(DISTINCT left_observation_id) FROM entity_match_candidates UNION ALL SELECT 'links', count(*) FROM approved_external_entity_links
 UNION ALL SELECT 'distinct_links', count(*) FROM (SELECT DISTINCT ein, external_source_record_id FROM approved_external_entity_links)""",
    "issue_topics": f"""SELECT general_issue_code, count(*) AS n_activities, count(DISTINCT client_id) AS n_clients, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM ({_ACT}) WHERE general_issue_code IS NOT NULL GROUP BY 1""",
}
