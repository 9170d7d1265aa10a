"""Linking lobbying parties to filers by role: who is named in a filing, where, and which filer that is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import blank_to_null, link_key, zip5, zip_score
from ..operators.entities import prefix_candidates
from ..operators.relational import first_per_group
from ..session import cut, table
from .network import latest_names, latest_state, modal_zip

AFFILIATES = "array<struct<name: string, state: string, zip: string>>"
PAYLOAD = f"struct<registrant: struct<name: string, state: string, zip: string>, affiliated_organizations: {AFFILIATES}>"


def fee_filings(spark, sf_dir: str) -> DataFrame:
    """Filings with a usable payload in which money was paid, with both names in the form in which they are compared."""
    f = table(spark, sf_dir, "lda_filings").where(F.try_parse_json("raw_json").isNotNull() & ((F.col("income") > 0) | (F.col("expenses") > 0)))
    return f.select("filing_uuid", "client_id", link_key(F.col("client_name")).alias("client_key"), link_key(F.col("registrant_name")).alias("registrant_key"), "client_state", zip5(F.col("client_zip_code")).alias("client_zip"), "raw_json")


def role_candidates(spark, sf_dir: str) -> DataFrame:
    """(role, party, filing_uuid, state, zip, zip_from) of clients, registrants and affiliates named with two words at least.

    A ZIP code comes from the filing, else from a filing that the party made for itself, else it is the one that its client and state have most often.
    """
    f = cut(fee_filings(spark, sf_dir).withColumn("p", F.from_json("raw_json", PAYLOAD)).drop("raw_json"))
    own = f.where((F.col("client_key") == F.col("registrant_key")) & F.col("client_zip").isNotNull()).groupBy("client_key").agg(F.min("client_zip").alias("own_zip"))
    usual = modal_zip(spark, sf_dir).select("client_id", "client_state", F.col("zip5").alias("usual_zip"))
    clients = f.join(own, "client_key", "left").join(usual, ["client_id", "client_state"], "left")
    found = F.when(F.col("client_zip").isNotNull(), "filing").when(F.col("own_zip").isNotNull(), "self_filed").when(F.col("usual_zip").isNotNull(), "usual")
    role = lambda name: F.lit(name).alias("role")
    parts = clients.select(role("client"), F.col("client_key").alias("party"), "filing_uuid", F.col("client_state").alias("state"), F.coalesce("client_zip", "own_zip", "usual_zip").alias("zip"), found.alias("zip_from"))
    r = F.col("p.registrant")
    parts = parts.unionByName(f.select(role("registrant"), F.col("registrant_key").alias("party"), "filing_uuid", r["state"].alias("state"), zip5(r["zip"]).alias("zip"), F.when(zip5(r["zip"]).isNotNull(), "payload").alias("zip_from")))
    a = f.select("filing_uuid", F.explode("p.affiliated_organizations").alias("a"))
    parts = parts.unionByName(a.select(role("affiliate"), link_key(F.col("a.name")).alias("party"), "filing_uuid", F.col("a.state").alias("state"), zip5(F.col("a.zip")).alias("zip"), F.when(zip5(F.col("a.zip")).isNotNull(), "payload").alias("zip_from")))
    return parts.where(F.col("party").contains(" ")).distinct()


def latest_zip(spark, sf_dir: str) -> DataFrame:
    """The ZIP code on the latest filing of each EIN that has one."""
    f = table(spark, sf_dir, "irs990_filings").withColumn("zip", zip5(F.col("filer_zip_code"))).where("ein IS NOT NULL AND zip IS NOT NULL")
    when = F.coalesce(F.col("tax_period_end_date"), F.col("tax_year").cast("string"))
    return first_per_group(f, ["ein"], [when.desc_nulls_last(), F.desc("filing_id")]).select("ein", "zip")


def filer_table(spark, sf_dir: str) -> DataFrame:
    """(ein, filer_key, filer_state, filer_zip): filers by the name, state and ZIP code last known."""
    df = latest_names(spark, sf_dir).join(latest_state(spark, sf_dir), "ein", "left").join(latest_zip(spark, sf_dir), "ein", "left")
    return df.select("ein", link_key(F.col("filer_name")).alias("filer_key"), F.col("state").alias("filer_state"), F.col("zip").alias("filer_zip")).where("filer_key <> ''")


def evidence(state: Column, score: Column) -> Column:
    """What supports a link beside the name."""
    return F.when(state & (score >= 80), "name+state+zip").when(state, "name+state").otherwise("name")


def role_links(spark, sf_dir: str) -> DataFrame:
    """(role, party, ein, state_agrees, zip_score, evidence): exact names of parties and filers, with all that their records agree in."""
    c = role_candidates(spark, sf_dir).groupBy("role", "party", "state", "zip").agg(F.count("*").alias("n"))
    df = c.join(filer_table(spark, sf_dir), F.col("party") == F.col("filer_key"))
    state, score = F.coalesce(F.col("state") == F.col("filer_state"), F.lit(False)), zip_score(F.col("zip"), F.col("filer_zip"))
    by = df.groupBy("role", "party", "ein").agg(F.max(state).alias("state_agrees"), F.max(score).alias("zip_score"), F.sum("n").alias("n_records"))
    return by.withColumn("evidence", evidence(F.col("state_agrees"), F.col("zip_score")))


def best_role_links(spark, sf_dir: str) -> DataFrame:
    """One filer per role and party: the best ZIP score, then the same state, then EIN."""
    return first_per_group(role_links(spark, sf_dir), ["role", "party"], [F.desc("zip_score"), F.desc("state_agrees"), F.asc("ein")]).select("role", "party", "ein", "evidence")


def weak_role_links(spark, sf_dir: str) -> DataFrame:
    """For each role and party without a supported link, the best of its unsupported ones."""
    links = cut(role_links(spark, sf_dir))
    supported = links.where("evidence <> 'name'").select("role", "party")
    rest = links.join(supported.distinct(), ["role", "party"], "left_anti")
    return first_per_group(rest, ["role", "party"], [F.desc("zip_score"), F.asc("ein")]).select("role", "party", "ein", "zip_score")


def near_client_links(spark, sf_dir: str, least: float = 0.9) -> DataFrame:
    """Near names of clients that share a state with the filer, with the field that supports them."""
    f = filer_table(spark, sf_dir).select("ein", F.col("filer_key").alias("name"), F.col("filer_state").alias("state"), F.col("filer_zip").alias("zip"))
    c = role_candidates(spark, sf_dir).where("role = 'client'").select(F.col("party").alias("client_key"), F.col("party").alias("name"), "state", "zip").distinct()
    df = prefix_candidates(f, c).where(F.col("state_agrees") & (F.col("similarity") >= least))
    return df.groupBy("client_key", "ein").agg(F.max("similarity").alias("similarity"), F.max("zip_score").alias("zip_score"))


def role_overview(spark, sf_dir: str) -> DataFrame:
    """By role, in the order of the roles: parties, parties with a ZIP code, filings, and the sources of ZIP codes put together."""
    c = role_candidates(spark, sf_dir)
    sources = F.array_join(F.array_sort(F.collect_set("zip_from")), ", ")
    df = c.groupBy("role").agg(F.count_distinct("party").alias("parties"), F.count_distinct(F.when(F.col("zip").isNotNull(), F.col("party"))).alias("parties_with_zip"), F.count_distinct("filing_uuid").alias("filings"), sources.alias("zip_sources"), F.min("party").alias("any_party"))
    place = F.when(F.col("role") == "client", 1).when(F.col("role") == "registrant", 2).otherwise(3)
    return df.select(place.alias("place"), "*").orderBy("place")


def name_fan_out(spark, sf_dir: str) -> DataFrame:
    """How many filers bear one name: names, the share borne by several, and the most."""
    per = filer_table(spark, sf_dir).groupBy("filer_key").agg(F.count_distinct("ein").alias("n"))
    return per.agg(F.count("*").alias("names"), F.round(F.avg((F.col("n") > 1).cast("double")), 6).alias("share_of_several"), F.max("n").alias("most"))


def unmatched_roles(spark, sf_dir: str) -> DataFrame:
    """Parties of every role that no filer's name equals, with their filings."""
    c = role_candidates(spark, sf_dir).groupBy("role", "party").agg(F.count_distinct("filing_uuid").alias("filings"))
    return c.join(filer_table(spark, sf_dir).select(F.col("filer_key").alias("party")).distinct(), "party", "left_anti")


def detail_coverage(spark, sf_dir: str) -> DataFrame:
    """For each detail table the filings that have rows in it, and their share of all."""
    f = table(spark, sf_dir, "irs990_filings").select("filing_id")
    total = f.count()
    parts = [("irs990_filing_grants", "filing_id"), ("entity_observations", "irs_filing_id")]
    rows = [f.join(table(spark, sf_dir, t).select(F.col(k).alias("filing_id")).distinct(), "filing_id", "left_semi").agg(F.count("*").alias("filings")).select(F.lit(t).alias("detail"), "filings") for t, k in parts]
    return rows[0].unionByName(rows[1]).withColumn("share", F.round(F.col("filings") / F.lit(max(1, total)), 6))


def review_sample(spark, sf_dir: str, n: int = 50, seed: int = 20) -> DataFrame:
    """``n`` candidates drawn by a seeded hash: the same ones on every run and cluster."""
    c = table(spark, sf_dir, "entity_match_candidates")
    return c.select("candidate_id", "score", F.md5(F.concat_ws(":", F.col("candidate_id").cast("string"), F.lit(str(seed)))).alias("draw")).orderBy("draw", "candidate_id").limit(n)


QUERIES = {f.__name__: f for f in (role_candidates, latest_zip, role_links, best_role_links, weak_role_links, near_client_links, role_overview, name_fan_out, unmatched_roles, detail_coverage, review_sample)}

_DROP = "('inc','incorporated','llc','lp','llp','corp','corporation','the','of','and','for','a','an','pac','cmte','association','committee','fund','foundation','trust','club','')"
_KEY = "array_to_string(list_filter(regexp_split_to_array(regexp_replace(lower(coalesce({0}, '')), '[^a-z0-9\\s]', ' ', 'g'), '\\s+'), lambda w: w NOT IN " + _DROP + "), ' ')"
_ZIP = "nullif(regexp_extract({0}, '([0-9]{{5}})', 1), '')"
_MODAL = """SELECT client_id, client_state, z AS usual_zip FROM (SELECT client_id, client_state, z, row_number() OVER (PARTITION BY client_id, client_state ORDER BY n DESC, z) AS rn FROM (
 SELECT client_id, client_state, nullif(regexp_extract(client_zip_code, '([0-9]{5})', 1), '') AS z, count(*) AS n FROM lda_filings WHERE client_id IS NOT NULL AND client_state IS NOT NULL GROUP BY 1, 2, 3) WHERE z IS NOT NULL) WHERE rn = 1"""
_ROLES = f"""(WITH fee AS (SELECT filing_uuid, client_id, {_KEY.format("client_name")} AS ck, {_KEY.format("registrant_name")} AS rk, client_state, {_ZIP.format("client_zip_code")} AS cz, CASE WHEN json_type(raw_json) = 'OBJECT' THEN raw_json::JSON END AS j
   FROM lda_filings WHERE json_valid(raw_json) AND (income > 0 OR expenses > 0)),
 own AS (SELECT ck, min(cz) AS own_zip FROM fee WHERE ck = rk AND cz IS NOT NULL GROUP BY 1), usual AS ({_MODAL}),
 parts AS (
 SELECT 'client' AS role, ck AS party, filing_uuid, client_state AS state, coalesce(cz, own_zip, usual_zip) AS zip, CASE WHEN cz IS NOT NULL THEN 'filing' WHEN own_zip IS NOT NULL THEN 'self_filed' WHEN usual_zip IS NOT NULL THEN 'usual' END AS zip_from
   FROM fee LEFT JOIN own USING (ck) LEFT JOIN usual USING (client_id, client_state)
 UNION ALL SELECT 'registrant', rk, filing_uuid, j ->> '$.registrant.state', {_ZIP.format("j ->> '$.registrant.zip'")}, CASE WHEN {_ZIP.format("j ->> '$.registrant.zip'")} IS NOT NULL THEN 'payload' END FROM fee
 UNION ALL SELECT 'affiliate', {_KEY.format("e.value ->> '$.name'")}, filing_uuid, e.value ->> '$.state', {_ZIP.format("e.value ->> '$.zip'")}, CASE WHEN {_ZIP.format("e.value ->> '$.zip'")} IS NOT NULL THEN 'payload' END
   FROM (SELECT * FROM fee WHERE json_type(j, '$.affiliated_organizations') = 'ARRAY') f, json_each(f.j, '$.affiliated_organizations') e)
 SELECT DISTINCT * FROM parts WHERE contains(party, ' '))"""
_LATEST_ZIP = f"""SELECT ein, z AS zip FROM (SELECT ein, {_ZIP.format("filer_zip_code")} AS z, row_number() OVER (PARTITION BY ein ORDER BY coalesce(tax_period_end_date, CAST(tax_year AS VARCHAR)) DESC NULLS LAST, filing_id DESC) AS rn
 FROM irs990_filings WHERE ein IS NOT NULL AND {_ZIP.format("filer_zip_code")} IS NOT NULL) WHERE rn = 1"""
_FILERS = f"""(SELECT n.ein, {_KEY.format("n.filer_name")} AS filer_key, s.state AS filer_state, z.zip AS filer_zip
 FROM (SELECT ein, filer_name FROM irs990_filings WHERE ein IS NOT NULL AND filer_name IS NOT NULL QUALIFY row_number() OVER (PARTITION BY ein ORDER BY tax_year DESC NULLS LAST, filing_id DESC) = 1) n
 LEFT JOIN (SELECT ein, trim(filer_state) AS state FROM irs990_filings WHERE ein IS NOT NULL AND trim(filer_state) <> '' AND form_type <> '990T' QUALIFY row_number() OVER (PARTITION BY ein ORDER BY coalesce(tax_period_end_date, CAST(tax_year AS VARCHAR)) DESC NULLS LAST, filing_id DESC) = 1) s USING (ein)
 LEFT JOIN ({_LATEST_ZIP}) z USING (ein) WHERE {_KEY.format("n.filer_name")} <> '')"""
_SCORE = "CASE WHEN zip = filer_zip THEN 100 WHEN left(zip, 4) = left(filer_zip, 4) THEN 90 WHEN left(zip, 3) = left(filer_zip, 3) THEN 80 ELSE 0 END"
_ROLE_LINKS = f"""(SELECT *, CASE WHEN state_agrees AND zip_score >= 80 THEN 'name+state+zip' WHEN state_agrees THEN 'name+state' ELSE 'name' END AS evidence FROM (
 SELECT role, party, ein, max(coalesce(state = filer_state, false)) AS state_agrees, max({_SCORE}) AS zip_score, CAST(count(*) AS BIGINT) AS n_records FROM {_ROLES} r JOIN {_FILERS} f ON r.party = f.filer_key GROUP BY 1, 2, 3))"""
SQL = {
    "role_candidates": f"SELECT * FROM {_ROLES}",
    "latest_zip": _LATEST_ZIP,
    "role_links": f"SELECT * FROM {_ROLE_LINKS}",
    "best_role_links": f"SELECT role, party, ein, evidence FROM {_ROLE_LINKS} QUALIFY row_number() OVER (PARTITION BY role, party ORDER BY zip_score DESC, state_agrees DESC, ein) = 1",
    "weak_role_links": f"WITH l AS (SELECT * FROM {_ROLE_LINKS}) SELECT role, party, ein, zip_score FROM l WHERE NOT EXISTS (SELECT 1 FROM l k WHERE k.role = l.role AND k.party = l.party AND k.evidence <> 'name') QUALIFY row_number() OVER (PARTITION BY role, party ORDER BY zip_score DESC, ein) = 1",
    "near_client_links": f"""SELECT client_key, ein, max(similarity) AS similarity, max(zip_score) AS zip_score FROM (SELECT party AS client_key, ein, round(jaro_winkler_similarity(filer_key, party), 6) AS similarity, {_SCORE} AS zip_score
 FROM {_FILERS} f JOIN (SELECT DISTINCT party, state, zip FROM {_ROLES} WHERE role = 'client') c ON left(filer_key, 8) = left(party, 8) AND filer_key <> party AND least(length(filer_key), length(party)) / greatest(length(filer_key), length(party)) >= 0.6
 WHERE state = filer_state) WHERE similarity >= 0.9 GROUP BY 1, 2""",
    "role_overview": f"""SELECT CASE role WHEN 'client' THEN 1 WHEN 'registrant' THEN 2 ELSE 3 END AS place, role, count(DISTINCT party) AS parties, count(DISTINCT CASE WHEN zip IS NOT NULL THEN party END) AS parties_with_zip, count(DISTINCT filing_uuid) AS filings,
 coalesce(string_agg(DISTINCT zip_from, ', ' ORDER BY zip_from), '') AS zip_sources, min(party) AS any_party FROM {_ROLES} GROUP BY role ORDER BY place""",
    "name_fan_out": f"SELECT count(*) AS names, round(avg(CASE WHEN n > 1 THEN 1.0 ELSE 0.0 END), 6) AS share_of_several, max(n) AS most FROM (SELECT filer_key, count(DISTINCT ein) AS n FROM {_FILERS} GROUP BY 1)",
    "unmatched_roles": f"SELECT party, role, count(DISTINCT filing_uuid) AS filings FROM {_ROLES} WHERE party NOT IN (SELECT filer_key FROM {_FILERS}) GROUP BY 1, 2",
    "detail_coverage": """SELECT detail, filings, round(filings / (SELECT count(*) FROM irs990_filings), 6) AS share FROM (SELECT 'irs990_filing_grants' AS detail, count(*) AS filings FROM irs990_filings WHERE filing_id IN (SELECT filing_id FROM irs990_filing_grants)
 UNION ALL SELECT 'entity_observations', count(*) FROM irs990_filings WHERE filing_id IN (SELECT irs_filing_id FROM entity_observations WHERE irs_filing_id IS NOT NULL))""",
    "review_sample": "SELECT candidate_id, score, md5(candidate_id || ':20') AS draw FROM entity_match_candidates ORDER BY draw, candidate_id LIMIT 50",
}
