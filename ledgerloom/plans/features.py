"""Features of organisations for modelling: from their scores, their neighbours in the grant network, and what they do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import url_key
from ..operators.graph import smallest_labels
from ..operators.relational import first_per_group, most_frequent, placed_in_order
from ..session import cut, table
from .network import grant_edges
from .scores import index_parts, index_source

PARTS = ["board", "volunteers", "related_527s", "related_c3s", "political", "salaries", "net_assets", "fundraising"]


def joined_once(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """``left`` joined with ``right``, which must have each key once; a repeated key is an error, not more rows."""
    if not right.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        raise ValueError(f"{keys} repeat on the right side")
    return left.join(right, keys, how)


def finite(df: DataFrame, columns: list[str], logarithm: bool = False) -> DataFrame:
    """``df`` if all ``columns`` hold finite numbers (none below zero, if their logarithm is to be taken), else an error."""
    bad = F.lit(False)
    for c in columns:
        x = F.col(c).cast("double")
        bad = bad | x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")) | (F.lit(logarithm) & (x < 0))
    if not df.where(bad).isEmpty():
        raise ValueError(f"numbers that are missing, infinite or too small in {columns}")
    return df


def _scored(spark, sf_dir: str) -> DataFrame:
    return index_parts(index_source(table(spark, sf_dir, "irs990_filings")))


def latest_scores(spark, sf_dir: str) -> DataFrame:
    """The index of the latest filing of each EIN."""
    df = _scored(spark, sf_dir).where("ein IS NOT NULL")
    return first_per_group(df, ["ein"], [F.desc_nulls_last("tax_year"), F.desc("filing_id")]).select("ein", "filing_id", "tax_year", F.round("index_score", 6).alias("index_score"))


def score_places(spark, sf_dir: str) -> DataFrame:
    """The place of each filing by its index, from the highest, ties by the higher filing number."""
    df = _scored(spark, sf_dir).select("filing_id", F.round("index_score", 6).alias("index_score"))
    return placed_in_order(df, "filing_id", "index_score")


def part_coverage(spark, sf_dir: str) -> DataFrame:
    """For each part of the index the share of filings in which it can be told, and the shares with at least six, seven and eight of them."""
    df = _scored(spark, sf_dir).select(*PARTS)
    known = sum((F.col(p).isNotNull().cast("int") for p in PARTS), F.lit(0))
    share = lambda c: F.round(F.avg(c.cast("double")), 6)
    wide = df.agg(*[share(F.col(p).isNotNull()).alias(p) for p in PARTS], *[share(known >= k).alias(f"at_least_{k}") for k in (6, 7, 8)])
    return wide.unpivot([], wide.columns, "part", "share")


def modelling_frame(spark, sf_dir: str) -> DataFrame:
    """One row per EIN, its latest filing: amounts as logarithms with missing ones marked, the index, and whether political activity is disclosed."""
    f = table(spark, sf_dir, "irs990_filings").where("ein IS NOT NULL AND form_type <> '990T'")
    one = first_per_group(f, ["ein"], [F.desc_nulls_last("tax_year"), F.desc("filing_id")])
    amounts = ["total_revenue", "total_expenses", "total_assets"]
    logs = [F.round(F.log1p(F.greatest(F.col(c), F.lit(0.0))), 6).alias(f"{c}_log") for c in amounts]
    flags = [F.col(c).isNull().cast("int").alias(f"{c}_missing") for c in amounts]
    df = one.select("ein", "filing_id", *logs, *flags, F.coalesce((F.col("political_activity_flag") > 0).cast("int"), F.lit(0)).alias("target"))
    scores = _scored(spark, sf_dir).select("filing_id", F.round("index_score", 6).alias("index_score"))
    return joined_once(df, scores, ["filing_id"])


def political_eins(spark, sf_dir: str) -> DataFrame:
    f = table(spark, sf_dir, "irs990_filings").where("political_activity_flag = 1 AND exempt_organization_type IN ('501(c)(4)', '501(c)(5)', '501(c)(6)')")
    return f.where("ein IS NOT NULL").select("ein").distinct()


def political_neighbours(spark, sf_dir: str) -> DataFrame:
    """For each organisation of the grant network the share of those it gives to, and of those it gets from, that are politically active, and how many these are."""
    e = cut(grant_edges(spark, sf_dir).select(F.col("source_ein").alias("src"), F.col("target_ein").alias("dst")))
    p = political_eins(spark, sf_dir).withColumn("p", F.lit(1))
    flag = lambda end: F.coalesce(F.col("p"), F.lit(0))
    out = e.join(p.withColumnRenamed("ein", "dst"), "dst", "left").groupBy(F.col("src").alias("ein")).agg(F.sum(flag("dst")).alias("po"), F.count("*").alias("no"))
    into = e.join(p.withColumnRenamed("ein", "src"), "src", "left").groupBy(F.col("dst").alias("ein")).agg(F.sum(flag("src")).alias("pi"), F.count("*").alias("ni"))
    df = out.join(into, "ein", "full").na.fill(0)
    share = lambda a, n: F.round(F.when(F.col(n) > 0, F.col(a) / F.col(n)).otherwise(0.0), 6)
    return df.select("ein", share("po", "no").alias("out_share"), share("pi", "ni").alias("in_share"), (F.col("po") + F.col("pi")).alias("n_political"))


def behaviour(spark, sf_dir: str) -> DataFrame:
    """What each filer does: grants given and received, lobbying filings linked, and whether it discloses political activity."""
    f = table(spark, sf_dir, "irs990_filings").where("ein IS NOT NULL").groupBy("ein").agg(F.count("*").alias("n_filings"), F.max(F.coalesce("political_activity_flag", F.lit(0))).alias("political"))
    e = cut(grant_edges(spark, sf_dir))
    given = e.groupBy(F.col("source_ein").alias("ein")).agg(F.round(F.sum("total_amount"), 2).alias("given"), F.count("*").alias("n_grantees"))
    got = e.groupBy(F.col("target_ein").alias("ein")).agg(F.round(F.sum("total_amount"), 2).alias("received"), F.count("*").alias("n_donors"))
    links = table(spark, sf_dir, "approved_external_entity_links").where("external_source_system = 'LDA'").select(F.lpad(F.regexp_replace("ein", r"\D", ""), 9, "0").alias("ein"), F.lower(F.trim("external_source_record_id")).alias("r"))
    lobbying = links.groupBy("ein").agg(F.count_distinct("r").alias("n_lobbying"))
    df = f.join(given, "ein", "left").join(got, "ein", "left").join(lobbying, "ein", "left")
    return df.na.fill(0, ["given", "n_grantees", "received", "n_donors", "n_lobbying"])


def ego_network(spark, sf_dir: str, around: int = 25) -> DataFrame:
    """Edges among the ``around`` largest givers and all that they give to or get from; edges of an organisation with itself go."""
    e = cut(grant_edges(spark, sf_dir).where("source_ein <> target_ein").select(F.col("source_ein").alias("src"), F.col("target_ein").alias("dst"), "total_amount"))
    egos = cut(e.groupBy(F.col("src").alias("node")).agg(F.sum("total_amount").alias("a")).orderBy(F.desc("a"), "node").limit(around).select("node"))
    near = e.join(egos.withColumnRenamed("node", "src"), "src", "left_semi").select(F.col("dst").alias("node")).union(e.join(egos.withColumnRenamed("node", "dst"), "dst", "left_semi").select(F.col("src").alias("node"))).union(egos).distinct()
    near = cut(near)
    return e.join(near.withColumnRenamed("node", "src"), "src", "left_semi").join(near.withColumnRenamed("node", "dst"), "dst", "left_semi").select("src", "dst", "total_amount")


def network_shape(spark, sf_dir: str) -> DataFrame:
    """Nodes, edges, density, components and the size of the largest, of the grant network."""
    e = cut(grant_edges(spark, sf_dir).select(F.col("source_ein").alias("src"), F.col("target_ein").alias("dst")))
    c = smallest_labels(e).groupBy("component").agg(F.count("*").alias("n")).agg(F.sum("n").alias("nodes"), F.count("*").alias("components"), F.max("n").alias("largest"))
    wide = c.crossJoin(e.agg(F.count("*").alias("edges")))
    density = F.round(F.try_divide(F.col("edges"), F.col("nodes") * (F.col("nodes") - 1)), 9)
    return wide.select("nodes", "edges", "components", "largest", density.alias("density"))


def best_websites(spark, sf_dir: str) -> DataFrame:
    """The usable address that each EIN gives most often, ties by the smaller."""
    f = table(spark, sf_dir, "irs990_filings").where("ein IS NOT NULL").select("ein", url_key(F.col("website")).alias("url"))
    return most_frequent(f, ["ein"], "url", "url")


def shared_websites(spark, sf_dir: str) -> DataFrame:
    """Addresses that several organisations give, with how many these are and their forms of exemption."""
    f = table(spark, sf_dir, "irs990_filings").where("ein IS NOT NULL").select("ein", "exempt_organization_type", url_key(F.col("website")).alias("url")).where("url IS NOT NULL")
    kinds: Column = F.array_join(F.array_sort(F.collect_set("exempt_organization_type")), ", ")
    return f.groupBy("url").agg(F.count_distinct("ein").alias("n_orgs"), kinds.alias("kinds")).where("n_orgs > 1")


QUERIES = {f.__name__: f for f in (latest_scores, score_places, part_coverage, modelling_frame, political_neighbours, behaviour, ego_network, network_shape, best_websites, shared_websites)}

_EDGES = """(SELECT ein AS src, trim(grantee_ein) AS dst, round(sum(amount), 2) AS total_amount FROM irs990_filing_grants g JOIN irs990_filings f USING (filing_id) WHERE ein IS NOT NULL AND trim(grantee_ein) <> '' GROUP BY 1, 2)"""
_PARTS = """(SELECT filing_id, ein, tax_year, CASE WHEN voting_members_governing_body IS NOT NULL THEN greatest(least(1 - least(voting_members_governing_body, 25) / 25, 1), 0) END AS board,
 CASE WHEN coalesce(total_volunteers, 0) = 0 THEN 1.0 ELSE 0.0 END AS volunteers, 0.0 AS related_527s, 1.0 AS related_c3s, CAST(NULL AS DOUBLE) AS political,
 CASE WHEN total_expenses > 0 AND total_salaries IS NOT NULL THEN greatest(least(1 - total_salaries / total_expenses, 1), 0) END AS salaries,
 CASE WHEN total_expenses > 0 THEN greatest(least(1 - greatest(unrestricted_net_assets_eoy, 0) / (3 * total_expenses), 1), 0) END AS net_assets,
 CASE WHEN coalesce(grants_and_contributions, 0) = 0 AND coalesce(fundraising_expenses, 0) = 0 THEN 0 WHEN grants_and_contributions > 0 AND fundraising_expenses IS NOT NULL THEN greatest(least(1 - fundraising_expenses / grants_and_contributions, 1), 0) END AS fundraising
 FROM irs990_filings WHERE form_type <> '990T')"""
_SCORES = f"(SELECT filing_id, ein, tax_year, round(coalesce(board, 0) + volunteers + 1 + coalesce(salaries, 0) + coalesce(net_assets, 0) + coalesce(fundraising, 0), 6) AS index_score FROM {_PARTS})"
_KNOWN = "(" + " + ".join(f"({p} IS NOT NULL)::INT" for p in PARTS) + ")"
_NINE = "lpad(regexp_replace(ein, '\\D', '', 'g'), 9, '0')"
_T = "regexp_replace(lower(trim(website, ' \t\n\r\"''()_')), '\\s+', ' ', 'g')"
_REST = f"regexp_replace({_T}, '^(h+t+ps?)(?:[:;.\\s]+/{{0,2}}|/{{1,2}})\\s*', '')"
_TYPED = f"regexp_extract({_T}, '^(h+t+ps?)(?:[:;.\\s]+/{{0,2}}|/{{1,2}})\\s*', 1)"
_HOST = f"regexp_extract({_REST}, '^([^/?#]*)', 1)"
_LABEL = "[^\\s.:-](?:[^\\s.:]*[^\\s.:-])?"
_PATH, _QUERY = f"regexp_extract({_REST}, '^[^/?#]*(/[^?#]*)', 1)", f"regexp_extract({_REST}, '^[^?#]*\\?([^#]+)', 1)"
_URL = f"""CASE WHEN regexp_full_match(regexp_replace({_HOST}, ':\\d*$', ''), '{_LABEL}(?:\\.{_LABEL})+\\.?') AND NOT ({_T} IN ('', '-', '--', '0', 'n/a', 'na', 'no', 'none', 'not applicable', 'null', 'tbd') OR regexp_matches({_REST}, '[\\s@\\\\]|^[a-z][a-z0-9+.-]*://') OR starts_with({_T}, 'see '))
 THEN CASE WHEN {_TYPED} = '' OR {_TYPED} LIKE '%s' THEN 'https://' ELSE 'http://' END || {_HOST} || CASE WHEN {_PATH} = '' THEN '/' ELSE {_PATH} END || CASE WHEN {_QUERY} = '' THEN '' ELSE '?' || {_QUERY} END END"""
SQL = {
    "latest_scores": f"SELECT ein, filing_id, tax_year, index_score FROM {_SCORES} WHERE ein IS NOT NULL QUALIFY row_number() OVER (PARTITION BY ein ORDER BY tax_year DESC NULLS LAST, filing_id DESC) = 1",
    "score_places": f"SELECT filing_id, index_score, row_number() OVER (ORDER BY index_score DESC NULLS LAST, filing_id DESC) AS place FROM {_SCORES}",
    "part_coverage": " UNION ALL ".join([*(f"SELECT '{p}' AS part, round(avg(({p} IS NOT NULL)::INT), 6) AS share FROM {_PARTS}" for p in PARTS), *(f"SELECT 'at_least_{k}', round(avg(({_KNOWN} >= {k})::INT), 6) FROM {_PARTS}" for k in (6, 7, 8))]),
    "modelling_frame": f"""SELECT f.ein, f.filing_id, round(ln(1 + greatest(total_revenue, 0)), 6) AS total_revenue_log, round(ln(1 + greatest(total_expenses, 0)), 6) AS total_expenses_log, round(ln(1 + greatest(total_assets, 0)), 6) AS total_assets_log,
 (total_revenue IS NULL)::INT AS total_revenue_missing, (total_expenses IS NULL)::INT AS total_expenses_missing, (total_assets IS NULL)::INT AS total_assets_missing, coalesce((political_activity_flag > 0)::INT, 0) AS target, s.index_score
 FROM (SELECT * FROM irs990_filings WHERE ein IS NOT NULL AND form_type <> '990T' QUALIFY row_number() OVER (PARTITION BY ein ORDER BY tax_year DESC NULLS LAST, filing_id DESC) = 1) f LEFT JOIN {_SCORES} s USING (filing_id)""",
    "political_neighbours": f"""WITH e AS {_EDGES}, p AS (SELECT DISTINCT ein FROM irs990_filings WHERE political_activity_flag = 1 AND exempt_organization_type IN ('501(c)(4)', '501(c)(5)', '501(c)(6)') AND ein IS NOT NULL),
 o AS (SELECT src AS ein, sum((dst IN (SELECT ein FROM p))::INT) AS po, count(*) AS n FROM e GROUP BY 1), i AS (SELECT dst AS ein, sum((src IN (SELECT ein FROM p))::INT) AS pi, count(*) AS n FROM e GROUP BY 1)
 SELECT ein, round(coalesce(po / o.n, 0), 6) AS out_share, round(coalesce(pi / i.n, 0), 6) AS in_share, coalesce(po, 0) + coalesce(pi, 0) AS n_political FROM o FULL JOIN i USING (ein)""",
    "behaviour": f"""WITH e AS {_EDGES} SELECT f.ein, n_filings, political, coalesce(given, 0) AS given, coalesce(n_grantees, 0) AS n_grantees, coalesce(received, 0) AS received, coalesce(n_donors, 0) AS n_donors, coalesce(n_lobbying, 0) AS n_lobbying
 FROM (SELECT ein, count(*) AS n_filings, max(coalesce(political_activity_flag, 0)) AS political FROM irs990_filings WHERE ein IS NOT NULL GROUP BY 1) f
 LEFT JOIN (SELECT src AS ein, round(sum(total_amount), 2) AS given, count(*) AS n_grantees FROM e GROUP BY 1) USING (ein) LEFT JOIN (SELECT dst AS ein, round(sum(total_amount), 2) AS received, count(*) AS n_donors FROM e GROUP BY 1) USING (ein)
 LEFT JOIN (SELECT {_NINE} AS ein, count(DISTINCT lower(trim(external_source_record_id))) AS n_lobbying FROM approved_external_entity_links WHERE external_source_system = 'LDA' GROUP BY 1) USING (ein)""",
    "ego_network": f"""WITH e AS (SELECT * FROM {_EDGES} WHERE src <> dst), g AS (SELECT src AS node FROM e GROUP BY 1 ORDER BY sum(total_amount) DESC, node LIMIT 25),
 n AS (SELECT node FROM g UNION SELECT dst FROM e WHERE src IN (SELECT node FROM g) UNION SELECT src FROM e WHERE dst IN (SELECT node FROM g)) SELECT * FROM e WHERE src IN (SELECT node FROM n) AND dst IN (SELECT node FROM n)""",
    "network_shape": f"""WITH RECURSIVE e AS (SELECT src, dst FROM {_EDGES}), b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), r(s, v) AS (SELECT src, src FROM b UNION SELECT r.s, b.dst FROM r JOIN b ON b.src = r.v), c AS (SELECT component, count(*) AS n FROM (SELECT v, min(s) AS component FROM r GROUP BY 1) GROUP BY 1)
 SELECT sum(n)::BIGINT AS nodes, (SELECT count(*) FROM e) AS edges, count(*) AS components, max(n) AS largest, round((SELECT count(*) FROM e) / (sum(n) * (sum(n) - 1)), 9) AS density FROM c""",
    "best_websites": f"SELECT ein, url FROM (SELECT ein, {_URL} AS url, count(*) AS n FROM irs990_filings WHERE ein IS NOT NULL GROUP BY ALL) WHERE url IS NOT NULL QUALIFY row_number() OVER (PARTITION BY ein ORDER BY n DESC, url) = 1",
    "shared_websites": f"SELECT url, count(DISTINCT ein) AS n_orgs, coalesce(string_agg(DISTINCT exempt_organization_type, ', ' ORDER BY exempt_organization_type), '') AS kinds FROM (SELECT ein, exempt_organization_type, {_URL} AS url FROM irs990_filings WHERE ein IS NOT NULL) WHERE url IS NOT NULL GROUP BY 1 HAVING count(DISTINCT ein) > 1",
}
