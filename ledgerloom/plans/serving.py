"""Questions asked interactively: searches, tops, neighbours, and read-only SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.relational import first_per_group
from ..session import table
from .network import activities, grants_with_filers, latest_names

READ_ONLY = ("select", "with", "show", "describe", "explain", "values", "from", "table", "desc")


def run_sql(spark: SparkSession, statement: str, most_rows: int = 10_000, args: dict | None = None) -> DataFrame:
    """One read-only statement, capped. It must begin like a query and its analysed plan must hold no command that writes."""
    text = statement.strip().rstrip(";").strip()
    if not text or ";" in text:
        raise ValueError("exactly one statement is allowed")
    if text.split(None, 1)[0].lower() not in READ_ONLY:
        raise ValueError("only statements that read are allowed")
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(text).toString()
    if any(w in plan for w in ("InsertInto", "CreateTable", "CreateView", "DropTable", "DeleteFrom", "UpdateTable", "MergeInto", "AlterTable", "TruncateTable")):
        raise ValueError("only statements that read are allowed")
    return spark.sql(text, args or {}).limit(most_rows)


def find_organizations(spark, sf_dir: str, query: str, most: int = 100) -> DataFrame:
    """Organisations by EIN or by part of their latest name: filings, latest year and totals, the largest first."""
    f = table(spark, sf_dir, "irs990_filings")
    if query.strip().isdigit():
        f = f.where(F.col("ein") == query.strip())
    else:
        named = latest_names(spark, sf_dir).where(F.col("filer_name").ilike(f"%{query.strip()}%")).select("ein")
        f = f.join(named, "ein", "left_semi")
    sums = f.groupBy("ein", "filer_name").agg(F.count("*").alias("filings"), F.max("tax_year").alias("latest_year"), F.round(F.sum("total_revenue"), 2).alias("total_revenue"))
    return sums.orderBy(F.desc_nulls_last("total_revenue"), "ein", "filer_name").limit(most)


def neighbours(spark, sf_dir: str, ein: str, top: int = 25) -> DataFrame:
    """The largest grants out of and into an organisation: (direction, other, amount)."""
    g = grants_with_filers(spark, sf_dir).where("grantee_ein IS NOT NULL")
    out = g.where(F.col("ein") == ein).groupBy(F.lit("out").alias("direction"), F.col("grantee_ein").alias("other")).agg(F.round(F.sum("amount"), 2).alias("amount"))
    into = g.where(F.col("grantee_ein") == ein).groupBy(F.lit("in").alias("direction"), F.col("ein").alias("other")).agg(F.round(F.sum("amount"), 2).alias("amount"))
    return first_per_group(out.unionByName(into), ["direction"], [F.desc_nulls_last("amount"), F.asc("other")], top)


def food_banks(spark, sf_dir: str) -> DataFrame:
    return find_organizations(spark, sf_dir, "food bank")


def hub_neighbours(spark, sf_dir: str) -> DataFrame:
    """The neighbours of the EIN that receives the most grants."""
    g = table(spark, sf_dir, "irs990_filing_grants").where("grantee_ein IS NOT NULL").groupBy("grantee_ein").agg(F.count("*").alias("n"))
    hub = g.orderBy(F.desc("n"), "grantee_ein").first()
    return neighbours(spark, sf_dir, hub.grantee_ein if hub else "")


def shared_grantees(spark, sf_dir: str, most: int = 8) -> DataFrame:
    """For each grantee up to ``most`` of the organisations that give to it, by EIN."""
    pairs = grants_with_filers(spark, sf_dir).where("ein IS NOT NULL AND grantee_ein IS NOT NULL").select("grantee_ein", "ein").distinct()
    return first_per_group(pairs, ["grantee_ein"], [F.asc("ein")], most)


def issue_flow(spark, sf_dir: str, top_issues: int = 5, top_clients: int = 5) -> DataFrame:
    """The clients with the most activities in each of the issues with the most: (issue, client, n)."""
    a = activities(spark, sf_dir).where("general_issue_code IS NOT NULL").join(table(spark, sf_dir, "lda_filings").where("client_id IS NOT NULL").select("filing_uuid", "client_id"), "filing_uuid")
    top = a.groupBy("general_issue_code").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "general_issue_code").limit(top_issues).select("general_issue_code")
    by = a.join(top, "general_issue_code", "left_semi").groupBy("general_issue_code", "client_id").agg(F.count("*").alias("n"))
    return first_per_group(by, ["general_issue_code"], [F.desc("n"), F.asc("client_id")], top_clients)


QUERIES = {f.__name__: f for f in (food_banks, hub_neighbours, shared_grantees, issue_flow)}
_A = """(SELECT l.client_id, a.value ->> 'general_issue_code' AS general_issue_code FROM (SELECT * FROM lda_filings WHERE client_id IS NOT NULL AND CASE WHEN json_valid(raw_json) THEN json_type(raw_json) = 'OBJECT' ELSE false END) l, json_each(l.raw_json, '$.lobbying_activities') a)"""
SQL = {
    "food_banks": """SELECT ein, filer_name, count(*) AS filings, max(tax_year) AS latest_year, round(sum(total_revenue), 2) AS total_revenue FROM irs990_filings
 WHERE ein IN (SELECT ein FROM (SELECT ein, filer_name, row_number() OVER (PARTITION BY ein ORDER BY tax_year DESC NULLS LAST, filing_id DESC) AS rn FROM irs990_filings WHERE ein IS NOT NULL AND filer_name IS NOT NULL) WHERE rn = 1 AND filer_name ILIKE '%food bank%')
 GROUP BY ein, filer_name ORDER BY total_revenue DESC NULLS LAST, ein, filer_name LIMIT 100""",
    "shared_grantees": """SELECT grantee_ein, ein FROM (SELECT *, row_number() OVER (PARTITION BY grantee_ein ORDER BY ein) AS rn FROM (
 SELECT DISTINCT g.grantee_ein, f.ein FROM irs990_filing_grants g JOIN irs990_filings f USING (filing_id) WHERE f.ein IS NOT NULL AND g.grantee_ein IS NOT NULL)) WHERE rn <= 8""",
    "hub_neighbours": """WITH g AS (SELECT g.grantee_ein, f.ein, g.amount FROM irs990_filing_grants g JOIN irs990_filings f USING (filing_id) WHERE g.grantee_ein IS NOT NULL),
 h AS (SELECT grantee_ein FROM irs990_filing_grants WHERE grantee_ein IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
 p AS (SELECT 'out' AS direction, grantee_ein AS other, round(sum(amount), 2) AS amount FROM g WHERE ein = (SELECT grantee_ein FROM h) GROUP BY 2
 UNION ALL SELECT 'in', ein, round(sum(amount), 2) FROM g WHERE grantee_ein = (SELECT grantee_ein FROM h) GROUP BY 2)
 SELECT direction, other, amount FROM (SELECT *, row_number() OVER (PARTITION BY direction ORDER BY amount DESC NULLS LAST, other) AS rn FROM p) WHERE rn <= 25""",
    "issue_flow": f"""WITH a AS (SELECT * FROM {_A} WHERE general_issue_code IS NOT NULL), t AS (SELECT general_issue_code FROM a GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 5),
 b AS (SELECT general_issue_code, client_id, count(*) AS n FROM a WHERE general_issue_code IN (SELECT general_issue_code FROM t) GROUP BY 1, 2)
 SELECT general_issue_code, client_id, n FROM (SELECT *, row_number() OVER (PARTITION BY general_issue_code ORDER BY n DESC, client_id) AS rn FROM b) WHERE rn <= 5""",
}
