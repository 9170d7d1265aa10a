"""The eight-part transparency index of filings and per-filing features, as plain columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import ratio, word_count
from ..operators.relational import first_per_group
from ..session import table


def unit(x: Column) -> Column:
    """Clipped to 0..1; NULL stays."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)))


def index_parts(df: DataFrame) -> DataFrame:
    """``df`` with the parts of the index and its sum; a part that can't be told is NULL and counts 0.

    Needs: voting_members_governing_body, max_board_size, total_volunteers, num_527s, num_c3s, political_expenses,
    total_expenses, total_salaries, unrestricted_net_assets_eoy, fundraising_expenses, grants_and_contributions.
    """
    board = F.greatest("voting_members_governing_body", "max_board_size")
    given, raised = F.coalesce("grants_and_contributions", F.lit(0.0)), F.coalesce("fundraising_expenses", F.lit(0.0))
    parts = {
        "board": F.when(board.isNotNull(), unit(1 - F.least(board, F.lit(25)) / 25)),
        "volunteers": F.when(F.coalesce("total_volunteers", F.lit(0)) == 0, 1.0).otherwise(0.0),
        "related_527s": F.when(F.col("num_527s") > 0, 1.0).otherwise(0.0),
        "related_c3s": F.when(F.col("num_c3s") == 0, 1.0).otherwise(0.0),
        "political": unit(ratio(F.col("political_expenses"), F.col("total_expenses"))),
        "salaries": unit(1 - ratio(F.col("total_salaries"), F.col("total_expenses"))),
        "net_assets": unit(1 - ratio(F.greatest("unrestricted_net_assets_eoy", F.lit(0.0)), 3 * F.col("total_expenses"))),
        "fundraising": F.when((given == 0) & (raised == 0), 0.0).otherwise(unit(1 - ratio(F.col("fundraising_expenses"), F.col("grants_and_contributions")))),
    }
    df = df.withColumns(parts)
    return df.withColumn("index_score", sum((F.coalesce(p, F.lit(0.0)) for p in parts), F.lit(0.0)))


def index_source(filings: DataFrame, related: DataFrame | None = None, groups_527: DataFrame | None = None, lobbying: DataFrame | None = None) -> DataFrame:
    """Filings (not 990T) with counts of related organisations (filing_id, ein, entity_type), of 527 groups and political expenses, as far as these tables are given."""
    f = filings.where("form_type <> '990T'")
    if related is not None:
        c3 = related.where("ein IS NOT NULL AND entity_type LIKE '%501%(3)%'").join(filings.select("filing_id", "tax_year"), "filing_id")
        boards = filings.where("exempt_organization_type = '501(c)(3)'").groupBy("ein", "tax_year").agg(F.max("voting_members_governing_body").alias("board"))
        c3 = c3.join(boards, ["ein", "tax_year"], "left").groupBy("filing_id").agg(F.count_distinct("ein").alias("num_c3s"), F.max("board").alias("max_board_size"))
        f = f.join(c3, "filing_id", "left")
        some = related.where("entity_type LIKE '%527%'").select("filing_id")
        some = some.unionByName(groups_527.select("filing_id")) if groups_527 is not None else some
        f = f.join(some.groupBy("filing_id").agg(F.count("*").alias("num_527s")), "filing_id", "left")
    else:
        f = f.withColumns({"num_c3s": F.lit(0), "max_board_size": F.lit(None).cast("bigint"), "num_527s": F.lit(0)})
    if lobbying is not None:
        a, b = F.max("total_exempt_function_expend_amt"), F.max("fees_for_services_lobbying_amt")
        known = F.max("total_exempt_function_expend_amt").isNotNull() | F.max("fees_for_services_lobbying_amt").isNotNull()
        f = f.join(lobbying.groupBy("filing_id").agg(F.when(known, F.coalesce(a, F.lit(0.0)) + F.coalesce(b, F.lit(0.0))).alias("political_expenses")), "filing_id", "left")
    else:
        f = f.withColumn("political_expenses", F.lit(None).cast("double"))
    return f.na.fill(0, ["num_c3s", "num_527s"])


def index_scores(spark, sf_dir: str) -> DataFrame:
    parts = ["board", "volunteers", "salaries", "net_assets", "fundraising"]
    return index_parts(index_source(table(spark, sf_dir, "irs990_filings"))).select("filing_id", *[F.round(p, 6).alias(p) for p in parts], F.round("index_score", 6).alias("index_score"))


def filing_features(spark, sf_dir: str) -> DataFrame:
    """One filing per EIN and year with ratios, words of the mission and how often the organisation changed name and address."""
    f = table(spark, sf_dir, "irs990_filings").where("ein IS NOT NULL AND tax_year IS NOT NULL AND form_type NOT IN ('990T')")
    address = F.concat_ws("|", "filer_address", "filer_city", "filer_state", "filer_zip_code")
    changes = f.groupBy("ein").agg(F.count_distinct("filer_name").alias("n_names"), F.count_distinct("doing_business_as_name").alias("n_dba"), F.count_distinct(address).alias("n_addresses"))
    one = first_per_group(f, ["ein", "tax_year"], [F.desc_nulls_last("tax_period_end_date"), F.desc_nulls_last("return_timestamp"), F.desc("filing_id")])
    share = lambda a: F.round(ratio(F.col(a), F.col("total_expenses")), 6)
    return one.join(changes, "ein").select(
        "filing_id", "ein", "tax_year", share("program_services_amt").alias("program_share"), share("management_and_general_amt").alias("management_share"),
        F.round(ratio(F.col("voting_members_independent"), F.col("voting_members_governing_body")), 6).alias("independent_share"), word_count(F.col("mission")).alias("mission_words"), "n_names", "n_dba", "n_addresses",
    )


QUERIES = {"index_scores": index_scores, "filing_features": filing_features}
SQL = {
    "index_scores": """WITH p AS (SELECT filing_id, CASE WHEN voting_members_governing_body IS NOT NULL THEN greatest(least(1 - least(voting_members_governing_body, 25) / 25, 1), 0) END AS board,
 CASE WHEN coalesce(total_volunteers, 0) = 0 THEN 1.0 ELSE 0.0 END AS volunteers,
 CASE WHEN total_expenses > 0 AND total_salaries IS NOT NULL THEN greatest(least(1 - total_salaries / total_expenses, 1), 0) END AS salaries,
 CASE WHEN total_expenses > 0 THEN greatest(least(1 - greatest(unrestricted_net_assets_eoy, 0) / (3 * total_expenses), 1), 0) END AS net_assets,
 CASE WHEN coalesce(grants_and_contributions, 0) = 0 AND coalesce(fundraising_expenses, 0) = 0 THEN 0 WHEN grants_and_contributions > 0 AND fundraising_expenses IS NOT NULL THEN greatest(least(1 - fundraising_expenses / grants_and_contributions, 1), 0) END AS fundraising
 FROM irs990_filings WHERE form_type <> '990T')
 SELECT filing_id, round(CASE WHEN board IS NOT NULL THEN board END, 6) AS board, volunteers, round(salaries, 6) AS salaries, round(net_assets, 6) AS net_assets, round(fundraising, 6) AS fundraising,
 round(coalesce(board, 0) + volunteers + 1 + coalesce(salaries, 0) + coalesce(net_assets, 0) + coalesce(fundraising, 0), 6) AS index_score FROM p""",
    "filing_features": """WITH f AS (SELECT * FROM irs990_filings WHERE ein IS NOT NULL AND tax_year IS NOT NULL AND form_type <> '990T'),
 c AS (SELECT ein, count(DISTINCT filer_name) AS n_names, count(DISTINCT doing_business_as_name) AS n_dba, count(DISTINCT concat_ws('|', filer_address, filer_city, filer_state, filer_zip_code)) AS n_addresses FROM f GROUP BY 1),
 o AS (SELECT *, row_number() OVER (PARTITION BY ein, tax_year ORDER BY tax_period_end_date DESC NULLS LAST, return_timestamp DESC NULLS LAST, filing_id DESC) AS rn FROM f)
 SELECT filing_id, o.ein, tax_year, round(CASE WHEN total_expenses > 0 THEN program_services_amt / total_expenses END, 6) AS program_share, round(CASE WHEN total_expenses > 0 THEN management_and_general_amt / total_expenses END, 6) AS management_share,
 round(CASE WHEN voting_members_governing_body > 0 THEN voting_members_independent / voting_members_governing_body END, 6) AS independent_share,
 CASE WHEN trim(coalesce(mission, '')) = '' THEN 0 ELSE len(regexp_split_to_array(trim(mission), '\\s+')) END AS mission_words, n_names, n_dba, n_addresses FROM o JOIN c USING (ein) WHERE rn = 1""",
}
