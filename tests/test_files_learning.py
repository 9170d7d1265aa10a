import json
import zipfile

import pytest
from pyspark.sql import functions as F

from ledgerloom import sinks
from ledgerloom.operators import learning
from ledgerloom.sources import discovery, files, returns
from ledgerloom.streaming import ingest

XML = """<?xml version="1.0"?><Return xmlns="http://www.irs.gov/efile"><ReturnHeader><TaxYr>2023</TaxYr><TaxPeriodEndDt>2023-12-31</TaxPeriodEndDt>
<Filer><EIN>{ein}</EIN><BusinessName><BusinessNameLine1Txt>BLUE RIVER</BusinessNameLine1Txt><BusinessNameLine2Txt>TRUST</BusinessNameLine2Txt></BusinessName>
<USAddress><AddressLine1Txt>1 MAIN ST</AddressLine1Txt><CityNm>X</CityNm><StateAbbreviationCd>NY</StateAbbreviationCd><ZIPCd>10001</ZIPCd></USAddress></Filer></ReturnHeader>
<ReturnData><IRS990><Organization501cInd organization501cTypeTxt="4">X</Organization501cInd><CYTotalRevenueAmt></CYTotalRevenueAmt><TotalRevenueAmt>1200</TotalRevenueAmt>
<Form990PartVIISectionAGrp><PersonNm>A B</PersonNm><OfficerInd>X</OfficerInd></Form990PartVIISectionAGrp><Form990PartVIISectionAGrp><TitleTxt>nameless</TitleTxt></Form990PartVIISectionAGrp>
<FeesForServicesLobbyingGrp><TotalAmt>50</TotalAmt></FeesForServicesLobbyingGrp></IRS990>
<IRS990ScheduleI><RecipientTable><RecipientEIN>012345678</RecipientEIN><CashGrantAmt>10</CashGrantAmt></RecipientTable><RecipientTable><CashGrantAmt>bad</CashGrantAmt></RecipientTable></IRS990ScheduleI></ReturnData></Return>"""


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_returns_from_files_and_archives(spark, tmp_path):
    (tmp_path / "one.xml").write_text(XML.format(ein="001234567"))
    (tmp_path / "bad.xml").write_text("<Return>")
    with zipfile.ZipFile(tmp_path / "more.zip", "w") as z:
        z.writestr("deep/two.xml", XML.format(ein=""))
        z.writestr("note.txt", "x")
    (tmp_path / "broken.zip").write_bytes(b"no archive")
    r = returns.read_returns(spark, str(tmp_path)).cache()
    assert rows(r.select("source_object_id", "outcome")) == [("bad", "failed"), ("broken.zip", "failed"), ("one", "succeeded"), ("two", "missing_ein")]
    f = returns.filings(r).first()
    assert (f.ein, f.filer_name, f.tax_year, f.total_revenue, f.exempt_organization_type, f.political_activity_flag, f.total_assets) == ("001234567", "BLUE RIVER TRUST", 2023, 1200.0, "501(c)(4)", 1, None)
    assert rows(returns.children(r, "grants").select("line_no", "grantee_ein", "amount")) == [(1, "012345678", 10.0), (2, None, None)]
    assert rows(returns.children(r, "people").select("person_name", "is_officer", "is_key_employee")) == [("A B", 1.0, None)]
    assert returns.lobbying(r).first().fees_for_services_lobbying_amt == 50.0


def test_registry_and_pages(spark, tmp_path):
    (tmp_path / "bmf.csv").write_text("EIN,NAME,ASSET_AMT\n1234567, A ,\"1,200\"\n000000000,no,1\n1234567,B,\n")
    assert rows(files.registry(spark, str(tmp_path / "bmf.csv"))) == [("001234567", "B", None)]
    page = {"results": [{"filing_uuid": "u", "filing_year": 2023, "income": "10.50", "client": {"id": 1, "name": "c"}, "lobbying_activities": [{"general_issue_code": "TAX"}, {"description": "HR 1"}]}]}
    (tmp_path / "page.json").write_text(json.dumps(page) + "\n" + json.dumps(page))
    f, a = files.lobbying_filings(spark, str(tmp_path / "page.json"))
    assert rows(f.select("filing_uuid", "client_id", "income")) == [("u", "1", 10.5)] and a.count() == 2
    (tmp_path / "bills.json").write_text(json.dumps({"bills": [{"congress": 118, "type": "HR", "number": "5", "latestAction": {"text": "t"}}, {"congress": 118, "type": "S"}]}))
    assert rows(files.bills(spark, str(tmp_path / "bills.json")).select("bill_id", "latest_action", "policy_area")) == [("118-hr-5", "t", None)]


def test_views_of_drifting_parquet(spark, tmp_path):
    spark.createDataFrame([(1,)], "a int").write.parquet(f"{tmp_path}/t.parquet/p1")
    spark.createDataFrame([(2, "x")], "a int, b string").write.parquet(f"{tmp_path}/u.parquet")
    got = files.parquet_views(spark, str(tmp_path), ["u", "missing"])
    assert set(got) == {"u"} and rows(got["u"].select(files.optional(got["u"], "b"), files.optional(got["u"], "c"))) == [("x", None)]


def test_runs_and_sorted_tables(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    for run, when in (("r1", "2024-01-01"), ("r2", "2024-02-01"), ("r1", "2024-01-02")):
        sinks.write_run(df, f"{tmp_path}/runs", run, "v1", when)
    assert sinks.latest_run(spark, f"{tmp_path}/runs", "v1") == "r2"
    assert spark.read.parquet(f"{tmp_path}/runs").count() == 4
    with pytest.raises(ValueError):
        sinks.write_run(df.limit(0), f"{tmp_path}/runs", "r3", "v1", "x")
    sinks.write_lookups(df.union(df), f"{tmp_path}/l", "k", "v")
    assert spark.read.parquet(f"{tmp_path}/l_by_v").count() == 2


def test_ingest_takes_each_file_once(spark, tmp_path):
    spark.createDataFrame([(1,)], "a int").write.parquet(f"{tmp_path}/in")
    for n in (1, 1, 2):
        if n == 2:
            spark.createDataFrame([(2,)], "a int").write.mode("append").parquet(f"{tmp_path}/in")
        ingest.ingest_new(spark, f"{tmp_path}/in", "a int", f"{tmp_path}/out", f"{tmp_path}/ck")
        assert spark.read.parquet(f"{tmp_path}/out").count() == n


def test_measures(spark):
    df = spark.createDataFrame([(0.9, 1), (0.8, 0), (0.7, 1), (0.1, 0), (None, 1)], "score double, label int")
    m = dict(rows(learning.measures(df, "label", tops=(1,))))
    assert m["roc_auc"] == 0.75 and m["average_precision"] == pytest.approx((1 + 2 / 3) / 2, abs=1e-8) and m["recall"] == 1.0 and m["recall_at_1"] == 0.5


def test_clusters_density_and_outliers(spark):
    data = [(k, float(k % 5) * 0.01, 0.0) for k in range(50)] + [(100 + k, 10 + float(k % 5) * 0.01, 5.0) for k in range(50)] + [(999, 100.0, -40.0)]
    df = spark.createDataFrame(data, "id int, x double, y double")
    got, k = learning.clusters(df.where("id <> 999"), ["x", "y"], range(2, 4))
    assert k == 2 and got.groupBy("cluster").count().count() == 2
    d = {r.id: r.cluster for r in learning.density_clusters(df, "id", ["x", "y"], eps=0.3).collect()}
    assert d[0] == d[49] and d[100] == d[149] != d[0] and d[999] is None
    s = {r.id: r.score for r in learning.isolation_scores(df, "id", ["x", "y"], trees=50).collect()}
    assert max(s, key=s.get) == 999


def test_splits_keep_groups_whole(spark):
    df = spark.range(1000).select((F.col("id") % 97).alias("g"), (F.col("id") % 10 + 2010).alias("year"))
    train, test = learning.grouped_split(df, "g")
    assert train.select("g").intersect(test.select("g")).count() == 0 and train.count() + test.count() == 1000 and test.count() > 100
    train, test = learning.temporal_split(df, "g", "year", 2018)
    assert train.join(test, "g", "left_semi").count() == 0


def test_tables_replaced_exported_and_found(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", "r1"), (2, "b", "r1")], "filing_id int, v string, run_id string")
    names = spark.createDataFrame([(1, "x"), (2, "y")], "filing_id int, filer_name string")
    for _ in range(2):
        sinks.export_run(df, names, f"{tmp_path}/t.parquet")
    assert [p.name for p in tmp_path.iterdir()] == ["t.parquet"]
    assert sinks.import_run(spark, f"{tmp_path}/t.parquet", ["v", "filer_name"], "v2").where("version = 'v2'").count() == 2
    for bad in (lambda: sinks.export_run(df.limit(0), names, f"{tmp_path}/u"), lambda: sinks.import_run(spark, f"{tmp_path}/t.parquet", ["zz"], "v")):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(Exception):  # noqa: B017
        sinks.replaced(df.selectExpr("raise_error('stop') AS x"), f"{tmp_path}/t.parquet")
    assert spark.read.parquet(f"{tmp_path}/t.parquet").count() == 2
    assert [(r.table_name, r.files > 0) for r in discovery.tables_in(spark, str(tmp_path)).collect()] == [("t", True)]
    assert [r.column_name for r in discovery.columns_of(spark, str(tmp_path)).collect()] == ["filing_id", "v", "run_id", "filer_name"]
    sinks.write_csv(df.select("filing_id", "v"), f"{tmp_path}/c")
    ok = discovery.typed_csv(spark, f"{tmp_path}/c", "filing_id int, v string", {"known": lambda: F.col("filing_id") > 0}, ["v"])
    assert ok.count() == 2
    with pytest.raises(ValueError):
        discovery.typed_csv(spark, f"{tmp_path}/c", "filing_id int, v string", {"known": lambda: F.col("filing_id") > 1})


def test_foundations_contractors_and_related(spark):
    xml = b"""<Return><ReturnHeader><Filer><EIN>123456789</EIN></Filer></ReturnHeader><ReturnData><IRS990PF><Organization501c3ExemptPFInd>X</Organization501c3ExemptPFInd>
    <AnalysisOfRevenueAndExpenses><TotalRevAndExpnssAmt>50</TotalRevAndExpnssAmt></AnalysisOfRevenueAndExpenses><StatementsRegardingActyGrp><LegislativePoliticalActyInd>true</LegislativePoliticalActyInd></StatementsRegardingActyGrp>
    <ContractorCompensationGrp><ContractorName><BusinessName><BusinessNameLine1Txt>ACME</BusinessNameLine1Txt></BusinessName></ContractorName><CompensationAmt>7</CompensationAmt></ContractorCompensationGrp><ContractorCompensationGrp><CompensationAmt>8</CompensationAmt></ContractorCompensationGrp></IRS990PF>
    <IRS990ScheduleR><IdRelatedOrgTxblPartnershipGrp><RelatedOrganizationName><BusinessNameLine1Txt>P</BusinessNameLine1Txt></RelatedOrganizationName><DirectControllingEntityName><BusinessNameLine1Txt>N/A</BusinessNameLine1Txt></DirectControllingEntityName></IdRelatedOrgTxblPartnershipGrp>
    <TransactionsRelatedOrgGrp><OtherOrganizationName><BusinessNameLine1Txt>Q</BusinessNameLine1Txt></OtherOrganizationName><TransactionTypeTxt>b</TransactionTypeTxt><InvolvedAmt>3</InvolvedAmt></TransactionsRelatedOrgGrp>
    <TransactionsRelatedOrgGrp><OtherOrganizationName><BusinessNameLine1Txt>Q</BusinessNameLine1Txt></OtherOrganizationName><TransactionTypeTxt>Z</TransactionTypeTxt></TransactionsRelatedOrgGrp></IRS990ScheduleR></ReturnData></Return>"""
    r = returns.parse(xml)
    assert (r["exempt_organization_type"], r["total_revenue"], r["political_activity_flag"]) == ("501(c)(3)", 50.0, 1)
    c = r["children"]
    assert [(x["line_no"], x["contractor_name"], x["compensation"]) for x in c["contractors"]] == [(1, "ACME", 7.0)]
    assert [(x["entity_type"], x["controlling_entity"]) for x in c["related_partnerships"]] == [("Taxable Partnership", None)]
    assert [(x["type"], x["amount"]) for x in c["related_transactions"]] == [("B", 3.0)]
