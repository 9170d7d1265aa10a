"""E-filed returns: XML files and ZIP archives of them, into filings and child rows."""

from __future__ import annotations

import hashlib
import io
import json
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Element names (local, by path) that hold each field; the first that is there counts.
HEADER = {"ein": "Filer/EIN", "tax_year": "TaxYr|TaxYear", "tax_period_end_date": "TaxPeriodEndDt", "return_timestamp": "ReturnTs"}
AMOUNTS = {
    "total_revenue": "CYTotalRevenueAmt|TotalRevenueCurrentYear|TotalRevenueAmt",
    "total_expenses": "CYTotalExpensesAmt|TotalExpensesCurrentYear|TotalExpensesAmt",
    "total_assets": "TotalAssetsEOYAmt|TotalAssetsCurrentYear|Form990TotalAssetsGrp/EOYAmt",
    "grants_and_contributions": "CYGrantsAndContriAmt|CYContributionsGiftsGrantsAmt|CYContributionsGrantsAmt|ContributionsGiftsGrantsAmt|ContributionsGiftsGrantsCurrentYear|TotalContributionsAmt",
    "voting_members_governing_body": "VotingMembersGoverningBodyCnt",
    "voting_members_independent": "VotingMembersIndependentCnt",
    "total_volunteers": "TotalVolunteersCnt",
    "total_salaries": "CYSalariesCompEmpBnftPaidAmt|SalariesAndWagesAmt",
    "unrestricted_net_assets_eoy": "NoDonorRestrictionNetAssetsGrp/EOYAmt|UnrestrictedNetAssetsGrp/EOYAmt|NetAssetsOrFundBalancesEOYAmt",
    "fundraising_expenses": "CYTotalProfFndrsngExpnsAmt|TotalFundraisingExpenseAmt",
    "program_services_amt": "TotalFunctionalExpensesGrp/ProgramServicesAmt",
    "management_and_general_amt": "TotalFunctionalExpensesGrp/ManagementAndGeneralAmt",
}
TEXTS = {"website": "WebsiteAddressTxt", "mission": "MissionDesc|ActivityOrMissionDesc|MissionStatement|PrimaryExemptPurposeTxt"}
LOBBYING = {
    "total_exempt_function_expend_amt": "TotalExemptFunctionExpendAmt",
    "total_lobbying_expend_amt": "TotalLobbyingExpendGrp/FilingOrganizationsTotalAmt",
    "total_exempt_purpose_expend_amt": "TotalExemptPurposeExpendGrp/FilingOrganizationsTotalAmt",
    "lobbying_nontaxable_amt": "LobbyingNontaxableAmountGrp/FilingOrganizationsTotalAmt",
    "grassroots_nontaxable_amt": "GrassrootsNontaxableGrp/FilingOrganizationsTotalAmt",
    "lobbying_ceiling_amt": "LobbyingCeilingAmt",
    "grassroots_ceiling_amt": "GrassrootsCeilingAmt",
    "total_lobbying_expenditures_amt": "TotalLobbyingExpendituresAmt",
    "direct_contact_legislators_amt": "DirectContactLegislatorsAmt",
    "other_lobbying_activities_amt": "OtherActivitiesAmt",
    "nondeductible_lobbying_pltcl_amt": "NonDeductibleLbbyngPltclTotAmt",
    "taxable_amt": "TaxableAmt",
}
US_PLACE = {"address": "USAddress/AddressLine1Txt", "city": "USAddress/CityNm", "state": "USAddress/StateAbbreviationCd", "zip_code": "USAddress/ZIPCd"}
#: Kinds of transactions with related organisations; the constant kind of related ones whose schedule names none; what stands for no controlling entity.
TRANSACTIONS, ENTITY_TYPES, NO_ENTITY = set("ABCDEFGHIJKLMNOPQRS"), {"related_partnerships": "Taxable Partnership", "related_corporations": "Taxable Corporation or Trust"}, ("N/A", "NA")
#: What a private foundation's return has in other places.
FOUNDATION = {
    "total_revenue": "AnalysisOfRevenueAndExpenses/TotalRevAndExpnssAmt|TotalRevAndExpnssAmt", "total_expenses": "AnalysisOfRevenueAndExpenses/TotalExpensesRevAndExpnssAmt|TotalExpensesRevAndExpnssAmt",
    "total_assets": "FMVAssetsEOYAmt|Form990PFBalanceSheetsGrp/TotalAssetsEOYAmt", "total_salaries": "CompOfcrDirTrstRevAndExpnssAmt|AnalysisOfRevenueAndExpenses/CompOfcrDirTrstRevAndExpnssAmt",
    "unrestricted_net_assets_eoy": "Form990PFBalanceSheetsGrp/TotNetAstOrFundBalancesEOYAmt|TotNetAstOrFundBalancesEOYAmt",
}
#: Child rows: (where they are, group elements, text fields, numbers, field that must be there).
CHILDREN = {
    "people": (
        "form", "Form990PartVIISectionAGrp|OfficerDirectorTrusteeKeyEmpl|OfficerDirectorTrusteeEmplGrp",
        {"person_name": "PersonNm|PersonName|NamePerson", "title": "TitleTxt|Title"},
        {"compensation_from_org": "ReportableCompFromOrgAmt|CompensationAmt", "compensation_from_related_org": "ReportableCompFromRltdOrgAmt", "compensation_other": "OtherCompensationAmt|ExpenseAccountOtherAllwncAmt", "avg_weekly_hours_worked_org": "AverageHoursPerWeekRt|AverageHrsPerWkDevotedToPosRt", "avg_weekly_hours_worked_related_org": "AverageHoursPerWeekRltdOrgRt"},
        "person_name",
    ),
    "grants": (
        "IRS990ScheduleI", "RecipientTable",
        {"grantee_ein": "RecipientEIN|EINOfRecipient", "grantee_name": "RecipientBusinessName/BusinessNameLine1Txt|RecipientNameBusiness/BusinessNameLine1|RecipientPersonNm"},
        {"amount": "CashGrantAmt|AmountOfCashGrant"}, None,
    ),
    "disregarded": ("IRS990ScheduleR", "IdDisregardedEntitiesGrp", {"ein": "EIN", "name": "DisregardedEntityName/BusinessNameLine1Txt", "primary_activities": "PrimaryActivitiesTxt", "address": "USAddress/AddressLine1Txt", "city": "USAddress/CityNm", "state": "USAddress/StateAbbreviationCd", "zip_code": "USAddress/ZIPCd"}, {}, None),
    "contractors": (
        "form", "ContractorCompensationGrp",
        {"contractor_name": "ContractorName/PersonNm|ContractorName/BusinessName/BusinessNameLine1Txt|ContractorName/BusinessNameLine1Txt", "services_description": "ServicesDesc", **{k: f"ContractorAddress/USAddress/{v}|ContractorAddress/{v}" for k, v in (("address", "AddressLine1Txt"), ("city", "CityNm"), ("state", "StateAbbreviationCd"), ("zip_code", "ZIPCd"))}},
        {"compensation": "CompensationAmt"}, "contractor_name",
    ),
    "groups_527": ("IRS990ScheduleC", "Section527PoliticalOrgGrp", {"ein": "EIN", "name": "OrganizationBusinessName/BusinessNameLine1Txt", **US_PLACE}, {"paid_internal_funds": "PaidInternalFundsAmt", "contributions_transferred": "ContributionsRcvdDlvrAmt"}, None),
    "related_partnerships": ("IRS990ScheduleR", "IdRelatedOrgTxblPartnershipGrp", {"ein": "EIN", "name": "RelatedOrganizationName/BusinessNameLine1Txt", "primary_activities": "PrimaryActivitiesTxt", "controlling_entity": "DirectControllingEntityName/BusinessNameLine1Txt", **US_PLACE}, {}, None),
    "related_corporations": ("IRS990ScheduleR", "IdRelatedOrgTxblCorpTrGrp", {"ein": "EIN", "name": "RelatedOrganizationName/BusinessNameLine1Txt", "entity_type": "EntityTypeTxt", "primary_activities": "PrimaryActivitiesTxt", "controlling_entity": "DirectControllingEntityName/BusinessNameLine1Txt", **US_PLACE}, {}, None),
    "related_transactions": ("IRS990ScheduleR", "TransactionsRelatedOrgGrp", {"related_org_name": "OtherOrganizationName/BusinessNameLine1Txt", "type": "TransactionTypeTxt", "method": "MethodOfAmountDeterminationTxt"}, {"amount": "InvolvedAmt"}, "related_org_name"),
    "related_exempt": ("IRS990ScheduleR", "IdRelatedTaxExemptOrgGrp", {"ein": "EIN", "name": "DisregardedEntityName/BusinessNameLine1Txt", "entity_type": "ExemptCodeSectionTxt", "primary_activities": "PrimaryActivitiesTxt", "address": "USAddress/AddressLine1Txt", "city": "USAddress/CityNm", "state": "USAddress/StateAbbreviationCd", "zip_code": "USAddress/ZIPCd"}, {}, None),
}
FLAGS = {"is_indiv_trustee_or_director": "IndividualTrusteeOrDirectorInd", "is_institutional_trustee": "InstitutionalTrusteeInd", "is_officer": "OfficerInd", "is_key_employee": "KeyEmployeeInd", "is_highest_compensated_employee": "HighestCompensatedEmployeeInd"}


def local(element: ElementTree.Element) -> str:
    return element.tag.rpartition("}")[2]


def child(element: ElementTree.Element | None, name: str) -> ElementTree.Element | None:
    return None if element is None else next((c for c in element if local(c) == name), None)


def value(element: ElementTree.Element | None, paths: str) -> str | None:
    """The first non-empty text at one of the ``|``-separated paths."""
    for path in paths.split("|"):
        at = element
        for step in path.split("/"):
            at = child(at, step)
        if at is not None and (text := (at.text or "").strip()):
            return text
    return None


def amount(text: str | None) -> float | None:
    try:
        return None if text is None else float(text.replace(",", ""))
    except ValueError:
        return None


def flag(text: str | None) -> float | None:
    return None if text is None else float(text.lower() in ("1", "x", "true"))


def business_name(element: ElementTree.Element | None, *tags: str) -> str | None:
    group = next((g for t in tags if (g := child(element, t)) is not None), None)
    lines = [value(group, "BusinessNameLine1Txt|BusinessNameLine1"), value(group, "BusinessNameLine2Txt|BusinessNameLine2")]
    return " ".join(x for x in lines if x) or None


def parse(content: bytes) -> dict:
    """A return as a dictionary: filing fields, ``children`` by kind with line numbers, ``lobbying``. Any namespace; absent fields are None."""
    root = ElementTree.fromstring(content)
    header, data = child(root, "ReturnHeader"), child(root, "ReturnData")
    filer = child(header, "Filer")
    main = next((c for c in (data if data is not None else ()) if local(c).startswith("IRS990")), None)
    form = next((f for f in (child(data, t) for t in ("IRS990", "IRS990EZ", "IRS990PF")) if f is not None), None)
    out = {k: value(header, p) for k, p in HEADER.items()}
    out["tax_year"] = int(out["tax_year"]) if (out["tax_year"] or "").isdigit() else None
    out["filer_name"] = business_name(filer, "BusinessName", "Name")
    out["doing_business_as_name"] = business_name(main, "DoingBusinessAsName")
    out["form_type"] = local(main).removeprefix("IRS") if main is not None else None
    place = next((a for a in (child(filer, t) for t in ("USAddress", "ForeignAddress", "Address")) if a is not None), None)
    out |= {"filer_address": value(place, "AddressLine1Txt|AddressLine1"), "filer_city": value(place, "CityNm|City"), "filer_state": value(place, "StateAbbreviationCd|State|ProvinceOrStateNm"), "filer_zip_code": value(place, "ZIPCd|ZIPCode|ForeignPostalCd")}
    section = child(form, "Organization501cInd")
    if child(form, "Organization501c3Ind") is not None:
        out["exempt_organization_type"] = "501(c)(3)"
    else:
        number = None if section is None else next((v for k, v in section.attrib.items() if k.rpartition("}")[2] == "organization501cTypeTxt"), None)
        out["exempt_organization_type"] = f"501(c)({number})" if number else None
    out |= {k: amount(value(form, p)) for k, p in AMOUNTS.items()} | {k: value(form, p) for k, p in TEXTS.items()}
    foundation = form is not None and local(form) == "IRS990PF"
    if foundation:
        out |= {k: amount(value(form, p)) for k, p in FOUNDATION.items()}
        if value(form, "Organization501c3ExemptPFInd"):
            out["exempt_organization_type"] = "501(c)(3)"
        elif value(form, "Organization4947a1NotPFInd"):
            out["exempt_organization_type"] = "4947(a)(1)"
    fees = amount(value(form, "FeesForServicesLobbyingGrp/TotalAmt"))
    schedule = child(data, "IRS990ScheduleC")
    lobbying = {k: amount(value(schedule, p)) for k, p in LOBBYING.items()} | {"fees_for_services_lobbying_amt": fees}
    out["lobbying"] = lobbying if schedule is not None or fees is not None else None
    marked = flag(value(form, "StatementsRegardingActyGrp/LegislativePoliticalActyInd" if foundation else "PoliticalCampaignActyInd|PoliticalActivitiesInd")) == 1.0
    spent = sum(lobbying[k] or 0.0 for k in ("total_lobbying_expend_amt", "total_lobbying_expenditures_amt", "fees_for_services_lobbying_amt"))
    out["political_activity_flag"] = None if form is None else int(marked or spent > 0)
    out["children"] = {}
    for kind, (where, groups, texts, numbers, needed) in CHILDREN.items():
        at = form if where == "form" else child(data, where)
        found = [g for t in groups.split("|") for g in (at if at is not None else ()) if local(g) == t]
        rows = [{k: value(g, p) for k, p in texts.items()} | {k: amount(value(g, p)) for k, p in numbers.items()} | ({k: flag(value(g, p)) for k, p in FLAGS.items()} if kind == "people" else {}) for g in found]
        rows = [r for r in rows if needed is None or r[needed]]
        if kind in ENTITY_TYPES:
            rows = [r | {"entity_type": r.get("entity_type") or ENTITY_TYPES[kind], "controlling_entity": None if r["controlling_entity"] in NO_ENTITY else r["controlling_entity"]} for r in rows]
        if kind == "related_transactions":
            rows = [r | {"type": r["type"].upper()} for r in rows if r["type"] and r["type"].upper() in TRANSACTIONS]
        out["children"][kind] = [{"line_no": n, **r} for n, r in enumerate(rows, 1)]
    return out


SCHEMA = "source_object_id string, content_sha256 string, byte_size long, outcome string, error string, record_json string"


def _documents(path: str, content: bytes) -> Iterator[tuple[str, bytes | None, str | None]]:
    """(object id, bytes, error) of an XML file, or of every XML member of a ZIP archive."""
    if not path.lower().endswith(".zip"):
        yield path.rpartition("/")[2].removesuffix(".xml"), content, None
        return
    try:
        archive = zipfile.ZipFile(io.BytesIO(content))
    except zipfile.BadZipFile as e:
        yield path.rpartition("/")[2], None, str(e)
        return
    for info in archive.infolist():
        if info.filename.lower().endswith(".xml"):
            name = info.filename.rpartition("/")[2].removesuffix(".xml")
            try:
                yield name, archive.read(info), None
            except (NotImplementedError, zipfile.BadZipFile, RuntimeError) as e:
                yield name, None, f"unsupported_compression: {e}"


def read_returns(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """One row per return under ``path`` (XML files and ZIP archives) with its digest, outcome (succeeded, missing_ein, failed) and record as JSON."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for p, c in zip(batch["path"], batch["content"], strict=True):
                for name, body, error in _documents(p, c):
                    record, outcome = None, "failed"
                    if body is not None:
                        try:
                            record = parse(body)
                            outcome = "succeeded" if record["ein"] else "missing_ein"
                        except ElementTree.ParseError as e:
                            error = str(e)
                    rows.append((name, hashlib.sha256(body).hexdigest() if body is not None else None, len(body) if body is not None else None, outcome, error, json.dumps(record, ensure_ascii=False) if record else None))
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in SCHEMA.split(", ")])

    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInPandas(work, SCHEMA)


def filings(returns: DataFrame) -> DataFrame:
    """The filings of ``read_returns`` as columns."""
    texts = [*HEADER, "filer_name", "doing_business_as_name", "form_type", "filer_address", "filer_city", "filer_state", "filer_zip_code", "exempt_organization_type", *TEXTS]
    schema = ", ".join(f"{c} {'bigint' if c == 'tax_year' else 'string'}" for c in texts) + "".join(f", {c} double" for c in AMOUNTS) + ", political_activity_flag bigint"
    return returns.where("outcome = 'succeeded'").select("source_object_id", F.from_json("record_json", schema).alias("r")).select("source_object_id", "r.*")


def children(returns: DataFrame, kind: str) -> DataFrame:
    """The child rows of one kind (see ``CHILDREN``) with source_object_id and line_no."""
    _, _, texts, numbers, _ = CHILDREN[kind]
    extra = dict.fromkeys(FLAGS, "double") if kind == "people" else {}
    texts = dict.fromkeys([*texts, "entity_type"]) if kind in ENTITY_TYPES else texts
    row = ", ".join(["line_no: int", *[f"{c}: string" for c in texts], *[f"{c}: double" for c in [*numbers, *extra]]])
    parsed = returns.where("outcome = 'succeeded'").select("source_object_id", F.explode(F.from_json(F.get_json_object("record_json", f"$.children.{kind}"), f"array<struct<{row}>>")).alias("c"))
    return parsed.select("source_object_id", "c.*")


def lobbying(returns: DataFrame) -> DataFrame:
    """Schedule C amounts of the returns that have any."""
    names = [*LOBBYING, "fees_for_services_lobbying_amt"]
    schema = ", ".join(f"{c} double" for c in names)
    rows = returns.where("outcome = 'succeeded'").select("source_object_id", F.from_json(F.get_json_object("record_json", "$.lobbying"), schema).alias("l")).select("source_object_id", "l.*")
    return rows.where(F.coalesce(*names).isNotNull())


def to_read_again(manifest: DataFrame, version: str, prefix: str | None = None, wanted: DataFrame | None = None, most: int | None = None) -> DataFrame:
    """Objects of ``manifest`` that another version read, or none with success: those under ``prefix``, of the EINs in ``wanted``, and at most ``most``, as far as these are given."""
    stale = manifest.where(~F.col("parser_version").eqNullSafe(F.lit(version)) | ~F.col("ingest_status").eqNullSafe(F.lit("succeeded")))
    stale = stale if prefix is None else stale.where(F.col("path").startswith(prefix))
    stale = stale if wanted is None else stale.join(wanted.select("ein").distinct(), "ein", "left_semi")
    return stale if most is None else stale.orderBy("source_object_id").limit(most)
