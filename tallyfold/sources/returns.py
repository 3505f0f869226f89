"""E-filed returns: XML in archives to typed tables, parsed once by Spark's own XML reader.

A return is described by a schema of the elements that are wanted; ``from_xml``
reads them in the JVM and ignores the rest, and repeated groups become rows with
their place.  Elements that are missing stay null; a filed zero is a zero.
"""

from __future__ import annotations

import io
import zipfile

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from ..functions import text as T

_REV, _BAL = "AnalysisOfRevenueAndExpenses", "Form990PFBalanceSheetsGrp"
#: Financial line -> (group, element) of the public return schema; no group: a line of the form itself.
FIN_LINES = {
    "contributions_received": (_REV, "ContriRcvdRevAndExpnssAmt"), "interest_income": (_REV, "InterestOnSavRevAndExpnssAmt"), "dividends": (_REV, "DividendsRevAndExpnssAmt"), "gross_rents": (_REV, "GrossRentsRevAndExpnssAmt"),
    "net_gain_sale_assets": (_REV, "NetGainSaleAstRevAndExpnssAmt"), "gross_sales_price": (_REV, "GrossSalesPriceAmt"), "capital_gain_net_income": (_REV, "CapGainNetIncmNetInvstIncmAmt"), "other_income": (_REV, "OtherIncomeRevAndExpnssAmt"),
    "total_revenue": (_REV, "TotalRevAndExpnssAmt"), "total_revenue_net_invst": (_REV, "TotalNetInvstIncmAmt"), "total_revenue_adj_net": (_REV, "TotalAdjNetIncmAmt"), "officer_comp": (_REV, "CompOfcrDirTrstRevAndExpnssAmt"),
    "other_salaries": (_REV, "OthEmplSlrsWgsRevAndExpnssAmt"), "pension_benefits": (_REV, "PensionEmplBnftRevAndExpnssAmt"), "legal_fees": (_REV, "LegalFeesRevAndExpnssAmt"), "accounting_fees": (_REV, "AccountingFeesRevAndExpnssAmt"),
    "other_prof_fees": (_REV, "OtherProfFeesRevAndExpnssAmt"), "interest_expense": (_REV, "InterestRevAndExpnssAmt"), "taxes": (_REV, "TaxesRevAndExpnssAmt"), "depreciation": (_REV, "DeprecAndDpltnRevAndExpnssAmt"),
    "occupancy": (_REV, "OccupancyRevAndExpnssAmt"), "travel_conferences": (_REV, "TravConfMeetingRevAndExpnssAmt"), "printing_publications": (_REV, "PrintingAndPubRevAndExpnssAmt"), "other_expenses": (_REV, "OtherExpensesRevAndExpnssAmt"),
    "total_operating_expenses": (_REV, "TotOprExpensesRevAndExpnssAmt"), "contributions_paid": (_REV, "ContriPaidRevAndExpnssAmt"), "total_expenses": (_REV, "TotalExpensesRevAndExpnssAmt"), "total_expenses_net_invst": (_REV, "TotalExpensesNetInvstIncmAmt"),
    "charitable_disbursements": (_REV, "TotalExpensesDsbrsChrtblAmt"), "excess_revenue_over_expenses": (_REV, "ExcessRevenueOverExpensesAmt"), "net_investment_income": (_REV, "NetInvestmentIncomeAmt"), "adjusted_net_income": (_REV, "AdjustedNetIncomeAmt"),
    "total_assets_boy": (_BAL, "TotalAssetsBOYAmt"), "total_assets_eoy": (_BAL, "TotalAssetsEOYAmt"), "total_assets_eoy_fmv": (_BAL, "TotalAssetsEOYFMVAmt"), "total_liabilities_boy": (_BAL, "TotalLiabilitiesBOYAmt"),
    "total_liabilities_eoy": (_BAL, "TotalLiabilitiesEOYAmt"), "net_assets_boy": (_BAL, "TotNetAstOrFundBalancesBOYAmt"), "net_assets_eoy": (_BAL, "TotNetAstOrFundBalancesEOYAmt"),
    "other_increases": ("ChgInNetAssetsFundBalancesGrp", "OtherIncreasesAmt"), "other_decreases": ("ChgInNetAssetsFundBalancesGrp", "OtherDecreasesAmt"), "fmv_assets_eoy": (None, "FMVAssetsEOYAmt"),
    "excise_tax": ("ExciseTaxBasedOnInvstIncmGrp", "TaxBasedOnInvestmentIncomeAmt"), "net_noncharitable_assets": ("MinimumInvestmentReturnGrp", "NetVlNoncharitableAssetsAmt"), "min_investment_return": ("MinimumInvestmentReturnGrp", "MinimumInvestmentReturnAmt"),
    "distributable_amount": ("DistributableAmountGrp", "DistributableAsAdjustedAmt"), "qualifying_distributions": ("PFQualifyingDistributionsGrp", "QualifyingDistributionsAmt"),
    "undistributed_income_cy": ("UndistributedIncomeGrp", "UndistributedIncomeCYAmt"), "excess_distribution_carryover": ("UndistributedIncomeGrp", "ExcessDistriCyovToNextYrAmt"),
    "total_grants_paid": ("SupplementaryInformationGrp", "TotalGrantOrContriPdDurYrAmt"), "total_grants_approved_future": ("SupplementaryInformationGrp", "TotalGrantOrContriApprvFutAmt"),
}
#: Groups that older schemas name otherwise.
OLDER_GROUPS = {"PFQualifyingDistributionsGrp": "QualifyingDistriPartXIIGrp"}
#: The same lines on the form of public charities.
CHARITY_LINES = {
    "total_revenue": (None, "CYTotalRevenueAmt"), "total_expenses": (None, "CYTotalExpensesAmt"), "contributions_received": (None, "CYContributionsGrantsAmt"), "contributions_paid": (None, "CYGrantsAndSimilarPaidAmt"),
    "excess_revenue_over_expenses": (None, "CYRevenuesLessExpensesAmt"), "other_salaries": (None, "CYSalariesCompEmpBnftPaidAmt"), "other_expenses": (None, "CYOtherExpensesAmt"), "total_assets_boy": (None, "TotalAssetsBOYAmt"),
    "total_assets_eoy": (None, "TotalAssetsEOYAmt"), "total_liabilities_boy": (None, "TotalLiabilitiesBOYAmt"), "total_liabilities_eoy": (None, "TotalLiabilitiesEOYAmt"), "net_assets_boy": (None, "NetAssetsOrFundBalancesBOYAmt"),
    "net_assets_eoy": (None, "NetAssetsOrFundBalancesEOYAmt"), "program_service_revenue": (None, "CYProgramServiceRevenueAmt"), "investment_income": (None, "CYInvestmentIncomeAmt"), "other_revenue": (None, "CYOtherRevenueAmt"),
    "unrelated_business_revenue": ("TotalRevenueGrp", "UnrelatedBusinessRevenueAmt"), "expenses_program_services": ("TotalFunctionalExpensesGrp", "ProgramServicesAmt"), "expenses_management": ("TotalFunctionalExpensesGrp", "ManagementAndGeneralAmt"),
    "expenses_fundraising": ("TotalFunctionalExpensesGrp", "FundraisingAmt"), "total_employees": (None, "TotalEmployeeCnt"), "total_volunteers": (None, "TotalVolunteersCnt"), "total_reportable_comp": (None, "TotalReportableCompFromOrgAmt"),
}
#: Recipients of one schedule above which it is counted and not listed.
SCHEDULE_ROWS = 50_000


def _struct(tree: dict) -> StructType:
    """``{name: None}`` is a text element, ``{name: {...}}`` a group, ``{name: [{...}]}`` a repeated group."""
    kind = lambda v: StringType() if v is None else ArrayType(_struct(v[0])) if isinstance(v, list) else _struct(v)
    return StructType([StructField(k, kind(v)) for k, v in tree.items()])


def _texts(*names: str) -> dict:
    return dict.fromkeys(names)


_ADDRESS = _texts("AddressLine1Txt", "AddressLine1", "AddressLine2Txt", "CityNm", "StateAbbreviationCd", "ProvinceOrStateNm", "ZIPCd", "ForeignPostalCd", "CountryCd")
_BUSINESS = _texts("BusinessNameLine1Txt", "BusinessNameLine1")
_OFFICER = _texts("PersonNm", "TitleTxt", "AverageHrsPerWkDevotedToPosRt", "CompensationAmt", "EmployeeBenefitProgramAmt", "ExpenseAccountOtherAllwncAmt") | {"BusinessName": _BUSINESS}
_GRANT = _texts("RecipientPersonNm", "RecipientFoundationStatusTxt", "RecipientRelationshipTxt", "GrantOrContributionPurposeTxt", "Amt") | {"RecipientBusinessName": _BUSINESS, "RecipientUSAddress": _ADDRESS, "RecipientForeignAddress": _ADDRESS}
_CONTRIBUTOR = _texts("ContributorNum", "ContributorPersonNm", "TotalContributionsAmt", "PersonContributionInd", "PayrollContributionInd", "NoncashContributionInd") | {"ContributorBusinessName": _BUSINESS, "ContributorUSAddress": _ADDRESS, "ContributorForeignAddress": _ADDRESS}
_APPLICATION = _texts("RecipientPersonNm", "RecipientPhoneNum", "RecipientEmailAddressTxt", "FormAndInfoAndMaterialsTxt", "SubmissionDeadlinesTxt", "RestrictionsOnAwardsTxt") | {"RecipientUSAddress": _ADDRESS}
_SCHEDULE = _texts("RecipientEIN", "EINOfRecipient", "CashGrantAmt", "NonCashAssistanceAmt", "PurposeOfGrantTxt") | {"RecipientBusinessName": _BUSINESS, "USAddress": _ADDRESS}
_PERSON = _texts("PersonNm", "TitleTxt", "AverageHoursPerWeekRt", "ReportableCompFromOrgAmt", "OtherCompensationAmt", "ReportableCompFromRltdOrgAmt") | {"BusinessName": _BUSINESS}


def _lines(table: dict) -> dict:
    tree: dict = {}
    for group, element in table.values():
        for g in (group, OLDER_GROUPS.get(group)):
            if g or group is None:
                (tree.setdefault(g, {}) if g else tree)[element] = None
    return tree


_PF = _lines(FIN_LINES) | _texts("MethodOfAccountingCashInd", "MethodOfAccountingAccrualInd", "MethodOfAccountingOtherDesc", "AmendedReturnInd") | {
    "OfficerDirTrstKeyEmplInfoGrp": {"OfficerDirTrstKeyEmplGrp": [_OFFICER]}, "StatementsRegardingActyGrp": _texts("WebsiteAddressTxt"), "WebsiteAddressTxt": None,
}
_PF["SupplementaryInformationGrp"] = _PF["SupplementaryInformationGrp"] | {"GrantOrContributionPdDurYrGrp": [_GRANT], "GrantOrContriApprvForFutGrp": [_GRANT], "ApplicationSubmissionInfoGrp": _APPLICATION, "OnlyContriToPreselectedInd": None}
_HEADER = _texts("ReturnTs", "TaxPeriodBeginDt", "TaxPeriodEndDt") | {"Filer": _texts("PhoneNum", "InCareOfNm") | {"USAddress": _ADDRESS, "ForeignAddress": _ADDRESS}, "BusinessOfficerGrp": _texts("PersonNm", "PersonTitleTxt", "SignatureDt")}
SCHEMA = _struct({
    "_returnVersion": None, "ReturnHeader": _HEADER,
    "ReturnData": {"IRS990PF": _PF, "IRS990": _lines(CHARITY_LINES) | {"WebsiteAddressTxt": None, "Form990PartVIISectionAGrp": [_PERSON]}, "IRS990ScheduleB": {"ContributorInformationGrp": [_CONTRIBUTOR]}, "IRS990ScheduleI": {"RecipientTable": [_SCHEDULE]}},
})


def archived(spark: SparkSession, path: str, wanted: DataFrame | None = None, suffix: str = ".xml") -> DataFrame:
    """SRC-03: ``member, xml`` of the archives under a path, one archive at a time in a task; only the ``wanted`` members (column ``member``) where given.

    A member that can't be read is a row with a null ``xml``, so it is seen and not lost.
    """

    def run(batches):
        for batch in batches:
            for content in batch.column("content").to_pylist():
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for name in z.namelist():
                        if name.endswith(suffix):
                            try:
                                body = z.read(name).decode("utf-8", "replace")
                            except (zipfile.BadZipFile, NotImplementedError, EOFError):
                                body = None
                            yield pa.record_batch([pa.array([name], pa.string()), pa.array([body], pa.string())], names=["member", "xml"])

    out = spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "member string, xml string")
    return out if wanted is None else out.join(wanted.select("member").distinct(), "member", "left_semi")


def parsed(xml: DataFrame) -> DataFrame:
    """Adds ``r``, the return's wanted elements, to rows of ``object_id, ein, tax_period, xml``."""
    return xml.withColumn("r", F.from_xml("xml", SCHEMA, {"ignoreNamespace": "true", "mode": "PERMISSIVE"})).drop("xml")


def _text(*paths: str) -> Column:
    """The first of the elements that holds more than white space."""
    return F.coalesce(*[F.nullif(F.trim(F.col(p)), F.lit("")) for p in paths])


def _whole(*paths: str) -> Column:
    return F.coalesce(_text(*paths).try_cast("bigint"), _text(*paths).try_cast("double").cast("bigint"))


def _checked(path: str) -> Column:
    return F.coalesce(~F.trim(F.col(path)).isin("", "0", "false"), F.lit(False))


def financials(returns: DataFrame, charity: bool = False) -> DataFrame:
    """SRC-04, SRC-06: A row a return: every line as a whole number, null where the return has no such line."""
    form, table = ("IRS990", CHARITY_LINES) if charity else ("IRS990PF", FIN_LINES)
    at = lambda g, e: f"r.ReturnData.{form}.{g}.{e}" if g else f"r.ReturnData.{form}.{e}"
    paths = lambda g, e: [at(x, e) for x in (g, OLDER_GROUPS.get(g)) if x or g is None][: 2 if g else 1]
    return returns.filter(F.col(f"r.ReturnData.{form}").isNotNull()).select("object_id", *[_whole(*paths(g, e)).alias(c) for c, (g, e) in table.items()])


def header(returns: DataFrame) -> DataFrame:
    h, f, a = "r.ReturnHeader", "r.ReturnHeader.Filer", "r.ReturnHeader.Filer.USAddress"
    x, pf = "r.ReturnHeader.Filer.ForeignAddress", "r.ReturnData.IRS990PF"
    method = F.when(_checked(f"{pf}.MethodOfAccountingCashInd"), "cash").when(_checked(f"{pf}.MethodOfAccountingAccrualInd"), "accrual").when(_text(f"{pf}.MethodOfAccountingOtherDesc").isNotNull(), "other")
    return returns.select(
        "object_id", _text(f"{h}.ReturnTs").alias("return_ts"), _text(f"{h}.TaxPeriodBeginDt").try_cast("date").alias("tax_period_begin"), _text(f"{h}.TaxPeriodEndDt").try_cast("date").alias("tax_period_end"), _text(f"{f}.PhoneNum").alias("phone"),
        _text(f"{f}.InCareOfNm").alias("in_care_of"), _text(f"{a}.AddressLine1Txt", f"{a}.AddressLine1", f"{x}.AddressLine1Txt").alias("addr1"), _text(f"{a}.CityNm", f"{x}.CityNm").alias("city"), _text(f"{a}.StateAbbreviationCd", f"{x}.ProvinceOrStateNm").alias("state"),
        _text(f"{a}.ZIPCd", f"{x}.ForeignPostalCd").alias("zip"), F.coalesce(_text(f"{x}.CountryCd"), F.when(F.col(a).isNotNull(), "US")).alias("country"), _text(f"{h}.BusinessOfficerGrp.PersonNm").alias("sign_name"),
        _text("r._returnVersion").alias("return_version"), _checked(f"{pf}.AmendedReturnInd").alias("amended"), method.alias("acct_method"),
    )


def _rows(returns: DataFrame, path: str) -> DataFrame:
    """A row for each element of a repeated group, with its place from 0."""
    return returns.select("object_id", "ein", "tax_period", F.posexplode(F.col(path)).alias("seq", "g"))


def officers(returns: DataFrame) -> DataFrame:
    """SRC-04: As filed, corporate trustees among them; a row without a name of either kind is none."""
    g = _rows(returns, "r.ReturnData.IRS990PF.OfficerDirTrstKeyEmplInfoGrp.OfficerDirTrstKeyEmplGrp")
    hours = _text("g.AverageHrsPerWkDevotedToPosRt").try_cast("double")
    business = F.when(_text("g.PersonNm").isNull(), _text("g.BusinessName.BusinessNameLine1Txt", "g.BusinessName.BusinessNameLine1"))
    out = g.select("object_id", "ein", "seq", T.title_case(_text("g.PersonNm")).alias("person_name"), business.alias("business_name"), _text("g.TitleTxt").alias("title"), F.when(F.abs(hours) < 1_000_000, hours).cast("decimal(9,2)").alias("hours"), _whole("g.CompensationAmt").alias("compensation"), _whole("g.EmployeeBenefitProgramAmt").alias("benefits"), _whole("g.ExpenseAccountOtherAllwncAmt").alias("expense"))
    return out.filter("person_name is not null or business_name is not null")


def people(officers_: DataFrame) -> DataFrame:
    """One row for each person of a filer, by normalised name; corporate trustees never are people."""
    p = officers_.filter("person_name is not null").withColumn("key", F.concat_ws(":", F.lit("pf"), "ein", T.norm_name(F.col("person_name"))))
    return p.groupBy("key").agg(F.min_by("person_name", F.struct("object_id", "seq")).alias("full_name"), F.min_by("title", F.struct("object_id", "seq")).alias("title"), F.first("ein").alias("ein"))


def grants(returns: DataFrame, future: bool = False) -> DataFrame:
    """SRC-04: Paid grants, or those approved for the future, each with its key and where in the return it stands."""
    group, kind = ("GrantOrContriApprvForFutGrp", "futgrant") if future else ("GrantOrContributionPdDurYrGrp", "grant")
    g = _rows(returns, f"r.ReturnData.IRS990PF.SupplementaryInformationGrp.{group}")
    u, x, n = "g.RecipientUSAddress", "g.RecipientForeignAddress", F.col("seq").cast("string")
    out = g.select(
        "object_id", "ein", F.concat(F.lit("irs990pf:"), "object_id", F.lit(f":{kind}:"), n).alias("record_key"), F.concat(F.lit(f"xpath:/Return/ReturnData/IRS990PF/SupplementaryInformationGrp/{group}["), (F.col("seq") + 1).cast("string"), F.lit("]")).alias("locator"),
        _text("g.RecipientBusinessName.BusinessNameLine1Txt", "g.RecipientBusinessName.BusinessNameLine1", "g.RecipientPersonNm").alias("recipient"), _text(f"{u}.CityNm", f"{x}.CityNm").alias("city"), _text(f"{u}.StateAbbreviationCd", f"{x}.ProvinceOrStateNm").alias("state"),
        _text("g.GrantOrContributionPurposeTxt").alias("purpose"), _whole("g.Amt").alias("amount"), F.left("tax_period", F.lit(4)).try_cast("int").alias("fy"), _text(f"{u}.ZIPCd", f"{x}.ForeignPostalCd").alias("zip"), _text(f"{x}.CountryCd").alias("country"),
        _text("g.RecipientFoundationStatusTxt").alias("foundation_status"), _text("g.RecipientRelationshipTxt").alias("relationship"),
    )
    return out.filter("recipient is not null")


def contributors(returns: DataFrame) -> DataFrame:
    g = _rows(returns, "r.ReturnData.IRS990ScheduleB.ContributorInformationGrp")
    u = "g.ContributorUSAddress"
    return g.select("object_id", "seq", _whole("g.ContributorNum").alias("num"), _text("g.ContributorPersonNm").alias("person"), _text("g.ContributorBusinessName.BusinessNameLine1Txt").alias("business"), _text(f"{u}.CityNm").alias("city"), _text(f"{u}.StateAbbreviationCd").alias("state"), _whole("g.TotalContributionsAmt").alias("amount"), _checked("g.PersonContributionInd").alias("is_person"), _checked("g.PayrollContributionInd").alias("is_payroll"), _checked("g.NoncashContributionInd").alias("is_noncash")).filter("person is not null or business is not null")


def application(returns: DataFrame) -> DataFrame:
    """SRC-04: How to apply, of returns that say anything about it."""
    s = "r.ReturnData.IRS990PF.SupplementaryInformationGrp"
    a = f"{s}.ApplicationSubmissionInfoGrp"
    only = _checked(f"{s}.OnlyContriToPreselectedInd")
    out = returns.filter(F.col(a).isNotNull() | only)
    return out.select("object_id", _text(f"{a}.RecipientPersonNm").alias("contact"), _text(f"{a}.RecipientUSAddress.CityNm").alias("city"), _text(f"{a}.RecipientPhoneNum").alias("phone"), _text(f"{a}.RecipientEmailAddressTxt").alias("email"), _text(f"{a}.FormAndInfoAndMaterialsTxt").alias("form_txt"), _text(f"{a}.SubmissionDeadlinesTxt").alias("deadlines_txt"), _text(f"{a}.RestrictionsOnAwardsTxt").alias("restrictions_txt"), only.alias("only_preselected"))


def schedule_grants(returns: DataFrame, most: int = SCHEDULE_ROWS) -> DataFrame:
    """SRC-05: Recipients of a public charity's schedule: cash and other gifts added, null where neither is stated or both are zero; a longer schedule is left to its reported total."""
    table = "r.ReturnData.IRS990ScheduleI.RecipientTable"
    g = _rows(returns.filter(F.coalesce(F.size(table), F.lit(0)) <= most), table)
    cash, other = T.amount(_text("g.CashGrantAmt")), T.amount(_text("g.NonCashAssistanceAmt"))
    stated = (F.coalesce(cash, F.lit(0)) != 0) | (F.coalesce(other, F.lit(0)) != 0)
    amount = F.when(stated, F.coalesce(cash, F.lit(0)) + F.coalesce(other, F.lit(0)))
    out = g.select("object_id", "ein", F.concat(F.lit("irs990:"), "object_id", F.lit(":schedi:"), F.col("seq").cast("string")).alias("record_key"), F.left(_text("g.RecipientBusinessName.BusinessNameLine1Txt", "g.RecipientBusinessName.BusinessNameLine1"), F.lit(500)).alias("recipient"), T.ein(_text("g.RecipientEIN", "g.EINOfRecipient")).alias("recipient_ein"), _text("g.USAddress.CityNm").alias("city"), _text("g.USAddress.StateAbbreviationCd").alias("state"), _text("g.PurposeOfGrantTxt").alias("purpose"), amount.alias("amount"), F.left("tax_period", F.lit(4)).try_cast("int").alias("fy"))
    return out.filter("recipient is not null")


def charity_people(returns: DataFrame) -> DataFrame:
    """SRC-06: Section A of the charities' form, in the columns of :func:`officers`."""
    g = _rows(returns, "r.ReturnData.IRS990.Form990PartVIISectionAGrp")
    return g.select("object_id", "ein", "seq", T.title_case(_text("g.PersonNm")).alias("person_name"), F.when(_text("g.PersonNm").isNull(), _text("g.BusinessName.BusinessNameLine1Txt")).alias("business_name"), _text("g.TitleTxt").alias("title"), _text("g.AverageHoursPerWeekRt").try_cast("decimal(9,2)").alias("hours"), _whole("g.ReportableCompFromOrgAmt").alias("compensation"), _whole("g.OtherCompensationAmt").alias("benefits"), F.lit(None).cast("bigint").alias("expense")).filter("person_name is not null or business_name is not null")


def websites(returns: DataFrame) -> DataFrame:
    """SRC-07: The first website element of either form that holds one, as a URL."""
    raw = _text("r.ReturnData.IRS990.WebsiteAddressTxt", "r.ReturnData.IRS990PF.StatementsRegardingActyGrp.WebsiteAddressTxt", "r.ReturnData.IRS990PF.WebsiteAddressTxt")
    return returns.select("object_id", raw.alias("raw"), T.website(raw).alias("website"))
