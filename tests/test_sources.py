"""Returns, lists and tables of invented values."""

import zipfile

import pytest
from pyspark.sql import functions as F

from tallyfold.operators import understand as U
from tallyfold.sources import lists, returns

NS = 'xmlns="http://www.irs.gov/efile" returnVersion="2023v4.0"'
PF = f"""<?xml version="1.0"?><Return {NS}><ReturnHeader><ReturnTs>2024-05-01T10:00:00-05:00</ReturnTs><TaxPeriodBeginDt>2023-01-01</TaxPeriodBeginDt><TaxPeriodEndDt>2023-12-31</TaxPeriodEndDt>
<Filer><PhoneNum>2125550100</PhoneNum><InCareOfNm>% A BANK</InCareOfNm><USAddress><AddressLine1Txt>1 Main St</AddressLine1Txt><CityNm>Oslo</CityNm><StateAbbreviationCd>MN</StateAbbreviationCd><ZIPCd>55001</ZIPCd></USAddress></Filer>
<BusinessOfficerGrp><PersonNm>Ann Lee</PersonNm></BusinessOfficerGrp></ReturnHeader><ReturnData><IRS990PF><AmendedReturnInd>X</AmendedReturnInd><MethodOfAccountingCashInd>X</MethodOfAccountingCashInd><FMVAssetsEOYAmt>900</FMVAssetsEOYAmt>
<AnalysisOfRevenueAndExpenses><InterestOnSavRevAndExpnssAmt>12</InterestOnSavRevAndExpnssAmt><InterestRevAndExpnssAmt>7</InterestRevAndExpnssAmt><NetGainSaleAstRevAndExpnssAmt>-45</NetGainSaleAstRevAndExpnssAmt><DividendsRevAndExpnssAmt>0</DividendsRevAndExpnssAmt></AnalysisOfRevenueAndExpenses>
<QualifyingDistriPartXIIGrp><QualifyingDistributionsAmt>321</QualifyingDistributionsAmt></QualifyingDistriPartXIIGrp><UndistributedIncomeGrp><QualifyingDistributionsAmt>999</QualifyingDistributionsAmt></UndistributedIncomeGrp>
<StatementsRegardingActyGrp><WebsiteAddressTxt>WWW.EXAMPLE.ORG/</WebsiteAddressTxt></StatementsRegardingActyGrp>
<OfficerDirTrstKeyEmplInfoGrp><OfficerDirTrstKeyEmplGrp><PersonNm>ANN O'NEIL</PersonNm><TitleTxt>PRESIDENT</TitleTxt><AverageHrsPerWkDevotedToPosRt>1.50</AverageHrsPerWkDevotedToPosRt><CompensationAmt>0</CompensationAmt></OfficerDirTrstKeyEmplGrp>
<OfficerDirTrstKeyEmplGrp><BusinessName><BusinessNameLine1Txt>A BANK</BusinessNameLine1Txt></BusinessName><TitleTxt>TRUSTEE</TitleTxt></OfficerDirTrstKeyEmplGrp><OfficerDirTrstKeyEmplGrp><PersonNm>ANN O'NEIL</PersonNm><AverageHrsPerWkDevotedToPosRt>99999999</AverageHrsPerWkDevotedToPosRt></OfficerDirTrstKeyEmplGrp></OfficerDirTrstKeyEmplInfoGrp>
<SupplementaryInformationGrp><OnlyContriToPreselectedInd>X</OnlyContriToPreselectedInd><GrantOrContributionPdDurYrGrp><RecipientBusinessName><BusinessNameLine1Txt>A SCHOOL</BusinessNameLine1Txt></RecipientBusinessName><RecipientUSAddress><CityNm>Oslo</CityNm><StateAbbreviationCd>MN</StateAbbreviationCd></RecipientUSAddress><RecipientFoundationStatusTxt>PC</RecipientFoundationStatusTxt><GrantOrContributionPurposeTxt>BOOKS</GrantOrContributionPurposeTxt><Amt>500</Amt></GrantOrContributionPdDurYrGrp>
<GrantOrContributionPdDurYrGrp><Amt>1</Amt></GrantOrContributionPdDurYrGrp><GrantOrContributionPdDurYrGrp><RecipientPersonNm>B KIM</RecipientPersonNm><RecipientForeignAddress><CityNm>Bonn</CityNm><CountryCd>GM</CountryCd></RecipientForeignAddress></GrantOrContributionPdDurYrGrp>
<GrantOrContriApprvForFutGrp><RecipientBusinessName><BusinessNameLine1>A CLINIC</BusinessNameLine1></RecipientBusinessName><Amt>70</Amt></GrantOrContriApprvForFutGrp><TotalGrantOrContriPdDurYrAmt>501</TotalGrantOrContriPdDurYrAmt></SupplementaryInformationGrp></IRS990PF>
<IRS990ScheduleB><ContributorInformationGrp><ContributorNum>1</ContributorNum><ContributorPersonNm>C DOE</ContributorPersonNm><TotalContributionsAmt>5000</TotalContributionsAmt><PersonContributionInd>X</PersonContributionInd></ContributorInformationGrp></IRS990ScheduleB></ReturnData></Return>"""
CHARITY = f"""<Return {NS}><ReturnData><IRS990><CYTotalRevenueAmt>88</CYTotalRevenueAmt><TotalFunctionalExpensesGrp><FundraisingAmt>3</FundraisingAmt></TotalFunctionalExpensesGrp><WebsiteAddressTxt>N/A</WebsiteAddressTxt><Form990PartVIISectionAGrp><PersonNm>D PAK</PersonNm><ReportableCompFromOrgAmt>9</ReportableCompFromOrgAmt></Form990PartVIISectionAGrp></IRS990>
<IRS990ScheduleI><RecipientTable><RecipientBusinessName><BusinessNameLine1Txt>ONE</BusinessNameLine1Txt></RecipientBusinessName><RecipientEIN>12345678</RecipientEIN><CashGrantAmt>10</CashGrantAmt><NonCashAssistanceAmt>5</NonCashAssistanceAmt></RecipientTable>
<RecipientTable><RecipientBusinessName><BusinessNameLine1>TWO</BusinessNameLine1></RecipientBusinessName><EINOfRecipient>987654321</EINOfRecipient><CashGrantAmt>0</CashGrantAmt></RecipientTable></IRS990ScheduleI></ReturnData></Return>"""


@pytest.fixture(scope="module")
def parsed(spark):
    xml = [("20231", "012345678", "202312", PF), ("20232", "111111111", "202306", CHARITY), ("20233", "222222222", "", f"<Return {NS}><ReturnData></ReturnData></Return>")]
    return returns.parsed(spark.createDataFrame(xml, "object_id string, ein string, tax_period string, xml string")).cache()


def test_financials(parsed):
    (r,) = returns.financials(parsed).collect()
    assert (r.interest_income, r.interest_expense, r.net_gain_sale_assets, r.dividends, r.gross_rents, r.fmv_assets_eoy) == (12, 7, -45, 0, None, 900)
    assert r.qualifying_distributions == 321 and r.total_grants_paid == 501 and len(r) == 52
    (c,) = returns.financials(parsed, charity=True).collect()
    assert (c.object_id, c.total_revenue, c.expenses_fundraising, c.total_expenses) == ("20232", 88, 3, None)


def test_header_and_people(parsed):
    h = {r.object_id: r for r in returns.header(parsed).collect()}["20231"]
    assert (h.phone, h.city, h.state, h.country, h.amended, h.acct_method, h.return_version, str(h.tax_period_end)) == ("2125550100", "Oslo", "MN", "US", True, "cash", "2023v4.0", "2023-12-31")
    o = returns.officers(parsed).orderBy("seq").collect()
    assert [(r.seq, r.person_name, r.business_name) for r in o] == [(0, "Ann O'Neil", None), (1, None, "A BANK"), (2, "Ann O'Neil", None)]
    assert o[0].compensation == 0 and float(o[0].hours) == 1.5 and o[2].hours is None and o[1].compensation is None
    assert [r.full_name for r in returns.people(returns.officers(parsed)).collect()] == ["Ann O'Neil"]
    assert [(r.person_name, r.compensation) for r in returns.charity_people(parsed).collect()] == [("D Pak", 9)]


def test_grants(parsed):
    g = returns.grants(parsed).orderBy("record_key").collect()
    assert [(r.record_key, r.recipient, r.amount, r.fy, r.country) for r in g] == [("irs990pf:20231:grant:0", "A SCHOOL", 500, 2023, None), ("irs990pf:20231:grant:2", "B KIM", None, 2023, "GM")]
    assert g[1].locator.endswith("GrantOrContributionPdDurYrGrp[3]")
    assert [(r.recipient, r.amount) for r in returns.grants(parsed, future=True).collect()] == [("A CLINIC", 70)]
    assert [(r.person, r.amount, r.is_person, r.is_noncash) for r in returns.contributors(parsed).collect()] == [("C DOE", 5000, True, False)]
    (a,) = returns.application(parsed).collect()
    assert a.only_preselected and a.contact is None
    s = returns.schedule_grants(parsed).orderBy("record_key").collect()
    assert [(r.recipient, r.recipient_ein, r.amount) for r in s] == [("ONE", "012345678", 15), ("TWO", "987654321", None)]
    assert returns.schedule_grants(parsed, most=1).collect() == []
    assert {r.object_id: r.website for r in returns.websites(parsed).collect()} == {"20231": "https://www.example.org", "20232": None, "20233": None}


def test_archives(spark, tmp_path):
    for k in range(2):
        with zipfile.ZipFile(tmp_path / f"{k}.zip", "w") as z:
            z.writestr(f"{k}_public.xml", PF)
            z.writestr("note.txt", "x")
    got = returns.archived(spark, str(tmp_path / "*.zip"))
    assert sorted(r.member for r in got.collect()) == ["0_public.xml", "1_public.xml"]
    some = returns.archived(spark, str(tmp_path / "*.zip"), spark.createDataFrame([("1_public.xml",)], "member string"))
    assert [r.member for r in some.collect()] == ["1_public.xml"]


def write(path, text):
    path.write_text(text)
    return str(path)


def test_registry_and_index(spark, tmp_path):
    p = write(tmp_path / "r.csv", "EIN,NAME,STATE,FOUNDATION,NTEE_CODE,RULING,ASSET_AMT\n12345,\"A, Fund\",Texas,4,T20,198500,\"$1,200.90\"\n777777777,B Org,TX,15,,1990,-\n,No Number,TX,04,,,\n")
    (r,) = lists.registry(spark, p).collect()
    assert (r.ein, r.name_normalized, r.state, r.ntee, str(r.ruling_date), r.assets, r.city) == ("000012345", "A FUND", "TX", "T20", "1985-01-01", 1200, None)
    assert sorted(x.org_type for x in lists.registry(spark, p, every=True).collect()) == ["private_foundation", "public_charity"]
    with pytest.raises(lists.LayoutError):
        lists.registry(spark, write(tmp_path / "bad.csv", "A,B\n1,2\n"))
    i = write(tmp_path / "i.csv", "RETURN_ID,OBJECT_ID,EIN,RETURN_TYPE,TAX_PERIOD,SUB_DATE\n1,20231,12345,990PF,202312,2024-01-01\n2,20231,12345,990PF,202312,2024-02-01\n3,20232,1,990EZ,202312,2024\n4,20233,55,990,202306,2024\n")
    assert sorted((r.object_id, r.ein, r.sub_date) for r in lists.index(spark, i).collect()) == [("20231", "000012345", "2024-02-01"), ("20233", "000000055", "2024")]


def test_pipe_lists(spark, tmp_path):
    line = lambda e, d, p="", x="": f"{e}|Name||St|City|TX|1|US|03|{d}|{p}|{x}"
    body = "\n".join([line("000000001", "15-MAY-2010", "12-AUG-2010"), line("000000002", "15-MAY-2010", "", "01-JAN-2009"), line("000000003", "15-may-2011"), "", "Total rows", line("000000001", "15-MAY-2010"), line("4", "15-MAY-2010"), line("000000005", "never"), "000000006|short", line("000000001", "15-MAY-2012")])
    rows, out = lists.revocations(spark, write(tmp_path / "rev.txt", body))
    assert sorted((r.ein, str(r.revocation_date)) for r in rows.collect()) == [("000000001", "2010-05-15"), ("000000001", "2012-05-15"), ("000000002", "2010-05-15"), ("000000003", "2011-05-15")]
    assert {r.reason: r.n for r in out.collect()} == {"blank": 1, "not_data": 1, "duplicate": 1, "bad_ein": 1, "no_revocation_date": 1, "bad_fields": 1, "reinstated_before_revoked": 1}
    for bad in ("", "abc\n", "000000001|a|b\n", line("000000001", "2010-05-15")):
        with pytest.raises(lists.LayoutError):
            lists.revocations(spark, write(tmp_path / f"bad{len(bad)}.txt", bad))
    rows, out = lists.deductible(spark, write(tmp_path / "p.txt", "000000001|A|C|TX|US|PC, souNK\n000000002|B|C|TX|US|PF\n000000003|D|C|TX|US|PF\n000000002|B|C|TX|US|PF\n000000004|E|C|TX|US|,\n"))
    assert {r.ein: r.codes for r in rows.collect()}["000000001"] == ["PC", "SOUNK"]
    assert {r.reason: r.n for r in out.collect()} == {"duplicate": 1, "no_codes": 1}


def test_awards_offerings_firms(spark, tmp_path):
    a = write(tmp_path / "a.csv", "Company Name,agency,Award Title,Contract,Award Year,Amount\nX,NSF,T,C1,2020,\"$5,000.99\"\nX,NSF,T,C1,2020,\"$5,000.99\"\nY,NSF,T,C1,2020,\n")
    got = lists.awards(spark, a).collect()
    assert sorted((r.company, r.amount) for r in got) == [("X", 5000), ("Y", None)] and len({r.record_key for r in got}) == 2
    write(tmp_path / "FORMDSUBMISSION.tsv", "ACCESSIONNUMBER\tFILING_DATE\tPREVIOUSACCESSIONNUMBER\na1\t05-JAN-2024\t\na2\t2024-02-01\ta1\n")
    write(tmp_path / "ISSUERS.tsv", "ACCESSIONNUMBER\tIS_PRIMARYISSUER_FLAG\tCIK\tENTITYNAME\tSTATEORCOUNTRY\na1\tYES\t0007\tF\tTX\na2\tYES\t0007\tF\tTX\na2\tNO\t9\tG\tTX\n")
    write(tmp_path / "OFFERING.tsv", "ACCESSIONNUMBER\tTOTALAMOUNTSOLD\na2\t100\n")
    assert [(r.accession, r.cik, str(r.day), r.sold) for r in lists.offerings(spark, str(tmp_path)).collect()] == [("a2", "7", "2024-02-01", 100)]
    x = write(tmp_path / "f.xml", '<R><Firm><Info FirmCrdNb="5" BusNm="B"/><MainAddr State="TX"/></Firm><Firm><Info FirmCrdNb="5" BusNm="A"/></Firm><Firm><Info BusNm="C"/></Firm></R>')
    assert [(r.crd, r.name) for r in lists.firms(spark, x).collect()] == [("5", "A")]
    base = spark.createDataFrame([("5", 1, "2023-01-01"), ("5", 2, "2024-01-01"), ("6", 3, "2022-01-01")], "crd string, filing_id int, filed_on string")
    detail = spark.createDataFrame([(1, "old"), (2, "new"), (3, "own")], "filing_id int, fund string")
    assert sorted(r.fund for r in lists.latest_filing_rows(base, detail).collect()) == ["new", "own"]


def test_imports_seeds_shards(spark, tmp_path):
    assert lists.guess_columns(["Tax ID", "Foundation", "Comments"]) == {"ein": "Tax ID", "name": "Foundation", "notes": "Comments"}
    df = spark.createDataFrame([("12", "The A, Inc."), ("0", ""), ("", "B")], ["EIN", "Organization"])
    assert sorted(map(tuple, lists.imported(df).select("ein", "name", "key").collect()), key=str) == [("000000012", "The A, Inc.", "a"), (None, "B", "b")]
    s = lists.seeds(spark, write(tmp_path / "s.csv", "slug,focus_areas\na,x; y;\nb,\n"), ("focus_areas",)).orderBy("slug").collect()
    assert s[0].focus_areas == ["x", "y"]
    assert lists.keyset_shards(0, 10, 3) == [(0, 3), (3, 6), (6, 10)] and lists.keyset_shards(0, 2, 5) == [(0, 1), (1, 2)]
    fetch = lambda after, to, page: [(i, f"r{i}") for i in range(after + 1, min(to, after + 1 + page))]
    got = lists.read_shards(spark, fetch, 0, 57, 4, "id long, name string", page=5)
    assert sorted(r.id for r in got.collect()) == list(range(57))


def test_understanding():
    cities = {"toledo": "OH", "kansas city": "MO"}
    u = lambda q: U.understand(q, cities)
    assert (u("youth programs in Ohio").state, u("youth programs in Ohio").topic) == ("OH", "youth programs")
    assert u("arts in West Virginia").state == "WV" and u("food in Toledo, OH").city == "Toledo" and u("parks in Kansas City").state == "MO"
    assert u("youth mental health in OR").state == "OR" and u("me or them").state is None and u("Washington DC arts").state is None
    assert u("Oregon Community Foundation").navigational and not u("grants for a foundation").navigational and not u("research institute foundation in Virginia").navigational
    assert u(None).topic == "" and not u("").navigational
    assert U.content_words("Funding for our after-school music programs") == ["after-school", "music"]
    assert U.phrase_query("food bank") == '"food bank"' and U.phrase_query("food -bank") == "food -bank" and U.phrase_query("food") == "food"
    assert U.name_variants("Children's") == ["Children's", "Childrens"] and U.name_tokens("THE ANNIE CASEY FOUNDATION") == ["ANNIE", "CASEY"]
    assert U.choose_mode("12-3456789", u("12-3456789"))[0] == "ein" and U.choose_mode("", u(""))[0] == "browse" and U.choose_mode("Moore Foundation", u("Moore Foundation"))[0] == "name"
    assert U.choose_mode("arts in Ohio", u("arts in Ohio")) == ("topic", ["place_from_words"])
    assert U.next_mode("name", 0) == "topic" and U.next_mode("topic", 0, True) == "keyword" and U.next_mode("topic", 0) is None
    assert U.resolve_context({"state": "TX"}, u("arts in Ohio"), {"state": "NY", "budget": 5}) == {"state": "TX", "state_from": "url", "budget": 5, "budget_from": "profile"}
    assert U.resolve_context({}, u("arts in Ohio"), {})["state_from"] == "query"
    assert U.filter_to_params({"q": "x", "page": 3, "state": "TX"}, {"state": None, "sort": "assets", "odd": 1}) == {"q": "x", "sort": "assets"}


def test_guarded_prune(spark):
    from tallyfold.operators.search import guard_prune, refresh_steps

    now, was = spark.createDataFrame([(1, "a"), (2, "b")], "k int, hash string"), spark.createDataFrame([(2, "x"), (3, "c")], "k int, h string")
    steps = refresh_steps(now, was, "k")
    assert {r.k: r.step for r in steps.collect()} == {1: "insert", 2: "update", 3: "prune"}
    assert guard_prune(steps).count() == 3
    with pytest.raises(ValueError):
        guard_prune(steps, 0.0, 0)
    assert steps.filter(F.col("step") == "keep").count() == 0
