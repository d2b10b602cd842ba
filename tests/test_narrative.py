"""The narrative grammar, its quirks included, and the reports on it."""

import pytest
from pyspark.sql import functions as F

from lynceus.functions import narrative as N
from lynceus.operators import facts as FX
from lynceus.operators import reports as R

RECORDS = [
    ("gone", "CORP", "lead [UK SANCTIONS - UKHMT] Jan 2001 - added to list. Mar 2010 - delisted. Name 6: SMITH JOHN. Group ID: 7419. Last Updated: x "
                     "[BIOGRAPHY] Feb 1999 - listed [note] x [USA SANCTIONS - OFAC] Nov 2001 - designated. Feb 2012 - removed. PRIMARY NAME: Orbit Trading Group DOB 1950 (a.k.a. Malko Petrov Ivan; f.k.a. Zed Group Limited). SDN Ref No 4712. "
                     "[EU SANCTIONS] May 2002 - listed. Jun 2013 – repealed. 2001/931/CFSP 'Rev Org 17 Nov'"),
    ("owned", None, "[DIRECT SHAREHOLDER/S] Alpha Corp (SOE) (50%), and Beta Ltd (IOS) (51,7%). Gamma (unknown percentage)"),
    ("live", "X", "[UK SANCTIONS - UKHMT] Jan 2001 - listed. [EU SANCTIONS] Jan 2001 - listed. Jan 2005 - lifted"),
    ("licence", "X", "[CANADA] Jan 2020 - general license issued"),
    ("odd", "X", "[EU SANCTIONS] Jan 2020 - pondered. Feb 2020 - marked as such"),
    ("ids", "X", "[IMO REGISTRATION] IMO 1234567 [FOO BAR] zz [OPERATIONAL] ok [STATE OWNED] Delta Holding"),
    ("null", "X", None), ("blank", " ", "  \n"), ("open", "X", "text [EU SANCTIONS Jan 2020 - listed"),
]


@pytest.fixture(scope="module")
def records(spark):
    return spark.createDataFrame(RECORDS, "uid string, category string, narrative string").cache()


def test_statuses(records):
    rows = {r.uid: r for r in FX.statuses(records).collect()}
    want = {"gone": "REMOVED_EVERYWHERE", "owned": "NOT_SANCTIONED", "live": "LIVE", "licence": "LIVE", "odd": "INDETERMINATE",
            "ids": "NOT_SANCTIONED", "null": "NOT_SANCTIONED", "blank": "NOT_SANCTIONED", "open": "NOT_SANCTIONED"}
    assert {u: r.status for u, r in rows.items()} == want
    assert rows["owned"].category == rows["blank"].category == "(no-category)"
    assert rows["gone"].list_sources == ["UK:UKHMT", "USA:OFAC", "EU"] and rows["licence"].list_sources == []
    assert rows["gone"].sections_seen == 4 and rows["gone"].sections_parsed == 3
    assert [(x.list_source, x.last_add, x.last_removal) for x in rows["gone"].per_source] == [("EU", 2002, 2013), ("UK:UKHMT", 2001, 2010), ("USA:OFAC", 2001, 2012)]


def test_events_have_their_place(records):
    rows = FX.events(records).collect()
    text = {u: n for u, _, n in RECORDS}
    assert len(rows) == 11  # a verb that begins like a month's name is dropped
    for r in rows:
        rule, _, place = r.provenance.rpartition("@")
        a, b = map(int, place.split(":"))
        assert r.raw_verb in text[r.uid][a:b].lower() and str(r.year) in text[r.uid][a:b] and r.action_type in rule


def test_ownership(records):
    rows = {r.owner: r for r in FX.ownership(records).collect()}
    assert set(rows) == {"Alpha Corp", "Beta Ltd", "Gamma", "Delta Holding"}
    assert (rows["Beta Ltd"].percent, rows["Beta Ltd"].owner_type, rows["Beta Ltd"].percent_stated) == (51.7, "IOS", True)
    assert rows["Gamma"].percent is None and not rows["Gamma"].percent_stated
    totals = R.ownership_totals(FX.ownership(records)).first()
    assert (totals.stakes, totals.with_percent, totals.without_percent) == (4, 2, 2)


def test_identifiers_and_names(records):
    ids = {(r.uid, r.type, r.value) for r in FX.identifiers(records).collect()}
    assert {("gone", "SDN_REF", "4712"), ("gone", "REF_NO", "4712"), ("gone", "GROUP_ID", "7419"), ("gone", "EU_LEGAL_BASIS", "2001/931/CFSP"), ("ids", "IMO", "1234567"), ("ids", "ASSET_STATUS", "OPERATIONAL")} <= ids
    names = {r.value for r in FX.names(records).collect()}
    assert {"SMITH JOHN", "Orbit Trading Group", "Malko Petrov Ivan", "Zed Group Limited", "Rev Org 17 Nov"} <= names
    assert not any("DOB" in n or "SDN" in n for n in names)


def test_quarantine(records):
    rows = {(r.uid, r.reason) for r in FX.quarantine(records).collect()}
    assert rows == {("odd", "UNCLASSIFIED_ACTION_VERB"), ("ids", "UNCLASSIFIED_SECTION")}


@pytest.mark.parametrize(
    "header,kind",
    [("UK SANCTIONS - UKHMT", "SANCTIONS"), ("USA", "SANCTIONS"), ("SECURITY COUNCIL SANCTIONS", "REGULATORY_WARNING"), ("DIRECT SHAREHOLDER/S", "OWNERSHIP"), ("ENTITY LIST", "LAW_ENFORCEMENT"),
     ("SWIFT BIC CODE", "IDENTIFIER"), ("BROKEN UP", "ASSET_STATUS"), ("BIOGRAPHY", "PROSE"), ("SOMETHING ELSE", "UNKNOWN"), (None, "UNKNOWN")],
)
def test_classify(spark, header, kind):
    assert spark.range(1).select(N.classify(F.lit(header).cast("string"))).first()[0] == kind


@pytest.mark.parametrize("text,ok", [("UN", True), ("A", False), ("Uk", False), ("ÉTAT 2", True), ("12", False), ("AB " * 30, False), ("一二", False)])
def test_is_header(spark, text, ok):
    assert spark.range(1).select(N.is_header(F.lit(text))).first()[0] is ok


@pytest.mark.parametrize("header,source", [("USA SANCTIONS - OFAC", "USA:OFAC"), ("EU SANCTIONS", "EU"), ("Canada Embargo", "CANADA"), (" SANCTIONS - X", "SANCTIONS:X"), ("A - B - C", "A:B - C")])
def test_canonical_source(spark, header, source):
    assert spark.range(1).select(N.canonical_source(F.lit(header))).first()[0] == source


@pytest.mark.parametrize("name,ok", [("Malko Ivan", True), ("Deputy Minister of Culture", False), ("Ali", False), ("A com", False), ("s Republic and", False), ("Member 2001", False), ("S.A., Cali, Colombia", False), ("Malek Haddad", False), ("Omar Haddad", True)])
def test_plausible(spark, name, ok):
    assert spark.range(1).select(N.plausible(F.lit(name))).first()[0] is ok


def test_reports(records):
    coverage = {r.parser_id: r.sections_handled for r in R.parser_coverage(records).collect()}
    assert coverage == {"OFSI": 2, "OFAC": 1, "EU": 3, "GENERIC": 1}
    assert R.parser_coverage(records.limit(0)).filter("share_pct <> 0").count() == 0
    x = next(r for r in R.status_by_category(FX.statuses(records)).collect() if r.category == "X")
    assert (x.live, x.indeterminate, x.removed_pct_of_sanctioned) == (2, 1, 0.0)


def test_order_of_partitions_does_not_matter(records):
    once = {tuple(r) for r in FX.events(records).collect()}
    assert {tuple(r) for r in FX.events(records.repartition(7)).collect()} == once


def test_only_what_is_used_of_a_section_is_made(spark):
    """Counts by action need no parser and no canonical source, which once were made for every section (F37, F38)."""
    rows = spark.createDataFrame([("1", "x", "[EU SANCTIONS] May 2020 - delisted. Jun 2021 - noted. [UK SANCTIONS - OFSI] Jul 2022 - added.")], "uid string, category string, narrative string")
    for table in (R.unclassified_verbs(FX.events(rows)), R.counts(FX.events(rows), "action_type")):
        assert "GUERNSEY" not in table._jdf.queryExecution().optimizedPlan().toString()
    assert [(r["raw_verb"], r["provenance"]) for r in FX.events(rows).collect()][1] == ("noted", "EU.ACTION.UNCLASSIFIED@36:52")
    assert [r["provenance"] for r in FX.quarantine(rows).collect()] == ["EU.ACTION.UNCLASSIFIED@36:52"]
