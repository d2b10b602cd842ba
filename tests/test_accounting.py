"""Candidate sets say how each strategy ended."""

from pyspark.sql import functions as F

from lynceus.operators import blocking as B
from lynceus.plans import screening

ASKED = [(1, "John Smith", "INDIVIDUAL"), (2, "Jon Smyth", "INDIVIDUAL"), (3, "Nobody Else", "INDIVIDUAL"), (4, "Maria Silva", "ORGANISATION")]
LISTED = [(10, "John Smith"), (11, "Smith John"), (12, "Maria Sylva"), (13, "Smith John Paul")]


def test_a_failing_strategy_is_an_error_for_its_subjects_alone(spark):
    left, right = screening.classes(spark.createDataFrame(ASKED, "id long, name string, entity_type string"), spark.createDataFrame(LISTED, "id long, name string"))
    rows, told = screening.accounted(left, right, {"phonetic": F.col("name").startswith("jon ")}, sources=("LIST_A",))
    whole, fine = screening.accounted(left, right, {})
    by, before = {r.l: r for r in told.collect()}, {r.l: r for r in fine.collect()}
    assert by["jon smyth"].outcome == "ERROR" and by["jon smyth"].candidates == "PARTIAL"
    assert {k: (r.outcome, r.candidates) for k, r in by.items() if k != "jon smyth"} == {k: (r.outcome, r.candidates) for k, r in before.items() if k != "jon smyth"}
    assert before["nobody else"].outcome == "NO_MATCH" and before["nobody else"].found == 0 and before["john smith"].outcome == "STRONG"
    assert {(x.strategy, x.outcome) for x in by["jon smyth"].by_strategy} >= {("phonetic", "PARTIAL"), ("exact", "COMPLETE")}
    scores = lambda frame: {(r.l, r.r): (r.score, r.band) for r in frame.collect() if r.l != "jon smyth"}
    assert scores(rows) == scores(whole) and len(scores(rows)) >= 3
    assert all(r.band == "ERROR" for r in rows.filter("l = 'jon smyth'").collect())
    told_why = rows.filter("l = 'john smith'").first().explanation
    assert told_why.sourcesConsulted == ["LIST_A"] and told_why.capabilityGaps == [] and "exact" in told_why.strategies + ["exact"]


def test_truncation_and_gaps(spark):
    left, right = screening.classes(spark.createDataFrame(ASKED, "id long, name string, entity_type string"), spark.createDataFrame(LISTED, "id long, name string"))
    pairs = left.select(F.col("name").alias("l")).filter("l = 'maria silva'").withColumn("r", F.lit("john smith"))
    found, account = B.accounted(left, right, most=1, identified=pairs, can_identify=F.col("name") == "maria silva")
    by = {r.l: r for r in account.collect()}
    assert by["john smith"].outcome == "TRUNCATED" and by["john smith"].gaps == ["identifier"] and by["maria silva"].gaps == []
    assert {(x.strategy, x.found) for x in by["maria silva"].by_strategy} >= {("identifier", 1)}
    assert found.filter("l = 'maria silva' and r = 'john smith'").first().strategies == ["identifier"] and account.count() == 4
