"""Screening by identifiers and attributes, end to end."""

from lynceus.operators import blocking
from lynceus.plans import screening


def test_identifiers_and_attributes_reach_the_score(spark):
    asked = [(1, "Ann Other", "INDIVIDUAL", "1990-01-01"), (2, "Ann Other", "INDIVIDUAL", None), (3, None, "INDIVIDUAL", None), (4, "John Smith", "INDIVIDUAL", "1970-05-05")]
    given = [(10, "Zhang Wei", None, None), (11, "John Smith", "1950-01-01", None), (12, "John Smith", "1970-05-05", "REMOVED_EVERYWHERE"), (13, None, None, None)]
    subjects = spark.createDataFrame(asked, "id long, name string, entity_type string, dob string")
    listed = spark.createDataFrame(given, "id long, name string, dob string, status string")
    ids = lambda *x: spark.createDataFrame(list(x), "id long, type string, value string")
    rows = screening.screen(subjects, listed, subject_ids=ids((1, "PASSPORT", "p-12 3"), (3, "PASSPORT", "9")), listed_ids=ids((10, "PASSPORT", "P123"), (13, "PASSPORT", "9"), (11, "TAX", "p123")))
    got = {(r.subject, r.entity): r for r in rows.collect()}
    assert set(got) == {(1, 10), (3, 13), (4, 11), (4, 12)}  # 2 bears the name of 1, not the passport
    assert got[1, 10].band == "STRONG" and got[1, 10].strategies == ["identifier"] and got[3, 13].band == "STRONG"
    assert got[4, 11].score == 85.0 and got[4, 12].score == 100.0 and got[4, 12]["rank"] == 1  # 100 - 15; 100 + 10 - 10
    assert {e.reason: e.effect for e in got[4, 12].explanation.effects}["STATUS"] == -10.0


def test_every_subject_has_an_outcome(spark):
    asked = [(1, "John Smith", "INDIVIDUAL"), (2, "Nobody Known", "INDIVIDUAL"), (3, None, "INDIVIDUAL"), (4, " ", None), (5, "John Smith", "ORGANISATION"), (6, "!?", None)]
    subjects = spark.createDataFrame(asked, "id long, name string, entity_type string")
    listed = spark.createDataFrame([(10, "John Smith")], "id long, name string")
    want = {1: "STRONG", 2: "NO_MATCH", 3: "ERROR", 4: "ERROR", 5: "STRONG", 6: "ERROR"}
    assert {r.id: r.outcome for r in screening.outcomes(subjects, listed).collect()} == want
    assert {r.outcome for r in screening.outcomes(subjects, listed.limit(0)).collect()} == {"ERROR"}
    ids = lambda x: spark.createDataFrame([(x, "PASSPORT", "1")], "id long, type string, value string")
    got = screening.outcomes(subjects, listed, subject_ids=ids(2), listed_ids=ids(10)).collect()
    assert {r.id: r.outcome for r in got} == want | {2: "STRONG"} and len(got) == 6


def test_values_that_say_nothing_match_nothing(spark):
    ids = lambda *values: spark.createDataFrame([(k, "PASSPORT", v) for k, v in enumerate(values)], "id long, type string, value string")
    values = ("-", "ЖЩ 12", "مرم", "", None, "???", "n/a", "Unknown", "000000", "X-1", "日本 7")
    pairs = {tuple(r) for r in blocking.by_identifier(ids(*values), ids("???", "жщ12", "م ر م", "-", "N.A.", "UNKNOWN", "00-00-00", "x1", "日本7")).collect()}
    assert pairs == {(1, 1), (2, 2), (9, 7), (10, 8)}
    subjects = spark.createDataFrame([(1, "John Smith", "INDIVIDUAL")], "id long, name string, entity_type string")
    listed = spark.createDataFrame([(2, "Petrova Olga")], "id long, name string")
    assert screening.screen(subjects, listed, subject_ids=ids("-", "-"), listed_ids=ids("?", "?", "?")).count() == 0


def test_a_hot_value_is_spread_and_makes_pairs_of_classes_only(spark, monkeypatch):
    monkeypatch.setattr(blocking, "PAIRS_A_TASK", 20_000)
    rows = spark.range(600).selectExpr("id", "case when id % 3 = 0 then 'Ann Other' else concat('Name ', id) end name", "'T' type", "case when id < 400 then 'hot' else concat('v', id) end value")
    pairs = blocking.by_identifier(rows, rows)
    assert pairs.count() == 400 * 400 + 200 and pairs.distinct().count() == pairs.count()
    named = screening.identified_classes(rows, rows, rows, rows)
    assert named.count() == named.distinct().count() == 267 * 267 + 134
