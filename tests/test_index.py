"""The persisted key index: deltas against whole runs, versions, and what a run reads."""

import pytest
from pyspark.sql import functions as F

from lynceus.functions import names as NM
from lynceus.operators import blocking, index
from lynceus.plans import screening

PEOPLE = [(1, "John Smith", "INDIVIDUAL"), (2, "Jon Smith", "INDIVIDUAL"), (3, "Africa Trading Company", "ORGANISATION"), (4, "Maria da Silva", "INDIVIDUAL"), (5, None, "INDIVIDUAL"), (6, "John  SMITH", "INDIVIDUAL")]
LISTED = [(10, "John Smyth"), (11, "Maria Silva"), (12, "Acme Limited"), (13, "Africa Trading Co"), (14, "Acme Ltd"), (15, "")]


@pytest.fixture(scope="module")
def tables(spark):
    return spark.createDataFrame(PEOPLE, "id long, name string, entity_type string"), spark.createDataFrame(LISTED, "id long, name string")


def rows(frame):
    return sorted((r.l, r.r, tuple(r.strategies), r.score, r.band) for r in frame.collect())


def test_delta_equals_the_whole_run_on_its_names(spark, tables):
    people, listed = tables
    population = index.build(people, "id", "name", "entity_type", buckets=3)
    changed = spark.createDataFrame([(12, "Jonn Smith"), (20, "Silva Maria"), (21, "Zhang Wei"), (22, None)], "id long, name string")
    now = listed.filter("id <> 12").unionByName(changed)
    names = [r[0] for r in changed.select(NM.normalised(F.col("name"))).collect()]
    whole = screening.screen(people, now).filter(F.col("r").isin(names))
    found = index.rescreened(population, changed, "id", "name")
    assert rows(found) == rows(whole) and found.count() >= 3
    files = " ".join(found.inputFiles())
    assert "name_class" in files and "listed" not in files
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:  # what is asked is dealt to the index's buckets, the index stays where it is
        asked = blocking.postings(blocking.keyed(blocking.name_classes(changed, "id", "name")), population.counts)
        plan = population.keys.join(asked.withColumnRenamed("name", "r"), "key")._jdf.queryExecution().executedPlan().toString()
        assert "Bucketed: true" in plan and plan.count("Exchange hashpartitioning(key") == 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_updates_append_and_bury(spark, tables):
    _, listed = tables
    first = index.build(listed, "id", "name", buckets=2)
    gone = spark.createDataFrame([("acme ltd",), ("nobody",)], "name string")
    more = spark.createDataFrame([(30, "John Smyth"), (31, "Neo Name")], "id long, name string")
    second = index.updated(first, more, gone, "id", "name")
    third = index.updated(second, spark.createDataFrame([(40, "ACME ltd.")], "id long, name string"), gone.limit(0), "id", "name")
    names = lambda i, v=None: sorted(r.name for r in index.live(i, v).classes.collect())
    assert names(first) == ["acme ltd", "africa trading co", "john smyth", "maria silva"]
    assert names(second) == ["africa trading co", "john smyth", "maria silva", "neo name"]
    assert names(third) == sorted(names(second) + ["acme ltd"]) and names(third, 1) == names(first) and names(third, 2) == names(second)
    asked = blocking.keyed(blocking.name_classes(spark.createDataFrame([(1, "Acme Ltd"), (2, "Neo Name")], "id long, name string"), "id", "name"))
    assert {(r.l, r.r) for r in index.probed(second, asked).collect()} == {("neo name", "neo name")}
    assert {(r.l, r.r) for r in index.probed(third, asked).collect()} == {("neo name", "neo name"), ("acme ltd", "acme ltd")}


def test_outcomes_of_a_delta(spark):
    before = spark.createDataFrame([("a", "x", "STRONG"), ("b", "x", "POSSIBLE"), ("c", "y", "STRONG"), ("d", "z", "STRONG")], "l string, r string, band string")
    now = spark.createDataFrame([("a", "x", "STRONG"), ("b", "x", "STRONG"), ("e", "w", "STRONG")], "l string, r string, band string")
    found = index.outcomes(before, now, spark.createDataFrame([("y",)], "name string"))
    assert {(r.l, r.r): r.outcome for r in found.collect()} == {("a", "x"): "UNCHANGED", ("b", "x"): "CHANGED_HIT", ("c", "y"): "RESOLVED_HIT", ("e", "w"): "NEW_HIT"}
