"""Version pointers, canaries, configuration changes, stored decisions and shared tables in odd cases."""

import json

import pytest
from pyspark.sql import functions as F

from lynceus.operators import benchmark as BM
from lynceus.operators import evidence as EV
from lynceus.operators import operations as OP
from lynceus.operators import shared
from lynceus.operators import versions as VS


def test_pointers_move_back_only_to_what_was_promoted(spark):
    events = [("a", 1, "PROMOTE", 10), ("a", 2, "PROMOTE", 11), ("a", 3, "ROLLBACK", 10), ("a", 4, "ROLLBACK", 99), ("b", 1, "ROLLBACK", 5), ("c", 1, None, 5)]
    history = EV.pointer_history(spark.createDataFrame(events, "list string, seq int, action string, version int"), "list", ["seq"])
    rows = {(r.list, r.seq): r for r in history.collect()}
    assert [rows["a", k].live_before for k in (1, 2, 3, 4)] == [None, 10, 11, 10]
    assert rows["a", 3].valid and not rows["a", 4].valid and not rows["b", 1].valid and not rows["c", 1].valid
    assert {r.list: r.version for r in EV.live_versions(history, "list", ["seq"]).collect()} == {"a": 10}


def test_canaries(spark):
    frame = lambda *x: spark.createDataFrame(list(x), "case int, band string")
    out = EV.canary(frame((1, "STRONG"), (2, "POSSIBLE"), (3, None), (4, "STRONG")), frame((1, "STRONG"), (2, "STRONG"), (3, None), (5, "STRONG")), ["case"], "band")
    assert {r.case: r.outcome for r in out.collect()} == {1: "OK", 2: "DIFFERS", 3: "OK", 4: "MISSING", 5: "UNEXPECTED"}
    assert EV.canary_gate(out).first().asDict() == {"cases": 5, "deviations": 3, "critical": True}
    assert EV.canary_gate(out.filter("outcome = 'OK'")).first().critical is False and EV.canary_gate(out.limit(0)).first().critical is True


def test_decisions_are_told_from_json(spark):
    requests = spark.createDataFrame([(1, "v1"), (2, None)], "key int, list_version string")
    found = spark.createDataFrame([(1, 2, "b", None), (1, 1, "a", 80), (3, 1, "z", 5)], "key int, rank int, entity string, score int")
    made = EV.decisions(requests, found, "key", F.col("rank"), ["rank", "entity", "score"], ["list_version"])
    rows = {r.key: r for r in made.collect()}
    assert rows[1].n_candidates == 2 and [c["entity"] for c in json.loads(rows[1].evidence)["candidates"]] == ["a", "b"]
    assert rows[2].n_candidates == 0 and json.loads(rows[2].evidence) == {"candidates": []}
    again = EV.told_again(made, "key", "list_version string, candidates array<struct<rank:int,entity:string,score:int>>").collect()
    assert [(r.key, r.list_version, r.rank, r.entity, r.score) for r in again] == [(1, "v1", 1, "a", 80), (1, "v1", 2, "b", None)]


def test_reports_of_loads_chunks_and_agreement(spark):
    rows = spark.createDataFrame([(1, None), (2, 5), (3, -1)], "id int, v int")
    assert {r.outcome: r.n for r in VS.load_report(rows, {"NEGATIVE": F.col("v") < 0, "ODD": F.col("v") % 2 != 0}).collect()} == {"LOADED": 1, "ODD": 1, "NEGATIVE": 1}
    done = spark.createDataFrame([(1, "ERROR"), (2, "STRONG"), (11, "ERROR"), (21, "NO_MATCH")], "id int, outcome string")
    assert {r.chunk: r.status for r in OP.chunk_status(done, F.floor(F.col("id") / 10)).collect()} == {0: "PARTIAL", 1: "FAILED", 2: "COMPLETE"}
    both = spark.createDataFrame([(True, True), (True, None), (False, True), (None, None)], "a boolean, b boolean")
    assert [r.agreement for r in BM.agreement(both, F.col("a"), F.col("b")).collect()] == ["BOTH_HIT", "ONLY_OURS", "ONLY_THEIRS", "BOTH_CLEAR"]


def test_no_local_folder_on_a_cluster():
    class Session:
        class conf:
            get = staticmethod(lambda key, default: default)

        class sparkContext:
            master = "local-cluster[2,1,1024]"

    with pytest.raises(ValueError):
        shared.shared_folder(Session)
