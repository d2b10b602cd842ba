"""Audit trees and usage sketches: against plain computation, and what an added day leaves alone."""

import hashlib
import random

from pyspark.sql import functions as F

from lynceus.operators import operations as OP


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def root(payloads):
    level = [sha("leaf" + (p or "")) for p in payloads]
    while len(level) > 1:
        level = [sha("node" + "".join(level[k : k + 16])) for k in range(0, len(level), 16)]
    return level[0]


def test_audit_tree_by_hand_and_appended_day(spark):
    rng = random.Random(3)
    sizes = {"a": 1, "b": 16, "c": 17, "d": 600}
    days = {d: [(d, k, rng.choice(["x", "y", None])) for k in range(n)] for d, n in sizes.items()}
    table = lambda names: spark.createDataFrame([r for d in names for r in days[d]], "d string, k long, payload string").repartition(3)
    tree = OP.audit_tree(table("abcd"), F.col("d"), ["k"], "payload")
    roots = {r.day: (r.root, r.n) for r in OP.audit_roots(tree).collect()}
    assert roots == {d: (root([p for *_, p in days[d]]), n) for d, n in sizes.items()}
    before = {r.day: r.root for r in OP.audit_roots(OP.audit_tree(table("abc"), F.col("d"), ["k"], "payload")).collect()}
    assert all(roots[d][0] == x for d, x in before.items())
    wanted = spark.createDataFrame([("d", 0), ("d", 599), ("c", 16), ("a", 0), ("a", 5)], "day string, place long")
    proofs = OP.audit_proofs(tree, wanted)
    held = OP.audit_verified(proofs, OP.audit_roots(tree)).collect()
    assert len(held) == 4 and all(r.verified for r in held) and {len(r.path) for r in held if r.day == "d"} == {3}
    moved = proofs.withColumn("path", F.transform("path", lambda s: F.struct(((s["at"] + 1) % 16).alias("at"), s["run"].alias("run"))))
    assert not any(r.verified for r in OP.audit_verified(moved.filter("day <> 'a'"), OP.audit_roots(tree)).collect())
    assert OP.audit_roots(OP.audit_tree(table("abcd").limit(0), F.col("d"), ["k"], "payload")).count() == 0


def test_leaves_take_their_paths_after_all_joins(spark):
    events = spark.range(300).select(F.lit("a").alias("d"), F.col("id").alias("k"), F.col("id").cast("string").alias("payload"))
    tree = OP.audit_tree(events, F.col("d"), ["k"], "payload")
    proofs = OP.audit_proofs(tree, tree.filter("level = 0").select("day", "place"))
    plan = proofs._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" in plan and plan.index("Generate") < plan.index("Join")
    held = OP.audit_verified(proofs, OP.audit_roots(tree)).collect()
    assert sorted(r.place for r in held) == list(range(300)) and all(r.verified and len(r.path) == 3 for r in held)


def test_usage_from_sketches_of_days(spark):
    rng = random.Random(4)
    rows = [(rng.choice("ab"), rng.randrange(30), rng.lognormvariate(3, 1)) for _ in range(20_000)]
    events = spark.createDataFrame(rows, "c string, day int, ms double").withColumn("alert", F.col("ms") > 50)
    days = OP.latency_sketches(events, ["c"], "ms", F.col("day"))
    assert days.count() == 60
    for r in OP.usage_of(days, ["c"]).collect():
        values = sorted(v for c, _, v in rows if c == r.c)
        assert r.requests == len(values) and abs(r.alert_rate - sum(v > 50 for v in values) / len(values)) < 1e-6
        for q, got in ((0.5, r.p50), (0.95, r.p95), (0.99, r.p99)):
            assert abs(sum(v <= got for v in values) / len(values) - q) <= 0.01
