"""Versions in force at each request's own time, against a plain search."""

import datetime as dt
import random

from lynceus.operators import versions


def test_in_force_against_a_plain_search(spark):
    rng, day = random.Random(7), dt.datetime(2024, 1, 1)
    moment = lambda: day + dt.timedelta(hours=rng.randrange(24 * 60))
    made = [(rng.choice(["a", "b", None, "hot"]), moment(), k) for k in range(60)]
    made += [("a", made[0][1], 100), ("late", day + dt.timedelta(days=90), 101)]
    asked = [(k, rng.choice(["a", "b", None, "hot", "hot", "none", "late"]), moment()) for k in range(400)]
    asked += [(900, "a", None), (901, made[5][0], made[5][1]), (902, "hot", day - dt.timedelta(days=3)), (902, "hot", day - dt.timedelta(days=3))]
    requests = spark.createDataFrame(asked, "id long, k string, at timestamp")
    table = spark.createDataFrame(made, "k string, start timestamp, version long")

    def plain(key, at, of):
        fits = [(s, v) for k, s, v in made if (not of or k == key) and at is not None and s <= at]
        return max(fits)[1] if fits else None

    for key, days in ((("k",), 7), ((), 7), (("k",), 1)):
        found = versions.in_force(requests, table, "at", "start", ["version"], "v", key, days).collect()
        assert sorted(((r.id, r.v.version if r.v else None) for r in found), key=repr) == sorted(((i, plain(k, at, key)) for i, k, at in asked), key=repr)
    assert versions.in_force(requests, table.limit(0), "at", "start", ["version"], "v", ("k",)).filter("v is null").count() == len(asked)
    assert versions.in_force(requests.limit(0), table, "at", "start", ["version"], "v").count() == 0
