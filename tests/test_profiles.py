"""Profiles of nested records against a walk over the records."""

from collections import defaultdict

from lynceus.sources import profiles

SCHEMA = "id long, name struct<first:string,last:string>, alias array<string>, ids array<struct<type:string,value:array<int>>>, extra map<string,string>"
ROWS = [
    (1, ("Ann", "Other"), ["A", "B"], [("P", [1, 2]), ("T", None)], {"k": "v"}), (2, (None, "Smith"), [], [], {}), (3, None, None, None, None),
    (4, ("", "Smith"), ["A", None], [("P", []), None, (None, [2, 2])], {"k": None, "m": "v"}), (4, ("", "Smith"), ["A", None], [("P", []), None, (None, [2, 2])], {"k": None, "m": "v"}),
]


def walk(x, path, out):
    if x is None:
        return
    if isinstance(x, dict):
        for v in x.values():
            walk(v, path + "{}", out)
    elif isinstance(x, list):
        for v in x:
            walk(v, path + "[]", out)
    elif isinstance(x, tuple):
        for name, v in zip({"name": ("first", "last"), "ids[]": ("type", "value")}[path], x):
            walk(v, f"{path}.{name}", out)
    else:
        out[path].append(str(x))


def test_profiles_against_a_walk(spark):
    rows = spark.createDataFrame(ROWS, SCHEMA)
    want = defaultdict(list)
    for r in ROWS:
        found = defaultdict(list)
        for name, x in zip(("id", "name", "alias", "ids", "extra"), r):
            walk(x, name, found)
        for path, values in found.items():
            want[path].append(values)
    parts = profiles.profile(rows.filter("id < 3"), "a").unionByName(profiles.profile(rows.filter("id >= 3"), "b"))
    got = {r.path: r for r in profiles.told(profiles.united(parts)).collect()}
    assert set(got) == {"id", "name.first", "name.last", "alias[]", "ids[].type", "ids[].value[]", "extra{}", "$"}
    for path, each in want.items():
        values, r = [v for x in each for v in x], got[path]
        assert (r.records, r.filled, r.n, r.least, r.greatest, r.distinct) == (5, len(each), len(values), min(values), max(values), len(set(values)))
        assert {(x.value, x.n) for x in r.frequent} == {(v, values.count(v)) for v in set(values)}
    assert got["$"].n == 5 and got["$"].distinct == 3
    changes = {r.path: r.change for r in profiles.compared(*(parts.filter(f"load = '{x}'") for x in "ab")).collect()}
    assert changes["name.first"] == "FILLS_MORE" and changes["id"] == "SAME"
    assert profiles.profile(rows.limit(0), "none").collect() == []
