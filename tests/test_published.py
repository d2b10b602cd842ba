"""Published versions under concurrent reading, and suppression that lasts across batches of a stream."""

import datetime as dt
import threading

import pytest

from lynceus.sources import published
from lynceus.streaming import rescreen


def test_a_reader_sees_one_version_only(spark, tmp_path):
    path, rows = str(tmp_path / "list"), lambda v: spark.range(200).selectExpr("id", f"{v} as v")
    with pytest.raises(LookupError):
        published.live(spark, path)
    staged = {v: published.stage(rows(v), path, str(v), "id") for v in (1, 2)}
    published.promote(spark, path, staged[1], "id")
    pinned, seen, stop = published.live(spark, path), [], threading.Event()

    def read():
        while not stop.is_set():
            seen.append({r.v for r in published.live(spark, path).select("v").distinct().collect()})

    reader = threading.Thread(target=read)
    reader.start()
    for v in (2, 1, 2, 1, 2):
        published.promote(spark, path, staged[v], "id")
    stop.set()
    reader.join()
    assert seen and all(len(x) == 1 for x in seen)
    assert {r.v for r in pinned.select("v").distinct().collect()} == {1} and published.manifest(spark, path)["history"] == ["1", "2", "1", "2", "1", "2"]


def test_a_bad_version_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "list")
    good = published.stage(spark.range(100).selectExpr("id"), path, "1", "id")
    published.promote(spark, path, good, "id")
    small = published.stage(spark.range(10).selectExpr("id"), path, "2", "id")
    none = published.stage(spark.range(0).selectExpr("id"), path, "3", "id")
    for staged, least in ((small, 0.5), (none, 0.0), (small | {"rows": 11}, 0.0)):
        with pytest.raises(ValueError):
            published.promote(spark, path, staged, "id", least)
    with pytest.raises(Exception):
        published.stage(spark.range(5).selectExpr("id"), path, "1", "id")
    assert published.live(spark, path).count() == 100


def test_suppression_across_batches(spark, tmp_path):
    day = lambda d, h=0: dt.datetime(2024, 1, 1) + dt.timedelta(days=d, hours=h)
    batches = [
        [("a", "x", day(0), "v1"), ("a", "x", day(1), "v1"), ("b", "x", day(0), "v1"), ("c", "x", day(0), None)],
        [("a", "x", day(5), "v1"), ("a", "y", day(5), "v1"), ("b", "x", day(5), "v2"), ("b", "x", day(6), "v2"), ("c", "x", day(5), None)],
        [("a", "x", day(11), "v1"), ("b", "x", day(14), "v2"), ("b", "x", day(17), "v2")],
    ]
    source, sink = str(tmp_path / "in"), str(tmp_path / "out")
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    for rows in batches:  # each run is one that goes on where the last one ended
        spark.createDataFrame(rows, "l string, r string, at timestamp, content string").coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("l string, r string, at timestamp, content string").parquet(source)
        rescreen.run_to(rescreen.suppress_repeats(stream, ["l", "r"], "at", "content", 10, "30 days"), sink, str(tmp_path / "state"))
    got = {(r.l, r.r, r["at"], r.content): r.suppressed for r in spark.read.parquet(sink).collect()}
    open_ = {("a", "x", day(0), "v1"), ("b", "x", day(0), "v1"), ("a", "y", day(5), "v1"), ("b", "x", day(5), "v2"), ("a", "x", day(11), "v1"), ("b", "x", day(17), "v2"), ("c", "x", day(0), None), ("c", "x", day(5), None)}
    assert len(got) == 12 and {k for k, s in got.items() if not s} == open_
