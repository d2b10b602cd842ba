"""Lines of deliveries: numbers over files and splits, records, quarantine."""

from pyspark.sql import types as T

from lynceus.sources import lines


def test_numbers_over_files_and_splits(spark, tmp_path):
    texts = {"a.txt": ["x" * (k % 300) for k in range(3000)], "b.txt": ["one", "", "three"], "c.txt": [str(k) for k in range(5000)]}
    for name, each in texts.items():
        (tmp_path / name).write_text("\n".join(each) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        rows = lines.lined(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    got = sorted((r.ordinal, r.file.rsplit("/", 1)[1], r.line, r.value) for r in rows)
    want = [(name, k, x) for name, each in texts.items() for k, x in enumerate(each, 1)]
    assert got == [(k, *w) for k, w in enumerate(want, 1)]


def test_quarantine_names_file_and_line(spark, tmp_path):
    (tmp_path / "f.csv").write_text("id,name\n1,Ann\nx,Bob\n3,\n\n5,Eve\n")
    (tmp_path / "g.csv").write_text("id,name\n6,Fay\n7,\n")
    schema = T.StructType().add("id", "long").add("name", "string")
    rows = lines.parsed(lines.lined(spark, str(tmp_path)), schema, "csv", header=True)
    bad = lines.quarantined(rows, ("name",))
    assert {(r.file[-5:], r.line, r.reason) for r in bad.collect()} == {("f.csv", 3, "MALFORMED"), ("f.csv", 4, "MISSING_NAME"), ("g.csv", 3, "MISSING_NAME")}
    assert bad.filter("reason = 'MALFORMED'").first().excerpt == "x,Bob"
    one = lines.threshold(rows, bad).first()
    assert (one.records, one.quarantined, one.halt) == (6, 3, True)
    (tmp_path / "e").mkdir()
    (tmp_path / "e" / "none.txt").write_text("")
    none = lines.lined(spark, str(tmp_path / "e"))
    assert none.collect() == [] and lines.threshold(none, none).first().halt
