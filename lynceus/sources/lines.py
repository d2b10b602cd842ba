"""Lines of a delivery with their file, their line number and their place in the feed.

Spark reads a file in splits, each of which has its lines in order.  Lines are numbered within their split as the
scan gives them, splits are counted, and a prefix sum over the splits of a file, and over all files by path, makes
line numbers and ordinals.  Only counts of splits meet in one window; the lines stay where they are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lynceus.operators.shared import settled

SPLIT_LINES = "file string, block long, n long, value string"


def _numbered(batches):
    """Each line's number within its split, from 0, in the order of the scan."""
    seen: dict[tuple[str, int], int] = {}
    for batch in batches:
        splits = list(zip(batch.column("file").to_pylist(), batch.column("block").to_pylist()))
        edges = [0, *(k for k in range(1, len(splits)) if splits[k] != splits[k - 1]), len(splits)]
        number = np.arange(len(splits), dtype=np.int64)
        for a, b in zip(edges, edges[1:]):
            if b > a:
                number[a:b] += seen.get(splits[a], 0) - a
                seen[splits[a]] = int(number[b - 1]) + 1
        yield pa.RecordBatch.from_arrays([batch.column("file"), batch.column("block"), pa.array(number), batch.column("value")], names=["file", "block", "n", "value"])


def lined(spark: SparkSession, path: str, separator: str | None = None) -> DataFrame:
    """(file, line, ordinal, value) of every line of the files, both numbers from 1; files follow each other by path.

    Empty lines count and are kept.  Lines end at ``separator``, if one is given.  The result is a table: a split's
    lines are read once.
    """
    reader = spark.read if separator is None else spark.read.option("lineSep", separator)
    scan = reader.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
    rows = settled(scan.mapInArrow(_numbered, SPLIT_LINES), "lines")
    splits = rows.groupBy("file", "block").agg(F.count("*").alias("lines"))
    before = lambda *by: F.coalesce(F.sum("lines").over((Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    splits = splits.withColumns({"in_file": before("file"), "in_feed": before()}).drop("lines")  # one row for each split
    return rows.join(splits, ["file", "block"]).select("file", (F.col("n") + F.col("in_file") + 1).alias("line"), (F.col("n") + F.col("in_feed") + 1).alias("ordinal"), "value")


def parsed(lines: DataFrame, schema: T.StructType, format_id: str, separator: str = ",", header: bool = False) -> DataFrame:
    """Lines as records of JSON or CSV: the schema's columns, file, line, ordinal and ``_corrupt_record``, the text of a line that is none.

    With ``header`` the first line of each file is none.  A record of several lines is not one; an empty line is skipped.
    """
    whole = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}
    rows = lines.filter("trim(value) <> ''" + (" and line > 1" if header else ""))
    if format_id == "json":
        record = F.from_json("value", whole, options)
    elif format_id == "csv":
        record = F.from_csv("value", whole.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "), options | {"sep": separator})
    else:
        raise KeyError(f"no records by line in format {format_id!r}")
    return rows.select(record.alias("r"), "file", "line", "ordinal").select("r.*", "file", "line", "ordinal")


def quarantined(records: DataFrame, required: tuple[str, ...] = (), excerpt: int = 200) -> DataFrame:
    """(file, line, reason, excerpt): records that are malformed, or lack a required column."""
    reason = F.when(F.col("_corrupt_record").isNotNull(), "MALFORMED")
    for c in required:
        reason = reason.when(F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == ""), f"MISSING_{c.upper()}")
    text = F.coalesce("_corrupt_record", F.to_json(F.struct(*[c for c in records.columns if c not in ("file", "line", "ordinal", "_corrupt_record")])))
    return records.select("file", "line", reason.alias("reason"), F.left(text, F.lit(excerpt)).alias("excerpt")).filter("reason is not null")


def threshold(records: DataFrame, quarantine: DataFrame, most: float = 0.01) -> DataFrame:
    """One row: records, how many of them are quarantined, their share, and whether the load must stop; an empty feed must."""
    n, bad = records.agg(F.count("*").alias("n")).scalar(), quarantine.agg(F.count("*").alias("n")).scalar()
    one = records.sparkSession.range(1).select(n.alias("records"), bad.alias("quarantined"))
    share = F.coalesce(F.try_divide(F.col("quarantined").cast("double"), F.col("records")), F.lit(1.0))
    return one.withColumn("share", F.round(share, 6)).withColumn("halt", F.col("share") > most)
