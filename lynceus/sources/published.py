"""Published versions of a list: staged beside each other, switched by one rename, read pinned.

A version is a folder that is written once.  Which one is live stands in one small manifest, which is replaced by
an atomic rename; a reader resolves it once and keeps reading that version's folder, so during a promotion it sees
the old version or the new one, whole, and never both.  Rolling back is promoting an earlier version.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "_live.json"


def _files(spark: SparkSession, path: str):
    """Hadoop's file context of a path, and what makes paths."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path
    return jvm.org.apache.hadoop.fs.FileContext.getFileContext(at(path).toUri(), spark.sparkContext._jsc.hadoopConfiguration()), at


def folder(path: str, version: str) -> str:
    return f"{path}/version={version}"


def stage(rows: DataFrame, path: str, version: str, key: str) -> dict:
    """Writes a version and tells its size and checksum, of the rows as they can be read again; a version is never overwritten."""
    place = folder(path, version)
    rows.write.mode("errorifexists").parquet(place)
    return measured(rows.sparkSession.read.parquet(place), version, key)


def measured(rows: DataFrame, version: str, key: str) -> dict:
    """Number of rows, of distinct keys, and 128 bits of all rows in any order, repeated rows included."""
    row = F.struct(*sorted(rows.columns))
    bits = lambda seed: F.xxhash64(F.lit(seed), row)
    one = rows.agg(F.count("*").alias("n"), F.count_distinct(key).alias("keys"), *[F.sum(bits(s).cast("decimal(38,0)")).cast("string").alias(f"s{s}") for s in (1, 2)], F.bit_xor(bits(3)).alias("x")).first()
    return {"version": version, "rows": one.n, "keys": one["keys"], "checksum": f"{one.s1 or 0}:{one.s2 or 0}:{one.x or 0}"}


def manifest(spark: SparkSession, path: str) -> dict | None:
    """The manifest as it stands, or none before the first promotion."""
    files, at = _files(spark, path)
    if not files.util().exists(at(f"{path}/{MANIFEST}")):
        return None
    stream = files.open(at(f"{path}/{MANIFEST}"))
    try:
        return json.loads(bytes(stream.readAllBytes()))
    finally:
        stream.close()


def promote(spark: SparkSession, path: str, staged: dict, key: str, least: float = 0.0) -> dict:
    """Makes a staged version the live one; what is on disk must be what was staged, and not be empty.

    ``least`` is the share of the live version's rows that the next one must have.  Nothing changes where a check fails.
    """
    found = measured(spark.read.parquet(folder(path, staged["version"])), staged["version"], key)
    if found != staged or not found["rows"]:
        raise ValueError(f"version {staged['version']} is not as it was staged, or empty")
    before = manifest(spark, path)
    if before and found["rows"] < least * before["live"]["rows"]:
        raise ValueError(f"version {staged['version']} has {found['rows']} rows, the live one {before['live']['rows']}")
    history = [*(before["history"] if before else []), found["version"]]
    after = {"live": found, "history": history}
    files, at = _files(spark, path)
    jvm = spark.sparkContext._jvm
    new = at(f"{path}/_{uuid.uuid4().hex}.tmp")
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.CreateOpts, 0)
    out = files.create(new, jvm.java.util.EnumSet.of(jvm.org.apache.hadoop.fs.CreateFlag.CREATE), options)
    try:
        out.write(json.dumps(after).encode())
    finally:
        out.close()
    files.rename(new, at(f"{path}/{MANIFEST}"), _overwrite(spark))
    return after


def _overwrite(spark: SparkSession):
    gateway, rename = spark.sparkContext._gateway, spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename
    options = gateway.new_array(rename, 1)
    options[0] = rename.OVERWRITE
    return options


def live(spark: SparkSession, path: str) -> DataFrame:
    """The live version, pinned: later promotions do not change what this frame reads; none is an error, never an empty list."""
    now = manifest(spark, path)
    if now is None:
        raise LookupError(f"no version of {path} is live")
    return spark.read.parquet(folder(path, now["live"]["version"]))
