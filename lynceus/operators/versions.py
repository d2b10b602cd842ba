"""Versioned lists: content hashes, reconciliation, gates, validity intervals and point-in-time reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def content_hash(*columns: str) -> Column:
    """SHA-256 of the columns in the order of their names; null and empty differ."""
    parts = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")) for c in sorted(columns)]
    return F.sha2(F.concat_ws("\x1f", *parts), 256)


def reconcile(live: DataFrame, staged: DataFrame, key: str) -> DataFrame:
    """(key, change, live_hash, staged_hash): ADDED, AMENDED, DELISTED or UNCHANGED; both sides have hash.

    Delisted records are tombstones to append; nothing is deleted.
    """
    old = live.select(key, F.col("hash").alias("live_hash"))
    new = staged.select(key, F.col("hash").alias("staged_hash"))
    change = (
        F.when(F.col("live_hash").isNull(), "ADDED").when(F.col("staged_hash").isNull(), "DELISTED")
        .when(F.col("live_hash") == F.col("staged_hash"), "UNCHANGED").otherwise("AMENDED")
    )
    return old.join(new, key, "full_outer").withColumn("change", change)


def tombstones(live: DataFrame, staged: DataFrame, key: str) -> DataFrame:
    return live.join(staged, key, "left_anti")


def delta_gate(changes: DataFrame, most: float = 0.2) -> DataFrame:
    """One row: counts of each change, the share of live records that changed, and whether to halt."""
    count = lambda word: F.count_if(F.col("change") == word)
    out = changes.agg(*[count(w).alias(w.lower()) for w in ("ADDED", "AMENDED", "DELISTED", "UNCHANGED")])
    before = F.col("amended") + F.col("delisted") + F.col("unchanged")
    share = F.coalesce(F.try_divide((F.col("added") + F.col("amended") + F.col("delisted")).cast("double"), before), F.lit(1.0))
    return out.withColumn("delta_share", F.round(share, 6)).withColumn("halt", F.col("delta_share") > most)


def load_report(rows: DataFrame, rejected: dict[str, Column]) -> DataFrame:
    """(outcome, n): records loaded, and those rejected by the first reason that holds; all of them are counted."""
    word = F.lit("LOADED")
    for reason, holds in reversed(rejected.items()):
        word = F.when(F.coalesce(holds, F.lit(False)), reason).otherwise(word)
    return rows.groupBy(word.alias("outcome")).agg(F.count("*").alias("n"))


def coverage(rows: DataFrame, slots: list[str]) -> DataFrame:
    """(slot, coverage): the share of rows that state each slot."""
    shares = rows.agg(*[F.round(F.avg(F.col(s).isNotNull().cast("int")), 6).alias(s) for s in slots])
    return shares.unpivot([], slots, "slot", "coverage")


def capability_gate(measured: DataFrame, expected: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """Measured and expected coverage by slot, and whether they agree; a slot not measured fails."""
    both = expected.join(measured, "slot", "left")
    return both.withColumn("ok", F.coalesce(F.abs(F.col("coverage") - F.col("expected")) <= tolerance, F.lit(False)))


def intervals(versions: DataFrame, key: str, start: str = "valid_from") -> DataFrame:
    """Versions with valid_to, the next version's start (null for the current one)."""
    order = Window.partitionBy(key).orderBy(start, "hash")
    return versions.withColumn("valid_to", F.lead(start).over(order))


def as_of(versions: DataFrame, at: Column, start: str = "valid_from") -> DataFrame:
    """The versions in force at a time."""
    return versions.filter((F.col(start) <= at) & (F.col("valid_to").isNull() | (at < F.col("valid_to"))))


def fingerprint(rows: DataFrame) -> DataFrame:
    """(n, checksum): of the rows' hashes, in any order."""
    return rows.agg(F.count("*").alias("n"), F.sum(F.conv(F.substring("hash", 1, 8), 16, 10).cast("long")).alias("checksum"))


def orphans(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    return children.join(parents, key, "left_anti")


def in_force(requests: DataFrame, versions: DataFrame, at: str, start: str, payload: list[str], as_: str, key: tuple[str, ...] = (), days: int = 7) -> DataFrame:
    """Every request with ``as_``, the payload of the version in force at its own time, null before the first one.

    A version is in force from its start on, until the next one of the same key (of the whole table without a key);
    of versions that start at once the greatest payload counts.  A request without a time has none.  Time is cut
    into buckets of ``days``: what is in force when a bucket begins is found among versions and buckets alone, and
    requests meet only the versions of their bucket, so neither a key with most of the requests nor a table of
    versions for all of them is one task's work.
    """
    second = lambda c: F.unix_timestamp(F.col(c).cast("timestamp"))
    width = days * 86400
    keys = [F.col(c) for c in key]
    once = versions.groupBy(*key, F.col(start).alias("_t")).agg(F.max(F.struct(*payload)).alias("_p"))
    once = once.select(*keys, F.col("_t").cast("timestamp").alias("_t"), F.lit(0).alias("_kind"), "_p")
    asked = requests.select(*keys, F.col(at).cast("timestamp").alias("_t"), F.lit(1).alias("_kind"), F.floor(second(at) / width).alias("_bucket"), F.struct(*requests.columns).alias("_r"))
    begin = (F.col("_bucket") * width).cast("timestamp")
    marks = asked.select(*keys, "_bucket").distinct().select(*keys, begin.alias("_t"), F.lit(-1).alias("_kind"), "_bucket")
    so_far = lambda by: F.last("_p", ignorenulls=True).over(Window.partitionBy(*by).orderBy("_t", "_kind").rowsBetween(Window.unboundedPreceding, 0))
    every = once.unionByName(marks, allowMissingColumns=True).withColumn("_p", so_far(key or [F.lit(0)]))
    marks = every.filter("_kind = -1")
    inside = once.withColumn("_bucket", F.floor(F.unix_timestamp("_t") / width))
    rows = asked.unionByName(marks, allowMissingColumns=True).unionByName(inside, allowMissingColumns=True)
    found = rows.withColumn("_p", so_far([*key, "_bucket"])).filter("_kind = 1")
    return found.select("_r.*", F.when(F.col("_t").isNotNull(), F.col("_p")).alias(as_))
