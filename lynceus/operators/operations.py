"""Operations on evidence: dispositions, whitelists, re-screening, usage, freshness, drift and audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lynceus.operators.ordinals import numbered
from lynceus.operators.shared import settled


def latest(events: DataFrame, key: str, at: str, tie: str, *columns: str) -> DataFrame:
    """The columns of each key's last event, ties by the greater ``tie``."""
    last = F.max_by(F.struct(at, tie, *columns), F.struct(at, tie))
    return events.groupBy(key).agg(last.alias("e")).select(key, F.col(f"e.{at}"), F.col(f"e.{tie}"), *[F.col(f"e.{c}") for c in columns])


def whitelisted(candidates: DataFrame, entries: DataFrame, at: Column) -> DataFrame:
    """All candidates, with whitelisted: an entry for (subject name, entity) that is approved and not expired."""
    valid = entries.filter((F.col("approved_at") <= at) & (F.col("expires_at").isNull() | (at < F.col("expires_at"))))
    flags = valid.select("l", "r").distinct().withColumn("_w", F.lit(True))
    return candidates.join(flags, ["l", "r"], "left").withColumn("whitelisted", F.coalesce("_w", F.lit(False))).drop("_w")


def rescreened(before: DataFrame, now: DataFrame, keys: list[str]) -> DataFrame:
    """NEW_HIT, RESOLVED_HIT, CHANGED_HIT or UNCHANGED for each pair that either run has."""
    a = before.select(*keys, F.col("band").alias("band_before"), F.lit(True).alias("_a"))
    b = now.select(*keys, F.col("band").alias("band_now"), F.lit(True).alias("_b"))
    outcome = (
        F.when(F.col("_a").isNull(), "NEW_HIT").when(F.col("_b").isNull(), "RESOLVED_HIT")
        .when(F.col("band_before").eqNullSafe(F.col("band_now")), "UNCHANGED").otherwise("CHANGED_HIT")
    )
    return a.join(b, keys, "full_outer").withColumn("outcome", outcome).drop("_a", "_b")


def usage(events: DataFrame, by: str, value: str) -> DataFrame:
    """Volume, alert rate and exact latency percentiles of each consumer."""
    pct = lambda p: F.round(F.percentile(value, F.lit(p)), 6)
    return events.groupBy(by).agg(
        F.count("*").alias("requests"), F.round(F.avg(F.col("alert").cast("int")), 6).alias("alert_rate"),
        pct(0.5).alias("p50"), pct(0.95).alias("p95"), pct(0.99).alias("p99"),
    )


def drift(daily: DataFrame, day: str, rate: str, days: int = 7, by: float = 0.5) -> DataFrame:
    """The days' rates with the mean of the days before, and whether they differ by more than a share of it."""
    before = Window.partitionBy("series").orderBy(day).rowsBetween(-days, -1)
    rows = daily.withColumn("baseline", F.round(F.avg(rate).over(before), 6))
    far = F.abs(F.col(rate) - F.col("baseline")) > by * F.col("baseline")
    return rows.withColumn("drift", F.coalesce(far, F.lit(False)))


def freshness(loads: DataFrame, now: Column, hours: int = 36) -> DataFrame:
    """Age in hours of each source's last load, and whether it is critical."""
    last = loads.groupBy("source").agg(F.max("loaded_at").alias("loaded_at"))
    age = F.floor((F.unix_timestamp(now) - F.unix_timestamp(F.col("loaded_at").cast("timestamp"))) / 3600)
    return last.withColumn("age_hours", age.cast("long")).withColumn("critical", F.col("age_hours") > hours)


def chunk_status(outcomes: DataFrame, chunk: Column) -> DataFrame:
    """(chunk, requests, errors, status) of a batch: COMPLETE, PARTIAL where some requests failed, FAILED where all did."""
    out = outcomes.groupBy(chunk.alias("chunk")).agg(F.count("*").alias("requests"), F.count_if(F.col("outcome") == "ERROR").alias("errors"))
    status = F.when(F.col("errors") == 0, "COMPLETE").when(F.col("errors") < F.col("requests"), "PARTIAL").otherwise("FAILED")
    return out.withColumn("status", status)


def idempotency(requests: DataFrame) -> DataFrame:
    """(key, n, payloads, conflict): the same key with another payload is a conflict."""
    out = requests.groupBy("key").agg(F.count("*").alias("n"), F.count_distinct("payload_hash").alias("payloads"))
    return out.withColumn("conflict", F.col("payloads") > 1)


def suppressed(alerts: DataFrame, closed: DataFrame, keys: list[str], at: Column, days: int = 90) -> DataFrame:
    """Alerts with suppressed: a like one was closed lately, and the listed record is still the same."""
    recent = closed.filter(F.datediff(at, F.col("closed_at")) <= days).select(*keys, "content_hash").distinct().withColumn("_s", F.lit(True))
    return alerts.join(recent, [*keys, "content_hash"], "left").withColumn("suppressed", F.coalesce("_s", F.lit(False))).drop("_s")


def audit_chain(events: DataFrame, stream: str, order: list[str], payload: str) -> DataFrame:
    """Events with the hash of each, chained: every one covers its predecessor in the same stream.

    Order matters only within a stream; streams are chained in parallel.
    """
    rows = events.withColumn("_p", F.col(payload).cast("string"))
    entries = F.array_sort(F.collect_list(F.struct(*order, "_p")))  # one stream's events
    seed = F.struct(F.lit("").alias("hash"), F.array().cast("array<string>").alias("all"))
    step = lambda a, e: F.sha2(F.concat(a["hash"], e["_p"]), 256)
    chain = F.aggregate(entries, seed, lambda a, e: F.struct(step(a, e).alias("hash"), F.array_append(a["all"], step(a, e)).alias("all")), lambda a: a["all"])
    grouped = rows.groupBy(stream).agg(entries.alias("entries"), chain.alias("hashes"))
    return grouped.select(stream, F.inline(F.arrays_zip("entries", "hashes"))).select(stream, "entries.*", F.col("hashes").alias("chain_hash")).drop("_p")


def latency_sketches(events: DataFrame, by: list[str], value: str, day: Column, k: int = 800) -> DataFrame:
    """(by, day, requests, alerts, sketch): what a day's usage report needs, with the values as a quantile sketch.

    Sketches are small, combine before the shuffle and are stored; ``usage_of`` merges days to any period.
    """
    out = events.groupBy(*by, day.alias("day"))
    return out.agg(F.count("*").alias("requests"), F.count_if("alert").alias("alerts"), F.kll_sketch_agg_double(F.col(value).cast("double"), k).alias("sketch"))


def usage_of(sketches: DataFrame, by: list[str], quantiles: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """Volume, alert rate and latency quantiles, within a percent of rank, from stored sketches alone."""
    merged = sketches.groupBy(*by).agg(F.sum("requests").alias("requests"), F.sum("alerts").alias("alerts"), F.kll_merge_agg_double("sketch").alias("sketch"))
    each = [F.kll_sketch_get_quantile_double("sketch", F.lit(q)).alias(f"p{q * 100:g}".replace(".", "_")) for q in quantiles]
    return merged.select(*by, "requests", F.round(F.col("alerts") / F.col("requests"), 6).alias("alert_rate"), *each)


#: Digests that one node of an audit tree covers.
AUDIT_ARITY = 16


def audit_tree(events: DataFrame, day: Column, order: list[str], payload: str) -> DataFrame:
    """(day, level, place, digest): a Merkle tree for each day of audit events, by aggregation alone.

    Leaves are hashes of payloads in order (``ordinals.numbered``, so no day is one task's work); each level hashes
    16 nodes of the one below, and the topmost level of a day has its root at place 0.  A day that was closed is
    never touched again: another day's events add rows and change none.
    """
    leaves = events.select(day.alias("day"), *order, F.sha2(F.concat(F.lit("leaf"), F.coalesce(F.col(payload).cast("string"), F.lit(""))), 256).alias("digest"))
    level = settled(numbered(leaves, ["day"], [*order, "digest"]).select("day", F.lit(0).alias("level"), "place", "digest", "total"), "audit")
    out, k = level, 0
    while (level.agg(F.max("total")).first()[0] or 0) > 1:
        k += 1
        run = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "digest"))), lambda x: x["digest"]), "")  # 16 at most
        up = level.filter("total > 1").groupBy("day", F.floor(F.col("place") / AUDIT_ARITY).alias("place"), F.ceil(F.col("total") / AUDIT_ARITY).alias("total"))
        level = settled(up.agg(F.sha2(F.concat(F.lit("node"), run), 256).alias("digest")).select("day", F.lit(k).alias("level"), "place", "digest", "total"), "audit")
        out = out.unionByName(level)
    return out.select("day", "level", "place", "digest", "total")


def audit_roots(tree: DataFrame) -> DataFrame:
    """(day, root, n): the root of each day and how many events it has."""
    n = tree.filter("level = 0").groupBy("day").agg(F.count("*").alias("n"))
    return tree.filter("total = 1").select("day", F.col("digest").alias("root")).join(n, "day")


def audit_proofs(tree: DataFrame, wanted: DataFrame) -> DataFrame:
    """(day, place, leaf, path) of the wanted (day, place): at each level the run of digests that the node stands in, and where.

    Paths grow from the root down, once for each run of nodes, and leaves take theirs where their run is: what is
    shuffled has a path for 16 leaves, and none is carried through the levels by every leaf.
    """
    height = tree.filter("total > 1").agg(F.max("level")).first()[0] or 0
    parents = lambda rows: rows.groupBy("day", F.floor(F.col("place") / AUDIT_ARITY).alias("_run")).agg(F.collect_set("place").alias("_wanted"))  # 16 at most
    asked = [parents(wanted)]
    for _ in range(height):
        asked.append(parents(asked[-1].select("day", F.col("_run").alias("place"))))
    none, above = F.array().cast("array<struct<at:int,run:array<string>>>"), None
    at = (F.col("place") % AUDIT_ARITY).cast("int")
    for k in reversed(range(height + 1)):
        nodes = tree.filter(F.col("level") == k).groupBy("day", F.floor(F.col("place") / AUDIT_ARITY).alias("_run"))
        runs = nodes.agg(F.max("total").alias("total"), F.transform(F.array_sort(F.collect_list(F.struct("place", "digest"))), lambda x: x["digest"]).alias("run"))
        runs = runs.join(asked[k], ["day", "_run"])
        runs = runs.withColumn("path", none) if above is None else runs.join(above, ["day", "_run"], "left").withColumn("path", F.coalesce("path", none))
        each = runs.select("day", "total", "run", "path", F.explode("_wanted").alias("place"))
        path = F.when(F.col("total") > 1, F.concat(F.array(F.struct(at.alias("at"), "run")), "path")).otherwise(F.col("path"))
        above = each.select("day", F.col("place").alias("_run"), F.get("run", at).alias("leaf"), path.alias("path"))
        above = above.drop("leaf") if k else above
    return above.withColumnRenamed("_run", "place").filter("leaf is not null")


def audit_verified(proofs: DataFrame, roots: DataFrame) -> DataFrame:
    """The proofs with ``verified``: whether the leaf stands in each run where it should and folds up to its day's root."""
    start = F.struct(F.col("leaf").alias("h"), F.lit(True).alias("ok"))
    up = lambda a, s: F.struct(F.sha2(F.concat(F.lit("node"), F.array_join(s["run"], "")), 256).alias("h"), (a["ok"] & F.coalesce(F.get(s["run"], s["at"]) == a["h"], F.lit(False))).alias("ok"))
    end = F.aggregate("path", start, up)
    return proofs.join(roots.select("day", "root"), "day", "left").withColumn("verified", F.coalesce(end["ok"] & (end["h"] == F.col("root")), F.lit(False)))
