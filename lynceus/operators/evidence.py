"""Evidence and governance: version pointers, canaries, configuration changes, and decisions told from what was stored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def pointer_history(events: DataFrame, of: str, order: list[str]) -> DataFrame:
    """Events (of, action, version, order) with ``valid`` and ``live_before``.

    PROMOTE and ROLLBACK both point a list at a version; a rollback is valid only to a version that was
    promoted before it, and one that is not valid moves nothing.
    """
    before = Window.partitionBy(of).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    first = Window.partitionBy(of, "version").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    known = F.coalesce(F.max((F.col("action") == "PROMOTE").cast("int")).over(first), F.lit(0)) == 1
    rows = events.withColumn("valid", (F.col("action") == "PROMOTE") | (F.col("action") == "ROLLBACK") & known)
    moved = F.when(F.col("valid"), F.col("version"))
    return rows.withColumn("live_before", F.last(moved, ignorenulls=True).over(before))


def live_versions(history: DataFrame, of: str, order: list[str]) -> DataFrame:
    """(of, version): where each list points now."""
    moves = history.filter("valid")
    return moves.groupBy(of).agg(F.max_by("version", F.struct(*order)).alias("version"))


def canary(expected: DataFrame, found: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The keys with OK, MISSING, UNEXPECTED or DIFFERS: what a known set should give, against what it gives."""
    a = expected.select(*keys, F.col(value).alias("_e"), F.lit(True).alias("_a"))
    b = found.select(*keys, F.col(value).alias("_f"), F.lit(True).alias("_b"))
    outcome = (
        F.when(F.col("_b").isNull(), "MISSING").when(F.col("_a").isNull(), "UNEXPECTED")
        .when(F.col("_e").eqNullSafe(F.col("_f")), "OK").otherwise("DIFFERS")
    )
    return a.join(b, keys, "full_outer").select(*keys, outcome.alias("outcome"))


def canary_gate(outcomes: DataFrame) -> DataFrame:
    """One row: cases, deviations, and whether any of them makes the load critical; no case is critical as well."""
    out = outcomes.agg(F.count("*").alias("cases"), F.count_if(F.col("outcome") != "OK").alias("deviations"))
    return out.withColumn("critical", (F.col("deviations") > 0) | (F.col("cases") == 0))


def config_changes(history: DataFrame, parameter: str, order: list[str], value: str) -> DataFrame:
    """Each change with its previous value, whether it changes anything, and the version of its parameter.

    A change may be promoted if it was approved and its regression run passed; both columns are the history's.
    """
    own = Window.partitionBy(parameter).orderBy(*order)
    rows = history.withColumns({"previous": F.lag(value).over(own), "config_version": F.row_number().over(own)})
    changed = ~F.col("previous").eqNullSafe(F.col(value))
    return rows.withColumns({"changed": changed, "promotable": changed & F.col("approved") & F.col("regression_passed")})


def decisions(requests: DataFrame, candidates: DataFrame, key: str, order: Column, stored: list[str], told: list[str]) -> DataFrame:
    """(key, n_candidates, evidence): each request with its stored candidates as JSON, nothing computed anew.

    ``told`` are the request's columns that the evidence repeats, ``stored`` those of its candidates, in
    the order of ``order``; a request without candidates has an empty list.
    """
    own = F.struct(order.alias("_o"), F.struct(*stored).alias("c"))
    kept = candidates.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(own)), lambda x: x["c"]).alias("candidates"))
    kind = kept.schema["candidates"].dataType
    rows = requests.join(kept, key, "left").withColumn("candidates", F.coalesce("candidates", F.array().cast(kind)))
    return rows.select(key, F.size("candidates").cast("long").alias("n_candidates"), F.to_json(F.struct(*told, "candidates")).alias("evidence"))


def told_again(records: DataFrame, key: str, schema: str) -> DataFrame:
    """The candidates of stored evidence, parsed from its JSON: (key, told columns, candidate columns)."""
    rows = records.select(key, F.from_json("evidence", schema).alias("e")).select(key, "e.*")
    return rows.select(*[c for c in rows.columns if c != "candidates"], F.inline("candidates"))
