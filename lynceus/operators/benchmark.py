"""Match quality: recall, precision, threshold sweeps and agreement with another system."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def outcomes(cases: DataFrame, hits: DataFrame, case: str = "case_id") -> DataFrame:
    """Cases with tp, fp and fn; hits have the case and entity_id; expected_entity_id is null for no match."""
    found = hits.groupBy(case).agg(F.collect_set("entity_id").alias("found"))
    rows = cases.join(found, case, "left").withColumn("found", F.coalesce("found", F.array().cast("array<bigint>")))
    right = F.coalesce(F.array_contains("found", F.col("expected_entity_id")), F.lit(False))
    return rows.withColumns(
        {
            "tp": right.cast("int"),
            "fp": (F.size("found") - right.cast("int")),
            "fn": (F.col("expected_entity_id").isNotNull() & ~right).cast("int"),
        }
    )


def _rates(rows: DataFrame, *by: str) -> DataFrame:
    rate = lambda a, b: F.round(F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0)), 6)
    out = rows.groupBy(*by).agg(F.count("*").alias("cases"), F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return out.withColumns(
        {"recall": rate(tp, tp + fn), "precision": rate(tp, tp + fp), "f1": rate(2 * tp, 2 * tp + fp + fn), "fp_per_1000": rate(1000 * fp, F.col("cases"))}
    )


def metrics(rows: DataFrame, by: str = "case_class") -> DataFrame:
    return _rates(rows, by)


def sweep(scored: DataFrame, thresholds: list[float], score: Column | None = None) -> DataFrame:
    """Recall, precision and f1 at each threshold, from pairs with score and is_true, in one pass."""
    score = F.col("score") if score is None else score
    at = F.explode(F.array(*[F.lit(float(t)) for t in thresholds])).alias("threshold")
    hit = F.col("score") >= F.col("threshold")
    rows = scored.select(score.alias("score"), "is_true", at).select(
        "threshold", (hit & F.col("is_true")).cast("int").alias("tp"), (hit & ~F.col("is_true")).cast("int").alias("fp"), (~hit & F.col("is_true")).cast("int").alias("fn")
    )
    return _rates(rows, "threshold").drop("fp_per_1000")


def parallel_run(ours: DataFrame, theirs: DataFrame, keys: list[str]) -> DataFrame:
    """BOTH_HIT, ONLY_OURS or ONLY_THEIRS for each key that either system hit."""
    a = ours.select(*keys).distinct().withColumn("_a", F.lit(True))
    b = theirs.select(*keys).distinct().withColumn("_b", F.lit(True))
    word = F.when(F.col("_a").isNull(), "ONLY_THEIRS").when(F.col("_b").isNull(), "ONLY_OURS").otherwise("BOTH_HIT")
    return a.join(b, keys, "full_outer").withColumn("agreement", word).drop("_a", "_b")


def agreement(candidates: DataFrame, ours: Column, theirs: Column) -> DataFrame:
    """Every candidate of either system with BOTH_HIT, ONLY_OURS, ONLY_THEIRS or BOTH_CLEAR; an unknown answer is no hit."""
    a, b = F.coalesce(ours, F.lit(False)), F.coalesce(theirs, F.lit(False))
    word = F.when(a & b, "BOTH_HIT").when(a, "ONLY_OURS").when(b, "ONLY_THEIRS").otherwise("BOTH_CLEAR")
    return candidates.withColumn("agreement", word)
