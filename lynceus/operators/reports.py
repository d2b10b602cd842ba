"""Reports on the facts of narrative records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lynceus.functions import narrative as N
from lynceus.functions import vocab as V
from lynceus.operators import facts as FX

PARSERS = tuple(p for p, _, _ in V.PARSERS) + ("GENERIC",)


def status_by_category(statuses: DataFrame) -> DataFrame:
    """Records of each status, and the percentage of sanctioned ones removed everywhere (0 of none)."""
    count = lambda word: F.count_if(F.col("status") == word)
    names = ("NOT_SANCTIONED", "LIVE", "REMOVED_EVERYWHERE", "INDETERMINATE")
    out = statuses.groupBy("category").agg(*[count(n).alias(n.lower()) for n in names])
    sanctioned = F.col("live") + F.col("removed_everywhere") + F.col("indeterminate")
    share = F.coalesce(F.try_divide(100.0 * F.col("removed_everywhere"), sanctioned), F.lit(0.0))
    return out.withColumn("removed_pct_of_sanctioned", F.round(share, 2))


def counts(table: DataFrame, by: str) -> DataFrame:
    """Facts of a table by one of their fields."""
    return table.groupBy(by).agg(F.count("*").alias("n"))


def unclassified_verbs(events: DataFrame) -> DataFrame:
    verbs = events.filter("action_type = 'UNCLASSIFIED'")
    return verbs.groupBy("raw_verb").agg(F.count("*").alias("occurrences"))


def list_sources(statuses: DataFrame) -> DataFrame:
    rows = statuses.select(F.explode("list_sources").alias("canonical_list_source"))
    return rows.groupBy("canonical_list_source").agg(F.count("*").alias("records"))


def parser_coverage(records: DataFrame) -> DataFrame:
    """Sections handled by each parser, those without any included, and their share in percent."""
    every = records.sparkSession.createDataFrame([(p, 0) for p in PARSERS], "parser_id string, n long")
    rows = FX.cut(records).select(F.inline("sections")).filter("kind = 'SANCTIONS'")
    found = rows.groupBy(N.parser_of(F.col("header")).alias("parser_id")).agg(F.count("*").alias("n"))
    out = every.unionByName(found).groupBy("parser_id").agg(F.sum("n").alias("sections_handled"))
    total = F.sum("sections_handled").over(Window.partitionBy())  # over one row for each parser
    share = F.coalesce(F.try_divide(100.0 * F.col("sections_handled"), total), F.lit(0.0))
    return out.withColumn("share_pct", F.round(share, 2))


def ownership_totals(stakes: DataFrame) -> DataFrame:
    return stakes.agg(
        F.count("*").alias("stakes"),
        F.count_if("percent_stated").alias("with_percent"),
        F.count_if(~F.col("percent_stated")).alias("without_percent"),
    )


def summary(statuses: DataFrame) -> DataFrame:
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return statuses.agg(
        F.count("*").alias("records"),
        F.count_if("has_narrative").alias("with_narrative"),
        total("sections_seen"),
        total("sections_parsed"),
    )
