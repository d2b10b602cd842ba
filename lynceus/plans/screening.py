"""Screening end to end: subjects against a list, as one plan for one subject or millions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lynceus.functions import names as NM
from lynceus.operators import blocking as B
from lynceus.operators import scoring as SC
from lynceus.operators.shared import settled


#: Columns beside id and name that scoring takes from either side, and what it calls them.
ASKED = {"entity_type": "entity_type", "dob": "dob", "country": "country"}
LISTED = {"entity_type": "listed_type", "dob": "listed_dob", "country": "listed_country", "whitelisted": "whitelisted", "status": "status"}

#: What pairs carry of their classes on either side, and what they call it.
BEARERS, LISTED_BEARERS = {"rep": "subject", "n": "n_subjects"}, {"rep": "entity", "n": "n_entities"}


def profiled(rows: DataFrame, attributes: dict[str, str], hits: DataFrame | None, name: str, rep: str, n: str) -> DataFrame:
    """The rows with their profile: normalised name, attributes, least id and number of those that have the same.

    A row whose identifier is found is a profile of its own.
    """
    alone = F.lit(None)
    rows = rows.withColumn(name, F.coalesce(NM.normalised(F.col("name")), F.lit("")))
    if hits is not None:
        rows = rows.join(hits.select(F.col(rep).alias("id"), F.lit(True).alias("_hit")).distinct(), "id", "left")
        alone = F.when(F.col("_hit"), F.col("id"))
    named = [F.col(c).alias(a) for c, a in attributes.items() if c in rows.columns]
    named = rows.select("id", name, *named, alone.alias("_alone"))
    same = Window.partitionBy(*[c for c in named.columns if c != "id"])
    return named.withColumns({rep: F.min("id").over(same), n: F.count("*").over(same)}).drop("_alone")


def identified(subject_ids: DataFrame | None, listed_ids: DataFrame | None) -> DataFrame | None:
    """(subject, entity) ids with an identifier in common; none where either side has no table of them."""
    if subject_ids is None or listed_ids is None:
        return None
    return B.by_identifier(subject_ids, listed_ids).toDF("subject", "entity")


def screen_profiles(asked: DataFrame, given: DataFrame, hits: DataFrame | None, config: dict = SC.CONFIG) -> DataFrame:
    """As screen(), for profiles of either side: names and identifiers unite, attributes adjust the score."""
    packed = lambda rows, as_: rows.drop("id").distinct().select(F.struct("*").alias(as_))
    left, right = packed(asked, "a"), packed(given, "b")
    names = lambda rows, c: rows.select(F.col(c).alias("name")).filter("name <> ''").distinct()
    found = B.candidates(names(asked, "l"), names(given, "r"))
    found = found.join(left, F.col("l") == F.col("a.l")).join(right, F.col("r") == F.col("b.r")).select("a", "b", "strategies")
    if hits is not None:
        more = hits.join(left, F.col("subject") == F.col("a.subject")).join(right, F.col("entity") == F.col("b.entity"))
        found = found.unionByName(more.select("a", "b", F.array(F.lit("identifier")).alias("strategies")))
    each = F.array_sort(F.array_distinct(F.flatten(F.collect_list("strategies")))).alias("strategies")
    pairs = found.groupBy("a", "b").agg(each).select("a.*", "b.*", "strategies")
    pairs = SC.features(pairs.withColumn("identifier_match", F.array_contains("strategies", "identifier")))
    pairs = pairs.withColumns({f: F.coalesce(f, F.lit(0.0)) for f in SC.FEATURES})  # a name may be missing
    order = Window.partitionBy("subject", "l").orderBy(F.col("score").desc(), "r", "entity")
    return SC.scored(pairs, config).withColumns({"rank": F.row_number().over(order), "config_version": F.lit(config["version"])})


def screen(
    subjects: DataFrame, listed: DataFrame, config: dict = SC.CONFIG, subject_ids: DataFrame | None = None, listed_ids: DataFrame | None = None
) -> DataFrame:
    """(l, r, subject, n_subjects, entity, n_entities, strategies, features, name_score, score, band, rank, versions).

    subjects have id, name and entity_type, listed ones id and name.  Equal normalised names are scored
    once, for the class: subject and entity are its least ids, and n_subjects and n_entities its sizes.

    Tables of identifiers (id, type, value) add the pairs that share one, whatever the names; dob and country
    of either side, and entity_type, whitelisted and status of listed ones, adjust scores.  Where any of
    these is given, equal names are one class only if their attributes are equal, too.
    """
    hits = identified(subject_ids, listed_ids)
    if hits is not None or {"dob", "country"} & set(subjects.columns) or set(LISTED) & set(listed.columns):
        asked = profiled(subjects, ASKED, hits, "l", "subject", "n_subjects")
        return screen_profiles(asked, profiled(listed, LISTED, hits, "r", "entity", "n_entities"), hits, config)
    return screen_classes(*classes(subjects, listed), None, config)


def classes(subjects: DataFrame, listed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The keyed name classes of both sides, as tables."""
    left = settled(B.keyed(B.name_classes(subjects, "id", "name", "entity_type")), "classes")
    return left, settled(B.keyed(B.name_classes(listed, "id", "name")), "classes")


def identified_classes(subjects: DataFrame, listed: DataFrame, subject_ids: DataFrame, listed_ids: DataFrame) -> DataFrame:
    """(l, r): the name classes that have bearers with an identifier in common.

    Bearers become their classes before they meet, so a value that many bear makes pairs of distinct names only.
    """

    def by_class(ids: DataFrame, rows: DataFrame) -> DataFrame:
        named = rows.select("id", NM.normalised(F.col("name")).alias("_name")).filter("_name <> ''")
        return ids.join(named, "id").select(F.col("_name").alias("id"), "type", "value")

    return B.by_identifier(by_class(subject_ids, subjects), by_class(listed_ids, listed))


def screen_classes(left: DataFrame, right: DataFrame, identified: DataFrame | None, config: dict = SC.CONFIG) -> DataFrame:
    """As screen(), of whole classes; pairs (l, r) of ``identified`` are candidates too, and strong ones."""
    pairs = B.candidates(left, right, identified, *B.compared(BEARERS | {"entity_type": "entity_type"}, LISTED_BEARERS))
    if identified is not None:
        pairs = pairs.withColumn("identifier_match", F.array_contains("strategies", "identifier"))
    rows = SC.scored(SC.features(pairs), config)
    return SC.ranked(rows, "l").withColumn("config_version", F.lit(config["version"]))


def outcome(listed_empty: bool, rows: DataFrame) -> DataFrame:
    """(l, outcome): an empty list is an ERROR for every subject, never a clear result."""
    if listed_empty:
        return rows.select("l").distinct().withColumn("outcome", F.lit("ERROR"))
    return SC.request_outcome(rows, "l")


def outcomes(
    subjects: DataFrame, listed: DataFrame, config: dict = SC.CONFIG, subject_ids: DataFrame | None = None, listed_ids: DataFrame | None = None
) -> DataFrame:
    """(id, l, outcome) for every subject: NO_MATCH without a candidate, ERROR without a usable name or without a list."""
    hits = identified(subject_ids, listed_ids)
    asked = profiled(subjects, ASKED, hits, "l", "subject", "n_subjects")
    if listed.isEmpty():
        return asked.select("id", "l", F.lit("ERROR").alias("outcome"))
    rows = screen(subjects, listed, config, subject_ids, listed_ids)
    # where screen() has classes of names alone, their least id is not that of a profile
    keys = ["l", "subject"] if "identifier_match" in rows.columns else ["l"]
    found = rows.withColumn("_of", F.struct(*keys)).transform(lambda x: SC.request_outcome(x, "_of"))
    joined = asked.withColumn("_of", F.struct(*keys)).join(found, "_of", "left")
    return joined.select("id", "l", F.when(F.col("l") == "", "ERROR").otherwise(F.coalesce("outcome", F.lit("NO_MATCH"))).alias("outcome"))


def accounted(left: DataFrame, right: DataFrame, failing: dict, most: int | None = None, config: dict = SC.CONFIG, sources: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Scored candidates of keyed classes, and (l, candidates, outcome) of every class asked.

    A class for which a strategy failed is an ERROR, with its candidates; others are as if nothing had failed.  The
    explanation also has the strategies with their outcomes, the sources consulted and the capability gaps.
    """
    asked, listed = B.compared({"rep": "subject", "entity_type": "entity_type"}, {"rep": "entity"})
    pairs, account = B.accounted(left, right, failing, most, asked=asked, listed=listed)
    account = settled(account, "accounts")
    scored = SC.scored(SC.features(pairs), config)
    rows = SC.ranked(scored.join(account.select("l", F.col("by_strategy").alias("_by"), "gaps"), "l"), "l")
    consulted = F.array(*map(F.lit, sources)).cast("array<string>")
    more = F.struct(F.col("explanation.*"), F.col("strategies"), F.col("_by").alias("strategyOutcomes"), consulted.alias("sourcesConsulted"), F.col("gaps").alias("capabilityGaps"))
    rows = rows.withColumn("explanation", more).drop("_by", "gaps")
    best = SC.request_outcome(scored, "l").withColumnRenamed("outcome", "_band")
    told = account.join(best, "l", "left").withColumn("band", F.when(F.col("outcome") == "PARTIAL", "ERROR").otherwise(F.coalesce("_band", F.lit("NO_MATCH"))))
    return rows, told.select("l", F.col("outcome").alias("candidates"), F.col("band").alias("outcome"), "found", "by_strategy", "gaps")
