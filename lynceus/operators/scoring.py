"""Explainable scoring: weighted name features, attribute effects, bands, and a score that can be redone.

Attributes adjust a score and never remove a candidate; missing ones are neutral.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lynceus.functions import names as NM
from lynceus.operators.shared import once

FEATURES = ("jaro_winkler", "jaccard", "phonetic", "edit", "ngram")
#: A configuration version: weights by entity type, thresholds and effects.
CONFIG = {
    "version": "1",
    "weights": {"INDIVIDUAL": (0.30, 0.20, 0.25, 0.15, 0.10), "ORGANISATION": (0.25, 0.30, 0.10, 0.15, 0.20)},
    "possible": 75.0,
    "strong": 92.0,
    "dob_exact": 10.0,
    "dob_year": 5.0,
    "dob_conflict": -15.0,
    "dob_tolerance_years": 1,
    "country_match": 5.0,
    "country_conflict": -5.0,
    "type_mismatch": -10.0,
    "list_source": {},
    "whitelist": -20.0,
    "removed_everywhere": -10.0,
    "max_candidates": 50,
}


#: What is compared of a class, as ``blocking.keyed`` makes it; pairs may carry it with l_ and r_ before the name.
COMPARED = ("words", "codes", "trigrams", "turned")


def features(pairs: DataFrame) -> DataFrame:
    """Pairs (l, r) of normalised names with the five features, rounded to 6 digits.

    What pairs carry of their classes (``COMPARED``) is taken from there, and left out of the result.
    """
    own = {"words": lambda c: F.array_distinct(NM.tokens(c)), "codes": NM.phonetic, "trigrams": NM.trigrams, "turned": NM.sorted_tokens}
    carried = {f"{side}_{c}" for side in "lr" for c in COMPARED} & set(pairs.columns)
    both = lambda c: [F.col(f"{side}_{c}") if {f"l_{c}", f"r_{c}"} <= carried else own[c](F.col(side)) for side in "lr"]
    value = {
        "jaccard": NM.set_jaccard(*both("words")),
        "phonetic": NM.set_jaccard(*both("codes")),
        "edit": NM.edit_ratio(F.col("l"), F.col("r")),
        "ngram": NM.dice(*both("trigrams")),
    }
    rows = pairs.withColumns({k: F.round(v, 6) for k, v in value.items()})
    # it takes one of the others, so that all these are made below it, once, whatever filters on the score do
    return rows.withColumn("jaro_winkler", F.round(NM.jaro_winkler_of(*both("turned"), F.col("edit")), 6)).drop(*carried)


def weights(kind: Column, config: dict = CONFIG) -> Column:
    """The weights of an entity type; other than individuals count as organisations."""
    lits = lambda name: F.array(*map(F.lit, config["weights"][name]))
    return F.when(kind == "INDIVIDUAL", lits("INDIVIDUAL")).otherwise(lits("ORGANISATION"))


def name_score(values: Column, w: Column) -> Column:
    """Sum of weight by feature over the sum of weights, from 0 to 1, to 6 digits."""
    places = range(len(FEATURES))
    return _weighed([values[k] for k in places], [F.rint(w[k] * 10_000) for k in places])


def _weighed(values: list[Column], weight: list[Column]) -> Column:
    """Features have 6 digits and weights at most 4: sums of whole numbers are exact, and a tie rounds up wherever it is computed."""
    total = reduce(add, [F.rint(v * 1_000_000) * w for v, w in zip(values, weight)])
    whole = reduce(add, weight)
    return F.floor(total / whole + 0.5) / 1_000_000


def _of_kind(kind: Column, config: dict) -> Column:
    """The name score by the weights of an entity type, as ``weights`` has them."""
    own = {name: _weighed([F.col(f) for f in FEATURES], [F.lit(round(x * 10_000.0)) for x in w]) for name, w in config["weights"].items()}
    return F.when(kind == "INDIVIDUAL", own["INDIVIDUAL"]).otherwise(own["ORGANISATION"])


def dob_effect(asked: Column, listed: Column, config: dict = CONFIG) -> Column:
    near = F.abs(F.year(asked) - F.year(listed)) <= config["dob_tolerance_years"]
    known = asked.isNotNull() & listed.isNotNull()
    return (
        F.when(~known, 0.0).when(asked == listed, config["dob_exact"]).when(F.year(asked) == F.year(listed), config["dob_year"])
        .when(near, 0.0).otherwise(config["dob_conflict"])
    )


def match_effect(asked: Column, listed: Column, same: float, other: float) -> Column:
    return F.when(asked.isNull() | listed.isNull(), 0.0).when(asked == listed, same).otherwise(other)


def list_source_effect(source: Column, config: dict = CONFIG) -> Column:
    """What the configuration gives a list source; 0 for one that it does not name."""
    out = F.lit(0.0)
    for name, effect in config["list_source"].items():
        out = F.when(source == name, float(effect)).otherwise(out)
    return out


#: Slots that each effect compares.
NEEDS = {"dob": "DATE_OF_BIRTH", "country": "COUNTRY", "type": "ENTITY_TYPE", "list_source": "LIST_SOURCE", "removed": "STATUS"}


def validated(config: dict, slots: set[str]) -> dict:
    """The configuration, if it can be applied to a source with the slots; else an error at start-up.

    Weights of a type sum to one, thresholds are in order, and no effect other than 0 asks for a slot that
    the source has not.
    """
    for kind, own in config["weights"].items():
        if len(own) != len(FEATURES) or abs(sum(own) - 1) > 1e-9 or min(own) < 0:
            raise ValueError(f"weights of {kind} are not {len(FEATURES)} shares of one")
    if not 0 <= config["possible"] <= config["strong"] <= 100:
        raise ValueError("thresholds are out of order")
    for name, effect in config.items():
        slot = next((s for prefix, s in NEEDS.items() if name.startswith(prefix)), None)
        if slot and slot not in slots and effect:
            raise ValueError(f"{name} needs the slot {slot}, which the source has not")
    return config


def composite(name: Column, effect: Column, identifier_match: Column, config: dict = CONFIG) -> Column:
    """The clamped sum of the name's score and all effects; an exact identifier lifts it to the strong threshold at least."""
    total = F.greatest(F.lit(0.0), F.least(F.lit(100.0), name * 100 + effect))
    return F.when(identifier_match, F.greatest(total, F.lit(config["strong"]))).otherwise(total)


def band(score: Column, complete: Column | None = None, config: dict = CONFIG) -> Column:
    """NO_MATCH, POSSIBLE or STRONG; ERROR where the candidates were not complete or there is no score."""
    failed = score.isNull() if complete is None else score.isNull() | ~complete
    return F.when(failed, "ERROR").when(score >= config["strong"], "STRONG").when(score >= config["possible"], "POSSIBLE").otherwise("NO_MATCH")


def scored(pairs: DataFrame, config: dict = CONFIG) -> DataFrame:
    """Candidates with score, band and explanation.

    Needs l, r, entity_type and the features; takes dob, listed_dob, country, listed_country, listed_type,
    list_source, identifier_match, whitelisted, status and complete where the columns exist.  Where ``complete``
    is false, as some strategy or page failed, the band is ERROR whatever the score.
    """
    has = lambda c: F.col(c) if c in pairs.columns else F.lit(None)
    yes = lambda c: F.coalesce(has(c).cast("boolean"), F.lit(False))
    date = lambda c: has(c).cast("date")
    effects = {
        "DOB": dob_effect(date("dob"), date("listed_dob"), config),
        "COUNTRY": match_effect(has("country").cast("string"), has("listed_country").cast("string"), config["country_match"], config["country_conflict"]),
        "ENTITY_TYPE": match_effect(F.col("entity_type"), has("listed_type").cast("string"), 0.0, config["type_mismatch"]),
        "LIST_SOURCE": list_source_effect(has("list_source").cast("string"), config),
        "WHITELIST": F.when(yes("whitelisted"), config["whitelist"]).otherwise(0.0),
        "STATUS": F.when(F.coalesce(has("status").cast("string") == "REMOVED_EVERYWHERE", F.lit(False)), config["removed_everywhere"]).otherwise(0.0),
    }
    structs = F.array(*[F.struct(F.lit(k).alias("reason"), v.alias("effect")) for k, v in effects.items()])
    rows = pairs.withColumns({"_w": weights(F.col("entity_type"), config), "_v": F.array(*FEATURES), "_e": structs})
    rows = rows.withColumn("name_score", once(_of_kind(F.col("entity_type"), config)))
    rows = rows.withColumn("score", F.round(composite(F.col("name_score"), reduce(add, effects.values(), F.lit(0.0)), yes("identifier_match"), config), 4))
    explanation = F.struct(
        F.lit(config["version"]).alias("config_version"),
        F.array(*map(F.lit, FEATURES)).alias("features"),
        F.col("_v").alias("values"),
        F.col("_w").alias("weights"),
        F.col("_e").alias("effects"),
        yes("identifier_match").alias("identifier_match"),
    )
    complete = F.coalesce(F.col("complete"), F.lit(False)) if "complete" in pairs.columns else None
    return rows.withColumns({"band": band(F.col("score"), complete, config), "explanation": explanation}).drop("_w", "_v", "_e")


def recomputed(explanation: Column, config: dict = CONFIG) -> Column:
    """The score again, from its explanation alone."""
    name = name_score(explanation["values"], explanation["weights"])
    effect = F.aggregate(explanation["effects"], F.lit(0.0), lambda a, e: a + e["effect"])
    return F.round(composite(name, effect, explanation["identifier_match"], config), 4)


def ranked(rows: DataFrame, subject: str, most: int | None = None) -> DataFrame:
    """Candidates of each subject by falling score, ties by name; at most so many."""
    order = Window.partitionBy(subject).orderBy(F.col("score").desc(), "r")
    out = rows.withColumn("rank", F.row_number().over(order))
    return out if most is None else out.filter(F.col("rank") <= most)


def paged(rows: DataFrame, subject: str, size: int) -> DataFrame:
    """Ranked candidates with their page, from 1, and the number of pages that their subject has."""
    page = (F.floor((F.col("rank") - 1) / size) + 1).cast("int")
    return rows.withColumn("page", page).withColumn("pages", F.max("page").over(Window.partitionBy(subject)))


def request_outcome(rows: DataFrame, subject: str) -> DataFrame:
    """(subject, outcome): the gravest band, ERROR above all."""
    grave = F.when(F.col("band") == "ERROR", 3).when(F.col("band") == "STRONG", 2).when(F.col("band") == "POSSIBLE", 1).otherwise(0)
    bands = F.array(*map(F.lit, ("NO_MATCH", "POSSIBLE", "STRONG", "ERROR")))
    # a number is combined before the shuffle without sorting the candidates
    return rows.groupBy(subject).agg(F.max(grave).alias("_grave")).select(subject, F.get(bands, F.col("_grave")).alias("outcome"))


def alerts(rows: DataFrame, threshold: float = CONFIG["possible"]) -> DataFrame:
    """Candidates that open an alert; the others stay in the evidence."""
    return rows.filter((F.col("score") >= threshold) | (F.col("band") == "ERROR")).withColumn("alert_status", F.lit("OPEN"))
