"""Facts of narrative records, as tables.

Records have uid, category and narrative.  A record's text is cut into sections, which become rows, and
each table reads the sections whose kind has its facts: narrow plans, of which none shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lynceus.functions import narrative as N
from lynceus.functions import vocab as V

NO_CATEGORY = "(no-category)"
SECTION = ("header", "body", "start", "kind", "parser", "context")


HEADED = "array<struct<header:string,body:string,start:int,kind:string>>"


def cut(records: DataFrame) -> DataFrame:
    """uid, category, has_narrative and the array ``sections`` of headed sections.

    A null or blank category is ``(no-category)``; a null or blank narrative has no sections.
    """
    blank = F.regexp_replace(F.coalesce("category", F.lit("")), N.BLANK, "") == ""
    full = F.coalesce(F.col("narrative").rlike(r"\S"), F.lit(False))
    headed = F.filter(F.when(full, N.sections(F.col("narrative"))), lambda s: s["header"].isNotNull())
    return records.select(
        "uid",
        F.when(blank, NO_CATEGORY).otherwise(F.col("category")).alias("category"),
        full.alias("has_narrative"),
        F.coalesce(headed, F.array().cast(HEADED)).alias("sections"),
    )


def sections(records: DataFrame) -> DataFrame:
    """(uid, category, n, header, body, start, kind): every section in order, the unheaded first one too."""
    rows = records.select("uid", "category", F.posexplode(N.sections(F.col("narrative"))).alias("n", "s"))
    return rows.select("uid", "category", "n", "s.*")


def _of(records: DataFrame, *kinds: str) -> DataFrame:
    """Rows of sections with parser and context, which are columns of rows: only sections of these kinds have theirs made, where used."""
    rows = cut(records).select("uid", "category", F.inline("sections"))
    rows = rows.filter(F.col("kind").isin(*kinds)) if kinds else rows
    return rows.withColumns({"parser": N.parser_of(F.col("header")), "context": N.canonical_source(F.col("header"))})


def _dated(rows: DataFrame) -> DataFrame:
    """The rows with the ``dated`` texts of sanctions sections, and where in the body each ``starts``."""
    rows = rows.withColumn("dated", F.when(F.col("kind") == "SANCTIONS", N.dated(F.col("body"))))
    return rows.withColumn("starts", N.starts(F.split("body", V.DATE_ACTION, -1), F.col("dated")))


def _table(rows: DataFrame, facts: Column) -> DataFrame:
    """Rows of facts, with provenance as ``rule@start:end``."""
    out = rows.select("uid", "category", F.inline(facts))
    place = F.concat(F.col("rule"), F.lit("@"), F.col("start").cast("string"), F.lit(":"), F.col("end").cast("string"))
    return out.withColumn("provenance", place).drop("rule", "start", "end")


def _section() -> dict[str, Column]:
    return {name: F.col(name) for name in SECTION}


def events(records: DataFrame) -> DataFrame:
    """(uid, category, list_source, action_type, raw_verb, year, provenance)"""
    rows = _dated(_of(records, "SANCTIONS"))
    rows = rows.select("uid", "category", "context", "parser", "start", "starts", F.inline(N.usable(F.col("dated"))))
    rows = rows.withColumns({"act": N.action(F.col("v")), "year": N.year(F.col("text")), "_from": F.col("start") + F.get("starts", F.col("n"))})
    rule = F.concat_ws(".", F.col("parser"), N.action_rule(F.col("act")))
    place = F.concat(rule, F.lit("@"), F.col("_from").cast("string"), F.lit(":"), (F.col("_from") + F.length("text")).cast("string"))
    return rows.select("uid", "category", F.col("context").alias("list_source"), F.col("act.type").alias("action_type"), F.col("v").alias("raw_verb"), "year", place.alias("provenance"))


def ownership(records: DataFrame) -> DataFrame:
    """(uid, category, relation, owner, owner_type, percent, percent_stated, provenance)"""
    return _table(_of(records, "OWNERSHIP").filter(F.col("body").rlike(r"\S")), N.stakes(_section())["stakes"])


def identifiers(records: DataFrame) -> DataFrame:
    """(uid, category, type, value, context, provenance)"""
    s = _section()
    rows = _of(records, "SANCTIONS", "IDENTIFIER", "LAW_ENFORCEMENT", "REGULATORY_WARNING", "ASSET_STATUS")
    rows = rows.filter((s["kind"] != "SANCTIONS") | (s["parser"] != "GENERIC"))
    reach = s["start"] + F.least(F.length(s["body"]), F.lit(200))
    asset = F.array(
        F.struct(
            F.lit("ASSET_STATUS").alias("type"), s["header"].alias("value"), s["context"].alias("context"),
            F.lit("SECTION.ASSET_STATUS").alias("rule"), s["start"].alias("start"), reach.alias("end"),
        )
    )
    authority = F.when(s["kind"] == "SANCTIONS", s["parser"]).otherwise("")
    found = F.concat(N.identifiers(s, s["context"]), N.authority_identifiers(s, authority, s["context"]))
    return _table(rows, F.when(s["kind"] == "ASSET_STATUS", asset).otherwise(found))


def names(records: DataFrame) -> DataFrame:
    """(uid, category, name_type, value, parser, provenance)"""
    rows = _of(records, "SANCTIONS").filter(F.col("parser") != "GENERIC")
    s = _section()
    out = rows.select("uid", "category", F.inline(N.names(s, s["parser"])))
    place = F.concat(F.col("rule"), F.lit("@"), F.col("start").cast("string"), F.lit(":"), F.col("end").cast("string"))
    return out.withColumn("provenance", place).drop("rule", "start", "end")


def quarantine(records: DataFrame) -> DataFrame:
    """(uid, category, section, reason, excerpt, provenance): what no rule understood."""
    s = _section()
    reach = s["start"] + F.least(F.length(s["body"]), F.lit(200))
    unknown = F.array(N.quarantined(s["header"], F.lit("UNCLASSIFIED_SECTION"), F.left(s["body"], F.lit(200)), F.lit("SECTION.UNKNOWN"), s["start"], reach))
    unread = F.filter(N.usable(F.col("dated")), lambda m: N.action(m["v"])["type"] == "UNCLASSIFIED")

    def of_verb(m: Column) -> Column:
        start = s["start"] + F.get("starts", m["n"])
        return N.quarantined(s["header"], F.lit("UNCLASSIFIED_ACTION_VERB"), m["v"], F.concat_ws(".", s["parser"], F.lit("ACTION.UNCLASSIFIED")), start, start + F.length(m["text"]))

    verbs = F.transform(unread, of_verb)
    stakes = F.when(s["body"].rlike(r"\S"), N.stakes(s)["quarantine"])
    found = F.when(s["kind"] == "SANCTIONS", verbs).when(s["kind"] == "OWNERSHIP", stakes).otherwise(unknown)
    return _table(_dated(_of(records, "SANCTIONS", "OWNERSHIP", "UNKNOWN")), found)


def statuses(records: DataFrame) -> DataFrame:
    """A row for each record: uid, category, status, unclassified_events, rationale, per_source, list_sources, and counts.

    per_source is an array of (list_source, last_add, last_removal, unclassified, authorised, state).
    """
    sanctions = F.filter("sections", lambda s: s["kind"] == "SANCTIONS")
    listed = F.filter(sanctions, lambda s: N.is_list_source(s["header"]))
    evs = F.flatten(F.transform(sanctions, lambda s: N.let(N.canonical_source(s["header"]), lambda source: N.happened(s["body"], source))))
    rows = cut(records).select(
        "uid",
        "category",
        "has_narrative",
        evs.alias("events"),
        F.array_distinct(F.transform(listed, lambda s: N.canonical_source(s["header"]))).alias("list_sources"),
        F.size("sections").alias("sections_seen"),
        F.size(F.filter("sections", lambda s: ~s["kind"].isin("PROSE", "UNKNOWN"))).alias("sections_parsed"),
    )
    rows = rows.withColumns(
        {
            "per_source": N.source_status(F.col("events")),
            "unclassified_events": F.size(F.filter("events", lambda e: e["action_type"] == "UNCLASSIFIED")),
        }
    ).drop("events")
    per = F.col("per_source")
    count = lambda word: F.size(F.filter(per, lambda x: x["state"] == word)).cast("string")
    why = (
        F.when(F.col("status") == "NOT_SANCTIONED", "no events")
        .when(F.col("status") == "LIVE", F.concat(count("LIVE"), F.lit(" source(s) designated and not removed later")))
        .when(F.col("status") == "REMOVED_EVERYWHERE", F.concat(F.lit("removed last by all of "), count("REMOVED"), F.lit(" source(s)")))
        .otherwise("events do not tell; to be treated as live")
    )
    return rows.withColumn("status", N.record_status(per)).withColumn("rationale", why)


def strided(records: DataFrame, ordinal: str, stride: int, most: int | None = None) -> DataFrame:
    """Every stride-th record of the first ``most``; ``ordinal`` is the record's place in the feed, from 1."""
    kept = records.filter(F.col(ordinal) % stride == 0)
    return kept if most is None else kept.filter(F.col(ordinal) <= most)
