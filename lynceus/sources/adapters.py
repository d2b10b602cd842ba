"""From source records to canonical ones, by code or by binding rows; profiling; fact sinks."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLOTS = (
    "PRIMARY_NAME", "ALIAS", "ENTITY_TYPE", "GENDER", "DATE_OF_BIRTH", "COUNTRY", "ADDRESS", "IDENTIFIER", "LIST_SOURCE",
    "STATUS", "DESIGNATION_DATE", "OWNERSHIP",
)
#: What a binding may do with a value; no conditions.
TRANSFORMS = {
    "TRIM": lambda c, _: F.trim(c),
    "UPPER": lambda c, _: F.upper(c),
    "RENAME": lambda c, _: c,
    "SPLIT": lambda c, arg: F.split(c, arg),
    "CONSTANT": lambda _, arg: F.lit(arg),
}


def entity_type(kind: Column, category: Column) -> Column:
    """From the feed's e-i flag and category."""
    return (
        F.when(category.isin("VESSEL", "AIRCRAFT"), category).when(kind == "E", "ORGANISATION")
        .when(kind.isin("M", "F", "U"), "INDIVIDUAL").otherwise("ORGANISATION")
    )


def feed_to_canonical(feed: DataFrame) -> DataFrame:
    """Canonical slots of feed records; an organisation's name is all in last_name; nil is absent."""
    names = F.col("person.names")
    return feed.select(
        F.col("_uid").alias("uid"),
        F.nullif(F.concat_ws(" ", F.nullif(names["first_name"], F.lit("")), names["last_name"]), F.lit("")).alias("PRIMARY_NAME"),
        names["aliases"]["alias"].alias("ALIAS"),
        entity_type(F.col("_e-i"), F.col("_category")).alias("ENTITY_TYPE"),
        F.when(F.col("_e-i").isin("M", "F"), F.col("_e-i")).alias("GENDER"),
        F.when(~F.coalesce(F.col("person.dob._nil"), F.lit(False)), F.nullif(F.col("person.dob._VALUE"), F.lit(""))).alias("DATE_OF_BIRTH"),
    )


def mapped(rows: DataFrame, bindings: list[tuple[str, str | None, str, str | None]]) -> DataFrame:
    """Slots by (slot, source column, transform, argument); an unknown slot or transform is an error."""
    out = []
    for slot, source, transform, argument in bindings:
        if slot not in SLOTS or transform not in TRANSFORMS:
            raise ValueError(f"cannot bind {slot} by {transform}")
        out.append(TRANSFORMS[transform](F.col(source) if source else F.lit(None), argument).alias(slot))
    return rows.select(*out)


@dataclass(frozen=True)
class Adapter:
    """A source's way to canonical records, the slots that it must fill, and the coverage that is expected of it."""

    to_canonical: Callable[[DataFrame], DataFrame]
    required: tuple[str, ...] = ("PRIMARY_NAME",)
    expectation: tuple[tuple[str, float], ...] = ()


#: Adapters by the name of their source; ``bound`` makes others from binding rows.
ADAPTERS: dict[str, Adapter] = {"FEED": Adapter(feed_to_canonical, ("PRIMARY_NAME", "ENTITY_TYPE"), (("PRIMARY_NAME", 1.0), ("ENTITY_TYPE", 1.0)))}


def bound(bindings: list[tuple[str, str | None, str, str | None]], expectation: tuple[tuple[str, float], ...] = ()) -> Adapter:
    """An adapter by binding rows; it must fill the slots that they bind from columns."""
    return Adapter(lambda rows: mapped(rows, bindings), tuple(slot for slot, source, _, _ in bindings if source), expectation)


def registered(name: str, adapter: Adapter) -> Adapter:
    """Adds an adapter; a name is given once."""
    if name in ADAPTERS and ADAPTERS[name] is not adapter:
        raise ValueError(f"there is an adapter for {name!r} already")
    ADAPTERS[name] = adapter
    return adapter


def canonical(sources: dict[str, tuple[Adapter, DataFrame]]) -> DataFrame:
    """All sources' canonical records under one another, each with its name as LIST_SOURCE; absent slots are null.

    A source that lacks a slot which its adapter requires is an error before anything is read.
    """
    out = None
    for name, (adapter, rows) in sources.items():
        made = adapter.to_canonical(rows)
        if missing := set(adapter.required) - set(made.columns):
            raise ValueError(f"{name} lacks {', '.join(sorted(missing))}")
        made = made.withColumn("LIST_SOURCE", F.lit(name))
        out = made if out is None else out.unionByName(made, allowMissingColumns=True)
    return out


def mapping_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Bindings (slot, source, transform) by slot in two versions, and what happened to each."""
    a, b = old.select("slot", F.struct("source", "transform").alias("old")), new.select("slot", F.struct("source", "transform").alias("new"))
    word = F.when(F.col("old").isNull(), "ADDED").when(F.col("new").isNull(), "REMOVED").when(F.col("old").eqNullSafe(F.col("new")), "SAME").otherwise("CHANGED")
    return a.join(b, "slot", "full_outer").withColumn("change", word)


def profile(rows: DataFrame, approximate: bool = True) -> DataFrame:
    """(path, coverage, distinct, sample): of every column, in one pass."""
    count = F.approx_count_distinct if approximate else F.count_distinct
    stats = lambda c: F.struct(F.round(F.avg(F.col(c).isNotNull().cast("int")), 6).alias("coverage"), count(F.col(c)).alias("distinct"), F.min(F.col(c).cast("string")).alias("sample"))
    one = rows.agg(*[stats(c).alias(c) for c in rows.columns])
    return one.unpivot([], rows.columns, "path", "s").select("path", "s.*")


def write_tsv(rows: DataFrame, path: str, order: list[str], most: int | None = 200_000) -> None:
    """A fact table as tab-separated text with a header, by a total order; tabs and line ends are blanks.

    Of a table with more than ``most`` rows the first ones stand in one file, which ends in a trailer line
    that says so; ``most=None`` writes all rows, as many files with a header each.
    """
    text = lambda c: F.coalesce(F.regexp_replace(F.col(c).cast("string"), r"[\t\r\n]", " "), F.lit(""))
    if most is None:
        rows.orderBy(*order).select(*[text(c).alias(c) for c in rows.columns]).write.csv(path, sep="\t", header=True, mode="overwrite", quote="")
        return
    spark, total = rows.sparkSession, rows.count()
    lines = rows.orderBy(*order).limit(most).select(F.concat_ws("\t", *[text(c) for c in rows.columns]).alias("value"))
    around = lambda x: spark.createDataFrame([(x,)], "value string")
    lines = around("\t".join(rows.columns)).unionAll(lines)
    if total > most:
        lines = lines.unionAll(around(f"# CAPPED {most} of {total}"))
    lines.coalesce(1).write.mode("overwrite").text(path)
