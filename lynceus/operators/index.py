"""A persisted index of name keys, kept up to date by deltas, that screening joins against.

Three tables: ``keys`` has the postings of every name class (``blocking.postings``), bucketed by key, so that a
join on keys moves only what is asked (trigrams apart, which meet in cells of their own); ``classes`` has what pairs are compared by and their bearers, bucketed by
name; ``counts`` orders items from rare to common.  The order stays as it was when the index was built: any order
gives the same pairs, as long as both sides use it, and an item that came later counts as the rarest.

A delta appends the postings of new classes and tombstones of classes that nobody bears any more, each with the
version that made it; nothing is rewritten, and an older version can be read as it was.
"""

from __future__ import annotations

import uuid
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lynceus.operators import blocking as B
from lynceus.operators import scoring as SC
from lynceus.operators.shared import settled, shared_folder

#: Columns of a class that the index keeps beside its bearers.
COMPARED = ("words", "trigrams", "sounds", "codes", "turned")


class Index(NamedTuple):
    keys: DataFrame
    classes: DataFrame
    counts: DataFrame
    tombstones: DataFrame
    version: int


def bucketed(rows: DataFrame, name: str, by: str, buckets: int) -> DataFrame:
    """The rows as a table in the shared folder, bucketed and sorted by a column."""
    table = f"{name}_{uuid.uuid4().hex}"
    path = f"{shared_folder(rows.sparkSession)}/{table}"
    rows.repartition(buckets, by).write.bucketBy(buckets, by).sortBy(by).option("path", path).saveAsTable(table)
    return rows.sparkSession.table(table)


def build(rows: DataFrame, id_col: str, name_col: str, *carried: str, buckets: int | None = None) -> Index:
    """The index of the names of a population or list, as version 1; null and empty names are in no class."""
    spark = rows.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    classes = bucketed(B.keyed(B.name_classes(rows, id_col, name_col, *carried)).withColumn("version", F.lit(1)), "name_class", "name", buckets)
    counts = settled(B.item_counts(classes), "items")
    keys = bucketed(B.postings(classes, counts).withColumn("version", F.lit(1)), "name_key", "key", buckets)
    none = spark.createDataFrame([], "name string, version int")
    return Index(keys, classes, counts, none, 1)


def updated(index: Index, added: DataFrame, removed: DataFrame, id_col: str, name_col: str, *carried: str) -> Index:
    """The next version: rows added, and normalised names (name) that nobody bears any more.

    Only the delta is keyed; a class that was there already gets no second posting, and its bearers are those of
    the version that brought it.
    """
    version = index.version + 1
    gone = settled(removed.select("name").distinct().withColumn("version", F.lit(version)), "tombstones")
    tombstones = index.tombstones.unionByName(gone)
    here = live(index._replace(tombstones=tombstones)).classes.select("name")
    fresh = settled(B.name_classes(added, id_col, name_col, *carried).join(here, "name", "left_anti"), "classes")
    fresh = settled(B.keyed(fresh).withColumn("version", F.lit(version)), "classes")
    keys = settled(B.postings(fresh, index.counts).withColumn("version", F.lit(version)), "keys")
    return Index(index.keys.unionByName(keys), index.classes.unionByName(fresh), index.counts, tombstones, version)


def live(index: Index, version: int | None = None) -> Index:
    """The index without what a tombstone of a later version buries, as of a version."""
    version = index.version if version is None else version
    last = index.tombstones.filter(F.col("version") <= version).groupBy("name").agg(F.max("version").alias("buried"))

    def kept(rows: DataFrame) -> DataFrame:
        joined = rows.filter(F.col("version") <= version).join(last, "name", "left")
        return joined.filter(F.col("buried").isNull() | (F.col("version") >= F.col("buried"))).drop("buried")

    return index._replace(keys=kept(index.keys), classes=kept(index.classes), version=version)


def probed(index: Index, asked: DataFrame, listed: dict[str, str] | None = None) -> DataFrame:
    """(l, r, strategies, carried columns): the index's classes l that meet the keyed classes r of ``asked``.

    ``listed`` names the columns of ``asked`` that pairs carry, as in ``blocking.candidates``.
    """
    keys = settled(B.postings(asked, index.counts, *(listed or ())), "keys")
    return B.strategies(B.met(live(index).keys.drop("version"), keys, as_placed=True), None, listed)


def rescreened(index: Index, delta: DataFrame, id_col: str, name_col: str, config: dict = SC.CONFIG) -> DataFrame:
    """A registered population against the new and amended records of a list alone, scored.

    ``index`` is the population's, with entity_type; ``delta`` has ids and names.  The rows are those that a run
    over the whole list has of these records' names; no name of an unchanged record is read.
    """
    asked = settled(B.keyed(B.name_classes(delta, id_col, name_col)), "classes")
    own, listed = B.compared({"rep": "subject", "n": "n_subjects", "entity_type": "entity_type"}, {"rep": "entity", "n": "n_entities"})
    people = live(index).classes.select(F.col("name").alias("l"), *[F.col(c).alias(as_) for c, as_ in own.items()])
    pairs = probed(index, asked, listed).join(people, "l")
    return SC.scored(SC.features(pairs), config).withColumn("config_version", F.lit(config["version"]))


def outcomes(before: DataFrame, now: DataFrame, delisted: DataFrame) -> DataFrame:
    """(l, r, band_before, band_now, outcome) of a delta's pairs.

    ``before`` are stored candidates (l, r, band), ``now`` those of the delta, ``delisted`` the normalised names
    (name) that the list has no more.  Pairs of other names are left as they are and not looked at.
    """
    concerned = now.select(F.col("r").alias("name")).unionByName(delisted.select("name")).distinct()
    old = before.join(concerned.withColumnRenamed("name", "r"), "r", "left_semi").select("l", "r", F.col("band").alias("band_before"))
    both = old.join(now.select("l", "r", F.col("band").alias("band_now")), ["l", "r"], "full_outer")
    outcome = (
        F.when(F.col("band_before").isNull(), "NEW_HIT").when(F.col("band_now").isNull(), "RESOLVED_HIT")
        .when(F.col("band_before") == F.col("band_now"), "UNCHANGED").otherwise("CHANGED_HIT")
    )
    return both.withColumn("outcome", outcome)


