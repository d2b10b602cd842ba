"""Watchlist-shaped inputs derived from the star schema, so that their size follows the tables.

Each customer is a watched entity.  Its narrative is made of its orders: the order key picks the list
section that an order stands in, its status the verb, its date the month and year.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lynceus.functions.narrative import let
from lynceus.operators.shared import settled

#: By order key modulo 6: the header of the order's section.
HEADERS = ("UK SANCTIONS - UKHMT", "USA SANCTIONS - OFAC", "EU SANCTIONS", "CANADA", "BIOGRAPHY", "CRYPTIC HEADING")
#: By order status.
VERBS = {"F": "delisted", "O": "added to the list", "P": "amended"}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(index: Column, values: tuple[str, ...]) -> Column:
    out = F.when(index == 0, values[0])
    for k, v in enumerate(values[1:], 1):
        out = out.when(index == k, v)
    return out


def narratives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(uid, category, narrative): customers with their orders' sections, in order of order key.

    They are small to shuffle and costly to parse, so they are spread by uid over as many partitions as
    shuffles have, which adaptive execution would make one of.
    """
    orders, customers = load(spark, sf_dir, "orders"), load(spark, sf_dir, "customer")
    key = F.col("o_orderkey")
    verb = F.when(key % 7 == 0, "noted without effect")
    for status, text in VERBS.items():
        verb = verb.when(F.col("o_orderstatus") == status, text)
    piece = F.concat(
        F.lit("["), _pick(key % 6, HEADERS), F.lit("] "), F.date_format("o_orderdate", "MMM yyyy"), F.lit(" - "), verb, F.lit(". PRIMARY NAME: Holder "),
        F.element_at(F.array(*map(F.lit, NAMES)), (key % len(NAMES) + 1).cast("int")), F.lit(" DOB: 1970. SDN Ref No "), key.cast("string"), F.lit("; Passport No P"), ((key + 1) * 7919).cast("string"), F.lit(". "),
    )
    pieces = orders.select("o_custkey", F.struct("o_orderkey", piece.alias("piece")).alias("p")).groupBy("o_custkey")
    joined = pieces.agg(F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda x: x["piece"]), "").alias("orders"))
    share = F.concat(F.lit("[DIRECT SHAREHOLDER/S] Ministry of Segment (SOE) ("), (F.col("c_custkey") % 90 + 10).cast("string"), F.lit(",5%). "))
    bare = F.lit("[STATE OWNED] Holding Group (unknown percentage). ")
    owned = F.when(F.col("c_custkey") % 3 == 0, share).when(F.col("c_custkey") % 3 == 1, bare).otherwise("")
    told = customers.join(joined, F.col("c_custkey") == F.col("o_custkey"), "left").select(
        F.concat(F.lit("E"), F.col("c_custkey").cast("string")).alias("uid"),
        F.when(F.col("c_custkey") % 10 != 0, F.col("c_mktsegment")).alias("category"),
        F.concat(owned, F.coalesce("orders", F.lit(""))).alias("narrative"),
    )
    return told.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "uid")


#: Surnames of principals, by order key.
NAMES = ("Marlow", "Okafor", "Lindqvist", "Petrov", "Haddad")


def notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(uid, category, narrative): suppliers with a notice of each of three authorities, in its own layout."""
    key, n = F.col("s_suppkey"), F.element_at(F.array(*map(F.lit, NAMES)), (F.col("s_suppkey") % len(NAMES) + 1).cast("int"))
    number = lambda shift: (key + shift).cast("string")
    padded = lambda size: F.lpad(key.cast("string"), size, "0")
    text = F.concat(
        F.lit("[UK SANCTIONS - UKHMT] Name 1: Karim "), n, F.lit(" DOB: 1970. Group ID: "), number(1000), F.lit(". Regime: Counter Terrorism; Tax ID No T-"), number(1000),
        F.lit(". [USA SANCTIONS - OFAC] (f.k.a. Delta "), n, F.lit("; f.k.a. Omega "), n, F.lit(") SDN Ref No "), number(5000), F.lit("; Program SDGT; LEI 5493"), padded(16), F.lit("; SWIFT DEUTDEFF; "),
        F.lit("[EU SANCTIONS] 'Alpha "), n, F.lit("' Regulation (EU) No 269/2014; 2014/145/CFSP; Reg No R-"), number(100), F.lit("; National ID No N-"), number(1000), F.lit("; IMO 9"), padded(6),
        F.lit("; Cedula No 1"), padded(7), F.lit("; "),
    )
    rows = load(spark, sf_dir, "supplier").select(F.concat(F.lit("S"), key.cast("string")).alias("uid"), F.lit("CORPORATE").alias("category"), text.alias("narrative"))
    return rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "uid")


def name_words(text: Column) -> Column:
    """struct(a, b, c): of the whole text its first, middle and last word; empty if none."""

    def pick(w: Column) -> Column:
        word = lambda x: F.coalesce(x, F.lit(""))
        middle = F.when(F.size(w) > 2, F.get(w, ((F.size(w) - 1) / 2).cast("int")))
        last = F.when(F.size(w) > 1, F.element_at(w, -1))
        return F.struct(word(F.get(w, F.lit(0))).alias("a"), word(middle).alias("b"), word(last).alias("c"))

    return let(F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != ""), pick)


def listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, name): documents as listed names of three of their words; a table, so that texts are read once."""
    words = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), name_words(F.col("text")).alias("w"))
    return settled(words.select("id", F.array_join(F.filter(F.array("w.a", "w.b", "w.c"), lambda x: x != ""), " ").alias("name")), "listed")


def subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, name, entity_type): the same names as people write them: turned round, cut, in capitals."""
    a, b, c = (F.col(f"w.{x}") for x in "abc")
    turned = F.concat_ws(" ", c, a, b)
    cut = F.concat_ws(" ", a, b, F.left(c, F.greatest(F.length(c) - 1, F.lit(0))))
    k = F.col("id") % 4
    name = F.when(k == 0, turned).when(k == 1, cut).when(k == 2, F.upper(F.concat_ws(" ", a, b, c))).otherwise(F.concat_ws(" ", a, b))
    kind = F.when(F.col("id") % 2 == 0, "INDIVIDUAL").otherwise("ORGANISATION")
    words = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), name_words(F.col("text")).alias("w"))
    return settled(words.select("id", name.alias("name"), kind.alias("entity_type")), "subjects")
