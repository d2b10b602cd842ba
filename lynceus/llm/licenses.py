"""License scans by diagonal voting (operator 4), with SQL functions only.

All rolling word k-gram hashes of the documents are joined to the template positions that have them.
A hit at document word i and template word j, verified word by word, votes for the diagonal i - j.
Votes are aggregated by diagonal, and neighbouring diagonals of a template merge into a span: those from one
diagonal on, as far as words may have been added or left out in all, so that a span is hardly longer than its
template and has its words in their order.  A span is kept when it covers enough of the template, and of spans
that share diagonals the one that covers most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

K = 2
#: Template positions that are sent to every executor, at most; more are joined by a shuffle.
SMALL = 20_000
WORD_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Short phrases, which count only where all of their words stand consecutively.
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)

#: Longer notices, of which a part with small changes counts too.
NOTICES = (
    ("permission is hereby granted free of charge to any person obtaining a copy of this software", "mit"),
    ("licensed under the apache license version 2 0 you may not use this file except in compliance", "apache"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by"),
    ("this source code form is subject to the terms of the mozilla public license", "mpl"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("boost software license version 1 0 august 17th 2003", "boost"),
    ("made available under the terms of the eclipse public license which accompanies this distribution", "epl"),
    ("has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law", "cc0"),
    ("this software is provided as is without any express or implied warranty in no event will the authors be held liable", "zlib"),
)


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased and nothing else; pure ASCII texts take the fast way."""
    plain = F.length(text) == F.octet_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words_of(text: Column) -> Column:
    """Words of digits, a-z and characters beyond ASCII; a null text has none."""
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), WORD_BREAK), lambda w: w != "")


def grams(words: Column, k: int = K) -> Column:
    """Array of (gram, parts): the hash of the k words from each place on, and those words."""

    def rolling(bound: Column) -> Column:
        h, w = bound["h"], bound["w"]
        return F.transform(
            F.slice(h, 1, F.greatest(F.size(h) - (k - 1), F.lit(0))),
            lambda x, i: F.struct(
                F.xxhash64(x, *[F.get(h, i + j) for j in range(1, k)]).alias("gram"),
                F.array(*[F.get(w, i + j) for j in range(k)]).alias("parts"),
            ),
        )

    # bound to a lambda's variable, words and their hashes are computed once
    hashed = F.transform(F.array(words), lambda w: F.struct(w.alias("w"), F.transform(w, lambda x: F.xxhash64(x)).alias("h")))
    return F.get(F.transform(hashed, rolling), F.lit(0))


def templates_table(spark: SparkSession, phrases=PHRASES, notices=NOTICES) -> DataFrame:
    """(template, label, whole, length, at, gram, parts): a row for each k-gram; whole ones count only complete."""
    rows = [(t, label, True) for t, label in phrases] + [(t, label, False) for t, label in notices]
    names = ("template", "label", "whole")
    schema = T.StructType([T.StructField(x, T.BooleanType() if x == "whole" else T.StringType()) for x in names])
    words = spark.createDataFrame(rows, schema).withColumn("words", words_of(F.col("template")))
    return words.select(*names, F.size("words").alias("length"), F.posexplode(grams(F.col("words"))).alias("at", "g")).select(
        *names, "length", "at", F.col("g.gram").alias("gram"), F.col("g.parts").alias("parts")
    )


def spans(keyed: DataFrame, templates: DataFrame, drift: int = 2, least: float = 0.6) -> DataFrame:
    """Verified spans: (doc_key, template, label, whole, share, first, last), words counted from 0.

    ``keyed`` has doc_key and text.  Every vote is verified word by word.  ``whole`` templates need all
    k-grams on one diagonal; the others need ``least`` of their k-grams on diagonals that are no more than
    ``drift``, or a quarter of the template's length, apart in all, so that words may be missing, added or changed.
    """
    rolled = keyed.select("doc_key", F.posexplode(grams(words_of(F.col("text")))).alias("pos", "g")).select(
        "doc_key", "pos", F.col("g.gram").alias("gram"), F.col("g.parts").alias("found")
    )
    longest = templates.agg(F.max("length")).first()[0] or 0
    if templates.limit(SMALL + 1).count() <= SMALL:
        templates = F.broadcast(templates)
    votes = rolled.join(templates, "gram").filter(F.col("found") == F.col("parts"))
    diagonals = votes.groupBy(
        "doc_key", "template", "label", "whole", "length", (F.col("pos") - F.col("at")).alias("diagonal")
    ).agg(F.collect_set("at").alias("ats"), F.min("pos").alias("first"), F.max("pos").alias("last"))
    most = max(drift, longest // 4)
    own = F.when(F.col("whole"), 0).otherwise(F.greatest(F.lit(drift), F.floor(F.col("length") / 4)))
    near = Window.partitionBy("doc_key", "template").orderBy("diagonal")
    ahead = F.collect_list(F.struct("diagonal", "ats", "first", "last")).over(near.rangeBetween(0, most))
    merged = diagonals.withColumn("ahead", F.filter(F.transform(ahead, lambda x: F.struct((x["diagonal"] - F.col("diagonal")).alias("off"), x.alias("d"))), lambda x: x["off"] <= own))
    of = lambda name: F.transform("ahead", lambda x: x["d"][name])
    share = F.size(F.array_distinct(F.flatten(of("ats")))) / (F.col("length") - (K - 1))
    found = merged.select(
        "doc_key", "template", "label", "whole", "diagonal", share.alias("share"), F.array_min(of("first")).cast("long").alias("first"),
        (F.array_max(of("last")) + (K - 1)).cast("long").alias("last"),
    ).filter(F.col("share") >= F.when(F.col("whole"), 1.0).otherwise(least))
    best = F.max(F.struct("share", (-F.col("diagonal")).alias("d"))).over(near.rangeBetween(-most, most))
    return found.withColumn("best", best).filter(F.col("whole") | (F.col("best.d") == -F.col("diagonal"))).drop("diagonal", "best")


def key_of(own_id: Column, text: Column) -> Column:
    """128 bits of an id and a text, of which either may be null."""
    parts = [own_id.isNull(), own_id, text.isNull(), text]
    return F.struct(F.xxhash64(*parts).alias("a"), F.xxhash64(text, own_id, F.lit(4), *parts[::2]).alias("b"))


def scan(docs: DataFrame, templates: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    The base columns tell of whole phrases, of which all places count; labels are those of all spans.
    score is the largest share of a template found (0 without a span).  A null or empty text has no
    words; rows that repeat are judged each; null ids are kept; an empty table gives an empty table.
    """
    keyed = docs.select(
        F.col(id_col), key_of(F.col(id_col), F.col(text_col)).alias("doc_key"), F.col(text_col).alias("text")
    )
    joined = lambda labels: F.array_join(F.array_sort(labels), ",")
    base = lambda x: F.when(F.col("whole"), F.col(x))
    found = spans(keyed, templates).groupBy("doc_key").agg(
        F.count(base("first")).alias("n_base"),
        F.min(base("first")).alias("first_word"),
        F.max(base("first")).alias("last_word"),
        joined(F.collect_set(base("label"))).alias("base_labels"),
        joined(F.collect_set("label")).alias("labels"),
        F.max("share").alias("score"),
    )
    return (
        keyed.select(id_col, "doc_key", F.size(words_of(F.col("text"))).cast("long").alias("n_words"))
        .join(found, "doc_key", "left")
        .select(
            id_col,
            "n_words",
            F.coalesce("n_base", F.lit(0)).alias("n_base"),
            "first_word",
            "last_word",
            F.coalesce("base_labels", F.lit("")).alias("base_labels"),
            F.coalesce("labels", F.lit("")).alias("labels"),
            F.coalesce("score", F.lit(0.0)).alias("score"),
        )
    )
