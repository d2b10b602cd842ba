"""Organisation names compared by what their words say: corpus weights and a best assignment of unlike words.

A word weighs by how few of the list's names have it, legal forms, generic words and connectors a fraction of
that.  Words that both names have are matched; the others are assigned one to one so that the gain, similarity
by the lesser weight, is greatest.  A distinctive word without any like one on the other side costs a share of
the whole, so names that agree in generic words alone do not match.  Of individuals every word weighs the same
and a missing one costs nothing.

Weights and gains are whole millionths, so sums are exact in any order.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lynceus.functions import names as NM
from lynceus.operators import scoring as SC
from lynceus.operators.shared import settled

UNIT = 1_000_000
#: Words below this similarity are not like each other.
LIKE = 700_000
#: A word of this weight and more is distinctive; missing, it takes so many tenths of its weight off the score.
DISTINCTIVE, PENALTY = 500_000, 5
#: Fractions that a word's weight is divided by.
FRACTIONS = ((NM.LEGAL, 10), (NM.GENERIC, 4), (NM.CONNECTORS, 4))

WORD = "array<struct<t:string,w:bigint>>"


def corpus_weights(classes: DataFrame) -> DataFrame:
    """(t, idf): of each word of the list's name classes, from 1 for words that no name has down to 0 for those of all."""
    words = classes.select(F.explode(F.array_distinct(NM.tokens(F.col("name")))).alias("t"))
    n = classes.agg(F.count("*").cast("double").alias("n")).scalar()
    idf = F.when(n > 0, F.log((n + 1) / (F.col("df") + 1)) / F.log(n + 1)).otherwise(1.0)
    return words.groupBy("t").agg(F.count("*").alias("df")).select("t", F.floor(idf * UNIT + 0.5).cast("long").alias("idf"))


def weighed(names: DataFrame, weights: DataFrame) -> DataFrame:
    """(name, words): each name's distinct words with their weights, by word; a word that the list has not is the rarest."""
    each = names.select("name", F.explode(F.array_distinct(NM.tokens(F.col("name")))).alias("t")).join(weights, "t", "left")
    weight = F.coalesce("idf", F.lit(UNIT))
    for words, part in FRACTIONS:
        weight = F.when(F.col("t").isin(*words), F.floor(F.coalesce("idf", F.lit(UNIT)) / part)).otherwise(weight)
    return each.groupBy("name").agg(F.array_sort(F.collect_list(F.struct("t", weight.cast("long").alias("w")))).cast(WORD).alias("words"))  # one name's words


def _best(gains: list[list[int]]) -> int:
    """The greatest sum of gains with one of each row and column at most, by shortest augmenting paths."""
    if len(gains) > len(gains[0]):
        gains = [list(x) for x in zip(*gains)]
    n, m = len(gains), len(gains[0])
    row_price, column_price, held = [0] * (n + 1), [0] * (m + 1), [0] * (m + 1)
    for i in range(1, n + 1):
        held[0], j = i, 0
        least, came, done = [float("inf")] * (m + 1), [0] * (m + 1), [False] * (m + 1)
        while held[j]:
            done[j], row, step, after = True, held[j], float("inf"), 0
            for k in range(1, m + 1):
                if not done[k]:
                    cost = -gains[row - 1][k - 1] - row_price[row] - column_price[k]
                    if cost < least[k]:
                        least[k], came[k] = cost, j
                    if least[k] < step:
                        step, after = least[k], k
            for k in range(m + 1):
                if done[k]:
                    row_price[held[k]] += step
                    column_price[k] -= step
                else:
                    least[k] -= step
            j = after
        while j:
            held[j] = held[came[j]]
            j = came[j]
    return sum(gains[held[k] - 1][k - 1] for k in range(1, m + 1) if held[k])


@F.pandas_udf(T.LongType())
def best_gain(gains: pd.Series) -> pd.Series:
    """Of a matrix of gains, the sum of the best assignment; 0 without rows or columns."""
    return pd.Series([0 if g is None or not len(g) or not len(g[0]) else int(np.max(np.stack(g))) if min(len(g), len(g[0])) == 1 else _best([list(map(int, x)) for x in g]) for g in gains], dtype="int64")


def _sum(words: Column) -> Column:
    return F.aggregate(words, F.lit(0).cast("long"), lambda a, x: a + x["w"])


def _gain(x: Column, y: Column) -> Column:
    long = F.greatest(F.length(x["t"]), F.length(y["t"]))
    alike = F.floor((long - F.levenshtein(x["t"], y["t"])) * UNIT / long).cast("long")
    return F.when(alike >= LIKE, F.floor(alike * F.least(x["w"], y["w"]) / UNIT)).otherwise(F.lit(0)).cast("long")


def aligned(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (l, r, entity_type, ...) with ``alignment``, 0 to 1; ``classes`` are the list's name classes.

    Empty names have an alignment of 0.
    """
    pairs = settled(pairs, "pairs")
    names = pairs.select(F.col("l").alias("name")).unionByName(pairs.select(F.col("r").alias("name"))).distinct()
    words = settled(weighed(names, corpus_weights(classes)), "words")
    side = lambda as_: words.select(F.col("name").alias(as_), F.col("words").alias("_" + as_))
    rows = pairs.join(side("l"), "l", "left").join(side("r"), "r", "left")
    none = F.array().cast(WORD)
    same = F.col("entity_type") == "INDIVIDUAL"
    plain = lambda c: F.when(same, F.transform(c, lambda x: F.struct(x["t"].alias("t"), F.lit(UNIT).cast("long").alias("w")))).otherwise(c)
    rows = rows.withColumns({c: plain(F.coalesce(c, none)) for c in ("_l", "_r")})
    without = lambda a, b: F.filter(a, lambda x: ~F.exists(b, lambda y: x["t"] == y["t"]))
    rows = rows.withColumns({"_a": without(F.col("_l"), F.col("_r")), "_b": without(F.col("_r"), F.col("_l"))})
    rows = settled(rows.withColumn("_g", F.transform("_a", lambda x: F.transform("_b", lambda y: _gain(x, y)))), "gains")
    rows = rows.withColumn("_best", best_gain("_g"))
    both = _sum(F.col("_l")) - _sum(F.col("_a")) + F.col("_best")
    whole = _sum(F.col("_l")) + _sum(F.col("_r")) - both
    like = lambda x, others: F.exists(others, lambda y: _gain(x, y) > 0)
    alone = F.concat(F.filter("_a", lambda x: ~like(x, F.col("_b"))), F.filter("_b", lambda y: ~F.exists("_a", lambda x: _gain(x, y) > 0)))
    missing = F.coalesce(F.array_max(F.transform(alone, lambda x: x["w"])), F.lit(0))
    off = F.when(~same & (missing >= DISTINCTIVE), missing * PENALTY).otherwise(0)
    share = F.coalesce(F.try_divide(both.cast("double"), whole), F.lit(0.0))
    return rows.withColumn("alignment", F.round(share * (10 * UNIT - off) / (10 * UNIT), 6)).drop("_l", "_r", "_a", "_b", "_g", "_best")


#: As SC.CONFIG, but words of organisations count by alignment instead of Jaccard similarity.
CONFIG = SC.CONFIG | {"version": "2"}


def scored(pairs: DataFrame, classes: DataFrame, config: dict = CONFIG) -> DataFrame:
    """Pairs with features, scored with the alignment in place of the overlap of words."""
    rows = aligned(pairs, classes)
    rows = rows.withColumn("jaccard", F.when(F.col("entity_type") == "INDIVIDUAL", F.col("jaccard")).otherwise(F.col("alignment")))
    return SC.scored(rows, config).withColumn("config_version", F.lit(config["version"]))
