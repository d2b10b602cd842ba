"""Trigram sets that meet on one of their rare items, compared a block of pairs at a time.

There are few trigrams, so a name meets thousands that it hardly resembles.  Spark brings those which share an item
together in cells of bounded size; within a cell, sizes and places, then bits that the items fall on, then the items
themselves tell which pairs are similar, each step as one operation on arrays.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lynceus.operators.shared import settled

#: Rows of one key and side that are in one cell at most; a key with more has a cell for every two of its blocks.
BLOCK = 32_768
#: Rows of rarer keys that a cell has, about.
CELL = 20_000
#: Pairs that are looked at in one step, and those whose items are compared in one.
STEP, EXACT = 1 << 20, 1 << 14
#: Words of 64 bits that a set's items fall on.
WORDS = 4


def met(asked: DataFrame, listed: DataFrame, threshold: float) -> DataFrame:
    """(l, r, type, sound, grams and own of either side): pairs of trigram postings by Dice similarity, each once.

    Both sides are read twice: give tables.
    """
    schema = T.StructType([T.StructField("l", T.StringType()), T.StructField("r", T.StringType()), T.StructField("type", T.StringType())])
    for column, of in (("sound", "sound"), ("grams", "set"), ("own", "own")):
        for side, rows in (("l", asked), ("r", listed)):
            schema = schema.add(f"{side}_{column}", rows.schema[of].dataType)
    n = lambda rows, as_: rows.groupBy("key").agg(F.count("*").alias(as_))
    blocks = lambda c: F.ceil(F.col(c) / BLOCK).cast("int").alias(c)
    counted = settled(n(asked, "_l").join(n(listed, "_r"), "key"), "counted")
    rows = counted.agg(F.sum(F.col("_l") + F.col("_r"))).first()[0] or 0
    hot = settled(counted.filter((F.col("_l") > BLOCK) | (F.col("_r") > BLOCK)).select("key", blocks("_l"), blocks("_r")), "hot")
    cells = F.pmod("key", F.lit(rows // CELL + 1))

    def celled(side: DataFrame, mine: str, others: str, spread: bool) -> DataFrame:
        side = side.select(*[F.col(c).alias(c) for c in ("key", "name", "size", "place", "set", "sound", "own")])  # either side may come of one table
        if not spread:
            return side.withColumns({"_cell": cells, "_at": F.lit(0)})
        rare = side.join(hot, "key", "left_anti").withColumns({"_cell": cells, "_at": F.lit(0)})
        block, each = F.pmod(F.xxhash64("name"), F.col(mine)).cast("int"), F.explode(F.sequence(F.lit(0), F.col(others) - 1))
        often = side.join(hot, "key").withColumns({"_mine": block, "_other": each})
        x, y = ("_mine", "_other") if mine == "_l" else ("_other", "_mine")
        at = (F.col(x) * F.col("_r") + F.col(y) + 1).cast("int")
        return rare.unionByName(often.withColumns({"_cell": F.col("key"), "_at": at}).drop("_l", "_r", "_mine", "_other"))

    spread = not hot.isEmpty()
    parts = int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cell = lambda *side: celled(*side, spread).repartition(parts, "_cell", "_at").groupBy("_cell", "_at")
    compare = lambda left, right: _similar(left, right, threshold)
    return cell(asked, "_l", "_r").cogroup(cell(listed, "_r", "_l")).applyInArrow(compare, schema)


class _Side:
    """A side of a cell by key: sizes, places, items in a matrix, and the bits they fall on."""

    def __init__(self, rows: pa.Table, threshold: float, nothing: int):
        order = np.argsort(rows["key"].to_numpy(), kind="stable")
        self.rows = rows.take(pa.array(order)).combine_chunks()
        self.keys, self.start, self.count = np.unique(self.rows["key"].to_numpy(), return_index=True, return_counts=True)
        self.size, self.place = (self.rows[c].to_numpy().astype(np.int64) for c in ("size", "place"))
        flat = pa.concat_arrays(self.rows["set"].chunks).flatten().to_numpy()
        self.items = np.full((len(order), int(self.size.max())), nothing, np.int64)
        self.items[np.arange(self.items.shape[1]) < self.size[:, None]] = flat
        self.bits = np.zeros((WORDS, len(order)), np.uint64)
        for k in range(self.items.shape[1]):
            some = np.nonzero(self.size > k)[0]
            item = self.items[some, k].view(np.uint64)
            self.bits[(item >> np.uint64(6)) % np.uint64(WORDS), some] |= np.uint64(1) << (item & np.uint64(63))
        self.any = np.bitwise_or.reduce(self.bits)
        self.half = self.size * (threshold / 2)
        self.most = self.size - self.place - self.half + 1e-9


def _similar(left: pa.Table, right: pa.Table, threshold: float) -> pa.Table:
    found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    if len(left) and len(right):
        x, y = _Side(left, threshold, 0), _Side(right, threshold, 1)
        left, right = x.rows, y.rows
        _, i, j = np.intersect1d(x.keys, y.keys, assume_unique=True, return_indices=True)
        waiting, held = ([], []), 0
        for a, n, b, m in zip(x.start[i], x.count[i], y.start[j], y.count[j]):
            step = max(1, STEP // m)
            for k in range(a, a + n, step):
                p, q = _alike(x, y, k, min(k + step, a + n), b, b + m)
                waiting[0].append(p), waiting[1].append(q)
                held += len(p)
                if held >= EXACT:
                    _verified(x, y, waiting, threshold, found)
                    waiting, held = ([], []), 0
        if held:
            _verified(x, y, waiting, threshold, found)
    p, q = (pa.array(np.concatenate(z)) for z in found)
    l, r = left.take(p), right.take(q)
    columns = {"l": l["name"], "r": r["name"], "type": pa.array(["trigram"] * len(p), pa.string())}
    columns |= {f"{s}_{c}": z[of] for c, of in (("sound", "sound"), ("grams", "set"), ("own", "own")) for s, z in (("l", l), ("r", r))}
    return pa.table(columns)


def _alike(x: _Side, y: _Side, a: int, b: int, c: int, d: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the pairs of rows a to b and c to d those that sizes, places and bits do not exclude."""
    p, q = np.nonzero((x.most[a:b, None] >= y.half[None, c:d]) & (x.half[a:b, None] <= y.most[None, c:d]))
    p, q = p + a, q + c
    for bits in (lambda s, at: s.any[at][None], lambda s, at: s.bits[:, at]):
        f, g = bits(x, p), bits(y, q)
        least = x.half[p] + y.half[q] - 1e-9
        alone = lambda u, v: np.bitwise_count(u & ~v).sum(axis=0, dtype=np.int64)
        kept = (x.size[p] - alone(f, g) >= least) & (y.size[q] - alone(g, f) >= least)
        p, q = p[kept], q[kept]
    return p, q


def _verified(x: _Side, y: _Side, waiting: tuple[list, list], threshold: float, found: tuple[list, list]) -> None:
    """Adds the pairs that are similar, where they share no item before the one that they met on."""
    p, q = (np.concatenate(z) for z in waiting)
    order = np.argsort(x.size[p] + y.size[q])
    for k in range(0, len(order), EXACT):
        i, j = p[order[k : k + EXACT]], q[order[k : k + EXACT]]
        for first in (True, False):
            if not len(i):
                break
            m, n = (x.place[i], y.place[j]) if first else (x.size[i], y.size[j])
            u, v = x.items[i, : int(m.max())], y.items[j, : int(n.max())]
            u = np.where(np.arange(u.shape[1]) < m[:, None], u, 0)
            v = np.where(np.arange(v.shape[1]) < n[:, None], v, 1)
            common = np.zeros(len(i), np.int64)
            for c in range(v.shape[1]):
                common += (u == v[:, c, None]).any(axis=1)
            kept = common == 0 if first else common >= x.half[i] + y.half[j] - 1e-9
            i, j = i[kept], j[kept]
        found[0].append(i), found[1].append(j)
