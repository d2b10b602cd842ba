"""Dealing documents into blocks, and asking shards of keys about what the blocks hold.

A block is the documents whose id hashes to it; a shard is a range of 64-bit key hashes.  Blocks send
each shard one packed row, shards merge what they get and answer each block, and the answers meet the
block's documents again.  Keys that are frequent in the corpus are sent once a block.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lynceus.operators.shared import settled as written

__all__ = ["chunks", "cuts", "dealt", "lowest", "partitions", "split", "texts_of", "written"]

#: Bytes of text in a block, at most on average: what a task holds at once, with its words and hashes.
BLOCK_BYTES = 48 << 20


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def lowest(rows: DataFrame, n: int, *keys: str) -> DataFrame:
    """At most n rows, those whose keys hash lowest; hardly more than 2 n of all reach the driver's choice."""
    total = rows.count()
    share = F.pmod(F.xxhash64(*keys), F.lit(1 << 31)) < min(1 << 31, (2 * n * (1 << 31)) // max(total, 1) + 1)
    return rows.filter(share).orderBy(F.pmod(F.xxhash64(*keys), F.lit(1 << 31)), *keys).limit(n)


def dealt(docs: DataFrame, id_col: str, text_col: str, *columns: str) -> DataFrame:
    """The named columns, dealt into blocks by a hash of id and text, so that rows of one id are spread.

    There are as many blocks as shuffle partitions, and more where they would hold over ``BLOCK_BYTES``
    of text on average.
    """
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    n = max(partitions(docs.sparkSession), -(-size // BLOCK_BYTES))
    block = F.pmod(F.xxhash64(F.col(id_col).cast("string"), text_col), F.lit(n)).cast("int")
    return docs.select(block.alias("block"), id_col, text_col, *columns).repartition(n, "block")


def cuts(shards: int) -> np.ndarray:
    """The first hash of every shard but the first."""
    return np.array([(k << 64) // shards for k in range(1, shards)], np.uint64)


def split(sorted_keys: np.ndarray, shards: int) -> list[tuple[int, int, int]]:
    """(shard, from, to) of the runs of sorted 64-bit keys that belong to each shard."""
    at = [0, *np.searchsorted(sorted_keys, cuts(shards)).tolist(), len(sorted_keys)]
    return [(k, a, b) for k, (a, b) in enumerate(zip(at, at[1:])) if b > a]


def texts_of(column, lower: bool = False) -> list[bytes]:
    """UTF-8 bytes of an Arrow string column; null is empty."""
    out = [x or b"" for x in column.cast("binary").to_pylist()]
    return [x.lower() for x in out] if lower else out


def chunks(texts: list[bytes], most: int = 1 << 20):
    """(from, to) of runs of texts with at most so many bytes, or a single longer text."""
    at = size = 0
    for k, x in enumerate(texts):
        if k > at and size + len(x) > most:
            yield at, k
            at, size = k, 0
        size += len(x) + 1
    if at < len(texts):
        yield at, len(texts)
