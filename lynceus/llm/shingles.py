"""Sets of hashed word shingles, and their Jaccard similarity."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import chunks, texts_of
from .words import Words, windows

SIZE, SIMILARITY, SEED = 5, 0.8, 42


def shingle_sets(texts: list[bytes], size: int = SIZE):
    """The sorted hashes of each text's shingles; a shorter text is one shingle, an empty one has none."""
    for a, b in chunks(texts):
        words = Words(texts[a:b], lower=True)
        hashes, at = windows(words.hashes(SEED), words.first, size, SEED)
        edges, n = np.searchsorted(at, words.first), np.diff(words.first)
        for i in range(b - a):
            if n[i] >= size:
                yield np.unique(hashes[edges[i] : edges[i + 1]])
            elif n[i]:
                whole = b" ".join(texts[a + i].lower().split())
                yield np.array([xxhash.xxh64_intdigest(whole, SEED)], np.uint64)
            else:
                yield np.zeros(0, np.uint64)


def node_of(shingles: np.ndarray) -> int:
    value = xxhash.xxh64_intdigest(shingles.tobytes(), SEED)
    return value - (1 << 64) if value >> 63 else value


def lists(sets: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0] + [len(x) for x in sets])
    values = np.concatenate([np.zeros(0, np.uint64), *sets]).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values))


def sets(docs: DataFrame, text_col: str, size: int) -> DataFrame:
    """(node, set) of every document."""

    def run(batches):
        for batch in batches:
            texts = texts_of(batch.column(0))
            for a, b in chunks(texts):
                found = list(shingle_sets(texts[a:b], size))
                nodes = pa.array([node_of(x) for x in found], pa.int64())
                yield pa.RecordBatch.from_arrays([nodes, lists(found)], names=["node", "set"])

    return docs.select(text_col).mapInArrow(run, "node long, set array<long>")


def similar(pairs: DataFrame, whole: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of nodes whose sets are similar."""
    side = lambda c: whole.select(F.col("node").alias(c), F.col("set").alias(c + "_set"))
    met = pairs.join(side("a"), "a").join(side("b"), "b")
    shared = F.size(F.array_intersect("a_set", "b_set"))
    return met.filter(shared >= (F.size("a_set") + F.size("b_set") - shared) * similarity - 1e-9).select("a", "b")
