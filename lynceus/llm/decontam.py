"""Benchmark decontamination by greedy string tiling (operator 1).

A document and a benchmark item become a pair where they share a seed: ``tile`` words in a row.  The
seeds' hashes are joined on Spark: a bit map of fixed size over the items' seeds is sent to the documents'
one scan, which keeps the documents that have a seed in it, and only their seeds meet the items'.  A pair
goes on if its shared seeds could cover enough of the item.

In each pair running Karp-Rabin finds the maximal matches, as stretches on a diagonal and never as a list
of places, and the longest match whose words are unmarked on both sides is marked, again and again, until
none of ``tile`` words is left.  The share of the item's words that are marked decides, so an item whose
sentences stand in another order is still found.
"""

from __future__ import annotations

import hashlib
import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import chunks, texts_of, written
from .simhash import SALTS, spread_join
from .words import Words, mix, windows

TILE, COVERAGE = 5, 0.5
#: Bits of the map of the items' seeds (8 MB, whatever the benchmark's size); a seed sets two of them.
MAP_BITS = 26

#: A-Z to a-z, and ASCII other than letters and digits to spaces.
PLAIN = bytes(b + 32 if 65 <= b < 91 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
TILES = T.ArrayType(T.StructType([T.StructField(x, T.IntegerType()) for x in ("text_word", "item_word", "length")]))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(PLAIN).split()


# ---------------------------------------------------------------- a pair


def _rolling(ids: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all windows of so many ids."""
    n = len(ids) - size + 1
    out = np.zeros(max(n, 0), np.uint64)
    for k in range(size):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + ids[k : k + n].astype(np.uint64))
    return out


def matches(text: np.ndarray, item: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text place, item place, length) of all maximal matches of ``size`` words or more.

    A seed begins a match where the seeds one word before it differ, and ends one where those after it do.
    Which places of the text do so depends on two seeds of the item alone, and is found once for each two.
    """
    ours, theirs = _rolling(text, size), _rolling(item, size)
    if not len(ours) or not len(theirs):
        return (np.zeros(0, np.int64),) * 3
    order = np.argsort(ours, kind="stable")
    low, high = (np.searchsorted(ours[order], theirs, side) for side in ("left", "right"))
    found: dict[tuple, np.ndarray] = {}

    def edges(q: int, step: int) -> np.ndarray:
        beside = q + step
        inside = 0 <= beside < len(theirs)
        key = (theirs[q], theirs[beside] if inside else None, step)
        if key not in found:
            at = order[low[q] : high[q]]
            if inside:
                near = at + step
                same = (near >= 0) & (near < len(ours))
                same[same] = ours[near[same]] == theirs[beside]
                at = at[~same]
            found[key] = at
        return found[key]

    def places(step: int) -> tuple[np.ndarray, np.ndarray]:
        some = [(q, edges(q, step)) for q in np.flatnonzero(high > low).tolist()]
        p = np.concatenate([np.zeros(0, np.int64), *[x for _, x in some]])
        q = np.repeat(np.array([q for q, _ in some], np.int64), [len(x) for _, x in some])
        by = np.lexsort((p, p - q))
        return p[by], q[by]

    (p, q), (last, _) = places(-1), places(1)
    return p, q, last - p + size


def tiles(text: np.ndarray, item: np.ndarray, size: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling of two sequences of positive ids: (text place, item place, length), in order.

    The longest match goes first (ties: the earlier in the text, then in the item).
    """
    heap = [(-n, p, q) for p, q, n in zip(*(x.tolist() for x in matches(text, item, size)))]
    heapq.heapify(heap)
    free_text, free_item = np.ones(len(text), bool), np.ones(len(item), bool)
    out, left = [], len(item)
    while heap and left >= size:
        n, p, q = heapq.heappop(heap)
        free = free_text[p : p - n] & free_item[q : q - n] & (text[p : p - n] == item[q : q - n])
        if free.all():
            out.append((p, q, -n))
            free_text[p : p - n] = free_item[q : q - n] = False
            left += n
            continue
        edge = np.flatnonzero(np.diff(np.concatenate(([False], free, [False])).astype(np.int8)))
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):  # what is left of it, if long enough, is a match again
            if b - a >= size:
                heapq.heappush(heap, (a - b, p + a, q + a))
    return sorted(out)


def tiled(text: bytes, item: bytes, tile: int) -> list[tuple[int, int, int]]:
    theirs = words_of(item)
    ids: dict[bytes, int] = {}
    b = np.array([ids.setdefault(w, len(ids) + 1) for w in theirs], np.int64)
    a = np.array([ids.get(w, 0) for w in words_of(text)], np.int64)
    return tiles(a, b, min(tile, len(theirs)))


# ---------------------------------------------------------------- all pairs


def _md5(text: bytes) -> str:
    return hashlib.md5(text).hexdigest()


def _seeds(texts: list[bytes], size: int):
    """(text index, seeds) of texts with so many words or more."""
    for a, b in chunks(texts):
        w = Words([x.translate(PLAIN) for x in texts[a:b]])
        keys, at = windows(w.hashes(6), w.first, size, 6)
        bounds = np.searchsorted(at, w.first).tolist()
        yield from ((a + k, keys[i:j]) for k, (i, j) in enumerate(zip(bounds, bounds[1:])) if j > i)


def _probes(seeds: np.ndarray) -> np.ndarray:
    return np.concatenate([seeds, mix(seeds)]) >> np.uint64(64 - MAP_BITS)


def _item_seeds(items: DataFrame, text_col: str, tile: int) -> DataFrame:
    """(item, h, size, n, places): the distinct seeds of distinct texts; ``item`` is a digest of the text."""

    def run(batches):
        for batch in batches:
            texts = sorted(set(texts_of(batch.column(0))))
            sizes = [min(tile, len(words_of(x))) for x in texts]
            for size in sorted(set(sizes) - {0}):
                own = [x for x, n in zip(texts, sizes) if n == size]
                for k, seeds in _seeds(own, size):
                    h, places = np.unique(seeds, return_counts=True)
                    n = len(h)
                    whole = len(seeds) + size - 1
                    columns = [pa.array([_md5(own[k])] * n), pa.array(h.view(np.int64)), pa.array([size] * n, pa.int32()), pa.array([whole] * n, pa.int64()), pa.array(places.astype(np.int64))]
                    yield pa.RecordBatch.from_arrays(columns, names=["item", "h", "size", "n", "places"])

    found = items.select(text_col).mapInArrow(run, "item string, h long, size int, n long, places long")
    return found.dropDuplicates(["item", "h"])


def _map_of(seeds: DataFrame) -> np.ndarray:
    """The bit map, combined by words of 64 bits before they reach the driver."""

    def run(batches):
        for batch in batches:
            cells = np.unique(_probes(batch.column(0).to_numpy().view(np.uint64)))
            word = (cells >> np.uint64(6)).astype(np.int64)
            at = np.flatnonzero(np.diff(word, prepend=-1))
            bits = np.bitwise_or.reduceat(np.uint64(1) << (cells & np.uint64(63)), at) if len(cells) else cells
            yield pa.RecordBatch.from_arrays([pa.array(word[at]), pa.array(bits.view(np.int64))], names=["word", "bits"])

    rows = seeds.select("h").mapInArrow(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(1 << (MAP_BITS - 6), np.uint64)
    out[rows["word"].to_numpy()] = rows["bits"].to_numpy().view(np.uint64)
    return out


def _suspects(docs: DataFrame, text_col: str, seeds: DataFrame) -> DataFrame:
    """(doc, text, seeds) of the texts with a seed in the map of the items' seeds; ``doc`` is a digest."""
    sizes = sorted(r[0] for r in seeds.select("size").distinct().collect())  # at most ``tile`` of them
    held = docs.sparkSession.sparkContext.broadcast(_map_of(seeds))

    def run(batches):
        for batch in batches:
            texts = texts_of(batch.column(0))
            hits: dict[int, list[np.ndarray]] = {}
            for size in sizes:
                for k, keys in _seeds(texts, size):
                    cells = _probes(keys)
                    set_ = (held.value[cells >> np.uint64(6)] >> (cells & np.uint64(63)) & np.uint64(1)).astype(bool)
                    both = set_[: len(keys)] & set_[len(keys) :]
                    if both.any():
                        hits.setdefault(k, []).append(np.unique(keys[both]))
            for k, parts in hits.items():
                flat = np.concatenate(parts).view(np.int64)
                columns = [pa.array([_md5(texts[k])]), pa.array([texts[k].decode("utf-8", "replace")]), pa.array([flat.tolist()], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc", "text", "seeds"])

    return docs.select(text_col).mapInArrow(run, "doc string, text string, seeds array<long>")


def _tiled_pairs(pairs: DataFrame, tile: int, coverage: float) -> DataFrame:
    """(doc, item, item_words, matched_words, tiles) of the pairs that reach the coverage."""
    arrow = pa.list_(pa.struct([pa.field(x, pa.int32()) for x in ("text_word", "item_word", "length")]))

    def run(batches):
        for batch in batches:
            rows = []
            for doc, item, text, other in zip(*(batch.column(k).to_pylist() for k in range(4))):
                n = len(words_of(other.encode()))
                got = tiled(text.encode(), other.encode(), tile)
                marked = sum(t[2] for t in got)
                if marked >= coverage * n:
                    rows.append((doc, item, n, marked, [dict(zip(("text_word", "item_word", "length"), t)) for t in got]))
            types = [pa.string(), pa.string(), pa.int64(), pa.int64(), arrow]
            columns = [pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * 5, types)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc", "item", "item_words", "matched_words", "tiles"])

    schema = T.StructType().add("doc", "string").add("item", "string").add("item_words", "long").add("matched_words", "long")
    return pairs.select("doc", "item", "text", "item_text").mapInArrow(run, schema.add("tiles", TILES))


def found(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_text_col: str = "text", tile: int = TILE, coverage: float = COVERAGE) -> DataFrame:
    """(doc, item, item_words, matched_words, tiles) for every two texts that reach the coverage, by their MD5."""
    seeds = written(_item_seeds(benchmark, item_text_col, tile), "seeds")
    suspects = written(_suspects(docs, text_col, seeds), "suspects").dropDuplicates(["doc"])
    own = suspects.select("doc", F.explode("seeds").alias("h"))
    # a seed that very many documents have is spread by document
    salted = own.withColumn("salt", F.pmod(F.xxhash64("doc"), F.lit(SALTS)).cast("int"))
    each = seeds.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    shared = salted.join(each, ["h", "salt"]).groupBy("doc", "item", "size", "n").agg(F.sum("places").alias("places"))
    pairs = shared.filter(F.col("places") * F.col("size") >= F.col("n") * coverage).select("doc", "item")
    texts = benchmark.select(F.col(item_text_col).alias("item_text")).filter("item_text is not null")
    texts = texts.withColumn("item", F.md5("item_text")).dropDuplicates(["item"])
    pairs = spread_join(pairs, texts, "item", "doc").join(suspects.select("doc", "text"), "doc")
    return written(_tiled_pairs(pairs, tile, coverage), "tiles")


def leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    tile: int = TILE,
    coverage: float = COVERAGE,
) -> DataFrame:
    """(id, item, item_words, matched_words, coverage, tiles) for every pair that reaches the coverage.

    tiles are (text_word, item_word, length), words counted from 0.  An item shorter than ``tile`` words
    must stand whole.  Null and empty texts and items have no words and match nothing; null ids, of either
    side, are ids like others; rows that repeat are judged each; an empty table on either side gives an
    empty one.  The item's text is the benchmark's column ``text``.
    """
    pairs = found(docs, benchmark, text_col, "text", tile, coverage)
    items = benchmark.select(F.col(item_col).alias("own_item"), F.md5("text").alias("item"))
    rows = docs.select(F.col(id_col).alias("own_doc"), F.md5(text_col).alias("doc"))
    hits = pairs.join(items, "item").join(rows, "doc")
    share = F.col("matched_words") / F.col("item_words")
    return hits.select(F.col("own_doc").alias(id_col), F.col("own_item").alias(item_col), "item_words", "matched_words", share.alias("coverage"), "tiles")


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", tile: int = TILE, coverage: float = COVERAGE) -> DataFrame:
    """The documents, all columns, that cover no item enough; cases as in ``leaks``."""
    gone = found(docs, benchmark, text_col, "text", tile, coverage).select(F.col("doc").alias("_doc_md5")).distinct()
    return docs.join(gone, F.md5(F.col(text_col)) == F.col("_doc_md5"), "left_anti")
