"""Substring deduplication with a count-min prefilter (operator 9).

A window is 13 consecutive words of one document.  A word goes if a window covers it whose words also
start in a document with a smaller id.  Documents are dealt into blocks, and

1. each block sends every shard of window hashes its partial count-min sketch, as the sorted cells that
   it fills; shards merge them into counters of a fixed size, which overestimate, and answer which of the
   cells may be filled twice;
2. each block groups only windows in such cells: it sends shards their 128-bit hashes with the least
   document id that it holds, and shards answer where another block has a smaller one;
3. each block removes the words that repeated windows cover.

No window that repeats is lost in step 1, and step 2 is exact; the three steps share one dealing of the
texts.  Blocks and shards number as the shuffle partitions, so that each is a bounded share.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .blocks import chunks, dealt, partitions, split, texts_of
from .words import Words, mix, windows

WINDOW = 13
#: Counters in each of the two rows of a shard's sketch.
WIDTH_BITS = 24
#: Bits of a window's hash that tell cells apart before they are folded into the counters.
CELL_BITS = 40
LAST = np.iinfo(np.int64).max

PACKET = "block int, shard int, phase int, size long, a binary, b binary, c binary"
PACKET_TYPE = pa.schema(
    [("block", pa.int32()), ("shard", pa.int32()), ("phase", pa.int32()), ("size", pa.int64()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary())]
)


def _packets(rows: list[tuple]) -> pa.Table:
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [()] * 7, PACKET_TYPE)], schema=PACKET_TYPE)


def _deltas(values: np.ndarray) -> bytes:
    """Sorted values as differences, in as few bytes each as the largest needs; the first byte tells."""
    steps = np.diff(values, prepend=np.zeros(1, values.dtype)).astype("<u8")
    width = max(1, -(-int(steps.max()).bit_length() // 8))
    return bytes([width]) + np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def _undo(data: bytes) -> np.ndarray:
    width = data[0]
    raw = np.frombuffer(data, np.uint8, offset=1).reshape(-1, width)
    full = np.zeros((len(raw), 8), np.uint8)
    full[:, :width] = raw
    return np.cumsum(full.view("<u8").ravel().astype(np.uint64), dtype=np.uint64)


class Block:
    """Windows of one block's documents, the same in each of the three steps."""

    def __init__(self, table: pa.Table):
        table = table.combine_chunks()
        self.id = table.column("block")[0].as_py()
        ids = table.column(1).cast(pa.int64()).fill_null(LAST)
        self.texts = texts_of(table.column(2))
        self.ids = ids.to_numpy()
        self.n_words = np.zeros(len(self.texts), np.int64)
        keys, second, doc, place = [], [], [], []
        for a, b in chunks(self.texts):
            w = Words(self.texts[a:b])
            self.n_words[a:b] = np.diff(w.first)
            key, at = windows(w.hashes(1), w.first, WINDOW, 1)
            owner = np.searchsorted(w.first, at, "right") - 1
            keys.append(key)
            second.append(windows(w.hashes(2), w.first, WINDOW, 2)[0])
            doc.append((owner + a).astype(np.int32))
            place.append((at - w.first[owner]).astype(np.int32))
        join = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
        self.keys, self.second = join(keys, np.uint64), join(second, np.uint64)
        self.doc, self.place = join(doc, np.int32), join(place, np.int32)

    def cells(self) -> tuple[np.ndarray, np.ndarray]:
        """The distinct cells that the windows fill, ascending, and which of them two windows fill."""
        cells = np.sort(self.keys >> np.uint64(64 - CELL_BITS))
        first = np.flatnonzero(np.concatenate(([True], cells[1:] != cells[:-1]))) if len(cells) else np.zeros(0, np.int64)
        return cells[first], np.diff(first, append=len(cells)) > 1

    def candidates(self, maybe: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Indices of windows whose cells (of ``maybe``) may repeat, by hash and id; where equal ones begin."""
        cells, _ = self.cells()
        kept = cells[maybe]
        mine = self.keys >> np.uint64(64 - CELL_BITS)
        at = np.minimum(np.searchsorted(kept, mine), max(len(kept) - 1, 0))
        rows = np.flatnonzero(kept[at] == mine) if len(kept) else np.zeros(0, np.int64)
        rows = rows[np.lexsort((self.ids[self.doc[rows]], self.second[rows], self.keys[rows]))]
        k, s = self.keys[rows], self.second[rows]
        new = np.concatenate(([True], (k[1:] != k[:-1]) | (s[1:] != s[:-1]))) if len(rows) else np.zeros(0, bool)
        return rows, np.flatnonzero(new)


def _answer(table: pa.Table, phase: int, total: int) -> np.ndarray:
    """The bits that the shards answered to a block, in the order of its sorted keys."""
    if not table.num_rows:
        return np.zeros(total, bool)
    rows = table.select(["shard", "phase", "size", "a"]).to_pylist()
    parts = sorted((r["shard"], r["size"], r["a"]) for r in rows if r["phase"] == phase)
    bits = [np.unpackbits(np.frombuffer(a, np.uint8), count=n).astype(bool) for _, n, a in parts]
    return np.concatenate(bits) if bits else np.zeros(total, bool)


def _sketch(shards: int):
    def run(table: pa.Table) -> pa.Table:
        block = Block(table)
        cells, twice = block.cells()
        shift = np.uint64(64 - CELL_BITS)
        return _packets([(block.id, k, 1, b - a, _deltas(cells[a:b]), np.packbits(twice[a:b]).tobytes(), None) for k, a, b in split(cells << shift, shards)])

    return run


def _merge(table: pa.Table) -> pa.Table:
    """A shard's sketch of two rows of counters, and its answers to the blocks."""
    rows = table.to_pylist()
    folds = [lambda c, k=k: (mix(c * np.uint64(2) + np.uint64(k)) >> np.uint64(64 - WIDTH_BITS)).astype(np.int64) for k in (0, 1)]
    counters = []
    for fold in folds:
        filled = np.zeros(1 << WIDTH_BITS, np.uint8)
        for r in rows:
            cells = _undo(r["a"])
            many = np.unpackbits(np.frombuffer(r["b"], np.uint8), count=r["size"]).astype(bool)
            at, n = np.unique(fold(cells), return_counts=True)
            filled[at] = np.minimum(filled[at] + np.minimum(n, 2), 2)
            filled[fold(cells[many])] = 2
        counters.append(filled)
    out = []
    for r in rows:
        cells = _undo(r["a"])
        both = np.minimum(counters[0][folds[0](cells)], counters[1][folds[1](cells)]) > 1
        out.append((r["block"], r["shard"], 1, r["size"], np.packbits(both).tobytes(), None, None))
    return _packets(out)


def _group(shards: int):
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return _packets([])
        block = Block(docs)
        rows, new = block.candidates(_answer(answers, 1, len(block.cells()[0])))
        top = rows[new]  # has the least id of its hash
        keys, second, ids = block.keys[top], block.second[top], block.ids[block.doc[top]]
        return _packets([(block.id, k, 2, b - a, keys[a:b].tobytes(), second[a:b].tobytes(), ids[a:b].tobytes()) for k, a, b in split(keys, shards)])

    return run


def _least(table: pa.Table) -> pa.Table:
    """Where another block has a window with a smaller id."""
    rows = table.to_pylist()
    joined = lambda name, kind: np.concatenate([np.frombuffer(r[name], kind) for r in rows])
    keys, second, ids = joined("a", np.uint64), joined("b", np.uint64), joined("c", np.int64)
    order = np.lexsort((ids, second, keys))
    k, s = keys[order], second[order]
    new = np.concatenate(([True], (k[1:] != k[:-1]) | (s[1:] != s[:-1])))
    least = ids[order][np.flatnonzero(new)][np.cumsum(new) - 1]
    smaller = np.zeros(len(keys), bool)
    smaller[order] = least < ids[order]
    out, at = [], 0
    for r in rows:
        out.append((r["block"], r["shard"], 2, r["size"], np.packbits(smaller[at : at + r["size"]]).tobytes(), None, None))
        at += r["size"]
    return _packets(out)


def _removal(schema: pa.Schema, tidy: bool):
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return schema.empty_table()
        block = Block(docs)
        rows, new = block.candidates(_answer(answers, 1, len(block.cells()[0])))
        elsewhere = _answer(answers, 2, len(new))
        ids = block.ids[block.doc[rows]]
        group = np.repeat(np.arange(len(new)), np.diff(new, append=len(rows)))
        goes = rows[elsewhere[group] | (ids > ids[new][group])] if len(rows) else rows
        goes = goes[np.lexsort((block.place[goes], block.doc[goes]))]
        bounds = np.searchsorted(block.doc[goes], np.arange(len(block.texts) + 1))
        removed, kept = [], []
        for i, text in enumerate(block.texts):
            words, at = text.split(), block.place[goes[bounds[i] : bounds[i + 1]]]
            if len(at):
                steps = np.zeros(len(words) + 1, np.int64)
                np.add.at(steps, at, 1)
                np.add.at(steps, np.minimum(at + WINDOW, len(words)), -1)
                stay = np.cumsum(steps[:-1]) == 0
                removed.append(int(len(words) - stay.sum()))
                words = [w for w, s in zip(words, stay.tolist()) if s]
            else:
                removed.append(0)
            kept.append((b" ".join(words) if tidy or len(at) else text).decode("utf-8", "replace"))
        table = docs.combine_chunks().drop_columns(["block", docs.column_names[2]])
        for name, values, kind in (("n_words", block.n_words, pa.int64()), ("n_removed", removed, pa.int64()), ("kept_text", kept, pa.string())):
            table = table.append_column(name, pa.array(values, kind))
        return table.cast(schema)

    return run


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), tidy: bool = True) -> DataFrame:
    """(id, carried columns, n_words, n_removed, kept_text) for every document.

    Words are the runs of bytes other than space and \\x09-\\x0D; kept words are joined by one space, but
    with ``tidy`` false a text of which nothing goes stays as it is.
    Null and empty texts have no words.  Rows that repeat an id count as one document; a null id counts
    as the largest.  The id is an integer; an empty table gives an empty table.
    """
    shards = partitions(docs.sparkSession)
    texts = dealt(docs, id_col, text_col, *carry)
    maybe = texts.groupBy("block").applyInArrow(_sketch(shards), PACKET).groupBy("shard").applyInArrow(_merge, PACKET)
    asked = texts.groupBy("block").cogroup(maybe.groupBy("block")).applyInArrow(_group(shards), PACKET)
    smaller = asked.groupBy("shard").applyInArrow(_least, PACKET)
    fields = [docs.schema[c] for c in (id_col, *carry)]
    schema = T.StructType([*[T.StructField(f.name, f.dataType) for f in fields], T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_text", T.StringType())])
    return texts.groupBy("block").cogroup(maybe.unionByName(smaller).groupBy("block")).applyInArrow(_removal(to_arrow_schema(schema), tidy), schema)

