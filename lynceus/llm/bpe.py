"""Byte-level BPE by recursive queries (operator 7).

Each partition holds a DuckDB connection in memory with the vocabulary's merge table: a row for every
split of a token into two tokens, with the token's rank.  The pieces of its texts that are new to it
become token-position rows; a recursive query joins them to the merge table and contracts each piece's
leftmost pair of least rank until no pair is left.  Decoding joins token ids to the vocabulary's bytes
and aggregates them in order.

Long pieces go through the same query as overlapping windows, so that rows stay in proportion to the
piece.  Tokens are what BPE makes of a text if and only if each two neighbours are what it makes of their
joint bytes; so where two windows share a token, the one's tokens up to it and the other's after it are
those of both together.  Windows that share none are contracted anew from a token of the one before.
"""

from __future__ import annotations

import base64
import hashlib

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .blocks import chunks, texts_of

#: Pieces whose tokens a worker remembers, at most; beyond it starts anew.
REMEMBERED = 400_000
#: A piece of n bytes has at most n * n / 2 rows over all steps of a recursion: the sum of n * n in one query.
BATCH = 3_000_000
#: Pieces beyond ``WINDOW`` bytes are contracted as windows that begin every ``STRIDE`` bytes and overlap by twice
#: ``HALO``.  The stride is a multiple of many numbers, so that windows of text with a short period agree.
STRIDE, HALO = 120, 40
WINDOW = STRIDE + 2 * HALO

ENCODE = """
WITH RECURSIVE step AS (
  SELECT s.w, 0 AS n, s.pos, s.tok, s.npos, s.ntok, m.rank
  FROM start s LEFT JOIN merges m ON m.a = s.tok AND m.b = s.ntok
  UNION ALL
  SELECT w, n, pos, tok, npos, ntok, m.rank
  FROM (
    WITH best AS (
      SELECT w, min(rank::BIGINT << 32 | pos) AS k FROM step WHERE rank IS NOT NULL GROUP BY w
    ), pair AS (
      SELECT s.w, s.pos, s.rank, s.npos AS gone
      FROM step s JOIN best b ON s.w = b.w AND s.pos = b.k & 4294967295
    ), cut AS (
      SELECT p.w, p.pos, p.rank, p.gone, s.npos, s.ntok FROM pair p JOIN step s ON s.w = p.w AND s.pos = p.gone
    )
    SELECT s.w, s.n + 1 AS n, s.pos,
      CASE WHEN s.pos = c.pos THEN c.rank ELSE s.tok END AS tok,
      CASE WHEN s.pos = c.pos THEN c.npos ELSE s.npos END AS npos,
      CASE WHEN s.pos = c.pos THEN c.ntok WHEN s.npos = c.pos THEN c.rank ELSE s.ntok END AS ntok
    FROM step s JOIN cut c ON s.w = c.w
    WHERE s.pos <> c.gone
  ) x LEFT JOIN merges m ON m.a = x.tok AND m.b = x.ntok
), ended AS (
  SELECT w, max(n) AS n FROM step GROUP BY w
)
SELECT s.w, s.tok FROM step s JOIN ended e ON s.w = e.w AND s.n = e.n ORDER BY s.w, s.pos
"""

DECODE = """
SELECT t.doc, string_agg(v.hex, '' ORDER BY t.pos) AS hex FROM toks t JOIN vocabulary v ON v.id = t.id GROUP BY t.doc
"""

_CODERS: dict[tuple, Coder] = {}


def ranks_of(path: str) -> dict[bytes, int]:
    """Token -> rank of a file with a base64 token and its rank in each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(bytes.strip, f))}


class Coder:
    """One worker's connection, merge table and memory of pieces."""

    def __init__(self, path: str, pattern: str):
        self.ranks, self.pattern = ranks_of(path), regex.compile(pattern)
        self.known: dict[str, str] = {}  # the ids of pieces, joined by commas
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = [
            (self.ranks[t[:k]], self.ranks[t[k:]], rank)
            for t, rank in self.ranks.items()
            for k in range(1, len(t))
            if t[:k] in self.ranks and t[k:] in self.ranks
        ]
        self.sizes = np.zeros(max(self.ranks.values()) + 1, np.int64)
        for t, rank in self.ranks.items():
            self.sizes[rank] = len(t)
        self.merges = pa.table(list(np.array(pairs, np.int32).T), names=["a", "b", "rank"])
        self.vocabulary = pa.table({"id": pa.array(self.ranks.values(), pa.int32()), "hex": [t.hex() for t in self.ranks]})
        self.db = None

    def __enter__(self) -> Coder:
        """Opens the connection for a partition."""
        self.db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "300MB", "temp_directory": ""})
        for name, rows in (("merges", self.merges), ("vocabulary", self.vocabulary)):
            self.db.register("given", rows)
            self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
            self.db.unregister("given")
        return self

    def __exit__(self, *_) -> None:
        """Gives back what the partition took, as the worker may serve other operators next."""
        self.db.close()
        self.known.clear()

    def _contract(self, pieces: list[bytes]) -> tuple[np.ndarray, list[int]]:
        """Tokens of all pieces in a row, and where each piece's begin and end."""
        sizes = np.array([len(p) for p in pieces])
        ends = np.cumsum(sizes)
        tok = self.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
        w = np.repeat(np.arange(len(pieces), dtype=np.int32), sizes)
        pos = (np.arange(len(tok)) - np.repeat(ends - sizes, sizes)).astype(np.int32)
        last = np.zeros(len(tok), bool)
        last[ends - 1] = True
        rows = {"w": w, "pos": pos, "tok": tok, "npos": pa.array(pos + 1, mask=last), "ntok": pa.array(np.append(tok[1:], 0), pa.int32(), mask=last)}
        self.db.register("start", pa.table(rows))
        found = self.db.execute(ENCODE).fetchnumpy()
        self.db.unregister("start")
        bounds = np.searchsorted(found["w"], np.arange(len(pieces) + 1))
        return np.asarray(found["tok"], np.int32), bounds.tolist()

    def contracted(self, pieces: list[bytes]):
        """The tokens of each piece, in batches of a bounded number of rows; lengths should be about ascending."""
        at = 0
        while at < len(pieces):
            end, size = at, 0
            while end < len(pieces) and (end == at or size + len(pieces[end]) ** 2 <= BATCH):
                size += len(pieces[end]) ** 2
                end += 1
            flat, bounds = self._contract(pieces[at:end])
            yield from (flat[i:j] for i, j in zip(bounds, bounds[1:]))
            at = end

    def long(self, data: bytes) -> np.ndarray:
        """The tokens of a long piece: those of its windows, joined at tokens that two of them share."""
        spans = [(max(0, a - HALO), min(len(data), a + STRIDE + HALO)) for a in range(0, len(data), STRIDE)]
        texts = sorted({data[a:b] for a, b in spans}, key=len)
        of = dict(zip(texts, self.contracted(texts)))
        ends = lambda a, toks: a + np.cumsum(self.sizes[toks])
        done: list[np.ndarray] = []  # settled tokens; own and until are those that the next window may change
        own = of[data[: spans[0][1]]]
        until = ends(0, own)
        for a, b in spans[1:]:
            toks = of[data[a:b]]
            while not self._joined(done, own, until, toks, to := ends(a, toks)):
                back = max(2 * HALO, int(until[-1]) - a)  # begins at a token of what there is, farther back each time
                k = max(0, int(np.searchsorted(until, until[-1] - back)) - 1)
                if k == 0 and done:
                    head = done.pop()
                    until = np.concatenate((until[0] - self.sizes[own[0]] - np.cumsum(self.sizes[head][::-1])[::-1] + self.sizes[head], until))
                    own = np.concatenate((head, own))
                a = int(until[k]) if k else int(until[0] - self.sizes[own[0]])
                toks = next(self.contracted([data[a:b]]))
            own, until = toks[self.kept :], to[self.kept :]
        return np.concatenate([*done, own])

    def _joined(self, done: list[np.ndarray], own: np.ndarray, until: np.ndarray, toks: np.ndarray, to: np.ndarray) -> bool:
        """Whether both have a token in common; then ``done`` gets what is before it, and ``kept`` is its place."""
        _, i, j = np.intersect1d(until << 20 | self.sizes[own], to << 20 | self.sizes[toks], return_indices=True)
        if len(i):
            done.append(own[: i[0]])
            self.kept = int(j[0])
        return len(i) > 0

    def learn(self, pieces: set[str]) -> None:
        """Tokens of pieces that are not known yet; a piece that is a token is that token."""
        todo: list[tuple[str, bytes]] = []
        for piece in sorted(pieces, key=len):
            data = piece.encode()
            if (rank := self.ranks.get(data)) is not None:
                self.known[piece] = str(rank)
            elif len(data) > WINDOW:
                self.known[piece] = ",".join(map(str, self.long(data).tolist()))
            else:
                todo.append((piece, data))
        for (piece, _), toks in zip(todo, self.contracted([data for _, data in todo])):
            self.known[piece] = ",".join(map(str, toks.tolist()))

    def encode(self, texts: list[str]) -> tuple[list[np.ndarray], list[str]]:
        """Ids of each text, and the same joined by commas."""
        split = [self.pattern.findall(x) for x in texts]
        seen = set().union(*split)
        if len(self.known) + len(seen) > REMEMBERED:  # then all of this batch's pieces are new
            self.known.clear()
        self.learn(seen - self.known.keys())
        joined = [",".join(map(self.known.__getitem__, pieces)) for pieces in split]
        return [np.fromstring(x, np.int32, sep=",") if x else np.zeros(0, np.int32) for x in joined], joined

    def decode(self, ids: list[np.ndarray]) -> list[bytes]:
        sizes = np.array([len(x) for x in ids])
        flat = np.concatenate(ids)
        rows = {"doc": np.repeat(np.arange(len(ids), dtype=np.int32), sizes), "pos": np.arange(len(flat), dtype=np.int32), "id": flat}
        self.db.register("toks", pa.table(rows))
        found = self.db.execute(DECODE).fetchall()
        self.db.unregister("toks")
        out = [b""] * len(ids)
        for doc, text in found:
            out[doc] = bytes.fromhex(text)
        return out


def coder(path: str, pattern: str) -> Coder:
    """This worker's coder; workers serve many partitions, and keep its tables."""
    if (path, pattern) not in _CODERS:
        _CODERS[path, pattern] = Coder(path, pattern)
    return _CODERS[path, pattern]


def encode_decode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """(id, carried columns, token_ids, n_tokens, ids_sha256, decoded, decoded_sha256) for every document.

    ``path`` is a rank file on every executor, ``pattern`` splits texts into pieces, which are encoded
    each by itself and without special tokens.  ``decoded`` comes from the ids alone.  Null and empty
    texts have no tokens.  Carried columns named like a result are left out.  Rows that repeat are encoded each; an empty table gives an empty table.
    """
    carry = tuple(c for c in carry if c not in ("token_ids", "n_tokens", "ids_sha256", "decoded", "decoded_sha256"))
    kept = [T.StructField(docs.schema[c].name, docs.schema[c].dataType) for c in (id_col, *carry)]
    text, number = T.StringType(), T.LongType()
    schema = T.StructType(
        [*kept, T.StructField("token_ids", T.ArrayType(T.IntegerType())), T.StructField("n_tokens", number)]
        + [T.StructField("ids_sha256", text), T.StructField("decoded", text), T.StructField("decoded_sha256", text)]
    )
    arrow = to_arrow_schema(schema)

    def run(batches):
        with coder(path, pattern) as own:
            for batch in batches:
                texts = texts_of(batch.column(batch.num_columns - 1))
                for a, b in chunks(texts, 1 << 20):
                    ids, joined = own.encode([x.decode("utf-8", "replace") for x in texts[a:b]])
                    back = own.decode(ids)
                    sha = lambda x: hashlib.sha256(x).hexdigest()
                    sizes = np.array([len(x) for x in ids])
                    offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
                    made = [
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids))),
                        pa.array(sizes.astype(np.int64)),
                        pa.array([sha(x.encode()) for x in joined]),
                        pa.array([x.decode("utf-8", "replace") for x in back]),
                        pa.array([sha(x) for x in back]),
                    ]
                    part = batch.slice(a, b - a)
                    own_columns = [part.column(k) for k in range(len(kept))]
                    made = [x.cast(f.type) for x, f in zip(made, list(arrow)[len(kept) :])]
                    yield pa.RecordBatch.from_arrays([*own_columns, *made], names=arrow.names)

    return docs.select(id_col, *carry, text_col).mapInArrow(run, schema)
