"""Cross-tokenizer alignment (operator 12): which tokens of two vocabularies end at the same bytes, and how often.

Texts are dealt into blocks of documents and pairs of ids into shards by their second id, so that a shard holds
every pair of that id: at most one for each id of the first vocabulary.

1. Blocks align their texts and send each shard the distinct pairs that they hold, with counts.
2. Shards unite the distinct pairs, branch by branch, and build a minimal perfect hash over them.
3. Each branch of blocks adds its counts into a dense vector indexed by the hash; the vectors of branches are
   summed in a second step.  The keys lie beside the counts in the same order, so that a looked-up pair is
   verified.
4. Shards look every block's pairs up, and blocks align their texts again and sum what was found.

Alignment is by unit: a text is cut before every space that follows a character which is no white space.  Neither
tokenizer has a token across such a place (``Aligner`` makes sure of it), so the tokens of a text are those of its
units in a row.  The distinct units of a run of texts are tokenized once, end to end, and aligned as arrays.
"""

from __future__ import annotations

import hashlib
import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .blocks import chunks, dealt, partitions, texts_of, written
from .mph import Hashed, built
from .words import byte_hashes, mix

#: Bytes of texts whose units are told apart at once, and of distinct units that are tokenized at once.
RUN, STRETCH = 4 << 20, 64 << 10

PAIRS = "block int, branch int, shard int, keys binary, counts binary"
KEYS = "shard int, keys binary"
HASH = "shard int, sizes array<long>, bits binary, keys binary"
VECTOR = "shard int, counts binary"
TABLE = "shard int, sizes array<long>, bits binary, keys binary, counts binary, best binary"
ANSWER = "block int, keys binary, counts binary, best binary"
COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


def byte_levels() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable Latin-1 for itself, others from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(others)}


def units_of(data: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where units begin in texts that lie end to end, each with a space before it.

    After a character of three bytes that begins with E1 to E3, which may be white space, none does.
    """
    before = np.concatenate((np.zeros(3, np.uint8), data[:-1]))  # before[k + 2] is the byte before k
    last, second, third = before[2:], before[1:-1], before[:-2]
    solid = (last > 32) & ~((last >= 0x80) & (((second == 0xC2) & ((last == 0x85) | (last == 0xA0))) | ((third >= 0xE1) & (third <= 0xE3))))
    begins = (data == 32) & solid[: len(data)]
    begins[first] = True
    return np.flatnonzero(begins)


class Run:
    """Aligned texts: numbers of distinct units by text, and by unit its counts of tokens, its links and its groups."""

    def __init__(self, per_text: list[np.ndarray], n_a: np.ndarray, n_b: np.ndarray, n_links: np.ndarray, links: np.ndarray, groups: list[str] | None):
        self.per_text, self.n_a, self.n_b, self.n_links, self.links, self.groups = per_text, n_a, n_b, n_links, links, groups


class Aligner:
    """The two tokenizers of one worker."""

    def __init__(self, a_file: str, b_file: str, pattern: str):
        import sentencepiece
        import tiktoken

        byte, vocabulary = byte_levels(), json.load(open(a_file, encoding="utf-8"))["model"]["vocab"]
        ranks = {bytes(byte[c] for c in entry): i for entry, i in vocabulary.items() if all(c in byte for c in entry)}
        self.a = tiktoken.Encoding("a", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_file)
        self.a_bytes = [b""] * (max(ranks.values()) + 1)
        for entry, i in ranks.items():
            self.a_bytes[i] = entry
        self.n_b = self.b.get_piece_size()
        pieces = [self.b.id_to_piece(i) for i in range(self.n_b)]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.a_len, self.b_len = (np.array(list(map(len, x)), np.int64) for x in (self.a_bytes, self.b_bytes))
        crossing = re.compile(r"\S ")  # a token over the end of a unit would make units unsafe
        self.by_unit = not any(crossing.search(x.decode("utf-8", "ignore")) for x in self.a_bytes + self.b_bytes)
        names = lambda n, end: np.array([f"{i}{end}" for i in range(n)], object)
        self.a_names = names(len(self.a_bytes), ","), names(len(self.a_bytes), "|")
        self.b_names = names(self.n_b, ","), names(self.n_b, ";")

    def stretch(self, raw: bytes, ends: np.ndarray, names: bool) -> tuple | None:
        """(n_a, n_b, n_links, links, groups) of units that end at ``ends`` in ``raw``; None if a tokenizer changes them."""
        text = raw.decode()
        a, b = self.a.encode_ordinary(text), self.b.encode(text[1:])
        if b"".join([self.a_bytes[i] for i in a]) != raw or b"".join([self.b_bytes[i] for i in b]) != raw:
            return None
        a, b = np.array(a, np.int64), np.array(b, np.int64)
        end_a, end_b = np.cumsum(self.a_len[a]), np.cumsum(self.b_len[b])
        at = np.searchsorted(end_b, end_a)
        met = end_b[at] == end_a
        links = a[met] * self.n_b + b[at[met]]
        upto_a, upto_b = np.searchsorted(end_a, ends, "right"), np.searchsorted(end_b, ends, "right")
        if (end_a[upto_a - 1] != ends).any() or (end_b[upto_b - 1] != ends).any():
            return None
        upto = np.concatenate(([0], np.cumsum(met)))[upto_a]
        each = lambda x: np.diff(x, prepend=0)
        groups: list[str] = []
        if names:  # tokens of A and B in the order in which their groups are written
            met_b = np.zeros(len(b), bool)
            met_b[at[met]] = True
            close_a, close_b = np.flatnonzero(met) + 1, np.flatnonzero(met_b) + 1
            of_a, of_b = np.cumsum(met) - met, np.cumsum(met_b) - met_b
            out = np.empty(len(a) + len(b), object)
            out[np.arange(len(a)) + np.concatenate(([0], close_b))[of_a]] = np.where(met, self.a_names[1][a], self.a_names[0][a])
            out[np.arange(len(b)) + close_a[of_b]] = np.where(met_b, self.b_names[1][b], self.b_names[0][b])
            written_, cuts = out.tolist(), [0, *(upto_a + upto_b).tolist()]
            groups = ["".join(written_[i:j]) for i, j in zip(cuts, cuts[1:])]
        return each(upto_a), each(upto_b), each(upto), links.astype(np.uint64), groups

    def units(self, units: list[bytes], names: bool) -> tuple:
        """The same of any number of units; the last item says which of them the tokenizers give back."""
        found, whole, k = [], np.ones(len(units), bool), 0
        sizes = np.array(list(map(len, units)), np.int64)
        while k < len(units):
            n = max(1, int(np.searchsorted(np.cumsum(sizes[k : k + STRETCH]), STRETCH)))
            some = self.stretch(b"".join(units[k : k + n]), np.cumsum(sizes[k : k + n]), names)
            if some is None:  # one by one, to find the odd ones
                none = tuple(np.zeros(1, np.int64) for _ in range(3)) + (np.zeros(0, np.uint64), [""])
                for i in range(k, k + n):
                    one = self.stretch(units[i], sizes[i : i + 1], names)
                    whole[i] = one is not None
                    found.append(one or none)
            else:
                found.append(some)
            k += n
        join = lambda i, kind: np.concatenate([np.zeros(0, kind), *(x[i] for x in found)])
        return join(0, np.int64), join(1, np.int64), join(2, np.int64), join(3, np.uint64), [g for x in found for g in x[4]], whole

    def run(self, texts: list[bytes], names: bool) -> Run:
        spaced = [b" " + x if x and _is_text(x) else b"" for x in texts]  # bytes that are no text: no tokens give them back
        data = np.frombuffer(b"".join(spaced), np.uint8)
        offsets = np.cumsum([0] + [len(x) for x in spaced])
        first = offsets[:-1][np.diff(offsets) > 0]
        start = units_of(data, first) if self.by_unit else first
        end = np.append(start[1:], len(data))
        size, pieces = end - start, _pieces(start, end)
        hashes = np.concatenate([np.zeros(0, np.uint64), *(byte_hashes(data[start[i] : end[j - 1]], start[i:j] - start[i], end[i:j] - start[i], 1) for i, j in pieces)])
        _, top, which = np.unique(hashes, return_index=True, return_inverse=True)
        same = bool((size[top][which] == size).all())
        for i, j in pieces if same else []:  # every unit against the one that stands for it
            like = np.repeat(start[top][which[i:j]] - start[i:j], size[i:j]) + np.arange(start[i], end[j - 1])
            same = same and bool((data[like] == data[start[i] : end[j - 1]]).all())
        if not same:  # two units share a hash: each counts as one of its own
            top = which = np.arange(len(start))
        raw = data.tobytes()
        n_a, n_b, n_links, links, groups, whole = self.units([raw[a:b] for a, b in zip(start[top].tolist(), end[top].tolist())], names)
        bounds = np.searchsorted(start, offsets).tolist()
        per_text = [which[a:b] for a, b in zip(bounds, bounds[1:])]
        if not whole.all():  # a text is judged as a whole: that its units fail need not mean that it does
            extra = []
            for k, mine in enumerate(per_text):
                if not whole[mine].all():
                    alone = self.stretch(spaced[k], np.array([len(spaced[k])]), names)
                    per_text[k] = np.zeros(0, np.int64) if alone is None else np.array([len(whole) + len(extra)])
                    extra += [alone] if alone is not None else []
            more = lambda x, i: np.concatenate([x, *(e[i] for e in extra)])
            n_a, n_b, n_links, links, groups = more(n_a, 0), more(n_b, 1), more(n_links, 2), more(links, 3), groups + [g for e in extra for g in e[4]]
        return Run(per_text, n_a, n_b, n_links, links, groups)


def _pieces(start: np.ndarray, end: np.ndarray, most: int = 512 << 10) -> list[tuple[int, int]]:
    """(from, to) of runs of units that span so many bytes at most, or one longer unit."""
    out, i = [], 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(end, start[i] + most, "right")))
        out.append((i, j))
        i = j
    return out


def _is_text(raw: bytes) -> bool:
    try:
        raw.decode()
    except UnicodeDecodeError:
        return False
    return True


_ALIGNERS: dict[tuple[str, ...], Aligner] = {}


def aligned(texts: list[bytes], files: tuple[str, ...], names: bool):
    """The runs of texts, aligned; ``files`` are the two vocabularies and the first one's pattern."""
    if files not in _ALIGNERS:
        _ALIGNERS[files] = Aligner(*files)
    for a, b in chunks(texts, RUN):
        yield _ALIGNERS[files].run(texts[a:b], names)


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, with the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else np.zeros(0, np.int64)


def _typed(schema: str):
    """Rows of one schema, whose Arrow form is made on the driver."""
    kind = to_arrow_schema(T._parse_datatype_string(schema))

    def rows(found: list[tuple]) -> pa.Table:
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found) if found else [()] * len(kind), kind)], schema=kind)

    return rows


def _long(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.int64)


def _key(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint64)


def _hashed(row: dict) -> Hashed:
    return Hashed(row["sizes"], row["bits"], _key(row["keys"]))


def _counted(files: tuple[str, ...], n_b: int, shards: int, branches: int):
    rows = _typed(PAIRS)

    def run(table: pa.Table) -> pa.Table:
        block, keys, counts = table.column("block")[0].as_py(), [], []
        for run in aligned(texts_of(table.column(2)), files, False):
            used = np.concatenate([np.zeros(0, np.int64), *run.per_text])
            times = np.repeat(np.bincount(used, minlength=len(run.n_a)), run.n_links)
            some = summed(run.links[times > 0], times[times > 0])  # units of texts without tokens count nothing
            keys.append(some[0])
            counts.append(some[1])
        key, count = summed(np.concatenate([np.zeros(0, np.uint64), *keys]), np.concatenate([np.zeros(0, np.int64), *counts]))
        shard = (mix(key % np.uint64(n_b)) % np.uint64(shards)).astype(np.int64)
        order = np.argsort(shard, kind="stable")
        key, count, shard = key[order], count[order], shard[order]
        edges = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(shard)]
        return rows([(block, block % branches, int(shard[a]), key[a:b].tobytes(), count[a:b].tobytes()) for a, b in zip(edges, edges[1:]) if b > a])

    return run


def _united():
    rows = _typed(KEYS)

    def run(table: pa.Table) -> pa.Table:
        keys = np.unique(np.concatenate([_key(x) for x in table.column("keys").to_pylist()]))
        return rows([(table.column("shard")[0].as_py(), keys.tobytes())])

    return run


def _built():
    rows = _typed(HASH)

    def run(table: pa.Table) -> pa.Table:
        keys = np.unique(np.concatenate([_key(x) for x in table.column("keys").to_pylist()]))
        sizes, bits = built(keys)
        ordered = np.empty_like(keys)
        ordered[Hashed(sizes, bits).at(keys)] = keys
        return rows([(table.column("shard")[0].as_py(), sizes, bits, ordered.tobytes())])

    return run


def _added():
    rows = _typed(VECTOR)

    def run(pairs: pa.Table, index: pa.Table) -> pa.Table:
        if not pairs.num_rows:
            return rows([])
        hashed = _hashed(index.to_pylist()[0])
        counts = np.zeros(len(hashed.keys), np.int64)
        for keys, n in zip(pairs.column("keys").to_pylist(), pairs.column("counts").to_pylist()):
            counts[hashed.at(_key(keys))] += _long(n)  # a block's keys are distinct
        return rows([(pairs.column("shard")[0].as_py(), counts.tobytes())])

    return run


def _tables(n_b: int):
    rows = _typed(TABLE)

    def run(vectors: pa.Table, index: pa.Table) -> pa.Table:
        row = index.to_pylist()[0]
        counts = np.sum([_long(x) for x in vectors.column("counts").to_pylist()], axis=0)
        second = (_key(row["keys"]) % np.uint64(n_b)).astype(np.int64)
        most = np.zeros(n_b, np.int64)
        np.maximum.at(most, second, counts)
        return rows([(row["shard"], row["sizes"], row["bits"], row["keys"], counts.tobytes(), (counts == most[second]).tobytes())])

    return run


def _answered():
    rows = _typed(ANSWER)

    def run(pairs: pa.Table, table: pa.Table) -> pa.Table:
        if not pairs.num_rows:
            return rows([])
        row = table.to_pylist()[0]
        hashed, counts, best = _hashed(row), _long(row["counts"]), np.frombuffer(row["best"], bool)
        out = []
        for block, keys in zip(pairs.column("block").to_pylist(), pairs.column("keys").to_pylist()):
            at = hashed.at(_key(keys))
            if (at < 0).any():
                raise ValueError("a pair of the texts is not among the hashed keys")
            out.append((block, keys, counts[at].tobytes(), best[at].tobytes()))
        return rows(out)

    return run


def _looked_up(files: tuple[str, ...], schema: pa.Schema):
    digest = schema.names[-1] == "groups_sha256"

    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return schema.empty_table()
        found = answers.to_pylist()
        keys = np.concatenate([np.zeros(0, np.uint64), *(_key(r["keys"]) for r in found)])
        order = np.argsort(keys)
        keys = keys[order]
        counts = np.concatenate([np.zeros(0, np.int64), *(_long(r["counts"]) for r in found)])[order]
        best = np.concatenate([np.zeros(0, bool), *(np.frombuffer(r["best"], bool) for r in found)])[order]
        numbers, groups = [], []
        for run in aligned(texts_of(docs.column(2)), files, True):
            at = np.minimum(np.searchsorted(keys, run.links), max(len(keys) - 1, 0))
            known = keys[at] == run.links if len(keys) else np.zeros(len(run.links), bool)  # units of texts without tokens may hold others
            ends = np.cumsum(run.n_links)
            total = lambda x: (s := np.concatenate(([0], np.cumsum(x))))[ends] - s[ends - run.n_links]  # noqa: B023, E731
            n_best, n_sum = (total(np.where(known, x[at], 0) if len(keys) else known) for x in (best.astype(np.int64), counts))
            each = np.array([run.n_a, run.n_b, run.n_links, run.n_links, n_best, n_sum], np.int64)
            for mine in run.per_text:
                numbers.append(each[:, mine].sum(axis=1))
                said = "".join([run.groups[i] for i in mine.tolist()])[:-1]
                groups.append(hashlib.sha256(said.encode()).hexdigest() if digest and said else said)
        table = docs.combine_chunks().drop_columns(["block", docs.column_names[2]])
        columns = np.array(numbers, np.int64).reshape(-1, 6).T
        for name, values in zip(COLUMNS, columns):
            table = table.append_column(name, pa.array(values))
        return table.append_column(schema.names[-1], pa.array(groups, pa.string())).cast(schema)

    return run


def alignment(docs: DataFrame, files: tuple[str, ...], id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups) for every document.

    ``files`` are a byte-level BPE as JSON (A), a sentencepiece model (B) and the pattern that cuts texts for A.
    A encodes a space
    and the text, B the text, whose space it adds.  Bytes where tokens of both end cut them into ``groups``, written
    ``a1,a2|b1;a3|b2,b3``; with ``digest`` their SHA-256 as ``groups_sha256`` instead.  Tokens that end together are
    a link.  ``n_best`` are the links whose pair of ids is the commonest of its B id in the corpus, ties included;
    ``count_sum`` adds up how often each link's pair is linked in the corpus.  Null and empty texts, and those that
    the tokens of A or B do not give back byte by byte, have no tokens: zeros and an empty string, and count nothing.
    Rows that repeat count each; null ids stay; an empty table gives an empty table.
    """
    import sentencepiece

    spark = docs.sparkSession
    n_b = sentencepiece.SentencePieceProcessor(model_file=files[1]).get_piece_size()
    shards, texts = partitions(spark), dealt(docs, id_col, text_col)
    branches = max(1, round(shards**0.5))
    pairs = written(texts.groupBy("block").applyInArrow(_counted(files, n_b, shards, branches), PAIRS), "pairs")
    keys = pairs.select("shard", "branch", "keys").groupBy("shard", "branch").applyInArrow(_united(), KEYS)
    index = written(keys.groupBy("shard").applyInArrow(_built(), HASH), "hashes")
    to_branches = lambda df: df.withColumn("branch", F.explode(F.sequence(F.lit(0), F.lit(branches - 1)))).groupBy("shard", "branch")
    vectors = pairs.groupBy("shard", "branch").cogroup(to_branches(index)).applyInArrow(_added(), VECTOR)
    tables = written(vectors.groupBy("shard").cogroup(index.groupBy("shard")).applyInArrow(_tables(n_b), TABLE), "counts")
    answers = pairs.groupBy("shard", "branch").cogroup(to_branches(tables)).applyInArrow(_answered(), ANSWER)
    schema = T.StructType([docs.schema[id_col], *[T.StructField(c, T.LongType()) for c in COLUMNS], T.StructField("groups_sha256" if digest else "groups", T.StringType())])
    return texts.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_looked_up(files, to_arrow_schema(schema)), schema)
