"""Operator 12: alignment and counts against a plain scan of whole texts by the libraries themselves."""

import hashlib
import json
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from lynceus.llm import align, mph, queries

SCHEMA = "doc_id long, text string, groups string, block string"
FILES = (*map(public_tokenizers.path, queries.PAIRED), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def brute():
    a, b = Tokenizer.from_file(FILES[0]), sentencepiece.SentencePieceProcessor(model_file=FILES[1])
    a.encode_special_tokens = True
    names, letter = {i: k for k, i in a.get_vocab().items()}, align.byte_levels()

    def spans(pieces):
        at = 0
        for i, raw in pieces:
            yield i, at, (at := at + len(raw))

    def of(text):
        if not text:
            return [], [], [], []
        whole = (" " + text).encode()
        as_a = [(i, bytes(letter[c] for c in names[i])) for i in a.encode(" " + text, add_special_tokens=False).ids]
        as_b = [(i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()) for i in b.encode(text) for p in [b.id_to_piece(i)]]
        if b"".join(x for _, x in as_a) != whole or b"".join(x for _, x in as_b) != whole:
            return [], [], [], []
        as_a, as_b = list(spans(as_a)), list(spans(as_b))
        ends = sorted({e for *_, e in as_a} & {e for *_, e in as_b})
        groups = [([], []) for _ in ends]
        for side, tokens in enumerate((as_a, as_b)):
            g = 0
            for i, _, e in tokens:
                groups[g][side].append(i)
                g += e == ends[g]
        at_b = {e: i for i, _, e in as_b}
        return as_a, as_b, groups, [(i, at_b[e]) for i, _, e in as_a if e in at_b]

    def run(texts):
        found = [of(t) for t in texts]
        count = Counter(x for f in found for x in f[3])
        best = Counter()
        for (_, j), n in count.items():
            best[j] = max(best[j], n)
        for as_a, as_b, groups, links in found:
            said = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
            n_best = sum(count[x] == best[x[1]] for x in links)
            yield len(as_a), len(as_b), len(groups), len(links), n_best, sum(count[x] for x in links), hashlib.sha256(said.encode()).hexdigest() if said else ""

    return run


def test_alignment_against_whole_texts(spark, brute):
    texts = [r[0] for r in duckdb.sql("SELECT text FROM '/root/testdata/sf0.001/documents.parquet'").fetchall()]
    texts += [
        None, "", " ", "  two  spaces ", "▁ is a space of its own", "good ▁ bad", "<|endoftext|> <s></s><unk> <0x41> <0xZZ>", "\x00nul \x1c a\x85b\xa0c　d  e\n\n f\r\n", "é à ñ日本語 テスト 😀 👩‍👩‍👧",
        "x" * 20_000, "ab " * 20_000, "fi ligature ﬁ ½ Å", "don't we'll I'd", "1234567890 3.14", "\t\ttabs\t end ", texts[0], texts[0],
    ]
    rows = [(k, t, "x", "y") for k, t in enumerate(texts)]
    docs = spark.createDataFrame([*rows, (None, "null id", "x", "y")], SCHEMA).repartition(5)
    want = list(brute([*texts, "null id"]))
    found = {r[0]: tuple(r)[1:] for r in align.alignment(docs, FILES, digest=True).collect()}
    assert len(found) == len(want)
    for k, row in enumerate(want):
        assert found[k if k < len(texts) else None] == row, texts[k]
    shown = {r.doc_id: r.groups for r in align.alignment(docs, FILES).collect()}
    assert all(hashlib.sha256(g.encode()).hexdigest() == found[k][-1] if g else found[k][-1] == "" for k, g in shown.items())


def test_ranks_are_the_vocabulary_in_order():
    model = json.load(open(FILES[0], encoding="utf-8"))["model"]
    ids = [model["vocab"]["".join(x) if isinstance(x, list) else x.replace(" ", "", 1)] for x in model["merges"]]
    assert ids == sorted(ids)  # so that merging the lowest id first is merging in the order of the merges


def test_minimal_perfect_hash():
    rng = np.random.default_rng(5)
    for n in (0, 1, 2, 1000, 50_000):
        keys = np.unique(rng.integers(0, 1 << 40, n, dtype=np.uint64))
        sizes, bits = mph.built(keys)
        at = mph.Hashed(sizes, bits).at(keys)
        assert sorted(at.tolist()) == list(range(len(keys))) and sum(sizes) <= 4.5 * max(len(keys), 30)
        ordered = np.empty_like(keys)
        ordered[at] = keys
        others = keys + np.uint64(1 << 41)
        assert (mph.Hashed(sizes, bits, ordered).at(others) == -1).all()


def test_empty_table(spark):
    none = align.alignment(spark.createDataFrame([], SCHEMA), FILES, digest=True)
    assert none.collect() == [] and none.columns == ["doc_id", *align.COLUMNS, "groups_sha256"]
