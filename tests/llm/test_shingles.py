"""Texts alike by SimHash and shingle sets against brute-force Jaccard of five-word shingles, with edited copies."""

import random
import re

import corpus_pipeline
import numpy as np
from lynceus.llm import simhash

from .test_operators import components, prose


def jaccard(a, b):
    sets = []
    for text in (a, b):
        words = (text or "").lower().split()
        sets.append({tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set())
    x, y = sets
    return len(x & y) / len(x | y) if x | y else 1.0


def edited(rng, text, n):
    words = text.split()
    for k in rng.sample(range(len(words)), n):
        words[k] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


def planted():
    rng, common = random.Random(5), prose(999, 30)
    rows = [(i, prose(i, rng.randrange(40, 160)) + (" " + common if i % 2 else "")) for i in range(60)]
    for i in range(40):  # from one changed word to far too many
        base = rows[i][1]
        rows.append((100 + i, edited(rng, base, 1 + i % 6)))
    rows += [(200 + i, edited(rng, rows[50][1], rng.randrange(3))) for i in range(60)]  # one large group
    rows += [(300, None), (301, ""), (302, "two words"), (303, "Two  WORDS"), (304, "two others"), (305, rows[0][1].upper())]
    return rows


def test_similar_texts_are_linked_and_no_others(spark):
    rows = planted()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    texts = dict(rows)
    ids = sorted(texts)
    alike = {(a, b): jaccard(texts[a], texts[b]) for a in ids for b in ids if a < b}
    pairs = [p for p, x in alike.items() if x >= 0.8]
    assert len(pairs) > 200 and any(texts[a] and texts[a].lower() != texts[b].lower() for a, b in pairs)
    want = components(pairs, ids)
    got = {r.doc_id: r.component_id for r in simhash.similar_texts(docs).collect()}
    assert all(want[got[i]] == want[i] for i in ids)  # no link but those of similar pairs
    sure = components([p for p in pairs if alike[p] >= 0.9], ids)
    assert all(got[i] == got[sure[i]] for i in ids)
    gone = [i for i in ids if want[i] != i]
    assert sum(got[i] != i for i in gone) >= 0.95 * len(gone)
    kept = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()}
    assert kept == {i for i in ids if got[i] == i}


def test_nothing_and_null_ids(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.similar_texts(empty).count() == 0
    docs = spark.createDataFrame([(None, "a b c d e f"), (4, "a b c d e f"), (4, "a b c d e f"), (None, "x")], "doc_id long, text string")
    got = [(r.doc_id, r.component_id) for r in simhash.similar_texts(docs).collect()]
    assert sorted(got, key=str) == sorted([(None, 4), (4, 4), (4, 4), (None, None)], key=str)


def test_parts_meet_in_a_bucket_once_however_many_texts_have_them(spark):
    rng = np.random.default_rng(8)
    base = rng.integers(0, 1 << 32, simhash.PARTS, dtype=np.uint64)
    fps = np.repeat(base[None], 400, axis=0)
    for row in fps:  # near copies: some parts differ from the first text's in up to three bits
        for k in rng.choice(simhash.PARTS, 6, replace=False):
            row[k] ^= np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 32, int(rng.integers(1, 4)), dtype=np.uint64))
    words = fps[:, 0::2] | fps[:, 1::2] << np.uint64(32)
    rows = [(i, w.view(np.int64).tolist()) for i, w in enumerate(words)]
    distinct = spark.createDataFrame(rows, "node long, fp array<long>")
    parts = simhash.parts_of(distinct)
    held = {(r.part, r.node) for r in parts.collect()}
    assert held == {((k << 32) | int(x), i) for i, row in enumerate(fps) for k, x in enumerate(row)}
    met = {}
    for r in simhash.collisions(distinct, parts).collect():
        met.setdefault(r.sig, []).append(r.part)
    each, texts = sorted({p for p, _ in held}), {}
    for p, i in held:
        texts.setdefault(p, set()).add(i)
    together = {(a, b) for x in met.values() for a in x for b in x if a < b}
    close = {(a, b) for i, a in enumerate(each) for b in each[i + 1 :] if a >> 32 == b >> 32 and (a ^ b).bit_count() <= 2}
    assert together <= close
    # two texts that meet alone do so once; whatever else meets does so at every part
    of = lambda pairs: {(min(i, j), max(i, j)) for a, b in pairs for i in texts[a] for j in texts[b]}
    assert of(together) == of(close)
    assert all(len(texts[a]) == len(texts[b]) == 1 for a, b in close - together)
    # each part is in less than half of its 33 buckets, and is there once for all texts that have it
    assert sum(map(len, met.values())) < 16 * len(each) and all(len(set(x)) == len(x) for x in met.values())
    assert len(each) < len(held) / 2


def test_rows_of_buckets_are_shuffled_as_one_number(spark):
    """A row for each part and variant is most of what near-dedup shuffles: beside the variant it has the place of a bit."""
    rng = np.random.default_rng(7)
    base = rng.integers(0, 1 << 32, 60)
    near = [int(x) ^ (1 << int(a)) ^ (1 << int(b)) for x in base for a, b in rng.integers(0, 32, (4, 2))]
    parts = sorted({int(x) + (k << 32) for k in (0, 15) for x in [*base.tolist(), *near]})
    rows = simhash.company(spark.createDataFrame([(x,) for x in parts], "part long"))
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    dealt = re.search(r"RepartitionByExpression.*\n.*?Project \[([^\]]*)\]|RepartitionByExpression.*\n.*Generate .*\[(v#\d+L)\]", plan)
    assert dealt and "," not in (dealt[1] or dealt[2]), plan
    buckets = {}
    for sig, part in rows.collect():
        assert (sig ^ part).bit_count() <= 1
        buckets.setdefault(sig, set()).add(part)
    met = [frozenset((a, b)) for x in buckets.values() for a in x for b in x if a < b]
    near = {frozenset((a, b)) for a in parts for b in parts if a < b and (a ^ b) >> 32 == 0 and (a ^ b).bit_count() <= 2}
    assert near and set(met) == near
