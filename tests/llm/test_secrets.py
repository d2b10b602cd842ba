"""Operator 13: base spans against a plain scan, the battery against simulation, discoveries against planted runs."""

import hashlib
import math
import random
import re
import string

import numpy as np
import pytest

from lynceus.llm import queries, secrets

SCHEMA = "doc_id long, text string, start string, spans string"
WORDS = "river stone market teacher window morning letter garden promise station between company without another picture".split()


def base_of(text):
    found = []
    for kind, pattern, group, least in (
        ("assign", r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
        ("access", "AKIA[A-Z0-9]+", 0, 20), ("hex", "[0-9a-f]+", 0, 24),
    ):
        found += [(m.start(), kind, m.end()) for m in re.finditer(pattern, text) if len(m[group]) >= least]
    return sorted(found, key=lambda x: (x[0], ("assign", "access", "hex").index(x[1])))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    pick = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    prose = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    out = [prose(150) for _ in range(700)]
    for i in range(0, 120):
        letters = (string.ascii_letters + string.digits, "0123456789abcdef", string.ascii_letters + string.digits + "+/")[i % 3]
        out[i] += " " + pick(letters, 20 + 8 * (i % 5)) + " " + prose(20)
    for i in range(120, 240):
        out[i] += " " + "_".join(rng.choice(WORDS) for _ in range(5)) + " see/" + "/".join(rng.choice(WORDS) for _ in range(4))
    odd = [
        None, "", " ", 'PassWord = "abc.d=e-f" token:short secret: x12345', "AKIA" + "Z" * 15, "AKIA" + "Z" * 16 + "a", "é😀 api_key=" + "9" * 8, "ſecret=abcdefgh toKen=abcdefgh",
        "0" * 24 + "g" + "f" * 23, "password" * 3 + "=" * 3 + "aaaaaaa", "AKIAAKIA" + "B" * 14, "x" * 300_000, "password " + " " * 100_000 + ": hunter22", "a1" * 50_000,
    ]
    return out + odd


def test_base_spans_and_planted_runs(spark, texts):
    rows = [(i, t, "x", "y") for i, t in enumerate(texts)] + [(None, "token=abcdefg", "x", "y"), (3, texts[3], "x", "y")]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    found = secrets.digests(secrets.scan(docs)).collect()
    assert len(found) == len(rows)
    hits = wrong = 0
    for r in found:
        text = "token=abcdefg" if r.doc_id is None else texts[r.doc_id] or ""
        base = base_of(text)
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == name for _, k, _ in base) for name in ("assign", "access", "hex"))
        said = [f"{k}:{a}:{b}" for a, k, b in base]
        assert r.base_sha256 == hashlib.sha256(",".join(said).encode()).hexdigest()
        spans = r.spans.split(",") if r.spans else []
        assert [x for x in spans if not x.startswith("random")] == said
        order = [(int(a), secrets.KINDS.index(k)) for k, a, _ in (x.split(":") for x in spans)]
        assert order == sorted(order)
        if r.doc_id is not None and r.doc_id < 700:
            hits += r.doc_id < 120 and bool(spans)
            wrong += r.doc_id >= 120 and bool(spans)
    assert hits >= 100 and wrong <= 3


def test_battery_is_uniform_on_random_symbols_and_low_on_text():
    rng = np.random.default_rng(3)
    for size in (10, 16, 36, 64):
        for n in (24, 64, 200):
            p = secrets.battery(rng.integers(0, size, 2000 * n).astype(np.int8), np.full(2000, n), size)
            assert abs((p < 0.5).mean() - 0.5) < 0.08 and (p < 0.01).mean() < 0.04
    text = np.frombuffer("".join(WORDS * 40).encode(), np.uint8)[: 24 * 100]
    assert (secrets.battery(secrets._SYMBOL[6][text], np.full(100, 24), 62) < 1e-3).mean() > 0.95
    for pattern in ([5] * 40, list(range(16)) * 3, [0, 15] * 20):  # constant, rising, alternating
        assert secrets.battery(np.array(pattern, np.int8), np.array([len(pattern)]), 16)[0] < 1e-3


def test_every_symbol_of_text_is_in_a_window_of_every_encoding_and_class():
    rng = random.Random(5)
    texts = [" ".join(rng.choice(WORDS) for _ in range(n)) for n in (0, 3, 40, 700)] + ["9 " * 300 + "AB cd " * 50]
    groups = np.bincount(secrets.decoys_of(texts) // secrets.BINS, minlength=len(secrets.ENCODINGS) * len(secrets.CLASSES))
    want = []
    for _, letters in secrets.ENCODINGS:
        held = [sum(x in letters for x in t) for t in texts]
        want += [sum(-(-n // c) for n in held if n >= c) for c in secrets.CLASSES]
    assert groups.tolist() == want


def test_windows_have_what_the_battery_says_of_each():
    rng = np.random.default_rng(6)
    for e, (_, letters) in enumerate(secrets.ENCODINGS):
        size = len(letters)
        # highest symbols, so many that the running sums wrap round, then random and constant ones
        symbols = np.concatenate([np.full(600_000, size - 1), rng.integers(0, size, 3000), np.full(300, 2)]).astype(np.int8)
        measured = secrets.windows(symbols, size)
        for length in secrets.CLASSES:
            starts = np.concatenate([np.arange(0, 400, 7), np.arange(599_000, len(symbols) - length + 1, 5), [len(symbols) - length]])
            apart = symbols[(starts[:, None] + np.arange(length)).ravel()]
            assert (measured(starts, length) == secrets.battery(apart, np.full(len(starts), length), size)).all()


def test_tail_is_that_of_a_normal():
    z = np.linspace(-9, 30, 4001)
    want = np.array([math.erfc(x / math.sqrt(2)) / 2 for x in z])
    assert (abs(secrets._tail(z) - want) <= 2e-7 * want).all()


def test_empty_table_and_query(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert secrets.digests(secrets.scan(none)).collect() == []
    made = queries.op13_secret_scan(spark, "/root/testdata/sf0.001")
    assert made.columns == ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"] and made.count() == 200
