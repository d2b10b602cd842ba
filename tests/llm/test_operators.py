"""The numbered operators against brute force, on small tables with every odd case that they may meet."""

import hashlib
import html
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from lynceus.llm import bpe, decontam, extract, hpylm, licenses, quality, queries, simhash, substring, urlrules, warc
from lynceus.llm.words import Words, windows

SCHEMA = "doc_id long, text string, lang string, stats string"
LOREM = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(seed, n=60):
    rng = random.Random(seed)
    return " ".join(rng.choice(LOREM) + str(rng.randrange(30)) for _ in range(n))


@pytest.fixture(scope="module")
def documents():
    """Nulls, empty and blank texts, exact and near copies, repeated rows, one long text, clashing column names."""
    base = prose(1)
    shared = prose(77, 55)
    rows = [
        (1, base), (2, base), (3, base.replace("alpha", "alfa", 1)), (4, None), (5, ""), (6, " \n\t "), (7, "Élan ÉTÉ straße\x0bMIT License"),
        (8, prose(2) + " " + shared), (9, shared + " " + prose(3)), (10, prose(4, 6000)), (10, prose(4, 6000)), (11, "one two"),
        (None, base), (12, "a b c d e f\n" * 9), (13, "licensed under the Apache License, CC BY, GNU general public license"),
        (14, "#### $$ %% && | | | <> !!! " * 9), (15, prose(5) + "    日本語 ŧ"),
    ]
    return [(i, t, "en", "x") for i, t in rows]


@pytest.fixture(scope="module")
def docs(spark, documents):
    return spark.createDataFrame(documents, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def lower(text):
    return (text or "").encode().lower()


def test_words_and_windows():
    texts = [b"a bb  ccc\n", b"", b"  ", "é a bb".encode(), b"ccc"]
    w = Words(texts)
    hashes, words = w.hashes(1), [x for t in texts for x in t.split()]
    assert np.diff(w.first).tolist() == [len(t.split()) for t in texts]
    assert all((hashes[i] == hashes[j]) == (words[i] == words[j]) for i in range(len(words)) for j in range(len(words)))
    keys, at = windows(hashes, w.first, 2, 1)
    assert at.tolist() == [0, 1, 3, 4] and keys[0] == keys[3] and len(set(keys.tolist())) == 3
    assert len(windows(hashes, w.first, 9, 1)[0]) == 0


# ---------------------------------------------------------------- 1


def test_tiling_finds_reordered_passages(spark, docs, none):
    first, second, short = prose(50, 20), prose(51, 20), "only three words"
    items = spark.createDataFrame([(1, first + " " + second), (2, short), (3, None), (4, ""), (None, first)], "item_id long, text string")
    rows = [(1, second + " xx yy " + first.upper() + "."), (2, first[:60]), (3, prose(9) + " " + short + " " + prose(8)), (4, None), (5, prose(60, 3000))]
    found = decontam.leaks(spark.createDataFrame(rows, "doc_id long, text string"), items).collect()
    assert {(r.doc_id, r.item_id) for r in found} == {(1, 1), (1, None), (3, 2)}
    one = next(r for r in found if r.item_id == 1)
    assert one.coverage == 1.0 and sorted(t.item_word for t in one.tiles) == [0, 20] and one.matched_words == 40
    kept = decontam.clean(spark.createDataFrame(rows, "doc_id long, text string"), items)
    assert {r.doc_id for r in kept.collect()} == {2, 4, 5}
    assert decontam.leaks(none, items).count() == 0 and decontam.leaks(docs, items.limit(0)).count() == 0


def covered(text, item, tile=5):
    """Item words that greedy tiling of two word lists marks, by looking everywhere for the longest match."""
    size, used, marks = min(tile, len(item)), set(), set()
    while size:
        best = (0, 0, 0)
        for i, j in itertools.product(range(len(text)), range(len(item))):
            n = 0
            while i + n < len(text) and j + n < len(item) and text[i + n] == item[j + n] and i + n not in used and j + n not in marks:
                n += 1
            best = min(best, (-n, i, j))
        n, i, j = -best[0], best[1], best[2]
        if n < size:
            break
        used |= set(range(i, i + n))
        marks |= set(range(j, j + n))
    return len(marks)


def test_leaks_against_brute_force(spark):
    rng = random.Random(12)
    words = "yes no a b c d".split()
    text = lambda n: " ".join(rng.choice(words[: rng.choice([2, 4, 6])]) for _ in range(n))
    items = [(k, text(rng.randrange(1, 24))) for k in range(25)] + [(None, text(9)), (3, text(8)), (7, None), (8, "")]
    rows = [(k, text(rng.randrange(0, 50))) for k in range(25)] + [(5, None), (None, items[0][1]), (6, items[1][1]), (6, items[1][1])]
    want = Counter()
    for (i, t), (k, x) in itertools.product(rows, items):
        item = (x or "").split()
        if item and (n := covered((t or "").split(), item)) >= 0.5 * len(item):
            want[i, k, len(item), n] += 1
    columns = "item_id long, text string, coverage string"
    bench = spark.createDataFrame([(*x, "c") for x in items], columns)
    docs = spark.createDataFrame([(*x, "c", 1) for x in rows], "doc_id long, text string, item_id string, coverage int")
    got = decontam.leaks(docs, bench).collect()
    assert Counter((r.doc_id, r.item_id, r.item_words, r.matched_words) for r in got) == want
    bad = {(i, t) for (i, t), (k, x) in itertools.product(rows, items) if (x or "").split() and covered((t or "").split(), x.split()) >= 0.5 * len(x.split())}
    kept = decontam.clean(docs, bench)
    assert kept.columns == docs.columns and Counter((r.doc_id, r.text) for r in kept.collect()) == Counter(x for x in rows if x not in bad)


def test_tiling_of_long_repetitive_texts():
    text, item = b"yes no " * 100_000, b"yes no " * 300
    assert decontam.tiled(text, item, 5) == [(0, 0, 600)]
    half = b"x " + b"yes no " * 60_000 + b"yes yes " * 9
    got = decontam.tiled(half, b"yes no yes yes yes yes yes", 5)
    assert sum(t[2] for t in got) == 7


def test_tiles_against_brute_force():
    rng = random.Random(3)
    for _ in range(60):
        a, b = [[rng.randrange(3) for _ in range(rng.randrange(4, 16))] for _ in range(2)]
        text, item, want = set(), set(), []
        while True:
            best = None
            for i, j in itertools.product(range(len(a)), range(len(b))):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and i + n not in text and j + n not in item:
                    n += 1
                if n >= 2 and (best is None or (-n, i, j) < best):
                    best = (-n, i, j)
            if best is None:
                break
            n, i, j = -best[0], best[1], best[2]
            want.append((i, j, n))
            text |= set(range(i, i + n))
            item |= set(range(j, j + n))
        assert decontam.tiles(np.array(a) + 1, np.array(b) + 1, 2) == sorted(want)


# ---------------------------------------------------------------- 2


def test_warc_links_and_digests(spark):
    pages = [(1, "http://a.example/x", "<title>T &amp; U</title><p>one<br>two</p><script>x</script><a href=\"/y\">z</a>"), (2, None, None)]
    rows = warc.derivatives(warc.responses(spark.createDataFrame(pages, "page_id long, url string, html string"))).collect()
    assert len(rows) == 4
    for r in rows:
        assert r.content_length == len(r.block.encode()) and r.block_digest == "sha256:" + hashlib.sha256(r.block.encode()).hexdigest()
        other = next(x for x in rows if x.record_id == r.concurrent_to)
        assert other.refers_to == r.refers_to and other.page_id == r.page_id and f"WARC-Refers-To: {r.refers_to}\r\n" in r.header
    text = next(r for r in rows if r.page_id == 1 and r.warc_type == "conversion")
    assert text.block == "one\ntwo\nz"
    fields = next(r for r in rows if r.page_id == 1 and r.warc_type == "metadata").block
    assert "title: T & U\r\n" in fields and "outlink: /y\r\n" in fields and "source-Content-Type: text/html" in fields


def test_warc_references_links_and_records(spark, tmp_path):
    page = (
        "<title>A &eacute;&#8217;&#x27; &mdash; &nope; B</title><p>x &amp;lt; y &copy; &#0;</p>"
        "<a class=k href='/one two'>1</a><A HREF = \"/two?a=1&amp;b\">2</A><a\nhref=/three>3</a><a data-href=\"/no\">4</a>"
    )
    pages = [(1, "http://a.example/x y\r\nEvil: 1", page), (2, None, None), (2, None, None), (3, "http://b.example/", "<p>" + "long text. " * 40_000)]
    docs = spark.createDataFrame([(*x, "clash", "clash") for x in pages], "page_id long, url string, html string, record_id string, block string")
    made = warc.derivatives(warc.responses(docs)).cache()
    meta = made.filter("page_id = 1 and warc_type = 'metadata'").first()
    lines = meta.block.split("\r\n")
    assert lines[0] == "title: A é’' — &nope; B"
    assert [x for x in lines if x.startswith("outlink")] == ["outlink: /one two", "outlink: /two?a=1&b", "outlink: /three"]
    text = made.filter("page_id = 1 and warc_type = 'conversion'").first()
    assert text.block.split("\n")[0] == "x &lt; y © \ufffd" and "WARC-Target-URI: http://a.example/x%20y%0D%0AEvil:%201\r\n" in text.header
    uuid = re.compile(r"<urn:uuid:[0-9a-f]{8}-[0-9a-f]{4}-8[0-9a-f]{3}-8[0-9a-f]{3}-[0-9a-f]{12}>")
    assert all(uuid.fullmatch(r.record_id) for r in made.collect())
    warc.write_records(made, str(tmp_path / "out"))
    raw = b"".join(f.read_bytes() for f in (tmp_path / "out").glob("part-*"))
    found, at = Counter(), 0
    while at < len(raw):  # a reader that goes by the stated lengths
        end = raw.index(b"\r\n\r\n", at)
        head = dict(x.split(": ", 1) for x in raw[at:end].decode().split("\r\n")[1:])
        size = int(head["Content-Length"])
        block = raw[end + 4 : end + 4 + size]
        assert raw[at : at + 10] == b"WARC/1.1\r\n" and raw[end + 4 + size : end + 8 + size] == b"\r\n\r\n"
        assert head["WARC-Block-Digest"] == "sha256:" + hashlib.sha256(block).hexdigest()
        found[head["WARC-Record-ID"], block.decode()] += 1
        at = end + 8 + size
    assert found == Counter((r.record_id, r.block) for r in made.collect())
    back = warc.read_records(spark, str(tmp_path / "out")).collect()
    assert all(r.whole for r in back) and Counter((r.record_id, r.block) for r in back) == found
    assert warc.derivatives(warc.responses(docs.limit(0))).count() == 0


# ---------------------------------------------------------------- 3


def test_url_rules_against_every_rule(spark):
    urls = ["http://A.Example.org/es/1?x", "http://example.org/en/12", "https://b.example.org/en/2", "http://xexample.org/es/", "ftp://h.com/fr/", "http://h.com/de",
            "http://h.com/de/#a", "http://h.net?q=/fr/", None, "", "no scheme", "http://", "http://ads.x.net/a", "http://x.net/login?z", "http://x.net/blogin", "http://x.net/a?sessionid=3",
            "http://archive.x.net/print/1.html", "http://x.net/print/q/1.html", "http://é.net/ü/cart"]
    frame = spark.createDataFrame([(i, u, "old") for i, u in enumerate(urls + urls[:3])], "page_id long, url string, verdict string")
    patterns = [(p, p, a, "pattern") for p, a in urlrules.DEFAULT_PATTERNS]
    rules = urlrules.rules_table(spark, urlrules.host_rules(queries.HOST_RULES) + patterns)
    rows = urlrules.judge(frame, rules).collect()
    assert len(rows) == len(urls) + 3
    for r in rows:
        rest = (urls + urls[:3])[r.page_id] or ""
        rest = rest.split("://", 1)[1] if "://" in rest else ""
        raw = re.match(r"[^/?#]*", rest)[0]
        host, path = raw.lower(), re.match(r"[^?#]*", rest[len(raw) :])[0]
        fits = [(len(x), x, a) for a, x in queries.HOST_RULES if (host == x.split("/")[0] or host.endswith("." + x.split("/")[0])) and path.startswith("/" + x.split("/", 1)[1])]
        address = host + re.match(r"[^#]*", rest[len(raw) :])[0]
        more = {a for p, a in urlrules.DEFAULT_PATTERNS if re.search(urlrules.compiled(p), address)}
        want = max(fits)[2] if fits else "allow" if "allow" in more or not more else "block"
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, max(fits)[1] if fits else None, want), r
    assert urlrules.judge(frame.limit(0), rules).count() == 0


def test_url_rules_of_odd_urls(spark):
    rows = [(k, None, "p") for k in range(40)] + [(50, "", "p"), (51, "x", "p"), (52, "http://a.org/" + "y/" * 60_000, "p"), (53, "HTTP://SUB.Example.org/es/1?a#b", "p"), (53, "HTTP://SUB.Example.org/es/1?a#b", "p")]
    rules = urlrules.rules_table(spark, urlrules.host_rules(queries.HOST_RULES) + [("*", "*", "allow", "pattern")])
    out = urlrules.judge(spark.createDataFrame(rows, "page_id long, url string, part string"), rules).collect()
    assert len(out) == len(rows) and all(r.host == "" and r.path == "" and r.rule is None and r.verdict == "allow" for r in out if r.page_id < 52)
    assert next(r for r in out if r.page_id == 52).rule == "org/" and [r.rule for r in out if r.page_id == 53] == ["example.org/es/"] * 2
    assert urlrules.judge(spark.createDataFrame([], "page_id long, url string"), rules).count() == 0


# ---------------------------------------------------------------- 4


def test_license_scan_against_brute_force(spark, docs, documents, none):
    rows = licenses.scan(docs, licenses.templates_table(spark)).collect()
    assert len(rows) == len(documents)
    want = Counter()
    for i, text, *_ in documents:
        words = [w.decode() for w in re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))]
        at = [(k, label) for phrase, label in licenses.PHRASES for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.split()]
        places = [k for k, _ in at]
        want[i, len(words), len(at), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in at}))] += 1
    assert Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in rows) == want
    assert licenses.scan(none, licenses.templates_table(spark)).count() == 0


def test_license_notice_with_changes(spark):
    text = "x y Permission is hereby granted, free of ANY charge, to any person obtaining this copy of this software z"
    rows = licenses.scan(spark.createDataFrame([(1, text), (2, "permission is hereby refused")], "doc_id long, text string"), licenses.templates_table(spark)).collect()
    assert {r.doc_id: r.labels for r in rows} == {1: "mit", 2: ""} and all(0 <= r.score <= 1 for r in rows)


# ---------------------------------------------------------------- 5


def fingerprint(text):
    words = lower(text).split()
    shingles = [b" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))] if words else []
    counts = [sum(xxhash.xxh64_intdigest(s, 42) >> b & 1 for s in shingles) for b in range(64)]
    return sum(1 << b for b in range(64) if shingles and 2 * counts[b] > len(shingles))


def components(pairs, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_simhash_against_all_pairs(docs, documents, none):
    rows = simhash.near_duplicates(docs).collect()
    assert len(rows) == len(documents)
    prints = {(i, t): fingerprint(t) for i, t, *_ in documents}
    fps = sorted(set(prints.values()))
    roots = components([(a, b) for a, b in itertools.combinations(fps, 2) if (a ^ b).bit_count() <= 4], fps)
    least = {}
    for (i, _), fp in prints.items():
        if i is not None:
            least[roots[fp]] = min(least.get(roots[fp], i), i)
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in rows) == Counter((i, f"{prints[i, t]:016x}", least.get(roots[prints[i, t]])) for i, t, *_ in documents)
    assert simhash.near_duplicates(none).count() == 0


def test_simhash_links_none_is_lost(spark):
    rng = random.Random(5)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    fps = {rng.getrandbits(64) for _ in range(40)}
    for fp in list(fps):
        for _ in range(3):
            for b in rng.sample(range(64), rng.randrange(1, 6)):
                fp ^= 1 << b
            fps.add(fp)
    links = simhash.links(spark.createDataFrame([(signed(x),) for x in fps], "fp long"))
    tree = {r.node: r.root for r in simhash.components(links).collect()}
    order = {signed(x): x for x in fps}
    nodes = sorted(order)
    want = components([(a, b) for a, b in itertools.combinations(nodes, 2) if (order[a] ^ order[b]).bit_count() <= 4], nodes)
    assert {n: tree.get(n, n) for n in nodes} == want


# ---------------------------------------------------------------- 6


def test_quality_statistics_and_list(spark, docs, documents, none):
    labels = spark.createDataFrame([(1, 1), (14, 0), (None, 1), (3, None)], "doc_id long, quality int")
    rows = quality.judge(docs, labels).select("doc_id", "text", "lang", *[F.col(f"stats.{x}") for x in quality.BASE], "base_failed", "kept").collect()
    assert len(rows) == len(documents)
    for r in rows:
        text = r.text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        grams = Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))
        covered = {k + j for k in range(len(words) - 4) if grams[tuple(words[k : k + 5])] > 1 for j in range(5)}
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (len(words) < 10 or 100 * len(covered) > 20 * len(words)) and not (r.kept and r.base_failed)
    assert quality.judge(none, labels).count() == 0


def test_learned_verdicts_on_held_out_labels(spark):
    """The list learned from one half of the labels, on the documents of the other half that no base rule rejects."""
    docs, labels = (queries.table(spark, "/root/testdata/sf0.1", x) for x in ("documents", "labels"))
    judged = quality.judge(docs, labels.filter("doc_id % 2 = 0")).filter("not base_failed").join(labels.filter("doc_id % 2 = 1"), "doc_id")
    rows = judged.filter("quality is not null").groupBy("quality", "kept").count().collect()
    n = {(r.quality, r.kept): r["count"] for r in rows}
    good, bad = n.get((1, True), 0), n.get((0, False), 0)
    print("kept of good", good / (good + n.get((1, False), 0)), "rejected of bad", bad / max(1, bad + n.get((0, True), 0)))
    assert good > 0.95 * (good + n.get((1, False), 0)) and good + bad > 0.8 * sum(n.values())


def test_decision_list_learns_thresholds():
    rng = random.Random(1)
    rows = [{"a": rng.random(), "b": rng.random(), "bad": 0} for _ in range(900)]
    for r in rows:
        r["bad"] = int(r["a"] > 0.8 or (r["b"] < 0.2 and r["a"] < 0.3))
    rules = quality.learn(rows, ["a", "b"])
    test = [{"a": rng.random(), "b": rng.random()} for _ in range(900)]
    said = [any(all(c.holds(r) for c in rule) for rule in rules) for r in test]
    assert sum(s == (r["a"] > 0.8 or (r["b"] < 0.2 and r["a"] < 0.3)) for s, r in zip(said, test)) > 860
    assert quality.learn([], ["a"]) == [] and quality.learn([{"a": 1.0, "bad": 0}] * 9, ["a"]) == []


# ---------------------------------------------------------------- 7


def test_bpe_as_the_library(docs, documents, none):
    path = public_tokenizers.path(queries.VOCABULARY)
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks_of(path), special_tokens={})
    rows = bpe.encode_decode(docs, path, public_tokenizers.PATTERN, carry=("lang",)).collect()
    texts = Counter((i, t or "") for i, t, *_ in documents)
    assert Counter((r.doc_id, r.decoded) for r in rows) == texts
    for r in rows:
        ids = own.encode_ordinary(r.decoded)
        assert r.token_ids == ids and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(r.decoded.encode()).hexdigest()
    assert bpe.encode_decode(none, path, public_tokenizers.PATTERN).count() == 0


@pytest.mark.parametrize("text", ["a" * 700, "ab" * 600 + "c", "=====-----" * 120, "thtion" * 400, "日本語テキスト" * 90, "".join(random.Random(4).choices("abcdef", k=1500))])
def test_bpe_long_pieces(text):
    path = public_tokenizers.path(queries.VOCABULARY)
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks_of(path), special_tokens={})
    with bpe.coder(path, public_tokenizers.PATTERN) as coder:
        ids, joined = coder.encode([text])
    assert ids[0].tolist() == own.encode_ordinary(text) and joined[0] == ",".join(map(str, ids[0].tolist()))


def test_bpe_very_long_pieces_and_clashing_names(spark):
    path = public_tokenizers.path(queries.VOCABULARY)
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks_of(path), special_tokens={})
    rng = random.Random(5)
    letters = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=30_000))
    rows = [(1, letters, "x"), (2, "a" * 200_000, "x"), (3, "xyz" * 900, "x"), (4, None, None)]
    coded = bpe.encode_decode(spark.createDataFrame(rows, "doc_id long, text string, token_ids string"), path, public_tokenizers.PATTERN, carry=("token_ids",))
    got = {r.doc_id: r.token_ids for r in coded.collect()}
    assert got[1] == own.encode_ordinary(letters) and got[3] == own.encode_ordinary("xyz" * 900) and got[4] == []
    assert len(got[2]) == 50_000 and set(got[2]) == set(own.encode_ordinary("aaaa"))


# ---------------------------------------------------------------- 8


def test_pitman_yor_of_a_long_text(spark):
    rows = [(k, "lorem ipsum dolor " * (20_000 if k == 3 else 5)) for k in range(12)] + [(None, "lorem"), (3, "lorem ipsum")]
    out = hpylm.score(spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, score double")).collect()
    long = next(r for r in out if r.n_tokens > 60_000)
    assert len(out) == 14 and long.n_tokens == 60_001 and math.isfinite(long.score) and long.score > -20_000


def test_pitman_yor_base_and_proper(docs, documents, none):
    rows = hpylm.score(docs).collect()
    assert len(rows) == len(documents)
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    tokens = [(i, lower(t).split() + [None]) for i, t, *_ in documents]
    counts = Counter(x for i, w in tokens if not held(i) for x in w)
    n, v = sum(counts.values()), len(counts)
    want = Counter((i, held(i), len(w), sum(counts[x] > 0 for x in w), n, round(sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w), 6)) for i, w in tokens)
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in rows) == want
    assert all(r.score < 0 for r in rows)
    assert hpylm.score(none).count() == 0


@pytest.mark.parametrize("customers, weight", [(1, 3.0), (2, 0.5), (5, 0.1), (30, 1.3), (30, 40.0), (200, 5.0), (2000, 3.0), (2000, 900.0), (5000, 0.6)])
def test_pitman_yor_tables_against_enumeration(customers, weight):
    """One customer after the other: j others at t tables give j - t / 2 seats, and ``weight`` a new table."""
    ways = np.zeros(customers + 2)
    ways[1], t = weight, np.arange(customers + 2)
    for j in range(1, customers):
        ways = np.maximum(j - 0.5 * t, 0) * ways + weight * np.concatenate(([0], ways[:-1]))
        ways /= ways.max()
    drawn = hpylm.tables_drawn(np.full(20_000, customers), np.full(20_000, weight), np.random.default_rng(2))
    assert drawn.min() >= 1 and drawn.max() <= customers
    assert abs(drawn.mean() - (ways * t).sum() / ways.sum()) < 0.02 * drawn.mean()


def seated_one_by_one(leaves, rounds, seed=3):
    """Mean tables by (level, context, byte) of a chain that reseats single customers in two levels."""
    rng, d, s = random.Random(seed), hpylm.DISCOUNT, 2.0
    rooms = {u: {} for u in [*leaves, ""]}  # context -> byte -> table sizes

    def chance(u, w):
        above = 1 / 256 if u == "" else chance("", w)
        n, t = sum(map(sum, rooms[u].values())), sum(map(len, rooms[u].values()))
        own = rooms[u].get(w, [])
        return (sum(own) - d * len(own) + (s + d * t) * above) / (s + n)

    def add(u, w):
        tables = rooms[u].setdefault(w, [])
        t = sum(map(len, rooms[u].values()))
        fresh = (s + d * t) * (1 / 256 if u == "" else chance("", w))
        k = rng.choices(range(len(tables) + 1), [n - d for n in tables] + [fresh])[0]
        if k < len(tables):
            tables[k] += 1
        else:
            tables.append(1)
            if u != "":
                add("", w)

    def leave(u, w):
        tables = rooms[u][w]
        k = rng.choices(range(len(tables)), tables)[0]
        tables[k] -= 1
        if not tables[k]:
            del tables[k]
            if u != "":
                leave("", w)

    people = [(u, w) for u in leaves for w, c in leaves[u].items() for _ in range(c)]
    for u, w in people:
        add(u, w)
    sums = Counter()
    for r in range(rounds):
        for u, w in people:
            leave(u, w)
            add(u, w)
        if r >= rounds // 10:
            for u in rooms:
                for w, tables in rooms[u].items():
                    sums[u, w] += len(tables) / (rounds - rounds // 10)
    return sums


def test_pitman_yor_sweeps_against_single_customers():
    leaves = {"A": {"x": 12, "y": 1}, "B": {"x": 2, "z": 9}, "C": {"x": 1, "y": 3}}
    want = seated_one_by_one(leaves, 3000)
    grams = {ord(u) << 8 | ord(w): c for u in leaves for w, c in leaves[u].items()}
    keys = np.array(sorted(grams), np.uint64)
    tier = hpylm.Tier(keys, np.array([grams[int(k)] for k in keys]), 1, 0, np.random.default_rng(5), True, 2.0)
    sums = Counter()
    for r in range(12_000):
        tier.sweep(np.full(len(tier.outer), 1 / 256))
        if r >= 1000:
            for level in tier.levels:
                for g, t in zip(level.grams.tolist(), level.t.tolist()):
                    sums[chr(g >> 8) if g >> 8 else "", chr(g & 255)] += t / 11_000
    assert set(sums) == {k for k in want if want[k]}
    assert all(abs(sums[k] - want[k]) < 0.05 * want[k] for k in sums), (sums, want)


def test_pitman_yor_levels_sum_to_one():
    rng = np.random.default_rng(1)
    grams = np.unique(rng.integers(0, 4, 40).astype(np.uint64) << np.uint64(8) | rng.integers(0, 200, 40).astype(np.uint64))
    tier = hpylm.Tier(grams, rng.integers(1, 500, len(grams)), 1, 0, rng, True)
    for _ in range(4):
        tier.sweep(np.full(len(tier.outer), 1 / 256))
        assert all((level.t >= 1).all() and (level.t <= level.c).all() for level in tier.levels)
    every = np.arange(256, dtype=np.uint64) | np.uint64(2 << 8)
    assert abs(tier.predict(every, np.full(256, 1 / 256)).sum() - 1) < 1e-9


def kneser_ney(trained, text, order=5, discount=0.75):
    """log10 probability of a text's stream by interpolated Kneser-Ney over bytes."""
    pad = b"\n" * order
    counts = [Counter() for _ in range(order + 1)]
    for x in trained:
        x = pad + hpylm.stream(x)
        counts[order].update(x[k : k + order + 1] for k in range(len(x) - order))
    for n in range(order - 1, -1, -1):
        counts[n].update(g[1:] for g in counts[n + 1])
    sums = [(Counter(), Counter()) for _ in counts]
    for n, by in enumerate(counts):
        for g, c in by.items():
            sums[n][0][g[:-1]] += c
            sums[n][1][g[:-1]] += 1
    out, x = 0.0, pad + hpylm.stream(text)
    for k in range(order, len(x)):
        p = 1 / 256
        for n in range(order + 1):
            g = x[k - n : k + 1]
            if total := sums[n][0][g[:-1]]:
                p = (max(counts[n][g] - discount, 0) + discount * sums[n][1][g[:-1]] * p) / total
        out += math.log10(p)
    return out


def test_pitman_yor_beats_kneser_ney_on_held_out_text(spark):
    docs = queries.table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text")
    texts = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    held = {r.doc_id: r.score for r in hpylm.score(docs).filter("held_out").collect()}
    trained = [t for i, t in texts.items() if i not in held]
    assert held and sum(held.values()) > sum(kneser_ney(trained, texts[i]) for i in held)


# ---------------------------------------------------------------- 9


def removed(documents):
    first = {}
    key = lambda i: math.inf if i is None else i
    for i, t, *_ in documents:
        w = (t or "").split()
        for k in range(len(w) - 12):
            first[tuple(w[k : k + 13])] = min(first.get(tuple(w[k : k + 13]), math.inf), key(i))
    for i, t, *_ in documents:
        w = (t or "").encode().decode().split()
        gone = {k + j for k in range(len(w) - 12) if first[tuple(w[k : k + 13])] < key(i) for j in range(13)}
        yield i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)


def test_substring_dedup_against_brute_force(docs, documents, none):
    plain = [(i, None if t is None else t.replace(" ", "~"), *x) for i, t, *x in documents]
    frame = docs.withColumn("text", F.replace("text", F.lit(" "), F.lit("~")))
    rows = substring.dedup(frame, carry=("lang",)).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in rows) == Counter(removed(plain))
    assert substring.dedup(none).count() == 0


def test_untouched_texts_stay_as_they_are(docs):
    rows = substring.dedup(docs, tidy=False).filter("n_removed = 0 and doc_id = 12").collect()
    assert [r.kept_text for r in rows] == ["a b c d e f\n" * 9]


# ---------------------------------------------------------------- 10


def page(title, body, extra=""):
    return f'<html><head><title>t</title><script>var x="</p>";</script></head><body><nav><ul><li><a href="/a">Home</a></li></ul></nav><!-- c --><div class="ad">Buy {extra} now</div><article><h1>{title}</h1>{body}</article><footer>&copy; me</footer></body></html>'


def test_blocks_decode_and_nest():
    found = extract.blocks("<p>a&amp;b<b>c</b>\n d<p>&lt;x&gt;<br>y<script>no</script><!-- no --><div title='a>b'>z</div><p")
    assert [t for _, t, _ in found] == ["a&bc d", "<x> y", "z"]
    assert extract.blocks("") == [] and extract.blocks("<") == [((), "<", 0)]


def test_labeller_extracts_articles(spark):
    rng = random.Random(6)
    pages, want = [], {}
    for i in range(120):
        parts = [f"{prose(i * 50 + k, rng.randrange(1, 40))} &amp; so" for k in range(rng.randrange(1, 9))]
        pages.append((i, page(f"Title {i}", "".join(f"<p>{p}</p>" for p in parts), prose(i, 3))))
        want[i] = "\n".join([f"Title {i}", *map(html.unescape, parts)])
    pages += [(200, None), (201, ""), (202, "plain"), (0, pages[0][1])]
    rows = extract.extract(spark.createDataFrame(pages, "page_id long, html string")).collect()
    assert len(rows) == 124
    assert sum(r.text == want[r.page_id] for r in rows if r.page_id < 200) >= 119
    assert {r.page_id: r.text for r in rows if r.page_id in (200, 201)} == {200: "", 201: ""}
    assert extract.extract(spark.createDataFrame([], "page_id long, html string")).count() == 0


def test_labeller_on_held_out_layouts():
    rng = np.random.default_rng(8)
    texts = [[prose(k * 9 + j, int(rng.integers(3, 40))) for j in range(6)] for k in range(60)]
    pages = [page("A title", "".join(f"<p>{t}</p>" for t in x)) for x in texts]
    model = extract.trained(pages[:50], layouts=6)
    right = total = 0
    for x in texts[50:] * 6:
        html_, truth = extract.layout(x, [t[:60] for y in texts[:50] for t in y], rng)
        found = extract.blocks(html_)
        assert len(found) == len(truth)
        z = model.logits(*extract.padded([extract.vectors([found])]))[0, : len(found)] > 0
        right, total = right + int((z == np.array(truth)).sum()), total + len(truth)
    assert right / total > 0.93


#: Pages written by hand, in other layouts than those trained on, and which of their blocks are main text.
BY_HAND = [
    (
        "blog with classes",
        '<html><body><div class="topbar"><a href="/">Home</a> <a href="/b">Blog</a></div><div class="wrap"><div class="post-body"><h1>On rivers</h1><p>Rivers carry silt to the sea, and over many centuries they build the land on which cities stand today.</p><p>Short one.</p><p>Most of what they carry is fine clay, which stays in the water for days before it settles down.</p></div><div class="sidebar"><ul><li><a href="/1">Older posts</a></li><li><a href="/2">About</a></li></ul></div></div><div class="comments"><p>Nice article, thanks!</p><p>I do not agree at all with this.</p></div><div class="footer">© 2020 Rivers</div></body></html>',
        [0, 1, 1, 1, 1, 0, 0, 0, 0, 0],
    ),
    (
        "semantic",
        '<html><body><header><h2>The Daily</h2></header><nav><a href=1>World</a></nav><main><article><h1>Bread prices rise</h1><p>The price of bread rose again in March, the office said on Monday, by four per cent.</p><ul><li>Rye bread</li><li>Wheat bread</li></ul></article></main><aside>Subscribe to our letter</aside><footer>Contact us</footer></body></html>',
        [0, 0, 1, 1, 1, 1, 0, 0],
    ),
    (
        "opaque names",
        '<html><body><div class="q1"><a href=1>Start</a><a href=2>News</a></div><div class="z9"><h1>A walk in the hills</h1><p>We left the village before dawn and followed the old road up to the pass, where the snow still lay.</p><p>Later the weather turned, and we went down on the other side in heavy rain without seeing a soul.</p><p>It was dark when we came to the inn.</p></div><div class="k2"><p><a href=4>More walks</a></p><p><a href=5>Maps</a></p></div></body></html>',
        [0, 1, 1, 1, 1, 0, 0],
    ),
    (
        "table layout",
        '<table><tr><td><a href=a>Index</a></td><td class="text"><h2>Notes on tin</h2><p>Tin melts at a low heat and was therefore among the first metals that people cast in stone moulds.</p><p>It is rare.</p></td></tr></table><div id="cookie-notice">We use cookies. <button>OK</button></div>',
        [0, 1, 1, 1, 0, 0],
    ),
    (
        "advert inside",
        '<div id="content"><h1>Cats</h1><p>Cats sleep for most of the day, as hunters do that live on short and sudden bursts of effort.</p><div class="advert">Buy cat food now</div><p>At night they wake up and walk about the house, to the dismay of those who would rather sleep.</p><form>Search <input> </form></div>',
        [1, 1, 0, 1, 0],
    ),
]


def test_labeller_on_pages_by_hand(spark):
    pages = [r.html for r in queries.table(spark, "/root/testdata/sf0.01", "pages").select("html").collect()]
    model = extract.trained(pages[:240])
    right = total = 0
    for name, text, truth in BY_HAND:
        found = extract.blocks(text)
        assert len(found) == len(truth), name
        z = model.logits(*extract.padded([extract.vectors([found])]))[0, : len(found)] > 0
        right, total = right + int((z == np.array(truth, bool)).sum()), total + len(truth)
    assert right / total > 0.93


def test_main_text_of_odd_pages(spark):
    """Long pages are read whole, repeated rows are each extracted, columns of clashing names are left alone."""
    body = "".join(f"<p>Paragraph {k} of a page that is long enough to be read as an article by anyone.</p>" for k in range(5000))
    rows = [(1, page("Long", body), "a", 1), (2, page("Short", "<p>One paragraph of some words that stands alone.</p>"), "b", 2)]
    rows += [rows[1], (3, None, None, None)]
    given = queries.table(spark, "/root/testdata/sf0.01", "pages").select(F.col("page_id") + 10, "html").collect()
    rows += [(r[0], r[1], "c", 0) for r in given]
    docs = spark.createDataFrame(rows, "page_id long, html string, text string, n_kept long")
    out = extract.extract(docs).filter("page_id < 10").collect()
    assert Counter(r.page_id for r in out) == {1: 1, 2: 2, 3: 1}
    long = next(r for r in out if r.page_id == 1)
    assert long.text.count("\n") >= 4990 and "Paragraph 4999" in long.text
    assert next(r.text for r in out if r.page_id == 3) == ""
