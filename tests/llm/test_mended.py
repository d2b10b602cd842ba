"""Broken markup, quoted and foreign WARC records, license notices with junk between their words."""

import gzip
import random
import time

import pytest
from pyspark.sql import functions as F

from lynceus.llm import extract, licenses, warc

# ---------------------------------------------------------------- 2


def test_headers_without_blanks_and_folded_ones_are_kept(spark):
    head = "HTTP/1.1 200 OK\r\nServer:nginx\r\nX-Long: one\r\n\ttwo\r\nDate : Mon\r\nbroken line\r\nContent-Type: text/html"
    rows = spark.createDataFrame([(1, "<urn:x>", "http://a/", "2024-01-01T00:00:00Z", head, "<dl><dt>one</dt><dd>two</dd></dl><figure>f<figcaption>cap</figcaption></figure>")], "page_id long, record_id string, target_uri string, warc_date string, http_headers string, payload string")
    made = {r.warc_type: r.block for r in warc.derivatives(rows).collect()}
    fields = made["metadata"].split("\r\n")
    assert {"source-Server: nginx", "source-X-Long: one two", "source-Date: Mon", "source-Content-Type: text/html"} <= set(fields) and not any("broken" in x for x in fields)
    assert made["conversion"] == "one\ntwo\nf\ncap"


def test_reader_goes_by_lengths(spark, tmp_path):
    def record(name, block, version="1.0"):
        return f"WARC/{version}\r\nWARC-Type:resource\r\nwarc-record-id: <{name}>\r\nX: a\r\n b\r\nContent-Length: {len(block.encode())}\r\n\r\n{block}\r\n\r\n"

    quoted = "é before\r\n\r\n" + record("inner", "nested\r\n\r\nWARC/1.1\r\nno record", "1.1") + "after"
    texts = {"a": "plain", "b": quoted, "c": "", "d": "x\r\n\r\n\r\n\r\ny", "e": "last " * 100}
    (tmp_path / "one.warc").write_bytes("".join(record(k, v) for k, v in texts.items()).encode())
    with open(tmp_path / "two.warc.gz", "wb") as out:  # a member for each record
        for k, v in texts.items():
            out.write(gzip.compress(record("gz-" + k, v, "1.1").encode()))
    (tmp_path / "cut.warc").write_bytes(record("cut", "0123456789").encode()[:-8])
    got = {r.record_id.strip("<>"): r for r in warc.read_records(spark, str(tmp_path)).collect()}
    assert set(got) == {*texts, *("gz-" + k for k in texts), "cut"}
    assert all(got[k].block == v and got["gz-" + k].block == v and got[k].whole for k, v in texts.items())
    assert not got["cut"].whole and {(h.name, h.value) for h in got["a"].headers} >= {("X", "a b"), ("WARC-Type", "resource")}


# ---------------------------------------------------------------- 4


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_spans_against_edit_distance(spark):
    """Notices with few edits are found and texts of which no stretch is near a notice are not."""
    rng, texts = random.Random(8), []
    notices = [(n.split(), label) for n, label in licenses.NOTICES]
    junk = lambda: "".join(rng.choice("bcdfgkmpqvxz") for _ in range(6))
    for words, label in notices:
        for share in (0.0, 0.1):
            copy = list(words)
            for _ in range(int(len(copy) * share)):
                k = rng.randrange(1, len(copy) - 1)
                copy[k : k + rng.randrange(2)] = [junk()] * rng.randrange(1, 2)
            texts.append((" ".join([junk() for _ in range(5)] + copy + [junk() for _ in range(5)]), label))
        texts.append((" ".join(f"{a} {b} {junk()}" for a, b in zip(words, words[1:])), None))  # every word pair, never three words in a row
        texts.append((" ".join(f"{a} {b} {junk()} {junk()}" for a, b in reversed(list(zip(words, words[1:])))), None))
    docs = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(texts)], "doc_id long, text string").repartition(4)
    found = {r.doc_id: r for r in licenses.scan(docs, licenses.templates_table(spark, phrases=())).collect()}
    for k, (text, label) in enumerate(texts):
        words = text.split()
        near = {own for notice, own in notices if min(distance(words[i : i + len(notice)], notice) for i in range(max(1, len(words) - len(notice) + 1))) <= 0.35 * len(notice)}
        labels = set(found[k].labels.split(",")) - {""}
        assert (label in labels and label in near) if label else labels <= near, (text, labels)
    assert sum(bool(found[k].labels) for k, (_, label) in enumerate(texts) if label is None) == 0


# ---------------------------------------------------------------- 10


@pytest.mark.parametrize("text", ["<a " * 350_000, '<p title="' * 90_000, "<a " * 100_000 + '">"' * 100_000, "<b>" * 100_000 + "</i>" * 100_000, "<b>" * 100_000 + "<hr>" * 100_000, "<a '<a \"" * 60_000])
def test_broken_markup_takes_linear_time(text):
    began = time.process_time()
    extract.blocks(text)
    assert time.process_time() - began < 8


def test_tags_and_what_is_none():
    said = lambda page: [t for _, t, _ in extract.blocks(page)]
    assert said('<p title="a>b">one</p><p>two < three <b>four</b></p>') == ["one", "two < three four"]
    assert said("<p>x<script>var a = '</p>' + \"</scr\" + \"ipt>\";</script>y</p><!-- <p>no</p> -->z") == ["xy", "z"]
    assert said("<p>x<!-- never closed <p>y") == ["x"] and said("<p>a</p><p b='c>d") == ["a"] or said("<p>a</p><p b='c>d")[0] == "a"
    assert said("<p>a</p><div unfinished") == ["a"] and said("a <! b > c <? d > e") == ["a c e"]
    deep = extract.blocks("<div>" * 5000 + "text" + "</div>" * 5000)
    assert len(deep) == 1 and len(deep[0][0]) == 2 * extract.DEEP


def test_one_long_page_beside_short_ones_is_kept_whole(spark):
    long = "<html><body><nav><a href='/'>home</a></nav><article>" + "".join(f"<p>Paragraph {k} tells at some length what was seen and said on day {k}.</p>" for k in range(5000)) + "</article><footer>imprint</footer></body></html>"
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "html")
    rows = pages.unionByName(spark.createDataFrame([(10**9, long)], "page_id long, html string")).coalesce(1)
    got = extract.extract(rows).filter(F.col("page_id") == 10**9).first()
    assert all(f"day {k}." in got.text for k in range(5000)) and "imprint" not in got.text
