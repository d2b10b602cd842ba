"""Operator 11: manifest, witnesses and verdicts against a tree built by hand."""

import hashlib
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from lynceus.llm import merkle, oracles

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, place string"


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def leaf(*values):
    return sha("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in values))


def levels(digests):
    out = [digests]
    while len(digests) > 1:
        digests = [sha("".join(digests[i : i + 8])) for i in range(0, len(digests), 8)]
        out.append(digests)
    return out


def witness(tree, i):
    out = []
    for level in tree[:-1]:
        run = level[i // 8 * 8 : i // 8 * 8 + 8]
        out.append(("".join(run[: i % 8]), "".join(run[i % 8 + 1 :])))
        i //= 8
    return out


def expected(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    names = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    ordered = {k: sorted(groups[k], key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r[:5]))) for k in names}
    trees = {k: levels([leaf(*r[:5]) for r in ordered[k]]) for k in names}
    top = levels([trees[k][-1][0] for k in names])
    lower = lambda t: None if t is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
    for j, k in enumerate(names):
        for i, r in enumerate(ordered[k]):
            steps = witness(trees[k], i) + witness(top, j)
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            h = leaf(*r[:4], lower(r[4])) if tampered else leaf(*r[:5])
            for a, b in steps:
                h = sha(a + h + b)
            yield r[0], leaf(*r[:5]), trees[k][-1][0], top[-1][0], sha("".join(a + b for a, b in steps)), h, h == top[-1][0]


def said(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)


@pytest.fixture(scope="module")
def odd():
    """Groups of 1, 2, 8, 9, 65, 4,096 and 4,097 leaves and more than eight groups; nulls, empty texts, repeated rows."""
    rows = [(1, "s", None, 3, "ABC", "p"), (2, None, "", None, "", "p"), (3, "s", "", 0, None, "p"), (None, "s", "en", 1, "X", "p"), (None, "s", "en", 1, "X", "q")]
    for k, (lang, n) in enumerate({"de": 1, "é": 2, "zz": 8, "a": 9, "aa": 65, "b c": 7, "Z": 64, "😀": 3, "full": 4096, "more": 4097}.items()):
        rows += [(10_000 * k + 3 * i, "src", lang, i, f"Text {i} É", str(i)) for i in range(n)]
    return rows + [(7, "s", "copies", 2, "AA", "p")] * 5000


def test_manifest_against_a_tree_by_hand(spark, odd):
    docs = spark.createDataFrame(odd, SCHEMA).repartition(5)
    assert said(merkle.verified(docs)) == sorted(expected(odd), key=repr)


def test_real_table_against_a_tree_by_hand(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select(*merkle.FIELDS)
    assert said(merkle.verified(docs)) == sorted(expected([tuple(r) for r in docs.collect()]), key=repr)


def test_sql_against_a_tree_by_hand(odd):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, source VARCHAR, lang VARCHAR, n_chars BIGINT, text VARCHAR)")
    few = [r[:5] for r in odd if r[2] not in ("full", "more", "copies")]
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?)", few)
    assert sorted(map(tuple, con.execute(oracles.MERKLE).fetchall()), key=repr) == sorted(expected(few), key=repr)


def test_other_columns_and_empty_table(spark, odd):
    docs = spark.createDataFrame(odd[:40], SCHEMA)
    leaves = docs.withColumns({"leaf": merkle.leaf([F.col(c) for c in merkle.FIELDS]), "n": F.lit(1), "block": F.col("place"), "root_": F.lit("x")})
    found = merkle.manifest(leaves.select("doc_id", "lang", "leaf", "place", "n", "block", "root_"))
    assert found.columns == ["doc_id", "lang", "leaf", "place", "n", "block", "root_", "subroot", "root", "witness"]
    folded = found.withColumn("again", merkle.folded(F.col("leaf"), F.col("witness"))).collect()
    assert len(folded) == 40 and all(r.again == r.root for r in folded)
    assert {(r.doc_id, r.lang, r.place) for r in folded} == {(r[0], r[2], r[5]) for r in odd[:40]}
    assert merkle.verified(spark.createDataFrame([], SCHEMA)).collect() == []
