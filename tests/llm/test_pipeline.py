"""The pipeline against brute force, and the whole entry with its oracles."""

import random
from collections import Counter

import pytest

import corpus_pipeline
from lynceus.llm import quality
from lynceus.llm.queries import table

from .test_operators import components, prose, removed
from .test_shingles import jaccard


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """documents, labels and benchmark with planted copies, junk, shared passages and leaks."""
    rng = random.Random(2)
    shared, item = prose(900, 60), prose(901, 30)
    rows = []
    for i in range(150):
        text = prose(i, rng.randrange(60, 200))
        if i % 10 == 3:
            text = " ".join(w + "$$$&&&" for w in text.split())
        if i % 10 == 5:
            text = rows[-1][1]
        if i % 10 == 7:
            text += "\n" + shared
        if i % 25 == 9:
            text += " " + item
        rows.append((i, text, "en", "s", len(text)))
    rows += [(150, None, None, None, None), (151, "", "en", "s", 0), rows[0]]
    path = str(tmp_path_factory.mktemp("in"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    labels = [(i, 0 if i % 10 == 3 else 1, 0) for i in range(0, 150)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, rows, item


def test_pipeline_against_brute_force(spark, folder):
    path, rows, item = folder
    docs = table(spark, path, "documents")
    judged = quality.judge(docs, table(spark, path, "labels")).filter("kept").select("doc_id").collect()
    kept_ids = {r.doc_id for r in judged}
    assert not any(i % 10 == 3 for i in kept_ids) and len(kept_ids) >= 130
    left = [r for r in rows if r[0] in kept_ids]
    texts = {r[0]: r[1] for r in left}
    near = components([(a, b) for a in texts for b in texts if a < b and jaccard(texts[a], texts[b]) >= 0.8], list(texts))
    left = [r for r in left if near[r[0]] == r[0]]
    cut = {i: (n, text) for i, _, n, text in removed(left)}
    want = Counter()
    for r in left:
        n, text = cut[r[0]]
        text = r[1] if n == 0 else text
        if item not in text:
            want[r[0], text] += 1
    stages = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        stages = stage(spark, stages, path)
        assert stages.columns == docs.columns
    got = stages.collect()
    assert Counter((r.doc_id, r.text) for r in got) == want
    assert all(r.n_chars == len(r.text) for r in got)
    last = corpus_pipeline.run(spark, path).collect()
    assert Counter(r.doc_id for r in last) == Counter(i for i, _ in want.elements())


def test_pipeline_of_nothing(spark, folder, tmp_path):
    path, _, _ = folder
    for name in ("documents", "labels", "benchmark"):
        table(spark, path, name).limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
