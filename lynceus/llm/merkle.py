"""Merkle dataset manifest with incremental witnesses (operator 11).

A group's leaves are appended in order to an 8-ary tree.  A leaf's witness is what folds it up to the root: at
each level the digests of its run on its left and on its right.  Leaves are numbered without a global window
(``ordinals.numbered``) and cut into aligned blocks of ``ARITY ** DEPTH``:

* a task streams blocks leaf by leaf; every leaf's partial witness hangs on the open subtree that it is in, and
  whenever a run of siblings completes, all witnesses below each sibling are extended by the others;
* a block's root is one more append to the layer above, whose nodes are blocks: the same operator builds it, and
  the roots of groups are the appends of the last tree.  Layers shrink by 4,096, so their number is the logarithm
  of the rows, and each is a Spark job over a table of its own;
* on the way down each block gets its root's witness as one row in front of its leaves, and the block is
  streamed once more: witnesses are completed where they are used, and are never shuffled leaf by leaf.

Equal rows are one row with a number until they are streamed, so copies do not meet in one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lynceus.operators.ordinals import numbered

from .blocks import written

ARITY, DEPTH = 8, 4
BLOCK = ARITY**DEPTH
#: Rows of witnesses that go to the JVM at once.
SLICE = 512

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
STEP = T.StructType().add("left", "string").add("right", "string")
WITNESS = T.ArrayType(STEP)


def leaf(values: list[Column]) -> Column:
    """SHA-256 of the values, each as its UTF-8 byte count, a colon and itself; null is ``-``."""
    text = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text]), 256)


def levels_of(total: int) -> int:
    """Levels that a block climbs in a layer of so many nodes."""
    levels = 0
    while total > 1 and levels < DEPTH:
        total, levels = -(-total // ARITY), levels + 1
    return levels


class Appends:
    """One block's tree under aligned appends; the open subtrees hold the witnesses that they will extend."""

    def __init__(self, levels: int, witnesses: bool):
        self.levels, self.top = levels, ""
        self.open: list[list[tuple[str, list]]] = [[] for _ in range(levels)]
        self.witnesses: list[list[tuple[str, str]]] | None = [] if witnesses else None

    def append(self, digest: str) -> None:
        mine: list = []
        if self.witnesses is not None:
            self.witnesses.append(mine)
        self._attach(0, digest, [] if self.witnesses is None else [mine])

    def _attach(self, level: int, digest: str, below: list) -> None:
        if level == self.levels:
            self.top = digest
            return
        self.open[level].append((digest, below))
        if len(self.open[level]) == ARITY:
            self._complete(level)

    def _complete(self, level: int) -> None:
        run, self.open[level] = self.open[level], []
        digests = [d for d, _ in run]
        for k, (_, below) in enumerate(run):
            step = "".join(digests[:k]), "".join(digests[k + 1 :])
            for witness in below:
                witness.append(step)
        self._attach(level + 1, hashlib.sha256("".join(digests).encode()).hexdigest(), [w for _, below in run for w in below])

    def close(self) -> str:
        for level in range(self.levels):
            if self.open[level]:
                self._complete(level)
        return self.top


def _by_block(batches) -> Iterator[pa.Table]:
    """The rows of one (grp, block) after another, of batches sorted by both."""
    held, key = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        pairs = list(zip(batch.column("grp").to_pylist(), batch.column("block").to_pylist()))
        edges = [0, *(k for k in range(1, len(pairs)) if pairs[k] != pairs[k - 1]), len(pairs)]
        for a, b in zip(edges, edges[1:]):
            if held and pairs[a] != key:
                yield pa.Table.from_batches(held)
                held = []
            key = pairs[a]
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def _streamed(rows: DataFrame) -> DataFrame:
    return rows.repartition("grp", "block").sortWithinPartitions("grp", "block", "start")


def _roots(batches):
    """(grp, place, total, digest) of blocks, as nodes of the layer above."""
    for table in _by_block(batches):
        total = table.column("total")[0].as_py()
        tree = Appends(levels_of(total), False)
        for digest, n in zip(table.column("digest").to_pylist(), table.column("n").to_pylist()):
            for _ in range(n):
                tree.append(digest)
        first = table.slice(0, 1)
        above = [first.column("grp").combine_chunks(), first.column("block").combine_chunks(), pa.array([-(-total // BLOCK)]), pa.array([tree.close()])]
        yield pa.RecordBatch.from_arrays(above, names=["grp", "place", "total", "digest"])


def _completed(schema: pa.Schema):
    """Every node of a block as often as it counts, with its witness up to the root."""

    def run(batches):
        for table in _by_block(batches):
            table = table.combine_chunks()
            above, nodes = table.slice(0, 1).to_pylist()[0], table.slice(1)  # the row of the layer above comes first
            times = nodes.column("n").to_numpy()
            tree = Appends(levels_of(nodes.column("total")[0].as_py()), True)
            for digest, n in zip(nodes.column("digest").to_pylist(), times.tolist()):
                for _ in range(n):
                    tree.append(digest)
            tree.close()
            rest = [(s["left"], s["right"]) for s in above["witness"]]
            which = np.repeat(np.arange(len(times)), times)
            place = above["block"] * BLOCK + np.arange(len(which))  # a block has no gaps
            for a in range(0, len(which), SLICE):
                part = nodes.take(pa.array(which[a : a + SLICE])).combine_chunks()
                columns = []
                for field in schema:
                    if field.name == "place":
                        values = pa.array(place[a : a + SLICE])
                    elif field.name == "witness":
                        values = pa.array([w + rest for w in tree.witnesses[a : a + SLICE]], field.type)
                    elif field.name in ("subroot", "root"):
                        values = pa.array([above[field.name]] * len(part), field.type)
                    else:
                        values = part.column(field.name).chunk(0)
                    columns.append(values)
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return run


def _layer(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The nodes in blocks, and (grp, place, root, witness) of the blocks, up to the root of their group."""
    last = F.col("place") + F.col("times") - 1
    span = nodes.withColumn("block", F.explode(F.sequence(F.floor(F.col("place") / BLOCK), F.floor(last / BLOCK))))
    start = F.greatest(F.col("place") - F.col("block") * BLOCK, F.lit(0))
    n = F.least(last - F.col("block") * BLOCK + 1, F.lit(BLOCK)) - start
    pieces = written(span.withColumns({"start": start.cast("long"), "n": n.cast("long")}).drop("place", "times"), "pieces")
    once = _streamed(pieces.select("grp", "block", "start", "n", "total", "digest"))
    blocks = written(once.mapInArrow(_roots, "grp string, place long, total long, digest string"), "blocks")
    if (blocks.agg(F.max("total")).first()[0] or 0) > 1:
        return pieces, grown(blocks.withColumn("times", F.lit(1).cast("long")))
    return pieces, blocks.select("grp", "place", F.col("digest").alias("root"), F.array().cast(WITNESS).alias("witness"))


def _descended(pieces: DataFrame, tops: DataFrame) -> DataFrame:
    """The nodes of the pieces with witnesses, below blocks that have theirs."""
    heads = tops.withColumnRenamed("place", "block").withColumn("start", F.lit(-1).cast("long"))
    kept = [f for f in pieces.schema if f.name not in ("block", "start", "n", "total")]
    above = [f for f in tops.schema if f.name in ("subroot", "root")]
    schema = T.StructType([*kept, *above]).add("place", "long").add("witness", WITNESS)
    rows = _streamed(pieces.unionByName(heads, allowMissingColumns=True))
    return rows.mapInArrow(_completed(to_arrow_schema(schema)), schema)


def grown(nodes: DataFrame) -> DataFrame:
    """Nodes (grp, place, total, digest, times, others) with ``root`` and ``witness``, one row for each time.

    ``place`` is a node's place in its group from 0, ``total`` how many nodes the group has.
    """
    return _descended(*_layer(nodes))


def manifest(leaves: DataFrame, group_col: str = "lang", id_col: str = "doc_id", leaf_col: str = "leaf") -> DataFrame:
    """The leaves with ``subroot``, ``root`` and ``witness``, array of (left, right), from the leaf up to the root.

    Per group the leaves ascend by id (null first), equal ids by leaf and then by the other columns; groups ascend
    bytewise, null first.  While a tree has several nodes, each 8 consecutive ones, and the last ones whatever
    their number, become their hash; one leaf alone is its tree.  Rows that repeat are leaves of their own.  An
    empty table has no root and gives no rows.  Other columns stay and may have any name.
    """
    others = [c for c in leaves.columns if c not in (group_col, id_col, leaf_col)]
    rest = F.struct(F.lit(None).alias("none"), *others)
    rows = leaves.select(F.coalesce(F.concat(F.lit("="), F.col(group_col).cast("string")), F.lit("")).alias("grp"), F.col(id_col).alias("id"), F.col(leaf_col).alias("digest"), rest.alias("rest"))
    once = rows.groupBy("grp", "id", "digest", "rest").agg(F.count("*").alias("times"))
    pieces, tops = _layer(numbered(once, ["grp"], ["id", "digest", "rest"], "times"))
    tops = written(tops.withColumnRenamed("root", "subroot"), "tops")
    groups = tops.groupBy("grp").agg(F.first("subroot").alias("digest"))  # one and the same in all blocks
    placed = numbered(groups, [], ["grp"]).withColumnRenamed("grp", "name")
    joined = grown(placed.withColumns({"grp": F.lit(""), "times": F.lit(1).cast("long")})).select(F.col("name").alias("grp"), "root", F.col("witness").alias("upper"))
    whole = tops.join(joined, "grp").withColumn("witness", F.concat("witness", "upper")).drop("upper")
    group = F.when(F.col("grp") != "", F.substr("grp", F.lit(2))).cast(leaves.schema[group_col].dataType)
    found = _descended(pieces, whole)
    return found.select(F.col("id").alias(id_col), group.alias(group_col), F.col("digest").alias(leaf_col), *[F.col("rest")[c].alias(c) for c in others], "subroot", "root", "witness")


def folded(start: Column, witness: Column) -> Column:
    """The root that a leaf folds up to."""
    return F.aggregate(witness, start, lambda h, w: F.sha2(F.concat(w["left"], h, w["right"]), 256))


def siblings(witness: Column) -> Column:
    """All digests of a witness, level by level, left to right."""
    return F.array_join(F.transform(witness, lambda w: F.concat(w["left"], w["right"])), "")


def verified(docs: DataFrame) -> DataFrame:
    """The manifest of documents, and whether each text folds to the root after a third of them were tampered with."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    values = {c: F.col(c) for c in FIELDS}
    other = leaf([*({**values, "text": F.translate("text", letters, letters.lower())}.values())])
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    leaves = docs.select("doc_id", "lang", leaf([*values.values()]).alias("leaf"), F.when(tampered, other).alias("tampered"))
    found = manifest(leaves).withColumn("folded_root", folded(F.coalesce("tampered", "leaf"), F.col("witness")))
    proof = F.sha2(siblings(F.col("witness")), 256).alias("proof_sha256")
    return found.select("doc_id", "leaf", "subroot", "root", proof, "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
