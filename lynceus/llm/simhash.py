"""SimHash near-duplicates by meet-in-the-middle ball hashing (operator 5).

Two fingerprints that differ in at most 2r bits have a common variant within r bits of each; and all
fingerprints within r bits of one variant differ from each other in at most 2r bits, so every bucket
of that shuffle is a clique that a star of links describes whole.

A ball of radius 2 among 64 bits has 2,081 variants.  Most fingerprints have no partner, which the
same method shows for less on halves: of two fingerprints at most 4 bits apart, one of the two 32-bit
halves differs in at most 2 bits, so some variant within 1 bit of that half is common.  Fingerprints
meet on those 66 variants first; a bucket of two is verified at once; only fingerprints in a verified
or a larger bucket emit their whole ball.  No link is lost.

Texts whose shingle sets are alike at a given Jaccard similarity (``similar_texts``) differ in far more
bits, so there the fingerprint is longer and cut into parts: every part emits its ball, texts meet on the
parts' variants, and colliding pairs are verified, first by the whole fingerprint and then on the sets.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .blocks import chunks, texts_of, written
from .shingles import SIMILARITY, SIZE, lists, node_of, sets, shingle_sets, similar
from .words import mix

SHINGLE, SEED, RADIUS = 4, 42, 2
#: A text's wide fingerprint: so many words of 64 bits, as twice as many parts; the parts' balls have radius 1.
WIDE, PARTS, PART_RADIUS = 8, 16, 1
#: Bits that tell which of a part's bits a variant flips, or none.
FLIP_BITS = 6
#: Bits of the wide fingerprint in which colliding texts may differ.  At a similarity of 0.8 it is 78 with a
#: deviation of 8, for unlike texts 256 with one of 11, so no more than chance collisions are turned away.
FAR = 160
#: Rows that one key is spread over in joins on keys that may be hot.
SALTS = 8
#: Pairs that may be left for each row of the buckets when they are paired off.
PAIRS_A_ROW = 4


def fingerprint_bits(words: list[bytes], size: int = SHINGLE) -> int:
    """The fingerprint of one text's words: a bit is set if over half of the shingles' hashes set it."""
    if not words:
        return 0
    data, at = b" ".join(words), 0
    starts, ends = [], []
    for w in words:
        starts.append(at)
        at += len(w)
        ends.append(at)
        at += 1
    digest = xxhash.xxh64_intdigest
    if len(words) < size:
        hashes = np.array([digest(data, SEED)], np.uint64)
    else:
        hashes = np.array([digest(data[a:b], SEED) for a, b in zip(starts, ends[size - 1 :])], np.uint64)
    counts = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 16):  # most significant bit first
        part = hashes[k : k + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): 64-bit fingerprints as signed longs; a null or empty text has 0."""
    kind = docs.schema[id_col].dataType

    def run(batches):
        for batch in batches:
            texts = texts_of(batch.column(1), lower=True)
            bits = np.array([fingerprint_bits(x.split()) for x in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bits)], names=[id_col, "fp"])

    schema = T.StructType([T.StructField(id_col, kind), T.StructField("fp", T.LongType())])
    return docs.select(id_col, text_col).mapInArrow(run, schema)


def flips(bits: range, most: int) -> list[int]:
    """Signed 64-bit masks of up to so many of the bits."""
    masks = [sum(1 << b for b in c) for k in range(most + 1) for c in combinations(bits, k)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _longs(values: list[int]) -> Column:
    return F.lit(np.array(values, np.int64))


def suspects(distinct: DataFrame, distance: int = 2 * RADIUS) -> DataFrame:
    """The fingerprints that some other one may link with; none that has a link is missing."""
    masks, low = _longs(flips(range(32), 1)), F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))
    high = F.shiftrightunsigned("fp", 32)
    halves = F.concat(
        F.transform(masks, lambda m: low.bitwiseXOR(m)),
        F.transform(masks, lambda m: high.bitwiseXOR(m) + F.lit(1 << 32)),
    )
    bucket = Window.partitionBy("v")
    met = (
        distinct.select("fp", F.explode(halves).alias("v"))
        .withColumns({"n": F.count("*").over(bucket), "a": F.min("fp").over(bucket), "b": F.max("fp").over(bucket)})
        .filter((F.col("n") > 2) | (F.col("n") == 2) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance))
    )
    return met.select("fp").distinct()


def links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(fp, hub): a star for each bucket of whole variants, repeated links once."""
    ball = F.explode(F.transform(_longs(flips(range(64), radius)), lambda m: F.col("fp").bitwiseXOR(m)))
    bucket = Window.partitionBy("v")
    return (
        suspects(distinct, 2 * radius)
        .select("fp", ball.alias("v"))
        .withColumn("hub", F.min("fp").over(bucket))
        .filter("hub < fp and bit_count(hub ^ fp) <= %d" % (2 * radius))
        .select("fp", "hub")
        .distinct()
    )


def spread_join(rows: DataFrame, few: DataFrame, key: str, by: str) -> DataFrame:
    """Inner join on ``key``, unique in ``few`` but perhaps hot in ``rows``, whose rows are spread by ``by`` too."""
    salted = rows.withColumn("salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int"))
    each = few.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(each, [key, "salt"]).drop("salt")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node that each node of (a, b) edges reaches.

    Alternates large-star and small-star steps until nothing changes.  Least neighbours are aggregates,
    combined before the shuffle, and joined back salted, so that a hub's edges are not one task's.  Every
    round's edges are written to the shared folder; only their number and a checksum reach the driver.
    """
    edges = written(edges.toDF("a", "b"), "links")
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = spread_join(both.filter("b > a"), least, "a", "b").select("b", "m").filter("b <> m").distinct()
        large = written(large.toDF("a", "b"), "links")  # a is the greater one
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = spread_join(large, least, "a", "b").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = written(moved.unionByName(least.toDF("a", "b")).distinct(), "links")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state = now


def named(firsts: DataFrame, tree: DataFrame, key: str) -> DataFrame:
    """(key, component_id): the least of the ``least`` ids of a component, for every key of ``firsts``."""
    rooted = firsts.join(tree.withColumnRenamed("node", key), key, "left").withColumn("root", F.coalesce("root", key))
    names = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return spread_join(rooted, names, "root", key).select(key, "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint, component_id) for every document; component_id is the least id it reaches.

    Equal texts share a fingerprint and are never paired.  Null and empty texts have fingerprint zero
    and link like any other.  A null id keeps its row, and is no component's id unless it is alone.
    Rows that repeat stay; an empty table gives an empty table.
    """
    prints = written(fingerprints(docs, id_col, text_col), "fingerprints")
    firsts = prints.groupBy("fp").agg(F.min(id_col).alias("least"))
    labels = named(firsts, components(links(firsts.select("fp"))), "fp")
    return prints.join(labels, "fp").select(
        id_col, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


# ---------------------------------------------------------------- similar sets of shingles


def wide_bits(shingles: np.ndarray) -> np.ndarray:
    """The wide fingerprint of a set of hashed shingles, as 64-bit words."""
    counts = np.zeros(64 * WIDE, np.int64)
    salts = mix(np.arange(1, WIDE + 1, dtype=np.uint64))
    for k in range(0, len(shingles), 1 << 14):
        hashes = mix(shingles[k : k + (1 << 14), None] ^ salts)
        counts += np.unpackbits(hashes.view(np.uint8).reshape(len(hashes), -1), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * counts > len(shingles)).view(np.int64)


def wide_fingerprints(docs: DataFrame, id_col: str, text_col: str, size: int = SIZE) -> DataFrame:
    """(id, node, n, fp): a hash of the text's set of shingles, its size and the wide fingerprint."""

    def run(batches):
        for batch in batches:
            texts = texts_of(batch.column(1))
            for a, b in chunks(texts):
                found = list(shingle_sets(texts[a:b], size))
                bits = [wide_bits(x).view(np.uint64) for x in found]
                columns = [pa.array([node_of(x) for x in found], pa.int64()), pa.array([len(x) for x in found], pa.int64()), lists(bits)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *columns], names=[id_col, "node", "n", "fp"])

    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType)]).add("node", "long").add("n", "long")
    return docs.select(id_col, text_col).mapInArrow(run, schema.add("fp", T.ArrayType(T.LongType())))


def parts_of(distinct: DataFrame) -> DataFrame:
    """(part, node): the 32-bit parts of each (node, fp), with their places."""

    def part(k: int) -> Column:
        word = F.col("fp")[k // 2]
        return (F.shiftrightunsigned(word, 32) if k % 2 else word).bitwiseAND(F.lit(0xFFFFFFFF)) + F.lit(k << 32)

    return distinct.select("node", F.explode(F.array(*map(part, range(PARTS)))).alias("part"))


def company(parts: DataFrame) -> DataFrame:
    """(sig, part) of the buckets in which different ones of the distinct parts meet on a variant.

    Two parts meet on two variants, which differ from each other in the bits that the parts flip to get there, and count
    at the one without the higher of these bits: a bucket keeps the parts up to the highest flip that takes a bit away.
    These rows are most of what near-dedup shuffles: each is one number, the variant and the place of its flip.
    """
    masks = _longs([m << FLIP_BITS | k for k, m in enumerate(flips(range(32), PART_RADIUS))])
    ball = F.explode(F.transform(masks, lambda m: F.shiftleft("part", FLIP_BITS).bitwiseXOR(m)))
    sig, flip = F.shiftright("v", FLIP_BITS), F.col("v").bitwiseAND(F.lit((1 << FLIP_BITS) - 1)).cast("int")
    dealt = parts.select(ball.alias("v")).repartition(sig).select(sig.alias("sig"), flip.alias("flip"))
    bit = F.when(F.col("flip") > 0, F.call_function("shiftleft", F.lit(1).cast("long"), F.col("flip") - 1)).otherwise(F.lit(0).cast("long"))
    taken, bucket = (F.col("flip") > 0) & (F.col("sig").bitwiseAND(bit) == 0), Window.partitionBy("sig")
    met = dealt.withColumn("most", F.max(F.when(taken, F.col("flip"))).over(bucket)).filter("flip <= most")
    met = met.withColumn("k", F.count("*").over(bucket)).filter("k > 1")
    return met.select("sig", F.col("sig").bitwiseXOR(bit).alias("part"))


def collisions(distinct: DataFrame, parts: DataFrame) -> DataFrame:
    """(sig, part) of the buckets in which different parts of (part, node) meet on a variant.

    Texts that share a part are in its buckets together, so a part is there once, however many have it.
    """
    own = parts.groupBy("part").agg(F.min("node").alias("node"), (F.min("node") == F.max("node")).alias("one"))
    own, bucket = written(own, "parts"), Window.partitionBy("sig")
    met = company(own).join(own, "part")
    met = met.withColumns({"k": F.count("*").over(bucket), "ones": F.min("one").over(bucket), "low": F.min("node").over(bucket), "high": F.max("node").over(bucket)})
    met = written(met.select("sig", "part", "low", "high", (F.col("ones") & (F.col("k") == 2)).alias("alone")), "collisions")
    # two texts that meet alone do so once, and are told by the whole fingerprint
    side = lambda c: distinct.select(F.col("node").alias(c), F.col("fp").alias(c + "_fp"))
    two = met.filter("alone").groupBy("low", "high").agg(F.min("sig").alias("sig"))
    apart = F.aggregate(F.zip_with("low_fp", "high_fp", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda a, x: a + x)
    near = two.join(side("low"), "low").join(side("high"), "high").filter(apart <= FAR)
    return met.filter("not alone").select("sig", "part").unionByName(met.filter("alone").join(near, "sig", "left_semi").select("sig", "part"))


def weighed(rows: DataFrame) -> DataFrame:
    """The (sig, node) rows with a node's ``weight``: how many its buckets have on average."""
    rows = rows.withColumn("k", F.count("*").over(Window.partitionBy("sig")))
    return written(rows.withColumn("weight", F.avg("k").over(Window.partitionBy("node"))).drop("k"), "buckets")


def rooted(rows: DataFrame, tree: DataFrame, node: str = "node") -> DataFrame:
    """The rows with the ``root`` of their node, which is the node itself where the tree has none."""
    own = tree.select(F.col("node").alias(node), F.col("root").alias("now"))
    return rows.join(own, node, "left").withColumn("root", F.coalesce("now", node)).drop("now")


def apart(rows: DataFrame) -> DataFrame:
    """The rows of the buckets in which there is more than one root."""
    bucket = Window.partitionBy("sig")
    ends = {"_low": F.min("root").over(bucket), "_high": F.max("root").over(bucket)}
    return rows.withColumns(ends).filter("_low < _high").drop("_low", "_high")


def verified(buckets: DataFrame, whole: DataFrame, similarity: float, known: DataFrame | None = None) -> DataFrame:
    """(a, b) links that join the nodes of (sig, node, n, weight) as all similar pairs in a bucket would.

    Where buckets have ``root`` too, nodes of one root are joined by the ``known`` links, which are among the result.

    Buckets are not paired off: each is verified against its most central members first, one and then twice as
    many in each round, and only members that are still in different components meet again.  What is paired off
    at the end is at most ``PAIRS_A_ROW`` times the rows that are left.
    """
    fits = lambda a, b: F.least(a, b) >= F.greatest(a, b) * similarity - 1e-9
    rows, found, hubs = buckets, known, 1
    if "root" not in rows.columns:
        rows = rows.withColumn("root", F.col("node"))
    while True:
        roots = rows.groupBy("sig", "root").agg(F.count("*").alias("k")).groupBy("sig")
        each = roots.agg(F.sum("k").alias("n"), F.sum(F.col("k") * F.col("k")).alias("same"))
        size = each.agg(F.sum("n"), F.sum((F.col("n") * F.col("n") - F.col("same")) / 2)).first()
        if not size[0] or size[1] <= PAIRS_A_ROW * size[0]:
            break
        central = rows.withColumn("place", F.row_number().over(Window.partitionBy("sig").orderBy(F.col("weight").desc(), "node")))
        hub = central.filter(F.col("place") <= hubs).select("sig", *[F.col(c).alias("hub_" + c) for c in ("node", "n", "root", "place")])
        apart = central.join(hub, "sig").filter((F.col("place") > F.col("hub_place")) & (F.col("root") != F.col("hub_root")) & fits(F.col("n"), F.col("hub_n")))
        pairs = apart.select(F.col("node").alias("a"), F.col("hub_node").alias("b")).distinct()
        new = written(similar(pairs, whole, similarity), "links")
        found = new if found is None else found.unionByName(new)
        roots = components(found).withColumnRenamed("root", "now")
        left = central.filter(F.col("place") > hubs).drop("place", "root").join(roots, "node", "left")
        left = left.withColumn("root", F.coalesce("now", "node")).drop("now")
        bucket = Window.partitionBy("sig")
        ends = {"low": F.min("root").over(bucket), "high": F.max("root").over(bucket)}
        rows = written(left.withColumns(ends).filter("low < high").drop("low", "high"), "buckets")
        hubs *= 2
    # pairs of different roots: those outside of a bucket's largest one with all others
    sizes = rows.groupBy("sig", "root").agg(F.count("*").alias("k")).groupBy("sig")
    rows = rows.join(sizes.agg(F.max_by("root", F.struct("k", "root")).alias("main")), "sig")
    side = lambda c: rows.select("sig", "main", F.col("node").alias(c), F.col("n").alias(c + "_n"), F.col("root").alias(c + "_root"))
    met = side("a").filter("a_root <> main").join(side("b").drop("main"), "sig")
    met = met.filter("a_root <> b_root and (b_root = main or a < b)").filter(fits(F.col("a_n"), F.col("b_n")))
    last = similar(met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), whole, similarity)
    return last if found is None else found.unionByName(last)


def similar_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, similarity: float = SIMILARITY) -> DataFrame:
    """(id, component_id) for every document; component_id is the least id it reaches over similar texts.

    Texts are linked if their sets of ``size``-word shingles (a shorter text is one) have the similarity
    and two 32-bit parts of their wide fingerprints differ in at most two bits.  No pair that differs in
    up to 47 of the 512 bits is missed; the README has the measured recall at 0.8.  Texts without words
    are alike.  A null id keeps its row, and is no component's id unless it is alone.  Rows that repeat
    stay; an empty table gives an empty table.
    """
    prints = written(wide_fingerprints(docs, id_col, text_col, size), "fingerprints")
    firsts = prints.groupBy("node").agg(F.min(id_col).alias("least"), F.first("n").alias("n"), F.first("fp").alias("fp"))
    firsts = written(firsts, "sets")
    parts = written(parts_of(firsts), "parts")
    met = written(collisions(firsts, parts), "collisions")
    alike = Window.partitionBy("part")
    shared = parts.withColumns({"low": F.min("node").over(alike), "high": F.max("node").over(alike)}).filter("low < high")
    shared = written(shared.select(F.col("part").alias("sig"), "node"), "shared")
    held = written(parts.join(met.select("part").distinct(), "part", "left_semi"), "parts")
    some = held.select("node").unionByName(shared.select("node")).distinct()
    some = written(some.join(firsts.select("node", "n", "least"), "node"), "suspects")
    rows = docs.select(id_col, text_col)
    rows = rows.join(some.select("least").distinct(), F.col(id_col).eqNullSafe(F.col("least")), "left_semi")
    whole = sets(rows, text_col, size).join(some.select("node"), "node", "left_semi").dropDuplicates(["node"])
    whole, sized = written(whole, "sets"), some.select("node", "n")
    found = met_links(shared.join(sized, "node"), held.join(sized, "node"), met, whole, similarity)
    labels = named(firsts.select("node", "least"), components(found), "node")
    return prints.select(id_col, "node").join(labels, "node").select(id_col, "component_id")


def met_links(shared: DataFrame, held: DataFrame, met: DataFrame, whole: DataFrame, similarity: float) -> DataFrame:
    """(a, b) links that join nodes as all similar pairs that share a part, or have parts that meet, would.

    The texts of one part (``shared``: sig, node, n) come first; then in each bucket of parts (``met``: sig, part) one
    text for each part and component; then all texts (``held``: part, node, n) of the buckets that are still apart.
    """
    buckets = weighed(shared)
    found = written(verified(buckets, whole, similarity), "links")
    weights = buckets.groupBy("node").agg(F.max("weight").alias("weight"))
    own = rooted(held, components(found)).join(weights, "node", "left")
    own = own.groupBy("part", "root").agg(F.max_by(F.struct("node", "n"), F.struct(F.coalesce("weight", F.lit(0.0)), "node")).alias("c"))
    first = written(apart(met.join(own, "part")), "buckets")
    found = written(verified(weighed(first.select("sig", "c.*", "root")), whole, similarity, found), "links")
    tree = components(found)
    left = apart(rooted(first.select("sig", F.col("root").alias("before")), tree, "before")).select("sig").distinct()
    rows = met.join(written(left, "buckets"), "sig", "left_semi").join(rooted(held, tree), "part")
    return verified(weighed(rows.select("sig", "node", "n", "root")), whole, similarity, found)
