"""Secret scans by a battery of randomness tests with false-discovery control (operator 13).

Fixed patterns give the base spans.  The method adds runs of token characters that are too random to be text:

1. a run's encoding is the smallest alphabet that holds it; against a uniform source over that alphabet it
   gets three p-values (chi-squared uniformity of symbols, runs about the alphabet's middle, serial
   correlation of neighbours), combined by Fisher's rule into one: high for random runs, low for others;
2. what ordinary text would get is measured, not assumed: the text around the runs, reduced to the same
   alphabet, is cut whole into windows of every length class and put to the same battery.  A run's p-value under
   "this is text" is the share of such windows, of its encoding and length class, that look as random;
3. false discoveries are controlled at ``LEVEL`` over all runs of the corpus by the group
   Benjamini-Hochberg procedure, whose groups are encodings and length classes: short runs, which the tests
   can hardly tell from text, get p-values and weights of their own and do not dilute long ones.

Scores are counted in bins, so what the corpus sends to the decision is one histogram of at most
``len(ENCODINGS) * len(CLASSES) * BINS`` rows, whatever its size; so is what the decision sends back.
"""

from __future__ import annotations

import math
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from .blocks import written

# fixed values: the base kinds in their order, their patterns and least lengths
KINDS = ("assign", "access", "hex", "random")
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS, HEX = r"AKIA[A-Z0-9]+", r"[0-9a-f]+"
LEAST = {"assign": 6, "access": 20, "hex": 24}

DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Alphabets by size; a run has the first that holds it.  Of base64 both writings of the last two symbols count.
ENCODINGS = (
    ("decimal", DIGITS), ("hex", DIGITS + LOWER[:6]), ("HEX", DIGITS + UPPER[:6]), ("base32", UPPER + "234567"), ("base36", DIGITS + LOWER),
    ("BASE36", DIGITS + UPPER), ("base62", DIGITS + UPPER + LOWER), ("base64", UPPER + LOWER + DIGITS + "+/"),
)
#: Least lengths of the classes; a run shorter than the first is no candidate, as no test could tell it from text.
CLASSES = (16, 20, 24, 32, 48, 64, 128)
#: Windows of ordinary text that are put to the battery at a time.
WINDOWS = 1 << 13
#: A score is -4 log10 of the combined p-value, in whole steps.
BINS, STEPS = 64, 4
#: False discoveries that are accepted among the runs called random.
LEVEL = 0.05

RUN = re.compile("[A-Za-z0-9+/_-]{%d,}" % CLASSES[0])
# a run of the last two kinds is found whole or not at all, so the least length can stand in the pattern
_LONG = (re.compile(ACCESS.replace("]+", "]{%d,}" % (LEAST["access"] - 4))), re.compile(HEX.replace("]+", "]{%d,}" % LEAST["hex"])))
_ASSIGN = re.compile(ASSIGN, re.ASCII | re.IGNORECASE)
_SYMBOL = np.full((len(ENCODINGS), 256), -1, np.int8)
for _e, (_, _letters) in enumerate(ENCODINGS):
    _SYMBOL[_e, np.frombuffer(_letters.encode(), np.uint8)] = np.arange(len(_letters))
_SYMBOL[-1, [ord("-"), ord("_")]] = 62, 63
# for bytes.translate: each byte's symbol, and the bytes that an alphabet does not have
_REDUCED = [(np.maximum(row, 0).astype(np.uint8).tobytes(), np.flatnonzero(row < 0).astype(np.uint8).tobytes()) for row in _SYMBOL]
_SIZE = np.array([len(x) for _, x in ENCODINGS])
# fixed values: Chebyshev coefficients of erfc by 1 / (1 + z / 2), within 1.2e-7 of the value at every z (Numerical Recipes, erfcc)
_ERFC = (0.17087277, -0.82215223, 1.48851587, -1.13520398, 0.27886807, -0.18628806, 0.09678418, 0.37409196, 1.00002368, -1.26551223)


def _tail(z: np.ndarray) -> np.ndarray:
    """The share of a standard normal above z."""
    x = np.abs(z) / math.sqrt(2)
    t = 1 / (1 + x / 2)
    power = np.full(len(x), _ERFC[0])
    for c in _ERFC[1:]:
        power *= t
        power += c
    above = t * np.exp(power - x * x) / 2
    return np.where(z < 0, 1 - above, above)


def _uniformity(squares: np.ndarray, n: np.ndarray | int, size: int) -> np.ndarray:
    """-ln of the p-value of a symbol's counts, given as the sum of their squares over n draws.

    Pearson's statistic has its exact mean and variance for n draws, and is made normal by a cube root.
    """
    pearson, mean, var = squares * size / n - n, size - 1.0, 2 * (size - 1) * (n - 1) / n
    shape = 2 * mean**2 / var  # degrees of freedom of the scaled chi-squared law of that mean and variance
    uniform = _tail((np.cbrt(pearson / mean) - (1 - 2 / (9 * shape))) / np.sqrt(2 / (9 * shape)))
    return -np.log(np.maximum(uniform, 1e-300))


def _turning(runs: np.ndarray, up: np.ndarray, n: np.ndarray | int) -> np.ndarray:
    """-ln of the p-value of the runs above and below the alphabet's middle, of n symbols of which ``up`` are above."""
    expected = 1 + 2 * up * (n - up) / n
    spread = np.sqrt(np.maximum((expected - 1) * (expected - 2) / (n - 1), 1e-9))
    one_sided = np.minimum(up, n - up) < 1
    running = np.where(one_sided, 2.0 ** (1 - np.minimum(n, 1000)), 2 * _tail(np.abs(runs - expected) / spread))
    return -np.log(np.maximum(running, 1e-300))


def _serial(total: np.ndarray, power: np.ndarray, cross: np.ndarray, ends: np.ndarray, n: np.ndarray | int) -> np.ndarray:
    """-ln of the p-value of the serial correlation of neighbours.

    From sums of the symbols, of their squares and of the products of neighbours, and the first symbol plus the last.
    """
    level = total / n
    power = power - total * level
    cross = cross - level * (2 * total - ends) + (n - 1) * level**2
    serial = np.where(power > 0.5, 2 * _tail(np.abs(cross / np.maximum(power, 0.5) + 1 / n) * np.sqrt(n)), 0)
    return -np.log(np.maximum(serial, 1e-300))


def _fisher(half: np.ndarray) -> np.ndarray:
    """The p-value of three by the sum of their -ln."""
    return np.exp(-half) * (1 + half + half * half / 2)


def battery(symbols: np.ndarray, lengths: np.ndarray, size: int) -> np.ndarray:
    """The combined p-value of each of the sequences that lie end to end in ``symbols``, over an alphabet of ``size``."""
    k, n = len(lengths), lengths.astype(float)
    first = np.cumsum(lengths) - lengths
    last = first + lengths - 1
    squares = np.zeros(k)
    for a in range(0, k, 1 << 12):
        b = min(k, a + (1 << 12))
        key = np.repeat(np.arange(b - a, dtype=np.int32) * size, lengths[a:b]) + symbols[first[a] : last[b - 1] + 1]
        counts = np.bincount(key, minlength=(b - a) * size).reshape(-1, size)
        squares[a:b] = np.einsum("ij,ij->i", counts, counts)
    # what lies between two sequences is no turn and no neighbour
    sums = lambda x: np.add.reduceat(x, first, dtype=np.int64).astype(float)
    high = symbols >= (size + 1) // 2
    turns = np.zeros(len(symbols), bool)
    np.not_equal(high[1:], high[:-1], out=turns[1:])
    turns[first] = False
    x = symbols.astype(np.int32)
    products = np.zeros(len(x), np.int32)
    np.multiply(x[1:], x[:-1], out=products[1:])
    products[first] = 0
    serial = _serial(sums(x), sums(x * x), sums(products), x[first] + x[last], n)
    return _fisher(_uniformity(squares, n, size) + _turning(1 + sums(turns), sums(high), n) + serial)


@lru_cache(maxsize=len(ENCODINGS) * len(CLASSES))
def _tables(size: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """``_uniformity`` by the sum of squares, and ``_turning`` by turns and symbols above, of windows of one length."""
    turns, up = np.divmod(np.arange(length * (length + 1)), length + 1)
    return _uniformity(np.arange(length * length + 1.0), length, size), _turning(turns + 1.0, up.astype(float), length)


def windows(symbols: np.ndarray, size: int):
    """A function (starts, length) -> ``battery`` of these windows of ``symbols``, which may overlap.

    Sums over a window are differences of running sums, made once for all lengths.  A running sum has several of them
    side by side, as none of a window exceeds its field: what one carries over goes from the difference again.
    """
    x = np.arange(64, dtype=np.int64)
    above = x >= (size + 1) // 2
    running = lambda y: np.concatenate(([0], np.cumsum(y)))
    single = running((x * x << 32 | x << 16 | above)[symbols])
    double = running(((x[:, None] * x) << 16 | (above[:, None] != above)).ravel()[symbols[:-1].astype(np.int16) << 6 | symbols[1:]])
    cells = (np.arange(WINDOWS) * size)[:, None]

    def measured(starts: np.ndarray, length: int) -> np.ndarray:
        k, last = len(starts), starts + (length - 1)
        own, pairs = single[last + 1] - single[starts], double[last] - double[starts]
        counts = np.bincount((cells[:k] + sliding_window_view(symbols, length)[starts]).ravel(), minlength=k * size).reshape(-1, size)
        uniform, turning = _tables(size, length)
        ends = symbols[starts] + symbols[last].astype(np.int64)
        serial = _serial((own >> 16 & 0xFFFF).astype(float), (own >> 32).astype(float), (pairs >> 16).astype(float), ends, length)
        turned = turning[(pairs & 0xFFFF) * (length + 1) + (own & 0xFFFF)]
        return _fisher(uniform[np.einsum("ij,ij->i", counts, counts)] + turned + serial)

    return measured


def codes(encoding: int, symbols: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Encoding, length class and score bin of each sequence as one number."""
    return _codes(encoding, battery(symbols, lengths, int(_SIZE[encoding])), lengths)


def _codes(encoding: int, p: np.ndarray, lengths: np.ndarray | int) -> np.ndarray:
    bins = np.minimum(-STEPS * np.log10(np.maximum(p, 1e-300)), BINS - 1).astype(np.int64)
    group = np.searchsorted(CLASSES, lengths, "right") - 1
    return (encoding * len(CLASSES) + group) * BINS + np.maximum(bins, 0)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the base matches, by start and then kind."""
    found = [(k, *m.span()) for k, pattern in enumerate(_LONG, 1) for m in pattern.finditer(text)]
    if ":" in text or "=" in text:
        found += [(0, *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    return sorted(found, key=lambda x: (x[1], x[0]))


def runs_of(text: str) -> list[tuple[int, int, int]]:
    """(start, end, code) of the text's runs."""
    at = [m.span() for m in RUN.finditer(text)]
    out: list[tuple[int, int, int]] = []
    if not at:
        return out
    lengths = np.array([b - a for a, b in at])
    data = np.frombuffer("".join(text[a:b] for a, b in at).encode(), np.uint8)
    starts = np.cumsum(lengths) - lengths
    fits = np.array([np.minimum.reduceat(_SYMBOL[e][data], starts) >= 0 for e in range(len(ENCODINGS))])
    kind, owner = fits.argmax(axis=0), np.repeat(np.arange(len(at)), lengths)
    for e in np.unique(kind):
        mine = np.flatnonzero(kind == e)
        found = codes(int(e), _SYMBOL[e][data[kind[owner] == e]], lengths[mine])
        out += [(*at[i], int(c)) for i, c in zip(mine, found)]
    return sorted(out)


def decoys_of(texts: list[str]) -> np.ndarray:
    """Codes of windows of ordinary text.

    Every whole text is reduced to every alphabet and cut into windows of every class's length, from its first
    symbol on; a last window ends with the text, so each symbol is in a window wherever the text is long enough.
    """
    plain = [RUN.sub(" ", text).encode("ascii", "ignore") for text in texts]
    found = [np.zeros(0, np.int64)]
    for e, (table, others) in enumerate(_REDUCED):
        reduced = [x.translate(table, others) for x in plain]
        size = np.array([len(x) for x in reduced])
        symbols, first = np.frombuffer(b"".join(reduced), np.int8), np.cumsum(size) - size
        measured = windows(symbols, int(_SIZE[e]))
        for length in CLASSES:
            n = np.where(size >= length, -(-size // length), 0)
            if not n.any():
                break
            place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            starts = np.repeat(first, n) + np.minimum(place * length, np.repeat(size, n) - length)
            for k in range(0, len(starts), WINDOWS):
                found.append(_codes(e, measured(starts[k : k + WINDOWS], length), length))
    return np.concatenate(found)


_SPAN = T.StructType().add("kind", "integer").add("start", "long").add("end", "long")
_RUN = T.StructType().add("start", "long").add("end", "long").add("code", "integer")
_COUNT = T.StructType().add("code", "integer").add("n", "long")


def scanned(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, base, runs, decoys) for every document; a batch's first row has the histogram of its decoys."""
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType)])
    schema = schema.add("base", T.ArrayType(_SPAN)).add("runs", T.ArrayType(_RUN)).add("decoys", T.ArrayType(_COUNT))
    arrow = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                texts = [x or "" for x in part.column(1).to_pylist()]
                seen, n = np.unique(decoys_of(texts), return_counts=True)
                decoys = [list(zip(seen.tolist(), n.tolist()))] + [[]] * (len(texts) - 1)
                columns = [part.column(0), *(pa.array(x, arrow.field(name).type) for name, x in (("base", list(map(base_spans, texts))), ("runs", list(map(runs_of, texts))), ("decoys", decoys)))]
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return docs.select(F.col(id_col).alias("id"), text_col).mapInArrow(run, schema)


def discoveries(runs: DataFrame, decoys: DataFrame, level: float = LEVEL) -> DataFrame:
    """(code) of the histogram cells that are called random: group Benjamini-Hochberg over (code, n) counts of both."""
    group = F.floor(F.col("code") / BINS)
    both = runs.select("code", "n", F.lit(0).cast("long").alias("text")).unionByName(decoys.select("code", F.lit(0).cast("long").alias("n"), F.col("n").alias("text")))
    cells = both.groupBy("code").agg(F.sum("n").alias("n"), F.sum("text").alias("text")).withColumn("g", group)
    whole, upto = Window.partitionBy("g"), Window.partitionBy("g").orderBy("code").rangeBetween(Window.unboundedPreceding, 0)
    p = (F.sum("text").over(upto) + 1) / (F.sum("text").over(whole) + 1)
    cells = cells.withColumn("p", p).withColumn("of", F.sum("n").over(whole))
    plain = (F.sum(F.when(F.col("p") > 0.5, F.col("n")).otherwise(0)).over(whole) + 1) / (0.5 * F.col("of"))
    cells = cells.filter("of > 0").withColumn("plain", F.least(F.lit(1.0), plain)).filter("n > 0 and plain < 1")
    cells = cells.withColumn("weighted", F.col("p") * F.col("plain") / (1 - F.col("plain")))
    order = Window.orderBy("weighted").rangeBetween(Window.unboundedPreceding, 0)  # at most as many rows as cells
    everything = Window.partitionBy(F.lit(0))
    total = runs.agg(F.sum("n").alias("total"))
    held = cells.withColumn("called", F.sum("n").over(order)).join(F.broadcast(total))
    # the share of text among all runs: that of the groups that can be told, and the whole of the others
    random = F.sum(F.col("n") * (1 - F.col("plain"))).over(everything) / F.col("total")
    fits = F.col("weighted") <= level * F.col("called") / F.col("total") / F.greatest(random, F.lit(1e-12))
    last = F.max(F.when(fits, F.col("weighted"))).over(everything)
    return held.withColumn("last", last).filter("weighted <= last").select("code")


def _joined(spans: Column) -> Column:
    name = lambda s: F.element_at(F.lit(list(KINDS)), s["kind"] + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", level: float = LEVEL) -> DataFrame:
    """(id, base, spans) for every document: arrays of (kind number, start, end) in code points, end exclusive.

    ``base`` has the matches of the fixed patterns, ``spans`` those and the runs called random that no base
    span holds, by start and then kind.  Null and empty texts have none.  Rows that repeat, and null ids,
    stay; an empty table gives an empty table.  Texts are read whole.
    """
    found = written(scanned(docs, id_col, text_col), "secrets")
    counted = lambda name, n: found.select(F.explode(name).alias("x")).groupBy("x.code").agg(n.cast("long").alias("n"))
    cells = discoveries(counted("runs", F.count("*")), counted("decoys", F.sum("x.n")), level)
    called = sorted(r[0] for r in cells.collect())  # cells of the histogram: at most len(ENCODINGS) * len(CLASSES) * BINS
    inside = lambda r: F.exists("base", lambda s: (s["start"] <= r["start"]) & (r["end"] <= s["end"]))
    picked = F.filter("runs", lambda r: F.array_contains(F.lit(np.array(called, np.int32)), r["code"]) & ~inside(r))
    as_span = lambda r: F.struct(F.lit(KINDS.index("random")).alias("kind"), r["start"].alias("start"), r["end"].alias("end"))
    every = F.concat("base", F.transform(picked, as_span))
    ordered = F.array_sort(F.transform(every, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))
    spans = F.transform(ordered, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return found.select(F.col("id").alias(id_col), "base", spans.alias("spans"))


def digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts by kind, a digest of the base spans and all spans as one string."""
    of = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    counts = [of(k).alias(f"n_{name}") for k, name in enumerate(KINDS[:3])]
    return found.select(id_col, *counts, F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))
