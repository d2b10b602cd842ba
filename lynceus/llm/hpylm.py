"""A hierarchical Pitman-Yor language model (operator 8).

Texts are streams of bytes: lower-cased words, a space after each but the last, and one end.  A context
of up to ``ORDER`` bytes is a restaurant, whose parent is the context without its earliest byte: contexts
that end alike share it.  Customers of the longest contexts are the stream's bytes; each table of a
restaurant is a customer of its parent, and bytes are uniform above the empty context.  The probability
of a text is the product over its stream, so one model covers known and unknown words alike.

The seating is sampled by a blocked Gibbs sampler.  Its state is, for every restaurant, the masses of a
random measure drawn from its posterior.  A sweep goes up the tree and draws, for each context and byte,
the number of tables at which its customers sit, given the parent's measure and with the own one
integrated out; then it goes down the tree and draws every measure anew, given the tables.  The discount
is one half at every level, the strength of each level is sampled with the rest.  With that discount each of these conditionals has a closed form (the numbers of
seatings are Bessel coefficients, the mass of fresh tables is inverse Gaussian), so that every draw is
exact, whether there are two customers or ten million, and no customer has to be visited by itself.

Everything that grows with the corpus stays dealt out.  Blocks of documents count the n-grams and words
they hold once each, and shards by a hash of the key merge the counts.  The n-grams, now once each, go
to houses by the last three bytes of their contexts: a house has the restaurants of five to three bytes.
Restaurants of two bytes are dealt by their last byte, at most 65,536 counts for each; those of one byte
and of none, at most 257 with 65,536 counts, are on the driver.  The sampler runs twice: first from the
houses up, each tier with its own guess of what is above, so that tables reach the top; then from the top
down, each tier's sweeps given the samples of the tier above.  Predictive probabilities are averaged over
the samples after the first ones; houses answer the shards with them, and those the blocks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .blocks import chunks, dealt, partitions, split, texts_of, written
from .words import Words, mix

#: Bytes of context, and how many of them a house's restaurants share.
ORDER, SHARED = 5, 3
DISCOUNT = 0.5
#: Values that a level's strength is sampled from, with equal prior weight.
STRENGTHS = np.geomspace(0.02, 50, 48)
SWEEPS, BURN = 6, 2
FOLDS, HELD_OUT = 7, 2

PACKET = "block int, shard int, kind int, size long, a binary, b binary"
PACKET_TYPE = pa.schema([("block", pa.int32()), ("shard", pa.int32()), ("kind", pa.int32()), ("size", pa.int64()), ("a", pa.binary()), ("b", pa.binary())])
NGRAMS, WORDS, TOTAL = 0, 1, 2
U = np.uint64


def _packets(rows: list[tuple]) -> pa.Table:
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [()] * 6, PACKET_TYPE)], schema=PACKET_TYPE)


def home(grams: np.ndarray) -> np.ndarray:
    """A hash that n-grams share if the last bytes of their contexts are alike."""
    return mix((grams >> U(8)) & U((1 << 8 * SHARED) - 1))


def _unique(x: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values, ascending, and the sums of their weights (or their counts)."""
    if weight is None:
        x = np.sort(x)
        at = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1]))) if len(x) else np.zeros(0, np.int64)
        return x[at], np.diff(at, append=len(x))
    order = np.argsort(x, kind="stable")
    x, weight = x[order], weight[order]
    at = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1]))) if len(x) else np.zeros(0, np.int64)
    return x[at], np.add.reduceat(weight, at) if len(x) else weight


class Tally:
    """Distinct keys and sums of their counts, merged whenever what is new outweighs what there is."""

    def __init__(self):
        self.keys, self.counts = np.zeros(0, U), np.zeros(0, np.uint32)
        self.fresh: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.fresh.append((keys, counts.astype(np.uint32)))
        if sum(len(k) for k, _ in self.fresh) > len(self.keys) + 500_000:
            self.merged()

    def merged(self) -> tuple[np.ndarray, np.ndarray]:
        if self.fresh:
            keys, counts = zip((self.keys, self.counts), *self.fresh)
            self.fresh = []
            self.keys, self.counts = _unique(np.concatenate(keys), np.concatenate(counts))
        return self.keys, self.counts


def stream(text: bytes) -> bytes:
    return b" ".join(text.lower().split()) + b"\n"


class Block:
    """One block's documents; ``parts`` gives runs of them as n-grams and word hashes."""

    def __init__(self, table: pa.Table):
        table = table.combine_chunks()
        self.id = table.column("block")[0].as_py()
        self.texts = texts_of(table.column("text"))
        self.trained = table.column("trained").to_numpy()

    def parts(self):
        """(from, to, n-grams, bytes per text, word hashes, words per text)"""
        for a, b in chunks(self.texts, 1 << 20):
            streams = [b"\n" * ORDER + stream(x) for x in self.texts[a:b]]
            sizes = np.array([len(x) - ORDER for x in streams])
            data = np.frombuffer(b"".join(streams), np.uint8)
            grams = np.zeros(len(data) - ORDER, U)
            for k in range(ORDER + 1):
                grams = grams << U(8) | data[k : k + len(grams)]
            inside = np.ones(len(data), bool)  # n-grams that end in a text, not in what pads it
            begins = np.cumsum(sizes + ORDER) - (sizes + ORDER)
            inside[(begins[:, None] + np.arange(ORDER)).ravel()] = False
            w = Words(self.texts[a:b], lower=True)
            yield a, b, grams[inside[ORDER:]], sizes, w.hashes(3), np.diff(w.first)


def _count(shards: int):
    def run(table: pa.Table) -> pa.Table:
        block = Block(table)
        found = [Tally(), Tally()]
        tokens = 0
        for a, b, grams, sizes, words, n_words in block.parts():
            own = block.trained[a:b]
            tokens += int((n_words + 1)[own].sum())
            for kind, x, n in ((0, grams, sizes), (1, words, n_words)):
                learned = np.repeat(own, n)
                for part, weight in ((x[learned], 1), (x[~learned], 0)):
                    keys, c = _unique(part)
                    found[kind].add(keys, c * weight)
        rows = [(block.id, 0, TOTAL, tokens, None, None)]
        for kind, by in ((NGRAMS, mix), (WORDS, lambda x: x)):
            keys, c = found[kind].merged()
            if kind == NGRAMS:
                order = np.argsort(by(keys), kind="stable")
                keys, c = keys[order], c[order]
            for k, i, j in split(by(keys), shards):
                rows.append((block.id, k, kind, j - i, keys[i:j].tobytes(), c[i:j].astype(np.uint32).tobytes()))
        return _packets(rows)

    return run


def tables_drawn(customers: np.ndarray, weight: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """The number of tables t, from 1 to the number of customers c, drawn with P(t) ~ S(c, t) weight**t.

    S(c, t) counts seatings at discount one half, where S(c, t + 1) / S(c, t) = 4 (c - t) / (t (2c - t - 1)).
    These ratios fall, so P has one mode; it is summed over eight deviations and more on either side of it,
    beyond which less than the precision of a float is left.
    """
    c, w = customers.astype(float), np.maximum(weight, 1e-300)
    b = 2 * c - 1 + 4 * w
    mode = 8 * w * c / (b + np.sqrt(np.maximum(b * b - 16 * w * c, 0)))
    wide = 8 / np.sqrt(1 / np.maximum(mode, 0.5) + 1 / (c - mode + 0.5) - 1 / np.maximum(2 * c - mode, 1)) + 8
    low, high = np.maximum(1, np.floor(mode - wide)), np.minimum(c, np.ceil(mode + wide))
    t = low.astype(np.int64)
    size = (high - low + 1).astype(np.int64)
    order = np.argsort(size, kind="stable")
    at = int(np.searchsorted(size[order], 2))  # the others have one possible number
    while at < len(order):
        n = int(size[order[at]])
        n = max(n + n // 4, 4)
        end = min(at + max(1, (1 << 19) // n), int(np.searchsorted(size[order], n, "right")))
        rows = order[at:end]
        x = low[rows, None] + np.arange(n - 1)
        own = c[rows, None]
        ratio = 4 * w[rows, None] * np.maximum(own - x, 0) / (x * np.maximum(2 * own - x - 1, 1))
        ratio[x >= high[rows, None]] = 0
        steps = np.zeros((len(rows), n))
        with np.errstate(divide="ignore"):
            np.cumsum(np.log(ratio), axis=1, out=steps[:, 1:])
        mass = np.cumsum(np.exp(steps - steps.max(axis=1, keepdims=True)), axis=1)
        t[rows] += (mass < rng.random(len(rows))[:, None] * mass[:, -1:]).sum(axis=1)
        at = end
    return t


def inverse_gaussian(mean: np.ndarray, shape: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Draws by the root that the square of a normal one gives, in a form without cancellation."""
    mean, shape = np.maximum(mean, 1e-150), np.maximum(shape, 1e-300)
    a = mean * rng.standard_normal(len(mean)) ** 2 / (2 * shape)
    x = mean / (1 + a + np.sqrt(a * (a + 2)))
    return np.where(rng.random(len(mean)) * (mean + x) <= mean, x, mean * (mean / np.maximum(x, 1e-300)))


def log_gamma(x: np.ndarray) -> np.ndarray:
    """By Stirling's series, eight places on."""
    z = x + 8
    near = np.log(x) + sum(np.log(x + k) for k in range(1, 8))
    return (z - 0.5) * np.log(z) - z + 0.5 * np.log(2 * np.pi) + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - near


class Level:
    """Restaurants of one context length: customers, tables and the measure's masses by (context, byte)."""

    def __init__(self, grams: np.ndarray, length: int):
        self.length, self.grams = length, grams  # sorted; context bytes, then the byte
        self.contexts, self.of = np.unique(grams >> U(8), return_inverse=True)
        self.t = np.ones(len(grams), np.int64)

    def serve(self, customers: np.ndarray) -> None:
        self.c = customers.astype(np.int64)
        self.c_all = self._all(self.c)

    def _all(self, x: np.ndarray) -> np.ndarray:
        return np.bincount(self.of, x, len(self.contexts))

    def begin(self, rng: np.random.Generator, strength: float | None, fixed: bool) -> None:
        """Some state to start from; without a given ``strength`` it is sampled."""
        self.strength, self.sampled = strength or 1.0, strength is None
        prior = -len(self.contexts) * log_gamma(STRENGTHS / DISCOUNT)
        if fixed:  # the customers' number is never drawn, so its normalisation counts
            sizes, n = np.unique(self.c_all, return_counts=True)
            prior += len(self.contexts) * log_gamma(STRENGTHS) - np.array([(n * log_gamma(s + sizes)).sum() for s in STRENGTHS])
        self.prior = prior
        self.time = rng.standard_gamma(self.strength / DISCOUNT + self._all(self.t))
        self.tilt, self.total = np.zeros(len(self.contexts)), np.ones(len(self.contexts))

    def seat(self, above: np.ndarray, rng: np.random.Generator, fixed: bool) -> None:
        """Draws the tables, given the parent's probabilities of the bytes, and what follows from them alone.

        ``time`` is how long the stable process behind the measure has run, ``tilt`` stands for the
        measure's normalisation.  Where the customers are the data (``fixed``) both are one variable.
        """
        if fixed:
            self.time = rng.standard_gamma(self.strength / DISCOUNT + self._all(self.t))
            speed = self.time
        else:
            self.tilt = rng.standard_gamma(np.maximum(self.c_all, 1)) / self.total
            speed = self.time * (1 + self.tilt) ** DISCOUNT
        self.t = tables_drawn(self.c, DISCOUNT * speed[self.of] * above, rng)
        if not fixed:
            self.time = rng.standard_gamma(self.strength / DISCOUNT + self._all(self.t)) / (1 + self.tilt) ** DISCOUNT
        if self.sampled and len(self.contexts):
            odds = self.prior + STRENGTHS / DISCOUNT * np.log(np.maximum(self.time, 1e-300)).sum()
            mass = np.cumsum(np.exp(odds - odds.max()))
            self.strength = float(STRENGTHS[int((mass < rng.random() * mass[-1]).sum())])

    def measure(self, above: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        """Draws the measure given the tables; the probabilities of the restaurant's bytes."""
        scale = 1 + self.tilt
        left = np.maximum(1 - self._all(above), 1e-12)  # of bytes that the restaurant has not served
        fresh = lambda share, time, tilt: inverse_gaussian(time * share / (2 * np.sqrt(tilt)), (time * share) ** 2 / 2, rng)
        mass = rng.standard_gamma(self.c - DISCOUNT * self.t) / scale[self.of]
        mass += fresh(above, self.time[self.of], scale[self.of])
        self.total = self._all(mass) + fresh(left, self.time, scale)
        return mass / self.total[self.of]

    def predict(self, grams: np.ndarray, above: np.ndarray) -> np.ndarray:
        """Probability of each n-gram's byte, given the parents' probabilities of it."""
        out = np.array(above, float)
        contexts = grams >> U(8)
        at = np.minimum(np.searchsorted(self.contexts, contexts), max(len(self.contexts) - 1, 0))
        known = self.contexts[at] == contexts if len(self.contexts) else np.zeros(len(grams), bool)
        at, own = at[known], grams[known]
        row = np.minimum(np.searchsorted(self.grams, own), len(self.grams) - 1) if len(self.grams) else at
        has = self.grams[row] == own if len(self.grams) else np.zeros(0, bool)
        seats = np.where(has, self.c[row] - DISCOUNT * self.t[row], 0) if len(self.grams) else 0
        tables = self._all(self.t)
        out[known] = (seats + (self.strength + DISCOUNT * tables[at]) * out[known]) / (self.strength + self.c_all[at])
        return out


class Tier:
    """The restaurants of some context lengths, longest first, over n-grams that their customers are."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray, longest: int, shortest: int, rng: np.random.Generator, fixed: bool, strength: float | None = None):
        self.rng, self.fixed = rng, fixed
        self.levels, self.parent = [Level(grams[counts > 0], longest)], []
        self.levels[0].serve(counts[counts > 0])
        for length in range(longest - 1, shortest - 1, -1):
            keys, parent = np.unique(self.levels[-1].grams & U((1 << 8 * (length + 1)) - 1), return_inverse=True)
            self.parent.append(parent)
            self.levels.append(Level(keys, length))
            self.levels[-1].serve(np.bincount(parent, minlength=len(keys)))
        for k, level in enumerate(self.levels):
            level.begin(rng, strength, fixed and not k)
        self.shares: list[np.ndarray] = []

    @property
    def outer(self) -> np.ndarray:
        """The n-grams of the shortest contexts, whose probabilities the tier above has to give."""
        return self.levels[-1].grams

    def guess(self) -> np.ndarray:
        """Probabilities for ``outer`` where nothing is known from above: shares of kinds of contexts."""
        level = self.levels[-1]
        keys, counts = _unique(level.grams & U((1 << 8 * level.length) - 1))
        own = counts[np.searchsorted(keys, level.grams & U((1 << 8 * level.length) - 1))]
        return (own + 1 / 256) / (np.bincount(level.of, own, len(level.contexts))[level.of] + 1)

    def _down(self, above: np.ndarray) -> None:
        self.shares = [above]
        for k in range(len(self.levels) - 1, 0, -1):
            self.shares.insert(0, self.levels[k].measure(self.shares[0], self.rng)[self.parent[k - 1]])
        if not self.fixed:
            self.drawn = self.levels[0].measure(self.shares[0], self.rng)

    def sweep(self, above: np.ndarray) -> np.ndarray:
        """One sweep, given the probabilities of ``outer`` above; the tables there."""
        if not self.shares:
            self._down(above)
        self.shares[-1] = above
        for k, level in enumerate(self.levels):
            if k:
                level.serve(np.bincount(self.parent[k - 1], self.levels[k - 1].t, len(level.grams)))
            level.seat(self.shares[k], self.rng, self.fixed and not k)
        self._down(above)
        return self.levels[-1].t

    def predict(self, grams: np.ndarray, above: np.ndarray) -> np.ndarray:
        """Predictive probabilities of n-grams of the longest contexts, from those of the tier above."""
        for level in self.levels[::-1]:
            above = level.predict(grams & U((1 << 8 * (level.length + 1)) - 1), above)
        return above


def _merged(rows: list[dict], kind: type = np.uint32) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and their counts over all packets, whose counts are of a kind: a block's fit 32 bits."""
    keys = np.concatenate([np.frombuffer(r["a"], U) for r in rows])
    counts = np.concatenate([np.frombuffer(r["b"], kind) for r in rows]).astype(np.int64)
    return _unique(keys, counts)


def _housed(shards: int):
    """A shard's n-grams, counted over all blocks, to the houses; in these packets block is the shard."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        grams, counts = _merged(rows)
        order = np.argsort(home(grams), kind="stable")
        grams, counts = grams[order], counts[order]
        me = rows[0]["shard"]
        return _packets([(me, k, NGRAMS, j - i, grams[i:j].tobytes(), counts[i:j].tobytes()) for k, i, j in split(home(grams), shards)])

    return run


def _forwarded(asked: pa.Table, answers: pa.Table) -> pa.Table:
    """What the houses answered to a shard, to each of its blocks."""
    if not asked.num_rows:
        return _packets([])
    rows = asked.to_pylist()
    grams, _ = _merged(rows)
    parts = sorted((r["shard"], r["a"]) for r in answers.select(["shard", "a"]).to_pylist())
    logs = np.zeros(len(grams))
    logs[np.argsort(home(grams), kind="stable")] = np.concatenate([np.frombuffer(a, float) for _, a in parts])
    of = lambda r: logs[np.searchsorted(grams, np.frombuffer(r["a"], U))].tobytes()
    return _packets([(r["block"], r["shard"], NGRAMS, r["size"], of(r), None) for r in rows])


def _sent_up(table: pa.Table) -> pa.Table:
    """A house's tables, as customers of the restaurants of two bytes, and all n-grams it asks for there."""
    rows = table.to_pylist()
    me = int(rows[0]["shard"])
    grams, counts = _merged(rows, np.int64)
    house = Tier(grams, counts, ORDER, SHARED, np.random.default_rng([8, me]), True)
    guess, tables = house.guess(), np.zeros(0, np.int64)
    for _ in range(BURN + 1):
        tables = house.sweep(guess)
    mask = U((1 << 8 * SHARED) - 1)
    keys, at = np.unique(grams & mask, return_inverse=True)
    customers = np.zeros(len(keys), np.int64)
    if len(house.outer):
        np.add.at(customers, np.searchsorted(keys, house.outer & mask), tables)
    by = (keys >> U(8)) & U(255)
    order = np.argsort(by, kind="stable")
    bounds = np.searchsorted(by[order], np.arange(257))
    out = [(me, k, NGRAMS, j - i, keys[order[i:j]].tobytes(), customers[order[i:j]].tobytes()) for k, (i, j) in enumerate(zip(bounds.tolist(), bounds[1:].tolist())) if j > i]
    return _packets(out)


def _middle(table: pa.Table) -> Tier:
    """The restaurants of two bytes that share their last byte."""
    rows = table.to_pylist()
    return Tier(*_merged(rows, np.int64), SHARED - 1, SHARED - 1, np.random.default_rng([9, int(rows[0]["shard"])]), False)


def _tables(table: pa.Table) -> pa.Table:
    """What restaurants of two bytes send to those of one byte: customers by (byte, byte)."""
    tier = _middle(table)
    guess, t = tier.guess(), np.zeros(0, np.int64)
    for _ in range(BURN + 1):
        t = tier.sweep(guess)
    keys, customers = _unique(tier.outer & U(0xFFFF), t)
    return pa.table({"gram": pa.array(keys.astype(np.int64)), "customers": pa.array(customers)})


def top_samples(customers: dict[int, int], seed: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """By sweep, previous byte and byte: the measures drawn for one byte of context, and the predictive ones."""
    every, flat = np.arange(65536, dtype=U), np.full((SWEEPS, 65536), 1 / 256)
    if not customers:
        return flat, flat
    keys = np.array(sorted(customers), U)
    tier = Tier(keys, np.array([customers[int(k)] for k in keys.tolist()]), 1, 0, np.random.default_rng(seed), False)
    drawn, mean = np.zeros((SWEEPS, 65536)), np.zeros((SWEEPS, 65536))
    uniform = np.full(len(tier.outer), 1 / 256)
    for k in range(BURN + SWEEPS):
        tier.sweep(uniform)
        if k >= BURN:
            mean[k - BURN] = tier.predict(every, np.full(65536, 1 / 256))
            drawn[k - BURN, keys.astype(np.int64)] = tier.drawn
    return drawn, mean


def _down(top: tuple[np.ndarray, np.ndarray]):
    """The samples of restaurants of two bytes, to each house that asked for their n-grams."""
    drawn, mean = top

    def run(table: pa.Table) -> pa.Table:
        tier, rows = _middle(table), table.to_pylist()
        grams, _ = _merged(rows, np.int64)
        outer, low = (tier.outer & U(0xFFFF)).astype(np.int64), (grams & U(0xFFFF)).astype(np.int64)
        has = np.searchsorted(grams, tier.levels[0].grams)
        draws, means = np.zeros((SWEEPS, len(grams))), np.zeros((SWEEPS, len(grams)))
        for k in range(SWEEPS):
            tier.sweep(drawn[k][outer])
            means[k] = tier.predict(grams, mean[k][low])
            draws[k, has] = tier.drawn
        out = []
        for r in rows:
            at = np.searchsorted(grams, np.frombuffer(r["a"], U))
            out.append((r["block"], r["shard"], NGRAMS, r["size"], draws[:, at].tobytes(), means[:, at].tobytes()))
        return _packets(out)

    return run


def _answers(asked: pa.Table, replies: pa.Table) -> pa.Table:
    """A house's averaged log10 probabilities for each shard's n-grams."""
    if not asked.num_rows:
        return _packets([])
    rows = asked.to_pylist()
    me = int(rows[0]["shard"])
    grams, counts = _merged(rows, np.int64)
    mask = U((1 << 8 * SHARED) - 1)
    keys, at = np.unique(grams & mask, return_inverse=True)
    order = np.argsort((keys >> U(8)) & U(255), kind="stable")
    drawn, mean = np.zeros((SWEEPS, len(keys))), np.zeros((SWEEPS, len(keys)))
    parts = sorted((r["shard"], r["a"], r["b"]) for r in replies.select(["shard", "a", "b"]).to_pylist())
    for k, out in ((1, drawn), (2, mean)):
        out[:, order] = np.concatenate([np.frombuffer(p[k], float).reshape(SWEEPS, -1) for p in parts], axis=1)
    house = Tier(grams, counts, ORDER, SHARED, np.random.default_rng([10, me]), True)
    outer = np.searchsorted(keys, house.outer & mask)
    total = np.zeros(len(grams))
    for k in range(SWEEPS):
        house.sweep(drawn[k][outer])
        if k >= BURN:
            total += house.predict(grams, mean[k][at])
    logs = np.log10(total / (SWEEPS - BURN))
    return _packets([(r["block"], r["shard"], NGRAMS, r["size"], logs[np.searchsorted(grams, np.frombuffer(r["a"], U))].tobytes(), None) for r in rows])


def _word_counts(table: pa.Table) -> pa.Table:
    """A shard's counts of each block's words, and how many of its words were trained on."""
    rows = table.to_pylist()
    keys, counts = _merged(rows)
    out = [(-1, rows[0]["shard"], TOTAL, int((counts > 0).sum()), None, None)]
    for r in rows:
        own = counts[np.searchsorted(keys, np.frombuffer(r["a"], U))]
        out.append((r["block"], r["shard"], WORDS, r["size"], own.tobytes(), None))
    return _packets(out)


def _score(id_name: str, ends: int, tokens: int, distinct: int, schema: pa.Schema):
    """Each document's sums; ``ends`` is the end token's count."""

    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return schema.empty_table()
        block = Block(docs)
        replies = answers.select(["shard", "kind", "a"]).to_pylist()
        of = {}
        for kind, dtype in ((NGRAMS, float), (WORDS, np.int64)):
            parts = sorted((r["shard"], r["a"]) for r in replies if r["kind"] == kind)
            of[kind] = np.concatenate([np.frombuffer(a, dtype) for _, a in parts]) if parts else np.zeros(0, dtype)
        found = [Tally(), Tally()]
        for _, _, grams, _, words, _ in block.parts():
            found[0].add(*_unique(grams))
            found[1].add(*_unique(words))
        keys, words_held = found[0].merged()[0], found[1].merged()[0]
        logs = np.zeros(len(keys))
        logs[np.argsort(mix(keys), kind="stable")] = of[NGRAMS]
        columns = {"n_tokens": [], "n_known": [], "base_score": [], "score": []}
        scale = np.log10(float(tokens + distinct + 1))
        total = lambda x, n: np.diff(np.concatenate(([0.0], np.cumsum(x)))[np.concatenate(([0], np.cumsum(n)))])
        for _, _, grams, sizes, words, n in block.parts():
            c = of[WORDS][np.searchsorted(words_held, words)].astype(float)
            columns["n_tokens"].append(n + 1)
            columns["n_known"].append(total((c > 0).astype(float), n).round().astype(np.int64) + (ends > 0))
            columns["base_score"].append(total(np.log10(c + 1), n) + np.log10(ends + 1) - (n + 1) * scale)
            columns["score"].append(total(logs[np.searchsorted(keys, grams)], sizes))
        made = {k: np.concatenate(v) for k, v in columns.items()}
        table = docs.combine_chunks()
        arrays = [table.column(id_name), pa.array(~block.trained), pa.array(made["n_tokens"]), pa.array(made["n_known"])]
        arrays += [pa.array(np.full(len(block.texts), tokens)), pa.array(made["base_score"]), pa.array(made["score"])]
        return pa.Table.from_arrays(arrays, schema=schema)

    return run


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every document.

    Documents whose crc32(id as text) mod 7 is 2 are held out, the others are learned from.  Words are
    lower-cased (A-Z) runs of bytes other than space and \\x09-\\x0D, and one end follows them.  Null and
    empty texts are the end alone; a null id counts as an empty text in the crc32.  Repeated rows count
    and are scored each.  Without a training document every byte is uniform.  An empty table gives an
    empty table.
    """
    spark = docs.sparkSession
    shards = partitions(spark)
    fold = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % FOLDS
    rows = docs.select(F.col(id_col), F.col(text_col).alias("text"), (fold != HELD_OUT).alias("trained"))
    texts = dealt(rows, id_col, "text", "trained")
    asked = written(texts.groupBy("block").applyInArrow(_count(shards), PACKET), "counts")
    grams = asked.filter(F.col("kind") == NGRAMS)
    housed = written(grams.groupBy("shard").applyInArrow(_housed(shards), PACKET), "houses")
    sent = written(housed.groupBy("shard").applyInArrow(_sent_up, PACKET), "tables")
    low = sent.groupBy("shard").applyInArrow(_tables, "gram long, customers long")
    customers = {r[0]: r[1] for r in low.groupBy("gram").agg(F.sum("customers")).collect()}  # at most 65,536
    ends = rows.filter("trained").count()
    tokens = asked.filter(F.col("kind") == TOTAL).agg(F.sum("size")).first()[0] or 0
    counted = asked.filter(F.col("kind") == WORDS).groupBy("shard").applyInArrow(_word_counts, PACKET)
    counted = written(counted, "words")
    distinct = (counted.filter(F.col("kind") == TOTAL).agg(F.sum("size")).first()[0] or 0) + (ends > 0)
    samples = sent.groupBy("shard").applyInArrow(_down(top_samples(customers)), PACKET)
    answers = housed.groupBy("shard").cogroup(samples.groupBy("block")).applyInArrow(_answers, PACKET)
    answers = grams.groupBy("shard").cogroup(answers.groupBy("block")).applyInArrow(_forwarded, PACKET)
    replies = counted.filter(F.col("kind") == WORDS).unionByName(answers)
    number, real = T.LongType(), T.DoubleType()
    schema = T.StructType([docs.schema[id_col], T.StructField("held_out", T.BooleanType())])
    for name, kind in (("n_tokens", number), ("n_known", number), ("train_tokens", number), ("base_score", real), ("score", real)):
        schema = schema.add(name, kind)
    run = _score(id_col, ends, tokens, distinct, to_arrow_schema(schema))
    return texts.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(run, schema)

