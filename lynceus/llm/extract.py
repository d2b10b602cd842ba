"""Main-text extraction by a recurrent block labeller (operator 10).

A page is cut into leaf blocks: runs of text between the tags of block elements.  Each block is a vector
of its hashed tag path (tags, classes, ids and roles of all open elements), its hashed words and a few
shares; a bidirectional LSTM in numpy reads the page's blocks in order from both ends and labels each
as main text or not, so that a block's label draws on the whole document.

The labeller is trained here, on a bounded sample of the given pages whose semantic elements label
them, and on the same pages' texts set in other layouts, whose labels come from how they are made: the
element names are replaced by classes, in a third of them by classes without a meaning, and other
boilerplate stands around.  It starts from a fixed seed.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .blocks import lowest
from .words import Words

#: Pages that the labeller is trained on, at most, and how often each is laid out anew.
SAMPLE, LAYOUTS = 240, 3
#: Share of the layouts in which no element or class name tells what a block is.
OPAQUE = 0.35
HIDDEN, PATH, TERMS, SHARES = 12, 48, 16, 4
WIDTH = PATH + TERMS + SHARES
CELL = 3.0
#: Blocks, padding included, that the network reads at once.
CELLS = 20_000

#: Elements that stand inside a block's text, and elements without an end.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("script style template noscript title textarea select option iframe object svg math head".split())
CLOSES_ITSELF = frozenset("p li dt dd tr td th".split())

RAW = re.compile(r"(script|style|template|noscript|textarea|title)\b", re.I)
ELEMENT = re.compile(r"[a-zA-Z][a-zA-Z0-9:-]*")
SPECIAL = re.compile(r"[>\"']")
NAMING = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
NAME = re.compile(r"[a-z]+")

#: Names of elements and classes that mark what is no main text, and what is.
ASIDE = frozenset("nav header footer aside form menu sidebar ad ads advert banner cookie notice comment comments share social related breadcrumb subscribe newsletter promo login search pagination copyright".split())
MAIN = frozenset("article main".split())


class Tags:
    """Start and end of every tag, comment and declaration of a page, from left to right, in time linear in its length.

    A tag ends at the first ``>`` outside of quotes.  Where none follows, what was looked at is remembered, so that
    no later tag looks at it again: whether a tag ends depends only on the next of ``>``, ``"`` and ``'`` outside of quotes.
    """

    def __init__(self, page: str):
        self.page, self.last, self.least = page, page.rfind("<"), page.rfind(">")
        self.hopeless: set[int] = set()
        self.next = (0, -1)  # from, to: no special character between them
        self.none: dict[str, int] = {}

    def _special(self, at: int) -> int:
        if not self.next[0] <= at <= self.next[1]:
            found = SPECIAL.search(self.page, at) if at < self.none.get("", len(self.page)) else None
            if not found:
                self.none[""] = min(at, self.none.get("", at))
                return -1
            self.next = at, found.start()
        return self.next[1]

    def _end(self, at: int) -> int:
        """Where the tag ends whose name ends at ``at``; -1 if it does not."""
        seen = []
        while (q := self._special(at)) >= 0 and q not in self.hopeless:
            quote = self.page[q]
            if quote == ">":
                return q
            seen.append(q)
            close = -1 if q >= self.none.get(quote, len(self.page)) else self.page.find(quote, q + 1)
            if close < 0:
                self.none[quote] = min(q, self.none.get(quote, q))
                break
            at = close + 1
        self.hopeless.update(seen)
        return -1

    def __iter__(self):
        """(start, end, name, is an end tag, attributes); no name for what is no element of the text."""
        page, at, n = self.page, 0, len(self.page)
        while (i := page.find("<", at)) >= 0:
            at = i + 1
            if page.startswith("<!--", i):
                end = page.find("-->", i + 4)
                at = n if end < 0 else end + 3
                yield i, at, None, False, ""
                continue
            closing = page.startswith("/", i + 1)
            name = ELEMENT.match(page, i + 1 + closing)
            if name:
                end = self._end(name.end())
                if end >= 0:
                    at = end + 1
                    raw = None if closing else RAW.match(page, i + 1)
                    if raw:
                        close = re.compile(rf"</{raw[1]}\s*>", re.I).search(page, at)
                        at = close.end() if close else n
                        yield i, at, None, False, ""
                    else:
                        yield i, at, name[0].lower(), closing, page[name.end() : end]
                elif i == self.last and self.least < i:  # the page ends inside the tag
                    at = n
                    yield i, at, None, False, ""
            elif page.startswith(("<!", "<?"), i):
                end = page.find(">", i) if i < self.least else -1
                at = n if end < 0 else end + 1
                yield i, at, None, False, ""


#: Of more open elements than this, the path has so many outermost and innermost ones.
DEEP = 64


def blocks(page: str) -> list[tuple[tuple[str, ...], str, int]]:
    """(tag path, text, characters in links) of the page's leaf blocks that have text.

    References are decoded, and white space inside a block is one space.
    """
    out: list[tuple[tuple[str, ...], str, int]] = []
    stack: list[tuple[str, tuple[str, ...], bool, bool]] = []  # with: not seen; inside a link
    parts: list[str] = []
    linked = 0

    def flush():
        nonlocal linked
        if parts:
            if text := " ".join(html.unescape("".join(parts)).split()):
                shown = stack if len(stack) <= 2 * DEEP else stack[:DEEP] + stack[-DEEP:]
                path = tuple(x for _, names, _, _ in shown for x in names)
                out.append((path, text, linked))
            parts.clear()
        linked = 0

    opened: Counter[str] = Counter()

    def close(k: int):
        for name, *_ in stack[k:]:
            opened[name] -= 1
        del stack[k:]

    at = 0
    for start, end, name, closing, attributes in Tags(page):
        if start > at:
            if not stack or not stack[-1][2]:
                parts.append(page[at:start])
                if stack and stack[-1][3]:
                    linked += start - at
        at = end
        if not name:
            continue
        if name not in INLINE:
            flush()
        elif name == "br":
            parts.append(" ")
        if closing:
            for k in range(len(stack) - 1, -1, -1) if opened[name] else ():
                if stack[k][0] == name:
                    close(k)
                    break
            continue
        if name not in INLINE and (opened["p"] or opened[name]):
            for k in range(len(stack) - 1, -1, -1):  # a block ends an open paragraph, an item the item before
                if stack[k][0] == "p" or stack[k][0] == name and name in CLOSES_ITSELF:
                    close(k)
                    break
                if stack[k][0] not in INLINE:
                    break
        if name not in VOID and not attributes.endswith("/"):
            names = (name,)
            if attributes:
                for found in NAMING.finditer(attributes):
                    names += tuple("." + x for x in NAME.findall((found[1] or found[2] or found[3] or "").lower()))
            _, _, unseen, link = stack[-1] if stack else ("", (), False, False)
            stack.append((name, names, unseen or name in UNSEEN, link or name == "a"))
            opened[name] += 1
    if at < len(page):
        if not stack or not stack[-1][2]:
            parts.append(page[at:])
    flush()
    return out


_PATHS: dict[tuple[str, ...], np.ndarray] = {}


def path_vector(path: tuple[str, ...]) -> np.ndarray:
    if path not in _PATHS:
        if len(_PATHS) > 50_000:
            _PATHS.clear()
        v = np.zeros(PATH, np.float32)
        for x in path:
            for salt in (b"1", b"2"):
                h = crc32(x.encode() + salt)
                v[h % PATH] += 1 if h >> 16 & 1 else -1
        _PATHS[path] = v / max(1.0, np.sqrt(len(path)))
    return _PATHS[path]


def vectors(pages: list[list[tuple]]) -> np.ndarray:
    """The blocks of all pages as rows."""
    flat = [b for p in pages for b in p]
    out = np.zeros((len(flat), WIDTH), np.float32)
    if not flat:
        return out
    texts = [t.encode() for _, t, _ in flat]
    at = 0
    for size in range(0, len(flat), 4096):
        w = Words(texts[size : size + 4096], lower=True)
        n = np.diff(w.first)
        term = (w.hashes(5) % np.uint64(TERMS)).astype(np.int64)
        counts = np.bincount(np.repeat(np.arange(len(n)), n) * TERMS + term, minlength=len(n) * TERMS)
        out[at : at + len(n), PATH : PATH + TERMS] = counts.reshape(-1, TERMS) / np.sqrt(np.maximum(n, 1))[:, None] / 4
        out[at : at + len(n), PATH + TERMS] = np.log1p(n) / 5
        at += len(n)
    for k, (path, text, linked) in enumerate(flat):
        out[k, :PATH] = path_vector(path)
        out[k, PATH + TERMS + 1] = min(1.0, linked / len(text))
        out[k, PATH + TERMS + 2] = text[-1] in ".!?"
        out[k, PATH + TERMS + 3] = 1.0
    return out


class Labeller:
    """A bidirectional LSTM with one output; weights are float32 arrays."""

    def __init__(self, seed: int = 10):
        rng = np.random.default_rng(seed)
        draw = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.w = {}
        for way in "fb":
            self.w |= {f"x{way}": draw(WIDTH, 4 * HIDDEN), f"h{way}": draw(HIDDEN, 4 * HIDDEN), f"b{way}": np.zeros(4 * HIDDEN, np.float32)}
            self.w[f"b{way}"][HIDDEN : 2 * HIDDEN] = 1  # forget gates begin open
        self.w |= {"o": draw(2 * HIDDEN, 1), "c": np.zeros(1, np.float32)}

    def _run(self, x: np.ndarray, mask: np.ndarray, way: str, keep: bool):
        n, steps, _ = x.shape
        z_all = x @ self.w["x" + way] + self.w["b" + way]
        h, c = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
        out, trace = np.zeros((n, steps, HIDDEN), np.float32), []
        for t in range(steps) if way == "f" else range(steps - 1, -1, -1):
            z = z_all[:, t] + h @ self.w["h" + way]
            s = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            i, f, o = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN : 3 * HIDDEN]
            g = np.tanh(z[:, 3 * HIDDEN :])
            new = np.clip(f * c + i * g, -CELL, CELL)  # so that a long run of like blocks ends as a short one does
            tanh = np.tanh(new)
            m = mask[:, t, None]
            if keep:
                trace.append((t, h, c, i, f, o, g, tanh, m))
            h, c = np.where(m, o * tanh, h), np.where(m, new, c)
            out[:, t] = h
        return out, trace

    def logits(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        both = np.concatenate([self._run(x, mask, way, False)[0] for way in "fb"], axis=2)
        return (both @ self.w["o"] + self.w["c"])[:, :, 0]

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
        runs = {way: self._run(x, mask, way, True) for way in "fb"}
        both = np.concatenate([runs[way][0] for way in "fb"], axis=2)
        z = (both @ self.w["o"] + self.w["c"])[:, :, 0]
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        loss = float(-(np.log(np.where(y, p, 1 - p) + 1e-7) * mask).sum() / mask.sum())
        d = ((p - y) * mask / mask.sum()).astype(np.float32)[:, :, None]
        grad = {"o": np.einsum("nth,nto->ho", both, d), "c": d.sum((0, 1))}
        back = d @ self.w["o"].T
        for k, way in enumerate("fb"):
            dh_out = back[:, :, k * HIDDEN : (k + 1) * HIDDEN]
            dh, dc = np.zeros_like(dh_out[:, 0]), np.zeros_like(dh_out[:, 0])
            dx, dhh, db = (np.zeros_like(self.w[v + way]) for v in "xhb")
            for t, h, c, i, f, o, g, tanh, m in runs[way][1][::-1]:
                total = dh + dh_out[:, t]
                dh_new, dc_in = total * m, dc * m
                dc_new = (dc_in + dh_new * o * (1 - tanh**2)) * (np.abs(f * c + i * g) < CELL)
                dz = np.concatenate([dc_new * g * i * (1 - i), dc_new * c * f * (1 - f), dh_new * tanh * o * (1 - o), dc_new * i * (1 - g**2)], axis=1)
                dx += x[:, t].T @ dz
                dhh += h.T @ dz
                db += dz.sum(0)
                dh = total * ~m + dz @ self.w["h" + way].T
                dc = dc * ~m + dc_new * f
            grad |= {"x" + way: dx, "h" + way: dhh, "b" + way: db}
        return loss, grad

    def train(self, pages: list[np.ndarray], labels: list[np.ndarray], rounds: int = 14, size: int = 32, rate: float = 0.02, seed: int = 11) -> float:
        """Adam over shuffled batches; the last round's mean loss."""
        rng, step, last = np.random.default_rng(seed), 0, []
        m, v = ({k: np.zeros_like(a) for k, a in self.w.items()} for _ in range(2))
        for r in range(rounds):
            last = []
            order = rng.permutation(len(pages))
            for k in range(0, len(order), size):
                part = order[k : k + size]
                x, mask = padded([pages[j] for j in part])
                x[rng.random(len(part)) < 0.3, :, PATH : PATH + TERMS] = 0  # words differ from site to site
                y = np.zeros(mask.shape, bool)
                for row, j in enumerate(part):
                    y[row, : len(labels[j])] = labels[j]
                loss, grad = self.gradients(x, mask, y)
                last.append(loss)
                step += 1
                for name, g in grad.items():
                    g = np.clip(g, -1, 1)
                    m[name] = 0.9 * m[name] + 0.1 * g
                    v[name] = 0.999 * v[name] + 0.001 * g**2
                    fix = rate * (0.5 ** (r // 5)) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
                    self.w[name] -= (fix * m[name] / (np.sqrt(v[name]) + 1e-8)).astype(np.float32)
        return float(np.mean(last)) if last else 0.0


def padded(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    n = np.array([len(r) for r in rows])
    x = np.zeros((len(rows), max(1, n.max(initial=1)), WIDTH), np.float32)
    for k, r in enumerate(rows):
        x[k, : len(r)] = r
    return x, np.arange(x.shape[1]) < n[:, None]


def marked(path: tuple[str, ...]) -> bool:
    """Whether the element names of a path, and plain classes, make it main text: the teacher's label."""
    bare = [x.lstrip(".") for x in path]
    return any(x in MAIN for x in path) and not any(x in ASIDE for x in bare)


def layout(texts: list[str], titles: list[str], rng: np.random.Generator) -> tuple[str, list[bool]]:
    """A page in another layout around the given main texts, and the labels of its blocks."""
    pick = lambda *x: x[rng.integers(len(x))]
    text = lambda: titles[rng.integers(len(titles))]
    page, labels = ["<html><head><title>t</title></head><body>"], []
    opaque = rng.random() < OPAQUE
    code = lambda: "".join(pick(*"bcdfghjklmnpqrstvwxz") for _ in range(int(rng.integers(3, 8))))

    def put(opening: str, closing: str, inner: list[str], label: bool):
        page.append(opening)
        for x in inner:
            tag = pick("p", "p", "p", "h2", "blockquote", "li") if label else pick("p", "p", "div", "li")
            x = html.escape(x, quote=False)
            page.append(f"<{tag}>" + (x if label or rng.random() < 0.4 else f'<a href="/x">{x}</a>') + f"</{tag}>")
            labels.append(label)
        page.append(closing)

    def aside(kinds: str):
        kind = pick(*kinds.split())
        tag = kind if kind in ("nav", "header", "footer", "aside", "form") else pick("div", "section", "ul")
        if opaque:
            return put(f'<div class="{code()}">', "</div>", [text()[: int(rng.integers(8, 40))] or "x" for _ in range(rng.integers(2, 7))], False)
        mark = "" if tag == kind and rng.random() < 0.6 else f' {pick("class", "id")}="{pick("", "site-", "main-") if rng.random() < 0.3 else ""}{kind}"'
        put(f"<{tag}{mark}>", f"</{tag}>", [text()[: int(rng.integers(8, 90))] or "x" for _ in range(rng.integers(1, 6))], False)

    for _ in range(rng.integers(1, 4)):
        aside("nav header menu ad cookie notice banner breadcrumb search")
    kind = pick("article", "article", "main", "div.content", "div.post", "div.entry", "section.article", "div.story", "div.main", "div.body", "td.text")
    tag, _, name = ("div." + code() if opaque else kind).partition(".")
    page.append(f"<{tag}" + (f' {pick("class", "id")}="{name}{pick("", "-body", "-text")}"' if name else "") + ">")
    if rng.random() < 0.7:
        page.append(f"<h1>{html.escape(text(), quote=False)}</h1>")
        labels.append(True)
    cut = int(rng.integers(0, len(texts) + 1))
    put("", "", texts[:cut], True)
    if rng.random() < 0.3:
        aside("ad advert share related aside promo newsletter")
    put("", "", texts[cut:], True)
    page.append(f"</{tag}>")
    for _ in range(rng.integers(1, 4)):
        aside("comments comment footer sidebar aside related form footer copyright subscribe")
    page.append("</body></html>")
    return "".join(page), labels


def trained(pages: list[str], layouts: int = LAYOUTS, seed: int = 12) -> Labeller:
    """A labeller for the given pages' kind; the same pages give the same labeller."""
    rng = np.random.default_rng(seed)
    cut = [b for b in map(blocks, pages) if b]
    rows, labels = [], []
    titles = [t[:100] for b in cut for _, t, _ in b][:4000] or ["Menu", "Home"]
    for b in cut:
        own = np.array([marked(path) for path, _, _ in b])
        if own.any():
            rows.append(vectors([b]))
            labels.append(own)
        body = [t for (_, t, _), good in zip(b, own) if good] or [t for _, t, _ in b if len(t) > 60]
        for k in range(layouts):
            some = body[: int(rng.integers(1, 30))]
            if k == 0 and rng.random() < 0.2:  # long pages, of which some repeat themselves
                some = some * int(rng.integers(2, 8))
            some = [x if rng.random() < 0.85 else x.split()[-1] for x in some]  # main text has short blocks too
            page, truth = layout(some, titles, rng)
            found = blocks(page)
            if len(found) == len(truth):
                rows.append(vectors([found]))
                labels.append(np.array(truth))
    model = Labeller()
    model.train(rows, labels)
    return model


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", carry: tuple[str, ...] = (), sample: int = SAMPLE) -> DataFrame:
    """(id, carried columns, text, n_blocks, n_kept) for every page: kept blocks joined by line feeds.

    The labeller is trained on the ``sample`` pages of up to 200,000 characters whose ids hash lowest.  A null or empty page has an
    empty text; a page of any length is read whole; rows that repeat are each extracted; an empty table
    gives an empty table.
    """
    usable = pages.filter(F.length(html_col).between(1, 200_000)).select(id_col, html_col)
    chosen = lowest(usable, sample, id_col, html_col)
    model = trained([r[0] for r in chosen.select(html_col).collect()])
    fields = [T.StructField(c, pages.schema[c].dataType) for c in (id_col, *carry)]
    schema = T.StructType([*fields, T.StructField("text", T.StringType()), T.StructField("n_blocks", T.LongType()), T.StructField("n_kept", T.LongType())])
    arrow = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            source = batch.column(batch.num_columns - 1)
            for at in range(0, batch.num_rows, 64):
                cut = [blocks(x or "") for x in source.slice(at, 64).to_pylist()]
                rows = vectors(cut)
                ends = np.cumsum([len(b) for b in cut])
                parts = np.split(rows, ends[:-1])
                good: list[np.ndarray] = [np.zeros(0, bool)] * len(cut)
                order = sorted(range(len(cut)), key=lambda k: len(cut[k]))
                while order:  # pages of about one length, to pad little; padded to at most CELLS, or a single one
                    n = 1
                    while n < len(order) and (n + 1) * len(cut[order[-1]]) <= CELLS:
                        n += 1
                    some, order = order[-n:], order[:-n]
                    x, mask = padded([parts[j] for j in some])
                    z = model.logits(x, mask) > 0
                    for row, j in enumerate(some):
                        good[j] = z[row, : len(cut[j])]
                texts = ["\n".join(t for (_, t, _), g in zip(b, ok.tolist()) if g) for b, ok in zip(cut, good)]
                made = [texts, [len(b) for b in cut], [int(g.sum()) for g in good]]
                own = [batch.column(k).slice(at, 64) for k in range(len(fields))]
                yield pa.RecordBatch.from_arrays([*own, *[pa.array(c, f.type) for c, f in zip(made, list(arrow)[len(fields) :])]], names=arrow.names)

    return pages.select(id_col, *carry, html_col).mapInArrow(run, schema)
