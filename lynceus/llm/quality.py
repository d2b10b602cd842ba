"""Quality rules as a learned decision list (operator 6), with DataFrame functions only.

Statistics of every text are Spark expressions.  A decision list is learned by sequential covering from
the statistics of a bounded sample of labelled documents: a rule is a conjunction of thresholds, grown
condition by condition for the best information gain on two thirds of the sample and pruned from its
end on the other third; the rows it covers leave, and the next rule is grown.  The list is applied to
all documents as one ordered conditional expression.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import lowest

SPACE = r"[\x20\x09-\x0D]+"
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Labelled documents that the list is learned from, at most.
SAMPLE = 6000


def bound(value: Column, use) -> Column:
    """use(value) with the value computed once, as a lambda's variable."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def count_of(text: Column, pattern: str) -> Column:
    return (F.length(text) - F.length(F.regexp_replace(text, pattern, ""))).cast("long")


def repeated_words(words: Column, size: int = 5) -> Column:
    """Words inside windows of ``size`` words that the text holds twice or more."""
    zero = F.lit(0).cast("long")
    sixth = lambda h: F.transform(
        F.slice(h, 1, F.greatest(F.size(h) - (size - 1), F.lit(0))),
        lambda x, i: F.xxhash64(x, *[F.get(h, i + j) for j in range(1, size)]),
    )

    def covered(at: Column) -> Column:
        reach = F.transform(at, lambda p, i: F.least(F.lit(size), F.coalesce(F.get(at, i + 1) - p, F.lit(size))))
        return F.aggregate(reach, zero, lambda a, x: a + x)

    def places(s: Column) -> Column:
        same = lambda x, i: F.coalesce(F.get(s, i)["g"] == x["g"], F.lit(False))
        twice = F.filter(s, lambda x, i: same(x, i - 1) | same(x, i + 1))
        return bound(F.sort_array(F.transform(twice, lambda x: x["i"])), covered)

    def count(g: Column) -> Column:
        pairs = F.sort_array(F.transform(g, lambda x, i: F.struct(x.alias("g"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(g)) == F.size(g), zero).otherwise(bound(pairs, places))

    return bound(F.transform(words, lambda w: F.xxhash64(w)), lambda h: bound(sixth(h), count))


def with_stats(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows with a struct ``stats``; a null text counts as empty."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    rows = docs.withColumns({"_words": words, "_lines": lines})
    w, ln = F.col("_words"), F.col("_lines")
    parts = {
        "n_words": F.size(w).cast("long"),
        "word_chars": F.length(F.array_join(w, "")).cast("long"),
        "n_symbols": count_of(text, r"[#*$%&|<>]+"),
        "n_dup_lines": (F.size(ln) - F.size(F.array_distinct(ln))).cast("long"),
        "n_repeat_words": repeated_words(w),
        "n_lines": F.size(ln).cast("long"),
        "n_upper": count_of(text, r"\p{Lu}+"),
        "n_marks": count_of(text, r"[!?]+"),
        "n_digits": count_of(text, r"[0-9]+"),
    }
    return rows.withColumn("stats", F.struct(*[c.alias(k) for k, c in parts.items()])).drop("_words", "_lines")


def features(stats: Column) -> dict[str, Column]:
    """What the rules' thresholds are on; a ratio to nothing is 0."""
    part = lambda a, b: F.coalesce(F.try_divide(stats[a].cast("double"), stats[b]), F.lit(0.0))
    return {
        "words": stats["n_words"].cast("double"),
        "chars_per_word": part("word_chars", "n_words"),
        "symbols_per_word": part("n_symbols", "n_words"),
        "dup_lines_share": part("n_dup_lines", "n_lines"),
        "repeat_share": part("n_repeat_words", "n_words"),
        "upper_share": part("n_upper", "word_chars"),
        "marks_per_word": part("n_marks", "n_words"),
        "digit_share": part("n_digits", "word_chars"),
        "words_per_line": part("n_words", "n_lines"),
    }


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, row: dict) -> bool:
        return row[self.feature] >= self.threshold if self.above else row[self.feature] < self.threshold

    def column(self, of: dict[str, Column]) -> Column:
        return of[self.feature] >= self.threshold if self.above else of[self.feature] < self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.above else '<'} {self.threshold:g}"


Rule = tuple[Condition, ...]


def _covers(rule: Rule, rows: list[dict]) -> list[dict]:
    return [r for r in rows if all(c.holds(r) for c in rule)]


def _candidates(rows: list[dict], names: list[str], bins: int) -> list[Condition]:
    out = []
    for f in names:
        values = sorted({r[f] for r in rows})
        cuts = {float(f"{values[len(values) * k // bins]:.3g}") for k in range(1, bins)}
        out += [Condition(f, above, t) for t in sorted(cuts) for above in (True, False)]
    return out


def _grow(rows: list[dict], names: list[str], bins: int, longest: int) -> Rule:
    rule: Rule = ()
    while len(rule) < longest:
        bad = sum(r["bad"] for r in rows)
        if not bad or bad == len(rows):
            break
        before, best, gain = log2(bad / len(rows)), None, 1e-9
        for c in _candidates(rows, names, bins):
            inside = [r["bad"] for r in rows if c.holds(r)]
            if p := sum(inside):
                if (g := p * (log2(p / len(inside)) - before)) > gain:
                    best, gain = c, g
        if best is None:
            break
        rule, rows = (*rule, best), _covers((best,), rows)
    # of conditions on one feature and side, the last is the tightest
    return tuple({(c.feature, c.above): c for c in rule}.values())


def learn(
    rows: list[dict], names: list[str], bins: int = 32, longest: int = 4, most_rules: int = 12, precision: float = 0.9
) -> list[Rule]:
    """An ordered list of rules for bad rows; empty where the rows have one class only.

    Each row has the features and ``bad``.  A rule is taken while at least ``precision`` of the pruning
    rows that it covers are bad; otherwise no rule starts from its first feature again.
    """
    grow, prune = [r for k, r in enumerate(rows) if k % 3], rows[::3]
    out: list[Rule] = []
    while len(out) < most_rules and names:
        rule = _grow(grow, names, bins, longest)
        cuts = []
        for k in range(1, len(rule) + 1):
            inside = [r["bad"] for r in _covers(rule[:k], prune)]
            if inside:
                p = sum(inside)
                cuts.append(((2 * p - len(inside)) / (len(inside) + 1), -k, p / len(inside)))
        if not rule:
            break
        if not cuts or max(cuts)[2] < precision:
            names = [n for n in names if n != rule[0].feature]
            continue
        rule = rule[: -max(cuts)[1]]
        out.append(rule)
        grow = [r for r in grow if not all(c.holds(r) for c in rule)]
        prune = [r for r in prune if not all(c.holds(r) for c in rule)]
    return out


def labelled_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id") -> list[dict]:
    """Features and ``bad`` of at most ``sample`` labelled documents, those whose ids hash lowest."""
    known = labels.filter(F.col("quality").isNotNull() & F.col(id_col).isNotNull())
    chosen = lowest(known.groupBy(id_col).agg(F.min("quality").alias("_quality")), sample, id_col)
    rows = with_stats(docs.join(F.broadcast(chosen), id_col))  # the sample bounds what is broadcast
    picked = rows.select(id_col, (F.col("_quality") == 0).cast("int").alias("bad"), *[c.alias(k) for k, c in features(F.col("stats")).items()])
    others = [c for c in picked.columns if c != id_col]  # rows of one id in a fixed order too
    return [r.asDict() for r in picked.orderBy(F.xxhash64(id_col), id_col, *others).limit(sample).collect()]


def decision(rules: list[Rule], stats: Column) -> Column:
    """The first rule that holds, as text; null if none does."""
    of, out = features(stats), F.when(F.lit(False), F.lit(""))
    for rule in rules:
        test = F.lit(True)
        for c in rule:
            test = test & c.column(of)
        out = out.when(test, F.lit(" and ".join(map(str, rule))))
    return out


def judge(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows and columns of ``docs`` with stats, base_failed, rule and kept.

    base_failed: fewer than 10 words, or over a fifth of the words in repeated 5-word windows.  kept is
    false for those and for documents that a learned rule covers.  A null text has no words and fails.
    Without labels of both kinds the list is empty.  Rows that repeat are judged each; columns named
    stats, base_failed, rule or kept are replaced; an empty table gives an empty table.
    """
    docs = docs.drop("stats", "base_failed", "rule", "kept")
    plain = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rows = labelled_rows(plain, labels, sample)
    rules = learn(rows, list(features(F.col("stats")))) if rows else []
    s = F.col("stats")
    failed = (s["n_words"] < 10) | (100 * s["n_repeat_words"] > 20 * s["n_words"])
    out = with_stats(docs, text_col).withColumns({"base_failed": failed, "rule": decision(rules, s)})
    return out.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())
