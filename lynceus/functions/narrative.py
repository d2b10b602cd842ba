"""The grammar of narratives as Spark columns: sections, events, stakes, identifiers, names, status.

Every function maps a column to a column, with built-in expressions only, so that a record's facts are
found in one narrow pass.  Offsets count code points from 0 in the whole narrative.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocab as V

BLANK = r"^[\x00-\x20]+|[\x00-\x20]+$"


def let(value: Column, use) -> Column:
    """use(value), with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, BLANK, "")


def quoted(words) -> str:
    return "|".join(re.escape(w) for w in words)


def running(values: Column) -> Column:
    """Before each of the values, the sum of those in front of it; one more for the sum of all."""
    return F.aggregate(values, F.array(F.lit(0)), lambda a, v: F.array_append(a, F.element_at(a, -1) + v))


def starts(parts: Column, found: Column) -> Column:
    """Where each of the found texts begins, given what stands between them."""
    steps = F.transform(found, lambda m, i: F.length(F.get(parts, i + 1)) + F.length(m))
    return F.transform(running(steps), lambda x: x + F.length(F.get(parts, F.lit(0))))


def find_all(text: Column, pattern: str, *groups: int) -> Column:
    """Array of (text, start, end, g1, ...) of all matches; a group that took no part is null."""

    def place(pair: Column) -> Column:
        def one(m: Column, i: Column) -> Column:
            start = F.get(pair["s"], i)
            own = [F.nullif(F.get(pair[f"g{g}"], i), F.lit("")).alias(f"g{g}") for g in groups]
            return F.struct(m.alias("text"), start.alias("start"), (start + F.length(m)).alias("end"), *own)

        return F.transform(pair["m"], one)

    def placed(pair: Column) -> Column:
        return F.struct(starts(pair["p"], pair["m"]).alias("s"), pair["m"].alias("m"), *[pair[f"g{g}"].alias(f"g{g}") for g in groups])

    every = lambda g: F.regexp_extract_all(text, F.lit(pattern), F.lit(g))
    pair = F.struct(
        F.split(text, pattern, -1).alias("p"), every(0).alias("m"), *[every(g).alias(f"g{g}") for g in groups]
    )
    none = F.array().cast(f"array<struct<text:string,start:int,end:int{''.join(f',g{g}:string' for g in groups)}>>")
    return F.when(text.rlike(pattern), let(pair, lambda p: let(placed(p), place))).otherwise(none)


# ---------------------------------------------------------------- sections


def is_header(text: Column) -> Column:
    """At most 64 characters with two letters or more, of which each is upper case."""
    shape = r"^(?=(?:\P{L}*\p{L}){2})\P{L}*(?:\p{Lu}\P{L}*)+$"
    return (F.length(text) <= V.MAX_HEADER) & text.rlike(shape)


def classify(header: Column) -> Column:
    """The section kind of a header; null is UNKNOWN."""
    out = F.when(header.isNull(), "UNKNOWN").when(header.isin(*V.PROSE), "PROSE").when(header.isin(*V.JURISDICTIONS), "SANCTIONS")
    hint = F.lit(None).cast("string")
    for kind, hints in V.HEADER_HINTS[::-1]:
        hint = F.when(header.rlike(quoted(hints)), kind).otherwise(hint)
    known = F.when(header.rlike(quoted(w for _, hints in V.HEADER_HINTS for w in hints)), hint)
    return out.otherwise(F.coalesce(known, F.lit("UNKNOWN")))


def parseable(header: Column, kind: Column) -> Column:
    return header.isNotNull() & (kind != "PROSE")


def sections(text: Column) -> Column:
    """Array of (header, body, start, kind) in order; a null or empty text has none."""

    def cut(pair: Column) -> Column:
        heads, whole = pair["h"], pair["t"]
        size = F.length(whole)

        def section(header: Column, a: Column, b: Column) -> Column:
            own = lambda h: F.struct(
                h.alias("header"), F.substring(whole, a + 1, b - a).alias("body"), a.cast("int").alias("start"), classify(h).alias("kind"),
            )
            return let(header.cast("string"), own)

        first = F.coalesce(F.get(heads, F.lit(0))["start"], size)
        lead = F.when(first > 0, F.array(section(F.lit(None), F.lit(0), first))).otherwise(F.array().cast("array<struct<header:string,body:string,start:int,kind:string>>"))
        rest = F.transform(heads, lambda h, i: section(trimmed(inside(h)), h["end"], F.coalesce(F.get(heads, i + 1)["start"], size)))
        return F.concat(lead, rest)

    inside = lambda m: F.substring(m["text"], F.lit(2), m["end"] - m["start"] - 2)
    heads = F.filter(find_all(text, r"\[[^\]]*\]"), lambda m: (m["end"] - m["start"] <= V.MAX_HEADER + 2) & is_header(trimmed(inside(m))))
    return F.when(F.length(text) > 0, let(F.struct(heads.alias("h"), text.alias("t")), cut))


def canonical_source(header: Column) -> Column:
    """JURISDICTION or JURISDICTION:PROGRAMME."""
    upper = trimmed(F.upper(header))
    jurisdiction = F.substring_index(upper, " - ", 1)
    for word in V.LIST_SOURCE_WORDS:
        jurisdiction = F.replace(jurisdiction, F.lit(" " + word), F.lit(""))
    jurisdiction = trimmed(jurisdiction)
    programme = F.when(upper.contains(" - "), trimmed(F.substring(upper, F.instr(upper, " - ") + 3, F.length(upper))))
    joined = F.when(F.coalesce(programme, F.lit("")) == "", jurisdiction).otherwise(F.concat_ws(":", jurisdiction, programme))
    return F.when(jurisdiction == "", F.coalesce(programme, F.lit(""))).otherwise(joined)


def is_list_source(header: Column) -> Column:
    return header.rlike(quoted(V.LIST_SOURCE_WORDS))


def is_history(header: Column) -> Column:
    return header.isin(*V.HISTORY_HEADERS)


def parser_of(header: Column) -> Column:
    """The authority whose layout a sanctions section has; GENERIC if none."""
    out = None
    for parser, inside, begins in V.PARSERS:
        test = header.rlike(quoted(inside) + "".join(f"|^{re.escape(b)}" for b in begins))
        out = F.when(test, parser) if out is None else out.when(test, parser)
    return out.otherwise("GENERIC")


# ---------------------------------------------------------------- events


def verb(raw: Column) -> Column:
    """Lower case up to the first of . , ( ), at most 60 characters."""
    return F.left(trimmed(F.regexp_extract(F.lower(trimmed(raw)), r"^[^.,()]*", 0)), F.lit(60))


def like_month(text: Column) -> Column:
    return F.left(text, F.lit(3)).isin(*V.MONTHS)


def action(text: Column) -> Column:
    """(type, phrase) of a verb: of the first phrase of the vocabulary that it contains."""
    pairs = [(t, p) for t, ps in V.ACTIONS for p in ps]
    act = lambda t, p: F.struct(F.lit(t).alias("type"), F.lit(p).cast("string").alias("phrase"))
    known = F.array(*[act(t, p) for t, p in pairs], act("UNCLASSIFIED", None))

    def of(v: Column) -> Column:
        found = F.when(v.isNull() | (v == "") | like_month(v), len(pairs))
        for k, (_, phrase) in enumerate(pairs):  # ends at the first that fits
            found = found.when(F.contains(v, F.lit(phrase)), k)
        return F.get(known, found.otherwise(len(pairs)))

    return let(trimmed(F.lower(text)), of)


def action_rule(act: Column) -> Column:
    return F.concat_ws(".", F.lit("ACTION"), act["type"], F.replace(act["phrase"], F.lit(" "), F.lit("_")))


def dated(body: Column) -> Column:
    """Texts of a section that tell a date and an action."""
    return F.regexp_extract_all(body, F.lit(V.DATE_ACTION), F.lit(0))


def usable(found: Column) -> Column:
    """(text, n, v): of the dated texts those that have a verb, the first hundred, with their place among all and the verb."""
    told = F.transform(found, lambda m, i: F.struct(m.alias("text"), i.alias("n"), verb(F.regexp_extract(m, V.DATE_ACTION, 3)).alias("v")))
    return F.slice(F.filter(told, lambda m: (m["v"] != "") & ~like_month(m["v"])), 1, 100)


def year(text: Column) -> Column:
    return F.regexp_extract(text, V.DATE_ACTION, 2).cast("int")


def happened(body: Column, source: Column) -> Column:
    """Sanction events of a section, without their place: (list_source, action_type, year)."""
    event = lambda m: F.struct(source.alias("list_source"), action(m["v"])["type"].alias("action_type"), year(m["text"]).alias("year"))
    return F.transform(usable(dated(body)), event)


# ---------------------------------------------------------------- ownership


def percent(raw: Column) -> Column:
    """A share from 0 to 100, with a comma or a dot; null if it is none."""
    value = F.replace(raw, F.lit(","), F.lit(".")).try_cast("double")
    return F.when(value.between(0, 100), value)


def clean_owner(text: Column) -> Column:
    text = F.regexp_replace(trimmed(text), r"^(?:[.,;\-][\x00-\x20]*)+", "")
    text = F.regexp_replace(text, r"(?:[\x00-\x20]*[.,;\-:])+$", "")
    return F.regexp_replace(trimmed(text), r"(?i)^and [\x00-\x20]*", "")


def stakes(s: Column) -> Column:
    """Ownership stakes of a section, and what they leave over, as (stakes, quarantine)."""
    body, start, head = s["body"], s["start"], s["header"]
    stake = lambda owner, kind, pct, rule, a, b: F.struct(
        head.alias("relation"), owner.alias("owner"), F.upper(kind).alias("owner_type"), pct.alias("percent"),
        pct.isNotNull().alias("percent_stated"), F.lit(rule).alias("rule"), (start + a).alias("start"), (start + b).alias("end"),
    )
    left_over = lambda reason, text, rule, a, b: F.array(quarantined(head, F.lit(reason), F.left(text, F.lit(200)), F.lit(rule), start + a, start + b))
    named = F.transform(find_all(body, V.STAKE, 1, 2, 3), lambda m: stake(clean_owner(m["g1"]), m["g2"], percent(m["g3"]), "OWN.STAKE", m["start"], m["end"]))
    bare = F.transform(F.slice(find_all(body, V.BARE_OWNER, 1, 2), 1, 1), lambda m: stake(clean_owner(m["g1"]), m["g2"], F.lit(None).cast("double"), "OWN.BARE", m["start"], m["end"]))
    kept = lambda x, n: F.slice(F.filter(x, lambda o: o["owner"] != ""), 1, n)

    def decide(both: Column) -> Column:
        n, b, size = both["n"], both["b"], F.length(body)
        last = F.element_at(n, -1)["end"] - start
        none = F.array().cast("array<struct<section:string,reason:string,excerpt:string,rule:string,start:int,end:int>>")
        rest = (
            F.when((F.size(n) > 0) & (size - last > 40), left_over("OWNERSHIP_TRAILING_CONTENT", F.substring(body, last + 1, size), "OWN.TRAILING", last, size))
            .when((F.size(n) == 0) & (F.size(b) == 0) & body.rlike(r"\S"), left_over("OWNERSHIP_SHAPE_UNRECOGNISED", body, "OWN.UNPARSED", F.lit(0), F.least(size, F.lit(200))))
            .otherwise(none)
        )
        return F.struct(F.when(F.size(n) > 0, n).otherwise(b).alias("stakes"), rest.alias("quarantine"))

    return let(F.struct(kept(named, 40).alias("n"), kept(bare, 1).alias("b")), decide)


def quarantined(section: Column, reason: Column, excerpt: Column, rule: Column, start: Column, end: Column) -> Column:
    return F.struct(section.alias("section"), reason.alias("reason"), excerpt.alias("excerpt"), rule.alias("rule"), start.cast("int").alias("start"), end.cast("int").alias("end"))


# ---------------------------------------------------------------- identifiers


def _values(body: Column, kind: str, rule: str, pattern: str, most: int, context: Column, offset: Column) -> Column:
    """Identifiers by one rule; the value is trimmed, its place is that of the whole group 1."""
    found = F.filter(find_all(body, pattern, 1), lambda m: trimmed(m["g1"]) != "")
    return F.transform(
        F.slice(found, 1, most),
        lambda m: F.struct(
            F.lit(kind).alias("type"), trimmed(m["g1"]).alias("value"), context.alias("context"), F.lit(rule).alias("rule"),
            (offset + m["end"] - F.length(m["g1"])).alias("start"), (offset + m["end"]).alias("end"),
        ),
    )


def identifiers(s: Column, context: Column) -> Column:
    return F.concat(*[_values(s["body"], t, "ID." + t, p, 20, context, s["start"]) for t, p in V.IDENTIFIERS])


def authority_identifiers(s: Column, parser: Column, context: Column) -> Column:
    none = F.array().cast("array<struct<type:string,value:string,context:string,rule:string,start:int,end:int>>")
    return F.concat(*[F.when(parser == who, _values(s["body"], t, rule, p, most, context, s["start"])).otherwise(none) for who, t, rule, most, p in V.AUTHORITY_IDENTIFIERS])


# ---------------------------------------------------------------- names


def trim_marks(text: Column) -> Column:
    text = F.regexp_replace(text, r"""^(?:['"(.:,][\x00-\x20]*)+""", "")
    text = F.regexp_replace(text, r"""(?:[\x00-\x20]*['").,;\-:])+$""", "")
    return F.left(text, F.lit(120))


def cut_at_label(text: Column, parser: Column) -> Column:
    """What stands before the first label that the authority or anyone uses."""
    def cut(t: Column) -> Column:
        before = lambda labels: F.get(F.split(t, quoted(labels), 2), F.lit(0))
        out = before(V.LABELS)
        for who, labels in V.AUTHORITY_LABELS.items():
            out = F.when(parser == who, before(V.LABELS + labels)).otherwise(out)
        return out

    return trim_marks(trimmed(let(trimmed(text), cut)))


def plausible(c: Column) -> Column:
    """Whether a candidate has the shape of a name."""
    lower = F.lower(c)
    size = lambda pattern: F.length(F.regexp_replace(c, pattern, ""))
    letters, digits, words = size(r"\P{L}"), size(r"\P{Nd}"), size("[^ ]") + 1
    tail = F.regexp_extract(c, r"^.+ ([^ ]*)$", 1)
    return (
        (F.length(c) >= 3)
        & ~c.rlike(V.YEAR)
        & ~c.contains(":")
        & ~lower.rlike("^(?:" + quoted(V.NO_NAME_PREFIXES) + ")")
        & ~c.rlike(r"(?s)^\p{Ll}.* ")
        & ~lower.rlike(r"^(?:and|the|of|or) ")
        & (letters >= 3)
        & (words <= 12)
        & (digits <= F.floor(letters / 4))
        & ~((words == 1) & (F.length(c) < 4))
        & ~((F.length(tail) < 4) & tail.rlike(r"^\p{Ll}"))
        & (size("[^,]") <= 1)
    )


def _name(value: Column, kind: Column, parser: Column, rule: Column, start: Column, end: Column) -> Column:
    return F.struct(kind.alias("name_type"), value.alias("value"), parser.alias("parser"), rule.alias("rule"), start.alias("start"), end.alias("end"))


NAMES = "array<struct<name_type:string,value:string,parser:string,rule:string,start:int,end:int>>"


def _while_few(groups: Column, most: int) -> Column:
    """All of the groups' items, but of no group before which ``most`` were found."""
    before = running(F.transform(groups, F.size))
    return F.flatten(let(before, lambda n: F.filter(groups, lambda g, i: F.get(n, i) < most)))


def marked_names(s: Column, parser: Column) -> Column:
    """Names after the markers of principal names and aliases, 300 characters each at most."""
    body, size = s["body"], F.length(s["body"])

    def after(m: Column, kind: str) -> Column:
        stop = F.least(size, m["end"] + 300)
        pieces = F.split(cut_at_label(F.substring(body, m["end"] + 1, stop - m["end"]), parser), V.NAME_SPLIT, -1)
        good = F.filter(F.transform(pieces, lambda p: trim_marks(trimmed(p))), plausible)
        rule = F.concat(parser, F.lit(".NAME." + kind))
        return F.transform(good, lambda c: _name(c, F.lit(kind), parser, rule, s["start"] + m["end"], s["start"] + stop))

    def marked(kind: str, mark: str) -> Column:
        return let(F.transform(find_all(body, re.escape(mark)), lambda m: after(m, kind)), lambda g: _while_few(g, 40))

    return F.concat(*[marked(kind, mark) for kind, mark in V.NAME_MARKERS])


def numbered_names(s: Column, parser: Column) -> Column:
    body, size = s["body"], F.length(s["body"])

    def one(m: Column) -> Column:
        stop = F.least(size, m["end"] + 160)
        first = F.get(F.split(F.substring(body, m["end"] + 1, stop - m["end"]), r"\n|\. ", 2), F.lit(0))
        return _name(cut_at_label(first, parser), F.lit("AKA"), parser, F.lit("OFSI.NAME_N"), s["start"] + m["end"], s["start"] + stop)

    return F.slice(F.filter(F.transform(find_all(body, V.NUMBERED_NAME), one), lambda n: plausible(n["value"])), 1, 20)


def parenthesised_names(s: Column, parser: Column) -> Column:
    def bare(piece: Column) -> Column:
        out = trimmed(piece)
        for prefix in V.ALIAS_PREFIXES:
            out = F.regexp_replace(out, "(?i)^" + re.escape(prefix) + r"[\x00-\x20]*", "")
        return trim_marks(out)

    def one(m: Column) -> Column:
        end = s["start"] + m["end"] - 1
        good = F.filter(F.transform(F.split(m["g1"], V.PAREN_SPLIT, -1), lambda p: cut_at_label(bare(p), parser)), plausible)
        return F.transform(good, lambda c: _name(c, F.lit("AKA"), parser, F.lit("OFAC.PAREN_AKA"), end - F.length(m["g1"]), end))

    return let(F.transform(find_all(s["body"], V.PAREN_ALIAS, 1), one), lambda g: _while_few(g, 40))


def quoted_names(s: Column, parser: Column) -> Column:
    one = lambda m: _name(cut_at_label(m["g1"], parser), F.lit("AKA"), parser, F.lit("EU.QUOTED_ALIAS"), s["start"] + m["start"] + 1, s["start"] + m["end"] - 1)
    return F.slice(F.filter(F.transform(find_all(s["body"], V.QUOTED_ALIAS, 1), one), lambda n: plausible(n["value"])), 1, 20)


def names(s: Column, parser: Column) -> Column:
    none = F.array().cast(NAMES)
    own = lambda who, found: F.when(parser == who, found(s, parser)).otherwise(none)
    marked = F.when(parser != "GENERIC", marked_names(s, parser)).otherwise(none)
    return F.concat(marked, own("OFSI", numbered_names), own("OFAC", parenthesised_names), own("EU", quoted_names))


# ---------------------------------------------------------------- status


def source_status(evs: Column) -> Column:
    """By list source, in order: (list_source, last_add, last_removal, unclassified, authorised, state)."""

    def one(name: Column) -> Column:
        def state(own: Column) -> Column:
            year = lambda *types: F.array_max(F.transform(F.filter(own, lambda e: e["action_type"].isin(*types)), lambda e: e["year"]))
            add, rem = year("ADDITION", "AMENDMENT"), year("REMOVAL")
            allowed = F.exists(own, lambda e: e["action_type"] == "AUTHORISATION")
            word = F.when(rem.isNotNull() & (add.isNull() | (rem > add)), "REMOVED").when(add.isNotNull() | allowed, "LIVE").otherwise("UNKNOWN")
            return F.struct(
                name.alias("list_source"), add.alias("last_add"), rem.alias("last_removal"),
                F.size(F.filter(own, lambda e: e["action_type"] == "UNCLASSIFIED")).alias("unclassified"), allowed.alias("authorised"), word.alias("state"),
            )

        return let(F.filter(evs, lambda e: e["list_source"] == name), state)

    return F.transform(F.array_sort(F.array_distinct(F.transform(evs, lambda e: e["list_source"]))), one)


def record_status(per_source: Column) -> Column:
    """LIVE if any source is, REMOVED_EVERYWHERE if all have removed, else INDETERMINATE; without events NOT_SANCTIONED."""
    return (
        F.when(F.size(per_source) == 0, "NOT_SANCTIONED")
        .when(F.exists(per_source, lambda x: x["state"] == "LIVE"), "LIVE")
        .when(F.forall(per_source, lambda x: x["state"] == "REMOVED"), "REMOVED_EVERYWHERE")
        .otherwise("INDETERMINATE")
    )


def may_be_designated(status: Column) -> Column:
    return status != "REMOVED_EVERYWHERE"
