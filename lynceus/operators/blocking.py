"""Candidate generation: the union of blocking strategies over distinct names.

Names are compared as classes: rows of one normalised name are one class, so that a name borne by a
third of all rows costs what a rare one does, and membership is joined on afterwards.  What strategies
compare is computed once for each class (``keyed``).  Set similarity joins use prefix filtering: items
ordered from rare to common, two sets that are similar enough share one (of words, two) of the first few,
so that a common item is a bucket's only where a set has hardly anything rarer; such buckets are spread
over several tasks, and pairs whose sizes alone exclude the similarity are not verified.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lynceus.functions import names as NM
from lynceus.operators import trigrams
from lynceus.operators.shared import settled

STRATEGIES = ("exact", "token", "trigram", "phonetic", "identifier")


def name_classes(rows: DataFrame, id_col: str, name_col: str, *carried: str) -> DataFrame:
    """(name, rep, n, carried): each normalised name that is not empty, the least id that bears it, how many do,
    and that id's carried columns."""
    named = rows.select(F.col(id_col).alias("id"), NM.normalised(F.col(name_col)).alias("name"), *carried)
    own = [F.min_by(c, "id").alias(c) for c in carried]
    return named.filter("name <> ''").groupBy("name").agg(F.min("id").alias("rep"), F.count("*").alias("n"), *own)


def keyed(classes: DataFrame) -> DataFrame:
    """The classes with what strategies and scores compare: hashes of words, trigrams and codes, the sound of all words and the words in order."""
    if "sounds" in classes.columns:
        return classes
    hashes = lambda items: F.transform(items, lambda x: F.xxhash64(x))
    name = F.col("name")
    sounds = {"sounds": F.array_join(NM.phonetic(name), " "), "codes": hashes(NM.phonetic(name))}
    return classes.withColumns({"words": hashes(F.array_distinct(NM.tokens(name))), "trigrams": hashes(NM.trigrams(name)), "turned": NM.sorted_tokens(name)} | sounds)


def exact(left: DataFrame, right: DataFrame) -> DataFrame:
    same = left.select("name").join(right.select("name"), "name")
    return same.select(F.col("name").alias("l"), F.col("name").alias("r"), F.lit("exact").alias("strategy"))


def by_token(left: DataFrame, right: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(l, r, strategy): pairs of name classes by Jaccard similarity of the words."""
    return _alike(left, right, {"token": ("words", threshold, threshold)})


def by_trigram(left: DataFrame, right: DataFrame, threshold: float = 0.7) -> DataFrame:
    """As by_token, by Dice similarity of the trigrams; at threshold t a set has t / (2 - t) of its items in common."""
    return _alike(left, right, {"trigram": ("trigrams", threshold, threshold / (2 - threshold))})


def _alike(left: DataFrame, right: DataFrame, sets: dict) -> DataFrame:
    left, right = (x if "sounds" in x.columns else settled(keyed(x), "classes") for x in (left, right))
    columns = ["name", *[column for column, *_ in sets.values()]]
    counts = settled(item_counts(left.select(*columns).unionByName(right.select(*columns)), sets), "items")
    keys = [settled(postings(x, counts, sets=sets).filter(F.col("type").isin(*sets)), "keys") for x in (left, right)]
    return met(*keys, sets=sets).select("l", "r", F.col("type").alias("strategy"))


def by_phonetic(left: DataFrame, right: DataFrame) -> DataFrame:
    """All words sound alike."""
    side = lambda frame, as_: keyed(frame).select(F.col("sounds").alias("key"), F.col("name").alias(as_))
    return side(left, "l").join(side(right, "r"), "key").select("l", "r", F.lit("phonetic").alias("strategy"))


# What stands where an identifier is not known, normalised.
PLACEHOLDERS = ("NA", "NIL", "NONE", "NULL", "UNKNOWN", "NOTKNOWN", "NOTAVAILABLE", "NOTAPPLICABLE", "PENDING", "TBA", "TBC", "TEST")


def identifier_value(value: Column) -> Column:
    """Letters of any script and digits, upper case; null where that says nothing: no character, three or more of one alone, or a placeholder."""
    norm = F.upper(F.regexp_replace(value, r"[^\p{L}\p{N}]", ""))
    return F.when((norm != "") & ~norm.rlike(r"^(.)\1{2,}$") & ~norm.isin(*PLACEHOLDERS), norm)


#: Pairs that one task makes of a key at least before it is spread over several, for which its right side is copied; where
#: a shuffle's partition has many pairs on average, a key is spread from this share of them on, so that copies stay few.
PAIRS_A_TASK, SHARE = 100_000, 0.25


def spread_join(left: DataFrame, right: DataFrame, on: list[str], by: str, as_placed: bool = False) -> DataFrame:
    """Inner join in which keys of many pairs, as counted, are spread by a hash of the left column ``by``; others are joined as they are.

    Both sides are read twice: give tables.  Partitions are as many as shuffles have, as pairs are many where rows are few;
    ``as_placed`` leaves bucketed tables where they are.
    """
    parts = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = lambda rows, *keys: rows if as_placed else rows.repartition(parts, *keys)
    counted = left.groupBy(*on).agg(F.count("*").alias("_l")).join(right.groupBy(*on).agg(F.count("*").alias("_r")), on)
    counted = settled(counted.select(*on, (F.col("_l").cast("double") * F.col("_r")).alias("_pairs")), "counted")
    most = max(PAIRS_A_TASK, (counted.agg(F.sum("_pairs")).first()[0] or 0) * SHARE / parts)
    hot = settled(counted.select(*on, F.ceil(F.col("_pairs") / most).cast("int").alias("_tasks")).filter("_tasks > 1"), "hot")
    if hot.isEmpty():
        return placed(left, *on).join(placed(right, *on), on)
    some = left.join(hot, on).withColumn("_salt", F.pmod(F.xxhash64(by), F.col("_tasks")).cast("int")).drop("_tasks")
    each = right.join(hot, on).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_tasks") - 1))).drop("_tasks")
    spread = some.repartition(parts, *on, "_salt").join(each.repartition(parts, *on, "_salt"), [*on, "_salt"]).drop("_salt")
    rare = left.join(hot, on, "left_anti")
    return placed(rare, *on).join(placed(right, *on), on).unionByName(spread)


def by_identifier(left: DataFrame, right: DataFrame) -> DataFrame:
    """(l, r) ids with the same (type, value); both sides have id, type and value.

    Values that say nothing (``identifier_value``) match nothing.  Where many share a value, give classes as ids.
    """
    side = lambda frame, as_: frame.select(F.col("id").alias(as_), "type", identifier_value(F.col("value")).alias("value")).filter("value is not null").distinct()
    left, right = settled(side(left, "l"), "identifiers"), settled(side(right, "r"), "identifiers")
    return spread_join(left, right, ["type", "value"], "l").select("l", "r").distinct()


#: Of each strategy that compares sets: what they are, the threshold of its measure, the share that either set has in common at least.
SETS = {"token": ("words", 0.5, 0.5), "trigram": ("trigrams", 0.7, 0.7 / (2 - 0.7))}


def _by_type(values: dict[str, float]) -> Column:
    out = F.lit(None).cast("double")
    for name, value in values.items():
        out = F.when(F.col("type") == name, F.lit(value)).otherwise(out)
    return out


def items_of(classes: DataFrame, sets: dict = SETS) -> DataFrame:
    """(name, type, item): the items of each keyed class's sets, hashed with their type."""
    return classes.select("name", F.inline(F.concat(*[_items(kind, column) for kind, (column, *_) in sets.items()])))


def _items(kind: str, column: str) -> Column:
    return F.transform(column, lambda x: F.struct(F.lit(kind).alias("type"), F.xxhash64(F.lit(kind), x).alias("item")))


def item_counts(classes: DataFrame, sets: dict = SETS) -> DataFrame:
    """(item, n): how many classes have each item."""
    return items_of(classes, sets).groupBy("item").agg(F.count("*").alias("n"))


#: Sets of words up to this size are met by two words at once.
SMALL = 8


def _sound(sounds: Column) -> Column:
    return F.xxhash64(F.lit("phonetic"), sounds)


def postings(classes: DataFrame, counts: DataFrame, *own: str, sets: dict = SETS) -> DataFrame:
    """(key, type, of, name, size, place, set, sound, grams, own): the keys that a class is met by, and what it is compared by.

    Of its sets these are the rarest items by ``counts``, as many as make sure that any set similar enough has one
    of them among its own; any counts will do, as long as both sides use the same.  ``set`` has all items in this
    order, ``grams`` the trigrams where ``set`` has others.  Words are met two at once (``of`` 2, ``place`` that of the
    second): one word in common is enough for the smallest sets only, and sets beyond SMALL have too many twos.  A name
    and the sound of its words are keys of their own.  ``own`` are columns that pairs are to carry.
    """
    more = {"sound": _sound(F.col("sounds")), "grams": F.col("trigrams"), "own": F.struct(*own) if own else F.lit(None).cast("int")}
    rows = items_of(classes, sets).join(counts, "item", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    grouped = rows.groupBy("name", "type").agg(F.array_sort(F.collect_list(F.struct("n", "item"))).alias("items"))  # one name's items
    ordered = grouped.select("name", "type", F.transform("items", lambda x: x["item"]).alias("set"))
    ordered = ordered.join(classes.select("name", *[v.alias(c) for c, v in more.items()]), "name")
    size, key = F.size("set"), lambda place, of, key: F.struct((place).alias("place"), F.lit(of).alias("of"), key.alias("key"))
    spare = size - F.ceil(size * _by_type({k: x[2] for k, x in sets.items()}) - 1e-9).cast("int")
    one = F.transform(F.slice("set", F.lit(1), spare + 1), lambda x, i: key(i, 1, x))
    two = F.flatten(F.transform(F.slice("set", F.lit(1), spare + 2), lambda x, i: F.transform(F.slice("set", F.lit(1), i), lambda y: key(i, 2, F.xxhash64(y, x)))))
    keys = one
    if "token" in sets:
        share = sets["token"][2]
        met_by_one = (F.col("type") != "token") | (size <= 1 / share + 1e-9) | (size > SMALL * share + 1e-9)
        met_by_two = (F.col("type") == "token") & (size > 1) & (size <= SMALL)
        keys = F.concat(F.when(met_by_one, one).otherwise(F.slice(one, 1, 0)), F.when(met_by_two, two).otherwise(F.slice(one, 1, 0)))
    grams = F.when(F.col("type") == "token", F.col("grams")).alias("grams")
    rare = ordered.select("type", "name", size.alias("size"), "set", *[grams if c == "grams" else F.col(c) for c in more], F.inline(keys))
    whole = lambda kind, column: F.struct(F.lit(kind).alias("type"), F.xxhash64(F.lit(kind), F.col(column)).alias("key"))
    alone = classes.select("name", *[v.alias(c) for c, v in more.items()], F.inline(F.array(whole("exact", "name"), whole("phonetic", "sounds"))))
    alone = alone.withColumns({"size": F.lit(0), "place": F.lit(0), "of": F.lit(0), "set": F.array().cast("array<bigint>")})
    columns = ["key", "type", "of", "name", "size", "place", "set", *more]
    return rare.select(columns).unionByName(alone.select(columns))


def met(asked: DataFrame, listed: DataFrame, sets: dict = SETS, as_placed: bool = False) -> DataFrame:
    """(l, r, type, sound, grams and own of either side): the pairs for which a strategy holds, once for each that does.

    Pairs are compared where they meet, so that only those which hold go on.  Two similar sets meet on each of their first
    items that they share; the pair counts at the first of them, which no other task has, and never needs to be made distinct.
    Most sets of trigrams that share one have too little else in common: these are compared block by block (``trigrams``).
    """
    others = [x.filter("type <> 'trigram'") for x in (asked, listed)]
    if "trigram" not in sets:
        return _joined(*others, sets, as_placed)
    blocks = trigrams.met(*[x.filter("type = 'trigram'") for x in (asked, listed)], sets["trigram"][1])
    return blocks if len(sets) == 1 and sets is not SETS else _joined(*others, sets, as_placed).unionByName(blocks)


def _joined(asked: DataFrame, listed: DataFrame, sets: dict, as_placed: bool) -> DataFrame:
    given = lambda rows, as_: rows.select(
        "key", *(["type", "of"] if as_ == "l" else []), F.col("name").alias(as_), *[F.col(c).alias(f"{as_}_{c}") for c in ("size", "place", "set", "sound", "grams", "own")],
    )
    pairs = spread_join(given(asked, "l"), given(listed, "r"), ["key"], "l", as_placed)
    a, b = F.col("l_size"), F.col("r_size")
    similar, is_set = F.lit(False), F.col("type") == "token"
    if "token" in sets:
        _, t, share = sets["token"]
        least = (a + b) * (t / (1 + t)) - 1e-9
        of, first = F.col("of"), F.least("l_place", "r_place")
        left_over = F.least(a - F.col("l_place"), b - F.col("r_place")) + of - 1
        common = F.size(F.array_intersect("l_set", "r_set"))
        before = F.size(F.array_intersect(F.slice("l_set", F.lit(1), F.col("l_place")), F.slice("r_set", F.lit(1), F.col("r_place"))))
        # what the key itself has in common is often enough, and often has nothing before it; twos are what small pairs count at
        enough, once = (of >= least) | (common >= least), (first == of - 1) | (before == of - 1)
        similar = (F.least(a, b) >= F.greatest(a, b) * share - 1e-9) & (left_over >= least) & enough & once & ((of == 2) | (F.greatest(a, b) > SMALL) | (common == 1))
    same = F.when(F.col("type") == "exact", F.col("l") == F.col("r")).when(F.col("type") == "phonetic", F.col("l_sound") == F.col("r_sound"))
    return pairs.filter(F.when(is_set, similar).otherwise(F.coalesce(same, F.lit(False)))).select("l", "r", "type", "l_sound", "r_sound", "l_grams", "r_grams", "l_own", "r_own")


def compared(asked: dict[str, str] | None, listed: dict[str, str] | None) -> tuple[dict[str, str], dict[str, str]]:
    """The carried columns of either side with those that scores compare, which ``scoring.features`` then has not to make anew for each pair."""
    return (asked or {}) | {c: f"l_{c}" for c in ("words", "codes", "turned")}, (listed or {}) | {c: f"r_{c}" for c in ("words", "codes", "turned")}


def strategies(pairs: DataFrame, asked: dict[str, str] | None = None, listed: dict[str, str] | None = None) -> DataFrame:
    """(l, r, strategies, carried columns): every pair of ``met`` once, where the first of its strategies found it, with all that hold.

    ``asked`` and ``listed`` name the carried columns of either side.  A pair without type is given, and may have no strategy.
    Pairs that carry what scores compare have the trigrams of both sides, too.
    """
    words = lambda c: F.split(c, " ")  # normalised names have single blanks
    kind = F.coalesce("type", F.lit(""))
    alike, sounds = NM.jaccard(words("l"), words("r")) >= SETS["token"][1], F.col("l_sound") == F.col("r_sound")
    first = (
        F.when(kind == "phonetic", F.col("l") != F.col("r")).when(kind == "token", ~sounds).when(kind == "trigram", ~sounds & ~alike).otherwise(True)
    )
    holds = {
        "exact": F.col("l") == F.col("r"),
        "phonetic": sounds,
        "token": F.when(kind == "token", True).when(kind == "trigram", False).otherwise(alike),
        "trigram": F.when(kind == "trigram", True).otherwise(NM.dice(F.col("l_grams"), F.col("r_grams")) >= SETS["trigram"][1]),
    }
    each = F.array_compact(F.array(*[F.when(yes, F.lit(name)) for name, yes in holds.items()]))
    carried = [F.col(f"{side}_own")[c].alias(as_) for side, names in (("l", asked), ("r", listed)) for c, as_ in (names or {}).items()]
    if "turned" in (asked or {}) or "turned" in (listed or {}):
        carried += [F.col(f"{side}_grams").alias(f"{side}_trigrams") for side in "lr"]
    return pairs.filter(first).select("l", "r", each.alias("strategies"), *carried)


def candidates(left: DataFrame, right: DataFrame, identified: DataFrame | None = None, asked: dict[str, str] | None = None, listed: dict[str, str] | None = None) -> DataFrame:
    """(l, r, strategies, carried columns): the union, never the intersection, of all strategies.

    All strategies meet in one join on keys, and a pair is compared where it meets; found pairs are not shuffled.
    ``identified`` has pairs (l, r) of classes in which bearers have an identifier in common.  ``asked`` and ``listed``
    name columns of the classes that pairs carry, and what they are called then.
    """
    left, right = (x if "sounds" in x.columns else settled(keyed(x), "classes") for x in (left, right))
    counts = settled(item_counts(left.select("name", "words", "trigrams").unionByName(right.select("name", "words", "trigrams"))), "items")
    if identified is None:
        keys = [settled(postings(x, counts, *(own or ())), "keys") for x, own in ((left, asked), (right, listed))]
        return strategies(met(*keys), asked, listed)
    identified = settled(identified.select("l", "r").distinct(), "identified")
    # a name knows whom it shares an identifier with: such pairs are made below, whether strategies find them or not
    known = identified.groupBy(F.col("l").alias("name")).agg(F.collect_set("r").alias("_known"))
    keys = [settled(postings(left.join(known, "name", "left"), counts, *(asked or ()), "_known"), "keys"), settled(postings(right, counts, *(listed or ())), "keys")]
    pairs = met(*keys).filter(~F.coalesce(F.array_contains("l_own._known", F.col("r")), F.lit(False)))
    side = lambda rows, as_, own: rows.select(F.col("name").alias(as_), _sound(F.col("sounds")).alias(f"{as_}_sound"), F.col("trigrams").alias(f"{as_}_grams"), (F.struct(*own) if own else F.lit(None).cast("int")).alias(f"{as_}_own"))
    given = identified.join(side(left, "l", asked), "l").join(side(right, "r", listed), "r").withColumn("type", F.lit(None).cast("string"))
    every = F.array_sort(F.array_append("strategies", F.lit("identifier")))
    more = strategies(given, asked, listed).withColumn("strategies", every)
    return strategies(pairs, asked, listed).withColumn("strategies", F.array_sort("strategies")).unionByName(more)


OUTCOME = "array<struct<strategy:string,outcome:string,found:bigint>>"


def accounted(
    left: DataFrame, right: DataFrame, failing: dict[str, Column] | None = None, most: int | None = None, identified: DataFrame | None = None, can_identify: Column | None = None,
    asked: dict[str, str] | None = None, listed: dict[str, str] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Candidates as candidates() has them, and how each strategy ended for each class of ``left``.

    ``failing`` says by strategy for which classes (name, words, trigrams, sounds) it gave no answer: what only such
    a strategy would have found is not among the candidates, and is accounted for.  The second table has (l, outcome,
    found, by_strategy, gaps): by_strategy lists COMPLETE, PARTIAL (it failed) or TRUNCATED (it found more than
    ``most``) and what it found; ``gaps`` the strategies that could not be tried, as the class has nothing that they
    compare.  One PARTIAL strategy makes the class PARTIAL, else one TRUNCATED makes it TRUNCATED.  No class is left
    out: one without candidates has an outcome, too.  ``identified`` are pairs by identifiers, which only classes for
    which ``can_identify`` holds have, all of them if it is not given.
    """
    left, right = (x if "sounds" in x.columns else settled(keyed(x), "classes") for x in (left, right))
    names = [s for s in STRATEGIES if s != "identifier" or identified is not None]
    failing = {s: F.coalesce((failing or {}).get(s, F.lit(False)), F.lit(False)) for s in names}
    tried = {"exact": F.lit(True), "token": F.size("words") > 0, "trigram": F.size("trigrams") > 0, "phonetic": F.col("sounds") != "", "identifier": F.lit(True) if can_identify is None else can_identify}
    some = lambda flags: F.array_compact(F.array(*[F.when(flag, F.lit(s)) for s, flag in flags.items()]))
    left = left.withColumns({"failed": some(failing), "gaps": some({s: ~tried[s] for s in names})})
    left = settled(left, "states")
    state = left.select(F.col("name").alias("l"), "failed", "gaps")
    found = candidates(left, right, identified, (asked or {}) | {"failed": "failed", "gaps": "_gaps"}, listed)
    found = found.withColumn("strategies", F.array_except("strategies", "failed")).filter(F.size("strategies") > 0)
    complete = F.size(F.array_except("failed", "_gaps")) == 0
    found = settled(found.withColumn("complete", complete).drop("failed", "_gaps"), "candidates")
    counts = found.select("l", F.explode("strategies").alias("s")).groupBy("l").agg(*[F.count_if(F.col("s") == s).alias(s) for s in names])
    total = found.groupBy("l").agg(F.count("*").alias("found"))
    rows = state.join(counts, "l", "left").join(total, "l", "left").fillna(0, [*names, "found"])
    each = F.array(*[F.struct(F.lit(s).alias("strategy"), F.when(F.array_contains("failed", s), "PARTIAL").when(F.col(s) > (most if most is not None else 1 << 62), "TRUNCATED").otherwise("COMPLETE").alias("outcome"), F.col(s).alias("found")) for s in names])
    rows = rows.withColumn("by_strategy", F.filter(each, lambda x: ~F.array_contains("gaps", x["strategy"])).cast(OUTCOME))
    any_ = lambda word: F.exists("by_strategy", lambda x: x["outcome"] == word)
    outcome = F.when(any_("PARTIAL"), "PARTIAL").when(any_("TRUNCATED"), "TRUNCATED").otherwise("COMPLETE")
    return found, rows.select("l", outcome.alias("outcome"), "found", "by_strategy", "gaps")


def recall(found: DataFrame, truth: DataFrame) -> DataFrame:
    """(strategy, n_true, n_found, recall): of true pairs (l, r), by strategy and by all of them."""
    hits = truth.distinct().join(found, ["l", "r"], "left")
    total = hits.agg(F.count("*").alias("n_true"))
    n_true = total.scalar()
    each = hits.select(F.explode(F.concat(F.col("strategies"), F.array(F.lit("ALL")))).alias("strategy"))
    return (
        each.groupBy("strategy").agg(F.count("*").alias("n_found")).withColumn("n_true", n_true)
        .select("strategy", "n_true", "n_found", F.round(F.col("n_found") / F.col("n_true"), 6).alias("recall"))
    )
