"""URL filters: pattern rules indexed by their rarest literal token (operator 3).

A rule has a pattern in the usual blocklist notation: ``||host`` anchors at a host or any of its
subdomains, ``|`` at either end of the address, ``*`` stands for any run of characters, ``^`` for a
separator or the end, and anything else for itself.  A *literal token* of a pattern is a run of
letters and digits that the pattern closes off on both sides, so every address that the pattern fits
has it as a whole token.  Each rule is filed under the one of its tokens that the fewest addresses
have; rules without such a token are filed under the empty token, which every address has.  Addresses
fetch the rules filed under their tokens, and only those rules' regular expressions run.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOKEN = "[0-9A-Za-z]+"
RULES = T.StructType([T.StructField(x, T.StringType()) for x in ("rule", "pattern", "action", "tier")])

#: Rules of this library for crawled pages: addresses that lead to no article, and hosts of adverts.
DEFAULT_PATTERNS = (
    ("||ads.", "block"), ("||ads-", "block"), ("||doubleclick.", "block"), ("||tracker.", "block"), ("/login^", "block"),
    ("/signup^", "block"), ("/cart^", "block"), ("/checkout^", "block"), ("/wp-admin/", "block"),
    ("/search?q=", "block"), ("/tag/*/page/", "block"), ("*/feed/|", "block"), ("sessionid=", "block"),
    ("/casino^", "block"), ("/porn^", "block"), ("/print/*.html", "block"), ("||archive.*/print/", "allow"),
)


def compiled(pattern: str) -> str:
    """The regular expression of a pattern, for ``host + path + query``."""
    head, tail = "", ""
    if pattern.startswith("||"):
        head, pattern = r"^(?:[^/?#]*\.)?", pattern[2:]
    elif pattern.startswith("|"):
        head, pattern = "^", pattern[1:]
    if pattern.endswith("|"):
        tail, pattern = "$", pattern[:-1]
    special = {"*": ".*", "^": r"(?:[^0-9A-Za-z_.%-]|$)"}
    return "(?s)" + head + "".join(special.get(x) or re.sub(r"(\W)", r"\\\1", x) for x in pattern) + tail


def literal_tokens(pattern: str) -> list[str]:
    """Tokens that every address fitting the pattern has whole."""
    anchored = pattern.startswith("|")
    body, closed = pattern.lstrip("|"), pattern.endswith("|")
    body = body.rstrip("|")
    out = []
    for m in re.finditer(TOKEN, body):
        left = body[m.start() - 1] != "*" if m.start() else anchored
        right = body[m.end()] != "*" if m.end() < len(body) else closed
        if left and right:
            out.append(m[0])
    return sorted(set(out))


def rules_table(spark: SparkSession, rules: list[tuple[str, str, str, str]]) -> DataFrame:
    """(rule, pattern, action, tier) rows; any other table with these columns serves as well."""
    return spark.createDataFrame(rules, RULES)


def host_rules(rules: list[tuple[str, str]]) -> list[tuple[str, str, str, str]]:
    """Rules ``host/path`` as patterns that fit the host, its subdomains, and paths that begin so."""
    return [(rule, "||" + rule, action, "base") for action, rule in rules]


def addressed(urls: DataFrame, url_col: str) -> DataFrame:
    """host, path and address (host, path and the rest up to ``#``) of each url; empty without ``://``."""
    after = F.regexp_extract(F.col(url_col), r"(?s)^.*?://(.*)$", 1)
    after = F.coalesce(after, F.lit(""))
    raw = F.regexp_extract(after, r"^[^/?#]*", 0)
    rest = F.substring(after, F.length(raw) + 1, F.length(after))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    host = F.translate(raw, upper, lower)
    return urls.withColumns(
        {
            "host": host,
            "path": F.regexp_extract(rest, r"^[^?#]*", 0),
            "address": F.concat(host, F.regexp_extract(rest, r"^[^#]*", 0)),
        }
    )


#: Parts that an empty token or address is spread over: every address has that token, and all null urls that address.
SPREAD = 8


def spread(rows: DataFrame, key: str, by: Column) -> DataFrame:
    """The rows with ``part``, by which those of an empty key are spread."""
    return rows.withColumn("part", F.when(F.col(key) == "", F.pmod(by, F.lit(SPREAD)).cast("int")).otherwise(0))


def repeated(few: DataFrame, key: str) -> DataFrame:
    """The rows for every ``part`` that their key may have."""
    every = F.sequence(F.lit(0), F.lit(SPREAD - 1))
    return few.withColumn("part", F.explode(F.when(F.col(key) == "", every).otherwise(F.array(F.lit(0)))))


def fetched(addresses: DataFrame, rules: DataFrame) -> DataFrame:
    """(address, rule, action, tier) for every rule that fits an address; ``addresses`` are distinct.

    Counting the tokens that rules have, over all addresses, picks each rule's rarest one.
    """
    tokens = F.udf(literal_tokens, "array<string>")  # runs over rules only
    regex = F.udf(compiled, "string")
    rules = rules.dropDuplicates(["rule", "pattern", "action", "tier"]).withColumns(
        {"tokens": tokens("pattern"), "regex": regex("pattern")}
    )
    of_urls = F.array_append(F.array_distinct(F.regexp_extract_all("address", F.lit(TOKEN), F.lit(0))), F.lit(""))
    held = addresses.select("address", F.explode(of_urls).alias("token"))
    wanted = rules.select(F.explode("tokens").alias("token")).distinct()
    counts = held.join(wanted, "token", "left_semi").groupBy("token").agg(F.count("*").alias("n"))
    rare = (
        rules.select("rule", "pattern", "action", "tier", "regex", F.explode_outer("tokens").alias("token"))
        .join(counts, "token", "left")
        .groupBy("rule", "pattern", "action", "tier", "regex")
        .agg(F.min(F.struct(F.coalesce("n", F.lit(0)), F.coalesce("token", F.lit("")).alias("token"))).alias("best"))
        .select("rule", "pattern", "action", "tier", "regex", F.col("best.token").alias("token"))
    )
    held = spread(held, "token", F.xxhash64("address"))
    return held.join(repeated(rare, "token"), ["token", "part"]).filter(F.expr("address rlike regex")).select("address", "rule", "action", "tier")


def judge(urls: DataFrame, rules: DataFrame, url_col: str = "url") -> DataFrame:
    """The rows of ``urls`` with host, path, rule, verdict and pattern_rule.

    Among the fitting rules of tier ``base`` the longest wins (ties: the greater text), and is returned
    in ``rule``; without one, the verdict is that of the other rules: ``block`` if one with that action
    fits and none that allows, else ``allow``.  ``pattern_rule`` is the longest deciding rule of those.
    Equal urls are judged once.  A null url, or one without ``://``, has an empty host and path, which
    no rule but one for empty addresses fits.  An empty table gives an empty table; other columns stay,
    but for those named address, part or like a result.
    """
    drop = [c for c in ("host", "path", "address", "part", "rule", "verdict", "pattern_rule") if c in urls.columns]
    rows = addressed(urls.drop(*drop), url_col)
    hits = fetched(rows.select("address").distinct(), rules)
    found = F.struct(F.length("rule").alias("n"), "rule", "action")
    longest = lambda fits: F.max(F.when(fits, found))
    best = hits.groupBy("address").agg(
        longest(F.col("tier") == "base").alias("base"),
        longest((F.col("tier") != "base") & (F.col("action") == "allow")).alias("allows"),
        longest((F.col("tier") != "base") & (F.col("action") == "block")).alias("blocks"),
    )
    extra = F.coalesce(F.col("allows"), F.col("blocks"))
    return (
        spread(rows, "address", F.monotonically_increasing_id()).join(repeated(best, "address"), ["address", "part"], "left")
        .withColumns(
            {
                "rule": F.col("base.rule"),
                "verdict": F.coalesce("base.action", extra["action"], F.lit("allow")),
                "pattern_rule": F.when(F.col("base").isNull(), extra["rule"]),
            }
        )
        .drop("address", "part", "base", "allows", "blocks")
    )
