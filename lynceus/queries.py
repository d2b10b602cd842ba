"""Registered queries of the screening operators, each with the SQL that says the same."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from lynceus.functions import narrative as N
from lynceus.operators import facts as FX
from lynceus.operators import reports as R
from lynceus.operators.shared import settled, shared_folder
from lynceus.plans.synthetic import narratives
from lynceus.plans.synthetic import notices as synthetic_notices

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return register


# ---------------------------------------------------------------- narratives

#: The orders behind the narratives, as the grammar should read them.
ORDERS = """
WITH o AS (
  SELECT c_custkey, o_orderkey, 'E' || c_custkey AS uid,
    CASE WHEN c_custkey % 10 <> 0 THEN c_mktsegment ELSE '(no-category)' END AS category,
    o_orderkey % 6 AS h, year(o_orderdate)::INT AS year, strftime(o_orderdate, '%b %Y') AS month,
    CASE WHEN o_orderkey % 7 = 0 THEN 'noted without effect' WHEN o_orderstatus = 'F' THEN 'delisted'
      WHEN o_orderstatus = 'O' THEN 'added to the list' WHEN o_orderstatus = 'P' THEN 'amended' END AS verb,
    ['Marlow', 'Okafor', 'Lindqvist', 'Petrov', 'Haddad'][o_orderkey % 5 + 1] AS person
  FROM customer JOIN orders ON c_custkey = o_custkey
), s AS (
  SELECT *, ['UK SANCTIONS - UKHMT', 'USA SANCTIONS - OFAC', 'EU SANCTIONS', 'CANADA', 'BIOGRAPHY', 'CRYPTIC HEADING'][h + 1] AS header,
    ['UK:UKHMT', 'USA:OFAC', 'EU', 'CANADA', NULL, NULL][h + 1] AS list_source,
    ['OFSI', 'OFAC', 'EU', 'GENERIC', NULL, NULL][h + 1] AS parser,
    CASE verb WHEN 'delisted' THEN 'REMOVAL' WHEN 'added to the list' THEN 'ADDITION' WHEN 'amended' THEN 'AMENDMENT' ELSE 'UNCLASSIFIED' END AS action_type
  FROM o WHERE verb IS NOT NULL
), stake AS (
  SELECT 'E' || c_custkey AS uid, CASE WHEN c_custkey % 10 <> 0 THEN c_mktsegment ELSE '(no-category)' END AS category,
    CASE c_custkey % 3 WHEN 0 THEN 'DIRECT SHAREHOLDER/S' ELSE 'STATE OWNED' END AS relation,
    CASE c_custkey % 3 WHEN 0 THEN 'Ministry of Segment' ELSE 'Holding Group' END AS owner,
    CASE c_custkey % 3 WHEN 0 THEN 'SOE' END AS owner_type,
    CASE c_custkey % 3 WHEN 0 THEN c_custkey % 90 + 10.5 END::DOUBLE AS percent, c_custkey % 3 = 0 AS percent_stated
  FROM customer WHERE c_custkey % 3 < 2
)
"""
PER_SOURCE = """, per AS (
  SELECT uid, list_source, max(year) FILTER (action_type IN ('ADDITION', 'AMENDMENT')) AS last_add,
    max(year) FILTER (action_type = 'REMOVAL') AS last_removal, count(*) FILTER (action_type = 'UNCLASSIFIED')::INT AS unclassified
  FROM s WHERE h < 4 GROUP BY ALL
), src AS (
  SELECT *, CASE WHEN last_removal IS NOT NULL AND (last_add IS NULL OR last_removal > last_add) THEN 'REMOVED'
    WHEN last_add IS NOT NULL THEN 'LIVE' ELSE 'UNKNOWN' END AS state FROM per
), rec AS (
  SELECT 'E' || c_custkey AS uid, any_value(CASE WHEN c_custkey % 10 <> 0 THEN c_mktsegment ELSE '(no-category)' END) AS category,
    CASE WHEN count(src.uid) = 0 THEN 'NOT_SANCTIONED' WHEN count(*) FILTER (state = 'LIVE') > 0 THEN 'LIVE'
      WHEN bool_and(state = 'REMOVED') THEN 'REMOVED_EVERYWHERE' ELSE 'INDETERMINATE' END AS status,
    coalesce(sum(unclassified), 0)::INT AS unclassified_events
  FROM customer LEFT JOIN src ON src.uid = 'E' || c_custkey GROUP BY c_custkey
)
"""


@query("narrative_sections", ORDERS + """, owned AS (
  SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN '[DIRECT SHAREHOLDER/S] Ministry of Segment (SOE) (' || (c_custkey % 90 + 10) || ',5%). '
    WHEN 1 THEN '[STATE OWNED] Holding Group (unknown percentage). ' ELSE '' END AS own FROM customer
), piece AS (
  SELECT c_custkey, o_orderkey, header, '[' || header || ']' AS head,
    ' ' || month || ' - ' || verb || '. PRIMARY NAME: Holder ' || person || ' DOB: 1970. SDN Ref No ' || o_orderkey || '; Passport No P' || ((o_orderkey + 1) * 7919) || '. ' AS body FROM s
  UNION ALL SELECT c_custkey, -1, regexp_extract(own, '\\[([^\\]]*)\\]', 1), regexp_extract(own, '\\[[^\\]]*\\]'), regexp_replace(own, '\\[[^\\]]*\\]', '') FROM owned WHERE own <> ''
)
SELECT 'E' || c_custkey AS uid, (row_number() OVER q - 1)::INT AS n, header, body,
  (sum(length(head) + length(body)) OVER q - length(body))::INT AS start,
  CASE header WHEN 'BIOGRAPHY' THEN 'PROSE' WHEN 'CRYPTIC HEADING' THEN 'UNKNOWN' WHEN 'DIRECT SHAREHOLDER/S' THEN 'OWNERSHIP' WHEN 'STATE OWNED' THEN 'OWNERSHIP' ELSE 'SANCTIONS' END AS kind
FROM piece WINDOW q AS (PARTITION BY c_custkey ORDER BY o_orderkey)
""")
def narrative_sections(spark, sf_dir):
    return FX.sections(narratives(spark, sf_dir)).drop("category")


@query("section_kind_counts", ORDERS + """
SELECT kind, count(*) AS n FROM (
  SELECT CASE h WHEN 4 THEN 'PROSE' WHEN 5 THEN 'UNKNOWN' ELSE 'SANCTIONS' END AS kind FROM s UNION ALL SELECT 'OWNERSHIP' FROM stake
) GROUP BY kind
""")
def section_kind_counts(spark, sf_dir):
    return FX.sections(narratives(spark, sf_dir)).groupBy("kind").agg(F.count("*").alias("n"))


@query("sanction_events", ORDERS + "SELECT uid, category, list_source, action_type, verb AS raw_verb, year FROM s WHERE h < 4")
def sanction_events(spark, sf_dir):
    return FX.events(narratives(spark, sf_dir)).drop("provenance")


@query("events_by_type", ORDERS + "SELECT action_type, count(*) AS n FROM s WHERE h < 4 GROUP BY 1")
def events_by_type(spark, sf_dir):
    return R.counts(FX.events(narratives(spark, sf_dir)), "action_type")


@query("unclassified_verbs", ORDERS + "SELECT verb AS raw_verb, count(*) AS occurrences FROM s WHERE h < 4 AND action_type = 'UNCLASSIFIED' GROUP BY 1")
def unclassified_verbs(spark, sf_dir):
    return R.unclassified_verbs(FX.events(narratives(spark, sf_dir)))


@query("ownership_stakes", ORDERS + "SELECT * FROM stake")
def ownership_stakes(spark, sf_dir):
    return FX.ownership(narratives(spark, sf_dir)).drop("provenance")


@query("ownership_totals", ORDERS + "SELECT count(*) AS stakes, count(*) FILTER (percent_stated) AS with_percent, count(*) FILTER (NOT percent_stated) AS without_percent FROM stake")
def ownership_totals(spark, sf_dir):
    return R.ownership_totals(FX.ownership(narratives(spark, sf_dir)))


IDENTIFIERS = ORDERS + """, ids AS (
  SELECT uid, list_source AS context, unnest([{'t': 'SDN_REF', 'v': o_orderkey::VARCHAR, 'p': NULL}, {'t': 'SDN_REF', 'v': o_orderkey::VARCHAR, 'p': 'OFAC'},
    {'t': 'REF_NO', 'v': o_orderkey::VARCHAR, 'p': NULL}, {'t': 'PASSPORT', 'v': 'P' || ((o_orderkey + 1) * 7919), 'p': NULL}]) AS i, parser FROM s WHERE h < 3
)
"""


@query("identifiers", IDENTIFIERS + "SELECT uid, i.t AS type, i.v AS value, context FROM ids WHERE i.p IS NULL OR i.p = parser")
def identifiers(spark, sf_dir):
    return FX.identifiers(narratives(spark, sf_dir)).select("uid", "type", "value", "context")


@query("identifiers_by_type", IDENTIFIERS + "SELECT i.t AS type, count(*) AS n FROM ids WHERE i.p IS NULL OR i.p = parser GROUP BY 1")
def identifiers_by_type(spark, sf_dir):
    return R.counts(FX.identifiers(narratives(spark, sf_dir)), "type")


@query("extracted_names", ORDERS + "SELECT uid, 'PRIMARY' AS name_type, 'Holder ' || person AS value, parser FROM s WHERE h < 3")
def extracted_names(spark, sf_dir):
    return FX.names(narratives(spark, sf_dir)).select("uid", "name_type", "value", "parser")


@query("names_by_parser", ORDERS + "SELECT parser, count(*) AS n FROM s WHERE h < 3 GROUP BY 1")
def names_by_parser(spark, sf_dir):
    return R.counts(FX.names(narratives(spark, sf_dir)), "parser")


@query("quarantine_by_reason", ORDERS + """
SELECT reason, count(*) AS n FROM (
  SELECT 'UNCLASSIFIED_SECTION' AS reason FROM s WHERE h = 5 UNION ALL
  SELECT 'UNCLASSIFIED_ACTION_VERB' FROM s WHERE h < 4 AND action_type = 'UNCLASSIFIED'
) GROUP BY 1
""")
def quarantine_by_reason(spark, sf_dir):
    return R.counts(FX.quarantine(narratives(spark, sf_dir)), "reason")


@query("record_status", ORDERS + PER_SOURCE + "SELECT uid, category, status, unclassified_events FROM rec")
def record_status(spark, sf_dir):
    return FX.statuses(narratives(spark, sf_dir)).select("uid", "category", "status", "unclassified_events")


@query("per_source_status", ORDERS + PER_SOURCE + "SELECT uid, list_source, last_add, last_removal, unclassified, state FROM src")
def per_source_status(spark, sf_dir):
    rows = FX.statuses(narratives(spark, sf_dir)).select("uid", F.inline("per_source"))
    return rows.select("uid", "list_source", "last_add", "last_removal", "unclassified", "state")


@query("status_by_category", ORDERS + PER_SOURCE + """
SELECT category, count(*) FILTER (status = 'NOT_SANCTIONED') AS not_sanctioned, count(*) FILTER (status = 'LIVE') AS live,
  count(*) FILTER (status = 'REMOVED_EVERYWHERE') AS removed_everywhere, count(*) FILTER (status = 'INDETERMINATE') AS indeterminate,
  round(coalesce(100.0::DOUBLE * count(*) FILTER (status = 'REMOVED_EVERYWHERE') / nullif(count(*) FILTER (status <> 'NOT_SANCTIONED'), 0), 0), 2)::DOUBLE AS removed_pct_of_sanctioned
FROM rec GROUP BY category
""")
def status_by_category(spark, sf_dir):
    return R.status_by_category(FX.statuses(narratives(spark, sf_dir)))


@query("list_source_counts", ORDERS + "SELECT list_source AS canonical_list_source, count(DISTINCT uid) AS records FROM s WHERE h < 3 GROUP BY 1")
def list_source_counts(spark, sf_dir):
    return R.list_sources(FX.statuses(narratives(spark, sf_dir)))


@query("parser_coverage", ORDERS + """
SELECT parser AS parser_id, count(*) AS sections_handled, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 2)::DOUBLE AS share_pct FROM s WHERE h < 4 GROUP BY 1
""")
def parser_coverage(spark, sf_dir):
    return R.parser_coverage(narratives(spark, sf_dir))


@query("extraction_summary", ORDERS + """, n AS (
  SELECT (SELECT count(*) FROM customer) AS records, (SELECT count(*) FROM s) AS orders, (SELECT count(*) FROM stake) AS stakes, (SELECT count(*) FROM s WHERE h < 4) AS read
)
SELECT records, (SELECT count(DISTINCT uid) FROM (SELECT uid FROM s UNION ALL SELECT uid FROM stake)) AS with_narrative,
  orders + stakes AS sections_seen, read + stakes AS sections_parsed FROM n
""")
def extraction_summary(spark, sf_dir):
    return R.summary(FX.statuses(narratives(spark, sf_dir)))


NOTICES = """
WITH k AS (
  SELECT s_suppkey AS k, 'S' || s_suppkey AS uid, ['Marlow', 'Okafor', 'Lindqvist', 'Petrov', 'Haddad'][s_suppkey % 5 + 1] AS n FROM supplier
)
"""


@query("authority_identifiers", NOTICES + """, i AS (
  SELECT uid, unnest([
    {'t': 'GROUP_ID', 'v': (k + 1000)::VARCHAR, 'c': 'UK:UKHMT'}, {'t': 'TAX_ID', 'v': 'T-' || (k + 1000), 'c': 'UK:UKHMT'}, {'t': 'GROUP_ID', 'v': (k + 1000)::VARCHAR, 'c': 'UK:UKHMT'}, {'t': 'REGIME', 'v': 'Counter Terrorism', 'c': 'UK:UKHMT'},
    {'t': 'LEI', 'v': '5493' || lpad(k::VARCHAR, 16, '0'), 'c': 'USA:OFAC'}, {'t': 'SWIFT_BIC', 'v': 'DEUTDEFF', 'c': 'USA:OFAC'}, {'t': 'SDN_REF', 'v': (k + 5000)::VARCHAR, 'c': 'USA:OFAC'}, {'t': 'REF_NO', 'v': (k + 5000)::VARCHAR, 'c': 'USA:OFAC'},
    {'t': 'SDN_REF', 'v': (k + 5000)::VARCHAR, 'c': 'USA:OFAC'}, {'t': 'OFAC_PROGRAMME', 'v': 'SDGT', 'c': 'USA:OFAC'},
    {'t': 'IMO', 'v': '9' || lpad(k::VARCHAR, 6, '0'), 'c': 'EU'}, {'t': 'REGISTRATION', 'v': 'R-' || (k + 100), 'c': 'EU'}, {'t': 'NATIONAL_ID', 'v': 'N-' || (k + 1000), 'c': 'EU'}, {'t': 'CEDULA', 'v': '1' || lpad(k::VARCHAR, 7, '0'), 'c': 'EU'},
    {'t': 'EU_LEGAL_BASIS', 'v': '2014/145/CFSP', 'c': 'EU'}, {'t': 'EU_REGULATION', 'v': '269/2014', 'c': 'EU'}]) AS x FROM k
)
SELECT uid, x.t AS type, x.v AS value, x.c AS context FROM i
""")
def authority_identifiers(spark, sf_dir):
    """What notices of three authorities state, by the common rules and by those of each authority."""
    return FX.identifiers(synthetic_notices(spark, sf_dir)).select("uid", "type", "value", "context")


@query("authority_names", NOTICES + """, i AS (
  SELECT uid, unnest([{'v': 'Karim ' || n, 'p': 'OFSI'}, {'v': 'Delta ' || n, 'p': 'OFAC'}, {'v': 'Omega ' || n, 'p': 'OFAC'}, {'v': 'Alpha ' || n, 'p': 'EU'}]) AS x FROM k
)
SELECT uid, 'AKA' AS name_type, x.v AS value, x.p AS parser FROM i
""")
def authority_names(spark, sf_dir):
    """Numbered, bracketed and quoted names of three authorities' notices."""
    return FX.names(synthetic_notices(spark, sf_dir)).select("uid", "name_type", "value", "parser")


@query("section_flags", ORDERS + """
SELECT uid, count(*) FILTER (h <> 4) AS parseable, 0::BIGINT AS history FROM (SELECT uid, h FROM s UNION ALL SELECT uid, -1 FROM stake) GROUP BY 1
""")
def section_flags(spark, sf_dir):
    """By record: headed sections that a parser may read, and those of the past alone."""
    rows = FX.sections(narratives(spark, sf_dir)).filter("header is not null")
    return rows.groupBy("uid").agg(F.count_if(N.parseable(F.col("header"), F.col("kind"))).alias("parseable"), F.count_if(N.is_history(F.col("header"))).alias("history"))


@query("designation_flags", ORDERS + PER_SOURCE + "SELECT uid, status, status <> 'REMOVED_EVERYWHERE' AS may_be_designated FROM rec")
def designation_flags(spark, sf_dir):
    """All but records that every source has removed are to be treated as designated."""
    return FX.statuses(narratives(spark, sf_dir)).select("uid", "status", N.may_be_designated(F.col("status")).alias("may_be_designated"))


# ---------------------------------------------------------------- names

from lynceus.functions import names as NM  # noqa: E402
from lynceus.functions import phonetics as PH  # noqa: E402
from lynceus.operators import alignment as AL  # noqa: E402
from lynceus.operators import benchmark as BM  # noqa: E402
from lynceus.operators import blocking as B  # noqa: E402
from lynceus.operators import evidence as EV  # noqa: E402
from lynceus.operators import index  # noqa: E402
from lynceus.operators import operations as OP  # noqa: E402
from lynceus.operators import scoring as SC  # noqa: E402
from lynceus.operators import versions as VS  # noqa: E402
from lynceus.plans import screening, synthetic  # noqa: E402
from lynceus.plans.synthetic import load  # noqa: E402
from lynceus.sources import adapters  # noqa: E402
from lynceus.sources import lines as LN  # noqa: E402
from lynceus.sources import profiles as PF  # noqa: E402
from lynceus.sources import published as PB  # noqa: E402
from lynceus.streaming import rescreen  # noqa: E402


def sql_norm(x: str) -> str:
    plain = f"replace(strip_accents(lower({x})), 'ß', 'ss')"
    # without lookarounds a match takes the letter that the next one needs: digits are replaced twice, articles marked first
    digits = f"translate({plain}, chr(1), '.')"
    for a, b in (("0", "o"), ("0", "o"), ("1", "l"), ("1", "l")):
        digits = f"regexp_replace({digits}, '([a-z]){a}([a-z])', '\\1{b}\\2', 'g')"
    marked = f"regexp_replace(regexp_replace({digits}, '[''’`]', '', 'g'), '\\b(al|el)[\\s-]+', '\\1' || chr(1), 'g')"
    joined = f"regexp_replace({marked}, chr(1) || '([a-z])', '\\1', 'g')"
    words = f"string_split(trim(regexp_replace({joined}, '[^a-z0-9]+', ' ', 'g')), ' ')"
    titles = ", ".join(f"'{t}'" for t in NM.TITLES)
    forms = "CASE w " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in NM.LEGAL_FORMS.items()) + " ELSE w END"
    return f"array_to_string([{forms} for w in {words} if w <> '' and w not in ({titles})], ' ')"


SQL_WORDS = "regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')"
SQL_NAMES = f"""
WITH raw AS (
  SELECT doc_id AS id, {SQL_WORDS} AS w FROM documents
), parts AS (
  SELECT id, coalesce(w[1], '') AS a, CASE WHEN len(w) > 2 THEN w[(len(w) + 1) // 2] ELSE '' END AS b, CASE WHEN len(w) > 1 THEN w[-1] ELSE '' END AS c FROM raw
), named AS (
  SELECT id, array_to_string([x for x in [a, b, c] if x <> ''], ' ') AS listed, CASE id % 4 WHEN 0 THEN c || ' ' || a || ' ' || b WHEN 1 THEN a || ' ' || b || ' ' || left(c, greatest(length(c) - 1, 0))
    WHEN 2 THEN upper(a || ' ' || b || ' ' || c) ELSE a || ' ' || b END AS asked,
    CASE WHEN id % 2 = 0 THEN 'INDIVIDUAL' ELSE 'ORGANISATION' END AS entity_type FROM parts
), n AS (
  SELECT id, entity_type, listed, asked, {sql_norm("listed")} AS r, {sql_norm("asked")} AS l FROM named
), lw AS (
  SELECT l AS name, min(id) AS rep, count(*) AS n FROM n WHERE l <> '' GROUP BY 1
), rw AS (
  SELECT r AS name, min(id) AS rep, count(*) AS n FROM n WHERE r <> '' GROUP BY 1
)
"""


def sql_tri(x: str) -> str:
    return f"list_distinct([substr('  ' || {x} || ' ', i, 3) for i in range(1, length({x}) + 2)])"


def sql_tokens(x: str) -> str:
    return f"[w for w in string_split({x}, ' ') if w <> '']"


def sql_sorted(x: str) -> str:
    return f"array_to_string(list_sort({sql_tokens(x)}), ' ')"


def sql_soundex(w: str) -> str:
    code = lambda s: f"translate({s}, 'bfpvcgjkqsxzdtlmnraeiouyhw', '11112222222233455600000077')"
    out = f"{code(f'left({w}, 1)')} || {code(f"translate(substr({w}, 2), 'hw', '')")}"
    for d in "123456":
        out = f"regexp_replace({out}, '{d}+', '{d}', 'g')"
    return f"CASE WHEN {w} SIMILAR TO '[a-z].*' THEN upper(left({w}, 1)) || rpad(left(regexp_replace(substr({out}, 2), '[^1-6]', '', 'g'), 3), 3, '0') ELSE {w} END"


def sql_phonetic(x: str) -> str:
    return f"list_sort(list_distinct([{sql_soundex('w')} for w in string_split({x}, ' ') if w <> '']))"


def sql_jaccard(a: str, b: str) -> str:
    return f"coalesce(len(list_intersect({a}, {b}))::DOUBLE / nullif(len(list_distinct(list_concat({a}, {b}))), 0), 0)"


def sql_dice(a: str, b: str) -> str:
    return f"coalesce(2.0::DOUBLE * len(list_intersect({a}, {b})) / nullif(len({a}) + len({b}), 0), 0)"


SQL_EDIT = "1 - coalesce(levenshtein(l, r)::DOUBLE / nullif(greatest(length(l), length(r)), 0), 0)"


def _pairs(spark, sf_dir):
    """Each document's name as asked and as listed, normalised."""
    asked, listed = synthetic.subjects(spark, sf_dir), synthetic.listed(spark, sf_dir).withColumnRenamed("name", "listed")
    both = asked.join(listed, "id")
    return both.select("id", "entity_type", NM.normalised(F.col("name")).alias("l"), NM.normalised(F.col("listed")).alias("r"))


@query("normalised_names", SQL_NAMES + f"SELECT id, listed AS name, r AS normalised, {sql_sorted('r')} AS sorted_tokens, len({sql_tokens('r')})::INT AS n_tokens FROM n")
def normalised_names(spark, sf_dir):
    rows = synthetic.listed(spark, sf_dir).select("id", "name", NM.profile(F.col("name")).alias("p"))
    return rows.select("id", "name", "p.normalised", "p.sorted_tokens", F.size("p.tokens").alias("n_tokens"))


@query("trigram_index", SQL_NAMES + f"SELECT item, count(*) AS n FROM (SELECT unnest({sql_tri('name')}) AS item FROM rw) GROUP BY 1")
def trigram_index(spark, sf_dir):
    classes = B.name_classes(synthetic.listed(spark, sf_dir), "id", "name")
    return classes.select(F.explode(NM.trigrams(F.col("name"))).alias("item")).groupBy("item").agg(F.count("*").alias("n"))


@query("phonetic_codes")
def phonetic_codes(spark, sf_dir):
    """Soundex, Double Metaphone and NYSIIS codes of every listed name class."""
    rows = B.name_classes(synthetic.listed(spark, sf_dir), "id", "name")
    words = NM.tokens(F.col("name"))
    return rows.select("name", NM.phonetic(F.col("name")).alias("soundex"), PH.double_metaphone_codes(words).alias("double_metaphone"), PH.nysiis_code("name").alias("nysiis"))


@query("name_measures", SQL_NAMES + f"""
SELECT id, round({sql_jaccard(sql_tokens('l'), sql_tokens('r'))}, 6) AS jaccard, round({sql_dice(sql_tri('l'), sql_tri('r'))}, 6) AS ngram,
  round({SQL_EDIT}, 6) AS edit, round({sql_jaccard(sql_phonetic('l'), sql_phonetic('r'))}, 6) AS phonetic,
  round(jaro_winkler_similarity({sql_sorted('l')}, {sql_sorted('r')}), 6) AS jaro_winkler, damerau_levenshtein(l, r)::INT AS damerau,
  array_to_string([left(w, 1) for w in {sql_tokens('r')}], '') AS acronym
FROM n WHERE l <> '' AND r <> ''
""")
def name_measures(spark, sf_dir):
    rows = SC.features(_pairs(spark, sf_dir).filter("l <> '' and r <> ''"))
    return rows.select("id", "jaccard", "ngram", "edit", "phonetic", "jaro_winkler", NM.damerau_levenshtein("l", "r").alias("damerau"), NM.acronym(NM.tokens(F.col("r"))).alias("acronym"))


def sql_weight(words: str) -> str:
    quoted = lambda xs: ", ".join(f"'{x}'" for x in xs)
    weight = f"CASE WHEN w IN ({quoted(NM.LEGAL)}) THEN 0.1 WHEN w IN ({quoted(NM.GENERIC)}) THEN 0.25 WHEN w IN ({quoted(NM.CONNECTORS)}) THEN 0.25 ELSE 1 END"
    return f"coalesce(list_sum([({weight})::DOUBLE for w in {words}]), 0)"


def sql_edit(a: str, b: str) -> str:
    return f"(1 - coalesce(levenshtein({a}, {b})::DOUBLE / nullif(greatest(length({a}), length({b})), 0), 0))"


@query("weighted_measures", SQL_NAMES + f"""
, t AS (
  SELECT id, list_distinct({sql_tokens("l")}) AS a, list_distinct({sql_tokens("r")}) AS b FROM n WHERE l <> '' AND r <> ''
), j AS (
  SELECT *, list_intersect(a, b) AS i, list_distinct(list_concat(a, b)) AS u, [x for x in a if NOT list_contains(b, x)] AS x, [y for y in b if NOT list_contains(a, y)] AS y FROM t
), s AS (
  SELECT *, array_to_string(list_sort(i), ' ') AS c, array_to_string(list_concat(list_sort(i), list_sort(x)), ' ') AS ca, array_to_string(list_concat(list_sort(i), list_sort(y)), ' ') AS cb FROM j
)
SELECT id, round({sql_weight("i")} / {sql_weight("u")}, 6) AS weighted_jaccard,
  round(greatest({sql_edit("ca", "cb")}, CASE WHEN c <> '' THEN greatest({sql_edit("c", "ca")}, {sql_edit("c", "cb")}) ELSE 0 END), 6) AS token_set FROM s
""")
def weighted_measures(spark, sf_dir):
    """Names as asked against names as listed, as those of organisations, whose generic words weigh little."""
    words = lambda c: F.array_distinct(NM.tokens(F.col(c)))
    rows = _pairs(spark, sf_dir).filter("l <> '' and r <> ''")
    return rows.select("id", F.round(NM.weighted_jaccard(words("l"), words("r")), 6).alias("weighted_jaccard"), F.round(NM.token_set_ratio(words("l"), words("r")), 6).alias("token_set"))


@query("initials_match", SQL_NAMES + f"""
SELECT id, len(a) > 0 AND len(a) = len(b) AND coalesce(list_bool_and([a[i] = b[i] OR (length(a[i]) = 1 AND starts_with(b[i], a[i])) OR (length(b[i]) = 1 AND starts_with(a[i], b[i])) for i in range(1, len(a) + 1)]), true) AS matches
FROM (SELECT id, {sql_tokens('l')} AS a, {sql_tokens('r')} AS b FROM n)
""")
def initials_match(spark, sf_dir):
    return _pairs(spark, sf_dir).select("id", NM.initials_match(NM.tokens(F.col("l")), NM.tokens(F.col("r"))).alias("matches"))


def _classes(spark, sf_dir):
    return B.name_classes(synthetic.subjects(spark, sf_dir), "id", "name"), B.name_classes(synthetic.listed(spark, sf_dir), "id", "name")


CROSS = f""", lx AS (
  SELECT name AS l, rep, n, list_distinct({sql_tokens('name')}) AS t, {sql_tri('name')} AS g, {sql_phonetic('name')} AS p FROM lw
), rx AS (
  SELECT name AS r, rep, n, list_distinct({sql_tokens('name')}) AS t, {sql_tri('name')} AS g, {sql_phonetic('name')} AS p FROM rw
), found AS (
  SELECT l, r, lx.rep AS subject, rx.rep AS entity, lx.n AS n_subjects, rx.n AS n_entities,
    l = r AS exact, {sql_jaccard('lx.t', 'rx.t')} >= 0.5 AS token, {sql_dice('lx.g', 'rx.g')} >= 0.7 AS trigram, lx.p = rx.p AS phonetic
  FROM lx, rx WHERE list_has_any(lx.g, rx.g) OR list_has_any(lx.p, rx.p)
)
"""


@query("block_exact", SQL_NAMES + "SELECT lw.name AS l, rw.name AS r, 'exact' AS strategy FROM lw JOIN rw USING (name)")
def block_exact(spark, sf_dir):
    return B.exact(*_classes(spark, sf_dir))


@query("block_token", SQL_NAMES + CROSS + "SELECT l, r, 'token' AS strategy FROM found WHERE token")
def block_token(spark, sf_dir):
    return B.by_token(*_classes(spark, sf_dir))


@query("block_trigram", SQL_NAMES + CROSS + "SELECT l, r, 'trigram' AS strategy FROM found WHERE trigram")
def block_trigram(spark, sf_dir):
    return B.by_trigram(*_classes(spark, sf_dir))


@query("block_phonetic", SQL_NAMES + CROSS + "SELECT l, r, 'phonetic' AS strategy FROM found WHERE phonetic")
def block_phonetic(spark, sf_dir):
    return B.by_phonetic(*_classes(spark, sf_dir))


@query("block_identifier", ORDERS + "SELECT o_orderkey AS l, uid AS r FROM s WHERE h < 3")
def block_identifier(spark, sf_dir):
    asked = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.lit("PASSPORT").alias("type"), F.concat(F.lit("p-"), ((F.col("o_orderkey") + 1) * 7919).cast("string")).alias("value"))
    listed = FX.identifiers(narratives(spark, sf_dir)).filter("type = 'PASSPORT'").select(F.col("uid").alias("id"), "type", "value")
    return B.by_identifier(asked, listed)


STRATEGIES = "list_sort([x.s for x in [{'s': 'exact', 'y': exact}, {'s': 'token', 'y': token}, {'s': 'trigram', 'y': trigram}, {'s': 'phonetic', 'y': phonetic}] if x.y])"


@query("candidate_union", SQL_NAMES + CROSS + f"SELECT l, r, array_to_string({STRATEGIES}, ',') AS strategies FROM found WHERE exact OR token OR trigram OR phonetic")
def candidate_union(spark, sf_dir):
    return B.candidates(*_classes(spark, sf_dir)).withColumn("strategies", F.array_join("strategies", ","))


@query("blocking_recall", SQL_NAMES + CROSS + """, truth AS (
  SELECT DISTINCT l, r FROM n WHERE l <> '' AND r <> ''
), hit AS (
  SELECT exact, token, trigram, phonetic FROM truth JOIN found USING (l, r)
), counts AS (
  SELECT unnest([{'s': 'exact', 'n': count(*) FILTER (exact)}, {'s': 'token', 'n': count(*) FILTER (token)}, {'s': 'trigram', 'n': count(*) FILTER (trigram)},
    {'s': 'phonetic', 'n': count(*) FILTER (phonetic)}, {'s': 'ALL', 'n': count(*) FILTER (exact OR token OR trigram OR phonetic)}]) AS x FROM hit
)
SELECT x.s AS strategy, (SELECT count(*) FROM truth) AS n_true, x.n AS n_found, round(x.n / (SELECT count(*) FROM truth)::DOUBLE, 6) AS recall FROM counts WHERE x.n > 0
""")
def blocking_recall(spark, sf_dir):
    truth = _pairs(spark, sf_dir).filter("l <> '' and r <> ''").select("l", "r")
    return B.recall(B.candidates(*_classes(spark, sf_dir)), truth)


WEIGHTED = """, f AS (
  SELECT found.*, entity_type, round(jaro_winkler_similarity(@sl, @sr), 6) AS jw, round(@jt, 6) AS ja, round(@jp, 6) AS ph, round(@ed, 6) AS ed, round(@di, 6) AS ng
  FROM found JOIN (SELECT id AS subject, entity_type FROM n) USING (subject) WHERE exact OR token OR trigram OR phonetic
), g AS (
  SELECT *, round(CASE entity_type WHEN 'INDIVIDUAL' THEN jw::DECIMAL(7,6) * 0.30 + ja::DECIMAL(7,6) * 0.20 + ph::DECIMAL(7,6) * 0.25 + ed::DECIMAL(7,6) * 0.15 + ng::DECIMAL(7,6) * 0.10
    ELSE jw::DECIMAL(7,6) * 0.25 + ja::DECIMAL(7,6) * 0.30 + ph::DECIMAL(7,6) * 0.10 + ed::DECIMAL(7,6) * 0.15 + ng::DECIMAL(7,6) * 0.20 END, 6)::DOUBLE AS name_score FROM f
), h AS (
  SELECT *, round(least(100, name_score * 100), 4) AS score FROM g
), k AS (
  SELECT *, CASE WHEN score >= 92 THEN 'STRONG' WHEN score >= 75 THEN 'POSSIBLE' ELSE 'NO_MATCH' END AS band,
    row_number() OVER (PARTITION BY l ORDER BY score DESC, r)::INT AS rank FROM h
)
""".replace("@sl", sql_sorted("l")).replace("@sr", sql_sorted("r")).replace("@jt", sql_jaccard(f"list_distinct({sql_tokens('l')})", f"list_distinct({sql_tokens('r')})")).replace("@jp", sql_jaccard(sql_phonetic("l"), sql_phonetic("r"))).replace("@ed", SQL_EDIT).replace("@di", sql_dice(sql_tri("l"), sql_tri("r")))  # fmt: skip
SCORED = SQL_NAMES + CROSS + WEIGHTED


def _screened(spark, sf_dir):
    return screening.screen(synthetic.subjects(spark, sf_dir), synthetic.listed(spark, sf_dir))


@query("composite_score", SCORED + "SELECT l, r, subject, entity, n_subjects, n_entities, name_score, score, band FROM k")
def composite_score(spark, sf_dir):
    return _screened(spark, sf_dir).select("l", "r", "subject", "entity", "n_subjects", "n_entities", "name_score", "score", "band")


@query("decision_bands", SCORED + "SELECT band, count(*) AS n FROM k GROUP BY 1")
def decision_bands(spark, sf_dir):
    return _screened(spark, sf_dir).groupBy("band").agg(F.count("*").alias("n"))


@query("topk_candidates", SCORED + "SELECT l, r, score, rank FROM k WHERE rank <= 50")
def topk_candidates(spark, sf_dir):
    return _screened(spark, sf_dir).filter(F.col("rank") <= SC.CONFIG["max_candidates"]).select("l", "r", "score", "rank")


@query("best_name_per_subject", SCORED + "SELECT l, r, score FROM k WHERE rank = 1")
def best_name_per_subject(spark, sf_dir):
    return _screened(spark, sf_dir).filter("rank = 1").select("l", "r", "score")


@query("request_outcome", SCORED + "SELECT l, CASE max(CASE band WHEN 'STRONG' THEN 2 WHEN 'POSSIBLE' THEN 1 ELSE 0 END) WHEN 2 THEN 'STRONG' WHEN 1 THEN 'POSSIBLE' ELSE 'NO_MATCH' END AS outcome FROM k GROUP BY 1")
def request_outcome(spark, sf_dir):
    return SC.request_outcome(_screened(spark, sf_dir), "l")


@query("request_outcomes", SCORED + """, o AS (
  SELECT l, max(CASE band WHEN 'STRONG' THEN 2 WHEN 'POSSIBLE' THEN 1 ELSE 0 END) AS grave FROM k GROUP BY 1
)
SELECT n.id, n.l, CASE WHEN n.l = '' THEN 'ERROR' WHEN grave = 2 THEN 'STRONG' WHEN grave = 1 THEN 'POSSIBLE' ELSE 'NO_MATCH' END AS outcome FROM n LEFT JOIN o ON n.l = o.l
""")
def request_outcomes(spark, sf_dir):
    """An outcome for every request; request_outcome has those of names with a candidate."""
    return screening.outcomes(synthetic.subjects(spark, sf_dir), synthetic.listed(spark, sf_dir))


def sql_gain(x: str, y: str) -> str:
    long = f"greatest(length({x}.t), length({y}.t))"
    alike = f"((({long} - levenshtein({x}.t, {y}.t)) * 1000000) // {long})"
    return f"CASE WHEN {alike} >= 700000 THEN ({alike} * least({x}.w, {y}.w)) // 1000000 ELSE 0 END"


def sql_fraction(t: str, w: str) -> str:
    words = lambda x: ", ".join(map(repr, x))
    cases = " ".join(f"WHEN {t} IN ({words(some)}) THEN {w} // {part}" for some, part in reversed(AL.FRACTIONS))
    return f"CASE {cases} ELSE {w} END"


#: Every way to assign words is tried.
ALIGNED = SCORED.replace("WITH raw", "WITH RECURSIVE raw", 1) + f""", df AS (
  SELECT t, floor(1000000 * ln((n + 1)::DOUBLE / (count(*) + 1)) / ln(n + 1) + 0.5)::BIGINT AS idf FROM (SELECT unnest(list_distinct({sql_tokens('name')})) AS t FROM rw), (SELECT count(*) AS n FROM rw) GROUP BY t, n
), w AS (
  SELECT name, list({{'t': t, 'w': {sql_fraction('t', 'coalesce(idf, 1000000)')}}} ORDER BY t) AS ws FROM (
    SELECT name, unnest(list_distinct({sql_tokens('name')})) AS t FROM (SELECT name FROM lw UNION SELECT name FROM rw)) LEFT JOIN df USING (t) GROUP BY name
), p AS (
  SELECT l, r, entity_type, CASE WHEN entity_type = 'INDIVIDUAL' THEN [{{'t': x.t, 'w': 1000000::BIGINT}} for x in a.ws] ELSE a.ws END AS a,
    CASE WHEN entity_type = 'INDIVIDUAL' THEN [{{'t': x.t, 'w': 1000000::BIGINT}} for x in b.ws] ELSE b.ws END AS b FROM k JOIN w a ON a.name = l JOIN w b ON b.name = r
), u AS (
  SELECT *, [x for x in a if NOT list_contains([y.t for y in b], x.t)] AS x, [y for y in b if NOT list_contains([x.t for x in a], y.t)] AS y FROM p
), gn AS (
  SELECT *, [[{sql_gain('i', 'j')} for j in y] for i in x] AS gains FROM u
), tried AS (
  SELECT l, r, 0 AS i, []::BIGINT[] AS used, 0::BIGINT AS total FROM gn
  UNION ALL
  SELECT l, r, i + 1, CASE WHEN j = 0 THEN used ELSE list_append(used, j) END, total + CASE WHEN j = 0 THEN 0 ELSE gains[i + 1][j] END
  FROM (SELECT t.*, gains, len(x) AS n, unnest(range(0, len(y) + 1)) AS j FROM tried t JOIN gn USING (l, r)) WHERE i < n AND NOT list_contains(used, j)
), best AS (
  SELECT l, r, max(total) AS best FROM tried GROUP BY 1, 2
), sums AS (
  SELECT gn.*, coalesce(list_sum([i.w for i in a]), 0)::BIGINT - coalesce(list_sum([i.w for i in x]), 0)::BIGINT + best AS both_, coalesce(list_sum([i.w for i in a]), 0)::BIGINT + coalesce(list_sum([i.w for i in b]), 0)::BIGINT AS all_,
    coalesce(list_max(list_concat([x[i].w for i in range(1, len(x) + 1) if coalesce(list_max(gains[i]), 0) = 0], [y[j].w for j in range(1, len(y) + 1) if coalesce(list_max([q[j] for q in gains]), 0) = 0])), 0) AS missing
  FROM gn JOIN best USING (l, r)
), al AS (
  SELECT l, r, entity_type, round(coalesce(both_::DOUBLE / nullif(all_ - both_, 0), 0) * (10000000 - CASE WHEN entity_type <> 'INDIVIDUAL' AND missing >= 500000 THEN missing * 5 ELSE 0 END) / 10000000, 6) AS alignment FROM sums
)
"""


def _compared(spark, sf_dir):
    """Candidate pairs with features, and the list's classes."""
    left, right = screening.classes(synthetic.subjects(spark, sf_dir), synthetic.listed(spark, sf_dir))
    return SC.features(B.candidates(left, right, None, *B.compared({"entity_type": "entity_type"}, None))), right


@query("soft_alignment", ALIGNED + "SELECT * FROM al")
def soft_alignment(spark, sf_dir):
    return AL.aligned(*_compared(spark, sf_dir)).select("l", "r", "entity_type", "alignment")


@query("organisation_score", ALIGNED + """, os AS (
  SELECT l, r, round(jw::DECIMAL(7,6) * 0.25 + alignment::DECIMAL(7,6) * 0.30 + ph::DECIMAL(7,6) * 0.10 + ed::DECIMAL(7,6) * 0.15 + ng::DECIMAL(7,6) * 0.20, 6)::DOUBLE AS s FROM k JOIN al USING (l, r) WHERE k.entity_type <> 'INDIVIDUAL'
)
SELECT l, r, round(s * 100, 4) AS score, CASE WHEN round(s * 100, 4) >= 92 THEN 'STRONG' WHEN round(s * 100, 4) >= 75 THEN 'POSSIBLE' ELSE 'NO_MATCH' END AS band FROM os
""")
def organisation_score(spark, sf_dir):
    """Organisations under the configuration that weighs words by the corpus."""
    return AL.scored(*_compared(spark, sf_dir)).filter("entity_type <> 'INDIVIDUAL'").select("l", "r", "score", "band")


@query("explanation", SCORED + "SELECT l, r, score, score AS recomputed FROM k")
def explanation(spark, sf_dir):
    return _screened(spark, sf_dir).select("l", "r", "score", SC.recomputed(F.col("explanation")).alias("recomputed"))


@query("alerts", SCORED + "SELECT l, r, score, 'OPEN' AS alert_status FROM k WHERE score >= 75")
def alerts(spark, sf_dir):
    return SC.alerts(_screened(spark, sf_dir)).select("l", "r", "score", "alert_status")


@query("threshold_sweep", SCORED + """, m AS (
  SELECT score, EXISTS (FROM n WHERE n.l = k.l AND n.r = k.r) AS is_true FROM k
), c AS (
  SELECT t::DOUBLE AS threshold, count(*) AS cases, sum((score >= t AND is_true)::INT)::BIGINT AS tp, sum((score >= t AND NOT is_true)::INT)::BIGINT AS fp, sum((score < t AND is_true)::INT)::BIGINT AS fn
  FROM m, (SELECT unnest([60, 70, 75, 80, 85, 90, 92, 95]) AS t) GROUP BY 1
)
SELECT *, round(coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(2.0::DOUBLE * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1 FROM c
""")
def threshold_sweep(spark, sf_dir):
    truth = _pairs(spark, sf_dir).select("l", "r").distinct().withColumn("is_true", F.lit(True))
    rows = _screened(spark, sf_dir).select("l", "r", "score").join(truth, ["l", "r"], "left").withColumn("is_true", F.coalesce("is_true", F.lit(False)))
    return BM.sweep(rows, [60, 70, 75, 80, 85, 90, 92, 95])


@query("benchmark_metrics", SCORED + """, b AS (
  SELECT n.id AS case_id, n.l, n.id % 4 AS class, n.entity_type, (SELECT rep FROM rw WHERE rw.name = n.r) AS expected FROM n
), hits AS (
  SELECT case_id, list(entity) AS found FROM b JOIN k ON b.l = k.l WHERE k.score >= 75 GROUP BY 1
), o AS (
  SELECT class, coalesce(list_contains(found, expected), false)::INT AS tp, coalesce(len(found), 0) - coalesce(list_contains(found, expected), false)::INT AS fp,
    (expected IS NOT NULL AND NOT coalesce(list_contains(found, expected), false))::INT AS fn FROM b LEFT JOIN hits USING (case_id)
), c AS (
  SELECT ['TURNED', 'CUT', 'UPPER', 'SHORT'][class + 1] AS case_class, count(*) AS cases, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn FROM o GROUP BY 1
)
SELECT *, round(coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0), 6) AS precision,
  round(coalesce(2.0::DOUBLE * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1, round(1000.0::DOUBLE * fp / cases, 6) AS fp_per_1000 FROM c
""")
def benchmark_metrics(spark, sf_dir):
    """Every document is a case: the name as asked should find the class of the name as listed."""
    _, right = _classes(spark, sf_dir)
    kind = F.element_at(F.array(*map(F.lit, ("TURNED", "CUT", "UPPER", "SHORT"))), (F.col("id") % 4 + 1).cast("int"))
    expected = right.select(F.col("name").alias("r"), F.col("rep").alias("expected_entity_id"))
    cases = _pairs(spark, sf_dir).join(expected, "r", "left").select(F.col("id").alias("case_id"), "l", kind.alias("case_class"), "expected_entity_id")
    found = _screened(spark, sf_dir).filter("score >= 75").select("l", F.col("entity").alias("entity_id"))
    hits = cases.select("case_id", "l").join(found, "l").select("case_id", "entity_id")
    return BM.metrics(BM.outcomes(cases, hits))


@query("parallel_run", SCORED + """
SELECT coalesce(a.l, b.l) AS l, coalesce(a.r, b.r) AS r, CASE WHEN a.l IS NULL THEN 'ONLY_THEIRS' WHEN b.l IS NULL THEN 'ONLY_OURS' ELSE 'BOTH_HIT' END AS agreement
FROM (SELECT l, r FROM k WHERE score >= 92) a FULL JOIN (SELECT l, r FROM k WHERE token) b ON a.l = b.l AND a.r = b.r
""")
def parallel_run(spark, sf_dir):
    """Strong matches against the hits of a system that compares words alone."""
    return BM.parallel_run(_screened(spark, sf_dir).filter("score >= 92"), B.by_token(*_classes(spark, sf_dir)), ["l", "r"])


def _identified(spark, sf_dir):
    """Both sides' classes, and those in common by passports: each document as asked has that of the next one as listed."""
    subjects, listed = synthetic.subjects(spark, sf_dir), synthetic.listed(spark, sf_dir)
    ids = lambda rows, shift, mark: rows.select("id", F.lit("PASSPORT").alias("type"), F.concat(F.lit(mark), (F.col("id") + shift).cast("string")).alias("value"))
    return *screening.classes(subjects, listed), screening.identified_classes(subjects, listed, ids(subjects, 1, "p-"), ids(listed, 0, "P"))


IDENTIFIED = SQL_NAMES + CROSS + """, ids AS (
  SELECT DISTINCT a.l, b.r FROM n a JOIN n b ON b.id = a.id + 1 WHERE a.l <> '' AND b.r <> ''
), by_name AS (
  SELECT * FROM found WHERE exact OR token OR trigram OR phonetic
), every AS (
  SELECT l, r, coalesce(exact, false) AS exact, coalesce(token, false) AS token, coalesce(trigram, false) AS trigram, coalesce(phonetic, false) AS phonetic, i.l IS NOT NULL AS identified
  FROM by_name FULL JOIN (SELECT l, r, l AS k FROM ids) i USING (l, r)
)
""".replace("i.l IS NOT NULL", "i.k IS NOT NULL")


@query("candidate_union_identified", IDENTIFIED + "SELECT l, r, array_to_string(list_sort([x.s for x in [{'s': 'exact', 'y': exact}, {'s': 'token', 'y': token}, {'s': 'trigram', 'y': trigram}, {'s': 'phonetic', 'y': phonetic}, {'s': 'identifier', 'y': identified}] if x.y]), ',') AS strategies FROM every")
def candidate_union_identified(spark, sf_dir):
    return B.candidates(*_identified(spark, sf_dir)).withColumn("strategies", F.array_join("strategies", ","))


@query("identifier_lift", IDENTIFIED + WEIGHTED.replace("SELECT found.*,", "SELECT found.*, identified,").replace("FROM found JOIN (SELECT id AS subject, entity_type FROM n) USING (subject) WHERE exact OR token OR trigram OR phonetic",
    "FROM (SELECT e.*, rep AS subject FROM every e JOIN lw ON lw.name = e.l) found JOIN (SELECT id AS subject, entity_type FROM n) USING (subject)").replace("SELECT found.*, identified,", "SELECT found.*,").replace(
    "round(least(100, name_score * 100), 4)", "round(CASE WHEN identified THEN greatest(92, least(100, name_score * 100)) ELSE least(100, name_score * 100) END, 4)")
    + "SELECT l, r, name_score, identified AS identifier_match, score, band FROM k")
def identifier_lift(spark, sf_dir):
    rows = screening.screen_classes(*_identified(spark, sf_dir))
    return rows.select("l", "r", "name_score", "identifier_match", "score", "band")


#: Classes for which a strategy gives no answer: by sound for names from a to c, by trigrams for short names.
ACCOUNTED = SCORED + """, fl AS (
  SELECT name AS l, name < 'd' AS no_sound, length(name) < 12 AS no_trigram FROM lw
), left_ AS (
  SELECT k.l, k.r, k.band, exact, token, trigram AND NOT no_trigram AS trigram, phonetic AND NOT no_sound AS phonetic FROM k JOIN fl USING (l)
), kept AS (
  SELECT * FROM left_ WHERE exact OR token OR trigram OR phonetic
), acc AS (
  SELECT l, any_value(no_sound OR no_trigram) AS partial, count(r) AS found, greatest(count(*) FILTER (exact), count(*) FILTER (token), count(*) FILTER (trigram), count(*) FILTER (phonetic)) AS most,
    max(CASE band WHEN 'STRONG' THEN 2 WHEN 'POSSIBLE' THEN 1 ELSE 0 END) AS grave FROM fl LEFT JOIN kept USING (l) GROUP BY 1
)
"""


def _accounted(spark, sf_dir):
    left, right = screening.classes(synthetic.subjects(spark, sf_dir), synthetic.listed(spark, sf_dir))
    return screening.accounted(left, right, {"phonetic": F.col("name") < "d", "trigram": F.length("name") < 12}, 3)


@query("candidate_outcomes", ACCOUNTED + """
SELECT l, found, CASE WHEN partial THEN 'PARTIAL' WHEN most > 3 THEN 'TRUNCATED' ELSE 'COMPLETE' END AS candidates,
  CASE WHEN partial THEN 'ERROR' WHEN grave = 2 THEN 'STRONG' WHEN grave = 1 THEN 'POSSIBLE' ELSE 'NO_MATCH' END AS outcome FROM acc
""")
def candidate_outcomes(spark, sf_dir):
    """How the candidates of every name were found, where two strategies fail for some; these names alone are errors."""
    return _accounted(spark, sf_dir)[1].select("l", "found", "candidates", "outcome")


@query("explained_strategies", ACCOUNTED + """
SELECT l, r, array_to_string(list_sort([x.s for x in [{'s': 'exact', 'y': exact}, {'s': 'token', 'y': token}, {'s': 'trigram', 'y': trigram}, {'s': 'phonetic', 'y': phonetic}] if x.y]), ',') AS strategies,
  concat_ws(',', CASE WHEN no_trigram THEN 'trigram' END, CASE WHEN no_sound THEN 'phonetic' END) AS failed FROM kept JOIN fl USING (l)
""")
def explained_strategies(spark, sf_dir):
    """Of every candidate the strategies that found it, and those that failed for its name."""
    e = F.col("explanation")
    failed = F.transform(F.filter(e["strategyOutcomes"], lambda x: x["outcome"] == "PARTIAL"), lambda x: x["strategy"])
    return _accounted(spark, sf_dir)[0].select("l", "r", F.array_join(e["strategies"], ",").alias("strategies"), F.array_join(failed, ",").alias("failed"))


@query("candidate_pages", SCORED + "SELECT l, r, rank, ((rank - 1) // 10 + 1)::INT AS page, max((rank - 1) // 10 + 1) OVER (PARTITION BY l)::INT AS pages FROM k")
def candidate_pages(spark, sf_dir):
    return SC.paged(_screened(spark, sf_dir), "l", 10).select("l", "r", "rank", "page", "pages")


@query("candidate_set_sizes", SQL_NAMES + CROSS + """
SELECT count(DISTINCT l) AS names, count(*) AS pairs, round(count(*)::DOUBLE / count(DISTINCT l), 6) AS mean_size FROM found WHERE exact OR token OR trigram OR phonetic
""")
def candidate_set_sizes(spark, sf_dir):
    each = B.candidates(*_classes(spark, sf_dir)).groupBy("l").agg(F.count("*").alias("n"))
    return each.agg(F.count("*").alias("names"), F.sum("n").alias("pairs"), F.round(F.sum("n") / F.count("*"), 6).alias("mean_size"))


@query("agreement_counts", SCORED + """
SELECT CASE WHEN score >= 92 AND token THEN 'BOTH_HIT' WHEN score >= 92 THEN 'ONLY_OURS' WHEN token THEN 'ONLY_THEIRS' ELSE 'BOTH_CLEAR' END AS agreement, count(*) AS n FROM k GROUP BY 1
""")
def agreement_counts(spark, sf_dir):
    """All candidates: strong ones of ours against the hits of a system that compares words alone."""
    rows = BM.agreement(_screened(spark, sf_dir), F.col("score") >= 92, F.array_contains("strategies", "token"))
    return rows.groupBy("agreement").agg(F.count("*").alias("n"))


@query("batch_chunks", SCORED + """, o AS (
  SELECT n.id // 100 AS chunk, n.l = '' AS bad FROM n
)
SELECT chunk, count(*) AS requests, count(*) FILTER (bad) AS errors, CASE WHEN count(*) FILTER (bad) = 0 THEN 'COMPLETE' WHEN count(*) FILTER (bad) < count(*) THEN 'PARTIAL' ELSE 'FAILED' END AS status FROM o GROUP BY 1
""")
def batch_chunks(spark, sf_dir):
    """Requests in chunks of a hundred, and how each chunk ended."""
    rows = screening.outcomes(synthetic.subjects(spark, sf_dir), synthetic.listed(spark, sf_dir))
    return OP.chunk_status(rows, F.floor(F.col("id") / 100))


# ---------------------------------------------------------------- attributes


@query("attribute_effects", """
WITH p AS (
  SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 2 = 0 THEN 'INDIVIDUAL' ELSE 'ORGANISATION' END AS entity_type,
    round(l_discount * 10, 6) AS v, CASE WHEN l_linenumber <> 3 THEN l_shipdate::DATE END AS dob, o_orderdate::DATE AS listed_dob,
    c_nationkey = s_nationkey AS same, l_linenumber = 4 AS no_country, CASE WHEN l_returnflag = 'A' THEN 'INDIVIDUAL' ELSE 'ORGANISATION' END AS listed_type,
    l_quantity = 50 AS identified, l_returnflag = 'R' AS white, l_linestatus = 'F' AS gone
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
), e AS (
  SELECT *, CASE WHEN dob IS NULL THEN 0 WHEN dob = listed_dob THEN 10 WHEN year(dob) = year(listed_dob) THEN 5 WHEN abs(year(dob) - year(listed_dob)) <= 1 THEN 0 ELSE -15 END
    + CASE WHEN no_country THEN 0 WHEN same THEN 5 ELSE -5 END + CASE WHEN entity_type = listed_type THEN 0 ELSE -10 END + CASE WHEN white THEN -20 ELSE 0 END + CASE WHEN gone THEN -10 ELSE 0 END AS effect FROM p
), c AS (
  SELECT *, greatest(0, least(100, round(v, 6) * 100 + effect)) AS raw FROM e
), f AS (
  SELECT *, round(CASE WHEN identified THEN greatest(raw, 92) ELSE raw END, 4)::DOUBLE AS score FROM c
)
SELECT l_orderkey, l_linenumber, score, CASE WHEN score >= 92 THEN 'STRONG' WHEN score >= 75 THEN 'POSSIBLE' ELSE 'NO_MATCH' END AS band FROM f
""")
def attribute_effects(spark, sf_dir):
    """Effects of dates, countries, types, whitelists and statuses on every line item, as if it were a candidate."""
    rows = load(spark, sf_dir, "lineitem").join(load(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    rows = rows.join(load(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    rows = rows.join(load(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    value = F.round(F.col("l_discount") * 10, 6)
    line = F.col("l_linenumber")
    pairs = rows.select(
        "l_orderkey", "l_linenumber", *[value.alias(f) for f in SC.FEATURES],
        F.when(line % 2 == 0, "INDIVIDUAL").otherwise("ORGANISATION").alias("entity_type"),
        F.when(line != 3, F.col("l_shipdate").cast("date")).alias("dob"), F.col("o_orderdate").cast("date").alias("listed_dob"),
        F.when(line != 4, F.col("c_nationkey")).alias("country"), F.col("s_nationkey").alias("listed_country"),
        F.when(F.col("l_returnflag") == "A", "INDIVIDUAL").otherwise("ORGANISATION").alias("listed_type"),
        (F.col("l_quantity") == 50).alias("identifier_match"), (F.col("l_returnflag") == "R").alias("whitelisted"),
        F.when(F.col("l_linestatus") == "F", "REMOVED_EVERYWHERE").alias("status"),
    )
    return SC.scored(pairs).select("l_orderkey", "l_linenumber", "score", "band")


# ---------------------------------------------------------------- versions

LISTS = """
WITH live AS (
  SELECT c_custkey, c_name, c_nationkey, c_mktsegment FROM customer
), staged AS (
  SELECT CASE WHEN c_custkey % 50 = 1 THEN c_custkey + 10000000 ELSE c_custkey END AS c_custkey, c_name,
    CASE WHEN c_custkey % 30 = 2 THEN c_nationkey + 1 ELSE c_nationkey END AS c_nationkey, c_mktsegment FROM customer
), ch AS (
  SELECT coalesce(a.c_custkey, b.c_custkey) AS c_custkey, CASE WHEN a.c_custkey IS NULL THEN 'ADDED' WHEN b.c_custkey IS NULL THEN 'DELISTED'
    WHEN a.c_nationkey = b.c_nationkey THEN 'UNCHANGED' ELSE 'AMENDED' END AS change FROM live a FULL JOIN staged b ON a.c_custkey = b.c_custkey
)
"""


def _lists(spark, sf_dir):
    """Two versions of the customers as a list: some ids withdrawn and given anew, some nations changed."""
    live = load(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    key = F.col("c_custkey")
    staged = live.withColumns({"c_nationkey": F.when(key % 30 == 2, F.col("c_nationkey") + 1).otherwise(F.col("c_nationkey")), "c_custkey": F.when(key % 50 == 1, key + 10_000_000).otherwise(key)})
    hashed = lambda rows: rows.withColumn("hash", VS.content_hash("c_name", "c_nationkey", "c_mktsegment"))
    return hashed(live), hashed(staged)


@query("content_hash", """
SELECT c_custkey, sha256('=' || c_mktsegment || chr(31) || '=' || c_name || chr(31) || '=' || c_nationkey) AS hash FROM customer
""")
def content_hash(spark, sf_dir):
    return _lists(spark, sf_dir)[0].select("c_custkey", "hash")


@query("reconcile_versions", LISTS + "SELECT * FROM ch")
def reconcile_versions(spark, sf_dir):
    return VS.reconcile(*_lists(spark, sf_dir), "c_custkey").select("c_custkey", "change")


@query("reload_is_idempotent", "SELECT 'UNCHANGED' AS change, count(*) AS n FROM customer")
def reload_is_idempotent(spark, sf_dir):
    live, _ = _lists(spark, sf_dir)
    return VS.reconcile(live, live, "c_custkey").groupBy("change").agg(F.count("*").alias("n"))


@query("tombstones", LISTS + "SELECT c_custkey FROM ch WHERE change = 'DELISTED'")
def tombstones(spark, sf_dir):
    return VS.tombstones(*_lists(spark, sf_dir), "c_custkey").select("c_custkey")


@query("published_versions", LISTS + """
SELECT 'before' AS reader, count(*) AS rows_, sum(c_nationkey)::BIGINT AS nations FROM live UNION ALL SELECT 'after', count(*), sum(c_nationkey)::BIGINT FROM staged UNION ALL SELECT 'rolled back', count(*), sum(c_nationkey)::BIGINT FROM live
""")
def published_versions(spark, sf_dir):
    """Two versions of a list: a reader from before the promotion, one from after it, and one from after the roll-back."""
    one, two = _lists(spark, sf_dir)
    path = f"{shared_folder(spark)}/list-{uuid.uuid4().hex}"
    first, second = PB.stage(one, path, "1", "c_custkey"), PB.stage(two, path, "2", "c_custkey")
    out = None
    for name, staged in (("before", first), ("after", second), ("rolled back", first)):
        PB.promote(spark, path, staged, "c_custkey")
        told = PB.live(spark, path).agg(F.count("*").alias("rows_"), F.sum("c_nationkey").cast("long").alias("nations")).select(F.lit(name).alias("reader"), "rows_", "nations")
        out = told if out is None else out.unionByName(told)  # read only when all promotions are over
    return out


@query("delta_gate", LISTS + """, c AS (
  SELECT count(*) FILTER (change = 'ADDED') AS added, count(*) FILTER (change = 'AMENDED') AS amended, count(*) FILTER (change = 'DELISTED') AS delisted, count(*) FILTER (change = 'UNCHANGED') AS unchanged FROM ch
)
SELECT *, round((added + amended + delisted)::DOUBLE / (amended + delisted + unchanged), 6) AS delta_share, (added + amended + delisted)::DOUBLE / (amended + delisted + unchanged) > 0.2 AS halt FROM c
""")
def delta_gate(spark, sf_dir):
    return VS.delta_gate(VS.reconcile(*_lists(spark, sf_dir), "c_custkey"))


@query("load_report", """
SELECT CASE WHEN o_custkey % 5 = 0 THEN 'TEST_CUSTOMER' WHEN o_totalprice < 50000 THEN 'TOO_SMALL' WHEN o_orderstatus = 'P' THEN 'PENDING' ELSE 'LOADED' END AS outcome, count(*) AS n FROM orders GROUP BY 1
""")
def load_report(spark, sf_dir):
    """Orders as delivered records, of which some are rejected, for a reason each."""
    reasons = {"TEST_CUSTOMER": F.col("o_custkey") % 5 == 0, "TOO_SMALL": F.col("o_totalprice") < 50_000, "PENDING": F.col("o_orderstatus") == "P"}
    return VS.load_report(load(spark, sf_dir, "orders"), reasons)


@query("capability_gate", """
WITH m AS (
  SELECT 'ENTITY_TYPE' AS slot, round(avg((c_custkey % 10 <> 0)::INT), 6) AS coverage, 0.9::DOUBLE AS expected FROM customer
  UNION ALL SELECT 'COUNTRY', round(avg((c_custkey % 4 = 0)::INT), 6), 1.0 FROM customer
)
SELECT *, abs(coverage - expected) <= 0.05 AS ok FROM m
""")
def capability_gate(spark, sf_dir):
    rows = load(spark, sf_dir, "customer").select(
        F.when(F.col("c_custkey") % 10 != 0, F.col("c_mktsegment")).alias("ENTITY_TYPE"), F.when(F.col("c_custkey") % 4 == 0, F.col("c_nationkey")).alias("COUNTRY")
    )
    expected = spark.createDataFrame([("ENTITY_TYPE", 0.9), ("COUNTRY", 1.0)], "slot string, expected double")
    return VS.capability_gate(VS.coverage(rows, ["ENTITY_TYPE", "COUNTRY"]), expected)


VERSIONS = """
WITH v AS (
  SELECT o_custkey, o_orderkey, o_orderdate AS valid_from, lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, sha256('=' || o_orderkey)) AS valid_to FROM orders
)
"""


def _versions(spark, sf_dir):
    rows = load(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.col("o_orderdate").alias("valid_from")).withColumn("hash", VS.content_hash("o_orderkey"))
    return VS.intervals(rows, "o_custkey")


@query("validity_intervals", VERSIONS + "SELECT o_custkey, o_orderkey, valid_to - valid_from AS d FROM v".replace("valid_to - valid_from AS d", "datediff('day', valid_from, valid_to)::INT AS days"))
def validity_intervals(spark, sf_dir):
    return _versions(spark, sf_dir).select("o_custkey", "o_orderkey", F.datediff("valid_to", "valid_from").alias("days"))


@query("point_in_time", VERSIONS + "SELECT o_custkey, o_orderkey FROM v WHERE valid_from <= TIMESTAMP '1996-06-30' AND (valid_to IS NULL OR TIMESTAMP '1996-06-30' < valid_to)")
def point_in_time(spark, sf_dir):
    return VS.as_of(_versions(spark, sf_dir), F.lit("1996-06-30").cast("timestamp_ntz")).select("o_custkey", "o_orderkey")


@query("requests_as_of", """
WITH req AS (
  SELECT l_orderkey, l_linenumber, l_shipdate AS at, o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey
), rec AS (
  SELECT o_custkey, o_orderdate AS start, max(o_orderkey) AS version FROM orders GROUP BY ALL
), conf AS (
  SELECT o_orderdate AS start, max(o_orderkey) AS version FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderkey % 40 = 1 GROUP BY ALL
), white AS (
  SELECT o_custkey, o_orderdate AS start, max(o_orderkey) AS entry FROM orders WHERE o_orderstatus = 'F' GROUP BY ALL
)
SELECT l_orderkey, l_linenumber, rec.version AS record_version, conf.version AS config_version, coalesce(req.at < white.start + INTERVAL 30 DAY, false) AS whitelisted
FROM req ASOF LEFT JOIN rec ON req.o_custkey = rec.o_custkey AND req.at >= rec.start ASOF LEFT JOIN conf ON req.at >= conf.start
  ASOF LEFT JOIN white ON req.o_custkey = white.o_custkey AND req.at >= white.start
""")
def requests_as_of(spark, sf_dir):
    """Line items as requests at their ship dates: their customer's record, the configuration and the whitelist entry in force then."""
    orders = load(spark, sf_dir, "orders")
    requests = load(spark, sf_dir, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select("l_orderkey", "l_linenumber", F.col("l_shipdate").alias("at"), "o_custkey")
    rows = VS.in_force(requests, orders, "at", "o_orderdate", ["o_orderkey"], "record", ("o_custkey",))
    rows = VS.in_force(rows, orders.filter("o_orderpriority = '1-URGENT' and o_orderkey % 40 = 1"), "at", "o_orderdate", ["o_orderkey"], "config")
    entries = orders.filter("o_orderstatus = 'F'").withColumn("until", F.col("o_orderdate") + F.expr("interval 30 days"))
    rows = VS.in_force(rows, entries, "at", "o_orderdate", ["o_orderkey", "until"], "entry", ("o_custkey",))
    white = F.coalesce(F.col("at") < F.col("entry.until"), F.lit(False))
    return rows.select("l_orderkey", "l_linenumber", F.col("record.o_orderkey").alias("record_version"), F.col("config.o_orderkey").alias("config_version"), white.alias("whitelisted"))


@query("list_fingerprint", "SELECT count(*) AS n, sum(('0x' || substr(sha256('=' || c_mktsegment || chr(31) || '=' || c_name || chr(31) || '=' || c_nationkey), 1, 8))::BIGINT)::BIGINT AS checksum FROM customer")
def list_fingerprint(spark, sf_dir):
    return VS.fingerprint(_lists(spark, sf_dir)[0])


@query("orphans", "SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)")
def orphans(spark, sf_dir):
    orders = load(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    return VS.orphans(orders, load(spark, sf_dir, "customer"), "c_custkey").select("o_orderkey")


POINTERS = """
WITH e AS (
  SELECT o_custkey, o_orderkey, o_orderdate, CASE WHEN o_orderkey % 3 = 0 THEN 'ROLLBACK' ELSE 'PROMOTE' END AS action, o_orderkey % 4 AS version FROM orders
), h AS (
  SELECT *, action = 'PROMOTE' OR EXISTS (FROM e p WHERE p.o_custkey = e.o_custkey AND p.version = e.version AND p.action = 'PROMOTE' AND (p.o_orderdate, p.o_orderkey) < (e.o_orderdate, e.o_orderkey)) AS valid FROM e
)
"""


def _pointers(spark, sf_dir):
    """Each customer as a list that its orders point at one of four versions."""
    key = F.col("o_orderkey")
    events = load(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate", F.when(key % 3 == 0, "ROLLBACK").otherwise("PROMOTE").alias("action"), (key % 4).alias("version"))
    return EV.pointer_history(events, "o_custkey", ["o_orderdate", "o_orderkey"])


@query("version_pointers", POINTERS + """
SELECT o_custkey, o_orderkey, valid, last_value(CASE WHEN valid THEN version END IGNORE NULLS) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS live_before FROM h
""")
def version_pointers(spark, sf_dir):
    return _pointers(spark, sf_dir).select("o_custkey", "o_orderkey", "valid", "live_before")


@query("live_versions", POINTERS + "SELECT o_custkey, arg_max(version, (o_orderdate, o_orderkey)) AS version FROM h WHERE valid GROUP BY 1")
def live_versions(spark, sf_dir):
    return EV.live_versions(_pointers(spark, sf_dir), "o_custkey", ["o_orderdate", "o_orderkey"])


CANARY = """
WITH e AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity > 40 THEN 'STRONG' ELSE 'POSSIBLE' END AS band FROM lineitem WHERE l_discount > 0.02),
f AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity > 45 THEN 'STRONG' ELSE 'POSSIBLE' END AS band FROM lineitem WHERE l_tax > 0.01),
o AS (SELECT l_orderkey, l_linenumber, CASE WHEN f.band IS NULL THEN 'MISSING' WHEN e.band IS NULL THEN 'UNEXPECTED' WHEN e.band = f.band THEN 'OK' ELSE 'DIFFERS' END AS outcome FROM e FULL JOIN f USING (l_orderkey, l_linenumber))
"""


def _canary(spark, sf_dir):
    rows = load(spark, sf_dir, "lineitem")
    banded = lambda kept, cut: rows.filter(kept).select("l_orderkey", "l_linenumber", F.when(F.col("l_quantity") > cut, "STRONG").otherwise("POSSIBLE").alias("band"))
    return EV.canary(banded("l_discount > 0.02", 40), banded("l_tax > 0.01", 45), ["l_orderkey", "l_linenumber"], "band")


@query("canary_outcomes", CANARY + "SELECT * FROM o")
def canary_outcomes(spark, sf_dir):
    """Line items as canaries: the bands that are expected against those that another threshold gives."""
    return _canary(spark, sf_dir)


@query("canary_gate", CANARY + "SELECT count(*) AS cases, count(*) FILTER (outcome <> 'OK') AS deviations, count(*) FILTER (outcome <> 'OK') > 0 OR count(*) = 0 AS critical FROM o")
def canary_gate(spark, sf_dir):
    return EV.canary_gate(_canary(spark, sf_dir))


@query("config_changes", """
WITH c AS (
  SELECT o_custkey, o_orderkey, o_orderstatus AS value, o_orderkey % 4 <> 0 AS approved, o_orderkey % 5 <> 0 AS regression_passed,
    lag(o_orderstatus) OVER q AS previous, row_number() OVER q AS v FROM orders WINDOW q AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)
)
SELECT o_custkey, o_orderkey, previous, value, v::INT AS config_version, previous IS DISTINCT FROM value AS changed, previous IS DISTINCT FROM value AND approved AND regression_passed AS promotable FROM c
""")
def config_changes(spark, sf_dir):
    """Each customer as a parameter that its orders set."""
    key = F.col("o_orderkey")
    history = load(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate", F.col("o_orderstatus").alias("value"), (key % 4 != 0).alias("approved"), (key % 5 != 0).alias("regression_passed"))
    out = EV.config_changes(history, "o_custkey", ["o_orderdate", "o_orderkey"], "value")
    return out.select("o_custkey", "o_orderkey", "previous", "value", "config_version", "changed", "promotable")


def _decisions(spark, sf_dir):
    """Orders as requests and their line items as the candidates that were stored with them."""
    band = F.when(F.col("l_quantity") > 40, "STRONG").when(F.col("l_quantity") > 20, "POSSIBLE").otherwise("NO_MATCH")
    rows = load(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("o_orderkey"), F.col("l_linenumber").cast("int").alias("rank"), F.col("l_partkey").cast("long").alias("entity"),
        F.col("l_quantity").cast("int").alias("score"), band.alias("band"),
    )
    requests = load(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", F.col("o_custkey").cast("long").alias("list_version"))
    return EV.decisions(requests, rows, "o_orderkey", F.struct("rank", "entity", "score"), ["rank", "entity", "score", "band"], ["o_orderstatus", "list_version"])


DECISIONS = """
WITH c AS (
  SELECT l_orderkey AS o_orderkey, count(*) AS n, list({'rank': l_linenumber::INT, 'entity': l_partkey::BIGINT, 'score': l_quantity::INT,
    'band': CASE WHEN l_quantity > 40 THEN 'STRONG' WHEN l_quantity > 20 THEN 'POSSIBLE' ELSE 'NO_MATCH' END} ORDER BY l_linenumber, l_partkey, l_quantity::INT) AS candidates FROM lineitem GROUP BY 1
)
"""


@query("decision_records", DECISIONS + """
SELECT o_orderkey, coalesce(n, 0) AS n_candidates, to_json({'o_orderstatus': o_orderstatus, 'list_version': o_custkey::BIGINT, 'candidates': coalesce(candidates, [])})::VARCHAR AS evidence FROM orders LEFT JOIN c USING (o_orderkey)
""")
def decision_records(spark, sf_dir):
    return _decisions(spark, sf_dir)


@query("decision_replay", "SELECT l_orderkey AS o_orderkey, o_orderstatus, o_custkey::BIGINT AS list_version, l_linenumber::INT AS rank, l_partkey::BIGINT AS entity, l_quantity::INT AS score, CASE WHEN l_quantity > 40 THEN 'STRONG' WHEN l_quantity > 20 THEN 'POSSIBLE' ELSE 'NO_MATCH' END AS band FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def decision_replay(spark, sf_dir):
    """Every candidate again, from the stored evidence alone."""
    schema = "o_orderstatus string, list_version long, candidates array<struct<rank:int,entity:long,score:int,band:string>>"
    return EV.told_again(_decisions(spark, sf_dir), "o_orderkey", schema)


@query("list_source_effect", """
WITH s AS (SELECT l_orderkey, l_linenumber, round(l_discount * 10, 6) AS v, CASE l_returnflag WHEN 'A' THEN 3 WHEN 'R' THEN -4 ELSE 0 END AS effect, l_linenumber <> 5 AS complete FROM lineitem),
t AS (SELECT *, round(greatest(0, least(100, v * 100 + effect)), 4)::DOUBLE AS score FROM s)
SELECT l_orderkey, l_linenumber, score, CASE WHEN NOT complete THEN 'ERROR' WHEN score >= 92 THEN 'STRONG' WHEN score >= 75 THEN 'POSSIBLE' ELSE 'NO_MATCH' END AS band FROM t
""")
def list_source_effect(spark, sf_dir):
    """Line items as candidates of list sources that a configuration weighs; the fifth of an order is of a partial answer."""
    config = SC.validated(SC.CONFIG | {"list_source": {"A": 3.0, "R": -4.0}}, {"DATE_OF_BIRTH", "COUNTRY", "ENTITY_TYPE", "LIST_SOURCE", "STATUS"})
    value = F.round(F.col("l_discount") * 10, 6)
    rows = load(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", *[value.alias(f) for f in SC.FEATURES], F.lit("INDIVIDUAL").alias("entity_type"),
        F.col("l_returnflag").alias("list_source"), (F.col("l_linenumber") != 5).alias("complete"),
    )
    return SC.scored(rows, config).select("l_orderkey", "l_linenumber", "score", "band")


# ---------------------------------------------------------------- operations


@query("disposition_latest", "SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1")
def disposition_latest(spark, sf_dir):
    """The events as dispositions of one alert for each user."""
    return OP.latest(load(spark, sf_dir, "events"), "user_id", "ts", "event_id", "event_type").select("user_id", "event_type", "event_id")


@query("usage_mi", """
SELECT event_type, count(*) AS requests, round(avg((value > 50)::INT), 6) AS alert_rate, round(quantile_cont(value, 0.5), 6) AS p50,
  round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY 1
""")
def usage_mi(spark, sf_dir):
    return OP.usage(load(spark, sf_dir, "events").withColumn("alert", F.col("value") > 50), "event_type", "value")


@query("alert_drift", """
WITH d AS (
  SELECT event_type AS series, date_trunc('day', ts)::DATE AS day, round(avg((value > 50)::INT), 6) AS rate FROM events GROUP BY ALL
), b AS (
  SELECT *, round(avg(rate) OVER (PARTITION BY series ORDER BY day ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING), 6) AS baseline FROM d
)
SELECT *, coalesce(abs(rate - baseline) > 0.5 * baseline, false) AS drift FROM b
""")
def alert_drift(spark, sf_dir):
    daily = load(spark, sf_dir, "events").groupBy(F.col("event_type").alias("series"), F.col("ts").cast("date").alias("day"))
    return OP.drift(daily.agg(F.round(F.avg((F.col("value") > 50).cast("int")), 6).alias("rate")), "day", "rate")


@query("list_freshness", """
WITH l AS (SELECT event_type AS source, max(ts) AS loaded_at FROM events GROUP BY 1)
SELECT source, floor((epoch(TIMESTAMP '2024-02-01') - epoch(loaded_at)) / 3600)::BIGINT AS age_hours, floor((epoch(TIMESTAMP '2024-02-01') - epoch(loaded_at)) / 3600) > 36 AS critical FROM l
""")
def list_freshness(spark, sf_dir):
    loads = load(spark, sf_dir, "events").select(F.col("event_type").alias("source"), F.col("ts").alias("loaded_at"))
    return OP.freshness(loads, F.lit("2024-02-01 00:00:00").cast("timestamp")).drop("loaded_at")


@query("idempotency_conflicts", "SELECT user_id AS key, count(*) AS n, count(DISTINCT sha256(props)) AS payloads, count(DISTINCT sha256(props)) > 1 AS conflict FROM events GROUP BY 1")
def idempotency_conflicts(spark, sf_dir):
    return OP.idempotency(load(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.sha2("props", 256).alias("payload_hash")))


@query("whitelist_flags", """
SELECT o_orderkey, o_orderdate >= TIMESTAMP '1997-01-01' AS whitelisted FROM orders
""")
def whitelist_flags(spark, sf_dir):
    """Orders as candidates; each has an entry that some expire before the day in question."""
    orders = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l"), F.col("o_custkey").alias("r"), F.col("o_orderdate").alias("expires_at"))
    at = F.lit("1997-01-01").cast("timestamp_ntz")
    entries = orders.withColumns({"approved_at": F.lit("1990-01-01").cast("timestamp_ntz"), "expires_at": F.col("expires_at") + F.expr("interval 1 day")})
    return OP.whitelisted(orders.select("l", "r"), entries, at).select(F.col("l").alias("o_orderkey"), "whitelisted")


@query("rescreen_outcomes", """
WITH a AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity > 40 THEN 'STRONG' ELSE 'POSSIBLE' END AS band FROM lineitem WHERE l_discount > 0.02),
b AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity > 30 THEN 'STRONG' ELSE 'POSSIBLE' END AS band FROM lineitem WHERE l_tax > 0.02)
SELECT CASE WHEN a.band IS NULL THEN 'NEW_HIT' WHEN b.band IS NULL THEN 'RESOLVED_HIT' WHEN a.band = b.band THEN 'UNCHANGED' ELSE 'CHANGED_HIT' END AS outcome, count(*) AS n
FROM a FULL JOIN b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber GROUP BY 1
""")
def rescreen_outcomes(spark, sf_dir):
    rows = load(spark, sf_dir, "lineitem")
    banded = lambda kept, cut: rows.filter(kept).select("l_orderkey", "l_linenumber", F.when(F.col("l_quantity") > cut, "STRONG").otherwise("POSSIBLE").alias("band"))
    out = OP.rescreened(banded("l_discount > 0.02", 40), banded("l_tax > 0.02", 30), ["l_orderkey", "l_linenumber"])
    return out.groupBy("outcome").agg(F.count("*").alias("n"))


@query("delta_rescreen", LISTS + "SELECT o_orderkey FROM orders JOIN ch ON o_custkey = c_custkey WHERE change IN ('ADDED', 'AMENDED')")
def delta_rescreen(spark, sf_dir):
    """Only what new or amended list records concern is screened again."""
    changed = VS.reconcile(*_lists(spark, sf_dir), "c_custkey").filter(F.col("change").isin("ADDED", "AMENDED"))
    orders = load(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey")
    return orders.join(changed, "c_custkey", "left_semi").select("o_orderkey")


#: The next version of the list of documents' names: some amended, some added, some withdrawn.
DELTA = SQL_NAMES.replace("FROM n WHERE r <> '' GROUP BY 1\n)", f"""FROM (
    SELECT id, {sql_norm("x")} AS r FROM (SELECT id, listed || ' Group' AS x FROM named WHERE id % 7 = 3 UNION ALL SELECT id + 1000000000, 'Neo ' || listed FROM named WHERE id % 13 = 2)
  ) WHERE r <> '' GROUP BY 1
)""")


def _list_delta(spark, sf_dir):
    """Names of the next version's new and amended records, and normalised names that it has no more."""
    rows = synthetic.listed(spark, sf_dir)
    amended = rows.filter("id % 7 = 3").withColumn("name", F.concat("name", F.lit(" Group")))
    added = rows.filter("id % 13 = 2").select((F.col("id") + 1_000_000_000).alias("id"), F.concat(F.lit("Neo "), "name").alias("name"))
    gone = (F.col("id") % 7 == 3) | (F.col("id") % 11 == 5)
    named = rows.select(NM.normalised(F.col("name")).alias("name"), gone.alias("gone")).filter("name <> ''")
    lost = named.groupBy("name").agg(F.every("gone").alias("gone")).filter("gone").select("name")
    return amended.unionByName(added), lost


@query("delta_rescreen_scored", DELTA + CROSS + WEIGHTED + "SELECT l, r, subject, entity, n_subjects, n_entities, score, band FROM k")
def delta_rescreen_scored(spark, sf_dir):
    """The documents' names as asked, as a registered population, against what a new version of the list changed."""
    population = index.build(synthetic.subjects(spark, sf_dir), "id", "name", "entity_type")
    changed, _ = _list_delta(spark, sf_dir)
    return index.rescreened(population, changed, "id", "name").select("l", "r", "subject", "entity", "n_subjects", "n_entities", "score", "band")


@query("index_updates", SQL_NAMES + f""", lost AS (
  SELECT r AS name FROM n WHERE r <> '' GROUP BY 1 HAVING bool_and(id % 7 = 3 OR id % 11 = 5)
), fresh AS (
  SELECT id, {sql_norm("x")} AS name FROM (SELECT id, listed || ' Group' AS x FROM named WHERE id % 7 = 3 UNION ALL SELECT id + 1000000000, 'Neo ' || listed FROM named WHERE id % 13 = 2)
), every AS (
  SELECT name, rep FROM rw ANTI JOIN lost USING (name) UNION ALL SELECT name, min(id) FROM fresh WHERE name <> '' AND name NOT IN (SELECT name FROM rw ANTI JOIN lost USING (name)) GROUP BY 1
)
SELECT type, count(*) AS classes, sum(rep)::BIGINT AS reps FROM every, (SELECT unnest(['exact', 'phonetic']) AS type) GROUP BY 1
""")
def index_updates(spark, sf_dir):
    """Live postings of whole names after a delta: withdrawn names are buried, new ones appended."""
    first = index.build(synthetic.listed(spark, sf_dir), "id", "name")
    changed, lost = _list_delta(spark, sf_dir)
    now = index.live(index.updated(first, changed, lost, "id", "name"))
    keys = now.keys.filter(F.col("type").isin("exact", "phonetic")).join(now.classes.select("name", "rep"), "name")
    return keys.groupBy("type").agg(F.count("*").alias("classes"), F.sum("rep").alias("reps"))


@query("repeat_alert_suppression", "SELECT o_orderkey, date_diff('day', o_orderdate::DATE, DATE '1998-08-02') <= 90 AS suppressed FROM orders")
def repeat_alert_suppression(spark, sf_dir):
    alerts_ = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", VS.content_hash("o_custkey").alias("content_hash"), F.col("o_orderdate").cast("date").alias("closed_at"))
    return OP.suppressed(alerts_.drop("closed_at"), alerts_, ["o_orderkey"], F.lit("1998-08-02").cast("date")).select("o_orderkey", "suppressed")


@query("audit_chain", """
WITH RECURSIVE e AS (
  SELECT user_id, ts::DATE AS day, event_id, event_type, row_number() OVER (PARTITION BY user_id, ts::DATE ORDER BY ts, event_id) AS k FROM events
), c AS (
  SELECT user_id, day, event_id, k, sha256(event_type) AS chain_hash FROM e WHERE k = 1
  UNION ALL SELECT e.user_id, e.day, e.event_id, e.k, sha256(c.chain_hash || e.event_type) FROM e JOIN c ON e.user_id = c.user_id AND e.day = c.day AND e.k = c.k + 1
)
SELECT user_id, event_id, chain_hash FROM c
""")
def audit_chain(spark, sf_dir):
    """A chain for each user and day, so that no chain grows without bound."""
    rows = load(spark, sf_dir, "events").withColumn("stream", F.struct("user_id", F.col("ts").cast("date").alias("day")))
    return OP.audit_chain(rows, "stream", ["ts", "event_id"], "event_type").select("stream.user_id", "event_id", "chain_hash")


@query("usage_quantiles", "SELECT event_type, count(*) AS requests, round(avg((value > 50)::INT), 6) AS alert_rate, true AS p50_ok, true AS p95_ok, true AS p99_ok FROM events GROUP BY 1")
def usage_quantiles(spark, sf_dir):
    """Usage of the whole period from sketches by day; each quantile is held against the exact rank of its value."""
    events = load(spark, sf_dir, "events").withColumn("alert", F.col("value") > 50)
    days = settled(OP.latency_sketches(events, ["event_type"], "value", F.col("ts").cast("date")), "usage")
    whole = OP.usage_of(days, ["event_type"])
    names = {"p50": 0.5, "p95": 0.95, "p99": 0.99}
    near = lambda c, q: ((F.sum((F.col("value") < F.col(c)).cast("long")) / F.count("*") <= q + 0.01) & (F.sum((F.col("value") <= F.col(c)).cast("long")) / F.count("*") >= q - 0.01)).alias(f"{c}_ok")
    held = events.select("event_type", "value").join(whole, "event_type").groupBy("event_type", "requests", "alert_rate")
    return held.agg(*[near(c, q) for c, q in names.items()])


@query("audit_roots", """
WITH RECURSIVE t AS (
  SELECT ts::DATE AS day, 0 AS level, row_number() OVER (PARTITION BY ts::DATE ORDER BY ts, event_id) - 1 AS place, sha256('leaf' || event_type) AS digest, count(*) OVER (PARTITION BY ts::DATE) AS total FROM events
  UNION ALL
  SELECT day, level + 1, place // 16, sha256('node' || string_agg(digest, '' ORDER BY place)), (total + 15) // 16 FROM t WHERE total > 1 GROUP BY day, level, place // 16, total
)
SELECT day, digest AS root, (SELECT count(*) FROM events WHERE ts::DATE = t.day) AS n FROM t WHERE total = 1
""")
def audit_roots(spark, sf_dir):
    """A tree of each day's events; no stream is folded in one row."""
    rows = load(spark, sf_dir, "events")
    return OP.audit_roots(OP.audit_tree(rows, F.col("ts").cast("date"), ["ts", "event_id"], "event_type"))


@query("audit_proofs", "SELECT ts::DATE AS day, count(*) AS n, true AS verified, false AS forged FROM events GROUP BY 1")
def audit_proofs(spark, sf_dir):
    """Every event proves that it belongs to its day, and none does with another payload."""
    tree = OP.audit_tree(load(spark, sf_dir, "events"), F.col("ts").cast("date"), ["ts", "event_id"], "event_type")
    roots, proofs = OP.audit_roots(tree), OP.audit_proofs(tree, tree.filter("level = 0").select("day", "place"))
    held = OP.audit_verified(proofs, roots).drop("root").withColumnRenamed("verified", "held")
    # a proof is as long as its leaf is deep: both leaves are tried on it where it is made
    rows = OP.audit_verified(held.withColumn("leaf", F.sha2(F.concat(F.lit("leaf forged"), "leaf"), 256)), roots)
    return rows.groupBy("day").agg(F.count("*").alias("n"), F.every("held").alias("verified"), F.some("verified").alias("forged"))


@query("stream_suppression", """
WITH RECURSIVE e AS (
  SELECT user_id, ts, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_type) AS k FROM events
), c AS (
  SELECT user_id, ts, event_type, k, event_type AS said, ts + INTERVAL 2 DAY AS until, false AS suppressed FROM e WHERE k = 1
  UNION ALL
  SELECT e.user_id, e.ts, e.event_type, e.k, CASE WHEN s THEN said ELSE e.event_type END, CASE WHEN s THEN until ELSE e.ts + INTERVAL 2 DAY END, s
  FROM (SELECT e.*, said, until, said = e.event_type AND e.ts <= until AS s FROM e JOIN c ON e.user_id = c.user_id AND e.k = c.k + 1) e
)
SELECT user_id, ts, event_type, suppressed FROM c
""")
def stream_suppression(spark, sf_dir):
    """The events as a stream of alerts of each user, of which like ones within two days are suppressed."""
    schema = load(spark, sf_dir, "events").schema
    # a stream reads folders: the table by a pattern that it alone fits
    rows = spark.readStream.schema(schema).parquet(f"{sf_dir}/event[s].parquet").withColumn("at", F.col("ts").cast("timestamp"))
    path = f"{shared_folder(spark)}/suppressed-{uuid.uuid4().hex}"
    rescreen.run_to(rescreen.suppress_repeats(rows, ["user_id"], "at", "event_type", 2), path, path + "-state")
    return spark.read.parquet(path).select("user_id", F.col("at").cast("timestamp_ntz").alias("ts"), "event_type", "suppressed")


@query("usage_windows", "SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def usage_windows(spark, sf_dir):
    out = rescreen.alert_rates(load(spark, sf_dir, "events"))
    return out.withColumn("day", F.col("day").cast("timestamp_ntz"))


# ---------------------------------------------------------------- sources


@query("profile_customer", """
SELECT 'c_custkey' AS path, 1.0::DOUBLE AS coverage, count(DISTINCT c_custkey) AS "distinct", min(c_custkey::VARCHAR) AS sample FROM customer
UNION ALL SELECT 'c_name', 1.0, count(DISTINCT c_name), min(c_name) FROM customer
UNION ALL SELECT 'c_mktsegment', 1.0, count(DISTINCT c_mktsegment), min(c_mktsegment) FROM customer
""")
def profile_customer(spark, sf_dir):
    return adapters.profile(load(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment"), approximate=False)


@query("mapped_source", "SELECT upper(s_name) AS PRIMARY_NAME, s_nationkey AS COUNTRY, 'SUPPLIERS' AS LIST_SOURCE FROM supplier")
def mapped_source(spark, sf_dir):
    bindings = [("PRIMARY_NAME", "s_name", "UPPER", None), ("COUNTRY", "s_nationkey", "RENAME", None), ("LIST_SOURCE", None, "CONSTANT", "SUPPLIERS")]
    return adapters.mapped(load(spark, sf_dir, "supplier"), bindings)


@query("list_sources", """
SELECT 'SUPPLIERS' AS LIST_SOURCE, upper(s_name) AS PRIMARY_NAME, s_nationkey::BIGINT AS COUNTRY, NULL AS ENTITY_TYPE FROM supplier
UNION ALL SELECT 'CUSTOMERS', trim(c_name), c_nationkey::BIGINT, c_mktsegment FROM customer
UNION ALL SELECT 'PARTS', p_name, NULL, NULL FROM part
""")
def list_sources(spark, sf_dir):
    """Three sources by their adapters, as one list."""
    country = lambda rows, c: rows.withColumn(c, F.col(c).cast("long"))
    sources = {
        "SUPPLIERS": (adapters.bound([("PRIMARY_NAME", "s_name", "UPPER", None), ("COUNTRY", "s_nationkey", "RENAME", None)]), country(load(spark, sf_dir, "supplier"), "s_nationkey")),
        "CUSTOMERS": (adapters.bound([("PRIMARY_NAME", "c_name", "TRIM", None), ("COUNTRY", "c_nationkey", "RENAME", None), ("ENTITY_TYPE", "c_mktsegment", "RENAME", None)]), country(load(spark, sf_dir, "customer"), "c_nationkey")),
        "PARTS": (adapters.bound([("PRIMARY_NAME", "p_name", "RENAME", None)]), load(spark, sf_dir, "part")),
    }
    return adapters.canonical(sources).select("LIST_SOURCE", "PRIMARY_NAME", "COUNTRY", "ENTITY_TYPE")


@query("strided_sample", "SELECT c_custkey FROM customer WHERE (c_custkey + 1) % 7 = 0 AND c_custkey + 1 <= 1000")
def strided_sample(spark, sf_dir):
    rows = load(spark, sf_dir, "customer").withColumn("ordinal", F.col("c_custkey") + 1)
    return FX.strided(rows, "ordinal", 7, 1000).select("c_custkey")


#: The customers as a delivery: every 97th line is broken, every 89th record has no name.
DELIVERY = """
WITH d AS (
  SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS ordinal, c_custkey % 97 = 5 AS broken, c_custkey % 89 = 7 AS nameless FROM customer
)
"""


def _delivery(spark, sf_dir):
    """A table written as JSON lines in several files, by key, and read again as a feed."""
    key = F.col("c_custkey")
    record = F.to_json(F.struct("c_custkey", F.when(key % 89 != 7, F.col("c_name")).alias("c_name"), "c_nationkey"))
    line = F.when(key % 97 == 5, F.concat(F.left(record, F.length(record) - 9), F.lit("}"))).otherwise(record)
    rows = load(spark, sf_dir, "customer").repartitionByRange(5, "c_custkey").sortWithinPartitions("c_custkey")
    path = f"{shared_folder(spark)}/delivery-{uuid.uuid4().hex}"
    rows.select(line.alias("value")).write.text(path)
    schema = T.StructType().add("c_custkey", "long").add("c_name", "string").add("c_nationkey", "integer")
    return LN.parsed(LN.lined(spark, path), schema, "json")


@query("feed_sample", DELIVERY + "SELECT c_custkey, ordinal FROM d WHERE ordinal % 7 = 0 AND ordinal <= 1000 AND NOT broken")
def feed_sample(spark, sf_dir):
    """Every seventh record by its place in the feed, over several files and splits."""
    return FX.strided(_delivery(spark, sf_dir).filter("_corrupt_record is null"), "ordinal", 7, 1000).select("c_custkey", "ordinal")


@query("feed_quarantine", DELIVERY + "SELECT ordinal, CASE WHEN broken THEN 'MALFORMED' ELSE 'MISSING_C_NAME' END AS reason FROM d WHERE broken OR nameless")
def feed_quarantine(spark, sf_dir):
    """Lines that are no records or lack a name; each names its file and line, which tell the place in the feed."""
    rows = _delivery(spark, sf_dir)
    return LN.quarantined(rows, ("c_name",)).join(rows.select("file", "line", "ordinal"), ["file", "line"]).select("ordinal", "reason")


def _records(spark, sf_dir):
    """Customers as nested records with their orders."""
    each = F.array_sort(F.collect_list(F.struct("o_orderkey", F.col("o_orderstatus").alias("status"), F.when(F.col("o_orderkey") % 3 == 0, F.split("o_orderpriority", "-")).alias("tags"))))
    orders = load(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(each.alias("orders"))
    rows = load(spark, sf_dir, "customer").join(orders, "c_custkey", "left")
    person = F.struct(F.when(F.col("c_custkey") % 4 != 0, F.col("c_name")).alias("name"), F.col("c_nationkey").alias("nation"))
    return rows.select("c_custkey", person.alias("person"), "c_mktsegment", "orders")


RECORDS = """
WITH o AS (
  SELECT o_custkey, o_orderkey, o_orderstatus AS status, CASE WHEN o_orderkey % 3 = 0 THEN string_split(o_orderpriority, '-') END AS tags FROM orders
), v AS (
  SELECT 'c_custkey' AS path, c_custkey, c_custkey::VARCHAR AS v FROM customer UNION ALL SELECT 'person.name', c_custkey, c_name FROM customer WHERE c_custkey % 4 <> 0
  UNION ALL SELECT 'person.nation', c_custkey, c_nationkey::VARCHAR FROM customer UNION ALL SELECT 'c_mktsegment', c_custkey, c_mktsegment FROM customer
  UNION ALL SELECT 'orders[].o_orderkey', o_custkey, o_orderkey::VARCHAR FROM o WHERE o_custkey IN (SELECT c_custkey FROM customer) UNION ALL SELECT 'orders[].status', o_custkey, status FROM o WHERE o_custkey IN (SELECT c_custkey FROM customer)
  UNION ALL SELECT 'orders[].tags[]', o_custkey, unnest(tags) FROM o WHERE o_custkey IN (SELECT c_custkey FROM customer)
)
"""


@query("profile_nested", RECORDS + """
SELECT path, (SELECT count(*) FROM customer) AS records, count(DISTINCT c_custkey) AS filled, count(*) AS n, min(v) AS least, max(v) AS greatest,
  CASE WHEN count(DISTINCT v) <= 100 THEN count(DISTINCT v) END AS "distinct" FROM v GROUP BY path
""")
def profile_nested(spark, sf_dir):
    """Nested records by path, arrays included, from the profiles of four loads; distinct values where few, whose sketch is exact."""
    rows = _records(spark, sf_dir)
    loads = None
    for k in range(4):
        part = PF.profile(rows.filter(F.col("c_custkey") % 4 == k), f"load-{k}")
        loads = part if loads is None else loads.unionByName(part)
    whole = PF.told(PF.united(loads)).filter("path <> '$'")
    return whole.select("path", "records", "filled", "n", "least", "greatest", F.when(F.col("distinct") <= 100, F.col("distinct")).alias("distinct"))


@query("profile_changes", RECORDS + """
, w AS (
  SELECT path, c_custkey % 4 AS load, count(DISTINCT c_custkey) AS filled FROM v WHERE c_custkey % 4 < 2 GROUP BY ALL
), n AS (
  SELECT c_custkey % 4 AS load, count(*) AS records FROM customer GROUP BY 1
), c AS (
  SELECT path, load, round(filled / records::DOUBLE, 6) AS coverage FROM w JOIN n USING (load)
)
SELECT path, CASE WHEN a.coverage IS NULL THEN 'NEW' WHEN b.coverage IS NULL THEN 'GONE' WHEN b.coverage - a.coverage < -0.05 THEN 'FILLS_LESS' WHEN b.coverage - a.coverage > 0.05 THEN 'FILLS_MORE' ELSE 'SAME' END AS change
FROM (SELECT * FROM c WHERE load = 0) a FULL JOIN (SELECT * FROM c WHERE load = 1) b USING (path)
""")
def profile_changes(spark, sf_dir):
    """What differs between the profiles of two loads."""
    rows = _records(spark, sf_dir)
    one, two = (PF.profile(rows.filter(F.col("c_custkey") % 4 == k), str(k)) for k in (0, 1))
    return PF.compared(one, two).select("path", "change")
