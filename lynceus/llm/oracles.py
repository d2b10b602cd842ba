"""DuckDB SQL for the operators that SQL can express, independent of how the operators work."""

from __future__ import annotations

from . import licenses, urlrules, warc

UPPER, LOWER = licenses.UPPER, licenses.LOWER


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def url_rules(host_rules: list[tuple[str, str]], patterns) -> str:
    """op3: every rule's own test, without an index."""
    rows = []
    for action, rule in host_rules:
        host, _, path = rule.partition("/")
        rows.append(f"({quoted(rule)}, {quoted(host)}, {quoted('/' + path)}, {quoted(action)})")
    tests = ", ".join(f"({quoted(p)}, {quoted(urlrules.compiled(p))}, {quoted(a)})" for p, a in patterns)
    return f"""
WITH u AS (
  SELECT page_id, url, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), a AS (
  SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host,
    substr(coalesce(rest, ''), length(regexp_extract(coalesce(rest, ''), '^[^/?#]*')) + 1) AS tail FROM u
), p AS (
  SELECT page_id, host, regexp_extract(tail, '^[^?#]*') AS path, host || regexp_extract(tail, '^[^#]*') AS address FROM a
), base AS (
  SELECT page_id, arg_max({{'rule': r.rule, 'action': r.action}}, length(r.rule)) AS b
  FROM p, (VALUES {", ".join(rows)}) AS r(rule, host, path, action)
  WHERE (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path) GROUP BY 1
), more AS (
  SELECT page_id, max(CASE WHEN t.action = 'allow' THEN {{'n': length(t.pattern), 'rule': t.pattern, 'action': t.action}} END) AS yes,
    max(CASE WHEN t.action = 'block' THEN {{'n': length(t.pattern), 'rule': t.pattern, 'action': t.action}} END) AS no
  FROM p, (VALUES {tests}) AS t(pattern, regex, action) WHERE regexp_matches(address, regex) GROUP BY 1
)
SELECT page_id, host, path, b.rule AS rule, coalesce(b.action, yes.action, no.action, 'allow') AS verdict,
  CASE WHEN b IS NULL THEN coalesce(yes.rule, no.rule) END AS pattern_rule
FROM p LEFT JOIN base USING (page_id) LEFT JOIN more USING (page_id)
"""


def license_scan(drift: int = 2, least: float = 0.6) -> str:
    """op4: templates' word pairs joined by their words, diagonals merged by gaps."""
    k = licenses.K
    rows = [(t, label, "true") for t, label in licenses.PHRASES] + [(t, label, "false") for t, label in licenses.NOTICES]
    values = ", ".join(f"({quoted(t)}, {quoted(label)}, {whole})" for t, label, whole in rows)
    return f"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
), t AS (
  SELECT template, label, whole, string_split(template, ' ') AS w FROM (VALUES {values}) AS v(template, label, whole)
), tg AS (
  SELECT template, label, whole, len(w) - {k - 1} AS n, i - 1 AS "at", w[i] AS a, w[i + 1] AS b FROM (SELECT *, unnest(range(1, len(w))) AS i FROM t)
), dg AS (
  SELECT doc_id, i - 1 AS pos, w[i] AS a, w[i + 1] AS b FROM (SELECT *, unnest(range(1, len(w))) AS i FROM d)
), diag AS (
  SELECT doc_id, template, label, whole, n, pos - "at" AS diagonal, list(DISTINCT "at") AS ats, min(pos) AS first FROM dg JOIN tg USING (a, b) GROUP BY ALL
), kept AS (
  SELECT *, CASE WHEN whole OR diagonal - lag(diagonal, 1, -1000000000) OVER q > {drift} THEN 1 ELSE 0 END AS apart
  FROM diag WHERE NOT whole OR len(ats) = n WINDOW q AS (PARTITION BY doc_id, template ORDER BY diagonal)
), runs AS (
  SELECT *, sum(apart) OVER (PARTITION BY doc_id, template ORDER BY diagonal) AS span FROM kept
), spans AS (
  SELECT doc_id, template, label, whole, len(list_distinct(flatten(list(ats)))) / n::DOUBLE AS share, min(first) AS first FROM runs GROUP BY doc_id, template, label, whole, n, span
), found AS (
  SELECT doc_id, count(*) FILTER (whole) AS n_base, min(first) FILTER (whole) AS first_word, max(first) FILTER (whole) AS last_word,
    array_to_string(list_sort(list(DISTINCT label) FILTER (whole)), ',') AS base_labels, array_to_string(list_sort(list(DISTINCT label)), ',') AS labels, max(share) AS score
  FROM spans WHERE share >= {least} GROUP BY 1
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0) AS score
FROM d LEFT JOIN found USING (doc_id)
"""


SUBSTRING = """
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents
), win AS (
  SELECT doc_id, i, array_to_string(words[i:i + 12], ' ') AS k FROM (SELECT *, unnest(range(1, len(words) - 11)) AS i FROM w)
), first AS (
  SELECT k, min(doc_id) AS least FROM win GROUP BY k
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM win JOIN first USING (k) WHERE least < doc_id
), word AS (
  SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS p FROM w
), kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS text, count(*) AS n FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY 1
)
SELECT doc_id, len(words)::BIGINT AS n_words, len(words)::BIGINT - coalesce(n, 0) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)
"""

CRLF = "chr(13) || chr(10)"
NAMES = "MAP {" + ", ".join(f"{quoted(k)}: {quoted(v)}" for k, v in warc.NAMED.items()) + "}"


def _decoded(x: str) -> str:
    """Each reference looked up once; what HTML does not know stays."""
    code = "CASE WHEN r[2] IN ('x', 'X') THEN ('0x' || r[3:])::BIGINT ELSE r[2:]::BIGINT END"
    number = f"CASE WHEN {code} BETWEEN 1 AND 1114111 AND NOT {code} BETWEEN 55296 AND 57343 THEN chr(({code})::INT) ELSE chr(65533) END"
    one = f"CASE WHEN r[1] = '#' THEN {number} ELSE coalesce(names[r], '&' || r || ';') END"
    found = f"[{one} for r in regexp_extract_all({x}, {quoted(warc.REFERENCE)}, 1)]"
    return f"list_reduce(list_concat([''], list_transform(list_zip(regexp_split_to_array({x}, {quoted(warc.REFERENCE)}), list_append({found}, '')), lambda z: z[1] || z[2])), lambda a, b: a || b)"


def _urn(*parts: str) -> str:
    h = f"md5(concat_ws(chr(10), {', '.join(parts)}))"
    return f"'<urn:uuid:' || concat_ws('-', substr({h}, 1, 8), substr({h}, 9, 4), '8' || substr({h}, 14, 3), '8' || substr({h}, 18, 3), substr({h}, 21, 12)) || '>'"


def _text(x: str) -> str:
    out = f"regexp_replace(regexp_replace({x}, {quoted(warc.UNSEEN)}, '', 'g'), '[ \\t\\r\\n\\f]+', ' ', 'g')"
    out = f"regexp_replace(regexp_replace({out}, {quoted(warc.BREAKS)}, chr(10), 'g'), '<[^>]*>', '', 'g')"
    out = f"regexp_replace({_decoded(out)}, ' *\\n[ \\n]*', chr(10), 'g')"
    return f"regexp_replace(regexp_replace({out}, ' +', ' ', 'g'), '^[ \\n]+|[ \\n]+$', '', 'g')"


WARC = f"""
WITH r AS (
  SELECT page_id, url, coalesce(html, '') AS payload, {_urn("'response'", "page_id::VARCHAR", "coalesce(url, '')", "coalesce(html, '')")} AS response,
    'HTTP/1.1 200 OK' || {CRLF} || 'Content-Type: text/html; charset=utf-8' || {CRLF} || 'Content-Length: ' || strlen(coalesce(html, '')) AS headers,
    {NAMES} AS names FROM pages
), i AS (
  SELECT *, {_urn("'metadata'", "response")} AS meta_id, {_urn("'conversion'", "response")} AS text_id,
    list_concat(list_concat(['title: ' || trim({_decoded("regexp_replace(regexp_extract(payload, '(?is)<title[^>]*>(.*?)</title', 1), '[ \\t\\r\\n\\f]+', ' ', 'g')")})],
      ['source-Content-Type: text/html; charset=utf-8', 'source-Content-Length: ' || strlen(payload)]),
      ['outlink: ' || {_decoded("x")} for x in [CASE WHEN y[1] IN ('"', chr(39)) THEN y[2:-2] ELSE y END for y in regexp_extract_all(payload, {quoted(warc.LINK)}, 1)]]) AS lines FROM r
), both_ AS (
  SELECT *, 'metadata' AS warc_type, meta_id AS record_id, text_id AS concurrent_to, 'application/warc-fields' AS content_type, array_to_string(lines, {CRLF}) || {CRLF} AS block FROM i
  UNION ALL SELECT *, 'conversion', text_id, meta_id, 'text/plain; charset=utf-8', {_text("payload")} FROM i
), m AS (
  SELECT *, strlen(block)::BIGINT AS content_length, 'sha256:' || sha256(block) AS block_digest, 'sha256:' || sha256(payload) AS payload_digest FROM both_
)
SELECT page_id, warc_type, record_id, response AS refers_to, concurrent_to, url AS target_uri, '2024-01-01T00:00:00Z' AS warc_date, content_type, content_length, block_digest, payload_digest, headers AS source_headers,
  sha256('WARC/1.1' || {CRLF} || 'WARC-Type: ' || warc_type || {CRLF} || 'WARC-Record-ID: ' || record_id || {CRLF} || 'WARC-Refers-To: ' || response || {CRLF} || 'WARC-Concurrent-To: ' || concurrent_to || {CRLF}
    || coalesce('WARC-Target-URI: ' || replace(replace(replace(replace(url, ' ', '%20'), chr(9), '%09'), chr(13), '%0D'), chr(10), '%0A') || {CRLF}, '') || 'WARC-Date: 2024-01-01T00:00:00Z' || {CRLF} || 'WARC-Payload-Digest: ' || payload_digest || {CRLF} || 'WARC-Block-Digest: ' || block_digest || {CRLF}
    || 'Content-Type: ' || content_type || {CRLF} || 'Content-Length: ' || content_length || {CRLF}) AS header_sha256
FROM m
"""


def _leaf(*values: str) -> str:
    return "sha256(" + " || ".join(f"coalesce(strlen({v}::VARCHAR)::VARCHAR || ':' || {v}::VARCHAR, '-')" for v in values) + ")"


#: CRC-32 by bits, of the decimal id.
CRC = "xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(str_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda r, i: CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END)))"

MERKLE = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, lang, {_leaf("doc_id", "source", "lang", "n_chars", "text")} AS leaf,
    CASE WHEN doc_id IS NOT NULL AND {CRC} % 3 = 0 THEN {_leaf("doc_id", "source", "lang", "n_chars", "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END AS tampered FROM documents
), l AS (
  SELECT *, coalesce('=' || lang, '') AS grp, row_number() OVER q - 1 AS pos FROM d WINDOW q AS (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf)
), t AS (
  SELECT grp, 0 AS level, pos, leaf AS digest, count(*) OVER (PARTITION BY grp) AS total FROM l
  UNION ALL
  SELECT grp, level + 1, pos // 8, sha256(string_agg(digest, '' ORDER BY pos)), (total + 7) // 8 FROM t WHERE total > 1 GROUP BY grp, level, pos // 8, total
), s AS (
  SELECT grp, digest AS subroot, row_number() OVER (ORDER BY grp) - 1 AS pos FROM t WHERE total = 1
), u AS (
  SELECT 0 AS level, pos, subroot AS digest, (SELECT count(*) FROM s) AS total FROM s
  UNION ALL
  SELECT level + 1, pos // 8, sha256(string_agg(digest, '' ORDER BY pos)), (total + 7) // 8 FROM u WHERE total > 1 GROUP BY level, pos // 8, total
), runs AS (
  SELECT grp, level, pos // 8 AS run, list(digest ORDER BY pos) AS digests FROM t WHERE total > 1 GROUP BY ALL
  UNION ALL SELECT NULL, level, pos // 8, list(digest ORDER BY pos) FROM u WHERE total > 1 GROUP BY ALL
), below AS (
  SELECT grp, pos AS leaf_pos, 0 AS level, pos, coalesce(tampered, leaf) AS folded, '' AS proof FROM l
  UNION ALL
  SELECT b.grp, leaf_pos, b.level + 1, pos // 8, sha256(array_to_string(digests[:pos % 8], '') || folded || array_to_string(digests[pos % 8 + 2:], '')), proof || array_to_string(digests[:pos % 8], '') || array_to_string(digests[pos % 8 + 2:], '')
  FROM below b JOIN runs r ON r.grp = b.grp AND r.level = b.level AND r.run = pos // 8
), above AS (
  SELECT b.grp, leaf_pos, 0 AS level, s.pos, folded, proof, subroot FROM (SELECT grp, leaf_pos, arg_max(folded, level) AS folded, arg_max(proof, level) AS proof FROM below GROUP BY ALL) b JOIN s USING (grp)
  UNION ALL
  SELECT a.grp, leaf_pos, a.level + 1, pos // 8, sha256(array_to_string(digests[:pos % 8], '') || folded || array_to_string(digests[pos % 8 + 2:], '')), proof || array_to_string(digests[:pos % 8], '') || array_to_string(digests[pos % 8 + 2:], ''), subroot
  FROM above a JOIN runs r ON r.grp IS NULL AND r.level = a.level AND r.run = pos // 8
), done AS (
  SELECT grp, leaf_pos AS pos, subroot, arg_max(folded, level) AS folded_root, sha256(arg_max(proof, level)) AS proof_sha256 FROM above GROUP BY ALL
)
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified
FROM l JOIN done USING (grp, pos), (SELECT digest AS root FROM u WHERE total = 1)
"""
