"""DuckDB SQL for the text operators that SQL can express."""

from __future__ import annotations

from . import collocations, linededup, quality, secrets

_ESC = "{}"
for _plain, _hidden in (("\\", "\\\\"), ("[INST]", "[\\INST]"), ("[/INST]", "[\\/INST]"), ("</s>", "<\\/s>")):
    _ESC = f"replace({_ESC}, '{_plain}', '{_hidden}')"

CHAT = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
r AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS rn,
    count(*) OVER (PARTITION BY conv_id) AS n,
    17 + length({_ESC.format("role")}) + length({_ESC.format("text")}) AS chars
  FROM t),
c AS (SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY rn) AS upto FROM r)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY rn)) AS turns_sha256,
  sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY rn), '')) AS loss_sha256,
  sum(CASE WHEN role = 'assistant' OR rn = n THEN upto ELSE 0 END)::BIGINT AS formatted_chars
FROM c GROUP BY conv_id
"""

_CELL = "(({0} >> greatest(length(bin({0})) - 6, 0)) << greatest(length(bin({0})) - 6, 0))"
_METRICS = {
    "symbols_pm": "CASE WHEN n_words > 0 THEN 1000 * n_symbols // n_words ELSE 0 END",
    "dup_lines_pm": "CASE WHEN n_lines > 0 THEN 1000 * n_dup_lines // n_lines ELSE 0 END",
    "repeats_pm": "CASE WHEN n_words > 0 THEN 1000 * n_repeat_words // n_words ELSE 0 END",
    "word_len_c": "CASE WHEN n_words > 0 THEN 100 * word_chars // n_words ELSE 0 END",
}
_FENCE = ["CASE metric " + " ".join(f"WHEN '{m}' THEN {p[k]}" for m, p in quality.FENCES.items()) + " END" for k in range(3)]
_INSIDE = " AND ".join(
    f"coalesce((SELECT {m} <= hi FROM fence f WHERE f.lang = m.lang AND f.source = m.source AND f.metric = '{m}'), TRUE)" for m in quality.FENCES
)
QUALITY = f"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce('=' || lang, '') AS lang, coalesce('=' || source, '') AS source, coalesce(text, '') AS text FROM documents),
w AS (
  SELECT rid, doc_id, lang, source, list_filter(string_split_regex(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls,
    length(translate(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) AS word_chars,
    length(text) - length(translate(text, '{quality.SYMBOLS}', '')) AS n_symbols
  FROM d),
g AS (
  SELECT rid, unnest(range(1, len(ws) - 3)) AS i, unnest(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(list_slice(ws, i, i + 4), ' '))) AS s
  FROM w WHERE len(ws) >= 5),
k AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, s) AS n FROM g),
f AS (SELECT rid, least(5, i - coalesce(lag(i) OVER (PARTITION BY rid ORDER BY i), -9)) AS new FROM k WHERE n > 1),
rep AS (SELECT rid, sum(new)::BIGINT AS n_repeat_words FROM f GROUP BY rid),
b AS (
  SELECT doc_id, lang, source, len(ws)::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
    len(ls)::BIGINT AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM w LEFT JOIN rep USING (rid)),
m AS (
  SELECT *, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed, {", ".join(f"({e})::BIGINT AS {m}" for m, e in _METRICS.items())} FROM b),
cells AS ({" UNION ALL ".join(f"SELECT lang, source, '{m}' AS metric, {_CELL.format(m)} AS cell FROM m WHERE NOT base_failed" for m in quality.FENCES)}),
lv AS (
  SELECT lang, source, metric, cell FROM cells
  UNION ALL SELECT lang, '*', metric, cell FROM cells
  UNION ALL SELECT '*', '*', metric, cell FROM cells),
h AS (SELECT lang, source, metric, cell, count(*) AS n FROM lv GROUP BY ALL),
r AS (
  SELECT *, sum(n) OVER (PARTITION BY lang, source, metric ORDER BY cell) AS cum, sum(n) OVER (PARTITION BY lang, source, metric) AS total FROM h),
q AS (
  SELECT lang, source, metric, max(total) AS total,
    min(CASE WHEN cum * 100 >= total * ({_FENCE[0]}) THEN cell END) AS low, min(CASE WHEN cum * 100 >= total * ({_FENCE[1]}) THEN cell END) AS high
  FROM r GROUP BY ALL),
e AS (SELECT lang, source, metric, total, high + greatest(({_FENCE[2]}) * (high - low), 1) AS hi, low - greatest(({_FENCE[2]}) * (high - low), 1) AS lo FROM q),
fence AS (
  SELECT g.lang, g.source, g.metric,
    CASE WHEN g.total >= {quality.MIN_SUPPORT} THEN g.hi WHEN l.total >= {quality.MIN_SUPPORT} THEN l.hi ELSE a.hi END AS hi,
    CASE WHEN g.total >= {quality.MIN_SUPPORT} THEN g.lo WHEN l.total >= {quality.MIN_SUPPORT} THEN l.lo ELSE a.lo END AS lo
  FROM e g JOIN e l ON l.lang = g.lang AND l.source = '*' AND l.metric = g.metric JOIN e a ON a.lang = '*' AND a.metric = g.metric
  WHERE g.source <> '*')
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND {_INSIDE}
  AND coalesce((SELECT word_len_c >= lo FROM fence f WHERE f.lang = m.lang AND f.source = m.source AND f.metric = 'word_len_c'), TRUE) AS kept
FROM m
"""


def _spans(pattern: str, group: int = 0, least: int = 0) -> str:
    p = pattern.replace("'", "''")
    found, gaps = f"regexp_extract_all(text, '{p}')", f"regexp_split_to_array(text, '{p}')"
    at = "coalesce(list_sum(list_transform(g[1:i], lambda y: length(y))), 0) + coalesce(list_sum(list_transform(m[1:i-1], lambda y: length(y))), 0)"
    second = f"regexp_extract_all(text, '{p}', {group})" if group else "m"
    each = f"list_transform(range(1, len(m) + 1), lambda i: {{'s': ({at})::BIGINT, 'e': ({at} + length(m[i]))::BIGINT, 'n': length(x[i])}})"
    return f"(SELECT list_filter({each}, lambda z: z.n >= {least}) FROM (SELECT {found} AS m, {gaps} AS g, {second} AS x))"


_TAG = "list_transform({0}, lambda z: {{'s': z.s, 'k': {1}, 'e': z.e}})"
_TEXT = "list_transform({0}, lambda z: (['assign', 'access', 'hex', 'linked'])[z.k + 1] || ':' || z.s || ':' || z.e)"
SECRETS = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
p AS (
  SELECT doc_id, {_spans(secrets.ASSIGN, 2, 6)} AS assign, {_spans(secrets.ACCESS)} AS access, {_spans(secrets.HEX)} AS hex,
    {_spans(secrets.LOGIN, 2, 1)} AS login, {_spans(secrets.ENDPOINT)} AS endpoint,
    list_filter({_spans(secrets.WEAK)}, lambda z: regexp_matches(substring(text, z.s + 1, z.e - z.s), '[0-9]')
      AND regexp_matches(substring(text, z.s + 1, z.e - z.s), '[a-z]') AND regexp_matches(substring(text, z.s + 1, z.e - z.s), '[A-Z]')) AS weak
  FROM d),
q AS (
  SELECT *, list_filter(weak, lambda w:
    len(list_filter(flatten([assign, access, hex, endpoint]), lambda b: b.s < w.e AND w.s < b.e)) = 0
    AND len(list_filter(flatten([access, login, endpoint]), lambda o: o.s >= w.s - {secrets.SCOPE} AND o.s <= w.e + {secrets.SCOPE} AND (o.e <= w.s OR o.s >= w.e))) > 0) AS linked
  FROM p),
t AS (
  SELECT doc_id, len(assign) AS n_assign, len(access) AS n_access, len(hex) AS n_hex,
    list_sort(flatten([{_TAG.format("assign", 0)}, {_TAG.format("access", 1)}, {_TAG.format("hex", 2)}])) AS base,
    list_sort(flatten([{_TAG.format("assign", 0)}, {_TAG.format("access", 1)}, {_TAG.format("hex", 2)}, {_TAG.format("linked", 3)}])) AS whole
  FROM q)
SELECT doc_id, n_assign, n_access, n_hex, sha256(coalesce(array_to_string({_TEXT.format("base")}, ','), '')) AS base_sha256,
  coalesce(array_to_string({_TEXT.format("whole")}, ','), '') AS spans
FROM t
"""

LINES = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, text, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT rid, unnest(range(len(ls))) AS i, unnest(ls) AS line FROM d),
w AS (
  SELECT rid, i, ('0x' || substr(md5(line), 1, 7))::BIGINT AS h,
    row_number() OVER (PARTITION BY rid ORDER BY i) - 1 AS k, count(*) OVER (PARTITION BY rid) AS m
  FROM l WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')),
x AS (SELECT *, (h * {linededup.BASE} + lead(h) OVER (PARTITION BY rid ORDER BY k)) % {linededup.MODULUS} % {linededup.BOUNDARY} AS r FROM w WHERE m >= {linededup.MIN_LINES}),
y AS (
  SELECT *, lag(r) OVER o AS p, k >= m - 2 OR r <> 1 AS e0, k >= m - 3 OR lead(r) OVER o <> 1 AS e1,
    lead(i, 1) OVER o AS i1, lead(i, 2) OVER o AS i2, lead(i, 3) OVER o AS i3
  FROM x WINDOW o AS (PARTITION BY rid ORDER BY k)),
t AS (
  SELECT rid, doc_id, i AS no, CASE WHEN e0 THEN i1 WHEN e1 THEN i2 ELSE i3 END AS last, array_to_string(ls[i + 1 : last + 1], chr(10)) AS body, struct_pack(doc_id := doc_id, no := i) AS place
  FROM y JOIN d USING (rid) WHERE k < m - 1 AND (k = 0 OR k = m - 2 OR r <> 0 OR p = 0)),
o AS (SELECT body, min(place) AS first FROM t GROUP BY body HAVING count(*) > 1),
r AS (SELECT rid, no, unnest(range(no, last + 1)) AS i FROM t JOIN o USING (body) WHERE place > first),
z AS (SELECT rid, list(DISTINCT i) AS gone, count(DISTINCT no) AS chunks FROM r GROUP BY rid)
SELECT doc_id, CASE WHEN text IS NULL THEN 0 ELSE len(ls) END::BIGINT AS n_lines, coalesce(len(gone), 0)::BIGINT AS n_removed_lines, coalesce(chunks, 0)::BIGINT AS n_removed_chunks,
  sha256(CASE WHEN gone IS NULL THEN coalesce(text, '') ELSE array_to_string(list_filter(ls, lambda x, j: NOT list_contains(gone, j - 1)), chr(10)) END) AS kept_sha256
FROM d LEFT JOIN z USING (rid)
"""

COLLOCATIONS = f"""
WITH d AS (
  SELECT row_number() OVER () AS rid, coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM documents),
w AS (SELECT lang, list_filter(string_split_regex(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS ws FROM d),
n AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM w GROUP BY lang),
k AS (SELECT unnest(range(1, {collocations.LONGEST + 1})) AS k),
o AS (SELECT lang, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: ws[i : i + k - 1])) AS g FROM w, k WHERE len(ws) >= k),
f AS (SELECT lang, g, count(*) AS a FROM o GROUP BY lang, g HAVING count(*) >= {collocations.LEAST}),
longer AS (SELECT lang, a, unnest([g[2:], g[:-2]]) AS g FROM f WHERE len(g) > 2),
covered AS (SELECT DISTINCT f.lang, f.g FROM f JOIN longer x ON f.lang = x.lang AND f.g = x.g AND 100 * x.a >= 100 * f.a),
c AS (SELECT lang, g, a, unnest(range(1, len(g))) AS cut FROM f ANTI JOIN covered USING (lang, g) WHERE len(g) > 1),
s AS (
  SELECT c.lang, c.g, c.a, cut, l.a AS l, r.a AS r, n, (1000 * c.a::HUGEINT * n::HUGEINT // (l.a::HUGEINT * r.a::HUGEINT))::BIGINT AS score
  FROM c JOIN n USING (lang) JOIN f l ON l.lang = c.lang AND l.g = c.g[:cut] JOIN f r ON r.lang = c.lang AND r.g = c.g[cut + 1 :]),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, cut) = 1),
p AS (SELECT *, array_to_string(g, ' ') AS phrase FROM b)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase)::BIGINT AS rank, phrase, a, l, r, n, score
FROM p QUALIFY rank <= {collocations.TOP}
"""

ORACLES = {"op2_quality_rules": QUALITY, "op3_chat_formatting": CHAT, "op6_secret_scan": SECRETS, "op10_line_dedup": LINES, "op12_phrase_collocations": COLLOCATIONS}
