"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

from .licences import TEMPLATES, THRESHOLD
from .near_dedup import DEN, NUM
from .quality_rules import POLICIES, CURRENT, RULES, SYMBOLS, mask
from .url_filter import RULES as URL_RULES

_WORD = r"[^\x20\x09-\x0D]+"
_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

OP1 = """
WITH p AS (SELECT page_id, coalesce(octet_length(encode(html)), 0) AS n, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT d, min(page_id) AS m FROM p WHERE n >= 100 GROUP BY d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
       CASE WHEN m IS NOT NULL AND page_id <> m THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id <> m THEN m END AS refers_to
FROM p LEFT JOIN f USING (d)
"""

_OP3_WITH = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS x FROM documents),
w AS (SELECT doc_id, x, regexp_extract_all(x, '{_WORD}') AS ws,
             list_filter(string_split(x, chr(10)), lambda l: length(translate(l, {_BLANKS}, '')) > 0) AS lines FROM t),
tri AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM w, unnest(range(1, len(ws) - 1)) AS u(i)),
rep AS (SELECT doc_id, i FROM tri QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
cov AS (SELECT doc_id, count(DISTINCT i + k) AS r FROM rep, (VALUES (0), (1), (2)) AS o(k) GROUP BY doc_id),
m AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(translate(x, {_BLANKS}, '')) AS BIGINT) AS word_chars,
             CAST(length(x) - length(translate(x, '{SYMBOLS}', '')) AS BIGINT) AS n_symbols, len(lines) AS n_lines,
             CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(r, 0) AS BIGINT) AS n_repeat_words
      FROM w LEFT JOIN cov USING (doc_id)),
b AS (SELECT *, {" + ".join(f"CASE WHEN {c} THEN {1 << k} ELSE 0 END" for k, c in enumerate(RULES.values()))} AS bits FROM m)
"""
OP3 = _OP3_WITH + f"""SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       bits & {mask(POLICIES["base_v1"])} <> 0 AS base_failed, bits & {mask(POLICIES[CURRENT])} = 0 AS kept, CAST(bits AS BIGINT) AS fail_bits
FROM b
"""

_PLAN = ", ".join(f"('{p}', '{r}', {mask(rules)}, {1 << list(RULES).index(r)})" for p, rules in POLICIES.items() for r in rules)
ABLATIONS = _OP3_WITH + f"""SELECT policy, rule, count(*) AS docs, count(*) FILTER (bits & every = 0) AS kept, count(*) FILTER (bits & (every - bit) = 0) AS kept_without,
  count(*) FILTER (bits & every = bit) AS only_this FROM b, (VALUES {_PLAN}) AS p(policy, rule, every, bit) GROUP BY policy, rule
"""


def _url_case(column: int) -> str:
    whens = []
    for what, text in sorted(URL_RULES, key=lambda r: -len(r[1])):
        h, slash, p = text.partition("/")
        whens.append(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{slash + p}') THEN '{(text, what)[column]}'")
    return "CASE " + " ".join(whens) + " END"


OP4 = f"""
WITH u AS (SELECT page_id, url, translate(coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 1), ''), {_LOWER}) AS host,
                  coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 2), '') AS path,
                  coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)(\\?[^#]*)?', 3), '') AS query FROM pages),
c AS (SELECT *, CASE WHEN regexp_replace(host, '^www\\.', '') <> '' THEN
          regexp_replace(host, '^www\\.', '') || regexp_replace(path, '(\\.html|/)$', '')
          || regexp_replace(regexp_replace(query, '[?&]utm_[^&]*', '', 'g'), '^&', '?') END AS canon FROM u),
l AS (SELECT DISTINCT canon FROM c WHERE regexp_matches(url, '[?&]utm_') AND canon IS NOT NULL),
r AS (SELECT *, {_url_case(0)} AS rule, {_url_case(1)} AS ruled FROM c)
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN l.canon IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM r LEFT JOIN l ON r.canon = l.canon
"""

OP5 = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_LOWER}), '{_WORD}') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS g FROM d, unnest(range(1, greatest(len(ws) - 3, 2))) AS u(i) WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
k AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE {DEN} * c >= {NUM} * (nx.n + ny.n - c)),
e AS (SELECT x, y FROM k UNION ALL SELECT y, x FROM k),
reach(a, b) AS (SELECT doc_id, doc_id FROM d UNION SELECT a, y FROM reach JOIN e ON b = x)
SELECT a AS doc_id, CAST(coalesce(max(n.n), 0) AS BIGINT) AS n_shingles, min(b) AS component_id, a = min(b) AS kept
FROM reach LEFT JOIN n ON n.doc_id = a GROUP BY a
"""

_TERMS = "list_filter(list_transform(regexp_extract_all(lower({}), '[a-z0-9.-]+'), lambda x: regexp_replace(x, '^[.-]+|[.-]+$', '', 'g')), lambda x: x <> '')"
_MARKED = r"regexp_matches(lower(x), '(^|[^a-z])(license|licensed|licence|copyright|redistribution|cc)([^a-z]|$)')"

OP8 = f"""
WITH f AS (SELECT doc_id, text, concat_ws('/', source, lang, CAST(doc_id // 100 AS VARCHAR),
                  CASE WHEN doc_id % 100 = 0 THEN 'LICENSE' ELSE CAST(doc_id AS VARCHAR) || '.txt' END) AS path FROM documents),
g AS (SELECT *, regexp_replace(path, '/[^/]*$', '') AS dir FROM f),
l AS (SELECT path, unnest(list_distinct(list_filter(string_split(text, chr(10)), lambda x: {_MARKED}))) AS line FROM g),
kinds AS (SELECT line, count(*) AS n FROM l GROUP BY line),
total AS (SELECT count(*) AS total FROM l),
raw AS (SELECT line, n, unnest({_TERMS.format("line")}) AS term FROM kinds),
vec AS (SELECT line, n, term, count(*) AS tf FROM raw GROUP BY ALL),
df AS (SELECT term, sum(n) AS df FROM vec GROUP BY term),
tpl(licence, t) AS (VALUES {", ".join(f"('{k}', '{v}')" for k, v in sorted(TEMPLATES.items()))}),
traw AS (SELECT licence, unnest({_TERMS.format("t")}) AS term FROM tpl),
tv AS (SELECT licence, term, count(*) * (ln((1.0 + (SELECT total FROM total)) / (1 + coalesce(any_value(df), 0))) + 1) AS tw FROM traw LEFT JOIN df USING (term) GROUP BY licence, term),
v AS (SELECT line, term, tf * (ln((1.0 + (SELECT total FROM total)) / (1 + df)) + 1) AS w FROM vec JOIN df USING (term)),
dots AS (SELECT line, licence, sum(w * tw) AS dot FROM v JOIN tv USING (term) GROUP BY ALL),
vn AS (SELECT line, sqrt(sum(w * w)) AS ln FROM v GROUP BY line),
tn AS (SELECT licence, sqrt(sum(tw * tw)) AS tn FROM tv GROUP BY licence),
sc AS (SELECT line, licence, round(dot / (ln * tn), 9) AS cosine FROM dots JOIN vn USING (line) JOIN tn USING (licence) WHERE round(dot / (ln * tn), 9) >= {THRESHOLD}),
own AS (SELECT path, licence, cosine FROM l JOIN sc USING (line) QUALIFY row_number() OVER (PARTITION BY path ORDER BY cosine DESC, licence) = 1),
dirs AS (SELECT DISTINCT dir AS from_dir, licence AS dir_licence FROM own JOIN g USING (path) WHERE regexp_extract(path, '[^/]*$') = 'LICENSE'),
near AS (SELECT DISTINCT g.dir, from_dir, dir_licence FROM g JOIN dirs ON g.dir = from_dir OR starts_with(g.dir, from_dir || '/')
         QUALIFY row_number() OVER (PARTITION BY g.dir ORDER BY length(from_dir) DESC) = 1)
SELECT doc_id, path, coalesce(licence, dir_licence) AS licence, round(cosine, 6) AS cosine,
       CASE WHEN licence IS NOT NULL THEN 'own' WHEN dir_licence IS NOT NULL THEN 'inherited' END AS origin,
       CASE WHEN licence IS NULL THEN from_dir END AS from_dir
FROM g LEFT JOIN own USING (path) LEFT JOIN near ON near.dir = g.dir
"""

_CRC_TABLE = ("(SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, _: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) ORDER BY i) AS tab "
              "FROM (SELECT CAST(unnest(range(256)) AS BIGINT) AS i))")
_CRC = ("xor(list_reduce([4294967295] || list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)), "
        "lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1])), 4294967295)")

OP11 = f"""
WITH raw AS (SELECT conv_id, turn, length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '') AS t, strlen(coalesce(text, '')) AS b
             FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list({{t: t, b: b}} ORDER BY turn NULLS FIRST, md5(t)) AS ts FROM raw GROUP BY conv_id),
heads AS (SELECT own.*, CAST({_CRC} % 9 AS BIGINT) AS h FROM own, {_CRC_TABLE}),
c AS (SELECT a.conv_id, list_concat(coalesce(b.ts[:a.h], []), a.ts[a.h + 1:]) AS ts FROM heads a LEFT JOIN own b ON b.conv_id = a.conv_id - a.conv_id % 5),
m AS (SELECT conv_id, d AS depth, ts[:d] AS k, len(ts) = d AS ends FROM c, unnest(range(len(ts) + 1)) AS u(d)),
n AS (SELECT k, depth, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256,
             CASE WHEN depth = 0 THEN 0 ELSE (count(*) - 1) * any_value(k[depth].b) END AS saved FROM m GROUP BY k, depth),
kids AS (SELECT k[:depth - 1] AS k, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1),
full_n AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN kids USING (k)),
sums AS (SELECT k[:d] AS k, sum(saved) AS saved_tokens, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves FROM full_n, unnest(range(depth + 1)) AS u(d) GROUP BY 1)
SELECT a.conv_id, CAST(a.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, a.n_convs, CAST(a.n_children AS BIGINT) AS n_children,
       CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, a.ends_sha256
FROM full_n a JOIN sums USING (k) LEFT JOIN full_n p ON p.k = a.k[:a.depth - 1] AND a.depth > 0
"""

ORACLES: dict[str, str] = {"op1_warc": OP1, "op3_quality_rules": OP3, "op4_url_filter": OP4, "op5_minhash": OP5, "op8_licences": OP8, "quality_ablations": ABLATIONS, "op11_prefix_trie": OP11}
