"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

from typeloom.llm import chat_format, line_dedup, url_filter

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_SPACE = r"[^\x20\x09-\x0D]+"


def _words(column: str, pattern: str) -> str:
    return f"regexp_extract_all(coalesce({_LOWER.format(column)}, ''), '{pattern}')"


DECONTAMINATE = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_words("text", _ALNUM)} AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item, {_words("text", _ALNUM)} AS w FROM benchmark WHERE item_id IS NOT NULL),
iw AS (SELECT DISTINCT item, n, array_to_string(w[p:p + n - 1], ' ') AS s
       FROM (SELECT item, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS p FROM i WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT rid, n, p, array_to_string(w[p:p + n - 1], ' ') AS s
       FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT rid, n, p, item FROM dw JOIN iw USING (n, s)),
covered AS (SELECT rid, count(DISTINCT k) AS n_hit FROM (SELECT rid, unnest(range(p, p + n)) AS k FROM (SELECT DISTINCT rid, n, p FROM hit)) GROUP BY rid),
ids AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item FROM hit) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (rid) LEFT JOIN ids USING (rid)
"""


def near_dup_sql(k: int = 4, percent: int = 80) -> str:
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, {_words("text", _SPACE)} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[p:p + {k} - 1], ' ') AS s
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {k}, 0) + 2)) AS p FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
e AS (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y USING (s) WHERE x.doc_id <> y.doc_id GROUP BY ALL)
      JOIN n na ON a = na.doc_id JOIN n nb ON b = nb.doc_id WHERE 100 * c >= {percent} * (na.n + nb.n - c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
low AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a),
same AS (SELECT doc_id, list_sort(list(s)) AS l FROM s GROUP BY doc_id),
c AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY l) AS class_id FROM same)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, d.doc_id = component_id AS kept, coalesce(class_id, d.doc_id) AS class_id
FROM d LEFT JOIN n USING (doc_id) JOIN low USING (doc_id) LEFT JOIN c USING (doc_id)
"""


def url_filter_sql() -> str:
    *weights, bias = url_filter.fit()
    best = "NULL"
    rules = sorted(url_filter.RULES, key=lambda r: (len(r[0]) + len(r[1]), r[0] + r[1]), reverse=True)
    for host, path, verdict in rules[::-1]:
        best = f"CASE WHEN (host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}') THEN {{'rule': '{host}{path}', 'verdict': '{verdict}'}} ELSE {best} END"
    best = best.replace("ELSE NULL END", "END", 1)
    total, count = str(bias), []
    sums = []
    for n in url_filter.SIZES:
        h = str(n)
        for j in range(n):
            h = f"(({h}) * 31 + c[i + {j + 1}]) % 1000003"
        sums.append(f"coalesce(list_sum([t[({h}) % {url_filter.DIM} + 1] FOR i IN range(0, greatest(len(c) - {n - 1}, 0))]), 0)")
        count.append(f"greatest(len(c) - {n - 1}, 0)")
    return f"""
WITH u AS (SELECT page_id, coalesce({_LOWER.format("regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1)")}, '') AS host,
                  coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
m AS (SELECT *, [unicode(x) FOR x IN string_split('^' || regexp_replace(host, '\\.[^.]*$', '') || regexp_replace(path, '[0-9]+', '0', 'g') || '$', '')] AS c, {best} AS r,
             [{", ".join(map(str, weights))}] AS t FROM u)
SELECT page_id, host, path, r.rule AS rule,
       coalesce(r.verdict, CASE WHEN {total} + ({" + ".join(sums)}) / sqrt(greatest({" + ".join(count)}, 1)) > 0 THEN 'block' ELSE 'allow' END) AS verdict
FROM m
"""


LINE_DEDUP = f"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS pos FROM documents WHERE text IS NOT NULL),
f AS (SELECT line, min((doc_id, pos)) AS spot, string_split(line, ' ') AS w FROM l WHERE trim(line, ' ') <> '' GROUP BY line),
g AS (SELECT line, spot, w, len(w) AS n FROM f),
v AS (SELECT line, spot, n, p, array_to_string(w[1:p - 1] || w[p + 1:n], ' ') AS s FROM (SELECT *, unnest(range(1, n + 1)) AS p FROM g)),
near AS (SELECT a.line, b.spot FROM v a JOIN v b ON a.n = b.n AND a.p = b.p AND a.s = b.s AND b.spot < a.spot WHERE a.n >= {line_dedup.MIN_WORDS}
         UNION ALL SELECT a.line, b.spot FROM v a JOIN g b ON a.s = b.line AND b.n = a.n - 1 AND b.spot < a.spot WHERE a.n >= {line_dedup.MIN_WORDS}
         UNION ALL SELECT a.line, b.spot FROM g a JOIN v b ON b.s = a.line AND a.n = b.n - 1 AND b.spot < a.spot WHERE b.n >= {line_dedup.MIN_WORDS}),
gone AS (SELECT DISTINCT line FROM near),
k AS (SELECT l.doc_id, l.pos, l.line, f.spot IS NOT NULL AND (l.doc_id, l.pos) > f.spot AS exact, gone.line IS NOT NULL AS fuzzy
      FROM l LEFT JOIN f USING (line) LEFT JOIN gone USING (line)),
t AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (exact OR fuzzy) AS n_dropped, count(*) FILTER (fuzzy AND NOT exact) AS n_near,
             coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT (exact OR fuzzy)), '') AS kept FROM k GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_dropped, 0) AS BIGINT) AS n_dropped, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near,
       CAST(length(kept) AS BIGINT) AS n_chars_kept, sha256(kept) AS text_sha256
FROM documents d LEFT JOIN t USING (doc_id)
"""


def chat_format_sql() -> str:
    def escaped(column: str, pairs) -> str:
        for plain, safe in pairs:
            column = f"replace({column}, {_quoted(plain)}, '{safe}')"
        return column

    return f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
p AS (SELECT *, {len(chat_format.OPEN) + 1} + length({escaped("role", chat_format.ROLE_ESCAPES)}) + length({escaped("text", chat_format.ESCAPES)}) AS chars FROM c),
e AS (SELECT *, sum(chars + {len(chat_format.CLOSE)}) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) - {len(chat_format.CLOSE)} AS upto FROM p)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(chars + {len(chat_format.CLOSE)}) AS BIGINT) AS formatted_chars,
       CAST(coalesce(sum(upto) FILTER (role = 'assistant'), 0) AS BIGINT) AS example_chars, count(*) FILTER (role = 'assistant') AS n_examples
FROM e GROUP BY conv_id
"""


def _quoted(s: str) -> str:
    return "chr(10)" if s == "\n" else f"'{s}'"


SQL = {
    "op1_decontaminate": DECONTAMINATE,
    "op3_near_dup": near_dup_sql(),
    "op4_url_filter": url_filter_sql(),
    "op5_line_dedup": LINE_DEDUP,
    "op7_chat_format": chat_format_sql(),
}
