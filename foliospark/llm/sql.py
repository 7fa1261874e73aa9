"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

from .mixing import LEVELS, SEED, WEB_DIGITS, WEIGHTS


def _weight(level: str) -> str:
    cases = "".join(f" WHEN {level} = '{name}' THEN {w}" for name, w in WEIGHTS[level].items())
    return f"CASE{cases} ELSE 1 END" if cases else "1"


def _level(k: int) -> str:
    """The shares of one level of the tree, from the budgets of the level above."""
    path, above = ", ".join(LEVELS[: k + 1]), LEVELS[:k]
    part = f"PARTITION BY {', '.join(above)}" if above else ""
    using = f"JOIN share{k - 1} USING ({', '.join(above)})" if above else "CROSS JOIN root"
    rising = f"OVER ({part} ORDER BY most::DOUBLE / weight, {LEVELS[k]} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    return f"""
node{k} AS (SELECT {path}, sum(tokens)::BIGINT * 4 AS most, {_weight(LEVELS[k])} AS weight FROM counted GROUP BY ALL),
fit{k} AS (SELECT *, coalesce(sum(most) {rising}, 0) AS c, sum(weight) OVER ({part}) - coalesce(sum(weight) {rising}, 0) AS w FROM node{k} {using}),
full{k} AS (SELECT *, most * w <= weight * (budget - c) AS filled FROM fit{k}),
share{k} AS (SELECT {path}, CASE WHEN filled THEN most ELSE weight * (budget - coalesce(sum(most) FILTER (filled) OVER ({part}), 0)) // sum(weight) FILTER (NOT filled) OVER ({part}) END AS budget FROM full{k})"""


MIXING = f"""
WITH counted AS (
  SELECT doc_id, CASE WHEN right(coalesce(source, 'unknown'), 1) IN ({", ".join(f"'{c}'" for c in WEB_DIGITS)}) THEN 'web' ELSE 'reference' END AS domain,
    coalesce(lang, 'unknown') AS lang, coalesce(source, 'unknown') AS source,
    len(list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> ''))::BIGINT AS tokens
  FROM documents),
root AS (SELECT coalesce(sum(tokens), 0) // 2 AS budget FROM counted),
{",".join(_level(k) for k in range(3))},
leaf AS (SELECT {", ".join(LEVELS)}, sum(tokens) AS leaf_tokens, any_value(budget) AS budget FROM counted JOIN share2 USING ({", ".join(LEVELS)}) GROUP BY ALL),
plan AS (SELECT *, CASE WHEN leaf_tokens > 0 THEN budget // leaf_tokens ELSE 0 END AS epochs FROM leaf),
keyed AS (SELECT *, md5('{SEED}:' || epochs::BIGINT || ':' || coalesce(doc_id::VARCHAR, '')) AS key FROM counted JOIN plan USING ({", ".join(LEVELS)})),
run AS (SELECT *, sum(tokens) OVER (PARTITION BY {", ".join(LEVELS)} ORDER BY key) AS reach FROM keyed)
SELECT doc_id, {", ".join(LEVELS)}, tokens, budget::BIGINT AS leaf_budget,
  (epochs + CASE WHEN leaf_tokens > 0 AND reach <= budget - epochs * leaf_tokens THEN 1 ELSE 0 END)::BIGINT AS copies
FROM run
"""

#: Every window of 400 bytes, as hexadecimal text, by its MD5.
REPEATS = """
WITH raw AS (SELECT doc_id, row_number() OVER () AS r, hex(encode(coalesce(text, ''))) AS x FROM documents),
win AS (SELECT r, i, md5(substring(x, 2 * i + 1, 800)) AS h FROM (SELECT r, x, unnest(range(0, greatest(length(x) // 2 - 399, 0))) AS i FROM raw)),
twice AS (SELECT h FROM win GROUP BY h HAVING count(*) > 1),
hit AS (SELECT r, i, CASE WHEN i <= lag(i) OVER (PARTITION BY r ORDER BY i) + 400 THEN 0 ELSE 1 END AS opens FROM win SEMI JOIN twice USING (h)),
span AS (SELECT r, min(i) AS low, max(i) + 400 AS high FROM (SELECT *, sum(opens) OVER (PARTITION BY r ORDER BY i) AS k FROM hit) GROUP BY r, k),
gap AS (SELECT r, coalesce(lag(high) OVER w, 0) AS low, low AS high FROM span WINDOW w AS (PARTITION BY r ORDER BY low) UNION ALL SELECT r, max(high), NULL FROM span GROUP BY r),
kept AS (SELECT r, string_agg(substring(x, 2 * low + 1, 2 * (coalesce(high, length(x) // 2) - low)), '' ORDER BY low) AS k FROM gap JOIN raw USING (r) GROUP BY r)
SELECT doc_id, (length(x) // 2)::BIGINT AS n_bytes, coalesce(n, 0)::BIGINT AS n_removed, coalesce(c, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(k, x))) AS kept_sha256
FROM raw LEFT JOIN kept USING (r) LEFT JOIN (SELECT r, sum(high - low) AS n, count(*) AS c FROM span GROUP BY r) USING (r)
"""

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

LINES = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id, 9223372036854775807) AS d, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
each AS (SELECT r, d, unnest(range(1, len(l) + 1)) AS i, l FROM docs),
keyed AS (SELECT r, d, i, l[i] AS line, translate(trim(l[i], chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') AS k FROM each),
shared AS (SELECT k, min(d) AS lo FROM keyed WHERE length(k) >= 10 GROUP BY k HAVING min(d) < max(d)),
marked AS (SELECT r, i, line, coalesce(d > lo, false) AS gone FROM keyed LEFT JOIN shared USING (k))
SELECT any_value(doc_id) AS doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM marked JOIN docs USING (r) GROUP BY r
"""

TRIE = """
WITH bits AS (SELECT conv_id, list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)) AS bytes FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL)),
crc AS (SELECT conv_id, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(bytes, lambda b: b::BIGINT)),
    lambda s, b: list_reduce(list_prepend(xor(s, b), range(8)), lambda x, k: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384::BIGINT) ELSE x // 2 END)), 4294967295::BIGINT) % 4 AS h FROM bits),
own AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS n FROM conversations WHERE conv_id IS NOT NULL),
turns AS (
  SELECT c.conv_id, n, role, text FROM crc c JOIN own o ON o.conv_id = c.conv_id - c.conv_id % 20 AND n <= h
  UNION ALL SELECT c.conv_id, n, role, text FROM crc c JOIN own o ON o.conv_id = c.conv_id AND n > h),
path AS (
  SELECT conv_id, row_number() OVER w AS depth, string_agg(md5(role) || md5(text), '') OVER w AS p, len(list_filter(string_split_regex(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')) AS words
  FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY n)
  UNION ALL SELECT conv_id, 0, '', 0 FROM crc),
ends AS (SELECT conv_id, max(depth) AS top FROM path GROUP BY conv_id),
node AS (SELECT depth, p, min(conv_id) AS lo, count(*) AS n, any_value(words) AS words FROM path GROUP BY depth, p),
child AS (SELECT a.depth, a.p, count(*) AS children FROM node a JOIN path b ON b.conv_id = a.lo AND b.depth = a.depth JOIN node c ON c.depth = a.depth + 1 JOIN path d ON d.conv_id = c.lo AND d.depth = a.depth AND d.p = a.p GROUP BY ALL),
full_node AS (SELECT node.*, coalesce(children, 0) AS children FROM node LEFT JOIN child USING (depth, p)),
sums AS (SELECT u.depth, u.p, sum(CASE WHEN v.children = 0 THEN 1 ELSE 0 END) AS leaves, sum((v.n - 1) * v.words) AS saved FROM full_node v JOIN path u ON u.conv_id = v.lo AND u.depth <= v.depth GROUP BY ALL),
last AS (SELECT path.depth, p, string_agg(path.conv_id::VARCHAR, ',' ORDER BY path.conv_id) AS ids FROM path JOIN ends ON ends.conv_id = path.conv_id AND top = path.depth GROUP BY ALL)
SELECT f.lo AS conv_id, f.depth, m.lo AS parent_conv_id, f.n AS n_convs, f.children AS n_children, leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM full_node f JOIN sums USING (depth, p) LEFT JOIN last USING (depth, p)
LEFT JOIN path q ON q.conv_id = f.lo AND q.depth = f.depth - 1 LEFT JOIN node m ON m.depth = q.depth AND m.p = q.p
"""

PHRASES = f"""
WITH piece AS (SELECT row_number() OVER () AS id, lang, p FROM (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[.,;:!?\\x0A-\\x0D]')) AS p FROM documents)),
words AS (SELECT id, lang, unnest(l) AS w, generate_subscripts(l, 1) AS i FROM (SELECT id, lang, list_filter(string_split_regex(p, '[\\x20\\x09]+'), lambda x: x <> '') AS l FROM piece)),
three AS (SELECT lang, w, lead(w) OVER o AS v, lead(w, 2) OVER o AS u FROM words WINDOW o AS (PARTITION BY id ORDER BY i)),
gram AS (SELECT lang, 1 AS k, w AS g FROM three UNION ALL SELECT lang, 2, w || ' ' || v FROM three WHERE v IS NOT NULL UNION ALL SELECT lang, 3, w || ' ' || v || ' ' || u FROM three WHERE u IS NOT NULL),
f AS (SELECT lang, g, any_value(k) AS k, count(*) AS f FROM gram GROUP BY lang, g),
total AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
cand AS (SELECT *, string_split(g, ' ') AS s FROM f WHERE k > 1 AND f >= 10),
parts AS (SELECT lang, g, k, f AS a, j, array_to_string(s[1:j], ' ') AS first, array_to_string(s[j + 1:], ' ') AS rest FROM cand CROSS JOIN range(1, 3) t(j) WHERE j < k),
cut AS (SELECT p.lang, p.g, p.k, a, j, l.f AS l, r.f AS r, 1000000::HUGEINT * a * a // (l.f::HUGEINT * r.f) AS score FROM parts p JOIN f l ON l.lang = p.lang AND l.g = first JOIN f r ON r.lang = p.lang AND r.g = rest),
best AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, j) = 1),
longer AS (SELECT lang, s[1] || ' ' || s[2] AS g, f FROM cand WHERE k = 3 UNION ALL SELECT lang, s[2] || ' ' || s[3], f FROM cand WHERE k = 3),
around AS (SELECT lang, g, max(f) AS most FROM longer GROUP BY lang, g),
kept AS (SELECT best.lang, best.g AS phrase, a, l, r, score FROM best LEFT JOIN around ON around.lang = best.lang AND around.g = best.g WHERE coalesce(100 * most < 50 * a, true)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score FROM ranked JOIN total USING (lang) WHERE rank <= 2000
"""

ORACLES: dict[str, str] = {
    "op13_phrase_automata": PHRASES,
    "op12_conversation_trie": TRIE,
    "op11_line_hash": LINES,
    "op7_run_length_index": REPEATS,
    "op8_hierarchical_mixing": MIXING,
}
