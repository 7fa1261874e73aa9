"""DuckDB SQL for the registered queries: the same tables from the same rules, by lists, joins and a table of common lengths."""

from __future__ import annotations

from foliospark.functions import colour
from foliospark.sources.tables import PAGE_LINES

SPACE = r"\s+"
BLANKS = rf"trim(regexp_replace(x, '{SPACE}', ' ', 'g'))"

LINES = f"""
docs AS (SELECT doc_id, source, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: {BLANKS}), lambda x: x <> '') AS l FROM documents),
line AS (SELECT doc_id, (i - 1)::INT AS line_no, ((i - 1) // {PAGE_LINES})::INT AS page_index, ((i - 1) % {PAGE_LINES})::INT AS line_index, l[i] AS text
  FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM docs))"""

_EDIT = f"""list_transform(range(1, len(o) + 1), lambda i: CASE (doc_id * 31 + (p * {PAGE_LINES} + i - 1) * 17) % 23 WHEN 0 THEN []::VARCHAR[] WHEN 1 THEN [o[i] || ' [rev]']
    WHEN 2 THEN [o[i], 'inserted ' || doc_id || ':' || (p * {PAGE_LINES} + i - 1)] ELSE [o[i]] END)"""

_OLD = f"""{LINES},
cut AS (SELECT doc_id, doc_id % 10 AS rule, (len(l) + {PAGE_LINES - 1}) // {PAGE_LINES} AS n, l, unnest(range(0, (len(l) + {PAGE_LINES - 1}) // {PAGE_LINES})) AS p FROM docs),
old AS (SELECT doc_id, rule, n, p, l[p * {PAGE_LINES} + 1 : p * {PAGE_LINES} + {PAGE_LINES}] AS o FROM cut)"""

PAGES = f"""{_OLD},
pair AS (
  SELECT doc_id AS pair_id, p::INT AS page_index, o AS old_lines, CASE
    WHEN rule = 2 AND n > 1 AND p = n - 1 THEN NULL WHEN rule IN (0, 1, 2) THEN o
    WHEN rule = 3 THEN list_transform(o, lambda x: '  ' || x || ' ')
    WHEN rule = 4 THEN list_concat(['fresh a ' || doc_id || ':' || p, 'fresh b ' || doc_id || ':' || p, 'fresh c ' || doc_id || ':' || p], o[2:])
    WHEN rule = 5 AND len(o) >= 4 THEN list_concat(['fresh d ' || doc_id || ':' || p], o[4:]) WHEN rule = 5 THEN o
    ELSE flatten({_EDIT}) END AS new_lines
  FROM old
  UNION ALL SELECT DISTINCT doc_id, n::INT, NULL, ['appended page of ' || doc_id] FROM old WHERE rule = 1),
side AS (SELECT *, CASE WHEN new_lines IS NULL THEN 'removed' WHEN old_lines IS NULL THEN 'added' ELSE 'common' END AS side FROM pair)"""

#: Each document against the next one of its source, page by page.
TWO_SIDES = f"""{_OLD},
following AS (SELECT doc_id AS pair_id, doc_id AS old_doc_id, lead(doc_id) OVER (PARTITION BY source ORDER BY doc_id) AS new_doc_id FROM documents WHERE source IS NOT NULL),
one AS (SELECT pair_id, p::INT AS page_index, o AS old_lines FROM following JOIN old ON doc_id = old_doc_id WHERE new_doc_id IS NOT NULL),
two AS (SELECT pair_id, p::INT AS page_index, o AS new_lines FROM following JOIN old ON doc_id = new_doc_id),
side AS (SELECT *, CASE WHEN new_lines IS NULL THEN 'removed' WHEN old_lines IS NULL THEN 'added' ELSE 'common' END AS side FROM one FULL JOIN two USING (pair_id, page_index))"""

#: Turns as outlines; siblings come in falling order of their turns.
_TURNS = """node AS (
  SELECT conv_id AS outline_id, turn AS node_id, CASE WHEN turn = 0 THEN NULL WHEN conv_id % 11 = 5 AND turn = 2 THEN turn WHEN conv_id % 11 = 7 AND turn = 3 THEN turn + 1000 WHEN turn % 3 = 0 THEN turn - 3 ELSE turn - 1 END AS parent_id,
    substring(text, 1, 30) AS title, CASE WHEN turn % 5 <> 4 THEN turn // 2 END AS page_index FROM conversations),
many AS (SELECT outline_id, (count(*) + 2) // 3 AS page_count FROM node GROUP BY outline_id),
down AS (
  SELECT *, 0::BIGINT AS level, [-node_id] AS path FROM node WHERE parent_id IS NULL
  UNION ALL SELECT n.*, level + 1, list_append(path, -n.node_id) FROM node n JOIN down d ON n.outline_id = d.outline_id AND n.parent_id = d.node_id)"""

#: Longest common subsequences by the usual table, one row of it a step, then read from the end. Follows a table `side`.
_ENTRIES = """
keyed AS MATERIALIZED (SELECT *, list_transform(old_lines, lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')) AS ok, list_transform(new_lines, lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')) AS nk
  FROM side WHERE side = 'common'),
grown(pair_id, page_index, ok, nk, i, tab) AS (
  SELECT pair_id, page_index, ok, nk, 0, [list_transform(range(len(nk) + 1), lambda x: 0::BIGINT)] FROM keyed
  UNION ALL SELECT pair_id, page_index, ok, nk, i + 1, list_append(tab, list_reduce(range(1, len(nk) + 1),
    lambda acc, j: list_append(acc, CASE WHEN ok[i + 1] = nk[j] THEN tab[i + 1][j] + 1 ELSE greatest(tab[i + 1][j + 1], acc[j]) END), [0::BIGINT]))
  FROM grown WHERE i < len(ok)),
back(pair_id, page_index, ok, nk, tab, i, j, o, n) AS (
  SELECT pair_id, page_index, ok, nk, tab, len(ok), len(nk), NULL::BIGINT, NULL::BIGINT FROM grown WHERE i = len(ok)
  UNION ALL SELECT pair_id, page_index, ok, nk, tab, CASE WHEN ok[i] = nk[j] OR tab[i][j + 1] >= tab[i + 1][j] THEN i - 1 ELSE i END,
    CASE WHEN ok[i] = nk[j] THEN j - 1 WHEN tab[i][j + 1] >= tab[i + 1][j] THEN j ELSE j - 1 END,
    CASE WHEN ok[i] = nk[j] THEN i - 1 END, CASE WHEN ok[i] = nk[j] THEN j - 1 END
  FROM back WHERE i > 0 AND j > 0),
stop AS (SELECT pair_id, page_index, o, n FROM back WHERE o IS NOT NULL UNION ALL SELECT pair_id, page_index, len(ok), len(nk) FROM keyed),
gap AS (SELECT *, coalesce(lag(o) OVER w, -1) + 1 AS lo, coalesce(lag(n) OVER w, -1) + 1 AS ln FROM stop WINDOW w AS (PARTITION BY pair_id, page_index ORDER BY o, n)),
made AS (
  SELECT g.pair_id, g.page_index, o AS pos_o, n AS pos_n, 0 AS late, k, CASE WHEN o > lo AND n > ln THEN 'modified' WHEN o > lo THEN 'removed' ELSE 'added' END AS kind,
    CASE WHEN o > lo THEN lo + least(k, o - lo - 1) END AS old_line, CASE WHEN n > ln THEN ln + least(k, n - ln - 1) END AS new_line
  FROM (SELECT *, unnest(range(0, greatest(o - lo, n - ln))) AS k FROM gap) g
  UNION ALL SELECT g.pair_id, g.page_index, o, n, 1, 0, 'unchanged', o, n FROM gap g JOIN keyed USING (pair_id, page_index) WHERE o < len(ok) AND n < len(nk)),
entry AS MATERIALIZED (
  SELECT m.pair_id, m.page_index, (row_number() OVER (PARTITION BY m.pair_id, m.page_index ORDER BY pos_o, pos_n, late, k) - 1)::INT AS entry_seq, kind,
    old_line::INT AS old_line, new_line::INT AS new_line, old_lines[old_line + 1] AS old_text, new_lines[new_line + 1] AS new_text
  FROM made m JOIN keyed USING (pair_id, page_index)),
change AS (SELECT * FROM entry WHERE kind <> 'unchanged'),
status AS (SELECT pair_id, page_index, CASE WHEN side <> 'common' THEN side WHEN c.pair_id IS NULL THEN 'match' ELSE 'modified' END AS status
  FROM side LEFT JOIN (SELECT DISTINCT pair_id, page_index FROM change) c USING (pair_id, page_index)),
summary AS (SELECT pair_id, page_index, status, count(*) FILTER (kind = 'added') AS added, count(*) FILTER (kind = 'removed') AS removed, count(*) FILTER (kind = 'modified') AS modified,
  count(kind) AS total FROM status LEFT JOIN change USING (pair_id, page_index) GROUP BY ALL),
stats AS (SELECT pair_id, count(*) FILTER (status = 'match') AS pages_match, count(*) FILTER (status = 'modified') AS pages_modified, count(*) FILTER (status = 'added') AS pages_added,
  count(*) FILTER (status = 'removed') AS pages_removed, sum(added)::BIGINT AS entries_added, sum(removed)::BIGINT AS entries_removed, sum(modified)::BIGINT AS entries_modified,
  sum(total)::BIGINT AS total_changes FROM summary GROUP BY pair_id),
full_stats AS (SELECT *, total_changes > 0 OR pages_added + pages_removed > 0 AS has_differences FROM stats),
manifest AS (SELECT pair_id, pair_id || ':old' AS old_doc_id, pair_id || ':new' AS new_doc_id, 'text' AS mode, count(old_lines) AS old_pages, count(new_lines) AS new_pages FROM side GROUP BY pair_id),
box AS (SELECT *, CASE WHEN old_line IS NOT NULL THEN 72::DOUBLE END AS old_left, (800 - 14 * old_line)::DOUBLE + 8.14::DOUBLE AS old_top, 72::DOUBLE + length(old_text) * 6.05::DOUBLE AS old_right,
  (800 - 14 * old_line)::DOUBLE - 1.98::DOUBLE AS old_bottom, CASE WHEN new_line IS NOT NULL THEN 72::DOUBLE END AS new_left, (800 - 14 * new_line)::DOUBLE + 8.14::DOUBLE AS new_top,
  72::DOUBLE + length(new_text) * 6.05::DOUBLE AS new_right, (800 - 14 * new_line)::DOUBLE - 1.98::DOUBLE AS new_bottom FROM change)"""

ENTRIES = f"{PAGES},{_ENTRIES}"

_REGIONS = """
wide AS (SELECT pair_id, page_index, entry_seq, coalesce(new_left, old_left) AS l, coalesce(new_right, old_right) AS r, 842::DOUBLE - coalesce(new_top, old_top) AS t, 842::DOUBLE - coalesce(new_bottom, old_bottom) AS b FROM box),
region AS (
  SELECT pair_id, page_index, entry_seq * 2 AS region_id, l AS "left", t AS top, (72::DOUBLE + r) / 2 - 2 AS "right", b AS bottom FROM wide
  UNION ALL SELECT pair_id, page_index, entry_seq * 2 + 1, (72::DOUBLE + r) / 2 + 2, t, r, b FROM wide
  UNION ALL SELECT DISTINCT pair_id, page_index, -1, 500::DOUBLE, 20::DOUBLE, 520::DOUBLE, 30::DOUBLE FROM change WHERE (pair_id + page_index) % 7 = 0),
near AS MATERIALIZED (SELECT a.pair_id, a.page_index, a.region_id AS a, b.region_id AS b FROM region a JOIN region b USING (pair_id, page_index)
  WHERE greatest(a."left" - b."right", b."left" - a."right") <= 8 AND greatest(a.top - b.bottom, b.top - a.bottom) <= 8),
reach(pair_id, page_index, a, b) AS (SELECT pair_id, page_index, region_id, region_id FROM region UNION SELECT r.pair_id, r.page_index, r.a, n.b FROM reach r JOIN near n ON r.pair_id = n.pair_id AND r.page_index = n.page_index AND r.b = n.a),
label AS (SELECT pair_id, page_index, a AS region_id, min(b) AS component FROM reach GROUP BY ALL),
merged AS (SELECT pair_id, page_index, min("left") AS "left", min(top) AS top, max("right") AS "right", max(bottom) AS bottom, count(*) AS n_boxes FROM region JOIN label USING (pair_id, page_index, region_id) GROUP BY pair_id, page_index, component)"""

REGIONS = f"{ENTRIES},{_REGIONS}"

#: Entries and page statuses of the three modes.
_MODES = """
line_box AS (SELECT pair_id, page_index, old_left AS l, 842::DOUBLE - old_top AS t, old_right AS r, 842::DOUBLE - old_bottom AS b FROM box WHERE old_line IS NOT NULL
  UNION ALL SELECT pair_id, page_index, new_left, 842::DOUBLE - new_top, new_right, 842::DOUBLE - new_bottom FROM box WHERE new_line IS NOT NULL),
loose AS MATERIALIZED (SELECT * FROM merged m WHERE NOT EXISTS (SELECT 1 FROM line_box x WHERE x.pair_id = m.pair_id AND x.page_index = m.page_index AND m."left" < x.r AND x.l < m."right" AND m.top < x.b AND x.t < m.bottom)),
mode_name AS (SELECT unnest(['text', 'visual', 'hybrid']) AS mode),
found AS MATERIALIZED (
  SELECT pair_id, mode, page_index, 'text' AS origin, entry_seq, kind, old_line, new_line, old_text, new_text, NULL::DOUBLE AS "left", NULL::DOUBLE AS top, NULL::DOUBLE AS "right", NULL::DOUBLE AS bottom FROM change, mode_name WHERE mode <> 'visual'
  UNION ALL SELECT pair_id, 'visual', page_index, 'visual', NULL, 'modified', NULL, NULL, NULL, NULL, "left", top, "right", bottom FROM merged
  UNION ALL SELECT pair_id, 'hybrid', page_index, 'visual', NULL, 'modified', NULL, NULL, NULL, NULL, "left", top, "right", bottom FROM loose),
mode_page AS MATERIALIZED (SELECT pair_id, mode, page_index, CASE WHEN side <> 'common' THEN side WHEN n IS NULL THEN 'match' ELSE 'modified' END AS status, coalesce(added, 0) AS added, coalesce(removed, 0) AS removed, coalesce(modified, 0) AS modified
  FROM side CROSS JOIN mode_name LEFT JOIN (SELECT pair_id, mode, page_index, count(*) AS n, count(*) FILTER (kind = 'added') AS added, count(*) FILTER (kind = 'removed') AS removed, count(*) FILTER (kind = 'modified') AS modified FROM found GROUP BY ALL) USING (pair_id, mode, page_index)),
mode_stats AS (SELECT pair_id, mode, count(*) FILTER (status = 'match') AS pages_match, count(*) FILTER (status = 'modified') AS pages_modified, count(*) FILTER (status = 'added') AS pages_added, count(*) FILTER (status = 'removed') AS pages_removed,
  sum(added)::BIGINT AS entries_added, sum(removed)::BIGINT AS entries_removed, sum(modified)::BIGINT AS entries_modified, sum(added + removed + modified)::BIGINT AS total_changes, bool_or(status <> 'match') AS has_differences FROM mode_page GROUP BY ALL)"""

COMPARED = f"{TWO_SIDES},{_ENTRIES},{_REGIONS},{_MODES}"

_TRUTH = f"""
truth_region AS MATERIALIZED (
  SELECT doc_id AS case_id, p::INT AS page_index, (row_number() OVER (PARTITION BY doc_id, p ORDER BY i) - 1)::INT AS region_id, CASE WHEN x <> 2 THEN i END::INT AS old_line, CASE x WHEN 1 THEN i + ins - rem WHEN 2 THEN i + ins - rem + 1 END::INT AS new_line,
    CASE WHEN x <> 2 THEN t END AS old_text, CASE x WHEN 1 THEN t || ' [rev]' WHEN 2 THEN 'inserted ' || doc_id || ':' || (p * {PAGE_LINES} + i) END AS new_text
  FROM (SELECT doc_id, p, i, h[i + 1] AS x, o[i + 1] AS t, len(list_filter(h[1:i], lambda y: y = 2)) AS ins, len(list_filter(h[1:i], lambda y: y = 0)) AS rem
    FROM (SELECT *, unnest(range(0, len(o))) AS i FROM (SELECT doc_id, p, o, list_transform(range(0, len(o)), lambda k: (doc_id * 31 + (p * {PAGE_LINES} + k) * 17) % 23) AS h FROM old WHERE rule > 5))) WHERE x <= 2
  UNION ALL SELECT doc_id, p::INT, k::INT, 0, k::INT, o[1], 'fresh ' || chr((97 + k)::INT) || ' ' || doc_id || ':' || p FROM old, range(3) AS r(k) WHERE rule = 4
  UNION ALL SELECT doc_id, p::INT, k::INT, k::INT, 0, o[k + 1], 'fresh d ' || doc_id || ':' || p FROM old, range(3) AS r(k) WHERE rule = 5 AND len(o) >= 4
  UNION ALL SELECT doc_id, p::INT, -1, NULL, NULL, NULL, 'a line that nobody wrote' FROM old WHERE doc_id % 29 = 3 AND p = 0),
truth_page AS MATERIALIZED (
  SELECT o.doc_id AS case_id, p::INT AS page_index, CASE WHEN rule = 2 AND n > 1 AND p = n - 1 THEN 'removed' WHEN t.case_id IS NULL THEN 'match' ELSE 'modified' END AS status, NULL::VARCHAR AS text_status, CASE WHEN rule = 3 THEN 'modified' END AS visual_status, NULL::VARCHAR AS hybrid_status
  FROM old o LEFT JOIN (SELECT DISTINCT case_id, page_index FROM truth_region WHERE region_id >= 0) t ON t.case_id = doc_id AND t.page_index = p
  UNION ALL SELECT DISTINCT doc_id, n::INT, 'added', NULL, NULL, NULL FROM old WHERE rule = 1)"""

CASES = f"""{REGIONS},{_MODES},{_TRUTH},
expected AS (SELECT case_id, mode, page_index, coalesce(CASE mode WHEN 'text' THEN text_status WHEN 'visual' THEN visual_status ELSE hybrid_status END, status) AS status FROM truth_page CROSS JOIN mode_name),
classes AS (SELECT coalesce(e.case_id, s.pair_id) AS case_id, coalesce(e.mode, s.mode) AS mode, count(*) AS pages_total, count(*) FILTER (e.status = s.status) AS pages_correct FROM expected e FULL JOIN mode_page s ON e.case_id = s.pair_id AND e.mode = s.mode AND e.page_index = s.page_index GROUP BY 1, 2),
clean AS (SELECT case_id, mode, bool_and(status = 'match') AS clean FROM expected GROUP BY ALL),
wrong AS (SELECT pair_id AS case_id, s.mode, has_differences AND coalesce(clean, true) AS doc_false_positive FROM mode_stats s LEFT JOIN clean c ON case_id = pair_id AND c.mode = s.mode),
text_true AS (SELECT case_id, nullif(trim(regexp_replace(old_text, '{SPACE}', ' ', 'g')), '') AS o, nullif(trim(regexp_replace(new_text, '{SPACE}', ' ', 'g')), '') AS n FROM truth_region WHERE old_text IS NOT NULL OR new_text IS NOT NULL),
text_found AS (SELECT pair_id AS case_id, nullif(trim(regexp_replace(old_text, '{SPACE}', ' ', 'g')), '') AS o, nullif(trim(regexp_replace(new_text, '{SPACE}', ' ', 'g')), '') AS n FROM change),
hit_true AS (SELECT t.case_id, count(*) AS n, count(*) FILTER (EXISTS (SELECT 1 FROM text_found f WHERE f.case_id = t.case_id AND f.o = t.o) OR EXISTS (SELECT 1 FROM text_found f WHERE f.case_id = t.case_id AND f.n = t.n)) AS hit FROM text_true t GROUP BY 1),
hit_found AS (SELECT t.case_id, count(*) AS n, count(*) FILTER (EXISTS (SELECT 1 FROM text_true f WHERE f.case_id = t.case_id AND f.o = t.o) OR EXISTS (SELECT 1 FROM text_true f WHERE f.case_id = t.case_id AND f.n = t.n)) AS hit FROM text_found t GROUP BY 1),
text_count AS (SELECT case_id, coalesce(t.hit, 0) AS tp, coalesce(f.n, 0) - coalesce(f.hit, 0) AS fp, coalesce(t.n, 0) - coalesce(t.hit, 0) AS fn FROM hit_true t FULL JOIN hit_found f USING (case_id)),
true_box AS (SELECT case_id, page_index, region_id, 72::DOUBLE AS l, 842::DOUBLE - ((800 - 14 * coalesce(new_line, old_line))::DOUBLE + 8.14::DOUBLE) AS t, 72::DOUBLE + length(coalesce(new_text, old_text)) * 6.05::DOUBLE AS r,
  842::DOUBLE - ((800 - 14 * coalesce(new_line, old_line))::DOUBLE - 1.98::DOUBLE) AS b FROM truth_region WHERE old_line IS NOT NULL OR new_line IS NOT NULL),
seen_box AS (SELECT pair_id AS case_id, row_number() OVER () AS d, "left" l, top t, "right" r, bottom b FROM merged),
meet AS (SELECT t.case_id, t.page_index, t.region_id, d FROM true_box t JOIN seen_box f ON t.case_id = f.case_id
  WHERE least(t.r, f.r) > greatest(t.l, f.l) AND least(t.b, f.b) > greatest(t.t, f.t) AND (t.r - t.l) * (t.b - t.t) > 0 AND (f.r - f.l) * (f.b - f.t) > 0
  AND (least(t.r, f.r) - greatest(t.l, f.l)) * (least(t.b, f.b) - greatest(t.t, f.t)) >= least((t.r - t.l) * (t.b - t.t), (f.r - f.l) * (f.b - f.t)) * 0.5::DOUBLE),
region_count AS (SELECT n.case_id, coalesce(m.tp, 0) AS tp, coalesce(f.n, 0) - coalesce(m.hit, 0) AS fp, n.n - coalesce(m.tp, 0) AS fn FROM (SELECT case_id, count(*) AS n FROM true_box GROUP BY 1) n
  LEFT JOIN (SELECT case_id, count(*) AS n FROM seen_box GROUP BY 1) f USING (case_id) LEFT JOIN (SELECT case_id, count(DISTINCT (page_index, region_id)) AS tp, count(DISTINCT d) AS hit FROM meet GROUP BY 1) m USING (case_id)),
score AS (
  SELECT c.case_id, c.mode, pages_total, pages_correct, doc_false_positive, CASE WHEN c.mode <> 'visual' THEN t.tp END AS text_tp, CASE WHEN c.mode <> 'visual' THEN t.fp END AS text_fp, CASE WHEN c.mode <> 'visual' THEN t.fn END AS text_fn,
    CASE WHEN c.mode = 'visual' THEN r.tp END AS region_tp, CASE WHEN c.mode = 'visual' THEN r.fp END AS region_fp, CASE WHEN c.mode = 'visual' THEN r.fn END AS region_fn
  FROM classes c LEFT JOIN wrong w ON w.case_id = c.case_id AND w.mode = c.mode LEFT JOIN text_count t ON t.case_id = c.case_id LEFT JOIN region_count r ON r.case_id = c.case_id),
mode AS (
  SELECT mode, count(*) AS cases, sum(text_tp) FILTER (text_tp + text_fp + text_fn > 0)::BIGINT AS text_tp, sum(text_fp) FILTER (text_tp + text_fp + text_fn > 0)::BIGINT AS text_fp, sum(text_fn) FILTER (text_tp + text_fp + text_fn > 0)::BIGINT AS text_fn,
    sum(region_tp) FILTER (region_tp + region_fp + region_fn > 0)::BIGINT AS region_tp, sum(region_fp) FILTER (region_tp + region_fp + region_fn > 0)::BIGINT AS region_fp, sum(region_fn) FILTER (region_tp + region_fp + region_fn > 0)::BIGINT AS region_fn,
    sum(pages_total)::BIGINT AS pages_total, sum(pages_correct)::BIGINT AS pages_correct, count(*) FILTER (doc_false_positive) AS false_positive_docs
  FROM score GROUP BY mode),
rated AS (SELECT *, (2 * text_tp) / (2 * text_tp + text_fp + text_fn)::DOUBLE AS text_f1, (2 * region_tp) / (2 * region_tp + region_fp + region_fn)::DOUBLE AS region_f1, pages_correct / pages_total::DOUBLE AS page_accuracy FROM mode)"""

def _rates(tp: str, fp: str, fn: str) -> str:
    return f"""coalesce({tp} / nullif({tp} + {fp}, 0)::DOUBLE, 0) AS "precision", coalesce({tp} / nullif({tp} + {fn}, 0)::DOUBLE, 0) AS recall, coalesce(2 * {tp} / nullif(2 * {tp} + {fp} + {fn}, 0)::DOUBLE, 0) AS f1, {tp} + {fp} + {fn} > 0 AS valid"""


def _one(x: str) -> str:
    """One decimal, half to even on the binary value."""
    return f"coalesce(printf('%.1f', {x}), '')"


def _box(side: str) -> str:
    s = side
    return f"{_one(f'{s}_left')} AS {s}_x, {_one(f'{s}_top')} AS {s}_y, {_one(f'{s}_right - {s}_left')} AS {s}_w, {_one(f'{s}_top - {s}_bottom')} AS {s}_h"


def _corners(s: str) -> str:
    return f"CASE WHEN {s}_left IS NULL THEN '' ELSE printf('(%.1f,%.1f)-(%.1f,%.1f)', {s}_left, {s}_top, {s}_right, {s}_bottom) END AS {s}_box"


def _escape(x: str) -> str:
    return f"""replace(replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;')"""


_WORDS = "list_filter(string_split(coalesce({0}, ''), ' '), lambda w: w <> '')"
_O, _N = _WORDS.format("old_text"), _WORDS.format("new_text")


def _markup(own: str, other: str, tag: str, kind: str, text: str) -> str:
    return f"""CASE WHEN kind = '{kind}' THEN '<{tag}>' || {_escape(text)} || '</{tag}>' WHEN {text} IS NULL THEN ''
      ELSE coalesce(array_to_string(list_transform({own}, lambda w: CASE WHEN list_contains({other}, w) THEN {_escape('w')} ELSE '<{tag}>' || {_escape('w')} || '</{tag}>' END), ' '), '') END"""


def _round(columns: str = "*") -> str:
    return f'{columns} REPLACE (round("left", 3) AS "left", round(top, 3) AS top, round("right", 3) AS "right", round(bottom, 3) AS bottom)'


def sql(ctes: str, select: str) -> str:
    return f"WITH RECURSIVE {ctes}\n{select}"


SEGMENTS = f"""{LINES},
seg AS (SELECT doc_id, page_index, line_index, i - 1 AS word_no, w[i] AS text, (length(array_to_string(w[1:i - 1], ' ')) + CASE WHEN i > 1 THEN 1 ELSE 0 END) * 6::DOUBLE AS "left",
  800 - 14 * line_index + ((doc_id + i - 1) % 2) * 0.5::DOUBLE AS top FROM (SELECT doc_id, page_index, line_index, string_split(text, ' ') AS w, unnest(range(1, len(string_split(text, ' ')) + 1)) AS i FROM line)),
placed AS (SELECT *, "left" + 6 * length(text) AS "right", top - 10 AS bottom, (line_index::BIGINT << 32) + word_no AS seg_id FROM seg)"""

SIDE_LINES = f"""{PAGES},
side_line AS (SELECT pair_id, page_index, s, i - 1 AS line_index, l[i] AS text FROM (SELECT *, unnest(range(1, len(l) + 1)) AS i FROM (
  SELECT pair_id, page_index, 'old' AS s, old_lines AS l FROM side WHERE side = 'common' UNION ALL SELECT pair_id, page_index, 'new', new_lines FROM side WHERE side = 'common'))),
side_word AS (SELECT pair_id, page_index, s, line_index, i - 1 AS word_no, w[i] AS text, (length(array_to_string(w[1:i - 1], ' ')) + CASE WHEN i > 1 THEN 1 ELSE 0 END) * 6::DOUBLE AS l
  FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM (SELECT pair_id, page_index, s, line_index, string_split(text, ' ') AS w FROM side_line))),
side_seg AS (SELECT *, 800 - 14 * line_index + ((pair_id + word_no) % 2) * 0.5::DOUBLE AS t, (line_index::BIGINT << 32) + word_no AS seg_id FROM side_word WHERE trim(text) <> ''),
side_open AS (SELECT *, row_number() OVER (PARTITION BY pair_id, page_index, s ORDER BY t DESC, l, seg_id) AS ord,
  CASE WHEN t < min(t - 10) OVER (PARTITION BY pair_id, page_index, s ORDER BY t DESC, l, seg_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 1 THEN 1 ELSE 0 END AS opens FROM side_seg),
shown_line AS (SELECT pair_id, page_index, s, line, lower(string_agg(text, ' ' ORDER BY ord)) AS k, min(l) AS l, max(t) AS t FROM (SELECT *, sum(opens) OVER (PARTITION BY pair_id, page_index, s ORDER BY ord) AS line FROM side_open) GROUP BY ALL),
shift AS (SELECT a.pair_id, a.page_index, median(b.l - a.l) * 300 / 72 AS x, -median(b.t - a.t) * 300 / 72 AS y FROM shown_line a JOIN shown_line b ON a.pair_id = b.pair_id AND a.page_index = b.page_index AND a.k = b.k WHERE a.s = 'old' AND b.s = 'new' GROUP BY ALL),
text_shift AS (SELECT pair_id, page_index, round(CASE WHEN abs(x) < 1 AND abs(y) < 1 THEN 0 ELSE x END, 3)::DOUBLE AS dx, round(CASE WHEN abs(x) < 1 AND abs(y) < 1 THEN 0 ELSE y END, 3)::DOUBLE AS dy FROM shift)"""


def _axis_of(weights: tuple, p: str) -> str:
    return " + ".join(f"{w}::DOUBLE * {p}{c}" for w, c in zip(weights, "rgb", strict=True))


def _difference(p: str, q: str) -> str:
    """Of two colours, as the column function has it; all cells are opaque."""
    y, i, k = (f"(({_axis_of(w, p)}) - ({_axis_of(w, q)}))" for w in (colour.Y, colour.I, colour.Q))
    return f"sqrt({y} * {y} + 0.48::DOUBLE * {i} * {i} + 0.48::DOUBLE * {k} * {k} + {y} * {y} + 0.3::DOUBLE * {i} * {i} + 0.3::DOUBLE * {k} * {k})"


_WHITE = ", ".join(f"coalesce({{0}}.{c}, 255) AS {{1}}{c}" for c in "rgb")


def _cells(which: str) -> str:
    return f"""
grid_line AS (SELECT pair_id, page_index, s, i - 1 AS y, l[i] AS text FROM (SELECT *, unnest(range(1, len(l) + 1)) AS i FROM (
  SELECT pair_id, page_index, 'old' AS s, old_lines AS l FROM side WHERE side = 'common' AND old_lines <> new_lines AND {which} UNION ALL SELECT pair_id, page_index, 'new', new_lines FROM side WHERE side = 'common' AND old_lines <> new_lines AND {which}))),
grid_word AS (SELECT pair_id, page_index, s, y, i - 1 AS x, length(w[i]) AS n, length(regexp_replace(w[i], '[^A-Za-z]', '', 'g')) AS k FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM (SELECT pair_id, page_index, s, y, string_split(text, ' ') AS w FROM grid_line))),
cell AS MATERIALIZED (SELECT pair_id, page_index, s, x, y, greatest(0, 255 - n * 20) AS r, greatest(0, 255 - k * 20) AS g, greatest(0, 255 - (n - k) * 20) AS b FROM grid_word),
extent AS (SELECT pair_id, page_index, max(x) + 1 AS width, max(y) + 1 AS height FROM cell GROUP BY ALL)"""


MASK = f"""{PAGES},{_cells('true')},
pixel AS (SELECT coalesce(o.pair_id, n.pair_id) AS pair_id, coalesce(o.page_index, n.page_index) AS page_index, coalesce(o.x, n.x) AS x, coalesce(o.y, n.y) AS y, {_WHITE.format('o', 'u')}, {_WHITE.format('n', 'v')}
  FROM (SELECT * FROM cell WHERE s = 'old') o FULL JOIN (SELECT * FROM cell WHERE s = 'new') n ON o.pair_id = n.pair_id AND o.page_index = n.page_index AND o.x = n.x AND o.y = n.y),
centre AS (SELECT p.*, width, height FROM pixel p JOIN extent USING (pair_id, page_index) WHERE {_difference('u', 'v')} > 60),
looked AS (SELECT *, greatest(0, least(x + dx, width - 1)) AS ax, greatest(0, least(y + dy, height - 1)) AS ay FROM centre, range(-2, 3) u(dx), range(-2, 3) v(dy)),
differing AS MATERIALIZED (SELECT q.pair_id, q.page_index, q.x, q.y FROM (SELECT l.pair_id, l.page_index, l.x, l.y, l.ur, l.ug, l.ub, {_WHITE.format('c', 'm')} FROM (SELECT pair_id, page_index, x, y, ax, ay, ur, ug, ub FROM looked) l
  LEFT JOIN cell c ON c.s = 'new' AND c.pair_id = l.pair_id AND c.page_index = l.page_index AND c.x = ax AND c.y = ay) q GROUP BY ALL HAVING min({_difference('q.u', 'q.m')}) > 60),
mask AS (SELECT pair_id, page_index, x, y FROM differing a WHERE (SELECT count(*) FROM differing b WHERE a.pair_id = b.pair_id AND a.page_index = b.page_index AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 AND (a.x <> b.x OR a.y <> b.y)) >= 3)"""

#: Drawings as rectangles, their cells, the new side seen from the old frame, what differs, and the regions of that.
DRAWN = f"""
ids AS (SELECT p, p % 8 AS e, 2 + q * 7 % 6 AS x, 2 + q * 5 % 4 AS y, 10 + q % 4 AS w, 9 + q % 3 AS h FROM (SELECT DISTINCT doc_id AS p, doc_id % 1000 AS q FROM documents WHERE doc_id IS NOT NULL)),
base AS (SELECT p, e, unnest([{{l: 0, x: 45, y: 30, w: 6, h: 4, r: 200, g: 0, b: 0}}, {{l: 1, x: 59, y: 39, w: 1, h: 1, r: 0, g: 0, b: 0}}] || list_transform(range(6), lambda i: {{l: (2 + i)::INT, x: (2 + 10 * (i // 2))::INT, y: (19 + 9 * (i % 2))::INT, w: 9, h: 8, r: 180, g: 180, b: 255}}), recursive := true) FROM ids),
rect AS (
  SELECT p, e, s, l, x, y, w, h, r, g, b FROM base, (VALUES ('old'), ('new')) t(s)
  UNION ALL SELECT p, e, 'old', 8, x, y, w, h, 0, 0, 0 FROM ids WHERE e <> 7 UNION ALL SELECT p, e, 'new', 8, CASE e WHEN 1 THEN x + 26 WHEN 5 THEN x + 1 ELSE x END, y, w, h, 0, 0, 0 FROM ids WHERE e <> 2
  UNION ALL SELECT p, e, 'new', 9, 12, 19, 9, 8, 0, 0, 120 FROM ids WHERE e = 3 UNION ALL SELECT p, e, 'new', 9, 50, 20, 1, 1, 0, 0, 0 FROM ids WHERE e = 6),
flat AS (SELECT p, s, x + i AS x, y + j AS y, arg_max({{r: r, g: g, b: b}}, l) AS c FROM rect, range(14) u(i), range(12) v(j) WHERE i < w AND j < h AND NOT (e = 4 AND s = 'new') GROUP BY ALL),
part AS (SELECT p, s, x + i + 4 AS x, y + j + 3 AS y, (CASE WHEN i < w THEN 0.75::DOUBLE ELSE 0 END + CASE WHEN i > 0 THEN 0.25::DOUBLE ELSE 0 END) * (CASE WHEN j < h THEN 0.5::DOUBLE ELSE 0 END + CASE WHEN j > 0 THEN 0.5::DOUBLE ELSE 0 END) AS z, r, g, b
  FROM rect, range(15) u(i), range(13) v(j) WHERE i <= w AND j <= h AND e = 4 AND s = 'new'),
cell AS MATERIALIZED (SELECT p, s, x, y, c.r AS r, c.g AS g, c.b AS b FROM flat
  UNION ALL SELECT p, s, x, y, round(255 + sum(z * (r - 255)))::INT, round(255 + sum(z * (g - 255)))::INT, round(255 + sum(z * (b - 255)))::INT FROM part WHERE x < 60 AND y < 40 GROUP BY ALL),
spot AS (SELECT p, x, y, dx, dy, least(greatest(x + dx, 0), 59) AS u, least(greatest(y + dy, 0), 39) AS v FROM (SELECT p, i - 2 AS x, j - 2 AS y, CASE WHEN e = 4 THEN 4.25::DOUBLE ELSE 0 END AS dx, CASE WHEN e = 4 THEN 3.5::DOUBLE ELSE 0 END AS dy FROM ids, range(64) m(i), range(44) n(j))),
corner AS (SELECT * FROM (SELECT p, x, y, dx, dy, floor(u)::INT + i AS cx, floor(v)::INT + j AS cy, (1 - abs(u - floor(u) - i)) * (1 - abs(v - floor(v) - j)) AS z FROM spot, range(2) m(i), range(2) n(j)) WHERE z > 0),
sampled AS MATERIALIZED (SELECT k.p, k.x, k.y, any_value(dx) AS dx, any_value(dy) AS dy, round(255 + sum(z * (coalesce(c.r, 255) - 255)))::INT AS mr, round(255 + sum(z * (coalesce(c.g, 255) - 255)))::INT AS mg, round(255 + sum(z * (coalesce(c.b, 255) - 255)))::INT AS mb
  FROM corner k LEFT JOIN cell c ON c.p = k.p AND c.s = 'new' AND c.x = cx AND c.y = cy GROUP BY k.p, k.x, k.y),
centre AS (SELECT * FROM (SELECT m.p, m.x, m.y, coalesce(c.r, 255) AS ur, coalesce(c.g, 255) AS ug, coalesce(c.b, 255) AS ub, mr, mg, mb FROM sampled m LEFT JOIN cell c ON c.p = m.p AND c.s = 'old' AND c.x = m.x AND c.y = m.y
  WHERE m.x >= 0 AND m.y >= 0 AND m.x + dx < 60 AND m.y + dy < 40 AND m.x < 60 AND m.y < 40) WHERE {_difference('u', 'm')} > 60),
differing AS MATERIALIZED (SELECT p, x, y FROM (SELECT c.p, c.x, c.y, ur, ug, ub, m.mr, m.mg, m.mb FROM (SELECT *, x + i - 2 AS ax, y + j - 2 AS ay FROM centre, range(5) u(i), range(5) v(j)) c JOIN sampled m ON m.p = c.p AND m.x = ax AND m.y = ay) GROUP BY p, x, y HAVING min({_difference('u', 'm')}) > 60),
kept AS MATERIALIZED (SELECT a.p, a.x, a.y FROM differing a JOIN differing b ON a.p = b.p AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 AND (a.x <> b.x OR a.y <> b.y) GROUP BY ALL HAVING count(*) >= 3),
walk(p, x, y, a, b) AS (SELECT p, x, y, x, y FROM kept UNION SELECT w.p, w.x, w.y, m.x, m.y FROM walk w JOIN kept m ON w.p = m.p AND abs(w.a - m.x) + abs(w.b - m.y) = 1),
box AS MATERIALIZED (SELECT p AS pair_id, 0::INT AS page_index, c AS region, min(x) * 12.0::DOUBLE AS "left", min(y) * 12.0::DOUBLE AS top, (max(x) + 1) * 12.0::DOUBLE AS "right", (max(y) + 1) * 12.0::DOUBLE AS bottom
  FROM (SELECT p, x, y, min(a * 1000 + b) AS c FROM walk GROUP BY p, x, y) GROUP BY p, c HAVING count(*) >= 8)"""

_LUMA = "0.29889531::DOUBLE * {0}r + 0.58662247::DOUBLE * {0}g + 0.11448223::DOUBLE * {0}b"


def _offset(which: str) -> str:
    return f"""{_cells(which)},
spot AS (SELECT e.pair_id, e.page_index, width, height, x, y, {_LUMA.format('p.')} AS old FROM (SELECT v.pair_id, v.page_index, v.x, v.y, {_WHITE.format('c', '')} FROM
  (SELECT *, unnest(range(0, height, 8)) AS y FROM (SELECT *, unnest(range(0, width, 8)) AS x FROM extent)) v LEFT JOIN cell c ON c.s = 'old' AND c.pair_id = v.pair_id AND c.page_index = v.page_index AND c.x = v.x AND c.y = v.y) p JOIN extent e USING (pair_id, page_index)),
tried AS (SELECT *, least(x + dx, width - 1) AS nx, least(y + dy, height - 1) AS ny FROM (SELECT *, (a - 8) * 0.25::DOUBLE AS dx, (b - 8) * 0.25::DOUBLE AS dy FROM spot, range(17) m(a), range(17) n(b)) WHERE x + dx >= 0 AND y + dy >= 0 AND x + dx < width AND y + dy < height),
corner AS (SELECT *, least(floor(nx)::BIGINT + i, width - 1) AS cx, least(floor(ny)::BIGINT + j, height - 1) AS cy, (CASE i WHEN 1 THEN nx - floor(nx) ELSE 1 - nx + floor(nx) END) * (CASE j WHEN 1 THEN ny - floor(ny) ELSE 1 - ny + floor(ny) END) AS weight FROM tried, range(2) p(i), range(2) q(j)),
mixed AS (SELECT k.pair_id, k.page_index, dx, dy, k.x, k.y, any_value(old) AS old, round(sum(weight * coalesce(c.r, 255))) AS r, round(sum(weight * coalesce(c.g, 255))) AS g, round(sum(weight * coalesce(c.b, 255))) AS b
  FROM corner k LEFT JOIN cell c ON c.s = 'new' AND c.pair_id = k.pair_id AND c.page_index = k.page_index AND c.x = cx AND c.y = cy WHERE weight > 0 GROUP BY ALL),
scored AS (SELECT pair_id, page_index, dx, dy, avg(abs(old - ({_LUMA.format('')}))) AS score FROM mixed GROUP BY ALL),
grid_shift AS (SELECT pair_id, page_index, dx, dy, round(score, 4) AS score FROM scored QUALIFY row_number() OVER (PARTITION BY pair_id, page_index ORDER BY round(score, 9), dx <> 0 OR dy <> 0, dy, dx) = 1)"""


TEXT_PAGE = "text_page AS (SELECT doc_id, page_index, string_agg(text, ' ' ORDER BY line_index) AS text FROM line GROUP BY ALL)"

ORACLES: dict[str, str] = {
    "doc_page_counts": sql(LINES, f"SELECT doc_id, len(l)::BIGINT AS n_lines, ((len(l) + {PAGE_LINES - 1}) // {PAGE_LINES})::BIGINT AS page_count, nullif(trim(source), '') AS title, coalesce(nullif(trim(source), ''), 'Untitled') AS display_title, len(l) = 0 AS rejected FROM docs"),
    "line_normalise": sql(LINES, "SELECT doc_id, line_no, page_index, line_index, text FROM line"),
    "reading_order": sql(SEGMENTS, """SELECT doc_id, page_index, line_index::BIGINT AS line_index, string_agg(text, ' ' ORDER BY ord) AS text, min("left") AS "left", max(top) AS top, max("right") AS "right", min(bottom) AS bottom FROM (
      SELECT *  EXCLUDE line_index, sum(opens) OVER (PARTITION BY doc_id, page_index ORDER BY ord) AS line_index FROM (
        SELECT *, row_number() OVER w AS ord, CASE WHEN top < min(bottom) OVER (PARTITION BY doc_id, page_index ORDER BY top DESC, "left", seg_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 1 THEN 1 ELSE 0 END AS opens
        FROM placed WINDOW w AS (PARTITION BY doc_id, page_index ORDER BY top DESC, "left", seg_id))) GROUP BY ALL"""),
    "revision_pairs": sql(f"{PAGES}", "SELECT pair_id, pair_id || ':old' AS old_doc_id, pair_id || ':new' AS new_doc_id, 'text' AS mode, count(old_lines) AS old_pages, count(new_lines) AS new_pages FROM side GROUP BY pair_id"),
    "page_alignment": sql(PAGES, "SELECT pair_id, page_index, side, coalesce(len(old_lines), 0)::INT AS n_old, coalesce(len(new_lines), 0)::INT AS n_new FROM side"),
    "line_entries": sql(ENTRIES, "SELECT * FROM entry"),
    "line_entries_residual": sql(ENTRIES, """SELECT e.* FROM entry e JOIN keyed k USING (pair_id, page_index) WHERE ok <> nk AND NOT (len(list_distinct(ok)) = len(ok) AND len(list_distinct(nk)) = len(nk)
      AND list_filter(list_transform(ok, lambda x: list_position(nk, x)), lambda p: p > 0) = list_sort(list_filter(list_transform(ok, lambda x: list_position(nk, x)), lambda p: p > 0)))"""),
    "page_status": sql(ENTRIES, "SELECT * FROM status"),
    "page_summary": sql(ENTRIES, "SELECT * FROM summary"),
    "diff_stats": sql(ENTRIES, "SELECT * FROM full_stats"),
    "diff_summary": sql(ENTRIES, "SELECT pair_id, sum(total)::BIGINT AS total, count(*) AS pages, sum(added)::BIGINT AS added, sum(removed)::BIGINT AS removed, sum(modified)::BIGINT AS modified FROM summary WHERE status <> 'match' OR total > 0 GROUP BY pair_id"),
    "overview": sql(ENTRIES, """SELECT pair_id, unnest(['mode', 'time', 'old document', 'new document', 'old pages', 'new pages', 'matching pages', 'modified pages', 'added pages', 'removed pages', 'added entries', 'removed entries', 'modified entries', 'total changes']) AS item,
      unnest([mode, '2024-01-01T00:00:00Z', old_doc_id, new_doc_id, old_pages::VARCHAR, new_pages::VARCHAR, pages_match::VARCHAR, pages_modified::VARCHAR, pages_added::VARCHAR, pages_removed::VARCHAR, entries_added::VARCHAR, entries_removed::VARCHAR, entries_modified::VARCHAR, total_changes::VARCHAR]) AS "value" FROM manifest JOIN stats USING (pair_id)"""),
    "change_list": sql(ENTRIES, f"SELECT pair_id, page_index + 1 AS page, entry_seq, kind, old_line + 1 AS old_line, new_line + 1 AS new_line, old_text, new_text, {_box('old')}, {_box('new')} FROM box"),
    "change_list_csv_cols": sql(ENTRIES, f"SELECT pair_id, page_index + 1 AS page, entry_seq, kind, coalesce((old_line + 1)::VARCHAR, '') AS old_line, coalesce((new_line + 1)::VARCHAR, '') AS new_line, coalesce(old_text, '') AS old_text, coalesce(new_text, '') AS new_text, {_corners('old')}, {_corners('new')} FROM box"),
    "change_filter": sql(ENTRIES, "SELECT pair_id, page_index, entry_seq, kind, old_text, new_text FROM change WHERE kind = 'modified' AND contains(lower(coalesce(old_text, '') || ' ' || coalesce(new_text, '')), 'the')"),
    "change_ordinals": sql(ENTRIES, "SELECT pair_id, page_index, entry_seq, ordinal, ordinal % n + 1 AS next_ordinal, (ordinal + n - 2) % n + 1 AS previous_ordinal FROM (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY page_index, entry_seq) AS ordinal, count(*) OVER (PARTITION BY pair_id) AS n FROM change)"),
    "word_diff": sql(ENTRIES, f"SELECT pair_id, page_index, entry_seq, coalesce(array_to_string(list_filter({_O}, lambda x: NOT list_contains({_N}, x)), ' '), '') AS deleted, coalesce(array_to_string(list_filter({_N}, lambda x: NOT list_contains({_O}, x)), ' '), '') AS inserted FROM change WHERE kind = 'modified'"),
    "word_diff_markup": sql(ENTRIES, f"SELECT pair_id, page_index, entry_seq, kind, {_markup(_O, _N, 'del', 'removed', 'old_text')} AS old_markup, {_markup(_N, _O, 'ins', 'added', 'new_text')} AS new_markup FROM change"),
    "golden_truth": sql(ENTRIES, "SELECT pair_id, page_index + 1 AS page, entry_seq, CASE WHEN kind <> 'added' THEN old_text END AS old_text, CASE WHEN kind <> 'removed' THEN new_text END AS new_text FROM change"),
    "search_hits": sql(f"{LINES}, {TEXT_PAGE}, asked AS (SELECT item_id AS query_id, lower(trim(regexp_replace(text, '{SPACE}', ' ', 'g'))) AS q FROM benchmark)", """
      SELECT query_id, doc_id, page_index, ((length(lower(text)) - length(replace(lower(text), q, ''))) // length(q))::BIGINT AS match_count,
        CASE WHEN instr(lower(text), q) > 41 THEN '...' ELSE '' END || trim(substring(text, greatest(instr(lower(text), q) - 41, 0) + 1, least(instr(lower(text), q) - 1 + length(q) + 40, length(text)) - greatest(instr(lower(text), q) - 41, 0))) AS snippet
      FROM text_page JOIN asked ON contains(lower(text), q) WHERE trim(q) <> ''"""),
    "report_time": "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS time FROM events",
    "recent_pairs": "SELECT user_id, event_type, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS time, place FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_type) AS place FROM (SELECT user_id, event_type, max(ts) AS ts FROM events WHERE user_id IS NOT NULL GROUP BY ALL)) WHERE place <= 3",
    "url_paths": f"""SELECT page_id, base AS base_name, lower(regexp_extract(base, '\\.([^.]*)$', 1)) AS extension, {_escape('url')} AS escaped FROM (SELECT *, CASE WHEN regexp_extract(url, '[^/\\\\]*$') = '' THEN url ELSE regexp_extract(url, '[^/\\\\]*$') END AS base FROM pages)""",
    "label_prf": f"SELECT tp, fp, fn, {_rates('tp', 'fp', 'fn')} FROM (SELECT count(*) FILTER (quality = 1 AND toxic = 1) AS tp, count(*) FILTER (quality <> 1 AND toxic = 1) AS fp, count(*) FILTER (quality = 1 AND toxic <> 1) AS fn FROM labels)",
    "drawing_regions": f"""WITH RECURSIVE {DRAWN} SELECT pair_id, page_index, "left", top, "right", bottom FROM box""",
    "drawing_comparison": f"""WITH RECURSIVE {DRAWN},
mode(mode) AS (VALUES ('text'), ('visual'), ('hybrid'))
SELECT p AS pair_id, mode, 0::INT AS page_index, CASE WHEN mode <> 'text' AND p IN (SELECT pair_id FROM box) THEN 'modified' ELSE 'match' END AS status FROM ids, mode""",
    "drawing_scores": f"""WITH RECURSIVE {DRAWN},
made AS (SELECT p AS case_id, k, x * 12.0::DOUBLE AS tl, y * 12.0::DOUBLE AS tt, (x + w) * 12.0::DOUBLE AS tr, (y + h) * 12.0::DOUBLE AS tb FROM (
  SELECT p, 0 AS k, x, y, w, h FROM ids WHERE e IN (1, 2, 5, 7) UNION ALL SELECT p, 1, x + 26, y, w, h FROM ids WHERE e = 1 UNION ALL SELECT p, 0, 12, 19, 9, 8 FROM ids WHERE e = 3)),
hit AS (SELECT case_id, k, b.region AS d FROM made JOIN box b ON b.pair_id = case_id WHERE least(tr, b."right") > greatest(tl, b."left") AND least(tb, bottom) > greatest(tt, top)
  AND (least(tr, b."right") - greatest(tl, b."left")) * (least(tb, bottom) - greatest(tt, top)) >= 0.5 * least((tr - tl) * (tb - tt), (b."right" - b."left") * (bottom - top))),
t AS (SELECT case_id % 8 AS edit, count(*) AS n, count(*) FILTER ((case_id, k) IN (SELECT (case_id, k) FROM hit)) AS tp FROM made GROUP BY 1),
d AS (SELECT pair_id % 8 AS edit, count(*) AS n, count(*) FILTER ((pair_id, region) IN (SELECT (case_id, d) FROM hit)) AS ok FROM box GROUP BY 1),
sums AS (SELECT edit, coalesce(tp, 0) AS tp, coalesce(d.n, 0) - coalesce(ok, 0) AS fp, coalesce(t.n, 0) - coalesce(tp, 0) AS fn FROM t FULL JOIN d USING (edit))
SELECT edit, tp, fp, fn, coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0) AS precision, coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0) AS recall, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 0) AS f1, tp + fp + fn > 0 AS valid FROM sums""",
    "page_metadata": f"""WITH given AS (SELECT page_id AS doc_id, len(list_filter(list_transform(string_split(coalesce(html, ''), chr(10)), lambda x: {BLANKS}), lambda x: x <> ''))::BIGINT AS n,
  CASE WHEN page_id % 3 > 0 THEN nullif({BLANKS.replace("(x,", "(regexp_extract(html, '<title>([^<]*)</title>', 1),")}, '') END AS title, nullif({BLANKS.replace("(x,", "(regexp_extract(html, '<html lang=\"([^\"]*)\"', 1),")}, '') AS subject,
  nullif(CASE WHEN regexp_extract(url, '[^/\\\\]*$') = '' THEN url ELSE regexp_extract(url, '[^/\\\\]*$') END, '') AS name FROM pages)
SELECT doc_id, n AS n_lines, (n + {PAGE_LINES - 1}) // {PAGE_LINES} AS page_count, title, NULL::VARCHAR AS author, subject, coalesce(title, name, 'Untitled') AS display_title, n = 0 AS rejected FROM given""",
    "document_diff": f"""WITH RECURSIVE {PAGES},
whole AS (SELECT pair_id, flatten(list(coalesce(old_lines, []) ORDER BY page_index)) AS o, flatten(list(coalesce(new_lines, []) ORDER BY page_index)) AS n FROM pair GROUP BY pair_id),
keyed AS MATERIALIZED (SELECT pair_id, list_transform(o, lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')) AS ok, list_transform(n, lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')) AS nk FROM whole),
grown(pair_id, i, prev) AS (
  SELECT pair_id, 0, list_transform(range(len(nk) + 1), lambda x: 0::BIGINT) FROM keyed
  UNION ALL SELECT g.pair_id, i + 1, list_reduce(range(1, len(nk) + 1), lambda acc, j: list_append(acc, CASE WHEN ok[i + 1] = nk[j] THEN prev[j] + 1 ELSE greatest(prev[j + 1], acc[j]) END), [0::BIGINT])
  FROM grown g JOIN keyed USING (pair_id) WHERE i < len(ok))
SELECT pair_id, len(ok)::BIGINT AS n_old, len(nk)::BIGINT AS n_new, prev[-1] AS n_kept, (len(ok) + len(nk) - 2 * prev[-1])::BIGINT AS n_edits FROM grown JOIN keyed USING (pair_id) WHERE i = len(ok)""",
    "compare_rejects": f"""WITH {LINES}, has AS (SELECT DISTINCT doc_id FROM line),
asked AS (SELECT doc_id AS pair_id, doc_id IN (FROM has) AS o, doc_id * 3 + 1 IN (FROM has) AS n FROM documents WHERE doc_id IS NOT NULL)
SELECT DISTINCT pair_id, 'text' AS mode, CASE WHEN o THEN 'new' WHEN n THEN 'old' ELSE 'both' END AS reason FROM asked WHERE NOT (o AND n)""",
    "outline_order": f"""WITH RECURSIVE {_TURNS}
SELECT outline_id, node_id, parent_id, coalesce(nullif({BLANKS.replace("(x,", "(title,")}, ''), '(Untitled)') AS title, level, row_number() OVER (PARTITION BY outline_id ORDER BY path) - 1 AS position,
  CASE WHEN page_index < page_count THEN page_index END AS page_index FROM down JOIN many USING (outline_id)""",
    "outline_rejects": f"""WITH RECURSIVE {_TURNS}
SELECT outline_id, node_id, parent_id, CASE WHEN outline_id % 11 = 5 THEN 'cycle' ELSE 'orphan' END AS reason FROM node ANTI JOIN down USING (outline_id, node_id)""",
    "outline_levels": """WITH RECURSIVE node AS (SELECT 'r' || r_regionkey AS node_id, NULL::VARCHAR AS parent_id, r_name AS title FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_name FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, c_name FROM customer),
      tree(node_id, parent_id, title, level, path) AS (SELECT node_id, parent_id, title, 0, node_id FROM node WHERE parent_id IS NULL UNION ALL SELECT n.node_id, n.parent_id, n.title, level + 1, path || '/' || n.node_id FROM node n JOIN tree t ON n.parent_id = t.node_id)
      SELECT node_id, parent_id, coalesce(nullif(trim(title), ''), '(Untitled)') AS title, level, path FROM tree""",
    "text_offset": sql(SIDE_LINES, "SELECT pair_id, page_index, dx, dy FROM text_shift"),
    "page_offset": sql(f"{SIDE_LINES},{_offset('(pair_id, page_index) NOT IN (SELECT (pair_id, page_index) FROM text_shift)')},both_shifts AS (SELECT pair_id, page_index, dx, dy FROM text_shift UNION ALL SELECT pair_id, page_index, dx, dy FROM grid_shift)",
      "SELECT pair_id, page_index, CASE WHEN none THEN 0 ELSE dx END AS dx, CASE WHEN none THEN 0 ELSE dy END AS dy FROM (SELECT *, abs(dx) < 1 AND abs(dy) < 1 OR abs(dx) > 612 * 300 / 72 / 8 OR abs(dy) > 842 * 300 / 72 / 8 AS none FROM both_shifts)"),
    "merged_regions": sql(REGIONS, f"SELECT {_round()} FROM merged"),
    "visual_entries": sql(REGIONS, f"SELECT {_round('* EXCLUDE n_boxes')}, 'modified' AS kind FROM merged"),
    "hybrid_entries": sql(f"{REGIONS},{_MODES}", f"""SELECT pair_id, page_index, origin, kind, old_text, new_text, "left", top, "right", bottom FROM (SELECT {_round()} FROM found) WHERE mode = 'hybrid'"""),
    "compare_pages": sql(COMPARED, "SELECT pair_id, mode, page_index, status FROM mode_page"),
    "compare_entries": sql(COMPARED, f"SELECT {_round()} FROM found"),
    "compare_stats": sql(COMPARED, "SELECT * FROM mode_stats"),
    "truth_tables": sql(CASES, "SELECT case_id, page_index + 1 AS page, mode, status FROM expected"),
    "truth_regions": sql(f"{PAGES},{_TRUTH}", "SELECT * FROM truth_region"),
    "case_list": sql(f"{PAGES},{_TRUTH}", "SELECT 'case ' || case_id AS name, string_agg(DISTINCT status, ', ' ORDER BY status) AS description FROM truth_page GROUP BY case_id"),
    "text_scores": sql(CASES, f"SELECT case_id, mode, text_tp AS tp, text_fp AS fp, text_fn AS fn, {_rates('text_tp', 'text_fp', 'text_fn')} FROM score WHERE text_tp IS NOT NULL"),
    "region_scores": sql(CASES, "SELECT case_id, tp, fp, fn FROM region_count"),
    "page_accuracy": sql(CASES, "SELECT case_id, mode, pages_total, pages_correct, pages_correct / pages_total::DOUBLE AS page_accuracy FROM classes"),
    "false_positive_docs": sql(CASES, "SELECT * FROM wrong"),
    "case_prf": sql(CASES, """SELECT case_id, mode, CASE WHEN tp + fp + fn > 0 THEN printf('%.3f / %.3f / %.3f', coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0), coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0), 2 * tp / (2 * tp + fp + fn)::DOUBLE) ELSE 'n/a' END AS prf
      FROM (SELECT case_id, mode, coalesce(text_tp, region_tp) AS tp, coalesce(text_fp, region_fp) AS fp, coalesce(text_fn, region_fn) AS fn FROM score)"""),
    "mode_summary": sql(CASES, "SELECT * FROM rated"),
    "gate": sql(CASES, "SELECT 'text_f1' AS metric, min(text_f1) AS \"value\", 0.9::DOUBLE AS threshold, coalesce(min(text_f1) >= 0.9, true) AS passed FROM rated UNION ALL SELECT 'visual_region_f1', min(region_f1) FILTER (mode = 'visual'), 0.85::DOUBLE, coalesce(min(region_f1) FILTER (mode = 'visual') >= 0.85, true) FROM rated"),
    "eval_tsv": sql(CASES, """SELECT case_id::VARCHAR AS "case", mode, coalesce(CASE WHEN text_tp + text_fp + text_fn > 0 THEN printf('%.3f', 2 * text_tp / (2 * text_tp + text_fp + text_fn)::DOUBLE) END, 'n/a') AS text_f1,
      coalesce(CASE WHEN region_tp + region_fp + region_fn > 0 THEN printf('%.3f', 2 * region_tp / (2 * region_tp + region_fp + region_fn)::DOUBLE) END, 'n/a') AS region_f1, printf('%.4f', pages_correct / pages_total::DOUBLE) AS page_acc, doc_false_positive::INT::VARCHAR AS fp_doc FROM score"""),
    "eval_summary": sql(CASES, "SELECT mode, cases, coalesce(printf('%.3f', text_f1), 'n/a') AS text_f1, coalesce(printf('%.3f', region_f1), 'n/a') AS region_f1, printf('%.4f', page_accuracy) AS page_acc, false_positive_docs AS fp_docs FROM rated"),
    "grid_mask": sql(MASK, "SELECT pair_id, page_index, x::INT AS x, y::INT AS y FROM mask"),
    "grid_regions": sql(f"{MASK}, walk(pair_id, page_index, x, y, a, b) AS (SELECT pair_id, page_index, x, y, x, y FROM mask UNION SELECT w.pair_id, w.page_index, w.x, w.y, m.x, m.y FROM walk w JOIN mask m ON w.pair_id = m.pair_id AND w.page_index = m.page_index AND abs(w.a - m.x) + abs(w.b - m.y) = 1), named AS (SELECT pair_id, page_index, x, y, min(a * 100000 + b) AS c FROM walk GROUP BY ALL)",
      'SELECT pair_id, page_index, round(min(x) * 0.24::DOUBLE, 3) AS "left", round(min(y) * 0.24::DOUBLE, 3) AS top, round((max(x) + 1) * 0.24::DOUBLE, 3) AS "right", round((max(y) + 1) * 0.24::DOUBLE, 3) AS bottom, count(*) AS n_cells FROM named GROUP BY pair_id, page_index, c HAVING count(*) >= 8'),
    "grid_offset": sql(f"{PAGES},{_offset('true')}", "SELECT pair_id, page_index, dx, dy, score FROM grid_shift"),
    "report_changes": sql(COMPARED, f"""SELECT f.pair_id, mode, f.page_index + 1 AS page, f.kind, f.old_line + 1 AS old_line, f.new_line + 1 AS new_line, f.old_text, f.new_text, CASE WHEN origin = 'text' THEN {_corners('old').split(' AS old_box')[0]} ELSE '' END AS old_box,
      CASE WHEN origin = 'text' THEN {_corners('new').split(' AS new_box')[0]} ELSE printf('(%.1f,%.1f)-(%.1f,%.1f)', "left", top, "right", bottom) END AS new_box, CASE WHEN origin = 'text' THEN 0 ELSE 1 END AS regions FROM found f LEFT JOIN box USING (pair_id, page_index, entry_seq)"""),
}
