"""DuckDB SQL of the queries that SQL can express, by plain joins instead of the operators' methods."""

from __future__ import annotations

from .curriculum import BASE_WEIGHTS, CAP, stated_schedules
from .decontaminate import WINDOW
from .secrets import BASE, RULES
from .trie import SHARE

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(text: str) -> str:
    return rf"regexp_extract_all(translate(coalesce({text}, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


DECONTAMINATE = f"""
WITH d AS MATERIALIZED (SELECT doc_id, {_words('text')} AS w FROM documents),
b AS (SELECT item_id, {_words('text')} AS w FROM benchmark),
win AS MATERIALIZED (
  SELECT DISTINCT item_id, m, array_to_string(w[i:i + m - 1], ' ') AS g
  FROM (SELECT item_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM (SELECT *, least({WINDOW}, len(w)) AS m FROM b) s WHERE m > 0) t),
dw AS (SELECT doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') AS g
       FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, (SELECT DISTINCT m FROM win) l WHERE len(w) >= m) t),
hits AS MATERIALIZED (SELECT dw.doc_id, dw.i, dw.m, win.item_id FROM dw JOIN win ON win.m = dw.m AND win.g = dw.g),
places AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM hits) h GROUP BY doc_id),
items AS (SELECT doc_id, list(DISTINCT CAST(item_id AS VARCHAR)) AS ids FROM hits WHERE item_id IS NOT NULL GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(p.n, 0) AS n_hit, CAST(coalesce(len(i.ids), 0) AS BIGINT) AS n_items,
       sha256(coalesce(array_to_string(list_sort(i.ids), ','), '')) AS items_sha256, coalesce(p.n, 0) > 0 AS contaminated
FROM d LEFT JOIN places p ON p.doc_id = d.doc_id LEFT JOIN items i ON i.doc_id = d.doc_id
"""


def _pattern(rule) -> str:
    """The rule's pattern with the word's letters in either case spelt out (RE2's flag would fold more)."""
    text = rule.pattern
    if rule.ignore_case:
        head, mark, rest = text.partition(")")
        text = "".join(f"[{c.upper()}{c}]" if c.islower() else c for c in head) + mark + rest
    return text.replace("'", "''")


def _secrets() -> str:
    kinds = []
    for k, r in enumerate(RULES):
        size = f"length(regexp_extract(m, '{_pattern(r)}', {r.group}))" if r.group else "length(m)"
        kinds.append(f"""
SELECT doc_id, {k} AS k, '{r.kind}' AS kind, start, start + length(m) AS stop FROM (
  SELECT doc_id, ms[i] AS m, list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS start
  FROM (SELECT doc_id, ms, gaps, unnest(range(1, len(ms) + 1)) AS i FROM (
    SELECT doc_id, regexp_extract_all(text, '{_pattern(r)}') AS ms, string_split_regex(text, '{_pattern(r)}') AS gaps FROM t) a) b) c
WHERE {size} >= {r.least}""")
    text = "kind || ':' || CAST(start AS BIGINT) || ':' || CAST(stop AS BIGINT)"
    n = ", ".join(f"coalesce(count(*) FILTER (kind = '{kind}'), 0) AS n_{kind}" for kind in BASE)
    return f"""
WITH t AS MATERIALIZED (SELECT doc_id, coalesce(text, '') AS text FROM documents),
s AS MATERIALIZED ({' UNION ALL '.join(kinds)}),
g AS (SELECT doc_id, {n}, string_agg({text}, ',' ORDER BY start, k) FILTER (k < {len(BASE)}) AS base, string_agg({text}, ',' ORDER BY start, k) AS spans FROM s GROUP BY doc_id)
SELECT t.doc_id, {', '.join(f'coalesce(g.n_{kind}, 0) AS n_{kind}' for kind in BASE)}, sha256(coalesce(g.base, '')) AS base_sha256, coalesce(g.spans, '') AS spans
FROM t LEFT JOIN g ON g.doc_id = t.doc_id
"""


SECRETS = _secrets()

_LINES = r"string_split_regex({0}, '\r\n|\r|\n')"
_QUOTED = r"regexp_matches(x, '^[ \t]*>')"
_NORMAL = r"trim(regexp_replace(lower({0}), '\s+', ' ', 'g'))"


def _units(text: str) -> str:
    parts = rf"list_concat([{text}], list_concat(string_split_regex({text}, '(\r?\n[ \t]*){{2,}}'), {_LINES.format(text)}))"
    return f"list_distinct(list_filter(list_transform({parts}, lambda x: {_NORMAL.format('x')}), lambda x: length(x) > 0))"


CHAT = rf"""
WITH RECURSIVE m AS MATERIALIZED (
  SELECT coalesce(conv_id, -9223372036854775808) AS conv, coalesce(turn, -1) AS t, conv_id, turn, role, text,
         len(list_filter({_LINES.format('text')}, lambda x: {_QUOTED})) > 0 AS quoting FROM conversations),
o AS MATERIALIZED (
  SELECT *, CASE WHEN quoting THEN regexp_replace(array_to_string(list_filter({_LINES.format('text')}, lambda x: NOT {_QUOTED}), chr(10)), '^\s*\n|\s+$', '', 'g')
                 ELSE text END AS own FROM m),
lines AS (SELECT conv, t, text, unnest({_LINES.format('text')}) AS line, unnest(range(1, len({_LINES.format('text')}) + 1)) AS nr
          FROM (SELECT DISTINCT conv, t, text FROM m WHERE quoting) q),
levels AS (SELECT *, length(regexp_extract(line, '^([ \t]*>)+[ \t]?')) - length(replace(regexp_extract(line, '^([ \t]*>)+[ \t]?'), '>', '')) AS level FROM lines),
starts AS (SELECT *, CASE WHEN level = lag(level) OVER (PARTITION BY conv, t, text ORDER BY nr) THEN 0 ELSE 1 END AS new FROM levels),
runs AS (SELECT *, sum(new) OVER (PARTITION BY conv, t, text ORDER BY nr) AS run FROM starts),
passages AS (SELECT conv, t, level, string_agg(regexp_replace(line, '^([ \t]*>)+[ \t]?', ''), chr(10) ORDER BY nr) AS passage
             FROM runs WHERE level > 0 GROUP BY conv, t, text, run, level),
asked AS (SELECT DISTINCT conv, t, level, passage, unnest({_units('passage')}) AS unit FROM passages),
held AS (SELECT DISTINCT conv, t, unnest({_units('own')}) AS unit FROM o WHERE own IS NOT NULL),
found AS (SELECT a.conv, a.t, a.level, a.passage, length(a.unit) AS size, max(h.t) AS source
          FROM asked a JOIN held h ON h.conv = a.conv AND h.unit = a.unit AND h.t < a.t GROUP BY a.conv, a.t, a.level, a.passage, a.unit),
best AS (SELECT *, row_number() OVER (PARTITION BY conv, t, level, passage ORDER BY size DESC, source DESC) AS rk FROM found),
links AS MATERIALIZED (
  SELECT conv, t, count(*) AS linked, (list(source ORDER BY level, size DESC, source DESC))[1] AS parent FROM best WHERE rk = 1 GROUP BY conv, t),
up AS (SELECT conv, t, parent AS root FROM links
       UNION ALL SELECT up.conv, up.t, l.parent FROM up JOIN links l ON l.conv = up.conv AND l.t = up.root),
roots AS (SELECT conv, t, min(root) AS root FROM up GROUP BY conv, t)
SELECT o.conv_id, o.turn, o.role, l.parent, coalesce(r.root, o.t) AS root, coalesce(l.linked, 0) AS linked,
       row_number() OVER (PARTITION BY o.conv ORDER BY coalesce(r.root, o.t), o.t, o.role NULLS FIRST, o.own NULLS FIRST) - 1 AS reply_pos, o.own AS text
FROM o LEFT JOIN links l ON l.conv = o.conv AND l.t = o.t LEFT JOIN roots r ON r.conv = o.conv AND r.t = o.t
"""


def _time_of(part: str) -> str:
    """The stated schedules' time of a share of their integral, one CASE branch a schedule and piece."""
    branches = []
    for k, knots in enumerate(stated_schedules()):
        whole, behind = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:], strict=False)), 0.0
        for (t0, w0), (t1, w1) in zip(knots, knots[1:], strict=False):
            ahead = behind + (t1 - t0) * (w0 + w1) / 2
            more = f"({part} * {whole!r}::DOUBLE - {behind!r}::DOUBLE)"
            root = f"sqrt({w0 * w0!r}::DOUBLE + {2 * (w1 - w0) / (t1 - t0)!r}::DOUBLE * {more})"
            branches.append(f"WHEN kind = {k} AND {part} * {whole!r}::DOUBLE < {ahead!r}::DOUBLE THEN {t0!r}::DOUBLE + 2 * {more} / ({w0!r}::DOUBLE + {root})")
            behind = ahead
    return f"CASE {' '.join(branches)} ELSE 1.0::DOUBLE END"


MIX = rf"""
WITH d AS MATERIALIZED (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, md5(concat_ws(':', CAST(doc_id AS VARCHAR), coalesce(text, ''))) AS o FROM documents),
s AS (SELECT source, sum(size) AS ssize, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rk FROM d GROUP BY source),
w AS MATERIALIZED (SELECT *, rk % {len(BASE_WEIGHTS)} AS kind, [{', '.join(f'{x!r}::DOUBLE' for x in BASE_WEIGHTS)}][rk % {len(BASE_WEIGHTS)} + 1] AS weight FROM s),
r AS (SELECT *, {CAP} * ssize / weight AS brim, row_number() OVER (ORDER BY {CAP} * ssize / weight, rk) AS nr FROM w),
l AS (SELECT a.nr, a.brim, ((SELECT sum(ssize) FROM w) - coalesce((SELECT sum({CAP} * b.ssize) FROM r b WHERE b.nr < a.nr), 0))
             / (SELECT sum(b.weight) FROM r b WHERE b.nr >= a.nr) AS level FROM r a),
t AS MATERIALIZED (SELECT w.*, least({CAP}.0::DOUBLE * ssize, weight * (SELECT level FROM l WHERE level <= brim ORDER BY nr LIMIT 1)) AS target FROM w),
c AS (SELECT d.*, t.ssize, t.target, t.kind, floor(t.target + 0.5) AS asked,
             sum(d.size) OVER (PARTITION BY t.rk ORDER BY d.o, d.size ROWS UNBOUNDED PRECEDING) - d.size AS start FROM d JOIN t ON t.source IS NOT DISTINCT FROM d.source),
e AS (SELECT *, CASE WHEN target > 0 THEN start / target ELSE 0 END AS part,
             {' + '.join(f'greatest(least(size, asked - {i} * ssize - start), 0)' for i in range(CAP))} AS taken,
             {' + '.join(f'CASE WHEN size > 0 AND asked - {i} * ssize - start > 0 THEN 1 ELSE 0 END' for i in range(CAP))} AS n_copies FROM c)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(ssize AS BIGINT) AS source_size, CAST(target AS DOUBLE) AS target, CAST(taken AS BIGINT) AS taken, CAST(n_copies AS BIGINT) AS n_copies,
       CASE WHEN n_copies > 0 THEN {_time_of('part')} END AS position FROM e
"""


def _crc32(text: str) -> str:
    """CRC-32 of an ASCII text, bit by bit."""
    byte = "list_reduce(list_concat([xor(c, b)], [0, 0, 0, 0, 0, 0, 0, 0]), lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))"
    return f"xor(list_reduce(list_concat([4294967295], list_transform(string_split({text}, ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda c, b: {byte}), 4294967295)"


TRIE = rf"""
WITH m AS MATERIALIZED (
  SELECT conv_id AS c, turn, coalesce(role, '') AS role, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS g,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words FROM conversations WHERE conv_id IS NOT NULL),
t AS MATERIALIZED (SELECT c, g, words, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, g) - 1 AS pos FROM m),
ids AS MATERIALIZED (SELECT c, c - c % {SHARE} AS base, {_crc32('CAST(c AS VARCHAR)')} % 4 AS h FROM (SELECT DISTINCT c FROM t) x),
built AS (SELECT i.c, t.pos, t.g, t.words FROM ids i JOIN t ON t.c = i.base AND t.pos < i.h UNION ALL SELECT i.c, t.pos, t.g, t.words FROM ids i JOIN t ON t.c = i.c AND t.pos >= i.h),
lists AS MATERIALIZED (SELECT i.c, coalesce(list(b.g ORDER BY b.pos) FILTER (b.g IS NOT NULL), []) AS gs, coalesce(list(b.words ORDER BY b.pos) FILTER (b.g IS NOT NULL), []) AS ws FROM ids i LEFT JOIN built b ON b.c = i.c GROUP BY i.c),
pre AS MATERIALIZED (SELECT c, d, array_to_string(gs[1:d], ',') AS k, array_to_string(gs[1:d - 1], ',') AS up, CASE WHEN d > 0 THEN ws[d] ELSE 0 END AS words, d = len(gs) AS ends
                     FROM (SELECT *, unnest(range(0, len(gs) + 1)) AS d FROM lists) x),
node AS MATERIALIZED (SELECT k, d, any_value(up) AS up, min(c) AS c, count(*) AS n, any_value(words) AS words, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (ends) AS ends FROM pre GROUP BY k, d),
kids AS (SELECT up, d - 1 AS d, count(*) AS n FROM node WHERE d > 0 GROUP BY 1, 2),
sub AS (SELECT p.k, p.d, sum((v.n - 1) * v.words) AS saved, count(*) FILTER (x.n IS NULL) AS leaves
        FROM node v JOIN pre p ON p.c = v.c AND p.d <= v.d LEFT JOIN kids x ON x.up = v.k AND x.d = v.d GROUP BY 1, 2)
SELECT v.c AS conv_id, CAST(v.d AS BIGINT) AS depth, a.c AS parent_conv_id, v.n AS n_convs, coalesce(x.n, 0) AS n_children, s.leaves AS n_leaves,
       CAST(s.saved AS BIGINT) AS saved_tokens, sha256(coalesce(v.ends, '')) AS ends_sha256
FROM node v JOIN sub s ON s.k = v.k AND s.d = v.d LEFT JOIN kids x ON x.up = v.k AND x.d = v.d LEFT JOIN node a ON a.k = v.up AND a.d = v.d - 1
"""


def _step(state: str, cost: str, edit: str) -> str:
    return f"{{'s': {state}, 'c': c + {cost}, 'a': a || '{edit}'}}"


_FOLLOW = "CASE WHEN s = 2 THEN 3 ELSE 2 END"
_SPACES = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
#: Insertions at one place: none, one or two (a third one only leads back).
_INSERTED = f"[e, {{'s': CASE WHEN e.s = 2 THEN 3 ELSE 2 END, 'c': e.c + 5, 'a': e.a || 'I'}}, {{'s': CASE WHEN e.s = 2 THEN 2 ELSE 3 END, 'c': e.c + 10, 'a': e.a || 'II'}}]"

#: The least (cost, audit) of every place and state, message by message; a state is 0 (nothing), 1 (system), 2 (user) or 3 (assistant).
REPAIR = rf"""
WITH RECURSIVE named AS (SELECT DISTINCT conv_id, turn, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS nm FROM conversations),
kinds AS MATERIALIZED (SELECT conv_id, turn, {_crc32('nm')} % 20 AS kind FROM named),
dm AS MATERIALIZED (
  SELECT m.conv_id, m.turn, CASE WHEN k.kind = 4 THEN 'user' ELSE coalesce(m.role, ' ') END AS role,
         CASE k.kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(coalesce(m.text, ' '), '[.!?]', '', 'g') ELSE coalesce(m.text, ' ') END AS text,
         unnest(CASE WHEN k.kind = 3 THEN [0, 1] ELSE [0] END) AS twice
  FROM conversations m JOIN kinds k ON k.conv_id IS NOT DISTINCT FROM m.conv_id AND k.turn IS NOT DISTINCT FROM m.turn WHERE k.kind <> 0),
pl AS (SELECT coalesce(CAST(conv_id AS VARCHAR), ' ') AS conv, turn, role, text, rtrim(text, {_SPACES}) AS stem,
              row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS pos FROM dm),
fl AS MATERIALIZED (
  SELECT *, CASE WHEN stem = '' THEN 'b' WHEN row_number() OVER (PARTITION BY conv, role, text ORDER BY pos) > 1 THEN 'd' WHEN right(stem, 1) IN ('.', '!', '?') THEN 'o' ELSE 't' END AS f,
         CASE WHEN role[1] IN ('s', 'u', 'a') THEN role[1] ELSE '-' END AS i, lag(role[1]) OVER (PARTITION BY conv ORDER BY pos) || role[1] AS pair FROM pl),
cv AS MATERIALIZED (
  SELECT conv, count(*) AS n, list(f ORDER BY pos) AS fs, list(i ORDER BY pos) AS ins, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (f = 'b') AS blank, count(*) FILTER (f = 'd') AS duplicate, count(*) FILTER (f = 't') AS truncated,
         count(*) FILTER (pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au')) AS illegal FROM fl GROUP BY conv),
dp AS (
  SELECT conv, 0 AS at_, e.s AS s, e.c AS c, e.a AS a FROM (SELECT conv, unnest([{{'s': 0, 'c': 0, 'a': ''}}, {{'s': 2, 'c': 5, 'a': 'I'}}, {{'s': 3, 'c': 10, 'a': 'II'}}]) AS e FROM cv) x
  UNION ALL
  SELECT conv, at_, s, best['c'], best['a'] FROM (SELECT conv, at_, z['s'] AS s, min({{'c': z['c'], 'a': z['a']}}) AS best FROM (
    SELECT conv, at_, unnest({_INSERTED}) AS z FROM (
      SELECT conv, at_, unnest([{_step('s', '2', 'D')},
        CASE WHEN f IN ('o', 't') AND ((s = 0 AND i IN ('s', 'u')) OR (s IN (1, 3) AND i = 'u') OR (s = 2 AND i = 'a'))
             THEN {_step("CASE i WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END", "CASE WHEN f = 't' THEN 5 ELSE 0 END", 'K')} END,
        CASE WHEN f IN ('o', 't') THEN {_step(_FOLLOW, "1 + CASE WHEN f = 't' THEN 5 ELSE 0 END", 'R')} END]) AS e
      FROM (SELECT dp.conv, dp.at_ + 1 AS at_, dp.s, dp.c, dp.a, cv.fs[dp.at_ + 1] AS f, cv.ins[dp.at_ + 1] AS i FROM dp JOIN cv ON cv.conv = dp.conv AND dp.at_ < cv.n) q) w WHERE e IS NOT NULL) v
  GROUP BY conv, at_, z['s']) y),
fin AS MATERIALIZED (SELECT cv.conv, min({{'c': dp.c, 'a': dp.a}}) AS best FROM dp JOIN cv ON cv.conv = dp.conv AND dp.at_ = cv.n WHERE dp.s IN (0, 3) GROUP BY cv.conv),
ops AS (SELECT conv, nr, best.a[nr] AS op, nr - length(replace(best.a[1:nr], 'I', '')) AS ahead FROM (SELECT *, unnest(range(1, length(best.a) + 1)) AS nr FROM fin) x),
kept AS (SELECT o.conv, o.nr, o.op, fl.role, CASE WHEN o.op = 'I' THEN '' ELSE fl.text END AS text, row_number() OVER (PARTITION BY o.conv ORDER BY o.nr) AS k,
                max(CASE WHEN o.op = 'K' AND fl.role[1] = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY o.conv) AS led
         FROM ops o LEFT JOIN fl ON fl.conv = o.conv AND fl.pos = o.nr - o.ahead AND o.op <> 'I' WHERE o.op <> 'D'),
said AS (SELECT conv, string_agg(CASE WHEN op = 'K' THEN role WHEN (k - led) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY nr) AS lines FROM kept GROUP BY conv)
SELECT d.conv_id, CAST(coalesce(cv.gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(cv.blank, 0) AS BIGINT) AS blank, CAST(coalesce(cv.duplicate, 0) AS BIGINT) AS duplicate,
       CAST(coalesce(cv.truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(cv.illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(fin.best.c, 0) AS BIGINT) AS cost,
       coalesce(fin.best.a, '') AS audit, sha256(coalesce(said.lines, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, coalesce(CAST(conv_id AS VARCHAR), ' ') AS conv FROM conversations) d
LEFT JOIN cv ON cv.conv = d.conv LEFT JOIN fin ON fin.conv = d.conv LEFT JOIN said ON said.conv = d.conv
"""
