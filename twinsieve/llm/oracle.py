"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

from twinsieve.llm import licenses, mixing

WS = r"\x20\x09-\x0D"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


OP1 = rf"""
WITH marked AS (
  SELECT doc_id, text, ('0x' || substr(md5(text), 1, 15))::BIGINT AS mark FROM documents),
lines AS (
  SELECT doc_id, mark, text, string_split(text, chr(10)) AS ls FROM marked),
ink AS (
  SELECT doc_id, mark, ls, list_filter(range(0, len(ls)), lambda i: regexp_matches(ls[i + 1], '[^{WS}]')) AS pos
  FROM (SELECT DISTINCT doc_id, mark, ls FROM lines)),
runs AS (
  SELECT doc_id, mark, unnest(list_transform(range(1, len(pos) - 1), lambda k: {{
    'first': pos[k], 'last': pos[k + 2],
    'body': ls[pos[k] + 1] || chr(10) || ls[pos[k + 1] + 1] || chr(10) || ls[pos[k + 2] + 1]}})) AS w
  FROM ink WHERE len(pos) >= 3),
ranked AS (
  SELECT doc_id, mark, w, row_number() OVER (PARTITION BY w.body ORDER BY doc_id NULLS LAST, mark, w."first") AS rank FROM runs),
cuts AS (
  SELECT doc_id, mark, list_distinct(flatten(list(range(w."first", w."last" + 1)))) AS cut
  FROM ranked WHERE rank > 1 GROUP BY doc_id, mark)
SELECT l.doc_id,
  coalesce(len(ls), 0)::BIGINT AS n_lines,
  coalesce(len(cut), 0)::BIGINT AS n_removed,
  sha256(CASE WHEN cut IS NULL THEN text ELSE coalesce(array_to_string(list_transform(
    list_filter(range(0, len(ls)), lambda i: NOT list_contains(cut, i)), lambda i: ls[i + 1]), chr(10)), '') END) AS text_sha256
FROM lines l LEFT JOIN cuts c ON l.doc_id IS NOT DISTINCT FROM c.doc_id AND l.mark = c.mark
"""


OP2 = """
WITH t AS (
  SELECT conv_id, coalesce(turn, 9223372036854775807) AS turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
forks AS (
  SELECT conv_id, (conv_id % w + w) % w AS fork
  FROM (SELECT conv_id, coalesce(max(turn) FILTER (WHERE turn < 9223372036854775807), -1) + 2 AS w FROM t GROUP BY conv_id)),
chosen AS (SELECT conv_id AS pair_id, turn, role, text FROM t),
rejected AS (
  SELECT conv_id AS pair_id, turn, role, text FROM t JOIN forks USING (conv_id) WHERE turn < fork
  UNION ALL SELECT f.conv_id, turn, role, text FROM forks f JOIN t ON xor(t.conv_id, 1) = f.conv_id WHERE turn >= fork),
met AS (
  SELECT coalesce(c.pair_id, r.pair_id) AS pair_id, coalesce(c.turn, r.turn) AS turn, c.l IS NOT DISTINCT FROM r.l AS same
  FROM (SELECT pair_id, turn, list_sort(list({'r': role, 't': text})) AS l FROM chosen GROUP BY ALL) c
  FULL JOIN (SELECT pair_id, turn, list_sort(list({'r': role, 't': text})) AS l FROM rejected GROUP BY ALL) r
    ON c.pair_id = r.pair_id AND c.turn = r.turn),
fork AS (SELECT pair_id, min(turn) AS fork FROM met WHERE NOT same GROUP BY 1),
every AS (SELECT *, 'chosen' AS part FROM chosen UNION ALL SELECT *, 'rejected' AS part FROM rejected),
placed AS (SELECT every.*, fork IS NULL OR turn < fork AS shared FROM every LEFT JOIN fork USING (pair_id)),
shown AS (
  SELECT pair_id, CASE WHEN shared THEN 'prompt' ELSE part END AS part, nullif(turn, 9223372036854775807) AS turn, role,
    NOT shared AND role = 'assistant' AS trained, '<|' || role || '|>' || chr(10) AS header, text
  FROM placed WHERE NOT shared OR part = 'chosen')
SELECT pair_id, part, turn, role, trained, CASE WHEN trained THEN length(header) END::INTEGER AS train_from,
  length(header || text || '<|end|>' || chr(10))::INTEGER AS n_chars, sha256(header || text || '<|end|>' || chr(10)) AS sha256
FROM shown
"""


def _op5() -> str:
    pairs = ", ".join(f"({_quoted(text)}, {_quoted(name)})" for name, text in licenses.SENTENCES.items())
    rules = ", ".join(
        f"({i}, {_quoted(name)}, {_quoted(lic)}, {_quoted(kind)}, {_quoted(',' + ','.join(seq) + ',')})"
        for i, (name, lic, kind, seq) in enumerate(licenses.RULES)
    )
    flat = "lower(coalesce(text, ''))"
    for pattern, new in licenses.STEPS:
        if "(?=" in pattern:  # no look-ahead here: the blank is matched and put back
            pattern, new = pattern.replace("(?=", "("), new + r"\1"
        flat = f"regexp_replace({flat}, {_quoted(pattern)}, {_quoted(new.replace('$0', chr(92) + '0'))}, 'g')"
    longest = sorted(licenses.SENTENCES.values(), key=lambda x: (-len(x), x))
    any_known = "|".join(x.replace(" ", r"(?: |\|\|)") for x in longest)
    return rf"""
WITH known(body, name) AS (VALUES {pairs}),
rule(place, rule, license, kind, seq) AS (VALUES {rules}),
flat AS (SELECT row_number() OVER () AS nr, doc_id, {flat} AS body FROM documents),
found AS (
  SELECT nr, doc_id, list_transform(regexp_extract_all('|' || replace(trim(body), '|', '||') || '|', '\|({any_known})\|', 1),
    lambda x: replace(x, '||', ' ')) AS ss FROM flat),
sentence AS (SELECT nr, i, ss[i] AS body FROM (SELECT nr, ss, unnest(range(1, len(ss) + 1)) AS i FROM found)),
ids AS (SELECT nr, string_agg(name, ',' ORDER BY i) AS sentence_ids FROM sentence JOIN known USING (body) GROUP BY nr),
hit AS (
  SELECT nr, place, rule, license, kind FROM ids JOIN rule ON contains(',' || sentence_ids || ',', seq)),
lic AS (SELECT nr, license, min(place) AS place FROM hit GROUP BY nr, license),
lics AS (SELECT nr, string_agg(license, ',' ORDER BY place) AS licenses FROM lic GROUP BY nr),
per AS (
  SELECT nr, string_agg(rule, ',' ORDER BY place) AS rules,
    max(CASE kind WHEN 'restricted' THEN 3 WHEN 'copyleft' THEN 2 ELSE 1 END) AS strict
  FROM hit GROUP BY nr)
SELECT d.doc_id, coalesce(sentence_ids, '') AS sentence_ids, coalesce(rules, '') AS rules,
  coalesce(licenses, '') AS licenses,
  CASE strict WHEN 3 THEN 'restricted' WHEN 2 THEN 'copyleft' WHEN 1 THEN 'permissive' END AS license_class
FROM flat d LEFT JOIN ids USING (nr) LEFT JOIN per USING (nr) LEFT JOIN lics USING (nr)
"""


def _op6() -> str:
    pieces = [
        "[" + ", ".join("{'t': %r, 'y': %r, 'w': %r, 's': %r}" % tuple(map(float, p)) for p in mixing.segments(k)) + "]"
        for k in mixing.SCHEDULES
    ]
    place = lambda b: f"""CASE WHEN greatest(least(floor(target) - ({b}), size), 0) > 0 THEN
      least(1.0::DOUBLE, p.t + CASE WHEN ({b}) / target - p.y <= 0 THEN 0.0 ELSE 2 * (({b}) / target - p.y)
        / (p.w + sqrt(greatest(p.w * p.w + 2 * p.s * (({b}) / target - p.y), 0.0))) END) END"""  # noqa: E731
    piece = lambda b: f"list_filter(pieces, lambda x: x.y <= ({b}) / target)[-1]"
    return rf"""
WITH rows_ AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^{WS}]+')), 0)::BIGINT AS size,
    ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))), 1, 13))::BIGINT AS key
  FROM documents),
src AS (
  SELECT source, sum(size)::DOUBLE AS source_size,
    (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 AS cycle
  FROM rows_ GROUP BY source),
wt AS (SELECT *, [5.0, 2.0, 1.0][cycle + 1]::DOUBLE AS weight, 2 * source_size AS cap FROM src),
ordered AS (
  SELECT *, row_number() OVER (ORDER BY cap / weight, source IS NULL, source) AS place,
    coalesce(sum(cap) OVER (ORDER BY cap / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
    sum(weight) OVER (ORDER BY cap / weight, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open
  FROM wt),
lvl AS (
  SELECT arg_min((1.5 * total - capped) / open, place) AS level
  FROM ordered, (SELECT sum(source_size) AS total FROM wt)
  WHERE (1.5 * total - capped) / open * weight <= cap),
tgt AS (
  SELECT source, source_size::BIGINT AS source_size, least(cap, weight * level)::DOUBLE AS target,
    CASE cycle WHEN 0 THEN {pieces[0]} WHEN 1 THEN {pieces[1]} ELSE {pieces[2]} END AS pieces
  FROM wt, lvl),
placed AS (
  SELECT r.*, t.source_size, t.target, t.pieces,
    (coalesce(sum(size) OVER (PARTITION BY r.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE AS c
  FROM rows_ r JOIN tgt t ON r.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  (greatest(least(floor(target) - c, size), 0) + greatest(least(floor(target) - c - source_size, size), 0))::BIGINT AS taken,
  (SELECT {place("c")} FROM (SELECT {piece("c")} AS p)) AS position,
  (SELECT {place("c + source_size")} FROM (SELECT {piece("c + source_size")} AS p)) AS again
FROM placed
"""


OP9 = rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^{WS}]+') AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_distinct(
    list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s
  FROM words),
one AS (SELECT s, min(doc_id) AS doc_id, len(s) AS n FROM sets GROUP BY s),
grams AS (SELECT doc_id, n, unnest(s) AS g FROM one),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b
  FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
  GROUP BY 1, 2, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(node, comp) AS (
  SELECT doc_id, doc_id FROM one WHERE n > 0
  UNION SELECT ways.b, reach.comp FROM reach JOIN ways ON ways.a = reach.node),
comps AS (SELECT node, min(comp) AS comp FROM reach GROUP BY node)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, coalesce(c.comp, s.doc_id) AS component_id,
  s.doc_id = coalesce(c.comp, s.doc_id) AS kept
FROM sets s LEFT JOIN one o ON s.s = o.s AND o.n > 0 LEFT JOIN comps c ON c.node = o.doc_id
"""


ORACLES = {"op1_line_dedup": OP1, "op2_chat_format": OP2, "op5_license_scan": _op5(), "op6_mixing": _op6(), "op9_near_dedup": OP9}
