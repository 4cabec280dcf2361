"""DuckDB statements of this subpackage's queries, where SQL can express them."""

from __future__ import annotations

from textcoder.llm import filter_audit, licenses, line_dedup, mixing
from textcoder.llm.util import SPACES, WORD

ORACLE: dict[str, str] = {}

_BARE = "regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g')"
assert set(SPACES) == {" ", *map(chr, range(9, 14))}

ORACLE["op4_exact_dedup"] = f"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS points, {_BARE} AS norm FROM documents),
     r AS (SELECT *, row_number() OVER (PARTITION BY norm ORDER BY points DESC, doc_id NULLS LAST) AS pos FROM d)
SELECT doc_id, first(doc_id) OVER g AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size, pos = 1 AS kept,
       sha256(norm) AS text_sha256
FROM r WINDOW g AS (PARTITION BY norm ORDER BY pos)
"""

_U = f"((('0x' || substr(md5('{mixing.SEED}:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496::DOUBLE)"
ORACLE["op8_mixing"] = f"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::BIGINT AS size, {_U} AS u FROM documents),
     s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY 1),
     w AS (SELECT *, list_extract([{', '.join(map(str, mixing.WEIGHTS))}],
                  1 + ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(mixing.WEIGHTS)})::INT)::BIGINT AS weight FROM s),
     c AS (SELECT *, source_size * {mixing.MAX_COPIES} AS cap, source_size * {mixing.MAX_COPIES} / weight AS ratio FROM w),
     l AS (SELECT *, row_number() OVER (ORDER BY ratio, source NULLS LAST) AS pos,
                  ((sum(source_size) OVER ())::BIGINT - coalesce(sum(cap) OVER (ORDER BY ratio, source NULLS LAST
                      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT)
                  / (sum(weight) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS level FROM c),
     f AS (SELECT coalesce(min_by(level, pos) FILTER (WHERE level <= ratio), 0) AS first FROM l),
     t AS (SELECT source, source_size, least(cap::DOUBLE, weight * first) AS target FROM l, f),
     q AS (SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), {mixing.MAX_COPIES})::INT ELSE 0 END AS whole FROM t),
     m AS (SELECT d.*, source_size, target, whole, greatest(0.0, target - whole * source_size) AS remaining, ln(1 + size::DOUBLE) AS w
           FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source),
     h AS (SELECT source, w, (remaining - coalesce(sum(size) OVER (PARTITION BY source ORDER BY w DESC, doc_id
                      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
                  / nullif(sum(w * size) OVER (PARTITION BY source ORDER BY w DESC, doc_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS scale,
                  row_number() OVER (PARTITION BY source ORDER BY w DESC, doc_id) AS pos FROM m),
     k AS (SELECT source, min_by(scale, pos) FILTER (WHERE scale * w < 1) AS scale FROM h GROUP BY 1),
     p AS (SELECT m.*, least(1.0, coalesce(k.scale, CASE WHEN remaining > 0 THEN 'infinity'::DOUBLE ELSE 0 END) * w) AS p
           FROM m JOIN k ON m.source IS NOT DISTINCT FROM k.source),
     r AS (SELECT *, CASE WHEN p > 0 AND p < 1 THEN (u / (1 - u)) / (p / (1 - p)) END AS rank FROM p),
     v AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY rank, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
           FROM r WHERE rank IS NOT NULL AND size > 0),
     z AS (SELECT source, any_value(remaining) - coalesce(sum(size) FILTER (WHERE p >= 1), 0)::DOUBLE AS missing FROM r GROUP BY 1),
     y AS (SELECT v.source AS s, any_value(missing) AS missing, min(row(rank, doc_id)) FILTER (WHERE upto > missing) AS stop
           FROM v JOIN z ON v.source IS NOT DISTINCT FROM z.source GROUP BY 1),
     n AS (SELECT v.source, any_value(missing) - coalesce(sum(size) FILTER (WHERE stop IS NULL OR row(rank, doc_id) < stop), 0)::DOUBLE AS missing,
                  coalesce(list(doc_id) FILTER (WHERE stop IS NULL OR row(rank, doc_id) < stop), []) AS ids,
                  coalesce(list({{'left': size::DOUBLE, 'ids': [doc_id]}} ORDER BY size DESC, rank, doc_id)
                      FILTER (WHERE stop IS NOT NULL AND row(rank, doc_id) >= stop), []) AS rest
           FROM v JOIN y ON v.source IS NOT DISTINCT FROM y.s GROUP BY 1),
     f2 AS (SELECT z.source, list_reduce(list_concat([{{'left': coalesce(n.missing, z.missing), 'ids': coalesce(ids, [])::BIGINT[]}}], coalesce(rest, [])),
                  lambda a, x: CASE WHEN x.left <= a.left THEN {{'left': a.left - x.left, 'ids': list_concat(a.ids, x.ids)}} ELSE a END) AS done
            FROM z LEFT JOIN n ON z.source IS NOT DISTINCT FROM n.source),
     x AS (SELECT r.source AS s, arg_min(doc_id, row(abs(done.left - size), rank, doc_id)) AS closing
           FROM r JOIN f2 ON r.source IS NOT DISTINCT FROM f2.source
           WHERE rank IS NOT NULL AND size > 0 AND NOT list_contains(done.ids, doc_id) AND abs(done.left - size) < done.left GROUP BY 1)
SELECT r.doc_id, r.size, r.source_size, r.target,
       (r.size * (r.whole + CASE WHEN r.p >= 1 OR list_contains(done.ids, r.doc_id) OR coalesce(x.closing = r.doc_id, false) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM r JOIN f2 ON r.source IS NOT DISTINCT FROM f2.source LEFT JOIN x ON r.source IS NOT DISTINCT FROM x.s
"""


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


ORACLE["op5_line_dedup"] = f"""
WITH p AS (SELECT page_id, coalesce(lower(regexp_extract(url, {_quoted(line_dedup.HOST)}, 1)), '') AS host,
                  regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), {_quoted(line_dedup.UNSEEN)}, chr(10), 'g'),
                      {_quoted(line_dedup.BREAK)}, chr(10), 'g'), '{line_dedup.TAG}', '', 'g'), '{line_dedup.SQUEEZE}', ' ', 'g') AS text,
                  row_number() OVER () AS rid FROM pages),
     l AS (SELECT rid, host, u.pos, trim(u.line, ' ') AS line
           FROM p, LATERAL (SELECT unnest(string_split(p.text, chr(10))) AS line, generate_subscripts(string_split(p.text, chr(10)), 1) AS pos) u
           WHERE trim(u.line, ' ') <> ''),
     h AS (SELECT host, count(*) AS pages FROM p GROUP BY 1),
     n AS (SELECT host, line, count(DISTINCT rid) AS n FROM l GROUP BY 1, 2),
     b AS (SELECT n.host, line FROM n JOIN h ON n.host = h.host WHERE n / pages > {line_dedup.RATIO} AND n >= {line_dedup.MIN_HOLDERS}),
     k AS (SELECT rid, count(*) AS n_lines, count(*) FILTER (WHERE b.line IS NULL) AS n_kept,
                  string_agg(l.line, chr(10) ORDER BY pos) FILTER (WHERE b.line IS NULL) AS text
           FROM l LEFT JOIN b ON l.host = b.host AND l.line = b.line GROUP BY 1)
SELECT page_id, host, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_kept, 0)::BIGINT AS n_kept, sha256(coalesce(k.text, '')) AS kept_sha256
FROM p LEFT JOIN k ON p.rid = k.rid
"""

_T = licenses.THRESHOLD
_GRAMS = [licenses.template_bigrams(t) for _, t in licenses.TEMPLATES]
_TEMPLATE_ROWS = ", ".join(f"({i}, {_quoted(name)}, {len(licenses.template_words(t))}, [{', '.join(map(_quoted, g))}])"
                           for i, ((name, t), g) in enumerate(zip(licenses.TEMPLATES, _GRAMS, strict=True)))
_ANCHOR_ROWS = ", ".join(f"({_quoted(g)}, {t}, {k})" for g, places in licenses.placements(licenses.TEMPLATES, _T).items() for t, k in places)
ORACLE["op9_licenses"] = f"""
WITH t(tid, name, words, grams) AS (VALUES {_TEMPLATE_ROWS}),
     a(gram, tid, k) AS (VALUES {_ANCHOR_ROWS}),
     d AS (SELECT doc_id, row_number() OVER () AS rid,
                  list_filter(string_split(regexp_replace(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM documents),
     g AS (SELECT rid, u.i, w[u.i] || ' ' || w[u.i + 1] AS gram FROM d, LATERAL (SELECT unnest(generate_series(1, len(w) - 1)) AS i) u),
     c AS (SELECT DISTINCT g.rid, a.tid, g.i - a.k AS first FROM g JOIN a ON g.gram = a.gram),
     x AS (SELECT c.rid, t.name, c.first, c.first + t.words - 1 AS last, t.grams,
                  list_distinct(list_transform(generate_series(c.first, c.first + t.words - 2), lambda j: d.w[j] || ' ' || d.w[j + 1])) AS own
           FROM c JOIN t ON c.tid = t.tid JOIN d ON c.rid = d.rid WHERE c.first >= 1 AND c.first + t.words - 1 <= len(d.w)),
     m AS (SELECT rid, name, first, last, len(grams) AS n, 2.0::DOUBLE * len(list_intersect(own, grams)) / (len(own) + len(grams)) AS dice FROM x),
     o AS (SELECT rid, list([{{'first': first, 'last': last, 'name': name, 'dice': dice}}] ORDER BY dice DESC, n DESC, name, first) AS found
           FROM m WHERE dice >= {_T} GROUP BY 1),
     b AS (SELECT rid, list_reduce(found, lambda kept, y: CASE WHEN len(list_filter(kept, lambda z: z.first <= y[1].last AND y[1].first <= z.last)) > 0
                  THEN kept ELSE list_concat(kept, y) END) AS best FROM o)
SELECT doc_id, coalesce(len(best), 0)::BIGINT AS n_licenses,
       coalesce(array_to_string(list_sort(list_distinct(list_transform(best, lambda y: y.name))), ','), '') AS licenses,
       coalesce(list_max(list_transform(best, lambda y: y.dice)), 0.0)::DOUBLE AS best_dice
FROM d LEFT JOIN b ON d.rid = b.rid
"""

_LETTERS = ", ".join(f"('{x}')" for x in filter_audit.FILTERS)
ORACLE["op12_filter_audit"] = f"""
WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
     w AS (SELECT *, regexp_extract_all(text, '{WORD}') AS words FROM t),
     g AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
           FROM labels WHERE doc_id IS NOT NULL GROUP BY 1),
     f AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
                  [len(words) < 200, 100 * len(list_distinct(words)) < 50 * len(words),
                   100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text), regexp_matches(text, '[#$%&*|]'),
                   coalesce(w.doc_id > min(w.doc_id) OVER same, w.doc_id IS NULL AND min(w.doc_id) OVER same IS NOT NULL)] AS fails
           FROM w LEFT JOIN g ON w.doc_id = g.doc_id WINDOW same AS (PARTITION BY text)),
     c AS (SELECT part, fails, list_sum(list_transform(fails, lambda x: x::INT)) AS n_fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic
           FROM f GROUP BY ALL),
     x(letter) AS (VALUES {_LETTERS}),
     o AS (SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order FROM x a, x b, x c, x d, x e
           WHERE len(list_distinct([a.letter, b.letter, c.letter, d.letter, e.letter])) = 5),
     s AS (SELECT filter_order, step, ascii(filter_order[step]) - 64 AS own,
                  list_transform(range(1, step), lambda i: ascii(filter_order[i]) - 64) AS earlier FROM o, (SELECT unnest(range(1, 6)) AS step)),
     r AS (SELECT part, filter_order, step, n, good, toxic, n_fails, fails[own] AS hit,
                  len(list_filter(earlier, lambda i: fails[i])) > 0 AS gone FROM c, s)
SELECT part, filter_order, step::INTEGER AS step, coalesce(sum(n) FILTER (WHERE NOT hit AND NOT gone), 0)::BIGINT AS kept,
       coalesce(sum(n) FILTER (WHERE hit AND NOT gone), 0)::BIGINT AS removed, coalesce(sum(n) FILTER (WHERE hit AND gone), 0)::BIGINT AS redundant,
       coalesce(sum(n) FILTER (WHERE hit AND n_fails = 1), 0)::BIGINT AS unique_fails,
       coalesce(sum(good) FILTER (WHERE hit AND NOT gone), 0)::BIGINT AS good_lost,
       coalesce(sum(toxic) FILTER (WHERE hit AND NOT gone), 0)::BIGINT AS toxic_lost,
       coalesce(sum(sum(n) FILTER (WHERE hit AND NOT gone)) OVER (PARTITION BY part, filter_order[step]), 0)::BIGINT AS shapley
FROM r GROUP BY part, filter_order, step
"""

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ORACLE["op11_source_divergence"] = f"""
WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
     o AS (SELECT rid, lang, source,
                  unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_UPPER.lower()}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
     l AS (SELECT lang, term, count(*) AS n FROM o GROUP BY 1, 2 HAVING count(DISTINCT rid) >= 3),
     c AS (SELECT lang, source, term, count(*) AS n FROM o GROUP BY 1, 2, 3),
     g AS (SELECT DISTINCT lang, source FROM d),
     x AS (SELECT g.lang, g.source, l.term, coalesce(c.n, 0) AS n, l.n AS lang_n
           FROM g JOIN l ON g.lang = l.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = l.term),
     p AS (SELECT lang, source, term, n,
                  (1 + (1000000000::HUGEINT * (n + 1)) // (sum(n) OVER (PARTITION BY lang, source) + count(*) OVER (PARTITION BY lang, source)))::BIGINT AS p,
                  (1 + (1000000000::HUGEINT * (lang_n + 1)) // (sum(lang_n) OVER (PARTITION BY lang, source) + count(*) OVER (PARTITION BY lang, source)))::BIGINT AS q
           FROM x),
     s AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
           FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
     r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
           FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
                LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
           UNION ALL
           SELECT lang, source, 'term', term, (((p - q) * (p - q)) // q)::BIGINT FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, rank FROM
    (SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank FROM r)
WHERE part = 'pair' OR rank <= 200
"""
