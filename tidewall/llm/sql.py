"""SQL for the operators that SQL can express, over whole tables."""

from __future__ import annotations

from tidewall.llm.secrets import BASE, RULES

_WORDS = r"regexp_extract_all({text}, '[^\x20\x09-\x0D]+')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _words(text: str) -> str:
    words = _WORDS.format(text=text)
    return f"SELECT doc_id, unnest({words}) AS word, unnest(range(1, len({words}) + 1)) AS pos FROM documents"


OP4 = f"""
WITH RECURSIVE words AS ({_words(_LOWER)}),
runs AS (SELECT doc_id, string_agg(word, ' ') OVER w AS run, count(*) OVER w AS n, count(*) OVER (PARTITION BY doc_id) AS total, pos FROM words
  WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)),
sets AS (SELECT DISTINCT doc_id, run FROM runs WHERE n = 5 OR (total < 5 AND pos = 1)),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM sets a JOIN sets b ON a.run = b.run AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM shared s JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * s.n >= 80 * (x.n + y.n - s.n)),
reached AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reached r JOIN links l ON l.a = r.b)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, least(d.doc_id, coalesce(r.low, d.doc_id)) AS component_id
FROM documents d LEFT JOIN sizes s USING (doc_id) LEFT JOIN (SELECT a AS doc_id, min(b) AS low FROM reached GROUP BY a) r USING (doc_id)"""

OP8 = f"""
WITH words AS ({_words("coalesce(text, '')")}),
spans AS (SELECT doc_id, pos, word, md5(string_agg(word, ' ') OVER w) AS span, count(*) OVER w AS n FROM words
  WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING)),
firsts AS (SELECT span, min(doc_id) AS low FROM spans WHERE n = 50 GROUP BY span),
marked AS (SELECT s.doc_id, s.pos, s.word, s.n = 50 AND f.low < s.doc_id AS starts FROM spans s LEFT JOIN firsts f ON s.span = f.span AND s.n = 50),
gone AS (SELECT doc_id, pos, word, coalesce(bool_or(starts) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 49 PRECEDING AND CURRENT ROW), false) AS gone FROM marked),
kept AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY pos) FILTER (NOT gone) AS kept FROM gone GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM documents d LEFT JOIN kept k USING (doc_id)"""


def _hits(rule: int) -> str:
    kind, pattern, group, least = RULES[rule]
    pat = "'" + pattern.replace("'", "''") + "'"
    text = "coalesce(text, '')"
    return f"""SELECT doc_id, {rule} AS rule, '{kind}' AS kind, {least} AS least, unnest(string_split_regex({text}, {pat})) AS gap,
unnest(regexp_extract_all({text}, {pat})) AS hit, unnest(regexp_extract_all({text}, {pat}, {group})) AS value,
unnest(range(len(string_split_regex({text}, {pat})))) AS nth FROM documents WHERE regexp_matches({text}, {pat})"""


OP9 = f"""
WITH hits AS ({' UNION ALL '.join(_hits(k) for k in range(len(RULES)))}),
ends AS (SELECT *, sum(length(gap) + coalesce(length(hit), 0)) OVER (PARTITION BY doc_id, rule ORDER BY nth) AS stop FROM hits),
spans AS (SELECT doc_id, rule, stop - length(hit) AS start, kind || ':' || CAST(stop - length(hit) AS BIGINT) || ':' || CAST(stop AS BIGINT) AS span FROM ends WHERE hit IS NOT NULL AND length(value) >= least),
found AS (SELECT doc_id, {', '.join(f"count(*) FILTER (rule = {k}) AS n_{RULES[k][0]}" for k in range(BASE))},
  string_agg(span, ',' ORDER BY start, rule) FILTER (rule < {BASE}) AS base, string_agg(span, ',' ORDER BY start, rule) AS spans FROM spans GROUP BY doc_id)
SELECT d.doc_id, {', '.join(f"coalesce(n_{RULES[k][0]}, 0) AS n_{RULES[k][0]}" for k in range(BASE))}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents d LEFT JOIN found f USING (doc_id)"""


#: The list of op11: verdict, host, path
LISTED = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]

OP11 = f"""
WITH listed(verdict, rule_host, rule_path) AS (VALUES {', '.join(map(str, LISTED))}),
rests AS (SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rests),
forms AS (SELECT DISTINCT host, path FROM parts),
best AS (SELECT host, path, max_by({{'rule': rule_host || rule_path, 'verdict': verdict}}, length(rule_host || rule_path)) AS won FROM forms
  JOIN listed ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY host, path)
SELECT page_id, host, path, won.rule AS rule, coalesce(won.verdict, 'allow') AS verdict FROM parts LEFT JOIN best USING (host, path)"""

_SHARE = "1 + (1000000000::HUGEINT * ({n} + 2)) // ({total} + 2 * {v})"
_F = "((p - q) * (p - q)) // (p + q)"

OP12 = f"""
WITH docs AS (SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
uses AS (SELECT doc, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM docs),
kept AS (SELECT lang, term FROM uses GROUP BY ALL HAVING count(DISTINCT doc) >= 10),
sizes AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
grps AS (SELECT DISTINCT lang, source FROM docs),
counts AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM uses JOIN kept USING (lang, term) GROUP BY ALL),
totals AS (SELECT lang, source, coalesce(sum(n), 0)::HUGEINT AS total FROM grps LEFT JOIN counts USING (lang, source) GROUP BY ALL),
full_grid AS (SELECT t.lang, t.source, k.term, coalesce(n, 0) AS n, {_SHARE.format(n="coalesce(n, 0)", total="total", v="v")} AS p
  FROM totals t JOIN kept k USING (lang) JOIN sizes USING (lang) LEFT JOIN counts c ON c.lang = t.lang AND c.source = t.source AND c.term = k.term),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value FROM full_grid a JOIN full_grid b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
all_pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM grps a JOIN grps b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source),
whole AS (SELECT lang, term, {_SHARE.format(n="n", total="(sum(n) OVER (PARTITION BY lang))", v="v")} AS q FROM (SELECT lang, term, sum(n)::HUGEINT AS n FROM counts GROUP BY ALL) JOIN sizes USING (lang)),
terms AS (SELECT lang, source, 'term' AS part, term AS item, {_F} AS value FROM full_grid JOIN whole USING (lang, term) WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (FROM all_pairs UNION ALL FROM terms))
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 10"""

OP13 = """
WITH valid AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
scored AS (SELECT a.vec_id AS anchor, b.vec_id AS other, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score FROM valid a JOIN valid b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
best AS (SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY score DESC, other) AS n FROM scored WHERE same),
found AS (SELECT b.anchor, b.other AS positive, b.score AS top, s.other, s.score, row_number() OVER (PARTITION BY b.anchor, b.other ORDER BY s.score DESC, s.other) AS rank
  FROM best b JOIN scored s ON b.anchor = s.anchor AND NOT s.same AND 50 * b.score <= 100 * s.score AND 100 * s.score <= 95 * b.score WHERE b.n <= 5)
SELECT anchor AS anchor_id, positive AS positive_id, rank::INTEGER AS rank, other AS negative_id, top AS positive_score, score AS negative_score FROM found WHERE rank <= 3"""
