"""SQL for the license scan: the same votes on k-grams of words instead of their hashes."""

from __future__ import annotations

from .licenses import LEAST_COVERAGE, NOTICE_K, PHRASE_K, SHIFT, TEMPLATES

WORDS = r"""list_filter(regexp_split_to_array(translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')"""


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


VALUES = ", ".join(
    f"({t}, {quoted(x.label)}, {x.is_phrase}, {x.k}, {quoted(x.text)})" for t, x in enumerate(TEMPLATES)
)

SQL = f"""
WITH tw AS (SELECT t, label, is_phrase, k, {WORDS.format(text='tx')} AS w
            FROM (VALUES {VALUES}) v(t, label, is_phrase, k, tx)),
tg AS (SELECT t, k, j - 1 AS j, list_slice(w, j, j + k - 1) AS g FROM (
         SELECT t, k, w, unnest(range(1, len(w) - k + 2)) AS j FROM tw)),
d AS (SELECT doc_id, coalesce(text, '') AS txt, {WORDS.format(text='text')} AS w FROM documents),
r AS (SELECT DISTINCT doc_id, txt, w FROM d),
p AS (SELECT doc_id, txt, w, k, unnest(range(1, len(w) - k + 2)) AS i
      FROM r, (VALUES ({PHRASE_K}), ({NOTICE_K})) ks(k)),
m AS (SELECT doc_id, txt, t, i - 1 - j AS d, j
      FROM (SELECT doc_id, txt, k, i, list_slice(w, i, i + k - 1) AS g FROM p) x JOIN tg USING (k, g)),
ds AS (SELECT DISTINCT doc_id, txt, t, d FROM m),
n AS (SELECT *, CASE WHEN is_phrase OR coalesce(d - lag(d) OVER o > {SHIFT}, true) THEN 1 ELSE 0 END AS new
      FROM ds JOIN tw USING (t) WINDOW o AS (PARTITION BY doc_id, txt, t ORDER BY d)),
s AS (SELECT doc_id, txt, t, d, sum(new) OVER (PARTITION BY doc_id, txt, t ORDER BY d) AS span FROM n),
q AS (SELECT doc_id, txt, t, span, j, min(d) AS low FROM m JOIN s USING (doc_id, txt, t, d)
      GROUP BY doc_id, txt, t, span, j),
c AS (SELECT *, least(k, coalesce(lead(j) OVER (PARTITION BY doc_id, txt, t, span ORDER BY j) - j, k)) AS covered
      FROM q JOIN tw USING (t)),
f AS (SELECT doc_id, txt, t, label, is_phrase, min(j + low) AS first_word,
             sum(covered) / len(any_value(w)) AS coverage
      FROM c GROUP BY doc_id, txt, t, span, label, is_phrase),
g AS (SELECT * FROM f WHERE coverage >= CASE WHEN is_phrase THEN 1 ELSE {LEAST_COVERAGE} END),
u AS (SELECT doc_id, txt, count(*) FILTER (is_phrase) AS n_base,
             min(first_word) FILTER (is_phrase) AS first_word, max(first_word) FILTER (is_phrase) AS last_word,
             string_agg(DISTINCT label, ',' ORDER BY label) FILTER (is_phrase) AS base_labels,
             string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(coverage) AS score
      FROM g GROUP BY doc_id, txt)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score
FROM d LEFT JOIN u ON d.doc_id IS NOT DISTINCT FROM u.doc_id AND d.txt = u.txt
"""
