"""DuckDB SQL of the corpus queries that SQL can express."""

from __future__ import annotations

from roadspeed.llm import license_scan

EXACT_DEDUP = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS body FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(body) AS text_sha256
FROM t WINDOW w AS (PARTITION BY body)
"""


def license_sql(templates: list[tuple[str, str]], threshold: float) -> str:
    rows = ", ".join(f"('{name}', '{text}')" for name, text in templates)
    return f"""
WITH tpl AS (
  SELECT license, [x FOR x IN string_split(regexp_replace(lower(body), '[^a-z0-9]+', ' ', 'g'), ' ') IF x <> ''] AS w
  FROM (VALUES {rows}) v(license, body)),
tb AS (SELECT license, w[i] || ' ' || w[i + 1] AS b, count(*) AS c
       FROM (SELECT license, w, unnest(range(1, len(w))) AS i FROM tpl) GROUP BY 1, 2),
ts AS (SELECT license, sum(c) AS n FROM tb GROUP BY 1),
clean AS (SELECT doc_id, coalesce(text, '') AS body,
                 regexp_replace(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}\\n]+', ' ', 'g') AS norm FROM documents),
lines AS (SELECT doc_id, string_split(norm, chr(10)) AS l, norm, len(string_split(body, chr(10))) AS n_lines FROM clean),
units AS (SELECT doc_id, unnest(l) AS u, generate_subscripts(l, 1) AS k FROM lines
          UNION ALL SELECT doc_id, replace(norm, chr(10), ' '), 0 FROM lines WHERE n_lines > 1),
words AS (SELECT doc_id, k, [x FOR x IN string_split(u, ' ') IF x <> ''] AS w FROM units),
short AS (SELECT doc_id, k, w FROM words
          WHERE len(w) BETWEEN 2 AND (SELECT max(n) FROM ts) * (2 - {threshold}) / {threshold} + 1),
ub AS (SELECT doc_id, k, w[i] || ' ' || w[i + 1] AS b, count(*) AS c
       FROM (SELECT doc_id, k, w, unnest(range(1, len(w))) AS i FROM short) GROUP BY 1, 2, 3),
us AS (SELECT doc_id, k, sum(c) AS n FROM ub GROUP BY 1, 2),
hit AS (SELECT ub.doc_id, ub.k, tb.license, sum(least(ub.c, tb.c)) AS s FROM ub JOIN tb USING (b) GROUP BY 1, 2, 3),
scored AS (SELECT hit.doc_id, k, license, 2.0::DOUBLE * s / (us.n + ts.n) AS dice
           FROM hit JOIN us USING (doc_id, k) JOIN ts USING (license)),
best AS (SELECT doc_id, k, license, dice FROM scored WHERE dice >= {threshold}
         QUALIFY row_number() OVER (PARTITION BY doc_id, k ORDER BY dice DESC, license DESC) = 1)
SELECT d.doc_id, d.n_lines, count(b.license) AS n_units,
       coalesce(string_agg(DISTINCT b.license, ',' ORDER BY b.license), '') AS licenses,
       arg_max(b.license, struct_pack(a := b.dice, z := b.license)) AS best_license, max(b.dice) AS best_dice
FROM lines d LEFT JOIN best b ON b.doc_id = d.doc_id GROUP BY d.doc_id, d.n_lines
"""


DECONTAMINATE = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                   'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS l FROM documents),
bw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                   'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS l FROM benchmark),
bn AS (SELECT item_id, l, least(len(l), 10) AS n FROM bw WHERE len(l) > 0),
bp AS (SELECT item_id, l, n, unnest(range(1, len(l) - n + 2)) AS p FROM bn),
bk AS (SELECT DISTINCT item_id, n, array_to_string(l[p:p + n - 1], ' ') AS k FROM bp),
dp AS (SELECT doc_id, l, n, unnest(range(1, len(l) - n + 2)) AS p FROM dw, (SELECT DISTINCT n FROM bk) WHERE len(l) >= n),
hit AS (SELECT dp.doc_id, dp.p, dp.n, bk.item_id FROM dp JOIN bk ON bk.n = dp.n AND bk.k = array_to_string(dp.l[dp.p:dp.p + dp.n - 1], ' ')),
cov AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS s
        FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM hit) GROUP BY doc_id)
SELECT dw.doc_id, len(l)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN cov USING (doc_id) LEFT JOIN its USING (doc_id)
"""

SUBSTRING_DEDUP = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS l FROM documents),
p AS (SELECT doc_id, l, unnest(range(1, len(l) - 18)) AS p FROM d WHERE len(l) >= 20),
k AS (SELECT doc_id, p, array_to_string(l[p:p + 19], ' ') AS k FROM p),
late AS (SELECT doc_id, p FROM k QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id, p) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 20)) AS q FROM late),
word AS (SELECT doc_id, unnest(l) AS w, generate_subscripts(l, 1) AS q FROM d),
kept AS (SELECT doc_id, string_agg(w, ' ' ORDER BY q) AS s, count(*) AS n
         FROM word ANTI JOIN gone USING (doc_id, q) GROUP BY doc_id)
SELECT d.doc_id, len(l)::BIGINT AS n_words, len(l)::BIGINT - coalesce(n, 0) AS n_removed, sha256(coalesce(s, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

#: Words at one edit: two that share a deletion at one place differ by a replacement there, a word that is
#: another's deletion by an insertion. CRC-32 is computed byte by byte from its table.
SPELLING = r"""
WITH tab AS (SELECT list(list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)
                         ORDER BY b) AS t FROM (SELECT unnest(range(256)) AS b)),
runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                  '[a-z\x{00C0}-\x{00FF}]+')) AS r FROM documents),
own AS (SELECT doc_id, r, count(*) AS n FROM runs GROUP BY 1, 2),
sums AS (SELECT r, n, length(r) AS len, xor(list_reduce([4294967295] || flatten(list_transform(
           string_split(coalesce(doc_id::VARCHAR, '') || ':' || r, ''),
           lambda ch: CASE WHEN unicode(ch) < 128 THEN [unicode(ch)::BIGINT] ELSE [195::BIGINT, unicode(ch)::BIGINT - 64] END)),
           lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h FROM own, tab),
new AS (SELECT CASE WHEN h % 97 = 0 THEN r[1:h % len] || r[h % len + 2:] ELSE r END AS word, n FROM sums),
w AS (SELECT word, sum(n)::BIGINT AS n, length(word) AS len FROM new WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
del AS (SELECT word, p, word[1:p - 1] || word[p + 1:] AS d FROM (SELECT word, unnest(range(1, len + 1)) AS p FROM w)),
pairs AS (SELECT a.word AS x, b.word AS y FROM del a JOIN del b ON a.d = b.d AND a.p = b.p AND a.word <> b.word
          UNION SELECT del.word, w.word FROM del JOIN w ON del.d = w.word
          UNION SELECT w.word, del.word FROM del JOIN w ON del.d = w.word),
near AS (SELECT x AS word, y AS other, w.n AS other_n FROM pairs JOIN w ON w.word = y),
best AS (SELECT word, count(*) AS n_near, max(other_n) AS most FROM near GROUP BY word),
top AS (SELECT near.word, n_near, most, min(other) AS other FROM near JOIN best ON best.word = near.word AND other_n = most GROUP BY 1, 2, 3),
f AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN most >= 2 * w.n THEN other END AS form,
             CASE WHEN most >= 2 * w.n THEN most END AS form_n FROM w LEFT JOIN top ON top.word = w.word),
walk AS (WITH RECURSIVE steps AS (SELECT word AS start, word AS here, 0 AS k FROM f
         UNION ALL SELECT start, f.form, k + 1 FROM steps JOIN f ON f.word = steps.here WHERE f.form IS NOT NULL)
         SELECT start, max_by(here, k) AS root FROM steps GROUP BY start)
SELECT f.word, f.form, walk.root, f.n, f.n_near, f.form_n FROM f JOIN walk ON walk.start = f.word
"""

HARD_NEGATIVES = """
WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
      FROM r a JOIN r b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
pos AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
        QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, (row_number() OVER w)::INTEGER AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM pos JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 5
"""

SQL = {
    "op1_decontaminate": DECONTAMINATE,
    "op10_substring_dedup": SUBSTRING_DEDUP,
    "op11_hard_negatives": HARD_NEGATIVES,
    "op12_spelling_variants": SPELLING,
    "op2_exact_dedup": EXACT_DEDUP,
    "op4_license_scan": license_sql(license_scan.TEMPLATES, license_scan.THRESHOLD),
}
