"""SQL of the Merkle, spelling and decontamination queries."""

from __future__ import annotations

#: Table of CRC-32 (the reflected polynomial 0xEDB88320), worked out bit by bit.
_CRC_TABLE = """(SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, _: xor(c >> 1, 3988292384 * (c & 1))) ORDER BY i) AS t FROM range(256) AS s(i))"""


def _crc32(text: str) -> str:
    """Unsigned CRC-32 of a text's UTF-8 bytes, with the table ``t`` at hand."""
    octets = f"list_transform(range(1, 2 * strlen({text}), 2), lambda i: CAST('0x' || hex({text})[i:i + 1] AS BIGINT))"
    return f"xor(4294967295, list_reduce(list_prepend(4294967295, {octets}), lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)])))"


def _field(column: str) -> str:
    return f"coalesce(concat(strlen(CAST({column} AS VARCHAR)), ':', CAST({column} AS VARCHAR)), '-')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(_field(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


MERKLE = rf"""
WITH RECURSIVE crc AS MATERIALIZED {_CRC_TABLE},
d AS MATERIALIZED (
  SELECT *, row_number() OVER () AS r, {_leaf('text')} AS leaf,
    CASE WHEN {_crc32("CAST(doc_id AS VARCHAR)")} % 2 = 0 THEN {_leaf("replace(text, chr(10), '')")} END AS changed
  FROM documents, crc),
placed AS MATERIALIZED (
  SELECT r, doc_id, source, leaf, coalesce(changed, leaf) AS claim,
    row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM d),
nodes AS (
  SELECT source, 0 AS level, i, n, leaf AS h FROM placed
  UNION ALL
  SELECT source, level + 1, i // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY i)) FROM nodes WHERE n > 1 GROUP BY source, level, i // 3, n),
kept AS MATERIALIZED (SELECT * FROM nodes),
subroots AS MATERIALIZED (
  SELECT source, h AS subroot, level AS levels, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM kept WHERE n = 1),
tops AS (
  SELECT 0 AS level, i, n, subroot AS h FROM subroots
  UNION ALL
  SELECT level + 1, i // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY i)) FROM tops WHERE n > 1 GROUP BY level, i // 3, n),
runs AS MATERIALIZED (
  SELECT source, 1 AS part, level, i // 3 AS g, list(h ORDER BY i) AS hs FROM kept WHERE n > 1 GROUP BY source, level, i // 3
  UNION ALL SELECT NULL, 2, level, i // 3, list(h ORDER BY i) FROM tops WHERE n > 1 GROUP BY level, i // 3),
folds AS (
  SELECT r, source, 1 AS part, 0 AS level, i, claim AS h, '' AS proof FROM placed
  UNION ALL
  SELECT f.r, f.source, CASE WHEN g.hs IS NULL AND f.part = 1 THEN 2 ELSE f.part END, CASE WHEN g.hs IS NULL THEN 0 ELSE f.level + 1 END,
    CASE WHEN g.hs IS NULL THEN s.i ELSE f.i // 3 END,
    CASE WHEN g.hs IS NULL THEN f.h ELSE sha256(array_to_string(g.hs[1:f.i % 3], '') || f.h || array_to_string(g.hs[f.i % 3 + 2:], '')) END,
    CASE WHEN g.hs IS NULL THEN f.proof ELSE f.proof || array_to_string(g.hs[1:f.i % 3], '') || array_to_string(g.hs[f.i % 3 + 2:], '') END
  FROM folds AS f JOIN subroots AS s ON s.source IS NOT DISTINCT FROM f.source
    LEFT JOIN runs AS g ON g.part = f.part AND g.level = f.level AND g.g = f.i // 3 AND (f.part = 2 OR g.source IS NOT DISTINCT FROM f.source)
  WHERE f.part = 1 OR g.hs IS NOT NULL),
last AS (SELECT r, arg_max(h, level) AS h, arg_max(proof, level) AS proof FROM folds WHERE part = 2 GROUP BY r)
SELECT p.doc_id, p.leaf, s.subroot, t.h AS root, sha256(l.proof) AS proof_sha256, l.h AS folded_root, l.h = t.h AS verified
FROM placed AS p JOIN last AS l USING (r) JOIN subroots AS s ON s.source IS NOT DISTINCT FROM p.source, (SELECT h FROM tops WHERE n = 1) AS t
"""

SPELLING = rf"""
WITH RECURSIVE crc AS MATERIALIZED {_CRC_TABLE},
runs AS MATERIALIZED (
  SELECT doc_id, run, count(*) AS c, concat(doc_id, ':', run) AS s
  FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents)
  WHERE length(run) >= 6 GROUP BY doc_id, run),
marked AS (SELECT run, c, {_crc32('s')} AS h FROM runs, crc),
words AS MATERIALIZED (
  SELECT word, CAST(sum(c) AS BIGINT) AS n
  FROM (SELECT CASE WHEN h % 199 = 0 THEN concat(run[1:h % length(run)], run[h % length(run) + 2:]) ELSE run END AS word, c FROM marked)
  WHERE length(word) >= 6 GROUP BY word HAVING sum(c) >= 5),
cut AS MATERIALIZED (SELECT word, i, concat(word[1:i], word[i + 2:]) AS rest, length(word) AS size FROM words, unnest(range(length(word))) AS t(i)),
pairs AS (
  SELECT a.word, b.word AS other FROM cut AS a JOIN cut AS b ON a.rest = b.rest AND a.i = b.i AND a.size = b.size AND a.word <> b.word
  UNION SELECT c.word, w.word FROM cut AS c JOIN words AS w ON w.word = c.rest
  UNION SELECT w.word, c.word FROM cut AS c JOIN words AS w ON w.word = c.rest),
near AS (
  SELECT p.word, count(*) AS n_near, max(o.n) AS best_n, arg_min(p.other, struct_pack(m := -o.n, w := p.other)) AS best
  FROM pairs AS p JOIN words AS o ON o.word = p.other GROUP BY p.word),
forms AS MATERIALIZED (
  SELECT w.word, w.n, CASE WHEN best_n >= 5 * w.n THEN best END AS form, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 5 * w.n THEN best_n END AS form_n
  FROM words AS w LEFT JOIN near USING (word)),
steps AS (
  SELECT word, word AS at, form AS onward FROM forms
  UNION ALL SELECT s.word, f.word, f.form FROM steps AS s JOIN forms AS f ON f.word = s.onward)
SELECT f.word, f.n, f.form, f.form_n, s.at AS root, CAST(f.n_near AS BIGINT) AS n_near FROM forms AS f JOIN steps AS s ON s.word = f.word AND s.onward IS NULL
"""

LEAKS = r"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS MATERIALIZED (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS MATERIALIZED (
  SELECT DISTINCT item_id, least(10, len(w)) AS k, array_to_string(w[i + 1:i + 10], ' ') AS g
  FROM b, unnest(range(greatest(1, len(w) - 9))) AS t(i) WHERE len(w) > 0),
spot AS MATERIALIZED (
  SELECT r, k, i, array_to_string(w[i + 1:i + k], ' ') AS g
  FROM (SELECT DISTINCT k FROM win) AS s, d, unnest(range(greatest(0, len(w) - k + 1))) AS t(i)),
hit AS MATERIALIZED (SELECT s.r, s.k, s.i, m.item_id FROM spot AS s JOIN win AS m ON m.k = s.k AND m.g = s.g),
covered AS (SELECT r, count(DISTINCT i + j) AS n FROM hit, unnest(range(k)) AS t(j) GROUP BY r),
found AS (SELECT r, count(DISTINCT CAST(item_id AS VARCHAR)) AS n, sha256(coalesce(string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)), '')) AS s FROM hit GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(covered.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(found.n, 0) AS BIGINT) AS n_items,
  coalesce(found.s, sha256('')) AS items_sha256, covered.n IS NOT NULL AS contaminated
FROM d LEFT JOIN covered USING (r) LEFT JOIN found USING (r)
"""
