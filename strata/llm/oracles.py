"""DuckDB SQL for the queries that SQL can express in full."""

from __future__ import annotations

from strata.llm.periodic_runs import SQL_CRC, SQL_CRC_TABLE
from strata.llm.quality_rules import BIT, V2, V3

_SOLID = r"[^\x20\x09-\x0D]+"

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_BARE = "trim(" + _LOWER + """, '.,;:!?"''()')"""

#: The word list is learned from all labels: no table here has as many as the sample may hold.
_LEDGER = rf"""
WITH {SQL_CRC_TABLE}, known AS (
  SELECT doc_id, max(toxic) AS toxic FROM labels, crc_table
  WHERE toxic IS NOT NULL AND doc_id IS NOT NULL AND {SQL_CRC.format("doc_id::VARCHAR")} % 4 <> 2 GROUP BY doc_id
), listed AS (
  SELECT word FROM (SELECT toxic, unnest(list_distinct(list_transform(regexp_extract_all(coalesce(text, ''), '{_SOLID}'), lambda x: {_BARE.format("x")}))) AS word
                    FROM documents JOIN known USING (doc_id))
  WHERE length(word) >= 4 GROUP BY word
  HAVING count(*) FILTER (toxic > 0) >= 4 AND 10 * count(*) FILTER (toxic > 0) >= 9 * count(*)
), t AS (
  SELECT row_number() OVER () AS i, doc_id, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT i, doc_id, text, regexp_extract_all(text, '{_SOLID}') AS words,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{_SOLID}')) AS lines
  FROM t
), windows AS (
  SELECT i, k, words[k] || ' ' || words[k + 1] || ' ' || words[k + 2] AS win
  FROM (SELECT i, words, unnest(range(1, len(words) - 1)) AS k FROM w)
), twice AS (
  SELECT i, k FROM windows QUALIFY count(*) OVER (PARTITION BY i, win) > 1
), repeated AS (
  SELECT i, count(DISTINCT k + d) AS n FROM twice, (VALUES (0), (1), (2)) AS s(d) GROUP BY i
), said AS (
  SELECT i, count(*) AS n FROM (SELECT i, unnest(list_transform(words, lambda x: {_BARE.format("x")})) AS word FROM w) SEMI JOIN listed USING (word) GROUP BY i
), m AS (
  SELECT w.i, doc_id, coalesce(s.n, 0)::BIGINT AS n_listed, len(words)::BIGINT AS n_words,
    length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    len(lines) AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    coalesce(r.n, 0)::BIGINT AS n_repeat_words,
    length(regexp_replace(text, '[\x00-\x40\x5B-\x60\x7B-\x7F]', '', 'g')) AS n_letters,
    length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_upper,
    length(regexp_replace(text, '[^!]', '', 'g')) AS n_exclaim
  FROM w LEFT JOIN repeated r ON r.i = w.i LEFT JOIN said s ON s.i = w.i
), b AS (
  SELECT *, (CASE WHEN n_words < 50 THEN {BIT['few_words']} ELSE 0 END
    + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN {BIT['repeated_words']} ELSE 0 END
    + CASE WHEN 100 * n_symbols > 30 * n_words THEN {BIT['symbols']} ELSE 0 END
    + CASE WHEN 100 * n_dup_lines > 50 * n_lines THEN {BIT['duplicate_lines']} ELSE 0 END
    + CASE WHEN NOT word_chars BETWEEN 2 * n_words AND 40 * n_words THEN {BIT['word_length']} ELSE 0 END
    + CASE WHEN 100 * n_letters < 50 * word_chars THEN {BIT['few_letters']} ELSE 0 END
    + CASE WHEN 100 * n_upper > 60 * n_letters THEN {BIT['shouting']} ELSE 0 END
    + CASE WHEN 100 * n_exclaim > 50 * n_words THEN {BIT['exclamations']} ELSE 0 END
    + CASE WHEN 200 * n_listed > n_words THEN {BIT['listed_words']} ELSE 0 END)::BIGINT AS fail_bits
  FROM m
)"""

OP9_SQL = rf"""{_LEDGER}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  fail_bits & {V3.mask} = 0 AS kept, n_listed, fail_bits, '{V3.version}' AS policy
FROM b
"""

OP9_TOXIC_SQL = rf"""{_LEDGER}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  fail_bits & {V3.mask} = 0 AS kept, n_listed, fail_bits & {V2.mask} = 0 AS v2_kept, fail_bits, '{V3.version}' AS policy
FROM b
"""

OP9_ABLATION_SQL = rf"""{_LEDGER}
SELECT rule, count(*) FILTER (fail_bits & bit <> 0) AS n_failed, count(*) FILTER (fail_bits & {V3.mask} = bit) AS n_only,
  count(*) FILTER (fail_bits & {V3.mask} & ~bit = 0) AS n_kept_without
FROM b, (VALUES {", ".join(f"('{r}', {BIT[r]}::BIGINT)" for r in V3.rules)}) AS rules(rule, bit) GROUP BY rule
"""

_WORDS = r"regexp_extract_all(" + _LOWER.format("coalesce(text, '')") + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP10_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS i, doc_id, {_WORDS} AS w FROM documents
), b AS (
  SELECT item_id, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL
), win AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n,
    array_to_string(w[k:k + least(10, len(w)) - 1], ' ') AS win
  FROM (SELECT *, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS k FROM b WHERE len(w) > 0)
), grams AS (
  SELECT i, n, k, array_to_string(w[k:k + n - 1], ' ') AS win
  FROM (SELECT i, n, w, unnest(range(1, len(w) - n + 2)) AS k
        FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)
), hits AS (
  SELECT g.i, g.k, g.n, win.item_id FROM grams g JOIN win USING (n, win)
), per AS (
  SELECT i, count(DISTINCT k) AS n_hit FROM (SELECT i, unnest(range(k, k + n)) AS k FROM hits) GROUP BY i
), items AS (
  SELECT i, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT i, item_id::VARCHAR AS item FROM hits) GROUP BY i
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN per USING (i) LEFT JOIN items USING (i)
"""

OP8_SQL = rf"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS i, doc_id,
    regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_SOLID}') AS w FROM documents
), s AS (
  SELECT DISTINCT i, doc_id, array_to_string(w[k:k + least(3, len(w)) - 1], ' ') AS shingle
  FROM (SELECT *, unnest(range(1, len(w) - least(3, len(w)) + 2)) AS k FROM d WHERE len(w) > 0)
), sizes AS (
  SELECT i, any_value(doc_id) AS doc_id, count(*) AS n FROM s GROUP BY i
), pairs AS (
  SELECT x.i AS a, y.i AS b, count(*) AS n FROM s x JOIN s y ON x.shingle = y.shingle AND x.i <> y.i GROUP BY 1, 2
), links AS (
  SELECT a, b, x.doc_id AS doc_a, y.doc_id AS doc_b FROM pairs JOIN sizes x ON x.i = a JOIN sizes y ON y.i = b
  WHERE 100 * pairs.n >= 90 * (x.n + y.n - pairs.n)
), reach AS (
  SELECT DISTINCT doc_a AS a, doc_b AS b FROM links
  UNION SELECT r.a, l.doc_b FROM reach r JOIN links l ON l.doc_a = r.b
)
SELECT d.doc_id, coalesce(z.n, 0)::BIGINT AS n_shingles,
  least(d.doc_id, (SELECT min(b) FROM reach WHERE a = d.doc_id)) AS component_id,
  (SELECT count(*) FROM links WHERE a = d.i)::BIGINT AS n_links
FROM d LEFT JOIN sizes z ON z.i = d.i
"""
