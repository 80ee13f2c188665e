r"""License scan by ordered signature rules.

A text is its lower-case words.  Rules (``license_rules``) are regular expressions
over these words, in a stated order, each with a label and a priority.

1. *Prefilter*: a rule can only match where all words that its matches must hold are
   there.  A text's words are intersected with the longest word of each rule; texts
   without any, most of them, are not looked at again.  In the others each rule is
   gated by all its words.
2. *Matches*: the rules that pass are applied to the text; places are word numbers.
3. *Suppression*: a detection goes if one of higher priority (a lower number) shares a
   word with it, or if one of its own priority contains it and is longer, or has the same
   place and an earlier rule.  Detections that go still count against others.  Both tests
   are running extremes over a text's detections in order.
4. *Base phrases* are looked up in the same pass, are always reported and take no part
   in suppression.

All steps are DataFrame operations.  Only texts with a rule that passed its gate are
stored with their words; no text is shuffled.  The rules are a constant.

Defined results: null, empty and wordless texts have no detections and score 0; rows without an id
and repeated rows are each reported; an empty table gives no rows; texts are read whole.
Input columns other than id and text are not read.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strata.llm.common import col, read_table
from strata.llm.decontaminate import words
from strata.llm.license_rules import BASE_RULES, CONFIDENCE, RULES, Rule
from strata.session import materialize

_RULE = "struct<rule:int,label:string,priority:int,keywords:array<string>,regex:string>"
#: Around a match, while it is cut out; no word holds them.
_OPEN, _SHUT = "\x01", "\x02"


def _array(rules: list[Rule]) -> Column:
    return F.from_json(F.lit(json.dumps([r._asdict() for r in rules])), f"array<{_RULE}>")


def _word_array(of: set[str]) -> Column:
    return F.from_json(F.lit(json.dumps(sorted(of))), "array<string>")


def _n_words(text: Column) -> Column:
    """Words of a text in which each has two spaces of its own."""
    return F.floor(F.char_length(F.regexp_replace(text, "[^ ]", "")) / 2).cast("long")


def gated(docs: DataFrame, id_col: str, text_col: str, rules: list[Rule]) -> DataFrame:
    """Per input row: uid, id, n_words, and where a rule passes its gate: line (the words, each between
    spaces of its own) and todo (those rules)."""
    first = _word_array({r.keywords[0] for r in rules})
    every = _word_array({k for r in rules for k in r.keywords})
    d = docs.select(col(id_col).alias("id"), words(col(text_col)).alias("w"))
    d = d.withColumn("there", F.when(F.size(F.array_intersect("w", first)) > 0, F.array_intersect("w", every)))
    passes = lambda r: F.forall(r["keywords"], lambda k: F.array_contains(col("there"), k))
    d = d.withColumn("todo", F.when(col("there").isNotNull(), F.filter(_array(rules), passes)))
    some = F.size("todo") > 0
    return d.select(F.monotonically_increasing_id().alias("uid"), "id", F.size("w").cast("long").alias("n_words"),
                    F.when(some, F.concat(F.lit(" "), F.array_join("w", "  "), F.lit(" "))).alias("line"),
                    F.when(some, col("todo")).alias("todo"))


def matches(texts: DataFrame) -> DataFrame:
    """Every match in the rows of ``gated`` that have rules to try: uid, rule, label, priority, start, end (exclusive)."""
    one = texts.where(col("todo").isNotNull()).select("uid", "line", F.explode("todo").alias("r")).select("uid", "line", "r.*")
    cut = F.split(F.regexp_replace(col("line"), col("regex"), F.lit(f"{_OPEN}$0{_SHUT}")), _OPEN)
    pieces = (one.withColumn("pieces", cut).where(F.size("pieces") > 1)
                 .select("uid", "rule", "label", "priority", F.posexplode("pieces").alias("k", "piece")))
    sized = pieces.select("uid", "rule", "label", "priority", "k", _n_words(col("piece")).alias("n"),
                          F.when(col("k") > 0, _n_words(F.substring_index("piece", _SHUT, 1))).alias("own"))
    before = Window.partitionBy("uid", "rule").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    return (sized.withColumn("start", F.sum("n").over(before)).where(col("k") > 0)
                 .select("uid", "rule", "label", "priority", "start", (col("start") + col("own")).alias("end")))


def suppressed(found: DataFrame) -> DataFrame:
    """The detections with ``kept``: false where another one takes the place."""
    line = [col("start").asc(), col("end").desc(), col("rule").asc()]
    above = lambda level, value: F.when(col("priority") < level, value)
    levels = sorted(CONFIDENCE)[1:]
    text = Window.partitionBy("uid").orderBy(*line)
    ahead, after = text.rowsBetween(Window.unboundedPreceding, -1), text.rowsBetween(1, Window.unboundedFollowing)
    own = Window.partitionBy("uid", "priority").orderBy(*line).rowsBetween(Window.unboundedPreceding, -1)
    covered = F.coalesce(F.max("end").over(own) >= col("end"), F.lit(False))
    shared = F.lit(False)
    for level in levels:
        meets = (F.coalesce(F.max(above(level, col("end"))).over(ahead) > col("start"), F.lit(False))
                 | F.coalesce(F.min(above(level, col("start"))).over(after) < col("end"), F.lit(False)))
        shared = shared | ((col("priority") == level) & meets)
    return found.withColumn("kept", ~covered & ~shared)


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  rules: list[Rule] = RULES) -> tuple[DataFrame, DataFrame]:
    """(texts, detections): the rows as ``gated`` gives them, and every detection with uid, rule,
    label, priority (0: base phrase), start, end, kept."""
    texts = materialize(gated(docs, id_col, text_col, [*BASE_RULES, *rules]), "licenses")
    found = matches(texts)
    base = found.where("priority = 0").withColumn("kept", F.lit(True))
    return texts, suppressed(found.where("priority > 0")).unionByName(base)


def license_summary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per input row: id, n_words, n_base, first_word, last_word, base_labels, labels, score (the highest
    confidence of a kept detection), n_kept and n_suppressed of the rules' own detections."""
    texts, found = scan_licenses(docs, id_col, text_col)
    base = col("priority") == 0
    trust = F.element_at(F.create_map(*[F.lit(x) for p, c in {0: CONFIDENCE[4], **CONFIDENCE}.items() for x in (p, c)]), col("priority"))
    per = found.groupBy("uid").agg(
        F.count_if(base).alias("n_base"), F.min(F.when(base, col("start"))).alias("first_word"),
        F.max(F.when(base, col("start"))).alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(base, col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set(F.when(col("kept"), col("label")))), ",").alias("labels"),
        F.max(F.when(col("kept"), trust)).alias("score"),
        F.count_if(~base & col("kept")).alias("n_kept"), F.count_if(~base & ~col("kept")).alias("n_suppressed"))
    zero, none = F.lit(0).cast("long"), F.lit("")
    defaults = {"n_base": zero, "first_word": F.lit(None).cast("long"), "last_word": F.lit(None).cast("long"), "base_labels": none,
                "labels": none, "score": F.lit(0.0), "n_kept": zero, "n_suppressed": zero}
    head = [col("id").alias(id_col), col("n_words")]
    plain = texts.where(col("todo").isNull()).select(*head, *[d.alias(c) for c, d in defaults.items()])
    tried = texts.where(col("todo").isNotNull()).select("uid", "id", "n_words").join(per, "uid", "left").select(
        *head, *[F.coalesce(col(c), d).alias(c) for c, d in defaults.items()])
    return plain.unionByName(tried)


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_summary(read_table(spark, sf_dir, "documents"))


def _sql_rules() -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    return ",\n    ".join(f"({r.rule}, {quoted(r.label)}, {r.priority}, {list(r.keywords)}, {quoted(r.regex)})" for r in [*BASE_RULES, *RULES])


OP12_SQL = rf"""
WITH rules(rule, label, priority, keywords, regex) AS (
  VALUES {_sql_rules()}
), d AS (
  SELECT row_number() OVER () AS d, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), lines AS (
  SELECT d, ' ' || array_to_string(w, '  ') || ' ' AS line,
    list_intersect(w, ks) AS there FROM d, (SELECT list(DISTINCT k) AS ks FROM (SELECT unnest(keywords) AS k FROM rules)) WHERE len(w) > 0
), pieces AS (
  SELECT d, rule, label, priority, string_split(regexp_replace(line, regex, chr(1) || '\0' || chr(2), 'g'), chr(1)) AS p
  FROM lines JOIN rules ON list_has_all(there, keywords)
), pos AS (
  SELECT d, rule, label, priority, unnest(range(1, len(p) + 1)) AS k, unnest(p) AS piece FROM pieces
), sized AS (
  SELECT *, length(regexp_replace(piece, '[^ ]', '', 'g')) // 2 AS n,
    length(regexp_replace(split_part(piece, chr(2), 1), '[^ ]', '', 'g')) // 2 AS own FROM pos
), found AS (
  SELECT * FROM (SELECT d, rule, label, priority, k, own, (sum(n) OVER (PARTITION BY d, rule ORDER BY k) - n)::BIGINT AS s FROM sized) WHERE k > 1
), kept AS (
  SELECT *, priority = 0 OR NOT EXISTS (
    SELECT 1 FROM found y WHERE y.d = x.d AND y.priority > 0 AND (
      y.priority < x.priority AND y.s < x.s + x.own AND y.s + y.own > x.s
      OR y.priority = x.priority AND y.s <= x.s AND y.s + y.own >= x.s + x.own AND (y.own > x.own OR y.rule < x.rule))) AS kept
  FROM found x
), per AS (
  SELECT d, count(*) FILTER (priority = 0) AS n_base, min(s) FILTER (priority = 0) AS first_word, max(s) FILTER (priority = 0) AS last_word,
    string_agg(DISTINCT label, ',' ORDER BY label) FILTER (priority = 0) AS base_labels,
    string_agg(DISTINCT label, ',' ORDER BY label) FILTER (kept) AS labels,
    max(CASE priority {" ".join(f"WHEN {p} THEN {c}::DOUBLE" for p, c in {0: CONFIDENCE[4], **CONFIDENCE}.items())} END) FILTER (kept) AS score,
    count(*) FILTER (kept AND priority > 0) AS n_kept, count(*) FILTER (NOT kept) AS n_suppressed
  FROM kept GROUP BY d
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score,
  coalesce(n_kept, 0)::BIGINT AS n_kept, coalesce(n_suppressed, 0)::BIGINT AS n_suppressed
FROM d LEFT JOIN per USING (d)
"""
