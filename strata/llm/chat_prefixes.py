"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns up to and including it,
with only that reply trainable.  A conversation that ends without a reply also
gives an example without a target, so that no turn is lost.

A turn is written as ``<|start|>role<|text|>text<|end|>``.  Roles and texts are
escaped so that no control string is left in them: ``~`` becomes ``~0`` and ``<|``
becomes ``~1``; the other way round gives back the original, whatever it was.

All steps are DataFrame operations.  A conversation is written once; its examples
are prefixes of it, given by offsets that a running sum of lengths yields, so a
conversation of n turns needs n rows, not n copies of itself.

Defined results: null texts and roles are empty; turns are ordered by turn, then
role and text (nulls first), so ties and repeated rows are all kept, in one
order; a null conversation id is one conversation; an empty table gives no
examples; other columns are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strata.llm.common import col, read_table

START, TEXT, END = "<|start|>", "<|text|>", "<|end|>"
ASSISTANT = "assistant"


def escape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("~"), F.lit("~0")), F.lit("<|"), F.lit("~1"))


def unescape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("~1"), F.lit("<|")), F.lit("~0"), F.lit("~"))


def prefix_targets(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn",
                   role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per example: conv, example (from 0), text, loss_start, loss_end (code points;
    null where nothing is trainable)."""
    empty = F.lit("")
    t = turns.select(col(conv_col).alias("conv"), col(turn_col).alias("turn"),
                     F.coalesce(col(role_col), empty).alias("role"), F.coalesce(col(text_col), empty).alias("said"))
    head = F.concat(F.lit(START), escape(F.col("role")), F.lit(TEXT))
    t = t.withColumn("head", F.length(head)).withColumn("line", F.concat(head, escape(F.col("said")), F.lit(END)))
    order = Window.partitionBy("conv").orderBy("turn", "role", "said")
    t = (t.withColumn("at", F.row_number().over(order))
          .withColumn("stop", F.sum(F.length("line")).over(order.rowsBetween(Window.unboundedPreceding, 0))))
    line = F.struct("at", "line", "stop",
                    (F.col("stop") - F.length("line") + F.col("head")).alias("loss_start"),
                    (F.col("stop") - len(END)).alias("loss_end"),
                    (F.col("role") == ASSISTANT).alias("target"))
    c = t.groupBy("conv").agg(F.array_sort(F.collect_list(line)).alias("lines"))
    last = F.element_at("lines", -1)
    replies = F.transform(F.filter("lines", lambda x: x["target"]), lambda x: F.struct(
        x["stop"].alias("stop"), x["loss_start"].alias("loss_start"), x["loss_end"].alias("loss_end")))
    rest = F.struct(last["stop"].alias("stop"), F.lit(None).cast("long").alias("loss_start"),
                    F.lit(None).cast("long").alias("loss_end"))
    c = c.select("conv", F.array_join(F.transform("lines", lambda x: x["line"]), "").alias("whole"),
                 F.when(last["target"], replies).otherwise(F.concat(replies, F.array(rest))).alias("examples"))
    return (c.select("conv", "whole", F.posexplode("examples").alias("example", "e"))
             .select("conv", "example", F.substring(F.col("whole"), F.lit(1), F.col("e.stop").cast("int")).alias("text"),
                     "e.loss_start", "e.loss_end"))


def read_back(examples: DataFrame) -> DataFrame:
    """Per conversation, from its examples alone: turns (role, text), loss (the trainable texts in
    order, unescaped) and formatted_chars (of all examples)."""
    loss = unescape(F.substring(F.col("text"), (F.col("loss_start") + 1).cast("int"),
                                (F.col("loss_end") - F.col("loss_start")).cast("int")))
    c = examples.groupBy("conv").agg(
        F.max_by("text", "example").alias("whole"),
        F.array_sort(F.collect_list(F.struct("example", loss.alias("loss")))).alias("losses"),
        F.sum(F.length("text")).alias("formatted_chars"))
    lines = F.split("whole", r"<\|end\|>", -1)
    lines = F.slice(lines, F.lit(1), F.size(lines) - 1)
    # a line is the start mark, the role, the text mark and the text; neither holds a mark
    cut = lambda x: F.instr(x, TEXT)
    turn = lambda x: F.struct(
        unescape(F.substring(x, F.lit(len(START) + 1), cut(x) - len(START) - 1)).alias("role"),
        unescape(F.substring(x, cut(x) + len(TEXT), F.length(x))).alias("text"))
    return c.select("conv", F.transform(lines, turn).alias("turns"),
                    F.array_join(F.transform("losses", lambda x: x["loss"]), "").alias("loss"), "formatted_chars")


def op5_chat_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.sql("""select * from values (-7L, 0L, 'user', '</s>[INST] ok [/INST]'),
                         (-7L, 1L, 'assistant', '</s>[INST] ok [/INST]') as t(conv_id, turn, role, text)""")
    back = read_back(prefix_targets(said.unionByName(extra)))
    told = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return back.select(F.col("conv").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"),
                       F.sha2(told, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"),
                       F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")


OP5_SQL = """
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), lines AS (
  SELECT *, row_number() OVER w AS place, count(*) OVER (PARTITION BY conv_id) AS n,
    sum(24 + length(replace(replace(role, '~', '~0'), '<|', '~1'))
           + length(replace(replace(text, '~', '~0'), '<|', '~1'))) OVER w AS stop
  FROM said WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING)
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY place) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(stop) FILTER (role = 'assistant' OR place = n)::BIGINT AS formatted_chars
FROM lines GROUP BY conv_id
"""
