"""Chat formatting with prefix-target expansion, in DataFrame functions alone.

A turn is formatted as `[INST] role [/INST]\\ntext</s>`. Control strings inside roles and texts are escaped
with a backslash, and so is the backslash, so that unescape() gives the text back. Every assistant turn is an
example of its own: all turns up to it, of which only its text is trainable.

format_turns() gives each turn its segment, its place in the conversation's text, and, for an assistant turn, its example's
number and the span of the loss mask (code points). expand() makes the examples: the prefix (all that comes before the reply) and
the target (the reply) of each, as texts of their own, so that a conversation's turns are repeated in every later example
(quadratic in its turns, as the method's output is). Turns after the last assistant turn are the prefix of an example
without a target, so that the output holds every turn. What digest() tells is read back from the examples' texts.

Defined results: null role or text is empty; turns go by turn (null first), then role, then text; repeated rows
are separate turns; a null conv_id is a conversation of its own; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import read_table

# The template's marks and the codes that stand for them inside texts.
OPEN, CLOSE, END = "[INST] ", " [/INST]\n", "</s>"
CONTROL = {"</s>": "\\a/s>", "<s>": "\\as>", "[INST]": "\\lINST]", "[/INST]": "\\l/INST]"}
TRAINED_ROLE = "assistant"


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\b"))
    for mark, code in CONTROL.items():
        out = F.replace(out, F.lit(mark), F.lit(code))
    return out


def unescape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\l"), F.lit("["))
    out = F.replace(out, F.lit("\\a"), F.lit("<"))
    return F.replace(out, F.lit("\\b"), F.lit("\\"))


def format_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, position (from 0), segment, seg_start, seg_end; for assistant turns example (from 0), loss_start, loss_end.

    The example's text is the conversation's text up to seg_end. `rest` marks the last turn of what follows the last reply.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    made = rows.withColumn("body", escape(F.col("text"))).withColumn("segment", F.concat(F.lit(OPEN), escape(F.col("role")), F.lit(CLOSE), F.col("body"), F.lit(END)))
    trained = F.col("role") == TRAINED_ROLE
    placed = made.select(
        "conv_id",
        (F.row_number().over(order) - 1).alias("position"),
        "segment",
        F.sum(F.length("segment").cast("long")).over(upto).alias("seg_end"),
        F.when(trained, F.count(F.when(trained, 1)).over(upto) - 1).alias("example"),
        F.length("body").alias("body_chars"),
        (F.lead("turn").over(order).isNull() & F.lead("segment").over(order).isNull() & ~trained).alias("rest"),
    )
    loss_end = F.when(F.col("example").isNotNull(), F.col("seg_end") - len(END))
    return placed.select(
        "conv_id", "position", "segment", (F.col("seg_end") - F.length("segment")).alias("seg_start"), "seg_end", "example", (loss_end - F.col("body_chars")).alias("loss_start"), loss_end.alias("loss_end"), "rest"
    )


def expand(turns: DataFrame) -> DataFrame:
    """The rows of format_turns() as examples: conv_id, example (-1 for what follows the last reply), prefix, target (null there), loss_start, loss_end, last (the example holds the whole conversation).

    A row a turn goes through the window; an example's text is what the turns up to its own say.
    """
    order = Window.partitionBy("conv_id").orderBy("position")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    ends = F.col("example").isNotNull() | F.col("rest")
    whole = turns.select(
        "conv_id", "example", "loss_start", "loss_end", "rest", F.array_join(F.collect_list("segment").over(upto), "").alias("text"), F.lead("position").over(order).isNull().alias("last")
    )
    target = F.substring("text", F.col("loss_start") + 1, F.col("loss_end") - F.col("loss_start"))
    prefix = F.when(F.col("loss_start").isNull(), F.col("text")).otherwise(F.substring("text", F.lit(1), F.col("loss_start")))
    return whole.where(ends).select("conv_id", F.coalesce("example", F.lit(-1)).alias("example"), prefix.alias("prefix"), F.when(F.col("loss_start").isNotNull(), target).alias("target"), "loss_start", "loss_end", "last")


def materialize(turns: DataFrame) -> DataFrame:
    """conv_id, example, text, loss_start, loss_end, last: the examples as whole texts, each its prefix, target and closing mark."""
    text = F.when(F.col("target").isNull(), F.col("prefix")).otherwise(F.concat("prefix", "target", F.lit(END)))
    return expand(turns).select("conv_id", "example", text.alias("text"), "loss_start", "loss_end", "last")


def read_back(text: Column) -> Column:
    """role and text of every turn of an example's text; no mark stands inside a role or text, as those are escaped."""
    segments = F.split(text, END)  # the last one is empty

    def turn(segment: Column) -> Column:
        at = F.locate(CLOSE, segment)
        role = unescape(F.substring(segment, F.lit(len(OPEN) + 1), at - 1 - len(OPEN)))
        return F.struct(role.alias("role"), unescape(F.substring(segment, at + len(CLOSE), F.length(segment))).alias("text"))

    return F.transform(F.slice(segments, F.lit(1), F.size(segments) - 1), turn)


def digest(turns: DataFrame) -> DataFrame:
    """One row a conversation, from its examples: the turns as its last example has them, the loss from each example's own mask. Its digests need all its text in one row, as a SHA-256 of it does."""
    loss = unescape(F.substring("text", F.col("loss_start") + 1, F.col("loss_end") - F.col("loss_start")))
    said = F.transform(read_back(F.col("text")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    examples = materialize(turns).select("conv_id", F.struct("example", loss.alias("loss")).alias("l"), F.when(F.col("last"), said).alias("said"), F.length("text").cast("long").alias("chars"))
    whole = examples.groupBy("conv_id").agg(F.sort_array(F.collect_list("l")).alias("l"), F.max("said").alias("said"), F.sum("chars").alias("formatted_chars"))
    loss = F.array_join(F.transform("l", lambda x: x["loss"]), "")  # array_join leaves nulls out
    return whole.select(
        "conv_id",
        F.size("said").cast("long").alias("n_turns"),
        F.sha2(F.array_join("said", ""), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        "formatted_chars",
    )


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = read_table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    role = F.when(F.col("id") == 0, F.lit("user")).otherwise(F.lit("assistant"))
    probe = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    return digest(format_turns(table.unionByName(probe)))


_ESCAPED = "replace(replace(replace(replace(replace({x}, '\\', '\\b'), '</s>', '\\a/s>'), '<s>', '\\as>'), '[INST]', '\\lINST]'), '[/INST]', '\\l/INST]')"

OP8_SQL = f"""
WITH c AS (
  SELECT conv_id::BIGINT AS conv_id, turn::BIGINT AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
s AS (SELECT *, 20 + length({_ESCAPED.format(x="role")}) + length({_ESCAPED.format(x="text")}) AS seg FROM c),
o AS (SELECT *, row_number() OVER w AS k, count(*) OVER (PARTITION BY conv_id) AS n, sum(seg) OVER (w ROWS UNBOUNDED PRECEDING) AS upto
      FROM s WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
  coalesce(sum(upto) FILTER (role = 'assistant' OR k = n), 0)::BIGINT AS formatted_chars
FROM o GROUP BY conv_id
"""
