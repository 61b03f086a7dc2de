"""Chat formatting: every assistant turn becomes an example of its own.

The context of an example is all turns before it; only its last turn, the reply, is under the loss mask. A turn reads
``[INST]role[/INST]text</s>``. The three control strings and the escape character inside roles and texts are escaped,
so that the output can be read back without loss.

Cases: a null text or role is empty; rows of a conversation are ordered by turn, then role, then text (nulls first), so
ties and repeated rows have one order and are all kept; a null conv_id is a conversation like any other; turns after the
last assistant turn go to a last example that trains nothing, so that the output holds every turn; an empty table
gives no examples; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

OPEN, CLOSE, END = "[INST]", "[/INST]", "</s>"
#: What is escaped, in this order; each escape is a backslash and a letter, so undoing it in the opposite order is exact.
ESCAPES = (("\\", "\\b"), (OPEN, "\\i"), (CLOSE, "\\e"), (END, "\\s"))


def escape(text: Column) -> Column:
    for raw, safe in ESCAPES:
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def unescape(text: Column) -> Column:
    for raw, safe in reversed(ESCAPES):
        text = F.replace(text, F.lit(safe), F.lit(raw))
    return text


def prefix_targets(turns: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """(conv_id, turn, role, text) to (conv_id, upto, trained, last, formatted, loss_start, loss_len), a row an example.

    formatted holds turns 1..upto; loss_start (from 1) and loss_len delimit the trainable characters. Only the turns are
    shuffled, once; the expansion streams out of the task that holds the conversation.
    """
    rows = turns.select(
        "conv_id", "turn",
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    marked = rows.select(
        "conv_id", "turn", "role", "text",
        F.concat(F.lit(OPEN), escape(F.col("role")), F.lit(CLOSE), escape(F.col("text")), F.lit(END)).alias("said"),
        F.char_length(escape(F.col("text"))).alias("len"),
    )
    convs = marked.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text", "said", "len"))).alias("t"))
    convs = convs.select("conv_id", F.col("t.role").alias("roles"), F.col("t.said").alias("said"), F.col("t.len").alias("lens"))
    n = F.size("roles")
    trained = lambda i: F.element_at("roles", i) == trained_role
    ends = F.filter(F.sequence(F.lit(1), n), lambda i: trained(i) | (i == n))
    out = convs.select("conv_id", "roles", "said", "lens", F.explode(ends).alias("upto"))
    out = out.select(
        "conv_id", "upto", trained(F.col("upto")).alias("trained"), (F.col("upto") == n).alias("last"),
        F.array_join(F.slice("said", F.lit(1), F.col("upto")), "").alias("formatted"),
        F.element_at("lens", F.col("upto")).alias("len"),
    )
    return out.select(
        "conv_id", "upto", "trained", "last", "formatted",
        (F.char_length("formatted") - len(END) - F.col("len") + 1).alias("loss_start"),
        F.when(F.col("trained"), F.col("len")).otherwise(0).alias("loss_len"),
    )


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted text, as an array of (role, text)."""
    said = F.split(formatted, END, -1)
    said = F.slice(said, 1, F.size(said) - 1)
    cut = F.transform(said, lambda s: F.split(s, r"\[/INST\]", -1))
    return F.transform(cut, lambda p: F.struct(unescape(F.substring(p[0], len(OPEN) + 1, 2147483647)).alias("role"), unescape(p[1]).alias("text")))


def read_loss(examples: DataFrame) -> Column:
    """The text under the loss mask of an example."""
    return unescape(F.substring(examples["formatted"], examples["loss_start"], examples["loss_len"]))


def summary(examples: DataFrame) -> DataFrame:
    """A row for each conversation, read from the examples' texts and masks alone."""
    seen = examples.select(
        "conv_id", F.char_length("formatted").cast("long").alias("chars"), F.when(F.col("last"), F.col("formatted")).alias("whole"),
        F.when(F.col("trained"), F.struct("upto", read_loss(examples).alias("text"))).alias("loss"),
    )
    convs = seen.groupBy("conv_id").agg(F.max("whole").alias("whole"), F.sort_array(F.collect_list("loss")).alias("loss"), F.sum("chars").alias("formatted_chars"))
    convs = convs.select("conv_id", "formatted_chars", read_turns(F.col("whole")).alias("turns"), F.array_join("loss.text", "").alias("loss"))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return convs.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars",
    )


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.sql("SELECT -1L conv_id, pos AS turn, role FROM (SELECT posexplode(array('user', 'assistant')) AS (pos, role))")
    extra = extra.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", F.lit(said).alias("text"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return summary(prefix_targets(turns.unionByName(extra)))


def _escaped(x: str) -> str:
    for raw, safe in ESCAPES:
        x = f"replace({x}, '{raw}', '{safe}')"
    return x


ORACLE = f"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
sized AS (
  SELECT *, sum(17 + length({_escaped('role')}) + length({_escaped('text')})) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) AS upto,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) AS from_end
  FROM said)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(upto) FILTER (role = 'assistant' OR from_end = 1) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""
