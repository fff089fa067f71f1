"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it are context, and only its own
text is trainable. Turns after the last assistant turn come in one more example without a trainable
part. Texts and roles are escaped, so that the template's control strings stand in no text:
a backslash is doubled, and ``[`` and ``<``, with which every control string begins, are followed by
a backslash and a bar.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hydroframe.llm.shared import table

START, SEP, END = "<s>", "[INST]", "[/INST]</s>"
SEP_PATTERN, END_PATTERN = r"\[INST\]", r"\[/INST\]</s>"


def escape(text: Column) -> Column:
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in ("[", "<"):
        text = F.replace(text, F.lit(c), F.lit(c + "\\|"))
    return text


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(?:(\\)|\|)", "$1")


def examples(conversations: DataFrame) -> DataFrame:
    """One row per example: conv_id, target_turn, n_turns, formatted, loss_start, loss_length.

    Turns stand in the order of (turn, role, text), nulls first; null roles and texts count as empty,
    null conv_id is a conversation. loss_start and loss_length count code points of ``formatted``;
    loss_length is null in an example without a trainable part. target_turn counts from 1. An example
    holds all turns up to its target, so a conversation's examples grow as the square of its turns:
    that is the expansion itself. An empty table gives an empty result; other columns are ignored.
    """
    null = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = conversations.select("conv_id", F.struct("turn", null("role").alias("role"), null("text").alias("text")).alias("turn"))
    whole = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    whole = whole.select(
        "conv_id", "turns", F.size("turns").alias("n_turns"),
        F.transform("turns", lambda t: F.concat(F.lit(START), escape(t["role"]), F.lit(SEP), escape(t["text"]), F.lit(END))).alias("blocks"),
        F.filter(F.sequence(F.lit(1), F.size("turns")), lambda i: F.get(F.col("turns"), i - 1)["role"] == "assistant").alias("targets"),
    )
    rest = F.coalesce(F.array_max("targets"), F.lit(0)) < F.col("n_turns")
    targets = F.when(rest, F.concat("targets", F.array("n_turns"))).otherwise(F.col("targets"))
    each = whole.select("conv_id", "turns", "n_turns", "blocks", F.explode(targets).alias("target_turn"))
    last = F.get(F.col("turns"), F.col("target_turn") - 1)
    each = each.select(
        "conv_id", "n_turns", "target_turn", (last["role"] == "assistant").alias("trains"),
        F.concat(F.array_join(F.slice("blocks", F.lit(1), F.col("target_turn") - 1), ""), F.lit(START), escape(last["role"]), F.lit(SEP)).alias("context"),
        escape(last["text"]).alias("reply"),
    )
    return each.select(
        "conv_id", "target_turn", "n_turns", F.concat("context", "reply", F.lit(END)).alias("formatted"),
        F.length("context").cast("long").alias("loss_start"), F.when(F.col("trains"), F.length("reply").cast("long")).alias("loss_length"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """What the examples of each conversation say, parsed from their text and loss mask alone."""
    parts = F.filter(F.split("formatted", END_PATTERN), lambda p: p != "")
    turns = F.transform(parts, lambda p: F.split(p, SEP_PATTERN))
    spoken = F.transform(turns, lambda t: F.concat(unescape(F.substring(F.get(t, F.lit(0)), len(START) + 1, 1 << 30)), F.lit("\n"), unescape(F.get(t, F.lit(1))), F.lit("\n")))
    trained = F.when(F.col("loss_length").isNotNull(), unescape(F.substring(F.col("formatted"), (F.col("loss_start") + 1).cast("int"), F.col("loss_length").cast("int")))).otherwise("")
    rows = formatted.select(
        "conv_id", "target_turn", F.length("formatted").cast("long").alias("chars"), trained.alias("trained"),
        # the example that ends with the last turn holds them all
        F.when(F.col("target_turn") == F.col("n_turns"), spoken).alias("spoken"),
    )
    whole = rows.groupBy("conv_id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("target_turn", "trained"))), lambda x: x["trained"]), "").alias("loss"),
        F.first("spoken", ignorenulls=True).alias("spoken"), F.sum("chars").alias("formatted_chars"),
    )
    return whole.select(
        "conv_id", F.size("spoken").cast("long").alias("n_turns"), F.sha2(F.array_join("spoken", ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars",
    )


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    return read_back(examples(rows.unionByName(more)))


OP3_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
), e AS (
  SELECT *, 3 + length(role) + 2 * (length(role) - length(replace(replace(role, '[', ''), '<', ''))) + (length(role) - length(replace(role, '\', ''))) + 6
           + length(text) + 2 * (length(text) - length(replace(replace(text, '[', ''), '<', ''))) + (length(text) - length(replace(text, '\', ''))) + 11 AS chars,
         row_number() OVER w AS n, count(*) OVER (PARTITION BY conv_id) AS n_turns
  FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), f AS (
  SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY n ROWS UNBOUNDED PRECEDING) AS upto FROM e
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(upto) FILTER (WHERE role = 'assistant' OR n = n_turns)::BIGINT AS formatted_chars
FROM f GROUP BY conv_id
"""
