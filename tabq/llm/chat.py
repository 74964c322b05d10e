r"""Chat formatting by prefix-target expansion. DataFrame functions only.

Template: every turn is ``<|role|>text<|end|>``. Inside roles and texts a backslash becomes ``\\`` and a bar ``\|``, so
no control string can occur there, and reading back is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

OPEN, CLOSE, END = "<|", "|>", "<|end|>"


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|"))


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def examples(turns: DataFrame) -> DataFrame:
    """One row per assistant turn of ``turns (conv_id, turn, role, text)``: ``conv_id, example, context, target, n_turns``.

    ``context`` is all earlier turns of the conversation and the header of the assistant's turn; ``target``, the reply
    and its end mark, is the only text to train on. Turns after the last reply (or a conversation without any) come as
    one example without target, so that no turn is lost; it trains nothing. Turns are in order of ``turn`` (null first), then role,
    then text; repeated rows are turns of their own. Null texts and roles count as empty, null ids form one
    conversation. Other columns play no part, an empty table gives no example.
    """
    turn = F.struct(F.col("turn").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    whole = turns.select("conv_id", turn.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    heads = F.transform("turns", lambda t: F.concat(F.lit(OPEN), escaped(t["role"]), F.lit(CLOSE)))
    bodies = F.transform("turns", lambda t: F.concat(escaped(t["text"]), F.lit(END)))
    whole = whole.select("conv_id", "turns", heads.alias("heads"), bodies.alias("bodies"))
    replies = F.filter(F.sequence(F.lit(1), F.size("turns")), lambda i: F.element_at("turns", i)["role"] == "assistant")
    last = F.size("turns")
    # Past the last turn stands the example without target; it is left out where a reply ends the conversation.
    at = F.when(F.element_at("turns", -1)["role"] == "assistant", replies).otherwise(F.concat(replies, F.array(last + 1)))
    whole = whole.select("conv_id", "heads", "bodies", last.alias("n"), F.posexplode(at).alias("example", "k"))
    earlier = F.array_join(F.zip_with(F.slice("heads", F.lit(1), F.col("k") - 1), F.slice("bodies", F.lit(1), F.col("k") - 1), lambda h, b: F.concat(h, b)), "")
    own = F.col("k") <= F.col("n")
    context = F.concat(earlier, F.when(own, F.get("heads", F.col("k") - 1)).otherwise(F.lit("")))
    return whole.select("conv_id", "example", context.alias("context"), F.when(own, F.get("bodies", F.col("k") - 1)).alias("target"), F.least("k", "n").alias("n_turns"))


def read_back(formatted: Column) -> Column:
    """The turns of a formatted text: an array of ``role, text``."""
    parts = F.split(formatted, r"<\|end\|>", -1)
    parts = F.slice(parts, F.lit(1), F.size(parts) - 1)
    head = r"(?s)^<\|((?:[^\\|]++|\\.)*+)\|>(.*)$"
    return F.transform(parts, lambda p: F.struct(unescaped(F.regexp_extract(p, head, 1)).alias("role"), unescaped(F.regexp_extract(p, head, 2)).alias("text")))


def digests(formatted: DataFrame) -> DataFrame:
    """What :func:`examples` holds of each conversation, read back from the examples alone.

    The last example holds every turn; the targets, in order, are what is trained on. ``formatted_chars`` counts the
    characters of all contexts and targets.
    """
    text = F.concat("context", F.coalesce("target", F.lit("")))
    trained = unescaped(F.regexp_replace("target", r"<\|end\|>$", ""))
    per = formatted.groupBy("conv_id").agg(
        F.max_by(text, "example").alias("all"),
        F.sort_array(F.collect_list(F.when(F.col("target").isNotNull(), F.struct("example", trained.alias("text"))))).alias("loss"),
        F.sum(F.length(text)).alias("formatted_chars"),
    )
    per = per.withColumns({"turns": read_back(F.col("all")), "loss": F.array_join(F.transform("loss", lambda x: x["text"]), "")})
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return per.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.col("formatted_chars").cast("long").alias("formatted_chars"),
    )


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "\\### Assistant: </turn> ok"
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], turns.schema)
    return digests(examples(turns.unionByName(extra)))


ORACLE = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, unnest([0, 1]), unnest(['user', 'assistant']), '\### Assistant: </turn> ok'),
lens AS (
  SELECT *, strlen(role) + length(text) + 11 + length(text) - length(replace(text, '\', '')) + length(text) - length(replace(text, '|', '')) AS len,
         max(CASE WHEN role = 'assistant' THEN turn END) OVER (PARTITION BY conv_id) AS last_reply,
         max(turn) OVER (PARTITION BY conv_id) AS last_turn FROM rows),
run AS (SELECT *, sum(len) OVER (PARTITION BY conv_id ORDER BY turn) AS chars FROM lens)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(CASE WHEN role = 'assistant' OR (turn = last_turn) THEN chars ELSE 0 END)::BIGINT AS formatted_chars
FROM run GROUP BY conv_id
"""
