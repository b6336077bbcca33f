"""Chat formatting with cumulative-snapshot collapse, with built-in DataFrame operations only.

Logs hold a conversation again each time it grows. Every turn's prefix gets a rolling hash; a
conversation whose whole hash is also the hash of a strict prefix of another one (or of an equal
one with a smaller id) is dropped by anti-join, and only maximal conversations are rendered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import table, written

START, END = "<|im_start|>", "<|im_end|>"


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, pos, h1, h2, last, n_turns): for each turn, the hash of the conversation up to it.

    The rolling hash is the xor of position-salted hashes of the turns, 128 bits in two halves; the
    order of turns enters through the position. A conversation's own turns are ordered in one task,
    as it is rendered into one string anyway.
    """
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    t = turns.withColumn("pos", F.row_number().over(order))
    t = t.withColumn("h1", F.bit_xor(F.xxhash64("pos", "role", "text")).over(upto)).withColumn("h2", F.bit_xor(F.xxhash64("text", "role", "pos", F.lit("2"))).over(upto))
    return t.select("conv_id", "pos", "h1", "h2", F.lead("pos").over(order).isNull().alias("last"))


def collapse(turns: DataFrame) -> DataFrame:
    """The ids of maximal conversations: (conv_id, copies), copies: equal conversations, itself included."""
    p = written(prefixes(turns), "chat-prefixes")
    whole = p.where("last").groupBy("pos", "h1", "h2").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("copies"))
    inner = p.where("NOT last").select("pos", "h1", "h2").distinct()
    return whole.join(inner, ["pos", "h1", "h2"], "left_anti").select("conv_id", "copies")


def render(turns: DataFrame, start: str = START, end: str = END) -> DataFrame:
    """One row per conversation: conv_id, n_turns, rendered."""
    one = F.struct(F.col("turn"), F.col("role"), F.col("text"))
    said = F.transform(F.sort_array(F.collect_list(one)), lambda x: F.concat(F.lit(start), x["role"], F.lit("\n"), x["text"], F.lit(end + "\n")))
    return turns.groupBy("conv_id").agg(F.count("*").alias("n_turns"), F.array_join(said, "").alias("rendered"))


def format_conversations(conversations: DataFrame) -> DataFrame:
    """Maximal conversations, rendered: conv_id, copies, n_turns, rendered.

    Turns are ordered by turn (null first), role and text; repeated rows count as turns of their
    own. A null role is "unknown", a null text empty. Rows with a null conv_id belong to no
    conversation and are left out. Of equal conversations the smallest conv_id stays. Of very long
    texts nothing is cut. Other columns are not read; an empty table gives no rows.
    """
    turns = conversations.where("conv_id IS NOT NULL").select("conv_id", "turn", F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    kept = collapse(turns)
    return render(turns.join(kept.select("conv_id"), "conv_id", "left_semi")).join(kept, "conv_id").select("conv_id", "copies", "n_turns", "rendered")


def op7_snapshot_collapse(spark, sf_dir: str) -> DataFrame:
    return format_conversations(table(spark, sf_dir, "conversations"))


OP7_SQL = """
WITH c AS (
  SELECT conv_id, list({'role': coalesce(role, 'unknown'), 'text': coalesce(text, '')} ORDER BY turn NULLS FIRST, coalesce(role, 'unknown'), coalesce(text, '')) AS turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
d AS (SELECT turns, min(conv_id) AS conv_id, count(*) AS copies FROM c GROUP BY turns),
k AS (SELECT * FROM d a WHERE NOT EXISTS (
  SELECT 1 FROM d b WHERE len(b.turns) > len(a.turns) AND b.turns[1] = a.turns[1] AND b.turns[1:len(a.turns)] = a.turns))
SELECT conv_id, copies, CAST(len(turns) AS BIGINT) AS n_turns,
  array_to_string(list_transform(turns, lambda x: concat('<|im_start|>', x.role, chr(10), x.text, '<|im_end|>', chr(10))), '') AS rendered
FROM k
"""
