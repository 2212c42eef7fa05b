"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it are
context, and only that reply is under the loss mask.  A turn is written as
``[INST]role[/INST]text</s>``; these control strings are escaped in roles and
texts, so that the output can be read back exactly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE, END = "[INST]", "[/INST]", "</s>"
#: What stands for what inside a text, in the order of escaping.
ESCAPES = (("~", "~0"), (OPEN, "~1"), (CLOSE, "~2"), (END, "~3"))
PROBE = "</s>[INST] ok [/INST]"


def escape(text):
    for plain, coded in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(coded))
    return text


def unescape(text):
    for plain, coded in reversed(ESCAPES):
        text = F.replace(text, F.lit(coded), F.lit(plain))
    return text


def with_probe(conversations: DataFrame) -> DataFrame:
    """All rows and conversation -1, whose two turns consist of control strings."""
    spark = conversations.sparkSession
    own = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    probe = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(PROBE).alias("text"),
    )
    return own.unionByName(probe)


def expand_targets(conversations: DataFrame, target: str = "assistant") -> DataFrame:
    """Examples ``conv_id, target_turn, text, loss_start, loss_chars, trainable``.

    ``target_turn`` counts turns from 0 in order of (turn, role, text), nulls
    first.  Turns after the last reply, or all turns of a conversation without
    a reply, form one more example with an empty mask, so that no row is lost.
    Null roles and texts are empty; rows with a null ``conv_id`` form one
    conversation; repeated rows are turns of their own; texts may be of any
    length; an empty table gives no examples; other columns are ignored.

    One conversation is one row while it is expanded, and its examples grow
    with the square of its turns, as each holds all turns before it.
    """
    empty = F.lit("")
    turns = conversations.select("conv_id", F.struct("turn", F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text")).alias("t"))
    grouped = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    parts = F.transform("turns", lambda t: F.concat(F.lit(OPEN), escape(t["role"]), F.lit(CLOSE), escape(t["text"]), F.lit(END)))
    spots = F.filter(
        F.transform("turns", lambda t, i: F.struct(i.alias("at"), (t["role"] == target).alias("own"), F.length(escape(t["text"])).alias("n"))),
        lambda s: s["own"] | (s["at"] == F.size("turns") - 1),
    )
    rows = grouped.select("conv_id", parts.alias("parts"), F.explode(spots).alias("s"))
    text = F.array_join(F.slice("parts", F.lit(1), F.col("s.at") + 1), "")
    loss = F.when(F.col("s.own"), F.col("s.n")).otherwise(0)
    return rows.select("conv_id", F.col("s.at").alias("target_turn"), text.alias("text"), loss.alias("loss_chars"), F.col("s.own").alias("trainable")).select(
        "conv_id", "target_turn", "text", (F.length("text") - len(END) - F.col("loss_chars")).alias("loss_start"), "loss_chars", "trainable"
    )


def read_back(examples: DataFrame) -> DataFrame:
    """Digests of each conversation, taken from the formatted examples alone; no examples give no rows."""
    masked = unescape(F.substring(F.col("text"), F.col("loss_start") + 1, F.col("loss_chars")))
    grouped = examples.groupBy("conv_id").agg(
        F.max_by("text", "target_turn").alias("full"),
        F.sort_array(F.collect_list(F.struct("target_turn", masked.alias("reply")))).alias("replies"),
        F.sum(F.length("text")).cast("long").alias("formatted_chars"),
    )
    units = F.filter(F.split(F.col("full"), END), lambda u: u != "")
    turn = lambda u: F.concat(
        unescape(F.substring_index(F.substring(u, len(OPEN) + 1, 1 << 30), CLOSE, 1)),
        F.lit("\n"),
        unescape(F.substring_index(u, CLOSE, -1)),
        F.lit("\n"),
    )
    loss = F.array_join(F.transform("replies", lambda r: r["reply"]), "")
    read = grouped.select("conv_id", units.alias("units"), loss.alias("loss"), "formatted_chars")
    return read.select(
        "conv_id",
        F.size("units").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("units", turn), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )
