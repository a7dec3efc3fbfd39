"""Preference formatting, in DataFrame functions: the longest common turn prefix of a chosen and a rejected conversation is
rendered once as prompt, the rest of each as completions with a loss mask.

Output is one row for each rendered turn, so that a conversation of any length is never one value: part is prompt, chosen or
rejected, pos counts from 0 over the pair's conversation, train is 1 on assistant turns of completions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from depmatrix.llm.shared import split_join, written


def rendered(role: Column, text: Column) -> Column:
    return F.concat(F.lit("<|"), F.coalesce(role, F.lit("")), F.lit("|>\n"), F.coalesce(text, F.lit("")), F.lit("<|end|>\n"))


def _numbered(turns: DataFrame, key: str) -> DataFrame:
    """turns with pos, their place in the conversation. Turns are numbered within stretches of 1,024 turn numbers, to which what stands before each is added,
    so that a conversation of any length is many tasks. Turns without a number are the last stretch."""
    last = F.lit((1 << 63) - 1)
    placed = turns.withColumn("stretch", F.coalesce(F.shiftright("turn", 10), last))
    counts = placed.groupBy(F.col(key).alias("_k"), F.col("stretch").alias("_s")).agg(F.count("*").alias("n"))
    before = F.sum("n").over(W.partitionBy("_k").orderBy("_s").rowsBetween(W.unboundedPreceding, -1))
    starts = counts.select("_k", "_s", F.coalesce(before, F.lit(0)).alias("first"))
    order = W.partitionBy(key, "stretch").orderBy(*(F.col(c).asc_nulls_last() for c in ("turn", "role", "text")))
    ranked = placed.withColumn("inside", F.row_number().over(order) - 1)
    joined = ranked.join(starts, (F.col(key) == F.col("_k")) & (F.col("stretch") == F.col("_s")))
    return joined.select(key, (F.col("first") + F.col("inside")).cast("int").alias("pos"), "role", "text")


def preference_segments(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """chosen, rejected: (pair_id, turn, role, text). Returns (pair_id, part, pos, role, rendered, train, prompt_turns).

    Turns stand in the order of turn, then role, then text, nulls last in each, so ties and repeats have one order; null role or text equals null and renders
    as empty, very long ones whole. A side without turns has no rows; rows with a null pair_id are of no pair and are left out. Extra columns are not looked at."""
    keep = lambda df: df.select(
        "pair_id",
        F.col("turn").cast("long").alias("turn"),
        F.col("role").cast("string").alias("role"),
        F.col("text").cast("string").alias("text"),
    ).filter("pair_id is not null")
    a = _numbered(keep(chosen), "pair_id").select("pair_id", "pos", F.struct("role", "text").alias("a"))
    b = _numbered(keep(rejected), "pair_id").select("pair_id", "pos", F.struct("role", "text").alias("b"))
    both = written(a.join(b, ["pair_id", "pos"], "full_outer"))
    same = (
        F.col("a").isNotNull()
        & F.col("b").isNotNull()
        & F.col("a.role").eqNullSafe(F.col("b.role"))
        & F.col("a.text").eqNullSafe(F.col("b.text"))
    )
    # the first turn that differs ends the prompt: a grouped minimum, joined back with long conversations split from the rest
    ends = both.groupBy(F.col("pair_id").alias("_p")).agg(
        F.coalesce(F.min(F.when(~same, F.col("pos"))), F.max("pos") + 1).alias("prompt_turns"), F.count("*").alias("_n")
    )
    shared = F.col("pos") < F.col("prompt_turns")
    part = lambda name, side: (
        F.struct(F.lit(name).alias("part"), F.col(f"{side}.role").alias("role"), F.col(f"{side}.text").alias("text"))
    )
    segments = F.when(shared, F.array(part("prompt", "a"))).otherwise(
        F.filter(
            F.array(F.when(F.col("a").isNotNull(), part("chosen", "a")), F.when(F.col("b").isNotNull(), part("rejected", "b"))),
            lambda x: x.isNotNull(),
        )
    )
    out = split_join(both, written(ends), [("pair_id", "_p")], "_n").select(
        "pair_id", "pos", "prompt_turns", F.explode(segments).alias("s")
    )
    train = ((F.col("s.part") != "prompt") & F.coalesce(F.col("s.role") == "assistant", F.lit(False))).cast("int")
    return out.select(
        "pair_id",
        F.col("s.part").alias("part"),
        "pos",
        F.col("s.role").alias("role"),
        rendered(F.col("s.role"), F.col("s.text")).alias("rendered"),
        train.alias("train"),
        "prompt_turns",
    )


def pairs_from_conversations(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chosen and rejected sides out of plain conversations: pair_id is conv_id; chosen is the conversation; rejected is what stands before its
    last assistant turn, then the last assistant turn of its neighbour (conv_id with the lowest bit flipped), the usual stand-in for a bad reply.

    A turn without a number stands after all that have one, so it is part of the chosen side only, and is never the last assistant turn.
    A conversation whose neighbour, or which itself, has no assistant turn gets a rejected side without that turn."""
    c = conversations.select(
        F.col("conv_id").cast("long").alias("pair_id"),
        F.col("turn").cast("long").alias("turn"),
        F.col("role").cast("string").alias("role"),
        F.col("text").cast("string").alias("text"),
    ).filter("pair_id is not null")
    said = F.when((F.col("role") == "assistant") & F.col("turn").isNotNull(), F.struct("turn", "text"))
    last = c.groupBy("pair_id").agg(F.max(said).alias("reply"), F.max("turn").alias("end"))
    cut = last.select("pair_id", F.coalesce("reply.turn", F.col("end") + 1).alias("cut"))
    neighbour = last.filter("reply is not null").select(
        F.col("pair_id").bitwiseXOR(F.lit(1).cast("long")).alias("pair_id"), F.col("reply.text").alias("text")
    )
    before = c.join(cut, "pair_id").filter("turn < cut").select("pair_id", "turn", "role", "text")
    reply = neighbour.join(cut, "pair_id").select("pair_id", F.col("cut").alias("turn"), F.lit("assistant").alias("role"), "text")
    return c, before.unionByName(reply)
