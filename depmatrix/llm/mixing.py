"""Mixing sources to target weights, in DataFrame functions: a multivariate-hypergeometric splitting tree over block quotas.

A source's documents, in an order drawn by hash, form a line of words that is cut into equal blocks. Its target is met by an
exact quota of block draws: whole passes over its blocks, and a disjoint subset for the rest. Sources, targets and quotas are a table of any length: targets by sums
over ranges of it. For the tree each source with a 1,024th of all draws stands alone; the others' draws are laid end to end in 1,024 lines, by hash of the source, so it has at most 2,048
leaves to a shard whatever the sources. The tree halves the output shards: each node holds the draws left to its lines, its left child gets a multivariate-hypergeometric draw of half of
them, its right child what remains, so quotas add up exactly at every level. A leaf (shard) knows how many draws it gets from each
line; a line's draws, in permuted order, are dealt to the shards in that proportion (so those of one of its sources are a multivariate-hypergeometric draw as well), and each shard orders
its draws by hash. Rows stay in the executors.
"""

from __future__ import annotations

import itertools
import json
import math
import random

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from depmatrix.llm.shared import WORD, written

WEIGHTS = (5, 2, 1)
#: Lines of sources too small to stand alone; as many stand alone at most.
LINES = 1024
#: Blocks of a source at most: rounding to blocks stays far below a thousandth of it.
MOST_BLOCKS = 1 << 14
#: Primes above MOST_BLOCKS, so that they have no factor in common with a number of blocks.
PRIMES = (1000003, 15485863, 32452843, 49979687, 67867967, 86028121)
DRAW = "array<struct<shard:int,rank:bigint,first:bigint,words:bigint>>"


def hypergeometric(rng: random.Random, good: int, total: int, draws: int) -> int:
    """How many of `draws` taken from `total`, without replacement, are among the `good`. Inverse distribution around its mode."""
    low, high = max(0, draws - (total - good)), min(good, draws)
    if low == high:
        return low
    mode = min(high, max(low, (draws + 1) * (good + 1) // (total + 2)))
    spread = int(12 * math.sqrt(max(1.0, draws * good / total * (1 - good / total))) + 12)
    up = np.arange(mode, min(high, mode + spread), dtype=float)
    down = np.arange(mode, max(low, mode - spread), -1, dtype=float)
    rest = float(total - good - draws)
    above = np.cumprod((good - up) * (draws - up) / ((up + 1) * (rest + up + 1)))
    below = np.cumprod(down * (rest + down) / ((good - down + 1) * (draws - down + 1)))
    weight = np.concatenate([below[::-1], [1.0], above])
    reached = np.cumsum(weight)
    return mode - len(below) + min(len(weight) - 1, int(np.searchsorted(reached, rng.random() * reached[-1])))


def split_tree(quotas: list[int], shards: int, seed: int = 7) -> list[list[int]]:
    """Draws of each source in each shard, [shard][source]: columns add up to the quotas, rows differ by one at most in their sum."""

    def node(left: list[int], first: int, many: int) -> list[list[int]]:
        if many == 1:
            return [left]
        half, rng = many // 2, random.Random(f"{seed}/{first}/{many}")
        total = sum(left)
        take = total * half // many
        mine = []
        for q in left:
            mine.append(hypergeometric(rng, q, total, take))
            total, take = total - q, take - mine[-1]
        return node(mine, first, half) + node([q - x for q, x in zip(left, mine, strict=True)], first + half, many - half)

    return node(list(quotas), 0, shards)


def _before(df: DataFrame, order: list[Column | str], **values: Column | str) -> DataFrame:
    """df with a column of each name: the sum of the values in all rows before, in a total order. Ranges are sorted in their tasks; only a row a task is summed in one place."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = written(ranged.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()))
    sums = {k: F.sum(F.lit(v) if isinstance(v, int) else v) for k, v in values.items()}
    earlier = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    totals = placed.groupBy("_part").agg(*(v.alias(f"_{k}") for k, v in sums.items()))
    starts = totals.select("_part", *(F.coalesce(F.sum(f"_{k}").over(earlier), F.lit(0)).alias(f"_{k}") for k in sums))
    inside = W.partitionBy("_part").orderBy("_at").rowsBetween(W.unboundedPreceding, -1)
    out = placed.select("*", *(F.coalesce(v.over(inside), F.lit(0)).alias(k) for k, v in sums.items())).join(F.broadcast(starts), "_part")
    return out.select(*df.columns, *((F.col(k) + F.col(f"_{k}")).alias(k) for k in sums))


def source_targets(sizes: DataFrame, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """sizes (source, n; one row a source) with place (by code point, null last), weight and target: shares of share * sum(n) by weight; none above most * n, what is above
    goes to the others by weight, until none is. Sources are filled up in the order of n to weight: before one of them all are full, from it on none is."""
    place = F.col("place")
    weight = F.element_at(F.array(*(F.lit(w) for w in WEIGHTS)), (place % len(WEIGHTS) + 1).cast("int"))
    named = _before(sizes, [F.asc_nulls_last("source")], place=1).withColumn("weight", weight)
    named = named.withColumn("ratio", F.lit(most) * F.col("n") / F.col("weight"))
    filled = written(_before(named, ["ratio", "place"], n_before="n", w_before="weight"))
    n, w = filled.agg(F.sum("n"), F.sum("weight")).first()
    level = (F.lit(share * (n or 0)) - most * F.col("n_before")) / (F.lit(w or 0) - F.col("w_before"))
    open_ = filled.withColumn("level", level).filter("level <= ratio")
    found = open_.agg(F.min_by("level", F.struct("ratio", "place"))).first()[0]
    target = F.least(most * F.col("n"), F.lit(float(found or 0.0)) * F.col("weight"))
    return filled.select("source", "n", "place", "weight", target.alias("target"))


def source_plans(sizes: DataFrame, seed: int = 7, most_blocks: int = MOST_BLOCKS) -> DataFrame:
    """One row a source, as a written table: s, place, source_size, target, block (its words, the last may have fewer), blocks, passes (each block is drawn so often), extra (and so many once
    more), step and shift (block b stands at (b * step + shift) mod blocks in permuted order), quota (draws), line."""
    n, block, blocks, passes = F.col("source_size"), F.col("block"), F.col("blocks"), F.col("passes")
    drawn = lambda salt: F.xxhash64("s", F.lit(seed), F.lit(salt))
    plans = source_targets(sizes).select(F.col("source").alias("s"), "place", F.col("n").alias("source_size"), "target")
    plans = plans.withColumn("block", F.greatest(F.lit(1), F.ceil(n / most_blocks)).cast("long"))
    plans = plans.withColumn("blocks", F.greatest(F.lit(1), F.ceil(n / block)).cast("long"))
    plans = plans.withColumn("passes", F.when(n > 0, F.least(F.lit(2), F.floor(F.col("target") / n))).otherwise(0).cast("int"))
    more = F.rint((F.col("target") - passes * n) / block).cast("long")
    plans = plans.withColumn("extra", F.when((n > 0) & (passes < 2), F.least(blocks, more)).otherwise(0).cast("long"))
    step = F.element_at(F.array(*(F.lit(p) for p in PRIMES)), (F.pmod(drawn("step"), F.lit(len(PRIMES))) + 1).cast("int")).cast("long")
    plans = plans.withColumn("step", step).withColumn("shift", F.pmod(drawn("shift"), blocks)).withColumn("quota", passes * blocks + F.col("extra"))
    plans = written(plans)
    whole = plans.agg(F.sum("quota")).first()[0] or 0
    line = F.when(F.col("quota") * LINES >= whole, LINES + F.col("place")).otherwise(F.pmod(drawn("line"), F.lit(LINES)))
    return written(plans.withColumn("line", line.cast("long")))


def _lines(plans: DataFrame, shards: int, seed: int) -> DataFrame:
    """One row a line (at most twice LINES), as a written table: its draws, how they are permuted, and where each shard's end among them."""
    totals = plans.groupBy("line").agg(F.sum("quota").alias("q")).orderBy("line").collect()
    tree, rows = split_tree([r["q"] for r in totals], shards, seed), []
    for k, (line, q) in enumerate(totals):
        rng, many = random.Random(f"{seed}/{line}"), max(1, q)
        step = next(x for x in iter(lambda: rng.randrange(1, min(many, 1 << 20) + 1), None) if math.gcd(x, many) == 1)
        ends = list(itertools.accumulate(row[k] for row in tree[:-1]))
        rows.append({"l": line, "line_draws": many, "line_step": step, "line_shift": rng.randrange(many), "bounds": ends})
    kind = "array<struct<l:bigint,line_draws:bigint,line_step:bigint,line_shift:bigint,bounds:array<bigint>>>"
    return written(plans.sparkSession.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), kind))))


def _draws(span_first: Column, size: Column, p: dict[str, Column], seed: int) -> Column:
    """The document's part of every draw of the blocks that it lies in."""
    last = span_first + size - 1
    block = p["block"]

    def of_block(b: Column) -> Column:
        begin, end = F.greatest(span_first, b * block), F.least(last, (b + 1) * block - 1)
        place = F.pmod(b * p["step"] + p["shift"], p["blocks"])
        times = p["passes"] + F.when(place < p["extra"], 1).otherwise(0)
        stands = lambda t: F.pmod((p["offset"] + t * p["blocks"] + place) * p["line_step"] + p["line_shift"], p["line_draws"])
        one = lambda t: F.struct(  # noqa: E731  the shard is found from where the draw stands among the line's draws
            F.size(F.filter(p["bounds"], lambda x: x <= stands(t))).alias("shard"), F.xxhash64(p["source"], b, t, F.lit(seed)).alias("rank"), (begin - span_first).alias("first"), (end - begin + 1).alias("words"))
        return F.when(times > 0, F.transform(F.sequence(F.lit(0), times - 1), one)).otherwise(F.array().cast(DRAW))

    div = lambda a: F.floor(a / block).cast("long")
    return F.when(size > 0, F.flatten(F.transform(F.sequence(div(span_first), div(last)), of_block))).otherwise(F.array().cast(DRAW))


def mix(docs: DataFrame, shards: int = 16, bucket_rows: int = 1 << 20, seed: int = 7) -> DataFrame:
    """One row per row of docs: doc_id, source, size, source_size, target, draws (shard, rank within the shard, first word, words).

    Null text has size 0 and no draws; null source is a source of its own, after the others. Repeated rows are separate documents that
    lie next to each other on the line. A very long text is cut into its blocks like any other. Empty table: no rows. Extra columns are not looked at.
    Same rows, same draws, however partitioned. bucket_rows: documents in a stretch of a source's line (256 stretches at least), which one task puts in order."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    sized = written(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            F.col("source").cast("string").alias("source"),
            F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
            F.xxhash64("text").alias("tie"),
        )
    )
    buckets = max(256, -(-sized.count() // bucket_rows))
    bucket = F.pmod(F.xxhash64("doc_id", "tie", F.lit(seed)), F.lit(buckets)).cast("int")
    parts = written(sized.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("words")))
    plans = source_plans(parts.groupBy("source").agg(F.sum("words").alias("n")), seed)
    offset = F.coalesce(F.sum("quota").over(W.partitionBy("line").orderBy("place").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    lines = F.broadcast(_lines(plans, shards, seed))  # at most twice LINES rows
    table = plans.withColumn("offset", offset).join(lines, F.col("line") == F.col("l")).drop("l", "line", "place", "quota")
    before = F.coalesce(F.sum("words").over(W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = (
        parts.select("source", "bucket", before.alias("base"))
        .join(table, F.col("source").eqNullSafe(F.col("s")))
        .select(F.col("bucket").alias("k"), "base", *table.columns)
    )
    inside = F.sum("size").over(
        W.partitionBy("source", "bucket")
        .orderBy(F.xxhash64("doc_id", F.lit(seed + 1)), "doc_id", "tie", "size")
        .rowsBetween(W.unboundedPreceding, -1)
    )
    placed = sized.withColumn("bucket", bucket).withColumn("inside", F.coalesce(inside, F.lit(0)))
    joined = placed.join(starts, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("k")))
    names = "block blocks passes extra step shift source offset line_draws line_step line_shift bounds".split()
    p = {c: F.col(c) for c in names}
    return joined.withColumn("at", F.col("base") + F.col("inside")).select(
        "doc_id", "source", "size", "source_size", "target", _draws(F.col("at"), F.col("size"), p, seed).alias("draws")
    )


def by_document(mixed: DataFrame) -> DataFrame:
    """mixed with figures of its draws instead of them: taken (words, repeats counted), n_draws, shards (numbers in order, joined by commas) and first_rank, the
    document's first place in the order of its first shard (both null if nothing is taken)."""
    taken = F.aggregate("draws", F.lit(0).cast("long"), lambda a, d: a + d["words"])
    shards = F.array_sort(F.array_distinct(F.transform("draws", lambda d: d["shard"])))
    first = F.array_min(F.transform("draws", lambda d: F.struct(d["shard"].alias("shard"), d["rank"].alias("rank"))))
    named = F.when(F.size("draws") > 0, F.array_join(shards.cast("array<string>"), ","))
    return mixed.select(
        "doc_id",
        "source",
        "size",
        "source_size",
        "target",
        taken.alias("taken"),
        F.size("draws").cast("long").alias("n_draws"),
        named.alias("shards"),
        first["rank"].alias("first_rank"),
    )


def shard_rows(mixed: DataFrame) -> DataFrame:
    """The mix as rows in output order within each shard: (shard, rank, doc_id, first, words). A shard's order is by hash, so it is shuffled in itself; the
    rows are divided by ranges of (shard, rank), so a shard may be many tasks."""
    order = ("shard", "rank", "doc_id", "first")
    rows = mixed.select("doc_id", F.explode("draws").alias("d")).select("d.shard", "d.rank", "doc_id", "d.first", "d.words")
    return rows.repartitionByRange(*order).sortWithinPartitions(*order)
