"""SimHash near-duplicates: byte-position inverted index with count filtering.

Two 64-bit fingerprints that differ in at most d bits agree in at least 8 - d of their 8 bytes. Postings are keyed by
(positions, bytes there) for a family of position sets such that any 8 - d agreeing positions contain a member; for d = 4
that is the 20 triples of a Turán system, so that lists stay short (24 bits a key) and a near pair still meets in one.
Within a list the positional bytes that a pair shares are tallied, pairs below the guaranteed minimum go, the rest are
verified by their differing bits. A list emits a spanning forest of its links, never all pairs. Equal fingerprints
are one node. Lists above `list_limit` (many different but close fingerprints) don't get compared pairwise: each
fingerprint links to the values within d/2 bits of it that keep the list's bytes, and two that are within d bits share one of
those, so the rows stay in proportion to the list.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from depmatrix.llm.components import connected_components
from depmatrix.llm.shared import byte_table, split_join, string_parts, written

_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_SPACED = byte_table().spaced()
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def fingerprint(text: bytes, words: int = 4, seed: int = 42, piece: int = 1 << 20) -> int:
    """SimHash of the lower-cased text's word shingles, repeats included; a bit is 1 if set in over half of the hashes. No words: 0.

    Works on about piece bytes at a time, up to the next white space, and keeps the last words - 1 words for the piece that follows, so a long text takes little more than itself."""
    ones, total, held, at = np.zeros(64, np.int64), 0, [], 0
    digest = xxhash.xxh64_intdigest
    while True:
        found = _SPACE.search(text, at + piece)
        end = found.start() if found else len(text)
        parts = held + text[at:end].translate(_SPACED).split()
        k = words if found or total else min(words, len(parts))  # fewer words than a shingle has: the whole sequence
        if k and len(parts) >= k:
            joined = b" ".join(parts)
            ends = np.cumsum([len(x) + 1 for x in parts]).tolist()
            starts = [0, *ends]
            hashes = np.array([digest(joined[s : e - 1], seed) for s, e in zip(starts, ends[k - 1 :], strict=False)], np.uint64)
            octets = hashes.astype("<u8").view(np.uint8).reshape(-1, 8)
            ones += np.concatenate([np.bincount(octets[:, i], minlength=256) @ _BITS for i in range(8)])
            total += len(hashes)
            parts = parts[len(parts) - words + 1 :]
        if not found:
            return int(np.packbits(2 * ones > total, bitorder="little").view("<u8")[0])
        held, at = parts, end


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4) -> DataFrame:
    """(doc_id, fp): one row per row of docs. Null text counts as empty, a very long one is hashed a megabyte at a time; other columns of docs are not looked at."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), _hashed(batch.column(1), words)], ["doc_id", "fp"])

    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")
    ).mapInArrow(run, "doc_id long, fp long")


def _fingerprint_column(words: int):
    @arrow_udf("long")
    def fp(texts: pa.Array) -> pa.Array:
        return _hashed(texts, words)

    return fp


def _hashed(texts: pa.Array, words: int) -> pa.Array:
    offsets, data = string_parts(texts)
    fps = [fingerprint(data[a:b].tobytes(), words) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
    return pa.array(np.array(fps, np.uint64).view(np.int64), pa.int64())


def position_sets(minimum: int) -> list[tuple[int, ...]]:
    """Sets of byte positions such that any `minimum` of the 8 positions contain one of them."""
    if minimum != 4:
        return list(combinations(range(8), min(3, minimum)))
    groups = ((0, 1, 2), (3, 4, 5), (6, 7))
    found = [x for g in groups for x in combinations(g, 3)]
    for k, g in enumerate(groups):
        found += [tuple(sorted((*two, one))) for two in combinations(g, 2) for one in groups[(k + 1) % 3]]
    return found


def _key(fp: Column, n: int, positions: tuple[int, ...]) -> Column:
    key = F.lit(n).cast("long")
    for p in positions:
        key = F.shiftleft(key, 8).bitwiseOR(F.shiftright(fp, 8 * p).bitwiseAND(F.lit(255)))
    return key


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The links' components as stars around their smallest member."""
    if not len(a):
        return a, b
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def _near(fp: np.ndarray, i: np.ndarray, j: np.ndarray, bits: int) -> np.ndarray:
    """Count filter, then verification."""
    x = fp[i] ^ fp[j]
    shared = (x.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1)
    keep = shared >= 8 - bits
    keep[keep] = np.bitwise_count(x[keep].view(np.uint64)) <= bits
    return keep


def _list_links(keys: np.ndarray, fps: np.ndarray, bits: int, block: int = 1 << 21) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links within each run of equal keys, some million pairs at a time."""
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    later = np.repeat(np.r_[starts[1:], len(keys)], np.diff(np.r_[starts, len(keys)])) - np.arange(len(keys)) - 1  # members after each
    at = 0
    run = np.cumsum(later)
    while at < len(keys):
        end = max(at + 1, int(np.searchsorted(run, (run[at - 1] if at else 0) + block, side="right")))
        many = later[at:end]
        i = np.repeat(np.arange(at, end), many)
        j = i + 1 + (np.arange(len(i)) - np.repeat(np.cumsum(many) - many, many))
        keep = _near(fps, i, j, bits)
        yield _forest(fps[i[keep]], fps[j[keep]])
        at = end


def _compare(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest_k, rest_f = np.zeros(0, np.int64), np.zeros(0, np.int64)
        empty = np.zeros(0, np.int64)

        def links(k, f):
            found = list(_list_links(k, f, bits)) if len(k) else []
            a, b = _forest(np.concatenate([x[0] for x in found] or [empty]), np.concatenate([x[1] for x in found] or [empty]))
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for batch in batches:
            k = np.concatenate([rest_k, batch.column(0).to_numpy(zero_copy_only=False)])
            f = np.concatenate([rest_f, batch.column(1).to_numpy(zero_copy_only=False)])
            if not len(k):
                continue
            cut = int(np.searchsorted(k, k[-1]))  # the last list may go on
            yield links(k[:cut], f[:cut])
            rest_k, rest_f = k[cut:], f[cut:]
        yield links(rest_k, rest_f)

    return run


def _ball(sets: list[tuple[int, ...]], radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masks = []
        for s in sets:
            free = [b for b in range(64) if b // 8 not in s]
            masks.append(
                np.array([sum(1 << b for b in c) for r in range(radius + 1) for c in combinations(free, r)], np.uint64).view(np.int64)
            )
        for batch in batches:
            ks, fs = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
            for k, f in zip((ks >> (8 * len(sets[0]))).tolist(), fs, strict=True):
                near = f ^ masks[k]
                # a value in the middle is a node of its own, told apart from fingerprints by `real`
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(near), f)), pa.array(near)], ["fp", "near"])

    return run


def near_links(fps: DataFrame, bits: int = 4, list_limit: int = 4096) -> DataFrame:
    """(a, b): links whose components are those of all pairs of distinct fingerprints within `bits` bits. fps: (fp), distinct."""
    sets = position_sets(8 - bits)
    parts = max(1, int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    keys = fps.select(
        F.explode(F.array(*(_key(F.col("fp"), n, s) for n, s in enumerate(sets)))).alias("key"), "fp"
    ).repartition(parts, "key")
    hot_keys = written(keys.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > list_limit))
    short = keys
    if not hot_keys.isEmpty():
        short = keys.join(hot_keys.select("key"), "key", "left_anti")
    short = short.select("key", "fp").sortWithinPartitions("key").mapInArrow(_compare(bits), "a long, b long")
    if hot_keys.isEmpty():
        return short
    hot = keys.join(hot_keys.select("key"), "key", "left_semi").select("key", "fp").repartition(parts)
    balls = hot.mapInArrow(_ball(sets, (bits + 1) // 2), "fp long, near long").distinct()
    hubs = balls.groupBy("near").agg(F.min("fp").alias("b"), F.count("*").alias("n")).filter("n > 1")
    # both ends are within bits/2 of the value between them, thus within bits of one another
    long = balls.join(hubs, "near").filter("fp <> b").select(F.col("fp").alias("a"), "b")
    return short.union(long)


def _components(fps: DataFrame, bits: int, list_limit: int) -> DataFrame:
    """fps (doc_id, fp), a written table, with the columns root (a fingerprint that names the component) and component_id (its smallest doc_id)."""
    nodes = written(fps.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")))
    roots = connected_components(near_links(nodes.select("fp"), bits, list_limit)).withColumnRenamed("node", "fp")
    rooted = written(nodes.join(roots, "fp", "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root")))
    ids = written(
        rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("_n")).withColumnRenamed("root", "_root")
    )
    named = written(split_join(rooted, ids, [("root", "_root")], "_n").select(F.col("fp").alias("_fp"), "n", "root", "component_id"))
    return split_join(fps, named, [("fp", "_fp")], "n")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, bits: int = 4, list_limit: int = 4096
) -> DataFrame:
    """(doc_id, fp, fingerprint, component_id), one row per row of docs; component_id is the smallest doc_id reachable over links of at most `bits` bits.

    Null or empty text: fingerprint zero, linked like any other. A repeated row comes out as often as it went in. Rows with a null
    id take part; their component_id is the smallest id that isn't null, or null. Empty table: no rows. Extra columns are not looked at."""
    found = _components(written(fingerprints(docs, id_col, text_col, words)), bits, list_limit)
    return found.select("doc_id", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, bits: int = 4) -> DataFrame:
    """The rows of docs, columns as they are, without the near duplicates: of each component a row with its smallest id stays.

    Rows are told apart by id and fingerprint: of several rows with one id each goes or stays with its own component. Of rows that share id and component
    one stays (by the smallest hash of all columns). Rows with a null id can't be named and stay. Null and empty texts are near duplicates of one another.
    Empty table: no rows. Extra columns stay as they are. Texts aren't shuffled while the ids that go are few enough for Spark to broadcast them by their size."""
    found = written(_components(written(fingerprints(docs, id_col, text_col, words)), bits, 4096))
    each = found.filter("doc_id is not null").groupBy("doc_id").agg(
        F.count("*").alias("rows"), F.count_if(F.col("component_id") == F.col("doc_id")).alias("stay")
    )
    each = written(each.filter("rows > 1 or stay = 0"))
    key = F.col(id_col).cast("long")
    out = docs.join(each.select(F.col("doc_id").alias("_s_id")), key.eqNullSafe(F.col("_s_id")), "left_anti")
    # ids of several rows of which one stays at least: their rows are judged one by one
    repeated = each.filter("rows > 1 and stay > 0").select(F.col("doc_id").alias("_s_id"))
    if repeated.isEmpty():
        return out
    columns = [F.col(f"`{c}`") for c in docs.columns]
    rows = docs.join(repeated, key == F.col("_s_id"), "left_semi").select(
        key.alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.struct(*columns).alias("row")
    )
    staying = found.filter("component_id = doc_id").select(F.col("doc_id").alias("_id"), F.col("fp").alias("_fp"), "root").distinct()
    judged = rows.select("doc_id", _fingerprint_column(words)("text").alias("fp"), "row")
    kept = judged.join(staying, (F.col("doc_id") == F.col("_id")) & (F.col("fp") == F.col("_fp")))
    # one row for each id and component; the minimum is found by partial aggregation
    one = kept.groupBy("doc_id", "root").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
    return out.unionByName(one.select("row.*"))
