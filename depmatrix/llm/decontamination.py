"""Benchmark decontamination by latent semantic retrieval.

Fit, one pass over all documents: passages of 64 words as TF vectors over hashed words; each task adds up document frequencies and its part of
the Gram matrix times a random test matrix, and the sums give the leading right singular vectors of the TF-IDF matrix (randomised SVD in its single-pass, Nystrom form).
Search, one pass: windows of about an item's length, moved by a quarter of it, are projected (whitened) and compared by cosine with the items; candidates are
then checked by the longest common subsequence with the item around the window, and by that with its answer (its last words, or a column of its own).
Items shorter than the least window are looked for exactly as well: in each stretch of their length and the part of it that may differ.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from depmatrix.llm.shared import byte_table, mixed, ranges, stretches, string_parts, word_hashes, written

_TABLE = byte_table()
DIMS, RANK, PASSAGE, BLOCK = 2048, 64, 64, 4
#: Window lengths in blocks of BLOCK words, about 1.4 apart; longer items are searched in parts of the longest.
WINDOWS = (2, 3, 4, 6, 8, 12, 16)
#: Blocks from one window to the next: a window always lies within an eighth to a quarter of its length of any item.
STEPS = {2: 1, 3: 1, 4: 1, 6: 2, 8: 2, 12: 4, 16: 4}
_CHUNK = 1 << 18
#: Words of a document that are looked at together, with an overlap in the search; a whole number of passages.
_STRETCH = 1 << 17
#: Items in one block, and blocks that are searched in one pass over the documents: what goes to the workers has a bound.
_ITEMS, _TOGETHER = 4096, 8


def _folded(column: str) -> Column:
    """Text in lower case, letters beyond ASCII too, so that a copy in capitals is the same words."""
    return F.lower(F.col(column).cast("string"))


def _test_matrix() -> np.ndarray:
    return np.random.default_rng(20240501).standard_normal((DIMS, RANK)).astype(np.float32)


def _bucket(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - 11)).astype(np.int64)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    omega = _test_matrix()
    df, y, passages = np.zeros(DIMS), np.zeros((DIMS, RANK)), 0
    for batch in batches:
        for _, _, h, counts in stretches(word_hashes(*string_parts(batch.column(0)), _TABLE, _CHUNK), _STRETCH):
            each = -(-counts // PASSAGE)
            first = np.cumsum(each) - each
            place = np.arange(len(h)) - np.repeat(np.cumsum(counts) - counts, counts)
            row, n = np.repeat(first, counts) + place // PASSAGE, int(each.sum())
            for a in range(0, n, 1024):  # bounded also for a very long text
                low, high = np.searchsorted(row, (a, a + 1024))
                m = min(1024, n - a)
                c = np.bincount((row[low:high] - a) * DIMS + _bucket(h[low:high]), minlength=m * DIMS).reshape(m, DIMS).astype(np.float32)
                df += (c > 0).sum(axis=0)
                y += c.T @ (c @ omega)
            passages += n
    yield pa.RecordBatch.from_arrays(
        [pa.array([passages], pa.int64()), pa.array([df.tobytes()], pa.binary()), pa.array([y.tobytes()], pa.binary())], ["n", "df", "y"]
    )


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n, df, y = 0, np.zeros(DIMS), np.zeros(DIMS * RANK)
    for batch in batches:
        for i in range(batch.num_rows):
            n += batch.column(0)[i].as_py()
            df += np.frombuffer(batch.column(1)[i].as_buffer())
            y += np.frombuffer(batch.column(2)[i].as_buffer())
    yield pa.RecordBatch.from_arrays(
        [pa.array([n], pa.int64()), pa.array([df.tobytes()], pa.binary()), pa.array([y.tobytes()], pa.binary())], ["n", "df", "y"]
    )


def word_vectors(docs: DataFrame, fan_in: int = 8) -> np.ndarray:
    """DIMS x RANK: what a word adds to a window's latent vector: idf times the right singular vectors, divided by the singular values.

    Each task writes one matrix of fixed size; they are added up in a tree, fan_in to a task, and the driver gets one."""
    kinds = "n long, df binary, y binary"
    parts = written(docs.select(_folded("text").alias("text")).mapInArrow(_sketch, kinds))
    while (left := parts.count()) > 1:
        parts = written(parts.repartition(-(-left // fan_in)).mapInArrow(_add, kinds))
    sums = parts.collect()
    if not sums:
        return latent(0, np.zeros(DIMS), np.zeros((DIMS, RANK)))
    return latent(sums[0]["n"], np.frombuffer(sums[0]["df"]), np.frombuffer(sums[0]["y"]).reshape(DIMS, RANK))


def latent(n: int, df: np.ndarray, y: np.ndarray) -> np.ndarray:
    idf = np.log((1 + n) / (1 + df)) + 1e-3
    y, omega = idf[:, None] * y, _test_matrix() / idf[:, None]
    shift = 1e-7 * np.linalg.norm(y) + 1e-9
    y = y + shift * omega
    core = omega.T @ y
    values, vectors = np.linalg.eigh((core + core.T) / 2)
    values = np.maximum(values, 1e-12 * max(values.max(), 1e-30))
    u, s, _ = np.linalg.svd(y @ vectors / np.sqrt(values), full_matrices=False)
    sigma = np.sqrt(np.maximum(s**2 - shift, 0))
    good = sigma > 1e-6 * max(sigma.max(), 1e-30)
    return (idf[:, None] * u[:, good] / sigma[good]).astype(np.float32)


def lcs(a: list[int], b: list[int]) -> int:
    """Longest common subsequence, a bit for each element of a."""
    at: dict[int, int] = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for x in b:
        u = v & at.get(x, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


@dataclass
class Items:
    """Benchmark items, ready for search."""

    ids: list[int]
    words: list[np.ndarray]
    answers: list[np.ndarray]
    vectors: np.ndarray
    queries: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=dict)  # window: item, first word of the part, unit vectors
    members: np.ndarray = field(default_factory=lambda: np.zeros(1 << 22, bool))  # places of (item, word)
    short: tuple[np.ndarray, np.ndarray] = (np.zeros(0, np.uint64), np.zeros(0, np.int64))  # words of short items, sorted, and the items

    @classmethod
    def build(cls, ids: list[int], words: list[np.ndarray], answers: list[np.ndarray], vectors: np.ndarray) -> Items:
        out = cls(ids, words, answers, vectors)
        by: dict[int, list] = {}
        for k, w in enumerate(words):
            longest = WINDOWS[-1] * BLOCK
            for first in range(0, len(w), longest):
                part = w[first : first + longest]
                if first and len(part) < longest // 4:
                    continue  # the part before has most of it
                blocks = min(WINDOWS, key=lambda b: abs(np.log(b * BLOCK / len(part))))
                z = vectors[_bucket(part)].sum(axis=0)
                if (size := np.linalg.norm(z)) > 0:
                    by.setdefault(blocks, []).append((k, first, z / size))
            out.members[out.places(w, np.full(len(w), k))] = True
        brief = [(w, k) for k, own in enumerate(words) if len(own) < WINDOWS[0] * BLOCK for w in sorted(set(own.tolist()))]
        brief.sort()
        out.short = (np.array([x[0] for x in brief], np.uint64), np.array([x[1] for x in brief], np.int64))
        out.queries = {
            b: (np.array([x[0] for x in v]), np.array([x[1] for x in v]), np.array([x[2] for x in v], np.float32)) for b, v in by.items()
        }
        return out

    def places(self, h: np.ndarray, k: np.ndarray) -> np.ndarray:
        return (h.astype(np.uint32) ^ mixed(k).astype(np.uint32)) & np.uint32(len(self.members) - 1)


@dataclass(frozen=True)
class Limits:
    cosine: float = 0.3
    lcs: float = 0.7
    answer: float = 0.6


def running_sums(h: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Sums of the words' vectors up to each block of words, with the longest window's blocks as margin on both sides."""
    n, edge = -(-len(h) // BLOCK), WINDOWS[-1]
    rows = vectors[_bucket(h)]
    if len(rows) < n * BLOCK:
        rows = np.concatenate([rows, np.zeros((n * BLOCK - len(rows), rows.shape[1]), np.float32)])
    total = np.zeros((n + 2 * edge + 1, rows.shape[1]), np.float32)
    np.cumsum(rows.reshape(n, BLOCK, -1).sum(axis=1), axis=0, out=total[edge + 1 : edge + n + 1])
    total[edge + n + 1 :] = total[edge + n]
    return total


def candidates(total: np.ndarray, items: Items, cosine: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """(first word, query's row, cosine, window's blocks) of windows over the words of running_sums() that reach the cosine with an item."""
    edge = WINDOWS[-1]
    n = len(total) - 2 * edge - 1
    for blocks, (_, _, units) in items.queries.items():
        step, begin = STEPS[blocks], edge - blocks // 2
        z = total[begin + blocks : edge + n + blocks : step] - total[begin : edge + n : step]
        size = np.sqrt(np.einsum("ij,ij->i", z, z))
        least = cosine * np.maximum(size, 1e-12)
        for a in range(0, len(z), 4096):
            dot = z[a : a + 4096] @ units.T
            flat = np.flatnonzero(dot >= least[a : a + 4096, None])
            if len(flat):
                i, q = np.divmod(flat, units.shape[0])
                yield (begin - edge + (a + i) * step) * BLOCK, q, dot[i, q] / np.maximum(size[a + i], 1e-12), blocks


def _enough(h: np.ndarray, low: np.ndarray, high: np.ndarray, k: np.ndarray, least: np.ndarray, items: Items) -> np.ndarray:
    """Whether at least so many of the words low..high are the item's. Some that aren't may count, so this only sorts out."""
    out, h = np.zeros(len(k), bool), h.astype(np.uint32)
    low, high = low.astype(np.int32), high.astype(np.int32)
    for a in range(0, len(k), 512):  # fits a core's cache
        part = slice(a, a + 512)
        at = low[part, None] + np.arange(int((high[part] - low[part]).max(initial=0)), dtype=np.int32)
        hit = items.members[items.places(h.take(at, mode="clip"), k[part, None])] & (at < high[part, None])
        out[part] = np.count_nonzero(hit, axis=1) >= least[part]
    return out


def _short(h: np.ndarray, items: Items, share: float) -> Iterator[tuple[int, int, int]]:
    """(first word, end, item) of all stretches that hold enough words of a short item and start with one."""
    words, owners = items.short
    low, high = (np.searchsorted(words, h, side=x) for x in ("left", "right"))
    many = high - low
    at, k = np.repeat(np.arange(len(h)), many), owners[np.repeat(low, many) + ranges(many)]
    order = np.lexsort((at, k))
    at, k = at[order], k[order]
    for item in np.unique(k).tolist():
        own, n = at[k == item], len(items.words[item])
        need, reach = max(1, math.ceil(share * n - 1e-9)), n + math.ceil((1 - share) * n - 1e-9)
        if len(own) >= need:
            for s in own[: len(own) - need + 1][own[need - 1 :] - own[: len(own) - need + 1] < reach].tolist():
                yield s, s + reach, item


def _cosine(a: np.ndarray, b: np.ndarray) -> float:
    return float(a @ b / max(float(np.linalg.norm(a) * np.linalg.norm(b)), 1e-12))


def search(texts: pa.Array, blocks: list[Items], limits: Limits) -> list[tuple[int, int, int, float, int, float]]:
    """(row, block, item, cosine, common words, answer's share) for each text and item that pass all checks. Texts are read once for all blocks of items."""
    blocks = [b for b in blocks if b.queries or len(b.short[0])]
    if not blocks:
        return []
    # a stretch of a long text overlaps the one before by the longest that a match can be, with its windows' margins
    longest = max(len(w) for b in blocks for w in b.words)
    overlap = 2 * longest + 2 * WINDOWS[-1] * BLOCK
    known = [_Known(b) for b in blocks]
    found: dict[tuple[int, int, int], tuple[float, int, float]] = {}
    for first, _, h, counts in stretches(word_hashes(*string_parts(texts), _TABLE, _CHUNK), max(_STRETCH, 4 * overlap), overlap):
        if len(h):
            total = running_sums(h, blocks[0].vectors) if any(b.queries for b in blocks) else None
            listed = h.tolist()
            for number, known_ in enumerate(known):
                for (d, k), got in known_.matches(h, listed, counts, total, limits).items():
                    place = (first + d, number, k)
                    if got[1] > found.get(place, (0, 0, 0))[1]:
                        found[place] = got
    return [(*place, *got) for place, got in sorted(found.items())]


class _Known:
    """A block of items with what its checks need."""

    def __init__(self, items: Items):
        self.items = items
        self.often = [Counter(w.tolist()) for w in items.words]
        self.sets = [set(x) for x in self.often]
        self.sizes = np.array([len(w) for w in items.words])

    def matches(
        self, h: np.ndarray, listed: list[int], counts: np.ndarray, total: np.ndarray | None, limits: Limits
    ) -> dict[tuple[int, int], tuple[float, int, float]]:
        """{(document, item): (cosine, common words, answer's share)} over consecutive documents' words h."""
        items, found = self.items, {}
        ends = np.cumsum(counts)
        tried: set[tuple[int, int]] = set()

        def check(k: int, d: int, low: int, high: int, cosine) -> None:
            region, words, answer = (
                listed[max(low, int(ends[d] - counts[d])) : min(high, int(ends[d]))],
                items.words[k].tolist(),
                items.answers[k],
            )
            common = lcs(words, region)
            if common >= limits.lcs * len(words) and common > found.get((d, k), (0, 0, 0))[1]:
                share = lcs(answer.tolist(), region) / len(answer) if len(answer) else 1.0
                if share >= limits.answer:
                    found[d, k] = (cosine(region), common, share)

        for start, query, cosine, blocks in candidates(total, items, limits.cosine) if items.queries else ():
            which, part, _ = items.queries[blocks]
            k, reach = which[query], blocks * BLOCK // 2 + 2
            from_, to = (
                np.maximum(0, start - part[query] - reach),
                np.minimum(len(h), start - part[query] + np.maximum(self.sizes[k], blocks * BLOCK) + reach),
            )
            keep = np.flatnonzero(_enough(h, from_, to, k, limits.lcs * self.sizes[k], items))
            for s, k, low, high, c in zip(
                start[keep].tolist(), k[keep].tolist(), from_[keep].tolist(), to[keep].tolist(), cosine[keep].tolist(), strict=True
            ):
                spot = (k, s // max(1, blocks * BLOCK // 4))
                # a common subsequence has each of the item's words that stand there, as often as the item has it at most
                if spot in tried or sum(
                    map(self.often[k].__getitem__, self.sets[k].intersection(listed[low:high]))
                ) < limits.lcs * len(items.words[k]):
                    continue
                tried.add(spot)
                for d in range(int(np.searchsorted(ends, low, side="right")), int(np.searchsorted(ends, high - 1, side="right")) + 1):
                    check(k, d, low, high, lambda _, c=c: c)
        for low, high, k in _short(h, items, limits.lcs):
            d = int(np.searchsorted(ends, low, side="right"))
            if found.get((d, k), (0, 0, 0))[1] < len(items.words[k]):
                z = lambda w: items.vectors[_bucket(np.array(w, np.uint64))].sum(axis=0)
                check(k, d, low, high, lambda region, k=k, z=z: _cosine(z(region), z(items.words[k])))
        return found


def _hashes(texts: list[str | None]) -> list[np.ndarray]:
    out: list[np.ndarray] = []
    for _, _, h, counts in word_hashes(*string_parts(pa.array(texts, pa.string())), _TABLE):
        out += np.split(h, np.cumsum(counts)[:-1])
    return out


def item_blocks(benchmark: DataFrame, vectors: np.ndarray, answer_col: str | None = None, answer_words: int = 5) -> Iterator[list[Items]]:
    """The benchmark in blocks of about _ITEMS items, up to _TOGETHER of them at a time, so that what goes to the workers has a bound. Items without words can't be found."""
    answer = _folded(answer_col) if answer_col else F.lit(None).cast("string")
    own = benchmark.select(F.col("item_id").cast("long").alias("item_id"), _folded("text").alias("text"), answer.alias("answer")).distinct()
    own = written(own)
    many = max(1, -(-own.count() // _ITEMS))
    for first in range(0, many, _TOGETHER):
        out = []
        for b in range(first, min(many, first + _TOGETHER)):
            rows = own.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(many)) == b).orderBy("item_id", "text").collect()
            if rows:
                words = _hashes([r["text"] for r in rows])
                answers = _hashes([r["answer"] for r in rows]) if answer_col else [w[-answer_words:] for w in words]
                out.append(Items.build([r["item_id"] for r in rows], words, answers, vectors))
        if out:
            yield out


MATCHES = "doc_id long, item_id long, cosine double, common_words long, item_words long, lcs_ratio double, answer_ratio double"


def contaminated(docs: DataFrame, benchmark: DataFrame, limits: Limits = Limits(), answer_col: str | None = None) -> DataFrame:
    """One row for each row of docs (doc_id, text) and item (item_id, text) that it holds: the columns of MATCHES.

    Null or empty texts and items match nothing; repeated rows of docs are found each, repeated items once; very long texts are searched whole, in overlapping
    stretches. Empty tables: no rows. Extra columns are not looked at."""
    spark = docs.sparkSession
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _folded("text").alias("text"))
    out = None
    for blocks in item_blocks(benchmark, word_vectors(own), answer_col=answer_col):
        shared = spark.sparkContext.broadcast(blocks)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            blocks = shared.value
            for batch in batches:
                rows = search(batch.column(1), blocks, limits)
                n = [len(blocks[b].words[k]) for _, b, k, *_ in rows]
                ids = batch.column(0).take(pa.array([r[0] for r in rows], pa.int64()))
                columns = [
                    pa.array([blocks[r[1]].ids[r[2]] for r in rows], pa.int64()),
                    *(pa.array([r[c] for r in rows], kind) for c, kind in ((3, pa.float64()), (4, pa.int64()))),
                ]
                shares = [
                    pa.array([r[4] / m for r, m in zip(rows, n, strict=True)], pa.float64()), pa.array([r[5] for r in rows], pa.float64())
                ]
                yield pa.RecordBatch.from_arrays(
                    [ids, *columns, pa.array(n, pa.int64()), *shares],
                    ["doc_id", "item_id", "cosine", "common_words", "item_words", "lcs_ratio", "answer_ratio"],
                )

        part = own.mapInArrow(run, MATCHES)
        out = part if out is None else out.union(part)
    return spark.createDataFrame([], MATCHES) if out is None else out


def keep_clean(docs: DataFrame, benchmark: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The rows of docs, columns as they are, that hold no item. No shuffle: each row is judged where it lies.

    Null and empty texts hold nothing and stay, as does every row if there are no items; repeated rows go or stay together; very long texts are searched whole,
    in overlapping stretches. Empty table: no rows. Extra columns stay as they are, whatever their names."""
    out = docs
    for blocks in item_blocks(benchmark, word_vectors(docs)):
        out = out.filter(_clean(docs.sparkSession.sparkContext.broadcast(blocks), limits)(_folded("text")))
    return out


def _clean(shared, limits: Limits):
    @arrow_udf("boolean")
    def clean(texts: pa.Array) -> pa.Array:
        mask = np.ones(len(texts), bool)
        mask[[r[0] for r in search(texts, shared.value, limits)]] = False
        return pa.array(mask)

    return clean
