"""Language-model scores from log-frequency Bloom filters (after Talbot and Osborne, 2007).

Word counts are exact, over all training documents. Every n-gram of two words that occurs in training goes into a Bloom filter, whatever its
count: an n-gram whose count has the logarithmic level q is stored once for each level 1..q, and a count is read by probing levels
until one is missing.

Nothing is broadcast. Documents are written as blocks of 8 MB and more; a block asks for each of its words and n-grams once, with its training
count there. The requests are dealt by hash into buckets, whose number grows with the corpus; a bucket sums the counts, builds its filters
from the n-grams that occur in training, and answers each block's requests. A block then scores its documents. As a block asks once for each
n-gram, frequent ones don't weigh on one bucket. Blocks and buckets both grow with the root of the corpus, up to bounds that fit a task: with blocks of one
size, ever more buckets would get ever smaller requests from each. Words are told apart by 64-bit hashes, n-grams by 32 bits inside their bucket (42 and more in all).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depmatrix.llm.shared import byte_table, mixed, one_word_hash, string_parts, word_hashes, written

#: The end token: a space can't be in a word.
END = one_word_hash(b" end ")
_TABLE = byte_table()
#: Bytes of text in a block and to a bucket: least and most; they grow from _LARGE bytes of text to 16 times as many.
_BLOCK, _BUCKET, _LARGE = (1 << 23, 1 << 25), (1 << 24, 1 << 26), 1 << 34


@dataclass
class LogBloom:
    """Counts by level: level q stands for counts from least * base^(q-1) on."""

    bits: np.ndarray
    least: int
    base: float = 1.5
    probes: int = 7

    @classmethod
    def build(cls, codes: np.ndarray, counts: np.ndarray, least: int, base: float = 1.5, probes: int = 7, bits_each: int = 12) -> LogBloom:
        levels = (
            1 + np.floor(np.log(np.maximum(counts, least) / least) / math.log(base) + 1e-9).astype(np.int64)
            if len(codes)
            else np.zeros(0, np.int64)
        )
        size = 1 << max(10, math.ceil(math.log2(max(1, int(levels.sum())) * bits_each)))
        out = cls(np.zeros(size >> 3, np.uint8), least, base, probes)
        for q in range(1, int(levels.max(initial=0)) + 1):
            for at in out._places(codes[levels >= q], q):
                np.bitwise_or.at(out.bits, at >> np.uint64(3), np.left_shift(1, at & np.uint64(7)).astype(np.uint8))
        return out

    def _places(self, codes: np.ndarray, level: int) -> Iterator[np.ndarray]:
        a = mixed(codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(level * 0x632BE59BD9B4E019 % (1 << 64)))
        b = mixed(a) | np.uint64(1)
        for i in range(self.probes):
            yield (a + np.uint64(i) * b) & np.uint64(len(self.bits) * 8 - 1)

    def _holds(self, codes: np.ndarray, level: int) -> np.ndarray:
        alive = np.arange(len(codes))
        a = mixed(codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(level * 0x632BE59BD9B4E019 % (1 << 64)))
        b = mixed(a) | np.uint64(1)
        for i in range(self.probes):
            at = (a + np.uint64(i) * b) & np.uint64(len(self.bits) * 8 - 1)
            ok = (self.bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
            alive, a, b = alive[ok], a[ok], b[ok]
            if not len(alive):
                break
        return alive

    def levels(self, codes: np.ndarray) -> np.ndarray:
        """Level of each code, 0 for what the filter doesn't hold. Never below the level of the true count."""
        levels, alive, q = np.zeros(len(codes), np.int64), np.arange(len(codes)), 1
        while len(alive):
            alive = alive[self._holds(codes[alive], q)]
            levels[alive] = q
            q += 1
        return levels

    def counts(self, codes: np.ndarray) -> np.ndarray:
        """Quantised counts, 0 for what the filter doesn't hold."""
        return level_counts(self.levels(codes), self.least, self.base)


def level_counts(levels: np.ndarray, least: int = 1, base: float = 1.5) -> np.ndarray:
    """The middle of the whole numbers that have a level; 0 for level 0."""
    q = np.arange(int(levels.max(initial=0)) + 1)
    low, high = least * base ** (q - 1.0), least * base**q
    first, last = np.ceil(low - 1e-6), np.ceil(high - 1e-6) - 1
    middle = np.where(last >= first, first + last, low + high) / 2
    middle[0] = 0
    return middle[levels]


def _with_ends(h: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens with each document's end, and tokens of each document."""
    many = counts + 1
    out = np.empty(len(h) + len(counts), np.uint64)
    ends = np.cumsum(many) - 1
    inside = np.ones(len(out), bool)
    inside[ends] = False
    out[ends], out[inside] = END, h
    return out, many


def _cut_up(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """values as binaries, one for each stretch between ends."""
    return pa.Array.from_buffers(
        pa.binary(),
        len(ends) - 1,
        [None, pa.py_buffer((ends * values.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))],
    )


def _joined(column: pa.ChunkedArray, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """The values of all binaries, and where each one's end: the inverse of _cut_up()."""
    column = pa.concat_arrays([x.cast(pa.large_binary()) for x in column.chunks]) if column.num_chunks else pa.array([], pa.large_binary())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data else np.zeros(0, np.uint8)
    return data.view(kind), (offsets - offsets[0]) // np.dtype(kind).itemsize


def _cut_counts(counts: np.ndarray, ends: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """A byte each; those from 255 on in full, in the second column."""
    large = counts >= 255
    return (
        _cut_up(np.minimum(counts, 255).astype(np.uint8), ends),
        _cut_up(counts[large].astype(np.int64), np.r_[0, np.cumsum(large)][ends]),
    )


def _joined_counts(low: pa.ChunkedArray, high: pa.ChunkedArray) -> np.ndarray:
    out = _joined(low, np.uint8)[0].astype(np.int64)
    out[out == 255] = _joined(high, np.int64)[0]
    return out


def sizes(text: int) -> tuple[int, int]:
    """(bytes of text in a block, in a bucket's share) for a corpus of so many bytes."""
    grown = math.sqrt(max(1.0, text / _LARGE))
    return min(_BLOCK[1], int(_BLOCK[0] * grown)), min(_BUCKET[1], int(_BUCKET[0] * grown))


def _blocks(most: int):
    """Blocks of documents, of so many bytes of text unless a single one has more: ids, held out, texts end to end and where they end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            offsets, data = string_parts(batch.column(2))
            at, n = 0, batch.num_rows
            while at < n:
                end = min(n, max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1))
                text, ends = data[offsets[at] : offsets[end]].tobytes(), (offsets[at : end + 1] - offsets[at]).astype(np.int64)
                one = lambda x, kind: pa.array([x], kind)
                lists = [pa.ListArray.from_arrays(pa.array([0, end - at], pa.int32()), batch.column(k).slice(at, end - at)) for k in (0, 1)]
                packed = one(pa.compress(text, codec="zstd", asbytes=True), pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [one(block, pa.int64()), *lists, packed, one(ends.tobytes(), pa.binary())], ["block", "ids", "held", "text", "ends"]
                )
                block, at = block + 1, end

    return run


def _tokens(text: bytes, ends: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of a block's documents with each one's end, and tokens of each document."""
    offsets = np.frombuffer(ends, np.int64)
    data = np.frombuffer(pa.decompress(text, int(offsets[-1]), codec="zstd"), np.uint8)
    found = [(h, counts) for _, _, h, counts in word_hashes(offsets, data, _TABLE)]
    return _with_ends(np.concatenate([h for h, _ in found]), np.concatenate([c for _, c in found]))


def _pairs(t: np.ndarray, bits: int) -> np.ndarray:
    """Bucket and 32 bits of each token's n-gram. Before a document's first word stands an end, as the last token before it is one."""
    code = mixed(np.r_[END, t[:-1]] * np.uint64(0xD6E8FEB86659FD93) + t)
    return code >> np.uint64(64 - bits) << np.uint64(32) | code & np.uint64(0xFFFFFFFF)


def _requests(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                block, held, text, ends = (batch.column(k)[row].as_py() for k in range(4))
                t, many = _tokens(text, ends)
                train = np.repeat(~np.array(held, bool), many)
                words, w = np.unique(t, return_inverse=True)
                pairs, p = np.unique(_pairs(t, bits), return_inverse=True)
                place_w, place_p = words >> np.uint64(64 - bits), pairs >> np.uint64(32)
                parts = np.union1d(place_w, place_p)
                ends_w, ends_p = (np.r_[0, np.searchsorted(x, parts, side="right")] for x in (place_w, place_p))
                count = lambda at, n: np.bincount(at[train], minlength=n)
                columns = [
                    _cut_up(words, ends_w),
                    *_cut_counts(count(w, len(words)), ends_w),
                    _cut_up(pairs.astype(np.uint32), ends_p),
                    *_cut_counts(count(p, len(pairs)), ends_p),
                ]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(parts.astype(np.int32)), pa.array(np.full(len(parts), block, np.int64)), *columns],
                    ["part", "block", "words", "wl", "wh", "pairs", "pl", "ph"],
                )

    return run


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    found, at = np.unique(keys, return_inverse=True)
    return found, np.bincount(at, counts, len(found)).astype(np.int64), at


def _answers(max_ngrams: int):
    def run(asked: pa.Table) -> pa.Table:
        words, ends_w = _joined(asked.column("words"), np.uint64)
        found, total, at = _summed(words, _joined_counts(asked.column("wl"), asked.column("wh")))
        pairs, ends_p = _joined(asked.column("pairs"), np.uint32)
        codes, counts, at_p = _summed(pairs, _joined_counts(asked.column("pl"), asked.column("ph")))
        # as many filters as the n-grams need, none with more than about max_ngrams of them
        levels, pieces = np.zeros(len(codes), np.uint8), max(1, -(-int((counts > 0).sum()) // max_ngrams))
        for k in range(pieces):
            own = codes % pieces == k
            trained = own & (counts > 0)
            levels[own] = LogBloom.build(codes[trained].astype(np.int64), counts[trained], 1).levels(codes[own].astype(np.int64))
        first = (np.arange(asked.num_rows) == 0).astype(np.int64)  # the bucket's figures, once
        columns = [
            *_cut_counts(total[at], ends_w),
            _cut_up(levels[at_p], ends_p),
            pa.array(first * int(total.sum())),
            pa.array(first * int((total > 0).sum())),
        ]
        return pa.Table.from_arrays(
            [asked.column("block"), asked.column("part"), *columns], ["block", "part", "wl", "wh", "levels", "tokens", "distinct"]
        )

    return run


def _score(tokens: int, distinct: int, weight: float, bits: int):
    def run(block: pa.Table, answers: pa.Table) -> pa.Table:
        t, many = _tokens(block.column("text")[0].as_py(), block.column("ends")[0].as_py())
        answers = answers.sort_by("part")  # the order of the block's words and n-grams
        words, w = np.unique(t, return_inverse=True)
        pairs, p = np.unique(_pairs(t, bits), return_inverse=True)
        counts, levels = _joined_counts(answers.column("wl"), answers.column("wh")), _joined(answers.column("levels"), np.uint8)[0]
        if len(counts) != len(words) or len(levels) != len(pairs):
            raise RuntimeError(
                f"block {block.column('block')[0]}: {len(counts)} and {len(levels)} answers to {len(words)} and {len(pairs)} requests"
            )
        context = counts[np.r_[np.searchsorted(words, END), w[:-1]]]
        lone = np.log10((counts + 0.5) / (tokens + 0.5 * (distinct + 1)))[w]
        share = np.where(context > 0, weight, 0.0)
        both = share * np.minimum(1.0, level_counts(levels)[p] / np.maximum(context, 1)) + (1 - share) * 10.0**lone
        starts = np.cumsum(many) - many
        by_doc = lambda x: pa.array(np.add.reduceat(x, starts))
        ids, held = (pa.concat_arrays([x.flatten() for x in block.column(c).chunks]) for c in ("ids", "held"))
        return pa.Table.from_arrays(
            [
                ids,
                held,
                pa.array(many),
                by_doc((counts[w] > 0).astype(np.int64)),
                pa.array(np.full(len(many), tokens)),
                by_doc(lone),
                by_doc(np.log10(both)),
            ],
            ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )

    return run


def held_out(doc_id):
    """Rows whose crc32(doc_id as text) leaves 1 by 5; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 1


def lm_scores(
    docs: DataFrame, max_words: int | None = None, max_ngrams: int = 1 << 19, weight: float = 0.3, block_bytes: int | None = None
) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Trains on the rows that aren't held out. Null or empty text: its end is its only token. Repeated rows count and are scored as often as they occur.
    No training rows: all counts are 0, and scores are those of unseen words. Extra columns are not looked at.

    max_words: a bucket's share of the text is 8 times as many bytes at most. block_bytes: text in a block. Both follow from the size of all texts unless given.
    max_ngrams: n-grams in one filter. These only set how many blocks, buckets and filters there are; no word and no n-gram is left out."""
    own = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        held_out(F.col("doc_id")).alias("held_out"),
        F.col("text").cast("string").alias("text"),
    )
    size = int(own.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1)).first()[0] or 0)
    block, bucket = sizes(size)
    bucket = 8 * max_words if max_words else bucket
    blocks = written(
        own.mapInArrow(_blocks(block_bytes or block), "block long, ids array<long>, held array<boolean>, text binary, ends binary")
    )
    bits = max(10, math.ceil(math.log2(max(1, size / bucket))))
    asked = blocks.select("block", "held", "text", "ends").mapInArrow(
        _requests(bits), "part int, block long, words binary, wl binary, wh binary, pairs binary, pl binary, ph binary"
    )
    answers = written(
        asked.groupBy("part").applyInArrow(
            _answers(max_ngrams), "block long, part int, wl binary, wh binary, levels binary, tokens long, distinct long"
        )
    )
    tokens, distinct = (int(x or 0) for x in answers.agg(F.sum("tokens"), F.sum("distinct")).first())
    kinds = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return (
        blocks.groupBy("block")
        .cogroup(answers.select("block", "part", "wl", "wh", "levels").groupBy("block"))
        .applyInArrow(_score(tokens, distinct, weight, bits), kinds)
    )
