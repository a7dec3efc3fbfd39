"""Importance resampling towards a target: documents are drawn by how much likelier the target makes their hashed n-grams than the corpus does.

Features are all runs of one to three words, told apart by CRC-32 modulo BUCKETS. The strings of n-grams are never made: the CRC of each word is computed once, CRCs of two and
three words are composed from these (crc_algebra). Two passes over the texts: one counts buckets, at most BUCKETS rows a task; the other sums the buckets' gains for each document. The gains,
BUCKETS numbers whatever the corpus, go to the workers with the task. Drawing is by Gumbel noise from a hash of the id: reruns agree, and nothing random is kept.
Places among the drawn ones come from ranges of the scores, and one count for each range.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from depmatrix.llm.crc_algebra import joined, of_spans, with_byte
from depmatrix.llm.shared import byte_table, string_parts, written

BUCKETS = 10_000
SPACE = 32


class Features:
    """Buckets of n-grams, some `chunk` bytes of text at a time; a longer document is cut between words, the last words of one part go on in the next."""

    def __init__(self, buckets: int = BUCKETS, longest: int = 3, chunk: int = 1 << 20):
        self.buckets, self.longest, self.chunk = buckets, longest, chunk
        self._table = byte_table("ascii")

    def __call__(self, column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
        """(first document, documents, bucket of each feature, its document, words of each document); a document may come in several parts."""
        offsets, data = string_parts(column)
        n, at = len(offsets) - 1, 0
        while at < n:
            end = min(n, max(at + 1, int(np.searchsorted(offsets, offsets[at] + self.chunk, side="right")) - 1))
            raw = data[offsets[at] : offsets[end]]
            if len(raw) <= self.chunk:
                yield at, end - at, *self._part(raw, offsets[at : end + 1] - offsets[at], None)[:3]
            else:
                before = None
                for a, b in self._cuts(raw):
                    *out, before = self._part(raw[a:b], np.array([0, b - a]), before)
                    yield at, 1, *out
            at = end

    def _cuts(self, raw: np.ndarray) -> Iterator[tuple[int, int]]:
        """Parts of some `chunk` bytes that end behind a separator, or where the text does."""
        at, n = 0, len(raw)
        while at < n:
            end = min(n, at + self.chunk)
            while end < n:
                gaps = np.flatnonzero(~self._table.inside[raw[max(at, end - 4096) : end]])
                if len(gaps):
                    end = max(at, end - 4096) + int(gaps[-1]) + 1
                    break
                end = min(n, end + 4096)
            yield at, end
            at = end

    def _part(self, raw: np.ndarray, edges: np.ndarray, before):
        """before: CRCs and lengths of the words that stand in front of the part (one document)."""
        folded, inside = self._table.folded[raw], self._table.inside[raw]
        cut = np.zeros(len(raw) + 1, bool)
        cut[edges] = True
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1] | cut[1:-1]
        last[:-1] &= ~inside[1:] | cut[1:-1]
        starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        crc, size = of_spans(folded, starts, ends), ends - starts
        words = np.diff(np.searchsorted(starts, edges))
        doc = np.repeat(np.arange(len(words)), words)
        back = 0
        if before is not None:
            back = len(before[0])
            crc, size, doc = np.append(before[0], crc), np.append(before[1], size), np.append(np.zeros(back, np.int64), doc)
        found, docs, now = [crc[back:]], [doc[back:]], crc
        for k in range(1, self.longest):
            # n-grams of k + 1 words: those of k words, a space and the word k on; all must be of one document
            m = max(0, len(crc) - k)
            now = joined(with_byte(now[:m], SPACE), crc[k:], size[k:]) if m else crc[:0]
            own = doc[k:] == doc[:m]
            if back:
                own &= np.arange(k, k + m) >= back  # the last word stands in this part
            found.append(now[own])
            docs.append(doc[:m][own])
        keep = slice(max(0, len(crc) - self.longest + 1), None)
        bucket = np.concatenate(found) % np.uint32(self.buckets)
        return bucket, np.concatenate(docs), words, (crc[keep], size[keep])


def bucket_counts(docs: DataFrame, buckets: int = BUCKETS, longest: int = 3) -> DataFrame:
    """(bucket, n): how often features fall into each bucket that has any, over whole texts; null texts have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, features = np.zeros(buckets, np.int64), Features(buckets, longest)
        for batch in batches:
            for _, _, bucket, _, _ in features(batch.column(0)):
                total += np.bincount(bucket, minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(total[held], pa.int64())], ["bucket", "n"])

    own = docs.select(F.col("text").cast("string").alias("text"))
    return own.mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, longest: int = 3) -> DataFrame:
    """(bucket, gain): floor(1000 * ln) of the bucket's share in the target against that in docs, each count raised by one; a row for every bucket."""
    spark = docs.sparkSession
    source = bucket_counts(docs, buckets, longest).withColumnRenamed("n", "s")
    wanted = bucket_counts(target, buckets, longest).withColumnRenamed("n", "t")
    every = spark.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    counted = every.join(source, "bucket", "left").join(wanted, "bucket", "left").select(
        "bucket", *(F.coalesce(c, F.lit(0)).cast("double").alias(c) for c in "st")
    )
    whole = W.partitionBy()  # over `buckets` rows
    ratio = ((F.col("t") + 1) * (F.sum("s").over(whole) + buckets)) / ((F.col("s") + 1) * (F.sum("t").over(whole) + buckets))
    return counted.select("bucket", F.floor(1000 * F.log(ratio)).cast("long").alias("gain"))


def weighed(docs: DataFrame, gains: np.ndarray, longest: int = 3) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of each row: the sum of the gains of its features. gains: one for each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(len(gains), longest)
        for batch in batches:
            n = batch.num_rows
            words, count, weight = (np.zeros(n, np.int64) for _ in range(3))
            for first, docs_, bucket, doc, each in features(batch.column(1)):
                here = slice(first, first + docs_)
                words[here] += each
                count[here] += np.bincount(doc, minlength=docs_)
                # exact in doubles: a part has fewer than 2^22 features, each gain is below 2^20
                weight[here] += np.bincount(doc, weights=gains[bucket], minlength=docs_).astype(np.int64)
            columns = [batch.column(0), pa.array(words), pa.array(count), pa.array(weight)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_features", "weight"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, seed: int = 42, least_words: int = 20, buckets: int = BUCKETS, longest: int = 3) -> DataFrame:
    """(doc_id, n_features, weight, score, rank), a row for each row of docs; rank 1, 2, ... by score, then the smaller doc_id, of the floor(percent * N / 100) that are drawn from the N rows with
    least_words words, null for others.

    Null and empty texts have no features, weight 0 and a score, but are never drawn; a null id is hashed as an empty one and stands last among equal scores; repeated rows are drawn one
    by one. Texts of any length are worked on a megabyte at a time. An empty target has equal shares everywhere; an empty table gives no rows. Other columns aren't looked at."""
    gains = np.zeros(buckets, np.int64)
    for row in bucket_gains(docs, target, buckets, longest).collect():  # `buckets` rows
        gains[row["bucket"]] = row["gain"]
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10)
    noise = F.floor(-1000 * F.log(-F.log((h.cast("double") + 0.5) / 4294967296.0)))
    scored = written(weighed(docs, gains, longest).withColumn("score", (F.col("weight") + noise).cast("long")))
    most = scored.filter(F.col("n_words") >= least_words).count() * percent // 100
    open_ = F.col("n_words") >= least_words
    order = [(~open_), F.desc("score"), F.asc_nulls_last("doc_id"), F.col("n_features")]
    ranged = scored.repartitionByRange(*order).sortWithinPartitions(*order)
    inside = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    placed = written(ranged.select("*", F.spark_partition_id().alias("part"), inside.alias("inside")))
    sizes = placed.groupBy("part").agg(F.count("*").alias("n"))  # a row for each range
    before = F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    place = F.col("before") + F.col("inside") + 1
    out = placed.join(F.broadcast(sizes.select("part", before.alias("before"))), "part")
    return out.select("doc_id", "n_features", "weight", "score", F.when(open_ & (place <= most), place).cast("long").alias("rank"))
