"""Helpers that the training-data operators share: written tables, word hashing over Arrow buffers."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but these bytes (space, tab to carriage return).
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

_own_folder: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where that is unset, the warehouse, or in local mode (tests) a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        return spark.conf.get("spark.sql.warehouse.dir")
    if not _own_folder:
        _own_folder.append(tempfile.mkdtemp(prefix="depmatrix-"))
    return _own_folder[0]


def _delete(spark: SparkSession, path: str) -> None:
    try:
        to = spark._jvm.org.apache.hadoop.fs.Path(path)
        to.getFileSystem(spark._jsc.hadoopConfiguration()).delete(to, True)
    except Exception:  # the session is gone; the cluster's folder has its own clean-up
        pass


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage, and survives lost executors. Removed at exit."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/depmatrix-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_delete, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def lowered(column):
    """A-Z in lower case; other letters stay."""
    return F.translate(column, UPPER, UPPER.lower())


@dataclass(frozen=True)
class Bytes:
    """What each of the 256 bytes becomes, and whether it belongs to a word. Zero bytes are word characters like any other."""

    folded: np.ndarray
    inside: np.ndarray

    def spaced(self) -> bytes:
        """For bytes.translate(): separators become spaces."""
        return np.where(self.inside, self.folded, 32).astype(np.uint8).tobytes()


def byte_table(words: str = "space", lower: bool = True) -> Bytes:
    """words: 'space' splits at white space, 'ascii' at all ASCII but letters and digits, 'line' at newlines."""
    folded, inside = np.arange(256, dtype=np.uint8), np.ones(256, bool)
    if lower:
        folded[65:91] += 32
    if words == "space":
        inside[[32, *range(9, 14)]] = False
    elif words == "line":
        inside[10] = False
    else:
        inside[:128] = False
        inside[48:58] = inside[65:91] = inside[97:123] = True
    return Bytes(folded, inside)


def string_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of an Arrow string column, null as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string())
    _, offsets, data = column.buffers()
    offsets = (
        np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
        if offsets
        else np.zeros(len(column) + 1, np.int64)
    )
    return offsets, np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)


_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    got = _powers.get(str(base))
    if got is None or len(got) < n:
        got = np.full(max(n, 1 << 16), base, np.uint64)
        got[0] = 1
        got = np.multiply.accumulate(got)
        if n <= 1 << 22:
            _powers[str(base)] = got
    return got[:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """The splitmix finaliser: spreads each bit over all."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _spans(b: np.ndarray, inside: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, polynomial over the bytes) of each word. A word starts and ends at separators and at the edges of its document."""
    cut = np.zeros(len(b) + 1, bool)
    cut[edges] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | cut[1:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | cut[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    run = np.zeros(len(b) + 1, np.uint64)
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * _power(_BASE, len(b)), out=run[1:])
    return starts, ends, (run[ends] - run[starts]) * _power(_INVERSE, len(b) + 1)[starts]


def _long_document(text: np.ndarray, table: Bytes, chunk: int) -> np.ndarray:
    """Word hashes of one document, worked out a chunk of bytes at a time; a word that goes on in the next chunk is put together."""
    found, value, length = [], 0, 0  # of the word that a chunk left open
    for at in range(0, len(text), chunk):
        raw = text[at : at + chunk]
        inside = table.inside[raw]
        starts, ends, poly = _spans(table.folded[raw], inside, np.array([0, len(raw)]))
        if length and inside[0]:
            poly[0] = np.uint64((value + pow(_BASE, length, 1 << 64) * int(poly[0])) % (1 << 64))
        elif length:
            found.append(np.array([value], np.uint64))
            length = 0
        if inside[-1]:
            value, length = int(poly[-1]), int(ends[-1] - starts[-1]) + (length if len(starts) == 1 and inside[0] else 0)
            poly = poly[:-1]
        else:
            length = 0
        found.append(poly)
    if length:
        found.append(np.array([value], np.uint64))
    return mixed(np.concatenate(found))


def word_hashes(offsets: np.ndarray, data: np.ndarray, table: Bytes, chunk: int = 1 << 20):
    """Yields (first document, documents, 64-bit hash of each word, words of each document), over about chunk bytes at a time.

    A word's hash is a polynomial over its bytes, taken for all words at once from one running sum. Only the hashes of a document of more than chunk
    bytes are held whole (8 bytes a word)."""
    n, at = len(offsets) - 1, 0
    while at < n:
        end = min(n, max(at + 1, int(np.searchsorted(offsets, offsets[at] + chunk, side="right")) - 1))
        raw = data[offsets[at] : offsets[end]]
        if len(raw) > chunk:
            h = _long_document(raw, table, chunk)
            counts = np.array([len(h)])
        else:
            edges = offsets[at : end + 1] - offsets[at]
            starts, _, poly = _spans(table.folded[raw], table.inside[raw], edges)
            h, counts = mixed(poly), np.diff(np.searchsorted(starts, edges))
        yield at, end - at, h, counts
        at = end


def stretches(parts, size: int, overlap: int = 0) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """What word_hashes() yields, a document of more than size words as several stretches that overlap; so what is made of a stretch has a bound."""
    for first, docs, h, counts in parts:
        if len(h) <= size or docs > 1:
            yield first, docs, h, counts
            continue
        for a in range(0, max(1, len(h) - overlap), size - overlap):
            part = h[a : a + size]
            yield first, 1, part, np.array([len(part)])


def ranges(counts: np.ndarray) -> np.ndarray:
    """0..c-1 for each c, one after the other."""
    total = int(counts.sum())
    return np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts)


def one_word_hash(word: bytes) -> np.uint64:
    """word_hashes() for one word."""
    h = 0
    for k, x in enumerate(word):
        h = (h + (x + 1) * pow(_BASE, k, 1 << 64)) % (1 << 64)
    return mixed(np.array([h], np.uint64))[0]


def split_join(
    big: DataFrame, small: DataFrame, on: list[tuple[str, str]], n_col: str, how: str = "inner", most: int = 100_000
) -> DataFrame:
    """big with the columns of small (a written table with one row a key) but for n_col, which counts big's rows of the key; null keys are equal.

    on: (big's column, small's column). At most `most` rows are broadcast: all of small if it is no longer, else the keys that hold more than one in `most` of
    the rows (there can't be more than `most` of them). The other keys are joined by a shuffle, in which none is large. how: inner or left."""
    match = lambda: _all(F.col(a).eqNullSafe(F.col(b)) for a, b in on)
    keys = [b for _, b in on]
    seen = small.agg(F.count("*").alias("rows"), F.sum(n_col).alias("total")).first()
    if seen["rows"] <= most:
        return big.join(F.broadcast(small.drop(n_col)), match(), how).drop(*keys)
    often = F.col(n_col) * most > (seen["total"] or 0)
    hot, rest = small.filter(often).drop(n_col), small.filter(~F.coalesce(often, F.lit(False))).drop(n_col)
    frequent = big.join(F.broadcast(hot), match(), "inner").drop(*keys)
    others = big.join(F.broadcast(hot.select(*keys)), match(), "left_anti").join(rest, match(), how).drop(*keys)
    return frequent.unionByName(others)


def _all(conditions):
    out = None
    for c in conditions:
        out = c if out is None else out & c
    return out
