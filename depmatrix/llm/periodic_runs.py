"""Periodic runs of words: stretches that repeat with a period at least four times, found by bit-parallel lags, and texts with the repeats taken out.

Ids of a text's words are written as bit planes, one big integer for each bit of the ids. A plane XORed with itself shifted by q tells where words q apart differ in that bit; the OR
over the planes tells where they differ at all. A run of period q is a long stretch of zeros; AND with copies shifted by 1, 2, 4, ... leaves a bit where enough zeros
follow, so that nearly all lags are done with after a few operations on whole integers.

A text of n words has n / 4 lags. Of long texts only those are tried that can have a run: the stretches of 2^j words (2^j the power of two above q) inside a run of period q next occur just q
words on, at q + 1 places at least, as a shorter distance would give the run a shorter period. These distances come from ranks of stretches, doubled in length each round.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words that a run has at least, and periods.
SHORTEST, TIMES = 6, 4
#: Words up to which all lags are tried.
ALL_LAGS = 512
_SCHEMA = (
    "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string, "
    "runs array<struct<start: long, length: long, period: long>>"
)


def candidate_lags(ids: np.ndarray) -> list[int]:
    """Ascending lags among which are all periods of runs."""
    n = len(ids)
    if n <= ALL_LAGS:
        return list(range(1, n // TIMES + 1))
    found: list[int] = []
    rank, size = ids.astype(np.int64), 1
    while size <= n // TIMES:
        # ranks of stretches of 2 * size words; lags size..2 * size - 1 belong to these
        m = n - 2 * size + 1
        if m <= 0:
            break
        pair = rank[:m] * (int(rank.max()) + 1) + rank[size : size + m]
        order = np.argsort(pair, kind="stable")
        same = pair[order[1:]] == pair[order[:-1]]
        apart = (order[1:] - order[:-1])[same]
        apart = apart[(apart >= size) & (apart < 2 * size) & (apart <= n // TIMES)]
        lags, times = np.unique(apart, return_counts=True)
        found.extend(lags[times > lags].tolist())
        rank = np.empty(m, np.int64)
        rank[order] = np.append(0, np.cumsum(~same))
        if len(apart) == 0 and not same.any():
            break  # no stretch of this length occurs twice, so no longer one does
        size *= 2
    return found


def _planes(ids: np.ndarray) -> list[int]:
    bits = max(1, int(ids.max()).bit_length())
    return [int.from_bytes(np.packbits((ids >> k) & 1, bitorder="little").tobytes(), "little") for k in range(bits)]


def _enough(match: int, least: int) -> int:
    """Bits from which `least` set bits follow, the bit included."""
    have = 1
    while have < least and match:
        step = min(have, least - have)
        match &= match >> step
        have += step
    return match


def word_ids(words: list[bytes]) -> np.ndarray:
    number: dict[bytes, int] = {}
    return np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))


def runs_of(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs, by start, then period: maximal stretches with that smallest period, of at least SHORTEST words and TIMES periods."""
    n = len(ids)
    if n < SHORTEST:
        return []
    planes = _planes(ids)
    found: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for q in candidate_lags(ids):
        least = max(SHORTEST, TIMES * q) - q  # words that equal the one q on
        inside = (1 << (n - q)) - 1
        differ = 0
        for k, plane in enumerate(planes):
            differ |= plane ^ (plane >> q)
            if k == 3 and not _enough(~differ & inside, least):
                break  # the other planes can but add differences
        else:
            match = ~differ & inside
            if not _enough(match, least):
                continue
            raw = np.frombuffer(match.to_bytes((n - q) // 8 + 1, "little"), np.uint8)
            bits = np.unpackbits(raw, bitorder="little", count=n - q)
            edges = np.flatnonzero(np.diff(bits, prepend=0, append=0))
            starts, ends = edges[::2], edges[1::2]
            long = ends - starts >= least
            starts, ends = starts[long], ends[long] + q
            for p, (a, b) in found.items():  # a stretch inside a run of a period that divides q has that one
                if q % p == 0 and len(starts):
                    at = np.searchsorted(a, starts, side="right") - 1
                    own = (at < 0) | (b[at] < ends)
                    starts, ends = starts[own], ends[own]
            if len(starts):
                found[q] = starts, ends
    return sorted((int(s), int(e - s), q) for q, (a, b) in found.items() for s, e in zip(a, b, strict=True))


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Whether each word stays: those that a run contains after its first period go."""
    steps = np.zeros(n + 1, np.int64)
    for s, length, q in runs:
        steps[s + q] += 1
        steps[s + length] -= 1
    return np.cumsum(steps[:-1]) == 0


def planted(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The text with a period planted into one document in ten: h is the CRC of the id's digits; where h is a multiple of ten, the words from place a on repeat p words."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    repeated = words[a : a + p]
    return words[:a] + (repeated * ((n - a) // p + 1))[: n - a]


def _row(doc_id: int | None, text: str | None, plant: bool) -> tuple:
    words = (text or "").encode("utf-8", "surrogatepass").split()  # bytes.split() parts at space and 0x09-0x0D alone
    if plant:
        words = planted(words, doc_id)
    runs = runs_of(word_ids(words)) if len(words) >= SHORTEST else []
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    keep = kept_words(len(words), runs).tolist() if runs else []
    left = b" ".join([w for w, k in zip(words, keep, strict=True) if k] if runs else words)
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    figures = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    listed = [{"start": s, "length": length, "period": q} for s, length, q in runs]
    return (doc_id, len(runs), *figures, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(left).hexdigest(), left, listed)


def periodic_runs(docs: DataFrame, plant: bool = False, texts: bool = False) -> DataFrame:
    """One row for each row of docs: doc_id, n_runs, start, length, period, exponent_milli of the longest run (ties: the first, then the shorter period; null without runs), runs_sha256 over
    all runs, collapsed_sha256 over the words that stay, runs; with texts also collapsed, those words joined by spaces.

    plant: a period is planted into a tenth of the documents first. Words are what stands between white space, whole texts are looked at; null and empty texts have no word and no run.
    A very long text takes some 100 bytes a word, and time in proportion to its words times the logarithm of their number, and to each lag that can have a run. A null id plants
    nothing. Repeated rows come out alike. Empty table: no rows. Other columns are not looked at."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = _SCHEMA + (", collapsed string" if texts else "")
    struct = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
    kinds = [pa.int64()] * 6 + [pa.string()] * 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256", "runs"]
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = [_row(x, y.as_py(), plant) for x, y in zip(part.column(0).to_pylist(), part.column(1), strict=True)]
                columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
                columns.append(pa.array([r[9] for r in rows], struct))
                if texts:
                    columns.append(pa.array([r[8].decode("utf-8", "surrogatepass") for r in rows], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names + ["collapsed"] * texts)

    return own.mapInArrow(run, schema)
