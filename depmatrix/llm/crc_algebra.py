"""CRC-32 of joined strings from the CRCs of their parts, many at a time.

Appending n bytes multiplies a CRC by the n-th power of a matrix over GF(2): crc(a + b) = shift(crc(a), len(b)) ^ crc(b). The matrices for 1, 2, 4, ... bytes are squares of one another;
each is kept as four tables of 256 values, one for each byte of a CRC, so that a shift is four look-ups and three XORs.
"""

from __future__ import annotations

import zlib

import numpy as np

#: The polynomial of zlib's CRC-32, bits reversed.
POLYNOMIAL = 0xEDB88320
_BYTE = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _BYTE = (_BYTE >> 1) ^ np.where(_BYTE & 1, np.uint32(POLYNOMIAL), np.uint32(0))


def _apply(tables: np.ndarray, c: np.ndarray) -> np.ndarray:
    return tables[0][c & 255] ^ tables[1][(c >> 8) & 255] ^ tables[2][(c >> 16) & 255] ^ tables[3][c >> 24]


def _one_byte() -> np.ndarray:
    """Tables of the matrix that appends one zero byte."""
    values = np.arange(256, dtype=np.uint32)
    return np.stack([(v >> 8) ^ _BYTE[v & 255] for v in (values, values << 8, values << 16, values << 24)])


_shifts = [_one_byte()]


def _shift(k: int) -> np.ndarray:
    """Tables for 2^k bytes."""
    while len(_shifts) <= k:
        last = _shifts[-1]
        _shifts.append(np.stack([_apply(last, row) for row in last]))
    return _shifts[k]


def shifted(crc: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The CRCs' part in those of strings that go on for `lengths` bytes."""
    out = np.array(crc, np.uint32)
    for k in range(int(lengths.max(initial=0)).bit_length()):
        which = np.flatnonzero((lengths >> k) & 1)
        out[which] = _apply(_shift(k), out[which])
    return out


def joined(left: np.ndarray, right: np.ndarray, right_length: np.ndarray) -> np.ndarray:
    """CRCs of the left strings with the right ones behind them."""
    return shifted(left, right_length) ^ right


def with_byte(crc: np.ndarray, byte: int) -> np.ndarray:
    """CRCs of the strings with one more byte."""
    state = ~crc
    return ~(_BYTE[(state ^ np.uint32(byte)) & np.uint32(255)] ^ (state >> np.uint32(8)))


def of_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, long: int = 48) -> np.ndarray:
    """CRC of each data[start:end], a byte of all of them at a time; those of more than `long` bytes one by one."""
    state = np.full(len(starts), 0xFFFFFFFF, np.uint32)
    lengths = ends - starts
    order = np.argsort(lengths, kind="stable")
    bounds = np.searchsorted(lengths[order], np.arange(1, long + 2))
    first = bounds[long] if len(starts) else 0
    for k in range(long):
        which = order[bounds[k] : first]
        if not len(which):
            break
        state[which] = _BYTE[(state[which] ^ data[starts[which] + k]) & np.uint32(255)] ^ (state[which] >> np.uint32(8))
    out = ~state
    for w in order[first:].tolist():
        out[w] = zlib.crc32(data[starts[w] : ends[w]].tobytes())
    return out
