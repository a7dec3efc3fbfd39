"""Simple-8b word-aligned coding of token ids: each 64-bit word has a selector and as many ids as fit, with escapes and offsets of blocks.

The four high bits of a word select how its other 60 are divided: so many ids of so many bits. Selector 0 is a run: one id, and how often it stands. An id that doesn't fit the
bits is written as all ones, and stands in full (32 bits) among the escapes; so one rare id doesn't widen its neighbours. A word is chosen for the fewest bits an id,
escapes counted. Words never cross a block of BLOCK ids; offsets of each block's words and escapes let blocks be decoded apart, and a whole image without a loop over words.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np

#: Ids in a word, bits of an id, by selector; 0 is the run.
DIVISIONS = ((0, 0), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60))
BLOCK = 4096
MAGIC = b"IDS8BW01"
_U = np.uint64
_RARE = 0.4
_LONGEST_RUN = 240
_SOME = 1 << 15


@dataclass(frozen=True)
class Packed:
    """words and escapes of n ids; word_at and escape_at: where each block's begin, and a last entry with their number."""

    n: int
    words: np.ndarray
    escapes: np.ndarray
    word_at: np.ndarray
    escape_at: np.ndarray


def _tried(ids: np.ndarray) -> list[tuple[int, bool]]:
    """Selectors, the widest first, and whether ids don't fit them. Widths that more than _RARE of all ids don't fit aren't tried."""
    out, top = [], int(ids.max())
    for selector in range(len(DIVISIONS) - 1, 0, -1):
        limit = (1 << DIVISIONS[selector][1]) - 1
        escapes = selector < len(DIVISIONS) - 1 and top >= limit
        if escapes and np.count_nonzero(ids >= limit) > _RARE * len(ids):
            break  # fewer bits fit even fewer
        out.append((selector, escapes))
    return out


def _choices(ids: np.ndarray, ends: np.ndarray, tried: list[tuple[int, bool]]) -> tuple[np.ndarray, np.ndarray]:
    """For each place the selector of a word that begins there, and how many ids it takes, up to ends."""
    n, at = len(ids), np.arange(len(ids), dtype=np.int32)
    changes = np.flatnonzero(np.append(ids[1:] != ids[:-1], True)) + 1
    room = ends.astype(np.int32) - at
    run = np.minimum(np.repeat(changes.astype(np.int32), np.diff(changes, prepend=0)) - at, room)
    run = np.minimum(run, _LONGEST_RUN)
    cost, choice = np.float32(64) / run.astype(np.float32), np.zeros(n, np.int8)  # 0: a run, else the k-th that is tried
    over, price = np.zeros(n + 1, np.float32), np.empty(n, np.float32)  # counts below 2^24 are exact
    near = np.flatnonzero(room < DIVISIONS[1][0])  # places where a word may have room to spare
    for k, (selector, escapes) in enumerate(tried, 1):
        count, bits = DIVISIONS[selector]
        short = near[room[near] < count]
        if escapes:
            np.cumsum(ids >= (1 << bits) - 1, dtype=np.float32, out=over[1:])
            if n >= count:  # the last places are short
                np.subtract(over[count:], over[: n + 1 - count], out=price[: n + 1 - count])
            price[short] = over[short + room[short]] - over[short]
            price *= np.float32(32)
            price += np.float32(64)
        else:
            price[:] = 64
        least = price[short] / room[short].astype(np.float32)
        price /= np.float32(count)
        price[short] = least
        np.maximum(choice, (price < cost).view(np.int8) * np.int8(k), out=choice)
        np.minimum(cost, price, out=cost)
    counts = np.array([_LONGEST_RUN, *(DIVISIONS[s][0] for s, _ in tried)], np.int32)
    took = np.minimum(counts[choice], np.where(choice == 0, run, room))
    return np.array([0, *(s for s, _ in tried)], np.int8)[choice], took


def pack(ids: np.ndarray, block: int = BLOCK) -> Packed:
    """ids: unsigned integers below 2^32."""
    ids = np.ascontiguousarray(ids, np.uint32)
    n = len(ids)
    if not n:
        return Packed(0, np.zeros(0, _U), np.zeros(0, np.uint32), np.zeros(1, np.int64), np.zeros(1, np.int64))
    ends = np.minimum(np.repeat(np.arange(block, n + block, block), block)[:n], n)
    tried, some = _tried(ids), max(block, _SOME // block * block)  # blocks don't depend on one another; some of them stay in a core's cache
    chosen, took = map(np.concatenate, zip(*(_choices(ids[a : a + some], ends[a : a + some] - a, tried) for a in range(0, n, some)), strict=True))
    step, starts, i = took.astype(np.uint8).tobytes(), [], 0
    while i < n:
        starts.append(i)
        i += step[i]
    starts = np.array(starts, np.int64)
    selectors, words = chosen[starts], np.zeros(len(starts), _U)
    escaped, top = np.zeros(n, bool), _U(ids.max())
    padded = np.append(ids.astype(_U), np.zeros(60, _U))
    for selector in np.unique(selectors).tolist():
        which = np.flatnonzero(selectors == selector)
        at = starts[which]
        if selector == 0:
            words[which] = ids[at].astype(_U) | (took[at].astype(_U) << _U(32))
            continue
        count, bits = DIVISIONS[selector]
        code, marker = np.full(len(at), _U(selector) << _U(60)), _U((1 << bits) - 1)
        room = ends[at] - at
        for k in range(count):  # the k-th id of all words of the selector
            values = padded[at + k]
            if room.min(initial=count) <= k:
                values[room <= k] = 0
            if count > 1 and top >= marker:
                out = values >= marker
                escaped[at[out] + k] = True
                values[out] = marker
            code |= values << _U(k * bits)
        words[which] = code
    edges = np.append(np.arange(0, n, block), n)
    before = np.append(0, np.cumsum(escaped))
    return Packed(n, words, ids[escaped], np.searchsorted(starts, edges), before[edges])


def unpack(packed: Packed, first: int = 0, last: int | None = None, block: int = BLOCK) -> np.ndarray:
    """The ids of blocks first..last-1, or of all; one pass for each selector."""
    last = len(packed.word_at) - 1 if last is None else last
    if last <= first:
        return np.zeros(0, np.uint32)
    words = packed.words[packed.word_at[first] : packed.word_at[last]]
    escapes = packed.escapes[packed.escape_at[first] : packed.escape_at[last]]
    selectors = (words >> _U(60)).astype(np.int64)
    counts = np.array([c for c, _ in DIVISIONS])[selectors]
    runs = selectors == 0
    counts[runs] = ((words[runs] >> _U(32)) & _U(255)).astype(np.int64)
    begin = np.append(0, np.cumsum(counts))
    out, marked = np.zeros(begin[-1], np.uint32), np.zeros(begin[-1], bool)
    for selector in np.unique(selectors).tolist():
        which = np.flatnonzero(selectors == selector)
        if selector == 0:
            lengths = counts[which]
            places = np.repeat(begin[which] - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())
            out[places] = np.repeat((words[which] & _U(0xFFFFFFFF)).astype(np.uint32), lengths)
            continue
        count, bits = DIVISIONS[selector]
        values = (words[which][:, None] >> (np.arange(count) * bits).astype(_U)) & _U((1 << bits) - 1)
        places = begin[which][:, None] + np.arange(count)
        out[places] = values.astype(np.uint32)
        if count > 1:
            marked[places] = values == _U((1 << bits) - 1)
    # the last word of a block may have room to spare, which decodes as zeros after the block's ids
    at = begin[packed.word_at[first : last + 1] - packed.word_at[first]]
    sizes = np.diff(np.minimum(np.arange(first, last + 1) * block, packed.n))
    keep = np.ones(len(out), bool)
    for k in np.flatnonzero(np.diff(at) > sizes):
        keep[at[k] + sizes[k] : at[k + 1]] = False
    out, marked = out[keep], marked[keep]
    out[marked] = escapes
    return out


def image(doc_ids: list[int | None], ends: np.ndarray, ids: np.ndarray, first: int) -> bytes:
    """A file: magic, eight counts, table of documents (id, whether it is null, where it ends), offsets of blocks, words, escapes; all little-endian, with a CRC of the rest."""
    packed = pack(ids)
    body = b"".join(
        (
            np.array([len(ids), first, len(doc_ids), len(packed.words), len(packed.escapes), len(packed.word_at), BLOCK, 0], "<u8").tobytes(),
            np.array([x or 0 for x in doc_ids], "<i8").tobytes(),
            np.asarray(ends, "<u8").tobytes(),
            packed.word_at.astype("<u8").tobytes(),
            packed.escape_at.astype("<u8").tobytes(),
            packed.words.astype("<u8").tobytes(),
            packed.escapes.astype("<u4").tobytes(),
            np.array([x is None for x in doc_ids], np.uint8).tobytes(),
        )
    )
    return MAGIC + np.array([zlib.crc32(body)], "<u4").tobytes() + body


@dataclass(frozen=True)
class Image:
    """What parse() finds in a file: first is the number of ids in the files of its part before it."""

    first: int
    doc_ids: list[int | None]
    ends: np.ndarray
    packed: Packed

    def ids(self) -> np.ndarray:
        return unpack(self.packed)


def parse(raw: bytes) -> Image:
    """ValueError if the file is cut off or was changed."""
    if raw[:8] != MAGIC or len(raw) < 76:
        raise ValueError("not a file of token ids")
    body = memoryview(raw)[12:]
    if zlib.crc32(body) != int.from_bytes(raw[8:12], "little"):
        raise ValueError("file of token ids is damaged")
    n, first, docs, words, escapes, offsets, block, _ = np.frombuffer(body, "<u8", 8).astype(np.int64).tolist()
    if block != BLOCK:
        raise ValueError(f"blocks of {block} ids")
    at, parts = 64, []
    for kind, count in (("<i8", docs), ("<u8", docs), ("<u8", offsets), ("<u8", offsets), ("<u8", words), ("<u4", escapes), ("u1", docs)):
        parts.append(np.frombuffer(body, kind, count, at))
        at += parts[-1].nbytes
    names, ends, word_at, escape_at, code, out, null = parts
    doc_ids = [None if z else x for x, z in zip(names.tolist(), null.tolist(), strict=True)]
    packed = Packed(n, code.astype(_U), out.astype(np.uint32), word_at.astype(np.int64), escape_at.astype(np.int64))
    return Image(first, doc_ids, ends.astype(np.int64), packed)
