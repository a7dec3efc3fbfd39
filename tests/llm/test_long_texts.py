"""Very long texts, worked on in pieces."""

from __future__ import annotations

import random
import resource

import xxhash

from depmatrix.llm import simhash


def whole(text: bytes, words: int = 4) -> int:
    """The contract's words, over all shingles at once."""
    parts = text.lower().split()
    if not parts:
        return 0
    k = min(words, len(parts))
    h = [xxhash.xxh64_intdigest(b" ".join(parts[i : i + k]), 42) for i in range(len(parts) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints_in_pieces_are_those_of_whole_texts():
    rng = random.Random(3)
    for k in range(400):
        n = rng.choice((0, 1, 2, 3, 4, 5, 6, 40))
        text = "".join(rng.choice(("Ab", "b\x00", "c" * 30, "é", "D")) + rng.choice((" ", "\n\n", "\t ")) for _ in range(n)).encode()
        text = rng.choice((b"", b"  ")) + (text if k % 2 else text.rstrip())
        for piece in (1, 7, 64):
            for words in (1, 4):
                assert simhash.fingerprint(text, words, piece=piece) == whole(text, words)
                assert simhash.fingerprint(text, words) == whole(text, words)


def test_a_long_text_takes_little_more_than_itself():
    rng = random.Random(4)
    base = " ".join(f"w{rng.randrange(10**6)}" for _ in range(100_000)).encode()
    simhash.fingerprint(base)
    text = base * 40  # 31 MB, 4 million words
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    simhash.fingerprint(text)
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 100_000  # KB
