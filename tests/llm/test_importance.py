"""Importance resampling against plain CRCs of plain strings."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from depmatrix.llm import crc_algebra, importance, queries

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(text):
    w = WORD.findall((text or "").translate(LOWER))
    return len(w), [zlib.crc32(" ".join(w[i : i + k]).encode()) % 10_000 for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def brute(docs, target, percent=5, least=20):
    each = [plain(text) for _, text in docs]
    s, t = Counter(b for _, f in each for b in f), Counter(b for text in target for b in plain(text)[1])
    ns, nt = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (ns + 10_000) / ((s[b] + 1) * (nt + 10_000)))) for b in range(10_000)]
    rows = []
    for (doc_id, _), (n, f) in zip(docs, each, strict=True):
        h = int(hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        rows.append((n, doc_id, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    open_ = sorted((r for r in rows if r[0] >= least), key=lambda r: (-r[4], r[1] is None, r[1] or 0, r[2]))
    drawn = open_[: percent * len(open_) // 100]
    out = [(*r[1:], drawn.index(r) + 1 if r in drawn else None) for r in rows]
    return sorted(out, key=repr)


def test_crcs_of_joined_strings():
    rng = random.Random(2)
    a, b = ([bytes(rng.randrange(256) for _ in range(rng.randint(0, 300))) for _ in range(400)] for _ in range(2))
    crc = lambda x: np.array([zlib.crc32(y) for y in x], np.uint32)
    size = lambda x: np.array([len(y) for y in x])
    assert np.array_equal(crc_algebra.joined(crc(a), crc(b), size(b)), crc([x + y for x, y in zip(a, b, strict=True)]))
    assert np.array_equal(crc_algebra.with_byte(crc(a), 32), crc([x + b" " for x in a]))
    ends = np.cumsum(size(a))
    assert np.array_equal(crc_algebra.of_spans(np.frombuffer(b"".join(a), np.uint8), ends - size(a), ends), crc(a))
    assert crc_algebra.shifted(np.array([zlib.crc32(b"x")], np.uint32), np.array([5_000_000]))[0] == zlib.crc32(b"x" + bytes(5_000_000)) ^ zlib.crc32(bytes(5_000_000))


@pytest.mark.parametrize("chunk", [1 << 20, 64, 7])
def test_features_of_texts_and_of_their_parts(chunk):
    rng = random.Random(chunk)
    bits = ["a", "B", "é", "中", " ", "\n", ".", "9", "_", "long" * 20, "  ", "\x00", "x"]
    texts = [None, ""] + ["".join(rng.choice(bits) for _ in range(rng.randint(0, 200))) for _ in range(200)]
    got, words = [[] for _ in texts], [0] * len(texts)
    for first, _, bucket, doc, each in importance.Features(chunk=chunk)(pa.array(texts)):
        for b, d in zip(bucket.tolist(), doc.tolist(), strict=True):
            got[first + d].append(b)
        for k, n in enumerate(each.tolist()):
            words[first + k] += n
    for text, found, n in zip(texts, got, words, strict=True):
        want = plain(text)
        assert n == want[0] and sorted(found) == sorted(want[1])


def test_odd_rows(spark):
    rng = random.Random(6)
    texts = [" ".join(rng.choice(("the", "Sea", "of", "été", "a1", "rain", "x" * 60)) for _ in range(rng.randint(0, 60))) for _ in range(300)]
    docs = list(enumerate(texts)) + [(None, "the sea " * 15), (None, None), (400, ""), (5, texts[5]), (401, "rain " * 50_000)]
    target = ["the sea of rain", None, "", "rain rain rain"]
    table = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, rank int, part string").repartition(4)
    wanted = spark.createDataFrame([(t,) for t in target], "text string")
    got = sorted((tuple(r) for r in importance.resample(table, wanted).collect()), key=repr)
    assert got == brute(docs, target)
    again = sorted((tuple(r) for r in importance.resample(table.repartition(2), wanted).collect()), key=repr)
    assert again == got
    empty = importance.resample(table, wanted.limit(0)).collect()
    assert len(empty) == len(docs) and importance.resample(table.limit(0), wanted).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = lambda name, *c: [tuple(r) for r in spark.read.parquet(f"{sf}/{name}.parquet").select(*c).collect()]
    want = brute(rows("documents", "doc_id", "text"), [r[0] for r in rows("benchmark", "text")])
    assert sorted((tuple(r) for r in queries.op13_importance_resampling(spark, sf).collect()), key=repr) == want
