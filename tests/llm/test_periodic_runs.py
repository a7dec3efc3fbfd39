"""Periodic runs against the definition."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest

from depmatrix.llm import periodic_runs, queries


def brute(w):
    found = []
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i < len(w) - q:
            j = i
            while j < len(w) - q and w[j] == w[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(6, 4 * q):
                part = w[i : i + length]
                if not any(all(part[x] == part[x + p] for x in range(length - p)) for p in range(1, q)):
                    found.append((i, length, q))
            i = max(j, i + 1)
    return sorted(found)


def odd_words(rng, n, letters=3):
    w = []
    while len(w) < n:
        w += [rng.randrange(letters) for _ in range(rng.randint(1, 9))] * rng.choice((1, 1, 2, 4, 6))
    return w[:n]


@pytest.mark.parametrize("all_lags", [512, 0])
def test_runs_are_those_of_the_definition(all_lags, monkeypatch):
    monkeypatch.setattr(periodic_runs, "ALL_LAGS", all_lags)
    rng = random.Random(3)
    for _ in range(1500):
        w = odd_words(rng, rng.randint(6, 90), rng.choice((2, 3, 5)))
        assert periodic_runs.runs_of(np.array(w)) == brute(w), w


def test_long_texts_take_few_lags():
    rng = np.random.default_rng(1)
    ids = rng.integers(0, 5000, 400_000)
    assert len(periodic_runs.candidate_lags(ids)) < 50
    ids[100_000:] = np.resize(ids[100_000:150_000], 300_000)
    assert periodic_runs.runs_of(ids) == [(100_000, 300_000, 50_000)]
    assert periodic_runs.runs_of(np.zeros(300_000, int)) == [(0, 300_000, 1)]


def expected(doc_id, text, plant):
    words = "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in text or "").split(" ")
    words = [w for w in words if w]
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if plant and doc_id is not None and h % 10 == 0 and n:
        a = h // 10 % n
        p = 1 + (n - a) // (3 + h // 10 % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    left = " ".join(w for i, w in enumerate(words) if i not in gone)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    figures = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(runs), *figures, sha("".join(f"{s},{length},{q}\n" for s, length, q in runs)), sha(left))


def test_odd_rows(spark):
    rng = random.Random(9)
    rows = [(k, " ".join(f"w{x}" for x in odd_words(rng, rng.randint(0, 60))), 5, "x") for k in range(300)]
    rows += [(None, "a a a a a a", 0, ""), (None, None, 0, ""), (7, "", 0, ""), (400, " \t\n", 0, ""), (401, "b\x00 " * 9, 1, ""), (401, "b\x00 " * 9, 1, "")]
    rows += [(402, "  　 " * 8 + "\x1c", 0, ""), (403, "\n".join(["one line", "one line"] * 5), 0, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_runs int, start string")
    for plant in (True, False):
        got = sorted((tuple(r) for r in periodic_runs.periodic_runs(docs, plant).drop("runs").collect()), key=repr)
        assert got == sorted((expected(r[0], r[1], plant) for r in rows), key=repr)
    texts = {r["doc_id"]: r["collapsed"] for r in periodic_runs.periodic_runs(docs, texts=True).collect()}
    assert texts[401] == "b\x00" and texts[403] == "one line"
    assert periodic_runs.periodic_runs(docs.limit(0)).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    short = {r["doc_id"]: r["text"] for r in rows if len(r["text"] or "") < 3000}
    got = {r["doc_id"]: tuple(r) for r in queries.op12_periodic_runs(spark, sf).collect()}
    assert len(got) == len(rows) and len(short) > 50
    for doc_id, text in short.items():
        assert got[doc_id] == expected(doc_id, text, True)
