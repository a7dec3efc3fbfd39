"""Token ids: Simple-8b words, files in order of doc_id, documents read back."""

from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from depmatrix.llm import queries, simple8b, token_output

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, part int, before long"


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("n", [0, 1, 2, 59, 60, 61, 4095, 4096, 4097, 13_000])
def test_words_hold_all_ids(n):
    rng = np.random.default_rng(n)
    kinds = (
        rng.integers(0, 50257, n),
        rng.integers(0, 2, n),
        np.full(n, 7),
        np.where(rng.random(n) < 0.05, 50_000, rng.integers(0, 200, n)),
        rng.integers(0, 1 << 32, n),
        np.repeat(rng.integers(0, 300, n // 9 + 1), 9)[:n],
    )
    for ids in kinds:
        packed = simple8b.pack(ids)
        assert np.array_equal(simple8b.unpack(packed), ids.astype(np.uint32))
        for k in range(len(packed.word_at) - 1):  # each block by itself
            assert np.array_equal(simple8b.unpack(packed, k, k + 1), ids[k * simple8b.BLOCK : (k + 1) * simple8b.BLOCK])


def test_rare_ids_escape_and_runs_are_one_word():
    ids = np.full(8000, 9)
    assert len(simple8b.pack(ids).words) == 18 + 17
    mixed = np.random.default_rng(1).integers(0, 100, 8000)
    mixed[::100] = 50_000
    packed = simple8b.pack(mixed)
    assert len(packed.escapes) >= 60 and len(packed.words) < 1150  # nearly all words hold eight or seven ids


def test_damaged_files_are_errors():
    raw = bytearray(simple8b.image([1, None], np.array([2, 5]), np.arange(5), 3))
    found = simple8b.parse(bytes(raw))
    assert found.doc_ids == [1, None] and found.first == 3 and found.ids().tolist() == [0, 1, 2, 3, 4]
    raw[-1] ^= 1
    for bad in (bytes(raw), bytes(raw[:-9]), b"", b"x" * 100):
        with pytest.raises(ValueError):
            simple8b.parse(bad)


def test_stretches_are_tokenised_as_the_whole(plain, monkeypatch):
    monkeypatch.setattr(token_output, "_WINDOW", 50)
    monkeypatch.setattr(token_output, "_LONG", 20)
    monkeypatch.setattr(token_output, "_REMEMBERED", 30)
    tokens, rng = token_output.Tokens(PATH), random.Random(4)
    bits = [" ", "  ", "\n", "\t", "a", "b'", "s", "I'll", "9", "é", "中", "。", " ", "　", "​", "\x1c", "\x85", "\r\n", "!", "--", "᠎"]
    bits += [" x ", "﻿", "\U0001f600", "٣", "<|endoftext|>", "abcdefgh", "\x00"]
    for _ in range(2500):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 90)))
        assert tokens.ids(text, None).tolist() == plain(text), text


@pytest.mark.parametrize("special_as_text", [True, False])
def test_texts_together_are_tokenised_as_the_whole(plain, monkeypatch, special_as_text):
    from tokenizers import Tokenizer

    monkeypatch.setattr(token_output, "_WINDOW", 120)
    monkeypatch.setattr(token_output, "_LONG", 20 if special_as_text else 1 << 14)
    monkeypatch.setattr(token_output, "_REMEMBERED", 60)
    monkeypatch.setattr(token_output, "_TOGETHER", 700)
    monkeypatch.setattr(token_output, "_JOINED", 5)
    tokens, rng, whole = token_output.Tokens(PATH, special_as_text), random.Random(11), Tokenizer.from_file(PATH)
    whole.encode_special_tokens = special_as_text
    bits = [" "] * 12 + ["\n", "\t", "a", "b'", "s", "I'll", "9", "é", "中", "。", " ", "　", "​", "\x1c", "\x85", "!", ".", ",", "--", "\u0120", "Ġx", "ñandú"]
    bits += ["word", "\U0001f600", "<|endoftext|>", "abcdefghijklmnopqrstuvwxyz", "\x00", "x\ny"]
    texts = [None, "", " ", "a", " a", "a "] + ["".join(rng.choice(bits) for _ in range(rng.randint(0, 60))) for _ in range(3000)] + [None]
    for column in (pa.array(texts, pa.string()), pa.array(texts, pa.large_string()).slice(3, 100), pa.array([], pa.string())):
        got = [x.tolist() for x in tokens.many(column)]
        assert got == [whole.encode(x or "", add_special_tokens=False).ids + [2] for x in column.to_pylist()]
        assert [x.tolist() for x in tokens.many(column, None)] == [x[:-1] for x in got]


def test_new_words_go_to_the_tokenizer_many_at_a_time(plain):
    tokens, asked = token_output.Tokens(PATH), []

    class Counted:
        def __init__(self, under):
            self.under = under

        def encode_batch_fast(self, parts, **options):
            asked.extend(parts)
            return self.under.encode_batch_fast(parts, **options)

    tokens._tokenizer, tokens._letters = Counted(tokens._tokenizer), Counted(tokens._letters)
    text = " ".join(f"{a}{b}q" for a in "abcdefghijklmnopqrst" for b in "uvwxyzabcdefghijklmn")  # 400 words
    texts = [text, text[4:], text + "."]
    assert [x.tolist() for x in tokens.many(pa.array(texts), None)] == [plain(x) for x in texts]
    assert len(asked) < 10
    asked.clear()
    assert tokens.ids(text, None).tolist() == plain(text) and len(asked) == 1


def test_words_met_again_are_kept_when_others_are_forgotten(monkeypatch):
    monkeypatch.setattr(token_output, "_REMEMBERED", 200)
    monkeypatch.setattr(token_output, "_TOGETHER", 500)
    tokens = token_output.Tokens(PATH)
    rare = [" ".join(f"{chr(97 + k % 26)}{chr(97 + k // 26)}{chr(97 + j)}" for j in range(26)) for k in range(60)]
    list(tokens.many(pa.array([f"z often {x}" for x in rare])))
    assert tokens._recall("often") is not None and tokens._recall(rare[0].split()[3]) is None
    assert len(tokens._met) + len(tokens._older) < 400


def brute(rows, plain):
    out, start = [], 0
    for doc_id, text, *_ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = plain(text) + [2]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_odd_rows_come_back(spark, plain, tmp_path):
    rows = [(5, "one two", 1, 2), (3, None, 0, 0), (9, "", 0, 0), (-4, "a  b\n\nc", 7, 7), (12, "word " * 60_000, 0, 0), (10, "x" * 3000 + "," + "y" * 3000, 0, 0)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    files = token_output.token_files(docs, PATH, file_ids=1000)
    got = [tuple(r) for r in token_output.read_documents(files).orderBy("start").collect()]
    assert got == brute(rows, plain)
    token_output.to_files(files, str(tmp_path / "ids")).count()
    again = token_output.read_documents(token_output.from_files(spark, str(tmp_path / "ids")), with_ids=True)
    found = {r["doc_id"]: r for r in again.collect()}
    assert found[-4]["ids"] == plain("a  b\n\nc") + [2] and [tuple(r)[:4] for r in again.orderBy("start").collect()] == got


def test_null_and_repeated_ids(spark, plain):
    rows = [(None, "b", 0, 0), (2, "same", 0, 0), (2, "same", 0, 0), (2, "other", 0, 0)]
    got = token_output.read_documents(token_output.token_files(spark.createDataFrame(rows, SCHEMA), PATH)).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [None, 2, 2, 2]
    assert [r["start"] for r in got] == np.cumsum([0] + [r["n_tokens"] for r in got[:-1]]).tolist()
    assert sorted(r["ids_crc32"] for r in got) == sorted(r[3] for r in brute(rows, plain))
    empty = spark.createDataFrame([], SCHEMA)
    assert token_output.read_documents(token_output.token_files(empty, PATH)).count() == 0


def test_query_against_the_plain_tokenizer(spark, plain):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert [tuple(r) for r in queries.op11_token_output(spark, sf).orderBy(F.col("start")).collect()] == brute(rows, plain)
