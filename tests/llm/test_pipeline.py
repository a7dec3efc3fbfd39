"""The pipeline against a plain re-run of its decisions on a small table."""

from __future__ import annotations

import random

import pytest

import corpus_pipeline
from depmatrix.llm import decontamination, mixing, quality_classifier, quality_rules, simhash

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng, d = random.Random(1), str(tmp_path_factory.mktemp("sf"))
    prose = lambda n: (
        " ".join(rng.choice(["the", "of"]) if rng.random() < 0.3 else f"w{rng.randrange(4000)}x" for _ in range(n))
    )
    items = [(k, prose(30)) for k in range(10)]
    rows, labels = [], []
    for k in range(400):
        text = prose(120)
        kind = k % 10
        if kind == 0:
            text = text.replace(" ", "### ")
        elif kind == 1:
            text = " ".join(["spam offer now click here"] * 20)
        elif kind == 2 and k > 12:
            text = rows[k - 9][1]  # an exact copy
        elif kind == 4:
            text += " " + items[k // 10 % 10][1]
        rows.append((k, text, "en", f"s{k % 4}", len(text)))
        labels.append((k, int(kind > 1), 0))
    rows += [(500, None, "en", None, 0), (501, "", None, "s1", 0)]
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def test_stages_take_effect(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    labels, bench = spark.read.parquet(f"{tables}/labels.parquet"), spark.read.parquet(f"{tables}/benchmark.parquet")
    now = docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        before = {r["doc_id"]: r["text"] for r in now.collect()}
        if k == 0:
            want = {r["doc_id"] for r in quality_rules.judge(now, labels)[0].filter("kept").collect()}
        elif k == 1:
            want = {r["doc_id"] for r in quality_classifier.classify(now, labels).filter("kept").collect()}
        elif k == 2:
            want = {r["component_id"] for r in simhash.near_duplicates(now).collect()}
        else:
            want = set(before) - {r["doc_id"] for r in decontamination.contaminated(now, bench).collect()}
        now = stage(spark, now, tables)
        assert now.columns == docs.columns and {r["doc_id"] for r in now.collect()} == want
        now = spark.createDataFrame(now.collect(), COLUMNS)
    left = {r["doc_id"] for r in now.collect()}
    assert not any(k % 10 in (0, 1, 4) or k % 10 == 2 and k > 12 for k in left)
    assert all(k in left for k in range(400) if k % 10 in (3, 5, 6, 7, 8, 9))
    final = corpus_pipeline.run(spark, tables)
    assert {r["doc_id"] for r in final.collect()} == left
    direct = {(r["doc_id"], r["size"], round(r["target"], 6)) for r in mixing.mix(now).collect()}
    assert {(r["doc_id"], r["size"], round(r["target"], 6)) for r in final.collect()} == direct
    assert [n for n, _ in corpus_pipeline.STAGES][-1] == "mixing" and corpus_pipeline.ORACLE_SQL is None


def test_registered_queries(spark):
    import __spark_entry__

    names = __spark_entry__.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names


def test_stages_on_odd_tables(spark, tmp_path):
    """Empty tables, nulls, a very long text, repeated ids and columns with names that operators use inside."""
    rng = random.Random(2)
    prose = lambda n: (
        " ".join(rng.choice(["the", "of"]) if rng.random() < 0.3 else f"w{rng.randrange(4000)}x" for _ in range(n))
    )
    extra = (
        "doc_id long, text string, lang string, source string, n_chars long, rows string, n string, root string, row string, key string, "
        "draws string, _h string, stats string"
    )
    item, long = prose(30), prose(200_000)
    texts = (
        [(k, prose(90), f"s{k % 3}") for k in range(60)]
        + [(70, long, "s0"), (71, None, None), (72, "", None), (None, prose(90), "s1"), (73, f"{prose(60)} {item}", "s1")]
    )
    texts += [(5, texts[5][1], "s2"), (5, texts[5][1], "s2"), (74, texts[6][1], "s1"), (7, prose(90), "s1")]
    for name, rows in (("odd", texts), ("none", [])):
        d = str(tmp_path / name)
        frame = spark.createDataFrame([(k, t, "en", s, 0, *"zzzzzzzz") for k, t, s in rows], extra)
        frame.write.parquet(f"{d}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
        spark.createDataFrame([(1, item), (2, None)] if rows else [], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
        now = spark.read.parquet(f"{d}/documents.parquet")
        left = []
        for _, stage in corpus_pipeline.STAGES[:-1]:
            now = stage(spark, now, d)
            assert now.columns == frame.columns
            left.append(now.count())
        final = corpus_pipeline.run(spark, d).collect()
        if not rows:
            assert left == [0, 0, 0, 0] and not final
            continue
        # no words: two rows; copies: two of 5, one of 6; a benchmark item: one
        assert left == [len(rows) - 2, len(rows) - 2, len(rows) - 5, len(rows) - 6]
        ids = sorted((r["doc_id"] for r in final), key=str)
        assert ids == sorted([*range(60), 7, 70, None], key=str)
        assert next(r["size"] for r in final if r["doc_id"] == 70) == 200_000
