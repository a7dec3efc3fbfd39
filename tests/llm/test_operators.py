"""Each training-data operator against a brute-force version, and on nulls, empty texts, ties, repeated rows, empty tables and clashing columns."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from depmatrix.llm import chat, components, decontamination, html_extract, license_scan, lm_score, mixing, quality_classifier, quality_rules, shared, simhash, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = (
    "doc_id long, text string, lang string, source string, n_chars long, fp string, key string, h string, words string, size string, "
    "draws string, row string"
)
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def docs(spark, rows):
    """rows: (doc_id, text) or (doc_id, text, source); the other columns have names that operators use inside."""
    return spark.createDataFrame(
        [(r[0], r[1], "en", r[2] if len(r) > 2 else "s0", 0, "x", "x", "x", "x", "x", "x", "x") for r in rows], DOCS
    )


def prose(rng, n, names=300):
    return " ".join(rng.choice(["the", "of", "and"]) if rng.random() < 0.3 else f"w{rng.randrange(names)}x" for _ in range(n))


def odd_rows(rng):
    base = prose(rng, 80)
    return [
        (1, base),
        (2, base),
        (3, None),
        (4, ""),
        (5, " \n\t "),
        (6, "Ünïcode ÄÖ words"),
        (7, base.upper()),
        (8, base + " tail"),
        (8, base + " tail"),
        (9, prose(rng, 20_000)),
        (None, base),
        (10, "one two three"),
        (11, "a a a a a a a"),
    ]


# -- 3 SimHash


def brute_fingerprint(text):
    words = WORD.findall((text or "").translate(LOWER))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows):
    fps = [brute_fingerprint(t) for _, t in rows]
    label = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i in range(len(rows)):
            for j in range(len(rows)):
                if (fps[i] ^ fps[j]).bit_count() <= 4 and label[j] < label[i]:
                    label[i], changed = label[j], True
    least = {}
    for (doc, _), c in zip(rows, label, strict=True):
        if doc is not None:
            least[c] = min(doc, least.get(c, doc))
    return sorted(((d, f"{f:016x}", least.get(c)) for (d, _), f, c in zip(rows, fps, label, strict=True)), key=str)


@pytest.mark.parametrize("limit", [4096, 2])
def test_simhash_equals_brute_force(spark, limit):
    rng = random.Random(1)
    rows = odd_rows(rng)
    for k in range(8):  # chains of near copies
        words = prose(rng, 300).split()
        for c in range(6):
            rows.append((100 + 10 * k + c, " ".join(words)))
            words[rng.randrange(300)] = f"edit{c}"
    got = simhash.near_duplicates(docs(spark, rows), list_limit=limit)
    assert sorted((tuple(r) for r in got.select("doc_id", "fingerprint", "component_id").collect()), key=str) == brute_components(rows)


def test_simhash_links_of_random_fingerprints(spark):
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**63, 40)
    fps = sorted({int(b) ^ sum(1 << int(k) for k in rng.choice(63, rng.integers(0, 7), replace=False)) for b in base for _ in range(8)})
    label = {f: f for f in fps}
    for _ in range(len(fps)):
        new = {f: min(label[g] for g in fps if (f ^ g).bit_count() <= 4) for f in fps}
        if new == label:
            break
        label = new
    for limit in (4096, 2):
        links = simhash.near_links(spark.createDataFrame([(f,) for f in fps], "fp long"), list_limit=limit)
        got = {f: f for f in fps} | {r["node"]: r["root"] for r in components.connected_components(links).collect()}
        assert got == label


def test_keep_one_and_empty(spark):
    rng = random.Random(1)
    rows = odd_rows(rng)
    kept = simhash.keep_one(docs(spark, rows))
    ids = [r["doc_id"] for r in kept.collect()]
    want = sorted({c for _, _, c in brute_components(rows)})
    assert kept.columns == docs(spark, rows).columns and sorted(i for i in ids if i is not None) == want and ids.count(None) == 1
    assert simhash.near_duplicates(docs(spark, [])).count() == 0
    from itertools import combinations

    assert (
        len(simhash.position_sets(4)) == 20
        and all(any(set(s) <= set(c) for s in simhash.position_sets(4)) for c in combinations(range(8), 4))
    )


# -- 7 quality rules


def brute_stats(text):
    text = text or ""
    words = WORD.findall(text)
    seen = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    hit = {i + k for i in range(len(words) - 4) if seen[tuple(words[i : i + 5])] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit)


def test_quality_statistics_equal_brute_force(spark):
    rng = random.Random(3)
    rows = odd_rows(rng) + [(20, "x y z a b c x y z a b c\nx\n\nx\n x"), (21, "#a* $b% &c| <d>\x0b\x0ce"), (22, "a b c")]
    rows += [(30 + k, " ".join(rng.choice("ab") for _ in range(40)) + "\nq\nq") for k in range(20)]
    got, _ = quality_rules.judge(docs(spark, rows), spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert sorted(
        ((r["doc_id"], *(r["stats"][n] for n in names)) for r in got.collect()), key=str
    ) == sorted(((d, *brute_stats(t)) for d, t in rows), key=str)
    for r in got.collect():
        s = r["stats"]
        assert (
            r["base_failed"] == (s["n_words"] < 10 or 100 * s["n_repeat_words"] > 20 * s["n_words"]) and r["kept"] == (not r["base_failed"])
        )


def test_decision_list_learns_and_applies(spark):
    rng = random.Random(4)
    rows, labels = [], []
    for k in range(400):
        bad = k % 5 == 0
        text = prose(rng, 60)
        rows.append((k, text.replace(" ", "### ") if bad else text))
        labels.append((k, 0 if bad else 1, 0))
    labels += [(None, 0, 0), (1, None, 0), (10**6, 0, 0)]
    frame = docs(spark, rows)
    judged, rules = quality_rules.judge(frame, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert len(rules.rules) >= 1 and "reject if" in str(rules)
    kept = {r["doc_id"]: r["kept"] for r in judged.collect()}
    assert all(kept[k] == (k % 5 != 0) for k in range(400))
    clean = quality_rules.keep_good(frame, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert clean.columns == frame.columns and clean.count() == 320
    assert quality_rules.judge(docs(spark, []), spark.createDataFrame([], "doc_id long, quality int, toxic int"))[0].count() == 0


def test_decision_list_covers_more_than_eight_kinds(spark):
    kinds = [f"f{k}" for k in range(10)]
    rows = [(n, *(1.0 if n % 20 == k else 0.0 for k in range(10)), n % 20 < 10) for n in range(800)]
    frame = spark.createDataFrame(rows, ", ".join(["id long", *(f"{k} double" for k in kinds), "bad boolean"]))
    rules = quality_rules.learn(frame, tuple(kinds))
    from pyspark.sql import functions as F

    assert len(rules.rules) == 10 and frame.filter(rules.keeps(F.col) == F.col("bad")).count() == 0
    with pytest.raises(ValueError):
        quality_rules.learn(frame, tuple(kinds), max_rules=1)


# -- 8 mixing


def targets(sizes, weights, share=1.5, most=2.0):
    """The contract's words: shares by weight, what is above twice a size goes to the others by weight, until none is."""
    out, full = [0.0] * len(sizes), set()
    while True:
        left = share * sum(sizes) - sum(out[i] for i in full)
        total = sum(w for i, w in enumerate(weights) if i not in full)
        for i, w in enumerate(weights):
            if i not in full:
                out[i] = left * w / total
        over = [i for i in range(len(sizes)) if i not in full and out[i] > most * sizes[i]]
        if not over:
            return out
        for i in over:
            out[i] = most * sizes[i]
            full.add(i)


def test_targets(spark):
    def of(sizes):
        rows = mixing.source_targets(spark.createDataFrame([(f"s{k}", n) for k, n in enumerate(sizes)], "source string, n long")).collect()
        return [r["target"] for r in sorted(rows, key=lambda r: r["source"])]

    assert of([100, 100, 100]) == pytest.approx([200, 500 / 3, 250 / 3])
    assert of([0, 0]) == [0, 0]
    for sizes in ([3, 9, 1, 7, 7, 7, 2, 90], [1000, 1, 1, 1], [5]):
        assert of(sizes) == pytest.approx(targets(sizes, [mixing.WEIGHTS[k % 3] for k in range(len(sizes))]))
    sizes, weights = [10, 1000, 1, 0, 50], [5, 2, 1, 5, 2]
    got = of(sizes)
    assert sum(got) == pytest.approx(1.5 * sum(sizes)) and all(g <= 2 * s + 1e-9 for g, s in zip(got, sizes, strict=True))
    free = [i for i in range(5) if got[i] < 2 * sizes[i] - 1e-9]
    assert len({round(got[i] / weights[i], 6) for i in free}) <= 1


def test_splitting_tree_is_exact_and_unbiased():
    got = [mixing.split_tree([700, 200, 0, 100], 8, seed) for seed in range(200)]
    for shards in got:
        assert [sum(s[k] for s in shards) for k in range(4)] == [700, 200, 0, 100] and {sum(s) for s in shards} == {125}
    first = [s[0][0] for s in got]
    assert abs(np.mean(first) - 87.5) < 1.5 and 3.5 < np.std(first) < 6.5  # hypergeometric: 4.8


def test_mix(spark):
    rng = random.Random(5)
    rows = (
        [(k, prose(rng, rng.randrange(1, 400)), rng.choice(["a", "a", "a", "b", "c", None, "d"])) for k in range(300)]
        + [(900, None, "a"), (901, "", None), (5, "same row", "b"), (5, "same row", "b")]
    )
    frame = docs(spark, rows)
    out = [r.asDict(recursive=True) for r in mixing.mix(frame).collect()]
    again = [r.asDict(recursive=True) for r in mixing.mix(frame.repartition(7)).collect()]
    order = lambda x: sorted(x, key=lambda r: (r["doc_id"], str(r["draws"])))
    assert order(out) == order(again) and len(out) == len(rows)
    size = Counter()
    for _, t, s in rows:
        size[s] += len(WORD.findall(t or ""))
    names = sorted(size, key=lambda s: (s is None, s or ""))
    goal = dict(zip(names, targets([size[n] for n in names], [mixing.WEIGHTS[i % 3] for i in range(len(names))]), strict=True))
    taken = Counter()
    for r in out:
        n = sum(d["words"] for d in r["draws"])
        taken[r["source"]] += n
        assert n <= 2 * r["size"] and r["source_size"] == size[r["source"]] and r["target"] == pytest.approx(goal[r["source"]])
        once = Counter(w for d in r["draws"] for w in range(d["first"], d["first"] + d["words"]))
        assert all(0 <= w < r["size"] and c <= 2 for w, c in once.items())
    assert all(abs(taken[s] - goal[s]) <= 1 + 0.001 * goal[s] for s in names)
    assert {d["shard"] for r in out for d in r["draws"]} == set(range(16))
    assert mixing.mix(docs(spark, [])).count() == 0
    shards = mixing.shard_rows(mixing.mix(frame))
    assert shards.agg({"words": "sum"}).first()[0] == sum(taken.values())


def test_twenty_thousand_sources(spark):
    """Each source's targets and quotas, the lines' shares of the shards, and that no word is drawn more often than a target of twice its source allows."""
    sources = 20_000
    many = spark.range(3 * sources).select(
        F.col("id").alias("doc_id"),
        F.when(F.col("id") % 9 == 0, "hot").otherwise(F.concat(F.lit("host "), F.col("id") % sources)).alias("source"),
        F.array_join(F.array_repeat(F.lit("w"), (F.pmod(F.xxhash64("id"), F.lit(12)) + 1).cast("int")), " ").alias("text"),
    )
    mixed = shared.written(mixing.mix(many))
    rows = mixing.by_document(mixed).toPandas()
    assert len(rows) == 3 * sources
    by = rows.groupby("source").agg(size=("size", "sum"), known=("source_size", "first"), target=("target", "first"), taken=("taken", "sum"))
    assert len(by) == sources + 1
    assert (by["size"] == by["known"]).all()
    names = sorted(by.index)
    goal = targets(by.loc[names, "size"].tolist(), [mixing.WEIGHTS[k % 3] for k in range(len(names))])
    assert np.allclose(by.loc[names, "target"], goal)
    assert (abs(by["taken"] - by["target"]) <= 1 + 0.001 * by["target"]).all() and (rows["taken"] <= 2 * rows["size"]).all()
    drawn = mixing.shard_rows(mixed).groupBy("shard").agg(F.count("*").alias("n")).toPandas()
    assert len(drawn) == 16 and drawn["n"].max() < 1.1 * drawn["n"].min()


# -- 2 chat


def test_preference_segments(spark):
    schema = "pair_id long, turn long, role string, text string, pos string, part string"
    chosen = [
        (1, 0, "user", "q"),
        (1, 1, "assistant", "a"),
        (1, 2, "user", "more"),
        (2, 0, "user", None),
        (3, 0, "user", "x"),
        (3, 0, "user", "x"),
        (None, 0, "user", "n"),
        (4, 5, "user", "same"),
    ]
    rejected = [(1, 0, "user", "q"), (1, 1, "assistant", "b"), (2, 0, "user", None), (2, 1, "assistant", ""), (4, 9, "user", "same")]
    make = lambda rows: spark.createDataFrame([(*r, "z", "z") for r in rows], schema)
    out = chat.preference_segments(make(chosen), make(rejected))
    got = {}
    for r in out.orderBy("pair_id", "part", "pos").collect():
        got.setdefault((r["pair_id"], r["part"]), []).append((r["role"], r["train"]))
    assert got == {
        (1, "prompt"): [("user", 0)],
        (1, "chosen"): [("assistant", 1), ("user", 0)],
        (1, "rejected"): [("assistant", 1)],
        (2, "prompt"): [("user", 0)],
        (2, "rejected"): [("assistant", 1)],
        (3, "chosen"): [("user", 0)] * 2,
        (4, "prompt"): [("user", 0)],
    }
    assert out.filter("pair_id = 1 and part = 'prompt'").first()["rendered"] == "<|user|>\nq<|end|>\n"
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.preference_segments(*chat.pairs_from_conversations(empty)).count() == 0


# -- 4 WARC


def test_warc_round_trip(spark, tmp_path):
    body = "ä" * 60 + "<p>"
    rows = [
        (3, "http://a/\r\nX: y", body),
        (1, None, body),
        (2, "http://b", "short"),
        (4, "http://c", "short"),
        (5, "http://d", None),
        (6, "http://e", ""),
        (7, "http://f", "x" * 300_000),
        (None, "http://g", body),
        (8, "http://h", "x" * 99),
        (9, "http://i", "x" * 99),
    ]
    pages = spark.createDataFrame([(*r, "z", "z") for r in rows], "page_id long, url string, html string, digest string, payload string")
    got = {r["page_id"]: r for r in warc.round_trip(pages, with_payload=True).collect()}
    assert len(got) == len(rows)
    for page, _, html in rows:
        r, data = got[page], (html or "").encode()
        assert (r["payload_bytes"], r["payload_digest"]) == (len(data), hashlib.sha256(data).hexdigest())
        revisit = html == body and page != 1
        assert (r["record_type"], r["refers_to"]) == (("revisit", 1) if revisit else ("response", None))
        assert r["payload"] == (None if revisit else data)
    assert got[3]["url"] == "http://a/%0D%0AX: y"
    assert warc.round_trip(pages.limit(0)).count() == 0
    (tmp_path / "w").mkdir()
    assert warc.to_files(warc.archives(pages, archive_bytes=500), str(tmp_path / "w")).count() >= 2
    assert warc.records(warc.from_files(spark, str(tmp_path / "w"))).count() == len(rows)


def test_warc_archive_of_many_megabytes(spark):
    pages = spark.createDataFrame([(k, "u", f"{k} " * 1_000_000) for k in range(12)], "page_id long, url string, html string")
    for with_payload in (False, True):
        got = warc.records(warc.archives(pages.coalesce(1)), with_payload).collect()
        assert sorted(r["payload_bytes"] for r in got) == sorted(len(f"{k} ") * 1_000_000 for k in range(12))


def test_warc_reader_finds_damage():
    data = b"x" * 1000
    good = warc.record(1, "u", data, hashlib.sha256(data).hexdigest(), None, False)
    assert len(list(warc.read_records([good[:50], good[50:] + good]))) == 2
    assert [r["payload"] for r in warc.read_records(bytes([b]) for b in good)] == [data]
    for bad in (good[:-20], good[:30] + bytes([good[30] ^ 255]) + good[31:], warc.record(1, "u", data, "0" * 64, None, False)):
        with pytest.raises(warc.WarcError):
            list(warc.read_records([bad]))
    assert zlib.decompress(good, 31).startswith(b"WARC/1.1\r\n")


# -- 5 licenses


def brute_license(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    at = [
        (i, label)
        for phrase, label in license_scan.PHRASES.items()
        for i in range(len(words))
        if words[i : i + phrase.count(" ") + 1] == phrase.split()
    ]
    return (
        len(words),
        len(at),
        min((i for i, _ in at), default=None),
        max((i for i, _ in at), default=None),
        ",".join(sorted({x for _, x in at})),
    )


def test_license_scan_equals_brute_force(spark):
    rng = random.Random(6)
    rows = (
        odd_rows(rng)
        + [
            (20, "Released under the MIT License."),
            (21, "CC BY-NC, cc by nc! cc_by nc"),
            (22, "Apache License, Version 2.0; under the mit licenseX"),
            (23, "Released undr the MIT Licence"),
            (24, "under the mit license under the mit license"),
            (25, "Licensed under the Apachee Licence, Version 2.0 ç"),
        ]
    )
    got = {(r["doc_id"], r["n_words"]): r for r in license_scan.license_scan(docs(spark, rows)).collect()}
    for doc, text in rows:
        want = brute_license(text)
        r = got[doc, want[0]]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == want
        assert set(r["base_labels"].split(",")) - {""} <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
    assert got[23, 5]["labels"] == "mit" and got[23, 5]["base_labels"] == "" and 0 < got[23, 5]["score"] < 1
    assert any("apache-2" in r["labels"] for (d, _), r in got.items() if d == 25)
    assert license_scan.license_scan(docs(spark, [])).count() == 0


def test_pigeonhole_finds_all_edited_notices():
    rng, notice = random.Random(7), license_scan.NOTICES[2]
    for _ in range(200):
        text = list(notice[0])
        for _ in range(notice[2]):
            # inside longer words: white space is normalised, so edits of it could count twice
            at, kind = (
                rng.choice([i for i in range(1, len(text) - 1) if text[i - 1].isalpha() and text[i].isalpha() and text[i + 1].isalpha()]),
                rng.randrange(3),
            )
            text[at : at + 1] = [] if kind == 0 else ["q"] if kind == 1 else [text[at], "q"]
        _, _, found = license_scan.scan(f"some words {''.join(text)} and more".encode())
        assert any(x[0] == "apache-2" for x in found), "".join(text)


def _near(text, parts, budget):
    """Fewest edits with which all of text reads as the notice's parts, keys standing between word boundaries; brute force over all divisions."""
    best = {0: 0}
    for k, (part, key, free) in enumerate(parts):
        new = {}
        for a, spent in best.items():
            for b in range(a, len(text) + 1) if k < len(parts) - 1 else [len(text)]:
                if key and not ((a == 0 or text[a - 1] == " ") and (b == len(text) or text[b] == " ")):
                    continue
                if abs(b - a - len(part)) <= min(free, budget) and (
                    d := license_scan.distance(part, text[a:b])
                ) <= free and spent + d <= budget:
                    new[b] = min(spent + d, new.get(b, 99))
        best = new
    return best.get(len(text), 99)


def test_fuzzy_labels_equal_exhaustive_search():
    """Edits anywhere (also of spaces and at word edges), notices side by side and names swapped, against all stretches between word boundaries."""
    rng = random.Random(70)
    notices = [license_scan.Notice(*n) for n in license_scan.NOTICES if len(n[0]) < 60]
    found = 0
    for n in range(150):
        own = rng.choice(notices)
        text = list(
            own.text
            if n % 3
            else own.text.replace(
                "mit", rng.choice(["bsd", "isc", "old", "mid"])
            ).replace("nc", "nd").replace("2 0", "1 1").replace("apache", "python").replace("gnu", "new")
        )
        for _ in range(rng.randrange(own.edits + 2)):
            at, kind = rng.randrange(len(text)), rng.randrange(3)
            text[at : at + 1] = [] if kind == 0 else [rng.choice("q ")] if kind == 1 else [text[at], rng.choice("q ")]
        line = " ".join(f"ab {''.join(text)} cd".split())
        words = [i for i in range(len(line)) if i == 0 or line[i - 1] == " "]
        ends = [i for i in range(1, len(line) + 1) if i == len(line) or line[i] == " "]
        want = {
            x.label
            for x in notices
            for a in words
            for b in ends
            if abs(b - a - len(x.text)) <= x.edits and _near(line[a:b], x.parts(), x.edits) <= x.edits
        }
        _, _, got = license_scan.scan(line.encode())
        assert {x[0] for x in got} & {x.label for x in notices} == want, line
        for label, first, last, edits, score in got:
            stretch = " ".join(line.split()[first : last + 1])
            assert (
                edits == min(
                    _near(stretch, x.parts(), x.edits)
                    for x in map(lambda y: license_scan.Notice(*y), license_scan.NOTICES)
                    if x.label == label
                )
                and 0 < score <= 1
            )
        found += bool(want)
    assert found > 50


@pytest.mark.parametrize(
    "text",
    [
        "Released under the BSD license",
        "released under the ISC license",
        "released under the old license of the city",
        "released under the GPL license",
        "released under the submit license",
        "released under the permit license",
        "Licensed under CC BY-ND 4.0",
        "Licensed under the Apache License, Version 1.1",
        "Licensed under the Python License, Version 2.0",
        "licensed under the GNU Affero General Public License",
        "licensed under the new general public license",
        "this source code form is subject to the terms of the eclipse public license",
        "no rights reserved",
        "some rights reserved",
        "under the mit\\x00licence",
    ],
)
def test_notices_of_other_licenses_have_no_label(text):
    assert license_scan.scan(text.encode())[1:] == ([], [])


def test_each_label_is_its_own_license_only():
    said = {
        "Released under the MIT License": {"mit"},
        "Licensed under the Apache License, Version 2.0": {"apache-2"},
        "Licensed under CC BY-NC 4.0": {"cc-by-nc"},
        "Licensed under CC BY-SA 4.0": {"cc-by-sa"},
        "Licensed under CC BY 4.0": {"cc-by"},
        "This work is licensed under the GNU General Public License, version 3": {"gpl"},
        "licensed under the GNU Lesser General Public License": {"lgpl"},
    }
    for text, labels in said.items():
        _, exact, fuzzy = license_scan.scan(text.encode())
        assert {x[0] for x in exact} | {x[0] for x in fuzzy} == labels, text


# -- 2 preference pairs with null turns


def test_turns_without_a_number_stand_last(spark):
    duckdb = pytest.importorskip("duckdb")
    from depmatrix.llm.queries import OP2_SQL

    rows = [
        (0, 1, "user", "q"),
        (0, 2, "assistant", "a"),
        (0, None, "user", "lost"),
        (0, 1, None, "q"),
        (1, 1, "user", "q"),
        (1, 2, "assistant", "b"),
        (1, None, "assistant", "late"),
        (2, None, "assistant", "x"),
        (2, None, None, None),
        (3, 1, "user", None),
        (3, 1, "user", "z"),
    ]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = [
        tuple(r)
        for r
        in chat.preference_segments(*chat.pairs_from_conversations(frame)).select(
            "pair_id", "part", "pos", "role", "rendered", "train", "prompt_turns"
        ).collect()
    ]
    assert {r[6] for r in got if r[0] == 0} == {2} and any("lost" in r[4] and r[1] == "chosen" for r in got)
    db = duckdb.connect()
    db.execute("CREATE TABLE conversations(conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    db.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    assert sorted(got, key=str) == sorted(db.execute(OP2_SQL).fetchall(), key=str)


# -- 9 HTML

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><header>Site</header><nav><ul><li><a href=/>Home</a></li></ul></nav>
<div class="ad">Buy now this thing today</div><article><h1>Head &amp; line</h1><p><b>First   part<br><p>Second
part.</p><p>Ok.</p><div class="comments"><p>I disagree strongly with all of this</p></div></article><aside>Side</aside><form>Mail</form><footer>&copy; all</footer></body></html>"""


def test_html_extraction(spark):
    want = "Head & line\n\nFirst part\n\nSecond part.\n\nOk."
    assert html_extract.extract(PAGE) == want
    assert html_extract.extract(PAGE.partition("</article>")[0]) == want
    bare = (
        "<html><body><div class=menu><a href=x>a</a><a href=y>b</a></div><div>"
        + "".join(f"<p>Paragraph number {k} has quite a lot of words in it, more than a menu has.</p>" for k in range(5))
        + "<p>Short.</p></div><div><a href=q>x</a> <a href=r>y</a></div></body></html>"
    )
    assert html_extract.extract(bare).count("\n\n") == 5 and html_extract.extract(bare).endswith("Short.")
    assert html_extract.extract("plain words only") == "plain words only" and html_extract.extract("<p></p>") == ""
    pages = spark.createDataFrame(
        [(1, "u", PAGE, "z"), (1, "u", PAGE, "z"), (2, None, None, "z"), (None, "v", "", "z")],
        "page_id long, url string, html string, text string",
    )
    got = sorted((tuple(r) for r in html_extract.extract_pages(pages).collect()), key=str)
    assert got == sorted([(1, "u", want, len(want)), (1, "u", want, len(want)), (2, None, "", 0), (None, "v", "", 0)], key=str)
    assert html_extract.extract_pages(pages.limit(0)).count() == 0


def test_html_clusters_decide_where_an_article_is_named():
    say = lambda k, n=12: " ".join(f"word{k}x{j}" for j in range(n)) + "."
    story = "".join(f"<p>{say(k, 40)}</p>" for k in range(6))
    cards = "".join(f"<article><h3><a href=/{k}>Card {k}</a></h3><p><a href=/{k}><b>See</b> it</a></p></article>" for k in range(4))
    links = "<div>" + "".join(f"<p><a href=/{k}>more {k}</a></p>" for k in range(9)) + "</div>"
    # teasers are articles, the story isn't; with and without a main around all
    for page in (
        f"<body>{cards}<div>{story}</div>{cards}</body>",
        f"<body><main>{cards}<div>{story}</div>{cards}</main></body>",
        f"<body><div role=main>{cards}<div>{story}</div>{cards}</div></body>",
    ):
        assert html_extract.extract(page).split("\n\n") == [say(k, 40) for k in range(6)]
    # boilerplate without a telling class inside main
    assert html_extract.extract(
        f"<body><main>{links}<div>{story}</div>{links}</main></body>"
    ).split("\n\n") == [say(k, 40) for k in range(6)]
    # parts of an article that are prose stay, however long another part is, and so does its title
    page = f"<body><article><h1>A title</h1><div>{story}</div><section><p>{say(7)}</p></section><div><p>{say(8, 900)}</p></div><section><p>{say(9)}</p><p>{say(10)}</p></section></article></body>"
    got = html_extract.extract(page).split("\n\n")
    assert got == ["A title", *(say(k, 40) for k in range(6)), say(7), say(8, 900), say(9), say(10)]


def test_smoothing_and_threshold():
    assert html_extract.smoothed([5.0, 5.0, 5.0]) == pytest.approx([5, 5, 5])
    assert 1 < html_extract.threshold([1, 1, 1, 9, 10]) < 9 and html_extract.threshold([3, 3]) == 3


# -- 10 LM


def test_lm_base_scores_equal_brute_force(spark):
    rng = random.Random(8)
    rows = odd_rows(rng) + [(100 + k, prose(rng, 60)) for k in range(120)]
    tokens = lambda t: [*WORD.findall((t or "").translate(LOWER)), None]
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 5 == 1
    counts = Counter(x for d, t in rows if not held(d) for x in tokens(t))
    n, v = sum(counts.values()), len(counts)
    got = sorted((tuple(r) for r in lm_score.lm_scores(docs(spark, rows), max_words=500, max_ngrams=300).collect()), key=str)
    want = sorted(
        (
            (
                d,
                held(d),
                len(tokens(t)),
                sum(counts[x] > 0 for x in tokens(t)),
                n,
                sum(math.log10((counts[x] + 0.5) / (n + 0.5 * (v + 1))) for x in tokens(t)),
            )
            for d, t in rows
        ),
        key=str,
    )
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert [g[5] for g in got] == pytest.approx([w[5] for w in want]) and all(g[6] <= 0 for g in got)
    assert lm_score.lm_scores(docs(spark, [])).count() == 0


def test_lm_scores_keep_every_bigram(spark):
    """Bigrams seen once or twice, of rare words too, raise the score as brute force says, however few n-grams one filter holds."""
    rng = random.Random(12)
    rows = (
        [(k, " ".join(f"w{rng.randrange(700)}" for _ in range(80))) for k in range(150)]
        + [(1000 + k, "once upon " + prose(rng, 30)) for k in range(40)]
    )
    rows += [(None, ""), (2000, rows[1][1]), (2001, rows[2][1]), (2002, rows[3][1]), (2003, rows[4][1])]
    tokens = lambda t: [*WORD.findall(t.translate(LOWER)), None]
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 5 == 1
    trained = [tokens(t) for d, t in rows if not held(d)]
    one, two = Counter(x for t in trained for x in t), Counter(x for t in trained for x in zip([None, *t], t))
    n, v = sum(one.values()), len(one)

    def level(c):  # the middle of the whole numbers with the level of c
        q = math.floor(math.log(c) / math.log(1.5) + 1e-9)
        inside = [x for x in range(1, 2 * c + 2) if math.floor(math.log(x) / math.log(1.5) + 1e-9) == q]
        return (inside[0] + inside[-1]) / 2

    def score(t):
        p = 0.0
        for a, b in zip([None, *t], t):
            share, pair = 0.3 if one[a] else 0.0, two[a, b]
            p += math.log10(share * min(1, level(pair) / one[a] if pair else 0) + (1 - share) * (one[b] + 0.5) / (n + 0.5 * (v + 1)))
        return p

    want = {d: score(tokens(t)) for d, t in rows}
    assert sum(c == 1 for c in two.values()) > 5000
    for options in ({}, {"max_ngrams": 3}, {"max_words": 1}, {"block_bytes": 700, "max_words": 1}, {"block_bytes": 1 << 25}):
        got = {r["doc_id"]: r["score"] for r in lm_score.lm_scores(docs(spark, rows), **options).collect()}
        off = sorted(abs(got[d] - want[d]) for d in want)
        assert len(got) == len(rows) and off[len(off) // 2] < 1e-6 and sum(off) / len(off) < 0.05  # a few false positives of the filter


def test_lm_blocks_and_buckets_grow_within_bounds():
    assert lm_score.sizes(0) == lm_score.sizes(1 << 34) == (1 << 23, 1 << 24)
    assert lm_score.sizes(1 << 36) == (1 << 24, 1 << 25) and lm_score.sizes(1 << 47) == (1 << 25, 1 << 26)


def test_log_bloom_never_underestimates():
    rng = np.random.default_rng(9)
    codes, counts = rng.integers(0, 1 << 40, 20_000), rng.integers(3, 5000, 20_000)
    bloom = lm_score.LogBloom.build(codes, counts, 3)
    read = bloom.counts(codes)
    assert (read >= counts / (1.5 * 1.0) * 0.8).all() and np.median(np.abs(np.log(read / counts))) < 0.25
    assert (bloom.counts(rng.integers(1 << 41, 1 << 42, 50_000)) > 0).mean() < 0.01


def test_model_prefers_held_out_text_of_its_kind(spark):
    rng = random.Random(10)
    phrases = [[f"p{k}a", f"p{k}b", f"p{k}c"] for k in range(30)]
    rows = [(k, " ".join(w for _ in range(40) for w in rng.choice(phrases))) for k in range(300)]
    out = [r for r in lm_score.lm_scores(docs(spark, rows)).collect() if r["held_out"]]
    assert len(out) > 20 and sum(r["score"] for r in out) > sum(r["base_score"] for r in out)


# -- 6 classifier


def test_classifier_and_shrinkage(spark):
    rng = random.Random(11)
    rows, labels = [], []
    for k in range(600):
        bad = rng.random() < (0.6 if k % 3 == 0 else 0.05)
        text = prose(rng, 50)
        rows.append((k, text.upper().replace(" ", "!! ") if bad else text, f"site{k % 3}"))
        if k % 2 == 0:
            labels.append((k, int(not bad), 0))
    rows += [(None, "some text", "site1"), (5000, None, None), (5001, "", "lonely")]
    frame, told = docs(spark, rows), spark.createDataFrame(labels + [(5000, None, 0)], "doc_id long, quality int, toxic int")
    out = {r["doc_id"]: r for r in quality_classifier.classify(frame, told).collect()}
    assert len(out) == len(rows)
    truth = {d: t == t.lower() for d, t, _ in rows if t and d is not None and d < 600}
    held = [d for d in truth if d % 2]
    assert sum(out[d]["kept"] == truth[d] for d in held) / len(held) > 0.97
    by = {r["host"]: r["host_posterior"] for r in out.values()}
    assert by["site0"] < by["site1"] and by["site0"] < by["lonely"] < 1  # one document hardly moves a site from the global rate
    kept = quality_classifier.keep_good(frame, told)
    assert kept.columns == frame.columns and kept.count() == sum(r["kept"] for r in out.values())
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality_classifier.classify(docs(spark, []), empty).count() == 0
    assert quality_classifier.classify(frame, empty).count() == len(rows)


# -- 1 decontamination


def test_decontamination_recall_and_precision(spark):
    rng = random.Random(12)
    items = [(k, prose(rng, rng.randrange(15, 60), 5000)) for k in range(40)] + [(90, None), (91, ""), (92, prose(rng, 200, 5000))]
    rows, want = [], set()
    for k in range(300):
        words = prose(rng, rng.randrange(5, 400), 5000).split()
        if k % 4 == 0:
            item = rng.choice([*items[:40], items[42]])
            leak = item[1].split()
            if k % 8 == 0:  # a paraphrase: every tenth word replaced
                leak[4::10] = ["other"] * len(leak[4::10])
            at = rng.randrange(len(words))
            words[at:at] = leak
            want.add((k, item[0]))
        rows.append((k, " ".join(words)))
    rows += [(1000, None), (1001, "")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    out = decontamination.contaminated(docs(spark, rows), bench)
    got = {(r["doc_id"], r["item_id"]) for r in out.collect()}
    assert len(got & want) >= 0.95 * len(want) and not got - want
    clean = decontamination.keep_clean(docs(spark, rows), bench)
    assert clean.columns == docs(spark, rows).columns and clean.count() == len(rows) - len({d for d, _ in got})
    assert decontamination.contaminated(docs(spark, []), bench).count() == 0
    assert decontamination.contaminated(docs(spark, rows), bench.limit(0)).count() == 0


def test_decontamination_of_short_and_heavily_edited_items(spark):
    rng = random.Random(21)
    items = (
        [(k, " ".join(f"s{k}x{j}" for j in range(1 + k % 7))) for k in range(70)]
        + [(k, prose(rng, 30 + k % 30, 5000)) for k in range(100, 200)]
    )
    rows, want = [], set()
    for n, (k, text) in enumerate(items):
        words, leak = prose(rng, rng.randrange(50, 300), 5000).split(), text.split()
        if k >= 100:  # 28% of the words, and up to two of the answer's five
            kept = rng.sample(range(len(leak) - 5, len(leak)), 3)
            for j in rng.sample([j for j in range(len(leak)) if j not in kept], int(0.28 * len(leak))):
                leak[j] = f"w{rng.randrange(5000)}x"
        at = rng.randrange(len(words))
        words[at:at] = leak
        rows.append((n, " ".join(words)))
        want.add((n, k))
    got = {
        (r["doc_id"], r["item_id"])
        for r in decontamination.contaminated(docs(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()
    }
    short = {x for x in want if x[1] < 100}
    assert short <= got and not got - want and len((got & want) - short) >= 0.98 * len(want - short)


def test_decontamination_of_copies_in_capitals(spark):
    rng = random.Random(13)
    item = " ".join(f"é{w}ñ" for w in prose(rng, 30, 5000).split())
    rows = [(0, f"{prose(rng, 100, 5000)} {item.upper()} {prose(rng, 50, 5000)}"), (1, prose(rng, 150, 5000))]
    bench = spark.createDataFrame([(7, item)], "item_id long, text string")
    assert [(r["doc_id"], r["lcs_ratio"]) for r in decontamination.contaminated(docs(spark, rows), bench).collect()] == [(0, 1.0)]


def test_lcs():
    rng = random.Random(13)
    for _ in range(50):
        a, b = ([rng.randrange(4) for _ in range(rng.randrange(12))] for _ in range(2))
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                t[i + 1][j + 1] = t[i][j] + 1 if a[i] == b[j] else max(t[i][j + 1], t[i + 1][j])
        assert decontamination.lcs(a, b) == t[-1][-1]


# -- shared


def test_word_hashes_match_words():
    import pyarrow as pa

    texts = ["a b a", None, "", "  Ab\tab\n", "x" * 5000 + " é é", " lead"]
    table, seen = shared.byte_table(), []
    for _, _, h, counts in shared.word_hashes(*shared.string_parts(pa.array(texts)), table, 100):
        seen += np.split(h, np.cumsum(counts)[:-1]) if len(counts) else []
    words = [WORD.findall((t or "").translate(LOWER)) for t in texts]
    assert [len(s) for s in seen] == [len(w) for w in words]
    names = {}
    for s, w in zip(seen, words, strict=True):
        for h, x in zip(s.tolist(), w, strict=True):
            assert names.setdefault(x, h) == h
    assert len(set(names.values())) == len(names) and names["a"] == int(shared.one_word_hash(b"a"))
