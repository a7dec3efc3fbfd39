"""Cases at the edges of the training-data operators: zero bytes, hot keys, repeated ids and rows, very long texts, swapped markup."""

from __future__ import annotations

import hashlib
import math
import random
import re
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from depmatrix.llm import chat, components, decontamination, html_extract, lm_score, mixing, quality_classifier, quality_rules, shared, simhash, warc
from tests.llm.test_operators import LOWER, WORD, brute_fingerprint, docs, prose

# -- 4 WARC


def test_equal_archives_are_separate_files(spark, tmp_path):
    pages = spark.createDataFrame([(None, "u", "short")] * 8, "page_id long, url string, html string").repartition(4)
    (tmp_path / "w").mkdir()
    archived = warc.archives(pages, archive_bytes=1)
    assert warc.to_files(archived, str(tmp_path / "w")).count() == 8
    got = warc.records(warc.from_files(spark, str(tmp_path / "w")))
    assert got.count() == 8 and got.filter("record_type = 'response'").count() == 8
    with pytest.raises(ValueError):
        warc.to_files(warc.from_files(spark, str(tmp_path / "w")).union(warc.from_files(spark, str(tmp_path / "w"))), str(tmp_path / "w"))


@pytest.mark.parametrize("most", [100_000, 5, 0])
def test_split_join_equals_a_join(spark, most):
    rng = random.Random(1)
    rows = [(n, rng.choice([None, "hot", "hot", f"k{n % 40}"])) for n in range(500)]
    big = spark.createDataFrame(rows, "n long, key string")
    counts = Counter(k for _, k in rows)
    small = spark.createDataFrame(
        [(k, c, f"v{k}") for k, c in counts.items() if k != "k3"] + [("none", 0, "x")], "_key string, many long, value string"
    )
    for how in ("inner", "left"):
        got = sorted((tuple(r) for r in shared.split_join(big, small, [("key", "_key")], "many", how, most).collect()), key=str)
        assert got == sorted(((n, k, f"v{k}" if k != "k3" else None) for n, k in rows if how == "left" or k != "k3"), key=str)


# -- 6 posteriors


def test_posteriors_equal_a_plain_computation(spark):
    rng = random.Random(3)
    rows = (
        [
            (h, p, g, rng.random())
            for h, p, g
            in (
                (rng.choice(["a", "a", "a", "b", None, "c"]), rng.choice(["x", "y", None]), rng.choice([None, None, 0, 1]))
                for _ in range(400)
            )
        ]
        + [("lonely", "z", 0, 0.2), ("good", "z", 1, 0.9)]
    )
    sites, rate = quality_classifier.site_posteriors(spark.createDataFrame(rows, "host string, path string, good int, p_doc double"))
    n, k = Counter(), Counter()
    for h, p, g, e in rows:
        w = 0.25 if g is None else 1.0
        n[h, p] += w
        k[h, p] += w * (e if g is None else g)

    def strength(cells):  # (n, k, mean)
        total = sum(c[0] for c in cells)
        beyond = (sum(n * (k / n - m) ** 2 for n, k, m in cells) - sum(m * (1 - m) for _, _, m in cells)) / total
        spread = sum(n * m * (1 - m) for n, _, m in cells) / total
        return 1e4 if beyond <= 0 else min(1e4, max(1.0, spread / beyond - 1))

    whole = (sum(k.values()) + 1) / (sum(n.values()) + 2)
    hn, hk = Counter(), Counter()
    for (h, p), x in n.items():
        hn[h] += x
        hk[h] += k[h, p]
    m = strength([(hn[h], hk[h], whole) for h in hn])
    host = {h: (hk[h] + m * whole) / (hn[h] + m) for h in hn}
    m = strength([(n[s], k[s], host[s[0]]) for s in n])
    want = {s: (host[s[0]], (k[s] + m * host[s[0]]) / (n[s] + m)) for s in n}
    got = {(r["host"], r["path"]): (r["host_posterior"], r["path_posterior"]) for r in sites.collect()}
    assert rate == pytest.approx(whole) and got.keys() == want.keys()
    assert all(got[s] == pytest.approx(want[s]) for s in want)


def test_classifier_on_long_and_repeated_rows_and_clashing_names(spark):
    rng = random.Random(5)
    rows = [(k, prose(rng, 40).upper() if k % 4 == 0 else prose(rng, 40), f"s{k % 2}") for k in range(200)]
    rows += [(300, prose(rng, 300_000), "s0"), (1, rows[1][1], "s1"), (1, rows[1][1], "s1"), (301, "a\x00b \x00 c", "s0")]
    names = (
        "doc_id long, text string, lang string, source string, rows string, host string, path string, _h string, p_doc string, good string"
    )
    frame = spark.createDataFrame([(d, t, "en", s, *"zzzzzz") for d, t, s in rows], names)
    told = spark.createDataFrame([(k, int(k % 4 > 0), 0) for k in range(0, 200, 3)], "doc_id long, quality int, toxic int")
    kept, said = quality_classifier.keep_good(frame, told), quality_classifier.classify(frame, told)
    assert said.count() == len(rows) and kept.columns == frame.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(r["doc_id"] for r in said.filter("kept").collect())
    ids = [r["doc_id"] for r in kept.collect()]
    assert 300 in ids and ids.count(1) == 3


# -- shared


def test_zero_bytes_and_long_documents_are_hashed_like_any_other():
    rng = random.Random(6)
    texts = [
        "a\x00 a \x00a \x00 b",
        "x" * 1000,
        " ".join(rng.choice(["ab", "é", "c\x00d", "q" * 50, "\x00"]) for _ in range(400)),
        "",
        " lead",
        "trail ",
        "y" * 130 + " z",
    ]
    table, names = shared.byte_table(), {}
    for chunk in (1 << 20, 64, 7, 1):
        seen = {}
        for first, _, h, counts in shared.word_hashes(*shared.string_parts(pa.array(texts)), table, chunk):
            for k, part in enumerate(np.split(h, np.cumsum(counts)[:-1])):
                seen[first + k] = part.tolist()
        for k, t in enumerate(texts):
            words = WORD.findall(t.translate(LOWER))
            assert len(words) == len(seen[k]), (chunk, t)
            for w, h in zip(words, seen[k], strict=True):
                assert names.setdefault(w, h) == h
    assert (
        len(set(names.values())) == len(names)
        and names["b"] == int(shared.one_word_hash(b"b"))
        and names["\x00"] == int(shared.one_word_hash(b"\x00"))
    )


def test_stretches_overlap_and_cover():
    h = np.arange(1000)
    got = list(shared.stretches([(4, 1, h, np.array([1000])), (5, 2, h[:30], np.array([10, 20]))], 300, 50))
    assert [g[0] for g in got] == [4] * 4 + [5] and set(np.concatenate([g[2] for g in got[:4]])) == set(range(1000))
    assert all(b[2][0] == a[2][-50] for a, b in zip(got, got[1:4]))


# -- 3 SimHash


def test_zero_bytes_count_in_fingerprints(spark):
    rows = [(1, "a\x00b \x00 c d e"), (2, "a b c d e"), (3, "\x00"), (4, "\x00 \x00 a A")]
    got = {r["doc_id"]: r["fingerprint"] for r in simhash.near_duplicates(docs(spark, rows)).collect()}
    assert got == {d: f"{brute_fingerprint(t):016x}" for d, t in rows}


def test_keep_one_tells_rows_with_one_id_apart(spark):
    rng = random.Random(2)
    a, b, c, d = (prose(rng, 60) for _ in range(4))
    rows = [(3, a), (8, a), (8, b), (9, c), (9, d), (9, c), (10, c), (11, d), (12, b), (None, a)]
    kept = sorted((r["doc_id"], r["text"]) for r in simhash.keep_one(docs(spark, rows)).collect() if r["doc_id"] is not None)
    # 8's copy of 3 goes, its own text stays; 9's two texts stay once each
    assert kept == sorted([(3, a), (8, b), (9, c), (9, d)])


# -- 1 decontamination


def test_items_are_found_across_stretches_of_a_long_text_and_blocks_of_items(spark, monkeypatch):
    rng = random.Random(8)
    monkeypatch.setattr(decontamination, "_STRETCH", 1 << 10)
    items = [(k, prose(rng, 30, 5000)) for k in range(12)] + [(50, "uno dos tres")]
    words = prose(rng, 6000, 5000).split()
    for n, (_, text) in enumerate(items):
        words[450 * n + 300 : 450 * n + 300] = text.split()
    rows = [(1, " ".join(words)), (1, " ".join(words)), (2, prose(rng, 3000, 5000)), (3, f"\x00 {items[0][1]}")]
    own = [decontamination._hashes([t for _, t in items])]
    vectors = decontamination.word_vectors(docs(spark, rows), fan_in=2)
    build = lambda part: decontamination.Items.build(
        [k for k, _ in part],
        decontamination._hashes([t for _, t in part]),
        [w[-5:] for w in decontamination._hashes([t for _, t in part])],
        vectors,
    )
    whole, halves = [build(items)], [build(items[:6]), build(items[6:])]
    texts = pa.array([t for _, t in rows])
    named = lambda blocks: (
        {(r[0], blocks[r[1]].ids[r[2]]) for r in decontamination.search(texts, blocks, decontamination.Limits())}
    )
    assert len(own[0]) == 13 and named(whole) == named(halves) == {(d, k) for d in (0, 1) for k, _ in items} | {(3, 0)}


def test_matches_equal_brute_force(spark):
    """Every document against every item: the best stretch by longest common subsequence, then the answer."""
    rng = random.Random(9)
    items = [(k, prose(rng, rng.randrange(2, 40), 3000)) for k in range(25)]
    rows = []
    for n in range(120):
        words = prose(rng, rng.randrange(0, 120), 3000).split()
        if n % 3:
            leak = rng.choice(items)[1].split()
            for _ in range(rng.randrange(1 + len(leak) // 4)):
                leak[rng.randrange(len(leak))] = f"w{rng.randrange(3000)}x"
            at = rng.randrange(len(words) + 1)
            words[at:at] = leak
        rows.append((n, " ".join(words)))
    got = {
        (r["doc_id"], r["item_id"])
        for r in decontamination.contaminated(docs(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()
    }
    sure, possible = set(), set()
    for d, text in rows:
        words = text.split()
        for k, item in items:
            own = item.split()
            n = len(own)
            # within the item's length and the part that may differ it has to be found; with windows' margins around it may be
            for reach, into in ((n, sure), (2 * n + 80, possible)):
                for a in range(max(1, len(words) - reach + 1)):
                    region = words[a : a + reach]
                    if decontamination.lcs(own, region) >= 0.7 * n and decontamination.lcs(own[-5:], region) >= 0.6 * len(own[-5:]):
                        into.add((d, k))
                        break
    assert got <= possible and len(sure - got) <= 0.02 * len(sure) and len(sure) > 50


# -- 2 chat


def test_long_conversations_are_numbered_as_a_plain_sort(spark):
    rng = random.Random(14)
    rows = (
        [
            (1, rng.choice([None, *range(-3000, 9000)]), rng.choice(["user", "assistant", None]), rng.choice(["a", "b", None]))
            for _ in range(6000)
        ]
        + [(2, 5, "user", "x")] * 3
    )
    frame = spark.createDataFrame(rows, "pair_id long, turn long, role string, text string")
    got = sorted((r["pair_id"], r["pos"], r["role"], r["text"]) for r in chat._numbered(frame, "pair_id").collect() if r["pair_id"] == 2)
    assert got == [(2, k, "user", "x") for k in range(3)]
    low = lambda x: (x is None, x or "")
    order = sorted((r for r in rows if r[0] == 1), key=lambda r: (r[1] is None, r[1] or 0, low(r[2]), low(r[3])))
    seen = {r["pos"]: (r["role"], r["text"]) for r in chat._numbered(frame, "pair_id").collect() if r["pair_id"] == 1}
    assert [seen[k] for k in range(6000)] == [r[2:] for r in order]


def test_null_turns_stand_last_on_both_sides(spark):
    make = lambda rows: spark.createDataFrame(rows, "pair_id long, turn long, role string, text string")
    out = chat.preference_segments(
        make([(1, None, "user", "n"), (1, 1, "user", "q"), (1, 2, "assistant", "a")]),
        make([(1, 1, "user", "q"), (1, 2, "assistant", "a"), (1, None, "user", "n")]),
    )
    assert [(r["part"], r["role"]) for r in out.orderBy("pos").collect()] == [
        ("prompt", "user"), ("prompt", "assistant"), ("prompt", "user")
    ]


# -- 9 HTML


def test_pages_with_swapped_and_left_out_markup():
    say = lambda k, n=30: " ".join(f"word{k}x{j}" for j in range(n)) + "."
    get = lambda page: html_extract.extract(page).split("\n\n")
    assert get(
        "<html><head><title>T</title><body><p>Hello there, this is a text of some words.</p>"
    ) == ["Hello there, this is a text of some words."]
    assert get(f"<title>T</title><p>{say(1)}</p>") == [say(1)]
    # names that hold a telling word without being one
    page = (
        f"<body><nav><a href=x>a</a></nav><article><div class='article-header'><h1>Title</h1></div><p>{say(1)}</p><div "
        f"class='related-work'><p>{say(2)}</p></div><p class=share-price>{say(3)}</p></article></body>"
    )
    assert get(page) == ["Title", say(1), say(2), say(3)]
    for name in (
        "comments",
        "comment-list",
        "siteFooter",
        "site-header",
        "ad-slot",
        "related-posts",
        "cookie_banner",
        "NavBar",
        "sidebar left",
        "foot",
    ):
        assert get(f"<body><article><h1>Title</h1><p>{say(1)}</p></article><div class='{name}'><p>{say(2)}</p></div></body>") == ["Title", say(1)], name
        assert get(f"<body><article><h1>Title</h1><p>{say(1)}</p><section id='{name}'><p>{say(2)}</p></section></article></body>") == ["Title", say(1)], name
    # comments that are articles, inside the article and after it
    assert get(
        f"<body><article><h1>T</h1><p>{say(1)}</p><article class='comment'><p>{say(2)}</p></article></article></body>"
    ) == ["T", say(1)]
    assert get(
        f"<body><article><h1>T</h1><p>{say(1)}</p></article><article class='comment by-user'><p>{say(2)}</p></article></body>"
    ) == ["T", say(1)]
    # a short paragraph in a container of its own, beside a long one, without an article
    page = (
        "<body><div><a href=a>Home</a> <a href=b>News</a> <a href=c>About us</a></div><div><p>A real opening paragraph of fifty "
        f"characters here.</p></div><div><p>{say(1, 35)}</p></div><div><a href=a>Home</a> <a href=b>News</a></div></body>"
    )
    assert get(page) == ["A real opening paragraph of fifty characters here.", say(1, 35)]


def test_pages_of_a_megabyte_take_seconds_at_most():
    words = " ".join(f"word{k}" for k in range(20))
    pages = [
        "<body><article>" + "<div>" * 20_000 + "x</i>" * 20_000,
        "<body><p><div>" + "<b>" * 20_000 + "y</p>" * 20_000,
        "<body><article>" + f"<p>{words} <b>x</b> &amp; y</p>" * 6500,
        "<div>" * 200_000 + "</p>" * 200_000,
    ]
    for page in pages:
        began = time.time()
        html_extract.extract(page)
        assert time.time() - began < 5


def _kept(lines, articles):
    """Ratios, smoothing, clusters and regions once more, in numpy from the description."""
    own = np.log1p(np.array([len(t) / max(1, n) for t, n, *_ in lines]))
    apart = np.arange(len(own))[:, None] - np.arange(len(own))
    weight = np.where(abs(apart) <= 2, np.exp(-0.5 * apart**2.0), 0)
    smooth = weight @ own / weight.sum(axis=1)

    def cut(v):
        if np.ptp(v) < 1e-9:
            return v.min()
        high = v.max()
        for _ in range(1000):
            high = v[v >= high / 2].mean()
        return high / 2

    least = cut(smooth)
    holder = np.array([x[2] for x in lines])
    sure = (smooth >= least) & (own >= cut(own))
    regions = set(holder[sure if sure.any() else smooth >= least].tolist())
    seeded = {x[3] for x in lines if x[3] and x[2] in regions}
    for h in {x[2] for x in lines if x[3] in seeded}:
        at = np.array([x[2] == h and x[3] in seeded for x in lines])
        size, tags = (sum(f(x) for x, y in zip(lines, at, strict=True) if y) for f in (lambda x: len(x[0]), lambda x: x[1]))
        if smooth[at].mean() >= math.log1p(0.5 * math.expm1(least)) or size >= 40 * max(1, tags) or h in articles:
            regions.add(h)
    return [k for k, x in enumerate(lines) if x[2] in regions or x[4] and x[3] in seeded]


def test_clusters_equal_a_plain_computation():
    rng, dropped = random.Random(15), 0
    for n in range(300):
        say = lambda: " ".join(f"w{rng.randrange(99)}" for _ in range(rng.choice([1, 2, 8, 40, 120])))  # noqa: B023, E731
        page = "<body>"
        for _ in range(rng.randrange(1, 12)):
            tag = rng.choice(["div", "section", "article", "main", "div"])
            page += (
                f"<{tag}>"
                + "".join(
                    rng.choice(
                        [f"<p>{say()}</p>", f"<p><a href=x>{say()}</a> <b>{say()}</b></p>", f"<h1>{say()}</h1>", f"<div>{say()}</div>"]
                    )
                    for _ in range(rng.randrange(6))
                )
                + (f"</{tag}>" if rng.random() < 0.9 else "")
            )
        parser = html_extract._Lines()
        parser.feed(page)
        parser.close()
        got = html_extract.content(parser.lines, parser.articles)
        assert got == (_kept(parser.lines, parser.articles) if parser.lines else [])
        dropped += len(got) < len(parser.lines)
    assert 30 < dropped < 290


# -- 8 mixing


def test_shards_come_from_the_tree(spark):
    """Draws of each source in each shard are the tree's, and what a document gives is the sum over the shards' rows; targets once more by bisection."""
    rng = random.Random(21)
    rows = (
        [(k, prose(rng, rng.randrange(1, 120)), rng.choice(["a", "a", "a", "b", None])) for k in range(200)]
        + [(500, None, "a"), (501, "q\x00r s", "a"), (502, prose(rng, 200_000), "b")]
    )
    mixed = mixing.mix(docs(spark, rows), shards=8, bucket_rows=16)
    pieces = [r.asDict() for r in mixing.shard_rows(mixed).collect()]
    source = {r[0]: r[2] for r in rows}
    size = Counter()
    for d, t, s in rows:
        size[s] += len(WORD.findall(t or ""))
    names = sorted(size, key=lambda s: (s is None, s or ""))
    sizes = spark.createDataFrame([(n, size[n]) for n in names], "source string, n long")
    plans = sorted(mixing.source_plans(sizes).collect(), key=lambda p: p.place)  # each stands alone
    assert [p.s for p in plans] == names and [p.line - mixing.LINES for p in plans] == list(range(len(names)))
    tree = mixing.split_tree([p.passes * p.blocks + p.extra for p in plans], 8)
    words = Counter((r["shard"], source[r["doc_id"]]) for r in pieces for _ in range(r["words"]))
    for k, p in enumerate(plans):
        assert p.block == max(1, -(-p.source_size // mixing.MOST_BLOCKS))
        for shard in range(8):
            # blocks are whole but for the last one of a source
            assert 0 <= tree[shard][k] * p.block - words[shard, p.s] <= 2 * p.block
    out = {r["doc_id"]: r for r in mixing.by_document(mixed).collect()}
    taken = Counter()
    for r in pieces:
        taken[r["doc_id"]] += r["words"]
    for d, r in out.items():
        own = sorted({x["shard"] for x in pieces if x["doc_id"] == d})
        assert r["taken"] == taken[d] and r["shards"] == (",".join(map(str, own)) if own else None)
        assert r["first_rank"] == min(((x["shard"], x["rank"]) for x in pieces if x["doc_id"] == d), default=(0, None))[1]
    order = [(r["shard"], r["rank"]) for r in pieces]
    assert order == sorted(order)
    # the level c of all sources at which min(2 size, weight c) adds up to the whole
    weight = {n: (5, 2, 1)[k % 3] for k, n in enumerate(names)}
    low, high = 0.0, 2.0 * sum(size.values())
    for _ in range(200):
        c = (low + high) / 2
        low, high = (c, high) if sum(min(2 * size[n], weight[n] * c) for n in names) < 1.5 * sum(size.values()) else (low, c)
    assert all(out[d]["target"] == pytest.approx(min(2 * size[s], weight[s] * c), rel=1e-6) for d, _, s in rows)


# -- 7 quality rules


def brute_list(rows, features, cuts, held, max_conditions=3, precision=0.95, least=5):
    """Sequential covering once more, over rows in memory: rows (values, bad), cuts as the operator found them."""
    def met(rule, x):
        return all(x[features.index(f)] >= t if above else x[features.index(f)] < t for f, above, t in rule)

    left, rules = list(zip(rows, held)), []
    while True:
        rule = []
        while len(rule) < max_conditions:
            own = [(x, bad) for (x, bad), h in left if not h and met(rule, x)]
            p0, n0 = sum(b for _, b in own), sum(not b for _, b in own)
            if not p0 or not n0:
                break
            best = (0.0, None)
            for i, f in enumerate(features):
                for t in cuts[f]:
                    for above in (False, True):
                        inside = [b for x, b in own if (x[i] >= t) == above]
                        p, n = sum(inside), len(inside) - sum(inside)
                        if p and n < n0:
                            gain = p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0)))
                            if gain > best[0] + 1e-9:
                                best = (gain, (f, above, t))
            if best[1] is None:
                break
            rule.append(best[1])
        if not rule:
            return rules

        def counts(k, only_held):
            found = [b for (x, b), h in left if (h or not only_held) and met(rule[: k + 1], x)]
            return sum(found), len(found) - sum(found)

        worth = [(p - n) / max(1, p + n) for p, n in (counts(k, True) for k in range(len(rule)))]
        k = max(range(len(rule)), key=lambda k: (worth[k], -k))
        (p, n), (hp, hn) = counts(k, False), counts(k, True)
        if p < least or hp < precision * (hp + hn) or p < precision * (p + n):
            return rules
        rules.append(tuple(rule[: k + 1]))
        left = [(r, h) for r, h in left if not met(rule[: k + 1], r[0])]


def test_decision_list_equals_covering_in_memory(spark):
    from pyspark.sql import functions as F

    rng = random.Random(33)
    features = ("f", "g")
    rows = []
    for _ in range(500):
        f, g = rng.randrange(12), rng.randrange(9)
        rows.append(((float(f), float(g)), (f >= 9 or f < 3 and g >= 6) != (rng.random() < 0.01)))
    frame = spark.createDataFrame([(k, *x, bad) for k, (x, bad) in enumerate(rows)], "id long, f double, g double, bad boolean")
    held = [r["h"] for r in frame.orderBy("id").select((F.pmod(F.xxhash64("id", F.lit("prune")), F.lit(3)) == 0).alias("h")).collect()]
    cuts = {f: sorted({x[k] for x, _ in rows}) for k, f in enumerate(features)}  # few values, so the quantiles are all of them
    got = [tuple((c.feature, c.above, c.threshold) for c in rule) for rule in quality_rules.learn(frame, features).rules]
    want = brute_list(rows, features, cuts, held)
    assert want and got == want


# -- 10 LM


def test_scores_add_up_to_one_over_the_vocabulary():
    """Interpolated probabilities over all known words, the end and one unknown word, from true counts: at most one, and one where the context is known."""
    rng = random.Random(4)
    text = [[rng.choice("abcdef") for _ in range(30)] + [None] for _ in range(20)]
    one = Counter(w for t in text for w in t)
    two = Counter(x for t in text for x in zip([None, *t], t, strict=False))
    n, v = sum(one.values()), len(one)
    for context in one:
        known = sum(0.3 * two[context, w] / one[context] + 0.7 * (one[w] + 0.5) / (n + 0.5 * (v + 1)) for w in one)
        assert known + 0.7 * 0.5 / (n + 0.5 * (v + 1)) == pytest.approx(1)


def test_zero_bytes_and_long_texts_are_scored(spark):
    rng = random.Random(41)
    rows = [(1, "a\x00b \x00 c"), (2, prose(rng, 400_000)), (3, None), (3, None), (4, "\x00")]
    got = {r["doc_id"]: r["n_tokens"] for r in lm_score.lm_scores(docs(spark, rows)).collect()}
    assert got == {1: 4, 2: 400_001, 3: 1, 4: 2}


def test_components_of_a_hub_and_a_chain(spark):
    links = [(k, 0) for k in range(1, 400)] + [(1000 + k, 1001 + k) for k in range(60)] + [(5, 5)]
    got = {r["node"]: r["root"] for r in components.connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(400)}, **{1000 + k: 1000 for k in range(61)}}
