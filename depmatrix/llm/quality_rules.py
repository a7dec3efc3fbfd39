"""Quality rules: text statistics and a learned decision list, in DataFrame functions only.

Sequential covering: a rule is a conjunction of thresholds, grown on two thirds of the labelled rows by information gain,
pruned on the rest, accepted while it is precise there; rows that it covers leave, and the next rule is learned. All labelled
rows count; only tables of (statistic, bin) counts reach the driver. The list is emitted as an ordered CASE expression.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depmatrix.llm.shared import written

SPACE = r"[\x20\x09-\x0D]+"
#: What the rules look at; each is a number for any text, also an empty one.
FEATURES = ("n_words", "word_length", "symbol_ratio", "upper_ratio", "dup_line_ratio", "repeat_ratio", "distinct_ratio", "mark_ratio")
_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _let(value: Column, body) -> Column:
    """body(value) with value computed once, also where body uses it in inner functions."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text.cast("string"), F.lit("")), SPACE), "")


def _window_hashes(words: Column, width: int) -> Column:
    hashed = F.transform(words, lambda w: F.xxhash64(w))
    return _let(
        hashed,
        lambda h: F.when(
            F.size(h) >= width,
            F.transform(F.sequence(F.lit(0), F.size(h) - width), lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(width)))),
        ).otherwise(F.array().cast("array<bigint>")),
    )


def _covered(windows: Column, width: int) -> Column:
    """Words in windows that occur twice or more."""
    placed = F.sort_array(F.transform(windows, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    again = _let(
        placed,
        lambda s: F.filter(
            s,
            lambda e, k: F.coalesce(F.get(s, k - 1)["h"] == e["h"], F.lit(False)) | F.coalesce(
                F.get(s, k + 1)["h"] == e["h"], F.lit(False)
            ),
        ),
    )
    starts = F.sort_array(F.transform(again, lambda e: e["i"]))
    start = F.struct(F.lit(0).alias("c"), F.lit(-width).alias("last"))
    return F.aggregate(
        starts, start, lambda a, p: F.struct((a["c"] + F.least(F.lit(width), p - a["last"])).alias("c"), p.alias("last")), lambda a: a["c"]
    )


def with_statistics(docs: DataFrame, text_col: str = "text", prefix: str = "_q_", width: int = 5) -> DataFrame:
    """docs with one column more, `{prefix}stats`: a struct of the counts and FEATURES. Null text counts as empty. No shuffle."""
    w, x, n, u = (f"{prefix}{k}" for k in ("words", "windows", "lines", "text"))
    df = docs.withColumn(u, F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    df = df.withColumn(w, words_of(F.col(u))).withColumn(
        n, F.filter(F.split(F.col(u), "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    )
    df = df.withColumn(x, _window_hashes(F.col(w), width))
    long = lambda c: c.cast("long")
    counts = {
        "n_words": F.size(w),
        "word_chars": F.char_length(F.array_join(w, "")),
        "n_symbols": F.regexp_count(u, F.lit("[#*$%&|<>]")),
        "n_dup_lines": F.size(n) - F.size(F.array_distinct(n)),
        "n_repeat_words": F.when(F.size(F.array_distinct(x)) < F.size(x), _covered(F.col(x), width)).otherwise(0),
        "n_lines": F.size(n),
        "n_distinct": F.size(F.array_distinct(w)),
        "n_upper": F.regexp_count(u, F.lit("[A-Z]")),
        "n_marks": F.regexp_count(u, F.lit("[!?|]")),
    }
    df = df.withColumn(f"{prefix}counts", F.struct(*(long(c).alias(k) for k, c in counts.items())))
    c = F.col(f"{prefix}counts")
    share = lambda a, b: F.coalesce(c[a].cast("double") / F.nullif(c[b], F.lit(0).cast("long")), F.lit(0.0))
    ratios = {
        "word_length": ("word_chars", "n_words"),
        "symbol_ratio": ("n_symbols", "n_words"),
        "upper_ratio": ("n_upper", "word_chars"),
        "dup_line_ratio": ("n_dup_lines", "n_lines"),
        "repeat_ratio": ("n_repeat_words", "n_words"),
        "distinct_ratio": ("n_distinct", "n_words"),
        "mark_ratio": ("n_marks", "n_words"),
    }
    stats = F.struct(*(c[k].alias(k) for k in _COUNTS), *(share(*v).alias(k) for k, v in ratios.items()))
    return df.withColumn(f"{prefix}stats", stats).drop(w, x, n, u, f"{prefix}counts")


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool  # feature >= threshold, else feature < threshold
    threshold: float

    def column(self, of) -> Column:
        return of(self.feature).cast("double") >= self.threshold if self.above else of(self.feature).cast("double") < self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.above else '<'} {self.threshold:.6g}"


@dataclass(frozen=True)
class DecisionList:
    """Rules in order; a row that meets one is rejected, a row that meets none is kept."""

    rules: tuple[tuple[Condition, ...], ...]

    def keeps(self, of) -> Column:
        """The ordered CASE expression; of(name) gives a statistic's column."""
        out = None
        for rule in self.rules:
            met = F.lit(True)
            for c in rule:
                met = met & c.column(of)
            out = F.when(met, F.lit(False)) if out is None else out.when(met, F.lit(False))
        return F.lit(True) if out is None else out.otherwise(F.lit(True))

    def __str__(self) -> str:
        return "\n".join("reject if " + " and ".join(map(str, r)) for r in self.rules) or "keep all"


def learn(
    rows: DataFrame,
    features: tuple[str, ...] = FEATURES,
    bins: int = 32,
    max_rules: int | None = None,
    max_conditions: int = 3,
    precision: float = 0.95,
    least: int = 5,
) -> DecisionList:
    """A decision list from rows (id, features..., bad boolean). No rows, or none bad: an empty list.

    precision: what a rule needs on the rows that it wasn't grown on. least: bad rows that it must cover.
    Covers until no rule is good enough; each takes at least `least` bad rows away, so that ends. max_rules: an error if more would be learned."""
    total = rows.agg(F.count("*"), F.count_if("bad")).first()
    if not total[1] or total[0] == total[1]:
        return DecisionList(())
    marks = [i / bins for i in range(bins + 1)]  # with both ends, so that a rule can take in all of a class
    spread = rows.agg(
        *(
            F.percentile_approx(F.when(F.col("bad") == b, F.col(f).cast("double")), marks, 10_000).alias(f"{f}_{b}")
            for f in features
            for b in (True, False)
        )
    ).first()
    cuts = {f: sorted({x for b in (True, False) for x in (spread[f"{f}_{b}"] or [])}) for f in features}
    place = lambda f: sum((F.col(f).cast("double") >= t).cast("int") for t in cuts[f]) if cuts[f] else F.lit(0)
    binned = written(
        rows.select(
            "bad",
            (F.pmod(F.xxhash64("id", F.lit("prune")), F.lit(3)) == 0).alias("held"),
            F.array(*(place(f) for f in features)).alias("at"),
        )
    )

    def met(rule) -> Column:
        out = F.lit(True)
        for f, above, k in rule:
            at = F.get("at", F.lit(features.index(f)))
            out = out & (at >= k if above else at < k)
        return out

    def grow(left: DataFrame) -> list[tuple[str, bool, int]]:
        rule: list[tuple[str, bool, int]] = []
        while len(rule) < max_conditions:
            seen = (
                left.filter(~F.col("held"))
                .filter(met(rule))
                .select("bad", F.posexplode("at").alias("f", "k"))
                .groupBy("f", "k")
                .agg(F.count_if("bad").alias("p"), F.count_if(~F.col("bad")).alias("n"))
                .collect()
            )
            p0, n0 = (sum(r[c] for r in seen if r["f"] == 0) for c in ("p", "n"))
            if not p0 or not n0:
                break
            best = (0.0, None)
            for i, f in enumerate(features):
                by = {r["k"]: (r["p"], r["n"]) for r in seen if r["f"] == i}
                low_p = low_n = 0
                for k in range(1, len(cuts[f]) + 1):
                    low_p, low_n = low_p + by.get(k - 1, (0, 0))[0], low_n + by.get(k - 1, (0, 0))[1]
                    for above, p, n in ((False, low_p, low_n), (True, p0 - low_p, n0 - low_n)):
                        if p and n < n0:
                            gain = p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0)))
                            if gain > best[0] + 1e-9:
                                best = (gain, (f, above, k))
            if best[1] is None:
                break
            rule.append(best[1])
        return rule

    left, rules = binned, []
    while True:
        rule = grow(left)
        if not rule:
            break
        heads = [rule[: k + 1] for k in range(len(rule))]
        got = left.agg(
            *(
                F.count_if(met(h) & (F.col("bad") == b) & (F.col("held") if held else F.lit(True))).alias(f"{k}_{b}_{held}")
                for k, h in enumerate(heads)
                for b in (True, False)
                for held in (True, False)
            )
        ).first()
        worth = lambda k: (
            (got[f"{k}_True_True"] - got[f"{k}_False_True"]) / max(1, got[f"{k}_True_True"] + got[f"{k}_False_True"])
        )
        k = max(range(len(heads)), key=lambda k: (worth(k), -k))
        enough = lambda held: got[f"{k}_True_{held}"] >= precision * (got[f"{k}_True_{held}"] + got[f"{k}_False_{held}"])
        if got[f"{k}_True_False"] < least or not enough(True) or not enough(False):
            break
        if max_rules is not None and len(rules) >= max_rules:
            raise ValueError(f"more than {max_rules} rules are good enough")
        rules.append(heads[k])
        left = left.filter(~met(heads[k]))
    return DecisionList(tuple(tuple(Condition(f, above, cuts[f][i - 1]) for f, above, i in r) for r in rules))


def learn_from_labels(stats: DataFrame, labels: DataFrame, **options) -> DecisionList:
    """stats: (doc_id, stats struct); labels: (doc_id, quality). A document labelled more than once counts as bad if any label is 0; null labels don't count."""
    bad = labels.filter("quality is not null").groupBy("doc_id").agg((F.min("quality") == 0).alias("bad"))
    rows = stats.join(bad, "doc_id").select(F.col("doc_id").alias("id"), "bad", *(F.col(f"stats.{f}").alias(f) for f in FEATURES))
    return learn(written(rows), **options)


def base_failed(of) -> Column:
    return (of("n_words") < 10) | (100 * of("n_repeat_words") > 20 * of("n_words"))


def judge(docs: DataFrame, labels: DataFrame, **options) -> tuple[DataFrame, DecisionList]:
    """((doc_id, stats, base_failed, kept) per row of docs, the list learned). Null or empty text has no words, so fails the base rule;
    rows with a null doc_id are judged but don't teach; repeated rows are judged alike; extra columns are not looked at."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    stats = written(with_statistics(own).select("doc_id", F.col("_q_stats").alias("stats")))
    rules = learn_from_labels(stats, labels, **options)
    of = lambda f: F.col(f"stats.{f}")
    return stats.select("doc_id", "stats", base_failed(of).alias("base_failed"), (~base_failed(of) & rules.keeps(of)).alias("kept")), rules


def keep_good(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of docs, columns as they are, that pass the base rule and the list learned from the labels of these rows.

    Null or empty text has no words and goes; very long texts are counted whole; repeated rows are judged alike; rows with a null doc_id are judged but don't
    teach. No labels or none bad: only the base rule counts. Empty table: no rows. The documents are written once with their statistics, which are then learned from and filtered by."""
    stated = written(with_statistics(docs))
    rules = learn_from_labels(
        stated.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("_q_stats").alias("stats")), labels, **options
    )
    of = lambda f: F.col("_q_stats")[f]
    return stated.filter(~base_failed(of) & rules.keeps(of)).select(*(F.col(f"`{c}`") for c in docs.columns))
