"""Quality classifier: hierarchical empirical Bayes over a document classifier and the sites that documents come from.

A logistic regression on counts of the text's bytes, words and lines gives each document's evidence. Sites are levels, host and path within it: each holds
good and all documents, a labelled document by its label, any other by its evidence at a lower weight. Rates of hosts are shrunk towards the
global rate, those of paths towards their host, with strengths estimated from how much the rates vary beyond chance (method of moments). The
document's odds are moved by the path's odds against the global ones. Sites are summed by grouped aggregation over all documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from depmatrix.llm.shared import Bytes, byte_table, split_join, string_parts, word_hashes, written

_MARKS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_LINES = byte_table("line", lower=False)
_WORDS = byte_table(lower=False)
N_FEATURES = 7 + len(_MARKS) + 4


def _distinct(offsets: np.ndarray, data: np.ndarray, table: Bytes) -> tuple[np.ndarray, np.ndarray]:
    """(pieces, distinct pieces) of each text."""
    n = len(offsets) - 1
    many, kinds = np.zeros(n), np.zeros(n)
    for first, docs, h, counts in word_hashes(offsets, data, table):
        many[first : first + docs] = counts
        if docs == 1:
            kinds[first] = len(np.unique(h))
            continue
        doc = np.repeat(np.arange(docs), counts)
        order = np.lexsort((h, doc))
        h, doc = h[order], doc[order]
        new = np.r_[True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])] if len(h) else np.zeros(0, bool)
        kinds[first : first + docs] = np.bincount(doc[new], minlength=docs)
    return many, kinds


def features(texts: pa.Array) -> np.ndarray:
    """Rows of N_FEATURES numbers, each finite for any text; null counts as empty."""
    offsets, data = string_parts(texts)
    n = len(offsets) - 1
    seen = np.zeros((n, 256))
    for i in range(n):
        if offsets[i + 1] > offsets[i]:
            seen[i] = np.bincount(data[offsets[i] : offsets[i + 1]], minlength=256)
    words, kinds = _distinct(offsets, data, _WORDS)
    lines, line_kinds = _distinct(offsets, data, _LINES)
    size, each = np.maximum(seen.sum(axis=1), 1), np.maximum(words, 1)
    share = lambda a, b: seen[:, a:b].sum(axis=1) / size
    columns = [np.log1p(words), size / each / 10, share(65, 91), share(48, 58), share(128, 256), share(0, 32), share(97, 123)]
    columns += [np.minimum(1, seen[:, m] / each) for m in _MARKS]
    columns += [kinds / each, 1 - line_kinds / np.maximum(lines, 1), np.log1p(lines), words < 10]
    return np.column_stack(columns).astype(np.float64)


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 40) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(weights with the constant last, mean, scale) by Newton steps. No rows or one class: the constant alone, from a smoothed rate."""
    rate = (y.sum() + 1) / (len(y) + 2)
    if len(y) == 0 or y.min() == y.max():
        return np.r_[np.zeros(N_FEATURES), np.log(rate / (1 - rate))], np.zeros(N_FEATURES), np.ones(N_FEATURES)
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale = np.where(scale > 1e-9, scale, 1)
    z = np.column_stack([np.clip((x - mean) / scale, -8, 8), np.ones(len(x))])
    w, penalty = np.zeros(z.shape[1]), np.r_[np.full(z.shape[1] - 1, ridge), 1e-6]
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p) + 1e-9)[:, None]).T @ z + np.diag(penalty), z.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w, mean, scale


def predictor(w: np.ndarray, mean: np.ndarray, scale: np.ndarray):
    """A column function: the probability that a text is good."""

    @arrow_udf("double")
    def p_doc(texts: pa.Array) -> pa.Array:
        z = np.clip((features(texts) - mean) / scale, -8, 8) @ w[:-1] + w[-1]
        return pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))), pa.float64())

    return p_doc


def labelled(labels: DataFrame) -> DataFrame:
    """(doc_id, good 0/1): a document labelled more than once is good only if all labels say so; null labels don't count."""
    return labels.filter("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").cast("int").alias("good"))


def train(docs: DataFrame, labels: DataFrame, max_train: int = 20_000):
    """Fits on at most max_train labelled documents, those with the least hash of their id, so that all count as long as they are fewer.

    The choice is made among the labels, so the table that meets the texts has at most max_train rows and the texts aren't shuffled."""
    chosen = labelled(labels).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    rows = docs.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "good")

    @arrow_udf("array<double>")
    def listed(texts: pa.Array) -> pa.Array:
        return pa.array(list(features(texts)), pa.list_(pa.float64()))

    got = rows.select("good", listed("text").alias("x")).toArrow()  # a repeated document counts each time
    x = np.array(got.column("x").to_pylist(), np.float64).reshape(-1, N_FEATURES)
    return fit_logistic(x, got.column("good").to_numpy().astype(np.float64))


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def _strength(sites: DataFrame, mean: str, floor: float = 1.0, ceiling: float = 1e4) -> float:
    """Pseudo-documents of the prior: mean (1 - mean) over the variance of the rates beyond chance, minus 1."""
    m, n = F.col(mean), F.col("n")
    got = sites.filter("n > 0").agg(
        F.sum(n), F.sum(n * F.pow(F.col("k") / n - m, F.lit(2))), F.sum(m * (1 - m)), F.sum(n * m * (1 - m))
    ).first()
    if not got[0]:
        return ceiling
    beyond = (got[1] - got[2]) / got[0]  # a site's rate varies by m (1 - m) / n by chance
    spread = got[3] / got[0]
    return ceiling if beyond <= 0 else float(min(ceiling, max(floor, spread / beyond - 1)))


def site_posteriors(evidence: DataFrame, unlabelled: float = 0.25) -> tuple[DataFrame, float]:
    """((host, path, host_posterior, path_posterior, rows), global rate) from rows (host, path, good or null, p_doc); the first is a written table."""
    n = F.when(F.col("good").isNotNull(), 1.0).otherwise(unlabelled)
    paths = written(
        evidence.groupBy("host", "path").agg(
            F.sum(n).alias("n"), F.sum(n * F.coalesce(F.col("good").cast("double"), F.col("p_doc"))).alias("k"), F.count("*").alias("rows")
        )
    )
    total = paths.agg(F.sum("n"), F.sum("k")).first()
    rate = min(0.999, max(0.001, ((total[1] or 0) + 1) / ((total[0] or 0) + 2)))
    hosts = paths.groupBy("host").agg(
        F.sum("n").alias("n"), F.sum("k").alias("k"), F.count("*").alias("paths")
    ).withColumn("m", F.lit(rate))
    m = _strength(hosts, "m")
    hosts = written(hosts.select(F.col("host").alias("h"), ((F.col("k") + m * rate) / (F.col("n") + m)).alias("host_posterior"), "paths"))
    nested = written(split_join(paths, hosts, [("host", "h")], "paths"))  # a host may have most of the paths
    m = _strength(nested, "host_posterior")
    return (
        written(
            nested.select(
                "host",
                "path",
                "host_posterior",
                ((F.col("k") + m * F.col("host_posterior")) / (F.col("n") + m)).alias("path_posterior"),
                "rows",
            )
        ),
        rate,
    )


def classify(
    docs: DataFrame, labels: DataFrame, host_col: str = "source", path_col: str = "lang", max_train: int = 20_000, least: float = 0.5
) -> DataFrame:
    """docs' columns host, path and doc_id per row, with p_doc, host_posterior, path_posterior, p_quality and kept (p_quality >= least).

    Null or empty text is judged as an empty one; null host or path is a site of its own; rows with a null doc_id have no label; repeated rows count each;
    no labels: the evidence is a constant. Empty table: no rows. Extra columns are not looked at. Each text is judged once, and only its evidence goes on."""
    own = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col(host_col).cast("string").alias("host"),
        F.col(path_col).cast("string").alias("path"),
        F.col("text").cast("string").alias("text"),
    )
    p_doc = predictor(*train(own, labels, max_train))
    scored = written(own.select("doc_id", "host", "path", p_doc("text").alias("p_doc")))
    sites, rate = _sites(scored, labels)
    joined = split_join(scored, sites.withColumnsRenamed({"host": "_h", "path": "_p"}), [("host", "_h"), ("path", "_p")], "rows")
    moved = _combined(F.col("p_doc"), F.col("path_posterior"), rate)
    return joined.select(
        "doc_id", "host", "path", "p_doc", "host_posterior", "path_posterior", moved.alias("p_quality"), (moved >= least).alias("kept")
    )


def _combined(p_doc: Column, path: Column, rate: float) -> Column:
    inside = lambda p: F.least(F.lit(1 - 1e-6), F.greatest(F.lit(1e-6), p))
    return 1 / (1 + F.exp(-(_logit(inside(p_doc)) + _logit(inside(path)) - _logit(F.lit(rate)))))


def _sites(scored: DataFrame, labels: DataFrame) -> tuple[DataFrame, float]:
    return site_posteriors(scored.join(labelled(labels), "doc_id", "left").select("host", "path", "good", "p_doc"))


def keep_good(
    docs: DataFrame, labels: DataFrame, host_col: str = "source", path_col: str = "lang", max_train: int = 20_000, least: float = 0.5
) -> DataFrame:
    """The rows of docs, columns as they are, with p_quality >= least, which classify() gives.

    Null and empty texts, null hosts, paths and ids, repeated rows, missing labels and empty tables as there. The documents are written once with their evidence.
    Sites are joined to them by broadcast up to a fixed number, beyond that the frequent ones are, so no site is one task."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    p_doc = predictor(*train(own, labels, max_train))
    scored = written(docs.withColumn("_c_p", p_doc(F.col("text").cast("string"))))
    site = {"_c_host": F.col(host_col).cast("string"), "_c_path": F.col(path_col).cast("string")}
    sites, rate = _sites(
        scored.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            site["_c_host"].alias("host"),
            site["_c_path"].alias("path"),
            F.col("_c_p").alias("p_doc"),
        ),
        labels,
    )
    joined = split_join(
        scored.withColumns(site),
        sites.toDF("_c_h", "_c_q", "_c_site", "_c_post", "_c_rows"),
        [("_c_host", "_c_h"), ("_c_path", "_c_q")],
        "_c_rows",
    )
    return joined.filter(_combined(F.col("_c_p"), F.col("_c_post"), rate) >= least).select(*(F.col(f"`{c}`") for c in docs.columns))


def site_columns(url: Column) -> tuple[Column, Column]:
    """(host, first part of the path) of a URL column, for tables that have URLs."""
    return (
        F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]+)", 1)),
        F.regexp_extract(url, r"^[^/]*//[^/?#]+/([^/?#]*)", 1),
    )
