"""One query for each training-data operator, over its whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from depmatrix.llm import (
    chat,
    decontamination,
    html_extract,
    importance,
    license_scan,
    lm_score,
    mixing,
    periodic_runs,
    quality_classifier,
    quality_rules,
    simhash,
    token_output,
    warc,
)
from depmatrix.llm.shared import lowered


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op2_preference_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.preference_segments(*chat.pairs_from_conversations(_table(spark, sf_dir, "conversations")))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(_table(spark, sf_dir, "documents")).drop("spans")


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged, _ = quality_rules.judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return judged.select(
        "doc_id", *(f"stats.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), "base_failed", "kept"
    )


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.by_document(mixing.mix(_table(spark, sf_dir, "documents")))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(_table(spark, sf_dir, "pages"))


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.lm_scores(_table(spark, sf_dir, "documents"))


def op11_token_output(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    """tokenizer: path of a tokenizer's file; that of the public byte-level vocabulary where none is given."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    return token_output.read_documents(token_output.token_files(_table(spark, sf_dir, "documents"), tokenizer))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.periodic_runs(_table(spark, sf_dir, "documents"), plant=True).drop("runs")


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def base_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5's columns that don't depend on the method."""
    return op5_license_scan(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def base_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7's columns that don't depend on the learned list."""
    return op7_quality_rules(spark, sf_dir).drop("kept")


def base_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8's sizes, and its targets to six digits."""
    return op8_mixing(spark, sf_dir).select("doc_id", "size", "source_size", F.round("target", 6).alias("target"))


def base_mixing_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the words that op8 takes of each source come within a thousandth (and one word) of its target, and no document is taken more than twice."""
    by = op8_mixing(spark, sf_dir).groupBy("source")
    near = F.abs(F.sum("taken") - F.max("target")) <= 1 + 0.001 * F.max("target")
    return by.agg(
        F.count("*").alias("documents"), near.alias("near_target"), F.bool_and(F.col("taken") <= 2 * F.col("size")).alias("twice_at_most")
    )


def base_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10's columns that don't depend on the method, the score to six digits."""
    return op10_lm_scoring(spark, sf_dir).drop("score").withColumn("base_score", F.round("base_score", 6))


def _spaced(text: Column, lower) -> Column:
    """Words with one space between them."""
    return F.trim(F.regexp_replace(lower(F.coalesce(text.cast("string"), F.lit(""))), r"[\x20\x09-\x0D]+", " "))


def copies_in_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that occur more than once, but for case and white space, and whether op3 gives all copies one fingerprint and one component."""
    texts = _table(spark, sf_dir, "documents").select("doc_id", F.sha2(_spaced(F.col("text"), lowered), 256).alias("copy_of"))
    together = (F.count_distinct("fingerprint") == 1) & (F.count_distinct("component_id") == 1) & (F.max("component_id") <= F.min("doc_id"))
    by = texts.join(op3_simhash(spark, sf_dir), "doc_id").groupBy("copy_of")
    return by.agg(
        F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"), together.alias("together")
    ).filter("copies > 1").drop("copy_of")


def items_contained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1's pairs of which the document holds the item's words side by side, in any case."""
    padded = lambda c: F.concat(F.lit(" "), _spaced(c, F.lower), F.lit(" "))
    pairs = op1_decontamination(spark, sf_dir).select("doc_id", "item_id")
    texts = _table(spark, sf_dir, "documents").select("doc_id", padded(F.col("text")).alias("text"))
    items = _table(spark, sf_dir, "benchmark").select("item_id", padded(F.col("text")).alias("item"))
    return pairs.join(items, "item_id").join(texts, "doc_id").filter(F.contains("text", "item")).select("doc_id", "item_id").distinct()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (
        op1_decontamination,
        op2_preference_chat,
        op3_simhash,
        op4_warc,
        op5_license_scan,
        op6_quality_classifier,
        op7_quality_rules,
        op8_mixing,
        op9_html_extraction,
        op10_lm_scoring,
        op11_token_output,
        op12_periodic_runs,
        op13_importance_resampling,
    )
    return {
        f.__name__: f
        for f
        in (
            *ops,
            base_license_scan,
            base_quality_rules,
            base_mixing,
            base_mixing_by_source,
            base_lm_scoring,
            copies_in_components,
            items_contained,
        )
    }


OP2_SQL = """
WITH c AS (SELECT conv_id AS pair_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL),
last AS (SELECT pair_id, max(CASE WHEN role = 'assistant' THEN turn END) AS reply_turn, max(turn) AS final FROM c GROUP BY pair_id),
reply AS (SELECT c.pair_id, max(c.text) AS text FROM c JOIN last l ON c.pair_id = l.pair_id AND c.turn = l.reply_turn AND c.role = 'assistant' GROUP BY c.pair_id),
cut AS (SELECT pair_id, coalesce(reply_turn, final + 1) AS cut FROM last),
rejected AS (
  SELECT c.pair_id, c.turn, c.role, c.text FROM c JOIN cut ON c.pair_id = cut.pair_id WHERE c.turn < cut.cut
  UNION ALL
  SELECT cut.pair_id, cut.cut, 'assistant', r.text FROM cut JOIN reply r ON r.pair_id = xor(cut.pair_id, 1)),
a AS (SELECT pair_id, role, text, row_number() OVER (PARTITION BY pair_id ORDER BY turn, role, text) - 1 AS pos FROM c),
b AS (SELECT pair_id, role, text, row_number() OVER (PARTITION BY pair_id ORDER BY turn, role, text) - 1 AS pos FROM rejected),
both_ AS (SELECT coalesce(a.pair_id, b.pair_id) AS pair_id, coalesce(a.pos, b.pos) AS pos, a.pair_id IS NOT NULL AS has_a, b.pair_id IS NOT NULL AS has_b,
  a.role AS ar, a.text AS at_, b.role AS br, b.text AS bt FROM a FULL OUTER JOIN b ON a.pair_id = b.pair_id AND a.pos = b.pos),
ends AS (SELECT pair_id, coalesce(min(CASE WHEN NOT (has_a AND has_b AND ar IS NOT DISTINCT FROM br AND at_ IS NOT DISTINCT FROM bt) THEN pos END), max(pos) + 1) AS prompt_turns FROM both_ GROUP BY pair_id),
seg AS (
  SELECT pair_id, 'prompt' AS part, pos, ar AS role, at_ AS text, prompt_turns FROM both_ JOIN ends USING (pair_id) WHERE pos < prompt_turns
  UNION ALL SELECT pair_id, 'chosen', pos, ar, at_, prompt_turns FROM both_ JOIN ends USING (pair_id) WHERE pos >= prompt_turns AND has_a
  UNION ALL SELECT pair_id, 'rejected', pos, br, bt, prompt_turns FROM both_ JOIN ends USING (pair_id) WHERE pos >= prompt_turns AND has_b)
SELECT pair_id, part, CAST(pos AS INTEGER) AS pos, role, '<|' || coalesce(role, '') || '|>' || chr(10) || coalesce(text, '') || '<|end|>' || chr(10) AS rendered,
  CAST(part <> 'prompt' AND coalesce(role = 'assistant', false) AS INTEGER) AS train, CAST(prompt_turns AS INTEGER) AS prompt_turns FROM seg
"""

OP4_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) AS least_id FROM d WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT d.page_id, d.payload_bytes, d.payload_digest, CASE WHEN f.least_id IS NOT NULL AND d.page_id IS DISTINCT FROM f.least_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN f.least_id IS NOT NULL AND d.page_id IS DISTINCT FROM f.least_id THEN f.least_id END AS refers_to
FROM d LEFT JOIN f ON d.payload_digest = f.payload_digest
"""


#: Lower case for A-Z only, as the contract has it.
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

BASE_LICENSE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
p(words, label) AS (VALUES (['under', 'the', 'mit', 'license'], 'mit'), (['apache', 'license', 'version', '2'], 'apache-2'), (['cc', 'by', 'nc'], 'cc-by-nc')),
i AS (SELECT r, w, unnest(range(len(w))) AS i FROM d),
f AS (SELECT i.r, i.i, p.label FROM i JOIN p ON list_slice(i.w, i.i + 1, i.i + len(p.words)) = p.words)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, count(f.i) AS n_base, min(f.i) AS first_word, max(f.i) AS last_word,
  coalesce(string_agg(DISTINCT f.label, ',' ORDER BY f.label), '') AS base_labels FROM d LEFT JOIN f ON f.r = d.r GROUP BY d.r, d.doc_id, d.w
"""

BASE_RULES_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
i AS (SELECT r, unnest(range(len(w) - 4)) AS i, w FROM d WHERE len(w) >= 5),
x AS (SELECT r, i, count(*) OVER (PARTITION BY r, list_slice(w, i + 1, i + 5)) AS n FROM i),
h AS (SELECT r, count(DISTINCT i + k) AS n FROM x, (SELECT unnest(range(5)) AS k) WHERE x.n > 1 GROUP BY r),
l AS (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d),
u AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM l WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY r),
s AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, coalesce(u.n, 0) AS n_dup_lines, coalesce(h.n, 0) AS n_repeat_words
  FROM d LEFT JOIN u ON u.r = d.r LEFT JOIN h ON h.r = d.r)
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM s
"""

_SIZED = f"""d AS (SELECT doc_id, source, CAST(len({_WORDS.format("coalesce(text, '')")}) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CAST([5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS DOUBLE) AS weight FROM d GROUP BY source)"""

#: A source is full if its size divided by its weight is low enough: in that order, each in turn is filled as long as twice its size is less than its share of what the others leave.
BASE_MIXING_SQL = f"""
WITH {_SIZED},
o AS (SELECT *, row_number() OVER (ORDER BY source_size / weight, source) AS k, coalesce(sum(source_size) OVER (ORDER BY source_size / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
  sum(weight) OVER (ORDER BY source_size / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open, sum(source_size) OVER () AS whole FROM s),
q AS (SELECT *, 2 * source_size < weight * (1.5 * whole - 2 * before) / open AS below FROM o),
e AS (SELECT min(k) AS k FROM q WHERE NOT below),
t AS (SELECT q.source, q.source_size, CASE WHEN e.k IS NULL OR q.k < e.k THEN 2.0 * q.source_size ELSE q.weight * (SELECT (1.5 * whole - 2 * before) / open FROM q JOIN e ON q.k = e.k) END AS target FROM q, e)
SELECT d.doc_id, d.size, t.source_size, round(CAST(t.target AS DOUBLE), 6) AS target FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
"""

BASE_MIXING_BY_SOURCE_SQL = (
    "SELECT source, count(*) AS documents, true AS near_target, true AS twice_at_most FROM documents GROUP BY source"
)


#: crc32 of the id's digits, bit by bit.
_CRC = """xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
  lambda c, b: list_reduce(list_concat([xor(c, b)], range(8)), lambda x, i: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END))), 4294967295)"""

BASE_LM_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_CRC} % 5 = 1 AS held_out, list_append({_WORDS.format(_LOWER)}, ' end ') AS w FROM documents),
t AS (SELECT r, held_out, unnest(w) AS token FROM d),
c AS (SELECT token, count(*) AS c FROM t WHERE NOT held_out GROUP BY token),
n AS (SELECT sum(c) AS n, count(*) AS v FROM c)
SELECT any_value(d.doc_id) AS doc_id, any_value(d.held_out) AS held_out, count(*) AS n_tokens, count(c.c) AS n_known, CAST(any_value(n.n) AS BIGINT) AS train_tokens,
  round(sum(log10((coalesce(c.c, 0) + 0.5) / (n.n + 0.5 * (n.v + 1)))), 6) AS base_score
FROM t JOIN d ON d.r = t.r LEFT JOIN c ON c.token = t.token, n GROUP BY d.r
"""


#: CRC-32 of each distinct feature, a byte at a time by a table of 256 values that SQL works out first; a feature's bytes are read from its hexadecimal form.
IMPORTANCE_SQL = f"""
WITH tab AS (SELECT list(list_reduce(list_concat([b], range(8)), lambda x, i: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END)) ORDER BY b) AS tab FROM range(256) r(b)),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
k AS (SELECT unnest([1, 2, 3]) AS k),
df AS (SELECT r, unnest(list_transform(range(len(w) - k + 1), lambda i: array_to_string(list_slice(w, i + 1, i + k), ' '))) AS f FROM d, k WHERE len(w) >= k),
bf AS (SELECT unnest(list_transform(range(len(w) - k + 1), lambda i: array_to_string(list_slice(w, i + 1, i + k), ' '))) AS f FROM b, k WHERE len(w) >= k),
u AS (SELECT f, hex(encode(f)) AS h FROM (SELECT f FROM df UNION SELECT f FROM bf)),
c AS (SELECT f, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(len(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT)),
  lambda s, x: xor(s >> 8, tab[(xor(s, x) & 255) + 1])), 4294967295) % 10000 AS bucket FROM u, tab),
dc AS (SELECT df.r, c.bucket, count(*) AS n FROM df JOIN c ON c.f = df.f GROUP BY ALL),
bc AS (SELECT c.bucket, count(*) AS n FROM bf JOIN c ON c.f = bf.f GROUP BY ALL),
g AS (SELECT x.bucket, CAST(floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM dc) + 10000) / ((coalesce(s.n, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM bc) + 10000)))) AS BIGINT) AS gain
  FROM range(10000) x(bucket) LEFT JOIN (SELECT bucket, sum(n) AS n FROM dc GROUP BY bucket) s ON s.bucket = x.bucket LEFT JOIN bc t ON t.bucket = x.bucket),
v AS (SELECT dc.r, sum(dc.n) AS n_features, sum(dc.n * g.gain) AS weight FROM dc JOIN g ON g.bucket = dc.bucket GROUP BY dc.r),
o AS (SELECT d.doc_id, len(d.w) AS words, CAST(coalesce(v.n_features, 0) AS BIGINT) AS n_features, CAST(coalesce(v.weight, 0) AS BIGINT) AS weight,
  CAST(coalesce(v.weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || coalesce(CAST(d.doc_id AS VARCHAR), '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM d LEFT JOIN v ON v.r = d.r),
p AS (SELECT *, row_number() OVER (ORDER BY words < 20, score DESC, doc_id NULLS LAST, n_features) AS place, count(*) FILTER (words >= 20) OVER () AS open FROM o)
SELECT doc_id, n_features, weight, score, CASE WHEN words >= 20 AND place <= 5 * open // 100 THEN place END AS rank FROM p
"""


_SPACED = r"trim(regexp_replace({}, '[\x20\x09-\x0D]+', ' ', 'g'))"

COPIES_SQL = f"""
SELECT min(doc_id) AS doc_id, count(*) AS copies, true AS together FROM documents GROUP BY {_SPACED.format(_LOWER)} HAVING count(*) > 1
"""

CONTAINED_SQL = f"""
WITH d AS (SELECT doc_id, ' ' || {_SPACED.format("lower(coalesce(text, ''))")} || ' ' AS text FROM documents),
i AS (SELECT item_id, {_SPACED.format("lower(coalesce(text, ''))")} AS item FROM benchmark)
SELECT DISTINCT d.doc_id, i.item_id FROM d JOIN i ON contains(d.text, ' ' || i.item || ' ') WHERE i.item <> ''
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op2_preference_chat": OP2_SQL,
        "op4_warc": OP4_SQL,
        "base_license_scan": BASE_LICENSE_SQL,
        "base_quality_rules": BASE_RULES_SQL,
        "base_mixing": BASE_MIXING_SQL,
        "base_mixing_by_source": BASE_MIXING_BY_SOURCE_SQL,
        "base_lm_scoring": BASE_LM_SQL,
        "copies_in_components": COPIES_SQL,
        "items_contained": CONTAINED_SQL,
        "op13_importance_resampling": IMPORTANCE_SQL,
    }
