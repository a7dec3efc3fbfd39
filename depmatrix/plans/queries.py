"""Registered queries over matrices derived from the order tables, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from depmatrix.operators import diff as D
from depmatrix.operators import graph as G
from depmatrix.operators import scoring as S
from depmatrix.operators import transforms as T
from depmatrix.operators import communities as C
from depmatrix.operators import history, markov, staleness, tearing
from depmatrix.operators import whatif as Q
from depmatrix.operators.numbering import numbered
from depmatrix.params import Constraints
from depmatrix.plans import cluster, derive, process, report
from depmatrix.schema import Dsm

Query = Callable[[SparkSession, str], DataFrame]
_found: dict[str, tuple[Query, str | None]] = {}

_TRADE = """t AS (SELECT c.c_nationkey AS i, s.s_nationkey AS j, CAST(count(*) AS DOUBLE) AS w FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN customer c ON o.o_custkey = c.c_custkey JOIN supplier s ON l.l_suppkey = s.s_suppkey WHERE c.c_nationkey <> s.s_nationkey{when} GROUP BY ALL)"""
_NATION = "n AS (SELECT n_nationkey AS idx, n_name AS label, n_regionkey AS cluster FROM nation)"
_CUT = (
    "e AS (SELECT i, j, w FROM t WHERE w >= (SELECT w FROM (SELECT w, row_number() OVER (ORDER BY w) - 1 AS r FROM t) WHERE r = (SELECT "
    "CAST(floor({share} * count(*)) AS BIGINT) FROM t)))"
)
_REACH = "reach(i, j) AS (SELECT i, j FROM e UNION SELECT r.i, e.j FROM reach r JOIN e ON r.j = e.i)"
_SCC = (
    "scc AS (SELECT n.idx, least(n.idx, coalesce(min(a.j), n.idx)) AS scc FROM n LEFT JOIN (SELECT a.i, a.j FROM reach a JOIN reach b ON "
    "a.i = b.j AND a.j = b.i) a ON a.i = n.idx GROUP BY n.idx)"
)


def _trade(when: str = "") -> str:
    return _TRADE.format(when=when)


def _cut(share: float | None) -> str:
    return "e AS (SELECT * FROM t)" if share is None else _CUT.format(share=share)


def _with(*parts: str, share: float | None = None, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ", ".join([_trade(), _NATION, _cut(share), *parts]) + " "


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        _found[f.__name__] = (f, sql)
        return f

    return add


def queries() -> dict[str, Query]:
    return {k: f for k, (f, _) in _found.items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for k, (_, sql) in _found.items() if sql}


def _dsm(spark: SparkSession, sf_dir: str, share: float | None = None) -> Dsm:
    d = derive.nation_trade(spark, sf_dir)
    if share is None:
        return d
    d = derive.strongest(Dsm(d.elements, G.cut(d.edges)), share)
    return Dsm(d.elements, G.cut(d.edges))  # several plans read it


def _regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive.regions(spark, sf_dir)


def _mod(d: Dsm, k: int) -> DataFrame:
    return d.elements.select("dsm_id", "idx", (F.col("idx") % k).alias("cluster"))


def _no_bus(d: Dsm) -> DataFrame:
    return d.elements.filter("false").select("dsm_id", "idx")


@query(_with() + "SELECT i, j, w FROM e")
def dsm_edges_nation_trade(spark, sf_dir):
    return _dsm(spark, sf_dir).edges.drop("dsm_id")


_CHAIN = """WITH s AS (SELECT {key} AS a, lag({key}) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS b FROM lineitem),
x AS (SELECT {id} AS item, CAST(row_number() OVER (ORDER BY {id}) - 1 AS INTEGER) AS idx FROM {table})
SELECT x.idx AS i, y.idx AS j, CAST(count(*) AS DOUBLE) AS w FROM s JOIN x ON s.a = x.item JOIN x y ON s.b = y.item WHERE s.b IS NOT NULL AND s.a <> s.b GROUP BY ALL"""


@query(_CHAIN.format(key="l_suppkey", id="s_suppkey", table="supplier"))
def dsm_edges_supp_chain(spark, sf_dir):
    return derive.chain(spark, sf_dir, "l_suppkey", "supp_chain").edges.drop("dsm_id")


@query(_CHAIN.format(key="l_partkey", id="p_partkey", table="part"))
def dsm_edges_part_chain(spark, sf_dir):
    return derive.chain(spark, sf_dir, "l_partkey", "part_chain").edges.drop("dsm_id")


@query(
    "WITH s AS (SELECT event_type AS src, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst FROM events) SELECT "
    "src, dst, CAST(count(*) AS DOUBLE) AS w FROM s WHERE dst IS NOT NULL AND src <> dst GROUP BY ALL"
)
def dsm_edges_event_flow(spark, sf_dir):
    return derive.event_flow(derive.table(spark, sf_dir, "events")).drop("dsm_id")


@query(_with(share=0.9) + "SELECT i, j, w FROM e")
def strongest_edges(spark, sf_dir):
    return _dsm(spark, sf_dir, 0.9).edges.drop("dsm_id")


@query(_with() + "SELECT j AS i, i AS j, w FROM e")
def transpose(spark, sf_dir):
    return T.transpose(_dsm(spark, sf_dir).edges).drop("dsm_id")


@query(_with(share=0.5) + "SELECT i, j, sum(w) / 2 AS w FROM (SELECT i, j, w FROM e UNION ALL SELECT j, i, w FROM e) GROUP BY ALL")
def symmetrise(spark, sf_dir):
    return T.symmetrise(_dsm(spark, sf_dir, 0.5).edges).drop("dsm_id")


_BUS = """d AS (SELECT i, count(DISTINCT j) AS d FROM (SELECT i, j FROM e UNION ALL SELECT j, i FROM e) GROUP BY i),
c AS (SELECT n.idx, coalesce(d.d, 0) / greatest((SELECT count(*) FROM n) - 1, 1) AS conn FROM n LEFT JOIN d ON d.i = n.idx),
m AS (SELECT median(conn) AS mid, stddev_pop(conn) AS sd FROM c), a AS (SELECT median(abs(conn - mid)) AS mad FROM c, m),
th AS (SELECT greatest(mid + 3.5 * CASE WHEN mad > 0 THEN 1.4826 * mad ELSE sd END, 0.15) AS threshold FROM m, a),
bus AS (SELECT idx, conn, threshold FROM c, th WHERE conn > threshold)"""


@query(_with(_BUS, share=0.9) + "SELECT idx, round(conn, 6) AS conn, round(threshold, 6) AS threshold FROM bus")
def bus_adaptive(spark, sf_dir):
    return S.bus_elements(_dsm(spark, sf_dir, 0.9)).select(
        "idx", F.round("conn", 6).alias("conn"), F.round("threshold", 6).alias("threshold")
    )


@query(_with(_BUS, share=0.9) + "SELECT idx, round(conn, 6) AS conn FROM c WHERE conn > 0.25")
def bus_fixed(spark, sf_dir):
    return S.bus_elements(_dsm(spark, sf_dir, 0.9), 0.25).select("idx", F.round("conn", 6).alias("conn"))


_CORE = (
    "core AS (SELECT idx AS old, CAST(row_number() OVER (ORDER BY idx) - 1 AS INTEGER) AS idx, label, cluster FROM n WHERE idx NOT IN "
    "(SELECT idx FROM bus))"
)


@query(_with(_BUS, _CORE, share=0.9) + "SELECT a.idx AS i, b.idx AS j, e.w FROM e JOIN core a ON a.old = e.i JOIN core b ON b.old = e.j")
def submatrix_core(spark, sf_dir):
    core, _, _ = cluster.core_of(_dsm(spark, sf_dir, 0.9), Constraints())
    return core.edges.drop("dsm_id")


@query(_with(_BUS, share=0.9) + """, k AS (SELECT coalesce(max(cluster) + 1, 0) AS k FROM n WHERE idx NOT IN (SELECT idx FROM bus)),
o AS (SELECT idx, cluster, 0 AS b FROM n WHERE idx NOT IN (SELECT idx FROM bus) UNION ALL SELECT idx, k.k + row_number() OVER (ORDER BY idx) - 1, 1 FROM bus, k)
SELECT CAST(row_number() OVER (ORDER BY b, cluster, idx) - 1 AS INTEGER) AS pos, idx, CAST(cluster AS INTEGER) AS cluster FROM o""".replace(", k AS", "SELECT * FROM (WITH k AS", 1) + ")")
def grouped_order(spark, sf_dir):
    d = _dsm(spark, sf_dir, 0.9)
    return T.grouped_order(d.elements, _regions(spark, sf_dir), S.bus_elements(d)).drop("dsm_id")


@query(
    _with("o AS (SELECT idx, CAST(row_number() OVER (ORDER BY cluster, idx) - 1 AS INTEGER) AS pos FROM n)")
    + "SELECT a.pos AS i, b.pos AS j, w FROM e JOIN o a ON a.idx = e.i JOIN o b ON b.idx = e.j"
)
def permute_by_cluster(spark, sf_dir):
    d = _dsm(spark, sf_dir)
    return T.permute(d, T.grouped_order(d.elements, _regions(spark, sf_dir), _no_bus(d))).edges.drop("dsm_id")


@query("SELECT n_nationkey AS idx, CAST(dense_rank() OVER (ORDER BY n_regionkey * 10) - 1 AS INTEGER) AS cluster FROM nation")
def relabel(spark, sf_dir):
    return T.relabel(_regions(spark, sf_dir).withColumn("cluster", F.col("cluster") * 10)).drop("dsm_id")


@query(_with(share=0.5) + "SELECT i, j, round(w / sum(w) OVER (PARTITION BY j), 9) AS w FROM e")
def column_normalise(spark, sf_dir):
    return T.column_normalise(_dsm(spark, sf_dir, 0.5).edges).select("i", "j", F.round("w", 9).alias("w"))


@query(
    _with(share=0.9)
    + "SELECT i - CASE WHEN i > 3 THEN 1 ELSE 0 END AS i, j - CASE WHEN j > 3 THEN 1 ELSE 0 END AS j, w FROM e WHERE i <> 3 AND j <> 3"
)
def editor_remove(spark, sf_dir):
    return T.remove_element(_dsm(spark, sf_dir, 0.9), "nation_trade", 3).edges.drop("dsm_id")


@query(_with(share=0.9) + "SELECT i, j, w FROM e WHERE NOT (i = 1 AND j = 2) UNION ALL SELECT 1, 2, CAST(7 AS DOUBLE)")
def editor_set(spark, sf_dir):
    return T.with_edge(_dsm(spark, sf_dir, 0.9), "nation_trade", 1, 2, 7.0).edges.drop("dsm_id")


def _score_sql(assign: str, share: float | None = None) -> str:
    return _with(f"g AS ({assign})", "z AS (SELECT cluster, count(*) AS size FROM g GROUP BY cluster)", share=share) + """SELECT CAST((SELECT count(*) FROM z) AS BIGINT) AS n_clusters,
coalesce(sum(w * CASE WHEN a.cluster = b.cluster THEN z.size ELSE (SELECT count(*) FROM n) END), 0) AS cost, coalesce(round(sum(CASE WHEN a.cluster <> b.cluster THEN w ELSE 0 END) / sum(w), 6), 0) AS external_ratio
FROM e JOIN g a ON a.idx = e.i JOIN g b ON b.idx = e.j JOIN z ON z.cluster = a.cluster"""


@query(_score_sql("SELECT idx, cluster FROM n"))
def coupling_by_region(spark, sf_dir):
    d = _dsm(spark, sf_dir)
    return S.scores(d.edges, _regions(spark, sf_dir), d.sizes()).select(
        "n_clusters", "cost", F.round("external_ratio", 6).alias("external_ratio")
    )


@query(_score_sql("SELECT idx, cluster FROM n", 0.9))
def coupling_strongest(spark, sf_dir):
    d = _dsm(spark, sf_dir, 0.9)
    return S.scores(d.edges, _regions(spark, sf_dir), d.sizes()).select(
        "n_clusters", "cost", F.round("external_ratio", 6).alias("external_ratio")
    )


@query(_with(_BUS, "g AS (SELECT idx, cluster FROM n WHERE idx NOT IN (SELECT idx FROM bus))", "z AS (SELECT cluster, count(*) AS size FROM g GROUP BY cluster)", share=0.9) + """SELECT CAST((SELECT count(*) FROM z) AS BIGINT) AS n_clusters, CAST((SELECT count(*) FROM bus) AS BIGINT) AS n_bus,
CAST((SELECT sum(w) FROM e) AS BIGINT) AS total_marks, CAST(sum(w) AS BIGINT) AS core_marks, CAST(sum(CASE WHEN a.cluster <> b.cluster THEN w ELSE 0 END) AS BIGINT) AS external_marks,
round(sum(CASE WHEN a.cluster <> b.cluster THEN w ELSE 0 END) / greatest(sum(w), 1), 6) AS external_ratio_core, sum(w * CASE WHEN a.cluster = b.cluster THEN z.size ELSE (SELECT count(*) FROM g) END) AS cost
FROM e JOIN g a ON a.idx = e.i JOIN g b ON b.idx = e.j JOIN z ON z.cluster = a.cluster""")
def metrics_core(spark, sf_dir):
    d = _dsm(spark, sf_dir, 0.9)
    return (
        S.metrics(d.edges, _regions(spark, sf_dir), d.elements, S.bus_elements(d))
        .drop("dsm_id")
        .withColumn("external_ratio_core", F.round("external_ratio_core", 6))
    )


@query(
    _with()
    + "SELECT sum(CASE WHEN i < j THEN w ELSE 0 END) AS feedback, CAST(sum(CASE WHEN i < j THEN w ELSE 0 END) AS BIGINT) AS feedback_marks FROM e"
)
def feedback_identity(spark, sf_dir):
    d = _dsm(spark, sf_dir)
    return S.feedback(d.edges, d.elements.select("dsm_id", "idx", F.col("idx").alias("pos"))).drop("dsm_id")


@query(
    _with(
        "o AS (SELECT n.idx, row_number() OVER (ORDER BY coalesce(sum(e.w), 0), n.idx) - 1 AS pos FROM n LEFT JOIN e ON e.i = n.idx "
        "GROUP BY n.idx)",
        share=0.5,
    )
    + "SELECT sum(CASE WHEN a.pos < b.pos THEN w ELSE 0 END) AS feedback FROM e JOIN o a ON a.idx = e.i JOIN o b ON b.idx = e.j"
)
def feedback_by_degree(spark, sf_dir):
    from pyspark.sql import Window as W

    d = _dsm(spark, sf_dir, 0.5)
    out = d.elements.join(d.edges.groupBy("dsm_id", F.col("i").alias("idx")).agg(F.sum("w").alias("s")), ["dsm_id", "idx"], "left")
    order = out.withColumn("pos", F.row_number().over(W.partitionBy("dsm_id").orderBy(F.coalesce("s", F.lit(0.0)), "idx")) - 1)
    return S.feedback(d.edges, order).select("feedback")


@query(
    _with(share=0.9)
    + "SELECT round(avg(CASE WHEN b.i IS NULL THEN 0.0 ELSE 1.0 END), 6) AS symmetry_ratio FROM e LEFT JOIN e b ON e.i = b.j AND e.j = b.i"
)
def symmetry_ratio(spark, sf_dir):
    return S.symmetry_ratio(_dsm(spark, sf_dir, 0.9).edges).select(F.round("symmetry_ratio", 6).alias("symmetry_ratio"))


_FIXED = (
    "g AS (SELECT idx, cluster, 'spectral' AS algo FROM n UNION ALL SELECT idx, idx % 4, 'mcl' FROM n UNION ALL SELECT idx, idx % 7, "
    "'thebeau' FROM n UNION ALL SELECT idx, idx % 12, 'louvain' FROM n)"
)
_SCORED = """z AS (SELECT algo, cluster, count(*) AS size FROM g GROUP BY ALL), k AS (SELECT algo, count(DISTINCT cluster) AS n_clusters FROM g GROUP BY algo),
sc AS (SELECT a.algo, k.n_clusters, sum(w * CASE WHEN a.cluster = b.cluster THEN z.size ELSE (SELECT count(*) FROM n) END) AS cost, sum(CASE WHEN a.cluster <> b.cluster THEN w ELSE 0 END) / sum(w) AS external_ratio
FROM e JOIN g a ON a.idx = e.i JOIN g b ON b.idx = e.j AND a.algo = b.algo JOIN z ON z.algo = a.algo AND z.cluster = a.cluster JOIN k ON k.algo = a.algo GROUP BY ALL)"""


def _fixed(spark, sf_dir) -> tuple[Dsm, DataFrame]:
    d = _dsm(spark, sf_dir, 0.9)
    parts = (
        [_regions(spark, sf_dir).withColumn("algo", F.lit("spectral"))]
        + [_mod(d, k).withColumn("algo", F.lit(a)) for a, k in (("mcl", 4), ("thebeau", 7), ("louvain", 12))]
    )
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return d, out


@query(
    _with(_FIXED, _SCORED, share=0.9)
    + "SELECT algo, cost FROM sc ORDER BY cost, CASE algo WHEN 'spectral' THEN 0 WHEN 'mcl' THEN 1 WHEN 'thebeau' THEN 2 ELSE 3 END LIMIT 1"
)
def recommend(spark, sf_dir):
    d, g = _fixed(spark, sf_dir)
    return S.recommend(S.scores(d.edges, g, d.sizes(), ("dsm_id", "algo"))).drop("dsm_id")


@query(_with(_FIXED, _SCORED, share=0.9) + "SELECT algo, n_clusters, cost, round(external_ratio, 6) AS external_ratio, n_clusters BETWEEN 2 AND 10 AS k_in_range, external_ratio > 0.85 AS exceeds_target FROM sc")
def candidate_flags(spark, sf_dir):
    d, g = _fixed(spark, sf_dir)
    out = S.over_target(S.k_in_range(S.scores(d.edges, g, d.sizes(), ("dsm_id", "algo")), d.sizes()), 0.85)
    return out.select("algo", "n_clusters", "cost", F.round("external_ratio", 6).alias("external_ratio"), "k_in_range", "exceeds_target")


_RUNS = (
    "r AS (SELECT 0 AS run, idx, cluster FROM n UNION ALL SELECT 1, idx, idx % 4 FROM n UNION ALL SELECT 2, idx, idx % 5 FROM n UNION "
    "ALL SELECT 3, idx, (idx + 1) % 5 FROM n)"
)


def _runs(spark, sf_dir) -> DataFrame:
    d = derive.nation_trade(spark, sf_dir)
    out = _regions(spark, sf_dir).withColumn("run", F.lit(0))
    for run, add, k in ((1, 0, 4), (2, 0, 5), (3, 1, 5)):
        out = out.unionByName(d.elements.select("dsm_id", "idx", ((F.col("idx") + add) % k).alias("cluster"), F.lit(run).alias("run")))
    return out


@query(
    "WITH "
    + _NATION
    + ", "
    + _RUNS
    + " SELECT a.idx AS i, b.idx AS j, count(*) / 4 AS frac FROM r a JOIN r b ON a.run = b.run AND a.cluster = b.cluster GROUP BY ALL"
)
def co_clustering(spark, sf_dir):
    return S.co_clustering(_runs(spark, sf_dir)).drop("dsm_id")


_CONSISTENCY = "WITH " + _NATION + ", " + _RUNS + """, f AS (SELECT a.idx AS i, b.idx AS j, count(*) / 4 AS frac FROM r a JOIN r b ON a.run = b.run AND a.cluster = b.cluster GROUP BY ALL)
SELECT a.idx, round(coalesce(avg(CASE WHEN b.idx IS NULL THEN NULL ELSE coalesce(f.frac, 0) END), 1), 6) AS c FROM n a LEFT JOIN n b ON a.cluster = b.cluster AND a.idx <> b.idx LEFT JOIN f ON f.i = a.idx AND f.j = b.idx GROUP BY a.idx"""


@query(_CONSISTENCY)
def consistency(spark, sf_dir):
    return S.consistency(_runs(spark, sf_dir), _regions(spark, sf_dir)).select("idx", F.round("c", 6).alias("c"))


@query(f"SELECT * FROM ({_CONSISTENCY.replace('n b ON a.cluster = b.cluster', 'n b ON a.idx % 4 = b.idx % 4')}) WHERE c < 0.7")
def unsettled_elements(spark, sf_dir):
    """Against the second of the runs as the reference."""
    reference = _mod(derive.nation_trade(spark, sf_dir), 4)
    return S.unsettled(S.consistency(_runs(spark, sf_dir), reference)).select("idx", F.round("c", 6).alias("c"))


@query("WITH " + _NATION + ", " + _RUNS + """, f AS (SELECT r.run, r.idx, r.cluster, min(r.idx) OVER (PARTITION BY r.run, r.cluster) AS first FROM r),
x AS (SELECT run, string_agg(cluster, ',' ORDER BY idx) AS a, string_agg(first, ',' ORDER BY idx) AS b FROM f GROUP BY run) SELECT count(DISTINCT a) AS distinct_partitions, count(DISTINCT b) AS distinct_canonical FROM x""")
def distinct_partitions(spark, sf_dir):
    return S.distinct_partitions(_runs(spark, sf_dir)).drop("dsm_id")


@query("SELECT n_regionkey AS cluster, string_agg(n_name, ', ' ORDER BY n_nationkey) AS labels FROM nation GROUP BY n_regionkey")
def cluster_members(spark, sf_dir):
    d = derive.nation_trade(spark, sf_dir)
    return S.members(_regions(spark, sf_dir), d.elements).drop("dsm_id")


_PERIODS = "WITH " + _trade(" AND o.o_orderdate < TIMESTAMP '1995-01-01'").replace("t AS", "ta AS", 1) + ", " + _trade(" AND o.o_orderdate >= TIMESTAMP '1995-01-01'").replace("t AS", "tb AS", 1) + """, n AS (SELECT n_nationkey AS idx, n_name AS label FROM nation),
la AS (SELECT x.label AS src, y.label AS dst, w FROM ta JOIN n x ON x.idx = ta.i JOIN n y ON y.idx = ta.j), lb AS (SELECT x.label AS src, y.label AS dst, w FROM tb JOIN n x ON x.idx = tb.i JOIN n y ON y.idx = tb.j),
df AS (SELECT coalesce(la.src, lb.src) AS src, coalesce(la.dst, lb.dst) AS dst, la.w AS w_a, lb.w AS w_b, CASE WHEN la.w IS NULL THEN 2 WHEN lb.w IS NULL THEN 3 WHEN la.w = lb.w THEN 1 ELSE 4 END AS status FROM la FULL OUTER JOIN lb ON la.src = lb.src AND la.dst = lb.dst) """


def _periods(spark, sf_dir) -> tuple[Dsm, Dsm]:
    return derive.nation_trade(spark, sf_dir, until="1995-01-01"), derive.nation_trade(spark, sf_dir, since="1995-01-01")


@query(_PERIODS + "SELECT * FROM df")
def diff_periods(spark, sf_dir):
    return D.diff(*_periods(spark, sf_dir)).drop("dsm_id")


@query(_PERIODS + "SELECT count(*) FILTER (status = 1) AS same, count(*) FILTER (status = 2) AS added, count(*) FILTER (status = 3) AS removed, count(*) FILTER (status = 4) AS changed FROM df")
def diff_summary(spark, sf_dir):
    return D.summary(D.diff(*_periods(spark, sf_dir))).drop("dsm_id")


@query(
    "SELECT n_name AS label, CASE WHEN n_regionkey < 2 THEN 'gone' ELSE 'new' END AS change FROM nation WHERE n_regionkey < 2 OR "
    "n_regionkey > 3"
)
def new_gone_elements(spark, sf_dir):
    d, r = derive.nation_trade(spark, sf_dir), _regions(spark, sf_dir)
    part = lambda cond: T.submatrix(d, r.filter(cond))[0]
    return D.element_changes(part("cluster <= 3"), part("cluster >= 2")).drop("dsm_id")


@query(
    _PERIODS
    + """, x AS (SELECT n_name AS label, n_regionkey AS r FROM nation),
la2 AS (SELECT la.* FROM la JOIN x a ON a.label = la.src JOIN x b ON b.label = la.dst WHERE a.r <= 3 AND b.r <= 3),
lb2 AS (SELECT lb.* FROM lb JOIN x a ON a.label = lb.src JOIN x b ON b.label = lb.dst WHERE a.r >= 2 AND b.r >= 2),
c AS (SELECT la2.w AS wa, lb2.w AS wb FROM la2 FULL OUTER JOIN lb2 ON la2.src = lb2.src AND la2.dst = lb2.dst)
SELECT count(*) FILTER (wa IS NULL) AS added, count(*) FILTER (wb IS NULL) AS removed, count(*) FILTER (wa <> wb) AS changed,
  (SELECT string_agg(label, ', ' ORDER BY label) FROM x WHERE r > 3) AS new_elements, (SELECT string_agg(label, ', ' ORDER BY label) FROM x WHERE r < 2) AS gone_elements FROM c"""
)
def report_diff(spark, sf_dir):
    """Two periods, the second without the first two regions and the first without the last: what a reader is told of the changes."""
    r = _regions(spark, sf_dir)
    a, b = (T.submatrix(d, r.filter(cond))[0] for d, cond in zip(_periods(spark, sf_dir), ("cluster <= 3", "cluster >= 2"), strict=True))
    return report.diff_report(a, b).drop("dsm_id")


@query(
    "SELECT n_regionkey + 1 AS cluster, count(*) AS size, string_agg(n_name, ', ' ORDER BY n_nationkey) AS members FROM nation GROUP BY "
    "n_regionkey"
)
def report_membership(spark, sf_dir):
    ordering = _regions(spark, sf_dir).select("dsm_id", F.col("idx").alias("pos"), "idx", "cluster")
    return report.membership(ordering, derive.nation_trade(spark, sf_dir)).drop("dsm_id")


@query("SELECT * FROM (VALUES ('2-8', '2-20', 'adaptive', '7')) AS v(k_range, cluster_size, bus_threshold, seed)")
def report_parameters(spark, sf_dir):
    limits = Constraints(min_clusters=2, max_clusters=8, min_cluster_size=2, max_cluster_size=20, seed=7)
    return report.parameters(derive.nation_trade(spark, sf_dir), limits).drop("dsm_id")


@query()
def report_comparison(spark, sf_dir):
    return report.comparison(cluster.cluster_stage(derive.nation_trade(spark, sf_dir), Constraints(seed=1)))


_LINES = """r AS (SELECT event_id AS line, event_type AS src, CASE WHEN event_id % 13 = 0 THEN event_type ELSE 'group ' || (user_id % 10) END AS dst, (event_id + 1) % 7 AS w FROM events),
s AS (SELECT label, min(first) AS first FROM (SELECT src AS label, 2 * line AS first FROM r UNION ALL SELECT dst, 2 * line + 1 FROM r) GROUP BY label),
x AS (SELECT label, CAST(row_number() OVER (ORDER BY first, label) - 1 AS INTEGER) AS idx FROM s),
p AS (SELECT src, dst, CAST(arg_max(CASE WHEN w = 0 THEN 1 ELSE w END, line) AS DOUBLE) AS w FROM r WHERE src <> dst GROUP BY src, dst)"""


@query(f"WITH {_LINES} SELECT a.idx AS i, b.idx AS j, src, dst, w FROM p JOIN x a ON a.label = p.src JOIN x b ON b.label = p.dst")
def edge_list_ingest(spark, sf_dir):
    """The events as lines of an edge list: blank weights, repeated pairs, edges of a type to itself, names with white space around them."""
    from depmatrix.sources.text import edges_from_lines

    e = F.col("event_id")
    dst = F.when(e % 13 == 0, F.col("event_type")).otherwise(F.concat(F.lit("group "), F.col("user_id") % 10))
    weight = F.when((e + 1) % 7 == 0, "").otherwise(((e + 1) % 7).cast("string"))
    lines = derive.table(spark, sf_dir, "events").select(e.alias("line"), F.concat("event_type", F.lit(" , "), dst, F.lit(","), weight).alias("value"))
    d = edges_from_lines(lines)
    a, b = (
        d.elements.select("dsm_id", F.col("idx").alias("i"), F.col("label").alias("src")),
        d.elements.select("dsm_id", F.col("idx").alias("j"), F.col("label").alias("dst")),
    )
    return d.edges.join(a, ["dsm_id", "i"]).join(b, ["dsm_id", "j"]).select("i", "j", "src", "dst", "w")


_SMALL = "g AS (SELECT idx, CASE WHEN idx < 3 THEN idx ELSE 3 + idx % 2 END AS cluster FROM n)"


def _small(d: Dsm) -> DataFrame:
    return d.elements.select("dsm_id", "idx", F.when(F.col("idx") < 3, F.col("idx")).otherwise(3 + F.col("idx") % 2).alias("cluster"))


@query(_with(_SMALL, "z AS (SELECT cluster, count(*) AS size, min(idx) AS first FROM g GROUP BY cluster)", share=0.5) + """, o AS (SELECT g.idx, l.cluster AS dest, l.first, coalesce(sum(e.w), 0) AS pull FROM g JOIN z s ON s.cluster = g.cluster AND s.size < 2
CROSS JOIN (SELECT * FROM z WHERE size >= 2) l LEFT JOIN g h ON h.cluster = l.cluster LEFT JOIN e ON e.i = g.idx AND e.j = h.idx GROUP BY ALL),
b AS (SELECT idx, dest FROM (SELECT *, row_number() OVER (PARTITION BY idx ORDER BY pull DESC, first) AS r FROM o) WHERE r = 1)
SELECT g.idx, CAST(dense_rank() OVER (ORDER BY coalesce(b.dest, g.cluster)) - 1 AS INTEGER) AS cluster FROM g LEFT JOIN b ON b.idx = g.idx""".replace(", o AS", "SELECT * FROM (WITH o AS", 1) + ")")
def min_size_pass(spark, sf_dir):
    d = _dsm(spark, sf_dir, 0.5)
    return Q.enforce_min_size(d.edges, _small(d)).drop("dsm_id")


@query(_with("z AS (SELECT cluster, count(*) AS size FROM n GROUP BY cluster)", share=0.5) + """SELECT a.cluster AS keep, b.cluster AS gone FROM z a JOIN z b ON a.cluster < b.cluster
LEFT JOIN (SELECT least(x.cluster, y.cluster) AS p, greatest(x.cluster, y.cluster) AS q, sum(w) AS w FROM e JOIN n x ON x.idx = e.i JOIN n y ON y.idx = e.j GROUP BY ALL) s ON s.p = a.cluster AND s.q = b.cluster
ORDER BY CASE WHEN a.size + b.size <= 20 THEN 0 ELSE 1 END, coalesce(s.w, 0) DESC, keep, gone LIMIT 1""")
def merge_step(spark, sf_dir):
    return Q.merge_step(_dsm(spark, sf_dir, 0.5).edges, _regions(spark, sf_dir)).drop("dsm_id")


@query(
    _with(share=0.5)
    + "SELECT a.cluster AS ci, b.cluster AS cj, sum(w) AS w FROM e JOIN n a ON a.idx = e.i JOIN n b ON b.idx = e.j GROUP BY ALL"
)
def louvain_aggregate(spark, sf_dir):
    return Q.aggregate_communities(_dsm(spark, sf_dir, 0.5).edges, _regions(spark, sf_dir)).drop("dsm_id")


_MOVED = _with("m AS (SELECT idx, CASE WHEN idx = 5 THEN 5 ELSE cluster END AS cluster FROM n)", "za AS (SELECT cluster, count(*) AS size FROM n GROUP BY cluster)", "zb AS (SELECT cluster, count(*) AS size FROM m GROUP BY cluster)") + """
SELECT base_cost, cost, round(base_external, 6) AS base_external, round(external, 6) AS external, CASE WHEN cost < base_cost THEN 'improved' WHEN cost > base_cost THEN 'worse' ELSE 'same' END AS verdict FROM
(SELECT sum(w * CASE WHEN a.cluster = b.cluster THEN za.size ELSE 25 END) AS base_cost, sum(CASE WHEN a.cluster <> b.cluster THEN w ELSE 0 END) / sum(w) AS base_external FROM e JOIN n a ON a.idx = e.i JOIN n b ON b.idx = e.j JOIN za ON za.cluster = a.cluster),
(SELECT sum(w * CASE WHEN a.cluster = b.cluster THEN zb.size ELSE 25 END) AS cost, sum(CASE WHEN a.cluster <> b.cluster THEN w ELSE 0 END) / sum(w) AS external FROM e JOIN m a ON a.idx = e.i JOIN m b ON b.idx = e.j JOIN zb ON zb.cluster = a.cluster)"""


@query(_MOVED)
def whatif_move(spark, sf_dir):
    d, r = _dsm(spark, sf_dir), _regions(spark, sf_dir)
    out = Q.rescore(d.edges, d.sizes(), r, Q.move(r, 5))
    return out.select(
        "base_cost", "cost", F.round("base_external", 6).alias("base_external"), F.round("external", 6).alias("external"), "verdict"
    )


@query("WITH RECURSIVE " + _with(share=0.9)[5:] + "SELECT idx, min(c) AS component FROM (WITH RECURSIVE u(i, j) AS (SELECT i, j FROM e UNION SELECT j, i FROM e), q(idx, c) AS (SELECT idx, idx FROM n UNION SELECT u.j, q.c FROM q JOIN u ON u.i = q.idx) SELECT * FROM q) GROUP BY idx")
def components(spark, sf_dir):
    return G.components(_dsm(spark, sf_dir, 0.9)).drop("dsm_id")


@query(_with(_REACH, _SCC, share=0.5, recursive=True) + "SELECT idx, scc FROM scc")
def scc(spark, sf_dir):
    d = _dsm(spark, sf_dir, 0.5)
    return G.strong_components(d.elements, d.edges).drop("dsm_id")


@query(_with(_REACH, _SCC, share=0.5, recursive=True) + "SELECT scc, count(*) AS size FROM scc GROUP BY scc HAVING count(*) > 1")
def loops(spark, sf_dir):
    d = _dsm(spark, sf_dir, 0.5)
    return G.loops(G.strong_components(d.elements, d.edges)).drop("dsm_id")


@query(
    _with(
        _REACH,
        _SCC,
        "dep AS (SELECT DISTINCT a.scc AS a, b.scc AS b FROM e JOIN scc a ON a.idx = e.i JOIN scc b ON b.idx = e.j WHERE a.scc <> b.scc)",
        "lv(scc, level) AS (SELECT scc, 0 FROM scc UNION SELECT dep.a, lv.level + 1 FROM lv JOIN dep ON dep.b = lv.scc)",
        share=0.5,
        recursive=True,
    )
    + "SELECT scc, max(level) AS level FROM lv GROUP BY scc"
)
def levels(spark, sf_dir):
    d = _dsm(spark, sf_dir, 0.5)
    return G.levels(d.edges, G.strong_components(d.elements, d.edges)).drop("dsm_id")


_TEAR = """
s AS (SELECT scc, count(*) AS size FROM scc GROUP BY scc HAVING count(*) > 1),
x AS (SELECT a.scc, s.size, e.i, e.j, e.w FROM e JOIN scc a ON a.idx = e.i JOIN scc b ON b.idx = e.j AND a.scc = b.scc JOIN s ON s.scc = a.scc),
r2(ti, tj, scc, i, j) AS (SELECT t.i, t.j, t.scc, x.i, x.j FROM x t JOIN x ON x.scc = t.scc AND NOT (x.i = t.i AND x.j = t.j)
  UNION SELECT r.ti, r.tj, r.scc, r.i, x.j FROM r2 r JOIN x ON x.scc = r.scc AND x.i = r.j AND NOT (x.i = r.ti AND x.j = r.tj)),
m2 AS (SELECT a.ti, a.tj, a.i, a.j FROM r2 a JOIN r2 b ON a.ti = b.ti AND a.tj = b.tj AND a.i = b.j AND a.j = b.i),
p AS (SELECT t.i AS ti, t.j AS tj, t.scc, m.idx, coalesce(count(b.j), 0) AS mutual FROM x t JOIN scc m ON m.scc = t.scc
  LEFT JOIN m2 b ON b.ti = t.i AND b.tj = t.j AND b.i = m.idx GROUP BY ALL),
o AS (SELECT x.scc, x.i, x.j, x.w, x.size - greatest(max(p.mutual), 1) AS impact, greatest(max(p.mutual), 1) AS largest_loop_after
  FROM x JOIN p ON p.ti = x.i AND p.tj = x.j GROUP BY x.scc, x.i, x.j, x.w, x.size)
SELECT scc, i, j, w, impact, largest_loop_after, largest_loop_after = 1 AS fully_resolves,
  CAST(row_number() OVER (PARTITION BY scc ORDER BY impact DESC, w, i, j) AS INTEGER) AS rank FROM o QUALIFY rank <= 5"""


def _torn(before: str) -> str:
    """before: SQL that ends with scc, the strong components."""
    return f"{before} SELECT * FROM (WITH RECURSIVE {_TEAR})"


@query(_torn(_with(_REACH, _SCC, share=0.9, recursive=True)))
def tearing_q90(spark, sf_dir):
    d = _dsm(spark, sf_dir, 0.9)
    return tearing.tearing(d.edges, G.strong_components(d.elements, d.edges)).drop("dsm_id")


_RISK = (
    "p1 AS (SELECT i, j, w / (SELECT max(w) FROM e) AS s FROM e), "
    + ", ".join(
        f"p{k + 1} AS (SELECT i, j, max(s) AS s FROM (SELECT * FROM p1 UNION ALL SELECT a.i, b.j, 0.6 * a.s * b.s FROM p1 a JOIN p{k} b "
        "ON a.j = b.i AND a.i <> b.j) GROUP BY i, j)"
        for k in (1, 2, 3)
    )
)


@query(_with(_RISK, share=0.9) + "SELECT i, j, round(s, 9) AS strength FROM p4")
def propagation(spark, sf_dir):
    return G.propagation(_dsm(spark, sf_dir, 0.9).edges).select("i", "j", F.round("strength", 9).alias("strength"))


def _rank_sql(axis: str) -> str:
    return _with(_RISK, share=0.9) + f"SELECT idx, round(m, 6) AS mean_risk, CAST(row_number() OVER (ORDER BY m DESC, idx) AS INTEGER) AS rank FROM (SELECT {axis} AS idx, sum(s) / 24 AS m FROM p4 GROUP BY {axis}) QUALIFY rank <= 6 AND m > 0.01"


@query(_rank_sql("j"))
def change_drivers(spark, sf_dir):
    d = _dsm(spark, sf_dir, 0.9)
    return G.risk_ranking(G.propagation(d.edges), d.sizes(), "j").select("idx", F.round("mean_risk", 6).alias("mean_risk"), "rank")


@query(_rank_sql("i"))
def change_prone(spark, sf_dir):
    d = _dsm(spark, sf_dir, 0.9)
    return G.risk_ranking(G.propagation(d.edges), d.sizes(), "i").select("idx", F.round("mean_risk", 6).alias("mean_risk"), "rank")


_MCL = (
    "m0 AS (SELECT i, j, w / sum(w) OVER (PARTITION BY j) AS w FROM (SELECT i, j, w FROM e UNION ALL SELECT idx, idx, 1.0 FROM n)), "
    + ", ".join(
        f"q{k} AS (SELECT a.i, b.j, pow(sum(a.w * b.w), 2) AS w FROM m{k} a JOIN m{k} b ON a.j = b.i GROUP BY a.i, b.j), m{k + 1} AS "
        f"(SELECT i, j, w / sum(w) OVER (PARTITION BY j) AS w FROM q{k})"
        for k in (0, 1)
    )
)


@query(_with(_MCL, share=0.9) + "SELECT i, j, round(w, 9) AS w FROM m2")
def mcl_two_steps(spark, sf_dir):
    return G.markov_steps(_dsm(spark, sf_dir, 0.9), 2).select("i", "j", F.round("w", 9).alias("w"))


_DEP = "dep AS (SELECT DISTINCT a.scc AS a, b.scc AS b FROM e JOIN scc a ON a.idx = e.i JOIN scc b ON b.idx = e.j WHERE a.scc <> b.scc)"
_LV = "lv(scc, level) AS (SELECT scc, 0 FROM scc UNION SELECT dep.a, lv.level + 1 FROM lv JOIN dep ON dep.b = lv.scc)"
_SHAPE = (
    "blk AS (SELECT s.scc, s.size, l.level FROM (SELECT scc, count(*) AS size FROM scc GROUP BY scc) s JOIN (SELECT scc, max(level) AS "
    "level FROM lv GROUP BY scc) l ON l.scc = s.scc)",
    "o AS (SELECT scc.idx, row_number() OVER (ORDER BY blk.level, blk.scc, scc.idx) AS pos FROM scc JOIN blk ON blk.scc = scc.scc)",
    """f AS (SELECT CAST(sum(size) AS BIGINT) AS n_elements, count(*) AS n_blocks, count(*) FILTER (size > 1) AS n_loops, CAST(coalesce(max(size) FILTER (size > 1), 1) AS BIGINT) AS largest_loop,
  CAST(coalesce(sum(size) FILTER (size > 1), 0) AS BIGINT) AS coupled_elements, max(level) + 1 AS n_levels, (SELECT CAST(coalesce(sum(CASE WHEN i < j THEN w END), 0) AS BIGINT) FROM e) AS feedback_before,
  (SELECT CAST(coalesce(sum(CASE WHEN a.pos < b.pos THEN w END), 0) AS BIGINT) FROM e JOIN o a ON a.idx = e.i JOIN o b ON b.idx = e.j) AS feedback_after,
  (SELECT coalesce(avg(CASE WHEN r.i IS NULL THEN 0.0 ELSE 1.0 END), 0) FROM e LEFT JOIN e r ON e.i = r.j AND e.j = r.i) AS s FROM blk)""",
)
_SHAPE_SQL = """SELECT n_elements, n_blocks, n_loops, largest_loop, coupled_elements, n_levels, feedback_before, feedback_after, round(s, 6) AS symmetry_ratio, n_elements - coupled_elements AS sequential_elements,
  feedback_before - feedback_after AS marks_resolved, CASE WHEN s >= 0.6 THEN 'symmetric' WHEN n_loops >= 1 AND largest_loop >= 0.8 * n_elements THEN 'giant_loop' ELSE 'process' END AS guidance FROM f"""
_FIXED_SQL = _SHAPE_SQL.replace("feedback_before, feedback_after,", "feedback_before,").replace(
    "feedback_before - feedback_after AS marks_resolved, ", ""
)


def _without_seed(metrics: DataFrame) -> DataFrame:
    return metrics.drop("dsm_id", "feedback_after", "marks_resolved").withColumn("symmetry_ratio", F.round("symmetry_ratio", 6))


@query()
def process_partition(spark, sf_dir):
    return process.partition(_dsm(spark, sf_dir, 0.5), seed=1).ordering


@query()
def process_metrics(spark, sf_dir):
    return process.partition(_dsm(spark, sf_dir, 0.5), seed=1).metrics


_LEVEL_OF = "SELECT scc.idx, max(lv.level) AS level FROM scc JOIN lv ON lv.scc = scc.scc GROUP BY scc.idx"


@query(_with(_REACH, _SCC, _DEP, _LV, share=0.5, recursive=True) + _LEVEL_OF)
def process_levels(spark, sf_dir):
    """Of the ordering what the seed doesn't decide."""
    return process.partition(_dsm(spark, sf_dir, 0.5), seed=1).ordering.select("idx", "level")


@query(_with(_REACH, _SCC, _DEP, _LV, *_SHAPE, share=0.5, recursive=True) + _FIXED_SQL)
def process_metrics_fixed(spark, sf_dir):
    """Of the metrics what the seed doesn't decide."""
    return _without_seed(process.partition(_dsm(spark, sf_dir, 0.5), seed=1).metrics)


@query()
def process_tears(spark, sf_dir):
    return process.partition(_dsm(spark, sf_dir, 0.5), seed=1).tears


@query(f"SELECT * EXCLUDE (scc) FROM ({_torn(_with(_REACH, _SCC, share=0.5, recursive=True))})")
def process_tears_fixed(spark, sf_dir):
    """The tears but for the block's number."""
    return process.partition(_dsm(spark, sf_dir, 0.5), seed=1).tears.drop("dsm_id", "block")


@query()
def cluster_candidates(spark, sf_dir):
    return cluster.cluster_stage(_dsm(spark, sf_dir, 0.9), Constraints(seed=1)).candidates


@query()
def cluster_sequence(spark, sf_dir):
    return cluster.run(_dsm(spark, sf_dir, 0.9), Constraints(seed=1))[0]


@query()
def cluster_metrics(spark, sf_dir):
    return cluster.run(_dsm(spark, sf_dir, 0.9), Constraints(seed=1))[1]


@query()
def k_sweep(spark, sf_dir):
    core, _, _ = cluster.core_of(_dsm(spark, sf_dir, 0.9), Constraints())
    return cluster.k_sweep(core)


@query()
def stability(spark, sf_dir):
    return cluster.stability(_dsm(spark, sf_dir, 0.9), "louvain")[1]


@query()
def fiedler_profile(spark, sf_dir):
    return cluster.fiedler_profile(_dsm(spark, sf_dir, 0.9))


@query("SELECT count(*) AS elements, count(*) AS places, 0 AS first, CAST(count(*) - 1 AS INTEGER) AS last, true AS together FROM nation")
def cluster_sequence_cover(spark, sf_dir):
    """Each element has a place of its own, places go from 0 without a gap, and each cluster's places lie side by side."""
    order = cluster.run(_dsm(spark, sf_dir, 0.9), Constraints(seed=1))[0]
    spans = order.groupBy("cluster").agg(F.count("*").alias("n"), (F.max("pos") - F.min("pos") + 1).alias("span"))
    found = order.agg(
        F.count_distinct("idx").alias("elements"),
        F.count_distinct("pos").alias("places"),
        F.min("pos").alias("first"),
        F.max("pos").alias("last"),
    )
    return found.crossJoin(spans.agg(F.bool_and(F.col("n") == F.col("span")).alias("together")))


@query(
    _with(_BUS, share=0.9)
    + """SELECT (SELECT count(*) FROM bus) AS n_bus, CAST(sum(w) AS BIGINT) AS total_marks,
  CAST(coalesce(sum(CASE WHEN i NOT IN (SELECT idx FROM bus) AND j NOT IN (SELECT idx FROM bus) THEN w END), 0) AS BIGINT) AS core_marks, true AS no_more_feedback, true AS within_bounds FROM e"""
)
def cluster_metrics_fixed(spark, sf_dir):
    """Of the metrics what the seed doesn't decide; ordering never adds feedback, and the cost lies between the core's marks and these times its elements."""
    d = _dsm(spark, sf_dir, 0.9)
    found = cluster.run(d, Constraints(seed=1))[1].join(d.sizes(), "dsm_id")
    within = (
        (F.col("external_marks") <= F.col("core_marks"))
        & (F.col("cost") >= F.col("core_marks"))
        & (F.col("cost") <= F.col("core_marks") * F.col("n"))
    )
    return found.select(
        "n_bus",
        "total_marks",
        "core_marks",
        (F.col("feedback_after") <= F.col("feedback_before")).alias("no_more_feedback"),
        within.alias("within_bounds"),
    )


@query(
    _with(_BUS, share=0.9)
    + "SELECT algo, true AS scored_alike, true AS cheapest_recommended FROM (VALUES ('spectral'), ('mcl'), ('thebeau'), ('louvain')) x(algo)"
)
def cluster_candidates_rescored(spark, sf_dir):
    """Every algorithm has a candidate, whose figures come out again from its clusters, and the recommended one is the cheapest."""
    stage = cluster.cluster_stage(_dsm(spark, sf_dir, 0.9), Constraints(seed=1))
    again = S.scores(stage.core.edges, stage.assign, stage.core.sizes(), ("dsm_id", "algo")).select(
        "dsm_id", "algo", F.col("cost").alias("c"), F.col("external_ratio").alias("x"), F.col("n_clusters").alias("k")
    )
    alike = (
        (F.abs(F.col("c") - F.col("cost")) < 1e-6)
        & (F.abs(F.col("x") - F.col("external_ratio")) < 1e-9)
        & (F.col("k") == F.col("n_clusters"))
    )
    least = stage.recommended().select("dsm_id", F.col("cost").alias("least"))
    return stage.candidates.join(again, ["dsm_id", "algo"]).join(least, "dsm_id").select(
        "algo", alike.alias("scored_alike"), (F.col("cost") >= F.col("least")).alias("cheapest_recommended")
    )


@query(_with(_BUS, share=0.9) + "SELECT CAST(k AS INTEGER) AS k, k AS n_clusters FROM (SELECT count(*) AS n FROM n WHERE idx NOT IN (SELECT idx FROM bus)), range(2, 12) r(k) WHERE k < least(12, n)")
def k_sweep_points(spark, sf_dir):
    """All k that the sweep tries, each with as many clusters."""
    return k_sweep(spark, sf_dir).select("k", F.col("n_clusters").cast("long").alias("n_clusters"))


@query("SELECT count(*) AS elements, 20 AS runs, true AS within_bounds FROM nation")
def stability_bounds(spark, sf_dir):
    """Consistency lies in 0..1, its mean is that of the elements, and there are as many different partitions as runs at most."""
    _, agree, figures = cluster.stability(_dsm(spark, sf_dir, 0.9), "louvain")
    each = agree.agg(F.count_distinct("idx").alias("elements"), F.min("c").alias("low"), F.max("c").alias("high"), F.avg("c").alias("mean"))
    fine = (
        (F.col("low") >= 0)
        & (F.col("high") <= 1)
        & (F.abs(F.col("mean") - F.col("mean_consistency")) < 1e-9)
        & F.col("distinct_partitions").between(1, F.col("runs"))
    )
    return each.crossJoin(figures).select("elements", "runs", fine.alias("within_bounds"))


def _chain(spark: SparkSession, sf_dir: str, kind: str, share: float = 0.99) -> Dsm:
    """supp: the suppliers' chain from its edge at that share of the weights on, the heaviest hundredth. part: edges of the parts' chain that occur twice at least."""
    d = derive.chain(spark, sf_dir, "l_suppkey" if kind == "supp" else "l_partkey", f"{kind}_chain")
    edges = G.cut(d.edges)
    d = derive.strongest(Dsm(d.elements, edges), share) if kind == "supp" else Dsm(d.elements, edges.filter("w >= 2"))
    return Dsm(d.elements, G.cut(d.edges))


def _shape(d: Dsm) -> DataFrame:
    """Figures of a process matrix in the order by levels, in tables alone."""
    out = process.process_metrics(d, process.by_levels(d)).drop("dsm_id")
    return out.withColumn("symmetry_ratio", F.round("symmetry_ratio", 6))


def _chain_sql(kind: str, *parts: str, share: float = 0.99) -> str:
    key, ident, name = ("l_suppkey", "s_suppkey", "supplier") if kind == "supp" else ("l_partkey", "p_partkey", "part")
    edges = _CUT.format(share=share) if kind == "supp" else "e AS (SELECT * FROM t WHERE w >= 2)"
    elements = f"n AS (SELECT CAST(row_number() OVER (ORDER BY {ident}) - 1 AS INTEGER) AS idx FROM {name})"
    return (
        "WITH RECURSIVE "
        + ", ".join([f"t AS ({_CHAIN.format(key=key, id=ident, table=name)})", elements, edges, _REACH, _SCC, *parts])
        + " "
    )


@query(_with(_REACH, _SCC, _DEP, _LV, *_SHAPE, share=0.5, recursive=True) + _SHAPE_SQL)
def process_shape(spark, sf_dir):
    return _shape(_dsm(spark, sf_dir, 0.5))


@query(_chain_sql("supp", _DEP, _LV, *_SHAPE) + _SHAPE_SQL)
def process_shape_supp_chain(spark, sf_dir):
    return _shape(_chain(spark, sf_dir, "supp"))


@query(_chain_sql("part", _DEP, _LV, *_SHAPE) + _SHAPE_SQL)
def process_shape_part_chain(spark, sf_dir):
    return _shape(_chain(spark, sf_dir, "part"))


@query(_chain_sql("supp", _DEP, _LV, *_SHAPE) + "SELECT level, CAST(sum(size) AS BIGINT) AS elements FROM blk GROUP BY level")
def level_bands_supp_chain(spark, sf_dir):
    return process.banded(process.by_levels(_chain(spark, sf_dir, "supp"))).drop("dsm_id")


@query(
    _with(_REACH, _SCC, _DEP, _LV, *_SHAPE, share=0.5, recursive=True)
    + "SELECT n_loops, coupled_elements, n_elements, n_levels, feedback_before FROM f"
)
def report_process(spark, sf_dir):
    """The summary, but for the feedback after annealing, which the seed decides."""
    d = _dsm(spark, sf_dir, 0.5)
    return report.process_report(d, process.partition(d, seed=1))["summary"].drop("dsm_id", "feedback_after")


@query(_with(share=0.9) + "SELECT i, j, w FROM e")
def matrix_files(spark, sf_dir):
    """The matrix written as a file of rows and read again."""
    from depmatrix.sources import text

    path = f"{G.shared_folder(spark)}/depmatrix-{uuid.uuid4().hex}"
    atexit.register(G._delete, spark, path)
    text.write_matrix_csv(_dsm(spark, sf_dir, 0.9), path)
    return text.read_matrices(spark, f"{path}/dsm_id=*").edges.drop("dsm_id")


@query(
    """WITH k AS (SELECT DISTINCT event_type FROM events), x AS (SELECT event_type, CAST(row_number() OVER (ORDER BY event_type) - 1 AS INTEGER) AS idx FROM k),
s AS (SELECT user_id % 25 AS g, event_type AS a, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events)
SELECT 'group ' || g || '.csv' AS dsm_id, x.idx AS i, y.idx AS j, CAST(count(*) AS DOUBLE) AS w FROM s JOIN x ON s.a = x.event_type JOIN x y ON s.b = y.event_type WHERE s.a <> s.b GROUP BY ALL"""
)
def matrix_files_by_group(spark, sf_dir):
    """What events follow which, a matrix for each of 25 groups of users, written as files by the data source and read again."""
    from depmatrix.sources import dsm_format

    dsm_format.register(spark)
    events = derive.table(spark, sf_dir, "events").withColumn("g", F.concat(F.lit("group "), F.col("user_id") % 25))
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    steps = events.select("g", F.col("event_type").alias("a"), F.lag("event_type").over(w).alias("b")).filter("a <> b")
    kinds = numbered(events.select("event_type").distinct(), ["event_type"], "idx", by=None)
    elements = G.cut(events.select(F.col("g").alias("dsm_id")).distinct().crossJoin(kinds).select("dsm_id", "idx", F.col("event_type").alias("label")))
    a, b = (kinds.select(F.col("event_type").alias(x), F.col("idx").alias(y)) for x, y in (("a", "i"), ("b", "j")))
    edges = steps.groupBy(F.col("g").alias("dsm_id"), "a", "b").agg(F.count("*").cast("double").alias("w")).join(a, "a").join(b, "b")
    path = f"{G.shared_folder(spark)}/depmatrix-{uuid.uuid4().hex}"
    atexit.register(G._delete, spark, path)
    dsm_format.laid_out(Dsm(elements, edges.select("dsm_id", "i", "j", "w"))).write.format("dsm").mode("append").save(path)
    return dsm_format.as_dsm(spark.read.format("dsm").load(path)).edges


@query(_chain_sql("supp") + "SELECT idx, scc FROM scc")
def scc_supp_chain(spark, sf_dir):
    d = _chain(spark, sf_dir, "supp")
    return G.strong_components(d.elements, d.edges).drop("dsm_id")


@query(_chain_sql("supp") + "SELECT scc, count(*) AS size FROM scc GROUP BY scc HAVING count(*) > 1")
def loops_supp_chain(spark, sf_dir):
    d = _chain(spark, sf_dir, "supp")
    return G.loops(G.strong_components(d.elements, d.edges)).drop("dsm_id")


@query(_chain_sql("supp", _DEP, _LV) + "SELECT scc, max(level) AS level FROM lv GROUP BY scc")
def levels_supp_chain(spark, sf_dir):
    d = _chain(spark, sf_dir, "supp")
    return G.levels(d.edges, G.strong_components(d.elements, d.edges)).drop("dsm_id")


@query(_chain_sql("part") + "SELECT idx, scc FROM scc")
def scc_part_chain(spark, sf_dir):
    d = _chain(spark, sf_dir, "part")
    return G.strong_components(d.elements, d.edges).drop("dsm_id")


@query(_chain_sql("part") + "SELECT scc, count(*) AS size FROM scc GROUP BY scc HAVING count(*) > 1")
def loops_part_chain(spark, sf_dir):
    d = _chain(spark, sf_dir, "part")
    return G.loops(G.strong_components(d.elements, d.edges)).drop("dsm_id")


@query(_chain_sql("part", _DEP, _LV) + "SELECT scc, max(level) AS level FROM lv GROUP BY scc")
def levels_part_chain(spark, sf_dir):
    d = _chain(spark, sf_dir, "part")
    return G.levels(d.edges, G.strong_components(d.elements, d.edges)).drop("dsm_id")


@query()
def process_metrics_supp_chain(spark, sf_dir):
    return process.partition(_chain(spark, sf_dir, "supp"), seed=1).metrics


@query()
def process_partition_supp_chain(spark, sf_dir):
    return process.partition(_chain(spark, sf_dir, "supp"), seed=1).ordering


@query()
def process_tears_supp_chain(spark, sf_dir):
    return process.partition(_chain(spark, sf_dir, "supp"), seed=1).tears


@query(_torn(_chain_sql("supp")))
def tearing_supp_chain(spark, sf_dir):
    d = _chain(spark, sf_dir, "supp")
    return tearing.tearing(d.edges, G.strong_components(d.elements, d.edges)).drop("dsm_id")


_DENSER = 0.97


@query(_torn(_chain_sql("supp", share=_DENSER)))
def tearing_supp_loop(spark, sf_dir):
    """Of a denser chain, where nearly all suppliers are one loop."""
    d = _chain(spark, sf_dir, "supp", _DENSER)
    return tearing.tearing(d.edges, G.strong_components(d.elements, d.edges)).drop("dsm_id")


@query(_torn(_chain_sql("supp", share=_DENSER)))
def tearing_supp_loop_tables(spark, sf_dir):
    """The same as for loops that no task holds: in tables alone."""
    d = _chain(spark, sf_dir, "supp", _DENSER)
    return tearing.tearing(d.edges, G.strong_components(d.elements, d.edges), in_task=0).drop("dsm_id")


@query(_chain_sql("supp", _DEP, _LV) + _LEVEL_OF)
def process_levels_supp_chain(spark, sf_dir):
    return process.partition(_chain(spark, sf_dir, "supp"), seed=1).ordering.select("idx", "level")


@query(_chain_sql("supp", _DEP, _LV, *_SHAPE) + _FIXED_SQL)
def process_metrics_fixed_supp_chain(spark, sf_dir):
    return _without_seed(process.partition(_chain(spark, sf_dir, "supp"), seed=1).metrics)


@query(f"SELECT * EXCLUDE (scc) FROM ({_torn(_chain_sql('supp'))})")
def process_tears_fixed_supp_chain(spark, sf_dir):
    """The tears but for the block's number."""
    return process.partition(_chain(spark, sf_dir, "supp"), seed=1).tears.drop("dsm_id", "block")


_MOVES = """s AS (SELECT i, j, sum(w) / 2 AS w FROM (SELECT i, j, w FROM e UNION ALL SELECT j, i, w FROM e) GROUP BY ALL),
k AS (SELECT i AS v, sum(w) AS k FROM s GROUP BY i), kc AS (SELECT n.cluster AS c, sum(k.k) AS kc FROM k JOIN n ON n.idx = k.v GROUP BY ALL),
l AS (SELECT s.i AS v, n.cluster AS c, sum(s.w) AS l FROM s JOIN n ON n.idx = s.j GROUP BY ALL), a AS (SELECT sum(w) AS a FROM s),
g AS (SELECT k.v, n.cluster AS c, l.c AS dest, 2 * (l.l - coalesce(h.l, 0)) / a.a - 2 * k.k * (t.kc - o.kc + k.k) / (a.a * a.a) AS gain FROM k JOIN n ON n.idx = k.v JOIN l ON l.v = k.v AND l.c <> n.cluster
  JOIN kc o ON o.c = n.cluster JOIN kc t ON t.c = l.c LEFT JOIN l h ON h.v = k.v AND h.c = n.cluster, a)"""


@query(_with(_MOVES, share=0.5) + "SELECT v AS idx, c AS cluster, dest, round(gain, 9) AS gain FROM g WHERE gain > 1e-12 QUALIFY row_number() OVER (PARTITION BY v ORDER BY gain DESC, dest) = 1")
def modularity_moves(spark, sf_dir):
    """From the regions, where each nation would move alone."""
    d = _dsm(spark, sf_dir, 0.5)
    member = _regions(spark, sf_dir).select("dsm_id", F.col("idx").alias("v"), F.col("cluster").alias("c"))
    moves = C.best_moves(G.cut(T.symmetrise(d.edges)), member)
    return moves.select(F.col("v").alias("idx"), F.col("c").alias("cluster"), F.col("to").alias("dest"), F.round("gain", 9).alias("gain"))


def _markov_sql(rounds: int, top: int, inflation: int = 2) -> str:
    """Pruned Markov rounds over e and n (idx), and the clusters then."""
    narrow = "SELECT i, j, w / sum(w) OVER (PARTITION BY j) AS w FROM k{k}"
    out = [f"k0 AS (SELECT i, j, w FROM (SELECT i, j, w / sum(w) OVER (PARTITION BY j) AS w FROM (SELECT i, j, w FROM e UNION ALL SELECT idx, idx, 1.0 FROM n)) QUALIFY row_number() OVER (PARTITION BY j ORDER BY round(w, 12) DESC, i) <= {top})"]
    for k in range(rounds):
        out.append(f"m{k} AS MATERIALIZED (" + narrow.format(k=k) + ")")
        out.append(f"s{k} AS MATERIALIZED (SELECT a.i, b.j, pow(sum(a.w * b.w), {inflation}) AS w FROM m{k} a JOIN m{k} b ON a.j = b.i GROUP BY a.i, b.j)")
        out.append(f"k{k + 1} AS (SELECT i, j, w FROM (SELECT i, j, w / sum(w) OVER (PARTITION BY j) AS w FROM s{k} WHERE w > 0) QUALIFY row_number() OVER (PARTITION BY j ORDER BY round(w, 12) DESC, i) <= {top})")
    out.append(f"g AS (SELECT i FROM k{rounds} WHERE i = j)")
    return ", ".join(out) + (
        f" SELECT CAST(n.idx AS INTEGER) AS idx, CAST(coalesce((SELECT min(k.i) FROM k{rounds} k WHERE k.j = n.idx AND k.i IN (SELECT i FROM g)), (SELECT min(i) FROM g)) AS INTEGER) AS cluster FROM n"
    )


@query(_with(share=0.5).rstrip() + ", " + _markov_sql(5, 6))
def markov_clusters(spark, sf_dir):
    """Clusters after five pruned rounds, six entries a column."""
    state = markov.markov(_dsm(spark, sf_dir, 0.5), (2.0,), top=6, rounds=5, tolerance=0.0)
    return markov.attracted(state).select("idx", "cluster")


@query(_chain_sql("supp", share=0.99).rstrip() + ", " + _markov_sql(6, 4))
def markov_clusters_supp_chain(spark, sf_dir):
    """Clusters of the suppliers' chain after six pruned rounds, four entries a column."""
    state = markov.markov(_chain(spark, sf_dir, "supp"), (2.0,), top=4, rounds=6, tolerance=0.0)
    return markov.attracted(state).select("idx", "cluster")


_HASH = "('0x' || substr(md5({}), 1, 12))::BIGINT::DECIMAL(38,0)"
_CONTENT = (
    "SELECT (SELECT count(*) FROM n) AS n, (SELECT count(*) FROM {e}) AS m, CAST((SELECT sum("
    + _HASH.format("'e|' || idx || '|' || label")
    + ") FROM n) + (SELECT sum("
    + _HASH.format("'w|' || i || '|' || j || '|' || w")
    + ") FROM {e}) AS VARCHAR) AS content"
)
_EDITS = (
    "same AS (SELECT * FROM e)",
    "edited AS (SELECT i, j, w FROM e WHERE NOT (i = 1 AND j = 2) UNION ALL SELECT 1, 2, CAST(7 AS DOUBLE))",
    "turned AS (SELECT j AS i, i AS j, w FROM e)",
)


@query(
    _with(*_EDITS, "c AS (" + " UNION ALL ".join(f"SELECT '{k}' AS edit, * FROM ({_CONTENT.format(e=k)})" for k in ("same", "edited", "turned")) + ")", share=0.9)
    + "SELECT edit, n, m, content, content <> (SELECT content FROM c WHERE edit = 'same') AS stale FROM c"
)
def staleness_of_edits(spark, sf_dir):
    """The strongest trade in another order of rows, with a cell set, and transposed: the content, and whether the scores of the matrix are stale then."""
    d = _dsm(spark, sf_dir, 0.9)
    scored = G.cut(staleness.stamped(S.symmetry_ratio(d.edges).select("dsm_id"), d))
    edits = {
        "same": Dsm(d.elements.orderBy(F.desc("idx")), d.edges.repartition(5, "w")),
        "edited": T.with_edge(d, "nation_trade", 1, 2, 7.0),
        "turned": Dsm(d.elements, T.transpose(d.edges)),
    }
    out = None
    for name, other in edits.items():
        row = staleness.content(other).join(staleness.checked(scored, other).select("dsm_id", "stale"), "dsm_id")
        row = row.select(F.lit(name).alias("edit"), "n", "m", "content", "stale")
        out = row if out is None else out.unionByName(row)
    return out


#: An edit log out of the events: who edits which cell, renames, undoes or redoes follows from the event's number. SQL goes through each matrix's steps with both stacks in hand.
_VERSIONS = """WITH RECURSIVE ev AS (SELECT 'group ' || (user_id % 25) AS dsm_id, event_id AS seq, CASE WHEN event_id % 11 < 6 THEN 'set' WHEN event_id % 11 = 6 THEN 'rename' WHEN event_id % 11 = 9 THEN 'redo' ELSE 'undo' END AS kind,
  event_id // 11 % 5 AS a, event_id // 55 % 5 AS b, event_id % 4 AS w, event_type AS label FROM events),
lg AS (SELECT *, row_number() OVER (PARTITION BY dsm_id ORDER BY seq) AS k FROM ev WHERE NOT (kind = 'set' AND a = b)),
st(dsm_id, k, seq, u, r, edit, holds) AS (SELECT DISTINCT dsm_id, 0::BIGINT, (-1)::BIGINT, []::BIGINT[], []::BIGINT[], NULL::BIGINT, false FROM lg
  UNION ALL SELECT l.dsm_id, l.k, l.seq,
    CASE WHEN kind = 'undo' THEN u[1:len(u) - 1] WHEN kind = 'redo' THEN CASE WHEN len(r) > 0 THEN list_append(u, r[len(r)]) ELSE u END WHEN len(u) >= 50 THEN list_append(u[2:], l.seq) ELSE list_append(u, l.seq) END,
    CASE WHEN kind = 'undo' THEN CASE WHEN len(u) > 0 THEN list_append(r, u[len(u)]) ELSE r END WHEN kind = 'redo' THEN r[1:len(r) - 1] ELSE []::BIGINT[] END,
    CASE WHEN kind = 'undo' THEN u[len(u)] WHEN kind = 'redo' THEN r[len(r)] ELSE l.seq END, kind <> 'undo' FROM st JOIN lg l ON l.dsm_id = st.dsm_id AND l.k = st.k + 1),
v AS (SELECT unnest([2500, 5000, 10000000]) AS version),
f AS (SELECT v.version, s.dsm_id, s.edit FROM st s, v WHERE s.edit IS NOT NULL AND s.seq <= v.version GROUP BY ALL HAVING arg_max(s.holds, s.seq)),
c AS (SELECT f.version, f.dsm_id, a, b, arg_max(w, seq) AS w FROM f JOIN lg ON lg.dsm_id = f.dsm_id AND lg.seq = f.edit WHERE kind = 'set' GROUP BY ALL),
t AS (SELECT f.version, f.dsm_id, a, arg_max(label, seq) AS label FROM f JOIN lg ON lg.dsm_id = f.dsm_id AND lg.seq = f.edit WHERE kind = 'rename' GROUP BY ALL)
SELECT CAST(c.version AS INTEGER) AS version, c.dsm_id, CAST(c.a AS INTEGER) AS i, CAST(c.b AS INTEGER) AS j, CAST(w AS DOUBLE) AS w, coalesce(t.label, 'Element ' || (c.a + 1)) AS label
FROM c LEFT JOIN t ON t.version = c.version AND t.dsm_id = c.dsm_id AND t.a = c.a WHERE w > 0"""


@query(_VERSIONS)
def matrix_versions(spark, sf_dir):
    """Three versions of 25 matrices that begin blank and are edited by the events: cells, and the name of each cell's row."""
    e = F.col("event_id")
    kind = F.when(e % 11 < 6, "set").when(e % 11 == 6, "rename").when(e % 11 == 9, "redo").otherwise("undo")
    at = lambda k: (F.floor(e / k) % 5).cast("int")
    log = derive.table(spark, sf_dir, "events").select(
        F.concat(F.lit("group "), F.col("user_id") % 25).alias("dsm_id"), e.alias("seq"), kind.alias("kind"), at(11).alias("a"), at(55).alias("b"),
        (e % 4).cast("double").alias("w"), F.col("event_type").alias("label"),
    )
    log = G.cut(log)
    every = log.select("dsm_id").distinct()
    blank = every.select("dsm_id", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("idx")).withColumn("label", F.concat(F.lit("Element "), F.col("idx") + 1))
    base = Dsm(blank, spark.createDataFrame([], "dsm_id string, i int, j int, w double"))
    done, out = G.cut(history.effects(log)), None
    for version in (2500, 5000, 10_000_000):
        d, _ = history.as_of(base, log, done, version)
        rows = d.edges.join(d.elements.select("dsm_id", F.col("idx").alias("i"), "label"), ["dsm_id", "i"])
        rows = rows.select(F.lit(version).alias("version"), "dsm_id", "i", "j", "w", "label")
        out = rows if out is None else out.unionByName(rows)
    return out
