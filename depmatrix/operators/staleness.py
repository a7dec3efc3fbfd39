"""Whether a result still belongs to its matrix: a hash of the content that doesn't depend on the order of rows, kept with the result and compared when that is used."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depmatrix.schema import Dsm


def _hash(*parts: Column) -> Column:
    """Twelve hexadecimal digits of an MD5, as a number: sums of these have room for 2^15 rows a partial sum in a long, so sums are taken as decimals."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("\0")) for p in parts))), 1, 12), 16, 10).cast("decimal(38,0)")


def content(dsm: Dsm) -> DataFrame:
    """(dsm_id, n, m, content): elements, edges, and the sum of the hashes of both. Any edit that changes a label, a place or a weight changes it; another order of rows doesn't."""
    rows = dsm.elements.select("dsm_id", F.lit(1).alias("e"), _hash(F.lit("e"), F.col("idx"), F.col("label")).alias("h")).unionByName(
        dsm.edges.filter("w > 0 and i <> j").select("dsm_id", F.lit(0).alias("e"), _hash(F.lit("w"), F.col("i"), F.col("j"), F.col("w")).alias("h"))
    )
    by = rows.groupBy("dsm_id").agg(F.sum("e").alias("n"), F.sum(1 - F.col("e")).alias("m"), F.sum("h").alias("h"))
    return by.select("dsm_id", "n", "m", F.col("h").cast("string").alias("content"))


def stamped(result: DataFrame, dsm: Dsm) -> DataFrame:
    """A result (dsm_id, ...) of dsm with its content."""
    return result.join(content(dsm).select("dsm_id", "content"), "dsm_id", "left")


def checked(result: DataFrame, dsm: Dsm) -> DataFrame:
    """A stamped result with stale: whether dsm is no longer what it was made of, or isn't there any more."""
    now = content(dsm).select("dsm_id", F.col("content").alias("_now"))
    return result.join(now, "dsm_id", "left").withColumn("stale", ~F.col("content").eqNullSafe(F.col("_now"))).drop("_now")


def fresh(result: DataFrame, dsm: Dsm) -> DataFrame:
    """A stamped result, without its stamp; ValueError if it is stale."""
    found = checked(result, dsm)
    old = found.filter("stale").select("dsm_id").first()
    if old:
        raise ValueError(f"results of {old['dsm_id']} are older than its last edit")
    return found.drop("content", "stale")
