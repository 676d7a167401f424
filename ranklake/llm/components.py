"""Connected components of a links table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C


def _large(e: DataFrame) -> DataFrame:
    """Each node sends its larger neighbours to the smallest node around it."""
    both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    out = both.join(least, "u").where("v > u and v != m")
    return out.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small(e: DataFrame) -> DataFrame:
    """Each node sends itself and its smaller neighbours to the smallest of these; u > v in e."""
    least = e.groupBy("u").agg(F.min("v").alias("m"))
    near = e.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return near.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """``node`` and ``component`` (the smallest node reachable) for every node that has a link.

    links: two long columns without nulls; repeats and loops do no harm.  A
    round halves long paths; tables in the shared folder cut the lineage, and
    only a count and a sum come to the driver.  Minima are combined before the
    shuffle, and joins on a node with very many links are split by Spark.
    """
    e = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u != v").distinct()
    e = C.table(e, "links")
    mark = None
    while True:
        before, e = e, C.table(_small(_large(e)), "stars")
        C.drop(before)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark or not now[0]:
            break
        mark = now
    roots = e.select(F.col("v").alias("node")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))
