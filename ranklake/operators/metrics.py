"""Ranking quality over a table of ranked hits and one of relevance judgements."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def evaluate(hits: DataFrame, judged: DataFrame, candidate_k: int = 1000) -> DataFrame:
    """By query_id of judged: ndcg_at_10, map_at_100, recall_at_100, mrr_at_20, candidate_upper_bound.

    hits: query_id, doc_id, rank.  judged: query_id, doc_id, relevance; every judged document is relevant.
    """
    gain, log2 = (lambda c: F.pow(F.lit(2.0), c) - 1), (lambda r: F.log2(r + F.lit(1.0)))
    # judgements of one relevance take ranks one after another, so that they come by their number
    order = Window.partitionBy("query_id").orderBy(F.desc("relevance"))
    grades = judged.groupBy("query_id", "relevance").agg(F.count("*").alias("n")).withColumn("last", F.sum("n").over(order))
    parts = F.array(*[F.lit(sum(1 / math.log2(r + 1) for r in range(1, n + 1))) for n in range(11)])
    upto = lambda c: F.get(parts, F.least(c, F.lit(10)).cast("int"))
    share = gain(F.col("relevance")) * (upto(F.col("last")) - upto(F.col("last") - F.col("n")))
    ideal = grades.groupBy("query_id").agg(F.sum("n").alias("relevant"), F.sum(share).alias("idcg"))
    met = hits.join(judged, ["query_id", "doc_id"]).withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))
    r = F.col("rank")
    found = met.groupBy("query_id").agg(
        F.sum(F.when(r <= 10, gain(F.col("relevance")) / log2(r)).otherwise(0.0)).alias("dcg"),
        F.sum(F.when(r <= 100, F.col("n") / r).otherwise(0.0)).alias("precision"),
        F.sum(F.when(r <= 100, 1).otherwise(0)).alias("hits"),
        F.min(F.when(r <= 20, r)).alias("first"),
        F.sum(F.when(r <= candidate_k, 1).otherwise(0)).alias("candidates"),
    )
    every = ideal.join(found, "query_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return every.select(
        "query_id",
        zero(F.when(F.col("idcg") > 0, F.col("dcg") / F.col("idcg"))).alias("ndcg_at_10"),
        zero(F.col("precision") / F.least(F.col("relevant"), F.lit(100))).alias("map_at_100"),
        zero(F.col("hits") / F.col("relevant")).alias("recall_at_100"),
        zero(1 / F.col("first")).alias("mrr_at_20"),
        zero(F.col("candidates") / F.col("relevant")).alias("candidate_upper_bound"),
    )
