"""Weighted fusion of hit lists, and hybrid fusion of candidates from several sources."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.query import QueryError
from .index import Index
from .score import search, top

NORMALIZERS = ("identity", "negative_distance", "inverse_distance", "minmax", "zscore", "rank")
CANDIDATE = "source_name string, doc_id long, raw_value double, source_rank int, weight double, normalizer string, direction string"


def fuse(lists: list[tuple[DataFrame, float | None]], k: int) -> DataFrame:
    """doc_id, score and rank of the k best by the weighted sum of scores; a null weight is 1; ties go by the text of doc_id."""
    every = [h.select("doc_id", (F.col("score") * F.lit(1.0 if w is None else float(w))).alias("score")) for h, w in lists]
    summed = reduce(DataFrame.unionByName, every).groupBy("doc_id").agg(F.sum("score").alias("score"))
    order = [F.round("score", 9).desc(), F.col("doc_id").cast("string")]
    return summed.orderBy(*order).limit(k).withColumn("rank", F.row_number().over(Window.orderBy(*order)))  # k rows


def fuse_queries(queries: list[tuple[Index, str, float | None]], k: int = 10, candidate_k: int | None = None, **text) -> DataFrame:
    """Each index contributes its best candidate_k (k if null) documents, padding included."""
    n = k if candidate_k is None else candidate_k
    return fuse([(search(index, q, n, **text), w) for index, q, w in queries], k)


def weighted(queries: list[tuple[Index, str]], weights: list[float | None] | None = None) -> list[tuple[Index, str, float]]:
    """Queries with their weights by position; a null or missing one is 1."""
    given = list(weights or [])
    if len(given) > len(queries):
        raise QueryError("more weights than queries")
    given += [None] * (len(queries) - len(given))
    return [(index, text, 1.0 if w is None else float(w)) for (index, text), w in zip(queries, given, strict=True)]


def fuse_fields(fields: dict[str, tuple[Index, str, float | None]], k: int = 10, candidate_k: int | None = None, **text) -> DataFrame:
    """fuse_queries() of queries by field; the fields' names say nothing but what is meant."""
    return fuse_queries(list(fields.values()), k, candidate_k, **text)


def candidates(hits: DataFrame, source: str, value: str = "score", rank: str | None = "rank", weight: float = 1.0, normalizer: str | None = None, direction: str = "higher") -> DataFrame:
    """Hits (doc_id and a value) as candidates of one source."""
    if (normalizer or "identity").lower() not in NORMALIZERS or direction.lower() not in ("higher", "lower"):
        raise QueryError("no such normalizer or direction")
    place = F.col(rank) if rank else F.lit(None)
    return hits.select(
        F.lit(source).alias("source_name"), F.col("doc_id").cast("long").alias("doc_id"), F.col(value).cast("double").alias("raw_value"), place.cast("int").alias("source_rank"),
        F.lit(float(weight)).alias("weight"), F.lit(normalizer).cast("string").alias("normalizer"), F.lit(direction).alias("direction"),
    )


def vector_candidates(vectors: DataFrame, query: list[float], source: str, k: int = 100, key: str = "vec_id", vector: str = "embedding", weight: float = 1.0, normalizer: str = "negative_distance") -> DataFrame:
    """The k nearest vectors by Euclidean distance, as candidates."""
    q = F.array(*[F.lit(float(x)) for x in query])
    square = F.aggregate(F.zip_with(F.col(vector).cast("array<double>"), q, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, x: a + x)
    near = vectors.select(F.col(key).cast("long").alias("doc_id"), F.sqrt(square).alias("score")).orderBy("score", "doc_id").limit(k)
    ranked = near.withColumn("rank", F.row_number().over(Window.orderBy("score", "doc_id")))  # k rows
    return candidates(ranked, source, weight=weight, normalizer=normalizer, direction="lower")


def hybrid(found: DataFrame, k: int | None = 10, method: str = "rrf", rrf_k: float = 60.0, epsilon: float = 1e-6) -> DataFrame:
    """Fuse candidates of several sources by reciprocal rank or by normalized score.

    Returns doc_id, score, source_count and, ordered by source, source_names,
    raw_values, normalized_scores, weighted_scores and ranks; best first by rank.
    """
    method = method.lower()
    if method not in ("rrf", "score"):
        raise QueryError("hybrid methods are rrf and score")
    k = 10 if k is None else max(k, 0)
    rrf_k, epsilon = max(rrf_k, 1e-6), max(epsilon, 1e-12)
    c = found.where("doc_id is not null and raw_value is not null and not isnan(raw_value)").where(F.abs("raw_value") != float("inf"))
    direction = F.lower(F.coalesce("direction", F.lit("higher")))
    c = c.select(
        F.when(F.coalesce("source_name", F.lit("")) == "", "source").otherwise(F.col("source_name")).alias("source"), "doc_id", F.col("raw_value").alias("raw"), "source_rank",
        F.coalesce("weight", F.lit(1.0)).alias("weight"), direction.alias("direction"),
        F.lower(F.coalesce("normalizer", F.when(direction == "lower", "negative_distance").otherwise("identity"))).alias("normalizer"),
    )
    lower = F.col("direction") == "lower"
    by = Window.partitionBy("source")
    place = F.row_number().over(by.orderBy(F.when(lower, 0).otherwise(1), F.when(lower, F.col("raw")).otherwise(-F.col("raw")), F.col("doc_id").cast("string")))
    c = c.withColumn("place", place).withColumn("n", F.count("*").over(by)).withColumn("lo", F.min("raw").over(by)).withColumn("hi", F.max("raw").over(by))
    c = c.withColumn("mean", F.sum("raw").over(by) / F.col("n")).withColumn("sq", F.sum(F.col("raw") * F.col("raw")).over(by) / F.col("n"))
    c = c.withColumn("rank", F.when(F.coalesce("source_rank", F.lit(0)) == 0, F.col("place")).otherwise(F.col("source_rank"))).where("rank >= 0")
    raw, span = F.col("raw"), F.col("hi") - F.col("lo")
    signed = F.when(lower, -raw).otherwise(raw)
    sigma = F.sqrt(F.greatest(F.lit(0.0), F.col("sq") - F.col("mean") * F.col("mean")))
    z = F.when(sigma > 0, (raw - F.col("mean")) / sigma).otherwise(0.0)
    kinds = {
        "identity": signed,
        "negative_distance": -raw,
        "inverse_distance": 1 / F.greatest(F.lit(epsilon), raw + epsilon),
        "minmax": F.when(span > 0, F.when(lower, F.col("hi") - raw).otherwise(raw - F.col("lo")) / span).otherwise(1.0),
        "zscore": F.when(lower, -z).otherwise(z),
        "rank": 1 / F.greatest(F.col("rank"), F.lit(1)),
    }
    if method == "rrf":
        value = 1 / (rrf_k + F.col("rank"))
    else:
        value = F.lit(None).cast("double")
        for name, how in kinds.items():
            value = F.when(F.col("normalizer") == name, how).otherwise(value)
    c = c.withColumn("normalized", value.cast("double")).withColumn("weighted", F.col("normalized") * F.col("weight"))
    best = Window.partitionBy("source", "doc_id").orderBy(F.desc("weighted"), "rank", F.when(lower, 0).otherwise(1), F.when(lower, raw).otherwise(-raw))
    once = c.withColumn("at", F.row_number().over(best)).where("at = 1")
    listed = F.array_sort(F.collect_list(F.struct("source", "raw", "normalized", "weighted", "rank")))
    docs = once.groupBy("doc_id").agg(F.sum("weighted").alias("score"), listed.alias("x")).orderBy(F.desc("score"), F.col("doc_id").cast("string")).limit(k)
    ranked = docs.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), F.col("doc_id").cast("string"))))  # k rows
    x = lambda f: F.transform("x", lambda e: e[f])
    return ranked.select(
        "doc_id", "score", F.size("x").alias("source_count"), x("source").alias("source_names"), x("raw").alias("raw_values"), x("normalized").alias("normalized_scores"),
        x("weighted").alias("weighted_scores"), x("rank").alias("ranks"), "rank",
    )


__all__ = ["candidates", "fuse", "fuse_queries", "hybrid", "top", "vector_candidates"]
