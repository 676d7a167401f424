"""The queries of the corpus operators and, where SQL expresses them, their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, licenses, lines, lm, packing, quality, simhash, toxicity, warc


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded text of every document, as hashes."""
    return bpe.digests(_read(spark, sf_dir, "documents"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = simhash.near_duplicates(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 tokens."""
    return packing.pack_digests(_read(spark, sf_dir, "documents")).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op4_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-probability of every document."""
    return lm.score(_read(spark, sf_dir, "documents"))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every license notice found in a document."""
    return licenses.scan(_read(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, base rules and the weakly supervised verdict on every document."""
    return quality.score(_read(spark, sf_dir, "documents")).select("doc_id", *quality.FEATURES, "base_failed", "kept", "posterior")


def op7_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What line deduplication keeps of every document."""
    return lines.digests(_read(spark, sf_dir, "documents"))


def op8_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors of every vector whose vec_id is divisible by 20."""
    rows = _read(spark, sf_dir, "embeddings")
    return ann.search(rows, F.col("vec_id") % 20 == 0)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's WARC record as read back from the archives."""
    found = warc.archive(_read(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "urlkey", "timestamp", "part", "place")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document."""
    return toxicity.classify(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_bpe, op2_simhash, op3_packing, op4_lm, op5_licenses, op6_quality, op7_lines, op8_ann, op9_warc, op10_toxicity)
}

#: Keys are compared in full here; UTF-8 hex of DuckDB's sha256 is lower case.
LINES_SQL = r"""
WITH l AS (
  SELECT doc_id, pos, line, lower_key AS k FROM (
    SELECT doc_id, pos, line,
           translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_key
    FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                 unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM documents))
), w AS (
  SELECT k, min(doc_id) AS first FROM l WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) >= 2
)
SELECT l.doc_id, count(*) AS n_lines, count(*) FILTER (WHERE w.first < l.doc_id) AS n_dropped,
       sha256(coalesce(string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (WHERE w.first IS NULL OR w.first = l.doc_id), '')) AS kept_sha256
FROM l LEFT JOIN w ON l.k = w.k GROUP BY l.doc_id
"""

ORACLES: dict[str, str] = {"op7_lines": LINES_SQL}
