"""Indexes and source tables as Parquet."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import asdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import TextOptions
from ..operators.index import Index, Options, Scoring, counted, one_field, sizes, stored_frequencies
from ..operators.scratch import shared_folder
from ..plans.query import QueryError

VERSION = 2
PARTS = ("documents", "postings", "terms", "corpus")
#: Tokens whose postings make a file: what a task sorts grows with this, not with the table.
FILE_TOKENS, LEAST_TOKENS = 2_000_000, 100_000
#: Tokens for which there is a partition where terms are summed, and terms seen for each cut between files.
TERM_TOKENS, SEEN = 4_000_000, 200


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def save(index: Index, path: str, mode: str = "errorifexists") -> None:
    """Write an index; postings lie sorted by term, so that a query's terms prune files and row groups.

    Texts are taken apart once: the documents' tokens are written first, and the
    other parts are made from what is stored.  Ranges are cut by term and
    document, so that a frequent term spreads over files.
    """
    spark = index.documents.sparkSession

    def put(df: DataFrame, part: str) -> DataFrame:
        df.write.mode(mode).parquet(f"{path}/{part}")
        return spark.read.schema(df.schema).parquet(f"{path}/{part}")

    made = index.source()
    documents = put(made.fast if made else index.documents, "documents")
    total = put(sizes(documents), "corpus").first().total_len
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    files = max(total // FILE_TOKENS, min(total // LEAST_TOKENS, parts)) + 1
    if index.options.field_aware or index.stored or not isinstance(documents.schema["doc_id"].dataType, T.IntegralType):
        own = index.postings if index.options.field_aware or index.stored else counted(documents, one_field())
        ranged = own.repartitionByRange(files, "term", "doc_id")
    else:
        ranged = counted(documents, one_field(), cuts(documents, files, total)).repartitionById(files, F.col("part")).drop("part")
    postings = put(ranged.sortWithinPartitions("term", "doc_id"), "postings")
    put(stored_frequencies(postings, max(parts, total // TERM_TOKENS), index.options.field_aware), "terms")
    meta = json.dumps({"version": VERSION, "columns": index.columns, "source_type": index.source_type, "options": asdict(index.options)})
    spark.range(0, 1, 1, 1).select(F.lit(meta).alias("value")).write.mode(mode).text(f"{path}/meta")


def cuts(documents: DataFrame, files: int, total: int) -> Callable[[pa.Array, np.ndarray, pa.Array], np.ndarray]:
    """Numbers postings by files of ranges of terms' first eight bytes and doc_id.

    The ranges are chosen by some terms of some documents, so that the postings
    needn't be made twice; each posting has its range.
    """
    share = min(1.0, 20 * SEEN * files / max(total, 1))
    some = documents.sample(share, 0) if share < 1 else documents
    each = some.select("doc_id", F.explode(F.array_distinct("tokens")).alias("term"))
    left = min(1.0, SEEN * files / max(total * share, 1))
    each = each.where(F.pmod(F.xxhash64("term", "doc_id"), F.lit(1 << 20)) < int(left * (1 << 20))) if left < 1 else each
    seen = each.select(F.col("term"), F.col("doc_id").cast("long").alias("doc_id")).toArrow()
    begins, docs = prefixes(pa.concat_arrays(seen["term"].chunks) if seen.num_rows else pa.array([], pa.string())), seen["doc_id"].to_numpy()
    order = np.lexsort((docs, begins))
    at = order[(np.arange(1, files) * len(order)) // files] if len(order) else order
    begins, docs = begins[at], docs[at]
    groups, ids = np.unique(begins), np.unique(docs)
    bounds = np.searchsorted(groups, begins) * (len(ids) + 1) + np.searchsorted(ids, docs, "right")

    def place(distinct: pa.Array, codes: np.ndarray, doc_ids: pa.Array) -> np.ndarray:
        own = prefixes(distinct)
        out = np.searchsorted(begins, own)[codes]
        group = np.searchsorted(groups, own)
        among = np.append(groups, 0)[group] == own
        among &= group < len(groups)
        met = np.flatnonzero(among[codes])
        rank = np.searchsorted(ids, doc_ids.take(pa.array(met)).cast(pa.int64()).to_numpy(), "right")
        out[met] = np.searchsorted(bounds, group[codes[met]] * (len(ids) + 1) + rank, "right")
        return out

    return place


def prefixes(terms: pa.Array) -> np.ndarray:
    """The first eight bytes of each term as a number, in the order of terms (null: 0)."""
    terms = pc.fill_null(terms.cast(pa.string()), "")
    if not len(terms):
        return np.zeros(0, np.uint64)
    at = np.frombuffer(terms.buffers()[1], np.int32)[terms.offset : terms.offset + len(terms) + 1]
    data = np.append(np.frombuffer(terms.buffers()[2] or b"", np.uint8), np.zeros(8, np.uint8))
    out = np.zeros(len(terms), np.uint64)
    for i in range(8):
        out = (out << np.uint64(8)) | np.where(at[:-1] + i < at[1:], data[at[:-1] + i], 0).astype(np.uint64)
    return out


def peek(spark: SparkSession, path: str) -> dict:
    meta = json.loads("".join(r[0] for r in spark.read.text(f"{path}/meta").collect()))
    if meta.get("version") != VERSION:
        raise QueryError("the index was written by another version")
    return meta


def load(spark: SparkSession, path: str) -> Index:
    meta = peek(spark, path)
    o = meta["options"]
    options = Options(**(o | {"scoring": Scoring(**o["scoring"]), "text": TextOptions.of(**o["text"])}))
    parts = [spark.read.parquet(f"{path}/{p}") for p in PARTS]
    return Index(*parts, options, tuple(meta["columns"]), meta["source_type"], True)


__all__ = ["load", "peek", "read", "save", "shared_folder"]
