"""Changes of documents: a log of upserts and retirements over a base, in batches or as a stream.

The log has seq (rising), op ('upsert' or 'retire'), doc_id and the document's
columns.  Statistics are those of live documents only.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.index import Index, Options, build
from ..sources import tables

#: Log records after which, and seconds by which at the latest, a log is merged into its base.
MOST_RECORDS, LONGEST_S = 65_536, 3600


def latest(log: DataFrame, key: str = "doc_id") -> DataFrame:
    """The last record of each document."""
    order = Window.partitionBy(key).orderBy(F.desc("seq"))
    return log.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def live(base: DataFrame, log: DataFrame, key: str = "doc_id") -> DataFrame:
    """The documents of base with the log applied, in the columns of base."""
    last = latest(log, key)
    kept = base.join(last.select(key), key, "left_anti")
    return kept.select(*base.columns).unionByName(last.where("op = 'upsert'").select(*base.columns))


def indexed(base: DataFrame, log: DataFrame, key: str, columns: list[str] | str, options: Options | None = None) -> Index:
    """The index of what its consistency shows: base and log, or base alone ('manual', until refreshed)."""
    options = options or Options()
    docs = base if options.consistency == "manual" else live(base, log, key)
    return build(docs, key, columns, options)


def overlaid(base: Index, log: DataFrame, key: str = "doc_id") -> Index:
    """The index of what its consistency shows, from a base index and a log, without building the base again.

    The base's parts without the changed documents, and those of the new
    versions; frequencies and totals are added and taken away, so they are exact
    for live documents.  'manual' shows the base alone.  ``pending`` counts the
    records that a reader doesn't see ('manual') or that aren't in the base
    ('eventual': it is exact here, but stale until merged()).
    """
    pending = log.count() if base.options.consistency != "realtime" else 0
    if base.options.consistency == "manual":
        return replace(base, pending=pending)
    last = latest(log, key)
    gone = last.select(F.col(key).alias("doc_id"))
    source = [c if c != "doc_id" else key for c in base.documents.columns if c not in ("tokens", "dl")]
    if base.source():
        # nothing is built yet: what is live is taken apart once
        return replace(build(live(base.documents.select(*[F.col("doc_id").alias(key) if c == key else c for c in source]), log, key), key, list(base.columns), base.options), pending=pending)
    new = build(last.where("op = 'upsert'").select(*source), key, list(base.columns), base.options)
    old = base.documents.select("doc_id", "dl").join(gone, "doc_id", "left_semi")
    lost = base.postings.join(gone, "doc_id", "left_semi").groupBy("term", "field").agg((-F.count("*")).alias("df"))
    parts = [base.terms.select("term", "field", "df"), lost, new.terms.select("term", "field", "df")]
    terms = reduce(DataFrame.unionByName, parts).groupBy("term", "field").agg(F.sum("df").alias("df")).where("df > 0")
    left = old.agg((-F.count("*")).alias("n_docs"), (-F.coalesce(F.sum("dl"), F.lit(0))).alias("total_len"))
    corpus = base.corpus.select("n_docs", "total_len").unionByName(left).unionByName(new.corpus).agg(F.sum("n_docs").alias("n_docs"), F.sum("total_len").alias("total_len"))
    documents = base.documents.join(gone, "doc_id", "left_anti").select(*base.documents.columns).unionByName(new.documents.select(*base.documents.columns))
    postings = base.postings.join(gone, "doc_id", "left_anti").select("term", "field", "doc_id", "dl", "tf").unionByName(new.postings)
    return replace(base, documents=documents, postings=postings, terms=terms, corpus=corpus, stored=True, pending=pending)


def merged(base: Index, log: DataFrame, path: str, key: str = "doc_id") -> Index:
    """Write the base with its log applied as a new stored index: the log's records up to now can go."""
    full = replace(overlaid(base.with_options(consistency="realtime"), log, key), pending=0)
    tables.save(full.with_options(consistency=base.options.consistency), path)
    return tables.load(base.documents.sparkSession, path)


def merged_if_due(base: Index, log: DataFrame, path: str, seconds: float, key: str = "doc_id") -> Index:
    """merged() if the log has grown or waited long enough; else the base as it is."""
    return merged(base, log, path, key) if due(log.count(), seconds) else base


def due(records: int, seconds: float, most: int = MOST_RECORDS, longest: float = LONGEST_S) -> bool:
    """Whether a log should be merged into its base now."""
    return records >= most or (records > 0 and seconds >= longest)


def completed(documents: DataFrame, atoms: DataFrame) -> DataFrame:
    """Atoms (doc_id, version, atom, weight) of the documents' present versions; others are out of date."""
    return atoms.join(documents.select("doc_id", "version"), ["doc_id", "version"], "left_semi")


def follow(changes: DataFrame, log_path: str, checkpoint: str, then: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Append a stream of changes to a Parquet log, each batch once, and call ``then`` on it."""

    def batch(df: DataFrame, number: int) -> None:
        # a batch that is repeated after a failure overwrites its own folder
        df.write.mode("overwrite").parquet(f"{log_path}/batch={number}")
        if then is not None:
            then(df, number)

    return changes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
