"""Line deduplication across documents (operator 7).

Method: each line's key is hashed to 128 bits; (hash, document, position) rows
are range-partitioned and sorted, so that first occurrences stream by.  Ranges
are cut by hash and document, hence a line that a third of all documents hold
spreads over many tasks; what a task needs to know about the one before (its
last hash, and the first document of that run) is a row per task.  The result is
a compressed bitmap of kept lines per document, never text.

Defined results: a null or empty text is one empty line and keeps it; rows of
one doc_id are one document, and repeated rows come out each by itself; rows
with a null doc_id are one document that sorts after all others; an empty table
gives an empty table; a very long text is a slice by itself; columns of any name
are carried along.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Rows to a range, about, and ranges at most; a range streams through its task, whatever its length.
RANGE, MOST_RANGES = 500_000, 20_000
LAST = (1 << 63) - 1


def key_of(line: bytes) -> bytes:
    """The line without white space at its ends, A-Z in lower case."""
    return C.lowered(line.strip())


def points(key: bytes, least: int) -> bool:
    """Whether the key has at least so many code points."""
    return len(key) >= 4 * least or (len(key) >= least and len(key.decode("utf-8")) >= least)


def line_hashes(docs: DataFrame, least: int) -> DataFrame:
    """h1, h2, doc, th (hash of the text), pos and n_lines of each line with a long enough key."""
    C.ship(docs.sparkSession)
    schema = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("doc", pa.int64()), ("th", pa.int64()), ("pos", pa.int32()), ("n_lines", pa.int32())])

    @C.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_128_digest
        for b in batches:
            for i, j in C.slices(b.column(1), 4 << 20):
                hashes, rows, at, of = [], [], [], []
                for r, text in enumerate(C.encoded(b.column(1).slice(i, j - i)), i):
                    lines = text.lower().split(b"\n")
                    for p, line in enumerate(lines):
                        k = line.strip()
                        if points(k, least):
                            hashes.append(digest(k))
                            rows.append(r)
                            at.append(p)
                            of.append(len(lines))
                h = np.frombuffer(b"".join(hashes), "<i8").reshape(-1, 2)
                take = pa.array(rows, pa.int64())
                yield C.batch(schema, h[:, 0], h[:, 1], b.column(0).take(take), b.column(2).take(take), at, of)

    plain = docs.select(F.coalesce("doc_id", F.lit(LAST)).alias("doc"), "text", "th")
    return plain.mapInArrow(run, "h1 long, h2 long, doc long, th long, pos int, n_lines int")


def _first_seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows of one range: rows to drop; rows of the first run's first document, which the range
    before decides about (kind 1); last, a row with the first and last hash and run starts (kind 2)."""
    from pyspark import TaskContext

    me = TaskContext.get().partitionId()
    names = ["kind", "part", "h1", "h2", "g1", "g2", "first", "doc", "th", "pos", "n_lines"]
    begin = now = None  # the first (hash, document), the hash in hand and its first document
    for b in batches:
        if not b.num_rows:
            continue
        h1, h2, doc = (b.column(i).to_numpy() for i in range(3))
        new = np.append(True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1]))
        if now is not None and (h1[0], h2[0]) == now[:2]:
            new[0] = False
        run = np.cumsum(new) - 1 + (0 if new[0] else 1)  # 0: goes on from the batch before, if not new
        starts = doc[new]
        firsts = starts if new[0] else np.append(now[2], starts)
        winner = firsts[run]
        if begin is None:
            begin = (int(h1[0]), int(h2[0]), int(doc[0]))
        now = (h1[-1], h2[-1], winner[-1])
        drop = doc != winner
        edge = (h1 == begin[0]) & (h2 == begin[1]) & (doc == begin[2])
        k = np.flatnonzero(drop | edge)
        if len(k):
            n, zero = len(k), np.zeros(len(k), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(edge[k].astype(np.int32)), pa.array(np.full(n, me, np.int32)), pa.array(h1[k]), pa.array(h2[k]), pa.array(zero), pa.array(zero), pa.array(zero), pa.array(doc[k]), b.column(3).take(pa.array(k)), b.column(4).take(pa.array(k)), b.column(5).take(pa.array(k))], names=names)
    if begin is not None:
        row = [2, me, begin[0], begin[1], int(now[0]), int(now[1]), int(now[2]), begin[2], 0, 0, 0]
        kinds = [pa.int32(), pa.int32(), *[pa.int64()] * 7, pa.int32(), pa.int32()]
        yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=names)


def dropped(docs: DataFrame, least: int) -> DataFrame:
    """doc, th, pos, n_lines of lines whose key an earlier document has.  docs: doc_id, text, th."""
    rows = C.table(line_hashes(docs, least), "lines")
    parts = min(C.pieces(rows.count(), RANGE, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))), MOST_RANGES)
    dealt = rows.repartitionByRange(parts, "h1", "h2", "doc").sortWithinPartitions("h1", "h2", "doc", "pos")
    seen = C.table(dealt.mapInArrow(_first_seen, "kind int, part int, h1 long, h2 long, g1 long, g2 long, first long, doc long, th long, pos int, n_lines int"), "seen")
    late, carry = [], None
    for r in seen.where("kind = 2").orderBy("part").select("part", "h1", "h2", "g1", "g2", "first", "doc").collect():  # a row for each range
        goes_on = carry is not None and carry[:2] == (r["h1"], r["h2"])
        if goes_on and carry[2] != r["doc"]:
            late.append(r["part"])
        whole = (r["h1"], r["h2"]) == (r["g1"], r["g2"])
        carry = (r["g1"], r["g2"], carry[2] if goes_on and whole else r["first"])
    spark = docs.sparkSession
    again = spark.createDataFrame([(p,) for p in late], "part int")
    edges = seen.where("kind = 1").join(again, "part", "left_semi")
    return seen.where("kind = 0").unionByName(edges).select("doc", "th", "pos", "n_lines")


def bitmaps(docs: DataFrame, text: str = "text", key: str = "doc_id", least: int = 10) -> DataFrame:
    """For each document that loses lines: doc, th (xxhash64 of its text), n_dropped and ``keep``.

    keep: zlib-compressed bits, one for each line, lowest bit first; 1 keeps the line.
    """
    plain = docs.select(docs[f"`{key}`"].cast("long").alias("doc_id"), docs[f"`{text}`"].cast("string").alias("text"))
    lost = dropped(plain.withColumn("th", F.xxhash64("text")), least)
    each = lost.groupBy("doc", "th", "n_lines").agg(F.collect_set("pos").alias("lost"))

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, keeps = [], []
            for lines, gone in zip(b.column(2).to_pylist(), b.column(3), strict=True):
                keep = np.ones(lines, np.uint8)
                keep[gone.values.to_numpy()] = 0
                n.append(int(lines - keep.sum()))
                keeps.append(zlib.compress(np.packbits(keep, bitorder="little").tobytes()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(keeps, pa.binary())], names=["doc", "th", "n_dropped", "keep"])

    return each.mapInArrow(bits, "doc long, th long, n_dropped long, keep binary")


def kept_text(text: bytes, keep: bytes | None) -> tuple[bytes, int]:
    """The text of the kept lines, and how many lines there were."""
    if keep is None:
        return text, text.count(b"\n") + 1
    lines = text.split(b"\n")
    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), count=len(lines), bitorder="little")
    return b"\n".join([x for x, k in zip(lines, bits.tolist(), strict=True) if k]), len(lines)


def dedup_lines(docs: DataFrame, text: str = "text", key: str = "doc_id", least: int = 10) -> DataFrame:
    """docs, in the same columns, with only the lines that no earlier document has.

    A text that loses all its lines becomes empty; a null text stays null.
    """
    C.ship(docs.sparkSession)
    row = F.struct(*[docs[f"`{c}`"] for c in docs.columns])  # so that no name clashes with ours
    joined = with_bitmaps(docs.select(row.alias("row"), docs[f"`{key}`"].cast("long").alias("doc_id"), docs[f"`{text}`"].cast("string").alias("text")), docs, text, key, least)

    @F.pandas_udf("string")
    def apply(texts, keeps):
        return texts.combine(keeps, lambda t, k: t if k is None or t is None else kept_text(t.encode(), k)[0].decode())

    new = F.when(F.col("keep").isNull(), F.col("text")).otherwise(apply("text", "keep"))
    return joined.select(*[new.alias(c) if c == text else F.col("row")[c].alias(c) for c in docs.columns])


def with_bitmaps(plain: DataFrame, docs: DataFrame, text: str, key: str, least: int) -> DataFrame:
    """plain (doc_id, text and others) with ``gone`` and ``keep`` of the documents of docs."""
    found = bitmaps(docs, text, key, least).select("doc", "th", F.col("n_dropped").alias("gone"), "keep")
    on = (F.coalesce(plain["doc_id"], F.lit(LAST)) == found["doc"]) & (F.xxhash64(plain["text"]) == found["th"])
    return plain.join(found, on, "left")


def digests(docs: DataFrame, text: str = "text", key: str = "doc_id", least: int = 10) -> DataFrame:
    """doc_id, n_lines, n_dropped and the hash of the kept text of each row."""
    import hashlib

    C.ship(docs.sparkSession)
    plain = docs.select(docs[f"`{key}`"].cast("long").alias("doc_id"), docs[f"`{text}`"].cast("string").alias("text"))
    joined = with_bitmaps(plain, docs, text, key, least).select("doc_id", "text", "gone", "keep")

    @C.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, out = [], []
            for text, keep in zip(b.column(1), b.column(3), strict=True):
                kept, lines = kept_text(text.as_buffer().to_pybytes() if text.is_valid else b"", keep.as_py())
                n.append(lines)
                out.append(hashlib.sha256(kept).hexdigest())
            gone = b.column(2).fill_null(0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), gone, pa.array(out)], names=["doc_id", "n_lines", "n_dropped", "kept_sha256"])

    return joined.mapInArrow(run, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")
