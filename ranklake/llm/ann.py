"""Approximate nearest neighbours by cross-polytope hashing (operator 8).

Method: three rounds of random signs and a fast Hadamard transform rotate unit
vectors; the nearest signed axis is a vector's bucket.  ``TABLES`` rotations
give as many tables.  A query probes its ``PROBES`` nearest axes in each, and
all that lie there are compared exactly, in double precision, in blocks.

Only directions are hashed, whatever the norms.  If norms differ, a long vector
can be among the nearest at a wide angle, where tables miss it.  So vectors are
cut into shells of about equal norm, and the worst score a query has found says
at what cosine a shell's vectors would still count.  Shells in which that is
past 1 are left; those in which tables find less than ``SURE`` of the vectors at
that cosine meet the query in full.

Equal vectors are searched once: of those only the smallest ids can be among
the nearest, so each distinct vector carries a few ids, and equal queries share
an answer.  Small buckets of one table are put together to blocks of about
``BLOCK`` vectors, so that a query goes to a few blocks of each table and brings
one list of its best back from each; a hot bucket is dealt to blocks of its own.
Queries for which the tables yield too few candidates meet all vectors, in
blocks.  A block keeps all vectors that tie with the last one in its matrix
product, scores them exactly and then cuts by score and id.

Defined results: vectors that are null, zero or hold null or non-finite
components take no part, nor do rows with a null id; vectors of another length
than the query are no candidates; repeated rows count once; of one id's several
vectors the nearest counts; an empty table gives an empty table; columns besides
key and vector are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

TABLES, PROBES, BLOCK, SEED = 8, 16, 32_768, 8
#: Products held at once.
PRODUCTS = 1 << 22
#: Shells of norm to a doubling, and the share of vectors at a cosine that tables must find to be trusted.
SHELLS, SURE = 4, 0.95


def hadamard(a: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of each row, orthonormal; the width is a power of two."""
    n, d = a.shape
    h = 1
    while h < d:
        a = a.reshape(n, -1, 2, h)
        a = np.stack([a[:, :, 0] + a[:, :, 1], a[:, :, 0] - a[:, :, 1]], axis=2).reshape(n, d)
        h *= 2
    return a / np.sqrt(d)


def _padded(width: int) -> int:
    return 1 << max(0, int(width - 1).bit_length())


def rotated(a: np.ndarray, table: int, seed: int = SEED) -> np.ndarray:
    """The rows under the table's pseudo-rotation, padded to a power of two."""
    width = _padded(a.shape[1])
    out = np.zeros((len(a), width))
    out[:, : a.shape[1]] = a
    rng = np.random.default_rng((seed, table, width))
    for _ in range(3):
        out = hadamard(out * rng.choice([-1.0, 1.0], width))
    return out


def units(a: np.ndarray) -> np.ndarray:
    return a / np.sqrt((a**2).sum(axis=1, keepdims=True))


def buckets(a: np.ndarray, table: int, probes: int) -> np.ndarray:
    """The ``probes`` nearest signed axes of each row, nearest first."""
    r = rotated(a, table)
    both = np.hstack([r, -r])
    k = min(probes, both.shape[1])
    if k == 1:
        return both.argmax(axis=1)[:, None]
    near = np.argpartition(-both, k - 1, axis=1)[:, :k]
    return near


def reach(width: int, tables: int, probes: int, pairs: int = 512) -> float:
    """The least cosine at which tables bring ``SURE`` of the vectors to a query, estimated on random pairs."""
    if probes >= 2 * width:
        return -1.0  # every bucket is probed
    rng = np.random.default_rng((SEED, width))
    q = units(rng.normal(size=(pairs, width)))
    r = rng.normal(size=(pairs, width))
    r = units(r - (r * q).sum(axis=1, keepdims=True) * q)
    near = [buckets(q, t, probes) for t in range(tables)]
    low, high = -1.0, 1.0
    for _ in range(7):
        c = (low + high) / 2
        v = c * q + np.sqrt(1 - c * c) * r
        hit = np.any([(near[t] == buckets(v, t, 1)).any(axis=1) for t in range(tables)], axis=0)
        low, high = (low, c) if hit.mean() >= SURE else (c, high)
    return high


def matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), width)


def valid(vector: str) -> Column:
    v = f"`{vector}`"
    return F.expr(f"{v} is not null and exists({v}, x -> x != 0) and not exists({v}, x -> x is null or isnan(x) or abs(x) = double('inf'))")


def _best(q: np.ndarray, qid: np.ndarray, v: np.ndarray, vid: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each query its k best of the vectors: query id, vector id, exact score; ties to the smaller id."""
    out: list[tuple] = []
    step = max(1, PRODUCTS // max(len(v), 1))
    far = np.sqrt((v**2).sum(axis=1)).max() * q.shape[1] * 2.0**-50
    for i in range(0, len(q), step):
        part = q[i : i + step]
        s = part @ v.T
        if k < len(v):
            least = np.partition(s, len(v) - k, axis=1)[:, len(v) - k] - far * np.sqrt((part**2).sum(axis=1))
            row, col = np.nonzero(s >= least[:, None])
        else:
            row, col = np.divmod(np.arange(s.size), len(v))
        exact = np.concatenate([np.zeros(0), *((part[row[j : j + 65_536]] * v[col[j : j + 65_536]]).sum(axis=1) for j in range(0, len(row), 65_536))])
        out.append(firsts(qid[i + row], vid[col], exact, k))
    return tuple(np.concatenate([o[j] for o in out]) for j in range(3))


def firsts(q: np.ndarray, vid: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best rows of each query; ties to the smaller id."""
    order = np.lexsort((vid, -score, q))
    q, vid, score = q[order], vid[order], score[order]
    begin = np.flatnonzero(np.append(True, q[1:] != q[:-1])) if len(q) else np.zeros(0, np.int64)
    place = np.arange(len(q)) - np.repeat(begin, np.diff(np.append(begin, len(q))))
    return q[place < k], vid[place < k], score[place < k]


def search(rows: DataFrame, is_query: Column, k: int = 20, key: str = "vec_id", vector: str = "embedding", tables: int = TABLES, probes: int = PROBES, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest rows of each query, itself left out."""
    spark = rows.sparkSession
    C.ship(spark)
    most = k + 1  # a query may find itself
    given = rows.schema[vector].dataType.elementType.simpleString()  # floats travel as floats
    v = rows[f"`{vector}`"] if given == "float" else rows[f"`{vector}`"].cast("array<double>")
    plain = rows.select(rows[f"`{key}`"].cast("long").alias("id"), v.alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    plain = plain.where(F.col("id").isNotNull() & valid("v")).withColumn("h", F.xxhash64("v"))
    # of equal vectors the smallest ids; the limit is applied before rows are moved
    order = Window.partitionBy("h", "v").orderBy("id")
    some = plain.select("id", "h", "v").withColumn("n", F.dense_rank().over(order)).where(F.col("n") <= most)
    groups = some.groupBy("h", "v").agg(F.array_sort(F.collect_set("id")).alias("ids"))
    groups = C.table(groups.select(F.element_at("ids", 1).alias("gid"), "ids", "h", "v"), "vectors")
    asks = plain.where("q").select("id", "h", "v").join(groups.select("gid", "h", "v"), ["h", "v"]).select(F.col("id").alias("query_id"), "gid").distinct()
    asks = C.table(asks, "asks")
    vectors = groups.select("gid", "v", F.size("v").alias("d"))
    queries = vectors.join(asks.select("gid").distinct(), "gid", "left_semi")
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    total, low, high = vectors.agg(F.count("*"), F.min(norm), F.max(norm)).first()
    even = not total or low > 0.999 * high

    def hashed(per: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                d = b.column(2).to_numpy()
                for width in np.unique(d).tolist():
                    pick = pa.array(np.flatnonzero(d == width))
                    gid, v = b.column(0).take(pick), b.column(1).take(pick)
                    a = units(matrix(v, width))
                    for t in range(tables):
                        near = buckets(a, t, per)
                        n = near.shape[1]
                        row = pa.array(np.repeat(np.arange(len(a)), n))
                        key_ = (width << 32 | t << 24) + near.ravel().astype(np.int64)
                        yield pa.RecordBatch.from_arrays([pa.array(key_), gid.take(row)], names=["bucket", "gid"])

        return run

    placed = C.table(vectors.mapInArrow(hashed(1), "bucket long, gid long"), "index")
    probed = C.table(queries.mapInArrow(hashed(probes), "bucket long, gid long"), "probes")
    found = C.table(meet(placed, probed, vectors, most, block), "found")
    # too few candidates, or a shell in which they may be too poor: the exact way
    tops = best_ids(found, groups, most)
    bounded = F.greatest(F.lit(1e-300), F.least(F.lit(1e300), norm))
    shell = F.lit(0) if even else F.floor(F.log2(bounded) * SHELLS).cast("int")
    bucket = (F.shiftleft(F.col("d").cast("long"), 32) + F.col("shell") + (1 << 16)).alias("bucket")
    shelled = vectors.select("gid", "d", shell.alias("shell"), norm.alias("norm"))
    limits = shelled.groupBy("d", "shell").agg(F.max("norm").alias("high")).collect()
    angle = {w: -1.0 if even else reach(w, tables, probes) for w in {_padded(r.d) for r in limits}}
    shells = spark.createDataFrame([(r.d, r.shell, r.high, angle[_padded(r.d)]) for r in limits], "d int, shell int, high double, least double")
    wanted = F.size(F.coalesce("near", F.array())) < min(most, total)
    if not even:
        worst, longest = F.get("near", F.lit(most - 1))["score"], F.col("norm") * F.col("high")
        wanted |= F.coalesce((worst <= longest * (1 + 1e-9)) & (worst < F.col("least") * longest), F.lit(False))
    poor = queries.select("gid", "d", norm.alias("norm")).join(tops, "gid", "left").join(F.broadcast(shells), "d").where(wanted)
    again = C.table(poor.select(bucket, "gid"), "again")
    if not again.isEmpty():
        whole = shelled.select(bucket, "gid").join(again.select("bucket").distinct(), "bucket", "left_semi")
        found = found.unionByName(meet(whole, again, vectors, most, block))
        tops = best_ids(found, groups, most)
    told = asks.join(tops, "gid")
    near = F.slice(F.filter("near", lambda x: x["id"] != F.col("query_id")), 1, k)
    return told.select("query_id", F.posexplode(near).alias("p", "x")).select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("x.id").alias("vec_id"), F.col("x.score").alias("score"))


def best_ids(found: DataFrame, groups: DataFrame, most: int) -> DataFrame:
    """gid of each query vector and ``near``: its best ids with scores, best first."""
    once = found.repartition("q").groupBy("q", "gid").agg(F.max("score").alias("score"))
    by = Window.partitionBy("q").orderBy(F.desc("score"), "gid")
    top = once.withColumn("n", F.row_number().over(by)).where(F.col("n") <= most)
    each = top.join(groups.select("gid", "ids"), "gid").select("q", "score", F.explode("ids").alias("id"))
    again = Window.partitionBy("q").orderBy(F.desc("score"), "id")
    last = each.groupBy("q", "id").agg(F.max("score").alias("score")).withColumn("n", F.row_number().over(again)).where(F.col("n") <= most)
    listed = F.array_sort(F.collect_list(F.struct("n", "id", "score")))
    return last.groupBy(F.col("q").alias("gid")).agg(listed.alias("near"))


def meet(placed: DataFrame, probed: DataFrame, vectors: DataFrame, most: int, block: int) -> DataFrame:
    """q, gid, score: the best vectors of each block for the queries that probe its buckets."""
    sizes = placed.groupBy("bucket").agg(F.count("*").alias("n"))
    asked = probed.groupBy("bucket").agg(F.count("*").alias("m"))
    # buckets of one table (its number stands above 24 bits) fill blocks one after another; large ones are by themselves
    both = sizes.join(asked, "bucket").withColumn("t", F.shiftright("bucket", 24))
    big = F.col("n") > block
    before = F.sum(F.when(big, 0).otherwise(F.col("n"))).over(Window.partitionBy("t").orderBy("bucket")) - F.when(big, 0).otherwise(F.col("n"))
    both = both.withColumn("grp", F.xxhash64("t", F.when(big, F.col("bucket")).otherwise(F.lit(-1)), F.when(big, 0).otherwise(F.floor(before / block))))
    shape = both.withColumn("nbs", F.ceil(F.col("n") / block).cast("int")).withColumn("mbs", F.ceil(F.sum("m").over(Window.partitionBy("grp")) / block).cast("int")).select("bucket", "grp", "nbs", "mbs")

    def dealt(side: DataFrame, own: str, other: str, bucket: str) -> DataFrame:
        mine = F.pmod(F.xxhash64("gid"), F.col(f"{own}s").cast("long")).cast("int").alias(own)
        x = side.select("grp", bucket, mine, F.explode(F.sequence(F.lit(0), F.col(f"{other}s") - 1)).alias(other), "gid").join(vectors.select("gid", "v"), "gid")
        return x.select(*[F.col(c).alias(f"{c}_") for c in ("grp", "mb", "nb", bucket, "gid", "v")]).toDF("grp", "mb", "nb", bucket, "gid", "v")

    once = probed.join(shape, "bucket").groupBy("grp", "gid").agg(F.collect_set("bucket").alias("buckets"), F.max("nbs").alias("nbs"), F.max("mbs").alias("mbs"))
    left, right = dealt(once, "mb", "nb", "buckets"), dealt(placed.join(shape, "bucket"), "nb", "mb", "bucket")
    keys = ["grp", "mb", "nb"]

    def compare(a: pa.Table, b: pa.Table) -> pa.Table:
        found: list[tuple] = []
        if a.num_rows and b.num_rows:
            own = b["bucket"].to_numpy()
            order = np.argsort(own, kind="stable")
            own, vid = own[order], b["gid"].to_numpy()[order]
            lists, qid = a["buckets"].combine_chunks(), a["gid"].to_numpy()
            wanted, of = lists.flatten().to_numpy(), np.repeat(np.arange(a.num_rows), np.diff(lists.offsets.to_numpy()))
            width = len(a["v"][0])
            q, v = matrix(a["v"].combine_chunks(), width), matrix(b["v"].combine_chunks(), width)[order]
            for x in np.unique(wanted).tolist():
                low, high = np.searchsorted(own, [x, x + 1])
                if high > low:
                    asks = of[wanted == x]
                    found.append(_best(q[asks], qid[asks], v[low:high], vid[low:high], most))
        empty = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        q, g, s = firsts(*(np.concatenate([empty[j], *(f[j] for f in found)]) for j in range(3)), most)
        return pa.table({"q": q, "gid": g, "score": s})

    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(compare, "q long, gid long, score double")
