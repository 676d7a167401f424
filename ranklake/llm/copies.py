"""Near copies by five-word Jaccard similarity, for the pipeline's near-dedup.

Texts link if their fingerprints are at most three bits apart (operator 2) or
their sets of five-word shingles have a similarity of at least ``LEAST``.  For
the latter, ``BANDS`` MinHash bands of ``ROWS`` rows bring candidates together:
a pair at a similarity of 0.8 is missed with a probability of (1 - 0.8 ** 5) **
20 = 0.0004.  Candidates are verified on their whole sets.  Groups whose members
are linked already, and groups of the same members as another, are left out; a
group only reports links that connect it, and is cut into blocks if it is large.

Defined results: null and empty texts have the empty set and are copies of each
other; a text of fewer than five words is one shingle; rows with a null doc_id
all stay, and of repeated rows of one doc_id that of the least hash of its
columns; an empty table gives an empty table; a very long text is a slice by
itself; columns of any name are carried along.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from . import simhash
from .components import components

#: LEAST is a fraction, compared in whole numbers.  BLOCK: sets in a block of a large group.
SIZE, BANDS, ROWS, LEAST, BLOCK = 5, 20, 5, (4, 5), 256
MIX = np.uint64(0x9E3779B97F4A7C15)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * MIX
    return h ^ (h >> np.uint64(29))


def shingle_set(text: bytes, size: int = SIZE) -> np.ndarray:
    """The distinct hashes of a text's shingles, in order."""
    words = C.lowered(text).split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    n = max(1, len(h) - size + 1)
    out = np.full(n, len(words) if len(words) < size else size, np.uint64)
    for i in range(min(size, len(h))):
        out = mixed(out + h[i : i + n])
    return np.unique(out)


def digest(found: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(found.tobytes())


def band_keys(sets: list[np.ndarray]) -> list[np.ndarray]:
    """The ``BANDS`` keys of each set; none of an empty one."""
    own = [i for i, s in enumerate(sets) if len(s)]
    out = [np.zeros(0, np.uint64)] * len(sets)
    if own:
        flat = np.concatenate([sets[i] for i in own])
        size = np.array([len(sets[i]) for i in own])
        at = np.cumsum(size) - size
        salts = np.random.default_rng(5).integers(1, 1 << 63, BANDS * ROWS).astype(np.uint64)
        keys = np.empty((len(own), BANDS), np.uint64)
        for b in range(BANDS):
            key = np.full(len(own), b, np.uint64)
            for s in salts[b * ROWS : (b + 1) * ROWS]:
                key = mixed(key + np.minimum.reduceat(mixed(flat ^ s), at))
            keys[:, b] = key
        for i, k in zip(own, keys, strict=True):
            out[i] = k
    return out


def near_links(sets: list[np.ndarray], group: np.ndarray) -> list[tuple[int, int]]:
    """Index pairs of similar sets that connect all that such pairs connect, given that equal groups are connected."""
    _, value = np.unique(np.concatenate(sets), return_inverse=True)
    size = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), size)
    parts = np.split(value, np.cumsum(size)[:-1])
    mark = np.zeros(int(value.max(initial=0)) + 1, bool)
    left = np.ones(len(sets), bool)
    out: list[tuple[int, int]] = []
    while left.any():
        first = int(left.argmax())
        queue = np.flatnonzero(left & (group == group[first])).tolist()
        left[queue] = False
        while queue and left.any():
            x = queue.pop()
            mark[parts[x]] = True
            common = np.bincount(owner[mark[value]], minlength=len(sets))
            mark[parts[x]] = False
            hit = np.flatnonzero(left & (common * LEAST[1] >= (size + size[x] - common) * LEAST[0]))
            out += [(x, y) for y in hit.tolist()]
            new = left & np.isin(group, group[hit])
            queue += np.flatnonzero(new).tolist()
            left &= ~new
    return out


def representatives(docs: DataFrame, text: str = "text", key: str = "doc_id", tau: int = 3, block: int = BLOCK) -> DataFrame:
    """The rows of docs whose doc_id is the smallest of its group of near copies, in the same columns."""
    C.ship(docs.sparkSession)
    own = docs.where(docs[f"`{key}`"].isNotNull())
    plain = C.only(own, doc_id=own[f"`{key}`"].cast("long"), text=own[f"`{text}`"].cast("string"))

    @C.lean
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j in C.slices(b.column(1), 4 << 20):
                part = b.slice(i, j - i)
                fp = simhash.fingerprints(part.column(1)).view(np.int64)
                sets = [shingle_set(t) for t in C.encoded(part.column(1))]
                s = np.fromiter(map(digest, sets), np.uint64, len(sets)).view(np.int64)
                bands = pa.array([k.view(np.int64) for k in band_keys(sets)], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fp), pa.array(s), bands], names=["doc_id", "fp", "s", "bands"])

    signed = C.table(plain.mapInArrow(sign, "doc_id long, fp long, s long, bands array<long>"), "signed")
    known = C.table(signed.join(simhash.named_fingerprints(signed.select("doc_id", "fp"), tau), "fp").select("doc_id", "s", "bands", F.col("component_id").alias("c")), "known")
    once = C.table(known.groupBy("s").agg(F.min("c").alias("c"), F.min("doc_id").alias("doc_id"), F.min("bands").alias("bands")), "sets")
    equal = known.select("s", F.col("c").alias("a")).distinct().join(once.select("s", F.col("c").alias("b")), "s").where("a != b").select("a", "b")
    # groups of more than one component, each set of members once
    members = once.select("s", "c", "doc_id", F.explode("bands").alias("key"))
    sizes = members.groupBy("key").agg(F.count("*").alias("n"), F.sum(F.xxhash64("s").cast("decimal(38,0)")).alias("who"), F.min("c").alias("low"), F.max("c").alias("high")).where("low < high")
    sizes = sizes.groupBy("n", "who").agg(F.min("key").alias("key")).select("key", F.ceil(F.col("n") / block).cast("int").alias("k"))
    met = C.table(members.join(sizes, "key"), "met")

    @C.lean
    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j in C.slices(b.column(0), 4 << 20):
                sets = [shingle_set(t) for t in C.encoded(b.column(0).slice(i, j - i))]
                s = np.fromiter(map(digest, sets), np.uint64, len(sets)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(s), pa.array([x.tobytes() for x in sets], pa.large_binary()).cast(pa.binary())], names=["s", "shingles"])

    asked = met.select("s", "doc_id").distinct()
    sets = plain.join(asked.select("doc_id").distinct(), "doc_id", "left_semi").select("text").mapInArrow(listed, "s long, shingles binary")
    sets = C.table(sets.dropDuplicates(["s"]), "shingles")
    mine = F.pmod(F.xxhash64("s", F.lit(2)), F.col("k").cast("long")).cast("int")
    dealt = met.withColumn("x", mine).withColumn("y", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    g = F.when(F.col("k") == 1, F.col("key")).otherwise(F.xxhash64("key", F.least("x", "y"), F.greatest("x", "y")))
    dealt = dealt.select(g.alias("g"), "s", "c").join(sets, "s")

    def verify(t: pa.Table) -> pa.Table:
        c = t["c"].to_numpy()
        found = near_links([np.frombuffer(x, np.uint64) for x in t["shingles"].to_pylist()], c)
        a, b = np.array(found, np.int64).reshape(-1, 2).T
        return pa.table({"a": c[a], "b": c[b]})

    links = equal.unionByName(dealt.groupBy("g").applyInArrow(verify, "a long, b long"))
    grown = components(links, "a", "b")
    name = C.fresh(docs, "_keep")
    kept = known.join(grown, known["c"] == grown["node"], "left").where(F.col("doc_id") == F.coalesce("component", "c")).select(F.col("doc_id").alias(name)).distinct()
    out = own.join(kept, own[f"`{key}`"].cast("long") == kept[name], "left_semi")
    return C.first_of_each(out, key).unionByName(docs.where(docs[f"`{key}`"].isNull()))
