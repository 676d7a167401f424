"""SimHash near-duplicates with the generalised pigeonhole principle (operator 2).

Method: 64 bits are grouped into parts of correlated bits.  Two fingerprints at
most tau bits apart are at most t_i bits apart in some part i, if the thresholds
t_i (-1: the part is left out) add up to tau - parts + 1.  A dynamic program
allots unequal thresholds from candidate counts estimated on a bounded sample,
which decides about speed only.  A probe key is a part with t_i of its bits
masked.  Fingerprints that share a key meet in one group and are verified; a
group only reports links that connect it, never all pairs.  A group of over
``GROUP`` fingerprints is refined: the bits its key leaves open are cut into
tau + 1 parts, on one of which any two linked ones agree.  What is large even
then is cut into blocks that meet two by two.

Defined results: null text has no words and fingerprint zero, which links like
any other; equal texts and repeated rows share a fingerprint; rows with a null
doc_id get the component of their fingerprint but never name one; an empty
table gives an empty table; a very long text is a slice by itself; columns
besides key and text are not read, or carried along, whatever their names.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .components import components

#: Fingerprints in the planning sample, in a block of a large group, and hashed shingles at once.
SAMPLE, GROUP, AT_ONCE = 16_384, 4096, 1 << 19
ONE = np.uint64(1)


def shingles(words: list[bytes], size: int) -> list[bytes]:
    if len(words) < size:
        return [b" ".join(words)] if words else []
    return list(map(b" ".join, zip(*(words[i:] for i in range(size)), strict=False)))


def fingerprints(column: pa.Array, size: int = 3, seed: int = 42) -> np.ndarray:
    """The 64-bit SimHash of each text: a bit is set if over half the shingles' XXH64 have it."""
    of = xxhash.xxh64_intdigest
    out = np.zeros(len(column), np.uint64)
    hashes: list[np.ndarray] = []
    at: list[int] = []
    held = 0

    def flush() -> None:
        nonlocal held
        if hashes:
            h = np.concatenate(hashes)
            n = np.fromiter(map(len, hashes), np.int64, len(hashes))
            bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones = np.add.reduceat(bits, np.cumsum(n) - n, axis=0, dtype=np.int32)
            out[at] = np.packbits(2 * ones > n[:, None], axis=1, bitorder="little").view("<u8").ravel()
        hashes.clear()
        at.clear()
        held = 0

    for i, text in enumerate(column):
        words = C.lowered(text.as_buffer().to_pybytes() if text.is_valid else b"").split()
        if not words:
            continue
        found = shingles(words, size)
        at.append(i)
        hashes.append(np.fromiter((of(s, seed) for s in found), np.uint64, len(found)))
        held += len(found)
        if held >= AT_ONCE:
            flush()
    flush()
    return out


def group_bits(sample: np.ndarray, parts: int) -> list[list[int]]:
    """The 64 bits in parts of about equal width, correlated bits together."""
    bits = np.unpackbits(sample.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(float)
    if len(bits) < 2:
        bits = np.zeros((2, 64))
    bits -= bits.mean(axis=0)
    norm = np.sqrt((bits**2).sum(axis=0))
    near = np.abs(bits.T @ bits) / np.maximum(np.outer(norm, norm), 1e-12)
    np.fill_diagonal(near, 0)
    left, out = list(range(64)), []
    for p in range(parts):
        width = len(left) // (parts - p)
        group = [left[int(near[np.ix_(left, left)].sum(axis=1).argmax())]]
        left.remove(group[0])
        while len(group) < width:
            best = left[int(near[np.ix_(left, group)].mean(axis=1).argmax())]
            group.append(best)
            left.remove(best)
        out.append(sorted(group))
    return out


def mask_of(bits) -> int:
    return sum(1 << b for b in bits)


def masks(part: list[int], threshold: int) -> list[int]:
    """What of the part stays if any ``threshold`` of its bits are masked."""
    return [mask_of(part) & ~mask_of(c) for c in itertools.combinations(part, threshold)]


def rest_of(mask: int, parts: int) -> list[int]:
    """The bits outside a mask, dealt to masks of about equal width."""
    left = [b for b in range(64) if not mask >> b & 1]
    return [mask_of(left[j::parts]) for j in range(parts)]


def key_of(bits: np.ndarray, salt) -> np.ndarray:
    """A hash of masked fingerprints; different ones of one salt have different hashes."""
    h = bits * np.uint64(0x9E3779B97F4A7C15)
    return (h ^ h >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93) ^ salt


def pairs_sharing(values: np.ndarray) -> float:
    n = np.unique(values, return_counts=True)[1].astype(float)
    return float((n * (n - 1) / 2).sum())


def plan(sample: np.ndarray, rows: int, tau: int = 3) -> list[int]:
    """Masks; fingerprints within tau bits agree on one of them at least.

    Over 2 to 6 parts, thresholds of each part from -1 to 2: the least cost of
    keys made and candidates met, by dynamic programming over the sum so far.
    """
    sample = sample.astype(np.uint64)
    scale = (rows / max(len(sample), 1)) ** 2
    best: tuple[float, list[int]] | None = None
    for parts in range(2, 7):
        groups = group_bits(sample, parts)
        state: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        for g in groups:
            costs: dict[int, tuple[float, list[int]]] = {-1: (0.0, [])}
            for t in range(min(tau, 2) + 1):
                own = masks(g, t)
                if len(own) > 64:
                    continue
                met = sum(pairs_sharing(sample & np.uint64(m)) for m in own) * scale
                costs[t] = (rows * len(own) * 1.0 + met * 0.01, own)
            after: dict[int, tuple[float, list[int]]] = {}
            for s, (c, chosen) in state.items():
                for t, (more, own) in costs.items():
                    if s + t not in after or c + more < after[s + t][0]:
                        after[s + t] = (c + more, chosen + own)
            state = after
        if (got := state.get(tau - parts + 1)) and (best is None or got[0] < best[0]):
            best = got
    assert best is not None
    return best[1]


def near_links(fp: np.ndarray, tau: int) -> list[tuple[int, int]]:
    """Index pairs within tau bits that connect all that such pairs connect (a spanning forest)."""
    left = np.arange(len(fp))
    out: list[tuple[int, int]] = []
    while len(left) > 1:
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            x = queue.pop()
            hit = np.bitwise_count(fp[left] ^ fp[x]) <= tau
            if hit.any():
                found = left[hit].tolist()
                out += [(x, y) for y in found]
                queue += found
                left = left[~hit]
    return out


def group_links(key: np.ndarray, fp: np.ndarray, node: np.ndarray, tau: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within runs of equal keys.  Small runs are compared side by side, lag by lag."""
    edges = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    size = np.diff(np.append(edges, len(key)))
    run = np.repeat(np.arange(len(edges)), size)
    a, b = [], []
    small = np.append(size <= 16, False)[run] if len(run) else np.zeros(0, bool)
    for lag in range(1, min(16, len(key))):
        hit = (run[lag:] == run[:-lag]) & small[lag:] & (np.bitwise_count(fp[lag:] ^ fp[:-lag]) <= tau)
        if not (run[lag:] == run[:-lag]).any():
            break
        k = np.flatnonzero(hit)
        a.append(node[k])
        b.append(node[k + lag])
    for r in np.flatnonzero(size > 16).tolist():
        s = slice(edges[r], edges[r] + size[r])
        found = near_links(fp[s], tau)
        if found:
            x, y = np.array(found).T
            a.append(node[s][x])
            b.append(node[s][y])
    empty = [np.zeros(0, np.int64)]
    return np.concatenate(a or empty), np.concatenate(b or empty)


def link(distinct: DataFrame, tau: int = 3, group: int = GROUP) -> DataFrame:
    """Links a, b between the nodes of fingerprints within tau bits, enough to connect all that link.

    distinct: a stored table of ``fp`` (long, distinct) and ``node`` (long, distinct).
    """
    spark = distinct.sparkSession
    C.ship(spark)
    rows = distinct.count()
    sample = distinct.orderBy(F.xxhash64("fp", F.lit(1))).select("fp").limit(SAMPLE).toArrow()["fp"].to_numpy()
    chosen = plan(sample.view(np.uint64), rows, tau)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp, node = b.column(0).to_numpy().view(np.uint64), b.column(1)
            for k, m in enumerate(chosen):
                key = key_of(fp & np.uint64(m), np.uint64(xxhash.xxh64_intdigest(str(k))))
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), b.column(0), node, pa.array(np.full(len(fp), k, np.int32))], names=["key", "fp", "node", "k"])

    def refine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key, fp, k = b.column(0).to_numpy().view(np.uint64), b.column(1).to_numpy().view(np.uint64), b.column(3).to_numpy()
            for own in np.unique(k).tolist():
                pick = np.flatnonzero(k == own)
                for j, m in enumerate(rest_of(chosen[own], tau + 1)):
                    finer = key_of(fp[pick] & np.uint64(m), key[pick] + np.uint64(j))
                    at = pa.array(pick)
                    yield pa.RecordBatch.from_arrays([pa.array(finer.view(np.int64)), b.column(1).take(at), b.column(2).take(at)], names=["key", "fp", "node"])

    # keys of one fingerprint meet nobody; large groups are refined, and dealt to blocks if they stay large
    probes = distinct.select("fp", "node").mapInArrow(probe, "key long, fp long, node long, k int")
    sizes = C.table(probes.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "sizes")
    met = probes.join(sizes, "key")
    large = not sizes.where(F.col("n") > group).isEmpty()
    plain = met.where(F.col("n") <= group) if large else met
    dealt = plain.select(F.col("key").alias("g"), "fp", "node")
    if large:
        finer = C.table(met.where(F.col("n") > group).select("key", "fp", "node", "k").mapInArrow(refine, "key long, fp long, node long"), "finer")
        sizes = finer.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
        blocks = finer.join(sizes, "key").withColumn("c", F.ceil(F.col("n") / group).cast("int"))
        mine = F.pmod(F.xxhash64("fp", F.lit(2)), F.col("c").cast("long")).cast("int")
        blocks = blocks.withColumn("x", mine).withColumn("y", F.explode(F.sequence(F.lit(0), F.col("c") - 1)))
        block = F.xxhash64("key", F.least("x", "y"), F.greatest("x", "y"))
        dealt = dealt.unionByName(blocks.select(F.when(F.col("c") == 1, F.col("key")).otherwise(block).alias("g"), "fp", "node"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        names = ["a", "b"]

        def links(parts: list[tuple]) -> pa.RecordBatch:
            g, f, n = (np.concatenate([p[i] for p in parts]) for i in range(3))
            a, b = group_links(g, f, n, tau)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=names)

        for b in batches:
            g, f, n = b.column(0).to_numpy(), b.column(1).to_numpy().view(np.uint64), b.column(2).to_numpy()
            if not len(g):
                continue
            cut = int(np.searchsorted(g, g[-1]))  # the last group may go on
            if cut == 0 and (not held or held[-1][0][-1] == g[0]):
                held.append((g, f, n))
                continue
            held.append((g[:cut], f[:cut], n[:cut]))
            yield links(held)
            held = [(g[cut:], f[cut:], n[cut:])]
        if held:
            yield links(held)

    return dealt.repartition("g").sortWithinPartitions("g").mapInArrow(verify, "a long, b long").distinct()


def simhash(docs: DataFrame, text: str = "text", key: str = "doc_id", size: int = 3, seed: int = 42) -> DataFrame:
    """doc_id and fp (long, its 64 bits) of each row."""
    C.ship(docs.sparkSession)

    @C.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j in C.slices(b.column(1), 4 << 20):
                part = b.slice(i, j - i)
                fp = fingerprints(part.column(1), size, seed).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fp)], names=["doc_id", "fp"])

    plain = docs.select(docs[f"`{key}`"].cast("long").alias("doc_id"), docs[f"`{text}`"].cast("string").alias("text"))
    return plain.mapInArrow(run, "doc_id long, fp long")


def named_fingerprints(prints: DataFrame, tau: int) -> DataFrame:
    """fp and component_id of each fingerprint.  prints: a stored table of doc_id and fp."""
    distinct = C.table(prints.groupBy("fp").agg(F.min("doc_id").alias("node")), "distinct")
    found = components(link(distinct.where("node is not null"), tau), "a", "b")
    return distinct.join(found, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", tau: int = 3, size: int = 3, seed: int = 42) -> DataFrame:
    """doc_id, fp and component_id (the smallest doc_id reachable by links) of each row."""
    prints = C.table(simhash(docs, text, key, size, seed), "fingerprints")
    return prints.join(named_fingerprints(prints, tau), "fp").select("doc_id", "fp", "component_id")


def representatives(docs: DataFrame, text: str = "text", key: str = "doc_id", tau: int = 3, size: int = 3) -> DataFrame:
    """The rows of docs whose doc_id names its component, in the same columns.

    Of repeated rows of one doc_id that of the least hash of its columns stays; rows with a null doc_id all stay.
    """
    own = docs.where(docs[f"`{key}`"].isNotNull())
    prints = C.table(simhash(own, text, key, size), "fingerprints")
    name = C.fresh(docs, "_keep")
    found = prints.join(named_fingerprints(prints, tau), "fp").where("doc_id = component_id").select(F.col("doc_id").alias(name)).distinct()
    kept = own.join(found, own[f"`{key}`"].cast("long") == found[name], "left_semi")
    return C.first_of_each(kept, key).unionByName(docs.where(docs[f"`{key}`"].isNull()))
