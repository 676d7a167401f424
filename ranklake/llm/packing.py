"""Packing texts into sequences of fixed length (operator 3).

Method: cutting stock by column generation.  A document of n tokens gives
floor(n / length) whole sequences and one remainder.  The histogram of the
remainders, in classes of ``GRAIN`` tokens, is covered by patterns (how many
remainders of each class share a sequence).  A linear program over patterns is
solved by revised simplex; a knapsack dynamic program prices new patterns until
none helps or the Farley bound shows that little is left to gain.  Patterns are
rounded down, what then is left over is packed first-fit by falling length, and
documents, ranked within their class, take the patterns' slots by arithmetic.
Remainders of at most ``SHORT`` tokens, for which a class is too coarse, first
form bundles of equal ones that fill whole classes exactly.  Only the histogram
(at most ``length`` counts) comes to the driver.

Defined results: a null or empty text still has its end id and so is packed;
repeated rows are packed each by itself; remainders of equal length are ranked by
row number; a very long text fills sequences of its own but for its remainder;
an empty table gives no pieces; columns besides key and text are not read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bpe
from . import common as C

#: Tokens to a class of remainders; remainders that form bundles; relative gap at which the linear program may stop.
GRAIN, SHORT, GAP = 8, 64, 3e-4
#: Documents of one remainder that are ranked together, about.
RANKED = 1000


def knapsack(value: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable multiset of items 1..len(value), of weight as numbered, within capacity."""
    n = min(len(value), capacity)
    best, took = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    gain = np.maximum(value[:n], 0)
    for c in range(1, capacity + 1):
        k = min(c, n)
        total = gain[:k] + best[c - k : c][::-1]
        i = int(total.argmax())
        if total[i] > best[c - 1]:
            best[c], took[c] = total[i], i + 1
        else:
            best[c] = best[c - 1]
    count, c = np.zeros(len(value), np.int64), capacity
    while c > 0:
        if took[c]:
            count[took[c] - 1] += 1
            c -= took[c]
        else:
            c -= 1
    return float(best[capacity]), count


def patterns(demand: np.ndarray, capacity: int, gap: float = GAP, most: int = 20_000) -> list[tuple[int, dict[int, int]]]:
    """How often to use which pattern for demand[i] items of weight i + 1.

    Each pattern is a dict from weight to number.  All demand is met exactly.
    """
    rows = np.flatnonzero(demand)
    if not len(rows):
        return []
    need = demand[rows].astype(float)
    fit = capacity // (rows + 1)
    columns = np.diag(fit.astype(float))
    inverse = np.diag(1 / fit)
    x = inverse @ need
    bound = (rows + 1) @ need / capacity
    value = np.zeros(len(demand))
    for _ in range(most):
        dual = inverse.sum(axis=0)
        value[rows] = dual
        top, count = knapsack(value, capacity)
        bound = max(bound, dual @ need / top)
        if top <= 1 + 1e-9 or x.sum() <= bound * (1 + gap):
            break
        enter = count[rows].astype(float)
        step = inverse @ enter
        up = step > 1e-9
        if not up.any():
            break
        ratio = np.where(up, x / np.where(up, step, 1), np.inf)
        leave = int(ratio.argmin())
        x -= ratio[leave] * step
        x[leave] = ratio[leave]
        np.maximum(x, 0, out=x)
        columns[:, leave] = enter
        row = inverse[leave] / step[leave]
        inverse -= np.outer(step, row)
        inverse[leave] = row
    left, out = demand.astype(np.int64).copy(), []
    for k in range(len(rows)):
        n = int(x[k] + 1e-6)
        used = {int(rows[i]) + 1: int(columns[i, k]) for i in np.flatnonzero(columns[:, k])}
        n = min([n, *(int(left[w - 1]) // c for w, c in used.items())])
        if n > 0:
            out.append((n, used))
            for w, c in used.items():
                left[w - 1] -= n * c
    rest: dict[tuple, int] = {}
    while left.any():  # what rounding left: fill one sequence after another, largest first
        room, used = capacity, {}
        for w in (np.flatnonzero(left)[::-1] + 1).tolist():
            if c := min(room // w, int(left[w - 1])):
                used[w] = c
                room -= c * w
        n = min(int(left[w - 1]) // c for w, c in used.items())
        for w, c in used.items():
            left[w - 1] -= n * c
        kind = tuple(sorted(used.items()))
        rest[kind] = rest.get(kind, 0) + n
    return out + [(n, dict(k)) for k, n in rest.items()]


def slots(found: list[tuple[int, dict[int, int]]]) -> tuple[np.ndarray, int]:
    """Rows (class, first rank, end rank, first sequence, items of the class per sequence), sorted; sequences in all."""
    rows, used, base = [], {}, 0
    for n, pattern in found:
        for w, c in pattern.items():
            start = used.get(w, 0)
            used[w] = start + n * c
            rows.append((w, start, start + n * c, base, c))
        base += n
    return np.array(sorted(rows), np.int64).reshape(-1, 5), base


class Items:
    """By remainder: how many rows make an item, its class, and which item of the class the first one is."""

    def __init__(self, counts: np.ndarray, grain: int, short: int = SHORT) -> None:
        r = np.arange(len(counts))
        self.per = np.array([grain // math.gcd(grain, x) if 0 < x <= short and x * grain < len(counts) else 1 for x in r.tolist()])
        self.bundles = counts // self.per * (r > 0)
        self.single = -(-r // grain)  # the class of a row by itself
        self.bundle = np.where(self.per > 1, self.per * r // grain, self.single)
        rest = np.where(self.per > 1, counts - self.bundles * self.per, 0) * (r > 0)
        demand = np.zeros(-(-len(counts) // grain) + 1, np.int64)
        self.first, self.first_rest = np.zeros(len(counts), np.int64), np.zeros(len(counts), np.int64)
        for x in r[1:].tolist():
            for own, n, w in ((self.first, self.bundles[x], self.bundle[x]), (self.first_rest, rest[x], self.single[x])):
                own[x] = demand[w]
                demand[w] += n
        self.demand = demand[1:]

    def of(self, r: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Class and place in it of the item that rows of a remainder and rank belong to."""
        item = rank // self.per[r]
        whole = item < self.bundles[r]
        place = np.where(whole, self.first[r] + item, self.first_rest[r] + rank - self.bundles[r] * self.per[r])
        return np.where(whole, self.bundle[r], self.single[r]), place


def assign(lengths: DataFrame, length: int = 2048, grain: int = GRAIN, ranked: int = RANKED) -> DataFrame:
    """Where the pieces of each row go.

    lengths: a stored table of ``rid`` (unique) and ``n`` tokens (1 at least).
    Returns rid, n, ``full_base`` (sequence of its first whole piece; the others
    follow), ``sequence_id`` and ``offset`` of its remainder (null: it has none).
    """
    spark = lengths.sparkSession
    C.ship(spark)
    whole = (F.col("n") / length).cast("long")
    rows = lengths.select("rid", "n", (F.col("n") % length).cast("int").alias("r"), whole.alias("m"))
    counts = np.zeros(length, np.int64)
    for r, n in rows.groupBy("r").count().collect():  # at most ``length`` counts
        counts[r] = n
    items = Items(counts, grain)
    table, sequences = slots(patterns(items.demand, length // grain))
    shared = spark.sparkContext.broadcast((table, items))
    # hot remainders are ranked in parts: within each, then the parts before
    parts = ",".join(map(str, (-(-counts // ranked)).clip(1).tolist()))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("rid"), F.split(F.lit(parts), ",")[F.col("r")].cast("long")))
    by = Window.partitionBy("r", "salt").orderBy("rid")
    each = rows.withColumn("k", F.row_number().over(by) - 1).withColumn("f", F.sum("m").over(by) - F.col("m"))
    groups = rows.groupBy("r", "salt").agg(F.count("*").alias("c"), F.sum("m").alias("q"))
    before = Window.partitionBy("r").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    within = groups.withColumn("c0", F.coalesce(F.sum("c").over(before), F.lit(0)))
    over = Window.orderBy("r").rowsBetween(Window.unboundedPreceding, -1)
    firsts = groups.groupBy("r").agg(F.sum("q").alias("qr"))  # a row for each remainder
    firsts = firsts.withColumn("q1", F.coalesce(F.sum("qr").over(over), F.lit(0))).select("r", "q1")
    within = within.withColumn("q0", F.coalesce(F.sum("q").over(before), F.lit(0))).join(firsts, "r")
    placed = each.join(within.select("r", "salt", "c0", "q0", "q1"), ["r", "salt"])
    placed = placed.select("rid", "n", "r", (F.col("k") + F.col("c0")).alias("rank"), (F.lit(sequences) + F.col("f") + F.col("q0") + F.col("q1")).alias("full_base"))
    schema = pa.schema([("rid", pa.int64()), ("n", pa.int64()), ("r", pa.int64()), ("full_base", pa.int64()), ("sequence_id", pa.int64())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, own = shared.value
        key = t[:, 0] << 40 | t[:, 1]
        for b in batches:
            r = b.column("r").to_numpy().astype(np.int64)
            w, item = own.of(r, b.column("rank").to_numpy())
            at = np.searchsorted(key, w << 40 | item, side="right") - 1
            has = r > 0
            seq = np.full(len(r), -1, np.int64)
            seq[has] = t[at[has], 3] + (item[has] - t[at[has], 1]) // t[at[has], 4]
            yield C.batch(schema, b.column("rid"), b.column("n").cast(pa.int64()), pa.array(r), b.column("full_base"), pa.array(seq, mask=~has))

    done = placed.mapInArrow(place, "rid long, n long, r long, full_base long, sequence_id long")
    inside = Window.partitionBy("sequence_id").orderBy(F.desc("r"), "rid").rowsBetween(Window.unboundedPreceding, -1)
    packed = done.where("sequence_id is not null").withColumn("offset", F.coalesce(F.sum("r").over(inside), F.lit(0)))
    return packed.unionByName(done.where("sequence_id is null").withColumn("offset", F.lit(None).cast("long"))).drop("r")


def with_end(ids: np.ndarray, end: int) -> np.ndarray:
    return np.append(ids, np.uint32(end)).astype("<u4")


def pack(docs: DataFrame, text: str = "text", key: str = "doc_id", length: int = 2048, end: int = 1, path: str | None = None) -> DataFrame:
    """Pieces of all rows: the key, start, length, doc_tokens, sequence_id, offset and ids array<int>."""
    plain = C.only(docs, doc_id=key, text=text)
    stored = C.table(bpe.encode(plain, path=path).select(F.monotonically_increasing_id().alias("rid"), "doc_id", F.concat("ids", F.array(F.lit(end))).alias("ids")), "tokens")
    plan = assign(stored.select("rid", F.size("ids").cast("long").alias("n")), length)
    return expand(stored.join(plan, "rid"), length, F.slice("ids", F.col("piece") * length + 1, length).alias("ids"), ["doc_id"])


def expand(joined: DataFrame, length: int, value, keys: list[str]) -> DataFrame:
    """A row for each piece; value may use ``piece``, its number."""
    each = joined.withColumn("piece", F.explode(F.sequence(F.lit(0), ((F.col("n") - 1) / length).cast("int"))))
    rest = F.col("piece") == (F.col("n") / length).cast("int")
    return each.select(
        *keys,
        (F.col("piece").cast("long") * length).alias("start"),
        F.when(rest, F.col("n") % length).otherwise(F.lit(length)).cast("long").alias("length"),
        F.col("n").alias("doc_tokens"),
        F.when(rest, F.col("sequence_id")).otherwise(F.col("full_base") + F.col("piece")).alias("sequence_id"),
        F.when(rest, F.col("offset")).otherwise(F.lit(0)).cast("long").alias("offset"),
        value,
    )


def pack_digests(docs: DataFrame, text: str = "text", key: str = "doc_id", length: int = 2048, end: int = 1, path: str | None = None) -> DataFrame:
    """pack() with a crc32 in place of each piece's ids; only lengths and checksums are stored and moved."""
    spark = docs.sparkSession
    C.ship(spark)
    file = bpe.tokenizer_path(path)
    shared = spark.sparkContext.broadcast(bpe.build_lexicon(docs, text, path))
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("crcs", pa.list_(pa.int64()))])

    @C.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = bpe.Codec.of(file, shared.value)
        for b in batches:
            for i, j in C.slices(b.column(1), bpe.SLICE):
                part = b.slice(i, j - i)
                ids, at = codec.encode(part.column(1))
                crcs = []
                for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                    own = with_end(ids[x:y], end)
                    crcs.append([zlib.crc32(own[k : k + length].tobytes()) for k in range(0, len(own), length)])
                yield C.batch(schema, part.column(0), np.diff(at) + 1, crcs)

    plain = docs.select(docs[f"`{key}`"].cast("long").alias("doc_id"), docs[f"`{text}`"].cast("string").alias("text"))
    coded = plain.mapInArrow(run, "doc_id long, n long, crcs array<long>").withColumn("rid", F.monotonically_increasing_id())
    stored = C.table(coded, "lengths")
    plan = assign(stored.select("rid", "n"), length)
    joined = stored.drop("n").join(plan, "rid")
    return expand(joined, length, F.element_at("crcs", F.col("piece") + 1).alias("ids_crc32"), ["doc_id"])
