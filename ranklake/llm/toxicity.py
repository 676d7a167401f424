"""Toxicity by a factorization machine over hashed terms (operator 10).

Method: a text's terms (its words, lower-cased without punctuation at their ends,
and the words' beginnings) are hashed.  A factorization machine adds to linear
weights an interaction of every pair of terms, the product of their factors, so
that a pair can mean what neither term means alone.  It learns from a bounded
sample of labelled rows: of either label the ``SAMPLE`` rows of least hash of
doc_id, whole texts of any length.  Tasks take the sampled texts apart; terms are
counted over the sample in a shuffle and chosen by how unevenly the labels share
them; one task then trains in numpy on rows that name chosen terms only (at most
2 * SAMPLE rows of TERMS + COMMON).  The driver sees the chosen terms and the
finished machine, never texts.

Defined results: null and empty texts have no terms and get the score of the
bias; without labels of both kinds every score is the share of toxic labels (0.5
without labels); labels other than 0 and 1 don't count; only the first label of a
doc_id counts, ordered by its value; of several rows of a sampled doc_id one is
learned from, that of the least hash of its terms; very long texts are a slice by
themselves; an empty table gives an empty table; columns besides the named ones
are carried along, whatever their names.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Labelled rows of each kind to learn from, terms, and factors of a term.
SAMPLE, TERMS, FACTORS = 4000, 8192, 8
#: Nats by which the labels must share a term unevenly (of 1, 3, 5 and 7 the least log loss on a fifth of the training
#: rows, the others learned from), and frequent terms taken anyhow.
GAIN, COMMON = 7.0, 256
ENDS = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "«»„“”‘’…–—¿¡"
STEMS = (4, 5, 6)
#: Bytes of text taken apart at once.
STEP = 3 << 20


def word_terms(word: str) -> list[int]:
    """Hashes of a word and of its beginnings; none if only punctuation is left."""
    w = word.strip(ENDS).lower()
    if not w:
        return []
    of = xxhash.xxh64_intdigest
    return [of("=" + w), *(of("^" + w[:n]) for n in STEMS if len(w) > n)]


class Terms:
    """Term sets of texts, by way of the distinct words of a batch."""

    def __init__(self, vocabulary: np.ndarray | None = None) -> None:
        self.vocabulary = vocabulary  # sorted hashes, or all terms

    def of(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(row, term) pairs, each once; terms are hashes, or their places in the vocabulary."""
        lists = pc.ascii_split_whitespace(C.texts(column))
        coded = lists.values.dictionary_encode()
        hashes = [word_terms(w) for w in coded.dictionary.to_pylist()]
        n = np.fromiter(map(len, hashes), np.int64, len(hashes))
        flat = np.fromiter((h for hs in hashes for h in hs), np.uint64, int(n.sum()))
        owner = np.repeat(np.arange(len(hashes)), n)
        if self.vocabulary is not None:
            at = np.searchsorted(self.vocabulary, flat)
            at[at == len(self.vocabulary)] = 0
            known = self.vocabulary[at] == flat if len(self.vocabulary) else np.zeros(len(flat), bool)
            flat, owner = at[known], owner[known]
        n = np.bincount(owner, minlength=len(hashes))
        begin = np.cumsum(n) - n
        use = coded.indices.to_numpy()
        row = np.repeat(np.arange(len(column)), np.diff(lists.offsets.to_numpy()))
        some = n[use] > 0
        use, row = use[some], row[some]
        per = n[use]
        where = np.repeat(begin[use] - (np.cumsum(per) - per), per) + np.arange(int(per.sum()))
        row, term = np.repeat(row, per), flat[where]
        order = np.lexsort((term, row))
        row, term = row[order], term[order]
        once = np.append(True, (row[1:] != row[:-1]) | (term[1:] != term[:-1])) if len(row) else np.zeros(0, bool)
        return row[once], term[once]


class Machine:
    """score = sigmoid(bias + sum of weights + sum over pairs of factor products), a term counting 1."""

    def __init__(self, vocabulary: np.ndarray, bias: float, weight: np.ndarray, factor: np.ndarray) -> None:
        self.vocabulary, self.bias, self.weight, self.factor = vocabulary, bias, weight, factor

    def margins(self, rows: int, row: np.ndarray, term: np.ndarray) -> np.ndarray:
        out = np.full(rows, self.bias)
        if not len(row):
            return out
        starts = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
        v = self.factor[term]
        total = np.add.reduceat(v, starts)
        pairs = 0.5 * (total**2 - np.add.reduceat(v**2, starts)).sum(axis=1)
        out[row[starts]] += np.add.reduceat(self.weight[term], starts) + pairs
        return out

    def scores(self, column: pa.Array) -> np.ndarray:
        row, term = Terms(self.vocabulary).of(column)
        return 1 / (1 + np.exp(-np.clip(self.margins(len(column), row, term), -50, 50)))


def tallies(texts: pa.Array, label: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Terms, in how many texts each is, and in how many texts of label 1; slice after slice."""
    names, seen, pos = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0)
    for i, j in C.slices(texts, STEP):
        row, term = Terms().of(texts.slice(i, j - i))
        own, back = np.unique(term, return_inverse=True)
        both, at = np.unique(np.concatenate([names, own]), return_inverse=True)
        seen = np.bincount(at, weights=np.concatenate([seen, np.bincount(back, minlength=len(own))]), minlength=len(both)).astype(np.int64)
        pos = np.bincount(at, weights=np.concatenate([pos, np.bincount(back, weights=label[i:j][row], minlength=len(own))]), minlength=len(both))
        names = both
    return names, seen, pos


def choose(names: np.ndarray, seen: np.ndarray, pos: np.ndarray, share: float, most: int = TERMS, common: int = COMMON) -> np.ndarray:
    """The terms that the labels share most unevenly, by log-likelihood ratio, and the most frequent
    ones, which may mean something in pairs only; all in two texts at least."""
    expect = seen * share

    def part(had, hoped):
        return np.where(had > 0, had * np.log(np.maximum(had, 1e-12) / np.maximum(hoped, 1e-12)), 0)

    gain = part(pos, expect) + part(seen - pos, seen - expect)
    gain[seen < 2] = 0
    best = np.argsort(-gain, kind="stable")[:most]
    often = np.argsort(-seen, kind="stable")[:common]
    return np.unique(names[np.concatenate([best[gain[best] > GAIN], often[seen[often] >= 2]])])


def train(texts: pa.Array, label: np.ndarray, rounds: int = 15, rate: float = 0.1, seed: int = 7) -> Machine:
    """The machine of texts in memory."""
    label = label.astype(float)
    if (m := constant(label)) is not None:
        return m
    vocabulary = choose(*tallies(texts, label), float(label.mean()))
    known, rows, terms = Terms(vocabulary), [], []
    for i, j in C.slices(texts, STEP):
        r, t = known.of(texts.slice(i, j - i))
        rows.append((r + i).astype(np.int32))
        terms.append(t.astype(np.int32))
    return learn(vocabulary, np.concatenate(rows), np.concatenate(terms), label, rounds, rate, seed)


def constant(label: np.ndarray) -> Machine | None:
    """The machine of labels that aren't of both kinds."""
    if len(label) and label.min() != label.max():
        return None
    share = min(max(float(label.mean()), 1e-6), 1 - 1e-6) if len(label) else 0.5
    return Machine(np.zeros(0, np.uint64), float(np.log(share / (1 - share))), np.zeros(1), np.zeros((1, FACTORS)))


def learn(vocabulary: np.ndarray, row: np.ndarray, term: np.ndarray, label: np.ndarray, rounds: int = 15, rate: float = 0.1, seed: int = 7) -> Machine:
    """Adagrad on logistic loss over (row, place in the vocabulary) pairs; the two labels weigh by the square root of their numbers."""
    n, rng = len(label), np.random.default_rng(seed)
    m = Machine(vocabulary, 0.0, np.zeros(max(len(vocabulary), 1)), rng.normal(0, 0.02, (max(len(vocabulary), 1), FACTORS)))
    cost = np.where(label > 0, (n / (2 * label.sum())) ** 0.5, (n / (2 * (n - label.sum()))) ** 0.5)
    ends = np.searchsorted(row, np.arange(n + 1))
    gw, gv, gb = np.full(len(m.weight), 1e-3), np.full(m.factor.shape, 1e-3), 1e-3
    for _ in range(rounds):
        order = rng.permutation(n)
        for i in range(0, n, 128):
            some = np.sort(order[i : i + 128])
            size = ends[some + 1] - ends[some]
            pick = np.repeat(ends[some] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
            r, t = np.repeat(np.arange(len(some)), size), term[pick]
            total = np.zeros((len(some), FACTORS))
            v = m.factor[t]
            if len(t):
                starts = np.flatnonzero(np.append(True, r[1:] != r[:-1]))
                total[r[starts]] = np.add.reduceat(v, starts)
            err = cost[some] * (1 / (1 + np.exp(-np.clip(m.margins(len(some), r, t), -50, 50))) - label[some]) / len(some)
            own, back = np.unique(t, return_inverse=True)
            dw = np.bincount(back, weights=err[r], minlength=len(own)) + 1e-5 * m.weight[own]
            each = err[r, None] * (total[r] - v)
            dv = np.stack([np.bincount(back, weights=each[:, k], minlength=len(own)) for k in range(FACTORS)], axis=1) + 1e-4 * m.factor[own]
            db = float(err.sum())
            gw[own] += dw**2
            gv[own] += dv**2
            gb += db**2
            m.weight[own] -= rate * dw / np.sqrt(gw[own])
            m.factor[own] -= 0.3 * rate * dv / np.sqrt(gv[own])
            m.bias -= rate * db / gb**0.5
    return m


def sample(docs: DataFrame, labels: DataFrame, text: str, key: str, label: str, most: int = SAMPLE) -> DataFrame:
    """A stored table of doc_id, label and terms (distinct hashes) of at most ``most`` labelled rows of either kind,
    those of least hash of doc_id."""
    C.ship(docs.sparkSession)
    marks = labels.select(labels[f"`{key}`"].cast("long").alias("doc_id"), labels[f"`{label}`"].cast("int").alias("label")).where("label in (0, 1)")
    marks = marks.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0).groupBy("doc_id").agg(F.min("label").alias("label"))
    chosen = None
    for k in (1, 0):
        one = marks.where(F.col("label") == k).orderBy(F.xxhash64("doc_id", F.lit(10)), "doc_id").limit(most)
        chosen = one if chosen is None else chosen.unionByName(one)

    @C.lean
    def apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j in C.slices(b.column(2), STEP):
                part = b.slice(i, j - i)
                row, term = Terms().of(part.column(2))
                at = np.searchsorted(row, np.arange(j - i + 1)).astype(np.int32)
                digest = [xxhash.xxh64_intdigest(term[x:y].tobytes()) >> 1 for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                lists = pa.ListArray.from_arrays(pa.array(at), pa.array(term.view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(digest, pa.int64()), lists], names=["doc_id", "label", "digest", "terms"])

    plain = docs.select(docs[f"`{key}`"].cast("long").alias("doc_id"), F.coalesce(docs[f"`{text}`"].cast("string"), F.lit("")).alias("text"))
    rows = plain.join(F.broadcast(chosen), "doc_id").select("doc_id", "label", "text")  # at most 2 * most rows
    found = rows.mapInArrow(apart, "doc_id long, label int, digest long, terms array<long>")
    once = found.groupBy("doc_id").agg(F.min(F.struct("digest", "label", "terms")).alias("x"))
    return C.table(once.select("doc_id", "x.label", "x.terms"), "sample")


def vocabulary_of(rows: DataFrame, n: int, toxic: int, most: int = TERMS, common: int = COMMON, gain: float = GAIN) -> np.ndarray:
    """What choose() takes from the terms of a sample of n rows, counted in a shuffle."""
    share = toxic / n
    seen = rows.select("label", F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").cast("double").alias("seen"), F.sum("label").cast("double").alias("pos")).where("seen >= 2")

    def part(had, hoped):
        return F.when(had > 0, had * F.log(had / hoped)).otherwise(0.0)

    expect, seen_, pos = F.col("seen") * share, F.col("seen"), F.col("pos")
    scored = C.table(seen.withColumn("gain", part(pos, expect) + part(seen_ - pos, seen_ - expect)), "terms")
    sign = F.col("term") < 0  # hashes are unsigned
    best = scored.where(F.col("gain") > gain).orderBy(F.desc("gain"), sign, "term").limit(most).select("term")
    often = scored.orderBy(F.desc("seen"), sign, "term").limit(common).select("term")
    return np.unique(best.unionByName(often).toArrow()["term"].to_numpy().view(np.uint64))


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic", gain: float = GAIN) -> Machine:
    rows = sample(docs, labels, text, key, label)
    n, toxic = rows.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    if (m := constant(np.repeat([1.0, 0.0], [toxic, n - toxic]))) is not None:
        return m
    vocabulary = vocabulary_of(rows, n, toxic, gain=gain)
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for b in batches:
            terms = b.column(2)
            flat = terms.flatten().to_numpy().view(np.uint64)
            of = np.repeat(np.arange(len(terms)), np.diff(terms.offsets.to_numpy()))
            at = np.minimum(np.searchsorted(own, flat), max(len(own) - 1, 0))
            hit = own[at] == flat if len(own) else np.zeros(len(flat), bool)
            ends = np.searchsorted(of[hit], np.arange(len(terms) + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.ListArray.from_arrays(pa.array(ends), pa.array(at[hit].astype(np.int32)))], names=["doc_id", "label", "terms"])

    @C.lean
    def trained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches)).sort_by("doc_id").combine_chunks()
        lists = t["terms"].combine_chunks()
        row = np.repeat(np.arange(t.num_rows, dtype=np.int32), np.diff(lists.offsets.to_numpy()))
        m = learn(shared.value, row, lists.flatten().to_numpy(), t["label"].to_numpy().astype(float))
        values = np.concatenate([[m.bias], m.weight, m.factor.ravel()])
        yield pa.RecordBatch.from_arrays([pa.array([values.tobytes()])], names=["machine"])

    one = rows.mapInArrow(known, "doc_id long, label int, terms array<int>").coalesce(1).mapInArrow(trained, "machine binary")
    values = np.frombuffer(one.first()[0])
    size = max(len(vocabulary), 1)
    return Machine(vocabulary, float(values[0]), values[1 : size + 1], values[size + 1 :].reshape(size, FACTORS))


def score(docs: DataFrame, machine: Machine, text: str = "text", name: str = "score") -> DataFrame:
    """docs with a column of scores from 0 to 1."""
    spark = docs.sparkSession
    C.ship(spark)
    shared = spark.sparkContext.broadcast((machine.vocabulary, machine.bias, machine.weight, machine.factor))

    @C.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Machine(*shared.value)
        for b in batches:
            last = b.num_columns - 1
            for i, j in C.slices(b.column(last), STEP):
                part = b.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(last)), pa.array(own.scores(part.column(last)))], names=[*(f"c{k}" for k in range(last)), "s"])

    inner = docs.select(*[docs[f"`{c}`"].alias(f"c{i}") for i, c in enumerate(docs.columns)], docs[f"`{text}`"].cast("string").alias("t"))
    ddl = ", ".join([*(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(docs.schema)), "s double"])
    return inner.mapInArrow(run, ddl).toDF(*docs.columns, name)


def classify(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic") -> DataFrame:
    """doc_id, held_out, score and predicted of each row of docs."""
    plain = C.only(docs, doc_id=docs[f"`{key}`"].cast("long"), text=text)
    machine = fit(plain, labels.select(labels[f"`{key}`"].alias("doc_id"), labels[f"`{label}`"].alias("label")), "text", "doc_id", "label")
    out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    scored = score(plain, machine)
    return scored.select("doc_id", F.coalesce(out, F.lit(True)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
