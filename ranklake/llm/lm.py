"""Language-model scores by a log-bilinear model (operator 4).

Method: the vocabulary is the most frequent training words (at least ``LEAST``
times; at most ``VOCAB``), so that it grows with the corpus; other words fall
into rest classes by their last letters.  A log-bilinear model predicts the next
word from the two before it, each with a vector of its own, in two levels: first
a group (the end of a text, ``GROUP`` words of about equal frequency, or a rest
class), then the word within its group.  Both levels are trained in numpy by
noise-contrastive estimation, and batched matrix products normalise each exactly.
A word of a rest class has its smoothed share of the class, so that

    p(word | before) = p(class | before) * (c + 0.5) / (C + 0.5 * (V + 1))

with c, C and V the counts of the word, the class and its distinct words, sums
to one over all words, an unknown one in each class included.

Training texts are dealt to shards of about ``SHARD_TOKENS`` by a hash of doc_id
and text, and ordered by another one; each shard learns alone from the common
start, and the shards' parameters are averaged in a fixed order.  So the model
does not depend on how the table is partitioned.

Exact counts of all training words are kept in a table.  The most frequent
words (``HEAD``, a bounded broadcast) are looked up in memory, so the join with
that table only meets rare words.

Defined results: null and empty texts are just their end; rows with a null
doc_id are held out; repeated rows are scored (and learned from) each by itself;
words of equal count are ordered by their bytes; without training texts all
counts are zero and both scores are those of chance; an empty table gives an
empty table; a very long text is a slice by itself; columns besides key and text
are not read.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Words looked up in memory; words with vectors at most, their least count, words to a group; classes of the rest.
HEAD, VOCAB, LEAST, GROUP, REST = 131_072, 16_384, 5, 128, 64
#: Width of the model; noise words to a batch of the first level and to a token of the second; tokens in a batch;
#: text at once; training tokens to a shard, about, and shards at most.  The batch is a compromise of the gain on a quarter
#: of the training rows and of time.
WIDTH, NOISE, NOISE_WITHIN, BATCH, SLICE, SHARD_TOKENS, SHARDS = 24, 32, 2, 1024, 4 << 20, 2_000_000, 4096


def words_of(column: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words (A-Z in lower case), the place of each occurrence, and where each text begins."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(C.texts(column)))
    coded = lists.values.dictionary_encode()
    use, at = coded.indices.to_numpy(), lists.offsets.to_numpy().astype(np.int64)
    empty = pc.binary_length(coded.dictionary).to_numpy() == 0
    if empty.any():  # what splitting leaves at a text's ends
        real = ~empty[use]
        before = np.concatenate([[0], np.cumsum(real)])
        use, at = use[real], before[at]
    return coded.dictionary, use, at


class Symbols:
    """Numbers of words: 0 for the end, then the vocabulary by falling frequency, then classes by the last two bytes."""

    def __init__(self, vocabulary: pa.Array) -> None:
        self.words, self.size = vocabulary, len(vocabulary)

    def of(self, words: pa.Array, place: np.ndarray | None = None) -> np.ndarray:
        """place: that of each word in a list that begins with the vocabulary, or -1."""
        if place is None:
            place = lookup(words, self.words)
        out = place.astype(np.int64) + 1
        rest = np.flatnonzero((place < 0) | (place >= self.size))
        if len(rest):
            at = np.frombuffer(words.buffers()[1], np.int32, len(words) + 1, words.offset * 4).astype(np.int64)
            data = np.frombuffer(words.buffers()[2] or b"\0", np.uint8).astype(np.int32)
            end, long = at[rest + 1], at[rest + 1] - at[rest] > 1
            code = np.where(long, data[np.maximum(end - 2, 0)] << 8, 1 << 16) | data[np.maximum(end - 1, 0)]
            out[rest] = 1 + self.size + tail_classes()[code]
        return out


@functools.lru_cache(maxsize=1)
def tail_classes() -> np.ndarray:
    """The rest class of each end of two bytes, and after these of each word of one byte."""
    tails = [bytes(divmod(x, 256)) for x in range(1 << 16)] + [bytes([x]) for x in range(256)]
    return np.array([xxhash.xxh32_intdigest(t) % REST for t in tails])


def lookup(words: pa.Array, among: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.index_in(words, value_set=among), -1).to_numpy(zero_copy_only=False)


def stream(cls: np.ndarray, use: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Class of each token with an end after each text, of the token before and of the one before that
    (the end at the start of a text); and where each text begins in these."""
    n = np.diff(at)
    starts = at[:-1] + np.arange(len(n))
    out = np.zeros(int(at[-1]) + len(n), np.int64)
    is_word = np.ones(len(out), bool)
    is_word[starts + n] = False
    out[is_word] = cls[use]
    one, two = np.zeros_like(out), np.zeros_like(out)
    one[1:], two[2:] = out[:-1], out[:-2]
    one[starts] = 0
    two[starts] = 0
    two[starts[n > 0] + 1] = 0
    return out, one, two, starts


def scatter(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows and the sums of their values."""
    order = np.argsort(rows.astype(np.uint16), kind="stable")
    rows = rows[order]
    first = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
    return rows[first], np.add.reduceat(values[order], first)


class Model:
    """A context's vector is h = r[one] c1 + r[two] c2, and a 1 after it for biases; a group g scores h . q1[g], a word w in its group h . q2[w].

    share: of each symbol among the training tokens.  All in float32.
    """

    NAMES = ("r", "c1", "c2", "q1", "q2")

    def __init__(self, share: np.ndarray, flat: np.ndarray | None = None, width: int = WIDTH, seed: int = 4) -> None:
        self.symbols, self.vocabulary, self.width = len(share), len(share) - 1 - REST, width
        v, self.groups = self.vocabulary, -(-self.vocabulary // GROUP)
        every = np.arange(self.symbols)
        self.level = np.where(every == 0, 0, np.where(every <= v, 1 + (every - 1) // GROUP, self.groups + every - v))
        first = np.bincount(self.level, weights=share)
        self.first_share = first / first.sum()
        words = np.maximum(share[1 : v + 1], 1e-12)
        self.sums = np.cumsum(words)
        ends = np.minimum(np.arange(1, self.groups + 1) * GROUP, v) - 1
        self.ends = self.sums[ends] if v else np.zeros(0)
        self.begins = np.append(0.0, self.ends[:-1]) if v else np.zeros(0)
        self.within = words / (self.ends - self.begins)[np.arange(v) // GROUP] if v else words
        shapes = {"r": (self.symbols, width), "c1": (width, width), "c2": (width, width), "q1": (len(first), width + 1), "q2": (v, width + 1)}
        if flat is None:  # small random vectors; the biases alone give the shares
            rng, near = np.random.default_rng(seed), np.eye(width)
            made = [rng.normal(0, 0.3, shapes["r"]), near, 0.5 * near, rng.normal(0, 0.1, shapes["q1"]), rng.normal(0, 0.1, shapes["q2"])]
            made[3][:, -1], made[4][:, -1] = np.log(self.first_share), np.log(self.within)
        else:
            at = np.cumsum([0, *(int(np.prod(x)) for x in shapes.values())])
            made = [flat[i:j].reshape(x) for i, j, x in zip(at[:-1], at[1:], shapes.values(), strict=True)]
        for name, x in zip(self.NAMES, made, strict=True):
            setattr(self, name, np.array(x, np.float32))

    def flat(self) -> np.ndarray:
        return np.concatenate([getattr(self, n).ravel() for n in self.NAMES])

    def log_probs(self, w: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Natural log of p(w | one, two), for symbols; both levels are normalised over all their outcomes.

        Like tokens are scored once, and a level's sum is taken once for each context (and group).
        """
        n = self.symbols
        # the projections carry half of the 1 each
        p1, p2 = (np.pad(self.r @ c, ((0, 0), (0, 1)), constant_values=0.5) for c in (self.c1, self.c2))
        code, back = np.unique((one * n + two) * n + w, return_inverse=True)
        context, target = np.divmod(code, n)
        level = self.level[target]
        # in this order the rows of a context are neighbours, and in it those of a group
        new = np.append(True, context[1:] != context[:-1])[: len(code)]
        fresh = new | np.append(True, level[1:] != level[:-1])[: len(code)]
        contexts, a, b = context[new], *np.divmod(context, n)
        norm = np.empty(len(contexts), np.float32)
        for i in range(0, len(contexts), 8192):
            x, y = np.divmod(contexts[i : i + 8192], n)
            norm[i : i + 8192] = log_sum(p1[x] + p2[y], self.q1)
        out = -norm[np.cumsum(new) - 1].astype(float)
        known = (target > 0) & (target <= self.vocabulary)
        # the second level, group by group
        heads = np.flatnonzero(fresh & known)
        heads = heads[np.argsort(level[heads].astype(np.uint16), kind="stable")]
        edges = np.searchsorted(level[heads], np.arange(1, self.groups + 2))
        inner = np.zeros(len(code), np.float32)
        for g in range(self.groups):
            words = slice(g * GROUP, min((g + 1) * GROUP, self.vocabulary))
            for i in range(int(edges[g]), int(edges[g + 1]), 8192):
                rows = heads[i : min(i + 8192, int(edges[g + 1]))]
                inner[rows] = log_sum(p1[a[rows]] + p2[b[rows]], self.q2[words])
        out -= inner[np.flatnonzero(fresh)[np.cumsum(fresh) - 1]]
        for i in range(0, len(code), 1 << 16):
            k = slice(i, i + (1 << 16))
            h, own = p1[a[k]] + p2[b[k]], known[k]
            out[k] += np.einsum("nd,nd->n", h, self.q1[level[k]])
            out[k][own] += np.einsum("nd,nd->n", h[own], self.q2[target[k][own] - 1])
        return out[back]

    def learn(self, w: np.ndarray, one: np.ndarray, two: np.ndarray, state: dict, rng, rate: float = 0.1) -> None:
        """One pass of noise-contrastive estimation over the tokens, alike ones together."""
        n, steps = self.symbols, 1 << 12
        # words of a group at even steps of its share: what noise is drawn from
        middle = (np.arange(steps) + 0.5) / steps
        draws = np.searchsorted(self.sums, self.begins[:, None] + middle * (self.ends - self.begins)[:, None]) if self.vocabulary else np.zeros((0, steps), np.int64)
        draws = np.minimum(draws, max(self.vocabulary - 1, 0)).astype(np.int32)
        first_draws = np.searchsorted(np.cumsum(self.first_share), (np.arange(1 << 16) + 0.5) / (1 << 16)).clip(0, len(self.first_share) - 1)
        code, weight = np.unique((one * n + two) * n + w, return_counts=True)
        order = rng.permutation(len(code))
        code, weight = code[order], weight[order].astype(np.float32)
        noise_bias = np.log(NOISE * self.first_share).astype(np.float32)
        within_bias = np.log(NOISE_WITHIN * self.within).astype(np.float32)

        for name in self.NAMES:
            if name not in state:
                state[name] = np.full(getattr(self, name).shape, 1e-4, np.float32)

        def step(name: str, grad: np.ndarray, rows=slice(None)) -> None:
            seen = state[name][rows] + grad * grad
            state[name][rows] = seen
            getattr(self, name)[rows] -= rate * grad / np.sqrt(seen)

        for i in range(0, len(code), BATCH):
            k = slice(i, i + BATCH)
            context, target = np.divmod(code[k], n)
            a, b = np.divmod(context, n)
            wt = weight[k] / weight[k].sum()
            ra, rb = self.r[a], self.r[b]
            h = np.ones((len(a), self.width + 1), np.float32)
            h[:, :-1] = ra @ self.c1 + rb @ self.c2
            # first level: one noise sample for all
            own, noise = self.level[target], first_draws[rng.integers(0, 1 << 16, NOISE)]
            q, qn = self.q1[own], self.q1[noise]
            ed = -wt * off(np.einsum("nd,nd->n", h, q) - noise_bias[own])
            ef = wt[:, None] * (1 - off(h @ qn.T - noise_bias[noise]))
            dh = ed[:, None] * q + ef @ qn
            first = scatter(np.concatenate([own, noise]), np.concatenate([ed[:, None] * h, ef.T @ h]))
            # second level: noise from the word's own group
            has = np.flatnonzero((target > 0) & (target <= self.vocabulary))
            if len(has):
                word, hh, wh = target[has] - 1, h[has], wt[has]
                g = word // GROUP
                other = draws[g[:, None], rng.integers(0, steps, (len(has), NOISE_WITHIN), dtype=np.uint16)]
                q, qn = self.q2[word], self.q2[other]
                ed = -wh * off(np.einsum("nd,nd->n", hh, q) - within_bias[word])
                ef = wh[:, None] * (1 - off((qn @ hh[:, :, None])[:, :, 0] - within_bias[other]))
                dh[has] += ed[:, None] * q + (ef[:, None, :] @ qn)[:, 0]
                at, total = scatter(np.concatenate([word, other.ravel()]), np.concatenate([ed[:, None] * hh, (ef[:, :, None] * hh[:, None, :]).reshape(-1, self.width + 1)]))
                step("q2", total, at)
            dh = dh[:, :-1]
            at, total = scatter(np.concatenate([a, b]), np.concatenate([dh @ self.c1.T, dh @ self.c2.T]))
            c1, c2 = ra.T @ dh, rb.T @ dh
            step("q1", first[1], first[0])
            step("r", total, at)
            step("c1", c1)
            step("c2", c2)


def off(x: np.ndarray) -> np.ndarray:
    """1 / (1 + exp(x))"""
    with np.errstate(over="ignore"):
        return 1 / (1 + np.exp(x))


def log_sum(h: np.ndarray, q: np.ndarray) -> np.ndarray:
    """log of the sum of exp(h . q) over all rows of q."""
    s = h @ q.T
    top = np.float32(0.0)
    if len(s) and (h * h).sum(axis=1).max() * (q * q).sum(axis=1).max() > 60.0**2:  # else no sum can leave the range of floats
        top = s.max(axis=1)
        s -= top[:, None]
    np.exp(s, out=s)
    return top + np.log(s.sum(axis=1))


def plain(docs: DataFrame, text: str, key: str) -> DataFrame:
    out = F.crc32(docs[f"`{key}`"].cast("long").cast("string").cast("binary")) % 5 == 1
    return docs.select(docs[f"`{key}`"].cast("long").alias("doc_id"), F.coalesce(out, F.lit(True)).alias("held_out"), docs[f"`{text}`"].cast("string").alias("text"))


def count_words(texts: DataFrame) -> DataFrame:
    """word and c, over all texts; the empty word stands for the end.  Tasks add up their own words first."""
    schema = pa.schema([("word", pa.string()), ("c", pa.int64())])

    @C.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j in C.slices(b.column(0), 2 * SLICE):
                words, use, _ = words_of(b.column(0).slice(i, j - i))
                n = np.bincount(use, minlength=len(words))
                some = pa.array(np.flatnonzero(n))
                yield pa.RecordBatch.from_arrays([words.take(some), pa.array(n[n > 0].astype(np.int64))], schema=schema)
                yield C.batch(schema, [""], [j - i])

    return texts.select("text").mapInArrow(run, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


def average(parts: DataFrame, n: int, fan: int = 16) -> np.ndarray | None:
    """Weighted mean of the rows (part under n, weight, value: float32 bytes) in the order of part, ``fan`` rows to a task and again.

    The rows go straight to the tasks that merge them; only means are stored.
    """

    @C.lean
    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total, weight = None, None, 0.0
        out = lambda: pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([weight]), pa.array([(total / weight).astype(np.float32).tobytes()])], names=["part", "weight", "value"])
        for b in batches:
            for p, w, v in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if p // fan != now and now is not None:
                    yield out()
                    total, weight = None, 0.0
                x = np.frombuffer(v, np.float32).astype(float) * w
                total = x if total is None else total + x
                now, weight = p // fan, weight + w
        if now is not None:
            yield out()

    ddl = "part int, weight double, value binary"
    while True:
        groups = C.pieces(n, fan)
        dealt = parts.repartitionById(groups, F.floor(F.col("part") / fan).cast("int"))
        parts, n = C.table(dealt.sortWithinPartitions("part").mapInArrow(merge, ddl), "means"), groups
        if n == 1:
            break
    one = parts.first()  # a single model
    return None if one is None else np.frombuffer(one["value"], np.float32)


def train(learn: DataFrame, vocabulary: pa.Array, share: np.ndarray, tokens: int) -> Model:
    """The mean of the shards' models, each after one pass over its texts.  learn: doc_id and text."""
    spark = learn.sparkSession
    shared = spark.sparkContext.broadcast((vocabulary, share))
    shards = min(C.pieces(tokens, SHARD_TOKENS), SHARDS)

    @C.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words_known, own = shared.value
        me, model, state, rng, seen = None, None, {}, None, 0
        symbols = Symbols(words_known)
        for b in batches:
            if not b.num_rows:
                continue
            if me is None:
                me = b.column(0)[0].as_py()
                model, rng = Model(own), np.random.default_rng(me)
            for i, j in C.slices(b.column(1), SLICE):
                words, use, at = words_of(b.column(1).slice(i, j - i))
                w, one, two, _ = stream(symbols.of(words), use, at)
                model.learn(w, one, two, state, rng)
                seen += len(w)
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([me], pa.int32()), pa.array([float(seen)]), pa.array([model.flat().tobytes()])], names=["part", "weight", "value"])

    rows = learn.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(shards)).cast("int").alias("shard"), "text", F.xxhash64("doc_id", "text", F.lit(7)).alias("order"), "doc_id")
    dealt = rows.repartitionById(shards, "shard").sortWithinPartitions("order", "doc_id").select("shard", "text")
    flat = average(dealt.mapInArrow(run, "part int, weight double, value binary"), shards)
    return Model(share, flat)


def score(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each row."""
    spark = docs.sparkSession
    C.ship(spark)
    rows = plain(docs, text, key)
    learn = rows.where("not held_out")
    counts = C.table(count_words(learn), "words")
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    top = counts.where("word != ''").orderBy(F.desc("c"), "word").limit(HEAD).toArrow()
    ends = counts.where("word = ''").agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    head, head_counts = top["word"].combine_chunks(), top["c"].to_numpy()
    vocabulary = head.slice(0, min(VOCAB, int((head_counts >= LEAST).sum())))
    known = len(vocabulary)
    # counts and distinct words of the rest's classes
    shared_words = spark.sparkContext.broadcast(vocabulary)

    def by_class(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbols = Symbols(shared_words.value)
        n, v = np.zeros(REST), np.zeros(REST)
        for b in batches:
            k = symbols.of(b.column(0)) - 1 - symbols.size
            rest = k >= 0
            n += np.bincount(k[rest], weights=b.column(1).to_numpy()[rest], minlength=REST)
            v += np.bincount(k[rest], minlength=REST)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(REST)), pa.array(n), pa.array(v)], names=["k", "n", "v"])

    found = counts.where("word != ''").select("word", "c").mapInArrow(by_class, "k long, n double, v double").groupBy("k").agg(F.sum("n"), F.sum("v")).collect()
    size, kinds = np.zeros(REST), np.zeros(REST)
    for k, n, v in found:
        size[k], kinds[k] = n, v
    share = np.concatenate([[ends], head_counts[:known], size]) + 0.5
    share /= share.sum()
    model = train(learn, vocabulary, share, int(total))
    within = np.log10(size + 0.5 * (kinds + 1))  # of the rest's classes
    base = float(np.log10(total + 0.5 * (distinct + 1)))
    end_log = float(np.log10(ends + 0.5))
    shared = spark.sparkContext.broadcast((head, known, np.log10(head_counts + 0.5), share, model.flat()))

    @C.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        in_memory, known, logs, own_share, flat = shared.value
        symbols, own = Symbols(in_memory.slice(0, known)), Model(own_share, flat)
        logs = np.append(logs, 0.0)
        for b in batches:
            for i, j in C.slices(b.column(2), SLICE):
                part = b.slice(i, j - i)
                words, use, at = words_of(part.column(2))
                place = lookup(words, in_memory)
                cls = symbols.of(words, place)
                w, one, two, starts = stream(cls, use, at)
                lp = own.log_probs(w, one, two) / np.log(10)
                neural = np.add.reduceat(lp, starts) if len(starts) else np.zeros(0)
                rest = (cls > known)[use]
                inner = logs[place] - within[np.maximum(cls - 1 - known, 0)]
                parts = (logs[place][use], (place >= 0)[use].astype(float), np.where(rest, inner[use], 0.0))
                sums = [segment_sums(values, at) for values in parts]
                # rare words of each text, each once
                far = np.flatnonzero((place < 0)[use])
                text_of = np.repeat(np.arange(j - i), np.diff(at))
                pair, n = np.unique(text_of[far] * len(words) + use[far], return_counts=True) if len(far) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
                owner, word = np.divmod(pair, max(len(words), 1))
                ends_at = np.searchsorted(owner, np.arange(j - i + 1)).astype(np.int32)
                rare = pa.ListArray.from_arrays(pa.array(ends_at), words.take(pa.array(word)))
                times = pa.ListArray.from_arrays(pa.array(ends_at), pa.array(n.astype(np.int32)))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(np.diff(at) + 1), *(pa.array(s) for s in sums), pa.array(neural), rare, times],
                    names=["doc_id", "held_out", "n_tokens", "logs", "known", "inner", "neural", "rare", "times"],
                )

    ddl = "doc_id long, held_out boolean, n_tokens long, logs double, known double, inner double, neural double, rare array<string>, times array<int>"
    scored = C.table(rows.mapInArrow(run, ddl).withColumn("rid", F.monotonically_increasing_id()), "scored")
    far = scored.where("size(rare) > 0").select("rid", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("rid", F.col("x.rare").alias("word"), F.col("x.times").alias("times"))
    told = far.join(counts, "word", "left")
    log_c = F.col("times") * F.log10(F.coalesce(F.col("c"), F.lit(0)) + 0.5)
    sums = told.groupBy("rid").agg(F.sum(log_c).alias("more"), F.sum(F.when(F.col("c").isNotNull(), F.col("times")).otherwise(0)).alias("more_known"))
    full = scored.drop("rare", "times").join(sums, "rid", "left")
    more = F.coalesce(F.col("more"), F.lit(0.0))
    n_known = F.col("known").cast("long") + F.coalesce(F.col("more_known"), F.lit(0)) + F.lit(1 if ends else 0)
    # all rare words are of the rest's classes; their share within a class lacks only log c
    return full.select(
        "doc_id",
        "held_out",
        F.col("n_tokens").cast("long").alias("n_tokens"),
        n_known.cast("long").alias("n_known"),
        F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("logs") + more + F.lit(end_log) - F.col("n_tokens") * F.lit(base)).alias("base_score"),
        (F.col("neural") + F.col("inner") + more).alias("score"),
    )


def segment_sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The sum of values[at[i] : at[i + 1]] for each i; 0 for none."""
    out = np.zeros(len(at) - 1)
    some = np.flatnonzero(at[1:] > at[:-1])
    if len(some):
        out[some] = np.add.reduceat(values, at[some])
    return out
