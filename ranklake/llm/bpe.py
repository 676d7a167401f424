"""BPE encoding and decoding with a word lexicon (operator 1).

Method: the corpus' frequent words are compiled, with their ids, into a minimal
acyclic transducer (``lexicon``) that each Python worker maps into memory; words
it lacks are merged exactly, many at a time.  The lexicon only saves time: the
ids do not depend on it.  It is compiled in a task; the driver only passes the
buffer on.

A text is cut at ASCII white space, which the tokenizer drops and across which
nothing is merged, so that each word has its ids wherever it stands.

Defined results: null texts count as empty and have no ids; the strings of
special tokens in a text become their ids, as in the tokenizers library; rows
are kept one for one, repeated or not; an empty table gives an empty table; a
text longer than ``SLICE`` is a slice by itself; columns besides key and text
are never read, whatever their names.  A file whose normalizer or pre-tokenizer
is not the one these cuts are made for is refused.
"""

from __future__ import annotations

import functools
import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from . import lexicon as L

#: Words in the lexicon and bytes in one: with these its size is under 40 MB.
LEXICON_WORDS, LEXICON_BYTES = 131_072, 48
#: Text handled at once.
SLICE = 8 << 20
#: The longest piece that is merged side by side with others, and how many are.
SIDE_BY_SIDE, AT_ONCE = 48, 16_384
NONE = np.int32(1 << 30)
#: Words of these letters need no normalizer but lower case: ASCII, and U+00C0 to U+017F without signs and dotted I.
LETTERS = "À-ÖØ-öø-įı-ſ"
SIMPLE = re.compile(f"[\x00-\x08\x0e-\x1f\x21-\x7f{LETTERS}]+")
#: What a tokenizer file must say for words to be cut this way.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SIMPLE_PIECES = re.compile(rf"\n|'s|'t|'re|'ve|'m|'ll|'d|[a-z{LETTERS}]+|[0-9]|[^\t-\r a-z0-9{LETTERS}]+")


def tokenizer_path(path: str | None = None) -> str:
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return {b: chr(b) if b in own else chr(next(rest)) for b in range(256)}


class Merger:
    """Exact merges by rank, with word ends, of the pieces of a word."""

    def __init__(self, path: str) -> None:
        self.path = path
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        cuts = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        if model.get("type", "BPE") != "BPE" or spec.get("normalizer") != NORMALIZER or [c.get("type") for c in cuts] != ["Split", "ByteLevel"] or cuts[0]["pattern"] != {"Regex": SPLIT} or cuts[1].get("use_regex", True) or cuts[1].get("add_prefix_space", True):
            raise ValueError(f"{path} cuts words in another way")
        end, vocab = model.get("end_of_word_suffix") or "", model["vocab"]
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.vocabulary = max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]) + 1
        self.tokens = [b""] * self.vocabulary
        for t, i in [*vocab.items(), *((t["content"], t["id"]) for t in spec["added_tokens"])]:
            self.tokens[i] = t.encode()
        letters = byte_letters()
        self.byte_of = {c: b for b, c in letters.items()}
        self.inner = np.array([vocab[letters[b]] for b in range(256)], np.int32)
        self.final = np.array([vocab[letters[b] + end] for b in range(256)], np.int32)
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, m in enumerate(model["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            self.pairs[vocab[a], vocab[b]] = (rank, vocab[a + b])
        keys = np.array([a << 20 | b for a, b in self.pairs], np.int64)
        self.places = L.Places(keys)
        self.rank = np.array([*(r for r, _ in self.pairs.values()), NONE], np.int32)  # NONE: for no place
        self.made = np.zeros(len(keys) + 1, np.int32)
        self.made[[r for r, _ in self.pairs.values()]] = [m for _, m in self.pairs.values()]
        self.start = np.concatenate([self.inner, self.final])
        self.first_ranks = self.ranks(np.repeat(self.inner, 512), np.tile(self.start, 256)).reshape(256, 512)

    @functools.cached_property
    def library(self):
        """The tokenizers library's own, for odd words only."""
        from tokenizers import Tokenizer

        out = Tokenizer.from_file(self.path)
        out.no_truncation()
        out.no_padding()
        return out

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self.rank[self.places.of(a.astype(np.int64) << 20 | b)]

    def side_by_side(self, pieces: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of at most width bytes: in each, the first pair of least rank is merged, again and again.

        Returns a row of ids for each piece and how many of them count.
        """
        n = len(pieces)
        size = np.fromiter(map(len, pieces), np.int64, n)
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(n, width)
        every = np.arange(n)
        first = raw.astype(np.int64)
        first[every, size - 1] += 256
        sym = self.start[first]
        count = size.copy()
        result = np.zeros((n, width), np.int32)
        rows = every
        col = np.arange(width)
        rank = np.full((n, width), NONE, np.int32)
        if width > 1:
            rank[:, :-1] = self.first_ranks[raw[:, :-1], first[:, 1:]]
            rank[col[None, :] + 1 >= size[:, None]] = NONE
        while True:
            at = rank.argmin(axis=1)
            best = rank[np.arange(len(rows)), at]
            live = best != NONE
            if not live.all():
                result[rows[~live]] = sym[~live]
                rows, sym, rank, at, best = rows[live], sym[live], rank[live], at[live], best[live]
            if not len(rows):
                return result, count
            source = np.minimum(col[None, :] + (col[None, :] > at[:, None]), width - 1)
            sym, rank = np.take_along_axis(sym, source, 1), np.take_along_axis(rank, source, 1)
            k = np.arange(len(rows))
            sym[k, at] = self.made[best]
            count[rows] -= 1
            now = count[rows]
            rank[k, now - 1] = NONE
            has = np.flatnonzero(at + 1 < now)
            rank[has, at[has]] = self.ranks(sym[has, at[has]], sym[has, at[has] + 1])
            has = np.flatnonzero(at > 0)
            rank[has, at[has] - 1] = self.ranks(sym[has, at[has] - 1], sym[has, at[has]])

    def one(self, piece: bytes) -> list[int]:
        """A piece of any length, with a heap of pairs over a linked list."""
        sym = self.inner[np.frombuffer(piece, np.uint8)].tolist()
        sym[-1] = int(self.final[piece[-1]])
        n = len(sym)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(p[0], i, sym[i], sym[i + 1]) for i in range(n - 1) if (p := self.pairs.get((sym[i], sym[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if sym[i] != a or j < 0 or sym[j] != b:
                continue
            sym[i], sym[j] = self.pairs[a, b][1], -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if p := self.pairs.get((sym[i], sym[k])):
                    heapq.heappush(heap, (p[0], i, sym[i], sym[k]))
            h = before[i]
            if h >= 0 and (p := self.pairs.get((sym[h], sym[i]))):
                heapq.heappush(heap, (p[0], h, sym[h], sym[i]))
        return [s for s in sym if s >= 0]

    def odd(self, word: str) -> list[int]:
        """The ids of a word with special tokens or letters that need the library's normalizer."""
        if any(s in word for s in self.special):
            return self.library.encode(word, add_special_tokens=False).ids
        normal = self.library.normalizer.normalize_str(word)
        out = []
        for p, _ in self.library.pre_tokenizer.pre_tokenize_str(normal):
            out += self.one(bytes([self.byte_of[c] for c in p]))
        return out

    def words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words in a row, and how many each has."""
        if not words:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        text = [w.decode("utf-8") for w in words]
        plain = [SIMPLE.fullmatch(w) is not None and not ("<|" in w and any(s in w for s in self.special)) for w in text]
        if not all(plain):
            made = [None if p else self.odd(w) for w, p in zip(text, plain, strict=True)]
            rest_ids, rest = self.words([w for w, p in zip(words, plain, strict=True) if p])
            mask = np.array(plain)
            count = np.zeros(len(words), np.int64)
            count[mask] = rest
            count[~mask] = [len(m) for m in made if m is not None]
            ids = np.empty(int(count.sum()), np.uint32)
            of = np.repeat(mask, count)
            ids[of] = rest_ids
            ids[~of] = [i for m in made if m is not None for i in m]
            return ids, count
        found = SIMPLE_PIECES.findall("\n".join(text).lower())
        coded = pa.array(found, pa.string()).dictionary_encode()
        use = coded.indices.to_numpy()
        distinct = coded.dictionary.cast(pa.binary()).to_pylist()
        size = np.fromiter(map(len, distinct), np.int64, len(distinct))
        ends = [i for i, d in enumerate(distinct) if d == b"\n"]  # between words
        count, begin, pool, total = np.zeros(len(distinct), np.int64), np.zeros(len(distinct), np.int64), [], 0
        for low, width in ((0, 4), (4, 8), (8, 12), (12, 20), (20, SIDE_BY_SIDE)):
            group = np.flatnonzero((size > low) & (size <= width))
            for i in range(0, len(group), AT_ONCE):
                some = group[i : i + AT_ONCE]
                rows, n = self.side_by_side([distinct[k] for k in some], width)
                begin[some] = total + np.arange(len(some)) * width
                count[some] = n
                pool.append(rows.ravel())
                total += rows.size
        for k in np.flatnonzero(size > SIDE_BY_SIDE).tolist():
            ids = self.one(distinct[k])
            begin[k], count[k] = total, len(ids)
            pool.append(np.array(ids, np.int32))
            total += len(ids)
        count[ends] = 0
        per = count[use]
        owner = np.cumsum(np.isin(use, ends)) if ends else np.zeros(len(use), np.int64)
        each = np.bincount(owner, weights=per, minlength=len(words)).astype(np.int64)
        last = np.cumsum(per)
        where = np.repeat(begin[use] - (last - per), per) + np.arange(int(last[-1]) if len(last) else 0)
        return np.concatenate(pool)[where].astype(np.uint32), each


@functools.lru_cache(maxsize=2)
def merger(path: str) -> Merger:
    out = Merger(path)
    C.give_back()  # what the file took while it was read
    return out


_codecs: dict[tuple, Codec] = {}


class Codec:
    """Encodes and decodes batches of texts."""

    def __init__(self, path: str, words: bytes) -> None:
        self.merger = merger(path)
        self.lexicon = L.Lexicon(L.mapped(words))

    @staticmethod
    def of(path: str, words: bytes) -> Codec:
        """This worker's codec; one is kept for each lexicon."""
        key = (path, len(words), hash(words))
        if key not in _codecs:
            _codecs.clear()
            _codecs[key] = Codec(path, words)
        return _codecs[key]

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and where each text's ids begin, with the end."""
        lists = pc.ascii_split_whitespace(C.texts(column))
        ends = lists.offsets.to_numpy()
        coded = lists.values.dictionary_encode()
        distinct = coded.dictionary
        if not len(distinct):
            return np.zeros(0, np.uint32), np.zeros(len(column) + 1, np.int64)
        at = np.frombuffer(distinct.buffers()[1], np.int32, len(distinct) + 1, distinct.offset * 4)
        data = np.frombuffer(distinct.buffers()[2] or b"\0", np.uint8)
        starts, sizes = at[:-1].astype(np.int64), np.diff(at)
        rank = self.lexicon.ranks(data, starts, sizes)
        known, new = rank >= 0, np.flatnonzero((rank < 0) & (sizes > 0))
        made, made_count = self.merger.words(distinct.take(pa.array(new)).cast(pa.binary()).to_pylist())
        count = np.zeros(len(distinct), np.int64)
        count[known] = np.diff(self.lexicon.offsets)[rank[known]]
        count[new] = made_count
        begin = np.zeros(len(distinct), np.int64)
        begin[known] = self.lexicon.offsets[rank[known]]
        base = len(self.lexicon.ids)
        begin[new] = base + np.cumsum(count[new]) - count[new]
        pool = np.concatenate([self.lexicon.ids, made])
        use = coded.indices.to_numpy()
        per = count[use]
        total = np.concatenate([[0], np.cumsum(per)])
        ids = np.empty(int(total[-1]), np.uint32)
        step = 1 << 19
        for i in range(0, len(use), step):  # by parts: the positions take much room
            p, u = per[i : i + step], use[i : i + step]
            first = total[i]
            where = np.repeat(begin[u] - (total[i : i + step][: len(u)] - first), p) + np.arange(int(p.sum()))
            ids[first : first + len(where)] = pool[where]
        return ids, total[ends]

    def decode(self, ids: np.ndarray) -> bytes:
        """The text of the ids, special tokens included, in UTF-8: tokens joined by a space."""
        return b" ".join(map(self.merger.tokens.__getitem__, ids.tolist()))


def build_lexicon(docs: DataFrame, text: str = "text", path: str | None = None, words: int = LEXICON_WORDS) -> bytes:
    """Count the words of all texts and compile the most frequent ones, in one task.

    Each task adds its counts up first; words that occur once in a slice aren't
    counted there.  What comes to the driver is the buffer, bounded
    by ``words``.
    """
    C.ship(docs.sparkSession)
    file = tokenizer_path(path)
    schema = pa.schema([("word", pa.binary()), ("n", pa.int64())])

    @C.lean
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j in C.slices(b.column(0), 2 * SLICE):
                flat = pc.ascii_split_whitespace(C.texts(b.column(0).slice(i, j - i))).flatten()
                found = flat.value_counts()
                w, n = found.field(0), found.field(1)
                size = pc.binary_length(w)
                keep = pc.and_(pc.greater(n, 1), pc.and_(pc.greater(size, 0), pc.less_equal(size, LEXICON_BYTES)))
                yield pa.RecordBatch.from_arrays([w.filter(keep).cast(pa.binary()), n.filter(keep)], schema=schema)

    @C.lean
    def compiled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [w for b in batches for w in b.column(0).to_pylist()]  # at most ``words``
        ids, n = merger(file).words(own)
        ends = np.cumsum(n)
        entries = {w: ids[e - k : e].tolist() for w, e, k in zip(own, ends.tolist(), n.tolist(), strict=True)}
        yield pa.RecordBatch.from_arrays([pa.array([L.compile_words(entries)], pa.binary())], names=["lexicon"])

    counts = C.only(docs, text=text).mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    top = counts.orderBy(F.desc("n"), "word").limit(words).select("word")
    made = top.coalesce(1).mapInArrow(compiled, "lexicon binary").toArrow()["lexicon"]
    return made[0].as_py() if len(made) else L.compile_words({})


def encode(docs: DataFrame, text: str = "text", keys: tuple[str, ...] = ("doc_id",), path: str | None = None, lexicon: bytes | None = None) -> DataFrame:
    """The keys of each row and ``ids`` array<int>, the ids of its whole text."""
    spark = docs.sparkSession
    C.ship(spark)
    file = tokenizer_path(path)
    shared = spark.sparkContext.broadcast(build_lexicon(docs, text, path) if lexicon is None else lexicon)
    source = docs.select(*[docs[f"`{k}`"] for k in keys], docs[f"`{text}`"].cast("string").alias("_text"))
    fields = [source.schema[i] for i in range(len(keys))]
    n = len(keys)

    @C.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(file, shared.value)
        for b in batches:
            for i, j in C.slices(b.column(n), SLICE):
                part = b.slice(i, j - i)
                ids, at = codec.encode(part.column(n))
                lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids.view(np.int32)))
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(n)), lists], names=[*(f"k{k}" for k in range(n)), "ids"])

    ddl = ", ".join([*(f"k{i} {f.dataType.simpleString()}" for i, f in enumerate(fields)), "ids array<int>"])
    return source.mapInArrow(run, ddl).toDF(*keys, "ids")


def decode(encoded: DataFrame, ids: str = "ids", path: str | None = None, words: bytes | None = None) -> DataFrame:
    """All columns, and ``decoded``: the text of ``ids``, special tokens included; null ids give null."""
    C.ship(encoded.sparkSession)
    file, empty = tokenizer_path(path), words or L.compile_words({})

    @F.pandas_udf("string")
    def text_of(column):
        codec = Codec.of(file, empty)
        return column.map(lambda x: None if x is None else codec.decode(np.asarray(x)).decode("utf-8"))

    return encoded.withColumn("decoded", text_of(F.col(ids)))


def digests(docs: DataFrame, text: str = "text", key: str = "doc_id", path: str | None = None) -> DataFrame:
    """Encode and decode every text in one pass and return hashes of both results."""
    import hashlib

    spark = docs.sparkSession
    C.ship(spark)
    file = tokenizer_path(path)
    shared = spark.sparkContext.broadcast(build_lexicon(docs, text, path))
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    @C.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(file, shared.value)
        for b in batches:
            for i, j in C.slices(b.column(1), SLICE):
                part = b.slice(i, j - i)
                ids, at = codec.encode(part.column(1))
                each = [ids[x:y] for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                first = [hashlib.sha256(x.astype("<u4", copy=False).tobytes()).hexdigest() for x in each]
                second = [hashlib.sha256(codec.decode(x)).hexdigest() for x in each]
                yield C.batch(schema, part.column(0), np.diff(at), first, second)

    source = docs.select(docs[f"`{key}`"].cast("long").alias("doc_id"), docs[f"`{text}`"].cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
