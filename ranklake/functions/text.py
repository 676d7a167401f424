"""Tokenizing and normalizing text, as Columns and for single query tokens."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

from .stem import porter

# Words follow the word boundary rules of Unicode (annex 29) for letters, digits, kana and connectors; of other
# scripts without spaces each character is a word (no dictionary of words is used).
_MARKS = r"[\p{WB=Extend}\p{WB=Format}\p{WB=ZWJ}]*"
_LETTER = rf"(?:[\p{{WB=ALetter}}\p{{WB=Hebrew_Letter}}]{_MARKS})"
_DIGIT = rf"(?:\p{{WB=Numeric}}{_MARKS})"
_IN_WORD = rf"(?:[\p{{WB=MidLetter}}\p{{WB=MidNumLet}}\p{{WB=Single_Quote}}]{_MARKS}|(?<=\p{{WB=Hebrew_Letter}}{_MARKS})\"(?=\p{{WB=Hebrew_Letter}}))"
_IN_NUMBER = rf"(?:[\p{{WB=MidNum}}\p{{WB=MidNumLet}}\p{{WB=Single_Quote}}]{_MARKS})"
_RUN = rf"(?:(?:{_LETTER}+(?:{_IN_WORD}{_LETTER}+)*|{_DIGIT}+(?:{_IN_NUMBER}{_DIGIT}+)*)+|(?:\p{{WB=Katakana}}{_MARKS})+)"
_JOIN = rf"(?:\p{{WB=ExtendNumLet}}{_MARKS})"
WORDS = regex.compile(rf"{_JOIN}*{_RUN}(?:{_JOIN}+{_RUN})*{_JOIN}*|[\p{{Ideographic}}\p{{L}}]{_MARKS}")


def _plain(c: str) -> bool:
    """Whether a character is Latin, Cyrillic or punctuation that needs no normalizing, and lower case folds it (or it is sharp s)."""
    if unicodedata.category(c) in ("Mn", "Mc", "Me", "Cf", "Cn") or unicodedata.normalize("NFC", c) != c or c == "İ":
        return False
    if c.casefold() != c.lower() and c != "ß":
        return False
    if regex.match(r"[\p{WB=MidLetter}\p{WB=MidNumLet}\p{WB=MidNum}\p{WB=Single_Quote}\p{WB=ExtendNumLet}\p{WB=Numeric}]", c):
        return c in ":·.‘’',;_0123456789"
    return c.isalpha() == bool(regex.match(r"\p{WB=ALetter}", c))


def _ranges(chars: list[int]) -> str:
    out, first = [], None
    for c in [*chars, None]:
        if first is not None and c != last + 1:
            out.append(f"\\x{{{first:x}}}-\\x{{{last:x}}}")
            first = None
        first = c if first is None else first
        last = c
    return "".join(out)


#: Rows that are Python objects at a time, and tokens whose normal form is remembered.
SLICE, SEEN = 64, 100_000
#: Texts of such characters alone are handled by built-in functions.  ASCII by itself, for that is one comparison.
_PLAIN_CODES = [c for r in (range(0x80, 0x250), range(0x400, 0x530), range(0x2010, 0x205F), range(0x20A0, 0x20C0)) for c in r if _plain(chr(c))]
_PLAIN_LETTERS = _ranges(_PLAIN_CODES)
PLAIN = rf"\A[\x00-\x7f]*+(?:[{_PLAIN_LETTERS}]++[\x00-\x7f]*+)*+\z"
#: The same words in texts of plain characters; possessive, so that Java needs no stack for long ones.
_PLAIN_RUN = r"(?:\p{L}++(?:[:·.‘’']\p{L}++)*+|[0-9]++(?:[,;.‘’'][0-9]++)*+)++"
TOKEN = rf"(?<!_)_*+{_PLAIN_RUN}(?:_++{_PLAIN_RUN})*+_*+"

#: What a plain character is, by code point: bits; the last entry stands for all that aren't plain.
LETTER, DIGIT, LINE, IN_WORD, IN_NUMBER, ODD = 1, 2, 4, 8, 16, 128
LAST = 0x20C0
#: Bytes of texts that are split at a time; a longer text stands alone.
SPLIT = 1 << 20


def _kinds() -> tuple[np.ndarray, np.ndarray]:
    """The bits of each code point up to LAST, and its lower case."""
    kinds, lower = np.full(LAST + 1, ODD, np.uint8), np.arange(LAST + 1, dtype=np.uint32)
    for i in [*range(0x80), *_PLAIN_CODES]:
        c = chr(i)
        kinds[i] = LETTER * c.isalpha() | DIGIT * (c in "0123456789") | LINE * (c == "_") | IN_WORD * (c in ":·.‘’'") | IN_NUMBER * (c in ",;.‘’'")
        lower[i] = ord(c.lower())
    return kinds, lower


@dataclass(frozen=True)
class TextOptions:
    lowercase: bool = False
    stopwords: tuple[str, ...] = ()
    stem_english: bool = False
    fold_diacritics: bool = False

    @staticmethod
    def of(lowercase=False, stopwords=(), stem_english=False, fold_diacritics=False) -> TextOptions:
        """stopwords: a list, or a string of comma-separated words with or without spaces around them."""
        if isinstance(stopwords, str):
            stopwords = [w.strip() for w in stopwords.split(",") if w.strip()]
        return TextOptions(bool(lowercase), tuple(stopwords or ()), bool(stem_english), bool(fold_diacritics))

    def but(self, **changes) -> TextOptions:
        """These options with those that are given and not None."""
        own = {k: getattr(self, k) for k in ("lowercase", "stopwords", "stem_english", "fold_diacritics")}
        return TextOptions.of(**(own | {k: v for k, v in changes.items() if v is not None}))


def normalize_token(token: str, options: TextOptions) -> str | None:
    """NFC, case folding (also before stemming), diacritics, then stopwords, then the stem; None: dropped."""
    t = unicodedata.normalize("NFC", token)
    if options.lowercase or options.stem_english:
        t = t.casefold()
    if options.fold_diacritics:
        t = unicodedata.normalize("NFC", "".join(c for c in unicodedata.normalize("NFD", t) if unicodedata.category(c) not in ("Mn", "Mc", "Me")))
    if t in options.stopwords:
        return None
    return porter(t) if options.stem_english else t


def normalize_all(tokens: list[str], options: TextOptions) -> list[str]:
    return [n for t in tokens if t is not None and (n := normalize_token(t, options)) is not None]


def _by_slices(column: pa.Array, one: Callable[[object], list[str] | None]) -> pa.Array:
    """``one`` of each value; only a slice of them are Python objects at a time."""
    out = [pa.array([], pa.list_(pa.string()))]
    for start in range(0, len(column), SLICE):
        out.append(pa.array([one(v) for v in column.slice(start, SLICE).to_pylist()], pa.list_(pa.string())))
    return pa.concat_arrays(out)


def split(texts: pa.Array, options: TextOptions) -> pa.ListArray:
    """tokenize() of an Arrow array, null as an empty text, for options without stems and diacritics.

    Plain texts are cut as arrays of characters, without an object for a word;
    the others are taken apart one by one.
    """
    texts = pc.fill_null(texts.cast(pa.string()), "")
    ends = np.concatenate([[0], np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64)])
    out, start = [pa.array([], pa.list_(pa.string()))], 0
    while start < len(texts):
        end = max(start + 1, int(np.searchsorted(ends, ends[start] + SPLIT, "right")) - 1)
        out.append(_split(texts.slice(start, end - start), options))
        start = end
    return pa.concat_arrays(out)


def _split(texts: pa.StringArray, options: TextOptions) -> pa.ListArray:
    at = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
    wide = bool(len(data)) and int(data.max()) >= 0x80
    if wide:
        codes = np.minimum(np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32), LAST)
        ends = np.concatenate([[0], np.cumsum(pc.utf8_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64)])
    else:
        codes, ends = data, (at - at[0]).astype(np.int64)
    kind = KINDS[codes]
    odd = np.unique(np.searchsorted(ends, np.flatnonzero(kind == ODD), "right") - 1) if wide else []
    for row in odd:
        kind[ends[row] : ends[row + 1]] = 0
    first = np.zeros(len(codes) + 1, bool)
    first[ends] = True
    kept = kind & (LETTER | DIGIT | LINE) != 0
    marks = np.flatnonzero(kind & (IN_WORD | IN_NUMBER))
    marks = marks[~first[marks] & ~first[marks + 1]]
    near = kind[marks - 1] & kind[marks + 1]
    kept[marks[(kind[marks] & IN_WORD != 0) & (near & LETTER != 0) | (kind[marks] & IN_NUMBER != 0) & (near & DIGIT != 0)]] = True
    begins = kept.copy()
    begins[1:] &= ~kept[:-1] | first[1:-1]
    starts = np.flatnonzero(begins)
    sizes = np.diff(np.append(np.cumsum(kept)[starts] - 1, np.count_nonzero(kept)))
    if (kind & LINE).any():  # what is underscores only is no word
        solid = np.append(np.concatenate([[0], np.cumsum(kind & (LETTER | DIGIT) != 0)])[starts], np.count_nonzero(kind & (LETTER | DIGIT)))
        word = np.diff(solid) > 0
        kept[np.flatnonzero(kept)[~np.repeat(word, sizes)]] = False
        starts, sizes = starts[word], sizes[word]
    chars = codes[kept]
    chars = LOWER[chars] if options.lowercase else chars
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    if wide:
        offsets = np.concatenate([[0], np.cumsum(1 + (chars >= 0x80) + (chars >= 0x800))])[offsets]
        raw = chars.astype(np.uint32).tobytes().decode("utf-32-le").encode()
        raw = raw.replace("ß".encode(), b"ss") if options.lowercase else raw  # as many bytes
    else:
        raw = chars.astype(np.uint8).tobytes()
    words = pa.StringArray.from_buffers(len(sizes), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(raw))
    rows = np.searchsorted(starts, ends)
    if options.stopwords:
        left = pc.invert(pc.is_in(words, value_set=pa.array(options.stopwords, pa.string())))
        words, rows = words.filter(left), np.concatenate([[0], np.cumsum(left.to_numpy(zero_copy_only=False))])[rows]
    lists = pa.ListArray.from_arrays(pa.array(rows.astype(np.int32)), words)
    if not len(odd):
        return lists
    others = _by_slices(texts.take(pa.array(odd)), lambda t: tokenize_local(t, options))
    order = np.arange(len(texts))
    order[odd] = len(texts) + np.arange(len(odd))
    return pa.concat_arrays([lists, others]).take(pa.array(order))


def _lowered(c: Column) -> Column:
    return F.replace(F.lower(c), F.lit("ß"), F.lit("ss"))


def normalize_tokens(tokens: Column, options: TextOptions) -> Column:
    """Normalize an array of tokens; null tokens are dropped.

    Tokens of plain characters are lower-cased by built-in functions; others,
    stems and diacritics need an Arrow function, which does each distinct token
    of a batch once.
    """
    present = F.filter(tokens, lambda t: t.isNotNull())

    @F.arrow_udf("array<string>")
    def run(column: pa.Array) -> pa.Array:
        seen: dict[str, str | None] = {}

        def one(t: str) -> str | None:
            if t not in seen:
                if len(seen) >= SEEN:
                    seen.clear()
                seen[t] = normalize_token(t, options)
            return seen[t]

        return _by_slices(column, lambda ts: None if ts is None else [n for t in ts if (n := one(t)) is not None])

    if options.stem_english or options.fold_diacritics:
        return run(present)
    plain = F.array_join(present, " ").rlike(PLAIN)
    out = F.transform(present, _lowered) if options.lowercase else present
    if options.stopwords:
        out = F.filter(out, lambda t: ~t.isin(*options.stopwords))
    return F.coalesce(run(F.when(~plain, present)), out)  # null where the array is plain


def tokenize(text: Column, options: TextOptions = TextOptions(lowercase=True)) -> Column:
    """The normalized tokens of a text; null gives an empty array.

    A text of plain characters stays within built-in functions (but for stems
    and diacritics); the others go through an Arrow function.
    """
    text = F.coalesce(text, F.lit(""))

    @F.arrow_udf("array<string>")
    def run(column: pa.Array) -> pa.Array:
        return _by_slices(column, lambda t: None if t is None else tokenize_local(t, options))

    if options.stem_english or options.fold_diacritics:
        return run(text)
    plain = text.rlike(PLAIN)
    words = F.regexp_extract_all(_lowered(text) if options.lowercase else text, F.lit(TOKEN), F.lit(0))
    if options.stopwords:
        words = F.filter(words, lambda t: ~t.isin(*options.stopwords))
    return F.coalesce(run(F.when(~plain, text)), words)  # null where the text is plain


def tokenize_local(text: str, options: TextOptions = TextOptions(lowercase=True)) -> list[str]:
    """tokenize() for one text."""
    return normalize_all(WORDS.findall(unicodedata.normalize("NFC", text or "")), options)


KINDS, LOWER = _kinds()
