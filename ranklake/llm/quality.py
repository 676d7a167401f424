"""Quality rules combined by weak supervision (operator 6), in DataFrame functions only.

Method: rules vote good or bad on a document, or abstain.  How often which votes
occur together is counted over all documents; expectation-maximisation on these
counts (at most 3 ** rules) estimates how often each rule votes either way on
good and on bad documents, and a document is kept if the posterior probability
that it is good is at least one half.  No label is used.

Rules on the length of words, on the ends of lines and on the variety of words
are made for scripts with spaces between words; they abstain on texts of which
over ``UNSPACED`` of the letters are of scripts without.  Marks at the ends of
lines are those of many scripts.

Defined results: a null text has no words; texts of under 20 words fail; an
empty table gives an empty table; repeated rows count as often as they occur;
very long texts are counted whole; extra columns are carried along by keep().
Windows of eight words are compared by a 64-bit hash within one document.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

SYMBOLS, WINDOW = "#*$%&|<>", 8
WHITE = r"[\x20\x09-\x0D]+"
#: Marks that end lines of prose: of Latin, Greek, Arabic, Devanagari, Ethiopic, Armenian and East Asian texts.
MARKS = ".!?:;,\"'”»…)" + "·؟؛،۔।॥።։" + "。！？；：，、」』）》】．"
NO_SPACES, UNSPACED = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}\p{IsTibetan}]", 0.3
#: Seeds of the estimation: how sure a bad vote is at first, and rounds.
ROUNDS = 200
FEATURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def without(text: Column, one: str) -> Column:
    """How often a character of one byte occurs."""
    return F.octet_length(text) - F.octet_length(F.replace(text, F.lit(one)))


def repeated(h: str) -> Column:
    """Words in windows that occur twice or more; h: array of window hashes in order."""
    order = f"array_sort(transform({h}, (x, i) -> named_struct('x', x, 'i', i)))"
    same = "filter(o, (t, k) -> (k > 0 and o[k - 1].x = t.x) or (k + 1 < size(o) and o[k + 1].x = t.x))"
    # covered words: a window adds what the one before it left open
    starts = f"array_sort(transform({same}, t -> t.i))"
    covered = f"aggregate(p, named_struct('end', 0, 'n', 0), (a, i) -> named_struct('end', i + {WINDOW}, 'n', a.n + i + {WINDOW} - greatest(a.end, i)), a -> a.n)"
    inner = f"element_at(transform(array({starts}), p -> {covered}), 1)"
    return F.expr(f"CASE WHEN size(array_distinct({h})) = size({h}) THEN 0 ELSE element_at(transform(array({order}), o -> {inner}), 1) END")


def features(docs: DataFrame, text: str = "text", *keep: str) -> DataFrame:
    """The columns ``keep``, then the counts of each row's whole text and what the rules need."""
    t = F.coalesce(docs[f"`{text}`"].cast("string"), F.lit(""))
    base = docs.select(*[docs[f"`{k}`"] for k in keep], t.alias("_t"))
    trimmed = F.btrim("_t", F.lit(C.SPACE))
    one = base.withColumn("_w", F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, WHITE)))
    two = one.withColumn("_l", F.filter(F.split("_t", "\n"), lambda x: F.btrim(x, F.lit(C.SPACE)) != "")).withColumn("_h", F.transform("_w", lambda w: F.xxhash64(w)))
    n = F.size("_w")
    hashes = F.when(n > WINDOW, F.expr(f"transform(sequence(1, size(_h) - {WINDOW - 1}), i -> xxhash64(slice(_h, i, {WINDOW})))")).otherwise(F.array().cast("array<bigint>"))
    symbols = sum((without(F.col("_t"), s) for s in SYMBOLS[1:]), without(F.col("_t"), SYMBOLS[0]))
    three = two.withColumn("_x", hashes)
    return three.select(
        *[F.col(f"`{k}`") for k in keep],
        n.cast("long").alias("n_words"),
        F.char_length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        symbols.cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        repeated("_x").cast("long").alias("n_repeat_words"),
        F.size("_l").cast("long").alias("n_lines"),
        F.size(F.array_distinct("_h")).cast("long").alias("n_distinct"),
        F.size(F.filter("_w", lambda w: (w == F.upper(w)) & (w != F.lower(w)))).cast("long").alias("n_upper"),
        without(F.col("_t"), "!").cast("long").alias("n_marks"),
        F.size(F.filter("_l", lambda x: F.btrim(x, F.lit(C.SPACE)).rlike(f"[{MARKS}]$"))).cast("long").alias("n_ended"),
        # looked for only where a fifth of the characters or more has several bytes
        F.when(F.octet_length("_t") > 1.2 * F.char_length("_t"), F.char_length("_t") - F.char_length(F.regexp_replace("_t", NO_SPACES, ""))).otherwise(0).cast("long").alias("n_unspaced"),
    )


def ratio(a: str, b: str) -> Column:
    return F.col(a) / F.greatest(F.col(b), F.lit(1))


def rules() -> dict[str, Column]:
    """Votes: 1 good, -1 bad, 0 abstains.  Their limits are those of common web-text heuristics.

    A rule that looks for one fault abstains where it finds none: that says
    nothing about other faults.  Good votes need several signs of plain prose.
    """
    symbols, length, capital = ratio("n_symbols", "n_words"), ratio("word_chars", "n_words"), ratio("n_upper", "n_words")
    marks, ended = ratio("n_marks", "n_words"), ratio("n_ended", "n_lines")
    lines, again, distinct = ratio("n_dup_lines", "n_lines"), ratio("n_repeat_words", "n_words"), ratio("n_distinct", "n_words")
    spaced = F.col("n_unspaced") <= UNSPACED * F.col("word_chars")
    plain = (symbols < 0.05) & (capital < 0.2) & (marks < 0.1)
    bad = {
        "symbols": symbols > 0.1,
        "capitals": capital > 0.4,
        "marks": marks > 0.3,
        "same_lines": lines > 0.5,
        "same_words": again > 0.3,
        "variety": spaced & (F.col("n_words") >= 50) & (distinct < 0.1),
        "word_length": spaced & ((length < 2.5) | (length > 14)),
        "line_ends": spaced & (ended < 0.1) & (F.col("n_lines") >= 3),
    }
    good = {
        "prose": plain & (~spaced | (length >= 3) & (length <= 10)),
        "sentences": plain & (ended > 0.5),
    }
    return {k: F.when(v, -1).otherwise(0) for k, v in bad.items()} | {k: F.when(v, 1).otherwise(0) for k, v in good.items()}


def estimate(counts: list[tuple[tuple[int, ...], int]], rounds: int = ROUNDS) -> tuple[float, np.ndarray]:
    """Log odds that a document is good, and by rule those that a bad vote, an abstention and a good vote add.

    counts: votes and how often they occur together.  The two classes start
    from the number of bad votes; a little is added to all counts, so that an
    unseen vote is never certain.
    """
    if not counts:
        return 0.0, np.zeros((0, 3))
    votes = np.array([v for v, _ in counts])
    n = np.array([c for _, c in counts], float)
    one = np.stack([votes == k for k in (-1, 0, 1)], axis=2).astype(float)  # pattern, rule, vote
    bad = (votes < 0).sum(axis=1)
    good = np.select([bad == 0, bad == 1], [0.98, 0.3], 0.02)
    total = n.sum()
    prior, odds = 0.0, np.zeros(one.shape[1:])
    for _ in range(rounds):
        a, b = n * good, n * (1 - good)
        p = np.einsum("p,prv->rv", a, one) + [0.001, 0.5, 1.0]
        q = np.einsum("p,prv->rv", b, one) + [0.5, 0.5, 0.5]
        odds = np.log(p / p.sum(axis=1, keepdims=True)) - np.log(q / q.sum(axis=1, keepdims=True))
        odds[:, 1] = 0.0  # an abstention says nothing
        prior = math.log((a.sum() + 1) / (b.sum() + 1)) if total else 0.0
        now = 1 / (1 + np.exp(-np.clip(prior + np.einsum("rv,prv->p", odds, one), -500, 500)))
        if np.abs(now - good).max() < 1e-9:
            break
        good = now
    return prior, odds


def verdicts(counted: DataFrame) -> DataFrame:
    """counted: the output of features(), stored.  Adds base_failed, posterior and kept."""
    named = rules()
    voted = counted.select(*counted.columns, *[v.cast("int").alias(f"_{k}") for k, v in named.items()])
    own = F.col("n_words") >= 20
    patterns = voted.where(own).groupBy(*[f"_{k}" for k in named]).count().collect()  # at most 3 ** rules
    prior, odds = estimate([(tuple(r[f"_{k}"] for k in named), r["count"]) for r in patterns])
    total = F.lit(float(prior))
    for k, o in zip(named, odds, strict=False):
        total = total + F.when(F.col(f"_{k}") < 0, float(o[0])).when(F.col(f"_{k}") > 0, float(o[2])).otherwise(0.0)
    failed = ~own | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    out = voted.withColumn("base_failed", failed).withColumn("posterior", 1 / (1 + F.exp(-total)))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= 0.5)).drop(*[f"_{k}" for k in named])


def score(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, the counts, base_failed, posterior and kept of each row."""
    plain = C.only(docs, doc_id=docs[f"`{key}`"].cast("long"), text=text)
    return verdicts(C.table(features(plain, "text", "doc_id"), "features"))


def keep(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of docs that are kept, in the same columns.

    The counts are computed once beside the rows and stored with them.
    """
    column = C.fresh(docs, "_all")
    packed = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias(column), docs[f"`{text}`"].alias("_text"))
    stored = C.table(features(packed, "_text", column), "quality")
    return verdicts(stored).where("kept").select(f"{column}.*")
