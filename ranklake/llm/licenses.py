"""License scans of texts against templates (operator 5), in DataFrame functions only.

Method: a text's words (letters and digits, in lower case) give five-word
shingles.  Windows of two blocks of ``BLOCK`` shingles overlap by half; each has
``BANDS`` MinHash bands of one row.  A template is cut into the same windows.
Where a template occurs, a window of the text is off by a quarter window at most,
so that they share at least 24 of 40 shingles: all bands miss with a probability
of 0.4 ** 10 = 0.0001, and a template of several windows is missed less often
still.  A band's order is that of the shingles' hashes under an exclusive or; the
bands' masks are spread evenly, so that the least shingles of two bands lie in
different parts of the hashes' range (a test counts misses).  Templates of at most ``SHORT`` shingles use windows of one shingle, whose
MinHash is the shingle, and are never missed.  Retrieved templates are verified
exactly: at least ``LEAST`` of their distinct shingles occur in the text.

All of it is done within a row, so nothing is shuffled; templates are a literal
of the plan (``MOST_SHINGLES`` bounds them).

Defined results: null and empty texts match nothing; an empty table gives an
empty table; very long texts are scanned whole; columns besides key and text are
not read; repeated rows match each by itself; templates of fewer than five words are refused; a template that occurs
often in a text is one match.
"""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


SIZE, BLOCK, BANDS, SHORT, LEAST, MOST_SHINGLES = 5, 16, 10, 16, 0.8, 200_000
BREAKS = r"[^\p{L}\p{N}]+"

#: Whole texts, a file for each license.
TEXTS = Path(__file__).parent / "license_texts"

#: Notices by which works state their terms, and two short permission texts; the texts in TEXTS are added to them.
TEMPLATES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0"],
    "MIT": [
        "Released under the MIT License",
        "Licensed under the MIT License",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so",
    ],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3", "licensed under the GNU General Public License version 3"],
    "GPL-2.0": ["licensed under the GNU General Public License version 2"],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC-BY-4.0": ["licensed under a Creative Commons Attribution 4.0 International License"],
    "CC-BY-SA-4.0": ["licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "MPL-2.0": ["subject to the terms of the Mozilla Public License, v. 2.0"],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"],
    "EPL-1.0": ["made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution"],
    "EPL-2.0": ["made available under the terms of the Eclipse Public License 2.0 which is available at", "made available under the terms of the Eclipse Public License v. 2.0 which is available at"],
    "CC0-1.0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"],
}

# notices of the GNU licenses: so short that another name or version leaves less than LEAST of the shingles
for _license, _name, _version in (
    ("GPL-2.0", "", "2"), ("GPL-3.0", "", "3"), ("AGPL-3.0", "Affero ", "3"), ("LGPL-2.0", "Library ", "2"), ("LGPL-2.1", "Lesser ", "2.1"), ("LGPL-3.0", "Lesser ", "3"),
):
    TEMPLATES.setdefault(_license, []).append(f"terms of the GNU {_name}General Public License as published by the Free Software Foundation, either version {_version} of the License")
for _file in sorted(TEXTS.glob("*.txt")):
    TEMPLATES.setdefault(_file.stem, []).append(_file.read_text(encoding="utf-8"))


def words_of(text: Column) -> Column:
    """The words of a text without its breaks; an empty array if there are none."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), BREAKS), lambda w: w != "")


def shingle_hashes(words: str) -> str:
    """SQL of the hashes of all five-word shingles in order; no text of fewer words has any."""
    return f"CASE WHEN size({words}) >= {SIZE} THEN transform(sequence(1, size({words}) - {SIZE - 1}), i -> xxhash64(slice({words}, i, {SIZE}))) ELSE cast(array() AS array<bigint>) END"


def salts() -> list[int]:
    return [(k * 0x9E3779B97F4A7C15 + 0x1234567) % (1 << 63) for k in range(1, BANDS + 1)]


def band_keys(h: str) -> str:
    """SQL of the keys of all windows: the least shingle of two adjacent blocks under each permutation.

    Exclusive or with a salt permutes 64-bit hashes; the key is the shingle
    itself, hashed with the number of its band.
    """
    blocks = f"transform(sequence(0, greatest(0, cast(ceil(size({h}) / {BLOCK}.0) AS int) - 1)), b -> slice({h}, b * {BLOCK} + 1, {BLOCK}))"
    each = ", ".join(f"array_min(transform(x, v -> v ^ {s}L))" for s in salts())
    mins = f"transform({blocks}, x -> array({each}))"
    window = ", ".join(f"xxhash64({k}, least(m[b][{k}], m[least(b + 1, size(m) - 1)][{k}]))" for k in range(BANDS))
    keys = f"flatten(transform(sequence(0, greatest(0, size(m) - 2)), b -> array({window})))"
    return f"CASE WHEN size({h}) > 0 THEN element_at(transform(array({mins}), m -> {keys}), 1) ELSE cast(array() AS array<bigint>) END"


def compiled(spark: SparkSession, templates: dict[str, list[str]]) -> list[dict]:
    """By template: its name, distinct shingle hashes, and keys (of windows, or of shingles if it is short)."""
    rows = [(name, text) for name, texts in templates.items() for text in texts]
    for name, text in rows:
        if len([w for w in re.split(r"[^\w]+|_+", text) if w]) < SIZE:
            raise ValueError(f"a template of {name} has fewer than {SIZE} words")
    df = spark.createDataFrame(rows, "name string, text string").withColumn("w", words_of(F.col("text")))
    df = df.withColumn("h", F.explode(F.array(F.expr(shingle_hashes("w"))))).withColumn("k", F.explode(F.array(F.expr(band_keys("h")))))
    out = [{"name": r["name"], "shingles": sorted(set(r["h"])), "keys": sorted(set(r["k"])), "short": len(set(r["h"])) <= SHORT} for r in df.select("name", "h", "k").collect()]
    if sum(len(t["shingles"]) for t in out) > MOST_SHINGLES:
        raise ValueError("too many templates for a plan's literal")
    return out


def longs(values) -> str:
    return "cast(array(" + ", ".join(f"{v}L" if v > -(1 << 63) else "(-9223372036854775807L - 1L)" for v in values) + ") AS array<bigint>)"


def scan(docs: DataFrame, text: str = "text", key: str = "doc_id", templates: dict[str, list[str]] | None = None, least: float = LEAST) -> DataFrame:
    """A row for each license found in a row: doc_id, license, containment, n_matched, n_shingles, first_word, last_word."""
    found = compiled(docs.sparkSession, TEMPLATES if templates is None else templates)
    plain = docs.select(docs[f"`{key}`"].cast("long").alias("doc_id"), docs[f"`{text}`"].cast("string").alias("_t"))
    # a generator of one row computes a value once: no rule copies its expression into later filters
    words = plain.select("doc_id", F.explode(F.array(words_of(F.col("_t")))).alias("_w"))
    one = words.select("doc_id", F.explode(F.array(F.expr(shingle_hashes("_w")))).alias("_h"))
    two = one.select("doc_id", "_h", F.explode(F.array(F.expr(band_keys("_h")))).alias("_k"))
    long_keys = sorted({k for t in found if not t["short"] for k in t["keys"]})
    short_keys = sorted({k for t in found if t["short"] for k in t["shingles"]})
    hit = F.lit(False)
    if short_keys:
        hit = hit | F.expr(f"arrays_overlap(_h, {longs(short_keys)})")
    if long_keys:
        hit = hit | F.expr(f"arrays_overlap(_k, {longs(long_keys)})")
    three = two.where(hit)
    structs = []
    for i, t in enumerate(found):
        keys, column = (t["shingles"], "_h") if t["short"] else (t["keys"], "_k")
        structs.append(f"CASE WHEN arrays_overlap({column}, {longs(keys)}) THEN named_struct('template', {i}, 'common', array_intersect({longs(t['shingles'])}, _h)) END")
    near = three.select("doc_id", "_h", F.explode(F.expr(f"filter(array({', '.join(structs) or 'NULL'}), x -> x is not null)")).alias("x"))
    names = F.array(*[F.lit(t["name"]) for t in found])
    sizes = F.array(*[F.lit(len(t["shingles"])) for t in found])
    each = near.select(
        "doc_id",
        F.element_at(names, F.col("x.template") + 1).alias("license"),
        F.size("x.common").cast("long").alias("n_matched"),
        F.element_at(sizes, F.col("x.template") + 1).cast("long").alias("n_shingles"),
        F.expr("array_min(transform(x.common, c -> array_position(_h, c))) - 1").cast("long").alias("first_word"),
        F.expr(f"array_max(transform(x.common, c -> array_position(_h, c))) + {SIZE - 2}").cast("long").alias("last_word"),
    )
    sure = each.withColumn("containment", F.col("n_matched") / F.col("n_shingles")).where(F.col("containment") >= least)
    return sure.select("doc_id", "license", "containment", "n_matched", "n_shingles", "first_word", "last_word")


def licenses(docs: DataFrame, text: str = "text", key: str = "doc_id", templates: dict[str, list[str]] | None = None) -> DataFrame:
    """doc_id, n_matches and ``licenses`` (distinct names in order) of every row with a match."""
    found = scan(docs, text, key, templates)
    return found.groupBy("doc_id").agg(F.count("*").alias("n_matches"), F.array_sort(F.collect_set("license")).alias("licenses"))


__all__ = ["TEMPLATES", "licenses", "scan"]
