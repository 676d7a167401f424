"""The pipeline against its stages' plain versions."""

from __future__ import annotations

import random

import corpus_pipeline as pipeline
import pytest
from pyspark.sql import functions as F

from ranklake.llm import copies, quality, toxicity

from . import plain


def test_pipeline(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = [n for n, _ in pipeline.STAGES]
    assert names == ["quality", "toxicity", "lines", "near_dedup", "packing"]
    rows = {r.doc_id: r.text for r in docs.collect()}
    kept = {r.doc_id for r in quality.score(docs).where("kept").collect()}
    own = docs.where(F.col("doc_id").isin(*kept))
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    clean = sorted(r.doc_id for r in toxicity.classify(own, labels).where("predicted = 0").collect())
    strip = "\t\n\x0b\x0c\r "
    holds: dict = {}
    for d in clean:
        for x in (rows[d] or "").split("\n"):
            k = x.strip(strip).translate(plain.UPPER)
            if len(k) >= 10:
                holds.setdefault(k, d)
    texts = [(d, "\n".join(x for x in (rows[d] or "").split("\n") if holds.get(x.strip(strip).translate(plain.UPPER), d) == d)) for d in clean]
    left = [(d, t) for (d, t), (_, _, c) in zip(texts, plain.simhash(texts), strict=True) if d == c]
    found = pipeline.run(spark, sf).collect()
    assert {r.doc_id for r in found} == {d for d, _ in left}
    assert plain.check_pieces(left, found) < 0.1


def test_stages_keep_the_columns_and_take_empty_tables(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    none = docs.limit(0)
    for name, stage in pipeline.STAGES:
        out = stage(spark, none, sf)
        if name != "packing":
            assert out.columns == docs.columns
        assert out.count() == 0


def shingled(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


@pytest.mark.parametrize("block", [copies.BLOCK, 2])
def test_near_dedup_finds_all_similar_texts(spark, block):
    """Texts of 100 words with some changed, on both sides of a similarity of 0.8; only 3 bits are too few for most."""
    rng = random.Random(3)
    rows = [(1000, None), (1001, ""), (1002, " \n"), (1003, "three words only"), (1004, "Three WORDS only")]
    for g in range(40):
        base = [f"w{rng.randrange(5000)}" for _ in range(100)]
        for _ in range(4):
            words = list(base)
            for at in rng.sample(range(100), rng.choice([0, 1, 2, 2, 3])):
                words[at] = f"new{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(words)))
    sets = {d: shingled(t) for d, t in rows}
    group = {d: c for d, _, c in plain.simhash(rows)}
    by_bits = len(set(group.values()))
    for a in sets:
        for b in sets:
            if a < b and (sets[a] == sets[b] or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])):
                low, high = sorted((group[a], group[b]))
                group = {d: low if c == high else c for d, c in group.items()}
    docs = spark.createDataFrame([*rows, (None, "no id")], "doc_id long, text string").repartition(3)
    found = [r.doc_id for r in (pipeline.near_dedup_stage(spark, docs, "") if block == copies.BLOCK else copies.representatives(docs, block=block)).collect()]
    assert len(set(group.values())) < by_bits
    assert sorted(d for d in found if d is not None) == sorted({min(d for d in group if group[d] == c) for c in set(group.values())})
    assert found.count(None) == 1
