"""The corpus operators against plain versions, on the smallest tables and on odd rows."""

from __future__ import annotations

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from ranklake.llm import ann, bpe, components, licenses, lines, lm, packing, quality, queries, simhash, toxicity, warc

from . import plain

LINE = "This very line stands in more than one document"
ODD = [
    (1, None),
    (2, ""),
    (3, " \n\t\n "),
    (4, "word"),
    (5, "two words"),
    (6, f"{LINE}\nshort\n\n{LINE}"),
    (7, f"  {LINE.upper()}\t\nshort\nown line of document seven"),
    (7, f"  {LINE.upper()}\t\nshort\nown line of document seven"),
    (8, "don't stop <|endoftext|> now's 12ab é Ünï 漢字 İstanbul ﬁne x" + chr(0x1F600)),
    (9, " ".join(f"w{i % 977}" for i in range(30_000))),
    (10, "x" * 5000),
    (11, "a b c d e f g h " * 40),
    (12, "###### |||| $$$$ %%%% <<<< >>>> **** &&&& " * 5),
    (13, " unicode spaces stay inside words 　 here"),
    (20, "Same text of ten words stands here two times over."),
    (21, "Same text of ten words stands here two times over."),
    (-5, f"negative id\n{LINE}"),
    (None, f"no id\n{LINE}"),
]
EXTRA = ("_text", "ids", "h", "_t", "score", "node", "rid", "_all", "_keep")


def frame(spark, rows):
    """rows with columns whose names clash with inner ones."""
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.select("text", *[F.lit(i).alias(c) for i, c in enumerate(EXTRA)], "doc_id").repartition(3)


@pytest.fixture(scope="module")
def docs(sf):
    t = pq.read_table(f"{sf}/documents.parquet", columns=["doc_id", "text"])
    return list(zip(t["doc_id"].to_pylist(), t["text"].to_pylist(), strict=True))


@pytest.fixture(scope="module", params=["odd", "documents", "none"])
def rows(request, docs):
    return {"odd": ODD, "documents": docs, "none": []}[request.param]


def same(found, wanted):
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(map(tuple, found), key=key) == sorted(map(tuple, wanted), key=key)


def test_bpe(spark, rows):
    same(bpe.digests(frame(spark, rows)).collect(), plain.bpe(rows))


def test_bpe_lexicon_changes_nothing_and_decodes(spark, docs):
    from ranklake.llm import lexicon

    some = docs[:40]
    df = frame(spark, some)
    with_words = {r.doc_id: r.ids for r in bpe.encode(df).collect()}
    without = bpe.decode(bpe.encode(df, lexicon=lexicon.compile_words({}))).collect()
    t = plain.tokenizer()
    for r in without:
        assert r.ids == with_words[r.doc_id]
        assert r.decoded == t.decode(r.ids, skip_special_tokens=False)


def test_another_tokenizer_is_refused(tmp_path):
    import json

    with open(bpe.tokenizer_path(), encoding="utf-8") as f:
        spec = json.load(f)
    spec["pre_tokenizer"] = {"type": "Whitespace"}
    (tmp_path / "other.json").write_text(json.dumps(spec))
    with pytest.raises(ValueError):
        bpe.Merger(str(tmp_path / "other.json"))


def test_lexicon_is_minimal_and_exact():
    from ranklake.llm import lexicon

    words = {b"tap": [1], b"taps": [2, 3], b"top": [4], b"tops": [], b"s": [5], "é".encode(): [6]}
    lex = lexicon.Lexicon(lexicon.mapped(lexicon.compile_words(words)))
    probe = [*words, b"ta", b"tapss", b"", b"x"]
    data = np.frombuffer(b"".join(probe) + b"\0", np.uint8)
    sizes = np.array([len(w) for w in probe])
    ranks = lex.ranks(data, np.cumsum(sizes) - sizes, sizes)
    assert ranks[len(words) :].tolist() == [-1] * 4
    for w, r in zip(words, ranks.tolist(), strict=False):
        assert lex.ids[lex.offsets[r] : lex.offsets[r + 1]].tolist() == words[w]
    assert len(lex.finals) <= 7  # tap, taps, top and tops share their ends


def test_simhash(spark, rows):
    found = simhash.near_duplicates(frame(spark, rows)).collect()
    same([(r.doc_id, f"{r.fp & (1 << 64) - 1:016x}", r.component_id) for r in found], plain.simhash(rows))


def test_simhash_links_of_many_fingerprints(spark):
    rng = random.Random(1)
    base = [rng.getrandbits(64) for _ in range(300)]
    fps = sorted({b ^ sum(1 << k for k in rng.sample(range(64), rng.randrange(4))) for b in base for _ in range(8)})
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f, i) for i, f in enumerate(fps)], "fp long, node long")
    a = np.array(fps, np.uint64)
    pairs = [(i, i + 1 + j) for i in range(len(a)) for j in np.flatnonzero(np.bitwise_count(a[i + 1 :] ^ a[i]) <= 3).tolist()]

    def classes(links):
        root = list(range(len(a)))

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for x, y in links:
            x, y = find(x), find(y)
            root[max(x, y)] = min(x, y)
        return [find(i) for i in range(len(a))]

    for group in (4096, 3):  # 3: every group of keys is cut into blocks
        found = [(r.a, r.b) for r in simhash.link(df, 3, group).collect()]
        assert all(bin(fps[x] ^ fps[y]).count("1") <= 3 for x, y in found)
        assert classes(found) == classes(pairs)


def test_thresholds_cover_all_distances():
    rng = np.random.default_rng(2)
    sample = rng.integers(0, 1 << 62, 500).astype(np.uint64)
    masks = np.array(simhash.plan(sample, 1_000_000), np.uint64)
    for _ in range(3000):
        change = sum(1 << int(b) for b in rng.choice(64, 3, replace=False))
        assert ((np.uint64(change) & masks) == 0).any()


def test_components(spark):
    links = [(i, i + 1) for i in range(100, 150)] + [(7, 7), (3, 9), (9, 5), (5, 3)] + [(1000, i) for i in range(1001, 1040)]
    found = {r.node: r.component for r in components.components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    assert all(found[i] == 100 for i in range(100, 151))
    assert found[9] == found[5] == found[3] == 3 and all(found[i] == 1000 for i in range(1000, 1040))


def test_representatives(spark):
    found = simhash.representatives(frame(spark, ODD))
    assert found.columns == ["text", *EXTRA, "doc_id"]
    ids = [r.doc_id for r in found.collect()]
    wanted = {d for d, _, c in plain.simhash(ODD) if d is not None and d == c}
    assert sorted(i for i in ids if i is not None) == sorted(wanted) and ids.count(None) == 1


def test_packing(spark, rows):
    unique = list({d: (d, t) for d, t in rows}.values())
    found = packing.pack_digests(frame(spark, unique)).collect()
    padding = plain.check_pieces(unique, found)
    if len(unique) > 100:
        assert padding < 0.03


def test_packing_of_short_texts(spark):
    """Texts of few tokens fill their sequences too; hot lengths are ranked in parts."""
    rng = random.Random(8)
    rows = [(i, None if i % 3 == 0 else " ".join("abc" for _ in range(rng.randrange(40)))) for i in range(6000)]
    found = packing.pack_digests(frame(spark, rows)).collect()
    assert plain.check_pieces(rows, found) < 0.03  # one sequence of 42 is the last one
    lengths = spark.createDataFrame([(i, 1 + i % 70) for i in range(3000)], "rid long, n long")
    got = packing.assign(lengths, 2048, 8, 7).collect()
    assert len({r.rid for r in got}) == len(got) == 3000
    used = defaultdict(list)
    for r in got:
        used[r.sequence_id].append((r.offset, r.n))
    for own in used.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= 2048


def test_packing_general(spark):
    some = [(d, t) for d, t in ODD if d in (1, 4, 9, 10, 20)]
    found = packing.pack(frame(spark, some), length=512, end=1).collect()
    t = plain.tokenizer()
    for d, text in some:
        own = sorted((r for r in found if r.doc_id == d), key=lambda r: r.start)
        assert [i for r in own for i in r.ids] == [*t.encode(text or "", add_special_tokens=False).ids, 1]


def test_patterns_meet_demand():
    rng = np.random.default_rng(3)
    for _ in range(5):
        demand = rng.integers(0, 40, 32)
        found = packing.patterns(demand, 32)
        got = np.zeros(32, int)
        for n, used in found:
            assert sum(w * c for w, c in used.items()) <= 32
            for w, c in used.items():
                got[w - 1] += n * c
        assert (got == demand).all()
        bins = []  # first fit by falling length
        for w in np.repeat(np.arange(1, 33), demand)[::-1].tolist():
            at = next((i for i, b in enumerate(bins) if b + w <= 32), None)
            if at is None:
                bins.append(w)
            else:
                bins[at] += w
        assert sum(n for n, _ in found) <= len(bins) + 4


def test_lm_base(spark, rows):
    found = {}
    for r in lm.score(frame(spark, rows)).collect():
        found.setdefault(r.doc_id, r)
    rows = [(d, t) for d, t in rows if d is not None]
    wanted = plain.unigrams(rows)
    assert len({d for d, *_ in wanted} - set(found)) == 0
    for d, held_out, n, known, total, base in wanted:
        r = found[d]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held_out, n, known, total)
        assert abs(r.base_score - base) <= 1e-6 * max(1, abs(base))
        assert r.score <= 0


def test_lm_beats_its_base_on_held_out_texts(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    t = lm.score(df).where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert t.s > t.b


def test_lm_model_does_not_depend_on_partitions(spark, sf, monkeypatch):
    monkeypatch.setattr(lm, "SHARD_TOKENS", 20_000)  # several shards
    df = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id % 2 = 0")
    a, b = ({r.doc_id: r.score for r in lm.score(d).collect()} for d in (df.coalesce(1), df.repartition(7)))
    assert all(abs(a[d] - b[d]) <= 1e-6 * abs(a[d]) for d in a)  # sums may come in another order


def plain_log_probs(m, a, b):
    """p of all symbols after a context, one level after the other, without batches."""
    h = np.append(m.r[a] @ m.c1 + m.r[b] @ m.c2, 1)
    first = np.exp(m.q1 @ h)
    first /= first.sum()
    out = first[m.level].astype(float)
    for g in range(m.groups):
        s = slice(g * lm.GROUP, min((g + 1) * lm.GROUP, m.vocabulary))
        second = np.exp(m.q2[s] @ h)
        out[1 + s.start : 1 + s.stop] *= second / second.sum()
    return out


@pytest.mark.parametrize("vocabulary", [0, 1, 300])
def test_lm_is_normalised(vocabulary):
    rng = np.random.default_rng(1)
    n = 1 + vocabulary + lm.REST
    share = rng.random(n) + 0.1
    m = lm.Model(share / share.sum(), width=6)
    w, one, two = (rng.integers(0, n, 500) for _ in range(3))
    before = m.log_probs(w, one, two).sum()
    for _ in range(20):
        m.learn(w, one, two, {}, rng)
    assert m.log_probs(w, one, two).sum() > before
    every = np.arange(n)
    for a, b in ((0, 0), (3, 17)):
        p = np.exp(m.log_probs(every, np.full(n, a), np.full(n, b)))
        assert abs(p.sum() - 1) < 1e-4
        assert np.allclose(p, plain_log_probs(m, a, b), rtol=1e-3)
    again = lm.Model(share / share.sum(), m.flat(), width=6)
    assert (again.log_probs(w, one, two) == m.log_probs(w, one, two)).all()


def shingles_of(text):
    words = [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]
    return [tuple(words[i : i + 5]) for i in range(len(words) - 4)]


def test_licenses(spark, docs):
    mit = licenses.TEMPLATES["MIT"][2].split()
    near = " ".join(w for i, w in enumerate(mit) if i != 30)
    rows = [*ODD, (30, "x " * 300 + " ".join(mit) + " y" * 200), (31, near), (32, " ".join(mit[:20])), *docs]
    found = licenses.scan(frame(spark, rows)).collect()
    wanted = defaultdict(int)
    for d, text in rows:
        own = set(shingles_of(text))
        for name, texts in licenses.TEMPLATES.items():
            for t in texts:
                s = set(shingles_of(t))
                if len(s & own) >= licenses.LEAST * len(s):
                    wanted[d, name, len(s & own), len(s)] += 1
    got = defaultdict(int)
    for r in found:
        got[r.doc_id, r.license, r.n_matched, r.n_shingles] += 1
    assert got == wanted and any(k[0] == 31 for k in got)
    assert licenses.scan(frame(spark, [])).collect() == []
    with pytest.raises(ValueError):
        licenses.scan(frame(spark, []), templates={"x": ["too short"]})


def test_bands_of_windows_miss_as_rarely_as_stated():
    """Windows of 40 distinct shingles of which 24 of the union are shared, by the masks in use."""
    rng = np.random.default_rng(4)
    masks = np.array(licenses.salts(), np.int64)
    n, missed = 30_000, 0
    for _ in range(10):
        h = rng.integers(-(1 << 63), (1 << 63) - 1, (n // 10, 40))
        # 24 shared, 8 on either side
        a, b = h[:, :32], h[:, np.r_[:24, 32:40]]
        met = np.zeros(len(h), bool)
        for m in masks:
            met |= (a ^ m).min(axis=1) == (b ^ m).min(axis=1)
        missed += int((~met).sum())
    assert missed / n <= 0.0004


@pytest.mark.parametrize("offset", [0, 1, 7, 15, 16, 23, 31])
def test_templates_are_found_at_any_offset(spark, offset):
    """Windows of text and template lie apart by any number of shingles; a fifth of the shingles is lost in places."""
    rng = random.Random(offset)
    templates = {f"T{i}": [" ".join(f"t{i}w{k}" for k in range(24 + 9 * i))] for i in range(12)}
    rows = []
    for i, (own,) in enumerate(templates.values()):
        words = own.split()
        words[rng.randrange(len(words))] = "changed" if i > 3 else words[0]
        rows.append((i, " ".join([f"b{rng.randrange(999)}" for _ in range(offset + 40)] + words + [f"a{rng.randrange(999)}" for _ in range(30)])))
    got = {(r.doc_id, r.license) for r in licenses.scan(frame(spark, rows), templates=templates).collect()}
    wanted = set()
    for d, text in rows:
        for name, (t,) in templates.items():
            s = set(shingles_of(t))
            if len(s & set(shingles_of(text))) >= licenses.LEAST * len(s):
                wanted.add((d, name))
    assert got == wanted and len(wanted) > 8


def test_license_texts_are_found_whole(spark):
    """Every text is found in a longer one, also with a word changed; notices of other versions aren't."""
    names = sorted(f.stem for f in licenses.TEXTS.glob("*.txt"))
    assert {"Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "CC0-1.0", "GPL-2.0", "GPL-3.0", "ISC", "LGPL-2.1", "LGPL-3.0", "MIT", "MPL-2.0", "Unlicense"} <= set(names)
    texts = [(licenses.TEXTS / f"{n}.txt").read_text() for n in names]
    rows = [(i, "before it " * 21 + t + " and after" * 9) for i, t in enumerate(texts)]
    rows += [(i + 100, re.sub(r"\bthe\b", "that", t, count=2)) for i, t in enumerate(texts)]
    notice = "under the terms of the GNU {}General Public License as published by the Free Software Foundation; either version {} of the License"
    notices = {200: ("GPL-2.0", "", "2"), 201: ("GPL-3.0", "", "3"), 202: ("AGPL-3.0", "Affero ", "3"), 203: ("LGPL-2.1", "Lesser ", "2.1"), 204: ("LGPL-3.0", "Lesser ", "3")}
    rows += [(i, notice.format(a, v)) for i, (_, a, v) in notices.items()]
    found = defaultdict(set)
    for r in licenses.scan(frame(spark, rows)).collect():
        found[r.doc_id].add((r.license, r.n_shingles > 50))
    for i, n in enumerate(names):
        assert (n, True) in found[i] and (n, True) in found[i + 100]
    assert {i: found[i] for i in notices} == {i: {(n, False)} for i, (n, _, _) in notices.items()}


def test_quality(spark, rows):
    found = quality.score(frame(spark, rows)).collect()
    same([(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in found], plain.quality(rows))
    assert not any(r.base_failed and r.kept for r in found)


def test_quality_rules_agree_with_labels(spark, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    t = quality.score(spark.read.parquet(f"{sf}/documents.parquet")).join(labels, "doc_id").agg(F.avg((F.col("kept") == (F.col("quality") == 1)).cast("int"))).first()[0]
    assert t > 0.75


def test_quality_rules_leave_other_scripts_alone(spark):
    """Prose of scripts without spaces or with other marks gets no bad vote."""
    texts = ["这是一段很普通的文字。" * 3 + " 它有几个句子。", "これはふつうの文章です。 " * 4, "นี่คือข้อความธรรมดา ไม่มีเครื่องหมาย\n" * 3 + "อีกบรรทัด", "यह एक साधारण वाक्य है।\nयह दूसरा वाक्य है।\nऔर यह तीसरा वाक्य है।", "هذا نص عادي تماما؟\nوهذا سطر آخر،\nوهذا الثالث۔"]
    rows = quality.features(frame(spark, list(enumerate(texts))), "text", "doc_id")
    voted = rows.select("doc_id", *[v.alias(k) for k, v in quality.rules().items() if k not in ("prose", "sentences", "same_lines", "same_words")])
    for r in voted.collect():
        assert min(r[1:]) == 0, r


def test_quality_keep(spark):
    found = quality.keep(frame(spark, ODD))
    assert found.columns == ["text", *EXTRA, "doc_id"]
    wanted = {r.doc_id for r in quality.score(frame(spark, ODD)).where("kept").collect()}
    assert {r.doc_id for r in found.collect()} == wanted


def test_lines(spark, rows):
    own = [(d, t) for d, t in rows if d is not None]
    same(lines.digests(frame(spark, own)).collect(), plain.lines(own))


def test_lines_without_id_come_last(spark):
    found = {r.doc_id: r.n_dropped for r in lines.digests(frame(spark, ODD)).collect()}
    assert found[None] == 1 and found[-5] == 0 and found[6] == 2


def test_lines_hot(spark, monkeypatch):
    """A run of one line that goes on over many ranges."""
    monkeypatch.setattr(lines, "RANGE", 10)
    rows = [(i, f"{LINE}\nline of {i % 7} and more\n{LINE}") for i in range(200)]
    same(lines.digests(frame(spark, rows)).collect(), plain.lines(rows))


def test_dedup_lines(spark):
    found = lines.dedup_lines(frame(spark, ODD))
    assert found.columns == ["text", *EXTRA, "doc_id"]
    texts = {r.doc_id: r.text for r in found.collect()}
    assert texts[1] is None and texts[7] == "short\nown line of document seven"
    assert [hashlib.sha256((texts[d] or "").encode()).hexdigest() for d in (6, 9, -5)] == [x[3] for d in (6, 9, -5) for x in plain.lines([r for r in ODD if r[0] is not None]) if x[0] == d]


def nearest(rows, asks, k=20):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all() and np.any(v)]
    out = {}
    for q, a in good:
        if q in asks:
            best = {}
            for i, v in good:
                if i != q and len(v) == len(a):
                    best[i] = max(best.get(i, -np.inf), float(a @ v))
            out[q] = sorted(((-round(s, 12), i) for i, s in best.items()))[:k]
    return out


def test_ann_recall(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    found = ann.search(df, F.col("vec_id") % 5 == 0).collect()
    truth = nearest(rows, {i for i, _ in rows if i % 5 == 0})
    hit = total = 0
    by = dict(rows)
    for q, best in truth.items():
        own = sorted((r for r in found if r.query_id == q), key=lambda r: r.rank)
        assert [r.rank for r in own] == list(range(1, len(best) + 1))
        assert all(abs(r.score - float(np.array(by[q], float) @ np.array(by[r.vec_id], float))) < 1e-9 for r in own)
        assert [(-round(r.score, 12), r.vec_id) for r in own] == sorted((-round(r.score, 12), r.vec_id) for r in own)
        hit += len({i for _, i in best} & {r.vec_id for r in own})
        total += len(best)
    assert hit >= 0.9 * total


def test_ann_odd_vectors(spark):
    rng = np.random.default_rng(5)
    hot = [1.0, 2.0, 0.5, -1.0]
    rows = [(i, hot) for i in range(60)] + [(i, rng.normal(size=4).tolist()) for i in range(60, 100)]
    rows += [(100, None), (101, [0.0] * 4), (102, [1.0, None, 0.0, 0.0]), (103, [float("nan"), 1.0, 0.0, 0.0]), (104, [float("inf"), 1.0, 0.0, 0.0]), (None, hot), (105, [1.0, 2.0]), (0, hot), (106, [50.0, 1.0, 1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("gid", F.lit(1)).withColumn("v", F.lit(2))
    found = ann.search(df, F.col("vec_id") % 20 == 0).collect()
    truth = nearest([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows], {0, 20, 40, 60, 80, 100})
    got = defaultdict(list)
    for r in sorted(found, key=lambda r: (r.query_id, r.rank)):
        got[r.query_id].append(r.vec_id)
    assert set(got) == set(truth)
    hits = sum(len(set(got[q]) & {i for _, i in truth[q]}) for q in truth)
    assert hits >= 0.9 * sum(map(len, truth.values()))
    assert got[20] == [i for _, i in truth[20]]  # ties go to the smaller id
    assert ann.search(df.limit(0), F.col("vec_id") % 20 == 0).collect() == []


@pytest.mark.parametrize("block", [32_768, 100])
def test_ann_ties_go_to_the_smaller_id(spark, block):
    """All sign vectors of nine places: most inner products are equal to many others."""
    order = list(range(512))
    random.Random(9).shuffle(order)
    rows = [(i, [1.0 if x >> k & 1 else -1.0 for k in range(9)]) for i, x in enumerate(order)] + [(600 + k, [float(j == k) for j in range(9)]) for k in range(9)]
    found = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 20 == 0, block=block).collect()
    truth = nearest(rows, {i for i, _ in rows if i % 20 == 0})
    got = defaultdict(list)
    for r in sorted(found, key=lambda r: (r.query_id, r.rank)):
        got[r.query_id].append((-r.score, r.vec_id))
    assert got == truth
    q, v = np.array([[1.0] * 9]), np.array([r[1] for r in rows[:512]])
    _, vid, s = ann._best(q, np.array([0]), v, np.arange(512), 21)
    assert list(zip((-s).tolist(), vid.tolist(), strict=True)) == sorted((-float(x.sum()), i) for i, x in enumerate(v))[:21]


@pytest.mark.parametrize("kind", ["outlier", "uneven", "heavy"])
def test_ann_recall_with_uneven_norms(spark, sf, kind):
    t = pq.read_table(f"{sf}/embeddings.parquet").to_pydict()
    rng = np.random.default_rng(6)
    n = len(t["vec_id"])
    scale = {"outlier": np.where(np.arange(n) == 7, 3.0, 1.0), "uneven": rng.uniform(0.5, 2, n), "heavy": np.exp(1.5 * rng.normal(size=n))}[kind]
    rows = [(i, (np.array(v, float) * s).tolist()) for i, v, s in zip(t["vec_id"], t["embedding"], scale.tolist(), strict=True)]
    found = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 5 == 0).collect()
    truth = nearest(rows, {i for i, _ in rows if i % 5 == 0})
    own = defaultdict(set)
    for r in found:
        own[r.query_id].add(r.vec_id)
    assert sum(len({i for _, i in best} & own[q]) for q, best in truth.items()) >= 0.9 * sum(map(len, truth.values()))


def pages_plain(rows):
    digest = [hashlib.sha1((h or "").encode()).hexdigest() for _, _, h in rows]
    size = [len((h or "").encode()) for _, _, h in rows]
    first = {}
    for (p, _, _), d, n in zip(rows, digest, size, strict=True):
        if n >= 1000 and p is not None:
            first[d] = max(first.get(d, p), p)
    out = []
    for (p, _, _), d, n in zip(rows, digest, size, strict=True):
        again = n >= 1000 and d in first and p != first[d]
        out.append((p, n, d, "revisit" if again else "response", first[d] if again else None))
    return out


@pytest.mark.parametrize("kind", ["pages", "odd", "none"])
def test_warc(spark, sf, kind):
    if kind == "pages":
        rows = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    else:
        big = "é" * 600
        rows = [(1, "http://A.example:80/x", big), (5, "https://www.a.example/x?y", big), (3, None, big), (2, "", None), (4, "b.example", ""), (6, "http://c.example/\r\nX: 1", "\r\n\r\nWARC/1.1\r\n"), (7, "http://d", "small"), (8, "http://d", "small"), (-9, "http://e", big), (None, "http://f", big), (5, "https://again", big)] if kind == "odd" else []
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1)).withColumn("first", F.lit(1)).withColumn("value", F.lit(1))
    found = warc.archive(df).collect()
    same([(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found], pages_plain(rows))
    inorder = sorted(found, key=lambda r: (r.part, r.place))
    keys = [(r.urlkey, r.timestamp, -1 if r.page_id is None else r.page_id) for r in inorder]
    assert keys == sorted(keys)


def test_warc_records_are_members_that_offsets_address(spark, tmp_path):
    import glob
    import gzip

    rows = [(i, f"http://{i % 5}.example/{i % 3}", "é" * (10 + 400 * (i % 4))) for i in range(200)]
    path = str(tmp_path / "warc")
    warc.write(warc.records(spark.createDataFrame(rows, "page_id long, url string, html string")), path, 2000)
    files = {"/".join(f.split("/")[-2:]): open(f, "rb").read() for f in glob.glob(f"{path}/*/part-*")}
    assert len(files) > 4 and all(len(d) < 2000 + 21 * 200 for d in files.values())
    found = warc.merge(warc.read(spark, path), 30).collect()
    assert len(found) == 200
    for r in found:
        record = gzip.decompress(files[r.run][r.offset : r.offset + r.length])
        assert f"<urn:page:{r.page_id}>" in warc.headers_and_block(record)[0]["warc-record-id"]
    for data in files.values():  # any reader of gzip sees whole records, one after another
        assert gzip.decompress(data).count(b"WARC/1.1\r\n") == sum(1 for _ in warc.parse(memoryview(data)))
    inorder = [(r.urlkey, r.timestamp, r.page_id) for r in sorted(found, key=lambda r: (r.part, r.place))]
    assert inorder == sorted(inorder)
    dated = warc.records(spark.createDataFrame([(1, None, None, "2020-02-03 04:05:06")], "page_id long, url string, html string, at string"), date="at")
    warc.write(dated, str(tmp_path / "dated"))
    assert warc.read(spark, str(tmp_path / "dated")).first().timestamp == "20200203040506"


def test_loser_tree():
    rng = random.Random(2)
    for k in (0, 1, 2, 3, 7, 16):
        runs = [sorted(rng.randrange(50) for _ in range(rng.randrange(9))) for _ in range(k)]
        assert list(warc.LoserTree([iter(r) for r in runs], lambda x: x)) == sorted(x for r in runs for x in r)


def test_toxicity_held_out(spark, sf):
    d = "/root/testdata/sf0.01" if sf.endswith("sf0.001") else sf
    labels = spark.read.parquet(f"{d}/labels.parquet")
    found = toxicity.classify(spark.read.parquet(f"{d}/documents.parquet"), labels)
    rows = found.where("held_out").join(labels, "doc_id").select("score", "toxic").collect()
    pos, neg = ([r.score for r in rows if r.toxic == k] for k in (1, 0))
    auc = np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])
    assert auc > 0.9


def test_toxicity_terms_are_those_of_a_plain_count(spark, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    rows = toxicity.sample(docs, labels, "text", "doc_id", "toxic").orderBy("doc_id").collect()
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    label = np.array([float(r.label) for r in rows])
    import pyarrow as pa

    own = toxicity.choose(*toxicity.tallies(pa.array([text[r.doc_id] for r in rows]), label), float(label.mean()))
    found = toxicity.vocabulary_of(spark.createDataFrame(rows), len(rows), int(label.sum()))
    assert len(own) > 100 and len(set(own.tolist()) ^ set(found.tolist())) <= 0.01 * len(own)  # gains may differ in the last bit


def test_toxicity_learns_from_long_texts_and_never_from_held_out_labels(spark):
    import zlib

    rng = random.Random(6)
    held = lambda d: zlib.crc32(str(d).encode()) % 5 == 0
    rows = [(d, " ".join(rng.choice(["vile", "plain"] if d % 2 else ["calm", "plain"]) if k % 10 == 0 else f"w{rng.randrange(99)}" for k in range(20_000 if d % 2 else 50))) for d in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    labels = [(d, d % 2) for d in range(60)]
    turned = [(d, 1 - t if held(d) else t) for d, t in labels]
    score = lambda own: {r.doc_id: r.score for r in toxicity.classify(docs, spark.createDataFrame(own, "doc_id long, toxic int")).collect()}
    found = score(labels)
    assert all((found[d] >= 0.5) == (d % 2 == 1) for d in found)
    assert found == score(turned)


def test_toxicity_odd(spark):
    empty = spark.createDataFrame([], "doc_id long, toxic int")
    found = toxicity.classify(frame(spark, ODD), empty).collect()
    assert len(found) == len(ODD) and {r.score for r in found} == {0.5}
    labels = spark.createDataFrame([(d, d % 2) for d in (4, 6, 7, 7, 8, 9, 11, 12)] + [(None, 1), (4, None), (9, 3)], "doc_id long, toxic int")
    found = toxicity.classify(frame(spark, ODD), labels).collect()
    assert len(found) == len(ODD) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in found)
    assert len({r.score for r in found if r.doc_id in (1, 2, 3)}) == 1
    assert toxicity.classify(frame(spark, []), labels).collect() == []


def test_pairs_count_in_toxicity():
    """Two terms that are toxic together only, which no linear weights can tell."""
    import pyarrow as pa

    rng = random.Random(4)
    texts, label = [], []
    for _ in range(1500):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        texts.append(" ".join(["insult" if a else "praise", "group" if b else "nobody", rng.choice(["one", "two", "three"])]))
        label.append(float(a == b))
    m = toxicity.train(pa.array(texts), np.array(label), rounds=60)
    assert np.mean((m.scores(pa.array(texts)) >= 0.5) == np.array(label)) > 0.95


def test_queries_are_complete():
    assert sorted({int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES}) == list(range(1, 11))
