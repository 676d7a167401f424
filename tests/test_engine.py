"""The retrieval engine on small corpora with known results, and its queries against DuckDB."""

from __future__ import annotations

import glob
import math
import os
from dataclasses import replace

import duckdb
import pytest
from pyspark.sql import functions as F

from ranklake import queries
from ranklake.functions.show import highlight, snippet
from ranklake.functions.text import TextOptions, normalize_all, tokenize, tokenize_local
from ranklake.operators import filters, fusion, semantic
from ranklake.operators.index import Options, Scoring, audit, build, describe, details, options_of, recommend, status
from ranklake.operators.score import distance, distance_of_text, matches, order_tokens, overlap, prepared, query_tokens, search, search_native, search_prepared, search_tokens
from ranklake.plans import query as Q
from ranklake.sources import tables
from ranklake.streaming import delta

TOKENS = [(1, ["cat", "cat", "feline"]), (2, ["dog", "friend"]), (3, ["cat", "bird", "bird"]), (4, [])]
SIX = ["blue bird flies over the river", "red fox sleeps beside a tree", "blue fox and blue bird share a forest", "postgresql inverted index supports fast lexical search", "semantic retrieval and lexical retrieval cooperate", "bird migration follows the river valley"]


@pytest.fixture(scope="module")
def tokens(spark):
    return build(spark.createDataFrame(TOKENS, "id int, tokens array<string>"), "id", "tokens")


@pytest.fixture(scope="module")
def six(spark):
    return build(spark.createDataFrame(list(enumerate(SIX)), "id int, body string"), "id", "body", Options(text=TextOptions(lowercase=True)))


def got(df):
    return [(r.doc_id, r.score) for r in sorted(df.collect(), key=lambda r: r["rank"])]


def near(found, wanted, tolerance=1e-5):
    assert [d for d, _ in found] == [d for d, _ in wanted]
    for (_, a), (_, b) in zip(found, wanted, strict=True):
        assert math.isclose(a, b, rel_tol=tolerance, abs_tol=tolerance)


QUERIES = {
    "bird cat missing": [(3, 0.8190589), (1, 0.3412417), (2, 0)],
    "bi* cat": [(3, 0.8190589), (1, 0.3412417), (2, 0)],
    "+cat -bird": [(1, 0.3412417)],
    '"cat bird"': [(3, 0.8190589)],
    "cat AND bird": [(3, 0.8190589)],
    "cat AND NOT bird": [(1, 0.3412417)],
    "cat OR bird AND missing": [(3, 0.8190589), (1, 0.3412417)],
    "cat AND NOT (bird OR dog)": [(1, 0.3412417)],
    '"cat bird" OR (cat AND feline)': [(1, 1.0756173), (3, 1.0453926)],
}


@pytest.mark.parametrize("text", QUERIES)
def test_queries(tokens, text):
    near(got(search(tokens, text, 3)), QUERIES[text])


def test_stored_index_ranks_alike(spark, tokens, tmp_path):
    tables.save(tokens, str(tmp_path / "index"))
    stored = tables.load(spark, str(tmp_path / "index"))
    assert stored.stored and stored.options == tokens.options
    for text in ("bird cat missing", "bi* cat", "+cat -bird"):
        near(got(search(stored, text, 3)), QUERIES[text])
    assert set(audit(stored).first()) == {0}
    assert details(stored).first().n_empty == 1 and describe(stored)["k1"] == 1.5


def test_stopwords_of_a_query(tokens):
    near(got(search(tokens, "CAT and BIRD", 3, lowercase=True, stopwords="and")), QUERIES["bird cat missing"])


def test_predicates(tokens):
    wanted = {"cat": [1, 3], "+cat -bird": [1], '"cat bird"': [3], "cat OR bird AND missing": [1, 3], "cat AND (bird OR dog)": [3], "NOT bird": [1, 2, 4]}
    for text, ids in wanted.items():
        assert sorted(r.doc_id for r in matches(tokens, text).select("doc_id").collect()) == ids


@pytest.mark.parametrize("method", ["lucene", "bm25+"])
def test_ids(spark, method):
    df = spark.createDataFrame([(1, [0, 0, 1]), (2, [1, 2]), (3, [0, 2, 2]), (4, [3])], "id int, token_ids array<int>")
    index = build(df, "id", "token_ids", Options(Scoring(method=method, idf_method=method)))
    wanted = {"bm25+": [(3, 2.895376), (1, 2.098601), (2, 1.880807)], "lucene": [(3, 0.5988481), (1, 0.3577534), (2, 0.2918514)]}[method]
    near(got(search_tokens(index, {0: [0, 2]}, 3)), wanted)


def test_ties_and_no_idf(spark):
    df = spark.createDataFrame([(1, [0]), (2, [0]), (3, [0]), (4, [1])], "id int, token_ids array<int>")
    near(got(search_tokens(build(df, "id", "token_ids"), {0: [0]}, 2)), [(1, 0.14266998), (2, 0.14266998)])
    same = build(df.where("id < 4"), "id", "token_ids", Options(Scoring(method="robertson", idf_method="robertson")))
    near(got(search_tokens(same, {0: [0, 0, 0]}, 3)), [(1, 0), (2, 0), (3, 0)])


def test_columns(spark):
    rows = [(1, ["cat"], ["feline"]), (2, ["bird"], ["cat"]), (3, ["dog"], ["bird", "bird"]), (4, [], ["cat"]), (5, None, ["cat", "bird"]), (6, ["bird"], None)]
    df = spark.createDataFrame(rows, "id int, title array<string>, body array<string>")
    fused = build(df, "id", ["title", "body"])
    near(got(search(fused, "cat bird", 5)), [(2, 0.33957452), (5, 0.33957452), (4, 0.22217876), (6, 0.22217876), (3, 0.2096026)])
    aware = build(df, "id", ["title", "body"], Options(field_aware=True))
    near(got(search(aware, "bird", 6, fields=["title", "body"], weights=[3.0, 1.0])), [(6, 1.553250), (2, 1.186980), (3, 0.488445), (5, 0.395662), (1, 0), (4, 0)])
    with pytest.raises(Q.QueryError):
        search(aware, "bird", 6, fields=["title", "body"], weights=[-1.0, 1.0])


GOLDEN = {
    "blue bird river": [(0, 1.140431), (2, 0.798901), (5, 0.713816), (1, 0), (3, 0), (4, 0)],
    '"blue bird"': [(2, 0.798901), (0, 0.713816)],
    "+blue -fox": [(0, 0.426615)],
}


@pytest.mark.parametrize("text", GOLDEN)
def test_texts(six, text):
    near(got(search(six, text, 6)), GOLDEN[text])


def test_text_functions(spark):
    assert normalize_all(["Running", "runs", "THE"], TextOptions.of(stem_english=True, stopwords="the")) == ["run", "run"]
    assert normalize_all(["CAFÉ", "Straße", "Über"], TextOptions.of(True, fold_diacritics=True)) == ["cafe", "strasse", "uber"]
    df = spark.createDataFrame([("Cat, and dog!",), (None,)], "t string")
    assert [r[0] for r in df.select(tokenize(F.col("t"), TextOptions.of(True, "and"))).collect()] == [["cat", "dog"], []]
    assert tokenize_local("Cat, and dog!", TextOptions.of(True, "and")) == ["cat", "dog"]


WORDS = [
    ("Can't stop e-mail at mail3.example.com", ["can't", "stop", "e", "mail", "at", "mail3", "example.com"]),
    ("3.14 1,000;2 a1b2 _x_ __ x_1", ["3.14", "1,000;2", "a1b2", "_x_", "x_1"]),
    ("foo:bar it’s", ["foo:bar", "it’s"]),
    ("STRASSE Straße", ["strasse", "strasse"]),
    ("ΟΔΟΣ Οδός οδος", ["οδοσ", "οδόσ", "οδοσ"]),  # a final sigma is a sigma
    ("caf\u0065\u0301 CAF\u00c9", ["café", "café"]),  # decomposed and composed
    ("漢字かカタ 한국어", ["漢", "字", "か", "カタ", "한국어"]),
    ("ﬁne İx", ["fine", "i̇x"]),
    ("", []),
    ("a" * 9000 + "1a" * 9000, ["a" * 9000 + "1a" * 9000]),
]


def test_words_and_folding_by_hand(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(WORDS)], "i int, t string")
    found = {r.i: r.w for r in df.select("i", tokenize(F.col("t")).alias("w")).collect()}
    for i, (text, words) in enumerate(WORDS):
        assert found[i] == words and tokenize_local(text) == words


def test_documents_and_queries_fold_alike(spark):
    """Each word is found in a document that spells it otherwise."""
    pairs = [("ΛΟΓΟΣ", "λογος"), ("cafe\u0301", "CAFÉ"), ("Straße", "STRASSE"), ("ﬁne", "FINE"), ("İ", "i̇"), ("ǰ", "J\u030c")]
    texts = spark.createDataFrame([(i, d) for i, (d, _) in enumerate(pairs)], "id long, t string")
    arrays = texts.select("id", F.array("t").alias("t"))
    for df in (texts, arrays):
        index = build(df, "id", "t", Options(text=TextOptions(lowercase=True)))
        for i, (d, q) in enumerate(pairs):
            assert [r.doc_id for r in matches(index, q).collect()] == [i] == [r.doc_id for r in matches(index, d).collect()]


@pytest.mark.parametrize("text", ["bird cat missing", "+cat -bird", '"cat bird"'])
@pytest.mark.parametrize("method", ["robertson", "lucene", "atire", "bm25l", "bm25+"])
def test_scans_and_postings_rank_alike(spark, tokens, text, method, monkeypatch):
    from ranklake.operators import score

    own = tokens.with_options(scoring=Scoring(method=method, idf_method=method))
    scanned = got(search(own, text, 4))
    monkeypatch.setattr(score, "SCANNED_TERMS", -1)
    near(got(search(own, text, 4)), scanned)


def test_limits_of_scans_and_postings_agree(spark, monkeypatch):
    own = build(spark.createDataFrame([(i, t, i % 3) for i, t in enumerate(SIX)] + [(9, None, None)], "id int, body string, kind int"), "id", "body", Options(text=TextOptions(lowercase=True)))
    few = spark.createDataFrame([(0,), (2,), (2,), (5,), (9,)], "doc_id int")
    weights = spark.createDataFrame([(i, i / 2) for i in (*range(6), 9)], "doc_id int, weight double")
    ways = [{"where": F.col("kind") > 0}, {"allowed": few}, {"where": F.col("kind") != 1, "allowed": few}, {"mask": weights}]
    texts = {1: "blue bird", 2: "blue OR river", 3: "+bird -river"}
    run = lambda how: sorted((r.query_id, r["rank"], r.doc_id, round(r.score, 9)) for r in search(own, texts, 4, **how).collect())
    scanned = [run(how) for how in ways]
    assert all(scanned)
    monkeypatch.setattr("ranklake.operators.score.SCANNED_TERMS", 0)
    assert [run(how) for how in ways] == scanned


def test_a_scan_reads_the_texts_once(spark, tmp_path):
    spark.createDataFrame(list(enumerate(SIX)), "id int, body string").write.parquet(f"{tmp_path}/six")
    own = build(spark.read.parquet(f"{tmp_path}/six"), "id", "body", Options(text=TextOptions(lowercase=True)))
    found = search(own, {1: "blue bird", 2: "blue OR river"}, 4)
    assert found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString()
    final = plan[: plan.index("== Initial Plan ==")] if "== Initial Plan ==" in plan else plan
    assert "ReusedExchange" in final and final.count("FileScan parquet") == 1


def test_highlight_and_snippet(spark):
    df = spark.createDataFrame([(["zero", "one", "two", "cat", "bird", "three", "four"],)], "t array<string>")
    h, s = df.select(highlight(F.col("t"), "bi* cat", "<mark>", "</mark>"), snippet(F.col("t"), '"cat bird"', 4, "<mark>", "</mark>")).first()
    assert h == "zero one two <mark>cat</mark> <mark>bird</mark> three four"
    assert s == "... one two <mark>cat</mark> <mark>bird</mark> ..."


def test_overlap(tokens):
    wanted = query_tokens("CAT and BIRD", stopwords="and")
    rows = {r.doc_id: (r.a, r.b) for r in tokens.documents.select("doc_id", overlap(F.col("tokens"), wanted).alias("a"), distance(F.col("tokens"), wanted).alias("b")).collect()}
    assert rows == {1: (1, -1), 2: (0, 0), 3: (2, -2), 4: (0, 0)}


def test_fusion(tokens):
    found = fusion.fuse_queries([(tokens, "bird", 2.0), (tokens, "cat", 1.0)], 3, 3)
    near(got(found), [(3, 1.4117839), (1, 0.3412417), (2, 0)])


def candidates(spark, rows):
    return spark.createDataFrame(rows, fusion.CANDIDATE)


def test_hybrid(spark):
    rrf = candidates(spark, [("title", 1, 1.0, 1, 2.0, None, None), ("embedding", 1, 0.2, 2, 1.0, None, "lower"), ("embedding", 2, 0.1, 1, 1.0, None, "lower")])
    rows = fusion.hybrid(rrf, 10).collect()
    assert [(r.doc_id, round(r.score, 6), r.source_names, r.ranks) for r in rows] == [(1, 0.048916, ["embedding", "title"], [2, 1]), (2, 0.016393, ["embedding"], [1])]
    norm = candidates(spark, [("title", 1, 10.0, None, 2.0, "minmax", "higher"), ("title", 2, 5.0, None, 2.0, "minmax", "higher"), ("distance", 1, 0.4, None, 3.0, "minmax", "lower"), ("distance", 2, 0.1, None, 3.0, "minmax", "lower")])
    assert [(r.doc_id, r.score) for r in fusion.hybrid(norm, 10, "score").collect()] == [(2, 3.0), (1, 2.0)]
    bad = candidates(spark, [("a", 1, float("nan"), 1, 1.0, None, None), ("a", 2, float("inf"), 1, 1.0, None, None)])
    assert fusion.hybrid(bad, 10).collect() == []


def test_filters(spark):
    df = spark.createDataFrame([(1, "en", ["x", "Yes"], 3.0), (2, None, ["z"], 5.0), (3, "de", None, None)], "id int, lang string, tags array<string>, v double")
    ids = lambda spec: sorted(r.id for r in df.where(filters.condition(df, spec)).collect())
    assert ids({"lang": {"eq": None}}) == [2] and ids({"lang": {"in": []}}) == []
    assert ids({"tags": {"overlap": ["z", "q"]}}) == [2] and ids({"tags": {"ilike": "y%"}}) == [1]
    assert ids({"v": {"range": {"gt": 3}}}) == [2] and ids('{"v": {"gte": 3, "lt": 5}}') == [1]
    for spec in ({"none": {"eq": 1}}, {"lang": {"like": "x"}}, {"lang": {"eq": 1, "in": [1]}}, {"v": {"ilike": "x"}}, {"v": {"range": {}}}):
        with pytest.raises(Q.QueryError):
            filters.condition(df, spec)


@pytest.mark.parametrize("text", ['"open', '""', "*", "+", "(a", "a AND", "a )", "NOT"])
def test_bad_queries(text):
    with pytest.raises(Q.QueryError):
        Q.parse(text)


def test_bad_options():
    for bad in ({"k1": -1.0}, {"b": 1.5}, {"method": "Lucene"}, {"delta": float("nan")}):
        with pytest.raises(Q.QueryError):
            Scoring(**bad)
    assert recommend("write_first")["consistency"] == "manual"


def test_options_of_both_kinds():
    assert options_of({"k1": "1.2", "text_stopwords": "a, b"}).scoring.k1 == 1.2
    own = options_of({"sae": "true", "semantic_impact_precision": "fp16"})
    assert own.sae and own.consistency == "eventual"
    for bad in ({"sae": True, "k1": 1.5}, {"semantic_alpha_mass": 1.0}, {"sae": True, "consistency": "realtime"}, {"no": 1}, {"sae": "maybe"}, {"sae": True, "semantic_alpha_mass": 0.0}):
        with pytest.raises(Q.QueryError):
            options_of(bad)


def test_prepared_and_native(six, tokens):
    p = prepared(six, '"Blue bird" -fox +River')
    assert order_tokens(p) == ["blue", "bird", "river"]
    assert got(search_prepared(prepared(six, "blue -fox +blue"), 6)) == got(search(six, "blue -fox +blue", 6))
    rows = search_native(six, "blue bird", 3, "body LIKE '%forest'").collect()
    assert [(r.doc_id, r.body) for r in rows] == [(2, SIX[2])] and rows[0].score > 0
    assert len(got(search(tokens, "cat", 4, positive_only=True))) == 2
    with pytest.raises(Q.QueryError):
        search_native(six, "blue", 3, "doc_id IN (SELECT 1)")


def test_distance_of_text(spark):
    df = spark.createDataFrame([("The CAT, the dog",), (None,), ("",)], "t string")
    assert [r[0] for r in df.select(distance_of_text(F.col("t"), ["cat", "the", "the", "x"])).collect()] == [3.0, None, 0.0]


def test_requests_and_windows(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    assert [len(b) for b in semantic.batches_of(["x"] * 1100)] == [512, 512, 76]
    assert [len(b) for b in semantic.batches_of(["é" * 300_000] * 3 + [None])] == [1, 1, 2]
    with pytest.raises(Q.QueryError):
        list(semantic.batches_of(["x" * 1_048_576]))
    encoder = semantic.batched(lambda texts: [[(len(t), 1.0)] for t in texts])
    df = spark.createDataFrame([("two",), (None,)], "t string")
    assert [[tuple(a) for a in r[0]] for r in df.select(encoder(F.col("t"))).collect()] == [[(3, 1.0)], [(0, 1.0)]]
    path = public_tokenizers.path("byte_bpe_50k.json")
    text = "some words of a longer text " * 100
    out = spark.createDataFrame([(text,), (None,)], "t string").select(semantic.token_windows(F.col("t"), path)).collect()
    assert max(map(len, out[0][0])) == 256 and sum(out[0][0], []) == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids and out[1][0] == []


def test_half_precision(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    values = np.concatenate([[0.0, 2.0**-24, 2.0**-25, 1.5 * 2.0**-24, 65504.0, 1.0, 2.0, 1.99999, 1 + 2.0**-11, 1 + 3 * 2.0**-11], np.exp(rng.normal(0, 4, 500))])
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    found = [r[0] for r in df.select(semantic.as_precision(F.col("v"), "fp16")).collect()]
    assert found == [min(float(np.float16(v)), 65504.0) for v in values]


def test_semantic(spark):
    atoms = spark.createDataFrame([(1, 1, 3.0), (1, 2, 1.0), (1, 3, 0.5), (2, 1, 1.0)], "doc_id long, atom int, weight double")
    assert sorted(tuple(r)[:2] for r in semantic.by_mass(atoms, 0.8).collect()) == [(1, 1), (1, 2), (2, 1)]
    assert [r.atom for r in semantic.heavy_hitters(atoms, 2).collect()] == [1, 2]
    with pytest.raises(Q.QueryError):
        semantic.checked(atoms.unionByName(atoms))


def test_stream_of_changes(spark, tmp_path):
    schema = "seq long, op string, doc_id long, text string"
    spark.createDataFrame([(1, "upsert", 7, "new incremental lexical document"), (2, "retire", 0, None), (3, "upsert", 7, "incremental lexical")], schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    delta.follow(stream, str(tmp_path / "log"), str(tmp_path / "check")).awaitTermination()
    log = spark.read.parquet(str(tmp_path / "log"))
    base = spark.createDataFrame(list(enumerate(SIX)), "doc_id long, text string")
    live = {r.doc_id: r.text for r in delta.live(base, log).collect()}
    assert live.keys() == {1, 2, 3, 4, 5, 7} and live[7] == "incremental lexical"
    manual = delta.indexed(base, log, "doc_id", "text", Options(text=TextOptions(lowercase=True), consistency="manual"))
    assert manual.corpus.first().n_docs == 6
    assert delta.due(0, 1e9) is False and delta.due(65_536, 0) and delta.due(1, 3600)


@pytest.mark.parametrize("stored", [False, True])
def test_a_log_over_a_base(spark, tmp_path, stored):
    rows = list(enumerate(SIX))
    log = spark.createDataFrame([(1, "upsert", 7, "blue bird again"), (2, "retire", 0, None), (3, "upsert", 2, "red tree"), (4, "upsert", 7, "blue tree"), (5, "retire", 99, None)], "seq long, op string, doc_id long, text string")
    base = spark.createDataFrame(rows, "doc_id long, text string")
    options = Options(text=TextOptions(lowercase=True))
    index = build(base, "doc_id", "text", options)
    if stored:
        tables.save(index, str(tmp_path / "base"))
        index = tables.load(spark, str(tmp_path / "base"))
    rebuilt = delta.indexed(base, log, "doc_id", "text", options)
    full = delta.overlaid(index, log)
    for own in (full, delta.merged(index, log, str(tmp_path / "next"))):
        for part in ("documents", "postings", "terms", "corpus"):
            cols = [c for c in ("doc_id", "term", "field", "tf", "dl", "df", "n_docs", "total_len") if c in getattr(rebuilt, part).columns]
            rows_of = lambda i: sorted(map(tuple, getattr(i, part).select(*cols).collect()))  # noqa: E731, B023
            assert rows_of(own) == rows_of(rebuilt)
        assert got(search(own, "blue tree", 6)) == got(search(rebuilt, "blue tree", 6))
        assert set(audit(own).first()) == {0}
    lazy = delta.overlaid(index.with_options(consistency="eventual"), log)
    assert status(lazy)["query_ready"] and status(lazy)["stale"] and lazy.pending == 5
    manual = delta.overlaid(index.with_options(consistency="manual"), log)
    assert manual.corpus.first().n_docs == 6 and status(manual)["stale"]
    late = replace(index, pending=3)
    assert status(late)["blocker"] == "pending_records"
    assert delta.merged_if_due(index, log, str(tmp_path / "no"), 1.0) is index


CHECKED = ["delta_overlaid", "stored_search", "metrics", "ids_topk", "native_search", "hybrid_arrays", "atoms_fp16", "semantic_pooled", "bm25_bm25plus", "index_terms", "ranked_or_not", "ranked_prefix", "filter_overlap", "weight_mask", "columns_field_aware", "batch_topk", "hybrid_zscore", "delta_search", "snippet"]


@pytest.mark.parametrize("name", CHECKED)
def test_oracle(spark, sf, name):
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    df = queries.QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    text = lambda rows: sorted(tuple("%.6g" % x if isinstance(x, float) else str(x) for x in r) for r in rows)
    want = con.execute(f"SELECT {', '.join(cols)} FROM ({queries.ORACLES[name]})").fetchall()
    assert text(df.select(*cols).collect()) == text(want)


def test_every_query_has_an_oracle_or_is_known_to_have_none():
    assert set(queries.QUERIES) - set(queries.ORACLES) == {"tokenize_stem_fold", "semantic_encoded"}
