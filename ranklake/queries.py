"""Queries over the driver's tables, and their oracle SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.show import highlight, snippet
from .functions.text import TextOptions, normalize_tokens, tokenize
from .operators import filters, fusion, metrics, semantic
from .operators.index import METHODS, Index, Options, Scoring, audit, build, describe, details, status
from .operators.score import distance, distance_of_text, matches, order_tokens, overlap, prepared, query_tokens, search, search_native, search_prepared, search_texts, search_tokens
from .operators.scratch import once
from .sources.tables import load, read, save, shared_folder
from .streaming import delta

Q1, Q2, Q3 = "the thand reer", "licensed apache version", "la que de"
BATCH = {1: Q1, 2: Q2, 3: Q3}
LOWER = TextOptions(lowercase=True)
RANKED = ["query_id", "doc_id", "score", "rank"]


def _index(spark: SparkSession, sf: str, method: str = "lucene", idf: str | None = None, docs: DataFrame | None = None) -> Index:
    docs = read(spark, sf, "documents") if docs is None else docs
    return build(docs, "doc_id", "text", Options(Scoring(method=method, idf_method=idf or method), LOWER))


def _out(hits: DataFrame, *columns: str) -> DataFrame:
    return hits.select(*(columns or RANKED)).withColumn("score", F.round("score", 6))


# --- oracle SQL ------------------------------------------------------------

# words of Latin text by the Unicode rules: letters with inner marks, numbers with inner marks, joined by underscores
_RUN = r"(?:\p{L}+(?:[:·.‘’']\p{L}+)*|[0-9]+(?:[,;.‘’'][0-9]+)*)+"
LIT = rf"_*{_RUN}(?:_+{_RUN})*_*".replace("'", "''")
FOLDED = "replace(lower(coalesce(text, '')), 'ß', 'ss')"
TOKENS = f"regexp_extract_all({FOLDED}, '{LIT}')"


def _base(source: str = "documents", tokens: str = TOKENS, key: str = "doc_id") -> str:
    return f"""tok AS (SELECT {key} AS doc_id, {tokens} AS tokens FROM {source}),
dl AS (SELECT doc_id, len(tokens)::BIGINT AS dl FROM tok),
p AS (SELECT doc_id, term, count(*)::BIGINT AS tf FROM (SELECT doc_id, unnest(tokens) AS term FROM tok) GROUP BY doc_id, term),
t AS (SELECT term, count(*)::BIGINT AS df FROM p GROUP BY term),
c AS (SELECT count(*)::DOUBLE AS n, sum(dl)::DOUBLE / count(*) AS avgdl FROM dl)"""


def _tf(m: str, tf: str = "p.tf") -> str:
    norm = "(1 - 0.75 + 0.75 * dl.dl / c.avgdl)"
    return {
        "lucene": f"{tf} / (1.5 * {norm} + {tf})",
        "robertson": f"{tf} / (1.5 * {norm} + {tf})",
        "atire": f"{tf} * 2.5 / ({tf} + 1.5 * {norm})",
        "bm25l": f"2.5 * ({tf} / {norm} + 0.5) / (1.5 + {tf} / {norm} + 0.5)",
        "bm25+": f"2.5 * {tf} / (1.5 * {norm} + {tf}) + 0.5",
    }[m]


def _idf(m: str) -> str:
    r = "(c.n - t.df + 0.5) / (t.df + 0.5)"
    return {"robertson": f"ln(greatest(1, {r}))", "lucene": f"ln(1 + {r})", "atire": "ln(c.n / t.df)", "bm25l": "ln((c.n + 1) / (t.df + 0.5))", "bm25+": "ln((c.n + 1) / t.df)"}[m]


ABSENT = {"bm25l": "(2.5 * 0.5 / 2.0)", "bm25+": "0.5"}


def _values(queries: dict[int, str]) -> str:
    return ", ".join(f"({q}, '{w}')" for q, text in queries.items() for w in text.split())


def _scores(q: str, m: str = "lucene", i: str | None = None, among: str = "TRUE") -> str:
    """CTEs up to s(query_id, doc_id, score) over every document that counts; q: a table of query_id, term."""
    absent = ABSENT.get(m, "0")
    return f"""w AS (SELECT query_id, term, count(*)::DOUBLE AS qw FROM {q} GROUP BY query_id, term),
k AS (SELECT query_id, sum(qw * {_idf(i or m)} * {absent}) AS constant FROM w JOIN t USING (term), c GROUP BY query_id),
h AS (SELECT w.query_id, p.doc_id, sum(w.qw * {_idf(i or m)} * ({_tf(m)} - {absent})) AS score
      FROM w JOIN p USING (term) JOIN t USING (term) JOIN dl USING (doc_id), c GROUP BY w.query_id, p.doc_id),
s AS (SELECT g.query_id, tok.doc_id, coalesce(h.score, 0) + coalesce(k.constant, 0) AS score
      FROM (SELECT DISTINCT query_id FROM {q}) g CROSS JOIN tok LEFT JOIN h ON h.query_id = g.query_id AND h.doc_id = tok.doc_id
      LEFT JOIN k ON k.query_id = g.query_id WHERE {among})"""


def _top(k: int, s: str = "s") -> str:
    return f"""SELECT query_id::BIGINT AS query_id, doc_id, round(score, 6) AS score, rank FROM (
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id)::INT AS rank FROM {s}) WHERE rank <= {k}"""


def _sql(queries: dict[int, str], k: int = 10, m: str = "lucene", i: str | None = None, among: str = "TRUE") -> str:
    return f"WITH {_base()}, q(query_id, term) AS (VALUES {_values(queries)}), {_scores('q', m, i, among)} {_top(k)}"


def _has(word: str) -> str:
    return f"list_contains(tok.tokens, '{word}')"


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


# --- BM25 ------------------------------------------------------------------

for _m in METHODS:
    _name = f"bm25_{_m.replace('+', 'plus')}"
    query(_name, _sql(BATCH, 10, _m))(lambda spark, sf, m=_m: _out(search(_index(spark, sf, m), BATCH, 10)))
for _m, _i in zip(METHODS, (*METHODS[1:], METHODS[0]), strict=True):
    _name = f"bm25_{_m}_idf_{_i}".replace("+", "plus")
    query(_name, _sql(BATCH, 10, _m, _i))(lambda spark, sf, m=_m, i=_i: _out(search(_index(spark, sf, m, i), BATCH, 10)))


@query("index_terms", f"WITH {_base()} SELECT term, df FROM t")
def index_terms(spark, sf):
    return _index(spark, sf).terms.select("term", "df")


@query("index_postings", f"WITH {_base()} SELECT term, doc_id, tf, dl FROM p JOIN dl USING (doc_id)")
def index_postings(spark, sf):
    return _index(spark, sf).postings.select("term", "doc_id", "tf", "dl")


@query("index_corpus", f"WITH {_base()} SELECT count(*) AS n_docs, sum(dl)::BIGINT AS total_len FROM dl")
def index_corpus(spark, sf):
    return _index(spark, sf).corpus


@query("index_audit", "SELECT 0::BIGINT AS wrong_lengths, 0::BIGINT AS wrong_frequencies, 0::BIGINT AS orphan_postings")
def index_audit(spark, sf):
    return audit(_index(spark, sf))


@query("tokenize", f"SELECT doc_id, array_to_string({TOKENS}, ' ') AS tokens FROM documents")
def tokenize_query(spark, sf):
    return read(spark, sf, "documents").select("doc_id", F.array_join(tokenize(F.col("text"), LOWER), " ").alias("tokens"))


@query("normalize_stopwords", f"SELECT doc_id, array_to_string([x for x in {TOKENS} if x NOT IN ('the', 'la', 'der')], ' ') AS tokens FROM documents")
def normalize_stopwords(spark, sf):
    own = TextOptions.of(lowercase=True, stopwords="the, la ,der")
    return read(spark, sf, "documents").select("doc_id", F.array_join(normalize_tokens(tokenize(F.col("text"), LOWER), own), " ").alias("tokens"))


@query("tokenize_stem_fold")
def tokenize_stem_fold(spark, sf):
    own = TextOptions.of(True, (), True, True)
    return read(spark, sf, "documents").select("doc_id", F.array_join(tokenize(F.col("text"), own), " ").alias("tokens"))


# --- the query language ----------------------------------------------------

TEXTS = {
    "match_and": ("the AND licensed", f"{_has('the')} AND {_has('licensed')}"),
    "match_or_not": ("(apache OR mit) AND NOT the", f"({_has('apache')} OR {_has('mit')}) AND NOT {_has('the')}"),
    "match_must": ("+licensed -the version", f"{_has('licensed')} AND NOT {_has('the')}"),
    "match_prefix": ("licen*", "len([x for x in tok.tokens if starts_with(x, 'licen')]) > 0"),
    "match_phrase": ('"apache license"', "contains(' ' || array_to_string(tok.tokens, ' ') || ' ', ' apache license ')"),
}
for _name, (_text, _cond) in TEXTS.items():
    query(_name, f"WITH {_base()} SELECT doc_id FROM tok WHERE {_cond}")(lambda spark, sf, t=_text: matches(_index(spark, sf), t).select("doc_id"))
    if _name in ("match_and", "match_or_not", "match_must", "match_phrase"):
        _terms = {"match_and": "the licensed", "match_or_not": "apache mit", "match_must": "licensed version", "match_phrase": "apache license"}[_name]
        query(_name.replace("match", "ranked"), _sql({0: _terms}, 10, among=_cond))(lambda spark, sf, t=_text: _out(search(_index(spark, sf), t, 10)))

_PREFIX = f"""WITH {_base()}, q AS (SELECT 0 AS query_id, term FROM t WHERE starts_with(term, 'licen') UNION ALL SELECT 0, 'apache'), {_scores('q')} {_top(10)}"""


@query("ranked_prefix", _PREFIX)
def ranked_prefix(spark, sf):
    return _out(search(_index(spark, sf), "licen* apache", 10))


@query("ranked_padding", _sql({0: "mozillamissing apache apache"}, 500))
def ranked_padding(spark, sf):
    return _out(search(_index(spark, sf), "mozillamissing apache apache", 500))


@query("query_tokens", _sql({0: "the the licensed"}, 7))
def query_tokens_query(spark, sf):
    return _out(search_tokens(_index(spark, sf), {0: ["the", "the", "licensed"]}, 7))


# --- filters and subsets ---------------------------------------------------

FILTERS = {
    "filter_eq": ({"lang": {"eq": "en"}}, "d.lang = 'en'"),
    "filter_in": ({"source": {"in": ["src0", "src3", "none"]}}, "d.source IN ('src0', 'src3')"),
    "filter_range": ({"n_chars": {"range": {"gte": 500, "lt": 3000}}, "lang": {"in": ["en", "de"]}}, "d.n_chars >= 500 AND d.n_chars < 3000 AND d.lang IN ('en', 'de')"),
    "filter_ilike": ({"source": {"ilike": "SRC1%"}}, "d.source ILIKE 'SRC1%'"),
    "filter_ilike_any": ({"source": {"ilike_any": ["SRC1%", "%7"]}}, "(d.source ILIKE 'SRC1%' OR d.source ILIKE '%7')"),
    "filter_overlap": ({"tags": {"overlap": ["src2", "fr"]}}, "(d.source = 'src2' OR d.lang = 'fr')"),
    "filter_empty": ({"lang": {"in": []}}, "FALSE"),
}


def _filtered(spark, sf, spec):
    docs = read(spark, sf, "documents").withColumn("tags", F.array("lang", "source"))
    index = _index(spark, sf, docs=docs)
    return _out(search(index, {1: Q1, 2: Q2}, 10, where=filters.condition(docs, spec)))


for _name, (_spec, _cond) in FILTERS.items():
    _among = f"tok.doc_id IN (SELECT doc_id FROM documents d WHERE {_cond})"
    query(_name, _sql({1: Q1, 2: Q2}, 10, among=_among))(lambda spark, sf, s=_spec: _filtered(spark, sf, s))


@query("subset_topk", _sql(BATCH, 5, among="tok.doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)"))
def subset_topk(spark, sf):
    allowed = read(spark, sf, "labels").where("quality = 1")
    return _out(search(_index(spark, sf), BATCH, 5, allowed=allowed))


_MASK = f"""WITH {_base()}, q(query_id, term) AS (VALUES {_values({1: Q1})}), {_scores('q', 'bm25+')},
m AS (SELECT s.query_id, s.doc_id, coalesce(h.score, 0) * (1 + s.doc_id % 3) + k.constant AS score FROM s JOIN k USING (query_id) LEFT JOIN h ON h.query_id = s.query_id AND h.doc_id = s.doc_id)
{_top(10, 'm')}"""


@query("weight_mask", _MASK)
def weight_mask(spark, sf):
    index = _index(spark, sf, "bm25+")
    mask = index.documents.select("doc_id", (1 + F.col("doc_id") % 3).cast("double").alias("weight"))
    return _out(search(index, {1: Q1}, 10, mask=mask))


# --- several columns -------------------------------------------------------

_PART = "regexp_extract_all(lower(p_name || ' ' || p_type || ' ' || p_brand), '" + LIT + "')"


def _parts(spark, sf, aware):
    return build(read(spark, sf, "part"), "p_partkey", ["p_name", "p_type", "p_brand"], Options(text=LOWER, field_aware=aware))


@query("columns_fused", f"WITH {_base('part', _PART, 'p_partkey')}, q(query_id, term) AS (VALUES (0, 'red'), (0, 'economy'), (0, 'ring')), {_scores('q')} {_top(20)}")
def columns_fused(spark, sf):
    return _out(search(_parts(spark, sf, False), "red economy ring", 20))


_FIELDS = f"""WITH f AS (SELECT p_partkey AS doc_id, 'p_name' AS field, regexp_extract_all(lower(p_name), '{LIT}') AS tokens FROM part
UNION ALL SELECT p_partkey, 'p_type', regexp_extract_all(lower(p_type), '{LIT}') FROM part UNION ALL SELECT p_partkey, 'p_brand', regexp_extract_all(lower(p_brand), '{LIT}') FROM part),
dl AS (SELECT doc_id, sum(len(tokens))::BIGINT AS dl FROM f GROUP BY doc_id),
p AS (SELECT doc_id, field, term, count(*)::BIGINT AS tf FROM (SELECT doc_id, field, unnest(tokens) AS term FROM f) GROUP BY ALL),
t AS (SELECT field, term, count(*)::BIGINT AS df FROM p GROUP BY ALL),
c AS (SELECT count(*)::DOUBLE AS n, sum(dl)::DOUBLE / count(*) AS avgdl FROM dl),
w(field, term, qw) AS (VALUES ('p_name', 'red', 3.0), ('p_name', 'small', 3.0), ('p_type', 'red', 0.5), ('p_type', 'small', 0.5)),
h AS (SELECT p.doc_id, sum(w.qw * {_idf('lucene')} * ({_tf('lucene')})) AS score FROM w JOIN p USING (field, term) JOIN t USING (field, term) JOIN dl USING (doc_id), c GROUP BY p.doc_id),
s AS (SELECT 0 AS query_id, dl.doc_id, coalesce(h.score, 0) AS score FROM dl LEFT JOIN h USING (doc_id)) {_top(20)}"""


@query("columns_field_aware", _FIELDS)
def columns_field_aware(spark, sf):
    return _out(search(_parts(spark, sf, True), "red small", 20, fields=["p_name", "p_type"], weights=[3.0, 0.5]))


# --- batches of queries ----------------------------------------------------

_BATCH = f"""WITH {_base()}, q AS (SELECT item_id AS query_id, unnest({TOKENS}) AS term FROM benchmark), {_scores('q')} {_top(10)}"""


@query("batch_topk", _BATCH)
def batch_topk(spark, sf):
    queries = read(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return _out(search_texts(_index(spark, sf), queries, 10, pad=True))


_METRICS = f"""WITH {_base()}, q AS (SELECT item_id AS query_id, unnest({TOKENS}) AS term FROM benchmark), {_scores('q')},
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM s WHERE score > 0),
j AS (SELECT query_id, doc_id, CASE WHEN dl > 150 THEN 2.0 ELSE 1.0 END AS relevance FROM (SELECT item_id AS query_id, {TOKENS}[1] AS word FROM benchmark)
      JOIN (SELECT tok.doc_id, tokens[1] AS word, dl FROM tok JOIN dl USING (doc_id)) USING (word)),
i AS (SELECT query_id, count(*) AS relevant, sum(CASE WHEN n <= 10 THEN (pow(2, relevance) - 1) / log2(n + 1) ELSE 0 END) AS idcg
      FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC) AS n FROM j) GROUP BY query_id),
m AS (SELECT r.query_id, r.rank, relevance, row_number() OVER (PARTITION BY r.query_id ORDER BY r.rank) AS n FROM r JOIN j USING (query_id, doc_id) WHERE r.rank <= 200),
g AS (SELECT query_id, sum(CASE WHEN rank <= 10 THEN (pow(2, relevance) - 1) / log2(rank + 1) ELSE 0 END) AS dcg, sum(CASE WHEN rank <= 100 THEN n::DOUBLE / rank ELSE 0 END) AS prec,
      count(*) FILTER (WHERE rank <= 100) AS hits, min(rank) FILTER (WHERE rank <= 20) AS first, count(*) AS cand FROM m GROUP BY query_id)
SELECT query_id, round(coalesce(dcg / idcg, 0), 6) AS ndcg_at_10, round(coalesce(prec / least(relevant, 100), 0), 6) AS map_at_100, round(coalesce(hits::DOUBLE / relevant, 0), 6) AS recall_at_100,
       round(coalesce(1.0::DOUBLE / first, 0), 6) AS mrr_at_20, round(coalesce(cand::DOUBLE / relevant, 0), 6) AS candidate_upper_bound FROM i LEFT JOIN g USING (query_id)"""


@query("metrics", _METRICS)
def metrics_query(spark, sf):
    bench = read(spark, sf, "benchmark")
    hits = search_texts(_index(spark, sf), bench.select(F.col("item_id").alias("query_id"), "text"), 200)
    # a document that begins with the query's first word counts as relevant, a long one more
    docs = _index(spark, sf).documents.select("doc_id", F.get("tokens", F.lit(0)).alias("word"), F.when(F.col("dl") > 150, 2.0).otherwise(1.0).alias("relevance"))
    judged = bench.select(F.col("item_id").alias("query_id"), F.get(tokenize(F.col("text"), LOWER), F.lit(0)).alias("word")).join(docs, "word").drop("word")
    out = metrics.evaluate(hits, once(judged, "judged"), 200)
    return out.select("query_id", *[F.round(c, 6).alias(c) for c in out.columns if c != "query_id"])


# --- overlap, highlight, snippet -------------------------------------------


@query("overlap_score", f"WITH {_base()} SELECT doc_id, (2 * ({_has('the')})::INT + ({_has('licensed')})::INT)::DOUBLE AS score, 0 - (2 * ({_has('the')})::INT + ({_has('licensed')})::INT)::DOUBLE AS distance FROM tok")
def overlap_score(spark, sf):
    wanted = query_tokens("The licensed the", lowercase=True)
    docs = _index(spark, sf).documents
    return docs.select("doc_id", overlap(F.col("tokens"), wanted).alias("score"), distance(F.col("tokens"), wanted).alias("distance"))


@query("highlight", f"WITH {_base()} SELECT doc_id, array_to_string([CASE WHEN x IN ('apache', 'license') OR starts_with(x, 'ver') THEN '<b>' || x || '</b>' ELSE x END for x in tokens], ' ') AS text FROM tok WHERE {_has('apache')}")
def highlight_query(spark, sf):
    found = matches(_index(spark, sf), "apache")
    return found.select("doc_id", highlight(F.col("tokens"), '"apache license" ver* -mit').alias("text"))


_SNIPPET = f"""WITH {_base()}, f AS (SELECT doc_id, tokens, list_position(tokens, 'apache') - 1 AS first, len(tokens) AS n FROM tok WHERE {_has('apache')}),
g AS (SELECT *, greatest(0, least(first - 4, n - 8)) AS b FROM f)
SELECT doc_id, (CASE WHEN b > 0 THEN '... ' ELSE '' END) || array_to_string([CASE WHEN x = 'apache' THEN '<b>' || x || '</b>' ELSE x END for x in tokens[b + 1 : b + 8]], ' ') || (CASE WHEN b + 8 < n THEN ' ...' ELSE '' END) AS snippet FROM g"""


@query("snippet", _SNIPPET)
def snippet_query(spark, sf):
    return matches(_index(spark, sf), "apache").select("doc_id", snippet(F.col("tokens"), "apache", 8).alias("snippet"))


# --- fusion ----------------------------------------------------------------

_FUSION = f"""WITH {_base()}, q(query_id, term) AS (VALUES {_values({1: Q1, 2: Q2})}), {_scores('q')},
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM s),
u AS (SELECT 0 AS query_id, doc_id, sum(score * CASE query_id WHEN 1 THEN 2.0 ELSE 0.5 END) AS score FROM r WHERE rank <= 30 GROUP BY doc_id)
SELECT doc_id, round(score, 6) AS score FROM u ORDER BY round(score, 9) DESC, doc_id::VARCHAR LIMIT 10"""


@query("fusion", _FUSION)
def fusion_query(spark, sf):
    index = _index(spark, sf)
    return _out(fusion.fuse_queries([(index, Q1, 2.0), (index, Q2, 0.5)], 10, 30), "doc_id", "score")


def _hybrid(spark, sf, method, normalizer):
    index = _index(spark, sf)
    words = fusion.candidates(search(index, Q1, 50), "bm25", weight=2.0, normalizer=normalizer)
    # the vectors' side: distance of each vector to the first axis
    vectors = read(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), (1.0 - F.round(F.col("embedding")[0].cast("double"), 6)).alias("score"))
    near = fusion.candidates(vectors.orderBy("score", "doc_id").limit(50), "vector", rank=None, weight=1.0, normalizer=normalizer, direction="lower")
    out = fusion.hybrid(words.unionByName(near), 20, method)
    return out.select("doc_id", F.round("score", 6).alias("score"), "source_count", F.array_join("source_names", ",").alias("sources"))


def _hybrid_sql(value: str) -> str:
    return f"""WITH {_base()}, q(query_id, term) AS (VALUES {_values({0: Q1})}), {_scores('q')},
b AS (SELECT doc_id, score AS raw, row_number() OVER (ORDER BY round(score, 9) DESC, doc_id) AS rank FROM s),
v AS (SELECT vec_id AS doc_id, 1.0::DOUBLE - round(embedding[1]::DOUBLE, 6) AS raw FROM embeddings),
v2 AS (SELECT * FROM v ORDER BY raw, doc_id LIMIT 50), v3 AS (SELECT doc_id, raw, row_number() OVER (ORDER BY raw, doc_id::VARCHAR) AS rank FROM v2),
a AS (SELECT 'bm25' AS source, doc_id, raw, rank, 2.0 AS weight, 1 AS sign FROM b WHERE rank <= 50 UNION ALL SELECT 'vector', doc_id, raw, rank, 1.0, -1 FROM v3),
z AS (SELECT *, min(raw) OVER (PARTITION BY source) AS lo, max(raw) OVER (PARTITION BY source) AS hi, avg(raw) OVER (PARTITION BY source) AS mean, stddev_pop(raw) OVER (PARTITION BY source) AS sd FROM a),
y AS (SELECT doc_id, sum(weight * ({value})) AS score, count(*)::INT AS source_count, string_agg(source, ',' ORDER BY source) AS sources FROM z GROUP BY doc_id)
SELECT doc_id, round(score, 6) AS score, source_count, sources FROM y ORDER BY score DESC, doc_id::VARCHAR LIMIT 20"""


HYBRID = {
    "hybrid_rrf": ("rrf", None, "1 / (60.0::DOUBLE + rank)"),
    "hybrid_minmax": ("score", "minmax", "(CASE WHEN sign > 0 THEN raw - lo ELSE hi - raw END) / (hi - lo)"),
    "hybrid_zscore": ("score", "zscore", "sign * (raw - mean) / sd"),
    "hybrid_identity": ("score", "identity", "sign * raw"),
    "hybrid_negative_distance": ("score", "negative_distance", "-raw"),
    "hybrid_inverse_distance": ("score", "inverse_distance", "1 / greatest(1e-6, raw + 1e-6)"),
    "hybrid_rank": ("score", "rank", "1.0::DOUBLE / rank"),
}
for _name, (_how, _norm, _value) in HYBRID.items():
    query(_name, _hybrid_sql(_value))(lambda spark, sf, h=_how, n=_norm: _hybrid(spark, sf, h, n))


# --- sparse vectors --------------------------------------------------------

ATOMS = "a AS (SELECT vec_id AS doc_id, i::INT AS atom, abs(embedding[i + 1]::DOUBLE) AS weight FROM embeddings, range(64) r(i))"


def _atoms(spark, sf):
    each = read(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), F.posexplode("embedding").alias("atom", "w"))
    return each.select("doc_id", "atom", F.abs(F.col("w").cast("double")).alias("weight"))


@query("atoms_by_mass", f"""WITH {ATOMS}, b AS (SELECT *, coalesce(sum(weight) OVER (PARTITION BY doc_id ORDER BY weight DESC, atom ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b, sum(weight) OVER (PARTITION BY doc_id) AS t FROM a)
SELECT doc_id, atom, round(weight, 6) AS weight FROM b WHERE b < 0.5 * t""")
def atoms_by_mass(spark, sf):
    return semantic.by_mass(_atoms(spark, sf), 0.5).withColumn("weight", F.round("weight", 6))


@query("atoms_heaviest", f"WITH {ATOMS} SELECT atom, round(sum(weight), 6) AS weight FROM a GROUP BY atom ORDER BY sum(weight) DESC, atom LIMIT 10")
def atoms_heaviest(spark, sf):
    return semantic.heavy_hitters(_atoms(spark, sf), 10).withColumn("weight", F.round("weight", 6))


@query("atoms_precision", f"WITH {ATOMS} SELECT doc_id, atom, round(CASE WHEN weight > 0 THEN least(255, greatest(1, round(weight / 2 * 255))) / 255.0::DOUBLE * 2 ELSE 0 END, 6) AS weight FROM a")
def atoms_precision(spark, sf):
    return _atoms(spark, sf).select("doc_id", "atom", F.round(semantic.as_precision(F.col("weight"), "u8"), 6).alias("weight"))


_UNIFIED = f"""WITH {_base()}, {ATOMS}, q(query_id, term) AS (VALUES {_values({1: Q1})}), {_scores('q')},
i AS (SELECT 1 AS query_id, doc_id, sum(weight * CASE atom WHEN 3 THEN 2.0 ELSE 0.5 END) AS score FROM a WHERE atom IN (3, 7) GROUP BY doc_id),
u AS (SELECT query_id, doc_id, sum(score) AS score FROM (SELECT query_id, doc_id, score FROM h UNION ALL SELECT * FROM i) GROUP BY ALL) {_top(15, 'u')}"""


@query("semantic_unified", _UNIFIED)
def semantic_unified(spark, sf):
    terms = spark.createDataFrame([(1, w, 1.0) for w in Q1.split()], "query_id long, term string, weight double")
    wanted = spark.createDataFrame([(1, 3, 2.0), (1, 7, 0.5)], "query_id long, atom int, weight double")
    return _out(semantic.unified(_index(spark, sf), _atoms(spark, sf), terms, wanted, 15))


@query("semantic_encoded")
def semantic_encoded(spark, sf):
    """Documents and a query through the stand-in encoder, pooled over windows."""
    index = _index(spark, sf)
    encoder = semantic.hashed_encoder()
    atoms = semantic.pooled(index.documents, "doc_id", "tokens", encoder)
    queries = spark.createDataFrame([(1, Q1)], "query_id long, text string")
    terms = spark.createDataFrame([(1, w, 1.0) for w in Q1.split()], "query_id long, term string, weight double")
    return _out(semantic.unified(index, atoms, terms, semantic.encode_queries(queries, encoder), 10))


# --- changes ---------------------------------------------------------------

_LOG = """l AS (SELECT event_id AS seq, CASE WHEN event_type = 'error' THEN 'retire' ELSE 'upsert' END AS op, user_id AS doc_id, 'event ' || event_type || ' ' || props AS text FROM events),
z AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY seq DESC) AS n FROM l) WHERE n = 1),
docs AS (SELECT doc_id, text FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM z) UNION ALL SELECT doc_id, text FROM z WHERE op = 'upsert')"""


def _log(spark, sf):
    e = read(spark, sf, "events")
    return e.select(F.col("event_id").alias("seq"), F.when(F.col("event_type") == "error", "retire").otherwise("upsert").alias("op"), F.col("user_id").alias("doc_id"), F.concat(F.lit("event "), "event_type", F.lit(" "), "props").alias("text"))


@query("delta_live", f"WITH {_LOG} SELECT doc_id, text FROM docs")
def delta_live(spark, sf):
    return delta.live(read(spark, sf, "documents").select("doc_id", "text"), _log(spark, sf))


@query("delta_search", f"WITH {_LOG}, {_base('docs')}, q(query_id, term) AS (VALUES (0, 'purchase'), (0, 'the')), {_scores('q')} {_top(12)}")
def delta_search(spark, sf):
    index = delta.indexed(read(spark, sf, "documents").select("doc_id", "text"), _log(spark, sf), "doc_id", "text", Options(text=LOWER))
    return _out(search(index, "purchase the", 12))


_LIVE = f"WITH {_LOG}, {_base('docs')}, q(query_id, term) AS (VALUES (0, 'purchase'), (0, 'the')), {_scores('q')} {_top(12)}"


def _base_index(spark, sf, consistency="realtime"):
    return build(read(spark, sf, "documents").select("doc_id", "text"), "doc_id", "text", Options(text=LOWER, consistency=consistency))


def _stored(spark, index):
    path = shared_folder(spark, "index")
    save(index, path)
    return load(spark, path)


@query("delta_overlaid", _LIVE)
def delta_overlaid(spark, sf):
    """A stored base's postings with the log laid over them."""
    return _out(search(delta.overlaid(_stored(spark, _base_index(spark, sf)), _log(spark, sf)), "purchase the", 12))


@query("delta_merged", _LIVE)
def delta_merged(spark, sf):
    """A stored base into which the log is merged."""
    base = _stored(spark, _base_index(spark, sf, "eventual"))
    return _out(search(delta.merged(base, _log(spark, sf), shared_folder(spark, "merged")), "purchase the", 12))


@query("delta_manual", f"WITH {_base()}, q(query_id, term) AS (VALUES (0, 'purchase'), (0, 'the')), {_scores('q')} {_top(12)}")
def delta_manual(spark, sf):
    return _out(search(delta.overlaid(_base_index(spark, sf, "manual"), _log(spark, sf)), "purchase the", 12))


@query("delta_status", "SELECT 'realtime' AS consistency, true AS query_ready, false AS stale, 0::BIGINT AS pending_records UNION ALL SELECT c, true, true, (SELECT count(*) FROM events) FROM (VALUES ('eventual'), ('manual')) v(c)")
def delta_status(spark, sf):
    rows = [status(delta.overlaid(_base_index(spark, sf, c), _log(spark, sf))) for c in ("realtime", "eventual", "manual")]
    return spark.createDataFrame([(r["consistency"], r["query_ready"], r["stale"], r["pending_records"]) for r in rows], "consistency string, query_ready boolean, stale boolean, pending_records long")


# --- stored indexes, ids, prepared queries, source rows -----------------------


@query("stored_search", _sql(BATCH, 10))
def stored_search(spark, sf):
    return _out(search(_stored(spark, _index(spark, sf)), BATCH, 10))


@query("stored_batch", _BATCH)
def stored_batch(spark, sf):
    queries = read(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return _out(search_texts(_stored(spark, _index(spark, sf)), queries, 10, pad=True))


for _m in METHODS:
    query(f"stored_{_m.replace('+', 'plus')}", _sql(BATCH, 10, _m))(lambda spark, sf, m=_m: _out(search(_stored(spark, _index(spark, sf, m)), BATCH, 10)))

_IDS = "(SELECT l_orderkey, list((l_partkey % 100)::VARCHAR) AS t FROM lineitem GROUP BY l_orderkey)"


@query("ids_topk", f"WITH {_base(_IDS, 't', 'l_orderkey')}, q(query_id, term) AS (VALUES (0, '5'), (0, '7'), (0, '7'), (0, '1000')), {_scores('q')} {_top(20)}")
def ids_topk(spark, sf):
    docs = read(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_list((F.col("l_partkey") % 100).cast("int")).alias("ids"))
    return _out(search_tokens(build(docs, "l_orderkey", "ids"), {0: [5, 7, 7, 1000]}, 20))


@query("index_details", f"WITH {_base()} SELECT (SELECT count(*) FROM dl) AS n_docs, (SELECT count(*) FROM dl WHERE dl = 0) AS n_empty, (SELECT sum(dl)::BIGINT FROM dl) AS total_len, (SELECT count(*) FROM p) AS n_postings, (SELECT count(*) FROM t) AS n_terms, 'text' AS source_type, 'realtime' AS consistency, false AS stale, 0::BIGINT AS pending_records")
def index_details(spark, sf):
    return details(_index(spark, sf))


@query("index_options", "SELECT * FROM (VALUES ('b', '0.75'), ('consistency', 'realtime'), ('idf_method', 'lucene'), ('k1', '1.5'), ('lowercase', 'True'), ('method', 'lucene')) v(name, value)")
def index_options(spark, sf):
    found = describe(_index(spark, sf))
    names = ("b", "consistency", "idf_method", "k1", "lowercase", "method")
    return spark.createDataFrame([(n, str(found[n])) for n in names], "name string, value string")


@query("native_search", _sql({0: Q1}, 10, among="tok.doc_id IN (SELECT doc_id FROM documents WHERE lang = 'en' AND n_chars > 300)").replace("SELECT query_id::BIGINT AS query_id, doc_id, round(score, 6) AS score, rank FROM", "SELECT r.doc_id, round(score, 6) AS score, rank, d.lang, d.source, d.n_chars FROM", 1).replace(" WHERE rank <= 10", " r JOIN documents d USING (doc_id) WHERE rank <= 10"))
def native_search(spark, sf):
    """Hits with the columns of their rows."""
    found = search_native(_index(spark, sf), Q1, 10, "lang = 'en' AND n_chars > 300")
    return _out(found, "doc_id", "score", "rank", "lang", "source", "n_chars")


@query("positive_topk", f"SELECT * FROM ({_sql({0: 'licensed version'}, 500)}) WHERE score > 0")
def positive_topk(spark, sf):
    return _out(search_prepared(prepared(_index(spark, sf), "Licensed version", lowercase=True), 500, positive_only=True))


@query("distance_of_text", f"WITH {_base()} SELECT doc_id, (2 * ({_has('the')})::INT + ({_has('licensed')})::INT)::DOUBLE AS distance FROM tok")
def distance_of_text_query(spark, sf):
    wanted = order_tokens(prepared(_index(spark, sf), "The licensed the", lowercase=True))
    return read(spark, sf, "documents").select("doc_id", F.coalesce(distance_of_text(F.col("text"), wanted), F.lit(0.0)).alias("distance"))


# --- more of sparse vectors and of hybrid hits --------------------------------


@query("hybrid_arrays", _hybrid_sql("1 / (60.0::DOUBLE + rank)").replace("string_agg(source, ',' ORDER BY source) AS sources", "string_agg(source, ',' ORDER BY source) AS sources, string_agg(round(raw * 1e6)::BIGINT::VARCHAR, ',' ORDER BY source) AS raw_values, string_agg(rank::VARCHAR, ',' ORDER BY source) AS ranks, string_agg(round(1e9 / (60.0::DOUBLE + rank))::BIGINT::VARCHAR, ',' ORDER BY source) AS normalized, string_agg(round(1e9 * weight / (60.0::DOUBLE + rank))::BIGINT::VARCHAR, ',' ORDER BY source) AS weighted").replace("SELECT doc_id, round(score, 6) AS score, source_count, sources FROM y", "SELECT doc_id, source_count, sources, raw_values, ranks, normalized, weighted FROM y"))
def hybrid_arrays(spark, sf):
    """The arrays of raw, normalized and weighted values and of ranks by source."""
    index = _index(spark, sf)
    words = fusion.candidates(search(index, Q1, 50), "bm25", weight=2.0)
    vectors = read(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), (1.0 - F.round(F.col("embedding")[0].cast("double"), 6)).alias("score"))
    near = fusion.candidates(vectors.orderBy("score", "doc_id").limit(50), "vector", rank=None, direction="lower")
    out = fusion.hybrid(words.unionByName(near), 20, "rrf")
    whole = lambda c, by: F.array_join(F.transform(c, lambda x: F.round(x * by).cast("long").cast("string")), ",")
    return out.select("doc_id", "source_count", F.array_join("source_names", ",").alias("sources"), whole("raw_values", 1e6).alias("raw_values"), whole("ranks", 1).alias("ranks"), whole("normalized_scores", 1e9).alias("normalized"), whole("weighted_scores", 1e9).alias("weighted"))


@query("fusion_fields", _FUSION)
def fusion_fields(spark, sf):
    index = _index(spark, sf)
    (a, b) = fusion.weighted([(index, Q1), (index, Q2)], [2.0, 0.5])
    return _out(fusion.fuse_fields({"title": a, "body": b}, 10, 30), "doc_id", "score")


@query("atoms_by_budget", f"WITH {_base()}, {ATOMS}, n AS (SELECT doc_id, count(*) AS n FROM p GROUP BY doc_id), r AS (SELECT a.*, n, row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC, atom) AS r FROM a JOIN n USING (doc_id)) SELECT doc_id, atom, round(weight, 6) AS weight FROM r WHERE r <= greatest(1, floor(n * 0.1))")
def atoms_by_budget(spark, sf):
    terms = _index(spark, sf).postings.groupBy("doc_id").agg(F.count("*").alias("n"))
    return semantic.by_budget(_atoms(spark, sf), terms, 0.1).withColumn("weight", F.round("weight", 6))


_STEP = "pow(2, greatest(floor(log2(greatest(weight, pow(2, -14)))), -14) - 10)"


@query("atoms_fp16", f"WITH {ATOMS} SELECT doc_id, atom, round(round_even(weight / {_STEP}, 0) * {_STEP}, 9) AS weight FROM a")
def atoms_fp16(spark, sf):
    return _atoms(spark, sf).select("doc_id", "atom", F.round(semantic.as_precision(F.col("weight"), "fp16"), 9).alias("weight"))


@query("atoms_completed", f"WITH {ATOMS}, d AS (SELECT doc_id, n_chars % 3 AS version FROM documents) SELECT a.doc_id, atom, round(weight, 6) AS weight FROM a JOIN d ON a.doc_id = d.doc_id AND d.version = a.atom % 3")
def atoms_completed(spark, sf):
    """Atoms of the versions that documents have now."""
    atoms = _atoms(spark, sf).withColumn("version", (F.col("atom") % 3).cast("long"))
    docs = read(spark, sf, "documents").select("doc_id", (F.col("n_chars") % 3).cast("long").alias("version"))
    return delta.completed(docs, atoms).select("doc_id", "atom", F.round("weight", 6).alias("weight"))


@query("atoms_calibrated", f"""WITH {ATOMS}, m AS (SELECT atom::VARCHAR AS name, sqrt(avg(weight * weight)) AS rms FROM a GROUP BY atom UNION ALL SELECT 'the', 0.9 UNION ALL SELECT 'thand', 0.2),
l(term, weight) AS (VALUES ('the', 2.0), ('thand', 1.0)), s(atom, weight) AS (VALUES (3, 1.5), (7, 0.25)),
x AS (SELECT sqrt(sum(pow(weight * rms, 2))) AS n FROM l JOIN m ON m.name = l.term), y AS (SELECT sqrt(sum(pow(weight * rms, 2))) AS n FROM s JOIN m ON m.name = s.atom::VARCHAR)
SELECT 1::BIGINT AS query_id, atom, round(s.weight * greatest(0.1, least(10.0, x.n / y.n)), 6) AS weight FROM s, x, y""")
def atoms_calibrated(spark, sf):
    rms = _atoms(spark, sf).groupBy(F.col("atom").cast("string").alias("name")).agg(F.sqrt(F.avg(F.col("weight") * F.col("weight"))).alias("rms"))
    rms = rms.unionByName(spark.createDataFrame([("the", 0.9), ("thand", 0.2)], "name string, rms double"))
    terms = spark.createDataFrame([(1, "the", 2.0), (1, "thand", 1.0)], "query_id long, term string, weight double")
    wanted = spark.createDataFrame([(1, 3, 1.5), (1, 7, 0.25)], "query_id long, atom int, weight double")
    return semantic.calibrated(terms, wanted, rms).withColumn("weight", F.round("weight", 6))


def _length_encoder(text):
    """Atoms are lengths of words, weights log(1 + how many words have it)."""
    sizes = F.transform(F.split(text, " "), lambda w: F.char_length(w))
    count = lambda n: F.size(F.filter(sizes, lambda s: s == n))
    return F.transform(F.array_distinct(sizes), lambda n: F.struct(n.alias("atom"), F.log(1.0 + count(n)).alias("weight")))


_POOLED = f"""WITH {_base()}, w AS (SELECT doc_id, (i - 1) // 256 AS win, len(x) AS atom, count(*) AS n FROM (SELECT doc_id, unnest(tokens) AS x, generate_subscripts(tokens, 1) AS i FROM tok) GROUP BY ALL),
m AS (SELECT doc_id, atom, max(ln(1.0 + n)) AS weight FROM w GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC, atom) AS r FROM m)
SELECT doc_id, atom::INT AS atom, round(weight, 6) AS weight FROM r WHERE r <= 6"""


@query("semantic_pooled", _POOLED)
def semantic_pooled(spark, sf):
    """The pooling of windows, with an encoder that SQL can express."""
    docs = _index(spark, sf).documents.where("dl > 0")
    return semantic.pooled(docs, "doc_id", "tokens", _length_encoder, 6).withColumn("weight", F.round("weight", 6))
