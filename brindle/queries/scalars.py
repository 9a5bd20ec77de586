"""Scalar and table functions, JSON, vectors, geometry and retrieval over the driver's tables."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import datetimes as D
from ..functions import geometry as G
from ..functions import jsons as J
from ..functions import maths as M
from ..functions import strings as S
from ..functions import vectors as V
from ..operators import relational as R
from ..retrieval import lexical as L
from ..retrieval import ranking as K
from ..retrieval import tokenize
from ..retrieval.stored import StoredIndex, exists
from .registry import query
from .registry import table as t

C = F.col
UP, LOW = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ'", "'abcdefghijklmnopqrstuvwxyz'"


@query(f"SELECT p_partkey, translate(p_name, {LOW}, {UP}) AS u, translate(p_brand, {UP}, {LOW}) AS l, length(p_name) AS n, octet_length(encode(p_type)) AS o, instr(p_name, 'e') AS i FROM part")
def string_basics(spark: SparkSession, sf: str) -> DataFrame:
    n = C("p_name")
    return t(spark, sf, "part").select("p_partkey", S.upper(n).alias("u"), S.lower(C("p_brand")).alias("l"), S.length(n).alias("n"), F.octet_length("p_type").cast("long").alias("o"), S.instr(n, F.lit("e")).alias("i"))


@query("SELECT p_partkey, substr(p_name, 2, 4) AS a, substr(p_name, 0, 3) AS b, substr(p_name, -5, 3) AS c, substr(p_name, 4) AS d FROM part")
def substr_forms(spark: SparkSession, sf: str) -> DataFrame:
    n = C("p_name")
    return t(spark, sf, "part").select("p_partkey", S.substr(n, 2, 4).alias("a"), S.substr(n, 0, 3).alias("b"), S.substr(n, -5, 3).alias("c"), S.substr(n, 4).alias("d"))


@query("SELECT p_partkey FROM part WHERE lower(p_name) LIKE lower('%A%e_') OR p_type GLOB 'S*[EI]*' OR regexp_matches(p_brand, '#[12]3$')")
def like_glob_regexp(spark: SparkSession, sf: str) -> DataFrame:
    return t(spark, sf, "part").filter(S.like(C("p_name"), "%A%e_") | S.glob(C("p_type"), "S*[EI]*") | C("p_brand").rlike("#[12]3$")).select("p_partkey")


@query("SELECT p_partkey, concat(p_name, NULL, p_size) AS c, concat_ws('-', p_brand, NULL, p_type) AS w, replace(p_type, 'E', 'ee') AS r, trim(p_name, 'a ') AS t, coalesce(hex(encode(p_brand)), '') AS h FROM part")
def string_building(spark: SparkSession, sf: str) -> DataFrame:
    none = F.lit(None).cast("string")
    return t(spark, sf, "part").select(
        "p_partkey", S.concat(C("p_name"), none, C("p_size")).alias("c"), F.concat_ws("-", "p_brand", none, "p_type").alias("w"), S.replace(C("p_type"), F.lit("E"), F.lit("ee")).alias("r"), S.trim(C("p_name"), "a ").alias("t"), S.hex_(C("p_brand")).alias("h")
    )


@query("""SELECT p_partkey, CASE WHEN x IS NULL THEN NULL ELSE greatest(x, 20) END AS hi, CASE WHEN x IS NULL THEN NULL ELSE least(x, 20) END AS lo, nullif(p_size, 7) AS nf,
CASE WHEN p_size > 40 THEN 'big' WHEN p_size > 20 THEN 'mid' ELSE 'low' END AS i, unicode(p_name) AS u, sign(p_size - 25) AS s FROM (SELECT *, CASE WHEN p_size % 4 <> 0 THEN p_size END AS x FROM part)""")
def general_scalars(spark: SparkSession, sf: str) -> DataFrame:
    x = F.when(C("p_size") % 4 != 0, C("p_size"))
    return t(spark, sf, "part").select(
        "p_partkey", S.scalar_max(x, F.lit(20)).alias("hi"), S.scalar_min(x, F.lit(20)).alias("lo"), F.nullif(C("p_size"), F.lit(7)).alias("nf"),
        S.iif(C("p_size") > 40, F.lit("big"), C("p_size") > 20, F.lit("mid"), F.lit("low")).alias("i"), S.unicode_(C("p_name")).cast("int").alias("u"), S.sign(C("p_size") - 25).cast("tinyint").alias("s"),
    )


@query("SELECT p_partkey, printf('%05d|%s|%.2f', p_size, p_brand, p_retailprice) AS p, '''' || replace(p_name, '''', '''''') || '''' AS q FROM part")
def formatting(spark: SparkSession, sf: str) -> DataFrame:
    return t(spark, sf, "part").select("p_partkey", S.printf("%05d|%s|%.2f", C("p_size"), C("p_brand"), C("p_retailprice")).alias("p"), S.quote(C("p_name"), "text").alias("q"))


@query("""SELECT l_orderkey, l_linenumber, round(sqrt(l_quantity), 9) AS sq, round(ln(l_quantity), 9) AS ln, round(log10(l_quantity), 9) AS lg, round(exp(l_discount), 9) AS ex, round(power(l_quantity, 1.5), 6) AS pw,
CASE WHEN l_quantity / 50 BETWEEN -1 AND 1 THEN round(acos(l_quantity / 50), 9) END AS ac, round(atan2(l_quantity, l_tax + 1), 9) AS at, ceil(l_extendedprice / 7) AS c, floor(-l_extendedprice / 7) AS f, trunc(-l_extendedprice / 7) AS tr, round(sinh(l_discount), 9) AS sh, round(degrees(l_tax), 9) AS dg FROM lineitem""")
def math_functions(spark: SparkSession, sf: str) -> DataFrame:
    q, d, x = C("l_quantity"), C("l_discount"), C("l_extendedprice") / 7
    r = lambda c, n=9: F.round(c, n)
    return t(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", r(M.sqrt(q)).alias("sq"), r(M.ln(q)).alias("ln"), r(M.log10(q)).alias("lg"), r(M.exp(d)).alias("ex"), r(M.power(q, F.lit(1.5)), 6).alias("pw"), r(M.acos(q / 50)).alias("ac"),
        r(M.atan2(q, C("l_tax") + 1)).alias("at"), M.ceil(x).alias("c"), M.floor(-x).alias("f"), M.trunc(-x).alias("tr"), r(M.sinh(d)).alias("sh"), r(M.degrees(C("l_tax"))).alias("dg"),
    )


@query("""SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS d, strftime(o_orderdate + INTERVAL 36 HOUR, '%Y-%m-%d %H:%M:%S') AS h, strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS m,
CAST(epoch(o_orderdate) AS BIGINT) AS e, round(epoch(o_orderdate) / 86400.0 + 2440587.5, 6) AS j, strftime(o_orderdate, '%j/%w/%u/%W/%U/%H:%M') AS f FROM orders""")
def date_functions(spark: SparkSession, sf: str) -> DataFrame:
    ts = D.instant(C("o_orderdate"), "timestamp")
    return t(spark, sf, "orders").select(
        "o_orderkey", D.date(ts).alias("d"), D.datetime(ts, "+36 hours").alias("h"), D.date(ts, "start of month").alias("m"), D.unixepoch(ts).cast("long").alias("e"), F.round(D.julianday(ts), 6).alias("j"), D.strftime("%j/%w/%u/%W/%U/%H:%M", ts).alias("f")
    )


@query("""SELECT o_orderkey, strftime(CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) + INTERVAL 1 MONTH + to_days(CAST(day(o_orderdate) - 1 AS INTEGER)), '%Y-%m-%d') AS carried, strftime(o_orderdate + INTERVAL 1 MONTH, '%Y-%m-%d') AS clamped FROM orders""")
def month_overflow(spark: SparkSession, sf: str) -> DataFrame:
    ts = D.instant(C("o_orderdate"), "timestamp")
    return t(spark, sf, "orders").select("o_orderkey", D.date(ts, "+1 month").alias("carried"), D.date(ts, "+1 month", "floor").alias("clamped"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, CAST(CASE WHEN json_valid(props) THEN 1 ELSE 0 END AS INTEGER) AS v, lower(json_type(props)) AS ty, CAST(coalesce(json_array_length(props), 0) AS BIGINT) AS n FROM events")
def json_reading(spark: SparkSession, sf: str) -> DataFrame:
    p = C("props")
    return t(spark, sf, "events").select("event_id", J.extract_text(p, "$.k").alias("k"), J.valid(p).alias("v"), J.json_type(p).alias("ty"), J.array_length(p).cast("long").alias("n"))


@query("""SELECT event_id, '{"k":' || json_extract_string(props, '$.k') || ',"n":[1,2]}' AS s, '{"z":true}' AS m, '[' || json_extract_string(props, '$.k') || ',null,"' || event_type || '"]' AS a FROM events""")
def json_writing(spark: SparkSession, sf: str) -> DataFrame:
    p = C("props")
    patched = J.patch(p, '{"k":null,"z":true}')
    return t(spark, sf, "events").select("event_id", J.set_(p, "$.n", [1, 2]).alias("s"), patched.alias("m"), J.array(J.extract(p, "$.k", "long"), F.lit(None).cast("string"), C("event_type")).alias("a"))


@query("SELECT i AS value FROM range(3, 40, 4) r(i)")
def generate_series(spark: SparkSession, sf: str) -> DataFrame:
    return R.generate_series(spark, 3, 39, -4)


QUERY = "[" + ", ".join(f"{((i * 37) % 19 - 9) / 10}::DOUBLE" for i in range(64)) + "]"
VECTOR = [((i * 37) % 19 - 9) / 10 for i in range(64)]


@query(f"""SELECT vec_id, round(sqrt(list_sum([(a - b) * (a - b) FOR a, b IN []])), 6) AS l2 FROM embeddings""".replace("list_sum([(a - b) * (a - b) FOR a, b IN []])", f"list_sum(list_transform(list_zip(embedding, {QUERY}), lambda x: (x[1]::DOUBLE - x[2]) * (x[1]::DOUBLE - x[2])))")
       .replace(" AS l2", f" AS l2, round(list_inner_product(embedding::DOUBLE[], {QUERY}), 6) AS dot, round(1 - list_cosine_similarity(embedding::DOUBLE[], {QUERY}), 6) AS cos, round(list_sum(list_transform(list_zip(embedding, {QUERY}), lambda x: abs(x[1]::DOUBLE - x[2]))), 6) AS l1"))
def vector_distances(spark: SparkSession, sf: str) -> DataFrame:
    v, q = C("embedding"), V.literal(VECTOR)
    return t(spark, sf, "embeddings").select("vec_id", F.round(V.l2_distance(v, q), 6).alias("l2"), F.round(V.dot(v, q), 6).alias("dot"), F.round(V.cosine_distance(v, q), 6).alias("cos"), F.round(V.l1_distance(v, q), 6).alias("l1"))


@query(f"SELECT vec_id AS id FROM embeddings ORDER BY list_cosine_similarity(embedding::DOUBLE[], {QUERY}) DESC, vec_id LIMIT 10")
def vector_top_k(spark: SparkSession, sf: str) -> DataFrame:
    return K.exact_search(t(spark, sf, "embeddings"), "vec_id", "embedding", VECTOR, 10).select("id")


@query(f"SELECT vec_id AS id FROM embeddings WHERE label IN (1, 3) ORDER BY list_cosine_similarity(embedding::DOUBLE[], {QUERY}) DESC, vec_id LIMIT 10")
def vector_top_k_filtered(spark: SparkSession, sf: str) -> DataFrame:
    return K.exact_search(t(spark, sf, "embeddings"), "vec_id", "embedding", VECTOR, 10, where=C("label").isin(1, 3)).select("id")


@query("""SELECT q.vec_id AS query_id, r.vec_id AS id FROM embeddings q, LATERAL (SELECT vec_id FROM embeddings e ORDER BY list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) DESC, vec_id LIMIT 3) r WHERE q.vec_id % 50 = 0""")
def vector_batch_search(spark: SparkSession, sf: str) -> DataFrame:
    e = t(spark, sf, "embeddings")
    return K.batch_search(e, "vec_id", "embedding", e.filter("vec_id % 50 = 0").select(C("vec_id").alias("query_id"), C("embedding").alias("query")), 3).select("query_id", "id")


def _lists(spark: SparkSession, sf: str) -> K.InvertedFile:
    """The stored lists of the embeddings, built by the first query that needs them."""
    path = stored(spark, sf, "embeddings")
    if exists(spark, f"{path}/model"):
        return K.InvertedFile.open(spark, path)
    return K.InvertedFile(t(spark, sf, "embeddings"), "vec_id", "embedding", lists=16, path=path)


@query()
def inverted_file_search(spark: SparkSession, sf: str) -> DataFrame:
    """Approximate: the nearest 12 of 16 stored lists for one vector, the setting whose recall the tests measure."""
    return _lists(spark, sf).search(VECTOR, 10, probes=12)


@query()
def inverted_file_batch_search(spark: SparkSession, sf: str) -> DataFrame:
    """Approximate: the nearest 12 of 16 lists for every id divisible by 50.  The tests measure the recall of this query."""
    e = t(spark, sf, "embeddings")
    queries = e.filter("vec_id % 50 = 0").select(C("vec_id").alias("query_id"), C("embedding").alias("query"))
    return _lists(spark, sf).batch_search(queries, 10, probes=12).select("query_id", "id")


@query("SELECT vec_id, array_to_string([CASE WHEN x > 0 THEN '1' ELSE '0' END FOR x IN embedding], '') AS bits, round(sqrt(list_sum([CAST(x AS DOUBLE) * x FOR x IN embedding])), 6) AS n, len(embedding) AS d FROM embeddings")
def vector_forms(spark: SparkSession, sf: str) -> DataFrame:
    v = C("embedding")
    return t(spark, sf, "embeddings").select("vec_id", V.binary_quantize(v).alias("bits"), F.round(V.norm(v), 6).alias("n"), V.dims(v).alias("d"))


@query("SELECT p_partkey, CAST(p_size * (p_size + 1) AS DOUBLE) AS area, 0.0::DOUBLE AS x0, CAST(p_size AS DOUBLE) AS x1 FROM part")
def polygon_area(spark: SparkSession, sf: str) -> DataFrame:
    s = C("p_size").cast("string")
    box = F.concat(F.lit("[[0,0],["), s, F.lit(",0],["), s, F.lit(","), (C("p_size") + 1).cast("string"), F.lit("],[0,"), (C("p_size") + 1).cast("string"), F.lit("],[0,0]]"))
    return t(spark, sf, "part").select("p_partkey", G.area(box).alias("area"), G.bbox(box)["x0"].alias("x0"), G.bbox(box)["x1"].alias("x1"))


# Retrieval ------------------------------------------------------------------------

TOKENS = "regexp_extract_all(lower(text), '[a-z0-9]+')"
POST = f"""p AS (SELECT doc_id AS id, unnest({TOKENS}) AS term FROM documents), tf AS (SELECT id, term, count(*) AS tf FROM p GROUP BY 1, 2),
len AS (SELECT doc_id AS id, len({TOKENS}) AS length FROM documents), c AS (SELECT count(*) AS n, avg(length) AS mean FROM len), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1)"""
TERMS = ["the", "and", "erst", "que"]
IN = "('" + "', '".join(TERMS) + "')"


def stored(spark: SparkSession, sf: str, name: str) -> str:
    """Where the index of a table's present files is kept, in the shared folder: other files have another place."""
    source = spark._jvm.org.apache.hadoop.fs.Path(f"{sf}/{name}.parquet")
    fs = source.getFileSystem(spark._jsc.hadoopConfiguration())
    state = fs.getFileStatus(source)
    files = [state] if state.isFile() else list(fs.listStatus(source))
    marks = sorted(f"{f.getPath()}:{f.getLen()}:{f.getModificationTime()}" for f in files)
    return f"{R.shared_root(spark)}/index-{name}-{hashlib.sha256(chr(10).join(marks).encode()).hexdigest()[:32]}"


def corpus(spark: SparkSession, sf: str, tokens: Column | None = None, kind: str = "plain") -> L.Corpus:
    """The stored index of the documents under one tokenizer, built by the first query that needs it."""
    index = StoredIndex(spark, f"{stored(spark, sf, 'documents')}-{kind}")
    if not index.generations:
        index.append(t(spark, sf, "documents"), "doc_id", tokenize.plain(C("text")) if tokens is None else tokens)
    return index.corpus()


BM25 = f"WITH {POST} SELECT id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))), 6) AS score FROM tf JOIN df USING (term) JOIN len USING (id), c WHERE term IN {IN} GROUP BY id"


@query(BM25)
def search_index_build(spark: SparkSession, sf: str) -> DataFrame:
    """A new index each time, then a search."""
    index = StoredIndex(spark, f"{R.shared_root(spark)}/build-{uuid.uuid4().hex}")
    index.append(t(spark, sf, "documents"), "doc_id", tokenize.plain(C("text")))
    return L.bm25(index.corpus(), TERMS).select("id", F.round("score", 6).alias("score"))


@query(BM25)
def search_index_generations(spark: SparkSession, sf: str) -> DataFrame:
    """A new index each time: the documents in three appends, some twice and some removed in between, then a search."""
    docs, tokens = t(spark, sf, "documents"), tokenize.plain(C("text"))
    index = StoredIndex(spark, f"{R.shared_root(spark)}/build-{uuid.uuid4().hex}")
    index.append(docs.filter("doc_id % 3 <> 0").withColumn("text", F.concat("text", F.lit(" the que"))), "doc_id", tokens)
    index.append(docs.filter("doc_id % 3 <> 2"), "doc_id", tokens).remove(docs.filter("doc_id % 3 = 2").select(C("doc_id").alias("id")))
    index.append(docs.filter("doc_id % 3 = 2"), "doc_id", tokens)
    return L.bm25(index.corpus(), TERMS).select("id", F.round("score", 6).alias("score"))


@query(f"""WITH {POST} SELECT id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))), 6) AS score FROM tf JOIN df USING (term) JOIN len USING (id), c WHERE term IN {IN} GROUP BY id""")
def bm25_scores(spark: SparkSession, sf: str) -> DataFrame:
    return L.bm25(corpus(spark, sf), TERMS).select("id", F.round("score", 6).alias("score"))


@query(f"""WITH {POST}, w AS (SELECT term, ln(1 + (n - df + 0.5) / (df + 0.5)) AS idf FROM df, c WHERE term IN {IN}), s AS (SELECT id, sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))) AS score, sum(idf) AS found FROM tf JOIN w USING (term) JOIN len USING (id), c GROUP BY id)
SELECT id, round(score * power(found / (SELECT sum(idf) FROM w), 3), 6) AS score FROM s""")
def bm25_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return L.bm25(corpus(spark, sf), TERMS, coverage=L.COVERAGE).select("id", F.round("score", 6).alias("score"))


@query(f"""WITH {POST} SELECT id, round(-sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))), 8) AS rank FROM tf JOIN df USING (term) JOIN len USING (id), c WHERE term IN ('the', 'erst') GROUP BY id HAVING count(*) = 2""")
def fts_rank(spark: SparkSession, sf: str) -> DataFrame:
    return L.fts_bm25(corpus(spark, sf), ["the", "erst"]).select("id", F.round("rank", 8).alias("rank"))


@query(f"WITH {POST} SELECT term, count(*) AS doc, CAST(sum(tf) AS BIGINT) AS cnt FROM tf GROUP BY term")
def term_vocabulary(spark: SparkSession, sf: str) -> DataFrame:
    return L.vocabulary(corpus(spark, sf).post)


@query(f"WITH d AS (SELECT doc_id AS id, ' ' || array_to_string({TOKENS}, ' ') || ' ' AS x FROM documents) SELECT id FROM d WHERE (contains(x, ' of the ') OR regexp_matches(x, ' ers[a-z0-9]* ')) AND NOT contains(x, ' and ')")
def match_expression(spark: SparkSession, sf: str) -> DataFrame:
    return L.match(corpus(spark, sf).post, '("of the" OR ers*) NOT and')


HITS = f"""l AS (SELECT id, score FROM (SELECT id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))), 9) AS score FROM tf JOIN df USING (term) JOIN len USING (id), c WHERE term IN {IN} GROUP BY id) ORDER BY score DESC, id LIMIT 50),
v AS (SELECT vec_id AS id, round(list_cosine_similarity(embedding::DOUBLE[], {QUERY}), 9) AS score FROM embeddings ORDER BY score DESC, id LIMIT 50)"""


def _branches(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """The two candidate lists of 50; embeddings stand for documents of the same number."""
    lexical = L.bm25(corpus(spark, sf), TERMS).withColumn("score", F.round("score", 9)).orderBy(F.desc("score"), "id").limit(50)
    vector = K.exact_search(t(spark, sf, "embeddings"), "vec_id", "embedding", VECTOR, 50).select("id", F.round(1 - C("distance"), 9).alias("score"))
    return lexical, vector


@query(f"""WITH {POST}, {HITS}, lr AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS r FROM l), vr AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS r FROM v)
SELECT coalesce(lr.id, vr.id) AS id, round(coalesce(1.0 / (60 + lr.r), 0) + coalesce(1.0 / (60 + vr.r), 0), 8) AS score, CASE WHEN lr.id IS NULL THEN 'vector' WHEN vr.id IS NULL THEN 'lexical' ELSE 'both' END AS origin FROM lr FULL JOIN vr ON lr.id = vr.id""")
def fusion_rrf(spark: SparkSession, sf: str) -> DataFrame:
    return K.rrf(*_branches(spark, sf)).select("id", F.round("score", 8).alias("score"), "origin")


@query(f"""WITH {POST}, {HITS}, ls AS (SELECT id, (score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER ()) AS s FROM l), vs AS (SELECT id, (score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER ()) AS s FROM v)
SELECT coalesce(ls.id, vs.id) AS id, round(0.35 * coalesce(vs.s, 0) + 0.65 * coalesce(ls.s, 0), 6) AS score FROM ls FULL JOIN vs ON ls.id = vs.id""")
def hybrid_search(spark: SparkSession, sf: str) -> DataFrame:
    """The flagship: keyword and vector candidates fused by min-max scaling."""
    return K.min_max(*_branches(spark, sf)).select("id", F.round("score", 6).alias("score"))


@query(f"""WITH {POST}, {HITS}, m AS (SELECT sum(ln(1 + (n - df + 0.5) / (df + 0.5))) * 2.2 AS top FROM df, c WHERE term IN {IN}), f AS (SELECT coalesce(l.id, v.id) AS id, 0.35 * greatest(0, least(1, coalesce(v.score, 0))) + 0.65 * coalesce(l.score / top, 0) AS confidence FROM l FULL JOIN v ON l.id = v.id, m)
SELECT id, round(confidence, 6) AS confidence FROM f WHERE confidence >= 0.3""")
def confident_answers(spark: SparkSession, sf: str) -> DataFrame:
    lexical, vector = _branches(spark, sf)
    top = L.ceiling(corpus(spark, sf), TERMS)
    both = lexical.select("id", C("score").alias("l")).join(vector.select("id", C("score").alias("v")), "id", "full_outer").crossJoin(F.broadcast(top))
    return K.abstain(both.select("id", K.confidence(C("v"), C("l"), C("ceiling")).alias("confidence")), 0.3).select("id", F.round("confidence", 6).alias("confidence"))


@query(f"WITH {POST}, s AS (SELECT id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))) AS score FROM tf JOIN df USING (term) JOIN len USING (id), c WHERE term IN {IN} GROUP BY id), r AS (SELECT id, source, row_number() OVER (PARTITION BY source ORDER BY round(score, 9) DESC, id) AS k FROM s JOIN documents ON doc_id = id WHERE lang = 'en') SELECT id, source FROM r WHERE k <= 2")
def facets_and_cap(spark: SparkSession, sf: str) -> DataFrame:
    """The facet filters before ranking, with corpus-wide frequencies; at most two hits a source."""
    docs = t(spark, sf, "documents").select(C("doc_id").alias("id"), "source", "lang").filter("lang = 'en'")
    hits = L.bm25(corpus(spark, sf), TERMS, keep=docs.select("id")).withColumn("score", F.round("score", 9)).join(docs, "id")
    return K.capped(hits, "source", 2).select("id", "source")


@query()
def highlight_whole(spark: SparkSession, sf: str) -> DataFrame:
    """Every document and its whole text; compared with brute force in the tests."""
    return t(spark, sf, "documents").select("doc_id", L.highlight(C("text"), ["the", "und"]).alias("h"))
