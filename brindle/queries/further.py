"""Excluded frames of all aggregates, archives, binary JSON, match figures and the functions that no other query shows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import blobs as B
from ..functions import datetimes as D
from ..functions import geometry as G
from ..functions import jsons as J
from ..functions import maths as M
from ..functions import strings as S
from ..functions import vectors as V
from ..operators import relational as R
from ..operators import windows as W
from ..plans.lower import Engine
from ..retrieval import lexical as L
from ..retrieval import ranking as K
from ..streaming import windows as ST
from .registry import query
from .registry import table as t
from .scalars import HITS, POST, QUERY, VECTOR, _branches

C = F.col

# EXCLUDE for every aggregate ---------------------------------------------------

WHOLE = (Window.unboundedPreceding, Window.unboundedFollowing)
FIGURES = {"lo": ("min", "BIGINT"), "hi": ("max", "BIGINT"), "n": ("count", "BIGINT"), "m": ("avg", "DOUBLE")}


def _excluded_sql(order: str, frame: str, kind: str) -> str:
    over = f"OVER (PARTITION BY o_custkey ORDER BY {order} ROWS BETWEEN {frame} EXCLUDE {kind})"
    told = ", ".join(f"CAST({f}(o_orderkey) {over} AS {cast}) AS {name}" for name, (f, cast) in FIGURES.items())
    return f"SELECT o_orderkey, lo, hi, n, round(m, 6) AS m FROM (SELECT o_orderkey, {told} FROM orders)"


def _excluded(spark: SparkSession, sf: str, order: list[str], frame: tuple[int, int], kind: str) -> DataFrame:
    df = t(spark, sf, "orders").select("o_orderkey", "o_custkey", *order[: 1 if order[0] != "o_orderkey" else 0])
    for name, (f, _) in FIGURES.items():
        df = W.excluding(df, ["o_custkey"], [C(o) for o in order], frame, "o_orderkey", kind, name, f)
    return df.select("o_orderkey", "lo", "hi", "n", F.round("m", 6).alias("m"))


@query(_excluded_sql("o_orderkey", "3 PRECEDING AND 2 FOLLOWING", "CURRENT ROW"))
def exclude_current_row_figures(spark: SparkSession, sf: str) -> DataFrame:
    return _excluded(spark, sf, ["o_orderkey"], (-3, 2), "current row")


@query(_excluded_sql("o_orderpriority", "UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING", "GROUP"))
def exclude_group_figures(spark: SparkSession, sf: str) -> DataFrame:
    return _excluded(spark, sf, ["o_orderpriority"], WHOLE, "group")


@query(_excluded_sql("o_orderpriority", "UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING", "TIES"))
def exclude_ties_figures(spark: SparkSession, sf: str) -> DataFrame:
    return _excluded(spark, sf, ["o_orderpriority"], WHOLE, "ties")


# Archives and binary JSON ----------------------------------------------------------


@query("SELECT doc_id, md5(coalesce(text, '')) AS digest, octet_length(encode(coalesce(text, ''))) AS size FROM documents")
def archive_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    data = F.coalesce(C("text"), F.lit("")).cast("binary")
    back = t(spark, sf, "documents").select("doc_id", B.sqlar_uncompress(B.sqlar_compress(data), F.octet_length(data)).alias("b"))
    return back.select("doc_id", F.md5("b").alias("digest"), F.octet_length("b").cast("long").alias("size"))


@query("""SELECT event_id, format('{:X}', 3 + length(k)) || 'C176B' || length(k) || '3' || hex(encode(k)) AS h, '{"k":' || k || '}' AS j, 1 AS v FROM (SELECT event_id, json_extract_string(props, '$.k') AS k FROM events)""")
def json_binary(spark: SparkSession, sf: str) -> DataFrame:
    b = t(spark, sf, "events").select("event_id", B.jsonb("props").alias("b"))
    return b.select("event_id", F.hex("b").alias("h"), B.jsonb_text("b").alias("j"), B.jsonb_valid("b").alias("v"))


@query("""SELECT event_id, '{}' AS r, '{' || chr(10) || '    "k": ' || json_extract_string(props, '$.k') || chr(10) || '}' AS p, length(props) AS e, '{"k":' || json_extract_string(props, '$.k') || '}' AS j FROM events""")
def json_editing(spark: SparkSession, sf: str) -> DataFrame:
    p = C("props")
    cut = F.substring(p, F.lit(1), F.length(p) - 1)
    return t(spark, sf, "events").select("event_id", J.remove(p, "$.k").alias("r"), J.pretty(p).alias("p"), J.error_position(cut).alias("e"), J.json_(p).alias("j"))


@query("""SELECT event_id, '[' || k || ',7,"' || event_type || '"]' AS a, '{"t":"' || event_type || '","k":' || k || '}' AS o FROM (SELECT event_id, event_type, json_extract_string(props, '$.k') AS k FROM events WHERE event_type IS NOT NULL)""")
def json_building(spark: SparkSession, sf: str) -> DataFrame:
    k = J.extract(C("props"), "$.k", "long")
    made = J.array_insert(J.array(k, C("event_type")), "$[1]", 7)
    return t(spark, sf, "events").filter("event_type IS NOT NULL").select("event_id", made.alias("a"), J.object_("t", C("event_type"), "k", k).alias("o"))


# Scalars -----------------------------------------------------------------------------


@query("SELECT o_orderkey, strftime(o_orderdate, '%H:%M:%S') AS t, '+0000-00-01 12:00:00.000' AS later, '-0000-00-01 12:00:00.000' AS sooner FROM orders")
def date_differences(spark: SparkSession, sf: str) -> DataFrame:
    ts = D.instant(C("o_orderdate"), "timestamp")
    day, next_one = D.instant(D.datetime(ts)), D.instant(D.datetime(ts, "+36 hours"))
    return t(spark, sf, "orders").select("o_orderkey", D.time(ts).alias("t"), D.timediff(next_one, day).alias("later"), D.timediff(day, next_one).alias("sooner"))


@query("SELECT p_partkey, round(log2(p_size), 6) AS b, round(ln(p_retailprice) / ln(3), 6) AS l, round(p_retailprice % 7, 6) AS f, round(p_size * pi(), 6) AS p FROM part")
def math_more(spark: SparkSession, sf: str) -> DataFrame:
    price, size = C("p_retailprice"), C("p_size")
    return t(spark, sf, "part").select("p_partkey", F.round(M.log2(size), 6).alias("b"), F.round(M.log(F.lit(3), price), 6).alias("l"), F.round(M.fmod(price, F.lit(7)), 6).alias("f"), F.round(size * M.pi(), 6).alias("p"))


@query("SELECT p_partkey, chr(65 + p_size % 26) || 'é' AS c, p_name AS u, p_size AS z, 'A' || p_brand AS e FROM part")
def text_and_blobs(spark: SparkSession, sf: str) -> DataFrame:
    n = C("p_name")
    return t(spark, sf, "part").select(
        "p_partkey", S.char(F.lit(65) + C("p_size") % 26, F.lit(233)).alias("c"), S.unhex(S.hex_(n)).cast("string").alias("u"), F.octet_length(S.zeroblob(C("p_size"))).alias("z"), S.unistr(F.concat(F.lit("\\0041"), C("p_brand"))).alias("e")
    )


BITS = f"list_transform({QUERY}, lambda x: x > 0)"


@query(f"""SELECT vec_id, round(2 * n, 5) AS added, 0.0::DOUBLE AS gone, 1.0::DOUBLE AS unit, round(sqrt(list_sum(list_transform(e[3:6], lambda x: x * x))), 5) AS part, CAST(len(list_filter(range(1, 65), lambda i: (e[i] > 0) <> {BITS}[i])) AS BIGINT) AS h,
round(1 - len(list_filter(range(1, 65), lambda i: (e[i] > 0) AND {BITS}[i])) / len(list_filter(range(1, 65), lambda i: (e[i] > 0) OR {BITS}[i])), 6) AS j
FROM (SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS n FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings))""")
def vector_arithmetic(spark: SparkSession, sf: str) -> DataFrame:
    v = C("embedding")
    bits, other = V.binary_quantize(v), V.binary_quantize(V.literal(VECTOR))
    return t(spark, sf, "embeddings").select(
        "vec_id", F.round(V.norm(V.add(v, v)), 5).alias("added"), F.round(V.norm(V.sub(v, v)), 5).alias("gone"), F.round(V.norm(V.normalize(v)), 5).alias("unit"), F.round(V.norm(V.subvector(v, 3, 4)), 5).alias("part"),
        V.hamming_distance(bits, other).cast("long").alias("h"), F.round(V.jaccard_distance(bits, other), 6).alias("j"),
    )


@query("""SELECT p_partkey, CASE WHEN p_size > 10 THEN 2 WHEN p_size = 10 THEN 1 ELSE 0 END AS inside, CASE WHEN p_size < 30 THEN 1 ELSE 0 END AS w, CAST(6 * p_size * (p_size + 1) AS DOUBLE) AS wide, CAST(p_size * (p_size + 1) AS DOUBLE) AS turned FROM part""")
def polygon_functions(spark: SparkSession, sf: str) -> DataFrame:
    """Boxes of p_size by p_size + 1: points inside, boxes within a box, affine transforms, orientation."""
    s, more = C("p_size").cast("string"), (C("p_size") + 1).cast("string")
    box = F.concat(F.lit("[[0,0],["), s, F.lit(",0],["), s, F.lit(","), more, F.lit("],[0,"), more, F.lit("],[0,0]]"))
    back = F.concat(F.lit("[[0,0],[0,"), more, F.lit("],["), s, F.lit(","), more, F.lit("],["), s, F.lit(",0],[0,0]]"))
    outer = F.lit("[[-1,-1],[30.5,-1],[30.5,30.5],[-1,30.5],[-1,-1]]")
    return R.spread(t(spark, sf, "part").select("p_partkey", "p_size")).select(
        "p_partkey", G.contains_point(box, F.lit(10.0), F.lit(10.0)).cast("int").alias("inside"), G.within(box, outer).cast("int").alias("w"), G.area(G.transform(box, 2, 0, 0, 3, 5, -5)).alias("wide"), G.area(G.ccw(back)).alias("turned")
    )


# Retrieval ------------------------------------------------------------------------

WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+')"
INFO_TERMS = ["the", "que"]


@query(f"""WITH h AS (SELECT doc_id, {", ".join(f"len(list_filter({WORDS}, lambda w: w = '{w}')) AS h{i}" for i, w in enumerate(INFO_TERMS))} FROM documents), g AS (SELECT {", ".join(f"sum(h{i}) AS a{i}, count(*) FILTER (WHERE h{i} > 0) AS d{i}" for i in range(2))} FROM h)
SELECT doc_id, concat_ws(',', 2, 1, h0, CAST(a0 AS BIGINT), d0, h1, CAST(a1 AS BIGINT), d1) AS info FROM h, g""")
def match_figures(spark: SparkSession, sf: str) -> DataFrame:
    info = L.matchinfo(t(spark, sf, "documents").select("doc_id", "text"), ["text"], INFO_TERMS)
    return info.select("doc_id", F.array_join(C("matchinfo").cast("array<string>"), ",").alias("info"))


@query(f"""SELECT doc_id, 4 * len(list_filter({WORDS}, lambda w: w IN ('the', 'que'))) AS n FROM documents WHERE len(list_filter({WORDS}, lambda w: w IN ('the', 'que'))) > 0""")
def match_offsets(spark: SparkSession, sf: str) -> DataFrame:
    told = t(spark, sf, "documents").select("doc_id", L.offsets([C("text")], INFO_TERMS).alias("o")).filter("o <> ''")
    return told.select("doc_id", F.size(F.split("o", " ")).cast("long").alias("n"))


@query(f"""WITH {POST}, {HITS} SELECT coalesce(l.id, v.id) AS id, round(0.35 * coalesce(v.score / (SELECT max(score) FROM v), 0) + 0.65 * coalesce(l.score / (SELECT max(score) FROM l), 0), 6) AS score FROM l FULL JOIN v ON l.id = v.id""")
def fusion_max_scaled(spark: SparkSession, sf: str) -> DataFrame:
    return K.max_scaled(*_branches(spark, sf)).select("id", F.round("score", 6).alias("score"))


@query(None)
def diverse_results(spark: SparkSession, sf: str) -> DataFrame:
    """The ten most relevant and least alike of the thirty nearest vectors (a bounded candidate list)."""
    rows = t(spark, sf, "embeddings")
    near = K.exact_search(rows, "vec_id", "embedding", VECTOR, 30)
    found = near.join(rows.select(C("vec_id").alias("id"), "embedding"), "id").orderBy("distance", "id").collect()
    chosen = K.diversified([(r["id"], 1 - r["distance"], list(r["embedding"])) for r in found], 10)
    return spark.createDataFrame(list(enumerate(chosen)), "place int, id long")


# Streams and SQL -------------------------------------------------------------------


@query("SELECT event_id, event_type FROM events")
def stream_deduplicated(spark: SparkSession, sf: str) -> DataFrame:
    """Each event arrives twice; one of each stays."""
    twice = ST.table_stream(spark, sf, "events").withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    return ST.run_to_end(ST.deduplicated(twice, ["event_id"], "ts"), f"s_{uuid.uuid4().hex[:8]}", "append").select("event_id", "event_type")


@query("SELECT s_suppkey, s_name, s_nationkey, CASE WHEN s_nationkey < 10 THEN s_acctbal + n_regionkey ELSE s_acctbal END AS s_acctbal FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def sql_update_from(spark: SparkSession, sf: str) -> DataFrame:
    engine, name = Engine(spark), f"w_{uuid.uuid4().hex[:8]}"
    engine.catalog.load(sf, "nation")
    engine.catalog.register(name, t(spark, sf, "supplier"), primary_key=["s_suppkey"])
    return engine.sql(f"UPDATE {name} SET s_acctbal = s_acctbal + n.n_regionkey FROM nation AS n WHERE n.n_nationkey = s_nationkey AND s_nationkey < 10; SELECT * FROM {name}")


@query("SELECT n_nationkey AS k, n_name AS label, 'none' AS note FROM nation WHERE n_regionkey < 3")
def sql_definitions(spark: SparkSession, sf: str) -> DataFrame:
    """CREATE AS, ALTER, and a deletion that a savepoint undoes."""
    engine, name = Engine(spark), f"w_{uuid.uuid4().hex[:8]}"
    engine.catalog.load(sf, "nation")
    made = f"CREATE TABLE {name} AS SELECT n_nationkey AS k, n_name AS name FROM nation WHERE n_regionkey < 3; ALTER TABLE {name} RENAME COLUMN name TO label; ALTER TABLE {name} ADD COLUMN note TEXT DEFAULT 'none'"
    return engine.sql(f"{made}; SAVEPOINT s; DELETE FROM {name} WHERE k > 5; ROLLBACK TO s; RELEASE s; SELECT * FROM {name}")


@query("SELECT * FROM (VALUES (0, 'r_regionkey', 'INTEGER'), (1, 'r_name', 'TEXT')) v(cid, name, type)")
def sql_table_info(spark: SparkSession, sf: str) -> DataFrame:
    engine = Engine(spark)
    engine.catalog.load(sf, "region")
    return engine.sql("PRAGMA table_info(region)").select("cid", "name", "type")


@query("SELECT o_orderkey, sum(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderpriority GROUPS BETWEEN 1 PRECEDING AND 1 FOLLOWING EXCLUDE GROUP)::BIGINT AS s, max(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderpriority GROUPS 1 PRECEDING) AS hi FROM orders")
def sql_groups_frames(spark: SparkSession, sf: str) -> DataFrame:
    engine = Engine(spark)
    engine.catalog.load(sf, "orders")
    return engine.sql("SELECT o_orderkey, sum(o_orderkey) OVER (w GROUPS BETWEEN 1 PRECEDING AND 1 FOLLOWING EXCLUDE GROUP) AS s, max(o_orderkey) OVER (w GROUPS 1 PRECEDING) AS hi FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderpriority)")
