"""The SQL front end, dynamic values, modules, user functions, streams and files over the driver's tables."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import dynamic
from ..functions import geometry as G
from ..functions import strings as S
from ..operators import dml, tables
from ..operators.relational import shared_root
from ..plans.lower import Engine
from ..retrieval import lexical as L
from ..retrieval import ranking as K
from ..retrieval import tokenize
from ..session import Table
from ..sources import files
from ..streaming import windows as ST
from .registry import query
from .registry import table as t
from .scalars import QUERY, VECTOR, corpus

C = F.col


def _sql(spark: SparkSession, sf: str, text: str, *names: str, params: object = None) -> DataFrame:
    engine = Engine(spark)
    engine.catalog.load(sf, *names)
    return engine.sql(text, params)


# The SQL front end --------------------------------------------------------------


@query("SELECT c_mktsegment AS seg, count(*) AS n, max(c_acctbal) AS top, arg_max(c_custkey, c_acctbal) AS who FROM customer GROUP BY 1")
def sql_bare_columns(spark: SparkSession, sf: str) -> DataFrame:
    return _sql(spark, sf, "SELECT c_mktsegment AS seg, count(*) AS n, max(c_acctbal) AS top, c_custkey AS who FROM customer GROUP BY seg", "customer")


@query("SELECT o_orderkey, o_orderkey // 7 AS d, o_orderkey % 7 AS m, CASE WHEN lower(o_orderpriority) LIKE '%urgent' THEN 1 ELSE 0 END AS u FROM orders WHERE o_orderkey // 3 > 100")
def sql_integer_division(spark: SparkSession, sf: str) -> DataFrame:
    out = _sql(spark, sf, "SELECT o_orderkey, o_orderkey / 7 AS d, o_orderkey % 7 AS m, iif(o_orderpriority LIKE '%URGENT', 1, 0) AS u FROM orders WHERE o_orderkey / 3 > 100", "orders")
    return out.withColumn("u", C("u").cast("int"))


@query("WITH a AS (SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier) SELECT n_name, n_nationkey FROM nation WHERE n_nationkey IN (SELECT k FROM a) AND EXISTS (SELECT 1 FROM supplier s WHERE s.s_nationkey = nation.n_nationkey)")
def sql_cte_subqueries(spark: SparkSession, sf: str) -> DataFrame:
    return _sql(spark, sf, "WITH a(k) AS (SELECT c_nationkey FROM customer UNION SELECT s_nationkey FROM supplier) SELECT n_name, n_nationkey FROM nation WHERE n_nationkey IN (SELECT k FROM a) AND EXISTS (SELECT 1 FROM supplier s WHERE s.s_nationkey = nation.n_nationkey)", "customer", "supplier", "nation")


@query("WITH RECURSIVE r(k) AS (SELECT 0 UNION SELECT (k * 5 + 3) % 25 FROM r) SELECT n_name, n_nationkey FROM nation WHERE n_nationkey IN (SELECT k FROM r)")
def sql_recursive_union(spark: SparkSession, sf: str) -> DataFrame:
    return _sql(spark, sf, "WITH RECURSIVE r(k) AS (SELECT 0 UNION SELECT (k * 5 + 3) % 25 FROM r) SELECT n_name, n_nationkey FROM nation WHERE n_nationkey IN (SELECT k FROM r)", "nation")


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS d, strftime(CAST(date_trunc('month', o_orderdate) AS TIMESTAMP), '%Y-%m-%d') AS m FROM orders")
def sql_dates(spark: SparkSession, sf: str) -> DataFrame:
    return _sql(spark, sf, "SELECT o_orderkey, date(o_orderdate) AS d, date(o_orderdate, 'start of month') AS m FROM orders", "orders")


@query("SELECT n_nationkey, n_name || '!' AS n_name, n_regionkey FROM nation WHERE n_regionkey <> 2 UNION ALL SELECT 100, 'NEW', 2")
def sql_writes(spark: SparkSession, sf: str) -> DataFrame:
    engine = Engine(spark)
    name = f"w_{uuid.uuid4().hex[:8]}"
    engine.catalog.register(name, t(spark, sf, "nation"), primary_key=["n_nationkey"])
    return engine.sql(f"DELETE FROM {name} WHERE n_regionkey = 2; UPDATE {name} SET n_name = n_name || '!'; INSERT INTO {name} VALUES (100, 'NEW', 2); SELECT * FROM {name}")


# Writes with declarations -----------------------------------------------------------


@query("SELECT r_regionkey AS id, r_name AS name, 7 AS score, r_regionkey + 7 AS total FROM region")
def insert_defaults_generated(spark: SparkSession, sf: str) -> DataFrame:
    table = Table(spark.createDataFrame([], "id int, name string, score int, total int"), ["id"], not_null=["name"], defaults={"score": "7"}, generated={"total": "id + score"}, checks=["score > 0"])
    return dml.insert(table, t(spark, sf, "region").select(C("r_regionkey").alias("id"), C("r_name").alias("name")))[0]


@query("SELECT CAST(n_nationkey AS BIGINT) AS k, n_name AS v FROM nation UNION ALL SELECT 25 + row_number() OVER (ORDER BY r_regionkey), r_name FROM region".replace("25 +", "(SELECT max(n_nationkey) FROM nation) +"))
def autoincrement(spark: SparkSession, sf: str) -> DataFrame:
    table = Table(t(spark, sf, "nation").select(C("n_nationkey").cast("long").alias("k"), C("n_name").alias("v")), ["k"])
    new = t(spark, sf, "region").orderBy("r_regionkey").select(C("r_name").alias("v"))
    return dml.insert(table, dml.next_ids(table, new, "k"))[0]


@query("SELECT s_suppkey, s_acctbal * 2 AS s_acctbal FROM supplier WHERE s_nationkey = 3")
def update_returning(spark: SparkSession, sf: str) -> DataFrame:
    return dml.update(Table(t(spark, sf, "supplier"), ["s_suppkey"]), {"s_acctbal": "s_acctbal * 2"}, "s_nationkey = 3")[1].select("s_suppkey", "s_acctbal")


@query("SELECT s_suppkey FROM supplier WHERE s_nationkey >= 5")
def foreign_key_cascade(spark: SparkSession, sf: str) -> DataFrame:
    gone = t(spark, sf, "nation").filter("n_nationkey < 5")
    return dml.on_delete(t(spark, sf, "supplier").select("s_suppkey", "s_nationkey"), ["s_nationkey"], gone, ["n_nationkey"], "cascade").select("s_suppkey")


# Dynamic values, user functions, modules ----------------------------------------------


@query("SELECT * FROM (VALUES ('null', 2::BIGINT), ('integer', 3), ('real', 2), ('text', 2), ('blob', 1)) v(ty, n)")
def dynamic_typeof(spark: SparkSession, sf: str) -> DataFrame:
    rows = dynamic.create(spark, list(enumerate([None, 0, 0.5, "", "0", b"", 7, -3, 1e308, None])))
    return rows.groupBy(dynamic.typeof(C("v")).alias("ty")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT CAST(k AS BIGINT) AS k, CAST(r AS BIGINT) AS r FROM (VALUES (0, 1), (6, 2), (1, 3), (2, 4), (5, 5), (3, 6), (4, 7)) v(k, r)")
def dynamic_order(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    rows = dynamic.create(spark, list(enumerate([None, 1, 2.5, "abc", b"\x00", 10, -1])))
    return rows.select("k", F.row_number().over(Window.orderBy(*dynamic.order_key(C("v")))).cast("long").alias("r"))


@query("SELECT p_partkey, p_size * 2 + 1 AS y FROM part")
def user_scalar(spark: SparkSession, sf: str) -> DataFrame:
    f = tables.Functions(spark)
    f.create_scalar("twice", 1, lambda x: x * 2 + 1, T.IntegerType())
    return t(spark, sf, "part").select("p_partkey", f.call("twice", C("p_size")).alias("y"))


@query("SELECT event_id, sum(value) FILTER (WHERE event_type = 'click') OVER (PARTITION BY user_id ORDER BY event_id ROWS 3 PRECEDING) AS s, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events")
def sql_window_filter_whole(spark: SparkSession, sf: str) -> DataFrame:
    text = "SELECT event_id, sum(value) FILTER (WHERE event_type = 'click') OVER (w ROWS 3 PRECEDING) AS s, row_number() OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)"
    out = _sql(spark, sf, text, "events")
    return out.withColumn("n", C("n").cast("long"))


@query("SELECT p_brand, CAST(max(p_size) - min(p_size) AS DOUBLE) AS spread FROM part GROUP BY 1")
def user_aggregate(spark: SparkSession, sf: str) -> DataFrame:
    f = tables.Functions(spark)
    f.create_aggregate("spread", lambda x: float(x.max() - x.min()), T.DoubleType())
    return t(spark, sf, "part").groupBy("p_brand").agg(f.call("spread", C("p_size")).alias("spread"))


@query("SELECT CAST(c_custkey AS BIGINT) AS k FROM customer ORDER BY reverse(c_name), c_custkey LIMIT 20")
def user_collation(spark: SparkSession, sf: str) -> DataFrame:
    f = tables.Functions(spark)
    f.create_collation("BACK", F.reverse)
    return t(spark, sf, "customer").orderBy(f.key("back", C("c_name")), "c_custkey").limit(20).select(C("c_custkey").alias("k"))


@query("SELECT i AS value FROM range(100, 201, 3) r(i) WHERE i >= 120 AND i % 2 = 0")
def module_scan_pushdown(spark: SparkSession, sf: str) -> DataFrame:
    spark.dataSource.register(tables.Series)
    return spark.read.format("brindle_series").options(start="100", stop="200", step="3").load().filter("value >= 120 AND value % 2 = 0")


@query("SELECT event_id, j.fullkey AS fullkey, CAST(j.atom AS VARCHAR) AS atom FROM events, json_tree(events.props) j")
def lateral_json_tree_whole(spark: SparkSession, sf: str) -> DataFrame:
    return tables.json_tree(t(spark, sf, "events").select("event_id", "props"), "props").select("event_id", "fullkey", "atom")


@query("SELECT o_orderkey FROM orders WHERE o_totalprice >= 100000 AND o_totalprice <= 150000 AND o_custkey <= 500")
def rtree_range(spark: SparkSession, sf: str) -> DataFrame:
    return tables.rtree_query(t(spark, sf, "orders"), {"o_totalprice": (100000, 150000), "o_custkey": (None, 500)}).select("o_orderkey")


@query("""SELECT p_partkey, CASE WHEN p_size < 9 THEN 2 WHEN p_size > 20 THEN 0 ELSE 1 END AS code FROM part WHERE p_size NOT IN (9, 10, 20)""")
def polygon_overlap(spark: SparkSession, sf: str) -> DataFrame:
    """A unit box at (size, 0.5) against [0.5, 20.5] x [0, 10]: inside, across its right side, or apart."""
    s = C("p_size").cast("double")
    x0 = F.when(C("p_size") < 9, s).when(C("p_size") > 20, s + 1).otherwise(F.lit(20.0))
    corner = lambda x, y: F.concat(F.lit("["), x.cast("string"), F.lit(","), F.lit(str(y)), F.lit("]"))
    box = F.concat(F.lit("["), F.concat_ws(",", corner(x0, 0.5), corner(x0 + 1, 0.5), corner(x0 + 1, 1.5), corner(x0, 1.5)), F.lit("]"))
    rows = t(spark, sf, "part").filter("p_size NOT IN (9, 10, 20)")
    return rows.select("p_partkey", G.overlap(box, F.lit("[[0.5,0],[20.5,0],[20.5,10],[0.5,10]]")).alias("code"))


@query("SELECT n_name AS a, trim(n_name || '   ') AS b, rtrim(n_name || '  ') = n_name AS same FROM nation")
def collate_rtrim(spark: SparkSession, sf: str) -> DataFrame:
    n = C("n_name")
    padded = F.concat(n, F.lit("  "))
    return t(spark, sf, "nation").select(n.alias("a"), S.trim(F.concat(n, F.lit("   "))).alias("b"), (F.rtrim(padded) == n).alias("same"))


# Retrieval with stems and positions (no SQL: tested by hand) -----------------------------


@query()
def stemmed_search_rescored(spark: SparkSession, sf: str) -> DataFrame:
    """BM25 over stems with coverage, the best hits rescored for closeness and order."""
    c = corpus(spark, sf, tokenize.search(C("text")), "stems")
    terms = tokenize.search_tokens("erst thing erhe")
    return L.rescored(c, L.bm25(c, terms, coverage=L.COVERAGE), terms, 10)


@query()
def snippets(spark: SparkSession, sf: str) -> DataFrame:
    return t(spark, sf, "documents").select("doc_id", L.snippet(C("text"), ["the", "erst"], "[", "]", "...", 12).alias("s"))


TOP = max(abs(x) for x in VECTOR)
COARSE = "[" + ", ".join(f"{round(x * 127 / TOP)}::DOUBLE" for x in VECTOR) + "]"


@query(f"""WITH w AS (SELECT vec_id, embedding::DOUBLE[] AS e, list_max([abs(x) FOR x IN embedding::DOUBLE[]]) AS top FROM embeddings), rough AS (SELECT vec_id, e FROM w ORDER BY list_cosine_similarity([coalesce(round(x * 127 / nullif(top, 0)), 0) FOR x IN e], {COARSE}) DESC, vec_id LIMIT 30)
SELECT vec_id AS id, round(1 - list_cosine_similarity(e, {QUERY}), 6) AS distance FROM rough ORDER BY list_cosine_similarity(e, {QUERY}) DESC, vec_id LIMIT 10""")
def int8_rescored_search(spark: SparkSession, sf: str) -> DataFrame:
    """Three times k candidates by int8 components, ranked by full precision."""
    return K.rescored_search(t(spark, sf, "embeddings"), "vec_id", "embedding", VECTOR, 10).select("id", F.round("distance", 6).alias("distance"))


# Streams and files ---------------------------------------------------------------------


@query("SELECT event_type, count(*) AS n, strftime(time_bucket(INTERVAL '1 day', ts), '%Y-%m-%d') AS d FROM events GROUP BY 1, 3")
def stream_tumbling(spark: SparkSession, sf: str) -> DataFrame:
    """The same windows from a stream that has read everything."""
    out = ST.tumbling(ST.table_stream(spark, sf, "events"), "ts", "1 day", ["event_type"], n=F.count(F.lit(1)))
    return ST.run_to_end(out, f"s_{uuid.uuid4().hex[:8]}").select("event_type", "n", F.date_format("window_start", "yyyy-MM-dd").alias("d"))


@query("SELECT p_partkey, p_name, p_retailprice FROM part")
def csv_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    path = f"{shared_root(spark)}/csv-{uuid.uuid4().hex}"
    files.write_delimited(t(spark, sf, "part").select("p_partkey", "p_name", "p_retailprice"), path)
    return files.read_delimited(spark, path, {"p_partkey": "INTEGER", "p_name": "TEXT", "p_retailprice": "REAL"})


@query("SELECT event_id, j.key AS key, CAST(j.value AS VARCHAR) AS value FROM events, json_each(events.props) j")
def sql_json_each(spark: SparkSession, sf: str) -> DataFrame:
    return _sql(spark, sf, "SELECT event_id, j.key AS key, j.value AS value FROM events, json_each(events.props) AS j", "events")


@query("SELECT event_id, '{\"k\":' || json_extract_string(props, '$.k') || ',\"e\":\"' || event_type || '\"}' AS edited, '[' || event_id || ',\"' || event_type || '\",null]' AS made, lower(json_type(props)) AS kind FROM events")
def sql_json_functions(spark: SparkSession, sf: str) -> DataFrame:
    text = "SELECT event_id, json_set(props, '$.e', event_type) AS edited, json_array(event_id, event_type, NULL) AS made, json_type(props) AS kind FROM events"
    return _sql(spark, sf, text, "events")


@query("SELECT n_nationkey, n_regionkey IN (SELECT CASE WHEN r_regionkey < 2 THEN r_regionkey END FROM region) AS a, n_regionkey NOT IN (SELECT r_regionkey FROM region WHERE r_regionkey > 2) AS b FROM nation")
def sql_in_values(spark: SparkSession, sf: str) -> DataFrame:
    return _sql(spark, sf, "SELECT n_nationkey, n_regionkey IN (SELECT CASE WHEN r_regionkey < 2 THEN r_regionkey END FROM region) AS a, n_regionkey NOT IN (SELECT r_regionkey FROM region WHERE r_regionkey > 2) AS b FROM nation", "nation", "region")


@query("SELECT p_partkey, printf('%05d|%.2f|%s', p_size, p_retailprice, p_brand) AS shown FROM part")
def sql_printf(spark: SparkSession, sf: str) -> DataFrame:
    return _sql(spark, sf, "SELECT p_partkey, printf('%05d|%.2f|%s', p_size, p_retailprice, p_brand) AS shown FROM part", "part")


@query("""WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings) SELECT vec_id, round(sqrt(list_sum([x * x FOR x IN e])), 6) AS norm, round(list_sum([abs(x) FOR x IN e]), 6) AS l1, len(e) AS dims,
  array_to_string([CASE WHEN x > 0 THEN '1' ELSE '0' END FOR x IN e], '') AS bits FROM v""")
def sql_vector_functions(spark: SparkSession, sf: str) -> DataFrame:
    text = "SELECT vec_id, round(vector_norm(embedding), 6) AS norm, round(l1_distance(embedding, vector_sub(embedding, embedding)), 6) AS l1, vector_dims(embedding) AS dims, binary_quantize(embedding) AS bits FROM embeddings"
    return _sql(spark, sf, text, "embeddings")

