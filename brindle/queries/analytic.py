"""Aggregates, window functions and streaming windows over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import aggregates as A
from ..operators import relational as R
from ..operators import windows as W
from ..streaming import windows as ST
from .registry import query
from .registry import table as t

def by_customer():  # noqa: ANN201
    """Orders of a customer by date (built when asked for: a window needs a session)."""
    return Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")


OVER = "OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey"


@query("SELECT l_returnflag, count(DISTINCT l_suppkey) AS n, CAST(sum(DISTINCT l_linenumber) AS BIGINT) AS s, count(*) FILTER (WHERE l_quantity > 25) AS big FROM lineitem GROUP BY 1")
def distinct_and_filter_aggregates(spark: SparkSession, sf: str) -> DataFrame:
    return t(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.count_distinct("l_suppkey").alias("n"), F.sum_distinct("l_linenumber").alias("s"), F.count(F.when(F.col("l_quantity") > 25, 1)).alias("big"))


@query("SELECT coalesce(sum(value), 0.0) AS t, sum(value) AS s, avg(value) AS a, count(value) AS n, min(value) AS lo, max(value) AS hi FROM events WHERE event_id < 0")
def aggregates_of_nothing(spark: SparkSession, sf: str) -> DataFrame:
    v = F.col("value")
    return t(spark, sf, "events").filter("event_id < 0").agg(A.total(v).alias("t"), F.sum(v).alias("s"), F.avg(v).alias("a"), F.count(v).alias("n"), F.min(v).alias("lo"), F.max(v).alias("hi"))


@query("SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names, string_agg(n_name, ' / ' ORDER BY n_nationkey DESC) AS back FROM nation GROUP BY 1")
def group_concat(spark: SparkSession, sf: str) -> DataFrame:
    x = F.col("n_name")
    return t(spark, sf, "nation").groupBy("n_regionkey").agg(A.group_concat(x, order=x).alias("names"), A.group_concat(x, " / ", -F.col("n_nationkey")).alias("back"))


@query("SELECT n_regionkey, '[' || string_agg('\"' || n_name || '\"', ',' ORDER BY n_name) || ']' AS arr, '{' || string_agg('\"' || n_name || '\":' || n_nationkey, ',' ORDER BY n_name) || '}' AS obj FROM nation GROUP BY 1")
def json_group(spark: SparkSession, sf: str) -> DataFrame:
    return t(spark, sf, "nation").groupBy("n_regionkey").agg(A.json_group_array(F.col("n_name")).alias("arr"), A.json_group_object(F.col("n_name"), F.col("n_nationkey")).alias("obj"))


@query("SELECT event_type, median(value) AS med, quantile_cont(value, 0.9) AS p90, quantile_cont(value, 0.25) AS q1 FROM events GROUP BY 1")
def percentiles(spark: SparkSession, sf: str) -> DataFrame:
    v = F.col("value")
    return t(spark, sf, "events").groupBy("event_type").agg(A.median(v).alias("med"), A.percentile(v, 90).alias("p90"), A.percentile_cont(v, 0.25).alias("q1"))


@query("SELECT o_orderpriority, list_sort(list(o_totalprice))[CAST(floor(0.3 * (count(*) - 1)) AS BIGINT) + 1] AS d FROM orders GROUP BY 1")
def percentile_disc(spark: SparkSession, sf: str) -> DataFrame:
    """The element at floor(0.3 (n - 1)): a rank in the group, so no group is held as one list."""
    w = Window.partitionBy("o_orderpriority").orderBy("o_totalprice")
    sized = t(spark, sf, "orders").select("o_orderpriority", "o_totalprice", (F.row_number().over(w) - 1).alias("r"), F.count(F.lit(1)).over(Window.partitionBy("o_orderpriority")).alias("n"))
    return sized.filter(F.col("r") == F.floor(F.lit(0.3) * (F.col("n") - 1))).select("o_orderpriority", F.col("o_totalprice").alias("d"))


@query("SELECT o_custkey, max(o_totalprice) AS o_totalprice, arg_max(o_orderkey, o_totalprice) AS o_orderkey FROM orders GROUP BY 1")
def bare_columns_with_max(spark: SparkSession, sf: str) -> DataFrame:
    return R.bare_columns(t(spark, sf, "orders"), ["o_custkey"], greatest="o_totalprice", bare=["o_orderkey"])


@query("SELECT count(*) AS n FROM orders HAVING count(*) > 10")
def having_without_group(spark: SparkSession, sf: str) -> DataFrame:
    return R.having(t(spark, sf, "orders"), [F.count(F.lit(1)).alias("n")], F.col("n") > 10)


@query("SELECT year(o_orderdate) AS y, o_orderpriority AS p, count(*) AS n FROM orders GROUP BY 1, 2 HAVING count(*) > 5")
def group_by_expression(spark: SparkSession, sf: str) -> DataFrame:
    return t(spark, sf, "orders").groupBy(F.year("o_orderdate").cast("long").alias("y"), F.col("o_orderpriority").alias("p")).agg(F.count(F.lit(1)).alias("n")).filter("n > 5")


@query("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def rollup(spark: SparkSession, sf: str) -> DataFrame:
    return t(spark, sf, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT label, round(avg(embedding[1]), 5) AS x0, round(sum(embedding[64]), 3) AS x63 FROM embeddings GROUP BY 1")
def vector_aggregates(spark: SparkSession, sf: str) -> DataFrame:
    from ..functions.vectors import vector_avg, vector_sum

    v = F.col("embedding")
    out = t(spark, sf, "embeddings").groupBy("label").agg(vector_avg(v, 64).alias("a"), vector_sum(v, 64).alias("s"))
    return out.select("label", F.round(F.col("a")[0], 5).alias("x0"), F.round(F.col("s")[63], 3).alias("x63"))


# Windows -----------------------------------------------------------------------


@query(f"""SELECT o_orderkey, row_number() {OVER}) AS rn, rank() OVER w AS rk, dense_rank() OVER w AS dr, round(percent_rank() OVER w, 9) AS pr, round(cume_dist() OVER w, 9) AS cd, ntile(3) {OVER}) AS nt
FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderpriority)""")
def ranking_functions(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderpriority")
    return t(spark, sf, "orders").select(
        "o_orderkey", F.row_number().over(by_customer()).cast("long").alias("rn"), F.rank().over(w).cast("long").alias("rk"), F.dense_rank().over(w).cast("long").alias("dr"),
        F.round(F.percent_rank().over(w), 9).alias("pr"), F.round(F.cume_dist().over(w), 9).alias("cd"), F.ntile(3).over(by_customer()).cast("long").alias("nt"),
    )


@query(f"SELECT o_orderkey, lag(o_orderkey) {OVER}) AS a, lead(o_orderkey, 2, -1) {OVER}) AS b FROM orders")
def lag_lead(spark: SparkSession, sf: str) -> DataFrame:
    return t(spark, sf, "orders").select("o_orderkey", F.lag("o_orderkey").over(by_customer()).alias("a"), F.lead("o_orderkey", 2, -1).over(by_customer()).alias("b"))


@query(f"SELECT o_orderkey, first_value(o_orderkey) {OVER} ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS f, last_value(o_orderkey) {OVER} ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS l, nth_value(o_orderkey, 2) {OVER} ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS n FROM orders")
def frame_values(spark: SparkSession, sf: str) -> DataFrame:
    w = by_customer().rowsBetween(-2, 1)
    k = "o_orderkey"
    return t(spark, sf, "orders").select(k, F.first(k).over(w).alias("f"), F.last(k).over(w).alias("l"), F.nth_value(k, 2).over(w).alias("n"))


@query("SELECT event_id, count(*) OVER (PARTITION BY event_type ORDER BY value RANGE BETWEEN 5 PRECEDING AND 0.5 FOLLOWING) AS n FROM events")
def range_frame(spark: SparkSession, sf: str) -> DataFrame:
    return spark.sql("SELECT event_id, count(*) OVER (PARTITION BY event_type ORDER BY value RANGE BETWEEN 5 PRECEDING AND 0.5 FOLLOWING) AS n FROM {e}", e=t(spark, sf, "events"))


@query("SELECT o_orderkey, CAST(sum(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderpriority GROUPS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS BIGINT) AS s FROM orders")
def groups_frame(spark: SparkSession, sf: str) -> DataFrame:
    return W.group_frame(t(spark, sf, "orders"), ["o_custkey"], [F.col("o_orderpriority")], -1, 1, s=F.sum("o_orderkey")).select("o_orderkey", "s")


def _excluded(kind: str) -> str:
    return f"SELECT o_orderkey, CAST(sum(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_orderdate, o_orderkey ROWS BETWEEN 3 PRECEDING AND 2 FOLLOWING EXCLUDE {kind}) AS BIGINT) AS s FROM orders"


def _exclude(spark: SparkSession, sf: str, kind: str) -> DataFrame:
    return W.excluding(t(spark, sf, "orders"), ["o_custkey"], [F.col("o_orderpriority"), F.col("o_orderdate"), F.col("o_orderkey")], (-3, 2), "o_orderkey", kind, "s").select("o_orderkey", "s")


@query(_excluded("CURRENT ROW"))
def exclude_current_row(spark: SparkSession, sf: str) -> DataFrame:
    return _exclude(spark, sf, "current row")


@query(_excluded("NO OTHERS"))
def exclude_no_others(spark: SparkSession, sf: str) -> DataFrame:
    return _exclude(spark, sf, "no others")


@query("SELECT o_orderkey, count(*) FILTER (WHERE o_orderstatus = 'F') OVER (PARTITION BY o_custkey) AS n, count(DISTINCT o_orderpriority) OVER (PARTITION BY o_custkey) AS d FROM orders")
def window_filter_distinct(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("o_custkey")
    return t(spark, sf, "orders").select("o_orderkey", W.filtered(F.count, F.lit(1), F.col("o_orderstatus") == "F").over(w).alias("n"), W.count_distinct_over(F.col("o_orderpriority"), w).alias("d"))


@query("SELECT o_custkey, round(sum(o_totalprice), 2) AS s, row_number() OVER (ORDER BY round(sum(o_totalprice), 2) DESC, o_custkey) AS r FROM orders GROUP BY 1 ORDER BY r LIMIT 50")
def window_over_groups(spark: SparkSession, sf: str) -> DataFrame:
    """The first 50 of all groups: ranks are numbered after the top-k, so no window sees all rows."""
    top = t(spark, sf, "orders").groupBy("o_custkey").agg(F.round(F.sum("o_totalprice"), 2).alias("s")).orderBy(F.desc("s"), "o_custkey").limit(50)
    return top.withColumn("r", F.row_number().over(Window.orderBy(F.desc("s"), "o_custkey")).cast("long"))


@query("SELECT o_orderkey, lag(o_orderkey, CAST(o_orderkey % 3 AS INTEGER)) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS v FROM orders")
def lag_by_column(spark: SparkSession, sf: str) -> DataFrame:
    rows = t(spark, sf, "orders").select("o_custkey", "o_orderkey", (F.col("o_orderkey") % 3).alias("n"))
    return W.offset_value(rows, ["o_custkey"], [F.col("o_orderkey")], "o_orderkey", "n", "v").select("o_orderkey", "v")


# Event-time windows ---------------------------------------------------------------


@query("SELECT strftime(time_bucket(INTERVAL '6 hours', ts), '%Y-%m-%d %H:%M:%S') AS w, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def tumbling_windows(spark: SparkSession, sf: str) -> DataFrame:
    out = ST.tumbling(t(spark, sf, "events"), "ts", "6 hours", ["event_type"], n=F.count(F.lit(1)))
    return out.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("w"), "event_type", "n")


@query("SELECT strftime(b + to_hours(CAST(k AS BIGINT)), '%Y-%m-%d %H:%M:%S') AS w, count(*) AS n FROM (SELECT time_bucket(INTERVAL '1 hour', ts) - INTERVAL '2 hours' AS b FROM events), range(0, 3) r(k) GROUP BY 1")
def sliding_windows(spark: SparkSession, sf: str) -> DataFrame:
    out = ST.tumbling(t(spark, sf, "events"), "ts", "3 hours", [], slide="1 hour", n=F.count(F.lit(1)))
    return out.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("w"), "n")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '12 hours' THEN 0 ELSE 1 END AS b FROM events),
s AS (SELECT user_id, ts, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def session_windows(spark: SparkSession, sf: str) -> DataFrame:
    out = ST.sessions(t(spark, sf, "events"), "ts", "12 hours", ["user_id"], n=F.count(F.lit(1)))
    return out.select("user_id", F.date_format("session_start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")
