"""Scans, predicates, joins, subqueries, set operations, sorting, recursion and writes over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import strings as S
from ..operators import dml
from ..operators import relational as R
from ..session import Table
from .registry import query
from .registry import table as t

DATE = "date_format"


@query("""SELECT l_returnflag, l_linestatus, CAST(sum(l_quantity) AS DOUBLE) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_price,
round(avg(l_quantity), 6) AS avg_qty, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem
WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2 ORDER BY 1, 2""")
def pricing_summary(spark: SparkSession, sf: str) -> DataFrame:
    return (
        t(spark, sf, "lineitem").filter(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp")).groupBy("l_returnflag", "l_linestatus")
        .agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.sum("l_extendedprice"), 2).alias("sum_price"), F.round(F.avg("l_quantity"), 6).alias("avg_qty"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count(F.lit(1)).alias("n"))
        .orderBy("l_returnflag", "l_linestatus")
    )


@query("SELECT count(*) AS n, CAST(sum(o_custkey) AS BIGINT) AS s, max(o_orderstatus) AS m FROM orders")
def scan_aggregate(spark: SparkSession, sf: str) -> DataFrame:
    return t(spark, sf, "orders").agg(F.count(F.lit(1)).alias("n"), F.sum("o_custkey").alias("s"), F.max("o_orderstatus").alias("m"))


@query("SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1 ORDER BY 1")
def scan_group(spark: SparkSession, sf: str) -> DataFrame:
    return t(spark, sf, "orders").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n")).orderBy("o_orderpriority")


@query("SELECT c_custkey, c_name FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 100")
def scan_sort_topn(spark: SparkSession, sf: str) -> DataFrame:
    return t(spark, sf, "customer").orderBy(F.desc("c_acctbal"), "c_custkey").limit(100).select("c_custkey", "c_name")


@query("SELECT DISTINCT l_shipdate IS NULL AS missing, l_returnflag FROM lineitem")
def scan_distinct(spark: SparkSession, sf: str) -> DataFrame:
    return t(spark, sf, "lineitem").select(F.col("l_shipdate").isNull().alias("missing"), "l_returnflag").distinct()


@query("SELECT count(o_custkey) AS n FROM orders WHERE o_orderkey BETWEEN 100 AND 5000")
def range_scan(spark: SparkSession, sf: str) -> DataFrame:
    return t(spark, sf, "orders").filter(F.col("o_orderkey").between(100, 5000)).agg(F.count("o_custkey").alias("n"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey <= 50 ORDER BY o_orderkey DESC")
def reverse_scan(spark: SparkSession, sf: str) -> DataFrame:
    return t(spark, sf, "orders").filter("o_orderkey <= 50").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_orderkey"))


@query("SELECT l_suppkey, min(l_partkey) AS first_part FROM lineitem GROUP BY l_suppkey")
def skip_scan(spark: SparkSession, sf: str) -> DataFrame:
    return t(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.min("l_partkey").alias("first_part"))


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey = 42")
def point_probe(spark: SparkSession, sf: str) -> DataFrame:
    return t(spark, sf, "customer").filter("c_custkey = 42").select("c_custkey", "c_name")


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey IN (1, 5, 9, 77, 1000000)")
def seek_union(spark: SparkSession, sf: str) -> DataFrame:
    return t(spark, sf, "customer").filter(F.col("c_custkey").isin(1, 5, 9, 77, 1000000)).select("c_custkey", "c_mktsegment")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_orderkey = 33 AND l_linenumber > 2) OR l_orderkey > 33 ORDER BY l_orderkey, l_linenumber LIMIT 40")
def keyset_page(spark: SparkSession, sf: str) -> DataFrame:
    page = ((F.col("l_orderkey") == 33) & (F.col("l_linenumber") > 2)) | (F.col("l_orderkey") > 33)
    return t(spark, sf, "lineitem").filter(page).select("l_orderkey", "l_linenumber").orderBy("l_orderkey", "l_linenumber").limit(40)


@query("SELECT CAST(a AS BIGINT) AS a, b FROM (VALUES (1, 'x'), (2, NULL), (3, 'z')) v(a, b)")
def values_scan(spark: SparkSession, sf: str) -> DataFrame:
    return spark.sql("SELECT cast(a AS bigint) AS a, b FROM VALUES (1, 'x'), (2, NULL), (3, 'z') v(a, b)")


@query("SELECT n_name, k FROM (SELECT n_name, n_regionkey * 10 + 1 AS k FROM nation) WHERE k > 11")
def derived_table(spark: SparkSession, sf: str) -> DataFrame:
    return t(spark, sf, "nation").select("n_name", (F.col("n_regionkey") * 10 + 1).alias("k")).filter("k > 11")


@query("""SELECT l_orderkey, l_linenumber, l_orderkey // nullif(l_linenumber - 1, 0) AS d, CAST(CAST(l_quantity AS BIGINT) % nullif(l_linenumber - 1, 0) AS BIGINT) AS m,
l_quantity / nullif(l_linenumber - 1, 0) AS q FROM lineitem""")
def arithmetic(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("l_linenumber") - 1
    return t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", S.int_div(F.col("l_orderkey"), k).alias("d"), S.mod(F.col("l_quantity"), k).alias("m"), S.real_div(F.col("l_quantity"), k).alias("q"))


@query("""SELECT o_orderkey, o_custkey & 255 AS a, o_custkey | 7 AS o, ~o_custkey AS n,
CAST(CASE WHEN l >= 9223372036854775808 THEN l - 18446744073709551616 ELSE l END AS BIGINT) AS l, o_custkey >> (o_orderkey % 10) AS r
FROM (SELECT *, CASE WHEN o_orderkey % 70 >= 64 THEN CAST(0 AS HUGEINT) ELSE CAST(o_custkey AS HUGEINT) * CAST(power(2, o_orderkey % 70) AS HUGEINT) % 18446744073709551616 END AS l FROM orders)""")
def bit_operations_whole(spark: SparkSession, sf: str) -> DataFrame:
    """All orders, shifts by 0 to 69 bits; SQL multiplies, modulo 2^64."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return t(spark, sf, "orders").select(
        "o_orderkey", c.bitwiseAND(255).alias("a"), c.bitwiseOR(7).alias("o"), F.bitwise_not(c).alias("n"), S.shift_left(c, k % 70).alias("l"), S.shift_right(c, k % 10).alias("r")
    )


@query("""SELECT event_id, (CAST(value AS VARCHAR) IS NOT DISTINCT FROM NULL) AS is_null, value > 50 AND NOT (user_id < 10) AS both_true, value > 90 OR user_id IS NULL AS either FROM events""")
def three_valued_logic(spark: SparkSession, sf: str) -> DataFrame:
    v, u = F.col("value"), F.col("user_id")
    return t(spark, sf, "events").select("event_id", v.eqNullSafe(F.lit(None)).alias("is_null"), ((v > 50) & ~(u < 10)).alias("both_true"), ((v > 90) | u.isNull()).alias("either"))


@query("""SELECT p_partkey, CASE p_brand WHEN 'Brand#11' THEN 'a' WHEN 'Brand#12' THEN 'b' ELSE 'z' END AS simple,
CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'mid' END AS searched FROM part""")
def case_expressions(spark: SparkSession, sf: str) -> DataFrame:
    b, s = F.col("p_brand"), F.col("p_size")
    return t(spark, sf, "part").select("p_partkey", F.when(b == "Brand#11", "a").when(b == "Brand#12", "b").otherwise("z").alias("simple"), F.when(s < 10, "small").when(s < 30, "mid").alias("searched"))


@query(r"""SELECT p_partkey, CAST(coalesce(TRY_CAST(regexp_extract(p_name, '^\s*([+-]?\d+)', 1) AS BIGINT), 0) AS BIGINT) AS i,
coalesce(TRY_CAST(regexp_extract(CAST(p_size AS VARCHAR) || 'xyz', '^\s*([+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?)', 1) AS DOUBLE), 0.0) AS r FROM part""")
def lenient_cast(spark: SparkSession, sf: str) -> DataFrame:
    return t(spark, sf, "part").select("p_partkey", S.cast_integer(F.col("p_name")).alias("i"), S.cast_real(F.concat(F.col("p_size").cast("string"), F.lit("xyz"))).alias("r"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_orderkey, l_linenumber) < (100, 3) AND (l_suppkey, l_returnflag) IN ((1, 'R'), (2, 'N'), (3, 'A'))")
def row_values(spark: SparkSession, sf: str) -> DataFrame:
    less = (F.col("l_orderkey") < 100) | ((F.col("l_orderkey") == 100) & (F.col("l_linenumber") < 3))
    pairs = spark.createDataFrame([(1, "R"), (2, "N"), (3, "A")], "l_suppkey long, l_returnflag string")
    return t(spark, sf, "lineitem").filter(less).join(F.broadcast(pairs), ["l_suppkey", "l_returnflag"], "left_semi").select("l_orderkey", "l_linenumber")


@query("SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 5000.0")
def bound_parameters(spark: SparkSession, sf: str) -> DataFrame:
    return spark.sql("SELECT c_custkey FROM {c} WHERE c_mktsegment = :seg AND c_acctbal > :bal", args={"seg": "BUILDING", "bal": 5000.0}, c=t(spark, sf, "customer"))


@query("SELECT min(lower(n_name)) AS k, count(*) AS n FROM nation GROUP BY lower(n_name)")
def collate_nocase(spark: SparkSession, sf: str) -> DataFrame:
    key = S.lower(F.col("n_name"))
    return t(spark, sf, "nation").groupBy(key.alias("key")).agg(F.min(key).alias("k"), F.count(F.lit(1)).alias("n")).drop("key")


# Joins ------------------------------------------------------------------------


@query("SELECT n_name, count(*) AS n, round(sum(c_acctbal), 2) AS bal FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def hash_join(spark: SparkSession, sf: str) -> DataFrame:
    c, n = t(spark, sf, "customer"), t(spark, sf, "nation")
    return c.join(n, c.c_nationkey == n.n_nationkey).groupBy("n_name").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("c_acctbal"), 2).alias("bal"))


@query("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 300000")
def left_join_residual(spark: SparkSession, sf: str) -> DataFrame:
    c, o = t(spark, sf, "customer"), t(spark, sf, "orders")
    return c.join(o, (o.o_custkey == c.c_custkey) & (o.o_totalprice > 300000), "left").select("c_custkey", "o_orderkey")


@query("SELECT s_suppkey, n_name FROM nation RIGHT JOIN supplier ON s_nationkey = n_nationkey AND n_regionkey = 1")
def right_join(spark: SparkSession, sf: str) -> DataFrame:
    n, s = t(spark, sf, "nation"), t(spark, sf, "supplier")
    return n.join(s, (s.s_nationkey == n.n_nationkey) & (n.n_regionkey == 1), "right").select("s_suppkey", "n_name")


@query("SELECT a.k AS a_k, b.k AS b_k FROM (SELECT c_custkey AS k FROM customer) a FULL JOIN (SELECT s_suppkey AS k FROM supplier) b ON a.k = b.k + 20")
def full_join(spark: SparkSession, sf: str) -> DataFrame:
    a = t(spark, sf, "customer").select(F.col("c_custkey").alias("a_k"))
    b = t(spark, sf, "supplier").select(F.col("s_suppkey").alias("b_k"))
    return a.join(b, F.col("a_k") == F.col("b_k") + 20, "full")


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def semi_join(spark: SparkSession, sf: str) -> DataFrame:
    c, o = t(spark, sf, "customer"), t(spark, sf, "orders").filter("o_orderstatus = 'F'")
    return c.join(o, o.o_custkey == c.c_custkey, "left_semi").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def anti_join(spark: SparkSession, sf: str) -> DataFrame:
    c, o = t(spark, sf, "customer"), t(spark, sf, "orders")
    return c.join(o, o.o_custkey == c.c_custkey, "left_anti").select("c_custkey")


@query("SELECT a.r_name AS a, b.r_name AS b FROM region a, region b WHERE a.r_regionkey < b.r_regionkey")
def theta_join(spark: SparkSession, sf: str) -> DataFrame:
    a = t(spark, sf, "region").select(F.col("r_regionkey").alias("x"), F.col("r_name").alias("a"))
    b = t(spark, sf, "region").select(F.col("r_regionkey").alias("y"), F.col("r_name").alias("b"))
    return a.join(b, F.col("x") < F.col("y")).select("a", "b")


@query("SELECT k, x, y FROM (SELECT n_nationkey AS k, n_name AS x FROM nation WHERE n_nationkey < 12) FULL JOIN (SELECT s_nationkey AS k, count(*) AS y FROM supplier WHERE s_nationkey > 5 GROUP BY 1) USING (k)")
def using_full_join(spark: SparkSession, sf: str) -> DataFrame:
    a = t(spark, sf, "nation").filter("n_nationkey < 12").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("x"))
    b = t(spark, sf, "supplier").filter("s_nationkey > 5").groupBy(F.col("s_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("y"))
    return R.using_join(a, b, ["k"], "full")


@query("SELECT * FROM (SELECT n_nationkey AS k, n_name AS x FROM nation) NATURAL JOIN (SELECT c_nationkey AS k, c_custkey AS c FROM customer)")
def natural_join(spark: SparkSession, sf: str) -> DataFrame:
    return R.natural_join(t(spark, sf, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("x")), t(spark, sf, "customer").select(F.col("c_nationkey").alias("k"), F.col("c_custkey").alias("c")))


@query("SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey JOIN region ON r_regionkey = a.n_regionkey WHERE r_name <> 'ASIA'")
def self_join(spark: SparkSession, sf: str) -> DataFrame:
    n = t(spark, sf, "nation")
    a, b, r = n.alias("a"), n.alias("b"), t(spark, sf, "region").filter("r_name <> 'ASIA'")
    on = (F.col("a.n_regionkey") == F.col("b.n_regionkey")) & (F.col("a.n_nationkey") < F.col("b.n_nationkey"))
    return a.join(b, on).join(r, F.col("a.n_regionkey") == r.r_regionkey).select(F.col("a.n_name").alias("a"), F.col("b.n_name").alias("b"))


@query("SELECT band, count(*) AS n, min(o_orderkey) AS k FROM orders JOIN (SELECT i AS band, i * 20000.0 AS lo, i * 20000.0 + 25000.0 AS hi FROM range(0, 25) x(i)) b ON o_totalprice BETWEEN lo AND hi GROUP BY band")
def range_band_join(spark: SparkSession, sf: str) -> DataFrame:
    bands = spark.range(25).select(F.col("id").alias("band"), (F.col("id") * 20000.0).alias("lo"), (F.col("id") * 20000.0 + 25000.0).alias("hi"))
    return R.range_join(t(spark, sf, "orders"), bands, "o_totalprice", "lo", "hi", 10000.0).groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("k"))


@query("""SELECT e.event_id, p.v FROM events e ASOF LEFT JOIN (SELECT user_id, ts, max(value) AS v FROM events WHERE event_type = 'click' GROUP BY 1, 2) p ON e.user_id = p.user_id AND e.ts >= p.ts""")
def asof_join(spark: SparkSession, sf: str) -> DataFrame:
    e = t(spark, sf, "events")
    clicks = e.filter("event_type = 'click'").groupBy("user_id", "ts").agg(F.max("value").alias("v"))
    return R.asof_join(e.select("event_id", "user_id", "ts"), clicks, ["user_id"], "ts", ["v"]).select("event_id", "v")


@query("SELECT event_id, j.key AS key, CAST(j.value AS VARCHAR) AS value FROM events, json_each(events.props) j")
def lateral_json_each_whole(spark: SparkSession, sf: str) -> DataFrame:
    return R.json_each(t(spark, sf, "events").select("event_id", "props"), "props").select("event_id", "key", "value")


# Subqueries, CTEs -----------------------------------------------------------------


@query("SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.8 FROM orders)")
def uncorrelated_scalar(spark: SparkSession, sf: str) -> DataFrame:
    return spark.sql("SELECT o_orderkey FROM {o} WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.8 FROM {o})", o=t(spark, sf, "orders"))


@query("SELECT c_custkey, (SELECT max(o_totalprice) FROM orders WHERE o_custkey = c_custkey) AS top FROM customer")
def correlated_scalar(spark: SparkSession, sf: str) -> DataFrame:
    return spark.sql("SELECT c_custkey, (SELECT max(o_totalprice) FROM {o} o WHERE o.o_custkey = c.c_custkey) AS top FROM {c} c", o=t(spark, sf, "orders"), c=t(spark, sf, "customer"))


@query("SELECT count(*) AS n FROM orders a WHERE EXISTS (SELECT 1 FROM lineitem b WHERE b.l_orderkey = a.o_orderkey AND l_quantity > 45)")
def correlated_exists(spark: SparkSession, sf: str) -> DataFrame:
    o, li = t(spark, sf, "orders"), t(spark, sf, "lineitem").filter("l_quantity > 45")
    return o.join(li, li.l_orderkey == o.o_orderkey, "left_semi").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT n_nationkey, n_name IN (SELECT CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE n2.n_name END FROM supplier JOIN nation n2 ON s_nationkey = n2.n_nationkey WHERE n2.n_regionkey = nation.n_regionkey) AS found FROM nation""")
def correlated_in(spark: SparkSession, sf: str) -> DataFrame:
    """IN with NULLs: true, NULL where a NULL is among the candidates, else false."""
    n, s = t(spark, sf, "nation"), t(spark, sf, "supplier")
    named = s.join(n, s.s_nationkey == n.n_nationkey).select(F.col("n_regionkey").alias("r"), F.when(F.col("s_suppkey") % 7 != 0, F.col("n_name")).alias("x"))
    by = named.groupBy("r").agg(F.max(F.col("x").isNull()).alias("nulls"), F.collect_set("x").alias("xs"))
    hit = F.array_contains("xs", F.col("n_name"))
    return n.join(by, F.col("n_regionkey") == F.col("r"), "left").select("n_nationkey", F.when(F.col("r").isNull(), False).when(hit, True).when(F.col("nulls"), F.lit(None)).otherwise(False).alias("found"))


@query("SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 10)")
def not_in_subquery(spark: SparkSession, sf: str) -> DataFrame:
    return R.not_in(t(spark, sf, "part").select("p_partkey"), "p_partkey", t(spark, sf, "lineitem").filter("l_quantity > 10").select("l_partkey"))


@query("WITH big AS (SELECT o_custkey, sum(o_totalprice) AS s FROM orders GROUP BY 1 HAVING sum(o_totalprice) > 500000) SELECT c_name, round(s, 2) AS s FROM big JOIN customer ON c_custkey = o_custkey")
def common_table(spark: SparkSession, sf: str) -> DataFrame:
    big = t(spark, sf, "orders").groupBy("o_custkey").agg(F.sum("o_totalprice").alias("s")).filter("s > 500000")
    c = t(spark, sf, "customer")
    return big.join(c, c.c_custkey == big.o_custkey).select("c_name", F.round("s", 2).alias("s"))


@query("WITH RECURSIVE c(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM c WHERE n < 50) SELECT CAST(n AS BIGINT) AS n, CAST(n * n AS BIGINT) AS sq FROM c")
def recursive_union_all(spark: SparkSession, sf: str) -> DataFrame:
    return spark.sql("WITH RECURSIVE c(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM c WHERE n < 50) SELECT cast(n AS bigint) AS n, cast(n * n AS bigint) AS sq FROM c")


@query("""WITH RECURSIVE e AS (SELECT DISTINCT l_partkey % 40 AS a, l_suppkey % 40 AS b FROM lineitem), r(x) AS (SELECT 1 UNION SELECT b FROM r JOIN e ON a = x) SELECT CAST(x AS BIGINT) AS x FROM r""")
def recursive_union(spark: SparkSession, sf: str) -> DataFrame:
    edges = t(spark, sf, "lineitem").select((F.col("l_partkey") % 40).alias("a"), (F.col("l_suppkey") % 40).alias("b")).distinct()
    return R.recursive(spark.sql("SELECT 1L AS x"), lambda d: d.join(edges, F.col("a") == F.col("x")).select(F.col("b").alias("x")))


@query("""WITH RECURSIVE e AS (SELECT DISTINCT l_partkey AS a, l_suppkey AS b FROM lineitem), r(x) AS (SELECT 1 UNION SELECT b FROM r JOIN e ON a = x) SELECT CAST(x AS BIGINT) AS x FROM r""")
def recursive_union_whole(spark: SparkSession, sf: str) -> DataFrame:
    edges = t(spark, sf, "lineitem").select(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b")).distinct()
    return R.recursive(spark.sql("SELECT 1L AS x"), lambda d: d.join(edges, F.col("a") == F.col("x")).select(F.col("b").cast("long").alias("x")))


# Sorting, limits, sets --------------------------------------------------------------


@query("SELECT event_id FROM events ORDER BY value DESC NULLS LAST, event_id LIMIT 20 OFFSET 5")
def limit_offset(spark: SparkSession, sf: str) -> DataFrame:
    return t(spark, sf, "events").orderBy(F.desc_nulls_last("value"), "event_id").offset(5).limit(20).select("event_id")


@query("SELECT CAST(k AS BIGINT) AS k, CAST(row_number() OVER (ORDER BY v NULLS FIRST, k) AS BIGINT) AS r FROM (SELECT c_custkey AS k, CASE WHEN c_custkey % 5 <> 0 THEN c_acctbal END AS v FROM customer)")
def null_order(spark: SparkSession, sf: str) -> DataFrame:
    rows = t(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.when(F.col("c_custkey") % 5 != 0, F.col("c_acctbal")).alias("v"))
    # A rank over all rows without a window in one task: sorted partitions, then offsets of partitions.
    return global_row_number(rows, [F.asc_nulls_first("v"), F.asc("k")], "r").select("k", "r")


def global_row_number(df: DataFrame, order: list, name: str) -> DataFrame:
    """Row numbers of a total order: range partitions, numbers within, and the sizes of the partitions before."""
    ranged = R.checkpointed(df.orderBy(*order).withColumns({"__p": F.spark_partition_id(), "__m": F.monotonically_increasing_id()}))
    sizes = ranged.groupBy("__p").agg(F.count(F.lit(1)).alias("__c"), F.min("__m").alias("__lo"))
    before = sizes.select("__p", "__lo", F.coalesce(F.sum("__c").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__b"))
    return ranged.join(F.broadcast(before), "__p").withColumn(name, (F.col("__m") - F.col("__lo") + F.col("__b") + 1).cast("long")).drop("__p", "__m", "__lo", "__b")


@query("SELECT s_nationkey AS k FROM supplier UNION ALL SELECT n_nationkey FROM nation")
def union_all(spark: SparkSession, sf: str) -> DataFrame:
    return R.compound(t(spark, sf, "supplier").select(F.col("s_nationkey").alias("k")), ("union all", t(spark, sf, "nation").select("n_nationkey")))


@query("((SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier) INTERSECT SELECT n_nationkey FROM nation WHERE n_regionkey < 3) EXCEPT SELECT n_nationkey FROM nation WHERE n_nationkey % 2 = 0")
def compound_left_to_right(spark: SparkSession, sf: str) -> DataFrame:
    n = t(spark, sf, "nation")
    return R.compound(
        t(spark, sf, "customer").select(F.col("c_nationkey").alias("k")), ("union", t(spark, sf, "supplier").select("s_nationkey")), ("intersect", n.filter("n_regionkey < 3").select("n_nationkey")), ("except", n.filter("n_nationkey % 2 = 0").select("n_nationkey"))
    )


@query("SELECT k, x FROM (VALUES (1, 'a'), (2, 'b')) v(k, x) UNION SELECT n_nationkey, n_name FROM nation WHERE n_nationkey < 3")
def values_arm(spark: SparkSession, sf: str) -> DataFrame:
    return R.compound(spark.sql("SELECT * FROM VALUES (1, 'a'), (2, 'b') v(k, x)"), ("union", t(spark, sf, "nation").filter("n_nationkey < 3").select("n_nationkey", "n_name")))


# Writes ---------------------------------------------------------------------------


def _nation(spark: SparkSession, sf: str) -> Table:
    return Table(t(spark, sf, "nation"), primary_key=["n_nationkey"])


@query("SELECT * FROM nation UNION ALL SELECT 100 + r_regionkey, r_name, r_regionkey FROM region")
def insert_select(spark: SparkSession, sf: str) -> DataFrame:
    new = t(spark, sf, "region").select((F.col("r_regionkey") + 100).alias("n_nationkey"), F.col("r_name").alias("n_name"), F.col("r_regionkey").alias("n_regionkey"))
    return dml.insert(_nation(spark, sf), new)[0]


NEW_NATIONS = "SELECT CAST(r_regionkey * 7 AS INTEGER) AS n_nationkey, upper(r_name) AS n_name, r_regionkey AS n_regionkey FROM region"


def _new(spark: SparkSession, sf: str) -> DataFrame:
    return t(spark, sf, "region").select((F.col("r_regionkey") * 7).alias("n_nationkey"), F.upper("r_name").alias("n_name"), F.col("r_regionkey").alias("n_regionkey"))


@query(f"SELECT * FROM nation UNION ALL SELECT * FROM ({NEW_NATIONS}) WHERE n_nationkey NOT IN (SELECT n_nationkey FROM nation)")
def insert_or_ignore(spark: SparkSession, sf: str) -> DataFrame:
    return dml.insert(_nation(spark, sf), _new(spark, sf), "ignore")[0]


@query(f"SELECT * FROM nation WHERE n_nationkey NOT IN (SELECT n_nationkey FROM ({NEW_NATIONS})) UNION ALL {NEW_NATIONS}")
def insert_or_replace(spark: SparkSession, sf: str) -> DataFrame:
    return dml.insert(_nation(spark, sf), _new(spark, sf), "replace")[0]


@query(f"""SELECT coalesce(o.n_nationkey, x.n_nationkey) AS n_nationkey, CASE WHEN o.n_nationkey IS NULL THEN x.n_name WHEN x.n_nationkey IS NULL THEN o.n_name ELSE o.n_name || '+' || x.n_name END AS n_name,
coalesce(o.n_regionkey, x.n_regionkey) AS n_regionkey FROM nation o FULL JOIN ({NEW_NATIONS}) x ON o.n_nationkey = x.n_nationkey""")
def upsert(spark: SparkSession, sf: str) -> DataFrame:
    return dml.upsert(_nation(spark, sf), _new(spark, sf), ["n_nationkey"], {"n_name": "n_name || '+' || excluded.n_name"})[0]


@query("SELECT s_suppkey, s_name, s_nationkey, CASE WHEN s_nationkey < 10 THEN s_acctbal + n_regionkey ELSE s_acctbal END AS s_acctbal FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey")
def update_from(spark: SparkSession, sf: str) -> DataFrame:
    src = t(spark, sf, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_regionkey")
    return dml.update(Table(t(spark, sf, "supplier"), ["s_suppkey"]), {"s_acctbal": "s_acctbal + source.n_regionkey"}, "s_nationkey < 10", src, ["s_nationkey"])[0]


@query("SELECT * FROM supplier WHERE NOT coalesce(s_acctbal < 0, false)")
def delete_where(spark: SparkSession, sf: str) -> DataFrame:
    return dml.delete(Table(t(spark, sf, "supplier"), ["s_suppkey"]), "s_acctbal < 0")[0]


@query("SELECT * FROM supplier ORDER BY s_acctbal, s_suppkey LIMIT 7")
def delete_limit_returning(spark: SparkSession, sf: str) -> DataFrame:
    return dml.delete(Table(t(spark, sf, "supplier"), ["s_suppkey"]), None, [F.col("s_acctbal"), F.col("s_suppkey")], 7)[1]


@query("SELECT c_custkey, c_nationkey FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_nationkey < 20)")
def foreign_key_check(spark: SparkSession, sf: str) -> DataFrame:
    return dml.foreign_key_violations(t(spark, sf, "customer"), ["c_nationkey"], t(spark, sf, "nation").filter("n_nationkey < 20"), ["n_nationkey"]).select("c_custkey", "c_nationkey")


@query("SELECT s_suppkey, CASE WHEN s_nationkey < 5 THEN NULL ELSE s_nationkey END AS s_nationkey FROM supplier")
def foreign_key_set_null(spark: SparkSession, sf: str) -> DataFrame:
    gone = t(spark, sf, "nation").filter("n_nationkey < 5")
    return dml.on_delete(t(spark, sf, "supplier").select("s_suppkey", "s_nationkey"), ["s_nationkey"], gone, ["n_nationkey"], "set null")


@query("SELECT count(*) AS n_rows FROM orders")
def table_digest(spark: SparkSession, sf: str) -> DataFrame:
    return R.digest(t(spark, sf, "orders")).select("n_rows")
