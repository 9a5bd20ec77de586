"""Queries whose plans must hold on larger tables: no subquery in one place, no value parsed again and again, no stream in the driver."""

import json
import random

import pytest
from pyspark.sql import functions as F

from brindle.functions import geometry as G
from brindle.operators import relational as R
from brindle.queries import QUERIES
from brindle.streaming import windows as ST

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("condition", ["q < 9", "q > 5", "q > 100", "q = 99"])
def test_not_in_is_that_of_sql(spark, condition):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c"), (None, "d")], "k int, s string")
    among = spark.createDataFrame([(1, 5), (3, 6), (3, 7), (None, 99)], "k int, q int").filter(condition).select("k")
    want = spark.sql("SELECT * FROM {a} WHERE k NOT IN (SELECT k FROM {b})", a=rows, b=among)
    assert sorted(map(str, R.not_in(rows, "k", among).collect())) == sorted(map(str, want.collect()))


def test_not_in_broadcasts_no_rows_of_the_subquery(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        plan = QUERIES["not_in_subquery"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "BroadcastHashJoin" not in plan


def _ring(rng, kind):
    if kind == 0:
        x, y, w, h = (rng.randint(-3, 3) for _ in range(4))
        v = [[x, y], [x + w, y], [x + w, y + h], [x, y + h]]
    else:
        v = [[rng.randint(-4, 4) / kind, rng.randint(-4, 4) / kind] for _ in range(rng.randint(1, 6))]
    return v + v[:1] if rng.random() < 0.5 else v


def test_polygons_of_many_rows_are_compared_as_one_by_one(spark):
    rng = random.Random(3)
    rings = [_ring(rng, rng.choice([0, 0, 1, 2])) for _ in range(900)]
    big = [[k, k * k % 977] for k in range(1100)]  # with itself over PAIRS pairs of edges
    pairs = [(rng.choice(rings), rng.choice(rings)) for _ in range(1500)] + [(r, r[::-1]) for r in rings[:50]] + [(big, rings[0]), (big, big)]
    rows = [(i, json.dumps(a), json.dumps(b), rng.randint(-8, 8) / 2, rng.randint(-8, 8) / 2) for i, (a, b) in enumerate(pairs)]
    rows += [(-1, None, "[[0,0],[1,0],[0,1]]", 0.0, 0.0), (-2, "[[0,0],[1,0],[0,1]]", None, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "i int, a string, b string, x double, y double").repartition(2)
    got = {r["i"]: tuple(r)[1:] for r in df.select("i", G.overlap("a", "b"), G.within("a", "b"), G.contains_point("a", "x", "y")).collect()}
    assert got.pop(-1) == (None, None, None) and got.pop(-2) == (None, None, 1)
    for i, a, b, x, y in rows[:-2]:
        a, b = G._open(json.loads(a)), G._open(json.loads(b))
        code = G.relation(a, b)
        assert got[i] == (code, {4: 2, 2: 1}.get(code, 0), G.point_in((x, y), a)), (a, b, x, y)
    assert {v[0] for v in got.values()} == {0, 1, 2, 3, 4}


def test_a_polygon_is_parsed_once_by_each_function(spark):
    plan = spark.range(1).select(G.area(G.ccw(F.col("id").cast("string"))).alias("a"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == 2
    nothing = spark.createDataFrame([(None,)], "s string")
    assert nothing.select(G.area("s"), G.area(G.ccw(F.col("s"))), G.bbox(F.col("s"))["x0"]).first()[:2] == (None, None)


def test_a_small_file_is_spread_over_the_cores(spark):
    rows = R.spread(spark.read.parquet(f"{SF}/part.parquet"))
    assert rows.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism and rows.count() == spark.read.parquet(f"{SF}/part.parquet").count()
    assert R.spread(spark.range(0, 100, 1, 64)).rdd.getNumPartitions() == 64


def test_a_stream_leaves_its_rows_in_the_shared_folder(spark):
    out = ST.run_to_end(ST.table_stream(spark, SF, "events").select("event_id", "ts"), "left_there", "append")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "parquet" in plan and "MemoryPlan" not in plan
    assert out.count() == spark.table("left_there").count() == spark.read.parquet(f"{SF}/events.parquet").count()


def test_streams_of_many_batches_and_of_none(spark, tmp_path):
    rows = spark.read.parquet(f"{SF}/events.parquet")
    rows.withColumn("event_id", F.col("event_id") % 50).repartition(3).write.parquet(str(tmp_path / "events.parquet"))
    stream = ST.read_stream(spark, str(tmp_path / "events.parquet"), rows.schema)
    n = ST.run_to_end(stream.groupBy("event_type").agg(F.count(F.lit(1)).alias("n")), "many_counted")
    assert sorted(map(str, n.collect())) == sorted(map(str, rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("n")).collect()))
    assert ST.run_to_end(stream.select("event_id"), "many_listed", "append").count() == rows.count()
    ids = ST.run_to_end(ST.deduplicated(stream, ["event_id"], "ts", "60 days"), "many_once", "append").select("event_id")
    assert sorted(r[0] for r in ids.collect()) == list(range(50))
    (tmp_path / "none").mkdir()
    none = ST.read_stream(spark, str(tmp_path / "none"), rows.schema)
    assert ST.run_to_end(none.select("event_id"), "none_there", "append").count() == 0


def test_a_stream_reads_a_table_in_a_folder_of_files(spark, tmp_path):
    rows = spark.read.parquet(f"{SF}/events.parquet")
    rows.repartition(3).write.parquet(str(tmp_path / "events.parquet"))
    got = QUERIES["stream_deduplicated"](spark, str(tmp_path))
    assert sorted(map(str, got.collect())) == sorted(map(str, rows.select("event_id", "event_type").collect()))
