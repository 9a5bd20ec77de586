"""Functions and operators with worked answers."""

import math

import pytest
from pyspark.sql import functions as F

from brindle.functions import aggregates as A
from brindle.functions import datetimes as D
from brindle.functions import geometry as G
from brindle.functions import jsons as J
from brindle.functions import strings as S
from brindle.functions import vectors as V
from brindle.operators import dml, relational, windows
from brindle.retrieval import lexical as L
from brindle.retrieval import ranking as K
from brindle.retrieval import tokenize
from brindle.session import Catalog, Table, affinity
from brindle.sources import files
from brindle.streaming import windows as ST

SF = "/root/testdata/sf0.001"


def one(spark, *cols):
    return tuple(spark.range(1).select(*(c.alias(f"c{i}") for i, c in enumerate(cols))).first())


def test_strings(spark):
    lit = F.lit
    assert one(spark, S.round_(lit(2.675), 2), S.round_(lit(-0.5)), S.round_(lit(1.005), 2)) == (2.67, -1.0, 1.0)
    assert one(spark, S.substr(lit("hello"), 0, 2), S.substr(lit("hello"), -3, 2), S.substr(lit("hello"), 3, -2), S.substr(lit("hello"), 9)) == ("h", "ll", "he", "")
    assert one(spark, S.printf("%5d|%-4s|%Q|%q", lit(42), lit("ab"), lit("it's"), lit("a'b")), S.char(lit(72), lit(8364))) == ("   42|ab  |'it''s'|a''b", "H€")
    assert one(spark, S.unhex(lit("4g")), S.hex_(lit(None).cast("string")), S.unistr(lit("a\\u00e9\\\\"))) == (None, "", "aé\\")
    assert one(spark, S.like(lit("É"), "é"), S.like(lit("Abc"), "a_C"), S.glob(lit("a1"), "a[0-9]"), S.glob(lit("ab"), "a[^b]")) == (False, True, True, False)
    assert one(spark, S.add(lit(2**63 - 1), lit(1)), S.shift_left(lit(1), lit(64)), S.shift_left(lit(8), lit(-2)), S.mod(lit(5.7), lit(2))) == (float(2**63), 0, 2, 1)


def test_dates(spark):
    ts = D.instant(F.lit("2024-01-31 10:20:30"))
    assert one(spark, D.date(ts, "+1 month"), D.date(ts, "+1 month", "floor"), D.datetime(ts, "start of year", "+36 hours"), D.date(ts, "weekday 1")) == ("2024-03-02", "2024-02-29", "2024-01-02 12:00:00", "2024-02-05")
    assert one(spark, D.strftime("%I %p %k|%W|%V|%G|%%", ts), D.strftime("%Q", ts), D.julianday(D.instant(F.lit("2000-01-01 12:00:00")))) == ("10 AM 10|05|05|2024|%", None, 2451545.0)
    assert one(spark, D.timediff(D.instant(F.lit("2024-03-01")), D.instant(F.lit("2024-01-30 12:00:00")))) == ("+0000-01-00 12:00:00.000",)
    assert one(spark, D.instant(F.lit("nonsense")), D.time(D.instant(F.lit(2451545.25), "julian"))) == (None, "18:00:00")


def test_json(spark):
    doc = F.lit('{"b": [1, 2], "a": {"x": null}}')
    assert one(spark, J.json_(doc), J.set_(doc, "$.b[#]", 3, "$.c", "n"), J.remove(doc, "$.b[0]", "$.a")) == ('{"b":[1,2],"a":{"x":null}}', '{"b":[1,2,3],"a":{"x":null},"c":"n"}', '{"b":[2]}')
    assert one(spark, J.insert(doc, "$.b", 0), J.replace(doc, "$.z", 1), J.array_insert(doc, "$.b[1]", 9)) == ('{"b":[1,2],"a":{"x":null}}', '{"b":[1,2],"a":{"x":null}}', '{"b":[1,9,2],"a":{"x":null}}')
    assert one(spark, J.json_(F.lit("{a: 'x', /* c */ b: [1,],}")), J.error_position(F.lit('{"a":x}')), J.error_position(F.lit("[1]")), J.valid(F.lit("{")), J.json_type(doc, "$.b"), J.json_type(doc, "$.a.x"), J.json_type(doc, "$.q")) == ('{"a":"x","b":[1]}', 6, 0, 0, "array", "null", None)
    assert one(spark, J.patch(doc, '{"a":null,"b":7}'), J.object_("k", F.lit(1), "n", F.lit(None).cast("string")), J.array_length(doc, "$.b")) == ('{"b":7}', '{"k":1,"n":null}', 2)


def test_vectors_and_polygons(spark):
    a, b = V.literal([3, 4]), V.literal([0, 1])
    assert one(spark, V.l2_distance(a, b), V.l1_distance(a, b), V.dot(a, b), V.norm(a), V.cosine_distance(a, V.literal([0, 0]))) == (math.sqrt(18), 6.0, 4.0, 5.0, None)
    assert one(spark, V.binary_quantize(V.literal([1, -1, 2])), V.hamming_distance(F.lit("101"), F.lit("011")), V.jaccard_distance(F.lit("00"), F.lit("00")), V.subvector(a, 2, 2)) == ("101", 2, None, None)
    with pytest.raises(ValueError):
        V.parse("[1, NaN]")
    sq, inner = F.lit("[[0,0],[4,0],[4,4],[0,4],[0,0]]"), F.lit("[[1,1],[2,1],[2,2],[1,2]]")
    assert one(spark, G.area(sq), G.contains_point(sq, F.lit(2.0), F.lit(2.0)), G.contains_point(sq, F.lit(4.0), F.lit(2.0)), G.contains_point(sq, F.lit(5.0), F.lit(2.0))) == (16.0, 2, 1, 0)
    assert one(spark, G.overlap(inner, sq), G.overlap(sq, inner), G.overlap(sq, sq), G.within(inner, sq), G.area(G.ccw(F.lit("[[0,0],[0,1],[1,0]]")))) == (2, 3, 4, 1, 0.5)
    assert abs(one(spark, G.area(F.lit(G.regular(0, 0, 1, 360))))[0] - math.pi) < 1e-3


def test_exact_sum_and_disc(spark):
    df = spark.createDataFrame([(-1e300,), (124.25,), (1e300,)], "x double")
    assert df.agg(A.exact_sum("x")).first()[0] == 124.25
    four = spark.createDataFrame([(1,), (2,), (3,), (4,)], "x int")
    assert four.agg(A.percentile_disc(F.col("x"), 0.3)).first()[0] == 1


def test_exclude_group_and_ties(spark):
    rows = spark.createDataFrame([("a", 1, 10), ("a", 1, 20), ("a", 2, 30)], "g string, k int, v int")
    whole = (windows.START, windows.END)
    got = lambda kind: sorted(r["s"] if r["s"] is not None else -1 for r in windows.excluding(rows, ["g"], [F.col("k")], whole, "v", kind, "s").collect())
    assert got("group") == [30, 30, 30] and got("ties") == [40, 50, 60] and got("current row") == [30, 40, 50]


def test_recursion_distinct_and_limit(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 5)], "a long, b long")
    step = lambda d: d.join(edges, d.x == edges.a).select(edges.b.alias("x"))
    assert sorted(r["x"] for r in relational.recursive(spark.sql("SELECT 1L AS x"), step).collect()) == [1, 2, 3]
    assert relational.recursive(spark.sql("SELECT 1L AS x"), step, distinct=False, limit=7).count() == 7


def test_upsert_and_update(spark):
    t = Table(spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "id long, s string, n int"), ["id"], not_null=["s"])
    new = spark.createDataFrame([(2, "B", 5), (3, "c", 7)], "id long, s string, n int")
    rows, touched = dml.upsert(t, new, ["id"], {"n": "n + excluded.n"}, "excluded.n > 4")
    assert sorted(map(tuple, rows.collect())) == [(1, "a", 1), (2, "b", 7), (3, "c", 7)] and touched.count() == 2
    with pytest.raises(dml.ConstraintError):
        dml.update(t, {"s": "NULL"})


def test_stems_and_tokens():
    pairs = {"caresses": "caress", "ponies": "poni", "running": "run", "hopping": "hop", "relational": "relat", "happily": "happili", "generously": "generous", "skies": "sky", "national": "nation", "conditional": "condit", "electricity": "electr", "hopefulness": "hope", "by": "by", "dying": "die"}
    assert {w: tokenize.stem(w) for w in pairs} == pairs
    assert tokenize.search_tokens("The Jobs at a.b@x.org use foo-bar_baz") == ["job", "a.b@x.org", "use", "foo-bar_baz", "foo", "bar", "baz"]


def test_match_expressions(spark):
    docs = spark.createDataFrame([(1, "one two three four"), (2, "two one"), (3, "three two one zero"), (4, "")], "id long, t string")
    post = L.postings(docs, "id", tokenize.plain(F.col("t")))
    hit = lambda q: sorted(r["id"] for r in L.match(post, q).collect())
    assert hit("one AND three") == [1, 3] and hit("one NOT three") == [2] and hit('"two one"') == [2, 3]
    assert hit("thr*") == [1, 3] and hit("^two") == [2] and hit("zero OR four") == [1, 3]
    assert hit("NEAR(one four, 2)") == [1] and hit("NEAR(one four, 1)") == [] and hit("one two") == [1, 2, 3]


def test_proximity_prefers_close_terms(spark):
    docs = spark.createDataFrame([(1, "red x x x x x fox"), (2, "red fox x x x x x")], "id long, t string")
    c = L.Corpus.of(docs, "id", tokenize.plain(F.col("t")))
    again = {r["id"]: r["score"] for r in L.rescored(c, L.bm25(c, ["red", "fox"]), ["red", "fox"], 5).collect()}
    assert again[2] > again[1]


def test_snippet_and_highlight(spark):
    x = F.lit("one two three four five six")
    assert one(spark, L.snippet(x, ["four"], "<", ">", "...", 3), L.highlight(x, ["two"])) == ("...two three <four>...", "one [two] three four five six")


def test_approximate_search_recall(spark):
    e = spark.read.parquet(f"{SF}/embeddings.parquet")
    index = K.InvertedFile(e, "vec_id", "embedding", lists=8)
    queries = [list(r["embedding"]) for r in e.filter("vec_id % 50 = 0").select("embedding").collect()]
    hits = sum(len({r["id"] for r in index.search(q, 10, probes=5).collect()} & {r["id"] for r in K.exact_search(e, "vec_id", "embedding", q, 10).collect()}) for q in queries)
    assert hits / (10 * len(queries)) >= 0.9


def test_fusion_details(spark):
    l = spark.createDataFrame([(1, 3.0), (2, 1.0)], "id long, score double")
    v = spark.createDataFrame([(2, 0.9), (3, 0.9)], "id long, score double")
    mm = {r["id"]: (round(r["score"], 6), r["origin"]) for r in K.min_max(l, v).collect()}
    assert mm == {1: (0.65, "lexical"), 2: (0.35, "both"), 3: (0.35, "vector")}
    assert K.adaptive_weight(1, 0, 0.5, 0.1, 0) == pytest.approx(0.49) and K.adaptive_weight(0, 9, 0, 0, 9) == 0.05
    assert K.diversified([(1, 1.0, [1, 0]), (2, 0.99, [1, 0]), (3, 0.6, [0, 1])], 2) == [1, 3]


def test_streams_give_the_batch_answer(spark):
    path = f"{SF}/events.parquet"
    batch = spark.read.parquet(path)
    stream = spark.readStream.schema(batch.schema).parquet("/root/testdata/sf0.001", pathGlobFilter="events.parquet")
    got = ST.run_to_end(ST.tumbling(stream, "ts", "1 day", ["event_type"], n=F.count(F.lit(1))), "tumbled")
    want = ST.tumbling(batch, "ts", "1 day", ["event_type"], n=F.count(F.lit(1)))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    deduped = ST.run_to_end(ST.deduplicated(stream.select("user_id", "ts"), ["user_id"], "ts"), "users", "append")
    assert deduped.count() >= batch.select("user_id").distinct().count()


def test_files_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "a,b", 1.5), (2, 'q"x', None)], "i long, s string, d double")
    files.write_delimited(df, str(tmp_path / "c"))
    back = files.read_delimited(spark, str(tmp_path / "c"), {"i": "INTEGER", "s": "TEXT", "d": "REAL"})
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    assert files.render(df, "json").startswith('[{"i":1,"s":"a,b","d":1.5}') and files.render(df, "quote").splitlines()[1] == "2,'q\"x',NULL"
    for mode in ("list", "column", "line", "csv", "tabs", "insert", "markdown", "table", "box", "html", "ascii"):
        assert "a,b" in files.render(df, mode)
    c = Catalog(spark)
    c.register("dumped", df)
    assert "INSERT INTO dumped VALUES(2,'q\"x',NULL);" in files.dump(c, "dumped")
    import sqlite3

    with sqlite3.connect(tmp_path / "x.db") as db:
        db.executescript("CREATE TABLE z(a INTEGER, b TEXT); INSERT INTO z VALUES (1,'x'),(2,NULL)")
    assert sorted(map(tuple, files.read_embedded(spark, str(tmp_path / "x.db"), "z").collect())) == [(1, "x"), (2, None)]
    assert relational.digest(df).first() == relational.digest(df.repartition(3)).first()


def test_affinity_and_snapshots(spark):
    assert [affinity(t) for t in ("BIGINT", "VARCHAR(9)", "", "DOUBLE", "DECIMAL(3)")] == ["integer", "text", "blob", "real", "numeric"]
    c = Catalog(spark)
    c.register("snap", spark.range(3).toDF("a"))
    c.savepoint()
    c.replace("snap", spark.range(9).toDF("a"))
    c.rollback()
    assert spark.table("snap").count() == 3


def test_json_tree_and_archives(spark, tmp_path):
    import zipfile

    from brindle.operators import tables

    df = spark.createDataFrame([(1, '{"a":[1,{"b":null}],"c d":true}'), (2, "not json"), (3, None)], "id long, doc string")
    got = [(r["fullkey"], r["type"], r["atom"], r["parent"]) for r in tables.json_tree(df, "doc").orderBy("id", "fullkey").collect()]
    assert got == [("$", "object", None, None), ('$."c d"', "true", "1", 0), ("$.a", "array", None, 0), ("$.a[0]", "integer", "1", 1), ("$.a[1]", "object", None, 1), ("$.a[1].b", "null", None, 3)]
    with zipfile.ZipFile(tmp_path / "x.zip", "w") as z:
        z.writestr("one.txt", "hello")
        z.writestr("dir/two.txt", "")
    listed = tables.zip_members(files.read_binary_files(spark, str(tmp_path), "*.zip"))
    assert sorted((r["name"], r["size"], bytes(r["data"])) for r in listed.collect()) == [("dir/two.txt", 0, b""), ("one.txt", 5, b"hello")]


def test_dynamic_values_compare_by_class(spark):
    from brindle.functions import dynamic

    values = [None, -1, 0, 0.0, 0.5, 2**62, 2**62 + 1, float(2**62), "", "0", "a", b"", b"\x00"]
    df = dynamic.create(spark, list(enumerate(values)))
    pairs = df.alias("x").crossJoin(df.alias("y")).select(F.col("x.k").alias("a"), F.col("y.k").alias("b"), dynamic.compare(F.col("x.v"), F.col("y.v")).alias("c"))
    rank = lambda v: 1 if isinstance(v, (int, float)) else 2 if isinstance(v, str) else 3

    def want(a, b):
        if a is None or b is None:
            return None
        if rank(a) != rank(b):
            return -1 if rank(a) < rank(b) else 1
        return (a > b) - (a < b)

    for r in pairs.collect():
        assert r["c"] == want(values[r["a"]], values[r["b"]]), (values[r["a"]], values[r["b"]])
    assert df.select(dynamic.group_key(F.col("v")).alias("g")).distinct().count() == len(values) - 2


def test_series_module_narrows_itself(spark):
    from brindle.operators import tables

    spark.dataSource.register(tables.Series)
    before = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    try:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
        got = spark.read.format("brindle_series").options(start="0", stop="1000000", step="7", pushdown="true").load().filter("value > 100 AND value <= 140")
        assert sorted(r["value"] for r in got.collect()) == [105, 112, 119, 126, 133, 140]
    finally:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", before)
