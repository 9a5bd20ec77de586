"""Excluded frames by brute force, blobs, match offsets, UPDATE ... FROM and the command line."""

import random
import re

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from brindle import cli
from brindle.functions import blobs as B
from brindle.operators import windows
from brindle.plans.lower import Engine
from brindle.plans.parser import SqlError
from brindle.retrieval import lexical as L

SF = "/root/testdata/sf0.001"
UNB, END = Window.unboundedPreceding, Window.unboundedFollowing


@pytest.mark.parametrize("frame", [(UNB, END), (UNB, 0), (0, END), (-2, 1), (1, 3), (-3, -1)])
@pytest.mark.parametrize("exclude", ["current row", "group", "ties", "no others"])
def test_excluded_frames(spark, frame, exclude):
    rng = random.Random(5)
    # Peers have one value each time, so their order among themselves does not matter.
    rows = [(g, o, None if o % 4 == 0 else (o * 37) % 11) for g in range(3) for o in range(6) for _ in range(rng.randint(1, 3))]
    df = spark.createDataFrame(rows, "g int, o int, x int")
    for name in ("min", "max", "count", "avg", "sum", "total"):
        df = windows.excluding(df, ["g"], [F.col("o")], frame, "x", exclude, name, name)
    got = sorted(map(tuple, df.collect()), key=str)
    want = []
    for g in range(3):
        own = [r for r in rows if r[0] == g]
        for i, (_, o, x) in enumerate(own):
            left = [
                r[2] for j, r in enumerate(own)
                if max(frame[0], -99) <= j - i <= min(frame[1], 99)
                and not {"current row": j == i, "group": r[1] == o, "ties": r[1] == o and j != i, "no others": False}[exclude] and r[2] is not None
            ]
            mean, whole = (sum(left) / len(left), sum(left)) if left else (None, None)
            want.append((g, o, x, min(left, default=None), max(left, default=None), len(left), mean, whole, float(whole or 0)))
    assert got == sorted(want, key=str)


def test_min_without_the_current_row_in_an_endless_frame_is_refused(spark):
    df = spark.createDataFrame([(1, 1, 1)], "g int, o int, x int")
    with pytest.raises(ValueError):
        windows.excluding(df, ["g"], [F.col("o")], (UNB, -1), "x", "group", "m", "min")


def test_archives(spark):
    big = b"a" * 1000
    df = spark.createDataFrame([(bytearray(big), 1000), (bytearray(b"ab"), 2), (bytearray(b""), 0), (None, 1), (bytearray(b"broken"), 99)], "x binary, n long")
    packed = [r[0] for r in df.select(B.sqlar_compress("x")).collect()]
    assert len(packed[0]) < 50 and packed[1] == b"ab" and packed[2] == b"" and packed[3] is None
    back = [r[0] for r in df.select(B.sqlar_uncompress(B.sqlar_compress("x"), "n")).collect()]
    assert back[:4] == [big, b"ab", b"", None]
    assert df.select(B.sqlar_uncompress("x", "n")).collect()[4][0] is None


@pytest.mark.parametrize("text", ["null", "true", "[1,-2,3.5,1e+20]", '{"a":{"b":[]},"":"é\\n\\"q\\""}', '"' + "x" * 300 + '"', "[" + ",".join(["12345"] * 20_000) + "]"])
def test_binary_json_round_trip(text):
    import json

    assert B.decoded(B.encoded(json.loads(text))) == json.loads(text)


def test_binary_json_by_hand(spark):
    """A one-member object: text "a" is 17 61, integer 1 is 13 31, and their 4 bytes make 4C."""
    assert B.encoded({"a": 1}).hex() == "4c17611331"
    bad = [b"", b"\x4c\x17\x61", b"\x1f\x00", b"\x4c\x17\x61\x13\x31\x00", b"\x2c\x17\x61", b"\xcc"]
    df = spark.createDataFrame([(bytearray(b),) for b in bad] + [(None,)], "b binary")
    assert [tuple(r) for r in df.select(B.jsonb_text("b"), B.jsonb_valid("b")).collect()] == [(None, 0)] * len(bad) + [(None, None)]


def test_offsets_and_matchinfo(spark):
    rows = [(1, "The é cat, the CAT", "cat"), (2, None, "the"), (3, "", None), (4, "élan the", "catalog")]
    df = spark.createDataFrame(rows, "id int, a string, b string")
    got = {r[0]: r[1] for r in df.select("id", L.offsets([F.col("a"), F.col("b")], ["the", "cat"])).collect()}
    for key, a, b in rows:
        want = []
        for c, text in enumerate((a, b)):
            raw = (text or "").encode()
            want += [f"{c} {['the', 'cat'].index(m[0].lower().decode())} {m.start()} {len(m[0])}" for m in re.finditer(rb"(?<![0-9A-Za-z\x80-\xff])(?i:the|cat)(?![0-9A-Za-z\x80-\xff])", raw)]
        assert got[key] == " ".join(want)
    info = {r["id"]: r["matchinfo"] for r in L.matchinfo(df, ["a", "b"], ["the", "cat"]).collect()}
    assert info[1] == [2, 2, 2, 3, 2, 0, 1, 1, 2, 2, 1, 1, 1, 1] and info[3][2::3] == [0, 0, 0, 0]
    assert L.matchinfo(df.limit(0), ["a"], ["the"]).count() == 0


def test_update_from(spark):
    engine = Engine(spark)
    engine.sql("CREATE TABLE uf(k INTEGER PRIMARY KEY, v INTEGER); INSERT INTO uf VALUES (1, 10), (2, 20), (3, NULL); CREATE TABLE us(k INTEGER, d INTEGER); INSERT INTO us VALUES (1, 5), (1, 5), (3, 7), (9, 9)")
    back = engine.sql("UPDATE uf SET v = coalesce(uf.v, 0) + s.d FROM us AS s WHERE s.k = uf.k RETURNING k, v")
    assert sorted(map(tuple, back.collect())) == [(1, 15), (3, 7)]
    assert sorted(map(tuple, engine.sql("SELECT * FROM uf").collect())) == [(1, 15), (2, 20), (3, 7)]
    engine.sql("UPDATE uf SET v = q.m FROM (SELECT max(d) AS m FROM us) AS q WHERE uf.k = 2")
    assert engine.sql("SELECT v FROM uf WHERE k = 2").first()[0] == 9
    with pytest.raises(SqlError):
        engine.sql("UPDATE us SET d = 1 FROM uf WHERE uf.k = us.k")


def test_command_line(spark, tmp_path, capsys):
    run = lambda *a: cli.run(spark, a)
    assert "5" in run("query", SF, "SELECT count(*) AS n FROM region", "--mode", "csv")
    assert run("query", SF, "SELECT r_name FROM region WHERE r_regionkey = ?", "--param", "1", "--mode", "csv").count("\n") <= 2
    assert "lineitem" in run("tables", SF) and "r_name" in run("schema", SF, "region") and run("count", SF, "region") == "5"
    assert "Scan" in run("explain", SF, "SELECT * FROM region") and "FROM" in run("translate", SF, "SELECT * FROM region")
    assert "INSERT INTO" in run("dump", SF, "region")
    out = str(tmp_path / "out")
    run("export", SF, "SELECT r_regionkey, r_name FROM region", out, "--format", "csv")
    (tmp_path / "db").mkdir()
    run("import", str(tmp_path / "db"), out, "copy", "--columns", "r_regionkey INTEGER, r_name TEXT")
    assert run("count", str(tmp_path / "db"), "copy") == "5"
    assert "score" in run("search", SF, "documents", "doc_id", "text", "the que", "--limit", "3")
    vector = str([0.1] * 64)
    assert "distance" in run("nearest", SF, "embeddings", "vec_id", "embedding", vector, "--limit", "3")
    assert cli.main(["schema", SF, "nothing"]) == 1 and "no such table" in capsys.readouterr().err
