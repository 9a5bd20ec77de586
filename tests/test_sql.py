"""The SQL front end against the standard library's engine, whose answers for these statements are those of the dialect."""

import random
import re
import sqlite3

import pytest
from sql_cases import CASES, SETUP, WRITES

from brindle.operators import relational
from brindle.operators.dml import ConstraintError
from brindle.plans.lower import Engine
from brindle.plans.parser import SqlError, parse
from brindle.session import Catalog, Table
from brindle.sources import files


def norm(v):
    """A column has one type, so a number among texts is a text."""
    if isinstance(v, str) and re.fullmatch(r"-?\d+(\.\d+)?", v):
        v = float(v)
    if isinstance(v, (bool, int, float)):
        return round(float(v), 9)
    return bytes(v) if isinstance(v, (bytes, bytearray)) else v


def rows(r):
    return sorted((tuple(map(norm, x)) for x in r), key=repr)


@pytest.fixture(scope="module")
def both(spark):
    engine, db = Engine(spark), sqlite3.connect(":memory:", isolation_level=None)
    for s in SETUP:
        engine.sql(s)
        db.executescript(s)
    return engine, db


@pytest.mark.parametrize("sql", CASES)
def test_select(both, sql):
    engine, db = both
    assert rows(map(tuple, engine.sql(sql).collect())) == rows(db.execute(sql).fetchall())


def test_random_predicates(both):
    """Ternary logic partitioning: the rows of p, NOT p and p IS NULL are all rows."""
    engine, db = both
    rng = random.Random(5)
    atom = lambda: rng.choice(["v > 1", "x < 2", "s LIKE 'a%'", "g = 'a'", "v IS NULL", "v / 2 = 1", "v IN (1, 5)", "x BETWEEN 0 AND 8"])
    for _ in range(6):
        p = f"({atom()} {rng.choice(['AND', 'OR'])} NOT {atom()}) OR {atom()}"
        parts = f"SELECT id FROM t WHERE {p} UNION ALL SELECT id FROM t WHERE NOT ({p}) UNION ALL SELECT id FROM t WHERE ({p}) IS NULL"
        assert rows(map(tuple, engine.sql(parts).collect())) == rows(db.execute("SELECT id FROM t").fetchall())
        assert rows(map(tuple, engine.sql(f"SELECT id FROM t WHERE {p}").collect())) == rows(db.execute(f"SELECT id FROM t WHERE {p}").fetchall())


def test_writes_in_order(both):
    engine, db = both
    for sql, look in WRITES:
        engine.sql(sql)
        db.execute(sql)
        assert rows(map(tuple, engine.sql(look).collect())) == rows(db.execute(look).fetchall()), sql


def test_constraints_returning_and_foreign_keys(spark):
    e = Engine(spark)
    e.sql("CREATE TABLE p(id INTEGER PRIMARY KEY, n TEXT NOT NULL CHECK (length(n) > 1)); CREATE TABLE c(id INTEGER PRIMARY KEY, pid INTEGER REFERENCES p(id) ON DELETE CASCADE)")
    assert [tuple(r) for r in e.sql("INSERT INTO p(n) VALUES ('aa'), ('bb') RETURNING id, n").collect()] == [(1, "aa"), (2, "bb")]
    for bad in ("INSERT INTO p VALUES (1, 'cc')", "INSERT INTO p VALUES (3, NULL)", "INSERT INTO p VALUES (3, 'x')"):
        with pytest.raises(ConstraintError):
            e.sql(bad)
    e.sql("INSERT INTO c VALUES (1, 1), (2, 2); PRAGMA foreign_keys = ON; DELETE FROM p WHERE id = 1")
    assert [r["id"] for r in e.sql("SELECT id FROM c").collect()] == [2]


def test_parameters_pragmas_and_explain(both):
    engine, _ = both
    assert engine.sql("SELECT id FROM t WHERE g = ? AND v > ?", ["a", 1]).count() == 2
    assert engine.sql("SELECT id FROM t WHERE g = :g", {"g": "b"}).count() == 2
    assert engine.sql("PRAGMA table_info(t)").count() == 5
    assert "Scan" in "\n".join(r[0] for r in engine.sql("EXPLAIN SELECT * FROM t WHERE id = 1").collect())
    engine.sql("PRAGMA user_version = 7")
    assert engine.sql("PRAGMA user_version").first()[0] == "7"


@pytest.mark.parametrize("sql", ["SELEC 1", "SELECT FROM t", "CREATE TRIGGER x AFTER INSERT ON t BEGIN SELECT 1; END", "SELECT nosuch(1)", "SELECT * FROM missing", "SELECT 1 +"])
def test_refused(both, sql):
    with pytest.raises(SqlError):
        both[0].sql(sql)


def test_precedence():
    assert parse("SELECT 1+2*3")[0].select.cores[0].items[0][0] == ("bin", "+", ("lit", 1), ("bin", "*", ("lit", 2), ("lit", 3)))


#: Functions that the standard library's engine does not have, with the answers that the dialect states.
ANSWERS = {
    "SELECT l2_distance('[1,2]','[4,6]'), vector_distance_l2('[1,2]','[4,6]'), l1_distance('[1,2]','[4,6]'), inner_product('[1,2]','[4,6]'), vector_dot('[1,2]','[4,6]')": (5.0, 5.0, 7.0, 16.0, 16.0),
    "SELECT round(cosine_distance('[1,0]','[0,2]'), 6), vector_distance_cos('[1,0]','[2,0]'), hamming_distance('1100','1010'), jaccard_distance('1100','1010'), '1100' <~> '1111'": (1.0, 0.0, 2, 1 - 1 / 3, 2),
    "SELECT vector_norm('[3,4]'), l2_normalize('[3,4]'), binary_quantize('[1,-2,0.5]'), subvector('[1,2,3]',2,2), vector_dims('[1,2,3]')": (5.0, [0.6, 0.8], "101", [2.0, 3.0], 3),
    "SELECT vector_add('[1,2]','[3,4]'), vector_sub('[1,2]','[3,4]'), vector_mul('[1,2]','[3,4]'), vector_concat('[1]','[2]')": ([4.0, 6.0], [-2.0, -2.0], [3.0, 8.0], [1.0, 2.0]),
    "SELECT geopoly_area('[[0,0],[2,0],[2,2],[0,2],[0,0]]'), geopoly_contains_point('[[0,0],[2,0],[2,2],[0,2],[0,0]]',1,1), geopoly_overlap('[[0,0],[2,0],[2,2],[0,2],[0,0]]','[[1,1],[3,1],[3,3],[1,3],[1,1]]'), geopoly_within('[[0,0],[1,0],[1,1],[0,0]]','[[-1,-1],[5,-1],[5,5],[-1,5],[-1,-1]]')": (4.0, 2, 1, 1),
    "SELECT geopoly_bbox('[[0,0],[2,1],[1,3],[0,0]]'), geopoly_ccw('[[0,0],[0,1],[1,0],[0,0]]'), geopoly_xform('[[0,0],[1,0],[0,1],[0,0]]',2,0,0,2,1,1)": ("[[0.0,0.0],[2.0,0.0],[2.0,3.0],[0.0,3.0],[0.0,0.0]]", "[[0.0,0.0],[1.0,0.0],[0.0,1.0],[0.0,0.0]]", "[[1.0,1.0],[3.0,1.0],[1.0,3.0],[1.0,1.0]]"),
    "SELECT hex(geopoly_blob('[[0,0],[1,0],[0,1],[0,0]]')), geopoly_svg('[[0,0],[1,0],[0,1],[0,0]]','class=\"p\"'), json_array_length(geopoly_regular(0,0,1,5))": ("01000003" + "00" * 8 + "0000803F" + "00" * 8 + "0000803F", "<polyline points='0,0 1,0 0,1 0,0' class=\"p\"></polyline>", 6),
    "SELECT timediff('2023-02-15','2023-03-15'), timediff('2024-03-01 12:00:00','2024-02-28 11:00:00'), unistr('A\\0042\\u0043'), unistr_quote('a''b'), unistr_quote(NULL)": ("-0000-01-00 00:00:00.000", "+0000-00-02 01:00:00.000", "ABC", "'a''b'", "NULL"),
    "SELECT hex(unhex('41-42','-')), json_error_position('[1,2'), json_error_position('[1]'), json_valid('{a:1}', 2), json_pretty('[1]'), json_array_insert('[1,3]','$[1]',2), octet_length('é')": ("4142", 5, 0, 1, "[\n    1\n]", "[1,2,3]", 2),
    "SELECT json(jsonb('[1, 2]')), json(jsonb_set('{}','$.a',1)), json_extract(jsonb_array(1,'x'),'$[1]'), json(jsonb_object('k',2)), json(jsonb_remove('[1,2]','$[0]')), json(jsonb_patch('{}','{\"a\":1}'))": ("[1,2]", '{"a":1}', "x", '{"k":2}', "[2]", '{"a":1}'),
    "SELECT datetime('2024-05-05 10:00:00.5','subsec'), unixepoch('2024-01-01 00:00:00.25','subsec'), date('2024-01-31','+1 month','floor'), date('2024-01-31','+1 month','ceiling'), strftime('%G-%V %u %U', '2024-12-30'), strftime('%I %p %P %e','2024-02-03 15:04:05')": ("2024-05-05 10:00:00.500", 1704067200.25, "2024-02-29", "2024-03-02", "2025-01 1 52", "03 PM pm  3"),
}


@pytest.mark.parametrize("sql", ANSWERS)
def test_functions_beyond_the_library(spark, sql):
    got = Engine(spark).sql(sql).collect()[0]
    for a, b in zip(got, ANSWERS[sql], strict=True):
        assert a == (pytest.approx(b) if isinstance(b, (float, list)) else b)


def test_upsert_meets_its_own_rows(spark):
    e, db = Engine(spark), sqlite3.connect(":memory:")
    for s in ("CREATE TABLE c(k INTEGER PRIMARY KEY, n INTEGER)", "INSERT INTO c VALUES (1, 1)", "INSERT INTO c VALUES (1, 5), (2, 1), (2, 10), (2, 100), (3, 7) ON CONFLICT(k) DO UPDATE SET n = n + excluded.n"):
        e.sql(s)
        db.execute(s)
    assert rows(map(tuple, e.sql("SELECT * FROM c").collect())) == rows(db.execute("SELECT * FROM c").fetchall())


def test_digest_tells_nulls_apart(spark):
    both = [spark.createDataFrame([r], "a string, b string") for r in ((None, "a"), ("a", None))]
    one, two = (relational.digest(d).first()["digest"] for d in both)
    assert one != two


def test_dump_holds_all_rows(spark):
    c = Catalog(spark)
    c.tables["big"] = Table(spark.range(100_010))
    assert files.dump(c, "big").count("INSERT") == 100_010 == files.dump_lines(c, "big").count()
