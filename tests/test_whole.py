"""Registered queries that do the whole job: recall at the registered setting, all rows, whole texts."""

import re

import oracle
import pytest
from pyspark.sql import functions as F

from brindle.queries import ORACLE_SQL, QUERIES
from brindle.queries.registry import table
from brindle.retrieval import ranking as K


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_inverted_file_recall_at_the_registered_setting(spark, sf):
    path = f"/root/testdata/{sf}"
    e = table(spark, path, "embeddings")
    queries = e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    pairs = lambda df: {tuple(r) for r in df.select("query_id", "id").collect()}
    want = pairs(K.batch_search(e, "vec_id", "embedding", queries, 10))
    got = pairs(QUERIES["inverted_file_batch_search"](spark, path))
    assert len(want) == 10 * queries.count() and len(got & want) / len(want) >= 0.9


def test_highlight_marks_whole_texts_of_every_document(spark):
    path = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in table(spark, path, "documents").collect()}

    def marked(text):
        out, at = [], 0
        for m in re.finditer("[a-zA-Z0-9]+", text):
            out += [text[at : m.start()], f"[{m[0]}]" if m[0].lower() in ("the", "und") else m[0]]
            at = m.end()
        return "".join(out) + text[at:]

    got = {r["doc_id"]: r["h"] for r in QUERIES["highlight_whole"](spark, path).collect()}
    assert got == {k: x if x is None else marked(x) for k, x in texts.items()}
    assert any(x and marked(x)[:400] == x[:400] and marked(x) != x for x in texts.values())  # marks after the first 400 characters


@pytest.mark.parametrize("name", ["lateral_json_each_whole", "lateral_json_tree_whole", "sql_window_filter_whole", "bit_operations_whole", "recursive_union_whole"])
def test_whole_tables_agree_with_sql(spark, name):
    path = "/root/testdata/sf0.01"
    assert oracle.differences(QUERIES[name](spark, path), ORACLE_SQL[name], oracle.connect(path)) == []


@pytest.mark.parametrize("name, source, key", [("lateral_json_each_whole", "events", "event_id"), ("lateral_json_tree_whole", "events", "event_id"), ("sql_window_filter_whole", "events", "event_id"), ("bit_operations_whole", "orders", "o_orderkey")])
def test_whole_tables_have_all_rows(spark, name, source, key):
    path = "/root/testdata/sf0.001"
    rows = table(spark, path, source)
    if name.startswith("lateral"):
        rows = rows.filter("json_object_keys(props)[0] IS NOT NULL")
    assert QUERIES[name](spark, path).select(key).distinct().count() == rows.select(key).distinct().count()
