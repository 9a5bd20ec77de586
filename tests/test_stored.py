"""The stored keyword index and stored inverted lists: append equals rebuild, searches read only their folders."""

import random
import shutil

import pytest
from pyspark.sql import functions as F

from brindle.retrieval import lexical as L
from brindle.retrieval import ranking as K
from brindle.retrieval import tokenize
from brindle.retrieval.stored import StoredIndex

WORDS = ["the", "red", "fox", "ran", "über", "hill", "far", "a1"]


def tokens():
    return tokenize.plain(F.col("t"))


def rows(spark, texts):
    return spark.createDataFrame(list(texts.items()), "id long, t string")


def ranks(c, terms):
    return {r["id"]: (round(r["score"], 9), r["matched"]) for r in L.bm25(c, terms).collect()}


@pytest.fixture
def texts():
    rng = random.Random(3)
    made = {i: " ".join(["the"] * (i % 3) + rng.choices(WORDS, k=rng.randrange(12))) for i in range(60)}
    return made | {60: "", 61: None, 62: "fox " * 5000}


def test_appends_removals_and_replacements_equal_a_rebuild(spark, tmp_path, texts):
    index = StoredIndex(spark, str(tmp_path / "i"))
    assert index.documents == 0 and ranks(index.corpus(), ["fox"]) == {}
    index.append(rows(spark, {k: "fox the the old" for k in range(0, 30)}), "id", tokens())
    index.append(rows(spark, {k: v for k, v in texts.items() if k >= 10}), "id", tokens())
    index.remove(spark.createDataFrame([(k,) for k in (*range(0, 15), 60, 62, 999)], "id long"))
    index.append(rows(spark, {k: v for k, v in texts.items() if k < 15 or k in (60, 62)}), "id", tokens())
    index.append(rows(spark, {}), "id", tokens())
    want = L.Corpus.of(rows(spark, texts), "id", tokens())
    for own in (index.corpus(), StoredIndex(spark, index.path).corpus(), index.compacted(str(tmp_path / "c")).corpus()):
        assert own.n == want.n
        assert ranks(own, ["the", "fox", "über", "nowhere"]) == ranks(want, ["the", "fox", "über", "nowhere"])
        for e in ('"the red" OR fo*', "NEAR(the hill, 3) NOT far"):
            assert sorted(L.match(own.post, e).collect()) == sorted(L.match(want.post, e).collect())


def test_work_cut_short_leaves_nothing(spark, tmp_path, texts):
    index = StoredIndex(spark, str(tmp_path / "i")).append(rows(spark, texts), "id", tokens())
    before = ranks(index.corpus(), ["fox"])
    index.append(rows(spark, {1: "fox fox", 99: "fox"}), "id", tokens())
    shutil.rmtree(tmp_path / "i" / "stats" / "generation=2")  # as if the writer had been lost before its last step
    index.refresh()
    assert ranks(index.corpus(), ["fox"]) == before
    index.remove(spark.createDataFrame([(0,)], "id long"))
    assert ranks(index.corpus(), ["the", "fox"]) == ranks(L.Corpus.of(rows(spark, {k: v for k, v in texts.items() if k}), "id", tokens()), ["the", "fox"])


def test_a_search_reads_the_buckets_of_its_terms(spark, tmp_path, texts):
    c = StoredIndex(spark, str(tmp_path / "i")).append(rows(spark, texts), "id", tokens()).corpus()
    found = L.of_terms(c.post, ["fox"])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "In(term" in plan or "EqualTo(term,fox)" in plan
    assert {f.split("bucket=")[1].split("/")[0] for f in found.select(F.input_file_name()).distinct().toPandas().iloc[:, 0]} == {str(spark.range(1).select(L.bucket_of(F.lit("fox"))).first()[0])}
    partitions = plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "bucket" in partitions


def test_stored_lists(spark, tmp_path):
    e = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    path = str(tmp_path / "v")
    K.InvertedFile(e.filter("vec_id % 4 <> 0"), "vec_id", "embedding", lists=8, path=path).append(e.filter("vec_id % 4 = 0"), "vec_id", "embedding")
    index = K.InvertedFile.open(spark, path)
    assert index.assigned.count() == e.count()
    queries = e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    pairs = lambda df: {tuple(r) for r in df.select("query_id", "id").collect()}
    assert pairs(index.batch_search(queries, 5, probes=8)) == pairs(K.batch_search(e, "vec_id", "embedding", queries, 5))
    q = list(e.first()["embedding"])
    assert [r["id"] for r in index.search(q, 5, probes=8).collect()] == [r["id"] for r in K.exact_search(e, "vec_id", "embedding", q, 5).collect()]
    assert "list" in index.search(q, 5, probes=2)._jdf.queryExecution().executedPlan().toString().split("PartitionFilters: [")[1].split("]")[0]
