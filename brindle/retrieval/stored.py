"""A stored keyword index: postings by a hash of their term, appended to in generations, with removals.

Layout under one path, all Parquet:

* ``postings/generation=G/bucket=B``: (id, term, tf, positions, length), sorted by term in each file;
* ``lengths/generation=G``: (id, length), one row a document;
* ``removed/generation=G``: (id) whose postings of earlier generations are dead;
* ``stats/generation=G``: one row with the change in documents and in tokens.

``stats`` is written last, and a generation without it does not exist: work
cut short is deleted by the next one.  A search reads the buckets of its
terms only.  Ids are unique in the corpus and not null; appending an id that is
there replaces it.  One writer at a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import lexical

#: Part of the format: readers prune by it.
BUCKETS = lexical.BUCKETS


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def discard(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


class StoredIndex:
    """Open the index at ``path``; it may be empty."""

    def __init__(self, spark: SparkSession, path: str, key_type: str = "bigint") -> None:
        self.spark, self.path, self.key_type = spark, path.rstrip("/"), key_type
        self.refresh()

    def refresh(self) -> None:
        """See the generations that are there now: one row each is read."""
        got = self._read("stats", "documents bigint, tokens bigint").collect()
        self.generations = sorted(r["generation"] for r in got)
        self.documents, self.tokens = sum(r["documents"] for r in got), sum(r["tokens"] for r in got)

    def _read(self, part: str, schema: str) -> DataFrame:
        whole = f"{schema}, generation int" + (", bucket int" if part == "postings" else "")
        if not exists(self.spark, f"{self.path}/{part}"):
            return self.spark.createDataFrame([], whole)
        return self.spark.read.schema(whole).parquet(f"{self.path}/{part}")

    def _write(self, rows: DataFrame, part: str, generation: int, by: list[str] | None = None) -> None:
        out = rows.write.mode("overwrite")
        (out.partitionBy(*by) if by else out).parquet(f"{self.path}/{part}/generation={generation}")

    def _live(self, part: str, schema: str) -> DataFrame:
        """The rows of all generations that no later one has removed."""
        rows = self._read(part, schema).filter(F.col("generation").isin(self.generations))
        if not exists(self.spark, f"{self.path}/removed"):
            return rows
        gone = self._read("removed", f"id {self.key_type}").filter(F.col("generation").isin(self.generations))
        gone = gone.groupBy(F.col("id").alias("__id")).agg(F.max("generation").alias("__until"))
        return rows.join(gone, (F.col("id") == F.col("__id")) & (F.col("generation") < F.col("__until")), "left_anti")

    def corpus(self) -> lexical.Corpus:
        """What the ranking functions take."""
        post = self._live("postings", f"id {self.key_type}, term string, tf bigint, positions array<int>, length int").drop("generation")
        return lexical.Corpus(post, self.documents, self.tokens / self.documents if self.documents else 1.0)

    def append(self, docs: DataFrame, key: str, tokens: Column) -> StoredIndex:
        """Add documents as one generation; those whose id is there already are replaced.

        Files of a bucket are split where a term fills them, so a frequent term is no task of its own.
        """
        return self._commit(docs.select(F.col(key).alias("id")), docs, key, tokens)

    def remove(self, ids: DataFrame) -> StoredIndex:
        """Take out the documents of these ids (id); unknown ones do nothing."""
        return self._commit(ids.select("id"))

    def _commit(self, ids: DataFrame, docs: DataFrame | None = None, key: str = "id", tokens: Column | None = None) -> StoredIndex:
        generation = max(self.generations, default=0) + 1
        documents = count = 0
        for part in ("postings", "lengths", "removed"):  # of work cut short
            discard(self.spark, f"{self.path}/{part}/generation={generation}")
        if self.generations:
            old = self._live("lengths", f"id {self.key_type}, length int").join(ids.distinct(), "id", "left_semi")
            gone = old.agg(F.count(F.lit(1)), F.coalesce(F.sum("length"), F.lit(0))).first()
            documents, count = -gone[0], -gone[1]
            if gone[0]:
                self._write(old.select("id"), "removed", generation)
        if docs is not None:
            post = lexical.entries(docs, key, tokens).withColumn("bucket", lexical.bucket_of(F.col("term")))
            self._write(post.hint("rebalance", "bucket").sortWithinPartitions("bucket", "term", "id"), "postings", generation, ["bucket"])
            self._write(docs.select(F.col(key).alias("id"), lexical.length_of(tokens).alias("length")), "lengths", generation)
            new = self.spark.read.parquet(f"{self.path}/lengths/generation={generation}").agg(F.count(F.lit(1)), F.coalesce(F.sum("length"), F.lit(0))).first()
            documents, count = documents + new[0], count + new[1]
        self._write(self.spark.createDataFrame([(documents, count)], "documents bigint, tokens bigint").coalesce(1), "stats", generation)
        self.refresh()
        return self

    def compacted(self, path: str) -> StoredIndex:
        """The same index as one generation without removals, at another path."""
        out = StoredIndex(self.spark, path, self.key_type)
        if out.generations:
            raise ValueError(f"{path} holds an index")
        post = self.corpus().post
        out._write(post.hint("rebalance", "bucket").sortWithinPartitions("bucket", "term", "id"), "postings", 1, ["bucket"])
        out._write(self._live("lengths", f"id {self.key_type}, length int").drop("generation"), "lengths", 1)
        out._write(self.spark.createDataFrame([(self.documents, self.tokens)], "documents bigint, tokens bigint").coalesce(1), "stats", 1)
        out.refresh()
        return out
