"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import re
import shutil
import sys
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The white space of the contracts: [\x20\x09-\x0D].
ASCII_SPACE = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    ``spark.checkpoint.dir`` names it on a cluster.  Where it is unset and all
    runs in this process, as in tests, a temporary folder is made and removed
    at exit; executors elsewhere would not see that, so there it is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="brindle-")
        atexit.register(shutil.rmtree, root, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


#: The paths that the open scopes have written, the innermost last.
_scopes: list[list[str]] = []


def shared_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].append(path)
    return path


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What is stored inside goes at the end: use it around work whose result is itself written."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def stored(df: DataFrame, label: str, path: str | None = None) -> DataFrame:
    """Write df to the shared folder and read it back, which cuts its lineage.

    A lost executor then costs a reread of files and not a recomputation.
    """
    spark = df.sparkSession
    path = path or shared_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions_for(df: DataFrame, bytes_each: int = 128 << 20) -> int:
    """Shuffle partitions for df by the size of the files it reads, the session's number at least (and where it reads none)."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    told = sum(s for s in sizes if s < 1 << 60)  # a plan without files states the largest number
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-told // bytes_each))


#: A set of row keys up to this number may be broadcast: about 150 bytes each.
BROADCAST_KEYS = 100_000


#: Rows that a function over Arrow batches works on at a time: Spark's batches hold ten times as many, and their copies as Python objects weigh several times their bytes.
SLICE_ROWS = 1_000


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of the batches, SLICE_ROWS at a time."""
    for b in batches:
        for at in range(0, b.num_rows, SLICE_ROWS):
            yield b.slice(at, SLICE_ROWS)


def forget_pieces() -> None:
    """Drop the token ids that encoding remembers in this worker process, which may run other work for long."""
    sys.modules.pop("_brindle_pieces", None)


def is_small(keys: DataFrame) -> bool:
    return keys.count() <= BROADCAST_KEYS


def without_rows(df: DataFrame, key: str, out: DataFrame, repeated: DataFrame | None = None) -> DataFrame:
    """df without the rows whose key is in out, and with one row of each key in repeated (both: stored, one column, distinct).

    Sets of a checked size are broadcast, so that the texts stay where they are; larger ones are joined by a shuffle.
    """
    few = repeated is not None and not repeated.isEmpty()
    gone = out.unionByName(repeated) if few else out
    kept = df.join(F.broadcast(gone) if is_small(gone) else gone, key, "left_anti")
    if not few:
        return kept
    again = df.join(F.broadcast(repeated) if is_small(repeated) else repeated, key, "left_semi")
    one = again.groupBy(key).agg(*(F.first(c).alias(c) for c in df.columns if c != key)).select(*df.columns)
    return kept.unionByName(one)


def id_and_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The two columns an operator reads, as ``id`` and ``text`` (null text: empty)."""
    return df.select(df[id_col].alias("id"), F.coalesce(df[text_col].cast("string"), F.lit("")).alias("text"))


def with_id(df: DataFrame, *fields: tuple[str, T.DataType]) -> T.StructType:
    """A schema: the type of df's ``id`` followed by further fields."""
    return T.StructType([T.StructField("id", df.schema["id"].dataType), *(T.StructField(n, t) for n, t in fields)])


def unused(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that df does not have."""
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


def fold(id_col: Column, modulus: int) -> Column:
    """crc32 of the id as text, mod modulus (null ids: null)."""
    return F.crc32(id_col.cast("string").cast("binary")) % modulus


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, keep: Column, bound: int) -> DataFrame:
    """At most ``bound`` labelled rows as (id, text, y): those of the smallest hash of the id.

    Of several labels of an id the largest counts, of several texts that of the
    smallest hash.  Only ids and labels are sorted; their number is bounded, so
    they may be broadcast to the documents.
    """
    chosen = (
        labels.filter(labels[label_col].isNotNull() & labels[id_col].isNotNull() & keep)
        .groupBy(labels[id_col].alias("id"))
        .agg(F.max(labels[label_col].cast("int")).alias("y"))
        .orderBy(F.xxhash64("id"), "id")
        .limit(bound)
    )
    rows = id_and_text(docs, id_col, text_col).join(F.broadcast(chosen), "id")
    return rows.groupBy("id", "y").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("id", "text", "y")
