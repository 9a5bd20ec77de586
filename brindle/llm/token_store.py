"""Token ids in files: one shared zstandard dictionary, one frame for each document.

The store is a folder of Parquet files, so that Spark's writers commit it and
any shared file system holds it:

* ``dictionary``: one row (dict_hash, dict_bytes);
* ``blobs``: rows of about BLOB_BYTES in ascending id order, each with its
  documents' frames one after another, their offsets, lengths and token counts,
  the first and last id (for pruning by file statistics) and dict_hash.

Ids are serialized as little-endian unsigned 16-bit integers where the
vocabulary allows it and 32-bit ones otherwise; each document is compressed
alone with the shared dictionary, so that reading a short document decompresses
that document only.  The dictionary is trained on a bounded sample, documented
at SAMPLE_DOCS; every document is encoded and stored.  A sample below 4 KB gives
no dictionary, one on which training fails gives its own last bytes as a raw
dictionary; the store says which by the bytes it holds.

Null text counts as empty (a document of the end id alone), null ids come
first, rows with the same id follow each other in any order, an empty table
gives an empty store.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard as zstd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import id_and_text, partitions_for, shared_path, with_id
from .encoding import Encoder

WORD_TOKENIZER = "word_bpe_49k.json"
#: The dictionary's sample: the documents of the smallest id hash, cut in
#: slices, of which again those of the smallest hash.
SAMPLE_DOCS, SAMPLE_SLICES, SLICE_IDS = 1024, 2048, 1024
DICT_BYTES = 64 << 10
BLOB_BYTES = 2 << 20
LEVEL = 3


def id_width(tokenizer: str) -> str:
    return "<u2" if max(Encoder(tokenizer).tok.get_vocab().values()) < 1 << 16 else "<u4"


def train_dictionary(docs: DataFrame, tokenizer: str, width: str) -> bytes:
    """Zstandard dictionary bytes; empty where the sample is too small to train on."""
    ids = docs.select("id").orderBy(F.xxhash64("id"), "id").limit(SAMPLE_DOCS).dropDuplicates(["id"])
    sample = docs.join(F.broadcast(ids), "id")  # ids: at most SAMPLE_DOCS

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder(tokenizer)
        for b in batches:
            for text in b.column(1).to_pylist():
                raw = np.frombuffer(enc.ids(text), "<u4").astype(width)
                cut = [raw[i : i + SLICE_IDS].tobytes() for i in range(0, len(raw), SLICE_IDS)]
                yield pa.RecordBatch.from_arrays([pa.array(cut, pa.binary())], names=["slice"])

    rows = sample.mapInArrow(slices, "slice binary").orderBy(F.xxhash64("slice"), "slice").limit(SAMPLE_SLICES).collect()
    parts = [bytes(r["slice"]) for r in rows if r["slice"]]
    if sum(map(len, parts)) < 4 * 1024:
        return b""
    size = min(DICT_BYTES, sum(map(len, parts)) // 8)
    try:
        return zstd.train_dictionary(size, parts).as_bytes()
    except zstd.ZstdError:
        return b"".join(parts)[-size:]


def dictionary(raw: bytes) -> zstd.ZstdCompressionDict | None:
    return zstd.ZstdCompressionDict(raw) if raw else None


def write_store(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = WORD_TOKENIZER, end_id: int = 1) -> None:
    """Encode every text, append end_id and write the store at path."""
    spark, rows = docs.sparkSession, id_and_text(docs, id_col, text_col)
    width = id_width(tokenizer)
    raw = train_dictionary(rows, tokenizer, width)
    dict_hash = hashlib.sha256(raw).hexdigest()
    spark.createDataFrame([(dict_hash, width, raw)], "dict_hash string, width string, dict_bytes binary").coalesce(1).write.parquet(f"{path}/dictionary")

    def blobs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = Encoder(tokenizer), np.array([end_id], "<u4").tobytes()
        shared = dictionary(raw)
        comp = zstd.ZstdCompressor(level=LEVEL, dict_data=shared) if shared else zstd.ZstdCompressor(level=LEVEL)
        part, number, before = TaskContext.get().partitionId(), 0, 0
        ids, frames, counts, size = [], [], [], 0

        def blob() -> pa.RecordBatch:
            lengths = list(map(len, frames))
            starts = np.cumsum([0, *lengths[:-1]]).tolist()
            row = {"first_id": ids[0], "last_id": ids[-1], "part": part, "number": number, "before": before, "tokens": sum(counts), "ids": ids, "counts": counts, "offsets": starts, "lengths": lengths, "blob": b"".join(frames), "dict_hash": dict_hash}
            return pa.RecordBatch.from_pylist([row], schema=arrow)

        kind = None
        for b in batches:
            if kind is None:
                kind = b.schema.field(0).type
                long = pa.list_(pa.int64())
                arrow = pa.schema([("first_id", kind), ("last_id", kind), ("part", pa.int32()), ("number", pa.int32()), ("before", pa.int64()), ("tokens", pa.int64()), ("ids", pa.list_(kind)), ("counts", long), ("offsets", long), ("lengths", long), ("blob", pa.binary()), ("dict_hash", pa.string())])
            for key, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                own = np.frombuffer(enc.ids(text.as_py()) + end, "<u4")
                frames.append(comp.compress(own.astype(width).tobytes()))
                ids.append(key)
                counts.append(len(own))
                size += len(frames[-1])
                if size >= BLOB_BYTES:
                    yield blob()
                    number, before = number + 1, before + sum(counts)
                    ids, frames, counts, size = [], [], [], 0
        if ids:
            yield blob()

    key, longs = rows.schema["id"].dataType, T.ArrayType(T.LongType())
    schema = T.StructType(
        [T.StructField("first_id", key), T.StructField("last_id", key), T.StructField("part", T.IntegerType()), T.StructField("number", T.IntegerType()), T.StructField("before", T.LongType()), T.StructField("tokens", T.LongType()), T.StructField("ids", T.ArrayType(key)), T.StructField("counts", longs), T.StructField("offsets", longs), T.StructField("lengths", longs), T.StructField("blob", T.BinaryType()), T.StructField("dict_hash", T.StringType())]
    )
    # Rows of one id, null included, are spread over as many ranges as they need.
    order = [F.col("id").asc_nulls_first(), F.col("spread")]
    ordered = rows.withColumn("spread", F.xxhash64("text", F.monotonically_increasing_id())).repartitionByRange(partitions_for(docs), *order).sortWithinPartitions(*order)
    ordered.select("id", "text").mapInArrow(blobs, schema).write.parquet(f"{path}/blobs")


def open_store(spark: SparkSession, path: str) -> tuple[DataFrame, bytes, str]:
    """The blobs, the dictionary (its hash verified) and the width of an id."""
    told = spark.read.parquet(f"{path}/dictionary").first()
    raw = bytes(told["dict_bytes"])
    if hashlib.sha256(raw).hexdigest() != told["dict_hash"]:
        raise ValueError(f"{path}: the dictionary does not have its hash")
    return spark.read.parquet(f"{path}/blobs").filter(F.col("dict_hash") == told["dict_hash"]), raw, told["width"]


def read_document(spark: SparkSession, path: str, key: object) -> list[list[int]]:
    """The ids of the documents with this id: prunes by statistics, decompresses their frames only."""
    blobs, raw, width = open_store(spark, path)
    shared = dictionary(raw)
    dec = zstd.ZstdDecompressor(dict_data=shared) if shared else zstd.ZstdDecompressor()
    # Null ids stand first, so a blob that begins with one may hold any key up to its last.
    hit = blobs.filter((F.col("first_id").isNull() | (F.col("first_id") <= F.lit(key))) & (F.col("last_id") >= F.lit(key)))
    at = hit.select("blob", F.explode(F.arrays_zip("ids", "offsets", "lengths")).alias("d")).filter(F.col("d.ids") == F.lit(key))
    frames = at.select(F.expr("substring(blob, cast(d.offsets + 1 as int), cast(d.lengths as int))").alias("frame")).collect()
    return [np.frombuffer(dec.decompress(bytes(r["frame"])), width).tolist() for r in frames]


def read_store(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """(id, start, n_tokens, ids_crc32[, ids]) of every document, from the files."""
    blobs, raw, width = open_store(spark, path)
    # A row for each partition of the writer; their number is that of its tasks.
    totals = blobs.groupBy("part").agg(F.sum("tokens").alias("part_tokens"))
    w = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    places = totals.select("part", F.coalesce(F.sum("part_tokens").over(w), F.lit(0)).cast("long").alias("part_start"))
    placed = blobs.join(F.broadcast(places), "part").select((F.col("part_start") + F.col("before")).alias("start"), "ids", "counts", "offsets", "lengths", "blob")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared = dictionary(raw)
        dec = zstd.ZstdDecompressor(dict_data=shared) if shared else zstd.ZstdDecompressor()
        for b in batches:
            for i in range(b.num_rows):
                start, ids, counts, offsets, lengths, blob = (b.column(k)[i] for k in range(6))
                blob, at, crcs, real = blob.as_py(), start.as_py(), [], []
                starts = (at + np.cumsum([0, *counts.as_py()[:-1]])).tolist()
                for o, n in zip(offsets.as_py(), lengths.as_py(), strict=True):
                    own = np.frombuffer(dec.decompress(blob[o : o + n]), width).astype("<u4")
                    crcs.append(zlib.crc32(own.tobytes()))
                    if with_ids:
                        real.append(own.astype(np.int64))
                cols = [ids.values, pa.array(starts, pa.int64()), pa.array(counts.as_py(), pa.int64()), pa.array(crcs, pa.int64())]
                cols += [pa.array(real, pa.list_(pa.int64()))] if with_ids else []
                yield pa.RecordBatch.from_arrays(cols, names=["id", "start", "n_tokens", "ids_crc32", "token_ids"][: len(cols)])

    key = blobs.schema["ids"].dataType.elementType
    fields = [("start", T.LongType()), ("n_tokens", T.LongType()), ("ids_crc32", T.LongType())]
    fields += [("token_ids", T.ArrayType(T.LongType()))] if with_ids else []
    return placed.mapInArrow(read, T.StructType([T.StructField("id", key), *(T.StructField(n, t) for n, t in fields)]))


def op4_token_store(docs: DataFrame) -> DataFrame:
    path = shared_path(docs.sparkSession, "token-store")
    write_store(docs, path)
    return read_store(docs.sparkSession, path).withColumnRenamed("id", "doc_id")
