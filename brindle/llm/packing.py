"""Best-fit packing with certified bounds.

Documents are tokenized once; those longer than a sequence are cut, the first
piece being the shorter one, so that all further pieces fill a sequence each.
The other pieces are dealt to partitions of about PARTITION_PIECES and packed
by best-fit decreasing.  Dual feasible functions give a lower bound for each
partition's number of sequences.  A partition that meets its bound is
certified; the others release their sequences that have room, the released
documents are dealt anew to fewer partitions, and best-fit decreasing runs
again, for as long as that saves sequences.  A repacking that saves none is
thrown away.

Pieces are dealt by a stored row number, so that repeated and null ids are
spread like any other.

Null text counts as empty (a piece of the end id alone); repeated rows are
packed each; an empty table gives no piece.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import id_and_text, slices, stored, with_id
from .encoding import Encoder

BYTE_TOKENIZER = "byte_bpe_50k.json"
CAPACITY = 1024
#: Pieces packed by one task; sizes only, about 100 bytes each.
PARTITION_PIECES = 65_536


def cut_pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, keep_ids: bool = False) -> DataFrame:
    """(id, piece, start, length, ids_crc32[, token_ids]) of every piece of every document (id, text)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = Encoder(tokenizer), np.array([end_id], "<u4").tobytes()
        for b in slices(batches):
            rows: list[tuple] = []
            for i, text in enumerate(b.column(1)):
                raw = enc.ids(text.as_py()) + end
                n = len(raw) // 4
                first = n % capacity or min(n, capacity)
                starts = [0, *range(first, n, capacity)]
                for k, (s, e) in enumerate(zip(starts, [*starts[1:], n], strict=True)):
                    own = raw[4 * s : 4 * e]
                    rows.append((i, k, s, e - s, zlib.crc32(own), np.frombuffer(own, "<u4").astype(np.int32) if keep_ids else None))
            at, piece, start, length, crc, ids = zip(*rows, strict=True) if rows else [()] * 6
            cols = [b.column(0).take(pa.array(at, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            cols += [pa.array(ids, pa.list_(pa.int32()))] if keep_ids else []
            yield pa.RecordBatch.from_arrays(cols, names=["id", "piece", "start", "length", "ids_crc32", "token_ids"][: len(cols)])

    fields = [("piece", T.IntegerType()), ("start", T.LongType()), ("length", T.LongType()), ("ids_crc32", T.LongType())]
    fields += [("token_ids", T.ArrayType(T.IntegerType()))] if keep_ids else []
    return docs.mapInArrow(cut, with_id(docs, *fields))


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """Fewest bins for counts[s] items of size s (0..capacity), by dual feasible functions."""
    sizes = np.arange(capacity + 1)
    total = int((counts * sizes).sum())
    best = -(-total // capacity)
    big = np.cumsum(counts[::-1])[::-1]  # items of at least that size
    mass = np.cumsum(counts * sizes)
    for t in range(1, capacity // 2 + 1):
        # Items over capacity - t count as whole bins, items below t not at all.
        whole = int(big[capacity - t + 1])
        middle = int(mass[capacity - t] - mass[t - 1])
        best = max(best, whole + -(-middle // capacity))
    for k in range(1, 33):
        # Rounds sizes down to multiples of 1/k unless (k + 1) size is whole.
        up = sizes * (k + 1)
        even = up % capacity == 0
        value = int((counts * np.where(even, sizes * k, up // capacity * capacity)).sum())
        best = max(best, -(-value // (capacity * k)))
    return best


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Bin and offset of each item, and each bin's fill; lengths in descending order.

    The bins with a given room are one stack; a bit mask over the rooms finds the tightest that fits.
    """
    bins, offsets, fill = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), []
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0
    for i, n in enumerate(lengths.tolist()):
        fits = mask >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            own = open_bins[room]
            b = own.pop()
            if not own:
                mask &= ~(1 << room)
        else:
            b, room = len(fill), capacity
            fill.append(0)
        bins[i], offsets[i] = b, fill[b]
        fill[b] += n
        if room > n:
            open_bins[room - n].append(b)
            mask |= 1 << (room - n)
    return bins, offsets, fill


def pack_round(pieces: DataFrame, n: int, capacity: int, round_no: int) -> DataFrame:
    """pieces (row, length) with sequence_id, offset and released: whether their bin has room and their partition a gap."""
    parts = max(1, -(-n // PARTITION_PIECES))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        t = pa.Table.from_batches(got).sort_by([("length", "descending"), ("row", "ascending")])
        lengths = t.column("length").to_numpy()
        bins, offsets, fill = best_fit(lengths, capacity)
        gap = len(fill) > lower_bound(np.bincount(lengths, minlength=capacity + 1), capacity)
        roomy = np.array(fill) < capacity
        first = (round_no << 48) + (TaskContext.get().partitionId() << 24)
        t = t.append_column("sequence_id", pa.array(first + bins)).append_column("offset", pa.array(offsets)).append_column("released", pa.array(roomy[bins] & gap))
        yield from t.combine_chunks().to_batches(max_chunksize=65_536)

    schema = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType()), T.StructField("released", T.BooleanType())])
    dealt = pieces.repartition(parts, F.xxhash64("row", F.lit(round_no)))
    return stored(dealt.mapInArrow(pack, schema), "packed")


def place(pieces: DataFrame, capacity: int, rounds: int | None = None) -> DataFrame:
    """pieces with sequence_id and offset added; pieces: row (a number of its own), length (capacity at most) and what travels with them.

    Without ``rounds`` until a repacking saves nothing: each that is kept has fewer sequences than it was given.
    """
    count = lambda df: df.agg(F.count(F.lit(1)), F.count_distinct("sequence_id")).first()
    packed = pack_round(pieces, pieces.count(), capacity, 1)
    done: list[DataFrame] = []
    for r in itertools.count(2):
        loose = packed.filter("released")
        n, before = count(loose)
        if (rounds is not None and r > rounds) or n == 0 or before < 2:
            break
        again = pack_round(loose.drop("sequence_id", "offset", "released"), n, capacity, r)
        if count(again)[1] >= before:
            break
        done.append(packed.filter("not released"))
        packed = again
    return reduce(DataFrame.unionByName, [*done, packed]).drop("released")


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = BYTE_TOKENIZER, end_id: int = 2, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset[, token_ids]) of every piece.

    A piece's few numbers travel through the packing with it; its token ids stay where they are until its place is known.
    """
    cut = cut_pieces(id_and_text(docs, id_col, text_col), tokenizer, end_id, capacity, keep_ids)
    cut = stored(cut.withColumn("row", F.monotonically_increasing_id()), "pieces")
    full = cut.filter(F.col("length") == capacity).withColumns({"sequence_id": -1 - F.col("row"), "offset": F.lit(0).cast("long")})
    rows = cut.filter(F.col("length") < capacity)
    names = ["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    if not keep_ids:
        return place(rows, capacity).unionByName(full).select(*names)
    placed = place(rows.select("row", "length"), capacity).select("row", "sequence_id", "offset")
    return rows.join(placed, "row").unionByName(full).select(*names, "token_ids")


def certificate(packed: DataFrame, capacity: int = CAPACITY) -> dict[str, int]:
    """The number of sequences and a lower bound for it over all pieces together."""
    counts = np.zeros(capacity + 1, np.int64)
    for r in packed.groupBy("length").count().collect():  # at most capacity rows
        counts[r["length"]] = r["count"]
    return {"sequences": packed.select("sequence_id").distinct().count(), "bound": lower_bound(counts, capacity)}


def op7_packing(docs: DataFrame) -> DataFrame:
    return pack_documents(docs).withColumnRenamed("id", "doc_id")
