"""Benchmark decontamination by spaced-seed hashing.

A text is a sequence of tokens: maximal runs of letters and digits, lower-cased;
a character of a script that is written without spaces is a token of its own.
Each fixed mask covers a few tokens and may ignore some of them, so a window
still hits after substitutions at ignored positions.  An item contaminates a
document if at one alignment a run of tokens has at least MIN_TOKENS equal
tokens (of a shorter item, the share MIN_IDENTITY of its tokens) and at least
MIN_IDENTITY of the run's tokens are equal.

1. Benchmark items become a table of seeds: (hash of a window under a mask,
   item, offset).  The hashes also set bits of a bitmap, of which the size is
   bounded by MAX_BITS whatever the benchmark's size.
2. One scan of the documents hashes every window under every mask.  Windows in
   the bitmap that lie close together make up a passage: its token hashes and
   hits.  A run that meets the criterion holds one of at most LONGEST tokens
   that does, and that one holds ``least_hits`` seeds whatever is substituted,
   so passages with fewer hits in reach of each other are no loss.
3. The hits are joined with the seeds on the hash, counted for each alignment,
   and alignments with fewer than ``least_hits`` are dropped.
4. What is left is verified: the run is found exactly.  With +1 for an equal
   token and -PRICE for a different one, a run has the identity if its sum is
   not negative.

Only passages are shuffled, not texts; no step holds the benchmark, except that
tables of a checked size are broadcast.  Items below SHORTEST tokens prove
nothing and are left out.  Not detected are passages with inserted or left out
tokens, unless a run between them suffices.

Null and empty texts are clean.  Every row is judged alone, so repeated rows
and repeated or null ids make no difference; benchmark rows with the same text
count as one item, that of the smallest id (null last).  Further columns of
either table play no part, whatever their names.  Very long texts are scanned
CHUNK tokens at a time.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import id_and_text, stored, unused, with_id, without_rows

MIN_TOKENS, MIN_IDENTITY = 13, 0.8
#: The equal tokens that make up for a different one at MIN_IDENTITY.
PRICE = round(MIN_IDENTITY / (1 - MIN_IDENTITY))
SHORTEST = 5
#: 1: the token counts, 0: it is ignored.  Together they cover every run that meets the criterion: SHORT_MASKS of items of SHORTEST tokens, MASKS of longer ones.
MASKS, SHORT_MASKS = ("1111", "11011"), ("111", "1101")
#: Tokens of the longest run that meets the criterion and holds no shorter one that does: a run of twice
#: MIN_TOKENS equal tokens or more can be cut so that both halves have MIN_TOKENS, and one has the identity.
LONGEST = (2 * MIN_TOKENS - 1) * (PRICE + 1) // PRICE
#: The bitmap has BITS_A_SEED bits for each seed, MAX_BITS (as a power of two) at most: 32 MB.
BITS_A_SEED, MAX_BITS = 256, 28
#: Tokens that are hashed at a time, and words whose hash a task remembers.
CHUNK, MEMORY = 1 << 18, 200_000
#: Seeds, or tokens of items, that may be broadcast: at most about 20 MB.
BROADCAST_SEEDS, BROADCAST_TOKENS = 200_000, 1_000_000

TOKEN = re.compile(r"[^\W_]+")
#: Scripts that are written without spaces: kana, ideographs, Thai, Lao, Burmese, Khmer.
WIDE = "぀-ヿ㐀-䶿一-鿿豈-﫿฀-໿က-႟ក-៿\U00020000-\U0003ffff"
ANY_WIDE, MIXED_TOKEN = re.compile(f"[{WIDE}]"), re.compile(rf"(?=[^\W_])[{WIDE}]|[^\W_{WIDE}]+")
#: Odd multipliers of a multiplicative hash, two for each position of a window.
FACTORS = [(0x9E3779B97F4A7C15 * (2 * i + 1)) % 2**64 for i in range(2 * max(map(len, MASKS)))]


def tokens(text: str) -> list[str]:
    low = text.lower()
    return (TOKEN if low.isascii() or not ANY_WIDE.search(low) else MIXED_TOKEN).findall(low)


def numbers(words: list[str], known: dict[str, bytes]) -> bytes:
    """The 64-bit hash of each word, joined; ``known`` remembers MEMORY of them."""
    got = list(map(known.get, words))
    if None in got:
        for i, b in enumerate(got):
            if b is None:
                got[i] = xxhash.xxh3_64_digest(words[i].encode("utf-8", "surrogatepass"))
                if len(known) < MEMORY and len(words[i]) <= 40:
                    known[words[i]] = got[i]
    return b"".join(got)


def windows(x: np.ndarray, mask: str) -> np.ndarray:
    """The hash of the window under the mask that begins at each token, as far as windows are whole."""
    n = max(0, len(x) - len(mask) + 1)
    h = np.full(n, FACTORS[-1 - len(mask)] ^ int(mask, 2), np.uint64)
    for i, c in enumerate(mask):
        if c == "1":
            h += (x[i : i + n] ^ np.uint64(FACTORS[i])) * np.uint64(FACTORS[len(FACTORS) // 2 + i])
    h ^= h >> np.uint64(31)
    return h * np.uint64(0x94D049BB133111EB)


def needed(n: int) -> int:
    """The equal tokens that an item of n tokens asks for."""
    return min(MIN_TOKENS, math.ceil(MIN_IDENTITY * n))


def masks_of(n: int) -> tuple[str, ...]:
    """The masks under which an item of n tokens is hashed."""
    return MASKS if n > SHORTEST else SHORT_MASKS


@lru_cache(maxsize=None)
def least_hits(n: int) -> int:
    """The fewest seeds in a run of at most LONGEST tokens that meets the criterion for an item of n tokens, over all such runs."""
    if n > LONGEST:
        return least_hits(LONGEST)
    masks, need = masks_of(n), needed(n)
    width = max(map(len, masks))
    fewest, best = {("", 0, 0): 0}, n * len(masks)  # by the last tokens (1: equal) and how many are equal and different so far
    for _ in range(n):
        longer: dict[tuple[str, int, int], int] = {}
        for (last, e, d), h in fewest.items():
            for b in "01":
                own = last + b
                hits = h + sum(len(own) >= len(m) and all(x <= y for x, y in zip(m, own[-len(m) :], strict=True)) for m in masks)
                key = own[1 - width :], e + (b == "1"), d + (b == "0")
                longer[key] = min(hits, longer.get(key, hits))
        fewest = longer
        best = min([best, *(h for (_, e, d), h in fewest.items() if e >= need and e >= PRICE * d)])
    return best


def best_run(equal: np.ndarray) -> tuple[int, int, int]:
    """(start, end, equal tokens) of the run with most equal tokens among those of MIN_IDENTITY.

    For each start, the last end whose prefix sum is not below that of the start.
    """
    score = np.concatenate([[0], np.cumsum(np.where(equal, 1, -PRICE))])
    same = np.concatenate([[0], np.cumsum(equal)])
    later = np.maximum.accumulate(score[::-1])[::-1]  # the largest sum from here on: falls, or stays
    ends = np.searchsorted(-later, -score, "right") - 1
    start = int((same[ends] - same).argmax())
    n = int(same[ends[start]] - same[start])
    if not n:
        return 0, 0, 0
    on = np.flatnonzero(equal[start : ends[start]])  # different tokens at the ends do not belong to the run
    return start + int(on[0]), start + int(on[-1]) + 1, n


def items_of(benchmark: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item, id, toks, n) of the distinct benchmark texts of SHORTEST tokens and more."""
    rows = id_and_text(benchmark, id_col, text_col).filter("text <> ''")
    distinct = rows.groupBy("text").agg(F.min("id").alias("id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, bytes] = {}
        for b in batches:
            toks = [np.frombuffer(numbers(tokens(t.as_py()), known), ">u8").astype("<u8").view("<i8") for t in b.column(1)]
            keep = [i for i, x in enumerate(toks) if len(x) >= SHORTEST]
            own = [toks[i] for i in keep]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keep, pa.int64())), pa.array(own, pa.list_(pa.int64())), pa.array([len(x) for x in own], pa.int32())], names=["id", "toks", "n"])

    found = distinct.select("id", "text").mapInArrow(run, with_id(distinct, ("toks", T.ArrayType(T.LongType())), ("n", T.IntegerType())))
    return stored(found.withColumn("item", F.monotonically_increasing_id()), "benchmark-items")


def seeds_of(items: DataFrame) -> DataFrame:
    """(h, item, at, least): each window of each item, and the hits that the item asks for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for item, toks in zip(b.column(0), b.column(1), strict=True):
                x = toks.values.to_numpy().view(np.uint64)
                found = [windows(x, m) for m in masks_of(len(x))]
                h, at = np.concatenate(found), np.concatenate([np.arange(len(f)) for f in found])
                own = [np.full(len(h), v) for v in (item.as_py(), least_hits(len(x)))]
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(own[0], pa.int64()), pa.array(at, pa.int32()), pa.array(own[1], pa.int32())], names=["h", "item", "at", "least"])

    return stored(items.select("item", "toks").mapInArrow(run, "h long, item long, at int, least int"), "benchmark-seeds")


def bitmap(seeds: DataFrame, n: int) -> tuple[np.ndarray, int]:
    """Bytes with two bits set for each hash, and the number of bits as a power of two; built by Spark, 4 KB a row."""
    power = min(MAX_BITS, max(16, (BITS_A_SEED * n).bit_length()))
    both = F.array(F.shiftrightunsigned("h", 64 - power), F.col("h").bitwiseAND(F.lit((1 << power) - 1)))
    places = seeds.select(F.explode(both).alias("p")).select((F.col("p") + 1).alias("p"))
    rows = places.groupBy(F.bitmap_bucket_number("p").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits")).collect()
    out = np.zeros(1 << power >> 3, np.uint8)
    for r in rows:
        part = np.frombuffer(bytes(r["bits"]), np.uint8)
        at = (r["bucket"] - 1) * len(part)
        out[at : at + len(part)] = part[: len(out) - at]
    return out, power


def hits_in(x: np.ndarray, masks: tuple[str, ...], bits: np.ndarray, power: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the windows that are in the bitmap, by place."""
    places, hashes = [], []
    for m in masks:
        h = windows(x, m)
        at = np.arange(len(h))
        for p in (lambda h: h >> np.uint64(64 - power), lambda h: h & np.uint64((1 << power) - 1)):
            k = p(h)
            on = (bits[k >> np.uint64(3)] >> (k & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
            at, h = at[on], h[on]
        places.append(at)
        hashes.append(h)
    at, h = np.concatenate(places), np.concatenate(hashes)
    order = np.argsort(at, kind="stable")
    return at[order], h[order]


def close(at: np.ndarray, k: int) -> np.ndarray:
    """Which of the sorted places are among k within LONGEST tokens."""
    live = np.zeros(len(at), bool)
    for i in np.flatnonzero(at[k - 1 :] - at[: len(at) - k + 1] < LONGEST) if len(at) >= k else ():
        live[i : i + k] = True
    return live


def passages_of(x: np.ndarray, ends: np.ndarray, masks: tuple[str, ...], k: int, bits: np.ndarray, power: int) -> Iterator[tuple[int, int, int, np.ndarray, np.ndarray]]:
    """(text, first token, end token, places of hits, hashes) of texts whose tokens are joined in x and end at ``ends``."""
    at, h = hits_in(x, masks, bits, power)
    own = np.searchsorted(ends, at, "right")
    for d in np.unique(own).tolist():
        lo, hi = np.searchsorted(own, [d, d + 1])
        live = close(at[lo:hi], k)
        if not live.any():
            continue
        begin, end = int(ends[d - 1]) if d else 0, int(ends[d])
        a, g = at[lo:hi][live], h[lo:hi][live]
        cuts = np.flatnonzero(np.diff(a) >= 2 * LONGEST) + 1
        for part, hashes in zip(np.split(a, cuts), np.split(g, cuts), strict=True):
            yield d, max(begin, int(part[0]) - LONGEST + 1), min(end, int(part[-1]) + LONGEST), part, hashes


def scan(rows: DataFrame, masks: tuple[str, ...], k: int, bits: np.ndarray, power: int) -> DataFrame:
    """(id, text_sha, row, first, toks, hits) of every passage of rows (id, text): the token it begins at, its token hashes, its hits (h, at)."""
    raw = bits.tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, bytes] = {}
        table = np.frombuffer(raw, np.uint8)
        kind = pa.list_(pa.struct([("h", pa.int64()), ("at", pa.int32())]))
        names = ["id", "text_sha", "nth", "first", "toks", "hits"]

        def told(b: pa.RecordBatch, chunk: list[tuple[int, int, bytes]], nth: int) -> pa.RecordBatch | None:
            x = np.frombuffer(b"".join(t for _, _, t in chunk), ">u8").astype("<u8")
            ends = np.cumsum([len(t) // 8 for _, _, t in chunk])
            begins = np.concatenate([[0], ends[:-1]])
            found = list(passages_of(x, ends, masks, k, table, power))
            if not found:
                return None
            at = [chunk[d][0] for d, *_ in found]
            shas = {i: hashlib.sha256(b.column(1)[i].as_py().encode("utf-8", "surrogatepass")).digest() for i in set(at)}
            return pa.RecordBatch.from_arrays(
                [
                    b.column(0).take(pa.array(at, pa.int64())),
                    pa.array([shas[i] for i in at], pa.binary()),
                    pa.array([nth + i for i in at], pa.int64()),
                    pa.array([chunk[d][1] + lo - int(begins[d]) for d, lo, *_ in found], pa.int64()),
                    pa.array([x[lo:hi].view(np.int64) for _, lo, hi, *_ in found], pa.list_(pa.int64())),
                    pa.array([[{"h": u, "at": v} for u, v in zip(h.view(np.int64).tolist(), (a - lo).tolist(), strict=True)] for _, lo, _, a, h in found], kind),
                ],
                names=names,
            )

        nth = 0
        for b in batches:
            chunk, size = [], 0
            for i, text in enumerate(b.column(1)):
                own = numbers(tokens(text.as_py()), known)
                # Parts of a very long text overlap by what a run and its reach need.
                step = 8 * CHUNK
                for lo in range(0, max(len(own) - 32 * LONGEST, 1), step):
                    part = own[lo : lo + step + 32 * LONGEST]
                    chunk.append((i, lo // 8, part))
                    size += len(part)
                    if size >= step:
                        if (out := told(b, chunk, nth)) is not None:
                            yield out
                        chunk, size = [], 0
            if chunk and (out := told(b, chunk, nth)) is not None:
                yield out
            nth += b.num_rows

    hit = T.ArrayType(T.StructType([T.StructField("h", T.LongType()), T.StructField("at", T.IntegerType())]))
    fields = [("text_sha", T.BinaryType()), ("nth", T.LongType()), ("first", T.LongType()), ("toks", T.ArrayType(T.LongType())), ("hits", hit)]
    found = rows.mapInArrow(run, with_id(rows, *fields))
    # A row is named by its partition and its place there; both are stored with its passages.
    return found.withColumn("row", F.spark_partition_id().cast("long") * (1 << 40) + F.col("nth")).drop("nth").withColumn("passage", F.monotonically_increasing_id())


def overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(id, row, text_sha, item, first, stop, same) of every alignment that contaminates a row, offsets in tokens; ``row`` tells rows with the same id apart."""
    rows = id_and_text(docs, id_col, text_col)
    items = items_of(benchmark, item_col, item_text_col)
    sizes = items.groupBy("n").count().collect() if not items.isEmpty() else []  # a row for each length: see least_hits
    schema = T.StructType([rows.schema["id"], *(T.StructField(n, t) for n, t in (("row", T.LongType()), ("text_sha", T.BinaryType()), ("item", T.StringType()), ("first", T.LongType()), ("stop", T.LongType()), ("same", T.LongType())))])
    if not sizes:
        return docs.sparkSession.createDataFrame([], schema)
    masks = tuple(dict.fromkeys(m for r in sizes for m in masks_of(r["n"])))
    seeds = seeds_of(items)
    n_seeds = seeds.count()
    bits, power = bitmap(seeds, n_seeds)
    passages = stored(scan(rows, masks, min(least_hits(r["n"]) for r in sizes), bits, power), "passages")

    hits = passages.select("passage", F.explode("hits").alias("hit")).select("passage", F.col("hit.h").alias("h"), F.col("hit.at").alias("place"))
    met = hits.join(F.broadcast(seeds) if n_seeds <= BROADCAST_SEEDS else seeds, "h")
    alignments = met.groupBy("passage", "item", (F.col("place") - F.col("at")).alias("shift")).agg(F.count(F.lit(1)).alias("n"), F.first("least").alias("least")).filter("n >= least")
    few = sum(r["n"] * r["count"] for r in sizes) <= BROADCAST_TOKENS
    own = items.select("item", F.col("id").alias("key"), F.col("toks").alias("own"))
    pairs = alignments.select("passage", "item", "shift").join(passages.drop("hits"), "passage").join(F.broadcast(own) if few else own, "item")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep, runs = [], []
            for i in range(b.num_rows):
                toks, item, shift = b.column(3)[i].values.to_numpy(), b.column(4)[i].values.to_numpy(), b.column(5)[i].as_py()
                lo, hi = max(0, -shift), min(len(item), len(toks) - shift)
                start, end, same = best_run(item[lo:hi] == toks[lo + shift : hi + shift])
                if same >= needed(len(item)):
                    keep.append(i)
                    first = b.column(6)[i].as_py() + lo + shift
                    runs.append((first + start, first + end, same))
            t = pa.array(keep, pa.int64())
            cols = [pa.array([r[k] for r in runs], pa.int64()) for k in range(3)]
            yield pa.RecordBatch.from_arrays([b.column(0).take(t), b.column(1).take(t), b.column(2).take(t), b.column(7).take(t), *cols], names=["id", "row", "text_sha", "item", "first", "stop", "same"])

    return pairs.select("id", "row", "text_sha", "toks", "own", "shift", "first", F.col("key").cast("string").alias("item")).mapInArrow(verify, schema)


def contaminated(docs: DataFrame, benchmark: DataFrame, **columns: str) -> DataFrame:
    """One row for each row of docs with a hit: id, n_items, equal_tokens of the best hit, items and spans (of each item's best hit, the first of equal ones) as text."""
    found = overlaps(docs, benchmark, **columns)
    per_item = found.groupBy("row", "id", "item").agg(F.max(F.struct("same", (-F.col("first")).alias("before"), "stop")).alias("best"))
    listed = F.array_sort(F.collect_list(F.struct("item", "best")))
    span = lambda x: F.concat_ws(":", x["item"], -x["best"]["before"], x["best"]["stop"])
    return per_item.groupBy("row", "id").agg(F.count(F.lit(1)).cast("long").alias("n_items"), F.max("best.same").alias("equal_tokens"), listed.alias("all")).select(
        "id",
        "n_items",
        "equal_tokens",
        F.array_join(F.transform("all", lambda x: x["item"]), ",").alias("items"),
        F.array_join(F.transform("all", span), ",").alias("spans"),
    )


def text_key(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text.cast("string"), F.lit("")), 256))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The clean rows of docs, with all their columns.  A text is contaminated or not wherever it stands, so its digest names what goes."""
    key = unused(docs, "text_sha")
    gone = stored(overlaps(docs, benchmark, id_col, text_col).select(F.col("text_sha").alias(key)).distinct(), "contaminated")
    return without_rows(docs.withColumn(key, text_key(docs[text_col])), key, gone).select(*docs.columns)


def op10_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each contaminated document; the others are clean."""
    return contaminated(docs, benchmark).withColumnRenamed("id", "doc_id").withColumn("contaminated", F.lit(True))
