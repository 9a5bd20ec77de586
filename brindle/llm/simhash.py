"""SimHash near-dedup with bit-sliced comparison.

Fingerprints: 64 bits over the XXH64 hashes of all 3-word shingles.  Links: two
fingerprints that differ in at most RADIUS bits.  With the bits cut in four
blocks of 16, two such fingerprints agree in at least two blocks, so the six
pairs of blocks give six exact keys of 32 bits; rows of a key are compared.

The comparison is bit-sliced: the rows of many keys, sorted by key, are stored
as 64 vertical bit planes, 64 rows a word.  For a shift s the planes are
compared with themselves s rows further, which gives the distances of 64 pairs
at a time; carry-save counters add up the differing bits, and a block of rows
is abandoned once all its pairs exceed the radius.

Only distinct fingerprints are compared; copies share one.  A key with more
than UNIT fingerprints is cut into units that are compared pair by pair in
tasks of their own.  A unit returns a spanning forest of its links, not the
links.  Components come from alternating star rounds on the forest's edges, as
many as the logarithm of a component's longest path, each written to the shared
folder; the last round's table maps nodes to roots.  Nothing is collected.

Null text counts as empty; texts without words have fingerprint zero and are
linked like any other.  Each input row gives one output row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import id_and_text, stored, unused, with_id, without_rows

SHINGLE, SEED, RADIUS = 3, 42, 2
#: Fingerprints of one key that a task compares with each other.
UNIT = 2048
#: Keyed fingerprints that a task is dealt.
TASK_ROWS = 2_000_000
#: Words of 64 rows that are abandoned together.
BLOCK = 64
BLOCK_PAIRS = [(a, b) for a in range(4) for b in range(a + 1, 4)]


def fingerprint(text: str, size: int = SHINGLE, seed: int = SEED) -> int:
    """A bit is 1 if it is set in over half of the shingles' hashes."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= size:
        return xxhash.xxh64_intdigest(line, seed)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = [0, *(ends[: -size] + 1).tolist()]
    h = xxhash.xxh64_intdigest
    hashes = np.array([h(line[a:b], seed) for a, b in zip(starts, ends[size - 1 :].tolist(), strict=True)], "<u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):  # bounded memory for very long texts
        part = hashes[at : at + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, fp) with fp as a signed 64-bit integer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t.as_py()) for t in b.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps)], names=["id", "fp"])

    rows = id_and_text(docs, id_col, text_col)
    return rows.mapInArrow(run, with_id(rows, ("fp", T.LongType())))


def bit_planes(fps: np.ndarray) -> np.ndarray:
    """64 rows of words: bit r of row p is bit p of fingerprint r."""
    n = -(-len(fps) // 64) * 64
    rows = np.zeros((n, 8), np.uint8)
    rows[: len(fps)] = fps.astype("<i8").view(np.uint8).reshape(-1, 8)
    bits = np.unpackbits(rows, axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view("<u8")


def shifted(words: np.ndarray, s: int) -> np.ndarray:
    """Row r gets what row r + s holds; zeros come in at the end."""
    w, r = divmod(s, 64)
    out = np.zeros_like(words)
    n = words.shape[-1] - w
    if n <= 0:
        return out
    out[..., :n] = words[..., w:] >> np.uint64(r)
    if r and n > 1:
        out[..., : n - 1] |= words[..., w + 1 :] << np.uint64(64 - r)
    return out


def within(planes: np.ndarray, other: np.ndarray, valid: np.ndarray) -> np.ndarray:
    """Words of those valid pairs that differ in at most two planes.

    Carry-save counters: ``one`` and ``two`` hold each pair's count, ``over`` marks counts past two.
    """
    near = np.zeros_like(valid)
    for at in range(0, valid.shape[0], BLOCK):
        own = slice(at, at + BLOCK)
        over = ~valid[own]
        one, two = np.zeros_like(over), np.zeros_like(over)
        for p in range(0, 64, 8):
            if (over == ~np.uint64(0)).all():
                break
            for d in planes[p : p + 8, own] ^ other[p : p + 8, own]:
                carry = one & d
                one ^= d
                over |= two & (carry | one & d)
                two |= carry
            over |= one & two
        near[own] = ~over
    return near


def forest(groups: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest (pairs of fingerprints) of the links within each group; rows sorted by group."""
    n = len(fps)
    parent = np.arange(n)
    edges: list[tuple[int, int]] = []

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    bounds = np.flatnonzero(np.concatenate([[True], groups[1:] != groups[:-1], [True]]))
    sizes = np.diff(bounds)
    rest = np.repeat(sizes, sizes) - (np.arange(n) - np.repeat(bounds[:-1], sizes))  # rows from here to the group's end
    s, rows, planes = 1, np.arange(n), None
    while True:
        keep = np.repeat(sizes > s, sizes) if planes is None else np.repeat(sizes[alive] > s, sizes[alive])
        if not keep.any():
            break
        if planes is None or keep.mean() < 0.7:  # groups that are through are left out
            rows = rows[keep]
            alive = sizes > s
            planes = bit_planes(fps[rows])
        ok = np.zeros(planes.shape[1] * 64, bool)
        ok[: len(rows)] = rest[rows] > s
        near = within(planes, shifted(planes, s), np.packbits(ok, bitorder="little").view("<u8"))
        hit = np.flatnonzero(np.unpackbits(near.view(np.uint8), bitorder="little"))
        if len(hit):
            a, b = rows[hit], rows[hit + s]
            open_ = parent[a] != parent[b]  # most links of a dense group are known to be inside a tree
            for i, j in zip(a[open_].tolist(), b[open_].tolist(), strict=True):
                x, y = root(i), root(j)
                if x != y:
                    parent[max(x, y)] = min(x, y)
                    edges.append((i, j))
            while (parent[parent] != parent).any():
                parent = parent[parent]
        s += 1
    e = np.array(edges, np.int64).reshape(-1, 2)
    return fps[e[:, 0]], fps[e[:, 1]]


def linked(keyed: DataFrame) -> DataFrame:
    """Edges (a, b) of spanning forests of keyed (g, fp), over all g."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g0, f0 = np.empty(0, np.int64), np.empty(0, np.int64)

        def out(g: np.ndarray, f: np.ndarray) -> pa.RecordBatch:
            a, b = forest(g, f)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            g0 = np.concatenate([g0, batch.column(0).to_numpy()])
            f0 = np.concatenate([f0, batch.column(1).to_numpy()])
            if len(g0) < 200_000:
                continue
            end = int(np.searchsorted(g0, g0[-1]))  # the last group may go on
            if end:
                yield out(g0[:end], f0[:end])
                g0, f0 = g0[end:], f0[end:]
        if len(g0):
            yield out(g0, f0)

    return keyed.mapInArrow(run, "a long, b long")


def links(fps: DataFrame) -> DataFrame:
    """A spanning forest (a, b) of all links between distinct fingerprints (fp)."""
    block = lambda i: F.shiftrightunsigned("fp", 16 * i).bitwiseAND(F.lit(0xFFFF))
    keys = F.array(*(F.xxhash64(F.lit(k), block(a), block(b)) for k, (a, b) in enumerate(BLOCK_PAIRS)))
    keyed = fps.select("fp", F.explode(keys).alias("key"))
    counts = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    busy = keyed.join(counts, "key")  # one row a key on the right: adaptive execution splits a hot key's rows
    chunks = F.ceil(F.col("n") / UNIT).cast("int")
    own = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
    units = (
        busy.select("key", "fp", chunks.alias("chunks"))
        .select("key", "fp", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other"))
        .select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("g"), "fp")
    )
    parts = max(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-fps.count() * len(BLOCK_PAIRS) // TASK_ROWS))
    return linked(units.repartition(parts, "g").sortWithinPartitions("g", "fp"))


def large_star(edges: DataFrame) -> DataFrame:
    """Every node's larger neighbours are tied to the smallest of its neighbours and itself; edges (a, b) with a > b."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("least")).select("a", F.least("a", "least").alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours are tied to the smallest of them; edges (a, b) with a > b."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    others = edges.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return least.withColumnRenamed("m", "b").unionByName(others).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of its component for every other node of edges (a, b).

    A round is a large star and a small star, written to the shared folder; it
    doubles how far a node sees, so a path of n links takes about log2(n)
    rounds.  Rounds end when one changes nothing: then every edge leads to a root.
    A hub's rows are on the larger side of each join, which adaptive execution splits.
    """
    spark = edges.sparkSession
    told = lambda df: df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    edges = stored(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before, now = None, told(edges)
    while now != before and now[0]:
        edges, before = stored(small_star(stored(large_star(edges), "large")), "edges"), now
        now = told(edges)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")) if now[0] else spark.createDataFrame([], "node long, root long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, component_id): the smallest id that links lead to, for every row of docs."""
    rows = stored(fingerprints(docs, id_col, text_col), "fingerprints")
    by_fp = stored(rows.groupBy("fp").agg(F.min("id").alias("least")), "distinct")
    roots = stored(components(links(by_fp.select("fp"))), "roots")
    named = by_fp.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    heads = named.groupBy("root").agg(F.min("least").alias("component_id"))
    final = stored(named.join(heads, "root").select("fp", "component_id"), "components")
    # A fingerprint may be that of a third of all rows: adaptive execution splits the rows' side of this join.
    return rows.join(final, "fp")


def keep_representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of docs for each component: that of the smallest id (null last), then of the smallest digest of the text.

    Ids may be null or repeated, so id and digest together name a row; of rows that agree in both one stays.
    """
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    key = unused(docs, "row")
    row = F.struct(docs[id_col].isNull().alias("last"), docs[id_col].alias("id"), F.unhex(F.sha2(text, 256)).alias("digest"))
    named = docs.withColumn(key, row)
    found = near_duplicates(named, key, text_col).select(F.col("id").alias(key), (F.col("id") != F.col("component_id")).alias("out"))
    told = stored(found.groupBy(key, "out").agg(F.count(F.lit(1)).alias("n")).filter("out or n > 1"), "near-out")
    return without_rows(named, key, told.filter("out").select(key), told.filter("not out").select(key)).select(*docs.columns)


def op8_near_duplicates(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
