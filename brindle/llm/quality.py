"""Quality classifier: random indexing, a two-layer network, calibrated probabilities.

Tokens of a text are its white-space words and the words' shapes (runs of
capitals, small letters and digits shrunk to A, a and 0, other characters
kept).  Every token is hashed to a bucket with a sparse ternary index vector;
a bucket's context vector is the sum of the index vectors of its neighbours in
a bounded labelled sample (random indexing).  Words that fall into the same
bucket share a vector, which at WORDS buckets happens to every rare word and is
the price of a bounded model.  A document is the mean of its
words' vectors, the mean of its shapes' vectors and a few counts; a network of
two layers in numpy maps it to a score, and a temperature fitted on labelled
rows that the network has not seen calibrates it.

At most TRAIN_ROWS labelled rows are used (those of the smallest hash of the
id); labels, lang, source and ids are never inputs of a score.  Null text
counts as empty; an empty text has zero vectors and gets a score like any
other.  Very long texts are pooled in parts.  Each input row gives one output
row; further columns play no part, whatever their names.  An empty table gives
no row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fold, forget_pieces, id_and_text, labelled_sample, slices, stored

TRAIN_ROWS = 8_000
WORDS, SHAPES, DIM = 8_192, 1_024, 32
BUCKETS = WORDS + SHAPES
WINDOW = 2
HIDDEN = 16
MEMORY = 200_000
RUN = re.compile(r"A+|a+|0+")


def shape_of(word: str) -> str:
    flat = "".join(["A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c for c in word])
    return RUN.sub(lambda m: m[0][0], flat)


def index_vectors() -> np.ndarray:
    """Four entries of +1 or -1 for each bucket, fixed by its number."""
    rng = np.random.default_rng(20_240)
    out = np.zeros((BUCKETS, DIM), np.float32)
    for b in range(BUCKETS):
        out[b, rng.choice(DIM, 4, replace=False)] = rng.choice([-1.0, 1.0], 4)
    return out


@dataclass
class Tokens:
    """Numbers of words and shapes, with a bounded memory."""

    known: dict[str, tuple[int, int]] = field(default_factory=dict)

    def number(self, word: str) -> tuple[int, int]:
        pair = crc32(word.lower().encode("utf-8", "replace")) % WORDS, WORDS + crc32(shape_of(word).encode("utf-8", "replace")) % SHAPES
        if len(self.known) < MEMORY and len(word) <= 40:
            self.known[word] = pair
        return pair

    def of(self, text: str) -> np.ndarray:
        """Two columns: buckets of words and of shapes."""
        known, number = self.known, self.number
        return np.array([known.get(w) or number(w) for w in text.split()], np.int64).reshape(-1, 2)


def counts_of(text: str, ids: np.ndarray) -> list[float]:
    lines = text.split("\n")
    n, n_words = len(text) or 1, len(ids)
    again = float((ids[1:, 0] == ids[:-1, 0]).mean()) if n_words > 1 else 0.0
    return [
        again,
        len(np.unique(ids[:, 0])) / (n_words or 1),
        np.log1p(n_words) / 10,
        len(set(lines)) / len(lines),
        n / (n_words or 1) / 20,
        len(re.findall(r"[*$%&#|!]", text)) / n,
        len(re.findall("[A-Z]", text)) / n,
        float(n_words == 0),
    ]


@dataclass
class Model:
    vectors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    layers: tuple[np.ndarray, np.ndarray, np.ndarray, float]
    temperature: float = 1.0

    def pooled(self, text: str, tokens: Tokens) -> np.ndarray:
        """The input of the network."""
        ids = tokens.of(text)
        if not len(ids):
            return np.concatenate([np.zeros(2 * DIM), counts_of(text, ids)])
        # One row at a time is summed for very long texts; the means are over all words.
        sums = np.zeros(2 * DIM)
        for at in range(0, len(ids), 1 << 16):
            part = ids[at : at + (1 << 16)]
            sums[:DIM] += self.vectors[part[:, 0]].sum(axis=0, dtype=np.float64)
            sums[DIM:] += self.vectors[part[:, 1]].sum(axis=0, dtype=np.float64)
        return np.concatenate([sums / len(ids), counts_of(text, ids)])

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        return np.tanh((x - self.mean) / self.scale @ w1 + b1) @ w2 + b2

    def scores(self, texts: list[str], tokens: Tokens) -> np.ndarray:
        if not texts:
            return np.empty(0)
        x = np.stack([self.pooled(t, tokens) for t in texts])
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def context_vectors(sample: DataFrame) -> np.ndarray:
    """Unit context vectors of all buckets: tasks sum their documents', Spark adds the sums by block of buckets."""
    block = 1024

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_pieces()
        index, tokens = index_vectors(), Tokens()
        sums = np.zeros((BUCKETS, DIM), np.float32)
        for b in batches:
            for text in b.column(1):
                ids = tokens.of(text.as_py())
                for kind in (0, 1):
                    own = ids[:, kind]
                    for d in range(1, WINDOW + 1):
                        if len(own) > d:
                            np.add.at(sums, own[d:], index[own[:-d]])
                            np.add.at(sums, own[:-d], index[own[d:]])
        parts = [sums[i : i + block].tobytes() for i in range(0, BUCKETS, block)]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.binary())], names=["block", "sums"])

    def add(key: tuple, rows: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_py(), np.float32) for x in rows["sums"])
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "sums": pa.array([total.tobytes()], pa.binary())})

    kind = "block int, sums binary"
    rows = sample.mapInArrow(run, kind).groupBy("block").applyInArrow(add, kind).collect()  # BUCKETS x DIM floats
    out = np.zeros((BUCKETS, DIM), np.float32)
    for r in rows:
        part = np.frombuffer(bytes(r["sums"]), np.float32).reshape(-1, DIM)
        out[r["block"] * block : r["block"] * block + len(part)] = part
    # The mean of all contexts says nothing about a word.
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    unit = out / np.maximum(norm, 1e-6)
    mean = unit[norm[:, 0] > 0].mean(axis=0) if (norm > 0).any() else 0
    return np.where(norm > 0, unit - mean, 0).astype(np.float32)


def train(x: np.ndarray, y: np.ndarray, rounds: int = 400) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Full-batch Adam on the logistic loss of tanh(x w1 + b1) w2 + b2."""
    rng = np.random.default_rng(7)
    p = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 0.25, HIDDEN), np.zeros(1)]
    m, s = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    for t in range(1, rounds + 1):
        h = np.tanh(x @ p[0] + p[1])
        d = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -30, 30))) - y) / len(y)
        dh = np.outer(d, p[2]) * (1 - h * h)
        for i, g in enumerate((x.T @ dh + 1e-4 * p[0], dh.sum(axis=0), h.T @ d + 1e-4 * p[2], d.sum(keepdims=True))):
            m[i], s[i] = 0.9 * m[i] + 0.1 * g, 0.999 * s[i] + 0.001 * g * g
            p[i] = p[i] - 0.02 * (m[i] / (1 - 0.9**t)) / (np.sqrt(s[i] / (1 - 0.999**t)) + 1e-8)
    return p[0], p[1], p[2], float(p[3][0])


def fitted_temperature(z: np.ndarray, y: np.ndarray) -> float:
    """The temperature of the least logistic loss."""
    grid = np.exp(np.linspace(np.log(0.25), np.log(8), 61))
    loss = [np.mean(np.logaddexp(0, z / t) - y * z / t) for t in grid]
    return float(grid[int(np.argmin(loss))])


def fit(docs: DataFrame, labels: DataFrame, keep: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", bound: int = TRAIN_ROWS) -> Model:
    """Learn from labelled rows for which keep holds; without any, a model that scores every text 1 (nothing is known against it)."""
    sample = stored(labelled_sample(docs, labels, id_col, text_col, label_col, keep, bound).repartition(24, F.xxhash64("id")), "quality-sample")
    width = 2 * DIM + 8
    none = (np.zeros((width, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), 30.0)
    model = Model(np.zeros((BUCKETS, DIM), np.float32), np.zeros(width), np.ones(width), none)
    if sample.isEmpty():
        return model
    model.vectors = context_vectors(sample)

    def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_pieces()
        tokens = Tokens()
        for b in slices(batches):
            x = [model.pooled(t.as_py(), tokens) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(x, pa.list_(pa.float64())), b.column(2)], names=["id", "x", "y"])

    kind = dict(sample.dtypes)["id"]
    got = sample.mapInArrow(pool, f"id {kind}, x array<double>, y int").orderBy("id").toArrow()
    x = np.array(got["x"].to_pylist(), float)
    y = (got["y"].to_numpy() == 1).astype(float)
    model.mean, model.scale = x.mean(axis=0), x.std(axis=0) + 1e-3
    scaled = (x - model.mean) / model.scale
    check = np.arange(len(y)) % 5 == 4 if len(y) >= 50 else np.zeros(len(y), bool)
    model.layers = train(scaled[~check], y[~check])
    if check.any():
        model.temperature = fitted_temperature(model.logits(x[check]), y[check])
    return model


def score_texts(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every row of docs."""
    rows = id_and_text(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_pieces()
        tokens = Tokens()
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.scores(b.column(1).to_pylist(), tokens), pa.float64())], names=["id", "score"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, score double")


def keep_good(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """The rows of docs that score at least the threshold, with all their columns."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_pieces()
        tokens = Tokens()
        for b in slices(batches):
            texts = [t or "" for t in b.column(at).to_pylist()]
            yield b.filter(pa.array(model.scores(texts, tokens) >= threshold, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def fit_for_contract(docs: DataFrame, labels: DataFrame) -> Model:
    return fit(docs, labels, fold(labels["doc_id"], 4) != 2)


def op6_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    model = fit_for_contract(docs, labels)
    held = F.coalesce(fold(F.col("doc_id"), 4) == 2, F.lit(False))
    scored = score_texts(docs, model).withColumnRenamed("id", "doc_id")
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
