"""Vector search, fusion of two rankings, confidence, abstention, per-document caps and diversity."""

from __future__ import annotations

import numpy as np
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import vectors

DISTANCES = {"cosine": vectors.cosine_distance, "l2": vectors.l2_distance, "l1": vectors.l1_distance, "ip": vectors.negative_inner_product}


def exact_search(rows: DataFrame, key: str, vector: str, query: list[float], k: int, metric: str = "cosine", where: Column | None = None) -> DataFrame:
    """(id, distance) of the k nearest rows, ties by id; the filter comes first.  Each task keeps k rows."""
    rows = rows.filter(where) if where is not None else rows
    d = DISTANCES[metric](F.col(vector), vectors.literal(query))
    return rows.select(F.col(key).alias("id"), d.alias("distance")).filter("distance IS NOT NULL").orderBy("distance", "id").limit(k)


def batch_search(rows: DataFrame, key: str, vector: str, queries: DataFrame, k: int, block: int = 256) -> DataFrame:
    """(query_id, id, similarity) of the k nearest rows by cosine for each query (query_id, query).

    Queries are a stated set, held in blocks; a task keeps k rows a query, so what is shuffled is k rows a
    query and task.
    """
    found = _blocks(rows.select(F.col(key).alias("id"), F.col(vector).alias("v")), queries, k, block)
    return _best(found, k)


def _blocks(rows: DataFrame, queries: DataFrame, k: int, block: int, centers: np.ndarray | None = None, probes: int = 0) -> DataFrame:
    """(query_id, id, similarity): the k nearest rows (id, v) a query and task, in the query's lists only if there are centers."""
    got = queries.select("query_id", "query").orderBy("query_id").collect()
    out = rows.sparkSession.createDataFrame([], "query_id long, id long, similarity double") if not got else None
    for at in range(0, len(got), block):
        part = got[at : at + block]
        ids = np.array([r["query_id"] for r in part])
        q = np.array([list(r["query"]) for r in part], np.float64)
        q /= np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)
        probed, own = None, rows
        if centers is not None:
            nearest = np.argsort(np.stack([((centers - x) ** 2).sum(axis=1) for x in q]), axis=1)[:, :probes]
            probed = np.zeros((len(q), len(centers)), bool)
            np.put_along_axis(probed, nearest, True, axis=1)
            own = rows.filter(F.col("list").isin(np.flatnonzero(probed.any(axis=0)).tolist()))

        def near(batches, ids=ids, q=q, probed=probed):  # noqa: ANN001, ANN202
            import pandas as pd

            best = [(np.empty(0, np.int64), np.empty(0)) for _ in ids]  # of the whole task, k a query
            for pdf in batches:
                if not len(pdf):
                    continue
                x = np.stack(pdf["v"].to_numpy()).astype(np.float64)
                sims = (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)) @ q.T
                keys = pdf["id"].to_numpy()
                for j in range(len(ids)):
                    at = slice(None) if probed is None else np.flatnonzero(probed[j, pdf["list"].to_numpy()])
                    own_ids, own_sims = np.concatenate([best[j][0], keys[at]]), np.concatenate([best[j][1], sims[at, j]])
                    first = np.lexsort((own_ids, -own_sims))[:k]
                    best[j] = own_ids[first], own_sims[first]
            for query_id, (found, similarity) in zip(ids, best, strict=True):
                if len(found):
                    yield pd.DataFrame({"query_id": query_id, "id": found, "similarity": similarity})

        found = own.mapInPandas(near, "query_id long, id long, similarity double")
        out = found if out is None else out.unionByName(found)
    return out


def _best(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


class InvertedFile:
    """k-means lists; a search looks at the nearest ``probes`` lists only.  Recall is to be measured against exact_search.

    Centers come from at most ``sample`` rows; every row is in a list.  With ``path`` the model and the lists are
    stored, one folder a list, and a search reads the folders that it looks at; ``open`` finds them again.
    """

    def __init__(self, rows: DataFrame, key: str, vector: str, lists: int = 100, passes: int = 10, sample: int = 100_000, seed: int = 1, path: str | None = None) -> None:
        unit = self._unit(rows, key, vector)
        fitted = unit.orderBy(F.xxhash64("id")).limit(sample)
        model = KMeans(k=lists, maxIter=passes, seed=seed, featuresCol="f").fit(fitted.select(array_to_vector("v").alias("f")))
        self._take(model)
        self.path = path.rstrip("/") if path else None
        if self.path:
            self._store(self._assign(unit), "overwrite")
            model.write().overwrite().save(f"{self.path}/model")
            self.assigned = rows.sparkSession.read.parquet(f"{self.path}/lists")
        else:
            self.assigned = self._assign(unit)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> InvertedFile:
        self = cls.__new__(cls)
        self.path = path.rstrip("/")
        self._take(KMeansModel.load(f"{self.path}/model"))
        self.assigned = spark.read.parquet(f"{self.path}/lists")
        return self

    def append(self, rows: DataFrame, key: str, vector: str) -> None:
        """Further rows go to the lists of the stored centers; ids are to be new."""
        if not self.path:
            raise ValueError("only stored lists take further rows")
        self._store(self._assign(self._unit(rows, key, vector)), "append")
        self.assigned = rows.sparkSession.read.parquet(f"{self.path}/lists")

    @staticmethod
    def _unit(rows: DataFrame, key: str, vector: str) -> DataFrame:
        return rows.select(F.col(key).alias("id"), vectors.normalize(F.col(vector)).alias("v"))

    def _take(self, model: KMeansModel) -> None:
        self.model, self.centers = model, np.array(model.clusterCenters())
        self.lists = len(self.centers)

    def _assign(self, unit: DataFrame) -> DataFrame:
        return self.model.transform(unit.withColumn("f", array_to_vector("v"))).select("id", "v", F.col("prediction").alias("list"))

    def _store(self, rows: DataFrame, mode: str) -> None:
        rows.hint("rebalance", "list").write.mode(mode).partitionBy("list").parquet(f"{self.path}/lists")

    def search(self, query: list[float], k: int, probes: int = 1) -> DataFrame:
        q = np.array(query, float)
        q /= max(np.linalg.norm(q), 1e-300)
        nearest = np.argsort(((self.centers - q) ** 2).sum(axis=1))[:probes].tolist()
        return exact_search(self.assigned, "id", "v", query, k, where=F.col("list").isin(nearest))

    def batch_search(self, queries: DataFrame, k: int, probes: int = 1, block: int = 256) -> DataFrame:
        """(query_id, id, similarity, rank) of the k nearest rows by cosine in the nearest lists of each query (query_id, query)."""
        return _best(_blocks(self.assigned, queries, k, block, self.centers, probes), k)


def rescored_search(rows: DataFrame, key: str, vector: str, query: list[float], k: int, oversample: int = 3) -> DataFrame:
    """int8 components find 3 k candidates; full precision ranks them."""
    top = max(abs(x) for x in query) or 1.0
    coarse = [round(x * 127 / top) for x in query]
    rough = rows.withColumn("__q", vectors.quantize_int8(F.col(vector)))
    ids = exact_search(rough, key, "__q", coarse, k * oversample).select(F.col("id").alias(key))
    return exact_search(rows.join(F.broadcast(ids), key), key, vector, query, k)


# Fusion: lists are (id, score) with better scores larger ------------------------


def _ranked(hits: DataFrame, name: str) -> DataFrame:
    return hits.select("id", F.col("score").alias(name), F.row_number().over(Window.orderBy(F.desc("score"), "id")).alias(f"{name}_rank"))


def rrf(lexical: DataFrame, vector: DataFrame, k: int = 60) -> DataFrame:
    """Sum of 1 / (k + rank), ranks from 1; the lists are the branches' top candidates."""
    both = _ranked(lexical, "l").join(_ranked(vector, "v"), "id", "full_outer")
    part = lambda n: F.coalesce(1 / (k + F.col(f"{n}_rank")), F.lit(0.0))
    return both.select("id", (part("l") + part("v")).alias("score"), origin().alias("origin"))


def origin() -> Column:
    return F.when(F.col("l").isNull(), "vector").when(F.col("v").isNull(), "lexical").otherwise("both")


def min_max(lexical: DataFrame, vector: DataFrame, w: float | Column = 0.35) -> DataFrame:
    """w minmax(vector) + (1 - w) minmax(lexical); a flat list scales to 1, a missing hit to 0."""
    scale = lambda h, n: h.select("id", F.col("score").alias(n), _scaled(F.col("score")).alias(f"{n}s"))
    both = scale(lexical, "l").join(scale(vector, "v"), "id", "full_outer")
    w = w if isinstance(w, Column) else F.lit(w)
    return both.select("id", (w * F.coalesce("vs", F.lit(0.0)) + (1 - w) * F.coalesce("ls", F.lit(0.0))).alias("score"), origin().alias("origin"))


def _scaled(x: Column) -> Column:
    whole = Window.partitionBy()
    lo, hi = F.min(x).over(whole), F.max(x).over(whole)
    return F.when(hi == lo, 1.0).otherwise((x - lo) / (hi - lo))


def max_scaled(lexical: DataFrame, vector: DataFrame, w: float = 0.35) -> DataFrame:
    """Convex combination of scores divided by their list's largest."""
    whole = Window.partitionBy()
    scale = lambda h, n: h.select("id", F.col("score").alias(n), F.coalesce(F.try_divide(F.col("score"), F.max("score").over(whole)), F.lit(0.0)).alias(f"{n}s"))
    both = scale(lexical, "l").join(scale(vector, "v"), "id", "full_outer")
    return both.select("id", (w * F.coalesce("vs", F.lit(0.0)) + (1 - w) * F.coalesce("ls", F.lit(0.0))).alias("score"), origin().alias("origin"))


def adaptive_weight(oov: float, identifiers: float, sep_vector: float, sep_lexical: float, coverage: float, gain: float = 0.1) -> float:
    """More weight for vectors with unknown words and clear vector hits, less with identifiers and covered terms."""
    w = 0.35 + gain * oov - gain * identifiers + gain * (sep_vector - sep_lexical) - gain * coverage
    return min(max(w, 0.05), 0.95)


def confidence(cosine: Column, bm25: Column, ceiling: Column, w: float = 0.35) -> Column:
    """w clamp(cosine) + (1 - w) bm25 / the score no document can pass."""
    return w * F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(cosine, F.lit(0.0)))) + (1 - w) * F.coalesce(F.try_divide(bm25, ceiling), F.lit(0.0))


def abstain(hits: DataFrame, threshold: float) -> DataFrame:
    """Nothing is returned rather than what is not confident."""
    return hits.filter(F.col("confidence") >= threshold)


def threshold_of(answerable: DataFrame, share: float = 0.05) -> float:
    """The 5th percentile of the confidence of answerable queries."""
    return answerable.agg(F.percentile("confidence", F.lit(share))).first()[0]


def capped(hits: DataFrame, group: str, n: int = 2) -> DataFrame:
    """At most n hits of a document."""
    w = Window.partitionBy(group).orderBy(F.desc("score"), "id")
    return hits.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= n).drop("__r")


def diversified(hits: list[tuple[int, float, list[float]]], k: int, lam: float = 0.7) -> list[int]:
    """Maximal marginal relevance over at most a few dozen candidates (id, score, vector)."""
    left = sorted(hits, key=lambda h: (-h[1], h[0]))
    unit = {i: np.array(v, float) / max(np.linalg.norm(v), 1e-300) for i, _, v in left}
    chosen: list[int] = []
    while left and len(chosen) < k:
        best = max(left, key=lambda h: (lam * h[1] - (1 - lam) * max((float(unit[h[0]] @ unit[c]) for c in chosen), default=0.0), -h[0]))
        chosen.append(best[0])
        left.remove(best)
    return chosen
