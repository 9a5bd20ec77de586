"""Toxicity by weak supervision.

1. Mining: words and word beginnings of a bounded labelled sample, near copies
   left out, are counted by class and by the language that a text's function
   words show; those that point to class 1 make up mined lists.
2. Voters vote 1, -1 or abstain: written lexicons, one for each of four
   languages and three themes; mined words and mined beginnings, a list for
   each language; patterns such as an insult after a second person, masked or
   stretched letters, capitals, several insults in one text.
3. Generative label model: a factor graph over the votes and the unknown class,
   with a propensity and an accuracy for each voter and a correlation for each
   pair of voters.  All are fitted together from the votes alone, by EM on the
   pseudo-likelihood; a penalty keeps correlations at zero that the votes do
   not show.  Two voters that repeat each other are explained by their
   correlation, so their accuracies are not counted twice.
4. A linear classifier over the mined features, lexicons, patterns and forms is
   trained on the model's posterior labels and scores every text.

At most TRAIN_ROWS labelled rows are used (those of the smallest hash of the
id); labels, lang, source and ids are never inputs of a score.  Null text
counts as empty; empty texts get the score of a text without features.  Texts
of any length are read whole.  Each input row gives one output row; an empty
table gives none, and further columns play no part, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fold, id_and_text, labelled_sample, stored

TRAIN_ROWS = 12_000
MAX_FEATURES = 3_000
#: A feature needs so many rows, such log odds, and a likelihood ratio beyond what chance gives the best of
#: all features (2 ln of their number) by MARGIN: chance finds would add up in long texts.
MIN_ROWS, MIN_ODDS, MARGIN = 6, 2.0, 4.0
STEMS = range(3, 9)
#: Log odds of a list's strongest word from which the list votes 1.
STRONG = 3.0
#: A text of so many different words without any find speaks against class 1.
CLEAN_WORDS = 10
#: The residual correlation from which a pair of voters gets a term of its own.
DEPENDENT = 0.1
WORD = re.compile(r"[^\W\d_]+")

#: Function words that show a text's language.
FUNCTION_WORDS = {
    "en": "the of and to in is that it for was with this are".split(),
    "de": "der die das und ist von den mit zu ein nicht auf".split(),
    "fr": "le la les des et est une pour que dans qui sur".split(),
    "es": "el los las que una por con del se y es no".split(),
}
LANGUAGES = (*FUNCTION_WORDS, "other")

#: Written lexicons: insults to someone's wits, to someone's worth, and words of contempt.
LEXICONS = {
    "en": ("idiot idiots idiotic moron morons moronic stupid imbecile imbeciles dumb dumbass fool fools dimwit halfwit", "worthless trash scum garbage loser losers vermin filth parasite useless", "pathetic disgusting revolting vile clown clowns ridiculous despicable repulsive contemptible"),
    "de": ("idiot idioten idiotisch trottel depp deppen dumm dummkopf blöd schwachkopf hohlkopf vollidiot", "wertlos abschaum müll dreck versager ungeziefer gesindel nutzlos nichtsnutz", "erbärmlich ekelhaft widerlich lächerlich abstoßend clown verachtenswert jämmerlich"),
    "fr": ("idiot idiote idiots crétin crétine imbécile imbéciles stupide stupides débile abruti abrutie", "ordure ordures déchet déchets minable minables nul nulle vermine raclure inutile", "pathétique dégoûtant dégoûtante répugnant répugnante ridicule ridicules clown méprisable abject"),
    "es": ("idiota idiotas imbécil imbéciles estúpido estúpida tonto tonta tarado tarada necio necia", "basura escoria inútil inútiles perdedor perdedora alimaña despojo", "patético patética asqueroso asquerosa repugnante ridículo ridícula payaso despreciable"),
}
#: Each insult's voters: the lexicons that list it.
INSULTS: dict[str, list[int]] = {}
for _k, _words in enumerate(w for own in LEXICONS.values() for w in own):
    for _w in _words.split():
        INSULTS.setdefault(_w, []).append(_k)
N_LEXICONS = 3 * len(LEXICONS)
MINED = [(lang, kind) for lang in LANGUAGES for kind in ("word", "beginning")]
PATTERNS = ("second person", "masked", "stretched", "capitals", "several", "repeated", "loud", "clean")
N_VOTERS = N_LEXICONS + len(MINED) + len(PATTERNS)

_any = "|".join(sorted(INSULTS, key=len, reverse=True))
SECOND_PERSON = re.compile(rf"\b(?:you|your|youre|du|ihr|dein|tu|vous|ton|eres|tú|ustedes)\b(?:\W+\w+){{0,3}}\W+(?:{_any})\b")
MASKED = re.compile(r"\b[a-z]+[$@*!0134][a-z$@*!0134]*(?![^\s.,;:?])")
UNMASK = str.maketrans("$@!0134", "saioiea")
STRETCHED = re.compile(r"([^\W\d_])\1\1+")


def beginnings(words: set[str]) -> set[str]:
    """The beginnings of longer words, as ``^abc``."""
    return {"^" + w[:n] for w in words for n in STEMS if len(w) > n}


def features(words: set[str]) -> set[str]:
    return words | beginnings(words)


def language(words: set[str]) -> int:
    """The number of the language most of whose function words a text has."""
    found = [sum(w in words for w in own) for own in FUNCTION_WORDS.values()]
    return found.index(max(found)) if max(found) > 1 else len(found)


def forms(text: str) -> list[float]:
    """Shares of capitals, exclamation marks and symbols."""
    n = len(text) or 1
    upper = len(re.findall("[A-Z]", text))
    return [upper / n, text.count("!") / n, len(re.findall(r"[*$%&#@]", text)) / n]


def unmasked(word: str) -> bool:
    """Whether a word is an insult with some letters replaced."""
    plain = word.translate(UNMASK)
    if "*" not in plain:
        return plain in INSULTS
    own = re.compile(plain.replace("*", "[^\\W\\d_]"))
    return any(own.fullmatch(w) for w in INSULTS)


def insults(text: str, low: str, words: set[str]) -> tuple[list[str], list[int]]:
    """The written insults in a text, and whether the first four patterns hold."""
    found = sorted(words & INSULTS.keys())
    masked = any(unmasked(m) for m in MASKED.findall(low))
    stretched = any(w not in INSULTS and (STRETCHED.sub(r"\1", w) in INSULTS or STRETCHED.sub(r"\1\1", w) in INSULTS) for w in words if STRETCHED.search(w)) if STRETCHED.search(low) else False
    if not found:
        return found, [0, int(masked), int(stretched), 0]
    return found, [int(bool(SECOND_PERSON.search(low))), int(masked), int(stretched), int(any(re.search(rf"\b{w.upper()}\b", text) for w in found))]


def mined(sample: DataFrame, rows: int) -> list[tuple[str, float, int]]:
    """The features that point to class 1 most surely, with their smoothed log odds and the language they are most found in.

    Tasks count in bounded tables and emit partial counts; Spark adds them up.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter, Counter] = (Counter(), Counter())

        def out() -> pa.RecordBatch:
            keys = list(seen[0].keys() | seen[1].keys())
            cols = [pa.array([f for f, _ in keys], pa.string()), pa.array([k for _, k in keys], pa.int32())]
            b = pa.RecordBatch.from_arrays([*cols, *(pa.array([seen[y][k] for k in keys], pa.int64()) for y in (0, 1))], names=["f", "lang", "n0", "n1"])
            seen[0].clear()
            seen[1].clear()
            return b

        for b in batches:
            for text, y in zip(b.column(1), b.column(2).to_pylist(), strict=True):
                words = set(WORD.findall(text.as_py().lower()))
                lang = language(words)
                seen[1 if y == 1 else 0].update((f, lang) for f in features(words))
                if len(seen[0]) + len(seen[1]) > 300_000:
                    yield out()
        yield out()

    n1 = sample.filter("y = 1").count()
    n0 = rows - n1
    by_lang = sample.mapInArrow(count, "f string, lang int, n0 long, n1 long").groupBy("f", "lang").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    counts = stored(by_lang.groupBy("f").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.max_by("lang", F.struct("n1", -F.col("lang"))).alias("lang")), "toxic-counts")
    a, b = F.col("n1"), F.col("n0")
    odds = F.log((a + 0.5) / (n1 + 1.0)) - F.log((b + 0.5) / (n0 + 1.0))
    part = lambda n, expected: F.when(n > 0, n * F.log(n / expected)).otherwise(0.0)
    ratio = 2 * (part(a, (a + b) * max(n1, 1) / rows) + part(b, (a + b) * max(n0, 1) / rows))
    chance = 2 * math.log(max(counts.count(), 2)) + MARGIN
    top = counts.filter(a + b >= MIN_ROWS).select("f", "lang", odds.alias("odds"), ratio.alias("ratio")).filter((F.col("odds") > MIN_ODDS) & (F.col("ratio") > chance))
    best = top.orderBy(F.desc("ratio"), "f").limit(MAX_FEATURES).collect()
    return [(r["f"], r["odds"], r["lang"]) for r in best]


def without_copies(sample: DataFrame) -> DataFrame:
    """One row of those that share label and least 5-word shingle hash: the rare words of near copies are no evidence.

    The sample is bounded, so its ids and hashes are chosen from in the driver; no key is sent to one task.
    """

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = []
            for text in b.column(1):
                w = WORD.findall(text.as_py().lower())
                keys.append(min((crc32(" ".join(w[i : i + 5]).encode()) for i in range(max(1, len(w) - 4))), default=0))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(keys, pa.int64()), pa.array([crc32(str(i).encode()) for i in b.column(0).to_pylist()], pa.int64())], names=["id", "y", "least", "rank"])

    kind = dict(sample.dtypes)["id"]
    first: dict[tuple[int, int], tuple[int, str, object]] = {}
    for r in sample.mapInArrow(least, f"id {kind}, y int, least long, rank long").collect():
        own = r["rank"], str(r["id"]), r["id"]
        first[r["least"], r["y"]] = min(first.get((r["least"], r["y"]), own), own)
    chosen = sample.sparkSession.createDataFrame([(i,) for *_, i in first.values()], f"id {kind}")
    return sample.join(F.broadcast(chosen), "id", "left_semi")


def votes(own: list[tuple[str, float, int]], lang: int, n_words: int, found: list[str], patterns: list[int], repeated: bool, form: list[float]) -> list[int]:
    """One vote a voter: 1, -1 or 0 (abstains)."""
    out = [0] * N_VOTERS
    for w in found:
        for k in INSULTS[w]:
            out[k] = 1
    score = [0.0] * len(MINED)
    for f, odds, at in own:
        k = 2 * at + (f[0] == "^")
        score[k] = max(score[k], odds)
    for k, s in enumerate(score):
        # A list speaks against class 1 only in its own language.
        out[N_LEXICONS + k] = 1 if s > STRONG else -1 if k // 2 == lang and s == 0 and n_words >= CLEAN_WORDS else 0
    several = len(found) + sum(f[0] != "^" for f, *_ in own)
    loud = 1 if form[1] > 0.05 and form[0] < 0.2 else 0
    clean = -1 if not own and not found and not any(patterns) and n_words >= CLEAN_WORDS else 0
    out[N_LEXICONS + len(MINED) :] = [*patterns, 1 if several > 1 else 0, int(repeated), loud, clean]
    return out


def label_model(v: np.ndarray, prior: float, rounds: int = 40, steps: int = 6) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(posterior of class 1 for each row of votes, accuracies, correlations).

    p(votes, class) is proportional to exp(sum of propensity[j] where j votes + accuracy[j] where its vote is the class's +
    correlation[j, k] where j and k cast the same vote).  Given the class, a voter's vote depends on the others' by the
    correlations only, which gives the pseudo-likelihood; given the votes, the log odds of the class are the votes weighted
    by the accuracies, with a constant that makes the mean posterior the prior.  No voter is worse than chance.

    The first rounds fit voters alone; pairs that leave a residual correlation above DEPENDENT then get a term, and the
    further rounds fit all terms together.
    """
    rows, back, n = np.unique(v, axis=0, return_inverse=True, return_counts=True)
    back, share = back.ravel(), n / n.sum()
    yes, no = (rows == 1).astype(float), (rows == -1).astype(float)
    k = v.shape[1]
    lab, acc, cor = np.full(k, -1.0), np.ones(k), np.zeros((k, k))
    params = [lab, acc, cor]
    m, s = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    post = np.where((rows == 1).any(axis=1), 0.9, 0.02)
    pairs = np.zeros((k, k), bool)

    def posterior() -> np.ndarray:
        z = rows @ acc
        lo, hi = -60.0, 60.0
        for _ in range(50):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if share @ (1 / (1 + np.exp(-np.clip(z + mid, -40, 40)))) < prior else (lo, mid)
        return 1 / (1 + np.exp(-np.clip(z + lo, -30, 30)))

    def dependent() -> np.ndarray:
        """Pairs of voters whose agreement the class leaves unexplained."""
        means = [(q * share) @ rows / max((q * share).sum(), 1e-9) for q in (post, 1 - post)]
        rest = rows - np.outer(post, means[0]) - np.outer(1 - post, means[1])
        cov = rest.T @ (rest * share[:, None])
        scale = np.sqrt(np.outer(np.diag(cov), np.diag(cov))) + 1e-9
        return (np.abs(cov / scale) > DEPENDENT) & ~np.eye(k, dtype=bool)

    for t in range(1, 2 * rounds * steps + 1):
        d_lab, d_acc, d_cor = -1e-3 * lab, -1e-3 * acc, -1e-3 * cor
        for q, up, down in ((post, acc, 0.0), (1 - post, 0.0, acc)):
            a, b = lab + up + yes @ cor, lab + down + no @ cor
            top = np.maximum(np.maximum(a, b), 0)
            ea, eb = np.exp(a - top), np.exp(b - top)
            total = ea + eb + np.exp(-top)
            w = (q * share)[:, None]
            ra, rb = w * (yes - ea / total), w * (no - eb / total)
            d_lab = d_lab + (ra + rb).sum(axis=0)
            d_acc = d_acc + (rb if down is acc else ra).sum(axis=0)
            d_cor = d_cor + yes.T @ ra + no.T @ rb
        for i, (p, g) in enumerate(zip(params, (d_lab, d_acc, np.where(pairs, (d_cor + d_cor.T) / 2, 0)), strict=True)):
            m[i], s[i] = 0.9 * m[i] + 0.1 * g, 0.99 * s[i] + 0.01 * g * g
            p += 0.05 * (m[i] / (1 - 0.9**t)) / (np.sqrt(s[i] / (1 - 0.99**t)) + 1e-4)
        np.maximum(acc, 0, out=acc)
        if t % steps == 0:
            post = posterior()
        if t == rounds * steps:
            pairs = dependent()
    return post[back], acc, cor


def fit_linear(rows: list[np.ndarray], form: np.ndarray, n_features: int, y: np.ndarray, rounds: int = 300) -> np.ndarray:
    """Logistic regression on soft labels: weights of features and forms, and the bias last."""
    at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    col = np.concatenate(rows) if rows else np.empty(0, np.int64)
    w, m, s = (np.zeros(n_features + form.shape[1] + 1) for _ in range(3))
    w[-1] = np.log(np.clip(y.mean(), 0.01, 0.99) / np.clip(1 - y.mean(), 0.01, 0.99))
    for t in range(1, rounds + 1):
        z = np.bincount(at, w[col], len(y)) + form @ w[n_features:-1] + w[-1]
        d = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(y)
        g = np.concatenate([np.bincount(col, d[at], n_features), form.T @ d, [d.sum()]])
        g[:-1] += 1e-5 * w[:-1]
        m, s = 0.9 * m + 0.1 * g, 0.999 * s + 0.001 * g * g
        w -= 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-9)
    return w


#: What a score reads besides the mined features: lexicons, the first four patterns, the forms.
N_EXTRA = N_LEXICONS + 4 + 3


@dataclass
class Model:
    odds: dict[str, tuple[float, int]]
    index: dict[str, int]
    weights: np.ndarray
    accuracies: np.ndarray
    correlations: np.ndarray

    def score(self, text: str) -> float:
        own, extra, _ = self.look(text)
        index, w = self.index, self.weights
        z = float(w[[index[f] for f in own]].sum()) + float(np.dot(extra, w[len(index) : -1])) + float(w[-1])
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def look(self, text: str, voting: bool = False) -> tuple[list[str], list[float], list[int]]:
        """The mined features of a text, what else a score reads, and the votes if asked for."""
        odds, low = self.odds, text.lower()
        listed = WORD.findall(low)
        words = set(listed)
        own = [w for w in words if w in odds] + [b for b in beginnings(words) if b in odds]
        found, patterns = insults(text, low, words)
        form = forms(text)
        lexicons = [0.0] * N_LEXICONS
        for w in found:
            for k in INSULTS[w]:
                lexicons[k] = 1.0
        cast = []
        if voting:
            repeated = any(listed.count(w) > 1 for w in [*found, *(f for f in own if f[0] != "^")])
            cast = votes([(f, *odds[f]) for f in own], language(words), len(words), found, patterns, repeated, form)
        return own, [*lexicons, *patterns, *form], cast


def fit(docs: DataFrame, labels: DataFrame, keep: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", bound: int = TRAIN_ROWS) -> Model:
    """Learn from labelled rows for which keep holds; without any, a model that scores 0.5 throughout."""
    chosen = stored(labelled_sample(docs, labels, id_col, text_col, label_col, keep, bound).repartition(24, F.xxhash64("id")), "toxic-rows")
    sample = stored(without_copies(chosen).repartition(24, F.xxhash64("id")), "toxic-sample")
    rows = sample.count()
    top = mined(sample, rows) if rows else []
    odds = {f: (o, lang) for f, o, lang in top}
    index = {f: i for i, (f, *_) in enumerate(top)}
    blank = Model(odds, index, np.zeros(len(index) + N_EXTRA + 1), np.zeros(0), np.zeros((0, 0)))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen = [blank.look(t.as_py(), voting=True) for t in b.column(1)]
            own = pa.array([[index[f] for f in o] for o, *_ in seen], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), own, pa.array([x for _, x, _ in seen], pa.list_(pa.float64())), pa.array([c for *_, c in seen], pa.list_(pa.int32())), b.column(2)], names=["id", "own", "extra", "vote", "y"])

    kind = dict(sample.dtypes)["id"]
    got = sample.mapInArrow(look, f"id {kind}, own array<int>, extra array<double>, vote array<int>, y int").orderBy("id").toArrow() if rows else None
    if got is None or not got.num_rows:
        return blank
    y = np.array(got["y"].to_numpy(), float)
    extra = np.array(got["extra"].to_pylist())
    post, accuracies, correlations = label_model(np.array(got["vote"].to_pylist()), float(np.clip((y == 1).mean(), 0.01, 0.99)))
    own = [np.array(x, np.int64) for x in got["own"].to_pylist()]
    return Model(odds, index, fit_linear(own, extra, len(index), post), accuracies, correlations)


def score_texts(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every row of docs."""
    rows = id_and_text(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([model.score(t.as_py()) for t in b.column(1)], pa.float64())], names=["id", "score"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, score double")


def op5_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    model = fit(docs, labels, fold(labels["doc_id"], 5) != 0)
    held = F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False))
    scored = score_texts(docs, model).withColumnRenamed("id", "doc_id")
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
