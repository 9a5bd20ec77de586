"""Keyword ranking: postings, two BM25 variants, coverage, proximity, the match-expression language, vocabulary, snippets.

Postings are a DataFrame (id, term, tf, positions); a query joins its few terms
with them.  Document frequencies and lengths are those of the whole corpus,
also under a filter.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.strings import lower
from . import tokenize

K1, B = 1.2, 0.75
COVERAGE, PROXIMITY, PHRASE, RESCORE = 3.0, 1.0, 0.75, 6
#: Stored postings are laid out by this many hash classes of their terms.
BUCKETS = 64


def postings(docs: DataFrame, key: str, tokens: Column) -> DataFrame:
    """(id, term, tf, positions, length): one row a document and term, with the document's number of tokens.

    A filter on terms reaches the tokens.  For all terms ``entries`` is cheaper.
    """
    sized = docs.select(F.col(key).alias("id"), tokens.alias("t")).select("id", "t", F.size("t").alias("length"))
    words = sized.select("id", "length", F.posexplode("t").alias("pos", "term"))
    return words.groupBy("id", "term").agg(F.count(F.lit(1)).alias("tf"), F.sort_array(F.collect_list("pos")).alias("positions"), F.max("length").alias("length"))


def entries(docs: DataFrame, key: str, tokens: Column) -> DataFrame:
    """The rows of ``postings`` for every term, grouped inside each document without a shuffle."""
    own = docs.select(F.col(key).alias("id"), tokens.alias("t"))
    kind = own.schema["id"].dataType.simpleString()

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                part = batch.slice(begin, 256)
                rows, terms, lengths, flat, ends = [], [], [], [], [0]
                for row, words in enumerate(part.column(1).to_pylist()):
                    at: dict[str, list[int]] = {}
                    for i, word in enumerate(words or ()):
                        at.setdefault(word, []).append(i)
                    for word, places in at.items():
                        rows.append(row)
                        terms.append(word)
                        lengths.append(len(words))
                        flat += places
                        ends.append(len(flat))
                places = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))
                tf = pa.array(np.diff(ends).astype(np.int64))
                ids = part.column(0).take(pa.array(rows, pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, pa.array(terms, pa.string()), tf, places, pa.array(lengths, pa.int32())], ["id", "term", "tf", "positions", "length"])

    return own.mapInArrow(build, f"id {kind}, term string, tf bigint, positions array<int>, length int")


def length_of(tokens: Column) -> Column:
    """The number of tokens; a null text is an empty one."""
    return F.coalesce(F.size(tokens), F.lit(0))


def bucket_of(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def of_terms(post: DataFrame, terms: list[str]) -> DataFrame:
    """The postings of some terms; of stored ones only their buckets are read."""
    rows = post.filter(F.col("term").isin(terms))
    if "bucket" not in post.columns or not terms:
        return rows
    return rows.filter(F.col("bucket").isin([bucket_of(F.lit(x)) for x in terms]))


def vocabulary(post: DataFrame) -> DataFrame:
    """(term, doc, cnt): documents with the term and its occurrences."""
    return post.groupBy("term").agg(F.count(F.lit(1)).alias("doc"), F.sum("tf").alias("cnt"))


def instances(post: DataFrame) -> DataFrame:
    """(term, id, offset): every occurrence."""
    return post.select("term", "id", F.explode("positions").alias("offset"))


@dataclass
class Corpus:
    """Postings with the corpus' number of documents and mean length, which any query needs."""

    post: DataFrame
    n: int
    mean: float

    @classmethod
    def of(cls, docs: DataFrame, key: str, tokens: Column) -> Corpus:
        n, mean = docs.select(length_of(tokens).alias("length")).agg(F.count(F.lit(1)), F.avg("length")).first()
        return cls(postings(docs, key, tokens), n, mean or 1.0)


def _weights(c: Corpus, terms: list[str], idf: Column) -> DataFrame:
    """(term, idf) of the query's terms."""
    return of_terms(c.post, terms).groupBy("term").agg(F.count(F.lit(1)).alias("df")).select("term", idf.alias("idf"))


def bm25(c: Corpus, terms: list[str], k1: float = K1, b: float = B, coverage: float = 0.0, keep: DataFrame | None = None) -> DataFrame:
    """(id, score, matched) with idf ln(1 + (N - n + .5) / (n + .5)); any term may match.

    ``coverage`` multiplies by the matched share of idf to that power; ``keep`` (id) filters before ranking.
    """
    terms = sorted(set(terms))
    weight = _weights(c, terms, F.log(1 + (c.n - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    hits = of_terms(c.post, terms).join(F.broadcast(weight), "term")
    if keep is not None:
        hits = hits.join(keep, "id", "left_semi")
    part = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / c.mean))
    scored = hits.groupBy("id").agg(F.sum(part).alias("score"), F.count(F.lit(1)).alias("matched"), F.sum("idf").alias("found"))
    if coverage:
        whole = weight.agg(F.sum("idf").alias("whole"))
        scored = scored.crossJoin(F.broadcast(whole)).withColumn("score", F.col("score") * F.pow(F.col("found") / F.col("whole"), coverage))
    return scored.select("id", "score", "matched")


def fts_bm25(c: Corpus, terms: list[str], k1: float = K1, b: float = B) -> DataFrame:
    """(id, rank): idf ln((N - n + .5) / (n + .5)), at least 1e-6, negated so that better is smaller; all terms must match."""
    terms = sorted(set(terms))
    weight = _weights(c, terms, F.greatest(F.log((c.n - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6)))
    hits = of_terms(c.post, terms).join(F.broadcast(weight), "term")
    part = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / c.mean))
    return hits.groupBy("id").agg((-F.sum(part)).alias("rank"), F.count(F.lit(1)).alias("m")).filter(F.col("m") == len(terms)).select("id", "rank")


def ceiling(c: Corpus, terms: list[str]) -> DataFrame:
    """The score that no document can pass: the sum of idf (k1 + 1) over the known terms."""
    weight = _weights(c, sorted(set(terms)), F.log(1 + (c.n - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    return weight.agg(F.coalesce(F.sum("idf"), F.lit(0.0)) * (K1 + 1)).toDF("ceiling")


def smallest_window(lists: list[list[int]]) -> int:
    """Width of the smallest span that holds one position of every list."""
    events = sorted((p, k) for k, ps in enumerate(lists) for p in ps)
    last: dict[int, int] = {}
    best = 1 << 30
    for p, k in events:
        last[k] = p
        if len(last) == len(lists):
            best = min(best, p - min(last.values()) + 1)
    return best


def ordered_run(terms: list[str], at: dict[str, list[int]]) -> int:
    """The longest run of consecutive query terms at consecutive positions."""
    best = 0
    for i, t in enumerate(terms):
        for p in at.get(t, ()):
            n = 1
            while i + n < len(terms) and p + n in at.get(terms[i + n], ()):
                n += 1
            best = max(best, n)
    return best


def rescored(c: Corpus, hits: DataFrame, terms: list[str], k: int, proximity: float = PROXIMITY, phrase: float = PHRASE) -> DataFrame:
    """The best RESCORE k hits with their scores changed for closeness and order of the terms; the rest as they were."""
    top = hits.orderBy(F.desc("score"), "id").limit(RESCORE * k)
    found = of_terms(c.post, sorted(set(terms))).join(F.broadcast(top), "id")
    grouped = found.groupBy("id", "score", "matched").agg(F.map_from_entries(F.collect_list(F.struct("term", "positions"))).alias("at"))

    @F.pandas_udf(T.DoubleType())
    def factor(at: pd.Series) -> pd.Series:
        def one(m: object) -> float:
            m = {t: list(ps) for t, ps in dict(m).items()}
            near = len(m) / smallest_window(list(m.values()))
            run = ordered_run(terms, m) / max(1, len(terms))
            return (1 - proximity + proximity * near) * (1 - phrase + phrase * run)

        return at.map(one)

    best = grouped.select("id", (F.col("score") * factor("at")).alias("score"), "matched")
    rest = hits.join(F.broadcast(top.select("id")), "id", "left_anti").select("id", "score", "matched")  # top: RESCORE k rows
    return best.unionByName(rest)


# Match expressions -------------------------------------------------------------

LEX = re.compile(r'\s*(?:"((?:[^"]|"")*)"(\s*\*)?|(\()|(\))|(\+)|(\^)|(:)|(\{)|(\})|([^\s()":+^{}]+))')


@dataclass
class Phrase:
    words: list[str]
    prefix: bool = False
    first: bool = False
    columns: list[str] | None = None


def parse_match(text: str, words_of=lambda s: re.findall(r"[a-z0-9]+", s.lower())) -> tuple:  # noqa: ANN001
    """AND, OR, NOT, implicit AND, phrases, ``prefix*``, ``^first``, ``NEAR(a b, n)`` and ``column : x`` as nested tuples."""
    toks: list[tuple[str, str, bool]] = []
    pos = 0
    while pos < len(text.rstrip()):
        m = LEX.match(text, pos)
        if not m:
            raise ValueError(f"bad match expression at {pos}: {text!r}")
        pos = m.end()
        if m[1] is not None:
            toks.append(("str", m[1].replace('""', '"'), bool(m[2])))
        elif m[10]:
            w = m[10]
            toks.append(("word", w.rstrip("*,"), w.rstrip(",").endswith("*")) if w not in (",",) else ("comma", ",", False))
            if w.endswith(",") and w != ",":
                toks.append(("comma", ",", False))
        else:
            toks.append(("op", m[0].strip(), False))
    i = 0

    def peek() -> str:
        return toks[i][1] if i < len(toks) else ""

    def is_op(v: str) -> bool:
        return i < len(toks) and toks[i][0] in ("op", "word") and toks[i][1] == v

    def either() -> tuple:
        nonlocal i
        left = both()
        while is_op("OR"):
            i += 1
            left = ("or", left, both())
        return left

    def both() -> tuple:
        nonlocal i
        left = negated()
        while i < len(toks) and not is_op("OR") and not is_op(")"):
            if is_op("AND"):
                i += 1
            left = ("and", left, negated())
        return left

    def negated() -> tuple:
        nonlocal i
        left = unit(None)
        while is_op("NOT"):
            i += 1
            left = ("not", left, unit(None))
        return left

    def unit(columns: list[str] | None) -> tuple:
        nonlocal i
        if is_op("{"):
            names = []
            i += 1
            while not is_op("}"):
                names.append(peek())
                i += 1
            i += 2
            return unit(names)
        if i + 1 < len(toks) and toks[i + 1][:2] == ("op", ":"):
            name = peek()
            i += 2
            return unit([name])
        if is_op("("):
            i += 1
            inner = either()
            i += 1
            return inner
        if is_op("NEAR") and i + 1 < len(toks) and toks[i + 1][1] == "(":
            i += 2
            own, distance = [], 10
            while not is_op(")"):
                if toks[i][0] == "comma":
                    distance = int(toks[i + 1][1])
                    i += 2
                    continue
                own.append(Phrase(words_of(toks[i][1]), toks[i][2], columns=columns))
                i += 1
            i += 1
            return ("near", own, distance)
        first = is_op("^")
        i += first
        kind, value, star = toks[i]
        i += 1
        words = words_of(value)
        while is_op("+"):
            words += words_of(toks[i + 1][1])
            star = toks[i + 1][2]
            i += 2
        return ("phrase", Phrase(words, star, first, columns))

    if not toks:
        return ("phrase", Phrase([]))
    out = either()
    if i < len(toks):
        raise ValueError(f"unexpected {peek()!r} in match expression")
    return out


def phrase_hits(post: DataFrame, p: Phrase) -> DataFrame:
    """(id, start, stop) of a phrase's occurrences."""
    if not p.words:
        return post.select("id", F.lit(0).alias("start"), F.lit(0).alias("stop")).limit(0)
    if p.columns is not None and "column" in post.columns:
        post = post.filter(F.col("column").isin(p.columns))
    out = None
    for k, w in enumerate(p.words):
        last = k == len(p.words) - 1
        own = post.filter(F.col("term").startswith(w)) if p.prefix and last else of_terms(post, [w])
        own = own.select("id", F.explode("positions").alias("pos")).select("id", (F.col("pos") - k).alias("start")).distinct()
        out = own if out is None else out.join(own, ["id", "start"])
    out = out.filter("start = 0") if p.first else out
    return out.select("id", "start", (F.col("start") + len(p.words) - 1).alias("stop"))


def match(post: DataFrame, expression: str | tuple) -> DataFrame:
    """The ids that a match expression selects: set algebra over postings, position joins for phrases and NEAR."""
    e = parse_match(expression) if isinstance(expression, str) else expression
    if e[0] == "phrase":
        return phrase_hits(post, e[1]).select("id").distinct()
    if e[0] == "near":
        hits = [phrase_hits(post, p) for p in e[1]]
        out = hits[0].select("id", F.col("start").alias("lo"), F.col("stop").alias("hi"))
        for h in hits[1:]:
            merged = out.join(h, "id").select("id", F.least("lo", "start").alias("lo"), F.greatest("hi", "stop").alias("hi"))
            out = merged.distinct()
        span = sum(len(p.words) for p in e[1])
        return out.filter(F.col("hi") - F.col("lo") + 1 - span <= e[2]).select("id").distinct()
    left, right = match(post, e[1]), match(post, e[2])
    if e[0] == "and":
        return left.join(right, "id", "left_semi")
    if e[0] == "not":
        return left.join(right, "id", "left_anti")
    return left.union(right).distinct()


def highlight(x: Column, terms: list[str], before: str = "[", after: str = "]") -> Column:
    """Whole words among the terms (plain tokens) marked."""
    body = "|".join(re.escape(t) for t in sorted(set(terms), key=len, reverse=True))
    mark = (before + "$1" + after).replace("\\", "\\\\")
    return F.regexp_replace(x, f"(?i)(?<![a-zA-Z0-9])({body})(?![a-zA-Z0-9])", mark)


def snippet(x: Column, terms: list[str], before: str, after: str, ellipsis: str, n: int) -> Column:
    """The n tokens with most distinct matches, marked, with an ellipsis where text is left out."""
    wanted = frozenset(t.lower() for t in terms)

    @F.pandas_udf(T.StringType())
    def run(s: pd.Series) -> pd.Series:
        def one(text: str | None) -> str | None:
            if text is None:
                return None
            words = [(m.start(), m.end(), m[0].lower()) for m in re.finditer(r"[A-Za-z0-9]+", text)]
            best = max(range(max(1, len(words) - n + 1)), key=lambda i: (len({w for *_, w in words[i : i + n]} & wanted), -i), default=0)
            own = words[best : best + n]
            if not own:
                return text
            out, pos = [], own[0][0] if best else 0
            for a, b, w in own:
                out += [text[pos:a], f"{before}{text[a:b]}{after}" if w in wanted else text[a:b]]
                pos = b
            more = best + n < len(words)
            return (ellipsis if best else "") + "".join(out) + (ellipsis if more else text[pos:])

        return s.map(one)

    return run(x)


def stemmed(docs: DataFrame, key: str, text: str) -> Corpus:
    """A corpus under the search table's tokenizer."""
    return Corpus.of(docs, key, tokenize.search(F.col(text)))


# matchinfo and offsets --------------------------------------------------------

#: The simple tokenizer: ASCII letters and digits and all further code points; only A-Z are folded.
SIMPLE = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"


def matchinfo(rows: DataFrame, columns: list[str], terms: list[str], name: str = "matchinfo") -> DataFrame:
    """rows with an array<long> in the default form: terms, columns, then hits here, hits in all rows and rows with hits.

    One triple for each term and column, terms first.  The counts over all rows are one aggregate of fixed width.
    """
    tokens = {c: F.regexp_extract_all(lower(F.col(c)), F.lit(f"({SIMPLE})"), 1) for c in columns}

    def hits(column: str, term: str) -> Column:
        return F.coalesce(F.array_size(F.filter(tokens[column], lambda w: w == term)), F.lit(0)).cast("long")

    here = [hits(c, term) for term in terms for c in columns]
    counts = rows.agg(*(f for i, h in enumerate(here) for f in (F.coalesce(F.sum(h), F.lit(0)).alias(f"a{i}"), F.count_if(h > 0).alias(f"d{i}")))).first()
    triples = [x for i, h in enumerate(here) for x in (h, F.lit(counts[f"a{i}"]).cast("long"), F.lit(counts[f"d{i}"]).cast("long"))]
    return rows.withColumn(name, F.array(F.lit(len(terms)).cast("long"), F.lit(len(columns)).cast("long"), *triples))


def offsets(columns: list[Column], terms: list[str]) -> Column:
    """``column term byte_offset size`` of every hit, by column and place; empty without one."""
    at = {term: i for i, term in enumerate(terms)}
    token = re.compile("[0-9A-Za-z\x80-\U0010ffff]+")
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

    @F.pandas_udf(T.StringType())
    def run(*texts: pd.Series) -> pd.Series:
        def one(*row: str | None) -> str:
            out: list[str] = []
            for c, text in enumerate(row):
                place = seen = 0
                for m in token.finditer(text or ""):
                    if (word := m[0].translate(fold)) in at:
                        place += len(text[seen : m.start()].encode("utf-8", "surrogatepass"))
                        seen = m.start()
                        out.append(f"{c} {at[word]} {place} {len(m[0].encode('utf-8', 'surrogatepass'))}")
            return " ".join(out)

        return pd.Series([one(*row) for row in zip(*texts, strict=True)], dtype=object)

    return run(*columns)
