"""Secret scan: Aho-Corasick keyword prefilter, anchored regular expressions, checksums.

One automaton pass over a lower-cased, code-point-aligned copy of the text
finds keyword hits.  Regular expressions run anchored at those hits only, and
the token kinds that embed a checksum are kept only when it holds.  A run of
hexadecimal digits has no keyword; its literal is sixteen marks in a row of a
mask of the text, found with a substring search.

Null text counts as empty; an empty text has no span.  Each input row gives one
output row, repeated rows included, and offsets count code points.  Texts of
any length are scanned whole; an empty table gives no row, and further columns
play no part, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import id_and_text, with_id

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
GITHUB = re.compile(r"gh[pousr]_[A-Za-z0-9]{36}(?![A-Za-z0-9])")
NPM = re.compile(r"npm_[A-Za-z0-9]{36}(?![A-Za-z0-9])")
XPRV = re.compile(r"xprv[1-9A-HJ-NP-Za-km-z]{107}(?![1-9A-HJ-NP-Za-km-z])")
AGE = re.compile(r"AGE-SECRET-KEY-1[02-9AC-HJ-NP-Z]{58}(?![A-Z0-9])")

BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
BASE58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
BECH32 = "qpzry9x8gf2tvdw0s3jn54khce6mua7l"

#: The kinds in the order in which spans of the same start are listed.
KINDS = ("assign", "access", "hex", "github", "npm", "xprv", "age")
BASE_KINDS = KINDS[:3]
KEYWORDS = {
    "assign": ("password", "passwd", "secret", "token", "apikey", "api_key"),
    "access": ("akia",),
    "github": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"),
    "npm": ("npm_",),
    "xprv": ("xprv",),
    "age": ("age-secret-key-1",),
}
HEX_MARKS = bytes(1 if chr(b) in "0123456789abcdef" else 0 for b in range(256))


def crc_base62_holds(token: str) -> bool:
    """prefix_ + 30 characters + 6 digits in base 62: the CRC-32 of the 30."""
    body, digits = token[4:-6], token[-6:]
    value = 0
    for c in digits:
        value = value * 62 + BASE62.index(c)
    return value == zlib.crc32(body.encode())


def base58check_holds(token: str) -> bool:
    """The last four bytes are the first of the double SHA-256 of the others."""
    value = 0
    for c in token:
        value = value * 58 + BASE58.index(c)
    try:
        raw = value.to_bytes(82, "big")
    except OverflowError:
        return False
    return hashlib.sha256(hashlib.sha256(raw[:-4]).digest()).digest()[:4] == raw[-4:]


def bech32_holds(token: str) -> bool:
    """The BCH checksum over the expanded prefix and all data characters is 1."""
    prefix, _, data = token.lower().rpartition("1")
    values = [ord(c) >> 5 for c in prefix] + [0] + [ord(c) & 31 for c in prefix] + [BECH32.index(c) for c in data]
    check = 1
    for v in values:
        top = check >> 25
        check = (check & 0x1FFFFFF) << 5 ^ v
        for i, g in enumerate((0x3B6A57B2, 0x26508E6D, 0x1EA119FA, 0x3D4233DD, 0x2A1462B3)):
            check ^= g if top >> i & 1 else 0
    return check == 1


RULES = {
    "assign": (ASSIGN, lambda m: len(m[2]) >= 12),
    "access": (ACCESS, lambda m: len(m[0]) >= 18),
    "github": (GITHUB, lambda m: crc_base62_holds(m[0])),
    "npm": (NPM, lambda m: crc_base62_holds(m[0])),
    "xprv": (XPRV, lambda m: base58check_holds(m[0])),
    "age": (AGE, lambda m: bech32_holds(m[0])),
}


def automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for kind, words in KEYWORDS.items():
        for w in words:
            a.add_word(w, (kind, len(w)))
    a.make_automaton()
    return a


def find_secrets(text: str, auto: ahocorasick.Automaton) -> list[tuple[str, int, int]]:
    """All spans (kind, start, end) by start, then kind; leftmost and disjoint within a kind."""
    flat = text.encode("ascii", "replace")  # one byte for each code point
    spans: list[tuple[int, int, int]] = []
    last: dict[str, int] = {}
    hits = sorted((end - n + 1, kind) for end, (kind, n) in auto.iter(flat.lower().decode("ascii")))
    for start, kind in hits:
        if start < last.get(kind, 0):
            continue
        pattern, holds = RULES[kind]
        if m := pattern.match(text, start):
            last[kind] = m.end()
            if holds(m):
                spans.append((start, KINDS.index(kind), m.end()))
    marks, run, at = flat.translate(HEX_MARKS), b"\x01" * 16, 0
    while (at := marks.find(run, at)) >= 0:
        end = HEX.match(text, at).end()
        spans.append((at, 2, end))
        at = end
    return [(KINDS[k], s, e) for s, k, e in sorted(spans)]


SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("stop", T.LongType())]))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans): one row for each row of docs, spans as array<struct<kind, start, stop>>."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = automaton()
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64())]))
        for b in batches:
            found = [[{"kind": k, "start": s, "stop": e} for k, s, e in find_secrets(t, auto)] for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, kind)], names=["id", "spans"])

    rows = id_and_text(docs, id_col, text_col)
    return rows.mapInArrow(scan, with_id(rows, ("spans", SPANS)))


def op1_secrets(docs: DataFrame) -> DataFrame:
    """The digest columns of the contract, derived from the spans."""
    told = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")
    count = lambda kinds: F.size(F.filter("spans", lambda s: s["kind"].isin(*kinds))).cast("long")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    return scan_secrets(docs).select(
        F.col("id").alias("doc_id"),
        *(count([k]).alias(f"n_{k}") for k in BASE_KINDS),
        F.sha2(told(base), 256).alias("base_sha256"),
        told(F.col("spans")).alias("spans"),
        count(KINDS[3:]).alias("n_checked"),
    )
