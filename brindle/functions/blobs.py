"""Blobs: archive compression and the binary form of JSON, as Arrow-batched UDFs."""

from __future__ import annotations

import json
import zlib

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .jsons import minified, relaxed

#: Element types of the binary form (fixed values of the format).
NULL, TRUE, FALSE, INT, INT5, FLOAT, FLOAT5, TEXT, TEXTJ, TEXT5, TEXTRAW, ARRAY, OBJECT = range(13)


@F.pandas_udf(T.BinaryType())
def sqlar_compress(x: pd.Series) -> pd.Series:
    """zlib, or the blob itself where that is no shorter; NULL for NULL."""

    def one(v: bytes | None) -> bytes | None:
        if v is None:
            return None
        packed = zlib.compress(bytes(v))
        return packed if len(packed) < len(v) else v

    return x.map(one)


@F.pandas_udf(T.BinaryType())
def sqlar_uncompress(x: pd.Series, size: pd.Series) -> pd.Series:
    """The blob of this size; one that already has it (or a size of 0 or less) is itself, a broken one NULL."""

    def one(v: bytes | None, n: float) -> bytes | None:
        if v is None or pd.isna(n) or n <= 0 or n == len(v):
            return v
        try:
            return zlib.decompress(bytes(v))
        except zlib.error:
            return None

    return pd.Series([one(v, n) for v, n in zip(x, size, strict=True)], dtype=object)


def element(kind: int, payload: bytes) -> bytes:
    """Header and payload: sizes up to 11 stand in the header, longer ones in 1, 2, 4 or 8 bytes after it."""
    n = len(payload)
    if n <= 11:
        return bytes([n << 4 | kind]) + payload
    code, width = next((c, w) for c, w in ((12, 1), (13, 2), (14, 4), (15, 8)) if n < 1 << 8 * w)
    return bytes([code << 4 | kind]) + n.to_bytes(width, "big") + payload


def encoded(v: object) -> bytes:
    if v is None or v is True or v is False:
        return element({None: NULL, True: TRUE, False: FALSE}[v], b"")
    if isinstance(v, (int, float)):
        return element(INT if isinstance(v, int) else FLOAT, json.dumps(v).encode())
    if isinstance(v, str):
        told = minified(v)[1:-1]
        return element(TEXT if told == v else TEXTJ, told.encode("utf-8", "surrogatepass"))
    if isinstance(v, list):
        return element(ARRAY, b"".join(map(encoded, v)))
    return element(OBJECT, b"".join(encoded(k) + encoded(x) for k, x in v.items()))


def bounds(b: bytes, at: int) -> tuple[int, int, int]:
    """Type, start and end of the payload of the element at a place."""
    kind, size = b[at] & 15, b[at] >> 4
    at += 1
    if size > 11:
        width = 1 << (size - 12)
        size, at = int.from_bytes(b[at : at + width], "big"), at + width
    if kind > OBJECT or at + size > len(b):
        raise ValueError("malformed binary JSON")
    return kind, at, at + size


def decoded(b: bytes) -> object:
    """The document of a blob; ValueError if it is malformed."""

    def read(at: int) -> tuple[object, int]:
        kind, start, end = bounds(b, at)
        if kind in (ARRAY, OBJECT):
            parts, at = [], start
            while at < end:
                v, at = read(at)
                parts.append(v)
            if at != end or (kind == OBJECT and len(parts) % 2):
                raise ValueError("malformed binary JSON")
            return (parts if kind == ARRAY else dict(zip(parts[::2], parts[1::2], strict=True))), end
        own = b[start:end].decode("utf-8", "surrogatepass")
        if kind in (NULL, TRUE, FALSE):
            return {NULL: None, TRUE: True, FALSE: False}[kind], end
        if kind == INT5:
            return int(own, 16 if "x" in own.lower() else 10), end
        if kind in (INT, FLOAT, FLOAT5):
            return (int(own) if kind == INT else float(own)), end
        return (own if kind in (TEXT, TEXTRAW) else relaxed(f'"{own}"')), end

    if not b:
        raise ValueError("malformed binary JSON")
    v, end = read(0)
    if end != len(b):
        raise ValueError("malformed binary JSON")
    return v


def _or_null(f, x: object) -> object:  # noqa: ANN001
    try:
        return None if x is None else f(x)
    except (ValueError, IndexError):
        return None


@F.pandas_udf(T.BinaryType())
def jsonb(x: pd.Series) -> pd.Series:
    """The binary form of JSON text; NULL for NULL and for what does not parse."""
    return x.map(lambda s: _or_null(lambda t: encoded(relaxed(t)), s))


@F.pandas_udf(T.StringType())
def jsonb_text(x: pd.Series) -> pd.Series:
    """Minified text of a binary document; NULL for NULL and for a malformed blob."""
    return x.map(lambda b: _or_null(lambda c: minified(decoded(bytes(c))), b))


@F.pandas_udf(T.IntegerType())
def jsonb_valid(x: pd.Series) -> pd.Series:
    """json_valid(x, 8): 1 if the blob is well formed throughout."""
    return x.map(lambda b: None if b is None else int(_or_null(lambda c: (decoded(bytes(c)),), b) is not None)).astype("Int32")
