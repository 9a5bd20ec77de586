"""JSON scalars over text.

Reading uses Spark's own functions.  Functions that return a changed document
keep the order of keys, which a VARIANT does not, so they run as Arrow-batched
UDFs over Python's json; input may use the common JSON5 relaxations.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

STEP = re.compile(r'\.("(?:[^"\\]|\\.)*"|[^.\[]+)|\[(#?-?\d*|#)\]')
ABSENT = object()


def steps(path: str) -> list[str | tuple[str, int]]:
    """``$.a[0][#-1][#]`` as keys, ("at", n), ("end", n) and ("append", 0)."""
    if not path.startswith("$"):
        raise ValueError(f"bad JSON path {path!r}")
    out, pos = [], 1
    while pos < len(path):
        m = STEP.match(path, pos)
        if not m:
            raise ValueError(f"bad JSON path {path!r}")
        if m[1] is not None:
            out.append(json.loads(m[1]) if m[1].startswith('"') else m[1])
        elif m[2] == "#":
            out.append(("append", 0))
        elif m[2].startswith("#-"):
            out.append(("end", int(m[2][2:])))
        else:
            out.append(("at", int(m[2])))
        pos = m.end()
    return out


def relaxed(text: str) -> object:
    """JSON, or the JSON5 forms with unquoted keys, single quotes, comments and trailing commas."""
    try:
        return json.loads(text, parse_constant=lambda c: None)
    except ValueError:
        pass
    t = re.sub(r"/\*.*?\*/|//[^\n]*", " ", text, flags=re.DOTALL)
    t = re.sub(r"'((?:[^'\\]|\\.)*)'", lambda m: json.dumps(m[1].replace("\\'", "'")), t)
    t = re.sub(r"([{,]\s*)([A-Za-z_$][\w$]*)(\s*:)", r'\1"\2"\3', t)
    t = re.sub(r",(\s*[}\]])", r"\1", t)
    t = re.sub(r"(?<![\w.])\+(\d)", r"\1", re.sub(r"(?<![\w.])\.(\d)", r"0.\1", t))
    return json.loads(t)


def minified(v: object) -> str:
    return json.dumps(v, separators=(",", ":"), ensure_ascii=False)


def place(seq: list, step: tuple[str, int]) -> int:
    kind, n = step
    return len(seq) if kind == "append" else len(seq) - n if kind == "end" else n


def edit(doc: object, path: list, value: object, create: bool, replace: bool, insert: bool = False) -> object:
    """doc with value at path: created, overwritten or (insert) put before an index."""
    if not path:
        return value if replace else doc
    step, rest = path[0], path[1:]
    if isinstance(step, str) and isinstance(doc, dict):
        if step in doc:
            return {k: edit(v, rest, value, create, replace, insert) if k == step else v for k, v in doc.items()}
        if create and not insert:
            return doc | {step: edit(fresh(rest), rest, value, True, True)}
    elif not isinstance(step, str) and isinstance(doc, list):
        i = place(doc, step)
        if insert and not rest:
            return [*doc[:i], value, *doc[i:]] if 0 <= i <= len(doc) else doc
        if 0 <= i < len(doc):
            return [*doc[:i], edit(doc[i], rest, value, create, replace, insert), *doc[i + 1 :]]
        if i == len(doc) and create and not insert:
            return [*doc, edit(fresh(rest), rest, value, True, True)]
    return doc


def fresh(path: list) -> object:
    return None if not path else {} if isinstance(path[0], str) else []


def without(doc: object, path: list) -> object:
    if not path:
        return None
    step, rest = path[0], path[1:]
    if isinstance(step, str) and isinstance(doc, dict) and step in doc:
        return {k: without(v, rest) if rest else v for k, v in doc.items() if rest or k != step} if not rest else doc | {step: without(doc[step], rest)}
    if not isinstance(step, str) and isinstance(doc, list) and 0 <= (i := place(doc, step)) < len(doc):
        return [*doc[:i], *([without(doc[i], rest)] if rest else []), *doc[i + 1 :]]
    return doc


def merged(target: object, patch: object) -> object:
    """RFC 7396."""
    if not isinstance(patch, dict):
        return patch
    out = dict(target) if isinstance(target, dict) else {}
    for k, v in patch.items():
        if v is None:
            out.pop(k, None)
        else:
            out[k] = merged(out.get(k), v)
    return out


def _document(f: Callable[[object], object], text: bool = True) -> Callable[[Column], Column]:
    """A UDF over parsed documents; NULL for NULL and for what does not parse."""

    def one(s: str | None) -> str | None:
        if s is None:
            return None
        try:
            v = f(relaxed(s))
        except ValueError:
            return None
        return minified(v) if text else v

    @F.pandas_udf(T.StringType())
    def run(x: pd.Series) -> pd.Series:
        return x.map(one)

    return run


def json_(x: Column) -> Column:
    """Validated and minified, keys in their order."""
    return _document(lambda v: v)(x)


def set_(x: Column, *pairs: object) -> Column:
    return _edit(x, pairs, True, True)


def insert(x: Column, *pairs: object) -> Column:
    return _edit(x, pairs, True, False)


def replace(x: Column, *pairs: object) -> Column:
    return _edit(x, pairs, False, True)


def array_insert(x: Column, *pairs: object) -> Column:
    return _edit(x, pairs, False, False, True)


def _edit(x: Column, pairs: tuple, create: bool, overwrite: bool, before: bool = False) -> Column:
    todo = [(steps(p), v) for p, v in zip(pairs[::2], pairs[1::2], strict=True)]

    def run(doc: object) -> object:
        for path, v in todo:
            doc = edit(doc, path, v, create, overwrite, before)
        return doc

    return _document(run)(x)


def remove(x: Column, *paths: str) -> Column:
    todo = [steps(p) for p in paths]

    def run(doc: object) -> object:
        for p in todo:
            doc = without(doc, p)
        return doc

    return _document(run)(x)


def patch(x: Column, change: str) -> Column:
    delta = relaxed(change)
    return _document(lambda doc: merged(doc, delta))(x)


def pretty(x: Column, indent: str = "    ") -> Column:
    return _document(lambda doc: json.dumps(doc, indent=indent, ensure_ascii=False), text=False)(x)


@F.pandas_udf(T.LongType())
def error_position(x: pd.Series) -> pd.Series:
    """1-based character of the first error, 0 for valid JSON."""

    def one(s: str | None) -> int | None:
        if s is None:
            return None
        try:
            relaxed(s)
        except json.JSONDecodeError as e:
            return e.pos + 1
        return 0

    return x.map(one).astype("Int64")


# Built-ins ------------------------------------------------------------------


def spark_path(path: str) -> str:
    return path if path.startswith("$") else f"$[{path}]" if path.isdigit() else f"$.{path}"


def extract_text(x: Column, path: str) -> Column:
    """``x ->> path``: the SQL value as text; JSON null is NULL, true and false are 1 and 0."""
    raw = F.get_json_object(x, spark_path(path))
    kind = json_type(x, path)
    return F.when(kind == "true", "1").when(kind == "false", "0").when(kind != "null", raw)


def extract_json(x: Column, path: str) -> Column:
    """``x -> path``: the member as JSON text."""
    return F.to_json(F.try_variant_get(F.try_parse_json(x), spark_path(path), "variant"))


def extract(x: Column, path: str, kind: str = "string") -> Column:
    return extract_text(x, path).try_cast(kind)


def json_type(x: Column, path: str = "$") -> Column:
    """null, true, false, integer, real, text, array or object; NULL for a missing path."""
    v = F.try_variant_get(F.try_parse_json(x), spark_path(path), "variant")
    kind = F.schema_of_variant(v)
    return (
        F.when(F.is_variant_null(v), "null").when(kind == "BOOLEAN", F.to_json(v)).when(kind == "BIGINT", "integer").when(kind.startswith("DECIMAL") | (kind == "DOUBLE"), "real")
        .when(kind == "STRING", "text").when(kind.startswith("ARRAY"), "array").when(kind.startswith("OBJECT"), "object")
    )


def valid(x: Column) -> Column:
    """Strict JSON."""
    return F.when(x.isNotNull(), F.try_parse_json(x).isNotNull().cast("int"))


def array_length(x: Column, path: str = "$") -> Column:
    """0 for what is no array, NULL for a missing path."""
    member = F.get_json_object(x, spark_path(path))
    return F.when(json_type(x, path).isNotNull(), F.coalesce(F.json_array_length(member), F.lit(0))).cast("long")


def quote(x: Column, text: bool = True) -> Column:
    """A SQL value as JSON."""
    out = F.regexp_extract(F.to_json(F.struct(x.alias("v"))), r'(?s)^\{"v":(.*)\}$', 1)
    return F.when(x.isNull(), "null").otherwise(out)


def array(*xs: Column) -> Column:
    """NULL is a member."""
    return F.concat(F.lit("["), F.concat_ws(",", *(quote(x) for x in xs)), F.lit("]"))


def object_(*pairs: object) -> Column:
    """Keys in the order given."""
    members = [F.concat(quote(F.lit(k)), F.lit(":"), quote(v)) for k, v in zip(pairs[::2], pairs[1::2], strict=True)]
    return F.concat(F.lit("{"), F.concat_ws(",", *members), F.lit("}"))
