"""Polygons as JSON text ``[[x,y],...]``: area, containment, overlap and transforms.

Area and bounding box are expressions over an array that is parsed once; the
tests between polygons run as Arrow-batched UDFs over arrays of all rows'
vertices, whose coordinates are doubles.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

POINTS = "array<array<double>>"


def _once(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x) with x computed once, however often f names it."""
    return F.transform(F.array(x), f)[0]


def points(x: Column) -> Column:
    """The vertices; a closing vertex equal to the first is left out."""
    closed = lambda v: (F.size(v) > 3) & (F.element_at(v, 1) == F.element_at(v, -1))
    return _once(F.from_json(x, POINTS), lambda v: F.when(closed(v), F.slice(v, 1, F.size(v) - 1)).otherwise(v))


def _area(v: Column) -> Column:
    after = F.concat(F.slice(v, 2, F.greatest(F.size(v) - 1, F.lit(0))), F.slice(v, 1, 1))
    cross = F.zip_with(v, after, lambda a, b: a[0] * b[1] - b[0] * a[1])
    return F.aggregate(cross, F.lit(0.0), lambda s, c: s + c) / 2


def area(x: Column) -> Column:
    """Shoelace; counter-clockwise polygons are positive."""
    return _once(points(x), _area)


def bbox(x: Column) -> Column:
    """struct<x0, x1, y0, y1>."""
    side = lambda f, v, k: f(F.transform(v, lambda p: p[k]))
    return _once(points(x), lambda v: F.struct(side(F.array_min, v, 0).alias("x0"), side(F.array_max, v, 0).alias("x1"), side(F.array_min, v, 1).alias("y0"), side(F.array_max, v, 1).alias("y1")))


def group_bbox(x: Column) -> Column:
    """Aggregate: the box around all polygons of a group."""
    b = bbox(x)
    return F.struct(F.min(b["x0"]).alias("x0"), F.max(b["x1"]).alias("x1"), F.min(b["y0"]).alias("y0"), F.max(b["y1"]).alias("y1"))


def ccw(x: Column) -> Column:
    """The same polygon counter-clockwise."""
    turned = lambda v: F.concat(F.slice(v, 1, 1), F.reverse(F.slice(v, 2, F.greatest(F.size(v) - 1, F.lit(0)))))
    return F.to_json(_once(points(x), lambda v: F.when(_area(v) < 0, turned(v)).otherwise(v)))


def transform(x: Column, a: float, b: float, c: float, d: float, e: float, f: float) -> Column:
    """x' = a x + b y + e, y' = c x + d y + f."""
    return F.to_json(F.transform(points(x), lambda p: F.array(a * p[0] + b * p[1] + e, c * p[0] + d * p[1] + f)))


def svg(x: Column) -> Column:
    """A polyline element."""
    text = F.array_join(F.transform(points(x), lambda p: F.concat_ws(",", p[0], p[1])), " ")
    return F.concat(F.lit("<polyline points='"), text, F.lit(" "), F.concat_ws(",", points(x)[0][0], points(x)[0][1]), F.lit("'></polyline>"))


def regular(x: float, y: float, r: float, n: int) -> str:
    """A regular polygon of n vertices around (x, y)."""
    n = max(3, min(n, 1000))
    return json.dumps([[x + r * math.cos(2 * math.pi * k / n), y + r * math.sin(2 * math.pi * k / n)] for k in range(n)])


def _open(v: list) -> list:
    return v[:-1] if len(v) > 3 and v[0] == v[-1] else v


def point_in(p: tuple[float, float], poly: list) -> int:
    """2 inside, 1 on the border, 0 outside."""
    x, y = p
    inside = False
    for (x1, y1), (x2, y2) in zip(poly, [*poly[1:], poly[0]], strict=True):
        cross = (x2 - x1) * (y - y1) - (y2 - y1) * (x - x1)
        if cross == 0 and min(x1, x2) <= x <= max(x1, x2) and min(y1, y2) <= y <= max(y1, y2):
            return 1
        if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
            inside = not inside
    return 2 * inside


def _turn(a: tuple, b: tuple, c: tuple) -> float:
    return (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])


def crossing(a: list, b: list) -> bool:
    """Whether some edges cross in their inner parts."""
    edges = lambda v: list(zip(v, [*v[1:], v[0]], strict=True))
    return any(_turn(p, q, r) * _turn(p, q, s) < 0 and _turn(r, s, p) * _turn(r, s, q) < 0 for p, q in edges(a) for r, s in edges(b))


def relation(a: list, b: list) -> int:
    """0 apart, 1 overlapping, 2 a inside b, 3 b inside a, 4 the same."""
    if sorted(map(tuple, a)) == sorted(map(tuple, b)):
        return 4
    if crossing(a, b):
        return 1
    mid = lambda v: [((p[0] + q[0]) / 2, (p[1] + q[1]) / 2) for p, q in zip(v, [*v[1:], v[0]], strict=True)]
    a_in = [point_in(p, b) for p in [*map(tuple, a), *mid(a)]]
    b_in = [point_in(p, a) for p in [*map(tuple, b), *mid(b)]]
    if min(a_in) >= 1:
        return 2
    if min(b_in) >= 1:
        return 3
    return 1 if 2 in a_in or 2 in b_in else 0


#: Pairs of edges that are compared at a time; polygons of more are compared one by one.
PAIRS = 1 << 20


def points_in(px: np.ndarray, py: np.ndarray, poly: np.ndarray) -> np.ndarray:
    """point_in for points (rows, m) and polygons (rows, k, 2)."""
    x, y = px[:, :, None], py[:, :, None]
    x1, y1 = poly[:, None, :, 0], poly[:, None, :, 1]
    x2, y2 = np.roll(x1, -1, axis=2), np.roll(y1, -1, axis=2)
    cross = (x2 - x1) * (y - y1) - (y2 - y1) * (x - x1)
    border = (cross == 0) & (np.minimum(x1, x2) <= x) & (x <= np.maximum(x1, x2)) & (np.minimum(y1, y2) <= y) & (y <= np.maximum(y1, y2))
    with np.errstate(divide="ignore", invalid="ignore"):
        passed = ((y1 > y) != (y2 > y)) & (x < (x2 - x1) * (y - y1) / (y2 - y1) + x1)
    return np.where(border.any(axis=2), 1, 2 * (passed.sum(axis=2) % 2))


def relations(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """relation for polygons (rows, k, 2) and (rows, n, 2)."""
    whole = lambda v: np.sort(np.ascontiguousarray(v).view(np.complex128)[:, :, 0], axis=1)
    same = (whole(a) == whole(b)).all(axis=1) if a.shape[1] == b.shape[1] else np.zeros(len(a), bool)
    after = lambda v: np.roll(v, -1, axis=1)
    turn = lambda p, q, r: (q[..., 0] - p[..., 0]) * (r[..., 1] - p[..., 1]) - (q[..., 1] - p[..., 1]) * (r[..., 0] - p[..., 0])
    p, q, r, s = a[:, :, None], after(a)[:, :, None], b[:, None], after(b)[:, None]
    across = ((turn(p, q, r) * turn(p, q, s) < 0) & (turn(r, s, p) * turn(r, s, q) < 0)).any(axis=(1, 2))
    own = lambda v: np.concatenate([v, (v + after(v)) / 2], axis=1)
    a_in, b_in = points_in(own(a)[:, :, 0], own(a)[:, :, 1], b), points_in(own(b)[:, :, 0], own(b)[:, :, 1], a)
    touch = ((a_in == 2).any(axis=1) | (b_in == 2).any(axis=1)).astype(int)
    return np.select([same, across, a_in.min(axis=1) >= 1, b_in.min(axis=1) >= 1], [4, 1, 2, 3], touch)


def _parsed(x: pd.Series) -> tuple[np.ndarray, list, list]:
    """The number of each row's text (null: -1), the polygons of the texts, and their vertices as arrays (None if odd)."""
    numbers, texts = pd.factorize(x)
    polygons = [_open(json.loads(s)) for s in texts]
    plain = [bool(v) and all(len(p) == 2 for p in v) for v in polygons]
    return numbers, polygons, [np.array(v, np.float64) if ok else None for v, ok in zip(polygons, plain, strict=True)]


def _by_shape(rows: np.ndarray, *sides: tuple[np.ndarray, list, list]) -> list[tuple[np.ndarray, list[np.ndarray] | None]]:
    """The rows in groups of polygons with as many vertices, with their vertices, PAIRS at a time; None with rows that go one by one."""
    sizes = [np.array([0 if v is None else len(v) for v in arrays] or [0]) for _, _, arrays in sides]
    shape = np.stack([size[numbers[rows]] for size, (numbers, _, _) in zip(sizes, sides, strict=True)], axis=1)
    out = []
    for kind in np.unique(shape, axis=0):
        own, each = rows[(shape == kind).all(axis=1)], int(np.prod(kind))
        if not 0 < each <= PAIRS:
            out.append((own, None))
            continue
        stacks = []
        for size, (numbers, _, arrays), k in zip(sizes, sides, kind, strict=True):
            at = np.flatnonzero(size == k)
            place = np.zeros(len(size), int)
            place[at] = np.arange(len(at))
            stacks.append((np.stack([arrays[i] for i in at]), place[numbers]))
        step = max(1, PAIRS // each)
        out += [(part, [stack[place[part]] for stack, place in stacks]) for part in np.split(own, range(step, len(own), step))]
    return out


def _codes(got: np.ndarray, known: np.ndarray) -> pd.Series:
    return pd.Series(pd.arrays.IntegerArray(got, ~known))


def _related(x: pd.Series, y: pd.Series) -> pd.Series:
    a, b = _parsed(x), _parsed(y)
    known, got = (a[0] >= 0) & (b[0] >= 0), np.zeros(len(x), np.int32)
    for rows, shapes in _by_shape(np.flatnonzero(known), a, b):
        got[rows] = [relation(a[1][a[0][i]], b[1][b[0][i]]) for i in rows] if shapes is None else relations(*shapes)
    return _codes(got, known)


@F.pandas_udf(T.IntegerType())
def contains_point(x: pd.Series, px: pd.Series, py: pd.Series) -> pd.Series:
    a, px, py = _parsed(x), px.to_numpy(float), py.to_numpy(float)
    known, got = a[0] >= 0, np.zeros(len(x), np.int32)
    for rows, shapes in _by_shape(np.flatnonzero(known), a):
        got[rows] = [point_in((px[i], py[i]), a[1][a[0][i]]) for i in rows] if shapes is None else points_in(px[rows, None], py[rows, None], shapes[0])[:, 0]
    return _codes(got, known)


@F.pandas_udf(T.IntegerType())
def overlap(x: pd.Series, y: pd.Series) -> pd.Series:
    return _related(x, y)


@F.pandas_udf(T.IntegerType())
def within(x: pd.Series, y: pd.Series) -> pd.Series:
    """2 the same, 1 x inside y, else 0."""
    return _related(x, y).map({4: 2, 2: 1, 0: 0, 1: 0, 3: 0}).astype("Int32")
