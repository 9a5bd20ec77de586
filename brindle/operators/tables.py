"""Table functions and modules: recursive JSON trees, archives, spatial ranges, user functions, a Python data source."""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

NODE = T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("key", "value", "type", "atom", "fullkey", "path")] + [T.StructField("id", T.LongType()), T.StructField("parent", T.LongType())]))


def nodes(doc: object) -> list[tuple]:
    """Every node of a parsed document, parents first."""
    out: list[tuple] = []

    def kind(v: object) -> str:
        if v is None or isinstance(v, bool):
            return {None: "null", True: "true", False: "false"}[v]
        return "integer" if isinstance(v, int) else "real" if isinstance(v, float) else "text" if isinstance(v, str) else "array" if isinstance(v, list) else "object"

    def walk(key: object, v: object, full: str, path: str, parent: int | None) -> None:
        me, k = len(out), kind(v)
        text = json.dumps(v, separators=(",", ":"), ensure_ascii=False)
        atom = None if k in ("array", "object", "null") else {"true": "1", "false": "0", "text": v}.get(k, text)
        out.append((None if key is None else str(key), text if k in ("array", "object") else atom, k, atom, full, path, me, parent))
        if isinstance(v, dict):
            for name, x in v.items():
                step = f".{name}" if name.isidentifier() else f'."{name}"'
                walk(name, x, full + step, full, me)
        elif isinstance(v, list):
            for i, x in enumerate(v):
                walk(i, x, f"{full}[{i}]", full, me)

    walk(None, doc, "$", "$", None)
    return out


def json_tree(df: DataFrame, doc: str) -> DataFrame:
    """LATERAL json_tree: df's columns with key, value, type, atom, fullkey, path, id and parent of every node."""

    @F.pandas_udf(NODE)
    def tree(x: pd.Series) -> pd.Series:
        def one(s: str | None) -> list | None:
            try:
                return None if s is None else nodes(json.loads(s))
            except ValueError:
                return None

        return x.map(one)

    return df.select(*df.columns, F.explode(tree(doc)).alias("__n")).select(*df.columns, "__n.*")


def zip_members(files: DataFrame, data: str = "data") -> DataFrame:
    """name, size and data of the members of zip archives held in a binary column."""
    member = T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("size", T.LongType()), T.StructField("data", T.BinaryType())]))

    @F.pandas_udf(member)
    def opened(x: pd.Series) -> pd.Series:
        def one(raw: bytes) -> list:
            with zipfile.ZipFile(io.BytesIO(raw)) as z:
                return [(i.filename, i.file_size, z.read(i)) for i in z.infolist() if not i.is_dir()]

        return x.map(one)

    return files.select(F.explode(opened(data)).alias("m")).select("m.*")


def rtree_query(df: DataFrame, boxes: dict[str, tuple[float | None, float | None]]) -> DataFrame:
    """Rows within ranges of their columns: a conjunction that reaches the scan."""
    cond = F.lit(True)
    for name, (lo, hi) in boxes.items():
        cond = cond & (F.col(name) >= lo if lo is not None else F.lit(True)) & (F.col(name) <= hi if hi is not None else F.lit(True))
    return df.filter(cond)


class Functions:
    """User functions: scalars, aggregates over whole groups and collations; a name may have one body for each number of arguments."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.bodies: dict[tuple[str, int], object] = {}
        self.collations: dict[str, Callable[[Column], Column]] = {}

    def create_scalar(self, name: str, arity: int, body: Callable, returns: T.DataType, deterministic: bool = True) -> None:
        """body gets one pandas Series an argument and returns one."""
        udf = F.pandas_udf(body, returns, F.PandasUDFType.SCALAR)
        udf = udf if deterministic else udf.asNondeterministic()
        self.bodies[name.lower(), arity] = udf
        self.spark.udf.register(f"{name}_{arity}", udf)

    def create_aggregate(self, name: str, body: Callable, returns: T.DataType) -> None:
        """body gets the group's values as one Series and returns a value."""

        def f(x: pd.Series) -> float:  # the signature decides the kind of UDF
            return body(x)

        f.__annotations__ = {"x": pd.Series, "return": float}
        self.bodies[name.lower(), 1] = F.pandas_udf(f, returns)

    def create_collation(self, name: str, key: Callable[[Column], Column]) -> None:
        """A key expression: texts compare as their keys."""
        self.collations[name.upper()] = key

    def remove(self, name: str, arity: int) -> None:
        del self.bodies[name.lower(), arity]

    def call(self, name: str, *args: Column) -> Column:
        return self.bodies[name.lower(), len(args)](*args)

    def key(self, collation: str, x: Column) -> Column:
        return self.collations[collation.upper()](x)


class SeriesPartition(InputPartition):
    def __init__(self, start: int, stop: int, step: int) -> None:
        self.start, self.stop, self.step = start, stop, step


class SeriesReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.lo, self.hi = int(options.get("start", 0)), int(options.get("stop", 0))
        self.step, self.parts = abs(int(options.get("step", 1))) or 1, int(options.get("parts", 4))

    def partitions(self) -> list[InputPartition]:
        n = max(0, (self.hi - self.lo) // self.step + 1)
        cut = [self.lo + self.step * (n * k // self.parts) for k in range(self.parts + 1)]
        return [SeriesPartition(a, b, self.step) for a, b in zip(cut, cut[1:], strict=False) if a < b] or [SeriesPartition(0, 0, 1)]

    def read(self, partition: SeriesPartition) -> Iterator[tuple]:
        yield from ((v,) for v in range(partition.start, partition.stop, partition.step))


class NarrowedSeriesReader(SeriesReader):
    """For sessions in which Python data sources get filters (spark.sql.python.filterPushdown.enabled)."""

    def pushFilters(self, filters: list) -> Iterator:  # noqa: N802  the API's name
        """Lower and upper bounds narrow the series; other filters go back to Spark."""
        for f in filters:
            kind, value = type(f).__name__, getattr(f, "value", None)
            if kind in ("GreaterThanOrEqual", "GreaterThan") and isinstance(value, int):
                first = value + (kind == "GreaterThan")
                self.lo += max(0, -(-(first - self.lo) // self.step)) * self.step
            elif kind in ("LessThanOrEqual", "LessThan") and isinstance(value, int):
                self.hi = min(self.hi, value - (kind == "LessThan"))
            else:
                yield f


class Series(DataSource):
    """A module in the sense of virtual tables: ``spark.read.format("brindle_series").options(start=, stop=, step=[, pushdown=])``."""

    @classmethod
    def name(cls) -> str:
        return "brindle_series"

    def schema(self) -> str:
        return "value long"

    def reader(self, schema: T.StructType) -> SeriesReader:
        options = dict(self.options)
        return (NarrowedSeriesReader if options.get("pushdown") == "true" else SeriesReader)(options)
