"""Session factory and the catalog of tables, views, attached namespaces and snapshots.

DataFrames are immutable, so a table is a name for one, a write is a new
DataFrame under the old name, and a transaction's snapshot is a copy of the
names.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def get_session(app: str = "brindle", **conf: str) -> SparkSession:
    """A session with the settings the engine counts on; those of a running session stay."""
    base = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.ansi.enabled": "true"}
    b = SparkSession.builder.appName(app)
    for k, v in (base | conf).items():
        b = b.config(k, v)
    return b.getOrCreate()


def affinity(declared: str) -> str:
    """The affinity that a declared column type has, by the substrings it holds."""
    d = declared.upper()
    if "INT" in d:
        return "integer"
    if any(s in d for s in ("CHAR", "CLOB", "TEXT")):
        return "text"
    if not d or "BLOB" in d:
        return "blob"
    if any(s in d for s in ("REAL", "FLOA", "DOUB")):
        return "real"
    return "numeric"


def spark_type(declared: str) -> T.DataType:
    """One Spark type for a declared type; VECTOR(n) is an array of floats."""
    if declared.upper().startswith("VECTOR"):
        return T.ArrayType(T.FloatType())
    return {"integer": T.LongType(), "text": T.StringType(), "blob": T.BinaryType(), "real": T.DoubleType(), "numeric": T.DoubleType()}[affinity(declared)]


@dataclass
class Table:
    """A table's rows and what its declaration says about them."""

    df: DataFrame
    primary_key: list[str] = field(default_factory=list)
    not_null: list[str] = field(default_factory=list)
    checks: list[str] = field(default_factory=list)
    unique: list[list[str]] = field(default_factory=list)
    defaults: dict[str, str] = field(default_factory=dict)
    generated: dict[str, str] = field(default_factory=dict)
    foreign_keys: list[tuple[list[str], str, list[str], str]] = field(default_factory=list)  # columns, table, columns, action
    declared: dict[str, str] = field(default_factory=dict)
    sql: str = ""


def table_names(spark: SparkSession, directory: str) -> list[str]:
    """The Parquet tables of a directory, by name."""
    path = spark._jvm.org.apache.hadoop.fs.Path(directory)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    names = [f.getPath().getName() for f in found]
    return sorted(n.removesuffix(".parquet") for n in names if n.endswith(".parquet"))


class Catalog:
    """Names of tables and views, with savepoints."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.tables: dict[str, Table] = {}
        self.views: dict[str, str] = {}
        self.indexes: dict[str, tuple[str, list[str], bool]] = {}
        self.saved: list[tuple[str, dict, dict]] = []
        self.pragmas: dict[str, object] = {"user_version": 0, "application_id": 0, "case_sensitive_like": 0, "foreign_keys": 0, "encoding": "UTF-8"}
        self.changes = self.total_changes = 0

    def register(self, name: str, df: DataFrame, **declared: object) -> Table:
        self.tables[name.lower()] = t = Table(df, **declared)
        df.createOrReplaceTempView(name)
        return t

    def replace(self, name: str, df: DataFrame) -> None:
        """The table's new rows."""
        self.tables[name.lower()].df = df
        df.createOrReplaceTempView(name)

    def load(self, directory: str, *names: str) -> None:
        """Register the Parquet tables of a directory."""
        for n in names:
            self.register(n, self.spark.read.parquet(f"{directory}/{n}.parquet"))

    def attach(self, schema: str, directory: str, *names: str) -> None:
        """ATTACH: the tables of another directory as schema_name."""
        for n in names:
            self.register(f"{schema}_{n}", self.spark.read.parquet(f"{directory}/{n}.parquet"))

    def detach(self, schema: str) -> None:
        for n in [n for n in self.tables if n.startswith(f"{schema.lower()}_")]:
            self.drop(n)

    def drop(self, name: str) -> None:
        self.tables.pop(name.lower(), None)
        self.views.pop(name.lower(), None)
        self.spark.catalog.dropTempView(name)

    def get(self, name: str) -> Table:
        if name.lower() not in self.tables:
            raise KeyError(f"no such table: {name}")
        return self.tables[name.lower()]

    # Transactions: names only, since what they stand for never changes.

    def savepoint(self, name: str = "") -> None:
        self.saved.append((name.lower(), {n: Table(**vars(t)) for n, t in self.tables.items()}, dict(self.views)))

    def rollback(self, name: str = "") -> None:
        """Back to the savepoint of this name (to the first without one)."""
        at = next((i for i in range(len(self.saved) - 1, -1, -1) if self.saved[i][0] == name.lower()), 0)
        if not self.saved:
            raise RuntimeError("no transaction is active")
        _, tables, views = self.saved[at]
        del self.saved[at + bool(name) :]
        for n in set(self.tables) - set(tables):
            self.spark.catalog.dropTempView(n)
        self.tables, self.views = {n: Table(**vars(t)) for n, t in tables.items()}, dict(views)
        for n, t in self.tables.items():
            t.df.createOrReplaceTempView(n)

    def release(self, name: str = "") -> None:
        """RELEASE, or COMMIT without a name: what was done since stays."""
        at = next((i for i in range(len(self.saved) - 1, -1, -1) if self.saved[i][0] == name.lower()), 0)
        del self.saved[at:]

    # Introspection.

    def schema_rows(self) -> DataFrame:
        """type, name, tbl_name and sql of every object."""
        rows = [("table", n, n, t.sql) for n, t in sorted(self.tables.items())]
        rows += [("view", n, n, s) for n, s in sorted(self.views.items())]
        rows += [("index", n, t, None) for n, (t, _, _) in sorted(self.indexes.items())]
        return self.spark.createDataFrame(rows, "type string, name string, tbl_name string, sql string")

    def table_info(self, name: str) -> DataFrame:
        t = self.get(name)
        kinds = {"bigint": "INTEGER", "int": "INTEGER", "double": "REAL", "string": "TEXT", "binary": "BLOB"}
        pk = [c.lower() for c in t.primary_key]
        rows = [(i, c, t.declared.get(c, kinds.get(k, k.upper())), int(c in t.not_null), t.defaults.get(c), pk.index(c.lower()) + 1 if c.lower() in pk else 0) for i, (c, k) in enumerate(t.df.dtypes)]
        return self.spark.createDataFrame(rows, "cid int, name string, type string, notnull int, dflt_value string, pk int")
