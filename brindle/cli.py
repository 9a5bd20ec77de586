"""The command line: ``python -m brindle VERB DIRECTORY ...`` over the Parquet tables of a directory."""

from __future__ import annotations

import argparse
import sys
from collections.abc import Sequence

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions import vectors
from .plans.lower import Engine
from .plans.parser import SqlError
from .retrieval import lexical, ranking, tokenize
from .session import get_session, table_names
from .sources import files

MODES = "list column line csv tabs quote insert json markdown table box html ascii".split()


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="brindle", description=__doc__)
    verbs = p.add_subparsers(dest="verb", required=True)

    def verb(name: str, told: str, *args: str) -> argparse.ArgumentParser:
        v = verbs.add_parser(name, help=told)
        v.add_argument("directory")
        for a in args:
            v.add_argument(a)
        v.add_argument("--mode", choices=MODES, default="table")
        v.add_argument("--limit", type=int, default=1000, help="rows to show")
        return v

    verb("query", "run statements and show the last result", "sql").add_argument("--param", action="append")
    verb("explain", "the physical plan of a query", "sql")
    verb("translate", "the Spark SQL of a query", "sql")
    verb("tables", "names and numbers of columns")
    verb("schema", "columns of a table", "table")
    verb("count", "rows of a table", "table")
    verb("dump", "SQL text that rebuilds a table", "table")
    verb("export", "write a query's rows: parquet, csv, tabs or json by --format", "sql", "target").add_argument("--format", choices=["parquet", "csv", "tabs", "json"], default="parquet")
    imported = verb("import", "add a delimited file as a table", "source", "table")
    imported.add_argument("--columns", required=True, help="name type, name type, ...")
    imported.add_argument("--tabs", action="store_true")
    verb("search", "rank the rows of a table by BM25", "table", "id", "text", "words")
    verb("nearest", "rank the rows of a table by cosine to a vector", "table", "id", "column", "vector")
    return p


def run(spark: SparkSession, argv: Sequence[str]) -> str:
    """The text that a command prints."""
    a = parser().parse_args(argv)
    engine = Engine(spark)
    names = table_names(spark, a.directory)
    engine.catalog.load(a.directory, *names)
    show = lambda df: files.render(df, a.mode, a.limit)
    table = lambda: engine.catalog.get(a.table).df
    if a.verb == "query":
        return show(engine.sql(a.sql, [int(p) if p.lstrip("-").isdigit() else p for p in a.param or []]))
    if a.verb == "explain":
        return "\n".join(r[0] for r in engine.sql(f"EXPLAIN {a.sql}").collect())
    if a.verb == "translate":
        return engine.translate(a.sql)
    if a.verb == "tables":
        return show(engine.sql("PRAGMA table_list").select("name", "type", "ncol"))
    if a.verb == "schema":
        return show(engine.catalog.table_info(a.table))
    if a.verb == "count":
        return str(table().count())
    if a.verb == "dump":
        return files.dump(engine.catalog, a.table, a.limit)
    if a.verb == "export":
        rows = engine.sql(a.sql)
        if a.format in ("csv", "tabs"):
            files.write_delimited(rows, a.target, a.format)
        else:
            rows.write.format(a.format).save(a.target)
        return a.target
    if a.verb == "import":
        declared = dict(c.split(None, 1) for c in map(str.strip, a.columns.split(",")))
        files.read_delimited(spark, a.source, declared, "tabs" if a.tabs else "csv").write.parquet(f"{a.directory.rstrip('/')}/{a.table}.parquet")
        return a.table
    if a.verb == "search":
        corpus = lexical.Corpus.of(table(), a.id, tokenize.plain(F.col(a.text)))
        return show(lexical.bm25(corpus, a.words.lower().split()).orderBy(F.desc("score"), "id").limit(a.limit))
    return show(ranking.exact_search(table(), a.id, a.column, vectors.parse(a.vector), a.limit))


def main(argv: Sequence[str] | None = None) -> int:
    try:
        print(run(get_session(), sys.argv[1:] if argv is None else argv))
    except (SqlError, KeyError, ValueError) as e:
        print(f"error: {e.args[0] if e.args else e}", file=sys.stderr)
        return 1
    return 0
