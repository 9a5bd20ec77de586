"""Exact dedup: a tree-merge of sorted digest runs, in DataFrame operations only.

Rows are dealt to runs by a hash of their row number, so that a group of copies
that holds a third of all rows is spread over all runs; there is a run for
RUN_ROWS rows.  Each run is reduced to one entry a digest.  The entries are
exchanged by ranges of digests and sorted by digest and run once; then binomial
rounds merge FAN_IN neighbouring runs at a time until one remains.  A run's
number is written as digits of base FAN_IN, so a merge groups by the digest and
one digit less: it streams over rows that are in order already, and neither
exchanges nor sorts again.  Every merge keeps the best row of a digest.  An
entry's key is the SHA-256 together with the length and a second hash of the
normalised text, so what is merged is verified to be the same text at every
level.

Documents are equal when they are identical without the characters
[\\x20\\x09-\\x0D]; null counts as empty.  Of equal documents the one with the
most code points in its original text stays, then the smallest id (null last).
Every input row gives one output row; of rows that agree in id and text too,
exactly one is kept.  An empty table gives no row; further columns of the input
play no part, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ASCII_SPACE, partitions_for, stored, unused, without_rows

RUN_ROWS = 1_000_000
FAN_IN, LEAST_LEVELS = 4, 3
KEY = ("sha", "norm_chars", "check")


def whole(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit(""))


def digests(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, chars, sha, norm_chars, check, row) of every row; ``row`` is a number to be stored."""
    text = whole(docs[text_col])
    return docs.select(docs[id_col].alias("id"), F.length(text).cast("long").alias("chars"), F.translate(text, ASCII_SPACE, "").alias("norm")).select(
        "id",
        "chars",
        F.unhex(F.sha2("norm", 256)).alias("sha"),
        F.length("norm").cast("long").alias("norm_chars"),
        F.xxhash64("norm").alias("check"),
        F.monotonically_increasing_id().alias("row"),
    )


def levels_for(rows: int) -> int:
    """Rounds of merging: FAN_IN to their power is the number of runs."""
    levels = LEAST_LEVELS
    while FAN_IN**levels * RUN_ROWS < rows:
        levels += 1
    return levels


def merged(entries: DataFrame, digits: list[str]) -> DataFrame:
    """One entry for each text and run: the best row (min of a struct) and the number of rows."""
    return entries.groupBy(*KEY, *digits).agg(F.min("best").alias("best"), F.sum("n").alias("n"))


def dedup_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, keep_id, group_size, kept, sha, chars) for every row of docs."""
    rows = stored(digests(docs, id_col, text_col), "digests")
    levels = levels_for(rows.count())
    run = F.pmod(F.xxhash64("row"), F.lit(FAN_IN**levels))
    digits = [f"digit{k}" for k in range(levels)]
    rows = rows.select("*", *((F.floor(run / FAN_IN ** (levels - 1 - k)) % FAN_IN).cast("byte").alias(d) for k, d in enumerate(digits)))
    best = F.struct((-F.col("chars")).alias("less"), F.col("id").isNull().alias("last"), F.col("id").alias("id"), F.col("row").alias("row")).alias("best")
    runs = stored(merged(rows.select(*KEY, *digits, best, F.lit(1).cast("long").alias("n")), digits), "runs")
    level = runs.repartitionByRange(partitions_for(runs), *KEY).sortWithinPartitions(*KEY, *digits)
    for k in range(levels - 1, -1, -1):
        level = merged(level, digits[:k])
    final = level.select(*KEY, F.col("best.id").alias("keep_id"), F.col("best.row").alias("keep_row"), F.col("n").alias("group_size"))
    # Back down the tree: a text has one entry a run, so a key of a run has about RUN_ROWS rows at most.
    by_run = runs.select(*digits, *KEY).join(final, list(KEY))
    return rows.join(by_run, [*digits, *KEY]).select("id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), "sha", "chars")


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns; id, digest and length name a row, of rows that agree in them one stays."""
    key = unused(docs, "row")
    named = lambda id_, sha, chars: F.struct(id_.isNull().alias("last"), id_.alias("id"), sha.alias("sha"), chars.alias("chars")).alias(key)
    found = dedup_groups(docs, id_col, text_col).select(named(F.col("id"), F.col("sha"), F.col("chars")), "kept")
    told = stored(found.groupBy(key).agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("n")).filter("not kept or n > 1"), "copies")
    text = whole(docs[text_col])
    marked = docs.withColumn(key, named(docs[id_col], F.unhex(F.sha2(F.translate(text, ASCII_SPACE, ""), 256)), F.length(text).cast("long")))
    return without_rows(marked, key, told.filter("not kept").select(key), told.filter("kept").select(key)).select(*docs.columns)


def op9_exact_dedup(docs: DataFrame) -> DataFrame:
    return dedup_groups(docs).select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


#: The same rows in DuckDB.
ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents
)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       CAST(count(*) OVER (PARTITION BY norm) AS BIGINT) AS group_size,
       row_number() OVER w = 1 AS kept,
       sha256(norm) AS text_sha256
FROM d WINDOW w AS (PARTITION BY norm ORDER BY chars DESC, doc_id NULLS LAST)"""
