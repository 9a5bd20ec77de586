"""Window features that Spark SQL has no syntax for: GROUPS frames, EXCLUDE, FILTER, DISTINCT, per-row offsets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = Window.unboundedPreceding, Window.unboundedFollowing


def group_frame(df: DataFrame, partition: list[str], order: list[Column], lo: int, hi: int, **aggregates: Column) -> DataFrame:
    """GROUPS BETWEEN lo AND hi: offsets count peer groups, so they are ranges over a dense rank."""
    ranked = df.withColumn("__peer", F.dense_rank().over(Window.partitionBy(*partition).orderBy(*order)))
    frame = Window.partitionBy(*partition).orderBy("__peer").rangeBetween(lo, hi)
    return ranked.select(*df.columns, *(a.over(frame).alias(n) for n, a in aggregates.items()))


def excluding(df: DataFrame, partition: list[str], order: list[Column], frame: tuple[int, int], x: str, exclude: str, name: str, aggregate: str = "sum") -> DataFrame:
    """aggregate(x) over a ROWS frame of the whole partition's rows with EXCLUDE current row, group, ties or no others.

    sum, total, count and avg are a frame's figure less that of the excluded rows inside the frame: no list of the
    frame is kept.  The peers inside a frame are those of the current row between its ends.  min and max cannot be
    subtracted: they join what stands before and after the excluded rows (see _extreme).
    """
    if aggregate in ("min", "max"):
        return _extreme(df, partition, order, frame, x, exclude, name, aggregate)
    w = Window.partitionBy(*partition).orderBy(*order)
    rows = w.rowsBetween(*frame)
    numbered = df.withColumns({"__n": F.row_number().over(w), "__rank": F.rank().over(w)})
    peers = Window.partitionBy(*partition, "__rank").orderBy("__n").rowsBetween(*frame)
    value, mine = F.sum(x).over(rows), F.col(x)
    counted, peer_sum = F.count(x).over(rows), F.coalesce(F.sum(x).over(peers), F.lit(0))
    peer_count = F.count(x).over(peers)
    inside = F.lit(frame[0] <= 0 <= frame[1])
    own, one = F.when(inside, F.coalesce(mine, F.lit(0))).otherwise(0), F.when(inside & mine.isNotNull(), 1).otherwise(0)
    drop = {
        "no others": (F.lit(0), F.lit(0)),
        "current row": (own, one),
        "group": (peer_sum, peer_count),
        "ties": (peer_sum - own, peer_count - one),
    }[exclude]
    left, n = F.coalesce(value, F.lit(0)) - drop[0], counted - drop[1]
    out = {"sum": F.when(n > 0, left), "total": F.when(n > 0, left.cast("double")).otherwise(0.0), "count": n.cast("long"), "avg": F.when(n > 0, left / n)}[aggregate]
    return numbered.withColumn(name, out).select(*df.columns, name)


def _extreme(df: DataFrame, partition: list[str], order: list[Column], frame: tuple[int, int], x: str, exclude: str, name: str, aggregate: str) -> DataFrame:
    """min or max with EXCLUDE: of the parts of the frame before and after the excluded rows.

    Around the current row both parts are ROWS frames.  Around the peers they are ranges of a dense rank where the
    frame has no end on that side, else the frame's own rows (as many as its ends say) are filtered by rank.
    """
    lo, hi = frame
    f, pick, shrink = (F.min, F.least, F.array_min) if aggregate == "min" else (F.max, F.greatest, F.array_max)
    w = Window.partitionBy(*partition).orderBy(*order)
    kind = df.schema[x].dataType
    nothing, mine = F.lit(None).cast(kind), F.when(F.lit(lo <= 0 <= hi), F.col(x))
    ranked = df.withColumn("__rank", F.dense_rank().over(w))
    if exclude == "no others":
        out = f(x).over(w.rowsBetween(lo, hi))
    elif exclude == "current row":
        before = f(x).over(w.rowsBetween(lo, min(hi, -1))) if lo <= -1 else nothing
        after = f(x).over(w.rowsBetween(max(lo, 1), hi)) if hi >= 1 else nothing
        out = pick(before, after)
    else:
        by_rank = Window.partitionBy(*partition).orderBy("__rank")

        def part(side: int) -> Column:
            """The frame's rows before (-1) or after (1) the peers."""
            end, other = (lo, hi) if side < 0 else (hi, lo)
            if side * end <= 0:
                return nothing
            if abs(end) >= abs(START):
                if side * other > 0:
                    raise ValueError("min and max with EXCLUDE need the current row in a frame without end")
                return f(x).over(by_rank.rangeBetween(START, -1) if side < 0 else by_rank.rangeBetween(1, END))
            near = w.rowsBetween(lo if side < 0 else max(lo, 0), min(hi, 0) if side < 0 else hi)
            held = F.collect_list(F.struct(F.col("__rank").alias("r"), F.col(x).alias("x"))).over(near)
            kept = F.filter(held, lambda s: (s["r"] < F.col("__rank")) if side < 0 else (s["r"] > F.col("__rank")))
            return shrink(F.transform(kept, lambda s: s["x"]))

        out = pick(part(-1), part(1), mine) if exclude == "ties" else pick(part(-1), part(1))
    return ranked.withColumn(name, out).select(*df.columns, name)


def filtered(aggregate, x: Column, condition: Column):  # noqa: ANN001, ANN201
    """aggregate(x) FILTER (WHERE condition), also over a window."""
    return aggregate(F.when(condition, x))


def count_distinct_over(x: Column, window) -> Column:  # noqa: ANN001
    """count(DISTINCT x) OVER window."""
    return F.size(F.collect_set(x).over(window)).cast("long")


def offset_value(df: DataFrame, partition: list[str], order: list[Column], x: str, n: str, name: str) -> DataFrame:
    """lag(x, n) where n is a column: an equi join on the row number."""
    numbered = df.withColumn("__n", F.row_number().over(Window.partitionBy(*partition).orderBy(*order)))
    keys = [F.col(p) for p in partition]
    other = numbered.select(*(k.alias(f"__k{i}") for i, k in enumerate(keys)), F.col("__n").alias("__m"), F.col(x).alias(name))
    on = F.col("__m") == F.col("__n") - F.col(n)
    for i, p in enumerate(partition):
        on = on & F.col(p).eqNullSafe(F.col(f"__k{i}"))
    return numbered.join(other, on, "left").select(*df.columns, name)
