"""Ordered operators that stay parallel inside one key.

A window over `partitionBy(drive)` puts a whole drive on one task. Here the order axis (time, distance,
input index) is cut into chunks, the window runs per (key, chunk), and what has to cross a chunk border
- the last row, a running total, the nearest row of the other side - travels through a table with one row
per chunk. Results are the same for any chunk width.

`Chunks.plan` measures the data once. If every key fits one chunk the operators fall back to the plain
window, so small inputs pay nothing for the machinery.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

CHUNK = "_chunk"
#: Rows of a chunk: what one task sorts, with both sides of a join, both poses and several lengths per row.
DEFAULT_ROWS = 100_000
# An overfull chunk is split again; sub-chunk numbers live in the low 20 bits of the chunk id.
SUB = 1 << 20
# Chunk numbers are below this in size; nulls and NaN have the two ends.
EDGE = 1 << 40
# Most pieces of an overfull chunk (at least; twice what its rows need otherwise). The table of cuts has one row per
# overfull chunk, at most n / (4 rows) of them.
QUANTILES, MOST_QUANTILES = 128, 1 << 16
BROADCAST_ROWS = 10_000


def join_equal(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join on `keys` in which null equals null, so that rows without a key or an order value stay."""
    renamed = right.select(*[F.col(k).alias(f"_same_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    condition = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_same_{k}")) for k in keys])
    return left.join(renamed, condition, how).drop(*[f"_same_{k}" for k in keys])


def few_rows(table: DataFrame) -> tuple[DataFrame, bool]:
    """`table` materialised, and broadcast in joins if it has at most BROADCAST_ROWS rows, which is said: the planner does not
    know how small the result of a derivation is, and would deal both sides of its joins."""
    table = cut(table)
    few = table.count() <= BROADCAST_ROWS
    return F.broadcast(table) if few else table, few


@dataclass(frozen=True)
class Chunks:
    """How the order axis is cut. `width is None` means one chunk per key."""

    width: float | None = None
    origin: float = 0.0
    hot: DataFrame | None = None
    hot_rows: int = 0
    hot_keys: tuple[str, ...] = ()
    #: Chunks that hold rows, as counted by `plan`; 0 if unknown.
    pieces: int = 0

    @staticmethod
    def plan(df: DataFrame, keys: Sequence[str], on: str, rows: int = DEFAULT_ROWS) -> "Chunks":
        """Choose a width so that a chunk holds about `rows` rows, and split bursts once more."""
        value = F.col(on).cast("double")
        real = F.when(F.abs(value) < float("inf"), value)
        per_key = df.groupBy(*keys).agg(
            F.count(F.lit(1)).alias("n"), F.min(real).alias("lo"), F.max(real).alias("hi")
        )
        big = (F.col("n") > rows) & (F.col("hi") > F.col("lo"))
        top = per_key.agg(
            F.max("n").alias("n"),
            F.min(F.when(big, (F.col("hi") - F.col("lo")) / F.ceil(F.col("n") / rows))).alias("width"),
            F.min("lo").alias("lo"),
        ).first()
        if top is None or top.n is None or top.n <= rows or not top.width or top.width <= 0.0:
            return Chunks()
        base = Chunks(float(top.width), float(top.lo))
        labelled = base.label(df.select(*keys, on), keys, on).withColumn("_hot_chunk", F.expr(f"{CHUNK} div {SUB}"))
        sizes = cut(labelled.groupBy(*keys, "_hot_chunk").agg(F.count(F.lit(1)).alias("n")))
        crowded = sizes.filter(F.col("n") > 4 * rows)
        pieces, found, largest = sizes.agg(F.count(F.lit(1)), F.count_if(F.col("n") > 4 * rows), F.max("n")).first()
        if not found:
            return replace(base, pieces=pieces)
        # Equal widths cannot split a burst; its own quantiles can. The sketch is bounded and merges map-side.
        small = F.broadcast(crowded) if found <= BROADCAST_ROWS else crowded
        parts = min(max(QUANTILES, 2 * -(-largest // rows)), MOST_QUANTILES)
        steps = [i / parts for i in range(1, parts)]
        hot = (
            join_equal(labelled, small.drop("n"), [*keys, "_hot_chunk"])
            .groupBy(*keys, "_hot_chunk")
            .agg(F.percentile_approx(F.col(on).cast("double"), steps, max(10_000, 4 * parts)).alias("_cuts"))
            .withColumn("_cuts", F.array_distinct("_cuts"))
        )
        return Chunks(base.width, base.origin, cut(hot), found, tuple(keys), pieces + found * parts)

    @property
    def whole(self) -> bool:
        return self.width is None

    def label(self, df: DataFrame, keys: Sequence[str], on: str) -> DataFrame:
        """Add the chunk id; it grows with `on` as Spark sorts: nulls have the first chunk, NaN has the last."""
        if self.whole:
            return df.withColumn(CHUNK, F.lit(0).cast("bigint"))
        ratio = (F.col(on).cast("double") - F.lit(self.origin)) / F.lit(self.width)
        base = F.when(ratio.isNull(), -EDGE).when(F.isnan(ratio), EDGE).otherwise(
            F.greatest(F.least(F.floor(ratio).cast("bigint"), F.lit(EDGE - 1)), F.lit(1 - EDGE))
        )
        if self.hot is None:
            return df.withColumn(CHUNK, base * F.lit(SUB))
        hot = F.broadcast(self.hot) if self.hot_rows <= BROADCAST_ROWS else self.hot
        value = F.col(on).cast("double")
        part = F.size(F.filter("_cuts", lambda c: c < value)).cast("bigint")
        part = F.when(F.col("_cuts").isNotNull(), part).otherwise(0)
        return (
            join_equal(df.withColumn("_hot_chunk", base), hot, [*self.hot_keys, "_hot_chunk"], "left")
            .withColumn(CHUNK, F.col("_hot_chunk") * F.lit(SUB) + part)
            .drop("_hot_chunk", "_cuts")
        )

    def labelled(self, df: DataFrame, keys: Sequence[str], on: str) -> DataFrame:
        """Rows labelled once for several steps along `on`, which then share one shuffle; whoever labels drops CHUNK."""
        return df if self.whole or CHUNK in df.columns else self.label(df, keys, on)

    def parts(self, keys: Sequence[str]) -> list[str]:
        return list(keys) if self.whole else [*keys, CHUNK]

    def join(self, rows: DataFrame, table: DataFrame, keys: Sequence[str]) -> DataFrame:
        """`rows` with `table`, one row per key and chunk. A table counted to be small is broadcast, so that the rows stay where
        their window left them; else every step would deal all rows anew before the adaptive planner sees how small it is."""
        small = 0 < self.pieces <= BROADCAST_ROWS
        return join_equal(rows, F.broadcast(table) if small else table, [*keys, CHUNK])


def _order_struct(order: Sequence[str]) -> Column:
    return F.struct(*[F.col(c) for c in order])


def lag_row(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], fields: Sequence[str], chunks: Chunks | None = None,
    into: str = "prev",
) -> DataFrame:
    """Add `into`, a struct of `fields` of the row before in `order` (null on the first row of a key)."""
    chunks = chunks or Chunks.plan(df, keys, order[0])
    row = F.struct(*[F.col(c) for c in fields])
    if chunks.whole:
        return df.withColumn(into, F.lag(row).over(Window.partitionBy(*keys).orderBy(*order)))
    own = () if CHUNK in df.columns else (CHUNK,)
    df = chunks.labelled(df, keys, order[0])
    tails = df.groupBy(*keys, CHUNK).agg(F.max_by(row, _order_struct(order)).alias("_tail"))
    tails = tails.select(
        *keys, CHUNK, F.lag("_tail").over(Window.partitionBy(*keys).orderBy(CHUNK)).alias("_wf_before")
    )
    local = df.withColumn(into, F.lag(row).over(Window.partitionBy(*keys, CHUNK).orderBy(*order)))
    return (
        chunks.join(local, tails, keys)
        .withColumn(into, F.coalesce(into, "_wf_before"))
        .drop(*own, "_wf_before")
    )


def running(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], values: dict[str, tuple[str, Column]],
    chunks: Chunks | None = None,
) -> DataFrame:
    """Running aggregates up to and including the current row. `values`: name -> (sum|max|min|last, column).

    `last` keeps the last non-null value.
    """
    chunks = chunks or Chunks.plan(df, keys, order[0])
    for name, (_, value) in values.items():
        df = df.withColumn(f"_v_{name}", value)
    own = () if CHUNK in df.columns else (CHUNK,)
    df = chunks.labelled(df, keys, order[0])
    frame = Window.partitionBy(*chunks.parts(keys)).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)

    def fold(kind: str, column: str) -> Column:
        if kind == "last":
            return F.last(column, ignorenulls=True)
        return {"sum": F.sum, "max": F.max, "min": F.min}[kind](column)

    out = df.withColumns({name: fold(kind, f"_v_{name}").over(frame) for name, (kind, _) in values.items()})
    helpers = [f"_v_{name}" for name in values]
    if chunks.whole:
        return out.drop(*helpers)
    totals = df.groupBy(*keys, CHUNK).agg(
        *[
            (F.max_by(f"_v_{name}", F.when(F.col(f"_v_{name}").isNotNull(), _order_struct(order)))
             if kind == "last" else fold(kind, f"_v_{name}")).alias(f"_t_{name}")
            for name, (kind, _) in values.items()
        ]
    )
    before = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(
        *keys, CHUNK,
        *[fold(kind, f"_t_{name}").over(before).alias(f"_c_{name}") for name, (kind, _) in values.items()],
    )
    out = chunks.join(out, carried, keys)
    merged = {}
    for name, (kind, _) in values.items():
        here, earlier = F.col(name), F.col(f"_c_{name}")
        if kind == "sum":
            merged[name] = F.when(here.isNull(), earlier).otherwise(here + F.coalesce(earlier, F.lit(0)))
        elif kind == "last":
            merged[name] = F.coalesce(here, earlier)
        else:
            merged[name] = (F.greatest if kind == "max" else F.least)(here, earlier)
    return out.withColumns(merged).drop(*own, *helpers, *[f"_c_{name}" for name in values])


def row_numbers(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], into: str = "rn", chunks: Chunks | None = None
) -> DataFrame:
    """1-based position of each row inside its key."""
    chunks = chunks or Chunks.plan(df, keys, order[0])
    if chunks.whole:
        return df.withColumn(into, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("bigint"))
    own = () if CHUNK in df.columns else (CHUNK,)
    df = chunks.labelled(df, keys, order[0])
    counts = df.groupBy(*keys, CHUNK).agg(F.count(F.lit(1)).alias("_wf_n"))
    before = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*keys, CHUNK, F.coalesce(F.sum("_wf_n").over(before), F.lit(0)).alias("_wf_before"))
    local = df.withColumn(into, F.row_number().over(Window.partitionBy(*keys, CHUNK).orderBy(*order)))
    return (
        chunks.join(local, counts, keys)
        .withColumn(into, F.col(into) + F.col("_wf_before"))
        .drop(*own, "_wf_before")
    )


def asof(
    left: DataFrame, right: DataFrame, keys: Sequence[str], on: str, right_on: str, fields: Sequence[str],
    tie: Sequence[str] = (), strict_next: bool = False, chunks: Chunks | None = None,
) -> DataFrame:
    """Bracket every left row by right rows along one axis.

    Adds `prev` (last right row strictly before) and `next` (first right row at or after) as structs of
    `fields`; with `strict_next`, `prev` is at or before and `next` strictly after. `tie` orders right rows
    with equal `right_on`. One union, one sort; no cross product.
    """
    if chunks is None:  # either side may be the big one
        both_axes = left.select(*keys, F.col(on).alias("_on")).unionByName(right.select(*keys, F.col(right_on).alias("_on")))
        chunks = Chunks.plan(both_axes, keys, "_on")
    row = F.struct(*[F.col(c) for c in fields])
    columns = left.columns
    lhs = left.select(
        *keys, F.col(on).alias("_on"), F.lit(1 if strict_next else 0).alias("_side"),
        F.struct(*[F.col(c) for c in columns]).alias("_left"),
    )
    rhs = right.filter(F.col(right_on).isNotNull()).select(
        *keys, F.col(right_on).alias("_on"), F.lit(0 if strict_next else 1).alias("_side"),
        *([F.struct(*[F.col(c) for c in tie]).alias("_tie")] if tie else []),
        row.alias("_right"),
    )
    both = lhs.unionByName(rhs, allowMissingColumns=True)
    if not chunks.whole:
        both = chunks.label(both, keys, "_on")
    parts = ", ".join(f"`{c}`" for c in chunks.parts(keys))
    order = ["_on", "_side", "_tie"] if tie else ["_on", "_side"]
    over = f"IGNORE NULLS OVER (PARTITION BY {parts} ORDER BY {', '.join(order)})"
    out = both.select(
        "*", F.expr(f"lag(_right, 1) {over}").alias("prev"), F.expr(f"lead(_right, 1) {over}").alias("next")
    ).filter(F.col("_left").isNotNull())
    if not chunks.whole:
        at = F.when(F.col("_right").isNotNull(), F.struct(*order))
        ends = both.groupBy(*keys, CHUNK).agg(
            F.min_by("_right", at).alias("_first"), F.max_by("_right", at).alias("_last")
        )
        edge = f"IGNORE NULLS OVER (PARTITION BY {', '.join(f'`{c}`' for c in keys)} ORDER BY {CHUNK})"
        ends = ends.select(
            *keys, CHUNK, F.expr(f"lag(_last, 1) {edge}").alias("_wf_before"),
            F.expr(f"lead(_first, 1) {edge}").alias("_wf_after"),
        )
        out = chunks.join(out, ends, keys).withColumns(
            {"prev": F.coalesce("prev", "_wf_before"), "next": F.coalesce("next", "_wf_after")}
        )
    # The keys themselves, not their copies: a filter on a key then reaches both scans.
    return out.select(*[F.col(c) if c in keys else F.col(f"_left.`{c}`").alias(c) for c in columns], "prev", "next")
