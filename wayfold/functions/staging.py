"""Named intermediate results inside one select."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pinned(df: DataFrame, values: dict[str, Column]) -> DataFrame:
    """`df` with more columns, kept where they are computed.

    A later filter on a derived column is pushed below a projection by inlining the whole derivation, again and again
    through stacked projections. As the output of a generator over an array of one struct the columns cannot be inlined,
    while filters on all other columns (keys above all) still pass down to the scan.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in values.items()]))))


def let(df: DataFrame, steps: dict[str, Column], drop: tuple[str, ...] | list[str] = ()) -> DataFrame:
    """Add columns in order; a later one may use an earlier one by name (lateral column aliases).

    Catalyst splits the select into stacked projections, so a value that is used many times is computed
    once and expression trees stay small. Names must be new; kept columns are `pinned`.
    """
    gone = set(drop)
    staged = {n: f"_let_{n}" for n in steps if n not in gone}
    out = df.select("*", *[c.alias(n) for n, c in steps.items()])
    out = out.select(*[F.col(f"`{c}`") for c in df.columns], *[F.col(n).alias(s) for n, s in staged.items()])
    return pinned(out, {n: F.col(s) for n, s in staged.items()}).drop(*staged.values())
