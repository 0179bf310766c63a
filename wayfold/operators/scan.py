"""Two ways to run order-dependent Python over huge keys without one task per key.

`prefix_scan` handles associative recursions (rotation products, clamped sums): local prefixes per chunk, one
row per chunk to link them. `chunked_fold` handles greedy recursions: every chunk is folded from the state its
predecessor ends with; only chunks whose entry state changed are folded again, until nothing changes. A chunk
is final once its predecessor is, so the fixed point is the sequential result.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scans
from ..session import cut
from .ordered import CHUNK, Chunks, join_equal

FOLD_ROWS = 200_000


def prefix_scan(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], inputs: Sequence[str], outputs: Sequence[str],
    combine: Callable, chunks: Chunks,
) -> DataFrame:
    """Inclusive prefix of `inputs` under `combine`, in `order`; result columns `outputs`."""
    labelled = chunks.label(df, keys, order[0])
    parts = [*keys, CHUNK]
    schema = T.StructType([*labelled.schema.fields, *[T.StructField(o, T.DoubleType()) for o in outputs]])
    ins, outs, by = list(inputs), list(outputs), list(order)

    def local(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(by, kind="stable")
        pdf[outs] = scans.prefix(pdf[ins].to_numpy(float), combine)
        return pdf

    done = labelled.groupBy(*parts).applyInPandas(local, schema)
    if chunks.whole:
        return done.drop(CHUNK)
    done = cut(done)  # read for the totals and for the rows; Python would run for each, and again for each scan on top
    tail = F.max_by(F.struct(*outs), F.struct(*by)).alias("_tail")
    totals = done.groupBy(*parts).agg(tail).select(*parts, *[F.col(f"_tail.{o}").alias(o) for o in outs])
    carry_schema = T.StructType(
        [*[f for f in labelled.schema.fields if f.name in parts],
         *[T.StructField(f"_c_{o}", T.DoubleType()) for o in outs]]
    )
    key_names, carry_names = list(parts), [f"_c_{o}" for o in outs]

    def link(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(CHUNK, kind="stable")
        reach = scans.prefix(pdf[outs].to_numpy(float), combine)
        pdf[carry_names] = np.vstack([np.full((1, len(outs)), np.nan), reach[:-1]])
        return pdf[key_names + carry_names]

    carried = totals.groupBy(*keys).applyInPandas(link, carry_schema)
    joined = chunks.join(done, carried, keys)

    def attach(batches):
        for pdf in batches:
            have = pdf[carry_names[0]].notna().to_numpy()
            if have.any():
                merged = combine(pdf.loc[have, carry_names].to_numpy(float), pdf.loc[have, outs].to_numpy(float))
                pdf.loc[have, outs] = merged
            yield pdf[[f.name for f in schema.fields]]

    return joined.mapInPandas(attach, schema).drop(CHUNK)


def chunked_fold(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], fold: Callable, state: T.StructType,
    schema: T.StructType, chunks: Chunks,
) -> DataFrame:
    """Sequential fold. `fold(rows, state_or_None) -> (output rows, state)`; `rows` come sorted by `order`.

    `state` is a flat schema and must describe the fold completely; the fold is deterministic.
    """
    by, key_list = list(order), list(keys)
    fields = [f.name for f in state.fields]
    out_fields = [f.name for f in schema.fields]

    def run(pdf: pd.DataFrame, entry: dict | None) -> tuple[pd.DataFrame, dict]:
        return fold(pdf.sort_values(by, kind="stable").reset_index(drop=True), entry)

    if chunks.whole:
        return df.groupBy(*keys).applyInPandas(lambda pdf: run(pdf, None)[0][out_fields], schema)

    labelled = cut(chunks.label(df, keys, order[0]))
    parts = [*key_list, CHUNK]
    key_fields = [f for f in labelled.schema.fields if f.name in parts]
    state_schema = T.StructType([*key_fields, *state.fields])

    def entry_of(carry: pd.DataFrame) -> dict | None:
        if carry.empty or not bool(carry["_known"].iloc[0]):
            return None
        return {f: carry[f].iloc[0] for f in fields}

    def exits(pdf: pd.DataFrame, carry: pd.DataFrame) -> pd.DataFrame:
        _, last = run(pdf, entry_of(carry))
        return pd.DataFrame([{**{k: pdf[k].iloc[0] for k in parts}, **last}])[[f.name for f in state_schema.fields]]

    def outputs(pdf: pd.DataFrame, carry: pd.DataFrame) -> pd.DataFrame:
        return run(pdf, entry_of(carry))[0][out_fields]

    def together(rows: DataFrame, carry: DataFrame, fn: Callable, out: T.StructType) -> DataFrame:
        # Both sides descend from the same rows; fresh aliases keep their columns apart.
        own = carry.select(*[F.col(c).alias(c) for c in carry.columns])
        return rows.groupBy(*parts).cogroup(own.groupBy(*parts)).applyInPandas(fn, out)

    sequence = labelled.select(*parts).distinct().withColumn(
        "_before", F.lag(CHUNK).over(Window.partitionBy(*keys).orderBy(CHUNK))
    )
    unknown = [F.lit(None).cast(f.dataType).alias(f.name) for f in state.fields]
    entry = cut(sequence.select(*parts, "_before", F.lit(False).alias("_known"), *unknown))
    last = cut(together(labelled, entry, exits, state_schema))
    while True:
        shifted = last.select(*key_list, F.col(CHUNK).alias("_before"), F.struct(*fields).alias("_new"))
        fresh = join_equal(
            entry.select(*parts, "_before", "_known", F.struct(*fields).alias("_old")), shifted, [*key_list, "_before"], "left"
        )
        known = F.col("_before").isNotNull()
        moved = (known != F.col("_known")) | (known & ~F.col("_old").eqNullSafe(F.col("_new")))
        fresh = cut(
            fresh.select(
                *parts, "_before", known.alias("_known"), moved.alias("_moved"),
                *[F.col(f"_new.{f}").alias(f) for f in fields],
            )
        )
        redo = fresh.filter("_moved")
        entry = fresh.drop("_moved")
        if redo.isEmpty():
            break
        again = join_equal(labelled, redo.select(*parts), parts, "left_semi")
        renewed = together(again, redo, exits, state_schema)
        kept = join_equal(last, redo.select(*parts), parts, "left_anti")
        last = cut(kept.unionByName(renewed))
    return together(labelled, entry, outputs, schema)
