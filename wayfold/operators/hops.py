"""Greedy selections that look at the last kept row, without running through a key from its first row to its last.

"Next kept row" is a function of a row alone. Inside a chunk, every row leads to a last kept row, its *tail*; chains that start at
different rows soon run together, so a chunk has few tails. Each tail is followed into the chunk where its next kept row is, and
on to the tail there: a small table of hops from tail to tail. The tails of the chain that starts at a key's first row are found by
pointer doubling over that table, in as many rounds as its length has binary digits. They are the states in which chunks
are entered, and one more pass selects the rows.

Chunks that a tail passes without a hop are skipped by bounds: a chunk tells how far any of its rows can be from a given one."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut
from .ordered import CHUNK, Chunks, join_equal

#: Rows whose bounds are kept together while a chunk's tails are looked for.
BLOCK = 512


@dataclass(frozen=True)
class Rule:
    """How a row follows the last kept one. `fields`: columns it looks at, as doubles.

    `far(rows, last)`: which rows may follow `last`. `bound(rows)`: a summary of rows as one vector. `may(bounds, last)`: of which
    summaries a row might follow `last`; never false for one that has such a row."""

    fields: tuple[str, ...]
    far: Callable[[np.ndarray, np.ndarray], np.ndarray]
    bound: Callable[[np.ndarray], np.ndarray]
    may: Callable[[np.ndarray, np.ndarray], np.ndarray]


class Rows:
    """Sorted rows of a chunk with bounds of their blocks."""

    def __init__(self, rule: Rule, values: np.ndarray):
        self.rule, self.values = rule, values
        self.bounds = np.array([rule.bound(values[at: at + BLOCK]) for at in range(0, len(values), BLOCK)])

    def after(self, at: int, last: np.ndarray) -> int:
        """First row at or after `at` that may follow `last`; the number of rows if there is none."""
        block = at // BLOCK
        near = self.rule.far(self.values[at: (block + 1) * BLOCK], last)
        if near.any():
            return at + int(near.argmax())
        for b in (np.flatnonzero(self.rule.may(self.bounds[block + 1:], last)) + block + 1).tolist():
            hit = self.rule.far(self.values[b * BLOCK: (b + 1) * BLOCK], last)
            if hit.any():
                return b * BLOCK + int(hit.argmax())
        return len(self.values)

    def chain(self, at: int) -> list[int]:
        """Rows kept from row `at` on, itself the first."""
        kept = []
        while at < len(self.values):
            kept.append(at)
            at = self.after(at + 1, self.values[at])
        return kept

    def tails(self) -> np.ndarray:
        """The last kept rows of all chains."""
        tail = np.arange(len(self.values))
        for at in range(len(tail) - 1, -1, -1):
            follower = self.after(at + 1, self.values[at])
            if follower < len(tail):
                tail[at] = tail[follower]
        return np.unique(tail)


def select_kept(df: DataFrame, keys: Sequence[str], order: Sequence[str], rule: Rule, chunks: Chunks) -> DataFrame:
    """The first row of every key in `order`, and every next kept row after the last kept one."""
    by, key_list, fields = list(order), list(keys), list(rule.fields)

    def rows_of(pdf: pd.DataFrame) -> tuple[pd.DataFrame, Rows]:
        pdf = pdf.sort_values(by, kind="stable", ignore_index=True)
        return pdf, Rows(rule, pdf[fields].to_numpy(float))

    if chunks.whole:
        def whole(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf, rows = rows_of(pdf)
            return pdf.iloc[rows.chain(0)]

        return df.groupBy(*keys).applyInPandas(whole, df.schema)

    labelled = cut(chunks.label(df, keys, order[0]))
    parts = [*key_list, CHUNK]
    part_fields = [f for f in labelled.schema.fields if f.name in parts]
    doubles = T.ArrayType(T.DoubleType())
    column = lambda name, kind: T.StructField(name, kind)
    # A state is a last kept row: its values, and its chunk and place, which name it.
    tail_schema = T.StructType([*part_fields, column("place", T.LongType()), column("state", doubles), column("bound", doubles), column("begins", T.BooleanType())])

    def tails(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, rows = rows_of(pdf)
        found, first = rows.tails(), rows.chain(0)[-1]
        head = {k: pdf[k].iloc[0] for k in parts}
        bound = rule.bound(rows.values).tolist()
        return pd.DataFrame([{**head, "place": int(p), "state": rows.values[p].tolist(), "bound": bound, "begins": p == first} for p in found.tolist()])

    states = cut(labelled.groupBy(*parts).applyInPandas(tails, tail_schema))
    # Chunks in which a state's next kept row may be, in order; one row per state, from one small table per key.
    route_schema = T.StructType([*part_fields, column("place", T.LongType()), column("state", doubles), column("begins", T.BooleanType()), column("next_chunks", T.ArrayType(T.LongType()))])

    def routed(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([CHUNK, "place"], ignore_index=True)
        own, first = pdf[CHUNK].to_numpy(), pdf.drop_duplicates(CHUNK).index
        numbers, bounds = own[first], np.array([pdf["bound"].iloc[i] for i in first], float)
        ahead = []
        for chunk, state in zip(own.tolist(), pdf["state"]):
            later = int(np.searchsorted(numbers, chunk, side="right"))
            ahead.append(numbers[later:][rule.may(bounds[later:], np.asarray(state, float))].tolist())
        begins = pdf["begins"].to_numpy(bool) & (own == own[0])  # the key's own first row
        return pdf.assign(begins=begins, next_chunks=ahead)[[f.name for f in route_schema.fields]]

    routes = cut(states.groupBy(*keys).applyInPandas(routed, route_schema))
    hop_schema = T.StructType([*part_fields, *[column(n, T.LongType()) for n in ("from_chunk", "from_place", "place")]])
    waiting, hops = routes.withColumn("_try", F.lit(0)), None

    def follow(pdf: pd.DataFrame, asking: pd.DataFrame) -> pd.DataFrame:
        _, rows = rows_of(pdf)
        out = []
        for chunk, place, state in zip(asking["from_chunk"].tolist(), asking["from_place"].tolist(), asking["state"]):
            at = rows.after(0, np.asarray(state, float)) if len(rows.values) else 0
            end = rows.chain(at)[-1] if at < len(rows.values) else -1
            out.append((*[asking[k].iloc[0] for k in parts], chunk, place, end))
        return pd.DataFrame(out, columns=[f.name for f in hop_schema.fields])

    while True:
        turn = waiting.filter(F.size("next_chunks") > F.col("_try"))
        asked = cut(turn.select(
            *key_list, F.col("next_chunks")[F.col("_try")].alias(CHUNK), F.col(CHUNK).alias("from_chunk"), F.col("place").alias("from_place"), "state",
        ))
        if asked.isEmpty():
            break
        rows = join_equal(labelled, asked.select(*parts).distinct(), parts, "left_semi")
        found = cut(rows.groupBy(*parts).cogroup(asked.groupBy(*parts)).applyInPandas(follow, hop_schema))
        hit = found.filter("place >= 0")
        hops = hit if hops is None else hops.unionByName(hit)
        missed = found.filter("place < 0").select(*key_list, F.col("from_chunk").alias(CHUNK), F.col("from_place").alias("place"))
        waiting = cut(join_equal(waiting, missed, [*parts, "place"], "left_semi").withColumn("_try", F.col("_try") + 1))
    start = routes.filter("begins").select(*parts, "place")
    entered = _entries(start, hops, key_list) if hops is not None else None
    first_chunk = start.select(*parts, F.lit(None).cast(doubles).alias("entry"))
    entry = first_chunk
    if entered is not None:
        source = routes.select(*key_list, F.col(CHUNK).alias("from_chunk"), F.col("place").alias("from_place"), F.col("state").alias("entry"))
        entry = first_chunk.unionByName(join_equal(entered, source, [*key_list, "from_chunk", "from_place"]).select(*parts, "entry"))
    names = [f.name for f in df.schema.fields]

    def chosen(pdf: pd.DataFrame, state: pd.DataFrame) -> pd.DataFrame:
        pdf, rows = rows_of(pdf)
        if not len(state) or not len(pdf):
            return pdf.iloc[:0][names]
        last = state["entry"].iloc[0]
        at = 0 if last is None else rows.after(0, np.asarray(last, float))
        return pdf.iloc[rows.chain(at)][names]

    entry = cut(entry)
    return labelled.groupBy(*parts).cogroup(entry.groupBy(*parts)).applyInPandas(chosen, df.schema)


def _entries(start: DataFrame, hops: DataFrame, keys: list[str]) -> DataFrame:
    """`(keys, chunk, from_chunk, from_place)`: the hops of the chains that begin at `start`, by pointer doubling: a jump table that
    doubles its reach, and the reached states, each round joined once."""
    hops = cut(hops)
    jump = hops.select(*keys, "from_chunk", "from_place", F.col(CHUNK).alias("to_chunk"), F.col("place").alias("to_place"))
    reached = cut(start.select(*keys, F.col(CHUNK).alias("from_chunk"), F.col("place").alias("from_place")))
    here, there = [*keys, "from_chunk", "from_place"], [*keys, "to_chunk", "to_place"]
    total = reached.count()
    while True:
        ahead = join_equal(jump, reached, here).select(*keys, F.col("to_chunk").alias("from_chunk"), F.col("to_place").alias("from_place"))
        reached = cut(reached.unionByName(ahead).distinct())
        now = reached.count()
        if now == total:
            break
        total = now
        second = jump.select(*keys, F.col("from_chunk").alias("to_chunk"), F.col("from_place").alias("to_place"), F.col("to_chunk").alias("end_chunk"), F.col("to_place").alias("end_place"))
        jump = cut(join_equal(jump, second, there).select(*here, F.col("end_chunk").alias("to_chunk"), F.col("end_place").alias("to_place")))
    return join_equal(hops, reached, here).select(*keys, CHUNK, "from_chunk", "from_place")
