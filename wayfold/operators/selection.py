"""Greedy, order-dependent selections: keyframes, decimation, stable peak ids."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.rigid import POSE_FIELDS
from .hops import Rule, select_kept
from .ordered import Chunks, row_numbers
from .scan import FOLD_ROWS, chunked_fold

DRIVE = ("drive",)


def _far(poses: np.ndarray, last: np.ndarray, min_t: float, min_r: float) -> np.ndarray:
    moved = np.linalg.norm(poses[:, :3] - last[:3], axis=1) >= min_t
    dot = np.abs(poses[:, 3:] @ last[3:])
    return moved | (2.0 * np.arccos(np.clip(dot, 0.0, 1.0)) >= min_r)


def next_keyframe(poses: np.ndarray, start: int, last: np.ndarray, min_t: float, min_r: float) -> int:
    """First row at or after `start` far enough from `last`; len(poses) if none."""
    block = 64
    while start < len(poses):
        hit = _far(poses[start:start + block], last, min_t, min_r)
        if hit.any():
            return start + int(hit.argmax())
        start += block
        block = min(block * 2, 65536)
    return len(poses)


def keyframes(
    poses: DataFrame, min_translation: float = 0.5, min_rotation: float = 0.05, keys: Sequence[str] = DRIVE,
    chunks: Chunks | None = None,
) -> DataFrame:
    """First pose of a key, then each pose that moved or turned enough from the last kept one."""
    chunks = chunks or Chunks.plan(poses, keys, "stamp", FOLD_ROWS)
    return select_kept(poses, keys, ("stamp", "idx"), _pose_rule(min_translation, min_rotation), chunks)


def _pose_rule(min_t: float, min_r: float) -> Rule:
    """Poses far from the last kept one. Bounds: the box of the positions, a middle attitude and the largest turn from it."""

    def turn(q: np.ndarray, of: np.ndarray) -> np.ndarray:
        return 2.0 * np.arccos(np.clip(np.abs(q @ of), 0.0, 1.0))

    def bound(rows: np.ndarray) -> np.ndarray:
        middle = rows[len(rows) // 2, 3:]
        return np.concatenate([rows[:, :3].min(axis=0), rows[:, :3].max(axis=0), middle, [turn(rows[:, 3:], middle).max()]])

    def may(bounds: np.ndarray, last: np.ndarray) -> np.ndarray:
        if not len(bounds):
            return np.zeros(0, bool)
        reach = np.linalg.norm(np.maximum(np.abs(last[:3] - bounds[:, :3]), np.abs(last[:3] - bounds[:, 3:6])), axis=1)
        near = (reach < min_t * (1 - 1e-12)) & (turn(bounds[:, 6:10], last[3:]) + bounds[:, 10] < min_r - 1e-6)
        return ~near  # a bound that is not a number excludes nothing

    return Rule(tuple(POSE_FIELDS), lambda rows, last: _far(rows, last, min_t, min_r), bound, may)


def decimate(
    rows: DataFrame, min_dt: float, cap: int | None = None, keys: Sequence[str] = DRIVE,
    chunks: Chunks | None = None, order: str = "idx",
) -> DataFrame:
    """Rows at least `min_dt` after the last kept one, or earlier than it; then the newest `cap` rows."""
    chunks = chunks or Chunks.plan(rows, keys, order, FOLD_ROWS)

    out = select_kept(rows, keys, (order,), _stamp_rule(min_dt), chunks)
    if cap is None:
        return out
    numbered = row_numbers(out, keys, (order,), "_rn", chunks)
    total = numbered.groupBy(*keys).agg(F.max("_rn").alias("_total"))
    return numbered.join(total, list(keys)).filter(F.col("_rn") > F.col("_total") - cap).drop("_rn", "_total")


def _stamp_rule(min_dt: float) -> Rule:
    """Stamps at least `min_dt` after the last kept one, or before it. Bounds: the smallest and the largest stamp."""

    def may(bounds: np.ndarray, last: np.ndarray) -> np.ndarray:
        return (bounds[:, 0] < last[0]) | (bounds[:, 1] - last[0] >= min_dt) if len(bounds) else np.zeros(0, bool)

    def far(rows: np.ndarray, last: np.ndarray) -> np.ndarray:
        return (rows[:, 0] - last[0] >= min_dt) | (rows[:, 0] < last[0])

    return Rule(("stamp",), far, lambda rows: np.array([rows[:, 0].min(), rows[:, 0].max()]), may)


def match_ids(centers: np.ndarray, known: np.ndarray, known_ids: Sequence[int], reach: float) -> list[int]:
    """Ids for one frame's peaks in vote order: nearest free known peak within `reach`, else the lowest free id."""
    ids, owners = np.zeros(len(centers), np.int64), np.asarray(known_ids, np.int64)
    if len(centers) and len(owners):
        apart = ((np.asarray(centers, float)[:, None] - np.asarray(known, float)[None]) ** 2).sum(axis=2)
        open_ = np.where((apart <= reach * reach) & (owners > 0), apart, np.inf)[:, ::-1]  # equal distance: the later one
        for peak, row in enumerate(open_):
            pick = int(row.argmin())
            if np.isfinite(row[pick]):
                ids[peak] = owners[len(owners) - 1 - pick]
                open_[:, pick] = np.inf
    new = np.flatnonzero(ids == 0)
    ids[new] = np.setdiff1d(np.arange(1, len(ids) + 1), ids)[: len(new)]
    return ids.tolist()


def stable_ids(
    peaks: DataFrame, reach: float, keys: Sequence[str] = DRIVE, chunks: Chunks | None = None
) -> DataFrame:
    """Class ids kept from frame to frame. Peaks: `keys, frame, rank, c0..c4, votes`; adds `id`.

    A frame without peaks does not appear here; as in a live run it would clear the memory, so a gap in
    `frame` numbers restarts the ids.
    """
    chunks = chunks or Chunks.plan(peaks, keys, "frame", FOLD_ROWS)
    dims = [f"c{i}" for i in range(5)]
    schema = T.StructType([*peaks.schema.fields, T.StructField("id", T.IntegerType())])
    state = T.StructType(
        [T.StructField("frame", T.LongType()), T.StructField("known", T.ArrayType(T.DoubleType())),
         T.StructField("ids", T.ArrayType(T.IntegerType()))]
    )

    def fold(pdf: pd.DataFrame, carry: dict | None):
        pdf = pdf.copy()
        pdf["id"] = 0
        frame = None if carry is None else int(carry["frame"])
        known = np.zeros((0, 5)) if carry is None else np.asarray(list(carry["known"]), float).reshape(-1, 5)
        ids = [] if carry is None else [int(i) for i in carry["ids"]]
        for number, rows in pdf.groupby("frame", sort=True):
            if frame is None or int(number) != frame + 1:
                known, ids = np.zeros((0, 5)), []
            centers = rows[dims].to_numpy(float)
            ids = match_ids(centers, known, ids, reach)
            pdf.loc[rows.index, "id"] = ids
            known, frame = centers, int(number)
        pdf["id"] = pdf["id"].astype("int32")
        return pdf, {"frame": frame, "known": known.reshape(-1).tolist(), "ids": ids}

    return chunked_fold(peaks, keys, ("frame", "rank"), fold, state, schema, chunks)
