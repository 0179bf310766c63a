"""Time association of two trajectories: nearest, one-to-one, interpolated, clamped.

A trajectory has `keys`, `stamp`, `idx` (position in its source, breaks ties between equal stamps) and the
pose columns `x, y, z, qw, qx, qy, qz`. A pair carries both poses as the structs `est` and `gt`. All variants
share one as-of kernel; they differ in the gate, the tie rule and the interpolation, and those differences
are the reason they have separate names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rigid
from .ordered import Chunks, asof

DRIVE = ("drive",)
SAMPLE = ("stamp", "idx", *rigid.POSE_FIELDS)


def _bracket(left: DataFrame, right: DataFrame, keys: Sequence[str], on: str, chunks: Chunks | None) -> DataFrame:
    return asof(left, right, keys, on, "stamp", SAMPLE, tie=("idx",), chunks=chunks)


def _strip(sample: str) -> Column:
    return rigid.pose(sample + ".").struct()


def _own() -> Column:
    return rigid.pose().struct()


def associate_nearest(
    est: DataFrame, gt: DataFrame, max_dt: float = 0.05, keys: Sequence[str] = DRIVE, chunks: Chunks | None = None
) -> DataFrame:
    """Each estimate with its nearest ground truth; equal distance takes the later one; gate inclusive."""
    out = _bracket(est, gt, keys, "stamp", chunks)
    before, after = F.col("stamp") - F.col("prev.stamp"), F.col("next.stamp") - F.col("stamp")
    later = F.col("next").isNotNull() & (F.col("prev").isNull() | (after <= before))
    out = out.withColumn("hit", F.when(later, F.col("next")).otherwise(F.col("prev")))
    out = out.withColumn("dt", F.abs(F.col("hit.stamp") - F.col("stamp"))).filter(F.col("dt") <= max_dt)
    return out.select(
        *keys, "stamp", "idx", F.col("hit.stamp").alias("gt_stamp"), F.col("hit.idx").alias("gt_idx"), "dt",
        F.col("stamp").alias("est_stamp"), F.col("idx").alias("est_idx"), _own().alias("est"),
        _strip("hit").alias("gt"),
    )


def associate_unique(
    est: DataFrame, gt: DataFrame, max_dt: float = 0.05, keys: Sequence[str] = DRIVE, chunks: Chunks | None = None
) -> DataFrame:
    """Nearest, then the closest estimate per ground-truth row (tie: the earliest estimate); in truth order."""
    near = associate_nearest(est, gt, max_dt, keys, chunks)
    best = near.groupBy(*keys, "gt_stamp", "gt_idx").agg(
        F.min_by(F.struct("dt", "est_stamp", "est_idx", "est", "gt"), F.struct("dt", "stamp", "idx")).alias("b")
    )
    return best.select(
        *keys, F.col("b.est_stamp").alias("stamp"), F.col("gt_idx").alias("idx"), "gt_stamp", "gt_idx",
        "b.dt", "b.est_stamp", "b.est_idx", "b.est", "b.gt",
    )


def interpolate_split(
    est: DataFrame, gt: DataFrame, max_dt: float = 0.05, keys: Sequence[str] = DRIVE, chunks: Chunks | None = None
) -> DataFrame:
    """The estimate at every ground-truth stamp: positions linear, rotations along the great arc.

    Interpolates when both brackets are inside the gate; otherwise copies the nearest bracket inside the
    gate (tie: the left one); otherwise drops the row. `est_stamp/est_idx` name the nearest source row.
    """
    out = _bracket(gt, est, keys, "stamp", chunks)
    out = out.withColumns(
        {
            "_l": F.col("stamp") - F.col("prev.stamp"),
            "_r": F.col("next.stamp") - F.col("stamp"),
            "_span": F.col("next.stamp") - F.col("prev.stamp"),
        }
    )
    left = F.coalesce(F.col("_l") <= F.coalesce("_r", F.lit(float("inf"))), F.lit(False))
    both = F.coalesce((F.col("_l") <= max_dt) & (F.col("_r") <= max_dt) & (F.col("_span") > 1.0e-9), F.lit(False))
    out = out.withColumns({"_left": left, "_both": both})
    out = out.filter(F.col("_both") | (F.least("_l", "_r") <= max_dt))
    near = F.when(F.col("_left"), F.col("prev")).otherwise(F.col("next"))
    out = out.withColumns(
        {
            "_near": near,
            "_a": F.when(F.col("_both"), F.col("prev")).otherwise(near),
            "_b": F.when(F.col("_both"), F.col("next")).otherwise(near),
            "_k": F.when(F.col("_both"), F.col("_l") / F.col("_span")).otherwise(F.lit(0.0)),
        }
    )
    a, b, k = rigid.pose("_a."), rigid.pose("_b."), F.col("_k")
    out = rigid.stage_slerp(out, a.q, b.q, k, "_m")
    turned = rigid.Quat(*[F.col(f"_m{n}") for n in ("qw", "qx", "qy", "qz")])
    mixed = rigid.Pose(a.t.scale(F.lit(1.0) - k) + b.t.scale(k), turned)
    est_pose = F.when(F.col("_both"), mixed.struct()).otherwise(_strip("_near"))
    return out.select(
        *keys, "stamp", "idx", F.col("stamp").alias("gt_stamp"), F.col("idx").alias("gt_idx"),
        F.least("_l", "_r").alias("dt"), F.col("_near.stamp").alias("est_stamp"), F.col("_near.idx").alias("est_idx"),
        F.col("_both").alias("interpolated"), est_pose.alias("est"), _own().alias("gt"),
    )


def _with_screw(df: DataFrame) -> DataFrame:
    """Add `_screw` between the structs `prev` and `next` at fraction `_k`."""
    return rigid.stage_screw(df, rigid.pose("prev."), rigid.pose("next."), F.col("_k"), "_screw")


def interpolate_screw(
    est: DataFrame, gt: DataFrame, max_dt: float = 0.05, keys: Sequence[str] = DRIVE, chunks: Chunks | None = None
) -> DataFrame:
    """The estimate at every ground-truth stamp along the screw motion between its brackets.

    The gate looks at the closer bracket only. Before the first estimate the first pose is copied if inside
    the gate. Truth later than the last estimate is not emitted: a live run would still be waiting for it.
    """
    out = _bracket(gt, est, keys, "stamp", chunks).withColumns(
        {"_l": F.col("stamp") - F.col("prev.stamp"), "_r": F.col("next.stamp") - F.col("stamp")}
    )
    reached = F.col("next").isNotNull() | (F.col("_l") <= 1.0e-9)
    out = out.filter(reached & (F.least("_l", "_r") <= max_dt))
    span = F.col("_l") + F.col("_r")
    out = _with_screw(out.withColumn("_k", F.when(span > 1.0e-9, F.col("_l") / span).otherwise(0.0)))
    picked = (
        F.when(F.col("prev").isNull(), _strip("next"))
        .when(F.col("next").isNull(), _strip("prev"))
        .otherwise(F.col("_screw"))
    )
    return out.select(
        *keys, "stamp", "idx", F.col("stamp").alias("gt_stamp"), F.col("idx").alias("gt_idx"),
        F.least("_l", "_r").alias("dt"), picked.alias("est"), _own().alias("gt"),
    )


def interpolate_clamped(
    queries: DataFrame, traj: DataFrame, on: str = "t", keys: Sequence[str] = DRIVE, chunks: Chunks | None = None,
    into: str = "at",
) -> DataFrame:
    """Pose of `traj` at every query time along the screw; outside the trajectory the end pose. No gate."""
    out = _bracket(queries, traj, keys, on, chunks)
    return clamp_bracketed(out, on, into)


def clamp_bracketed(bracketed: DataFrame, on: str, into: str) -> DataFrame:
    """Resolve `prev`/`next` brackets of `on` into one pose struct, clamping at the ends."""
    span = F.col("next.stamp") - F.col("prev.stamp")
    out = bracketed.withColumn(
        "_k", F.when(span > 1.0e-9, (F.col(on) - F.col("prev.stamp")) / span).otherwise(0.0)
    )
    out = _with_screw(out)
    picked = (
        F.when(F.col("prev").isNull(), _strip("next"))
        .when(F.col("next").isNull(), _strip("prev"))
        .otherwise(F.col("_screw"))
    )
    return out.withColumn(into, picked).drop("prev", "next", "_k", "_screw")


def closest_pose(
    queries: DataFrame, traj: DataFrame, on: str = "t", keys: Sequence[str] = DRIVE, chunks: Chunks | None = None
) -> DataFrame:
    """Nearest trajectory row as `hit` with its `dt`; equal distance takes the earlier row."""
    out = _bracket(queries, traj, keys, on, chunks)
    before, after = F.col(on) - F.col("prev.stamp"), F.col("next.stamp") - F.col(on)
    earlier = F.col("prev").isNotNull() & (F.col("next").isNull() | (before <= after))
    out = out.withColumn("hit", F.when(earlier, F.col("prev")).otherwise(F.col("next")))
    return out.withColumn("dt", F.abs(F.col("hit.stamp") - F.col(on))).drop("prev", "next")


def has_pose_near(
    queries: DataFrame, traj: DataFrame, max_dt: float, on: str = "t", keys: Sequence[str] = DRIVE,
    chunks: Chunks | None = None,
) -> DataFrame:
    """Add the boolean `covered`: a trajectory row lies within `max_dt` (inclusive)."""
    out = closest_pose(queries, traj, on, keys, chunks)
    return out.withColumn("covered", F.coalesce(F.col("dt") <= max_dt, F.lit(False))).drop("hit", "dt")
