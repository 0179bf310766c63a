"""Rigid alignment of paired trajectories: by the first pose, and in the least-squares sense without scale.

Each function reduces pairs to one row per key. The reductions are plain sums, so they combine map-side; the
3-D rotation is the only step in Python and sees one row per key.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rigid
from ..schemas import columns

DRIVE = ("drive",)


def _first_pair(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    order = F.struct("stamp", "idx")
    return pairs.groupBy(*keys).agg(
        F.min_by("est", order).alias("est"), F.min_by("gt", order).alias("gt"), F.count(F.lit(1)).alias("n")
    )


def align_first_se2(pairs: DataFrame, keys: Sequence[str] = DRIVE) -> DataFrame:
    """Planar transform `theta, tx, ty` that puts the first estimate pose on the first truth pose."""
    one = _first_pair(pairs, keys)
    e, g = rigid.pose("est."), rigid.pose("gt.")
    one = one.withColumn("theta", rigid.wrap_angle(rigid.yaw_of(g.q) - rigid.yaw_of(e.q)))
    return one.select(*keys, "theta", *_se2_offset("est.x", "est.y", "gt.x", "gt.y"))


def _se2_offset(sx: str, sy: str, dx: str, dy: str):
    c, s = F.cos("theta"), F.sin("theta")
    return (
        (F.col(dx) - (c * F.col(sx) - s * F.col(sy))).alias("tx"),
        (F.col(dy) - (s * F.col(sx) + c * F.col(sy))).alias("ty"),
    )


def align_rigid_se2(pairs: DataFrame, keys: Sequence[str] = DRIVE) -> DataFrame:
    """Planar least-squares transform in closed form; with fewer than two pairs the first-pose one."""
    order = F.struct("stamp", "idx")
    sums = pairs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("est.x").alias("mex"), F.avg("est.y").alias("mey"),
        F.avg("gt.x").alias("mgx"), F.avg("gt.y").alias("mgy"),
        F.covar_pop("est.x", "gt.x").alias("xx"), F.covar_pop("est.y", "gt.y").alias("yy"),
        F.covar_pop("est.x", "gt.y").alias("xy"), F.covar_pop("est.y", "gt.x").alias("yx"),
        F.min_by("est", order).alias("est"), F.min_by("gt", order).alias("gt"),
    )
    single = rigid.wrap_angle(rigid.yaw_of(rigid.pose("gt.").q) - rigid.yaw_of(rigid.pose("est.").q))
    fitted = F.atan2(F.col("xy") - F.col("yx"), F.col("xx") + F.col("yy"))
    sums = sums.withColumn("theta", F.when(F.col("n") < 2, single).otherwise(fitted))
    return sums.select(*keys, "theta", *_se2_offset("mex", "mey", "mgx", "mgy"))


def align_first_se3(pairs: DataFrame, keys: Sequence[str] = DRIVE) -> DataFrame:
    """Spatial transform (struct `tf`) that puts the first estimate pose on the first truth pose."""
    one = _first_pair(pairs, keys)
    e, g = rigid.pose("est."), rigid.pose("gt.")
    return one.select(*keys, g.mul(e.inverse()).struct().alias("tf"))


@F.pandas_udf(columns("w double, x double, y double, z double"))
def _horn_rotation(c: pd.Series) -> pd.DataFrame:
    """Rotation maximising trace(R S) for the cross covariance S (est rows, gt columns), by Horn's quaternion."""
    s = np.asarray(c.tolist(), dtype=float).reshape(-1, 3, 3)
    n = np.empty((len(s), 4, 4))
    trace = np.trace(s, axis1=1, axis2=2)
    skew = np.stack([s[:, 1, 2] - s[:, 2, 1], s[:, 2, 0] - s[:, 0, 2], s[:, 0, 1] - s[:, 1, 0]], axis=1)
    n[:, 0, 0] = trace
    n[:, 0, 1:] = n[:, 1:, 0] = skew
    n[:, 1:, 1:] = s + np.transpose(s, (0, 2, 1)) - trace[:, None, None] * np.eye(3)
    _, vectors = np.linalg.eigh(n)
    q = vectors[:, :, 3]
    return pd.DataFrame({"w": q[:, 0], "x": q[:, 1], "y": q[:, 2], "z": q[:, 3]})


def align_rigid_se3(pairs: DataFrame, keys: Sequence[str] = DRIVE) -> DataFrame:
    """Spatial least-squares transform without scale (struct `tf`); fewer than two pairs: the first-pose one."""
    order = F.struct("stamp", "idx")
    axes = ("x", "y", "z")
    sums = pairs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.avg(f"{side}.{a}").alias(f"m_{side}_{a}") for side in ("est", "gt") for a in axes],
        *[F.covar_pop(f"est.{a}", f"gt.{b}").alias(f"c_{a}{b}") for a in axes for b in axes],
        F.min_by("est", order).alias("est"), F.min_by("gt", order).alias("gt"),
    )
    sums = sums.withColumn("_q", _horn_rotation(F.array(*[F.col(f"c_{a}{b}") for a in axes for b in axes])))
    q = rigid.Quat(*[F.col(f"_q.{n}") for n in ("w", "x", "y", "z")])
    mean_est, mean_gt = rigid.vec("m_est_"), rigid.vec("m_gt_")
    fitted = rigid.Pose(mean_gt - q.rotate(mean_est), q)
    first = rigid.pose("gt.").mul(rigid.pose("est.").inverse())
    return sums.select(
        *keys, F.when(F.col("n") < 2, first.struct()).otherwise(fitted.struct()).alias("tf")
    )


def apply_se2(pairs: DataFrame, transform: DataFrame, keys: Sequence[str] = DRIVE, column: str = "est") -> DataFrame:
    """Left-multiply `column` by the planar transform of its key: yaw about world z, z unchanged."""
    out = pairs.join(transform, list(keys))
    p = rigid.pose(f"{column}.")
    c, s = F.cos("theta"), F.sin("theta")
    moved = rigid.Pose(
        rigid.Vec(c * p.t.x - s * p.t.y + F.col("tx"), s * p.t.x + c * p.t.y + F.col("ty"), p.t.z),
        rigid.yaw_quat(F.col("theta")).mul(p.q),
    )
    return out.withColumn(column, moved.struct()).drop("theta", "tx", "ty")


def apply_se3(pairs: DataFrame, transform: DataFrame, keys: Sequence[str] = DRIVE, column: str = "est") -> DataFrame:
    """Left-multiply `column` by the spatial transform of its key."""
    out = pairs.join(transform, list(keys))
    return out.withColumn(column, rigid.pose("tf.").mul(rigid.pose(f"{column}.")).struct()).drop("tf")


def rigid_summary_se2(transform: DataFrame, keys: Sequence[str] = DRIVE) -> DataFrame:
    return transform.select(
        *keys, F.col("tx").alias("translation_x"), F.col("ty").alias("translation_y"),
        F.hypot("tx", "ty").alias("translation_norm_m"), F.degrees("theta").alias("yaw_deg"),
    )


def rigid_summary_se3(transform: DataFrame, keys: Sequence[str] = DRIVE) -> DataFrame:
    p = rigid.pose("tf.")
    roll, pitch, yaw = rigid.rpy_of(p.q)
    return transform.select(
        *keys, p.t.x.alias("translation_x"), p.t.y.alias("translation_y"), p.t.z.alias("translation_z"),
        p.t.norm().alias("translation_norm_m"), F.degrees(roll).alias("roll_deg"),
        F.degrees(pitch).alias("pitch_deg"), F.degrees(yaw).alias("yaw_deg"),
        F.degrees(rigid.rotation_angle(p.q)).alias("rotation_deg"),
    )
