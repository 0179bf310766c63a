"""IMU operators: frame changes, stationary alignment, dead reckoning, body-twist integration.

Rows: `drive, idx, stamp, ax, ay, az, wx, wy, wz`. The dead-reckoning recursion is a rotation product, a
clamped sum of forward / vertical speed and a plain sum of positions. All three are associative, so a long
drive is cut into chunks and the result is still that of the sequential filter.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rigid, scans
from .ordered import Chunks, asof, lag_row, row_numbers, running
from .scan import FOLD_ROWS, prefix_scan

DRIVE = ("drive",)
ACC, GYR = ("ax", "ay", "az"), ("wx", "wy", "wz")
ORDER = ("stamp", "idx")


def to_right_handed(imu: DataFrame) -> DataFrame:
    """Left-handed sensor axes to right-handed ones."""
    return imu.withColumns({"ay": -F.col("ay"), "wx": -F.col("wx"), "wz": -F.col("wz")})


def lever_arm(
    imu: DataFrame, extrinsic: rigid.Pose, keys: Sequence[str] = DRIVE, chunks: Chunks | None = None
) -> DataFrame:
    """Samples moved into the target frame; `extrinsic` is target-from-IMU.

    Adds alpha x r + w x (w x r) with r = -translation; alpha is the backward difference and is left out on
    the first row and where time does not advance.
    """
    q, r = extrinsic.q, extrinsic.t.scale(F.lit(-1.0))
    turned = imu.withColumns(
        {
            **dict(zip(GYR, q.rotate(rigid.vec(names=GYR)), strict=True)),
            **dict(zip(ACC, q.rotate(rigid.vec(names=ACC)), strict=True)),
        }
    )
    turned = lag_row(turned, keys, ORDER, ("stamp", *GYR), chunks, into="_b")
    w, before = rigid.vec(names=GYR), rigid.vec("_b.", GYR)
    dt = F.col("stamp") - F.col("_b.stamp")
    use = F.coalesce(dt > 0, F.lit(False))
    tangential = (w - before).cross(r)
    centripetal = w.cross(w.cross(r))
    out = {
        name: F.col(name) + F.when(use, t / dt).otherwise(0.0) + c
        for name, t, c in zip(ACC, tangential, centripetal, strict=True)
    }
    return turned.withColumns(out).drop("_b")


def stationary_windows(
    imu: DataFrame, samples: int = 100, gyro: float = 0.05, accel_dev: float = 0.5,
    keys: Sequence[str] = DRIVE, chunks: Chunks | None = None, first_only: bool = False, block: int = 100_000,
) -> DataFrame:
    """Windows of `samples` rows without rotation and with accelerations close to their mean.

    Row numbers are cut into blocks; each block also gets the `samples - 1` rows before it. Per-axis extremes
    around the window mean decide most windows; only the undecided ones look at their single samples.
    Returns `rn` (last row of the window) and `stamp`; with `first_only` the first window per key.
    """
    rows = row_numbers(imu, keys, ORDER, "rn", chunks)
    own = F.floor((F.col("rn") - 1) / block).cast("bigint")
    following = F.floor((F.col("rn") + samples - 2) / block).cast("bigint")
    spread = rows.select(
        *keys, "rn", "stamp", *ACC, rigid.vec(names=GYR).norm().alias("_w"),
        F.explode(F.sequence(own, following)).alias("_block"), own.alias("_own"),
    )
    frame = Window.partitionBy(*keys, "_block").orderBy("rn").rowsBetween(-(samples - 1), 0)
    stats = spread.withColumns(
        {
            "_n": F.count(F.lit(1)).over(frame), "_wmax": F.max("_w").over(frame),
            **{f"_m{a}": F.avg(a).over(frame) for a in ACC},
            **{f"_hi{a}": F.max(a).over(frame) for a in ACC},
            **{f"_lo{a}": F.min(a).over(frame) for a in ACC},
        }
    ).filter((F.col("_block") == F.col("_own")) & (F.col("_n") == samples) & (F.col("_wmax") <= gyro))
    reach = {a: F.greatest(F.col(f"_hi{a}") - F.col(f"_m{a}"), F.col(f"_m{a}") - F.col(f"_lo{a}")) for a in ACC}
    upper = F.sqrt(sum((c * c for c in reach.values()), F.lit(0.0)))
    stats = stats.withColumns({"_upper": upper, "_lower": F.greatest(*reach.values())})
    stats = stats.filter(F.col("_lower") <= accel_dev)
    picked = [*keys, "rn", "stamp"]
    sure = stats.filter(F.col("_upper") <= accel_dev).select(*picked)
    unsure = stats.filter(F.col("_upper") > accel_dev).select(*picked, *[f"_m{a}" for a in ACC])
    if first_only:
        sure = sure.groupBy(*keys).agg(F.min("rn").alias("rn"), F.min("stamp").alias("stamp"))
        limit = sure.select(*keys, F.col("rn").alias("_rn_sure"))
        unsure = unsure.join(limit, list(keys), "left").filter(
            F.col("_rn_sure").isNull() | (F.col("rn") < F.col("_rn_sure"))
        ).drop("_rn_sure")
    single = unsure.withColumn("_at", F.explode(F.sequence(F.col("rn") - (samples - 1), F.col("rn"))))
    near = rows.select(*keys, F.col("rn").alias("_at"), *ACC)
    off = (rigid.vec(names=ACC) - rigid.vec("_m", ACC)).norm()
    checked = (
        single.join(near, [*keys, "_at"]).groupBy(*picked).agg(F.max(off).alias("_off"))
        .filter(F.col("_off") <= accel_dev).select(*picked)
    )
    found = sure.unionByName(checked)
    if first_only:
        found = found.groupBy(*keys).agg(F.min("rn").alias("rn"), F.min("stamp").alias("stamp"))
    return found


def window_alignment(
    imu: DataFrame, windows: DataFrame, samples: int, gravity: float = 9.81, keys: Sequence[str] = DRIVE,
    chunks: Chunks | None = None,
) -> DataFrame:
    """Gyro bias, gravity and orientation (mean acceleration to -Z) from each key's window ending at `rn`."""
    rows = row_numbers(imu, keys, ORDER, "_rn", chunks)
    span = windows.select(*keys, F.col("rn"), F.col("stamp").alias("align_stamp"))
    inside = rows.join(span, list(keys)).filter(
        (F.col("_rn") > F.col("rn") - samples) & (F.col("_rn") <= F.col("rn"))
    )
    return stationary_alignment(inside, gravity, [*keys, "rn", "align_stamp"])


def stationary_alignment(samples: DataFrame, gravity: float = 9.81, keys: Sequence[str] = DRIVE) -> DataFrame:
    """Alignment of one group of stationary samples per key."""
    out = samples.groupBy(*keys).agg(
        *[F.avg(a).alias(f"_{a}") for a in ACC], *[F.avg(g).alias(f"bias_{g}") for g in GYR]
    )
    norm = rigid.vec("_", ACC).norm()
    out = out.withColumn("_norm", norm).filter(F.col("_norm") >= 1.0e-6)
    f = rigid.vec("_", ACC).scale(F.lit(1.0) / F.col("_norm"))
    out = out.withColumns({"_fx": f.x, "_fy": f.y, "_fz": f.z})
    fx, fy, fz = F.col("_fx"), F.col("_fy"), F.col("_fz")
    # Rotation taking the unit vector f to -Z; for f = +Z a half turn about a perpendicular axis.
    flipped = -fz < -1.0 + 1.0e-8
    side = F.sqrt(fz * fz + fy * fy)
    along_x = rigid.Quat(F.lit(0.0), F.lit(0.0), -fz / side, fy / side)
    regular = rigid.unit_quat(rigid.Quat(F.lit(1.0) - fz, -fy, fx, F.lit(0.0)))
    q = [F.when(flipped, a).otherwise(r) for a, r in zip(along_x, regular, strict=True)]
    plausible = (F.col("_norm") >= 8.0) & (F.col("_norm") <= 11.0)
    return out.select(
        *keys, *[f"bias_{g}" for g in GYR], F.when(plausible, F.col("_norm")).otherwise(float(gravity)).alias("gravity"),
        *[c.alias(n) for c, n in zip(q, ("qw", "qx", "qy", "qz"), strict=True)],
    )


def limit_velocity(
    before: tuple[Column, Column], after: tuple[Column, Column], dt: Column, max_speed: float = 20.0,
    max_acceleration: float = 5.0,
) -> tuple[Column, Column, Column]:
    """Body velocity (x, y, z) after one step: no lateral part, bounded change, bounded speed."""
    speed = max(0.0, max_speed)
    out = []
    for b, a in zip(before, after, strict=True):
        b, a = rigid.clamp(b, -speed, speed), rigid.clamp(a, -speed, speed)
        change = F.lit(max(0.0, max_acceleration)) * dt
        stepped = F.when(dt > 1.0e-6, rigid.clamp(a, b - change, b + change)).otherwise(a)
        out.append(rigid.clamp(stepped, -speed, speed))
    return out[0], F.lit(0.0), out[1]


def _drive_rotation(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return scans.quat_mul(a, b)


def _two_clamps(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.concatenate([scans.clamp_add(a[..., :3], b[..., :3]), scans.clamp_add(a[..., 3:], b[..., 3:])], axis=-1)


def dead_reckon(
    imu: DataFrame, alignment: DataFrame, max_dt: float = 0.1, max_speed: float = 20.0,
    max_acceleration: float = 5.0, keys: Sequence[str] = DRIVE, chunks: Chunks | None = None,
) -> DataFrame:
    """Pose and velocity at every sample from the alignment on.

    Carries the velocity with the heading, adds gravity-free acceleration, removes lateral motion, then limits
    change and speed; the position uses the velocity before the limit. Steps that do not advance time or are
    longer than `max_dt` change nothing.
    """
    chunks = chunks or Chunks.plan(imu, keys, "stamp", FOLD_ROWS)
    start = alignment.select(
        *keys, "align_stamp", "gravity", *[f"bias_{g}" for g in GYR],
        *[F.col(f"q{n}").alias(f"_q0{n}") for n in "wxyz"],
    )
    rows = imu.join(start, list(keys)).filter(F.col("stamp") >= F.col("align_stamp"))
    rows = lag_row(rows, keys, ORDER, ("stamp",), chunks, into="_b")
    dt = F.col("stamp") - F.col("_b.stamp")
    rows = rows.withColumn("_dt", F.when((dt > 0) & (dt <= max_dt), dt).otherwise(0.0)).drop("_b")
    body_rate = rigid.Vec(*[F.col(g) - F.col(f"bias_{g}") for g in GYR])
    turn = rigid.so3_exp(body_rate.scale(F.col("_dt")))
    rows = rows.withColumns({f"_t{n}": c for n, c in zip("wxyz", turn, strict=True)})
    rows = prefix_scan(
        rows, keys, ORDER, [f"_t{n}" for n in "wxyz"], [f"_r{n}" for n in "wxyz"], _drive_rotation, chunks
    )
    q0 = rigid.Quat(*[F.col(f"_q0{n}") for n in "wxyz"])
    turned = q0.mul(rigid.Quat(*[F.col(f"_r{n}") for n in "wxyz"]))
    rows = rows.withColumns({f"q{n}": c for n, c in zip("wxyz", turned, strict=True)})
    q = rigid.unit_quat(rigid.Quat(*[F.col(f"q{n}") for n in "wxyz"]))
    rows = rows.withColumns({f"q{n}": c for n, c in zip("wxyz", q, strict=True)})
    rows = rows.drop(*[f"_{p}{n}" for p in ("t", "r", "q0") for n in "wxyz"])
    q = rigid.Quat(*[F.col(f"q{n}") for n in "wxyz"])
    up = q.conj().rotate(rigid.Vec(F.lit(0.0), F.lit(0.0), F.col("gravity")))
    rows = rows.withColumns(
        {"_dx": (F.col("ax") + up.x) * F.col("_dt"), "_dz": (F.col("az") + up.z) * F.col("_dt")}
    )
    change = F.lit(float(max_acceleration)) * F.col("_dt")
    bound = {
        f"_b{a}": F.when(F.col("_dt") > 1.0e-6, rigid.clamp(F.col(f"_d{a}"), -change, change)).otherwise(F.col(f"_d{a}"))
        for a in "xz"
    }
    rows = rows.withColumns(
        {**bound, "_lo": F.lit(-float(max_speed)), "_hi": F.lit(float(max_speed))}
    )
    outs = [f"_p{a}{k}" for a in "xz" for k in ("d", "l", "h")]
    rows = prefix_scan(
        rows, keys, ORDER, ["_bx", "_lo", "_hi", "_bz", "_lo", "_hi"], outs, _two_clamps, chunks
    )
    # Speed starts at zero, so the prefix applied to 0 is the speed after the row.
    speed = {f"_s{a}": rigid.clamp(F.col(f"_p{a}d"), F.col(f"_p{a}l"), F.col(f"_p{a}h")) for a in "xz"}
    rows = rows.withColumns(speed).drop(*outs, "_bx", "_bz", "_lo", "_hi")
    rows = lag_row(rows, keys, ORDER, ("_sx", "_sz"), chunks, into="_b")
    raw = {a: F.coalesce(F.col(f"_b._s{a}"), F.lit(0.0)) + F.col(f"_d{a}") for a in "xz"}
    rows = rows.withColumns({f"_u{a}": c for a, c in raw.items()}).drop("_b")
    step = q.rotate(rigid.Vec(F.col("_ux"), F.lit(0.0), F.col("_uz"))).scale(F.col("_dt"))
    world = q.rotate(rigid.Vec(F.col("_sx"), F.lit(0.0), F.col("_sz")))
    fast = F.greatest(F.abs("_ux"), F.abs("_uz")) > max_speed + 1.0e-3
    rows = rows.withColumns(
        {
            **{f"_m{a}": c for a, c in zip("xyz", step, strict=True)},
            **{f"v{a}": c for a, c in zip("xyz", world, strict=True)},
            "speed_clamped": fast & (F.col("_dt") > 0),
        }
    )
    rows = running(rows, keys, ORDER, {a: ("sum", F.col(f"_m{a}")) for a in "xyz"}, chunks)
    return rows.select(
        *keys, "idx", "stamp", "x", "y", "z", "qw", "qx", "qy", "qz", "vx", "vy", "vz", "speed_clamped"
    )


def twist_between(
    twist: DataFrame, intervals: DataFrame, max_gap: float, keys: Sequence[str] = DRIVE,
    chunks: Chunks | None = None,
) -> DataFrame:
    """Body motion over every interval `[t0, t1]` under piecewise constant twist (the left sample holds).

    The product over all samples is scanned once; an interval then needs its two end samples only:
    exp(xi_a (t_a - t0)) C_a^-1 C_b exp(xi_b (t1 - t_b)). `motion` is null where the samples do not cover
    the interval within `max_gap` or a used sample is not finite.
    """
    chunks = chunks or Chunks.plan(twist, keys, "stamp", FOLD_ROWS)
    sample = ("stamp", *rigid.TWIST_FIELDS)
    rows = lag_row(twist, keys, ORDER, sample, chunks, into="_b")
    bad = F.greatest(*[F.when(c, 1).otherwise(0) for c in
                       [~F.coalesce(F.abs(F.col(f"_b.{n}")) < float("inf"), F.lit(False)) for n in rigid.TWIST_FIELDS]])
    dt = F.col("stamp") - F.col("_b.stamp")
    held = rigid.twist("_b.")
    held = rigid.Twist(*[rigid.Vec(*[F.coalesce(F.nanvl(c, F.lit(0.0)), F.lit(0.0)) for c in v]) for v in held])
    step = held.scale(F.coalesce(dt, F.lit(0.0)))
    rows = rows.withColumn("_xi", step.struct())
    rows = rigid.stage_se3_exp(rows, rigid.twist("_xi."), "_link").drop("_xi")
    link = rigid.pose("_link.")
    rows = rows.withColumns(
        {
            "_hole": F.when(dt > max_gap + 1.0e-9, 1).otherwise(0),
            "_bad": F.when(F.col("_b").isNull() | (dt <= 0), 0).otherwise(bad),
            **{f"_i{n}": c for n, c in zip(rigid.POSE_FIELDS, (*link.t, *link.q), strict=True)},
        }
    ).drop("_b", "_link")
    rows = running(
        rows, keys, ORDER, {"_holes": ("sum", F.col("_hole")), "_bads": ("sum", F.col("_bad"))}, chunks
    ).drop("_hole", "_bad")
    rows = prefix_scan(
        rows, keys, ORDER, [f"_i{n}" for n in rigid.POSE_FIELDS], [f"c_{n}" for n in rigid.POSE_FIELDS],
        scans.pose_mul, chunks,
    )
    fields = (*sample, "_holes", "_bads", *[f"c_{n}" for n in rigid.POSE_FIELDS])
    out = asof(intervals, rows, keys, "t0", "stamp", fields, tie=("idx",), strict_next=True, chunks=chunks)
    out = out.withColumn("a", F.coalesce("prev", "next")).drop("prev", "next")
    out = asof(out, rows, keys, "t1", "stamp", fields, tie=("idx",), strict_next=True, chunks=chunks)
    out = out.withColumn("b", F.coalesce("prev", F.col("a"))).drop("prev", "next")
    eps = max_gap + 1.0e-9
    covered = (
        F.col("a").isNotNull() & (F.col("a.stamp") <= F.col("t0") + eps)
        & (F.col("t1") - F.col("b.stamp") <= eps) & (F.col("b._holes") == F.col("a._holes"))
        & (F.col("b._bads") == F.col("a._bads")) & (F.col("t1") >= F.col("t0"))
    )

    def usable(s: str) -> Column:
        return F.least(*[F.coalesce(F.abs(F.col(f"{s}.{n}")) < float("inf"), F.lit(False)) for n in rigid.TWIST_FIELDS])

    covered = covered & usable("a") & ((F.col("b.stamp") >= F.col("t1") - 1.0e-9) | usable("b"))
    out = out.withColumn("_ok", F.coalesce(covered, F.lit(False)))
    out = out.withColumns(
        {
            "_xa": rigid.twist("a.").scale(F.col("a.stamp") - F.col("t0")).struct(),
            "_xb": rigid.twist("b.").scale(F.col("t1") - F.col("b.stamp")).struct(),
        }
    )
    out = rigid.stage_se3_exp(out, rigid.twist("_xa."), "_lead")
    out = rigid.stage_se3_exp(out, rigid.twist("_xb."), "_tail").drop("_xa", "_xb")
    middle = rigid.pose("a.c_").between(rigid.pose("b.c_"))
    out = out.withColumn("_mid", rigid.pose("_lead.").mul(middle).struct())
    motion = rigid.pose("_mid.").mul(rigid.pose("_tail."))
    return out.withColumn("motion", F.when(F.col("_ok"), motion.struct())).drop(
        "a", "b", "_ok", "_lead", "_tail", "_mid"
    )


def filter_twist(twist: DataFrame, body_frame: str = "base_link", frame: str = "frame_id") -> DataFrame:
    """Rows with finite twist whose frame is empty or the body frame."""
    ok = F.least(*[F.coalesce(F.abs(F.col(n)) < float("inf"), F.lit(False)) for n in rigid.TWIST_FIELDS])
    return twist.filter(ok & (F.col(frame).isNull() | (F.col(frame) == "") | (F.col(frame) == body_frame)))


def pair_scans(
    scans_df: DataFrame, traj: DataFrame, anchors: DataFrame, twist: DataFrame | None, max_pair_dt: float = 0.05,
    max_speed: float = 20.0, max_yaw_rate: float = 1.0, max_gap: float = 0.05, keys: Sequence[str] = DRIVE,
    chunks: Chunks | None = None,
) -> DataFrame:
    """Seed pose of every scan that has an IMU pose within `max_pair_dt` of its end.

    `scans_df`: `scan_id, scan_end`; `anchors`: `scan_id, anchor_stamp, anchor` (last committed pose). The
    seed is the anchor moved by the IMU motion since then; a covered twist of plausible size replaces it.
    """
    from .association import clamp_bracketed, closest_pose, SAMPLE

    near = closest_pose(scans_df, traj, "scan_end", keys, chunks).filter(F.col("dt") <= max_pair_dt)
    near = near.drop("hit", "dt").join(anchors, [*keys, "scan_id"], "left")

    def at(df: DataFrame, on: str, into: str) -> DataFrame:
        return clamp_bracketed(asof(df, traj, keys, on, "stamp", SAMPLE, tie=("idx",), chunks=chunks), on, into)

    near = at(at(near, "scan_end", "imu_end"), "anchor_stamp", "imu_anchor")
    first = traj.groupBy(*keys).agg(F.min("stamp").alias("_t0"))
    near = near.join(first, list(keys))
    held = (F.col("anchor_stamp") + 1.0e-6 >= F.col("_t0")) & (F.col("anchor_stamp") <= F.col("scan_end"))
    move = rigid.pose("imu_anchor.").between(rigid.pose("imu_end."))
    near = near.withColumn("_move", move.struct())
    moved = rigid.pose("anchor.").mul(rigid.pose("_move."))
    near = near.withColumn(
        "seed", F.when(F.coalesce(held, F.lit(False)), moved.struct()).otherwise(F.col("imu_end"))
    ).drop("_move", "imu_anchor", "_t0")
    if twist is None:
        return near.withColumn("twist_prior", F.lit(False))
    near = near.withColumns({"t0": F.col("anchor_stamp"), "t1": F.col("scan_end")})
    near = twist_between(twist, near, max_gap, keys, chunks)
    dt = F.greatest(F.lit(0.0), F.col("t1") - F.col("t0"))
    m = rigid.pose("motion.")
    use = F.coalesce(
        (m.t.norm() <= max_speed * dt + 1.0) & (rigid.rotation_angle(m.q) <= max_yaw_rate * dt + 0.5), F.lit(False)
    )
    return near.withColumn("twist_prior", use).withColumn(
        "seed", F.when(use, rigid.pose("anchor.").mul(m).struct()).otherwise(F.col("seed"))
    ).drop("t0", "t1", "motion")


def _moved(p: np.ndarray, t: Sequence, q: Sequence) -> None:
    """Poses (rows x, y, z, qw, qx, qy, qz; one column each) times a motion of which every part is a number or one per pose."""
    (x, y, z, w, a, b, c), (tx, ty, tz), (qw, qa, qb, qc) = p, t, q
    ux, uy, uz = 2.0 * (b * tz - c * ty), 2.0 * (c * tx - a * tz), 2.0 * (a * ty - b * tx)
    p[:] = (
        x + tx + w * ux + b * uz - c * uy, y + ty + w * uy + c * ux - a * uz, z + tz + w * uz + a * uy - b * ux,
        w * qw - a * qa - b * qb - c * qc, w * qa + a * qw + b * qc - c * qb,
        w * qb - a * qc + b * qw + c * qa, w * qc + a * qb - b * qa + c * qw,
    )


def _blended(p: np.ndarray, stamps: np.ndarray, c: dict[str, np.ndarray]) -> None:
    """Poses, columns in order of `stamps`, with the corrections applied one after another, each to the stretch that it covers."""
    first = np.searchsorted(stamps, c["since"], side="right")
    last = np.searchsorted(stamps, c["tip"], side="right")
    ramp = np.where(c["scan"] - c["since"] > 1.0e-9, np.searchsorted(stamps, c["scan"], side="left"), first).clip(first, last)
    xi = c["xi"]
    v, w, angle = xi[:, :3], xi[:, 3:], np.linalg.norm(xi[:, 3:], axis=1)
    u = np.cross(w, v)
    uu, whole = np.cross(w, u), scans.se3_exp(xi)
    for i in np.flatnonzero(last > first).tolist():
        a, m, b = first[i], ramp[i], last[i]
        if m > a:  # exp of the scaled tangent: its directions stay, only three lengths and the angle change
            alpha = ((stamps[a:m] - c["since"][i]) / (c["scan"][i] - c["since"][i])).clip(0.0, 1.0)
            t = alpha * angle[i]
            small, half, square = t < 1.0e-3, 0.5 * t, t * t
            safe = np.where(small, 1.0, t)
            sine = np.sin(half)
            k2 = alpha * alpha * np.where(small, 0.5 - square / 24.0, (1.0 - np.cos(safe)) / (safe * safe))
            k3 = alpha**3 * np.where(small, 1.0 / 6.0 - square / 120.0, (safe - np.sin(safe)) / (safe * safe * safe))
            turn = alpha * np.where(t < 1.0e-8, 0.5, sine / np.where(t < 1.0e-8, 1.0, t))
            _moved(p[:, a:m], [alpha * v[i, k] + k2 * u[i, k] + k3 * uu[i, k] for k in range(3)], [np.cos(half), *[turn * w[i, k] for k in range(3)]])
        if b > m:
            _moved(p[:, m:b], whole[i, :3].tolist(), whole[i, 3:].tolist())


def blend_corrections(
    poses: DataFrame, corrections: DataFrame, keys: Sequence[str] = DRIVE, bucket_s: float = 5.0
) -> DataFrame:
    """Poses with later scan corrections blended in: pose * product of exp(alpha log delta).

    `corrections`: `seq, since, scan, tip, delta` (pose struct). A correction touches poses with
    since < stamp <= tip; alpha ramps from 0 to 1 over (since, scan] and stays 1 up to the tip. Corrections
    apply in `seq` order. Poses of a time bucket meet the corrections that reach into it in one group; the pairs of both
    exist only there, one correction at a time, so memory and shuffle are those of the rows and not of the pairs.
    """
    c = rigid.stage_se3_log(corrections, rigid.pose("delta."), "xi").withColumn(
        "_bucket",
        F.explode(F.sequence(F.floor(F.col("since") / bucket_s).cast("bigint"),
                             F.floor(F.col("tip") / bucket_s).cast("bigint"))),
    )
    xi = [F.col(f"xi.{n}").alias(f"xi_{n}") for n in rigid.TWIST_FIELDS]
    size = F.sqrt(sum((F.col(f"xi.{n}") ** 2 for n in rigid.TWIST_FIELDS), F.lit(0.0)))
    known = reduce(and_, [F.col(k).isNotNull() for k in keys])  # a pose without a key has no corrections
    c = c.filter((size > 1.0e-8) & known).select(*keys, "_bucket", "seq", "since", "scan", "tip", *xi)
    p = poses.withColumn("_bucket", F.floor(F.col("stamp") / bucket_s).cast("bigint"))
    schema, fields = poses.schema, list(rigid.POSE_FIELDS)

    def together(rows: pa.Table, fixes: pa.Table) -> pa.Table:
        rows = rows.select(schema.names)
        if not rows.num_rows or not fixes.num_rows:
            return rows
        rows = rows.sort_by("stamp")  # nulls and NaN last: no correction reaches them
        order = ["seq", "since", "scan", "tip"]
        fixes = fixes.sort_by([(n, "ascending") for n in [*order, *[f"xi_{n}" for n in rigid.TWIST_FIELDS]]])
        col = lambda table, name: table.column(name).to_numpy(zero_copy_only=False).astype(float)
        fix = {n: col(fixes, n) for n in order[1:]} | {"xi": np.stack([col(fixes, f"xi_{n}") for n in rigid.TWIST_FIELDS], axis=1)}
        out = np.stack([col(rows, n) for n in fields])
        _blended(out, col(rows, "stamp"), fix)
        for k, n in enumerate(fields):
            at = rows.schema.get_field_index(n)
            rows = rows.set_column(at, rows.schema.field(at), pa.array(out[k], rows.schema.field(at).type, from_pandas=True))
        return rows

    parts = [*keys, "_bucket"]
    return p.groupBy(*parts).cogroup(c.groupBy(*parts)).applyInArrow(together, schema)
