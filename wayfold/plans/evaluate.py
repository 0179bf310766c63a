"""End-to-end trajectory evaluation: planar report, spatial comparison, error sections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..formats import FILTER
from ..functions import rigid
from ..operators import align, association, metrics, sections
from ..operators.ordered import Chunks
from ..session import cut, stored

DRIVE = ("drive",)


def _prefixed(df: DataFrame, keys: Sequence[str], prefix: str) -> DataFrame:
    return df.select(*keys, *[F.col(c).alias(prefix + c) for c in df.columns if c not in keys])


def evaluate_planar(
    est: DataFrame, gt: DataFrame, max_dt: float = 0.05, delta_s: float = 1.0,
    lengths: Sequence[float] = metrics.KITTI_LENGTHS, keys: Sequence[str] = DRIVE, chunks: Chunks | None = None,
    parts: Sequence[str] = ("report", "kitti"),
) -> tuple[DataFrame | None, DataFrame | None]:
    """Planar report per key (ATE after least-squares and first-pose alignment, RPE, rate) and KITTI per length.

    RPE and KITTI compare relative motions, which a rigid alignment does not change. Chunks of errors and distances are measured
    when a table is asked for; one that is not named in `parts` is None and costs nothing.
    """
    chunks = chunks or Chunks.plan(gt, keys, "stamp")
    pairs = association.associate_nearest(est, gt, max_dt, keys, chunks)
    pairs = pairs.persist() if chunks.whole else cut(pairs)
    fitted = align.apply_se2(pairs, align.align_rigid_se2(pairs, keys), keys)
    report = kitti = None
    if "report" in parts:
        first = align.apply_se2(pairs, align.align_first_se2(pairs, keys), keys)
        on = list(keys)
        enough = metrics.association_rate(pairs, keys).withColumn(
            "association_hz", F.when(F.col("n") < 2, 0.0).otherwise(F.col("association_hz"))
        )
        report = (
            enough.join(_prefixed(metrics.ate_planar(fitted, keys, chunks), keys, "fit_"), on, "left")
            .join(_prefixed(metrics.ate_planar(first, keys, chunks), keys, "first_"), on, "left")
            .join(_prefixed(metrics.rpe(fitted, delta_s, keys, chunks), keys, "rpe_"), on, "left")
        )
    if "kitti" in parts:
        kitti = metrics.kitti_by_length(
            metrics.kitti_segments_legacy(fitted, lengths, keys, chunks), pairs, lengths, keys
        )
    return report, kitti


PARTS = ("ate", "rpe", "segments", "kitti", "transforms", "errors")


def compare_pairs(
    pairs: DataFrame, route: DataFrame | None = None, delta_s: float = 1.0,
    lengths: Sequence[float] = metrics.KITTI_LENGTHS, keys: Sequence[str] = DRIVE, chunks: Chunks | None = None,
    parts: Sequence[str] = PARTS,
) -> dict[str, DataFrame]:
    """Spatial comparison of associated pairs.

    Returns the tables named in `parts`: `ate` (raw / first / se2 / se3), `rpe`, `segments` (both spaces), `kitti`, `transforms`
    and `errors` per pose. One that is not named costs nothing (chunks are measured when a table is made). `route` (`gt_stamp,
    gt_idx, distance`) is the distance along the full truth route; it may have fewer keys than the pairs (one truth for several
    estimators).
    """
    chunks = chunks or Chunks.plan(pairs, keys, "stamp")
    se2, se3 = align.align_rigid_se2(pairs, keys), align.align_rigid_se3(pairs, keys)
    out = {}
    if "ate" in parts:
        first = align.align_first_se3(pairs, keys)
        in_se2, in_se3 = align.apply_se2(pairs, se2, keys), align.apply_se3(pairs, se3, keys)
        versions = {"raw": pairs, "first": align.apply_se3(pairs, first, keys), "se2": in_se2, "se3": in_se3}
        tagged = None
        for name, df in versions.items():
            one = df.select(*keys, "stamp", "idx", "est", "gt").withColumn("alignment", F.lit(name))
            tagged = one if tagged is None else tagged.unionByName(one)
        out["ate"] = metrics.ate_split(tagged, [*keys, "alignment"], chunks)
    if "rpe" in parts:
        out["rpe"] = metrics.rpe(pairs, delta_s, keys, chunks)
    if "segments" in parts or "kitti" in parts:
        segments = metrics.kitti_segments(pairs, "se2", lengths, metrics.KITTI_STEP, keys, chunks).unionByName(
            metrics.kitti_segments(pairs, "se3", lengths, metrics.KITTI_STEP, keys, chunks)
        )
        out |= {"segments": segments, "kitti": metrics.kitti_rollup(segments, [*keys, "space"])}
    if "transforms" in parts:
        out["transforms"] = align.rigid_summary_se2(se2, keys).join(
            _prefixed(align.rigid_summary_se3(se3, keys), keys, "se3_"), list(keys)
        )
    if "errors" in parts:
        out["errors"] = per_pose_errors(pairs, se2, se3, route, keys)
    return out


PAIR = ("stamp", "idx", "gt_stamp", "gt_idx", "est_idx", "est", "gt")


def compare_estimators(
    pairs: dict[str, DataFrame], route: DataFrame | None = None, delta_s: float = 1.0,
    lengths: Sequence[float] = metrics.KITTI_LENGTHS, keys: Sequence[str] = DRIVE, chunks: Chunks | None = None,
    parts: Sequence[str] = PARTS,
) -> dict[str, DataFrame]:
    """`compare_pairs` of several estimators at once; its tables have the column `estimator` besides the keys.

    The estimator is one more key of every reduction, so that two estimators cost one job of twice the rows. `errors` keep
    `est_idx`, the estimate's source row, by which the signals of that row can be joined.
    """
    tagged = None
    for name, df in pairs.items():
        one = df.select(*keys, F.lit(name).alias("estimator"), *PAIR)
        tagged = one if tagged is None else tagged.unionByName(one)
    if tagged is None:
        raise ValueError("no estimator to compare")
    return compare_pairs(stored(tagged), route, delta_s, lengths, [*keys, "estimator"], chunks, parts)


def per_pose_errors(
    pairs: DataFrame, se2: DataFrame, se3: DataFrame, route: DataFrame | None = None, keys: Sequence[str] = DRIVE
) -> DataFrame:
    """Every pair with its raw, SE(2)- and SE(3)-aligned errors and body-frame residuals."""
    on = list(keys)
    out = pairs.withColumn("_raw", F.col("est"))
    out = align.apply_se2(out, se2, on).withColumns({"_se2": F.col("est"), "est": F.col("_raw")})
    out = align.apply_se3(out, se3, on).withColumns({"_se3": F.col("est"), "est": F.col("_raw")})
    e, g = rigid.pose("est."), rigid.pose("gt.")
    p2, p3 = rigid.pose("_se2."), rigid.pose("_se3.")
    er, gr = rigid.rpy_of(e.q), rigid.rpy_of(g.q)
    out = out.withColumns(
        {
            "gt_x": g.t.x, "gt_y": g.t.y, "gt_z": g.t.z, "gt_roll": gr[0], "gt_pitch": gr[1], "gt_yaw": gr[2],
            "est_x": e.t.x, "est_y": e.t.y, "est_z": e.t.z, "est_roll": er[0], "est_pitch": er[1], "est_yaw": er[2],
            "se2_x": p2.t.x, "se2_y": p2.t.y, "se2_yaw": rigid.yaw_of(p2.q),
            "se3_x": p3.t.x, "se3_y": p3.t.y, "se3_z": p3.t.z, "se3_yaw": rigid.yaw_of(p3.q),
        }
    )
    body = g.q.conj().rotate(p3.t - g.t)
    angle = {n: F.degrees(rigid.wrap_angle(F.col(f"est_{n}") - F.col(f"gt_{n}"))) for n in ("roll", "pitch", "yaw")}
    out = out.withColumns(
        {
            "err_horiz_se2_m": F.hypot(F.col("se2_x") - F.col("gt_x"), F.col("se2_y") - F.col("gt_y")),
            "err_yaw_se2_deg": F.degrees(rigid.wrap_angle(F.col("se2_yaw") - F.col("gt_yaw"))),
            "err_horiz_se3_m": F.hypot(F.col("se3_x") - F.col("gt_x"), F.col("se3_y") - F.col("gt_y")),
            "err_vert_raw_m": F.col("est_z") - F.col("gt_z"), "err_xyz_se3_m": (p3.t - g.t).norm(),
            "err_long_m": body.x, "err_lat_m": body.y, "err_vert_m": body.z,
            "err_roll_deg": angle["roll"], "err_pitch_deg": angle["pitch"], "err_yaw_deg": angle["yaw"],
        }
    ).drop("_raw", "_se2", "_se3")
    if route is None:
        return out
    shared = [*[k for k in on if k in route.columns], "gt_stamp", "gt_idx"]
    return out.join(route.select(*shared, F.col("distance").alias("distance_m")), shared)


SIGNALS = (
    "err_x", "err_y", "err_z", "err_yaw_filter", "bg_x", "bg_y", "bg_z", "ba_x", "ba_y", "ba_z",
    "imu_ax", "imu_ay", "imu_az", "imu_wx", "imu_wy", "imu_wz", "body_vx", "body_vy", "body_vz",
    "odom_age", "pose_applied",
)


def build_sections(
    errors: DataFrame, segments: DataFrame, signals: DataFrame, floor_m: float = 5.0, percentile: float = 90.0,
    min_length_m: float = 20.0, top_k: int = 5, origin: float = 0.0, keys: Sequence[str] = DRIVE,
    chunks: Chunks | None = None, bucket_s: float = 600.0,
) -> DataFrame:
    """Sections of high error of both estimators with statistics and blame.

    `errors`: `estimator, stamp, idx, est_idx, horiz, vert, yaw_deg, distance`; `segments`: KITTI segments with
    `estimator, space`; `signals`: filter signals by the `idx` of the filter's estimates.
    """
    owner = [*keys, "estimator"]
    thresholds = sections.section_threshold(errors, "horiz", floor_m, percentile, owner, chunks)
    runs = sections.error_spans(errors, thresholds, min_length_m, "horiz", "distance", owner, chunks).select(
        *owner, F.lit("ate_run").alias("kind"), F.lit("se2").alias("space"), "stamp_start", "stamp_end",
        "distance_start", "distance_end", "threshold_m",
    )
    worst = sections.worst_segments(segments, top_k, 100.0, [*owner, "space"]).join(thresholds, owner).select(
        *owner, F.lit("kitti_100m").alias("kind"), "space", "stamp_start", "stamp_end", "distance_start",
        "distance_end", "threshold_m", F.col("length_m").alias("kitti_length_m"),
        F.col("translation_percent").alias("kitti_translation_percent"),
        F.col("rotation_deg_per_100m").alias("kitti_rotation_deg_per_100m"),
    )
    found = runs.unionByName(worst, allowMissingColumns=True).withColumn(
        "section_id",
        F.concat_ws(":", "kind", "estimator", "space", F.format_string("%.6f", "stamp_start"), F.format_string("%.6f", "stamp_end")),
    )
    summary = sections.section_summary(found, errors, keys, bucket_s)
    of_filter = errors.filter(F.col("estimator") == FILTER)
    stats = sections.filter_stats(found, signals, of_filter, keys, bucket_s, chunks)
    sid = [*keys, "section_id"]
    out = found.join(summary, sid, "left").join(stats, sid, "left")
    out = out.withColumn(
        "tag",
        sections.classify_error_source(
            F.col("odom_horiz_mean_m"), F.col("ekf_horiz_mean_m"), F.col("residual_xy_mean_m"), F.col("threshold_m")
        ),
    )
    return out.select(
        *keys, "kind", "estimator", "space", "tag", (F.col("stamp_start") - origin).alias("stamp_bag_start"),
        (F.col("stamp_end") - origin).alias("stamp_bag_end"), F.col("stamp_start").alias("stamp_gps_start"),
        F.col("stamp_end").alias("stamp_gps_end"), F.col("distance_start").alias("distance_start_m"),
        F.col("distance_end").alias("distance_end_m"), "horiz_rmse_m", "horiz_max_m", "vert_rmse_m", "yaw_rmse_deg",
        "odom_horiz_mean_m", "ekf_horiz_mean_m", "residual_xy_mean_m", "filter_yaw_rmse_deg",
        "gyro_bias_delta", "accel_bias_delta", "odom_age_p95_s", "speed_mean_mps", "kitti_length_m",
        "kitti_translation_percent", "kitti_rotation_deg_per_100m", "threshold_m",
    )


def report_top(runs: DataFrame, by: str, n: int, keys: Sequence[str] = DRIVE) -> DataFrame:
    """The `n` worst rows per key, worst first, as report rows with their rank.

    Rows that tie on value and start are ranked by their other columns, none is lost. Spark cuts every key to `n` rows
    before the shuffle, so a hot key costs `n` rows per task.
    """
    cols = [c for c in runs.columns if c not in keys]
    order = Window.partitionBy(*keys).orderBy(F.desc_nulls_last(by), "stamp_start", *[c for c in cols if c not in (by, "stamp_start")])
    return runs.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n).select(*keys, "rank", *cols)
