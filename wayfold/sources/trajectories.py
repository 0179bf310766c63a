"""Readers of recorded trajectories and traces. Every schema is explicit; missing numbers become null."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..formats import ODOM
from ..functions import rigid

# Static yaw of the lidar in the vehicle frame.
LIDAR_TO_BASE_YAW = math.pi / 4.0
MICROSECOND_STAMPS = 1.0e12


def _csv(spark: SparkSession, path: str | Sequence[str], schema, drive: Column | None) -> DataFrame:
    rows = spark.read.csv(
        path if isinstance(path, str) else list(path), schema=schema, header=True, nanValue="nan", enforceSchema=True
    )
    numbers = [f.name for f in schema.fields if f.dataType.typeName() == "double"]
    rows = rows.withColumns({n: F.when(~F.isnan(n), F.col(n)) for n in numbers})
    order = F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    named = F.regexp_extract(F.col("_metadata.file_path"), r"drive=([^/]+)", 1) if drive is None else drive
    return rows.withColumns({"idx": F.monotonically_increasing_id(), "_order": order, "drive": named})


def seconds(raw: Column) -> Column:
    """A single stamp that may be microseconds."""
    return F.when(raw > MICROSECOND_STAMPS, raw * 1.0e-6).otherwise(raw)


def ros_seconds(sec: Column, nanosec: Column) -> Column:
    return sec.cast("double") + nanosec.cast("double") * 1.0e-9


def scale_stamps(rows: DataFrame, stamp: str, keys: Sequence[str] = ("drive",)) -> DataFrame:
    """Microseconds to seconds for the keys whose median stamp is above 1e12.

    The median itself is not needed: counts and the two values around the threshold decide.
    """
    big = F.col(stamp) > MICROSECOND_STAMPS
    side = rows.groupBy(*keys).agg(
        F.count(stamp).alias("_n"), F.count_if(big).alias("_big"),
        F.max(F.when(~big, F.col(stamp))).alias("_lo"), F.min(F.when(big, F.col(stamp))).alias("_hi"),
    )
    half = F.col("_big") * 2
    micro = (half > F.col("_n")) | (
        (half == F.col("_n")) & ((F.col("_lo") + F.col("_hi")) * 0.5 > MICROSECOND_STAMPS)
    )
    side = side.select(*keys, F.coalesce(micro, F.lit(False)).alias("_micro"))
    return rows.join(side, list(keys)).withColumn(
        stamp, F.when(F.col("_micro"), F.col(stamp) * 1.0e-6).otherwise(F.col(stamp))
    ).drop("_micro")


def lidar_poses(rows: DataFrame, mount_yaw: float = LIDAR_TO_BASE_YAW, keys: Sequence[str] = ("drive",)) -> DataFrame:
    """Ground-truth rows (`GPSTime, easting, ..., heading`) to base poses, with the raw heading as `heading`."""
    rows = scale_stamps(rows, "GPSTime", keys)
    q = rigid.frd_attitude(F.col("heading"), F.col("pitch"), F.col("roll")).mul(
        rigid.yaw_quat(F.lit(-float(mount_yaw)))
    )
    return rows.select(
        *keys, "idx", F.col("GPSTime").alias("stamp"), F.col("easting").alias("x"), F.col("northing").alias("y"),
        F.col("altitude").alias("z"), *[c.alias(n) for c, n in zip(q, ("qw", "qx", "qy", "qz"), strict=True)], "heading",
    )


def read_lidar_poses(
    spark: SparkSession, path: str | Sequence[str], mount_yaw: float = LIDAR_TO_BASE_YAW, drive: Column | None = None
) -> DataFrame:
    return lidar_poses(_csv(spark, path, schemas.LIDAR_POSES_CSV, drive), mount_yaw)


def read_odometry_csv(spark: SparkSession, path: str | Sequence[str], drive: Column | None = None) -> DataFrame:
    """`stamp,x,y,z,qx,qy,qz,qw` to poses with their yaw."""
    rows = _csv(spark, path, schemas.ODOMETRY_CSV, drive)
    yaw = rigid.yaw_of(rigid.Quat(F.col("qw"), F.col("qx"), F.col("qy"), F.col("qz")))
    return rows.select("drive", "idx", "stamp", *rigid.POSE_FIELDS, yaw.alias("yaw"))


def finite(*names: str) -> Column:
    out = F.lit(True)
    for n in names:
        out = out & F.coalesce(F.abs(F.col(n)) < float("inf"), F.lit(False))
    return out


def filter_trace(rows: DataFrame, keys: Sequence[str] = ("drive",)) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Trace rows to (filter poses, filter signals, odometry poses).

    The odometry keeps one pose per rounded `pose_applied`, the first written, stamped at the pose time.
    """
    keys = list(keys)
    ekf = rows.filter(finite("stamp", "ekf_x", "ekf_y", "ekf_z"))
    q = rigid.quat_from_rpy(F.col("ekf_roll"), F.col("ekf_pitch"), F.col("ekf_yaw"))
    names = ("qw", "qx", "qy", "qz")
    poses = ekf.select(
        *keys, "idx", "stamp", F.col("ekf_x").alias("x"), F.col("ekf_y").alias("y"), F.col("ekf_z").alias("z"),
        *[c.alias(n) for c, n in zip(q, names, strict=True)],
    )
    signals = ekf.select(
        *keys, "idx", "stamp", "err_x", "err_y", "err_z", F.col("err_yaw"), "bg_x", "bg_y", "bg_z", "ba_x", "ba_y", "ba_z",
        "imu_ax", "imu_ay", "imu_az", "imu_wx", "imu_wy", "imu_wz",
        *[F.col(f"ekf_body_v{a}").alias(f"body_v{a}") for a in "xyz"], F.col(f"{ODOM}_age").alias("odom_age"), "pose_applied",
    )
    odom = rows.filter(finite("stamp", *[f"{ODOM}_{n}" for n in ("x", "y", "z", "age")], "pose_applied"))
    odom = odom.withColumn("_id", F.rint("pose_applied").cast("bigint"))
    taken = ["stamp", "idx", f"{ODOM}_age", *[f"{ODOM}_{n}" for n in ("x", "y", "z", "roll", "pitch", "yaw")]]
    # The trace is written in time order, so the first row of an id is its earliest one.
    first = odom.groupBy(*keys, "_id").agg(F.min_by(F.struct(*taken), F.struct("stamp", "_order")).alias("_o"))
    q = rigid.quat_from_rpy(*[F.col(f"_o.{ODOM}_{n}") for n in ("roll", "pitch", "yaw")])
    odometry = first.select(
        *keys, F.col("_o.idx").alias("idx"), (F.col("_o.stamp") - F.col(f"_o.{ODOM}_age")).alias("stamp"),
        *[F.col(f"_o.{ODOM}_{n}").alias(n) for n in "xyz"], *[c.alias(n) for c, n in zip(q, names, strict=True)],
        F.col("_id").alias("pose_applied"),
    )
    return poses, signals, odometry


def read_filter_trace(
    spark: SparkSession, path: str | Sequence[str], drive: Column | None = None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    return filter_trace(_csv(spark, path, schemas.TRACE_CSV, drive))


def detect_time_origin(
    trace: DataFrame, lidar: DataFrame, imu: DataFrame | None = None, gnss: DataFrame | None = None,
    camera: DataFrame | None = None, keys: Sequence[str] = ("drive",), stamp: str = "stamp",
) -> DataFrame:
    """`origin` of the recording and the `rule` that gave it, from the first stamps of the sensor tables."""
    def first(df: DataFrame, name: str, scaled: bool) -> DataFrame:
        low = F.min(stamp)
        return df.groupBy(*keys).agg((seconds(low) if scaled else low).alias(name))

    out = first(trace, "trace0", False).join(first(lidar, "lidar0", False), list(keys))
    for name, df in (("imu0", imu), ("gnss0", gnss), ("camera0", camera)):
        out = out.withColumn(name, F.lit(None).cast("double")) if df is None else out.join(
            first(df, name, True), list(keys), "left"
        )
    base = F.least("lidar0", "imu0", "gnss0")
    wide = F.least(base, F.col("camera0"))

    def fits(origin: Column) -> Column:
        return F.abs((F.col("lidar0") - origin) - F.col("trace0")) < 1.0e-3

    camera_fits = F.col("camera0").isNotNull() & fits(wide)
    return out.select(
        *keys,
        F.when(fits(base), base).when(camera_fits, wide).otherwise(F.col("lidar0") - F.col("trace0")).alias("origin"),
        F.when(fits(base), "imu_gnss_lidar").when(camera_fits, "with_camera").otherwise("lidar_minus_trace").alias("rule"),
    )


def shift_time(rows: DataFrame, origins: DataFrame, keys: Sequence[str] = ("drive",)) -> DataFrame:
    return rows.join(origins.select(*keys, "origin"), list(keys)).withColumn(
        "stamp", F.col("stamp") + F.col("origin")
    ).drop("origin")


def odometry_topics(rows: DataFrame, topics: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(poses of the requested topics, requested topics without any row)."""
    yaw = rigid.yaw_of(rigid.Quat(F.col("qw"), F.col("qx"), F.col("qy"), F.col("qz")))
    found = rows.filter(F.col("topic").isin(*topics)).withColumn("yaw", yaw)
    asked = rows.sparkSession.createDataFrame([(t,) for t in topics], schemas.columns("topic string"))
    missing = asked.join(found.select("topic").distinct(), "topic", "left_anti")
    return found, missing


def planar(poses: DataFrame) -> DataFrame:
    """Spatial rows as planar ones."""
    yaw = rigid.yaw_of(rigid.Quat(F.col("qw"), F.col("qx"), F.col("qy"), F.col("qz")))
    return poses.select(*[c for c in poses.columns if c not in rigid.POSE_FIELDS], "x", "y", yaw.alias("yaw"))


def body_velocity(rows: DataFrame) -> DataFrame:
    """World velocity `vx, vy, vz` in the body frame as `body_vx ...`."""
    local = rigid.Quat(F.col("qw"), F.col("qx"), F.col("qy"), F.col("qz")).conj().rotate(rigid.vec("v", ("x", "y", "z")))
    return rows.withColumns({f"body_v{a}": c for a, c in zip("xyz", local, strict=True)})


def with_covariance(rows: DataFrame, position: float, rotation: float, into: str = "covariance") -> DataFrame:
    """Row-major 6x6 diagonal covariance as an array of 36."""
    values = [position] * 3 + [rotation] * 3
    cells = [F.lit(float(values[i]) if i == k else 0.0) for i in range(6) for k in range(6)]
    return rows.withColumn(into, F.array(*cells))
