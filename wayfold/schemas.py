"""Explicit schemas of the tables the operators take and return. Time is seconds in DOUBLE; null = missing."""

from __future__ import annotations

from pyspark.sql import types as T

from .formats import ODOM

_TYPES = {
    "string": T.StringType(), "bigint": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(),
    "float": T.FloatType(), "boolean": T.BooleanType(), "binary": T.BinaryType(),
}


def columns(text: str) -> T.StructType:
    """A flat schema from `name type, name type`; unlike a DDL string it needs no running session."""
    return T.StructType([T.StructField(n, _TYPES[t]) for n, t in (part.split() for part in text.split(","))])


_d = columns

POSES2 = _d("drive string, stamp double, x double, y double, yaw double")
POSES = _d(
    "drive string, idx bigint, stamp double, x double, y double, z double, "
    "qw double, qx double, qy double, qz double"
)
IMU = _d("drive string, idx bigint, stamp double, ax double, ay double, az double, wx double, wy double, wz double")
TWIST = _d("drive string, idx bigint, stamp double, vx double, vy double, vz double, wx double, wy double, wz double")
POINTS = _d("drive string, scan_id bigint, idx bigint, t double, x double, y double, z double, intensity float")
CLOUD_FIELD = _d("name string, offset int, datatype int, count int")
CLOUDS = T.StructType(
    [
        *_d("drive string, scan_id bigint, stamp double, is_bigendian boolean, point_step int").fields,
        T.StructField("fields", T.ArrayType(CLOUD_FIELD)),
        T.StructField("data", T.BinaryType()),
    ]
)
LIDAR_POSES_CSV = _d(
    "GPSTime double, easting double, northing double, altitude double, vel_east double, vel_north double, "
    "vel_up double, roll double, pitch double, heading double, angvel_z double, angvel_y double, angvel_x double"
)
ODOMETRY_CSV = _d(
    "stamp double, x double, y double, z double, qx double, qy double, qz double, qw double"
)
TRACE_CSV = _d(
    "stamp double, ekf_x double, ekf_y double, ekf_z double, ekf_roll double, ekf_pitch double, ekf_yaw double, "
    "ekf_vx double, ekf_vy double, ekf_vz double, ekf_body_vx double, ekf_body_vy double, ekf_body_vz double, "
    "bg_x double, bg_y double, bg_z double, ba_x double, ba_y double, ba_z double, "
    "imu_ax double, imu_ay double, imu_az double, imu_wx double, imu_wy double, imu_wz double, "
    + ", ".join(f"{ODOM}_{n} double" for n in ("x", "y", "z", "roll", "pitch", "yaw", "age"))
    + ", "
    "err_x double, err_y double, err_z double, err_yaw double, "
    "pose_applied double, pose_dropped_late double, pose_dropped_no_buffer double"
)

# Message tables (batch and streaming sinks).
BODY_FRAME_ERROR = _d("drive string, stamp double, longitudinal_m double, lateral_m double, vertical_m double")
KITTI_ERROR = _d(
    "drive string, stamp double, translation_percent double, rotation_deg_per_100m double, num_segments bigint"
)
SCAN_STAGES = _d(
    "drive string, stamp double, deskew_ms double, voxel_ms double, align_ms double, cost_ms double, "
    "refine_ms double, map_ms double, timed_out boolean, skipped boolean, applied boolean, skipped_total bigint"
)
ICP_DEBUG = _d(
    "drive string, stamp double, status string, cost double, ndt_cost double, inlier_ratio double, "
    "iterations double, partial boolean, translation_m double, rotation_rad double, health string, "
    "inserted boolean, total_ms double, deskew_ms double, voxel_ms double, align_ms double"
)
POSE_REFINE = _d("drive string, stamp double, scans int, settled int, largest_shift_m double")
