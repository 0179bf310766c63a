"""Readers and writers: the derived data is written in the recorded formats by Spark and read back."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from wayfold import driver_views as V
from wayfold.formats import ODOM
from wayfold.functions import rigid
from wayfold.session import ensure_checkpoint_dir
from wayfold.sources import clouds, sinks, trajectories

from .registry import GT, query, r, rounded, rs


def scratch(spark, name: str) -> str:
    """A fresh folder below the shared checkpoint folder."""
    return os.path.join(ensure_checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex}")


def written(spark, rows, name: str) -> str:
    path = scratch(spark, name)
    sinks.write_table(rows, path, "csv", ("drive",))
    return path


@query(
    "read_lidar_poses",
    f"WITH {GT} SELECT drive, CAST(round(stamp * 1e6) AS BIGINT) AS stamp_us, {rs('x', 'y', 'z', digits=3)}, {r('sin(-yaw - pi() / 4)', 'yaw_sin', 3)}, {r('cos(-yaw - pi() / 4)', 'yaw_cos', 3)}, {r('sin(yaw)', 'heading_sin', 3)} FROM gt",
)
def read_lidar_poses(spark, sf):
    """Ground truth as its CSV (even drives in microseconds, odd ones in seconds), read back."""
    raw = V.raw_route(spark, sf, V.time_chunks(spark, sf))
    zero = F.lit(0.0)
    rows = raw.select(
        "drive", F.when(F.col("drive") % 2 == 0, F.round(F.col("stamp") * 1e6)).otherwise(F.col("stamp")).alias("GPSTime"),
        F.col("x").alias("easting"), F.col("y").alias("northing"), F.col("z").alias("altitude"),
        *[zero.alias(n) for n in ("vel_east", "vel_north", "vel_up", "roll", "pitch")], F.col("yaw").alias("heading"),
        *[zero.alias(n) for n in ("angvel_z", "angvel_y", "angvel_x")],
    )
    back = trajectories.read_lidar_poses(spark, written(spark, rows, "lidar_poses"))
    yaw = rigid.yaw_of(rigid.Quat(*[F.col(f"q{n}") for n in "wxyz"]))
    out = back.select(
        F.col("drive").cast("bigint").alias("drive"), F.round(F.col("stamp") * 1e6).cast("bigint").alias("stamp_us"), "x", "y", "z", F.sin(yaw).alias("yaw_sin"), F.cos(yaw).alias("yaw_cos"),
        F.sin("heading").alias("heading_sin"),
    )
    return rounded(out, 3)


@query(
    "read_odometry_csv",
    f"WITH {GT} SELECT drive, CAST(round(stamp * 1e6) AS BIGINT) AS stamp_us, {rs('x', 'y', digits=3)}, {r('sin(yaw)', 'yaw_sin', 3)} FROM gt",
)
def read_odometry_csv(spark, sf):
    g, _ = V.planar_pair(spark, sf, V.time_chunks(spark, sf))
    rows = g.select("drive", "stamp", "x", "y", "z", "qx", "qy", "qz", "qw")
    back = trajectories.read_odometry_csv(spark, written(spark, rows, "odometry"))
    return rounded(back.select(F.col("drive").cast("bigint").alias("drive"), F.round(F.col("stamp") * 1e6).cast("bigint").alias("stamp_us"), "x", "y", F.sin("yaw").alias("yaw_sin")), 3)


_TRACE = GT + """,
tr AS (SELECT drive, idx, stamp, CASE WHEN idx % 13 = 1 THEN NULL ELSE x END AS ekf_x, y, z, yaw, CASE WHEN idx % 17 = 2 THEN NULL ELSE x + 1 END AS ox,
  CAST(floor(idx / 24) AS BIGINT) AS applied, 0.25e0 + (idx % 5) * 0.01e0 AS age FROM gt)"""


def _trace(spark, sf):
    """The filter trace CSV of the derived routes; several rows share one applied pose."""
    raw = V.raw_route(spark, sf, V.time_chunks(spark, sf))
    i, nan, zero = F.col("idx"), F.lit(float("nan")), F.lit(0.0)
    ekf_x = F.when(i % 13 == 1, nan).otherwise(F.col("x"))
    odom_x = F.when(i % 17 == 2, nan).otherwise(F.col("x") + 1.0)
    cols = {"stamp": F.col("stamp"), "ekf_x": ekf_x, "ekf_y": F.col("y"), "ekf_z": F.col("z"), "ekf_roll": zero, "ekf_pitch": zero, "ekf_yaw": F.col("yaw")}
    cols |= {f"ekf_v{a}": zero for a in "xyz"} | {f"ekf_body_v{a}": F.col("step") for a in "xyz"}
    cols |= {f"{k}_{a}": 0.001 * (i % 9) for k in ("bg", "ba") for a in "xyz"} | {f"imu_{k}{a}": zero for k in "aw" for a in "xyz"}
    cols |= {f"{ODOM}_x": odom_x, f"{ODOM}_y": F.col("y"), f"{ODOM}_z": F.col("z"), f"{ODOM}_roll": zero, f"{ODOM}_pitch": zero, f"{ODOM}_yaw": F.col("yaw")}
    cols |= {f"{ODOM}_age": 0.25 + (i % 5) * 0.01} | {f"err_{a}": 0.1 * F.sin(i) for a in ("x", "y", "z", "yaw")}
    cols |= {"pose_applied": F.floor(i / 24.0).cast("double"), "pose_dropped_late": zero, "pose_dropped_no_buffer": zero}
    rows = raw.select("drive", *[c.alias(n) for n, c in cols.items()]).repartition("drive").sortWithinPartitions("drive", "stamp")
    return trajectories.read_filter_trace(spark, written(spark, rows, "trace"))


@query("trace_filter_poses", f"WITH {_TRACE} SELECT drive, {r('stamp', 'stamp', 3)}, {r('ekf_x', 'x', 3)}, {r('sin(yaw)', 'yaw_sin', 3)}, {r('0.001e0 * (idx % 9)', 'bg_x')} FROM tr WHERE ekf_x IS NOT NULL")
def trace_filter_poses(spark, sf):
    poses, signals, _ = _trace(spark, sf)
    both = poses.join(signals.select("drive", "idx", "bg_x"), ["drive", "idx"])
    yaw = rigid.yaw_of(rigid.Quat(*[F.col(f"q{n}") for n in "wxyz"]))
    return rounded(both.select(F.col("drive").cast("bigint").alias("drive"), "stamp", "x", F.sin(yaw).alias("yaw_sin"), "bg_x"), 3, bg_x=4)


@query(
    "trace_odometry_poses",
    f"WITH {_TRACE} SELECT drive, applied AS pose_applied, {r('stamp - age', 'stamp', 3)}, {r('ox', 'x', 3)} FROM tr WHERE ox IS NOT NULL QUALIFY row_number() OVER (PARTITION BY drive, applied ORDER BY stamp) = 1",
)
def trace_odometry_poses(spark, sf):
    _, _, odom = _trace(spark, sf)
    return rounded(odom.select(F.col("drive").cast("bigint").alias("drive"), "pose_applied", "stamp", "x"), 3)


@query(
    "detect_time_origin",
    f"""WITH {GT}, s AS (SELECT drive, min(stamp) + 2 AS lidar0, (min(stamp) - drive) * 1e6 AS imu_raw, (min(stamp) + 0.5e0 - drive % 2) AS gnss0, min(stamp) - 9 AS cam0 FROM gt GROUP BY drive),
t AS (SELECT *, imu_raw * 1e-6 AS imu0, CASE drive % 3 WHEN 0 THEN lidar0 - least(lidar0, imu_raw * 1e-6, gnss0) WHEN 1 THEN lidar0 - cam0 ELSE 5e0 END AS trace0 FROM s),
o AS (SELECT *, least(lidar0, imu0, gnss0) AS base, least(lidar0, imu0, gnss0, cam0) AS wide FROM t)
SELECT drive, CASE WHEN abs(lidar0 - base - trace0) < 1e-3 THEN 'imu_gnss_lidar' WHEN abs(lidar0 - wide - trace0) < 1e-3 THEN 'with_camera' ELSE 'lidar_minus_trace' END AS rule,
 round(CASE WHEN abs(lidar0 - base - trace0) < 1e-3 THEN base WHEN abs(lidar0 - wide - trace0) < 1e-3 THEN wide ELSE lidar0 - trace0 END, 3) + 0e0 AS origin FROM o""",
)
def detect_time_origin(spark, sf):
    g = V.events(spark, sf).select("drive", F.col("t").alias("stamp"))
    t0 = g.groupBy("drive").agg(F.min("stamp").alias("t0"))
    d, s = F.col("drive"), F.col("stamp")
    lidar, imu = g.select("drive", (s + 2.0).alias("stamp")), g.select("drive", ((s - d) * 1e6).alias("stamp"))
    gnss, camera = g.select("drive", (s + 0.5 - d % 2).alias("stamp")), g.select("drive", (s - 9.0).alias("stamp"))
    base = F.least(F.col("t0") + 2.0, (F.col("t0") - d) * 1e6 * 1e-6, F.col("t0") + 0.5 - d % 2)
    first = F.when(d % 3 == 0, F.col("t0") + 2.0 - base).when(d % 3 == 1, F.lit(11.0)).otherwise(5.0)
    trace = g.join(t0, "drive").select("drive", (s - F.col("t0") + first).alias("stamp"))
    return rounded(trajectories.detect_time_origin(trace, lidar, imu, gnss, camera), 3)


@query("odometry_topics", f"WITH {GT} SELECT drive, topic, count(*) AS n, {r('sum(x)', 'x_sum', 2)} FROM (SELECT drive, x, CASE idx % 3 WHEN 0 THEN '/a/odom' WHEN 1 THEN '/b/odom' ELSE '/c' END AS topic FROM gt) WHERE topic IN ('/a/odom', '/c', '/none') GROUP BY drive, topic")
def odometry_topics(spark, sf):
    found, _ = trajectories.odometry_topics(_topics(spark, sf), ["/a/odom", "/c", "/none"])
    return rounded(found.groupBy("drive", "topic").agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("x_sum")), 2)


def _topics(spark, sf):
    g = V.gt(spark, sf, V.time_chunks(spark, sf))
    i = F.col("idx")
    return g.withColumn("topic", F.when(i % 3 == 0, "/a/odom").when(i % 3 == 1, "/b/odom").otherwise("/c"))


@query("missing_topics", f"WITH {GT}, t AS (SELECT DISTINCT CASE idx % 3 WHEN 0 THEN '/a/odom' WHEN 1 THEN '/b/odom' ELSE '/c' END AS topic FROM gt) SELECT v.topic FROM (VALUES ('/a/odom'), ('/c'), ('/none')) v(topic) ANTI JOIN t ON t.topic = v.topic")
def missing_topics(spark, sf):
    return trajectories.odometry_topics(_topics(spark, sf), ["/a/odom", "/c", "/none"])[1]


@query("odometry_dump", f"WITH {GT} SELECT CASE idx % 3 WHEN 0 THEN 'a_odom' WHEN 1 THEN 'b_odom' ELSE 'c' END AS topic, count(*) AS n, {r('sum(x)', 'x_sum', 2)} FROM gt GROUP BY ALL")
def odometry_dump(spark, sf):
    """Written as one CSV folder per topic and read back from the folders."""
    path = scratch(spark, "dump")
    sinks.write_odometry(_topics(spark, sf), path)
    back = spark.read.csv(path, header=True, schema="stamp double, x double, y double, z double, qx double, qy double, qz double, qw double, topic string")
    return rounded(back.groupBy("topic").agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("x_sum")), 2)


def _framed(spark, sf):
    i = F.col("idx")
    return V.points(spark, sf).withColumn("frame_id", F.when(i % 7 == 0, F.lit(None)).when(i % 7 == 1, "").when(i % 7 == 2, "unknown").when(i % 7 < 5, "left").otherwise("right"))


def _extrinsics(spark, sf):
    drives = V.points(spark, sf).select("drive").distinct()
    frame = F.explode(F.array(F.lit("left"), F.lit("right"))).alias("frame_id")
    t = drives.select("drive", frame).withColumn("s", F.when(F.col("frame_id") == "left", 1.0).otherwise(-1.0))
    return t.select("drive", "frame_id", F.lit(0.5).alias("x"), F.col("s").alias("y"), F.lit(2.0).alias("z"), *[c.alias(n) for c, n in zip(rigid.yaw_quat(F.col("s") * 0.4), ("qw", "qx", "qy", "qz"), strict=True)])


POINTS = """pts AS (SELECT l_orderkey % 4 AS drive, l_orderkey % 32 AS scan_id, ((l_orderkey * 8 + l_linenumber) << 27) + CAST(round(l_extendedprice * 100) AS BIGINT) AS idx,
  l_linenumber * 0.01e0 AS t, x0*cos(0.3e0) - y0*sin(0.3e0) AS x, x0*sin(0.3e0) + y0*cos(0.3e0) AS y, z, intensity FROM (
  SELECT *, l_extendedprice / 1e3 - 50e0 AS x0, l_quantity - 25e0 + (l_partkey % 10) * 0.1e0 AS y0, l_tax * 1e1 - 0.5e0 + (l_suppkey % 10) * 0.01e0 + 0.003e0 * sin(l_orderkey) AS z, l_discount * 1e3 AS intensity FROM lineitem))"""


@query(
    "attach_extrinsic",
    f"WITH {POINTS}, f AS (SELECT *, CASE WHEN idx % 7 = 3 OR idx % 7 = 4 THEN 1e0 WHEN idx % 7 >= 5 THEN -1e0 END AS s FROM pts) "
    f"SELECT drive, idx, {r('cos(s*0.4e0)*x - sin(s*0.4e0)*y + 0.5e0', 'x', 3)}, {r('sin(s*0.4e0)*x + cos(s*0.4e0)*y + s', 'y', 3)}, {r('z + 2', 'z', 3)} FROM f WHERE s IS NOT NULL",
)
def attach_extrinsic(spark, sf):
    joined, _ = clouds.attach_extrinsic(_framed(spark, sf), _extrinsics(spark, sf))
    w = rigid.pose("ext.").apply(rigid.vec())
    return rounded(joined.select("drive", "idx", *[c.alias(a) for a, c in zip("xyz", w, strict=True)]), 3)


@query("attach_extrinsic_dropped", f"WITH {POINTS} SELECT drive, count(*) FILTER (idx % 7 < 3) AS dropped, count(*) AS total FROM pts GROUP BY drive")
def attach_extrinsic_dropped(spark, sf):
    return clouds.attach_extrinsic(_framed(spark, sf), _extrinsics(spark, sf))[1]


def packed_clouds(spark, sf):
    """Points packed into binary messages of one order range each; the layout differs between messages."""
    import numpy as np
    import pandas as pd

    from wayfold.schemas import CLOUDS

    rows = V.points(spark, sf).withColumn("_cloud", F.shiftright("idx", 27 + 3 + 9))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        cloud = int(pdf["_cloud"].iloc[0])
        big, wide = cloud % 2 == 1, cloud % 3 == 0
        order = ">" if big else "<"
        kind = order + "f8"
        layout = [("x", kind, 8), ("y", kind, 8), ("z", kind, 8), ("stamp" if wide else "t", kind, 8)]
        layout.append(("intensity", order + "u2", 4) if wide else ("reflectivity", order + "f4", 7))
        dtype = np.dtype([(n, d) for n, d, _ in layout])
        out = np.zeros(len(pdf), dtype)
        pdf = pdf.sort_values("idx")
        for (name, _, _), source in zip(layout, ("x", "y", "z", "t", "intensity"), strict=True):
            out[name] = pdf[source].to_numpy()
        fields = [{"name": "timestamp" if n == "stamp" else n, "offset": dtype.fields[n][1], "datatype": code, "count": 1} for n, _, code in layout]
        return pd.DataFrame(
            [{"drive": str(pdf["drive"].iloc[0]), "scan_id": cloud, "stamp": 100.0 + cloud, "is_bigendian": big, "point_step": dtype.itemsize, "fields": fields, "data": out.tobytes()}]
        )

    return rows.groupBy("drive", "_cloud").applyInPandas(pack, CLOUDS)


@query(
    "explode_clouds",
    f"WITH {POINTS}, c AS (SELECT *, idx >> 39 AS cloud FROM pts), n AS (SELECT *, row_number() OVER (PARTITION BY drive, cloud ORDER BY idx) - 1 AS i FROM c) "
    f"SELECT drive, cloud AS scan_id, i AS idx, {rs('x', 'y', 'z', digits=3)}, {r('t + 100 + cloud', 't', 3)}, {r('CASE WHEN cloud % 3 = 0 THEN trunc(intensity) ELSE intensity END', 'intensity', 1)} "
    "FROM n WHERE x*x + y*y + z*z >= 25e0 AND x*x + y*y + z*z <= 1600e0",
)
def explode_clouds(spark, sf):
    out = clouds.explode_clouds(packed_clouds(spark, sf), None, 5.0, 40.0)
    return rounded(out.withColumns({"drive": F.col("drive").cast("bigint")}), 3, intensity=1)


