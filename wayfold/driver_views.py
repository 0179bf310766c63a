"""Trajectories, IMU samples, match logs and point clouds derived from the benchmark tables.

The benchmark tables have no vehicle data, so the registered queries first derive it with Spark from `events`
and `lineitem`. Every row of the source table is used; the amount of derived data grows with the tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import rigid
from .operators.ordered import CHUNK, Chunks, running
from .session import stored

KEYS = ("drive",)


def events(spark: SparkSession, sf: str) -> DataFrame:
    """One row per event with its drive (8 vehicles) and its time in seconds."""
    micros = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")
    return spark.read.parquet(f"{sf}/events.parquet").select(
        (F.col("user_id") % 8).alias("drive"), F.col("event_id").alias("idx"), (micros / F.lit(1e6)).alias("t"),
        "event_type", "value",
    )


def time_chunks(spark: SparkSession, sf: str, scale: float = 1.0) -> Chunks:
    """Chunk plan of the event times; read off the raw table so that it costs one pruned scan."""
    return Chunks.plan(events(spark, sf).select("drive", (F.col("t") / scale).alias("t")), KEYS, "t")


def _attitude(roll: Column, pitch: Column, yaw: Column) -> list[Column]:
    q = rigid.quat_from_rpy(roll, pitch, yaw)
    return [c.alias(n) for n, c in zip(("qw", "qx", "qy", "qz"), q, strict=True)]


def raw_route(spark: SparkSession, sf: str, chunks: Chunks) -> DataFrame:
    """Integrated route with roll, pitch and yaw as columns."""
    ev = events(spark, sf).select(
        "drive", "idx", F.col("t").alias("stamp"), "event_type", "value",
        (1.0 + (F.col("idx") % 7) * 0.5 + 0.1 * F.sin("idx")).alias("step"),
        (((F.col("idx") * 37) % 21 - 10) * 0.01).alias("dyaw"),
        (((F.col("idx") * 13) % 5 - 2) * 0.02).alias("dz"),
        (0.02 * F.sin(F.col("idx") * 0.7)).alias("roll"), (0.03 * F.cos(F.col("idx") * 0.3)).alias("pitch"),
    )
    order = ("stamp", "idx")
    y = running(chunks.labelled(ev, KEYS, "stamp"), KEYS, order, {"yaw": ("sum", F.col("dyaw")), "z": ("sum", F.col("dz"))}, chunks)
    route = running(
        y, KEYS, order,
        {"x": ("sum", F.col("step") * F.cos("yaw")), "y": ("sum", F.col("step") * F.sin("yaw"))}, chunks,
    )
    # Chunked operators look at their input twice; nested ones would derive the route anew each time.
    return route if chunks.whole else stored(route.drop(CHUNK))


def gt(spark: SparkSession, sf: str, chunks: Chunks) -> DataFrame:
    r = raw_route(spark, sf, chunks)
    return r.select("drive", "idx", "stamp", "x", "y", "z", *_attitude(F.col("roll"), F.col("pitch"), F.col("yaw")))


def est(spark: SparkSession, sf: str, chunks: Chunks) -> DataFrame:
    """Estimate of the same route: jittered stamps, scaled and shifted position, small attitude errors."""
    r = raw_route(spark, sf, chunks)
    return r.select(
        "drive", "idx", (F.col("stamp") + ((F.col("idx") * 11) % 13 - 6) * 10.0).alias("stamp"),
        (1.01 * F.col("x") + 3.0).alias("x"), (0.995 * F.col("y") - 2.0).alias("y"), (F.col("z") + 0.1).alias("z"),
        *_attitude(F.col("roll") + 0.003, F.col("pitch") - 0.002, F.col("yaw") + 0.02 + 0.01 * F.sin("idx")),
    )


def planar_pair(spark: SparkSession, sf: str, chunks: Chunks) -> tuple[DataFrame, DataFrame]:
    """(truth, estimate) of the same routes without roll and pitch."""
    r = raw_route(spark, sf, chunks)
    zero = F.lit(0.0)
    truth = r.select("drive", "idx", "stamp", "x", "y", "z", *_attitude(zero, zero, F.col("yaw")))
    guess = r.select(
        "drive", "idx", (F.col("stamp") + ((F.col("idx") * 11) % 13 - 6) * 10.0).alias("stamp"),
        (1.01 * F.col("x") + 3.0).alias("x"), (0.995 * F.col("y") - 2.0).alias("y"), (F.col("z") + 0.1).alias("z"),
        *_attitude(zero, zero, F.col("yaw") + 0.02 + 0.01 * F.sin("idx")),
    )
    return truth, guess


IMU_TIME_SCALE = 36000.0


def imu(spark: SparkSession, sf: str) -> DataFrame:
    """Samples at about 20 Hz: event times divided by a constant."""
    i = F.col("idx")
    return events(spark, sf).select(
        "drive", "idx", (F.col("t") / IMU_TIME_SCALE).alias("stamp"), (0.1 * F.sin(i)).alias("ax"),
        (0.1 * F.cos(i)).alias("ay"), (-9.81 + 0.05 * F.sin(i * 3)).alias("az"),
        (0.001 * F.cos(i * 2)).alias("wx"), (0.001 * F.sin(i * 5)).alias("wy"), (0.01 * (i % 7)).alias("wz"),
    )


def twist(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("idx")
    return events(spark, sf).select(
        "drive", "idx", (F.col("t") / IMU_TIME_SCALE).alias("stamp"), (5.0 + F.sin(i)).alias("vx"),
        (0.2 * F.cos(i)).alias("vy"), (0.05 * F.sin(i * 2)).alias("vz"), F.lit(0.0).alias("wx"), F.lit(0.0).alias("wy"),
        (0.05 * (i % 7 - 3)).alias("wz"),
        F.when(F.col("event_type") == "view", "base_link").when(F.col("event_type") == "click", "").otherwise("odom").alias("frame_id"),
    )


# Event types as match events: fixed mapping of the benchmark columns.
MATCH_EVENTS = {
    "click": "Accepted", "view": "Saturated", "signup": "Rejected", "purchase": "TimedOut", "error": "KinematicViolation",
}


def match_log(spark: SparkSession, sf: str) -> DataFrame:
    i, v = F.col("idx"), F.col("value")
    event = F.lit(None)
    for source, name in MATCH_EVENTS.items():
        event = F.when(F.col("event_type") == source, name).otherwise(event)
    return events(spark, sf).select(
        "drive", "idx", F.col("t").alias("stamp"), event.alias("event"), "value",
        ((i * 7) % 21).cast("int").alias("iterations"), ((i * 3) % 11 * 0.01).alias("last_step"),
        ((i * 5) % 40 * 0.06 + 0.01).alias("translation_m"), ((i * 17) % 29 * 0.009 + 0.001).alias("rotation_rad"),
        F.when(i % 10 == 3, F.lit(None)).otherwise(v / 10.0).cast("double").alias("ndt_cost"),
        F.when(i % 10 == 3, F.lit(None)).otherwise((i * 19) % 23 / 22.0).cast("double").alias("ndt_inliers"),
        ((i * 29) % 31 / 31.0).alias("inlier_ratio"),
        F.when(i % 97 == 5, F.lit(None)).otherwise(v / 100.0).cast("double").alias("cost"),
        (F.col("event_type") == "purchase").alias("timed_out"), (F.col("event_type") == "view").alias("saturated"),
        F.col("event_type").isin("click", "view").alias("applied"), (i % 50 == 0).alias("first"),
        (i % 3 == 0).alias("recovering"), (v / 11.0).alias("seed_ndt_cost"), (F.col("event_type") == "error").alias("skipped"),
        (v * 0.1).alias("deskew_ms"), (v * 0.2 + 1.0).alias("voxel_ms"), (v * 0.5 + i % 9).alias("align_ms"),
        (v * 0.05).alias("cost_ms"), (i % 13 * 0.5).alias("refine_ms"), (v * 0.3 + i % 4).alias("map_ms"),
    )


def points(spark: SparkSession, sf: str) -> DataFrame:
    """One return per line item: 32 scans of 4 vehicles. `idx` packs a unique key, so it is a stable input order."""
    li = spark.read.parquet(f"{sf}/lineitem.parquet")
    cents = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    x0 = F.col("l_extendedprice") / 1e3 - 50.0
    y0 = F.col("l_quantity") - 25.0 + (F.col("l_partkey") % 10) * 0.1
    return li.select(
        (F.col("l_orderkey") % 4).alias("drive"), (F.col("l_orderkey") % 32).alias("scan_id"),
        (F.shiftleft(F.col("l_orderkey") * 8 + F.col("l_linenumber"), 27) + cents).alias("idx"),
        (F.col("l_linenumber") * 0.01).alias("t"), (x0 * F.cos(F.lit(0.3)) - y0 * F.sin(F.lit(0.3))).alias("x"),
        (x0 * F.sin(F.lit(0.3)) + y0 * F.cos(F.lit(0.3))).alias("y"),
        (F.col("l_tax") * 1e1 - 0.5 + (F.col("l_suppkey") % 10) * 0.01 + 0.003 * F.sin("l_orderkey")).alias("z"),
        (F.col("l_discount") * 1e3).alias("intensity"),
    )


def scan_poses(spark: SparkSession, sf: str) -> DataFrame:
    """One planar pose per scan of `points`, from the line items of the scan."""
    li = spark.read.parquet(f"{sf}/lineitem.parquet")
    s = li.groupBy((F.col("l_orderkey") % 4).alias("drive"), (F.col("l_orderkey") % 32).alias("scan_id")).agg(
        (F.count(F.lit(1)) % 7 * 0.1).alias("_n"), F.max("l_linenumber").alias("_m")
    )
    yaw = F.col("scan_id") * 0.02
    zero = F.lit(0.0)
    return s.select(
        "drive", "scan_id", F.col("scan_id").alias("idx"), (F.col("scan_id") * 1.0).alias("stamp"),
        (F.col("scan_id") * 1.5 + F.col("_n")).alias("x"), (F.col("scan_id") * 0.25).alias("y"),
        (F.col("scan_id") * 0.01).alias("z"), *_attitude(zero, zero, yaw), (F.col("scan_id") % 3).alias("collective_passes"),
    )
