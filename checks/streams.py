"""The streaming operators on derived rows that arrive as files, drained and compared with the SQL of their batch twins."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold import driver_views as V
from wayfold.functions.rigid import POSE_FIELDS
from wayfold.session import ensure_checkpoint_dir
from wayfold.sources import streams as message_sinks
from wayfold.streaming import stateful

from .evaluation import BRACKET, GAP, _SCREW_OUT, kitti_sql, screw_sql, unique_pairs
from .logs import _DECIMATE, _HEALTH, _SKIP, LOG
from .registry import ERR2, FIRST2, UNIQUE, query, r, rounded, rs

#: Steps in which a table arrives (at least), files of each step, and most rows of one, as a micro-batch is held by Python workers.
STEPS, FILES, STEP_ROWS = 3, 4, 1_000_000
POSE = list(POSE_FIELDS)
#: Drive of the last row of a stream, which only moves the watermark.
CLOCK = -1


def _folder(spark: SparkSession) -> str:
    return f"{ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"


def replay(rows: DataFrame, by: str = "stamp", tick: bool = True) -> DataFrame:
    """`rows` as a file stream that arrives in steps of `by`, the more the more rows; after them, with `tick`, one row of the drive CLOCK
    far in the future."""
    spark, folder, files = rows.sparkSession, _folder(rows.sparkSession), _folder(rows.sparkSession)
    rows.write.parquet(folder)
    rows = spark.read.schema(rows.schema).parquet(folder)
    steps = max(STEPS, -(-rows.count() // STEP_ROWS))
    if steps > STEPS:  # sorted once, so that a step reads its own rows only
        ordered = _folder(spark)
        rows.repartitionByRange(steps, by).sortWithinPartitions(by).write.parquet(ordered)
        rows = spark.read.schema(rows.schema).parquet(ordered)
    edges = rows.agg(F.percentile_approx(by, [i / steps for i in range(1, steps)]).alias("e"), F.max("stamp").alias("last")).first()
    bounds = [None, *(edges["e"] or []), None]
    for low, high in zip(bounds, bounds[1:]):
        part = rows if low is None else rows.where(F.col(by) >= low)
        part = part if high is None else part.where(F.col(by) < high)
        part.repartition(FILES).write.mode("append").parquet(files)
    if tick and edges["last"] is not None:
        fixed = {"drive": F.lit(CLOCK), "stamp": F.lit(edges["last"] + 1e7), "kind": F.lit("tick")}
        empty = [fixed.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in rows.schema.fields]
        spark.range(1).select(*empty).write.mode("append").parquet(files)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", FILES).parquet(files)


def drained(stream: DataFrame) -> DataFrame:
    """All that a stream puts out for what has arrived."""
    spark, folder = stream.sparkSession, _folder(stream.sparkSession)
    writer = stream.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/state")
    writer.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows").where(F.col("drive") != CLOCK)


def _flat(pairs: DataFrame) -> DataFrame:
    """Pairs with the poses as columns."""
    return pairs.select("drive", "stamp", "idx", *[F.col(f"{s}.{c}").alias(f"{s}_{c}") for s in ("gt", "est") for c in POSE])


# --- waiting scans -------------------------------------------------------------------------------------

WAIT, PAIR_DT, HORIZON = 0.05, 0.02, 1.0


def arrivals(spark: SparkSession, sf: str) -> DataFrame:
    """IMU samples, with holes, and scans (one event in five) of all drives."""
    hole = (F.floor(F.col("stamp") / 4.0) % 5) == 2
    rows = V.imu(spark, sf).select("drive", "idx", "stamp")
    kinds = V.events(spark, sf).select("drive", "idx", F.when(F.col("event_type") == "purchase", "scan").otherwise("imu").alias("kind"))
    rows = rows.join(kinds, ["drive", "idx"]).where((F.col("kind") == "scan") | ~hole)
    return rows.select("drive", "idx", "kind", "stamp", (F.col("stamp") - 0.05 - (F.col("idx") % 4) * 0.3).alias("scan_start"))


@query(
    "stream_bounded_wait",
    f"""WITH ev AS (SELECT user_id % 8 AS drive, event_id AS idx, epoch_us(ts) / 1e6 / 36000e0 AS stamp, event_type FROM events),
im AS (SELECT drive, stamp FROM ev WHERE event_type <> 'purchase' AND CAST(floor(stamp / 4e0) AS BIGINT) % 5 <> 2),
sc AS (SELECT drive, idx, stamp, stamp - 0.05e0 - (idx % 4) * 0.3e0 AS scan_start, stamp - 1e-3 AS from_, stamp - 0.05e0 - (idx % 4) * 0.3e0 + {PAIR_DT}e0 AS upto FROM ev WHERE event_type = 'purchase'),
j AS (SELECT s.*, b.stamp AS cover, f.stamp AS back FROM sc s ASOF LEFT JOIN im b ON b.drive = s.drive AND s.from_ <= b.stamp
  ASOF LEFT JOIN im f ON f.drive = s.drive AND s.upto >= f.stamp)
SELECT drive, idx, CASE WHEN NOT coalesce(back >= stamp - {HORIZON}e0, false) THEN 'skipped' WHEN coalesce(cover <= stamp + {WAIT}e0, false) THEN 'ready' ELSE 'behind' END AS status FROM j""",
)
def stream_bounded_wait(spark, sf):
    out = stateful.bounded_wait(replay(arrivals(spark, sf)), WAIT, PAIR_DT, HORIZON, delay_s=0.5)
    return drained(out).select("drive", "idx", "status")


# --- pairs and running errors --------------------------------------------------------------------------


@query(
    "stream_pairs",
    f"WITH {BRACKET}, {screw_sql('b', f'WHERE (ns IS NOT NULL OR stamp - ls <= 1e-9) AND least(stamp - ls, ns - stamp) <= {GAP}')} "
    + _SCREW_OUT.replace("drive, idx,", f"drive, {r('stamp', 'stamp', 3)},"),
)
def stream_pairs(spark, sf):
    g, e = V.planar_pair(spark, sf, V.time_chunks(spark, sf))
    both = e.withColumn("kind", F.lit("est")).unionByName(g.withColumn("kind", F.lit("gt")))
    out = drained(stateful.sync_estimate_gt(replay(both), GAP, delay_s=60.0))
    yaw = 2.0 * F.atan2("est_qz", "est_qw")
    return rounded(out.select("drive", "stamp", F.col("est_x").alias("px"), F.col("est_y").alias("py"), F.col("est_z").alias("pz"), F.sin(yaw).alias("yaw_sin"), F.cos(yaw).alias("yaw_cos")), 3)


@query(
    "stream_kitti",
    f"WITH {kitti_sql('se3')} SELECT drive, {r('100*avg(translation/length_m)', 'translation_percent')}, "
    f"{r('degrees(avg(rotation/length_m))*100', 'rotation_deg_per_100m')}, count(*) AS num_segments FROM seg GROUP BY drive",
)
def stream_kitti(spark, sf):
    """The last running total of each drive."""
    _, p = unique_pairs(spark, sf)
    out = drained(stateful.kitti_of_pairs(replay(_flat(p)), 1.0))
    last = out.groupBy("drive").agg(F.max_by(F.struct("translation_percent", "rotation_deg_per_100m", "num_segments"), "num_segments").alias("l"))
    return rounded(last.select("drive", "l.*"))


@query(
    "stream_body_error",
    f"WITH {UNIQUE}, {FIRST2.replace('FROM pairs', 'FROM uniq')}, "
    f"{ERR2.replace('FROM pairs p', 'FROM uniq p')}, q AS (SELECT *, row_number() OVER w AS rn, dz - first_value(dz) OVER w AS up FROM errh WINDOW w AS (PARTITION BY drive ORDER BY stamp, idx)) "
    f"SELECT drive, {r('stamp', 'stamp', 3)}, {r('cos(gyaw)*dx + sin(gyaw)*dy', 'longitudinal_m', 3)}, {r('cos(gyaw)*dy - sin(gyaw)*dx', 'lateral_m', 3)}, {r('up', 'vertical_m', 3)} FROM q WHERE rn > 1",
)
def stream_body_error(spark, sf):
    _, p = unique_pairs(spark, sf, planar=True)
    return rounded(drained(stateful.body_error_of_pairs(replay(_flat(p)), 1.0)), 3)


# --- order, retention, selection -----------------------------------------------------------------------


@query(
    "stream_in_order",
    "SELECT user_id % 8 AS drive, floor(epoch_us(ts) / 1e6 / 600e0) AS stamp, max(event_id) AS idx FROM events GROUP BY ALL",
)
def stream_in_order(spark, sf):
    """Stamps of ten minutes: the last arrival of each; rows come half a day out of order."""
    rows = V.events(spark, sf).select("drive", "idx", F.floor(F.col("t") / 600.0).cast("double").alias("stamp"), ((F.col("idx") * 7919) % 72).alias("jitter"))
    mixed = rows.withColumn("arrival", F.col("stamp") + F.col("jitter"))
    stream = replay(mixed, "arrival").drop("jitter", "arrival")
    return drained(stateful.in_order(stream, delay_s=100.0)).select("drive", "stamp", "idx")


@query(
    "stream_twist_buffer",
    f"""WITH ev AS (SELECT user_id % 8 AS drive, event_id AS idx, event_type, epoch_us(ts) / 1e6 / 36000e0 - CASE WHEN event_id % 211 < 40 THEN 3e0 ELSE 0e0 END AS stamp FROM events),
tw AS (SELECT *, CASE WHEN stamp < lag(stamp) OVER (PARTITION BY drive ORDER BY idx) THEN 1 ELSE 0 END AS back FROM ev WHERE event_type <> 'view'),
run AS (SELECT *, sum(back) OVER (PARTITION BY drive ORDER BY idx) AS run FROM tw),
held AS (SELECT *, count(*) OVER w AS held, min(stamp) OVER w AS oldest FROM run WINDOW w AS (PARTITION BY drive, run ORDER BY stamp RANGE BETWEEN 2e0 PRECEDING AND CURRENT ROW))
SELECT s.drive, s.idx, coalesce(h.held, 0) AS held, {r('h.oldest', 'oldest')}, {r('h.stamp', 'newest')}
FROM (SELECT * FROM ev WHERE event_type = 'view') s ASOF LEFT JOIN held h ON h.drive = s.drive AND s.idx >= h.idx""",
)
def stream_twist_buffer(spark, sf):
    """Samples of a source that now and then goes back in time, and scans that ask for the buffer."""
    kinds = V.events(spark, sf).select("drive", "idx", F.when(F.col("event_type") == "view", "scan").otherwise("twist").alias("kind"))
    rows = V.imu(spark, sf).select("drive", "idx", (F.col("stamp") - F.when(F.col("idx") % 211 < 40, 3.0).otherwise(0.0)).alias("stamp"))
    out = drained(stateful.twist_buffer(replay(rows.join(kinds, ["drive", "idx"]), "idx", tick=False), 2.0))
    return rounded(out.select("drive", "idx", "held", "oldest", "newest"))


@query("stream_decimate", _DECIMATE)
def stream_decimate(spark, sf):
    rows = V.events(spark, sf).select("drive", "idx", F.col("t").alias("stamp"))
    return drained(stateful.stream_decimate(replay(rows, tick=False), 5000.0, order=("stamp", "idx"))).select("drive", "idx")


@query(
    "stream_once_only",
    f"WITH {LOG} SELECT drive, min_by(idx, {{'s': stamp, 'i': idx}}) AS idx FROM lg GROUP BY drive",
)
def stream_once_only(spark, sf):
    rows = V.events(spark, sf).select("drive", "idx", F.col("t").alias("stamp"))
    return drained(stateful.once_only(replay(rows, tick=False))).select("drive", "idx")


# --- health and messages -------------------------------------------------------------------------------


@query(
    "stream_health",
    f"{_HEALTH} SELECT drive, idx, health, CAST(reject_streak AS BIGINT) AS reject_streak, CAST(timeout_streak AS BIGINT) AS timeout_streak, "
    "CASE health WHEN 'healthy' THEN 'OK' WHEN 'degraded' THEN 'WARN' ELSE 'ERROR' END AS level FROM h",
)
def stream_health(spark, sf):
    rows = V.match_log(spark, sf).select("drive", "idx", "stamp", "event")
    out = drained(stateful.stream_health(replay(rows, tick=False), 3))
    return out.select("drive", "idx", "health", "reject_streak", "timeout_streak", "level")


@query(
    "stream_messages",
    f"""WITH {LOG}, st AS (SELECT drive, stamp, {_SKIP} FROM lg)
SELECT 'scan_stages' AS message, drive, count(*) AS n, CAST(sum(CAST(floor(stamp) AS BIGINT)) AS BIGINT) AS stamps, {r('sum(skipped_total)', 'value', 3)} FROM st GROUP BY drive UNION ALL
SELECT 'icp_debug', drive, count(*), CAST(sum(CAST(floor(stamp) AS BIGINT)) AS BIGINT) AS stamps, {r('sum(coalesce(ndt_cost, -1))', 'value', 3)} FROM lg
  WHERE (timed_out AND NOT applied) OR (applied AND NOT first) GROUP BY drive""",
)
def stream_messages(spark, sf):
    """The message tables of the match log after a stream whose last batch was delivered twice."""
    log, folder = replay(V.match_log(spark, sf), tick=False), _folder(spark)
    sink = message_sinks.MessageSink(folder, {"scan_stages": message_sinks.scan_stages, "icp_debug": message_sinks.icp_debug})
    last = {}

    def deliver(batch: DataFrame, number: int) -> None:
        sink(batch, number)
        last[number] = True
        sink(batch, number)

    writer = stateful.stream_skipped(log).writeStream.foreachBatch(deliver).option("checkpointLocation", f"{folder}/state")
    writer.trigger(availableNow=True).start().awaitTermination()
    stages, debug = sink.read(spark, "scan_stages"), sink.read(spark, "icp_debug")
    count = lambda t, name, value: t.groupBy("drive").agg(F.lit(name).alias("message"), F.count("*").alias("n"), F.sum(F.floor("stamp")).alias("stamps"), F.sum(value).alias("value"))
    both = count(stages, "scan_stages", F.col("skipped_total").cast("double")).unionByName(count(debug, "icp_debug", F.col("ndt_cost")))
    return rounded(both.select("message", "drive", "n", "stamps", "value"), 3)
