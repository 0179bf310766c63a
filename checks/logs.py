"""Match logs, health, telemetry, IMU and twist on the derived samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayfold import driver_views as V
from wayfold.functions import rigid
from wayfold.operators import imu, matchlog, metrics, selection
from wayfold.operators.association import interpolate_clamped
from wayfold.sources import trajectories
from wayfold.streaming import stateful

from .registry import GT, query, r, rot, rot_columns, rounded, rs

LOG = """lg AS (SELECT user_id % 8 AS drive, event_id AS idx, epoch_us(ts) / 1e6 AS stamp, value,
  CASE event_type WHEN 'click' THEN 'Accepted' WHEN 'view' THEN 'Saturated' WHEN 'signup' THEN 'Rejected' WHEN 'purchase' THEN 'TimedOut' WHEN 'error' THEN 'KinematicViolation' END AS event,
  (event_id * 7) % 21 AS iterations, (event_id * 3) % 11 * 0.01e0 AS last_step, (event_id * 5) % 40 * 0.06e0 + 0.01e0 AS translation_m,
  (event_id * 17) % 29 * 0.009e0 + 0.001e0 AS rotation_rad, CASE WHEN event_id % 10 = 3 THEN NULL ELSE value / 10 END AS ndt_cost,
  CASE WHEN event_id % 10 = 3 THEN NULL ELSE (event_id * 19) % 23 / 22e0 END AS ndt_inliers, (event_id * 29) % 31 / 31e0 AS inlier_ratio,
  CASE WHEN event_id % 97 = 5 THEN NULL ELSE value / 100 END AS cost, event_type = 'purchase' AS timed_out, event_type = 'view' AS saturated,
  event_type IN ('click', 'view') AS applied, event_id % 50 = 0 AS first, event_id % 3 = 0 AS recovering, value / 11 AS seed_ndt_cost, event_type = 'error' AS skipped,
  value * 0.1e0 AS deskew_ms, value * 0.2e0 + 1 AS voxel_ms, value * 0.5e0 + event_id % 9 AS align_ms, value * 0.05e0 AS cost_ms, event_id % 13 * 0.5e0 AS refine_ms,
  value * 0.3e0 + event_id % 4 AS map_ms FROM events)"""
_ORDER = "PARTITION BY drive ORDER BY stamp, idx ROWS UNBOUNDED PRECEDING"


@query(
    "gate_matches",
    f"""WITH {LOG}, f AS (SELECT *, translation_m <= 0.25e0 AND rotation_rad <= 0.05e0 AS small, coalesce(ndt_inliers >= 0.5e0, false) AS enough,
  ndt_cost IS NOT NULL AS have FROM lg),
g AS (SELECT *, have AND ndt_cost < 7.81e0 AND enough AS strict, small AND enough AND (NOT have OR ndt_cost < 2 * 7.81e0) AS soft FROM f)
SELECT drive, idx, CASE WHEN timed_out AND iterations + 0.5e0 < 3 THEN 'timeout' WHEN recovering AND NOT small AND have AND ndt_cost > seed_ndt_cost + 0.5e0 THEN 'worse_than_seed'
 WHEN iterations <= 0 THEN 'no_iterations' WHEN NOT (translation_m <= CASE WHEN recovering AND strict THEN 3e0 ELSE 1e0 END AND rotation_rad <= 0.2e0) THEN 'step'
 WHEN cost IS NULL THEN 'cost' WHEN have AND NOT strict AND NOT soft THEN 'ndt' WHEN inlier_ratio < 0.3e0 THEN 'inliers' ELSE 'ok' END AS reason,
 timed_out AND iterations + 0.5e0 >= 3 AND last_step <= 0.05e0 AS partial_used FROM g""",
)
def gate_matches(spark, sf):
    return matchlog.gate_matches(V.match_log(spark, sf)).select("drive", "idx", "reason", "partial_used")


@query(
    "step_within_limits",
    f"""WITH {GT}, s AS (SELECT drive, idx, sqrt((x - lag(x) OVER w)**2 + (y - lag(y) OVER w)**2) AS d, yaw - lag(yaw) OVER w AS a, (stamp - lag(stamp) OVER w) / 1000 AS dt
  FROM gt WINDOW w AS (PARTITION BY drive ORDER BY stamp, idx))
SELECT drive, idx, CASE WHEN d IS NULL THEN false WHEN NOT coalesce(dt >= 1e-3, false) THEN true ELSE d / dt <= 5e0 AND abs(a) / dt <= 0.1e0 END AS fits FROM s""",
)
def step_within_limits(spark, sf):
    ch = V.time_chunks(spark, sf)
    g, _ = V.planar_pair(spark, sf, ch)
    m = metrics.relative_motion(g, chunks=ch).withColumn("dt", F.col("dt") / 1000.0)
    p = rigid.pose("motion.")
    return m.select("drive", "idx", matchlog.step_within_limits(F.hypot(p.t.x, p.t.y), rigid.yaw_of(p.q), F.col("dt"), 5.0, 0.1).alias("fits"))


_HEALTH = f"""WITH {LOG}, n AS (SELECT *, sum(CASE WHEN event = 'Accepted' THEN 1 ELSE 0 END) OVER w AS island, sum(CASE WHEN event IN ('Accepted', 'Saturated', 'Rejected') THEN 1 ELSE 0 END) OVER w AS calm
  FROM lg WINDOW w AS ({_ORDER})),
k AS (SELECT *, sum(CASE WHEN event IN ('Rejected', 'KinematicViolation', 'SpeedClamped') THEN 1 ELSE 0 END) OVER i AS reject_streak,
  sum(CASE WHEN event = 'TimedOut' THEN 1 ELSE 0 END) OVER (PARTITION BY drive, calm ORDER BY stamp, idx ROWS UNBOUNDED PRECEDING) AS timeout_streak
  FROM n WINDOW i AS (PARTITION BY drive, island ORDER BY stamp, idx ROWS UNBOUNDED PRECEDING)),
d AS (SELECT *, max(CASE WHEN event IN ('KinematicViolation', 'SpeedClamped') OR (event = 'Rejected' AND reject_streak >= 3) THEN 1 ELSE 0 END)
  OVER (PARTITION BY drive, island ORDER BY stamp, idx ROWS UNBOUNDED PRECEDING) AS gone FROM k),
h AS (SELECT *, CASE WHEN event = 'Accepted' THEN 'healthy' WHEN gone = 1 THEN 'diverged' ELSE 'degraded' END AS health FROM d)"""


@query(
    "health_states",
    f"{_HEALTH} SELECT drive, idx, health, CAST(reject_streak AS BIGINT) AS reject_streak, CAST(timeout_streak AS BIGINT) AS timeout_streak, "
    "CASE health WHEN 'healthy' THEN 'OK' WHEN 'degraded' THEN 'WARN' ELSE 'ERROR' END AS level, event = 'Accepted' AS update_bias, "
    "event IN ('KinematicViolation', 'SpeedClamped') OR (health = 'diverged' AND event IN ('Rejected', 'Saturated')) AS restore_speed FROM h",
)
def health_states(spark, sf):
    ch = V.time_chunks(spark, sf)
    out = matchlog.health_states(V.match_log(spark, sf), 3, chunks=ch)
    return out.select("drive", "idx", "health", "reject_streak", "timeout_streak", "level", "update_bias", "restore_speed")


_SKIP = f"CAST(sum(CASE WHEN skipped OR (timed_out AND NOT applied) THEN 1 ELSE 0 END) OVER ({_ORDER}) AS BIGINT) AS skipped_total"


@query("skipped_total", f"WITH {LOG} SELECT drive, idx, {_SKIP} FROM lg")
def skipped_total(spark, sf):
    ch = V.time_chunks(spark, sf)
    return matchlog.skipped_total(V.match_log(spark, sf), chunks=ch).select("drive", "idx", "skipped_total")


@query("scan_stages", f"WITH {LOG} SELECT drive, {r('stamp', 'stamp', 3)}, {rs('deskew_ms', 'voxel_ms', 'align_ms', 'cost_ms', 'refine_ms', 'map_ms', digits=6)}, timed_out, skipped, applied, {_SKIP} FROM lg")
def scan_stages(spark, sf):
    ch = V.time_chunks(spark, sf)
    return rounded(matchlog.scan_stages(V.match_log(spark, sf), chunks=ch), 6, stamp=3)


@query(
    "match_status",
    f"WITH {LOG} SELECT drive, idx, CASE WHEN timed_out AND NOT applied THEN 'timeout' WHEN saturated THEN 'saturated' ELSE 'applied' END AS status, {r('coalesce(ndt_cost, -1)', 'ndt_cost')}, "
    f"{r('deskew_ms + voxel_ms + align_ms + cost_ms + refine_ms + map_ms', 'total_ms', 6)} FROM lg WHERE (timed_out AND NOT applied) OR (applied AND NOT first)",
)
def match_status(spark, sf):
    return rounded(matchlog.match_status(V.match_log(spark, sf)).select("drive", "idx", "status", "ndt_cost", "total_ms"), 4, total_ms=6)


_STAGES = matchlog.STAGES


@query(
    "stage_latency",
    f"WITH {LOG} SELECT drive, {', '.join(r(f'sum({s})', s + '_total', 3) for s in _STAGES)}, {', '.join(r(f'quantile_cont({s}, 0.5)', s + '_median', 3) for s in _STAGES)}, "
    "count(*) FILTER (skipped) AS skipped, count(*) FILTER (timed_out) AS timed_out, count(*) AS scans FROM lg GROUP BY drive",
)
def stage_latency(spark, sf):
    return rounded(matchlog.stage_latency(V.match_log(spark, sf), chunks=V.time_chunks(spark, sf)), 3)


@query(
    "health_by_window",
    f"WITH {LOG} SELECT drive, CAST(floor(stamp / 86400) * 86400 AS BIGINT) AS window_start, count(*) AS n, count(*) FILTER (event = 'Accepted') AS accepted, count(*) FILTER (event = 'Rejected') AS rejected, count(*) FILTER (event = 'TimedOut') AS timedout FROM lg GROUP BY ALL",
)
def health_by_window(spark, sf):
    log = V.match_log(spark, sf).withColumn("ts", F.timestamp_micros((F.col("stamp") * 1e6).cast("bigint")))
    out = matchlog.health_by_window(log, "1 day")
    return out.select("drive", F.unix_timestamp("window_start").alias("window_start"), "n", "accepted", "rejected", "timedout")


@query(
    "latest_scan_mailbox",
    f"WITH {LOG}, c AS (SELECT *, count(*) OVER (PARTITION BY drive, CAST(floor(stamp / 3600) AS BIGINT)) - 1 AS replaced, CAST(floor(stamp / 3600) AS BIGINT) AS batch FROM lg) "
    "SELECT drive, batch, idx, replaced FROM c QUALIFY row_number() OVER (PARTITION BY drive, batch ORDER BY stamp DESC, idx DESC) = 1",
)
def latest_scan_mailbox(spark, sf):
    log = V.match_log(spark, sf).withColumn("batch", F.floor(F.col("stamp") / 3600.0).cast("bigint"))
    return stateful.latest_only(log.select("drive", "batch", "stamp", "idx"), ("drive", "batch")).select("drive", "batch", "idx", "replaced")


@query(
    "retain_buffer",
    f"WITH {LOG}, n AS (SELECT *, row_number() OVER (PARTITION BY drive ORDER BY stamp DESC, idx DESC) AS age, max(stamp) OVER (PARTITION BY drive) AS newest FROM lg) "
    "SELECT drive, idx FROM n WHERE (stamp >= newest - 86400e0 AND age <= 20000) OR age <= 2",
)
def retain_buffer(spark, sf):
    return stateful.retain(V.match_log(spark, sf).select("drive", "idx", "stamp"), 86400.0).select("drive", "idx")


# --- twist and covariance ------------------------------------------------------------------------------

TWIST = """tw AS (SELECT user_id % 8 AS drive, event_id AS idx, epoch_us(ts) / 1e6 / 36000e0 AS stamp, 5 + sin(event_id) AS vx, 0.2e0 * cos(event_id) AS vy,
  0.05e0 * sin(event_id * 2) AS vz, 0.05e0 * (event_id % 7 - 3) AS wz, CASE event_type WHEN 'view' THEN 'base_link' WHEN 'click' THEN '' ELSE 'odom' END AS frame_id FROM events)"""


@query("twist_filter", f"WITH {TWIST} SELECT drive, idx, {rs('vx', 'wz')} FROM tw WHERE frame_id IN ('', 'base_link')")
def twist_filter(spark, sf):
    return rounded(imu.filter_twist(V.twist(spark, sf)).select("drive", "idx", "vx", "wz"))


@query(
    "body_velocity",
    f"WITH {GT} SELECT drive, idx, {r('cos(yaw)*step + sin(yaw)*dz', 'body_vx')}, {r('cos(yaw)*dz - sin(yaw)*step', 'body_vy')}, 0.25e0 AS cov_x, 0.01e0 AS cov_yaw FROM (SELECT g.*, e.step, e.dz FROM gt g JOIN ev e USING (drive, idx))",
)
def body_velocity(spark, sf):
    ch = V.time_chunks(spark, sf)
    raw = V.raw_route(spark, sf, ch)
    q = rigid.yaw_quat(F.col("yaw"))
    rows = raw.withColumns({**{f"q{n}": c for n, c in zip("wxyz", q, strict=True)}, "vx": F.col("step"), "vy": F.col("dz"), "vz": F.lit(0.0)})
    out = trajectories.with_covariance(trajectories.body_velocity(rows), 0.25, 0.01)
    return rounded(out.select("drive", "idx", "body_vx", "body_vy", F.col("covariance")[0].alias("cov_x"), F.col("covariance")[35].alias("cov_yaw")))


_TW_STEP = TWIST + """,
seg AS (SELECT drive, idx, stamp, vx, wz, lead(stamp) OVER w AS nx, stamp - lag(stamp) OVER w AS gap FROM tw WINDOW w AS (PARTITION BY drive ORDER BY stamp, idx)),
iv AS (SELECT drive, idx AS interval_id, stamp + 0.003e0 AS t0, stamp + 0.153e0 AS t1 FROM tw)"""


@query(
    "twist_between",
    f"""WITH {_TW_STEP}, a AS (SELECT iv.*, s.stamp AS sa FROM iv ASOF LEFT JOIN seg s ON iv.drive = s.drive AND iv.t0 >= s.stamp),
b AS (SELECT a.*, s.stamp AS sb FROM a ASOF LEFT JOIN seg s ON a.drive = s.drive AND a.t1 >= s.stamp),
m AS (SELECT b.drive, b.interval_id, any_value(t1 - sb) AS tail, max(CASE WHEN s.stamp > sa THEN s.gap END) AS hole,
  sum(s.wz * (least(coalesce(s.nx, t1), t1) - greatest(s.stamp, t0))) AS turn
  FROM b JOIN seg s ON s.drive = b.drive AND s.stamp BETWEEN sa AND sb GROUP BY b.drive, b.interval_id)
SELECT drive, interval_id, tail <= 0.1e0 + 1e-9 AND coalesce(hole <= 0.1e0 + 1e-9, true) AS covered,
 CASE WHEN tail <= 0.1e0 + 1e-9 AND coalesce(hole <= 0.1e0 + 1e-9, true) THEN round(turn, 4) + 0e0 END AS turn FROM m""",
)
def twist_between(spark, sf):
    ch = V.time_chunks(spark, sf, V.IMU_TIME_SCALE)
    tw = V.twist(spark, sf).drop("frame_id")
    iv = tw.select("drive", F.col("idx").alias("interval_id"), (F.col("stamp") + 0.003).alias("t0"), (F.col("stamp") + 0.153).alias("t1"))
    out = imu.twist_between(tw, iv, 0.1, chunks=ch)
    return rounded(out.select("drive", "interval_id", F.col("motion").isNotNull().alias("covered"), rigid.yaw_of(rigid.pose("motion.").q).alias("turn")))


@query("twist_motion")
def twist_motion(spark, sf):
    ch = V.time_chunks(spark, sf, V.IMU_TIME_SCALE)
    tw = V.twist(spark, sf).drop("frame_id")
    iv = tw.select("drive", F.col("idx").alias("interval_id"), (F.col("stamp") + 0.003).alias("t0"), (F.col("stamp") + 0.153).alias("t1"))
    out = imu.twist_between(tw, iv, 0.1, chunks=ch).filter(F.col("motion").isNotNull())
    return rounded(out.select("drive", "interval_id", "motion.x", "motion.y", "motion.z"))


# --- IMU -----------------------------------------------------------------------------------------------

IMU = """im AS (SELECT user_id % 8 AS drive, event_id AS idx, epoch_us(ts) / 1e6 / 36000e0 AS stamp, 0.1e0 * sin(event_id) AS ax, 0.1e0 * cos(event_id) AS ay,
  -9.81e0 + 0.05e0 * sin(event_id * 3) AS az, 0.001e0 * cos(event_id * 2) AS wx, 0.001e0 * sin(event_id * 5) AS wy, 0.01e0 * (event_id % 7) AS wz FROM events)"""
N = 6


@query("imu_right_handed", f"WITH {IMU} SELECT drive, idx, {r('-ay', 'ay')}, {r('-wx', 'wx')}, {r('-wz', 'wz')}, {r('az', 'az')} FROM im")
def imu_right_handed(spark, sf):
    return rounded(imu.to_right_handed(V.imu(spark, sf)).select("drive", "idx", "ay", "wx", "wz", "az"))


# Extrinsic: a quarter turn about z, then the lever arm; r = -translation.
@query(
    "imu_lever_arm",
    f"""WITH {IMU}, t AS (SELECT drive, idx, stamp, -ay AS ax, ax AS ay, az, -wy AS wx, wx AS wy, wz FROM im),
l AS (SELECT *, (wx - lag(wx) OVER w) / nullif(greatest(stamp - lag(stamp) OVER w, 0), 0) AS gx, (wy - lag(wy) OVER w) / nullif(greatest(stamp - lag(stamp) OVER w, 0), 0) AS gy,
  (wz - lag(wz) OVER w) / nullif(greatest(stamp - lag(stamp) OVER w, 0), 0) AS gz FROM t WINDOW w AS (PARTITION BY drive ORDER BY stamp, idx)),
c AS (SELECT *, wy*(-1.5e0) - wz*0.2e0 AS cx, wz*(-0.5e0) - wx*(-1.5e0) AS cy, wx*0.2e0 - wy*(-0.5e0) AS cz FROM l)
SELECT drive, idx, {r('ax + coalesce(gy*(-1.5e0) - gz*0.2e0, 0) + wy*cz - wz*cy', 'ax', 3)}, {r('ay + coalesce(gz*(-0.5e0) - gx*(-1.5e0), 0) + wz*cx - wx*cz', 'ay', 3)},
 {r('az + coalesce(gx*0.2e0 - gy*(-0.5e0), 0) + wx*cy - wy*cx', 'az', 3)}, {rs('wx', 'wz')} FROM c""",
)
def imu_lever_arm(spark, sf):
    ch = V.time_chunks(spark, sf, V.IMU_TIME_SCALE)
    ext = rigid.Pose(rigid.lit_vec(0.5, -0.2, 1.5), rigid.Quat(F.lit(0.5**0.5), F.lit(0.0), F.lit(0.0), F.lit(0.5**0.5)))
    out = imu.lever_arm(V.imu(spark, sf), ext, chunks=ch)
    return rounded(out.select("drive", "idx", "ax", "ay", "az", "wx", "wz"), 3, wx=4, wz=4)


_STILL = IMU + f""",
rn AS (SELECT *, row_number() OVER (PARTITION BY drive ORDER BY stamp, idx) AS rn FROM im),
wd AS (SELECT *, count(*) OVER w AS n, max(sqrt(wx*wx + wy*wy + wz*wz)) OVER w AS wm, avg(ax) OVER w AS mx, avg(ay) OVER w AS my, avg(az) OVER w AS mz, avg(wx) OVER w AS bx,
  avg(wy) OVER w AS b_y, avg(wz) OVER w AS bz, list({{'x': ax, 'y': ay, 'z': az}}) OVER w AS pts
  FROM rn WINDOW w AS (PARTITION BY drive ORDER BY stamp, idx ROWS BETWEEN {N - 1} PRECEDING AND CURRENT ROW)),
still AS (SELECT * FROM wd WHERE n = {N} AND wm <= 0.05e0 AND list_max([sqrt((p.x-mx)**2 + (p.y-my)**2 + (p.z-mz)**2) for p in pts]) <= 0.14e0)"""


@query("stationary_windows", f"WITH {_STILL} SELECT drive, rn FROM still")
def stationary_windows(spark, sf):
    ch = V.time_chunks(spark, sf, V.IMU_TIME_SCALE)
    return imu.stationary_windows(V.imu(spark, sf), N, 0.05, 0.14, chunks=ch).select("drive", "rn")


def _alignment(spark, sf, ch):
    samples = V.imu(spark, sf)
    first = imu.stationary_windows(samples, N, 0.05, 0.14, chunks=ch, first_only=True)
    return imu.window_alignment(samples, first, N, chunks=ch)


@query(
    "stationary_alignment",
    f"""WITH {_STILL}, o AS (SELECT *, sqrt(mx*mx + my*my + mz*mz) AS g FROM still QUALIFY row_number() OVER (PARTITION BY drive ORDER BY rn) = 1),
q AS (SELECT *, sqrt((1 - mz/g)**2 + (my/g)**2 + (mx/g)**2) AS s FROM o)
SELECT drive, rn, {r('bx', 'bias_wx', 6)}, {r('bz', 'bias_wz', 6)}, {r('CASE WHEN g BETWEEN 8 AND 11 THEN g ELSE 9.81e0 END', 'gravity')}, {r('(1 - mz/g)/s', 'qw', 6)}, {r('-(my/g)/s', 'qx', 6)}, {r('(mx/g)/s', 'qy', 6)} FROM q""",
)
def stationary_alignment(spark, sf):
    ch = V.time_chunks(spark, sf, V.IMU_TIME_SCALE)
    return rounded(_alignment(spark, sf, ch).select("drive", "rn", "bias_wx", "bias_wz", "gravity", "qw", "qx", "qy"), 6, gravity=4)


_CL = "least({m}, greatest(-{m}, {x}))"


@query(
    "limit_velocity",
    f"""WITH {TWIST}, l AS (SELECT drive, idx, lag(vx*4.2e0) OVER w AS b, vx*4.2e0 AS a, lag(vz*30) OVER w AS c, vz*30 AS d, stamp - lag(stamp) OVER w AS dt FROM tw WINDOW w AS (PARTITION BY drive ORDER BY stamp, idx)),
k AS (SELECT *, {_CL.format(m='20e0', x='b')} AS b1, {_CL.format(m='20e0', x='a')} AS a1, {_CL.format(m='20e0', x='c')} AS c1, {_CL.format(m='20e0', x='d')} AS d1 FROM l WHERE b IS NOT NULL)
SELECT drive, idx, {r(_CL.format(m='20e0', x='CASE WHEN dt > 1e-6 THEN least(b1 + 5*dt, greatest(b1 - 5*dt, a1)) ELSE a1 END'), 'vx')}, {r(_CL.format(m='20e0', x='CASE WHEN dt > 1e-6 THEN least(c1 + 5*dt, greatest(c1 - 5*dt, d1)) ELSE d1 END'), 'vz')} FROM k""",
)
def limit_velocity(spark, sf):
    from wayfold.operators.ordered import lag_row

    ch = V.time_chunks(spark, sf, V.IMU_TIME_SCALE)
    rows = V.twist(spark, sf).select("drive", "idx", "stamp", (F.col("vx") * 4.2).alias("a"), (F.col("vz") * 30.0).alias("d"))
    rows = lag_row(rows, ("drive",), ("stamp", "idx"), ("stamp", "a", "d"), ch, "b").filter(F.col("b").isNotNull())
    x, _, z = imu.limit_velocity((F.col("b.a"), F.col("b.d")), (F.col("a"), F.col("d")), F.col("stamp") - F.col("b.stamp"))
    return rounded(rows.select("drive", "idx", x.alias("vx"), z.alias("vz")))


@query("dead_reckon")
def dead_reckon(spark, sf):
    ch = V.time_chunks(spark, sf, V.IMU_TIME_SCALE)
    out = imu.dead_reckon(V.imu(spark, sf), _alignment(spark, sf, ch), max_dt=0.2, chunks=ch)
    return rounded(out.select("drive", "idx", "x", "y", "z", "qw", "vx", "vy", "speed_clamped"))


@query("blend_corrections")
def blend_corrections(spark, sf):
    ch = V.time_chunks(spark, sf)
    g = V.gt(spark, sf, ch)
    i = F.col("idx")
    zero = F.lit(0.0)
    delta = rigid.Pose(rigid.Vec(0.01 * F.sin(i), 0.02 * F.cos(i), zero), rigid.yaw_quat(0.01 * F.sin(i * 2)))
    c = g.select("drive", i.alias("seq"), F.col("stamp").alias("since"), (F.col("stamp") + 3600.0).alias("scan"), (F.col("stamp") + 7200.0).alias("tip"), delta.struct().alias("delta"))
    return rounded(imu.blend_corrections(g, c, bucket_s=7200.0).select("drive", "idx", "x", "y", "z"), 3)


@query("pair_scans")
def pair_scans(spark, sf):
    ch = V.time_chunks(spark, sf)
    g, e = V.gt(spark, sf, ch), V.est(spark, sf, ch)
    ends = g.select("drive", F.col("idx").alias("scan_id"), (F.col("stamp") + 5.0).alias("scan_end"))
    at = interpolate_clamped(g.select("drive", F.col("idx").alias("scan_id"), (F.col("stamp") - 600.0).alias("anchor_stamp")), g, "anchor_stamp", chunks=ch, into="anchor")
    out = imu.pair_scans(ends, e, at, None, 45.0, chunks=ch)
    return rounded(out.select("drive", "scan_id", F.col("seed.x").alias("x"), F.col("seed.y").alias("y")), 3)


# --- greedy selections ---------------------------------------------------------------------------------


_KEYFRAMES = f"""WITH RECURSIVE {GT}, n AS (SELECT *, row_number() OVER (PARTITION BY drive ORDER BY stamp, idx) AS rn FROM gt),
m AS (SELECT drive, rn, idx, x, y, z, {rot_columns('', 'm')} FROM n),
nx AS (SELECT a.drive, a.rn, a.idx, min(b.rn) AS next_rn FROM m a LEFT JOIN m b ON b.drive = a.drive AND b.rn > a.rn AND b.rn <= a.rn + 64
  AND ((b.x - a.x)**2 + (b.y - a.y)**2 + (b.z - a.z)**2 >= 100e0 OR acos(least(1e0, greatest(-1e0, ({' + '.join(f'a.m{k}*b.m{k}' for k in rot('x'))} - 1) / 2))) >= 0.5e0) GROUP BY ALL),
kept AS (SELECT * FROM nx WHERE rn = 1 UNION ALL SELECT n.* FROM kept k JOIN nx n ON n.drive = k.drive AND n.rn = k.next_rn)
SELECT drive, idx FROM kept"""


@query("keyframes", _KEYFRAMES)
def keyframes(spark, sf):
    ch = V.time_chunks(spark, sf)
    return selection.keyframes(V.gt(spark, sf, ch), 10.0, 0.5, chunks=ch).select("drive", "idx")


_DECIMATE = f"""WITH RECURSIVE {GT}, nx AS (SELECT a.drive, a.idx, a.stamp, b.idx AS next_idx FROM gt a ASOF LEFT JOIN gt b ON a.drive = b.drive AND a.stamp + 5000e0 <= b.stamp),
kept AS (SELECT drive, idx, next_idx FROM (SELECT * FROM nx QUALIFY row_number() OVER (PARTITION BY drive ORDER BY stamp, idx) = 1)
  UNION ALL SELECT n.drive, n.idx, n.next_idx FROM kept k JOIN nx n ON n.drive = k.drive AND n.idx = k.next_idx)
SELECT drive, idx FROM kept"""


@query("decimate", _DECIMATE)
def decimate(spark, sf):
    ch = V.time_chunks(spark, sf)
    rows = V.gt(spark, sf, ch).select("drive", "idx", "stamp")
    return selection.decimate(rows, 5000.0, chunks=ch, order="stamp").select("drive", "idx")
