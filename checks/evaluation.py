"""Association, alignment, errors, segments and sections on the derived trajectories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold import driver_views as V
from wayfold.formats import FILTER, ODOM
from wayfold.functions import rigid
from wayfold.operators import align, association, metrics, points, sections
from wayfold.operators.ordered import Chunks
from wayfold.plans import evaluate
from wayfold.session import cut, stored
from wayfold.sources import sinks, trajectories

from .registry import (
    ERR2, FIRST2, FIT2, GAP, GT, PAIRS, UNIQUE, query, r, rot, rot_columns, rounded, rs, wrap,
)

DELTA = 3600.0


def data(spark: SparkSession, sf: str) -> tuple[Chunks, DataFrame, DataFrame]:
    ch = V.time_chunks(spark, sf)
    return ch, V.gt(spark, sf, ch), V.est(spark, sf, ch)


def near_pairs(spark, sf, planar: bool = False):
    ch = V.time_chunks(spark, sf)
    g, e = V.planar_pair(spark, sf, ch) if planar else (V.gt(spark, sf, ch), V.est(spark, sf, ch))
    p = association.associate_nearest(e, g, GAP, chunks=ch)
    return ch, p if ch.whole else cut(p)  # alignment, errors and their quantiles each read the pairs


# --- association ---------------------------------------------------------------------------------------


@query("assoc_nearest", f"WITH {PAIRS} SELECT drive, idx, gt_idx, {r('dt', 'dt')}, {rs('ex', 'gy', digits=3)}, {r('sin(eyaw)', 'yaw_sin', 3)} FROM pairs")
def assoc_nearest(spark, sf):
    _, p = near_pairs(spark, sf, planar=True)
    turn = F.sin(rigid.yaw_of(rigid.pose("est.").q))
    out = p.select("drive", "idx", "gt_idx", "dt", F.col("est.x").alias("ex"), F.col("gt.y").alias("gy"), turn.alias("yaw_sin"))
    return rounded(out, 3, dt=4)


@query(
    "assoc_unique",
    f"WITH {UNIQUE} SELECT drive, idx AS est_idx, gt_idx, {r('dt', 'dt')}, {rs('ex', 'gy', digits=3)} FROM uniq",
)
def assoc_unique(spark, sf):
    ch, g, e = data(spark, sf)
    p = association.associate_unique(e, g, GAP, chunks=ch)
    return rounded(p.select("drive", "est_idx", "gt_idx", "dt", F.col("est.x").alias("ex"), F.col("gt.y").alias("gy")), 3, dt=4)


SPLIT_GAP = 900.0
SPLIT = GT + f""",
b AS (
  SELECT g.drive, g.idx, g.stamp, l.stamp AS ls, l.idx AS li, l.x AS lx, l.y AS ly, l.z AS lz, l.yaw AS lyaw,
    n.stamp AS ns, n.idx AS ni, n.x AS nx, n.y AS ny, n.z AS nz, n.yaw AS nyaw
  FROM gt g ASOF LEFT JOIN est l ON g.drive = l.drive AND g.stamp > l.stamp
  ASOF LEFT JOIN est n ON g.drive = n.drive AND g.stamp <= n.stamp),
c AS (SELECT *, coalesce(stamp - ls, 'inf'::DOUBLE) AS dl, coalesce(ns - stamp, 'inf'::DOUBLE) AS dr FROM b),
d AS (SELECT *, dl <= {SPLIT_GAP} AND dr <= {SPLIT_GAP} AND ns - ls > 1e-9 AS both_in, dl <= dr AS use_l FROM c),
split AS (
  SELECT drive, idx AS gt_idx, both_in AS interpolated, CASE WHEN use_l THEN li ELSE ni END AS est_idx, least(dl, dr) AS dt,
    CASE WHEN both_in THEN lx + (nx - lx) * dl / (ns - ls) WHEN use_l THEN lx ELSE nx END AS x,
    CASE WHEN both_in THEN ly + (ny - ly) * dl / (ns - ls) WHEN use_l THEN ly ELSE ny END AS y,
    CASE WHEN both_in THEN lz + (nz - lz) * dl / (ns - ls) WHEN use_l THEN lz ELSE nz END AS z,
    CASE WHEN both_in THEN lyaw + {wrap('nyaw - lyaw')} * dl / (ns - ls) WHEN use_l THEN lyaw ELSE nyaw END AS yaw
  FROM d WHERE both_in OR least(dl, dr) <= {SPLIT_GAP})"""


@query(
    "interp_split",
    f"WITH {SPLIT} SELECT drive, gt_idx, interpolated, est_idx, {r('dt', 'dt')}, {rs('x', 'y', 'z', digits=3)}, "
    f"{r('sin(yaw)', 'yaw_sin', 3)}, {r('cos(yaw)', 'yaw_cos', 3)} FROM split",
)
def interp_split(spark, sf):
    ch = V.time_chunks(spark, sf)
    g, e = V.planar_pair(spark, sf, ch)
    p = association.interpolate_split(e, g, SPLIT_GAP, chunks=ch)
    yaw = rigid.yaw_of(rigid.pose("est.").q)
    out = p.select(
        "drive", "gt_idx", "interpolated", "est_idx", "dt", "est.x", "est.y", "est.z", F.sin(yaw).alias("yaw_sin"),
        F.cos(yaw).alias("yaw_cos"),
    )
    return rounded(out, 3, dt=4)


def screw_sql(source: str, where: str) -> str:
    """Planar screw between l and n at fraction k, independent closed form: rotate about the motion's pole."""
    return f"""
s AS (SELECT *, CASE WHEN ns - ls > 1e-9 THEN (stamp - ls) / (ns - ls) ELSE 0e0 END AS k, {wrap('nyaw - lyaw')} AS th,
    cos(lyaw) * (nx - lx) + sin(lyaw) * (ny - ly) AS ux, cos(lyaw) * (ny - ly) - sin(lyaw) * (nx - lx) AS uy
  FROM {source} {where}),
pole AS (SELECT *, CASE WHEN abs(th) > 1e-9 THEN (ux - uy / tan(th / 2)) / 2 END AS cx,
    CASE WHEN abs(th) > 1e-9 THEN (uy + ux / tan(th / 2)) / 2 END AS cy FROM s),
m AS (SELECT *, CASE WHEN cx IS NULL THEN k * ux ELSE cx - cos(k * th) * cx + sin(k * th) * cy END AS mx,
    CASE WHEN cx IS NULL THEN k * uy ELSE cy - sin(k * th) * cx - cos(k * th) * cy END AS my FROM pole),
scr AS (SELECT *, CASE WHEN ls IS NULL THEN nx WHEN ns IS NULL THEN lx ELSE lx + cos(lyaw) * mx - sin(lyaw) * my END AS px,
    CASE WHEN ls IS NULL THEN ny WHEN ns IS NULL THEN ly ELSE ly + sin(lyaw) * mx + cos(lyaw) * my END AS py,
    CASE WHEN ls IS NULL THEN nz WHEN ns IS NULL THEN lz ELSE lz + k * (nz - lz) END AS pz,
    CASE WHEN ls IS NULL THEN nyaw WHEN ns IS NULL THEN lyaw ELSE lyaw + k * th END AS pyaw FROM m)"""


BRACKET = GT + """,
b AS (
  SELECT g.drive, g.idx, g.stamp, l.stamp AS ls, l.x AS lx, l.y AS ly, l.z AS lz, l.yaw AS lyaw,
    n.stamp AS ns, n.x AS nx, n.y AS ny, n.z AS nz, n.yaw AS nyaw
  FROM gt g ASOF LEFT JOIN est l ON g.drive = l.drive AND g.stamp > l.stamp
  ASOF LEFT JOIN est n ON g.drive = n.drive AND g.stamp <= n.stamp)"""

_SCREW_OUT = (
    f"SELECT drive, idx, {rs('px', 'py', 'pz', digits=3)}, {r('sin(pyaw)', 'yaw_sin', 3)}, {r('cos(pyaw)', 'yaw_cos', 3)} FROM scr"
)


def _screw_columns(df: DataFrame, column: str) -> DataFrame:
    yaw = rigid.yaw_of(rigid.pose(column + ".").q)
    return rounded(
        df.select(
            "drive", "idx", F.col(f"{column}.x").alias("px"), F.col(f"{column}.y").alias("py"), F.col(f"{column}.z").alias("pz"),
            F.sin(yaw).alias("yaw_sin"), F.cos(yaw).alias("yaw_cos"),
        ), 3,
    )


@query(
    "interp_screw",
    f"WITH {BRACKET}, {screw_sql('b', f'WHERE (ns IS NOT NULL OR stamp - ls <= 1e-9) AND least(stamp - ls, ns - stamp) <= {GAP}')} {_SCREW_OUT}",
)
def interp_screw(spark, sf):
    ch = V.time_chunks(spark, sf)
    g, e = V.planar_pair(spark, sf, ch)
    return _screw_columns(association.interpolate_screw(e, g, GAP, chunks=ch), "est")


@query("interp_clamped", f"WITH {BRACKET}, {screw_sql('b', '')} {_SCREW_OUT}")
def interp_clamped(spark, sf):
    ch = V.time_chunks(spark, sf)
    g, e = V.planar_pair(spark, sf, ch)
    out = association.interpolate_clamped(g.select("drive", "idx", F.col("stamp").alias("t")), e, "t", chunks=ch)
    return _screw_columns(out, "at")


CLOSEST = GT + """,
b AS (
  SELECT g.drive, g.idx, g.stamp, l.stamp AS ls, l.idx AS li, n.stamp AS ns, n.idx AS ni
  FROM gt g ASOF LEFT JOIN est l ON g.drive = l.drive AND g.stamp > l.stamp
  ASOF LEFT JOIN est n ON g.drive = n.drive AND g.stamp <= n.stamp),
c AS (SELECT *, ls IS NOT NULL AND (ns IS NULL OR stamp - ls <= ns - stamp) AS earlier FROM b),
h AS (SELECT drive, idx, CASE WHEN earlier THEN li ELSE ni END AS hit_idx,
  abs(CASE WHEN earlier THEN stamp - ls ELSE ns - stamp END) AS dt FROM c)"""


@query("closest_pose", f"WITH {CLOSEST} SELECT drive, idx, hit_idx, {r('dt', 'dt')} FROM h")
def closest_pose(spark, sf):
    ch, g, e = data(spark, sf)
    out = association.closest_pose(g.select("drive", "idx", F.col("stamp").alias("t")), e, chunks=ch)
    return rounded(out.select("drive", "idx", F.col("hit.idx").alias("hit_idx"), "dt"))


@query("has_pose_near", f"WITH {CLOSEST} SELECT drive, idx, dt <= 35e0 AS covered FROM h")
def has_pose_near(spark, sf):
    ch, g, e = data(spark, sf)
    q = g.select("drive", "idx", F.col("stamp").alias("t"))
    return association.has_pose_near(q, e, 35.0, chunks=ch).select("drive", "idx", "covered")


# --- distance and motion -------------------------------------------------------------------------------

STEPS = GT + """,
st AS (SELECT drive, idx, stamp, x, y, z, yaw, roll, pitch, lag(x) OVER w AS bx, lag(y) OVER w AS b_y, lag(z) OVER w AS bz,
  lag(yaw) OVER w AS byaw, lag(roll) OVER w AS broll, lag(pitch) OVER w AS bpitch, lag(stamp) OVER w AS bs
  FROM gt WINDOW w AS (PARTITION BY drive ORDER BY stamp, idx))"""
STEP3 = "coalesce(sqrt((x - bx) ** 2 + (y - b_y) ** 2 + (z - bz) ** 2), 0e0)"
STEP2 = "coalesce(sqrt((x - bx) ** 2 + (y - b_y) ** 2), 0e0)"


@query(
    "path_length",
    f"WITH {STEPS} SELECT drive, {r(f'sum({STEP3})', 'path_m')}, {r(f'sum({STEP2})', 'path_xy_m')}, count(*) AS n FROM st GROUP BY drive",
)
def path_length(spark, sf):
    ch, g, _ = data(spark, sf)
    full = metrics.path_length(g, chunks=ch)
    flat = metrics.path_length(g, planar=True, chunks=ch).select("drive", F.col("path_m").alias("path_xy_m"))
    return rounded(full.join(flat, "drive").select("drive", "path_m", "path_xy_m", "n"))


@query(
    "cumulative_distance",
    f"WITH {STEPS} SELECT drive, idx, round(sum({STEP3}) OVER (PARTITION BY drive ORDER BY stamp, idx ROWS UNBOUNDED PRECEDING), 3) + 0e0 AS distance FROM st",
)
def cumulative_distance(spark, sf):
    ch, g, _ = data(spark, sf)
    return rounded(metrics.cumulative_distance(g, chunks=ch).select("drive", "idx", "distance"), 3)


@query(
    "relative_motion",
    f"WITH {STEPS}, m AS (SELECT *, {rot_columns('b', 'b')}, {rot_columns('', 'r')} FROM st) SELECT drive, idx, {r('stamp - bs', 'dt', 3)}, "
    f"{r('b00*(x-bx)+b10*(y-b_y)+b20*(z-bz)', 'mx')}, {r('b01*(x-bx)+b11*(y-b_y)+b21*(z-bz)', 'my')}, {r('b02*(x-bx)+b12*(y-b_y)+b22*(z-bz)', 'mz')}, "
    + r("CASE WHEN bx IS NOT NULL THEN acos(least(1e0, greatest(-1e0, (b00*r00+b10*r10+b20*r20+b01*r01+b11*r11+b21*r21+b02*r02+b12*r12+b22*r22-1)/2))) END", "angle")
    + " FROM m",
)
def relative_motion(spark, sf):
    ch, g, _ = data(spark, sf)
    out = metrics.relative_motion(g, chunks=ch)
    m = rigid.pose("motion.")
    out = out.select(
        "drive", "idx", "dt", m.t.x.alias("mx"), m.t.y.alias("my"), m.t.z.alias("mz"), rigid.rotation_angle(m.q).alias("angle")
    )
    return rounded(out, 4, dt=3)


# --- alignment -----------------------------------------------------------------------------------------


@query("align_rigid_se2", f"WITH {PAIRS}, {FIT2} SELECT drive, {rs('th', 'tx', 'ty')} FROM fit2")
def align_rigid_se2(spark, sf):
    _, p = near_pairs(spark, sf)
    return rounded(align.align_rigid_se2(p).withColumnRenamed("theta", "th"))


@query("align_first_se2", f"WITH {PAIRS}, {FIRST2} SELECT drive, {rs('th', 'tx', 'ty')} FROM fit2")
def align_first_se2(spark, sf):
    _, p = near_pairs(spark, sf, planar=True)
    return rounded(align.align_first_se2(p).withColumnRenamed("theta", "th"))


_FIRST3 = f""", one AS (
  SELECT *, {rot_columns('e', 'a')}, {rot_columns('g', 'c')} FROM pairs
  QUALIFY row_number() OVER (PARTITION BY drive ORDER BY stamp, idx) = 1),
tf AS (SELECT drive, gx, gy, gz, ex, ey, ez, {', '.join(
    f"{' + '.join(f'c{i}{j}*a{k}{j}' for j in range(3))} AS t{i}{k}" for i in range(3) for k in range(3))} FROM one)"""


@query(
    "align_first_se3",
    f"WITH {PAIRS}{_FIRST3} SELECT drive, {r('gx - (t00*ex + t01*ey + t02*ez)', 'tx')}, {r('gy - (t10*ex + t11*ey + t12*ez)', 'ty')}, "
    f"{r('gz - (t20*ex + t21*ey + t22*ez)', 'tz')}, {r('degrees(acos(least(1e0, (t00 + t11 + t22 - 1) / 2)))', 'rotation_deg')}, "
    f"{r('degrees(atan2(t10, t00))', 'yaw_deg')} FROM tf",
)
def align_first_se3(spark, sf):
    _, p = near_pairs(spark, sf)
    s = align.rigid_summary_se3(align.align_first_se3(p))
    return rounded(
        s.select("drive", *[F.col(f"translation_{a}").alias(f"t{a}") for a in "xyz"], "rotation_deg", "yaw_deg")
    )


@query(
    "rigid_summary",
    f"WITH {PAIRS}, {FIT2} SELECT drive, {r('tx', 'translation_x')}, {r('ty', 'translation_y')}, "
    f"{r('sqrt(tx*tx + ty*ty)', 'translation_norm_m')}, {r('degrees(th)', 'yaw_deg')} FROM fit2",
)
def rigid_summary(spark, sf):
    _, p = near_pairs(spark, sf)
    return rounded(align.rigid_summary_se2(align.align_rigid_se2(p)))


# --- absolute and relative errors ----------------------------------------------------------------------

_ATE2 = (
    f"SELECT drive, {r('sqrt(avg(horiz*horiz))', 'rmse_xy_m')}, {r('avg(horiz)', 'mean_xy_m')}, {r('quantile_cont(horiz, 0.5)', 'median_xy_m')}, "
    f"{r('max(horiz)', 'max_xy_m')}, {r('degrees(sqrt(avg(dyaw*dyaw)))', 'rmse_yaw_deg')}, count(*) AS num_poses FROM errh GROUP BY drive"
)
_ATE2_COLS = ("drive", "rmse_xy_m", "mean_xy_m", "median_xy_m", "max_xy_m", "rmse_yaw_deg", "num_poses")


@query("ate_planar_fit", f"WITH {PAIRS}, {FIT2}, {ERR2} {_ATE2}")
def ate_planar_fit(spark, sf):
    ch, p = near_pairs(spark, sf, planar=True)
    return rounded(metrics.ate_planar(align.apply_se2(p, align.align_rigid_se2(p)), chunks=ch).select(*_ATE2_COLS))


@query("ate_planar_first", f"WITH {PAIRS}, {FIRST2}, {ERR2} {_ATE2}")
def ate_planar_first(spark, sf):
    ch, p = near_pairs(spark, sf, planar=True)
    return rounded(metrics.ate_planar(align.apply_se2(p, align.align_first_se2(p)), chunks=ch).select(*_ATE2_COLS))


@query(
    "ate_split_raw",
    f"WITH {PAIRS}, e AS (SELECT *, ex-gx AS dx, ey-gy AS dy, ez-gz AS dz, {wrap('eyaw-gyaw')} AS dyaw, {wrap('eroll-groll')} AS droll, "
    f"{wrap('epitch-gpitch')} AS dpitch FROM pairs), h AS (SELECT *, sqrt(dx*dx+dy*dy) AS horiz FROM e) SELECT drive, "
    f"{r('sqrt(avg(horiz*horiz))', 'rmse_horiz_m')}, {r('avg(horiz)', 'mean_horiz_m')}, {r('quantile_cont(horiz, 0.5)', 'median_horiz_m')}, "
    f"{r('max(horiz)', 'max_horiz_m')}, {r('sqrt(avg(dz*dz))', 'rmse_vert_m')}, {r('avg(dz)', 'mean_vert_m')}, "
    f"{r('sqrt(avg(dx*dx+dy*dy+dz*dz))', 'rmse_xyz_m')}, {r('degrees(sqrt(avg(dyaw*dyaw)))', 'rmse_yaw_deg')}, {r('degrees(avg(dyaw))', 'mean_yaw_deg')}, "
    f"{r('degrees(sqrt(avg(droll*droll)))', 'rmse_roll_deg')}, {r('degrees(sqrt(avg(dpitch*dpitch)))', 'rmse_pitch_deg')}, count(*) AS num_poses FROM h GROUP BY drive",
)
def ate_split_raw(spark, sf):
    ch, p = near_pairs(spark, sf)
    return rounded(metrics.ate_split(p, chunks=ch))


@query(
    "association_rate",
    f"WITH {PAIRS} SELECT drive, {r('CASE WHEN max(stamp) - min(stamp) > 1e-6 THEN count(*) / (max(stamp) - min(stamp)) ELSE 0 END', 'association_hz', 8)}, count(*) AS n FROM pairs GROUP BY drive",
)
def association_rate(spark, sf):
    _, p = near_pairs(spark, sf)
    return rounded(metrics.association_rate(p), 8)


@query(
    "body_frame_error",
    f"WITH {PAIRS}, {FIRST2}, {ERR2}, q AS (SELECT *, row_number() OVER (PARTITION BY drive ORDER BY stamp, idx) AS rn FROM errh) "
    f"SELECT drive, idx, {r('cos(gyaw)*dx + sin(gyaw)*dy', 'longitudinal_m', 3)}, {r('cos(gyaw)*dy - sin(gyaw)*dx', 'lateral_m', 3)}, {r('dz', 'vertical_m', 3)} FROM q",
)
def body_frame_error(spark, sf):
    _, p = near_pairs(spark, sf, planar=True)
    out = metrics.body_frame_error(align.apply_se2(p, align.align_first_se2(p)))
    return rounded(out.select("drive", "idx", "longitudinal_m", "lateral_m", "vertical_m"), 3)


_R = rot
_RPE = PAIRS + f""",
t AS (SELECT *, stamp + {DELTA}e0 AS target FROM pairs),
fin AS (SELECT * FROM pairs QUALIFY row_number() OVER (PARTITION BY drive ORDER BY stamp DESC, idx DESC) = 1),
j AS (
  SELECT a.*, coalesce(b.idx, f.idx) AS j_idx, coalesce(b.stamp, f.stamp) AS j_stamp
  FROM t a ASOF LEFT JOIN pairs b ON a.drive = b.drive AND a.target <= b.stamp JOIN fin f ON f.drive = a.drive),
k AS (
  SELECT a.drive, a.idx, {', '.join(f'a.{s}{c} AS {s}{c}0, b.{s}{c} AS {s}{c}1' for s in 'eg' for c in ('x', 'y', 'z', 'yaw', 'roll', 'pitch'))}
  FROM j a JOIN pairs b ON b.drive = a.drive AND b.idx = a.j_idx
  WHERE a.j_stamp > a.stamp AND abs(a.j_stamp - a.target) <= {0.5 * DELTA}e0),
rr AS (SELECT *, sqrt((gx1-gx0)**2 + (gy1-gy0)**2) AS chord,
  cos(eyaw0)*(ex1-ex0) + sin(eyaw0)*(ey1-ey0) - cos(gyaw0)*(gx1-gx0) - sin(gyaw0)*(gy1-gy0) AS ux,
  cos(eyaw0)*(ey1-ey0) - sin(eyaw0)*(ex1-ex0) - cos(gyaw0)*(gy1-gy0) + sin(gyaw0)*(gx1-gx0) AS uy,
  abs({wrap('(eyaw1-eyaw0)-(gyaw1-gyaw0)')}) AS turn FROM k),
ok AS (SELECT *, sqrt(ux*ux + uy*uy) AS trans FROM rr WHERE chord >= 1e-3)"""


@query(
    "rpe_planar",
    f"WITH {_RPE} SELECT drive, {r('sqrt(avg(trans*trans))', 'translation_rmse_m')}, {r('100*avg(trans/chord)', 'translation_percent')}, "
    f"{r('degrees(sqrt(avg(turn*turn)))', 'yaw_rmse_deg')}, {r('avg(degrees(turn)/chord)', 'yaw_deg_per_m', 5)}, count(*) AS num_pairs FROM ok GROUP BY drive",
)
def rpe_planar(spark, sf):
    ch, p = near_pairs(spark, sf, planar=True)
    out = metrics.rpe(p, DELTA, chunks=ch)
    return rounded(
        out.select(
            "drive", F.col("se2_translation_rmse_m").alias("translation_rmse_m"), F.col("se2_translation_percent").alias("translation_percent"),
            F.col("se2_yaw_rmse_deg").alias("yaw_rmse_deg"), F.col("se2_yaw_deg_per_m").alias("yaw_deg_per_m"), "num_pairs",
        ), 4, yaw_deg_per_m=5,
    )


# --- KITTI ---------------------------------------------------------------------------------------------


def kitti_sql(space: str) -> str:
    step = "(gx-bx)**2 + (gy-b_y)**2" + (" + (gz-bz)**2" if space == "se3" else "")
    sides = ", ".join(f"a.{s}{c} AS {s}{c}0, b.{s}{c} AS {s}{c}1" for s in "eg" for c in ("x", "y", "z", "yaw", "roll", "pitch"))
    base = UNIQUE + f""",
lagged AS (SELECT *, lag(gx) OVER w AS bx, lag(gy) OVER w AS b_y, lag(gz) OVER w AS bz, row_number() OVER w AS rn
  FROM uniq WINDOW w AS (PARTITION BY drive ORDER BY stamp, gt_idx)),
dist AS (SELECT *, sum(coalesce(sqrt({step}), 0e0)) OVER (PARTITION BY drive ORDER BY rn ROWS UNBOUNDED PRECEDING) AS d FROM lagged),
starts AS (SELECT *, d + l.length_m AS target FROM dist, (SELECT unnest([100e0,200e0,300e0,400e0,500e0,600e0,700e0,800e0]) AS length_m) l WHERE (rn - 1) % 10 = 0),
ends AS (SELECT drive, d, min(rn) AS rn FROM dist GROUP BY drive, d),
hit AS (SELECT a.*, b.rn AS last_rn FROM starts a ASOF JOIN ends b ON a.drive = b.drive AND a.target < b.d),
k AS (SELECT a.drive, a.length_m, a.rn AS first_rn, a.last_rn, a.d AS d0, b.d AS d1, {sides} FROM hit a JOIN dist b ON b.drive = a.drive AND b.rn = a.last_rn),"""
    if space == "se2":
        return base + f"""
e AS (SELECT *, cos(eyaw0)*(ex1-ex0) + sin(eyaw0)*(ey1-ey0) - cos(gyaw0)*(gx1-gx0) - sin(gyaw0)*(gy1-gy0) AS ux,
  cos(eyaw0)*(ey1-ey0) - sin(eyaw0)*(ex1-ex0) - cos(gyaw0)*(gy1-gy0) + sin(gyaw0)*(gx1-gx0) AS uy,
  abs({wrap('(eyaw1-eyaw0)-(gyaw1-gyaw0)')}) AS rotation FROM k),
seg AS (SELECT *, sqrt(ux*ux+uy*uy) AS translation FROM e)"""
    m = ", ".join(rot_columns_suffixed(s, n) for s in "eg" for n in (0, 1))
    rel = {
        s: {(i, j): "(" + " + ".join(f"{s}{n}0{i}*{s}{n}1{j}" for n in range(3)) + ")" for i in range(3) for j in range(3)}
        for s in "eg"
    }
    # Entries named <side><row><pose><col>.
    trace = " + ".join(f"{rel['e'][k]}*{rel['g'][k]}" for k in rel["e"])
    shift = {
        s: [" + ".join(f"{s}{n}0{i}*({s}{a}1-{s}{a}0)" for n, a in enumerate("xyz")) for i in range(3)] for s in "eg"
    }
    return base + f"""
mm AS (SELECT *, {m} FROM k),
e AS (SELECT *, {', '.join(f"({shift['g'][i]}) - ({shift['e'][i]}) AS u{i}" for i in range(3))},
  acos(least(1e0, greatest(-1e0, (({trace}) - 1) / 2))) AS rotation FROM mm),
seg AS (SELECT *, sqrt(u0*u0+u1*u1+u2*u2) AS translation FROM e)"""


def rot_columns_suffixed(s: str, n: int) -> str:
    entries = rot(s)
    out = []
    for key, e in entries.items():
        for a in ("roll", "pitch", "yaw"):
            e = e.replace(f"({s}{a})", f"({s}{a}{n})")
        out.append(f"{e} AS {s}{key[0]}{n}{key[1]}")
    return ", ".join(out)


def unique_pairs(spark, sf, planar: bool = False):
    ch = V.time_chunks(spark, sf)
    g, e = V.planar_pair(spark, sf, ch) if planar else (V.gt(spark, sf, ch), V.est(spark, sf, ch))
    p = association.associate_unique(e, g, GAP, chunks=ch)
    return ch, p if ch.whole else cut(p)


_SEG_OUT = (
    f"SELECT drive, length_m, first_rn, last_rn, {rs('d0', 'd1', digits=3)}, {r('100*translation/length_m', 'translation_percent', 3)}, "
    f"{r('degrees(rotation/length_m)*100', 'rotation_deg_per_100m', 3)} FROM seg"
)


def _seg_columns(s: DataFrame) -> DataFrame:
    out = s.select(
        "drive", "length_m", "first_rn", "last_rn", F.col("distance_start").alias("d0"), F.col("distance_end").alias("d1"),
        "translation_percent", "rotation_deg_per_100m",
    )
    return rounded(out, 3)


@query("kitti_segments_se2", f"WITH {kitti_sql('se2')} {_SEG_OUT}")
def kitti_segments_se2(spark, sf):
    ch, p = unique_pairs(spark, sf, planar=True)
    return _seg_columns(metrics.kitti_segments(p, "se2", chunks=ch))


@query("kitti_segments_se3", f"WITH {kitti_sql('se3')} {_SEG_OUT}")
def kitti_segments_se3(spark, sf):
    ch, p = unique_pairs(spark, sf)
    return _seg_columns(metrics.kitti_segments(p, "se3", chunks=ch))


_LENGTHS = "(SELECT unnest([100e0,200e0,300e0,400e0,500e0,600e0,700e0,800e0]) AS length_m)"


@query(
    "kitti_by_length",
    f"WITH {kitti_sql('se3')}, g AS (SELECT drive, length_m, 100*avg(translation/length_m) AS t, degrees(avg(rotation/length_m))*100 AS q, count(*) AS n FROM seg GROUP BY ALL) "
    f"SELECT d.drive, l.length_m, {r('t', 'translation_percent')}, {r('q', 'rotation_deg_per_100m')}, coalesce(n, 0) AS num_segments "
    f"FROM (SELECT DISTINCT drive FROM uniq) d CROSS JOIN {_LENGTHS} l LEFT JOIN g ON g.drive = d.drive AND g.length_m = l.length_m",
)
def kitti_by_length(spark, sf):
    ch, p = unique_pairs(spark, sf)
    return rounded(metrics.kitti_by_length(metrics.kitti_segments(p, "se3", chunks=ch), p))


@query(
    "kitti_pooled",
    f"WITH {kitti_sql('se2')} SELECT drive, {r('100*avg(translation/length_m)', 'pooled_translation_percent')}, "
    f"{r('degrees(avg(rotation/length_m))*100', 'pooled_rotation_deg_per_100m')}, count(*) AS num_segments FROM seg GROUP BY drive",
)
def kitti_pooled(spark, sf):
    ch, p = unique_pairs(spark, sf, planar=True)
    return rounded(metrics.kitti_pooled(metrics.kitti_segments(p, "se2", chunks=ch)))


@query(
    "kitti_rollup",
    f"WITH {kitti_sql('se3')} SELECT drive, length_m, {r('100*avg(translation/length_m)', 'translation_percent')}, "
    f"{r('degrees(avg(rotation/length_m))*100', 'rotation_deg_per_100m')}, count(*) AS num_segments FROM seg GROUP BY GROUPING SETS ((drive, length_m), (drive))",
)
def kitti_rollup(spark, sf):
    ch, p = unique_pairs(spark, sf)
    return rounded(metrics.kitti_rollup(metrics.kitti_segments(p, "se3", chunks=ch)))


_LEGACY = UNIQUE + f""",
lagged AS (SELECT *, lag(gx) OVER w AS bx, lag(gy) OVER w AS b_y, row_number() OVER w AS rn FROM uniq WINDOW w AS (PARTITION BY drive ORDER BY stamp, gt_idx)),
dist AS (SELECT *, round(sum(coalesce(sqrt((gx-bx)**2 + (gy-b_y)**2), 0e0)) OVER (PARTITION BY drive ORDER BY rn ROWS UNBOUNDED PRECEDING), 9) AS d FROM lagged),
starts AS (SELECT *, d + l.length_m AS target FROM dist, {_LENGTHS} l),
ends AS (SELECT drive, d, min(rn) AS rn FROM dist GROUP BY drive, d),
hit AS (
  SELECT a.*, n.rn AS n_rn, n.d AS n_d, p.d AS p_d FROM starts a ASOF JOIN ends n ON a.drive = n.drive AND a.target <= n.d
  ASOF LEFT JOIN ends p ON a.drive = p.drive AND a.target > p.d),
chosen AS (SELECT *, CASE WHEN p_d IS NOT NULL AND target - p_d < n_d - target THEN n_rn - 1 ELSE n_rn END AS j FROM hit),
k AS (SELECT a.drive, a.length_m, a.rn AS first_rn, b.rn AS last_rn, b.d - a.d AS travelled,
  {', '.join(f'a.{s}{c} AS {s}{c}0, b.{s}{c} AS {s}{c}1' for s in 'eg' for c in ('x', 'y', 'yaw'))}
  FROM chosen a JOIN dist b ON b.drive = a.drive AND b.rn = a.j WHERE b.rn > a.rn AND b.d - a.d >= 0.5e0 * a.length_m),
e AS (SELECT *, cos(eyaw0)*(ex1-ex0) + sin(eyaw0)*(ey1-ey0) - cos(gyaw0)*(gx1-gx0) - sin(gyaw0)*(gy1-gy0) AS ux,
  cos(eyaw0)*(ey1-ey0) - sin(eyaw0)*(ex1-ex0) - cos(gyaw0)*(gy1-gy0) + sin(gyaw0)*(gx1-gx0) AS uy,
  abs({wrap('(eyaw1-eyaw0)-(gyaw1-gyaw0)')}) AS rotation FROM k)"""


@query(
    "kitti_segments_legacy",
    f"WITH {_LEGACY} SELECT drive, length_m, first_rn, last_rn, {r('travelled', 'travelled_m', 3)}, "
    f"{r('100*sqrt(ux*ux+uy*uy)/travelled', 'translation_percent', 3)}, {r('degrees(rotation)*100/travelled', 'rotation_deg_per_100m', 3)} FROM e",
)
def kitti_segments_legacy(spark, sf):
    ch, p = unique_pairs(spark, sf, planar=True)
    return rounded(metrics.kitti_segments_legacy(p, chunks=ch), 3)


# --- sections ------------------------------------------------------------------------------------------


def both_pairs(e, g, ch):
    """Pairs of the odometry (nearest, one to one) and of the filter (interpolated at the truth's stamps)."""
    split = association.interpolate_split(e, g, SPLIT_GAP, chunks=ch).withColumn("stamp", F.col("gt_stamp"))
    return (ODOM, association.associate_unique(e, g, GAP, chunks=ch)), (FILTER, split)


def tagged_pairs(spark, sf):
    """Truth and the pairs of both estimators in one table; errors and segments of a query read it."""
    ch = V.time_chunks(spark, sf)
    g, e = V.planar_pair(spark, sf, ch)
    out = None
    for name, pairs in both_pairs(e, g, ch):
        one = pairs.select("drive", F.lit(name).alias("estimator"), *evaluate.PAIR)
        out = one if out is None else out.unionByName(one)
    return ch, g, stored(out)


def two_estimators(spark, sf):
    """Per-pose errors of both estimators after planar alignment, with route distance."""
    ch, g, pairs = tagged_pairs(spark, sf)
    return ch, errors_of(g, pairs, ch)


def errors_of(g, pairs, ch):
    route = metrics.cumulative_distance(g, chunks=ch).select(
        "drive", F.col("stamp").alias("gt_stamp"), F.col("idx").alias("gt_idx"), "distance"
    )
    owner = ("drive", "estimator")
    al = align.apply_se2(pairs, align.align_rigid_se2(pairs, owner), owner)
    err = metrics.pose_errors(al).select(
        "drive", "estimator", "gt_stamp", "gt_idx", "stamp", "idx", "est_idx", "horiz", F.col("dz").alias("vert"), F.degrees("dyaw").alias("yaw_deg")
    )
    out = err.join(route, ["drive", "gt_stamp", "gt_idx"]).drop("gt_stamp", "gt_idx")
    return out if ch.whole else stored(out)


_TWO = f"""WITH {UNIQUE},
rt AS (SELECT drive, gt_idx, sum(coalesce(s, 0e0)) OVER (PARTITION BY drive ORDER BY stamp, gt_idx ROWS UNBOUNDED PRECEDING) AS distance FROM (
  SELECT drive, idx AS gt_idx, stamp, sqrt((x - lag(x) OVER w)**2 + (y - lag(y) OVER w)**2 + (z - lag(z) OVER w)**2) AS s
  FROM gt WINDOW w AS (PARTITION BY drive ORDER BY stamp, idx))),
{SPLIT[len(GT) + 2:]},
both_e AS (
  SELECT '{ODOM}' AS estimator, drive, stamp, gt_idx, ex, ey, ez, eyaw, gx, gy, gz, gyaw FROM uniq UNION ALL
  SELECT '{FILTER}', s.drive, g.stamp, s.gt_idx, s.x, s.y, s.z, s.yaw, g.x, g.y, g.z, g.yaw FROM split s JOIN gt g ON g.drive = s.drive AND g.idx = s.gt_idx),
fa AS (SELECT estimator, drive, atan2(covar_pop(ex, gy) - covar_pop(ey, gx), covar_pop(ex, gx) + covar_pop(ey, gy)) AS th,
  avg(ex) AS mex, avg(ey) AS mey, avg(gx) AS mgx, avg(gy) AS mgy FROM both_e GROUP BY ALL),
er AS (SELECT b.estimator, b.drive, b.stamp, b.gt_idx, sqrt((cos(th)*(ex-mex) - sin(th)*(ey-mey) + mgx - gx)**2 + (sin(th)*(ex-mex) + cos(th)*(ey-mey) + mgy - gy)**2) AS horiz,
  ez - gz AS vert, degrees({wrap('eyaw + th - gyaw')}) AS yaw_deg, rt.distance
  FROM both_e b JOIN fa ON fa.drive = b.drive AND fa.estimator = b.estimator JOIN rt ON rt.drive = b.drive AND rt.gt_idx = b.gt_idx),
th AS (SELECT estimator, drive, greatest(5e0, quantile_cont(horiz, 0.9)) AS threshold_m FROM er GROUP BY ALL),
isl AS (SELECT er.*, threshold_m, horiz >= threshold_m AS above,
  sum(CASE WHEN horiz >= threshold_m THEN 0 ELSE 1 END) OVER (PARTITION BY er.estimator, er.drive ORDER BY stamp, gt_idx ROWS UNBOUNDED PRECEDING) AS island
  FROM er JOIN th ON th.drive = er.drive AND th.estimator = er.estimator),
spans AS (SELECT estimator, drive, min(stamp) AS t0, max(stamp) AS t1, min(distance) AS d0, max(distance) AS d1, count(*) AS n, any_value(threshold_m) AS threshold_m
  FROM isl WHERE above GROUP BY estimator, drive, island HAVING max(distance) - min(distance) >= 5e0)"""


@query("section_threshold", f"{_TWO} SELECT estimator, drive, {r('threshold_m', 'threshold_m')} FROM th")
def section_threshold(spark, sf):
    ch, e = two_estimators(spark, sf)
    return rounded(sections.section_threshold(e, keys=("drive", "estimator"), chunks=ch))


def with_id(s):
    """Sections named by estimator and exact start. Those that start at one stamp share a name, and so their figures."""
    return s.withColumn("section_id", F.concat_ws(":", "estimator", F.col("stamp_start").cast("string")))


def by_start(figures, s):
    """Figures per `section_id` with the estimator and the start it stands for: one row per start."""
    return figures.join(s.select("drive", "section_id", "estimator", "stamp_start").distinct(), ["drive", "section_id"])


def spans(spark, sf):
    ch, e = two_estimators(spark, sf)
    e = e.persist()
    owner = ("drive", "estimator")
    th = sections.section_threshold(e, keys=owner, chunks=ch)
    s = sections.error_spans(e, th, 5.0, keys=owner, chunks=ch)
    return ch, e, with_id(s)


@query("error_spans", f"{_TWO} SELECT estimator, drive, {r('t0', 'stamp_start', 3)}, {r('t1', 'stamp_end', 3)}, {rs('d0', 'd1', digits=3)}, n, {r('threshold_m', 'threshold_m')} FROM spans")
def error_spans(spark, sf):
    _, _, s = spans(spark, sf)
    out = s.select(
        "estimator", "drive", "stamp_start", "stamp_end", F.col("distance_start").alias("d0"), F.col("distance_end").alias("d1"), "n", "threshold_m"
    )
    return rounded(out, 3, threshold_m=4)


def _by_source_order(sql: str) -> str:
    """`sql` in which an as-of join takes, of rows with equal stamps, the last before and the first after by `idx`, as the operators do."""
    edges = "".join(
        f",\n{t}_{name} AS (SELECT * FROM {t} QUALIFY row_number() OVER (PARTITION BY drive, stamp ORDER BY idx{way}) = 1)"
        for t in ("gt", "est") for name, way in (("first", ""), ("last", " DESC"))
    )
    for table, alias, end in (("gt", "p", "last"), ("gt", "n", "first"), ("est", "l", "last"), ("est", "n", "first")):
        sql = sql.replace(f"ASOF LEFT JOIN {table} {alias} ON", f"ASOF LEFT JOIN {table}_{end} {alias} ON")
    return sql.replace(GT, GT + edges, 1)


@query(
    "section_overlap",
    f"{_by_source_order(_TWO)} SELECT s.estimator, s.drive, {r('s.t0', 'stamp_start', 3)}, e.estimator AS other, count(*) AS n, {r('avg(e.horiz)', 'horiz_mean_m')} "
    "FROM spans s JOIN er e ON e.drive = s.drive AND e.stamp BETWEEN s.t0 AND s.t1 GROUP BY s.estimator, s.drive, s.t0, e.estimator",
)
def section_overlap(spark, sf):
    _, e, s = spans(spark, sf)
    other = e.select("drive", F.col("estimator").alias("other"), "stamp", "horiz")
    hit = sections.section_overlap(s.select("drive", "estimator", "stamp_start", "stamp_end"), other, bucket_s=3600.0)
    return rounded(
        hit.groupBy("estimator", "drive", "stamp_start", "other").agg(F.count(F.lit(1)).alias("n"), F.avg("horiz").alias("horiz_mean_m")),
        4, stamp_start=3,
    )


_SUMMARY = f""",
sm AS (SELECT s.estimator, s.drive, s.t0, any_value(s.threshold_m) AS threshold_m,
  sqrt(avg(CASE WHEN e.estimator = s.estimator THEN e.horiz**2 END)) AS horiz_rmse_m, max(CASE WHEN e.estimator = s.estimator THEN e.horiz END) AS horiz_max_m,
  sqrt(avg(CASE WHEN e.estimator = s.estimator THEN e.vert**2 END)) AS vert_rmse_m, sqrt(avg(CASE WHEN e.estimator = s.estimator THEN e.yaw_deg**2 END)) AS yaw_rmse_deg,
  avg(CASE WHEN e.estimator = '{ODOM}' THEN e.horiz END) AS odom_horiz_mean_m, avg(CASE WHEN e.estimator = '{FILTER}' THEN e.horiz END) AS ekf_horiz_mean_m
  FROM spans s JOIN er e ON e.drive = s.drive AND e.stamp BETWEEN s.t0 AND s.t1 GROUP BY s.estimator, s.drive, s.t0)"""
_SUMMARY_COLS = ("horiz_rmse_m", "horiz_max_m", "vert_rmse_m", "yaw_rmse_deg", "odom_horiz_mean_m", "ekf_horiz_mean_m")


@query("section_summary", f"{_TWO}{_SUMMARY} SELECT estimator, drive, {r('t0', 'stamp_start', 3)}, {rs(*_SUMMARY_COLS)} FROM sm")
def section_summary(spark, sf):
    _, e, s = spans(spark, sf)
    out = by_start(sections.section_summary(s, e, bucket_s=3600.0), s)
    return rounded(out.select("estimator", "drive", "stamp_start", *_SUMMARY_COLS), 4, stamp_start=3)


# Filter signals on event stamps, in both engines.
def signals(spark, sf):
    i = F.col("idx")
    null_at = lambda k, c: F.when(i % 11 == k, F.lit(None)).otherwise(c).cast("double")
    return V.events(spark, sf).select(
        "drive", "idx", F.col("t").alias("stamp"), (0.5 * F.sin(i)).alias("err_x"), (0.5 * F.cos(i)).alias("err_y"),
        (0.1 * F.sin(i * 3)).alias("err_z"), null_at(3, 0.05 * F.sin(i * 2)).alias("err_yaw"),
        null_at(4, 0.001 * (i % 17)).alias("bg_x"), (0.001 * (i % 13)).alias("bg_y"), (0.001 * (i % 7)).alias("bg_z"),
        (0.01 * (i % 5)).alias("ba_x"), null_at(5, 0.01 * (i % 19)).alias("ba_y"), (0.01 * (i % 3)).alias("ba_z"),
        *[F.lit(0.0).alias(f"imu_{k}{a}") for k in "aw" for a in "xyz"],
        (F.col("value") * 0.1).alias("body_vx"), (F.col("value") * 0.02).alias("body_vy"), F.lit(0.0).alias("body_vz"),
        (F.col("value") * 0.001).alias("odom_age"), i.cast("double").alias("pose_applied"),
    )


_SIGNALS = """,
sg AS (SELECT drive, idx, stamp, 0.5e0*sin(idx) AS err_x, 0.5e0*cos(idx) AS err_y, CASE WHEN idx % 11 = 3 THEN NULL ELSE 0.05e0*sin(idx*2) END AS err_yaw,
  CASE WHEN idx % 11 = 4 THEN NULL ELSE 0.001e0*(idx % 17) END AS bg_x, 0.001e0*(idx % 13) AS bg_y, 0.001e0*(idx % 7) AS bg_z,
  0.01e0*(idx % 5) AS ba_x, CASE WHEN idx % 11 = 5 THEN NULL ELSE 0.01e0*(idx % 19) END AS ba_y, 0.01e0*(idx % 3) AS ba_z,
  value*0.1e0 AS bvx, value*0.02e0 AS bvy, value*0.001e0 AS age FROM ev),
hs AS (SELECT s.estimator, s.drive, s.t0, g.* EXCLUDE (drive, stamp), {'a': t.stamp, 'b': p.gt_idx} AS stamp
  FROM spans s JOIN gt t ON t.drive = s.drive AND t.stamp BETWEEN s.t0 AND s.t1 JOIN split p ON p.drive = t.drive AND p.gt_idx = t.idx
  JOIN sg g ON g.drive = p.drive AND g.idx = p.est_idx),
st AS (SELECT estimator, drive, t0, avg(sqrt(err_x**2 + err_y**2)) AS residual_xy_mean_m, degrees(sqrt(avg(err_yaw**2))) AS filter_yaw_rmse_deg,
  quantile_cont(age, 0.95) AS odom_age_p95_s, avg(sqrt(bvx**2 + bvy**2)) AS speed_mean_mps,
  CASE WHEN count(bg_x) >= 2 THEN sqrt((arg_max(bg_x, stamp) FILTER (bg_x IS NOT NULL) - arg_min(bg_x, stamp) FILTER (bg_x IS NOT NULL))**2
    + (arg_max(bg_y, stamp) FILTER (bg_x IS NOT NULL) - arg_min(bg_y, stamp) FILTER (bg_x IS NOT NULL))**2
    + (arg_max(bg_z, stamp) FILTER (bg_x IS NOT NULL) - arg_min(bg_z, stamp) FILTER (bg_x IS NOT NULL))**2) END AS gyro_bias_delta,
  CASE WHEN count(ba_y) >= 2 THEN sqrt((arg_max(ba_x, stamp) FILTER (ba_y IS NOT NULL) - arg_min(ba_x, stamp) FILTER (ba_y IS NOT NULL))**2
    + (arg_max(ba_y, stamp) FILTER (ba_y IS NOT NULL) - arg_min(ba_y, stamp) FILTER (ba_y IS NOT NULL))**2
    + (arg_max(ba_z, stamp) FILTER (ba_y IS NOT NULL) - arg_min(ba_z, stamp) FILTER (ba_y IS NOT NULL))**2) END AS accel_bias_delta
  FROM hs GROUP BY estimator, drive, t0)"""
_STATS = ("residual_xy_mean_m", "filter_yaw_rmse_deg", "odom_age_p95_s", "speed_mean_mps", "gyro_bias_delta", "accel_bias_delta")


@query("filter_stats", f"{_TWO}{_SIGNALS} SELECT estimator, drive, {r('t0', 'stamp_start', 3)}, {rs(*_STATS)} FROM st")
def filter_stats(spark, sf):
    ch, e, s = spans(spark, sf)
    out = by_start(sections.filter_stats(s, signals(spark, sf), e.filter(F.col("estimator") == FILTER), bucket_s=3600.0, chunks=ch), s)
    return rounded(out.select("estimator", "drive", "stamp_start", *_STATS), 4, stamp_start=3)


_BLAME = f"""CASE WHEN o IS NULL OR k IS NULL OR res IS NULL OR far IS NULL THEN 'unknown'
 WHEN o >= far AND res < greatest(1e0, 0.35e0 * greatest(o, k, 0e0)) THEN '{ODOM}_led'
 WHEN k >= far AND o < far THEN 'ekf_diverged' WHEN o >= far AND k >= far THEN 'both'
 WHEN k >= far THEN 'ekf_diverged' WHEN o >= far THEN '{ODOM}_led' ELSE 'within_threshold' END"""


@query(
    "classify_error_source",
    "WITH v AS (SELECT event_id, CASE WHEN event_id % 23 = 0 THEN NULL ELSE value / 5 END AS o, (event_id * 7 % 101) / 4e0 AS k, value / 20 AS res, 5e0 + event_id % 6 AS far FROM events) "
    f"SELECT event_id, {_BLAME} AS tag FROM v",
)
def classify_error_source(spark, sf):
    i, v = F.col("idx"), F.col("value")
    e = V.events(spark, sf)
    leader = F.when(i % 23 == 0, F.lit(None)).otherwise(v / 5.0)
    tag = sections.classify_error_source(leader, i * 7 % 101 / 4.0, v / 20.0, 5.0 + i % 6)
    return e.select(i.alias("event_id"), tag.alias("tag"))


@query(
    "build_sections_runs",
    f"{_TWO}{_SUMMARY}{_SIGNALS}, f AS (SELECT s.estimator, s.drive, s.t0, s.t1, s.d0, s.d1, sm.odom_horiz_mean_m AS o, sm.ekf_horiz_mean_m AS k, st.residual_xy_mean_m AS res, s.threshold_m AS far, "
    f"sm.horiz_rmse_m, st.speed_mean_mps FROM spans s JOIN sm ON sm.estimator = s.estimator AND sm.drive = s.drive AND sm.t0 = s.t0 LEFT JOIN st ON st.estimator = s.estimator AND st.drive = s.drive AND st.t0 = s.t0) "
    f"SELECT estimator, drive, {r('t0', 'stamp_gps_start', 3)}, {r('t1', 'stamp_gps_end', 3)}, {r('d0', 'distance_start_m', 3)}, {r('d1', 'distance_end_m', 3)}, {_BLAME} AS tag, "
    f"{r('horiz_rmse_m', 'horiz_rmse_m', 3)}, {r('speed_mean_mps', 'speed_mean_mps', 3)} FROM f",
)
def build_sections_runs(spark, sf):
    out = _sections(spark, sf).filter("kind = 'ate_run'")
    return rounded(
        out.select("estimator", "drive", "stamp_gps_start", "stamp_gps_end", "distance_start_m", "distance_end_m", "tag", "horiz_rmse_m", "speed_mean_mps"), 3
    )


def _sections(spark, sf):
    """Runs and worst 100 m segments of both estimators, the segments in both spaces."""
    ch, g, pairs = tagged_pairs(spark, sf)
    segs = None
    for space in metrics.SPACES:
        one = metrics.kitti_segments(pairs, space, (100.0,), keys=("drive", "estimator"), chunks=ch)
        segs = one if segs is None else segs.unionByName(one)
    e = errors_of(g, pairs, ch)
    return evaluate.build_sections(e.persist(), segs.persist(), signals(spark, sf), min_length_m=5.0, chunks=ch, bucket_s=3600.0)


@query("section_table")
def section_table(spark, sf):
    return rounded(sinks.null_non_finite(_sections(spark, sf)))


@query(
    "worst_segments",
    f"""WITH RECURSIVE {kitti_sql('se3')}, hundred AS (SELECT drive, first_rn, last_rn, 100 * translation / length_m AS bad FROM seg WHERE length_m = 100),
greedy(drive, rank, kept, best) AS (
  SELECT DISTINCT drive, 0, CAST([] AS STRUCT(f BIGINT, l BIGINT)[]), {{'bad': 0e0, 'f': 0::BIGINT, 'l': 0::BIGINT}} FROM hundred UNION ALL
  SELECT p.drive, p.rank + 1, list_append(p.kept, {{'f': -max({{'bad': s.bad, 'f': -s.first_rn, 'l': -s.last_rn}}).f, 'l': -max({{'bad': s.bad, 'f': -s.first_rn, 'l': -s.last_rn}}).l}}),
    max({{'bad': s.bad, 'f': -s.first_rn, 'l': -s.last_rn}})
  FROM greedy p JOIN hundred s ON s.drive = p.drive AND len(list_filter(p.kept, lambda k: s.first_rn <= k.l AND k.f <= s.last_rn)) = 0
  WHERE p.rank < 5 GROUP BY p.drive, p.rank, p.kept)
SELECT drive, 'se3' AS space, rank, -best.f AS first_rn, -best.l AS last_rn, {r('best.bad', 'translation_percent')} FROM greedy WHERE rank > 0""",
)
def worst_segments(spark, sf):
    ch, p = unique_pairs(spark, sf)
    segs = metrics.kitti_segments(p, "se3", (100.0,), chunks=ch).persist()
    return rounded(sections.worst_segments(segs, 5).select("drive", "space", "rank", "first_rn", "last_rn", "translation_percent"))


@query(
    "report_worst_runs",
    f"{_TWO} SELECT estimator, drive, row_number() OVER w AS rank, {r('t0', 'stamp_start', 3)}, {r('d1 - d0', 'span_m', 3)} FROM spans "
    "WINDOW w AS (PARTITION BY drive, estimator ORDER BY d1 - d0 DESC, t0) QUALIFY row_number() OVER w <= 5",
)
def report_worst_runs(spark, sf):
    _, _, s = spans(spark, sf)
    runs = s.select("drive", "estimator", "stamp_start", (F.col("distance_end") - F.col("distance_start")).alias("span_m")).persist()
    out = evaluate.report_top(runs, "span_m", 5, ("drive", "estimator"))
    return rounded(out.select("estimator", "drive", F.col("rank").cast("bigint").alias("rank"), "stamp_start", "span_m"), 3)


# --- whole evaluations and result tables ---------------------------------------------------------------


@query(
    "evaluate_planar",
    f"WITH {_RPE}, {FIT2}, {ERR2}, a AS (SELECT drive, sqrt(avg(horiz*horiz)) AS fit_rmse_xy_m, quantile_cont(horiz, 0.5) AS fit_median_xy_m, count(*) AS n, "
    "count(*) / (max(stamp) - min(stamp)) AS association_hz FROM errh GROUP BY drive), b AS (SELECT drive, sqrt(avg(trans*trans)) AS rpe_translation_rmse_m, count(*) AS rpe_num_pairs FROM ok GROUP BY drive) "
    f"SELECT drive, n, {r('association_hz', 'association_hz', 8)}, {rs('fit_rmse_xy_m', 'fit_median_xy_m', 'rpe_translation_rmse_m')}, rpe_num_pairs FROM a JOIN b USING (drive)",
)
def evaluate_planar(spark, sf):
    ch = V.time_chunks(spark, sf)
    g, e = V.planar_pair(spark, sf, ch)
    report, _ = evaluate.evaluate_planar(e, g, GAP, DELTA, chunks=ch, parts=("report",))
    out = report.select(
        "drive", "n", "association_hz", "fit_rmse_xy_m", "fit_median_xy_m", F.col("rpe_se2_translation_rmse_m").alias("rpe_translation_rmse_m"), "rpe_num_pairs"
    )
    return rounded(out, 4, association_hz=8)


@query(
    "evaluate_planar_kitti",
    f"WITH {_LEGACY.replace('FROM uniq', 'FROM pairs').replace('ORDER BY stamp, gt_idx', 'ORDER BY stamp, idx')}, g AS (SELECT drive, length_m, avg(100*sqrt(ux*ux+uy*uy)/travelled) AS t, avg(degrees(rotation)*100/travelled) AS q, count(*) AS n FROM e GROUP BY ALL) "
    f"SELECT d.drive, l.length_m, {r('t', 'translation_percent', 3)}, {r('q', 'rotation_deg_per_100m', 3)}, coalesce(n, 0) AS num_segments "
    f"FROM (SELECT DISTINCT drive FROM pairs) d CROSS JOIN {_LENGTHS} l LEFT JOIN g ON g.drive = d.drive AND g.length_m = l.length_m",
)
def evaluate_planar_kitti(spark, sf):
    ch = V.time_chunks(spark, sf)
    g, e = V.planar_pair(spark, sf, ch)
    _, kitti = evaluate.evaluate_planar(e, g, GAP, DELTA, chunks=ch, parts=("kitti",))
    return rounded(kitti, 3)


_POSE_SQL = (
    f"WITH {UNIQUE}, {FIT2.replace('FROM pairs', 'FROM uniq')}, rt AS (SELECT drive, gt_idx, sum(coalesce(s, 0e0)) OVER (PARTITION BY drive ORDER BY stamp, gt_idx ROWS UNBOUNDED PRECEDING) AS distance FROM ("
    "SELECT drive, idx AS gt_idx, stamp, sqrt((x - lag(x) OVER w)**2 + (y - lag(y) OVER w)**2 + (z - lag(z) OVER w)**2) AS s FROM gt WINDOW w AS (PARTITION BY drive ORDER BY stamp, idx))), "
    "a AS (SELECT u.*, f.th, cos(th)*ex - sin(th)*ey + tx AS sx, sin(th)*ex + cos(th)*ey + ty AS sy, distance FROM uniq u JOIN fit2 f USING (drive) JOIN rt ON rt.drive = u.drive AND rt.gt_idx = u.gt_idx) "
    f"SELECT drive, '{ODOM}' AS estimator, {r('gt_stamp', 'stamp_gps', 3)}, {r('gt_stamp - 1000', 'stamp_bag', 3)}, {r('distance', 'distance_m', 3)}, {r('gx', 'gt_x', 3)}, {r('gz', 'gt_z', 3)}, "
    f"{r('groll', 'gt_roll')}, {r('gpitch', 'gt_pitch')}, {r('epitch', 'est_pitch')}, {r('sx', 'se2_x', 3)}, {r('sy', 'se2_y', 3)}, {r('sqrt((sx-gx)**2+(sy-gy)**2)', 'err_horiz_se2_m', 3)}, "
    f"{r('degrees(' + wrap('eyaw + th - gyaw') + ')', 'err_yaw_se2_deg', 3)}, {r('ez - gz', 'err_vert_raw_m', 3)}, {r('degrees(' + wrap('eroll - groll') + ')', 'err_roll_deg', 3)}, {r('degrees(' + wrap('epitch - gpitch') + ')', 'err_pitch_deg', 3)}, CAST(NULL AS DOUBLE) AS bg_x FROM a"
)


@query("pose_table_columns", _POSE_SQL)
def pose_table_columns(spark, sf):
    ch = V.time_chunks(spark, sf)
    g, e = V.gt(spark, sf, ch), V.est(spark, sf, ch)
    pairs = association.associate_unique(e, g, GAP, chunks=ch).persist()
    route = metrics.cumulative_distance(g, chunks=ch).select("drive", F.col("stamp").alias("gt_stamp"), F.col("idx").alias("gt_idx"), "distance")
    errors = evaluate.compare_pairs(pairs, route, DELTA, chunks=ch, parts=("errors",))["errors"]
    # Yaw about the vertical differs from the aligned quaternion's yaw b_y rounding only; tilt stays small here.
    t = sinks.pose_table(errors.withColumn("estimator", F.lit(ODOM)), signals(spark, sf), 1000.0)
    out = t.select(
        "drive", "estimator", "stamp_gps", "stamp_bag", "distance_m", "gt_x", "gt_z", "gt_roll", "gt_pitch", "est_pitch", "se2_x", "se2_y",
        "err_horiz_se2_m", "err_yaw_se2_deg", "err_vert_raw_m", "err_roll_deg", "err_pitch_deg", "bg_x",
    )
    return rounded(out, 3, gt_roll=4, gt_pitch=4, est_pitch=4)


@query(
    "segment_table",
    f"WITH {kitti_sql('se3')} SELECT drive, '{ODOM}' AS estimator, 'se3' AS space, length_m, {r('d0', 'distance_start_m', 3)}, {r('d1', 'distance_end_m', 3)}, {r('translation', 'translation_m', 3)}, "
    f"{r('100*translation/length_m', 'translation_percent', 3)}, {r('degrees(rotation)', 'rotation_deg', 3)}, {r('degrees(rotation/length_m)*100', 'rotation_deg_per_100m', 3)} FROM seg",
)
def segment_table(spark, sf):
    ch, p = unique_pairs(spark, sf)
    t = sinks.segment_table(metrics.kitti_segments(p, "se3", chunks=ch).withColumn("estimator", F.lit(ODOM)))
    return rounded(t.drop("stamp_bag_start", "stamp_bag_end", "stamp_gps_start", "stamp_gps_end"), 3)


@query(
    "concat_estimators",
    f"{_TWO} SELECT estimator, drive, count(*) AS n, {r('sum(horiz)', 'horiz_sum', 3)} FROM er GROUP BY estimator, drive",
)
def concat_estimators(spark, sf):
    _, e = two_estimators(spark, sf)
    return rounded(e.groupBy("estimator", "drive").agg(F.count(F.lit(1)).alias("n"), F.sum("horiz").alias("horiz_sum")), 3)


@query(
    "plot_kitti",
    f"WITH {kitti_sql('se3')} SELECT drive, 'se3' AS space, length_m, {r('100*avg(translation/length_m)', 'translation_percent')}, {r('degrees(avg(rotation/length_m))*100', 'rotation_deg_per_100m')} FROM seg GROUP BY drive, length_m",
)
def plot_kitti(spark, sf):
    ch, p = unique_pairs(spark, sf)
    k = metrics.kitti_rollup(metrics.kitti_segments(p, "se3", chunks=ch), ["drive", "space"])
    return rounded(sinks.kitti_plot(k))


@query(
    "lock_map_alignment",
    GT.join(["WITH ", ""]) + f""", c AS (SELECT g.drive, g.idx, g.stamp, g.x AS gx, g.y AS gy, g.z AS gz, g.yaw AS gyaw, l.stamp AS ls, l.idx AS li, n.stamp AS ns, n.idx AS ni
  FROM gt g ASOF LEFT JOIN est l ON g.drive = l.drive AND g.stamp > l.stamp ASOF LEFT JOIN est n ON g.drive = n.drive AND g.stamp <= n.stamp),
h AS (SELECT *, CASE WHEN ls IS NOT NULL AND (ns IS NULL OR stamp - ls <= ns - stamp) THEN li ELSE ni END AS hi FROM c),
f AS (SELECT h.*, e.x AS ex, e.y AS ey, e.z AS ez, {wrap('h.gyaw - e.yaw')} AS th FROM h JOIN est e ON e.drive = h.drive AND e.idx = h.hi WHERE abs(e.stamp - h.stamp) <= 25e0
  QUALIFY row_number() OVER (PARTITION BY h.drive ORDER BY h.stamp, h.idx) = 1),
a AS (SELECT e.drive, e.idx, f.stamp AS locked, gx + cos(th)*(e.x - ex) - sin(th)*(e.y - ey) AS x, gy + sin(th)*(e.x - ex) + cos(th)*(e.y - ey) AS y, gz + e.z - ez AS z FROM est e JOIN f ON f.drive = e.drive)
SELECT drive, idx, {r('locked', 'locked_at', 3)}, {rs('x', 'y', 'z', digits=3)} FROM a""",
)
def lock_map_alignment(spark, sf):
    ch = V.time_chunks(spark, sf)
    g, e = V.planar_pair(spark, sf, ch)
    lock = points.lock_map_alignment(g, e, 25.0, chunks=ch)
    out = points.apply_map_alignment(e, lock).join(lock.select("drive", "locked_at"), "drive")
    return rounded(out.select("drive", "idx", "locked_at", "x", "y", "z"), 3)


@query(
    "trajectory_window",
    f"""WITH {GT}, n AS (SELECT drive, idx, stamp, row_number() OVER (PARTITION BY drive ORDER BY stamp, idx) AS rn, count(*) OVER (PARTITION BY drive) AS total FROM gt),
w AS (SELECT drive, idx AS range_id, stamp + 7e0 AS f, stamp + 4007e0 AS t FROM gt),
q AS (SELECT w.drive, w.range_id, p.rn AS pr, a.rn AS ar, b.rn AS br, (SELECT any_value(total) FROM n WHERE n.drive = w.drive) AS total
  FROM w ASOF LEFT JOIN n p ON w.drive = p.drive AND w.f > p.stamp ASOF LEFT JOIN n a ON w.drive = a.drive AND w.f <= a.stamp ASOF LEFT JOIN n b ON w.drive = b.drive AND w.t <= b.stamp),
l AS (SELECT *, coalesce(pr, ar, total) AS lo, greatest(coalesce(br, total), coalesce(pr, ar, total)) AS hi FROM q),
m AS (SELECT drive, range_id, CASE WHEN lo = hi AND hi = total THEN greatest(lo - 1, 1) ELSE lo END AS lo, CASE WHEN lo = hi AND hi < total THEN hi + 1 ELSE hi END AS hi FROM l)
SELECT drive, range_id, lo AS first_rn, hi AS last_rn, hi - lo + 1 AS n FROM m""",
)
def trajectory_window(spark, sf):
    ch, g, _ = data(spark, sf)
    ranges = g.select("drive", F.col("idx").alias("range_id"), (F.col("stamp") + 7.0).alias("from_stamp"), (F.col("stamp") + 4007.0).alias("to_stamp"))
    out = points.trajectory_window(g, ranges, chunks=ch)  # every row of every range; what it holds is read off the rows
    return out.groupBy("drive", "range_id").agg(F.min("rn").alias("first_rn"), F.max("rn").alias("last_rn"), F.count(F.lit(1)).alias("n"))


# --- scalar functions ----------------------------------------------------------------------------------


@query(
    "fn_angles",
    f"WITH {GT} SELECT drive, idx, {r(wrap('yaw * 3'), 'wrapped')}, {r('sin(yaw)', 'yaw_sin')}, {r('roll', 'roll')}, {r('pitch', 'pitch')}, "
    f"{r('acos(least(1e0, (' + ' + '.join(rot('')[k] for k in ('00', '11', '22')) + ' - 1) / 2))', 'angle', 3)} FROM gt",
)
def fn_angles(spark, sf):
    ch = V.time_chunks(spark, sf)
    raw = V.raw_route(spark, sf, ch)
    q = rigid.quat_from_rpy(F.col("roll"), F.col("pitch"), F.col("yaw"))
    raw = raw.withColumns({f"q{n}": c for n, c in zip("wxyz", q, strict=True)})
    q = rigid.Quat(*[F.col(f"q{n}") for n in "wxyz"])
    roll, pitch, yaw = rigid.rpy_of(q)
    out = raw.select(
        "drive", "idx", rigid.wrap_angle(F.col("yaw") * 3).alias("wrapped"), F.sin(yaw).alias("yaw_sin"), roll.alias("roll"),
        pitch.alias("pitch"), rigid.rotation_angle(q).alias("angle"),
    )
    return rounded(out, 4, angle=3)


_REL = rot("")


@query(
    "fn_apply_transform",
    f"WITH {GT}, m AS (SELECT *, {rot_columns('', 'r')} FROM gt) SELECT drive, idx, {r('r00*1.5e0 + r01*(-2e0) + r02*0.5e0 + x', 'px', 3)}, {r('r10*1.5e0 + r11*(-2e0) + r12*0.5e0 + y', 'py', 3)}, "
    f"{r('r20*1.5e0 + r21*(-2e0) + r22*0.5e0 + z', 'pz', 3)}, {r('r00*(1-x) + r10*(2-y) + r20*(3-z)', 'bx', 3)}, {r('r01*(1-x) + r11*(2-y) + r21*(3-z)', 'by', 3)}, {r('r02*(1-x) + r12*(2-y) + r22*(3-z)', 'bz', 3)} FROM m",
)
def fn_apply_transform(spark, sf):
    ch, g, _ = data(spark, sf)
    p = rigid.pose()
    w, b = p.apply(rigid.lit_vec(1.5, -2.0, 0.5)), p.inverse().apply(rigid.lit_vec(1.0, 2.0, 3.0))
    return rounded(
        g.select("drive", "idx", *[c.alias(f"p{a}") for a, c in zip("xyz", w, strict=True)], *[c.alias(f"b{a}") for a, c in zip("xyz", b, strict=True)]), 3
    )


@query("fn_exp_log")
def fn_exp_log(spark, sf):
    """exp(log) round trip of every relative motion: the residual is zero to rounding."""
    ch, g, _ = data(spark, sf)
    m = metrics.relative_motion(g, chunks=ch).filter(F.col("motion").isNotNull())
    m = rigid.stage_se3_exp(rigid.stage_se3_log(m, rigid.pose("motion."), "xi"), rigid.twist("xi."), "again")
    d = rigid.pose("motion.").between(rigid.pose("again."))
    m = m.withColumn("res", d.t.norm() + rigid.rotation_angle(d.q))
    return rounded(m.select("drive", "idx", "res"), 6)


@query(
    "planar_projection",
    f"WITH {GT} SELECT drive, idx, {rs('x', 'y', digits=3)}, {r('sin(yaw)', 'yaw_sin', 3)} FROM gt",
)
def planar_projection(spark, sf):
    ch, g, _ = data(spark, sf)
    p = trajectories.planar(g)
    return rounded(p.select("drive", "idx", "x", "y", F.sin("yaw").alias("yaw_sin")), 3)


_LOCAL = "10e0 + cos(0.3e0)*x - sin(0.3e0)*y"


@query(
    "fn_limit_forward",
    f"WITH {PAIRS}, m AS (SELECT *, {rot_columns('g', 'r')} FROM pairs), s AS (SELECT *, "
    + ", ".join(f"{' + '.join(f'r{i}{k}*(e{a} - g{a})' for i, a in enumerate('xyz'))} AS u{k}" for k in range(3))
    + " FROM m), h AS (SELECT *, greatest(-2e0, least(2e0, u0)) AS v FROM s) SELECT drive, idx, "
    + ", ".join(r(f"g{a} + r{i}0*v + r{i}1*u1 + r{i}2*u2", a, 3) for i, a in enumerate("xyz"))
    + f", abs(u0) > 2 AS held, {r('sin(eyaw)', 'yaw_sin', 3)} FROM h",
)
def fn_limit_forward(spark, sf):
    """Estimates whose correction of the truth along the vehicle is held within 2 m."""
    _, p = near_pairs(spark, sf)
    g, e = rigid.pose("gt."), rigid.pose("est.")
    p = p.withColumn("out", rigid.limit_forward(g, e, 2.0).struct())
    out = p.select(
        "drive", "idx", "out.x", "out.y", "out.z", (F.abs(g.between(e).t.x) > 2.0).alias("held"),
        F.sin(rigid.yaw_of(rigid.pose("out.").q)).alias("yaw_sin"),
    )
    return rounded(out, 3)


@query(
    "fn_reframe",
    f"WITH {GT} SELECT drive, idx, {r('floor(stamp) + (stamp - floor(stamp))', 'stamp', 3)}, {r(_LOCAL, 'x', 3)}, "
    f"{r('-5e0 + sin(0.3e0)*x + cos(0.3e0)*y', 'y', 3)}, {r('z + 1e0', 'z', 3)}, {r('sin(yaw + 0.3e0)', 'yaw_sin', 3)}, {r('pitch', 'pitch')} FROM gt",
)
def fn_reframe(spark, sf):
    """Poses of the local frame in the map frame, with stamps put together from seconds and nanoseconds."""
    _, g, _ = data(spark, sf)
    turn = rigid.yaw_quat(F.lit(0.3))
    p = g.withColumn("out", rigid.reframe(rigid.pose(), rigid.Pose(rigid.lit_vec(10.0, -5.0, 1.0), turn)).struct())
    whole = F.floor("stamp")
    nanos = F.round((F.col("stamp") - whole) * 1.0e9).cast("long")
    q = rigid.pose("out.").q
    out = p.select(
        "drive", "idx", trajectories.ros_seconds(whole, nanos).alias("stamp"), "out.x", "out.y", "out.z",
        F.sin(rigid.yaw_of(q)).alias("yaw_sin"), rigid.rpy_of(q)[1].alias("pitch"),
    )
    return rounded(out, 3, pitch=4)
