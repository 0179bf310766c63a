"""Points, voxels, surfaces, registration and cells on the derived point clouds."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayfold import driver_views as V
from wayfold.functions import rigid
from wayfold.functions.eigen3 import with_eigenvalues
from wayfold.operators import cells as C
from wayfold.operators import points as P
from wayfold.operators import surface as S
from wayfold.operators.ordered import few_rows
from wayfold.plans import cells as cell_plans
from wayfold.plans import clouds as cloud_plans
from wayfold.plans import registration
from wayfold.session import cut

from .recordings import POINTS, packed_clouds
from .registry import query, r, rounded, rs

POSES = """sp AS (SELECT drive, scan_id, scan_id * 1e0 AS stamp, scan_id * 1.5e0 + n % 7 * 0.1e0 AS x, scan_id * 0.25e0 AS y, scan_id * 0.01e0 AS z, scan_id * 0.02e0 AS yaw, scan_id % 3 AS passes
  FROM (SELECT l_orderkey % 4 AS drive, l_orderkey % 32 AS scan_id, count(*) AS n FROM lineitem GROUP BY ALL))"""
VOX = 5.0


def vkey(size: float, p: str = "", height: float | None = None) -> str:
    sizes = (size, size, height or size)
    return ", ".join(f"CAST(floor({p}{a} / {float(s)}e0) AS BIGINT) AS v{a}" for a, s in zip("xyz", sizes, strict=True))


# --- filters -------------------------------------------------------------------------------------------


@query("crop_box", f"WITH {POINTS} SELECT scan_id, idx, {r('intensity', 'intensity', 2)} FROM pts WHERE abs(x) <= 20 AND abs(y) <= 15")
def crop_box(spark, sf):
    return rounded(P.crop_box(V.points(spark, sf), 20.0, 15.0).select("scan_id", "idx", "intensity"), 2)


@query("crop_below", f"WITH {POINTS} SELECT scan_id, idx FROM pts WHERE abs(x) <= 30 AND abs(y) <= 20 AND z <= 0 AND z >= -0.355e0")
def crop_below(spark, sf):
    return P.crop_below(V.points(spark, sf), 30.0, 20.0, 0.355).select("scan_id", "idx")


@query("finite_in_range", f"WITH {POINTS} SELECT scan_id, idx FROM pts WHERE x*x + y*y + z*z BETWEEN 100 AND 900")
def finite_in_range(spark, sf):
    return P.finite_in_range(V.points(spark, sf), 10.0, 30.0).select("scan_id", "idx")


@query(
    "crop_aabb",
    f"WITH {POSES}, c AS (SELECT drive, scan_id, x + cos(yaw)*cx - sin(yaw)*cy AS px, y + sin(yaw)*cx + cos(yaw)*cy AS py, z + cz AS pz FROM sp, (VALUES (-30e0), (30e0)) a(cx), (VALUES (-20e0), (20e0)) b(cy), (VALUES (-5e0), (0e0)) d(cz)) "
    f"SELECT drive, scan_id, {r('min(px)', 'min_x', 3)}, {r('max(px)', 'max_x', 3)}, {r('min(py)', 'min_y', 3)}, {r('max(py)', 'max_y', 3)}, {r('min(pz)', 'min_z', 3)}, {r('max(pz)', 'max_z', 3)} FROM c GROUP BY drive, scan_id",
)
def crop_aabb(spark, sf):
    out = P.crop_aabb(V.scan_poses(spark, sf), 30.0, 20.0, 5.0)
    return rounded(out.select("drive", "scan_id", *[f"{m}_{a}" for a in "xyz" for m in ("min", "max")]), 3)


@query(
    "visible_scans",
    f"WITH {POSES}, n AS (SELECT * FROM sp QUALIFY row_number() OVER (PARTITION BY drive ORDER BY stamp DESC) = 1), "
    "v AS (SELECT s.drive, s.scan_id, s.stamp FROM sp s JOIN n USING (drive) WHERE abs(cos(n.yaw)*(s.x-n.x) + sin(n.yaw)*(s.y-n.y)) <= 30 AND abs(cos(n.yaw)*(s.y-n.y) - sin(n.yaw)*(s.x-n.x)) <= 20) "
    "SELECT drive, scan_id FROM v QUALIFY row_number() OVER (PARTITION BY drive ORDER BY stamp DESC) <= 4",
)
def visible_scans(spark, sf):
    return P.visible_scans(V.scan_poses(spark, sf), 30.0, 20.0, 4).select("drive", "scan_id")


# --- voxels --------------------------------------------------------------------------------------------

_FIRST = f"SELECT * FROM (SELECT *, {vkey(VOX)} FROM pts) QUALIFY row_number() OVER (PARTITION BY drive, scan_id, vx, vy, vz ORDER BY idx) = 1"


@query("voxel_first", f"WITH {POINTS} SELECT scan_id, idx, {r('x', 'x', 3)}, {r('intensity', 'intensity', 2)} FROM ({_FIRST})")
def voxel_first(spark, sf):
    return rounded(P.voxel_first(V.points(spark, sf), VOX).select("scan_id", "idx", "x", "intensity"), 3, intensity=2)


@query(
    "voxel_two_level",
    f"WITH {POINTS}, f AS (SELECT * FROM (SELECT *, {vkey(VOX * 0.5)} FROM pts) QUALIFY row_number() OVER (PARTITION BY drive, scan_id, vx, vy, vz ORDER BY idx) = 1), "
    f"c AS (SELECT * FROM (SELECT * EXCLUDE (vx, vy, vz), {vkey(VOX * 1.5)} FROM f) QUALIFY row_number() OVER (PARTITION BY drive, scan_id, vx, vy, vz ORDER BY idx) = 1) "
    "SELECT 'fine' AS level, scan_id, idx FROM f UNION ALL SELECT 'coarse', scan_id, idx FROM c",
)
def voxel_two_level(spark, sf):
    fine, coarse = P.voxel_two_level(V.points(spark, sf), VOX)
    tag = lambda df, name: df.select(F.lit(name).alias("level"), "scan_id", "idx")
    return tag(fine, "fine").unionByName(tag(coarse, "coarse"))


@query("thin_for_display", f"WITH {POINTS} SELECT drive, scan_id, idx FROM (SELECT *, {vkey(0.5)} FROM pts) QUALIFY row_number() OVER (PARTITION BY drive, vx, vy, vz ORDER BY scan_id, idx) = 1")
def thin_for_display(spark, sf):
    return P.thin_for_display(V.points(spark, sf)).select("drive", "scan_id", "idx")


@query("voxel_random")
def voxel_random(spark, sf):
    return P.voxel_random(V.points(spark, sf), VOX, 0.3, seed=7).select("scan_id", "idx")


@query("voxel_spaced")
def voxel_spaced(spark, sf):
    return P.voxel_spaced(V.points(spark, sf), VOX, 20).select("scan_id", "idx", "kept_rank")


@query(
    "stride_sample",
    f"WITH {POINTS}, n AS (SELECT scan_id, idx, row_number() OVER (PARTITION BY drive, scan_id ORDER BY idx) - 1 AS pos, count(*) OVER (PARTITION BY drive, scan_id) AS n FROM pts), "
    "k AS (SELECT scan_id, CAST(floor(i.i * (n / 100e0)) AS BIGINT) AS pos FROM (SELECT DISTINCT scan_id, n FROM n WHERE n > 100), (SELECT unnest(range(100)) AS i) i) "
    "SELECT scan_id, idx FROM n WHERE n <= 100 OR (scan_id, pos) IN (SELECT (scan_id, pos) FROM k)",
)
def stride_sample(spark, sf):
    return P.stride_sample(V.points(spark, sf), 100).select("scan_id", "idx")


@query(
    "voxel_intensity",
    f"WITH {POINTS}, d AS (SELECT * FROM ({_FIRST})), c AS (SELECT *, {vkey(VOX)} FROM pts WHERE abs(x) <= 20 AND abs(y) <= 15), "
    "f AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY drive, scan_id, vx, vy, vz ORDER BY idx) = 1) "
    f"SELECT d.scan_id, d.idx, {r('coalesce(f.intensity, 0)', 'intensity', 2)} FROM d LEFT JOIN f ON f.scan_id = d.scan_id AND f.drive = d.drive AND f.vx = d.vx AND f.vy = d.vy AND f.vz = d.vz",
)
def voxel_intensity(spark, sf):
    pts = V.points(spark, sf)
    out = P.voxel_intensity(P.voxel_first(pts, VOX), P.crop_box(pts, 20.0, 15.0), VOX)
    return rounded(out.select("scan_id", "idx", "intensity"), 2)


WORLD = f"""{POINTS}, {POSES}, wp AS (SELECT p.drive, p.scan_id, p.idx, p.intensity, s.passes, s.x + cos(s.yaw)*p.x - sin(s.yaw)*p.y AS x, s.y + sin(s.yaw)*p.x + cos(s.yaw)*p.y AS y, s.z + p.z AS z
  FROM pts p JOIN sp s USING (drive, scan_id))"""


@query("merge_scan_points", f"WITH {WORLD} SELECT scan_id, idx, {rs('x', 'y', 'z', digits=3)}, passes AS collective_passes FROM wp")
def merge_scan_points(spark, sf):
    out = P.merge_scan_points(V.points(spark, sf), V.scan_poses(spark, sf))
    return rounded(out.select("scan_id", "idx", "x", "y", "z", "collective_passes"), 3)


# --- motion --------------------------------------------------------------------------------------------


def sweep(spark, sf):
    """Points on the clock of their scan and a trajectory that covers the sweeps."""
    pts = V.points(spark, sf).withColumn("t", F.col("scan_id") * 1.0 + F.col("t") * 10.0)
    traj = V.scan_poses(spark, sf).drop("scan_id", "collective_passes")
    return pts, traj


# Planar screw of the sweep between scan poses, by the pole of the motion.
_DESKEW = f"""WITH {POINTS}, {POSES}, tp AS (SELECT drive, scan_id, idx, scan_id * 1e0 + t * 1e1 AS t, x, y, z FROM pts),
qs AS (SELECT drive, scan_id, idx, t, x, y, z, false AS is_end FROM tp UNION ALL SELECT drive, scan_id, NULL, max(t), NULL, NULL, NULL, true FROM tp GROUP BY drive, scan_id),
b AS (SELECT q.*, l.stamp AS ls, l.x AS lx, l.y AS ly, l.z AS lz, l.yaw AS lyaw, n.stamp AS ns, n.x AS nx, n.y AS ny, n.z AS nz, n.yaw AS nyaw
  FROM qs q ASOF LEFT JOIN sp l ON q.drive = l.drive AND q.t > l.stamp ASOF LEFT JOIN sp n ON q.drive = n.drive AND q.t <= n.stamp),
s AS (SELECT *, (t - ls) / (ns - ls) AS k, nyaw - lyaw AS th, cos(lyaw)*(nx-lx) + sin(lyaw)*(ny-ly) AS ux, cos(lyaw)*(ny-ly) - sin(lyaw)*(nx-lx) AS uy FROM b),
c AS (SELECT *, (ux - uy / tan(th / 2)) / 2 AS cx, (uy + ux / tan(th / 2)) / 2 AS cy FROM s),
m AS (SELECT *, cx - cos(k*th)*cx + sin(k*th)*cy AS mx, cy - sin(k*th)*cx - cos(k*th)*cy AS my FROM c),
posed AS (SELECT drive, scan_id, idx, x, y, z, is_end, CASE WHEN ls IS NULL THEN nx WHEN ns IS NULL THEN lx ELSE lx + cos(lyaw)*mx - sin(lyaw)*my END AS px,
  CASE WHEN ls IS NULL THEN ny WHEN ns IS NULL THEN ly ELSE ly + sin(lyaw)*mx + cos(lyaw)*my END AS py,
  CASE WHEN ls IS NULL THEN nz WHEN ns IS NULL THEN lz ELSE lz + k*(nz-lz) END AS pz, CASE WHEN ls IS NULL THEN nyaw WHEN ns IS NULL THEN lyaw ELSE lyaw + k*th END AS pyaw FROM m),
w AS (SELECT a.drive, a.scan_id, a.idx, a.px + cos(a.pyaw)*a.x - sin(a.pyaw)*a.y AS wx, a.py + sin(a.pyaw)*a.x + cos(a.pyaw)*a.y AS wy, a.pz + a.z AS wz,
  e.px AS ex, e.py AS ey, e.pz AS ez, e.pyaw AS eyaw FROM posed a JOIN posed e ON e.drive = a.drive AND e.scan_id = a.scan_id AND e.is_end WHERE NOT a.is_end)
SELECT scan_id, idx, {r('cos(eyaw)*(wx-ex) + sin(eyaw)*(wy-ey)', 'x', 3)}, {r('cos(eyaw)*(wy-ey) - sin(eyaw)*(wx-ex)', 'y', 3)}, {r('wz - ez', 'z', 3)} FROM w"""


@query("deskew", _DESKEW)
def deskew(spark, sf):
    pts, traj = sweep(spark, sf)
    return rounded(P.deskew(pts, traj).select("scan_id", "idx", "x", "y", "z"), 3)


@query(
    "accumulate_in_view",
    f"""WITH {WORLD}, fr AS (SELECT *, row_number() OVER (PARTITION BY drive ORDER BY stamp) AS fn FROM sp),
v AS (SELECT p.drive, p.scan_id, p.idx, p.x, p.y, p.z, o.fn AS own, f.fn, f.scan_id AS view_frame, cos(f.yaw)*(p.x-f.x) + sin(f.yaw)*(p.y-f.y) AS bx, cos(f.yaw)*(p.y-f.y) - sin(f.yaw)*(p.x-f.x) AS b_y, p.z - f.z AS bz
  FROM wp p JOIN fr o ON o.drive = p.drive AND o.scan_id = p.scan_id JOIN fr f ON f.drive = p.drive AND f.fn >= o.fn),
o AS (SELECT *, max(CASE WHEN abs(bx) <= 25 AND abs(b_y) <= 18 AND bz <= 0 AND bz >= -2 THEN 0 ELSE 1 END) OVER (PARTITION BY drive, scan_id, idx, x, y, z ORDER BY fn ROWS UNBOUNDED PRECEDING) AS gone FROM v)
SELECT view_frame, scan_id AS frame, idx FROM o WHERE gone = 0""",
)
def accumulate_in_view(spark, sf):
    pts = P.merge_scan_points(V.points(spark, sf), V.scan_poses(spark, sf)).withColumnRenamed("scan_id", "frame")
    frames = V.scan_poses(spark, sf).withColumnRenamed("scan_id", "frame")
    return P.accumulate_in_view(pts, frames, 25.0, 18.0, 2.0).select("view_frame", "frame", "idx")


@query("prepare_points")
def prepare_points(spark, sf):
    pts, traj = sweep(spark, sf)
    fine, coarse = cloud_plans.prepare_points(pts, traj, cloud_plans.PrepareParams(voxel=VOX))
    tag = lambda df, name: df.select(F.lit(name).alias("level"), "scan_id", "idx")
    return tag(fine, "map").unionByName(tag(coarse, "source"))


@query("prepare_scans")
def prepare_scans(spark, sf):
    """From binary messages with sensor frames to the two clouds."""
    messages = packed_clouds(spark, sf).withColumn("frame_id", F.lit("left"))
    drives = messages.select("drive").distinct()
    ext = drives.select("drive", F.lit("left").alias("frame_id"), *[F.lit(v).alias(n) for n, v in zip(rigid.POSE_FIELDS, (0.5, 0.0, 1.0, 1.0, 0.0, 0.0, 0.0), strict=True)])
    traj = V.scan_poses(spark, sf).drop("scan_id", "collective_passes").withColumns({"drive": F.col("drive").cast("string"), "stamp": F.col("stamp") + 100.0})
    fine, _ = cloud_plans.prepare_scans(messages, ext, traj, cloud_plans.PrepareParams(voxel=VOX))
    return rounded(fine.select("drive", "scan_id", "idx", "x", "y", "z"), 3)


# --- surface -------------------------------------------------------------------------------------------

MOM = f"""mo AS (SELECT drive, vx, vy, vz, count(*) AS n, avg(x) AS mx, avg(y) AS my, avg(z) AS mz, covar_pop(x, x) AS cxx, covar_pop(x, y) AS cxy, covar_pop(x, z) AS cxz,
  covar_pop(y, y) AS cyy, covar_pop(y, z) AS cyz, covar_pop(z, z) AS czz FROM (SELECT drive, x, y, z, {vkey(VOX)} FROM wp) GROUP BY ALL)"""
_COV = ("cxx", "cxy", "cxz", "cyy", "cyz", "czz")


def world(spark, sf):
    return P.merge_scan_points(V.points(spark, sf), V.scan_poses(spark, sf))


@query("voxel_moments", f"WITH {WORLD}, {MOM} SELECT drive, vx, vy, vz, n, {rs('mx', 'my', 'mz', *_COV, digits=3)} FROM mo")
def voxel_moments(spark, sf):
    return rounded(S.voxel_moments(world(spark, sf), VOX), 3)


def eigen_sql(source: str, out: str) -> str:
    """Eigenvalues of a symmetric 3x3 by the cubic's power sums (independent of the column code's scaling)."""
    return f"""{out}_a AS (SELECT *, (cxx + cyy + czz) / 3 AS qm FROM {source}),
{out}_b AS (SELECT *, ((cxx-qm)**2 + (cyy-qm)**2 + (czz-qm)**2 + 2*(cxy**2 + cxz**2 + cyz**2)) / 6 AS p2,
  ((cxx-qm)*((cyy-qm)*(czz-qm) - cyz**2) - cxy*(cxy*(czz-qm) - cyz*cxz) + cxz*(cxy*cyz - (cyy-qm)*cxz)) / 2 AS hd FROM {out}_a),
{out}_c AS (SELECT *, CASE WHEN p2 > 0 THEN acos(least(1e0, greatest(-1e0, hd / (p2 * sqrt(p2))))) / 3 ELSE 0 END AS ph FROM {out}_b),
{out} AS (SELECT *, qm + 2*sqrt(p2)*cos(ph) AS l1, qm + 2*sqrt(p2)*cos(ph - 2*pi()/3) AS l2, qm + 2*sqrt(p2)*cos(ph + 2*pi()/3) AS l3 FROM {out}_c)"""


@query("voxel_eigenvalues", f"WITH {WORLD}, {MOM}, {eigen_sql('mo', 'ev3')} SELECT drive, vx, vy, vz, {rs('l1', 'l2', 'l3', digits=3)} FROM ev3")
def voxel_eigenvalues(spark, sf):
    e = with_eigenvalues(S.voxel_moments(world(spark, sf), VOX), "c", "l")
    return rounded(e.select("drive", "vx", "vy", "vz", "l1", "l2", "l3"), 3)


_OFF = "(SELECT a.d AS ox, b.d AS oy, c.d AS oz FROM (VALUES (-1), (0), (1)) a(d), (VALUES (-1), (0), (1)) b(d), (VALUES (-1), (0), (1)) c(d))"
_BLOCK = f"""bl AS (SELECT t.drive, t.vx, t.vy, t.vz, count(*) AS n, avg(w.x) AS mx, avg(w.y) AS my, avg(w.z) AS mz, covar_pop(w.x, w.x) AS cxx, covar_pop(w.x, w.y) AS cxy, covar_pop(w.x, w.z) AS cxz,
  covar_pop(w.y, w.y) AS cyy, covar_pop(w.y, w.z) AS cyz, covar_pop(w.z, w.z) AS czz FROM mo t, {_OFF} o
  JOIN (SELECT *, {vkey(VOX)} FROM wp) w ON w.drive = t.drive AND w.vx = t.vx + ox AND w.vy = t.vy + oy AND w.vz = t.vz + oz GROUP BY ALL)"""


@query("block_moments", f"WITH {WORLD}, {MOM}, {_BLOCK} SELECT drive, vx, vy, vz, n, {rs('mx', 'my', 'mz', *_COV, digits=3)} FROM bl")
def block_moments(spark, sf):
    stats = S.voxel_moments(world(spark, sf), VOX)
    return rounded(S.block_moments(stats, stats, VOX), 3)


_SURF = f"""{WORLD}, {MOM}, {eigen_sql('mo', 'oe')}, {_BLOCK}, {eigen_sql('bl', 'be')},
su AS (SELECT o.*, o.n >= 5 AND o.l1 > 1e-10 AND o.l3 / o.l1 <= 0.25e0 AS own_fit, b.n >= 5 AND b.l1 > 1e-10 AND b.l3 / b.l1 <= 0.25e0 AS block_fit,
  (o.cxx+1e-3)*((o.cyy+1e-3)*(o.czz+1e-3) - o.cyz**2) - o.cxy*(o.cxy*(o.czz+1e-3) - o.cyz*o.cxz) + o.cxz*(o.cxy*o.cyz - (o.cyy+1e-3)*o.cxz) AS det
  FROM oe o JOIN be b USING (drive, vx, vy, vz)),
sv AS (SELECT *, n >= 5 AND abs(det) > 1e-12 AS valid, own_fit OR block_fit AS planar, ((cyy+1e-3)*(czz+1e-3) - cyz**2)/det AS ixx, (cxz*cyz - cxy*(czz+1e-3))/det AS ixy,
  (cxy*cyz - cxz*(cyy+1e-3))/det AS ixz, ((cxx+1e-3)*(czz+1e-3) - cxz**2)/det AS iyy, (cxy*cxz - (cxx+1e-3)*cyz)/det AS iyz, ((cxx+1e-3)*(cyy+1e-3) - cxy**2)/det AS izz FROM su)"""


@query("surface_map", f"WITH {_SURF} SELECT drive, vx, vy, vz, n, own_fit, planar, valid, {r('mx', 'mx', 3)}, CASE WHEN valid THEN {r('ixx', 'q', 2)[:-5]} END AS ixx FROM sv")
def surface_map(spark, sf):
    out = S.surface_map(world(spark, sf), VOX)
    return rounded(out.select("drive", "vx", "vy", "vz", "n", "own_fit", "planar", "valid", "mx", "ixx"), 3, ixx=2)


_NDT = f"""{_SURF}, dd AS (SELECT w.scan_id, w.x - s.mx AS a, w.y - s.my AS b, w.z - s.mz AS c, s.* FROM (SELECT drive, scan_id, idx, x + 0.3e0 AS x, y, z + 0.05e0 AS z, {vkey(VOX).replace('floor(x', 'floor((x + 0.3e0)').replace('floor(z', 'floor((z + 0.05e0)')} FROM wp) w
  JOIN sv s ON s.drive = w.drive AND s.vx = w.vx AND s.vy = w.vy AND s.vz = w.vz WHERE s.valid),
nd AS (SELECT drive, scan_id, a*(ixx*a + ixy*b + ixz*c) + b*(ixy*a + iyy*b + iyz*c) + c*(ixz*a + iyz*b + izz*c) AS d2 FROM dd)"""


@query(
    "ndt_score",
    f"WITH {_NDT} SELECT drive, scan_id, count(*) AS valid_hits, CASE WHEN count(*) >= 20 THEN round(avg(d2), 3) + 0e0 END AS mean_cost, CASE WHEN count(*) >= 20 THEN round(avg(CASE WHEN d2 < 7.81e0 THEN 1e0 ELSE 0e0 END), 4) + 0e0 END AS inlier_fraction FROM nd GROUP BY drive, scan_id",
)
def ndt_score(spark, sf):
    w = world(spark, sf)
    moved = w.withColumns({"x": F.col("x") + 0.3, "z": F.col("z") + 0.05})
    return rounded(S.ndt_score(moved, S.surface_map(w, VOX), VOX), 4, mean_cost=3)


@query("voxel_lookup", f"WITH {_SURF} SELECT w.scan_id, count(*) AS n, count(*) FILTER (planar) AS planar_hits FROM (SELECT *, {vkey(VOX)} FROM wp) w JOIN sv USING (drive, vx, vy, vz) GROUP BY w.scan_id")
def voxel_lookup(spark, sf):
    w = world(spark, sf)
    return S.voxel_lookup(w, S.surface_map(w, VOX).drop("n"), VOX).groupBy("scan_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("planar").alias("planar_hits"))


_MAP = f"mp AS (SELECT * FROM (SELECT *, {vkey(2.5)} FROM wp) QUALIFY row_number() OVER (PARTITION BY drive, vx, vy, vz ORDER BY scan_id, idx) = 1)"


def thinned(points):
    """One point per 2.5 m voxel: at most 8 per 5 m voxel of the search grid."""
    return P.voxel_first(points, 2.5, ("drive",), ("scan_id", "idx"))


def thin_map(spark, sf):
    return thinned(world(spark, sf))


@query(
    "closest_map_point",
    f"WITH {WORLD}, {_MAP}, mv AS (SELECT drive, idx, x, y, z, {vkey(VOX)} FROM mp), qv AS (SELECT drive, scan_id, idx, x + 0.7e0 AS x, y, z, {vkey(VOX).replace('floor(x', 'floor((x + 0.7e0)')} FROM wp), "
    f"c AS (SELECT q.drive, q.scan_id, q.idx, m.idx AS hit_idx, (m.x-q.x)**2 + (m.y-q.y)**2 + (m.z-q.z)**2 AS d2 FROM qv q, {_OFF} o JOIN mv m ON m.drive = q.drive AND m.vx = q.vx + ox AND m.vy = q.vy + oy AND m.vz = q.vz + oz) "
    f"SELECT scan_id, idx, hit_idx, {r('d2', 'd2', 3)} FROM c WHERE d2 < 9 QUALIFY row_number() OVER (PARTITION BY drive, scan_id, idx ORDER BY d2, hit_idx) = 1",
)
def closest_map_point(spark, sf):
    index = S.block_index(thin_map(spark, sf), VOX)
    queries = world(spark, sf).withColumn("x", F.col("x") + 0.7)
    out = S.closest_map_point(queries, index, VOX, 3.0).filter(F.col("hit").isNotNull())
    return rounded(out.select("scan_id", "idx", F.col("hit.id").alias("hit_idx"), F.col("hit.d2").alias("d2")), 3)


@query(
    "dominant_scan",
    f"WITH {WORLD}, k AS (SELECT drive, vx, vy, vz, scan_id, count(*) AS c FROM (SELECT *, {vkey(VOX)} FROM wp) GROUP BY ALL) "
    "SELECT drive, vx, vy, vz, scan_id AS dominant, c AS dominant_n, CAST(sum(c) OVER (PARTITION BY drive, vx, vy, vz) AS BIGINT) AS n FROM k QUALIFY row_number() OVER (PARTITION BY drive, vx, vy, vz ORDER BY c DESC, scan_id) = 1",
)
def dominant_scan(spark, sf):
    return S.dominant_scan(world(spark, sf), VOX)


@query(
    "closest_plane",
    f"""WITH {_SURF}, k AS (SELECT drive, vx, vy, vz, scan_id, count(*) AS c FROM (SELECT *, {vkey(VOX)} FROM wp) GROUP BY ALL),
dm AS (SELECT drive, vx, vy, vz, scan_id AS dominant, c FROM k QUALIFY row_number() OVER (PARTITION BY drive, vx, vy, vz ORDER BY c DESC, scan_id) = 1),
pl AS (SELECT s.drive, s.vx, s.vy, s.vz, s.mx, s.my, s.mz, s.n, dominant, c FROM sv s JOIN dm USING (drive, vx, vy, vz) WHERE own_fit),
h AS (SELECT q.drive, q.scan_id, q.idx, p.vx AS px, p.vy AS py, p.vz AS pz, (p.mx-q.x)**2 + (p.my-q.y)**2 + (p.mz-q.z)**2 AS d2 FROM (SELECT *, {vkey(VOX)} FROM wp) q, {_OFF} o
  JOIN pl p ON p.drive = q.drive AND p.vx = q.vx + ox AND p.vy = q.vy + oy AND p.vz = q.vz + oz WHERE NOT (p.dominant = q.scan_id AND p.c * 2 >= p.n))
SELECT scan_id, idx, px, py, pz, {r('d2', 'd2', 3)} FROM h WHERE d2 < 16 QUALIFY row_number() OVER (PARTITION BY drive, scan_id, idx ORDER BY d2) = 1""",
)
def closest_plane(spark, sf):
    w = world(spark, sf)
    planes = S.surface_map(w, VOX).filter("own_fit").join(S.dominant_scan(w, VOX).drop("n"), ["drive", *P.VOXEL])
    out = S.closest_plane(w, planes, VOX, 4.0).filter(F.col("hit").isNotNull())
    return rounded(out.select("scan_id", "idx", *[F.col(f"hit.v{a}").alias(f"p{a}") for a in "xyz"], F.col("hit.d2").alias("d2")), 3)


# --- registration --------------------------------------------------------------------------------------


def _residuals(spark, sf):
    poses, few = few_rows(V.scan_poses(spark, sf))
    w = P.merge_scan_points(V.points(spark, sf), poses)
    index = S.plane_index(thinned(w), S.surface_map(w, VOX), VOX)
    return S.plane_residuals(V.points(spark, sf), poses.withColumn("x", F.col("x") + 0.4), index, VOX, 3.0, few_poses=few)


@query("plane_normal_equations")
def plane_normal_equations(spark, sf):
    return rounded(S.plane_normal_equations(_residuals(spark, sf)).select("drive", "scan_id", "h00", "h35", "g2", "correspondences", "cost_sum", "n"), 3)


@query("plane_cost")
def plane_cost(spark, sf):
    return rounded(S.plane_cost(_residuals(spark, sf)))


@query(
    "robust_kernel",
    f"WITH {POINTS} SELECT scan_id, {r('sum(0.25e0*z*z/(0.5e0 + z*z))', 'cost', 3)}, {r('sum(0.25e0/((0.5e0 + z*z)**2))', 'weight', 3)} FROM pts GROUP BY scan_id",
)
def robust_kernel(spark, sf):
    z = F.col("z")
    return rounded(V.points(spark, sf).groupBy("scan_id").agg(F.sum(S.robust_cost(z, 0.5)).alias("cost"), F.sum(S.robust_weight(z, 0.5)).alias("weight")), 3)


@query("register_scans")
def register_scans(spark, sf):
    poses, _ = few_rows(V.scan_poses(spark, sf))
    w = P.merge_scan_points(V.points(spark, sf), poses)
    params = registration.RegisterParams(max_distance=3.0, max_iterations=4)
    whole = S.DenseMap.of(w, cut(S.surface_map(w, VOX)), VOX, params.max_distance)
    seeds = poses.withColumn("z", F.col("z") + 0.1)
    out = registration.register_scans(V.points(spark, sf), seeds, whole, VOX, params)
    return rounded(out.select("drive", "scan_id", "z", "iterations", "correspondences", "robust_cost", "saturated"), 3)


@query("refine_scan_poses")
def refine_scan_poses(spark, sf):
    poses = V.scan_poses(spark, sf).withColumn("adjustable", (F.col("scan_id") >= 4) & (F.col("scan_id") < 28))
    params = registration.RefineParams(voxel=VOX, max_distance=4.0, outer_iterations=1, inner_iterations=1, points_per_voxel=8)
    out = registration.refine_scan_poses(V.points(spark, sf), poses, params)
    return rounded(out.select("drive", "scan_id", "adjustable", "x", "y", "z", "shift_m"), 3)


# --- cells ---------------------------------------------------------------------------------------------

SIZE, HEIGHT = 5.0, 2.0
KEYS = ("drive", "frame")
CELL = f"""{POINTS}, cp AS (SELECT drive, scan_id AS frame, idx, x, y, z, intensity, {vkey(SIZE, height=HEIGHT)} FROM pts),
cs AS (SELECT drive, frame, vx, vy, vz, count(*) AS n, sum(intensity) AS si, sum(intensity**2) AS sii, avg(x) AS mx, avg(y) AS my, avg(z) AS mz, covar_pop(x, x) AS cxx, covar_pop(x, y) AS cxy, covar_pop(x, z) AS cxz,
  covar_pop(y, y) AS cyy, covar_pop(y, z) AS cyz, covar_pop(z, z) AS czz, sum(intensity) AS sw, sum(intensity*x) AS swx, sum(intensity*x*y) AS swxy FROM cp GROUP BY ALL)"""


def cell_points(spark, sf):
    return V.points(spark, sf).withColumnRenamed("scan_id", "frame")


@query(
    "cell_stats",
    f"WITH {CELL} SELECT drive, frame, vx, vy, vz, n, {r('si', 'sum_i', 2)}, {r('sii', 'sum_ii', 1)}, {r('n*(mx - vx*5e0)', 'sx', 2)}, {r('swx - sw*vx*5e0', 'swx', 1)} FROM cs",
)
def cell_stats(spark, sf):
    s = C.cell_stats(cell_points(spark, sf), SIZE, HEIGHT)
    return rounded(s.select("drive", "frame", "vx", "vy", "vz", "n", "sum_i", "sum_ii", "sx", "swx"), 2, sum_ii=1, swx=1)


# |n_z|^2 from the projector on the smallest eigenvector, for cells whose two smaller eigenvalues differ.
_LOCAL = f"""{CELL}, {eigen_sql('(SELECT * FROM cs WHERE n >= 4) cs4', 'ce')},
lf AS (SELECT *, (l2 - l3) / l1 AS planarity, si / n AS mean_intensity, sqrt(greatest(sii/n - (si/n)**2, 0)) / greatest(abs(si/n), 1e-6) AS intensity_cv,
  sqrt(greatest((cxz*cxz + cyz*cyz + (czz-l1)*(czz-l2)) / ((l3-l1)*(l3-l2)), 0)) AS nz FROM ce WHERE l1 > 1e-10)"""


@query(
    "local_features",
    f"WITH {_LOCAL} SELECT drive, frame, vx, vy, vz, n, {rs('l1', 'l2', 'l3', 'planarity', 'mean_intensity', digits=3)}, {r('intensity_cv', 'intensity_cv', 3)}, CASE WHEN l2 - l3 > 1e-3*l1 THEN round(1 - least(nz, 1e0), 3) + 0e0 END AS verticality FROM lf",
)
def local_features(spark, sf):
    f = C.local_features(C.cell_stats(cell_points(spark, sf), SIZE, HEIGHT), SIZE, HEIGHT, 4)
    out = f.select(
        "drive", "frame", "vx", "vy", "vz", "n", "l1", "l2", "l3", "planarity", "mean_intensity", "intensity_cv",
        F.when(F.col("l2") - F.col("l3") > F.col("l1") * 1e-3, F.col("verticality")).alias("verticality"),
    )
    return rounded(out, 3)


_EDGES = f"""ed AS (SELECT a.drive, a.frame, a.vx, a.vy, a.vz, b.vx AS nx, b.vy AS ny, b.vz AS nz FROM lf a, {_OFF} o JOIN lf b ON b.drive = a.drive AND b.frame = a.frame AND b.vx = a.vx + ox AND b.vy = a.vy + oy AND b.vz = a.vz + oz
  WHERE NOT (ox = 0 AND oy = 0 AND oz = 0))"""


def features(spark, sf):
    return C.local_features(C.cell_stats(cell_points(spark, sf), SIZE, HEIGHT), SIZE, HEIGHT, 4)


@query("cell_neighbors", f"WITH {_LOCAL}, {_EDGES} SELECT drive, frame, vx, vy, vz, nx, ny, nz FROM ed")
def cell_neighbors(spark, sf):
    return C.cell_neighbors(features(spark, sf)).select("drive", "frame", "vx", "vy", "vz", "nx", "ny", "nz")


# h^2 = d' P d with the projector P; exact for separated eigenvalues, so the twin compares those cells.
_PROJ = ", ".join(
    f"({' + '.join(f'({a}{k})*({b}{k})' for k in ('1', '2', '3'))}) / ((l3-l1)*(l3-l2)) AS p{n}"
    for n, a, b in (("xx", "ax", "bx"), ("xy", "ax", "b_y"), ("xz", "ax", "bz"), ("yy", "ay", "b_y"), ("yz", "ay", "bz"), ("zz", "az", "bz"))
)
_LAP = f"""{_LOCAL}, {_EDGES},
mm AS (SELECT *, cxx-l1 AS ax1, cxy AS ax2, cxz AS ax3, cxy AS ay1, cyy-l1 AS ay2, cyz AS ay3, cxz AS az1, cyz AS az2, czz-l1 AS az3,
  cxx-l2 AS bx1, cxy AS bx2, cxz AS bx3, cxy AS b_y1, cyy-l2 AS b_y2, cyz AS b_y3, cxz AS bz1, cyz AS bz2, czz-l2 AS bz3 FROM lf),
pr AS (SELECT *, {_PROJ} FROM mm),
nb AS (SELECT e.drive, e.frame, e.vx, e.vy, e.vz, a.mean_intensity AS oi, b.mean_intensity AS ni, a.l1, a.l2, a.l3, b.mx-a.mx AS dx, b.my-a.my AS dy, b.mz-a.mz AS dz, a.pxx, a.pxy, a.pxz, a.pyy, a.pyz, a.pzz
  FROM ed e JOIN pr a ON a.drive = e.drive AND a.frame = e.frame AND a.vx = e.vx AND a.vy = e.vy AND a.vz = e.vz JOIN lf b ON b.drive = e.drive AND b.frame = e.frame AND b.vx = e.nx AND b.vy = e.ny AND b.vz = e.nz),
hh AS (SELECT *, dx*(pxx*dx + pxy*dy + pxz*dz) + dy*(pxy*dx + pyy*dy + pyz*dz) + dz*(pxz*dx + pyz*dy + pzz*dz) AS h2 FROM nb),
lw AS (SELECT *, exp(-(dx*dx + dy*dy + dz*dz - h2) / 25e0) AS w FROM hh WHERE h2 <= 4e0)"""


@query(
    "intensity_laplacian",
    f"WITH {_LAP} SELECT drive, frame, vx, vy, vz, {r('abs(sum(w*(ni-oi))/sum(w)) / greatest(abs(any_value(oi)), 1e-6)', 'intensity_laplacian', 3)} FROM lw GROUP BY drive, frame, vx, vy, vz HAVING sum(w) > 1e-9 AND any_value(l2 - l3 > 1e-2*l1)",
)
def intensity_laplacian(spark, sf):
    f = features(spark, sf)
    lap = C.intensity_laplacian(f, SIZE, HEIGHT)
    clear = f.filter(F.col("l2") - F.col("l3") > F.col("l1") * 1e-2).select("drive", "frame", *P.VOXEL)
    return rounded(lap.join(clear, ["drive", "frame", *P.VOXEL]), 3)


@query("quadric_normal_equations")
def quadric_normal_equations(spark, sf):
    q = C.quadric_normal_equations(features(spark, sf))
    return rounded(q.select("drive", "frame", *P.VOXEL, "rows", "q00", "q55"), 3)


@query("cell_features")
def cell_features(spark, sf):
    f = cell_plans.cell_features(cell_points(spark, sf), SIZE, HEIGHT, 4)
    return rounded(f.select("drive", "frame", *P.VOXEL, "planarity", "intensity_cv", "intensity_laplacian"), 3)


@query(
    "intensity_pca",
    f"WITH {POINTS}, cp AS (SELECT drive, scan_id AS frame, x, y, z, intensity AS i, {vkey(SIZE, height=HEIGHT)} FROM pts), "
    "ws AS (SELECT drive, frame, vx, vy, vz, count(*) AS n, sum(i) AS sw, sum(i*x)/sum(i) AS mx, sum(i*y)/sum(i) AS my, sum(i*z)/sum(i) AS mz FROM cp GROUP BY ALL HAVING count(*) >= 4 AND sum(i) > 1e-6), "
    "wc AS (SELECT w.drive, w.frame, w.vx, w.vy, w.vz, any_value(w.n) AS n, any_value(mx) AS mx, any_value(my) AS my, sum(i*(x-mx)**2)/sum(i) AS cxx, sum(i*(x-mx)*(y-my))/sum(i) AS cxy, sum(i*(x-mx)*(z-mz))/sum(i) AS cxz, "
    "sum(i*(y-my)**2)/sum(i) AS cyy, sum(i*(y-my)*(z-mz))/sum(i) AS cyz, sum(i*(z-mz)**2)/sum(i) AS czz FROM ws w JOIN cp USING (drive, frame, vx, vy, vz) GROUP BY ALL), "
    f"{eigen_sql('wc', 'we')} SELECT drive, frame, vx, vy, vz, n, {rs('mx', 'my', digits=3)}, {r('sqrt(l1)', 'radius1', 3)}, {r('sqrt(greatest(l2, 0))', 'radius2', 3)} FROM we WHERE l1 > 1e-6",
)
def intensity_pca(spark, sf):
    s = C.cell_stats(cell_points(spark, sf), SIZE, HEIGHT)
    out = C.intensity_pca(s, SIZE, HEIGHT, 4).filter(F.col("radius1") ** 2 > 1e-6)
    return rounded(out.select("drive", "frame", *P.VOXEL, "n", "mx", "my", "radius1", "radius2"), 3)


# Features for the grid operators: local ones, with simple stand-ins for curvature and Laplacian in both engines.
_FV = f"""{_LOCAL}, fv AS (SELECT *, least(greatest(planarity, 0), 1) AS f0, least(greatest((vx % 7 + 7) % 7 / 7e0, 0), 1) AS f1, least(greatest(mean_intensity / 100 / 0.5e0, 0), 1) AS f2,
  least(greatest(intensity_cv, 0), 1) AS f3, least(greatest(l2 / 4e0, 0), 1) AS f4 FROM lf)"""
_BIN = ", ".join(f"CAST(least(greatest(floor(f{i} * 6), 0), 5) AS INTEGER) AS b{i}" for i in range(5))
_HIST = f"{_FV}, hi AS (SELECT drive, frame, b0, b1, b2, b3, b4, CAST(sum(least(n, 32)) AS DOUBLE) AS votes FROM (SELECT *, {_BIN} FROM fv) GROUP BY ALL)"


def grid_features(spark, sf):
    f = features(spark, sf).withColumns(
        {"verticality": F.pmod(F.col("vx"), F.lit(7)) / 7.0, "curvature": F.col("mean_intensity") / 100.0, "intensity_laplacian": F.col("l2") / 4.0}
    )
    return C.feature_vector(f)


@query("feature_vector", f"WITH {_FV} SELECT drive, frame, vx, vy, vz, {rs('f0', 'f1', 'f2', 'f3', 'f4', digits=3)} FROM fv")
def feature_vector(spark, sf):
    return rounded(grid_features(spark, sf).select("drive", "frame", *P.VOXEL, *C.FEATURES), 3)


@query("feature_histogram", f"WITH {_HIST} SELECT drive, frame, b0, b1, b2, b3, b4, votes FROM hi")
def feature_histogram(spark, sf):
    return C.feature_histogram(grid_features(spark, sf), 6)


_TAPS = "(VALUES (-1, 0.25e0), (0, 0.5e0), (1, 0.25e0))"


@query(
    "blur_histogram",
    f"WITH {_HIST}, " + ", ".join(
        f"s{i} AS (SELECT drive, frame, {', '.join(f'b{k}' if k != i else f'b{k} + d AS b{k}' for k in range(5))}, sum(votes * w) AS votes FROM {'hi' if i == 0 else f's{i - 1}'}, {_TAPS} t(d, w) WHERE b{i} + d BETWEEN 0 AND 5 GROUP BY ALL)"
        for i in range(5)
    ) + f" SELECT drive, frame, b0, b1, b2, b3, b4, {r('votes', 'blurred', 6)} FROM s4",
)
def blur_histogram(spark, sf):
    return rounded(C.blur_histogram(C.feature_histogram(grid_features(spark, sf), 6), 6), 6)


@query("histogram_peaks")
def histogram_peaks(spark, sf):
    return rounded(C.histogram_peaks(C.feature_histogram(grid_features(spark, sf), 6), 6, 20.0).select("drive", "frame", "rank", *C.BINS, "votes"))


# Fixed classes for the label operators, given in both engines.
_PEAKS = "pk AS (SELECT * FROM (VALUES (0, 1, 0.9e0, 0.1e0, 0.05e0, 0.4e0, 0.3e0), (1, 2, 0.3e0, 0.5e0, 0.1e0, 0.6e0, 0.7e0), (2, 3, 0.6e0, 0.8e0, 0.2e0, 0.3e0, 0.9e0)) v(rank, id, c0, c1, c2, c3, c4))"
_LABEL = f"""{_FV}, {_PEAKS}, nl AS (SELECT f.*, (f0-c0)**2 + (f1-c1)**2 + (f2-c2)**2 + (f3-c3)**2 + (f4-c4)**2 AS d2, pk.rank, pk.id AS label FROM fv f, pk
  QUALIFY row_number() OVER (PARTITION BY drive, frame, vx, vy, vz ORDER BY d2, pk.rank) = 1)"""


def _labelled(spark, sf):
    cells = grid_features(spark, sf)
    peaks = cells.select("drive", "frame").distinct().withColumn("_p", F.explode(F.array(*[
        F.struct(F.lit(i).alias("rank"), F.lit(i + 1).alias("id"), *[F.lit(v).alias(f"c{k}") for k, v in enumerate(c)])
        for i, c in enumerate(((0.9, 0.1, 0.05, 0.4, 0.3), (0.3, 0.5, 0.1, 0.6, 0.7), (0.6, 0.8, 0.2, 0.3, 0.9)))
    ]))).select("drive", "frame", "_p.*")
    return C.nearest_peak(cells, peaks)


@query("nearest_peak", f"WITH {_LABEL} SELECT drive, frame, vx, vy, vz, label FROM nl")
def nearest_peak(spark, sf):
    return _labelled(spark, sf).select("drive", "frame", *P.VOXEL, "label")


def _round_sql(src: str, out: str) -> str:
    return f"""{out}s AS (SELECT drive, frame, vx, vy, vz, l, sum(w) AS s FROM (
  SELECT e.drive, e.frame, e.vx, e.vy, e.vz, b.label AS l, e.w FROM we e JOIN {src} b ON b.drive = e.drive AND b.frame = e.frame AND b.vx = e.nx AND b.vy = e.ny AND b.vz = e.nz
  UNION ALL SELECT drive, frame, vx, vy, vz, label, 1e0 FROM {src}) GROUP BY ALL),
{out} AS (SELECT s.drive, s.frame, s.vx, s.vy, s.vz, s.l AS label FROM {out}s s JOIN {src} a USING (drive, frame, vx, vy, vz)
  QUALIFY row_number() OVER (PARTITION BY s.drive, s.frame, s.vx, s.vy, s.vz ORDER BY s DESC, CASE WHEN l = a.label THEN 0 ELSE 1 END, l) = 1)"""


_SMOOTH = f"""{_LABEL}, {_EDGES}, we AS (SELECT e.*, exp(-((a.f0-b.f0)**2 + (a.f1-b.f1)**2 + (a.f2-b.f2)**2 + (a.f3-b.f3)**2 + (a.f4-b.f4)**2) / 0.0625e0) AS w FROM ed e
  JOIN fv a ON a.drive = e.drive AND a.frame = e.frame AND a.vx = e.vx AND a.vy = e.vy AND a.vz = e.vz JOIN fv b ON b.drive = e.drive AND b.frame = e.frame AND b.vx = e.nx AND b.vy = e.ny AND b.vz = e.nz),
r0 AS (SELECT drive, frame, vx, vy, vz, label FROM nl), {_round_sql('r0', 'r1')}, {_round_sql('r1', 'r2')}, {_round_sql('r2', 'r3')}"""


def _smooth(spark, sf):
    cells = _labelled(spark, sf).persist()
    edges = C.cell_neighbors(cells)
    return cells, edges, C.propagate_labels(cells, edges)


@query("propagate_labels", f"WITH {_SMOOTH} SELECT drive, frame, vx, vy, vz, label FROM r3")
def propagate_labels(spark, sf):
    return _smooth(spark, sf)[2]


_COMP = f"""WITH RECURSIVE {_LABEL}, {_EDGES}, nd AS (SELECT drive, frame, vx, vy, vz, label, ((vx + 16777216) << 38) + ((vy + 16777216) << 13) + (vz + 4096) AS node FROM nl),
ee AS (SELECT a.drive, a.frame, a.node AS a, b.node AS b FROM ed e JOIN nd a ON a.drive = e.drive AND a.frame = e.frame AND a.vx = e.vx AND a.vy = e.vy AND a.vz = e.vz
  JOIN nd b ON b.drive = e.drive AND b.frame = e.frame AND b.vx = e.nx AND b.vy = e.ny AND b.vz = e.nz WHERE a.label = b.label),
rc AS (SELECT drive, frame, node, node AS seg FROM nd UNION SELECT e.drive, e.frame, e.b, c.seg FROM rc c JOIN ee e ON e.drive = c.drive AND e.frame = c.frame AND e.a = c.node WHERE c.seg < e.b)
SELECT n.drive, n.frame, n.vx, n.vy, n.vz, n.label, min(c.seg) AS segment FROM nd n JOIN rc c ON c.drive = n.drive AND c.frame = n.frame AND c.node = n.node GROUP BY ALL"""


@query("connected_components", _COMP)
def connected_components(spark, sf):
    cells = _labelled(spark, sf).select("drive", "frame", *P.VOXEL, "label").persist()
    return C.connected_components(cells, C.cell_neighbors(cells))


@query("label_points", f"WITH {_LABEL}, {POINTS.replace('pts AS', 'pt2 AS')} SELECT p.scan_id AS frame, p.idx, coalesce(n.label, 0) AS label FROM (SELECT *, {vkey(SIZE, height=HEIGHT)} FROM pt2) p LEFT JOIN nl n ON n.drive = p.drive AND n.frame = p.scan_id AND n.vx = p.vx AND n.vy = p.vy AND n.vz = p.vz")
def label_points(spark, sf):
    cells = _labelled(spark, sf).withColumn("segment", F.lit(0))
    return C.label_points(cell_points(spark, sf), cells, SIZE, HEIGHT).select("frame", "idx", "label")


@query("segment_cells")
def segment_cells(spark, sf):
    f = cell_plans.cell_features(cell_points(spark, sf), SIZE, HEIGHT, 4)
    cells, _ = cell_plans.segment_cells(f, cell_plans.SegmentParams(bins=6, min_votes=20.0, separation=2))
    return cells
