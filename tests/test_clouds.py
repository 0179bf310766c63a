import math
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from checks import clouds
from tests.helpers import yaw_poses
from wayfold import driver_views as V
from wayfold.operators import cells as C
from wayfold.operators import points as P
from wayfold.operators import surface as S
from wayfold.operators.selection import stable_ids
from wayfold.plans import cells as cell_plans
from wayfold.plans import registration
from wayfold.session import cut


def cloud(xyz, drive="a", scan=0, intensity=1.0):
    xyz = np.asarray(xyz, float)
    return pd.DataFrame({"drive": drive, "scan_id": scan, "idx": np.arange(len(xyz)), "t": 0.0, "x": xyz[:, 0], "y": xyz[:, 1], "z": xyz[:, 2], "intensity": np.broadcast_to(intensity, len(xyz)).astype(float)})


def corner():
    g = np.arange(17) * 0.25 + 0.01
    a, b = (m.ravel() for m in np.meshgrid(g, g))
    o = np.full(a.size, 0.01)
    return np.vstack([np.stack([a, b, o], 1), np.stack([a, o, b], 1), np.stack([o, a, b], 1)])


def test_deskew_to_scan_end(spark):
    traj = spark.createDataFrame(yaw_poses("a", [0.0, 1.0], [0.0, 1.0], 0.0, 0.0))
    pts = cloud([[0, 0, 0], [2, 0, 0]]).assign(t=[0.0, 1.0])
    out = P.deskew(spark.createDataFrame(pts), traj).toPandas().sort_values("idx")
    assert np.allclose(out[["x", "y", "z"]], [[-1, 0, 0], [2, 0, 0]])


def test_spaced_points_equal_the_sequential_rule(spark):
    rng = np.random.default_rng(0)
    pts = cloud(rng.uniform(-1, 1, (1500, 3)))
    got = P.voxel_spaced(spark.createDataFrame(pts), 1.0, 6).toPandas()
    kept = {}
    for r in pts.itertuples():
        key = (math.floor(r.x), math.floor(r.y), math.floor(r.z))
        have = kept.setdefault(key, [])
        if len(have) < 6 and all((r.x - h.x) ** 2 + (r.y - h.y) ** 2 + (r.z - h.z) ** 2 >= 1.0 / 6 for h in have):
            have.append(r)
    assert sorted(got.idx) == sorted(h.idx for v in kept.values() for h in v)


def test_random_grid_counts_and_repeatability(spark):
    rng = np.random.default_rng(1)
    df = spark.createDataFrame(cloud(rng.uniform(-2, 2, (3000, 3))))
    a = P.voxel_random(df, 1.0, 0.2, seed=3).toPandas()
    b = P.voxel_random(df.repartition(7), 1.0, 0.2, seed=3, slice_rows=50).toPandas()
    each = math.ceil(0.2 * 3000 / 64)
    counts = a.groupby([np.floor(a.x), np.floor(a.y), np.floor(a.z)]).size()
    assert counts.max() <= each and len(a) <= math.ceil(3000 * 0.2 * 1.2)
    assert sorted(a.idx) == sorted(b.idx)
    assert P.voxel_random(df, 1.0, 0.99).count() == 3000


def test_ndt_scores(spark):
    rng = np.random.default_rng(2)
    xyz = np.stack([rng.uniform(0.05, 0.45, 40), rng.uniform(0.05, 0.45, 40), rng.uniform(0.2, 0.202, 40)], 1)
    df = spark.createDataFrame(cloud(xyz))
    m = S.surface_map(df, 0.5)
    row = m.first()
    assert row.own_fit and row.valid and abs(row.n_z) > 0.999
    assert S.ndt_score(df, m, 0.5, min_hits=10).first().mean_cost < 7.81
    lifted = df.withColumn("z", df.z + 0.2)
    assert S.ndt_score(lifted, m, 0.5, min_hits=10).first().mean_cost > 7.81
    assert S.ndt_score(df, m.filter("false"), 0.5).first().mean_cost is None


def test_registration_recovers_a_shift(spark):
    pts = cloud(corner())
    df = spark.createDataFrame(pts)
    index = S.plane_index(df, S.surface_map(df, 1.0), 1.0).persist()
    seed = yaw_poses("a", [0.0], 0.12, -0.08, 0.01, 0.1).assign(scan_id=0)
    out = registration.register_scans(df, spark.createDataFrame(seed), index, 1.0, registration.RegisterParams(max_iterations=12)).first()
    assert np.allclose([out.x, out.y, out.z], 0.0, atol=5e-3) and out.converged and not out.saturated


def test_few_poses_are_broadcast_around_the_search(spark):
    """The same residuals, and points are dealt by voxel only, not by scan."""
    pts = pd.concat([cloud(corner(), scan=s) for s in (0, 1)])
    df = spark.createDataFrame(pts)
    index = S.plane_index(df, S.surface_map(df, 1.0), 1.0).persist()
    poses = pd.concat([yaw_poses("a", [0.0], 0.1, -0.05, 0.2, 0.1).assign(scan_id=s) for s in (0, 1, 7)])
    poses = cut(spark.createDataFrame(poses))
    made = {few: S.plane_residuals(df, poses, index, 1.0, 2.0, few_poses=few) for few in (False, True)}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        dealt = {few: out._jdf.queryExecution().executedPlan().toString() for few, out in made.items()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    by_scan = {few: len(re.findall(r"hashpartitioning\(drive#\d+, scan_id", plan)) for few, plan in dealt.items()}
    assert by_scan[False] and not by_scan[True]
    a, b = (made[few].toPandas().sort_values(["scan_id", "idx"], ignore_index=True) for few in (False, True))
    assert len(a) == len(pts) and a.usable.equals(b.usable) and a.usable.any()
    assert np.allclose(a[["residual", *S.JAC]], b[["residual", *S.JAC]], atol=1e-9, equal_nan=True)


def test_refine_keeps_fixed_scans_and_clamps(spark):
    pts = pd.concat([cloud(corner(), scan=i) for i in range(4)])
    poses = yaw_poses("a", np.arange(4.0), [0.0, 0.0, 0.05, 0.0], 0.0, 0.0).assign(scan_id=np.arange(4))
    poses["adjustable"] = [False, True, True, False]
    params = registration.RefineParams(voxel=1.0, outer_iterations=1, inner_iterations=1)
    out = registration.refine_scan_poses(spark.createDataFrame(pts), spark.createDataFrame(poses), params).toPandas().set_index("scan_id")
    assert out.shift_m[0] == 0 and out.shift_m[3] == 0
    assert out.shift_m.max() <= 0.15 + 1e-9 and abs(out.x[2]) < 0.05


def lattice(height=lambda x, y: 0.0 * x, intensity=lambda x, y: 20.0 + 0 * x):
    g = np.arange(0, 5, 0.1) + 0.05
    x, y = (m.ravel() for m in np.meshgrid(g, g))
    return cloud(np.stack([x, y, height(x, y)], 1), intensity=intensity(x, y)).rename(columns={"scan_id": "frame"})


def test_plane_has_no_curvature_and_a_step_has_a_laplacian(spark):
    flat = cell_plans.cell_features(spark.createDataFrame(lattice(lambda x, y: 0.01 + 0 * x)), 0.5, 0.5).toPandas()
    assert (flat.planarity > 0.9).all() and flat.curvature.max() < 1e-6 and flat.intensity_laplacian.max() < 1e-6
    step = cell_plans.cell_features(
        spark.createDataFrame(lattice(lambda x, y: 0.01 + 0 * x, lambda x, y: np.where(x < 2.5, 20.0, 60.0))), 0.5, 0.5
    ).toPandas()
    at_step = step.vx.isin([4, 5])
    assert step[at_step].intensity_laplacian.min() > 0.1 and step[~step.vx.isin([4, 5])].intensity_laplacian.max() < 1e-6


def test_one_plane_is_one_class_and_one_component(spark):
    f = cell_plans.cell_features(spark.createDataFrame(lattice(lambda x, y: 0.01 + 0 * x)), 0.5, 0.5)
    cells, peaks = cell_plans.segment_cells(f)
    assert peaks.count() == 1
    out = cells.toPandas()
    assert set(out.label) == {1} and out.segment.nunique() == 1


def test_components_of_a_long_chain(spark):
    n = 300
    rows = pd.DataFrame({"drive": "a", "frame": 0, "vx": np.r_[np.arange(n), np.arange(n) + 2 * n], "vy": 0, "vz": 0, "label": np.r_[np.ones(n, int), np.full(n, 2)]})
    df = spark.createDataFrame(rows)
    out = C.connected_components(df, C.cell_neighbors(df)).toPandas()
    assert out.segment.nunique() == 2 and out.groupby("label").segment.nunique().max() == 1


def test_ids_stay_with_their_peak(spark):
    base = np.array([[0.1] * 5, [0.5] * 5, [0.9] * 5])
    rows = []
    for frame in range(30):
        order = [0, 1, 2] if frame % 2 == 0 else [2, 1, 0]
        rows += [{"drive": "a", "frame": frame, "rank": k, **{f"c{i}": base[o][i] + 0.001 * frame for i in range(5)}, "votes": 100.0 - k, "_o": o} for k, o in enumerate(order)]
    df = spark.createDataFrame(pd.DataFrame(rows))
    from wayfold.operators.ordered import Chunks

    for ch in (Chunks(), Chunks.plan(df, ("drive",), "frame", 12)):
        out = stable_ids(df, 2 / 12, chunks=ch).toPandas()
        assert out.groupby("_o").id.nunique().max() == 1 and set(out.id) == {1, 2, 3}


def test_accumulated_points_leave_for_good(spark):
    frames = yaw_poses("a", np.arange(4.0), [0.0, 20.0, 0.0, 0.0], 0.0, 0.0).assign(frame=np.arange(4))
    pts = cloud([[1.0, 0.0, -0.5]]).drop(columns="scan_id").assign(frame=0)
    out = P.accumulate_in_view(spark.createDataFrame(pts), spark.createDataFrame(frames), 5.0, 5.0, 2.0).toPandas()
    assert out.view_frame.tolist() == [0]
    assert pytest.approx(out.bx[0]) == 1.0


def test_trajectory_window_bounds_of_long_overlapping_ranges(spark):
    """Bounds are one row per range; the rows are those between the bounds, equal stamps and ranges without a row included."""
    rng = np.random.default_rng(2)
    traj = yaw_poses("a", np.sort(rng.integers(0, 300, 900)).astype(float), np.arange(900.0), 0.0, 0.0)
    start = rng.uniform(-20, 320, 60)
    ranges = pd.DataFrame({"drive": "a", "range_id": np.arange(60), "from_stamp": start, "to_stamp": start + rng.choice([0.0, 0.5, 40.0, 400.0], 60)})
    stamps, want = traj.stamp.to_numpy(), {}
    for r in ranges.itertuples():
        before, after = np.searchsorted(stamps, r.from_stamp), np.searchsorted(stamps, r.to_stamp) + 1
        first, last = max(before, 1), min(after, 900)
        first, last = min(first, 900), max(last, min(first, 900))
        if first == last:
            first, last = (first, last + 1) if last < 900 else (first - 1, last)
        want[r.range_id] = (first, last)
    t, q = spark.createDataFrame(traj), spark.createDataFrame(ranges)
    bounds = P.window_bounds(t, q).toPandas()
    rows = P.trajectory_window(t, q).toPandas()
    assert {b.range_id: (b.first_rn, b.last_rn) for b in bounds.itertuples()} == want
    found = rows.groupby("range_id").rn.agg(["min", "max", "count", "nunique"])
    assert {i: (r["min"], r["max"]) for i, r in found.iterrows()} == want
    assert (found["count"] == found["max"] - found["min"] + 1).all() and (found["nunique"] == found["count"]).all()
    assert (rows.x == rows.rn - 1).all()


@pytest.mark.parametrize("most, size", [(3.0, 5.0), (2.0, 0.7)])
def test_nearest_points_of_a_cloud_of_any_density(most, size):
    """Against all distances: far and near clusters, equal distances, odd coordinates, voxels narrower than the search distance."""
    rng = np.random.default_rng(6)
    points = np.concatenate([rng.uniform(-9, 9, (200, 3)), rng.normal(0, 0.05, (600, 3)), np.round(rng.uniform(-6, 6, (200, 3))), [[np.nan, 0, 0]]])
    queries = np.concatenate([rng.uniform(-14, 14, (200, 3)), rng.normal(0, 0.1, (200, 3)), np.round(rng.uniform(-7, 7, (200, 3)) * 2) / 2, [[np.inf, 0, 0]]])
    with np.errstate(invalid="ignore"):
        d2 = sum((points[:, a] - queries[:, a:a + 1]) ** 2 for a in range(3))
        apart = (np.abs(np.floor(points / size) - np.floor(queries / size)[:, None]) > 1).any(axis=2)
    d2 = np.where((d2 < most * most) & ~apart, d2, np.inf)
    want = np.where(np.isfinite(d2.min(axis=1)), d2.argmin(axis=1), -1)
    assert (want >= 0).any() and (want < 0).any()
    assert S.nearest_points(points, queries, most, size).tolist() == want.tolist()


def test_register_scans_query_uses_every_map_point(spark):
    """As with a block index of all points, in tiles; not as with one point per 2.5 m."""
    sf = "/root/testdata/sf0.001"
    poses = V.scan_poses(spark, sf)
    world = P.merge_scan_points(V.points(spark, sf), poses)
    index = S.plane_index(world, S.surface_map(world, 5.0), 5.0)
    params = registration.RegisterParams(max_distance=3.0, max_iterations=4)
    want = registration.register_scans(V.points(spark, sf), poses.withColumn("z", F.col("z") + 0.1), index, 5.0, params).toPandas().set_index(["drive", "scan_id"]).sort_index()
    got = clouds.register_scans(spark, sf).toPandas().set_index(["drive", "scan_id"]).sort_index()
    assert len(got) == 32 and (got.correspondences == want.correspondences).all() and (got.iterations == want.iterations).all()
    assert np.allclose(got.z, want.z, atol=6e-4) and np.allclose(got.robust_cost, want.robust_cost, atol=6e-4)
