import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.helpers import POSE, walk, yaw_poses
from wayfold.functions import rigid, scans
from wayfold.operators import imu, matchlog, selection
from wayfold.operators.ordered import Chunks
from wayfold.plans import registration
from wayfold.plans.registration import se3_exp_np


def samples(drive, n, seed, still=20):
    rng = np.random.default_rng(seed)
    a = rng.normal(0, 0.02, (n, 3)) + [0.3, 0.1, -9.8]
    w = rng.normal(0, 0.005, (n, 3))
    a[still:, 0] += rng.normal(0, 6, n - still)
    w[still:] += rng.normal(0, 0.4, (n - still, 3))
    t = np.cumsum(np.where(rng.random(n) < 0.02, 0.5, 0.05))
    return pd.DataFrame({"drive": drive, "idx": np.arange(n), "stamp": t, "ax": a[:, 0], "ay": a[:, 1], "az": a[:, 2], "wx": w[:, 0], "wy": w[:, 1], "wz": w[:, 2]})


def reckon(rows, n, max_dt=0.1, max_speed=5.0, max_acc=5.0):
    """Sequential twin of the filter."""
    a, w, t = rows[["ax", "ay", "az"]].to_numpy(), rows[["wx", "wy", "wz"]].to_numpy(), rows.stamp.to_numpy()
    start = next(i for i in range(n - 1, len(rows)) if (np.linalg.norm(w[i - n + 1:i + 1], axis=1) <= 0.05).all()
                 and (np.linalg.norm(a[i - n + 1:i + 1] - a[i - n + 1:i + 1].mean(0), axis=1) <= 0.5).all())
    mean, bias = a[start - n + 1:start + 1].mean(0), w[start - n + 1:start + 1].mean(0)
    g = np.linalg.norm(mean)
    f = mean / g
    q = np.array([1 - f[2], -f[1], f[0], 0.0])
    q /= np.linalg.norm(q)
    p, v, out = np.zeros(3), np.zeros(3), []
    for i in range(start, len(rows)):
        dt = t[i] - t[i - 1]
        flag = False
        if i > start and 0 < dt <= max_dt:
            q = scans.quat_mul(q, scans.quat_exp((w[i] - bias) * dt))
            back = q * [1, -1, -1, -1]
            raw = v + (a[i] + scans.quat_rotate(back, np.array([0, 0, g]))) * dt
            raw[1] = 0.0
            p = p + scans.quat_rotate(q, raw) * dt
            flag = abs(raw[0]) > max_speed + 1e-3 or abs(raw[2]) > max_speed + 1e-3
            new = np.clip(raw, -max_speed, max_speed)
            new = np.clip(np.clip(new, v - max_acc * dt, v + max_acc * dt), -max_speed, max_speed)
            v = np.array([new[0], 0.0, new[2]])
        out.append([*p, *scans.quat_rotate(q, v), flag])
    return np.array(out, float)


def test_dead_reckoning_equals_the_sequential_filter(spark):
    both = pd.concat([samples("a", 700, 1), samples("b", 120, 2)])
    df = spark.createDataFrame(both)
    for rows in (10**6, 70):
        ch = Chunks.plan(df, ("drive",), "stamp", rows)
        first = imu.stationary_windows(df, 10, chunks=ch, first_only=True, block=64)
        got = imu.dead_reckon(df, imu.window_alignment(df, first, 10, chunks=ch), max_speed=5.0, chunks=ch).toPandas()
        for drive, part in both.groupby("drive"):
            mine = got[got.drive == drive].sort_values("idx")
            want = reckon(part, 10)
            assert len(mine) == len(want)
            assert np.allclose(mine[["x", "y", "z", "vx", "vy", "vz"]].to_numpy(), want[:, :6], atol=1e-7)
            assert (mine.speed_clamped.to_numpy() == want[:, 6].astype(bool)).all()


def test_tilted_gravity(spark):
    rows = pd.DataFrame({"drive": "a", "ax": 0.0, "ay": [-9.81] * 10, "az": 0.0, "wx": 0.0, "wy": 0.0, "wz": 0.0})
    r = imu.stationary_alignment(spark.createDataFrame(rows)).first()
    up = scans.quat_rotate(np.array([r.qw, r.qx, r.qy, r.qz]), np.array([0.0, 1.0, 0.0]))
    assert np.allclose(up, [0, 0, 1]) and r.gravity == pytest.approx(9.81)


def twist_brute(tw, t0, t1, gap):
    s = tw.stamp.to_numpy()
    if s[0] > t0 + gap or s[-1] + gap < t1:
        return None
    a = max(int(np.searchsorted(s, t0, side="right")) - 1, 0)
    b = max(int(np.searchsorted(s, t1, side="right")) - 1, a)
    if any(s[k + 1] - s[k] > gap + 1e-9 for k in range(a, b)) or t1 - s[b] > gap + 1e-9:
        return None
    pose = np.array([[0, 0, 0, 1.0, 0, 0, 0]])
    edges = [t0, *s[a + 1:b + 1], t1]
    for k in range(len(edges) - 1):
        xi = tw[["vx", "vy", "vz", "wx", "wy", "wz"]].to_numpy()[a + k] * (edges[k + 1] - edges[k])
        pose = scans.pose_mul(pose, se3_exp_np(xi[None]))
    return pose[0]


def test_twist_between_against_brute_force(spark):
    rng = np.random.default_rng(7)
    n = 300
    tw = pd.DataFrame({"drive": "a", "idx": np.arange(n), "stamp": np.cumsum(rng.choice([0.02, 0.05, 0.2], n, p=[0.6, 0.35, 0.05]))})
    for c in ("vx", "vy", "vz", "wx", "wy", "wz"):
        tw[c] = rng.normal(0, 2, n)
    t0 = rng.uniform(0, tw.stamp.max(), 60)
    iv = pd.DataFrame({"drive": "a", "k": np.arange(60), "t0": t0, "t1": t0 + rng.uniform(0, 0.4, 60)})
    df = spark.createDataFrame(tw)
    for rows in (10**6, 40):
        ch = Chunks.plan(df, ("drive",), "stamp", rows)
        got = imu.twist_between(df, spark.createDataFrame(iv), 0.06, chunks=ch).toPandas().set_index("k")
        covered = 0
        for r in iv.itertuples():
            want = twist_brute(tw, r.t0, r.t1, 0.06)
            mine = got.loc[r.k, "motion"]
            assert (mine is None) == (want is None)
            if want is not None:
                covered += 1
                assert np.allclose([mine[c] for c in POSE], want, atol=1e-8)
        assert 5 < covered < 60


def test_keyframes_and_decimation_match_the_sequential_rule(spark):
    both = pd.concat([walk("a", 800, 1), walk("b", 60, 2)])
    df = spark.createDataFrame(both)
    for rows in (10**6, 50):
        ch = Chunks.plan(df, ("drive",), "stamp", rows)
        got = selection.keyframes(df, 3.0, 0.3, chunks=ch).toPandas()
        thin = selection.decimate(df, 1.0, chunks=ch, order="stamp").toPandas()
        for drive, part in both.groupby("drive"):
            kept, spaced = [], []
            for r in part.itertuples():
                yaw = 2 * np.arctan2(r.qz, r.qw)
                if not kept or np.hypot(r.x - kept[-1][1], r.y - kept[-1][2]) >= 3.0 or abs((yaw - kept[-1][3] + np.pi) % (2 * np.pi) - np.pi) >= 0.3:
                    kept.append((r.idx, r.x, r.y, yaw))
                if not spaced or r.stamp - spaced[-1][1] >= 1.0:
                    spaced.append((r.idx, r.stamp))
            assert sorted(got[got.drive == drive].idx) == [k[0] for k in kept]
            assert sorted(thin[thin.drive == drive].idx) == [k[0] for k in spaced]


def health_brute(events, limit):
    health, rejects, timeouts, out = "healthy", 0, 0, []
    for e in events:
        stuck = health == "diverged"
        if e in ("KinematicViolation", "SpeedClamped"):
            health, rejects = "diverged", rejects + 1
        elif e == "TimedOut":
            health, timeouts = ("diverged" if stuck else "degraded"), timeouts + 1
        elif e == "Rejected":
            rejects, timeouts = rejects + 1, 0
            health = "diverged" if stuck or rejects >= limit else "degraded"
        elif e == "Saturated":
            health, timeouts = ("diverged" if stuck else "degraded"), 0
        else:
            health, rejects, timeouts = "healthy", 0, 0
        out.append((health, rejects, timeouts))
    return out


def test_health_closed_form(spark):
    rng = np.random.default_rng(3)
    names = ["Accepted", "Saturated", "Rejected", "TimedOut", "KinematicViolation", "SpeedClamped"]
    rows = pd.DataFrame({"drive": "a", "stamp": np.arange(600.0), "idx": np.arange(600), "event": rng.choice(names, 600, p=[0.2, 0.2, 0.3, 0.2, 0.05, 0.05])})
    df = spark.createDataFrame(rows)
    for ch in (Chunks(), Chunks.plan(df, ("drive",), "stamp", 50)):
        got = matchlog.health_states(df, 3, chunks=ch).toPandas().sort_values("idx")
        mine = list(zip(got.health, got.reject_streak, got.timeout_streak, strict=True))
        assert mine == health_brute(rows.event, 3)


def test_step_limits(spark):
    rows = [(30.0, 0.0, 1.0, False), (0.0, 2.0, 0.5, False), (1.0, 0.0, 0.1, True), (50.0, 0.0, 0.0, True), (float("nan"), 0.0, 1.0, False)]
    df = spark.createDataFrame(rows, "d double, y double, dt double, want boolean")
    out = df.select("want", matchlog.step_within_limits(F.col("d"), F.col("y"), F.col("dt")).alias("got")).collect()
    assert all(r.got == r.want for r in out)


def test_blend_ramps_and_holds(spark):
    poses = yaw_poses("a", np.arange(8.0), np.arange(8.0), 0.0, 0.0)
    c = pd.DataFrame({"drive": ["a"], "seq": [1], "since": [1.0], "scan": [3.0], "tip": [5.0]})
    delta = F.struct(*[F.lit(v).alias(n) for n, v in zip(POSE, (0.4, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0), strict=True)])
    out = imu.blend_corrections(spark.createDataFrame(poses), spark.createDataFrame(c).withColumn("delta", delta)).toPandas().sort_values("idx")
    assert np.allclose(out.x - np.arange(8.0), [0, 0, 0.2, 0.4, 0.4, 0.4, 0, 0])


def test_selection_hops_over_chunks_without_a_kept_row(spark):
    """A vehicle that stands still for many chunks, stamps that go back, and rows of which nothing is ever kept again."""
    rng = np.random.default_rng(4)
    parts = [walk("a", 150, 3), walk("b", 90, 4)]
    still = pd.concat([parts[0].iloc[[-1]]] * 200, ignore_index=True)
    parts.insert(1, still.assign(stamp=still.stamp.iloc[0] + 0.1 * np.arange(1, 201), x=still.x + 0.01 * rng.uniform(size=200)))
    tail = parts[0].assign(stamp=parts[0].stamp + parts[1].stamp.max())
    route = pd.concat([*parts[:2], tail, parts[1].assign(stamp=parts[1].stamp + 1000.0), parts[2]], ignore_index=True)
    route["idx"] = np.arange(len(route))
    df = spark.createDataFrame(route)
    ch = Chunks.plan(df, ("drive",), "stamp", 20)
    got = selection.keyframes(df, 3.0, 0.3, chunks=ch).toPandas()
    back = route.assign(stamp=np.where(route.idx % 131 > 100, route.stamp - 40.0, route.stamp))
    thin = selection.decimate(spark.createDataFrame(back), 2.0, chunks=Chunks.plan(spark.createDataFrame(back), ("drive",), "idx", 20)).toPandas()
    assert not ch.whole
    for drive in ("a", "b"):
        kept, spaced = [], []
        for r in route[route.drive == drive].sort_values(["stamp", "idx"]).itertuples():
            pose = np.array([r.x, r.y, r.z, r.qw, r.qx, r.qy, r.qz])
            if not kept or selection._far(pose[None], kept[-1][1], 3.0, 0.3)[0]:
                kept.append((r.idx, pose))
        for r in back[back.drive == drive].sort_values("idx").itertuples():
            if not spaced or r.stamp - spaced[-1][1] >= 2.0 or r.stamp < spaced[-1][1]:
                spaced.append((r.idx, r.stamp))
        assert sorted(got[got.drive == drive].idx) == [k[0] for k in kept]
        assert sorted(thin[thin.drive == drive].idx) == [k[0] for k in spaced]


def test_corrections_are_limited(spark):
    """Along the vehicle only, and to a length in both parts of the tangent."""
    rows = pd.concat([
        yaw_poses("p", [0.0], 1.0, 2.0, np.pi / 2).add_prefix("p_"), yaw_poses("f", [0.0], 0.5, 5.0, np.pi / 2 + 0.4, 0.1).add_prefix("f_"),
    ], axis=1)
    rows = spark.createDataFrame(rows)
    df = rows.select(*[F.struct(*[F.col(f"{s}_{n}").alias(n) for n in POSE]).alias(s) for s in "pf"])
    p, f = rigid.pose("p."), rigid.pose("f.")
    df = df.withColumn("held", rigid.limit_forward(p, f, 1.0).struct())
    df = df.withColumns({"back": p.between(rigid.pose("held.")).struct(), "free": rigid.limit_forward(p, f, -1.0).struct()})
    row = df.first()
    assert np.allclose([row.back.x, row.back.y, row.back.z], [1.0, 0.5, 0.1]) and np.isclose(2 * np.arcsin(row.back.qz), 0.4)
    assert np.allclose(list(row.free), list(row.f))
    for most, turn in ((9.0, 9.0), (0.5, 0.1)):
        out = rigid.stage_clamp(df.select("p", "f"), f, p, most, turn, "out")
        out = rigid.stage_se3_log(out.withColumn("d", p.between(rigid.pose("out.")).struct()), rigid.pose("d."), "xi").first()
        moved, turned = np.linalg.norm(list(out.xi)[:3]), np.linalg.norm(list(out.xi)[3:])
        if most > 1:
            assert np.allclose(list(out.out), list(row.f)) and np.isclose(turned, 0.4)
        else:
            assert np.isclose(moved, 0.5) and np.isclose(turned, 0.1)


def test_blend_in_order_without_pairs(spark):
    """Many overlapping corrections, in `seq` order whatever their times, and no table of pose-correction pairs."""
    rng = np.random.default_rng(6)
    poses = walk("a", 60, 2).assign(label="as it was", count=np.arange(60))
    n, last = 40, poses.stamp.max()
    since = rng.uniform(-1, last, n)
    c = pd.DataFrame({"drive": "a", "seq": rng.permutation(n), "since": since, "scan": since + rng.choice([0.0, 1.0, 3.0], n), "angle": rng.normal(0, 0.4, n), "step": rng.normal(0, 1.0, n)})
    c["tip"] = c.scan + rng.uniform(0, 3, n)
    zero = F.lit(0.0)
    delta = rigid.Pose(rigid.Vec(F.col("step"), zero, F.col("step") / 2), rigid.yaw_quat(F.col("angle")))
    frame = imu.blend_corrections(spark.createDataFrame(poses), spark.createDataFrame(c).withColumn("delta", delta.struct()).drop("angle", "step"), bucket_s=1.5)
    assert "collect_list" not in frame._jdf.queryExecution().toString()
    got = frame.toPandas().sort_values("idx")
    want = poses[POSE].to_numpy(float)
    for r in c.sort_values("seq").itertuples():
        pose = np.array([[r.step, 0.0, r.step / 2, np.cos(r.angle / 2), 0.0, 0.0, np.sin(r.angle / 2)]])
        xi = registration.se3_log_np(pose)
        for k, t in enumerate(poses.stamp):
            if r.since < t <= r.tip:
                alpha = (t - r.since) / (r.scan - r.since) if t < r.scan else 1.0
                want[k] = scans.pose_mul(want[k: k + 1], registration.se3_exp_np(alpha * xi))[0]
    assert np.allclose(got[POSE].to_numpy(float), want) and (got.label == "as it was").all() and got["count"].tolist() == list(range(60))
