import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from checks import evaluation
from tests.helpers import circle, moved, walk, yaw_poses
from wayfold.formats import FILTER, ODOM
from wayfold.operators import align, association, metrics, sections
from wayfold.operators.ordered import Chunks, lag_row, row_numbers, running
from wayfold.plans import evaluate
from wayfold.sources import sinks


def pairs_of(spark, gt, est, max_dt=0.05, chunks=None):
    return association.associate_nearest(spark.createDataFrame(est), spark.createDataFrame(gt), max_dt, chunks=chunks)


def test_alignment_removes_a_frame_change(spark):
    gt = circle()
    pairs = pairs_of(spark, gt, moved(gt, np.radians(30), 10.0, -5.0))
    row = metrics.ate_planar(align.apply_se2(pairs, align.align_rigid_se2(pairs))).first()
    assert row.num_poses == 400 and row.rmse_xy_m < 1e-6 and row.rmse_yaw_deg < 1e-4
    row = metrics.ate_split(align.apply_se3(pairs, align.align_rigid_se3(pairs))).first()
    assert row.rmse_xyz_m < 1e-6 and row.rmse_roll_deg < 1e-4


def test_one_percent_drift_gives_ten_segments(spark):
    n = 1101
    gt = yaw_poses("a", np.arange(n) * 0.1, np.arange(n) * 0.1, 0.0, 0.0)
    est = gt.assign(x=gt.x * 1.01)
    segs = metrics.kitti_segments(pairs_of(spark, gt, est), "se3", (100.0,)).toPandas()
    assert len(segs) == 10
    assert np.allclose(segs.distance_end - segs.distance_start, 100.1)
    assert np.allclose(segs.translation_percent, 0.01 * 100.1)


def test_midpoint_interpolation(spark):
    est = yaw_poses("a", [0.0, 1.0], [0.0, 1.0], [0.0, 2.0], np.array([0.0, np.pi / 2]))
    gt = yaw_poses("a", [0.5], 0.0, 0.0, 0.0)
    row = association.interpolate_split(spark.createDataFrame(est), spark.createDataFrame(gt), 0.6).first()
    assert row.est.x == pytest.approx(0.5) and row.est.y == pytest.approx(1.0)
    assert 2 * np.degrees(np.arctan2(row.est.qz, row.est.qw)) == pytest.approx(45.0)


def test_nearest_takes_the_later_and_closest_pose_the_earlier(spark):
    gt = spark.createDataFrame(yaw_poses("a", [0.0, 1.0], [0.0, 1.0], 0.0, 0.0))
    est = spark.createDataFrame(yaw_poses("a", [0.5], 9.0, 0.0, 0.0))
    assert association.associate_nearest(est, gt, 0.5).first().gt_stamp == 1.0
    q = est.select("drive", F.col("stamp").alias("t"))
    assert association.closest_pose(q, gt).first().hit.stamp == 0.0


def test_body_frame_error(spark):
    gt = yaw_poses("a", [0.0, 1.0], [10.0, 10.0], [20.0, 20.0], np.pi / 2)
    est = gt.assign(x=gt.x - 0.5, y=gt.y + 1.0)
    row = metrics.body_frame_error(pairs_of(spark, gt, est)).first()
    assert row.longitudinal_m == pytest.approx(1.0) and row.lateral_m == pytest.approx(0.5)


def test_error_bump_is_one_span(spark):
    d = np.arange(301.0)
    rows = pd.DataFrame({"drive": "a", "stamp": d, "idx": np.arange(301), "distance": d, "horiz": np.where((d >= 100) & (d <= 140), 8.0, 0.0)})
    errors = spark.createDataFrame(rows)
    th = sections.section_threshold(errors)
    assert 5.0 <= th.first().threshold_m <= 8.0
    found = sections.error_spans(errors, th, 20.0).toPandas()
    assert len(found) == 1 and found.distance_start[0] == 100.0 and found.distance_end[0] == 140.0


@pytest.mark.parametrize("triple,tag", [((20, 18, 0.4, 5), "led"), ((1, 20, 15, 5), "ekf_diverged"), ((20, 20, 12, 5), "both")])
def test_blame(spark, triple, tag):
    a, b, c, d = (F.lit(float(v)) for v in triple)
    got = spark.range(1).select(sections.classify_error_source(a, b, c, d).alias("t")).first().t
    assert got.endswith(tag)


def small_chunks(df, on="stamp", rows=60):
    return Chunks.plan(df, ("drive",), on, rows)


def test_chunks_do_not_change_results(spark):
    """A drive with two thirds of all rows, cut into many chunks, against the plain window."""
    gt = pd.concat([walk("a", 900, 1), walk("b", 300, 2), walk("c", 5, 3)])
    est = gt.assign(stamp=gt.stamp + np.random.default_rng(4).uniform(-0.2, 0.2, len(gt)), x=gt.x * 1.01)
    g, e = spark.createDataFrame(gt), spark.createDataFrame(est)
    ch, whole = small_chunks(g), Chunks()
    assert not ch.whole

    def frame(df):
        out = df.toPandas()
        return out.sort_values([c for c in ("drive", "idx", "length_m", "first_rn") if c in out.columns]).reset_index(drop=True)

    for fn in (
        lambda c: association.associate_nearest(e, g, 0.1, chunks=c).select("drive", "idx", "gt_idx", "dt"),
        lambda c: association.interpolate_clamped(g.select("drive", "idx", (F.col("stamp") + 0.07).alias("t")), e, chunks=c).select("drive", "idx", "at.x", "at.qz"),
        lambda c: metrics.cumulative_distance(g, chunks=c).select("drive", "idx", "distance"),
        lambda c: row_numbers(g, ("drive",), ("stamp", "idx"), "rn", c).select("drive", "idx", "rn"),
        lambda c: lag_row(g, ("drive",), ("stamp", "idx"), ("idx",), c).select("drive", "idx", F.col("prev.idx").alias("p")),
        lambda c: running(g, ("drive",), ("stamp", "idx"), {"m": ("max", F.col("x")), "l": ("last", F.when(F.col("idx") % 50 == 0, F.col("y")))}, c).select("drive", "idx", "m", "l"),
        lambda c: metrics.kitti_segments(association.associate_unique(e, g, 0.1, chunks=c), "se2", (100.0, 200.0), chunks=c).select("drive", "length_m", "first_rn", "last_rn", "translation_percent"),
        lambda c: metrics.rpe(association.associate_unique(e, g, 0.1, chunks=c), 1.0, chunks=c).drop("idx"),
    ):
        a, b = frame(fn(ch)), frame(fn(whole))
        if "idx" not in a.columns and "first_rn" not in a.columns:
            a, b = a.sort_values("drive").reset_index(drop=True), b.sort_values("drive").reset_index(drop=True)
        pd.testing.assert_frame_equal(a, b, check_exact=False, rtol=1e-9, atol=1e-9)


def test_a_burst_is_split_again(spark):
    t = np.concatenate([np.linspace(0, 1000, 200), 500 + np.linspace(0, 0.01, 2000)])
    df = spark.createDataFrame(pd.DataFrame({"drive": "a", "stamp": t, "idx": np.arange(len(t))}))
    ch = Chunks.plan(df, ("drive",), "stamp", 100)
    assert ch.hot is not None
    sizes = ch.label(df, ("drive",), "stamp").groupBy("_chunk").count().toPandas()["count"]
    assert sizes.max() < 1000
    got = row_numbers(df, ("drive",), ("stamp", "idx"), "rn", ch).toPandas().sort_values(["stamp", "idx"])
    assert (got.rn.to_numpy() == np.arange(1, len(t) + 1)).all()


def test_quantiles_of_a_big_key_match_numpy(spark):
    rng = np.random.default_rng(0)
    v = np.concatenate([rng.lognormal(0, 2, 997), [3.0] * 50])
    df = spark.createDataFrame(pd.DataFrame({"drive": "a", "e": v}))
    row = metrics.exact_quantiles(df, ("drive",), "e", {"p50": 0.5, "p90": 0.9}, rows=100).first()
    assert row.p50 == pytest.approx(np.percentile(v, 50)) and row.p90 == pytest.approx(np.percentile(v, 90))


def test_worst_segments_against_brute_force(spark):
    rng = np.random.default_rng(5)
    first = np.arange(0, 400, 10)
    rows = pd.DataFrame({"drive": "a", "space": "se3", "length_m": 100.0, "first_rn": first, "last_rn": first + rng.integers(5, 60, len(first)), "translation_percent": rng.uniform(0, 5, len(first))})
    got = sections.worst_segments(spark.createDataFrame(rows), 4).toPandas().sort_values("rank")
    want = []
    for row in rows.sort_values("translation_percent", ascending=False).itertuples():
        if len(want) < 4 and all(row.last_rn < k.first_rn or k.last_rn < row.first_rn for k in want):
            want.append(row)
    assert got.first_rn.tolist() == [w.first_rn for w in want]


def test_worst_segments_come_from_few_contenders(spark):
    """Many segments, ties and missing errors: the same choice as over all rows, from a small part of them."""
    rng = np.random.default_rng(7)
    n = 20_000
    first = np.sort(rng.integers(0, 10 * n, n))
    bad = np.round(rng.uniform(0, 5, n), 2)
    bad[::97] = np.nan
    rows = pd.DataFrame({"drive": np.where(np.arange(n) % 3, "a", "b"), "space": "se3", "length_m": 100.0, "first_rn": first, "last_rn": first + rng.integers(5, 60, n), "translation_percent": bad})
    table = spark.createDataFrame(rows).repartition(3)
    got = sections.worst_segments(table, 6).toPandas().sort_values(["drive", "rank"])
    want = []
    for drive in ("a", "b"):
        kept = []
        for row in rows[(rows.drive == drive) & rows.translation_percent.notna()].sort_values(["translation_percent", "first_rn", "last_rn"], ascending=[False, True, True]).itertuples():
            if len(kept) < 6 and all(row.last_rn < k.first_rn or k.last_rn < row.first_rn for k in kept):
                kept.append(row)
        want += [(drive, i + 1, k.first_rn, k.last_rn) for i, k in enumerate(kept)]
    assert [tuple(r) for r in got[["drive", "rank", "first_rn", "last_rn"]].itertuples(index=False)] == want
    assert sections._contenders(table.where("not isnan(translation_percent)"), 6, ("drive", "space")).count() < n / 20
    assert sections.worst_segments(table.limit(0), 3).count() == 0


def test_quantiles_of_equal_values(spark):
    """Ten million rows of one value among others: counts per task meet, not the rows; small value chunks."""
    same = spark.range(0, 10_000_000, 1, 64).selectExpr("'a' AS drive", "2.5D AS e")
    other = spark.range(2_000_000).selectExpr("'a' AS drive", "(id % 2000) / 100.0D AS e")
    row = metrics.exact_quantiles(same.unionByName(other), ("drive",), "e", {"low": 0.01, "p50": 0.5, "p90": 0.9, "p99": 0.99}, rows=100).first()
    values = np.concatenate([np.full(10_000_000, 2.5), np.arange(2_000_000) % 2000 / 100.0])
    assert [row.low, row.p50, row.p90, row.p99] == pytest.approx(np.quantile(values, [0.01, 0.5, 0.9, 0.99]))


def test_two_estimators_compare_as_each_alone(spark):
    """Odometry and filter in one job give what each gives alone; signals stand on the filter's rows only."""
    gt = pd.concat([walk("a", 300, 1), walk("b", 260, 2)])
    near, far = moved(gt, 0.2, 3.0, 1.0), moved(gt, -0.1, -2.0, 5.0)
    truth = spark.createDataFrame(gt)
    pairs = {
        ODOM: association.associate_unique(spark.createDataFrame(near), truth),
        FILTER: association.interpolate_split(spark.createDataFrame(far.assign(stamp=far.stamp + 0.01)), truth),
    }
    route = metrics.cumulative_distance(truth).select(
        "drive", F.col("stamp").alias("gt_stamp"), F.col("idx").alias("gt_idx"), "distance"
    )
    both = evaluate.compare_estimators(pairs, route)
    alone = evaluate.compare_pairs(pairs[FILTER], route)
    order = ["drive", "alignment"]
    got = both["ate"].filter(F.col("estimator") == FILTER).toPandas().sort_values(order).reset_index(drop=True)
    want = alone["ate"].toPandas().sort_values(order).reset_index(drop=True)
    pd.testing.assert_frame_equal(got[want.columns], want, atol=1e-6)
    signals = spark.createDataFrame(gt[["drive", "idx"]].assign(**{
        c: 1.5 for c in ("err_yaw", *evaluate.SIGNALS) if c != "err_yaw_filter"
    }))
    table = sinks.pose_table(both["errors"], signals).toPandas()
    assert len(table.columns) == 56 and table.distance_m.notna().all()
    of_filter = table.estimator == FILTER
    assert (table[of_filter].bg_x == 1.5).all() and table[~of_filter].bg_x.isna().all() and 0 < of_filter.sum() < len(table)


def test_no_estimator_is_an_error():
    with pytest.raises(ValueError):
        evaluate.compare_estimators({})


def test_trajectory_window_query_lists_its_rows(spark, monkeypatch):
    """The query's figures are read off the rows themselves: rows taken away are missing from its counts."""
    real = evaluation.points.trajectory_window
    monkeypatch.setattr(evaluation.points, "trajectory_window", lambda *a, **k: real(*a, **k).filter("rn % 2 = 0"))
    out = evaluation.trajectory_window(spark, "/root/testdata/sf0.001")
    wrong = out.filter((F.col("n") != (F.col("last_rn") - F.col("first_rn")) / 2 + 1) | (F.col("first_rn") % 2 != 0)).count()
    assert out.count() > 0 and wrong == 0
