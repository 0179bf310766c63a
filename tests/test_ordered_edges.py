"""Ordered operators with null, NaN and tied order values and null keys: any chunk width gives the same rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.helpers import walk
from wayfold.functions import rigid
from wayfold.operators import association, cells, metrics, points, scan
from wayfold.operators.ordered import Chunks, asof, lag_row, row_numbers, running
from wayfold.plans import evaluate

KEYS, ORDER = ("drive",), ("stamp", "idx")


def rows_of(spark, seed, n=300):
    rng = np.random.default_rng(seed)
    stamp = np.round(rng.uniform(0, 20, n), 1)
    rows = [("a" if rng.random() < 0.7 else None, float(s), i, float(i)) for i, s in enumerate(stamp)]
    for i in range(0, n, 17):
        rows[i] = (rows[i][0], None if i % 2 else float("nan"), i, float(i))
    return spark.createDataFrame(rows, "drive string, stamp double, idx long, x double")


def same(a, b):
    a, b = (df.toPandas().sort_values("idx", ignore_index=True) for df in (a, b))
    pd.testing.assert_frame_equal(a, b)
    return len(a)


@pytest.mark.parametrize("rows", [20, 60])
def test_nulls_nans_and_ties_stay(spark, rows):
    df, other = rows_of(spark, 1), rows_of(spark, 2)
    chunks, whole = Chunks.plan(df, KEYS, "stamp", rows), Chunks()
    assert not chunks.whole
    for fn in (
        lambda c: row_numbers(df, KEYS, ORDER, "rn", c),
        lambda c: lag_row(df, KEYS, ORDER, ("idx",), c).select("idx", F.col("prev.idx").alias("p")),
        lambda c: running(df, KEYS, ORDER, {"s": ("sum", F.col("x")), "m": ("min", F.col("x")), "l": ("last", F.when(F.col("idx") % 9 == 0, F.col("x")))}, c),
        lambda c: asof(df, other, KEYS, "stamp", "stamp", ("idx",), tie=("idx",), chunks=c).select("idx", "prev.idx", F.col("next.idx").alias("n")).toDF("idx", "p", "n"),
    ):
        assert same(fn(chunks), fn(whole)) == 300


def test_one_key_of_equal_values_does_not_undo_the_others(spark):
    df = rows_of(spark, 3).unionByName(spark.range(500).selectExpr("'same' AS drive", "5.0D AS stamp", "id + 1000 AS idx", "0.0D AS x"))
    chunks = Chunks.plan(df, KEYS, "stamp", 50)
    assert not chunks.whole and same(row_numbers(df, KEYS, ORDER, "rn", chunks), row_numbers(df, KEYS, ORDER, "rn", Chunks())) == 800


def test_report_top_keeps_ties(spark):
    runs = spark.createDataFrame([("a", 5.0, 1.0, "p"), ("a", 5.0, 1.0, "q"), ("a", 4.0, 0.0, "r"), ("a", 9.0, 2.0, "s"), ("b", None, 1.0, "t")], "drive string, v double, stamp_start double, tag string")
    got = [(r.drive, r["rank"], r.tag) for r in evaluate.report_top(runs, "v", 3).orderBy("drive", "rank").collect()]
    assert got == [("a", 1, "s"), ("a", 2, "p"), ("a", 3, "q"), ("b", 1, "t")]


def test_cell_ids_are_unique_and_bounded(spark):
    far = spark.createDataFrame([(9_700_000, -9_700_000, 5), (9_700_000 - (1 << 22), -9_700_000, 5), (-1, 0, 0), (0, -1, 4095), (0, 0, -4096)], "vx long, vy long, vz long")
    ids = [r[0] for r in far.orderBy("vx", "vy", "vz").select(cells.cell_id()).collect()]
    assert ids == sorted(set(ids)) and len(ids) == 5
    with pytest.raises(Exception, match="does not fit"):
        spark.createDataFrame([(1 << 24, 0, 0)], "vx long, vy long, vz long").select(cells.cell_id()).collect()


def test_a_key_filter_reaches_both_scans(spark, tmp_path):
    for name, seed in (("est", 1), ("gt", 2)):
        spark.createDataFrame(pd.concat([walk(d, 40, seed) for d in "ab"])).write.parquet(f"{tmp_path}/{name}")
    est, gt = (spark.read.parquet(f"{tmp_path}/{n}") for n in ("est", "gt"))
    plan = association.associate_nearest(est, gt, 0.1, chunks=Chunks()).filter("drive = 'a'")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("EqualTo(drive,a)") == 2


def test_deskew_of_a_scan_across_a_hole(spark):
    traj = walk("a", 50, 5)
    traj = traj[(traj.stamp < 2) | (traj.stamp > 4)]
    pts = pd.DataFrame({"drive": "a", "scan_id": np.arange(60) // 20, "idx": np.arange(60), "t": np.linspace(-1, 9, 60), "x": 1.0, "y": 2.0, "z": 0.5})
    got = points.deskew(spark.createDataFrame(pts), spark.createDataFrame(traj)).toPandas().sort_values("idx")
    at = association.interpolate_clamped(spark.createDataFrame(pts), spark.createDataFrame(traj), "t", chunks=Chunks()).select("idx", "at.*").toPandas().sort_values("idx")

    def world(p, v):
        w, q = p[3], p[4:]
        return v + 2 * np.cross(q, np.cross(q, v) + w * v) + p[:3]

    fields = ["x", "y", "z", "qw", "qx", "qy", "qz"]
    poses = at[fields].to_numpy()
    for s in range(3):
        end = poses[s * 20 + 19]
        for i in range(s * 20, s * 20 + 20):
            here = world(poses[i], np.array([1.0, 2.0, 0.5]))
            assert np.allclose(world(end, got[["x", "y", "z"]].to_numpy()[i]), here, atol=1e-6)


def test_a_chunk_bounds_what_one_task_sorts(spark):
    """A key of 750,000 rows is cut into chunks of about 100,000."""
    rows = spark.range(750_000).selectExpr("0 as drive", "id * 0.5D as stamp")
    ch = Chunks.plan(rows, ("drive",), "stamp")
    sizes = ch.label(rows, ("drive",), "stamp").groupBy("drive", "_chunk").count().toPandas()["count"]
    assert not ch.whole and sizes.max() <= 110_000 and sizes.sum() == 750_000


def shown(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_chunk_tables_are_broadcast_and_shared_inputs_derived_once(spark):
    df = spark.range(2_000).selectExpr("'a' AS drive", "id * 0.1D AS stamp", "id AS idx", "id % 7 * 1.0D AS x")
    chunks = Chunks.plan(df, KEYS, "stamp", 100)
    assert chunks.pieces == 21  # the last row begins one
    for one in (row_numbers(df, KEYS, ORDER, "rn", chunks), lag_row(df, KEYS, ORDER, ("x",), chunks), running(df, KEYS, ORDER, {"s": ("sum", F.col("x"))}, chunks)):
        assert "BroadcastHashJoin" in shown(one) and "SortMergeJoin" not in shown(one)
    pose = "named_struct('x', x, 'y', x * 2, 'z', 0D, 'qw', 1D, 'qx', 0D, 'qy', 0D, 'qz', 0D)"
    pairs = df.selectExpr("drive", "stamp", "idx", f"{pose} AS est", f"{pose} AS gt")
    for fn in (metrics.kitti_segments, metrics.kitti_segments_legacy):
        assert "_step" not in shown(fn(pairs, lengths=(50.0,), chunks=chunks))
    scanned = scan.prefix_scan(df, KEYS, ORDER, ["x"], ["p"], np.add, chunks)
    assert shown(scanned).count("FlatMapGroupsInPandas") == 1  # the links only
    want = scan.prefix_scan(df, KEYS, ORDER, ["x"], ["p"], np.add, Chunks())
    assert same(scanned, want) == 2_000


def test_tables_not_asked_for_cost_nothing(spark, monkeypatch):
    def unwanted(*_, **__):
        raise AssertionError("made without being asked for")

    for name in ("ate_split", "rpe", "kitti_segments", "kitti_segments_legacy", "ate_planar"):
        monkeypatch.setattr(metrics, name, unwanted)
    poses = spark.createDataFrame(walk("a", 40, 1))
    pairs = association.associate_unique(poses, poses, 0.1)
    assert list(evaluate.compare_pairs(pairs, parts=("errors",))) == ["errors"]
    assert evaluate.evaluate_planar(poses, poses, parts=()) == (None, None)


def test_deskew_looks_points_up_in_their_scans_path(spark):
    """Paths in pieces of any size, rows of one stamp, points on a stamp, ahead of the path, behind it and without a time."""
    traj = walk("a", 60, 5)
    traj.loc[20:24, "stamp"] = traj.stamp[20]
    t = np.concatenate([np.linspace(-1, 12, 80), traj.stamp[15:30], [np.nan]])
    pts = pd.DataFrame({"drive": "a", "scan_id": np.arange(len(t)) % 2, "idx": np.arange(len(t)), "t": t, "x": 1.0, "y": 2.0, "z": 0.5})
    rows = spark.createDataFrame(pts).withColumn("t", F.nullif(F.nanvl("t", F.lit(-99.0)), F.lit(-99.0)))
    route = spark.createDataFrame(traj)
    ends = rows.groupBy("drive", "scan_id").agg(F.max("t").alias("t"))
    end = association.interpolate_clamped(ends, route, "t", chunks=Chunks(), into="end").select("drive", "scan_id", "end")
    at = association.interpolate_clamped(rows, route, "t", chunks=Chunks()).join(end, ["drive", "scan_id"])
    want = rigid.pose("end.").between(rigid.pose("at.")).apply(rigid.vec())
    want = at.select("idx", *[c.alias(a) for a, c in zip("xyz", want)]).toPandas().sort_values("idx")[["x", "y", "z"]]
    for size in (1, 3, 7, 64):
        out = points.deskew(rows, route, piece_rows=size)
        assert "Window" not in shown(out)
        got = out.toPandas().sort_values("idx")
        assert list(got.idx) == list(range(len(t))) and np.allclose(got[["x", "y", "z"]], want, atol=1e-9)
