import tempfile

import numpy as np
import pandas as pd
import pytest

from tests.helpers import POSE, walk
from tests.test_imu_and_logs import health_brute, reckon, samples
from wayfold.operators import align, association, metrics, selection
from wayfold.sources import streams as message_sinks
from wayfold.streaming import stateful


def stream_of(spark, frames):
    """One parquet file per micro-batch, in order."""
    folder = tempfile.mkdtemp(prefix="spark-")
    for i, f in enumerate(frames):
        spark.createDataFrame(f).coalesce(1).write.mode("append").parquet(folder)
        schema = spark.createDataFrame(f).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def drain(df, name):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name).toPandas()


def ticked(parts):
    """A last batch whose only row, of a drive of its own, moves the watermark past all others."""
    last = parts[-1].iloc[-1:].assign(drive="clock", stamp=max(p.stamp.max() for p in parts) + 1e5)
    return [*parts, last.assign(kind="tick") if "kind" in last else last]


def batches(rows, k):
    edges = np.linspace(0, len(rows), k + 1).astype(int)
    return [rows.iloc[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]


def test_health_stream_equals_batch(spark):
    rng = np.random.default_rng(3)
    names = ["Accepted", "Saturated", "Rejected", "TimedOut", "KinematicViolation"]
    rows = pd.DataFrame({"drive": "a", "stamp": np.arange(120.0), "idx": np.arange(120), "event": rng.choice(names, 120)})
    got = drain(stateful.stream_health(stream_of(spark, batches(rows, 3)), 3), "health").sort_values("idx")
    assert list(zip(got.health, got.reject_streak, got.timeout_streak, strict=True)) == health_brute(rows.event, 3)


def test_dead_reckoning_stream(spark):
    rows = samples("a", 200, 1)
    got = drain(stateful.stream_dead_reckon(stream_of(spark, batches(rows, 4)), 10, max_speed=5.0), "reckon").sort_values("idx")
    track = got[got.phase == "tracking"]
    want = reckon(rows, 10)
    assert np.allclose(track[["x", "y", "z", "vx", "vy", "vz"]].to_numpy(), want[:, :6], atol=1e-8)


def test_sync_and_kpis_equal_the_batch_operators(spark):
    gt = walk("a", 400, 1)
    rng = np.random.default_rng(2)
    est = gt.assign(stamp=gt.stamp + rng.uniform(0.0, 0.02, len(gt)), x=gt.x * 1.02)
    both = pd.concat([gt.assign(kind="gt"), est.assign(kind="est")]).sort_values("stamp")
    parts = ticked(batches(both[["drive", "idx", "kind", "stamp", *POSE]], 4))
    pairs = drain(stateful.sync_estimate_gt(stream_of(spark, parts), 0.2), "pairs").sort_values("stamp")
    want = association.interpolate_screw(spark.createDataFrame(est), spark.createDataFrame(gt), 0.2)
    ref = want.toPandas().sort_values("stamp")
    assert np.allclose(pairs.stamp, ref.stamp)
    assert np.allclose(pairs[["est_x", "est_y"]], [[e["x"], e["y"]] for e in ref.est])
    kitti = drain(stateful.running_kitti(stream_of(spark, parts), 0.2, lengths=(100.0, 200.0)), "kitti").sort_values("num_segments").iloc[-1]
    pooled = metrics.kitti_pooled(metrics.kitti_segments(want, "se3", (100.0, 200.0))).first()
    assert kitti.num_segments == pooled.num_segments
    assert kitti.translation_percent == pytest.approx(pooled.pooled_translation_percent)
    body = drain(stateful.running_body_error(stream_of(spark, parts), 0.2), "body").sort_values("stamp")
    al = metrics.body_frame_error(align.apply_se3(want, align.align_first_se3(want))).toPandas().sort_values("stamp")
    assert np.allclose(body.longitudinal_m, al.longitudinal_m[1:], atol=1e-7)


def test_pairs_whatever_the_order_of_arrival(spark):
    """Rows shuffled inside the watermark's delay give the pairs of the batch operator, and late ones do not."""
    gt = walk("a", 300, 5)
    est = gt.assign(stamp=gt.stamp + 0.03)
    both = pd.concat([gt.assign(kind="gt"), est.assign(kind="est")])[["drive", "idx", "kind", "stamp", *POSE]]
    rng = np.random.default_rng(1)
    both = both.iloc[np.argsort(both.stamp.to_numpy() + rng.uniform(0.0, 2.0, len(both)))]
    pairs = drain(stateful.sync_estimate_gt(stream_of(spark, ticked(batches(both, 5))), 0.2, delay_s=3.0), "shuffled").sort_values("stamp")
    ref = association.interpolate_screw(spark.createDataFrame(est), spark.createDataFrame(gt), 0.2).toPandas().sort_values("stamp")
    assert np.allclose(pairs.stamp, ref.stamp) and np.allclose(pairs.est_x, [e["x"] for e in ref.est])


def test_waiting_scans(spark):
    """Ready, behind (the IMU stops), skipped (the buffer begins too late), and a drive without any IMU."""
    imu = [("a", i, "imu", 0.1 * i, None) for i in range(20)] + [("b", i, "imu", 5.0 + 0.1 * i, None) for i in range(10)]
    scan = [("a", 100, "scan", 0.45, 0.4), ("a", 101, "scan", 1.85, 1.7), ("a", 102, "scan", 1.95, 1.9), ("a", 103, "scan", 9.0, 8.9),
            ("b", 104, "scan", 4.95, 4.9), ("b", 105, "scan", 5.3, 5.2), ("c", 106, "scan", 3.0, 2.9)]
    rows = pd.DataFrame(imu + scan, columns=["drive", "idx", "kind", "stamp", "scan_start"]).sort_values("stamp")
    out = drain(stateful.bounded_wait(stream_of(spark, ticked(batches(rows, 4))), 0.5, horizon_s=3.0), "wait").set_index("idx")
    assert out.status.to_dict() == {100: "ready", 101: "ready", 102: "behind", 103: "skipped", 104: "skipped", 105: "ready", 106: "skipped"}


def test_open_segments_are_a_queue(spark):
    """The state holds the open starts only, and the last total is that of the batch operator whatever the batches."""
    gt = walk("a", 900, 3)
    pairs = pd.DataFrame({"drive": "a", "idx": np.arange(len(gt)), "stamp": gt.stamp} | {f"gt_{c}": gt[c] for c in POSE} | {f"est_{c}": gt[c] * (1.02 if c in "xy" else 1.0) for c in POSE})
    struct = lambda s: "struct(" + ", ".join(f"{s}_{c} as {c}" for c in POSE) + ") as " + s
    table = spark.createDataFrame(pairs).selectExpr("drive", "stamp", "idx", struct("est"), struct("gt"))
    want = metrics.kitti_pooled(metrics.kitti_segments(table, "se3", (50.0, 120.0), step=7)).first()
    for k in (2, 9):
        last = drain(stateful.kitti_of_pairs(stream_of(spark, ticked(batches(pairs, k))), 1.0, (50.0, 120.0), 7), f"queue{k}").sort_values("num_segments").iloc[-1]
        assert last.num_segments == want.num_segments and last.translation_percent == pytest.approx(want.pooled_translation_percent)


def test_twist_buffer(spark):
    rows = pd.DataFrame(
        [("a", i, *r) for i, r in enumerate([("scan", 0.0), ("twist", 1.0), ("twist", 2.0), ("twist", 3.5), ("scan", 3.6), ("twist", 1.5), ("scan", 1.6), ("twist", 3.5), ("scan", 9.0)])],
        columns=["drive", "idx", "kind", "stamp"],
    )
    for k in (1, 4):
        out = drain(stateful.twist_buffer(stream_of(spark, batches(rows, k)), 2.0), f"twist{k}").sort_values("idx")
        assert out.held.tolist() == [0, 2, 1, 2] and out.oldest.tolist()[1:] == [2.0, 1.5, 1.5] and np.isnan(out.oldest.iloc[0])


def test_selections_and_ids_over_batches(spark):
    route = walk("a", 300, 8)
    for name, run, batch in (
        ("keys", lambda s: stateful.stream_keyframes(s, 3.0, 0.3), lambda d: selection.keyframes(d, 3.0, 0.3)),
        ("thin", lambda s: stateful.stream_decimate(s, 1.0), lambda d: selection.decimate(d, 1.0)),
    ):
        got = drain(run(stream_of(spark, batches(route, 4))), name)
        assert sorted(got.idx) == sorted(r.idx for r in batch(spark.createDataFrame(route)).collect())
    rng = np.random.default_rng(2)
    peaks = pd.DataFrame([("a", f, k, *rng.integers(0, 4, 5).astype(float), 1.0) for f in (1, 2, 3, 5, 6) for k in range(3)], columns=["drive", "frame", "rank", *[f"c{i}" for i in range(5)], "votes"])
    got = drain(stateful.stream_stable_ids(stream_of(spark, [peaks[peaks.frame == f] for f in (1, 2, 3, 5, 6)]), 3.0), "ids")
    want = selection.stable_ids(spark.createDataFrame(peaks), 3.0).toPandas()
    order = ["frame", "rank"]
    assert got.sort_values(order).id.tolist() == want.sort_values(order).id.tolist()


def test_once_and_in_order(spark):
    rows = pd.DataFrame({"drive": "a", "idx": [0, 1, 2, 3, 4], "stamp": [10.0, 11.0, 10.5, 11.0, 12.0]})
    parts = [rows.iloc[:2], rows.iloc[2:4], rows.iloc[4:]]
    assert drain(stateful.once_only(stream_of(spark, parts)), "once").idx.tolist() == [0]
    got = drain(stateful.in_order(stream_of(spark, ticked(parts)), delay_s=5.0), "ordered").sort_values("stamp")
    assert got[got.drive == "a"].idx.tolist() == [0, 2, 3, 4]


def test_message_sink_takes_a_batch_again(spark, tmp_path):
    """A repeated batch replaces itself, a new one adds; missing columns are null; unknown messages are refused."""
    rows = spark.createDataFrame([("a", 1.0, 0.5), ("a", 2.0, 0.25)], "drive string, stamp double, longitudinal_m double")
    sink = message_sinks.MessageSink(str(tmp_path), {"body_frame_error": message_sinks.body_frame_error, "pose_refine": message_sinks.pose_refine})
    for number in (0, 1, 1, 0):
        sink(rows.where(f"stamp = {number + 1}"), number)
    got = sink.read(spark, "body_frame_error").orderBy("stamp").collect()
    assert [tuple(r) for r in got] == [("a", 1.0, 0.5, None, None), ("a", 2.0, 0.25, None, None)]
    assert sink.read(spark, "pose_refine").count() == 2
    with pytest.raises(ValueError):
        message_sinks.MessageSink(str(tmp_path), {"other": message_sinks.pose_refine})


class _Handle:
    """State in memory that counts how often it is read."""

    def __init__(self):
        self.reads, self.timers, self.states = 0, set(), {}

    def _state(self, name, *schemas):
        handle = self

        class State:
            rows, entries = [], {}

            def get(self):
                handle.reads += 1
                return iter(list(self.rows))

            def put(self, rows):
                self.rows = list(rows)

            def iterator(self):
                handle.reads += 1
                return iter(list(self.entries.items()))

            def updateValue(self, key, value):
                self.entries = {**self.entries, key: value}

            def removeKey(self, key):
                self.entries = {k: v for k, v in self.entries.items() if k != key}

            def clear(self):
                self.rows, self.entries = [], {}

        return State()

    getListState = getMapState = _state

    def registerTimer(self, at):
        self.timers.add(at)


class _At:
    def __init__(self, ms):
        self.ms = ms

    def getExpiryTimeInMs(self):
        return self.ms

    getCurrentWatermarkInMs = getExpiryTimeInMs


def test_waiting_scans_are_judged_together(spark):
    """However many scans the watermark passes, the state is read a few times."""
    handle, n = _Handle(), 300
    scans = pd.DataFrame({"idx": np.arange(n), "kind": "scan", "stamp": 1.0 + np.arange(n), "scan_start": 0.9 + np.arange(n)})
    samples = pd.DataFrame({"idx": n, "kind": "imu", "stamp": 0.5 + np.arange(0, n, 3.0), "scan_start": np.nan})
    wait = stateful.BoundedWait(0.5, 0.05, 3.0, 0.5, ["drive", "idx", "stamp", "scan_start", "status"], ["drive"])
    wait.init(handle)
    out = list(wait.handleInputRows(("a",), iter([scans, samples]), _At(0)))
    clock = int((n + 100) * 1000)
    for at in sorted(handle.timers):
        out += wait.handleExpiredTimer(("a",), _At(clock), _At(at))
    assert sorted(pd.concat(out).idx) == list(range(n)) and handle.reads < 20


def test_a_replayed_step_is_bounded(spark, monkeypatch):
    """The steps of a replayed table grow in number, not in size, and lose no row."""
    from checks import streams

    monkeypatch.setattr(streams, "STEP_ROWS", 100)
    rows = spark.range(1000).selectExpr("id % 3 as drive", "id as idx", "cast((id * 7) % 1000 as double) as stamp")
    stream, sizes = streams.replay(rows, tick=False), []
    query = stream.writeStream.foreachBatch(lambda batch, _: sizes.append(batch.count())).trigger(availableNow=True).start()
    query.awaitTermination()
    assert sum(sizes) == 1000 and max(sizes) <= 150
