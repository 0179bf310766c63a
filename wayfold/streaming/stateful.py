"""Structured Streaming operators with typed state per drive in the RocksDB state store.

A `Worker` holds the state of one operator: it opens its state variables and handles the rows of one drive. Two processors drive
workers. `Live` passes the rows of a micro-batch on in the order given, as a live run sees them. `InOrder` holds rows back
until the watermark has passed them, so a worker sees all rows of a drive in event-time order whatever the order of arrival
inside the watermark's delay. `BoundedWait` has event-time timers of its own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from ..functions import scans
from ..functions.rigid import POSE_FIELDS
from ..operators.metrics import KITTI_LENGTHS, KITTI_STEP
from ..operators.selection import match_ids, next_keyframe
from ..plans.registration import pose_inverse_np, se3_exp_np, se3_log_np
from ..schemas import BODY_FRAME_ERROR, KITTI_ERROR, columns

POSE = list(POSE_FIELDS)
Step = Callable[[pd.DataFrame, dict], tuple[pd.DataFrame, dict]]
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Event time is compared in milliseconds by timers and watermarks.
MS = 1000.0


def use_rocksdb(spark: SparkSession) -> None:
    """Typed state needs the RocksDB provider; a session that names another RocksDB-like one keeps it."""
    current = spark.conf.get("spark.sql.streaming.stateStore.providerClass", "")
    if "RocksDB" not in current:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


class Worker:
    """State and work of one operator for one drive at a time."""

    def open(self, handle) -> None:
        """Declares the state variables."""

    def step(self, rows: pd.DataFrame, clock: float) -> pd.DataFrame:
        """Output for further rows, which come sorted; `clock`: the watermark in seconds (minus infinity without one)."""
        raise NotImplementedError


class Remembering(Worker):
    """A worker from a step function whose memory is one typed row."""

    def __init__(self, step: Step, memory: str, ttl_s: float | None = None):
        self.rule, self.schema, self.ttl = step, columns_of(memory), None if ttl_s is None else int(ttl_s * MS)

    def open(self, handle) -> None:
        self.memory = handle.getValueState("memory", self.schema, self.ttl)

    def step(self, rows: pd.DataFrame, clock: float) -> pd.DataFrame:
        names = self.schema.names
        before = {k: v for k, v in zip(names, self.memory.get()) if v is not None} if self.memory.exists() else {}
        out, after = self.rule(rows, before)
        self.memory.update(tuple(after.get(n) for n in names))
        return out


_ARRAYS = {"doubles": T.ArrayType(T.DoubleType()), "longs": T.ArrayType(T.LongType())}


def columns_of(text: str) -> T.StructType:
    """As `columns`, with the types `doubles` and `longs` for arrays."""
    parts = [p.split() for p in text.split(",")]
    return T.StructType([T.StructField(n, _ARRAYS[t]) if t in _ARRAYS else columns(f"{n} {t}")[0] for n, t in parts])


def tuples(rows: pd.DataFrame, schema: T.StructType) -> list[tuple]:
    """Rows as the tuples of a state variable, nulls as None."""
    out = []
    for field in schema.fields:
        values = rows[field.name]
        whole = isinstance(field.dataType, T.IntegralType)
        out.append([None if v is None or v != v else int(v) if whole else v for v in values.tolist()])
    return list(zip(*out))


def frame_of(rows: list[tuple], names: Sequence[str]) -> pd.DataFrame:
    return pd.DataFrame.from_records(rows, columns=list(names))


class Live(StatefulProcessor):
    """Rows of a drive as they arrive, sorted inside a micro-batch."""

    def __init__(self, worker: Worker, names: Sequence[str], keys: Sequence[str], order: Sequence[str]):
        self.worker, self.names, self.keys, self.order = worker, list(names), list(keys), list(order)

    def init(self, handle) -> None:
        self.worker.open(handle)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        together = pd.concat(list(rows), ignore_index=True).sort_values(self.order, kind="stable", ignore_index=True)
        yield from self.keyed(key, self.worker.step(together, float("-inf")))

    def keyed(self, key, out: pd.DataFrame) -> Iterator[pd.DataFrame]:
        if len(out):
            out = out.assign(**dict(zip(self.keys, key, strict=True)))
            yield out[self.names]

    def close(self) -> None:
        pass


class InOrder(Live):
    """Rows of a drive in event-time order, once the watermark has passed them. What waits is a list state with one typed entry a
    row, as long as the watermark's delay; a timer stands at the first of them."""

    def __init__(self, worker: Worker, names: Sequence[str], keys: Sequence[str], order: Sequence[str], fields: T.StructType):
        super().__init__(worker, names, keys, order)
        self.fields = fields

    def init(self, handle) -> None:
        super().init(handle)
        self.handle, self.waiting = handle, handle.getListState("waiting", self.fields)

    def _wake(self, stamps: np.ndarray) -> None:
        if len(stamps):
            self.handle.registerTimer(int(np.floor(stamps.min() * MS)) + 1)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        arrived = pd.concat(list(rows), ignore_index=True)
        arrived = arrived[arrived["stamp"].notna()]
        if len(arrived):
            self.waiting.appendList(tuples(arrived, self.fields))
            self._wake(arrived["stamp"].to_numpy(float))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        clock = timerValues.getCurrentWatermarkInMs()
        held = frame_of(list(self.waiting.get()), self.fields.names)
        due = np.floor(held["stamp"].to_numpy(float) * MS) < clock
        if not due.any():
            return
        rest = held[~due]
        if len(rest):
            self.waiting.put(tuples(rest, self.fields))
            self._wake(rest["stamp"].to_numpy(float))
        else:
            self.waiting.clear()
        ready = held[due].sort_values(self.order, kind="stable", ignore_index=True)
        yield from self.keyed(key, self.worker.step(ready, clock / MS))


def run_live(
    stream: DataFrame, worker: Worker, schema: T.StructType, keys: Sequence[str] = ("drive",), order: Sequence[str] = ("stamp", "idx"),
    ttl_s: float | None = None,
) -> DataFrame:
    """`worker` over rows as they arrive. `ttl_s`: state that was not written for so long (wall clock) expires."""
    use_rocksdb(stream.sparkSession)
    processor = Live(worker, schema.names, keys, order)
    return stream.groupBy(*keys).transformWithStateInPandas(processor, schema, "Append", "None" if ttl_s is None else "ProcessingTime")


def timed(stream: DataFrame, delay_s: float) -> DataFrame:
    """Adds the event time `_ts` of `stamp` with its watermark."""
    micros = (F.col("stamp") * 1e6).cast("bigint")
    return stream.withColumn("_ts", F.timestamp_micros(micros)).withWatermark("_ts", f"{int(delay_s * MS)} milliseconds")


def run_in_order(
    stream: DataFrame, worker: Worker, schema: T.StructType, delay_s: float, keys: Sequence[str] = ("drive",),
    order: Sequence[str] = ("stamp", "idx"),
) -> DataFrame:
    """`worker` over rows in event-time order; rows later than `delay_s` behind the newest are dropped."""
    use_rocksdb(stream.sparkSession)
    fields = T.StructType([f for f in stream.schema.fields if f.name not in keys])
    processor = InOrder(worker, schema.names, keys, order, fields)
    return timed(stream, delay_s).groupBy(*keys).transformWithStateInPandas(processor, schema, "Append", "EventTime")


def _with_key(text: str, stream: DataFrame, keys: Sequence[str]) -> T.StructType:
    return T.StructType([*[stream.schema[k] for k in keys], *columns(text).fields])


# --- estimate / truth pairs ----------------------------------------------------------------------------

_SIDE = columns("stamp double, " + ", ".join(f"{c} double" for c in POSE))


class Pairing(Worker):
    """Truth rows with the estimate at their time, along the screw between its brackets, once an estimate has passed them.

    State: estimates from the last one before the oldest waiting truth, and truth that waits. Truth without an estimate inside the
    gate is dropped as soon as none can come any more, so both lists stay as short as the gate and the
    estimates' spacing, however long the stream is."""

    def __init__(self, max_dt: float, after: Worker | None = None):
        self.max_dt, self.after = max_dt, after

    def open(self, handle) -> None:
        self.tail, self.pending = handle.getListState("tail", _SIDE), handle.getListState("pending", _SIDE)
        if self.after is not None:
            self.after.open(handle)

    def step(self, rows: pd.DataFrame, clock: float) -> pd.DataFrame:
        est, truth = (
            np.array([*state.get(), *rows.loc[rows["kind"] == kind, _SIDE.names].itertuples(index=False, name=None)], float).reshape(-1, 8)
            for state, kind in ((self.tail, "est"), (self.pending, "gt"))
        )
        after = np.searchsorted(est[:, 0], truth[:, 0] - 1.0e-9, side="left")
        before = after - 1
        left = np.where(before >= 0, truth[:, 0] - est[before.clip(0), 0] if len(est) else np.inf, np.inf)
        passed = after < len(est)
        right = np.where(passed, (est[after.clip(max=len(est) - 1), 0] if len(est) else 0.0) - truth[:, 0], np.inf)
        found = passed & (np.minimum(left, right) <= self.max_dt)
        out = self._paired(est, truth[found], before[found], after[found])
        hopeless = (left > self.max_dt) & (truth[:, 0] + self.max_dt < clock - 2.0 / MS)
        wait = ~passed & ~hopeless
        self._keep(self.pending, truth[wait])
        first = max(int(np.searchsorted(est[:, 0], min(clock, truth[wait, 0].min(initial=np.inf)), side="left")) - 1, 0)
        self._keep(self.tail, est[first:])
        return out if self.after is None else self.after.step(out, clock) if len(out) else out

    @staticmethod
    def _keep(state, rows: np.ndarray) -> None:
        if len(rows):
            state.put([tuple(r) for r in rows.tolist()])
        else:
            state.clear()

    @staticmethod
    def _paired(est: np.ndarray, truth: np.ndarray, before: np.ndarray, after: np.ndarray) -> pd.DataFrame:
        a, b = est[np.where(before >= 0, before, after)], est[after]
        span = b[:, 0] - a[:, 0]
        share = np.where(span > 1.0e-9, (truth[:, 0] - a[:, 0]) / np.where(span > 1.0e-9, span, 1.0), 0.0)
        move = se3_log_np(scans.pose_mul(pose_inverse_np(a[:, 1:]), b[:, 1:])) if len(a) else np.zeros((0, 6))
        at = scans.pose_mul(a[:, 1:], se3_exp_np(share[:, None] * move)) if len(a) else np.zeros((0, 7))
        values = np.concatenate([truth, at], axis=1)
        return pd.DataFrame(values, columns=["stamp", *[f"{s}_{c}" for s in ("gt", "est") for c in POSE]])


PAIRS = ", ".join(["stamp double"] + [f"{s}_{c} double" for s in ("gt", "est") for c in POSE])


def sync_estimate_gt(
    stream: DataFrame, max_dt: float = 0.05, delay_s: float = 30.0, keys: Sequence[str] = ("drive",)
) -> DataFrame:
    """Pairs from one stream of both sides (`kind` is est or gt)."""
    return run_in_order(stream, Pairing(max_dt), _with_key(PAIRS, stream, keys), delay_s, keys)


class RunningKitti(Worker):
    """Running segment errors. Every start is open at a target distance until the route is beyond it. Targets of one length only grow,
    so the open starts of a length are a queue: a map from its running number to the start, of which only the head is looked
    at. A pair costs the starts that it opens and closes, whatever went before; closed segments live on as sums."""

    def __init__(self, lengths: Sequence[float] = KITTI_LENGTHS, stride: int = KITTI_STEP):
        self.lengths, self.stride = [float(n) for n in lengths], stride

    def open(self, handle) -> None:
        self.totals = handle.getValueState("totals", columns_of("count bigint, distance double, last doubles, sums doubles, n bigint, heads longs, tails longs"))
        self.starts = handle.getMapState("starts", columns("length int, number bigint"), columns_of("target double, poses doubles"))

    def step(self, pairs: pd.DataFrame, clock: float) -> pd.DataFrame:
        zero = [0] * len(self.lengths)
        count, distance, last, sums, n, heads, tails = self.totals.get() if self.totals.exists() else (0, 0.0, None, [0.0, 0.0], 0, zero, zero)
        heads, tails = list(heads), list(tails)
        poses = pairs[[f"{s}_{c}" for s in ("gt", "est") for c in POSE]].to_numpy(float)
        places = np.vstack([poses[:1, :3] if last is None else [last], poses[:, :3]])
        route = distance + np.cumsum(np.linalg.norm(np.diff(places, axis=0), axis=1))
        fresh = np.flatnonzero((count + np.arange(len(poses))) % self.stride == 0)
        first, final, nominal = [], [], []

        def close(start: np.ndarray, end: np.ndarray, length: float) -> None:
            first.append(start)
            final.append(poses[end])
            nominal.append(np.full(len(end), length))

        for k, length in enumerate(self.lengths):
            while heads[k] < tails[k]:
                target, start = self.starts.getValue((k, heads[k]))
                if not route[-1] > target:
                    break
                close(np.array([start]), np.searchsorted(route, [target], side="right"), length)
                self.starts.removeKey((k, heads[k]))
                heads[k] += 1
            end = np.searchsorted(route, route[fresh] + length, side="right")
            done = end < len(route)
            close(poses[fresh[done]], end[done], length)
            for i in fresh[~done].tolist():
                self.starts.updateValue((k, tails[k]), (float(route[i] + length), poses[i].tolist()))
                tails[k] += 1
        a, b, length = np.concatenate(first), np.concatenate(final), np.concatenate(nominal)
        if len(a):
            moved = [scans.pose_mul(pose_inverse_np(a[:, s]), b[:, s]) for s in (slice(0, 7), slice(7, 14))]
            error = scans.pose_mul(pose_inverse_np(moved[1]), moved[0])
            turn = 2.0 * np.arctan2(np.linalg.norm(error[:, 4:], axis=1), np.abs(error[:, 3]))
            sums = [sums[0] + float((np.linalg.norm(error[:, :3], axis=1) / length).sum()), sums[1] + float((turn / length).sum())]
        n += len(a)
        self.totals.update((count + len(poses), float(route[-1]), poses[-1, :3].tolist(), list(sums), n, heads, tails))
        if not len(a):
            return pd.DataFrame()
        return pd.DataFrame(
            {
                "stamp": [pairs["stamp"].iloc[-1]], "translation_percent": [100.0 * sums[0] / n],
                "rotation_deg_per_100m": [np.degrees(sums[1] / n) * 100.0], "num_segments": [n],
            }
        )


class BodyError(Worker):
    """Body-frame residuals; the first pair fixes the alignment and emits nothing."""

    def open(self, handle) -> None:
        self.alignment = handle.getValueState("alignment", columns_of("pose doubles"))

    def step(self, pairs: pd.DataFrame, clock: float) -> pd.DataFrame:
        gt, est = (pairs[[f"{s}_{c}" for c in POSE]].to_numpy(float) for s in ("gt", "est"))
        stamps = pairs["stamp"].to_numpy(float)
        if not self.alignment.exists():
            self.alignment.update((scans.pose_mul(gt[:1], pose_inverse_np(est[:1]))[0].tolist(),))
            gt, est, stamps = gt[1:], est[1:], stamps[1:]
        aligned = scans.pose_mul(np.repeat(np.array([self.alignment.get()[0]]), len(est), 0), est)
        back = gt[:, 3:] * np.array([1.0, -1.0, -1.0, -1.0])
        local = scans.quat_rotate(back, aligned[:, :3] - gt[:, :3]).reshape(-1, 3)
        return pd.DataFrame({"stamp": stamps, "longitudinal_m": local[:, 0], "lateral_m": local[:, 1], "vertical_m": local[:, 2]})


def _message(schema: T.StructType, stream: DataFrame, keys: Sequence[str]) -> T.StructType:
    return T.StructType([*[stream.schema[k] for k in keys], *[f for f in schema.fields if f.name != "drive"]])


def running_kitti(
    stream: DataFrame, max_dt: float = 0.05, delay_s: float = 30.0, lengths: Sequence[float] = KITTI_LENGTHS, keys: Sequence[str] = ("drive",),
) -> DataFrame:
    """KITTI error so far, emitted when the number of closed segments changes."""
    return run_in_order(stream, Pairing(max_dt, RunningKitti(lengths)), _message(KITTI_ERROR, stream, keys), delay_s, keys)


def running_body_error(
    stream: DataFrame, max_dt: float = 0.05, delay_s: float = 30.0, keys: Sequence[str] = ("drive",)
) -> DataFrame:
    return run_in_order(stream, Pairing(max_dt, BodyError()), _message(BODY_FRAME_ERROR, stream, keys), delay_s, keys)


def kitti_of_pairs(
    pairs: DataFrame, delay_s: float = 30.0, lengths: Sequence[float] = KITTI_LENGTHS, stride: int = KITTI_STEP, keys: Sequence[str] = ("drive",)
) -> DataFrame:
    """`running_kitti` over a stream of pairs (`stamp, idx, gt_*, est_*`)."""
    return run_in_order(pairs, RunningKitti(lengths, stride), _message(KITTI_ERROR, pairs, keys), delay_s, keys)


def body_error_of_pairs(pairs: DataFrame, delay_s: float = 30.0, keys: Sequence[str] = ("drive",)) -> DataFrame:
    """`running_body_error` over a stream of pairs (`stamp, idx, gt_*, est_*`)."""
    return run_in_order(pairs, BodyError(), _message(BODY_FRAME_ERROR, pairs, keys), delay_s, keys)


# --- order, retention, selection -----------------------------------------------------------------------


class KeepLast(Worker):
    """The last arrival (largest `idx`) of rows with equal stamps."""

    def open(self, handle) -> None:
        pass

    def step(self, rows: pd.DataFrame, clock: float) -> pd.DataFrame:
        same = rows["stamp"].diff().shift(-1).abs() < 1.0e-9
        return rows[~same]


def in_order(stream: DataFrame, delay_s: float = 30.0, keys: Sequence[str] = ("drive",)) -> DataFrame:
    """Rows in stamp order, the last of equal stamps kept, each once the watermark has passed it."""
    return run_in_order(stream, KeepLast(), stream.schema, delay_s, keys)


class TwistBuffer(Worker):
    """What the live twist buffer holds when a scan arrives: samples up to `horizon_s` before its newest; a sample from before the
    newest one empties it first. The state is a list with one entry a sample, never longer than the horizon."""

    def __init__(self, horizon_s: float):
        self.horizon = horizon_s

    def open(self, handle) -> None:
        self.held = handle.getListState("held", columns("stamp double"))

    def step(self, rows: pd.DataFrame, clock: float) -> pd.DataFrame:
        old = np.array([s for s, in self.held.get()], float)
        twist = (rows["kind"] == "twist").to_numpy()
        stamps = np.concatenate([old, rows.loc[twist, "stamp"].to_numpy(float)])
        run = np.cumsum(np.concatenate([[False], np.diff(stamps) < 0.0])) if len(stamps) else np.zeros(0, int)
        begin = np.searchsorted(run, run, side="left")  # where each sample's run of rising time begins
        oldest = np.array([max(b, int(np.searchsorted(stamps[b: i + 1], stamps[i] - self.horizon, side="left")) + b) for i, b in enumerate(begin)], int)
        if len(stamps):
            self.held.put([(float(s),) for s in stamps[oldest[-1]:]])
        last = len(old) + np.cumsum(twist) - 1  # newest sample when each row arrives
        last = last[~twist]
        have = last >= 0
        out = rows.loc[~twist, ["idx", "stamp"]].copy()
        out["held"] = np.where(have, last - oldest[last] + 1 if len(stamps) else 0, 0).astype("int64")
        out["oldest"] = np.where(have, stamps[oldest[last]] if len(stamps) else np.nan, np.nan)
        out["newest"] = np.where(have, stamps[last] if len(stamps) else np.nan, np.nan)
        return out


def twist_buffer(stream: DataFrame, horizon_s: float = 2.0, keys: Sequence[str] = ("drive",)) -> DataFrame:
    """State of the twist buffer at every scan, in order of arrival (`idx`). `kind` is twist or scan."""
    schema = _with_key("idx bigint, stamp double, held bigint, oldest double, newest double", stream, keys)
    return run_live(stream, TwistBuffer(horizon_s), schema, keys, ("idx",))


def stream_keyframes(
    stream: DataFrame, min_translation: float = 0.5, min_rotation: float = 0.05, keys: Sequence[str] = ("drive",)
) -> DataFrame:
    def step(rows: pd.DataFrame, m: dict):
        poses, kept, at = rows[POSE].to_numpy(float), [], 0
        last = m.get("last")
        if last is None:
            kept, last, at = [0], poses[0], 1
        last = np.asarray(last, float)
        while (hit := next_keyframe(poses, at, last, min_translation, min_rotation)) < len(poses):
            kept.append(hit)
            last, at = poses[hit], hit + 1
        return rows.iloc[kept].copy(), {"last": last.tolist()}

    return run_live(stream, Remembering(step, "last doubles"), stream.schema, keys)


def stream_decimate(stream: DataFrame, min_dt: float, keys: Sequence[str] = ("drive",), order: Sequence[str] = ("idx",)) -> DataFrame:
    def step(rows: pd.DataFrame, m: dict):
        last, kept, t, at = m.get("last"), [], rows["stamp"].to_numpy(float), 0
        while at < len(t):
            fits = np.ones(1, bool) if last is None else (t[at: at + 4096] - last >= min_dt) | (t[at: at + 4096] < last)
            if not fits.any():
                at += 4096
                continue
            kept.append(at + int(fits.argmax()))
            last, at = float(t[kept[-1]]), kept[-1] + 1
        return rows.iloc[kept].copy(), {"last": last}

    return run_live(stream, Remembering(step, "last double"), stream.schema, keys, order)


def stream_stable_ids(stream: DataFrame, reach: float, keys: Sequence[str] = ("drive",)) -> DataFrame:
    """Stable class ids over a stream of peaks (`frame, rank, c0..c4, votes`); whole frames per batch."""
    schema = T.StructType([*stream.schema.fields, T.StructField("id", T.IntegerType())])
    dims = [f"c{i}" for i in range(5)]

    def step(rows: pd.DataFrame, m: dict):
        rows = rows.assign(id=0)
        frame, known, ids = m.get("frame"), np.array(m.get("known", [])).reshape(-1, 5), list(m.get("ids", []))
        for number, part in rows.groupby("frame", sort=True):
            if frame is None or int(number) != frame + 1:
                known, ids = np.zeros((0, 5)), []
            centers = part[dims].to_numpy(float)
            ids = match_ids(centers, known, ids, reach)
            rows.loc[part.index, "id"] = ids
            known, frame = centers, int(number)
        rows["id"] = rows["id"].astype("int32")
        return rows, {"frame": frame, "known": known.reshape(-1).tolist(), "ids": [int(i) for i in ids]}

    return run_live(stream, Remembering(step, "frame bigint, known doubles, ids longs"), schema, keys, ("frame", "rank"))


def once_only(stream: DataFrame, keys: Sequence[str] = ("drive",)) -> DataFrame:
    """The first row of every key, once."""
    def step(rows: pd.DataFrame, m: dict):
        return (rows.iloc[:0] if m.get("sent") else rows.iloc[:1]).copy(), {"sent": True}

    return run_live(stream, Remembering(step, "sent boolean"), stream.schema, keys)


def latest_only(batch: DataFrame, keys: Sequence[str] = ("drive",)) -> DataFrame:
    """Mailbox for `foreachBatch`: the newest scan of a batch per key and how many it replaced."""
    cols = [c for c in batch.columns if c not in keys]
    return batch.groupBy(*keys).agg(
        F.max_by(F.struct(*cols), F.struct("stamp", "idx")).alias("_r"), (F.count(F.lit(1)) - 1).alias("replaced")
    ).select(*keys, "_r.*", "replaced")


#: A scan that waits.
_SCAN = columns("idx bigint, stamp double, scan_start double")


class BoundedWait(Live):
    """Scans that wait for the IMU, with a timer at the end of the first one's patience.

    A scan is `ready` when a sample covers its end and the buffer reaches back to its start. Both are facts that stay true, so it
    leaves at once and never enters the state. Else it leaves when the watermark passes scan end + `wait_s`: then all samples that
    could have come in time are there, and it is `behind` (no cover of the end) or `skipped` (the buffer does not reach back).
    A timer judges all scans that the watermark has passed together, so the state is read once a batch, not once a scan."""

    def __init__(self, wait_s: float, max_pair_dt: float, horizon_s: float, delay_s: float, names: Sequence[str], keys: Sequence[str]):
        super().__init__(Worker(), names, keys, ("stamp",))
        self.wait, self.pair, self.horizon, self.delay = wait_s, max_pair_dt, horizon_s, delay_s

    def init(self, handle) -> None:
        self.handle = handle
        self.samples = handle.getListState("samples", columns("stamp double"))
        self.scans = handle.getListState("scans", _SCAN)

    def _deadline(self, waiting: pd.DataFrame) -> np.ndarray:
        return np.floor((waiting["stamp"].to_numpy(float) + self.wait) * MS).astype("int64") + 2

    def _judged(self, imu: np.ndarray, waiting: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        """Whether the IMU covers each scan's end in time, and whether its buffer reaches back to the start."""
        end, start = waiting["stamp"].to_numpy(float), waiting["scan_start"].to_numpy(float)
        at = np.searchsorted(imu, end - 1.0e-3, side="left")
        back = np.searchsorted(imu, start + self.pair, side="right") - 1
        padded = np.append(imu, [np.inf, -np.inf])  # places -1 and len(imu)
        return padded[at] <= end + self.wait, np.where(back >= 0, padded[back], -np.inf) >= end - self.horizon

    def _waiting(self) -> pd.DataFrame:
        return frame_of(list(self.scans.get()), _SCAN.names)

    def _keep(self, waiting: pd.DataFrame) -> None:
        if len(waiting):
            self.scans.put(tuples(waiting, _SCAN))
            self.handle.registerTimer(int(self._deadline(waiting).min()))
        else:
            self.scans.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        arrived = pd.concat(list(rows), ignore_index=True)
        fresh = arrived.loc[arrived["kind"] == "scan", _SCAN.names]
        before = self._waiting()
        # A scan that comes again replaces the one that waits.
        waiting = (pd.concat([before, fresh], ignore_index=True) if len(before) else fresh).drop_duplicates("idx", keep="last")
        new = arrived.loc[arrived["kind"] == "imu", "stamp"].to_numpy(float)
        imu = np.unique(np.concatenate([np.array([s for s, in self.samples.get()], float), new]))
        covered, reaches = self._judged(imu, waiting)
        ready = covered & reaches
        if len(new):
            oldest = min(imu[-1] - self.delay, waiting.loc[~ready, "stamp"].min() if (~ready).any() else np.inf) - self.horizon
            self.samples.put([(s,) for s in imu[imu >= oldest].tolist()])
        if len(waiting):
            self._keep(waiting[~ready])
        yield from self.keyed(key, waiting[ready].assign(status="ready"))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        waiting = self._waiting()
        if not len(waiting):
            return
        clock = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        due = self._deadline(waiting) <= clock
        if not due.any():
            return
        over = waiting[due]
        imu = np.unique(np.array([s for s, in self.samples.get()], float))
        covered, reaches = self._judged(imu, over)
        self._keep(waiting[~due])
        yield from self.keyed(key, over.assign(status=np.where(~reaches, "skipped", np.where(covered, "ready", "behind"))))


def bounded_wait(
    stream: DataFrame, wait_s: float = 0.5, max_pair_dt: float = 0.05, horizon_s: float = 30.0, keys: Sequence[str] = ("drive",),
    delay_s: float = 0.5,
) -> DataFrame:
    """Scans released once the IMU covers them, or after `wait_s` of event time with what is there.

    One stream: `kind` imu (`stamp`) or scan (`stamp` = scan end, `scan_start`); rows of another kind only move the clock. Status:
    `ready`, `behind` (released without cover) or `skipped` (the IMU buffer starts after the scan).
    """
    use_rocksdb(stream.sparkSession)
    schema = _with_key("idx bigint, stamp double, scan_start double, status string", stream, keys)
    processor = BoundedWait(wait_s, max_pair_dt, horizon_s, delay_s, schema.names, keys)
    return timed(stream, delay_s).groupBy(*keys).transformWithStateInPandas(processor, schema, "Append", "EventTime")


# --- IMU and health ------------------------------------------------------------------------------------


def stream_dead_reckon(
    stream: DataFrame, samples: int = 100, gyro: float = 0.05, accel_dev: float = 0.5, gravity: float = 9.81,
    max_dt: float = 0.1, max_speed: float = 20.0, max_acceleration: float = 5.0, keys: Sequence[str] = ("drive",),
) -> DataFrame:
    """Collect, align on the first stationary window, then integrate; one output row per sample."""
    text = "idx bigint, stamp double, phase string, " + ", ".join(f"{c} double" for c in POSE)
    schema = _with_key(text + ", vx double, vy double, vz double, speed_clamped boolean", stream, keys)
    acc, gyr = ["ax", "ay", "az"], ["wx", "wy", "wz"]

    def align(a: np.ndarray, w: np.ndarray) -> dict:
        mean = a.mean(axis=0)
        norm = float(np.linalg.norm(mean))
        f = mean / norm
        if -f[2] < -1.0 + 1.0e-8:
            q = np.array([0.0, 0.0, -f[2], f[1]])
        else:
            q = np.array([1.0 - f[2], -f[1], f[0], 0.0])
        q = q / np.linalg.norm(q)
        g = norm if 8.0 <= norm <= 11.0 else gravity
        return {"q": q.tolist(), "bias": w.mean(axis=0).tolist(), "g": g, "s": [0.0, 0.0], "p": [0.0] * 3}

    def integrate(rows: pd.DataFrame, m: dict) -> pd.DataFrame:
        a, w = rows[acc].to_numpy(float), rows[gyr].to_numpy(float)
        t = rows["stamp"].to_numpy(float)
        dt = np.diff(np.concatenate([[m["t"]], t]))
        dt = np.where((dt > 0) & (dt <= max_dt), dt, 0.0)
        turns = scans.prefix(scans.quat_exp((w - np.array(m["bias"])) * dt[:, None]), scans.quat_mul)
        q = scans.quat_mul(np.repeat(np.array([m["q"]]), len(turns), 0), turns)
        q /= np.linalg.norm(q, axis=1, keepdims=True)
        back = q * np.array([1.0, -1.0, -1.0, -1.0])
        up = scans.quat_rotate(back, np.repeat([[0.0, 0.0, m["g"]]], len(q), 0))
        d = (a + up)[:, [0, 2]] * dt[:, None]
        most = max_acceleration * dt[:, None]
        bound = np.where(dt[:, None] > 1.0e-6, np.clip(d, -most, most), d)
        s = np.empty_like(d)
        for k in range(2):
            rule = np.stack([bound[:, k], np.full(len(d), -max_speed), np.full(len(d), max_speed)], axis=1)
            reach = scans.prefix(rule, scans.clamp_add)
            s[:, k] = np.clip(m["s"][k] + reach[:, 0], reach[:, 1], reach[:, 2])
        raw = np.vstack([[m["s"]], s[:-1]]) + d
        zero = np.zeros(len(q))
        p = np.array(m["p"]) + np.cumsum(scans.quat_rotate(q, np.stack([raw[:, 0], zero, raw[:, 1]], 1)) * dt[:, None], 0)
        v = scans.quat_rotate(q, np.stack([s[:, 0], zero, s[:, 1]], 1))
        m.update({"q": q[-1].tolist(), "s": s[-1].tolist(), "p": p[-1].tolist(), "t": float(t[-1])})
        out = pd.DataFrame(np.concatenate([p, q, v], axis=1), columns=[*POSE, "vx", "vy", "vz"])
        out["speed_clamped"] = (np.abs(raw).max(axis=1) > max_speed + 1.0e-3) & (dt > 0)
        return out.assign(idx=rows["idx"].to_numpy(), stamp=t, phase="tracking")

    def blank(rows: pd.DataFrame) -> pd.DataFrame:
        out = rows[["idx", "stamp"]].copy()
        out[[*POSE, "vx", "vy", "vz"]] = 0.0
        out["qw"] = 1.0
        return out.assign(phase="collecting", speed_clamped=False)

    def step(rows: pd.DataFrame, m: dict):
        parts, at = [], 0
        if "q" not in m:
            window = np.reshape(m.get("window", []), (-1, 6)).tolist()
            values = rows[acc + gyr].to_numpy(float)
            while at < len(rows) and "q" not in m:
                window = [*window, values[at].tolist()][-samples:]
                w = np.array(window)
                if len(window) == samples and (np.linalg.norm(w[:, 3:], axis=1) <= gyro).all():
                    off = np.linalg.norm(w[:, :3] - w[:, :3].mean(axis=0), axis=1)
                    if (off <= accel_dev).all():
                        m = {**align(w[:, :3], w[:, 3:]), "t": float(rows["stamp"].iloc[at])}
                        break
                at += 1
            if at:
                parts.append(blank(rows.iloc[:at]))
            if "q" not in m:
                m = {"window": np.ravel(window).tolist()}
        if at < len(rows):
            parts.append(integrate(rows.iloc[at:], m))
        return pd.concat(parts, ignore_index=True) if parts else pd.DataFrame(), m

    return run_live(stream, Remembering(step, "window doubles, q doubles, bias doubles, g double, s doubles, p doubles, t double"), schema, keys)


def _since(flag: np.ndarray, opens: np.ndarray, carried: int) -> np.ndarray:
    """Running count of `flag` since the last row where `opens` holds, that row included; before the first, on top of `carried`."""
    total = np.cumsum(flag)
    base = np.maximum.accumulate(np.where(opens, total - flag, -1))
    return np.where(base >= 0, total - base, total + carried)


def health_step(max_rejects: int = 5) -> Step:
    """Health as counts since the last accepted match, carried from batch to batch; the same closed form as `matchlog.health_states`."""
    limit = max(1, max_rejects)

    def step(rows: pd.DataFrame, m: dict):
        event = rows["event"]
        violation = event.isin(["KinematicViolation", "SpeedClamped"]).to_numpy()
        rejected, late, settled = ((event == n).to_numpy() for n in ("Rejected", "TimedOut", "Saturated"))
        accepted = ~(violation | rejected | late | settled)
        rejects = _since(violation | rejected, accepted, m.get("rejects", 0))
        timeouts = _since(late, accepted | rejected | settled, m.get("timeouts", 0))
        lost = _since(violation | (rejected & (rejects >= limit)), accepted, m.get("lost", 0))
        res = rows[["idx", "stamp", "event"]].assign(
            health=np.where(accepted, "healthy", np.where(lost > 0, "diverged", "degraded")),
            level=np.where(accepted, "OK", np.where(lost > 0, "ERROR", "WARN")), reject_streak=rejects, timeout_streak=timeouts,
        )
        return res, {"rejects": int(rejects[-1]), "timeouts": int(timeouts[-1]), "lost": int(lost[-1])}

    return step


def stream_health(stream: DataFrame, max_rejects: int = 5, keys: Sequence[str] = ("drive",)) -> DataFrame:
    """Live health with its diagnostic level."""
    text = "idx bigint, stamp double, event string, health string, level string, reject_streak bigint, timeout_streak bigint"
    worker = Remembering(health_step(max_rejects), "rejects bigint, timeouts bigint, lost bigint")
    return run_live(stream, worker, _with_key(text, stream, keys), keys)


def stream_skipped(stream: DataFrame, keys: Sequence[str] = ("drive",)) -> DataFrame:
    """Stage telemetry with the running count of lost scans."""
    schema = T.StructType([*stream.schema.fields, T.StructField("skipped_total", T.LongType())])

    def step(rows: pd.DataFrame, m: dict):
        lost = rows["skipped"].astype(bool) | (rows["timed_out"].astype(bool) & ~rows["applied"].astype(bool))
        total = lost.cumsum() + m.get("total", 0)
        return rows.assign(skipped_total=total.astype("int64")), {"total": int(total.iloc[-1])}

    return run_live(stream, Remembering(step, "total bigint"), schema, keys)


def retain(rows: DataFrame, horizon_s: float = 30.0, max_rows: int = 20_000, keys: Sequence[str] = ("drive",)) -> DataFrame:
    """Rows a live buffer would still hold: within the horizon of the newest, at most `max_rows`, at least 2."""
    from ..operators.ordered import row_numbers

    numbered = row_numbers(rows, keys, ("stamp", "idx"), "_rn")
    newest = numbered.groupBy(*keys).agg(F.max("stamp").alias("_newest"), F.max("_rn").alias("_total"))
    age = F.col("_total") - F.col("_rn")
    fresh = (F.col("stamp") >= F.col("_newest") - horizon_s) & (age < max_rows)
    return numbered.join(newest, list(keys)).filter(fresh | (age < 2)).drop("_rn", "_newest", "_total")
