"""Point-cloud operators. One row per return: `drive, scan_id, idx, t, x, y, z, intensity`."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import rigid
from ..functions.staging import pinned
from ..session import cut
from .association import SAMPLE, interpolate_clamped
from .ordered import BROADCAST_ROWS, Chunks, asof, row_numbers

SCAN = ("drive", "scan_id")
VOXEL = ("vx", "vy", "vz")


# --- filters -------------------------------------------------------------------------------------------


def crop_box(points: DataFrame, half_x: float, half_y: float) -> DataFrame:
    """Inside the box around the sensor, borders included, any height; a missing intensity becomes 0."""
    return points.filter((F.abs("x") <= half_x) & (F.abs("y") <= half_y)).withColumn(
        "intensity", F.coalesce("intensity", F.lit(0.0))
    )


def below_box(v: rigid.Vec, longitudinal: float, lateral: float, z_below: float) -> Column:
    return (
        (F.abs(v.x) <= longitudinal) & (F.abs(v.y) <= lateral) & (v.z <= 0.0) & (v.z >= -float(z_below))
    )


def crop_below(points: DataFrame, longitudinal: float, lateral: float, z_below: float) -> DataFrame:
    """Inside the box that reaches `z_below` under the body origin."""
    return points.filter(below_box(rigid.vec(), longitudinal, lateral, z_below))


def finite_in_range(points: DataFrame, min_range: float = 0.0, max_range: float = 0.0) -> DataFrame:
    """Finite coordinates and time, and range inside [min, max]; `max_range` 0 means no upper bound."""
    ok = reduce(lambda a, b: a & b, [F.col(c).isNotNull() & (F.abs(c) < float("inf")) for c in ("x", "y", "z", "t")])
    r2 = rigid.vec().dot(rigid.vec())
    ok = ok & (r2 >= min_range * min_range)
    if max_range > 0.0:
        ok = ok & (r2 <= max_range * max_range)
    return points.filter(ok)


def crop_aabb(frames: DataFrame, longitudinal: float, lateral: float, z_below: float) -> DataFrame:
    """Axis-aligned map box of each frame's body crop; `frames` carry the body pose in the map."""
    p = rigid.pose()
    corners = F.array(
        *[
            F.struct(*[c.alias(n) for c, n in zip(p.apply(rigid.lit_vec(x, y, z)), "xyz", strict=True)])
            for x in (-longitudinal, longitudinal) for y in (-lateral, lateral) for z in (-z_below, 0.0)
        ]
    )
    out = frames.withColumn("_corners", corners)
    bounds = {}
    for axis in "xyz":
        values = F.col("_corners").getField(axis)
        bounds[f"min_{axis}"], bounds[f"max_{axis}"] = F.array_min(values), F.array_max(values)
    return out.withColumns(bounds).drop("_corners")


def visible_scans(
    scan_poses: DataFrame, longitudinal: float, lateral: float, cap: int = 120, keys: Sequence[str] = ("drive",),
    chunks: Chunks | None = None,
) -> DataFrame:
    """Scans whose position lies in the box of the newest scan's frame; of those the `cap` newest."""
    order = F.struct("stamp", "idx")
    newest = scan_poses.groupBy(*keys).agg(F.max_by(rigid.pose().struct(), order).alias("_n"))
    local = rigid.pose("_n.").inverse().apply(rigid.vec())
    seen = scan_poses.join(newest, list(keys)).filter(
        (F.abs(local.x) <= longitudinal) & (F.abs(local.y) <= lateral)
    ).drop("_n")
    ranked = row_numbers(seen, keys, ("stamp", "idx"), "_rn", chunks)
    total = ranked.groupBy(*keys).agg(F.max("_rn").alias("_total"))
    return ranked.join(total, list(keys)).filter(F.col("_rn") > F.col("_total") - cap).drop("_rn", "_total")


# --- voxels --------------------------------------------------------------------------------------------


def with_voxel(points: DataFrame, size: float, height: float | None = None) -> DataFrame:
    """Voxel key floor(p / size); `height` sets another size along z."""
    sizes = (size, size, size if height is None else height)
    return points.withColumns(
        {v: F.floor(F.col(a) / F.lit(float(s))).cast("bigint") for v, a, s in zip(VOXEL, "xyz", sizes, strict=True)}
    )


def voxel_first(
    points: DataFrame, size: float, keys: Sequence[str] = SCAN, order: Sequence[str] = ("idx",)
) -> DataFrame:
    """First point in input order of every voxel.

    Combines map-side, so dense voxels stay cheap. With a single order column every column is its own
    `min_by`: fixed-width buffers keep the aggregate hash-based and compiled.
    """
    names = [c for c in points.columns if c not in keys]
    grouped = with_voxel(points, size).groupBy(*keys, *VOXEL)
    if len(order) == 1:
        best = grouped.agg(*[F.min_by(c, order[0]).alias(f"_p_{c}") for c in names])
        return best.select(*keys, *[F.col(f"_p_{c}").alias(c) for c in names])
    best = grouped.agg(F.min_by(F.struct(*names), F.struct(*order)).alias("_p"))
    return best.select(*keys, "_p.*")


def voxel_two_level(points: DataFrame, voxel: float, keys: Sequence[str] = SCAN) -> tuple[DataFrame, DataFrame]:
    """Map cloud (half a voxel) and, from its survivors, the source cloud (one and a half voxels)."""
    fine = voxel_first(points, voxel * 0.5, keys)
    return fine, voxel_first(fine, voxel * 1.5, keys)


HASH_SLICES = 4096


def voxel_random(
    points: DataFrame, size: float, rate: float, seed: int = 0, keys: Sequence[str] = SCAN,
    target: int | None = None, slice_rows: int = 1_000_000,
) -> DataFrame:
    """Random points per voxel: ceil(rate N / voxels) each, at most ceil(1.2 N rate) in total.

    Random order is a seeded hash of the point, so a rerun keeps the same points. Ranks are taken inside hash
    slices and offset by slice counts, so neither a crowded voxel nor a crowded scan lands on one task.
    """
    counts = points.groupBy(*keys).agg(F.count(F.lit(1)).alias("_N"))
    share = F.lit(float(rate)) if not target else F.lit(float(target)) / F.greatest(F.col("_N"), F.lit(1))
    finite = reduce(lambda a, b: a & b, [F.col(c).isNotNull() & (F.abs(c) < float("inf")) for c in "xyz"])
    rows = with_voxel(points, size).withColumns({"_finite": finite, "_h": F.xxhash64(F.lit(seed), *keys, "idx")})
    cells = rows.filter("_finite").groupBy(*keys, *VOXEL).agg(F.count(F.lit(1)).alias("_cell"))
    per_scan = cells.groupBy(*keys).agg(F.count(F.lit(1)).alias("_V")).join(counts, list(keys))
    per_scan = per_scan.withColumn("_rate", F.least(share, F.lit(1.0))).withColumns(
        {
            "_all": share >= 0.99,
            "_each": F.ceil(F.col("_rate") * F.col("_N") / F.col("_V")),
            "_cap": F.ceil(F.col("_N") * F.col("_rate") * 1.2),
        }
    )
    rows = rows.join(per_scan.select(*keys, "_all", "_each", "_cap"), list(keys))
    rows = rows.filter((F.col("_all") | F.col("_finite")))
    rows = _hash_rank(rows, [*keys, *VOXEL], "_rank", slice_rows).filter(
        F.col("_all") | (F.col("_rank") <= F.col("_each"))
    )
    kept = _hash_rank(rows, list(keys), "_rank", slice_rows).filter(F.col("_all") | (F.col("_rank") <= F.col("_cap")))
    return kept.select(*points.columns)


def _hash_rank(rows: DataFrame, group: list[str], into: str, slice_rows: int) -> DataFrame:
    """Rank by (_h, idx) inside `group`. Groups above `slice_rows` are ranked per hash slice and offset."""
    size = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("_size"))
    slices = F.least(F.ceil(F.col("_size") / slice_rows), F.lit(HASH_SLICES)).cast("bigint")
    # The top 31 bits of the hash, as a fraction, pick the slice: slices follow hash order.
    part = F.floor(F.shiftrightunsigned(F.col("_h"), 33) / F.lit(float(1 << 31)) * slices).cast("bigint")
    unsigned = F.shiftrightunsigned(F.col("_h"), 1)
    rows = rows.join(size, group).withColumn("_slice", part)
    before = Window.partitionBy(*group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy(*group, "_slice").agg(F.count(F.lit(1)).alias("_c")).select(
        *group, "_slice", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_offset")
    )
    local = rows.withColumn("_u", unsigned).withColumn(
        into, F.row_number().over(Window.partitionBy(*group, "_slice").orderBy("_u", "idx"))
    )
    return local.join(offsets, [*group, "_slice"]).withColumn(into, F.col(into) + F.col("_offset")).drop(
        "_slice", "_offset", "_size", "_u"
    )


def voxel_spaced(
    points: DataFrame, size: float, cap: int = 20, keys: Sequence[str] = SCAN, order: Sequence[str] = ("idx",)
) -> DataFrame:
    """Points kept in input order per voxel, at most `cap`, none nearer than size / sqrt(cap) to a kept one.

    One shuffle: points are dealt by voxel, sorted in input order, and a pass over the batches holds the kept points of
    the current voxel only, however many points it has. A point without a position is kept if it is the first one.
    """
    spacing2, cap = (size / math.sqrt(max(1, cap))) ** 2, max(1, cap)
    group = [*keys, *VOXEL]
    rows = with_voxel(points, size).withColumn("_group", F.xxhash64(*group))
    placed = rows.repartition(*group).sortWithinPartitions(*group, *order)
    schema = T.StructType([f for f in placed.schema.fields if f.name != "_group"]).add("kept_rank", T.IntegerType())

    def choose(xyz: np.ndarray, kept: list[np.ndarray]) -> list[int]:
        """Places of the points to keep after those in `kept`, which grows."""
        alive, out = np.ones(len(xyz), bool), []
        for k in kept:
            alive &= ((xyz - k) ** 2).sum(axis=1) >= spacing2
        while len(kept) < cap and alive.any():
            out.append(int(alive.argmax()))
            kept.append(xyz[out[-1]])
            alive[: out[-1] + 1] = False
            alive &= ((xyz - kept[-1]) ** 2).sum(axis=1) >= spacing2
        return out

    def run(batches):
        current, kept = None, []
        for batch in batches:
            ids = batch.column("_group").to_numpy()
            xyz = np.stack([batch.column(a).to_numpy(zero_copy_only=False).astype(float) for a in "xyz"], axis=1)
            places, ranks = [], []
            starts = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]])) if len(ids) else []
            for a, b in zip(starts, [*starts[1:], len(ids)]):
                if ids[a] != current:
                    current, kept = ids[a], []
                before = len(kept)
                if before < cap:
                    new = choose(xyz[a:b], kept)
                    places += [a + i for i in new]
                    ranks += range(before + 1, before + 1 + len(new))
            out = batch.take(pa.array(np.array(places, np.int64)))
            columns = [out.column(f.name) for f in schema.fields[:-1]]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(ranks, pa.int32())], [f.name for f in schema.fields])

    return placed.mapInArrow(run, schema).select(*points.columns, "kept_rank", *VOXEL)


def stride_sample(
    points: DataFrame, limit: int, keys: Sequence[str] = SCAN, chunks: Chunks | None = None
) -> DataFrame:
    """`limit` evenly spaced points in input order: positions floor(k N / limit); all points if fewer."""
    rows = row_numbers(points, keys, ("idx",), "_rn", chunks)
    rows = rows.join(points.groupBy(*keys).agg(F.count(F.lit(1)).alias("_N")), list(keys))
    at, step = F.col("_rn") - 1, F.col("_N") / F.lit(float(limit))
    k = F.ceil(at / step)
    near = [k - 1, k, k + 1]
    hit = reduce(
        lambda a, b: a | b,
        [(j >= 0) & (j < limit) & (F.floor(j.cast("double") * step) == at) for j in near],
    )
    return rows.filter((F.col("_N") <= limit) | hit).drop("_rn", "_N")


def thin_for_display(points: DataFrame, size: float = 0.5, keys: Sequence[str] = ("drive",)) -> DataFrame:
    """One point per display voxel of the whole map."""
    return voxel_first(points, size, keys, ("scan_id", "idx"))


def voxel_intensity(down: DataFrame, cropped: DataFrame, size: float, keys: Sequence[str] = SCAN) -> DataFrame:
    """Intensity of the first cropped point in each down-sampled point's voxel, else 0."""
    first = with_voxel(cropped, size).groupBy(*keys, *VOXEL).agg(
        F.min_by(F.coalesce("intensity", F.lit(0.0)), "idx").alias("_i")
    )
    return with_voxel(down, size).join(first, [*keys, *VOXEL], "left").withColumn(
        "intensity", F.coalesce("_i", F.lit(0.0))
    ).drop("_i", *VOXEL)


# --- motion --------------------------------------------------------------------------------------------


#: Row numbers of one block when ranges meet the rows they hold.
WINDOW_BLOCK = 256


def _ranked_ranges(
    traj: DataFrame, ranges: DataFrame, keys: Sequence[str], chunks: Chunks | None
) -> tuple[DataFrame, DataFrame]:
    """`traj` with its row number `rn`, and `ranges` with the first and last row number they hold."""
    numbered = row_numbers(traj, keys, ("stamp", "idx"), "rn", chunks)
    total = numbered.groupBy(*keys).agg(F.max("rn").alias("_n"))
    found = asof(ranges, numbered, keys, "from_stamp", "stamp", ("rn",), tie=("idx",), chunks=chunks)
    found = found.withColumns({"_f": F.col("prev.rn"), "_fn": F.col("next.rn")}).drop("prev", "next")
    found = asof(found, numbered, keys, "to_stamp", "stamp", ("rn",), tie=("idx",), chunks=chunks)
    found = found.withColumns({"_l": F.col("next.rn")}).drop("prev", "next").join(total, list(keys))
    first = F.coalesce("_f", F.coalesce("_fn", "_n"))
    last = F.greatest(F.coalesce("_l", "_n"), first)
    found = found.withColumns({"_a": first, "_b": last})
    single = F.col("_a") == F.col("_b")
    found = found.withColumns(
        {
            "last_rn": F.when(single & (F.col("_b") < F.col("_n")), F.col("_b") + 1).otherwise(F.col("_b")),
            "first_rn": F.when(single & (F.col("_b") >= F.col("_n")), F.greatest(F.col("_a") - 1, F.lit(1))).otherwise(F.col("_a")),
        }
    )
    return numbered, found.drop("_f", "_fn", "_l", "_n", "_a", "_b")


def window_bounds(
    traj: DataFrame, ranges: DataFrame, keys: Sequence[str] = ("drive",), chunks: Chunks | None = None
) -> DataFrame:
    """`ranges` with `first_rn`, `last_rn`: the rows of `trajectory_window` by their numbers in stamp order, one row per range."""
    return _ranked_ranges(traj, ranges, keys, chunks)[1]


def trajectory_window(
    traj: DataFrame, ranges: DataFrame, keys: Sequence[str] = ("drive",), chunks: Chunks | None = None
) -> DataFrame:
    """Rows of `traj` that bracket each range `from_stamp..to_stamp` (`range_id`): one before, one at or after.

    A range that catches a single row gets one more: the following row, else the one before. Ranges and rows meet
    in blocks of row numbers, so a range is shuffled as few blocks and its rows only come out of the join.
    """
    numbered, found = _ranked_ranges(traj, ranges, keys, chunks)
    block = f" div {WINDOW_BLOCK}"
    wanted = found.select(
        *keys, "range_id", "first_rn", "last_rn", F.explode(F.expr(f"sequence(first_rn{block}, last_rn{block})")).alias("_block")
    )
    rows = wanted.join(numbered.withColumn("_block", F.expr(f"rn{block}")), [*keys, "_block"])
    rows = rows.filter(F.col("rn").between(F.col("first_rn"), F.col("last_rn")))
    return rows.select(*keys, "rn", "range_id", *[c for c in traj.columns if c not in keys])


#: Trajectory rows of a scan that a point looks through for its own two; longer paths are cut into pieces of so many.
PATH_ROWS = 64


def _scan_paths(near: DataFrame, ends: DataFrame, scan_keys: Sequence[str], piece_rows: int) -> DataFrame:
    """The trajectory rows of every scan (`near`), seen from its end pose `_end`, with the span and the twist to the next row (none
    after the last one), their place in the scan and the piece of `piece_rows` rows that it falls into."""
    own = Window.partitionBy(*scan_keys).orderBy("stamp", "idx")
    following = F.lead(F.struct("stamp", *rigid.POSE_FIELDS)).over(own)
    rows = near.withColumns({"_rn": F.row_number().over(own) - 1, "_n": following}).join(ends, list(scan_keys))
    rows = rows.withColumns({"_gap": rigid.pose().between(rigid.pose("_n.")).struct(), "_seen": rigid.pose("_end.").between(rigid.pose()).struct()})
    rows = rigid.stage_se3_log(rows.withColumn("_span", F.col("_n.stamp") - F.col("stamp")), rigid.pose("_gap."), "_twist")
    return rows.select(*scan_keys, F.expr(f"_rn div {piece_rows}").alias("_piece"), "_rn", "stamp", "_span", "_seen", "_twist")


def deskew(
    points: DataFrame, traj: DataFrame, extrinsic: rigid.Pose | None = None, scan_keys: Sequence[str] = SCAN,
    keys: Sequence[str] = ("drive",), chunks: Chunks | None = None, piece_rows: int = PATH_ROWS,
) -> DataFrame:
    """Points moved to the end of their scan: P(t_end)^-1 P(t) E p, with t_end the latest time of the scan.

    Only the trajectory rows around a scan go to it. They and the motions between them are one array per scan (and per
    `piece_rows` rows of it), and every point finds its two rows there: points are neither sorted nor gathered by scan.
    """
    traj = cut(traj.select(*keys, *SAMPLE))
    spans = cut(points.groupBy(*scan_keys).agg(F.min("t").alias("_t0"), F.max("t").alias("t_end")))
    first = asof(spans, traj, keys, "_t0", "stamp", ("stamp",), chunks=chunks).withColumn("_lo", F.coalesce("prev.stamp", "_t0"))
    last = asof(first.drop("prev", "next"), traj, keys, "t_end", "stamp", ("stamp",), chunks=chunks)
    spans = cut(last.withColumn("_hi", F.coalesce("next.stamp", "t_end")).drop("prev", "next"))
    # The rows around each scan, found by time bins of a usual scan's length; a scan across a hole has more bins.
    usual = spans.agg(F.percentile_approx(F.col("_hi") - F.col("_lo"), 0.5)).first()[0]
    width = float(usual) if usual and usual > 0.0 else 1.0
    bins = F.sequence(F.floor(F.col("_lo") / width), F.floor(F.col("_hi") / width))
    around = spans.select(*scan_keys, "_lo", "_hi", F.explode(bins).alias("_bin"))
    near = traj.withColumn("_bin", F.floor(F.col("stamp") / width)).join(around, [*keys, "_bin"])
    near = near.filter(F.col("stamp").between(F.col("_lo"), F.col("_hi"))).select(*scan_keys, *SAMPLE)
    ends = interpolate_clamped(spans.select(*scan_keys, "t_end"), near, "t_end", scan_keys, Chunks(), into="_end")
    paths = cut(_scan_paths(near, ends.select(*scan_keys, "_end"), scan_keys, piece_rows))
    count, pieces = paths.agg(F.count(F.lit(1)), F.max("_piece")).first()
    # In order: (stamp, place). A row holds at most `piece_rows` of them.
    path = paths.groupBy(*scan_keys, "_piece").agg(F.array_sort(F.collect_list(F.struct("stamp", "_rn", "_span", "_seen", "_twist"))).alias("_path"))

    def looked_up(rows: DataFrame, table: DataFrame, on: Sequence[str]) -> DataFrame:
        return rows.join(F.broadcast(table) if count <= BROADCAST_ROWS else table, list(on), "left")

    def earlier(stamps: str, stamp) -> Column:
        """How many of an array's rows lie before `t`."""
        return F.size(F.filter(stamps, lambda s: stamp(s) < F.col("t")))

    placed = reduce(lambda rows, k: rows.filter(F.col(k).isNotNull()), scan_keys, points).withColumn("_piece", F.lit(0).cast("bigint"))
    if pieces:
        starts = path.groupBy(*scan_keys).agg(F.array_sort(F.collect_list(F.get("_path", F.lit(0))["stamp"])).alias("_starts"))
        piece = F.coalesce(F.greatest(earlier("_starts", lambda s: s) - 1, F.lit(0)), F.lit(0)).cast("bigint")
        placed = looked_up(placed, starts, scan_keys).withColumn("_piece", piece).drop("_starts")
    placed = looked_up(placed, path.withColumn("_piece", F.col("_piece").cast("bigint")), [*scan_keys, "_piece"])
    placed = pinned(placed, {"_before": earlier("_path", lambda s: s["stamp"])}).withColumn("_at", F.get("_path", F.greatest(F.col("_before") - 1, F.lit(0)))).drop("_path")
    share = F.when((F.col("_before") > 0) & (F.col("_at._span") > 1.0e-9), (F.col("t") - F.col("_at.stamp")) / F.col("_at._span")).otherwise(0.0)
    # Ahead of the first row and behind the last one it is that row's own pose.
    twist = [F.coalesce(F.col(f"_at._twist.{n}") * F.col("_share"), F.lit(0.0)).alias(n) for n in rigid.TWIST_FIELDS]
    kept = [c for c in points.columns if c not in ("x", "y", "z")]
    placed = placed.withColumn("_share", share).withColumn("_xi", F.struct(*twist)).drop("_share", "_before", "_piece")
    placed = placed.withColumn("_seen", F.col("_at._seen")).drop("_at")
    moved = rigid.stage_se3_exp(placed, rigid.twist("_xi."), "_step")
    body = rigid.vec() if extrinsic is None else extrinsic.apply(rigid.vec())
    out = rigid.pose("_seen.").apply(rigid.pose("_step.").apply(body))
    moved = moved.select(*kept, *[c.alias(f"_new_{a}") for a, c in zip("xyz", out, strict=True)])
    return pinned(moved, {a: F.col(f"_new_{a}") for a in "xyz"}).drop(*[f"_new_{a}" for a in "xyz"])


def merge_scan_points(points: DataFrame, scan_poses: DataFrame, keys: Sequence[str] = SCAN) -> DataFrame:
    """World points of all given scans, with the scan's pass count."""
    poses = scan_poses.select(
        *keys, *[F.col(n).alias(f"_p{n}") for n in rigid.POSE_FIELDS], "collective_passes"
    )
    out = points.join(poses, list(keys))
    w = rigid.pose("_p").apply(rigid.vec())
    return out.withColumns({"x": w.x, "y": w.y, "z": w.z}).withColumn(
        "intensity", F.coalesce("intensity", F.lit(0.0))
    ).drop(*[f"_p{n}" for n in rigid.POSE_FIELDS])


def accumulate_in_view(
    points: DataFrame, frames: DataFrame, longitudinal: float, lateral: float, z_below: float,
    accumulate: bool = True, keys: Sequence[str] = ("drive",), tile: float | None = None,
    chunks: Chunks | None = None,
) -> DataFrame:
    """Points in view at every frame: those of the frame's scan and earlier ones that never left the crop.

    `points` are in the map frame with the `frame` of their scan; `frames`: `frame, stamp, idx` and the body
    pose. The join runs on map tiles of the crop box; a point survives as long as the frames that see it
    follow each other without a gap from its own frame on.
    """
    tile = tile or max(longitudinal, lateral)
    f = row_numbers(frames, keys, ("stamp", "idx"), "_fn", chunks)
    boxes = crop_aabb(f, longitudinal, lateral, z_below)

    def span(axis: str) -> Column:
        return F.sequence(
            F.floor(F.col(f"min_{axis}") / tile).cast("bigint"), F.floor(F.col(f"max_{axis}") / tile).cast("bigint")
        )

    boxes = boxes.withColumn("_tx", F.explode(span("x"))).withColumn("_ty", F.explode(span("y")))
    boxes = boxes.select(
        *keys, "_tx", "_ty", "_fn", F.col("frame").alias("view_frame"), *[F.col(n).alias(f"_p{n}") for n in rigid.POSE_FIELDS]
    )
    own = f.select(*keys, "frame", F.col("_fn").alias("_own"))
    p = points.join(own, [*keys, "frame"]).withColumns(
        {"_tx": F.floor(F.col("x") / tile).cast("bigint"), "_ty": F.floor(F.col("y") / tile).cast("bigint")}
    )
    hit = p.join(boxes, [*keys, "_tx", "_ty"])
    hit = hit.filter(F.col("_fn") == F.col("_own")) if not accumulate else hit.filter(F.col("_fn") >= F.col("_own"))
    local = rigid.pose("_p").inverse().apply(rigid.vec())
    hit = pinned(hit, {f"b{a}": c for a, c in zip("xyz", local, strict=True)})
    hit = hit.filter(below_box(rigid.vec("b"), longitudinal, lateral, z_below))
    # Returns that share an `idx` are apart by their place; at the same place they are seen by the same frames.
    run = Window.partitionBy(*keys, "frame", "idx", "x", "y", "z").orderBy("_fn")
    hit = hit.withColumn("_k", F.dense_rank().over(run)).filter(F.col("_fn") - F.col("_own") == F.col("_k") - 1)
    return hit.drop("_tx", "_ty", "_fn", "_own", "_k", *[f"_p{n}" for n in rigid.POSE_FIELDS])


def lock_map_alignment(
    gt: DataFrame, traj: DataFrame, max_dt: float, keys: Sequence[str] = ("drive",), chunks: Chunks | None = None
) -> DataFrame:
    """Constant `tf` = truth * pose^-1 from the first truth row that has a trajectory pose within `max_dt`."""
    from .association import closest_pose

    own = gt.withColumn("_gt", rigid.pose().struct())
    near = closest_pose(own, traj, "stamp", keys, chunks).filter(F.col("dt") <= max_dt)
    first = near.groupBy(*keys).agg(
        F.min_by(F.struct("_gt", "hit"), F.struct("stamp", "idx")).alias("_f"), F.min("stamp").alias("locked_at")
    )
    tf = rigid.pose("_f._gt.").mul(rigid.pose("_f.hit.").inverse())
    return first.select(*keys, "locked_at", tf.struct().alias("tf"))


def apply_map_alignment(rows: DataFrame, alignment: DataFrame, keys: Sequence[str] = ("drive",)) -> DataFrame:
    """Poses (and velocities `vx, vy, vz` where present) expressed in the map."""
    out = rows.join(alignment.select(*keys, "tf"), list(keys))
    moved = rigid.pose("tf.").mul(rigid.pose())
    cols = dict(zip(rigid.POSE_FIELDS, (*moved.t, *moved.q), strict=True))
    if "vx" in rows.columns:
        cols |= dict(zip(("vx", "vy", "vz"), rigid.pose("tf.").q.rotate(rigid.vec("v", ("x", "y", "z"))), strict=True))
    return out.withColumns(cols).drop("tf")
