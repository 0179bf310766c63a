"""Scan preparation: unpack, place in the body frame, deskew, crop, down-sample."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rigid
from ..operators import points as P
from ..operators.ordered import Chunks
from ..sources.clouds import attach_extrinsic, explode_clouds


@dataclass(frozen=True)
class PrepareParams:
    voxel: float = 0.5
    half_x: float = 37.5
    half_y: float = 25.0
    min_range: float = 0.0
    max_range: float = 0.0
    time_field: str | None = None
    random: bool = False
    random_rate: float = 0.3
    random_target: int | None = None
    seed: int = 0


def prepare_points(
    points: DataFrame, traj: DataFrame, params: PrepareParams = PrepareParams(), extrinsic: rigid.Pose | None = None,
    chunks: Chunks | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Point rows of many scans to (map cloud, source cloud)."""
    clean = P.finite_in_range(points, params.min_range, params.max_range)
    moved = P.crop_box(P.deskew(clean, traj, extrinsic, chunks=chunks), params.half_x, params.half_y)
    if not params.random:
        return P.voxel_two_level(moved, params.voxel)
    fine = P.voxel_random(
        moved, params.voxel * 0.5, params.random_rate, params.seed, target=params.random_target
    )
    return fine, P.voxel_first(fine, params.voxel * 1.5)


def prepare_scans(
    clouds: DataFrame, extrinsics: DataFrame, traj: DataFrame, params: PrepareParams = PrepareParams(),
    chunks: Chunks | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Raw cloud rows (with `frame_id`) to (map cloud, source cloud). Ranges are those of the sensor, before the time rule."""
    p = params
    rows = explode_clouds(attach_extrinsic(clouds, extrinsics)[0], p.time_field, p.min_range, p.max_range, carry=("ext",))
    body = rigid.pose("ext.").apply(rigid.vec())
    rows = rows.withColumns({"x": body.x, "y": body.y, "z": body.z}).drop("ext")
    return prepare_points(rows, traj, replace(p, min_range=0.0, max_range=0.0), None, chunks)
