"""Voxel surface statistics of a map and the scores and systems built on them."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import rigid
from ..functions.eigen3 import SYM, inverse_sym, with_axes, with_eigenvalues
from .points import SCAN, VOXEL, voxel_spaced, with_voxel

PLANARITY_RATIO = 0.25
AXES = ("x", "y", "z")


def block_offsets(include_centre: bool = True) -> Column:
    """The 27 (or 26) voxel offsets as an array literal of structs `ox, oy, oz`."""
    return F.array(
        *[
            F.struct(F.lit(a).alias("ox"), F.lit(b).alias("oy"), F.lit(c).alias("oz"))
            for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1) if include_centre or (a, b, c) != (0, 0, 0)
        ]
    )


def shifted(df: DataFrame, include_centre: bool = True, names: Sequence[str] = VOXEL) -> DataFrame:
    """One row per neighbouring voxel, as columns `nx, ny, nz`."""
    out = df.withColumn("_o", F.explode(block_offsets(include_centre)))
    return out.withColumns(
        {n: F.col(v) + F.col(f"_o.{o}") for n, v, o in zip(("nx", "ny", "nz"), names, ("ox", "oy", "oz"), strict=True)}
    ).drop("_o")


def voxel_moments(points: DataFrame, size: float, keys: Sequence[str] = ("drive",)) -> DataFrame:
    """Count, mean and population covariance per voxel (centred sums: safe far from the origin)."""
    rows = with_voxel(points, size)
    return rows.groupBy(*keys, *VOXEL).agg(
        F.count(F.lit(1)).alias("n"), *[F.avg(a).alias(f"m{a}") for a in AXES],
        *[F.covar_pop(s[0], s[1]).alias(f"c{s}") for s in SYM],
    )


def block_moments(
    targets: DataFrame, stats: DataFrame, size: float, keys: Sequence[str] = ("drive",)
) -> DataFrame:
    """Count, mean and covariance of the 27-voxel block around each target voxel.

    Block sums are taken relative to the target voxel's corner, so they do not cancel on map coordinates.
    """
    near = shifted(targets.select(*keys, *VOXEL))
    other = stats.select(
        *keys, *[F.col(v).alias(n) for v, n in zip(VOXEL, ("nx", "ny", "nz"), strict=True)],
        "n", *[f"m{a}" for a in AXES], *[f"c{s}" for s in SYM],
    )
    hit = near.join(other, [*keys, "nx", "ny", "nz"])
    hit = hit.withColumns({f"_r{a}": F.col(f"m{a}") - F.col(v) * float(size) for a, v in zip(AXES, VOXEL, strict=True)})
    sums = hit.groupBy(*keys, *VOXEL).agg(
        F.sum("n").alias("n"), *[F.sum(F.col("n") * F.col(f"_r{a}")).alias(f"_s{a}") for a in AXES],
        *[
            F.sum(F.col("n") * (F.col(f"c{s}") + F.col(f"_r{s[0]}") * F.col(f"_r{s[1]}"))).alias(f"_q{s}")
            for s in SYM
        ],
    )
    mean = {a: F.col(f"_s{a}") / F.col("n") for a in AXES}
    return sums.select(
        *keys, *VOXEL, "n", *[(mean[a] + F.col(v) * float(size)).alias(f"m{a}") for a, v in zip(AXES, VOXEL, strict=True)],
        *[(F.col(f"_q{s}") / F.col("n") - mean[s[0]] * mean[s[1]]).alias(f"c{s}") for s in SYM],
    )


def _planar(df: DataFrame) -> Column:
    return F.coalesce(
        F.when(F.col("l1") > 1.0e-10, F.col("l3") / F.col("l1") <= PLANARITY_RATIO), F.lit(False)
    )


def surface_map(
    points: DataFrame, size: float, regularise: float = 1.0e-3, min_points: int = 5,
    keys: Sequence[str] = ("drive",),
) -> DataFrame:
    """Surface voxels: mean, unit normal, inverse covariance and the flags planar / own_fit / valid.

    The normal comes from the voxel's own points if they span a plane, otherwise from its 27-voxel block.
    """
    need = max(1, min_points)
    stats = voxel_moments(points, size, keys)
    own = with_eigenvalues(stats, "c", "l")
    own = own.withColumn("own_fit", (F.col("n") >= need) & _planar(own))
    own = with_axes(own, "c", "n_", "m_")
    own = inverse_sym(own, "c", "i", regularise)
    normals = [f"n_{a}" for a in AXES]
    own = own.withColumn("valid", (F.col("n") >= need) & F.col("iok")).select(
        *keys, *VOXEL, "n", "mx", "my", "mz", *[F.when(F.col("own_fit"), F.col(c)).alias(c) for c in normals],
        *[F.when(F.col("valid"), F.col(f"i{s}")).alias(f"i{s}") for s in SYM], "own_fit", "valid",
    )
    block = block_moments(own.filter(~F.col("own_fit")), stats, size, keys)
    block = with_axes(with_eigenvalues(block, "c", "l"), "c", "b_", "m_")
    block = block.filter((F.col("n") >= need) & _planar(block)).select(
        *keys, *VOXEL, *[f"b_{a}" for a in AXES]
    )
    out = own.join(block, [*keys, *VOXEL], "left")
    return out.withColumns(
        {
            **{f"n_{a}": F.coalesce(f"n_{a}", f"b_{a}") for a in AXES},
            "planar": F.col("own_fit") | F.col("b_x").isNotNull(),
        }
    ).drop(*[f"b_{a}" for a in AXES])


def voxel_lookup(points: DataFrame, surface: DataFrame, size: float, keys: Sequence[str] = ("drive",)) -> DataFrame:
    """World points with the surface row of the voxel they fall into (exact voxel equality)."""
    return with_voxel(points, size).join(surface, [*keys, *VOXEL])


def ndt_score(
    points: DataFrame, surface: DataFrame, size: float, threshold: float = 7.81, min_hits: int = 20,
    keys: Sequence[str] = ("drive",), scan_keys: Sequence[str] = SCAN,
) -> DataFrame:
    """Mean squared Mahalanobis distance and share under the threshold per scan, over voxels with statistics."""
    hit = voxel_lookup(points, surface.filter("valid"), size, keys)
    d = rigid.Vec(*[F.col(a) - F.col(f"m{a}") for a in AXES])
    i = {s: F.col(f"i{s}") for s in SYM}
    d2 = (
        d.x * (i["xx"] * d.x + i["xy"] * d.y + i["xz"] * d.z)
        + d.y * (i["xy"] * d.x + i["yy"] * d.y + i["yz"] * d.z)
        + d.z * (i["xz"] * d.x + i["yz"] * d.y + i["zz"] * d.z)
    )
    hit = hit.withColumn("_d2", d2).filter(F.abs("_d2") < float("inf"))
    score = hit.groupBy(*scan_keys).agg(
        F.count(F.lit(1)).alias("valid_hits"), F.avg("_d2").alias("_m"),
        F.avg((F.col("_d2") < threshold).cast("double")).alias("_f"),
    )
    every = points.select(*scan_keys).distinct()
    enough = F.col("valid_hits") >= max(1, min_hits)
    return every.join(score, list(scan_keys), "left").select(
        *scan_keys, F.coalesce("valid_hits", F.lit(0)).alias("valid_hits"),
        F.when(enough, F.col("_m")).alias("mean_cost"), F.when(enough, F.col("_f")).alias("inlier_fraction"),
    )


# --- nearest map point ---------------------------------------------------------------------------------


def local_map(points: DataFrame, size: float, cap: int = 20, keys: Sequence[str] = ("drive",),
              order: Sequence[str] = ("scan_id", "idx")) -> DataFrame:
    """The registration map: at most `cap` spaced points per voxel. The cap is the map's definition."""
    return voxel_spaced(points, size, cap, keys, order)


def block_index(
    map_points: DataFrame, size: float, payload: Sequence[str] = (), keys: Sequence[str] = ("drive",)
) -> DataFrame:
    """For every voxel with a map point in its 27-voxel block: those points as the array `near`.

    The map is the small side (bounded points per voxel), so it is the one that is expanded; a query then
    needs one equi-join on its own voxel and no further shuffle. `near` has at most 27 times the map's
    points per voxel.
    """
    rows = shifted(with_voxel(map_points, size))
    item = F.struct(
        *[F.col(a) for a in AXES], F.col("idx"), *[F.col(v).alias(f"o{v}") for v in VOXEL], *payload
    )
    return rows.groupBy(
        *keys, *[F.col(n).alias(v) for n, v in zip(("nx", "ny", "nz"), VOXEL, strict=True)]
    ).agg(F.collect_list(item).alias("near"))


# Queries compared with one block's points at a time.
QUERY_GROUP = 512


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _nearest_places(
    qx: pd.Series, qy: pd.Series, qz: pd.Series, own: pd.Series, px: pd.Series, py: pd.Series, pz: pd.Series, tie: pd.Series,
    barred: pd.Series,
) -> pd.Series:
    """Per row, a group of queries and the points of its block: the place of each query's nearest point (-1: none)."""
    out = []
    for q1, q2, q3, mine, p1, p2, p3, rank, not_for in zip(qx, qy, qz, own, px, py, pz, tie, barred, strict=True):
        if p1 is None or not len(p1):
            out.append(np.full(len(q1), -1, np.int32))
            continue
        order = np.argsort(rank, kind="stable")
        d2 = (p1[order] - q1[:, None]) ** 2 + (p2[order] - q2[:, None]) ** 2 + (p3[order] - q3[:, None]) ** 2
        d2 = np.where(np.isnan(d2) | (not_for[order] == mine[:, None]), np.inf, d2)
        best = d2.argmin(axis=1)
        out.append(np.where(np.isfinite(d2[np.arange(len(d2)), best]), order[best], -1).astype(np.int32))
    return pd.Series(out)


def _nearest_in_block(
    queries: DataFrame, index: DataFrame, size: float, max_distance: float, keys: Sequence[str], how: str, names: Sequence[str],
    tie: Callable[[Column], Column], barred: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """Adds `_d2` and `_p`, the nearest point of the query's block (`near`) strictly nearer than `max_distance`.

    Queries of a voxel meet its points as one distance matrix. A voxel with many queries is dealt into groups of about
    QUERY_GROUP, so a dense voxel is no longer task than others; points are not copied per query.
    """
    voxel, columns = [*keys, *VOXEL], queries.columns
    own = F.struct(*[F.col(c) for c in columns if c not in keys])
    rows = with_voxel(queries, size).withColumn("_q", own).select(*voxel, "_q")
    dense = rows.groupBy(*voxel).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > QUERY_GROUP)
    parts = F.coalesce(F.ceil(F.col("_n") / QUERY_GROUP), F.lit(1))
    dealt = rows.join(dense, voxel, "left").withColumn("_part", F.pmod(F.xxhash64("_q"), parts))
    groups = dealt.groupBy(*voxel, "_part").agg(F.collect_list("_q").alias("_qs")).join(index, voxel, how)

    def number(name: str) -> Callable[[Column], Column]:
        return lambda item: item.getField(name).cast("double")

    mine = F.transform("_qs", lambda q: q.getField("scan_id").cast("double") if barred else F.lit(0.0))
    theirs = F.transform("near", lambda p: F.coalesce(barred(p).cast("double"), F.lit(float("nan"))) if barred else F.lit(float("nan")))
    at = _nearest_places(
        *[F.transform("_qs", number(a)) for a in AXES], mine, *[F.transform("near", number(n)) for n in names],
        F.transform("near", lambda p: tie(p).cast("double")), theirs,
    )
    pairs = F.transform(F.arrays_zip("_qs", "_at"), lambda x: F.struct(x.getField("_qs").alias("q"), F.when(x.getField("_at") >= 0, F.get("near", x.getField("_at"))).alias("p")))
    out = groups.withColumn("_at", at).select(*keys, F.explode(pairs).alias("_x"))
    out = out.select(*[F.col(c) if c in keys else F.col(f"_x.q.`{c}`").alias(c) for c in columns], F.col("_x.p").alias("_p"))
    d2 = sum(((F.col(f"_p.{n}") - F.col(a)) * (F.col(f"_p.{n}") - F.col(a)) for n, a in zip(names, AXES, strict=True)), F.lit(0.0))
    out = out.withColumn("_d2", d2)
    near = F.col("_d2") < F.lit(float(max_distance) * float(max_distance))
    return out.withColumns({"_p": F.when(near, F.col("_p")), "_d2": F.when(near, F.col("_d2"))})


def closest_map_point(
    queries: DataFrame, index: DataFrame, size: float, max_distance: float, keys: Sequence[str] = ("drive",),
    how: str = "left",
) -> DataFrame:
    """Nearest map point of the query's block, strictly nearer than `max_distance`, as struct `hit`.

    Equal distances take the smaller point id. `hit` carries `d2`, the point and its owner voxel.
    """
    out = _nearest_in_block(queries, index, size, max_distance, keys, how, AXES, lambda p: p.getField("idx"))
    hit = F.struct(F.col("_d2").alias("d2"), F.col("_p.idx").alias("id"), F.col("_p").alias("p"))
    return out.withColumn("hit", F.when(F.col("_p").isNotNull(), hit)).drop("_p", "_d2")


#: Points of a dense map that a tile is meant to hold, and most (query, point) pairs compared at a time.
TILE_POINTS, PAIRS = 100_000, 1 << 21
_NEIGHBOURS = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1)]


def _spacing(points: np.ndarray) -> float:
    """About the distance of neighbouring points, whether they fill a box or lie in a plane."""
    extent = np.sort(np.ptp(points, axis=0))
    return max(np.cbrt(extent.prod() / len(points)), np.sqrt(extent[1] * extent[2] / len(points)), extent[2] / len(points))


def nearest_points(points: np.ndarray, queries: np.ndarray, most: float, size: float, start: float | None = None) -> np.ndarray:
    """Place of each query's nearest point strictly nearer than `most` and in the 27 voxels around its own, -1 if there is none.
    Of equally near points the first is taken.

    Points are sorted into cells as wide as the search radius, so that a query's 27 cells hold all that is in reach. Queries that
    find nothing so near go on with the double radius: work follows the points nearby, not the points of the cloud."""
    found, last = np.full(len(queries), -1, np.int64), most * (1 + 1e-6)
    usable = np.flatnonzero(np.isfinite(points).all(axis=1))
    left = np.flatnonzero(np.isfinite(queries).all(axis=1))
    if not len(usable) or not len(left):
        return found
    points = points[usable]
    radius = min(max(start or _spacing(points), last / 1024), last)
    low = points.min(axis=0)
    while len(left):
        cell = np.floor((points - low) / radius).astype(np.int64) + 1
        span = cell.max(axis=0) + 2
        key = (cell[:, 0] * span[1] + cell[:, 1]) * span[2] + cell[:, 2]
        order = np.argsort(key, kind="stable")
        key, near = key[order], points[order]
        own = np.floor((queries[left] - low) / radius)
        inside = ((own >= -1) & (own <= span - 2)).all(axis=1)  # others are a cell or more away from all points
        asked, own = left[inside], own[inside].astype(np.int64) + 1
        base = np.stack([((own[:, 0] + a) * span[1] + own[:, 1] + b) * span[2] + own[:, 2] for a, b in _NEIGHBOURS], axis=1)
        # A row of cells beside the grid has a key of another row: those are left out.
        there = np.stack([(own[:, 0] + a >= 1) & (own[:, 0] + a < span[0]) & (own[:, 1] + b >= 1) & (own[:, 1] + b < span[1]) for a, b in _NEIGHBOURS], axis=1)
        above = np.maximum(own[:, 2:] - 1, 0) - own[:, 2:]
        below = np.minimum(own[:, 2:] + 1, span[2] - 1) - own[:, 2:]
        begin = np.searchsorted(key, base + above, "left")
        count = np.where(there, np.searchsorted(key, base + below, "right") - begin, 0)
        total = np.cumsum(count.sum(axis=1))
        done, at = np.zeros(len(queries), bool), 0
        while at < len(asked):
            to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + PAIRS, "right")))
            each, width = count[at:to].ravel(), count[at:to].sum(axis=1)
            some = np.flatnonzero(width)
            if len(some):
                place = np.repeat(begin[at:to].ravel() - (np.cumsum(each) - each), each) + np.arange(each.sum())
                query, p = np.repeat(queries[asked[at:to]], width, axis=0), near[place]
                d2 = (p[:, 0] - query[:, 0]) ** 2 + (p[:, 1] - query[:, 1]) ** 2 + (p[:, 2] - query[:, 2]) ** 2
                if radius > size:
                    d2[(np.abs(np.floor(p / size) - np.floor(query / size)) > 1).any(axis=1)] = np.inf
                edges = np.cumsum(width)[some] - width[some]
                best = np.minimum.reduceat(d2, edges)
                first = np.minimum.reduceat(np.where(d2 == np.repeat(best, width[some]), order[place], len(points)), edges)
                whose = asked[at:to][some]
                settled = best < (radius * (1 - 1e-9)) ** 2
                done[whose[settled]] = True
                hit = settled & (best < most * most)
                found[whose[hit]] = usable[first[hit]]
            at = to
        left = left[~done[left]]
        if radius >= last:
            break
        radius = min(2 * radius, last)
    return found


@dataclass(frozen=True)
class DenseMap:
    """A map with all its points, however many a voxel has, for nearest points without a block index.

    Points and queries meet in tiles of x and y; a tile has the points around it, up to the search distance, too. The denser the map,
    the smaller the tiles (down to twice the search distance), so a task holds some TILE_POINTS of points at a time."""

    points: DataFrame
    size: float
    tile: float
    max_distance: float
    keys: tuple[str, ...] = ("drive",)

    @staticmethod
    def of(points: DataFrame, surface: DataFrame, size: float, max_distance: float, keys: Sequence[str] = ("drive",)) -> "DenseMap":
        """The map whose points carry their voxel's normal (null when the voxel is not planar), dealt to its tiles and kept."""
        normals = surface.select(*keys, *VOXEL, *[F.when(F.col("planar"), F.col(f"n_{a}")).alias(f"n_{a}") for a in AXES])
        # Half of all points are in columns of voxels that are at least as full.
        full = surface.groupBy(*keys, "vx", "vy").agg(F.sum("n").alias("_n")).agg((F.sum(F.col("_n") * F.col("_n")) / F.sum("_n")).alias("n")).first().n
        tile = min(max(size * (TILE_POINTS / (full or 1.0)) ** 0.5, 2 * max_distance), 4 * max(size, max_distance))
        finite = [F.abs(a) < float("inf") for a in AXES]
        rows = with_voxel(points.filter(finite[0] & finite[1] & finite[2]), size).join(normals, [*keys, *VOXEL], "left")
        rows = rows.select(*keys, "idx", *AXES, *[f"n_{a}" for a in AXES])
        for a in "xy":
            reach = [F.floor((F.col(a) + d * max_distance * (1 + 1e-6)) / tile) for d in (-1, 1)]
            rows = rows.withColumn(f"_t{a}", F.explode(F.sequence(*reach)))
        parts = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        rows = rows.repartition(parts, *keys, "_tx", "_ty").persist()
        return DenseMap(rows, size, tile, max_distance, tuple(keys))

    def closest(self, queries: DataFrame, max_distance: float) -> DataFrame:
        """As `closest_map_point`: the nearest map point of the 27 voxels around, strictly nearer than `max_distance`, as struct `hit`."""
        if max_distance > self.max_distance:
            raise ValueError("the map was dealt for a shorter distance")
        size, columns, carried = self.size, queries.columns, ("idx", *AXES, *[f"n_{a}" for a in AXES])
        tiled = queries.withColumns({f"_t{a}": F.floor(F.col(a) / self.tile) for a in "xy"})
        on = [*self.keys, "_tx", "_ty"]

        def numbers(table: pa.Table) -> np.ndarray:
            return np.stack([table.column(a).to_numpy().astype(float) for a in AXES], axis=1)

        def met(asked: pa.Table, near: pa.Table) -> pa.Table:
            place = np.full(asked.num_rows, -1, np.int64)
            if near.num_rows and asked.num_rows:
                near = near.sort_by("idx")
                place = nearest_points(numbers(near), numbers(asked), max_distance, size)
            places = pa.array(place, mask=place < 0)
            return pa.table([*[asked.column(c) for c in columns], *[near.column(c).take(places) for c in carried]], [*columns, *[f"_m{c}" for c in carried]])

        schema = T.StructType([*queries.schema.fields, *[T.StructField(f"_m{c}", self.points.schema[c].dataType) for c in carried]])
        out = tiled.groupBy(*on).cogroup(self.points.groupBy(*on)).applyInArrow(met, schema)
        point = F.struct(*[F.col(f"_m{c}").alias(c) for c in carried])
        d2 = sum(((F.col(f"_m{a}") - F.col(a)) * (F.col(f"_m{a}") - F.col(a)) for a in AXES), F.lit(0.0))
        hit = F.struct(d2.alias("d2"), F.col("_midx").alias("id"), point.alias("p"))
        return out.withColumn("hit", F.when(F.col("_mx").isNotNull(), hit)).drop(*[f"_m{c}" for c in carried])


def closest_plane(
    queries: DataFrame, planes: DataFrame, size: float, max_distance: float, keys: Sequence[str] = ("drive",)
) -> DataFrame:
    """Nearest planar voxel mean in the block, skipping voxels that are mostly the query's own scan.

    `planes`: voxel key, `mx..mz, n_x..n_z, dominant, dominant_n, n`; queries carry `scan_id`. Equal distances take the
    smaller voxel.
    """
    p = planes.select(
        *keys, *VOXEL, F.struct("mx", "my", "mz", "n_x", "n_y", "n_z", "dominant", "dominant_n", "n", *VOXEL).alias("_p")
    )
    index = shifted(p).groupBy(
        *keys, *[F.col(n).alias(v) for n, v in zip(("nx", "ny", "nz"), VOXEL, strict=True)]
    ).agg(F.collect_list("_p").alias("near"))

    def rank(p: Column) -> Column:
        return sum(((p.getField(v) - F.col(v)) * w for v, w in zip(VOXEL, (9, 3, 1), strict=True)), F.lit(0))

    def mostly(p: Column) -> Column:
        return F.when(p.getField("dominant_n") * 2 >= p.getField("n"), p.getField("dominant"))

    out = _nearest_in_block(queries, index, size, max_distance, keys, "left", ("mx", "my", "mz"), rank, mostly)
    hit = F.struct(F.col("_d2").alias("d2"), *[F.col(f"_p.{v}").alias(v) for v in VOXEL], F.col("_p").alias("p"))
    return out.withColumn("hit", F.when(F.col("_p").isNotNull(), hit)).drop("_p", "_d2")


def dominant_scan(points: DataFrame, size: float, keys: Sequence[str] = ("drive",)) -> DataFrame:
    """Most frequent scan per voxel with its count; equal counts take the earlier scan."""
    per = with_voxel(points, size).groupBy(*keys, *VOXEL, "scan_id").agg(F.count(F.lit(1)).alias("_n"))
    best = per.groupBy(*keys, *VOXEL).agg(
        F.max_by("scan_id", F.struct("_n", (-F.col("scan_id")).alias("_s"))).alias("dominant"),
        F.max("_n").alias("dominant_n"), F.sum("_n").alias("n"),
    )
    return best


# --- registration systems ------------------------------------------------------------------------------


def robust_cost(residual: Column, scale: float) -> Column:
    return F.lit(scale * scale) * residual * residual / (F.lit(scale) + residual * residual)


def robust_weight(residual: Column, scale: float) -> Column:
    denominator = F.lit(scale) + residual * residual
    return F.lit(scale * scale) / (denominator * denominator)


JAC = tuple(f"j{i}" for i in range(6))
HESSIAN = tuple((i, k) for i in range(6) for k in range(i, 6))


def plane_index(
    map_points: DataFrame, surface: DataFrame, size: float, keys: Sequence[str] = ("drive",)
) -> DataFrame:
    """Block index of the map whose points carry their voxel's normal (null when the voxel is not planar)."""
    normals = surface.select(
        *keys, *VOXEL, *[F.when(F.col("planar"), F.col(f"n_{a}")).alias(f"n_{a}") for a in AXES]
    )
    tagged = with_voxel(map_points, size).join(normals, [*keys, *VOXEL], "left").drop(*VOXEL)
    return block_index(tagged, size, [f"n_{a}" for a in AXES], keys)


def plane_residuals(
    points: DataFrame, poses: DataFrame, index: DataFrame | DenseMap, size: float, max_distance: float,
    keys: Sequence[str] = ("drive",), scan_keys: Sequence[str] = SCAN, few_poses: bool = False,
) -> DataFrame:
    """Point-to-plane residual of every body point at its scan's pose, with the six Jacobian entries. `index` is a block index
    (`plane_index`) or a map with all its points.

    A point without a usable plane keeps `usable` false and the residual `max_distance`. With `few_poses` the poses are
    broadcast, before the search and behind it again, so that only places in the map are dealt by voxel.
    """
    def nearest(queries: DataFrame) -> DataFrame:
        if isinstance(index, DenseMap):
            return index.closest(queries, max_distance)
        return closest_map_point(queries, index, size, max_distance, keys)

    own = poses.select(*scan_keys, *[F.col(n).alias(f"_p{n}") for n in rigid.POSE_FIELDS])
    own = F.broadcast(own) if few_poses else own
    at = points.select(*scan_keys, "idx", *[F.col(a).alias(f"b{a}") for a in AXES]).join(own, list(scan_keys))
    w = rigid.pose("_p").apply(rigid.vec("b"))
    at = at.withColumns({"x": w.x, "y": w.y, "z": w.z})
    if few_poses:
        hit = nearest(at.select(*scan_keys, "idx", *AXES)).join(own, list(scan_keys))
        back = rigid.pose("_p").inverse().apply(rigid.vec())
        hit = hit.withColumns({f"b{a}": c for a, c in zip(AXES, back, strict=True)})
    else:
        hit = nearest(at)
    n = rigid.Vec(*[F.col(f"hit.p.n_{a}") for a in AXES])
    gap = rigid.Vec(*[F.col(a) - F.col(f"hit.p.{a}") for a in AXES])
    usable = F.col("hit.p.n_x").isNotNull()
    hit = hit.withColumns(
        {"usable": usable, "residual": F.when(usable, n.dot(gap)).otherwise(float(max_distance))}
    )
    nb = rigid.Quat(*[F.col(f"_p{c}") for c in ("qw", "qx", "qy", "qz")]).conj().rotate(n)
    hit = hit.withColumns({f"j{i}": c for i, c in enumerate(nb)})
    body = rigid.vec("b")
    turn = body.cross(rigid.Vec(F.col("j0"), F.col("j1"), F.col("j2")))
    return hit.withColumns({f"j{i + 3}": c for i, c in enumerate(turn)}).select(
        *scan_keys, "idx", "usable", "residual", *JAC
    )


def plane_normal_equations(
    residuals: DataFrame, kernel_scale: float = 0.5, scan_keys: Sequence[str] = SCAN
) -> DataFrame:
    """Per scan: 21 + 6 robust-weighted sums, correspondences, cost sum and point count. Plain sums only."""
    rows = residuals.withColumns(
        {"_w": F.when(F.col("usable"), robust_weight(F.col("residual"), kernel_scale)),
         "_c": robust_cost(F.col("residual"), kernel_scale)}
    )
    return rows.groupBy(*scan_keys).agg(
        *[F.sum(F.col("_w") * F.col(f"j{i}") * F.col(f"j{k}")).alias(f"h{i}{k}") for i, k in HESSIAN],
        *[F.sum(F.col("_w") * F.col("residual") * F.col(f"j{i}")).alias(f"g{i}") for i in range(6)],
        F.count_if("usable").alias("correspondences"), F.sum("_c").alias("cost_sum"), F.count(F.lit(1)).alias("n"),
    )


def plane_cost(residuals: DataFrame, kernel_scale: float = 0.5, scan_keys: Sequence[str] = SCAN) -> DataFrame:
    return residuals.groupBy(*scan_keys).agg(F.avg(robust_cost(F.col("residual"), kernel_scale)).alias("robust_cost"))
