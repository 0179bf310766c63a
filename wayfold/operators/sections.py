"""Stretches of high error: where they are, how bad they are, and which estimator led them."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..formats import FILTER, ODOM, TAG_BOTH, TAG_FILTER, TAG_NONE, TAG_ODOM, TAG_UNKNOWN
from .metrics import exact_quantiles
from .ordered import Chunks, join_equal, running

DRIVE = ("drive",)


def section_threshold(
    errors: DataFrame, error: str = "horiz", floor_m: float = 5.0, percentile: float = 90.0,
    keys: Sequence[str] = DRIVE, chunks: Chunks | None = None,
) -> DataFrame:
    """max(floor, percentile of the finite errors) per key; the floor where nothing is finite."""
    finite = errors.withColumn(
        "_e", F.when(~F.isnan(error) & (F.abs(F.col(error)) != float("inf")), F.col(error))
    )
    q = exact_quantiles(finite, keys, "_e", {"_q": percentile / 100.0}, chunks=chunks)
    every = errors.select(*keys).distinct()
    return every.join(q, list(keys), "left").select(
        *keys, F.greatest(F.lit(float(floor_m)), F.col("_q")).alias("threshold_m")
    )


def error_spans(
    errors: DataFrame, thresholds: DataFrame, min_length_m: float, error: str = "horiz", distance: str = "distance",
    keys: Sequence[str] = DRIVE, chunks: Chunks | None = None,
) -> DataFrame:
    """Maximal runs with a finite error at or above the threshold that cover at least `min_length_m`."""
    rows = errors.join(thresholds, list(keys))
    finite = F.col(error).isNotNull() & ~F.isnan(error) & (F.abs(F.col(error)) != float("inf"))
    rows = rows.withColumn("_above", finite & (F.col(error) >= F.col("threshold_m")))
    rows = running(
        rows, keys, ("stamp", "idx"), {"_island": ("sum", F.when(F.col("_above"), 0).otherwise(1))}, chunks
    ).filter("_above")
    order = F.struct("stamp", "idx")
    spans = rows.groupBy(*keys, "_island").agg(
        F.min("stamp").alias("stamp_start"), F.max("stamp").alias("stamp_end"),
        F.min_by(distance, order).alias("distance_start"), F.max_by(distance, order).alias("distance_end"),
        F.count(F.lit(1)).alias("n"), F.first("threshold_m").alias("threshold_m"),
    )
    return spans.filter(F.col("distance_end") - F.col("distance_start") >= min_length_m).drop("_island")


#: Shares of a key's segments above which a score is looked up, and the accuracy of the lookup (ranks are right to n / ACCURACY).
_SHARES, ACCURACY = [1.0 - 0.5**i for i in range(1, 13)], 10_000


def _contenders(segments: DataFrame, top_k: int, keys: Sequence[str]) -> DataFrame:
    """Segments among which are the `top_k` that the greedy choice keeps.

    Each kept segment takes at most those out that overlap it, and these start less than the longest segment away: in its own tile or a
    neighbouring one, if tiles are as wide. So the choice looks at no more than (top_k - 1) * (3 * fullest tile) + top_k segments in
    descending order, and a score that at least as many reach comes from a quantile sketch. Two aggregates, both combined map-side."""
    scores = segments.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), F.max(F.col("last_rn") - F.col("first_rn") + 1).alias("_width"),
        F.percentile_approx("translation_percent", _SHARES, ACCURACY).alias("_cuts"),
    )
    tiles = join_equal(segments.select(*keys, "first_rn"), scores.select(*keys, "_width"), keys)
    full = tiles.groupBy(*keys, F.expr("first_rn div _width").alias("_tile")).count().groupBy(*keys).agg(F.max("count").alias("_most"))
    wanted = (top_k - 1) * 3 * F.col("_most") + top_k
    # The largest share whose score is surely reached by enough segments, the sketch's error taken off.
    enough = F.array_max(F.filter(F.array(*[F.struct(F.lit(q).alias("q"), F.lit(i).alias("i")) for i, q in enumerate(_SHARES)]),
                                  lambda x: F.col("_n") * (1.0 - x.q - 2.0 / ACCURACY) >= F.col("_wanted")))
    cut = join_equal(scores, full, keys).withColumn("_wanted", wanted).withColumn("_e", enough)
    cut = cut.select(*keys, F.when(F.col("_e").isNotNull(), F.element_at("_cuts", F.col("_e.i") + 1)).alias("_cut"))
    return join_equal(segments, cut, keys).filter(F.col("_cut").isNull() | (F.col("translation_percent") >= F.col("_cut"))).drop("_cut")


def worst_segments(
    segments: DataFrame, top_k: int, length_m: float = 100.0, keys: Sequence[str] = ("drive", "space")
) -> DataFrame:
    """Worst segments of one length, greedily kept when their pose ranges do not overlap a kept one (borders included).

    Equal errors keep the earlier start, then the earlier end. Whatever `top_k`, the segments are aggregated and compared with one score per key,
    and the few contenders of a key meet in one group. Segments without an error (null or NaN) are never worst."""
    segments = segments.filter((F.col("length_m") == length_m) & F.col("translation_percent").isNotNull() & ~F.isnan("translation_percent"))
    few = _contenders(segments, top_k, keys)
    schema = T.StructType([*few.schema.fields, T.StructField("rank", T.IntegerType(), False)])

    def chosen(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["translation_percent", "first_rn", "last_rn"], ascending=[False, True, True], kind="stable")
        begins, ends = rows["first_rn"].to_numpy(), rows["last_rn"].to_numpy()
        free, kept = np.ones(len(rows), bool), []
        while len(kept) < top_k and free.any():
            best = int(free.argmax())
            kept.append(best)
            free &= (ends < begins[best]) | (begins > ends[best])
            free[best] = False
        return rows.iloc[kept].assign(rank=np.arange(1, len(kept) + 1, dtype="int32"))

    return few.groupBy(*keys).applyInPandas(chosen, schema)


def classify_error_source(
    leader: Column, ekf: Column, residual: Column, far: Column | float
) -> Column:
    """Blame for a window, from both estimators' errors and the filter's residual to the odometry."""
    far = far if isinstance(far, Column) else F.lit(float(far))
    finite = reduce(
        lambda a, b: a & b,
        [c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")) for c in (leader, ekf, residual, far)],
    )
    leader_far, ekf_far = leader >= far, ekf >= far
    residual_small = residual < F.greatest(F.lit(1.0), F.lit(0.35) * F.greatest(leader, ekf, F.lit(0.0)))
    return (
        F.when(~F.coalesce(finite, F.lit(False)), TAG_UNKNOWN)
        .when(leader_far & residual_small, TAG_ODOM)
        .when(ekf_far & ~leader_far, TAG_FILTER)
        .when(leader_far & ekf_far, TAG_BOTH)
        .when(leader_far, TAG_ODOM)
        .otherwise(TAG_NONE)
    )


def section_overlap(
    sections: DataFrame, rows: DataFrame, stamp: str = "stamp", keys: Sequence[str] = DRIVE,
    bucket_s: float = 600.0,
) -> DataFrame:
    """Rows with a stamp inside a section (inclusive): an equi-join on time buckets plus the exact test.

    A section is listed once per bucket it touches, so a long section spreads over many tasks.
    """
    s = sections.withColumn(
        "_bucket",
        F.explode(
            F.sequence(
                F.floor(F.col("stamp_start") / bucket_s).cast("bigint"),
                F.floor(F.col("stamp_end") / bucket_s).cast("bigint"),
            )
        ),
    )
    r = rows.withColumn("_bucket", F.floor(F.col(stamp) / bucket_s).cast("bigint"))
    inside = (F.col(stamp) >= F.col("stamp_start")) & (F.col(stamp) <= F.col("stamp_end"))
    return s.join(r, [*keys, "_bucket"]).filter(inside).drop("_bucket")


def filter_stats(
    sections: DataFrame, signals: DataFrame, sources: DataFrame, keys: Sequence[str] = DRIVE, bucket_s: float = 600.0,
    chunks: Chunks | None = None,
) -> DataFrame:
    """Filter health inside each section (`section_id`): residual, yaw, bias change, pose age, speed.

    Signals: `idx, err_x, err_y, err_yaw, bg_*, ba_*, odom_age, body_vx, body_vy`, null = missing. `sources`: the filter's
    error rows, `stamp, idx, est_idx`. A section takes the signals of the rows that its errors were measured on, each as
    often as it was used, not all that were recorded meanwhile.
    """
    sid = [*keys, "section_id"]
    used = section_overlap(
        sections.select(*sid, "stamp_start", "stamp_end"), sources.select(*keys, "stamp", "idx", "est_idx"), "stamp", keys, bucket_s
    ).select(*sid, F.struct("stamp", "idx").alias("_when"), "est_idx")
    hit = used.join(signals.drop("stamp").withColumnRenamed("idx", "est_idx"), [*keys, "est_idx"])

    def change(names: Sequence[str]) -> Column:
        present = reduce(lambda a, b: a & b, [F.col(n).isNotNull() for n in names])
        when = F.when(present, F.col("_when"))
        first = F.min_by(F.struct(*names), when)
        last = F.max_by(F.struct(*names), when)
        total = sum(((last[n] - first[n]) ** 2 for n in names), F.lit(0.0))
        return F.when(F.sum(F.when(present, 1).otherwise(0)) >= 2, F.sqrt(total))

    stats = hit.groupBy(*sid).agg(
        F.avg(F.hypot("err_x", "err_y")).alias("residual_xy_mean_m"),
        F.degrees(F.sqrt(F.avg(F.col("err_yaw") ** 2))).alias("filter_yaw_rmse_deg"),
        change(("bg_x", "bg_y", "bg_z")).alias("gyro_bias_delta"),
        change(("ba_x", "ba_y", "ba_z")).alias("accel_bias_delta"),
        F.avg(F.hypot("body_vx", "body_vy")).alias("speed_mean_mps"),
    )
    age = exact_quantiles(hit, sid, "odom_age", {"odom_age_p95_s": 0.95}, chunks=chunks)
    return stats.join(age, sid, "left")


def section_summary(
    sections: DataFrame, errors: DataFrame, keys: Sequence[str] = DRIVE, bucket_s: float = 600.0,
    owner: str = "estimator",
) -> DataFrame:
    """Per section: error of its own estimator and the mean horizontal error of both estimators.

    `errors`: `estimator, stamp, horiz, vert, yaw_deg` for both estimators.
    """
    sid = [*keys, "section_id"]
    s = sections.select(*sid, F.col(owner).alias("_owner"), "stamp_start", "stamp_end")
    hit = section_overlap(s, errors, "stamp", keys, bucket_s)
    own = F.col("estimator") == F.col("_owner")

    def rms(name: str) -> Column:
        return F.sqrt(F.avg(F.when(own, F.col(name) ** 2)))

    def mean_of(name: str) -> Column:
        return F.avg(F.when(F.col("estimator") == name, F.col("horiz")))

    return hit.groupBy(*sid).agg(
        rms("horiz").alias("horiz_rmse_m"), F.max(F.when(own, F.col("horiz"))).alias("horiz_max_m"),
        rms("vert").alias("vert_rmse_m"), rms("yaw_deg").alias("yaw_rmse_deg"),
        mean_of(ODOM).alias("odom_horiz_mean_m"), mean_of(FILTER).alias("ekf_horiz_mean_m"),
    )
