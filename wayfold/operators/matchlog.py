"""Scan-match logs: acceptance gates, health states, status rows and stage telemetry.

A match log row: `drive, stamp, idx` and the match columns named in each function. Missing numbers are null
(a NaN in a source becomes null on read); "finite" therefore means "not null".
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .metrics import exact_quantiles
from .ordered import Chunks, running

DRIVE = ("drive",)
STAGES = ("deskew_ms", "voxel_ms", "align_ms", "cost_ms", "refine_ms", "map_ms")


@dataclass(frozen=True)
class GateParams:
    """Acceptance limits of a scan match."""

    max_ndt_cost: float = 7.81
    min_ndt_inlier_fraction: float = 0.5
    min_inlier_ratio: float = 0.3
    max_translation: float = 1.0
    max_rotation: float = 0.2
    recovery_max_translation: float = 3.0
    small_translation: float = 0.25
    small_rotation: float = 0.05
    small_cost_scale: float = 2.0
    worse_than_seed: float = 0.5
    partial_min_iterations: int = 3
    partial_max_step: float = 0.05


def finite(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf"))


def gate_matches(log: DataFrame, params: GateParams = GateParams()) -> DataFrame:
    """Add `passes`, `reason` and `partial_used`.

    Reads `iterations, last_step, translation_m, rotation_rad, ndt_cost, ndt_inliers, inlier_ratio, cost,
    timed_out, recovering, seed_ndt_cost`.
    """
    p = params
    solved = F.col("iterations") + 0.5 >= p.partial_min_iterations
    ndt_ok = finite(F.col("ndt_cost"))
    enough = F.coalesce(F.col("ndt_inliers") >= p.min_ndt_inlier_fraction, F.lit(False))
    small = (F.col("translation_m") <= p.small_translation) & (F.col("rotation_rad") <= p.small_rotation)
    strict = ndt_ok & (F.col("ndt_cost") < p.max_ndt_cost) & enough
    soft = small & enough & (~ndt_ok | (F.col("ndt_cost") < p.small_cost_scale * p.max_ndt_cost))
    worse = (
        F.col("recovering") & ~small & finite(F.col("seed_ndt_cost")) & ndt_ok
        & (F.col("ndt_cost") > F.col("seed_ndt_cost") + p.worse_than_seed)
    )
    reach = F.when(F.col("recovering") & strict, p.recovery_max_translation).otherwise(p.max_translation)
    step_ok = (F.col("translation_m") <= reach) & (F.col("rotation_rad") <= p.max_rotation)
    reason = (
        F.when(F.col("timed_out") & ~solved, "timeout")
        .when(worse, "worse_than_seed")
        .when(~(F.col("iterations") > 0), "no_iterations")
        .when(~F.coalesce(step_ok, F.lit(False)), "step")
        .when(~finite(F.col("cost")), "cost")
        .when(ndt_ok & ~strict & ~soft, "ndt")
        .when(~F.coalesce(F.col("inlier_ratio") >= p.min_inlier_ratio, F.lit(False)), "inliers")
        .otherwise("ok")
    )
    partial = F.col("timed_out") & solved & F.coalesce(F.col("last_step") <= p.partial_max_step, F.lit(False))
    return log.withColumns({"reason": reason, "partial_used": partial}).withColumn(
        "passes", F.col("reason") == "ok"
    )


def step_within_limits(
    translation: Column, yaw: Column, dt: Column, max_speed: float = 20.0, max_yaw_rate: float = 1.0
) -> Column:
    """A step no faster than the vehicle. Shorter than 1 ms passes; a non-finite step fails."""
    return (
        F.when(~(finite(translation) & finite(yaw)), F.lit(False))
        .when(~F.coalesce(dt >= 1.0e-3, F.lit(False)), F.lit(True))
        .otherwise((translation / dt <= max_speed) & (F.abs(yaw) / dt <= max_yaw_rate))
    )


def health_states(
    events: DataFrame, max_rejects: int = 5, keys: Sequence[str] = DRIVE, chunks: Chunks | None = None,
    order: Sequence[str] = ("stamp", "idx"),
) -> DataFrame:
    """Health after every event, in closed form over running aggregates - no fold.

    `event` is one of Accepted, Saturated, Rejected, KinematicViolation, SpeedClamped, TimedOut. An Accepted
    event opens a new island; inside an island the reject streak counts up and Diverged is absorbing. The
    timeout streak restarts at Rejected, Saturated and Accepted only.
    """
    chunks = chunks or Chunks.plan(events, keys, order[0])
    limit = max(1, max_rejects)
    event = F.col("event")
    kinematic = event.isin("KinematicViolation", "SpeedClamped")
    strike = F.when(kinematic | (event == "Rejected"), 1).otherwise(0)
    settles = event.isin("Rejected", "Saturated", "Accepted")
    counted = running(
        events, keys, order,
        {
            "_strikes": ("sum", strike),
            "_timeouts": ("sum", F.when(event == "TimedOut", 1).otherwise(0)),
            "_jolts": ("sum", F.when(kinematic, 1).otherwise(0)),
        },
        chunks,
    )
    # Totals at the latest Accepted / settling event are the zero points of the streaks.
    based = running(
        counted, keys, order,
        {
            "_s0": ("max", F.when(event == "Accepted", F.col("_strikes"))),
            "_j0": ("max", F.when(event == "Accepted", F.col("_jolts"))),
            "_t0": ("max", F.when(settles, F.col("_timeouts"))),
        },
        chunks,
    )
    based = based.withColumns(
        {
            "reject_streak": F.col("_strikes") - F.coalesce("_s0", F.lit(0)),
            "timeout_streak": F.col("_timeouts") - F.coalesce("_t0", F.lit(0)),
        }
    )
    # Inside an island the streak never falls, so "a Rejected at or past the limit was seen" is a running
    # maximum of island totals against the island's own base.
    over = running(
        based, keys, order,
        {"_over": ("max", F.when((event == "Rejected") & (F.col("reject_streak") >= limit), F.col("_strikes")))},
        chunks,
    )
    diverged = (F.col("_jolts") > F.coalesce("_j0", F.lit(0))) | (
        F.coalesce("_over", F.lit(0)) > F.coalesce("_s0", F.lit(0))
    )
    health = F.when(event == "Accepted", "healthy").when(diverged, "diverged").otherwise("degraded")
    level = F.when(F.col("health") == "healthy", "OK").when(F.col("health") == "degraded", "WARN").otherwise("ERROR")
    restore = kinematic | ((F.col("health") == "diverged") & event.isin("Rejected", "Saturated"))
    return (
        over.withColumn("health", health)
        .withColumns({"level": level, "update_bias": event == "Accepted", "restore_speed": restore})
        .drop("_strikes", "_timeouts", "_jolts", "_s0", "_j0", "_t0", "_over")
    )


def skipped_total(
    log: DataFrame, keys: Sequence[str] = DRIVE, chunks: Chunks | None = None,
    order: Sequence[str] = ("stamp", "idx"),
) -> DataFrame:
    """Running count of scans that were skipped or timed out without a pose update."""
    lost = F.col("skipped") | (F.col("timed_out") & ~F.col("applied"))
    return running(log, keys, order, {"skipped_total": ("sum", F.when(lost, 1).otherwise(0))}, chunks)


def match_status(log: DataFrame) -> DataFrame:
    """Rows a live run would report: timeouts, and applied matches that are not the first."""
    timeout = F.col("timed_out") & ~F.col("applied")
    status = F.when(timeout, "timeout").when(F.col("saturated"), "saturated").otherwise("applied")
    return log.filter(timeout | (F.col("applied") & ~F.col("first"))).withColumns(
        {
            "status": status,
            "ndt_cost": F.when(finite(F.col("ndt_cost")), F.col("ndt_cost")).otherwise(-1.0),
            "total_ms": sum((F.col(s) for s in STAGES[1:]), F.col(STAGES[0])),
        }
    )


def stage_latency(
    log: DataFrame, keys: Sequence[str] = DRIVE, chunks: Chunks | None = None
) -> DataFrame:
    """Median and total of every stage, with skip and timeout counts."""
    out = log.groupBy(*keys).agg(
        *[F.sum(s).alias(f"{s}_total") for s in STAGES],
        F.count_if(F.col("skipped")).alias("skipped"), F.count_if(F.col("timed_out")).alias("timed_out"),
        F.count(F.lit(1)).alias("scans"),
    )
    # All stages in one table and one pass.
    long = log.select(*keys, F.explode(F.array(*[F.struct(F.lit(s).alias("stage"), F.col(s).cast("double").alias("ms")) for s in STAGES])).alias("_s"))
    medians = exact_quantiles(long.select(*keys, "_s.stage", "_s.ms"), [*keys, "stage"], "ms", {"median": 0.5}, chunks=chunks)
    wide = medians.groupBy(*keys).agg(*[F.max(F.when(F.col("stage") == s, F.col("median"))).alias(f"{s}_median") for s in STAGES])
    return out.join(wide, list(keys), "left")


def scan_stages(log: DataFrame, keys: Sequence[str] = DRIVE, chunks: Chunks | None = None) -> DataFrame:
    """Message rows of the stage telemetry."""
    out = skipped_total(log, keys, chunks)
    return out.select(*keys, "stamp", *STAGES, "timed_out", "skipped", "applied", "skipped_total")


def health_by_window(events: DataFrame, window: str = "1 hour", keys: Sequence[str] = DRIVE) -> DataFrame:
    """Event counts per tumbling window; works on batch and on streams with a watermark on `ts`."""
    names = ("Accepted", "Saturated", "Rejected", "KinematicViolation", "SpeedClamped", "TimedOut")
    return (
        events.groupBy(*keys, F.window("ts", window))
        .agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("event") == n).alias(n.lower()) for n in names])
        .select(*keys, F.col("window.start").alias("window_start"), "n", *[n.lower() for n in names])
    )
