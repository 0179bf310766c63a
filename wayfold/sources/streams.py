"""Message tables as stream sinks: each micro-batch owns its partition, so a batch that is delivered again adds nothing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import matchlog
from ..schemas import BODY_FRAME_ERROR, ICP_DEBUG, KITTI_ERROR, POSE_REFINE, SCAN_STAGES

MESSAGES = {
    "body_frame_error": BODY_FRAME_ERROR, "kitti_error": KITTI_ERROR, "scan_stages": SCAN_STAGES, "icp_debug": ICP_DEBUG, "pose_refine": POSE_REFINE,
}


def conform(rows: DataFrame, schema: T.StructType) -> DataFrame:
    """`rows` with the columns and types of a message; what it does not have is null. The key keeps its own type."""
    have = set(rows.columns)
    return rows.select(
        *[(F.col(f.name) if f.name in have else F.lit(None)).cast(rows.schema[f.name].dataType if f.name == "drive" else f.dataType).alias(f.name) for f in schema.fields]
    )


def scan_stages(log: DataFrame) -> DataFrame:
    """Stage telemetry rows of a match log that has its running `skipped_total`."""
    return conform(log, SCAN_STAGES)


def icp_debug(log: DataFrame) -> DataFrame:
    """Status rows of a match log: timeouts, and applied matches after the first."""
    return conform(matchlog.match_status(log).withColumn("partial", F.col("timed_out") & F.col("applied")), ICP_DEBUG)


def body_frame_error(rows: DataFrame) -> DataFrame:
    return conform(rows, BODY_FRAME_ERROR)


def kitti_error(rows: DataFrame) -> DataFrame:
    return conform(rows, KITTI_ERROR)


def pose_refine(rows: DataFrame) -> DataFrame:
    """One row per refined window: `scans` poses, of which `settled` moved no more, and the largest shift."""
    return conform(rows, POSE_REFINE)


class MessageSink:
    """Writer for `foreachBatch`: `tables` maps a message to the function that makes its rows of a batch.

    A batch's rows go to `<folder>/<message>/batch=<number>`, which is replaced as a whole. Spark gives a batch that it repeats after a
    failure the same number and the same rows, so the tables hold every row once. The batch is kept while it is
    written to several tables."""

    def __init__(self, folder: str, tables: dict[str, Callable[[DataFrame], DataFrame]]):
        unknown = set(tables) - set(MESSAGES)
        if unknown:
            raise ValueError(f"no message {', '.join(sorted(unknown))}; known messages: {', '.join(MESSAGES)}")
        self.folder, self.tables = folder, tables

    def __call__(self, batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            for name, make in self.tables.items():
                make(batch).write.mode("overwrite").parquet(f"{self.folder}/{name}/batch={number}")
        finally:
            batch.unpersist()

    def read(self, spark: SparkSession, name: str) -> DataFrame:
        return spark.read.parquet(f"{self.folder}/{name}").drop("batch")
