"""Helpers shared by the text operators."""

from __future__ import annotations

import ctypes
import gc
import time
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.session import ensure_checkpoint_dir

#: Rows of text handled at a time inside a task, so that a worker holds little besides one Arrow batch.
SLICE_ROWS = 256
#: Seeds of sub-hashes, so that bucket ids of different uses are independent.
MIX_1, MIX_2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialise(df: DataFrame) -> DataFrame:
    """Writes `df` to the shared checkpoint folder and continues from the files: lineage ends there."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Lets the shuffle files of finished stages go: Spark deletes them when the driver's JVM has collected what refers to
    them, which it would otherwise do at some later time (`spark.cleaner.periodicGC.interval`)."""
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)


#: What the operator whose tasks ran last in this Python worker keeps for its next ones.
_KEPT: dict[str, dict] = {}


def worker_memory(owner: str) -> dict:
    """What `owner`'s tasks keep in a Python worker from one task to the next. Spark lends a worker to one stage after another;
    what another operator has left there is let go, and its memory is given back to the system."""
    if owner not in _KEPT:
        _KEPT.clear()
        _KEPT[owner] = {}
        gc.collect()
        pa.default_memory_pool().release_unused()
        if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
            libc.malloc_trim(0)
    return _KEPT[owner]


#: Most rows of keys (some 16 bytes each) that are broadcast.
BROADCAST_ROWS = 1_000_000


def bounded(keys: DataFrame) -> DataFrame:
    """A table of keys for a semi or anti join against texts: written and counted, then broadcast if it has at most
    BROADCAST_ROWS rows, so that the texts need no shuffle; beyond that left to a shuffled join."""
    keys = materialise(keys)
    return F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys


def skew_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join whose `right` has one row per key, often an aggregate by the key. A second key, a hash of the first,
    keeps Spark from reusing the aggregate's partitioning, so that both sides are dealt for the join and the adaptive
    skew join can split the rows of a hot key."""
    left, right = (x.withColumn("_deal", F.xxhash64(*keys)) for x in (left, right))
    return left.join(right, [*keys, "_deal"], how).drop("_deal")


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """Whole texts; null is empty."""
    return ["" if t is None else t for t in batch.column(name).to_pylist()]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit (64-bit)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= MIX_1
    x ^= x >> np.uint64(33)
    x *= MIX_2
    x ^= x >> np.uint64(33)
    return x


def ranges(lengths: np.ndarray) -> np.ndarray:
    """0..n-1 for each n, joined."""
    lengths = np.asarray(lengths, dtype=np.int64)
    total = int(lengths.sum())
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) - np.repeat(ends - lengths, lengths)


def crc_remainder(name: str, modulus: int):
    """crc32 of the id written as text, modulo `modulus`: the folds of the contracts."""
    return F.crc32(F.col(name).cast("string")) % modulus


def local_components(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the links (u, v) and the smallest node of each one's component, by min-label rounds with shortcuts."""
    nodes, both = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = both[: len(u)], both[len(u):]
    label = np.arange(len(nodes))
    while len(a):
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while not np.array_equal(label, jumped := label[label]):
            label = jumped
        live = label[a] != label[b]
        a, b = a[live], b[live]
    return nodes, nodes[label]
