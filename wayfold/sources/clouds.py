"""Raw cloud messages to point rows, and the static frame join."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import rigid

# Datatype codes of the message format: fixed values.
DATATYPES = {1: "i1", 2: "u1", 3: "i2", 4: "u2", 5: "i4", 6: "u4", 7: "f4", 8: "f8"}
INTENSITY_TYPES = (2, 3, 4, 6, 7, 8)
FLOAT_TYPES = (7, 8)
TIME_NAMES = ("time", "t", "timestamp")
INTENSITY_NAMES = ("intensity", "i", "reflectivity")
MAX_HEADER_OFFSET = 0.25
MAX_RELATIVE = 1000.0


def attach_extrinsic(
    rows: DataFrame, extrinsics: DataFrame, keys: Sequence[str] = ("drive",)
) -> tuple[DataFrame, DataFrame]:
    """(rows with the sensor-to-body pose of their `frame_id` as struct `ext`, dropped counts per key)."""
    table = extrinsics.select(*keys, "frame_id", rigid.pose().struct().alias("ext"))
    named = rows.filter(F.col("frame_id").isNotNull() & (F.col("frame_id") != ""))
    joined = named.join(table, [*keys, "frame_id"])
    known = table.select(*keys, "frame_id", F.lit(True).alias("_known"))
    flagged = rows.join(known, [*keys, "frame_id"], "left")
    lost = F.col("_known").isNull() | F.coalesce(F.col("frame_id") == "", F.lit(True))
    dropped = flagged.groupBy(*keys).agg(F.count_if(lost).alias("dropped"), F.count(F.lit(1)).alias("total"))
    return joined, dropped


def _field(fields: list[dict], names: Sequence[str]) -> dict | None:
    by_name = {f["name"]: f for f in fields}
    return next((by_name[n] for n in names if n in by_name), None)


def _read(raw: np.ndarray, step: int, field: dict, swap: str) -> np.ndarray:
    dtype = np.dtype(swap + DATATYPES[field["datatype"]])
    view = np.ndarray(len(raw) // step, dtype, raw, field["offset"], (step,))
    return view.astype(np.float64)


def unpack_cloud(
    data: bytes, step: int, fields: list[dict], big: bool, header: float, time_field: str | None,
    min_range: float, max_range: float,
) -> dict[str, np.ndarray]:
    """Kept returns of one message as columns. Empty when x, y, z or a time field is missing.

    The time rule looks at the kept returns: all within 0.25 s of the header are absolute stamps; else, if
    they stay below 1000 s in size, they count from the header; else every return gets the header stamp.
    """
    empty = {c: np.zeros(0) for c in ("idx", "t", "x", "y", "z", "intensity")}
    raw = np.frombuffer(data, np.uint8)
    raw = raw[: len(raw) // step * step] if step > 0 else raw[:0]
    swap = ">" if big else "<"
    where = {a: _field(fields, (a,)) for a in "xyz"}
    where["t"] = _field(fields, ((time_field,) if time_field else ()) + TIME_NAMES)
    if not len(raw) or any(f is None or f["datatype"] not in FLOAT_TYPES for f in where.values()):
        return empty
    out = {a: _read(raw, step, f, swap) for a, f in where.items()}
    bright = _field(fields, INTENSITY_NAMES)
    known = bright is not None and bright["datatype"] in INTENSITY_TYPES
    out["intensity"] = _read(raw, step, bright, swap) if known else np.zeros(len(out["x"]))
    out["idx"] = np.arange(len(out["x"]))
    r2 = out["x"] ** 2 + out["y"] ** 2 + out["z"] ** 2
    keep = np.isfinite(r2) & np.isfinite(out["t"]) & (r2 >= min_range**2)
    if max_range > 0.0:
        keep &= r2 <= max_range**2
    out = {c: v[keep] for c, v in out.items()}
    if len(out["t"]) and np.abs(out["t"] - header).max() > MAX_HEADER_OFFSET:
        relative = np.abs(out["t"]).max() < MAX_RELATIVE
        out["t"] = out["t"] + header if relative else np.full(len(out["t"]), header)
    return out


def explode_clouds(
    clouds: DataFrame, time_field: str | None = None, min_range: float = 0.0, max_range: float = 0.0,
    carry: Sequence[str] = (),
) -> DataFrame:
    """One row per kept return, unpacked in Arrow batches on the row's own task - no shuffle."""
    source = clouds.schema
    kept = ["drive", "scan_id", *carry]
    numbers = ("t", "x", "y", "z")
    schema = T.StructType(
        [*[source[c] for c in kept], T.StructField("idx", T.LongType()),
         *[T.StructField(c, T.DoubleType()) for c in numbers], T.StructField("intensity", T.FloatType())]
    )
    names = [f.name for f in schema.fields]

    def unpack(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                one = batch.slice(row, 1)
                msg = {n: one.column(n)[0].as_py() for n in ("stamp", "point_step", "fields", "is_bigendian", "data")}
                cols = unpack_cloud(
                    msg["data"] or b"", msg["point_step"] or 0, msg["fields"] or [], bool(msg["is_bigendian"]),
                    msg["stamp"], time_field, min_range, max_range,
                )
                copies = pa.array(np.zeros(len(cols["x"]), np.int64))
                arrays = [one.column(c).take(copies) for c in kept]
                arrays.append(pa.array(cols["idx"].astype(np.int64)))
                arrays += [pa.array(cols[c]) for c in numbers]
                arrays.append(pa.array(cols["intensity"].astype(np.float32)))
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    needed = clouds.select(*kept, "stamp", "point_step", "fields", "is_bigendian", "data")
    return needed.mapInArrow(unpack, schema).select("drive", "scan_id", "idx", *numbers, "intensity", *carry)
