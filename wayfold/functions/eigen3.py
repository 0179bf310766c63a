"""Symmetric 3x3 matrices: eigenvalues and inverse as Column expressions, directions in Arrow batches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import columns
from .rigid import clamp
from .staging import let

SYM = ("xx", "xy", "xz", "yy", "yz", "zz")


def with_eigenvalues(df: DataFrame, cov: str, into: str) -> DataFrame:
    """Add `<into>1 >= <into>2 >= <into>3` for the covariance columns `<cov>xx ... <cov>zz`."""
    t = f"_{into}"
    a = {s: F.col(cov + s) for s in SYM}
    b = {s: F.col(f"{t}b{s}") for s in SYM}
    q, p, f = F.col(f"{t}q"), F.col(f"{t}p"), F.col(f"{t}f")
    off = a["xy"] * a["xy"] + a["xz"] * a["xz"] + a["yz"] * a["yz"]
    spread = sum(((a[s] - q) * (a[s] - q) for s in ("xx", "yy", "zz")), off * 2.0)
    det = (
        b["xx"] * (b["yy"] * b["zz"] - b["yz"] * b["yz"]) - b["xy"] * (b["xy"] * b["zz"] - b["yz"] * b["xz"])
        + b["xz"] * (b["xy"] * b["yz"] - b["yy"] * b["xz"])
    )
    steps = {
        f"{t}q": (a["xx"] + a["yy"] + a["zz"]) / 3.0,
        f"{t}p": F.sqrt(spread / 6.0),
        **{f"{t}b{s}": F.when(p > 0, (a[s] - q if s[0] == s[1] else a[s]) / p) for s in SYM},
        f"{t}f": F.when(p > 0, F.acos(clamp(det * 0.5, -1.0, 1.0)) / 3.0).otherwise(0.0),
        f"{into}1": q + p * 2.0 * F.cos(f),
        f"{into}3": q + p * 2.0 * F.cos(f + F.pi() * 2.0 / 3.0),
        f"{into}2": q * 3.0 - F.col(f"{into}1") - F.col(f"{into}3"),
    }
    return let(df, steps, [n for n in steps if n.startswith("_")])


@F.pandas_udf(columns(", ".join(f"{v}{a} double" for v in "nm" for a in "xyz")))
def _axes(cov: pd.DataFrame) -> pd.DataFrame:
    """Directions of the smallest and largest eigenvalue of a batch of matrices; the largest entry is positive."""
    c = cov.to_numpy(float)
    good = np.isfinite(c).all(axis=1)
    full = np.where(good[:, None], c, 0.0)[:, [0, 1, 2, 1, 3, 4, 2, 4, 5]].reshape(-1, 3, 3)
    vectors = np.linalg.eigh(full)[1][:, :, [0, 2]].transpose(0, 2, 1)
    lead = np.take_along_axis(vectors, np.abs(vectors).argmax(axis=2)[:, :, None], 2)
    vectors = (vectors * np.where(lead < 0, -1.0, 1.0)).reshape(-1, 6)
    return pd.DataFrame(np.where(good[:, None], vectors, np.nan), columns=[f"{v}{a}" for v in "nm" for a in "xyz"])


def with_axes(df: DataFrame, cov: str, normal: str, major: str) -> DataFrame:
    """Add the unit directions of the smallest (`<normal>x..z`) and largest (`<major>x..z`) eigenvalue.

    One row per voxel or cell reaches Python, in Arrow batches; the closed form as columns outgrows the
    size limit of compiled methods.
    """
    out = df.withColumn("_axes", _axes(F.struct(*[F.col(cov + s).alias(s) for s in SYM])))
    named = {f"{p}{a}": F.col(f"_axes.{v}{a}") for v, p in (("n", normal), ("m", major)) for a in "xyz"}
    return out.withColumns(named).drop("_axes")


def inverse_sym(df: DataFrame, cov: str, into: str, regularise: float) -> DataFrame:
    """Add the inverse `<into>xx ...` of cov + regularise * I and `<into>ok`; null entries when singular."""
    reg = max(0.0, regularise)
    a = {s: (F.col(cov + s) + reg if s[0] == s[1] else F.col(cov + s)) for s in SYM}
    cof = {
        "xx": a["yy"] * a["zz"] - a["yz"] * a["yz"], "xy": a["xz"] * a["yz"] - a["xy"] * a["zz"],
        "xz": a["xy"] * a["yz"] - a["xz"] * a["yy"], "yy": a["xx"] * a["zz"] - a["xz"] * a["xz"],
        "yz": a["xy"] * a["xz"] - a["xx"] * a["yz"], "zz": a["xx"] * a["yy"] - a["xy"] * a["xy"],
    }
    c = {s: F.col(f"_{into}c{s}") for s in SYM}
    det = F.col(f"_{into}det")
    steps = {f"_{into}c{s}": e for s, e in cof.items()}
    steps[f"_{into}det"] = a["xx"] * c["xx"] + a["xy"] * c["xy"] + a["xz"] * c["xz"]
    steps[f"{into}ok"] = F.coalesce(F.abs(det) > 1.0e-12, F.lit(False))
    steps |= {f"{into}{s}": F.when(F.col(f"{into}ok"), c[s] / det) for s in SYM}
    return let(df, steps, [n for n in steps if n.startswith("_")])
