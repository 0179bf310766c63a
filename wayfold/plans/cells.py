"""Cell features and segmentation end to end."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import cells as C
from ..operators.ordered import Chunks
from ..operators.points import VOXEL
from ..operators.selection import stable_ids
from ..session import cut

FRAME = ("drive", "frame")


@F.pandas_udf(T.DoubleType())
def _curvature(sums: pd.DataFrame) -> pd.Series:
    n = np.zeros((len(sums), 6, 6))
    for i in range(6):
        for k in range(i, 6):
            n[:, i, k] = n[:, k, i] = sums[f"q{i}{k}"]
    n += 1.0e-9 * np.eye(6)
    rhs = sums[[f"r{i}" for i in range(6)]].to_numpy(float)
    coefficients = np.linalg.solve(n, rhs[:, :, None])[:, :, 0]
    return pd.Series(np.abs(coefficients[:, 0] + coefficients[:, 2]))


def cell_features(
    points: DataFrame, size: float, height: float, min_points: int = 8, keys: Sequence[str] = FRAME
) -> DataFrame:
    """Valid cells with local features, curvature and intensity Laplacian (0 where there is no support)."""
    local = C.local_features(C.cell_stats(points, size, height, keys), size, height, min_points, keys)
    local = cut(local)
    quadric = C.quadric_normal_equations(local, keys).filter(F.col("rows") >= 6)
    names = [c for c in quadric.columns if c[0] in "qr" and c != "rows"]
    bent = quadric.select(*keys, *VOXEL, _curvature(F.struct(*names)).alias("curvature"))
    lap = C.intensity_laplacian(local, size, height, keys)
    on = [*keys, *VOXEL]
    return local.join(bent, on, "left").join(lap, on, "left").na.fill(0.0, ["curvature", "intensity_laplacian"])


@dataclass(frozen=True)
class SegmentParams:
    bins: int = 12
    curvature_max: float = 0.5
    cv_max: float = 1.0
    laplacian_max: float = 1.0
    min_votes: float = 50.0
    separation: int = 2
    max_classes: int = 8
    sigma: float = 0.25
    iterations: int = 3


def segment_cells(
    features: DataFrame, params: SegmentParams = SegmentParams(), keys: Sequence[str] = FRAME,
    chunks: Chunks | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(cells with `label` and `segment`, peaks with stable `id`). `keys` end with the frame number."""
    p, keys = params, list(keys)
    cells = C.feature_vector(features, p.curvature_max, p.cv_max, p.laplacian_max)
    hist = C.feature_histogram(cells, p.bins, keys)
    peaks = C.histogram_peaks(hist, p.bins, p.min_votes, p.separation, p.max_classes, keys)
    peaks = stable_ids(peaks, max(p.separation, 1) / p.bins, keys[:-1], chunks)
    peaks = cut(peaks)
    labelled = cut(C.nearest_peak(cells, peaks, keys).select(*keys, *VOXEL, *C.FEATURES, "label"))
    edges = C.cell_neighbors(labelled, keys)
    smooth = C.propagate_labels(labelled, edges, p.sigma, p.iterations, keys)
    return C.connected_components(smooth, edges, keys), peaks
