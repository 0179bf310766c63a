"""Surface cells: statistics, neighbour features, and the pieces of the segmentation.

A cell is `keys + (vx, vy, vz)`; keys are usually `(drive, frame)`. All neighbour work is an equi-join after
expanding the 26 offsets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rigid
from ..functions.eigen3 import SYM, with_axes, with_eigenvalues
from ..session import cut
from .points import VOXEL, with_voxel
from .surface import shifted

FRAME = ("drive", "frame")
AXES = ("x", "y", "z")
BINS = tuple(f"b{i}" for i in range(5))
FEATURES = tuple(f"f{i}" for i in range(5))
VOTE_CAP = 32


def cell_stats(points: DataFrame, size: float, height: float, keys: Sequence[str] = FRAME) -> DataFrame:
    """Counts, intensity sums and first / second moments of each cell, plain and intensity-weighted.

    Moments are taken about the cell corner, so they keep their digits on map coordinates.
    """
    rows = with_voxel(points, size, height).withColumns(
        {f"_l{a}": F.col(a) - F.col(v) * float(s) for a, v, s in zip(AXES, VOXEL, (size, size, height), strict=True)}
    )
    rows = rows.withColumns({"_i": F.col("intensity").cast("double")}).withColumn("_w", F.greatest("_i", F.lit(0.0)))
    pair = {s: F.col(f"_l{s[0]}") * F.col(f"_l{s[1]}") for s in SYM}
    return rows.groupBy(*keys, *VOXEL).agg(
        F.count(F.lit(1)).alias("n"), F.sum("_i").alias("sum_i"), F.sum(F.col("_i") * F.col("_i")).alias("sum_ii"),
        *[F.sum(f"_l{a}").alias(f"s{a}") for a in AXES], *[F.sum(c).alias(f"s{s}") for s, c in pair.items()],
        F.sum("_w").alias("sw"), *[F.sum(F.col("_w") * F.col(f"_l{a}")).alias(f"sw{a}") for a in AXES],
        *[F.sum(F.col("_w") * c).alias(f"sw{s}") for s, c in pair.items()],
    )


def _moments(stats: DataFrame, size: float, height: float, weight: str) -> DataFrame:
    """Mean (map coordinates) and covariance from the sums; `weight` "" or "w"."""
    n = F.col("n") if not weight else F.col("sw")
    local = {a: F.col(f"s{weight}{a}") / n for a in AXES}
    return stats.withColumns(
        {
            **{f"m{a}": local[a] + F.col(v) * float(s) for a, v, s in zip(AXES, VOXEL, (size, size, height), strict=True)},
            **{f"c{s}": F.col(f"s{weight}{s}") / n - local[s[0]] * local[s[1]] for s in SYM},
        }
    )


def local_features(
    stats: DataFrame, size: float, height: float, min_points: int = 8, keys: Sequence[str] = FRAME
) -> DataFrame:
    """Per-cell mean, eigenvalues, normal, planarity, verticality, mean intensity and its variation.

    Only valid cells stay: at least max(min_points, 3) points and a largest eigenvalue above 1e-10.
    """
    rows = _moments(stats.filter(F.col("n") >= max(min_points, 3)), size, height, "")
    rows = with_eigenvalues(rows, "c", "l")
    rows = rows.filter(F.col("l1") > 1.0e-10)
    rows = with_axes(rows, "c", "n_", "m_")
    rows = rows.withColumns({f"l{i}": F.greatest(F.col(f"l{i}"), F.lit(0.0)) for i in (1, 2, 3)})
    mean_i = F.col("sum_i") / F.col("n")
    variance = F.greatest(F.col("sum_ii") / F.col("n") - mean_i * mean_i, F.lit(0.0))
    return rows.select(
        *keys, *VOXEL, "n", "mx", "my", "mz", "l1", "l2", "l3", "n_x", "n_y", "n_z",
        rigid.clamp((F.col("l2") - F.col("l3")) / F.col("l1"), 0.0, 1.0).alias("planarity"),
        rigid.clamp(F.lit(1.0) - F.abs("n_z"), 0.0, 1.0).alias("verticality"), mean_i.alias("mean_intensity"),
        (F.sqrt(variance) / F.greatest(F.abs(mean_i), F.lit(1.0e-6))).alias("intensity_cv"),
    )


def cell_neighbors(cells: DataFrame, keys: Sequence[str] = FRAME) -> DataFrame:
    """Directed 26-neighbour edges: cell columns and the neighbour as `nx, ny, nz`."""
    ids = cells.select(*keys, *VOXEL)
    other = ids.select(*keys, *[F.col(v).alias(n) for v, n in zip(VOXEL, ("nx", "ny", "nz"), strict=True)])
    return shifted(ids, include_centre=False).join(other, [*keys, "nx", "ny", "nz"])


def _neighbour_frames(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Edges with the neighbour mean in the cell's tangent frame: height `h`, radius `r2`, coordinates u, v."""
    own = cells.select(
        *keys, *VOXEL, *[F.col(f"m{a}").alias(f"o{a}") for a in AXES], "n_x", "n_y", "n_z",
        F.col("mean_intensity").alias("own_i"),
    )
    other = cells.select(
        *keys, *[F.col(v).alias(n) for v, n in zip(VOXEL, ("nx", "ny", "nz"), strict=True)], "mx", "my", "mz",
        F.col("mean_intensity").alias("near_i"),
    )
    e = shifted(own, include_centre=False).join(other, [*keys, "nx", "ny", "nz"])
    d = rigid.Vec(*[F.col(f"m{a}") - F.col(f"o{a}") for a in AXES])
    n = rigid.Vec(F.col("n_x"), F.col("n_y"), F.col("n_z"))
    # Any orthonormal tangent basis serves: the curvature is the trace of the quadratic form.
    ax, ay = F.abs(n.x), F.abs(n.y)
    helper_x = ax <= ay
    t = n.cross(rigid.Vec(F.when(helper_x, 1.0).otherwise(0.0), F.when(helper_x, 0.0).otherwise(1.0), F.lit(0.0)))
    t = t.scale(F.lit(1.0) / t.norm())
    e = e.withColumns({"_tx": t.x, "_ty": t.y, "_tz": t.z, "h": n.dot(d)})
    t = rigid.Vec(F.col("_tx"), F.col("_ty"), F.col("_tz"))
    s = n.cross(t)
    e = e.withColumns({"u": t.dot(d), "v": s.dot(d)})
    return e.withColumn("r2", d.dot(d) - F.col("h") * F.col("h"))


def intensity_laplacian(
    cells: DataFrame, size: float, height: float, keys: Sequence[str] = FRAME
) -> DataFrame:
    """Gaussian-weighted intensity difference to neighbours near the tangent plane, relative to the own mean."""
    e = _neighbour_frames(cells, keys).filter(F.abs("h") <= max(height, 1.0e-6))
    w = F.exp(-F.col("r2") / max(size * size, 1.0e-12))
    sums = e.groupBy(*keys, *VOXEL).agg(
        F.sum(w * (F.col("near_i") - F.col("own_i"))).alias("_num"), F.sum(w).alias("_den"), F.first("own_i").alias("_i")
    )
    value = F.abs(F.col("_num") / F.col("_den")) / F.greatest(F.abs("_i"), F.lit(1.0e-6))
    return sums.filter(F.col("_den") > 1.0e-9).select(*keys, *VOXEL, value.alias("intensity_laplacian"))


QUADRIC = ("uu", "uv", "vv", "u", "v", "1")


def quadric_normal_equations(cells: DataFrame, keys: Sequence[str] = FRAME) -> DataFrame:
    """Sums of the 6-term quadric over neighbour means plus the cell's own zero row; `rows` counts all."""
    e = _neighbour_frames(cells, keys)
    u, v = F.col("u"), F.col("v")
    term = {"uu": u * u, "uv": u * v, "vv": v * v, "u": u, "v": v, "1": F.lit(1.0)}
    aggs = [
        F.sum(term[a] * term[b]).alias(f"q{i}{k}")
        for i, a in enumerate(QUADRIC) for k, b in enumerate(QUADRIC) if k >= i
    ]
    sums = e.groupBy(*keys, *VOXEL).agg(
        *aggs, *[F.sum(term[a] * F.col("h")).alias(f"r{i}") for i, a in enumerate(QUADRIC)],
        (F.count(F.lit(1)) + 1).alias("rows"),
    )
    return sums.withColumn("q55", F.col("q55") + 1.0)


def intensity_pca(stats: DataFrame, size: float, height: float, min_points: int = 8, keys: Sequence[str] = FRAME) -> DataFrame:
    """Intensity-weighted centre, major and minor axes and radii (square roots of the eigenvalues)."""
    rows = stats.filter((F.col("n") >= min_points) & (F.col("sw") > 1.0e-6))
    rows = with_eigenvalues(_moments(rows, size, height, "w"), "c", "l").filter(F.col("l1") > 1.0e-10)
    rows = with_axes(rows, "c", "n_", "e_")
    return rows.select(
        *keys, *VOXEL, "n", "mx", "my", "mz", "e_x", "e_y", "e_z", "n_x", "n_y", "n_z",
        *[F.sqrt(F.greatest(F.col(f"l{i}"), F.lit(0.0))).alias(f"radius{i}") for i in (1, 2, 3)],
    )


# --- feature histogram and peaks -----------------------------------------------------------------------


def feature_vector(
    cells: DataFrame, curvature_max: float = 0.5, cv_max: float = 1.0, laplacian_max: float = 1.0
) -> DataFrame:
    raw = (
        F.col("planarity"), F.col("verticality"), F.col("curvature") / max(curvature_max, 1.0e-9),
        F.col("intensity_cv") / max(cv_max, 1.0e-9), F.col("intensity_laplacian") / max(laplacian_max, 1.0e-9),
    )
    return cells.withColumns({f: rigid.clamp(c, 0.0, 1.0) for f, c in zip(FEATURES, raw, strict=True)})


def feature_histogram(cells: DataFrame, bins: int = 12, keys: Sequence[str] = FRAME) -> DataFrame:
    """Sparse vote grid: a cell gives min(points, 32) votes to its bin."""
    rows = cells.withColumns(
        {b: F.least(F.greatest(F.floor(F.col(f) * bins), F.lit(0)), F.lit(bins - 1)).cast("int")
         for b, f in zip(BINS, FEATURES, strict=True)}
    )
    return rows.groupBy(*keys, *BINS).agg(F.sum(F.least(F.col("n"), F.lit(VOTE_CAP)).cast("double")).alias("votes"))


def blur_histogram(hist: DataFrame, bins: int = 12, keys: Sequence[str] = FRAME) -> DataFrame:
    """(0.25, 0.5, 0.25) along every axis; mass that would leave the grid is lost. One shuffle."""
    rows = hist.withColumn("_v", F.col("votes"))
    for b in BINS:
        rows = rows.withColumn("_t", F.explode(F.array(*[
            F.struct(F.lit(d).alias("d"), F.lit(w).alias("w")) for d, w in ((-1, 0.25), (0, 0.5), (1, 0.25))
        ])))
        rows = rows.withColumns({b: F.col(b) + F.col("_t.d"), "_v": F.col("_v") * F.col("_t.w")}).filter(
            (F.col(b) >= 0) & (F.col(b) < bins)
        )
    return rows.groupBy(*keys, *BINS).agg(F.sum("_v").alias("blurred"))


def histogram_peaks(
    hist: DataFrame, bins: int = 12, min_votes: float = 50.0, separation: int = 2, max_classes: int = 8,
    keys: Sequence[str] = FRAME,
) -> DataFrame:
    """Classes: local maxima of the blurred grid with enough raw mass around, strongest first.

    Plateaus qualify as a whole. Columns: `rank` (0-based), bin coordinates, centre `c0..c4`, `votes`.
    """
    radius = max(separation, 1)
    blurred = cut(blur_histogram(hist, bins, keys))
    around = blurred.withColumn("_v", F.col("blurred"))
    for b in BINS:
        around = around.withColumn(b, F.explode(F.array(F.col(b) - 1, F.col(b), F.col(b) + 1)))
        around = around.groupBy(*keys, *BINS).agg(F.max("_v").alias("_v"))
    top = blurred.join(around, [*keys, *BINS]).filter((F.col("blurred") > 0) & (F.col("blurred") >= F.col("_v")))
    # Raw mass in the Chebyshev ball: two axes by offsets (equi-join), the other three as a filter.
    two = F.array(*[F.lit(d) for d in range(-radius, radius + 1)])
    probe = top.select(*keys, *BINS).withColumn("_o0", F.explode(two)).withColumn("_o1", F.explode(two))
    probe = probe.withColumns({"_k0": F.col("b0") + F.col("_o0"), "_k1": F.col("b1") + F.col("_o1")})
    raw = hist.select(
        *keys, F.col("b0").alias("_k0"), F.col("b1").alias("_k1"), *[F.col(b).alias(f"_{b}") for b in BINS[2:]], "votes"
    )
    inside = probe.join(raw, [*keys, "_k0", "_k1"])
    for b in BINS[2:]:
        inside = inside.filter(F.abs(F.col(b) - F.col(f"_{b}")) <= radius)
    mass = inside.groupBy(*keys, *BINS).agg(F.sum("votes").alias("mass")).filter(F.col("mass") >= min_votes)
    flat = sum((F.col(b).cast("bigint") * bins**i for i, b in enumerate(BINS)), F.lit(0))
    item = F.struct((-F.col("mass")).alias("m"), flat.alias("i"), *BINS)
    # A frame has at most bins^5 bins, whatever the data size, so its maxima fit one array.
    listed = mass.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("_all"))
    empty = F.array().cast(listed.schema["_all"].dataType)

    def keep(acc: Column, x: Column) -> Column:
        near = F.exists(
            acc, lambda k: F.greatest(*[F.abs(k.getField(b) - x.getField(b)) for b in BINS]) < separation
        )
        return F.when((F.size(acc) >= max(max_classes, 0)) | near, acc).otherwise(F.concat(acc, F.array(x)))

    kept = listed.withColumn("_kept", F.aggregate("_all", empty, keep))
    out = kept.select(*keys, F.posexplode("_kept").alias("rank", "_p"))
    return out.select(
        *keys, "rank", *[F.col(f"_p.{b}").alias(b) for b in BINS],
        *[((F.col(f"_p.{b}") + 0.5) / bins).alias(f"c{i}") for i, b in enumerate(BINS)], (-F.col("_p.m")).alias("votes"),
    )


def nearest_peak(cells: DataFrame, peaks: DataFrame, keys: Sequence[str] = FRAME) -> DataFrame:
    """Label of the closest peak in feature space; equal distances take the peak with more votes.

    A frame has a handful of peaks: they travel as one array, so labelling is a single equi-join.
    """
    listed = peaks.groupBy(*keys).agg(F.collect_list(F.struct("rank", "id", *[f"c{i}" for i in range(5)])).alias("_peaks"))

    def scored(p: Column) -> Column:
        d2 = sum(((p.getField(f"c{i}") - F.col(f)) ** 2 for i, f in enumerate(FEATURES)), F.lit(0.0))
        return F.struct(d2.alias("d2"), p.getField("rank").alias("rank"), p.getField("id").alias("id"))

    out = cells.join(listed, list(keys), "left").withColumn("_best", F.array_min(F.transform("_peaks", scored)))
    return out.withColumn("label", F.coalesce("_best.id", F.lit(0))).drop("_peaks", "_best")


def propagate_labels(
    cells: DataFrame, edges: DataFrame, sigma: float = 0.25, iterations: int = 3, keys: Sequence[str] = FRAME
) -> DataFrame:
    """Synchronous smoothing: own label scores 1, a labelled neighbour exp(-d^2 / sigma^2).

    A label changes only to a strictly better one (tie: lowest id); unlabelled cells stay as they are.
    `cells`: key, label and features; all edges get their weight once.
    """
    near = ("nx", "ny", "nz")
    feats = cells.select(*keys, *VOXEL, *FEATURES)
    other = feats.select(
        *keys, *[F.col(v).alias(n) for v, n in zip(VOXEL, near, strict=True)], *[F.col(f).alias(f"_{f}") for f in FEATURES]
    )
    d2 = sum(((F.col(f) - F.col(f"_{f}")) ** 2 for f in FEATURES), F.lit(0.0))
    weighted = edges.join(feats, [*keys, *VOXEL]).join(other, [*keys, *near]).select(
        *keys, *VOXEL, *near, F.exp(-d2 / max(sigma * sigma, 1.0e-12)).alias("_w")
    )
    labels = cells.select(*keys, *VOXEL, "label")
    if iterations > 1:
        weighted = cut(weighted)
    for _ in range(iterations):
        around = labels.filter("label > 0").select(
            *keys, *[F.col(v).alias(n) for v, n in zip(VOXEL, near, strict=True)], F.col("label").alias("_l")
        )
        votes = weighted.join(around, [*keys, *near]).groupBy(*keys, *VOXEL, "_l").agg(F.sum("_w").alias("_s"))
        own = labels.filter("label > 0").select(*keys, *VOXEL, F.col("label").alias("_l"), F.lit(1.0).alias("_s"))
        score = votes.unionByName(own).groupBy(*keys, *VOXEL, "_l").agg(F.sum("_s").alias("_s"))
        mine = score.join(labels, [*keys, *VOXEL]).filter("label > 0")
        # At equal score the current label wins, then the lowest id.
        rank = F.struct(F.col("_s"), (F.col("_l") == F.col("label")).alias("own"), (-F.col("_l")).alias("low"))
        best = mine.groupBy(*keys, *VOXEL).agg(F.max_by("_l", rank).alias("_best"))
        labels = labels.join(best, [*keys, *VOXEL], "left").select(
            *keys, *VOXEL, F.coalesce("_best", "label").alias("label")
        )
        labels = cut(labels)
    return labels


# Bits of the cell indices in an id. At 0.5 m they reach 8,388 km east and north and 2 km up and down.
ID_BITS = {"vx": 25, "vy": 25, "vz": 13}


def cell_id() -> Column:
    """The three cell indices packed into one bigint; sorts like (vx, vy, vz). Indices out of reach stop the job."""
    out, fits = F.lit(0).cast("bigint"), F.lit(True)
    for name, bits in ID_BITS.items():
        half = 1 << (bits - 1)
        fits = fits & F.col(name).between(-half, half - 1)
        out = F.shiftleft(out, bits) + (F.col(name) + half).cast("bigint")
    stop = F.raise_error(F.lit("a cell index does not fit its bits in a cell id")).cast("bigint")
    return F.when(F.coalesce(fits, F.lit(True)), out).otherwise(stop)


def connected_components(labels: DataFrame, edges: DataFrame, keys: Sequence[str] = FRAME) -> DataFrame:
    """Components of equal non-zero label over the 26-neighbour edges; `segment` is the smallest cell id.

    Each round points every node to its smallest neighbour, compresses the pointers and contracts the graph.
    Only the roots keep edges, so rounds shrink geometrically and long chains do not need long loops.
    """
    keys = list(keys)
    near = ("nx", "ny", "nz")
    nodes = labels.filter("label > 0").select(*keys, *VOXEL, "label").withColumn("node", cell_id())
    a = nodes.select(*keys, *VOXEL, F.col("label").alias("_la"), F.col("node").alias("a"))
    b = nodes.select(
        *keys, *[F.col(v).alias(n) for v, n in zip(VOXEL, near, strict=True)], F.col("label").alias("_lb"), F.col("node").alias("b")
    )
    graph = cut(
        edges.join(a, [*keys, *VOXEL]).join(b, [*keys, *near]).filter(F.col("_la") == F.col("_lb")).select(*keys, "a", "b")
    )
    member = nodes.select(*keys, *VOXEL, "label", F.col("node").alias("segment"))
    while not graph.isEmpty():
        pointer = graph.groupBy(*keys, "a").agg(F.least(F.min("b"), F.col("a")).alias("to"))
        pointer = cut(pointer)
        while True:
            onward = pointer.select(*keys, F.col("a").alias("to"), F.col("to").alias("_next"))
            jumped = cut(pointer.join(onward, [*keys, "to"]).select(*keys, "a", F.col("_next").alias("to"), (F.col("_next") != F.col("to")).alias("_m")))
            pointer = jumped.drop("_m")
            if jumped.filter("_m").isEmpty():
                break
        member = member.join(pointer.withColumnRenamed("a", "segment"), [*keys, "segment"], "left").select(
            *keys, *VOXEL, "label", F.coalesce("to", "segment").alias("segment")
        )
        member = cut(member)
        pa, pb = pointer.select(*keys, "a", F.col("to").alias("_ra")), pointer.select(*keys, F.col("a").alias("b"), F.col("to").alias("_rb"))
        graph = cut(
            graph.join(pa, [*keys, "a"]).join(pb, [*keys, "b"]).filter(F.col("_ra") != F.col("_rb"))
            .select(*keys, F.col("_ra").alias("a"), F.col("_rb").alias("b")).distinct()
        )
    zero = labels.filter("label <= 0").select(*keys, *VOXEL, "label", F.lit(0).cast("bigint").alias("segment"))
    return member.unionByName(zero)


def label_points(
    points: DataFrame, segments: DataFrame, size: float, height: float, keys: Sequence[str] = FRAME
) -> DataFrame:
    """Points with the label and segment of their cell, 0 where there is none."""
    out = with_voxel(points, size, height).join(segments.select(*keys, *VOXEL, "label", "segment"), [*keys, *VOXEL], "left")
    return out.na.fill(0, ["label", "segment"]).drop(*VOXEL)
