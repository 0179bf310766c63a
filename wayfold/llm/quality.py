"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.llm.common import slices, texts_of, worker_memory

WORD_BUCKETS = 1 << 15
BINS = 12
FACTORS = 6
#: The model is fitted on at most this many labelled rows, those with the smallest hash of their id.
MAX_FIT_ROWS = 6000
EPOCHS, BATCH, RATE, DECAY, SEED = 12, 64, 0.03, 1e-5, 17
THRESHOLD = 0.3

# Byte classes: 0 other, 1 lower, 2 upper, 3 digit, 4 blank, 5 line end, 6 sentence mark, 7 other mark.
_CLASS = np.zeros(256, dtype=np.uint8)
for _from, _to, _kind in ((97, 123, 1), (65, 91, 2), (48, 58, 3), (33, 48, 7), (58, 65, 7), (91, 97, 7), (123, 127, 7)):
    _CLASS[_from:_to] = _kind
_CLASS[[9, 11, 12, 13, 32]] = 4
_CLASS[10] = 5
_CLASS[[33, 44, 46, 63]] = 6
STATISTICS = (
    "log_bytes", "log_words", "word_bytes", "other", "lower", "upper", "digit", "line_end", "sentence", "mark",
    "distinct_words", "top_word", "line_words", "distinct_lines", "longest_word", "repeated_neighbours",
)


def structure(data: bytes, words: list[bytes], counts: np.ndarray) -> np.ndarray:
    """STATISTICS of a text; all zero for an empty one."""
    if not words:
        return np.zeros(len(STATISTICS))
    kinds = np.bincount(_CLASS[np.frombuffer(data, np.uint8)], minlength=8) / len(data)
    lines = [line for line in data.split(b"\n") if line.strip()]
    n = len(words)
    return np.array([
        np.log1p(len(data)), np.log1p(n), len(data) / n, kinds[0], kinds[1], kinds[2], kinds[3], kinds[5], kinds[6],
        kinds[7], len(counts) / n, counts.max() / n, n / len(lines), len(set(lines)) / len(lines),
        np.log1p(max(map(len, words))), sum(map(bytes.__eq__, words, words[1:])) / n,
    ])


def features(text: str, metadata: list[float | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word buckets, their weights (log counts at unit length), and the dense statistics with `metadata` appended."""
    data = text.encode()
    words = data.split()
    hashed = np.fromiter(map(zlib.crc32, words), np.uint32, len(words)) % WORD_BUCKETS
    at, counts = np.unique(hashed, return_counts=True)
    weights = np.log1p(counts)
    weights = weights / np.sqrt((weights**2).sum()) if len(at) else weights
    extra = [np.nan if m is None else float(m) for m in metadata]
    return at.astype(np.int64), weights, np.concatenate([structure(data, words, counts), extra])


@dataclass
class Machine:
    """w0 + sum w_i x_i + sum over pairs <v_i, v_j> x_i x_j, the pairs by the sum-of-squares identity in linear time.
    Dense statistics enter as one of BINS quantile bins each (a missing value is a bin of its own)."""

    edges: np.ndarray
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def expand(self, at: np.ndarray, x: np.ndarray, dense: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        bins = [BINS if np.isnan(v) else int(np.searchsorted(e, v, "right")) for v, e in zip(dense, self.edges)]
        own = WORD_BUCKETS + np.arange(len(dense)) * (BINS + 1) + np.array(bins, dtype=np.int64)
        return np.concatenate([at, own]), np.concatenate([x, np.full(len(own), 1 / np.sqrt(len(own)))])

    def margin(self, at: np.ndarray, x: np.ndarray) -> float:
        v = self.factors[at]
        inner = x @ v
        return float(self.bias + self.weights[at] @ x + 0.5 * (inner @ inner - (x * x) @ (v * v).sum(axis=1)))

    def score(self, text: str, metadata: list[float | None]) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.margin(*self.expand(*features(text, metadata))), -40, 40))))


def _feature_rows(rows: DataFrame, metadata: list[str]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_memory("quality")
        for batch in slices(batches):
            more = list(zip(*[batch.column(f"m{i}").to_pylist() for i in range(len(metadata))])) or [()] * batch.num_rows
            found = [features(t, list(m)) for t, m in zip(texts_of(batch), more)]
            columns = [pa.array([f[i] for f in found], pa.list_(kind)) for i, kind in enumerate((pa.int64(), pa.float64(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([*columns, batch.column("y")], ["at", "x", "dense", "y"])

    kept = rows.select("text", "y", *[F.col(m).cast("double").alias(f"m{i}") for i, m in enumerate(metadata)])
    return kept.mapInArrow(run, "at array<long>, x array<double>, dense array<double>, y double")


def fit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    metadata: list[str] | None = None, max_rows: int = MAX_FIT_ROWS,
) -> Machine:
    """Fits on the `max_rows` labelled rows with the smallest hash of their id (null ids and labels are left out).
    The labelled ids are bounded by `max_rows` and broadcast, so `docs` is scanned once without a shuffle; features are
    made in tasks and only those of the sample reach the driver. Without a usable row, every score is 0.5."""
    metadata = metadata or []
    picked = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
    picked = picked.select(F.col(id_col).alias("_id"), F.col(label_col).cast("double").alias("y"))
    picked = picked.orderBy(F.xxhash64("_id"), "_id", "y").limit(max_rows)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text"), *metadata)
    rows = rows.join(F.broadcast(picked), "_id").orderBy(F.xxhash64("_id"), "_id", F.xxhash64("text")).limit(max_rows)
    sample = _feature_rows(rows, metadata).collect()
    n_dense = len(STATISTICS) + len(metadata)
    dense = np.array([r.dense for r in sample], dtype=float).reshape(len(sample), n_dense)
    edges = np.zeros((n_dense, BINS - 1))
    for i in range(n_dense):
        known = dense[:, i][~np.isnan(dense[:, i])] if len(sample) else []
        edges[i] = np.quantile(known, np.arange(1, BINS) / BINS) if len(known) else 0.0
    size = WORD_BUCKETS + n_dense * (BINS + 1)
    rng = np.random.default_rng(SEED)
    model = Machine(edges, 0.0, np.zeros(size), np.zeros((size, FACTORS)))
    if not sample:
        return model
    y = np.array([r.y for r in sample])
    rows_ = [model.expand(np.array(r.at, dtype=np.int64), np.array(r.x), np.array(r.dense)) for r in sample]
    model.bias = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    model.factors = rng.normal(0, 0.05, (size, FACTORS))
    _descend(model, rows_, y, rng)
    return model


def _descend(model: Machine, rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, rng: np.random.Generator) -> None:
    """Mini-batch AdaGrad on the logistic loss."""
    g_w, g_v, g_b = np.full(len(model.weights), 1e-6), np.full(model.factors.shape, 1e-6), 1e-6
    for _ in range(EPOCHS):
        order = rng.permutation(len(rows))
        for at in range(0, len(rows), BATCH):
            pick = order[at: at + BATCH]
            idx = np.concatenate([rows[i][0] for i in pick])
            x = np.concatenate([rows[i][1] for i in pick])[:, None]
            lens = np.array([len(rows[i][0]) for i in pick])
            starts = np.cumsum(lens) - lens
            v = model.factors[idx]
            inner = np.add.reduceat(v * x, starts, axis=0)
            squares = np.add.reduceat(((v * x) ** 2).sum(axis=1), starts)
            linear = np.add.reduceat(model.weights[idx] * x[:, 0], starts)
            margin = model.bias + linear + 0.5 * ((inner**2).sum(axis=1) - squares)
            slope = (1 / (1 + np.exp(-np.clip(margin, -40, 40))) - y[pick]) / len(pick)
            each = np.repeat(slope, lens)[:, None]
            d_v = each * x * (np.repeat(inner, lens, axis=0) - v * x)
            touched, back = np.unique(idx, return_inverse=True)
            sum_v = np.stack([np.bincount(back, d_v[:, f]) for f in range(FACTORS)], axis=1) + DECAY * model.factors[touched]
            sum_w = np.bincount(back, (each * x)[:, 0]) + DECAY * model.weights[touched]
            g_v[touched] += sum_v**2
            g_w[touched] += sum_w**2
            g_b += slope.sum() ** 2
            model.factors[touched] -= RATE * sum_v / np.sqrt(g_v[touched])
            model.weights[touched] -= 4 * RATE * sum_w / np.sqrt(g_w[touched])
            model.bias -= RATE * slope.sum() / np.sqrt(g_b)


def score(docs: DataFrame, model: Machine, text_col: str = "text", metadata: list[str] | None = None) -> DataFrame:
    """`docs` with `score` (0 to 1, higher: label 1 likelier). Null and empty texts are scored from their statistics;
    metadata that is null falls into a bin of its own. Repeated rows stay; an own column named `score` is replaced."""
    metadata = metadata or []
    docs = docs.drop("score")
    # Texts go to the workers once, inside their rows.
    kept = docs.select(F.struct("*").alias("row"), *[F.col(m).cast("double").alias(f"m{i}") for i, m in enumerate(metadata)])
    place = [c.lower() for c in docs.columns].index(text_col.lower())
    return _scored(kept, model, place, len(metadata)).select("row.*", "score")


def _scored(kept: DataFrame, model: Machine, place: int, n: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_memory("quality")
        for batch in slices(batches):
            more = list(zip(*[batch.column(f"m{i}").to_pylist() for i in range(n)])) or [()] * batch.num_rows
            texts = pa.compute.struct_field(batch.column("row"), [place]).to_pylist()
            found = pa.array([model.score(t or "", list(m)) for t, m in zip(texts, more)], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column("row"), found], ["row", "score"])

    schema = kept.select("row").schema.add("score", "double")
    return kept.mapInArrow(run, schema)
