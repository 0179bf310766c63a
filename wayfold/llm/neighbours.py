"""Approximate nearest neighbours by cosine: inverted lists, scanned dimension block by dimension block.

Vectors are scaled to unit length and turned by a random rotation, after which any few coordinates are a fair sample of a distance:
over t of D coordinates, the squared partial distance times D / t estimates the whole one with an error that falls as 1 / sqrt(t).
A list is laid out in column blocks. After each block, candidates whose estimate is beyond the distance still to be beaten by more
than chance (hypothesis test with `confidence` deviations) are abandoned; those that reach the last block have their exact
distance. The distance to beat is at first that of the sample's rows in the lists to probe, and falls as nearer rows are found. Rows of
the sample are abandoned only if their partial distance itself is too large, so no query ends with fewer rows than it can have.

A list is probed only if the triangle inequality lets it hold a row near enough, nearest centroid first, and at most `share` of all
lists (MIN_PROBES, if that is more): with rows that have no clusters at all, as random ones, that share bounds the work and sets the recall."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wayfold.llm.common import materialise, skew_join

NEAREST, SEED, BLOCK = 5, 13, 8
#: Share of the lists probed at most, and deviations of the hypothesis test.
SHARE, MIN_PROBES, CONFIDENCE = 0.6, 32, 3.0
#: The index is fitted on a sample of at most so many rows and bytes; a list is for about so many rows while there are at most MAX_LISTS.
SAMPLE_ROWS, SAMPLE_BYTES = 16_384, 32 << 20
LIST_ROWS, MAX_LISTS = 512, 1024
#: Vector lengths that get lists; rows of rarer lengths are one list for each length, in chunks like any other.
MAX_SIZES = 64
#: Rows and queries that meet in one task's group, and rows scanned at once.
CHUNK_ROWS, CHUNK_QUERIES, STEP = 8192, 2048, 1024
_SLACK = 1e-9


@cache
def rotation(size: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(SEED).normal(size=(size, size)))
    return q * np.sign(np.diag(r))


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows over a power of two each, so that squares neither overflow nor vanish and no digit changes."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, initial=0.0))[1][:, None])


def turned(x: np.ndarray) -> np.ndarray:
    x = scaled(x)
    return (x / np.sqrt((x**2).sum(axis=1))[:, None]) @ rotation(x.shape[1])


def matrix(column: pa.Array, size: int) -> np.ndarray:
    """Rows of equally long lists."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)


def centroids_of(rows: np.ndarray, lists: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means on unit rows."""
    rng = np.random.default_rng(SEED)
    centres = rows[np.sort(rng.choice(len(rows), min(lists, len(rows)), replace=False))]
    for _ in range(rounds):
        near = (rows @ centres.T).argmax(axis=1)
        total = np.zeros_like(centres)
        np.add.at(total, near, rows)
        norm = np.sqrt((total**2).sum(axis=1))
        centres = np.where(norm[:, None] > 0, total / np.maximum(norm, 1e-300)[:, None], centres)
    return centres


class Lists:
    """Per vector length: the sample with its vectors turned, and centroids."""

    def __init__(self, drawn: dict[int, pa.Table], counts: dict[int, int]):
        self.last = {s: (t.column("h1")[-1].as_py(), t.column("h2")[-1].as_py()) for s, t in drawn.items()}
        self.sample = {s: turned(matrix(t.column("vector").combine_chunks(), s)) for s, t in drawn.items()}
        self.centres = {s: centroids_of(x, max(1, min(MAX_LISTS, counts[s] // LIST_ROWS))) for s, x in self.sample.items()}
        self.home = {s: self.place(x)[0] for s, x in self.sample.items()}

    def place(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """List of each turned row, and its angle to the centroid."""
        centres = self.centres.get(x.shape[1])
        if centres is None:
            return np.zeros(len(x), np.int64), np.full(len(x), np.pi)
        inner = x @ centres.T
        return inner.argmax(axis=1), np.arccos(np.clip(inner.max(axis=1), -1, 1))

    def sampled(self, size: int, h1: int, h2: int) -> bool:
        """Whether a vector is in the sample, which holds those with the smallest hashes."""
        return size in self.last and (h1, h2) <= self.last[size]

    def probes(self, x: np.ndarray, radius: np.ndarray, wanted: int, share: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, list) pairs to scan, and the squared distance within which each query has `wanted` rows in its lists."""
        size = x.shape[1]
        if size not in self.centres:
            return np.arange(len(x)), np.zeros(len(x), np.int64), np.full(len(x), np.inf)
        angle = np.arccos(np.clip(x @ self.centres[size].T, -1, 1))
        rank = np.argsort(np.argsort(angle, axis=1, kind="stable"), axis=1, kind="stable")
        ranked = rank < max(MIN_PROBES, int(np.ceil(share * angle.shape[1])))
        start = np.full(len(x), np.inf)
        if len(self.sample[size]) >= wanted:
            inner = np.where(ranked[:, self.home[size]], x @ self.sample[size].T, -np.inf)
            start = np.maximum(2 + 2 * np.partition(-inner, wanted - 1, axis=1)[:, wanted - 1], 0) + _SLACK
        reach = np.where(np.isfinite(start), np.arccos(np.clip(1 - start / 2, -1, 1)), np.pi)
        query, list_ = np.nonzero(ranked & (angle - radius[None, :] <= reach[:, None] + 1e-6))
        return query, list_, start


def scan(rows: np.ndarray, sure: np.ndarray, queries: np.ndarray, start: np.ndarray, wanted: int, confidence: float) -> tuple[np.ndarray, np.ndarray]:
    """(query, row) pairs among which are each query's `wanted` nearest of the turned rows within its start distance, but for those
    that chance made the test abandon; `sure` rows are never left to chance."""
    size = rows.shape[1]
    cuts = list(range(0, size, BLOCK))
    limit, found = start.copy(), [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    blocks = [np.ascontiguousarray(queries[:, c: c + BLOCK]) for c in cuts]
    for at in range(0, len(rows), STEP):
        safe = sure[at: at + STEP]
        step = [np.ascontiguousarray(rows[at: at + STEP, c: c + BLOCK]) for c in cuts]
        for i, c in enumerate(cuts):
            seen = min(c + BLOCK, size)
            bar = limit if seen == size else np.minimum(limit, limit * (seen / size) * (1 + confidence / np.sqrt(seen)) ** 2)
            if i == 0:
                a, b = blocks[0], step[0]
                partial = np.maximum((a**2).sum(axis=1)[:, None] + (b**2).sum(axis=1)[None, :] - 2 * a @ b.T, 0)
                q, r = np.nonzero(partial <= np.where(safe[None, :], limit[:, None], bar[:, None]) + _SLACK)
                partial = partial[q, r]
            else:
                partial = partial + ((blocks[i][q] - step[i][r]) ** 2).sum(axis=1)
                live = partial <= np.where(safe[r], limit[q], bar[q]) + _SLACK
                q, r, partial = q[live], r[live], partial[live]
        found.append((q, r + at, partial))
        q, r, distance = (np.concatenate(x) for x in zip(*found))
        order = np.lexsort((distance, q))
        q, r, distance = q[order], r[order], distance[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        last = place == wanted - 1
        limit[q[last]] = np.minimum(limit[q[last]], distance[last])
        keep = distance <= limit[q] + _SLACK
        found = [(q[keep], r[keep], distance[keep])]
    return found[0][0], found[0][1]


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of each pair of rows; products are added from the first to the last, so that a pair has one value wherever it is met."""
    a, b = scaled(a), scaled(b)
    total = lambda x: np.cumsum(x, axis=1)[:, -1]
    return total(a * b) / np.sqrt(total(a * a) * total(b * b))


def usable(vector: Column) -> Column:
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~odd & F.exists(vector, lambda x: x != 0)


def _by_size(batch: pa.RecordBatch, name: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and vectors of a batch, for each vector length, some hundreds at a time."""
    sizes = pa.compute.list_value_length(batch.column(name)).to_numpy()
    for size in np.unique(sizes):
        mine = np.flatnonzero(sizes == size)
        for at in range(0, len(mine), 256):
            part = mine[at: at + 256]
            yield part, matrix(batch.column(name).take(pa.array(part)), int(size))


def fitted(nodes: DataFrame) -> Lists:
    """Lists from a bounded sample of the distinct vectors: those with the smallest hashes, for each of the commonest lengths."""
    counts = {r["size"]: r["count"] for r in nodes.groupBy("size").count().orderBy(F.desc("count"), "size").limit(MAX_SIZES).collect()}
    drawn = {}
    for size in counts:
        rows = min(SAMPLE_ROWS, max(256, SAMPLE_BYTES // (8 * size * len(counts))))
        drawn[size] = nodes.where(F.col("size") == size).orderBy("h1", "h2").limit(rows).select("h1", "h2", "vector").toArrow()
    return Lists(drawn, counts)


_HIT = "q1 long, q2 long, ids array<long>, score double"


def search(
    rows: DataFrame, queries: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", nearest: int = NEAREST, share: float = SHARE,
    confidence: float = CONFIDENCE,
) -> DataFrame:
    """`(query_id, rank, vec_id, score)`: for each row of `queries`, itself a row of `rows`, the `nearest` rows of largest cosine that
    were found, itself left out; ties by the smaller id, `rank` from 1. `score` is the cosine of the original vectors in double precision.

    Equal vectors are one node with its `nearest + 1` smallest ids: rows beyond those can be in no answer. Lists are cut into chunks and
    queries of a list into blocks, so groups are bounded however many rows are alike. The sample, the centroids and
    one number per list go to the driver and back to all tasks; their size is bounded. Rows without an id and vectors that
    are null, empty, zero or hold null or non-finite components take no part; vectors of different lengths never meet. Repeated rows are rows
    of their own. With fewer rows than `nearest`, all are returned. Extra columns are ignored."""
    spark, wanted = rows.sparkSession, nearest + 1

    def clean(table: DataFrame) -> DataFrame:
        own = table.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector"))
        own = own.where(F.col("id").isNotNull() & usable(F.col("vector"))).withColumn("size", F.size("vector"))
        return own.withColumns({"h1": F.xxhash64("vector"), "h2": F.xxhash64(F.lit(SEED), "vector")})

    first = Window.partitionBy("h1", "h2").orderBy("id")
    kept = clean(rows).withColumn("place", F.row_number().over(first)).where(F.col("place") <= wanted)
    nodes = kept.groupBy("h1", "h2").agg(F.sort_array(F.collect_list("id")).alias("ids"), F.first("vector").alias("vector"), F.first("size").alias("size"))
    nodes = materialise(nodes)
    lists = spark.sparkContext.broadcast(fitted(nodes))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            list_, angle = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows)
            for part, x in _by_size(batch, "vector"):
                list_[part], angle[part] = lists.value.place(turned(x))
            sampled = [lists.value.sampled(*x) for x in zip(*(batch.column(c).to_pylist() for c in ("size", "h1", "h2")))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, (list_, angle, sampled))], [*batch.schema.names, "list", "angle", "sampled"])

    more = [F.lit(0).alias("list"), F.lit(0.0).alias("angle"), F.lit(False).alias("sampled")]
    index = materialise(nodes.mapInArrow(placed, nodes.select("*", *more).schema))
    stats = index.where(F.col("size").isin(list(lists.value.centres))).groupBy("size", "list").agg(F.max("angle").alias("radius")).collect()
    radius = {s: np.full(len(c), -np.inf) for s, c in lists.value.centres.items()}  # an empty list is out of reach
    for r in stats:  # at most MAX_SIZES * MAX_LISTS rows
        radius[r["size"]][r["list"]] = r["radius"]

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, x in _by_size(batch, "vector"):
                x = turned(x)
                query, list_, start = lists.value.probes(x, radius.get(x.shape[1], np.zeros(1)), wanted, share)
                own = batch.take(pa.array(part[query]))
                columns = [*own.columns, pa.array(list_.astype(np.int32)), pa.array(start[query])]
                yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "list", "start"])

    asked = clean(queries)
    distinct = asked.groupBy("h1", "h2").agg(F.first("vector").alias("vector"), F.first("size").alias("size"))
    sent = distinct.mapInArrow(routed, distinct.select("*", F.lit(0).alias("list"), F.lit(0.0).alias("start")).schema)
    sent = materialise(sent)
    count = lambda table, most: table.groupBy("size", "list").agg(F.ceil(F.count("*") / most).cast("int").alias("n"))
    grid = count(index, CHUNK_ROWS).withColumnRenamed("n", "chunks").join(count(sent, CHUNK_QUERIES).withColumnRenamed("n", "blocks"), ["size", "list"])
    grid = materialise(grid)  # lists that hold rows and are asked for
    left = _dealt(index.drop("angle"), grid, "chunk", "chunks", "block", "blocks")
    right = _dealt(sent, grid, "block", "blocks", "chunk", "chunks")
    keys = ["size", "list", "chunk", "block"]

    def met(a: pa.Table, b: pa.Table) -> pa.Table:
        q = r = np.zeros(0, np.int64)
        score = np.zeros(0)
        if a.num_rows and b.num_rows:
            x, y = (matrix(t.column("vector").combine_chunks(), t.column("size")[0].as_py()) for t in (a, b))
            q, r = scan(turned(x), a.column("sampled").to_numpy(), turned(y), b.column("start").to_numpy().copy(), wanted, confidence)
            score = cosine(x[r], y[q])
        columns = [b.column("h1").take(pa.array(q)), b.column("h2").take(pa.array(q)), a.column("ids").take(pa.array(r)), pa.chunked_array([score])]
        return pa.table(columns, ["q1", "q2", "ids", "score"])

    hits = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(met, _HIT)
    best = Window.partitionBy("q1", "q2").orderBy(F.desc("score"), "id")
    hits = hits.select("q1", "q2", F.explode("ids").alias("id"), "score").withColumn("place", F.row_number().over(best)).where(F.col("place") <= wanted)
    answers = hits.groupBy("q1", "q2").agg(F.sort_array(F.collect_list(F.struct("place", "id", "score"))).alias("found"))
    asked = asked.select(F.col("id").alias("query_id"), F.col("h1").alias("q1"), F.col("h2").alias("q2"))
    out = skew_join(asked, answers, ["q1", "q2"]).withColumn("own", F.array_position(F.transform("found", lambda x: x.id), F.col("query_id")))
    others = F.slice(F.filter("found", lambda x, i: i + 1 != F.col("own")), 1, nearest)
    out = out.select("query_id", F.posexplode(others).alias("rank", "x"))
    return out.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("x.id").alias("vec_id"), F.col("x.score").alias("score"))


def _dealt(table: DataFrame, grid: DataFrame, own: str, n: str, other: str, others: str) -> DataFrame:
    """Every row in one of the `n` parts of its list, by hash, once for each part of the other side."""
    out = skew_join(table, grid, ["size", "list"]).withColumn(own, F.pmod(F.xxhash64("h1", F.lit(own)), F.col(n)).cast("int"))
    return out.withColumn(other, F.explode(F.sequence(F.lit(0), F.col(others) - 1))).drop("chunks", "blocks")
