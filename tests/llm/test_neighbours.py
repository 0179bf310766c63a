"""Nearest neighbours against brute force: exact while all lists are probed, recall beyond, odd rows."""

import math

import numpy as np
import pytest

from wayfold.llm import neighbours, queries

SCHEMA = "vec_id long, embedding array<float>, label int, h1 int, list string, score int"


def brute(rows, nearest=5):
    good = []
    for at, (i, v) in enumerate(rows):
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            good.append((at, i, np.array(v, np.float32).astype(float)))
    out = []
    for at, i, v in good:
        if i % 50 == 0:
            near = [(-neighbours.cosine(v[None], w[None])[0], j) for other, j, w in good if other != at and len(v) == len(w)]
            out += [(i, rank + 1, j, -s) for rank, (s, j) in enumerate(sorted(near)[:nearest])]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, "l", 3) for i, v in rows], SCHEMA)


def floats(rng, n, size):
    return [[float(x) for x in row] for row in rng.normal(size=(n, size)).astype(np.float32)]


@pytest.mark.parametrize("case", ["odd", "few", "empty"])
def test_query_against_brute_force(spark, tmp_path, case):
    rng = np.random.default_rng(2)
    rows = [] if case == "empty" else [(i, v) for i, v in enumerate(floats(rng, 120 if case == "odd" else 4, 19))]
    if case == "odd":
        same = rows[7][1]
        rows += [(i, same) for i in range(200, 320)] + [(400 + i, v) for i, v in enumerate(floats(rng, 3, 5))]
        rows += [(1000, None), (1050, []), (1100, [0.0] * 19), (1150, [None] + [1.0] * 18), (1200, [float("nan")] + [1.0] * 18), (1250, [float("inf")] + [1.0] * 18), (None, same)]
        rows += [(1300, [1e-30] * 19), (1301, [1e30] * 19), (1302, [-0.0] + [1.0] * 18), (1350, [1.0]), rows[3], rows[100], rows[100]]
    frame(spark, rows).repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    found = queries.op13(spark, str(tmp_path))
    assert dict(found.dtypes) == {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "double"}
    assert sorted(tuple(r) for r in found.collect()) == brute(rows)


def test_blocks_of_rows_and_queries(spark, monkeypatch):
    """A list of many chunks and query blocks; lists of 16 rows, of which some are out of reach."""
    for name, value in (("CHUNK_ROWS", 64), ("CHUNK_QUERIES", 8), ("STEP", 16), ("LIST_ROWS", 16)):
        monkeypatch.setattr(neighbours, name, value)
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(6, 16)) * 4
    rows = [(i, [float(x) for x in np.float32(centres[rng.integers(6) if i % 3 else 0] + rng.normal(size=16))]) for i in range(900)]
    table = frame(spark, rows)
    got = sorted(tuple(r) for r in neighbours.search(table, table.where("vec_id % 50 = 0")).collect())
    want = brute(rows)
    assert len(got) == len(want)
    assert len({g[::2] for g in got} & {w[::2] for w in want}) >= 0.95 * len(want)


def test_recall_without_clusters(spark):
    """Random vectors, the hardest rows for lists: 50 lists of which 32 are probed at most."""
    rng = np.random.default_rng(6)
    rows = list(enumerate(floats(rng, 26_000, 24)))
    table = frame(spark, rows)
    got = {(r.query_id, r.vec_id) for r in neighbours.search(table, table.where("vec_id % 500 = 0")).collect()}
    unit = np.array([v for _, v in rows])
    unit /= np.sqrt((unit**2).sum(axis=1))[:, None]
    asked = np.arange(0, 26_000, 500)
    inner = unit[asked] @ unit.T
    inner[np.arange(len(asked)), asked] = -2
    want = {(int(q), int(i)) for q, near in zip(asked, np.argsort(-inner, axis=1)[:, :5]) for i in near}
    assert len(got) == len(want) and len(got & want) >= 0.9 * len(want)


def test_scan_abandons_but_never_a_sure_row():
    rng = np.random.default_rng(8)
    rows, asks = rng.normal(size=(3000, 32)), rng.normal(size=(20, 32))
    rows, asks = (x / np.sqrt((x**2).sum(axis=1))[:, None] for x in (rows, asks))
    distance = ((asks[:, None] - rows[None]) ** 2).sum(axis=2)
    order = np.argsort(distance, axis=1)[:, :6]
    want = {(q, int(r)) for q in range(20) for r in order[q]}
    start = np.full(20, np.inf)
    q, r = neighbours.scan(rows, np.ones(3000, bool), asks, start, 6, 0.0)
    assert set(zip(q.tolist(), r.tolist())) == want
    q, r = neighbours.scan(rows, np.zeros(3000, bool), asks, start, 6, 3.0)
    assert len(set(zip(q.tolist(), r.tolist())) & want) >= 0.95 * len(want)
