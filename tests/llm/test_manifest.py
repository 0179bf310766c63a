"""Merkle manifest against a recursive brute force, with odd rows."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from wayfold.llm import manifest, queries


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute_leaf(*values):
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def brute_tree(nodes):
    """Root and each node's siblings with their sides."""
    paths, places, level = [[] for _ in nodes], list(range(len(nodes))), nodes
    while len(level) > 1:
        for path, at in zip(paths, places):
            other = at ^ 1
            path.append((at % 2 == 1, level[other] if other < len(level) else ""))
        level = [digest("".join(level[i: i + 2])) for i in range(0, len(level), 2)]
        places = [p // 2 for p in places]
    return level[0], paths


def brute(rows):
    groups = {}
    for row in rows:
        groups.setdefault(row[2], []).append((row[0], brute_leaf(row[0], row[1], row[2], row[3], row[4]), row))
    names = sorted(groups, key=lambda g: b"" if g is None else b"1" + g.encode())
    trees = {}
    for g in names:
        groups[g].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees[g] = brute_tree([x[1] for x in groups[g]])
    root, above = brute_tree([trees[g][0] for g in names])
    out = []
    for g, up in zip(names, above):
        for (doc, own, row), path in zip(groups[g], trees[g][1]):
            whole = path + up
            shown = own
            if doc is not None and zlib.crc32(str(doc).encode()) % 7 == 0 and row[3] is not None:
                shown = brute_leaf(row[0], row[1], row[2], row[3] + 1, row[4])
            for left, other in whole:
                shown = digest(other + shown if left else shown + other)
            out.append((doc, own, trees[g][0], root, digest("".join(o for _, o in whole)), shown, shown == root))
    return sorted(out, key=str)


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, pos int, path string, item string"
ODD = [
    (None, "s", "en", 3, "abc"), (None, None, "en", None, None), (7, "s", "en", 3, "é:1"), (7, "s", "en", 3, "é:1"), (7, "t", "en", 3, "other"),
    (8, "s", None, 4, ""), (9, "-", "", 0, "-"), (10, "s", "zh", 2, "文字"), (2, "s", "fr", 70_000, "long " * 20_000),
]


@pytest.mark.parametrize("rows", [
    ODD, ODD[7:8], [], [(i, "s", "en" if i % 3 else "de", i, f"text {i}") for i in range(1100)] + ODD,
    [(5, "s", "en", 1, "same")] * 300 + [(6, "s", "en", 1, "x")],
])
def test_manifest_query(spark, tmp_path, rows):
    docs = spark.createDataFrame([(*r, 1, "p", "i") for r in rows], SCHEMA)
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    found = queries.op11(spark, str(tmp_path))
    got = sorted((tuple(r) for r in found.collect()), key=str)
    assert found.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert got == (brute(rows) if rows else [])


def test_more_tiers_than_two(spark, monkeypatch):
    """Small blocks: five tiers, a lone last block on each."""
    monkeypatch.setattr(manifest, "LEVELS", 2)
    monkeypatch.setattr(manifest, "BLOCK", 4)
    leaves = spark.range(1025).select(F.lit("g").alias("grp"), F.col("id").alias("doc_id"), F.sha2(F.col("id").cast("string"), 256).alias("leaf"))
    found = manifest.verify(manifest.manifest(leaves), "leaf").orderBy("doc_id").collect()
    root, paths = brute_tree([digest(str(i)) for i in range(1025)])
    assert all(r.verified and r.root == root for r in found)
    assert [r.proof_sha256 for r in found] == [digest("".join(o for _, o in p)) for p in paths]
