"""SimHash near-duplicates: fingerprints, pigeonhole blocks, Hamming verification, components."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.llm.common import bounded, local_components, materialise, skew_join, slices, texts_of
from wayfold.llm.components import components

SHINGLE_WORDS, SEED, MAX_BITS = 4, 42, 4
#: Fingerprints are cut into BLOCKS parts; two that differ in at most MAX_BITS bits agree on at least BLOCKS - MAX_BITS.
#: More blocks mean longer keys and more rows: 6 for up to some 10^9 fingerprints, 7 or 8 beyond; results are the same.
BLOCKS = 6
#: A bucket with more fingerprints is cut into chunks of about this size, and the chunk pairs are compared apart.
CHUNK = 1024
_UPPER = bytes(range(65, 91)), bytes(range(97, 123))
_LOWER = bytes.maketrans(*_UPPER)


def fingerprint(text: str, shingle: int = SHINGLE_WORDS) -> int:
    """64-bit SimHash of the word shingles (A-Z lower-cased, words cut at ASCII white space, repeats included)."""
    words = text.encode().translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    n = max(1, len(words) - shingle + 1)
    starts = np.concatenate([[0], ends[: n - 1] + 1]).tolist()
    stops = ends[min(shingle, len(words)) - 1:].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, stops)), np.uint64, n)
    bits = np.zeros(64, dtype=np.int64)
    for at in range(0, n, 4096):
        part = hashes[at: at + 4096].astype("<u8").view(np.uint8).reshape(-1, 8)
        bits += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * bits > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`(doc_id, fp long)`: the fingerprint as a signed long. Null and empty texts have fingerprint zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            fps = np.array([fingerprint(t) for t in texts_of(batch)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps)], ["doc_id", "fp"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, fp long")


def block_masks(blocks: int = BLOCKS, max_bits: int = MAX_BITS) -> list[int]:
    """A mask for each choice of blocks that may agree: any two fingerprints within `max_bits` agree under one."""
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    parts = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]
    return [sum(parts[i] for i in pick) for pick in combinations(range(blocks), blocks - max_bits)]


def split_buckets(entries: DataFrame, keys: list[str], item: str, chunk: int = CHUNK) -> DataFrame:
    """Adds `own`, `low`, `high`: rows of a bucket (equal `keys`) with more than `chunk` rows are dealt into chunks by a
    hash of `item`, and each row goes to every chunk pair that holds its chunk; other rows stay in the pair (0, 0).
    Every pair of rows of a bucket meets in the group (keys, low, high), and no group is larger than about two chunks.
    Sizes come from an aggregate that combines before the shuffle; the table of large buckets has at most rows / chunk
    rows and is joined, not collected."""
    large = entries.groupBy(*keys).count().where(F.col("count") > chunk)
    large = large.select(*keys, F.ceil(F.col("count") / chunk).cast("int").alias("chunks"))
    out = skew_join(entries, large, keys, "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    out = out.withColumn("own", F.pmod(F.xxhash64(item), F.col("chunks")).cast("int"))
    out = out.withColumn("mate", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    return out.withColumn("low", F.least("own", "mate")).withColumn("high", F.greatest("own", "mate")).drop("chunks", "mate")


def bucket_links(entries: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Links inside buckets: `(mask, key, own, low, high, fp, rep)` -> `(u, v)`, a spanning star of every component of
    a run of groups rather than all its pairs. Rows arrive sorted by group; equal distances are compared together."""

    def links(group: np.ndarray, fp: np.ndarray, rep: np.ndarray) -> pa.RecordBatch:
        found_u, found_v, at, step = [], [], np.arange(len(fp)), 1
        while True:
            at = at[at + step < len(fp)]
            at = at[group[at] == group[at + step]]
            if not len(at):
                break
            near = at[np.bitwise_count((fp[at] ^ fp[at + step]).view(np.uint64)) <= max_bits]
            found_u.append(rep[near])
            found_v.append(rep[near + step])
            if sum(map(len, found_u)) > 1 << 20:
                u, v = local_components(np.concatenate(found_u), np.concatenate(found_v))
                found_u, found_v = [u], [v]
            step += 1
        u, v = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (found_u, found_v))
        if len(u):
            u, v = local_components(u, v)
        keep = u != v
        return pa.RecordBatch.from_arrays([pa.array(u[keep]), pa.array(v[keep])], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            now = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("group", "fp", "rep")]
            held = [np.concatenate(x) for x in zip(held, now)] if held else now
            cut = int(np.argmax(held[0] == held[0][-1]))  # where the last group, which may go on, begins
            if cut:
                yield links(*[x[:cut] for x in held])
                held = [x[cut:] for x in held]
        if held:
            yield links(*held)

    grouped = entries.select(F.xxhash64("mask", "key", "low", "high").alias("group"), "fp", "rep")
    placed = grouped.repartition("group").sortWithinPartitions("group")
    return placed.mapInArrow(run, "u long, v long").distinct()


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS, blocks: int = BLOCKS
) -> DataFrame:
    """`(doc_id, fingerprint, component_id)` for every row: 16 hex digits and the smallest doc_id reachable over links
    of at most `max_bits` differing bits.

    Equal fingerprints are one node from the start (smallest doc_id first), so a group of copies of any size costs one
    row per fingerprint. Pairs of different fingerprints are found by pigeonhole: both agree on `blocks - max_bits` of
    the blocks, which is an equi-grouping per choice of blocks; the distance is then checked. No pair is lost.
    Null or empty texts: fingerprint zero, linked like any other. Null ids: rows are kept and get the component of
    their fingerprint. Repeated rows come back as often. Extra columns are ignored."""
    prints = materialise(fingerprints(docs, id_col, text_col))
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("rep"))
    masks = F.array(*[F.lit(m - (1 << 64) if m >> 63 else m).cast("long") for m in block_masks(blocks, max_bits)])
    entries = nodes.where("rep is not null").select("fp", "rep", F.explode(masks).alias("mask"))
    entries = entries.select("fp", "rep", "mask", F.col("fp").bitwiseAND(F.col("mask")).alias("key"))
    joined = components(bucket_links(split_buckets(entries, ["mask", "key"], "fp"), max_bits))
    named = nodes.join(joined, nodes.rep == joined.id, "left").select("fp", F.coalesce("component_id", "rep").alias("component_id"))
    return skew_join(prints, named, ["fp"], "left").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame, found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Rows of `docs` whose id is the smallest of its group. Rows with a null id stay; rows of one id are one document."""
    gone = bounded(found.where("doc_id <> component_id").select(F.col("doc_id").alias(id_col)).distinct())
    return docs.join(gone, id_col, "left_anti")
