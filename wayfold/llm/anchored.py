"""Repeated windows of a corpus, shared work of the substring operators.

A window is W consecutive symbols of one document. Every window has an anchor, its k-gram with the smallest hash, and
equal windows have equal anchors at equal places. So windows need comparing only between documents' *spans*: a span is
the run of windows that share one anchor occurrence. Only spans whose anchor occurs again anywhere are looked at:

1. `mark_spans`: anchors of all documents, dealt by their hash; anchors that occur once go.
2. `distinct_contexts`: the symbols of the remaining spans, aggregated to the first document of each distinct content.
3. an index per shard of contexts (the caller's) finds the windows that also occur earlier.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wayfold.llm.common import materialise, mix, ranges, release, skew_join, slices, texts_of

#: Rows are known by a hash of id and text: a repeated row is the same document, and one id may have several texts.
#: One document in HEAVY_SAMPLE is looked at to find anchors so common that they must not meet in one task; an anchor is
#: heavy with HEAVY_HITS hits or one in HEAVY_SHARE of the sample's anchors, so there are at most HEAVY_SHARE of them.
HEAVY_SAMPLE, HEAVY_HITS, HEAVY_SHARE = 100, 64, 100_000
#: An anchor with more spans is compared window by window instead of span by span (same results, evenly dealt).
CROWDED = 4000
#: Contexts in one shard's index, and marks of a document that are looked at together.
SHARD_CONTEXTS, UNIT_MARKS = 20_000, 8192
_HOT_BIT = 1 << 62


@dataclass(frozen=True)
class Parsed:
    """A text as symbols: their 64-bit hashes, and the bytes that symbols a..b stand for (`ends` null: one byte each)."""

    hashes: np.ndarray
    raw: bytes
    begins: np.ndarray | None = None
    ends: np.ndarray | None = None

    def contents(self, a: np.ndarray, b: np.ndarray) -> list[bytes]:
        if self.ends is not None:
            a, b = self.begins[a], self.ends[b - 1]
        return [self.raw[x:y] for x, y in zip(a.tolist(), b.tolist())]


@dataclass(frozen=True)
class Alphabet:
    """How a text becomes symbols. `window` and `gram` count symbols; `window - gram` is below 256."""

    parse: Callable[[str], Parsed]
    window: int
    gram: int


def gram_hashes(level: np.ndarray, gram: int) -> np.ndarray:
    """Hash of every k-gram of hashed symbols: lengths double, and those in the binary form of `gram` are joined."""
    n, power, taken, out, base = len(level) - gram + 1, 1, 0, None, np.uint64(0x9E3779B97F4A7C15)
    while True:
        if gram & power:
            part = level[taken: taken + n]
            out = part if out is None else out * (base + np.uint64(2 * power)) + part
            taken += power
        if taken == gram:
            return mix(out)
        level = level[:-power] * (base ^ np.uint64(2 * power)) + level[power:]
        power *= 2


def window_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """Index of the smallest value of every `width` consecutive ones: the first of ties on the upper 40 bits. Values
    and places share one integer, so that a minimum of doubling widths needs no index arithmetic."""
    low = np.uint64((1 << 24) - 1)
    if len(values) > int(low):  # a very long document, in overlapping parts
        step = int(low) - width
        parts = [window_minimum(values[a: a + step + width - 1], width) + a for a in range(0, len(values) - width + 1, step)]
        return np.concatenate(parts)
    best, have = (values & ~low) | np.arange(len(values), dtype=np.uint64), 1
    while have * 2 <= width:
        best = np.minimum(best[:-have], best[have:])
        have *= 2
    if have < width:
        best = np.minimum(best[: len(best) - (width - have)], best[width - have:])
    return (best & low).astype(np.int64)


def spans(hashes: np.ndarray, alphabet: Alphabet) -> tuple[np.ndarray, np.ndarray]:
    """Anchor hash and packed place of every span of one document: first window, anchor's offset in it, windows."""
    if len(hashes) < alphabet.window:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    grams = gram_hashes(hashes, alphabet.gram)
    anchor = window_minimum(grams, alphabet.window - alphabet.gram + 1)
    first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
    count = np.diff(np.append(first, len(anchor)))
    return grams[anchor[first]], (first << 16) | ((anchor[first] - first) << 8) | count


def _anchor_rows(docs: DataFrame, alphabet: Alphabet, heavy: np.ndarray) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids = batch.column("row").to_numpy(zero_copy_only=False)
            found = [spans(alphabet.parse(t).hashes, alphabet) for t in texts_of(batch)]
            sizes = [len(f[0]) for f in found]
            if not sum(sizes):
                continue
            key, packed = (np.concatenate([f[i] for f in found]) for i in range(2))
            row = np.repeat(ids, sizes).astype(np.int64)
            if len(heavy):
                hot = np.isin(key, heavy)
                packed[hot] |= _HOT_BIT
                key = np.where(hot, mix(key ^ mix(row.view(np.uint64)) ^ packed.view(np.uint64)), key)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(row), pa.array(packed)], ["key", "row", "span"])

    return docs.mapInArrow(run, "key long, row long, span long")


def mark_spans(docs: DataFrame, alphabet: Alphabet) -> DataFrame:
    """`(row, marks array<long>)`: spans whose anchor occurs more than once, packed as start, anchor and number of
    windows, with a bit for crowded anchors. A document's marks are bounded by its own length. Heavy anchors, known
    from a sample, keep their place under a scattered key: they are repeated anyway, and no task gets them all.
    The sample steers where work is done, never what is found."""
    sampled = docs.where(F.pmod("row", F.lit(HEAVY_SAMPLE)) == 0)
    counts = _anchor_rows(sampled, alphabet, np.zeros(0, np.uint64)).groupBy("key").count()
    top = counts.where(F.col("count") >= HEAVY_HITS).orderBy(F.desc("count"), "key").limit(HEAVY_SHARE)
    heavy = np.array([r.key for r in top.collect()], dtype=np.int64).view(np.uint64)
    rows = _anchor_rows(docs, alphabet, heavy).withColumn("n", F.count("*").over(Window.partitionBy("key")))
    kept = rows.where((F.col("n") > 1) | (F.col("span") >= _HOT_BIT))
    crowded = (F.col("n") > CROWDED) & (F.col("span") < _HOT_BIT)
    kept = kept.select("row", F.when(crowded, F.col("span") + _HOT_BIT).otherwise(F.col("span")).alias("mark"))
    marks = materialise(kept.groupBy("row").agg(F.collect_list("mark").alias("marks")))
    release(docs.sparkSession)
    return marks


@dataclass
class Units:
    """The compared pieces of one document: a whole span, or a single window of a crowded anchor (`single`). `anchor` is
    the anchor's offset in the content."""

    start: np.ndarray
    windows: np.ndarray
    anchor: np.ndarray
    key: np.ndarray
    content: list[bytes]
    single: np.ndarray


def units(parsed: Parsed, marks: np.ndarray, alphabet: Alphabet) -> Iterator[Units]:
    """Units of a document in order of their start (those of crowded anchors after the others), some thousands at a time."""
    grams = gram_hashes(parsed.hashes, alphabet.gram).view(np.int64) if len(marks) else None
    for at in range(0, len(marks), UNIT_MARKS):
        packed = marks[at: at + UNIT_MARKS]
        hot = packed >= _HOT_BIT
        packed = packed & (_HOT_BIT - 1)
        start, anchor, n = packed >> 16, (packed >> 8) & 255, packed & 255
        key, times = grams[start + anchor], np.where(hot, n, 1)
        step, single = ranges(times), np.repeat(hot, times)
        start, anchor, key = np.repeat(start, times) + step, np.repeat(anchor, times) - step, np.repeat(key, times)
        n = np.where(single, 1, np.repeat(n, times))
        content = parsed.contents(start, start + n + alphabet.window - 1)
        if single.any():
            own = np.fromiter((xxhash.xxh64_intdigest(c) if s else 0 for c, s in zip(content, single)), np.uint64, len(content))
            key = np.where(single, own.view(np.int64), key)
        yield Units(start, n, anchor, key, content, single)


def keyed(docs: DataFrame, id_col: str, text_col: str, carry: list[str] | None = None) -> DataFrame:
    """`(doc_id, row, text)`, the input of the steps below, and `rest`, a struct of the columns to carry along."""
    rest = [F.struct(*carry).alias("rest")] if carry else []
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *rest)
    return docs.select("doc_id", F.xxhash64("doc_id", "text").alias("row"), "text", *(["rest"] if carry else []))


def with_marks(docs: DataFrame, marks: DataFrame, how: str) -> DataFrame:
    return docs.join(marks.hint("shuffle_hash"), "row", how)


def marks_of(batch: pa.RecordBatch, i: int) -> np.ndarray:
    """Sorted marks of a row; a repeated row has its marks twice."""
    column = batch.column("marks")
    return np.unique(column[i].values.to_numpy(zero_copy_only=False)) if column[i].is_valid else np.zeros(0, np.int64)


#: What tells contents apart.
CONTENT = ("key", "content", "n_windows", "anchor")


def unit_rows(docs: DataFrame, marks: DataFrame, alphabet: Alphabet) -> DataFrame:
    """`(key, content binary, n_windows, anchor, doc_id, row, start)`: every distinct content of a unit of each document with its
    first place there. A single window of a crowded anchor has nothing to be searched in: a 128-bit digest stands for it, and
    `n_windows` is 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 64):
            out: list[list] = [[], [], [], [], [], [], []]
            ids = zip(batch.column("doc_id").to_pylist(), batch.column("row").to_pylist(), texts_of(batch))
            for i, (doc, row, text) in enumerate(ids):
                seen: set[tuple[int, bytes]] = set()
                for found in units(alphabet.parse(text), marks_of(batch, i), alphabet):
                    lists = (x.tolist() for x in (found.key, found.windows, found.anchor, found.start, found.single))
                    for content, key, n, anchor, start, single in zip(found.content, *lists):
                        if (key, content) not in seen:
                            seen.add((key, content))
                            if single:
                                content, n, anchor = xxhash.xxh128_digest(content), 0, 0
                            for column, value in zip(out, (key, content, n, anchor, doc, row, start)):
                                column.append(value)
            types = (pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32())
            names = ["key", "content", "n_windows", "anchor", "doc_id", "row", "start"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names)

    rows = with_marks(docs, marks, "inner")
    return rows.mapInArrow(run, "key long, content binary, n_windows int, anchor int, doc_id long, row long, start int")


def distinct_contexts(docs: DataFrame, marks: DataFrame, alphabet: Alphabet) -> tuple[DataFrame, DataFrame | None]:
    """Every distinct content with its first document and place: by id, and for rows that share an id by their hash, the same
    order for all contents; and those rows of `docs`, if there are any. The aggregate combines before the shuffle, so a passage in
    a third of all documents is a few rows by then. Rows that share an id are reduced to one per content and id before, so that the
    aggregate of all is over numbers and meets no ties but between equal rows."""
    same = twins(docs)
    if same.isEmpty():
        every, shared = unit_rows(docs, marks, alphabet), None
    else:
        shared = docs.join(same, "row", "left_semi")
        first = unit_rows(shared, marks, alphabet).groupBy(*CONTENT, "doc_id").agg(F.min(F.struct("row", "start")).alias("first"))
        every = unit_rows(docs.join(same, "row", "left_anti"), marks, alphabet).unionByName(first.select(*CONTENT, "doc_id", "first.*"))
    found = every.groupBy(*CONTENT).agg(
        F.min("doc_id").alias("doc_id"), F.min_by("row", "doc_id").alias("row"), F.min_by("start", "doc_id").alias("start")
    )
    return found, shared


def twins(docs: DataFrame) -> DataFrame:
    """`(row)`: rows that share their id with another text; written."""
    ids = docs.select("doc_id", "row").distinct()
    shared = ids.groupBy("doc_id").count().where(F.col("count") > 1).select("doc_id")
    return materialise(skew_join(ids, shared, ["doc_id"]).select("row"))


def sharded(contexts: DataFrame, marks: DataFrame) -> DataFrame:
    """Adds `shard`: contexts of one key meet in one shard, and shards hold about SHARD_CONTEXTS each at most (there is a
    mark for every context, but for crowded anchors, whose windows are dealt evenly)."""
    total = marks.agg(F.sum(F.size("marks"))).first()[0] or 0
    return contexts.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(max(1, total // SHARD_CONTEXTS))))


#: Mask of a single window's first place: not covered.
OPEN = b"\x00"


def index_shards(contexts: DataFrame, covered: Callable[[pa.Table], list[bytes]]) -> DataFrame:
    """`(row, start, mask)`: `covered` makes the masks of a shard's contexts; single windows need none."""

    def run(rows: pa.Table) -> pa.Table:
        spans_ = pa.compute.greater(rows.column("n_windows"), 0)
        searched, single = rows.filter(spans_), rows.filter(pa.compute.invert(spans_))
        masks = (covered(searched) if searched.num_rows else []) + [OPEN] * single.num_rows
        both = pa.concat_tables([searched.select(["row", "start"]), single.select(["row", "start"])])
        return both.append_column("mask", pa.array(masks, pa.binary()))

    return contexts.groupBy("shard").applyInArrow(run, "row long, start int, mask binary")


def firsts(indexed: DataFrame) -> DataFrame:
    """`(row, firsts array<struct<start, mask>>)` from `(row, start, mask)` rows, bounded by the document; written."""
    found = materialise(indexed.groupBy("row").agg(F.collect_list(F.struct("start", "mask")).alias("firsts")))
    release(indexed.sparkSession)
    return found


def covered_windows(parts: Iterator[Units], known: dict[int, bytes], same_document: bool) -> np.ndarray:
    """Starts of the windows that also occur earlier. A content's first unit has its own mask in `known` if this
    document is its first one; a unit that is not in `known` is covered whole. `same_document`: earlier places of the
    same document count, so later units of a content are covered whole; else they share the first unit's mask."""
    starts, counts, out, masks = [], [], [], {}
    for found in parts:
        for key, content, n, start in zip(found.key.tolist(), found.content, found.windows.tolist(), found.start.tolist()):
            mask = masks.get((key, content))
            if mask is None:
                mask = masks[key, content] = known.get(start, b"")
            elif same_document:
                mask = b""
            if mask:
                out.append(start + np.flatnonzero(np.unpackbits(np.frombuffer(mask, np.uint8), bitorder="little")[:n]))
            else:
                starts.append(start)
                counts.append(n)
    out.append(np.repeat(np.array(starts, np.int64), counts) + ranges(counts))
    return np.concatenate(out)


def removed_symbols(n: int, windows: np.ndarray, width: int) -> np.ndarray:
    """Boolean mask of the symbols that the windows cover."""
    delta = np.zeros(n + 1, np.int64)
    np.add.at(delta, windows, 1)
    np.add.at(delta, windows + width, -1)
    return np.cumsum(delta)[:n] > 0


def runs(removed: np.ndarray) -> np.ndarray:
    """(start, stop) of the maximal runs of true."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], removed.view(np.int8), [0]])))
    return edge.reshape(-1, 2)


def first_masks(batch: pa.RecordBatch, i: int) -> dict[int, bytes]:
    column = batch.column("firsts")
    return {x["start"]: x["mask"] for x in column[i].as_py()} if column[i].is_valid else {}
