"""Suffix-array dedup over bytes: common-prefix interval trees of sparse suffix arrays."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.llm import anchored
from wayfold.llm.common import mix, slices, texts_of

WINDOW, GRAM = 100, 32
_SPREAD = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def parse_bytes(text: str) -> anchored.Parsed:
    raw = text.encode()
    return anchored.Parsed(_SPREAD[np.frombuffer(raw, np.uint8)], raw)


def alphabet(window: int = WINDOW) -> anchored.Alphabet:
    return anchored.Alphabet(parse_bytes, window, min(GRAM, window))


@dataclass
class SuffixArray:
    """Contexts of a shard in the order of (key, bytes from the anchor on), with the common prefix of neighbours in that
    order (`lcp`, 0 between keys) and the common suffix of their bytes before the anchor (`left`)."""

    order: np.ndarray
    lcp: np.ndarray
    left: np.ndarray


def _common(rows: list[bytes], width: int, same: np.ndarray) -> np.ndarray:
    """Length of the common prefix of rows i and i + 1 where `same`, at most `width`."""
    lengths = np.array([len(r) for r in rows], dtype=np.int64)
    table = np.frombuffer(b"".join(r.ljust(width, b"\0") for r in rows), np.uint8).reshape(len(rows), width)
    differ = np.ones((max(len(rows) - 1, 0), width + 1), bool)
    differ[:, :width] = table[1:] != table[:-1]
    return np.where(same, np.minimum(differ.argmax(axis=1), np.minimum(lengths[1:], lengths[:-1])), 0)


def suffix_array(keys: list[int], contents: list[bytes], anchor: list[int], window: int) -> SuffixArray:
    suffixes = [c[a:] for c, a in zip(contents, anchor)]
    order = sorted(range(len(keys)), key=lambda i: (keys[i], suffixes[i]))
    key = np.array([keys[i] for i in order], np.int64)
    same = key[1:] == key[:-1]
    before = [contents[i][: anchor[i]][::-1] for i in order]
    return SuffixArray(np.array(order, np.int64), _common([suffixes[i] for i in order], window, same), _common(before, window, same))


def interval_tree(lcp: list[int]) -> Iterator[tuple[int, int, int, int]]:
    """Nodes (depth, depth of the parent, first, last) of the common-prefix interval tree, children before parents, by
    one scan with a stack. Nodes of depth 0 are left out."""
    stack: list[tuple[int, int]] = []  # (depth, first)
    for i, depth in enumerate([*lcp, 0]):
        first = i
        while stack and stack[-1][0] > depth:
            top, first = stack.pop()
            yield top, max(depth, stack[-1][0] if stack else 0), first, i
        if depth and (not stack or stack[-1][0] < depth):
            stack.append((depth, first))


def left_classes(members: list[int], contents: list[bytes], anchor: list[int], reach: int) -> list[list[int]]:
    """Members with the same `reach` bytes before the anchor; those with fewer bytes are in none."""
    classes: dict[bytes, list[int]] = {}
    for i in members:
        if anchor[i] >= reach:
            classes.setdefault(contents[i][anchor[i] - reach: anchor[i]], []).append(i)
    return [c for c in classes.values() if len(c) > 1]


def covered(keys: list[int], contents: list[bytes], n_windows: list[int], anchor: list[int], place: list[tuple[int, int, int]], window: int) -> list[bytes]:
    """For every context a bit mask of its windows that also start at an earlier place (document, row, byte of the anchor).

    A window reaches `reach` bytes before the anchor and needs a common prefix of `window - reach` after it: it belongs to
    the tree node whose depth allows that and whose parent's does not. Inside a node, the left-extension test decides:
    as far as all members agree before the anchor they are one class, beyond it they are split by those bytes."""
    if not keys:
        return []
    array = suffix_array(keys, contents, anchor, window)
    rank = np.empty(len(place), np.int64)
    rank[sorted(range(len(place)), key=place.__getitem__)] = np.arange(len(place))
    order, left, rank = array.order.tolist(), array.left, rank.tolist()
    masks = [0] * len(keys)
    for depth, above, first, last in interval_tree(array.lcp.tolist()):
        members = order[first: last + 1]
        shortest, longest = max(window - depth, 0), window - above - 1  # bytes before the anchor
        longest = min(longest, max(anchor[i] for i in members))
        if longest < shortest:
            continue
        agreed = int(left[first:last].min())
        if agreed >= shortest:
            upto = min(agreed, longest)
            earliest = min(members, key=rank.__getitem__)
            for i in members:  # every member has `agreed` bytes there
                if i != earliest:
                    low, high = max(anchor[i] - upto, 0), min(anchor[i] - shortest, n_windows[i] - 1)
                    if low <= high:
                        masks[i] |= ((1 << (high - low + 1)) - 1) << low
        for reach in range(max(agreed + 1, shortest), longest + 1):
            for group in left_classes(members, contents, anchor, reach):
                earliest = min(group, key=rank.__getitem__)
                for i in group:
                    at = anchor[i] - reach
                    if i != earliest and at < n_windows[i]:
                        masks[i] |= 1 << at
    return [m.to_bytes((n + 7) // 8, "little") for m, n in zip(masks, n_windows)]


def repeats(keys: list[int], contents: list[bytes], anchor: list[int], window: int) -> Iterator[tuple[int, int, list[int]]]:
    """Maximal repeats inside the contexts: (bytes before the anchor, bytes from it on, members). A node is right-maximal
    by the tree; a class of members is left-maximal when one more byte before the anchor splits it or ends it."""
    if not keys:
        return
    array = suffix_array(keys, contents, anchor, window)
    order = array.order.tolist()
    for depth, _, first, last in interval_tree(array.lcp.tolist()):
        classes, reach = [order[first: last + 1]], 0
        while classes:
            longer = []
            for members in classes:
                split = left_classes(members, contents, anchor, reach + 1)
                if not (len(split) == 1 and len(split[0]) == len(members)) and reach + depth >= window:
                    yield reach, depth, members
                longer += split
            classes, reach = longer, reach + 1


_LISTS = ("key", "content", "n_windows", "anchor", "doc_id", "row", "start")


def _indexed(contexts: DataFrame, window: int) -> DataFrame:
    def masks(rows: pa.Table) -> list[bytes]:
        key, content, n, anchor, doc, row, start = (rows.column(c).to_pylist() for c in _LISTS)
        return covered(key, content, n, anchor, [(d, r, s + a) for d, r, s, a in zip(doc, row, start, anchor)], window)

    return anchored.index_shards(contexts, masks)


def repeat_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """`(group_id, n_bytes, doc_id, start)`: all occurrences of every maximal repeat of `window` bytes or more around an
    anchor, one row per distinct context (its first document). Repeats are followed as far as the contexts reach; crowded
    anchors, whose windows are compared one by one, are left to `dedup`."""
    docs, letters = anchored.keyed(docs, id_col, text_col).where("doc_id is not null"), alphabet(window)
    marks = anchored.mark_spans(docs, letters)
    contexts = anchored.sharded(anchored.distinct_contexts(docs, marks, letters)[0], marks)

    def run(rows: pa.Table) -> pa.Table:
        key, content, _, anchor, doc, _, start = (rows.column(c).to_pylist() for c in _LISTS)
        out: list[tuple[str, int, int, int]] = []
        for i, (reach, depth, members) in enumerate(repeats(key, content, anchor, window)):
            name = f"{key[members[0]]}-{i}"
            out += [(name, reach + depth, doc[m], start[m] + anchor[m] - reach) for m in members]
        types = (pa.string(), pa.int64(), pa.int64(), pa.int64())
        columns = list(zip(*out)) or [()] * 4
        return pa.table([pa.array(c, t) for c, t in zip(columns, types)], ["group_id", "n_bytes", "doc_id", "start"])

    return contexts.where("n_windows > 0").groupBy("shard").applyInArrow(run, "group_id string, n_bytes long, doc_id long, start long")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """`(doc_id, n_bytes, kept binary, spans array<struct<start, stop>>)` for every row: bytes (UTF-8) covered by a string
    of `window` bytes that also starts earlier (smaller id, or same document and earlier) are taken out; overlaps count,
    and all is judged on the input. `spans` are the maximal removed runs.

    Null or empty text: no bytes. Repeated rows are one document and get the same result; rows that share an id but not a text
    are documents in the order of a hash of their texts. Rows with a null id are never changed and change nothing. Bytes are compared
    themselves (windows of crowded anchors by 128-bit digests). Extra columns are ignored."""
    docs, letters = anchored.keyed(docs, id_col, text_col), alphabet(window)
    known = docs.where("doc_id is not null")
    marks = anchored.mark_spans(known, letters)
    contexts = anchored.sharded(anchored.distinct_contexts(known, marks, letters)[0], marks)
    masks = anchored.firsts(_indexed(contexts, window))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 128):
            counts, kept, cut = [], [], []
            for i, text in enumerate(texts_of(batch)):
                codes = np.frombuffer(text.encode(), np.uint8)
                gone = np.zeros(0, np.int64)
                if batch.column("marks")[i].is_valid:
                    found = anchored.units(parse_bytes(text), anchored.marks_of(batch, i), letters)
                    gone = anchored.covered_windows(found, anchored.first_masks(batch, i), True)
                removed = anchored.removed_symbols(len(codes), gone, window) if len(gone) else np.zeros(len(codes), bool)
                counts.append(len(codes))
                cut.append([{"start": a, "stop": b} for a, b in anchored.runs(removed).tolist()])
                kept.append(codes[~removed].tobytes())
            columns = [
                batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(kept, pa.binary()),
                pa.array(cut, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "kept", "spans"])

    rows = anchored.with_marks(anchored.with_marks(docs, marks, "left"), masks, "left")
    return rows.mapInArrow(run, "doc_id long, n_bytes long, kept binary, spans array<struct<start:long,stop:long>>")
