"""Substring dedup over words: a compressed FM-index per shard, backward search, matching intervals."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayfold.llm import anchored
from wayfold.llm.common import materialise, mix, slices, texts_of

#: Words of a window, and of its anchor.
WINDOW, GRAM = 13, 5


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Base of the polynomial word hash; odd, so that it has an inverse.
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse for texts of up to `size` bytes; those of long texts are not kept."""
    size = 1 << max(12, (size - 1).bit_length())
    return _kept_powers(size) if size <= 1 << 20 else _kept_powers.__wrapped__(size)


@cache
def _kept_powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, both modulo 2 to the 64."""
    inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
    return tuple(np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(size - 1, b, np.uint64)])) for b in (_BASE, inverse))


def parse_words(text: str) -> anchored.Parsed:
    """Words cut at ASCII white space and hashed byte array-wise; `raw` has them joined by one space. A word's hash is that of
    its bytes as a polynomial, from running sums over the text."""
    raw = text.encode()
    space = _SPACE[np.frombuffer(raw, np.uint8)]
    if space.any() and (space[0] or space[-1] or raw.count(b" ") != int(space.sum()) or (space[1:] & space[:-1]).any()):
        raw = b" ".join(raw.split())
        space = np.frombuffer(raw, np.uint8) == 32
    if not raw:
        return anchored.Parsed(np.zeros(0, np.uint64), raw, np.zeros(0, np.int64), np.zeros(0, np.int64))
    gaps = np.flatnonzero(space)
    begins, ends = np.concatenate([[0], gaps + 1]), np.append(gaps, len(raw))
    power, inverse = _powers(len(raw))
    total = np.concatenate([[np.uint64(0)], np.cumsum((np.frombuffer(raw, np.uint8).astype(np.uint64) + np.uint64(1)) * power[: len(raw)])])
    return anchored.Parsed(mix((total[ends] - total[begins]) * inverse[begins]), raw, begins, ends)


def alphabet(window: int = WINDOW) -> anchored.Alphabet:
    return anchored.Alphabet(parse_words, window, min(GRAM, window))


class WaveletMatrix:
    """Rank of any symbol in a sequence: one bit vector per level, packed, with a running count per 64 bits."""

    def __init__(self, sequence: np.ndarray, symbols: int):
        self.levels = max(1, int(symbols - 1).bit_length())
        self.words, self.counts, self.zeros = [], [], []
        now = sequence.astype(np.int64)
        for level in range(self.levels - 1, -1, -1):
            bit = (now >> level) & 1
            padded = np.zeros((len(bit) // 64 + 1) * 64, np.uint8)
            padded[: len(bit)] = bit
            words = np.packbits(padded, bitorder="little").view("<u8")
            self.words.append(words)
            self.counts.append(np.concatenate([[0], np.cumsum(np.bitwise_count(words).astype(np.int64))]))
            self.zeros.append(int(len(bit) - bit.sum()))
            now = np.concatenate([now[bit == 0], now[bit == 1]])
        ids = np.arange(symbols)
        self.base = self._down(ids, np.zeros(symbols, np.int64))

    def _down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for i, level in enumerate(range(self.levels - 1, -1, -1)):
            block = at >> 6
            inside = self.words[i][block] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1))
            ones = self.counts[i][block] + np.bitwise_count(inside)
            at = np.where((symbol >> level) & 1, self.zeros[i] + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of symbol[i] before place at[i]."""
        return self._down(symbol, at) - self.base[symbol]


class FmIndex:
    """Backward search over the joined contexts of a shard. Symbol 0 ends every context, so nothing matches across.
    Suffixes are ordered by their first 16 symbols or more, enough for windows up to that length."""

    def __init__(self, text: np.ndarray, symbols: int, depth: int):
        rank, span = text.astype(np.int64), 1
        while span < depth:
            ahead = np.concatenate([rank[span:], np.zeros(min(span, len(rank)), np.int64)])[: len(rank)]
            rank = np.unique(rank * (rank.max() + 2) + ahead + 1, return_inverse=True)[1]
            span *= 2
        self.places = np.argsort(rank, kind="stable")
        self.below = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=symbols))])[:symbols]
        self.last = WaveletMatrix(text[self.places - 1], symbols)
        self.size = len(text)

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix intervals after putting `symbol` in front of the matched strings."""
        both = self.last.rank(np.concatenate([symbol, symbol]), np.concatenate([low, high])) + np.tile(self.below[symbol], 2)
        return both[: len(symbol)], both[len(symbol):]


def interval_minimum(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Smallest of values[low:high] for each non-empty interval, by a table of doubling widths."""
    width = np.frexp((high - low).astype(float))[1] - 1
    out, level, table = np.empty(len(low), values.dtype), 0, values
    while True:
        mine = width == level
        out[mine] = np.minimum(table[low[mine]], table[high[mine] - (1 << level)])
        if level >= width.max(initial=0):
            return out
        table = np.minimum(table[: -(1 << level)], table[1 << level:])
        level += 1


def covered(contents: list[bytes], n_windows: np.ndarray, doc: np.ndarray, window: int) -> list[bytes]:
    """For every context a bit mask of its windows that also occur in a context of a smaller document. The windows'
    words are searched backwards together; a window whose interval narrows to its own place leaves the search."""
    names: dict[bytes, int] = {}
    split = [[names.setdefault(w, len(names) + 1) for w in c.split(b" ")] for c in contents]
    lengths = np.array([len(w) for w in split], dtype=np.int64)
    starts = np.cumsum(lengths + 1) - lengths - 1
    text = np.zeros(int(lengths.sum() + len(lengths)), np.int64)
    text[np.repeat(starts, lengths) + anchored.ranges(lengths)] = np.fromiter(chain.from_iterable(split), np.int64, int(lengths.sum()))
    owner = np.repeat(np.arange(len(lengths)), lengths + 1)
    index = FmIndex(text, len(names) + 1, window)
    owner_rows = np.repeat(np.arange(len(contents)), n_windows)
    step = anchored.ranges(n_windows)
    at = starts[owner_rows] + step
    live = np.arange(len(at))
    low, high = np.zeros(len(at), np.int64), np.full(len(at), index.size, np.int64)
    for back in range(window - 1, -1, -1):
        low, high = index.extend(text[at[live] + back], low, high)
        more = high - low > 1
        live, low, high = live[more], low[more], high[more]
    hit = np.zeros(len(at), bool)
    if len(live):
        hit[live] = interval_minimum(doc[owner][index.places], low, high) < doc[owner_rows[live]]
    ends = np.cumsum(n_windows)
    return [np.packbits(hit[a:b], bitorder="little").tobytes() for a, b in zip((ends - n_windows).tolist(), ends.tolist())]


def _indexed(contexts: DataFrame, window: int) -> DataFrame:
    def masks(rows: pa.Table) -> list[bytes]:
        n, doc = (rows.column(c).to_numpy().astype(np.int64) for c in ("n_windows", "doc_id"))
        return covered(rows.column("content").to_pylist(), n, doc, window)

    return anchored.index_shards(contexts, masks)


def _with_twins(found: DataFrame, contexts: DataFrame, docs: DataFrame, marks: DataFrame, letters: anchored.Alphabet) -> DataFrame:
    """Also gives the mask of a content to rows that share the id, but not the text, of its first document: it was
    found against smaller ids, which are the same for them."""
    found = materialise(found)
    held = contexts.select(*anchored.CONTENT, "doc_id", F.col("row").alias("first_row"), F.col("start").alias("first_start"))
    own = anchored.unit_rows(docs, marks, letters).join(held, [*anchored.CONTENT, "doc_id"]).where("row <> first_row")
    masks = found.select(F.col("row").alias("first_row"), F.col("start").alias("first_start"), "mask")
    return found.unionByName(own.join(masks, ["first_row", "first_start"]).select("row", "start", "mask"))


def dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, carry: list[str] | None = None
) -> DataFrame:
    """`(doc_id, n_words, kept_text, intervals array<struct<start, stop>>)` for every row: words (cut at ASCII white
    space) covered by a window of `window` words whose sequence also starts in a document with a smaller id are taken
    out; `intervals` are their maximal runs, `kept_text` the other words joined by one space.

    All decisions are on the input. Null or empty text: no words. Repeated rows get the same
    result; so do rows that share an id but not a text: none of them is earlier than another. Rows with a null id are never changed
    and change nothing. Words are compared by 64-bit hashes, so windows by 13 of them. Extra columns are ignored but for those in `carry`, returned as the struct `rest`."""
    docs = anchored.keyed(docs, id_col, text_col, carry)
    letters = alphabet(window)
    known = docs.where("doc_id is not null").drop("rest")
    marks = anchored.mark_spans(known, letters)
    contexts, shared = anchored.distinct_contexts(known, marks, letters)
    contexts = anchored.sharded(contexts, marks)
    found = _indexed(contexts, window)
    if shared is not None:
        found = _with_twins(found, contexts, shared, marks, letters)
    masks = anchored.firsts(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 128):
            counts, kept, cut = [], [], []
            for i, text in enumerate(texts_of(batch)):
                parsed = parse_words(text)
                gone = np.zeros(0, np.int64)
                if batch.column("marks")[i].is_valid:
                    found = anchored.units(parsed, anchored.marks_of(batch, i), letters)
                    gone = anchored.covered_windows(found, anchored.first_masks(batch, i), False)
                counts.append(len(parsed.hashes))
                runs = anchored.runs(anchored.removed_symbols(len(parsed.hashes), gone, window)) if len(gone) else np.zeros((0, 2), np.int64)
                cut.append([{"start": a, "stop": b} for a, b in runs.tolist()])
                left = np.concatenate([[0], runs.reshape(-1), [len(parsed.hashes)]]).reshape(-1, 2)
                left = left[left[:, 0] < left[:, 1]]
                kept.append(b" ".join(parsed.contents(left[:, 0], left[:, 1])) if len(runs) else parsed.raw)
            columns = [
                batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array([k.decode() for k in kept], pa.string()),
                pa.array(cut, pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))),
            ]
            names = ["doc_id", "n_words", "kept_text", "intervals"]
            if carry:
                columns, names = [*columns, batch.column("rest")], [*names, "rest"]
            yield pa.RecordBatch.from_arrays(columns, names)

    rows = anchored.with_marks(anchored.with_marks(docs, marks, "left"), masks, "left")
    schema = T.StructType.fromDDL("doc_id long, n_words long, kept_text string, intervals array<struct<start:int,stop:int>>")
    return rows.mapInArrow(run, T.StructType([*schema.fields, *[f for f in rows.schema.fields if f.name == "rest"]]))


def strip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with the repeated words taken out of the texts; texts without any stay as they are, byte for byte. Documents
    that lose all their words leave. `n_chars`, if there is one, follows the text."""
    found = dedup(docs, id_col, text_col, carry=docs.columns)
    cut = F.size("intervals") > 0
    text = F.when(cut, F.col("kept_text")).otherwise(F.col(f"rest.{text_col}"))
    length = F.when(cut, F.length("kept_text")).otherwise(F.col("rest.n_chars")) if "n_chars" in docs.columns else None
    own = {text_col: text} | ({"n_chars": length.cast(docs.schema["n_chars"].dataType)} if length is not None else {})
    return found.where(~cut | (F.length("kept_text") > 0)).select(*[own.get(c, F.col(f"rest.`{c}`")).alias(c) for c in docs.columns])
