"""Best-fit packing of tokenised documents with certified bin counts."""

from __future__ import annotations

import re
import sys
import zlib
from array import array
from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.llm.common import materialise, ranges, slices, worker_memory

CAPACITY, END_ID = 4096, 1
#: Pieces of one partition; small enough for one task, large enough that best-fit decreasing wastes next to nothing.
PARTITION_PIECES = 4000
#: The share of a bin that must be empty for its pieces to be exchanged.
LOOSE = 0.005
#: Bytes that a worker keeps of encoded parts of chunks, by what the entries take.
PART_BYTES = 64 << 20
#: Bytes of an entry besides its key and ids: two objects and their places in a table.
ENTRY_BYTES = 130
#: Plain words that are encoded as one text.
JOINED = 512
_MARKS = ".,!?;:*#%&$)|"
#: A chunk that is cut: marks behind a letter or digit, and nowhere the beginning of a special token.
_CUT = "[0-9A-Za-z][" + re.escape(_MARKS) + "]+$"
TOKENIZER, WORD_END = "word_bpe_49k.json", "</w>"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Memory:
    """A table of two generations, together within `size` bytes: a full young one becomes the old one, and what is used
    again comes back from there."""

    def __init__(self, size: int):
        self.half, self.used, self.young, self.old = size // 2, 0, {}, {}

    def put(self, keys: list[bytes], values: list[bytes]) -> None:
        for key, value in zip(keys, values):
            self.used += ENTRY_BYTES + len(key) + len(value)
            if self.used > self.half:
                self.young, self.old, self.used = {}, self.young, ENTRY_BYTES + len(key) + len(value)
            self.young[key] = value

    def get(self, keys: list[bytes]) -> list[bytes | None]:
        """Values in order, None for what is not there."""
        found = list(map(self.young.get, keys))
        absent = [i for i, v in enumerate(found) if v is None]
        back = [(i, v) for i in absent if (v := self.old.get(keys[i])) is not None]
        for i, v in back:
            found[i] = v
        self.put([keys[i] for i, _ in back], [v for _, v in back])
        return found

    def complete(self, keys: list[bytes], make) -> list[bytes]:
        """Values in order; `make` gives those that are not there, which are then kept."""
        found = self.get(keys)
        absent = [i for i, v in enumerate(found) if v is None]
        if absent:
            names = [keys[i] for i in absent]
            made = make(names)
            self.put(names, made)
            for i, v in zip(absent, made):
                found[i] = v
        return found


class Encoder:
    """Token ids of whole texts.

    White space is dropped by this tokenizer and no token spans it, so a text's ids are its chunks' ids in order. A chunk
    that ends in marks after a letter or digit is two pre-tokens or more, cut there; and letters are lower-cased first. So
    every distinct chunk is put together from the ids of its lower-case body and its marks, each encoded once while it is
    remembered. Python sees the distinct parts of a batch only; all else is done column-wise. Plain words are encoded many at a time: a word of letters is one pre-token, and only the last token of a pre-token has the ending
    mark, so the ids of joined words are cut behind those tokens."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        if array("I").itemsize != 4 or sys.byteorder != "little":
            raise RuntimeError("ids are kept as little-endian 32-bit integers")
        self.tokenizer = Tokenizer.from_file(path)
        self.parts = Memory(PART_BYTES)
        vocabulary = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closes[[i for name, i in vocabulary.items() if name.endswith(WORD_END)]] = True

    @classmethod
    def of(cls, path: str) -> Encoder:
        """One per worker process and file, until another operator's tasks run there."""
        kept = worker_memory("packing")
        if path not in kept:
            kept[path] = cls(path)
        return kept[path]

    def _one_by_one(self, names: list[bytes]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast([n.decode() for n in names], add_special_tokens=False)
        return [array("I", e.ids).tobytes() for e in found]

    def _words(self, names: list[bytes]) -> list[bytes]:
        """Ids of words of letters; each has one ending mark at least, so as many as words means one each."""
        out: list[bytes] = []
        groups = [names[at: at + JOINED] for at in range(0, len(names), JOINED)]
        for group, found in zip(groups, self.tokenizer.encode_batch_fast([b" ".join(g).decode() for g in groups], add_special_tokens=False)):
            ids = np.array(found.ids, "<u4")
            ends = (4 * (np.flatnonzero(self.closes[ids]) + 1)).tolist()
            raw = ids.tobytes()
            if len(ends) == len(group) and ends[-1] == len(raw):
                out += [raw[a:b] for a, b in zip([0, *ends], ends)]
            else:  # a letter that is none any more after lower-casing
                out += self._one_by_one(group)
        return out

    def _encoded(self, names: list[bytes]) -> list[bytes]:
        plain = [n.decode().isalpha() for n in names]
        words = iter(self._words([n for n, p in zip(names, plain) if p]))
        rest = iter(self._one_by_one([n for n, p in zip(names, plain) if not p]))
        return [next(words if p else rest) for p in plain]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one behind the other, and where each text begins and the last ends; null is empty."""
        pc = pa.compute
        split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        ends = np.concatenate([[0], np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64))])
        coded = split.flatten().dictionary_encode()
        chunks = coded.dictionary
        cut = pc.and_(pc.match_substring_regex(chunks, _CUT), pc.invert(pc.match_substring(chunks, "<|")))
        body = pc.if_else(cut, pc.ascii_rtrim(chunks, _MARKS), chunks)
        size = pc.binary_length(body).to_numpy()
        places = np.flatnonzero(cut.to_numpy(zero_copy_only=False))
        marks = [c[n:] for c, n in zip(chunks.take(pa.array(places)).cast(pa.binary()).to_pylist(), size[places].tolist())]
        parts = pa.concat_arrays([pc.ascii_lower(body).cast(pa.binary()), pa.array(marks, pa.binary())]).dictionary_encode()
        values = self.parts.complete(parts.dictionary.to_pylist(), self._encoded)
        length = np.fromiter(map(len, values), np.int64, len(values)) // 4
        start = np.cumsum(length) - length
        part = parts.indices.to_numpy()
        # Every chunk is its body and its marks; most have none, which is the part behind all others.
        length, start = np.append(length, 0), np.append(start, 0)
        pair = np.stack([part[: len(chunks)], np.full(len(chunks), len(values))], axis=1)
        pair[places, 1] = part[len(chunks):]
        place = pair[coded.indices.to_numpy()].reshape(-1)
        each = length[place]
        ids = np.frombuffer(b"".join(values), "<u4")[np.repeat(start[place], each) + ranges(each)]
        edges = np.concatenate([[0], np.cumsum(each)])[2 * ends]
        return ids, edges


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, tokenizer: str | None = None) -> DataFrame:
    """`(doc_id, piece, start, length, ids_crc32)`: each document's ids and `end_id`, cut every `capacity` ids. Null and
    empty texts are one piece with `end_id` alone."""
    path, end = tokenizer or tokenizer_path(), np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(path)
        for batch in slices(batches, 512):
            doc, piece, start, length, crc = [], [], [], [], []
            every, edges = encoder.encode(batch.column("text"))
            for name, a, b in zip(batch.column("doc_id").to_pylist(), edges.tolist(), edges[1:].tolist()):
                ids = every[a:b].tobytes() + end
                for i, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at: at + 4 * capacity]
                    doc.append(name)
                    piece.append(i)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            columns = [pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), *[pa.array(x, pa.int64()) for x in (start, length, crc)]]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def lower_bound(counts: np.ndarray) -> int:
    """Bins that any packing needs. counts[l]: pieces of length l, capacity len(counts) - 1. The largest of the sums
    under dual feasible functions: the length itself, its roundings to k-ths (Fekete and Schepers), and for thresholds e the map that counts
    pieces over C - e whole and leaves out those under e (Martello and Toth)."""
    capacity = len(counts) - 1
    lengths = np.arange(capacity + 1)
    best = -(-int((counts * lengths).sum()) // capacity)
    for k in range(1, 21):
        scaled = lengths * (k + 1)
        value = np.where(scaled % capacity == 0, lengths * k, (scaled // capacity) * capacity)  # in units of 1 / (k C)
        best = max(best, -(-int((counts * value).sum()) // (k * capacity)))
    total, mass = np.cumsum(counts), np.cumsum(counts * lengths)
    e = np.arange(1, capacity // 2 + 1)
    whole = total[capacity] - total[capacity - e]
    middle = mass[capacity - e] - mass[e - 1]
    return max(best, int((whole + -(-middle // capacity)).max(initial=0)))


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each piece, and the fill of each bin: longest first, into the fullest bin with room. Bins with
    equal room are a stack; one integer has a bit for every room that occurs, so the best fit is its lowest set bit."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    fill: list[int] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        length = int(lengths[i])
        fitting = rooms >> length
        if fitting:
            room = length + (fitting & -fitting).bit_length() - 1
            at = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            at, room = len(fill), capacity
            fill.append(0)
        bins[i], offsets[i] = at, fill[at]
        fill[at] += length
        rest = room - length
        if rest:
            by_room[rest].append(at)
            rooms |= 1 << rest
    return bins, offsets, np.array(fill, np.int64)


_PACKED = ("doc_id", "piece", "start", "length", "ids_crc32", "part", "bin", "offset", "fill", "bins", "bound")


def _pack(rows: DataFrame, capacity: int) -> DataFrame:
    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["length", "doc_id", "piece"], ignore_index=True)
        lengths = part["length"].to_numpy(np.int64)
        bins, offsets, fill = best_fit_decreasing(lengths, capacity)
        bound = lower_bound(np.bincount(lengths, minlength=capacity + 1))
        return part.assign(bin=bins, offset=offsets, fill=fill[bins], bins=len(fill), bound=bound)[list(_PACKED)]

    return rows.select("doc_id", "piece", "start", "length", "ids_crc32", "part").groupBy("part").applyInPandas(
        run, ", ".join(f"{c} {'int' if c == 'piece' else 'long'}" for c in _PACKED)
    )


def pack(cut: DataFrame, capacity: int = CAPACITY, partition_pieces: int = PARTITION_PIECES) -> DataFrame:
    """Adds `sequence_id`, `offset`, `sequence_length` to the pieces, and `partition_bins` and `partition_bound`, the bins of the
    partition that packed a piece last and the certificate: as many at least any packing of that partition needs.

    Each partition of about `partition_pieces` pieces is packed by best-fit decreasing, and dual feasible functions
    bound its bins from below. While the bins in use exceed the bound over all pieces, bins with room give their pieces
    back; those are dealt anew, in partitions of the same size, and packed again: what was a gap in each of many
    partitions becomes a gap in a few. That goes on until the bound is met or a round saves no bin. A partition is never larger for a larger input. Pieces longer than the capacity
    are an error of the caller; repeated rows are pieces of their own; an empty table gives an empty table."""
    cut = materialise(cut)
    counted = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    histogram = np.zeros(capacity + 1, np.int64)
    for length, n in counted.items():
        histogram[length] = n
    total, goal = int(histogram.sum()), lower_bound(histogram)
    if not total:
        more = ("sequence_id", "offset", "sequence_length", "partition_bins", "partition_bound")
        return cut.select("*", *[F.lit(0).cast("long").alias(c) for c in more])
    done, open_, used, left, before = [], cut, 0, total, total + 1
    for turn in count():
        parts = max(1, -(-left // partition_pieces))
        # Dealt by where a row was read: rows of one id, or equal in all, do not meet in one partition.
        dealt = open_.withColumn("part", F.pmod(F.xxhash64(F.monotonically_increasing_id(), F.lit(turn)), F.lit(parts)))
        packed = materialise(_pack(dealt, capacity).withColumn("turn", F.lit(turn)))
        loose = F.col("fill") < capacity - int(capacity * LOOSE)
        bins = packed.select("part", "bin", "fill").distinct()
        row = bins.agg(F.count("*").alias("bins"), F.coalesce(F.sum(loose.cast("long")), F.lit(0)).alias("loose")).first()
        now = used + row["bins"]
        if now <= goal or now >= before or row["loose"] < 2 or parts == 1:
            done.append(packed)
            break
        before = now
        done.append(packed.where(~loose))
        used += row["bins"] - row["loose"]
        open_ = packed.where(loose)
        left = open_.count()
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    number = F.shiftleft(F.col("turn").cast("long"), 60) + F.shiftleft(F.col("part"), 20) + F.col("bin")
    return out.select(
        "doc_id", "piece", "start", "length", "ids_crc32", number.alias("sequence_id"), "offset", F.col("fill").alias("sequence_length"),
        F.col("bins").alias("partition_bins"), F.col("bound").alias("partition_bound"),
    )
