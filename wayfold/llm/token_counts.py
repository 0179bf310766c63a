"""Edit-aware token counts: segment trees over pre-token runs; only regions touched by edits are encoded again."""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.llm.common import slices, texts_of

TOKENIZER = "byte_bpe_50k.tiktoken"
#: Characters of a leaf, about; a leaf that edits have grown to GROWN times as much is cut anew.
LEAF, GROWN = 512, 8
# Between a letter and a blank followed by a letter, the pattern always ends one pre-token and starts the next,
# whatever stands around: nothing before is looked at, and the letter before cannot go on.
_CUT = re.compile(r"(?<=[^\W\d_])(?= [^\W\d_])")
Edit = tuple[int, int, str]


@cache
def encoding(path: str | None = None):
    """The public vocabulary, one per worker process."""
    import public_tokenizers
    import tiktoken

    with open(path or public_tokenizers.path(TOKENIZER), "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("counts", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def count(text: str, path: str | None = None) -> int:
    return len(encoding(path).encode_ordinary(text))


def cut_leaves(text: str, leaf: int = LEAF) -> list[str]:
    """Runs of whole pre-tokens of about `leaf` characters; a text without a cut place is one leaf."""
    out, at = [], 0
    while len(text) - at > leaf:
        found = _CUT.search(text, at + leaf)
        if found is None:
            break
        out.append(text[at: found.start()])
        at = found.start()
    return [*out, text[at:]]


@dataclass
class Tree:
    """Leaves in order and two binary trees of sums over them, characters and tokens, in arrays (root at 1)."""

    leaves: list[str]
    tokens: list[int]
    path: str | None = None
    encoded: int = 0
    size: int = field(init=False)
    chars_sum: list[int] = field(init=False)
    tokens_sum: list[int] = field(init=False)

    def __post_init__(self):
        self.size = 1 << max(0, len(self.leaves) - 1).bit_length()
        pad = [0] * (self.size - len(self.leaves))
        self.chars_sum = [0] * self.size + [len(x) for x in self.leaves] + pad
        self.tokens_sum = [0] * self.size + list(self.tokens) + pad
        for i in range(self.size - 1, 0, -1):
            self.chars_sum[i] = self.chars_sum[2 * i] + self.chars_sum[2 * i + 1]
            self.tokens_sum[i] = self.tokens_sum[2 * i] + self.tokens_sum[2 * i + 1]

    @classmethod
    def of(cls, text: str, path: str | None = None) -> Tree:
        leaves = cut_leaves(text)
        return cls(leaves, [count(x, path) for x in leaves], path)

    @classmethod
    def kept(cls, text: str, chars: list[int], tokens: list[int], path: str | None = None) -> Tree:
        """From a text and the leaf sizes and counts kept for it; nothing is encoded."""
        leaves, at = [], 0
        for n in chars:
            leaves.append(text[at: at + n])
            at += n
        return cls(leaves, tokens, path)

    @property
    def total(self) -> int:
        return self.tokens_sum[1]

    def text(self) -> str:
        return "".join(self.leaves)

    def find(self, at: int) -> tuple[int, int]:
        """Leaf that holds character `at` (the last one for the end), and where it starts."""
        if at >= self.chars_sum[1]:
            last = max((i for i, x in enumerate(self.leaves) if x), default=0)
            return last, self.chars_sum[1] - len(self.leaves[last])
        node, start = 1, 0
        while node < self.size:
            node *= 2
            if at - start >= self.chars_sum[node]:
                start += self.chars_sum[node]
                node += 1
        return node - self.size, start

    def _set(self, i: int, text: str, tokens: int) -> None:
        self.leaves[i] = text
        node, chars, count_ = self.size + i, len(text) - self.chars_sum[self.size + i], tokens - self.tokens_sum[self.size + i]
        while node:
            self.chars_sum[node] += chars
            self.tokens_sum[node] += count_
            node //= 2

    def edit(self, start: int, stop: int, text: str) -> None:
        """Replaces characters start..stop. The leaves touched, and the next one where the edit comes within two characters of
        a cut, become one region: its outer cuts keep their letter, blank and letter, so they stay pre-token ends."""
        start = max(0, min(start, self.chars_sum[1]))
        stop = max(start, min(stop, self.chars_sum[1]))
        first, begin = self.find(max(0, start - 2))
        last, last_begin = self.find(min(stop + 1, self.chars_sum[1]))
        old = "".join(self.leaves[first: last + 1])
        new = old[: start - begin] + text + old[stop - begin:]
        self.encoded += len(new)
        if len(new) > GROWN * LEAF:
            middle = cut_leaves(new)
            counts = self.tokens_sum[self.size: self.size + len(self.leaves)]
            encoded = [count(x, self.path) for x in middle]
            keep = self.encoded
            self.__init__([*self.leaves[:first], *middle, *self.leaves[last + 1:]], [*counts[:first], *encoded, *counts[last + 1:]], self.path)
            self.encoded = keep
            return
        self._set(first, new, count(new, self.path))
        for i in range(first + 1, last + 1):
            self._set(i, "", 0)


def build(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """`(doc_id, text, leaf_chars array<int>, leaf_tokens array<int>, n_tokens)`: the kept trees. Null is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = texts_of(batch)
            trees = [Tree.of(t, path) for t in texts]
            ints = pa.list_(pa.int32())
            columns = [
                batch.column("doc_id"), pa.array(texts, pa.string()), pa.array([[len(x) for x in t.leaves] for t in trees], ints),
                pa.array([t.tokens for t in trees], ints), pa.array([t.total for t in trees], pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text", "leaf_chars", "leaf_tokens", "n_tokens"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, text string, leaf_chars array<int>, leaf_tokens array<int>, n_tokens long")


def update(trees: DataFrame, edits_of: Callable[[str], list[Edit]] | None = None, path: str | None = None) -> DataFrame:
    """Kept trees after edits: the columns of `build` for the new texts, with `n_tokens_before`, `n_edits`, `n_encoded`
    (characters that were encoded again).

    Edits are (start, stop, replacement) in characters of the text as it stands when each is applied, in order. They come
    from a column `edits array<struct<start:int, stop:int, text:string>>` (null: none), joined by the caller, or from
    `edits_of(text)`. Places outside the text are moved to its ends; a null replacement is empty. Repeated rows stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out, before, edited, encoded = [], [], [], []
            given = batch.column("edits").to_pylist() if edits_of is None else [None] * batch.num_rows
            kept = zip(texts_of(batch), batch.column("leaf_chars").to_pylist(), batch.column("leaf_tokens").to_pylist(), given)
            for text, chars, tokens, listed in kept:
                tree = Tree.kept(text, chars, tokens, path)
                before.append(tree.total)
                edits = edits_of(text) if edits_of else [(e["start"] or 0, e["stop"] or 0, e["text"] or "") for e in listed or [] if e]
                for edit in edits:
                    tree.edit(*edit)
                out.append(tree)
                edited.append(len(edits))
                encoded.append(tree.encoded)
            ints, long = pa.list_(pa.int32()), pa.int64()
            columns = [
                batch.column("doc_id"), pa.array([t.text() for t in out], pa.string()), pa.array([[len(x) for x in t.leaves] for t in out], ints),
                pa.array([t.tokens_sum[t.size: t.size + len(t.leaves)] for t in out], ints), pa.array([t.total for t in out], long),
                pa.array(before, long), pa.array(edited, long), pa.array(encoded, long),
            ]
            names = ["doc_id", "text", "leaf_chars", "leaf_tokens", "n_tokens", "n_tokens_before", "n_edits", "n_encoded"]
            yield pa.RecordBatch.from_arrays(columns, names)

    names = ["doc_id", "text", "leaf_chars", "leaf_tokens"] + ([] if edits_of else ["edits"])
    schema = "doc_id long, text string, leaf_chars array<int>, leaf_tokens array<int>, n_tokens long, n_tokens_before long, n_edits long, n_encoded long"
    return trees.select(*names).mapInArrow(run, schema)


_PERSONAL = re.compile(r"[\w.+-]+@[\w-]+\.[\w.]+|\b\d{1,3}(?:\.\d{1,3}){3}\b|\+?\d[\d ()-]{7,}\d")


def redactions(text: str) -> list[Edit]:
    """Edits that replace mail addresses, IP addresses and telephone numbers by a tag; last first, so places stay true."""
    return [(m.start(), m.end(), "<redacted>") for m in reversed(list(_PERSONAL.finditer(text)))]
