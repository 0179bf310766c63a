"""Language identification by unigram piece models: a text's likelihood summed over all its segmentations."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.llm.common import materialise, slices, texts_of

TOKENIZER = "piece_bpe_32k.model"
#: Longest piece used, in characters; longer words are cut into parts of PART characters first.
MAX_PIECE, PART = 10, 48
#: The models are fitted on at most this many documents, those with the smallest hash of their id, and on up to
#: RARE_FIT_DOCS more of each language that has fewer than that among them, so that every language has a model.
MAX_FIT_DOCS, RARE_FIT_DOCS = 4000, 64
#: Rounds of expectation-maximisation, pseudo-count of every piece, probability of a character outside the vocabulary.
ROUNDS, PSEUDO_COUNT, UNKNOWN = 3, 0.05, 1e-7
#: Scored words kept per worker; beyond it the table starts anew.
WORD_MEMORY = 700_000
UNDETERMINED = "und"
# Probabilities are scaled by this factor per character, so that products over a part stay within doubles.
_SCALE = 30.0
_WORD = re.compile(r"[^\W\d_]+")


def vocabulary(path: str | None = None) -> dict[str, int]:
    """Lower-case pieces of at most MAX_PIECE characters of the public vocabulary; `▁` starts a word."""
    import public_tokenizers
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path or public_tokenizers.path(TOKENIZER))
    names = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    kept = sorted({n.lower() for n in names if len(n.lower()) <= MAX_PIECE and n.strip("▁").isalpha() or n == "▁"})
    return {n: i for i, n in enumerate(kept)}


def words_of(text: str) -> list[str]:
    """Runs of letters, lower-cased, marked at the front, and cut into parts of PART characters."""
    found = []
    for word in _WORD.findall(text.lower()):
        if not word.isalpha():
            word = "".join(c for c in word if c.isalpha())
        if len(word) < PART:
            if word:
                found.append("▁" + word)
        else:
            found += [("▁" if at == 0 else "") + word[at: at + PART] for at in range(0, len(word), PART)]
    return found


def lattice(words: list[str], pieces: dict[str, int]) -> np.ndarray:
    """Piece ids of words of one length: [word, start, piece length - 1]. Ids past the vocabulary: no such piece, and a
    single unknown character."""
    none, unknown, n = len(pieces), len(pieces) + 1, len(words[0])
    width = min(MAX_PIECE, n)
    get, flat = pieces.get, []
    for w in words:
        for i in range(n):
            flat.append(get(w[i], unknown))
            flat += [get(w[i: j], none) for j in range(i + 2, min(i + width, n) + 1)]
            flat += [none] * (width - min(width, n - i))
    return np.array(flat, np.int32).reshape(len(words), n, width)


def forward(ids: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Scaled forward sums [place, word, language]: mass of all segmentations of the first characters."""
    count, n, width = ids.shape
    alpha = np.zeros((n + 1, count, table.shape[1]))
    alpha[0] = 1.0
    for i in range(n):
        for k in range(1, min(width, n - i) + 1):
            alpha[i + k] += alpha[i] * (table[ids[:, i, k - 1]] * _SCALE**k)
    return alpha


def backward(ids: np.ndarray, table: np.ndarray) -> np.ndarray:
    count, n, width = ids.shape
    beta = np.zeros((n + 1, count, table.shape[1]))
    beta[n] = 1.0
    for i in range(n - 1, -1, -1):
        for k in range(1, min(width, n - i) + 1):
            beta[i] += beta[i + k] * (table[ids[:, i, k - 1]] * _SCALE**k)
    return beta


@dataclass
class Models:
    """`table[piece, language]`: probabilities, with two more rows: no such piece (0) and an unknown character."""

    languages: list[str]
    pieces: dict[str, int]
    table: np.ndarray
    prior: np.ndarray

    def word_scores(self, words: list[str]) -> np.ndarray:
        """Log-likelihood of each word in each language, over all segmentations."""
        out = np.zeros((len(words), len(self.languages)))
        by_length: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            by_length.setdefault(len(w), []).append(i)
        for n, members in by_length.items():
            for at in range(0, len(members), 2048):
                part = members[at: at + 2048]
                mass = forward(lattice([words[i] for i in part], self.pieces), self.table)[n]
                out[part] = np.log(mass) - n * np.log(_SCALE)
        return out


class Scorer:
    """Scores texts, with a bounded table of words already scored."""

    def __init__(self, models: Models):
        self.models, self.places = models, {}
        self.scores = np.zeros((0, len(models.languages)))

    def score(self, texts: list[str]) -> list[tuple[str, float]]:
        split = [words_of(t) for t in texts]
        missing = list({w for words in split for w in words} - self.places.keys())
        if len(self.places) + len(missing) > WORD_MEMORY:
            self.places, self.scores = {}, self.scores[:0]
            missing = list({w for words in split for w in words})
        if missing:
            base = len(self.places)
            self.places.update((w, base + i) for i, w in enumerate(missing))
            self.scores = np.concatenate([self.scores, self.models.word_scores(missing)])
        out = []
        for words in split:
            if not words or not self.models.languages:
                out.append((UNDETERMINED, 0.0))
                continue
            total = self.scores[np.fromiter(map(self.places.__getitem__, words), np.int64, len(words))].sum(axis=0) + self.models.prior
            share = np.exp(total - total.max())
            best = int(total.argmax())
            out.append((self.models.languages[best], float(share[best] / share.sum())))
        return out


def _expected(words: DataFrame, models: Models) -> np.ndarray:
    """Expected piece counts per language under the models; one row per piece and language reaches the driver, bounded
    by vocabulary and languages."""
    names, pieces, table = models.languages, models.pieces, models.table

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = np.zeros((len(pieces) + 2, len(names)))
        for part in parts:
            part = part.assign(n=part.word.str.len())
            for (lang, n), rows in part.groupby(["lang", "n"]):
                own = names.index(lang)
                column = table[:, [own]]
                for at in range(0, len(rows), 2048):
                    piece_ids = lattice(rows.word.iloc[at: at + 2048].tolist(), pieces)
                    alpha, beta = forward(piece_ids, column)[..., 0], backward(piece_ids, column)[..., 0]
                    weight = rows["count"].to_numpy(float)[at: at + 2048] / alpha[n]
                    for i in range(n):
                        for k in range(1, min(piece_ids.shape[2], n - i) + 1):
                            use = piece_ids[:, i, k - 1]
                            share = alpha[i] * column[use, 0] * _SCALE**k * beta[i + k] * weight
                            counts[:, own] += np.bincount(use, share, minlength=len(counts))
        piece, lang = np.nonzero(counts)
        yield pd.DataFrame({"piece": piece, "lang": lang, "n": counts[piece, lang]})

    total = np.zeros((len(pieces) + 2, len(names)))
    for r in words.mapInPandas(run, "piece long, lang long, n double").groupBy("piece", "lang").agg(F.sum("n").alias("n")).collect():
        total[r.piece, r.lang] = r.n
    return total


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_docs: int = MAX_FIT_DOCS, path: str | None = None) -> Models:
    """Piece probabilities per language by expectation-maximisation over the sample's word counts. Rows with a null
    id, text or language are left out; without any, the models know no language and every text is undetermined."""
    pieces = vocabulary(path)
    rows = docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull() & F.col(id_col).isNotNull())
    rows = rows.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    picked = materialise(rows.select("_id", "lang").orderBy(F.xxhash64("_id"), "_id").limit(max_docs))
    common = picked.groupBy("lang").count().where(F.col("count") >= RARE_FIT_DOCS).select("lang")
    # One document of each of RARE_FIT_DOCS hash slices, an aggregate that combines before the shuffle.
    rare = rows.join(F.broadcast(common), "lang", "left_anti").groupBy("lang", F.pmod(F.xxhash64("_id", F.lit(1)), F.lit(RARE_FIT_DOCS)).alias("slice"))
    rare = rare.agg(F.min(F.struct(F.xxhash64("_id").alias("hash"), "_id")).alias("first")).select("first._id")
    rows = rows.join(F.broadcast(picked.select("_id").unionByName(rare).distinct()), "_id")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found: Counter[tuple[str, str]] = Counter()
            for lang, text in zip(batch.column("lang").to_pylist(), texts_of(batch)):
                found.update((lang, w) for w in words_of(text))
            columns = [pa.array([k[0] for k in found], pa.string()), pa.array([k[1] for k in found], pa.string()), pa.array(found.values(), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "word", "count"])

    words = rows.select("text", "lang").mapInArrow(count, "lang string, word string, count long")
    words = words.groupBy("lang", "word").agg(F.sum("count").alias("count")).cache()
    totals = {r.lang: r.n for r in words.groupBy("lang").agg(F.sum("count").alias("n")).collect()}
    languages = sorted(totals)
    shape = (len(pieces) + 2, len(languages))
    models = Models(languages, pieces, np.full(shape, 1 / shape[0]), np.log(np.array([1.0 for _ in languages])))
    models.table[-2], models.table[-1] = 0.0, UNKNOWN
    for _ in range(ROUNDS if languages else 0):
        counts = _expected(words, models)[:-2] + PSEUDO_COUNT
        models.table[:-2] = counts / counts.sum(axis=0)
    words.unpersist()
    return models


def predict(docs: DataFrame, models: Models, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`(doc_id, lang_pred, score)` for every row: the likeliest language and its share of the likelihood. `und` and 0
    for texts that are null or without a letter. Repeated rows come back as often; extra columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(models)
        for batch in slices(batches, 768):
            found = scorer.score(texts_of(batch))
            columns = [batch.column("doc_id"), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double")
