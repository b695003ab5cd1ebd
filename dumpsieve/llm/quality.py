"""Quality of documents by a regularised quadratic discriminant over statistics of the text."""

from __future__ import annotations

import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dumpsieve.llm.shared import bloom_bits, give_back, member_bitmap, passes_bloom, remainder, stored, text_chunks, words_of

#: Punctuation of plain prose; any other sign that is no letter or digit counts as a symbol.
_PROSE = set(".,;:'\"?()-–—’‘“”¿¡«»…")
_UPPER, _LETTER, _SYMBOL, _SHOUT, _CHARS, _SHOWN, _BARE = range(7)
_WORD_CHARS = 20  # of a word that count for its length: a key or an address is no long word
FEATURES = (
    "upper", "symbol", "shout", "bare", "repeat", "distinct", "distinct pairs", "word length", "length"
)


def _word_traits(word: str) -> tuple[int, ...]:
    if word.isascii() and word.isalpha():
        low = sum(c in string.ascii_lowercase for c in word)
        return len(word) - low, len(word), 0, 0, len(word), min(len(word), _WORD_CHARS), 0
    upper = sum(c.isupper() for c in word)
    letters = sum(c.isalpha() for c in word)
    digits = sum(c.isdigit() for c in word)
    symbols = sum(not (c.isalnum() or c in _PROSE or c == "!") for c in word)
    return upper, letters, symbols, word.count("!"), len(word), min(len(word), _WORD_CHARS), int(letters + digits == 0)


def _distinct_per_row(rows: np.ndarray, values: np.ndarray, n_rows: int) -> np.ndarray:
    order = np.lexsort((values, rows))
    rows, values = rows[order], values[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (values[1:] != values[:-1])
    return np.bincount(rows[new], minlength=n_rows)


def _share(part: np.ndarray, whole: np.ndarray, usual: float, weight: float) -> np.ndarray:
    """Log odds of a share, drawn to what is usual where there is little to count."""
    share = (part + usual * weight) / (whole + weight)
    share = np.clip(share, 1e-4, 1 - 1e-4)
    return np.log(share / (1 - share))


def features(texts: pa.Array) -> np.ndarray:
    """One row of statistics per text; null and empty texts have those of no words at all."""
    n = len(texts)
    rows, codes, dictionary = words_of(texts)
    traits = np.array([_word_traits(w) for w in dictionary], np.float64).reshape(-1, 7)
    sums = np.stack([np.bincount(rows, weights=traits[codes, k], minlength=n) for k in range(7)], axis=1)
    words = np.bincount(rows, minlength=n)
    follows = rows[1:] == rows[:-1]
    same = np.bincount(rows[1:][follows & (codes[1:] == codes[:-1])], minlength=n)
    distinct = _distinct_per_row(rows, codes, n)
    first, pair = rows[1:][follows], (codes[:-1] * max(len(dictionary), 1) + codes[1:])[follows]
    pairs = _distinct_per_row(first, pair, n)
    size = np.log1p(words)
    return np.stack([
        _share(sums[:, _UPPER], sums[:, _LETTER], 0.04, 20),
        _share(sums[:, _SYMBOL], sums[:, _CHARS], 0.002, 200),
        _share(sums[:, _SHOUT], words, 0.002, 10),
        _share(sums[:, _BARE], words, 0.005, 20),
        _share(same, words, 0.01, 10),
        np.log((words + 5) / (distinct + 5)),
        np.log((words + 5) / (pairs + 5)),
        np.log((sums[:, _SHOWN] + 100) / (words + 20)),
        size,
    ], axis=1)


def _featurizer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in text_chunks(batches):
        found = features(part.column("text"))
        offsets = np.arange(part.num_rows + 1, dtype=np.int32) * len(FEATURES)
        yield pa.RecordBatch.from_arrays(
            [part.column("doc_id"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(found.ravel()))],
            names=["doc_id", "features"],
        )


def document_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_featurizer, "doc_id long, features array<double>")


_SEEDS = (41, 42)


@dataclass(frozen=True)
class QualityModel:
    """Per class its mean, the inverse of its Cholesky factor and the constant of its log density."""

    means: np.ndarray
    whiten: np.ndarray
    constants: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1 for rows of statistics."""
        density = []
        for k in (0, 1):
            z = (x - self.means[k]) @ self.whiten[k].T
            density.append(self.constants[k] - 0.5 * (z * z).sum(1))
        return 1 / (1 + np.exp(-np.clip(density[1] - density[0], -30, 30)))


def fit_quality(
    known: DataFrame, labels: DataFrame, train: Column, pooled: float = 0.5, ridge: float = 0.1
) -> QualityModel:
    """Fit on ``known`` (doc_id, features) by ``labels`` (doc_id, quality), where ``train`` holds.

    All labelled rows count; an id with several labels has the least of them. Only sums over
    features come to the driver: n, x and x xT per class. The covariance of a class is drawn to
    the pooled one by ``pooled`` and to a multiple of the identity by ``ridge``, in units of the pooled deviation.
    """
    d = len(FEATURES)
    marked = labels.filter(F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    rows = known.filter(train).join(marked, "doc_id")
    one = F.array_insert("features", 1, F.lit(1.0))
    products = F.flatten(F.transform(one, lambda a: F.transform(one, lambda b: a * b)))
    sums = rows.select("quality", F.posexplode(products).alias("at", "value"))
    sums = sums.groupBy("quality", "at").agg(F.sum("value").alias("total")).collect()
    moments = np.zeros((2, (d + 1) ** 2))
    for row in sums:
        moments[int(row["quality"]), row["at"]] = row["total"]
    moments = moments.reshape(2, d + 1, d + 1)
    n = moments[:, 0, 0]
    means = moments[:, 0, 1:] / np.maximum(n, 1)[:, None]
    scatter = np.stack([moments[k, 1:, 1:] - n[k] * np.outer(means[k], means[k]) for k in (0, 1)])
    common = scatter.sum(0) / max(n.sum() - 2, 1)
    unit = np.sqrt(np.maximum(np.diag(common), 1e-4))
    whiten, constants = [], []
    for k in (0, 1):
        own = scatter[k] / max(n[k] - 1, 1) if n[k] > d else common
        own = ((1 - pooled) * own + pooled * common) / np.outer(unit, unit)
        own = (1 - ridge) * own + ridge * max(np.trace(own) / d, 1e-2) * np.eye(d)
        factor = np.linalg.cholesky(own)
        whiten.append(np.linalg.inv(factor) / unit)
        prior = (n[k] + 1) / (n.sum() + 2)
        constants.append(np.log(prior) - np.log(np.diag(factor)).sum())
    if (n == 0).any():  # nothing to tell apart: what is known of one class holds for both
        means = np.repeat(means[[int(n.argmax())]], 2, axis=0)
    return QualityModel(means, np.stack(whiten), np.array(constants))


def _scorer(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column("features").flatten().to_numpy(zero_copy_only=False)
            score = model.value.scores(flat.reshape(-1, len(FEATURES)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score)], names=["doc_id", "score"])

    return run


def score_quality(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", accept: float = 0.3
) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted.

    Rows whose crc32(doc_id as text) mod 5 is 0 are held out, the others' labels train the model.
    Null and empty texts are scored as texts without words; rows with a null id are scored and never
    train. Without labels of both classes the score is the share of the known class. Repeated rows give
    repeated results; an empty table gives an empty result; other columns are not read.
    """
    known = stored(document_features(docs, id_col, text_col), "quality")
    held_out = F.coalesce(remainder("doc_id", 5) == 0, F.lit(False))
    model = docs.sparkSession.sparkContext.broadcast(fit_quality(known, labels, ~held_out))
    scored = known.mapInArrow(_scorer(model), "doc_id long, score double")
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= accept).cast("int").alias("predicted"))


def _judge(model, text_col: str, accept: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_chunks(batches, text_col):
            good = model.value.scores(features(part.column(text_col))) >= accept
            yield part.filter(pa.array(good))
        give_back()

    return run


def keep_good(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", accept: float = 0.3
) -> DataFrame:
    """The rows of ``docs`` that :func:`score_quality` does not reject, all columns; rules as there.

    For the fit only texts are looked at whose id may be labelled, by a bounded bitmap of the
    labels' ids. Each text then goes to a task of Python once, with its row, and comes back if it stays.
    """
    ids = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1)).select("doc_id")
    bits = bloom_bits(ids.count())
    bitmap = stored(member_bitmap(ids, F.col("doc_id").cast("long"), _SEEDS, bits), "bloom")
    named = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).filter("doc_id IS NOT NULL")
    maybe = passes_bloom(named, F.col("doc_id"), bitmap, _SEEDS, bits).filter("maybe").drop("maybe")
    known = stored(document_features(maybe), "quality")
    train = F.coalesce(remainder("doc_id", 5) != 0, F.lit(False))
    model = docs.sparkSession.sparkContext.broadcast(fit_quality(known, labels, train))
    return docs.mapInArrow(_judge(model, text_col, accept), docs.schema)
