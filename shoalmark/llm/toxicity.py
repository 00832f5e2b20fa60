"""Toxicity scores from bags of subwords.

A word is the mean of the vectors of its character n-grams (3 to 5, with word ends marked) and of the word itself;
a passage of at most ``WINDOW`` words is the mean of its words; a softmax layer turns that mean into class probabilities.
Vectors and layer are trained together in numpy by Adagrad. A document is as toxic as its most toxic passage, so a
few words in a long text count as much as in a short one: in training, a toxic document teaches through its
highest passage and a clean one through its highest four. A misspelt word shares most n-grams with
the word it comes from, and with them its score.

The model is trained on a bounded sample (``PER_CLASS`` texts of each class, ``LONGEST`` characters at most, chosen
by a hash of the key). Scoring reads every whole text. As the layer is linear, an n-gram adds one number to the
score, so tasks receive one float per bucket (``BUCKETS`` floats, 1 MB, whatever the data).

Rows: a null or empty text, or one without words, has the bias of the layer alone as its score. Labels other than
0 and 1, null keys and keys with contradicting labels teach nothing; with one class or none labelled every
score is the share of toxic labels seen (0 without any). Repeated rows are scored alike. Existing columns named
score and predicted are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import DoubleType

from .common import fold, labelled_sample, read
from .registry import query
from .text import subword_ids, words_of

BUCKETS = 1 << 18
DIMENSIONS = 8
#: Words of a passage. Chosen, with MIN_TEXTS, on an inner fold of training rows of the sf0.1 tables (crc32 mod 5 = 1).
WINDOW = 2
DECAY = 0.02
#: An n-gram in fewer training texts has no vector: it could only remember these texts.
MIN_TEXTS = 5
PER_CLASS = 3_000
LONGEST = 200_000
#: A task forgets its words' scores beyond this many.
CACHED_WORDS = 500_000


def _mean(values: np.ndarray, starts: np.ndarray, total: int) -> np.ndarray:
    """Mean of each run of rows; no run is empty."""
    lengths = np.diff(np.append(starts, total))
    summed = np.add.reduceat(values, starts, axis=0)
    return summed / (lengths[:, None] if values.ndim == 2 else lengths)


def passages(n: int) -> np.ndarray:
    """Starts of the passages of a text of n words: of even length, none above WINDOW words."""
    k = -(-n // WINDOW)
    return np.arange(k) * n // k


@dataclass
class SubwordModel:
    """Score of each bucket (the difference of the two classes' logits) and the bias."""

    bucket: np.ndarray
    bias: float

    def words(self, words: list[str]) -> np.ndarray:
        ids, starts = subword_ids(words, len(self.bucket))
        return _mean(self.bucket[ids], starts, len(ids))


def _all_subwords(words: list[str], step: int = 10_000) -> tuple[np.ndarray, np.ndarray]:
    """``subword_ids`` of many words, in steps that keep the driver's memory low."""
    ids, starts, at = [], [], 0
    for i in range(0, len(words), step):
        own, begin = subword_ids(words[i:i + step], BUCKETS)
        ids.append(own.astype(np.int32))
        starts.append(begin + at)
        at += len(own)
    return np.concatenate(ids), np.concatenate(starts)


def _in_texts(seen: list[np.ndarray], grams: np.ndarray, starts: np.ndarray, counts: np.ndarray, n: int) -> np.ndarray:
    """In how many texts each n-gram occurs; ``seen`` has the words of each text."""
    found = np.zeros(n, np.int64)
    for words in seen:
        own = np.unique(words)
        size = counts[own]
        at = np.repeat(starts[own] - np.append(0, np.cumsum(size)[:-1]), size) + np.arange(size.sum())
        found[np.unique(grams[at])] += 1
    return found


def train(texts: list[str], labels: list[int], epochs: int = 20, rate: float = 0.3, seed: int = 7) -> SubwordModel:
    """Fit vectors and softmax layer together on labelled texts."""
    y = np.asarray(labels, np.int64)
    if len(set(labels)) < 2:
        share = min(max(float(y.mean()) if len(y) else 0.0, 1e-9), 1 - 1e-9)
        return SubwordModel(np.zeros(BUCKETS, np.float32), float(np.log(share / (1 - share))))
    rng = np.random.default_rng(seed)
    number: dict[str, int] = {}
    seen, window_starts, window_doc, at = [], [], [], 0
    for d, text in enumerate(texts):
        ids = [number.setdefault(w, len(number)) for w in words_of(text)]
        if not ids:
            continue
        own = passages(len(ids))
        window_starts.append(own + at)
        window_doc.append(np.full(len(own), d, np.int32))
        seen.append(np.array(ids, np.int32))
        at += len(ids)
    if not seen:
        return train([], [])
    tokens, starts, doc = np.concatenate(seen), np.concatenate(window_starts), np.concatenate(window_doc)
    ends = np.append(starts[1:], len(tokens))
    grams, gram_starts = _all_subwords(list(number))
    known, grams = np.unique(grams, return_inverse=True)  # only buckets that occur are trained
    gram_counts = np.diff(np.append(gram_starts, len(grams)))
    common = _in_texts(seen, grams, gram_starts, gram_counts, len(known)) >= MIN_TEXTS

    vectors = (rng.standard_normal((len(known), DIMENSIONS)) * 0.02).astype(np.float32) * common[:, None]
    layer = (rng.standard_normal((DIMENSIONS, 2)) * 0.5).astype(np.float32)
    bias = np.zeros(2, np.float32)
    g_vectors = np.full(len(known), 1e-6, np.float32)  # one Adagrad cell per vector
    g_layer, g_bias = np.full_like(layer, 1e-6), np.full(2, 1e-6, np.float32)
    share = np.bincount(y, minlength=2) / len(y)

    for epoch in range(epochs):
        # the scores of all passages under the present model choose the passages that teach
        flat = vectors @ (layer[:, 1] - layer[:, 0])
        word_score = _mean(flat[grams], gram_starts, len(grams))
        window_score = _mean(word_score[tokens], starts, len(tokens))
        order = np.lexsort((-window_score, doc))
        rank = np.arange(len(order)) - np.searchsorted(doc[order], doc[order])
        most = np.where(y[doc[order]] == 1, 1 if epoch else 8, 4)
        chosen = rng.permutation(order[rank < most])
        step, pace = max(64, len(chosen) // 12), rate * (1 - epoch / epochs)
        for i in range(0, len(chosen), step):
            part = np.sort(chosen[i:i + step])
            lengths = ends[part] - starts[part]
            begin = np.append(0, np.cumsum(lengths)[:-1])
            own = np.arange(lengths.sum()) - np.repeat(begin - starts[part], lengths)
            distinct, where = np.unique(tokens[own], return_inverse=True)
            n_grams = gram_counts[distinct]
            g_begin = np.append(0, np.cumsum(n_grams)[:-1])
            used = grams[np.arange(n_grams.sum()) - np.repeat(g_begin - gram_starts[distinct], n_grams)]
            word_vec = _mean(vectors[used], g_begin, len(used))
            bag = _mean(word_vec[where], begin, len(where))
            logits = bag @ layer + bias
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            target = y[doc[part]]
            error = p
            error[np.arange(len(part)), target] -= 1
            error *= (0.5 / share[target])[:, None]
            d_bag = (error @ layer.T) / lengths[:, None]
            d_vectors = np.empty_like(vectors)
            for k in range(DIMENSIONS):
                d_word = np.bincount(where, np.repeat(d_bag[:, k], lengths), len(distinct)) / n_grams
                d_vectors[:, k] = np.bincount(used, np.repeat(d_word, n_grams), len(known))
            d_vectors *= common[:, None]
            g_vectors += (d_vectors ** 2).mean(axis=1)
            vectors -= pace * (d_vectors / np.sqrt(g_vectors)[:, None] + DECAY * vectors)
            d_layer, d_bias = bag.T @ error / len(part), error.mean(axis=0)
            g_layer += d_layer ** 2
            layer -= pace * 0.3 * d_layer / np.sqrt(g_layer)
            g_bias += d_bias ** 2
            bias -= pace * d_bias / np.sqrt(g_bias)
    bucket = np.zeros(BUCKETS, np.float32)
    bucket[known] = vectors @ (layer[:, 1] - layer[:, 0])
    return SubwordModel(bucket, float(bias[1] - bias[0]))


class Scorer:
    """Scores texts with a table of word scores that is filled on demand."""

    def __init__(self, model: SubwordModel):
        self.model, self.table = model, {}

    def score(self, texts: list[str | None]) -> np.ndarray:
        out = np.zeros(len(texts))
        for i, text in enumerate(texts):
            words = words_of(text)
            top = 0.0
            if words:
                new = list({w for w in words if w not in self.table})
                if new:
                    if len(self.table) > CACHED_WORDS:
                        self.table, new = {}, list(set(words))
                    self.table.update(zip(new, self.model.words(new).tolist()))
                values = np.fromiter(map(self.table.__getitem__, words), np.float64, len(words))
                top = float(_mean(values, passages(len(values)), len(values)).max())
            out[i] = 1 / (1 + np.exp(-np.clip(top + self.model.bias, -500, 500)))
        return out


def score_toxicity(docs: DataFrame, model: SubwordModel, text: str = "text") -> DataFrame:
    """Adds score and predicted to every row."""
    shared = docs.sparkSession.sparkContext.broadcast((model.bucket, model.bias))

    @F.pandas_udf(DoubleType())
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(SubwordModel(*shared.value))
        for batch in batches:
            yield pd.Series(scorer.score(batch.tolist()))

    return (docs.withColumn("score", score(F.col(text)))
            .withColumn("predicted", (F.col("score") >= 0.5).cast("int")))


def fit_toxicity(docs: DataFrame, labels: DataFrame, where: Column, per_class: int = PER_CLASS) -> SubwordModel:
    rows = [(r.doc_id, r.text, r.label) for r in labelled_sample(docs, labels, "toxic", per_class, LONGEST, where).collect()]
    rows.sort()
    texts, known = [r[1] for r in rows], [r[2] for r in rows]
    del rows
    return train(texts, known)


@query("op2_toxicity")
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    model = fit_toxicity(docs, labels, fold("doc_id", 5) != 0)
    return (score_toxicity(docs.select("doc_id", "text"), model)
            .select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", "predicted"))
