"""Quality scores from a factorisation machine.

Features of a text: its words, hashed to ``WORD_BUCKETS`` and weighted by their share of the text; structure
statistics of the text (shares of upper case, digits, symbols, white space, marked-up words, repeated lines and
words, lengths of words and lines); and the size class of its declared length n_chars (of the text's own
length if that column is missing or null). The score is

    w0 + sum_i w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)

so all pairs of features interact through vectors of ``FACTORS`` numbers in time linear in the features. Trained by
Adagrad in numpy on a bounded sample (``PER_CLASS`` texts of each class, ``LONGEST`` characters at most, chosen by a
hash of the key); scoring reads every whole text and tasks receive the model (4 MB, whatever the data).

Rows: a null or empty text has no words and zero statistics and still gets a score. Labels other than 0 and 1,
null keys and keys with contradicting labels teach nothing; with one class or none labelled every score is the share
of good labels seen (1 without any: nothing says that a text is bad). Repeated rows are scored alike. Existing
columns named score and predicted are replaced.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import DoubleType

from .common import fold, labelled_sample, read
from .registry import query
from .text import subword_ids

WORD_BUCKETS = 1 << 16
FACTORS = 6
PER_CLASS = 4_000
LONGEST = 200_000
STATISTICS = 14
SIZES = 24
FEATURES = WORD_BUCKETS + STATISTICS + SIZES
CACHED_WORDS = 100_000
_LETTER, _UPPER, _DIGIT, _SPACE, _STOP, _MARK, _SYMBOL = range(7)


def character_classes() -> np.ndarray:
    """Character class of every code point of the basic plane; what lies beyond counts as a symbol."""
    out = np.full(1 << 16, _SYMBOL, np.uint8)
    for code in range(1 << 16):
        c = chr(code)
        if c.isdigit():
            out[code] = _DIGIT
        elif c.isalpha() or c == "_":
            out[code] = _UPPER if c.isupper() else _LETTER
        elif c.isspace():
            out[code] = _SPACE
        elif c in ".!?":
            out[code] = _STOP
        elif c in ",;:'\"()-":
            out[code] = _MARK
    return out


def statistics(text: str, words: list[str], distinct: int, classes: np.ndarray) -> list[float]:
    """Shares and mean lengths that describe how a text is built, about 0 to 1 each."""
    n, m = max(len(text), 1), max(len(words), 1)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = classes[np.minimum(codes, 0xFFFF)]
    count = np.bincount(kind, minlength=7)
    mark = kind >= _STOP
    after = np.append(kind[2:] == _SPACE, True) if len(kind) > 1 else np.zeros(0, bool)
    lines = [x for x in text.split("\n") if x.strip()]
    k = max(len(lines), 1)
    return [
        count[_UPPER] / n, count[_DIGIT] / n * 5, count[_SYMBOL] / n * 5, count[_STOP] / m,
        np.count_nonzero(mark[:-1] & mark[1:] & after) / m, text.count("|") / m,
        1 - distinct / m, 1 - len(set(lines)) / k, min(n / m / 20, 3.0), min(n / k / 500, 3.0),
        min(max(map(len, words), default=0) / 50, 3.0), min(m / 50, 1.0), text.count("!") / m,
        sum(1 for x in lines if x[-1] in ".!?\"'") / k,
    ]


def size_class(n: int) -> int:
    return min(max(int(n), 0).bit_length(), SIZES - 1)


class Features:
    """Features of texts, with a table of word buckets that is filled on demand."""

    def __init__(self) -> None:
        self.table: dict[str, int] = {}
        self.classes = character_classes()

    def _bucket(self, words: list[str]) -> None:
        ids, starts = subword_ids(words, WORD_BUCKETS, 9, 8)  # the whole word alone
        self.table.update(zip(words, ids[starts].tolist()))

    def of(self, texts: list[str | None], sizes: list[int | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Feature numbers, values and the start of each text's run; every text has features."""
        idx, val, starts, at = [], [], [], 0
        for text, size in zip(texts, sizes):
            text = text or ""
            words = text.split()
            counts = Counter(w.lower() for w in words)
            new = [w for w in counts if w not in self.table]
            if new:
                if len(self.table) > CACHED_WORDS:
                    self.table, new = {}, list(counts)
                self._bucket(new)
            m = len(counts)
            i = np.empty(m + STATISTICS + 1, np.int64)
            v = np.empty(m + STATISTICS + 1, np.float32)
            i[:m] = np.fromiter(map(self.table.__getitem__, counts), np.int64, m)
            v[:m] = np.sqrt(np.fromiter(counts.values(), np.float32, m) / max(len(words), 1))
            i[m:m + STATISTICS] = WORD_BUCKETS + np.arange(STATISTICS)
            v[m:m + STATISTICS] = statistics(text, words, m, self.classes)
            i[-1] = WORD_BUCKETS + STATISTICS + size_class(len(text) if size is None or size != size else size)
            v[-1] = 0.3
            idx.append(i)
            val.append(v)
            starts.append(at)
            at += len(i)
        if not idx:
            return np.zeros(0, np.int64), np.zeros(0, np.float32), np.zeros(0, np.int64)
        return np.concatenate(idx), np.concatenate(val), np.array(starts)


@dataclass
class FactorModel:
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def logits(self, idx: np.ndarray, val: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Linear part plus pairwise part by the sum-of-squares identity."""
        if not len(starts):
            return np.zeros(0)
        linear = np.add.reduceat(self.weights[idx] * val, starts)
        vx = self.factors[idx] * val[:, None]
        pairs = np.add.reduceat(vx, starts, axis=0) ** 2 - np.add.reduceat(vx ** 2, starts, axis=0)
        return self.bias + linear + 0.5 * pairs.sum(axis=1)


def train(texts: list[str], sizes: list[int | None], labels: list[int], epochs: int = 12, rate: float = 0.1,
          decay: float = 0.002, seed: int = 11) -> FactorModel:
    y = np.asarray(labels, np.float64)
    if len(set(labels)) < 2:
        share = min(max(float(y.mean()) if len(y) else 1.0, 1e-9), 1 - 1e-9)
        return FactorModel(float(np.log(share / (1 - share))), np.zeros(FEATURES, np.float32),
                           np.zeros((FEATURES, FACTORS), np.float32))
    rng = np.random.default_rng(seed)
    idx, val, starts = Features().of(texts, sizes)
    counts = np.diff(np.append(starts, len(idx)))
    known, idx = np.unique(idx, return_inverse=True)  # only features that occur are trained
    w, v = np.zeros(len(known)), rng.standard_normal((len(known), FACTORS)) * 0.02
    gw, gv, b, gb = np.full(len(known), 1e-4), np.full((len(known), FACTORS), 1e-4), 0.0, 1e-4
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    for epoch in range(epochs):
        pace = rate * (1 - epoch / epochs)
        order = rng.permutation(len(y))
        for i in range(0, len(y), 256):
            part = np.sort(order[i:i + 256])
            n = counts[part]
            begin = np.append(0, np.cumsum(n)[:-1])
            own = np.arange(n.sum()) - np.repeat(begin - starts[part], n)
            f, x = idx[own], val[own].astype(np.float64)
            vx = v[f] * x[:, None]
            sums = np.add.reduceat(vx, begin, axis=0)
            logit = (b + np.add.reduceat(w[f] * x, begin)
                     + 0.5 * (sums ** 2 - np.add.reduceat(vx ** 2, begin, axis=0)).sum(axis=1))
            error = (1 / (1 + np.exp(-np.clip(logit, -40, 40))) - y[part]) * weight[part] / len(part)
            each = np.repeat(error, n)
            dw = np.bincount(f, each * x, len(known)) + decay * w / len(known)
            gw += dw ** 2
            w -= pace * dw / np.sqrt(gw)
            for k in range(FACTORS):
                dv = np.bincount(f, each * x * (np.repeat(sums[:, k], n) - vx[:, k]), len(known))
                gv[:, k] += dv ** 2
                v[:, k] -= pace * (dv / np.sqrt(gv[:, k]) + decay * v[:, k])
            gb += error.sum() ** 2
            b -= pace * error.sum() / np.sqrt(gb)
    weights, factors = np.zeros(FEATURES, np.float32), np.zeros((FEATURES, FACTORS), np.float32)
    weights[known], factors[known] = w, v
    return FactorModel(float(b), weights, factors)


def score_quality(docs: DataFrame, model: FactorModel, text: str = "text") -> DataFrame:
    """Adds score and predicted to every row."""
    shared = docs.sparkSession.sparkContext.broadcast((model.bias, model.weights, model.factors))

    @F.pandas_udf(DoubleType())
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        features, fitted = Features(), FactorModel(*shared.value)
        for texts, sizes in batches:
            out = []
            for i in range(0, len(texts), 256):
                logit = fitted.logits(*features.of(texts[i:i + 256].tolist(), sizes[i:i + 256].tolist()))
                out.append(1 / (1 + np.exp(-np.clip(logit.astype(np.float64), -500, 500))))
            yield pd.Series(np.concatenate(out) if out else np.zeros(0))

    return (docs.withColumn("score", score(F.col(text), _size(docs, text)))
            .withColumn("predicted", (F.col("score") >= 0.5).cast("int")))


def _size(docs: DataFrame, text: str) -> Column:
    own = F.length(text)
    return (F.coalesce(F.col("n_chars"), own, F.lit(0)) if "n_chars" in docs.columns
            else F.coalesce(own, F.lit(0))).cast("double")


def fit_quality(docs: DataFrame, labels: DataFrame, where: Column, per_class: int = PER_CLASS) -> FactorModel:
    rows = labelled_sample(docs.withColumn("_size", _size(docs, "text")), labels, "quality", per_class, LONGEST, where,
                           keep=("_size",)).collect()
    rows.sort(key=lambda r: (r.doc_id, r.text, r["_size"]))
    return train([r.text for r in rows], [r["_size"] for r in rows], [r.label for r in rows])


@query("op7_quality")
def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    model = fit_quality(docs, labels, fold("doc_id", 3) != 1)
    return (score_quality(docs.select("doc_id", "text", "n_chars"), model)
            .select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score", "predicted"))
