"""Hard negatives by a secondary sort of packed pair scores.

Every anchor is scored against every row by an integer inner product. A pair travels as the packed key (anchor,
complement of the score, kind, id), so ascending keys list an anchor's rows by descending score, positives before
negatives of the same score, smaller ids first. Keys are dealt by anchor and sorted within their partition
(``repartition`` and ``sortWithinPartitions``, the DataFrame form of repartitionAndSortWithinPartitions), and one
streaming iterator reads them: a positive opens a window, later negatives enter every window that is open, has room
and still reaches down to their score. An anchor's rows are never held together; the state is its open windows.

Two passes keep the shuffle small without losing a pair. The first finds each anchor's positives: a task keeps the best
few rows of the anchor's own label that it has seen, because no other row of the task can be among the first few of
all. With the positives known, the bounds of every window are known, and in the second pass a task keeps the best
few negatives of each window, for the same reason. A hot label or a vector that a third of the rows share fills
these few places with its smallest ids and no more.

Anchors are read in blocks of ``BLOCK`` rows. A block is the only thing that passes through the driver and
is broadcast; each block scans the rows twice and shuffles at most (positives + positives * negatives) keys per anchor and
task, never a vector. The work is anchors times rows, in matrix products of bounded size.

Rows: a null id, label or vector, or a null or non-finite component: the row takes no part. Vectors are compared with
vectors of their own length only. Rows of one id are never partners of each other; rows of one id that score alike for
an anchor count once, and anchors that repeat in id, label and vector count once. Scores are exact; those outside 64 bits
become the nearest 64-bit number. Other columns are ignored, whatever their names. Empty tables, or no anchors, give
no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.ordering import with_row_id
from ..session import scratch_path, written
from .common import read
from .registry import query

#: Anchors of one pass: 4,096 vectors of 64 components are 2 MB.
BLOCK = 4096
#: Scores that a task holds at a time.
_CELLS = 2_000_000
_LOW, _HIGH = np.iinfo(np.int64).min, np.iinfo(np.int64).max
_KEYS = "no long, down long, kind int, id long"
_RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def vectors_by_length(column: pa.Array, scale: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, floor(scale * component) as float64) for each length of vector in a list column."""
    offsets = column.offsets.to_numpy()
    flat = column.values.to_numpy(zero_copy_only=False).astype(np.float64)
    lengths = np.diff(offsets)
    for n in np.unique(lengths):
        rows = np.flatnonzero(lengths == n)
        yield rows, np.floor(flat[offsets[rows][:, None] + np.arange(n)] * scale)


def scores(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers, exact; beyond 64 bits the nearest 64-bit number."""
    n = left.shape[1]
    if n == 0:
        return np.zeros((len(left), len(right)), np.int64)
    if float(np.abs(left).max(initial=0)) * float(np.abs(right).max(initial=0)) * n < 2.0 ** 53:
        return (left @ right.T).astype(np.int64)
    whole = np.frompyfunc(int, 1, 1)
    return np.clip(whole(left) @ whole(right).T, _LOW, _HIGH).astype(np.int64)


@dataclass
class Block:
    """A block of anchors and, per window, the scores that may enter it."""

    no: np.ndarray
    ids: np.ndarray
    labels: np.ndarray
    #: length of vector -> (places in the block, vectors)
    vectors: dict[int, tuple[np.ndarray, np.ndarray]]
    same_label: bool
    low: np.ndarray
    high: np.ndarray


@dataclass
class Best:
    """The first few (score down, id up) rows of every anchor of one window."""

    most: int
    floor: np.ndarray
    anchor: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    score: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    ids: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    def add(self, anchor: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        anchor, score, ids = (np.concatenate(p) for p in ((self.anchor, anchor), (self.score, score), (self.ids, ids)))
        order = np.lexsort((ids, ~score, anchor))
        anchor, score, ids = anchor[order], score[order], ids[order]
        new = np.ones(len(anchor), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (score[1:] != score[:-1]) | (ids[1:] != ids[:-1])
        anchor, score, ids = anchor[new], score[new], ids[new]
        rank = np.arange(len(anchor)) - np.searchsorted(anchor, anchor)
        keep = rank < self.most
        self.anchor, self.score, self.ids = anchor[keep], score[keep], ids[keep]
        last = rank[keep] == self.most - 1
        self.floor[self.anchor[last]] = np.maximum(self.floor[self.anchor[last]], self.score[last])


def _best_of_task(batches: Iterator[pa.RecordBatch], block: Block, most: int, scale: float) -> Iterator[pa.RecordBatch]:
    best = [Best(most, low.copy()) for low in block.low]
    step = 64  # small at first, so that the floors are known when the steps are long
    for batch in batches:
        ids, labels = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        for rows, vectors in vectors_by_length(batch.column(2), scale):
            places, anchors = block.vectors.get(vectors.shape[1], (None, None))
            if places is None:
                continue
            at = 0
            while at < len(rows):
                part, at = rows[at:at + step], at + step
                cells = scores(anchors, vectors[at - step:at])
                fits = (block.labels[places][:, None] == labels[part]) == block.same_label
                fits &= block.ids[places][:, None] != ids[part]
                for b, high in zip(best, block.high):
                    a, r = np.nonzero(fits & (cells <= high[places][:, None]) & (cells >= b.floor[places][:, None]))
                    if len(a):
                        b.add(places[a], cells[a, r], ids[part][r])
                step = min(step * 2, max(64, _CELLS // len(places)))
    found = np.concatenate([np.stack([b.anchor, b.score, b.ids]) for b in best], axis=1)
    no, score, ids = np.unique(found, axis=1)  # a row in several windows travels once
    yield pa.RecordBatch.from_arrays(
        [pa.array(block.no[no]), pa.array(~score), pa.array(np.full(len(no), 0 if block.same_label else 1, np.int32)), pa.array(ids)],
        ["no", "down", "kind", "id"])


def _candidates(rows: DataFrame, block: Block, most: int, scale: float) -> DataFrame:
    """Packed keys of the rows that can be among the first ``most`` of a window."""
    shared = rows.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _best_of_task(batches, shared.value, most, scale)

    return rows.mapInArrow(run, _KEYS)


def _in_key_order(keys: DataFrame) -> DataFrame:
    return keys.repartition("no").sortWithinPartitions("no", "down", "kind", "id")


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, int, int]]:
    """Packed keys in order, each (anchor, score, kind, id) once."""
    last = None
    for batch in batches:
        for key in zip(*(c.to_pylist() for c in batch.columns)):
            if key != last:
                yield key[0], ~key[1], key[2], key[3]
            last = key


def _first_positives(keys: DataFrame, most: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, now, n = [], None, 0
        for no, score, kind, i in _stream(batches):
            now, n = no, (n + 1 if no == now else 1)
            if n <= most:
                out.append((no, ~score, kind, i))
            if len(out) >= 10_000:
                yield _batch(out, ["no", "down", "kind", "id"], [pa.int64(), pa.int64(), pa.int32(), pa.int64()])
                out = []
        yield _batch(out, ["no", "down", "kind", "id"], [pa.int64(), pa.int64(), pa.int32(), pa.int64()])

    return _in_key_order(keys).mapInArrow(run, _KEYS)


def _batch(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)


def _open_windows(keys: DataFrame, block: Block, negatives: int, low: int, high: int) -> DataFrame:
    """Read the sorted keys: positives open windows, negatives fall into the open ones."""
    ids = keys.sparkSession.sparkContext.broadcast(dict(zip(block.no.tolist(), block.ids.tolist())))
    names = [f.split()[0] for f in _RESULT.split(", ")]
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, now, windows = [], None, []
        for no, score, kind, i in _stream(batches):
            if no != now:
                now, windows = no, []
            if kind == 0:
                windows.append([i, score, 0])
                continue
            # a window that is full, or that ends above this score, takes no later negative either
            windows = [w for w in windows if w[2] < negatives and low * w[1] <= 100 * score]
            for w in windows:
                if 100 * score <= high * w[1]:
                    w[2] += 1
                    out.append((ids.value[no], w[0], w[2], i, w[1], score))
            if len(out) >= 10_000:
                yield _batch(out, names, types)
                out = []
        yield _batch(out, names, types)

    return _in_key_order(keys).mapInArrow(run, _RESULT)


def mine_hard_negatives(rows: DataFrame, anchors: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100,
                        scale: float = 256.0, key: str = "vec_id", label: str = "label", vector: str = "embedding",
                        block: int = BLOCK) -> DataFrame:
    """For each anchor and each of its first positives, the first negatives that score between ``low`` and ``high`` (at most 100)
    percent of the positive. Labels and keys are whole numbers; ``anchors`` is a condition on the rows."""
    if not 0 <= low <= high <= 100:
        raise ValueError("the window must lie between 0 and 100 percent of the positive")
    spark = rows.sparkSession
    rows = (rows.select(F.col(key).cast("long").alias("id"), F.col(label).cast("long").alias("label"),
                        F.col(vector).cast("array<double>").alias("vector"), anchors.alias("anchor"))
            .where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull())
            .where(~F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))))
    chosen = written(with_row_id(rows.where("anchor").select("id", "label", "vector").distinct(), ["id", "label", "vector"], "no"), "anchors")
    rows = rows.select("id", "label", "vector")
    n = chosen.count()
    if n == 0:
        return spark.createDataFrame([], _RESULT)
    place = scratch_path(spark, "hard-negatives")
    for number, first in enumerate(range(1, n + 1, block)):
        part = chosen.where(F.col("no").between(first, first + block - 1)).orderBy("no").toArrow().combine_chunks()  # at most ``block`` rows
        vectors = {v.shape[1]: (at, v) for at, v in vectors_by_length(part["vector"].combine_chunks(), scale)}
        no = part["no"].to_numpy()
        own = Block(no, part["id"].to_numpy(), part["label"].to_numpy(), vectors, True, np.full((1, len(no)), _LOW), np.full((1, len(no)), _HIGH))
        opened = written(_first_positives(_candidates(rows, own, positives, scale), positives), "positives")
        lows, highs, n_opened = np.full((positives, len(no)), _HIGH), np.full((positives, len(no)), _LOW), [0] * len(no)
        for r in opened.collect():  # at most ``block`` times ``positives`` rows
            at, score = r.no - first, ~r.down
            lows[n_opened[at], at], highs[n_opened[at], at] = max(-(-low * score // 100), _LOW), min(high * score // 100, _HIGH)
            n_opened[at] += 1
        other = Block(no, own.ids, own.labels, vectors, False, lows, highs)
        found = _candidates(rows, other, negatives, scale).unionByName(opened)
        _open_windows(found, other, negatives, low, high).write.parquet(f"{place}/block={number}")
    return spark.read.schema(_RESULT).parquet(*[f"{place}/block={b}" for b in range(-(-n // block))])


SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same,
         CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, p.positive_id,
       CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.id) AS INTEGER) AS rank,
       s.id AS negative_id, p.positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same
  AND 80 * p.positive_score <= 100 * s.score AND 100 * s.score <= 100 * p.positive_score
QUALIFY rank <= 5
"""


@query("op12_hard_negatives", SQL)
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = (read(spark, sf_dir, "embeddings").withColumn(
        "label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))))
    return mine_hard_negatives(rows, F.col("vec_id") % 100 == 0)
