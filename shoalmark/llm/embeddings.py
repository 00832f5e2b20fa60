"""Near-duplicate vectors by tiled comparison in the order of principal components.

Two vectors link when their labels are equal and not null and their cosine, in double precision, is at least the threshold.

* Equal vectors of one label are one class, compared once and counted as often as they occur.
* Unit vectors are rotated onto the principal axes of all vectors (sums of products formed on the cluster, d^2 numbers on the
  driver), so the leading coordinates hold most of every product.
* Classes are ordered by label and first coordinate and cut into tiles of ``TILE``. Two tiles meet only if they share a label and
  their first coordinates come within sqrt(2 - 2t), the largest distance of linked unit vectors.
* In a pair of tiles, products are accumulated over the leading coordinates first; what remains is at most the product of the two
  suffix norms. Rows and columns whose pairs all fall below the threshold leave; when none is left the comparison stops.
  Survivors are decided by the cosine of the vectors as given.

A pair of tiles returns one row per vector that has links: how many, and the smallest class it reaches within the pair. So a
group of near copies of any size costs rows in proportion to its members, not to its links. Tile pairs within one label grow
with its square, spread over as many tasks; that is the price of an exact answer where coordinates do not separate.

Rows: vectors that are null, empty, zero, or hold null or non-finite components, vectors without label or id, and
vectors of different lengths link with nothing; such a row has 0 links and is its own component (null without id). Repeated
rows (same id, label and vector) are one vector; an id with different vectors has a row for each. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.ordering import with_row_id
from ..session import written
from .common import components, read
from .registry import query

TILE = 1024
STEPS = (8, 16, 32)
SLACK = 1e-9


def _usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled first, so that no square over- or underflows."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def axes(vectors: DataFrame) -> dict[int, np.ndarray]:
    """Principal axes (as columns, strongest first) of the unit vectors of each length."""

    def products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for d, rows in batch.groupby(batch["vector"].map(len)):
                x = unit(np.array(rows["vector"].tolist(), float))
                sums[d] = sums.get(d, 0) + x.T @ x
        for d, s in sums.items():
            i, j = np.triu_indices(d)
            yield pd.DataFrame({"d": d, "i": i, "j": j, "s": s[i, j]})

    summed = (vectors.select("vector").mapInPandas(products, "d int, i int, j int, s double")
              .groupBy("d", "i", "j").agg(F.sum("s").alias("s")))
    out: dict[int, np.ndarray] = {}
    for r in summed.collect():  # d (d + 1) / 2 numbers for each length
        m = out.setdefault(r.d, np.zeros((r.d, r.d)))
        m[r.i, r.j] = m[r.j, r.i] = r.s
    return {d: np.linalg.eigh(m)[1][:, ::-1] for d, m in out.items()}


def links(a: np.ndarray, b: np.ndarray, basis: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of a, rows of b and the matrix that says which of them link; rows without any link are left out."""
    ua, ub = unit(a), unit(b)
    ra, rb = ua @ basis, ub @ basis
    rows, cols, acc, done = np.arange(len(a)), np.arange(len(b)), np.zeros((len(a), len(b))), 0
    for k in [s for s in STEPS if s < a.shape[1]]:
        acc = acc + ra[rows, done:k] @ rb[cols, done:k].T
        rest = np.outer(np.sqrt((ra[rows, k:] ** 2).sum(axis=1)), np.sqrt((rb[cols, k:] ** 2).sum(axis=1)))
        alive = acc + rest >= threshold - SLACK
        keep_a, keep_b = alive.any(axis=1), alive.any(axis=0)
        rows, cols, acc, done = rows[keep_a], cols[keep_b], acc[np.ix_(keep_a, keep_b)], k
        if not len(rows):
            return rows, cols, np.zeros((0, 0), bool)
    cos = ua[rows] @ ub[cols].T
    # the product of matrices may round otherwise than one cosine; those at the threshold are taken one by one
    linked = cos >= threshold
    for i, j in np.argwhere(np.abs(cos - threshold) < 1e-12):
        x, y = a[rows[i]], b[cols[j]]
        linked[i, j] = np.dot(x, y) / (np.sqrt(np.dot(x, x)) * np.sqrt(np.dot(y, y))) >= threshold
    return rows, cols, linked


def smallest_reached(linked: np.ndarray, ids_a: np.ndarray, ids_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row and column the smallest id of its component in the bipartite graph; each has a link or its own id."""
    la, lb, far = ids_a.copy(), ids_b.copy(), np.iinfo(np.int64).max
    while True:
        na = np.minimum(la, np.where(linked, lb, far).min(axis=1, initial=far))
        nb = np.minimum(lb, np.where(linked, na[:, None], far).min(axis=0, initial=far))
        if (na == la).all() and (nb == lb).all():
            return la, lb
        la, lb = na, nb


def vector_components(vectors: DataFrame, threshold: float, tile: int = TILE) -> DataFrame:
    """vec_id, n_links, component_id and kept of every distinct row of vec_id, embedding and label."""
    rows = (vectors.select("vec_id", "label", F.col("embedding").alias("vector"))
            .withColumn("usable", _usable(F.col("vector")) & F.col("label").isNotNull() & F.col("vec_id").isNotNull())
            .withColumn("k1", F.xxhash64("label", "vector")).withColumn("k2", F.xxhash64(F.lit(1), "label", "vector")))
    plain = rows.select("vec_id", "k1", "k2", "usable").distinct()
    classes = written(rows.where("usable").groupBy("k1", "k2").agg(
        F.min("vec_id").alias("rep"), F.count_distinct("vec_id").alias("copies"), F.first("label").alias("label"),
        F.first("vector").alias("vector")).withColumn("class", F.monotonically_increasing_id()), "vector-classes")
    bases = classes.sparkSession.sparkContext.broadcast(axes(classes))  # d^2 numbers for each length

    @F.pandas_udf("double")
    def leading(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            out = np.zeros(len(batch))
            for d, part in batch.groupby(batch.map(len)):
                where = batch.index.get_indexer(part.index)
                out[where] = unit(np.array(part.tolist(), float)) @ bases.value[d][:, 0]
            yield pd.Series(out)

    placed = (with_row_id(classes.withColumn("c1", leading("vector")).withColumn("d", F.size("vector")), ["label", "d", "c1", "class"], "number", 0)
              .withColumn("tile", F.floor(F.col("number") / tile)))
    placed = written(placed.select("class", "copies", "label", "d", "vector", "c1", "tile"), "vector-tiles")
    spans = placed.groupBy("label", "d", "tile").agg(F.min("c1").alias("lo"), F.max("c1").alias("hi"))
    other = spans.select("label", "d", F.col("tile").alias("tile2"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
    reach = float(np.sqrt(max(0.0, 2 - 2 * threshold))) + SLACK
    pairs = (spans.join(other, ["label", "d"]).where((F.col("tile") <= F.col("tile2")) & (F.col("lo2") <= F.col("hi") + reach)
                                                     & (F.col("lo") <= F.col("hi2") + reach))
             .select("label", "d", "tile", "tile2").distinct())
    sides = written(pairs.select("label", "d", "tile", "tile2", F.explode(F.when(F.col("tile") == F.col("tile2"), F.array(F.lit(0)))
                                                                         .otherwise(F.array(F.lit(0), F.lit(1)))).alias("side"))
                    .withColumn("own", F.when(F.col("side") == 0, F.col("tile")).otherwise(F.col("tile2"))), "tile-pairs")
    dealt = (placed.select("class", "copies", "vector", "label", "d", F.col("tile").alias("own"))
             .join(sides, ["label", "d", "own"]))

    def compare(batch: pa.Table) -> pa.Table:
        rows = batch.to_pandas()
        d = int(rows["d"].iloc[0])
        first, second = rows[rows["side"] == 0], rows[rows["side"] == 1]
        same = len(second) == 0 and rows["tile"].iloc[0] == rows["tile2"].iloc[0]
        if not same and (len(first) == 0 or len(second) == 0):
            second = second.iloc[:0]
        a = np.array(first["vector"].tolist(), float).reshape(len(first), d)
        b = a if same else np.array(second["vector"].tolist(), float).reshape(len(second), d)
        ids_a, ids_b = first["class"].to_numpy(), (first if same else second)["class"].to_numpy()
        many_a, many_b = first["copies"].to_numpy(), (first if same else second)["copies"].to_numpy()
        out_ids, out_n, out_root = [], [], []
        if len(a) and len(b):
            i, j, linked = links(a, b, bases.value[d], threshold)
            if linked.size:
                ra, rb = smallest_reached(linked, ids_a[i], ids_b[j])
                weight = linked.astype(np.int64)
                out_ids.append(ids_a[i])
                # within one tile every vector meets itself; its own copies are counted by its class
                out_n.append(weight @ many_b[j] - (many_a[i] if same else 0))
                out_root.append(ra)
                if not same:
                    out_ids.append(ids_b[j])
                    out_n.append(weight.T @ many_a[i])
                    out_root.append(rb)
        ids, n, root = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (out_ids, out_n, out_root))
        some = n > 0
        return pa.table({"class": pa.array(ids[some], pa.int64()), "n": pa.array(n[some], pa.int64()),
                         "root": pa.array(root[some], pa.int64())})

    linked = written(dealt.groupBy("label", "d", "tile", "tile2").applyInArrow(compare, "class long, n long, root long"), "vector-links")
    found = components(linked.select(F.col("class").alias("a"), F.col("root").alias("b")).where("a <> b"))
    counts = linked.groupBy("class").agg(F.sum("n").alias("n"))
    member = (classes.select("k1", "k2", "class", "rep", "copies").join(counts, "class", "left")
              .join(found.withColumnRenamed("id", "class"), "class", "left")
              .withColumn("component", F.coalesce("component", "class")))
    least = member.groupBy("component").agg(F.min("rep").alias("component_id"))
    member = (member.join(least, "component")
              .select("k1", "k2", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n"), "component_id", F.lit(True).alias("usable")))
    out = plain.join(member, ["k1", "k2", "usable"], "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
                      F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


SQL = """
WITH valid AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
sized AS (SELECT vec_id, label, v, sqrt(list_dot_product(v, v)) AS size FROM valid),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM sized a JOIN sized b
    ON a.label = b.label AND len(a.v) = len(b.v) AND a.vec_id <> b.vec_id
  WHERE list_dot_product(a.v, b.v) / (a.size * b.size) >= 0.93),
reach AS (
  WITH RECURSIVE walk(id, root) AS (
    SELECT vec_id, vec_id FROM embeddings
    UNION SELECT links.b, walk.root FROM walk JOIN links ON links.a = walk.id WHERE walk.root < links.b)
  SELECT id, min(root) AS component_id FROM walk GROUP BY id),
counts AS (SELECT a AS id, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(n, 0) AS n_links, component_id, e.vec_id = component_id AS kept
FROM embeddings e JOIN reach ON reach.id = e.vec_id LEFT JOIN counts ON counts.id = e.vec_id
"""


@query("op4_embedding_dedup", SQL)
def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_components(read(spark, sf_dir, "embeddings"), 0.93)
