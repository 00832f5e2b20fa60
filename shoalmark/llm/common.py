"""What several operators share: row keys, labelled samples, connected components, held-out folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..session import written

#: A table of ids is broadcast only if it was counted and holds at most this many of them (about 16 MB).
BROADCAST_IDS = 1_000_000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(key: Column | str, folds: int) -> Column:
    """crc32 of the key as text, modulo ``folds``; a null key counts as empty text."""
    key = F.col(key) if isinstance(key, str) else key
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % folds


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, longest: int,
                    where: Column, keep: tuple[str, ...] = (), characters: int = 200_000_000) -> DataFrame:
    """At most ``per_class`` labelled texts of each class, ``characters`` of each class in all, by a hash of their key.

    Rows without label, text or key, and texts above ``longest`` characters, teach nothing. Two labels of one key
    that disagree are left out. Of several texts of one key the one with the smallest hash is taken.
    """
    known = (labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id")
             .agg(F.min(label).alias("_label"), F.max(label).alias("_other"))
             .where("_label = _other").select("doc_id", "_label"))
    rows = (docs.where(F.col("text").isNotNull() & (F.length("text") <= longest) & where)
            .select("doc_id", "text", *keep, F.xxhash64("text").alias("_hash")))
    # the texts of the sample are chosen without moving any text
    ids = (rows.groupBy("doc_id").agg(F.min(F.struct("_hash", F.length("text").alias("n"))).alias("_text")).join(known, "doc_id"))
    chosen = None
    for value in (0, 1):
        part = (ids.where(F.col("_label") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class))
        chosen = part if chosen is None else chosen.unionByName(part)
    # 2 * per_class rows of numbers
    so_far = F.sum("_text.n").over(Window.partitionBy("_label").orderBy(F.xxhash64("doc_id"), "doc_id"))
    chosen = (chosen.withColumn("_so_far", so_far).where(F.col("_so_far") <= characters)
              .select("doc_id", F.col("_text._hash").alias("_hash"), "_label"))
    found = rows.join(F.broadcast(chosen), ["doc_id", "_hash"])
    rest = F.struct("text", *keep, F.col("_label").alias("label"))
    return found.groupBy("doc_id").agg(F.min(rest).alias("_row")).select("doc_id", "_row.*")


def by_ids(rows: DataFrame, ids: DataFrame, key: str, how: str) -> DataFrame:
    """Rows whose key is (``left_semi``) or is not (``left_anti``) in a one-column table of ids.

    The ids are written and counted: a short table is broadcast, so texts are not shuffled; beyond that, the
    same join is left to the optimizer.
    """
    ids = written(ids.withColumnRenamed(ids.columns[0], key), "ids")
    return rows.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, key, how)


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of an undirected graph given as rows (a, b), repeated or not.

    Returns (id, component): every vertex with an edge to another, and the smallest id it can reach. Vertices of one label
    move together: each round, a label becomes the smallest label next to any of its vertices, and the label of that
    label, and so on for two steps, so the number of labels falls by a factor each round, on chains as well. Each
    round is one written table; nothing is gathered on the driver, and hubs are reduced by plain minima.
    """
    pairs = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b")
    both = written(pairs.union(pairs.select("b", "a")).distinct(), "edges")
    labels = written(both.groupBy(F.col("a").alias("id"))
                     .agg(F.least(F.min("b"), F.col("id")).alias("component")), "labels")
    for _ in range(max_rounds):
        near = (both.join(labels.select(F.col("id").alias("b"), "component"), "b")
                .groupBy(F.col("a").alias("id")).agg(F.min("component").alias("_near")))
        moves = written(labels.join(near, "id").groupBy("component")
                        .agg(F.least(F.min("_near"), F.col("component")).alias("_to")), "moves")
        for _ in range(2):
            onward = moves.select(F.col("component").alias("_to"), F.col("_to").alias("_far"))
            moves = moves.join(onward, "_to", "left").select("component", F.coalesce("_far", "_to").alias("_to"))
        moved = written(labels.join(moves, "component")
                        .select("id", F.col("component").alias("_old"), F.col("_to").alias("component")), "labels")
        labels = moved.select("id", "component")
        if moved.where("_old <> component").isEmpty():
            return labels
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
