"""Conflict-constrained best-fit packing of documents into sequences of fixed capacity.

A bin holds at most ``capacity`` words, at most one document of a source and at most one of a cluster of copies. Bins are
kept in the order of their residual room and carry a bitmap of sources and one of clusters. A document goes, longest
first, to the bin with the least sufficient room; while that bin conflicts, the search moves on to its successor, and
a new bin is opened when none is left. Documents longer than a bin are cut: full pieces have bins of their own, the rest is
packed like a document.

Best fit looks at all open bins, so it runs within shards: documents are numbered in the order of a hash of their key
and every ``SHARD`` consecutive numbers are one shard, whatever the input. A shard holds lengths and codes, never texts,
and its search is bounded by SHARD^2 steps even if all its documents come from one source.

Rows: every row is placed. A null or empty text has length 0 and joins the tightest bin that does not conflict. Null
sources and null clusters conflict with nothing. Repeated rows are placed separately. Ties in length go by the
number within the shard. Other columns are not looked at. An empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.ordering import with_row_id
from ..session import written
from .common import read
from .registry import query

CAPACITY = 1024
SHARD = 8192


def best_fit(items: Iterable[tuple[int, object, object]], capacity: int) -> tuple[list[int], int]:
    """Bin of each item (length, source, cluster), lengths within capacity; None for source or cluster: no conflict."""
    items = list(items)
    source_bit: dict[object, int] = {}
    cluster_bit: dict[object, int] = {}
    sources: list[int] = []
    clusters: list[int] = []
    rooms: list[tuple[int, int]] = []  # (residual, bin) in ascending order
    placed = [0] * len(items)
    for i in sorted(range(len(items)), key=lambda i: (-items[i][0], i)):
        length, source, cluster = items[i]
        s = 0 if source is None else 1 << source_bit.setdefault(source, len(source_bit))
        c = 0 if cluster is None else 1 << cluster_bit.setdefault(cluster, len(cluster_bit))
        at = bisect_left(rooms, (length, -1))
        while at < len(rooms) and (sources[rooms[at][1]] & s or clusters[rooms[at][1]] & c):
            at += 1
        if at < len(rooms):
            room, b = rooms.pop(at)
        else:
            room, b = capacity, len(sources)
            sources.append(0)
            clusters.append(0)
        sources[b] |= s
        clusters[b] |= c
        insort(rooms, (room - length, b))
        placed[i] = b
    return placed, len(sources)


def pack(docs: DataFrame, keys: Sequence[str], length: Column, source: Column, cluster: Column, order: Sequence[Column],
         capacity: int = CAPACITY, shard: int = SHARD) -> DataFrame:
    """One row per piece: keys, piece, start (in words of the document), length, shard, bin and offset within the bin.

    ``order`` numbers the documents; make it a hash of their content followed by what distinguishes rows.
    """
    facts = written(docs.select(*keys, length.cast("long").alias("_length"), source.cast("string").alias("_source"),
                                cluster.cast("string").alias("_cluster"), F.struct(*order).alias("_order")), "pack-facts")
    numbered = with_row_id(facts, ["_order", "_length", "_source", "_cluster"], "_number", 0).drop("_order")
    fields = {f.name: f.dataType.simpleString() for f in facts.schema}
    schema = ", ".join(f"`{k}` {fields[k]}" for k in keys) + \
        ", piece long, start long, length long, shard long, bin long, offset long"

    def pack_shard(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("_number", kind="stable").reset_index(drop=True)
        plain = lambda column: [None if pd.isna(v) else v for v in column]
        lengths = rows["_length"].astype("int64").tolist()
        full = [n // capacity if n % capacity or not n else n // capacity - 1 for n in lengths]
        rest = [n - f * capacity for n, f in zip(lengths, full)]
        bins, used = best_fit(zip(rest, plain(rows["_source"]), plain(rows["_cluster"])), capacity)
        out: list[tuple[int, int, int, int, int, int]] = []
        filled = [0] * used
        for i in sorted(range(len(lengths)), key=lambda i: (-rest[i], i)):
            for piece in range(full[i]):
                out.append((i, piece, piece * capacity, capacity, used, 0))
                used += 1
            out.append((i, full[i], full[i] * capacity, rest[i], bins[i], filled[bins[i]]))
            filled[bins[i]] += rest[i]
        made = pd.DataFrame(out, columns=["_i", "piece", "start", "length", "bin", "offset"])
        result = rows[list(keys)].iloc[made["_i"]].reset_index(drop=True)
        result["piece"], result["start"], result["length"] = made["piece"], made["start"], made["length"]
        result["shard"], result["bin"], result["offset"] = int(key[0]), made["bin"], made["offset"]
        return result

    return (numbered.withColumn("_shard", F.floor(F.col("_number") / shard))
            .groupBy("_shard").applyInPandas(pack_shard, schema))


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, shard: int = SHARD) -> DataFrame:
    """Documents packed by words, with their source and with equal texts as clusters."""
    content = F.xxhash64("text")
    words = F.coalesce(F.regexp_count("text", F.lit(r"\S+")), F.lit(0))
    return pack(docs, ["doc_id"], words, F.col("source"), F.when(F.col("text").isNotNull(), content),
                [F.xxhash64(F.col("doc_id"), content), F.col("doc_id"), content], capacity, shard)


@query("op6_best_fit_packing")
def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read(spark, sf_dir, "documents").select("doc_id", "text", "source"))
