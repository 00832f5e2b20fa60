"""Exact Jaccard join of documents on word shingles through a token-group matrix.

A document's set is its distinct ``width``-word shingles (64-bit hashes; words as in ``text.word_hashes``); with
fewer words, the whole sequence is its one shingle. Two documents link when den * |intersection| >= num * |union|. The
result is one row per document with the size of its set and the smallest doc_id that it reaches by links.

1. Documents with equal sets form one class, represented by its smallest doc_id.
2. Tokens are put in one global order, rare ones first, by a table of ``SKETCH`` counters over all shingles of all texts.
   Linked sets share a token among their first |s| - ceil(t |s|) + 1, whatever that order is, so only these enter the matrix
   (token, representative); tokens with a single doc_id are left out of it.
3. Similar documents are partitioned into groups around a leader: every member of a token's bucket is compared with the first and
   the last representative of the bucket, which takes one row per member, however large the bucket. Whatever links joins one component.
4. What is left are buckets whose members lie in several components. They are cut into groups of about ``GROUP``
   members; each group stores the union of its members' matrix tokens and the range of their sizes. A query, that is a member outside the
   bucket's largest component, meets a group with its own tokens: the overlap with the union bounds the
   overlap with every member, and only groups that can still reach the threshold are opened and their members bounded one by one.
5. Each set has a signature of ``BITS`` bits, a bit being the parity of its tokens that fall there. Two signatures differ in at
   most as many bits as the sets differ in tokens, so most pairs of step 4 that do not link go without their sets.
6. Pairs that pass are verified on their whole sets, taken again from the texts.

A pair within one component is not compared any further, as it cannot change the result; every other linked pair is found.
Hot tokens need no cap: large groups of near copies become one component in step 3 by a linear number of rows, joins are
equi-joins that adaptive execution can split, and groups of step 4 are bounded on both sides.

Rows: a text that is null, empty or without words has an empty set, links with nothing and is its own
component. Rows of one doc_id are one vertex; each of their texts has its own set. A null doc_id names no vertex: such a row
gets the component of its equals, or null. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import IntegralType

from ..operators.ordering import with_row_id
from ..session import written
from .common import BROADCAST_IDS, by_ids, components, read
from .registry import query
from .text import shingles

SKETCH = 1 << 22
_BLOCK = 1024
GROUP = 128
QUERIES = 512
BITS = 1024


def count_tokens(docs: DataFrame, text: str, width: int, size: int = SKETCH) -> np.ndarray:
    """Counters of all shingles by the low bits of their hash; tasks send small blocks of counters, summed on the cluster."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int32)

        def take(held: list[np.ndarray]) -> None:
            at, n = np.unique((np.concatenate(held) & np.uint64(size - 1)).astype(np.int32), return_counts=True)
            total[at] += n.astype(np.int32)

        for batch in batches:
            held, n = [], 0
            for s in shingles(batch.column(0), width):
                held.append(s)
                n += len(s)
                if n > 1 << 19:
                    take(held)
                    held, n = [], 0
            if n:
                take(held)
        blocks = total.reshape(-1, _BLOCK)
        for i in range(0, len(blocks) if total.any() else 0, 256):
            part = blocks[i:i + 256]
            kinds = [np.uint8 if m < 256 else np.uint16 if m < 65536 else np.int32 for m in part.max(axis=1)]
            yield pa.RecordBatch.from_arrays([pa.array(range(i, i + len(part)), pa.int32()),
                                              pa.array([b.astype(k).tobytes() for b, k in zip(part, kinds)], pa.binary())],
                                             names=["block", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds, sums = {_BLOCK: np.uint8, 2 * _BLOCK: np.uint16, 4 * _BLOCK: np.int32}, {}
        for batch in batches:
            for block, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = sums.setdefault(block, np.zeros(_BLOCK, np.int64))
                own += np.frombuffer(counts, kinds[len(counts)])
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()),
                                          pa.array([np.minimum(s, 0xFFFFFFFF).astype(np.uint32).tobytes() for s in sums.values()], pa.binary())],
                                         names=["block", "counts"])

    schema = "block int, counts binary"
    parts = docs.select(text).mapInArrow(count, schema).repartition("block").mapInArrow(add, schema)
    out = np.zeros((size // _BLOCK, _BLOCK), np.uint32)
    for row in parts.collect():  # size / 1024 rows of 4 KB, whatever the data
        out[row.block] = np.frombuffer(row.counts, np.uint32)
    return out.reshape(-1)


def prefix_length(n: int, num: int, den: int) -> int:
    """How many of a set's first tokens must hold one that any linked set has among its own first."""
    return n - -(-num * n // den) + 1 if n else 0


def signature(s: np.ndarray) -> np.ndarray:
    """Parity of the tokens of a set by the high bits of their hash, as 64-bit numbers."""
    at = np.bincount((s // np.uint64((1 << 64) // BITS)).astype(np.int64), minlength=BITS)
    return np.packbits((at & 1).astype(np.uint8)).view(np.int64)


def token_sets(docs: DataFrame, text: str, width: int, num: int, den: int, counts: np.ndarray) -> DataFrame:
    """doc_id, size of the set, 128-bit fingerprint, first tokens in the global order and signature."""
    shared = docs.sparkSession.sparkContext.broadcast(counts)  # SKETCH counters

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank, low = shared.value, np.uint64(len(shared.value) - 1)
        for batch in batches:
            sizes, firsts, marks, signs = [], [], [], []
            for s in shingles(batch.column(1), width):
                p = prefix_length(len(s), num, den)
                own = rank[(s & low).astype(np.int64)]
                if p < len(s):  # s ascends, so a stable sort breaks ties by token
                    s_first = s[np.argsort(own, kind="stable")[:p]]
                else:
                    s_first = s
                sizes.append(len(s))
                firsts.append(s_first.view(np.int64))
                marks.append(np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), np.int64))
                signs.append(signature(s))
            if not sizes:
                continue
            marks = np.array(marks)
            offsets = np.append(0, np.cumsum([len(f) for f in firsts])).astype(np.int32)
            tokens = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(firsts)))
            every = np.arange(len(signs) + 1, dtype=np.int32) * (BITS // 64)
            sign = pa.ListArray.from_arrays(pa.array(every), pa.array(np.concatenate(signs)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(sizes, np.int64)), pa.array(marks[:, 0]),
                                              pa.array(marks[:, 1]), tokens, sign], names=["doc_id", "n", "f1", "f2", "first", "sign"])

    return (docs.select(F.col("doc_id").cast("long"), text)
            .mapInArrow(one, "doc_id long, n long, f1 long, f2 long, first array<long>, sign array<long>"))


def whole_sets(docs: DataFrame, text: str, width: int, wanted: DataFrame) -> DataFrame:
    """doc_id, fingerprint and all tokens of the wanted documents (a table of distinct ids)."""
    chosen = by_ids(docs.select(F.col("doc_id").cast("long").alias("id"), text), wanted, "id", "left_semi")

    def all_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                held = list(shingles(part.column(1), width))
                marks = [int.from_bytes(hashlib.blake2b(h.tobytes(), digest_size=8).digest(), "little", signed=True) for h in held]
                offsets = np.append(0, np.cumsum([len(h) for h in held])).astype(np.int32)
                tokens = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(held).view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(marks, pa.int64()), tokens], names=["id", "mark", "tokens"])

    return chosen.mapInArrow(all_of, "id long, mark long, tokens array<long>").dropDuplicates(["id", "mark"]).drop("mark")


def _needed(na: Column, nb: Column, num: int, den: int) -> Column:
    """Least intersection of linked sets of these sizes."""
    return F.ceil(num * (na + nb) / F.lit(float(num + den)) - 1e-9)


def _sizes_fit(na: Column, nb: Column, num: int, den: int) -> Column:
    return den * F.least(na, nb) >= num * F.greatest(na, nb)


def _verified(pairs: DataFrame, docs: DataFrame, text: str, width: int, num: int, den: int) -> DataFrame:
    """The linked ones of candidate pairs (a, b)."""
    pairs = written(pairs, "pairs")
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct()
    sets = written(whole_sets(docs, text, width, ids), "sets")
    both = (pairs.join(sets.select(F.col("id").alias("a"), F.col("tokens").alias("ta")), "a")
            .join(sets.select(F.col("id").alias("b"), F.col("tokens").alias("tb")), "b"))
    shared = F.size(F.array_intersect("ta", "tb"))
    return (both.select("a", "b", shared.alias("i"), (F.size("ta") + F.size("tb") - shared).alias("u"))
            .where(f"{den} * i >= {num} * u").select("a", "b"))


def _first_check(pairs: DataFrame, firsts: DataFrame, num: int, den: int) -> DataFrame:
    """Drop pairs (a, b, na, nb) whose first tokens already show that they cannot link.

    Of the set whose first tokens end earlier in the global order, all common ones among them are among the first of the
    other; the rest adds at most its remaining tokens.
    """
    both = (pairs.join(firsts.select(F.col("rep").alias("a"), F.col("n").alias("na"), F.col("first").alias("fa")), "a")
            .join(firsts.select(F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("first").alias("fb")), "b"))
    rest = F.greatest(F.col("na") - F.size("fa"), F.col("nb") - F.size("fb"))
    return (both.where(_sizes_fit(F.col("na"), F.col("nb"), num, den)
                       & (F.size(F.array_intersect("fa", "fb")) + rest >= _needed(F.col("na"), F.col("nb"), num, den)))
            .select("a", "b").distinct())


def _sign_check(pairs: DataFrame, signs: DataFrame, num: int, den: int) -> DataFrame:
    """Drop pairs (a, b) whose signatures (rep, n, sign) differ in more bits than linked sets differ in tokens."""
    both = (pairs.join(signs.select(F.col("rep").alias("a"), F.col("n").alias("na"), F.col("sign").alias("sa")), "a")
            .join(signs.select(F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("sign").alias("sb")), "b"))
    apart = F.aggregate(F.zip_with("sa", "sb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda t, x: t + x)
    na, nb = F.col("na"), F.col("nb")
    return (both.where(_sizes_fit(na, nb, num, den) & (apart <= na + nb - 2 * _needed(na, nb, num, den)))
            .select("a", "b").distinct())


def _group_candidates(members: DataFrame, num: int, den: int, group: int = GROUP, queries: int = QUERIES) -> DataFrame:
    """Pairs between components of a bucket that the token-group matrix cannot rule out.

    members: bucket, rep, n, first, component, main (the bucket's largest component), n_members, n_queries.
    """
    mixed = F.pmod(F.xxhash64("rep"), F.lit(1 << 30))
    groups, blocks = F.ceil(F.col("n_members") / group), F.ceil(F.col("n_queries") / queries)
    stored = members.select("bucket", "rep", "n", "first", "component", F.lit(False).alias("asks"),
                            F.pmod(mixed, groups).alias("g"), F.explode(F.sequence(F.lit(0), (blocks - 1).cast("int"))).alias("q"))
    asking = (members.where("component <> main")
              .select("bucket", "rep", "n", "first", "component", F.lit(True).alias("asks"),
                      F.explode(F.sequence(F.lit(0).cast("bigint"), groups - 1)).alias("g"), F.pmod(mixed, blocks).cast("int").alias("q")))

    def open_groups(rows: pd.DataFrame) -> pd.DataFrame:
        need = lambda a, b: -(-num * (a + b) // (num + den))
        held = [(r.rep, r.n, r.component, np.asarray(r.first)) for r in rows[~rows.asks].itertuples()]
        out = []
        if held:
            union = np.unique(np.concatenate([f for *_, f in held]))
            least, most = min(h[1] for h in held), max(h[1] for h in held)
            rest = max(h[1] - len(h[3]) for h in held)
            for r in rows[rows.asks].itertuples():
                mine = np.asarray(r.first)
                lowest = max(least, -(-num * r.n // den))  # no linked set is smaller
                if den * r.n < num * least or den * most < num * r.n:
                    continue
                inside = np.isin(mine, union, assume_unique=True).sum()
                if inside + max(r.n - len(mine), rest) < need(r.n, min(lowest, least)):
                    continue
                for rep, n, component, first in held:
                    if component == r.component or den * min(n, r.n) < num * max(n, r.n):
                        continue
                    common = np.isin(mine, first, assume_unique=True).sum()
                    if common + max(r.n - len(mine), n - len(first)) >= need(n, r.n):
                        out.append((min(rep, r.rep), max(rep, r.rep)))
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return (stored.unionByName(asking).groupBy("bucket", "g", "q").applyInPandas(open_groups, "a long, b long").distinct())


def jaccard_components(docs: DataFrame, width: int = 5, num: int = 8, den: int = 10, text: str = "text",
                       sketch: int = SKETCH, sizes: tuple[int, ...] = ()) -> DataFrame:
    """doc_id, n_shingles and component_id of every row; links are shingle sets with Jaccard of num / den or more.

    ``sizes``: members and queries of a group in step 4, if not ``GROUP`` and ``QUERIES``; larger ones move fewer copies of rows.
    Ids that are not whole numbers are numbered in their order and come back at the end."""
    if not isinstance(docs.schema["doc_id"].dataType, IntegralType):
        codes = written(with_row_id(docs.select("doc_id").where("doc_id IS NOT NULL").distinct(), ["doc_id"], "code"), "codes")
        coded = docs.select("doc_id", text).join(codes, "doc_id", "left").select(F.col("code").alias("doc_id"), text)
        found = jaccard_components(coded, width, num, den, text, sketch, sizes)
        own, of = (codes.select(F.col("doc_id").alias(n), F.col("code").alias(f"_{n}")) for n in ("doc_id", "component_id"))
        return (found.withColumnsRenamed({"doc_id": "_doc_id", "component_id": "_component_id"}).join(own, "_doc_id", "left")
                .join(of, "_component_id", "left").select("doc_id", "n_shingles", "component_id"))
    sets = written(token_sets(docs, text, width, num, den, count_tokens(docs, text, width, sketch)), "token-sets")
    filled = sets.where("n > 0")
    reps = written(filled.groupBy("f1", "f2").agg(F.min("doc_id").alias("rep")), "representatives")

    # the matrix, with its tokens of one id left out; only sets of one id and size need their fingerprints to tell them apart
    named, key = filled.where("doc_id IS NOT NULL"), ["doc_id", "n"]
    several = written(named.groupBy(*key).agg(F.min("f1").alias("_a1"), F.max("f1").alias("_z1"), F.min("f2").alias("_a2"), F.max("f2").alias("_z2"))
                      .where("_a1 < _z1 OR _a2 < _z2").select(*key, F.lit(True).alias("_many")), "several-sets")
    if (many := several.count()):
        mark = lambda f: F.when(F.col("_many"), F.col(f)).otherwise(F.lit(0).cast("long"))
        named = (named.join(F.broadcast(several) if many <= BROADCAST_IDS else several, key, "left")
                 .withColumns({"m1": mark("f1"), "m2": mark("f2")}))
        key = [*key, "m1", "m2"]
    cells = named.select(*key, F.explode("first").alias("token"))
    buckets = (cells.groupBy("token").agg(F.min("doc_id").alias("_lo"), F.max("doc_id").alias("_hi"))
               .where("_lo < _hi").select("token"))
    hits = cells.join(buckets, "token")
    of_doc = named.select(*key, "f1", "f2").join(reps, ["f1", "f2"]).groupBy(*key).agg(F.min("rep").alias("rep"))
    hits = written(hits.join(of_doc, key).select("token", "rep", "n").distinct(), "matrix")
    firsts = written(filled.withColumnRenamed("doc_id", "rep").join(hits.select("rep", "n").distinct(), ["rep", "n"])
                     .dropDuplicates(["rep", "n", "f1", "f2"]).select("rep", "n", "first", "sign"), "first-tokens")

    # every member of a bucket against its first and its last representative
    ends = (hits.groupBy("token").agg(F.min(F.struct("rep", "n")).alias("lo"), F.max(F.struct("rep", "n")).alias("hi"))
            .where("lo.rep < hi.rep"))
    ends = written(ends, "bucket-ends")  # a table of its own, so that the join below can split a hot token
    met = hits.join(ends, "token")
    fits = lambda end: _sizes_fit(F.col("n"), F.col(f"{end}.n"), num, den)
    pairs = (met.where(fits("lo")).select(F.col("lo.rep").alias("a"), F.col("rep").alias("b"))
             .union(met.where(fits("hi")).select(F.col("rep").alias("a"), F.col("hi.rep").alias("b")))
             .where("a < b").distinct())
    near = _verified(_first_check(pairs, firsts, num, den), docs, text, width, num, den)

    # texts of one id are one vertex
    several = (filled.where("doc_id IS NOT NULL").select("doc_id", "f1", "f2").distinct().join(reps, ["f1", "f2"]))
    least = several.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("_z")).where("a < _z").drop("_z")
    same = several.join(least, "doc_id").select("a", F.col("rep").alias("b")).where("a < b")
    edges = written(near.union(same), "links")
    found = written(components(edges), "components")

    # buckets that still hold several components, each set of members once
    placed = hits.join(found.withColumnRenamed("id", "rep"), "rep", "left") \
        .withColumn("component", F.coalesce("component", "rep"))
    content = [F.xxhash64(F.lit(k), "rep", "n").bitwiseAND((1 << 40) - 1) for k in (1, 2)]
    open_buckets = (placed.join(ends.select("token", "lo", "hi"), "token")  # another set of the first or last id is not compared yet
                    .where("NOT (rep = lo.rep AND n = lo.n) AND NOT (rep = hi.rep AND n = hi.n)").groupBy("token")
                    .agg(F.min("component").alias("_c1"), F.max("component").alias("_c2"), F.count("*").alias("n_members"),
                         F.sum(content[0]).alias("_h1"), F.sum(content[1]).alias("_h2"))
                    .where("_c1 < _c2").groupBy("n_members", "_h1", "_h2").agg(F.min("token").alias("token"))
                    .select("token"))
    left = written(placed.join(open_buckets, "token"), "open-buckets")
    by_component = left.groupBy("token", "component").agg(F.count("*").alias("_k"))
    main = by_component.groupBy("token").agg(
        F.max_by("component", F.struct("_k", "component")).alias("main"), F.sum("_k").alias("n_members"),
        (F.sum("_k") - F.max("_k")).alias("n_queries"))
    members = (left.join(main, "token").join(firsts.select("rep", "n", "first"), ["rep", "n"])
               .withColumnRenamed("token", "bucket"))
    candidates = written(_group_candidates(members, num, den, *sizes), "candidates")
    more = _verified(_sign_check(candidates, firsts, num, den), docs, text, width, num, den)
    edges = written(edges.union(more), "links")
    found = components(edges)

    out = (sets.select("doc_id", F.col("n").alias("n_shingles"), "f1", "f2").join(reps, ["f1", "f2"], "left")
           .join(found.withColumnRenamed("id", "rep"), "rep", "left"))
    return out.select("doc_id", "n_shingles", F.coalesce("component", "rep", "doc_id").alias("component_id"))


def one_per_group(docs: DataFrame, width: int = 5, num: int = 8, den: int = 10, sizes: tuple[int, ...] = ()) -> DataFrame:
    """One document of each group of linked ones: the one with the smallest doc_id.

    Where ids repeat or lack, every row is a document of its own: rows are numbered by doc_id (null last) and text, and the
    first of a group stays. So unrelated texts of one id all stay, and copies without an id are removed.
    """
    size = docs.agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("ids")).first()
    if size.n == size.ids:
        found = written(jaccard_components(docs, width, num, den, sizes=sizes), "groups")
        later = found.where("doc_id <> component_id").select("doc_id").distinct()
        return by_ids(docs, later, "doc_id", "left_anti").select(*docs.columns)
    row = F.struct(F.lit(1).alias("_"), *[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    numbered = written(with_row_id(docs.select(row, F.col("doc_id").alias("_id"), "text"), [F.col("_id").asc_nulls_last(), "text"], "_no"), "numbered")
    found = written(jaccard_components(numbered.select(F.col("_no").alias("doc_id"), "text"), width, num, den, sizes=sizes), "groups")
    later = found.where("doc_id <> component_id").select("doc_id")
    return by_ids(numbered, later, "_no", "left_anti").select(*[F.col(f"_row.`{c}`").alias(c) for c in docs.columns])


@query("op9_jaccard_join")
def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(read(spark, sf_dir, "documents").select("doc_id", "text"), 4, 85, 100)
