"""Benchmark decontamination by pigeonhole edit matching.

A test item may occur in a document with up to ``RATE`` of its length in edit errors. Split into one piece more than
that budget, an occurrence must hold at least one piece unchanged. A task finds all pieces of all items in one pass over each
whole text (an Aho-Corasick automaton), takes every hit as a place where the item may lie, and verifies the place by Myers'
bit-parallel edit distance. Hits of one item that imply the same start as one of its last eight are verified once.

Texts and items are compared in lower case with white space runs as one space; reported places are code points of the
text itself. Item ids keep their type. Items are taken in blocks of at most ``BLOCK_CHARS`` characters; each block is broadcast and meets all
documents, so neither memory nor recall depends on the size of the benchmark.

Rows: null and empty texts hold nothing. Items with null id or text, or shorter than ``SHORTEST`` characters after
normalisation, are too short to tell a leak and are left out. Repeated items count once; texts that share an
item_id are alternatives. Repeated documents are each reported. Of several occurrences of an item in a text the
closest, then the first, is reported. Existing columns named leaks are replaced.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import written
from .common import read
from .registry import query

RATE = 0.05
SHORTEST = 20
BLOCK_CHARS = 4_000_000


def lowered(text: str) -> str:
    """Lower case with as many characters as before."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower()[0] for c in text)


def normal(text: str) -> str:
    return " ".join(lowered(text).split())


def pieces_of(item: str, errors: int) -> list[tuple[int, str]]:
    """errors + 1 pieces of even length with their offsets."""
    cuts = [len(item) * i // (errors + 1) for i in range(errors + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def masks(pattern: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, c in enumerate(pattern):
        out[c] = out.get(c, 0) | 1 << i
    return out


def myers(pattern: dict[str, int], m: int, text: str) -> tuple[int, int]:
    """Least edit distance between the pattern and a part of the text, and the first end of such a part."""
    every, high = (1 << m) - 1, 1 << (m - 1)
    up, down, score = every, 0, m
    best, end = m, 0
    for j, c in enumerate(text, 1):
        eq = pattern.get(c, 0)
        diagonal = (((eq & up) + up) ^ up) | eq | down
        grows, falls = down | (every & ~(diagonal | up)), up & diagonal
        if grows & high:
            score += 1
        elif falls & high:
            score -= 1
        grows, falls = (grows << 1) & every, (falls << 1) & every
        vertical = eq | down
        up, down = falls | (every & ~(vertical | grows)), grows & vertical
        if score < best:
            best, end = score, j
    return best, end


class Matcher:
    """Finds the items of one block in texts."""

    def __init__(self, items: list[tuple[int, str]], rate: float):
        import ahocorasick

        self.items = [(item_id, text, int(len(text) * rate)) for item_id, text in items]
        self.masks: dict[int, tuple[dict, dict]] = {}
        where: dict[str, list[tuple[int, int]]] = {}
        for n, (_, text, errors) in enumerate(self.items):
            for offset, piece in pieces_of(text, errors):
                where.setdefault(piece, []).append((n, offset + len(piece)))
        self.automaton = ahocorasick.Automaton()
        for piece, at in where.items():
            self.automaton.add_word(piece, at)
        if where:
            self.automaton.make_automaton()
        self.any = bool(where)

    def verify(self, n: int, text: str, start: int) -> tuple[int, int, int] | None:
        """(distance, start, end) of the item's best occurrence that begins within the budget of ``start``."""
        _, item, errors = self.items[n]
        if text.startswith(item, max(start, 0)) and start >= 0:
            return 0, start, start + len(item)
        if n not in self.masks:
            self.masks[n] = masks(item), masks(item[::-1])
        forward, backward = self.masks[n]
        low = max(0, start - errors)
        part = text[low:start + len(item) + 2 * errors]
        distance, end = myers(forward, len(item), part)
        if distance > errors:
            return None
        _, back = myers(backward, len(item), part[:end][::-1])
        return distance, low + end - back, low + end

    def leaks(self, text: str | None) -> list[dict]:
        if not text or not self.any:
            return []
        plain = normal(text)
        tried: dict[int, list[int]] = {}
        best: dict[int, tuple[int, int, int]] = {}
        for last, at in self.automaton.iter(plain):
            for n, reach in at:
                start = last + 1 - reach
                places = tried.setdefault(n, [])
                # the verified part covers starts within the budget, so a hit at the same start tells nothing new
                if start in places[-8:]:
                    continue
                places.append(start)
                found = self.verify(n, plain, start)
                if found:
                    item_id = self.items[n][0]
                    best[item_id] = min(best.get(item_id, found), found)
        if not best:
            return []
        spans = [m.span() for m in re.finditer(r"\S+", text)]
        starts, at = [], 0
        for a, b in spans:
            starts.append((at, a))
            at += b - a + 1

        def place(i: int) -> int:
            k = bisect_right(starts, (i, len(text))) - 1
            return min(starts[k][1] + i - starts[k][0], spans[k][1])

        return [{"item_id": k, "start": place(a), "end": place(b - 1) + 1 if b > a else place(a), "distance": d}
                for k, (d, a, b) in sorted(best.items())]


def _blocks(benchmark: DataFrame, block_chars: int) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of about ``block_chars`` characters; only one block is on the driver at a time."""
    items = benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").select("item_id", "text").distinct()
    total = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    n = max(1, -(-2 * int(total) // block_chars) if total > block_chars else 1)
    for b in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b)
        block = [(r.item_id, normal(r.text)) for r in part.collect()]
        yield sorted({(i, t) for i, t in block if len(t) >= SHORTEST})


def with_leaks(docs: DataFrame, items: list[tuple], text: str = "text", rate: float = RATE, id_type: str = "bigint") -> DataFrame:
    """Adds the leaks of one block of items: an array of item_id, start, end and distance."""
    shared = docs.sparkSession.sparkContext.broadcast(items)

    @F.pandas_udf(f"array<struct<item_id:{id_type},start:long,end:long,distance:long>>")
    def leaks(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        matcher = Matcher(shared.value, rate)
        for batch in batches:
            yield pd.Series([matcher.leaks(t) for t in batch], dtype=object)

    return docs.withColumn("leaks", leaks(F.col(text)))


def _id_type(benchmark: DataFrame) -> str:
    return benchmark.schema["item_id"].dataType.simpleString()


def find_leaks(docs: DataFrame, benchmark: DataFrame, keys: tuple[str, ...] = ("doc_id",), rate: float = RATE,
               block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per document and item found in it: keys, item_id, start, end, distance."""
    out = None
    for items in _blocks(benchmark, block_chars):
        part = (with_leaks(docs.select(*keys, "text"), items, rate=rate, id_type=_id_type(benchmark)).where(F.size("leaks") > 0)
                .select(*keys, F.explode("leaks").alias("_l")).select(*keys, "_l.*"))
        out = part if out is None else out.unionByName(part)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The documents in which no item was found."""
    kept = docs.columns
    for n, items in enumerate(_blocks(benchmark, block_chars)):
        docs = written(docs, "decontaminated") if n else docs
        docs = with_leaks(docs, items, rate=rate, id_type=_id_type(benchmark)).where(F.size("leaks") == 0).select(*kept)
    return docs


@query("op1_decontamination")
def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark"))
