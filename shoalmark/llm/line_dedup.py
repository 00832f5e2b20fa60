"""Removal of repeated passages by overlapping windows of three lines.

Every run of three consecutive lines is hashed (two 64-bit hashes with different seeds). A window that occurs more than
once in the corpus keeps its first occurrence, in the order of (doc_id with null last, hash of the text, line number);
all positions covered by later occurrences are merged and removed. A removed line always has an equal line earlier in
that order, so the first occurrence of a line is never lost. Windows of nothing but empty lines are not compared.

The first occurrence of a window is a plain minimum, reduced within each task before the shuffle, so a window that a
third of all rows share is one row per task. The windows then meet the repeated ones in an equi-join, where adaptive
execution splits hot windows; nothing is gathered but the removed line numbers of one document. Only texts that lose a
line are moved: the others are told apart by a short table of keys.

Rows: a null or empty text has one empty line (null stays null). Texts of fewer than three lines have no window and
stay as they are. Repeated rows (same doc_id and text) count as one document and are treated alike; rows with one
doc_id and different texts are documents of their own. Existing columns n_lines and n_removed are replaced; other columns
keep their values, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import written
from .common import by_ids, read
from .registry import query

WIDTH = 3


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def windows(docs: DataFrame, text: str = "text", width: int = WIDTH) -> DataFrame:
    """One row per window: its two hashes and its place (flag of a null id, id, hash of the text, first line)."""
    lines = F.col("_lines")
    at = lambda i: [F.get(lines, i + k) for k in range(width)]

    def one(i: Column) -> Column:
        filled = F.length(F.concat(*at(i))) > 0
        return F.when(filled, F.struct(F.xxhash64(*at(i)).alias("h1"), F.xxhash64(F.lit(width), *at(i)).alias("h2"),
                                       i.alias("line")))

    return (docs.select("doc_id", F.xxhash64(text).alias("_hash"), _lines(F.col(text)).alias("_lines"))
            .where(F.size("_lines") >= width)
            .select("doc_id", "_hash", F.explode(F.transform(F.sequence(F.lit(0), F.size("_lines") - width), one)).alias("w"))
            .where("w IS NOT NULL")
            .select("w.h1", "w.h2", F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"),
                                             F.col("_hash").alias("hash"), F.col("w.line").alias("line")).alias("place")))


def dedup_lines(docs: DataFrame, text: str = "text", width: int = WIDTH) -> DataFrame:
    """Replaces the text by what is kept of it and adds n_lines and n_removed."""
    found = windows(docs, text, width)
    repeated = (found.groupBy("h1", "h2").agg(F.min("place").alias("first"), F.max("place").alias("last"))
                .where("first < last").drop("last"))
    later = found.join(repeated, ["h1", "h2"]).where("place > first")
    key = lambda i, h: F.xxhash64(F.col(i).isNull(), i, h)  # noqa: E731  equal keys of different texts only cost a join
    removed = written(later.groupBy(F.col("place.id").alias("_id"), F.col("place.hash").alias("_of"))
                      .agg(F.collect_set("place.line").alias("_starts")).withColumn("_key", key("_id", "_of")), "removed-lines")
    row = F.struct(F.lit(1).alias("_"), *[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    rows = (docs.select(row, F.col("doc_id").alias("_doc"), F.col(text).alias("_text"), F.xxhash64(text).alias("_hash"))
            .withColumn("_key", key("_doc", "_hash")))
    keys = removed.select("_key").distinct()
    whole = by_ids(rows, keys, "_key", "left_anti").withColumn("_starts", F.lit(None).cast("array<int>"))
    cut = by_ids(rows, keys, "_key", "left_semi").join(
        removed.drop("_key"), F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_of")), "left")
    covered = F.array_distinct(F.flatten(F.transform("_starts", lambda s: F.sequence(s, s + width - 1))))
    every = F.sequence(F.lit(0), F.size("_lines") - 1)
    out = (cut.select("_row", "_text", "_starts").unionByName(whole.select("_row", "_text", "_starts"))
           .withColumn("_lines", _lines(F.col("_text")))
           .withColumn("_kept", F.when(F.col("_starts").isNotNull(), F.array_except(every, covered))))
    left = F.when(F.col("_kept").isNotNull(), F.array_join(F.transform("_kept", lambda i: F.get("_lines", i)), "\n")).otherwise(F.col("_text"))
    return out.select(
        *[(left if c == text else F.col(f"_row.`{c}`")).alias(c) for c in docs.columns if c not in ("n_lines", "n_removed")],
        F.size("_lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("_lines") - F.size("_kept"), F.lit(0)).cast("long").alias("n_removed"))


SQL = """
WITH docs AS (
  SELECT row_number() OVER () AS n, doc_id, text, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
windows AS (
  SELECT n, doc_id, i, lines[i + 1] AS a, lines[i + 2] AS b, lines[i + 3] AS c
  FROM docs, unnest(range(0, len(lines) - 2)) AS t(i)
  WHERE lines[i + 1] <> '' OR lines[i + 2] <> '' OR lines[i + 3] <> ''),
firsts AS (
  SELECT a, b, c, min(struct_pack(d := doc_id, i := i)) AS first FROM windows GROUP BY a, b, c HAVING count(*) > 1),
removed AS (
  SELECT DISTINCT n, i + k AS line FROM windows JOIN firsts USING (a, b, c), unnest([0, 1, 2]) AS u(k)
  WHERE struct_pack(d := doc_id, i := i) > first),
kept AS (
  SELECT l.n, count(*) AS n_kept, string_agg(l.line_text, chr(10) ORDER BY l.line) AS kept_text
  FROM (SELECT n, i AS line, lines[i + 1] AS line_text FROM docs, unnest(range(0, len(lines))) AS t(i)) l
  ANTI JOIN removed r ON l.n = r.n AND l.line = r.line
  GROUP BY l.n)
SELECT doc_id, CASE WHEN text IS NULL THEN NULL ELSE coalesce(kept_text, '') END AS text,
       CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - coalesce(n_kept, 0) AS BIGINT) AS n_removed
FROM docs LEFT JOIN kept USING (n)
"""


@query("op8_line_dedup", SQL)
def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "text", "n_lines", "n_removed")
