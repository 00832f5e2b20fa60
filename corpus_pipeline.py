"""A corpus pipeline of five operators; every stage works on all that its predecessor kept.

1. quality: documents that the classifier rejects go.
2. lines: later occurrences of repeated three-line windows go, and documents of which nothing is left.
3. groups: of documents linked by five-word shingles with a Jaccard similarity of 0.8 or more one stays.
4. leaks: documents that hold a benchmark item go.
5. packs: what is left is packed into sequences; this stage returns the pieces and their bins.

All stages but the last return the columns of documents; n_chars follows the text where the text changes.

Stages lower the session's ``spark.sql.execution.arrow.maxRecordsPerBatch`` to ``BATCH_ROWS``: with Spark's 10,000 a batch holds
a whole partition of texts, in the executor's JVM and again in its Python workers.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession, functions as F

from shoalmark.llm import decontamination, jaccard_join, line_dedup, packing, quality
from shoalmark.llm.common import read
from shoalmark.session import written

#: Texts that a task hands to Python at a time; a session with a lower limit keeps its own.
BATCH_ROWS = 500
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _small_batches(stage: Stage) -> Stage:
    """Run a stage with small batches; its result is computed later, so the setting stays."""

    @wraps(stage)
    def limited(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        own = int(spark.conf.get(_BATCH))
        if own <= 0 or own > BATCH_ROWS:
            spark.conf.set(_BATCH, str(BATCH_ROWS))
        return stage(spark, docs, sf_dir)

    return limited


def _apart(docs: DataFrame, taken: tuple[str, ...], stage: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Run a stage that adds the columns ``taken`` while columns of documents with these names are set aside."""
    aside = {c: f"_own_{c}" for c in docs.columns if c in taken}
    out = stage(docs.withColumnsRenamed(aside))
    return out.select(*[F.col(f"`{aside.get(c, c)}`").alias(c) for c in docs.columns])


@_small_batches
def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality.fit_quality(docs, read(spark, sf_dir, "labels"), F.lit(True))
    return _apart(docs, ("score", "predicted"), lambda d: quality.score_quality(d, model).where("predicted = 1"))


def lines_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    def stage(d: DataFrame) -> DataFrame:
        out = line_dedup.dedup_lines(d)
        changed = F.col("n_removed") > 0
        out = out.where(~changed | (F.length(F.trim(F.translate("text", "\n\t\r", "   "))) > 0))
        if "n_chars" in docs.columns:
            out = out.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars")))
        return out

    return _apart(docs, ("n_lines", "n_removed"), stage)


@_small_batches
def groups_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.one_per_group(docs, width=5, num=8, den=10, sizes=(256, 1024))


@_small_batches
def leaks_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _apart(docs, ("leaks",), lambda d: decontamination.decontaminate(d, read(spark, sf_dir, "benchmark")))


def packs_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES = [("quality", quality_stage), ("lines", lines_stage), ("groups", groups_stage), ("leaks", leaks_stage),
          ("packs", packs_stage)]

#: The classifier, the edit matching and the packing have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to documents; each result is written to the shared folder and read back."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
