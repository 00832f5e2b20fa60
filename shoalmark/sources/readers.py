"""Reading and writing tables."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from ..functions.columns import survey_days

CSV_OPTIONS = dict(header=True, nullValue="NA", quote='"', escape='"')
# Reading: a line break within quotes is part of the value, and a value that does not fit its type is an error.
# Whole files are then read by one task each, so large exports should come in several files.
READ_OPTIONS = dict(CSV_OPTIONS, multiLine=True, mode="FAILFAST")


def read_csv(spark: SparkSession, path: str, schema: StructType | str, **options) -> DataFrame:
    """Header CSV with a declared schema; the text NA is missing, a BOM is dropped by the reader."""
    return spark.read.schema(schema).options(**{**READ_OPTIONS, **options}).csv(path)


def read_csv_by_header(spark: SparkSession, path: str, schema: StructType, **options) -> DataFrame:
    """CSV whose columns are matched to ``schema`` by name; unnamed columns are dropped."""
    text = spark.read.options(**{**READ_OPTIONS, **options}).csv(path)
    text = drop_unnamed(text)
    return text.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema])


def drop_unnamed(df: DataFrame) -> DataFrame:
    """Drop columns without a header, such as the row index an earlier export added."""
    return df.drop(*[c for c in df.columns if re.fullmatch(r"_c\d+", c)])


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Header CSV, quoted where needed so embedded commas and quotes survive."""
    df.write.mode(mode).options(**CSV_OPTIONS).csv(path)


def write_parquet(df: DataFrame, path: str, by: Sequence[str] = (), mode: str = "errorifexists") -> None:
    """Hand-over table between stages, partitioned by low-cardinality columns such as year."""
    out = df.write.mode(mode)
    (out.partitionBy(*by) if by else out).parquet(path)


def scan_grid(df: DataFrame, day_col: str = "day") -> DataFrame:
    """Long grid rows of the survey days; on a table partitioned by year with a day column both
    the year and the day condition reach the scan."""
    return df.where(survey_days(day_col))


def rownames_to_column(df: DataFrame, label_col: str, name: str, before: str | None = None) -> DataFrame:
    out = df.withColumnRenamed(label_col, name)
    rest = [c for c in out.columns if c != name]
    at = rest.index(before) if before else 0
    return out.select(*rest[:at], name, *rest[at:])
