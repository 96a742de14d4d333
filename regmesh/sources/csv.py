"""CSV sources and sinks.

Reads always use an explicit schema: under ``inferSchema`` two files can
infer different types for one column and a positional union then fails at
run time on Spark 4 (ANSI).  Numeric and date columns that arrive dirty are
read as strings and converted with ``try_cast`` / ``try_to_date``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def read_csv(spark: SparkSession, paths: str | list[str], schema: StructType,
             multiline: bool = False, header: bool = True, corrupt: str | None = None) -> DataFrame:
    """Header row, RFC 4180 quoting (``"`` is quote and escape).

    A list of paths is one source (the reference's ``a.union(b).union(c)``
    of identical part files).  ``multiline`` makes each file one unsplittable
    task - ``ingest.ingest_csv`` converts such inputs to Parquet once.  ``corrupt``
    names a string column of ``schema`` that takes the text of a record which
    does not fit; without it such a record is a row of nulls.
    """
    reader = spark.read.schema(schema)
    if corrupt:
        reader = reader.option("columnNameOfCorruptRecord", corrupt)
    return (reader
            .option("header", header)
            .option("quote", '"')
            .option("escape", '"')
            .option("multiLine", multiline)
            .option("ignoreLeadingWhiteSpace", False)
            .option("ignoreTrailingWhiteSpace", False)
            .option("mode", "PERMISSIVE")
            .csv(paths))


def _writer(df: DataFrame):
    """Header, RFC 4180 quoting, and values written exactly: Spark's CSV writer
    trims leading/trailing white space by default, which would change names
    such as ``' ORG 3 '``."""
    return (df.write.mode("overwrite")
            .option("header", True)
            .option("quote", '"').option("escape", '"')
            .option("ignoreLeadingWhiteSpace", False)
            .option("ignoreTrailingWhiteSpace", False))


def write_csv(df: DataFrame, path: str) -> None:
    """K1/K2: parallel CSV write (one part file per partition, header in each).

    A frame is written by all tasks at once, never through one; an ``orderBy``-ed frame keeps its global order across the
    part files (range-partitioned sort).
    """
    _writer(df).csv(path)
