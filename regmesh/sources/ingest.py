"""One-time ingest of CSV extracts into Parquet, with the malformed records kept apart.

``PERMISSIVE`` reading turns a record that does not fit the schema into a row of nulls that nobody
sees.  Here the reader keeps the text of such a record; one pass over the files writes the good
rows and the rejects into two folders of one Parquet table, so a multi-line file, which one task
must read, is parsed once and every later read is split, pruned and pushed down to.

Reasons, the first one that holds:

* ``quote``  the record has an odd number of quotes (a quote never closed, or one too many);
* ``short``, ``long``  fewer or more fields than the schema;
* ``type``   a value does not fit its declared type.

Records are read line by line unless ``multiline``; there an unclosed quote swallows what follows
up to the next quote, as in any RFC 4180 reader, and the swallowed records count as one reject.
Blank lines are no records.  A file without records gives two empty tables.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

from ..session import shared_dir
from .csv import read_csv

RECORD = "_record"
REASONS = ("quote", "short", "long", "type")


@dataclass(frozen=True)
class Ingested:
    """The stored result of an ingest."""
    good: DataFrame         # the schema's columns
    rejects: DataFrame      # record, reason

    def counts(self) -> DataFrame:
        """``status, n_records``: good rows and rejects by reason, zeros included."""
        tagged = (self.good.select(F.lit("good").alias("status"))
                  .unionByName(self.rejects.select(F.col("reason").alias("status"))))
        found = tagged.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
        return (found.agg(*[F.coalesce(F.sum(F.when(F.col("status") == s, F.col("n"))), F.lit(0)).alias(s)
                            for s in ("good", *REASONS)])
                .unpivot([], ["good", *REASONS], "status", "n_records"))


def reject_reason(record: Column, n_fields: int) -> Column:
    """Why a record does not fit: its quotes and separators counted outside of quoted parts."""
    quotes = F.length(record) - F.length(F.replace(record, F.lit('"'), F.lit("")))
    bare = F.regexp_replace(record, '"[^"]*"', "")
    fields = F.length(bare) - F.length(F.replace(bare, F.lit(","), F.lit(""))) + 1
    return (F.when(quotes % 2 == 1, "quote").when(fields < n_fields, "short")
            .when(fields > n_fields, "long").otherwise("type"))


def ingest_csv(spark: SparkSession, paths: str | list[str], schema: StructType, multiline: bool = False,
               header: bool = True, name: str = "ingest") -> Ingested:
    """Parse the files once; the good rows and the rejects, read back from Parquet."""
    wide = StructType([*schema.fields, StructField(RECORD, StringType(), True)])
    raw = read_csv(spark, paths, wide, multiline=multiline, header=header, corrupt=RECORD)
    path = shared_dir(spark, name)
    bad = F.col(RECORD).isNotNull()
    (raw.withColumn("reason", F.when(bad, reject_reason(F.col(RECORD), len(schema.fields))))
     .withColumn("rejected", bad).write.partitionBy("rejected").parquet(path))
    stored = StructType([*wide.fields, StructField("reason", StringType(), True),
                         StructField("rejected", BooleanType(), True)])
    back = spark.read.schema(stored).parquet(path)
    return Ingested(back.filter(~F.col("rejected")).select(*schema.names),
                    back.filter("rejected").select(F.col(RECORD).alias("record"), "reason"))
