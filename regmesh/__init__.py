"""regmesh: registry integration on PySpark.

Every operator is a plain ``DataFrame -> DataFrame`` function built from
Spark's own joins, aggregations and set operations.  Sub-packages:

* ``sources``   - parquet/CSV readers and writers, the derived fixture views
* ``functions`` - column expressions (normalisation, sentinels, safe casts)
* ``operators`` - overlap, resolution, merge, enrichment, triple-graph ops
* ``plans``     - the report pipelines and the query registry
"""

__version__ = "0.1.0"
