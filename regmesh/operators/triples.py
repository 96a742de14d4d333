"""Triple-graph operators over a ``quads(g, s, p, o, o_type)`` DataFrame.

The reference sends one SPARQL request per input row to an external store.
Here a graph is data: a pattern is a chain of self-joins, updates are set
operations producing a new frame.  ``graph_store`` keeps a graph on disk and
changes only the folders that an update touches; the functions here are the
set semantics on any frame of quads.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written
from .skew import hot_keys, salted_join

QUAD_COLS = ("g", "s", "p", "o", "o_type")
TASK_QUADS = 500_000            # quads that one task of a snapshot sorts and writes


def _pat(quads: DataFrame, graph: str, pred: str) -> DataFrame:
    return quads.filter((F.col("g") == graph) & (F.col("p") == pred))


def identifier_index(quads: DataFrame, graph: str, *, type_pred: str, type_obj: str,
                     has_id: str, id_name: str, id_value: str, scheme: str,
                     wanted: DataFrame | None = None) -> DataFrame:
    """``(value, project)`` for the pattern::

        ?x type_pred type_obj . ?x has_id ?i . ?i id_name "scheme" . ?i id_value ?v

    Four filtered scans of the same graph joined on subject/object, with the
    literal constraints applied before the joins; ``min(project)`` per value
    stands for the reference's "first solution".  ``wanted(value)`` limits the
    index to the values of a lookup, before any other join.  An identifier
    node is reduced to its smallest project before it meets its values, so m
    projects and n values of one node give n rows, never m x n.

    A predicate's files are sorted and compress well, so a join planned by
    their bytes would broadcast millions of nodes through the driver.  So names
    and projects of a node meet in one aggregation, both joins can broadcast
    their right side only, and that is written plain (``session.written``).
    """
    typed = (_pat(quads, graph, type_pred).filter(F.col("o") == type_obj)
             .select(F.col("s").alias("x")).distinct())
    has = _pat(quads, graph, has_id).select(F.col("s").alias("x"), F.col("o").alias("i"))
    named = (_pat(quads, graph, id_name)
             .filter((F.col("o") == scheme) & (F.col("o_type") == "string"))
             .select(F.col("s").alias("i"), F.lit(None).cast("string").alias("x"), F.lit(True).alias("_named")))
    valued = (_pat(quads, graph, id_value).filter(F.col("o_type") == "string")
              .select(F.col("s").alias("i"), F.col("o").alias("value")).distinct())
    if wanted is not None:
        valued = valued.join(wanted.select("value").distinct(), "value", "left_semi")
    typed = written(typed, "typed-subjects", plain=True)
    per_node = (salted_join(has, typed, ["x"], "left_semi", _heavy(has, "x"))
                .select("i", "x", F.lit(False).alias("_named")).unionByName(named)
                .groupBy("i").agg(F.min("x").alias("x"), F.bool_or("_named").alias("_named"))
                .filter(F.col("_named") & F.col("x").isNotNull()).select("i", "x"))
    per_node = written(per_node, "identifier-nodes", plain=True)
    # an outer join: an inner one could broadcast the values
    return (salted_join(valued, per_node, ["i"], "left", _heavy(valued, "i"))
            .groupBy("value").agg(F.min("x").alias("projectURI"))
            .filter(F.col("projectURI").isNotNull()))


def _heavy(df: DataFrame, key: str) -> DataFrame:
    return hot_keys(df.groupBy(key).agg(F.count(F.lit(1)).alias("_r")), [key], "_r")


def resolve_identifier(items: DataFrame, index: DataFrame, value_col: str) -> DataFrame:
    """T1 for a whole table at once: attach ``projectURI`` (``''`` when absent).

    Each different value is looked up once: the values, counted map-side and written, meet the
    index (one row per value), which a bucketed table of ``graph_store`` joins where it lies.
    The items, their values and the index are written plain (``session.written``), so none is
    broadcast unless its rows are few: a caller that keeps found items only (``field_triples``)
    makes the last join an inner one, which could broadcast the items.
    The answers go back to the items, values carried by very many items salted across tasks
    (``skew.salted_join``).
    """
    it = written(items.withColumn("value", F.col(value_col).cast("string")), "lookup-items", plain=True)
    wanted = written(it.groupBy("value").agg(F.count(F.lit(1)).alias("_r")), "lookup-values", plain=True)
    found = wanted.join(index, "value").select("value", "projectURI")
    j = salted_join(it, found, ["value"], "left", hot_keys(wanted, ["value"], "_r")).drop("value")
    return j.withColumn("projectURI", F.coalesce(F.col("projectURI"), F.lit("")))


def insert_triples(quads: DataFrame, new: DataFrame) -> DataFrame:
    """Set-semantics insert; the result is the new snapshot."""
    return quads.unionByName(new_only(quads, new))


def new_only(quads: DataFrame, new: DataFrame) -> DataFrame:
    """The part of ``new`` not already in the graph (re-insert is a no-op).

    A set difference (a NULL is the same as another) by one aggregation of both: an anti join
    could broadcast the graph's quads, which it plans by their small files."""
    tagged = (new.select(*QUAD_COLS, F.lit(True).alias("_new"))
              .unionByName(quads.select(*QUAD_COLS, F.lit(False).alias("_new"))))
    return (tagged.groupBy(*QUAD_COLS).agg(F.bool_and("_new").alias("_new"))
            .filter(F.col("_new")).select(*QUAD_COLS))


def field_triples(resolved: DataFrame, graph: str, pred: str, label_col: str) -> DataFrame:
    """One typed-literal triple per resolved row (``projectURI`` not empty)."""
    found = resolved.filter(F.col("projectURI") != "")
    return found.select(F.lit(graph).alias("g"), F.col("projectURI").alias("s"),
                        F.lit(pred).alias("p"), F.col(label_col).alias("o"),
                        F.lit("string").alias("o_type"))


def annotate_counts(resolved: DataFrame) -> DataFrame:
    """T3 counters: rows found in the graph and rows not found."""
    return resolved.agg(F.count_if(F.col("projectURI") != "").alias("rows_in"),
                        F.count_if(F.col("projectURI") == "").alias("rows_out"))


def delete_triples(quads: DataFrame, doomed: DataFrame) -> DataFrame:
    """T4: remove exact quads (all five fields must match)."""
    return quads.join(doomed.select(*QUAD_COLS).distinct(), list(QUAD_COLS), "left_anti")


def delete_predicate(quads: DataFrame, graph: str, pred: str) -> DataFrame:
    """T5: drop every triple of ``pred`` in ``graph`` (the reference's intent)."""
    return quads.filter(~(F.col("g").eqNullSafe(graph) & F.col("p").eqNullSafe(pred)))


def clear_graph(quads: DataFrame, graph: str) -> DataFrame:
    """Drop a whole graph (a partition filter on disk)."""
    return quads.filter(~F.col("g").eqNullSafe(graph))


def list_graphs(quads: DataFrame, limit: int | None = None) -> DataFrame:
    """Distinct graph names in order; the first ``limit`` where one is given."""
    names = quads.select("g").distinct().orderBy("g")
    return names if limit is None else names.limit(limit)


def write_snapshot(quads: DataFrame, path: str, by: tuple[str, ...] = ("g",)) -> None:
    """Persist quads partitioned by graph (or by ``by``), to a new path (updates never
    overwrite the folders being read).  Within a graph, rows are clustered
    by predicate so a pattern scan's predicate filter skips row groups.  A
    range partitioning on (g, p, s) keeps files balanced even when one
    predicate (say ``rdf:type``) holds a third of all triples: its range is
    split by subject instead of landing in one writer task.  The number of
    ranges follows the number of quads (which are counted first), so a task's
    sort is the same size for any graph; merged by their bytes in the shuffle,
    where quads are small, ranges would grow with it."""
    tasks = max(1, -(-quads.count() // TASK_QUADS))
    (quads.repartitionByRange(tasks, "g", "p", "s").sortWithinPartitions("g", "p", "s")
     .write.mode("errorifexists").partitionBy(*by).parquet(path))


def read_quads(spark, path: str, graphs: list[str] | None = None) -> DataFrame:
    """Read a snapshot; a graph list becomes a partition filter, so only those
    graph directories are listed and read (``clear_graph`` on disk is simply
    not reading - or deleting - one directory)."""
    q = spark.read.parquet(path).select(*QUAD_COLS)
    return q.filter(F.col("g").isin(*graphs)) if graphs else q
