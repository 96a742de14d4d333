"""A stored triple graph whose updates touch only what they change.

A snapshot is a catalogued external table over ``(s, o, o_type)`` partitioned by graph, predicate
and batch; its partitions are folders, and the catalog's partition list is the whole of what a
snapshot is.  An update makes a new snapshot that lists the untouched folders of the old one next
to the folders it has written itself:

* ``insert`` (T2/T3) compares the new quads with just the (graph, predicate) partitions that they
  touch and appends one batch with the ones that were not there; no old file is written again;
* ``delete`` (T4) rewrites only the batches that hold a doomed quad;
* ``delete_predicate`` (T5) and ``clear_graph`` (T6) leave partitions out of the list, without
  reading or writing a quad; ``graphs`` (T7) reads the list alone;
* ``identifier_index`` (T1) is a table bucketed and sorted by value, built once for the folders it
  was read from and found again by every later lookup, which joins it without shuffling it.

Old snapshots stay readable.  Folders of a batch are written by all tasks at once (range
partitioned by graph, predicate and subject, so a predicate with a third of all quads is split),
and committed by Spark before any table lists them: a lost executor costs task retries only.

A quad without a graph or a predicate (null or empty) names no partition; ``create`` and ``insert``
refuse such rows (``quads_without_partition`` counts them).  The driver handles partition names
only: as many as there are (graph, predicate, batch) triples, as for any partitioned table.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable
from dataclasses import dataclass
from hashlib import sha256
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import PLAIN, shared_dir, written
from . import triples
from .triples import QUAD_COLS

BUCKET_ROWS = 2_000_000         # index rows in one bucket
MIN_BUCKETS = 8


@dataclass(frozen=True)
class Folder:
    """One partition of a snapshot; ``path`` is relative to the store's root."""
    g: str
    p: str
    batch: str
    path: str


def _literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _values(spec: str) -> list[str]:
    """The values of a ``k=v/k=v`` partition name as the catalog prints it."""
    return [unquote(part.split("=", 1)[1]) for part in spec.split("/")]


def _specs(spark: SparkSession, name: str) -> list[str]:
    return [r["partition"] for r in spark.sql(f"SHOW PARTITIONS {name}").toLocalIterator()]


def quads_without_partition(quads: DataFrame) -> DataFrame:
    """The rows that no partition can hold."""
    return quads.filter(F.coalesce(F.col("g"), F.lit("")).eqNullSafe("")
                        | F.coalesce(F.col("p"), F.lit("")).eqNullSafe(""))


class Snapshot:
    """One state of a stored graph: a catalogued list of partition folders under ``root``."""

    def __init__(self, spark: SparkSession, root: str, name: str):
        self.spark, self.root, self.name = spark, root, name

    # ---- reading ----

    def quads(self) -> DataFrame:
        """All quads; filters on ``g`` and ``p`` prune folders."""
        return self.spark.table(self.name).select(*QUAD_COLS)

    def folders(self) -> list[Folder]:
        """The partition list, from the catalog."""
        found = []
        for spec in _specs(self.spark, self.name):
            g, p, batch = _values(spec)
            found.append(Folder(g, p, batch, f"{batch}/{spec.rsplit('/', 1)[0]}"))
        return found

    def graphs(self, limit: int | None = None) -> DataFrame:
        """Graph names in order, from the partition list; no data file is read."""
        listed = self.spark.sql(f"SHOW PARTITIONS {self.name}")
        escaped = F.regexp_extract("partition", "^g=([^/]*)", 1)
        names = (listed.select(F.url_decode(F.replace(escaped, F.lit("+"), F.lit("%2B"))).alias("g"))
                 .distinct().orderBy("g"))
        return names if limit is None else names.limit(limit)

    def batch(self, name: str) -> DataFrame:
        """The quads of one batch."""
        return self.spark.table(self.name).filter(F.col("batch") == name).select(*QUAD_COLS)

    # ---- updates ----

    def insert(self, new: DataFrame) -> tuple[Snapshot, str]:
        """Set-semantics insert; the new snapshot and the name of the appended batch."""
        staged = self._write(_whole(new.select(*QUAD_COLS)).distinct())
        touched = {(f.g, f.p) for f in staged.folders()}
        old = [f for f in self.folders() if (f.g, f.p) in touched]
        if not old:
            added = staged
        else:
            there = self._listing(old)
            added = self._write(triples.new_only(there.quads(), staged.quads()))
            self._forget(staged, there)
        name = added.name.rsplit("_", 1)[1]
        after = self._listing([*self.folders(), *added.folders()])
        self._forget(added)
        return after, name

    def delete(self, doomed: DataFrame) -> Snapshot:
        """T4: without the exact quads of ``doomed``; only batches that hold one are rewritten."""
        staged = self._write(_whole(doomed.select(*QUAD_COLS)).distinct())
        touched = {(f.g, f.p) for f in staged.folders()}
        near = self._listing([f for f in self.folders() if (f.g, f.p) in touched])
        hit = (self.spark.table(near.name).join(staged.quads(), list(QUAD_COLS), "left_semi")
               .select("g", "p", "batch").distinct())
        doomed_in = {(r["g"], r["p"], r["batch"]) for r in hit.toLocalIterator()}
        old = [f for f in near.folders() if (f.g, f.p, f.batch) in doomed_in]
        after = self
        if old:
            held = self._listing(old)
            left = self._write(held.quads().join(staged.quads(), list(QUAD_COLS), "left_anti"))
            after = self._listing([*[f for f in self.folders() if f not in old], *left.folders()])
            self._forget(held, left)
        self._forget(staged, near)
        return after

    def delete_predicate(self, graph: str, pred: str) -> Snapshot:
        """T5: without any quad of ``pred`` in ``graph``; a change of the list alone."""
        return self._listing([f for f in self.folders() if (f.g, f.p) != (graph, pred)])

    def clear_graph(self, graph: str) -> Snapshot:
        """Without a whole graph; a change of the list alone."""
        return self._listing([f for f in self.folders() if f.g != graph])

    # ---- the identifier index ----

    def identifier_index(self, graph: str, *, type_pred: str, type_obj: str, has_id: str, id_name: str,
                         id_value: str, scheme: str) -> DataFrame:
        """``(value, projectURI)`` of the pattern, bucketed and sorted by value.

        The table is named after the folders that the pattern reads, so a snapshot that shares them
        (an insert of other predicates, say) shares the index, and any other one gets its own."""
        preds = (type_pred, has_id, id_name, id_value)
        read = sorted(f.path for f in self.folders() if f.g == graph and f.p in preds)
        key = repr((self.root, graph, preds, type_obj, scheme, read))
        name = f"regmesh_ids_{sha256(key.encode()).hexdigest()[:24]}"
        if not self.spark.catalog.tableExists(name):
            quads = self.quads()
            rows = quads.filter((F.col("g") == graph) & (F.col("p") == id_value)).count()
            n = max(MIN_BUCKETS, -(-rows // BUCKET_ROWS))
            index = triples.identifier_index(quads, graph, type_pred=type_pred, type_obj=type_obj,
                                             has_id=has_id, id_name=id_name, id_value=id_value, scheme=scheme)
            (index.repartition(n, "value").write.bucketBy(n, "value").sortBy("value").options(**PLAIN)
             .option("path", shared_dir(self.spark, "identifier-index")).saveAsTable(name))
        return self.spark.table(name)

    # ---- folders and lists ----

    def _write(self, quads: DataFrame) -> Snapshot:
        # a batch is the result of joins: computed once, then counted, sampled and sorted
        return _written(self.spark, self.root, written(quads, "graph-batch"))

    def _forget(self, *lists: Snapshot) -> None:
        """Drop helper lists from the catalog; the tables are external, so folders stay."""
        for one in lists:
            self.spark.sql(f"DROP TABLE {one.name}")

    def _listing(self, folders: Iterable[Folder]) -> Snapshot:
        return _listed(self.spark, self.root, folders)


def _whole(quads: DataFrame) -> DataFrame:
    """``quads``, raising at run time where a row names no partition."""
    def named(c: str):
        return F.when(F.length(c) > 0, F.col(c)).otherwise(
            F.raise_error(F.lit(f"a quad needs a value in {c}")).cast("string")).alias(c)
    return quads.select(named("g"), "s", named("p"), "o", "o_type")


def _listed(spark: SparkSession, root: str, folders: Iterable[Folder], name: str | None = None) -> Snapshot:
    """A snapshot table over the given folders."""
    name = name or f"regmesh_quads_{uuid.uuid4().hex}"
    spark.sql(f"CREATE TABLE {name} (s STRING, o STRING, o_type STRING, g STRING, p STRING, batch STRING) "
              f"USING parquet PARTITIONED BY (g, p, batch) LOCATION {_literal(root)}")
    parts = [f"PARTITION (g={_literal(f.g)}, p={_literal(f.p)}, batch={_literal(f.batch)}) "
             f"LOCATION {_literal(f'{root}/{f.path}')}" for f in folders]
    for at in range(0, len(parts), 500):
        spark.sql(f"ALTER TABLE {name} ADD {' '.join(parts[at:at + 500])}")
    return Snapshot(spark, root, name)


def _written(spark: SparkSession, root: str, quads: DataFrame) -> Snapshot:
    """``quads`` written as one batch, and the snapshot of that batch alone."""
    batch = uuid.uuid4().hex
    path = f"{root}/{batch}"
    triples.write_snapshot(quads.select(*QUAD_COLS), path, by=("g", "p"))
    probe = f"regmesh_batch_{batch}"
    spark.sql(f"CREATE TABLE {probe} (s STRING, o STRING, o_type STRING, g STRING, p STRING) "
              f"USING parquet PARTITIONED BY (g, p) LOCATION {_literal(path)}")
    spark.sql(f"MSCK REPAIR TABLE {probe}")              # lists folders, reads no file
    specs = _specs(spark, probe)
    spark.sql(f"DROP TABLE {probe}")                      # external: the folders stay
    return _listed(spark, root, [Folder(*_values(s), batch, f"{batch}/{s}") for s in specs],
                   f"regmesh_quads_{batch}")


def create(spark: SparkSession, quads: DataFrame) -> Snapshot:
    """A new store under the shared folder, holding ``quads`` (as they are, repeated ones too)."""
    return _written(spark, shared_dir(spark, "graph"), _whole(quads.select(*QUAD_COLS)))


def session_graph(spark: SparkSession, key: str, quads: DataFrame) -> Snapshot:
    """The graph stored for ``key`` in this application: loaded at first use, then shared by every
    query; updates make snapshots beside it."""
    name = f"regmesh_graph_{sha256(f'{spark.sparkContext.applicationId}|{key}'.encode()).hexdigest()[:24]}"
    if not spark.catalog.tableExists(name):
        loaded = create(spark, quads)
        return _listed(spark, loaded.root, loaded.folders(), name)
    found = spark.sql(f"DESCRIBE TABLE EXTENDED {name}").filter(F.col("col_name") == "Location").first()
    return Snapshot(spark, found["data_type"], name)
