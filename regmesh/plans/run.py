"""Run one registered report and write it as CSV (the reference's programs do this).

    spark-submit -m regmesh.plans.run org_budget --data DIR --out OUT [--input-bytes N --cores N]
    python -m regmesh.plans.run --list
    spark-submit -m regmesh.plans.run --all --data DIR --out OUT [--materialize]

The result is written by Spark in parallel; a report sorted with ``orderBy``
keeps its global order across the part files (range-partitioned sort).
``--input-bytes`` and ``--cores`` apply ``session.cluster_conf``, sized for
that input on that many cores.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from ..session import cluster_conf, ensure_checkpoint_dir, shared_dir
from ..sources import csv as csvio
from .queries import BUILDERS, REGISTRY, MaterializedCtx


def main(argv: list[str] | None = None) -> int:
    ap = argparse.ArgumentParser(prog="regmesh.plans.run")
    ap.add_argument("query", nargs="?")
    ap.add_argument("--data", help="folder holding the input parquet tables")
    ap.add_argument("--out", help="output folder (CSV with header); omit to print")
    ap.add_argument("--show", type=int, default=20, help="rows to print when --out is omitted")
    ap.add_argument("--list", action="store_true", help="list the registered queries")
    ap.add_argument("--all", action="store_true", help="run every query into OUT/<name>/")
    ap.add_argument("--materialize", action="store_true",
                    help="with --all: write each registry view once under spark.checkpoint.dir")
    ap.add_argument("--input-bytes", type=int, help="bytes of the input, for cluster settings")
    ap.add_argument("--cores", type=int, help="cores of the cluster, for cluster settings")
    args = ap.parse_args(argv)
    if (args.input_bytes is None) != (args.cores is None):
        ap.error("--input-bytes and --cores go together")

    def session(app: str) -> SparkSession:
        builder = SparkSession.builder.appName(app)
        if args.cores is not None:
            builder = builder.config(map=cluster_conf(args.input_bytes, args.cores))
        return builder.getOrCreate()

    if args.all:
        if not (args.data and args.out):
            ap.error("--all needs --data and --out")
        spark = session("regmesh-all")
        ensure_checkpoint_dir(spark)
        ctx = (MaterializedCtx(spark, args.data, shared_dir(spark, "registries"))
               if args.materialize else None)
        for name, fn in REGISTRY.items():
            df = BUILDERS[name](ctx) if ctx is not None else fn(spark, args.data)
            csvio.write_csv(df, f"{args.out.rstrip('/')}/{name}")
        return 0
    if args.list or not args.query:
        for name, fn in REGISTRY.items():
            print(f"{name:26s} {(fn.__doc__ or '').strip().splitlines()[0]}")
        return 0
    if args.query not in REGISTRY or not args.data:
        ap.error("a registered query and --data are required")
    spark = session(f"regmesh-{args.query}")
    ensure_checkpoint_dir(spark)
    df = REGISTRY[args.query](spark, args.data)
    if not args.out:
        df.show(args.show, truncate=False)
    else:
        csvio.write_csv(df, args.out)
    return 0


if __name__ == "__main__":
    sys.exit(main())
