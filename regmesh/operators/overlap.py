"""Overlap statistics between registries.

Core idea: instead of one ``distinct().join().count()`` job per number, every
key of every (kind, side) is tagged and reduced once::

    union_all(kind, key, bit) -> groupBy(kind, key).agg(bit_or(bit) = mask)

Partial aggregation collapses duplicates map-side, so a hot key (one name
holding a third of all rows) leaves each map task as a single row.  All the
counts of a report are then ``count_if`` expressions over that one frame.

NULL rules (each caller chooses explicitly):
  * distinct count (A8): NULL is one value            -> ``null_counts=True``
  * join overlap (J2):   NULL never matches           -> ``null_counts=False``
  * intersect (U3):      a shared NULL is an overlap  -> ``null_counts=True``
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written
from .metrics import to_long
from .skew import hot_keys, salted_join


@dataclass(frozen=True)
class Source:
    """One input scanned once: every (kind, key expression) it contributes."""
    df: DataFrame
    side: int                                  # bit position of the source
    keys: tuple[tuple[str, Column | None], ...]  # (kind, key) pairs


@dataclass(frozen=True)
class Count:
    name: str
    kind: str
    sides: tuple[int, ...]
    null_counts: bool
    any_side: bool = False


@dataclass(frozen=True)
class Rows:
    """Number of input rows that produced ``kind`` (fan-in before de-duplication)."""
    name: str
    kind: str


ROWS = None   # key of a row-count-only kind (every row gives one NULL key)


def _key(key: Column | None) -> Column:
    return F.lit(None).cast("string") if key is None else key.cast("string")


def presence(sources: list[Source]) -> DataFrame:
    """``(kind, key, mask, n)``: one row per distinct key of each kind.

    Each source is read once: ``inline`` turns every input row into one
    (kind, key) row per requested key family, so a report that needs five
    distinct counts over one table still scans it a single time.
    """
    parts = []
    for src in sources:
        arr = F.array(*[F.struct(F.lit(kind).alias("kind"), _key(key).alias("key"))
                        for kind, key in src.keys])
        parts.append(src.df.select(F.inline(arr)).withColumn("bit", F.lit(1 << src.side)))
    u = reduce(DataFrame.unionByName, parts)
    return u.groupBy("kind", "key").agg(F.bit_or("bit").alias("mask"),
                                        F.count(F.lit(1)).alias("n"))


def count_expr(c: Count | Rows) -> Column:
    if isinstance(c, Rows):
        return F.coalesce(F.sum(F.when(F.col("kind") == F.lit(c.kind), F.col("n"))),
                          F.lit(0)).alias(c.name)
    req = sum(1 << s for s in c.sides)
    held = F.col("mask").bitwiseAND(F.lit(req))
    cond = (F.col("kind") == F.lit(c.kind)) & ((held > 0) if c.any_side else (held == F.lit(req)))
    if not c.null_counts:
        cond = cond & F.col("key").isNotNull()
    return F.count_if(cond).alias(c.name)


def overlap_metrics(sources: list[Source], counts: list[Count | Rows]) -> DataFrame:
    """All requested distinct/overlap/row counts in one aggregation, long form."""
    wide = presence(sources).agg(*[count_expr(c) for c in counts])
    return to_long(wide)


def distinct(name: str, kind: str, side: int) -> Count:
    """Distinct values of one side, NULL counted as a value."""
    return Count(name, kind, (side,), True)


def either(name: str, kind: str, *sides: int) -> Count:
    """Distinct values of the union of the sides, NULL counted as a value."""
    return Count(name, kind, sides, True, any_side=True)


def joined(name: str, kind: str, a: int, b: int) -> Count:
    """Keys present on both sides, NULL never matches."""
    return Count(name, kind, (a, b), False)


def intersected(name: str, kind: str, a: int, b: int) -> Count:
    """Keys present on both sides, a shared NULL counts."""
    return Count(name, kind, (a, b), True)


def _inline(df: DataFrame, pairs: list[tuple[str, Column]]) -> DataFrame:
    arr = F.array(*[F.struct(F.lit(k).alias("kind"), c.cast("string").alias("key"))
                    for k, c in pairs])
    return df.select(F.inline(arr))


def pair_counts(a: DataFrame, b: DataFrame,
                kinds: list[tuple[str, Column, Column]]) -> DataFrame:
    """Rows of ``a JOIN b ON key`` counted (fan-out included), per key kind.

    Each side is read once and reduced to ``(kind, key, n)``; the join is
    then 1:1 per key and the pair count is ``sum(n_a * n_b)``.  No pair is
    ever emitted, so a hot key costs one row instead of ``n_a * n_b``.
    NULL keys never match, as in the join.
    """
    ca = (_inline(a, [(n, ka) for n, ka, _ in kinds])
          .groupBy("kind", "key").agg(F.count(F.lit(1)).alias("na")))
    cb = (_inline(b, [(n, kb) for n, _, kb in kinds])
          .groupBy("kind", "key").agg(F.count(F.lit(1)).alias("nb")))
    j = ca.join(cb, ["kind", "key"])
    # pairs of big tables outgrow 64 bits
    product = F.col("na").cast("decimal(19,0)") * F.col("nb").cast("decimal(18,0)")
    wide = j.agg(*[F.coalesce(F.sum(F.when(F.col("kind") == n, product)),
                              F.lit(0)).alias(n) for n, _, _ in kinds])
    return to_long(wide, "decimal(38,0)")


def _pairs(parts: list[tuple[DataFrame, int, Column, Column]], k: str, v: str) -> DataFrame:
    """Distinct ``(k, v)`` pairs over several sources with the bit mask of their sources.

    Written once: every step of a report reads this frame, not the sources."""
    u = reduce(DataFrame.unionByName, [
        df.select(kc.alias(k), vc.alias(v), F.lit(1 << side).alias("bit"))
        for df, side, kc, vc in parts])
    return written(u.groupBy(k, v).agg(F.bit_or("bit").alias("m")), "pairs")


def _not_null_and(col: str, cond: Column) -> Column:
    """``col IS NOT NULL AND cond`` as one CASE, so Catalyst cannot split off
    ``col IS NOT NULL`` and push it below the aggregate that produced the
    frame (which would stop that aggregate's shuffle from being reused)."""
    return F.when(F.col(col).isNull(), F.lit(False)).otherwise(cond)


def _has(col: str, bits: int) -> Column:
    return F.col(col).bitwiseAND(F.lit(bits)) != 0


def names_sharing_keys(a: DataFrame, b: DataFrame, key_a: Column, key_b: Column,
                       name: str = "cleanName") -> DataFrame:
    """J10 both ways: ``(side, name)`` for names of one side whose key (title)
    also occurs on the other side.

    The reference joins the two sides on the title and projects the names,
    which fans out on popular titles.  Here both sides are reduced to
    distinct (title, name) pairs in one pass each, a per-title source mask
    is joined back (one row per title, never a fan-out; the heaviest titles
    are salted across tasks) and each pair is tested against it.
    """
    A, B = 1, 2
    # a NULL title never matches (inner join), so it is dropped for every branch alike
    p = (_pairs([(a, 0, key_a, F.col(name)), (b, 1, key_b, F.col(name))], "_t", name)
         .filter(F.col("_t").isNotNull()))
    # the weight (pairs per key) is counted through the mask so the pairs
    # stage stays identical in every branch and its shuffle is reused
    t = p.groupBy("_t").agg(F.bit_or("m").alias("tm"), F.count_if(F.col("m") != 0).alias("_r"))
    j = salted_join(p, t.drop("_r"), ["_t"], "inner", hot_keys(t, ["_t"], "_r"))
    side = F.explode(F.array(
        F.when(_has("m", B) & _has("tm", A), F.lit("B")),
        F.when(_has("m", A) & _has("tm", B), F.lit("A"))))
    return (j.select(side.alias("side"), name)
            .filter(F.col("side").isNotNull()).distinct())


def shared_title_delta(frames: list[DataFrame], pairs: list[tuple[str, int, int]],
                       name: str = "cleanName", title: str = "title") -> DataFrame:
    """E4 for several pairs of registries, as metrics.

    For each ``(prefix, x, y)`` (indexes into ``frames``):
      shared names   = |names(x) INTERSECT names(y)| (a shared NULL counts)
      titles_a / _b  = distinct titles of x's / y's rows whose name is shared
                       (the reference filters with ``isin``, so NULL names
                       never pass)
      delta          = titles_a - titles_b (may be negative; not a set difference)
      titles_only_a  = the true set difference: shared-name titles of x not in y

    Every frame is read once into distinct (name, title) pairs with a source
    mask; per-name title counts per source decide which names are shared in
    which pair; one join of the pairs with those per-name flags and one
    aggregation per title then serve every pair at once.
    """
    p = _pairs([(df, i, F.col(name), F.col(title)) for i, df in enumerate(frames)], name, title)
    # titles per source per name (counts, so the distinct pairs below stay one
    # shared stage instead of being re-derived from the sources)
    n = p.groupBy(name).agg(*[F.count_if(_has("m", 1 << i)).alias(f"_n{i}")
                              for i in range(len(frames))])
    weight = reduce(lambda x, y: x + y, [F.col(f"_n{i}") for i in range(len(frames))])

    def both(x: int, y: int) -> Column:
        return (F.col(f"_n{x}") > 0) & (F.col(f"_n{y}") > 0)

    names = n.agg(*[F.count_if(both(x, y)).alias(f"{pf}_shared_names") for pf, x, y in pairs])
    # one row per name with "shared in pair k" flags; NULL names never share
    flags = n.select(name, *[_not_null_and(name, both(x, y)).alias(f"_s{k}")
                             for k, (_, x, y) in enumerate(pairs)])
    j = salted_join(p, flags, [name], "inner", hot_keys(n, [name], weight), null_safe=True)
    t = j.groupBy(title).agg(*[F.bit_or(F.when(F.col(f"_s{k}"), F.col("m")).otherwise(F.lit(0)))
                               .alias(f"_t{k}") for k in range(len(pairs))])
    cols = []
    for k, (pf, x, y) in enumerate(pairs):
        ta = F.count_if(_has(f"_t{k}", 1 << x))
        tb = F.count_if(_has(f"_t{k}", 1 << y))
        only_a = F.count_if(_has(f"_t{k}", 1 << x) & ~_has(f"_t{k}", 1 << y))
        cols += [ta.alias(f"{pf}_titles_a"), tb.alias(f"{pf}_titles_b"),
                 (ta - tb).alias(f"{pf}_title_delta"), only_a.alias(f"{pf}_titles_only_a")]
    return to_long(names).unionByName(to_long(t.agg(*cols)))


def gained_projects(a: DataFrame, b_subjects: DataFrame, c: DataFrame,
                    name: str = "cleanName", project: str = "projectURI") -> DataFrame:
    """How many projects registry B brings for orgs A already has.

    orgs_a      = distinct names of A
    orgs_bc     = distinct names of C UNION B
    shared_orgs = names(a) JOIN names(c UNION b)        (NULL never matches)
    gained      = distinct projects of B rows whose name is shared

    All three sources are read once into distinct (name, project) pairs with a
    source mask; names and projects are then counted from that frame.
    """
    A, B, C = 1, 2, 4
    none = F.lit(None).cast("string")
    p = _pairs([(a, 0, F.col(name), none), (b_subjects, 1, F.col(name), F.col(project)),
                (c, 2, F.col(name), none)], name, project)
    n = p.groupBy(name).agg(F.count_if(_has("m", A)).alias("na"),
                            F.count_if(_has("m", B | C)).alias("nbc"))
    both = _not_null_and(name, (F.col("na") > 0) & (F.col("nbc") > 0))
    names = n.agg(F.count_if(F.col("na") > 0).alias("orgs_a"),
                  F.count_if(F.col("nbc") > 0).alias("orgs_bc"),
                  F.count_if(both).alias("shared_orgs"))
    shared = n.filter(both).select(name)
    g = (salted_join(p.filter(_has("m", B)), shared, [name], "left_semi",
                     hot_keys(n, [name], F.col("na") + F.col("nbc")), null_safe=True)
         .agg((F.count_distinct(F.col(project))
               + F.coalesce(F.max(F.col(project).isNull().cast("int")), F.lit(0)))
              .alias("gained_projects")))
    return to_long(names).unionByName(to_long(g))
