"""Entity resolution.

The reference collects name groups to the driver, builds a mutable map and
reads it back in a UDF; here each step is a join against an aggregated
frame, so nothing passes through the driver and the work grows with the
cluster.  Groups are never materialised as arrays: a hot name that owns a
third of all URIs would otherwise become one huge row in one task.  Group
facts are aggregates (count, min) and membership stays in long form.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written
from . import skew
from .merge import min_per_key
from .skew import hot_keys, salted_join

CHUNK = 1000        # members in one chunk of an alias group


def alias_members(orgs: DataFrame, name: str = "cleanName", uri: str = "orgURI") -> DataFrame:
    """Distinct ``(name, uri)`` membership, NULL URIs dropped (``collect_set`` skips them)."""
    return orgs.select(name, uri).filter(F.col(uri).isNotNull()).distinct()


def alias_groups(orgs: DataFrame, name: str = "cleanName", uri: str = "orgURI") -> DataFrame:
    """E5: per clean name, the number of distinct URIs and the group's first URI.

    Distinct (name, uri) first (hash aggregate with map-side combine), then
    count and min per name on the reduced pairs: a hot name that owns many
    URIs is two partial aggregations, never one big set.
    """
    return (alias_members(orgs, name, uri)
            .groupBy(name)
            .agg(F.count(F.lit(1)).alias("n_uris"), F.min(uri).alias("canonicalURI")))


def alias_membership(orgs: DataFrame, name: str = "cleanName", uri: str = "orgURI",
                     chunk: int = CHUNK) -> DataFrame:
    """E5: every ``(name, uri)`` member of the groups with several URIs, with the group's size and
    the number of its chunk: a group is cut, in URI order, into chunks of ``chunk`` members, so a
    caller that wants sets builds them per ``(name, chunk)`` and never holds a hot group whole.

    A member's rank needs no window over its group: members are range-partitioned and sorted by
    (name, uri) and written with their place in the partition.  A group is then a run in each
    partition that it touches; the runs before a member's own (one row per group and partition)
    give its rank.  NULL names and URIs are no members.
    """
    members = written(alias_members(orgs, name, uri).filter(F.col(name).isNotNull()), "alias-members")
    sizes = members.groupBy(name).agg(F.count(F.lit(1)).alias("n_uris")).filter(F.col("n_uris") > 1)
    multi = salted_join(members, sizes, [name], "inner", hot_keys(sizes, [name], "n_uris"))
    placed = written(multi.repartitionByRange(name, uri).sortWithinPartitions(name, uri)
                     .withColumn("_at", F.monotonically_increasing_id())
                     # the partition's number is in the upper bits of the id
                     .withColumn("_part", F.shiftright("_at", 33)), "alias-ranks")
    runs = placed.groupBy(name, "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    run = F.struct("_part", "_first", "_n")
    before = F.aggregate(F.slice("_runs", 1, F.col("_i")), F.lit(0).cast("bigint"), lambda s, r: s + r["_n"])
    starts = (runs.groupBy(name).agg(F.array_sort(F.collect_list(run)).alias("_runs"))
              .select(name, "_runs", F.posexplode("_runs").alias("_i", "_r"))
              .select(name, "_r._part", "_r._first", before.alias("_before")))
    rank = F.col("_at") - F.col("_first") + F.col("_before")
    return (placed.join(starts, [name, "_part"])
            .select(name, uri, "n_uris", F.floor(rank / F.lit(chunk)).cast("bigint").alias("chunk")))


def canonical_map(members: DataFrame, name: str = "cleanName", uri: str = "orgURI") -> DataFrame:
    """E6 on distinct ``(name, uri)`` pairs: ``(uri, canonicalURI)``.

    A URI in a multi-URI name group is replaced by the group's smallest URI;
    a URI in several groups takes the smallest of those; a URI whose names
    are all NULL keeps itself.  (Singleton groups map a URI to itself, which
    never beats a multi-URI group's minimum, so one ``min`` covers both.)
    Membership is exact - not the substring test of the reference - and
    there is no transitive closure (the reference has none).

    The group minimum is joined back null-safely and NULL names are masked
    afterwards, and the group size (a count, which Catalyst cannot treat as
    duplicate-insensitive) decides membership: both branches then read the
    very same ``members`` plan, so its shuffle is reused instead of the
    sources being scanned twice.  The heaviest groups are salted across
    tasks (``skew.salted_join``), so a name owning a third of all URIs does
    not become one task.
    """
    gmin = members.groupBy(name).agg(F.min(uri).alias("_gmin"), F.count(F.lit(1)).alias("_size"))
    j = salted_join(members, gmin, [name], "left", hot_keys(gmin, [name], "_size"), null_safe=True)
    in_group = F.col(name).isNotNull() & (F.col("_size") > 1)
    per_uri = j.groupBy(uri).agg(F.min(F.when(in_group, F.col("_gmin"))).alias("_m"))
    return per_uri.select(F.col(uri), F.coalesce(F.col("_m"), F.col(uri)).alias("canonicalURI"))


def canonical_uri(orgs: DataFrame, name: str = "cleanName", uri: str = "orgURI") -> DataFrame:
    """``(orgURI, canonicalURI)`` for every distinct non-NULL URI; the pairs are written
    once, so the map, its minima and its hot list read them and not the registries."""
    members = written(alias_members(orgs, name, uri), "alias-members")
    return (canonical_map(members, name, uri)
            .select(F.col(uri).alias("orgURI"), "canonicalURI"))


def flag_multi_row_names(orgs: DataFrame, name: str = "cleanName",
                         source: str = "source", out: str = "multi_row_name") -> DataFrame:
    """True when the name occurs on more than one row of its own source.

    Quirk c: rows are (org, title), so an org with two titles is flagged.
    A NULL name gives NULL, as ``isin`` does.  Aggregate + join instead of a
    window (a window would put a hot name in one task); the heaviest names
    are salted across tasks in the join.  The repeated names, one row each, are
    written once, so the sources are read twice: to count and to flag.
    """
    dup = written(orgs.filter(F.col(name).isNotNull())
                  .groupBy(source, name).agg(F.count(F.lit(1)).alias("_rows"))
                  .filter(F.col("_rows") > 1), "multi-row-names")
    hot = hot_keys(dup, [source, name], "_rows")
    j = salted_join(orgs, dup.select(source, name, F.lit(True).alias("_dup")), [source, name],
                    "left", hot)
    return (j.withColumn(out, F.when(F.col(name).isNull(), F.lit(None).cast("boolean"))
                         .otherwise(F.coalesce(F.col("_dup"), F.lit(False))))
            .drop("_dup"))


def merged_publications(orgs: DataFrame, name: str = "cleanName", uri: str = "orgURI",
                        org_name: str = "orgName", title: str = "title") -> DataFrame:
    """Publications per resolved organisation.

    Semantics: rows get their canonical URI (E6); each canonical URI gets one
    representative name (``min`` of its raw names, quirk a4); distinct
    (canonical URI, title) pairs are counted per representative name.

    Plan: the large path - the rows' (uri, title), their canonical URI,
    distinct (canonical, title), count per canonical - is hash-only (the
    heaviest URIs salted in the join) and makes titles distinct once.  Names travel on the small path: one
    minimum per URI, then per canonical URI.  Per canonical URI only a count
    and a minimum travel, never a set of names or titles.
    """
    live = orgs.filter(F.col(uri).isNotNull())
    # the distinct rows and the map are written once, so membership, names,
    # titles and hot lists read them instead of the registries; no step needs
    # all name variants of a URI in one task
    base = written(live.select(name, uri, org_name, title).distinct(), "org-titles")
    members = written(base.select(name, uri).distinct(), "alias-members")
    cmap = written(canonical_map(members, name, uri), "canonical-map")
    # small path: representative name per canonical URI
    per_uri_name = min_per_key(base, [uri], [org_name], ["_n"], empty=None)
    names = (per_uri_name.join(cmap, uri)
             .groupBy("canonicalURI").agg(F.coalesce(F.min("_n"), F.lit("")).alias("orgName")))
    # large path: distinct titles per canonical URI
    hot = hot_keys(base.groupBy(uri).agg(F.count(F.lit(1)).alias("_t")), [uri], "_t")
    titles = (salted_join(base.select(uri, title), cmap, [uri], "inner", hot)
              .select("canonicalURI", title).distinct()
              .groupBy("canonicalURI").agg(F.count(F.lit(1)).alias("_titles")))
    return (titles.join(names, "canonicalURI")
            .groupBy("orgName")
            .agg(F.sum("_titles").cast("bigint").alias("numberOfPublications"))
            .orderBy(F.desc("numberOfPublications"), F.asc("orgName")))


def with_canonical(orgs: DataFrame, uri: str = "orgURI", out: str = "newOrgURI",
                   name: str = "cleanName") -> DataFrame:
    """Attach the canonical URI to every row (row count unchanged; NULL URI stays NULL)."""
    members = written(alias_members(orgs, name, uri), "alias-members")
    cmap = canonical_map(members, name, uri).withColumnRenamed(uri, "_u")
    return (orgs.join(cmap, orgs[uri] == cmap["_u"], "left")
            .withColumn(out, F.col("canonicalURI"))
            .drop("_u", "canonicalURI"))


def names_over(groups: DataFrame, n: int) -> DataFrame:
    """Alias groups with more than ``n`` URIs."""
    return groups.filter(F.col("n_uris") > n)


def repositories_of(orgs: DataFrame, name: str = "cleanName", source: str = "source") -> DataFrame:
    """For a name present in several sources, the *other* sources holding it.

    The set per name is bounded by the number of sources (not by the data),
    so ``collect_set`` is safe here.
    """
    present = orgs.select(name, source).filter(F.col(name).isNotNull()).distinct()
    # built from ``present`` (with a count, so Catalyst keeps that distinct)
    # so both sides of the join read one reused stage
    srcs = (present.groupBy(name)
            .agg(F.count(F.lit(1)).alias("_n"), F.array_sort(F.collect_set(source)).alias("_all"))
            .filter(F.col("_n") > 1))
    return (present.join(srcs, name)
            .select(name, source,
                    F.concat_ws(",", F.array_except("_all", F.array(F.col(source))))
                    .alias("other_sources")))


def rows_per_key(df: DataFrame, *keys: str) -> DataFrame:
    """Rows per key, largest first (A1 + O1)."""
    return df.groupBy(*keys).count().orderBy(F.desc("count"), *[F.asc(k) for k in keys])


def multi_valued(df: DataFrame, key: str, attr: str, out: str) -> DataFrame:
    """Keys with more than one distinct ``attr`` value."""
    return (df.groupBy(key).agg(F.count_distinct(attr).alias(out))
            .filter(F.col(out) > 1))


# --- acronym matching -------------------------------------------------------

def _lower_acronym(df: DataFrame) -> DataFrame:
    return df.withColumn("acronym", F.lower("acronym"))


def acronym_new(subjects: DataFrame, base: DataFrame) -> DataFrame:
    """Distinct subject rows whose lower(acronym) is unknown to ``base``.

    NULL acronyms are kept (an anti join never matches NULL).
    """
    keys = _lower_acronym(base).select("acronym").filter(F.col("acronym").isNotNull()).distinct()
    return _distinct_join(_lower_acronym(subjects), keys, ["acronym"], "left_anti")


def _distinct_join(rows: DataFrame, answers: DataFrame, keys: list[str], how: str) -> DataFrame:
    """The distinct ``rows`` joined with one answer per key, in one shuffle of the rows; the rows
    are read once more to count them per key (at least as many as distinct ones)."""
    weights = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_r"))
    return salted_join(rows, answers, keys, how, hot_keys(weights, keys, "_r"), distinct=True)


def _acronym_rows(base: DataFrame) -> DataFrame:
    return (_lower_acronym(base).filter(F.col("acronym").isNotNull())
            .select("acronym", "orgURI", "projectURI", "title").distinct())


def acronym_summary(base: DataFrame) -> DataFrame:
    """Per lower(acronym) of ``base``: the number of its rows and the first of them.

    One ``min`` over the whole row, so organisation, project and title come
    from the same row (rows without an organisation come last)."""
    b = _acronym_rows(base)
    first = F.struct(F.col("orgURI").isNull().alias("no_org"), "orgURI", "projectURI", "title")
    return (b.groupBy("acronym")
            .agg(F.count(F.lit(1)).alias("n_matches"), F.min(first).alias("_first"))
            .select("acronym", "n_matches", F.col("_first.orgURI").alias("baseOrgURI"),
                    F.col("_first.projectURI").alias("baseProjectURI"),
                    F.col("_first.title").alias("baseTitle")))


def acronym_match(subjects: DataFrame, base: DataFrame, every: bool = False) -> DataFrame:
    """Every distinct subject row with its matches in ``base``.

    Each subject row carries the number of distinct base matches and the first matching row
    (org, project, title), which is what E14 and E16 consume.  With ``every``, as the reference's
    left join has it, there is one row per (subject, base) pair, with the base row of the pair.
    Unmatched rows keep NULLs and ``n_matches = 0``.
    """
    j = _distinct_join(_lower_acronym(subjects), acronym_summary(base), ["acronym"], "left")
    j = j.withColumn("n_matches", F.coalesce(F.col("n_matches"), F.lit(0)).cast("bigint"))
    return _every_match(j.drop("baseOrgURI", "baseProjectURI", "baseTitle"), base) if every else j


def _every_match(matched: DataFrame, base: DataFrame) -> DataFrame:
    """Each row of ``matched`` (with its ``n_matches``) next to every base row of its acronym.

    The pairs of an acronym are as many as both its sides multiplied.  Where they exceed
    ``skew.TARGET_ROWS``, both sides are cut into chunks of its square root, and a task joins one
    chunk with one other: the pairs of a task are bounded, and each row is copied as often as the
    other side has chunks, a small part of its pairs.  Rows without a match are spread by their hash.
    """
    side = math.isqrt(skew.TARGET_ROWS)
    m = written(matched, "acronym-matches")
    cells = written(m.filter(F.col("n_matches") > 0).groupBy("acronym", "n_matches")
                    .agg(F.count(F.lit(1)).alias("_r"))
                    .filter(F.col("_r") * F.col("n_matches") > skew.TARGET_ROWS)
                    .select(F.col("acronym").alias("_hk"),
                            F.ceil(F.col("_r") / F.lit(side)).cast("int").alias("_rows"),
                            F.ceil(F.col("n_matches") / F.lit(side)).cast("int").alias("_cols")),
                    "hot-acronyms")

    def own(df: DataFrame, n: str) -> Column:
        """The chunk of a row among ``n``: a hash of the row, so the same when a task runs again."""
        return F.coalesce(F.pmod(F.xxhash64(*[F.col(c) for c in df.columns]), F.col(n)), F.lit(0))

    def every_chunk(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.coalesce(F.col(n), F.lit(1)) - 1))

    alone = F.when(F.col("n_matches") == 0,
                   F.pmod(F.xxhash64(*[F.col(c) for c in m.columns]), F.lit(skew.NULL_SALTS)))
    s = (m.join(cells, F.col("acronym") == F.col("_hk"), "left")
         .withColumn("_i", alone.otherwise(own(m, "_rows")).cast("int")).withColumn("_j", every_chunk("_cols"))
         .drop("_hk", "_rows", "_cols"))
    b = _acronym_rows(base)
    b = (b.join(cells, F.col("acronym") == F.col("_hk"), "left")
         .withColumn("_bj", own(b, "_cols").cast("int")).withColumn("_bi", every_chunk("_rows"))
         .select(F.col("acronym").alias("_bk"), "_bi", "_bj", F.col("orgURI").alias("baseOrgURI"),
                 F.col("projectURI").alias("baseProjectURI"), F.col("title").alias("baseTitle")))
    j = s.join(b, (F.col("acronym") == F.col("_bk")) & (F.col("_i") == F.col("_bi")) & (F.col("_j") == F.col("_bj")),
               "left")
    # a matched row meets nothing where a chunk of the base is empty
    return (j.filter(F.col("_bk").isNotNull() | (F.col("n_matches") == 0))
            .drop("_i", "_j", "_bk", "_bi", "_bj"))


def acronym_org_map(subjects: DataFrame, base: DataFrame) -> DataFrame:
    """Subject org URI -> base org URI through shared acronyms.

    ``min`` over all matches replaces the reference's "last write wins" map;
    orgs without a match map to themselves.  Only the distinct (acronym, org)
    pairs of the subjects take part, written once.
    """
    pairs = written(_lower_acronym(subjects).select("acronym", "orgURI")
                    .filter(F.col("orgURI").isNotNull()).distinct(), "acronym-orgs")
    hot = hot_keys(pairs.groupBy("acronym").agg(F.count(F.lit(1)).alias("_r")), ["acronym"], "_r")
    matched = salted_join(pairs, acronym_summary(base).select("acronym", "baseOrgURI"), ["acronym"],
                          "left", hot)
    return _org_map(matched)


def _org_map(matched: DataFrame) -> DataFrame:
    return (min_per_key(matched, ["orgURI"], ["baseOrgURI"], ["_m"], empty=None)
            .select("orgURI", F.coalesce(F.col("_m"), F.col("orgURI")).alias("newOrgURI")))


def rewrite_on_title_match(subjects: DataFrame, base: DataFrame, title_key) -> DataFrame:
    """Take the base project URI when acronym and (normalised) title agree.

    Per distinct subject row: ``projectURI`` becomes the smallest base
    project with the same lower(acronym) and title key, ``modify`` = 1; else
    the row keeps its URI and ``modify`` = 0.  Linear: the base side is
    aggregated to one row per (acronym, title key) before the join.
    """
    s = _lower_acronym(subjects).withColumn("_tk", title_key(F.col("title")))
    b = (_lower_acronym(base).filter(F.col("acronym").isNotNull())
         .withColumn("_tk", title_key(F.col("title")))
         .filter(F.col("_tk").isNotNull()))
    b = min_per_key(b, ["acronym", "_tk"], ["projectURI"], ["_p"], empty=None)
    j = _distinct_join(s, b, ["acronym", "_tk"], "left")
    return (j.withColumn("modify", F.when(F.col("_p").isNotNull(), F.lit(1)).otherwise(F.lit(0)))
            .withColumn("projectURI", F.coalesce(F.col("_p"), F.col("projectURI")))
            .drop("_tk", "_p"))


def _title_key(title_key) -> Column:
    """The title key of a row, never NULL: ``=`` and the key, or nothing."""
    return F.coalesce(F.concat(F.lit("="), title_key(F.col("title"))), F.lit(""))


def title_matches(keys: DataFrame, base: DataFrame, title_key) -> tuple[DataFrame, DataFrame]:
    """One row per (acronym, title key) of either side: ``_p``, the smallest base project of that
    key, and ``baseOrgURI``, the base org of the acronym (E14's choice); and the subject rows
    ``_r`` of each such pair.

    The subjects' ``keys`` (``acronym, _tk, _r``) and the base rows are one tagged union, aggregated
    once per key and from there once per acronym; a subject row then finds both answers in one
    join.  NULL acronyms match nothing, NULL title keys no project.
    """
    first = F.struct(F.col("orgURI").isNull().alias("no_org"), "orgURI", "projectURI", "title")
    b = (_lower_acronym(base).filter(F.col("acronym").isNotNull())
         .withColumn("_tk", _title_key(title_key))
         .select("acronym", "_tk", F.lit(0).cast("bigint").alias("_r"),
                 F.when(F.col("_tk") != "", F.col("projectURI")).alias("_p"), first.alias("_f")))
    none = [F.lit(None).cast(b.schema[c].dataType).alias(c) for c in ("_p", "_f")]
    per_key = written(keys.select("acronym", "_tk", "_r", *none).unionByName(b)
                      .groupBy("acronym", "_tk")
                      .agg(F.sum("_r").alias("_r"), F.min("_p").alias("_p"), F.min("_f").alias("_f")),
                      "acronym-titles")
    per_acronym = per_key.groupBy("acronym").agg(F.min("_f").alias("_f"), F.count(F.lit(1)).alias("_keys"))
    answers = salted_join(per_key.drop("_f", "_r"),
                          per_acronym.select("acronym", F.col("_f.orgURI").alias("baseOrgURI")),
                          ["acronym"], "left", hot_keys(per_acronym, ["acronym"], "_keys"))
    return answers, per_key.select("acronym", "_tk", "_r")


def rewrite_uris(subjects: DataFrame, base: DataFrame, title_key) -> DataFrame:
    """E16 in full: the project URI as ``rewrite_on_title_match``, and the org URI
    through the acronym map (E14); an org the map does not know keeps its URI.

    The subjects are read twice: to count their (acronym, title key) pairs, and for the rows,
    which are shuffled once, made distinct where they meet their answers.  The answers, the
    matched rows and the org map are written, and every later step reads those.
    """
    s = _lower_acronym(subjects).withColumn("_tk", _title_key(title_key))
    keys = (s.filter(F.col("acronym").isNotNull()).groupBy("acronym", "_tk")
            .agg(F.count(F.lit(1)).alias("_r")))
    answers, weights = title_matches(keys, base, title_key)
    rows = written(salted_join(s, answers, ["acronym", "_tk"], "left",
                               hot_keys(weights, ["acronym", "_tk"], "_r"), distinct=True)
                   .withColumn("modify", F.when(F.col("_p").isNotNull(), F.lit(1)).otherwise(F.lit(0)))
                   .withColumn("projectURI", F.coalesce(F.col("_p"), F.col("projectURI")))
                   .drop("_tk", "_p"), "rewritten-projects")
    orgs = written(_org_map(rows.select("orgURI", "baseOrgURI").filter(F.col("orgURI").isNotNull())),
                   "acronym-orgs")
    hot = hot_keys(rows.groupBy("orgURI").agg(F.count(F.lit(1)).alias("_r")), ["orgURI"], "_r")
    return (salted_join(rows.drop("baseOrgURI"), orgs, ["orgURI"], "left", hot)
            .withColumn("orgURI", F.coalesce("newOrgURI", "orgURI")).drop("newOrgURI"))


def rewrite_counts(rewritten: DataFrame, base_org: str, own_project: str) -> DataFrame:
    """E16 counts: rewritten projects, rows whose org only was rewritten, and their projects."""
    org_only = F.col("orgURI").contains(base_org) & F.col("projectURI").contains(own_project)
    projects = F.count_distinct(F.when(org_only, F.col("projectURI")))
    return rewritten.agg(F.count_if(F.col("modify") == 1).alias("modified"),
                         F.count_if(org_only).alias("org_only"),
                         projects.alias("org_only_projects"))


def values_per_key(df: DataFrame, keys: list[str], attr: str, out: str) -> DataFrame:
    """Distinct ``attr`` values per key group, most first."""
    return (df.groupBy(*keys).agg(F.count_distinct(attr).alias(out))
            .orderBy(F.desc(out), *[F.asc(k) for k in keys]))
