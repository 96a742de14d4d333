"""The query registry: one callable ``(spark, sf_dir) -> DataFrame`` per report/operator.

Roles of the fixture registries:
  A = proj_a  the base registry (first source of every two-source report)
  B = proj_b  the second registry; also the "subjects" extract with acronyms
  C = proj_c  the third registry (org, title)
Each query reads whole tables through the fixture views; nothing is sampled.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.normalize import clean, clean_title, fallback_id, to_double, try_date
from ..operators import enrich, graph_store, merge, overlap, resolve, triples
from ..operators.metrics import to_long
from ..operators.overlap import ROWS, Rows, Source, distinct, either, intersected, joined
from ..schemas import NUMBERED, ORG_TITLE, PROJ
from ..session import shared_dir
from ..sources import csv as csvio
from ..sources import fixtures as fx
from ..sources import ingest
from ..sources.tables import Tables

A, B, C = 0, 1, 2

# Fixed query parameters.
NORTHERN_START = "1996-01-01"
NORTHERN_END = "1999-12-31"
SEARCH_TEXT = "ORG 1"
LOOKUP_VAT = "V7"
DIRT_STEP = 11
DOOMED_TRIPLE = (fx.G_PROJECTS, "p/1", fx.HAS_FIELD, "physics", "string")
SUBJECT_COLS = ["acronym", "projectURI", "title", "orgURI", "orgName", "country"]


class Ctx:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.t = Tables(spark, sf_dir)

    def v(self, name: str) -> DataFrame:
        return fx.view(self.t, name)

    def named(self, name: str) -> DataFrame:
        """A registry view with ``cleanName`` added."""
        return self.v(name).withColumn("cleanName", clean("orgName"))

    def graph(self) -> graph_store.Snapshot:
        """The quads as a stored graph: loaded once per application, then shared by all queries."""
        return graph_store.session_graph(self.spark, self.t.sf_dir, self.v("quads"))


class MaterializedCtx(Ctx):
    """Registry views written once as Parquet under a shared folder and read
    back by every report of a run (a written table cuts the lineage and the
    source joins are not recomputed per report).  The folder must be on the
    cluster's shared storage - the runner puts it under spark.checkpoint.dir."""

    def __init__(self, spark: SparkSession, sf_dir: str, folder: str):
        super().__init__(spark, sf_dir)
        self.folder = folder
        self._done: dict[str, str] = {}

    def v(self, name: str) -> DataFrame:
        if name not in self._done:
            path = f"{self.folder.rstrip('/')}/{name}"
            fx.view(self.t, name).write.mode("overwrite").parquet(path)
            self._done[name] = path
        return self.spark.read.parquet(self._done[name])


Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}
BUILDERS: dict[str, Callable[[Ctx], DataFrame]] = {}   # the same queries, on a given context


def query(fn: Callable[[Ctx], DataFrame]) -> Callable[[Ctx], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(Ctx(spark, sf_dir))
    run.__name__ = fn.__name__
    run.__doc__ = fn.__doc__
    REGISTRY[fn.__name__] = run
    BUILDERS[fn.__name__] = fn
    return fn


# --- reports: budget, overlap, regions (Q1-Q4) -----------------------------

@query
def org_budget(c: Ctx) -> DataFrame:
    """Q1: (pic, organizationName, totalBudget, numberProjects)."""
    return merge.org_budget(c.v("proj_a"), c.v("proj_b"))


@query
def project_org_overlap(c: Ctx) -> DataFrame:
    """Q2/Q4: projects and organisations per source and their overlap."""
    a, b = c.v("proj_a"), c.v("proj_b")
    keys = (("proj", F.col("proj")), ("title", clean("title")), ("pic", F.col("pic")))
    return overlap.overlap_metrics([Source(a, A, keys), Source(b, B, keys)], [
        distinct("projects_a", "proj", A), distinct("projects_b", "proj", B),
        joined("shared_project_titles", "title", A, B),
        distinct("orgs_a", "pic", A), distinct("orgs_b", "pic", B),
        joined("shared_orgs", "pic", A, B)])


@query
def region_budget(c: Ctx) -> DataFrame:
    """Q3: (region, source, totalBudget, numberProjects)."""
    return merge.region_budget(c.v("proj_a"), c.v("proj_b"))


# --- publications (Q10, Q15, Q16) -------------------------------------------

@query
def pubs_by_org_type(c: Ctx) -> DataFrame:
    """Q10: publications per organisation type."""
    r = c.v("results")
    return (r.groupBy("catLabel").agg(F.count("resultURI").alias("number of publications"))
            .withColumnRenamed("catLabel", "organization type"))


@query
def pubs_totals(c: Ctx) -> DataFrame:
    """Q10: distinct organisations and results."""
    r = c.v("results")
    return overlap.overlap_metrics(
        [Source(r, A, (("org", F.col("orgURI")), ("result", F.col("resultURI"))))],
        [distinct("distinct_orgs", "org", A), distinct("distinct_results", "result", A)])


@query
def pubs_by_project_year(c: Ctx) -> DataFrame:
    """Q15: (project, year, numberOfPublications), year desc then count desc."""
    p = c.v("pubs").select("year", "projTitle", "cleanTitle").distinct()
    return (p.groupBy("projTitle", "year").count()
            .select(F.col("projTitle").alias("project"), "year",
                    F.col("count").alias("numberOfPublications"))
            .orderBy(F.desc("year"), F.desc("numberOfPublications"), F.asc("project")))


def _title_overlap(c: Ctx, key) -> DataFrame:
    a, b, s = c.v("proj_a"), c.v("proj_b"), c.v("proj_c")
    keys = (("t", key(F.col("title"))),)
    srcs = [Source(a, A, keys), Source(b, B, keys), Source(s, C, keys)]
    return overlap.overlap_metrics(srcs, [
        distinct("titles_a", "t", A), distinct("titles_c", "t", C), distinct("titles_b", "t", B),
        joined("shared_a_c", "t", A, C), joined("shared_a_b", "t", A, B)])


@query
def title_overlap_raw(c: Ctx) -> DataFrame:
    """Q16: three-source title overlap on raw titles."""
    return _title_overlap(c, lambda x: x)


@query
def title_overlap_clean(c: Ctx) -> DataFrame:
    """Q16: three-source title overlap on cleaned titles (quotes removed, trim, lower)."""
    return _title_overlap(c, clean_title)


# --- registry statistics (Q8, Q9, Q11, Q14, E3, E4) --------------------------

@query
def name_intersect_3way(c: Ctx) -> DataFrame:
    """Pairwise intersections of clean names (a shared NULL counts)."""
    keys = (("n", F.col("cleanName")),)
    srcs = [Source(c.named("proj_a"), A, keys), Source(c.named("proj_b"), B, keys),
            Source(c.named("proj_c"), C, keys)]
    return overlap.overlap_metrics(srcs, [
        intersected("shared_a_c", "n", A, C), intersected("shared_a_b", "n", A, B),
        intersected("shared_b_c", "n", B, C)])


@query
def shared_title_delta(c: Ctx) -> DataFrame:
    """Titles behind shared names, A-vs-B and C-vs-B."""
    a, b, s = c.named("proj_a"), c.named("proj_b"), c.named("proj_c")
    return overlap.shared_title_delta([a, b, s], [("a_b", 0, 1), ("c_b", 2, 1)])


@query
def registry_totals(c: Ctx) -> DataFrame:
    """Q11: distinct names, URIs and titles per registry, and title row counts."""
    a, b, s = c.v("proj_a"), c.v("proj_b"), c.v("proj_c")
    srcs = [
        Source(a, A, (("name", F.col("orgName")), ("title", F.col("title")), ("rows_a", ROWS))),
        Source(s, C, (("name", F.col("orgName")), ("uri", F.col("orgURI")),
                      ("title", F.col("title")), ("rows_c", ROWS))),
        Source(b, B, (("uri", F.col("orgURI")), ("title", F.col("title")), ("rows_b", ROWS))),
    ]
    return overlap.overlap_metrics(srcs, [
        distinct("orgs_by_name_a", "name", A), distinct("orgs_by_name_c", "name", C),
        distinct("orgs_by_uri_c", "uri", C), distinct("orgs_by_uri_b", "uri", B),
        distinct("titles_a", "title", A), distinct("titles_c", "title", C),
        distinct("titles_b", "title", B),
        Rows("title_rows_a", "rows_a"), Rows("title_rows_c", "rows_c"),
        Rows("title_rows_b", "rows_b")])


@query
def stem_overlap(c: Ctx) -> DataFrame:
    """Q14: per-source org/project counts and overlaps by legal name, tax id, title."""
    a, b = c.v("proj_a"), c.v("proj_b")
    keys = (("org", F.col("orgURI")), ("proj", F.col("projectURI")),
            ("legal", F.col("orgName")), ("vat", F.col("vatID")), ("title", F.lower("title")))
    return overlap.overlap_metrics([Source(a, A, keys), Source(b, B, keys)], [
        distinct("orgs_a", "org", A), distinct("orgs_b", "org", B),
        distinct("projects_a", "proj", A), distinct("projects_b", "proj", B),
        joined("shared_legal_names", "legal", A, B), joined("shared_vat_ids", "vat", A, B),
        joined("shared_titles", "title", A, B)])


@query
def title_pair_count(c: Ctx) -> DataFrame:
    """Row pairs of A JOIN B and of A JOIN C on title (fan-out included), clean and raw."""
    a, b, other = c.v("proj_a"), c.v("proj_b"), c.v("proj_c")

    def pairs(side, name):
        return overlap.pair_counts(a, side, [
            (f"{name}_clean", clean("title"), clean("title")),
            (f"{name}_raw", F.col("title"), F.col("title"))])
    return pairs(b, "title_pairs").unionByName(pairs(other, "title_pairs_ac"))


@query
def titles_projects_bc(c: Ctx) -> DataFrame:
    """Distinct titles and projects over the union of C and B, next to each side's."""
    b, other = c.v("proj_b"), c.v("proj_c")
    keys = (("title", F.col("title")), ("proj", F.col("projectURI")))
    return overlap.overlap_metrics([Source(b, B, keys), Source(other, C, keys)], [
        either("titles_bc", "title", B, C), distinct("titles_b", "title", B),
        distinct("titles_c", "title", C),
        either("projects_bc", "proj", B, C), distinct("projects_b", "proj", B),
        distinct("projects_c", "proj", C)])


@query
def orgs_sharing_title(c: Ctx) -> DataFrame:
    """Clean names on one side whose clean titles also occur on the other."""
    a, b = c.named("proj_a"), c.named("proj_b")
    return overlap.names_sharing_keys(a, b, clean("title"), clean("title"))


@query
def gained_projects(c: Ctx) -> DataFrame:
    """Org names shared with A and the B projects they bring."""
    return overlap.gained_projects(c.named("proj_a"), c.named("proj_b"), c.named("proj_c"))


@query
def vat_overlap_upper(c: Ctx) -> DataFrame:
    """Tax-id overlap, raw and upper-cased."""
    a, b = c.v("proj_a"), c.v("proj_b")
    keys = (("raw", F.col("vatID")), ("up", F.upper("vatID")))
    return overlap.overlap_metrics([Source(a, A, keys), Source(b, B, keys)], [joined("shared_vat", "raw", A, B),
                                        joined("shared_vat_upper", "up", A, B)])


# --- acronyms (E12-E14, E16) ------------------------------------------------

def _subjects(c: Ctx) -> DataFrame:
    return c.v("proj_b").select(*SUBJECT_COLS)


@query
def acronym_overlap(c: Ctx) -> DataFrame:
    """Q8: distinct acronyms per registry and their overlap on lower(acronym)."""
    a, b = c.v("proj_a"), _subjects(c)
    keys = (("raw", F.col("acronym")), ("low", F.lower("acronym")))
    return overlap.overlap_metrics([Source(a, A, keys), Source(b, B, keys)], [
        distinct("acronyms_a", "raw", A), distinct("acronyms_b", "raw", B),
        joined("shared_lower_acronyms", "low", A, B)])


@query
def acronym_match(c: Ctx) -> DataFrame:
    """Subject rows with their acronym matches in A (count, and a row for each match)."""
    return resolve.acronym_match(_subjects(c), c.v("proj_a"), every=True)


@query
def acronym_new(c: Ctx) -> DataFrame:
    """Subject rows whose acronym A does not know."""
    return resolve.acronym_new(_subjects(c), c.v("proj_a"))


@query
def acronym_org_map(c: Ctx) -> DataFrame:
    """B org URI -> A org URI through shared acronyms."""
    return resolve.acronym_org_map(_subjects(c), c.v("proj_a"))


@query
def rewrite_on_title_match(c: Ctx) -> DataFrame:
    """Adopt A's project URI when acronym and clean title agree."""
    return resolve.rewrite_on_title_match(_subjects(c), c.v("proj_a"), clean)


def _rewritten(c: Ctx) -> DataFrame:
    return resolve.rewrite_uris(_subjects(c), c.v("proj_a"), clean)


@query
def rewrite_uris(c: Ctx) -> DataFrame:
    """Subject rows with A's project URI (acronym and title agree) and A's org URI (acronym)."""
    return _rewritten(c)


@query
def rewrite_counts(c: Ctx) -> DataFrame:
    """Rewritten projects, and rows whose organisation alone became A's."""
    return to_long(resolve.rewrite_counts(_rewritten(c), "a.example", "b.example"))


# --- enrichment (Q5-Q7, Q13) ------------------------------------------------

@query
def projects_by_org_hdi(c: Ctx) -> DataFrame:
    """Q5: (hdi, countryName, count, orgName)."""
    return enrich.projects_by_org(c.v("proj_b"), c.v("proj_a"), c.v("country_ref"), "hdi", "using")


def _gdp_dim(c: Ctx) -> DataFrame:
    return c.v("country_ref").filter(F.col("gdp").isNotNull())


@query
def projects_by_org_gdp(c: Ctx) -> DataFrame:
    """Q6: (gdp, countryName, count, orgName); label source joined with J4."""
    return enrich.projects_by_org(c.v("proj_b"), c.v("proj_a"), _gdp_dim(c), "gdp", "on")


@query
def projects_by_vat_gdp(c: Ctx) -> DataFrame:
    """Q7: (vatID, gdp, count), vatID descending."""
    return enrich.projects_by_vat(c.v("proj_b"), c.v("proj_a"), _gdp_dim(c), "gdp")


def _coded(c: Ctx) -> DataFrame:
    """A with the country's ISO code in ``country``."""
    return c.v("proj_a").withColumn("country", F.col("countryCode"))


@query
def projects_by_org_gdp_iso(c: Ctx) -> DataFrame:
    """Q6: as projects_by_org_gdp, the second source joined on the ISO code."""
    return enrich.projects_by_org(c.v("proj_b"), _coded(c), _gdp_dim(c), "gdp", "iso")


@query
def projects_by_vat_gdp_iso(c: Ctx) -> DataFrame:
    """Q7: as projects_by_vat_gdp, the second source joined on the ISO code."""
    return enrich.projects_by_vat(c.v("proj_b"), _coded(c), _gdp_dim(c), "gdp", "iso")


@query
def projects_by_vat_hdi(c: Ctx) -> DataFrame:
    """Q7: (vatID, hdi, count), the second source joined on the ISO code."""
    return enrich.projects_by_vat(c.v("proj_b"), _coded(c), c.v("country_ref"), "hdi", "iso")


@query
def northern_projects(c: Ctx) -> DataFrame:
    """Q13: (LegalName, Country, ProjectTitle) for allow-listed countries."""
    return enrich.northern_projects(c.v("proj_a"), c.v("proj_b"), c.v("country_allow"),
                                    NORTHERN_START, NORTHERN_END)


# --- merge by id (E9) -------------------------------------------------------

def _gains(c: Ctx) -> DataFrame:
    a = c.v("proj_a").withColumn("vatID", fallback_id("vatID", "orgURI"))
    b = c.v("proj_b").withColumn("vatID", fallback_id("vatID", "orgURI"))
    return merge.merge_by_id(a, b)


@query
def new_projects_by_id(c: Ctx) -> DataFrame:
    """(vatID, countByBase, countByMerge, newProjects) with newProjects > 0."""
    return _gains(c)


@query
def new_projects_total(c: Ctx) -> DataFrame:
    """Total of newProjects."""
    return merge.total(_gains(c), "newProjects", "total_new_projects")


# --- resolution (E5-E8, E17, E18) -------------------------------------------

@query
def alias_groups(c: Ctx) -> DataFrame:
    """E5: (cleanName, n_uris, canonicalURI)."""
    return resolve.alias_groups(c.v("all_orgs"))


@query
def alias_members(c: Ctx) -> DataFrame:
    """E5: (cleanName, orgURI, n_uris, chunk) of the groups with several URIs."""
    return resolve.alias_membership(c.v("all_orgs"))


@query
def names_over_two_uris(c: Ctx) -> DataFrame:
    """Alias groups with more than two URIs."""
    return resolve.names_over(resolve.alias_groups(c.v("all_orgs")), 2)


@query
def canonical_uri(c: Ctx) -> DataFrame:
    """(orgURI, canonicalURI)."""
    return resolve.canonical_uri(c.v("all_orgs"))


@query
def multi_row_names(c: Ctx) -> DataFrame:
    """Every org row with its multi_row_name flag."""
    return resolve.flag_multi_row_names(c.v("all_orgs"))


@query
def pubs_by_resolved_org(c: Ctx) -> DataFrame:
    """(orgName, numberOfPublications) after URI resolution."""
    return resolve.merged_publications(c.v("all_orgs"))


@query
def repositories_of(c: Ctx) -> DataFrame:
    """(cleanName, source, other_sources) for names in several sources."""
    return resolve.repositories_of(c.v("all_orgs"))


@query
def multi_title_projects(c: Ctx) -> DataFrame:
    """Project ids carrying more than one title across A and B."""
    u = merge.union_all(c.v("proj_a"), c.v("proj_b"), cols=["proj", "title"])
    return resolve.multi_valued(u, "proj", "title", "n_titles")


@query
def titles_per_vat_project(c: Ctx) -> DataFrame:
    """Distinct titles per (vatID, project) in B, most first."""
    return resolve.values_per_key(c.v("proj_b"), ["vatID", "projectURI"], "title", "n_titles")


@query
def rows_per_project(c: Ctx) -> DataFrame:
    """Rows per project in B."""
    return resolve.rows_per_key(c.v("proj_b"), "projectURI")


@query
def rows_per_name(c: Ctx) -> DataFrame:
    """Rows per clean name over all registries."""
    return resolve.rows_per_key(c.v("all_orgs"), "cleanName")


@query
def name_search(c: Ctx) -> DataFrame:
    """Names containing a text (case-insensitive), most rows first."""
    o = c.v("all_orgs").filter(F.upper("cleanName").contains(SEARCH_TEXT))
    return (o.groupBy("cleanName").agg(F.count(F.lit(1)).alias("n_rows"))
            .orderBy(F.desc("n_rows"), F.asc("cleanName")))


@query
def vat_lookup(c: Ctx) -> DataFrame:
    """every participation row of one tax id, both registries."""
    cols = ["vatID", "orgURI", "orgName", "projectURI", "source"]
    u = merge.union_all(c.v("proj_a"), c.v("proj_b"), cols=cols)
    return u.filter(F.col("vatID") == LOOKUP_VAT)


# --- triple graph (T1-T7, Q17, Q18) -----------------------------------------

def _resolved(c: Ctx) -> DataFrame:
    items = c.v("classification").select("project_id", "rcn", "category").distinct()
    idx = c.graph().identifier_index(
        fx.G_PROJECTS, type_pred=fx.RDF_TYPE, type_obj=fx.CLS_PROJECT, has_id=fx.HAS_IDENTIFIER,
        id_name=fx.ID_NAME, id_value=fx.ID_VALUE, scheme="rcn")
    return triples.resolve_identifier(items, idx, "rcn")


def _field_triples(c: Ctx) -> DataFrame:
    return triples.field_triples(_resolved(c), fx.G_PROJECTS, fx.HAS_FIELD, "category")


@query
def resolve_identifier(c: Ctx) -> DataFrame:
    """(project_id, rcn, category, projectURI); '' when not in the graph."""
    return _resolved(c)


@query
def annotate_fields(c: Ctx) -> DataFrame:
    """The hasFieldOfScience quads that the annotation appends (set semantics)."""
    after, batch = c.graph().insert(_field_triples(c))
    return after.batch(batch)


@query
def annotated_graph(c: Ctx) -> DataFrame:
    """The graph after the annotation (the old folders and the appended batch)."""
    return c.graph().insert(_field_triples(c))[0].quads()


@query
def annotate_counts(c: Ctx) -> DataFrame:
    """Q17: classification rows found / not found in the graph."""
    return to_long(triples.annotate_counts(_resolved(c)))


@query
def delete_triple(c: Ctx) -> DataFrame:
    """T4: the graph without one exact triple."""
    # an inline table: literals in a projection would be folded into the join condition,
    # which leaves it no key
    doomed = c.spark.sql("SELECT * FROM VALUES (:g, :s, :p, :o, :o_type) AS t(g, s, p, o, o_type)",
                         args=dict(zip(triples.QUAD_COLS, DOOMED_TRIPLE)))
    return c.graph().delete(doomed).quads()


@query
def delete_predicate(c: Ctx) -> DataFrame:
    """T5: the graph without any hasFieldOfScience triple of the project graph."""
    return c.graph().delete_predicate(fx.G_PROJECTS, fx.HAS_FIELD).quads()


@query
def clear_graph(c: Ctx) -> DataFrame:
    """The quads without the patents graph."""
    return c.graph().clear_graph(fx.G_PATENTS).quads()


@query
def list_graphs(c: Ctx) -> DataFrame:
    """Distinct graphs, in order."""
    return c.graph().graphs()


@query
def category_labels(c: Ctx) -> DataFrame:
    """Q18: distinct category labels."""
    return c.v("classification").select("category").distinct()


# --- CSV round trip (S1-S3, K1) ---------------------------------------------

@query
def csv_roundtrip(c: Ctx) -> DataFrame:
    """Registry A written as header CSV (in parallel) and read back typed."""
    path = shared_dir(c.spark, "csv-roundtrip")
    csvio.write_csv(c.v("proj_a").select(*PROJ.names), path)
    raw = csvio.read_csv(c.spark, path, PROJ, multiline=True)
    return raw.select(
        *[F.col(n) for n in ("projectURI", "title", "acronym", "orgURI", "orgName", "country",
                              "vatID", "pic", "proj")],
        to_double("budget").alias("budget"),
        try_date("sDate").alias("sDate"), try_date("eDate").alias("eDate"),
        F.col("source"))


@query
def orgs_from_files(c: Ctx) -> DataFrame:
    """The (org, title) extracts of the three registries, several files read as one source."""
    paths = []
    for name in ("proj_a", "proj_b", "proj_c"):
        paths.append(shared_dir(c.spark, f"extract-{name}"))
        csvio.write_csv(c.v(name).select(*ORG_TITLE.names), paths[-1])
    return csvio.read_csv(c.spark, paths, ORG_TITLE, multiline=True)


@query
def report_csv(c: Ctx) -> DataFrame:
    """K1/K2: the Q1 report written as CSV part files in its order, header in each, read back."""
    path = shared_dir(c.spark, "report-csv")
    csvio.write_csv(merge.org_budget(c.v("proj_a"), c.v("proj_b")), path)
    schema = StructType([StructField(n, StringType(), True) for n in
                         ("pic", "organizationName", "totalBudget", "numberProjects")])
    raw = csvio.read_csv(c.spark, path, schema)
    return raw.select("pic", "organizationName", to_double("totalBudget").alias("totalBudget"),
                      F.col("numberProjects").try_cast("bigint").alias("numberProjects"))


# --- ingest with rejects (S1-S3) ----------------------------------------------

def _dirty_extract(c: Ctx) -> ingest.Ingested:
    """Registry C as a hand-made CSV extract, one record a line, in which records of some users
    lack a field, have one too many, a quote that is never closed, or no number where one belongs."""
    o = c.v("proj_c").select("orgName", "orgURI", "title",
                             F.regexp_extract("orgURI", "([0-9]+)$", 1).alias("no"))
    kind = F.col("no").cast("bigint") % DIRT_STEP
    line = F.concat_ws(",", "orgName", "orgURI", "title", "no")
    dirty = (F.when(kind == 2, F.concat_ws(",", "orgName", "orgURI", "title", F.lit("n/a")))
             .when(kind == 3, F.concat_ws(",", "orgName", "orgURI"))
             .when(kind == 5, F.concat(line, F.lit(",extra")))
             .when(kind == 7, F.concat(F.lit('"'), line)).otherwise(line))
    path = shared_dir(c.spark, "dirty-extract")
    o.select(dirty.alias("value")).write.text(path)
    return ingest.ingest_csv(c.spark, path, NUMBERED, header=False)


@query
def csv_rejects(c: Ctx) -> DataFrame:
    """Records of a dirty extract by what became of them (good, or the reject's reason)."""
    return _dirty_extract(c).counts()


@query
def csv_accepted(c: Ctx) -> DataFrame:
    """The good rows of a dirty extract, typed."""
    return _dirty_extract(c).good


@query
def multiline_report(c: Ctx) -> DataFrame:
    """Registry A as multi-line CSV, ingested into Parquet once; projects and titles with a
    line break per country, from the Parquet table."""
    path = shared_dir(c.spark, "multiline-extract")
    csvio.write_csv(c.v("proj_a").select(*PROJ.names), path)
    done = ingest.ingest_csv(c.spark, path, PROJ, multiline=True)
    return (done.good.groupBy("country")
            .agg(F.count(F.lit(1)).alias("n_projects"),
                 F.count_if(F.col("title").contains("\n")).alias("n_broken_titles")))
