"""DuckDB oracle SQL, one statement per registered query.

Written independently of the Spark code, in the reference's own step order
(distinct -> join -> count, union -> group, ...), so a wrong Spark rewrite
shows up as a mismatch.  Base tables are views registered by the caller;
fixture views come in as CTEs (``fixtures.with_views``).
"""

from __future__ import annotations

from ..sources import fixtures as fx
from ..sources.fixtures import with_views

# Keep these in step with plans.queries.
from ..operators.resolve import CHUNK
from .queries import (DIRT_STEP, DOOMED_TRIPLE, LOOKUP_VAT, NORTHERN_END, NORTHERN_START,
                      SEARCH_TEXT)

CLEAN = "trim(lower({}))"
CLEAN_TITLE = "trim(lower(replace({}, '\"', '')))"
MONEY = "CAST(sum(CAST({} AS DECIMAL(18,2))) AS DOUBLE)"
FALLBACK = ("CASE WHEN vatID IS NULL OR lower(vatID) IN ('nan', 'missing') "
            "THEN orgURI ELSE vatID END")


def dcount(expr: str, src: str) -> str:
    """Distinct values, NULL counted."""
    return f"(SELECT count(*) FROM (SELECT DISTINCT {expr} AS k FROM {src}) d)"


def jcount(ea: str, sa: str, eb: str, sb: str) -> str:
    """Distinct keys joined, NULL never matches."""
    return (f"(SELECT count(*) FROM (SELECT DISTINCT {ea} AS k FROM {sa}) x "
            f"JOIN (SELECT DISTINCT {eb} AS k FROM {sb}) y ON x.k = y.k)")


def icount(ea: str, sa: str, eb: str, sb: str) -> str:
    """INTERSECT, a shared NULL counts."""
    return f"(SELECT count(*) FROM (SELECT {ea} FROM {sa} INTERSECT SELECT {eb} FROM {sb}) i)"


def metric_rows(*pairs: tuple[str, str], kind: str = "BIGINT") -> str:
    return "\nUNION ALL ".join(f"SELECT '{n}' AS metric, CAST({v} AS {kind}) AS value"
                               for n, v in pairs)


def _named(view: str) -> str:
    return f"(SELECT *, trim(lower(orgName)) AS cleanName FROM {view})"


SQL: dict[str, str] = {}


def sql(name: str, views: tuple[str, ...], body: str) -> None:
    SQL[name] = with_views(body, *views)


AB = ("proj_a", "proj_b")
ABC = ("proj_a", "proj_b", "proj_c")

sql("org_budget", AB, f"""
, u AS (SELECT pic, orgName, proj, budget FROM proj_a
        UNION ALL SELECT pic, orgName, proj, budget FROM proj_b),
names AS (SELECT pic, COALESCE(min(orgName), '') AS organizationName
          FROM (SELECT DISTINCT pic, orgName FROM u) d GROUP BY pic),
facts AS (SELECT pic, {MONEY.format('budget')} AS totalBudget, count(proj) AS numberProjects
          FROM (SELECT DISTINCT pic, proj, budget FROM u) d GROUP BY pic)
SELECT pic, organizationName, totalBudget, numberProjects
FROM facts JOIN names USING (pic)
ORDER BY totalBudget DESC, numberProjects DESC""")

sql("project_org_overlap", AB, metric_rows(
    ("projects_a", dcount("proj", "proj_a")),
    ("projects_b", dcount("proj", "proj_b")),
    ("shared_project_titles", jcount(CLEAN.format("title"), "proj_a", CLEAN.format("title"), "proj_b")),
    ("orgs_a", dcount("pic", "proj_a")),
    ("orgs_b", dcount("pic", "proj_b")),
    ("shared_orgs", jcount("pic", "proj_a", "pic", "proj_b"))))

sql("region_budget", AB, f"""
SELECT region, source, {MONEY.format('budget')} AS totalBudget, count(proj) AS numberProjects
FROM (SELECT country AS region, source, proj, budget FROM proj_a
      UNION ALL SELECT country AS region, source, proj, budget FROM proj_b) u
GROUP BY region, source""")

sql("pubs_by_org_type", ("results",), """
SELECT catLabel AS "organization type", count(resultURI) AS "number of publications"
FROM results GROUP BY catLabel""")

sql("pubs_totals", ("results",), metric_rows(
    ("distinct_orgs", dcount("orgURI", "results")),
    ("distinct_results", dcount("resultURI", "results"))))

sql("pubs_by_project_year", ("pubs",), """
SELECT projTitle AS project, year, count(*) AS numberOfPublications
FROM (SELECT DISTINCT year, projTitle, cleanTitle FROM pubs) d
GROUP BY projTitle, year""")


def _title_overlap(key: str) -> str:
    k = key.format("title")
    return metric_rows(
        ("titles_a", dcount(k, "proj_a")), ("titles_c", dcount(k, "proj_c")),
        ("titles_b", dcount(k, "proj_b")),
        ("shared_a_c", jcount(k, "proj_a", k, "proj_c")),
        ("shared_a_b", jcount(k, "proj_a", k, "proj_b")))


sql("title_overlap_raw", ABC, _title_overlap("{}"))
sql("title_overlap_clean", ABC, _title_overlap(CLEAN_TITLE))

_NA, _NB, _NC = _named("proj_a"), _named("proj_b"), _named("proj_c")

sql("name_intersect_3way", ABC, metric_rows(
    ("shared_a_c", icount("cleanName", _NA, "cleanName", _NC)),
    ("shared_a_b", icount("cleanName", _NA, "cleanName", _NB)),
    ("shared_b_c", icount("cleanName", _NB, "cleanName", _NC))))


def _delta(prefix: str, a: str, b: str) -> list[tuple[str, str]]:
    shared = f"(SELECT cleanName FROM {a} INTERSECT SELECT cleanName FROM {b})"
    ta = f"(SELECT count(*) FROM (SELECT DISTINCT title FROM {a} WHERE cleanName IN {shared}) t)"
    tb = f"(SELECT count(*) FROM (SELECT DISTINCT title FROM {b} WHERE cleanName IN {shared}) t)"
    only_a = (f"(SELECT count(*) FROM (SELECT title FROM {a} WHERE cleanName IN {shared} "
              f"EXCEPT SELECT title FROM {b} WHERE cleanName IN {shared}) t)")
    return [(f"{prefix}_shared_names", f"(SELECT count(*) FROM {shared} s)"),
            (f"{prefix}_titles_a", ta), (f"{prefix}_titles_b", tb),
            (f"{prefix}_title_delta", f"({ta} - {tb})"), (f"{prefix}_titles_only_a", only_a)]


sql("shared_title_delta", ABC, metric_rows(*_delta("a_b", _NA, _NB), *_delta("c_b", _NC, _NB)))

sql("registry_totals", ABC, metric_rows(
    ("orgs_by_name_a", dcount("orgName", "proj_a")),
    ("orgs_by_name_c", dcount("orgName", "proj_c")),
    ("orgs_by_uri_c", dcount("orgURI", "proj_c")),
    ("orgs_by_uri_b", dcount("orgURI", "proj_b")),
    ("titles_a", dcount("title", "proj_a")),
    ("titles_c", dcount("title", "proj_c")),
    ("titles_b", dcount("title", "proj_b")),
    ("title_rows_a", "(SELECT count(*) FROM proj_a)"),
    ("title_rows_c", "(SELECT count(*) FROM proj_c)"),
    ("title_rows_b", "(SELECT count(*) FROM proj_b)")))

sql("stem_overlap", AB, metric_rows(
    ("orgs_a", dcount("orgURI", "proj_a")), ("orgs_b", dcount("orgURI", "proj_b")),
    ("projects_a", dcount("projectURI", "proj_a")), ("projects_b", dcount("projectURI", "proj_b")),
    ("shared_legal_names", jcount("orgName", "proj_a", "orgName", "proj_b")),
    ("shared_vat_ids", jcount("vatID", "proj_a", "vatID", "proj_b")),
    ("shared_titles", jcount("lower(title)", "proj_a", "lower(title)", "proj_b"))))

def _pairs_sql(other: str) -> tuple[str, str]:
    return (f"(SELECT count(*) FROM (SELECT {CLEAN.format('title')} AS t FROM proj_a) x "
            f"JOIN (SELECT {CLEAN.format('title')} AS t FROM {other}) y ON x.t = y.t)",
            f"(SELECT count(*) FROM proj_a x JOIN {other} y ON x.title = y.title)")


sql("title_pair_count", (*AB, "proj_c"), metric_rows(
    *zip(("title_pairs_clean", "title_pairs_raw"), _pairs_sql("proj_b")),
    *zip(("title_pairs_ac_clean", "title_pairs_ac_raw"), _pairs_sql("proj_c")),
    kind="DECIMAL(38,0)"))


def _union(expr: str) -> str:
    return (f"(SELECT count(*) FROM (SELECT {expr} FROM proj_c "
            f"UNION SELECT {expr} FROM proj_b) u)")


sql("titles_projects_bc", ("proj_b", "proj_c"), metric_rows(
    ("titles_bc", _union("title")), ("titles_b", dcount("title", "proj_b")),
    ("titles_c", dcount("title", "proj_c")),
    ("projects_bc", _union("projectURI")), ("projects_b", dcount("projectURI", "proj_b")),
    ("projects_c", dcount("projectURI", "proj_c"))))

sql("orgs_sharing_title", AB, f"""
SELECT DISTINCT 'B' AS side, y.cleanName
FROM (SELECT DISTINCT {CLEAN.format('title')} AS t FROM proj_a) x
JOIN (SELECT DISTINCT {CLEAN.format('title')} AS t, cleanName FROM {_NB}) y ON x.t = y.t
UNION ALL
SELECT DISTINCT 'A' AS side, x.cleanName
FROM (SELECT DISTINCT {CLEAN.format('title')} AS t, cleanName FROM {_NA}) x
JOIN (SELECT DISTINCT {CLEAN.format('title')} AS t FROM proj_b) y ON x.t = y.t""")

_BC_NAMES = f"(SELECT cleanName FROM {_NC} UNION SELECT cleanName FROM {_NB})"
_SHARED_A_BC = (f"(SELECT x.cleanName FROM (SELECT DISTINCT cleanName FROM {_NA}) x "
                f"JOIN {_BC_NAMES} y ON x.cleanName = y.cleanName)")
sql("gained_projects", ABC, metric_rows(
    ("orgs_a", dcount("cleanName", _NA)),
    ("orgs_bc", f"(SELECT count(*) FROM {_BC_NAMES} n)"),
    ("shared_orgs", f"(SELECT count(*) FROM {_SHARED_A_BC} s)"),
    ("gained_projects",
     f"(SELECT count(*) FROM (SELECT DISTINCT b.projectURI FROM {_NB} b "
     f"JOIN {_SHARED_A_BC} s ON b.cleanName = s.cleanName) g)")))

sql("vat_overlap_upper", AB, metric_rows(
    ("shared_vat", jcount("vatID", "proj_a", "vatID", "proj_b")),
    ("shared_vat_upper", jcount("upper(vatID)", "proj_a", "upper(vatID)", "proj_b"))))

_SUBJ = ("(SELECT DISTINCT lower(acronym) AS acronym, projectURI, title, orgURI, orgName, country "
         "FROM proj_b)")
_ACR_A = ("(SELECT acronym, count(*) OVER (PARTITION BY acronym) AS n_matches, orgURI AS baseOrgURI, "
          "projectURI AS baseProjectURI, title AS baseTitle "
          "FROM (SELECT DISTINCT lower(acronym) AS acronym, "
          "orgURI, projectURI, title FROM proj_a WHERE acronym IS NOT NULL) d "
          "QUALIFY row_number() OVER (PARTITION BY acronym ORDER BY orgURI NULLS LAST, "
          "projectURI NULLS FIRST, title NULLS FIRST) = 1)")
_MATCH = f"""
SELECT s.acronym, s.projectURI, s.title, s.orgURI, s.orgName, s.country,
       CAST(COALESCE(m.n_matches, 0) AS BIGINT) AS n_matches, m.baseOrgURI, m.baseProjectURI,
       m.baseTitle
FROM {_SUBJ} s LEFT JOIN {_ACR_A} m ON s.acronym = m.acronym"""

sql("acronym_overlap", AB, metric_rows(
    ("acronyms_a", dcount("acronym", "proj_a")),
    ("acronyms_b", dcount("acronym", "proj_b")),
    ("shared_lower_acronyms", jcount("lower(acronym)", "proj_a", "lower(acronym)", "proj_b"))))
# every match of a subject row, where _MATCH has the first one
_ACR_EVERY = _ACR_A.split("QUALIFY")[0].rstrip() + ")"
sql("acronym_match", AB, _MATCH.replace(_ACR_A, _ACR_EVERY))

sql("acronym_new", AB, f"""
SELECT s.* FROM {_SUBJ} s
WHERE NOT EXISTS (SELECT 1 FROM proj_a a WHERE lower(a.acronym) = s.acronym)""")

sql("acronym_org_map", AB, f"""
SELECT orgURI, COALESCE(min(baseOrgURI), orgURI) AS newOrgURI
FROM ({_MATCH}) m WHERE orgURI IS NOT NULL GROUP BY orgURI""")

_REWRITE = f"""
, b AS (SELECT lower(acronym) AS acronym, {CLEAN.format('title')} AS tk, min(projectURI) AS p
        FROM proj_a WHERE acronym IS NOT NULL AND {CLEAN.format('title')} IS NOT NULL
        GROUP BY lower(acronym), {CLEAN.format('title')})
SELECT s.acronym, COALESCE(b.p, s.projectURI) AS projectURI, s.title, s.orgURI, s.orgName,
       s.country, CASE WHEN b.p IS NOT NULL THEN 1 ELSE 0 END AS modify
FROM {_SUBJ} s LEFT JOIN b ON s.acronym = b.acronym AND {CLEAN.format('s.title')} = b.tk"""
sql("rewrite_on_title_match", AB, _REWRITE)

_HEAD, _ROWS = _REWRITE.split("\nSELECT s.acronym", 1)
_REWRITE_URIS = f"""{_HEAD},
rewritten AS (SELECT s.acronym{_ROWS}),
orgs AS (SELECT s.orgURI, min(a.orgURI) AS newOrgURI FROM {_SUBJ} s
         JOIN proj_a a ON lower(a.acronym) = s.acronym
         JOIN (SELECT lower(acronym) AS k, min(orgURI) AS first FROM proj_a GROUP BY lower(acronym)) f
           ON f.k = s.acronym AND f.first = a.orgURI
         GROUP BY s.orgURI),
uris AS (SELECT r.acronym, r.projectURI, r.title, COALESCE(o.newOrgURI, r.orgURI) AS orgURI,
                r.orgName, r.country, r.modify
         FROM rewritten r LEFT JOIN orgs o ON r.orgURI = o.orgURI)"""
sql("rewrite_uris", AB, _REWRITE_URIS + "\nSELECT * FROM uris")
_ORG_ONLY = "contains(orgURI, 'a.example') AND contains(projectURI, 'b.example')"
sql("rewrite_counts", AB, _REWRITE_URIS + "\n" + metric_rows(
    ("modified", "(SELECT count(*) FROM uris WHERE modify = 1)"),
    ("org_only", f"(SELECT count(*) FROM uris WHERE {_ORG_ONLY})"),
    ("org_only_projects", f"(SELECT count(DISTINCT projectURI) FROM uris WHERE {_ORG_ONLY})")))


def _by_org(measure: str, dim: str, label_on: bool, iso: bool = False) -> str:
    if iso:
        c2 = (f"SELECT d.orgURI, d.projectURI, c.{measure}, c.countryName "
              f"FROM (SELECT DISTINCT orgURI, countryCode, projectURI FROM proj_a) d "
              f"LEFT JOIN {dim} c ON d.countryCode = c.iso")
    elif label_on:
        c2 = (f"SELECT d.orgURI, d.projectURI, c.{measure}, c.cn AS countryName "
              f"FROM (SELECT DISTINCT orgURI, country, projectURI FROM proj_a) d "
              f"LEFT JOIN (SELECT countryName AS cn, {measure} FROM {dim}) c ON d.country = c.cn")
    else:
        c2 = (f"SELECT d.orgURI, d.projectURI, c.{measure}, d.countryName "
              f"FROM (SELECT DISTINCT orgURI, country AS countryName, projectURI FROM proj_a) d "
              f"LEFT JOIN {dim} c ON d.countryName = c.countryName")
    return f"""
, o1 AS (SELECT d.orgURI, d.projectURI, c.{measure}, c.countryName
         FROM (SELECT DISTINCT orgURI, country, projectURI FROM proj_b) d
         LEFT JOIN {dim} c ON d.country = c.country),
c2 AS ({c2}),
result AS (SELECT orgURI, {measure}, countryName, count(*) AS "count"
           FROM (SELECT * FROM o1 UNION ALL SELECT * FROM c2) u
           WHERE {measure} IS NOT NULL GROUP BY orgURI, {measure}, countryName),
names AS (SELECT orgURI, COALESCE(min(orgName), '') AS orgName
          FROM (SELECT orgURI, orgName FROM proj_b UNION ALL SELECT orgURI, orgName FROM proj_a) n
          GROUP BY orgURI)
SELECT {measure}, countryName, "count", orgName FROM result JOIN names USING (orgURI)
ORDER BY "count" DESC"""


_GDP_DIM = "(SELECT * FROM country_ref WHERE gdp IS NOT NULL)"
sql("projects_by_org_hdi", AB + ("country_ref",), _by_org("hdi", "country_ref", False))
sql("projects_by_org_gdp", AB + ("country_ref",), _by_org("gdp", _GDP_DIM, True))

sql("projects_by_org_gdp_iso", AB + ("country_ref",), _by_org("gdp", _GDP_DIM, False, iso=True))


def _by_vat_iso(measure: str) -> str:
    return f"""
SELECT vatID, {measure}, count(*) AS "count" FROM (
  SELECT d.vatID, c.{measure} FROM (SELECT DISTINCT vatID, country, projectURI FROM proj_b) d
  JOIN country_ref c ON d.country = c.country
  UNION ALL
  SELECT d.vatID, c.{measure} FROM (SELECT DISTINCT vatID, countryCode, projectURI FROM proj_a) d
  JOIN country_ref c ON d.countryCode = c.iso) u
WHERE {measure} IS NOT NULL GROUP BY vatID, {measure}"""


sql("projects_by_vat_gdp_iso", AB + ("country_ref",), _by_vat_iso("gdp"))
sql("projects_by_vat_hdi", AB + ("country_ref",), _by_vat_iso("hdi"))

sql("projects_by_vat_gdp", AB + ("country_ref",), f"""
SELECT vatID, gdp, count(*) AS "count" FROM (
  SELECT d.vatID, d.projectURI, c.gdp
  FROM (SELECT DISTINCT vatID, country, projectURI FROM proj_b) d
  LEFT JOIN {_GDP_DIM} c ON d.country = c.country
  UNION ALL
  SELECT d.vatID, d.projectURI, c.gdp
  FROM (SELECT DISTINCT vatID, country, projectURI FROM proj_a) d
  LEFT JOIN (SELECT countryName AS cn, gdp FROM {_GDP_DIM} x) c ON d.country = c.cn) u
WHERE gdp IS NOT NULL GROUP BY vatID, gdp ORDER BY vatID DESC""")

sql("northern_projects", AB + ("country_allow",), f"""
, s1 AS (SELECT * FROM proj_a WHERE country IN (SELECT Country FROM country_allow)),
lk AS (SELECT countryCode, min(Country) AS label FROM country_allow GROUP BY countryCode),
s2 AS (SELECT b.orgURI, b.orgName, b.vatID, lk.label AS country, b.title
       FROM proj_b b JOIN lk ON b.country = lk.countryCode
       WHERE b.sDate >= DATE '{NORTHERN_START}' AND b.eDate <= DATE '{NORTHERN_END}'),
f1 AS (SELECT {FALLBACK} AS vatID, orgName, country, title FROM s1),
f2 AS (SELECT {FALLBACK} AS vatID, orgName, country, title FROM s2),
merged AS (SELECT DISTINCT vatID, lower(title) AS ProjectTitle
           FROM (SELECT vatID, title FROM f1 UNION ALL SELECT vatID, title FROM f2) u),
ci AS (SELECT vatID, COALESCE(min(country), '') AS Country FROM
       (SELECT DISTINCT country, vatID FROM f1 UNION SELECT DISTINCT country, vatID FROM f2) d
       GROUP BY vatID),
ni AS (SELECT vatID, COALESCE(min(orgName), '') AS LegalName FROM
       (SELECT DISTINCT orgName, vatID FROM f1 UNION SELECT DISTINCT orgName, vatID FROM f2) d
       GROUP BY vatID)
SELECT ni.LegalName, ci.Country, m.ProjectTitle
FROM merged m LEFT JOIN ci ON m.vatID = ci.vatID LEFT JOIN ni ON m.vatID = ni.vatID""")

_GAINS = f"""
, qa AS (SELECT {FALLBACK} AS vatID, lower(title) AS ProjectTitle FROM proj_a),
qb AS (SELECT {FALLBACK} AS vatID, lower(title) AS ProjectTitle FROM proj_b),
merged AS (SELECT DISTINCT vatID, ProjectTitle FROM (SELECT * FROM qa UNION ALL SELECT * FROM qb) u),
base AS (SELECT vatID, count(*) AS countByBase FROM qa GROUP BY vatID),
mc AS (SELECT vatID, count(*) AS countByMerge FROM merged GROUP BY vatID),
gains AS (SELECT vatID, countByBase, countByMerge, countByMerge - countByBase AS newProjects
          FROM base JOIN mc USING (vatID) WHERE countByMerge - countByBase > 0)"""
sql("new_projects_by_id", AB, _GAINS + "\nSELECT * FROM gains")
sql("new_projects_total", AB,
    _GAINS + "\nSELECT CAST(sum(newProjects) AS BIGINT) AS total_new_projects FROM gains")

_GROUPS = """SELECT cleanName, count(DISTINCT orgURI) AS n_uris, min(orgURI) AS canonicalURI
FROM all_orgs WHERE orgURI IS NOT NULL GROUP BY cleanName"""
sql("alias_groups", ("all_orgs",), _GROUPS)
sql("names_over_two_uris", ("all_orgs",), f"SELECT * FROM ({_GROUPS}) g WHERE n_uris > 2")

sql("alias_members", ("all_orgs",), f"""
, m AS (SELECT DISTINCT cleanName, orgURI FROM all_orgs
        WHERE cleanName IS NOT NULL AND orgURI IS NOT NULL),
r AS (SELECT cleanName, orgURI, count(*) OVER (PARTITION BY cleanName) AS n_uris,
             row_number() OVER (PARTITION BY cleanName ORDER BY orgURI) - 1 AS k FROM m)
SELECT cleanName, orgURI, n_uris, CAST(k // {CHUNK} AS BIGINT) AS chunk FROM r WHERE n_uris > 1""")

_CMAP = """
, m AS (SELECT DISTINCT cleanName, orgURI FROM all_orgs WHERE orgURI IS NOT NULL),
g AS (SELECT cleanName, min(orgURI) AS gmin FROM m WHERE cleanName IS NOT NULL GROUP BY cleanName),
cmap AS (SELECT m.orgURI, COALESCE(min(g.gmin), m.orgURI) AS canonicalURI
         FROM m LEFT JOIN g ON m.cleanName = g.cleanName GROUP BY m.orgURI)"""
sql("canonical_uri", ("all_orgs",), _CMAP + "\nSELECT orgURI, canonicalURI FROM cmap")

sql("multi_row_names", ("all_orgs",), """
SELECT o.orgName, o.cleanName, o.orgURI, o.title, o.source,
       CASE WHEN o.cleanName IS NULL THEN NULL ELSE COALESCE(d.dup, false) END AS multi_row_name
FROM all_orgs o LEFT JOIN (
  SELECT source, cleanName, true AS dup FROM all_orgs WHERE cleanName IS NOT NULL
  GROUP BY source, cleanName HAVING count(*) > 1) d
ON o.source = d.source AND o.cleanName = d.cleanName""")

sql("pubs_by_resolved_org", ("all_orgs",), _CMAP + """,
pre AS (SELECT o.orgName, o.title, c.canonicalURI AS newOrgURI
        FROM all_orgs o LEFT JOIN cmap c ON o.orgURI = c.orgURI),
names AS (SELECT newOrgURI, COALESCE(min(orgName), '') AS repName FROM pre
          WHERE newOrgURI IS NOT NULL GROUP BY newOrgURI),
pubs AS (SELECT DISTINCT newOrgURI, title FROM pre WHERE newOrgURI IS NOT NULL)
SELECT repName AS orgName, count(*) AS numberOfPublications
FROM pubs JOIN names USING (newOrgURI) GROUP BY repName
ORDER BY numberOfPublications DESC, orgName""")

sql("repositories_of", ("all_orgs",), """
, p AS (SELECT DISTINCT cleanName, source FROM all_orgs WHERE cleanName IS NOT NULL),
n AS (SELECT cleanName FROM p GROUP BY cleanName HAVING count(*) > 1)
SELECT p.cleanName, p.source,
       COALESCE((SELECT string_agg(q.source, ',' ORDER BY q.source) FROM p q
                 WHERE q.cleanName = p.cleanName AND q.source <> p.source), '') AS other_sources
FROM p JOIN n ON p.cleanName = n.cleanName""")

sql("multi_title_projects", AB, """
SELECT proj, count(DISTINCT title) AS n_titles
FROM (SELECT proj, title FROM proj_a UNION ALL SELECT proj, title FROM proj_b) u
GROUP BY proj HAVING count(DISTINCT title) > 1""")

sql("titles_per_vat_project", ("proj_b",), """
SELECT vatID, projectURI, count(DISTINCT title) AS n_titles
FROM proj_b GROUP BY vatID, projectURI""")

sql("rows_per_project", ("proj_b",), """
SELECT projectURI, count(*) AS "count" FROM proj_b GROUP BY projectURI ORDER BY "count" DESC""")

sql("rows_per_name", ("all_orgs",), """
SELECT cleanName, count(*) AS "count" FROM all_orgs GROUP BY cleanName ORDER BY "count" DESC""")

sql("name_search", ("all_orgs",), f"""
SELECT cleanName, count(*) AS n_rows FROM all_orgs
WHERE contains(upper(cleanName), '{SEARCH_TEXT}')
GROUP BY cleanName ORDER BY n_rows DESC, cleanName""")

sql("vat_lookup", AB, f"""
SELECT vatID, orgURI, orgName, projectURI, source FROM (
  SELECT vatID, orgURI, orgName, projectURI, source FROM proj_a
  UNION ALL SELECT vatID, orgURI, orgName, projectURI, source FROM proj_b) u
WHERE vatID = '{LOOKUP_VAT}'""")

_RESOLVED = f"""
, idx AS (
  SELECT v.o AS value, min(h.s) AS projectURI
  FROM quads h
  JOIN quads n ON n.s = h.o AND n.g = '{fx.G_PROJECTS}' AND n.p = '{fx.ID_NAME}'
                AND n.o = 'rcn' AND n.o_type = 'string'
  JOIN quads v ON v.s = h.o AND v.g = '{fx.G_PROJECTS}' AND v.p = '{fx.ID_VALUE}'
                AND v.o_type = 'string'
  JOIN quads t ON t.s = h.s AND t.g = '{fx.G_PROJECTS}' AND t.p = '{fx.RDF_TYPE}'
                AND t.o = '{fx.CLS_PROJECT}'
  WHERE h.g = '{fx.G_PROJECTS}' AND h.p = '{fx.HAS_IDENTIFIER}'
  GROUP BY v.o),
resolved AS (
  SELECT c.project_id, c.rcn, c.category, COALESCE(i.projectURI, '') AS projectURI
  FROM (SELECT DISTINCT project_id, rcn, category FROM classification) c
  LEFT JOIN idx i ON CAST(c.rcn AS VARCHAR) = i.value)"""
QC = ("quads", "classification")
sql("resolve_identifier", QC, _RESOLVED + "\nSELECT * FROM resolved")
sql("annotate_fields", QC, _RESOLVED + f"""
SELECT DISTINCT '{fx.G_PROJECTS}' AS g, projectURI AS s, '{fx.HAS_FIELD}' AS p,
       category AS o, 'string' AS o_type
FROM resolved WHERE projectURI <> ''
EXCEPT SELECT g, s, p, o, o_type FROM quads""")
sql("annotated_graph", QC, _RESOLVED + f"""
SELECT g, s, p, o, o_type FROM quads
UNION ALL
(SELECT DISTINCT '{fx.G_PROJECTS}' AS g, projectURI AS s, '{fx.HAS_FIELD}' AS p,
        category AS o, 'string' AS o_type
 FROM resolved WHERE projectURI <> ''
 EXCEPT SELECT g, s, p, o, o_type FROM quads)""")
sql("annotate_counts", QC, _RESOLVED + "\n" + metric_rows(
    ("rows_in", "(SELECT count(*) FROM resolved WHERE projectURI <> '')"),
    ("rows_out", "(SELECT count(*) FROM resolved WHERE projectURI = '')")))

_g, _s, _p, _o, _ot = DOOMED_TRIPLE
sql("delete_triple", ("quads",), f"""
SELECT * FROM quads
WHERE NOT COALESCE(g = '{_g}' AND s = '{_s}' AND p = '{_p}' AND o = '{_o}' AND o_type = '{_ot}',
                   false)""")
sql("delete_predicate", ("quads",), f"""
SELECT * FROM quads WHERE NOT (g IS NOT DISTINCT FROM '{fx.G_PROJECTS}'
                               AND p IS NOT DISTINCT FROM '{fx.HAS_FIELD}')""")
sql("clear_graph", ("quads",), f"""
SELECT * FROM quads WHERE g IS DISTINCT FROM '{fx.G_PATENTS}'""")
sql("list_graphs", ("quads",), "SELECT DISTINCT g FROM quads ORDER BY g")
sql("category_labels", ("classification",), "SELECT DISTINCT category FROM classification")
sql("csv_roundtrip", ("proj_a",), "SELECT * EXCLUDE (countryCode) FROM proj_a")
sql("orgs_from_files", ("all_orgs",), "SELECT orgName, orgURI, title FROM all_orgs")
SQL["report_csv"] = SQL["org_budget"]     # the written-and-read-back Q1 report

_DIRTY = f"""
, e AS (SELECT orgName, orgURI, title, no, no % {DIRT_STEP} AS k
        FROM (SELECT *, CAST(regexp_extract(orgURI, '([0-9]+)$', 1) AS BIGINT) AS no FROM proj_c) x)"""
sql("csv_rejects", ("proj_c",), _DIRTY + """
SELECT status, count(k) AS n_records
FROM (SELECT unnest(['good', 'quote', 'short', 'long', 'type']) AS status) s
LEFT JOIN (SELECT k, CASE k WHEN 2 THEN 'type' WHEN 3 THEN 'short' WHEN 5 THEN 'long'
                     WHEN 7 THEN 'quote' ELSE 'good' END AS status FROM e) t USING (status)
GROUP BY status""")
sql("csv_accepted", ("proj_c",), _DIRTY + """
SELECT orgName, orgURI, title, no FROM e WHERE k NOT IN (2, 3, 5, 7)""")
sql("multiline_report", ("proj_a",), """
SELECT country, count(*) AS n_projects,
       count(CASE WHEN contains(title, chr(10)) THEN 1 END) AS n_broken_titles
FROM proj_a GROUP BY country""")
