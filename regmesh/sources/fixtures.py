"""Registry-shaped views derived from the base tables.

The reference reads CSV extracts of research registries; the test data is a
TPC-H-like star schema.  These views re-shape whole base tables (no sampling,
no id subsets) into the registry schemas the operators expect, so every query
grows with its input.  Each view exists twice: as a Spark DataFrame builder
and as an SQL twin used by the DuckDB oracle.  Both must stay in step.

Views (grain):
  proj_a          orders x customer x nation   - registry A participation
  proj_b          lineitem x supplier          - registry B participation
  proj_c          events                       - registry C (org, title)
  all_orgs        proj_a U proj_b U proj_c     - (orgName, cleanName, orgURI, title, source)
  country_ref     nation                       - country dimension (hdi, gdp)
  country_allow   country_ref, region 3        - country allow-list
  results         events                       - results by organisation type
  pubs            lineitem x orders x part     - publications by project/year
  classification  documents                    - (project_id, rcn, category)
  quads           orders, part                 - RDF quads (g, s, p, o, o_type)
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.normalize import clean, clean_title
from .tables import Tables

# Fixed vocabulary of the quad fixture (graph, predicate and class names).
G_PROJECTS = "urn:g:projects"
G_PATENTS = "urn:g:patents"
RDF_TYPE = "rdf:type"
HAS_IDENTIFIER = "s66:hasIdentifier"
ID_NAME = "s66:name"
ID_VALUE = "s66:value"
HAS_FIELD = "s66:hasFieldOfScience"
CLS_PROJECT = "s66:Project"
CLS_PATENT = "s66:Patent"


def _str(c) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return c.cast("string")


def _pre(prefix: str, c) -> Column:
    return F.concat(F.lit(prefix), _str(c))


def _div(c: str, n: int) -> Column:
    """Whole-number division: a key domain that grows with the table."""
    return F.expr(f"{c} div {n}")


# --------------------------------------------------------------------------
# Spark builders
# --------------------------------------------------------------------------

def proj_a(t: Tables) -> DataFrame:
    o, c, n = t["orders"], t["customer"], t["nation"]
    j = (o.join(c, o["o_custkey"] == c["c_custkey"])
          .join(n, c["c_nationkey"] == n["n_nationkey"]))
    title = _pre("Project ", _div("o_orderkey", 4))
    return j.select(
        _pre("http://a.example/p/", "o_orderkey").alias("projectURI"),
        F.when(F.col("o_orderkey") % 17 == 0, F.concat(title, F.lit("\nphase 2")))
         .when(F.col("o_orderkey") % 13 == 0, F.concat(F.lit('"'), title, F.lit('"')))
         .otherwise(title).alias("title"),
        _pre("ACR", _div("o_orderkey", 5)).alias("acronym"),
        _pre("http://a.example/o/", "c_custkey").alias("orgURI"),
        F.when(F.col("o_orderkey") % 10 == 0, _pre("Solo ", "o_orderkey"))
         .otherwise(_pre("Org ", _div("c_custkey", 2))).alias("orgName"),
        F.col("n_name").alias("country"),
        _pre("V", "c_custkey").alias("vatID"),
        _str("c_custkey").alias("pic"),
        _str("o_orderkey").alias("proj"),
        F.col("o_totalprice").alias("budget"),
        F.col("o_orderdate").cast("date").alias("sDate"),
        F.date_add(F.col("o_orderdate").cast("date"), (F.col("o_orderkey") % 400).cast("int"))
         .alias("eDate"),
        F.lit("A").alias("source"),
        _pre("I", "n_nationkey").alias("countryCode"),
    )


def proj_b(t: Tables) -> DataFrame:
    li, s = t["lineitem"], t["supplier"]
    j = li.join(s, li["l_suppkey"] == s["s_suppkey"])
    k = F.col("s_suppkey") % 7
    return j.select(
        _pre("http://b.example/p/", "l_orderkey").alias("projectURI"),
        F.when(F.col("l_orderkey") % 5 == 0, _pre("Project ", _div("l_orderkey", 4)))
         .when(F.col("l_orderkey") % 7 == 0, _pre("Study ", _div("l_orderkey", 4)))
         .otherwise(F.concat(F.lit("  PROJECT "),
                             _str(_div("l_orderkey", 4) + 500 + F.col("l_linenumber") % 2),
                             F.lit(" "))).alias("title"),
        F.when((F.col("l_orderkey") % 11 == 0) | (F.col("s_suppkey") % 10 == 0),
               F.lit(None).cast("string"))
         .when(F.col("l_orderkey") % 5 == 0, _pre("acr", _div("l_orderkey", 5)))
         .otherwise(_pre("acr", _div("l_orderkey", 3) + 1000)).alias("acronym"),
        _pre("http://b.example/o/", "s_suppkey").alias("orgURI"),
        F.when(F.col("s_suppkey") % 10 == 9, _pre("Lab ", "s_suppkey"))
         .when(F.col("s_suppkey") % 3 == 0, _pre("Org ", "s_suppkey"))
         .otherwise(F.concat(F.lit(" ORG "), _str("s_suppkey"), F.lit(" "))).alias("orgName"),
        _pre("C", "s_nationkey").alias("country"),
        F.when(k == 0, F.lit(None).cast("string"))
         .when(k == 1, F.lit("NaN"))
         .when(k == 2, F.lit("missing"))
         .when(k == 3, _pre("v", "s_suppkey"))
         .otherwise(_pre("V", "s_suppkey")).alias("vatID"),
        _str("s_suppkey").alias("pic"),
        _str("l_orderkey").alias("proj"),
        F.col("l_extendedprice").alias("budget"),
        F.col("l_shipdate").cast("date").alias("sDate"),
        F.date_add(F.col("l_shipdate").cast("date"), (F.col("l_orderkey") % 400).cast("int"))
         .alias("eDate"),
        F.lit("B").alias("source"),
    )


def proj_c(t: Tables) -> DataFrame:
    e = t["events"]
    return e.select(
        F.when(F.col("user_id") % 4 == 0, _pre("Org ", "user_id"))
         .otherwise(_pre("org ", "user_id")).alias("orgName"),
        _pre("http://c.example/o/", "user_id").alias("orgURI"),
        F.when(F.col("event_id") % 3 == 0, _pre("Project ", _div("event_id", 2)))
         .otherwise(_pre("project ", _div("event_id", 2))).alias("title"),
        F.when(F.col("event_id") % 2 == 0, _pre("http://b.example/p/", _div("event_id", 2)))
         .otherwise(_pre("http://c.example/p/", _div("event_id", 3))).alias("projectURI"),
        F.lit("C").alias("source"),
    )


ORG_COLS = ("orgName", "orgURI", "title", "source")


def all_orgs(t: Tables) -> DataFrame:
    u = (proj_a(t).select(*ORG_COLS)
         .unionByName(proj_b(t).select(*ORG_COLS))
         .unionByName(proj_c(t).select(*ORG_COLS)))
    return u.select("orgName", clean("orgName").alias("cleanName"), "orgURI", "title", "source")


def country_ref(t: Tables) -> DataFrame:
    n = t["nation"]
    return n.select(
        _pre("C", "n_nationkey").alias("country"),
        F.col("n_name").alias("countryName"),
        _pre("I", "n_nationkey").alias("iso"),
        F.when(F.col("n_regionkey") == 4, F.lit(None).cast("double"))
         .otherwise((F.col("n_nationkey") + 50).cast("double") / 100).alias("hdi"),
        F.when(F.col("n_regionkey") == 1, F.lit(None).cast("double"))
         .otherwise((F.col("n_nationkey") * 1000).cast("double")).alias("gdp"),
        F.col("n_regionkey"),
    )


def country_allow(t: Tables) -> DataFrame:
    """Allow-list (country label, country code): the countries of region 3."""
    return (country_ref(t).filter(F.col("n_regionkey") == 3)
            .select(F.col("countryName").alias("Country"), F.col("country").alias("countryCode")))


def results(t: Tables) -> DataFrame:
    e = t["events"]
    return e.select(_str("user_id").alias("orgURI"), _str("event_id").alias("resultURI"),
                    F.col("event_type").alias("catLabel"))


def pubs(t: Tables) -> DataFrame:
    li, o, p = t["lineitem"], t["orders"], t["part"]
    j = (li.join(o, li["l_orderkey"] == o["o_orderkey"])
           .join(p, li["l_partkey"] == p["p_partkey"]))
    title = (F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit('"'), F.col("p_name"), F.lit('"')))
             .otherwise(F.col("p_name")))
    return j.select(
        F.year("o_orderdate").cast("int").alias("year"),
        F.col("o_orderpriority").alias("projTitle"),
        title.alias("title"),
        clean_title(title).alias("cleanTitle"),
    )


def classification(t: Tables) -> DataFrame:
    d = t["documents"]
    return d.select(
        _str("doc_id").alias("project_id"),
        (F.col("doc_id") * 3).alias("rcn"),
        F.concat(F.col("lang"), F.lit("/"), F.col("source")).alias("category"),
    )


def quads(t: Tables) -> DataFrame:
    """One scan of orders emits every order's triples through ``inline``."""
    o = t["orders"]
    p_uri = _pre("p/", "o_orderkey")
    i_uri = _pre("id/", "o_orderkey")

    def q(s, p, obj, otype):
        return F.struct(s.alias("s"), F.lit(p).alias("p"), obj.alias("o"),
                        F.lit(otype).alias("o_type"))

    per_order = F.array(
        q(p_uri, RDF_TYPE, F.lit(CLS_PROJECT), "uri"),
        q(p_uri, HAS_IDENTIFIER, i_uri, "uri"),
        q(i_uri, ID_NAME,
          F.when(F.col("o_orderstatus") != "P", F.lit("rcn")).otherwise(F.lit("doi")),
          "string"),
        q(i_uri, ID_VALUE, _str("o_orderkey"), "string"),
        q(p_uri, HAS_FIELD,
          F.when(F.col("o_orderstatus") == "F", F.lit("physics")), "string"),
    )
    projects = (o.select(F.inline(per_order))
                 .filter(F.col("o").isNotNull())
                 .select(F.lit(G_PROJECTS).alias("g"), "s", "p", "o", "o_type"))
    patents = t["part"].select(
        F.lit(G_PATENTS).alias("g"), _pre("pt/", "p_partkey").alias("s"),
        F.lit(RDF_TYPE).alias("p"), F.lit(CLS_PATENT).alias("o"), F.lit("uri").alias("o_type"))
    return projects.unionByName(patents)


BUILDERS = {
    "proj_a": proj_a, "proj_b": proj_b, "proj_c": proj_c, "all_orgs": all_orgs,
    "country_ref": country_ref, "country_allow": country_allow, "results": results,
    "pubs": pubs, "classification": classification, "quads": quads,
}


def view(t: Tables, name: str) -> DataFrame:
    return BUILDERS[name](t)


# --------------------------------------------------------------------------
# SQL twins (DuckDB dialect, base tables pre-registered as views)
# --------------------------------------------------------------------------

VIEW_SQL: dict[str, tuple[str, tuple[str, ...]]] = {
    "proj_a": ("""
  SELECT 'http://a.example/p/' || CAST(o_orderkey AS VARCHAR) AS projectURI,
         CASE WHEN o_orderkey % 17 = 0
              THEN 'Project ' || CAST(o_orderkey // 4 AS VARCHAR) || chr(10) || 'phase 2'
              WHEN o_orderkey % 13 = 0 THEN '"Project ' || CAST(o_orderkey // 4 AS VARCHAR) || '"'
              ELSE 'Project ' || CAST(o_orderkey // 4 AS VARCHAR) END AS title,
         'ACR' || CAST(o_orderkey // 5 AS VARCHAR) AS acronym,
         'http://a.example/o/' || CAST(c_custkey AS VARCHAR) AS orgURI,
         CASE WHEN o_orderkey % 10 = 0 THEN 'Solo ' || CAST(o_orderkey AS VARCHAR)
              ELSE 'Org ' || CAST(c_custkey // 2 AS VARCHAR) END AS orgName,
         n_name AS country,
         'V' || CAST(c_custkey AS VARCHAR) AS vatID,
         CAST(c_custkey AS VARCHAR) AS pic,
         CAST(o_orderkey AS VARCHAR) AS proj,
         o_totalprice AS budget,
         CAST(o_orderdate AS DATE) AS sDate,
         CAST(o_orderdate AS DATE) + CAST(o_orderkey % 400 AS INTEGER) AS eDate,
         'A' AS source,
         'I' || CAST(n_nationkey AS VARCHAR) AS countryCode
  FROM orders JOIN customer ON o_custkey = c_custkey
              JOIN nation ON c_nationkey = n_nationkey""", ()),
    "proj_b": ("""
  SELECT 'http://b.example/p/' || CAST(l_orderkey AS VARCHAR) AS projectURI,
         CASE WHEN l_orderkey % 5 = 0 THEN 'Project ' || CAST(l_orderkey // 4 AS VARCHAR)
              WHEN l_orderkey % 7 = 0 THEN 'Study ' || CAST(l_orderkey // 4 AS VARCHAR)
              ELSE '  PROJECT ' || CAST(l_orderkey // 4 + 500 + l_linenumber % 2 AS VARCHAR) || ' '
              END AS title,
         CASE WHEN l_orderkey % 11 = 0 OR s_suppkey % 10 = 0 THEN NULL
              WHEN l_orderkey % 5 = 0 THEN 'acr' || CAST(l_orderkey // 5 AS VARCHAR)
              ELSE 'acr' || CAST(l_orderkey // 3 + 1000 AS VARCHAR) END AS acronym,
         'http://b.example/o/' || CAST(s_suppkey AS VARCHAR) AS orgURI,
         CASE WHEN s_suppkey % 10 = 9 THEN 'Lab ' || CAST(s_suppkey AS VARCHAR)
              WHEN s_suppkey % 3 = 0 THEN 'Org ' || CAST(s_suppkey AS VARCHAR)
              ELSE ' ORG ' || CAST(s_suppkey AS VARCHAR) || ' ' END AS orgName,
         'C' || CAST(s_nationkey AS VARCHAR) AS country,
         CASE WHEN s_suppkey % 7 = 0 THEN NULL
              WHEN s_suppkey % 7 = 1 THEN 'NaN'
              WHEN s_suppkey % 7 = 2 THEN 'missing'
              WHEN s_suppkey % 7 = 3 THEN 'v' || CAST(s_suppkey AS VARCHAR)
              ELSE 'V' || CAST(s_suppkey AS VARCHAR) END AS vatID,
         CAST(s_suppkey AS VARCHAR) AS pic,
         CAST(l_orderkey AS VARCHAR) AS proj,
         l_extendedprice AS budget,
         CAST(l_shipdate AS DATE) AS sDate,
         CAST(l_shipdate AS DATE) + CAST(l_orderkey % 400 AS INTEGER) AS eDate,
         'B' AS source
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey""", ()),
    "proj_c": ("""
  SELECT CASE WHEN user_id % 4 = 0 THEN 'Org ' ELSE 'org ' END || CAST(user_id AS VARCHAR) AS orgName,
         'http://c.example/o/' || CAST(user_id AS VARCHAR) AS orgURI,
         CASE WHEN event_id % 3 = 0 THEN 'Project ' ELSE 'project ' END
           || CAST(event_id // 2 AS VARCHAR) AS title,
         CASE WHEN event_id % 2 = 0 THEN 'http://b.example/p/' || CAST(event_id // 2 AS VARCHAR)
              ELSE 'http://c.example/p/' || CAST(event_id // 3 AS VARCHAR) END AS projectURI,
         'C' AS source
  FROM events""", ()),
    "all_orgs": ("""
  SELECT orgName, trim(lower(orgName)) AS cleanName, orgURI, title, source FROM (
    SELECT orgName, orgURI, title, source FROM proj_a
    UNION ALL SELECT orgName, orgURI, title, source FROM proj_b
    UNION ALL SELECT orgName, orgURI, title, source FROM proj_c) u""",
                 ("proj_a", "proj_b", "proj_c")),
    "country_ref": ("""
  SELECT 'C' || CAST(n_nationkey AS VARCHAR) AS country,
         n_name AS countryName,
         'I' || CAST(n_nationkey AS VARCHAR) AS iso,
         CASE WHEN n_regionkey = 4 THEN NULL
              ELSE CAST(n_nationkey + 50 AS DOUBLE) / 100 END AS hdi,
         CASE WHEN n_regionkey = 1 THEN NULL
              ELSE CAST(n_nationkey * 1000 AS DOUBLE) END AS gdp,
         n_regionkey
  FROM nation""", ()),
    "country_allow": ("""
  SELECT countryName AS Country, country AS countryCode FROM country_ref WHERE n_regionkey = 3""",
                      ("country_ref",)),
    "results": ("""
  SELECT CAST(user_id AS VARCHAR) AS orgURI, CAST(event_id AS VARCHAR) AS resultURI,
         event_type AS catLabel
  FROM events""", ()),
    "pubs": ("""
  SELECT CAST(year(o_orderdate) AS INTEGER) AS year, o_orderpriority AS projTitle,
         CASE WHEN p_partkey % 3 = 0 THEN '"' || p_name || '"' ELSE p_name END AS title,
         trim(lower(replace(p_name, '"', ''))) AS cleanTitle
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
                JOIN part ON l_partkey = p_partkey""", ()),
    "classification": ("""
  SELECT CAST(doc_id AS VARCHAR) AS project_id, doc_id * 3 AS rcn,
         lang || '/' || source AS category
  FROM documents""", ()),
    "quads": (f"""
  SELECT '{G_PROJECTS}' AS g, 'p/' || CAST(o_orderkey AS VARCHAR) AS s, '{RDF_TYPE}' AS p,
         '{CLS_PROJECT}' AS o, 'uri' AS o_type FROM orders
  UNION ALL
  SELECT '{G_PROJECTS}', 'p/' || CAST(o_orderkey AS VARCHAR), '{HAS_IDENTIFIER}',
         'id/' || CAST(o_orderkey AS VARCHAR), 'uri' FROM orders
  UNION ALL
  SELECT '{G_PROJECTS}', 'id/' || CAST(o_orderkey AS VARCHAR), '{ID_NAME}',
         CASE WHEN o_orderstatus <> 'P' THEN 'rcn' ELSE 'doi' END, 'string' FROM orders
  UNION ALL
  SELECT '{G_PROJECTS}', 'id/' || CAST(o_orderkey AS VARCHAR), '{ID_VALUE}',
         CAST(o_orderkey AS VARCHAR), 'string' FROM orders
  UNION ALL
  SELECT '{G_PROJECTS}', 'p/' || CAST(o_orderkey AS VARCHAR), '{HAS_FIELD}',
         'physics', 'string' FROM orders WHERE o_orderstatus = 'F'
  UNION ALL
  SELECT '{G_PATENTS}', 'pt/' || CAST(p_partkey AS VARCHAR), '{RDF_TYPE}',
         '{CLS_PATENT}', 'uri' FROM part""", ()),
}


def with_views(body: str, *names: str) -> str:
    """Prefix ``body`` with the CTEs of the named views (dependencies first)."""
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for d in VIEW_SQL[n][1]:
            visit(d)
        order.append(n)

    for n in names:
        visit(n)
    ctes = ",\n".join(f"{n} AS ({VIEW_SQL[n][0]}\n)" for n in order)
    return f"WITH {ctes}\n{body.strip()}"
