"""Enrichment with the country dimension (J3, J4, J8, J12, F1, F2, A11; Q5-Q7, Q13).

The dimension is joined without a ``broadcast`` hint: Spark broadcasts it
only when its estimated (and, under AQE, measured) size is below
``spark.sql.autoBroadcastJoinThreshold``, and falls back to a shuffle join
otherwise - the size check lives in the planner, not in a guess here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.normalize import fallback_id
from ..session import written
from .merge import min_per_key, union_all
from .skew import hot_keys, salted_join


def org_projects(df: DataFrame, org: str = "orgURI") -> DataFrame:
    """Distinct (org, country, project); the title ``collect_set`` of the
    reference is never used afterwards, so it is not computed."""
    return df.select(org, "country", "projectURI").distinct()


def projects_by_org(code_src: DataFrame, label_src: DataFrame, dim: DataFrame,
                    measure: str, label_join: str = "using") -> DataFrame:
    """Q5 (measure=hdi) / Q6 (measure=gdp).

    code_src  : country holds the dimension's code -> J3 ``USING(country)``
    label_src : country holds the label            -> J3 ``USING(countryName)``
                (label_join="using") or J4 ``country = countryName``
                (label_join="on", both columns kept), or the dimension's
                ISO code -> ``country = iso`` (label_join="iso")
    Then UNION ALL, keep rows with a known measure (F1; Catalyst pushes it
    below the union and turns the outer joins into inner ones), count
    projects per (org, measure, countryName), attach one name per org.
    """
    o1 = (org_projects(code_src)
          .join(dim.select("country", measure, "countryName"), "country", "left")
          .select("orgURI", "projectURI", measure, "countryName"))
    if label_join == "using":
        c2 = (org_projects(label_src).withColumnRenamed("country", "countryName")
              .join(dim.select(measure, "countryName"), "countryName", "left"))
    elif label_join == "iso":
        c2 = org_projects(label_src).join(dim.select(F.col("iso").alias("country"), measure,
                                                     "countryName"), "country", "left")
    else:
        d = dim.select(F.col("countryName").alias("_cn"), measure)
        c2 = (org_projects(label_src)
              .join(d, F.col("country") == F.col("_cn"), "left")
              .withColumnRenamed("_cn", "countryName"))
    c2 = c2.select("orgURI", "projectURI", measure, "countryName")
    result = (o1.unionByName(c2)
              .filter(F.col(measure).isNotNull())
              .groupBy("orgURI", measure, "countryName").count())
    # quirk l: one name per URI over both sources
    names = min_per_key(union_all(code_src, label_src, cols=["orgURI", "orgName"]),
                        ["orgURI"], ["orgName"])
    return (result.join(names, "orgURI").drop("orgURI")
            .select(measure, "countryName", "count", "orgName")
            .orderBy(F.desc("count"), F.asc("orgName"), F.asc("countryName"), F.asc(measure)))


def projects_by_vat(code_src: DataFrame, label_src: DataFrame, dim: DataFrame,
                    measure: str = "gdp", label_key: str = "countryName") -> DataFrame:
    """Q7: projects per (vatID, measure), vatID descending.

    The country of ``label_src`` is matched with the dimension's ``label_key``
    (its label, or ``iso``).

    The reference drops ``vatID`` from its column list and fails analysis
    (quirk f); here the id is part of the input schema.
    """
    o1 = (code_src.select("vatID", "country", "projectURI").distinct()
          .join(dim.select("country", measure), "country", "left"))
    d = dim.select(F.col(label_key).alias("_cn"), measure)
    c2 = (label_src.select("vatID", "country", "projectURI").distinct()
          .join(d, F.col("country") == F.col("_cn"), "left"))
    u = o1.select("vatID", "projectURI", measure).unionByName(c2.select("vatID", "projectURI", measure))
    return (u.filter(F.col(measure).isNotNull())
            .groupBy("vatID", measure).count()
            .orderBy(F.desc_nulls_last("vatID"), F.desc("count"), F.asc(measure)))


def in_date_range(df: DataFrame, start: str, end: str,
                  s_col: str = "sDate", e_col: str = "eDate") -> DataFrame:
    """``start <= sDate`` and ``eDate <= end``, both inclusive; NULL dates drop.
    Literal dates keep the predicate pushable into the Parquet scan."""
    return df.filter((F.col(s_col) >= F.lit(start).cast("date")) &
                     (F.col(e_col) <= F.lit(end).cast("date")))


def allow_list(df: DataFrame, allowed: DataFrame, df_col: str, allowed_col: str,
               label_col: str | None = None) -> DataFrame:
    """Keep rows whose ``df_col`` is on the allow-list.

    The list is de-duplicated first, so an inner join cannot multiply rows
    (the reference's inner join would).  With ``label_col`` the matching
    label replaces ``df_col`` (code -> label, quirk i); otherwise a semi join.
    """
    if label_col is None:
        keys = allowed.select(F.col(allowed_col).alias(df_col)).distinct()
        return df.join(keys, df_col, "left_semi")
    lookup = (allowed.groupBy(F.col(allowed_col).alias("_k"))
              .agg(F.min(label_col).alias("_label")))
    return (df.join(lookup, F.col(df_col) == F.col("_k"))
            .withColumn(df_col, F.col("_label")).drop("_k", "_label"))


def northern_projects(src1: DataFrame, src2: DataFrame, allowed: DataFrame,
                      start: str, end: str) -> DataFrame:
    """Q13: (LegalName, Country, ProjectTitle) of allow-listed countries.

    src1 country = label, src2 country = code and src2 is limited to the date
    range.  Tax ids fall back to the org URI when missing (E10); merge by id
    (E9); one country and one legal name per id (E11, ``min``) - both taken in
    a single aggregation over the union, then one left join (J12).  The narrow
    union is written once, so each source is read once.
    """
    s1 = allow_list(src1, allowed, "country", "Country")
    s2 = allow_list(in_date_range(src2, start, end), allowed, "country", "countryCode",
                    label_col="Country")
    s1 = s1.withColumn("vatID", fallback_id("vatID", "orgURI"))
    s2 = s2.withColumn("vatID", fallback_id("vatID", "orgURI"))
    rows = written(union_all(s1, s2, cols=["vatID", "title", "country", "orgName"]).distinct(),
                   "northern-rows")
    merged = rows.select("vatID", F.lower("title").alias("ProjectTitle")).distinct()
    info = min_per_key(rows, ["vatID"], ["country", "orgName"], ["Country", "LegalName"])
    hot = hot_keys(merged.groupBy("vatID").agg(F.count(F.lit(1)).alias("_t")), ["vatID"], "_t")
    return (salted_join(merged, info, ["vatID"], "left", hot)
            .select("LegalName", "Country", "ProjectTitle"))
