"""Unit tests on hand-written edge frames (FIXTURES.md section 3, SURVEY 2.15)."""

import datetime as dt

from pyspark.sql import functions as F

from regmesh.functions.normalize import clean, clean_title, fallback_id, to_double, try_date
from regmesh.operators import enrich, merge, overlap, resolve
from regmesh.operators.overlap import ROWS, Rows, Source, distinct, intersected, joined
from tests.util import rows


def metric_dict(df):
    return {r["metric"]: r["value"] for r in df.collect()}


# --- normalisation ----------------------------------------------------------

def test_clean_trims_spaces_only_and_lowers_unicode(spark):
    df = spark.createDataFrame([(" É X ",), ("a\t",), ("",), (None,), ('"Q" x',)], "s string")
    got = [r[0] for r in df.select(clean("s")).collect()]
    assert got == ["é x", "a\t", "", None, '"q" x']
    got = [r[0] for r in df.select(clean_title("s")).collect()]
    assert got[-1] == "q x"


def test_fallback_id_sentinels(spark):
    df = spark.createDataFrame(
        [(None, "u1"), ("nan", "u2"), ("NaN", "u3"), ("MISSING", "u4"), ("V1", "u5"), (None, None)],
        "vatID string, orgURI string")
    got = [r[0] for r in df.select(fallback_id("vatID", "orgURI")).collect()]
    assert got == ["u1", "u2", "u3", "u4", "V1", None]


def test_tolerant_casts(spark):
    df = spark.createDataFrame([("1.5",), ("1,5",), ("",), (None,)], "b string")
    assert [r[0] for r in df.select(to_double("b")).collect()] == [1.5, None, None, None]
    d = spark.createDataFrame([("2020-01-31",), ("nope",), (None,)], "d string")
    assert [r[0] for r in d.select(try_date("d")).collect()] == [dt.date(2020, 1, 31), None, None]


# --- representative names (quirks a1-a5) ------------------------------------

def test_representative_is_min_and_never_cut(spark):
    a = spark.createDataFrame([("1", "Max-Planck"), ("1", "Acme, Inc"), ("2", "my_org"),
                               ("3", "a$b"), ("4", None)], "pic string, name string")
    b = spark.createDataFrame([("1", "Zeta"), ("2", None)], "pic string, name string")
    got = dict(rows(merge.representative([a, b], "pic", "name")))
    assert got == {"1": "Acme, Inc", "2": "my_org", "3": "a$b", "4": ""}


# --- overlap NULL rules ----------------------------------------------------------

def test_overlap_null_rules(spark):
    a = spark.createDataFrame([("x",), ("y",), (None,), ("x",)], "k string")
    b = spark.createDataFrame([("x",), (None,), ("z",)], "k string")
    keys = (("k", F.col("k")), ("rows", ROWS))
    m = metric_dict(overlap.overlap_metrics(
        [Source(a, 0, keys), Source(b, 1, (("k", F.col("k")),))],
        [distinct("da", "k", 0), distinct("db", "k", 1), joined("j", "k", 0, 1),
         intersected("i", "k", 0, 1), Rows("ra", "rows")]))
    assert m == {"da": 3, "db": 3, "j": 1, "i": 2, "ra": 4}
    assert m["j"] <= min(m["da"], m["db"])


def test_pair_counts_include_fan_out(spark):
    a = spark.createDataFrame([("k",), ("k",), (None,), ("q",)], "t string")
    b = spark.createDataFrame([("k",), ("k",), ("k",), (None,)], "t string")
    m = metric_dict(overlap.pair_counts(a, b, [("pairs", F.col("t"), F.col("t"))]))
    assert m == {"pairs": 6}


def test_shared_title_delta_can_be_negative(spark):
    a = spark.createDataFrame([("n", "t1"), (None, "t9")], "cleanName string, title string")
    b = spark.createDataFrame([("n", "t1"), ("n", "t2"), ("n", "t3"), (None, "t8")],
                              "cleanName string, title string")
    m = metric_dict(overlap.shared_title_delta([a, b], [("p", 0, 1)]))
    # NULL is a shared name for the count, but NULL-named rows never pass isin
    assert m == {"p_shared_names": 2, "p_titles_a": 1, "p_titles_b": 3, "p_title_delta": -2,
                 "p_titles_only_a": 0}


def test_gained_projects(spark):
    a = spark.createDataFrame([("n1",), ("n2",), (None,)], "cleanName string")
    b = spark.createDataFrame([("n1", "p1"), ("n1", "p2"), ("n3", "p3"), (None, "p4")],
                              "cleanName string, projectURI string")
    c = spark.createDataFrame([("n2",)], "cleanName string")
    m = metric_dict(overlap.gained_projects(a, b, c))
    assert m == {"orgs_a": 3, "orgs_bc": 4, "shared_orgs": 2, "gained_projects": 2}


def test_names_sharing_keys(spark):
    a = spark.createDataFrame([("t1", "a1"), ("t2", "a2"), (None, "a3")],
                              "title string, cleanName string")
    b = spark.createDataFrame([("t1", "b1"), ("t3", "b3"), (None, "b4")],
                              "title string, cleanName string")
    got = rows(overlap.names_sharing_keys(a, b, F.col("title"), F.col("title")), "side", "cleanName")
    assert got == [("A", "a1"), ("B", "b1")]


# --- resolution (quirk b, c) -------------------------------------------------------

def _orgs(spark):
    return spark.createDataFrame([
        ("g1", "http://x/1", "t1", "S1", "Org One"),
        ("g1", "http://x/5", "t2", "S1", "org one"),
        ("g2", "http://x/10", "t3", "S2", "Org Ten"),
        ("g2", "http://x/5", "t4", "S2", "Org Five"),
        ("g3", "http://x/10", "t5", "S1", "Ten"),
        ("g4", "http://x/7", "t6", "S2", "Seven"),
        (None, "http://x/8", "t7", "S1", "Eight"),
        ("g5", None, "t8", "S1", "Nobody"),
    ], "cleanName string, orgURI string, title string, source string, orgName string")


def test_canonical_uri_exact_membership_and_min(spark):
    got = dict(rows(resolve.canonical_uri(_orgs(spark))))
    assert got == {
        "http://x/1": "http://x/1",
        "http://x/5": "http://x/1",     # in g1 (min /1) and g2 (min /10): smallest wins
        "http://x/10": "http://x/10",   # never merged with /1 (no substring test)
        "http://x/7": "http://x/7",     # singleton group keeps itself
        "http://x/8": "http://x/8",     # only a NULL name: keeps itself
    }
    assert all(c <= u for u, c in got.items())


def test_with_canonical_keeps_row_count(spark):
    o = _orgs(spark)
    w = resolve.with_canonical(o)
    assert w.count() == o.count()
    assert rows(w.filter(F.col("orgURI").isNull()), "newOrgURI") == [(None,)]


def test_canonical_idempotent_without_shared_uris(spark):
    o = spark.createDataFrame([("a", "u3"), ("a", "u1"), ("b", "u2"), ("b", "u4"), ("c", "u5")],
                              "cleanName string, orgURI string")
    first = resolve.canonical_uri(o)
    again = resolve.canonical_uri(
        o.join(first, "orgURI").select("cleanName", F.col("canonicalURI").alias("orgURI")))
    assert rows(again.filter(F.col("orgURI") != F.col("canonicalURI"))) == []


def test_alias_groups(spark):
    got = {r[0]: (r[1], r[2]) for r in rows(resolve.alias_groups(_orgs(spark)))}
    assert got["g1"] == (2, "http://x/1")
    assert "g5" not in got          # a name whose URIs are all NULL forms no group


def test_multi_row_name_flag(spark):
    o = spark.createDataFrame([("a", "S1"), ("a", "S1"), ("a", "S2"), (None, "S1"), (None, "S1")],
                              "cleanName string, source string")
    got = rows(resolve.flag_multi_row_names(o), "cleanName", "source", "multi_row_name")
    assert got == [("a", "S1", True), ("a", "S1", True), ("a", "S2", False),
                   (None, "S1", None), (None, "S1", None)]


def test_merged_publications(spark):
    got = dict(rows(resolve.merged_publications(_orgs(spark))))
    # /1 and /5 resolve to /1: titles t1, t2, t4 under the name min("Org Five","Org One","org one")
    assert got["Org Five"] == 3
    assert got["Org Ten"] == 2 and got["Seven"] == 1 and got["Eight"] == 1


def test_repositories_of(spark):
    o = spark.createDataFrame([("n", "A"), ("n", "B"), ("n", "C"), ("m", "A")],
                              "cleanName string, source string")
    got = rows(resolve.repositories_of(o))
    assert got == [("n", "A", "B,C"), ("n", "B", "A,C"), ("n", "C", "A,B")]


# --- acronyms (quirk d) ----------------------------------------------------------

def _acr(spark):
    base = spark.createDataFrame([
        ("ACR1", "pa1", "T one", "oa1"), ("acr1", "pa2", "T two", "oa0"), ("ACR2", "pa3", "x", "oa3"),
        (None, "pa4", "y", "oa4")], "acronym string, projectURI string, title string, orgURI string")
    subj = spark.createDataFrame([
        ("Acr1", "pb1", "t one", "ob1", "B1", "c"), ("acr9", "pb2", "z", "ob2", "B2", "c"),
        (None, "pb3", "y", "ob3", "B3", "c")],
        "acronym string, projectURI string, title string, orgURI string, orgName string, country string")
    return subj, base


def test_acronym_new_keeps_null(spark):
    subj, base = _acr(spark)
    assert rows(resolve.acronym_new(subj, base), "projectURI") == [("pb2",), ("pb3",)]


def test_acronym_match_and_org_map(spark):
    subj, base = _acr(spark)
    m = {r["projectURI"]: (r["n_matches"], r["baseOrgURI"], r["baseProjectURI"], r["baseTitle"])
         for r in resolve.acronym_match(subj, base).collect()}
    # org, project and title of one row of the base
    assert m == {"pb1": (2, "oa0", "pa2", "T two"), "pb2": (0, None, None, None),
                 "pb3": (0, None, None, None)}
    assert dict(rows(resolve.acronym_org_map(subj, base))) == {
        "ob1": "oa0", "ob2": "ob2", "ob3": "ob3"}


def test_rewrite_on_title_match(spark):
    subj, base = _acr(spark)
    got = {r["orgURI"]: (r["projectURI"], r["modify"])
           for r in resolve.rewrite_on_title_match(subj, base, clean).collect()}
    assert got == {"ob1": ("pa1", 1), "ob2": ("pb2", 0), "ob3": ("pb3", 0)}


# --- merge and budgets (quirk j, k) ------------------------------------------------

def test_org_budget_distinct_on_pic_proj_budget(spark):
    cols = "pic string, orgName string, proj string, budget double"
    a = spark.createDataFrame([("1", "Acme", "p1", 1.5), ("1", "Acme", "p1", 2.0),
                               ("1", "Acme", "p1", 1.5), (None, "Ghost", "p9", 9.0)], cols)
    b = spark.createDataFrame([("1", "ACME", "p2", None)], cols)
    got = rows(merge.org_budget(a, b))
    assert got == [("1", "ACME", 3.5, 3)]


def test_merge_by_id(spark):
    cols = "vatID string, title string"
    a = spark.createDataFrame([("V1", "T"), ("V1", "t"), ("V2", "x")], cols)
    b = spark.createDataFrame([("V1", "new"), ("V2", "X"), ("V3", "only b"), (None, "n")], cols)
    got = rows(merge.merge_by_id(a, b), "vatID", "countByBase", "countByMerge", "newProjects")
    # V1 brings "new", but its duplicate rows in A understate the gain to 0
    assert got == []
    a2 = spark.createDataFrame([("V1", "T"), ("V2", "x")], cols)
    got = rows(merge.merge_by_id(a2, b), "vatID", "countByBase", "countByMerge", "newProjects")
    assert got == [("V1", 1, 2, 1)]


# --- enrichment ---------------------------------------------------------------------

def test_date_range_inclusive(spark):
    df = spark.createDataFrame([
        (dt.date(2010, 1, 1), dt.date(2020, 12, 31)), (dt.date(2009, 12, 31), dt.date(2011, 1, 1)),
        (dt.date(2011, 1, 1), dt.date(2021, 1, 1)), (None, dt.date(2012, 1, 1))],
        "sDate date, eDate date")
    assert enrich.in_date_range(df, "2010-01-01", "2020-12-31").count() == 1


def test_allow_list_never_multiplies(spark):
    df = spark.createDataFrame([("GR", "x"), ("DE", "y")], "country string, v string")
    allow = spark.createDataFrame([("Greece", "GR"), ("Greece", "GR"), ("Hellas", "GR")],
                                  "Country string, countryCode string")
    assert rows(enrich.allow_list(df, allow, "country", "countryCode")) == [("GR", "x")]
    assert rows(enrich.allow_list(df, allow, "country", "countryCode", label_col="Country")) == [
        ("Greece", "x")]
