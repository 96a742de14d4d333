"""Ingest with a reject table (S1-S3) and alias members in chunks (E5)."""

import os

from pyspark.sql import functions as F

from regmesh.operators import resolve, skew
from regmesh.schemas import NUMBERED, ORG_TITLE
from regmesh.sources.ingest import ingest_csv
from tests.util import local_dir, rows


def extract(spark, name, text):
    path = local_dir(spark, name)
    os.makedirs(path)
    file = os.path.join(path, "in.csv")
    with open(file, "w", encoding="utf-8") as f:
        f.write(text)
    return file


def test_malformed_records_are_kept_apart_with_their_reason(spark):
    src = extract(spark, "dirty", "orgName,orgURI,title,no\n"
                  "a,u1,t,1\n"
                  '"b ""x"", y",u2,"t, u",2\n'
                  "c,u3,t\n"
                  "d\n"
                  "e,u5,t,5,extra\n"
                  '"f, g",u6,"t, u",6,extra\n'
                  '"open,u7,t,7\n'
                  "h,u8,t,eight\n"
                  "\n"
                  "i,u9,,\n"
                  " j ,u10,t,10\n")
    got = ingest_csv(spark, src, NUMBERED)
    assert rows(got.good) == [(" j ", "u10", "t", 10), ("a", "u1", "t", 1), ('b "x", y', "u2", "t, u", 2),
                              ("i", "u9", None, None)]
    assert rows(got.rejects, "reason", "record") == [
        ("long", '"f, g",u6,"t, u",6,extra'), ("long", "e,u5,t,5,extra"), ("quote", '"open,u7,t,7'),
        ("short", "c,u3,t"), ("short", "d"), ("type", "h,u8,t,eight")]
    assert dict(rows(got.counts())) == {"good": 4, "quote": 1, "short": 2, "long": 2, "type": 1}
    # any projection sees the same rows: they were parsed whole, once
    assert got.good.select("orgURI").count() == 4 and got.good.filter("no > 1").count() == 2


def test_multiline_records_and_their_rejects(spark):
    src = extract(spark, "multi", "orgName,orgURI,title\n"
                  '"a",u1,"line one\nline two"\n'
                  "b,u2\n"
                  'c,u3,"x"\n')
    got = ingest_csv(spark, src, ORG_TITLE, multiline=True)
    assert rows(got.good) == [("a", "u1", "line one\nline two"), ("c", "u3", "x")]
    assert [r["reason"] for r in got.rejects.collect()] == ["short"]


def test_a_file_without_records_gives_empty_tables(spark):
    got = ingest_csv(spark, extract(spark, "none", "orgName,orgURI,title\n"), ORG_TITLE)
    assert got.good.count() == 0 and got.rejects.count() == 0 and got.good.columns == ORG_TITLE.names
    assert {r["n_records"] for r in got.counts().collect()} == {0}


def test_rejects_do_not_need_a_header(spark):
    got = ingest_csv(spark, extract(spark, "bare", "a,u1,t,1\nb,u2,t\n"), NUMBERED, header=False)
    assert rows(got.good) == [("a", "u1", "t", 1)] and got.rejects.count() == 1


def plain_members(pairs, chunk):
    groups = {}
    for name, uri in pairs:
        if name is not None and uri is not None:
            groups.setdefault(name, set()).add(uri)
    return sorted((n, u, len(us), i // chunk) for n, us in groups.items() if len(us) > 1
                  for i, u in enumerate(sorted(us)))


def test_members_are_cut_into_chunks_of_bounded_size(spark, monkeypatch):
    monkeypatch.setattr(skew, "TARGET_ROWS", 100)
    pairs = ([("hot", f"u{i:05d}") for i in range(2000)] + [("hot", "u00007")] * 5
             + [(f"n{i % 300}", f"v{i}") for i in range(700)] + [(None, "u1"), ("lone", "u1"), ("x", None)])
    df = spark.createDataFrame(pairs, "cleanName string, orgURI string").repartition(7)
    got = rows(resolve.alias_membership(df, chunk=64))
    assert got == sorted(plain_members(pairs, 64), key=lambda t: tuple((x is None, str(x)) for x in t))
    sizes = {}
    for name, _, _, chunk in got:
        sizes[name, chunk] = sizes.get((name, chunk), 0) + 1
    assert max(sizes.values()) == 64 and len([k for k in sizes if k[0] == "hot"]) == 32
    empty = spark.createDataFrame([], "cleanName string, orgURI string")
    assert resolve.alias_membership(empty).count() == 0


def test_rewrite_with_null_acronyms_and_titles(spark):
    cols = "acronym string, projectURI string, title string, orgURI string, orgName string, country string"
    subjects = spark.createDataFrame(
        [("X", "b/1", None, "b/o1", "n", "c"), (None, "b/2", None, "b/o2", "n", "c"),
         ("y", "b/3", "T", None, "n", "c"), ("y", "b/4", "T", "b/o4", "n", "c"), ("y", "b/4", "T", "b/o4", "n", "c"),
         ("z", "b/5", "T", "b/o5", "n", "c")], cols)
    base = spark.createDataFrame(
        [("x", "a/1", None, "a/o1", "n", "c"), (None, "a/2", "t", "a/o2", "n", "c"),
         ("Y", "a/4", "t", None, "n", "c"), ("Y", "a/3", "t", "a/o9", "n", "c"), ("Y", "a/0", "u", "a/o8", "n", "c"),
         ("z", "a/5", "t", None, "n", "c")], cols)
    done = resolve.rewrite_uris(subjects, base, lambda c: F.trim(F.lower(c)))
    # acronym alone gives the org (smallest of its rows with one), acronym and title the project
    assert rows(done, "projectURI", "orgURI", "modify") == [
        ("a/3", "a/o8", 1), ("a/3", None, 1), ("a/5", "b/o5", 1), ("b/1", "a/o1", 0), ("b/2", "b/o2", 0)]
