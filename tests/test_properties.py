"""Properties against brute force on random small frames."""

from collections import Counter

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from regmesh.operators import overlap, resolve
from regmesh.operators.overlap import Source, distinct, intersected, joined

KEYS = st.one_of(st.none(), st.sampled_from(["a", "b", "c", "d", "e"]))
SETTINGS = settings(max_examples=12, deadline=None,
                    suppress_health_check=[HealthCheck.function_scoped_fixture])


def _frame(spark, keys, col="k"):
    return spark.createDataFrame([(k,) for k in keys], f"{col} string")


@SETTINGS
@given(st.lists(KEYS, max_size=12), st.lists(KEYS, max_size=12))
def test_overlap_counts_match_sets(spark, xs, ys):
    a, b = _frame(spark, xs), _frame(spark, ys)
    keys = (("k", F.col("k")),)
    got = {r["metric"]: r["value"] for r in overlap.overlap_metrics(
        [Source(a, 0, keys), Source(b, 1, keys)],
        [distinct("da", "k", 0), distinct("db", "k", 1), joined("j", "k", 0, 1),
         intersected("i", "k", 0, 1)]).collect()}
    sa, sb = set(xs), set(ys)
    assert got == {"da": len(sa), "db": len(sb), "j": len((sa & sb) - {None}),
                   "i": len(sa & sb)}
    assert got["j"] <= min(got["da"], got["db"])


@SETTINGS
@given(st.lists(KEYS, max_size=15), st.lists(KEYS, max_size=15))
def test_pair_counts_match_nested_loop(spark, xs, ys):
    a, b = _frame(spark, xs, "t"), _frame(spark, ys, "t")
    got = overlap.pair_counts(a, b, [("p", F.col("t"), F.col("t"))]).collect()[0]["value"]
    assert got == sum(1 for x in xs for y in ys if x is not None and x == y)


NAMES = st.one_of(st.none(), st.sampled_from(["n1", "n2", "n3", "n4"]))
URIS = st.sampled_from([f"u{i}" for i in range(8)])


@SETTINGS
@given(st.lists(st.tuples(NAMES, URIS), min_size=1, max_size=14))
def test_canonical_uri_brute_force(spark, pairs):
    df = spark.createDataFrame(pairs, "cleanName string, orgURI string")
    got = {r["orgURI"]: r["canonicalURI"] for r in resolve.canonical_uri(df).collect()}
    groups: dict[str, set[str]] = {}
    for n, u in pairs:
        if n is not None:
            groups.setdefault(n, set()).add(u)
    want = {}
    for _, u in pairs:
        mins = [min(g) for g in groups.values() if u in g and len(g) > 1]
        want[u] = min(mins) if mins else u
    assert got == want
    assert all(c <= u for u, c in got.items())


@SETTINGS
@given(st.lists(st.tuples(NAMES, st.sampled_from(["S1", "S2"])), max_size=14))
def test_multi_row_flag_brute_force(spark, rows_):
    df = spark.createDataFrame(rows_, "cleanName string, source string")
    counts = Counter(rows_)
    got = Counter((r["cleanName"], r["source"], r["multi_row_name"])
                  for r in resolve.flag_multi_row_names(df).collect())
    want = Counter((n, s, None if n is None else counts[(n, s)] > 1) for n, s in rows_)
    assert got == want


PAIRS = st.lists(st.tuples(NAMES, st.sampled_from(["t1", "t2", "t3", None])), max_size=10)


@SETTINGS
@given(PAIRS, PAIRS)
def test_shared_title_delta_brute_force(spark, xs, ys):
    a = spark.createDataFrame(xs, "cleanName string, title string")
    b = spark.createDataFrame(ys, "cleanName string, title string")
    got = {r["metric"]: r["value"]
           for r in overlap.shared_title_delta([a, b], [("p", 0, 1)]).collect()}
    shared = {n for n, _ in xs} & {n for n, _ in ys}
    ta = {t for n, t in xs if n is not None and n in shared}
    tb = {t for n, t in ys if n is not None and n in shared}
    assert got == {"p_shared_names": len(shared), "p_titles_a": len(ta), "p_titles_b": len(tb),
                   "p_title_delta": len(ta) - len(tb), "p_titles_only_a": len(ta - tb)}


@SETTINGS
@given(PAIRS, PAIRS)
def test_names_sharing_keys_brute_force(spark, xs, ys):
    a = spark.createDataFrame([(t, n) for n, t in xs], "title string, cleanName string")
    b = spark.createDataFrame([(t, n) for n, t in ys], "title string, cleanName string")
    got = {(r["side"], r["cleanName"])
           for r in overlap.names_sharing_keys(a, b, F.col("title"), F.col("title")).collect()}
    ta = {t for _, t in xs if t is not None}
    tb = {t for _, t in ys if t is not None}
    want = ({("B", n) for n, t in ys if t in ta} | {("A", n) for n, t in xs if t in tb})
    assert got == want


IDS = st.one_of(st.none(), st.sampled_from(["V1", "V2", "V3"]))
TITLES = st.sampled_from(["Alpha", "alpha", "Beta", "gamma"])


@SETTINGS
@given(st.lists(st.tuples(IDS, TITLES), max_size=10), st.lists(st.tuples(IDS, TITLES), max_size=10))
def test_merge_by_id_brute_force(spark, xs, ys):
    from regmesh.operators import merge
    a = spark.createDataFrame(xs, "vatID string, title string")
    b = spark.createDataFrame(ys, "vatID string, title string")
    got = {r["vatID"]: (r["countByBase"], r["countByMerge"], r["newProjects"])
           for r in merge.merge_by_id(a, b).collect()}
    base = Counter(v for v, _ in xs)
    merged = Counter(v for v, _ in {(v, t.lower()) for v, t in xs + ys})
    want = {v: (base[v], merged[v], merged[v] - base[v])
            for v in base if v is not None and merged[v] - base[v] > 0}
    assert got == want


@SETTINGS
@given(st.lists(st.tuples(NAMES, st.integers(0, 3)), max_size=14),
       st.lists(NAMES, max_size=5, unique=True),
       st.lists(NAMES, max_size=3),
       st.sampled_from(["inner", "left", "left_semi", "left_anti"]),
       st.booleans())
def test_salted_join_equals_plain_join(spark, big_rows, small_keys, hot, how, null_safe):
    from regmesh.operators.skew import salted_join
    big = spark.createDataFrame(big_rows, "k string, v int")
    small = spark.createDataFrame([(k, f"x{i}") for i, k in enumerate(small_keys)], "k string, w string")
    hot_df = spark.createDataFrame([(k, 4) for k in hot], "k string, _n int")
    got = salted_join(big, small, ["k"], how, hot_df, null_safe=null_safe)
    cond = big["k"].eqNullSafe(small["k"]) if null_safe else big["k"] == small["k"]
    want = big.join(small, cond, how)
    if how in ("inner", "left"):
        want = want.select(big["k"], "v", "w")
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(map(tuple, want.collect()), key=key)


def test_pair_count_beyond_64_bits(spark):
    from decimal import Decimal

    from pyspark.sql import functions as F

    from regmesh.operators.metrics import to_long
    n = F.lit(4_000_000_000).cast("decimal(19,0)") * F.lit(4_000_000_000).cast("decimal(18,0)")
    wide = spark.range(3).agg(F.sum(n).alias("pairs"))
    assert to_long(wide, "decimal(38,0)").first()["value"] == Decimal(48) * 10 ** 18 > 2 ** 63
