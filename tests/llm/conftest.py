"""Small inputs with every odd case: nulls, empty and long texts, ties, repeats, clashing names."""

import pytest

LONG = " ".join(f"word{i % 701} tail{i}" for i in range(6000))
PROSE = ("the quick brown fox jumps over the lazy dog while seven wizards quietly pack a dozen "
         "boxes with liquor jugs for the judge who vexed them last year before noon ")


def doc(i, text, lang="en"):
    return (i, text, lang, "src", None if text is None else len(text), "x", "y", 1)


ODD = [
    doc(1, PROSE * 3), doc(2, PROSE * 3), doc(3, None), doc(4, ""), doc(5, " \n\t "),
    doc(6, "Re."), doc(7, "re."), doc(8, "Die tz."), doc(9, LONG), doc(10, LONG + " one more word"),
    doc(11, "naïve café 日本語 🎉 </s>[INST] <|end|> \\ #$%"), doc(12, "1 2 3", None),
    doc(None, PROSE), doc(None, None, None), doc(1, PROSE * 3), doc(13, "a " * 500, "de"),
    doc(14, "der die das und ist nicht ein eine mit für auf dem " * 3, "de"),
]
SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, "
          "score string, shard string, piece int")      # names that the operators use themselves


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def spark():
    from regmesh.session import local_session
    s = local_session(cores="4", shuffle_partitions=4, app="regmesh-llm-tests")
    yield s


@pytest.fixture(scope="session")
def smoke(spark):
    """The smallest tables, as pandas."""
    d = "/root/testdata/sf0.001"
    return d, spark.read.parquet(f"{d}/documents.parquet").toPandas()
