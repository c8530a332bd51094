import pytest


#: extra columns have names that the operators use themselves
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, row bigint, kept string, n bigint, hashed string, size bigint"
ODD = [None, "", " \n\t", "one", "Two words", "a b c d e f g h i j", "a b c d e f g h i j", "A b c\nd e f g h i j", "x " * 30_000, "tok=1 @ + AKIA 1.2.3.4 " * 40, "\x1c é ǘ   z"]


@pytest.fixture(scope="session")
def odd(spark):
    rows = [(i, t, None if i % 3 == 0 else "en", None if i % 4 == 0 else f"s{i % 3}", None, i, "k", 1, "h", 2) for i, t in enumerate(ODD)]
    return spark.createDataFrame([*rows, rows[5], (None, "no id", "en", "s1", 1, 1, None, 1, "h", 2)], SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
