import pytest


@pytest.fixture(scope="session")
def path():
    import public_tokenizers

    return public_tokenizers.path


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


ODD = [
    (1, None, "x", 1),
    (2, "", "x", 2),
    (3, " \t\n ", None, 3),
    (4, "one two", "y", 4),
    (5, "one two", "y", 4),
    (6, "naïve é漢🙂 a@b.cc 1.2.3.4 idiot", "z", 5),
    (7, " ".join(f"w{i % 50}" for i in range(400)), "z", 6),
    (8, "x" * 30_000, "z", 7),
    (9, " ".join(f"w{i % 50}" for i in range(400)), "z", 8),
    (9, " ".join(f"w{i % 50}" for i in range(400)), "z", 8),
    (None, "one two", "z", 9),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Null, empty, repeated and long texts, a null id, and columns named as operators name theirs."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(ODD, "doc_id long, text string, source string, n_chars long")
    return df.withColumns({n: F.lit(i) for i, n in enumerate(["score", "spots", "hash", "base", "marks", "row", "label", "kind", "n", "ids", "v", "key", "a b", "path"])})


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
