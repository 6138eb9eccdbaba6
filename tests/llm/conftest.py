import pytest

# columns whose names the operators use inside
CLASHES = "'x' AS __id, 'y' AS __text, 1 AS __key, 'z' AS key, 2 AS digest, 3 AS place, 'w' AS bucket, 4 AS __size, 5 AS piece, 6 AS c0, 7 AS score, 8 AS ids, 9 AS id"
LONG = " ".join(f"w{i % 977}x{i % 89}" for i in range(60_000))


@pytest.fixture(scope="session")
def messy(spark):
    """Null ids, texts and sources, empty texts, ties, repeated rows, a very long text, clashing column names."""
    same = "the same few words that come again and again in every copy of this short text"
    rows = [
        (1, same, "en", "a", 10), (1, same, "en", "a", 10), (2, same, None, None, None), (3, None, "en", "b", None), (4, "", "en", "b", 0), (5, "   \n\t ", None, "b", 6),
        (None, same, "en", "a", 10), (None, None, None, None, None), (7, LONG, "en", "c", len(LONG)), (8, "one", "de", "c", 3), (9, "é€😀 ünḯ", "de", None, 9),
        (10, LONG[: len(LONG) // 2], "en", "c", 1), (3, "another text under an id that is taken", "en", "b", 1),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.selectExpr("*", *CLASHES.split(", ")).repartition(3)


@pytest.fixture(scope="session")
def nothing(messy):
    return messy.where("false")


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark, sf):
    return spark.read.parquet(f"{sf}/labels.parquet")
