import pytest

ODD = [
    (0, "The cat sat on the mat and looked at the dog. " * 3, "en", "a", 1),
    (1, None, None, None, None),
    (2, "", "en", "a", 0),
    (3, "   \t\n ", "de", "b", 5),
    (4, "the cat", "en", "a", 7),
    (5, "The CAT", "en", "a", 7),
    (6, "x" * 200_000, "fr", "b", 200_000),
    (7, "der hund und die katze sind im haus " * 4, "de", "b", 100),
    (7, "der hund und die katze sind im haus " * 4, "de", "b", 100),
    (8, "a\x00b <|endoftext|> c  d\n\n e 漢字 😀 é", "de", "b", 30),
    (None, "nobody knows this text at all", "en", "a", 29),
    (9, "<|startoftext|>İstanbul ΑΣ don't", "fr", "b", 10),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, repeats, and further columns of names that operators use."""
    df = spark.createDataFrame(ODD, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    return df.select("*", df["doc_id"].alias("score"), df["text"].alias("digest"), df["lang"].alias("block_id")).repartition(3)


@pytest.fixture(scope="session")
def clash(odd):
    """The same with columns whose names differ from the right ones in case alone, in front of them."""
    return odd.select(odd["lang"].alias("TEXT"), odd["n_chars"].alias("Doc_Id"), "*")


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
