import pytest

#: Odd rows that every operator must take: null and empty texts, no letters, repeats, a null id, a very long text.
ODD = [
    (1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, "\n \n", None, None, 0), (4, "!!! 123", "de", None, 0), (5, "same text here", "en", "b", 0),
    (5, "same text here", "en", "b", 0), (6, "same text here", "en", "b", 0), (None, "no id at all", "en", "b", 0), (7, "éàü ß 漢字", "fr", "", 0),
    (8, "word " * 30_000, "en", "b", 0), (9, "a\x00b", "en", "b", 0),
]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture()
def odd(spark):
    """The odd rows, with extra columns under names that operators use themselves."""
    df = spark.createDataFrame(ODD, SCHEMA)
    for name in ("score", "shard", "key", "bin", "tk", "kept", "size", "part", "lang_pred", "target", "weight"):
        df = df.selectExpr("*", f"'clash' AS {name}")
    return df


@pytest.fixture()
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
