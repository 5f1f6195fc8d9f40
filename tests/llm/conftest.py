import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rid long, score double, h long, z binary"
LONG = " ".join(f"w{i * i % 9973} filler of the text" for i in range(30_000))
ODD = [
    (5, "one two three four five six seven eight"), (5, "one two three four five six seven eight"), (None, "no id here at all, and none"), (3, None), (4, ""), (2, "  \n\t "), (9, LONG), (8, "tie"), (7, "tie"),
    (1, "café CAFÉ ﬁn <|endoftext|> \U0001f600 \x00 end"), (6, "a" * 3000), (11, "Released under the MIT License."),
]


def frame(spark, rows):
    """Documents with extra columns of clashing names."""
    return spark.createDataFrame([(i, t, "en", "s", None, 1, 0.5, 2, bytearray(b"z")) for i, t in rows], SCHEMA)


@pytest.fixture
def docs_of(spark):
    return lambda rows: frame(spark, rows)


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, ties, repeated rows."""
    return frame(spark, ODD).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return frame(spark, []).drop("h")


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    """(doc_id, text), by doc_id."""
    return sorted((r.doc_id, r.text or "") for r in documents.select("doc_id", "text").collect())
