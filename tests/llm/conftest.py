import pytest

from tests.oracle import connect

FOLDER = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, source string"


@pytest.fixture(scope="session")
def folder():
    return FOLDER


@pytest.fixture(scope="session")
def texts():
    """(doc_id, text, source) of the smallest documents table, by descending id."""
    return connect(FOLDER).execute("SELECT doc_id, text, source FROM documents ORDER BY doc_id DESC").fetchall()


@pytest.fixture
def table(spark):
    """A documents table with columns whose names our own code might use."""

    def make(rows, schema=DOCS):
        df = spark.createDataFrame(rows, schema)
        extra = ("id", "key", "fp", "size", "place", "first", "row", "passes", "ranges", "n", "kind", "label", "score", "home", "guest", "_salt")
        return df.selectExpr("*", *[f"'x' AS {c}" for c in extra])

    return make
