import pytest

DOCS = "doc_id long, text string, lang string, source string, fp string, id int"


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from texts, with columns whose names clash with those inside the operators."""

    def make(texts, start=0):
        return spark.createDataFrame([(start + i, t, "en", "s", "x", 1) for i, t in enumerate(texts)], DOCS)

    return make

