import pytest


@pytest.fixture
def documents(spark):
    """A maker of tables with an extra column whose name clashes with ones that operators make, and with repeated and null rows on demand."""

    def make(rows):
        return spark.createDataFrame([(i, t, "en", "src", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")

    return make
