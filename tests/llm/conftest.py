import pytest


@pytest.fixture(scope="session")
def docs(spark):
    """Rows with nulls, empty and long texts, repeats, and a clashing column."""

    def make(rows):
        return spark.createDataFrame([(i, t, lang, "s", len(t) if t is not None else None, "x") for i, t, lang in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint, score string")

    return make
