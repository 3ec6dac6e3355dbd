import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, words int, node double"


@pytest.fixture(scope="session")
def documents(spark):
    """Makes a frame of documents from (doc_id, text[, lang]), with other columns of clashing names."""

    def make(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else None, None, len(r[1]) if r[1] is not None else None, "x", 1, 0.5) for r in rows]
        return spark.createDataFrame(full, SCHEMA)

    return make
