import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    """Makes a documents table of (doc_id, text) pairs, with extra columns whose names operators use inside."""

    def make(rows):
        extra = ", d string, fp long, key string, score double, p0 double, tokens long, found string, gone string"
        full = [(i, t, "en", "s", None if t is None else len(t), "x", 7, "k", 0.5, 0.5, 3, "f", "g") for i, t in rows]
        return spark.createDataFrame(full, DOC + extra).repartition(3)

    return make
