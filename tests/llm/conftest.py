import pytest


@pytest.fixture(scope="session")
def docs(spark):
    """Makes documents with a clashing extra column of (doc_id, text) pairs."""

    def make(rows, **more):
        schema = "doc_id long, text string, lang string, source string, n_chars long, component_id long, _id string"
        full = [(i, t, more.get("lang", "en"), "s", len(t or ""), -1, "x") for i, t in rows]
        return spark.createDataFrame(full, schema).repartition(3) if full else spark.createDataFrame([], schema)

    return make
