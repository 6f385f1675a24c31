import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, n_tokens string, id string, h int"


def documents(spark, rows):
    """Documents with extra columns whose names operators use inside. rows: (doc_id, text[, source])."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else f"src{r[0] or 0}", len(r[1] or ""), 0.5, "x", "y", 1) for r in rows]
    return spark.createDataFrame(full, DOCS)


@pytest.fixture
def docs(spark):
    return lambda rows: documents(spark, rows)


@pytest.fixture(scope="session", autouse=True)
def shipped(spark):
    from corpusmith.deploy import ship

    ship(spark)
