import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, kept string, id string, row string"


def frame(spark, texts, ids=None, sources=None, tmp=None):
    """Documents with clashing extra columns, written so that they read the same rows in the same order each time."""
    ids = list(range(len(texts))) if ids is None else ids
    sources = [f"s{i % 3}" for i in range(len(texts))] if sources is None else sources
    rows = [(i, t, None, s, None, "x", None, "y", "z") for i, t, s in zip(ids, texts, sources, strict=True)]
    spark.createDataFrame(rows, SCHEMA).repartition(3, "doc_id").write.parquet(tmp)
    return spark.read.parquet(tmp)


@pytest.fixture
def docs(spark, tmp_path):
    n = iter(range(1000))
    return lambda texts, ids=None, sources=None: frame(spark, texts, ids, sources, str(tmp_path / f"d{next(n)}"))


@pytest.fixture(scope="session")
def small(spark):
    return lambda name: spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet")
