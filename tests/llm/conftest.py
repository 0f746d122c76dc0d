import pytest

SCHEMA = "doc_id long, text string, lang string, digest string, salt int, `key` long, size int, label int, `odd name` int, `a-b` int, gone_id int, found_id string, `row` int, features int"


@pytest.fixture
def docs(spark):
    """Documents with extra columns whose names clash with those the operators use inside."""

    def make(rows):
        return spark.createDataFrame([(i, text, "en", "x", 1, 2, 3, 4, 5, 6, 7, "8", 9, 10) for i, text in rows], SCHEMA)

    return make
