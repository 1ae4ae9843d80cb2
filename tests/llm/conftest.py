import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Null, empty, repeated and clashing cases beside ordinary rows."""
    rows = [
        (1, "Hello there. It's a test\n\nof  packing", "x"),
        (2, None, "x"),
        (3, "", None),
        (4, "word " * 5000, "y"),
        (4, "word " * 5000, "y"),
        (None, "no id here", "z"),
        (7, "tab\tand 　wide <|endoftext|> mark", "z"),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, part string").repartition(3)
