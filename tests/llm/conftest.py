import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, rank int, h double, __text string, __ID long, __hash int, __n string, __at double, text_hash string, __exact int, positions string"


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls in every column, empty and blank texts, a very long one, repeated rows, clashing extra columns."""
    long = " ".join(f"word{i % 997} tail" for i in range(30_000))
    prose = "One two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty.\n"
    rows = [
        (1, prose, "en", "a", 5, "x", 1, 0.5),
        (1, prose, "en", "a", 5, "x", 1, 0.5),
        (2, prose + prose, "en", None, None, None, None, None),
        (3, None, None, None, None, None, None, None),
        (4, "", "en", "b", 0, "", 0, 0.0),
        (5, " \n\t ", None, "b", 3, "y", 2, 1.0),
        (6, long, "en", "b", 9, "z", 3, 2.0),
        (7, "É ê x\x0bq\x1cr $$$ |", "fr", "é", 9, "z", 3, 2.0),
        (None, "lost id but some words here", "fr", "é", 9, "z", 3, 2.0),
    ]
    clash = ("t", 7, 8, "n", 0.5, "h", 1, "p")
    return spark.createDataFrame([(*r, *clash) for r in rows], DOCS)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
