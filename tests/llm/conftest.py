import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, `key` int, words int, band int, row int, hits int, part int"


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls everywhere, repeated rows and ids, empty, blank and long texts, columns with clashing names."""
    long = " ".join(f"word{k % 977} of a long text," for k in range(20_000))
    prose = "The quick brown fox jumps over the lazy dog and runs into the deep green forest where it lives with its family."
    rows = [
        (1, prose, "en", "a", 5),
        (1, prose, "en", "a", 5),
        (2, None, None, None, None),
        (None, prose + " Always.", "en", None, 0),
        (None, None, None, None, None),
        (3, "", "en", "a", 0),
        (4, " \n\t ", "en", "a", 0),
        (5, long, "en", "b", 1),
        (6, "..,,!!", "en", "b", 1),
        (7, "straße ÉCOLE naïve 東京 👍", "de", "b", 1),
    ]
    return spark.createDataFrame([(*r, "x", 1, 2, 3, 4, 5, 6) for r in rows], SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
