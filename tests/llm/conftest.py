import pytest

#: Rows that every operator must stand: nulls everywhere, blanks, ties, repeated rows, long and odd texts.
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog and runs away", "en", "a", 57),
    (2, "The quick brown fox jumps over the lazy dog and runs away", "en", "a", 57),
    (2, "The quick brown fox jumps over the lazy dog and runs away", "en", "a", 57),
    (3, None, "en", "b", None),
    (4, "", "de", None, 0),
    (5, " \t\n\x0b\f\r", None, "b", 6),
    (None, "Lonely row without an id", "en", "c", 24),
    (None, None, None, None, None),
    (6, "12345 !!! ###", "fr", "c", 13),
    (7, "wort " * 30000, "de", "a", 150000),
    (8, "émoji 😀 ﬁ ½ \u2581 \u00a0 nul\x00 end", "fr", "d", 30),
    (9, "mail bob@example.com, call +1 (319) 555-5132, host 10.0.0.1, card 4111 1111 1111 1111, password=abcdefghijkl123", "en", "d", 110),
]
DDL = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns whose names the operators use themselves.
CLASH = ("size", "fp", "key", "mask", "kept", "score", "_t", "_c", "taken", "row", "k", "decoded")


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(ROWS, DDL)


@pytest.fixture(scope="session")
def clash(odd):
    from pyspark.sql import functions as F

    return odd.withColumns({c: F.lit(1) for c in CLASH})


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("false")
