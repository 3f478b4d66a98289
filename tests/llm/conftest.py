import pytest

SCHEMA = "doc_id long, text string, source string, lang string, kept boolean, score double, row long, length long, n long, labels string, recipe string, part int, token string"


def rows_of(spark, rows):
    """Documents with columns besides that have the names of the operators' own."""
    return spark.createDataFrame([(i, t, s, "en", True, 0.5, 7, 7, 7, "x", "x", 7, "x") for i, t, s in rows], SCHEMA)


LONG = "lorem ipsum dolor sit amet consetetur " * 6000
EDGES = [
    (1, "One two three four five six seven.\nEight nine", "a"), (2, "One two three four five six seven.\nEight nine", "b"), (None, "no id here at all, really", "a"), (None, None, None),
    (3, None, "a"), (4, "", None), (5, " \n\t\x0b ", "a"), (6, LONG, "a"), (6, LONG, "a"), (7, "été 👍🏽   Released under the MIT License. mit　license", "c"), (8, "One  two three\nfour five six seven. Eight nine", "a"),
    (9, "x", "a"), (10, "a" * 30000, "b"), (11, "<|endoftext|> \x1c \x85 ½ ²³ 中文字 'll", "b"),
]


@pytest.fixture(scope="session")
def edges(spark):
    return rows_of(spark, EDGES)


@pytest.fixture(scope="session")
def nothing(spark):
    return rows_of(spark, [])
