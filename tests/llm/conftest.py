import pytest

LONG = "word " * 30000 + "9" * 60000 + " " + "1 " * 20000 + "a." * 20000 + "+" * 5000
EDGE = [
    (1, None, "en", "s0"), (2, "", None, "s0"), (3, "  \n\t ", "en", None), (4, "One two", "en", "s1"), (4, "One two", "en", "s1"), (None, "One two three four", None, None),
    (5, "Mail a.b@c.d_e@f.g.h, 1.2.3.4.5.6.7.8 and 300.1.1.1 x@y", "en", "s1"), (6, "card 4111 1111 1111 1111, 4111-1111-1111-1112; +44 (0)20 7946 0958. +1 23", "de", "s1"),
    (7, LONG, "en", "s2"), (8, "Ünïcode \U0001f600 mail ä@b.co \U0001f600 z.z@y.y\nÜber x y", "de", "s2"), (9, "a\x0bb\x0cc\rd\x1ce\x85f", "fr", "s2"),
]


@pytest.fixture(scope="session")
def edge(spark):
    """Nulls in every column, empty and very long texts, repeated rows, a clashing extra column."""
    rows = [(i, t, lang, src, None if t is None else len(t), "x") for i, t, lang, src in EDGE]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, `_Quality_Model` string").repartition(3)


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


def read(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")
