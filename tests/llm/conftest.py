import pytest

from entitylink.llm.common import Scratch

#: Nulls, empty and blank texts, ties and repeated rows, a long text, and a column whose name clashes.
ODD = [
    (1, "The quick brown fox jumps over the lazy dog. mail ann.lee7@example.org", "en", "a", 1),
    (2, None, "en", "a", 2),
    (3, "", "de", None, 3),
    (4, " \n\t ", None, "b", 4),
    (5, "Le renard brun saute par-dessus le chien paresseux encore une fois", "fr", "b", 5),
    (5, "Le renard brun saute par-dessus le chien paresseux encore une fois", "fr", "b", 5),
    (None, "no id at all here but still six words", "en", None, None),
    (7, "x" * 9000 + " " + "word " * 5000, "en", "c", 7),
    (8, "1 2 3 +++", None, None, None),
    (9, "é", "de", "a", 1),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture()
def odd(spark):
    return spark.createDataFrame([(*r, "clash", 0.5) for r in ODD], SCHEMA + ", score string, _c double")


@pytest.fixture()
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture()
def scratch(spark):
    s = Scratch(spark, "test")
    yield s
    s._remove(s.base)
