import pytest
from pyspark.sql import functions as F

from bookwarp.functions import text as X


def values(spark, rows, f):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, x string")
    return [r[0] for r in df.orderBy("i").select(f("x")).collect()]


def test_isbn(spark):
    good = ["0-306-40615-2", "0306406152", "978-0-306-40615-7", "9780306406157", "0-8044-2957-X"]
    bad = ["0-306-40615-3", "978-0-306-40615-8", "123", "", None, "not-an-isbn", "99999999999999", "X306406152"]
    assert values(spark, good + bad, X.isbn_valid) == [True] * 5 + [False] * 8


def test_title_sort(spark):
    rows = ["The Maze of Bones by Rick Riordan", "A Study in Scarlet", "An American Tragedy", "Doctor Sleep", "", None, "the  hobbit"]
    assert values(spark, rows, X.title_sort) == ["Maze of Bones by Rick Riordan, The", "Study in Scarlet, A", "American Tragedy, An", "Doctor Sleep", "", None, "hobbit, the"]


def test_component(spark):
    assert values(spark, ['Title: "The Best"?', "   ", "Trailing Space. . ", None, "x" * 200], X.path_component) == ["Title The Best", "Unknown", "Trailing Space", "Unknown", "x" * 150]


def test_by_clause(spark):
    rows = ["The Maze of Bones by Rick Riordan", "Married by Morning", "Dexter by Design", "  X by A B.  "]
    assert values(spark, rows, X.without_by_clause) == ["The Maze of Bones", "Married by Morning", "Dexter by Design", "X"]
    assert values(spark, rows, X.has_by_clause) == [True, False, False, True]


@pytest.mark.parametrize("value", ["plain", "it's", 'say "x"', "it's \"x\"", "back\\slash"])
def test_quoted_is_repr(spark, value):
    assert values(spark, [value], X.quoted) == [repr(value)]


def test_signature_and_numbers(spark):
    assert values(spark, ["King, Stephen", "Müller-Lüdenscheidt Jürgen", None, "!!"], X.name_signature) == [["king", "stephen"], ["jürgen", "lüdenscheidt", "müller"], [], []]
    df = spark.createDataFrame([(2.0,), (1.5,)], "x double")
    assert [r[0] for r in df.select(X.short_number("x")).collect()] == ["2", "1.5"]
    assert df.select(X.listed(F.array(F.lit(1), F.lit(2)))).first()[0] == "[1, 2]"
    assert values(spark, [" \t x \n"], X.strip) == ["x"]
