"""The search language: terms, predicates over every field, sorting.

A term becomes one Column predicate; all terms are combined with AND and go to the scan as far as the source allows.
Only the fuzzy operator and regular expressions in a dialect that the JVM lacks leave it, as vectorised functions after
the other predicates.
"""

from __future__ import annotations

import re
from difflib import SequenceMatcher
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bookwarp.functions.text import strip, text
from bookwarp.model import Criterion
from bookwarp.stage import cut

FUZZY_THRESHOLD = 0.6
# The search language.
ALIASES = {
    "missing-isbn": "isbn:missing", "missing-cover": "has_cover:missing", "has-cover": "has_cover:present", "missing-series": "series:missing", "missing-description": "comments:missing",
    "missing-publisher": "publisher:missing", "missing-language": "language:missing", "missing-tags": "tag:missing", "missing-rating": "rating:missing",
}
NUMERIC_SYMBOLS = ((">=", "gte"), ("<=", "lte"), (">", "gt"), ("<", "lt"))
NUMERIC_FIELDS = ("rating",)
OPERATORS = ("exact", "contains", "starts_with", "ends_with", "regex", "fuzzy", "missing", "present", "eq", "gte", "lte", "gt", "lt")
FIELDS = ("title", "author", "isbn", "uuid", "series", "publisher", "language", "tag", "format", "comments", "path", "date_added", "last_modified", "rating", "has_cover")
SORTS = ("title", "author", "series", "rating", "date_added", "last_modified", "size")


def parse_term(term: str) -> Criterion:
    """field:mode, field>=number, field:mode=value or field=value; short names stand for frequent terms."""
    term = ALIASES.get(term, term)
    colon, equals = term.find(":"), term.find("=")
    if colon >= 0 and equals < 0:
        return Criterion(term[:colon].strip(), term[colon + 1 :].strip())
    for symbol, operator in NUMERIC_SYMBOLS:
        field, found, value = term.partition(symbol)
        if found:
            return Criterion(field.strip(), operator, value.strip())
    if equals < 0:
        raise ValueError(f"Could not parse search term: {term!r} (expected field=value, field:mode=value, field:missing, or field>=value)")
    left, value = term[:equals], term[equals + 1 :].strip()
    if 0 <= colon < equals:
        return Criterion(left[:colon].strip(), left[colon + 1 :].strip(), value)
    field = left.strip()
    return Criterion(field, "eq" if field in NUMERIC_FIELDS else "contains", value)


def field_values(field: str) -> Column:
    """The values of a field as an array of texts; numbers and flags as texts, with 0 and false empty."""
    one = lambda c: F.array(text(c))
    simple = {"date_added": "timestamp", **{f: f for f in ("title", "isbn", "uuid", "publisher", "comments", "path", "last_modified")}}
    if field in simple:
        return one(simple[field])
    many = {"author": F.transform("authors", lambda a: text(a["name"])), "language": F.col("languages"), "tag": F.col("tags"), "format": F.col("formats")}
    if field in many:
        return many[field]
    if field == "series":
        return F.when(F.col("series").isNull(), F.array().cast("array<string>")).otherwise(F.array(text("series.name")))
    if field == "rating":
        return F.array(F.when(F.col("rating") == 0, "").otherwise(F.col("rating").cast("string")))
    if field == "has_cover":
        return F.array(F.when(F.col("has_cover"), "True").otherwise(""))
    raise ValueError(f"Unknown search field: {field!r}")


def _as_number(value: Column, field: str) -> Column:
    if field == "has_cover":
        return F.when(value == "True", 1.0).otherwise(0.0)
    return F.when(value == "", 0.0).otherwise(strip(value).try_cast("double"))


def _fuzzy(needle: str, threshold: float):
    @F.pandas_udf(T.BooleanType())
    def match(values: pd.Series) -> pd.Series:
        def near(v: str) -> bool:
            m = SequenceMatcher(None, v, needle)
            return m.real_quick_ratio() >= threshold and m.quick_ratio() >= threshold and m.ratio() >= threshold

        return values.map(lambda vs: any(near(v.lower()) for v in vs))

    return match


def _python_regex(pattern: str):
    @F.pandas_udf(T.BooleanType())
    def match(values: pd.Series) -> pd.Series:
        compiled = re.compile(pattern, re.IGNORECASE)
        return values.map(lambda vs: any(compiled.search(v) is not None for v in vs))

    return match


PYTHON_ONLY = re.compile(r"\(\?P|\\Z|\(\?\(|\(\?[aL]")


def predicate(criterion: Criterion) -> Column:
    """The condition that some value of the field fulfils; unknown fields and operators are refused at once."""
    values, operator = field_values(criterion.field), criterion.operator
    if operator not in OPERATORS:
        raise ValueError(f"Unknown search operator: {operator!r}")
    some = lambda f: F.coalesce(F.exists(values, f), F.lit(False))
    needle = (criterion.value or "").lower()
    if operator == "missing":
        return (F.size(values) == 0) | some(lambda v: strip(v) == "")
    if operator == "present":
        return some(lambda v: strip(v) != "")
    if operator == "fuzzy":
        return _fuzzy(needle, FUZZY_THRESHOLD)(values) if needle else F.lit(False)
    if operator == "regex":
        try:
            re.compile(criterion.value)
        except re.error as error:
            raise ValueError(f"Invalid regular expression {criterion.value!r}: {error}") from error
        if PYTHON_ONLY.search(criterion.value):
            return _python_regex(criterion.value)(values)
        return some(lambda v: v.rlike("(?iuU)" + criterion.value))
    if operator in ("exact", "contains", "starts_with", "ends_with"):
        test = {"exact": lambda v: v == needle, "contains": lambda v: v.contains(needle), "starts_with": lambda v: v.startswith(needle), "ends_with": lambda v: v.endswith(needle)}[operator]
        return some(lambda v: test(F.lower(v)))
    try:
        number = float(criterion.value)
    except (TypeError, ValueError):
        return F.lit(False)
    compare = {"eq": lambda a: a == number, "gte": lambda a: a >= number, "lte": lambda a: a <= number, "gt": lambda a: a > number, "lt": lambda a: a < number}[operator]
    return some(lambda v: F.coalesce(compare(_as_number(v, criterion.field)), F.lit(False)))


def sort_keys(name: str) -> list[Column]:
    first = F.try_element_at("authors", F.lit(1))
    keys = {
        "title": [F.lower(F.when(F.col("title_sort") != "", F.col("title_sort")).otherwise(F.col("title")))],
        "author": [F.lower(F.coalesce(F.when(text(first["sort"]) != "", first["sort"]).otherwise(first["name"]), F.lit("")))],
        "series": [F.lower(text("series.name")), F.when(F.col("series").isNull(), 0.0).otherwise(F.col("series_index"))],
        "rating": [F.col("rating")], "date_added": [F.col("timestamp")], "last_modified": [F.col("last_modified")], "size": [F.col("size")],
    }
    if name not in keys:
        raise ValueError(f"Unknown sort: {name!r}")
    return keys[name]


def search(books: DataFrame, criteria: list[Criterion | str], sort: str | None = None, descending: bool = False, limit: int | None = None) -> DataFrame:
    """The books that fulfil all criteria; ties of the sort stay in the order of ids, in either direction."""
    parsed = [parse_term(c) if isinstance(c, str) else c for c in criteria]
    slow = [c for c in parsed if c.operator in ("fuzzy", "regex")]
    for part in ([c for c in parsed if c not in slow], slow):
        if part:
            books = books.filter(reduce(lambda a, b: a & b, map(predicate, part)))
    if sort:
        books = books.orderBy(*[k.desc() if descending else k.asc() for k in sort_keys(sort)], F.col("id").asc())
    return books.limit(limit) if limit is not None else books


def places(books: DataFrame, sort: str, descending: bool = False) -> DataFrame:
    """(id, place): the place of every book in an order, without one task for all.

    Books are sorted in ranges of the keys; a place is the number of books in the ranges before plus that in its own.
    """
    ordered = search(books, [], sort, descending).select("id", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at"))
    ordered = cut(ordered.withColumn("at", F.col("at").bitwiseAND((1 << 33) - 1)))
    counted = ordered.groupBy("part").agg(F.count("*").alias("n"))  # one row per range
    before = counted.withColumn("before", F.sum("n").over(Window.orderBy("part")) - F.col("n"))
    return ordered.join(before.select("part", "before"), "part").select("id", (F.col("before") + F.col("at") + 1).alias("place"))
