"""Column functions with the string semantics of the catalogue rules: Unicode strip, signatures, checksums, formats.

All are pure expressions inside whole-stage code generation; none needs a Python worker.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
BY_CLAUSE = r"(?U)\s+by\s+[A-Z][\w.'-]*(?:\s+[A-Z][\w.'-]*)+$"
ILLEGAL_IN_PATH = r'[<>:"/\\|?*\x00-\x1f]'
LONGEST_COMPONENT = 150


def _c(column: Column | str) -> Column:
    return F.col(column) if isinstance(column, str) else column


def strip(column: Column | str) -> Column:
    """Without any white space at both ends, not only spaces."""
    return F.regexp_replace(_c(column), r"(?U)^\s+|\s+$", "")


def text(column: Column | str) -> Column:
    """Null becomes the empty string."""
    return F.coalesce(_c(column), F.lit(""))


def name_signature(column: Column | str) -> Column:
    """The sorted words of a name in lower case, with repetitions; an empty array without words."""
    return F.array_sort(F.regexp_extract_all(F.lower(text(column)), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1)))


def without_digits(column: Column | str) -> Column:
    return F.regexp_replace(_c(column), r"(?U)\d+", "")


def title_sort(column: Column | str) -> Column:
    """A leading article goes to the end; null and empty stay."""
    return F.regexp_replace(_c(column), r"(?isU)^(the|a|an)\s+(.*)$", "$2, $1")


def has_by_clause(column: Column | str) -> Column:
    return strip(column).rlike(BY_CLAUSE)


def without_by_clause(column: Column | str) -> Column:
    return strip(F.regexp_replace(strip(column), BY_CLAUSE, ""))


def _digit(cleaned: Column, position: Column) -> Column:
    letter = cleaned.substr(position, F.lit(1))
    return F.when(letter == "X", 10).otherwise(F.try_to_number(letter, F.lit("9")).cast("int"))


def isbn_valid(column: Column | str) -> Column:
    """Whether the ISBN-10 or ISBN-13 checksum holds; hyphens and spaces don't count, null and anything else is false."""
    cleaned = F.upper(F.regexp_replace(text(column), r"(?U)[\s-]", ""))
    total = lambda n, weight: F.aggregate(F.sequence(F.lit(1), F.lit(n)), F.lit(0), lambda acc, i: acc + _digit(cleaned, i) * weight(i))
    ten = cleaned.rlike("^[0-9]{9}[0-9X]$")
    thirteen = cleaned.rlike("^[0-9]{13}$")
    return F.when(ten, total(10, lambda i: F.lit(11) - i) % 11 == 0).when(thirteen, total(13, lambda i: F.when(i % 2 == 1, 1).otherwise(3)) % 10 == 0).otherwise(False)


def path_component(column: Column | str, fallback: Column | str = "Unknown") -> Column:
    """A text as one path component: no reserved or control characters, single spaces, no dots or spaces at the end."""
    cleaned = F.regexp_replace(strip(text(column)), ILLEGAL_IN_PATH, "")
    cleaned = strip(F.regexp_replace(cleaned, r"(?U)\s+", " "))
    cleaned = F.regexp_replace(cleaned, r"(?U)[.\s]+$", "")
    kept = F.when(cleaned == "", F.lit(fallback) if isinstance(fallback, str) else fallback).otherwise(cleaned)
    return F.substring(kept, 1, LONGEST_COMPONENT)


def quoted(column: Column | str) -> Column:
    """In quotation marks as messages show values: single, unless the value has a single and no double one."""
    c = _c(column)
    escaped = F.regexp_replace(c, r"\\", r"\\\\")
    double = c.contains("'") & ~c.contains('"')
    return F.when(double, F.concat(F.lit('"'), escaped, F.lit('"'))).otherwise(F.concat(F.lit("'"), F.replace(escaped, F.lit("'"), F.lit("\\'")), F.lit("'")))


def short_number(column: Column | str) -> Column:
    """A double without a needless fraction."""
    c = _c(column)
    return F.when(c == F.floor(c), F.floor(c).cast("string")).otherwise(c.cast("string"))


def listed(column: Column | str) -> Column:
    """An array of numbers as [1, 2]."""
    return F.concat(F.lit("["), F.array_join(F.transform(_c(column), lambda x: x.cast("string")), ", "), F.lit("]"))


def preview(column: Column | str, length: int = 100) -> Column:
    """The beginning of a text on one line."""
    return F.translate(F.substring(text(column), 1, length), "\n", " ")
