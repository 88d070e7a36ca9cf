"""Column helpers whose results agree with Python's text and number rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Python's ``str.strip`` sees it, as a Java character class body.
#: Unicode White_Space plus the four information separators.
SPACE = r"\s\x0b\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

NAN = float("nan")


def py_strip(c: Column | str) -> Column:
    """Trim Unicode white space at both ends; null stays null."""
    c = F.col(c) if isinstance(c, str) else c
    return F.regexp_replace(c, rf"^[{SPACE}]+|[{SPACE}]+$", "")


def squeeze(c: Column | str) -> Column:
    """Trim, and make each run of Unicode white space one blank."""
    c = F.col(c) if isinstance(c, str) else c
    return py_strip(F.regexp_replace(c, rf"[{SPACE}]+", " "))


def blank_to_null(c: Column | str) -> Column:
    """Null for blank text, else the text as it is."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(F.length(py_strip(c)) > 0, c)


def div_nan(a: Column, b: Column) -> Column:
    """a / b as double, NaN where b is 0 (never an ANSI error)."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(NAN))


def div_zero(a: Column, b: Column) -> Column:
    """a / b as double, 0 where b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def let(value: Column, use) -> Column:
    """``use`` of a column that is computed once.

    A column that an expression names several times is computed as often, and
    inside a lambda for each element. As the element of a one-element array it
    is a variable.
    """
    return F.element_at(F.transform(F.array(value), use), 1)


def is_number(c: Column) -> Column:
    """True for a value that is neither null nor NaN."""
    return c.isNotNull() & ~F.isnan(c)


def seeded(seed: int, *keys: Column | str) -> Column:
    """A reproducible random order key: md5 of the seed and the keys."""
    cols = [F.coalesce((F.col(k) if isinstance(k, str) else k).cast("string"), F.lit("")) for k in keys]
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *cols))
