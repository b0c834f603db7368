"""Text columns: cleaning, splitting, titles, predicates on the shape of a value."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# The title rules.
SHORT_TITLES = {
    "Capt": "Sir",
    "Don": "Sir",
    "Major": "Sir",
    "Dona": "Sir",
    "Lady": "Sir",
    "the Countess": "Sir",
    "Jonkheer": "Sir",
}
FULL_TITLES = {"Mme": "Mlle", **SHORT_TITLES}

# A word in any script: letters, digits and the underscore.
WORD = r"[\p{L}\p{N}_]+"


def clean(col: Column) -> Column:
    """Lower-case words joined by one space; everything between words goes."""
    return F.array_join(F.regexp_extract_all(F.lower(col), F.lit(WORD), F.lit(0)), " ")


def nth(col: Column, separator: str, position: int) -> Column:
    """The ``position``-th part (from 0) of a string, null when there are fewer parts."""
    return F.get(F.split(col, _literal(separator)), F.lit(position))


def _literal(text: str) -> str:
    return "".join("\\" + c if c in r"\.[]{}()*+-?^$|" else c for c in text)


def title(name: Column) -> Column:
    """``Last, Title. First`` -> ``Title``."""
    return F.trim(nth(nth(name, ".", 0), ",", 1))


def last_name(name: Column) -> Column:
    """``Last, Title. First`` -> ``Last``."""
    return nth(name, ",", 0)


def normalize_title(col: Column, mapping: Mapping[str, str] = FULL_TITLES) -> Column:
    """Replace rare titles by the value they map to."""
    by_target: dict[str, list[str]] = {}
    for source, target in mapping.items():
        by_target.setdefault(target, []).append(source)
    result = col
    for target, sources in by_target.items():
        result = F.when(col.isin(sources), F.lit(target)).otherwise(result)
    return result


def is_digits(col: Column) -> Column:
    """True when the text is digits only (no sign, fraction or blank)."""
    return col.rlike(r"^[0-9]+\z")


def is_numeric_like(col: Column) -> Column:
    """True when only digits are left after removing ``-`` and ``.``."""
    return is_digits(F.translate(col, "-.", ""))


def booleans_to_digits(line: Column) -> Column:
    """``false`` -> ``0`` and ``true`` -> ``1`` anywhere in a line."""
    return F.replace(F.replace(line, F.lit("false"), F.lit("0")), F.lit("true"), F.lit("1"))


def plain_value(col: Column) -> Column:
    """A field without quotes, blanks and colons, in lower case."""
    return F.lower(F.translate(col, '" :\n\r', ""))


def number_or_null(col: Column) -> Column:
    """Numeric-looking text as a number; null for a category.

    Text such as ``1-2`` looks numeric by the digit rule but is no number; it
    counts as a category too (see :func:`category_or_null`).
    """
    return F.when(is_numeric_like(col), col.try_cast("double"))


def category_or_null(col: Column) -> Column:
    """The text itself when it is not a number."""
    return F.when(number_or_null(col).isNull(), col)
