"""Text scalars built from built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def words(text: Column) -> Column:
    """Runs of characters other than white space."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def host(url: Column) -> Column:
    """The host of a URL in lower case, without its port; null if there is none."""
    found = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]+)", 1))
    return F.when(found != "", found)


def fraction(text: Column, pattern: str) -> Column:
    """The share of characters that match a one-character pattern; null for empty texts."""
    n = F.length(text)
    return F.try_divide(n - F.length(F.regexp_replace(text, pattern, "")), n)
