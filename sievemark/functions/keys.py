"""Canonical forms of the keys that records use to point at each other."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = " \t\r\n\f\u000b\u00a0"


def blank_to_null(c: Column) -> Column:
    """Trimmed text, null when nothing is left."""
    return F.nullif(F.btrim(c, F.lit(BLANKS)), F.lit(""))


def facility_key(c: Column) -> Column:
    """Facility number: trimmed, upper case, zeros restored to six characters."""
    t = F.upper(blank_to_null(c))
    return F.when(F.length(t) < 6, F.lpad(t, 6, "0")).otherwise(t)


def tag_key(c: Column) -> Column:
    """Tag without blanks and leading zeros; a bare number is an F tag."""
    t = F.nullif(F.upper(F.translate(c, BLANKS, "")), F.lit(""))
    head = F.substring(t, 1, 1)
    lettered = head.between("A", "Z")
    number = F.when(lettered, F.substring(t, 2, 1 << 30)).otherwise(t)
    digits = (number != "") & (F.translate(number, "0123456789", "") == "")
    bare = F.ltrim(number, F.lit("0"))
    return F.when(digits, F.concat(F.when(lettered, head).otherwise("F"), F.when(bare == "", "0").otherwise(bare))).otherwise(t)


def day_key(c: Column) -> Column:
    """A day written ``yyyy-mm-dd`` or ``mm/dd/yyyy`` as ``yyyy-mm-dd``; impossible days stay comparable text."""
    t = blank_to_null(c)
    part = lambda i: F.split_part(t, F.lit("/"), F.lit(i))
    us = t.contains("/") & t.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$")
    return F.when(us, F.concat_ws("-", part(3), F.lpad(part(1), 2, "0"), F.lpad(part(2), 2, "0"))).otherwise(t)


def grid_key(c: Column) -> Column:
    """First character of a severity code, trimmed and upper-cased; null and blank are no reference."""
    return F.substring(F.upper(blank_to_null(c)), 1, 1)


def snake_name(c: Column) -> Column:
    """Field name: trimmed, lower case, blanks as underscores."""
    return F.regexp_replace(F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", "")), r"(?U)\s", "_")
