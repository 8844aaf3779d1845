"""Scope and severity of a citation letter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def grid_letter(c: Column) -> Column:
    return F.substring(F.upper(F.btrim(c, F.lit(" \t\r\n"))), 1, 1)


def decompose(c: Column) -> dict[str, Column]:
    """severity_level 1-4, scope_level 1-3 (null for an unknown letter), actual_harm and immediate_jeopardy (false then)."""
    i = F.ascii(grid_letter(c)) - 65
    known = (i >= 0) & (i <= 11)
    severity = F.when(known, F.floor(i / 3) + 1).cast("double")
    return {
        "severity_level": severity,
        "scope_level": F.when(known, i % 3 + 1).cast("double"),
        "actual_harm": F.coalesce(severity >= 3, F.lit(False)),
        "immediate_jeopardy": F.coalesce(severity >= 4, F.lit(False)),
    }
