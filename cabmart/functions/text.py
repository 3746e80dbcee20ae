"""Text cleaning."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed value: the whitespace class of the SQL engine the results must match
# (its ``\s`` is tab, newline, form feed, carriage return and space; Java's
# ``\s`` also takes the vertical tab, so the class is spelled out).
WS = "[\\t\\n\\f\\r ]"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalize_text(c, lower: bool = False, first_only: bool = False) -> Column:
    """trim -> [lower] -> collapse whitespace runs to one space -> '' becomes NULL.

    ``first_only=True`` collapses only the first run, the way a
    ``regexp_replace`` without the global flag does.
    """
    x = F.trim(_col(c))
    if lower:
        x = F.lower(x)
    if first_only:
        # Lazy prefix up to the first run, then the run itself.
        x = F.regexp_replace(x, f"(?s)^(.*?){WS}+", "$1 ")
    else:
        x = F.regexp_replace(x, f"{WS}+", " ")
    return F.nullif(x, F.lit(""))


def clean_name(c, lower: bool = False) -> Column:
    """trim [+ lower] without collapsing, as used for zone attributes."""
    x = F.trim(_col(c))
    return F.lower(x) if lower else x
