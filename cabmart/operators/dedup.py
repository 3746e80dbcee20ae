"""Keep-one-row-per-key operators.

``keep_first`` is written as a grouped MIN/MAX over a struct instead of a
``row_number()`` window: the aggregate combines map-side, so a key that holds
a large share of all rows never lands whole in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def keep_first(df: DataFrame, keys: list[str], order: list[str],
               descending: bool = False) -> DataFrame:
    """One row per ``keys``: the first by ``order`` (all ascending, or all
    descending), NULLs last, remaining columns as final tie-breakers.

    Same result as ``row_number() over (partition by keys order by order
    [desc] nulls last, <other columns>) = 1``.
    """
    rest = [c for c in df.columns if c not in keys and c not in order]
    parts = []
    for i, c in enumerate(order):
        # ascending + MIN: (is_null, value); descending + MAX: (is_not_null, value)
        flag = F.col(c).isNotNull() if descending else F.col(c).isNull()
        parts += [flag.alias(f"_n{i}"), F.col(c).alias(f"_o{i}")]
    payload = F.struct(*parts, *[F.col(c) for c in rest])
    pick = F.max(payload) if descending else F.min(payload)
    best = df.groupBy(*keys).agg(pick.alias("_best"))
    out = []
    for c in df.columns:
        if c in keys:
            out.append(F.col(c))
        elif c in order:
            out.append(F.col("_best").getField(f"_o{order.index(c)}").alias(c))
        else:
            out.append(F.col("_best").getField(c).alias(c))
    return best.select(*out)


def min_per_key(df: DataFrame, key: str, value: str) -> DataFrame:
    """``select key, min(value) group by key``."""
    return df.groupBy(key).agg(F.min(value).alias(value))


def distinct_values(df: DataFrame, *cols: str) -> DataFrame:
    return df.select(*cols).distinct()
