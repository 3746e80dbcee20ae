"""Fact-to-dimension lookups (J1-J9) with a checked broadcast.

A dimension is broadcast only when its size is known to be small: either the
caller states a proven row bound (a date range, a fixed code list), or the
optimizer's size estimate is under the limit.  Otherwise the join is left to
the planner and AQE (shuffle join, converted at run time if it turns out
small).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Upper bound for a broadcast side in memory (bytes).  Kept below Spark's 8 GB
# hard limit and well inside executor memory.
DEFAULT_BROADCAST_LIMIT = 64 * 1024 * 1024
# Estimates of stored tables are sizes of compressed files; in memory they can be
# several times that, and this much is allowed for.
UNPACKED = 8


def estimated_bytes(df: DataFrame) -> int | None:
    """Optimizer's size estimate of a plan, or None when unavailable."""
    try:
        return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    except Exception:  # Spark Connect or no statistics
        return None


def is_small(dim: DataFrame, limit: int = DEFAULT_BROADCAST_LIMIT, max_rows: int | None = None, row_bytes: int = 256) -> bool:
    if max_rows is not None and max_rows * row_bytes <= limit:
        return True
    size = estimated_bytes(dim)
    return size is not None and size * UNPACKED <= limit


def broadcast_if_small(dim: DataFrame, limit: int = DEFAULT_BROADCAST_LIMIT,
                       max_rows: int | None = None, row_bytes: int = 256) -> DataFrame:
    """Hint a broadcast when the dimension is provably below ``limit``."""
    return F.broadcast(dim) if is_small(dim, limit, max_rows, row_bytes) else dim


def month_slices(dim: DataFrame, month: Column, limit: int) -> list[tuple[int, int]]:
    """Consecutive ranges of months such that the rows of each take at most ``limit`` bytes in memory.

    A month of more rows than that is a range of its own.
    """
    row = 64 * len(dim.columns)                          # bytes of a row in memory, generously
    counts = dim.groupBy(month.alias("month")).count().filter("month IS NOT NULL").orderBy("month").collect()   # a row a month
    out: list[tuple[int, int]] = []
    used = 0
    for r in counts:
        if out and used + r["count"] * row <= limit:
            out[-1] = (out[-1][0], r.month)
            used += r["count"] * row
        else:
            out.append((r.month, r.month))
            used = r["count"] * row
    return out


def lookup_in_slices(fact: DataFrame, dim: DataFrame, on: list[tuple[str, str]], take: dict[str, tuple[str, object]],
                     month: str, dim_month: Column, limit: int = DEFAULT_BROADCAST_LIMIT) -> DataFrame:
    """``lookup`` in a dimension too large to broadcast, whose matches lie in the fact row's month.

    The fact is read once for each range of months (its own months only, where it is
    stored by month) and joined to that range of the dimension, which is small enough
    to broadcast.  Rows of other months have no match.
    """
    tag = "_dim_month"
    ranges = month_slices(dim, dim_month, limit)
    tagged = dim.withColumn(tag, dim_month)
    parts = []
    for lo, hi in ranges:
        own = F.col(month).between(lo, hi)
        part = tagged.filter(F.col(tag).between(lo, hi)).drop(tag)
        parts.append(lookup(fact.filter(own), part, on, take, hinted=True))
    inside = F.lit(False)
    for lo, hi in ranges:
        inside = inside | F.col(month).between(lo, hi)
    rest = fact.filter(~F.coalesce(inside, F.lit(False)))
    none = [(F.lit(None).cast(dim.schema[src].dataType) if default is None else
             (default if isinstance(default, Column) else F.lit(default)).cast(dim.schema[src].dataType)).alias(out)
            for out, (src, default) in take.items()]
    rest = rest.select(*[c for c in fact.columns if c not in take], *none)
    for p in parts:
        rest = rest.unionByName(p)
    return rest


def lookup_many(fact: DataFrame, specs: list[dict], limit: int = DEFAULT_BROADCAST_LIMIT) -> DataFrame:
    """Several LEFT JOIN lookups in a row, defaults applied in one final projection.

    Each spec holds ``dim``, ``on`` [(fact column, dim column)], ``take``
    {output: (dim column, default)} and optionally ``max_rows`` and
    ``dim_filter``; an ``on`` column may name an output of an earlier spec.
    ``slices`` (fact column, dim expression) names the months by which a dimension
    beyond the broadcast ``limit`` is looked up in slices.
    Same result as chaining ``lookup``; fewer plan-building calls.
    """
    sliced = [s for s in specs if s.get("slices") and not is_small(s["dim"], limit, s.get("max_rows"))]
    if sliced:
        late = {out for s in sliced for out in s["take"]}
        early = [s for s in specs if not any(s is x for x in sliced)]
        assert not any(f in late for s in early for f, _ in s["on"])
        fact = lookup_many(fact, [{**s, "slices": None} for s in early], limit) if early else fact
        for s in sliced:
            fact = lookup_in_slices(fact, s["dim"], s["on"], s["take"], *s["slices"], limit=limit)
        return fact
    joined = fact
    taken: dict[str, tuple[str, object]] = {}
    for i, spec in enumerate(specs):
        dim = spec["dim"]
        if spec.get("dim_filter") is not None:
            dim = dim.filter(spec["dim_filter"])
        tag = f"_lk{i}"
        cols = [F.col(d).alias(f"{tag}_{d}") for _, d in spec["on"]]
        cols += [F.col(src).alias(f"{tag}v_{out}") for out, (src, _) in spec["take"].items()]
        small = broadcast_if_small(dim.select(*cols), limit, max_rows=spec.get("max_rows"))
        cond = None
        for f, d in spec["on"]:
            left = F.col(taken[f][0]) if f in taken else joined[f]
            c = left == small[f"{tag}_{d}"]
            cond = c if cond is None else cond & c
        joined = joined.join(small, cond, "left")
        for out, (_, default) in spec["take"].items():
            taken[out] = (f"{tag}v_{out}", default)
    out = [F.col(c) for c in fact.columns if c not in taken]
    for name, (col, default) in taken.items():
        v = F.col(col)
        if default is None:
            out.append(v.alias(name))
        else:
            d = default if isinstance(default, Column) else F.lit(default)
            out.append(F.coalesce(v, d).alias(name))
    return joined.select(*out)


def lookup(fact: DataFrame, dim: DataFrame, on: list[tuple[str, str]],
           take: dict[str, tuple[str, object]], max_rows: int | None = None,
           dim_filter: Column | None = None, hinted: bool = False) -> DataFrame:
    """LEFT JOIN dim ON fact.f = dim.d ... and COALESCE the taken columns.

    ``take`` maps output column -> (dimension column, default or None).  The
    dimension must be unique on its join columns (true for every dimension
    built here), so the fact keeps its row count.  ``hinted``: the caller knows that it is small.
    """
    if dim_filter is not None:
        dim = dim.filter(dim_filter)
    tag = "_lk"
    cols = [F.col(d).alias(f"{tag}_{d}") for _, d in on]
    cols += [F.col(src).alias(f"{tag}v_{out}") for out, (src, _) in take.items()]
    small = dim.select(*cols)
    small = F.broadcast(small) if hinted else broadcast_if_small(small, max_rows=max_rows)
    cond = None
    for f, d in on:
        c = fact[f] == small[f"{tag}_{d}"]
        cond = c if cond is None else cond & c
    joined = fact.join(small, cond, "left")
    out = [F.col(c) for c in fact.columns if c not in take]
    for name, (_, default) in take.items():
        v = F.col(f"{tag}v_{name}")
        if default is None:
            out.append(v.alias(name))
        else:
            d = default if isinstance(default, Column) else F.lit(default)
            out.append(F.coalesce(v, d).alias(name))
    return joined.select(*out)
