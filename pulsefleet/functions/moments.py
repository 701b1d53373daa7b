"""Means, spreads and coefficients that come out the same bit for bit, however rows were dealt to tasks.

A group's values are gathered in the order of their days and added up in that order with a running compensation
(Neumaier's), as one person's values would be in a loop: mean first, then squares of what each value is off. A group is one
user's values of one metric, or a user's pairs; it has at most one entry per day of the range, so its size is bounded by the calendar.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Term = Callable[[Column, Column], Column]


def in_order(order: str, **values: str | Column) -> Column:
    """Aggregate: the group's structs (order, values...), sorted by ``order``, which must not repeat."""
    cells = [(F.col(v) if isinstance(v, str) else v).alias(name) for name, v in values.items()]
    return F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), *cells)))


def totals(rows: Column, known: Column, **terms: Term) -> Column:
    """Struct of compensated sums over an array. A term gets an element and ``known``, which is evaluated once."""
    zero = F.lit(0.0)
    start = F.struct(known.alias("known"), *[zero.alias(f"{part}_{name}") for name in terms for part in ("sum", "off")])

    def add(acc: Column, x: Column) -> Column:
        cells = [acc.known.alias("known")]
        for name, term in terms.items():
            held, new = acc[f"sum_{name}"], term(x, acc.known)
            both = held + new
            lost = F.when(F.abs(held) >= F.abs(new), (held - both) + new).otherwise((new - both) + held)
            cells += [both.alias(f"sum_{name}"), (acc[f"off_{name}"] + lost).alias(f"off_{name}")]
        return F.struct(*cells)

    def close(acc: Column) -> Column:
        return F.struct(*[(acc[f"sum_{name}"] + acc[f"off_{name}"]).alias(name) for name in terms])

    return F.aggregate(rows, start, add, close)


def mean_and_spread(rows: Column) -> Column:
    """Struct (mean, sd) of the elements' ``value``: population deviation; nulls for no element."""
    n = F.size(rows)
    mean = F.try_divide(totals(rows, F.lit(None).cast("double"), x=lambda r, _: r["value"])["x"], n)

    def spread(m: Column) -> Column:
        squares = totals(rows, m, q=lambda r, k: (r["value"] - k) * (r["value"] - k))
        return F.struct(m.alias("mean"), F.sqrt(F.try_divide(squares["q"], n)).alias("sd"))

    return F.transform(F.array(mean), spread)[0]  # the mean is bound, not taken once for each use


def pearson(pairs: Column, least: int) -> Column:
    """Coefficient of the elements' ``x`` and ``y``; null for under ``least`` elements or a constant side."""
    n = F.size(pairs)
    nothing = F.lit(None).cast("double")
    sums = totals(pairs, nothing, x=lambda r, _: r["x"], y=lambda r, _: r["y"])
    # The sums stay one struct, so that they are added up once.
    known = F.transform(F.array(sums), lambda s: F.struct(F.try_divide(s["x"], n).alias("x"), F.try_divide(s["y"], n).alias("y")))[0]
    off = totals(
        pairs,
        known,
        xx=lambda r, m: (r["x"] - m["x"]) * (r["x"] - m["x"]),
        yy=lambda r, m: (r["y"] - m["y"]) * (r["y"] - m["y"]),
        xy=lambda r, m: (r["x"] - m["x"]) * (r["y"] - m["y"]),
    )
    r = F.transform(F.array(off), lambda s: F.try_divide(s["xy"], F.sqrt(s["xx"] * s["yy"])))[0]

    def varies(side: str) -> Column:
        values = F.transform(pairs, lambda p: p[side])
        return F.array_min(values) < F.array_max(values)

    return F.when((n >= least) & varies("x") & varies("y"), r)


__all__ = ["in_order", "mean_and_spread", "pearson", "totals"]
