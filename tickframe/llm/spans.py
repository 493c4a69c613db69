"""Matches with positions by built-in SQL functions alone."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def running(values: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """Running ``combine`` (a sum, a maximum) over an array: strides double, so there are as many passes as the length has bits."""

    def passes(xs: Column) -> Column:
        def step(acc: Column, k: Column) -> Column:
            stride = F.call_function("shiftleft", F.lit(1), k)
            return F.transform(acc, lambda v, i: F.when(i < stride, v).otherwise(combine(F.get(acc, i - stride), v)))

        return F.when(F.size(xs) > 1, F.aggregate(F.sequence(F.lit(0), F.length(F.bin(F.size(xs) - 1)) - 1), xs, step)).otherwise(xs)

    return once(values, passes)


def count_below(rising: Column, bound: Column) -> Column:
    """How many numbers of a rising array are below ``bound``, by bisection."""
    bits = F.length(F.bin(F.size(rising)))

    def step(at: Column, k: Column) -> Column:
        to = at + F.call_function("shiftleft", F.lit(1), k)
        return F.when((to <= F.size(rising)) & (F.get(rising, to - 1) < bound), to).otherwise(at)

    return F.aggregate(F.sequence(bits - 1, F.lit(0), F.lit(-1)), F.lit(0), step)


def matches(text: Column, pattern: Column | str, group: int = 0, measure: Callable[[Column], Column] = F.length) -> Column:
    """All leftmost non-overlapping matches: ``array<struct<start, end, value>>``.

    Positions are counted by ``measure`` (code points unless told otherwise); ``value`` is the
    capture ``group``.  The text between matches comes from ``split`` with the same pattern, so
    ends are running sums of the lengths of pieces and matches.  ``pattern`` must not match
    the empty string.
    """
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    empty = F.array().cast("array<struct<start:int,end:int,value:string>>")

    def place(x: Column) -> Column:
        ends = running(F.transform(x["all"], lambda v, i: measure(x["between"][i]) + measure(v)), lambda a, b: a + b)
        found = lambda at: lambda v, i: F.struct((at[i] - measure(v)).alias("start"), at[i].alias("end"), x["value"][i].alias("value"))
        return once(ends, lambda at: F.transform(x["all"], found(at)))

    whole = F.regexp_extract_all(text, pattern, F.lit(0))
    parts = F.struct(whole.alias("all"), (F.regexp_extract_all(text, pattern, F.lit(group)) if group else whole).alias("value"), F.split(text, pattern, -1).alias("between"))
    return F.when(F.rlike(text, pattern), once(parts, place)).otherwise(empty)
