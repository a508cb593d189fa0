"""Array helpers that stay inside Spark's own expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body names it, also per element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def lower_bound(size: Column, below: Callable[[Column], Column]) -> Column:
    """Number of leading positions of 0 .. size - 1 for which ``below`` holds, by bisection."""
    start = F.struct(F.lit(0).alias("lo"), size.cast("int").alias("hi"))

    def step(state: Column, _: Column) -> Column:
        lo, hi = state["lo"], state["hi"]
        middle = F.shiftright(lo + hi, 1)
        moved = F.when(below(middle), F.struct((middle + 1).alias("lo"), hi.alias("hi"))).otherwise(
            F.struct(lo.alias("lo"), middle.alias("hi")))
        return F.when(lo < hi, moved).otherwise(state)

    rounds = F.sequence(F.lit(1), F.length(F.bin(F.greatest(size.cast("long"), F.lit(1)))))
    return F.aggregate(rounds, start, step, lambda state: state["lo"])


def running_sums(numbers: Column) -> Column:
    """Inclusive running sums of an array of longs. Blocks of about the square root of its size keep the
    work at size ** 1.5."""

    def blocks(x: Column) -> Column:
        width = F.greatest(F.ceil(F.sqrt(F.size(x))), F.lit(1)).cast("int")
        starts = F.sequence(F.lit(0), F.greatest(F.size(x) - 1, F.lit(0)), width)
        parts = F.transform(starts, lambda s: F.slice(x, s + 1, width))
        return let(parts, lambda p: let(F.transform(p, _sum), lambda t: F.flatten(F.transform(
            p, lambda part, i: let(_sum(F.slice(t, F.lit(1), i)), lambda base: F.transform(
                part, lambda _, j: base + _sum(F.slice(part, F.lit(1), j + 1))))))))

    return let(numbers, lambda x: F.when(F.size(x) > 0, blocks(x)).otherwise(x))


def _sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0).cast("long"), lambda a, v: a + v)
