"""A seeded 64-bit generator and draws without replacement, as column expressions.

The state is a counter, so the m-th number of a seed is known without those before it. Unsigned 64-bit numbers are
decimals, as ANSI arithmetic on longs does not wrap.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: the generator's increment and multipliers
STEP, FIRST, SECOND = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


def _number(n: int) -> Column:
    return F.expr(f"{n}BD").cast("decimal(20,0)")


def _wrapped(x: Column) -> Column:
    return (x % F.expr(f"{1 << 64}BD")).cast("decimal(20,0)")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """The body with a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _times(x: Column, by: int) -> Column:
    low, high = by & 0xFFFFFFFF, by >> 32
    part = lambda n: (x * F.expr(f"{n}BD").cast("decimal(10,0)"))
    upper = (part(high) % F.expr("4294967296BD")).cast("decimal(10,0)") * F.expr("4294967296BD").cast("decimal(10,0)")
    return _wrapped(part(low) + upper)


def _mixed(x: Column, shift: int) -> Column:
    """x xor (x >> shift)."""
    signed = F.when(x >= F.expr(f"{1 << 63}BD"), x - F.expr(f"{1 << 64}BD")).otherwise(x).cast("long")
    out = let(signed, lambda s: s.bitwiseXOR(F.shiftrightunsigned(s, shift)))
    return let(out, lambda s: F.when(s < 0, s.cast("decimal(20,0)") + F.expr(f"{1 << 64}BD")).otherwise(s.cast("decimal(20,0)")).cast("decimal(20,0)"))


def seeded(material: Column) -> Column:
    """The state that the first eight bytes of the text's SHA-256 give, the lowest first."""
    return let(F.sha2(material.cast("binary"), 256), lambda h: F.conv(F.concat(*[F.substring(h, 2 * k + 1, 2) for k in range(7, -1, -1)]), 16, 10).cast("decimal(20,0)"))


def number(seed: Column, at: Column) -> Column:
    """The number at a place, counted from 1, of a seed's sequence."""
    state = _wrapped(seed + _times(at.cast("decimal(20,0)"), STEP))
    z = let(state, lambda s: _times(_mixed(s, 30), FIRST))
    return let(let(z, lambda s: _times(_mixed(s, 27), SECOND)), lambda s: _mixed(s, 31))


def below(seed: Column, at: Column, bound: Column) -> Column:
    """struct(value, at): a uniform number below a bound of at least 1, and the place it was drawn from.

    Numbers that a remainder would favour are drawn again, once: twice in a row has a chance under 2^-80 for bounds
    below 2^24.
    """
    least = F.expr(f"{1 << 64}BD") % bound.cast("decimal(20,0)")
    value = lambda n: (n % bound.cast("decimal(20,0)")).cast("long")
    again = F.struct(value(number(seed, at + 1)).alias("value"), (at + 1).alias("at"))
    return let(number(seed, at), lambda n: F.when(n >= least, F.struct(value(n).alias("value"), at.alias("at"))).otherwise(again))


def drawn(seed: Column, size: Column, k: Column, before: Column | None = None) -> Column:
    """k different places below `size`, in the order in which they are drawn: the first steps of a shuffle.

    Only places that were swapped are held, so the cost is that of k, whatever the size. `before`: numbers of the seed
    that are used already.
    """
    swap = "array<struct<at: bigint, holds: bigint>>"
    start = F.struct(F.coalesce(before, F.lit(0)).cast("long").alias("used") if before is not None else F.lit(0).cast("long").alias("used"), F.array().cast(swap).alias("moved"), F.array().cast("array<bigint>").alias("out"))
    k, size = F.least(k, size).cast("long"), size.cast("long")
    holds = lambda moved, x: F.coalesce(F.try_element_at(F.transform(F.filter(moved, lambda m: m.at == x), lambda m: m.holds), F.lit(-1)), x)

    def step(s: Column, i: Column) -> Column:
        def put(d: Column) -> Column:
            j = i + d.value
            rest = F.filter(s.moved, lambda m: (m.at != j) & (m.at != i))
            return F.struct(d["at"].alias("used"), F.concat(rest, F.array(F.struct(j.alias("at"), holds(s.moved, i).alias("holds")))).cast(swap).alias("moved"), F.concat(s.out, F.array(holds(s.moved, j))).alias("out"))

        return let(below(seed, s.used + 1, size - i), put)

    turns = F.when(k > 0, F.sequence(F.lit(0).cast("long"), k - 1)).otherwise(F.array().cast("array<bigint>"))
    return F.aggregate(turns, start, step, lambda s: s.out)
