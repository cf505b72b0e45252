"""Exact fractions as struct<num: bigint, den: bigint>, always reduced, den positive."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LEAST = -(2**63)


def quotient(a: Column, b: Column) -> Column:
    """The whole part of a / b, exact over all of bigint."""
    return F.call_function("div", a, b)


def magnitude(a: Column) -> Column:
    """The absolute value; null for the one bigint that has none."""
    a = a.cast("bigint")
    return F.when(a != LEAST, F.abs(F.greatest(a, F.lit(LEAST + 1))))


def gcd(a: Column, b: Column) -> Column:
    """Greatest common divisor of the magnitudes, by Euclid's rule, which takes at most five steps for each digit of the smaller operand."""
    def run(s: Column) -> Column:
        step = lambda t, _: F.when(t["b"] == 0, t).otherwise(F.struct(t["b"].alias("a"), F.try_mod(t["a"], t["b"]).alias("b")))
        steps = 5 * F.length(F.least(s["a"], s["b"]).cast("string")) + 1
        folded = F.aggregate(F.sequence(F.lit(1), steps), s, step, lambda t: t["a"])
        return F.when(s["b"] == 0, s["a"]).when((s["a"] == 1) | (s["b"] == 1), F.lit(1).cast("bigint")).otherwise(folded)

    return _with(F.struct(magnitude(a).alias("a"), magnitude(b).alias("b")), run)


def lcm(a: Column, b: Column) -> Column:
    """Least common multiple of the magnitudes, 0 where one is 0; null where it doesn't fit 64 bits."""
    return F.when((a == 0) | (b == 0), F.lit(0).cast("bigint")).otherwise(F.try_multiply(quotient(magnitude(a), gcd(a, b)), magnitude(b)))


def _with(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.transform(F.array(value), use)[0]


def _signed(num: Column, den: Column) -> Column:
    """The sign moved to the numerator, for a reduced pair; null where it doesn't fit."""
    return F.when(num.isNotNull() & (den > 0), F.struct(num.alias("num"), den.alias("den"))).when((den < 0) & (num != LEAST) & (den != LEAST), F.struct((-F.greatest(num, F.lit(LEAST + 1))).alias("num"), (-F.greatest(den, F.lit(LEAST + 1))).alias("den")))


def _reduced(s: Column) -> Column:
    return _with(F.struct(s["n"].alias("n"), s["d"].alias("d"), gcd(s["n"], s["d"]).alias("g")), lambda r: _signed(quotient(r["n"], r["g"]), quotient(r["d"], r["g"])))


def fraction(num: Column, den: Column) -> Column:
    """The reduced fraction; null where den is 0, or where an operand or the result doesn't fit 64 bits with its sign changed."""
    both = F.struct(num.cast("bigint").alias("n"), den.cast("bigint").alias("d"))
    return F.when(den != 0, _with(both, _reduced))


def plus(a: Column, b: Column) -> Column:
    """The sum, over the least common denominator; null where a step doesn't fit 64 bits."""
    def add(s: Column) -> Column:
        g = gcd(s["a"]["den"], s["b"]["den"])

        def over(r: Column) -> Column:
            left, right = quotient(r["b"]["den"], r["g"]), quotient(r["a"]["den"], r["g"])
            num = F.try_add(F.try_multiply(r["a"]["num"], left), F.try_multiply(r["b"]["num"], right))
            return fraction(num, F.try_multiply(r["a"]["den"], left))

        return _with(F.struct(s["a"].alias("a"), s["b"].alias("b"), g.alias("g")), over)

    return _with(F.struct(a.alias("a"), b.alias("b")), add)


def times(a: Column, b: Column) -> Column:
    """The product; operands are reduced crosswise first, so it is null only where the product itself doesn't fit 64 bits."""
    def multiply(s: Column) -> Column:
        crossed = F.struct(s["a"].alias("a"), s["b"].alias("b"), gcd(s["a"]["num"], s["b"]["den"]).alias("g"), gcd(s["b"]["num"], s["a"]["den"]).alias("h"))
        return _with(crossed, lambda r: _signed(F.try_multiply(quotient(r["a"]["num"], r["g"]), quotient(r["b"]["num"], r["h"])), F.try_multiply(quotient(r["a"]["den"], r["h"]), quotient(r["b"]["den"], r["g"]))))

    return _with(F.struct(a.alias("a"), b.alias("b")), multiply)


def divides(a: Column, b: Column) -> Column:
    """The quotient; null where b is 0."""
    return F.when(b["num"] != 0, times(a, _signed(b["den"], b["num"])))


def common_divisor(a: Column, b: Column) -> Column:
    """The largest fraction of the form 1/n in which both are counted: b where a is 0, else 1 over the common multiple of the denominators."""
    return F.when(a["num"] == 0, b).otherwise(fraction(F.lit(1).cast("bigint"), lcm(a["den"], b["den"])))


def signature(text: Column) -> Column:
    """'beats/type' as it is written, unreduced; null for anything else."""
    n, d = (F.regexp_extract(text, r"^\s*(\d+)\s*/\s*(\d+)\s*$", k).try_cast("bigint") for k in (1, 2))
    return F.when(n.isNotNull() & (d > 0), F.struct(n.alias("num"), d.alias("den")))


def less(a: Column, b: Column) -> Column:
    wide = lambda x: x.cast("decimal(19,0)")
    return wide(a["num"]) * wide(b["den"]) < wide(b["num"]) * wide(a["den"])


def parse(text: Column) -> Column:
    """'n/d' or 'n'; null for anything else."""
    n, d = F.regexp_extract(text, r"^\s*(-?\d+)\s*(?:/\s*(\d+)\s*)?$", 1), F.regexp_extract(text, r"^\s*(-?\d+)\s*(?:/\s*(\d+)\s*)?$", 2)
    return F.when(n != "", fraction(n.try_cast("bigint"), F.when(d == "", F.lit(1)).otherwise(d.try_cast("bigint"))))
