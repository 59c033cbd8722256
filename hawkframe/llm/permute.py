"""Pseudorandom permutations of 0 .. n-1 as column expressions, and the same as SQL text.

A generalised Feistel network over Z_a x Z_b with a = ceil(sqrt n), b = ceil(n / a) permutes the a * b
pairs; a value that lands beyond n-1 is put through again until it falls inside (cycle walking). At most
a * b - n < a values lie outside, so a walk takes at most that many steps. Only whole-number arithmetic
below 2^62 is used, so any engine gives the same permutation. n may be up to 2^60.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DOUBLE_ROUNDS = 3
PRIME = 2_147_483_647
ADD, MUL = 1_234_567, 48_271


def quotient(x: Column, y: Column) -> Column:
    return F.call_function("div", x, y)


def _mix(x: Column, key: Column) -> Column:
    y = (x + key) % F.lit(PRIME)
    return ((y * y) % F.lit(PRIME) * F.lit(MUL) + key) % F.lit(PRIME)


def _key(seed: Column, i: Column) -> Column:
    return (seed * F.lit(2_011) + i * F.lit(ADD)) % F.lit(PRIME)


def _network(x: Column, a: Column, b: Column, seed: Column) -> Column:
    def double_round(s: Column, i: Column) -> Column:
        left = (s["l"] + _mix(s["r"], _key(seed, i * 2))) % a
        return F.struct(left.alias("l"), ((s["r"] + _mix(left, _key(seed, i * 2 + 1))) % b).alias("r"))

    start = F.struct((x % a).alias("l"), quotient(x, a).alias("r"))
    rounds = F.sequence(F.lit(1).cast("long"), F.lit(DOUBLE_ROUNDS).cast("long"))
    return F.aggregate(rounds, start, double_round, lambda s: s["r"] * a + s["l"])


def permuted(x: Column, n: Column, seed: Column) -> Column:
    """The place of `x` (long, 0 .. n-1) under the permutation that `seed` (0 .. 10^12) names."""
    a = F.greatest(F.ceil(F.sqrt(n)).cast("long"), F.lit(1).cast("long"))
    b = quotient(n + a - 1, a)
    once = _network(x, a, b, seed)
    steps = F.sequence(F.lit(0).cast("long"), a * b - n)
    walk = F.aggregate(steps, once, lambda y, _: F.when(y < n, y).otherwise(_network(y, a, b, seed)))
    return F.when(once < n, once).otherwise(walk)


def with_permuted(df: DataFrame, out: str, x: Column, n: Column, seed: Column) -> DataFrame:
    """`df` with `out`, the place of `x` as in `permuted`. The rounds are columns of successive projections, so that each is
    compiled and computed once; only the few values that land outside are walked by the interpreted form."""
    step = df.select(*df.columns, x.alias("_fx"), n.alias("_fn"), seed.alias("_fs"))
    x, n, seed, a, b, left, right, y = (F.col(c) for c in ("_fx", "_fn", "_fs", "_fa", "_fb", "_fl", "_fr", "_fy"))
    step = step.withColumn("_fa", F.greatest(F.ceil(F.sqrt(n)).cast("long"), F.lit(1).cast("long")))
    step = step.withColumns({"_fb": quotient(n + a - 1, a), "_fl": x % a, "_fr": quotient(x, a)})
    for i in range(1, DOUBLE_ROUNDS + 1):
        step = step.withColumn("_fl", (left + _mix(right, _key(seed, F.lit(2 * i).cast("long")))) % a)
        step = step.withColumn("_fr", (right + _mix(left, _key(seed, F.lit(2 * i + 1).cast("long")))) % b)
    step = step.withColumn("_fy", right * a + left)
    walk = F.aggregate(F.sequence(F.lit(0).cast("long"), a * b - n), y, lambda v, _: F.when(v < n, v).otherwise(_network(v, a, b, seed)))
    return step.select(*df.columns, F.when(y < n, y).otherwise(walk).alias(out))


def network_sql(x: str, a: str, b: str, seed: str) -> str:
    """The network as one DuckDB expression over the names given."""

    def mix(v: str, key: str) -> str:
        y = f"(({v} + {key}) % {PRIME})"
        return f"((({y} * {y}) % {PRIME} * {MUL} + {key}) % {PRIME})"

    left, right = f"({x} % {a})", f"({x} // {a})"
    for i in range(1, DOUBLE_ROUNDS + 1):
        k1, k2 = (f"(({seed} * 2011 + {j} * {ADD}) % {PRIME})" for j in (2 * i, 2 * i + 1))
        left = f"(({left} + {mix(right, k1)}) % {a})"
        right = f"(({right} + {mix(left, k2)}) % {b})"
    return f"({right} * {a} + {left})"
