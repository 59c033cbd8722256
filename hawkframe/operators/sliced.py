"""Ordered per-key computations that stay parallel when one key is hot.

A plain ``Window.partitionBy(key)`` puts every row of a key into one task.
Here each key is cut into time slices.  Rows are windowed inside a slice only,
and a small table with one row per (key, slice) carries what earlier slices
contribute.  That table grows with covered time, not with the rows of the key.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hawkframe.session import durable

US = 1_000_000
DEFAULT_SLICE_S = 120


def micros(df: DataFrame, name: str) -> Column:
    """Epoch microseconds of a timestamp column, with or without time zone."""
    if isinstance(df.schema[name].dataType, T.TimestampNTZType):
        return F.expr(
            f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', `{name}`)"
        )
    return F.unix_micros(F.col(name))


def slice_of(t: Column, length_us: int) -> Column:
    """Start of the time slice that holds `t`."""
    return t - F.pmod(t, F.lit(length_us))


def null_safe_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner"
) -> DataFrame:
    """Join on equal keys where NULL equals NULL; keeps the left key columns."""
    renamed = right.select(
        *[F.col(k).alias(f"__r_{k}") for k in keys],
        *[F.col(c) for c in right.columns if c not in keys],
    )
    cond = reduce(
        lambda a, b: a & b,
        [left[k].eqNullSafe(renamed[f"__r_{k}"]) for k in keys],
    )
    return left.join(renamed, cond, how).drop(*[f"__r_{k}" for k in keys])


def keyed(df: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """`df` with its keys as one struct `_k`, which is never null and in which null equals null.

    Windows, groups and joins by it share one shuffle; a null-safe join on the columns would need another.
    """
    return (df.withColumn("_k", F.struct(*keys)), ["_k"]) if keys else (df, [])


def sessionize(
    df: DataFrame,
    keys: Sequence[str],
    t: str,
    order_id: str,
    gap_us: int,
    slice_us: int | None = None,
    break_at_equal: bool = True,
) -> DataFrame:
    """Add `session_start` (micros) and `session_first_id` per inactivity session.

    A session ends when the next row of the key is `gap_us` or more later
    (strictly more when `break_at_equal` is false).  A slice is shorter than
    the gap, so no session can break inside one: the breaks follow from the
    first and last time of each slice.
    """
    slice_us = min(slice_us or DEFAULT_SLICE_S * US, gap_us)
    sliced, k = keyed(df.withColumn("_slice", slice_of(F.col(t), slice_us)), keys)
    bounds = sliced.groupBy(*k, "_slice").agg(
        F.min(F.struct(F.col(t).alias("t"), F.col(order_id).alias("id"))).alias("_first"),
        F.max(t).alias("_last"),
    )
    w = Window.partitionBy(*k).orderBy("_slice")
    idle = F.col("_first.t") - F.lag("_last").over(w)
    breaks = idle >= gap_us if break_at_equal else idle > gap_us
    marks = bounds.withColumn(
        "_head", F.when(idle.isNull() | breaks, F.col("_first"))
    ).select(
        *k,
        "_slice",
        F.last("_head", ignorenulls=True)
        .over(w.rowsBetween(Window.unboundedPreceding, 0))
        .alias("_head"),
    )
    out = sliced.join(marks, [*k, "_slice"])
    return out.select(
        *df.columns,
        F.col("_head.t").alias("session_start"),
        F.col("_head.id").alias("session_first_id"),
    )


def running_sums(
    df: DataFrame,
    keys: Sequence[str],
    slice_col: str,
    order: Sequence[str | Column],
    measures: dict[str, Column],
    inclusive: bool = False,
) -> DataFrame:
    """Add exact running sums per key in `order`, slice by slice.

    `slice_col` must be non-decreasing along `order`.  Sums exclude the row
    itself unless `inclusive`.
    """
    whole, k = keyed(df, keys)
    upto = 0 if inclusive else -1
    local = Window.partitionBy(*k, slice_col).orderBy(*order)
    local = local.rowsBetween(Window.unboundedPreceding, upto)
    before = Window.partitionBy(*k).orderBy(slice_col)
    before = before.rowsBetween(Window.unboundedPreceding, -1)

    totals = whole.groupBy(*k, slice_col).agg(
        *[F.sum(m).alias(f"_tot_{n}") for n, m in measures.items()]
    )
    offsets = totals.select(
        *k,
        slice_col,
        *[F.sum(f"_tot_{n}").over(before).alias(f"_off_{n}") for n in measures],
    )
    rows = whole.select("*", *[F.sum(m).over(local).alias(f"_loc_{n}") for n, m in measures.items()])
    joined = rows.join(offsets, [*k, slice_col])
    zero = F.lit(0)
    return joined.select(
        *df.columns,
        *[
            (F.coalesce(f"_loc_{n}", zero) + F.coalesce(f"_off_{n}", zero)).alias(n)
            for n in measures
        ],
    )


def next_after(
    df: DataFrame,
    keys: Sequence[str],
    t: str,
    value: Column,
    alias: str,
    slice_us: int = DEFAULT_SLICE_S * US,
) -> DataFrame:
    """Add the smallest `value` among rows of the key strictly later than the row.

    `value` must not decrease with time where it is set (a timestamp, or a
    struct that starts with one), so the smallest is also the earliest.  Frames
    run backwards in time: they only grow, so a row costs one step.
    """
    sliced, k = keyed(df.withColumn("_slice", slice_of(F.col(t), slice_us)).withColumn("_v", value), keys)
    local = (
        Window.partitionBy(*k, "_slice")
        .orderBy(F.col(t).desc())
        .rangeBetween(Window.unboundedPreceding, -1)
    )
    later = (
        Window.partitionBy(*k)
        .orderBy(F.desc("_slice"))
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    firsts = sliced.groupBy(*k, "_slice").agg(F.min("_v").alias("_m"))
    firsts = firsts.select(*k, "_slice", F.min("_m").over(later).alias("_later"))
    rows = sliced.withColumn("_here", F.min("_v").over(local))
    joined = rows.join(firsts, [*k, "_slice"])
    return joined.select(*df.columns, F.coalesce("_here", "_later").alias(alias))


def neighbour_times(
    df: DataFrame,
    keys: Sequence[str],
    t: str,
    order_id: str,
    slice_us: int = DEFAULT_SLICE_S * US,
) -> DataFrame:
    """Add `prev_t` and `next_t`: times of the adjacent rows of the key."""
    sliced, k = keyed(df.withColumn("_slice", slice_of(F.col(t), slice_us)), keys)
    local = Window.partitionBy(*k, "_slice").orderBy(t, order_id)
    bounds = sliced.groupBy(*k, "_slice").agg(
        F.min(t).alias("_first"), F.max(t).alias("_last")
    )
    w = Window.partitionBy(*k).orderBy("_slice")
    around = bounds.select(
        *k,
        "_slice",
        F.lag("_last").over(w).alias("_before"),
        F.lead("_first").over(w).alias("_after"),
    )
    rows = sliced.select(
        "*", F.lag(t).over(local).alias("_lag"), F.lead(t).over(local).alias("_lead")
    )
    joined = rows.join(around, [*k, "_slice"])
    return joined.select(
        *df.columns,
        F.coalesce("_lag", "_before").alias("prev_t"),
        F.coalesce("_lead", "_after").alias("next_t"),
    )


def fitted_slice(df: DataFrame, key: str, ts: str, rows: int = 50_000, longest_s: int = 86400) -> int:
    """Length in microseconds of slices in which the busiest hour of any key has about `rows` rows.

    Quiet keys then have few slices, and a hot key still has many. One number reaches the driver; it never moves a result.
    """
    hour = slice_of(micros(df, ts), 3600 * US)
    busiest = df.groupBy(key, hour.alias("_hour")).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("n")).first()["n"] or 1
    return max(DEFAULT_SLICE_S, min(longest_s, 3600 * rows // busiest)) * US


RANK_ROWS = 100_000


def ordered_slices(df: DataFrame, order: Column | str, rows: int = RANK_ROWS) -> DataFrame:
    """`df`, written once, with `_vs`: the number of its slice along `order`, of about `rows` rows each.

    Slices are the parts of a range partitioning, as many as the counted rows ask for; rows equal in `order` share one.
    """
    return number_slices(durable(df), order, rows)


def number_slices(written: DataFrame, order: Column | str, rows: int = RANK_ROWS) -> DataFrame:
    """`ordered_slices` of rows that are written already."""
    slices = -(-written.count() // rows)
    if slices <= 1:
        return written.withColumn("_vs", F.lit(0))
    return durable(written.repartitionByRange(slices, order).withColumn("_vs", F.spark_partition_id()))


def ordered_counts(
    df: DataFrame,
    value: str,
    by: Sequence[str] = (),
    weights: dict[str, Column] | None = None,
    descending: bool = False,
    rows: int = RANK_ROWS,
) -> DataFrame:
    """One row per (by, value) with counts and the counts of all earlier values.

    Gives ranks of a whole table without sorting it in one task: equal values
    are counted before the shuffle, then running sums go slice by slice.
    """
    weights = weights or {"n": F.lit(1)}
    counted = df.groupBy(*by, value).agg(
        *[F.sum(w).cast("bigint").alias(n) for n, w in weights.items()]
    )
    order = F.col(value).desc() if descending else F.col(value).asc()
    out = running_sums(
        ordered_slices(counted, order, rows), by, "_vs", [order], {f"{n}_before": F.col(n) for n in weights}
    )
    return out.drop("_vs")


def exact_quantiles(
    df: DataFrame,
    value: str,
    inclusive: dict[str, float] | None = None,
    by: Sequence[str] = (),
    exclusive: dict[str, float] | None = None,
    weight: str | None = None,
) -> DataFrame:
    """Exact quantiles with linear interpolation, any group size.

    `inclusive` takes position p*(n-1)+1, `exclusive` p*(n+1), as the standard
    library of Python names them.  The exclusive method interpolates from the
    two outer values when the position falls outside 1..n.  With `weight`, a
    row stands for that many equal rows.
    """
    clean = df.filter(F.col(value).isNotNull())
    one = F.col(weight) if weight else F.lit(1)
    ranks = ordered_counts(clean, value, by, {"n": one})
    sizes = clean.groupBy(*by).agg(F.sum(one).cast("bigint").alias("_n"))
    if by:
        joined = null_safe_join(ranks, sizes, list(by))
    else:
        joined = ranks.withColumn("_n", sizes.scalar())
    n = F.col("_n")
    position = {name: p * (n - 1) + 1 for name, p in (inclusive or {}).items()}
    position |= {name: p * (n + 1) for name, p in (exclusive or {}).items()}
    # The rank below the position, kept inside 1..n-1 so that a next one exists.
    lower = {
        name: F.greatest(F.lit(1), F.least(F.floor(pos), n - 1)) for name, pos in position.items()
    }

    def at(rank: Column) -> Column:
        hit = (F.col("n_before") < rank) & (rank <= F.col("n_before") + F.col("n"))
        return F.max(F.when(hit, F.col(value)))

    aggs = []
    for name, rank in lower.items():
        aggs += [at(rank).alias(f"_lo_{name}"), at(rank + 1).alias(f"_hi_{name}")]
    picked = joined.groupBy(*by).agg(F.max("_n").alias("_n"), *aggs)
    out = []
    for name, pos in position.items():
        low, high = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        step = (pos - lower[name]) * (high - low)
        out.append(F.when(n == 1, low).otherwise(low + step).cast("double").alias(name))
    return picked.select(*by, *out)


def lookup_join(
    big: DataFrame, table: DataFrame, keys: Sequence[str], how: str = "left"
) -> DataFrame:
    """Join a lookup table to a big one that may be skewed on the keys.

    A plain join: adaptive execution broadcasts the table if its measured bytes
    allow that, and splits the partitions of a hot key otherwise.
    """
    return big.join(table, list(keys), how)
