"""Volume, latency, drift and quality reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hawkframe.operators.sliced import exact_quantiles, null_safe_join

# Fixed bucket bounds of the latency histogram, in seconds.
LATENCY_BUCKETS = [0.01, 0.05, 0.1, 0.5, 1.0, float("inf")]


def count_by(df: DataFrame, *labels: str) -> DataFrame:
    return df.groupBy(*labels).agg(F.count(F.lit(1)).alias("n"))


def latency_histogram(
    df: DataFrame, latency: str, by: Sequence[str] = (), buckets: Sequence[float] = LATENCY_BUCKETS
) -> DataFrame:
    """Cumulative bucket counts with the total sum and count, one row per bucket."""
    counted = df.groupBy(*by).agg(
        F.sum(latency).alias("sum"),
        F.count(latency).alias("count"),
        *[F.count_if(F.col(latency) <= b).alias(f"_b{i}") for i, b in enumerate(buckets)],
    )
    rows = F.array(
        *[
            F.struct(F.lit(float(b)).alias("le"), F.col(f"_b{i}").alias("cumulative"))
            for i, b in enumerate(buckets)
        ]
    )
    return counted.select(*by, F.inline(rows), "sum", "count")


def histogram_quantile(
    hist: DataFrame, q: float, by: Sequence[str] = (), alias: str = "value"
) -> DataFrame:
    """Quantile from cumulative buckets, linear inside a bucket.

    In the open last bucket the answer is the highest finite bound.
    """
    w = Window.partitionBy(*by).orderBy("le")
    total = F.max("cumulative").over(Window.partitionBy(*by))
    steps = hist.select(
        *by,
        "le",
        "cumulative",
        F.lag("le", 1, 0.0).over(w).alias("_low"),
        F.lag("cumulative", 1, 0).over(w).alias("_below"),
        (total * q).alias("_rank"),
    )
    hit = steps.filter((F.col("_below") < F.col("_rank")) & (F.col("_rank") <= F.col("cumulative")))
    share = (F.col("_rank") - F.col("_below")) / (F.col("cumulative") - F.col("_below"))
    inside = F.col("_low") + (F.col("le") - F.col("_low")) * share
    value = F.when(F.col("le") == float("inf"), F.col("_low")).otherwise(inside)
    return hit.select(*by, value.alias(alias))


def latency_summary(df: DataFrame, latency: str, by: Sequence[str] = ()) -> DataFrame:
    """Mean, median, exclusive p50/p95/p99, min, max and sample deviation."""
    basic = df.groupBy(*by).agg(
        F.count(latency).alias("n"),
        F.avg(latency).alias("mean"),
        F.min(latency).alias("min"),
        F.max(latency).alias("max"),
        F.coalesce(F.stddev_samp(latency), F.lit(0.0)).alias("stdev"),
    )
    ranks = exact_quantiles(
        df, latency, {"median": 0.5}, by, exclusive={"p50": 0.5, "p95": 0.95, "p99": 0.99}
    )
    if by:
        return null_safe_join(basic, ranks, list(by))
    # Two one-row results side by side.
    sides = [d.withColumn("_one", F.lit(1)) for d in (basic, ranks)]
    return sides[0].join(sides[1], "_one").drop("_one")


def throughput(df: DataFrame, ok: Column, elapsed_s: Column, by: Sequence[str] = ()) -> DataFrame:
    """Rows per second and success percentage, 0 where undefined."""
    grouped = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(ok).alias("successful"), elapsed_s.alias("elapsed_s")
    )
    rate = F.when(F.col("elapsed_s") > 0, F.col("total") / F.col("elapsed_s")).otherwise(0.0)
    success = F.when(F.col("total") > 0, 100.0 * F.col("successful") / F.col("total")).otherwise(0.0)
    return grouped.select("*", rate.alias("per_second"), success.alias("success_rate"))


def mttr_daily(
    alerts: DataFrame,
    created: str,
    closed: str,
    wanted: Column,
    days: int | None = 30,
    below_minutes: float | None = 10,
) -> DataFrame:
    """Mean minutes to close per creation day, over the last `days` of the table."""
    if days is not None:
        newest = alerts.agg(F.max(created)).scalar()
        alerts = alerts.filter(F.col(created) >= newest - F.expr(f"INTERVAL {days} DAYS"))
    seconds = F.expr(f"timestampdiff(SECOND, `{created}`, `{closed}`)")
    daily = (
        alerts.filter(wanted)
        .groupBy(F.to_date(created).alias("date"))
        .agg((F.avg(seconds) / 60).alias("mttr_minutes"), F.count(F.lit(1)).alias("n"))
    )
    return daily if below_minutes is None else daily.filter(F.col("mttr_minutes") < below_minutes)


def null_rates(df: DataFrame, minimum: float = 0.95) -> DataFrame:
    """Null share of every column in one pass, with a completeness flag."""
    rates = df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in df.columns])
    return rates.unpivot([], df.columns, "column_name", "null_rate").withColumn(
        "complete", (1 - F.col("null_rate")) >= minimum
    )


def kl_drift(
    current: DataFrame,
    baseline: DataFrame,
    column: str,
    bins: int = 20,
    threshold: float = 0.1,
    smoothing: float = 0.0,
) -> DataFrame:
    """Divergence of the current distribution from the baseline over shared bins.

    Natural log; +Infinity when the baseline has an empty bin that the current
    data uses, unless `smoothing` is added to every bin.
    """
    both = current.select(F.col(column).alias("x"), F.lit(1).alias("c")).unionByName(
        baseline.select(F.col(column).alias("x"), F.lit(0).alias("c"))
    )
    both = both.filter("x is not null")
    bounds = both.agg(F.struct(F.min("x").alias("lo"), F.max("x").alias("hi")).alias("b")).scalar()
    width = (F.col("_b.hi") - F.col("_b.lo")) / bins
    bin_no = F.when(width > 0, F.least(F.floor((F.col("x") - F.col("_b.lo")) / width), F.lit(bins - 1))).otherwise(0)
    binned = both.withColumn("_b", bounds).groupBy(bin_no.alias("bin")).agg(
        (F.sum("c") + smoothing).cast("double").alias("cur"),
        (F.sum(1 - F.col("c")) + smoothing).cast("double").alias("base"),
    )
    # sum p*ln(p/q) = sum(cur*ln(cur/base))/C + ln(B/C)
    part = (
        F.when(F.col("cur") == 0, 0.0)
        .when(F.col("base") == 0, F.lit(float("inf")))
        .otherwise(F.col("cur") * F.log(F.col("cur") / F.nullif(F.col("base"), F.lit(0.0))))
    )
    missing = smoothing * (F.lit(bins) - F.count(F.lit(1)))
    c, b = F.sum("cur") + missing, F.sum("base") + missing
    kl = F.sum(part) / c + F.log(b / c)
    return binned.agg(kl.alias("kl")).withColumn("drift", F.col("kl") > threshold)


def volume_spikes(
    counts: DataFrame, offset_s: int = 3600, factor: float = 2.0, by: Sequence[str] = (), seconds: int = 300
) -> DataFrame:
    """Windows whose count exceeds `factor` times the count `offset_s` earlier.

    `counts` holds one row per window of `seconds`: `window_start` and `n`. Windows without a row inside a label's span
    count 0, and anything after silence is +Infinity times as much; before its first window a label has no count.
    """
    filled = fill_grid(counts.select(*by, "window_start", "n"), seconds, by)
    earlier = filled.select(
        *by,
        (F.col("window_start") + F.expr(f"INTERVAL {offset_s} SECONDS")).alias("window_start"),
        F.col("n").alias("n_before"),
    )
    both = null_safe_join(filled.filter("n > 0"), earlier, [*by, "window_start"])
    ratio = F.when(F.col("n_before") == 0, float("inf")).otherwise(F.col("n") / F.nullif(F.col("n_before"), F.lit(0)))
    return both.withColumn("ratio", ratio).filter(F.col("ratio") > factor)


def _window_us(name: str = "window_start") -> Column:
    return F.expr(f"timestampdiff(SECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', cast({name} as timestamp_ntz))")


def trailing_average(
    series: DataFrame, value: str, seconds: int, by: Sequence[str] = (), alias: str = "trailing_avg"
) -> DataFrame:
    """Average of a windowed series over the last `seconds`, the row included.

    The series has one row per label and window, so a partition grows with
    time only.
    """
    w = (
        Window.partitionBy(*by)
        .orderBy("_s")
        .rangeBetween(-(seconds - 1), Window.currentRow)
    )
    return (
        series.withColumn("_s", _window_us()).withColumn(alias, F.avg(value).over(w)).drop("_s")
    )


def unusual_rates(
    series: DataFrame, by: Sequence[str], factor: float = 3.0, seconds: int = 3600, step_s: int = 300
) -> DataFrame:
    """Windows of `step_s` whose rate exceeds `factor` times the average over the last `seconds`, silent windows included.

    `series` has a row per label and window with `n` and `rate`; windows without one inside the label's span have rate 0.
    """
    filled = fill_grid(series.select(*by, "window_start", "n", "rate"), step_s, by).withColumn("rate", F.coalesce("rate", F.lit(0.0)))
    out = trailing_average(filled, "rate", seconds, by)
    return out.filter(F.col("rate") > factor * F.col("trailing_avg"))


def metric_drift(
    series: DataFrame, value: str, offset_s: int, threshold: float, by: Sequence[str] = ()
) -> DataFrame:
    """Grid points whose metric moved more than `threshold` since `offset_s` earlier."""
    earlier = series.select(
        *by,
        (F.col("window_start") + F.expr(f"INTERVAL {offset_s} SECONDS")).alias("window_start"),
        F.col(value).alias("before"),
    )
    both = series.join(earlier, [*by, "window_start"])
    return both.withColumn("change", F.abs(F.col(value) - F.col("before"))).filter(
        F.col("change") > threshold
    )


def fill_grid(counts: DataFrame, seconds: int, by: Sequence[str] = ()) -> DataFrame:
    """All windows between the first and the last of each label; missing ones have `n` 0 and else nulls."""
    span = counts.groupBy(*by).agg(F.min("window_start").alias("lo"), F.max("window_start").alias("hi")).filter("lo is not null")
    grid = span.select(
        *by, F.explode(F.expr(f"sequence(lo, hi, INTERVAL {seconds} SECONDS)")).alias("window_start")
    )
    filled = null_safe_join(grid, counts, [*by, "window_start"], "left")
    return filled.withColumn("n", F.coalesce("n", F.lit(0)).cast("bigint")).select(*counts.columns)


def low_volume(counts: DataFrame, seconds: int, floor_per_s: float) -> DataFrame:
    filled = fill_grid(counts, seconds)
    return filled.withColumn("rate", F.col("n") / float(seconds)).filter(F.col("rate") < floor_per_s)


def sustained(
    series: DataFrame, condition: Column, seconds: int, by: Sequence[str] = ()
) -> DataFrame:
    """Grid points where the condition has held without a break for `seconds`."""
    w = Window.partitionBy(*by).orderBy("_s")
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marked = series.withColumn("_s", _window_us()).withColumn("_ok", F.coalesce(condition, F.lit(False)))
    begins = F.when(F.col("_ok") & ~F.coalesce(F.lag("_ok").over(w), F.lit(False)), F.col("_s"))
    since = marked.withColumn("_begin", begins).withColumn(
        "active_s", F.col("_s") - F.last("_begin", ignorenulls=True).over(upto)
    )
    return since.filter(F.col("_ok") & (F.col("active_s") >= seconds)).drop("_s", "_ok", "_begin")
