"""Deterministic splits, batches and time cuts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hawkframe.operators.sliced import RANK_ROWS, lookup_join, ordered_slices, running_sums


def stratified_split(
    df: DataFrame, id_col: str, label: str, train: int = 70, validation: int = 15, seed: str = "", rows: int = RANK_ROWS
) -> DataFrame:
    """Add `split` with exact shares per label, from a hash of the id.

    The hash orders each class at random, and the order is cut into slices of
    a bounded number of rows, so a large class is ranked in parallel.
    """
    h = F.md5(F.concat(F.lit(seed), F.col(id_col).cast("string")).cast("binary"))
    hashed = ordered_slices(df.withColumn("_h", h), "_h", rows)
    ranked = running_sums(hashed, [label], "_vs", ["_h", id_col], {"_rank": F.lit(1)})
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("_size"))
    sized = lookup_join(ranked, sizes, [label])
    at = F.col("_rank") * 100
    split = (
        F.when(at < train * F.col("_size"), "train")
        .when(at < (train + validation) * F.col("_size"), "validation")
        .otherwise("test")
    )
    return sized.select(*df.columns, split.alias("split"))


def row_numbers(df: DataFrame, order: str, alias: str = "row_no", rows: int = RANK_ROWS) -> DataFrame:
    """0-based position in the order of a unique column, without a global sort task."""
    return running_sums(ordered_slices(df, order, rows), [], "_vs", [order], {alias: F.lit(1)}).drop("_vs")


def batch_ids(df: DataFrame, order: str, size: int) -> DataFrame:
    numbered = row_numbers(df, order)
    return numbered.withColumn("batch_id", F.expr(f"row_no div {size}")).drop("row_no")


def keep_days(df: DataFrame, ts: str, days: int, as_of: Column | None = None) -> DataFrame:
    """Rows of the last `days` before `as_of`, by default the newest row."""
    end = df.agg(F.max(ts)).scalar() if as_of is None else as_of
    return df.filter(F.col(ts) >= end - F.expr(f"INTERVAL {days} DAYS"))
