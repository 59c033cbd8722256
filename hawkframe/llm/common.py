"""Helpers shared by the operators of this package."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hawkframe.session import durable, ensure_checkpoint_dir  # noqa: F401  (used by the operators)

WORD = r"[^\x20\x09-\x0D]+"
# Rows of one ordered slice; slices are as many as the table needs.
SLICE_ROWS = 100_000
COPY_CHUNK = 65_536


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_partitions(df: DataFrame, parts: int | None = None) -> int:
    """Partitions for a shuffle of whole texts: the session's setting unless given."""
    return parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def fold_of(doc_id: str | Column, folds: int = 5) -> Column:
    """crc32 of the id written as text, modulo `folds`; a null id counts as the empty text."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % folds


def running_sum(df: DataFrame, order: list[str], weight: str, out: str, by: list[str] | None = None) -> DataFrame:
    """Add `out`: the sum of `weight` over the rows that come earlier in `order`, within `by`.

    Rows are cut into contiguous slices of the order by range partitioning, written once, summed per
    slice, and numbered inside their slice. No task sees more than a slice, however large a group of
    `by` is. Rows equal in all of `order` must not occur (group them first).
    """
    by = by or []
    keys = [*by, *order]
    rows = df.count()
    slices = max(1, math.ceil(rows / SLICE_ROWS))
    cut = durable(df.repartitionByRange(slices, *[F.col(c).asc_nulls_first() for c in keys]).withColumn("_slice", F.spark_partition_id()))
    sums = cut.groupBy(*by, "_slice").agg(F.sum(weight).alias("_w"))
    earlier = Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(by)], F.col("_slice").alias("_s"), F.coalesce(F.sum("_w").over(earlier), F.lit(0)).alias("_base"))
    within = Window.partitionBy("_slice", *by).orderBy(*[F.col(c).asc_nulls_first() for c in order]).rowsBetween(Window.unboundedPreceding, -1)
    same = F.col("_slice") == F.col("_s")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_k{i}"))
    numbered = cut.withColumn("_in", F.coalesce(F.sum(weight).over(within), F.lit(0)))
    return numbered.join(sums, same).withColumn(out, F.col("_base") + F.col("_in")).select(*df.columns, out)


def copies(df: DataFrame, count: str, out: str) -> DataFrame:
    """Each row `count` times, numbered 0.. in `out`; very long runs are cut into chunks that tasks share."""
    few = df.where(F.col(count) <= COPY_CHUNK).withColumn(out, F.explode(F.sequence(F.lit(0).cast("long"), F.col(count) - 1)))
    many = df.where(F.col(count) > COPY_CHUNK)
    many = many.withColumn("_from", F.explode(F.sequence(F.lit(0).cast("long"), F.col(count) - 1, F.lit(COPY_CHUNK).cast("long"))))
    many = many.repartition(F.col("_from"), *[F.col(c) for c in df.columns])
    many = many.withColumn(out, F.explode(F.sequence(F.col("_from"), F.least(F.col("_from") + COPY_CHUNK, F.col(count)) - 1)))
    return few.unionByName(many.select(*few.columns))


def map_batches(df: DataFrame, fn, schema: str) -> DataFrame:
    """Apply `fn` to each Arrow batch as lists by column name; it returns lists by column of `schema`, or yields several such."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType, _parse_datatype_string

    target = _parse_datatype_string(schema)
    assert isinstance(target, StructType)
    arrow = to_arrow_schema(target)

    def run(batches):
        for batch in batches:
            made = fn({name: batch.column(i).to_pylist() for i, name in enumerate(batch.schema.names)})
            for part in [made] if isinstance(made, dict) else made:
                yield pa.RecordBatch.from_arrays([pa.array(part[f.name], type=f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, target)


def lowered(text: str | None) -> bytes:
    """UTF-8 bytes with A-Z in lower case and nothing else changed; null is empty."""
    return (text or "").encode("utf-8", "surrogatepass").lower()
