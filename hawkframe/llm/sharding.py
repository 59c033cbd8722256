"""Reproducible shuffle into shards: a Feistel permutation of global row numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hawkframe.llm.common import copies, running_sum
from hawkframe.llm.permute import permuted, quotient


def shard_rows(df: DataFrame, shards: int, seed: int = 17) -> DataFrame:
    """Every row of `df` with `row_number`, `shard` and `slot` (long, int, long).

    Rows are numbered from 0 in the order of all their columns (nulls first), the number is permuted,
    and the permuted number p gives shard p mod `shards` and slot p div `shards`. Shard sizes differ by
    one row at most, slots have no gaps, and anyone can compute a row's place from its number.

    Rows equal in all columns are one group with consecutive numbers, so repeated rows never gather in
    one task. An empty table gives no rows. All columns must be orderable (no maps). Nulls are values.
    Columns named like the new ones, or starting with an underscore, are refused.
    """
    taken = {"row_number", "shard", "slot"} & set(df.columns) | {c for c in df.columns if c.startswith("_")}
    if taken:
        raise ValueError(f"rename columns {sorted(taken)}")
    groups = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_n"))
    numbered = running_sum(groups, df.columns, "_n", "_first")
    total = numbered.agg(F.sum("_n")).first()[0] or 0
    rows = copies(numbered, "_n", "_i").withColumn("row_number", F.col("_first") + F.col("_i"))
    place = permuted(F.col("row_number"), F.lit(total).cast("long"), F.lit(seed).cast("long"))
    rows = rows.withColumn("_p", place)
    return rows.select(
        *df.columns,
        "row_number",
        (F.col("_p") % shards).cast("int").alias("shard"),
        quotient(F.col("_p"), F.lit(shards).cast("long")).alias("slot"),
    )


def shard_documents(docs: DataFrame, shards: int = 40, seed: int = 17) -> DataFrame:
    """Digest of the shuffle of documents: ids, sizes and checksums in, texts stay where they are."""
    text = F.col("text").cast("binary")
    digest = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"),
        F.coalesce(F.crc32(text), F.lit(0)).cast("long").alias("text_crc32"),
    )
    return shard_rows(digest, shards, seed).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
