"""Scalar column functions on text, addresses, numbers and times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MD5_PATTERN = "^[a-fA-F0-9]{32}$"
SHA256_PATTERN = "^[a-fA-F0-9]{64}$"


def entropy(text: Column) -> Column:
    """Shannon entropy in bits over the characters of the whole text.

    Characters are sorted, then one pass adds c*log2(c) per run of c equal
    ones: H = log2(n) - sum(c*log2(c)) / n.
    """
    n = F.length(text)
    run_term = lambda run: F.when(run > 0, run * F.log2(run)).otherwise(0.0)
    start = F.struct(
        F.lit(None).cast("string").alias("ch"),
        F.lit(0.0).alias("run"),
        F.lit(0.0).alias("acc"),
    )

    def step(s: Column, ch: Column) -> Column:
        same = s["ch"].eqNullSafe(ch)
        return F.struct(
            ch.alias("ch"),
            F.when(same, s["run"] + 1.0).otherwise(1.0).alias("run"),
            F.when(same, s["acc"]).otherwise(s["acc"] + run_term(s["run"])).alias("acc"),
        )

    total = F.aggregate(
        F.array_sort(F.split(text, "")), start, step, lambda s: s["acc"] + run_term(s["run"])
    )
    return F.when(n > 0, F.greatest(F.log2(n) - total / n, F.lit(0.0))).otherwise(0.0)


def entropy_table(df: DataFrame, id_col: str, text: str, alias: str = "entropy") -> DataFrame:
    """Entropy of whole long texts, one row per unique id.

    Characters are counted in the task that reads the text; only one row per
    id and distinct character is shuffled.
    """
    counts = (
        df.select(id_col, F.explode(F.split(text, "")).alias("ch"))
        .filter("ch <> ''")
        .groupBy(id_col, "ch")
        .agg(F.count(F.lit(1)).alias("c"))
    )
    n = F.sum("c")
    sums = counts.groupBy(id_col).agg(
        F.greatest(F.log2(n) - F.sum(F.col("c") * F.log2("c")) / n, F.lit(0.0)).alias("_h")
    )
    # Texts without a character have no counts.
    return df.select(id_col).join(sums, id_col, "left").select(id_col, F.coalesce("_h", F.lit(0.0)).alias(alias))


def is_valid_ipv4(ip: Column) -> Column:
    """Four decimal parts in 0..255; leading zeros are accepted."""
    parts = F.split(ip, "\\.")
    in_range = F.forall(
        parts,
        lambda p: F.coalesce(
            p.rlike("^[0-9]+$") & (F.expr("0") <= p.try_cast("bigint")) & (p.try_cast("bigint") <= 255),
            F.lit(False),
        ),
    )
    return F.coalesce((F.size(parts) == 4) & in_range, F.lit(False))


def sanitize_ip(ip: Column) -> Column:
    trimmed = F.trim(ip)
    return F.when(is_valid_ipv4(trimmed), trimmed)


def ipv4_to_long(ip: Column) -> Column:
    parts = F.split(ip, "\\.")
    return sum(
        (F.get(parts, F.lit(i)).try_cast("bigint") * (256 ** (3 - i)) for i in range(4)),
        F.lit(0).cast("bigint"),
    )


def safe_divide(num: Column, den: Column, default: float = 0.0) -> Column:
    return F.when(den == 0, F.lit(default)).otherwise(
        num.cast("double") / F.nullif(den.cast("double"), F.lit(0.0))
    )


def percentage(value: Column, total: Column, decimals: int = 2) -> Column:
    """100*value/total, 0 when the total is 0.

    Spark rounds the decimal form half-up; Python rounds the binary value, so
    exact half cases may differ in the last digit.
    """
    return F.round(safe_divide(value, total) * 100, decimals)


def truncate(text: Column, max_length: int = 100, suffix: str = "...") -> Column:
    keep = max(max_length - len(suffix), 0)
    cut = F.concat(F.substring(text, 1, keep), F.lit(suffix))
    return F.when(F.length(text) <= max_length, text).otherwise(cut)


def epoch_to_timestamp(seconds: Column) -> Column:
    return F.timestamp_micros((seconds * 1_000_000).cast("bigint"))


def timestamp_to_epoch(ts: Column) -> Column:
    return F.unix_micros(ts) / 1_000_000.0


def mask_email(text: Column) -> Column:
    return F.regexp_replace(text, "[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+", "[email]")


def token(value: Column) -> Column:
    """Stable stand-in for a personal value."""
    return F.sha2(value, 256)
