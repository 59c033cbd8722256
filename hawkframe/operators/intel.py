"""Joins with threat intelligence, address ranges and technique tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hawkframe.functions.text import ipv4_to_long
from hawkframe.operators.sliced import lookup_join, null_safe_join


def latest_intel(intel: DataFrame) -> DataFrame:
    """Newest row per indicator; ties go to the larger row."""
    keys = ["ioc_type", "ioc_value"]
    rest = [c for c in intel.columns if c not in (*keys, "timestamp")]
    row = F.struct("timestamp", *rest)
    best = intel.groupBy(*keys).agg(F.max(row).alias("_r"))
    return best.select(*keys, F.col("_r.timestamp").alias("timestamp"), *[f"_r.{c}" for c in rest])


def add_reputation(events: DataFrame, reputation: DataFrame) -> DataFrame:
    """Score of the destination in -100..100, 0 when unknown."""
    table = reputation.select("destination_ip", F.col("score").alias("_score"))
    out = lookup_join(events, table, ["destination_ip"])
    score = F.greatest(F.lit(-100), F.least(F.lit(100), F.coalesce("_score", F.lit(0))))
    return out.select(*events.columns, score.cast("int").alias("ip_reputation_score"))


def add_ioc_flag(events: DataFrame, ioc_ips: DataFrame) -> DataFrame:
    table = ioc_ips.select("destination_ip").distinct().withColumn("_hit", F.lit(1))
    out = lookup_join(events, table, ["destination_ip"])
    return out.select(*events.columns, F.coalesce("_hit", F.lit(0)).alias("ioc_matches"))


def matching_events(events: DataFrame, ioc_ips: DataFrame) -> DataFrame:
    keys = ioc_ips.select("destination_ip").distinct()
    return lookup_join(events, keys, ["destination_ip"], "left_semi")


def events_without(events: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """Events whose key is not in the known table."""
    return lookup_join(events, known.select(*keys).distinct(), keys, "left_anti")


def ioc_match_counts(
    events: DataFrame, indicators: dict[str, str], intel: DataFrame, id_col: str = "event_id"
) -> DataFrame:
    """Number of indicator hits of each event over several indicator types: `id_col` and `ioc_matches`, a row per event row.

    `indicators` maps an indicator type to the event column that holds it. Each type is a lookup of its own, so events
    are neither multiplied nor shuffled by id; indicators that fit are broadcast by adaptive execution.
    """
    out = events.select(id_col, *[F.col(c).cast("string").alias(f"_value{i}") for i, c in enumerate(indicators.values())])
    for i, kind in enumerate(indicators):
        known = intel.where(F.col("ioc_type") == kind).select(F.col("ioc_value").alias(f"_value{i}")).distinct()
        out = lookup_join(out, known.withColumn(f"_hit{i}", F.lit(1)), [f"_value{i}"])
    hits = sum(F.coalesce(F.col(f"_hit{i}"), F.lit(0)) for i in range(len(indicators)))
    return out.select(id_col, hits.cast("bigint").alias("ioc_matches"))


def with_country(
    events: DataFrame, ranges: DataFrame, ip: str = "source_ip", alias: str = "country"
) -> DataFrame:
    """Country of an address from non-overlapping (start_ip, end_ip, country) ranges, null where none holds it.

    Each /16 block has one row with its ranges as sorted arrays (at most 65,536 of them); an event meets that row
    once and is searched in it by halving, so no event or address is shuffled twice or joined back.
    """
    blocks = ranges.select(
        F.col("start_ip").alias("lo"),
        F.col("end_ip").alias("hi"),
        F.col("country").alias("name"),
        F.explode(F.sequence(F.shiftright("start_ip", 16), F.shiftright("end_ip", 16))).alias("_block"),
    )
    blocks = blocks.groupBy("_block").agg(F.array_sort(F.collect_list(F.struct("lo", "hi", "name"))).alias("_ranges"))
    number = ipv4_to_long(F.col(ip))
    found = lookup_join(events.withColumn("_n", number).withColumn("_block", F.shiftright("_n", 16)), blocks, ["_block"])
    # Seventeen halvings tell the last of up to 65,536 ranges that starts at or before the address.
    def halve(state, _):
        middle = (state["a"] + state["b"]).cast("int") / 2
        middle = F.floor(middle).cast("int")
        right = state["r"][middle]["lo"] <= state["n"]
        return F.struct(F.when(right, middle).otherwise(state["a"]).alias("a"), F.when(right, state["b"]).otherwise(middle).alias("b"), state["r"].alias("r"), state["n"].alias("n"))

    start = F.struct(F.lit(0).alias("a"), F.size("_ranges").alias("b"), F.col("_ranges").alias("r"), F.col("_n").alias("n"))
    last = F.aggregate(F.sequence(F.lit(1), F.lit(17)), start, halve, lambda s: s["r"][s["a"]])
    hit = F.when(F.col("_ranges").isNotNull(), last)
    return found.withColumn("_hit", hit).select(*events.columns, F.when((F.col("_n") >= F.col("_hit.lo")) & (F.col("_n") <= F.col("_hit.hi")), F.col("_hit.name")).alias(alias))


def add_country(
    events: DataFrame, ranges: DataFrame, ip: str = "source_ip", alias: str = "country"
) -> DataFrame:
    return with_country(events, ranges, ip, alias)


def add_tactics(events: DataFrame, techniques: str, tactics: DataFrame) -> DataFrame:
    """One row per event and technique with the tactic of the kill chain."""
    exploded = events.withColumn("technique", F.explode(techniques))
    return lookup_join(exploded, tactics, ["technique"])


def peer_scores(events: DataFrame, assets: DataFrame, key: str = "source_ip") -> DataFrame:
    """Connection count of each source and its z-score inside its asset group."""
    from hawkframe.operators.state import peer_zscore

    counts = events.groupBy(key).agg(F.count(F.lit(1)).alias("conn_total"))
    grouped = null_safe_join(counts, assets.select(key, "asset_group"), [key])
    return peer_zscore(grouped, "asset_group", "conn_total")
