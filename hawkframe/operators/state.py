"""Per-source behaviour features from keyed, time-expiring history.

Event order is (time, event id).  A feature sees what arrived before the
event; window bounds are inclusive at both ends.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hawkframe.operators.sliced import (
    DEFAULT_SLICE_S,
    US,
    micros,
    neighbour_times,
    null_safe_join,
    running_sums,
    sessionize,
    slice_of,
)
from hawkframe.schemas import PORT_TTL, SESSION_TTL

SLICE_US = DEFAULT_SLICE_S * US


def latest_per_event(df: DataFrame, key: str = "source_ip", ts: str = "timestamp") -> DataFrame:
    """A repeated event id of a source counts once, with its latest time; of rows of one time one by their content."""
    others = [c for c in df.columns if c not in (key, "event_id")]
    row = F.struct(ts, *[c for c in others if c != ts])
    best = df.groupBy(key, "event_id").agg(F.max_by(row, F.struct(ts, F.xxhash64(*others))).alias("_row"))
    return best.select(
        *[F.col(c) if c in (key, "event_id") else F.col(f"_row.{c}").alias(c) for c in df.columns]
    )


# Order of sweep rows at one moment: events by id; for one event, first the
# values it brings into its own view, then the event itself.  What leaves a
# window follows all events of that moment.
_ENTER, _EVENT, _LEAVE = 0, 1, 2


def conn_counts(
    df: DataFrame,
    windows: Mapping[str, int],
    key: str = "source_ip",
    ts: str = "timestamp",
    slice_us: int = SLICE_US,
) -> DataFrame:
    """Earlier events of the source within each window: `conn_count_<name>`."""
    return trailing(df, windows, key=key, ts=ts, slice_us=slice_us)


def trailing(
    df: DataFrame,
    windows: Mapping[str, float],
    distinct: Mapping[str, Sequence[str]] | None = None,
    stats: Mapping[str, str] | None = None,
    columns: Mapping[str, str] | None = None,
    novel: Mapping[str, tuple[str, int]] | None = None,
    counts: bool = True,
    key: str = "source_ip",
    ts: str = "timestamp",
    slice_us: int = SLICE_US,
) -> DataFrame:
    """Counts, exact distinct counts and moments over trailing windows, in one sweep.

    An event adds its values when it arrives and takes them back right after
    `t + window`, so a running sum is the content of the window.

    * `conn_count_<w>`: earlier events, the event itself excluded.
    * `distinct` maps an output prefix to the windows wanted, `columns` the
      prefix to its column: `<prefix>_<w>` counts values including the event.
      A value enters when its previous use has left the window and leaves when
      no next use comes in time, so the sweep needs no sets.
    * `novel` maps an output to a column and seconds: true when the source did not use the value in these seconds before;
      false for no value.
    * `stats` maps a whole-number column to a window: `<column>_mean` and
      `<column>_stddev` (sample, 0 for one event) including the event.

    Each row goes through the sweep as it is and comes out once, so repeated event ids are rows of their own.
    """
    distinct, stats, columns, novel = distinct or {}, stats or {}, columns or {}, novel or {}
    span = {w: round(s * US) for w, s in windows.items()}
    t = F.col("_t")
    base = df.select(
        F.col(key).alias("_key"), "event_id", micros(df, ts).alias("_t"), *{*columns.values(), *stats, *(c for c, _ in novel.values())}, F.struct(*df.columns).alias("_row")
    )
    moments = {
        c: {
            f"_n_{c}": F.lit(1),
            f"_s1_{c}": F.col(c).cast("decimal(38,0)"),
            f"_s2_{c}": F.col(c).cast("decimal(19,0)") * F.col(c).cast("decimal(19,0)"),
        }
        for c in stats
    }
    moves = F.array(
        F.struct(t.alias("at"), F.lit(0).alias("tie"), F.lit(_EVENT).alias("cls"), F.lit("").alias("win")),
        *[
            F.struct(
                (t + span[w]).alias("at"),
                F.lit(1).alias("tie"),
                F.lit(_LEAVE).alias("cls"),
                F.lit(w).alias("win"),
            )
            for w in windows
            if counts or w in stats.values()
        ],
    )
    arrives = F.col("_e.cls") == _EVENT
    deltas = {}
    if counts:
        for w in windows:
            deltas[f"conn_count_{w}"] = F.when(arrives, 1).when(F.col("_e.win") == w, -1)
    for c, w in stats.items():
        for n, d in moments[c].items():
            deltas[n] = F.when(arrives, d).when(F.col("_e.win") == w, -d)
    place = [
        "_key",
        "event_id",
        F.col("_e.at").alias("_at"),
        F.col("_e.tie").alias("_tie"),
        F.col("_e.cls").alias("_cls"),
    ]
    steps = base.select("*", F.explode(moves).alias("_e")).select(
        *place, F.when(arrives, F.col("_row")).alias("_row"), *[d.alias(n) for n, d in deltas.items()]
    )
    # All uses of all columns are one table, so that their neighbours in time cost one shuffle.
    used = {columns[p]: None for p in distinct} | {c: None for c, _ in novel.values()}
    if used:
        values = [F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in used]
        melted = base.select("_key", "event_id", "_t", F.explode(F.array(*values)).alias("_u")).select("_key", "event_id", "_t", "_u.*")
        uses = neighbour_times(melted, ["_key", "column", "value"], "_t", "event_id", slice_us)
        since = t - F.col("prev_t")
        enters = [
            F.when((F.col("column") == columns[p]) & (F.col("prev_t").isNull() | (since > span[w])), 1).alias(f"{p}_{w}")
            for p, wanted in distinct.items()
            for w in wanted
        ]
        first_use = {
            n: F.when((F.col("column") == c) & F.col("value").isNotNull() & (F.col("prev_t").isNull() | (since > s * US)), 1)
            for n, (c, s) in novel.items()
        }
        names = [f"{p}_{w}" for p, wanted in distinct.items() for w in wanted]
        nothing = {n: F.lit(None).cast("int").alias(n) for n in [*names, *novel]}
        at = lambda moment, tie, cls: [moment.alias("at"), F.lit(tie).alias("tie"), F.lit(cls).alias("cls")]
        moves = [F.struct(*at(t, 0, _ENTER), *enters, *[f.alias(n) for n, f in first_use.items()])]
        if novel:
            # A first use counts for its own event only: it is taken back right behind it.
            again = [(-f).alias(n) for n, f in first_use.items()]
            some = F.coalesce(*first_use.values()).isNotNull()
            moves.append(F.when(some, F.struct(*at(t, 0, _LEAVE), *[nothing[n] for n in names], *again)))
        for p, wanted in distinct.items():
            for w in wanted:
                left = (F.col("column") == columns[p]) & (F.col("next_t").isNull() | (F.col("next_t") - t > span[w]))
                minus = [F.lit(-1).alias(n) if n == f"{p}_{w}" else nothing[n] for n in [*names, *novel]]
                moves.append(F.when(left, F.struct(*at(t + span[w], 1, _LEAVE), *minus)))
        edges = uses.select("_key", "event_id", F.explode(F.array(*moves)).alias("_e")).filter("_e is not null")
        edges = edges.select(*place, *[F.col(f"_e.{n}").alias(n) for n in [*names, *novel]])
        steps = steps.unionByName(edges, allowMissingColumns=True)
    totals = [c for c in steps.columns if c not in ("_key", "event_id", "_at", "_tie", "_cls", "_row")]
    steps = steps.withColumn("_slice", slice_of(F.col("_at"), slice_us))
    swept = running_sums(
        steps.withColumnsRenamed({c: f"_d_{c}" for c in totals}),
        ["_key"],
        "_slice",
        ["_at", "_tie", "event_id", "_cls"],
        {c: F.col(f"_d_{c}") for c in totals},
    )
    own = [F.col("_row").getField(c).alias(c) for c in df.columns]
    return swept.filter(F.col("_cls") == _EVENT).select(*own, *_trailing_results(totals, stats, novel))


def _trailing_results(totals: list[str], stats: Mapping[str, str], novel: Mapping) -> list[Column]:
    out = [(F.col(c) > 0).alias(c) if c in novel else F.col(c).cast("bigint").alias(c) for c in totals if not c.startswith("_")]
    for c in stats:
        n, s1, s2 = (F.col(f"{m}_{c}") + F.col(f"_d_{m}_{c}") for m in ("_n", "_s1", "_s2"))
        total = s1.cast("decimal(38,0)")
        exact = F.try_subtract(
            F.try_multiply(n.cast("decimal(12,0)"), s2.cast("decimal(38,0)")),
            F.try_multiply(total, total),
        ).cast("double")
        rough = n * s2.cast("double") - s1.cast("double") * s1.cast("double")
        spread = F.greatest(F.coalesce(exact, rough), F.lit(0.0))
        out += [
            (s1.cast("double") / n).alias(f"{c}_mean"),
            F.when(n > 1, F.sqrt(spread / (n * (n - 1)))).otherwise(0.0).alias(f"{c}_stddev"),
        ]
    return out


def session_distinct(
    df: DataFrame,
    attributes: Mapping[str, str],
    gap_s: int = SESSION_TTL,
    key: str = "source_ip",
    ts: str = "timestamp",
    slice_us: int = SLICE_US,
) -> DataFrame:
    """Distinct values seen earlier in the source's inactivity session.

    `attributes` maps an output name to a column.  Only the first use of a
    value in a session adds one; first uses are found by a partial aggregate.
    """
    base = df.withColumn("_t", micros(df, ts))
    rows = sessionize(base, [key], "_t", "event_id", gap_s * US, slice_us)
    rows = rows.drop("session_first_id")
    uses = rows.select(
        key,
        "session_start",
        "event_id",
        "_t",
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(n).alias("attr"), F.col(c).cast("string").alias("value"))
                    for n, c in attributes.items()
                ]
            )
        ).alias("_u"),
    )
    firsts = (
        uses.filter("_u.value is not null")
        .groupBy(key, "session_start", "_u.attr", "_u.value")
        .agg(F.min(F.struct("_t", "event_id")).alias("_f"))
        .select(
            key,
            "session_start",
            F.col("_f._t").alias("_t"),
            F.col("_f.event_id").alias("event_id"),
            F.lit(1).alias("_cls"),
            F.col("attr").alias("_attr"),
        )
    )
    probes = rows.withColumn("_cls", F.lit(0))
    both = probes.unionByName(firsts, allowMissingColumns=True)
    both = both.withColumn("_slice", slice_of(F.col("_t"), slice_us))
    measures = {n: F.when(F.col("_attr") == n, 1).otherwise(0) for n in attributes}
    swept = running_sums(
        both, [key, "session_start"], "_slice", ["_t", "event_id", "_cls"], measures
    )
    return swept.filter("_cls = 0").select(
        *df.columns, *[F.col(n).cast("bigint").alias(n) for n in attributes]
    )


def novel_in_session(
    df: DataFrame,
    column: str,
    alias: str = "is_novel_port",
    gap_s: int = PORT_TTL,
    key: str = "source_ip",
    ts: str = "timestamp",
) -> DataFrame:
    """True for the first use of a value inside the source's long inactivity session.

    Rows that share id and time are told apart by their content; of equal rows one is the first.
    """
    base = df.withColumn("_t", micros(df, ts)).withColumn("_place", F.struct("_t", "event_id", F.xxhash64(*df.columns).alias("hash")))
    rows = sessionize(base, [key], "_t", "event_id", gap_s * US)
    uses = rows.withColumn("_use", F.struct(key, column, "session_start"))
    firsts = uses.groupBy("_use").agg(F.min("_place").alias("_place")).withColumn("_first", F.lit(True))
    out = numbered_among_equals(uses, ["_use", "_place"]).join(firsts, ["_use", "_place"], "left")
    return out.select(*df.columns, (F.col("_first").isNotNull() & (F.col("_nth") == 1)).alias(alias))


def numbered_among_equals(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """`rows` and `_nth`: the number, from 1, of a row among those equal in `keys`."""
    return rows.withColumn("_nth", F.row_number().over(Window.partitionBy(*keys).orderBy(F.lit(0))))


def not_seen_within(
    df: DataFrame,
    column: str,
    alias: str,
    horizon_s: int,
    key: str = "source_ip",
    ts: str = "timestamp",
) -> DataFrame:
    """True when the source did not use the value in the `horizon_s` before."""
    base = df.withColumn("_t", micros(df, ts))
    rows = sessionize(
        base, [key, column], "_t", "event_id", horizon_s * US, break_at_equal=False
    )
    return rows.select(
        *df.columns, (F.col("session_first_id") == F.col("event_id")).alias(alias)
    )


def window_distinct_approx(
    df: DataFrame,
    column: str,
    window_s: int,
    alias: str,
    parts: int = 12,
    lg_k: int = 11,
    key: str = "source_ip",
    ts: str = "timestamp",
) -> DataFrame:
    """Approximate trailing distinct count from mergeable sketches.

    One sketch per (source, slice); each is merged into the `parts` slices
    after it.  The window therefore ends at the event's slice end and its
    start is rounded to a slice.
    """
    step = window_s * US // parts
    base = df.withColumn("_t", micros(df, ts)).withColumn("_slice", slice_of(F.col("_t"), step))
    sketches = base.groupBy(key, "_slice").agg(
        F.hll_sketch_agg(F.col(column).cast("string"), lg_k).alias("_sk")
    )
    spread = sketches.select(
        key,
        F.explode(
            F.transform(
                F.sequence(F.lit(0), F.lit(parts)), lambda i: F.col("_slice") + i.cast("bigint") * step
            )
        ).alias("_slice"),
        "_sk",
    )
    merged = spread.groupBy(key, "_slice").agg(
        F.hll_sketch_estimate(F.hll_union_agg("_sk")).alias(alias)
    )
    return null_safe_join(base, merged, [key, "_slice"]).select(*df.columns, alias)


def peer_zscore(
    counts: DataFrame,
    group: str,
    metric: str,
    alias: str = "peer_deviation_score",
) -> DataFrame:
    """Deviation of each row's metric from its group, 0 where the group has none."""
    stats = counts.groupBy(group).agg(
        F.avg(metric).alias("_mean"), F.stddev_pop(metric).alias("_dev")
    )
    out = null_safe_join(counts, stats, [group])
    z = F.when(F.col("_dev") > 0, (F.col(metric) - F.col("_mean")) / F.col("_dev")).otherwise(0.0)
    return out.select(*counts.columns, z.alias(alias))
