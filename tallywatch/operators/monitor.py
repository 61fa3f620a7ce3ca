"""Operational metrics over sample tables: rates, ratios, latency, holds, resets.

Samples are reduced to one row per series and minute first. Sliding windows,
spines and islands then work on minutes, whose number depends on time only.
Rates are plain sums over the window; nothing is extrapolated.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallywatch.operators.evaluate import ratio
from tallywatch.operators.ordered import exact_quantiles, previous_in_group

# Latency histogram bounds in seconds, and the ratio floor.
DURATION_BOUNDS = [0.005, 0.01, 0.025, 0.05, 0.075, 0.1, 0.25, 0.5, 0.75, 1.0, 2.5, 5.0, 7.5, 10.0]
RATIO_FLOOR = 0.001


def minute_of(ts: str = "ts") -> Column:
    return F.date_trunc("minute", F.col(ts))


def per_minute(df: DataFrame, series: Sequence[str], ts: str = "ts", value: str | None = None,
               grain: str = "minute") -> DataFrame:
    """Increase per series and minute (or a coarser grain): the sum of ``value``, or the row count."""
    amount = F.count("*") if value is None else F.sum(value)
    return df.groupBy(*series, F.date_trunc(grain, F.col(ts)).alias("minute")).agg(amount.alias("n"))


def sliding(minutes: DataFrame, series: Sequence[str], length: int, value: str = "n") -> DataFrame:
    """Sums over windows of ``length`` minutes that slide by one minute."""
    spans = F.window("minute", f"{length} minutes", "1 minute")
    return (minutes.groupBy(*series, spans.alias("w")).agg(F.sum(value).alias(value))
            .select(*series, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), value))


def event_rates(df: DataFrame, series: Sequence[str], ts: str = "ts", length: int = 5, value: str | None = None) -> DataFrame:
    out = sliding(per_minute(df, series, ts, value), series, length)
    return out.withColumn("per_second", F.col("n") / F.lit(length * 60))


def status_ratio(df: DataFrame, wanted: Column, series: Sequence[str] = (), ts: str = "ts", length: int = 5) -> DataFrame:
    """Rate of the wanted rows over the rate of all rows, floored denominator."""
    marked = df.withColumn("_wanted", wanted.cast("long"))
    minutes = marked.groupBy(*series, minute_of(ts).alias("minute")).agg(
        F.sum("_wanted").alias("hits"), F.count("*").alias("n"))
    spans = F.window("minute", f"{length} minutes", "1 minute")
    summed = minutes.groupBy(*series, spans.alias("w")).agg(F.sum("hits").alias("hits"), F.sum("n").alias("n"))
    seconds = F.lit(length * 60)
    return summed.select(
        *series, F.col("w.end").alias("window_end"), "hits", "n",
        (F.col("hits") / seconds / F.greatest(F.col("n") / seconds, F.lit(RATIO_FLOOR))).alias("ratio"))


def duration_quantile(df: DataFrame, duration: str, share: float, series: Sequence[str]) -> DataFrame:
    """Exact duration quantile per series from the raw durations."""
    return exact_quantiles(df, duration, [share], list(series)).select(*series, F.col("quantile"), "n")


def bucket_counts(df: DataFrame, duration: str, series: Sequence[str], bounds: Sequence[float]) -> DataFrame:
    """Histogram form: rows per series and upper bound (infinity for the rest)."""
    upper = F
    for bound in bounds:
        upper = upper.when(F.col(duration) <= bound, F.lit(float(bound)))
    return df.groupBy(*series, upper.otherwise(F.lit(float("inf"))).alias("le")).agg(F.count("*").alias("n"))


def histogram_quantile(buckets: DataFrame, share: float, series: Sequence[str], bounds: Sequence[float]) -> DataFrame:
    """Quantile by linear interpolation inside the bucket that holds the rank.

    The lowest bucket starts at 0. A rank in the open bucket gives the highest
    bound. Works on one row per series and bucket.
    """
    lower = F
    for low, high in zip([0.0, *bounds], [*bounds, float("inf")]):
        lower = lower.when(F.col("le") == F.lit(float(high)), F.lit(float(low)))
    order = Window.partitionBy(*series).orderBy("le")
    ranked = buckets.withColumns({
        "_low": lower, "_below": F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "_all": F.sum("n").over(Window.partitionBy(*series))})
    rank = F.lit(share) * F.col("_all")
    inside = (F.col("_below") < rank) & (rank <= F.col("_below") + F.col("n"))
    value = F.when(F.col("le") == float("inf"), F.lit(float(bounds[-1]))).otherwise(
        F.col("_low") + (F.col("le") - F.col("_low")) * (rank - F.col("_below")) / F.col("n"))
    return ranked.where(inside).select(*series, value.alias("quantile"), F.col("_all").alias("n"))


def minute_spine(minutes: DataFrame) -> DataFrame:
    """Every minute between the first and the last; its size depends on time only."""
    span = minutes.agg(F.min("minute").alias("a"), F.max("minute").alias("b"))
    return span.select(F.explode(F.sequence("a", "b", F.expr("INTERVAL 1 MINUTE"))).alias("minute"))


def silent_minutes(df: DataFrame, length: int = 10, ts: str = "ts") -> DataFrame:
    """Minutes that end a stretch of ``length`` minutes without any row."""
    minutes = per_minute(df, [], ts)
    spine = minute_spine(minutes).join(minutes, "minute", "left").fillna(0, ["n"])
    back = Window.partitionBy(F.lit(0)).orderBy("minute").rowsBetween(1 - length, 0)
    seen = spine.withColumns({"_sum": F.sum("n").over(back), "_size": F.count("*").over(back)})
    return seen.where((F.col("_sum") == 0) & (F.col("_size") == length)).select("minute")


def firing_spans(states: DataFrame, series: Sequence[str], active: str, hold: int, every: int = 1) -> DataFrame:
    """Spans of an alert rule that held for ``hold`` minutes.

    ``states`` has one row per series and evaluated minute; the rule evaluates
    every ``every`` minutes, so a missing evaluation ends a span.
    """
    order = Window.partitionBy(*series).orderBy("minute")
    on = states.where(F.col(active))
    gap = (F.unix_timestamp("minute") - F.unix_timestamp(F.lag("minute").over(order))) / 60
    starts = on.withColumn("_start", F.coalesce((gap > every).cast("int"), F.lit(1)))
    islands = starts.withColumn("_island", F.sum("_start").over(order))
    spans = islands.groupBy(*series, "_island").agg(
        F.min("minute").alias("active_since"), F.max("minute").alias("active_until"))
    firing_from = F.timestamp_seconds(F.unix_timestamp("active_since") + F.lit(hold * 60))
    return (spans.withColumn("firing_from", firing_from).where(F.col("active_until") >= F.col("firing_from"))
            .select(*series, "active_since", "firing_from", "active_until"))


def rule_limits(at_least: int | None, at_most: int | None) -> tuple[int, int | None]:
    """Limits of a rule on the count of a window; a rule that an empty window both keeps and breaks is refused."""
    if at_least is None and at_most is None:
        raise ValueError("give at_least, at_most or both")
    low = 0 if at_least is None else at_least
    if (at_most is None and low <= 0) or (at_most is not None and at_most < low):
        raise ValueError("the limits leave no count, or all counts, in the rule")
    return low, at_most


def alert_spans(df: DataFrame, series: Sequence[str], until: Column, ts: str = "ts", wanted: Column | None = None, length: int = 10,
                at_least: int | None = None, at_most: int | None = None, hold: int = 0) -> DataFrame:
    """Alerts of a rule on the count of the last ``length`` minutes: (series, active_since, firing_from, active_until).

    The rule holds in a minute if ``at_least`` <= count <= ``at_most``; spans in which it holds for more than ``hold``
    minutes are alerts. Every series is evaluated from its first wanted row to the minute ``until`` (a constant);
    active_until is null for alerts that still fire then. Work follows the minutes at which a count changes, not all minutes.
    """
    low, high = rule_limits(at_least, at_most)
    minute = F.expr("INTERVAL 1 MINUTE")
    timed = df.where(F.col(ts).isNotNull()) if wanted is None else df.where(wanted & F.col(ts).isNotNull())
    counted = per_minute(timed, series, ts)
    leaving = counted.withColumns({"minute": F.col("minute") + F.make_interval(mins=F.lit(length)), "n": -F.col("n")})
    changes = counted.unionByName(leaving).where(F.col("minute") <= until).groupBy(*series, "minute").agg(F.sum("n").alias("n"))
    order = Window.partitionBy(*(series or [F.lit(0)])).orderBy("minute")
    total = F.sum("n").over(order)
    parts = changes.withColumns({
        "_on": (total >= low) & (F.lit(True) if high is None else total <= high),
        "_to": F.coalesce(F.lead("minute").over(order) - minute, until)})
    begun = F.col("_on") & ~F.coalesce(F.lag("_on").over(order), F.lit(False))
    islands = parts.withColumn("_begun", begun.cast("int")).withColumn("_island", F.sum("_begun").over(order)).where("_on")
    spans = islands.groupBy(*series, "_island").agg(F.min("minute").alias("active_since"), F.max("_to").alias("active_until"))
    fired = spans.withColumn("firing_from", F.col("active_since") + F.make_interval(mins=F.lit(hold))).where("active_until >= firing_from")
    return fired.select(*series, "active_since", "firing_from", F.when(F.col("active_until") < until, F.col("active_until")).alias("active_until"))


def repeated_failures(df: DataFrame, failed: Column, series: Sequence[str], at_least: int = 3, length: int = 10,
                      ts: str = "ts") -> DataFrame:
    """Windows with at least that many failures."""
    out = sliding(per_minute(df.where(failed), series, ts), series, length)
    return out.where(F.col("n") >= at_least)


def gauge_changes(df: DataFrame, series: Sequence[str], gauge: str, order: str, block: Column) -> DataFrame:
    """Rows whose gauge differs from the row before it in the series."""
    paired = previous_in_group(df, series, order, {"previous": gauge}, block)
    return paired.where(F.col("previous").isNotNull() & (F.col("previous") != F.col(gauge)))


def availability(df: DataFrame, up: str, series: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*series).agg(F.avg(F.col(up).cast("double")).alias("availability"), F.count("*").alias("samples"))


def counter_increase(df: DataFrame, series: Sequence[str], counter: str, order: str, block: Column) -> DataFrame:
    """Counter samples to increments; a drop means a reset, so the new value counts."""
    paired = previous_in_group(df, series, order, {"_previous": counter}, block)
    step = F.when(F.col("_previous").isNull(), F.lit(None)).when(
        F.col(counter) < F.col("_previous"), F.col(counter)).otherwise(F.col(counter) - F.col("_previous"))
    return paired.withColumn("increase", step).drop("_previous")


def failure_share(df: DataFrame, failed: Column, series: Sequence[str]) -> DataFrame:
    return df.groupBy(*series).agg(F.count_if(failed).alias("failures"), F.count("*").alias("n")).withColumn(
        "share", ratio(F.col("failures"), F.col("n")))
