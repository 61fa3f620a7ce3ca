"""Detector evaluation: confusion metrics, threshold sweeps, curves, reports.

Scores are reduced to one row per threshold interval or per distinct score
before anything is ordered, so a sweep costs one aggregation, not one join.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, functions as F

from tallywatch.operators.ordered import exact_quantiles, running, value_bounds
from tallywatch.schema import RISK_TIERS

# False-positive caps of the four thresholds, sweep grids, targets.
FPR_CAPS = {"T1": 0.01, "T2": 0.005, "T3": 0.001, "T4": 0.0005}
NOTEBOOK_FPR_CAPS = {"T1": 0.01, "T2": 0.005, "T3": 0.002, "T4": 0.0005}
SECOND_STAGE_GRID = [0.01, 0.02, 0.05, 0.10, 0.15, 0.20, 0.25, 0.30, 0.40, 0.50, 0.60, 0.70, 0.80, 0.90]


def ratio(top: Column, bottom: Column) -> Column:
    """Division that gives 0 where the denominator is 0."""
    return F.when(bottom != 0, top / bottom).otherwise(0.0)


def add_rates(df: DataFrame, tp: str = "tp", fp: str = "fp", fn: str = "fn", tn: str = "tn") -> DataFrame:
    a, b, c, d = (F.col(name) for name in (tp, fp, fn, tn))
    return df.withColumns({
        "precision": ratio(a, a + b), "recall": ratio(a, a + c), "f1": ratio(2 * a, 2 * a + b + c),
        "fpr": ratio(b, b + d), "fnr": ratio(c, a + c), "accuracy": ratio(a + d, a + b + c + d),
    })


def confusion(df: DataFrame, label: str, prediction: str, groups: Sequence[str] = ()) -> DataFrame:
    truth, said = F.col(label) == 1, F.col(prediction) == 1
    counts = df.groupBy(*groups).agg(
        F.count_if(truth & said).alias("tp"), F.count_if(~truth & said).alias("fp"),
        F.count_if(truth & ~said).alias("fn"), F.count_if(~truth & ~said).alias("tn"))
    return add_rates(counts)


def normalized_confusion(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """Counts per (label, prediction) and the share within the label."""
    cells = df.groupBy(label, prediction).agg(F.count("*").alias("n"))
    return cells.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(label)))


def classification_report(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """Precision, recall, F1 and support per class, plus macro and weighted rows."""
    cells = df.groupBy(label, prediction).agg(F.count("*").alias("n"))
    as_class = F.inline(F.array(
        F.struct(F.col(label).cast("string").alias("class"), F.col("n").alias("support"), F.lit(0).alias("said"),
                 F.when(F.col(label) == F.col(prediction), F.col("n")).otherwise(0).alias("hit")),
        F.struct(F.col(prediction).cast("string").alias("class"), F.lit(0).cast("long").alias("support"),
                 F.col("n").alias("said"), F.lit(0).cast("long").alias("hit"))))
    sides = cells.select(as_class).groupBy("class").agg(
        F.sum("support").alias("support"), F.sum("said").alias("said"), F.sum("hit").alias("hit"))
    per_class = sides.select(
        "class", ratio(F.col("hit"), F.col("said")).alias("precision"),
        ratio(F.col("hit"), F.col("support")).alias("recall"),
        ratio(2 * F.col("hit"), F.col("said") + F.col("support")).alias("f1"), "support")
    weight = F.sum("support")
    means = per_class.agg(
        *[F.avg(m).alias(f"m_{m}") for m in ("precision", "recall", "f1")],
        *[(F.sum(F.col(m) * F.col("support")) / weight).alias(f"w_{m}") for m in ("precision", "recall", "f1")],
        weight.alias("support"))
    averages = means.select(F.inline(F.array(*[
        F.struct(F.lit(name).alias("class"), *[F.col(f"{p}_{m}").alias(m) for m in ("precision", "recall", "f1")],
                 F.col("support"))
        for name, p in (("macro avg", "m"), ("weighted avg", "w"))])))
    return per_class.unionByName(averages)


def tier_thresholds(
    df: DataFrame, score: str, label: str, caps: Mapping[str, float] = FPR_CAPS
) -> dict[str, float]:
    """Exact quantiles of the legitimate scores; they must increase strictly."""
    rows = exact_quantiles(df.where(F.col(label) == 0), score, [1.0 - cap for cap in caps.values()])
    found = {round(row["share"], 9): row["quantile"] for row in rows.collect()}
    thresholds = {name: float(found[round(1.0 - cap, 9)]) for name, cap in caps.items()}
    values = list(thresholds.values())
    if any(low >= high for low, high in zip(values, values[1:])):
        raise ValueError(f"thresholds do not increase: {thresholds}")
    return thresholds


def approximate_tier_thresholds(df: DataFrame, score: str, label: str, caps: Mapping[str, float] = FPR_CAPS,
                                accuracy: int = 100_000) -> DataFrame:
    """Sketch-based thresholds for a quick look; not for calibration."""
    shares = [1.0 - cap for cap in caps.values()]
    found = df.where(F.col(label) == 0).agg(F.percentile_approx(score, shares, accuracy).alias("q"))
    return found.select(*[F.col("q")[i].alias(name) for i, name in enumerate(caps)])


def threshold_sweep(df: DataFrame, score: str, label: str, thresholds: Sequence[float]) -> DataFrame:
    """Confusion metrics of ``score >= t`` for every candidate, in one aggregation.

    Each row falls into the interval of the last threshold it reaches; sums from
    the top down give the counts of every threshold.
    """
    candidates = [float(t) for t in thresholds]
    if not candidates:
        raise ValueError("no candidate threshold")
    cuts = sorted(set(candidates))
    edges = [-math.inf, *cuts, math.inf]
    scored = df.where(F.col(score).isNotNull()).select(
        F.col(score).cast("double").alias("_score"), F.col(label).cast("long").alias("_label"))
    filled = Bucketizer(splits=edges, inputCol="_score", outputCol="_slot").transform(scored)
    slots = filled.groupBy("_slot").agg(F.count("*").alias("_n"), F.sum("_label").alias("_p"))
    # Thresholds are a parameter list, so everything from here on is that small.
    listed = df.sparkSession.createDataFrame(
        [(i, t, float(cuts.index(t) + 1)) for i, t in enumerate(candidates)], "ordinal int, threshold double, _slot double")
    every = df.sparkSession.createDataFrame([(float(i),) for i in range(len(edges) - 1)], "_slot double")
    down = Window.partitionBy(F.lit(0)).orderBy(F.col("_slot").desc())
    whole = Window.partitionBy(F.lit(0))
    counts = every.join(slots, "_slot", "left").fillna(0, ["_n", "_p"]).select(
        "_slot", F.sum("_n").over(down).alias("alerts"), F.sum("_p").over(down).alias("tp"),
        F.sum("_n").over(whole).alias("rows"), F.sum("_p").over(whole).alias("positives"))
    table = listed.join(counts, "_slot").select(
        "ordinal", "threshold", "tp", (F.col("alerts") - F.col("tp")).alias("fp"),
        (F.col("positives") - F.col("tp")).alias("fn"),
        (F.col("rows") - F.col("positives") - F.col("alerts") + F.col("tp")).alias("tn"),
        "alerts", ratio(F.col("alerts"), F.col("rows")).alias("alert_rate"))
    return add_rates(table)


def percentile_thresholds(df: DataFrame, score: str, shares: Sequence[float]) -> list[float]:
    """Candidate thresholds at exact score percentiles."""
    rows = exact_quantiles(df, score, shares).select("share", "quantile").collect()
    return [row["quantile"] for row in sorted(rows, key=lambda row: row["share"])]


def spaced_thresholds(df: DataFrame, score: str, low: float, high: float, points: int) -> list[float]:
    """Evenly spaced candidates between two exact percentiles."""
    first, last = percentile_thresholds(df, score, [low, high])
    step = (last - first) / (points - 1)
    return [first + i * step for i in range(points - 1)] + [last]


def best_f1(sweep: DataFrame) -> DataFrame:
    """The candidate with the best F1; the earliest wins a tie."""
    return _pick(sweep, F.struct(F.col("f1"), -F.col("ordinal")))


def best_by_recall(sweep: DataFrame) -> DataFrame:
    """Highest recall, then F1, then fewest false positives, then fewest misses."""
    return _pick(sweep, F.struct("recall", "f1", -F.col("fp"), -F.col("fn"), -F.col("ordinal")))


def _pick(sweep: DataFrame, rank: Column) -> DataFrame:
    return sweep.agg(F.max_by(F.struct(*sweep.columns), rank).alias("best")).select("best.*")


def best_per_recall_target(sweep: DataFrame, targets: Sequence[float]) -> DataFrame:
    """Per target, the reaching threshold with the best precision, then F1.

    A target that no threshold reaches keeps a row of nulls.
    """
    goals = [float(t) for t in targets]
    reached = F.filter(F.array(*[F.lit(t) for t in goals]), lambda goal: F.col("recall") >= goal)
    fields = ["threshold", "precision", "recall", "f1", "tp", "fp", "fn", "tn", "alerts", "alert_rate"]
    best = sweep.withColumn("target_recall", F.explode(reached)).groupBy("target_recall").agg(
        F.max_by(F.struct(*fields), F.struct(F.col("precision"), F.col("f1"), -F.col("ordinal"))).alias("best"))
    listed = sweep.sparkSession.createDataFrame([(t,) for t in goals], "target_recall double")
    return listed.join(best, "target_recall", "left").select(
        "target_recall", F.col("best").isNotNull().alias("achieved"), "best.*")


def incremental_cost(per_target: DataFrame) -> DataFrame:
    """Extra false positives paid for each extra hit between successive targets."""
    order = Window.partitionBy(F.lit(0)).orderBy("target_recall")
    more = {name: F.col(name) - F.lag(name).over(order) for name in ("fp", "tp")}
    out = per_target.withColumns({"additional_fp": more["fp"], "additional_tp": more["tp"]})
    return out.withColumn("fp_per_additional_tp", F.when(
        F.col("additional_tp") != 0, F.col("additional_fp") / F.col("additional_tp")))


def _score_steps(df: DataFrame, score: str, label: str, groups: Sequence[str] = ()) -> DataFrame:
    """One row per distinct score with hits and alerts at or above it."""
    rows = df.where(F.col(score).isNotNull() & F.col(label).isNotNull())
    steps = rows.groupBy(*groups, score).agg(
        F.count("*").alias("n"), F.sum(F.col(label).cast("long")).alias("pos"))
    ordered = running(steps, score, {"n": "n", "pos": "pos"}, groups, bounds=value_bounds(rows, score))
    return ordered.withColumns({
        "tp": F.col("pos_total") - F.col("pos_before"),
        "alerts": F.col("n_total") - F.col("n_before"),
    })


def curve_points(df: DataFrame, score: str, label: str) -> DataFrame:
    """ROC and precision-recall points at every distinct score, and the end point of both curves.

    At the end point nothing is alerted: its threshold is null (above every score), both rates are 0 and the precision is 1.
    """
    steps = _score_steps(df, score, label)
    false = F.col("alerts") - F.col("tp")
    points = steps.select(
        F.col(score).alias("threshold"), "tp", false.alias("fp"),
        ratio(F.col("tp"), F.col("pos_total")).alias("tpr"),
        ratio(false, F.col("n_total") - F.col("pos_total")).alias("fpr"),
        ratio(F.col("tp"), F.col("alerts")).alias("precision"))
    values = {"threshold": None, "tp": 0, "fp": 0, "tpr": 0.0, "fpr": 0.0, "precision": 1.0}
    end = df.sparkSession.range(1, numPartitions=1).select(*[F.lit(values[f.name]).cast(f.dataType).alias(f.name) for f in points.schema])
    return points.unionByName(end)


def ranking_metrics(df: DataFrame, score: str, label: str, groups: Sequence[str] = ()) -> DataFrame:
    """ROC-AUC with ties averaged and step-wise average precision; null for one class."""
    steps = _score_steps(df, score, label, groups)
    neg, neg_before = F.col("n") - F.col("pos"), F.col("n_before") - F.col("pos_before")
    positives, negatives = F.max("pos_total"), F.max("n_total") - F.max("pos_total")
    return steps.groupBy(*groups).agg(
        F.when((positives > 0) & (negatives > 0),
               F.sum(F.col("pos") * (neg_before + neg / 2)) / (positives * negatives)).alias("roc_auc"),
        F.when(positives > 0, F.sum(F.col("pos") * F.col("tp") / F.col("alerts")) / positives).alias("pr_auc"),
        positives.alias("positives"), negatives.alias("negatives"))


def population_report(df: DataFrame, label: str = "isFraud", tier: str = "risk_level", split: str = "split") -> DataFrame:
    fraud = F.col(label) == 1
    return df.groupBy(split).agg(
        F.count("*").alias("total_rows"), F.count_if(fraud).alias("fraud_rows"),
        F.count_if(~fraud).alias("legitimate_rows"),
        *[F.count_if(F.col(tier) == t).alias(f"{t}_rows") for t in RISK_TIERS],
        *[F.count_if((F.col(tier) == t) & fraud).alias(f"fraud_in_{t}") for t in RISK_TIERS])


def fraud_guard(report: DataFrame) -> DataFrame:
    """Per split: does it hold fraud, and does its second-stage input?"""
    return report.select(
        "split", (F.col("fraud_rows") > 0).alias("has_fraud"),
        (F.col("fraud_in_L1") + F.col("fraud_in_L2") > 0).alias("has_low_tier_fraud"))


def require_fraud(report: DataFrame, split: str = "validation") -> DataFrame:
    """Stop when a split, or its second-stage input, holds no fraud at all."""
    row = report.where(F.col("split") == split).first()
    if row is None or row["total_rows"] == 0:
        raise ValueError(f"split {split} is empty")
    if row["fraud_rows"] == 0:
        raise ValueError(f"split {split} holds no fraud rows")
    if row["fraud_in_L1"] + row["fraud_in_L2"] == 0:
        raise ValueError(f"split {split} holds no fraud in the low tiers")
    return report


def cascade_comparison(df: DataFrame, label: str = "isFraud", first: str = "first_stage_alert",
                       final: str = "final_prediction") -> DataFrame:
    """First stage against the cascade on the same rows, one aggregate."""
    truth = F.col(label) == 1

    def counts(said: Column, name: str) -> list[Column]:
        return [F.count_if(truth & said).alias(f"{name}_tp"), F.count_if(~truth & said).alias(f"{name}_fp"),
                F.count_if(truth & ~said).alias(f"{name}_fn"), F.count_if(~truth & ~said).alias(f"{name}_tn")]

    a, b = F.col(first) == 1, F.col(final) == 1
    row = df.agg(*counts(a, "first"), *counts(b, "cascade"), F.count_if(truth & ~a & b).alias("recovered_fraud"))
    rates = {}
    for name in ("first", "cascade"):
        tp, fp, fn, tn = (F.col(f"{name}_{k}") for k in ("tp", "fp", "fn", "tn"))
        rates |= {f"{name}_precision": ratio(tp, tp + fp), f"{name}_recall": ratio(tp, tp + fn),
                  f"{name}_f1": ratio(2 * tp, 2 * tp + fp + fn), f"{name}_fpr": ratio(fp, fp + tn),
                  f"{name}_alerts": tp + fp}
    fewer = F.col("first_fn") - F.col("cascade_fn")
    return row.withColumns(rates | {
        "fn_reduction": fewer, "fn_reduction_pct": ratio(fewer * 100.0, F.col("first_fn"))})


def outcome(label: str, prediction: str) -> Column:
    truth, said = F.col(label) == 1, F.col(prediction) == 1
    return (F.when(truth & said, "TP").when(~truth & said, "FP").when(~truth & ~said, "TN").otherwise("FN"))


def long_form(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in columns])
    return df.select(*keep, F.inline(pairs))


def outcome_profile(df: DataFrame, label: str, prediction: str, features: Sequence[str],
                    outcomes: Sequence[str] = ("TP", "FN")) -> DataFrame:
    """Mean and median of each feature per outcome (detected against missed by default)."""
    marked = df.withColumn("outcome", outcome(label, prediction)).where(F.col("outcome").isin(list(outcomes)))
    values = long_form(marked, features, ["outcome"]).where("value IS NOT NULL")
    means = values.groupBy("outcome", "feature").agg(F.avg("value").alias("mean"), F.count("*").alias("n"))
    medians = exact_quantiles(values, "value", [0.5], ["outcome", "feature"]).select(
        "outcome", "feature", F.col("quantile").alias("median"))
    return means.join(medians, ["outcome", "feature"])


def miss_rate_by(df: DataFrame, key: str, label: str, prediction: str) -> DataFrame:
    missed = F.count_if(F.col(prediction) == 0)
    return df.where(F.col(label) == 1).groupBy(key).agg(
        F.count("*").alias("fraud"), F.count_if(F.col(prediction) == 1).alias("detected"), missed.alias("missed"),
        (missed / F.count("*")).alias("miss_rate"))


def outcome_listing(df: DataFrame, label: str, prediction: str, score: str, which: str, unique: str) -> DataFrame:
    """Every row with one outcome, highest score first."""
    return df.where(outcome(label, prediction) == which).orderBy(F.col(score).desc(), unique)


def top_anomalies(df: DataFrame, score: str, unique: str, n: int = 20) -> DataFrame:
    return df.orderBy(F.col(score).desc(), unique).limit(n)


def score_summary(df: DataFrame, score: str, by: str) -> DataFrame:
    """Count, mean, median, population deviation, minimum and maximum per class."""
    medians = exact_quantiles(df, score, [0.5], [by]).select(by, F.col("quantile").alias("median"))
    return df.where(F.col(score).isNotNull()).groupBy(by).agg(
        F.count(score).alias("n"), F.avg(score).alias("mean"), F.stddev_pop(score).alias("std"),
        F.min(score).alias("min"), F.max(score).alias("max")).join(medians, by)


def score_percentiles(df: DataFrame, score: str, by: str,
                      shares: Sequence[float] = (0.5, 0.75, 0.9, 0.95, 0.99, 0.995, 0.999)) -> DataFrame:
    return exact_quantiles(df, score, shares, [by]).select(by, "share", "quantile")


def histogram(df: DataFrame, value: str, bins: int, groups: Sequence[str] = ()) -> DataFrame:
    """Equal-width bins between the overall minimum and maximum; the last is closed."""
    low, high = df.agg(F.min(value).cast("double"), F.max(value).cast("double")).first()
    if low is None:
        return df.limit(0).select(*groups, F.lit(0).alias("bin"), F.lit(0).cast("long").alias("n"))
    width = (high - low) / bins
    slot = F.lit(0) if width == 0 else F.least(
        F.floor((F.col(value) - F.lit(low)) / F.lit(width)), F.lit(bins - 1)).cast("int")
    return df.where(F.col(value).isNotNull()).groupBy(*groups, slot.alias("bin")).agg(F.count("*").alias("n"))


def shares_of(df: DataFrame, column: str) -> DataFrame:
    whole = Window.partitionBy(F.lit(0))
    counts = df.groupBy(column).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(whole))


def tier_summary(df: DataFrame, tier: str = "risk_level", label: str = "isFraud") -> DataFrame:
    """Rows, share of all rows, fraud and purity per tier."""
    counts = df.groupBy(tier).agg(F.count("*").alias("records"), F.count_if(F.col(label) == 1).alias("anomalies"))
    total = F.sum("records").over(Window.partitionBy(F.lit(0)))
    return counts.withColumns({
        "population_pct": F.col("records") / total * 100,
        "purity_pct": ratio(F.col("anomalies") * 100.0, F.col("records"))})


def class_weight(df: DataFrame, label: str) -> DataFrame:
    positives, negatives = F.count_if(F.col(label) == 1), F.count_if(F.col(label) == 0)
    return df.agg(positives.alias("positives"), negatives.alias("negatives"),
                  (negatives / F.greatest(positives, F.lit(1))).alias("weight"))


def compare_models(long: DataFrame, models: Sequence[str]) -> DataFrame:
    """Metric-by-model table from (model, metric, value) rows."""
    return long.groupBy("metric").pivot("model", list(models)).agg(F.first("value"))
