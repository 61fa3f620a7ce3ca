"""Tiers, decisions and routing of scored transactions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

# Tier thresholds of the shipped configuration, actions and paths.
DEFAULT_THRESHOLDS = {
    "T1": -0.018327812857451373, "T2": 0.0044591921162663506,
    "T3": 0.0590975780688639, "T4": 0.09981083263386063,
}
TIER_ACTIONS = {
    "L1": "ALLOW_STORE", "L2": "ALLOW_MONITOR_STORE", "L3": "INVESTIGATE",
    "L4": "PRIORITY_INVESTIGATE", "L5": "CRITICAL_INVESTIGATE",
}
DIRECT_PATH = "Isolation Forest -> fraud-alerts"
SECOND_STAGE_ALERT_PATH = "L1/L2 -> XGBoost -> fraud-alerts"
SECOND_STAGE_LOW_PATH = "L1/L2 -> XGBoost -> low-risk"
DEFAULT_SECOND_STAGE_THRESHOLD = 0.5


def risk_tier(score: Column, thresholds: Mapping[str, float] = DEFAULT_THRESHOLDS) -> Column:
    """Half-open tiers: a score equal to a threshold belongs to the tier above."""
    cuts = [float(thresholds[f"T{i}"]) for i in range(1, 5)]
    if any(low >= high for low, high in zip(cuts, cuts[1:])):
        raise ValueError("thresholds must increase strictly")
    return (F.when(score < cuts[0], "L1").when(score < cuts[1], "L2")
            .when(score < cuts[2], "L3").when(score < cuts[3], "L4").otherwise("L5"))


def assign_tiers(
    df: DataFrame, score: str = "anomaly_score", thresholds: Mapping[str, float] = DEFAULT_THRESHOLDS,
    model_version: str = "isolation_forest_33_feature_v1",
) -> DataFrame:
    tier = F.col("risk_level")
    action = F.coalesce(*[F.when(tier == name, F.lit(text)) for name, text in TIER_ACTIONS.items()])
    return df.withColumn("risk_level", risk_tier(F.col(score), thresholds)).withColumns({
        "alert_required": F.when(tier.isin("L3", "L4", "L5"), 1).otherwise(0),
        "risk_action": action,
        "model_version": F.lit(model_version),
    })


def decide(
    df: DataFrame, probability: str = "second_stage_probability",
    threshold: float = DEFAULT_SECOND_STAGE_THRESHOLD, second_stage_version: str = "second_stage_v1",
) -> DataFrame:
    """Decision columns. The second stage only speaks for the two low tiers."""
    direct = F.col("risk_level").isin("L3", "L4", "L5")
    hit = F.col("xgboost_prediction") == 1
    staged = df.withColumns({
        "xgboost_probability": F.when(~direct, F.col(probability)),
        "xgboost_threshold": F.when(~direct, F.lit(float(threshold))),
        "xgboost_prediction": F.when(~direct, (F.col(probability) >= threshold).cast("int")),
        "xgboost_model_version": F.when(~direct, F.lit(second_stage_version)),
    })
    return staged.withColumns({
        "final_prediction": F.when(direct, 1).otherwise(F.col("xgboost_prediction")),
        "final_decision_path": F.when(direct, DIRECT_PATH).when(hit, SECOND_STAGE_ALERT_PATH)
        .otherwise(SECOND_STAGE_LOW_PATH),
        "final_risk_action": F.when(direct, F.col("risk_action")).when(hit, "FRAUD_ALERT")
        .otherwise("LOW_RISK_STORE"),
    })


def routed(df: DataFrame) -> DataFrame:
    """Adds the output route; one scored frame feeds both outputs."""
    return df.withColumn("route", F.when(F.col("final_prediction") == 1, "fraud-alerts").otherwise("low-risk"))


def split_routes(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(alerts, low-risk rows): direct alerts and second-stage hits share one frame."""
    return df.where("final_prediction = 1"), df.where("final_prediction = 0")


def decision_counts(df: DataFrame, *groups: str) -> DataFrame:
    """All batch counters in one aggregate."""
    direct = F.col("risk_level").isin("L3", "L4", "L5")
    hit = F.coalesce(F.col("xgboost_prediction") == 1, F.lit(False))
    return df.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(~direct).alias("second_stage_input"),
        F.count_if(direct).alias("direct_alerts"),
        F.count_if(~direct & hit).alias("second_stage_alerts"),
        F.count_if(~direct & ~hit).alias("low_risk"),
    )
