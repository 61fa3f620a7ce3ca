"""Second stage, standardisation, reconstruction error, record verdicts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from tallywatch.operators.evaluate import SECOND_STAGE_GRID, best_by_recall, best_f1, spaced_thresholds, threshold_sweep
from tallywatch.operators.forest import Forest, score_forest, train_forest
from tallywatch.operators.route import risk_tier

# The three candidate settings of the second stage.
SECOND_STAGE_CONFIGS = [
    {"maxDepth": 3, "stepSize": 0.05, "maxIter": 200, "subsamplingRate": 0.9, "featureSubsetStrategy": "0.8"},
    {"maxDepth": 3, "stepSize": 0.08, "maxIter": 150, "subsamplingRate": 0.9, "featureSubsetStrategy": "0.8"},
    {"maxDepth": 4, "stepSize": 0.05, "maxIter": 200, "subsamplingRate": 0.9, "featureSubsetStrategy": "0.8"},
]
PROBABILITY = "second_stage_probability"


def _vectors(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol="_features", handleInvalid="error").transform(df)


@dataclass
class SecondStage:
    model: GBTClassificationModel
    features: list[str]
    threshold: float
    config: dict

    def apply(self, df: DataFrame, name: str = PROBABILITY) -> DataFrame:
        """Probability per row, computed where the row is; nothing goes to the driver."""
        scored = self.model.transform(_vectors(df, self.features))
        return scored.withColumn(name, vector_to_array("probability")[1]).drop(
            "_features", "rawPrediction", "probability", "prediction")


def train_second_stage(
    train: DataFrame, valid: DataFrame, features: Sequence[str], label: str = "isFraud",
    configs: Sequence[Mapping] = tuple(SECOND_STAGE_CONFIGS), grid: Sequence[float] = SECOND_STAGE_GRID, seed: int = 42,
) -> tuple[SecondStage, list[dict]]:
    """Weighted boosted trees per setting; one sweep each; best by recall, F1, FP, FN.

    Returns the winner and all sweep rows (settings x thresholds).
    """
    # The inputs are computed once, for their counts and for all settings; lost blocks are recomputed from lineage.
    taken = _vectors(train, features).select("_features", F.col(label).alias("_given")).persist()
    held_out = valid.select(*features, label).persist()
    best, best_key, table = None, None, []
    try:
        counts = taken.agg(F.count_if(F.col("_given") == 1).alias("p"), F.count_if(F.col("_given") == 0).alias("n")).first()
        if counts["p"] == 0 or held_out.agg(F.count_if(F.col(label) == 1)).first()[0] == 0:
            raise ValueError("the second stage needs fraud rows in training and validation")
        weight = counts["n"] / max(counts["p"], 1)
        ready = taken.select(
            "_features", F.col("_given").cast("double").alias("_label"),
            F.when(F.col("_given") == 1, F.lit(float(weight))).otherwise(1.0).alias("_weight"))
        for index, config in enumerate(configs):
            model = GBTClassifier(featuresCol="_features", labelCol="_label", weightCol="_weight", seed=seed,
                                  **config).fit(ready)
            stage = SecondStage(model, list(features), 0.5, dict(config))
            sweep = threshold_sweep(stage.apply(held_out), PROBABILITY, label, grid)
            rows = [row.asDict() | {"config_index": index} for row in sweep.orderBy("ordinal").collect()]
            table += rows
            for row in rows:
                rank = (row["recall"], row["f1"], -row["fp"], -row["fn"])
                if best_key is None or rank > best_key:
                    best_key, stage.threshold, best = rank, row["threshold"], stage
    finally:
        taken.unpersist()
        held_out.unpersist()
    return best, table


def pick_threshold(stage: SecondStage, valid: DataFrame, label: str = "isFraud") -> DataFrame:
    return best_by_recall(threshold_sweep(stage.apply(valid), PROBABILITY, label, SECOND_STAGE_GRID))


def forest_search(train: DataFrame, valid: DataFrame, features: Sequence[str], key: str, configs: Sequence[Mapping],
                  label: str = "isFraud", points: int = 50) -> list[dict]:
    """Fit each setting on legitimate rows, sweep thresholds on validation, rank by F1."""
    results = []
    for config in configs:
        subsample = int(config.get("subsample", 256))
        nodes = train_forest(train.where(F.col(label) == 0), features, key, **config)
        scored = score_forest(valid, Forest.load(nodes, features, subsample)).select(label, "anomaly_score")
        candidates = spaced_thresholds(scored, "anomaly_score", 0.5, 0.999, points)
        best = best_f1(threshold_sweep(scored, "anomaly_score", label, candidates)).first()
        results.append(dict(config) | {k: best[k] for k in ("threshold", "precision", "recall", "f1")})
    return sorted(results, key=lambda row: -row["f1"])


@dataclass
class Scaler:
    """Mean and population deviation per feature, from legitimate training rows."""

    means: dict[str, float]
    deviations: dict[str, float]

    @classmethod
    def fit(cls, df: DataFrame, features: Sequence[str]) -> Scaler:
        row = df.agg(*[F.avg(f).alias(f"m_{f}") for f in features], *[F.stddev_pop(f).alias(f"s_{f}") for f in features]).first()
        return cls({f: float(row[f"m_{f}"]) for f in features}, {f: float(row[f"s_{f}"]) for f in features})

    def z(self, feature: str) -> Column:
        # A constant feature keeps its centred value, as a unit scale would.
        scale = self.deviations[feature] or 1.0
        return (F.col(feature).cast("double") - F.lit(self.means[feature])) / F.lit(scale)

    def transform(self, df: DataFrame, prefix: str = "z_") -> DataFrame:
        return df.withColumns({f"{prefix}{f}": self.z(f) for f in self.means})


def top_contributions(features: Sequence[str], n: int = 3, prefix: str = "z_") -> Column:
    """The n features with the largest absolute z, as ``name (z=1.23)``."""
    entries = F.array(*[
        F.struct((-F.abs(F.col(f"{prefix}{f}"))).alias("order"), F.lit(f).alias("name"), F.col(f"{prefix}{f}").alias("z"))
        for f in features])
    return F.transform(F.slice(F.array_sort(entries), 1, n), lambda e: F.concat(
        e["name"], F.lit(" (z="), F.round(e["z"], 2).cast("decimal(20,2)").cast("string"), F.lit(")")))


def reconstruction_error(train: DataFrame, df: DataFrame, features: Sequence[str], k: int, name: str = "reconstruction_error") -> DataFrame:
    """Mean squared error after projecting standardised rows on k principal axes.

    The axes are orthonormal, so the lost energy is the row's squared length
    minus that of its projection; no inverse transform is needed.
    """
    scaler = Scaler.fit(train, features)
    columns = [f"z_{f}" for f in features]
    model = PCA(k=k, inputCol="_features", outputCol="_projected").fit(_vectors(scaler.transform(train), columns))
    projected = model.transform(_vectors(scaler.transform(df), columns))

    def energy(values: Column) -> Column:
        return F.aggregate(values, F.lit(0.0), lambda total, v: total + v * v)

    lost = energy(F.array(*[F.col(c) for c in columns])) - energy(vector_to_array("_projected"))
    return projected.withColumn(name, F.greatest(lost, F.lit(0.0)) / len(columns)).select(*df.columns, name)


def record_verdicts(df: DataFrame, features: Sequence[str], thresholds: Mapping[str, float], cut: float,
                    score: str = "anomaly_score") -> DataFrame:
    """Tier, anomaly flag, recommended action and top features per scored record.

    Needs the standardised columns of ``Scaler.transform``.
    """
    tier = risk_tier(F.col(score), thresholds)
    action = (F.when(tier.isin("L4", "L5"), "Immediate Escalation / Audit").when(tier == "L3", "Sampled Review")
              .otherwise("Automated Pass"))
    return df.withColumns({
        "risk_level": tier, "is_anomaly": F.col(score) >= cut, "recommended_action": action,
        "top_contributing_features": top_contributions(features)})
