"""Column contracts of the transaction pipeline."""

from __future__ import annotations

from pyspark.sql import types as T

# Wire and model contracts.
TRANSACTION_TYPES = ["CASH_IN", "CASH_OUT", "DEBIT", "PAYMENT", "TRANSFER"]
RISK_TIERS = ["L1", "L2", "L3", "L4", "L5"]

BASE_FEATURES = [
    "step", "amount",
    "oldbalanceOrg", "newbalanceOrig", "oldbalanceDest", "newbalanceDest",
    "orig_balance_change", "dest_balance_change", "orig_balance_error", "dest_balance_error",
    "orig_zero_after", "dest_zero_before", "dest_zero_after",
    "log_amount",
    "type_CASH_IN", "type_CASH_OUT", "type_DEBIT", "type_PAYMENT", "type_TRANSFER",
]
BEHAVIOR_FEATURES = [
    "orig_tx_count_1step", "orig_tx_count_6steps", "orig_tx_count_24steps",
    "orig_amount_sum_6steps", "orig_amount_sum_24steps",
    "orig_avg_amount_6steps", "orig_avg_amount_24steps",
    "orig_amount_ratio_to_avg_24steps", "orig_time_since_prev_step",
    "orig_unique_destinations_24steps",
    "orig_cashout_count_24steps", "orig_transfer_count_24steps",
    "orig_new_destination", "orig_balance_depletion_ratio",
]
MODEL_FEATURES = BASE_FEATURES + BEHAVIOR_FEATURES
LABEL_AND_KEY_COLUMNS = ["isFraud", "isFlaggedFraud", "nameOrig", "nameDest"]

CSV_COLUMNS = [
    "step", "type", "amount", "nameOrig", "oldbalanceOrg", "newbalanceOrig",
    "nameDest", "oldbalanceDest", "newbalanceDest", "isFraud", "isFlaggedFraud",
]
DECISION_PAYLOAD = [
    "transaction_id", "event_time", "source", "batch_id", "producer_sequence",
    "step", "event_step", "type", "amount",
    "nameOrig", "oldbalanceOrg", "newbalanceOrig",
    "nameDest", "oldbalanceDest", "newbalanceDest",
    "anomaly_score", "risk_level", "alert_required", "risk_action", "model_version",
    "xgboost_probability", "xgboost_threshold", "xgboost_prediction", "xgboost_model_version",
    "final_prediction", "final_decision_path", "final_risk_action",
]

_S, _I, _L, _D = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields.items()])


TRANSACTION_EVENT = _struct(
    transaction_id=_S, event_time=_S, source=_S, batch_id=_S, producer_sequence=_I,
    step=_I, event_step=_I, type=_S, amount=_D,
    nameOrig=_S, oldbalanceOrg=_D, newbalanceOrig=_D,
    nameDest=_S, oldbalanceDest=_D, newbalanceDest=_D,
    isFraud=_I, isFlaggedFraud=_I,
)
CSV_TYPED = _struct(
    step=_I, type=_S, amount=_D, nameOrig=_S, oldbalanceOrg=_D, newbalanceOrig=_D,
    nameDest=_S, oldbalanceDest=_D, newbalanceDest=_D, isFraud=_I, isFlaggedFraud=_I,
)
CSV_TEXT = _struct(**{name: _S for name in CSV_COLUMNS})


def require_feature_contract(columns: list[str]) -> list[str]:
    """Names and order must match the model contract, without labels or keys."""
    leaked = sorted(set(columns) & set(LABEL_AND_KEY_COLUMNS))
    if leaked:
        raise ValueError(f"label or key columns used as features: {leaked}")
    if list(columns) != MODEL_FEATURES:
        raise ValueError("feature columns differ from the ordered model contract")
    return list(columns)
