"""Event validation: rules, rejects that name the broken rules, normalisation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tallywatch.functions.bound import with_bound
from tallywatch.functions.ids import alert_id
from tallywatch.functions.times import parse_event_time
from tallywatch.schema import TRANSACTION_TYPES

# Rule inputs.
REQUIRED_EVENT_FIELDS = [
    "transaction_id", "step", "type", "amount", "nameOrig", "nameDest",
    "oldbalanceOrg", "newbalanceOrig", "oldbalanceDest", "newbalanceDest",
]
NON_NEGATIVE_FIELDS = ["amount", "oldbalanceOrg", "newbalanceOrig", "oldbalanceDest", "newbalanceDest"]
REQUIRED_TRANSACTION_ROW = [
    "transaction_id", "event_time", "type", "nameOrig", "nameDest", "amount",
    "oldbalanceOrg", "newbalanceOrig", "oldbalanceDest", "newbalanceDest",
    "anomaly_score", "risk_level", "risk_action", "final_prediction",
    "final_decision_path", "model_version", "source",
]
REQUIRED_ALERT_ROW = REQUIRED_TRANSACTION_ROW + ["alert_required", "final_risk_action"]
MANUAL_EVENT_FIELDS = ["step", "event_step", "type", "amount", "nameOrig", "oldbalanceOrg", "newbalanceOrig",
                       "nameDest", "oldbalanceDest", "newbalanceDest"]
MAX_STEP = 2_147_483_647
MAX_AMOUNT = 1e15
MAX_ID_LENGTH = 128
FIELD_ALIASES = {
    "type": "transaction_type", "nameOrig": "name_orig", "nameDest": "name_dest",
    "oldbalanceOrg": "old_balance_orig", "newbalanceOrig": "new_balance_orig",
    "oldbalanceDest": "old_balance_dest", "newbalanceDest": "new_balance_dest",
}


def transaction_is_valid() -> Column:
    """Required fields present, a known type, no negative money."""
    rule = F.col("type").isin(TRANSACTION_TYPES)
    for name in REQUIRED_EVENT_FIELDS:
        rule = rule & F.col(name).isNotNull()
    for name in NON_NEGATIVE_FIELDS:
        rule = rule & (F.col(name) >= 0)
    return rule


def validate_transactions(df: DataFrame) -> DataFrame:
    return df.where(transaction_is_valid())


def violations(rules: Mapping[str, Column]) -> Column:
    """Names of the rules that a row breaks, in rule order. Rules state the breach."""
    return F.array_compact(F.array(*[F.when(F.coalesce(broken, F.lit(False)), F.lit(name))
                                     for name, broken in rules.items()]))


def split_rejects(df: DataFrame, rules: Mapping[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(passing rows, rejected rows with a ``violations`` column)."""
    marked = with_bound(df, "violations", violations(rules))
    return marked.where(F.size("violations") == 0).drop("violations"), marked.where(F.size("violations") > 0)


def transaction_rules() -> dict[str, Column]:
    rules = {f"missing:{name}": F.col(name).isNull() for name in REQUIRED_EVENT_FIELDS}
    rules["unknown:type"] = ~F.col("type").isin(TRANSACTION_TYPES)
    rules.update({f"negative:{name}": F.col(name) < 0 for name in NON_NEGATIVE_FIELDS})
    return rules


def required_field_rules(fields: Sequence[str]) -> dict[str, Column]:
    """Missing or empty payload fields, each named."""
    return {f"missing:{name}": F.col(name).isNull() | (F.col(name).cast("string") == "") for name in fields}


def manual_event_rules(columns: Sequence[str]) -> dict[str, Column]:
    """Bounds on a hand-entered event; a column outside the form is forbidden."""
    rules: dict[str, Column] = {}
    for name in ("step", "event_step"):
        if name in columns:
            rules[f"range:{name}"] = (F.col(name) < 0) | (F.col(name) > MAX_STEP)
    rules["missing:step"] = F.col("step").isNull()
    rules["unknown:type"] = F.col("type").isNull() | ~F.col("type").isin(TRANSACTION_TYPES)
    for name in NON_NEGATIVE_FIELDS:
        value = F.col(name)
        rules[f"range:{name}"] = value.isNull() | F.isnan(value) | (value < 0) | (value > MAX_AMOUNT)
    for name in ("nameOrig", "nameDest"):
        size = F.char_length(F.col(name))
        rules[f"length:{name}"] = F.col(name).isNull() | (size < 1) | (size > MAX_ID_LENGTH)
    for name in sorted(set(columns) - set(MANUAL_EVENT_FIELDS)):
        rules[f"forbidden:{name}"] = F.col(name).isNotNull()
    return rules


def normalize_alerts(df: DataFrame) -> DataFrame:
    """One naming for alerts from any source; row by row, a value under the new name wins.

    Adds a stable alert id, the event date and the event hour where absent.
    """
    out = df
    for source, target in FIELD_ALIASES.items():
        if source in out.columns:
            present = [F.col(target)] if target in out.columns else []
            out = out.withColumn(target, F.coalesce(*present, F.col(source))).drop(source)
    supplied = F.col("alert_id") if "alert_id" in out.columns else None
    fields = [c for c in out.columns if c != "alert_id"]
    if "transaction_id" in out.columns:
        out = out.withColumn("transaction_id", F.col("transaction_id").cast("string"))
    else:
        out = out.withColumn("transaction_id", F.lit(None).cast("string"))
    out = out.withColumn("alert_id", alert_id(supplied, F.col("transaction_id"), fields))
    if "event_time" in out.columns:
        moment = parse_event_time(F.col("event_time").cast("string"))
        derived = {"event_date": F.date_format(moment, "yyyy-MM-dd"), "event_hour": F.hour(moment)}
        out = out.withColumns({
            name: F.coalesce(F.col(name).cast("string" if name == "event_date" else "int"), value)
            if name in out.columns else value
            for name, value in derived.items()
        })
    return out


def _with_moment(df: DataFrame) -> tuple[DataFrame, str]:
    """``df`` with the instant of ``event_time``, read once for each row, and the name of that column."""
    name = "_moment"
    while name in {c.lower() for c in df.columns}:
        name += "_"
    return with_bound(df, name, parse_event_time(F.col("event_time"))), name


def _flag(name: str) -> Column:
    return F.col(name).cast("int").cast("boolean")


def _row_columns(moment: Column) -> dict[str, Column]:
    row = {
        "name_orig": F.col("nameOrig").cast("string"), "event_time": moment,
        "transaction_id": F.col("transaction_id").cast("string"),
        "event_date": F.to_date(moment), "event_hour": F.hour(moment),
        "transaction_type": F.col("type").cast("string"), "name_dest": F.col("nameDest").cast("string"),
        "amount": F.col("amount").cast("double"),
        "old_balance_orig": F.col("oldbalanceOrg").cast("double"),
        "new_balance_orig": F.col("newbalanceOrig").cast("double"),
        "old_balance_dest": F.col("oldbalanceDest").cast("double"),
        "new_balance_dest": F.col("newbalanceDest").cast("double"),
        "anomaly_score": F.col("anomaly_score").cast("double"),
        "risk_level": F.col("risk_level"), "risk_action": F.col("risk_action"),
        "xgboost_probability": F.col("xgboost_probability").cast("double"),
        "xgboost_prediction": _flag("xgboost_prediction"), "final_prediction": _flag("final_prediction"),
        "final_decision_path": F.col("final_decision_path"), "model_version": F.col("model_version"),
    }
    return row


def transaction_rows(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows of the transactions table, rejected payloads)."""
    read, name = _with_moment(df)
    moment = F.col(name)
    rules = required_field_rules(REQUIRED_TRANSACTION_ROW) | {"invalid:event_time": moment.isNull()}
    good, bad = split_rejects(read, rules)
    row = _row_columns(moment) | {"source": F.col("source"), "inserted_at": F.current_timestamp()}
    return good.select(*[c.alias(n) for n, c in row.items()]), bad.drop(name)


def alert_rows(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows of the alerts table, rejected payloads)."""
    read, name = _with_moment(df)
    moment = F.col(name)
    rules = required_field_rules(REQUIRED_ALERT_ROW) | {"invalid:event_time": moment.isNull()}
    good, bad = split_rejects(read, rules)
    supplied = F.col("alert_id") if "alert_id" in df.columns else None
    status = F.nullif(F.col("status"), F.lit("")) if "status" in df.columns else F.lit(None)
    row = _row_columns(moment) | {
        "alert_id": alert_id(supplied, F.col("transaction_id")), "alert_required": _flag("alert_required"),
        "final_risk_action": F.col("final_risk_action"), "status": F.coalesce(status, F.lit("NEW")),
        "created_at": F.current_timestamp(),
    }
    return good.select(*[c.alias(n) for n, c in row.items()]), bad.drop(name)


SENSITIVE_WORDS = ["password", "secret", "token", "credential", "private_key"]


def is_sensitive(name: str) -> bool:
    return any(word in name.lower() for word in SENSITIVE_WORDS)


def drop_sensitive(df: DataFrame) -> DataFrame:
    """Remove fields with a sensitive name at any depth of the schema."""

    def clean(value: Column, kind: T.DataType) -> Column:
        if isinstance(kind, T.StructType):
            kept = [f for f in kind.fields if not is_sensitive(f.name)]
            if not kept:
                return F.lit(None).cast("struct<>")
            built = F.struct(*[clean(value[f.name], f.dataType).alias(f.name) for f in kept])
            return F.when(value.isNotNull(), built)
        if isinstance(kind, T.ArrayType) and _holds_struct(kind):
            return F.transform(value, lambda item: clean(item, kind.elementType))
        if isinstance(kind, T.MapType):
            kept_map = value
            if isinstance(kind.keyType, T.StringType):
                pattern = "|".join(SENSITIVE_WORDS)
                kept_map = F.map_filter(value, lambda k, _: ~F.lower(k).rlike(pattern))
            if _holds_struct(kind.valueType):
                kept_map = F.transform_values(kept_map, lambda _, v: clean(v, kind.valueType))
            return kept_map
        return value

    return df.select(*[clean(F.col(f.name), f.dataType).alias(f.name)
                       for f in df.schema.fields if not is_sensitive(f.name)])


def _holds_struct(kind: T.DataType) -> bool:
    if isinstance(kind, T.ArrayType):
        return _holds_struct(kind.elementType)
    return isinstance(kind, (T.StructType, T.MapType))


def impute(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], filler: str = "Unknown") -> DataFrame:
    """Fill numeric nulls with the exact median and categorical nulls with a constant.

    Only columns that hold a null are touched, and only their medians computed.
    """
    from tallywatch.operators.ordered import exact_quantiles

    counted = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in [*numeric, *categorical]]).first()
    fills: dict[str, object] = {c: filler for c in categorical if counted[c]}
    for name in numeric:
        if counted[name]:
            median = exact_quantiles(df.select(F.col(name).cast("double").alias(name)), name, [0.5]).first()
            if median is None:
                raise ValueError(f"{name} has no value to take a median from")
            fills[name] = float(median["quantile"])
    if not fills:
        return df
    return df.withColumns({
        name: F.coalesce(F.col(name), F.lit(value).cast("string" if name in categorical else "double"))
        for name, value in fills.items()
    })


def search_predicate(
    search: str | None = None, transaction_type: str | None = None, risk_level: str | None = None,
    decision: str | None = None, kafka_status: str | None = None, processing_status: str | None = None,
    investigation_status: str | None = None, batch_id: str | None = None,
    amount_min: float | None = None, amount_max: float | None = None,
) -> Column:
    """The optional filters of the ledger page, as one predicate."""
    rule = F.lit(True)
    if search:
        needle = search.lower()
        rule = rule & (F.lower("transaction_id").contains(needle) | F.lower("nameOrig").contains(needle)
                       | F.lower("nameDest").contains(needle))
    for name, value in (("batch_id", batch_id), ("type", transaction_type), ("risk_level", risk_level),
                        ("final_decision", decision), ("kafka_status", kafka_status),
                        ("processing_status", processing_status)):
        if value:
            rule = rule & (F.col(name) == value)
    if investigation_status == "ALL":
        rule = rule & F.col("alert_id").isNotNull()
    elif investigation_status:
        rule = rule & (F.col("investigation_status") == investigation_status)
    if amount_min is not None:
        rule = rule & (F.col("amount") >= amount_min)
    if amount_max is not None:
        rule = rule & (F.col("amount") <= amount_max)
    return rule


def within_distance(df: DataFrame, ceiling: float | None, distance: str = "distance") -> DataFrame:
    """Drop candidates beyond a distance ceiling; no ceiling keeps all."""
    return df if ceiling is None else df.where(F.col(distance) <= ceiling)
