from __future__ import annotations

import uuid
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from tallywatch.functions.ids import alert_id, uuid5_url
from tallywatch.functions.times import parse_event_time
from tallywatch.operators import features, route, validate
from tallywatch.operators.ordered import exact_quantiles
from tallywatch.schema import MODEL_FEATURES, require_feature_contract

EVENT = ("transaction_id string, step int, type string, amount double, nameOrig string, nameDest string, "
         "oldbalanceOrg double, newbalanceOrig double, oldbalanceDest double, newbalanceDest double")
GOOD = ("t1", 1, "TRANSFER", 10.0, "C1", "M1", 100.0, 90.0, 0.0, 10.0)


def event(**changes):
    names = [p.split()[0] for p in EVENT.split(", ")]
    return tuple(changes.get(n, v) for n, v in zip(names, GOOD))


def test_rejects_name_their_rules(spark):
    df = spark.createDataFrame([event(), event(type="WIRE"), event(amount=-1.0), event(nameDest=None), event(step=None, amount=None)], EVENT)
    good, bad = validate.split_rejects(df, validate.transaction_rules())
    assert good.count() == 1 and validate.validate_transactions(df).count() == 1
    assert sorted(tuple(r["violations"]) for r in bad.collect()) == [
        ("missing:nameDest",), ("missing:step", "missing:amount"), ("negative:amount",), ("unknown:type",)]


def test_manual_bounds(spark):
    names = [p.split()[0] for p in EVENT.split(", ")]
    df = spark.createDataFrame([event(), event(amount=2e15), event(nameOrig="x" * 129), event(step=-1), event(amount=float("nan"))], EVENT)
    rules = validate.manual_event_rules([n for n in names if n != "transaction_id"])
    _, bad = validate.split_rejects(df, rules)
    assert sorted(r["violations"][0] for r in bad.collect()) == ["length:nameOrig", "range:amount", "range:amount", "range:step"]
    forbidden = validate.manual_event_rules([*names, "extra"])
    assert "forbidden:extra" in forbidden and "forbidden:transaction_id" in forbidden


def test_base_features(spark):
    row = features.base_features(spark.createDataFrame([event(newbalanceOrig=0.0)], EVENT)).first()
    assert (row["orig_balance_change"], row["dest_balance_change"], row["orig_balance_error"]) == (100.0, 10.0, -90.0)
    assert (row["orig_zero_after"], row["dest_zero_before"], row["dest_zero_after"]) == (1.0, 1.0, 0.0)
    assert row["type_TRANSFER"] == 1.0 and row["type_DEBIT"] == 0.0
    with pytest.raises(ValueError):
        require_feature_contract([*MODEL_FEATURES, "isFraud"])


def test_non_finite_rows(spark):
    df = spark.createDataFrame([(1, 1.0), (2, float("nan")), (3, float("inf")), (4, None)], "id int, v double")
    report = features.finite_report(df, ["v"]).first()
    assert (report["null_count"], report["nan_count"], report["inf_count"]) == (1, 1, 1)
    good, bad = features.reject_non_finite(df, ["v"])
    assert [r["id"] for r in good.collect()] == [1] and bad.count() == 3
    with pytest.raises(Exception, match="non-finite"):
        features.require_finite(df, ["v"]).collect()


@pytest.mark.parametrize("score,tier", [(-0.02, "L1"), (route.DEFAULT_THRESHOLDS["T1"], "L2"), (0.0045, "L3"),
                                        (0.06, "L4"), (route.DEFAULT_THRESHOLDS["T4"], "L5"), (1.0, "L5")])
def test_tier_edges_are_half_open(spark, score, tier):
    df = spark.createDataFrame([(score,)], "s double")
    assert df.select(route.risk_tier(F.col("s")).alias("t")).first()["t"] == tier


def test_thresholds_must_increase(spark):
    with pytest.raises(ValueError):
        route.risk_tier(F.col("s"), {"T1": 0.1, "T2": 0.1, "T3": 0.2, "T4": 0.3})


def test_second_stage_alert_keeps_its_tier_action(spark):
    df = spark.createDataFrame([(-0.5, 0.9), (-0.5, 0.1), (0.5, 0.1)], "anomaly_score double, second_stage_probability double")
    out = route.decide(route.assign_tiers(df)).collect()
    hit, low, direct = out
    assert (hit["alert_required"], hit["risk_action"], hit["final_risk_action"]) == (0, "ALLOW_STORE", "FRAUD_ALERT")
    assert hit["final_decision_path"] == "L1/L2 -> XGBoost -> fraud-alerts"
    assert (low["final_prediction"], low["final_risk_action"]) == (0, "LOW_RISK_STORE")
    assert direct["xgboost_probability"] is None and direct["final_risk_action"] == "CRITICAL_INVESTIGATE"
    counts = route.decision_counts(route.decide(route.assign_tiers(df))).first()
    assert (counts["total"], counts["direct_alerts"], counts["second_stage_alerts"], counts["low_risk"]) == (3, 1, 1, 1)
    alerts, rest = route.split_routes(route.decide(route.assign_tiers(df)))
    assert alerts.count() == 2 and rest.count() == 1


def test_alert_ids(spark):
    df = spark.createDataFrame([("txn-1", None), ("txn-1", "given"), (None, None)], "transaction_id string, alert_id string")
    ids = [r[0] for r in df.select(alert_id(F.col("alert_id"), F.col("transaction_id"), ["transaction_id"])).collect()]
    assert ids[0] == str(uuid.uuid5(uuid.NAMESPACE_URL, "fraud-alert:txn-1"))
    assert ids[1] == "given" and ids[2].startswith("alert_") and len(ids[2]) == 70
    many = [f"n{i}é" for i in range(200)]
    got = spark.createDataFrame([(m,) for m in many], "n string").select("n", uuid5_url(F.col("n")).alias("u")).collect()
    assert all(r["u"] == str(uuid.uuid5(uuid.NAMESPACE_URL, r["n"])) for r in got)


def test_normalized_alert(spark):
    df = spark.createDataFrame([("txn-1", "TRANSFER", "C1", "2026-01-15T10:30:00+00:00")],
                               "transaction_id string, type string, nameOrig string, event_time string")
    row = validate.normalize_alerts(df).first()
    assert (row["transaction_type"], row["name_orig"], row["event_date"], row["event_hour"]) == ("TRANSFER", "C1", "2026-01-15", 10)
    assert "type" not in row.asDict()
    kept = spark.createDataFrame([("t", "RAW", "KEPT")], "transaction_id string, type string, transaction_type string")
    assert validate.normalize_alerts(kept).first()["transaction_type"] == "KEPT"


@pytest.mark.parametrize("text,want", [
    ("2026-01-15T10:30:00Z", datetime(2026, 1, 15, 10, 30)), ("2026-01-15T10:30:00+05:30", datetime(2026, 1, 15, 5, 0)),
    ("2026-01-15 10:30:00.250000", datetime(2026, 1, 15, 10, 30, 0, 250000)), ("2026-01-15", datetime(2026, 1, 15)),
    ("2026-01-15T10:30", datetime(2026, 1, 15, 10, 30)), ("  ", None), ("yesterday", None), ("2026-13-40T00:00:00Z", None)])
def test_event_time(spark, text, want):
    got = spark.createDataFrame([(text,)], "t string").select(
        F.unix_micros(parse_event_time(F.col("t"))).alias("m")).first()["m"]
    assert got == (None if want is None else int(want.replace(tzinfo=timezone.utc).timestamp() * 1_000_000))


def test_redaction_at_any_depth(spark):
    df = spark.createDataFrame([(1, "x", {"a": 1, "api_token": 2}, [(1, "p")])],
                               "id int, Password string, m map<string,int>, l array<struct<v:int,client_secret:string>>")
    clean = validate.drop_sensitive(df)
    assert clean.columns == ["id", "m", "l"]
    row = clean.first()
    assert row["m"] == {"a": 1} and row["l"][0].asDict() == {"v": 1}


def test_row_builders_keep_nulls_and_reject(spark):
    base = {"transaction_id": "t", "event_time": "2026-01-01T05:00:00Z", "type": "DEBIT", "nameOrig": "C", "nameDest": "M",
            "amount": 1.0, "oldbalanceOrg": 1.0, "newbalanceOrig": 0.0, "oldbalanceDest": 0.0, "newbalanceDest": 1.0,
            "anomaly_score": 0.1, "risk_level": "L3", "risk_action": "INVESTIGATE", "final_prediction": 1,
            "final_decision_path": "p", "model_version": "m", "source": "paysim", "alert_required": 1,
            "final_risk_action": "INVESTIGATE", "xgboost_probability": None, "xgboost_prediction": None, "status": ""}
    schema = ", ".join(f"{k} " + ("double" if isinstance(v, float) or k == "xgboost_probability" else
                                  "int" if isinstance(v, int) or k == "xgboost_prediction" else "string") for k, v in base.items())
    df = spark.createDataFrame([tuple(base.values()), tuple((base | {"event_time": "bad"}).values()),
                                tuple((base | {"source": ""}).values())], schema)
    good, bad = validate.alert_rows(df)
    row = good.first()
    assert row["xgboost_prediction"] is None and row["final_prediction"] is True and row["status"] == "NEW"
    assert row["alert_id"] == str(uuid.uuid5(uuid.NAMESPACE_URL, "fraud-alert:t"))
    assert sorted(v for r in bad.collect() for v in r["violations"]) == ["invalid:event_time", "missing:source"]
    assert validate.transaction_rows(df)[0].count() == 1


def test_exact_quantiles_of_a_hot_value(spark):
    import numpy as np

    values = [5.0] * 700 + [float(i % 97) / 3 for i in range(1300)]
    df = spark.createDataFrame([(("a" if i % 3 else "b"), v) for i, v in enumerate(values)], "g string, v double")
    rows = exact_quantiles(df, "v", [0.0, 0.1, 0.5, 0.99, 1.0], ["g"]).collect()
    for row in rows:
        mine = [v for i, v in enumerate(values) if ("a" if i % 3 else "b") == row["g"]]
        assert row["quantile"] == pytest.approx(float(np.quantile(mine, row["share"])), abs=1e-12)
    assert len(rows) == 10


def test_impute_touches_only_holes(spark):
    df = spark.createDataFrame([(1.0, "a", 1), (None, None, 2), (3.0, "b", 3)], "v double, c string, i int")
    rows = validate.impute(df, ["v", "i"], ["c"]).collect()
    assert [(r["v"], r["c"]) for r in rows] == [(1.0, "a"), (2.0, "Unknown"), (3.0, "b")]


@pytest.mark.parametrize("broadcast_groups", [0, 100])
def test_quantiles_of_large_groups(spark, broadcast_groups):
    """Brackets that are broadcast and brackets that are joined by shuffle both equal numpy."""
    import numpy as np

    rng = np.random.default_rng(4)
    values = np.round(np.concatenate([rng.exponential(30, 40_000), np.full(20_000, 12.5)]), 3)
    df = spark.createDataFrame([(int(i % 4 == 0), float(v)) for i, v in enumerate(values)], "g int, v double").repartition(7)
    shares = [0.0, 0.01, 0.5, 0.6, 0.95, 0.999, 1.0]
    for groups in ([], ["g"]):
        rows = exact_quantiles(df, "v", shares, groups, broadcast_groups=broadcast_groups).collect()
        assert len(rows) == len(shares) * (2 if groups else 1)
        for row in rows:
            mine = values if not groups else values[(np.arange(len(values)) % 4 == 0) == bool(row["g"])]
            assert row["quantile"] == pytest.approx(float(np.quantile(mine, row["share"])), abs=1e-9)
            assert row["n"] == len(mine)


def test_ranks_of_many_small_and_odd_groups(spark):
    from tallywatch.operators.ordered import rank_values

    rows = [(f"g{i % 700}" if i % 700 else None, (i * 7919) % 1000) for i in range(3000)] + [("only", 5), ("none", None), ("inf", 10**15)]
    df = spark.createDataFrame(rows, "g string, v long").repartition(5)
    groups = {}
    for g, v in rows:
        if v is not None:
            groups.setdefault(g, []).append(v)
    for bound in (0, 10_000):
        got = rank_values(df, "v", [0.25, 1.0], ["g"], interpolate=False, broadcast_groups=bound).collect()
        want = {(g, s): sorted(vs)[min(int(s * len(vs)), len(vs) - 1)] for g, vs in groups.items() for s in (0.25, 1.0)}
        assert {(r["g"], r["share"]): r["quantile"] for r in got} == want and len(got) == len(want)
    assert exact_quantiles(df.limit(0), "v", [0.5]).count() == 0 and exact_quantiles(df.where("v IS NULL"), "v", [0.5], ["g"]).count() == 0
    plan = rank_values(df, "v", [0.5])._jdf.queryExecution().optimizedPlan().toString()
    assert "NestedLoop" not in plan and "Join Cross" not in plan


def test_leading_rows_by_selection(spark):
    from tallywatch.operators.ordered import leading_rows

    df = spark.range(5000).select("id", (F.col("id") % 50).alias("v"), F.concat(F.lit("C"), F.col("id")).alias("name")).repartition(6)
    big = leading_rows(df, "v", 1234).collect()
    assert len(big) == 1234 and sorted(r["v"] for r in big) == sorted(i % 50 for i in range(5000))[:1234]
    newest = {r["id"] for r in leading_rows(df, "id", 1500, descending=True).collect()}
    assert newest == set(range(3500, 5000))
    prefix = F.conv(F.rpad(F.hex(F.substring(F.encode("name", "UTF-8"), 1, 3)), 6, "0"), 16, 10).cast("long")
    names = sorted(r["name"] for r in leading_rows(df, "name", 2000, position=prefix).collect())
    assert names == sorted(f"C{i}" for i in range(5000))[:2000]
    assert leading_rows(df, "id", 9000).count() == 5000


def test_leading_rows_count_nulls_for_any_k(spark):
    from tallywatch.operators.ordered import leading_rows

    df = spark.createDataFrame([(i, None if i % 10 == 0 else float(i % 700)) for i in range(5000)], "id long, v double")
    for k in (0, 1, 400, 500, 900, 1500, 4999, 6000):
        for descending in (False, True):
            rows = leading_rows(df, "v", k, descending, tie="id").collect()
            key = lambda r: ((r["v"] is not None) != descending, (-r["v"] if descending else r["v"]) if r["v"] is not None else 0, r["id"])
            assert {r["id"] for r in rows} == {r["id"] for r in sorted(df.collect(), key=key)[:k]}
            assert len(rows) == min(k, 5000)


def test_alert_names_are_merged_row_by_row(spark):
    df = spark.createDataFrame([("PAYMENT", None), (None, "DEBIT"), ("A", "B")], "type string, transaction_type string")
    assert [r["transaction_type"] for r in validate.normalize_alerts(df).collect()] == ["PAYMENT", "DEBIT", "B"]
