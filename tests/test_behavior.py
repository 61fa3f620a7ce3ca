from __future__ import annotations

import random

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from tallywatch.operators.behavior import _FEATURES, account_history, behavioral_features, whole_account_features
from tallywatch.operators.ordered import position_in_group, previous_in_group
from tests.models import frame, sequential_behavior, transaction


def check(spark, rows, gap_mode="retained", width=1 << 20):
    want = sequential_behavior(rows, gap_mode)
    got = {r["event_id"]: r.asDict() for r in
           behavioral_features(frame(spark, rows), gap_mode=gap_mode, width=width).collect()}
    assert set(got) == set(want)
    for event, features in want.items():
        for name, value in features.items():
            assert got[event][name] == pytest.approx(value, abs=1e-9), (event, name)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(data=st.lists(st.tuples(st.integers(0, 80), st.sampled_from("ab"), st.sampled_from("xyz"),
                               st.sampled_from(["CASH_OUT", "TRANSFER", "PAYMENT"]), st.integers(0, 500)),
                     min_size=1, max_size=60),
       mode=st.sampled_from(["retained", "last"]), width=st.sampled_from([1, 3, 1 << 20]))
def test_windows_match_the_sequential_model(spark, data, mode, width):
    rows = [transaction(i, step, account, target, float(amount), kind)
            for i, (step, account, target, kind, amount) in enumerate(data)]
    check(spark, rows, mode, width)


def test_hot_account_and_hot_step_in_small_blocks(spark):
    """A third of all rows in one account, most of them in one step and to one destination."""
    rng = random.Random(3)
    rows = []
    for i in range(900):
        hot = i % 3 == 0
        rows.append(transaction(
            i, 40 if hot and i % 2 == 0 else rng.randrange(100), "HOT" if hot else f"C{rng.randrange(40)}",
            "M0" if hot and i % 5 else f"M{rng.randrange(9)}", float(rng.randrange(1, 90)),
            rng.choice(["CASH_OUT", "TRANSFER", "PAYMENT"])))
    check(spark, rows, width=16)


def test_no_window_holds_a_whole_account(spark):
    """Row windows are keyed by cell; only aggregated tables are windowed by account."""
    df = behavioral_features(frame(spark, [transaction(1, 1)]))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    row_window = plan[:plan.index("Union")]
    assert "[_key" in row_window and "_block" in row_window
    for line in plan.splitlines():
        if "Window" in line and "_marker" in line:
            assert "_block" in line


def test_first_row_has_empty_history(spark):
    row = behavioral_features(frame(spark, [transaction(1, 5, old=0.0, new=0.0)])).first()
    assert row["orig_new_destination"] == 1.0
    assert all(row[f] == 0.0 for f in _FEATURES if f != "orig_new_destination")


@pytest.mark.parametrize("old,new,ratio", [(100.0, 0.0, 1.0), (100.0, 60.0, 0.4), (100.0, 150.0, 0.0), (0.0, 5.0, 0.0)])
def test_balance_depletion(spark, old, new, ratio):
    row = behavioral_features(frame(spark, [transaction(1, 1, old=old, new=new)])).first()
    assert row["orig_balance_depletion_ratio"] == pytest.approx(ratio)


def test_window_edges_are_inclusive(spark):
    rows = [transaction(1, 0), transaction(2, 24), transaction(3, 49)]
    got = {r["event_id"]: r for r in behavioral_features(frame(spark, rows)).collect()}
    assert got[2]["orig_tx_count_24steps"] == 1.0 and got[2]["orig_time_since_prev_step"] == 24.0
    assert got[3]["orig_tx_count_24steps"] == 0.0 and got[3]["orig_time_since_prev_step"] == 0.0
    assert got[3]["orig_new_destination"] == 1.0


def test_unknown_gap_mode_is_refused(spark):
    with pytest.raises(ValueError):
        behavioral_features(frame(spark, [transaction(1, 1)]), gap_mode="other")


def test_history_and_whole_account(spark):
    rows = [transaction(i, s, target=t) for i, (s, t) in enumerate([(0, "a"), (10, "b"), (30, "a"), (30, "a")])]
    assert sorted(r["event_id"] for r in account_history(frame(spark, rows)).collect()) == [1, 2, 3]
    whole = {r["event_id"]: r for r in whole_account_features(frame(spark, rows)).collect()}
    assert [whole[i]["orig_time_since_prev_step"] for i in range(4)] == [0.0, 10.0, 20.0, 0.0]
    assert whole[0]["orig_unique_destinations_24steps"] == 2.0 and whole[0]["orig_new_destination"] == 0.0


def test_position_and_lag_cross_blocks(spark):
    df = spark.range(500).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 7)).alias("k"),
                                 "id", (F.col("id") * 2).alias("v"))
    want_position, want_lag, last = {}, {}, {}
    for row in sorted(df.collect(), key=lambda r: r["id"]):
        count, value = last.get(row["k"], (0, None))
        want_position[row["id"]], want_lag[row["id"]] = count + 1, value
        last[row["k"]] = (count + 1, row["v"])
    got = position_in_group(df, ["k"], "id", width=8).collect()
    assert {r["id"]: r["position"] for r in got} == want_position
    lagged = previous_in_group(df, ["k"], "id", {"before": "v"}, F.floor(F.col("id") / 8)).collect()
    assert {r["id"]: r["before"] for r in lagged} == want_lag
