"""Values that are computed once for each row: chunks of long texts, event times and broken rules of payloads."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from tallywatch.functions.bound import bound, with_bound
from tallywatch.functions.times import parse_event_time
from tallywatch.operators import chunking, validate


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_words_of_a_text_are_not_cut_out_again_for_each_run(spark):
    text = " \n" + " ".join(f"w{i}" for i in range(3000)) + "\x85 "
    df = spark.createDataFrame([(1, text), (2, None), (3, " 　"), (4, " a b ")], "doc int, text string")
    rows = chunking.chunk_documents(df, "doc").orderBy("doc", "chunk_index").collect()
    assert [(r.doc, len(r.chunk.split())) for r in rows] == [(1, 700), (1, 800), (1, 800), (1, 800), (1, 300), (4, 2)]
    assert rows[0].chunk.startswith("w0 w1 ") and rows[4].chunk.endswith(" w2999") and rows[5].chunk == "a b"
    assert len(re.findall(r"\bsplit\(", _plan(chunking.chunk_documents(df, "doc")))) <= 8


def test_event_time_and_rules_are_worked_out_once_for_all_columns(spark):
    fields = {f: F.lit("x") for f in validate.REQUIRED_ALERT_ROW} | {
        "amount": F.col("id") * 1.0, "event_time": F.concat(F.lit("2024-05-0"), F.col("id").cast("string"), F.lit(" 07")),
        "xgboost_probability": F.lit(0.5), "xgboost_prediction": F.lit(1), "final_prediction": F.lit(1), "alert_required": F.lit(1),
        "anomaly_score": F.lit(0.1), "violations": F.lit("old"), "_moment": F.lit("kept")}
    for name in ("oldbalanceOrg", "newbalanceOrig", "oldbalanceDest", "newbalanceDest"):
        fields[name] = F.lit(1.0)
    df = spark.range(0, 12).select("id", *(c.alias(n) for n, c in fields.items()))
    for make in (validate.alert_rows, validate.transaction_rows):
        good, bad = make(df)
        assert _plan(good).count("try_to_timestamp") + _plan(good).count("gettimestamp") <= 1
        assert [str(r.event_date) for r in good.select("event_date").orderBy("event_date").collect()] == [f"2024-05-0{i}" for i in range(1, 10)]
        assert {r.event_hour for r in good.collect()} == {7}
        assert sorted((r.id, r._moment, tuple(r.violations)) for r in bad.collect()) == [(i, "kept", ("invalid:event_time",)) for i in (0, 10, 11)]


def test_bound_values_may_be_null(spark):
    df = spark.createDataFrame([(1, None), (2, "2024-01-02T03")], "k int, t string")
    out = with_bound(df, "T", parse_event_time(F.col("t"))).select("k", F.hour("T").alias("h"), bound(F.col("T"), lambda x: x.isNull()).alias("none"))
    assert sorted(map(tuple, out.collect())) == [(1, None, True), (2, 3, False)]
