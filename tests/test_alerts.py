"""Alert rules by event-time timers: equal to the batch form over many micro-batches, and firing without a new row."""

from __future__ import annotations

import random
import tempfile
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tallywatch.operators import monitor
from tallywatch.sources import readers
from tallywatch.streaming import alerts, router, stateful

START = datetime(2024, 5, 1)
SCHEMA = "series string, ts timestamp, bad boolean"


def run_rule(spark, parts, delay="5 minutes", **rule):
    """Rows of the rule's stream with their micro-batch; each part is one file and one micro-batch."""
    stateful.use_rocksdb(spark)
    folder = tempfile.mkdtemp(prefix="tallywatch-test-")
    for part in parts:
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    schema = spark.read.parquet(f"{folder}/in").schema
    stream = alerts.alert_stream(readers.file_events(spark, f"{folder}/in", schema, maxFilesPerTrigger=1), ["series"], delay=delay, **rule)
    started = (stream.writeStream.foreachBatch(lambda batch, number: router.write_batch(batch, f"{folder}/out", number))
               .outputMode("append").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start())
    started.awaitTermination()
    return spark.read.parquet(f"{folder}/out")


def at(minute, second=0):
    return START + timedelta(minutes=minute, seconds=second)


def random_parts(seed, files=5, minutes=240):
    """Rows of three series and a null one in the order of time but for some minutes of disorder, cut into files."""
    draw = random.Random(seed)
    rows = []
    for name, gap in (("busy", 0.2), ("some", 4), ("rare", 40), (None, 9)):
        t = draw.uniform(0, 30)
        while t < minutes:
            rows.append((t + draw.uniform(0, 3), name, at(0) + timedelta(minutes=t), draw.random() < 0.3))
            t += draw.expovariate(1 / gap)
    rows.sort(key=lambda r: r[0])
    cut = -(-len(rows) // files)
    return [[r[1:] for r in rows[i:i + cut]] for i in range(0, len(rows), cut)]


@pytest.mark.parametrize("rule", [{"length": 15, "at_most": 0}, {"length": 10, "at_least": 2, "hold": 4, "wanted": "bad"}])
def test_stream_equals_batch(spark, rule):
    parts = random_parts(3)
    rule = {**rule, "wanted": F.col("bad")} if "wanted" in rule else rule
    rows = run_rule(spark, parts, **rule)
    got = alerts.alert_states(rows, ["series"]).collect()
    everything = [r for part in parts for r in part]
    last = (max(r[1] for r in everything) - timedelta(minutes=5)).replace(second=0, microsecond=0) - timedelta(minutes=1)
    want = monitor.alert_spans(spark.createDataFrame(everything, SCHEMA), ["series"], F.lit(last).cast("timestamp"), **rule).collect()
    assert len(want) > 3 and sorted(map(str, got)) == sorted(map(str, want))
    # One row when it fires and one when it is over, never more.
    assert rows.count() == len(want) + sum(r["active_until"] is not None for r in want)
    assert rows.select("micro_batch").distinct().count() > 1


def brute(rows, until, length, low, high, hold):
    out = []
    for name in {r[0] for r in rows}:
        seen = sorted(int((r[1] - START).total_seconds() // 60) for r in rows if r[0] == name)
        since = None
        for m in range(seen[0], until + 2):
            n = sum(m - length < s <= m for s in seen)
            on = m <= until and n >= low and (high is None or n <= high)
            if on and since is None:
                since = m
            elif not on and since is not None:
                if m - 1 - since >= hold:
                    out.append((name, at(since), at(since + hold), None if m > until else at(m - 1)))
                since = None
    return out


@pytest.mark.parametrize("limits", [(0, 0, 0), (0, 0, 12), (3, None, 0), (1, 2, 5)])
def test_batch_form_equals_brute_force(spark, limits):
    low, high, hold = limits
    rows = [r for part in random_parts(11) for r in part]
    got = monitor.alert_spans(spark.createDataFrame(rows, SCHEMA), ["series"], F.lit(at(200)).cast("timestamp"), length=12,
                              at_least=low or None, at_most=high, hold=hold).collect()
    want = brute([r for r in rows if r[1] < at(201)], 200, 12, low, high, hold)
    assert want and sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, want))


def test_silence_fires_by_a_timer_and_a_span_over_batches_fires_once(spark):
    parts = [[("gone", at(0), False), ("gone", at(2), False), ("back", at(1), False)],
             [("other", at(9), False)],
             [("other", at(40), False), ("back", at(36), False)],
             [("other", at(90), False)]]
    rows = run_rule(spark, parts, length=20, at_most=0).orderBy("micro_batch", "series", "state").collect()
    found = [(r["series"], r["state"], r["active_since"], r["active_until"]) for r in rows]
    assert ("gone", "firing", at(22), None) in found and ("back", "firing", at(21), None) in found
    assert ("back", "resolved", at(21), at(35)) in found
    assert not [f for f in found if f[0] == "gone" and f[1] == "resolved"] and len(found) == len(set(found))
    when = {(r["series"], r["active_since"], r["state"]): r["micro_batch"] for r in rows}
    # The last row of "gone" is in the first file; its alert fires when other series have moved the time on.
    assert 1 < when["gone", at(22), "firing"] < when["back", at(56), "firing"]


def test_limits_that_say_nothing_are_refused():
    for limits in ((None, None), (0, None), (4, 2)):
        with pytest.raises(ValueError):
            monitor.rule_limits(*limits)
    assert monitor.rule_limits(None, 0) == (0, 0) and monitor.rule_limits(3, None) == (3, None)


def test_empty_table_has_no_spans(spark):
    assert monitor.alert_spans(spark.createDataFrame([], SCHEMA), ["series"], F.lit(at(5)).cast("timestamp"), at_most=0).count() == 0


def test_stream_without_alerts_gives_no_rows(spark, tmp_path):
    """Events so dense that no rule fires: the query ends with an empty result."""
    from tallywatch.plans import jobs

    rows = spark.range(40).selectExpr("id AS event_id", "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 10 * CAST(id AS INT)) AS ts",
                                      "1L AS user_id", "'view' AS event_type", "5.0D AS value", "'{}' AS props")
    rows.coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    source = next((tmp_path / "events.parquet").glob("*.parquet"))
    folder = tmp_path / "data"
    folder.mkdir()
    source.rename(folder / "events.parquet")
    assert jobs.streamed_alert_spans(spark, str(folder)).collect() == []
