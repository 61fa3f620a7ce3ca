"""Behaviour features on a stream, with compact state per account."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tallywatch.operators.behavior import LOOK_BACK, _FEATURES, account_history

_STEP_KEY = T.StructType([T.StructField("step", T.IntegerType())])
_STEP_TOTALS = T.StructType([
    T.StructField("n", T.LongType()), T.StructField("amount", T.DoubleType()),
    T.StructField("cashouts", T.LongType()), T.StructField("transfers", T.LongType())])
_DEST_KEY = T.StructType([T.StructField("destination", T.StringType())])
_DEST_STEPS = T.StructType([T.StructField("steps", T.ArrayType(T.IntegerType()))])


class AccountBehavior(StatefulProcessor):
    """State is totals per step and steps per destination, pruned to the look-back.

    Its size follows the number of steps and destinations in 24 steps, not the
    number of rows. A row that arrives behind its account's latest step sees only
    steps at or before its own and is marked late.
    """

    def __init__(self, gap_mode: str = "retained", ttl_ms: int | None = None):
        self.gap_mode, self.ttl_ms = gap_mode, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.totals = handle.getMapState("totals", _STEP_KEY, _STEP_TOTALS, self.ttl_ms)
        self.used = handle.getMapState("destinations", _DEST_KEY, _DEST_STEPS, self.ttl_ms)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        """Takes over rows of ``state_history``; they may come in several frames."""
        for step, part in initialState.groupby("step"):
            old = self.totals.getValue((int(step),)) if self.totals.containsKey((int(step),)) else (0, 0.0, 0, 0)
            new = (int(part["n"].sum()), float(part["total"].sum()), int(part["cashouts"].sum()), int(part["transfers"].sum()))
            self.totals.updateValue((int(step),), tuple(a + b for a, b in zip(old, new)))
        for target, part in initialState.groupby("nameDest"):
            old = set(self.used.getValue((target,))[0]) if self.used.containsKey((target,)) else set()
            self.used.updateValue((target,), (sorted(old | {int(s) for s in part["step"]}),))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(["step", "row_order"], kind="stable")
        totals = {k[0]: tuple(v) for k, v in self.totals.iterator()}
        used = {k[0]: set(v[0]) for k, v in self.used.iterator()}
        stored_steps, stored_used = set(totals), {d: frozenset(s) for d, s in used.items()}
        latest = max(totals, default=None)
        features, here = [], None
        for step, amount, target, kind in zip(batch["step"], batch["amount"], batch["nameDest"], batch["type"]):
            step, amount = int(step), float(amount)
            if step != here:
                # Rows are in step order, so the look-back is read once per step and then grows.
                here, seen = step, self._look_back(totals, used, step)
            n24, n6 = seen["n24"], seen["n6"]
            mean24 = seen["a24"] / n24 if n24 else 0.0
            features.append((
                float(seen["n1"]), float(n6), float(n24), seen["a6"], seen["a24"], seen["a6"] / n6 if n6 else 0.0, mean24,
                amount / mean24 if mean24 > 0 else 0.0, 0.0 if seen["last"] is None else float(step - seen["last"]),
                float(len(seen["live"])), float(seen["c24"]), float(seen["t24"]), float(target not in seen["live"]),
                latest is not None and step < latest))
            cashout, transfer = int(kind == "CASH_OUT"), int(kind == "TRANSFER")
            for name, more in (("n1", 1), ("n6", 1), ("n24", 1), ("a6", amount), ("a24", amount), ("c24", cashout),
                               ("t24", transfer)):
                seen[name] += more
            seen["live"].add(target)
            seen["last"] = step
            n, total, cashouts, transfers = totals.get(step, (0, 0.0, 0, 0))
            totals[step] = (n + 1, total + amount, cashouts + cashout, transfers + transfer)
            used.setdefault(target, set()).add(step)
        latest = max(totals)
        self._store(totals, used, stored_steps, stored_used, latest)
        names = [f for f in _FEATURES if f != "orig_balance_depletion_ratio"]
        found = pd.DataFrame(features, columns=[*names, "late"], index=batch.index)
        yield pd.concat([batch, found], axis=1)

    def _look_back(self, totals, used, step) -> dict:
        """Totals at or before a step, inside the windows, and the destinations in use."""
        near = {step - s: t for s, t in totals.items() if 0 <= step - s <= LOOK_BACK}
        known = [s for s in totals if s <= step and (self.gap_mode == "last" or step - s <= LOOK_BACK)]

        def total(span: int, field: int):
            return sum(t[field] for distance, t in near.items() if distance <= span)

        return {
            "n1": total(1, 0), "n6": total(6, 0), "n24": total(LOOK_BACK, 0), "a6": float(total(6, 1)),
            "a24": float(total(LOOK_BACK, 1)), "c24": total(LOOK_BACK, 2), "t24": total(LOOK_BACK, 3),
            "live": {d for d, steps in used.items() if any(0 <= step - s <= LOOK_BACK for s in steps)},
            "last": max(known, default=None)}

    def _store(self, totals, used, stored_steps, stored_used, latest) -> None:
        # The gap of the 'last' mode needs the newest step even when it is old.
        floor = latest - LOOK_BACK
        for step, value in totals.items():
            if step >= floor:
                self.totals.updateValue((step,), value)
            elif step in stored_steps:
                self.totals.removeKey((step,))
        for target, steps in used.items():
            kept = frozenset(s for s in steps if s >= floor)
            if kept and kept != stored_used.get(target):
                self.used.updateValue((target,), (sorted(kept),))
            elif not kept and target in stored_used:
                self.used.removeKey((target,))

    def close(self) -> None:
        pass


def state_history(df: DataFrame) -> DataFrame:
    """What a stream must know of earlier rows: per account, the totals of the last 24 steps by step and destination."""
    rows = account_history(df).groupBy("nameOrig", "step", "nameDest")
    return rows.agg(F.count("*").alias("n"), F.sum("amount").cast("double").alias("total"), F.count_if(F.col("type") == "CASH_OUT").alias("cashouts"),
                    F.count_if(F.col("type") == "TRANSFER").alias("transfers"))


def behavioral_stream(df: DataFrame, order: str = "event_id", gap_mode: str = "retained", ttl_ms: int | None = None,
                      history: DataFrame | None = None) -> DataFrame:
    """The 14 behaviour features on a stream of validated events, keyed by origin account.

    ``history`` (see ``state_history``) is the state that the stream's first batch starts from, such as a back-fill has written.
    """
    from tallywatch.operators.behavior import depletion_ratio

    flat = df.withColumn("row_order", F.col(order).cast("long"))
    fields = [f for f in flat.schema.fields]
    added = [T.StructField(f, T.DoubleType()) for f in _FEATURES if f != "orig_balance_depletion_ratio"]
    schema = T.StructType([*fields, *added, T.StructField("late", T.BooleanType())])
    out = flat.groupBy("nameOrig").transformWithStateInPandas(
        AccountBehavior(gap_mode, ttl_ms), outputStructType=schema, outputMode="Update",
        timeMode="None" if ttl_ms is None else "ProcessingTime",
        initialState=None if history is None else history.groupBy("nameOrig"))
    return out.withColumn("orig_balance_depletion_ratio", depletion_ratio()).drop("row_order")


def use_rocksdb(spark) -> None:
    """State variables need the RocksDB state store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass",
                   "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
