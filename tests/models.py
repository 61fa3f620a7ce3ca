"""Plain sequential models that the operators are checked against."""

from __future__ import annotations


def sequential_behavior(rows: list[dict], gap_mode: str = "retained") -> dict[int, dict]:
    """Walk each account in (step, event_id) order and look back over a list."""
    out: dict[int, dict] = {}
    history: dict[str, list[dict]] = {}
    for row in sorted(rows, key=lambda r: (r["step"], r["event_id"])):
        past = history.setdefault(row["nameOrig"], [])
        near = {w: [p for p in past if row["step"] - p["step"] <= w] for w in (1, 6, 24)}
        recent = near[24]
        total = {w: sum(p["amount"] for p in near[w]) for w in (6, 24)}
        mean = {w: total[w] / len(near[w]) if near[w] else 0.0 for w in (6, 24)}
        seen = {p["nameDest"] for p in recent}
        last = recent if gap_mode == "retained" else past
        out[row["event_id"]] = {
            "orig_tx_count_1step": float(len(near[1])), "orig_tx_count_6steps": float(len(near[6])),
            "orig_tx_count_24steps": float(len(recent)),
            "orig_amount_sum_6steps": total[6], "orig_amount_sum_24steps": total[24],
            "orig_avg_amount_6steps": mean[6], "orig_avg_amount_24steps": mean[24],
            "orig_amount_ratio_to_avg_24steps": row["amount"] / mean[24] if mean[24] > 0 else 0.0,
            "orig_time_since_prev_step": float(row["step"] - last[-1]["step"]) if last else 0.0,
            "orig_unique_destinations_24steps": float(len(seen)),
            "orig_cashout_count_24steps": float(sum(p["type"] == "CASH_OUT" for p in recent)),
            "orig_transfer_count_24steps": float(sum(p["type"] == "TRANSFER" for p in recent)),
            "orig_new_destination": float(row["nameDest"] not in seen),
        }
        past.append(row)
    return out


SCHEMA = ("event_id long, step int, type string, amount double, nameOrig string, nameDest string, "
          "oldbalanceOrg double, newbalanceOrig double")


def frame(spark, rows: list[dict]):
    names = [part.split()[0] for part in SCHEMA.split(", ")]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], SCHEMA)


def transaction(event_id: int, step: int, account: str = "C1", target: str = "M1", amount: float = 10.0,
                kind: str = "PAYMENT", old: float = 100.0, new: float = 90.0) -> dict:
    return {"event_id": event_id, "step": step, "type": kind, "amount": amount, "nameOrig": account, "nameDest": target,
            "oldbalanceOrg": old, "newbalanceOrig": new}
