"""Account behaviour from prior history: 14 features in a look-back of 24 steps.

The history of a row is every row of the same account with an earlier step
inside the window, plus the rows of the same step that come first in the row
order. A busy account may hold a large share of all rows, so no account, and no
account-and-step, is ever one window partition. The work is cut into *cells*:

    cell = (account, step, block of the row order)

A cell holds at most ``width`` rows. Cell totals are small, so the look-back
windows run over cells; only the position inside a cell needs the rows.

Distinct destinations are counted without sets. A destination is *open* for an
account from its first use until 24 steps pass without a new use. Opening adds
one, closing subtracts one, and the running balance is the distinct count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallywatch.operators.ordered import block_of

LOOK_BACK = 24
_EARLIER = (Window.unboundedPreceding, -1)


def _uses(rows: DataFrame) -> DataFrame:
    """Totals per (account, destination, cell), with the openings and endings of use."""
    uses = rows.groupBy("_key", "_dest", "_step", "_block").agg(
        F.count(F.lit(1)).alias("n"), F.sum("_amount").alias("amount"),
        F.sum("_cashout").alias("cashouts"), F.sum("_transfer").alias("transfers"), F.min("_order").alias("_first"))
    along = Window.partitionBy("_key", "_dest").orderBy("_step", "_block")
    return uses.withColumns({
        "_opens": F.coalesce(F.col("_step") - F.lag("_step").over(along) > LOOK_BACK, F.lit(True)),
        "_ends": F.coalesce(F.lead("_step").over(along) - F.col("_step") > LOOK_BACK, F.lit(True)),
    })


def _markers(uses: DataFrame) -> DataFrame:
    """One marker per opening, at the order of the row that opens.

    The condition on the totals is always true. It keeps the columns of this
    branch equal to those under the cells, so Spark shuffles ``uses`` once.
    """
    always = (F.col("n") > 0) & (F.col("cashouts") + F.col("transfers") <= F.col("n")) & (
        F.col("amount").isNull() | (F.col("n") > 0))
    return uses.where(F.col("_opens") & always).select(
        "_key", "_step", "_block", F.col("_first").alias("_order"), F.lit(1).alias("_marker"))


def _cells(uses: DataFrame) -> DataFrame:
    """Look-back totals as they stand at the start of each cell."""
    zero = F.lit(0).cast("long")

    def entry(step: Column, block: Column, opened: Column, closed: Column, used: bool) -> Column:
        return F.struct(
            step.alias("step"), block.alias("block"), (F.col("n") if used else zero).alias("n"),
            (F.col("amount") if used else F.lit(0.0)).alias("amount"),
            (F.col("cashouts") if used else zero).alias("cashouts"),
            (F.col("transfers") if used else zero).alias("transfers"), opened.alias("opened"), closed.alias("closed"))

    here = entry(F.col("_step"), F.col("_block"), F.col("_opens").cast("long"), zero, True)
    # A use that ends closes before the first block of the step that leaves the window.
    leaves = entry(F.col("_step") + LOOK_BACK + 1, F.lit(None).cast("long"), zero, F.lit(1).cast("long"), False)
    entries = F.when(F.col("_ends"), F.array(here, leaves)).otherwise(F.array(here))
    totals = uses.select("_key", F.inline(entries)).groupBy(
        "_key", F.col("step").alias("_step"), F.col("block").alias("_block")).agg(
        *[F.sum(c).alias(c) for c in ("n", "amount", "cashouts", "transfers", "opened", "closed")])

    account = Window.partitionBy("_key")
    by_block = F.col("_block").asc_nulls_first()
    same_step = Window.partitionBy("_key", "_step").orderBy(by_block).rowsBetween(*_EARLIER)
    path = account.orderBy("_step", by_block)

    def back(column: str, steps: int) -> Column:
        older = F.sum(column).over(account.orderBy("_step").rangeBetween(-steps, -1))
        return F.coalesce(older, F.lit(0)) + F.coalesce(F.sum(column).over(same_step), F.lit(0))

    return totals.select(
        "_key", "_step", "_block", "n",
        back("n", 1).alias("_n1"), back("n", 6).alias("_n6"), back("n", LOOK_BACK).alias("_n24"),
        back("amount", 6).alias("_a6"), back("amount", LOOK_BACK).alias("_a24"),
        back("cashouts", LOOK_BACK).alias("_c24"), back("transfers", LOOK_BACK).alias("_t24"),
        (F.coalesce(F.sum("opened").over(path.rowsBetween(*_EARLIER)), F.lit(0))
         - F.sum("closed").over(path.rowsBetween(Window.unboundedPreceding, 0))).alias("_open"),
        F.max(F.when(F.col("n") > 0, F.col("_step"))).over(path.rowsBetween(*_EARLIER)).alias("_last_step"),
    ).where("n > 0").drop("n")


def depletion_ratio(old: str = "oldbalanceOrg", new: str = "newbalanceOrig") -> Column:
    share = (F.col(old) - F.col(new)) / F.col(old)
    return F.when(F.col(old) > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), share))).otherwise(0.0)


def behavioral_features(
    df: DataFrame,
    key: str = "nameOrig",
    step: str = "step",
    order: str = "event_id",
    amount: str = "amount",
    destination: str = "nameDest",
    kind: str = "type",
    gap_mode: str = "retained",
    width: int = 1 << 20,
) -> DataFrame:
    """Add the 14 behaviour features.

    ``order`` is a unique integer that orders rows within a step (an offset or
    an event id). ``gap_mode`` is ``retained`` (a gap over 24 steps gives 0, as
    history is pruned) or ``last`` (the true gap).
    """
    if gap_mode not in ("retained", "last"):
        raise ValueError("gap_mode is 'retained' or 'last'")
    rows = df.withColumns({
        "_key": F.col(key), "_step": F.col(step), "_order": F.col(order).cast("long"),
        "_block": block_of(order, width), "_dest": F.col(destination), "_amount": F.col(amount).cast("double"),
        "_cashout": (F.col(kind) == "CASH_OUT").cast("long"), "_transfer": (F.col(kind) == "TRANSFER").cast("long"),
    })
    uses = _uses(rows)
    cells = _cells(uses)
    # A marker sits just before the row that opens a destination, so one sort
    # of the cell yields both the flag and the running count of openings.
    placed = rows.withColumn("_marker", F.lit(0)).unionByName(_markers(uses), allowMissingColumns=True)
    inside = Window.partitionBy("_key", "_step", "_block").orderBy("_order", F.col("_marker").desc())
    before = inside.rowsBetween(*_EARLIER)
    is_row = F.col("_marker") == 0

    def so_far(column: Column) -> Column:
        return F.coalesce(F.sum(F.when(is_row, column)).over(before), F.lit(0))

    placed = placed.withColumns({
        "_in_n": F.count(F.when(is_row, F.lit(1))).over(before),
        "_in_amount": so_far(F.col("_amount")),
        "_in_cashout": so_far(F.col("_cashout")),
        "_in_transfer": so_far(F.col("_transfer")),
        "_in_open": F.coalesce(F.sum("_marker").over(before), F.lit(0)),
        "_new": F.coalesce(F.lag("_marker").over(inside), F.lit(0)),
    }).where(is_row)

    full = placed.join(cells, ["_key", "_step", "_block"])
    n1, n6, n24 = (F.col(f"_n{w}") + F.col("_in_n") for w in (1, 6, 24))
    a6, a24 = (F.col(f"_a{w}") + F.col("_in_amount") for w in (6, 24))
    mean6 = F.when(n6 > 0, a6 / n6).otherwise(0.0)
    mean24 = F.when(n24 > 0, a24 / n24).otherwise(0.0)
    gap = F.coalesce(F.when(F.col("_in_n") > 0, F.lit(0)).otherwise(F.col("_step") - F.col("_last_step")), F.lit(0))
    if gap_mode == "retained":
        gap = F.when(gap > LOOK_BACK, 0).otherwise(gap)
    return full.withColumns({
        "orig_tx_count_1step": n1.cast("double"),
        "orig_tx_count_6steps": n6.cast("double"),
        "orig_tx_count_24steps": n24.cast("double"),
        "orig_amount_sum_6steps": a6,
        "orig_amount_sum_24steps": a24,
        "orig_avg_amount_6steps": mean6,
        "orig_avg_amount_24steps": mean24,
        "orig_amount_ratio_to_avg_24steps": F.when(mean24 > 0, F.col("_amount") / mean24).otherwise(0.0),
        "orig_time_since_prev_step": gap.cast("double"),
        "orig_unique_destinations_24steps": (F.col("_open") + F.col("_in_open") - F.col("_new")).cast("double"),
        "orig_cashout_count_24steps": (F.col("_c24") + F.col("_in_cashout")).cast("double"),
        "orig_transfer_count_24steps": (F.col("_t24") + F.col("_in_transfer")).cast("double"),
        "orig_new_destination": F.col("_new").cast("double"),
        "orig_balance_depletion_ratio": depletion_ratio(),
    }).select(*df.columns, *_FEATURES)


_FEATURES = [
    "orig_tx_count_1step", "orig_tx_count_6steps", "orig_tx_count_24steps",
    "orig_amount_sum_6steps", "orig_amount_sum_24steps",
    "orig_avg_amount_6steps", "orig_avg_amount_24steps",
    "orig_amount_ratio_to_avg_24steps", "orig_time_since_prev_step",
    "orig_unique_destinations_24steps", "orig_cashout_count_24steps", "orig_transfer_count_24steps",
    "orig_new_destination", "orig_balance_depletion_ratio",
]


def account_history(df: DataFrame, key: str = "nameOrig", step: str = "step") -> DataFrame:
    """Rows that a later batch still needs: the last 24 steps of each account.

    The latest step per account is pre-aggregated; the join spreads the rows of
    a busy account through AQE's skew handling or a broadcast of the small side.
    """
    latest = df.groupBy(key).agg(F.max(step).alias("_latest"))
    return df.join(latest, key).where(F.col(step) >= F.col("_latest") - LOOK_BACK).drop("_latest")


def whole_account_features(
    df: DataFrame, key: str = "nameOrig", step: str = "step", order: str = "event_id"
) -> DataFrame:
    """Account-wide aggregates under the same 14 names, without a window.

    Denominators carry 1e-6, and "new destination" means the account has one
    destination only.
    """
    totals = df.groupBy(key).agg(
        F.count(F.lit(1)).alias("_n"), F.sum("amount").alias("_sum"),
        F.count_if(F.col("type") == "CASH_OUT").alias("_c"), F.count_if(F.col("type") == "TRANSFER").alias("_t"))
    targets = df.groupBy(key, "nameDest").agg(F.lit(1).alias("_one")).groupBy(key).agg(
        F.count("nameDest").alias("_d"))
    # Only the first row of a step has a gap; it looks back to the previous step used.
    steps = df.groupBy(key, step).agg(F.min(order).alias(order))
    gaps = steps.withColumn(
        "_gap", F.col(step) - F.lag(step).over(Window.partitionBy(key).orderBy(step))).select(key, order, "_gap")
    mean = F.col("_sum") / F.col("_n")
    share = (F.col("oldbalanceOrg") - F.col("newbalanceOrig")) / (F.col("oldbalanceOrg") + 1e-6)
    count = F.col("_n").cast("double")
    return df.join(totals.join(targets, key), key).join(gaps, [key, order], "left").withColumns({
        "orig_tx_count_1step": count, "orig_tx_count_6steps": count, "orig_tx_count_24steps": count,
        "orig_amount_sum_6steps": F.col("_sum"), "orig_amount_sum_24steps": F.col("_sum"),
        "orig_avg_amount_6steps": mean, "orig_avg_amount_24steps": mean,
        "orig_amount_ratio_to_avg_24steps": F.col("amount") / (mean + 1e-6),
        "orig_time_since_prev_step": F.coalesce(F.col("_gap"), F.lit(0)).cast("double"),
        "orig_unique_destinations_24steps": F.col("_d").cast("double"),
        "orig_cashout_count_24steps": F.col("_c").cast("double"),
        "orig_transfer_count_24steps": F.col("_t").cast("double"),
        "orig_new_destination": (F.col("_d") == 1).cast("double"),
        "orig_balance_depletion_ratio": F.greatest(F.lit(0.0), F.least(F.lit(1.0), share)),
    }).select(*df.columns, *_FEATURES)
