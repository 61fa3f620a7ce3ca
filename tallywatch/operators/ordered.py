"""Ordered aggregation that stays distributed when one group is huge.

A plain window puts a whole group into one task. The operators here cut the
order axis into blocks first, aggregate each block, carry the block totals
forward and only then look inside a block, so a task sees one block at most.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, functions as F

from tallywatch.session import scratch_dir

_EARLIER = (Window.unboundedPreceding, -1)


def value_bounds(df: DataFrame, value: str, blocks: int | None = None) -> list[float]:
    """Cut points that spread the rows of ``df`` evenly along ``value``.

    Mergeable sketches per partition; the driver receives the cut points only.
    """
    if blocks is None:
        blocks = min(1000, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    if blocks < 2:
        return []
    shares = [i / blocks for i in range(1, blocks)]
    cuts = df.select(F.col(value).cast("double").alias(value)).approxQuantile(value, shares, 1 / (2 * blocks))
    return sorted(set(cuts))


def with_block(df: DataFrame, value: str, bounds: Sequence[float], name: str = "_block") -> DataFrame:
    if not bounds:
        return df.withColumn(name, F.lit(0.0))
    edges = [-math.inf, *bounds, math.inf]
    keyed = df.withColumn("_value", F.col(value).cast("double"))
    return Bucketizer(splits=edges, inputCol="_value", outputCol=name).transform(keyed).drop("_value")


def running(
    df: DataFrame,
    value: str,
    sums: Mapping[str, str],
    groups: Sequence[str] = (),
    bounds: Sequence[float] | None = None,
) -> DataFrame:
    """Running sums along ``value`` for a table with one row per group and value.

    ``sums`` maps an output prefix to a numeric column. Adds ``<prefix>_before``
    (all smaller values) and ``<prefix>_total`` (the whole group).
    """
    groups = list(groups)
    blocked = with_block(df, value, value_bounds(df, value) if bounds is None else bounds)
    totals = blocked.groupBy(*groups, "_block").agg(
        *[F.sum(column).alias(f"{name}_sum") for name, column in sums.items()])
    # At most one row per block here, so these windows are small by design.
    by_group = Window.partitionBy(*(groups or [F.lit(0)]))
    earlier = by_group.orderBy("_block").rowsBetween(*_EARLIER)
    carried = totals.select(
        *groups, "_block",
        *[F.coalesce(F.sum(f"{name}_sum").over(earlier), F.lit(0)).alias(f"{name}_carry") for name in sums],
        *[F.sum(f"{name}_sum").over(by_group).alias(f"{name}_total") for name in sums],
    )
    inside = Window.partitionBy(*groups, "_block").orderBy(value).rowsBetween(*_EARLIER)
    joined = blocked.withColumns({
        f"{name}_inside": F.coalesce(F.sum(column).over(inside), F.lit(0)) for name, column in sums.items()
    }).join(carried, [*groups, "_block"])
    return joined.withColumns({
        f"{name}_before": F.col(f"{name}_carry") + F.col(f"{name}_inside") for name in sums
    }).drop("_block", *[f"{name}_carry" for name in sums], *[f"{name}_inside" for name in sums])


def value_counts(df: DataFrame, value: str, groups: Sequence[str] = ()) -> DataFrame:
    return (df.where(F.col(value).isNotNull()).groupBy(*groups, value)
            .agg(F.count(F.lit(1)).alias("n")))


def ranked_values(df: DataFrame, value: str, groups: Sequence[str] = (), bounds: Sequence[float] | None = None) -> DataFrame:
    """Distinct values with their count and the ranks they span."""
    return running(value_counts(df, value, groups), value, {"n": "n"}, groups,
                   bounds=value_bounds(df, value) if bounds is None else bounds)


_ACCURACY = 10_000
# Groups whose rank brackets are broadcast, some 100 numbers each; more are joined by shuffle with the same result.
BROADCAST_GROUPS = 10_000


def _same(names: Sequence[str], others: Sequence[str]) -> Column:
    same = F.lit(True)
    for name, other in zip(names, others):
        same = same & F.col(name).eqNullSafe(F.col(other))
    return same


def _brackets(rows: DataFrame, keys: Sequence[str], shares: Sequence[float], broadcast_groups: int) -> DataFrame:
    """Per group: its size and, per share, a short grid of values around the rank.

    The sketch is off by at most 1/accuracy of the ranks. The ends of a bracket lie three times as far and two ranks more
    from the wanted rank, which is a wide share of a small group and a narrow one of a large group. The table is written
    once, a row per group, and never passes the driver.
    """
    widths = [6 * 4 ** j / _ACCURACY for j in range(6)]
    offsets = sorted([*(w * sign for w in widths for sign in (-1, 1)), *(k / _ACCURACY for k in (-2, -1, 0, 1, 2))])
    grid = sorted({share + o for share in shares for o in offsets if 0 < share + o < 1} | {0.5})
    sketched = rows.groupBy(*keys).agg(F.count("*").alias("_n"), F.percentile_approx(F.col("_v").cast("double"), grid, _ACCURACY).alias("_grid"))
    folder = scratch_dir(rows.sparkSession, "rank-brackets")
    sketched.write.parquet(folder)
    stored = rows.sparkSession.read.schema(sketched.schema).parquet(folder)
    need = 3 / _ACCURACY + F.lit(2.0) / F.col("_n")

    def point(at: float) -> Column:
        return F.col("_grid")[grid.index(at)] if 0 < at < 1 else F.lit(None).cast("double")

    def target(i: int, share: float) -> Column:
        low, high = F, F
        for width in widths:
            low, high = low.when(need <= width, point(share - width)), high.when(need <= width, point(share + width))
        cuts = [point(share + o) for o in offsets if 0 < share + o < 1]
        return F.struct(F.lit(i).alias("target"), low.alias("low"), high.alias("high"), F.array(*cuts).alias("cuts"))

    out = stored.select(*[F.col(k).alias(f"_of{k}") for k in keys], "_n", F.array(*[target(i, s) for i, s in enumerate(shares)]).alias("_targets"))
    return F.broadcast(out) if stored.count() <= broadcast_groups else out


def rank_values(df: DataFrame, value: str, shares: Sequence[float], groups: Sequence[str] = (), interpolate: bool = True,
                broadcast_groups: int = BROADCAST_GROUPS) -> DataFrame:
    """Exact values at shares of the rank order: one row per group and share, (groups, share, quantile, n).

    With ``interpolate`` the position is ``share * (n - 1)`` and neighbours are blended; without, it is
    ``floor(share * n)`` and the value there is returned. Null values do not count; groups with none have no row, null
    groups are groups. A sketch brackets each rank; values below a bracket are counted, those inside it are cut into
    blocks along the sketch, and only the blocks that hold the rank are sorted. One plan serves tables of any size.
    """
    shares, groups = [float(s) for s in shares], list(groups)
    keys = [f"_g{i}" for i in range(max(1, len(groups)))]
    rows = df.where(F.col(value).isNotNull()).select(*[F.col(g).alias(k) for g, k in zip(groups, keys)], F.col(value).alias("_v"))
    if not groups:
        # One group: a key that is 0 in every row but no constant, so the join below stays one by key.
        rows = rows.withColumn(keys[0], F.pmod(F.xxhash64("_v"), F.lit(1)))
    number = F.col("_v").cast("double")
    missing = F.lit(None).cast(rows.schema["_v"].dataType)

    def place(t: Column) -> Column:
        below = t["low"].isNotNull() & (number < t["low"])
        block = F.size(F.filter(t["cuts"], lambda c: c <= number))
        return F.when(below, F.struct(t["target"].alias("target"), F.lit(-1).alias("block"), missing.alias("value"))).when(
            t["high"].isNull() | (number <= t["high"]), F.struct(t["target"].alias("target"), block.alias("block"), F.col("_v").alias("value")))

    brackets = _brackets(rows, keys, shares, broadcast_groups)
    joined = rows.join(brackets, _same(keys, [f"_of{k}" for k in keys]))
    entries = joined.select(*keys, "_n", F.inline(F.array_compact(F.transform("_targets", place))))
    counts = entries.groupBy(*keys, "_n", "target", "block", "value").agg(F.count("*").alias("n"))

    share = F.element_at(F.array(*[F.lit(s) for s in shares]), F.col("target") + 1)
    position = share * (F.col("_n") - 1)
    low, high = (F.floor(position), F.ceil(position)) if interpolate else (F.least(F.floor(share * F.col("_n")), F.col("_n") - 1),) * 2

    # At most twenty rows per group and share here.
    along = Window.partitionBy(*keys, "target")
    blocks = counts.groupBy(*keys, "_n", "target", "block").agg(F.sum("n").alias("n")).withColumn(
        "before", F.coalesce(F.sum("n").over(along.orderBy("block").rowsBetween(*_EARLIER)), F.lit(0)))
    last = F.col("before") + F.col("n") - 1
    hits = [(F.col("block") >= 0) & (F.col("before") <= rank) & (rank <= last) for rank in (low, high)]
    found = F.max(hits[0]).over(along) & F.max(hits[1]).over(along)
    marked = blocks.withColumns({"hit": hits[0] | hits[1], "found": found})
    # Not to be reached: it would say that a sketch broke its bound.
    held = marked.where(F.when(F.col("found"), F.col("hit")).otherwise(F.raise_error(F.lit("rank outside its bracket")).cast("boolean")))
    held = held.select(*[F.col(k).alias(f"_of{k}") for k in [*keys, "target", "block"]], "before")

    names = [*keys, "target", "block"]
    inside = counts.where("block >= 0").join(held, _same(names, [f"_of{k}" for k in names])).select(*counts.columns, "before")
    order = Window.partitionBy(*names).orderBy("value").rowsBetween(*_EARLIER)
    ranked = inside.withColumn("first", F.col("before") + F.coalesce(F.sum("n").over(order), F.lit(0)))
    end = F.col("first") + F.col("n") - 1
    picked = ranked.groupBy(*keys, "_n", "target").agg(
        *[F.max(F.when((F.col("first") <= rank) & (rank <= end), F.col("value"))).alias(name) for name, rank in (("low", low), ("high", high))])
    exact = F.col("low")
    if interpolate:
        step = F.col("high").cast("double") - F.col("low").cast("double")
        exact = F.col("low").cast("double") + step * (position - F.floor(position))
    return picked.select(*[F.col(k).alias(g) for g, k in zip(groups, keys)], share.alias("share"), exact.alias("quantile"), F.col("_n").alias("n"))


def exact_quantiles(df: DataFrame, value: str, shares: Sequence[float], groups: Sequence[str] = (),
                    broadcast_groups: int = BROADCAST_GROUPS) -> DataFrame:
    """Linear-interpolated exact quantiles: one row per group and share."""
    return rank_values(df, value, shares, groups, broadcast_groups=broadcast_groups)


def leading_rows(df: DataFrame, column: str, k: int, descending: bool = False, position: Column | None = None,
                 tie: str | None = None) -> DataFrame:
    """The k first rows along a column without gathering k rows per task; nulls come first, descending last.

    The k-th value is found by selection and the rows are filtered by it, for any k;
    ``position`` is a numeric column that grows with ``column`` (needed for text). Rows
    that tie with the k-th value are ordered by ``column``, then ``tie``, and cut among themselves.
    """
    order = [F.col(column).desc() if descending else F.col(column).asc(), *([F.col(tie)] if tie else [])]
    size = df.agg(F.count(F.lit(1)).alias("rows"), F.count(column).alias("known")).first()
    nulls = size["rows"] - size["known"]
    wanted = min(size["known"], k if descending else max(0, k - nulls))
    some_nulls = min(nulls, k - wanted)
    empty, known = df.where(F.col(column).isNull()), df.where(F.col(column).isNotNull())
    if some_nulls < nulls:
        empty = empty.orderBy(*order).limit(some_nulls)
    if wanted == size["known"]:
        return known.unionByName(empty)
    if not wanted:
        return empty
    place = (F.col(column) if position is None else position).cast("double")
    placed = known.withColumn("_place", -place if descending else place)
    counts = placed.groupBy("_place").agg(F.count("*").alias("n"))
    ranked = running(counts, "_place", {"n": "n"}, bounds=value_bounds(placed, "_place"))
    edge = ranked.where((F.col("n_before") < wanted) & (F.col("n_before") + F.col("n") >= wanted)).select("_place", "n_before").first()
    inside = placed.where(F.col("_place") < edge["_place"])
    ties = placed.where(F.col("_place") == edge["_place"]).orderBy(*order).limit(wanted - edge["n_before"])
    return inside.unionByName(ties).drop("_place").unionByName(empty)


def block_of(order: str, width: int) -> Column:
    """Block number of a unique integer order: at most ``width`` rows share one."""
    return F.expr(f"CAST(`{order}` AS BIGINT) DIV {int(width)}")


def position_in_group(
    df: DataFrame, keys: Sequence[str], order: str, name: str = "position", width: int = 1 << 20
) -> DataFrame:
    """1-based position of each row in its group along a unique integer order."""
    keys = list(keys)
    blocked = df.withColumn("_block", block_of(order, width))
    carried = (
        blocked.groupBy(*keys, "_block").agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_carry", F.coalesce(
            F.sum("_n").over(Window.partitionBy(*keys).orderBy("_block").rowsBetween(*_EARLIER)), F.lit(0)))
        .drop("_n")
    )
    inside = F.row_number().over(Window.partitionBy(*keys, "_block").orderBy(order))
    return (blocked.withColumn("_inside", inside).join(carried, [*keys, "_block"])
            .withColumn(name, F.col("_inside") + F.col("_carry")).drop("_inside", "_carry", "_block"))


def previous_in_group(
    df: DataFrame, keys: Sequence[str], order: str, values: Mapping[str, str], block: Column
) -> DataFrame:
    """``lag`` by one row over an order, one block of the order per task.

    ``values`` maps an output name to a source column; ``block`` must grow with
    ``order``. The first row of a block takes the last row of the nearest
    earlier block of its group.
    """
    keys, names = list(keys), list(values)
    blocked = df.withColumn("_block", block)
    packed = F.struct(*[F.col(column).alias(name) for name, column in values.items()])
    ends = blocked.groupBy(*keys, "_block").agg(F.max_by(packed, F.col(order)).alias("_end"))
    carried = ends.select(
        *keys, "_block",
        F.lag("_end").over(Window.partitionBy(*keys).orderBy("_block")).alias("_carry"))
    inside = Window.partitionBy(*keys, "_block").orderBy(order)
    return (
        blocked.withColumn("_inside", F.lag(packed).over(inside))
        .join(carried, [*keys, "_block"])
        .withColumns({name: F.coalesce(F.col("_inside"), F.col("_carry"))[name] for name in names})
        .drop("_inside", "_carry", "_block")
    )
