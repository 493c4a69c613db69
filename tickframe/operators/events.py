"""Events made from state changes, and passes over finished events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import HIT_GROUP, ROUND_WIN_REASON, ROUND_WINNER, label


def on_change(deltas: DataFrame, counter: str, by: list[str], order: str, step: int | None = None) -> DataFrame:
    """The rows at which a counter changes (by ``step``, if given), with ``previous``.

    The first value of a key is no change.
    """
    told = deltas.withColumn("previous", F.lag(counter).over(Window.partitionBy(*by).orderBy(order)))
    changed = F.col(counter) != F.col("previous") if step is None else F.col(counter) - F.col("previous") == step
    return told.where(changed)


def round_ends(rules: DataFrame, by: list[str], order: str, kept: list[str] = []) -> DataFrame:  # noqa: B006
    """``round_end`` rows: round, winner and reason, at each step of the round end count; ``kept`` are columns to keep.

    ``rules`` has ``round_end_count`` and ``reason``; an unmapped reason is its number as text,
    and a reason without a winner gives that number as the winner.
    """
    number = F.col("reason").cast("string")
    return on_change(rules, "round_end_count", by, order, 1).select(
        *by, order, *kept, F.lit("round_end").alias("event_name"), F.col("previous").alias("round"), label(F.col("reason"), ROUND_WIN_REASON).alias("reason"), label(F.col("reason"), ROUND_WINNER, number).alias("winner")
    )


def round_starts(rules: DataFrame, by: list[str], order: str, kept: list[str] = []) -> DataFrame:  # noqa: B006
    """``round_officially_ended`` (not before round 2) and ``round_start`` rows at each change of the start count.

    ``sub`` orders the two inside one message.
    """
    starts = on_change(rules, "round_start_count", by, order).withColumn("round", F.col("total_rounds_played") + 1)
    kinds = F.explode(F.array(F.struct(F.lit(0).alias("sub"), F.lit("round_officially_ended").alias("event_name")), F.struct(F.lit(1).alias("sub"), F.lit("round_start").alias("event_name"))))
    told = starts.withColumn("__kind", kinds).select(*by, order, *kept, "round", "__kind.sub", "__kind.event_name")
    return told.where("event_name = 'round_start' or round > 1")


def match_ends(rules: DataFrame, by: list[str], order: str, kept: list[str] = []) -> DataFrame:  # noqa: B006
    return on_change(rules, "match_end_count", by, order).select(*by, order, *kept, F.lit("cs_win_panel_match").alias("event_name"))


def ordered_pattern(updates: DataFrame, kind: str, pattern: list[str], by: list[str], order: str, value: str, maybe: dict[str, tuple[str, int]] | None = None) -> DataFrame:
    """Consecutive updates of the given kinds: the first row of each match with all values as ``v0, v1, ...``.

    ``maybe`` maps columns to the value so many rows on, if that row is of a kind; else null.
    """
    w = Window.partitionBy(*by).orderBy(order)
    ahead = {f"v{i}": F.lead(value, i).over(w) if i else F.col(value) for i in range(len(pattern))}
    seen = {f"__k{i}": F.lead(kind, i).over(w) if i else F.col(kind) for i in range(len(pattern))}
    ahead |= {name: F.when(F.lead(kind, i).over(w) == k, F.lead(value, i).over(w)) for name, (k, i) in (maybe or {}).items()}
    match = F.lit(True)
    for i, k in enumerate(pattern):
        match &= F.col(f"__k{i}") == k
    return updates.withColumns(ahead | seen).where(match).drop(*seen)


def was_sold(trades: DataFrame, keys: list[str], order: str, purchase: Column, sale: Column) -> DataFrame:
    """Purchases with ``was_sold``: whether a later sale of the same keys comes before a later purchase, both existing."""
    w = Window.partitionBy(*keys).orderBy(order).rangeBetween(1, Window.unboundedFollowing)
    told = trades.withColumns({"__sale": F.min(F.when(sale, F.col(order))).over(w), "__buy": F.min(F.when(purchase, F.col(order))).over(w)})
    return told.where(purchase).withColumn("was_sold", F.coalesce(F.col("__sale") < F.col("__buy"), F.lit(False))).drop("__sale", "__buy")


def first_per_key(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row of each key by a unique order; partial aggregates meet, so a hot key costs a row a task."""
    return df.groupBy(*keys).agg(F.min_by(F.struct(*df.columns), order).alias("__row")).select("__row.*")


def last_per_key(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.max_by(F.struct(*df.columns), order).alias("__row")).select("__row.*")


def label_hits(df: DataFrame, column: str = "hitgroup") -> DataFrame:
    return df.withColumn(column, label(F.col(column), HIT_GROUP))


def deferred_order(df: DataFrame, names: tuple[str, ...], order: str, packet_end: str) -> DataFrame:
    """Moves events whose properties are taken at the end of their packet there."""
    return df.withColumn(order, F.when(F.col("event_name").isin(*names), F.col(packet_end)).otherwise(F.col(order)))


def union_segments(*parts: DataFrame, order: list[str] | None = None) -> DataFrame:
    """One table of several, columns by name, missing ones null; sorted if an order is given."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out.orderBy(*order) if order else out


def distinct_sorted(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct().orderBy(column)


def per_key_lists(df: DataFrame, keys: list[str], order: str, columns: list[str]) -> DataFrame:
    """A row for each key with the columns as lists in order.  For keys of bounded size; else use ``by_key``."""
    packed = df.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(order, *(c for c in columns if c != order)))).alias("__rows"))
    return packed.select(*keys, *(F.col(f"__rows.{c}").alias(c) for c in columns))


def by_key(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """All rows, each key's together and in order, spread by key."""
    return df.repartition(*keys).sortWithinPartitions(*keys, order)
