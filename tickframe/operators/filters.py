"""Filters and projections of the query surface."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import REPLACED_EVENTS

#: Values of an IN list; longer lists are joined.
MOST_IN = 1000


def _member(df: DataFrame, column: str, wanted) -> DataFrame:
    if isinstance(wanted, DataFrame):
        return df.join(wanted.select(F.col(wanted.columns[0]).alias("__wanted")).distinct(), F.col(column) == F.col("__wanted"), "left_semi")
    if not wanted:
        return df
    if len(wanted) <= MOST_IN:
        return df.where(F.col(column).isin(list(wanted)))
    kind = df.schema[column].dataType.simpleString()
    return _member(df, column, df.sparkSession.createDataFrame([(x,) for x in wanted], f"w {kind}"))


def at_ticks(df: DataFrame, ticks, column: str = "tick") -> DataFrame:
    """Rows at the wanted ticks: a list (empty or None: all) or a one-column DataFrame, of any size."""
    return df if ticks is None else _member(df, column, ticks)


def of_players(df: DataFrame, players, column: str = "steamid") -> DataFrame:
    """Rows of the wanted players, as ``at_ticks``."""
    return df if players is None else _member(df, column, players)


def events_named(df: DataFrame, names: list[str], column: str = "event_name") -> DataFrame:
    """Events of the given names; ``all`` among them gives every one."""
    return df if "all" in names else df.where(F.col(column).isin(names))


def without_replaced(df: DataFrame, column: str = "event_name", replaced: tuple[str, ...] = REPLACED_EVENTS) -> DataFrame:
    return df.where(~F.col(column).isin(*replaced))


def prop_states(df: DataFrame, conditions: dict[str, object] | Column, by: list[str], order: list[str]) -> DataFrame:
    """The players of each tick before the first, in ``order``, that misses a wanted value.

    ``conditions`` maps columns to wanted values (all of them; a null never matches) or is a
    predicate.  This is a prefix, not a WHERE: rows after the first miss go too.
    """
    if isinstance(conditions, Column):
        fits = conditions
    else:
        fits = F.lit(True)
        for name, value in conditions.items():
            fits &= F.col(f"`{name}`") == F.lit(value)
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    misses = F.sum(F.when(F.coalesce(fits, F.lit(False)), 0).otherwise(1)).over(w)
    return df.withColumn("__misses", misses).where("__misses = 0").drop("__misses")


def grenade_rows(df: DataFrame, grenades: bool = True, column: str = "grenade_type") -> DataFrame:
    """All grenades, or with ``grenades=False`` only classes that contain Projectile."""
    return df if grenades else df.where(F.contains(column, F.lit("Projectile")))


def sorted_columns(df: DataFrame) -> DataFrame:
    return df.select(sorted(df.columns))
