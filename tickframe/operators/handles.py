"""Joins along handles and ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def deref(rows: DataFrame, targets: DataFrame, handle: Column, target_key: str, how: str = "left", prefix: str = "") -> DataFrame:
    """``rows`` with the columns of the target each handle points at; ``left`` keeps rows without one.

    The join is left to the planner: a small target is sent to the executors, a large one is
    shuffled, and skewed handles are split at run time.
    """
    renamed = targets.select(F.col(target_key).alias("__target"), *(F.col(c).alias(prefix + c) for c in targets.columns if c != target_key))
    return rows.join(renamed, handle == F.col("__target"), how).drop("__target")


def user_of(events: DataFrame, userinfo: DataFrame, field: Column, prefix: str, by: list[str] = []) -> DataFrame:  # noqa: B006
    """Events with ``prefix_name`` and ``prefix_steamid`` of the player behind a user id, one row for each.

    The player with that id itself comes first; without one, ids are compared by their low bytes,
    and of several such players the one with the smallest id is taken.  Unmatched events stay,
    with nulls.  ``by`` are columns of both sides that must be equal.
    """
    player = F.struct("name", "steamid")
    low = userinfo.select(*by, F.col("userid").bitwiseAND(255).alias("userid"), F.col("userid").alias("__id"), "name", "steamid").groupBy(*by, "userid").agg(F.min_by(player, "__id").alias("__low"))
    full = userinfo.groupBy(*by, "userid").agg(F.max(player).alias("__full"))
    out = events
    for players, key in ((full, field), (low, field.bitwiseAND(255))):
        own = players.select(*(F.col(c).alias(f"__{c}") for c in (*by, "userid")), players.columns[-1])
        same = key == F.col("__userid")
        for c in by:
            same &= events[c] == F.col(f"__{c}")
        out = out.join(own, same, "left").drop(*(f"__{c}" for c in (*by, "userid")))
    who = F.coalesce("__full", "__low")
    return out.select(*(F.col(f"`{c}`") for c in events.columns), who["name"].alias(f"{prefix}_name"), who["steamid"].cast("string").alias(f"{prefix}_steamid"))


def pawn_field(has: set[str]) -> str | None:
    """Which field of an event names its user: ``userid``, else ``entityid``, else ``userid_pawn``."""
    return next((f for f in ("userid", "entityid", "userid_pawn") if f in has), None)


def team_columns(teams: DataFrame, by: list[str], props: list[str], team: str = "team_num") -> DataFrame:
    """``t_<prop>`` and ``ct_<prop>`` from rows of teams 2 and 3."""
    picks = [F.max(F.when(F.col(team) == number, F.col(p))).alias(f"{side}_{p}") for p in props for side, number in (("t", 2), ("ct", 3))]
    return teams.groupBy(*by).agg(*picks)


def inventory(slots: DataFrame, by: list[str], item: str, order: str) -> DataFrame:
    """``items`` (distinct, by their first slot) and ``bitmask`` of each owner's slots."""
    first = slots.groupBy(*by, item).agg(F.min(order).alias("__at"))
    bit = F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(F.col(item), F.lit(64)).cast("int")))
    packed = first.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("__at", item))).alias("__items"), bit.alias("bitmask"))
    return packed.select(*by, F.transform("__items", lambda x: x[item]).alias("items"), "bitmask")
