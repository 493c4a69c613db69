"""Composite plans over an event log (``event_id, user_id, event_type, value``)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import events as ev
from ..operators import filters, state


def _round(width: int):
    return F.floor(F.col("event_id") / width).alias("round")


def scoreboard(events: DataFrame, at: str = "purchase") -> DataFrame:
    """Totals of each player up to the last event of a kind."""
    cut = events.where(F.col("event_type") == at).agg(F.max("event_id").alias("__cut"))
    upto = events.join(F.broadcast(cut), F.col("event_id") <= F.col("__cut"))  # one row
    return upto.groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


def kills_per_round(events: DataFrame, width: int = 500, not_type: str = "error", not_user: int = 3) -> DataFrame:
    kept = events.where((F.col("event_type") != not_type) & (F.col("user_id") != not_user))
    return kept.groupBy(_round(width), "user_id").agg(F.count("*").alias("kills"))


def kda_per_zone(events: DataFrame, zone=None) -> DataFrame:
    """Kills and deaths inside a zone, players of either kind included."""
    zone = F.col("value") > 10 if zone is None else zone
    count = lambda kind, name: events.where(F.col("event_type") == kind).groupBy("user_id").agg(F.count_if(zone).alias(name))
    return count("click", "kills").join(count("error", "deaths"), "user_id", "full").na.fill(0, ["kills", "deaths"])


def clutch(events: DataFrame, width: int = 400, mates: int = 20, enemies: int = 10) -> DataFrame:
    """The first moment of each round at which ``mates`` of one side and at least ``enemies`` of the other are counted, with the winner."""
    w = Window.partitionBy("round").orderBy("event_id")
    counted = events.select("event_id", "user_id", "event_type", _round(width))
    counted = counted.withColumns({"enemies": F.count_if(F.col("event_type") == "view").over(w), "mates": F.count_if(F.col("event_type") == "click").over(w)})
    first = ev.first_per_key(counted.where((F.col("mates") == mates) & (F.col("enemies") >= enemies)).select("round", "event_id", F.col("enemies").alias("versus")), ["round"], "event_id")
    winners = events.groupBy(_round(width)).agg(F.max_by("user_id", "event_id").alias("winner"))
    return first.join(winners, "round")


def equipment_at(events: DataFrame, segment: int, at: str = "signup") -> DataFrame:
    """Each player's latest value at the events of a kind."""
    rows = events.select("event_id", "user_id", "event_type", "value")
    filled = state.carry_forward(rows, ["user_id"], "event_id", {"equipment": F.expr("CASE WHEN event_type = 'view' THEN value END")}, F.floor(F.col("event_id") / segment))
    return filters.at_ticks(filled.select("event_id", "user_id", "equipment"), events.where(F.col("event_type") == at).select("event_id"), "event_id")


def round_time(events: DataFrame, width: int = 500) -> DataFrame:
    w = Window.partitionBy("round").orderBy("event_id")
    return events.select("event_id", "value", _round(width)).select("event_id", (F.col("value") - F.first("value").over(w)).alias("round_time"))


def utility_damage(events: DataFrame, kinds: list[str]) -> DataFrame:
    return events.where(F.col("event_type").isin(kinds)).groupBy("user_id").agg(F.round(F.sum("value"), 4).alias("damage"))


def from_match_start(events: DataFrame, start: str) -> DataFrame:
    """Events from the first one of a kind on."""
    cut = events.where(F.col("event_type") == start).agg(F.min("event_id").alias("__cut"))
    return events.join(F.broadcast(cut), F.col("event_id") >= F.col("__cut")).drop("__cut")  # one row
