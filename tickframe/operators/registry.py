"""Who plays which pawn, and when."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import derived
from ..functions.labels import NO_PAWN, SPECTATOR_TEAM
from . import state

_PROPS = {"steamid": "m_steamID", "name": "m_iszPlayerName", "team_num": "m_iTeamNum", "handle": "m_hPlayerPawn"}


def player_registry(updates: DataFrame) -> DataFrame:
    """``demo_id, pawn_id, controller_id, steamid, name, team_num, from_seq, to_seq`` from the controllers' properties.

    An entry begins where a controller first has a steam id, a team and a pawn, or where one of
    them or the name changes, and ends where the same steam id has its next entry.  Spectators,
    steam id 0 and handles to no pawn are not registered.
    """
    rows = updates.where(F.col("prop").isin([f"CCSPlayerController.{p}" for p in _PROPS.values()]))
    at = rows.groupBy("demo_id", "entity_id", "seq").agg(*(F.max(F.when(F.col("prop") == f"CCSPlayerController.{p}", F.col("value"))).alias(f"new_{n}") for n, p in _PROPS.items()))
    known = state.carry_forward(at, ["demo_id", "entity_id"], "seq", {n: F.col(f"new_{n}") for n in _PROPS})
    told = known.select(
        "demo_id", derived.entity_of(F.col("handle").cast("bigint")).cast("int").alias("pawn_id"), F.col("entity_id").alias("controller_id"), F.col("steamid").cast("bigint").alias("steamid"), "name", F.col("team_num").cast("int").alias("team_num"), F.col("seq").alias("from_seq")
    )
    told = told.where((F.col("steamid") != 0) & (F.col("team_num") != SPECTATOR_TEAM) & (F.col("pawn_id") != NO_PAWN))
    w = Window.partitionBy("demo_id", "steamid").orderBy("from_seq", "controller_id")
    entry = F.struct("pawn_id", "controller_id", "name", "team_num")
    changed = told.withColumn("before", F.lag(entry).over(w)).where(F.col("before").isNull() | ~entry.eqNullSafe(F.col("before"))).drop("before")
    return changed.withColumn("to_seq", F.lead("from_seq").over(w))
