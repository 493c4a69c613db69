"""Lookup tables and constants of the replay format."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the format.
ROUND_WIN_REASON = {
    0: "still_in_progress",
    1: "bomb_exploded",
    2: "vip_escaped",
    3: "vip_killed",
    4: "t_saved",
    5: "ct_stopped_escape",
    6: "RoundEndReasonTerroristsStopped",
    7: "bomb_defused",
    8: "t_killed",
    9: "ct_killed",
    10: "draw",
    11: "hostage_rescued",
    12: "time_ran_out",
    13: "RoundEndReasonHostagesNotRescued",
    14: "terrorists_not_escaped",
    15: "vip_not_escaped",
    16: "game_start",
    17: "t_surrender",
    18: "ct_surrender",
    19: "t_planted",
    20: "ct_reached_hostage",
}
ROUND_WINNER = {1: "T", 4: "CT", 5: "CT", 6: "CT", 7: "CT", 8: "CT", 9: "T", 11: "CT", 12: "CT", 13: "T", 14: "CT", 17: "CT", 18: "T", 19: "CT", 20: "CT"}
HIT_GROUP = {0: "generic", 1: "head", 2: "chest", 3: "stomach", 4: "left_arm", 5: "right_arm", 6: "left_leg", 7: "right_leg", 8: "neck", 10: "gear"}
PLAYER_COLOR = {0: "blue", 1: "green", 2: "yellow", 3: "orange", 4: "purple"}
#: Bits of the button mask.
BUTTONS = {"FIRE": 0, "FORWARD": 3, "BACK": 4, "USE": 5, "LEFT": 9, "RIGHT": 10, "RIGHTCLICK": 11, "RELOAD": 13, "SCOREBOARD": 16, "WALK": 18, "ZOOM": 24, "INSPECT": 35}
ENTITY_MASK = 0x7FF
INVENTORY_MASK = (1 << 14) - 1
STEAMID_BASE = 0x0110000100000000
NO_GROUND = 0xFFFFFF
TICKS_PER_SECOND = 64
#: Cells of the world grid, and where the first begins.
CELL_SIZE, WORLD_EDGE = 512, 16384
SPECTATOR_TEAM, NO_PAWN = 1, 2047
#: Events whose player properties are taken at the end of their packet.
DEFERRED_EVENTS = ("inferno_startburn", "decoy_started", "inferno_expire")
#: Legacy events in place of which there are others of the same name.
REPLACED_EVENTS = ("server_cvar", "player_connect")


def label(code: Column, table: dict[int, str], unknown: Column | None = None) -> Column:
    """The label of a code; an unknown one gives ``unknown``, by default its number as text."""
    names = F.create_map(*(F.lit(x) for pair in table.items() for x in pair))
    code = code.cast("int")
    return F.coalesce(F.try_element_at(names, code), code.cast("string") if unknown is None else unknown)
