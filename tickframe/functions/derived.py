"""Per-row functions over replay properties.  Null in, null out unless said otherwise."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from .labels import BUTTONS, CELL_SIZE, ENTITY_MASK, INVENTORY_MASK, NO_GROUND, PLAYER_COLOR, TICKS_PER_SECOND, WORLD_EDGE, label


def cell_coord(cell: Column, offset: Column) -> Column:
    """A world coordinate from a grid cell and the place in it; null unless both are there."""
    return (cell * CELL_SIZE - WORLD_EDGE).cast("float") + offset.cast("float")


def velocity_axis(coord: Column, by: list[str], order: list[str]) -> Column:
    """Units a second along one axis from the two rows before; null in the first two rows of a key."""
    w = Window.partitionBy(*by).orderBy(*order)
    return (F.lag(coord, 1).over(w) - F.lag(coord, 2).over(w)) * TICKS_PER_SECOND


def velocity(x: Column, y: Column) -> Column:
    return F.sqrt(x * x + y * y)


def pitch(angles: Column) -> Column:
    return F.get(angles, F.lit(0))


def yaw(angles: Column) -> Column:
    return F.get(angles, F.lit(1))


def button(mask: Column, name: str) -> Column:
    return mask.bitwiseAND(F.lit(1 << BUTTONS[name]).cast("bigint")) != 0


def button_names(mask: Column) -> Column:
    """The names of the pressed buttons, by bit."""
    pairs = F.array(*(F.struct(F.lit(1 << bit).cast("bigint").alias("bit"), F.lit(name).alias("name")) for name, bit in BUTTONS.items()))
    return F.transform(F.filter(pairs, lambda p: p["bit"].bitwiseAND(mask) != 0), lambda p: p["name"])


def is_alive(life_state: Column) -> Column:
    """Never null."""
    return F.coalesce(life_state == 0, F.lit(False))


def is_airborne(ground: Column) -> Column:
    """Never null."""
    return F.coalesce(ground == NO_GROUND, F.lit(False))


def steamid(value: Column) -> Column:
    return F.coalesce(value, F.lit(0))


def player_color(code: Column) -> Column:
    return label(code, PLAYER_COLOR)


def integral_id(value: Column) -> Column:
    """An id kept as a float; null unless it is whole and not negative."""
    return F.when((value == F.floor(value)) & (value >= 0), value.cast("bigint"))


def paint_seed(value: Column) -> Column:
    return F.coalesce(value.cast("int"), F.lit(0))


def owner_xuid(high: Column, low: Column) -> Column:
    """64-bit owner id from its halves, as text."""
    return (high.cast("decimal(20,0)") * F.lit(1 << 32) + low.cast("decimal(20,0)")).cast("decimal(20,0)").cast("string")


def entity_of(handle: Column) -> Column:
    return handle.bitwiseAND(ENTITY_MASK)


def item_entity_of(handle: Column) -> Column:
    return handle.bitwiseAND(INVENTORY_MASK)


def game_time(net_tick: Column) -> Column:
    return (net_tick / TICKS_PER_SECOND).cast("float")


def item_bitmask(ids: Column) -> Column:
    """OR of ``1 << id`` over an array of item ids, shifts wrapping at 64."""
    return F.aggregate(ids, F.lit(0).cast("bigint"), lambda acc, i: acc.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(i, F.lit(64)).cast("int"))))


def spotted_by(mask: Column, controllers: int = 16) -> Column:
    """Controller numbers (from 1) whose bits are set."""
    return F.filter(F.sequence(F.lit(1), F.lit(controllers)), lambda i: F.getbit(mask.cast("bigint"), i - 1) == 1)


def _bits(value: pd.Series) -> pd.Series:
    return pd.Series(value.to_numpy(np.float32).view(np.uint32).astype(np.int64)).where(value.notna().to_numpy())


def float_bits(value: Column) -> Column:
    """The bits of a 32-bit float as an unsigned number; no built-in function tells them."""
    return F.pandas_udf(_bits, "bigint")(value)


def sticker_slots(attributes: Column, first: int = 4, step: int = 4, slots: int = 6) -> Column:
    """Attribute slots as structs of id bits (float), wear, x and y; a slot without an id is left out, negative wear is 0."""
    at = lambda i, k: F.get(attributes, i + k)
    every = F.transform(
        F.sequence(F.lit(first), F.lit(first + step * (slots - 1)), F.lit(step)),
        lambda i: F.struct(at(i, 0).alias("id"), F.greatest(at(i, 1), F.lit(0).cast("float")).alias("wear"), at(i, 2).alias("x"), at(i, 3).alias("y")),
    )
    return F.filter(every, lambda s: s["id"].isNotNull())
