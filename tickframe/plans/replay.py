"""The query surface over a replay's relations.

Relations (``demo_id`` first in all; ``seq`` orders the whole message stream of a demo):

* ``updates``: seq, tick, entity_id, prop, value - the log of property changes, values as text
  (arrays as JSON); ``sub`` orders those of one message, ``snapshot`` marks what a full packet repeats
* ``lifecycle``: seq, entity_id, kind (``create`` or ``delete``), cls
* ``ticks``: segment_id, seq, tick, net_tick - the end of each entity message
* ``players``: pawn_id, controller_id, steamid, name, team_num, from_seq, to_seq (null: open)
* ``userinfo``: userid, steamid, name
* ``events``: segment_id, seq, tick, event_name, fields (map of text)
* ``header``, ``voice``, ``item_drops``, ``skins``, ``player_info`` as the file reader gives them
* ``chat``, ``server_messages``, ``server_cvars``, ``rank_updates``, ``fire_bullets``, ``bullet_hits`` - the
  messages behind the events of ``made.FROM_MESSAGES``
* ``items``: def_index, name; ``paint_kits``, ``stickers``, ``agents``: id, name - optional labels

All methods return lazy DataFrames; missing relations fail only the methods that need them.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import derived, labels
from ..functions.catalog import ITEM_CLASS, NOT_ITEMS, THROWN_CLASS, Catalog
from ..operators import events as ev
from ..operators import filters, handles, ranges, state
from . import made

_CELL = "CCSPlayerPawn.CBodyComponentBaseAnimGraph.m_cell{}"
_OFFSET = "CCSPlayerPawn.CBodyComponentBaseAnimGraph.m_vec{}"
_BUTTONS = "CCSPlayerPawn.CCSPlayer_MovementServices.m_nButtonDownMaskPrev"
_ANGLES, _LIFE, _GROUND = "CCSPlayerPawn.m_angEyeAngles", "CCSPlayerPawn.m_lifeState", "CCSPlayerPawn.m_hGroundEntity"
_WEAPON, _COLOR = "CCSPlayerPawn.CCSPlayer_WeaponServices.m_hActiveWeapon", "CCSPlayerController.m_iCompTeammateColor"
_ITEM, _TEAM_NUM = "m_iItemDefinitionIndex", "CCSTeam.m_iTeamNum"
_SPOTTED, _AGENT = "CCSPlayerPawn.m_bSpottedByMask", "CCSPlayerController.m_nPawnCharacterDefIndex"
_XUID = ("m_OriginalOwnerXuidHigh", "m_OriginalOwnerXuidLow")
_HELD, _AMMO = "CCSPlayerPawn.CCSPlayer_WeaponServices.m_hMyWeapons", "CCSPlayerPawn.CCSPlayer_WeaponServices.m_iAmmo[14]"
# Fixed values of the format: weapons a player can hold, item attributes (skin, seed, float and six stickers of four), and two items with rules of their own.
SLOTS, ATTRIBUTES, FLASHBANG, C4 = 64, 28, 43, 49
_TYPES = {_BUTTONS: "bigint", _ANGLES: "array<float>", _LIFE: "int", _GROUND: "bigint", _WEAPON: "bigint", _COLOR: "int", _ITEM: "int", _SPOTTED: "bigint", _AGENT: "bigint", _HELD: "int", _AMMO: "int"}
_TYPES |= {_CELL.format(a): "int" for a in "XYZ"} | {_OFFSET.format(a): "float" for a in "XYZ"}
_TYPES |= {f"CBodyComponentBaseAnimGraph.m_cell{a}": "int" for a in "XYZ"} | {f"CBodyComponentBaseAnimGraph.m_vec{a}": "float" for a in "XYZ"}
_TYPES |= {f"{_HELD}[{k}]": "bigint" for k in range(SLOTS)} | {x: "bigint" for x in _XUID}
_TYPES |= {f"{n}[{k}]": "float" for n in ("attribute", "glove") for k in range(ATTRIBUTES)}
#: What each computed property is made of; a prefix says whose property it is where its name does not.
_NEEDS = {a: [_CELL.format(a), _OFFSET.format(a)] for a in "XYZ"} | {b: [_BUTTONS] for b in labels.BUTTONS}
_NEEDS |= {"pitch": [_ANGLES], "yaw": [_ANGLES], "is_alive": [_LIFE], "is_airborne": [_GROUND], "player_color": [_COLOR], "weapon_name": [_ITEM], "game_time": [], "entity_id": [], "user_id": []}
_NEEDS |= {f"velocity_{a}": _NEEDS[a] for a in "XYZ"} | {"velocity": _NEEDS["X"] + _NEEDS["Y"]}
_NEEDS |= {"weapon_skin": ["attribute[0]"], "weapon_skin_id": ["attribute[0]"], "weapon_paint_seed": ["attribute[1]"], "weapon_float": ["attribute[2]"], "weapon_stickers": [f"attribute[{k}]" for k in range(4, ATTRIBUTES)]}
_NEEDS |= {"glove_skin": ["glove[0]"], "glove_paint_id": ["glove[0]"], "glove_paint_seed": ["glove[1]"], "glove_paint_float": ["glove[2]"]}
_NEEDS |= {"active_weapon_original_owner": list(_XUID), "approximate_spotted_by": [_SPOTTED], "agent_skin": [_AGENT]}
_NEEDS |= {n: [_LIFE, _HELD, _AMMO] for n in ("inventory", "inventory_as_ids", "inventory_as_bitmask")}
#: Positions of the stream whose property changes are filled forward by themselves, so that a busy entity is spread over tasks.
SPAN = 1 << 16
#: What makes an entity an item; rows of items that are sent to the executors, and slots that are then asked in place.
_OF_ITEMS, FEW_ITEMS, MOST_JOINS = (_ITEM, "m_hOwnerEntity"), 1 << 19, 16
#: Computed properties that depend on the tick, not only on a player's own properties.
_OF_TICKS = ("game_time", "approximate_spotted_by", "velocity", "velocity_X", "velocity_Y", "velocity_Z")
USER_FIELDS = {"attacker": "attacker", "userid": "user", "assister": "assister", "victim": "victim", "entityid": "user", "userid_pawn": "user"}
_INTERNAL = ("userid", "attacker", "assister", "victim")


def _strings(name: str, value) -> list[str]:
    """A list argument; None is empty, and a bare string is refused."""
    if value is None:
        return []
    if isinstance(value, str) or not isinstance(value, Iterable):
        raise TypeError(f"{name} must be a list of strings")
    value = list(value)
    if not all(isinstance(x, str) for x in value):
        raise TypeError(f"{name} must be a list of strings")
    return value


@dataclass
class WantedPropState:
    prop: str
    state: object


@dataclass
class Replay:
    tables: dict[str, DataFrame]
    catalog: Catalog = field(default_factory=Catalog)
    _asked: tuple[int, int, int] | None = field(default=None, repr=False)

    @classmethod
    def from_files(cls, spark: SparkSession, path, known_events: DataFrame | None = None, entities: bool = False) -> Replay:
        """The relations the file reader gives; those of entities, if asked for, are made again by each query unless cached or written."""
        from ..operators.registry import player_registry
        from ..sources import entities as en
        from ..sources import replay_files as rf
        from ..sources.stringtables import userinfo

        m = rf.read_messages(spark, path)
        told = {"chat": rf.chat(m), "server_messages": rf.server_messages(m), "server_cvars": rf.server_cvars(m), "rank_updates": rf.rank_updates(m), "fire_bullets": rf.fire_bullets(m), "bullet_hits": rf.bullet_hits(m)}
        told |= {"events": rf.events(m, known_events), "header": rf.header(m), "voice": rf.voice(m), "item_drops": rf.item_drops(m), "skins": rf.skins(m), "player_info": rf.player_info(m), "userinfo": userinfo(m)}
        if entities:
            changes = en.entity_changes(m)
            inputs = rf.user_commands(m).withColumn("snapshot", F.lit(False))
            log = en.updates(changes)
            told |= {"updates": log.unionByName(inputs.select(*log.columns)), "lifecycle": en.lifecycle(changes), "ticks": en.tick_spine(m)}
            told["players"] = player_registry(told["updates"])
        return cls(told)

    def table(self, name: str) -> DataFrame:
        if name not in self.tables:
            raise KeyError(f"this replay has no relation {name}")
        return self.tables[name]

    def _lookup(self, rows: DataFrame, key: str, props: list[str]) -> DataFrame:
        """``rows`` with the latest values of ``props`` of the entity in column ``key`` at their ``seq``."""
        props = list(dict.fromkeys(props))
        if not props:
            return rows
        updates = self._changes(props)
        lives = self.table("lifecycle").select("demo_id", F.col("entity_id").alias("__e"), "seq") if "lifecycle" in self.tables else None
        types = {p: _TYPES.get(p) or self.catalog.spark_type(p) for p in props}
        return state.as_of(rows.withColumn("__e", F.col(key)), updates, ["demo_id", "__e"], "seq", props, types, lives, None if self._asked and self._asked[1] < SPAN else SPAN).drop("__e")

    @staticmethod
    def _generalised() -> Column:
        """Weapon and grenade properties without their class, as the catalogue names them; item attributes as ``attribute[i]``, those of gloves as ``glove[i]``."""
        attribute = F.concat(F.when(F.col("prop").startswith("CCSPlayerPawn"), "glove").otherwise("attribute"), F.lit("["), F.coalesce(F.nullif(F.regexp_extract("prop", r"\[(\d+)\]\.m_iRawValue32$", 1), F.lit("")), F.lit("0")), F.lit("]"))
        cls = F.substring_index("prop", ".", 1)
        item = ~F.col("prop").startswith("CCSPlayer") & cls.rlike(ITEM_CLASS) & ~cls.rlike(NOT_ITEMS)
        return F.when(F.col("prop").endswith("m_iRawValue32") & F.col("prop").rlike(r"CEconItemAttribute(\[\d+\])?\.m_iRawValue32$"), attribute).when(item & F.contains("prop", F.lit(".")), F.regexp_replace("prop", r"^[^.]+\.", "")).otherwise(F.col("prop"))

    def _kinds(self, wanted: list[str]) -> dict[str, list[str]]:
        """The properties behind the wanted names, by whose they are."""
        by_kind: dict[str, list[str]] = {}
        for w in dict.fromkeys(wanted):
            real = self._real(w)
            for p in _NEEDS.get(w, [real]) + ([f"{_HELD}[{k}]" for k in range(self._slots())] if w.startswith("inventory") else []):
                kind = "weapon" if p in (_ITEM, *_XUID) or p.startswith("attribute[") else "player" if p.startswith("glove[") else self.catalog.kind(p)
                if p not in by_kind.setdefault(kind, []):
                    by_kind[kind].append(p)
        if by_kind.get("weapon") and _WEAPON not in by_kind.setdefault("player", []):
            by_kind["player"].append(_WEAPON)
        return by_kind

    def _own(self, by_kind: dict[str, list[str]]) -> list[tuple[str, list[str]]]:
        """The properties of players' own entities, with the columns that name these."""
        own = [("pawn_id", by_kind.get("player", []) + by_kind.get("custom", [])), ("controller_id", by_kind.get("controller", []))]
        return [(key, list(dict.fromkeys(props))) for key, props in own if props]

    def _changes(self, props: list[str]) -> DataFrame:
        """The changes of ``props``: demo_id, entity ``__e``, seq, prop (general, see ``_generalised``), value."""
        told = self.table("updates")
        bare = F.substr("prop", F.instr("prop", F.lit(".")) + 1)  # a plain comparison first: most rows need no patterns
        told = told.where(F.col("prop").isin(props) | bare.isin(props) | F.col("prop").endswith("m_iRawValue32"))
        updates = told.withColumn("prop", self._generalised())
        return updates.where(F.col("prop").isin(props)).select("demo_id", F.col("entity_id").alias("__e"), "seq", "prop", "value")

    def _pieces(self, own: list[tuple[str, list[str]]]) -> DataFrame:
        """The registered players cut where a property of ``own`` may change: ``__from``, ``__to`` (excluded; null: open) and their values between."""
        players = self.table("players")
        who = players.where("demo_id is not null and from_seq is not null and (to_seq is null or from_seq < to_seq)")
        told = [c for c in players.columns if c not in ("from_seq", "to_seq")]
        if not own:
            return who.select(*told, F.col("from_seq").alias("__from"), F.col("to_seq").alias("__to"))
        keys = ("demo_id", "pawn_id", "controller_id")
        packed = who.groupBy(*players.columns).agg(F.count("*").alias("__count")).select(F.struct(*players.columns, "__count").alias("__who"), *keys, "from_seq", "to_seq")
        moments = packed.select("__who", F.col("from_seq").alias("seq"))  # only these, so that each use of them reads the same shuffles
        for key, props in own:
            at = self._changes(props).select("demo_id", "__e", "seq")
            if "lifecycle" in self.tables:
                at = at.unionByName(self.table("lifecycle").select("demo_id", F.col("entity_id").alias("__e"), "seq"))
            at = at.distinct().withColumnRenamed("demo_id", "__d")
            there = (F.col("demo_id") == F.col("__d")) & (F.col(key) == F.col("__e")) & (F.col("seq") > F.col("from_seq")) & (F.col("to_seq").isNull() | (F.col("seq") < F.col("to_seq")))
            moments = moments.unionByName(at.join(packed, there).select("__who", "seq"))
        moments = state.until_next(moments, "__who", "seq", "__to", SPAN).where("__to is null or seq < __to")
        moments = moments.select("__who", "seq", "__to", *(F.col("__who").getField(c).alias(c) for c in keys))
        for key, props in own:
            moments = self._lookup(moments, key, props)
        to = F.coalesce("__to", "__who.to_seq")
        values = [F.col(f"`{p}`") for _, props in own for p in props]
        return moments.select(*(F.col("__who").getField(c).alias(c) for c in told), *values, F.col("seq").alias("__from"), to.alias("__to"), F.explode(F.sequence(F.lit(1).cast("bigint"), "__who.__count")).alias("__copy")).drop("__copy")

    def _widths(self, spine: DataFrame, own: list[tuple[str, list[str]]], paired: bool) -> DataFrame:
        """Buckets of ticks: so many that about as many pieces begin inside as reach in from before.

        With ``paired`` all pieces meet the ticks of their buckets: four times as wide, as looking at
        a tick costs less than another row of a piece, and pieces are dealt to shards.
        """
        sides = [self.table("players").groupBy("demo_id").agg(F.count("*").alias("__all"))]
        if own:
            sides.append(self._changes([p for _, props in own for p in props]).groupBy("demo_id").agg(F.count("*").alias("__changes")))
        ends = spine.groupBy("demo_id").agg(F.min("seq").alias("__low"), F.max("seq").alias("__high"), F.count("seq").alias("__points"))
        for side in sides:
            ends = ends.join(F.broadcast(side), "demo_id", "left")
        changes, players = F.coalesce("__changes", F.lit(0)) if own else F.lit(0), F.coalesce("__all", F.lit(1))
        size = F.greatest(F.lit(1), (4 if paired else 1) * players * F.col("__points") / (changes + 1))
        return ranges.bucket_widths(ends, F.least(F.lit(ranges.CELL if paired else 256), size), F.ceil(players / ranges.CELL) if paired else 1)

    def _with_props(self, rows: DataFrame, wanted: list[str], own: bool = False) -> DataFrame:
        """``rows`` (demo_id, seq, pawn_id, controller_id, team_num, net_tick) with a column for each wanted name; ``own``: they have the properties of players' own entities."""
        wanted = list(dict.fromkeys(wanted))
        real = {w: self._real(w) for w in wanted}
        by_kind = self._kinds(wanted)
        for key, props in [] if own else self._own(by_kind):
            rows = self._lookup(rows, key, props)
        if by_kind.get("team"):
            teams = self.table("updates").where(F.col("prop") == _TEAM_NUM).groupBy("demo_id", F.col("value").cast("int").alias("team_num")).agg(F.max_by("entity_id", "seq").alias("__team"))
            rows = self._lookup(rows.join(teams, ["demo_id", "team_num"], "left"), "__team", by_kind["team"])
        if by_kind.get("rules"):
            rules = self.table("updates").where(F.col("prop").startswith("CCSGameRules")).groupBy("demo_id").agg(F.max("entity_id").alias("__rules"))
            rows = self._lookup(rows.join(rules, "demo_id", "left"), "__rules", by_kind["rules"])
        if by_kind.get("weapon"):
            rows = self._lookup(rows.withColumn("__weapon", derived.entity_of(F.col(f"`{_WEAPON}`"))), "__weapon", by_kind["weapon"])
        for w in wanted:
            if w in ("weapon_name", "weapon_skin", "glove_skin", "agent_skin"):
                code, relation, key = {
                    "weapon_name": (F.col(f"`{_ITEM}`"), "items", "def_index"),
                    "weapon_skin": (derived.integral_id(F.col("`attribute[0]`")), "paint_kits", "id"),
                    "glove_skin": (derived.integral_id(F.col("`glove[0]`")), "paint_kits", "id"),
                    "agent_skin": (F.col(f"`{_AGENT}`"), "agents", "id"),
                }[w]
                rows = self.named(rows, code, w, relation, key)
            elif w == "weapon_stickers":
                rows = self._stickers(rows, w)
            elif w == "user_id":
                ids = self.table("userinfo").groupBy(F.col("demo_id").alias("__d"), F.col("steamid").alias("__s")).agg(F.min("userid").alias(w))
                rows = rows.join(ids, (F.col("demo_id") == F.col("__d")) & (F.col("steamid") == F.col("__s")), "left").drop("__d", "__s")
            elif w == "approximate_spotted_by":
                rows = self._spotted(rows, w)
            elif w.startswith("inventory"):
                names = [n for n in wanted if n.startswith("inventory")]
                rows = self._inventory(rows, names, list(real.values())) if w == names[0] else rows
            elif w in _NEEDS and not w.startswith("velocity"):
                rows = rows.withColumn(w, self._computed(w))
            elif w not in _NEEDS and w != real[w]:
                rows = rows.withColumn(w, F.col(f"`{real[w]}`"))
        return rows

    def _real(self, name: str) -> str:
        """The property behind a name; names that are neither computed, nor in the catalogue, nor those of properties are refused."""
        real = self.catalog.resolve(name)
        if name not in _NEEDS and self.catalog.kind(real) == "custom" and "." not in real and not real.startswith("usercmd_"):
            raise ValueError(f"unknown property {name}")
        return real

    def _log(self) -> tuple[int, int, int]:
        """How many of the ``SLOTS`` of an inventory are ever written, the last position, and how many rows tell of items; the log is asked once."""
        if self._asked is None:
            number = F.when(F.col("prop").startswith(f"{_HELD}["), F.regexp_extract("prop", r"\[(\d+)\]$", 1).try_cast("int"))
            told = self.table("updates").agg(F.max(number), F.max("seq"), F.count_if(F.substring_index("prop", ".", -1).isin(*_OF_ITEMS))).first()
            self._asked = 0 if told[0] is None else min(SLOTS, told[0] + 1), told[1] or 0, told[2]
        return self._asked

    def _slots(self) -> int:
        return self._log()[0]

    def _gathered(self, rows: DataFrame, one: Column, value: str, order: str, made: Column) -> DataFrame:
        """``rows`` (as struct ``__row``, one of each) with ``made`` of the list ``__all`` of their ``value``s in order."""
        packed = rows.groupBy("__row").agg(F.sort_array(F.collect_list(F.when(one, F.struct(order, value)))).alias("__all"))
        return packed.select("__row.*", made)

    def _spotted(self, rows: DataFrame, name: str) -> DataFrame:
        """Steam ids of the registered controllers, by number, whose bits are set; null without a mask."""
        mask = F.col(f"`{_SPOTTED}`")
        each = rows.select(F.struct("*").alias("__row"), F.explode_outer(F.when(mask.isNotNull(), derived.spotted_by(mask))).alias("__bit"), "demo_id", "seq")
        who = self.table("players").select(F.col("demo_id").alias("__d"), F.col("controller_id").alias("__c"), F.col("steamid").alias("__steam"), "from_seq", "to_seq")
        there = (F.col("demo_id") == F.col("__d")) & (F.col("__bit") == F.col("__c")) & (F.col("seq") >= F.col("from_seq")) & (F.col("to_seq").isNull() | (F.col("seq") < F.col("to_seq")))
        told = each.join(who, there, "left")
        return self._gathered(told, F.col("__steam").isNotNull(), "__steam", "__bit", F.when(F.col(f"__row.`{_SPOTTED}`").isNotNull(), F.transform("__all", lambda x: x["__steam"])).alias(name))

    def _items(self) -> DataFrame:
        """What each entity was as an item, and whose: demo ``__d``, ``__item``, ``__span`` of positions, ``__from``, ``__to``, ``__def``, ``__owner``, ``__name``."""
        at = self._changes(list(_OF_ITEMS)).select("demo_id", "__e", "seq")
        if "lifecycle" in self.tables:
            at = at.unionByName(self.table("lifecycle").select("demo_id", F.col("entity_id").alias("__e"), "seq"))
        at = at.distinct().withColumnRenamed("__e", "__item").where("demo_id is not null and __item is not null").withColumn("__key", F.struct("demo_id", "__item"))
        told = self._lookup(state.until_next(at, "__key", "seq", "__to", SPAN), "__item", list(_OF_ITEMS)).where(F.col(_ITEM).isNotNull())
        told = self.named(told, F.col(_ITEM), "__name", "items", "def_index")
        last = F.coalesce(F.col("__to") - 1, F.lit(self._log()[1]))
        span = F.explode(F.sequence(F.floor(F.col("seq") / SPAN), F.floor(F.greatest(last, "seq") / SPAN)))
        return told.select(F.col("demo_id").alias("__d"), F.col("__item").cast("bigint").alias("__item"), span.alias("__span"), F.col("seq").alias("__from"), "__to", F.col(_ITEM).alias("__def"), derived.entity_of(F.col("m_hOwnerEntity").cast("bigint")).alias("__owner"), "__name")

    def _inventory(self, rows: DataFrame, names: list[str], kept: list[str]) -> DataFrame:
        """What living players hold, by slot, an entity that stands in several slots once; the dead hold nothing.

        With two flashbangs one more stands in the list, and the bomb is listed only for whom it
        names as its owner.  Items that ``items`` does not name are left out, if there is such a relation.
        Few items are sent to the executors and each row asks for its slots in place; with many,
        a row for each slot goes to them and is gathered again.
        """
        most, end, told = self._log()
        none = F.array().cast("array<struct<slot:int,entity:bigint>>")
        slots = F.concat(none, *(F.array(F.struct(F.lit(k).alias("slot"), derived.item_entity_of(F.col(f"`{_HELD}[{k}]`")).alias("entity"))) for k in range(most)))
        held = F.filter(slots, lambda s: s["entity"].isNotNull() & (s["slot"] < F.col(f"`{_HELD}`")))
        alive = derived.is_alive(F.col(f"`{_LIFE}`"))
        rows = rows.withColumn("__held", F.when(alive, held)).drop(*(c for k in range(most) if (c := f"{_HELD}[{k}]") not in kept))
        rows = rows.withColumn("__held", F.filter("__held", lambda s, i: ~F.exists("__held", lambda o: (o["slot"] < s["slot"]) & (o["entity"] == s["entity"]))))
        items, span = self._items(), F.least(F.floor(F.col("seq") / SPAN), F.lit(end // SPAN))
        value = F.struct("slot", "__def", "__owner", "__name")
        if most <= MOST_JOINS and told * (1 + end // SPAN) <= FEW_ITEMS:
            columns = rows.columns
            for k in range(most):
                own = items.select(*(F.col(c).alias(f"{c}{k}") for c in items.columns))
                c = lambda name: F.col(f"{name}{k}")  # noqa: B023, E731
                here = (F.col("demo_id") == c("__d")) & (F.get("__held", k)["entity"] == c("__item")) & (span == c("__span")) & (F.col("seq") >= c("__from")) & (c("__to").isNull() | (F.col("seq") < c("__to")))
                one = F.when(c("__def").isNotNull(), F.struct(F.get("__held", k)["slot"].alias("slot"), *(c(n).alias(n) for n in ("__def", "__owner", "__name"))))
                rows = rows.join(F.broadcast(own), here, "left").select(*(F.col(f"`{x}`") for x in columns), *(f"__one{i}" for i in range(k)), one.alias(f"__one{k}"))
            empty = F.array().cast("array<struct<slot:int,__def:int,__owner:bigint,__name:string>>")
            rows = rows.withColumn("__all", F.array_compact(F.concat(empty, F.array(*(f"__one{k}" for k in range(most)))) if most else empty)).drop(*(f"__one{k}" for k in range(most)))
        else:
            each = rows.select(F.struct("*").alias("__row"), "demo_id", "seq", F.explode_outer("__held").alias("__each")).select("__row", "demo_id", "seq", "__each.*")
            here = (F.col("demo_id") == F.col("__d")) & (F.col("entity") == F.col("__item")) & (span == F.col("__span")) & (F.col("seq") >= F.col("__from")) & (F.col("__to").isNull() | (F.col("seq") < F.col("__to")))
            packed = each.join(items, here, "left").groupBy("__row").agg(F.sort_array(F.collect_list(F.when(F.col("__def").isNotNull(), value))).alias("__all"))
            rows = packed.select("__row.*", "__all")
        size, twice = F.col(f"`{_HELD}`").isNotNull(), F.col(f"`{_AMMO}`") == 2
        known = lambda x: (x["__def"] != C4) | (x["__owner"] == F.col("pawn_id"))
        listed = F.filter("__all", lambda x: known(x) & (x["__name"].isNotNull() if "items" in self.tables else F.lit(True)))
        for name in names:
            field = "__name" if name == "inventory" else "__def"
            values = F.flatten(F.transform(listed, lambda x: F.array_repeat(x[field], F.when((x["__def"] == FLASHBANG) & twice, 2).otherwise(1))))  # noqa: B023
            empty = F.array().cast("array<string>" if name == "inventory" else "array<int>")
            if name == "inventory_as_bitmask":
                values, empty = derived.item_bitmask(values), F.lit(0).cast("bigint")
            rows = rows.withColumn(name, F.when(~alive, empty).when(size, values))
        return rows.drop("__held", "__all")

    def _stickers(self, rows: DataFrame, name: str) -> DataFrame:
        """Stickers as id, name, wear, x and y; a slot counts only if all four numbers are there."""
        for k in range(4, ATTRIBUTES, 4):
            rows = rows.withColumn(f"__id{k}", derived.float_bits(F.col(f"`attribute[{k}]`")))
        at = lambda k: F.col(f"`attribute[{k}]`")
        label = F.lit("unknown")
        if "stickers" in self.tables:
            table = self.table("stickers").agg(F.map_from_entries(F.collect_list(F.struct(F.col("id").cast("bigint"), "name"))).alias("__stickers"))
            rows = rows.crossJoin(table)  # one row
        def one(k: int) -> Column:
            named = F.coalesce(F.try_element_at("__stickers", F.col(f"__id{k}")), label) if "stickers" in self.tables else label
            told = F.struct(F.col(f"__id{k}").alias("id"), named.alias("name"), F.greatest(at(k + 1), F.lit(0).cast("float")).alias("wear"), at(k + 2).alias("x"), at(k + 3).alias("y"))
            return F.when(at(k).isNotNull() & at(k + 1).isNotNull() & at(k + 2).isNotNull() & at(k + 3).isNotNull(), told)

        every = F.array_compact(F.array(*(one(k) for k in range(4, ATTRIBUTES, 4))))
        return rows.withColumn(name, every).drop("__stickers", *(f"__id{k}" for k in range(4, ATTRIBUTES, 4)))

    def weapon_details(self, rows: DataFrame, key: str) -> DataFrame:
        """``rows`` with ``float, skin, skin_id, paint_seed, stickers, custom_name`` of the weapon whose entity stands in ``key``."""
        held = rows.columns
        told = self._lookup(rows, key, [*(f"attribute[{k}]" for k in (0, 1, 2, *range(4, ATTRIBUTES))), "m_szCustomName"])
        told = told.withColumns({"float": F.col("`attribute[2]`"), "skin_id": derived.integral_id(F.col("`attribute[0]`")), "paint_seed": F.col("`attribute[1]`"), "custom_name": F.col("m_szCustomName")})
        told = self._stickers(self.named(told, F.col("skin_id"), "skin", "paint_kits", "id"), "stickers")
        return told.select(*held, "float", "skin", "skin_id", "paint_seed", "stickers", "custom_name")

    def registered(self, rows: DataFrame, key: str, column: str, how: str = "inner") -> DataFrame:
        """``rows`` with ``name, steamid, pawn_id, controller_id, team_num`` of the player whose ``column`` equals ``key`` at their ``seq``."""
        if how == "left" and "players" not in self.tables:
            return rows.withColumns({c: F.lit(None).cast(t) for c, t in (("name", "string"), ("steamid", "bigint"), ("pawn_id", "int"), ("controller_id", "int"), ("team_num", "int"))})
        who = self.table("players").select(F.col("demo_id").alias("__d"), F.col(column).alias("__k"), "name", "steamid", "pawn_id", "controller_id", "team_num", "from_seq", "to_seq")
        valid = (F.col("demo_id") == F.col("__d")) & (F.col(key) == F.col("__k")) & (F.col("seq") >= F.col("from_seq")) & (F.col("to_seq").isNull() | (F.col("seq") < F.col("to_seq")))
        return rows.join(who, valid, how).drop("__d", "__k", "from_seq", "to_seq")

    def _computed(self, name: str) -> Column:
        c = lambda p: F.col(f"`{p}`")
        if name in ("X", "Y", "Z"):
            return derived.cell_coord(c(_CELL.format(name)), c(_OFFSET.format(name)))
        if name in labels.BUTTONS:
            return derived.button(c(_BUTTONS), name)
        return {
            "pitch": lambda: derived.pitch(c(_ANGLES)),
            "yaw": lambda: derived.yaw(c(_ANGLES)),
            "is_alive": lambda: derived.is_alive(c(_LIFE)),
            "is_airborne": lambda: derived.is_airborne(c(_GROUND)),
            "player_color": lambda: derived.player_color(c(_COLOR)),
            "game_time": lambda: derived.game_time(F.col("net_tick")),
            "entity_id": lambda: F.col("pawn_id"),
            "weapon_skin_id": lambda: derived.integral_id(c("attribute[0]")),
            "weapon_paint_seed": lambda: derived.paint_seed(c("attribute[1]")),
            "weapon_float": lambda: c("attribute[2]"),
            "glove_paint_id": lambda: derived.integral_id(c("glove[0]")),
            "glove_paint_seed": lambda: c("glove[1]"),
            "glove_paint_float": lambda: c("glove[2]"),
            "active_weapon_original_owner": lambda: derived.owner_xuid(*(c(x) for x in _XUID)),
        }[name]()

    def named(self, rows: DataFrame, code: Column, name: str, relation: str, key: str) -> DataFrame:
        """``rows`` with the label of ``code`` as ``name``; null where the relation, or its entry, is not there."""
        if relation not in self.tables:
            return rows.withColumn(name, F.lit(None).cast("string"))
        told = self.table(relation).groupBy(F.col(key).alias("__def")).agg(F.min("name").alias("__label"))
        return rows.withColumn("__code", code).join(told, F.col("__code") == F.col("__def"), "left").withColumnRenamed("__label", name).drop("__def", "__code")

    def ticks(self, props: list[str], *, players: list[int] | None = None, ticks=None, prop_states: list[WantedPropState] | None = None, segment_parity: bool = False) -> DataFrame:
        """The wanted properties of each registered player at each tick, with ``tick, steamid, name``.

        ``prop_states`` keep the players of a tick, by pawn, before the first that misses a
        wanted value.  Velocities look at the player's two rows before among the wanted ticks;
        with ``segment_parity`` they start anew in each segment.
        """
        props = _strings("wanted_props", props)
        states = list(prop_states or [])
        spine = filters.at_ticks(self.table("ticks"), ticks)
        wanted = props + [s.prop for s in states]
        wanted += [a for p in props if p.startswith("velocity") and p in _NEEDS for a in (("X", "Y") if p == "velocity" else (p[-1],))]
        if any(w.startswith("inventory") for w in wanted):  # a change of each slot: more pieces than ticks
            who = self.table("players").withColumnRenamed("demo_id", "__demo")
            alive = (F.col("demo_id") == F.col("__demo")) & (F.col("seq") >= F.col("from_seq")) & (F.col("to_seq").isNull() | (F.col("seq") < F.col("to_seq")))
            rows = self._with_props(spine.join(who, alive).drop("__demo", "from_seq", "to_seq"), wanted)
            whole = bool(states)
        else:
            own = self._own(self._kinds(wanted))
            whole = any(s.prop in _OF_TICKS or {"weapon", "team", "rules"} & set(self._kinds([s.prop])) for s in states)
            pieces, widths = self._pieces(own), self._widths(spine, own, whole or not states)
            if states and not whole:
                fits = F.lit(True)
                held = self._with_props(pieces.withColumns({"__rank": F.coalesce(F.col("pawn_id").cast("bigint"), F.lit(-1 << 62))}), [s.prop for s in states], True)
                for s in states:
                    fits &= F.col(f"`{s.prop}`") == F.lit(s.state)
                held = held.select(*(F.col(f"`{c}`") for c in pieces.columns), "__rank", F.coalesce(fits, F.lit(False)).alias("__fits"))
                spine = ranges.least_over(spine, held.where("not __fits"), ["demo_id"], "seq", "__rank", widths)
                rows = ranges.points_in_pieces(spine, filters.of_players(held.where("__fits"), players), ["demo_id"], "seq", widths, "__rank").drop("__first", "__rank", "__fits")
            else:
                rows = ranges.points_in_pieces(spine, pieces if whole else filters.of_players(pieces, players), ["demo_id"], "seq", widths)
            rows = self._with_props(rows, wanted, True)
        if whole:
            rows = filters.prop_states(rows, {s.prop: s.state for s in states}, ["demo_id", "seq"], ["pawn_id"])
        rows = filters.of_players(rows, players)
        by = ["demo_id", *(["segment_id"] if segment_parity else []), "steamid"]
        axis = lambda a: derived.velocity_axis(F.col(a), by, ["seq"])
        for p in props:
            if p in _NEEDS and p.startswith("velocity"):
                rows = rows.withColumn(p, derived.velocity(axis("X"), axis("Y")) if p == "velocity" else axis(p[-1]))
        return rows.select(*(F.col(f"`{p}`") for p in dict.fromkeys(props)), "demo_id", "tick", derived.steamid(F.col("steamid")).alias("steamid"), "name")

    def events(self, names: list[str], *, player: list[str] | None = None, other: list[str] | None = None) -> dict[str, DataFrame]:
        """A DataFrame for each named event; ``all`` gives every event there is, for which names are read first."""
        names = _strings("event_names", names)
        if "all" in names:
            names = [r[0] for r in self.event_names().collect()]  # one row for each kind of event
            names += [n for n in made.FROM_STATE if (own := made.made(self, n)) is not None and own.head(1)]
        return {n: self.event(n, player=player, other=other) for n in dict.fromkeys(names)}

    def event(self, name: str, *, player: list[str] | None = None, other: list[str] | None = None) -> DataFrame:
        """One kind of event: its fields, the players behind them with their properties, and global properties.

        Besides the events that a file holds there are those of ``made``, such as ``round_end``,
        ``item_purchase`` and ``chat_message``; of one name, both kinds come.  For each field that
        refers to a player there are ``<prefix>_name``, ``<prefix>_steamid`` and ``<prefix>_<property>``,
        as of the event's place in the stream (some events' at the end of their packet); players that
        are not found leave nulls, and velocities, which come from a player's rows before, are null.
        Team properties give ``t_`` and ``ct_`` columns, rules properties stand under their own
        name, in either list.  Columns are sorted.  An event that never happens gives no rows and
        only the fixed columns.
        """
        if not isinstance(name, str):
            raise TypeError("event_name must be a string")
        player, other = _strings("player", player), _strings("other", other)
        one, keys = self._native(name)
        own = made.made(self, name)
        if own is not None:
            kinds = dict(own.dtypes)
            one = own if not keys and not one.head(1) else own.unionByName(one.select(*(F.col(f"`{c}`").cast(kinds.get(c, "string")).alias(c) for c in one.columns)), allowMissingColumns=True)
        if "hitgroup" in keys:
            one = ev.label_hits(one)
        users = {k: p for k, p in USER_FIELDS.items() if k in keys and (p != "user" or k == handles.pawn_field(set(keys)))}
        for k, prefix in users.items():
            one = self._user(one, k, prefix, player)
        for k, column in (("__pawn", "pawn_id"), ("__controller", "controller_id")):
            if k in one.columns:
                one = self._player(one, k, column, "user", player, keep_id=column == "pawn_id", named=name not in made.NAMED)
        for w in dict.fromkeys(player + other):
            kind = "rules" if w == "game_time" and w in other else "" if w in _NEEDS else self.catalog.kind(self._real(w))
            if kind == "team":
                one = self._teams(one, w)
            elif kind == "rules":
                one = self._rules(one, w)
        return filters.sorted_columns(one.drop("seq", "__pawn", "__controller", *(c for c in one.columns if c in _INTERNAL or c.endswith("_pawn"))))

    def _native(self, name: str) -> tuple[DataFrame, list[str]]:
        """The file's own events of a name, a column for each field, and the fields."""
        rows = filters.events_named(filters.without_replaced(self.table("events")), [name])
        keys = [r[0] for r in rows.select(F.explode(F.map_keys("fields")).alias("k")).distinct().collect()]  # the fields of one kind
        one = rows.select("demo_id", "seq", "tick", *(F.try_element_at("fields", F.lit(k)).alias(k) for k in keys))
        if name in labels.DEFERRED_EVENTS and "ticks" in self.tables:
            spine = self.table("ticks").select(F.col("demo_id").alias("__d"), F.col("tick").alias("__t"), F.col("seq").alias("__end"))
            ends = spine.groupBy("__d", "__t").agg(F.max("__end").alias("__end"))
            later = one.join(ends, (F.col("demo_id") == F.col("__d")) & (F.col("tick") == F.col("__t")), "left")
            one = later.withColumn("seq", F.greatest("seq", "__end")).select(*(F.col(f"`{c}`") for c in one.columns))
        return one, keys

    def _user(self, rows: DataFrame, key: str, prefix: str, props: list[str]) -> DataFrame:
        """``rows`` with the player that a field names: by user id, as the owner of a grenade (``entityid``) or by pawn handle."""
        code = F.col(f"`{key}`").try_cast("bigint")
        if key == "userid_pawn":
            told = self._player(rows.withColumn("__of", derived.entity_of(code)), "__of", "pawn_id", prefix, props, keep_id=True)
        elif key == "entityid":
            owned = self._lookup(rows.withColumn("__entity", code.cast("int")), "__entity", ["m_nOwnerId"])
            told = self._player(owned.withColumn("__of", derived.entity_of(F.col("m_nOwnerId").cast("bigint"))).drop("m_nOwnerId", "__entity"), "__of", "pawn_id", prefix, props, keep_id=True)
        else:
            known = handles.user_of(rows, self.table("userinfo").select("demo_id", "userid", "name", "steamid"), code, "__user", ["demo_id"])
            told = self._player(known.withColumn("__of", F.col("__user_steamid").cast("bigint")), "__of", "steamid", prefix, props)
            told = told.withColumn(f"{prefix}_steamid", F.col("__user_steamid"))
            if "players" not in self.tables:  # entities were not asked for
                told = told.withColumn(f"{prefix}_name", F.col("__user_name"))
        return told.drop("__of", "__user_name", "__user_steamid")

    def _player(self, rows: DataFrame, key: str, column: str, prefix: str, props: list[str], *, keep_id: bool = False, named: bool = True) -> DataFrame:
        """``rows`` with name, steam id and properties of the registered player whose ``column`` is ``key``.

        ``keep_id``: properties of the pawn ``key`` come even if no player is registered for it.
        """
        held = [c for c in rows.columns]
        packed = rows.select("demo_id", "seq", F.col(key).alias("__key"), F.struct(*(F.col(f"`{c}`") for c in held)).alias("__held"))
        found = self.registered(packed, "__key", column, "left")
        if keep_id:
            found = found.withColumn("pawn_id", F.coalesce("pawn_id", F.col("__key").cast("int")))
        moving = [p for p in props if p.startswith("velocity") and p in _NEEDS]
        shown = [p for p in props if p not in moving and (p in _NEEDS or self.catalog.kind(self._real(p)) != "rules")]
        found = self._with_props(found.withColumn("net_tick", F.lit(None).cast("bigint")), shown)
        extra = [F.lit(None).cast("float").alias(f"{prefix}_{p}") if p in moving else F.col(f"`{p}`").alias(f"{prefix}_{p}") for p in dict.fromkeys(p for p in props if p in moving or p in shown)]
        who = [F.col("name").alias(f"{prefix}_name"), F.col("steamid").cast("string").alias(f"{prefix}_steamid")] if named else []
        return found.select(*(F.col("__held").getField(c).alias(c) for c in held), *who, *extra)

    def _teams(self, rows: DataFrame, name: str) -> DataFrame:
        prop = self.catalog.resolve(name)
        teams = self.table("updates").where(F.col("prop") == _TEAM_NUM).groupBy("demo_id").agg(*(F.max_by("entity_id", F.when(F.col("value").cast("int") == n, F.col("seq"))).alias(f"__{s}") for s, n in (("t", 2), ("ct", 3))))
        out = rows.join(teams, "demo_id", "left")
        for side in ("t", "ct"):
            out = self._lookup(out, f"__{side}", [prop]).withColumnRenamed(prop, f"{side}_{name}")
        return out.drop("__t", "__ct")

    def _rules(self, rows: DataFrame, name: str) -> DataFrame:
        if name == "game_time":
            spine = self.table("ticks").select("demo_id", F.col("tick").alias("__tick"), "net_tick").groupBy("demo_id", "__tick").agg(F.max("net_tick").alias("__net"))
            return rows.join(spine, (rows.demo_id == spine.demo_id) & (rows.tick == spine["__tick"]), "left").select(*(rows[c] for c in rows.columns), derived.game_time(F.col("__net")).alias(name))
        prop = self.catalog.resolve(name)
        rules = self.table("updates").where(F.col("prop").startswith("CCSGameRules")).groupBy("demo_id").agg(F.max("entity_id").alias("__rules"))
        return self._lookup(rows.join(rules, "demo_id", "left"), "__rules", [prop]).withColumnRenamed(prop, name).drop("__rules")

    def grenades(self, *, extra: list[str] | None = None, grenades: bool = True) -> DataFrame:
        """Each live grenade with a registered thrower at each tick: class, entity, place, thrower and extra properties."""
        extra = _strings("extra", extra)
        real = {w: self._real(w) for w in extra}
        lives = self.table("lifecycle").where(F.col("cls").rlike("Projectile|Grenade"))
        lives = lives.select("demo_id", "entity_id", "seq", "kind", F.col("cls").alias("grenade_type"))
        spans = state.generations(lives.drop("grenade_type"), ["demo_id", "entity_id"], "seq")
        born = lives.where("kind = 'create'").select("demo_id", "entity_id", F.col("seq").alias("from"), "grenade_type")
        spans = spans.join(born, ["demo_id", "entity_id", "from"]).withColumnRenamed("demo_id", "__d")
        there = (F.col("demo_id") == F.col("__d")) & (F.col("seq") >= F.col("from")) & (F.col("to").isNull() | (F.col("seq") < F.col("to")))
        rows = filters.grenade_rows(self.table("ticks").join(spans, there).drop("__d", "from", "to", "generation"), grenades)
        place = {a.lower(): (f"CBodyComponentBaseAnimGraph.m_cell{a}", f"CBodyComponentBaseAnimGraph.m_vec{a}") for a in "XYZ"}
        rows = self._lookup(rows, "entity_id", ["m_hOwnerEntity", *(p for pair in place.values() for p in pair), *real.values()])
        who = self.table("players").select(F.col("demo_id").alias("__d"), "pawn_id", "name", "steamid", "from_seq", "to_seq")
        owner = (F.col("demo_id") == F.col("__d")) & (derived.entity_of(F.col("m_hOwnerEntity")) == F.col("pawn_id")) & (F.col("seq") >= F.col("from_seq")) & (F.col("to_seq").isNull() | (F.col("seq") < F.col("to_seq")))
        thrown = rows.join(who, owner)
        projectile = F.contains("grenade_type", F.lit("Projectile"))
        coords = [F.when(projectile, derived.cell_coord(F.col(f"`{c}`"), F.col(f"`{o}`"))).alias(a) for a, (c, o) in place.items()]
        return thrown.select("demo_id", "grenade_type", F.col("entity_id").alias("grenade_entity_id"), *coords, "tick", "steamid", "name", *(F.col(f"`{p}`").alias(w) for w, p in real.items()))

    def player_info(self) -> DataFrame:
        """Players of the end of the match, or if there is no such relation the last registry rows."""
        if "player_info" in self.tables:
            return self.table("player_info").select("demo_id", "steamid", "name", "team_number")
        last = ev.last_per_key(self.table("players").select("demo_id", "steamid", "name", "team_num", "from_seq"), ["demo_id", "steamid"], "from_seq")
        return last.select("demo_id", "steamid", "name", F.col("team_num").alias("team_number"))

    def item_drops(self) -> DataFrame:
        return self.table("item_drops")

    def skins(self) -> DataFrame:
        return self.table("skins").where("item_id <> 0")

    def voice(self) -> DataFrame:
        return self.table("voice").select("demo_id", "tick", "steamid", "bytes")

    def header(self) -> DataFrame:
        return self.table("header")

    def event_names(self) -> DataFrame:
        """Names of the file's events, and of those that other messages tell of; events made from state changes are not listed."""
        names = filters.without_replaced(self.table("events")).select("event_name")
        for name, (_, relation) in made.FROM_MESSAGES.items():
            if relation in self.tables:
                names = names.unionAll(self.table(relation).select(F.lit(name).alias("event_name")))
        return ev.distinct_sorted(names, "event_name")

    def updated_fields(self) -> DataFrame:
        """Sorted names of all properties that were written, weapon and grenade classes as ``Weapon.`` and ``Grenade.``."""
        cls = F.substring_index("prop", ".", 1)
        rest = F.regexp_replace("prop", r"^[^.]+\.", "")
        shown = F.when(cls.rlike(THROWN_CLASS) & ~cls.rlike(NOT_ITEMS), F.concat(F.lit("Grenade."), rest)).when(cls.rlike(ITEM_CLASS) & ~cls.rlike(NOT_ITEMS), F.concat(F.lit("Weapon."), rest))
        return ev.distinct_sorted(self.table("updates").select(F.coalesce(shown, F.col("prop")).alias("prop")), "prop")
