"""Events made from state and messages, players behind all kinds of fields, and computed properties, over a hand-written replay."""

import pytest

from tickframe.functions.labels import STEAMID_BASE
from tickframe.plans import replay as rp
from tickframe.plans.replay import Replay

PAWN, CTRL, RULES = "CCSPlayerPawn.", "CCSPlayerController.", "CCSGameRulesProxy.CCSGameRules."
A, B = STEAMID_BASE + 7, STEAMID_BASE + 9
HELD, ATTRIBUTE = PAWN + "CCSPlayer_WeaponServices.m_hMyWeapons", "CAK47.CEconItemAttribute[{}].m_iRawValue32"
SELL = PAWN + "CCSPlayer_BuyServices.SellbackPurchaseEntry_t[{}].{}"
COUNT = PAWN + "CCSPlayer_ActionTrackingServices.WeaponPurchaseCount_t[{}].m_nCount"


@pytest.fixture(scope="module")
def replay(spark):
    log = [
        (90, 2, RULES + "m_nRoundStartCount", 1), (90, 2, RULES + "m_nRoundEndCount", 0), (90, 2, RULES + "m_totalRoundsPlayed", 0), (90, 2, RULES + "m_nMatchEndCount", 0),
        (90, 12, RULES + "m_nRoundEndCount", 1), (90, 12, RULES + "m_eRoundWinReason", 8), (90, 13, RULES + "m_totalRoundsPlayed", 1), (90, 14, RULES + "m_nRoundStartCount", 2),
        (90, 22, RULES + "m_nRoundEndCount", 2), (90, 22, RULES + "m_eRoundWinReason", 77), (90, 24, RULES + "m_nRoundEndCount", 5), (90, 25, RULES + "m_nMatchEndCount", 1),
        (11, 1, CTRL + "m_steamID", A), (12, 1, CTRL + "m_steamID", B), (11, 2, CTRL + "m_nPawnCharacterDefIndex", 4613),
        (1, 2, PAWN + "m_iHealth", 100), (2, 2, PAWN + "m_iHealth", 55), (1, 2, PAWN + "m_lifeState", 0), (2, 2, PAWN + "m_lifeState", 0), (2, 20, PAWN + "m_lifeState", 1),
        (1, 2, PAWN + "CCSPlayer_WeaponServices.m_hActiveWeapon", 0x8000 | 50), (1, 2, PAWN + "m_bSpottedByMask", (1 << 10) | (1 << 11) | 1),
        (1, 2, HELD, 6), (1, 2, HELD + "[0]", 0x8000 | 50), (1, 2, HELD + "[1]", 0xC000 | 51), (1, 2, HELD + "[2]", 0x4000 | 50), (1, 2, HELD + "[3]", 52), (1, 2, HELD + "[4]", 53), (1, 2, HELD + "[5]", 99), (1, 2, HELD + "[6]", 54),
        (2, 2, HELD, 1), (2, 2, HELD + "[0]", 53),
        (50, 2, "CAK47.m_iItemDefinitionIndex", 7), (51, 2, "CFlashbang.m_iItemDefinitionIndex", 43), (52, 2, "CKnife.m_iItemDefinitionIndex", 500), (53, 2, "CC4.m_iItemDefinitionIndex", 49), (54, 2, "CDEagle.m_iItemDefinitionIndex", 1),
        (53, 2, "CC4.m_hOwnerEntity", 0x8000 | 2), (1, 2, PAWN + "CCSPlayer_WeaponServices.m_iAmmo[14]", 2),
        *((50, 2, ATTRIBUTE.format(k), v) for k, v in ((0, 44.0), (1, 661.0), (2, 0.25), (4, 1.0), (5, -0.5), (6, 0.5), (7, 0.125), (8, 2.0))),
        (50, 2, "CAK47.m_OriginalOwnerXuidHigh", 17825793), (50, 2, "CAK47.m_OriginalOwnerXuidLow", 7), (50, 2, "CAK47.m_szCustomName", "Mine"),
        (1, 2, PAWN + "CEconItemAttribute[0].m_iRawValue32", 10.5), (1, 2, PAWN + "CEconItemAttribute[1].m_iRawValue32", 3.0),
        (60, 3, "CSmokeGrenadeProjectile.m_nOwnerId", 0x8000 | 2),
        # A buys slot 3 (skin and all), sells it, buys it again; B buys without a handle.
        (1, 16, SELL.format(3, "m_unDefIdx"), 7), (1, 16, SELL.format(3, "m_nCost"), 2700), (1, 16, SELL.format(3, "m_hItem"), 0x8000 | 50), (1, 17, COUNT.format(3), 0),
        (1, 21, SELL.format(3, "m_unDefIdx"), 7), (1, 21, SELL.format(3, "m_nCost"), 2700), (1, 21, SELL.format(3, "m_hItem"), 0x8000 | 50), (2, 18, SELL.format(0, "m_unDefIdx"), 999), (2, 18, SELL.format(0, "m_nCost"), 50),
    ]
    snapshot = [(90, 19, RULES + "m_nRoundEndCount", 1), (1, 19, SELL.format(3, "m_unDefIdx"), 7), (1, 19, SELL.format(3, "m_nCost"), 2700)]
    tick = lambda s: 1 + (s > 10) + (s > 15) + (s > 16) + (s > 19)
    rows = [("d", e, s, k, tick(s), p, str(v), s == 19) for k, (e, s, p, v) in enumerate(sorted(log + snapshot, key=lambda x: x[1]))]
    message = "demo_id string, segment_id int, seq long, sub int, tick int, net_tick long, "
    one = lambda seq, *more: ("d", 0, seq, 0, tick(seq), 0, *more)
    bullets = {"player": 0x8000 | 1, "weapon_id": 5}
    t = {
        "updates": spark.createDataFrame(rows, "demo_id string, entity_id int, seq long, sub int, tick int, prop string, value string, snapshot boolean"),
        "ticks": spark.createDataFrame([("d", 0, 10, 1, 64), ("d", 0, 15, 2, 128), ("d", 1, 30, 5, 192)], "demo_id string, segment_id int, seq long, tick int, net_tick long"),
        "players": spark.createDataFrame([("d", 1, 11, A, "Al", 2, 1, None), ("d", 2, 12, B, "Bo", 3, 1, None), ("d", 1, 11, A, "Al2", 2, 28, None)][:2], "demo_id string, pawn_id int, controller_id int, steamid long, name string, team_num int, from_seq long, to_seq long"),
        "userinfo": spark.createDataFrame([("d", 5, A, "Al"), ("d", 261, B, "Bo")], "demo_id string, userid int, steamid long, name string"),
        "events": spark.createDataFrame(
            [
                ("d", 0, 11, 2, "player_death", {"userid": "5"}), ("d", 0, 11, 2, "player_death", {"userid": "261"}), ("d", 0, 12, 2, "player_death", {"userid": "517"}),
                ("d", 0, 13, 2, "smoke_started", {"entityid": "60"}), ("d", 0, 13, 2, "weapon_fire", {"userid_pawn": str(0x8000 | 2), "weapon": "ak47"}),
                ("d", 0, 13, 2, "both", {"userid": "5", "entityid": "60", "userid_pawn": str(0x8000 | 2)}), ("d", 0, 9, 1, "inferno_expire", {"entityid": "60"}), ("d", 0, 9, 1, "round_end", {"round": "9", "note": "native"}),
            ],
            "demo_id string, segment_id int, seq long, tick int, event_name string, fields map<string,string>",
        ),
        "items": spark.createDataFrame([(7, "AK-47"), (43, "Flashbang"), (49, "C4 Explosive"), (1, "Desert Eagle")], "def_index int, name string"),
        "paint_kits": spark.createDataFrame([(44, "Case Hardened")], "id int, name string"),
        "stickers": spark.createDataFrame([(1065353216, "One")], "id long, name string"),
        "agents": spark.createDataFrame([(4613, "Agent")], "id int, name string"),
        "chat": spark.createDataFrame([one(12, 12, "gg"), one(12, 77, "who")], message + "controller_id int, chat_message string"),
        "server_messages": spark.createDataFrame([one(3, "hello")], message + "server_message string"),
        "server_cvars": spark.createDataFrame([one(3, "sv_x", "1")], message + "name string, value string"),
        "rank_updates": spark.createDataFrame([one(26, 7, 3, 4, 9, 1.5, 12), one(26, 8, 3, 4, 9, 1.5, 12)], message + "account_id int, rank_old int, rank_new int, num_wins int, rank_change float, rank_type_id int"),
        "fire_bullets": spark.createDataFrame([one(13, *bullets.values())], message + ", ".join(f"{k} long" for k in bullets)),
        "bullet_hits": spark.createDataFrame([one(13, 1, 2)], message + "attacker_slot int, damage int"),
    }
    return Replay(t)


def rows(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


def test_rounds_and_match_end(replay):
    got = replay.event("round_end", other=["total_rounds_played"])
    assert got.columns == sorted(got.columns)
    key = lambda r: (r["round"], str(r["reason"]))
    assert [(r["round"], r.reason, r.winner, r.tick, r.note) for r in sorted(got.collect(), key=key)] == [(0, "t_killed", "CT", 2, None), (1, "77", "77", 5, None), (9, None, None, 1, "native")]
    assert rows(replay.event("round_start"), "round", "tick") == [(2, 2)]
    assert rows(replay.event("round_officially_ended", player=["team_rounds_total", "total_rounds_played"]), "tick", "total_rounds_played") == [(2, 1)]
    assert rows(replay.event("cs_win_panel_match"), "tick") == [(5,)]


def test_purchases_know_their_weapon_and_whether_it_was_sold(replay):
    got = {(r.name, r.tick): r for r in replay.event("item_purchase", player=["health"]).collect()}
    assert sorted(got) == [("Al", 3), ("Al", 5), ("Bo", 4)]
    first, again, other = got["Al", 3], got["Al", 5], got["Bo", 4]
    assert (first.item_name, first.cost, first.inventory_slot, first.steamid, first.was_sold, first.user_health) == ("AK-47", 2700, 3, str(A), True, 100)
    assert (first.skin, first.skin_id, first.paint_seed, first.float, first.custom_name) == ("Case Hardened", 44, 661.0, 0.25, "Mine")
    assert [tuple(s) for s in first.stickers] == [(1065353216, "One", 0.0, 0.5, 0.125)]
    assert not again.was_sold
    assert (other.item_name, other.cost, other.inventory_slot, other.skin_id, other.was_sold) == (None, 50, 0, None, False)


def test_messages_as_events(replay):
    assert sorted(replay.event("chat_message", player=["health"]).select("user_name", "user_steamid", "chat_message", "user_health").collect(), key=lambda r: r.chat_message) == [("Bo", str(B), "gg", 55), (None, None, "who", None)]
    assert rows(replay.event("server_message"), "server_message", "tick") == [("hello", 1)]
    assert rows(replay.event("server_cvar"), "name", "value") == [("sv_x", "1")]
    assert rows(replay.event("rank_update"), "user_name", "user_steamid", "rank_new", "num_wins") == [("Al", str(A), 4, 9)]
    assert rows(replay.event("fire_bullets", player=["health"]), "user_name", "user_health", "weapon_id") == [("Al", 100, 5)]
    assert rows(replay.event("player_bullet_hit"), "attacker_slot", "damage") == [(1, 2)]
    assert rows(replay.event("player_first_connect", player=["health"]), "name", "steamid", "team", "player_entity_id", "tick") == [("Al", str(A), "T", 1, 1), ("Bo", str(B), "CT", 2, 1)]
    assert {"chat_message", "server_cvar", "rank_update", "smoke_started"} <= {r[0] for r in replay.event_names().collect()}
    assert {"round_end", "item_purchase", "chat_message", "weapon_fire"} <= set(replay.events(["all"]))


def test_players_behind_ids_handles_and_grenades(replay):
    assert rows(replay.event("player_death"), "user_name", "user_steamid") == [("Al", str(A)), ("Al", str(A)), ("Bo", str(B))]  # 517 is unknown: its low byte is that of 5
    got = replay.event("weapon_fire", player=["health", "velocity"])
    assert rows(got, "user_name", "user_health", "user_velocity") == [("Bo", 55, None)]
    assert "userid_pawn" not in got.columns
    assert rows(replay.event("smoke_started", player=["health"]), "entityid", "user_name", "user_health") == [("60", "Bo", 55)]
    assert rows(replay.event("both"), "user_name") == [("Al",)]
    assert rows(replay.event("inferno_expire"), "user_name", "tick") == [("Bo", 1)]


def test_what_players_hold(replay):
    got = {(r.steamid, r.tick): r for r in replay.ticks(["inventory", "inventory_as_ids", "inventory_as_bitmask"]).collect()}
    assert got[A, 1].inventory == ["AK-47", "Flashbang", "Flashbang"]  # the knife has no name, the bomb is another's, slot 6 is past the end
    assert got[A, 1].inventory_as_ids == [7, 43, 43]
    assert got[A, 1].inventory_as_bitmask == (1 << 7) | (1 << 43)
    assert got[B, 1].inventory == ["C4 Explosive"]
    assert (got[B, 5].inventory, got[B, 5].inventory_as_ids, got[B, 5].inventory_as_bitmask) == ([], [], 0)  # dead by then


def test_weapons_gloves_and_players(replay):
    wanted = ["weapon_skin", "weapon_skin_id", "weapon_paint_seed", "weapon_float", "weapon_stickers", "active_weapon_original_owner", "glove_paint_id", "glove_skin", "glove_paint_seed", "glove_paint_float"]
    got = {r.steamid: r for r in replay.ticks([*wanted, "user_id", "agent_skin", "approximate_spotted_by"], ticks=[1]).collect()}
    a, b = got[A], got[B]
    assert (a.weapon_skin, a.weapon_skin_id, a.weapon_paint_seed, a.weapon_float, a.active_weapon_original_owner) == ("Case Hardened", 44, 661, 0.25, str((17825793 << 32) + 7))
    assert [tuple(s) for s in a.weapon_stickers] == [(1065353216, "One", 0.0, 0.5, 0.125)]
    assert (a.glove_paint_id, a.glove_skin, a.glove_paint_seed, a.glove_paint_float) == (None, None, 3.0, None)  # 10.5 is no id
    assert (a.user_id, a.agent_skin, a.approximate_spotted_by) == (5, "Agent", [A, B])
    assert (b.user_id, b.agent_skin, b.approximate_spotted_by, b.weapon_skin, b.weapon_paint_seed, b.weapon_stickers) == (261, None, None, None, 0, [])


def test_unknown_names_are_refused(replay):
    for bad in (lambda: replay.ticks(["no_such_prop"]), lambda: replay.event("player_death", player=["no_such_prop"]), lambda: replay.grenades(extra=["no_such_prop"])):
        with pytest.raises(ValueError, match="no_such_prop"):
            bad()


@pytest.mark.parametrize("span", [3, 1 << 16])
def test_a_busy_entity_is_filled_by_spans(spark, monkeypatch, span):
    monkeypatch.setattr(rp, "SPAN", span)
    n = 400
    t = {
        "updates": spark.createDataFrame([("d", 1, s, s, PAWN + "m_iHealth", str(s)) for s in range(0, n, 7)], "demo_id string, entity_id int, seq long, tick int, prop string, value string"),
        "lifecycle": spark.createDataFrame([("d", 1, 0, "create", "x"), ("d", 1, 100, "delete", "x"), ("d", 1, 301, "create", "x")], "demo_id string, entity_id int, seq long, kind string, cls string"),
        "ticks": spark.createDataFrame([("d", s // 50, s, s, s) for s in range(0, n, 3)], "demo_id string, segment_id int, seq long, tick int, net_tick long"),
        "players": spark.createDataFrame([("d", 1, 9, 100, "A", 2, 0, None)], "demo_id string, pawn_id int, controller_id int, steamid long, name string, team_num int, from_seq long, to_seq long"),
    }
    got = {r.tick: r.health for r in Replay(t).ticks(["health"]).collect()}
    births = (0, 100, 301)
    for s in range(0, n, 3):
        since = max(b for b in births if b <= s)
        told = [x for x in range(0, n, 7) if since <= x <= s]
        assert got[s] == (told[-1] if told else None), s
