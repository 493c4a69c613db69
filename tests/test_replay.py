"""The query surface over a small hand-written replay."""

import pytest
from pyspark.sql import functions as F

from tickframe.functions.catalog import Catalog
from tickframe.plans.replay import Replay, WantedPropState

PAWN, CTRL = "CCSPlayerPawn.", "CCSPlayerController."
CELL = PAWN + "CBodyComponentBaseAnimGraph.m_cell{}"
VEC = PAWN + "CBodyComponentBaseAnimGraph.m_vec{}"
WEAPON = PAWN + "CCSPlayer_WeaponServices.m_hActiveWeapon"


@pytest.fixture(scope="module")
def replay(spark):
    updates = [
        (1, 2, PAWN + "m_iHealth", "100"), (1, 20, PAWN + "m_iHealth", "40"), (2, 2, PAWN + "m_iHealth", "100"),
        (1, 2, PAWN + "m_lifeState", "0"), (2, 2, PAWN + "m_lifeState", "1"),
        *((1, s, CELL.format(a), "32") for s in (2,) for a in "XYZ"), *((1, s, VEC.format(a), str(v)) for s, v in ((2, 0.0), (12, 1.0), (22, 3.0)) for a in "XYZ"),
        (1, 2, WEAPON, str(0x10000 | 50)), (50, 2, "CAK47.m_iClip1", "30"), (50, 15, "CAK47.m_iClip1", "29"), (50, 2, "CAK47.m_iItemDefinitionIndex", "7"),
        (11, 2, CTRL + "m_iScore", "5"), (80, 2, "CCSTeam.m_iTeamNum", "2"), (81, 2, "CCSTeam.m_iTeamNum", "3"), (80, 2, "CCSTeam.m_iScore", "8"), (81, 18, "CCSTeam.m_iScore", "9"),
        (90, 2, "CCSGameRulesProxy.CCSGameRules.m_totalRoundsPlayed", "0"), (90, 16, "CCSGameRulesProxy.CCSGameRules.m_totalRoundsPlayed", "1"),
        (60, 12, "CSmokeGrenadeProjectile.m_hOwnerEntity", str(0x8000 | 1)), (60, 12, "CSmokeGrenadeProjectile.CBodyComponentBaseAnimGraph.m_cellX", "33"), (60, 12, "CSmokeGrenadeProjectile.CBodyComponentBaseAnimGraph.m_vecX", "1.5"),
    ]
    t = {
        "updates": spark.createDataFrame([("d", e, s, 1 + (s > 10) + (s > 19), p, v) for e, s, p, v in updates], "demo_id string, entity_id int, seq long, tick int, prop string, value string"),
        "lifecycle": spark.createDataFrame([("d", 1, 1, "create", "CCSPlayerPawn"), ("d", 60, 11, "create", "CSmokeGrenadeProjectile"), ("d", 60, 21, "delete", "CSmokeGrenadeProjectile"), ("d", 2, 25, "delete", "CCSPlayerPawn")], "demo_id string, entity_id int, seq long, kind string, cls string"),
        "ticks": spark.createDataFrame([("d", 0, 10, 1, 64), ("d", 0, 19, 2, 128), ("d", 1, 30, 3, 192)], "demo_id string, segment_id int, seq long, tick int, net_tick long"),
        "players": spark.createDataFrame([("d", 1, 11, 100, "A", 2, 0, None), ("d", 2, 12, 200, "B", 3, 0, None)], "demo_id string, pawn_id int, controller_id int, steamid long, name string, team_num int, from_seq long, to_seq long"),
        "userinfo": spark.createDataFrame([("d", 5, 100, "A"), ("d", 6, 200, "B")], "demo_id string, userid int, steamid long, name string"),
        "events": spark.createDataFrame(
            [("d", 0, 17, 2, "player_death", {"userid": "6", "attacker": "261", "hitgroup": "1"}), ("d", 0, 24, 3, "player_death", {"userid": "99", "attacker": "5", "hitgroup": "77"}), ("d", 0, 9, 1, "bomb_planted", {}), ("d", 0, 9, 1, "player_connect", {})],
            "demo_id string, segment_id int, seq long, tick int, event_name string, fields map<string,string>",
        ),
        "items": spark.createDataFrame([(7, "AK-47")], "def_index int, name string"),
    }
    return Replay(t)


def rows(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


def test_ticks_know_the_latest_values(replay):
    got = replay.ticks(["health", "is_alive", "X", "ammo", "weapon_name", "score", "team_rounds_total", "total_rounds_played", "game_time"])
    assert rows(got.where("steamid = 100"), "tick", "health", "is_alive", "X", "ammo", "weapon_name", "score", "total_rounds_played", "game_time") == [
        (1, 100, True, 0.0, 30, "AK-47", 5, 0, 1.0),
        (2, 100, True, 1.0, 29, "AK-47", 5, 1, 2.0),
        (3, 40, True, 3.0, 29, "AK-47", 5, 1, 3.0),
    ]
    assert [r.health for r in got.where("steamid = 200").orderBy("tick").collect()] == [100, 100, None]  # deleted before tick 3
    assert [r.team_rounds_total for r in got.where("steamid = 200").orderBy("tick").collect()] == [None, 9, 9]


def test_tick_and_player_filters_and_states(replay):
    assert rows(replay.ticks(["health"], ticks=[2, 3], players=[100]), "tick", "health") == [(2, 100), (3, 40)]
    assert rows(replay.ticks([], prop_states=[WantedPropState("is_alive", True)]), "tick", "name") == [(1, "A"), (2, "A"), (3, "A")]
    assert rows(replay.ticks([], prop_states=[WantedPropState("is_alive", False)]), "tick", "name") == []  # A comes first and misses


def test_velocity(replay):
    got = replay.ticks(["velocity_X", "velocity"], players=[100])
    assert rows(got, "tick", "velocity_X") == [(1, None), (2, None), (3, 64.0)]
    assert rows(replay.ticks(["velocity_X"], players=[100], segment_parity=True), "tick", "velocity_X") == [(1, None), (2, None), (3, None)]


def test_events_know_their_players(replay):
    got = replay.event("player_death", player=["health", "X"], other=["team_rounds_total", "total_rounds_played", "game_time"])
    assert got.columns == sorted(got.columns)
    assert rows(got, "tick", "user_name", "user_steamid", "user_health", "attacker_name", "attacker_health", "attacker_X", "hitgroup", "t_team_rounds_total", "ct_team_rounds_total", "total_rounds_played", "game_time") == [
        (2, "B", "200", 100, "A", 100, 1.0, "head", 8, None, 1, 2.0),
        (3, None, None, None, "A", 40, 3.0, "77", 8, 9, 1, 3.0),
    ]
    assert "userid" not in got.columns


def test_event_lists(replay):
    assert [r[0] for r in replay.event_names().collect()] == ["bomb_planted", "player_death"]
    assert {k: v.count() for k, v in replay.events(["all"]).items()} == {"bomb_planted": 1, "player_death": 2, "player_first_connect": 2}
    assert replay.event("no_such").count() == 0
    for bad in (lambda: replay.events("player_death"), lambda: replay.event(["x"]), lambda: replay.event("x", player="health"), lambda: replay.ticks("health"), lambda: replay.events([1])):
        with pytest.raises(TypeError):
            bad()


def test_grenades_live_between_create_and_delete(replay):
    got = replay.grenades(extra=["m_hOwnerEntity"])
    assert rows(got, "tick", "grenade_type", "grenade_entity_id", "x", "y", "name") == [(2, "CSmokeGrenadeProjectile", 60, 513.5, None, "A")]
    assert replay.grenades(grenades=False).count() == 1


def test_fields_and_players(replay):
    assert "Weapon.m_iClip1" in [r[0] for r in replay.updated_fields().collect()]
    assert "Grenade.m_hOwnerEntity" in [r[0] for r in replay.updated_fields().collect()]
    assert rows(replay.player_info(), "steamid", "team_number") == [(100, 2), (200, 3)]
    with pytest.raises(KeyError):
        replay.voice()


def test_files_without_entities(spark, tmp_path):
    from test_sources import replay as file

    (tmp_path / "a.dem").write_bytes(file())
    r = Replay.from_files(spark, str(tmp_path))
    names = [x[0] for x in r.event_names().collect()]
    assert "player_death" in names
    assert {"chat_message", "server_message", "server_cvar"} <= {*names}
    assert r.event("server_message").count() > 0
    assert {"user_name", "user_steamid"} <= set(r.event("player_death").columns)
    assert [x.steamid for x in r.voice().collect()] == [9]
    assert r.skins().count() == 1
    assert r.header().select(F.col("header")["map_name"]).first()[0] == "de_test"
    assert Catalog({"mine": "X.m_iY"}).resolve("mine") == "X.m_iY"
