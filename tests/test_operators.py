import pytest
from pyspark.sql import functions as F

from tickframe.functions import derived, labels
from tickframe.functions.catalog import Catalog, generalised
from tickframe.operators import events, filters, handles, ranges, registry


def test_prop_states_is_a_prefix_not_a_where(spark):
    rows = spark.createDataFrame([(1, 1, True), (1, 2, False), (1, 3, True), (2, 1, None), (2, 2, True), (3, 1, True)], "tick int, pawn int, alive boolean")
    got = filters.prop_states(rows, {"alive": True}, ["tick"], ["pawn"])
    assert sorted((r.tick, r.pawn) for r in got.collect()) == [(1, 1), (3, 1)]


def test_tick_lists_of_any_length(spark):
    rows = spark.range(3000).withColumnRenamed("id", "tick")
    assert filters.at_ticks(rows, None).count() == filters.at_ticks(rows, []).count() == 3000
    assert filters.at_ticks(rows, [1, 2, 99999]).count() == 2
    assert filters.at_ticks(rows, list(range(1500))).count() == 1500
    assert filters.at_ticks(rows, spark.createDataFrame([(5,), (5,)], "t long")).count() == 1


def test_event_names_and_replaced_events(spark):
    rows = spark.createDataFrame([("a",), ("b",), ("server_cvar",)], "event_name string")
    assert filters.events_named(rows, ["b", "all"]).count() == 3
    assert filters.events_named(rows, []).count() == 0
    assert filters.without_replaced(rows).count() == 2


def test_was_sold_needs_both_a_later_sale_and_a_later_purchase(spark):
    trades = spark.createDataFrame([(1, 1, "buy"), (1, 2, "sell"), (1, 3, "buy"), (1, 4, "sell"), (2, 1, "buy"), (2, 2, "buy")], "slot int, tick int, kind string")
    got = events.was_sold(trades, ["slot"], "tick", F.col("kind") == "buy", F.col("kind") == "sell")
    assert sorted((r.slot, r.tick, r.was_sold) for r in got.collect()) == [(1, 1, True), (1, 3, False), (2, 1, False), (2, 2, False)]


def test_round_events(spark):
    rules = spark.createDataFrame([(1, 0, 0, 0), (2, 1, 9, 0), (3, 2, 8, 1), (4, 2, 99, 1), (5, 3, 99, 2)], "seq int, round_end_count int, reason int, total_rounds_played int").withColumn("demo", F.lit(1))
    ends = events.round_ends(rules, ["demo"], "seq").orderBy("seq").collect()
    assert [(r.round, r.reason, r.winner) for r in ends] == [(0, "ct_killed", "T"), (1, "t_killed", "CT"), (2, "99", "99")]
    starts = events.round_starts(rules.withColumnRenamed("round_end_count", "round_start_count"), ["demo"], "seq").orderBy("seq", "sub").collect()
    assert [(r.seq, r.event_name, r.round) for r in starts] == [(2, "round_start", 1), (3, "round_officially_ended", 2), (3, "round_start", 2), (5, "round_officially_ended", 3), (5, "round_start", 3)]


def test_user_ids_compare_their_low_byte_first(spark):
    info = spark.createDataFrame([(2, "low", 20), (258, "full", 30), (300, "far", 40)], "userid int, name string, steamid long")
    rows = spark.createDataFrame([(258,), (300,), (7,)], "userid int")
    got = {r.userid: (r.user_name, r.user_steamid) for r in handles.user_of(rows, info, F.col("userid"), "user").collect()}
    assert got == {258: ("low", "20"), 300: ("far", "40"), 7: (None, None)}


def test_inventory_keeps_first_slots_and_wraps_shifts(spark):
    slots = spark.createDataFrame([("p", 0, 42), ("p", 1, 7), ("p", 2, 42), ("p", 3, 65)], "owner string, slot int, item int")
    r = handles.inventory(slots, ["owner"], "item", "slot").first()
    assert (r["items"], r["bitmask"]) == ([42, 7, 65], 1 << 42 | 1 << 7 | 1 << 1)


def test_team_columns(spark):
    teams = spark.createDataFrame([(1, 2, "a"), (1, 3, "b"), (2, 3, "c")], "tick int, team_num int, score string")
    got = {r.tick: (r.t_score, r.ct_score) for r in handles.team_columns(teams, ["tick"], ["score"]).collect()}
    assert got == {1: ("a", "b"), 2: (None, "c")}


def test_window_before_holds_both_ends(spark):
    rows = spark.createDataFrame([(1, t) for t in (0, 1, 100, 400, 401)], "player int, tick int")
    hurts = spark.createDataFrame([(1, 400), (None, 400)], "player int, tick int")
    got = ranges.window_before(rows, hurts, ["player"], "tick", 300)
    assert sorted(r.tick for r in got.collect()) == [100, 400]


def test_derived_values(spark):
    r = spark.range(1).select(
        derived.cell_coord(F.lit(34), F.lit(5.5)).alias("x"),
        derived.cell_coord(F.lit(None).cast("int"), F.lit(5.5)).alias("none"),
        derived.is_alive(F.lit(None).cast("int")).alias("alive"),
        derived.is_airborne(F.lit(0xFFFFFF)).alias("air"),
        derived.integral_id(F.lit(12.5)).alias("half"),
        derived.integral_id(F.lit(12.0)).alias("whole"),
        derived.paint_seed(F.lit(None).cast("float")).alias("seed"),
        derived.owner_xuid(F.lit(0xFFFFFFFF), F.lit(0xFFFFFFFF)).alias("xuid"),
        derived.button_names(F.lit((1 << 35) | 1).cast("bigint")).alias("buttons"),
        derived.spotted_by(F.lit(0b101)).alias("spotted"),
        derived.float_bits(F.lit(1.0).cast("float")).alias("bits"),
        labels.label(F.lit(9), labels.HIT_GROUP).alias("group"),
    ).first()
    assert r.asDict() == {"x": 1029.5, "none": None, "alive": False, "air": True, "half": None, "whole": 12, "seed": 0, "xuid": "18446744073709551615", "buttons": ["FIRE", "INSPECT"], "spotted": [1, 3], "bits": 0x3F800000, "group": "9"}


def test_velocity_needs_two_rows_before(spark):
    rows = spark.createDataFrame([(1, 0, 0.0), (1, 1, 1.0), (1, 2, 3.0), (1, 3, 3.0)], "p int, seq int, x float")
    got = rows.select("seq", derived.velocity_axis(F.col("x"), ["p"], ["seq"]).alias("v")).orderBy("seq").collect()
    assert [r.v for r in got] == [None, None, 64.0, 128.0]


@pytest.mark.parametrize(("name", "prop"), [("health", "CCSPlayerPawn.m_iHealth"), ("Weapon.ammo", "m_iClip1"), ("Grenade.m_x", "m_x"), ("no_such", "no_such")])
def test_names_resolve(name, prop):
    assert Catalog().resolve(name) == prop


def test_kinds_types_and_classes():
    c = Catalog({"mine": "CCSTeam.m_iX"})
    assert (c.resolve("mine"), c.kind("CCSTeam.m_iX"), c.spark_type("CCSTeam.m_iX")) == ("CCSTeam.m_iX", "team", "int")
    assert [c.spark_type(f"C.{p}") for p in ("m_bScoped", "m_flTime", "m_szName", "m_hOwner", "m_unId", "m_steamID")] == ["boolean", "float", "string", "bigint", "bigint", "bigint"]
    assert (generalised("CAK47.m_iClip1"), generalised("CCSPlayerPawn.m_iHealth")) == ("m_iClip1", "CCSPlayerPawn.m_iHealth")


def test_registry_follows_controllers(spark):
    told = [
        (9, 1, "m_steamID", "76561198000000001"), (9, 1, "m_iszPlayerName", "A"), (9, 1, "m_iTeamNum", "1"), (9, 1, "m_hPlayerPawn", str(0x8000 | 33)),
        (9, 4, "m_iTeamNum", "2"), (9, 6, "m_iTeamNum", "2"), (9, 8, "m_hPlayerPawn", str(0x10000 | 40)), (9, 9, "m_hPlayerPawn", str(0x7FF)), (9, 10, "m_hPlayerPawn", "40"),
        (11, 2, "m_steamID", "0"), (11, 2, "m_iTeamNum", "3"), (11, 2, "m_hPlayerPawn", "50"), (12, 2, "m_steamID", "5"),
    ]
    df = spark.createDataFrame([("d", e, s, f"CCSPlayerController.{p}", v) for e, s, p, v in told], "demo_id string, entity_id int, seq long, prop string, value string")
    got = registry.player_registry(df).orderBy("from_seq").collect()
    assert [(r.pawn_id, r.controller_id, r.name, r.team_num, r.from_seq, r.to_seq) for r in got] == [(33, 9, "A", 2, 4, 8), (40, 9, "A", 2, 8, None)]
