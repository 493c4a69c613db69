"""Points in pieces, and ticks that meet players without a shuffle of all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from tickframe.operators import ranges, state
from tickframe.plans.replay import Replay, WantedPropState

TICKS, PLAYERS = 400, 400


@pytest.mark.parametrize("size", [1, 3, 1000])
def test_pieces_meet_their_points(spark, size):
    rng = random.Random(size)
    points = [(d, s) for d in "ab" for s in sorted(rng.sample(range(50, 400), 60))] + [("b", 60), ("b", 60)]
    pieces = [(rng.choice("abc"), rng.randint(0, 60), a, rng.choice([None, a, a + rng.randint(0, 9), a + rng.randint(0, 400)])) for a in (rng.randint(0, 420) for _ in range(120))]
    p, q = spark.createDataFrame(points, "k string, s long"), spark.createDataFrame(pieces, "k string, r long, __from long, __to long")
    widths = ranges.bucket_widths(p.groupBy("k").agg(F.min("s").alias("__low"), F.max("s").alias("__high"), F.count("s").alias("__points")), size)
    over = lambda k, s: [r for d, r, a, z in pieces if d == k and a <= s and (z is None or s < z)]
    got = ranges.points_in_pieces(p, q, ["k"], "s", widths).select("k", "s", "r").collect()
    assert sorted(map(tuple, got)) == sorted((k, s, r) for k, s in points for r in over(k, s))
    least = ranges.least_over(p, q.where("r % 3 = 0"), ["k"], "s", "r", widths)
    first = lambda k, s: min((r for r in over(k, s) if r % 3 == 0), default=None)
    assert sorted(map(str, least.select("k", "s", "__first").collect())) == sorted(f"Row(k={k!r}, s={s}, __first={first(k, s)})" for k, s in points)
    below = ranges.points_in_pieces(least, q, ["k"], "s", widths, "r").select("k", "s", "r").collect()
    assert sorted(map(tuple, below)) == sorted((k, s, r) for k, s in points for r in over(k, s) if first(k, s) is None or r < first(k, s))


def test_lists_of_points_and_shards_of_pieces(spark, monkeypatch):
    """Lists shorter than a bucket, with points of one place in different lists, and pieces in three shards."""
    monkeypatch.setattr(ranges, "CELL", 4)
    rng = random.Random(5)
    points = [(d, rng.randint(50, 90), k) for d in "ab" for k in range(60)]
    pieces = [(rng.choice("abc"), rng.randint(0, 60), a, rng.choice([None, a, a + 1, a + rng.randint(0, 40)])) for a in (rng.randint(30, 95) for _ in range(150))]
    p, q = spark.createDataFrame(points, "k string, s long, n int"), spark.createDataFrame(pieces, "k string, r long, __from long, __to long")
    widths = ranges.bucket_widths(p.groupBy("k").agg(F.min("s").alias("__low"), F.max("s").alias("__high"), F.count("s").alias("__points")), 20, 3)
    got = ranges.points_in_pieces(p, q, ["k"], "s", widths).select("k", "s", "n", "r").collect()
    assert sorted(map(tuple, got)) == sorted((k, s, n, r) for k, s, n in points for d, r, a, z in pieces if d == k and a <= s and (z is None or s < z))


def test_next_rows_are_found_across_segments(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 5), ("a", 93), ("b", 7)], "k string, s long")
    assert sorted(map(tuple, state.until_next(rows, "k", "s", "n", 10).collect()), key=str) == [("a", 1, 5), ("a", 5, 93), ("a", 93, None), ("b", 7, None)]


@pytest.fixture(scope="module")
def replay(spark):
    """Players' health goes between 0 and 100 now and then; some leave."""
    rng, health = random.Random(7), "CCSPlayerPawn.m_iHealth"
    log = [("d", rng.randrange(PLAYERS), rng.randrange(10 * TICKS), 1, health, rng.choice(["0", "0", "0", "100", None])) for _ in range(2000)]
    log = list({x[1:3]: x for x in log}.values())
    players = [("d", k, 1000 + k, 5000 + k, f"p{k}", 2, k, None if k % 3 else 20 * k + 9) for k in range(PLAYERS)]
    t = {
        "updates": spark.createDataFrame(log, "demo_id string, entity_id int, seq long, tick int, prop string, value string"),
        "ticks": spark.createDataFrame([("d", 0, 10 * k + 5, k, k) for k in range(TICKS)], "demo_id string, segment_id int, seq long, tick int, net_tick long"),
        "players": spark.createDataFrame(players, "demo_id string, pawn_id int, controller_id int, steamid long, name string, team_num int, from_seq long, to_seq long"),
    }
    want, now, at = [], {}, 0
    log.sort(key=lambda x: x[2])
    for k in range(TICKS):
        while at < len(log) and log[at][2] <= 10 * k + 5:
            now[log[at][1]] = log[at][5] and int(log[at][5])
            at += 1
        want += [(k, p[3], now.get(p[1])) for p in players if p[6] <= 10 * k + 5 and (p[7] is None or 10 * k + 5 < p[7])]
    return Replay(t), want


def shuffled(spark, df):
    """The rows, and MB that making them shuffled."""
    sc = spark.sparkContext._jsc.sc()

    def written():
        sc.listenerBus().waitUntilEmpty(30_000)
        return sc.statusStore().executorList(True).head().totalShuffleWrite() / 1e6

    before = written()
    return [tuple(r) for r in df.collect()], written() - before


def test_ticks_do_not_shuffle_all_pairs(spark, replay):
    got, mb = shuffled(spark, replay[0].ticks(["health"]).select("tick", "steamid", "health"))
    assert sorted(map(str, got)) == sorted(map(str, replay[1]))
    assert mb < 1


def test_states_do_not_shuffle_all_pairs(spark, replay):
    want, missed = [], set()
    for k, steamid, health in replay[1]:  # by tick, then by pawn
        missed |= {k} if health != 0 else set()
        want += [] if k in missed else [(k, steamid, health)]
    got, mb = shuffled(spark, replay[0].ticks(["health"], prop_states=[WantedPropState("health", 0)]).select("tick", "steamid", "health"))
    assert sorted(map(str, got)) == sorted(map(str, want)) and want
    assert mb < 1


def rows_shuffled(spark):
    sc, jvm = spark.sparkContext._jsc.sc(), spark.sparkContext._jvm
    sc.listenerBus().waitUntilEmpty(30_000)
    stages = sc.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return sum(stages.apply(k).shuffleWriteRecords() for k in range(stages.size()))


def test_players_that_stay_are_not_shuffled_for_each_few_ticks(spark):
    """2000 players whose health never changes stand over 8000 ticks in one row, not in one for each 256."""
    made = lambda n, *columns: spark.range(n).selectExpr("'d' demo_id", *columns)
    players = made(2000, "int(id) pawn_id", "int(1000 + id) controller_id", "5000 + id steamid", "concat('p', id) name", "2 team_num", "id from_seq", "cast(null as long) to_seq")
    log = made(2000, "int(id) entity_id", "id seq", "1 tick", "'CCSPlayerPawn.m_iHealth' prop", "string(id % 100) value")
    ticks = made(8000, "0 segment_id", "id seq", "int(id) tick", "id net_tick")
    rows = Replay({"updates": log, "ticks": ticks, "players": players}).ticks(["health"])
    before = rows_shuffled(spark)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # tables of this size would be broadcast
    try:
        got = [tuple(r) for r in rows.agg(F.count("*"), F.sum("health"), F.sum("tick")).collect()]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == [(sum(8000 - k for k in range(2000)), sum((8000 - k) * (k % 100) for k in range(2000)), sum(t * min(t + 1, 2000) for t in range(8000)))]
    assert rows_shuffled(spark) - before < 60_000
