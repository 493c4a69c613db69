"""Inventories against a sequential fold, with few and with many items, in one span of positions and over several."""

import random

import pytest

from tickframe.plans import replay as rp
from tickframe.plans.replay import Replay

from test_pieces import shuffled

HELD, LIFE, ITEM = rp._HELD, rp._LIFE, "CAK47.m_iItemDefinitionIndex"
UPDATES = "demo_id string, entity_id int, seq long, tick int, prop string, value string"
PLAYERS = "demo_id string, pawn_id int, controller_id int, steamid long, name string, team_num int, from_seq long, to_seq long"
NAMES = ["inventory_as_ids", "inventory_as_bitmask"]


def folded(log, lives, ticks, pawns):
    steps = sorted([(s, 0, e, None, None) for _, e, s, _, _ in lives] + [(s, 1, e, p, v) for _, e, s, _, p, v in log], key=lambda x: x[:2])
    now, at, out = {}, 0, []
    for t in ticks:
        while at < len(steps) and steps[at][0] <= t:
            _, kind, e, p, v = steps[at]
            if kind:
                now[e, p] = int(v)
            else:
                now = {k: x for k, x in now.items() if k[0] != e}
            at += 1
        for pawn in pawns:
            held = [h & 0x3FFF for k in range(now.get((pawn, HELD), 0)) if (h := now.get((pawn, f"{HELD}[{k}]"))) is not None]
            ids = [i for e in dict.fromkeys(held) if (i := now.get((e, ITEM))) is not None]
            life, size = now.get((pawn, LIFE)), now.get((pawn, HELD))
            out.append((t, 5000 + pawn, [] if life not in (None, 0) else ids if size is not None else None))
    return out


@pytest.mark.parametrize("few", [0, 1 << 19])
@pytest.mark.parametrize("step", [1, 3000])
def test_inventories_equal_a_fold(spark, monkeypatch, few, step):
    monkeypatch.setattr(rp, "FEW_ITEMS", few)
    rng, pawns, items = random.Random(step), range(1, 5), range(50, 58)
    log = [("d", rng.choice(pawns), s, 1, rng.choice([HELD, LIFE, *(f"{HELD}[{k}]" for k in range(4))] + [f"{HELD}[0]", f"{HELD}[1]"]), None) for s in rng.sample(range(100), 80)]
    log = [(d, e, s * step, t, p, str(rng.randint(0, 4) if p == HELD else rng.choice([0, 0, 0, 1]) if p == LIFE else 0x8000 | rng.choice(items))) for d, e, s, t, p, _ in log]
    log += [("d", e, 0, 1, p, v) for e in pawns for p, v in ((HELD, "3"), (LIFE, "0"))] + [("d", e, rng.randrange(100) * step + 1, 1, ITEM, str(rng.randint(1, 40))) for e in items for _ in range(2)]
    log = list({(x[1], x[2], x[4]): x for x in log}.values())
    lives = [("d", e, rng.randrange(100) * step, rng.choice(["create", "delete"]), "CAK47") for e in items]
    ticks = [k * step * 5 + 2 for k in range(20)]
    t = {
        "updates": spark.createDataFrame(log, UPDATES),
        "lifecycle": spark.createDataFrame(lives, "demo_id string, entity_id int, seq long, kind string, cls string"),
        "ticks": spark.createDataFrame([("d", 0, s, s, s) for s in ticks], "demo_id string, segment_id int, seq long, tick int, net_tick long"),
        "players": spark.createDataFrame([("d", e, 10 + e, 5000 + e, "x", 2, 0, None) for e in pawns], PLAYERS),
    }
    got = {(r.tick, r.steamid): (r.inventory_as_ids, r.inventory_as_bitmask) for r in Replay(t).ticks(NAMES).collect()}
    want = folded(log, lives, ticks, pawns)
    bits = lambda ids: ids and sum({1 << i % 64 for i in ids}) or (None if ids is None else 0)
    assert got == {(s, steam): (ids, bits(ids)) for s, steam, ids in want} and any(ids for _, _, ids in want)


def test_few_items_are_asked_in_place(spark):
    log = [("d", e, 1, 1, p, v) for e in range(100, 2100) for p, v in ((HELD, "4"), (LIFE, "0"), *((f"{HELD}[{k}]", str(20 + (e + k) % 10)) for k in range(4)))]
    t = {
        "updates": spark.createDataFrame(log + [("d", e, 1, 1, ITEM, "7") for e in range(20, 30)], UPDATES),
        "ticks": spark.createDataFrame([("d", 0, 2, 2, 2)], "demo_id string, segment_id int, seq long, tick int, net_tick long"),
        "players": spark.createDataFrame([("d", e, e, e, "x", 2, 0, None) for e in range(100, 2100)], PLAYERS),
    }
    got, mb = shuffled(spark, Replay(t).ticks(NAMES))
    assert len(got) == 2000 and {tuple(r[0]) for r in got} == {(7, 7, 7, 7)}
    assert mb < 0.5
