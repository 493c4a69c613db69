import random

from pyspark.sql import functions as F

from tickframe.operators import state

SCHEMA = "demo int, entity int, seq int, prop string, value string"


def fold(rows, keys, props):
    """Sequential state: what each property was last set to, after each row."""
    now, out = {}, {}
    for r in sorted(rows, key=lambda r: r[2]):
        key = tuple(r[k] for k in keys)
        if r[3] in props and r[4] is not None:
            now[key, r[3]] = r[4]
        out[r[2]] = tuple(now.get((key, p)) for p in props)
    return out


def random_log(seed, n=400):
    rng = random.Random(seed)
    return [(rng.randint(0, 1), rng.choice([0, 0, 0, 1, 2]), seq, rng.choice("abc"), rng.choice([None, *"12345"])) for seq in rng.sample(range(10 * n), n)]


def test_carry_forward_equals_a_sequential_fold(spark):
    rows, props = random_log(1), ["a", "b"]
    want = fold(rows, (0, 1), props)
    df = spark.createDataFrame(rows, SCHEMA)
    columns = {p: F.when(F.col("prop") == p, F.col("value")) for p in props}
    for segment in (None, F.floor(F.col("seq") / 100)):
        got = state.carry_forward(df, ["demo", "entity"], "seq", columns, segment).collect()
        assert {r.seq: (r.a, r.b) for r in got} == want


def test_as_of_takes_the_value_at_or_before(spark):
    deltas = spark.createDataFrame([(1, 10, "x", "1"), (1, 20, "x", "2"), (1, 20, "y", "9"), (2, 5, "x", "7")], "entity int, seq int, prop string, value string")
    probes = spark.createDataFrame([(1, 9, "p"), (1, 10, "q"), (1, 25, "r"), (3, 25, "s"), (None, 25, "t")], "entity int, seq int, name string")
    got = {r.name: (r.x, r.y) for r in state.as_of(probes, deltas, ["entity"], "seq", ["x", "y"], {"x": "int"}).collect()}
    assert got == {"p": (None, None), "q": (1, None), "r": (2, "9"), "s": (None, None), "t": (None, None)}


def test_as_of_without_deltas_or_probes(spark):
    none = spark.createDataFrame([], "entity int, seq int, prop string, value string")
    probe = spark.createDataFrame([(1, 1)], "entity int, seq int")
    assert [tuple(r) for r in state.as_of(probe, none, ["entity"], "seq", ["x"]).collect()] == [(1, 1, None)]
    assert state.as_of(probe.limit(0), none, ["entity"], "seq", ["x"]).count() == 0


def test_generations_end_at_the_next_life_or_at_a_delete(spark):
    told = spark.createDataFrame([(7, 1, "create"), (7, 5, "create"), (7, 8, "delete"), (7, 9, "create")], "entity int, seq int, kind string")
    got = sorted(tuple(r) for r in state.generations(told, ["entity"], "seq").collect())
    assert got == [(7, 1, 1, 5), (7, 2, 5, 8), (7, 3, 9, None)]
