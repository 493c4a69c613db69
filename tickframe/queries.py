"""The driver's queries over the replay operators and their SQL.

The test tables stand in for replay relations: ``events`` is a player's change and event log
(``event_type`` names the property or event, ``event_id`` orders it), ``lineitem``/``part`` are
entities and item definitions, ``customer`` the player registry.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import derived, labels
from .operators import events as ev
from .operators import filters, handles, ranges, state
from .plans import recipes

SEGMENT = 4096
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def query(sql: str | None):
    """Registers a query under its function's name with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _k() -> Column:
    return F.get_json_object("props", "$.k").cast("bigint")


_KS = "CAST(json_extract(props, '$.k') AS BIGINT)"


# State at an event ------------------------------------------------------------------------------------------


@query(
    """SELECT * FROM (SELECT event_id, user_id, event_type,
        last_value(CASE WHEN event_type = 'view' THEN value END IGNORE NULLS) OVER w AS last_view,
        last_value(CASE WHEN event_type = 'click' THEN value END IGNORE NULLS) OVER w AS last_click
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)) WHERE event_type = 'purchase'"""
)
def state_at_event(spark, d):
    """For each purchase the user's latest view and click."""
    rows = _t(spark, d, "events").select("event_id", "user_id", "event_type", "value")
    props = {f"last_{p}": F.when(F.col("event_type") == p, F.col("value")) for p in ("view", "click")}
    filled = state.carry_forward(rows, ["user_id"], "event_id", props, F.floor(F.col("event_id") / SEGMENT))
    return filled.where("event_type = 'purchase'").select("event_id", "user_id", "event_type", *props)


@query(
    """SELECT p.event_id, p.user_id, (SELECT arg_max(value, event_id) FROM events e WHERE e.user_id = p.user_id AND e.event_type = 'view' AND e.event_id <= p.event_id) AS view,
        (SELECT arg_max(value, event_id) FROM events e WHERE e.user_id = p.user_id AND e.event_type = 'error' AND e.event_id <= p.event_id) AS error
    FROM events p WHERE p.event_type = 'signup'"""
)
def as_of_join(spark, d):
    """As-of join of sign-ups with the property log."""
    rows = _t(spark, d, "events")
    deltas = rows.select("user_id", "event_id", F.col("event_type").alias("prop"), F.col("value").cast("string").alias("value"))
    probes = rows.where("event_type = 'signup'").select("user_id", "event_id")
    return state.as_of(probes, deltas, ["user_id"], "event_id", ["view", "error"], {"view": "double", "error": "double"})


@query(
    """WITH g AS (SELECT *, sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS generation FROM events)
    SELECT event_id, user_id, generation::BIGINT AS generation,
        last_value(CASE WHEN event_type = 'view' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id, generation ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS last_view
    FROM g WHERE generation > 0"""
)
def generation_reset(spark, d):
    """A slot's new life starts from nothing: the fill stops at each sign-up."""
    rows = _t(spark, d, "events").select("event_id", "user_id", "event_type", "value")
    w = Window.partitionBy("user_id").orderBy("event_id")
    rows = rows.withColumn("generation", F.sum((F.col("event_type") == "signup").cast("bigint")).over(w)).where("generation > 0")
    return state.carry_forward(rows, ["user_id", "generation"], "event_id", {"last_view": F.expr("CASE WHEN event_type = 'view' THEN value END")}).select("event_id", "user_id", "generation", "last_view")


# Filters ----------------------------------------------------------------------------------------------------


@query(
    """SELECT event_id, user_id, value FROM (SELECT *, sum(CASE WHEN value > 20 THEN 0 ELSE 1 END) OVER (PARTITION BY event_id // 50 ORDER BY user_id, event_id ROWS UNBOUNDED PRECEDING) AS bad FROM events) WHERE bad = 0"""
)
def prop_state_prefix(spark, d):
    rows = _t(spark, d, "events").select("event_id", "user_id", "value").withColumn("bucket", F.floor(F.col("event_id") / 50))
    return filters.prop_states(rows, F.col("value") > 20, ["bucket"], ["user_id", "event_id"]).select("event_id", "user_id", "value")


@query("SELECT event_id, user_id, event_type FROM events WHERE event_id IN (SELECT event_id FROM events WHERE event_type = 'signup' AND event_id % 7 = 0)")
def tick_filter(spark, d):
    rows = _t(spark, d, "events").select("event_id", "user_id", "event_type")
    wanted = _t(spark, d, "events").where("event_type = 'signup' and event_id % 7 = 0").select("event_id")
    return filters.at_ticks(rows, wanted, "event_id")


@query("SELECT event_id, user_id, value FROM events WHERE user_id IN (3, 8, 46)")
def player_filter(spark, d):
    return filters.of_players(_t(spark, d, "events").select("event_id", "user_id", "value"), [3, 8, 46], "user_id")


@query("SELECT event_id, user_id, value FROM events WHERE event_type = 'purchase'")
def parse_event_one(spark, d):
    return filters.events_named(_t(spark, d, "events"), ["purchase"], "event_type").select("event_id", "user_id", "value")


@query("SELECT event_type, event_id, user_id FROM events WHERE event_type IN ('purchase', 'error')")
def parse_events_many(spark, d):
    return filters.events_named(_t(spark, d, "events"), ["purchase", "error"], "event_type").select("event_type", "event_id", "user_id")


@query("SELECT event_type, count(*) AS n FROM events WHERE event_type NOT IN ('error') GROUP BY event_type")
def parse_events_all(spark, d):
    rows = filters.events_named(_t(spark, d, "events"), ["all"], "event_type")
    return filters.without_replaced(rows, "event_type", ("error",)).groupBy("event_type").agg(F.count("*").alias("n"))


@query("SELECT DISTINCT event_type FROM events")
def list_events(spark, d):
    return ev.distinct_sorted(_t(spark, d, "events"), "event_type")


@query("SELECT DISTINCT regexp_replace(p_type, '^[^ ]+ ', '') AS field FROM part UNION SELECT DISTINCT regexp_replace(p_brand, '#.*$', '') FROM part")
def updated_fields(spark, d):
    part = _t(spark, d, "part")
    both = part.select(F.regexp_replace("p_type", "^[^ ]+ ", "").alias("field")).union(part.select(F.regexp_replace("p_brand", "#.*$", "")))
    return ev.distinct_sorted(both, "field")


@query("SELECT vec_id AS grenade_id, label FROM embeddings WHERE label IN (SELECT label FROM embeddings GROUP BY label HAVING count(*) > 5)")
def semi_join_counts(spark, d):
    rows = _t(spark, d, "embeddings")
    often = rows.groupBy("label").agg(F.count("*").alias("n")).where("n > 5").select("label")
    return filters.at_ticks(rows.select(F.col("vec_id").alias("grenade_id"), "label"), often, "label")


@query("SELECT c_custkey, c_name FROM customer WHERE contains(replace(c_name, '1', 'Projectile'), 'Projectile')")
def grenade_class_filter(spark, d):
    """Only classes that contain Projectile (names with a 1 here)."""
    named = _t(spark, d, "customer").select("c_custkey", "c_name", F.replace("c_name", F.lit("1"), F.lit("Projectile")).alias("grenade_type"))
    return filters.grenade_rows(named, grenades=False).drop("grenade_type")


# Derived values ---------------------------------------------------------------------------------------------


@query("SELECT event_id, (lag(value, 1) OVER w - lag(value, 2) OVER w) * 64 AS velocity FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)")
def velocity_axis(spark, d):
    return _t(spark, d, "events").select("event_id", derived.velocity_axis(F.col("value"), ["user_id"], ["event_id"]).alias("velocity"))


@query(
    f"""SELECT event_id, round(sqrt(vx * vx + vy * vy), 4) AS velocity FROM (SELECT event_id, (lag(value, 1) OVER w - lag(value, 2) OVER w) * 64 AS vx, (lag({_KS}, 1) OVER w - lag({_KS}, 2) OVER w) * 64 AS vy
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))"""
)
def velocity_norm(spark, d):
    rows = _t(spark, d, "events").withColumn("k", _k())
    axes = [derived.velocity_axis(F.col(c), ["user_id"], ["event_id"]) for c in ("value", "k")]
    return rows.select("event_id", *(a.alias(n) for a, n in zip(axes, ("vx", "vy"), strict=True))).select("event_id", F.round(derived.velocity(F.col("vx"), F.col("vy")), 4).alias("velocity"))


@query(f"SELECT event_id, ({_KS} & 1) <> 0 AS fire, ({_KS} & 8) <> 0 AS forward, ({_KS} & 32) <> 0 AS use FROM events")
def button_flags(spark, d):
    return _t(spark, d, "events").select("event_id", *(derived.button(_k(), b).alias(b.lower()) for b in ("FIRE", "FORWARD", "USE")))


@query(
    f"""SELECT event_id, concat_ws(',', CASE WHEN k & 1 <> 0 THEN 'FIRE' END, CASE WHEN k & 8 <> 0 THEN 'FORWARD' END, CASE WHEN k & 16 <> 0 THEN 'BACK' END, CASE WHEN k & 32 <> 0 THEN 'USE' END) AS pressed
    FROM (SELECT event_id, {_KS} AS k FROM events)"""
)
def button_names(spark, d):
    return _t(spark, d, "events").select("event_id", F.array_join(derived.button_names(_k()), ",").alias("pressed"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, (l_linenumber * 512 - 16384 + l_quantity)::DOUBLE AS x FROM lineitem")
def cell_coord(spark, d):
    row = _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    return row.select("l_orderkey", "l_linenumber", "l_partkey", derived.cell_coord(F.col("l_linenumber"), F.col("l_quantity")).cast("double").alias("x"))


@query("SELECT vec_id, embedding[1]::DOUBLE AS pitch, embedding[2]::DOUBLE AS yaw FROM embeddings")
def pitch_yaw(spark, d):
    e = F.col("embedding")
    return _t(spark, d, "embeddings").select("vec_id", derived.pitch(e).cast("double").alias("pitch"), derived.yaw(e).cast("double").alias("yaw"))


@query("SELECT event_id, coalesce(user_id = 0, false) AS alive, coalesce(value > 400, false) AS airborne FROM events")
def alive_flag(spark, d):
    rows = _t(spark, d, "events")
    ground = F.when(F.col("value") > 400, F.lit(labels.NO_GROUND)).otherwise(F.when(F.col("value") > 5, F.lit(1)))
    return rows.select("event_id", derived.is_alive(F.nullif(F.col("user_id"), F.lit(7))).alias("alive"), derived.is_airborne(ground).alias("airborne"))


@query("SELECT event_id, CASE WHEN value * 4 = floor(value * 4) THEN (value * 4)::BIGINT END AS skin_id FROM events")
def skin_id_integral(spark, d):
    return _t(spark, d, "events").select("event_id", derived.integral_id(F.col("value") * 4).alias("skin_id"))


@query("SELECT event_id, ((event_id + 3)::HUGEINT * 4294967296 + user_id)::VARCHAR AS owner FROM events")
def xuid_concat(spark, d):
    return _t(spark, d, "events").select("event_id", derived.owner_xuid(F.col("event_id") + 3, F.col("user_id")).alias("owner"))


@query(f"SELECT event_id, array_to_string(list_filter(range(1, 17), lambda i: ({_KS} >> (i - 1)::BIGINT) & 1 = 1), ',') AS spotted_by FROM events")
def spotted_mask(spark, d):
    return _t(spark, d, "events").select("event_id", F.array_join(derived.spotted_by(_k()).cast("array<string>"), ",").alias("spotted_by"))


@query(
    """SELECT vec_id, i::INT AS slot, embedding[i + 1]::DOUBLE AS id, greatest(embedding[i + 2], 0)::DOUBLE AS wear, embedding[i + 3]::DOUBLE AS x, embedding[i + 4]::DOUBLE AS y
    FROM embeddings, (VALUES (4), (8), (12), (16), (20), (24)) AS s(i)"""
)
def stickers(spark, d):
    rows = _t(spark, d, "embeddings").select("vec_id", F.posexplode(derived.sticker_slots(F.col("embedding"))).alias("n", "s"))
    return rows.select("vec_id", (4 * (F.col("n") + 1)).alias("slot"), *(F.col(f"s.{c}").cast("double").alias(c) for c in ("id", "wear", "x", "y")))


@query("SELECT event_id, (event_id / 64)::FLOAT::DOUBLE AS game_time FROM events")
def game_time(spark, d):
    return _t(spark, d, "events").select("event_id", derived.game_time(F.col("event_id")).cast("double").alias("game_time"))


_HIT = " ".join(f"WHEN {k} THEN '{v}'" for k, v in labels.HIT_GROUP.items())
_REASON = " ".join(f"WHEN {k} THEN '{v}'" for k, v in labels.ROUND_WIN_REASON.items())
_COLOR = " ".join(f"WHEN {k} THEN '{v}'" for k, v in labels.PLAYER_COLOR.items())


@query(f"SELECT event_id, CASE k {_HIT} ELSE k::VARCHAR END AS hitgroup, CASE k {_REASON} ELSE k::VARCHAR END AS reason, CASE k {_COLOR} ELSE k::VARCHAR END AS color FROM (SELECT event_id, {_KS} AS k FROM events)")
def label_lookup(spark, d):
    rows = _t(spark, d, "events").select("event_id", _k().alias("hitgroup"), labels.label(_k(), labels.ROUND_WIN_REASON).alias("reason"), derived.player_color(_k()).alias("color"))
    return ev.label_hits(rows)


# Joins along handles ----------------------------------------------------------------------------------------


@query("SELECT p_brand, count(*) AS n FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_size < 25) ON l_partkey = p_partkey GROUP BY p_brand")
def handle_deref(spark, d):
    items = _t(spark, d, "part").where("p_size < 25").select("p_partkey", "p_brand")
    return handles.deref(_t(spark, d, "lineitem").select("l_partkey"), items, F.col("l_partkey"), "p_partkey").groupBy("p_brand").agg(F.count("*").alias("n"))


@query("SELECT l_partkey & 2047 AS entity, p_brand, count(*) AS n FROM lineitem JOIN part ON (l_partkey & 2047) = p_partkey GROUP BY ALL")
def masked_handle(spark, d):
    rows = _t(spark, d, "lineitem").select(derived.entity_of(F.col("l_partkey")).alias("entity")).groupBy("entity").agg(F.count("*").alias("n"))
    return handles.deref(rows, _t(spark, d, "part").select("p_partkey", "p_brand"), F.col("entity"), "p_partkey", "inner")


@query("SELECT n_regionkey AS region, max(CASE WHEN n_nationkey % 4 = 2 THEN n_name END) AS t_name, max(CASE WHEN n_nationkey % 4 = 3 THEN n_name END) AS ct_name FROM nation GROUP BY 1")
def team_pivot(spark, d):
    rows = _t(spark, d, "nation").select(F.col("n_regionkey").alias("region"), (F.col("n_nationkey") % 4).alias("team_num"), F.col("n_name").alias("name"))
    return handles.team_columns(rows, ["region"], ["name"])


@query("SELECT event_id, c_name AS name FROM events JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON user_id = c_custkey")
def thrower_inner(spark, d):
    players = _t(spark, d, "customer").where("c_acctbal > 0").select("c_custkey", F.col("c_name").alias("name"))
    return handles.deref(_t(spark, d, "events").select("event_id", "user_id"), players, F.col("user_id"), "c_custkey", "inner").select("event_id", "name")


@query(
    """WITH c AS (SELECT * FROM customer WHERE c_acctbal > 0), low AS (SELECT c_custkey & 255 AS k, arg_min(c_name, c_custkey) AS name, min(c_custkey) AS id FROM c GROUP BY 1)
    SELECT event_id, coalesce(c.c_name, low.name) AS user_name, coalesce(c.c_custkey, low.id)::VARCHAR AS user_steamid FROM events LEFT JOIN c ON user_id = c.c_custkey LEFT JOIN low ON (user_id & 255) = low.k"""
)
def event_user_left(spark, d):
    info = _t(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("userid"), F.col("c_name").alias("name"), F.col("c_custkey").alias("steamid"))
    return handles.user_of(_t(spark, d, "events").select("event_id", "user_id"), info, F.col("user_id"), "user").drop("user_id")


@query("SELECT l_orderkey, (sum(DISTINCT (1::HUGEINT << (l_partkey % 64)::INT)) - CASE WHEN bool_or(l_partkey % 64 = 63) THEN (1::HUGEINT << 64) ELSE 0 END)::BIGINT AS bitmask, count(DISTINCT l_partkey) AS n_items FROM lineitem GROUP BY l_orderkey")
def inventory(spark, d):
    slots = _t(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    kept = handles.inventory(slots, ["l_orderkey"], "l_partkey", "l_linenumber")
    return kept.select("l_orderkey", derived.item_bitmask(F.col("items")).alias("bitmask"), F.size("items").cast("bigint").alias("n_items"))


@query("SELECT o_orderkey, l_partkey AS def_index, o_custkey AS steamid FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_partkey % 5 <> 0")
def econ_explode(spark, d):
    items = _t(spark, d, "lineitem").select("l_orderkey", "l_partkey")
    owned = handles.deref(items, _t(spark, d, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey"), "o_orderkey", "inner")
    players = owned.groupBy(F.col("l_orderkey").alias("o_orderkey"), F.col("o_custkey").alias("steamid")).agg(F.collect_list("l_partkey").alias("items"))
    return players.select("o_orderkey", F.explode("items").alias("def_index"), "steamid").where("def_index % 5 <> 0")


@query("SELECT conv_id, turn, c_name AS name, text FROM conversations LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 3 = 0) ON conv_id = c_custkey")
def chat(spark, d):
    players = _t(spark, d, "customer").where("c_custkey % 3 = 0").select("c_custkey", F.col("c_name").alias("name"))
    return handles.deref(_t(spark, d, "conversations").select("conv_id", "turn", "text"), players, F.col("conv_id"), "c_custkey")


@query("SELECT o_orderkey, o_custkey - 10 AS account_id, c_name AS name FROM orders JOIN (SELECT * FROM customer WHERE c_nationkey < 10) ON o_custkey - 10 = c_custkey")
def rank_update(spark, d):
    """Inner join on an id less a base; unmatched rows go."""
    players = _t(spark, d, "customer").where("c_nationkey < 10").select("c_custkey", F.col("c_name").alias("name"))
    rows = _t(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") - 10).alias("account_id"))
    return handles.deref(rows, players, F.col("account_id"), "c_custkey", "inner")


# Events made from changes -----------------------------------------------------------------------------------


@query(
    """SELECT event_id, user_id, n, before FROM (SELECT event_id, user_id, n, lag(n) OVER (PARTITION BY user_id ORDER BY event_id) AS before
    FROM (SELECT event_id, user_id, sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id)::BIGINT AS n FROM events)) WHERE n - before = 1"""
)
def transition_events(spark, d):
    w = Window.partitionBy("user_id").orderBy("event_id")
    rows = _t(spark, d, "events").select("event_id", "user_id", F.sum((F.col("event_type") == "signup").cast("bigint")).over(w).alias("n"))
    return ev.on_change(rows, "n", ["user_id"], "event_id", 1).withColumnRenamed("previous", "before")


_RULES = f"SELECT event_id, user_id, {_KS} % 22 AS reason, sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id)::BIGINT AS n FROM events"
_WINNER = " ".join(f"WHEN {k} THEN '{v}'" for k, v in labels.ROUND_WINNER.items())


def _rules(spark, d):
    n = F.sum((F.col("event_type") == "signup").cast("bigint")).over(Window.partitionBy("user_id").orderBy("event_id"))
    return _t(spark, d, "events").select("event_id", "user_id", (_k() % 22).alias("reason"), n.alias("n"))


@query(
    f"""SELECT user_id, event_id, 'round_end' AS event_name, before AS round, CASE reason {_REASON} ELSE reason::VARCHAR END AS reason, CASE reason {_WINNER} ELSE reason::VARCHAR END AS winner
    FROM (SELECT *, lag(n) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM ({_RULES})) WHERE n - before = 1"""
)
def round_end(spark, d):
    return ev.round_ends(_rules(spark, d).withColumnRenamed("n", "round_end_count"), ["user_id"], "event_id")


@query(
    f"""WITH c AS (SELECT *, lag(n) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM ({_RULES}))
    SELECT user_id, event_id, n AS round, sub, event_name FROM c, (VALUES (0, 'round_officially_ended'), (1, 'round_start')) AS k(sub, event_name) WHERE n <> before AND (sub = 1 OR n > 1)"""
)
def round_start(spark, d):
    rows = _rules(spark, d).select("event_id", "user_id", F.col("n").alias("round_start_count"), (F.col("n") - 1).alias("total_rounds_played"))
    return ev.round_starts(rows, ["user_id"], "event_id")


@query(f"SELECT user_id, event_id, 'cs_win_panel_match' AS event_name FROM (SELECT *, lag(n) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM ({_RULES})) WHERE n <> before")
def win_panel_match(spark, d):
    return ev.match_ends(_rules(spark, d).withColumnRenamed("n", "match_end_count"), ["user_id"], "event_id")


@query(
    """SELECT event_id, user_id, v0, v1 FROM (SELECT event_id, user_id, event_type AS k0, lead(event_type) OVER w AS k1, value AS v0, lead(value) OVER w AS v1 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) WHERE k0 = 'purchase' AND k1 = 'view'"""
)
def purchase_pairs(spark, d):
    rows = _t(spark, d, "events").select("event_id", "user_id", "event_type", "value")
    return ev.ordered_pattern(rows, "event_type", ["purchase", "view"], ["user_id"], "event_id", "value").select("event_id", "user_id", "v0", "v1")


@query(
    """SELECT event_id, user_id, v0, v1, v2 FROM (SELECT event_id, user_id, event_type AS k0, lead(event_type) OVER w AS k1, lead(event_type, 2) OVER w AS k2, value AS v0, lead(value) OVER w AS v1, lead(value, 2) OVER w AS v2
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) WHERE k0 = 'view' AND k1 = 'click' AND k2 = 'purchase'"""
)
def purchase_triples(spark, d):
    rows = _t(spark, d, "events").select("event_id", "user_id", "event_type", "value")
    return ev.ordered_pattern(rows, "event_type", ["view", "click", "purchase"], ["user_id"], "event_id", "value").select("event_id", "user_id", "v0", "v1", "v2")


@query(
    """SELECT p.event_id, p.user_id, coalesce((SELECT min(event_id) FROM events e WHERE e.user_id = p.user_id AND e.event_type = 'error' AND e.event_id > p.event_id)
        < (SELECT min(event_id) FROM events e WHERE e.user_id = p.user_id AND e.event_type = 'purchase' AND e.event_id > p.event_id), false) AS was_sold FROM events p WHERE event_type = 'purchase'"""
)
def was_sold(spark, d):
    rows = _t(spark, d, "events").where("event_type in ('purchase', 'error')").select("event_id", "user_id", "event_type")
    kind = F.col("event_type")
    return ev.was_sold(rows, ["user_id"], "event_id", kind == "purchase", kind == "error").select("event_id", "user_id", "was_sold")


@query("SELECT event_id, user_id, value FROM events WHERE event_type = 'signup' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1")
def first_connect(spark, d):
    rows = _t(spark, d, "events").where("event_type = 'signup'").select("event_id", "user_id", "value")
    return ev.first_per_key(rows, ["user_id"], "event_id")


@query("SELECT user_id, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY user_id")
def roster_last(spark, d):
    return ev.last_per_key(_t(spark, d, "events").select("event_id", "user_id", "value"), ["user_id"], "event_id")


@query("SELECT CASE WHEN event_type IN ('view', 'error') THEN (event_id // 10) * 10 + 9 ELSE event_id END AS seq, event_type AS event_name, event_id FROM events")
def deferred_events(spark, d):
    rows = _t(spark, d, "events").select(F.col("event_id").alias("seq"), F.col("event_type").alias("event_name"), "event_id", (F.floor(F.col("event_id") / 10) * 10 + 9).alias("packet_end"))
    return ev.deferred_order(rows, ("view", "error"), "seq", "packet_end").drop("packet_end")


@query("SELECT event_id, user_id, value FROM events")
def segment_union(spark, d):
    rows = _t(spark, d, "events").select("event_id", "user_id", "value")
    return ev.union_segments(*(rows.where(F.floor(F.col("event_id") / 500) % 3 == k) for k in range(3)))


@query("SELECT user_id, string_agg(event_id::VARCHAR, ',' ORDER BY event_id) AS ids FROM events GROUP BY user_id")
def per_player_soa(spark, d):
    packed = ev.per_key_lists(_t(spark, d, "events").select("event_id", "user_id"), ["user_id"], "event_id", ["event_id"])
    return packed.select("user_id", F.array_join(F.col("event_id").cast("array<string>"), ",").alias("ids"))


@query("SELECT conv_id, string_agg(text, '' ORDER BY turn) AS audio FROM conversations GROUP BY conv_id")
def voice_concat(spark, d):
    packed = ev.per_key_lists(_t(spark, d, "conversations").select("conv_id", "turn", "text"), ["conv_id"], "turn", ["text"])
    return packed.select("conv_id", F.array_join("text", "").alias("audio"))


@query("SELECT r_name AS \"key\", count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def header_counts(spark, d):
    regions = _t(spark, d, "region").select("r_regionkey", F.col("r_name").alias("key"))
    return handles.deref(_t(spark, d, "nation").select("n_regionkey"), regions, F.col("n_regionkey"), "r_regionkey", "inner").groupBy("key").agg(F.count("*").alias("n"))


# Recipes ----------------------------------------------------------------------------------------------------



@query("SELECT e.event_id AS anchor, count(*) AS n, round(avg(r.value), 6) AS mean FROM events e JOIN events r ON r.user_id = e.user_id AND r.event_id BETWEEN e.event_id - 300 AND e.event_id WHERE e.event_type = 'error' GROUP BY 1")
def aim_window(spark, d):
    rows = _t(spark, d, "events").select("event_id", "user_id", "value", "event_type")
    anchors = rows.where("event_type = 'error'").select("event_id", "user_id")
    return ranges.window_before(rows, anchors, ["user_id"], "event_id", 300).groupBy(F.col("a_event_id").alias("anchor")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))


@query("SELECT user_id, count(*) AS n, round(sum(value), 4) AS total FROM events WHERE event_id <= (SELECT max(event_id) FROM events WHERE event_type = 'purchase') GROUP BY user_id")
def scoreboard(spark, d):
    return recipes.scoreboard(_t(spark, d, "events"))


@query("SELECT event_id // 500 AS round, user_id, count(*) AS kills FROM events WHERE event_type <> 'error' AND user_id <> 3 GROUP BY ALL")
def kills_per_round(spark, d):
    return recipes.kills_per_round(_t(spark, d, "events"))


@query(
    """SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(kills, 0) AS kills, coalesce(deaths, 0) AS deaths FROM (SELECT user_id, count(*) FILTER (WHERE value > 10) AS kills FROM events WHERE event_type = 'click' GROUP BY 1) a
    FULL JOIN (SELECT user_id, count(*) FILTER (WHERE value > 10) AS deaths FROM events WHERE event_type = 'error' GROUP BY 1) b ON a.user_id = b.user_id"""
)
def kda_per_zone(spark, d):
    return recipes.kda_per_zone(_t(spark, d, "events"))


@query(
    """WITH t AS (SELECT event_id, event_id // 400 AS round, count(*) FILTER (WHERE event_type = 'view') OVER w AS enemies, count(*) FILTER (WHERE event_type = 'click') OVER w AS mates FROM events
        WINDOW w AS (PARTITION BY event_id // 400 ORDER BY event_id)), f AS (SELECT round, min(event_id) AS event_id, arg_min(enemies, event_id) AS versus FROM t WHERE mates = 20 AND enemies >= 10 GROUP BY round)
    SELECT f.round, f.event_id, f.versus, w.winner FROM f JOIN (SELECT event_id // 400 AS round, arg_max(user_id, event_id) AS winner FROM events GROUP BY 1) w USING (round)"""
)
def clutch_1vx(spark, d):
    return recipes.clutch(_t(spark, d, "events"))


@query(
    """SELECT event_id, user_id, equipment FROM (SELECT event_id, user_id, event_type, last_value(CASE WHEN event_type = 'view' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS equipment FROM events)
    WHERE event_id IN (SELECT event_id FROM events WHERE event_type = 'signup')"""
)
def equip_at_freeze(spark, d):
    return recipes.equipment_at(_t(spark, d, "events"), SEGMENT)


@query("SELECT event_id, value - first_value(value) OVER (PARTITION BY event_id // 500 ORDER BY event_id) AS round_time FROM events")
def round_time(spark, d):
    return recipes.round_time(_t(spark, d, "events"))


@query("SELECT user_id, round(sum(value), 4) AS damage FROM events WHERE event_type = 'click' OR event_type = 'view' GROUP BY user_id")
def utility_filter(spark, d):
    return recipes.utility_damage(_t(spark, d, "events"), ["click", "view"])


@query("SELECT event_id, user_id FROM events WHERE event_type = 'error'")
def chicken(spark, d):
    return _t(spark, d, "events").where("event_type = 'error'").select("event_id", "user_id")


@query("SELECT event_id, user_id, event_type FROM events WHERE event_id >= (SELECT min(event_id) FROM events WHERE event_type = 'signup')")
def match_start_cut(spark, d):
    return recipes.from_match_start(_t(spark, d, "events").select("event_id", "user_id", "event_type"), "signup")


# What DataFrames give for nothing ---------------------------------------------------------------------------


@query(
    """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL"""
)
def pricing_summary(spark, d):
    rows = _t(spark, d, "lineitem").where("l_shipdate <= timestamp '1998-09-02'")
    revenue = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(revenue), 2).alias("revenue"), F.count("*").alias("n"))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def rollup_counts(spark, d):
    return _t(spark, d, "orders").rollup("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@query("SELECT o_custkey, o_orderkey, o_totalprice, rank FROM (SELECT *, rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC)::INT AS rank FROM orders) WHERE rank <= 3")
def top_per_player(spark, d):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"))
    return _t(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice", F.rank().over(w).alias("rank")).where("rank <= 3")


@query("SELECT l_suppkey AS id FROM lineitem INTERSECT SELECT l_partkey FROM lineitem EXCEPT SELECT n_nationkey FROM nation")
def set_operations(spark, d):
    items = _t(spark, d, "lineitem")
    both = items.select(F.col("l_suppkey").alias("id")).intersect(items.select("l_partkey"))
    return both.subtract(_t(spark, d, "nation").select(F.col("n_nationkey").cast("bigint")))
