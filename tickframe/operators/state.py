"""State at a moment: the last write at or before it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def carry_forward(rows: DataFrame, keys: list[str], order: str, props: dict[str, Column], segment: Column | None = None) -> DataFrame:
    """``rows`` with the latest non-null value of each property so far, its own row included.

    ``props`` maps output columns to expressions that are null where a row writes nothing.
    ``order`` must be unique within ``keys``.  Without ``segment`` this is one window by
    ``keys``.  With it - an expression that never falls as ``order`` rises - each (key, segment)
    is filled by itself; a row with the last values of the segments before stands first in it, if
    there are any.  A key that holds much of the data is spread over its segments.
    """
    if segment is None:
        local = Window.partitionBy(*keys).orderBy(order)
        return rows.withColumns({n: F.last(c, ignorenulls=True).over(local) for n, c in props.items()})
    own = {n: f"__own_{n}" for n in props}
    kept = [c for c in rows.columns if c not in props]
    rows = rows.withColumns({"__segment": segment} | {own[n]: c for n, c in props.items()}).select(*kept, "__segment", *own.values())
    ends = rows.groupBy(*keys, "__segment").agg(*(F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in own.values()))
    before = Window.partitionBy(*keys).orderBy("__segment").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(*keys, "__segment", *(F.last(c, ignorenulls=True).over(before).alias(c) for c in own.values()), F.lit(True).alias("__carried"))
    ends = ends.where(F.coalesce(*(F.when(F.col(c).isNotNull(), True) for c in own.values())))
    local = Window.partitionBy(*keys, "__segment").orderBy(F.col("__carried").asc_nulls_last(), order)
    filled = rows.unionByName(ends, allowMissingColumns=True).withColumns({c: F.last(c, ignorenulls=True).over(local) for c in own.values()})
    return filled.where(F.col("__carried").isNull()).select(*kept, *(F.col(c).alias(n) for n, c in own.items()))


def until_next(rows: DataFrame, key: str, order: str, name: str, segment: int) -> DataFrame:
    """``rows`` with ``order`` of the next row of the same ``key`` (never null) as ``name``, null at its last; spans of ``segment`` positions by themselves."""
    rows = rows.withColumn("__segment", F.floor(F.col(order) / segment))
    starts = rows.groupBy(F.col(key).alias("__k"), F.col("__segment").alias("__s")).agg(F.min(order).alias("__start"))
    starts = starts.withColumn("__start", F.lead("__start").over(Window.partitionBy("__k").orderBy("__s")))
    own = rows.withColumn("__next", F.lead(order).over(Window.partitionBy(key, "__segment").orderBy(order)))
    both = own.join(starts, (F.col(key) == F.col("__k")) & (F.col("__segment") == F.col("__s")))
    return both.withColumn(name, F.coalesce("__next", "__start")).drop("__k", "__s", "__start", "__next", "__segment")


def as_of(probes: DataFrame, deltas: DataFrame, keys: list[str], order: str, props: list[str], types: dict[str, str] | None = None, resets: DataFrame | None = None, segment: int | None = None) -> DataFrame:
    """``probes`` with the values that ``deltas`` (keys, order, prop, value) last wrote at or before each.

    Deltas and probes are laid in one sequence and filled at once for all properties; a
    delta at a probe's own position counts.  ``resets`` (keys, order) forget all earlier values
    of a key: a slot's new life, or its end.  Keys that are null on the probe match nothing.
    With ``segment``, spans of so many positions are filled by themselves (``carry_forward``), so
    that a key that holds much of the data is spread.
    """
    at = {p: f"__p{i}" for i, p in enumerate(props)}
    written = lambda value: F.struct(value.alias("v"))
    both = deltas.where(F.col("prop").isin(props)).select(*keys, order, F.lit(1).alias("__kind"), *(F.when(F.col("prop") == p, written(F.col("value").cast("string"))).alias(n) for p, n in at.items()))
    mine = [c for c in probes.columns if c not in keys and c != order]
    probe = probes.select(*keys, order, F.lit(2).alias("__kind"), F.struct(*[F.col(f"`{c}`").alias(c) for c in mine] or [F.lit(1).alias("__none")]).alias("__row"))
    both = both.unionByName(probe, allowMissingColumns=True)
    if resets is not None:
        both = both.unionByName(resets.select(*keys, order, F.lit(0).alias("__kind"), *(written(F.lit(None).cast("string")).alias(n) for n in at.values())), allowMissingColumns=True)
    both = both.withColumn("__at", F.struct(order, "__kind"))
    cut = None if segment is None else F.floor(F.col(order) / segment)
    filled = carry_forward(both, keys, "__at", {n: F.col(n) for n in at.values()}, cut).where("__kind = 2")
    known = F.lit(True)
    for k in keys:
        known &= F.col(k).isNotNull()
    cast = [_typed(F.when(known, F.col(n)["v"]), (types or {}).get(p, "string")).alias(p) for p, n in at.items()]
    return filled.select(*keys, order, *(F.col("__row").getField(c).alias(c) for c in mine), *cast)


def _typed(value: Column, kind: str) -> Column:
    return F.from_json(value, kind) if kind.startswith(("array", "map", "struct")) else value.cast(kind)


def generations(lifecycle: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Validity of each life of an entity slot: ``generation, from, to`` (exclusive; null while it lives).

    ``lifecycle`` has ``kind`` create or delete; a create ends the life before it, a delete ends its own.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    told = lifecycle.withColumn("generation", F.sum((F.col("kind") == "create").cast("int")).over(w)).withColumn("to", F.lead(order).over(w))
    return told.where("kind = 'create'").select(*keys, "generation", F.col(order).alias("from"), "to")
