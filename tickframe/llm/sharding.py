"""Sharding of indivisible groups by best-fit-decreasing bin packing."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import MOST_SENT, stash

#: Parts of a shard, and of a class of groups of equal size, in which rows are numbered independently.
PARTS = 256


class FreeSpace:
    """Open bins ordered by (free space, number) in an AVL tree: insert, and remove the tightest fit, in O(log n)."""

    def __init__(self) -> None:
        self.root: list | None = None  # [key, left, right, height]

    @staticmethod
    def _height(node: list | None) -> int:
        return node[3] if node else 0

    @classmethod
    def _settled(cls, node: list) -> list:
        """The balanced tree of a node whose subtrees are balanced and differ by two levels at most."""
        lean = cls._height(node[1]) - cls._height(node[2])
        if abs(lean) > 1:
            heavy, light = (1, 2) if lean > 0 else (2, 1)
            child = node[heavy]
            if cls._height(child[light]) > cls._height(child[heavy]):
                node[heavy] = cls._turned(child, light, heavy)
            return cls._turned(node, heavy, light)
        node[3] = 1 + max(cls._height(node[1]), cls._height(node[2]))
        return node

    @classmethod
    def _turned(cls, node: list, up: int, down: int) -> list:
        """The child on side ``up`` takes the node's place."""
        top = node[up]
        node[up], top[down] = top[down], node
        for n in (node, top):
            n[3] = 1 + max(cls._height(n[1]), cls._height(n[2]))
        return top

    def add(self, free: int, bin_no: int) -> None:
        def put(node: list | None) -> list:
            if node is None:
                return [(free, bin_no), None, None, 1]
            side = 1 if (free, bin_no) < node[0] else 2
            node[side] = put(node[side])
            return self._settled(node)

        self.root = put(self.root)

    def take_tightest(self, size: int) -> tuple[int, int] | None:
        """Remove and return the (free, bin) with the least free space that is ``size`` or more."""
        node, found = self.root, None
        while node:
            if node[0] >= (size, -1):
                found, node = node[0], node[1]
            else:
                node = node[2]
        if found:
            self.root = self._without(self.root, found)
        return found

    def _without(self, node: list, key: tuple[int, int]) -> list | None:
        if key != node[0]:
            side = 1 if key < node[0] else 2
            node[side] = self._without(node[side], key)
        elif node[1] is None or node[2] is None:
            return node[1] or node[2]
        else:
            after = node[2]
            while after[1]:
                after = after[1]
            node[0] = after[0]
            node[2] = self._without(node[2], after[0])
        return self._settled(node)


Runs = list[tuple[int, int, int]]


def best_fit_decreasing(classes: list[tuple[int, int]], capacity: int, most: int | None = None) -> tuple[Runs, int]:
    """Best-fit-decreasing over classes of equal items (size, how many): runs of (class, bin, how many), and the number of bins.

    Items go in by falling size; each enters the bin with the tightest remaining capacity that
    holds it, or a new one; an item above ``capacity`` has a bin of its own.  Once one of a
    class has entered a bin, that bin is still the tightest for the next, until it is too full;
    so a class takes one step for each bin it enters, and the bins are those of item-by-item
    placement.  It stops short when it needs more than ``most`` bins.
    """
    out, bins, free = [], 0, FreeSpace()
    for k in sorted(range(len(classes)), key=lambda k: -classes[k][0]):
        size, left = classes[k]
        while left:
            found = free.take_tightest(size)
            if found is None:
                found = (max(capacity, size), bins)
                bins += 1
                if most and bins > most:
                    return out, bins
            n = min(left, found[0] // size)
            out.append((k, found[1], n))
            left -= n
            if found[0] > n * size:
                free.add(found[0] - n * size, found[1])
    return out, bins


def pack_into(classes: list[tuple[int, int]], shards: int) -> Runs:
    """Runs (class, shard, how many): best-fit-decreasing at the smallest capacity found that needs no more than ``shards`` bins.

    Items above an even share have shards of their own first, as no capacity that holds them
    would make the others even.
    """
    order = sorted(range(len(classes)), key=lambda k: -classes[k][0])
    left, total, items = [n for _, n in classes], sum(s * n for s, n in classes), sum(n for _, n in classes)
    out: Runs = []
    for k in order:
        while left[k] and len(out) < min(shards - 1, items) and classes[k][0] * (shards - len(out)) > total:
            out.append((k, len(out), 1))
            left[k] -= 1
            total -= classes[k][0]
        if left[k]:
            break
    alone, rest = len(out), [k for k in order if left[k]]
    if not rest:
        return out
    own, room = [(classes[k][0], left[k]) for k in rest], shards - alone
    low, high = max(-(-total // room), own[0][0]), max(-(-total // room), own[0][0]) * 2
    best = best_fit_decreasing(own, high, room)
    while best[1] > room:
        low, high = high, high * 2
        best = best_fit_decreasing(own, high, room)
    while high - low > max(1, total // room // 100_000):
        mid = (low + high) // 2
        tried = best_fit_decreasing(own, mid, room)
        if tried[1] <= room:
            best, high = tried, mid
        else:
            low = mid + 1
    return out + [(rest[k], alone + b, n) for k, b, n in best[0]]


def _numbered(rows: DataFrame, by: str, part: str, order: list[str]) -> DataFrame:
    """``rows`` with ``nth``, gapless from 0 within ``by``: parts are numbered by themselves and laid end to end."""
    counts = rows.groupBy(by, part).agg(F.count("*").alias("n"))
    before = Window.partitionBy(by).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(by, part, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    within = Window.partitionBy(by, part).orderBy(*order)
    told = rows.withColumn("own", F.row_number().over(within)).join(stash(starts, "starts"), [by, part])
    return told.withColumn("nth", F.col("first") + F.col("own") - 1).drop("first", "own")


def shard_by_bytes(docs: DataFrame, *, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard``: shards of near equal bytes that keep equal texts together.

    ``size`` is the text's UTF-8 bytes plus 1.  Documents with equal texts are one indivisible
    group (by 128 bits of hash), whose size is their sum.  Groups of one size are alike, so
    ``pack_into`` places classes of them: distinct sizes with their counts, which are fewer than
    the square root of twice all bytes (14 million for 100 TB, 16 bytes each, and far fewer in
    practice), however many groups there are.  The runs of a class go to its groups in the
    order of their hashes.  A shard exceeds another by little more than the smallest groups,
    unless one group alone is larger than an even share.

    ``slot`` numbers the rows of a shard without gaps, in ``PARTS`` parts (by hash of the row's
    values, so that a hot group is spread) which are laid end to end.  Neither shards nor slots
    depend on how the table is laid out in files.

    Null texts are empty; repeated rows are documents of the same group and have slots of their
    own.  Other columns are not read.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2"))
    rows = stash(rows, "sizes")
    groups = stash(rows.groupBy("h1", "h2").agg(F.sum("size").alias("bytes")), "groups")
    told = groups.groupBy("bytes").agg(F.count("*").alias("n")).toArrow().sort_by([("bytes", "descending")])
    sizes = told.column("bytes").to_pylist()
    runs = pack_into(list(zip(sizes, told.column("n").to_pylist(), strict=True)), shards)

    of_class: list[list[tuple[int, int]]] = [[] for _ in sizes]
    for k, shard, n in runs:
        of_class[k].append((n, shard))
    until = [np.cumsum([n for n, _ in x]).tolist() for x in of_class]
    plan = pa.table({"bytes": pa.array(sizes, pa.int64()), "until": pa.array(until, pa.list_(pa.int64())), "shards": pa.array([[s for _, s in x] for x in of_class], pa.list_(pa.int32()))})
    plan = stash(spark.createDataFrame(plan), "plan")
    near = F.broadcast if len(sizes) <= MOST_SENT else lambda df: df

    placed = groups.join(near(plan), "bytes")
    whole = placed.where(F.size("shards") == 1).select("h1", "h2", F.col("shards")[0].alias("shard"))
    # Only classes that are split between shards need to number their groups.
    split = placed.where(F.size("shards") > 1).withColumn("part", F.pmod("h2", F.lit(PARTS)))
    shard = F.element_at("shards", F.size(F.filter("until", lambda u: u <= F.col("nth"))) + 1)
    dealt = _numbered(split, "bytes", "part", ["h1", "h2"]).select("h1", "h2", shard.alias("shard"))
    # Written, so that both sides of the join are plain exchanges and a hot group can be split.
    rows = rows.join(stash(whole.union(dealt), "dealt"), ["h1", "h2"])
    rows = stash(rows.select("doc_id", "size", "text_crc32", "shard", F.pmod(F.xxhash64("doc_id", "h2"), F.lit(PARTS)).alias("part")), "placed")
    numbered = _numbered(rows, "shard", "part", ["doc_id", "text_crc32", "size"])
    return numbered.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("nth").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
