"""Removal of lines repeated across documents, by a sharded minimal perfect hash."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..code import share_code
from .shared import LOWER, MOST_SENT, SPACES, forget, fresh, map_rows, mix, quoted, slices, stash, texts

_U = np.uint64
#: Entries of one shard of the hash, on average.
SHARD_KEYS = 250_000
#: Bytes of an index that goes to the executors whole; documents send their digests to the shards of a larger one.
SENT_BYTES = 64 << 20
#: Digests that meet a shard in one call.
CALL_PROBES = 2_000_000
_NO_ID = -(2**63)


def _keys(text: bytes, min_chars: int) -> list[tuple[int, bytes]]:
    """Line numbers and 16-byte digests of the line keys with ``min_chars`` code points or more."""
    out = []
    for i, line in enumerate(text.translate(LOWER).split(b"\n")):
        if len(line) >= min_chars:
            line = line.strip(SPACES)
            n = len(line)
            if n >= 4 * min_chars or n >= min_chars and len(line.decode()) >= min_chars:
                out.append((i, xxhash.xxh3_128_digest(line)))
    return out


def _digests(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    pair = np.frombuffer(b"".join(keys), _U).reshape(-1, 2)
    return pair[:, 0], pair[:, 1]


class PerfectHash:
    """A minimal perfect hash in levels: keys alone in their slot of a bit array keep it, the rest go to the next level.

    Keys are 128-bit digests in two halves, mixed anew at every level.  ``place`` numbers them
    0..n-1 without gaps (a rank over the bits, by 64-bit words); a foreign key gets any number or
    -1, and the caller's fingerprint array tells it apart.  Equal keys are refused.
    """

    MOST_LEVELS = 64

    def __init__(self, h1: np.ndarray, h2: np.ndarray, gamma: float = 1.7):
        self.levels: list[np.ndarray] = []
        while len(h1):
            if len(self.levels) == self.MOST_LEVELS:
                raise ValueError("keys of a perfect hash must differ")
            size = max(64, (int(gamma * len(h1)) + 63) // 64 * 64)
            slot = self._slot(h1, h2, len(self.levels), size)
            alone = np.bincount(slot, minlength=size) == 1
            self.levels.append(np.packbits(alone, bitorder="little").view(_U))
            left = ~alone[slot]
            h1, h2 = h1[left], h2[left]
        self._rank()

    def _rank(self) -> None:
        self.ranks, self.n = [], 0
        for words in self.levels:
            ones = np.bitwise_count(words).astype(np.int64)
            self.ranks.append(self.n + np.cumsum(ones) - ones)
            self.n += int(ones.sum())

    @staticmethod
    def _slot(h1: np.ndarray, h2: np.ndarray, level: int, size: int) -> np.ndarray:
        step = _U(0x9E3779B97F4A7C15 * (level + 1) & 0xFFFFFFFFFFFFFFFF)
        return (mix(mix(h1 + step) ^ h2) % _U(size)).astype(np.int64)

    def place(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        out, left = np.full(len(h1), -1, np.int64), np.arange(len(h1))
        for level, words in enumerate(self.levels):
            if not len(left):
                break
            slot = self._slot(h1[left], h2[left], level, 64 * len(words))
            word, bit = words[slot >> 6], (slot & 63).astype(_U)
            here = (word >> bit & _U(1)).astype(bool)
            below = word[here] & ((_U(1) << bit[here]) - _U(1))
            out[left[here]] = self.ranks[level][slot[here] >> 6] + np.bitwise_count(below)
            left = left[~here]
        return out

    def to_bytes(self) -> list[bytes]:
        return [x.tobytes() for x in self.levels]

    @classmethod
    def from_bytes(cls, levels: list[bytes]) -> PerfectHash:
        new = cls.__new__(cls)
        new.levels = [np.frombuffer(x, _U) for x in levels]
        new._rank()
        return new


def _shard(h1: np.ndarray, shards: int) -> np.ndarray:
    """Where a digest is dealt; ``line_index`` says the same in SQL."""
    return (h1 >> _U(33)).astype(np.int64) % shards


def line_index(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """The shards of the perfect hash: ``shard, shards, levels, fingerprints, counts, last_ids, n_bytes``.

    Distinct line digests are counted once per document (partial sums first, so a line that
    stands everywhere costs one row a task); those in ``min_docs`` documents or more - the
    others can decide nothing, and their fingerprints would not match - are dealt to shards by
    digest, about ``SHARD_KEYS`` to each, and every shard is hashed by itself.
    """
    spark = docs.sparkSession

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            found = [{k for _, k in _keys(x, min_chars)} for x in texts(b.column("text"))]
            rows = np.repeat(np.arange(len(found)), [len(x) for x in found])
            h1, h2 = _digests([k for x in found for k in x])
            yield pa.RecordBatch.from_arrays([pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), b.column("id").take(pa.array(rows))], names=["h1", "h2", "id"])

    share_code(spark)
    given = docs.select(F.col(quoted(id_col)).cast("long").alias("id"), F.col(quoted(text_col)).alias("text"))
    held = given.mapInArrow(lines, "h1 long, h2 long, id long").groupBy("h1", "h2").agg(F.count("*").alias("n"), F.max("id").alias("last"))
    held = stash(held.where(F.col("n") >= min_docs), "lines")
    shards = max(1, -(-held.count() // SHARD_KEYS))

    def build(table: pa.Table) -> pa.Table:
        t = table.sort_by([("h1", "ascending"), ("h2", "ascending")])
        h1, h2 = (t.column(c).to_numpy().view(_U) for c in ("h1", "h2"))
        hashed = PerfectHash(h1, h2)
        at = hashed.place(h1, h2)
        prints, counts, last = np.zeros(hashed.n, _U), np.zeros(hashed.n, np.int32), np.zeros(hashed.n, np.int64)
        prints[at], last[at] = h1, t.column("last").fill_null(_NO_ID).to_numpy()
        counts[at] = np.minimum(t.column("n").to_numpy(), 2**31 - 1)
        levels = hashed.to_bytes()
        size = sum(map(len, levels)) + 20 * hashed.n
        return pa.table({"shard": [t.column("shard")[0].as_py()], "shards": [shards], "levels": pa.array([levels], pa.list_(pa.binary())), "fingerprints": [prints.tobytes()], "counts": [counts.tobytes()], "last_ids": [last.tobytes()], "n_bytes": [size]})

    schema = "shard long, shards long, levels array<binary>, fingerprints binary, counts binary, last_ids binary, n_bytes long"
    of = (F.shiftrightunsigned("h1", 33) % F.lit(shards)).alias("shard")
    out = stash(held.select("h1", "h2", "n", "last", of).groupBy("shard").applyInArrow(build, schema), "line-index")
    forget(held)
    return out


class _Index:
    """Some shards of the index in a worker."""

    def __init__(self, rows: list[dict]):
        self.shards, self.parts = rows[0]["shards"] if rows else 1, {}
        for r in rows:
            self.parts[r["shard"]] = (PerfectHash.from_bytes(r["levels"]), *(np.frombuffer(r[c], d) for c, d in (("fingerprints", _U), ("counts", np.int32), ("last_ids", np.int64))))

    def last_ids(self, h1: np.ndarray, h2: np.ndarray, min_docs: int) -> tuple[np.ndarray, np.ndarray]:
        """Which digests stand in ``min_docs`` documents by these arrays, and the largest of their ids."""
        found, out, shard = np.zeros(len(h1), bool), np.zeros(len(h1), np.int64), _shard(h1, self.shards)
        for k, (hashed, prints, counts, last) in self.parts.items():
            mine = np.flatnonzero(shard == k)
            at = hashed.place(h1[mine], h2[mine])
            mine, at = mine[at >= 0], at[at >= 0]
            same = (prints[at] == h1[mine]) & (counts[at] >= min_docs)
            found[mine[same]], out[mine[same]] = True, last[at[same]]
        return found, out


def _ids(column: pa.Array) -> np.ndarray:
    return column.cast(pa.int64()).fill_null(_NO_ID).to_numpy(zero_copy_only=False)


def _routed(docs: DataFrame, index: DataFrame, id_col: str, text_col: str, min_chars: int, min_docs: int) -> DataFrame:
    """``id, t1, t2, gone``: the numbers of the lines to drop, for documents that have any, named by id and text.

    Digests go to the shards, a shard that gets many to several calls, each with a copy of its
    arrays; so a line that stands everywhere is spread, and no task holds more than one shard.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    given = docs.select(F.col(quoted(id_col)).cast("long").alias("id"), F.col(quoted(text_col)).alias("text"))
    given = given.select("id", F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2"), "text")

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            found = [_keys(x, min_chars) for x in texts(b.column("text"))]
            rows = pa.array(np.repeat(np.arange(len(found)), [len(x) for x in found]))
            h1, h2 = _digests([k for x in found for _, k in x])
            lines = pa.array([i for x in found for i, _ in x], pa.int32())
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(rows) for c in ("id", "t1", "t2")), lines, pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64))], names=["id", "t1", "t2", "line", "h1", "h2"])

    shards = index.select("shards").first()[0]
    probes = given.mapInArrow(digests, "id long, t1 long, t2 long, line int, h1 long, h2 long").withColumn("shard", F.shiftrightunsigned("h1", 33) % F.lit(shards))
    probes = stash(probes, "probes")
    calls = stash(probes.groupBy("shard").agg(F.ceil(F.count("*") / CALL_PROBES).cast("int").alias("calls")), "calls")
    few = F.broadcast(calls) if shards <= MOST_SENT else calls
    probes = probes.join(few, "shard").withColumn("call", F.pmod(F.xxhash64("id", "t1", "line"), F.col("calls")).cast("int"))
    copies = index.join(few, "shard").withColumn("call", F.explode(F.sequence(F.lit(0), F.col("calls") - 1))).drop("calls")
    copies = copies.select(*(F.col(c).alias(f"of_{c}" if c in ("shard", "call") else c) for c in copies.columns))

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = [r | {"shard": r["of_shard"]} for r in right.to_pylist()]
        h1, h2 = (left.column(c).to_numpy().view(_U) for c in ("h1", "h2"))
        repeated, last = _Index(rows).last_ids(h1, h2, min_docs)
        return left.select(["id", "t1", "t2", "line"]).filter(pa.array(repeated & (_ids(left.column("id").combine_chunks()) != last)))

    hits = probes.groupBy("shard", "call").cogroup(copies.groupBy("of_shard", "of_call")).applyInArrow(meet, "id long, t1 long, t2 long, line int")
    return stash(hits.groupBy("id", "t1", "t2").agg(F.collect_set("line").alias("gone")), "gone")


def dedup_lines(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_chars: int = 20,
    min_docs: int = 3,
    sent_bytes: int = SENT_BYTES,
) -> DataFrame:
    """``docs`` with three more columns: ``n_lines``, ``n_dropped`` and ``kept_text``.

    A line's key is the line without blanks at its ends, A-Z in lower case.  A key of at least
    ``min_chars`` code points that stands in at least ``min_docs`` documents loses all its
    lines except in the document with the largest id.  Documents probe the arrays of
    ``line_index``; lines are never joined.  An index of at most ``sent_bytes`` goes to the
    executors, and texts stay where they are; to the shards of a larger one the documents send
    their lines' digests, and the numbers of the lines to drop come back by id and text.

    Ids must be integers (TypeError otherwise).  Null and empty texts are one empty line.  Every
    row is a document, so repeated rows count as often as they stand there, and all rows with the
    largest id keep their lines.  A null id is below all others.  Existing columns named like the
    new ones are replaced; other columns may have any name.
    """
    from pyspark.sql.types import IntegralType, LongType, StringType, StructField, StructType

    if not isinstance(docs.schema[id_col].dataType, IntegralType):
        raise TypeError(f"ids must be integers, not {docs.schema[id_col].dataType.simpleString()}")
    spark = docs.sparkSession
    share_code(spark)
    new = ("n_lines", "n_dropped", "kept_text")
    docs = docs.select(*(quoted(c) for c in docs.columns if c.lower() not in new))
    kept = docs.columns
    schema = StructType([*docs.schema.fields, *(StructField(n, StringType() if n == "kept_text" else LongType()) for n in new)])
    index = line_index(docs, id_col=id_col, text_col=text_col, min_chars=min_chars, min_docs=min_docs)
    size = index.agg(F.sum("n_bytes")).first()[0] or 0

    def finish(b: pa.RecordBatch, gone: list) -> pa.RecordBatch:
        n, dropped, out = [], [], []
        for text, drop in zip(texts(b.column(text_col)), gone, strict=True):
            n.append(text.count(b"\n") + 1)
            dropped.append(len(drop or ()))
            out.append(b"\n".join(x for i, x in enumerate(text.split(b"\n")) if i not in drop) if drop else text)
        told = [pa.array(n, pa.int64()), pa.array(dropped, pa.int64()), pa.array(out, pa.binary()).cast(pa.string())]
        return pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), *told], names=[*kept, *new])

    if size > sent_bytes:
        found = _routed(docs, index, id_col, text_col, min_chars, min_docs)
        i, t1, t2, gone = (fresh(docs, c) for c in ("id", "t1", "t2", "gone"))
        text = F.coalesce(F.col(quoted(text_col)), F.lit(""))
        found = found.toDF(i, t1, t2, gone)
        same = F.col(quoted(id_col)).eqNullSafe(F.col(i)) & (F.xxhash64(text) == F.col(t1)) & (F.xxhash64(F.lit(1), text) == F.col(t2))
        held = docs.join(found, same, "left").select(*(quoted(c) for c in kept), gone)

        def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in slices(batches, text_col):
                yield finish(b, [set(x or ()) for x in b.column(gone).to_pylist()])

        return map_rows(held, drop, schema)

    sent = spark.sparkContext.broadcast(index.toArrow().to_pylist())

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _Index(sent.value)
        for b in slices(batches, text_col):
            found = [_keys(x, min_chars) for x in texts(b.column(text_col))]
            rows = np.repeat(np.arange(len(found)), [len(x) for x in found])
            lines = np.fromiter((i for x in found for i, _ in x), np.int64, len(rows))
            repeated, last = own.last_ids(*_digests([k for x in found for _, k in x]), min_docs)
            drop = repeated & (_ids(b.column(id_col))[rows] != last)
            gone: list = [None] * b.num_rows
            for row, line in zip(rows[drop].tolist(), lines[drop].tolist(), strict=True):
                gone[row] = gone[row] or set()
                gone[row].add(line)
            yield finish(b, gone)

    return map_rows(docs, probe, schema)
