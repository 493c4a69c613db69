"""Best-fit packing of documents into fixed-length sequences under conflict rules."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..code import share_code
from .shared import slices, stash, texts

#: Pieces of one lot, about; the pieces of a lot are packed in one call.
LOT_PIECES = 50_000
#: Equal rows that go to one lot together.
TIES = 1000
#: Bins filled to less than this share give their pieces to a second round.
FULL = 0.97


class Bins:
    """Open bins by residual capacity, with the keys that conflict in each.

    ``open`` is a bitmap over residuals: bit ``r`` is set while some bin has ``r`` left.  Each
    conflict key (a source, a duplicate cluster) has a bitmap ``full`` of the residuals at which
    every bin holds the key.  The successor search takes the lowest bit at or above an item's
    size that is open and full for none of its keys, looks for a bin there that has none of
    them, and goes on to the next bit otherwise; so it ends at the tightest compatible bin.
    """

    def __init__(self, capacity: int):
        self.capacity, self.count = capacity, 0
        self.open, self.full = 0, {}
        self.at: list[dict[int, None]] = [{} for _ in range(capacity + 1)]
        self.held: list[dict[int, int]] = [{} for _ in range(capacity + 1)]  # how many bins of a residual hold a key
        self.bits: list[int] = []  # the keys of each bin, as a bitmap
        self.keys: list[list[int]] = []

    def _mark(self, r: int, keys) -> None:
        n, held, bit = len(self.at[r]), self.held[r], 1 << r
        self.open = self.open | bit if n else self.open & ~bit
        for k in keys:
            if n and held.get(k) == n:
                self.full[k] = self.full.get(k, 0) | bit
            elif self.full.get(k, 0) & bit:
                self.full[k] &= ~bit

    def _leave(self, b: int, r: int) -> None:
        del self.at[r][b]
        touched, held = list(self.held[r]), self.held[r]
        for k in self.keys[b]:
            held[k] -= 1
            if not held[k]:
                del held[k]
        self._mark(r, touched)

    def _enter(self, b: int, r: int) -> None:
        before = list(self.held[r])
        self.at[r][b] = None
        for k in self.keys[b]:
            self.held[r][k] = self.held[r].get(k, 0) + 1
        self._mark(r, {*before, *self.keys[b]})

    def place(self, size: int, keys: list[int]) -> int:
        """The bin that takes an item of ``size`` with these conflict keys; it is opened if none fits."""
        blocked, need = 0, 0
        for k in keys:
            blocked |= self.full.get(k, 0)
            need |= 1 << k
        found = None
        free = (self.open & ~blocked) >> size << size
        while free and found is None:
            r = (free & -free).bit_length() - 1
            found = next(((b, r) for b in self.at[r] if not self.bits[b] & need), None)
            free &= free - 1
        if found is None:
            b, r = self.count, self.capacity
            self.count += 1
            self.bits.append(0)
            self.keys.append([])
        else:
            b, r = found
            self._leave(b, r)
        self.bits[b] |= need
        self.keys[b] += keys
        if r - size:
            self._enter(b, r - size)
        return b


def pack_lot(items: list[tuple[int, list[int]]], capacity: int) -> list[int]:
    """The bin of each item (size, conflict keys), placed by falling size, ties in the given order."""
    bins, out = Bins(capacity), [0] * len(items)
    for i in sorted(range(len(items)), key=lambda i: -items[i][0]):
        out[i] = bins.place(*items[i])
    return out


def word_counts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``doc_id, source, n_tokens, cluster``: lengths in words split at blanks; equal texts are a cluster."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            n = [len(x.split()) for x in texts(b.column("text"))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("source"), pa.array(n, pa.int64()), b.column("cluster")], names=["doc_id", "source", "n_tokens", "cluster"])

    kind = dict(docs.dtypes)[id_col]
    share_code(docs.sparkSession)
    given = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("cluster"))
    return given.mapInArrow(run, f"doc_id {kind}, source string, n_tokens long, cluster long")


def _dealt(lengths: DataFrame, copies: str, lot_pieces: int, salt: int) -> tuple[DataFrame, int]:
    """The rows with a lot for each, by a hash of their values, and the number of lots.

    Equal rows are counted, not told apart: ``TIES`` of them at a time go to a lot, so that a row
    repeated a million times is spread and the lots do not depend on the layout of the table.
    """
    keys = ["doc_id", "source", "n_tokens", "cluster"]
    met = stash(lengths.groupBy(*keys).agg(F.sum(copies).alias("copies")), "lengths")
    lots = max(1, -(-(met.agg(F.sum("copies")).first()[0] or 0) // lot_pieces))
    cut = met.withColumn("tie", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / TIES))))
    cut = cut.withColumn("copies", F.least(F.lit(TIES), F.col("copies") - F.col("tie") * TIES))
    return cut.withColumn("lot", F.pmod(F.xxhash64(F.lit(salt), *keys, "tie"), F.lit(lots)).cast("int")), lots


def _pack(t: pa.Table, capacity: int, first_lot: int, tails_only: bool) -> pa.Table:
    """The places of a lot's pieces, in their order by value, with ``closed``: whether the piece's bin is full.

    With ``tails_only`` the rows stand for the last pieces of their documents alone.
    """
    t = t.sort_by([(c, "ascending") for c in ("n_tokens", "doc_id", "source", "cluster", "tie")])
    ids, sources, sizes, clusters = ([x for x, n in zip(t.column(c).to_pylist(), t.column("copies").to_pylist(), strict=True) for _ in range(n)] for c in ("doc_id", "source", "n_tokens", "cluster"))
    often = {c for c, n in Counter(clusters).items() if n > 1 and c is not None}
    numbers: dict = {}
    rest = [k for k, n in enumerate(sizes) if n % capacity]
    items = [(sizes[k] % capacity, [numbers.setdefault(x, len(numbers)) for x in [("source", sources[k])] + [("cluster", clusters[k])] * (clusters[k] in often)]) for k in rest]
    bins = pack_lot(items, capacity)
    fill = Counter()
    for (size, _), b in zip(items, bins, strict=True):
        fill[b] += size
    bin_of, used, offsets, out = dict(zip(rest, bins, strict=True)), max(bins, default=-1) + 1, Counter(), []
    for k, n in enumerate(sizes):
        row = (ids[k], sources[k], n, clusters[k])
        if not tails_only:
            if not n:
                out.append((*row, 0, 0, 0, None, None, True))
            for piece in range(n // capacity):
                out.append((*row, piece, piece * capacity, capacity, used, 0, True))
                used += 1
        if k in bin_of:
            b = bin_of[k]
            out.append((*row, n // capacity, n - n % capacity, n % capacity, b, offsets[b], fill[b] >= FULL * capacity))
            offsets[b] += n % capacity
    kinds = [t.schema.field("doc_id").type, pa.string(), pa.int64(), pa.int64(), *[pa.int64()] * 5, pa.bool_()]
    names = ["doc_id", "source", "n_tokens", "cluster", "piece", "start", "length", "bin", "offset", "closed"]
    told = pa.Table.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
    return told.append_column("lot", pa.array([first_lot + t.column("lot")[0].as_py()] * len(out), pa.int32()))


def pack_documents(lengths: DataFrame, *, capacity: int = 2048, lot_pieces: int = LOT_PIECES) -> DataFrame:
    """``doc_id, piece, start, length, lot, bin, offset``: where each piece of each document goes.

    ``lengths`` has ``doc_id, source, n_tokens, cluster``.  A document of more than ``capacity``
    tokens is cut into full pieces, which fill bins of their own, and a last one.  Pieces of less
    than ``capacity`` are packed best-fit by falling size; no bin holds two of one source or of
    one duplicate cluster.  ``bin`` names a bin within ``lot``; ``offset`` is where the piece begins in
    its bin.

    Rows are dealt to lots of about ``lot_pieces`` by a hash of their values, whatever their
    source or cluster, so no key makes a large lot; a lot is packed in one call.  Pieces in bins
    that a lot left less than ``FULL`` are dealt to lots once more, by another hash, and packed
    with those of other lots.  Lots and bins depend on the rows alone, not on their order or
    partitions.  Only ids, lengths and keys are shuffled.

    Documents without tokens (also null lengths) take no room: bin and offset are null.  A null
    source is a source; a null cluster conflicts with nothing.  Repeated rows are packed as
    often as they stand there.
    """
    given = lengths.select("doc_id", "source", F.coalesce("n_tokens", F.lit(0)).cast("long").alias("n_tokens"), "cluster", F.lit(1).cast("long").alias("one"))
    share_code(lengths.sparkSession)
    schema = f"doc_id {dict(given.dtypes)['doc_id']}, source string, n_tokens long, cluster long, piece long, start long, length long, bin long, offset long, closed boolean, lot int"

    def packed(rows: DataFrame, first_lot: int, tails_only: bool) -> DataFrame:
        return rows.groupBy("lot").applyInArrow(lambda t: _pack(t, capacity, first_lot, tails_only), schema)

    rows, lots = _dealt(given, "one", lot_pieces, 0)
    first = stash(packed(rows, 0, False), "first")
    left, _ = _dealt(first.where(~F.col("closed")).withColumn("one", F.lit(1).cast("long")), "one", lot_pieces, 1)
    # With one lot the pieces have met already, and would only be packed without those in full bins.
    out = first.where("closed").unionByName(packed(left, lots, True)) if lots > 1 else first
    return out.select("doc_id", "piece", "start", "length", "lot", "bin", "offset")
