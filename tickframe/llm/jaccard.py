"""N-gram Jaccard join through parity sketches, and near-duplicate groups."""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..code import share_code
from .shared import LOWER, MOST_SENT, WordHashes, forget, mix, quoted, slices, stash, texts, without

_U = np.uint64
#: Bits of one segment of a sketch: so many that unrelated sets of a large corpus seldom have equal ones.
SEGMENT_BITS = 32
#: Rows of one block of a bucket; larger buckets are compared block by block.
BLOCK_ROWS = 256
#: Rows of compared blocks that go to one task's call together.
CALL_ROWS = 20_000


class Bands:
    """Size bands and what pairs in them may differ by, at a similarity of ``num / den`` or more.

    Band ``k`` holds the sizes from ``edge[k]`` to below ``edge[k + 1]``, and no set links with
    one more than a band away.  Scheme ``k`` serves the pairs whose larger set is in band ``k``:
    two such sets differ by ``limit(k)`` shingles at most, and so do their sketches in bits; so
    of ``parts(k)`` segments of the sketch, all but ``limit(k)`` are equal.
    """

    def __init__(self, num: int, den: int):
        self.t = Fraction(num, den)
        self.edges = [1]

    def band(self, n: int) -> int:
        """The band of size ``n``; edges follow ``next = floor(edge / t) + 1``, exactly."""
        while self.edges[-1] <= n:
            self.edges.append(math.floor(self.edges[-1] / self.t) + 1)
        return bisect_right(self.edges, n) - 1

    def limit(self, k: int) -> int:
        while len(self.edges) < k + 2:
            self.band(self.edges[-1])
        most = self.edges[k + 1] - 1
        return math.floor(2 * most * (1 - self.t) / (1 + self.t))

    def parts(self, k: int) -> int:
        """An eighth more than are needed to be sure of one, so that a set may do without some common segments (see ``buckets``)."""
        return self.limit(k) + 1 + 2 + (self.limit(k) + 1) // 8

    def bits(self, k: int) -> int:
        """Of the folded sketch by which candidates are compared."""
        self.limit(k)
        return -(-self.edges[k + 1] // 64) * 64


def _shingle_sets(batch: list[bytes], n: int, memo: WordHashes) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words = [x.translate(LOWER).split() for x in batch]
    counts = [len(w) for w in words]
    h = memo.of([w for x in words for w in x])
    out, at = [], 0
    with np.errstate(over="ignore"):
        for c in counts:
            own = h[at : at + c]
            at += c
            k = min(n, c)
            if not c:
                out.append(own)
                continue
            s = np.full(c - k + 1, k, _U)
            for j in range(k):
                s = mix(s * _U(0x9E3779B97F4A7C15) + own[j : c - k + 1 + j])
            s.sort()
            out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
    return out


def _set_hash(s: np.ndarray) -> tuple[int, int]:
    d = xxhash.xxh3_128_intdigest(s.tobytes())
    return (d >> 64) - (1 << 63), (d & (1 << 64) - 1) - (1 << 63)


def _sketch(s: np.ndarray, k: int, bands: Bands) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of the bits that a set's shingles flip in the sketch of scheme ``k``, and the segments they lie in.

    The sketch has ``parts(k)`` segments of 2 ** ``SEGMENT_BITS`` bits; it is nearly empty, so it
    is kept as these numbers.  A shingle's hash names its bit, and the segments rise with ``s``.
    """
    part = ((s >> _U(32)) * _U(bands.parts(k)) >> _U(32)).astype(np.int64)
    return (part.astype(_U) << _U(SEGMENT_BITS)) | (s & _U((1 << SEGMENT_BITS) - 1)), part


def _segment_keys(bit: np.ndarray, part: np.ndarray, k: int, bands: Bands) -> tuple[np.ndarray, int]:
    """Keys of a set's segments, equal for equal segments, and how many of the most common a set may do without.

    A key digests a segment's bits by XOR, in which a bit flipped twice cancels as it does in the
    sketch.  Linked sets have ``parts - limit`` equal segments or more; in any order that all
    sets share, the first ``limit + 1`` of each have one in common (prefix filter).  Empty
    segments come last in that order and give keys only to sets that would be short of
    ``limit + 1`` otherwise.
    """
    need = bands.limit(k) + 1
    if need == 1:
        return np.zeros(0, np.int64), 0  # only equal sets could link
    first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
    key, own = np.bitwise_xor.reduceat(mix(bit), first), part[first]
    if len(own) < need:
        free = np.setdiff1d(np.arange(bands.parts(k)), own)[: need - len(own)]
        key, own = np.concatenate([key, np.zeros(len(free), _U)]), np.concatenate([own, free])
    with np.errstate(over="ignore"):
        return mix(key + mix(own.astype(_U) + _U(k << 32))).view(np.int64), len(own) - need


def _folded(bit: np.ndarray, bits: int) -> bytes:
    """The sketch folded to fewer bits: two folded sketches differ in as many bits as the sets in shingles, at most."""
    at = (mix(bit ^ _U(0xA5A5A5A5A5A5A5A5)) % _U(bits)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=bits) & 1).astype(np.uint8)).tobytes()


class _Seen(set):
    """Set hashes that a task has met; it forgets all rather than grow without end, which only repeats work."""

    def new(self, h: tuple[int, int]) -> bool:
        if h in self:
            return False
        if len(self) >= 500_000:
            self.clear()
        self.add(h)
        return True


#: A key that so many sets of one batch share is common: its rows are told apart before the others are gathered by key.
COMMON = 32
_SHAPE = "n_shingles long, h1 long, h2 long, band int, keys array<long>, keys_up array<long>, slack int, slack_up int, sketch binary, sketch_up binary, common array<long>"


def shapes(docs: DataFrame, n: int, num: int, den: int, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All that one pass over the texts tells of each document's shingle set.

    ``doc_id, n_shingles, h1, h2`` (a 128-bit hash of the set), and for a set that the task has
    not met before: its band, the keys of its sketch's segments, how many of them it may do
    without, and its folded sketch, for its own band's scheme and the next one's (``_up``).  A
    text copied a million times gives these once a task.  The first row of a batch also has the
    keys that are ``common`` in it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, bands, seen = WordHashes(), Bands(num, den), _Seen()
        for b in slices(batches, "text", 4 << 20):
            rows, every = [], []
            for s in _shingle_sets(texts(b.column("text")), n, memo):
                h = _set_hash(s)
                if not len(s) or not seen.new(h):
                    rows.append([len(s), *h, *[None] * 8])
                    continue
                k = bands.band(len(s))
                keys, slacks, drawn = [], [], []
                for scheme in (k, k + 1):
                    bit, part = _sketch(s, scheme, bands)
                    own, slack = _segment_keys(bit, part, scheme, bands)
                    keys.append(own)
                    slacks.append(slack)
                    drawn.append(_folded(bit, bands.bits(scheme)))
                rows.append([len(s), *h, k, *keys, *slacks, *drawn, None])
                every += keys
            if every:
                key, times = np.unique(np.concatenate(every), return_counts=True)
                rows[0][-1] = key[times >= COMMON]
            cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("id"), *cols], names=names)

    many = pa.list_(pa.int64())
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), many, many, pa.int32(), pa.int32(), pa.binary(), pa.binary(), many]
    names = ["doc_id", *(x.split()[0] for x in _SHAPE.split(", "))]
    share_code(docs.sparkSession)
    given = docs.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(text_col)).alias("text"))
    return given.mapInArrow(run, f"doc_id {given.schema[0].dataType.simpleString()}, {_SHAPE}")


def _sent(df: DataFrame) -> DataFrame:
    """For a written table: broadcast while it is small, else left to the planner."""
    return F.broadcast(df) if df.count() <= MOST_SENT else df


def buckets(shaped: DataFrame, clashes: DataFrame) -> DataFrame:
    """``key, h, up, size``: sets (by ``h1``) that share a segment, in buckets of two or more.

    Keys that one set alone has are left out first, then the sets of the others are counted.  In
    the order of these counts, a set then leaves its ``slack`` most common segments
    (see ``_segment_keys``): a passage in a third of all documents costs each of them a few
    common segments, which they can spare.  Sets whose ``h1`` is not theirs alone spare none.

    No common key is gathered in one task: keys that are common in some batch of texts are known
    to be shared and go past the first step, the counts are partial sums, and later joins on keys are
    between written tables, which Spark splits where they are skewed.  A set's own segments, as
    many as its text is long, are ordered in one task.
    """
    of = lambda up, keys, slack: shaped.where(F.col(keys).isNotNull()).select(F.explode(keys).alias("key"), F.col("h1").alias("h"), F.lit(up).cast("byte").alias("up"), F.col(slack).alias("slack"))
    keys = of(0, "keys", "slack").union(of(1, "keys_up", "slack_up"))
    common = stash(shaped.select(F.explode("common").alias("key")).distinct(), "common")
    by_key = Window.partitionBy("key")
    rare = keys.join(_sent(common), "key", "left_anti").select("*", F.min("h").over(by_key).alias("lo"), F.max("h").over(by_key).alias("hi"))
    shared = rare.where("lo <> hi").drop("lo", "hi").unionByName(keys.join(_sent(common), "key", "left_semi"))
    rows = stash(shared.distinct(), "met")
    sizes = stash(rows.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"), "sizes")
    sized = rows.join(sizes, "key")
    if clashes.head(1):
        sized = sized.join(clashes.select(F.col("h1").alias("h"), F.lit(True).alias("shared")), "h", "left").withColumn("slack", F.when(F.col("shared"), 0).otherwise(F.col("slack")))
    rarest = Window.partitionBy("h", "up").orderBy(F.desc("size"), F.desc("key"))
    left = stash(sized.withColumn("nth", F.row_number().over(rarest)).where("nth > slack").select("key", "h", "up"), "left")
    again = stash(left.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"), "sizes")
    out = stash(left.join(again, "key"), "buckets")
    forget(common, rows, sizes, left, again)
    return out


def shingle_sets(docs: DataFrame, n: int) -> DataFrame:
    """``h1, h2, shingles`` of the sets of the given texts, each once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, seen = WordHashes(), _Seen()
        for b in slices(batches, "text", 4 << 20):
            new = [(h, s) for s in _shingle_sets(texts(b.column("text")), n, memo) if len(s) and seen.new(h := _set_hash(s))]
            yield pa.RecordBatch.from_arrays([pa.array([h[0] for h, _ in new], pa.int64()), pa.array([h[1] for h, _ in new], pa.int64()), pa.array([s.view(np.int64) for _, s in new], pa.list_(pa.int64()))], names=["h1", "h2", "shingles"])

    return docs.select("text").mapInArrow(run, "h1 long, h2 long, shingles array<long>")


def components(edges: DataFrame) -> DataFrame:
    """``h, root`` for every node of the edges (``a, b``): root is the smallest node that can be reached.

    Alternating large-star and small-star steps on a written edge table until it holds only
    stars; each step is two aggregations and two joins over the links.
    """
    now = stash(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = None
    while True:
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("v"), F.least("a", "m").alias("m"))
        large = both.join(least, F.col("a") == F.col("v")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        small = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "v")
        joined = large.join(small, F.col("a") == F.col("v"))
        new = joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(small.select("v", "m")).distinct()
        before, now = now, stash(new, "edges")
        forget(before)
        mark = now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if mark == state:
            break
        state = mark
    return now.select(F.col("a").alias("h"), F.col("b").alias("root")).union(now.select("b", "b").distinct())


def _verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (``a, b``) whose sets link.  The sets of ``b`` move with their pairs, those of ``a`` once."""
    right = pairs.join(sets.select(F.col("h").alias("b"), F.col("shingles").alias("sb")), "b")
    both = right.join(sets.select(F.col("h").alias("a"), F.col("shingles").alias("sa")), "a")
    inter = F.size(F.array_intersect("sa", "sb"))
    return both.where(den * inter >= num * (F.size("sa") + F.size("sb") - inter)).select("a", "b")


def _most_apart(total: np.ndarray, num: int, den: int) -> np.ndarray:
    """Of the symmetric difference of linked sets with so many shingles together: den * inter >= num * union."""
    return total * (den - num) // (den + num)


def _near(pairs: DataFrame, drawn: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (``a, b``) that sizes and sketches allow to link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            na, nb, ka, kb = (b.column(c).to_numpy() for c in ("na", "nb", "ka", "kb"))
            most, top = _most_apart(na + nb, num, den), np.maximum(ka, kb)
            good = np.zeros(b.num_rows, bool)
            drawn = [b.column(c).to_pylist() for c in ("sa", "ua", "sb", "ub")]
            fits = (np.abs(ka - kb) < 2) & (np.abs(na - nb) <= most)
            for k in np.unique(top[fits]):
                at = np.flatnonzero(fits & (top == k))
                x = np.frombuffer(b"".join(drawn[int(ka[i] != k)][i] for i in at), _U).reshape(len(at), -1)
                y = np.frombuffer(b"".join(drawn[2 + int(kb[i] != k)][i] for i in at), _U).reshape(len(at), -1)
                good[at] = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64) <= most[at]
            yield b.select(["a", "b"]).filter(pa.array(good))

    side = lambda v: drawn.select(F.col("h").alias(v), F.col("n").alias(f"n{v}"), F.col("band").alias(f"k{v}"), F.col("sketch").alias(f"s{v}"), F.col("sketch_up").alias(f"u{v}"))
    return pairs.join(side("b"), "b").join(side("a"), "a").mapInArrow(run, "a long, b long")


def _pairs_within(size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All index pairs ``x < y`` inside consecutive runs of the given sizes."""
    end = np.repeat(np.cumsum(size), size)
    n = end - np.arange(len(end)) - 1
    x = np.repeat(np.arange(len(end)), n)
    return x, x + 1 + np.arange(len(x)) - np.repeat(np.cumsum(n) - n, n)


def _compare(t: pa.Table, num: int, den: int, room: int = 4_000_000) -> pa.Table:
    """The pairs inside equal ``key, i, j`` that sketches and sizes allow to link, roots being different."""
    t = t.sort_by([("key", "ascending"), ("i", "ascending"), ("j", "ascending")])
    key, i, j, h, n, root, mine, up = (t.column(c).to_numpy() for c in ("key", "i", "j", "h", "n", "root", "mine", "up"))
    new = np.concatenate([[True], (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])])
    x, y = _pairs_within(np.diff(np.flatnonzero(new), append=len(key)))
    most = _most_apart(n[x] + n[y], num, den)
    # Two smaller sets of a bucket meet in their own band's scheme.
    keep = (root[x] != root[y]) & (up[x] + up[y] < 2) & (np.abs(n[x] - n[y]) <= most) & ((i == j)[x] | (mine[x] != mine[y]))
    x, y, most = x[keep], y[keep], most[keep]
    sketch = t.column("sketch").to_pylist()
    words = np.array([len(s) // 8 for s in sketch])[x] if len(x) else np.zeros(0, np.int64)
    out = [np.zeros(0, np.int64)]
    for width in np.unique(words):
        of_width = np.flatnonzero(words == width)
        rows, at = np.unique(np.concatenate([x[of_width], y[of_width]]), return_inverse=True)
        table = np.frombuffer(b"".join(sketch[r] for r in rows), _U).reshape(len(rows), width)
        step = max(1, room // int(width))
        for lo in range(0, len(of_width), step):
            some = of_width[lo : lo + step]
            apart = np.bitwise_count(table[at[: len(of_width)][lo : lo + step]] ^ table[at[len(of_width) :][lo : lo + step]]).sum(axis=1, dtype=np.int64)
            out.append(some[apart <= most[some]])
    good = np.concatenate(out)
    pairs = np.unique(np.stack([np.maximum(h[x[good]], h[y[good]]), np.minimum(h[x[good]], h[y[good]])], 1), axis=0)
    return pa.table({"a": pa.array(pairs[:, 0], pa.int64()), "b": pa.array(pairs[:, 1], pa.int64())})


def _cross_pairs(members: DataFrame, drawn: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs of one bucket (``key, h, up, size, root``) in different components whose sketches allow a link.

    Buckets are cut into blocks of about ``BLOCK_ROWS`` members and blocks are compared two by
    two, so that a large bucket spreads over calls; only pairs that pass leave a call.
    """
    cuts = F.ceil(F.col("size") / BLOCK_ROWS).cast("int")
    cut = members.withColumn("mine", F.pmod(F.xxhash64("h"), cuts).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), cuts - 1)))
    cut = stash(cut.select("key", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "h", "up", "root"), "blocks")
    calls = max(1, -(-cut.count() // CALL_ROWS))
    own = F.when(F.col("up") == 0, F.col("sketch")).otherwise(F.col("sketch_up")).alias("sketch")
    with_sketches = cut.join(drawn, "h").select("key", "i", "j", "mine", "h", "up", "root", "n", own, F.pmod(F.xxhash64("key", "i", "j"), F.lit(calls)).alias("call"))
    return with_sketches.groupBy("call").applyInArrow(lambda t: _compare(t, num, den), "a long, b long").distinct()


def jaccard_groups(docs: DataFrame, *, words: int = 5, num: int = 4, den: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id``: groups of documents linked by shingle similarity.

    A document's set holds its distinct runs of ``words`` words (split at blanks, A-Z in lower
    case); with fewer words, the whole sequence is its one shingle.  Two documents link when
    ``den * |intersection| >= num * |union|``; a component is what links reach, named by its
    smallest id.  No link between different sets is lost:

    1. Equal sets are one class from the start, so copies cost nothing further.
    2. Each shingle flips one bit of a set's parity sketch.  Sketches are joined on their
       segments, band by band: linked sets share one, and one of their less common ones
       (``Bands``, ``buckets``).
    3. In each bucket all members are paired with the likeliest centre; pairs that the folded
       sketches allow are verified, and give components.
    4. Pairs of a bucket that are still in different components are compared by their folded
       sketches, and verified where these allow a link; then components are final.

    Sets are named by 128-bit hashes; 64 of these bits go with the segments' keys, where equal
    ones only give more candidates, and sets that meet are numbered.  Null and empty texts have no
    shingles, are linked with nothing and are components by themselves - as is each of several
    equal rows of that kind under their id.  Repeated rows are equal sets.  A row without an id
    is named by its group's smallest id; a set none of whose rows has an id is linked with
    nothing and named null.  Other columns are not read.
    """
    shaped = stash(shapes(docs, words, num, den, id_col=id_col, text_col=text_col), "shapes")
    classes = stash(shaped.select("doc_id", "n_shingles", "h1", "h2"), "classes")
    reps = stash(classes.where("n_shingles > 0").groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")), "reps")
    clashes = stash(reps.groupBy("h1").agg(F.count("*").alias("n")).where("n > 1").select("h1"), "clashes")

    met = buckets(shaped, clashes)
    ids = stash(met.select("h").distinct(), "ids")
    drawn = shaped.where(F.col("sketch").isNotNull()).join(_sent(ids), F.col("h1") == F.col("h"), "left_semi").dropDuplicates(["h1", "h2"])
    numbered = stash(drawn.select("h1", "h2", F.col("n_shingles").alias("n"), "band", "sketch", "sketch_up").withColumn("h", F.monotonically_increasing_id()), "sketches")
    forget(shaped)
    drawn = numbered.drop("h1", "h2")
    names = stash(numbered.select("h", "h1", "h2").join(reps, ["h1", "h2"]).select("h", "h1", "h2", "rep"), "names")
    held = stash(met.withColumnRenamed("h", "h1").join(numbered.select("h", "h1"), "h1").select("key", "h", "up", "size"), "held")

    # The member whose buckets are fullest is the likeliest centre of a bucket.
    weight = held.groupBy("h").agg(F.sum("size").alias("weight"))
    centre = stash(held.join(weight, "h").groupBy("key").agg(F.max(F.struct("weight", "h")).alias("top")).select("key", F.col("top.h").alias("a")), "centres")
    stars = held.join(centre, "key").where("a <> h").select("a", F.col("h").alias("b")).distinct()

    def links(pairs: DataFrame) -> DataFrame:
        pairs = stash(pairs, "pairs")
        ends = stash(pairs.select(F.col("a").alias("h")).union(pairs.select("b")).distinct().join(names, "h"), "ends")
        picked = stash(ends.select("rep").distinct(), "picked")
        given = docs.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(text_col)).alias("text")).join(_sent(picked), F.col("id") == F.col("rep"), "left_semi")
        own = shingle_sets(given, words).join(ends.select("h", "h1", "h2"), ["h1", "h2"]).select("h", "shingles")
        sets = stash(own, "sets")
        out = stash(_verified(pairs, sets, num, den), "links")
        forget(pairs, ends, picked, sets)
        return out

    near = links(_near(stars, drawn, num, den))
    roots = components(near)
    placed = stash(held.join(roots, "h", "left").withColumn("root", F.coalesce("root", "h")), "placed")
    open_keys = stash(placed.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key"), "open")
    more = links(_cross_pairs(placed.join(open_keys, "key"), drawn, num, den))
    final = components(roots.select(F.col("h").alias("a"), F.col("root").alias("b")).union(more))

    named = stash(final.join(names, "h"), "named")
    least = stash(named.groupBy("root").agg(F.min("rep").alias("component_id")), "least")  # written, so that a large component can be split in the join
    linked = named.join(least, "root").select("h1", "h2", "component_id")
    known = reps.join(linked, ["h1", "h2"], "left").where("copies > 1 or component_id is not null").select(F.col("h1").alias("k1"), F.col("h2").alias("k2"), F.coalesce("component_id", "rep").alias("component_id"))
    known = stash(known, "known")  # so that both sides of the join are plain exchanges and a hot class can be split
    forget(reps, clashes, met, ids, numbered, names, held, centre, near, placed, open_keys, more, named, least)
    out = classes.join(known, (F.col("h1") == F.col("k1")) & (F.col("h2") == F.col("k2")) & (F.col("n_shingles") > 0), "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def drop_near_duplicates(docs: DataFrame, *, words: int = 5, num: int = 4, den: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each group, the one with the smallest id.

    Rows are dropped by id: rows without one stay, and repeated rows of the document that stays do too.
    """
    groups = jaccard_groups(docs, words=words, num=num, den=den, id_col=id_col, text_col=text_col)
    return without(docs, groups.where("doc_id <> component_id").select("doc_id"), id_col)
