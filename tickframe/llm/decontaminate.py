"""Benchmark decontamination through a distributed positional inverted index."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..code import share_code
from .shared import ALNUM, WordHashes, forget, quoted, slices, stash, texts, without

#: Words of one index shard, about; a longer document has a shard of its own.
SHARD_WORDS = 1_500_000
#: Words of benchmark items that are searched for at once in a worker, and that go to the executors in one pass (8 bytes each).
BLOCK_WORDS = 300_000
PASS_WORDS = 4_000_000
#: Distinct terms whose hashes go to the executors (8 bytes each).
MOST_TERMS = 4_000_000
#: Percent of an item's distinct terms that a proximity match must hold.
NEAR_SHARE = 80
#: Words beyond an item's own number within which a proximity match stands, where proximity is run.
PROXIMITY = 10

_INDEX = "doc_ids array<{id}>, n_words array<bigint>, terms array<bigint>, sizes array<int>, gaps binary"
_FOUND = "doc_id {id}, n_words bigint, hits array<int>, items array<string>, near array<string>, shard bigint, nth int"


def _words(text: bytes) -> list[bytes]:
    return text.translate(ALNUM).split()


def benchmark_words(benchmark: DataFrame) -> DataFrame:
    """``item, n, words``: the hashes of each item's words, as bytes, and their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in slices(batches, "text"):
            found = [hashes.of(_words(x)) for x in texts(b.column("text"))]
            cols = [b.column("item"), pa.array(list(map(len, found)), pa.int64()), pa.array([h.tobytes() for h in found], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["item", "n", "words"])

    return benchmark.mapInArrow(run, "item string, n bigint, words binary")


def benchmark_terms(items: DataFrame) -> DataFrame:
    """The distinct term hashes (``term``) of the items' words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.frombuffer(b"".join(b.column("words").to_pylist()), np.int64)))], names=["term"])

    return items.select("words").mapInArrow(run, "term long").distinct()


def build_index(docs: DataFrame, terms: DataFrame | None, *, window: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Positional postings of the training texts, a row for each shard of whole documents.

    A shard numbers the words of its documents from 0 on, with a gap of ``window`` between two
    documents, so that no window spans them.  ``terms`` are the distinct hashes of its words,
    ``sizes`` the lengths of their posting lists, ``gaps`` all lists in a row, each position as
    its distance from the one before.  With ``terms``, only those are posted: the others can't
    be asked for.
    """
    spark = docs.sparkSession
    known = None
    if terms is not None:
        known = spark.sparkContext.broadcast(np.sort(terms.toArrow().column("term").to_numpy().view(np.uint64)))
    share_code(spark)
    kind = docs.schema[id_col].dataType.simpleString()

    def shard(ids: list, counts: list[int], hashes: list[np.ndarray], id_type: pa.DataType) -> pa.RecordBatch:
        n = np.array(counts, np.int64)
        starts = np.cumsum(n + window) - (n + window)
        h = np.concatenate(hashes)
        pos = np.arange(len(h)) + np.repeat(starts - (np.cumsum(n) - n), n)
        if known is not None:
            at = np.searchsorted(known.value, h).clip(max=max(0, len(known.value) - 1))
            held = known.value[at] == h if len(known.value) else np.zeros(len(h), bool)
            h, pos = h[held], pos[held]
        order = np.argsort(h, kind="stable")
        h, pos = h[order], pos[order]
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
        gaps = np.diff(pos, prepend=0)
        gaps[first] = pos[first]
        row = [pa.array([ids], pa.list_(id_type)), pa.array([n], pa.list_(pa.int64())), pa.array([h[first].view(np.int64)], pa.list_(pa.int64()))]
        row += [pa.array([np.diff(first, append=len(h)).astype(np.int32)], pa.list_(pa.int32())), pa.array([gaps.astype(np.int32).tobytes()])]
        return pa.RecordBatch.from_arrays(row, names=["doc_ids", "n_words", "terms", "sizes", "gaps"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, ids, counts, hashes, held = WordHashes(), [], [], [], 0
        id_type = None
        for b in slices(batches, "text"):
            id_type = b.schema.field("id").type
            for i, text in zip(b.column("id").to_pylist(), texts(b.column("text")), strict=True):
                words = memo.of(_words(text))
                if ids and held + len(words) > SHARD_WORDS:
                    yield shard(ids, counts, hashes, id_type)
                    ids, counts, hashes, held = [], [], [], 0
                ids.append(i)
                counts.append(len(words))
                hashes.append(words)
                held += len(words)
        if ids:
            yield shard(ids, counts, hashes, id_type)

    given = docs.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(text_col)).alias("text"))
    return stash(given.mapInArrow(run, _INDEX.format(id=kind)).withColumn("shard", F.monotonically_increasing_id()), "postings")


class _Windows:
    """The windows of some benchmark items, by length: a row of term hashes for each, and its item."""

    def __init__(self, items: list[tuple[str, np.ndarray]], window: int):
        self.names = [name for name, _ in items]
        by: dict[int, list[tuple[np.ndarray, int]]] = {}
        for k, (_, h) in enumerate(items):
            if len(h):
                n = min(window, len(h))
                by.setdefault(n, []).append((np.lib.stride_tricks.sliding_window_view(h, n), k))
        self.groups = {n: (np.concatenate([w for w, _ in found]), np.repeat([k for _, k in found], [len(w) for w, _ in found])) for n, found in by.items()}


def _search(terms: np.ndarray, sizes: np.ndarray, pos: np.ndarray, windows: _Windows, room: int = 4_000_000) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Exact phrase matches in one shard: where each begins, its length and its item.

    Lists are met from each window's rarest term on: its postings, moved back by its offset,
    are the candidates, and the other lists, shortest first, keep those they hold too.
    """
    none = (np.zeros(0, np.int64),) * 3
    if not len(terms):
        return none
    begin = np.cumsum(sizes, dtype=np.int64) - sizes
    posted = np.repeat(np.arange(len(terms), dtype=np.int64), sizes) << 32 | pos  # sorted
    out = [none]
    for n, (grams, item) in windows.groups.items():
        at = np.searchsorted(terms, grams).clip(max=len(terms) - 1)
        full = np.flatnonzero((terms[at] == grams).all(axis=1))
        at, who = at[full], item[full]
        order = np.argsort(sizes[at], axis=1, kind="stable")
        some = sizes[np.take_along_axis(at, order[:, :1], 1)[:, 0]].astype(np.int64) if len(at) else np.zeros(0, np.int64)
        part = np.cumsum(some) // room
        for lo, hi in ((int(np.searchsorted(part, p)), int(np.searchsorted(part, p, "right"))) for p in np.unique(part)):
            rare, off, n_cand = at[np.arange(lo, hi), order[lo:hi, 0]], order[lo:hi, 0], some[lo:hi]
            gram = np.repeat(np.arange(lo, hi), n_cand)
            inner = np.arange(len(gram)) - np.repeat(np.cumsum(n_cand) - n_cand, n_cand)
            start = pos[begin[np.repeat(rare, n_cand)] + inner] - np.repeat(off, n_cand)
            for k in range(1, n):
                if not len(gram):
                    break
                off = order[gram, k]
                want = at[gram, off] << 32 | (start + off).clip(min=0)
                hit = (start >= 0) & (posted[np.searchsorted(posted, want).clip(max=len(posted) - 1)] == want)
                gram, start = gram[hit], start[hit]
            out.append((start, np.full(len(start), n), who[gram]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    window: int = 10,
    proximity: int | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """For each document ``doc_id, n_words, n_hit, items, n_near``.

    Words are runs of ``[0-9a-z]`` and non-ASCII characters, A-Z in lower case.  An item's
    windows are its runs of ``window`` words; an item of fewer is one window.  ``n_hit`` counts
    the document's words inside exact occurrences of windows, ``items`` lists the items (as
    strings, sorted) with such occurrences.  With ``proximity``, ``n_near`` counts the items
    without one of which ``NEAR_SHARE`` percent of the distinct terms stand in any order within
    so many words of the document as the item has and ``proximity`` more; else it is 0.

    The index of ``build_index`` is written to the shared folder and searched shard by shard,
    each row by itself: nothing is shuffled, and a frequent word or passage only lengthens
    lists inside the shards that hold it.  Benchmark terms filter the postings while there are
    at most ``MOST_TERMS``.  Items go to the executors ``PASS_WORDS`` at a time; a worker searches
    a shard for blocks of ``BLOCK_WORDS`` of them.  A benchmark of more words takes several passes
    over the index, the first of which lists all documents and the others those with matches;
    what they found is then put together by document.

    Null texts have no words, and an item without words matches nothing; repeated rows are
    documents of their own; items with equal names count once.  Other columns are not read.
    """
    if proximity is not None and proximity < 0:
        raise ValueError("proximity must not be negative")
    spark = docs.sparkSession
    share_code(spark)
    told = benchmark.select(F.coalesce(F.col(quoted(item_col)).cast("string"), F.lit("")).alias("item"), F.col(quoted(item_text_col)).alias("text"))
    items = stash(benchmark_words(told).where("n > 0"), "items")
    terms = stash(benchmark_terms(items), "terms")
    index = build_index(docs, terms if terms.count() <= MOST_TERMS else None, window=window, id_col=id_col, text_col=text_col)
    kind = index.schema["doc_ids"].dataType.elementType.simpleString()
    passes = max(1, -(-(items.agg(F.sum("n")).first()[0] or 0) // PASS_WORDS))
    found = None
    for k in range(passes):
        own = items.where(F.pmod(F.xxhash64("item", "words"), F.lit(passes)) == k) if passes > 1 else items
        own = own.select("item", "words").toArrow()
        sent = spark.sparkContext.broadcast(list(zip(own.column("item").to_pylist(), own.column("words").to_pylist(), strict=True)))
        part = index.mapInArrow(_searcher(sent, window, proximity, every=not k), _FOUND.format(id=kind))
        found = found.unionAll(part) if k else part
    if passes > 1:
        together = lambda c: F.array_distinct(F.flatten(F.collect_list(c))).alias(c)
        found = found.groupBy("shard", "nth").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), *(together(c) for c in ("hits", "items", "near")))
    forget(items, terms)
    near = F.size(F.array_except("near", "items")).cast("long")
    return found.select("doc_id", "n_words", F.size("hits").cast("long").alias("n_hit"), F.array_sort("items").alias("items"), near.alias("n_near"))


def _postings(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    terms, sizes = np.array(row["terms"], np.int64).view(np.uint64), np.array(row["sizes"], np.int64)
    steps = np.frombuffer(row["gaps"], np.int32).astype(np.int64)
    if len(steps):
        first = np.cumsum(sizes) - sizes
        total = np.cumsum(steps)
        steps = total - np.repeat(total[first] - steps[first], sizes)
    return terms, sizes, steps


def _searcher(sent, window: int, proximity: int | None, every: bool):
    """For ``mapInArrow`` over index rows: the matches of each document with the items sent, or only of those that have any.

    ``hits`` are positions of words in the document.
    """

    def blocks() -> Iterator[tuple[_Windows, _Bags | None]]:
        some, n = [], 0
        for name, words in sent.value:
            if some and n + len(words) // 8 > BLOCK_WORDS:
                yield _Windows(some, window), None if proximity is None else _Bags(some)
                some, n = [], 0
            some.append((name, np.frombuffer(words, np.uint64)))
            n += len(words) // 8
        if some:
            yield _Windows(some, window), None if proximity is None else _Bags(some)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = list(blocks()) if sum(len(w) for _, w in sent.value) <= 16 * BLOCK_WORDS else None  # made anew for each shard if they are many
        for batch in batches:
            for r in range(batch.num_rows):
                row = batch.slice(r, 1)
                terms, sizes, pos = _postings({c: row.column(c)[0].as_py() if c == "gaps" else row.column(c)[0].values.to_numpy() for c in ("terms", "sizes", "gaps")})
                n_words = row.column("n_words")[0].values.to_numpy()
                begins = np.cumsum(n_words + window) - (n_words + window)
                hits: list[np.ndarray] = []
                items: list[set[str]] = [set() for _ in n_words]
                near: list[set[str]] = [set() for _ in n_words]
                for windows, bags in ready or blocks():
                    start, n, item = _search(terms, sizes, pos, windows)
                    hits += [(start[n == m][:, None] + np.arange(m)).ravel() for m in np.unique(n)]
                    for d, i in np.unique(np.stack([_doc_of(n_words, window, start), item], 1), axis=0).tolist():
                        items[d].add(windows.names[i])
                    for d, i in _near(terms, sizes, pos, n_words, window, bags, proximity) if bags else ():
                        near[d].add(windows.names[i])
                at = np.unique(np.concatenate([np.zeros(0, np.int64), *hits]))
                doc = _doc_of(n_words, window, at)
                cuts = np.searchsorted(doc, np.arange(len(n_words) + 1))
                kept = [d for d in range(len(n_words)) if every or items[d] or near[d]]
                own = [pa.array([at[cuts[d] : cuts[d + 1]] - begins[d] for d in kept], pa.list_(pa.int32()))]
                own += [pa.array([sorted(x[d]) for d in kept], pa.list_(pa.string())) for x in (items, near)]
                ids = row.column("doc_ids")[0].values.take(pa.array(kept, pa.int64()))
                shard = pa.array([row.column("shard")[0].as_py()] * len(kept), pa.int64())
                yield pa.RecordBatch.from_arrays([ids, pa.array(n_words[kept], pa.int64()), *own, shard, pa.array(kept, pa.int32())], names=[x.split()[0] for x in _FOUND.split(", ")])

    return run


def _doc_of(n_words: np.ndarray, window: int, positions: np.ndarray) -> np.ndarray:
    return np.searchsorted(np.cumsum(n_words + window), positions, "right")


class _Bags:
    """The distinct terms of some benchmark items in a row, where each item's begin, and its number of words."""

    def __init__(self, items: list[tuple[str, np.ndarray]]):
        held = [(k, np.unique(h), len(h)) for k, (_, h) in enumerate(items) if len(h)]
        self.item = np.array([k for k, _, _ in held], np.int64)
        self.terms = np.concatenate([np.zeros(0, np.uint64), *(u for _, u, _ in held)])
        self.n = np.array([len(u) for _, u, _ in held], np.int64)
        self.words = np.array([n for _, _, n in held], np.int64)
        self.begin = np.cumsum(self.n) - self.n
        self.need = -(-self.n * NEAR_SHARE // 100)


def _near(terms: np.ndarray, sizes: np.ndarray, pos: np.ndarray, n_words: np.ndarray, window: int, bags: _Bags, within: int) -> list[tuple[int, int]]:
    """Pairs of a document's number and an item's for the proximity matches in one shard.

    Documents that hold enough of an item's terms at all are counted first.  In those, a term
    is in the span that ends at a word from each of its places on until the next one, the
    span's length or the end of the document; a running sum of these intervals gives the terms
    of every span.
    """
    out: list[tuple[int, int]] = []
    if not len(terms) or not len(bags.item):
        return out
    ends = np.cumsum(n_words + window) - window
    doc = np.searchsorted(ends + window, pos, "right")
    begin = np.cumsum(sizes) - sizes
    fresh = np.concatenate([[True], doc[1:] != doc[:-1]])
    fresh[begin[sizes > 0]] = True
    once = doc[fresh]  # the documents of each term, each once
    stop = np.cumsum(np.add.reduceat(fresh, begin))
    start = np.concatenate([[0], stop[:-1]])
    at = np.searchsorted(terms, bags.terms).clip(max=len(terms) - 1)
    held = terms[at] == bags.terms
    for k in np.flatnonzero(np.add.reduceat(held, bags.begin, dtype=np.int64) >= bags.need):
        mine = slice(bags.begin[k], bags.begin[k] + bags.n[k])
        own, need, span = at[mine][held[mine]], bags.need[k], bags.words[k] + within
        able = np.bincount(np.concatenate([once[start[t] : stop[t]] for t in own]), minlength=len(n_words)) >= need
        if not able.any():
            continue
        keys = []
        for t in own:
            p, d = pos[begin[t] : begin[t] + sizes[t]], doc[begin[t] : begin[t] + sizes[t]]
            p, d = p[able[d]], d[able[d]]
            until = np.minimum(p + span, ends[d])
            until[:-1] = np.minimum(until[:-1], p[1:])
            keys += [2 * p + 1, 2 * until]  # at one place, ends come first
        key = np.sort(np.concatenate(keys))
        full = key[np.cumsum(2 * (key & 1) - 1) >= need] >> 1
        out += [(d, int(bags.item[k])) for d in np.unique(np.searchsorted(ends + window, full, "right")).tolist()]
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, *, window: int = 10, proximity: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without those that hold a benchmark window or, with ``proximity``, an item's terms close together; by id: rows without an id stay, and rows that share one go together."""
    found = contamination(docs, benchmark, window=window, proximity=proximity, id_col=id_col, text_col=text_col)
    return without(docs, found.where("n_hit > 0 or n_near > 0").select("doc_id"), id_col)
