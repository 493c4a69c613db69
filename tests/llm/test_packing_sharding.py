import random
import zlib
from collections import Counter, defaultdict

import pytest
from cases import SCHEMA, documents

from tickframe.llm import packing, sharding


@pytest.mark.parametrize("seed", range(30))
def test_each_item_enters_the_tightest_compatible_bin(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 50, 300])
    items = [(rng.randint(1, capacity - 1), [0 if rng.random() < 0.35 else rng.randint(1, 6)] + [100 + rng.randint(0, 5)] * (rng.random() < 0.3)) for _ in range(rng.randint(0, 300))]
    placed, bins = packing.pack_lot(items, capacity), []
    for i in sorted(range(len(items)), key=lambda i: -items[i][0]):
        size, keys = items[i]
        fits = [left for left, held in bins if left >= size and not held & set(keys)]
        if fits:
            left, held = bins[placed[i]]
            assert left == min(fits)
            assert not held & set(keys)
        else:
            assert placed[i] == len(bins)
            bins.append((capacity, set()))
        bins[placed[i]] = (bins[placed[i]][0] - size, bins[placed[i]][1] | set(keys))


@pytest.mark.parametrize("lot_pieces", [20_000, 25])
def test_packed_documents_are_whole_and_without_conflicts(spark, lot_pieces):
    rows = documents(6) + [(800 + k, "same words", "en", "hot", 0, 0, "", 0, "") for k in range(20)]
    rows += [rows[-1]] * 10
    df = spark.createDataFrame(rows, SCHEMA)
    got = packing.pack_documents(packing.word_counts(df), capacity=128, lot_pieces=lot_pieces).collect()
    by_id = {r[0]: r for r in rows}
    copies = Counter(r[0] for r in rows)
    spans, bins = defaultdict(list), defaultdict(list)
    for r in got:
        spans[r.doc_id].append((r.start, r.length))
        if r.bin is not None:
            bins[r.lot, r.bin].append((r.offset, r.length, r.doc_id))
    for i, row in by_id.items():
        n = len((row[1] or "").encode().split())
        pieces = [(k, min(128, n - k)) for k in range(0, n, 128)] or [(0, 0)]
        assert sorted(spans[i]) == sorted(pieces * copies[i])
    for held in bins.values():
        at = 0
        for offset, length, _ in sorted(held):
            assert offset == at
            at += length
        assert at <= 128
        if len(held) > 1:
            assert len({by_id[i][3] for *_, i in held}) == len({by_id[i][1] for *_, i in held}) == len(held)


def test_nothing_to_pack_or_to_shard(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert packing.pack_documents(packing.word_counts(none)).count() == 0
    assert sharding.shard_by_bytes(none).count() == 0


def by_item(sizes, capacity):
    """Plain best-fit-decreasing: what is left in each bin, in the order in which they were opened, and the bin of each item."""
    left, placed = [], []
    for size in sorted(sizes, reverse=True):
        fits = [(room, b) for b, room in enumerate(left) if room >= size]
        if not fits:
            left.append(max(capacity, size))
        b = min(fits)[1] if fits else len(left) - 1
        left[b] -= size
        placed.append((size, b))
    return left, Counter(placed)


@pytest.mark.parametrize("seed", range(40))
def test_classes_are_placed_like_their_items_one_by_one(seed):
    rng = random.Random(seed)
    sizes = [int(rng.paretovariate(1.1) * rng.choice([1, 3, 10])) for _ in range(rng.randint(0, 400))]
    capacity = rng.randint(20, 500)
    classes = list(Counter(sizes).items())
    rng.shuffle(classes)
    runs, n = sharding.best_fit_decreasing(classes, capacity)
    left, placed = by_item(sizes, capacity)
    got = Counter()
    for k, b, many in runs:
        got[classes[k][0], b] += many
    assert (n, got) == (len(left), placed)


def test_more_groups_than_lots_ever_held():
    rng = random.Random(3)
    sizes = [int(rng.lognormvariate(7, 1)) + 1 for _ in range(100_000)]
    classes = list(Counter(sizes).items())
    runs = sharding.pack_into(classes, 16)
    capacity, held, many = Counter(), Counter(), Counter()
    for k, b, n in runs:
        capacity[b] += n * classes[k][0]
        many[k] += n
        held[classes[k][0], b] += n
    assert [many[k] for k in range(len(classes))] == [n for _, n in classes]
    assert max(capacity.values()) - min(capacity.values()) <= 0.001 * max(capacity.values())
    # The same bins as those of the 100,000 items one by one, at the capacity that was found.
    low = max(capacity.values())
    assert by_item_in_few_bins(sizes, low, 16) == held


def by_item_in_few_bins(sizes, capacity, shards):
    left, out = [], Counter()
    for size in sorted(sizes, reverse=True):
        fits = [(room, b) for b, room in enumerate(left) if room >= size]
        if not fits:
            left.append(capacity)
        b = min(fits)[1] if fits else len(left) - 1
        left[b] -= size
        out[size, b] += 1
    assert len(left) <= shards
    return out


def test_free_space_with_many_bins():
    free, rng, plain = sharding.FreeSpace(), random.Random(1), []
    for k in range(6000):
        plain.append((rng.randint(0, 10_000), k))
        free.add(*plain[-1])
        if k % 3 == 0:
            size = rng.randint(0, 10_000)
            want = min((x for x in plain if x[0] >= size), default=None)
            assert free.take_tightest(size) == want
            if want:
                plain.remove(want)


def checked_shards(rows, got, shards):
    text = {r[0]: (r[1] or "").encode() for r in rows}
    size, slots, where = Counter(), defaultdict(list), defaultdict(set)
    for r in got:
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(text[r.doc_id]) + 1, zlib.crc32(text[r.doc_id]), "bytes", None)
        size[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
        where[text[r.doc_id]].add(r.shard)
    assert len(got) == len(rows)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, where.values())) == 1
    groups = Counter()
    for r in rows:
        groups[text[r[0]]] += len(text[r[0]]) + 1
    assert set(size) <= set(range(shards))
    return size, groups, {t: next(iter(s)) for t, s in where.items()}


def test_shards_keep_equal_texts_and_near_equal_bytes(spark):
    rows = documents(7, 400)
    rows += [(7000 + k, f"same length {k:04d}", "en", "s", 0, 0, "", 0, "") for k in range(3000)]  # a class that is split
    df = spark.createDataFrame(rows, SCHEMA)
    got = sharding.shard_by_bytes(df, shards=4).collect()
    size, groups, where = checked_shards(rows, got, 4)
    # The shards hold what plain best-fit-decreasing over the groups puts there.
    runs = sharding.pack_into(sorted(Counter(groups.values()).items(), reverse=True), 4)
    classes = sorted(Counter(groups.values()).items(), reverse=True)
    want = Counter()
    for k, shard, n in runs:
        want[classes[k][0], shard] += n
    assert Counter((groups[t], s) for t, s in where.items()) == want
    largest = max(groups.values())
    rest = sorted(size.values())[:-1] if largest > sum(size.values()) / 4 else sorted(size.values())
    assert rest[-1] - rest[0] <= 0.001 * rest[-1]
    again = sharding.shard_by_bytes(df.repartition(7), shards=4).collect()
    assert sorted(map(tuple, again), key=str) == sorted(map(tuple, got), key=str)


def test_bins_do_not_depend_on_partitions(spark):
    rows = documents(6, 300) + [(5000 + k, "same words", "en", "hot", 0, 0, "", 0, "") for k in range(20)]
    rows += [rows[-1]] * 2500
    df = spark.createDataFrame(rows, SCHEMA)
    got = [sorted(map(str, packing.pack_documents(packing.word_counts(df.coalesce(1) if n == 1 else df.repartition(n)), capacity=128, lot_pieces=400).collect())) for n in (1, 7)]
    assert got[0] == got[1]
    assert len(got[0]) >= len(rows)
