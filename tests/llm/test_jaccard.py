import random
from collections import defaultdict

import pytest
from cases import SCHEMA, documents, edited, sentence

from tickframe.llm import jaccard

LOWER = {c: c + 32 for c in range(65, 91)}


def groups_by_hand(rows, n, num, den):
    sets = {}
    for i, text, *_ in rows:
        w = (text or "").translate(LOWER).encode().split()
        sets[i] = {tuple(w[j : j + n]) for j in range(max(1, len(w) - n + 1))} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            inter = len(sets[a] & sets[b])
            if sets[a] and sets[b] and den * inter >= num * (len(sets[a]) + len(sets[b]) - inter):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def got(spark, rows, n, num, den):
    found = jaccard.jaccard_groups(spark.createDataFrame(rows, SCHEMA), words=n, num=num, den=den).collect()
    assert len(found) == len(rows)
    return {r.doc_id: (r.n_shingles, r.component_id) for r in found}


@pytest.mark.parametrize(("n", "num", "den", "common"), [(3, 9, 10, 2), (5, 4, 5, 32)])
def test_groups_equal_brute_force(spark, monkeypatch, n, num, den, common):
    monkeypatch.setattr(jaccard, "COMMON", common)
    monkeypatch.setattr(jaccard, "BLOCK_ROWS", 4)
    rng, rows = random.Random(n), documents(n)
    base = sentence(rng, 150)
    # A star: copies link with the base, hardly with each other; chains; and small sets around one difference.
    rows += [(5000 - k, edited(rng, base, 2 if den == 10 else 5) if k else base, "en", "s", 0, 0, "", 0, "") for k in range(40)]
    chain = base
    for k in range(25):
        chain = edited(rng, chain, 1)
        rows.append((6000 + k, chain, "en", "s", 0, 0, "", 0, ""))
    for k in range(60):
        few = [f"w{j}" for j in range(rng.randint(1, 14))]
        if rng.random() < 0.5:
            few.append("end")
        rows.append((7000 + k, " ".join(few), "en", "s", 0, 0, "", 0, ""))
    want = groups_by_hand(rows, n, num, den)
    assert len(rows) > len({c for _, c in want.values()}) > 50
    assert got(spark, rows, n, num, den) == want


def test_nothing_and_only_texts_without_words(spark):
    assert jaccard.jaccard_groups(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(k, t, "en", "s", 0, 0, "", 0, "") for k, t in enumerate([None, "", " ", "\n"])]
    assert got(spark, rows, 3, 9, 10) == {k: (0, k) for k in range(4)}


def test_repeated_rows_are_one_class_and_one_stays(spark):
    text = " ".join(f"w{k}" for k in range(40))
    rows = [(k, t, "en", "s", 0, 0, "", 0, "") for k, t in [(4, text), (4, text), (9, text), (2, "other words stand here alone")]]
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted((r.doc_id, r.component_id) for r in jaccard.jaccard_groups(df).collect()) == [(2, 2), (4, 4), (4, 4), (9, 4)]
    left = jaccard.drop_near_duplicates(df.withColumnRenamed("key", "rep"))
    assert sorted(r.doc_id for r in left.collect()) == [2, 4, 4]


def test_rows_without_an_id(spark):
    text = " ".join(f"w{k}" for k in range(40))
    rows = [(k, t, "en", "s", 0, 0, "", 0, "") for k, t in [(4, text), (None, text), (None, text + " end"), (None, None)]]
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted(map(str, (r.component_id for r in jaccard.jaccard_groups(df).collect()))) == ["4", "4", "None", "None"]
    assert jaccard.drop_near_duplicates(df).count() == 4


def test_bands_hold_every_linking_size():
    for num, den in ((9, 10), (4, 5), (1, 2)):
        bands = jaccard.Bands(num, den)
        for n in range(1, 400):
            for m in range(n, 500):
                if den * n >= num * m:  # the smaller inside the larger
                    assert bands.band(m) - bands.band(n) in (0, 1)
                    most = (n + m) * (den - num) // (den + num)
                    assert most <= bands.limit(bands.band(m))


def test_components_are_the_least_reachable(spark):
    rng = random.Random(5)
    edges = [(rng.randint(-300, 300), rng.randint(-300, 300)) for _ in range(250)] + [(k, k + 1) for k in range(1000, 1200)]
    near = defaultdict(set)
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    want = {}
    for x in sorted(near):
        todo = [x] if x not in want else []
        while todo:
            y = todo.pop()
            if y not in want:
                want[y] = x
                todo += near[y]
    found = {r.h: r.root for r in jaccard.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    alone = {x for x in near if near[x] == {x}}
    assert found == {k: v for k, v in want.items() if k not in alone}
