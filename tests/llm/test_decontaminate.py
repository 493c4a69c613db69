import random
import re

import pytest
from cases import SCHEMA, documents, sentence

from tickframe.llm import decontaminate

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def by_hand(rows, items, window):
    out = []
    for i, text, *_ in rows:
        w = words(text)
        hit, names = set(), set()
        for name, told in items:
            q = words(told)
            n = min(window, len(q))
            grams = {tuple(q[k : k + n]) for k in range(len(q) - n + 1)} if n else set()
            at = [k for k in range(len(w) - n + 1) if tuple(w[k : k + n]) in grams] if n else []
            hit |= {k + j for k in at for j in range(n)}
            names |= {str(name)} if at else set()
        out.append((i, len(w), len(hit), sorted(names)))
    return sorted(out)


@pytest.mark.parametrize(("shard_words", "block_words", "pass_words", "most_terms"), [(1_500_000, 300_000, 4_000_000, 4_000_000), (50, 1, 4_000_000, 0), (50, 20, 100, 0)])
def test_hits_equal_brute_force(spark, monkeypatch, shard_words, block_words, pass_words, most_terms):
    for name, value in (("SHARD_WORDS", shard_words), ("BLOCK_WORDS", block_words), ("PASS_WORDS", pass_words), ("MOST_TERMS", most_terms)):
        monkeypatch.setattr(decontaminate, name, value)
    rng, rows = random.Random(4), documents(8, 60)
    items = [(k, sentence(rng, rng.randint(1, 30))) for k in range(25)] + [(90, None), (91, ""), (92, "?!"), (93, "Alpha1"), (94, "aa aa aa"), (95, "ß é😀")]
    for k in range(40):
        told = words(rng.choice(items)[1])
        cut = rng.randint(0, max(0, len(told) - 1))
        body = f"{sentence(rng, 5)} {', '.join(told[cut : cut + rng.randint(1, 14)]).upper()}. {sentence(rng, 5)}"
        rows.append((2000 + k, body, "en", "s", 0, 0, "", 0, ""))
    rows += [(3000, "aa aa aa aa b aa aa", "en", "s", 0, 0, "", 0, ""), rows[-1], rows[-1]]
    df = spark.createDataFrame(rows, SCHEMA)
    got = decontaminate.contamination(df, spark.createDataFrame(items, "item_id long, text string"))
    want = by_hand(rows, items, 10)
    assert sum(x[2] > 0 for x in want) > 15
    assert sorted((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in got.collect()) == want
    left = decontaminate.drop_contaminated(df, spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(r.doc_id for r in left.select("doc_id").collect()) == sorted(i for i, _, n, _ in want if not n)


def test_empty_sides(spark):
    none, items = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contamination(none, items).count() == 0
    rows = documents(9, 5)
    got = decontaminate.contamination(spark.createDataFrame(rows, SCHEMA), items).collect()
    assert sorted((r.doc_id, r.n_words, r.n_hit) for r in got) == sorted((i, len(words(t)), 0) for i, t, *_ in rows)


def test_proximity_takes_any_order(spark):
    docs = spark.createDataFrame([(1, "zz x1 b c a q"), (2, "a b c"), (3, "a " + "x " * 40 + "b c"), (4, "a b")], "doc_id long, text string")
    got = decontaminate.contamination(docs, spark.createDataFrame([(1, "a b c")], "item_id long, text string"), proximity=5)
    assert {r.doc_id: (r.n_hit, r.n_near) for r in got.collect()} == {1: (0, 1), 2: (3, 0), 3: (0, 0), 4: (0, 0)}


def near_by_hand(text, items, within, window=10):
    w, near, exact = words(text), set(), set()
    for name, told in items:
        q = words(told)
        terms, span, n = set(q), len(q) + within, min(window, len(q))
        if q and any(100 * len(terms & set(w[k : k + span])) >= 80 * len(terms) for k in range(len(w))):
            near.add(name)
        if q and any(w[i : i + n] == q[k : k + n] for k in range(len(q) - n + 1) for i in range(len(w) - n + 1)):
            exact.add(name)
    return len(near - exact)


@pytest.mark.parametrize(("shard_words", "block_words", "pass_words"), [(1_500_000, 300_000, 4_000_000), (120, 30, 150)])
@pytest.mark.parametrize("within", [0, 4, 25])
def test_proximity_equals_brute_force(spark, monkeypatch, shard_words, block_words, pass_words, within):
    monkeypatch.setattr(decontaminate, "SHARD_WORDS", shard_words)
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", block_words)
    monkeypatch.setattr(decontaminate, "PASS_WORDS", pass_words)
    rng = random.Random(6)
    items = [(k, sentence(rng, rng.randint(1, 30))) for k in range(25)] + [(90, None), (91, ""), (94, "aa aa bb cc aa"), (3, sentence(rng, 12))]
    rows = [(1, None), (2, ""), (3, "cc bb"), (4, "aa bb cc aa aa")]
    for k in range(60):
        told = words(rng.choice(items)[1])
        rng.shuffle(told)
        for _ in range(rng.randint(0, 1 + len(told) // 3)):  # words changed or put in
            if told and rng.random() < 0.5:
                told[rng.randrange(len(told))] = "changed"
            else:
                told.insert(rng.randint(0, len(told)), f"more{rng.randint(0, 3)}")
        half = rng.randint(0, len(told))
        rows.append((10 + k, " ".join([sentence(rng, rng.randint(0, 20)), *told, sentence(rng, rng.randint(0, 20))])))
        rows += [(100 + 2 * k, " ".join(told[:half])), (101 + 2 * k, " ".join(told[half:]))]  # neighbours that hold a passage only together
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = {r.doc_id: r.n_near for r in decontaminate.contamination(docs, spark.createDataFrame(items, "item_id long, text string"), proximity=within).collect()}
    want = {i: near_by_hand(t, items, within) for i, t in rows}
    assert sum(n > 0 for n in want.values()) > 15
    assert got == want


def test_reordered_passages_are_dropped(spark):
    passage = sentence(random.Random(2), 20).split()
    edited = [*passage[12:], "and", *passage[5:12], "so", *passage[:5]]
    docs = spark.createDataFrame([(1, "before " + " ".join(edited) + " after"), (2, (" " + "x " * 9).join(passage)), (3, "plain text")], "doc_id long, text string")
    items = spark.createDataFrame([(7, " ".join(passage))], "item_id long, text string")
    assert sorted(r.doc_id for r in decontaminate.drop_contaminated(docs, items, proximity=decontaminate.PROXIMITY).collect()) == [2, 3]
    assert decontaminate.contamination(docs, items, proximity=decontaminate.PROXIMITY).where("doc_id = 1").first().n_hit == 0
