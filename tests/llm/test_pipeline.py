"""The pipeline, and its rows, against plain Python over a small table."""

import random

from cases import SCHEMA, documents, sentence
from test_decontaminate import by_hand as hits_by_hand
from test_jaccard import groups_by_hand
from test_lines_quality import kept_by_hand, lines_by_hand

import corpus_pipeline


def test_stages_equal_brute_force(spark, tmp_path):
    rng, rows = random.Random(12), documents(12)
    items = [(k, sentence(rng, 14)) for k in range(5)]
    rows += [(3000 + k, sentence(rng, 60) + " " + items[k][1], "en", f"s{k}", 0, 0, "", 0, "") for k in range(5)]
    names = [x.split()[0] for x in SCHEMA.split(", ")][:5]
    spark.createDataFrame(rows, SCHEMA).select(names).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    stay, _, _ = kept_by_hand(rows)
    want = [r for r in rows if r[0] in stay]
    kept = {i: t for i, _, _, t in lines_by_hand(want, 3)}
    want = [(r[0], kept[r[0]], *r[2:]) for r in want]
    groups = groups_by_hand(want, 5, 4, 5)
    want = [r for r in want if groups[r[0]][1] == r[0]]
    clean = {i for i, _, n, _ in hits_by_hand(want, items, 10) if not n}
    want = [r for r in want if r[0] in clean]

    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == names
        docs.write.parquet(str(tmp_path / f"{k}-{name}"))
        docs = spark.read.parquet(str(tmp_path / f"{k}-{name}"))
    assert sorted((r.doc_id, r.text, r.n_chars) for r in docs.collect()) == sorted((r[0], r[1], len(r[1])) for r in want)

    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    lengths: dict = {}
    for r in packed:
        lengths[r.doc_id] = lengths.get(r.doc_id, 0) + r.length
    assert lengths == {r[0]: len(r[1].encode().split()) for r in want}
