from collections import Counter, defaultdict

import numpy as np
import pytest
from cases import SCHEMA, documents
from pyspark.sql import functions as F

from tickframe.llm import linededup, quality

BLANKS = " \t\n\x0b\x0c\r"
LOWER = {c: c + 32 for c in range(65, 91)}


def key(line):
    return line.strip(BLANKS).translate(LOWER)


def lines_by_hand(rows, min_docs):
    held = defaultdict(list)
    for i, text, *_ in rows:
        for k in {key(x) for x in (text or "").split("\n")}:
            held[k].append(i)
    out = []
    for i, text, *_ in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if not (len(key(x)) >= 20 and len(held[key(x)]) >= min_docs and max(held[key(x)]) != i)]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out)


@pytest.mark.parametrize(("shard_keys", "sent_bytes"), [(250_000, 64 << 20), (3, 1)])
def test_lines_equal_brute_force(spark, monkeypatch, shard_keys, sent_bytes):
    monkeypatch.setattr(linededup, "SHARD_KEYS", shard_keys)
    monkeypatch.setattr(linededup, "CALL_PROBES", 2_000_000 if shard_keys > 3 else 7)
    rows = documents(1)
    rows.append(rows[20])  # a repeated row is one more document
    got = linededup.dedup_lines(spark.createDataFrame(rows, SCHEMA), sent_bytes=sent_bytes)
    assert got.columns == [*(x.split()[0] for x in SCHEMA.split(", ")), "n_lines", "n_dropped", "kept_text"]
    want = lines_by_hand(rows, 3)
    assert sum(x[2] for x in want) > 20
    assert sorted((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in got.collect()) == want


def test_no_documents_and_no_repeated_lines(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert linededup.dedup_lines(none).count() == 0
    one = linededup.dedup_lines(spark.createDataFrame([(1, None)], "doc_id long, text string")).first()
    assert (one.n_lines, one.n_dropped, one.kept_text) == (1, 0, "")


@pytest.mark.parametrize("sent_bytes", [64 << 20, 1])
def test_columns_of_any_name_keep_their_values(spark, sent_bytes):
    line = "a line of more than twenty characters"
    rows = [(k, f"{line}\nown {k}", [9], "h", "g", 1, 2) for k in range(4)] + [(None, line, [8], "h", "g", 1, 2)]
    df = spark.createDataFrame(rows, "doc_id int, text string, `__drop` array<int>, gone string, `odd ``name` string, t1 int, id int")
    got = sorted(linededup.dedup_lines(df, sent_bytes=sent_bytes).collect(), key=lambda r: str(r.doc_id))
    assert [(r.doc_id, r.n_dropped, r.kept_text) for r in got] == [(0, 1, "own 0"), (1, 1, "own 1"), (2, 1, "own 2"), (3, 0, f"{line}\nown 3"), (None, 1, "")]
    assert {tuple(map(str, r[2:7])) for r in got} == {("[9]", "h", "g", "1", "2"), ("[8]", "h", "g", "1", "2")}
    with pytest.raises(TypeError, match="integers"):
        linededup.dedup_lines(spark.createDataFrame([("x", "y")], "doc_id string, text string"))


def test_perfect_hash_is_minimal_and_survives_bytes():
    rng = np.random.default_rng(1)
    h1 = np.unique(rng.integers(0, 1 << 63, 20_000).astype(np.uint64))
    h1[: len(h1) // 2] = h1[0]  # digests that share a half
    h2 = rng.permutation(len(h1)).astype(np.uint64)
    made = linededup.PerfectHash(h1, h2)
    again = linededup.PerfectHash.from_bytes(made.to_bytes())
    for h in (made, again):
        assert sorted(h.place(h1, h2)) == list(range(len(h1)))
    assert linededup.PerfectHash(h1[:0], h2[:0]).place(h1, h2).max() == -1
    with pytest.raises(ValueError, match="differ"):
        linededup.PerfectHash(np.array([3, 3], np.uint64), np.array([4, 4], np.uint64))


def quality_by_hand(rows):
    out = {}
    for i, text, _, source, *_ in rows:
        text = text or ""
        words = [w for w in text.translate({ord(c): " " for c in BLANKS}).split(" ") if w]
        grams = Counter(zip(words, words[1:], words[2:], strict=False))
        cover = {j + k for j in range(len(words) - 2) if grams[tuple(words[j : j + 3])] > 1 for k in range(3)}
        lines = [x for x in text.split("\n") if x.strip(BLANKS)]
        n, chars, symbols, dup = len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines))
        fails = (n < 50, len(cover) / max(1, n) > 0.5, symbols / max(1, n) > 0.3 if n else symbols > 0, dup / max(1, len(lines)) > 0.5, n > 0 and not 2 <= chars / n <= 50)
        out[i] = ((n, chars, symbols, dup, len(cover), len(lines)), fails, source)
    return out


def kept_by_hand(rows):
    """The ids that stay, by every rule and every host's shrunk rates, and the hosts that go."""
    told = quality_by_hand(rows)
    hosts = defaultdict(list)
    for _, fails, source in told.values():
        hosts[source].append(fails)
    worst = dict.fromkeys(hosts, 0.0)
    for k in range(5):
        rates = {h: np.mean([f[k] for f in x]) for h, x in hosts.items()}
        m, v = np.mean(list(rates.values())), np.var(list(rates.values()), ddof=1) if len(rates) > 1 else 0
        s = m * (1 - m) / v - 1 if v > 0 and 0 < m < 1 else 0
        a, b = (m * s, (1 - m) * s) if s > 0 else (1, 1)
        for h, x in hosts.items():
            worst[h] = max(worst[h], (sum(f[k] for f in x) + a) / (len(x) + a + b))
    bad = {h for h, r in worst.items() if r > 0.8}
    return {i for i, (_, fails, source) in told.items() if not any(fails) and source not in bad}, bad, worst


def quality_rows():
    rows = documents(2)
    varied = " ".join(f"w{k}" for k in range(80))
    rows += [(900 + k, "x # <b>\n" * 40 + "y", "en", "s1", 0, 0, "", 0, "") for k in range(3)]
    rows += [(950 + k, "too short", "en", "farm", 0, 0, "", 0, "") for k in range(60)] + [(1010, varied, "en", "farm", 0, 0, "", 0, "")]
    rows += [(1100 + k, varied.replace(" ", " # "), "en", "symbols", 0, 0, "", 0, "") for k in range(40)] + [(1140, varied, "en", "symbols", 0, 0, "", 0, "")]
    rows += [(1200 + k, varied + "\nsame\nsame\nsame\nsame", "en", "lines", 0, 0, "", 0, "") for k in range(2)]
    rows += [(1300, " ".join(f"{k}" for k in range(10)) + " a b c d e f g h i j k l m n o p q r s t u v w x y z A B C D E F G H I J K L M N O P", "en", "lengths", 0, 0, "", 0, "")]
    return rows


def test_quality_equals_brute_force(spark):
    rows = quality_rows()
    df = spark.createDataFrame(rows, SCHEMA)
    want, (stay, bad, worst) = quality_by_hand(rows), kept_by_hand(rows)
    got = {r.doc_id: r for r in quality.host_quality(df).collect()}
    assert got.keys() == want.keys()
    for i, r in got.items():
        features, fails, source = want[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.n_lines) == features
        assert r.failed_rules == ",".join(n for n, f in zip(quality.RULES, fails, strict=True) if f)
        assert (r.base_failed, r.kept, r.source) == (fails[0] or fails[1], i in stay, source)
        assert abs(r.host_rate - worst[source]) < 1e-6
    assert {"farm", "symbols"} <= bad
    assert not got[1010].kept  # clean, but for its host
    assert not got[1140].kept
    assert {n for x in got.values() for n in x.failed_rules.split(",")} >= set(quality.RULES)
    left = quality.drop_low_quality(df.withColumnsRenamed({"key": "bad", "text2": "__bad_source", "h": "host"}))
    assert {"bad", "__bad_source", "host"} <= set(left.columns)
    assert sorted(r.doc_id for r in left.select("doc_id").collect()) == sorted(stay)
    assert sorted((r.doc_id, r.text) for r in left.select("doc_id", "text").collect()) == sorted((r[0], r[1]) for r in rows if r[0] in stay)


def test_hosts_of_urls(spark):
    varied = " ".join(f"w{k}" for k in range(80))
    told = [(k, "short", "https://Farm.example.org:80/a?b#c") for k in range(30)] + [(40, varied, "http://farm.example.org/x"), (41, varied, "https://good.example.net"), (42, varied, "no url"), (43, varied, None)]
    got = {r.doc_id: r for r in quality.host_quality(spark.createDataFrame(told, "doc_id long, text string, url string"), url_col="url").collect()}
    assert [(got[k].source, got[k].kept) for k in (0, 40, 41, 42, 43)] == [("farm.example.org", False), ("farm.example.org", False), ("good.example.net", True), (None, True), (None, True)]


def test_quality_of_nothing(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert quality.host_quality(none).count() == quality.drop_low_quality(none).count() == 0


def test_rows_are_kept_whole_in_large_batches(spark):
    varied = " ".join(f"w{k}" for k in range(400))
    df = spark.range(20_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "short").otherwise(F.concat(F.lit(varied), F.lit(" "), F.col("id").cast("string"))).alias("text"), F.lit("s").alias("source")).coalesce(1)
    got = quality.drop_low_quality(df).agg(F.count("*"), F.sum(F.length("text")), F.sum("doc_id")).first()
    want = df.where("doc_id % 3 <> 0").agg(F.count("*"), F.sum(F.length("text")), F.sum("doc_id")).first()
    assert tuple(got) == tuple(want)
