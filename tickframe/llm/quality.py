"""Quality rules with host-level verdicts."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..code import share_code
from .shared import MOST_SENT, SPACES, fresh, map_rows, quoted, slices, stash, texts

SYMBOLS = b"#*$%&|<>"
FEATURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long"
#: The rules by name, each with the share of a host's documents that may fail it; the first two are the base rules.
RULES = ("short", "repeats", "symbols", "lines", "lengths")


def _repeat_words(words: list[bytes]) -> int:
    """Words that lie in a 3-word window found twice or more in the text."""
    if len(words) < 4:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    n = len(seen)
    if n < 2_000_000:
        key = (ids[:-2] * n + ids[1:-1]) * n + ids[2:]
    else:  # the product would not fit 63 bits: number the pairs first
        pair = np.unique(ids[:-2] * n + ids[1:-1], return_inverse=True)[1].astype(np.int64)
        key = pair * n + ids[2:]
    order = np.sort(key)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    hit = twice[np.searchsorted(twice, key).clip(max=len(twice) - 1)] == key
    cover = np.zeros(len(words), bool)
    for k in range(3):
        cover[k : k + len(hit)] |= hit
    return int(cover.sum())


def _features(text: bytes) -> tuple[int, ...]:
    words = text.split()
    chars = len(text.decode())
    blanks = len(text) - len(text.translate(None, SPACES))
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    return len(words), chars - blanks, symbols, len(lines) - len(set(lines)), _repeat_words(words), len(lines)


def _fails(words: int, chars: int, symbols: int, dup_lines: int, repeats: int, lines: int) -> tuple[bool, ...]:
    """Which of ``RULES`` a text with these features fails; ``failures`` says the same of columns."""
    return (
        words < 50,
        100 * repeats > 50 * words,
        100 * symbols > 30 * words,
        2 * dup_lines > lines,
        words > 0 and (chars < 2 * words or chars > 50 * words),
    )


def failures() -> list[Column]:
    """``RULES`` over the feature columns: under 50 words; over half of them in repeated 3-word windows; over 30
    symbols for 100 words; over half of the lines repeated; words of under 2 or over 50 characters on average."""
    c = {x.split()[0]: F.col(x.split()[0]) for x in FEATURES.split(", ")}
    return [
        c["n_words"] < 50,
        100 * c["n_repeat_words"] > 50 * c["n_words"],
        100 * c["n_symbols"] > 30 * c["n_words"],
        2 * c["n_dup_lines"] > c["n_lines"],
        (c["n_words"] > 0) & ((c["word_chars"] < 2 * c["n_words"]) | (c["word_chars"] > 50 * c["n_words"])),
    ]


def host_of(docs: DataFrame, host_col: str, url_col: str | None) -> Column:
    """The host of a row: that of its URL in lower case if a URL column is named (null for what is no URL), else ``host_col``."""
    return F.lower(F.try_parse_url(F.col(quoted(url_col)), F.lit("HOST"))) if url_col else F.col(quoted(host_col)).cast("string")


def rule_features(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", url_col: str | None = None) -> DataFrame:
    """``doc_id, source`` and the rule features of each whole text; null and empty texts have none of anything."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            cols = list(zip(*map(_features, texts(b.column("text"))), strict=True))
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("host"), *(pa.array(c, pa.int64()) for c in cols)], names=names)

    names = ["doc_id", "source", *(x.split()[0] for x in FEATURES.split(", "))]
    share_code(docs.sparkSession)
    given = docs.select(F.col(quoted(id_col)).alias("id"), host_of(docs, host_col, url_col).alias("host"), F.col(quoted(text_col)).alias("text"))
    return given.mapInArrow(run, f"doc_id {given.schema[0].dataType.simpleString()}, source string, {FEATURES}")


def host_rates(rows: DataFrame, fails: list[Column]) -> DataFrame:
    """``source, host_rate``: the highest of the shrunk failure rates of each host, over the rules.

    Failures are summed by host and rule.  The hosts' rates under a rule give a beta prior by the
    method of moments (with fewer than two hosts, or no variance, the uniform prior), towards
    which each is shrunk: ``(failed + a) / (documents + a + b)``.
    """
    sums = [F.sum(c.cast("long")).alias(f"f{k}") for k, c in enumerate(fails)]
    hosts = stash(rows.groupBy("source").agg(F.count("*").alias("n"), *sums), "hosts")
    rates = [F.col(f"f{k}") / F.col("n") for k in range(len(fails))]
    count, *moments = hosts.agg(F.count("*"), *(x for r in rates for x in (F.avg(r), F.var_samp(r)))).first()
    shrunk = []
    for k in range(len(fails)):
        m, v = moments[2 * k : 2 * k + 2]
        a, b = 1.0, 1.0
        if count > 1 and v and 0 < m < 1 and v < m * (1 - m):
            s = m * (1 - m) / v - 1
            a, b = m * s, (1 - m) * s
        shrunk.append((F.col(f"f{k}") + a) / (F.col("n") + a + b))
    return stash(hosts.select("source", F.greatest(*shrunk).alias("host_rate")), "hosts")


def _sent(hosts: DataFrame) -> DataFrame:
    return F.broadcast(hosts) if hosts.count() <= MOST_SENT else hosts


def host_quality(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", url_col: str | None = None, host_failure_limit: float = 0.8) -> DataFrame:
    """Rule features of each document, the rules it fails, its host's rate, and the verdict ``kept``.

    A document fails by itself if it fails one of ``RULES`` (see ``failures``; ``base_failed``
    tells of the first two).  A host one of whose shrunk failure rates (see ``host_rates``)
    exceeds ``host_failure_limit`` takes all its documents with it.

    The sums are partial before they are shuffled, so a hot host costs one row a task; hosts meet
    the documents' features again as a written table, broadcast while it is small.  A null host is
    a host of its own; null and empty texts have no words and fail; repeated rows count as often
    as they stand there.  Other columns of ``docs`` are not read and cannot clash.
    """
    rows = stash(rule_features(docs, id_col=id_col, text_col=text_col, host_col=host_col, url_col=url_col), "quality")
    fails = failures()
    hosts = host_rates(rows, fails).withColumnRenamed("source", "of")
    held = rows.join(_sent(hosts), F.col("source").eqNullSafe(F.col("of")))
    named = F.concat_ws(",", *(F.when(f, F.lit(r)) for r, f in zip(RULES, fails, strict=True)))
    kept = (F.col("failed_rules") == "") & (F.col("host_rate") <= host_failure_limit)
    held = held.withColumn("failed_rules", named).withColumn("base_failed", fails[0] | fails[1]).withColumn("kept", kept)
    names = [x.split()[0] for x in FEATURES.split(", ")]
    return held.select("doc_id", *names, "base_failed", "kept", "failed_rules", F.round("host_rate", 6).alias("host_rate"), "source")


def drop_low_quality(docs: DataFrame, *, text_col: str = "text", host_col: str = "source", url_col: str | None = None, host_failure_limit: float = 0.8) -> DataFrame:
    """The rows of ``docs`` that ``host_quality`` would keep, with all their columns.

    The rules run once on each text, and their verdict is written beside the row (without its
    text, if it fails); so no text is shuffled and rows need no key.  Only the rejected hosts are
    joined, on their name.
    """
    from pyspark.sql.types import BooleanType, StringType, StructField, StructType

    host, *marks = (fresh(docs, n) for n in ("host", *(f"fails_{r}" for r in RULES)))
    share_code(docs.sparkSession)
    given = docs.withColumn(host, host_of(docs, host_col, url_col))
    schema = StructType([*docs.schema.fields, StructField(host, StringType()), *(StructField(m, BooleanType()) for m in marks)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, text_col):
            own = texts(b.column(text_col))
            fails = [_fails(*_features(x)) for x in own]
            at = b.schema.get_field_index(text_col)
            left = b.set_column(at, b.schema.field(at), pa.array([None if any(f) else x for x, f in zip(own, fails, strict=True)], pa.binary()).cast(b.schema.field(at).type))
            yield pa.RecordBatch.from_arrays([*left.columns, *(pa.array(c, pa.bool_()) for c in zip(*fails, strict=True))], names=schema.names)

    rows = stash(map_rows(given, run, schema), "judged")
    marked = [F.col(quoted(m)) for m in marks]
    hosts = host_rates(rows.select(F.col(quoted(host)).alias("source"), *marked), marked)
    bad = stash(hosts.where(F.col("host_rate") > host_failure_limit).select(F.col("source").alias(fresh(rows, "bad"))), "bad-hosts")
    good = rows.where(~reduce(or_, marked))
    return good.join(_sent(bad), F.col(quoted(host)).eqNullSafe(F.col(quoted(bad.columns[0]))), "left_anti").select(*(quoted(c) for c in docs.columns))
