"""Token counts through a digest cache."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..code import share_code
from .shared import MOST_SENT, quoted, slices, stash

#: Ids that go to the executors at once to pick rows; more are joined by shuffling.
MOST_IDS = MOST_SENT
#: Words whose counts a worker remembers.
MOST_WORDS = 1_200_000
CACHE_SCHEMA = "d1 long, d2 long, tokenizer string, n_tokens long"


def tokenizer_version(path: str) -> str:
    """The digest of the tokenizer's file, and of the rules below by a number."""
    return hashlib.sha256(Path(path).read_bytes()).hexdigest()[:32] + "-1"


class _Counter:
    """Token counts of byte-level BPE texts, equal to the library's ``encode``.

    The pre-tokenizer never joins a space with what stands before it unless that is white
    space too, so a text can be cut before each space that follows a non-space, and each piece
    counts by itself.  Pieces repeat, so their counts are remembered; those that are new are
    encoded by the library, all at once.  Between non-spaces a line break is a piece of its own.
    A special string holds no space, and so lies within a piece.
    """

    DOUBT = re.compile(r"[ \n]\s|\s[ \n]")
    CUT = re.compile(r"(?<=\S)(?= )")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # The cuts hold for this pre-tokenizer and no normalizer; any other tokenizer gets whole texts.
        kind = self.tokenizer.pre_tokenizer
        self.cuts = self.tokenizer.normalizer is None and type(kind).__name__ == "ByteLevel" and not kind.add_prefix_space and getattr(kind, "use_regex", True)
        if self.cuts:
            self.cuts = all(not re.search(r"\s", t.content) and not t.lstrip and not t.rstrip and not t.single_word for t in self.tokenizer.get_added_tokens_decoder().values())
        self.known: dict[str, int] = {}

    def _pieces(self, text: str) -> list[str]:
        if self.DOUBT.search(text) or text[:1].isspace() or text[-1:].isspace():
            return self.CUT.split(text)
        out = []
        for line in text.split("\n"):
            first, *rest = line.split(" ")
            out += ["\n", first]
            out += [" " + x for x in rest]
        return out[1:]

    def counts(self, texts: list[str]) -> list[int]:
        if not self.cuts:
            return [len(x.ids) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        parts = [self._pieces(x) for x in texts]
        new = {p for x in parts for p in x if p not in self.known}
        if len(self.known) + len(new) > MOST_WORDS:
            self.known.clear()
            new = {p for x in parts for p in x}
        new = list(new)
        self.known.update(zip(new, (len(x.ids) for x in self.tokenizer.encode_batch_fast(new, add_special_tokens=False)), strict=True))
        return [sum(map(self.known.__getitem__, x)) for x in parts]


@lru_cache(maxsize=2)
def _counter(path: str) -> _Counter:
    return _Counter(path)


def _read_cache(spark: SparkSession, path: str, version: str) -> DataFrame:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)
    cache = spark.read.schema(CACHE_SCHEMA).parquet(path) if there else spark.createDataFrame([], CACHE_SCHEMA)
    # Two jobs may have appended one digest at the same time; their counts are equal.
    return cache.where(F.col("tokenizer") == version).groupBy("d1", "d2").agg(F.min("n_tokens").alias("n_tokens"))


def _same(rows: DataFrame, ids: DataFrame):
    return (rows["d1"] == ids["d1"]) & (rows["d2"] == ids["d2"]) & rows["doc_id"].eqNullSafe(ids["at"])


def count_tokens(docs: DataFrame, *, tokenizer_path: str, cache_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of each document's whole text.

    A text's digest is 128 bits over its UTF-8 bytes with null as empty: the tokenizer has no
    normalizer, so nothing else may be normalised without changing counts.  The cache maps
    (digest, tokenizer version) to counts.  Digests that it lacks are counted once each, at the
    document with the smallest id that has them, and appended; then all documents get their
    counts by joining digests.  Only digests, ids and counts are shuffled, never texts, while
    either the rows to encode or the rows to leave out number at most ``MOST_IDS``.

    Repeated rows each get their count; rows with one id and different texts do so too; empty
    texts have no tokens.  Other columns are not read.
    """
    spark = docs.sparkSession
    version = tokenizer_version(tokenizer_path)
    share_code(spark)
    given = docs.select(F.col(quoted(id_col)).alias("doc_id"), F.coalesce(F.col(quoted(text_col)), F.lit("")).alias("text"))
    digest = {"d1": F.xxhash64("text"), "d2": F.xxhash64(F.lit(1), "text")}
    rows = stash(given.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), *(v.alias(k) for k, v in digest.items())), "digests")
    lacking = rows.groupBy("d1", "d2").agg(F.min("doc_id").alias("at")).join(_read_cache(spark, cache_path, version), ["d1", "d2"], "left_anti")
    lacking = stash(lacking, "misses")
    misses, total = lacking.count(), rows.count()
    if misses:
        keyed = given.withColumns(digest)
        if misses <= MOST_IDS:
            texts = keyed.join(F.broadcast(lacking), _same(keyed, lacking), "left_semi")
        elif total - misses <= MOST_IDS:
            spare = rows.join(lacking, _same(rows, lacking), "left_anti").select("d1", "d2", F.col("doc_id").alias("at"))
            texts = keyed.join(F.broadcast(spare), _same(keyed, spare), "left_anti")
        else:
            texts = keyed.join(lacking, _same(keyed, lacking), "left_semi")

        def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            counter = _counter(tokenizer_path)
            for b in slices(batches, "text", 2 << 20):
                n = counter.counts(b.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([b.column("d1"), b.column("d2"), pa.array([version] * len(n)), pa.array(n, pa.int64())], names=["d1", "d2", "tokenizer", "n_tokens"])

        texts.select("d1", "d2", "text").mapInArrow(encode, CACHE_SCHEMA).write.mode("append").parquet(cache_path)
    # Written first, so that both sides of the join are plain exchanges and a hot digest can be split.
    out = rows.join(stash(_read_cache(spark, cache_path, version), "counts"), ["d1", "d2"])
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
