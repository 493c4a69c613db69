"""What several text operators share: byte-level splitting, hashing and tables in the cluster's shared folder.

Texts reach Python as UTF-8 bytes in Arrow batches.  ``bytes.split()`` without arguments
splits at exactly ``[\\x20\\x09-\\x0D]``, and ``bytes.translate`` lower-cases A-Z only, so
both word definitions used here are single C calls over a whole text.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..code import share_code

SPACES = b" \t\n\x0b\x0c\r"
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Lower-cases A-Z and turns all but ``[0-9a-z]`` and non-ASCII bytes into blanks.
ALNUM = bytes(LOWER[c] if c >= 128 or chr(c).isalnum() else 32 for c in range(256))

#: Small rows that go to the executors at once; a row of an id or a digest takes up to 128 bytes there, so these are 64 MB at most.
MOST_SENT = (64 << 20) // 128

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset, a local session, whose executors are the driver, gets a folder of this
    machine; a cluster must name one.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = f"{tempfile.gettempdir()}/checkpoints/tickframe"
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, deleted when the driver ends."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def stash(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: cuts the lineage and survives lost executors.

    ``forget`` deletes the table before the driver ends.
    """
    spark = df.sparkSession
    share_code(spark)
    path = scratch_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tickframe_path = path
    return out


def forget(*stashed: DataFrame) -> None:
    """Delete stashed tables all of whose readers have been written themselves."""
    for df in stashed:
        _delete(df.sparkSession, df._tickframe_path)
        _written.remove((df.sparkSession, df._tickframe_path))


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            _delete(spark, path)
        except Exception:  # the JVM may be gone already; the folder is scratch space
            return


def texts(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column; null counts as empty."""
    return [b"" if x is None else x for x in column.cast(pa.large_binary()).to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each piece holds about ``most_bytes`` of ``column``; a longer row stands alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        values = batch.column(batch.schema.get_field_index(column)).cast(pa.large_binary())
        ends = np.cumsum(np.fromiter((len(x.as_buffer() or b"") if x.is_valid else 0 for x in values), np.int64, len(values)))
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + most_bytes, "right")))
            yield batch.slice(at, to - at)
            at = to


class WordHashes(dict):
    """64-bit hashes of words, remembered; forgets all once it holds ``most`` words."""

    def __init__(self, most: int = 1_000_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every input bit over a 64-bit hash (wrapping arithmetic)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores more as make it differ from all columns of ``df``."""
    held = {c.lower() for c in df.columns}
    while name.lower() in held:
        name += "_"
    return name


def quoted(name: str) -> str:
    """A column's name for ``F.col``, whatever characters it has."""
    return "`" + name.replace("`", "``") + "`"


def map_rows(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: StructType) -> DataFrame:
    """``mapInArrow`` for columns of any name; Spark itself takes a name with a backtick for syntax."""
    given, made = df.columns, StructType([StructField(f"c{k}", f.dataType) for k, f in enumerate(schema.fields)])

    def renamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in run(pa.RecordBatch.from_arrays(b.columns, names=given) for b in batches):
            yield pa.RecordBatch.from_arrays(b.columns, names=made.names)

    return df.toDF(*(f"c{k}" for k in range(len(given)))).mapInArrow(renamed, made).toDF(*schema.names)


def without(docs: DataFrame, ids: DataFrame, id_col: str = "doc_id", most_sent: int = MOST_SENT) -> DataFrame:
    """``docs`` without the rows whose id stands in the one column of ``ids``.

    ``ids`` is written first and counted: up to ``most_sent`` of them go to the executors
    (64 MB at most), more are joined by shuffling.
    """
    own = fresh(docs, "dropped")
    ids = stash(ids.toDF(own).distinct(), "dropped")
    few = F.broadcast(ids) if ids.count() <= most_sent else ids
    return docs.join(few, F.col(quoted(id_col)) == F.col(own), "left_anti")
