"""Shared text helpers: reading the tables, word splitting, rolling hashes in numpy.

Words are maximal runs of anything but the six ASCII white-space characters;
``bytes.split()`` cuts at exactly those, so words are taken from UTF-8 bytes.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WHITE = " \t\n\x0b\x0c\r"
SPACES = np.zeros(256, dtype=bool)
SPACES[[32, 9, 10, 11, 12, 13]] = True
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))

# Hash parameters: fixed odd multipliers, and one random 64-bit value per byte.
_RNG = np.random.default_rng(20240611)
BYTE_CODES = _RNG.integers(1, 1 << 63, size=(2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8(col: str = "text") -> Column:
    """Null-safe UTF-8 bytes of a text column."""
    return F.coalesce(F.col(col), F.lit("")).cast("binary")


def words(text: Column) -> Column:
    """Array of words (JVM side); null text has none."""
    flat = F.translate(F.coalesce(text, F.lit("")), WHITE, " " * len(WHITE))
    return F.filter(F.split(flat, " "), lambda w: w != "")


def unused(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    while name in df.columns:
        name += "_"
    return name


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage into the session's reliable checkpoint folder."""
    from seriescast.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame) -> DataFrame:
    """Cut the lineage with a Parquet table in the session's checkpoint folder: smaller than
    ``checkpoint()`` (columnar, compressed) for large intermediates.  The shuffle files behind it go
    when it is written, the table when the session's file system closes or by ``unwritten``."""
    from seriescast.session import ensure_checkpoint_dir

    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/written-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return spark.read.schema(df.schema).parquet(path)


def unwritten(*tables: DataFrame) -> None:
    """Delete tables of ``written`` that no plan reads any more."""
    for df in tables:
        spark = df.sparkSession
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if not folder.rsplit("/", 1)[1].startswith("written-"):
                raise ValueError(f"not a table of written: {folder}")
            hadoop = spark._jvm.org.apache.hadoop.fs.Path(folder)
            hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


BROADCAST_IDS = 1_000_000


def only_ids(docs: DataFrame, ids: DataFrame, most: int = BROADCAST_IDS) -> DataFrame:
    """The rows of ``docs`` whose ``doc_id`` is in ``ids`` (one column, distinct).  Up to ``most``
    ids (counted first) are broadcast and the texts stay where they are; more are joined
    by shuffling both sides."""
    ids = written(ids.toDF("doc_id"))
    return docs.join(F.broadcast(ids) if ids.count() <= most else ids.hint("merge"), "doc_id", "left_semi")


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser over uint64 (multiply, xor-shift)."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


class Powers:
    """Powers of an odd base and of its inverse modulo 2^64, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inv = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) <= n:
            size = max(n + 1, 2 * len(self.up), 1 << 16)
            for name, b in (("up", self.base), ("down", self.inv)):
                p = np.full(size, b, dtype=np.uint64)
                p[0] = 1
                setattr(self, name, np.multiply.accumulate(p))
        return self.up, self.down


POWERS = tuple(Powers(b) for b in BASES)


class Rolling:
    """Hashes of any slice of a uint64 sequence: prefix sums of code * base^i, shifted back."""

    def __init__(self, codes: np.ndarray, which: int = 0):
        up, self.down = POWERS[which].upto(len(codes) + 1)
        self.sums = np.zeros(len(codes) + 1, dtype=np.uint64)
        np.cumsum(codes * up[: len(codes)], out=self.sums[1:])

    def slices(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start])


def word_bounds(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end offsets of the words of a byte array."""
    gap = np.ones(len(raw) + 2, dtype=np.int8)
    gap[1:-1] = SPACES[raw]
    step = np.diff(gap)
    return np.flatnonzero(step == -1), np.flatnonzero(step == 1)


def word_hashes(raw: np.ndarray, which: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word starts, ends and 64-bit hashes."""
    start, end = word_bounds(raw)
    return start, end, Rolling(BYTE_CODES[which][raw], which).slices(start, end)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every window of ``width`` values (prefix and suffix minima of blocks)."""
    n = len(x)
    if width <= 1 or n < width:
        return x[: max(0, n - width + 1)]
    pad = -n % width
    full = np.concatenate([x, np.full(pad, np.iinfo(x.dtype).max, dtype=x.dtype)]).reshape(-1, width)
    left = np.minimum.accumulate(full, axis=1).ravel()
    right = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - width + 1], left[width - 1: n])


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal true runs."""
    step = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def covered(n: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Flags of the positions inside any of the given ranges."""
    step = np.zeros(n + 1, dtype=np.int64)
    np.add.at(step, start, 1)
    np.add.at(step, end, -1)
    return np.cumsum(step[:n]) > 0


def binary(col: pa.Array) -> Iterator[bytes]:
    """The values of a binary Arrow column, one at a time."""
    for v in col:
        yield v.as_py() or b""


def pieces(batch: pa.RecordBatch, limit: int = 1 << 21, col: str = "raw") -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each piece holds about ``limit`` text bytes (or one longer row)."""
    size = np.asarray(pc.binary_length(batch[col]).fill_null(0))
    at = start = 0
    for i, s in enumerate(size):
        if at and at + s > limit:
            yield batch.slice(start, i - start)
            at, start = 0, i
        at += int(s)
    if len(batch) > start:
        yield batch.slice(start)
