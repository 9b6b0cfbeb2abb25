"""What the corpus operators share: reading tables, checkpoints, connected components, words of an Arrow batch."""

from __future__ import annotations

import ctypes
import sys
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters between words: a word is a longest run of other characters.
BLANKS = " \t\n\x0b\x0c\r"
BETWEEN = "[\\x20\\x09-\\x0D]+"
WORD = "[^\\x20\\x09-\\x0D]+"

#: What workers keep for later tasks, by name: tables that are made again where they are found empty.
_HELD: dict[str, dict | list] = {}

_FREE = np.zeros(256, bool)
_FREE[[0x20, 9, 10, 11, 12, 13]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BACK = np.uint64(pow(int(_BASE), -1, 1 << 64))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where it is unset, as in tests, one of this machine, but never on a cluster."""
    if spark.sparkContext.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            shared = tempfile.mkdtemp(prefix="checkpoints-")
        spark.sparkContext.setCheckpointDir(shared)
    return spark.sparkContext.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the folder of spark.checkpoint.dir, without its lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """cut() for wide tables: a compressed Parquet table in the same folder, which discard() removes."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the store that Spark writes to."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def discard(*tables: DataFrame) -> None:
    """Removes what written() wrote, once nothing reads it any more."""
    for df in tables:
        remove(df.sparkSession, df.written_to)


def _stars(e: DataFrame) -> bool:
    """Whether each end of e (u, v) is either the centre of a star or has one edge to a centre."""
    ends = e.select(F.col("u").alias("x"), F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(e.select(F.col("v").alias("x"), F.lit(0).alias("a"), F.lit(1).alias("b")))
    return ends.groupBy("x").agg(F.sum("a").alias("a"), F.max("b").alias("b")).where("a + b > 1 and a > 0").isEmpty()


def components(edges: DataFrame, a: str, b: str, rounds: int = 60) -> DataFrame:
    """(id, component): for each end of an edge the smallest id that can be reached.

    Alternates large-star and small-star steps until only stars are left, so the number of rounds grows with the logarithm of the longest path; each
    round is cut by a checkpoint. Nothing is gathered on the driver but whether a row is left.
    """
    e = cut(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct())
    for _ in range(rounds):
        if _stars(e):
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        e = cut(small.where("u > v").distinct())
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and where each row starts and ends in them; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None and column.buffers()[2].size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def held(name: str, kept: dict | list) -> dict | list:
    """kept, which a worker empties before a task that doesn't name it."""
    _HELD[name] = kept
    return kept


def let_go(uses: tuple[str, ...] = ()) -> None:
    """Empties what this worker keeps under other names than these."""
    full = [kept for name, kept in _HELD.items() if kept and name not in uses]
    for kept in full:
        kept.clear()
    if full:
        give_back()


def give_back() -> None:
    """Gives freed memory back to the system."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


def tidied(run, *uses: str):
    """run, for mapInArrow, in a worker that holds nothing but what run uses and that gives freed memory back when a task ends.

    Workers are kept for later tasks, of other operators too; so would be all they once needed, one operator's on top of another's.
    """

    def all_(batches):
        let_go(uses)
        try:
            yield from run(batches)
        finally:
            give_back()

    return all_


def slices(offsets: np.ndarray, most: int = 1 << 21, rows: int = 1 << 19):
    """Row ranges of at most so many bytes, or of one longer row, and of at most so many rows."""
    at, n = 0, len(offsets) - 1
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        end = min(end, n, at + rows)
        yield at, end
        at = end


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose output bits look independent."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_KEPT = 1 << 21
_POWERS: list[np.ndarray] = held("powers", [])


def _powers(n: int) -> list[np.ndarray]:
    """Powers 0 to n of _BASE and of its inverse; those for up to 2 MB, 32 MB in all, are kept for the next call."""
    made = lambda m: [np.cumprod(np.concatenate([[np.uint64(1)], np.full(m, of, np.uint64)])) for of in (_BASE, _BACK)]
    if n > _KEPT:
        return made(n)
    if not _POWERS:
        _POWERS.extend(made(_KEPT))
    return _POWERS


def prefix_hash(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums and inverse powers from which span_hash() gets the hash of any span of data."""
    powers, back = _powers(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[: len(data)], out=sums[1:])
    return sums, back


def span_hash(prefix: tuple[np.ndarray, np.ndarray], start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of spans; equal bytes give equal hashes wherever they stand."""
    sums, back = prefix
    return mix((sums[end] - sums[start]) * back[start] + (end - start).astype(np.uint64))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, start and end (in bytes) of each word."""
    inside = np.concatenate([[False], ~_FREE[data], [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edge[::2], edge[1::2]
    inner = offsets[1:-1]
    if len(inner):  # a word can run on over the border of two rows
        k = np.searchsorted(start, inner, "left") - 1
        cross = np.unique(inner[(k >= 0) & (end[np.maximum(k, 0)] > inner)]) if len(start) else inner[:0]
        if len(cross):
            start, end = np.sort(np.concatenate([start, cross])), np.sort(np.concatenate([end, cross]))
    return np.searchsorted(offsets, start, "right") - 1, start, end


def shingles(data: np.ndarray, offsets: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of each run of k words, row by row; a row of fewer words, but one at least, has one run of all of them."""
    row, start, end = words(data, offsets)
    h = span_hash(prefix_hash(data), start, end)
    factor = np.uint64(0x9FB21C651E98DF25)
    n = np.bincount(row, minlength=len(offsets) - 1)
    at = np.zeros(0, np.int64)
    if len(h) >= k:
        at = np.flatnonzero(row[k - 1 :] == row[: len(row) - k + 1])
    whole = len(at) == len(h) - k + 1
    out = np.zeros(len(at), np.uint64)
    for j in range(k):
        out *= factor
        out += h[j : j + len(at)] if whole else h[at + j]
        out = mix(out)
    owner = row[at]
    few = np.flatnonzero((n > 0) & (n < k))
    if len(few):
        first = np.concatenate([[0], np.cumsum(n)])[few]
        some = np.zeros(len(few), np.uint64)
        for j in range(k - 1):
            inside = j < n[few]
            some[inside] = mix(some[inside] * factor + h[first[inside] + j])
        owner, out = np.concatenate([owner, few]), np.concatenate([out, some])
        order = np.argsort(owner, kind="stable")
        owner, out = owner[order], out[order]
    return owner, out
