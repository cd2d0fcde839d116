"""What the operators share: the shared folder, Arrow slicing, tokens and hashes."""

from __future__ import annotations

import atexit
import ctypes
import functools
import gc
import shutil
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python worker handles at once.
SLICE_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or a folder of our own where unset and all runs on this machine (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="revlens-")
        atexit.register(shutil.rmtree, found, True)
        spark.sparkContext.setCheckpointDir("file://" + found)
        found = "file://" + found
    return found.rstrip("/")


def fresh_dir(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def local_path(uri: str) -> str:
    """A shared mount's path, for memory maps."""
    if uri.startswith("file:"):
        return "/" + uri[5:].lstrip("/")
    if "://" in uri:
        raise ValueError(f"memory-mapped arrays need spark.checkpoint.dir on a mounted folder, not {uri}")
    return uri


def written(df: DataFrame, tag: str) -> DataFrame:
    """Cut lineage: the rows as a table in the shared folder, which outlives any executor. See discard()."""
    path = fresh_dir(df.sparkSession, tag)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables of written() that nothing reads any more; other tables are left alone."""
    for df in tables:
        if path := getattr(df, "written_to", None):
            jvm = df.sparkSession._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def shuffles_released(spark: SparkSession) -> None:
    """Shuffle files that no query needs any more are deleted now, not when the driver happens to collect its garbage."""
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)


def released() -> None:
    """What this process has freed goes back to the system, where its C library can do that."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass


def lean(f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """f for mapInArrow, so that a worker is released() after each task: workers idle for a minute, else with their tasks' peak."""

    @functools.wraps(f)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from f(batches)
        finally:
            released()

    return run


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, base: str) -> str:
    """A column name that df doesn't have."""
    names = {c.lower() for c in df.columns}
    while base.lower() in names:
        base = "_" + base
    return base


def hash_range(h: Column, n: int) -> Column:
    """The range of a uniform signed 64-bit hash, of n equal ranges in ascending order."""
    top = F.shiftright(h, 32) + F.lit(1 << 31)
    return F.shiftright(top * F.lit(n), 32).cast("int")


def sliced(batches: Iterator[pa.RecordBatch], column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that a slice has at most this many bytes in a string column, or one row."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes)
        start = 0
        while start < n:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + most, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def words(text: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """ASCII white-space tokens of each text: the distinct ones, their codes in order, and each text's offsets.

    A null or blank text has no token.
    """
    lists = pc.ascii_split_whitespace(pc.fill_null(text, ""))
    flat = lists.flatten()
    encoded = pc.dictionary_encode(flat)
    codes = encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64, copy=False)
    offsets = lists.offsets.to_numpy().astype(np.int64)
    offsets = offsets - offsets[0]
    vocabulary = encoded.dictionary.to_pylist()
    if "" in vocabulary:
        keep = codes != vocabulary.index("")
        kept = np.concatenate(([0], np.cumsum(keep)))
        codes, offsets = codes[keep], kept[offsets]
    return vocabulary, codes, offsets


def word_hashes(vocabulary: list[str]) -> np.ndarray:
    h = xxhash.xxh3_64_intdigest
    return np.fromiter((h(w) for w in vocabulary), np.uint64, len(vocabulary))


def mix(a: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads them."""
    a = a.astype(np.uint64, copy=True)
    a ^= a >> np.uint64(33)
    a *= np.uint64(0xFF51AFD7ED558CCD)
    a ^= a >> np.uint64(33)
    a *= np.uint64(0xC4CEB9FE1A85EC53)
    a ^= a >> np.uint64(33)
    return a
