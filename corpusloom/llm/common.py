"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A-Z to a-z and nothing else, for bytes.translate
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")

#: the six characters that separate words
SPACES = " \t\n\x0b\x0c\r"


def encode(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text, as UTF-8; none for null."""
    return encode(text).split()


def lower_words(text: str | None) -> list[bytes]:
    """As ``words``, with A-Z lower-cased."""
    return encode(text).translate(LOWER).split()


#: Spark then deletes a query's shuffle files when the query has ended
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where the session names none, one of our own on a single machine, an error on a cluster."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = tempfile.mkdtemp(prefix="corpusloom-")
        atexit.register(shutil.rmtree, path, True)
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def settle(df: DataFrame) -> DataFrame:
    """Cut the lineage: write to a table in the shared folder and read it back. Shuffle files of the way there go at its end."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/settled-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.select("*").write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
        trim()
    return spark.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Delete the files of a settled table that no later step reads."""
    spark = df.sparkSession
    for file in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(file)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def trim() -> None:
    """Give what this process has freed back to the system: a worker serves the next task too, and the driver all steps."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run over batches, with ``trim`` at its end."""

    def tidied(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            trim()

    return tidied


def tidy_group(run: Callable) -> Callable:
    """run over the rows of a group, with ``trim`` at its end."""

    def tidied(rows):
        try:
            return run(rows)
        finally:
            trim()

    return tidied


def tidy_pair(run: Callable) -> Callable:
    """run over the rows of a group from two tables, with ``trim`` at its end."""

    def tidied(left, right):
        try:
            return run(left, right)
        finally:
            trim()

    return tidied


def pack(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(1).compress(x.tobytes())


def unpack(x: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(x), kind)


def pack_sorted(x: np.ndarray) -> bytes:
    """Sorted 64-bit numbers as differences, byte by byte: the high bytes are mostly 0."""
    gaps = np.diff(x, prepend=np.uint64(0))
    return pack(gaps.view(np.uint8).reshape(-1, 8).T)


def unpack_sorted(x: bytes) -> np.ndarray:
    planes = unpack(x, "u1").reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<u8").ravel().cumsum(dtype=np.uint64)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the table doesn't have, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"{name}_"
    return name


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; null for a null id."""
    return F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % n


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
