"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearhit.session import ensure_checkpoint_dir, ship_package

#: The six ASCII white-space characters; a word is a run of anything else.
WS = "\t\n\x0b\x0c\r "
_BLANK = re.compile(rb"[\t\n\x0b\x0c\r ]")


def prepare(spark: SparkSession) -> SparkSession:
    """Make the package importable in Python workers."""
    ship_package(spark)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def stash(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` under the shared checkpoint folder and read it back.

    Cuts lineage like ``checkpoint()``, columnar and compressed; a lost
    executor loses nothing. Written on purpose where a result is used twice."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    # the shuffles behind it are spent: Spark drops their files once the JVM has collected their handles
    spark.sparkContext._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an Arrow string/binary column and its row offsets (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type)
                                  else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offs, data = column.buffers()
    width = np.int64 if wide else np.int32
    offsets = np.frombuffer(offs, width)[column.offset:column.offset + len(column) + 1].astype(np.int64) \
        if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


def components(edges: DataFrame, a: str = "a", b: str = "b", tag: str = "cc") -> DataFrame:
    """(node, root) of every node of an undirected edge table; root is the smallest node.

    Alternates large-star and small-star steps (each one grouped minimum and
    one join) until a round leaves the edge set as it was. Every round is
    written to the shared folder, so no round depends on an executor."""
    cur = stash(edges.where(F.col(a) != F.col(b)).select(
        F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), tag)
    seen = None
    while True:
        # large star: every larger neighbour is linked to the smallest node of the neighbourhood
        both = cur.union(cur.select(F.col("v"), F.col("u")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (both.where(F.col("v") > F.col("u")).join(low, "u")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        # small star: the smaller neighbours of a node and the node itself are linked to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        nxt = stash(small.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
                    .union(low.select("u", F.col("m").alias("v"))).distinct(), tag)
        state = nxt.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            return nxt.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen, cur = state, nxt


def give_back() -> None:
    """Hands freed memory of this Python worker back to the system; Spark keeps workers for the tasks of later stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # no such call on this system
        pass


def byte_slices(text: bytes, size: int = 1 << 22):
    """A text in slices of about ``size`` bytes that end with a white-space byte, so that no word is cut."""
    at = 0
    while at < len(text):
        end = at + size
        if end < len(text):
            found = _BLANK.search(text, end)
            end = found.end() if found else len(text)
        yield text[at:end]
        at = end
