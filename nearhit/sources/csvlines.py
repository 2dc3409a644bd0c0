"""Quoted CSV with line breaks inside fields, read by many tasks.

Spark's ``multiLine`` reader takes a file as one task, since a line may begin inside a
quoted field. Here files are read as lines, split like any text, and three steps put the lines together:

1. Each split is walked once for both cases, beginning outside and inside a field. What it does to either case is
   a row of a few flags.
2. The splits of a file, in order, are applied to "outside" one after the other, so every split's real beginning is known,
   and the split where a record that is open there began.
3. Each split is walked again from its real beginning and gives its records. The
   unfinished ends of records that cross splits are joined by (file, split of their first line); only these are shuffled.

``from_csv`` then parses the records as the reader would. Lines are read three times (once in
step 1, twice in step 3) and never shuffled as a whole. What step 2 holds is a narrow row a
split, broadcast to step 3: about 100 bytes for each ``spark.sql.files.maxPartitionBytes`` of input.

Fields open with a quote right after a comma or at the start of a record and close at the next quote that no backslash
escapes; quotes elsewhere are text. A record ends with a line that ends outside; a carriage return before the line
feed belongs to the line's end. Empty records are skipped, and a quote that never closes makes one
record of the rest of its file, both as in the ``multiLine`` reader. Every file begins with a header unless told otherwise.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import groupby

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BODY = re.compile(r'(?:[^"\\]+|\\["\\]?)*+')  # the inside of a quoted field up to its closing quote
OPTIONS = {"sep": ",", "quote": '"', "escape": "\\", "multiLine": "true", "mode": "PERMISSIVE"}
WALK = "file string, block long, ends_inside boolean, ends_inside_if_inside boolean, tail_begins_here boolean"
START = "file string, block long, inside boolean, open_block long"
PART = "file string, block long, key long, first boolean, text string"


def ends_inside(line: str, inside: bool) -> bool:
    """Whether a quoted field is open at the line's end."""
    if not inside and '"' not in line:
        return False
    at, n = 0, len(line)
    while True:
        if inside or line.startswith('"', at):
            at = BODY.match(line, at if inside else at + 1).end()
            if at == n:
                return True
            inside = False  # at the closing quote; what follows it up to the comma is text
        at = line.find(",", at)
        if at < 0:
            return False
        at += 1


def _lines(spark: SparkSession, path) -> DataFrame:
    return spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")


def _by_block(batches: Iterator[pa.RecordBatch]):
    """((file, block, ...), lines) for each split of a task, whose lines come in order and together."""
    def rows():
        for b in batches:
            yield from zip(*(c.to_pylist() for c in b.columns))
    for head, group in groupby(rows(), key=lambda r: r[:-1]):
        yield head, (r[-1] for r in group)


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for (file, block), lines in _by_block(batches):
        out, inn, here = False, True, False
        for line in lines:
            here |= not inn  # a record has ended before this line
            same = out == inn
            out = ends_inside(line, out)
            inn = out if same else ends_inside(line, inn)
        yield _batch([(file, block, out, inn, here)], WALK)


def _starts(pdf: pd.DataFrame) -> pd.DataFrame:
    inside, key, rows = False, None, []
    for s in pdf.sort_values("block").itertuples(index=False):
        rows.append((s.file, s.block, inside, key))
        begins_here = s.tail_begins_here if inside else True
        inside = s.ends_inside_if_inside if inside else s.ends_inside
        key = (s.block if begins_here else key) if inside else None
    return pd.DataFrame(rows, columns=["file", "block", "inside", "open_block"]).astype({"open_block": "Int64"})


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for (file, block, inside, key), lines in _by_block(batches):
        held, done, size, first = [], [], 0, block == 0
        for line in lines:
            held.append(line)
            inside = ends_inside(line, inside)
            if inside:
                continue
            text = "\n".join(held).removesuffix("\r")
            held = []
            if key is not None or text:  # a first record that is empty leaves the header to the next one
                done.append((file, block, key, first, text))
                key, first, size = None, False, size + len(text)
            if size > 1 << 22:
                yield _batch(done, PART)
                done, size = [], 0
        if held:
            done.append((file, block, block if key is None else key, first, "\n".join(held)))
        if done:
            yield _batch(done, PART)


def _batch(rows: list[tuple], ddl: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}
    fields = [f.split() for f in ddl.split(", ")]
    return pa.record_batch([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*rows), fields)], names=[n for n, _ in fields])


def csv_records(spark: SparkSession, path, header: bool = True) -> DataFrame:
    """``(text)``: every record of the files, line breaks inside fields included, headers left out."""
    starts = _lines(spark, path).mapInArrow(_walk, WALK).groupBy("file").applyInPandas(_starts, START)
    state = F.when(F.col("inside").isNull(), F.raise_error("the files were split in another way when they were read again")).otherwise(F.col("inside"))
    lines = (_lines(spark, path).join(F.broadcast(starts), ["file", "block"], "left")
             .select("file", "block", state.alias("inside"), "open_block", "value"))
    parts = lines.mapInArrow(_records, PART)
    whole = parts.where("key IS NULL").select("first", "text")
    pieces = F.array_sort(F.collect_list(F.struct("block", "text")))
    joined = (parts.where("key IS NOT NULL").groupBy("file", "key")
              .agg(F.max("first").alias("first"), F.array_join(F.transform(pieces, lambda p: p["text"]), "\n").alias("text"))
              .select("first", "text"))
    out = whole.unionByName(joined)
    return (out.where(~F.col("first")) if header else out).select("text").where("text <> ''")


def read_csv_split(spark: SparkSession, path, ddl: str, header: bool = True, options: dict | None = None) -> DataFrame:
    """Rows of ``ddl`` from quoted CSV files, as ``spark.read.csv`` with ``multiLine`` gives them, by one task a split."""
    rows = csv_records(spark, path, header).select(F.from_csv("text", ddl, {**OPTIONS, **(options or {})}).alias("_r"))
    return rows.select("_r.*")
