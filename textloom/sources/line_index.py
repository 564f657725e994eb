"""Byte offsets of the lines of text files, and the lines at given offsets.

Each block of a file is read by its own task; where its first line begins is the sum of the bytes
of all lines in the blocks before it. Lines end with a line feed; a carriage return before it is
counted but is not part of the line."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..shared import file_system, kept

#: Bytes between two wanted lines that are read rather than passed over, and bytes read at once.
GAP, SPAN = 64 << 10, 4 << 20
#: Bytes of small blocks that a task reads, where that makes more tasks than a few for each core.
TASK_BYTES = 128 << 20


def _tasks(spark: SparkSession) -> int:
    return max(spark.sparkContext.defaultParallelism, 1) * 4


def line_index(spark: SparkSession, *paths: str, blank: bool = False, block: int | None = None) -> DataFrame:
    """(file, line_no from 0, offset, n_bytes) of the lines of text files, or of the *.txt files below
    folders; n_bytes is without the line's end. blank: lines of white space alone, too. block: so
    many bytes for a block, instead of the session's setting; then a task reads several."""
    reader = spark.read.option("lineSep", "\n").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt")
    name = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)
    if block:
        spark.conf.set(name, str(block))
    try:
        size = F.octet_length("value").cast("long")
        rows = reader.text(list(paths)).select(
            F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), size.alias("size"),
            F.when(F.col("value").endswith("\r"), size - 1).otherwise(size).alias("n_bytes"), (~F.col("value").rlike("[^\\s\\u00A0\\u0099]")).alias("blank"),
        )
        if block:  # a task takes many small blocks
            rows = rows.coalesce(max(_tasks(spark), rows.rdd.getNumPartitions() * block // TASK_BYTES))
        rows = kept(rows, "lines")  # the blocks are those of now
    finally:
        spark.conf.set(name, before)
    sums = rows.groupBy("file", "block").agg(F.sum(F.col("size") + 1).alias("bytes"), F.count("*").alias("n"))
    over = Window.partitionBy("file").orderBy("block")
    starts = sums.select("file", "block", (F.sum("bytes").over(over) - F.col("bytes")).alias("start"), (F.sum("n").over(over) - F.col("n")).alias("first"))
    inside = Window.partitionBy("file", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.withColumn("end", F.sum(F.col("size") + 1).over(inside)).withColumn("place", F.count("*").over(inside))
    out = placed.join(starts, ["file", "block"]).select(
        "file", (F.col("first") + F.col("place") - 1).alias("line_no"), (F.col("start") + F.col("end") - F.col("size") - 1).alias("offset"), "n_bytes", "blank"
    )
    return (out if blank else out.filter(~F.col("blank"))).drop("blank")


def lines_at(index: DataFrame, tasks: int | None = None) -> DataFrame:
    """index (file, offset, n_bytes, and others) with `line`: the text at each place. A task's places are
    neighbours; near ones are read together, bytes that are no UTF-8 are replaced."""
    n = tasks or _tasks(index.sparkSession)
    columns = [f.name for f in index.schema]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in index.schema), "line string"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, file, start, data = None, None, 0, b""
        for batch in batches:
            lines = []
            wanted = list(zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "n_bytes")), strict=True))
            for k, (here, offset, size) in enumerate(wanted):
                if here != path:
                    store, place = file_system(here)
                    path, file, start, data = here, store.open_input_file(place), 0, b""
                if not start <= offset <= offset + size <= start + len(data):
                    end = offset + size
                    for other, at, more in wanted[k + 1 :]:
                        if other != path or at > end + GAP or at + more - offset > SPAN:
                            break
                        end = max(end, at + more)
                    start, data = offset, file.read_at(end - offset, offset)
                    if len(data) < size:
                        raise ValueError(f"{path} ends before {offset + size}")
                lines.append(data[offset - start : offset - start + size].decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(lines, pa.string())], [*columns, "line"])

    return index.repartitionByRange(n, "file", "offset").sortWithinPartitions("file", "offset").mapInArrow(read, schema)
