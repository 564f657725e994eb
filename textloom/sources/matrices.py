"""Archives of matrices: many matrices in one binary file, found by an index of `id path:offset` lines.

The index is a table: its lines are dealt to tasks by file and offset, and each task seeks to its
own matrices, so that one large archive is read by many tasks and a few wanted ids read little."""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import file_system

# Fixed values of the format: a binary mark, then a kind, then sizes (each after a byte 4).
_BINARY, _FLOAT, _DOUBLE = b"\0B", b"FM ", b"DM "
_PACKED, _PACKED16, _PACKED8 = b"CM ", b"CM2 ", b"CM3 "
#: A matrix's head, at most.
_HEAD = 32
#: Matrices that a task returns at once, and values of an archive's file, at most.
_ROWS, FILE_VALUES = 64, 1 << 26


def read_matrix(file: pa.NativeFile, offset: int) -> np.ndarray:
    """The matrix at an offset of an open file; also one with values packed in 8 or 16 bits."""
    head = file.read_at(_HEAD, offset)
    if not head.startswith(_BINARY):
        raise ValueError(f"no binary matrix at {offset}")
    kind = head[2 : head.index(b" ", 2) + 1]
    at = 2 + len(kind)
    if kind in (_FLOAT, _DOUBLE):
        four, rows, again, columns = struct.unpack_from("<bibi", head, at)
        if (four, again) != (4, 4) or rows < 0 or columns < 0:
            raise ValueError(f"a broken matrix at {offset}")
        width = 4 if kind == _FLOAT else 8
        data = _exactly(file, rows * columns * width, offset + at + 10)
        return np.frombuffer(data, f"<f{width}").reshape(rows, columns)
    if kind not in (_PACKED, _PACKED16, _PACKED8):
        raise ValueError(f"a matrix of kind {kind!r} at {offset}")
    low, span, rows, columns = struct.unpack_from("<ffii", head, at)
    at += 16
    if kind == _PACKED:
        marks = np.frombuffer(_exactly(file, 8 * columns, offset + at), "<u2").reshape(columns, 4)
        p = low + span * marks.astype(np.float64) / 65535  # least, quarter, three quarters, most of a column
        x = np.frombuffer(_exactly(file, rows * columns, offset + at + 8 * columns), np.uint8).reshape(columns, rows).astype(np.float64)
        p0, p25, p75, p100 = (p[:, k : k + 1] for k in range(4))
        out = np.where(x <= 64, p0 + (p25 - p0) * x / 64, np.where(x <= 192, p25 + (p75 - p25) * (x - 64) / 128, p75 + (p100 - p75) * (x - 192) / 63))
        return out.T
    size, top = (2, 65535) if kind == _PACKED16 else (1, 255)
    x = np.frombuffer(_exactly(file, rows * columns * size, offset + at), f"<u{size}").reshape(rows, columns)
    return low + span * x.astype(np.float64) / top


def _exactly(file: pa.NativeFile, n: int, offset: int) -> bytes:
    data = file.read_at(n, offset)
    if len(data) != n:
        raise ValueError(f"the archive ends within the matrix at {offset}")
    return data


def matrix_index(spark: SparkSession, path: str) -> DataFrame:
    """(id, file, offset) of the lines of an index; a path without offset is a file of one matrix."""
    rows = spark.read.text(path).filter(F.trim("value") != "")
    place = F.trim(F.substr("value", F.instr("value", " ") + 1))
    offset = F.regexp_extract(place, ":([0-9]+)$", 1)
    return rows.select(F.substring_index("value", " ", 1).alias("id"), F.regexp_replace(place, ":[0-9]+$", "").alias("file"), F.when(offset == "", 0).otherwise(offset.cast("long")).alias("offset"))


def read_matrices(index: DataFrame, tasks: int | None = None) -> DataFrame:
    """(id, features: array of rows) of an index (id, file, offset), each task reading neighbouring places."""
    n = tasks or max(index.sparkSession.sparkContext.defaultParallelism, 1) * 4

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, file = None, None
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                part = batch.slice(at, _ROWS)
                found = []
                for here, offset in zip(part.column("file").to_pylist(), part.column("offset").to_pylist(), strict=True):
                    if here != path:
                        store, place = file_system(here)
                        path, file = here, store.open_input_file(place)
                    found.append(read_matrix(file, offset).tolist())
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(found, pa.list_(pa.list_(pa.float64())))], ["id", "features"])

    dealt = index.select("id", "file", "offset").repartitionByRange(n, "file", "offset").sortWithinPartitions("file", "offset")
    return dealt.mapInArrow(read, "id string, features array<array<double>>")


def write_matrices(df: DataFrame, key: str, features: str, folder: str, *, double: bool = False) -> DataFrame:
    """Writes each row's array of rows to archives below folder, each task its own, a new one for each
    FILE_VALUES values; (id, file, offset) of what is written. Each evaluation writes anew: keep the
    result, whose lines are the index. Null features are left out; rows of unlike length are an error."""
    kind, width = (_DOUBLE, 8) if double else (_FLOAT, 4)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, path, at = None, None, 0
        store, root = file_system(folder)
        store.create_dir(root, recursive=True)
        for batch in batches:
            ids, files, places = [], [], []
            for name, matrix in zip(batch.column("id").to_pylist(), batch.column("features").to_pylist(), strict=True):
                if matrix is None:
                    continue
                x = np.array(matrix, f"<f{width}") if matrix else np.zeros((0, 0))
                if x.ndim != 2:
                    raise ValueError(f"{name}: rows of unlike length")
                if out is None or at > FILE_VALUES * width:
                    if out is not None:
                        out.close()
                    path, at = f"{folder.rstrip('/')}/{uuid.uuid4().hex}.ark", 0
                    out = store.open_output_stream(f"{root.rstrip('/')}/{path.rpartition('/')[2]}")
                head = f"{name} ".encode()
                data = _BINARY + kind + struct.pack("<bibi", 4, x.shape[0], 4, x.shape[1]) + x.tobytes()
                ids.append(name), files.append(path), places.append(at + len(head))
                out.write(head + data)
                at += len(head) + len(data)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(files, pa.string()), pa.array(places, pa.int64())], ["id", "file", "offset"])
        if out is not None:
            out.close()

    return df.select(F.col(key).cast("string").alias("id"), F.col(features).cast("array<array<double>>").alias("features")).mapInArrow(write, "id string, file string, offset long")


def write_index(index: DataFrame, path: str) -> None:
    """The lines `id path:offset`."""
    index.select(F.concat("id", F.lit(" "), "file", F.lit(":"), F.col("offset").cast("string")).alias("value")).write.text(path)
