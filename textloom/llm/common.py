"""What several training-data operators share: tables in the cluster's shared
folder, and numpy hashing of the words of many texts at once."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own_dir: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or where that is
    unset, on a local master alone, a temporary folder that goes with the process. A cluster
    without the setting is an error: its machines would write to folders of their own."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own_dir:
        _own_dir.append(tempfile.mkdtemp(prefix="textloom-"))
        atexit.register(shutil.rmtree, _own_dir[0], ignore_errors=True)
    return _own_dir[0]


class Shelf:
    """Intermediate tables of one operator call, as Parquet in the shared folder.

    A written table cuts the lineage and survives the loss of any executor. codec: that of the
    files, Spark's own where None."""

    def __init__(self, spark: SparkSession, name: str, codec: str | None = None):
        self.spark = spark
        self.codec = codec
        self.root = f"{shared_dir(spark)}/textloom-{name}-{uuid.uuid4().hex}"

    def put(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path, compression=self.codec)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def arrow_rows(spark: SparkSession, rows: int = 500) -> None:
    """Arrow batches of whole texts hold few rows, so that very long texts fit."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


WORD_SEPARATORS = " \t\n\x0b\f\r"


def words_of(text):
    """Column -> array<string>: the words [^\\x20\\x09-\\x0D]+ (null: none)."""
    trimmed = F.btrim(text, F.lit(WORD_SEPARATORS))
    return F.when(F.length(trimmed) > 0, F.split(trimmed, "[\\x20\\x09-\\x0D]+")).otherwise(F.array().cast("array<string>"))


# ---- numpy hashing of words -------------------------------------------------

_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_APART = np.ones(256, bool)
_APART[list(b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")] = False
_APART[128:] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15 | 1
_BLOCK = 1 << 20


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of uint64 that spreads every input bit (murmur's finaliser)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


class WordHasher:
    """64-bit hashes of the words of texts, A-Z lower-cased, by a polynomial in a
    fixed odd base; blocks of about 1 MB bound the memory. plain: ASCII marks part words too."""

    def __init__(self, plain: bool = False):
        self.apart = _APART if plain else _SPACE
        self._grow(64)

    def _grow(self, n: int) -> None:
        powers = np.full(n, _BASE, np.uint64)
        powers[0] = 1
        self.powers = np.multiply.accumulate(powers)

    def _block(self, data: bytes) -> np.ndarray:
        raw = np.frombuffer(data, np.uint8)
        solid = ~self.apart[raw]
        edges = np.flatnonzero(np.diff(solid, prepend=False, append=False))
        if not len(edges):
            return np.zeros(0, np.uint64)
        lengths = edges[1::2] - edges[::2]
        if lengths.max() > len(self.powers):
            self._grow(int(lengths.max()) * 2)
        letters = _LOWER[raw[solid]]
        first = np.cumsum(lengths) - lengths
        place = np.arange(len(letters)) - np.repeat(first, lengths)
        return mix64(np.add.reduceat(self.powers[place] * (letters.astype(np.uint64) + np.uint64(1)), first))

    def words(self, data: bytes) -> np.ndarray:
        """Of one text."""
        if len(data) <= _BLOCK:
            return self._block(data)
        parts, at = [], 0
        while at < len(data):
            end = min(at + _BLOCK, len(data))
            while end < len(data) and not self.apart[data[end]]:
                end += 1
            parts.append(self._block(data[at:end]))
            at = end
        return np.concatenate(parts)

    def many(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Of texts whose total size is moderate: all hashes, and each text's number."""
        joined = b"\n".join(texts)
        raw = np.frombuffer(joined, np.uint8)
        solid = ~self.apart[raw]
        starts = np.flatnonzero(solid[1:] & ~solid[:-1]) + 1
        if len(solid) and solid[0]:
            starts = np.concatenate([[0], starts])
        ends = np.cumsum([len(t) + 1 for t in texts])
        counts = np.diff(np.searchsorted(starts, ends), prepend=0)
        return self._block(joined), counts


def blocks_of(texts: list[bytes], most: int = _BLOCK):
    """(first, last) ranges of texts of about `most` bytes; a longer text is alone."""
    first, size = 0, 0
    for k, t in enumerate(texts):
        if k > first and size + len(t) > most:
            yield first, k
            first, size = k, 0
        size += len(t)
    if first < len(texts):
        yield first, len(texts)


def ngram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n words of one text."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    total = words[: len(words) - n + 1].copy()
    for j in range(1, n):
        total = total * np.uint64(_BASE) + words[j : len(words) - n + 1 + j]
    return mix64(total)


def shingle_set(words: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct hashes of the n-word shingles; with fewer words, the whole
    sequence as one; without words, empty."""
    if not len(words):
        return np.zeros(0, np.uint64)
    if len(words) < n:
        return mix64(ngram_hashes(words, len(words)) + np.uint64(len(words)))
    return np.unique(ngram_hashes(words, n))


#: So many keys of rows to drop are sent to all executors; beyond it the join shuffles.
BROADCAST_ROWS = 1_000_000


def drop_rows(docs: DataFrame, dropped: DataFrame, keys: dict) -> DataFrame:
    """docs without the rows whose keys (column of dropped -> expression over docs) stand in
    dropped; a null equals a null. Rows of docs are not shuffled while dropped is small."""
    dropped = dropped.select(*[F.col(c).alias(f"__drop_{c}") for c in keys]).distinct()
    if dropped.count() <= BROADCAST_ROWS:
        dropped = F.broadcast(dropped)
    on = None
    for c, mine in keys.items():
        same = mine.eqNullSafe(F.col(f"__drop_{c}"))
        on = same if on is None else on & same
    return docs.join(dropped, on, "left_anti")


def lookup_counted(rows: DataFrame, table: DataFrame, keys: list[str], value: str, count: str, total: int, spread: str) -> DataFrame:
    """rows with `value` of the table's row of equal keys (null: none), where many rows may share
    a key. The table has `count`, the number of rows of each key, of `total` in all: keys of more
    than a thousandth, at most 1000, are broadcast; rows that these serve are spread by the column
    `spread` in the join with all others, so that no key gathers many rows in one task."""
    hot = table.filter(F.col(count) * 1000 > total).select(*keys, F.col(value).alias("__hot"))
    cold = table.filter(F.col(count) * 1000 <= total).select(*keys, F.col(value).alias("__cold"), F.lit(0).cast("long").alias("__spread"))
    rows = rows.join(F.broadcast(hot), keys, "left")
    rows = rows.withColumn("__spread", F.when(F.col("__hot").isNotNull(), F.xxhash64(spread)).otherwise(F.lit(0).cast("long")))
    return rows.join(cold, [*keys, "__spread"], "left").withColumn(value, F.coalesce("__hot", "__cold")).drop("__hot", "__cold", "__spread")
