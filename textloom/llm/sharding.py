"""Sharding by histogram sort, with DataFrame functions alone.

Rows are ordered by (md5 of the text, id). Each round counts, in one pre-aggregated pass,
the exact bytes below up to 256 probes inside every open interval; the interval that
holds a splitter's target is probed again, until the splitter meets the tolerance. Then
one exchange deals the rows out. The driver sees (shards - 1) * 256 sums a round at most,
whatever the input; rows that lie in no open interval are left behind after the first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Shelf

KEY_BITS, ID_BITS = 60, 64
FIRST_BITS, NEXT_BITS = 12, 8
_LEAST_LONG = -(1 << 63)


def text_key(text: Column) -> Column:
    """The first 60 bits of the text's md5, so that equal texts lie side by side."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def _digits() -> list[tuple[str, int, int]]:
    """(column, shift, bits) from the most significant digit of (key, id) to the least."""
    cuts = [(0, FIRST_BITS), *((at, NEXT_BITS) for at in range(FIRST_BITS, KEY_BITS, NEXT_BITS))]
    out = [("k1", KEY_BITS - at - bits, bits) for at, bits in cuts]
    return out + [("k2", ID_BITS - at - NEXT_BITS, NEXT_BITS) for at in range(0, ID_BITS, NEXT_BITS)]


def splitters(rows: DataFrame, shards: int, tolerance: int = 0, shelf: Shelf | None = None) -> list[tuple[int, int]]:
    """(k1 long >= 0, k2 long, size long) -> for shard 1, 2, ...: the least (k1, k2) in it.

    A row lies in shard floor(shards * bytes before it / all bytes); a splitter may stand up
    to `tolerance` bytes from that, at 0 it is exact to the row. Rows with one key and id
    stay together. No rows: no splitters."""
    shelf = shelf or Shelf(rows.sparkSession, "shards")
    rows = rows.select("k1", F.col("k2").bitwiseXOR(F.lit(_LEAST_LONG)).alias("k2"), "size")
    total = None
    done: dict[int, tuple[int, int]] = {}
    # Open intervals: prefix (values of k1 and k2 so far) -> (bytes below it, the splitters in it).
    open_: dict[tuple[int, int], tuple[int, list[int]]] = {}
    known1, known2 = 0, 0
    for round_, (column, shift, bits) in enumerate(_digits()):
        digit = F.shiftrightunsigned(column, shift).bitwiseAND(F.lit((1 << bits) - 1))
        prefix1 = F.shiftrightunsigned("k1", KEY_BITS - known1) if known1 else F.lit(0).cast("long")
        prefix2 = F.shiftrightunsigned("k2", ID_BITS - known2) if known2 else F.lit(0).cast("long")
        part = rows.withColumns({"p1": prefix1, "p2": prefix2})
        if round_ > 0:
            keys = F.struct("p1", "p2").isin([F.struct(F.lit(a).alias("p1"), F.lit(b).alias("p2")) for a, b in open_])
            part = part.filter(F.col("p1").isin([a for a, _ in open_]) & keys)
            if round_ == 1:
                rows = shelf.put(part.select("k1", "k2", "size"), "open")
        sums = part.groupBy("p1", "p2", digit.alias("digit")).agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).collect()
        cells: dict[tuple[int, int], list] = {}
        for r in sums:
            cells.setdefault((r["p1"], r["p2"]), []).append((r["digit"], r["bytes"], r["n"]))
        if round_ == 0:
            total = sum(r["bytes"] for r in sums)
            open_ = {(0, 0): (0, list(range(1, shards)))} if sums else {}
        known1, known2 = known1 + bits * (column == "k1"), known2 + bits * (column == "k2")
        next_: dict[tuple[int, int], tuple[int, list[int]]] = {}
        for (p1, p2), (below, which) in open_.items():
            own = sorted(cells[p1, p2])
            for i in which:
                at = below
                for k, (value, size, n) in enumerate(own):
                    here = ((p1 << bits) + value, p2) if column == "k1" else (p1, (p2 << bits) + value)
                    low = (here[0] << (KEY_BITS - known1), here[1] << (ID_BITS - known2))
                    if at * shards >= i * total or (i * total - at * shards) <= tolerance * shards:
                        done[i] = low
                        break
                    last_digit = known2 == ID_BITS
                    if (at + size) * shards > i * total or k == len(own) - 1:
                        if n == 1 or last_digit:  # the row starts before the target: the splitter follows it
                            done[i] = _after(low, known1, known2)
                        else:
                            next_.setdefault(here, (at, []))[1].append(i)
                        break
                    at += size
        open_ = next_
        if not open_:
            break
    shelf.drop("open")
    return [(done[i][0], (done[i][1] ^ (1 << 63)) - (1 << 64) if (done[i][1] ^ (1 << 63)) >= 1 << 63 else done[i][1] ^ (1 << 63)) for i in sorted(done)]


def _after(low: tuple[int, int], known1: int, known2: int) -> tuple[int, int]:
    """The first (k1, k2) beyond the cell that starts at low."""
    if known1 < KEY_BITS or known2 == 0:
        return low[0] + (1 << (KEY_BITS - known1)), 0
    k2 = low[1] + (1 << (ID_BITS - known2))
    return (low[0] + 1, 0) if k2 >> ID_BITS else (low[0], k2)


def shard_of(key: Column, number: Column, cuts: list[tuple[int, int]]) -> Column:
    """How many splitters lie at or before (key, number)."""
    out = F.lit(0)
    for a, b in cuts:
        out = out + ((key > a) | ((key == a) & (number >= F.lit(b)))).cast("int")
    return out


def histogram_shards(rows: DataFrame, key: str, number: str, size: str, shards: int = 40, *, tolerance: int = 0, salts: int = 64) -> DataFrame:
    """rows with the columns shard (0 to shards - 1) and slot (gapless from 0 in each
    shard) more; `key` and `number` (longs, key not negative and not null) give the order,
    `size` the weight. Columns named shard or slot are replaced.

    Shards are runs of the order with equal weight to the row. Within a shard, slots run by
    number mod `salts`, then by the order: so a shard's rows are numbered by many tasks.
    Null numbers come first. Repeated rows stay together. No rows: no rows."""
    shelf = Shelf(rows.sparkSession, "shards")
    kept = [c for c in rows.columns if c not in ("shard", "slot")]
    least = F.coalesce(F.col(number), F.lit(_LEAST_LONG))
    cuts = splitters(rows.select(F.col(key).alias("k1"), least.alias("k2"), F.col(size).alias("size")), shards, tolerance, shelf)
    salt = F.coalesce(F.pmod(F.col(number), F.lit(salts)), F.lit(0)).cast("int")
    dealt = rows.select(F.struct(*kept).alias("row"), F.col(key).alias("k1"), least.alias("k2"), shard_of(F.col(key), least, cuts).alias("shard"), salt.alias("salt"))
    counts = dealt.groupBy("shard", "salt").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("salt")) - F.col("n")
    starts = counts.select("shard", "salt", before.alias("first"))  # shards * salts rows at most
    slot = F.row_number().over(Window.partitionBy("shard", "salt").orderBy("k1", "k2")) - 1
    placed = dealt.withColumn("slot", slot).join(F.broadcast(starts), ["shard", "salt"])
    return placed.select(*[F.col("row")[c].alias(c) for c in kept], "shard", (F.col("slot") + F.col("first")).alias("slot"))


def sized_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size: UTF-8 bytes + 16, text_crc32, key) of each row; null texts as empty."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"), text_key(text).alias("key"),
    )


def shard_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 40, tolerance: int = 0) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) by the law of equal bytes.

    Null texts weigh 16 bytes, null ids come first within their text, an empty table gives
    no rows. A group of equal texts lies in one shard unless a boundary falls inside it,
    where its ids divide it; so no group, however large, unbalances a shard."""
    shelf = Shelf(docs.sparkSession, "sized")
    rows = shelf.put(sized_documents(docs, id_col, text_col), "rows")
    out = histogram_shards(rows, "key", "doc_id", "size", shards, tolerance=tolerance)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", shards: int = 40) -> None:
    """Writes docs, all columns, as Parquet in one folder `shard=N` for each shard."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    cuts = splitters(docs.select(text_key(text).alias("k1"), F.coalesce(F.col(id_col).cast("long"), F.lit(_LEAST_LONG)).alias("k2"), (F.octet_length(text) + 16).cast("long").alias("size")), shards)
    shard = shard_of(text_key(text), F.coalesce(F.col(id_col).cast("long"), F.lit(_LEAST_LONG)), cuts)
    docs.withColumn("shard", shard).repartition("shard").write.partitionBy("shard").parquet(path)
