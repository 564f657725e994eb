"""Best-fit packing of tokenised documents into sequences of fixed length.

Documents become pieces inside Arrow batches. Pieces of full length are sequences by
themselves; the others are dealt into buckets of about `bucket_pieces` by a hash, each
sorted from long to short, and packed online: a fixed number of open bins, found through
a bitset keyed by free space, the fullest of them closing first. A bucket streams
through its task in batches, so memory holds the open bins alone."""

from __future__ import annotations

import base64
import os
import re
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Shelf, arrow_rows

PIECES = "id long, piece int, start long, length long, ids binary"


def default_vocabulary() -> tuple[str, str]:
    """Paths of the byte-level BPE vocabulary, for tokenizers and as ranks for tiktoken."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


#: Runs without white space beyond this length go to the library with the heap-based merge.
_LONG_RUN = re.compile(r"\S{2000}")


@lru_cache(maxsize=4)
def _encoder(json_path: str, ranks_path: str, special_tokens: bool = False):
    """text -> uint32 ids. special_tokens: what the vocabulary adds to its merges (<|endoftext|>)
    is one id where a text spells it, as by tokenizers' default; else it is encoded like other
    text. For the rest both libraries give the same ids from the one vocabulary; the rank-based
    one is four times as fast on ordinary texts."""
    import json

    import public_tokenizers
    import tiktoken

    added = re.compile("(?!)")
    if special_tokens:
        with open(json_path, encoding="utf-8") as f:
            contents = [t["content"] for t in json.load(f).get("added_tokens", [])]
        added = re.compile("|".join(map(re.escape, contents)) or "(?!)")

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    quick = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    slow: list = []

    def encode(text: str) -> np.ndarray:
        if not _LONG_RUN.search(text) and not added.search(text):
            return np.array(quick.encode_ordinary(text), np.uint32)
        if not slow:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            slow.append(Tokenizer.from_file(json_path))
            slow[0].encode_special_tokens = not special_tokens
        return np.array(slow[0].encode(text, add_special_tokens=False).ids, np.uint32)

    return encode


def _pieces(batches, vocabulary: tuple[str, str], size: int, end_id: int, special_tokens: bool):
    encode = _encoder(*vocabulary, special_tokens)
    for batch in batches:
        seen: dict[str, np.ndarray] = {}
        doc, piece, start, ids = [], [], [], []
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            text = text or ""
            if text not in seen:
                seen[text] = np.append(encode(text), np.uint32(end_id)).astype("<u4")
            all_ids = seen[text]
            cuts = [0, *range(len(all_ids) % size or size, len(all_ids), size), len(all_ids)]
            for k, (lo, hi) in enumerate(zip(cuts, cuts[1:], strict=False)):
                doc.append(key)
                piece.append(k)
                start.append(lo)
                ids.append(all_ids[lo:hi].tobytes())
        lengths = [len(x) // 4 for x in ids]
        yield pa.RecordBatch.from_arrays(
            [pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(lengths, pa.int64()), pa.array(ids, pa.binary())],
            ["id", "piece", "start", "length", "ids"],
        )


def pieces(docs: DataFrame, id_col: str, text_col: str, size: int, end_id: int, vocabulary, special_tokens: bool = False) -> DataFrame:
    """(id, piece, start, length, ids: little-endian unsigned 32-bit) of each document: its
    token ids, then end_id, cut into pieces of `size` of which the first may be shorter."""
    arrow_rows(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(partial(_pieces, vocabulary=vocabulary, size=size, end_id=end_id, special_tokens=special_tokens), PIECES)


class OpenBins:
    """Bounded-space best fit: bit f of `free` is set while some open bin has f places
    left; at most `most` bins are open."""

    def __init__(self, size: int, most: int):
        self.size, self.most = size, most
        self.free, self.bins, self.open, self.made = 0, [[] for _ in range(size + 1)], 0, 0

    def place(self, length: int) -> tuple[int, int]:
        """(bin, offset) for a piece: the fullest bin that holds it, else a new one."""
        fits = self.free >> length << length
        if fits:
            left = (fits & -fits).bit_length() - 1
            number = self._take(left)
        else:
            if self.open == self.most:
                self._take((self.free & -self.free).bit_length() - 1)
            left, number = self.size, self.made
            self.made += 1
        if left > length:
            self.bins[left - length].append(number)
            self.free |= 1 << (left - length)
            self.open += 1
        return number, self.size - left

    def _take(self, left: int) -> int:
        number = self.bins[left].pop()
        if not self.bins[left]:
            self.free &= ~(1 << left)
        self.open -= 1
        return number


def _packed(batches, size: int, open_bins: int):
    """Rows sorted by bucket: adds sequence_id and place to each batch as it comes."""
    bucket, bins = None, None
    for batch in batches:
        sequence, offset = [], []
        for b, length in zip(batch.column("bucket").to_pylist(), batch.column("length").to_pylist(), strict=True):
            if b != bucket:
                bucket, bins = b, OpenBins(size, open_bins)
            number, at = bins.place(length)
            sequence.append((b << 32) + number)
            offset.append(at)
        names = [n for n in batch.schema.names if n != "bucket"]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())], [*names, "sequence_id", "offset"])


def best_fit_packing(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, size: int = 1024, end_id: int = 2, open_bins: int = 1024,
    bucket_pieces: int = 2000, vocabulary: tuple[str, str] | None = None, with_ids: bool = False, special_tokens: bool = False,
) -> DataFrame:
    """Returns (doc_id, piece, start, length, ids_crc32, sequence_id, offset) and, with
    with_ids, the token ids (binary, little-endian unsigned 32-bit) of every piece. special_tokens:
    see _encoder().

    Null and empty texts are the single token end_id. Null ids are kept as null. Repeated
    rows are each packed. Other columns are not read. An empty table gives no rows. No
    token is dropped: a sequence's pieces lie gapless from offset 0."""
    shelf = Shelf(docs.sparkSession, "packing")
    cut = pieces(docs, id_col, text_col, size, end_id, vocabulary or default_vocabulary(), special_tokens)
    kept = ["id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), *(["ids"] if with_ids else [])]
    cut = shelf.put(cut.select(F.monotonically_increasing_id().alias("row"), *kept), "pieces")
    short = cut.filter(F.col("length") < size)
    buckets = max(1, short.count() // bucket_pieces)
    dealt = short.withColumn("bucket", F.pmod(F.xxhash64("row"), F.lit(buckets)))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema) + ", sequence_id long, offset long"
    packed = (
        dealt.repartition("bucket").sortWithinPartitions("bucket", F.desc("length"), "row")
        .mapInArrow(partial(_packed, size=size, open_bins=open_bins), schema)
    )
    whole = cut.filter(F.col("length") == size).withColumns({"sequence_id": F.lit(1 << 62) + F.col("row"), "offset": F.lit(0).cast("long")})
    names = ["piece", "start", "length", "ids_crc32", "sequence_id", "offset", *(["ids"] if with_ids else [])]
    return packed.unionByName(whole).select(F.col("id").alias("doc_id"), *names)
