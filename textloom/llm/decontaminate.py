"""Benchmark decontamination: rare word-pair seeds join passages to test items, then
Smith-Waterman alignment scores paraphrased or edited copies.

A seed is two words of an item, one or two places apart, that stand one or two places
apart in a document. Between two matched words of an alignment that are no seed lie two
errors or more, which cost what a match gains: an alignment never scores more than the words
that its seeds cover, so one that reaches LEAST_SCORE of an item of n words covers at least
LEAST_SCORE * n words of the item by seeds within a bounded stretch of the document.

Only rare seeds look for items. Of each item the most frequent seeds of the benchmark are left
out of the index, as many as cover at most LEAST_SCORE * n - RARE_WORDS words together: whatever
reaches the score covers RARE_WORDS words at least by the others. Documents and items that share
so many rare seeds are held against each other by all seeds, and aligned where these cover
enough. So no pair that can reach the score is left out, and a phrase that many items share
brings nothing together.

Seeds go to the tasks in blocks of items of a fixed size, one block after the other, so a benchmark
of any size is searched against all documents without shuffling them, and the driver holds one
block."""

from __future__ import annotations

from functools import partial
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Shelf, WordHasher, arrow_rows, blocks_of, ngram_hashes

#: Items with fewer words are copied only by a document that has these words and no others.
LEAST_WORDS = 4
#: Words of an item that rare seeds of an alignment cover at least (fewer where the item is short).
RARE_WORDS = 7
MATCH, MISMATCH, GAP = 2, -1, -1
LEAST_SCORE = 0.45
#: Characters of test items that one block holds.
BLOCK_CHARS = 16_000_000
#: Places of items that are looked at in one go, and bits of the table that counts them.
PLACES, TABLE_BITS = 1_000_000, 22
_SPREAD = 0x9E3779B97F4A7C15


def local_alignment(item: np.ndarray, window: np.ndarray) -> int:
    """The best Smith-Waterman score of two runs of word hashes with linear gaps."""
    steps = np.arange(len(window) + 1) * -GAP
    row = np.zeros(len(window) + 1, np.int64)
    best = 0
    for word in item:
        new = np.zeros_like(row)
        new[1:] = np.maximum(np.maximum(row[:-1] + np.where(window == word, MATCH, MISMATCH), row[1:] + GAP), 0)
        new = np.maximum.accumulate(new + steps) - steps
        row = np.maximum(new, 0)
        best = max(best, int(row.max()))
    return best


def pair_hashes(words: np.ndarray, apart: int) -> np.ndarray:
    """Hash of each word with the one `apart` places on."""
    if apart == 1:
        return ngram_hashes(words, 2)
    return ngram_hashes(np.stack([words[:-apart], words[apart:]], 1).ravel(), 2)[::2] if len(words) > apart else words[:0]


def whole_hash(words: np.ndarray) -> tuple[int, int]:
    """(number of words, hash of them all)."""
    return len(words), int(ngram_hashes(words, len(words))[0])


class Items:
    """Test items of one block: their words, the places of their seeds in order, and the index of rare ones."""

    def __init__(self, rows: list[tuple[int, str]]):
        hasher = WordHasher(plain=True)
        split = [(r[0], hasher.words((r[1] or "").encode())) for r in rows]
        #: Items of few words: a hash of them all -> ids.
        self.short: dict[tuple[int, int], list[int]] = {}
        for i, w in split:
            if 0 < len(w) < LEAST_WORDS:
                self.short.setdefault(whole_hash(w), []).append(i)
        split = [(i, w) for i, w in split if len(w) >= LEAST_WORDS]
        self.ids, self.words = [i for i, _ in split], [w for _, w in split]
        sizes = np.array([len(w) for w in self.words], np.int64)
        #: Words of the item that seeds of an alignment of LEAST_SCORE cover at least, and words of a document that it spans at most.
        self.least = np.maximum(2, np.ceil(LEAST_SCORE * sizes - 1e-9)).astype(np.int64)
        self.rare = np.minimum(RARE_WORDS, self.least)
        #: Gaps of an alignment of LEAST_SCORE, at most.
        self.drift = np.ceil((2 - 2 * LEAST_SCORE) * sizes).astype(np.int64)
        self.longest = int(sizes.max(initial=0)) + 1
        self.span = np.ceil((3 - 2 * LEAST_SCORE) * sizes).astype(np.int64)
        seeds = [pair_hashes(w, apart) for w in self.words for apart in (1, 2)]
        every = np.concatenate([*seeds, np.zeros(0, np.uint64)])
        owner = np.repeat(np.repeat(np.arange(len(split)), 2), [len(s) for s in seeds])
        place = np.concatenate([*(np.arange(len(s)) for s in seeds), np.zeros(0, np.int64)])
        apart = np.concatenate([*(np.full(len(s), 1 + k % 2) for k, s in enumerate(seeds)), np.zeros(0, np.int64)])
        #: All seeds by item.
        self.all_seeds, self.all_places, self.all_aparts = every, place, apart
        self.bounds = np.searchsorted(owner, np.arange(len(split) + 1))
        kept = self._rare(every, place, apart)
        every, owner, place, apart = every[kept], owner[kept], place[kept], apart[kept]
        order = np.lexsort((place, owner, every))
        self.seeds, first = np.unique(every[order], return_index=True)
        self.first = np.append(first, len(order))
        self.owner, self.place, self.apart = owner[order], place[order], apart[order]
        self.mask = np.uint64((1 << max(20, (16 * len(self.seeds)).bit_length())) - 1)
        self.filter = np.zeros(int(self.mask) + 1, bool)
        self.filter[(self.seeds & self.mask).astype(np.int64)] = True

    def _rare(self, every: np.ndarray, place: np.ndarray, apart: np.ndarray) -> np.ndarray:
        """Whether each seed is in the index: of each item, all but the most frequent that cover at most
        least - rare words. A seed is as frequent as the benchmark has it, of equals as its words are."""
        _, number, held = np.unique(every, return_inverse=True, return_counts=True)
        _, word, many = np.unique(np.concatenate([*self.words, np.zeros(0, np.uint64)]), return_inverse=True, return_counts=True)
        common = np.log(many)[word]
        begin = np.cumsum([0, *map(len, self.words)])
        kept = np.ones(len(every), bool)
        for k, (lo, hi) in enumerate(zip(self.bounds[:-1], self.bounds[1:], strict=True)):
            free = int(self.least[k] - self.rare[k])
            if free < 2:
                continue
            at = begin[k] + place[lo:hi]
            order = np.lexsort((-(common[at] + common[at + apart[lo:hi]]), -held[number[lo:hi]]))
            by_seed: dict[int, list[int]] = {}
            for j in order:  # places of one seed go together
                by_seed.setdefault(int(number[lo + j]), []).append(int(j))
            covered: set[int] = set()
            for places in by_seed.values():
                more = covered | {w for j in places for w in (int(place[lo + j]), int(place[lo + j] + apart[lo + j]))}
                if len(more) <= free:
                    covered = more
                    kept[lo + np.array(places)] = False
        return kept

    def hits(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places in grams, numbers of the rare seeds there)."""
        at = np.flatnonzero(self.filter[(grams & self.mask).astype(np.int64)])
        if not len(at) or not len(self.seeds):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        number = np.minimum(np.searchsorted(self.seeds, grams[at]), len(self.seeds) - 1)
        right = self.seeds[number] == grams[at]
        return at[right], number[right]

    def _covered(self, pair: np.ndarray, item: np.ndarray, where: np.ndarray, first: np.ndarray, apart: np.ndarray, n: int) -> np.ndarray:
        """Of each of n pairs, the most words of the item that seeds of like drift cover. A seed's drift is
        its place in the document less that in the item; along an alignment it changes by gaps alone,
        so it stays within twice as wide a range as there are gaps at most, one of which is looked at."""
        width = self.drift[item]
        bucket = (where - first + self.longest) // width + 1
        buckets = int(bucket.max(initial=0)) + 1
        one = (pair * buckets + bucket) * self.longest + first
        every = np.concatenate([one, one + apart])
        every = np.unique(np.concatenate([every, every - self.longest])) // self.longest  # each in its range and the one before
        key, words = np.unique(every, return_counts=True)
        out = np.zeros(n, np.int64)
        np.maximum.at(out, key // buckets, words)
        return out

    def candidates(self, pairs: list[np.ndarray], doc: np.ndarray):
        """Yields (document, item) of those whose common rare seeds cover enough words of the item."""
        found = []
        for apart, grams in enumerate(pairs, 1):
            at, number = self.hits(grams)
            inside = doc[at] == doc[at + apart]
            found.append((at[inside], number[inside]))
        at, number = (np.concatenate(c) for c in zip(*found, strict=True))
        order = np.argsort(doc[at], kind="stable")
        at, number = at[order], number[order]
        many = self.first[number + 1] - self.first[number]
        total, ends = np.cumsum(many), np.append(np.flatnonzero(np.diff(doc[at])) + 1, len(at))
        lo = 0
        while lo < len(at):
            # Whole documents, as many as have PLACES places together, at least one.
            most = np.searchsorted(total, (total[lo - 1] if lo else 0) + PLACES, "right")
            hi = int(ends[max(np.searchsorted(ends, most, "right") - 1, np.searchsorted(ends, lo, "right"))])
            n = many[lo:hi]
            where = np.repeat(at[lo:hi], n)
            row = np.repeat(self.first[number[lo:hi]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            item = self.owner[row]
            # Pairs with too few seeds of like drift, of two words each, go at once: the counts are at least the true ones.
            cell = (doc[where] * len(self.ids) + item).astype(np.uint64) * np.uint64(1 << 20) + ((where - self.place[row] + self.longest) // self.drift[item]).astype(np.uint64)
            before, here, after = (((cell + np.uint64(k)) * np.uint64(_SPREAD)) >> np.uint64(64 - TABLE_BITS) for k in (0, 1, 2))
            count = np.bincount(here.astype(np.int64), minlength=1 << TABLE_BITS)
            near = count[here.astype(np.int64)] + np.maximum(count[before.astype(np.int64)], count[after.astype(np.int64)])
            enough = 2 * near >= self.rare[item]
            where, row, item = where[enough], row[enough], item[enough]
            pairs_here, pair = np.unique(doc[where] * len(self.ids) + item, return_inverse=True)
            covered = self._covered(pair, item, where, self.place[row], self.apart[row], len(pairs_here))
            for p in pairs_here[covered >= self.rare[pairs_here % len(self.ids)]].tolist():
                yield divmod(p, len(self.ids))
            lo = hi

    def sharing(self, words: np.ndarray, doc: np.ndarray):
        """Yields (document, item, places of the seeds in words, [their first and second places in the
        item]) of the pairs that share enough seeds; doc: each word's document, ascending."""
        pairs = [pair_hashes(words, apart) for apart in (1, 2)]
        for d, group in groupby(self.candidates(pairs, doc), lambda x: x[0]):
            wanted = np.array(sorted(item for _, item in group))
            lo, hi = np.searchsorted(doc, [d, d + 1])
            grams = np.concatenate([g[lo : max(lo, hi - apart)] for apart, g in enumerate(pairs, 1)])
            places = np.concatenate([np.arange(lo, max(lo, hi - apart)) for apart in (1, 2)])
            order = np.argsort(grams, kind="stable")
            grams, places = grams[order], places[order]
            for at in range(0, len(wanted), 1000):
                items = wanted[at : at + 1000]
                size = self.bounds[items + 1] - self.bounds[items]
                own = np.repeat(self.bounds[items] - (np.cumsum(size) - size), size) + np.arange(size.sum())
                left, right = (np.searchsorted(grams, self.all_seeds[own], side) for side in ("left", "right"))
                n = right - left
                where = places[np.repeat(left - (np.cumsum(n) - n), n) + np.arange(n.sum())]
                pair, first, apart = (np.repeat(x, n) for x in (np.repeat(np.arange(len(items)), size), self.all_places[own], self.all_aparts[own]))
                covered = self._covered(pair, items[pair], where, first, apart, len(items))
                for k in np.flatnonzero(covered >= self.least[items]):
                    mine = np.flatnonzero(pair == k)
                    mine = mine[np.argsort(where[mine], kind="stable")]
                    yield d, int(items[k]), where[mine], np.stack([first[mine], first[mine] + apart[mine]])

    def score(self, item: int, words: np.ndarray, at: np.ndarray, covered: np.ndarray) -> float:
        """The best alignment's part of the item's own score, 0 if it is below LEAST_SCORE;
        at: ascending places of seeds in a document's words, covered: the item's words that they cover."""
        least, span = int(self.least[item]), int(self.span[item])
        # Along an alignment at least half of the covered words begin a seed: so many begin in the stretch.
        starts, many = np.unique(at), -(-least // 2)
        starts = starts[: max(0, len(starts) - many + 1)][starts[many - 1 :] - starts[: max(0, len(starts) - many + 1)] <= span]
        want, best = self.words[item], 0
        for part in np.split(starts, np.flatnonzero(np.diff(starts) > 2 * span) + 1):
            if not len(part):
                continue
            lo, hi = max(0, int(part[0]) - span), int(part[-1]) + span + 1
            if len(np.unique(covered[:, (at >= lo) & (at < hi)])) >= least:
                best = max(best, local_alignment(want, words[lo:hi]))
        score = best / (MATCH * len(want))
        return score if score >= LEAST_SCORE else 0.0


def _aligned(batches, items: Items):
    """(id, hash, text) -> (id, hash, item, score) of the pairs that reach LEAST_SCORE."""
    hasher = WordHasher(plain=True)
    for batch in batches:
        texts = [(t or "").encode() for t in batch.column(2).to_pylist()]
        keys, marks, out = batch.column(0).to_pylist(), batch.column(1).to_pylist(), []
        for lo, hi in blocks_of(texts):
            if hi - lo == 1:
                words = hasher.words(texts[lo])
                counts = np.array([len(words)])
            else:
                words, counts = hasher.many(texts[lo:hi])
            first = np.cumsum(counts) - counts
            if items.short:
                for doc in np.flatnonzero((counts > 0) & (counts < LEAST_WORDS)):
                    for i in items.short.get(whole_hash(words[first[doc] : first[doc] + counts[doc]]), ()):
                        out.append((keys[lo + doc], marks[lo + doc], i, 1.0))
            for doc, item, at, covered in items.sharing(words, np.repeat(np.arange(hi - lo), counts)):
                score = items.score(item, words[first[doc] : first[doc] + counts[doc]], at - first[doc], covered)
                if score:
                    out.append((keys[lo + doc], marks[lo + doc], items.ids[item], score))
        columns = list(zip(*out, strict=True)) if out else [(), (), (), ()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.float64()), strict=True)], ["id", "hash", "item_id", "score"]
        )


def benchmark_matches(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """(doc_id, text_hash, item_id, score) of every document and test item that align with a
    score (Smith-Waterman over words, part of the item's own) of LEAST_SCORE or more.

    Words are compared A-Z lower-cased and without ASCII marks. An item with fewer than LEAST_WORDS
    words is matched by documents of just these words; null and empty texts match nothing. text_hash (xxhash64
    of the text) tells rows of one id apart; equal rows appear once. Empty tables give no rows."""
    spark = docs.sparkSession
    arrow_rows(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(text_col).cast("string")).alias("hash"), F.col(text_col).cast("string").alias("text"))
    tests = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(item_text_col).cast("string").alias("text")).filter("text is not null")
    blocks = tests.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0] // BLOCK_CHARS + 1
    shelf, found = Shelf(spark, "decontaminate"), None
    for k in range(blocks):
        part = tests.filter(F.pmod(F.xxhash64("text"), F.lit(blocks)) == k).orderBy("item", "text").collect()
        if not part:
            continue
        items = Items([(r["item"], r["text"]) for r in part])
        here = rows.mapInArrow(partial(_aligned, items=items), "id long, hash long, item_id long, score double")
        if blocks > 1:  # else the driver would hold all blocks until the end
            here = shelf.put(here, f"block-{k}")
        found = here if found is None else found.union(here)
    if found is None:
        return spark.createDataFrame([], "doc_id long, text_hash long, item_id long, score double")
    return found.groupBy(F.col("id").alias("doc_id"), F.col("hash").alias("text_hash"), "item_id").agg(F.max("score").alias("score"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **names) -> DataFrame:
    """For each row of docs: doc_id, item_id (the item it matches best, the least of equals;
    null if none), score (0 if none), n_items, kept (it matches none). See benchmark_matches()."""
    best = benchmark_matches(docs, benchmark, id_col, text_col, **names).groupBy("doc_id", "text_hash").agg(
        F.max_by("item_id", F.struct("score", -F.col("item_id"))).alias("item_id"), F.max("score").alias("score"), F.count("*").alias("n_items")
    )
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(text_col).cast("string")).alias("hash"))
    out = rows.join(best, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("hash") == F.col("text_hash")), "left")
    return out.select(
        F.col("id").alias("doc_id"), "item_id", F.coalesce("score", F.lit(0.0)).alias("score"),
        F.coalesce("n_items", F.lit(0)).alias("n_items"), F.col("item_id").isNull().alias("kept"),
    )
