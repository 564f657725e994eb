"""MinHash near-duplicates: universal hash minima, banding, signature verification,
confirmation on full shingle sets, and connected components.

Copies with one shingle set are one node from the start (a pre-aggregated minimum), so
groups of thousands of exact copies cost nothing further. Nodes are sets, not ids: rows of one
id with different texts are different nodes. Inside a band bucket no list
of all pairs is made: each node is first checked against one bucket centre; only
buckets whose nodes then still lie in different components are compared further, in
blocks of signatures, and only pairs whose signatures agree are passed on.

With the default 36 bands of 5 minima a pair of similarity 0.8 fails to meet in any
band with a chance of 6e-7, and its signatures fall short of `screen` with 3e-7."""

from __future__ import annotations

import hashlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Shelf, WordHasher, arrow_rows, blocks_of, shingle_set
from .components import BROADCAST_IDS, components, joined, small

BANDS, ROWS = 36, 5
#: Signatures that agree in a smaller part are not confirmed on full sets.
SCREEN = 0.65
#: Nodes of one block when an unresolved bucket is compared, and the shingle hashes that each
#: then carries: with 1024 the estimate's standard error is 0.0125, and 6 % are allowed.
BLOCK, LEAST = 1024, 1024


def _hash_family(n: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(seed)
    return draw.integers(0, 1 << 32, n, dtype=np.uint32) | np.uint32(1), draw.integers(0, 1 << 32, n, dtype=np.uint32)


def minima(sets: list[np.ndarray], family) -> np.ndarray:
    """[set, hash function] least value of a*x+b mod 2^32, low 16 bits; sets are not empty."""
    values = np.concatenate(sets)
    values = (values ^ (values >> np.uint64(32))).astype(np.uint32)
    first = np.cumsum([0] + [len(s) for s in sets[:-1]])
    out = np.empty((len(sets), len(family[0])), np.uint16)
    for j, (a, b) in enumerate(zip(*family, strict=True)):
        out[:, j] = np.minimum.reduceat(values * a + b, first).astype(np.uint16)
    return out


def _sketch(batches, words: int, n_hashes: int):
    hasher, family = WordHasher(), _hash_family(n_hashes)
    for batch in batches:
        texts = [(t or "").encode() for t in batch.column(2).to_pylist()]
        sizes, keys, sigs = [], [], []
        for lo, hi in blocks_of(texts, 1 << 18):
            if hi - lo == 1:
                sets = [shingle_set(hasher.words(texts[lo]), words)]
            else:
                hashes, counts = hasher.many(texts[lo:hi])
                sets = [shingle_set(w, words) for w in np.split(hashes, np.cumsum(counts)[:-1])]
            full = [s for s in sets if len(s)]
            rows = iter(minima(full, family)) if full else iter(())
            for s in sets:
                sizes.append(len(s))
                keys.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                sigs.append(next(rows).tobytes() if len(s) else None)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(sigs, pa.binary())],
            ["id", "hash", "n", "key", "sig"],
        )


def _agreeing(batches, screen: float):
    """(a, b, sig_a, sig_b) -> (a, b) of the pairs whose signatures agree in `screen` or more."""
    for batch in batches:
        if not batch.num_rows:
            continue
        left, right = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint16).reshape(batch.num_rows, -1) for k in (2, 3))
        yield batch.select([0, 1]).filter(pa.array((left == right).mean(axis=1) >= screen))


def _confirmed(batches, words: int, percent: int):
    """(a, b, text_a, text_b) -> (a, b) where 100 * common >= percent * union of full sets."""
    hasher, last, kept = WordHasher(), None, None
    for batch in batches:
        keep = []
        for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            if x != last:
                last = x
                kept = shingle_set(hasher.words((x or "").encode()), words)
            other = shingle_set(hasher.words((y or "").encode()), words)
            both = len(np.intersect1d(kept, other, assume_unique=True))
            keep.append(both > 0 and 100 * both >= percent * (len(kept) + len(other) - both))
        yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))


def _groups(batches):
    """Rows sorted by their first three columns -> lists of the rows that agree in them."""
    rows = []
    for batch in batches:
        for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if rows and r[:3] != rows[0][:3]:
                yield rows
                rows = []
            rows.append(r)
    if rows:
        yield rows


class _Group:
    """Two blocks i and j of one bucket: rows (band, i, j, node, component, block, sig, ...)."""

    def __init__(self, rows):
        _, self.i, self.j = rows[0][:3]
        self.rows = sorted({r[3]: r for r in rows}.values(), key=lambda r: r[3])
        self.node, self.comp, self.block = (np.array([r[k] for r in self.rows]) for k in (3, 4, 5))
        self.sig = np.frombuffer(b"".join(r[6] for r in self.rows), np.uint16).reshape(len(self.rows), -1)

    def near(self, screen: float):
        """(x, others, agreement) for nodes x of block i and others of block j, each pair
        once, whose components differ and whose signatures agree in `screen` or more."""
        for x in np.flatnonzero(self.block == self.i):
            other = (self.comp != self.comp[x]) & (self.block == self.j)
            if self.i == self.j:
                other[: x + 1] = False
            other = np.flatnonzero(other)
            if len(other):
                agree = (self.sig[other] == self.sig[x]).mean(axis=1)
                if (near := agree >= screen).any():
                    yield x, other[near], agree[near]


def _closest(batches, screen: float):
    """Of each node in each group, the other node that agrees most with it: (node, other, agree)."""

    def batch_of(found):
        return pa.RecordBatch.from_arrays(
            [pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64()), pa.array([f[2] for f in found], pa.float64())],
            ["node", "other", "agree"],
        )

    out: list[tuple[int, int, float]] = []
    for rows in _groups(batches):
        best: dict[int, tuple[float, int]] = {}
        group = _Group(rows)
        for x, others, agree in group.near(screen):
            for y, a in zip(group.node[others].tolist(), agree.tolist(), strict=True):
                for p, q in ((int(group.node[x]), y), (y, int(group.node[x]))):
                    if (a, -q) > best.get(p, (0.0, 0)):
                        best[p] = (a, -q)
        out += [(p, -q, a) for p, (a, q) in best.items()]
        if len(out) > 10_000:
            yield batch_of(out)
            out = []
    if out:
        yield batch_of(out)


def _least(batches, words: int):
    """(rep, text) -> (rep, least): the LEAST smallest 32-bit shingle hashes, sorted; all of
    them, if there are no more."""
    hasher = WordHasher()
    for batch in batches:
        least = []
        for text in batch.column(1).to_pylist():
            values = shingle_set(hasher.words((text or "").encode()), words)
            least.append(np.unique((values ^ (values >> np.uint64(32))).astype(np.uint32))[:LEAST].tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(least, pa.binary())], ["rep", "least"])


def _likely(batches, screen: float, percent: int, rows_per_band: int, bands: int):
    """Every pair of a group in different components that can still be a link, judged by
    the least shingle hashes (exact where a set has no more of them): (a, b). A pair
    counts in the first of the bands that it shares alone."""
    for rows in _groups(batches):
        group = _Group(rows)
        band_no = group.rows[0][8]
        first_bands = group.sig[:, : bands * rows_per_band].reshape(len(group.rows), bands, rows_per_band)
        sets = [np.frombuffer(r[7], np.uint32) for r in group.rows]
        sizes = np.array([len(v) for v in sets])
        top = np.array([v[-1] if len(v) == LEAST else 1 << 32 for v in sets], np.int64)
        _, place = np.unique(np.concatenate(sets), return_inverse=True)
        first = np.cumsum(sizes) - sizes
        seen = np.zeros(place.max() + 1, bool)
        found = []
        for x, others, _ in group.near(screen):
            shared = (first_bands[others] == first_bands[x]).all(axis=2)
            others = others[shared.argmax(axis=1) == band_no]
            if not len(others):
                continue
            mine = place[first[x] : first[x] + sizes[x]]
            seen[mine] = True
            common = np.add.reduceat(seen[place].astype(np.int64), first)[others]
            seen[mine] = False
            whole = (top[others] == 1 << 32) & (top[x] == 1 << 32)
            union = sizes[others] + sizes[x] - common
            keep = whole & (common * 100 >= (percent - 1) * union)
            for k in np.flatnonzero(~whole & (common * 100 >= 40 * np.minimum(sizes[others], sizes[x]))):
                y = others[k]
                limit = min(top[x], top[y])
                both = sum(int(np.searchsorted(sets[z], limit, "right")) for z in (x, y)) - common[k]
                keep[k] = common[k] * 100 >= (percent - 6) * both
            found += [(int(group.node[x]), int(group.node[y])) for y in others[keep]]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], ["a", "b"])


def _texts_of(nodes: DataFrame, ids: DataFrame, texts: DataFrame, shelf: Shelf, name: str) -> DataFrame:
    """(rep, blocks, text) of the nodes in ids (rep, blocks), as a table: each node's text is that of one document."""
    n = ids.count()
    wanted = small(nodes.select("rep", "id", "hash").join(small(ids, n), "rep"), n)
    found = shelf.put(texts.join(wanted, ["id", "hash"]).select("rep", "blocks", "text"), f"{name}_texts")
    if found.count() > n:  # repeated rows
        found = shelf.put(found.dropDuplicates(["rep"]), f"{name}_texts1")
    return found


#: Partners of one document in one block of pairs: its text is sent once for each block.
PARTNERS = 512


def _confirm(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, shelf: Shelf, name: str, words: int, percent: int) -> tuple[DataFrame, DataFrame | None]:
    """Of the pairs (of nodes; a table without repeated rows) those that hold on full sets, as a
    table, and the table of all their texts (none without pairs)."""
    n = pairs.count()
    if not n:
        return pairs, None
    # A document with many partners is dealt over several blocks, each with a copy of its text.
    ends = pairs.select(F.col("a").alias("rep"), F.lit(1).alias("one")).union(pairs.select("b", F.lit(0)))
    ids = ends.groupBy("rep").agg(F.greatest(F.ceil(F.sum("one") / PARTNERS), F.lit(1)).cast("int").alias("blocks"))
    ids = shelf.put(ids, f"{name}_ids")
    wanted = _texts_of(nodes, ids, texts, shelf, name)
    hubs = small(ids.filter("blocks > 1").select(F.col("rep").alias("a"), "blocks"), n // PARTNERS)
    left = wanted.select(F.col("rep").alias("a"), F.col("text").alias("text_a"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    both = (
        pairs.join(hubs, "a", "left").select("a", "b", F.pmod(F.xxhash64("b"), F.coalesce("blocks", F.lit(1))).cast("int").alias("block"))
        .join(wanted.select(F.col("rep").alias("b"), F.col("text").alias("text_b")), "b")
        .join(left, ["a", "block"])
        .select("a", "b", "text_a", "text_b")
    )
    edges = shelf.put(both.mapInArrow(partial(_confirmed, words=words, percent=percent), "a long, b long"), f"{name}_edges")
    shelf.drop(f"{name}_ids")
    return edges, wanted


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, words: int = 5, percent: int = 80,
    bands: int = BANDS, rows: int = ROWS, screen: float = SCREEN,
) -> DataFrame:
    """Returns (doc_id, n_shingles, component_id, kept, text_hash, first, component_key), a row for
    each row of docs.

    Words are [^\\x20\\x09-\\x0D]+ of the whole text, A-Z lower-cased; a document's set
    holds its distinct `words`-word shingles (fewer words: the whole sequence). Documents
    are linked where 100 * common >= percent * union; component_id is the smallest id
    reachable, itself included, and kept says that it is the row's own id. Links are between texts:
    rows of one id with different texts may lie in different components. component_key tells
    components apart even where one id stands in two (null without shingles), and first says that the
    row has the component's least id and, of that id's texts, the one that stands for the component;
    text_hash is xxhash64 of the text.

    Null or blank texts: no shingles, linked with nothing. A null id: component_id null,
    kept, linked with nothing. Repeated rows are each returned, with one component. Other columns of docs are not read. An empty table gives no rows."""
    spark = docs.sparkSession
    arrow_rows(spark)
    shelf = Shelf(spark, "neardup")
    text = F.col(text_col).cast("string")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("hash"), text.alias("text"))
    sketches = shelf.put(
        texts.mapInArrow(partial(_sketch, words=words, n_hashes=bands * rows), "id long, hash long, n long, key binary, sig binary"), "sketches"
    )
    nodes = shelf.put(
        sketches.filter("id is not null and key is not null").groupBy("key").agg(F.min(F.struct("id", "hash", "n", "sig")).alias("s"))
        .select("key", "s.*", F.monotonically_increasing_id().alias("rep")), "nodes",
    )
    width = 2 * rows
    hits = nodes.select(
        "id", "rep", F.posexplode(F.array(*[F.xxhash64(F.substring("sig", width * k + 1, width), F.lit(k)) for k in range(bands)])).alias("band_no", "band")
    )
    # The centre has the least id: in most groups the text that the others were made from.
    buckets = hits.groupBy("band").agg(F.min(F.struct("id", "rep"))["rep"].alias("centre"), F.count("*").alias("size")).filter("size > 1")
    members = shelf.put(hits.join(buckets, "band").select("band", "band_no", "centre", "rep"), "members")
    # Each node against the centre with which it shares most bands. A node has a row for each band
    # at most, so that all further steps up to its signature stay where its rows are.
    shared = members.filter("rep != centre").select("rep", "centre").repartition("rep").groupBy("rep", "centre").count()
    star = shared.groupBy("rep").agg(F.max_by("centre", F.struct("count", -F.col("centre"))).alias("a")).select("a", F.col("rep").alias("b"))
    sig = nodes.select("rep", "sig")
    star = (
        star.join(sig.select(F.col("rep").alias("b"), F.col("sig").alias("sig_b")), "b")
        .join(sig.select(F.col("rep").alias("a"), F.col("sig").alias("sig_a")), "a")
        .select("a", "b", "sig_a", "sig_b").mapInArrow(partial(_agreeing, screen=screen), "a long, b long")
    )
    edges, _ = _confirm(shelf.put(star, "star_pairs"), nodes, texts, shelf, "star", words, percent)
    found = components(edges, shelf)
    shelf.drop("star_texts", "star_texts1")
    # What the stars left apart. First of each node its closest pair alone, which joins nearly
    # all that belongs together; then, exactly, every pair of different components.
    def unresolved(found: DataFrame, name: str, extra: DataFrame | None = None) -> DataFrame:
        rest, n = members, found.count()
        if extra is not None:
            rest = rest.join(small(extra.select("rep"), extra.count()), "rep", "left_semi")
        placed = rest.join(small(found, n), F.col("rep") == F.col("node"), "left").select(
            "band", "band_no", "rep", F.coalesce("component", "rep").alias("component")
        )
        if n > BROADCAST_IDS:
            placed = shelf.put(placed, f"{name}_placed")
        several = placed.groupBy("band").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("m"))
        several = shelf.put(several.filter("lo != hi").select("band", "m"), f"{name}_several")
        spread = placed.join(small(several, several.count()), "band").join(nodes.select("rep", "sig"), "rep")
        if extra is not None:
            spread = spread.join(extra, "rep")
        blocks = F.ceil(F.col("m") / BLOCK).cast("int")
        spread = (
            spread.withColumn("block", F.pmod(F.xxhash64("rep"), blocks).cast("int"))
            .withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
            .select(
                "band", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "rep", "component", "block", "sig",
                *(["least", "band_no"] if extra is not None else []),
            )
        )
        return spread.repartition("band", "i", "j").sortWithinPartitions("band", "i", "j")

    near = unresolved(found, "near").mapInArrow(partial(_closest, screen=screen), "node long, other long, agree double")
    near = near.groupBy("node").agg(F.max_by("other", F.struct("agree", -F.col("other"))).alias("other"))
    near = shelf.put(near.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct(), "near")
    shelf.drop("near_placed")
    edges, near_texts = _confirm(near, nodes, texts, shelf, "closest", words, percent)
    if near_texts is not None:
        found = joined(found, edges, shelf, "cc1")
        least = shelf.put(near_texts.select("rep", "text").mapInArrow(partial(_least, words=words), "rep long, least binary"), "least")
        shelf.drop("closest_texts", "closest_texts1")
        likely = partial(_likely, screen=screen, percent=percent, rows_per_band=rows, bands=bands)
        # a pair counts in one band alone: no row is repeated
        rest = shelf.put(unresolved(found, "rest", least).mapInArrow(likely, "a long, b long"), "rest_pairs")
        shelf.drop("rest_placed", "least")
        more, more_texts = _confirm(rest, nodes, texts, shelf, "rest", words, percent)
        if more_texts is not None:
            found = joined(found, more, shelf, "cc2")
            shelf.drop("rest_texts", "rest_texts1")
    # A component's label is the least (id, key) of its nodes: found holds the nodes with links alone.
    n = found.count()
    own = F.struct(F.col("id").alias("label"), F.col("key").alias("label_key"))
    placed = nodes.select("key", "rep", own.alias("own")).join(small(found, n), F.col("rep") == F.col("node"), "left")
    least_of = shelf.put(placed.filter("component is not null").groupBy("component").agg(F.min("own").alias("least")), "least_of")
    labels = placed.join(small(least_of, n), "component", "left").select("key", F.coalesce("least", "own").alias("l"))
    labels = shelf.put(labels.select("key", "l.*"), "labels")
    shelf.drop("members", "near", "nodes", "least_of", "near_several", "rest_several", "star_pairs", "rest_pairs", *(f"{k}_edges" for k in ("star", "closest", "rest")))
    out = sketches.join(labels, "key", "left")
    known = F.col("id").isNotNull()
    return out.select(
        F.col("id").alias("doc_id"),
        F.col("n").alias("n_shingles"),
        F.when(known, F.coalesce("label", "id")).alias("component_id"),
        F.coalesce(F.coalesce("label", "id") == F.col("id"), F.lit(True)).alias("kept"),
        F.col("hash").alias("text_hash"),
        F.coalesce((F.col("label") == F.col("id")) & (F.col("label_key") == F.col("key")), F.lit(True)).alias("first"),
        F.when(known, F.hex("label_key")).alias("component_key"),
    )
