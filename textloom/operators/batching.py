"""Batches of sentence pairs by a token budget, exactly as one pass over all pairs would make them.

The pass is sequential: which pair comes next, and where a batch ends, depends on all before. But
it looks at lengths alone, and pairs of equal lengths come in a row. So the pairs are counted by
(source, target) length, the pass runs over those counts, jumping over the like batches that one
length pair fills, and its result, a few ranges for each length pair, is joined to the pairs."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .order import ranked

#: Batches are cut to multiples of so many pairs; the rest begins the next batch.
GROUP = 8
#: Most pairs of lengths that are counted; lengths to 2000 on either side always fit.
MOST_CELLS = 4_000_000
#: So many ranges are sent to all tasks; beyond it the join shuffles.
BROADCAST_RANGES = 1_000_000


@dataclass
class _Walk:
    """The pass: pairs taken so far, the open batch, and what was decided."""

    budget: int
    taken: int = 0
    open: int = 0
    source: int = 0
    target: int = 0
    cut: int = 0  # pairs in closed batches
    closed: int = 0
    last: list = field(default_factory=list)  # [source, target, pairs] of the latest pairs, GROUP at least
    runs: list = field(default_factory=list)  # (source, target, first rank, pairs, place of the first)
    spans: list = field(default_factory=list)  # (first place, pairs of a batch, first batch): until the next span

    def full_at(self) -> float:
        """How many pairs of the open batch's lengths exceed the budget."""
        width = self.source + self.target
        return self.budget // width + 1 if width else float("inf")

    def take(self, source: int, target: int, rank: int, n: int) -> None:
        self.source, self.target = max(self.source, source), max(self.target, target)
        self.runs.append((source, target, rank, n, self.taken))
        self.taken += n
        self.open += n
        if self.last and self.last[-1][:2] == [source, target]:
            self.last[-1][2] += n
        else:
            self.last.append([source, target, n])
        while sum(r[2] for r in self.last[1:]) >= GROUP:
            self.last.pop(0)

    def close(self, size: int, times: int = 1) -> None:
        """Closes `times` batches of `size` pairs each."""
        self.spans.append((self.cut, size, self.closed))
        self.cut += size * times
        self.closed += times

    def evict(self) -> None:
        """Closes the open batch but for its rest, whose lengths the next batch begins with."""
        size = GROUP * ((self.open - 1) // GROUP) or self.open
        rest = self.open - size
        self.close(size)
        self.open, self.source, self.target = rest, 0, 0
        for source, target, n in reversed(self.last):
            if rest <= 0:
                break
            self.source, self.target = max(self.source, source), max(self.target, target)
            rest -= n


def _pass(cells: list[tuple[int, int, int]], budget: int) -> _Walk:
    """cells: (source, target, pairs) in order. Of the shortest source length left and the next
    longer one the pair is taken that widens the batch less, the former where both do alike."""
    buckets: list[tuple[int, list]] = []
    for source, target, n in cells:
        if not buckets or buckets[-1][0] != source:
            buckets.append((source, []))
        buckets[-1][1].append([target, n, 0])  # length, pairs, pairs taken
    heads, walk, i = [0] * len(buckets), _Walk(budget), 0

    def head(b: int):
        return buckets[b][1][heads[b]] if b < len(buckets) and heads[b] < len(buckets[b][1]) else None

    def wider(b: int, cell) -> int:
        return max(walk.source, buckets[b][0]) + max(walk.target, cell[0])

    while i < len(buckets):
        here, ahead = head(i), head(i + 1)
        if here is None:
            i += 1
            continue
        b = i if ahead is None or wider(i, here) <= wider(i + 1, ahead) else i + 1
        source, cell = buckets[b][0], (here if b == i else ahead)
        target, n, used = cell
        walk.source, walk.target = max(walk.source, source), max(walk.target, target)
        # One pair ahead may be enough to make the one here no wider.
        once = b > i and here[0] <= walk.target
        n = 1 if once else int(min(n - used, max(1, walk.full_at() - walk.open)))
        walk.take(source, target, used, n)
        cell[2] += n
        if walk.open * (walk.source + walk.target) > budget:
            walk.evict()
            left = cell[1] - cell[2]
            alone = not walk.open or walk.last[-1][:2] == [source, target] and walk.last[-1][2] >= walk.open
            first = walk.open or ahead is None or (wider(i, here) <= wider(i + 1, ahead)) == (b == i)
            again = first and (b == i or here[0] > target)
            if left and alone and again:  # batches of this length pair alone follow each other
                most = budget // (source + target) + 1
                size = GROUP * ((most - 1) // GROUP) or most
                if (times := left // size) and walk.open == most - size:
                    walk.take(source, target, cell[2], size * times)
                    walk.open -= size * times
                    cell[2] += size * times
                    walk.close(size, times)
                    if walk.open:
                        walk.source, walk.target = source, target
                    else:
                        walk.source = walk.target = 0
        if cell[2] == cell[1]:
            heads[b] += 1
    if walk.open:
        walk.close(walk.open)
    return walk


def _ranges(walk: _Walk) -> list[tuple]:
    """(source, target, first rank, end, place less rank, first place of the span, its size, its
    first batch): runs cut where spans begin."""
    out, k = [], 0
    for source, target, rank, n, place in walk.runs:
        end = place + n
        while place < end:
            while k + 1 < len(walk.spans) and walk.spans[k + 1][0] <= place:
                k += 1
            first, size, batch = walk.spans[k]
            stop = min(end, walk.spans[k + 1][0]) if k + 1 < len(walk.spans) else end
            out.append((source, target, rank, rank + stop - place, place - rank, first, size, batch))
            rank, place = rank + stop - place, stop
    return out


def greedy_batches(df: DataFrame, key: str, source: str, target: str, budget: int) -> DataFrame:
    """df with `batch` (from 0): pairs sorted by source, then target length, ties by key; a batch is
    closed when its pairs, each as wide as its longest, exceed the budget, and then cut to a
    multiple of eight. Lengths and key are not null; the key is unique. More than MOST_CELLS
    different pairs of lengths are an error: filter long pairs first."""
    spark = df.sparkSession
    counts = df.groupBy(F.col(source).cast("long").alias("s"), F.col(target).cast("long").alias("t")).agg(F.count("*").alias("n"))
    cells = counts.limit(MOST_CELLS + 1).collect()
    if len(cells) > MOST_CELLS:
        raise ValueError(f"more than {MOST_CELLS} different pairs of lengths")
    ranges = _ranges(_pass(sorted(map(tuple, cells)), budget))
    schema = "__s long, __t long, __from long, __to long, __shift long, __first long, __size long, __batch long"
    table = spark.createDataFrame(ranges, schema)
    table = F.broadcast(table) if len(ranges) <= BROADCAST_RANGES else table
    placed = ranked(df.withColumn("__s", F.col(source).cast("long")).withColumn("__t", F.col(target).cast("long")), key, "__rank", within=("__s", "__t"))
    inside = (F.col("__rank") >= F.col("__from")) & (F.col("__rank") < F.col("__to"))
    out = placed.join(table.withColumnRenamed("__s", "__s2").withColumnRenamed("__t", "__t2"), (F.col("__s") == F.col("__s2")) & (F.col("__t") == F.col("__t2")) & inside)
    batch = F.col("__batch") + F.floor((F.col("__rank") + F.col("__shift") - F.col("__first")) / F.col("__size"))
    return out.select(*[F.col(f"`{c}`") for c in df.columns], batch.cast("long").alias("batch"))
