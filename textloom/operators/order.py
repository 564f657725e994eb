"""Order-dependent operators that hold at scale: ranks and running totals over a whole table
in two levels (within ranges of the order, then over the ranges), first appearances,
histories and splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import kept


def running_total(df: DataFrame, order: str, value: Column, out: str = "before", width: int | None = None, then: tuple[str, ...] = (), within: tuple[str, ...] = ()) -> DataFrame:
    """df with the sum of `value` over all rows that come earlier by `order`, a unique number
    (or, with `then`, by it and the columns of `then`, unique together); within: of the rows
    that are equal in these columns.

    The rows are sorted into ranges of like sizes, once, as a table; the ranges' totals, a row
    each, meet in one window. A value of `within` that many rows hold spans several ranges.
    width: ranges of so many order values instead, for orders that are known to be dense."""
    df = df.withColumn("__value", value)
    if width is not None:
        df = df.withColumn("__range", F.floor(F.col(order) / width))
    else:
        df = kept(df.repartitionByRange(*within, order, *then).withColumn("__range", F.spark_partition_id()), "ranges")
    ranges = df.groupBy(*within, "__range").agg(F.sum("__value").alias("__sum"))
    over = Window.partitionBy(*within).orderBy("__range")
    starts = ranges.select(*within, "__range", (F.sum("__sum").over(over) - F.col("__sum")).alias("__start"))
    inside = F.sum("__value").over(Window.partitionBy(*within, "__range").orderBy(order, *then).rowsBetween(Window.unboundedPreceding, 0)) - F.col("__value")
    starts = starts if within else F.broadcast(starts)  # a row for each range
    return df.withColumn("__inside", inside).join(starts, [*within, "__range"]).withColumn(out, F.col("__start") + F.col("__inside")).drop("__range", "__value", "__inside", "__start")


def ranked(df: DataFrame, order: str, out: str = "rank", width: int | None = None, then: tuple[str, ...] = (), within: tuple[str, ...] = ()) -> DataFrame:
    """df with each row's place, from 0, by a unique number (or by it and `then`)."""
    return running_total(df, order, F.lit(1).cast("long"), out, width, then, within)


def exact_split(df: DataFrame, order: str, share: float) -> DataFrame:
    """df with `split`: 'train' for exactly floor(rows * share) of the rows, the first by `order`,
    'dev' for the rest; nothing is drawn at random (random_split() does)."""
    n = df.count()
    cut = int(n * share)
    placed = ranked(df, order, "__rank")
    return placed.withColumn("split", F.when(F.col("__rank") < cut, "train").otherwise("dev")).drop("__rank")


def random_split(df: DataFrame, key: str, share: float, seed: int = 0) -> DataFrame:
    """df with `split`: exactly floor(rows * share) rows, drawn by a seeded digest of a unique key,
    are 'train', the rest 'dev'."""
    drawn = df.withColumn("__draw", F.conv(F.substring(shuffle_key(key, seed), 1, 15), 16, 10).cast("long"))
    cut = int(df.count() * share)
    placed = ranked(drawn, "__draw", "__rank", then=(key,))
    return placed.withColumn("split", F.when(F.col("__rank") < cut, "train").otherwise("dev")).drop("__rank", "__draw")


def first_seen_ids(tokens: DataFrame, token: str, order: list[str], specials: list[str] = ()) -> DataFrame:
    """(token, id): specials first, then tokens by first appearance. The vocabulary is
    aggregated before it is ordered."""
    first = tokens.filter(~F.col(token).isin(*specials) if specials else F.lit(True)).groupBy(token).agg(F.min(F.struct(*order)).alias("first"))
    if len(order) == 1 and dict(tokens.dtypes)[order[0]].startswith("struct"):
        first = first.select(token, F.col(f"first.{order[0]}").alias("first"))
    names = first.schema["first"].dataType.names
    placed = ranked(first.select(token, *[F.col(f"first.{n}").alias(f"__{k}") for k, n in enumerate(names)]), "__0", "id", then=tuple(f"__{k}" for k in range(1, len(names))))
    return placed.select(token, (F.col("id") + len(specials)).cast("long").alias("id"))


def alphabetical_ids(labels: DataFrame, label: str, pad: str | None = None) -> DataFrame:
    """(label, id): the pad label 0, then the others in code-point order."""
    each = labels.select(label).distinct()
    return each.select(label, (F.row_number().over(Window.orderBy(F.col(label) != F.lit(pad), label)) - 1).cast("long").alias("id"))


def last_line_ids(lines: DataFrame, label: str, line_no: str) -> DataFrame:
    """(label, id): a label's line number, of repeated labels the last."""
    return lines.groupBy(label).agg(F.max(line_no).alias("id"))


def shuffle_key(key: str, seed: int) -> Column:
    """Sorting by it is a shuffle that a seed repeats on any cluster."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))


def shuffled_first(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """The first n rows of a seeded shuffle: a top-n by shuffle_key(), without a full sort."""
    return df.orderBy(shuffle_key(key, seed), key).limit(n)


def rank_shards(df: DataFrame, order: str, ranks: int, epoch: int = 0) -> DataFrame:
    """df with `rank` below `ranks`, sizes at most one apart; each epoch deals the rows anew by
    an arithmetic permutation of their places (a step prime to the row count)."""
    n = max(df.count(), 1)
    step = next(p for p in (1_000_003, 1_000_033, 1_000_037, 1_000_039, 1_000_081) if n % p)
    place = (F.col("__place") * step + epoch * 7919) % n
    return ranked(df, order, "__place").withColumn("rank", place % ranks).drop("__place")


def history(turns: DataFrame, key: str, order: str, text: Column, out: str = "history") -> DataFrame:
    """Each turn's text after those of all earlier turns of its dialogue."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return turns.withColumn(out, F.trim(F.array_join(F.collect_list(text).over(w), "")))


def first_of(df: DataFrame, key: str, *order: str) -> DataFrame:
    """The first row of each key, by aggregation (map-side combined)."""
    row = F.struct(*[F.col(c) for c in df.columns])
    return df.groupBy(key).agg(F.min_by(row, F.struct(*order)).alias("__row")).select("__row.*")


def batches(df: DataFrame, order: str, size: int, *, drop_last: bool = False) -> DataFrame:
    """df with `batch`: runs of `size` rows by `order`; -1 is one batch."""
    if size == -1:
        return df.withColumn("batch", F.lit(0).cast("long"))
    out = ranked(df, order, "__rank").withColumn("batch", F.floor(F.col("__rank") / size)).drop("__rank")
    if drop_last:
        out = out.filter(F.col("batch") < df.count() // size)
    return out


def token_budget_batches(df: DataFrame, key: str, source: str, target: str, budget: int) -> DataFrame:
    """df with `batch`: pairs of like lengths share a batch of about `budget` tokens (batching.py
    has the batches of a whole greedy pass). Lengths are sorted, then the running tokens of each doubling of the length are cut by the budget."""
    out = df.withColumn("__width", F.greatest(source, target)).withColumn("__band", F.floor(F.log2(F.col("__width") + 1)).cast("int"))
    out = running_total(out, "__width", F.col("__width"), "__before", then=(source, key))
    starts = out.groupBy("__band").agg(F.min("__before").alias("__start"))  # a row for each power of two
    place = F.floor((F.col("__before") - F.col("__start")) / budget)
    return out.join(F.broadcast(starts), "__band").withColumn("batch", F.concat_ws("-", "__band", place.cast("long"))).drop("__band", "__width", "__before", "__start")
