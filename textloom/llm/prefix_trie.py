"""The trie of all conversations' beginnings: which first turns conversations share, and what
storing or computing shared beginnings once would save.

It is built level by level. At depth d every live conversation stands at a node of depth d - 1;
live conversations are grouped by (that node, their next turn), and the least conversation id of
a group names its node. A conversation that is alone in its node, or has no further turn, is no
longer live: below it stands a chain of its own turns, which needs no grouping. Leaves and savings
are then rolled up from the deepest level to the root, a join by parent for each level. There are
as many levels as the longest beginning that two conversations share.

Turns are compared by SHA-256 of role and text (null: empty) and travel as digests. The levels are
tables in the shared folder. A node that many conversations share is counted by partial sums; its
number reaches them by a broadcast of the at most 1000 nodes of a level that hold a thousandth of
the live conversations each, all others by a join.

Turns of a conversation are ordered by turn (null first), those of one number by their digest;
equal rows are turns of their own. Rows without a conversation id are left out. A conversation may be without
turns. An empty table gives no rows. Further columns are not read."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Shelf, lookup_counted, words_of

#: Ids of one piece of a node's list of ends: so many consecutive numbers.
PIECE = 4096
NO_ENDS = hashlib.sha256(b"").hexdigest()


def ordered_turns(conversations: DataFrame, shelf: Shelf) -> DataFrame:
    """(conv_id, rank from 0, digest, n_words) of all turns with a conversation id.

    The table is sorted by ranges, so that one conversation may span several; the turns of a
    conversation in earlier ranges are counted first."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))
    rows = conversations.filter("conv_id is not null").select("conv_id", "turn", digest.alias("digest"), F.size(words_of(text)).cast("long").alias("n_words"))
    order = (F.col("turn").asc_nulls_first(), F.col("digest"))
    rows = rows.repartitionByRange("conv_id", *order).withColumn("part", F.spark_partition_id())
    rows = shelf.put(rows, "sorted")
    counts = rows.groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("conv_id").orderBy("part")) - F.col("n")
    starts = counts.select("conv_id", "part", before.alias("start"))
    place = F.row_number().over(Window.partitionBy("conv_id", "part").orderBy(*order)) - 1
    return rows.withColumn("place", place).join(starts, ["conv_id", "part"]).select("conv_id", (F.col("start") + F.col("place")).cast("long").alias("rank"), "digest", "n_words")


def spliced(turns: DataFrame, shelf: Shelf, source: Column, borrowed: Column, most: int) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin with another's turns: the first `borrowed` (up to `most`) of
    `source`, both over conv_id, all if it has fewer, then their own after as many.

    Gives (conv_id, n_turns) and (conv_id, depth from 1, digest, n_words)."""
    turns = shelf.put(turns, "ranked")
    convs = turns.groupBy("conv_id").agg(F.count("*").alias("own")).withColumn("source", source).withColumn("h", borrowed.cast("long"))
    heads = turns.filter(F.col("rank") < most).select(F.col("conv_id").alias("source"), "rank", "digest", "n_words")
    found = heads.groupBy("source").agg(F.count("*").alias("there"))
    convs = convs.join(found, "source", "left").withColumn("lent", F.least("h", F.coalesce("there", F.lit(0))))
    convs = shelf.put(convs.select("conv_id", "source", "h", "lent", (F.col("lent") + F.greatest(F.lit(0), F.col("own") - F.col("h"))).alias("n_turns")), "convs")
    first = convs.filter("lent > 0").join(heads, "source").filter(F.col("rank") < F.col("lent")).select("conv_id", (F.col("rank") + 1).alias("depth"), "digest", "n_words")
    rest = turns.join(convs, "conv_id").filter(F.col("rank") >= F.col("h")).select("conv_id", (F.col("lent") + F.col("rank") - F.col("h") + 1).alias("depth"), "digest", "n_words")
    return convs.select("conv_id", "n_turns"), first.unionByName(rest)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's pieces; they come sorted by node and piece."""
    names = ["depth", "node", "ends_sha256"]
    state, at = hashlib.sha256(), None
    for batch in batches:
        out = []
        for depth, node, ids in zip(*(batch.column(c).to_pylist() for c in ("depth", "node", "ids")), strict=True):
            if at != (depth, node):
                if at is not None:
                    out.append((*at, state.hexdigest()))
                state, at = hashlib.sha256(ids.encode()), (depth, node)
            else:
                state.update(b"," + ids.encode())
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.string()))], names)
    if at is not None:
        yield pa.RecordBatch.from_arrays([pa.array([at[0]], pa.int64()), pa.array([at[1]], pa.int64()), pa.array([state.hexdigest()])], names)


def ends_of_nodes(ends: DataFrame) -> DataFrame:
    """(depth, node, ends_sha256) from (depth, node, conv_id): of the decimal ids in numeric order,
    joined by commas. A list is made in pieces of bounded size; a node's pieces pass one after the
    other through the digest, whose state is all that is held."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    pieces = ends.groupBy("depth", "node", F.floor(F.col("conv_id") / PIECE).alias("piece")).agg(text.alias("ids"))
    pieces = pieces.repartition("depth", "node").sortWithinPartitions("depth", "node", "piece")
    return pieces.mapInArrow(_digests, "depth long, node long, ends_sha256 string")


def prefix_trie(convs: DataFrame, turns: DataFrame, shelf: Shelf | None = None) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256):
    a row for each node of the trie of conversations (conv_id, n_turns) with the turns
    (conv_id, depth from 1 without gaps, digest, n_words)."""
    shelf = shelf or Shelf(convs.sparkSession, "trie")
    # By depth inside files, so that a level's rows are found by the files' statistics.
    turns = shelf.put(turns.repartition("conv_id").sortWithinPartitions("depth", "conv_id"), "turns")
    convs = shelf.put(convs, "all")
    n, root = convs.agg(F.count("*"), F.min("conv_id")).first()
    spark = convs.sparkSession
    schema = "conv_id long, depth long, parent_conv_id long, n_convs long, n_turns long, saved long"
    if not n:
        return spark.createDataFrame([], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")
    only = convs.agg(F.min("n_turns")).first()[0]
    levels = [spark.createDataFrame([(root, 0, None, n, only, 0)], schema)]
    left = n if n > 1 else 0
    live = shelf.put(convs.filter(F.lit(n > 1)).select("conv_id", "n_turns", F.lit(root).cast("long").alias("node"), F.lit(0).cast("long").alias("depth")), "live/0")
    depth = 0
    while left:
        depth += 1
        here = turns.filter(F.col("depth") == depth).select("conv_id", "digest", "n_words")
        rows = here.join(live.filter(F.col("n_turns") >= depth).select("conv_id", "n_turns", F.col("node").alias("parent")), "conv_id")
        rows = shelf.put(rows, f"rows/{depth}")
        groups = rows.groupBy("parent", "digest").agg(F.min("conv_id").alias("node"), F.count("*").alias("n"), F.min("n_turns").alias("n_turns"), F.first("n_words").alias("n_words"))
        groups = shelf.put(groups, f"groups/{depth}")
        total, shared = groups.agg(F.sum("n"), F.sum(F.when(F.col("n") > 1, F.col("n")))).first()
        if not total:
            break
        level = F.lit(depth).cast("long").alias("depth")
        levels.append(groups.select(F.col("node").alias("conv_id"), level, F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"), "n_turns", ((F.col("n") - 1) * F.col("n_words")).alias("saved")))
        left = shared or 0
        if left:
            placed = lookup_counted(rows, groups.filter("n > 1").select("parent", "digest", "node", "n"), ["parent", "digest"], "node", "n", left, "conv_id")
            live = shelf.put(placed.filter("node is not null").select("conv_id", "n_turns", "node", level), f"live/{depth}")
    # A conversation that others went along with ends in the node of its last level.
    ends = spark.read.schema(live.schema).parquet(f"{shelf.root}/live/*").filter("n_turns = depth")
    nodes = _rolled_up(levels, shelf)
    shelf.drop("sorted", "ranked", "convs", "all", "turns", "rows", "groups")
    return _nodes(nodes, ends_of_nodes(ends))


def _rolled_up(levels: list[DataFrame], shelf: Shelf) -> DataFrame:
    """The nodes of all levels with children, leaves and savings, the deepest level first."""
    below = None
    for depth in range(len(levels) - 1, -1, -1):
        level = levels[depth]
        # Of a conversation alone, its chain stands for all that is below.
        chain = ((F.col("n_convs") == 1) & (F.col("n_turns") > F.col("depth"))).cast("long")
        if below is None:
            level = level.select("*", F.lit(0).cast("long").alias("c"), F.lit(1).cast("long").alias("l"), F.lit(0).cast("long").alias("s"))
        else:
            sums = below.groupBy(F.col("parent_conv_id").alias("conv_id")).agg(F.count("*").alias("c"), F.sum("n_leaves").alias("l"), F.sum("saved_tokens").alias("s"))
            level = level.join(sums, "conv_id", "left").na.fill({"c": 0, "l": 1, "s": 0})
        level = level.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_turns", (F.col("c") + chain).alias("n_children"), F.col("l").alias("n_leaves"), (F.col("saved") + F.col("s")).alias("saved_tokens"))
        below = shelf.put(level, f"up/{depth}")
    return below.sparkSession.read.schema(below.schema).parquet(f"{shelf.root}/up/*")


def _nodes(nodes: DataFrame, ends: DataFrame) -> DataFrame:
    """The rows of nodes that conversations share, with their ends, and of the chains below nodes
    with one conversation, a row for each of its further turns."""
    shared = nodes.filter("n_convs > 1").join(ends.withColumnRenamed("node", "conv_id"), ["depth", "conv_id"], "left")
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    shared = shared.select(*columns, F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256"))
    top = F.col("depth")
    chains = nodes.filter("n_convs = 1").select("conv_id", top.alias("top"), "parent_conv_id", "n_turns", F.explode(F.sequence(top, F.col("n_turns"))).alias("depth"))
    last = F.col("depth") == F.col("n_turns")
    chains = chains.select(
        "conv_id", "depth", F.when(F.col("depth") == F.col("top"), F.col("parent_conv_id")).otherwise(F.col("conv_id")).alias("parent_conv_id"), F.lit(1).cast("long").alias("n_convs"),
        F.when(last, 0).otherwise(1).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"),
        F.when(last, F.sha2(F.col("conv_id").cast("string"), 256)).otherwise(F.lit(NO_ENDS)).alias("ends_sha256"),
    )
    return shared.unionByName(chains)


def conversation_trie(conversations: DataFrame, splice: tuple[Callable[[Column], Column], Callable[[Column], Column], int] | None = None) -> DataFrame:
    """The trie of a table (conv_id, turn, role, text). splice: (source id, number of borrowed
    turns, the most of these), functions of conv_id, for conversations that go on from another's."""
    shelf = Shelf(conversations.sparkSession, "trie")
    turns = ordered_turns(conversations, shelf)
    if splice is None:
        turns = shelf.put(turns, "ranked")
        return prefix_trie(turns.groupBy("conv_id").agg(F.count("*").alias("n_turns")), turns.withColumn("depth", F.col("rank") + 1).drop("rank"), shelf)
    source, borrowed, most = splice
    convs, turns = spliced(turns, shelf, source(F.col("conv_id")), borrowed(F.col("conv_id")), most)
    return prefix_trie(convs, turns, shelf)
