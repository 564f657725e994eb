"""What each of several document filters removes, in every order that they may be applied in.

Which filters a document fails is a mask. Documents are counted by (part, mask) once; all orders
of k filters are then answered from those 2 ** k cells. The orders are visited by swaps of two
neighbours (each order differs from the one before in one swap), so that each visit computes two
steps anew and keeps the others; what a filter removes is summed along the walk.

Null texts are empty, a null part is the empty string. A text's copies are found by its SHA-256
over the whole table; rows without an id are never copies of another nor are others theirs. Of
rows that share the least id of a text none is a copy. A document of several label rows is good,
or toxic, if one of them says so. An empty table gives no rows. Further columns are not read."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import words_of

_COUNTS = ("n", "good", "toxic")
#: An audit of k filters has k! orders.
MOST_FILTERS = 8


def text_filters(text: Column) -> dict[str, Column]:
    """Few words, few distinct words, many capitals, marks of code: name -> whether a text fails."""
    words = words_of(text)
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return {
        "A": F.size(words) < 100,
        "B": 100 * F.size(F.array_distinct(words)) < 80 * F.size(words),
        "C": 100 * capitals > 10 * F.length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def swaps(k: int) -> Iterator[tuple[list[int], int | None]]:
    """All orders of range(k), each with the place of the swap that led to it (None at first);
    an element moves on its way until it meets a larger one or the end."""
    order, ways = list(range(k)), [-1] * k
    yield list(order), None
    while True:
        able = [x for p, x in enumerate(order) if 0 <= p + ways[x] < k and order[p + ways[x]] < x]
        if not able:
            return
        x = max(able)
        p = order.index(x)
        q = p + ways[x]
        order[p], order[q] = order[q], order[p]
        for y in range(x + 1, k):
            ways[y] = -ways[y]
        yield list(order), min(p, q)


def audit_cells(cells: np.ndarray, names: str | list[str]) -> list[dict]:
    """The audit of one part from its cells, an array (2 ** k, 3): rows, good and toxic ones by mask."""
    k = len(names)
    masks = np.arange(1 << k)
    fails = np.array([cells[masks & (1 << f) > 0].sum(axis=0) for f in range(k)])
    only = [int(cells[1 << f, 0]) for f in range(k)]
    lost = np.zeros((k, 3), np.int64)  # by step: rows, good, toxic removed there
    removed_sum, since, visits = np.zeros(k, np.int64), [0] * k, 0
    rows = []

    def place(order: list[int], step: int) -> None:
        gone = sum(1 << f for f in order[:step])
        lost[step] = cells[(masks & gone == 0) & (masks & (1 << order[step]) > 0)].sum(axis=0)

    before: list[int] = []
    for order, at in swaps(k):
        changed = range(k) if at is None else (at, at + 1)
        if at is not None:  # what these two removed holds for all visits since their last change
            for step in changed:
                removed_sum[before[step]] += lost[step, 0] * (visits - since[before[step]])
        for step in changed:
            place(order, step)
            since[order[step]] = visits
        visits += 1
        kept = cells[:, 0].sum() - np.cumsum(lost[:, 0])
        name = "".join(names[f] for f in order)
        for step, f in enumerate(order):
            n, good, toxic = (int(x) for x in lost[step])
            rows.append({"filter_order": name, "step": step + 1, "filter": f, "kept": int(kept[step]), "removed": n, "redundant": int(fails[f, 0]) - n, "unique_fails": only[f], "good_lost": good, "toxic_lost": toxic})
        before = order
    for step, f in enumerate(before):
        removed_sum[f] += lost[step, 0] * (visits - since[f])
    for row in rows:
        f = row.pop("filter")
        row |= {"filter": names[f], "shapley": int(removed_sum[f])}
    return rows


def mask_cells(docs: DataFrame, labels: DataFrame, filters: dict[str, Column], copies: str | None, part: str) -> DataFrame:
    """(part, mask, n, good, toxic): documents by the filters that they fail, bit k being the k-th filter.

    A filter is a condition over docs that depends on the text alone; `copies` names one more,
    the last, that texts fail which a smaller id has. Texts travel as digests. Copies are summed
    before they meet, so a text that a third of all rows hold is a row for each task."""
    text = F.coalesce(F.col("text"), F.lit(""))
    mask = sum((F.coalesce(c, F.lit(False)).cast("int") * (1 << k) for k, c in enumerate(filters.values())), F.lit(0))
    rows = docs.select(F.col("doc_id").alias("id"), F.coalesce(F.col(part), F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("digest"), mask.alias("mask"))
    rows = rows.groupBy("id", "part", "digest", "mask").agg(F.count("*").alias("n"))
    said = labels.groupBy(F.col("doc_id").alias("id")).agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False)).cast("long")).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False)).cast("long")).alias("toxic"))
    said = said.filter("id is not null").withColumn("spread", F.lit(0).cast("long"))
    # Rows without an id find no label; they are spread, so that they don't meet in one task.
    rows = rows.withColumn("spread", F.when(F.col("id").isNull(), F.xxhash64("digest")).otherwise(F.lit(0).cast("long")))
    rows = rows.join(said, ["id", "spread"], "left").na.fill(0, ["good", "toxic"])
    counts = [F.col("n"), (F.col("n") * F.col("good")).alias("good"), (F.col("n") * F.col("toxic")).alias("toxic")]
    rows = rows.select("id", "part", "digest", "mask", *counts)
    if copies is None:
        return rows.groupBy("part", "mask").agg(*[F.sum(c).alias(c) for c in _COUNTS])
    named = F.col("id").isNotNull()
    texts = rows.groupBy("digest", "part", "mask").agg(
        *[F.sum(F.when(named, F.col(c)).otherwise(0)).alias(c) for c in _COUNTS],
        *[F.sum(F.when(named, 0).otherwise(F.col(c))).alias(f"{c}_unnamed") for c in _COUNTS],
        F.min("id").alias("first"),
        F.min_by(F.struct(*_COUNTS), "id").alias("of_first"),  # one row an id here
    )
    texts = texts.withColumn("least", F.min("first").over(Window.partitionBy("digest")))  # a row for each part
    leads = F.coalesce(F.col("first") == F.col("least"), F.lit(False))
    fresh = [F.when(leads, F.col(f"of_first.{c}")).otherwise(F.lit(0)) for c in _COUNTS]
    bit = 1 << len(filters)
    both = F.array(
        F.struct(F.col("mask").alias("mask"), *[(x + F.col(f"{c}_unnamed")).alias(c) for c, x in zip(_COUNTS, fresh, strict=True)]),
        F.struct((F.col("mask") + bit).alias("mask"), *[(F.col(c) - x).alias(c) for c, x in zip(_COUNTS, fresh, strict=True)]),
    )
    cells = texts.select("part", F.inline(both)).filter("n > 0")
    return cells.groupBy("part", "mask").agg(*[F.sum(c).alias(c) for c in _COUNTS])


def interaction_audit(docs: DataFrame, labels: DataFrame, filters: dict[str, Column] | None = None, copies: str | None = "E", part: str = "lang") -> DataFrame:
    """(part, filter_order, step, filter, kept, removed, redundant, unique_fails, good_lost,
    toxic_lost, shapley): a row for each part, order of the filters and step.

    filters: name of one letter -> condition over docs that a failing text meets; by default
    those of text_filters(). shapley sums what the step's filter removes over all orders."""
    if filters is None:
        filters = text_filters(F.coalesce(F.col("text"), F.lit("")))
    names = [*filters, *([copies] if copies else [])]
    if not 0 < len(names) <= MOST_FILTERS:
        raise ValueError(f"1 to {MOST_FILTERS} filters, not {len(names)}")

    def walk(cells: pd.DataFrame) -> pd.DataFrame:
        table = np.zeros((1 << len(names), 3), np.int64)
        table[cells["mask"]] = cells[list(_COUNTS)]
        return pd.DataFrame(audit_cells(table, names)).assign(part=cells["part"].iloc[0])

    schema = "part string, filter_order string, step int, filter string, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"
    order = [c.split()[0] for c in schema.split(", ")]
    return mask_cells(docs, labels, filters, copies, part).groupBy("part").applyInPandas(lambda p: walk(p)[order], schema)
