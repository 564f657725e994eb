"""Writers: text lines, tab-separated files, vocabularies, label statistics, data sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.aggregates import label_stats
from ..operators.order import alphabetical_ids


def write_lines(df: DataFrame, line: Column, path: str, *order: str) -> None:
    """A line for each row, ends trimmed; with `order`, sorted over all part files."""
    rows = df.orderBy(*order) if order else df
    rows.select(F.trim(line).alias("value")).write.mode("overwrite").text(path)


def write_tsv(df: DataFrame, path: str, *columns: str, order: tuple[str, ...] = ()) -> None:
    write_lines(df, F.concat_ws("\t", *[F.col(c).cast("string") for c in columns]), path, *order)


def write_vocabulary(ids: DataFrame, token: str, path: str) -> None:
    """Tokens by id, the line number being the id. A vocabulary is aggregated and small."""
    ids.orderBy("id").coalesce(1).select(F.col(token).alias("value")).write.mode("overwrite").text(path)


def write_label_stats(df: DataFrame, label: str, path: str) -> None:
    """Label and share, the most frequent first."""
    stats = label_stats(df, label).orderBy(F.desc("n"), label)
    write_tsv(stats.coalesce(1), path, label, "share")


def write_intent_data(rows: DataFrame, folder: str, *, lower: bool = False) -> None:
    """From (intent, tokens, slots): the sentences with intent ids, the slot ids line by line
    with them, and both dictionaries; slots in order with O last."""
    intents = alphabetical_ids(rows.select("intent"), "intent")
    slots = rows.select(F.explode("slots").alias("slot")).distinct()
    order = slots.selectExpr("slot", "slot = 'O' AS last").orderBy("last", "slot")
    names = [r["slot"] for r in order.collect()]  # a dictionary of slot names
    table = F.create_map(*[F.lit(x) for k, s in enumerate(names) for x in (s, k)]) if names else F.create_map()
    text = F.array_join("tokens", " ")
    placed = rows.join(F.broadcast(intents), "intent").withColumn("sentence", F.lower(text) if lower else text)
    placed = placed.withColumn("slot_ids", F.array_join(F.transform("slots", lambda s: table[s].cast("string")), " "))
    write_tsv(placed, f"{folder}/sentences", "sentence", "id", order=("sentence", "slot_ids"))
    write_lines(placed, F.col("slot_ids"), f"{folder}/slots", "sentence", "slot_ids")
    write_vocabulary(intents, "intent", f"{folder}/dict.intents")
    spark = rows.sparkSession
    write_vocabulary(spark.createDataFrame(list(enumerate(names)), "id long, slot string"), "slot", f"{folder}/dict.slots")
