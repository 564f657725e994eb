"""Dialogue state: slot repair and joint accuracy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def repair_values(value: Column, table: dict[str, str], rules: list[tuple[Column, str]]) -> Column:
    """A value rewritten by the table, else by the first rule that holds, else as it is."""
    out = value
    for condition, new in reversed(rules):
        out = F.when(condition, new).otherwise(out)
    for old, new in reversed(table.items()):
        out = F.when(value == old, new).otherwise(out)
    return out


def slot_name(name: Column) -> Column:
    """Lower case; spaces dropped but in names of bookings."""
    return F.when(F.contains(name, F.lit("book")), F.lower(name)).otherwise(F.lower(F.replace(name, F.lit(" "), F.lit(""))))


def domain_slots(slots: DataFrame, name: str, domains: list[str]) -> DataFrame:
    """Rows whose slot, `domain-name`, is of one of the domains, with the name normalised."""
    return slots.filter(F.substring_index(name, "-", 1).isin(domains)).withColumn(name, slot_name(F.col(name)))


def joint_accuracy(slots: DataFrame, turn: list[str], right: Column) -> DataFrame:
    """(joint: share of turns with all slots right, slot: share of slots right), one row."""
    turns = slots.withColumn("__right", right).groupBy(*turn).agg(
        F.bool_and("__right").alias("joint"), F.count_if("__right").alias("right"), F.count("*").alias("n")
    )
    return turns.agg(F.avg(F.col("joint").cast("double")).alias("joint"), (F.sum("right") / F.sum("n")).alias("slot"))
