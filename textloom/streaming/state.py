"""Streams with state: running figures of each key, hourly windows that late rows still reach, and
runs that go on from their checkpoint.

A stream's results are written batch by batch, each batch under its own number, so that a batch
that is run again after a failure replaces what it had written; the end state is each key's row of
the latest batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle, TimerValues

#: A key's rows are dealt to so many accumulators, so that a key of many rows is no single task's.
SALTS = 8
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Figures(StatefulProcessor):
    """Of one key: rows, their sum and squares, least and most value, micro-batches and the sum of their
    means. Rows come in pieces; what is held is one row of figures."""

    FIELDS = ("n", "total", "squares", "least", "most", "batches", "means")
    STATE = "n long, total double, squares double, least double, most double, batches long, means double"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("figures", self.STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers: TimerValues) -> Iterator[pd.DataFrame]:
        n, total, squares, least, most = 0, 0.0, 0.0, float("inf"), float("-inf")
        for piece in rows:
            x = piece["value"].dropna()
            if len(x):
                n, total, squares = n + len(x), total + float(x.sum()), squares + float((x * x).sum())
                least, most = min(least, float(x.min())), max(most, float(x.max()))
        now = (n, total, squares, least, most, 1, total / n) if n else None
        if self.state.exists():
            old = tuple(self.state.get())
            if now is None:
                now = old
            else:
                a, b = dict(zip(self.FIELDS, old, strict=True)), dict(zip(self.FIELDS, now, strict=True))
                now = tuple(min(a[f], b[f]) if f == "least" else max(a[f], b[f]) if f == "most" else a[f] + b[f] for f in self.FIELDS)
        if now is not None:
            self.state.update(now)
            yield pd.DataFrame([[*key, *now]], columns=["key", "salt", *self.FIELDS])

    def close(self) -> None:
        pass


def figures(stream: DataFrame, key: str, value: str, row: str) -> DataFrame:
    """(key, salt, n, total, squares, least, most, batches, means) of a stream: of each key whose rows
    came, its figures up to now. row: a unique column that deals a key's rows to accumulators.
    Null keys are left out, null values are not counted."""
    rows = stream.filter(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("key"), F.pmod(F.xxhash64(row), F.lit(SALTS)).alias("salt"), F.col(value).cast("double").alias("value"))
    return rows.groupBy("key", "salt").transformWithStateInPandas(Figures(), f"key string, salt long, {Figures.STATE}", "Update", "None")


def end_state(written: DataFrame, *keys: str) -> DataFrame:
    """Each key's row of the latest batch, from a table with `batch`."""
    row = F.struct(*[c for c in written.columns if c != "batch"])
    return written.groupBy(*keys).agg(F.max_by(row, "batch").alias("__row")).select("__row.*")


def summed(state: DataFrame) -> DataFrame:
    """(key, n, total, mean, deviation, least, most) of the end state of figures()."""
    each = end_state(state, "key", "salt").groupBy("key").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.sum("squares").alias("squares"), F.min("least").alias("least"), F.max("most").alias("most"))
    mean = F.col("total") / F.col("n")
    return each.select("key", "n", "total", mean.alias("mean"), F.sqrt(F.greatest(F.col("squares") / F.col("n") - mean * mean, F.lit(0.0))).alias("deviation"), "least", "most")


@contextmanager
def state_in_files(spark: SparkSession):
    """State stores on disk for the streams started inside; the session's own setting comes back."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


def run_until_read(result: DataFrame, table: str, checkpoint: str, mode: str = "update") -> None:
    """Runs a stream over all that has come since its checkpoint, then ends it; results go to
    table/batch=<number>, a run-again batch over what it wrote before."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table}/batch={number}")

    with state_in_files(result.sparkSession):
        query = result.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()


def batches_of(spark: SparkSession, table: str, schema) -> DataFrame:
    """All that run_until_read() has written, with `batch`; nothing written is an empty table."""
    kind = schema if isinstance(schema, str) else ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    return spark.read.schema(f"{kind}, batch long").parquet(table)


def replayed(spark: SparkSession, slices: list[DataFrame], folder: str, build: Callable[[DataFrame], DataFrame], schema: str, mode: str = "update") -> DataFrame:
    """What a stream over files has written after each slice of them came, in turn, the stream being
    ended and begun again from its checkpoint between the slices: (results, batch)."""
    kind = None
    for part in slices:
        part.write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(schema).parquet(f"{folder}/in")
        result = build(stream)
        kind = result.schema
        run_until_read(result, f"{folder}/out", f"{folder}/checkpoint", mode)
    return batches_of(spark, f"{folder}/out", kind)
