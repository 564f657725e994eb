"""Predictions joined to their examples, batches of dialogues, capped files and vocabularies of pieces."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import pad_right


def null_answers(features: DataFrame, outputs: DataFrame) -> DataFrame:
    """features (unique_id, example, feature), outputs (unique_id, position, start, end: logits)
    -> (example, features, feature, null_score): of each example the first of the features whose
    logits of "no answer" are least together. Of outputs with one unique_id the last counts;
    features without output are left out."""
    last = outputs.groupBy("unique_id").agg(F.max_by(F.struct("start", "end"), "position").alias("o"))
    score = F.get("o.start", F.lit(0)) + F.get("o.end", F.lit(0))
    joined = features.join(last, "unique_id").select("example", "feature", score.alias("score"))
    best = F.min(F.struct("score", "feature"))
    return joined.groupBy("example").agg(F.count("*").alias("features"), best.alias("b")).select(
        "example", "features", "b.feature", F.col("b.score").alias("null_score")
    )


def dialogue_batches(df: DataFrame, batch: str, key: str, context: str, responses: str, pad_id: int) -> DataFrame:
    """Adds `place`, and fills contexts with 1 and all response lists with pad_id to the longest
    of their batch (contexts: 1 at least); the longest contexts come first, ties by key.

    A batch is bounded by its caller: places are counted inside it."""
    longest = F.max(F.array_max(F.transform(responses, F.size)))
    size = df.groupBy(batch).agg(F.greatest(F.max(F.size(context)), F.lit(1)).alias("_context"), F.coalesce(longest, F.lit(0)).alias("_response"))
    place = F.row_number().over(Window.partitionBy(batch).orderBy(F.size(context).desc(), key)) - 1
    filled = F.transform(responses, lambda r: pad_right(r, F.col("_response"), F.lit(pad_id)))
    out = df.join(size, batch).withColumn("place", place).withColumn(responses, filled)
    return out.withColumn(context, pad_right(F.col(context), F.col("_context"), F.lit(1))).drop("_context", "_response")


def capped_files(df: DataFrame, file: str, line: str, n: int) -> DataFrame:
    """The first n rows in order of file and line, and the first row of each file that follows
    the one where n was reached: the cap ends the reading of one file, not of all."""
    head = df.select(file, line).orderBy(file, line).limit(n)
    reached = head.agg(F.count("*").alias("n"), F.max(file).alias("_last"), F.max(F.struct(file, line)).alias("_end")).filter(F.col("n") >= n)
    first = df.groupBy(file).agg(F.min(line).alias("_first"))
    out = df.join(F.broadcast(reached), how="left").join(first, file)  # one row, or none below the cap
    here = F.struct(file, line) <= F.col("_end")
    later = (F.col(file) > F.col("_last")) & (F.col(line) == F.col("_first"))
    return out.filter(F.col("_end").isNull() | here | later).select(*df.columns)


def piece_vocabulary(pieces: DataFrame, piece: str, line: str, specials: list[str], mark: str = "▁") -> DataFrame:
    """pieces with gapless line numbers from 0 (line 0 is the unknown piece and left out) -> (id,
    token): the special tokens, then pieces, word-initial ones without their mark, others with ##."""
    spark = pieces.sparkSession
    token = F.when(F.col(piece).startswith(mark), F.expr(f"substring({piece}, {len(mark) + 1})")).otherwise(F.concat(F.lit("##"), piece))
    rest = pieces.filter(F.col(line) > 0).select((F.col(line) - 1 + len(specials)).cast("long").alias("id"), token.alias("token"))
    return spark.createDataFrame(list(enumerate(specials)), "id long, token string").union(rest)
