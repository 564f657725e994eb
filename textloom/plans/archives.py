"""Queries over archives of matrices, byte offsets of lines, cached features and shards of epochs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cache
from ..shared import kept, new_path
from ..sources import line_index, matrices
from .base import query
from .corpus import PAIRS, pairs

#: Documents of one file, and bytes of one block of it.
FILE_DOCS, BLOCK = 500, 100_000


@query("""SELECT vec_id, CAST((i - 1) // 8 AS BIGINT) AS frame, CAST((i - 1) % 8 AS BIGINT) AS place, round(embedding[i]::DOUBLE, 6) AS value FROM embeddings, range(1, 65) r(i)""")
def source_feature_archives(t):
    """Embeddings as matrices of eight rows, written as archives with an index, and read back by it."""
    e = t("embeddings")
    spark = e.sparkSession
    rows = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.slice("embedding", 8 * k + 1, F.lit(8)))
    folder = new_path(spark, "archives")
    written = kept(matrices.write_matrices(e.select("vec_id", rows.alias("m")), "vec_id", "m", folder), "written")
    matrices.write_index(written, f"{folder}/feats.scp")
    found = matrices.read_matrices(matrices.matrix_index(spark, f"{folder}/feats.scp"))
    cells = found.select("id", F.posexplode("features").alias("frame", "row")).select("id", "frame", F.posexplode("row").alias("place", "value"))
    return cells.select(F.col("id").cast("long").alias("vec_id"), F.col("frame").cast("long").alias("frame"), F.col("place").cast("long").alias("place"), F.round("value", 6).alias("value"))


def _files(t, d, folder: str) -> None:
    """Documents by id, FILE_DOCS to a file, one after the other."""
    d.withColumn("file", F.floor(F.col("doc_id") / FILE_DOCS)).repartition("file").sortWithinPartitions("file", "doc_id").select("file", "text").write.partitionBy("file").text(folder)


@query(f"""WITH d AS (SELECT doc_id, doc_id // {FILE_DOCS} AS file, CASE WHEN doc_id % 2 = 0 THEN replace(text, chr(10), chr(13) || chr(10)) || chr(13) ELSE text END AS text FROM documents WHERE text IS NOT NULL),
l AS (SELECT file, doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS k FROM d),
o AS (SELECT file, row_number() OVER w - 1 AS line_no, sum(strlen(line) + 1) OVER w - strlen(line) - 1 AS start, line FROM l WINDOW w AS (PARTITION BY file ORDER BY doc_id, k))
SELECT file, line_no, CAST(start AS BIGINT) AS start, rtrim(line, chr(13)) AS line FROM o WHERE trim(rtrim(line, chr(13))) <> ''""")
def source_line_offsets(t):
    """Files of several blocks, with line ends of both kinds: where each line stands, and the line there."""
    d = t("documents").filter("text is not null")
    spark = d.sparkSession
    folder = new_path(spark, "lines")
    text = F.when(F.col("doc_id") % 2 == 0, F.concat(F.replace("text", F.lit("\n"), F.lit("\r\n")), F.lit("\r"))).otherwise(F.col("text"))
    _files(t, d.select("doc_id", text.alias("text")), folder)
    found = line_index.lines_at(line_index.line_index(spark, folder, block=BLOCK))
    return found.select(F.regexp_extract("file", "/file=([0-9]+)/", 1).cast("long").alias("file"), "line_no", F.col("offset").alias("start"), "line")


@query(f"""SELECT doc_id // {FILE_DOCS} AS file, CAST(sum(length(CASE WHEN doc_id < {FILE_DOCS} THEN text || text || 'x' ELSE text END)) - sum((length(text) - length(replace(text, chr(10), ''))) * CASE WHEN doc_id < {FILE_DOCS} THEN 2 ELSE 1 END) AS BIGINT) AS n_chars,
count(DISTINCT doc_id // {FILE_DOCS}) + CASE WHEN doc_id // {FILE_DOCS} = 0 THEN 1 ELSE 0 END AS built FROM documents WHERE text IS NOT NULL GROUP BY doc_id // {FILE_DOCS}""")
def cached_features(t):
    """Characters of files; one file is changed, and it alone is built again."""
    d = t("documents").filter("text is not null").select("doc_id", "text")
    spark = d.sparkSession
    folder, store = new_path(spark, "texts"), new_path(spark, "cache")
    build = lambda lines: lines.groupBy("file").agg(F.sum(F.char_length("value")).alias("n_chars"))
    _files(t, d, folder)
    cache.cached_features(spark, folder, {"unit": "characters"}, build, store)
    changed = d.filter(F.col("doc_id") < FILE_DOCS).select("doc_id", F.concat("text", "text", F.lit("x")).alias("text"))
    changed.repartition(1).sortWithinPartitions("doc_id").select("text").write.mode("overwrite").text(f"{folder}/file=0")  # one file's rows
    found, _ = cache.cached_features(spark, folder, {"unit": "characters"}, build, store)
    number = lambda c: F.regexp_extract(c, "/file=([0-9]+)/", 1).cast("long")
    times = spark.read.parquet(f"{store}/index").groupBy(number("file").alias("file")).agg(F.count("*").alias("built"))
    return found.select(number("file").alias("file"), "n_chars").join(times, "file")


@query("""WITH s AS (SELECT lang, row_number() OVER (ORDER BY md5('4:2:' || lang), lang) - 1 AS turn FROM (SELECT DISTINCT lang FROM documents WHERE lang IS NOT NULL))
SELECT doc_id, turn, row_number() OVER (PARTITION BY lang ORDER BY md5('4:2:' || doc_id), doc_id) - 1 AS place FROM documents JOIN s USING (lang)""")
def epoch_order(t):
    d = t("documents").filter("lang is not null").select("doc_id", "lang")
    return cache.epoch_order(d, "lang", "doc_id", epoch=2, seed=4).select("doc_id", "turn", "place")


def _line_sql(c: str) -> str:
    return f"replace({c}, chr(10), ' ')"


_TASKS = ("mrpc", "mnli", "mnli-mm", "cola", "sst-2", "sts-b", "qqp", "qnli", "rte", "wnli")


@query(f"""SELECT task, 'dev-' || CASE WHEN task IN ('mrpc', 'cola', 'sst-2') THEN NULL ELSE CAST(conv_id * 100 + turn AS VARCHAR) END AS guid, {_line_sql('src')} AS text_a, CASE WHEN task IN ('cola', 'sst-2') THEN NULL ELSE {_line_sql('tgt')} END AS text_b, 'l' || turn % 2 AS label
FROM {PAIRS}, (SELECT unnest({list(_TASKS)}) AS task)""")
def source_pair_tasks(t):
    """Each turn with the next as a row of every sentence-pair format, read back; ids that are line
    numbers depend on the files and are left out."""
    from ..sources import readers

    line = lambda c: F.translate(c, "\n", " ").alias(c)
    p = kept(pairs(t).select("conv_id", "turn", line("src"), line("tgt")), "pairs")  # joined once for all formats
    spark = p.sparkSession
    found = None
    for task in _TASKS:
        a, b, label, header, by_column = readers.PAIR_TASKS[task]
        width = max(a, b or 0, label) + 1 + (label < 0)
        cells = {a: F.col("src"), label % width: F.concat(F.lit("l"), (F.col("turn") % 2).cast("string"))}
        if b is not None:
            cells[b] = F.col("tgt")
        if by_column:
            cells[0] = (F.col("conv_id") * 100 + F.col("turn")).cast("string")
        rows = p.select(*[cells.get(k, F.lit("-")).alias(f"c{k}") for k in range(width)])
        path = new_path(spark, task)
        rows.write.option("header", str(header).lower()).option("sep", "\t").option("quote", "").option("ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false").csv(path)
        own = readers.sentence_pairs(spark, path, task, "dev").select(F.lit(task).alias("task"), (F.col("guid") if by_column else F.lit(None).cast("string")).alias("guid"), "text_a", "text_b", "label")
        found = own if found is None else found.union(own)
    return found
