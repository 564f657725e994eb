import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    """[(doc_id, text, lang, source)] -> a table like `documents`, n_chars from the text;
    further columns have names that operators might use themselves."""

    def make(rows, extra=False):
        rows = [(r + (None,) * 4)[:4] for r in rows]
        df = spark.createDataFrame([(*r, None if r[1] is None else len(r[1])) for r in rows], SCHEMA)
        if extra:
            df = df.selectExpr("*", *[f"'x' AS `{c}`" for c in ("id", "key", "row", "hash", "text_hash", "kept", "bucket", "shard", "size", "n", "t", "words", "pii", "label")])
        return df

    return make
