import pytest

#: Columns that operators use inside, as extra columns of the input.
CLASHING = ["_row", "_key", "_text", "_doc", "_draw", "_source", "size", "bits", "shard", "position", "before", "target", "ids", "score", "removed_lines"]

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def written(spark, tmp_path):
    """Writes rows as a table of ``files`` files and reads it back, optionally with clashing columns."""
    made = []

    def write(rows, schema=DOCS, clash=False, files=3):
        from pyspark.sql import functions as F

        df = spark.createDataFrame(rows, schema).repartition(files)
        if clash:
            df = df.select("*", *(F.lit(f"own {c}").alias(c) for c in CLASHING))
        made.append(f"{tmp_path}/t{len(made)}")
        df.write.parquet(made[-1])
        return spark.read.parquet(made[-1])

    return write


LONG = "\n".join(" ".join(f"w{i * j}" for j in range(1, 40)) for i in range(1, 200))


@pytest.fixture
def messy():
    """Nulls in every column, empty and very long texts, ties and whole rows repeated."""
    rows = [
        (1, "Alpha beta gamma\ndelta <|im_end|> password=hunter22x", "en", "a", 40),
        (1, "Alpha beta gamma\ndelta <|im_end|> password=hunter22x", "en", "a", 40),
        (2, None, "en", "a", None),
        (3, "", None, None, 0),
        (None, "no id here", "en", "b", 10),
        (None, "no id here", "en", "b", 10),
        (4, LONG, "de", "b", len(LONG)),
        (5, LONG, "de", None, len(LONG)),
        (6, "\n\n \n", "fr", "", 4),
        (7, "12 34 !! 🙂", "fr", "c", 10),
        (8, "é ß ç 日本 ΟΔΟΣ", None, "c", 14),
    ]
    return rows
