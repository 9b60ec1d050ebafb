"""Small tables with the awkward cases: nulls, empty and long texts, repeated rows, clashing names."""

SF = "/root/testdata/sf0.001"

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def awkward(spark, texts=()):
    """Rows with null ids, null, empty, blank and long texts, and a repeated row."""
    rows = [
        (1, None, "en", "s", 0), (2, "", "en", "s", 0), (3, " \n\t ", None, "s", 4), (None, "no id here", "en", None, None),
        (4, "one", "en", "s", 3), (5, "twice " * 3, "en", "s", 18), (5, "twice " * 3, "en", "s", 18), (6, "!!! ... 123", "en", "s", 11),
        (7, "a very long text with many words " * 20_000, "en", "s", 660_000), (8, "ÀÉ ñandú 日本語 ſ", "es", "s", 15),
    ]
    return spark.createDataFrame(rows + [(100 + i, t, "en", "s", len(t)) for i, t in enumerate(texts)], SCHEMA)


def no_documents(spark):
    return spark.createDataFrame([], SCHEMA)


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)
