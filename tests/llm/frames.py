"""Small frames with the cases that every operator must bear."""

from __future__ import annotations

from pyspark.sql import DataFrame

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows) -> DataFrame:
    """rows: (doc_id, text) or (doc_id, text, lang)."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "s", None if r[1] is None else len(r[1])) for r in rows]
    return spark.createDataFrame(full, DOCS)


def odd_documents(spark) -> DataFrame:
    """Nulls in every column, empty and very long texts, repeated rows, ties, and extra columns with clashing names."""
    long = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu. " * 9000
    rows = [(1, None), (2, ""), (3, "   \n\t "), (4, "one"), (5, long), (5, long), (6, "one"), (None, "some text here. and more of it."), (None, None), (7, "Ünïcode été 東京 ١٢٣ \U0001f600"), (8, "." * 5000), (9, "x" * 60000)]
    df = documents(spark, rows)
    from pyspark.sql import functions as F

    for name in ("score", "n_shingles", "spans", "digest", "node", "key", "_text", "n_words", "place", "span", "label", "toxic", "held_out"):
        df = df.withColumn(name, F.lit("clash"))
    return df.withColumn("lang", F.when(F.col("doc_id") == 4, None).otherwise(F.col("lang")))


def empty_documents(spark) -> DataFrame:
    return spark.createDataFrame([], DOCS)
