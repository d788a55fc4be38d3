"""Rows that every operator must cope with."""

from __future__ import annotations

LONG = "word " * 60_000 + "x" * 70_000
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
TEXTS = [
    (1, "The quick brown fox jumps over the lazy dog near the river bank today."),
    (2, "The quick brown fox jumps over the lazy dog near the river bank today."),
    (2, "The quick brown fox jumps over the lazy dog near the river bank today."),
    (3, ""), (4, None), (5, "   \n\t "), (6, "one two"), (7, "éß漢字 😀 <|endoftext|> ▁ 'll"), (8, LONG),
    (None, "a row without an id"), (None, None), (9, "12 34 -- ??"), (10, "\u0000 control \u0085 x"),
]


def documents(spark, rows=None):
    """The cases as a documents table; ``rows`` are id and text."""
    rows = TEXTS if rows is None else rows
    return spark.createDataFrame([(i, t, None, None, None if t is None else len(t)) for i, t in rows], SCHEMA)


def with_clashes(frame, names):
    """``frame`` with further columns that carry the names an operator adds."""
    from pyspark.sql import functions as F

    return frame.withColumns({n: F.lit("clash") for n in names if n not in frame.columns})


def tables(spark, folder, **frames):
    """A folder of tables for queries."""
    for name, frame in frames.items():
        frame.write.parquet(f"{folder}/{name}.parquet")
    return folder
