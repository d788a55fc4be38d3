"""Splitting texts into chunks of roughly equal size at sentence ends."""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

# Fixed value: where a sentence ends.
SENTENCE_END = r"[.!?]\s+[A-Z]|[.!?]\n"

#: Characters of text whose chunks a task holds at a time.
BLOCK_CHARS = 1 << 18

_ENDS = [re.compile(alternative) for alternative in SENTENCE_END.split("|")]


def sentence_ends(text: str) -> tuple[list[int], list[int]]:
    """Where the pattern matches and where the match ends, by place; at one place the first alternative comes first."""
    found = sorted((m.start(), rank, m.end()) for rank, one in enumerate(_ENDS) for m in one.finditer(text))
    return [f[0] for f in found], [f[2] for f in found]


def chunk_bounds(text: str, size: int, compat: bool) -> list[int]:
    """Ends of the chunks: at most ``size`` apart, and at the first sentence end in the last fifth of a chunk if any.

    Without ``compat`` a chunk ends after the punctuation mark; with it after the whole match, so the capital letter of
    the next sentence stays with the one before.
    """
    marks, ends = sentence_ends(text)
    bounds, low = [], 0
    while low < len(text):
        high = low + size
        if high >= len(text):
            bounds.append(len(text))
            break
        k = bisect.bisect_left(marks, max(low, high - size // 5))
        while k < len(marks) and marks[k] < high and ends[k] > high:
            k += 1
        if k < len(marks) and ends[k] <= high:
            high = ends[k] if compat else marks[k] + 1
        bounds.append(high)
        low = high
    return bounds


def chunk_list(text: str | None, size: int, compat: bool) -> list[dict]:
    """Chunks that hold more than white space, numbered from 0."""
    text = text or ""
    bounds = chunk_bounds(text, size, compat)
    pieces = ((a, b, text[a:b].strip()) for a, b in zip([0, *bounds], bounds))
    return [{"chunk_no": n, "start": a, "end": b, "text": t} for n, (a, b, t) in enumerate(p for p in pieces if p[2])]


def chunk_blocks(texts: Iterable[pa.StringScalar], size: int, compat: bool) -> Iterator[list[list[dict]]]:
    """Chunks of each text, in blocks of ``BLOCK_CHARS`` characters of text or one text."""
    block, held = [], 0
    for scalar in texts:
        text = scalar.as_py() or ""
        block.append(chunk_list(text, size, compat))
        held += len(text)
        if held >= BLOCK_CHARS:
            yield block
            block, held = [], 0
    if block:
        yield block


def chunk_text(text: Column, chunk_size: int = 500, compat: bool = False) -> Column:
    """``array<struct<chunk_no, start, end, text>>`` of a text column, empty chunks left out."""
    if chunk_size < 1:
        raise ValueError("chunk_size must be at least 1")

    kind = pa.list_(pa.struct([("chunk_no", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("text", pa.string())]))

    @F.arrow_udf(T.ArrayType(_CHUNK))
    def split(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            for chunks in chunk_blocks(batch, chunk_size, compat):
                yield pa.array(chunks, kind)

    return split(text.cast("string"))


def explode_chunks(
    documents: DataFrame, text: str = "text", chunk_size: int = 500, compat: bool = False,
) -> DataFrame:
    """One row per chunk with the other columns of its document."""
    chunked = documents.withColumn("_c", F.explode(chunk_text(F.col(text), chunk_size, compat)))
    kept = [c for c in documents.columns if c != text]
    return chunked.select(*kept, "_c.chunk_no", "_c.start", "_c.end", F.col("_c.text").alias("text"))


_CHUNK = T.StructType([
    T.StructField("chunk_no", T.IntegerType()), T.StructField("start", T.IntegerType()),
    T.StructField("end", T.IntegerType()), T.StructField("text", T.StringType()),
])


# Spark does not allow Arrow table functions on the right of a lateral join, which is how this one is used.
@F.udtf(returnType=_CHUNK)
class Chunks:
    """Table function form, for ``LATERAL chunks(text, size)`` in SQL; ``explode_chunks`` is the batched way."""

    def eval(self, text: str, size: int):
        for chunk in chunk_list(text, size, False):
            yield tuple(chunk.values())


def register_chunks(spark: SparkSession, name: str = "chunks") -> None:
    spark.udtf.register(name, Chunks)
