"""Objects written from the pages, some without a byte, listed and scanned; arrivals with a lifetime."""

from __future__ import annotations

import struct
import zlib

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from larkspur.catalog.tables import table
from larkspur.session import scratch_path
from larkspur.sources.objects import list_objects, read_image_objects, read_text_objects, validate_images
from larkspur.streaming.jobs import arrivals_with_lifetime, object_stream, point_stream

# The first bytes of the formats.
_HEADS = (b"\xff\xd8\xff\xe0", b"\x89PNG\r\n\x1a\n", b"GIF89a", b"RIFF\0\0\0\0WEBP", b"no image at all")


def _write_objects(rows: DataFrame, root: str) -> None:
    """One file for each row ``key, content``, written by the tasks."""

    def write(batches):
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(root)
        n = 0
        for batch in batches:
            for key, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                system.create_dir(f"{base}/{key}".rsplit("/", 1)[0], recursive=True)
                with system.open_output_stream(f"{base}/{key}") as out:
                    out.write(content)
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n])], ["n"])

    rows.select("key", "content").mapInArrow(write, "n bigint").agg(F.sum("n")).collect()


def _root(spark, purpose: str) -> str:
    path = scratch_path(spark, purpose)
    return f"file://{path}" if path.startswith("/") else path


def _pages_as(spark, sf_dir, purpose: str, key: str, content) -> str:
    """Pages written as objects below a new folder; those whose number is divisible by seven are empty."""
    root = _root(spark, purpose)
    empty = F.when(F.col("page_id") % 7 == 0, F.unhex(F.lit(""))).otherwise(content)
    pages = table(spark, sf_dir, "pages").withColumn("html", F.coalesce("html", F.lit("")))
    _write_objects(pages.select(F.expr(key).alias("key"), empty.alias("content")), root)
    return root


_KEY = "concat('pages/', page_id % 4, '/', page_id, '.html')"


def listed_objects(spark, sf_dir):
    """Pages as objects in four folders, of which two are listed; nothing is opened."""
    root = _pages_as(spark, sf_dir, "listed", _KEY, F.encode("html", "UTF-8"))
    found = list_objects(spark, root, prefix="pages/1/").unionByName(list_objects(spark, root, prefix="pages/3"))
    return found.select("key", "length")


def scanned_texts(spark, sf_dir):
    """The same objects read as texts."""
    read = read_text_objects(spark, _pages_as(spark, sf_dir, "texts", _KEY, F.encode("html", "UTF-8")))
    return read.select("key", "success", F.md5(F.col("text").cast("binary")).alias("text_md5"))


def scanned_images(spark, sf_dir):
    """Pages behind the first bytes of four formats, or of none, scanned as images; some are empty, short or large."""
    head = F.element_at(F.array(*(F.lit(bytearray(h)) for h in _HEADS)), (F.col("page_id") % 5 + 1).cast("int"))
    content = F.concat(head, F.encode(F.when(F.col("page_id") % 9 == 1, F.left("html", F.lit(40))).otherwise(F.col("html")), "UTF-8"))
    key = "concat('images/', page_id % 3, '/', page_id, CASE WHEN page_id % 8 = 0 THEN '.txt' WHEN page_id % 8 = 1 THEN '.PNG' ELSE '.jpg' END)"
    read = read_image_objects(spark, _pages_as(spark, sf_dir, "images", key, content), max_bytes=1500)
    return read.select("key", "length", "size_bytes", "format", "success", "error_message", "reason")


@F.pandas_udf(T.BinaryType())
def _picture(ids: pd.Series, texts: pd.Series) -> pd.Series:
    """A grey PNG whose rows are bytes of the text; every third is cut off."""
    def chunk(tag: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + tag + body + struct.pack(">I", zlib.crc32(tag + body))

    def png(number: int, text: str) -> bytes:
        width = 16
        body = text.encode()[:width * 20].ljust(width, b" ")
        rows = [body[i:i + width] for i in range(0, len(body) - width + 1, width)]
        made = (_HEADS[1] + chunk(b"IHDR", struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0))
                + chunk(b"IDAT", zlib.compress(b"".join(b"\0" + r for r in rows))) + chunk(b"IEND", b""))
        return made[:40] if number % 3 == 0 else made

    return pd.Series([png(i, t) for i, t in zip(ids, texts)])


def validated_images(spark, sf_dir):
    """Pictures made of the pages, decoded completely: whole ones, cut off ones and empty ones."""
    root = _pages_as(spark, sf_dir, "pictures", "concat('p/', page_id % 2, '/', page_id, '.png')", _picture("page_id", "html"))
    found = validate_images(spark, root)
    return found.select(F.regexp_extract("path", "p/[01]/[0-9]+\\.png$", 0).alias("key"), "is_valid", "error")


def streamed_objects(spark, sf_dir):
    """The objects as a stream: what is there when it starts, then what is added."""
    root, where = _pages_as(spark, sf_dir, "stream-in", _KEY, F.encode("html", "UTF-8")), scratch_path(spark, "stream-out")
    checkpoint = scratch_path(spark, "stream-check")
    more = table(spark, sf_dir, "pages").select(
        F.concat(F.lit("later/"), F.col("page_id")).alias("key"), F.encode("url", "UTF-8").alias("content"))
    for turn in range(2):
        object_stream(spark, root).writeStream.format("parquet").option("checkpointLocation", checkpoint) \
            .trigger(availableNow=True).start(where).awaitTermination()
        if turn == 0:
            _write_objects(more, root)
    found = spark.read.parquet(where)
    return found.select(F.regexp_extract("key", "(pages|later)/[0-9/]+(\\.html)?$", 0).alias("key"),
                        F.length("content").cast("bigint").alias("length"))


def streamed_lifetimes(spark, sf_dir):
    """Users' events in files by fifth days: the first of a user, and the first at least two days after the last one."""
    events = table(spark, sf_dir, "events").select(
        F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("key"), "event_id")
    path, where = scratch_path(spark, "events"), scratch_path(spark, "lifetimes")
    # Files are taken by their time of writing, so each part is written after the one before.
    part = F.expr("datediff(ts, DATE '2024-01-01') div 5")
    for number in sorted(r.part for r in events.select(part.alias("part")).distinct().collect()):
        events.where(part == number).coalesce(1).sortWithinPartitions("ts", "event_id").write.mode("append").parquet(path)
    stream = point_stream(spark, path, events.schema, 1)
    arrivals_with_lifetime(stream, "key", "ts", 2 * 86_400, "40 days").writeStream.format("parquet") \
        .option("checkpointLocation", scratch_path(spark, "lifetimes-check")).trigger(availableNow=True).start(where).awaitTermination()
    return spark.read.schema(events.schema).parquet(where).select("key", "event_id")


QUERIES = {
    "listed_objects": listed_objects,
    "scanned_texts": scanned_texts,
    "scanned_images": scanned_images,
    "validated_images": validated_images,
    "streamed_objects": streamed_objects,
    "streamed_lifetimes": streamed_lifetimes,
}

_OBJECTS = """
given AS (SELECT page_id, url, CASE WHEN page_id % 7 = 0 THEN '' ELSE coalesce(html, '') END AS held,
                 'pages/' || page_id % 4 || '/' || page_id || '.html' AS key FROM pages)"""

ORACLES = {
    "listed_objects": f"WITH {_OBJECTS} SELECT key, strlen(held) AS length FROM given WHERE page_id % 4 IN (1, 3)",
    "scanned_texts": f"WITH {_OBJECTS} SELECT key, true AS success, md5(held) AS text_md5 FROM given",
    "streamed_objects": f"""
WITH {_OBJECTS} SELECT key, strlen(held) AS length FROM given UNION ALL SELECT 'later/' || page_id, strlen(url) FROM given""",
    "scanned_images": """
WITH given AS (
  SELECT page_id, CASE WHEN page_id % 7 = 0 THEN NULL ELSE page_id % 5 END AS kind,
         CASE WHEN page_id % 7 = 0 THEN 0
              ELSE [4, 8, 6, 12, 15][page_id % 5 + 1] + strlen(CASE WHEN page_id % 9 = 1 THEN left(html, 40) ELSE html END) END AS length,
         'images/' || page_id % 3 || '/' || page_id || CASE page_id % 8 WHEN 0 THEN '.txt' WHEN 1 THEN '.PNG' ELSE '.jpg' END AS key
  FROM (SELECT page_id, coalesce(html, '') AS html FROM pages) WHERE page_id % 8 <> 0),
judged AS (
  SELECT key, length, CASE WHEN length BETWEEN 12 AND 1500 THEN CASE kind WHEN 0 THEN 'jpeg' WHEN 1 THEN 'png' WHEN 2 THEN 'gif' WHEN 3 THEN 'webp' END END AS format
  FROM given)
SELECT key, length, length AS size_bytes, format, reason IS NULL AS success,
       CASE WHEN reason IS NOT NULL THEN 'Image fetch/validation failed' END AS error_message, reason
FROM (SELECT *, CASE WHEN length > 1500 THEN length || ' bytes, at most 1500 allowed'
                     WHEN length < 100 THEN 'only ' || length || ' bytes, at least 100 wanted'
                     WHEN format IS NULL THEN 'not a known image format' END AS reason FROM judged)""",
    "validated_images": """
SELECT 'p/' || page_id % 2 || '/' || page_id || '.png' AS key, page_id % 7 <> 0 AND page_id % 3 <> 0 AS is_valid,
       CASE WHEN page_id % 7 <> 0 AND page_id % 3 <> 0 THEN '' ELSE 'Invalid image format: cannot identify image' END AS error
FROM pages""",
    "streamed_lifetimes": """
WITH RECURSIVE passed AS (
  SELECT user_id, min(ts) AS ts FROM events GROUP BY user_id
  UNION ALL
  SELECT user_id, ts FROM (
    SELECT e.user_id, e.ts, row_number() OVER (PARTITION BY e.user_id, p.ts ORDER BY e.ts) AS n
    FROM events e JOIN passed p ON e.user_id = p.user_id AND e.ts >= p.ts + INTERVAL 2 DAY) WHERE n = 1)
SELECT user_id AS key, (SELECT min(event_id) FROM events e WHERE e.user_id = p.user_id AND e.ts = p.ts) AS event_id FROM passed p""",
}
