"""Text and image objects under a path prefix."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from larkspur.functions.images import (
    MAX_IMAGE_BYTES, MIN_IMAGE_BYTES, detect_image_format, image_dimensions, image_error,
)
from larkspur.functions.links import is_image_key
from larkspur.sources.listing import register_objects

FETCH_FAILED = "Failed to fetch or decode content"
IMAGE_FETCH_FAILED = "Image fetch/validation failed"


def _files(spark: SparkSession, path: str, glob: str | None, prefix: str = "", content: bool = True,
           max_bytes: int | None = None) -> DataFrame:
    """``key, path, modificationTime, length, content`` of the objects whose key starts with ``prefix``.

    Prefixes are listed by tasks, and objects of zero bytes are there too. Without ``content``, or above ``max_bytes``,
    an object is not opened and its content is null. A glob is matched with the object's name.
    """
    register_objects(spark)
    reader = spark.read.format("objects").option("keyPrefix", prefix).option("content", content)
    if max_bytes is not None:
        reader = reader.option("maxContentBytes", max_bytes)
    files = reader.load(path)
    if glob:
        names = re.escape(glob).replace(r"\*", "[^/]*").replace(r"\?", "[^/]")
        files = files.filter(F.col("key").rlike(f"(^|/){names}$"))
    return files


def object_key(path: Column, root: str | None = None) -> Column:
    """Key of a file path: the part below ``root``, or the whole path."""
    if root is None:
        return path
    marker = root.rstrip("/").split("://")[-1].lstrip("/") + "/"
    return F.when(F.instr(path, marker) > 0,
                  F.substr(path, F.instr(path, marker) + F.lit(len(marker)))).otherwise(path)


def list_objects(spark: SparkSession, path: str, prefix: str = "", glob: str | None = None) -> DataFrame:
    """``key, path, length, modificationTime`` of all objects whose key starts with ``prefix``.

    No object is opened; objects of zero bytes are listed as well.
    """
    return _files(spark, path, glob, prefix, content=False).select("key", "path", "length", "modificationTime")


def image_keys(keys: DataFrame, column: str = "key") -> DataFrame:
    """Rows whose key has an image extension."""
    return keys.filter(is_image_key(F.col(column)))


def decode_text(objects: DataFrame, content: str = "content") -> DataFrame:
    """Add ``text, success, error_message``: strict UTF-8, a bad object is a failed row."""
    text = F.col(content).cast("string")
    valid = F.col(content).isNotNull() & F.is_valid_utf8(text)
    return (
        objects
        .withColumn("success", F.coalesce(valid, F.lit(False)))
        .withColumn("text", F.when(F.col("success"), text))
        .withColumn("error_message", F.when(~F.col("success"), F.lit(FETCH_FAILED)))
        .drop(content)
    )


def read_text_objects(spark: SparkSession, path: str, prefix: str = "", glob: str | None = None) -> DataFrame:
    """``key, text, success, error_message`` of every object under the path."""
    files = _files(spark, path, glob, prefix).select("key", "content")
    return decode_text(files).select("key", "text", "success", "error_message")


def check_images(
    objects: DataFrame,
    content: str = "content",
    min_bytes: int = MIN_IMAGE_BYTES,
    max_bytes: int = MAX_IMAGE_BYTES,
    with_dimensions: bool = False,
) -> DataFrame:
    """Add ``format, size_bytes, success, error_message, reason`` and optionally the dimensions."""
    data = F.col(content)
    reason = image_error(data, min_bytes, max_bytes)
    out = (
        objects
        .withColumn("format", detect_image_format(data))
        .withColumn("size_bytes", F.length(data).cast("bigint"))
        .withColumn("reason", F.when(data.isNull(), F.lit(IMAGE_FETCH_FAILED)).otherwise(reason))
        .withColumn("success", F.col("reason").isNull())
        .withColumn("error_message", F.when(~F.col("success"), F.lit(IMAGE_FETCH_FAILED)))
    )
    if with_dimensions:
        size = image_dimensions(F.when(F.col("success"), data))
        out = out.withColumn("_size", size).withColumns(
            {"width": F.col("_size.width"), "height": F.col("_size.height")}).drop("_size")
    return out


def read_image_objects(
    spark: SparkSession,
    path: str,
    prefix: str = "",
    min_bytes: int = MIN_IMAGE_BYTES,
    max_bytes: int = MAX_IMAGE_BYTES,
    with_dimensions: bool = False,
) -> DataFrame:
    """Image objects with their format, size and verdict.

    The upper limit is applied to the listed size as well: an oversized file is never opened.
    """
    files = _files(spark, path, None, prefix, max_bytes=max_bytes).filter(is_image_key(F.col("key")))
    in_limit = files.filter(F.col("length") <= max_bytes)
    checked = check_images(in_limit, "content", min_bytes, max_bytes, with_dimensions)
    too_large = (
        files.filter(F.col("length") > max_bytes)
        .select("path", "modificationTime", "length", "key", F.col("length").alias("size_bytes"),
                F.concat(F.col("length").cast("string"), F.lit(f" bytes, at most {max_bytes} allowed")).alias("reason"),
                F.lit(False).alias("success"), F.lit(IMAGE_FETCH_FAILED).alias("error_message"))
    )
    return checked.unionByName(too_large, allowMissingColumns=True)


def validate_images(spark: SparkSession, path: str) -> DataFrame:
    """``path, is_valid, error``: every file under the path is decoded completely.

    The built-in image source marks a file it cannot decode with width -1. It
    has no WebP decoder, so WebP files are judged by their container header.
    A file without any bytes is no image.
    """
    decoded = spark.read.format("image").option("recursiveFileLookup", True).load(path)
    # The two sources write local paths with a different number of slashes.
    same = lambda column: F.regexp_replace(column, "^file:/+", "file:/")
    decoded = decoded.select(same(F.col("image.origin")).alias("path"), F.col("image.width").alias("width"))
    heads = _files(spark, path, None).select(
        same(F.col("path")).alias("path"), "length",
        detect_image_format(F.substring("content", 1, 32)).alias("format"),
    )
    joined = heads.join(decoded, "path", "left")
    valid = (F.col("width") > 0) | ((F.col("format") == "webp") & (F.col("length") >= 30))
    error = F.when(~F.coalesce(valid, F.lit(False)), F.lit("Invalid image format: cannot identify image")).otherwise(F.lit(""))
    return joined.select("path", (error == "").alias("is_valid"), error.alias("error"))


def split_outcomes(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The successful rows and the failed ones as ``key, success, error_message``."""
    failed = rows.filter(~F.col("success")).select("key", "success", "error_message")
    return rows.filter("success"), failed
