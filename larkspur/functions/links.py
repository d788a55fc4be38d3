"""URLs, object keys, file names and display labels."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Image file extensions accepted for ingestion.
IMAGE_EXTENSIONS = (".jpg", ".jpeg", ".png", ".webp", ".gif")


def image_url(photo_id: Column, host: str, extension: Column | None = None, size: str = "medium") -> Column:
    """``https://{host}/photos/{id}/{size}.{ext}``; the extension defaults to jpeg."""
    ext = F.lit("jpeg") if extension is None else extension
    return F.concat(F.lit(f"https://{host}/photos/"), photo_id.cast("string"), F.lit(f"/{size}."), ext)


def image_file_name(photo_id: Column, extension: Column) -> Column:
    return F.concat(F.lit("photos/"), photo_id.cast("string"), F.lit("/medium."), extension)


def photo_id_from_url(url: Column) -> Column:
    """Second-to-last path segment as a number; null when there is none."""
    segment = F.try_element_at(F.split(url, "/"), F.lit(-2))
    return segment.try_cast("bigint")


def is_store_uri(path: Column) -> Column:
    return F.startswith(path, F.lit("s3://")) | F.startswith(path, F.lit("s3a://"))


def store_uri_parts(uri: Column) -> Column:
    """``struct(bucket, key)`` of an object store URI; the key may be empty."""
    path = F.regexp_replace(uri, "^s3a?://", "")
    bucket = F.substring_index(path, "/", 1)
    key = F.when(F.instr(path, "/") > 0, F.substr(path, F.length(bucket) + 2)).otherwise(F.lit(""))
    return F.struct(bucket.alias("bucket"), key.alias("key"))


def key_extension(key: Column) -> Column:
    """Text from the last dot on, lower case; empty when there is no dot."""
    return F.lower(F.regexp_extract(key, r"\.[^.]*\z", 0))


def is_image_key(key: Column) -> Column:
    """The key ends in one of the image extensions, whatever the case."""
    lowered = F.lower(key)
    hit = F.lit(False)
    for ext in IMAGE_EXTENSIONS:
        hit = hit | F.endswith(lowered, F.lit(ext))
    return hit


def map_link(lat: Column, lon: Column) -> Column:
    return F.concat(F.lit("https://maps.google.com/?q="), lat.cast("string"), F.lit(","), lon.cast("string"))


def photo_page_link(photo_id: Column, site: str) -> Column:
    return F.concat(F.lit(site.rstrip("/") + "/photos/"), photo_id.cast("string"))


def taxon_label(name: Column, common_name: Column) -> Column:
    """``common (name)`` when there is a common name, else the name."""
    return F.when(
        common_name.isNotNull() & (common_name != ""),
        F.concat(common_name, F.lit(" ("), name, F.lit(")")),
    ).otherwise(name)
