"""Point payloads, ids, filter documents and response shapes."""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T


def geo_point(latitude: Column, longitude: Column) -> Column:
    """``struct(lat, lon)``; each missing coordinate becomes 0.0 on its own."""
    return F.struct(
        F.coalesce(latitude.cast("double"), F.lit(0.0)).alias("lat"),
        F.coalesce(longitude.cast("double"), F.lit(0.0)).alias("lon"),
    )


def rfc3339_date(date: Column) -> Column:
    return F.coalesce(F.date_format(date, "yyyy-MM-dd"), F.lit(""))


def object_uri(bucket: Column, key: Column) -> Column:
    return F.concat(F.lit("s3://"), bucket, F.lit("/"), key)


def text_payload(bucket: Column, key: Column, text: Column) -> Column:
    """Payload of a text point."""
    return F.struct(
        key.alias("s3_key"),
        bucket.alias("s3_bucket"),
        object_uri(bucket, key).alias("s3_uri"),
        text.alias("text"),
    )


def point_id(uri: Column, mode: str = "deterministic") -> Column:
    """UUID of a point.

    ``deterministic`` formats the md5 of the URI as a UUID, so that ingesting
    an object again overwrites its point; ``random`` draws a version 4 UUID.
    """
    if mode == "random":
        return F.uuid()
    if mode != "deterministic":
        raise ValueError(f"unknown point id mode {mode!r}; use 'deterministic' or 'random'")
    digest = F.md5(uri.cast("binary"))
    cuts = ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))
    return F.concat_ws("-", *[F.substring(digest, start, length) for start, length in cuts])


_FILTER_DOCUMENT = T.StructType([
    T.StructField("species", T.StringType()),
    T.StructField("location", T.StructType([
        T.StructField("latitudeMin", T.StringType()),
        T.StructField("latitudeMax", T.StringType()),
        T.StructField("longitudeMin", T.StringType()),
        T.StructField("longitudeMax", T.StringType()),
    ])),
    T.StructField("start_date", T.StringType()),
    T.StructField("end_date", T.StringType()),
    T.StructField("months", T.ArrayType(T.StringType())),
])

FILTER_FIELDS = (
    "species", "latitude_min", "latitude_max", "longitude_min", "longitude_max",
    "start_date", "end_date", "months",
)


def parse_filters(document: Column) -> Column:
    """Struct of typed filters from the JSON text of a search form.

    Species defaults to the empty string; empty or unparsable bounds are null.
    """
    doc = F.from_json(document, _FILTER_DOCUMENT)

    def bound(name: str) -> Column:
        return F.nullif(doc["location"][name], F.lit("")).try_cast("double")

    return F.struct(
        F.coalesce(doc["species"], F.lit("")).alias("species"),
        bound("latitudeMin").alias("latitude_min"),
        bound("latitudeMax").alias("latitude_max"),
        bound("longitudeMin").alias("longitude_min"),
        bound("longitudeMax").alias("longitude_max"),
        doc["start_date"].try_cast("date").alias("start_date"),
        doc["end_date"].try_cast("date").alias("end_date"),
        doc["months"].alias("months"),
    )


def response_text(payload: Column) -> Column:
    """The ``text`` entry of a payload map, empty when missing."""
    return F.coalesce(F.try_element_at(payload, F.lit("text")), F.lit(""))


def response_metadata(payload: Column) -> Column:
    """The payload map without its ``text`` entry."""
    return F.map_filter(payload, lambda k, _: k != "text")
