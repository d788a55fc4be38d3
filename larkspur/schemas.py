"""Fixed schemas of the tables and datasets."""

from __future__ import annotations

from pyspark.sql import types as T

_EMBEDDING = T.ArrayType(T.FloatType(), containsNull=False)

PHOTOS = T.StructType([
    T.StructField("photo_uuid", T.StringType()),
    T.StructField("photo_id", T.IntegerType()),
    T.StructField("observation_uuid", T.StringType()),
    T.StructField("observer_id", T.IntegerType()),
    T.StructField("extension", T.StringType()),
    T.StructField("license", T.StringType()),
    T.StructField("width", T.ShortType()),
    T.StructField("height", T.ShortType()),
    T.StructField("position", T.ShortType()),
    T.StructField("embedding", _EMBEDDING),
])

# The CSV dump has no embedding column.
PHOTOS_CSV = T.StructType([f for f in PHOTOS.fields if f.name != "embedding"])

OBSERVATIONS = T.StructType([
    T.StructField("observation_uuid", T.StringType()),
    T.StructField("observer_id", T.IntegerType()),
    T.StructField("latitude", T.DecimalType(15, 10)),
    T.StructField("longitude", T.DecimalType(15, 10)),
    T.StructField("positional_accuracy", T.IntegerType()),
    T.StructField("taxon_id", T.IntegerType()),
    T.StructField("quality_grade", T.StringType()),
    T.StructField("observed_on", T.DateType()),
    T.StructField("anomaly_score", T.DoubleType()),
])

OBSERVERS = T.StructType([
    T.StructField("observer_id", T.IntegerType()),
    T.StructField("login", T.StringType()),
    T.StructField("name", T.StringType()),
])

TAXA = T.StructType([
    T.StructField("taxon_id", T.IntegerType()),
    T.StructField("ancestry", T.StringType()),
    T.StructField("rank_level", T.DoubleType()),
    T.StructField("rank", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("active", T.BooleanType()),
])

IMAGE_DATASET = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("img_url", T.StringType()),
    T.StructField("file_name", T.StringType()),
    T.StructField("img_embedding", _EMBEDDING),
    T.StructField("latitude", T.FloatType()),
    T.StructField("longitude", T.FloatType()),
    T.StructField("positional_accuracy", T.FloatType()),
    T.StructField("observed_on", T.DateType()),
    T.StructField("taxon", T.StringType()),
])

EMBEDDING_STATUS = T.StructType([
    T.StructField("photo_id", T.IntegerType()),
    T.StructField("embedding", _EMBEDDING),
    T.StructField("status", T.BooleanType()),
])

PROCESSING_RESULT = T.StructType([
    T.StructField("key", T.StringType()),
    T.StructField("success", T.BooleanType()),
    T.StructField("error_message", T.StringType()),
])

SINK_STATUS = T.StructType([
    T.StructField("batch_id", T.StringType()),
    T.StructField("sink", T.StringType()),
    T.StructField("success", T.BooleanType()),
    T.StructField("error", T.StringType()),
    T.StructField("batch_size", T.LongType()),
])

CHECKPOINT = T.StructType([
    T.StructField("collection", T.StringType()),
    T.StructField("key", T.StringType()),
    T.StructField("processed_at", T.TimestampType()),
    T.StructField("run_id", T.StringType()),
])

TABLES = {
    "photos": PHOTOS,
    "observations": OBSERVATIONS,
    "observers": OBSERVERS,
    "taxa": TAXA,
}
