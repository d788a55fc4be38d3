"""Joins of photos, observations, observers, taxa and embeddings.

No join carries a broadcast hint: the taxa table and key sets are broadcast by
Spark itself when their size, read from the files or measured at run time, is
below the session's threshold, and are sort-merge joined otherwise. A hot key
is split by the adaptive skew join.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from larkspur.functions.links import image_file_name, image_url
from larkspur.functions.payload import rfc3339_date
from larkspur.session import stage


def canonical_uuid(column: Column) -> Column:
    return F.lower(F.trim(column))


def _with_canonical(df: DataFrame, key: str) -> DataFrame:
    if dict(df.dtypes)[key] == "string":
        return df.withColumn(key, canonical_uuid(F.col(key)))
    return df


def photo_observations(photos: DataFrame, observations: DataFrame, key: str = "observation_uuid") -> DataFrame:
    """Photos with their observation. The vector column stays out of the shuffle."""
    slim = photos.drop("embedding", "observer_id")
    return _with_canonical(slim, key).join(_with_canonical(observations, key), key)


def with_taxa(rows: DataFrame, taxa: DataFrame, how: str = "left") -> DataFrame:
    """Add the taxon name as ``taxon``; rows without a taxon stay unless ``how='inner'``."""
    names = taxa.select("taxon_id", F.col("name").alias("taxon"))
    return rows.join(names, "taxon_id", how)


def photo_metadata(photos: DataFrame, observations: DataFrame, taxa: DataFrame) -> DataFrame:
    """The nine columns the datasets are built from."""
    joined = with_taxa(photo_observations(photos, observations), taxa)
    return joined.select(
        "photo_id", "extension", "observer_id", "latitude", "longitude",
        "positional_accuracy", "observed_on", "taxon_id", "taxon", "observation_uuid",
    )


def first_rows(rows: DataFrame, n: int, by: str = "photo_id") -> DataFrame:
    """The first ``n`` rows in key order."""
    return rows.orderBy(by).limit(n)


def valid_embeddings(embeddings: DataFrame, status: str = "status") -> DataFrame:
    return embeddings.filter(F.col(status))


def enrich_embeddings(
    embeddings: DataFrame, photos: DataFrame, observations: DataFrame, taxa: DataFrame,
) -> DataFrame:
    """Valid embeddings with their photo metadata, one row per matching observation."""
    valid = valid_embeddings(embeddings).select("photo_id", "embedding")
    return photo_metadata(photos, observations, taxa).join(valid, "photo_id")


def latest_per_key(rows: DataFrame, keys: list[str], newest_first: list[Column]) -> DataFrame:
    """One row per key: the first in the given order.

    Spark cuts each key to one row per task before the shuffle
    (WindowGroupLimit), so a key that holds most rows does not travel.
    """
    order = Window.partitionBy(*keys).orderBy(*newest_first)
    return rows.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def row_tiebreak(df: DataFrame, keys: list[str]) -> Column:
    """A hash of the remaining columns: the same choice on every run."""
    rest = [c for c, t in df.dtypes if c not in keys and "map<" not in t]
    return F.xxhash64(*rest) if rest else F.lit(0)


def attach_embeddings(photos: DataFrame, embeddings: DataFrame, newest: Column | None = None) -> DataFrame:
    """Photos with the vector of the last valid embedding row per photo, else their own."""
    valid = valid_embeddings(embeddings)
    order = ([newest.desc()] if newest is not None else []) + [row_tiebreak(valid, ["photo_id"]).desc()]
    latest = latest_per_key(valid, ["photo_id"], order).select("photo_id", F.col("embedding").alias("_new"))
    merged = photos.join(latest, "photo_id", "left")
    return merged.withColumn("embedding", F.coalesce("_new", "embedding")).drop("_new").select(*photos.columns)


def photo_observers(photos: DataFrame, observers: DataFrame, how: str = "inner") -> DataFrame:
    return photos.join(observers, "observer_id", how)


def unprocessed(keys: DataFrame, processed: DataFrame, column: str = "key") -> DataFrame:
    """Rows whose key is not among the processed ones."""
    return keys.join(processed.select(column), column, "left_anti")


def suggest_taxa(taxa: DataFrame, prefix: str, n: int = 10, name: str = "name") -> DataFrame:
    """Up to ``n`` taxa whose name starts with the prefix, ignoring case; blank text suggests nothing."""
    text = (prefix or "").strip().lower()
    if not text:
        return taxa.limit(0)
    hits = taxa.filter(F.startswith(F.lower(F.col(name)), F.lit(text)))
    return hits.orderBy(name, *[c for c in taxa.columns if c != name][:1]).limit(n)


def image_dataset(rows: DataFrame, vector: str, host: str) -> DataFrame:
    """Embedded photo metadata in the layout of the image dataset."""
    photo = F.col("photo_id")
    return rows.select(
        photo.cast("bigint").alias("id"),
        image_url(photo, host, F.col("extension")).alias("img_url"),
        image_file_name(photo, F.col("extension")).alias("file_name"),
        F.col(vector).cast("array<float>").alias("img_embedding"),
        F.col("latitude").cast("float").alias("latitude"),
        F.col("longitude").cast("float").alias("longitude"),
        F.col("positional_accuracy").cast("float").alias("positional_accuracy"),
        "observed_on",
        "taxon",
    )


def image_points(rows: DataFrame, vector: str, host: str) -> DataFrame:
    """Collection rows of photos: coordinates stay null when unknown, dates stay dates."""
    photo = F.col("photo_id")
    return rows.select(
        photo.cast("bigint").alias("id"),
        F.col(vector).cast("array<float>").alias("vector"),
        image_url(photo, host, F.col("extension")).alias("img_url"),
        image_file_name(photo, F.col("extension")).alias("file_name"),
        F.struct(F.col("latitude").cast("double").alias("lat"),
                 F.col("longitude").cast("double").alias("lon")).alias("location"),
        F.col("positional_accuracy").cast("double").alias("positional_accuracy"),
        F.col("observed_on"),
        F.col("taxon").alias("species"),
        F.col("observation_uuid"),
    )


def image_response(results: DataFrame) -> DataFrame:
    """Search results over image points in the shape sent to a client."""
    return results.select(
        "query_id", "rank", "id", "img_url", "score", "file_name", "species",
        F.struct(F.coalesce("location.lat", F.lit(0.0)).alias("lat"),
                 F.coalesce("location.lon", F.lit(0.0)).alias("lon")).alias("location"),
        rfc3339_date(F.col("observed_on")).alias("observed_on"),
    )


def running_total(rows: DataFrame, key: str, weight: Column, out: str) -> DataFrame:
    """Add the sum of ``weight`` over all rows with a smaller key.

    Rows are range-partitioned by key; totals per range (one row each) give
    the start of every range, so no task sees more than its own range.
    """
    ranges = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    weighted = rows.withColumn("_w", weight.cast("bigint"))
    ranged = stage(weighted.repartitionByRange(ranges, key).withColumn("_range", F.spark_partition_id()), "ranges")
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("_range").agg(F.sum("_w").alias("_sum"))
    starts = totals.select("_range", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_start"))
    within = Window.partitionBy("_range").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    return (
        ranged.join(F.broadcast(starts), "_range")  # one row per range: at most spark.sql.shuffle.partitions rows
        .withColumn(out, F.col("_start") + F.coalesce(F.sum("_w").over(within), F.lit(0)))
        .drop("_w", "_range", "_start")
    )


def batch_numbers(keys: DataFrame, size: int, key: str = "key") -> DataFrame:
    """Number of the batch of ``size`` keys, in key order, each key belongs to."""
    if size < 1:
        raise ValueError("size must be at least 1")
    numbered = running_total(keys, key, F.lit(1), "_no")
    return numbered.withColumn("batch", F.floor(F.col("_no") / size).cast("bigint")).drop("_no")


def cycle_documents(chunks: DataFrame, n_documents: int, n_chunks: int | None = None) -> DataFrame:
    """``n_documents`` documents, number ``i`` carrying the chunk ``i mod n_chunks``.

    The chunks need a dense ``chunk_no`` from 0.
    """
    total = chunks.count() if n_chunks is None else n_chunks
    if total == 0:
        raise ValueError("no chunks to make documents from")
    wanted = chunks.sparkSession.range(n_documents).withColumn("chunk_no", F.pmod("id", F.lit(total)))
    text = chunks.select(F.col("chunk_no").cast("bigint").alias("chunk_no"), "text")
    joined = wanted.join(text, "chunk_no")
    return joined.select(
        F.col("id").alias("document_no"),
        F.format_string("doc-%05d.txt", F.col("id")).alias("name"),
        "text",
    )


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)
