"""Joins, datasets, run statistics and benchmarks over the order tables.

Lineitem stands for photos, orders for observations, customers with a positive
balance for taxa and suppliers for observers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from larkspur.catalog.search import ORACLES as _SEARCH
from larkspur.catalog.tables import LABEL_QUERIES, PLACED_SQL, label_queries, points, score_sql, table, vector_md5, vector_md5_sql
from larkspur.operators.collections import CollectionStore
from larkspur.operators.metrics import classify_errors, progress, sink_rollup, summarize_run
from larkspur.operators.relational import (
    attach_embeddings, batch_numbers, enrich_embeddings, first_rows, image_points, image_response, latest_per_key, photo_metadata,
    photo_observers, photo_observations, unprocessed, valid_embeddings, with_taxa,
)
from larkspur.operators.search import search_batch
from larkspur.plans.benchmark import run_benchmark
from larkspur.plans.datasets import build_collection, build_image_dataset, reembedded_and_failures
from larkspur.session import scratch_path
from larkspur.streaming.jobs import point_stream, upsert_stream

HOST = "images.example.org"


def photos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("photo_uuid"),
        F.col("l_partkey").cast("int").alias("photo_id"),
        F.concat(F.lit(" OBS-"), F.col("l_orderkey").cast("string")).alias("observation_uuid"),
        F.col("l_suppkey").cast("int").alias("observer_id"),
        F.when(F.pmod("l_orderkey", F.lit(2)) == 0, F.lit("jpg")).otherwise(F.lit("png")).alias("extension"),
        F.lit(None).cast("array<float>").alias("embedding"),
    )


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("obs-"), key.cast("string")).alias("observation_uuid"),
        F.col("o_custkey").cast("int").alias("observer_id"),
        (F.pmod(key, F.lit(180)) - 90).cast("decimal(15,10)").alias("latitude"),
        F.when(F.col("o_orderstatus") != "P", F.pmod(key, F.lit(360)) - 180).cast("decimal(15,10)").alias("longitude"),
        F.length("o_orderpriority").alias("positional_accuracy"),
        F.when(F.col("o_orderstatus") != "F", F.col("o_custkey")).cast("int").alias("taxon_id"),
        F.col("o_orderdate").cast("date").alias("observed_on"),
    )


def taxa(spark: SparkSession, sf_dir: str) -> DataFrame:
    rich = table(spark, sf_dir, "customer").filter(F.col("c_acctbal") > 0)
    return rich.select(F.col("c_custkey").cast("int").alias("taxon_id"), F.col("c_name").alias("name"))


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").cast("int").alias("photo_id"), "embedding", (F.col("label") < 8).alias("status"))


def _metadata(spark, sf_dir):
    return photo_metadata(photos(spark, sf_dir), observations(spark, sf_dir), taxa(spark, sf_dir))


def photo_rows(spark, sf_dir):
    rows = _metadata(spark, sf_dir)
    return rows.select("photo_id", "extension", "observer_id", F.col("latitude").cast("double").alias("latitude"),
                       F.col("longitude").cast("double").alias("longitude"), "positional_accuracy", "observed_on",
                       "taxon_id", "taxon", "observation_uuid")


def photo_rows_with_taxon(spark, sf_dir):
    """The inner variant: only photos whose taxon is known."""
    joined = photo_observations(photos(spark, sf_dir), observations(spark, sf_dir))
    known = with_taxa(joined, taxa(spark, sf_dir), "inner")
    return known.groupBy("taxon").agg(F.count(F.lit(1)).alias("photos"))


def first_photos(spark, sf_dir):
    slim = _metadata(spark, sf_dir).select("photo_id", "observation_uuid").distinct()
    return first_rows(slim.withColumn("key", F.struct("photo_id", "observation_uuid")), 25, "key").drop("key")


def observed_photos(spark, sf_dir):
    people = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").cast("int").alias("observer_id"), F.col("s_name").alias("login"))
    joined = photo_observers(photos(spark, sf_dir), people)
    return joined.groupBy("login").agg(F.count(F.lit(1)).alias("photos"))


def enriched_embeddings(spark, sf_dir):
    rows = enrich_embeddings(embeddings(spark, sf_dir), photos(spark, sf_dir), observations(spark, sf_dir),
                             taxa(spark, sf_dir))
    return rows.select("photo_id", "observation_uuid", "extension", "taxon", "observed_on", vector_md5("embedding").alias("vector_md5"))


def attached_embeddings(spark, sf_dir):
    """Parts as photos; every vector comes twice, and the later version, turned round, wins."""
    parts = table(spark, sf_dir, "part").select(
        F.col("p_partkey").cast("int").alias("photo_id"), F.array(F.col("p_size").cast("float")).alias("embedding"))
    old = embeddings(spark, sf_dir).withColumn("version", F.lit(1))
    new = old.withColumn("version", F.lit(2)).withColumn("embedding", F.transform("embedding", lambda x: -x))
    merged = attach_embeddings(parts, old.unionByName(new), F.col("version"))
    return merged.select("photo_id", F.size("embedding").cast("bigint").alias("dim"), vector_md5("embedding").alias("vector_md5"))


def valid_embedding_counts(spark, sf_dir):
    return valid_embeddings(embeddings(spark, sf_dir)).agg(F.count(F.lit(1)).alias("valid"))


def photo_dataset(spark, sf_dir):
    """Image dataset whose picture bytes are document texts."""
    images = table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("int").alias("photo_id"), F.encode("text", "UTF-8").alias("content"))
    built = build_image_dataset(photos(spark, sf_dir), observations(spark, sf_dir), taxa(spark, sf_dir), images,
                                "byte_histogram", HOST, scratch_path(spark, "dataset"))
    return built.groupBy("id", "img_url", "file_name", "observed_on", "taxon").agg(
        F.count(F.lit(1)).alias("n"), F.max(F.size("img_embedding")).cast("bigint").alias("dim"),
        F.round(F.sum(F.col("latitude").cast("double")), 4).alias("latitudes"))


def photo_collection(spark, sf_dir):
    """Collection of valid embeddings with metadata, one point per photo."""
    store = CollectionStore(spark, scratch_path(spark, "store"))
    build_collection(store, "photos", embeddings(spark, sf_dir), photos(spark, sf_dir), observations(spark, sf_dir),
                     taxa(spark, sf_dir), HOST, 64, n_buckets=8)
    return store.read("photos").select("id", "observation_uuid", "file_name", vector_md5("vector").alias("vector_md5"))


def streamed_photos(spark, sf_dir):
    """Embeddings arrive as a stream; each batch is joined to the metadata tables and upserted."""
    store, source = CollectionStore(spark, scratch_path(spark, "store")), table(spark, sf_dir, "embeddings")
    store.create("photos", 64, n_buckets=8)

    def with_metadata(batch: DataFrame) -> DataFrame:
        shaped = batch.select(F.col("vec_id").cast("int").alias("photo_id"), "embedding", (F.col("label") < 8).alias("status"))
        rows = enrich_embeddings(shaped, photos(spark, sf_dir), observations(spark, sf_dir), taxa(spark, sf_dir))
        return image_points(rows, "embedding", HOST)

    stream = point_stream(spark, f"{sf_dir}/embeddings*.parquet", source.schema)
    upsert_stream(stream, store, "photos", scratch_path(spark, "stream"), "observation_uuid", enrich=with_metadata)
    return store.read("photos").select("id", "observation_uuid", "file_name", vector_md5("vector").alias("vector_md5"))


def photo_search_response(spark, sf_dir):
    """Search over the photo collection in the shape sent to a client."""
    store = CollectionStore(spark, scratch_path(spark, "store"))
    build_collection(store, "photos", embeddings(spark, sf_dir), photos(spark, sf_dir), observations(spark, sf_dir),
                     taxa(spark, sf_dir), HOST, 64, n_buckets=8)
    collection = store.read("photos")
    found = search_batch(collection, label_queries(spark, sf_dir), 5)
    columns = ["img_url", "file_name", "species", "location", "observed_on"]
    payload = collection.select("id", *columns)
    shaped = image_response(payload.join(found, "id"))
    return shaped.select("query_id", "rank", "id", "img_url", F.round("score", 6).alias("score"), "file_name", "species",
                         F.col("location.lat").alias("lat"), F.col("location.lon").alias("lon"), "observed_on")


def _reembedded(spark, sf_dir, pictures="true"):
    """Pages as a picture dataset; some have no picture signature, those without ``pictures`` no picture."""
    pages = table(spark, sf_dir, "pages")
    url = F.concat(F.lit("https://images.example.org/photos/"), F.col("page_id").cast("string"), F.lit("/medium.jpg"))
    dataset = pages.select(url.alias("img_url"), F.concat(F.lit("photos/"), F.col("page_id").cast("string")).alias("file_name"))
    head = F.when(F.startswith("url", F.lit("https")), F.unhex(F.lit("FFD8FFE0"))).otherwise(F.unhex(F.lit("00000000")))
    images = pages.where(pictures).select(url.alias("img_url"), F.concat(head, F.encode("html", "UTF-8")).alias("content"))
    return reembedded_and_failures(dataset, images, "byte_histogram", scratch_path(spark, "reembedded"))


def reembedded_pages(spark, sf_dir):
    """Rows of the picture dataset that got a new vector."""
    out = _reembedded(spark, sf_dir)[0]
    return out.select("id", "img_url", "file_name", F.size("img_embedding").cast("bigint").alias("dim"))


def reembedding_failures(spark, sf_dir):
    """Rows of the picture dataset that got none, and why; here every thirteenth page lacks its picture."""
    return _reembedded(spark, sf_dir, "page_id % 13 <> 0")[1]


# Runs ---------------------------------------------------------------------------


def _results(spark, sf_dir):
    message = F.when(F.col("event_type") == "error", F.when(F.col("value") > 60, F.lit("upstream timeout"))
                     .when(F.col("value") > 30, F.lit("Circuit Breaker open (upstream)")).otherwise(F.lit("bad text")))
    return table(spark, sf_dir, "events").select(
        F.col("event_id").cast("string").alias("key"), "user_id", "event_type",
        (F.col("event_type") != "error").alias("success"), message.alias("error_message"))


def run_summary(spark, sf_dir):
    return summarize_run(_results(spark, sf_dir), 12.5)


def run_progress(spark, sf_dir):
    return progress(_results(spark, sf_dir), 250_000, 12.5, ["event_type"])


def failure_classes(spark, sf_dir):
    return classify_errors(_results(spark, sf_dir))


def sink_status_rollup(spark, sf_dir):
    """Event types as two sinks of one batch per user."""
    status = table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("batch_id"), (F.col("value") > 1).alias("success"),
        F.col("event_id").alias("batch_size"))
    return sink_rollup(status)


def key_batches(spark, sf_dir):
    """Batches of 50 keys in key order."""
    keys = table(spark, sf_dir, "documents").select(F.format_string("inputs/doc-%06d.txt", "doc_id").alias("key"))
    return batch_numbers(keys, 50)


def pending_documents(spark, sf_dir):
    """Documents without a label: the labelled ones count as processed."""
    keys = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), "lang")
    done = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("key")).distinct()
    return unprocessed(keys, done)


def merged_results(spark, sf_dir):
    """Union of successes and failures, then the distinct keys of both."""
    rows = _results(spark, sf_dir).select(F.col("user_id").cast("string").alias("key"), "success")
    both = rows.filter("success").unionByName(rows.filter(~F.col("success")))
    return both.select("key").distinct()


def last_event_per_user(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "event_type")
    return latest_per_key(events, ["user_id"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id", "event_type")


def benchmark_recall(spark, sf_dir):
    """Benchmark of the four metrics against the exact cosine results; timings are left out."""
    rows, queries = points(spark, sf_dir), label_queries(spark, sf_dir)
    exact = search_batch(rows, queries, 10, "cosine")
    searches = {m: (lambda q, m=m: search_batch(rows, q, 10, m)) for m in ("cosine", "l1")}
    report = run_benchmark(queries, searches, exact, 10, rounds=1, metrics_root=scratch_path(spark, "metrics"))
    return report.select("engine", F.col("topk").cast("bigint").alias("topk"), "queries", F.round("recall", 6).alias("recall"))


QUERIES = {
    "photo_rows": photo_rows,
    "photo_rows_with_taxon": photo_rows_with_taxon,
    "first_photos": first_photos,
    "observed_photos": observed_photos,
    "enriched_embeddings": enriched_embeddings,
    "attached_embeddings": attached_embeddings,
    "valid_embedding_counts": valid_embedding_counts,
    "photo_dataset": photo_dataset,
    "photo_collection": photo_collection,
    "streamed_photos": streamed_photos,
    "photo_search_response": photo_search_response,
    "reembedded_pages": reembedded_pages,
    "reembedding_failures": reembedding_failures,
    "run_summary": run_summary,
    "run_progress": run_progress,
    "failure_classes": failure_classes,
    "sink_status_rollup": sink_status_rollup,
    "key_batches": key_batches,
    "pending_documents": pending_documents,
    "merged_results": merged_results,
    "last_event_per_user": last_event_per_user,
    "benchmark_recall": benchmark_recall,
}

_PHOTOS = """
photos AS (SELECT l_partkey AS photo_id, l_orderkey, CASE WHEN l_orderkey % 2 = 0 THEN 'jpg' ELSE 'png' END AS extension FROM lineitem),
obs AS (SELECT o_orderkey, 'obs-' || o_orderkey AS observation_uuid, o_custkey::INTEGER AS observer_id,
               (o_orderkey % 180 - 90)::DOUBLE AS latitude,
               CASE WHEN o_orderstatus <> 'P' THEN (o_orderkey % 360 - 180)::DOUBLE END AS longitude,
               length(o_orderpriority)::INTEGER AS positional_accuracy, o_orderdate::DATE AS observed_on,
               CASE WHEN o_orderstatus <> 'F' THEN o_custkey::INTEGER END AS taxon_id FROM orders),
taxa AS (SELECT c_custkey::INTEGER AS taxon_id, c_name AS taxon FROM customer WHERE c_acctbal > 0),
meta AS (SELECT photo_id::INTEGER AS photo_id, extension, observer_id, latitude, longitude, positional_accuracy, observed_on,
                obs.taxon_id, taxon, observation_uuid
         FROM photos JOIN obs ON o_orderkey = l_orderkey LEFT JOIN taxa ON taxa.taxon_id = obs.taxon_id)"""

_URL = f"'https://{HOST}/photos/' || photo_id || '/medium.' || extension"
_FILE = "'photos/' || photo_id || '/medium.' || extension"

# The point of a photo is its row with the highest observation.
_POINTS = """
chosen AS (SELECT DISTINCT m.*, v FROM meta m JOIN placed ON vec_id = m.photo_id WHERE label < 8
           AND m.observation_uuid = (SELECT max(o.observation_uuid) FROM meta o WHERE o.photo_id = m.photo_id))"""

ORACLES = {
    "photo_rows": f"WITH {_PHOTOS} SELECT * FROM meta",
    "photo_rows_with_taxon": f"WITH {_PHOTOS} SELECT taxon, count(*) AS photos FROM meta WHERE taxon IS NOT NULL GROUP BY taxon",
    "first_photos": f"WITH {_PHOTOS} SELECT DISTINCT photo_id, observation_uuid FROM meta ORDER BY 1, 2 LIMIT 25",
    "observed_photos": "SELECT s_name AS login, count(*) AS photos FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1",
    "enriched_embeddings": f"""
WITH {_PHOTOS} SELECT photo_id, observation_uuid, extension, taxon, observed_on, {vector_md5_sql('embedding')} AS vector_md5
FROM meta JOIN embeddings ON vec_id = photo_id WHERE label < 8""",
    "attached_embeddings": f"""
SELECT p_partkey::INTEGER AS photo_id, CASE WHEN vec_id IS NULL THEN 1 ELSE len(embedding) END::BIGINT AS dim,
       {vector_md5_sql('CASE WHEN vec_id IS NULL THEN [p_size::FLOAT] ELSE list_transform(embedding, lambda y: -y) END')} AS vector_md5
FROM part LEFT JOIN (SELECT * FROM embeddings WHERE label < 8) ON vec_id = p_partkey""",
    "valid_embedding_counts": "SELECT count(*) AS valid FROM embeddings WHERE label < 8",
    "photo_dataset": f"""
WITH {_PHOTOS} SELECT photo_id::BIGINT AS id, {_URL} AS img_url, {_FILE} AS file_name, observed_on, taxon, count(*) AS n,
       64::BIGINT AS dim, round(sum(latitude), 4) AS latitudes
FROM meta JOIN documents ON doc_id = photo_id GROUP BY ALL""",
    "photo_collection": f"""
WITH {PLACED_SQL}, {_PHOTOS}, {_POINTS}
SELECT photo_id::BIGINT AS id, observation_uuid, {_FILE} AS file_name, {vector_md5_sql('v')} AS vector_md5 FROM chosen""",
    "photo_search_response": f"""
WITH {LABEL_QUERIES}, {PLACED_SQL}, {_PHOTOS}, {_POINTS}
SELECT query_id, rank, id, img_url, round(score, 6) AS score, file_name, species, lat, lon, observed_on FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (
    SELECT query_id, photo_id::BIGINT AS id, {_URL} AS img_url, {score_sql('cosine', 'v', 'q')} AS score,
           {_FILE} AS file_name, taxon AS species, coalesce(latitude, 0.0) AS lat, coalesce(longitude, 0.0) AS lon,
           strftime(observed_on, '%Y-%m-%d') AS observed_on
    FROM chosen, label_queries))
WHERE rank <= 5""",
    "run_summary": """
SELECT count(*) FILTER (WHERE event_type <> 'error') AS successful, count(*) FILTER (WHERE event_type = 'error') AS failed,
       count(*) AS total, 12.5::DOUBLE AS elapsed_seconds, round(count(*) / 12.5::DOUBLE, 2) AS rate_per_sec FROM events""",
    "run_progress": """
SELECT event_type, count(*) AS completed, 250000::BIGINT AS total, round(100.0::DOUBLE * count(*) / 250000, 1) AS percent,
       12.5::DOUBLE AS elapsed_seconds, round(count(*) / 12.5::DOUBLE, 1) AS docs_per_second, 250000 - count(*) AS pending
FROM events GROUP BY event_type""",
    "failure_classes": """
SELECT CASE WHEN value > 60 THEN 'upstream' WHEN value > 30 THEN 'circuit_breaker' ELSE 'other' END AS error_class,
       count(*) AS failures FROM events WHERE event_type = 'error' GROUP BY 1""",
    "sink_status_rollup": """
SELECT user_id::VARCHAR AS batch_id, bool_or(value > 1) AS any_success, bool_and(value > 1) AS all_success,
       max(event_id) AS batch_size FROM events GROUP BY user_id""",
    "key_batches": """
SELECT key, (row_number() OVER (ORDER BY key) - 1) // 50 AS batch
FROM (SELECT format('inputs/doc-{:06d}.txt', doc_id) AS key FROM documents)""",
    "pending_documents": "SELECT doc_id AS key, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "merged_results": "SELECT DISTINCT user_id::VARCHAR AS key FROM events",
    "last_event_per_user": """
SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""",
    "benchmark_recall": f"""
WITH r AS ({_SEARCH['recall_l1_vs_cosine']})
SELECT 'cosine' AS engine, 10::BIGINT AS topk, queries, 1.0::DOUBLE AS recall FROM r
UNION ALL SELECT 'l1', 10, queries, recall FROM r""",
    "reembedded_pages": """
SELECT page_id AS id, 'https://images.example.org/photos/' || page_id || '/medium.jpg' AS img_url,
       'photos/' || page_id AS file_name, 64::BIGINT AS dim
FROM pages WHERE starts_with(url, 'https')""",
    "reembedding_failures": """
SELECT 'https://images.example.org/photos/' || page_id || '/medium.jpg' AS img_url,
       CASE WHEN page_id % 13 = 0 THEN 'no picture' ELSE 'not a known image format' END AS error_message, NULL::VARCHAR AS cause
FROM pages WHERE page_id % 13 = 0 OR NOT starts_with(url, 'https')""",
}
ORACLES["streamed_photos"] = ORACLES["photo_collection"]
