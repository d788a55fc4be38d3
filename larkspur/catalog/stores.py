"""Collections, checkpoints, ingestion jobs and streams."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from larkspur.catalog.tables import embed_sql, label_queries, points, table
from larkspur.catalog.texts import FailsOnLongText
from larkspur.operators.collections import CollectionStore
from larkspur.operators.embedding import EmbedPolicy
from larkspur.operators.metrics import sink_rollup
from larkspur.operators.search import search_batch
from larkspur.operators.sinks import Checkpoint, key_documents, write_sinks
from larkspur.plans.ingest import Target, ingest_documents, ingest_images, retry_failures
from larkspur.session import scratch_path, stage
from larkspur.streaming.jobs import first_arrivals, ingest_stream, point_stream, upsert_stream


def _store(spark: SparkSession) -> CollectionStore:
    return CollectionStore(spark, scratch_path(spark, "store"))


def _turn_points(turns: DataFrame) -> DataFrame:
    """Turns as points of their conversation; role and turn are payload."""
    return turns.select(
        F.col("conv_id").alias("id"), F.array(F.col("turn").cast("float"), F.length("text").cast("float")).alias("vector"),
        "turn", "role", F.length("text").cast("bigint").alias("n_chars"))


def _turns_of(store: CollectionStore, name: str) -> DataFrame:
    return store.read(name).select("id", "turn", "role", "n_chars", F.get("vector", F.lit(0)).cast("double").alias("x0"))


def upserted_turns(spark, sf_dir):
    """User turns first, then all others: the last turn of a batch wins, the second batch overwrites the first."""
    store, turns = _store(spark), table(spark, sf_dir, "conversations")
    store.create("turns", 2, "l2", n_buckets=8)
    user = F.col("role") == "user"
    store.upsert("turns", _turn_points(turns.filter(user)), "turn")
    store.upsert("turns", _turn_points(turns.filter(~user)), "turn")
    return _turns_of(store, "turns")


def refused_points(spark, sf_dir):
    """Vectors of the wrong size or without a vector are refused, with the reason."""
    store = _store(spark)
    store.create("vectors", 64, n_buckets=8)
    rows = points(spark, sf_dir)
    mixed = rows.withColumn("vector", F.when(F.col("species") == "1", F.slice("vector", 1, 7)).when(
        F.col("species") != "2", F.col("vector")))
    report = store.upsert("vectors", mixed)
    kept = store.read("vectors").groupBy(F.lit("stored").alias("outcome")).agg(F.count(F.lit(1)).alias("points"))
    refused = report.rejected.groupBy(F.col("reason").alias("outcome")).agg(F.count(F.lit(1)).alias("points"))
    return kept.unionByName(refused)


def loaded_with_refused(spark, sf_dir):
    """A load in which some rows are refused: what went in, and the rest by reason, none missing."""
    store, rows = _store(spark), points(spark, sf_dir)
    mixed = rows.withColumn("vector", F.when(F.col("species") == "1", F.slice("vector", 1, 7)).when(
        F.col("species") != "2", F.col("vector"))).withColumn("id", F.when(F.col("species") != "3", F.col("id")))
    report = store.load("vectors", mixed, 64, n_buckets=8)
    refused = report.rejected.groupBy(F.col("reason").alias("outcome")).agg(F.count(F.lit(1)).alias("points"))
    stored = store.read("vectors").agg(F.count(F.lit(1)).alias("points")).select(F.lit("stored").alias("outcome"), "points")
    told = spark.range(1).select(F.lit("told").alias("outcome"), F.lit(report.written).cast("bigint").alias("points"))
    return stored.unionByName(refused).unionByName(told)


def narrower_ids(spark, sf_dir):
    """Points stored under BIGINT ids, changed and deleted under INT ids: one row per id, with its whole vector."""
    store, rows = _store(spark), points(spark, sf_dir)
    store.load("vectors", rows, 64, n_buckets=8)
    narrow = rows.withColumn("id", F.col("id").cast("int"))
    store.upsert("vectors", narrow.filter("species = '2'").withColumn("species", F.lit("changed")))
    store.delete("vectors", narrow.filter("species = '3'").select("id"))
    whole = F.md5(F.array_join(F.transform("vector", lambda x: F.round(x * 1000).cast("bigint").cast("string")), ","))
    return store.read("vectors").select("id", "species", whole.alias("vector_md5"))


def two_streams_one_collection(spark, sf_dir):
    """User turns and other turns as two streams of their own into one collection."""
    store, turns = _store(spark), table(spark, sf_dir, "conversations")
    store.create("turns", 2, "l2", n_buckets=8)
    for of_user in (True, False):
        stream = point_stream(spark, f"{sf_dir}/conversations*.parquet", turns.schema)
        chosen = lambda batch, of_user=of_user: _turn_points(batch.filter((F.col("role") == "user") == of_user))
        upsert_stream(stream, store, "turns", scratch_path(spark, "stream"), "turn", enrich=chosen)
    return _turns_of(store, "turns")


def ingested_wrong_dimension(spark, sf_dir):
    """An embedder of 64 into collections of 32 and 64: what each run reports, stores and records."""
    store, documents = _store(spark), _documents(spark, sf_dir).select("key", "text").filter("text RLIKE '\\\\S'")
    store.create("narrow", 32, n_buckets=8)
    store.create("wide", 64, n_buckets=8)
    out = []
    for name, targets, require in (("refused", ["narrow"], "any"), ("any", ["narrow", "wide"], "any"), ("all", ["narrow", "wide"], "all")):
        checkpoint = Checkpoint(spark, scratch_path(spark, "checkpoint"))
        report = ingest_documents(documents, "archive", "hashing", {t: Target(store, t) for t in targets}, checkpoint, require=require)
        result = report.results.agg(F.count_if("success").alias("succeeded"), F.count_if(F.col("cause").isNotNull()).alias("refused"))
        out.append(result.select(
            F.lit(name).alias("run"), "succeeded", "refused", F.lit(checkpoint.keys("documents").count()).cast("bigint").alias("recorded"),
            F.lit(store.count("narrow")).cast("bigint").alias("in_narrow"), F.lit(store.count("wide")).cast("bigint").alias("in_wide")))
    return reduce(DataFrame.unionByName, out)


def deleted_points(spark, sf_dir):
    """One label deleted by id, with ids that do not exist."""
    store, rows = _store(spark), points(spark, sf_dir)
    store.load("vectors", rows, 64, n_buckets=8)
    gone = rows.filter("species = '3'").select("id").unionByName(rows.select((-F.col("id") - 1).alias("id")))
    store.delete("vectors", gone)
    return store.read("vectors").select("id", "species")


def copied_collection(spark, sf_dir):
    source, target = _store(spark), _store(spark)
    source.load("vectors", points(spark, sf_dir), 64, "ip", n_buckets=8)
    target.load("copy", label_queries(spark, sf_dir).select(F.col("query_id").alias("id"), "vector"), 64)
    source.copy("vectors", target, "copy")
    return target.read("copy").groupBy("species").agg(F.count(F.lit(1)).alias("points"), F.sum("id").alias("ids"))


def described_collection(spark, sf_dir):
    store = _store(spark)
    store.load("vectors", points(spark, sf_dir), 64, n_buckets=8)
    store.build_index("vectors", n_lists=8)
    row = store.describe("vectors")
    big = lambda c: F.col(c).cast("bigint").alias(c)
    return row.select("name", "metric", big("dim"), "points", big("min_dim"), big("max_dim"), "null_vectors", "index_status")


def found_again(spark, sf_dir):
    """Label means upserted as points and searched by themselves: each comes back first."""
    store, queries = _store(spark), stage(label_queries(spark, sf_dir), "queries")
    store.load("vectors", points(spark, sf_dir), 64, n_buckets=8)
    store.upsert("vectors", queries.select(
        (F.col("query_id") + 1_000_000_000).alias("id"), F.col("vector").cast("array<float>").alias("vector")))
    best = search_batch(store.read("vectors"), queries, 1)
    return best.select("query_id", "id", (F.col("score") > 0.99).alias("close"))


def sink_outcomes(spark, sf_dir):
    """One batch into two stores, of which one expects another vector size."""
    store, rows = _store(spark), points(spark, sf_dir)

    def refuse(batch):
        raise OSError("store is read-only")

    good = lambda batch: store.load("vectors", batch, 64, n_buckets=8)
    status = write_sinks(rows, {"first": good, "second": refuse}, "batch-1")
    return status.select("batch_id", "sink", "success", "error", "batch_size")


def sink_verdict(spark, sf_dir):
    return sink_rollup(sink_outcomes(spark, sf_dir))


def checkpoint_round_trip(spark, sf_dir):
    """Labelled documents recorded, exported, imported elsewhere; the rest is pending."""
    key = F.format_string("inputs/doc-%06d.txt", "doc_id")
    done = table(spark, sf_dir, "labels").select(key.alias("key"))
    first, second = (Checkpoint(spark, scratch_path(spark, "checkpoint")) for _ in range(2))
    first.append("documents", done, "run-1")
    first.append("documents", done, "run-2")
    exported = scratch_path(spark, "keys")
    first.export_json("documents", exported)
    second.import_json("documents", exported)
    return second.pending("documents", table(spark, sf_dir, "documents").select(key.alias("key"), "lang"))


def key_document_sizes(spark, sf_dir):
    """Keys in sorted documents of at most 100 keys: how many there are in all."""
    keys = table(spark, sf_dir, "documents").select(F.format_string("inputs/doc-%06d.txt", "doc_id").alias("key"))
    documents = key_documents(keys, 100)
    inside = F.from_json("value", "processed_keys array<string>, last_updated double")["processed_keys"]
    return documents.agg(F.sum(F.size(inside)).alias("keys"), F.bool_and(inside == F.array_sort(inside)).alias("sorted"),
                         F.bool_and(F.size(inside) <= 100).alias("bounded"))


def _documents(spark, sf_dir) -> DataFrame:
    key = F.concat(F.lit("inputs/doc-"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return table(spark, sf_dir, "documents").select(key.alias("key"), "text", "lang")


def _as_bytes(documents: DataFrame) -> DataFrame:
    broken = F.when(F.col("lang") == "de", F.unhex(F.lit("FF"))).otherwise(F.unhex(F.lit("")))
    return documents.select("key", F.concat(F.encode("text", "UTF-8"), broken).alias("content"))


def ingested_documents(spark, sf_dir):
    """All documents into two collections; labelled ones are skipped, undecodable ones fail."""
    first, second = _store(spark), _store(spark)
    checkpoint = Checkpoint(spark, scratch_path(spark, "checkpoint"))
    done = table(spark, sf_dir, "labels").select(
        F.concat(F.lit("inputs/doc-"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("key"))
    checkpoint.append("documents", done, "earlier")
    targets = {"first": Target(first, "documents", 8), "second": Target(second, "documents", 8)}
    report = ingest_documents(_as_bytes(_documents(spark, sf_dir)), "archive", "hashing", targets, checkpoint)
    outcome = report.results.groupBy("success", "error_message").agg(F.count(F.lit(1)).alias("rows")).select(
        F.concat_ws(" ", F.lit("result"), F.col("success").cast("string"), "error_message").alias("what"), "rows")
    stored = [
        s.read("documents").agg(F.count(F.lit(1)).alias("rows")).select(F.lit(f"points {n}").alias("what"), "rows")
        for n, s in (("first", first), ("second", second))
    ]
    again = checkpoint.keys("documents").agg(F.count(F.lit(1)).alias("rows")).select(F.lit("checkpoint").alias("what"), "rows")
    return outcome.unionByName(stored[0]).unionByName(stored[1]).unionByName(again)


def ingested_points(spark, sf_dir):
    """Ids, payload and part of the vector of ingested documents."""
    store = _store(spark)
    ingest_documents(_documents(spark, sf_dir).select("key", "text"), "archive", "hashing", {"main": Target(store, "documents", 8)})
    return store.read("documents").select(
        "id", "s3_key", "s3_uri", F.length("text").cast("bigint").alias("n_chars"),
        F.round(F.get("vector", F.lit(5)).cast("double"), 5).alias("x5"))


def ingested_images(spark, sf_dir):
    """Pages as pictures: secure ones carry a signature, the others are refused."""
    head = F.when(F.startswith("url", F.lit("https")), F.unhex(F.lit("FFD8FFE0"))).otherwise(F.unhex(F.lit("00")))
    objects = table(spark, sf_dir, "pages").select(
        F.concat(F.lit("images/"), F.col("page_id").cast("string"), F.lit(".jpg")).alias("key"),
        F.concat(head, F.encode("html", "UTF-8")).alias("content"))
    store = _store(spark)
    report = ingest_images(objects, "archive", "byte_histogram", {"main": Target(store, "images", 8)})
    counted = report.results.groupBy("success", F.coalesce("cause", F.lit("")).alias("cause")).agg(F.count(F.lit(1)).alias("rows"))
    return counted.withColumn("points", F.lit(store.count("images")))


def retried_documents(spark, sf_dir):
    """Long texts fail on the first run; those with a retriable code succeed on the second."""
    store, documents = _store(spark), _documents(spark, sf_dir)
    targets = {"main": Target(store, "documents", 8)}
    careful = EmbedPolicy(batch_size=1, max_batch=1)
    report = ingest_documents(documents.select("key", "text"), "archive", FailsOnLongText(3000), targets, policy=careful)
    failed = report.results.filter(~F.col("success")).join(documents.select("key", "lang"), "key").select(
        "key", F.when(F.col("lang") == "en", F.lit("SlowDown")).otherwise(F.lit("NoSuchKey")).alias("code"),
        F.lit(None).cast("string").alias("http_status"))
    retry_failures(failed, documents.select("key", "text"), "archive", FailsOnLongText(10_000_000), targets, policy=careful)
    return store.read("documents").select("s3_key", F.get("vector", F.lit(0)).cast("double").alias("length"))


def streamed_turns(spark, sf_dir):
    """Turns as a stream of points, the last turn of each conversation wins."""
    store, turns = _store(spark), table(spark, sf_dir, "conversations")
    store.create("turns", 2, "l2", n_buckets=8)
    stream = point_stream(spark, f"{sf_dir}/conversations*.parquet", turns.schema)
    query = upsert_stream(stream, store, "turns", scratch_path(spark, "stream"), "turn", enrich=_turn_points)
    # The same batch again: already recorded in the collection, so nothing changes.
    again = _turn_points(turns).withColumn("role", F.lit("replay"))
    store.upsert("turns", again, "turn", batch=(f"points:{query.id}", 0))
    return _turns_of(store, "turns")


def streamed_documents(spark, sf_dir):
    """Documents ingested as a stream."""
    store, documents = _store(spark), table(spark, sf_dir, "documents")
    stream = point_stream(spark, f"{sf_dir}/documents*.parquet", documents.schema)
    objects = stream.select(F.concat(F.lit("inputs/doc-"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("key"), "text")
    ingest_stream(objects, "archive", "hashing", {"main": Target(store, "documents", 8)}, scratch_path(spark, "stream"))
    return store.read("documents").select("s3_key", F.length("text").cast("bigint").alias("n_chars"))


def _drained(spark, stream: DataFrame) -> DataFrame:
    out = scratch_path(spark, "arrivals")
    stream.writeStream.format("parquet").option("checkpointLocation", scratch_path(spark, "stream")) \
        .trigger(availableNow=True).start(out).awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def streamed_first_arrivals(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    stream = point_stream(spark, f"{sf_dir}/conversations*.parquet", turns.schema).select(F.col("conv_id").alias("key"))
    return _drained(spark, first_arrivals(stream))


def streamed_event_keys(spark, sf_dir):
    """Users once each, with state bounded by a watermark longer than the data."""
    events = table(spark, sf_dir, "events")
    stream = point_stream(spark, f"{sf_dir}/events*.parquet", events.schema).select(
        F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("key"))
    return _drained(spark, first_arrivals(stream, event_time="ts", delay="3650 days")).select("key")


QUERIES = {
    "upserted_turns": upserted_turns,
    "refused_points": refused_points,
    "loaded_with_refused": loaded_with_refused,
    "narrower_ids": narrower_ids,
    "two_streams_one_collection": two_streams_one_collection,
    "ingested_wrong_dimension": ingested_wrong_dimension,
    "deleted_points": deleted_points,
    "copied_collection": copied_collection,
    "described_collection": described_collection,
    "found_again": found_again,
    "sink_outcomes": sink_outcomes,
    "sink_verdict": sink_verdict,
    "checkpoint_round_trip": checkpoint_round_trip,
    "key_document_sizes": key_document_sizes,
    "ingested_documents": ingested_documents,
    "ingested_points": ingested_points,
    "ingested_images": ingested_images,
    "retried_documents": retried_documents,
    "streamed_turns": streamed_turns,
    "streamed_documents": streamed_documents,
    "streamed_first_arrivals": streamed_first_arrivals,
    "streamed_event_keys": streamed_event_keys,
}

_LAST_TURN = """
SELECT conv_id AS id, turn, role, length(text) AS n_chars, turn::DOUBLE AS x0 FROM {source}
QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY {order}) = 1"""

_BLANK = "regexp_replace(text, '\\s', '', 'g') = ''"

ORACLES = {
    "upserted_turns": _LAST_TURN.format(source="conversations", order="(role = 'user'), turn DESC"),
    "refused_points": """
SELECT CASE label WHEN 1 THEN 'vector has 7 dimensions, expected 64' WHEN 2 THEN 'vector is null' ELSE 'stored' END AS outcome,
       count(*) AS points FROM embeddings GROUP BY 1""",
    "loaded_with_refused": """
SELECT CASE label WHEN 1 THEN 'vector has 7 dimensions, expected 64' WHEN 2 THEN 'vector is null' WHEN 3 THEN 'id is null'
                  ELSE 'stored' END AS outcome, count(*) AS points FROM embeddings GROUP BY 1
UNION ALL SELECT 'told', count(*) FROM embeddings WHERE label NOT IN (1, 2, 3)""",
    "narrower_ids": """
SELECT vec_id AS id, CASE label WHEN 2 THEN 'changed' ELSE label::VARCHAR END AS species,
       md5(array_to_string(list_transform(embedding, lambda x: round((x * 1000::FLOAT)::DOUBLE)::BIGINT::VARCHAR), ',')) AS vector_md5
FROM embeddings WHERE label <> 3""",
    "two_streams_one_collection": _LAST_TURN.format(source="conversations", order="(role = 'user'), turn DESC"),
    "ingested_wrong_dimension": f"""
WITH n AS (SELECT count(*) AS n FROM documents WHERE NOT {_BLANK})
SELECT 'refused' AS run, 0::BIGINT AS succeeded, n AS refused, 0::BIGINT AS recorded, 0::BIGINT AS in_narrow, 0::BIGINT AS in_wide FROM n
UNION ALL SELECT 'any', n, 0, n, 0, n FROM n UNION ALL SELECT 'all', 0, n, 0, 0, n FROM n""",
    "deleted_points": "SELECT vec_id AS id, label::VARCHAR AS species FROM embeddings WHERE label <> 3",
    "copied_collection": """
SELECT label::VARCHAR AS species, count(*) AS points, sum(vec_id)::BIGINT AS ids FROM embeddings GROUP BY 1""",
    "described_collection": """
SELECT 'vectors' AS name, 'cosine' AS metric, 64::BIGINT AS dim, count(*) AS points, min(len(embedding)) AS min_dim,
       max(len(embedding)) AS max_dim, 0::BIGINT AS null_vectors, 'indexed' AS index_status FROM embeddings""",
    "found_again": "SELECT DISTINCT label::BIGINT AS query_id, label::BIGINT + 1000000000 AS id, TRUE AS close FROM embeddings",
    "sink_outcomes": """
SELECT 'batch-1' AS batch_id, sink, sink = 'first' AS success, CASE WHEN sink = 'second' THEN 'OSError: store is read-only' ELSE '' END AS error,
       (SELECT count(*) FROM embeddings) AS batch_size FROM (VALUES ('first'), ('second')) s(sink)""",
    "sink_verdict": "SELECT 'batch-1' AS batch_id, TRUE AS any_success, FALSE AS all_success, count(*) AS batch_size FROM embeddings",
    "checkpoint_round_trip": """
SELECT format('inputs/doc-{:06d}.txt', doc_id) AS key, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""",
    "key_document_sizes": "SELECT count(*) AS keys, TRUE AS sorted, TRUE AS bounded FROM documents",
    "ingested_documents": f"""
WITH d AS (SELECT doc_id, lang = 'de' AS broken, {_BLANK} AS blank FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)),
r AS (SELECT CASE WHEN broken THEN 'result false Failed to fetch or decode content' WHEN blank THEN 'result false Text cannot be empty'
                  ELSE 'result true ' END AS what, NOT (broken OR blank) AS good FROM d),
g AS (SELECT count(*) FILTER (WHERE good) AS n FROM r)
SELECT what, count(*) AS rows FROM r GROUP BY what
UNION ALL SELECT 'points first', n FROM g UNION ALL SELECT 'points second', n FROM g
UNION ALL SELECT 'checkpoint', n + (SELECT count(DISTINCT doc_id) FROM labels) FROM g""",
    "ingested_points": f"""
WITH src AS (SELECT doc_id, text FROM documents WHERE NOT {_BLANK}), v AS {embed_sql('src', 'doc_id', 'text')},
u AS (SELECT doc_id, text, 'inputs/doc-' || doc_id || '.txt' AS s3_key, md5('s3://archive/inputs/doc-' || doc_id || '.txt') AS h FROM src)
SELECT concat_ws('-', h[1:8], h[9:12], h[13:16], h[17:20], h[21:32]) AS id, s3_key, 's3://archive/' || s3_key AS s3_uri,
       length(text) AS n_chars, round(v[6], 5) AS x5
FROM u JOIN v ON v.doc_id = u.doc_id""",
    "ingested_images": """
WITH p AS (SELECT starts_with(url, 'https') AS success, octet_length(encode(html)) AS n FROM pages),
c AS (SELECT success, CASE WHEN NOT success AND n + 1 < 100 THEN 'only ' || (n + 1) || ' bytes, at least 100 wanted'
                           WHEN success AND n + 4 < 100 THEN 'only ' || (n + 4) || ' bytes, at least 100 wanted'
                           WHEN NOT success THEN 'not a known image format' ELSE '' END AS cause FROM p)
SELECT cause = '' AS success, cause, count(*) AS rows, (SELECT count(*) FROM c WHERE cause = '') AS points FROM c GROUP BY cause""",
    "retried_documents": f"""
SELECT 'inputs/doc-' || doc_id || '.txt' AS s3_key, length(text)::DOUBLE AS length FROM documents
WHERE NOT {_BLANK} AND (length(text) <= 3000 OR lang = 'en')""",
    "streamed_turns": _LAST_TURN.format(source="conversations", order="turn DESC"),
    "streamed_documents": f"""
SELECT 'inputs/doc-' || doc_id || '.txt' AS s3_key, length(text) AS n_chars FROM documents WHERE NOT {_BLANK}""",
    "streamed_first_arrivals": "SELECT DISTINCT conv_id AS key FROM conversations",
    "streamed_event_keys": "SELECT DISTINCT user_id AS key FROM events",
}
