"""Chunking, joins, aggregates, sinks, composed jobs and streams."""

import datetime
import json
import os
import re
import random

import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from larkspur import schemas, session
from larkspur.catalog import relations
from larkspur.operators import metrics, relational
from larkspur.operators.chunking import BLOCK_CHARS, SENTENCE_END, chunk_blocks, chunk_bounds, chunk_list, explode_chunks
from larkspur.operators.collections import CollectionStore
from larkspur.operators.embedding import EmbedPolicy
from larkspur.operators.search import search, search_batch
from larkspur.operators.sinks import Checkpoint, read_key_documents, write_metrics, write_sinks
from larkspur.plans import datasets
from larkspur.plans.benchmark import embed_queries, run_benchmark, run_update_benchmark
from larkspur.plans.ingest import Target, ingest_documents, ingest_images, retry_failures
from larkspur.streaming.jobs import first_arrivals, ingest_stream, object_stream, point_stream, stream_progress, upsert_stream
from tests.pictures import jpeg

# Chunks


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aB. !?\né", max_size=300), st.integers(1, 60), st.booleans())
def test_spans_cover_the_text(text, size, compat):
    bounds = chunk_bounds(text, size, compat)
    spans = list(zip([0, *bounds], bounds))
    assert [s for s, _ in spans] == [0, *[e for _, e in spans[:-1]]][:len(spans)]
    assert "".join(text[s:e] for s, e in spans) == text
    assert all(0 < e - s <= size for s, e in spans)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="aB.!? \nC", max_size=120), st.integers(1, 40), st.booleans())
def test_breaks_are_the_first_sentence_ends_of_the_last_fifth(text, size, compat):
    bounds = chunk_bounds(text, size, compat)
    for low, got in zip([0, *bounds], bounds):
        high = min(low + size, len(text))
        found = re.compile(SENTENCE_END).search(text, max(low, high - size // 5), high) if high < len(text) else None
        assert got == (high if found is None else found.end() if compat else found.start() + 1)


def test_break_after_a_sentence():
    text = "a" * 90 + ". Next one goes on" + "b" * 50
    assert [c["text"] for c in chunk_list(text, 100, False)][0] == "a" * 90 + "."
    assert [c["text"] for c in chunk_list(text, 100, True)][0] == "a" * 90 + ". N"
    assert chunk_list("a" * 85 + ".\n" + "b" * 50, 100, True)[0]["text"] == "a" * 85 + "."
    assert chunk_list("  \n ", 100, False) == [] and chunk_list(None, 100, False) == []


def test_few_chunks_are_held_at_a_time():
    texts = pa.array(["x. Y" * 5000, None, "", "é" * 700] * 100)
    blocks = list(chunk_blocks(texts, 500, False))
    assert [c for b in blocks for c in b] == [chunk_list(t, 500, False) for t in texts.to_pylist()]
    assert len(blocks) > 5 and all(sum(c[-1]["end"] for c in b if c) < BLOCK_CHARS + 20_000 for b in blocks)


def test_explode_chunks(spark):
    rows = spark.createDataFrame([(1, "x" * 1200), (2, " "), (3, None)], "id int, text string")
    got = explode_chunks(rows, "text").orderBy("id", "chunk_no").collect()
    assert [(r.id, r.chunk_no, r.start, r.end) for r in got] == [(1, 0, 0, 500), (1, 1, 500, 1000), (1, 2, 1000, 1200)]


def test_make_documents(spark, folder):
    books = spark.createDataFrame([("a", "junk\nCHAPTER 1\n" + "x" * 20), ("b", "y" * 25)], "book string, text string")
    made = datasets.make_documents(books, 11, chunk_size=10, path=folder + "/docs").orderBy("document_no").collect()
    assert len(made) == 11 and made[0].name == "doc-00000.txt" and made[10].name == "doc-00010.txt"
    chunks = ["CHAPTER 1", "x" * 10, "x" * 10, "y" * 10, "y" * 10, "y" * 5]
    assert [r.text for r in made] == [chunks[i % 6] for i in range(11)]


# Joins


@pytest.fixture(scope="module")
def tables(spark):
    photos = spark.createDataFrame([
        ("p1", 1, "O1", 10, "jpg", None), ("p2", 2, "o2 ", 10, "png", [9.0]), ("p3", 3, "o3", 11, "jpg", None),
        ("p4", 4, "missing", 12, "jpg", None), ("p1b", 1, "o2", 10, "jpg", None)],
        "photo_uuid string, photo_id int, observation_uuid string, observer_id int, extension string, embedding array<float>")
    observations = spark.createDataFrame([
        ("o1", 10, 1.5, None, 5, 100, datetime.date(2020, 5, 1)), ("o2", 10, None, 2.5, None, None, None),
        ("o3", 11, 3.0, 4.0, 7, 999, datetime.date(2021, 6, 2))],
        "observation_uuid string, observer_id int, latitude double, longitude double, positional_accuracy int, taxon_id int, observed_on date")
    taxa = spark.createDataFrame([(100, "Corvus"), (101, "Vulpes"), (102, "Corvus corax")], "taxon_id int, name string")
    embeddings = spark.createDataFrame([(1, [1.0, 2.0], True), (2, [3.0, 4.0], False), (3, [5.0, 6.0], None), (1, [7.0, 8.0], True)],
                                       "photo_id int, embedding array<float>, status boolean")
    return photos, observations, taxa, embeddings


def test_photo_metadata(tables):
    photos, observations, taxa, _ = tables
    rows = {(r.photo_id, r.observation_uuid): r for r in relational.photo_metadata(photos, observations, taxa).collect()}
    assert set(rows) == {(1, "o1"), (2, "o2"), (3, "o3"), (1, "o2")}
    assert rows[1, "o1"].taxon == "Corvus" and rows[3, "o3"].taxon is None and rows[2, "o2"].taxon_id is None
    assert relational.with_taxa(observations, taxa, "inner").count() == 1


def test_vectors_stay_out_of_the_join(tables):
    photos, observations, taxa, _ = tables
    plan = relational.photo_metadata(photos, observations, taxa)._jdf.queryExecution().optimizedPlan().toString()
    assert "embedding" not in plan.split("LogicalRDD")[0]


def test_enrich_embeddings(tables):
    photos, observations, taxa, embeddings = tables
    got = relational.enrich_embeddings(embeddings, photos, observations, taxa).collect()
    assert sorted((r.photo_id, r.observation_uuid, r.embedding[0]) for r in got) == [
        (1, "o1", 1.0), (1, "o1", 7.0), (1, "o2", 1.0), (1, "o2", 7.0)]


def test_attach_embeddings(spark, tables):
    photos, _, _, embeddings = tables
    newest = embeddings.withColumn("v", F.col("embedding")[0])
    got = {r.photo_uuid: r.embedding for r in relational.attach_embeddings(photos, newest, F.col("v")).collect()}
    assert got == {"p1": [7.0, 8.0], "p1b": [7.0, 8.0], "p2": [9.0], "p3": None, "p4": None}


def test_suggestions(tables):
    taxa = tables[2]
    assert [r.name for r in relational.suggest_taxa(taxa, " corv").collect()] == ["Corvus", "Corvus corax"]
    assert relational.suggest_taxa(taxa, "  ").count() == 0 and relational.suggest_taxa(taxa, "c%").count() == 0


def test_batch_numbers(spark):
    keys = spark.range(1003).select(F.format_string("k%05d", "id").alias("key")).repartition(7)
    got = relational.batch_numbers(keys, 50).orderBy("key").collect()
    assert [r.batch for r in got] == [i // 50 for i in range(1003)]


def test_latest_per_key_limits_before_the_shuffle(spark):
    rows = spark.range(1000).select((F.col("id") % 3).alias("k"), "id")
    latest = relational.latest_per_key(rows, ["k"], [F.desc("id")])
    assert {(r.k, r.id) for r in latest.collect()} == {(0, 999), (1, 997), (2, 998)}
    plan = latest._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


# Aggregates


def test_latency_stats(spark):
    rows = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 3.0), ("a", 4.0), ("b", 5.0), (None, 1.0), ("c", None)], "e string, v double")
    got = {r.e: (r.lat_ms_avg, r.lat_ms_p50, r.lat_ms_p95) for r in metrics.latency_stats(rows, "v", ["e"]).collect()}
    assert got["a"] == pytest.approx((2.5, 2.5, 3.85)) and got["b"] == (5.0, 5.0, 5.0) and got[None] == (1.0, 1.0, 1.0)
    assert got["c"] == (None, None, None)
    one = metrics.latency_stats(rows.filter("e = 'a'"), "v").first()
    assert (one.lat_ms_p50, one.lat_ms_p95) == pytest.approx((2.5, 3.85))
    rough = metrics.latency_stats(rows.filter("e = 'a'"), "v", approximate=True).first()
    assert rough.lat_ms_p50 in (2.0, 3.0)


@pytest.mark.parametrize("band_values", [3, 60, 4096])
def test_percentiles_of_a_large_skewed_group(spark, monkeypatch, band_values):
    monkeypatch.setattr(metrics, "BAND_VALUES", band_values)
    rows = spark.range(60_000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("g"), (F.col("id") % 40).cast("string"))).alias("g"),
        F.when(F.col("id") % 3 == 0, F.pmod(F.hash("id"), F.lit(5000)) / 7).otherwise(F.rand(1)).alias("v"))
    rows = rows.cache()
    got = metrics.exact_percentiles(rows, "v", [0.0, 0.5, 0.95, 1.0], ["g"]).collect()
    want = {r.g: r for r in rows.groupBy("g").agg(F.percentile("v", [0.0, 0.5, 0.95, 1.0]).alias("q")).collect()}
    assert len(got) == len(want) and all([r.p0, r.p50, r.p95, r.p100] == pytest.approx(want[r.g].q) for r in got)


def results(spark, *rows):
    return spark.createDataFrame(list(rows), "query_id int, rank int, id int")


def test_recall_edges(spark):
    exact = results(spark, (0, 1, 5), (0, 2, 6), (1, 1, 7))
    assert metrics.recall_at_k(exact, exact, 2).first().recall == 0.75
    none = exact.limit(0)
    assert metrics.recall_at_k(none, exact, 1).first().recall == 0.0
    assert metrics.recall_at_k(none, none, 1).first().recall == 0.0
    copies = results(spark, (0, 1, 5), (0, 2, 5))
    assert metrics.recall_at_k(copies, exact, 2).first().hits == 1


def test_hit_count(spark):
    ids = lambda *x: F.array(*[F.lit(i) for i in x])
    row = spark.range(1).select(metrics.hit_count(ids(1, 1, 2, -1), ids(2, 1, 3, -1), 3).alias("a"),
                                metrics.hit_count(ids(-1, -1), ids(-1, 4), 2).alias("b")).first()
    assert (row.a, row.b) == (2, 1)


def test_run_figures(spark):
    rows = spark.createDataFrame([("a", True, None), ("b", False, "Upstream gone"), ("c", False, "x circuit breaker upstream")],
                                 schemas.PROCESSING_RESULT)
    got = metrics.summarize_run(rows, 1.5).first()
    assert (got.successful, got.failed, got.total, got.rate_per_sec) == (1, 2, 3, 2.0)
    assert metrics.summarize_run(rows, 0.0).first().rate_per_sec == 0.0
    seen = metrics.progress(rows, 9, 2.0).first()
    assert (seen.completed, seen.percent, seen.docs_per_second, seen.pending) == (3, 33.3, 1.5, 6)
    assert {r.error_class: r.failures for r in metrics.classify_errors(rows).collect()} == {"upstream": 1, "circuit_breaker": 1}


@pytest.mark.parametrize("one, two, any_ok, all_ok", [(True, True, True, True), (True, False, True, False), (False, True, True, False), (False, False, False, False)])
def test_sinks(spark, one, two, any_ok, all_ok):
    def sink(ok):
        def write(batch):
            if not ok:
                raise ValueError("no\nmore")
            batch.count()
        return write

    status = write_sinks(spark.range(3), {"one": sink(one), "two": sink(two)}, "b")
    row = metrics.sink_rollup(status).first()
    assert (row.any_success, row.all_success, row.batch_size) == (any_ok, all_ok, 3)
    assert {r.error for r in status.filter(~F.col("success")).collect()} <= {"ValueError: no"}


def test_empty_batch_writes_nothing(spark):
    def write(batch):
        raise AssertionError

    assert write_sinks(spark.range(0), {"one": write}).first().success


# Checkpoints


def test_checkpoint(spark, folder):
    keys = lambda *k: spark.createDataFrame([(x,) for x in k], "key string")
    point = Checkpoint(spark, folder + "/points")
    assert point.keys("c").count() == 0 and point.pending("c", keys("a")).count() == 1
    point.append("c", keys("a", "b"), "r1")
    point.append("c", keys("b"), "r2")
    point.append("other", keys("z"), "r1")
    assert {r.key for r in point.keys("c").collect()} == {"a", "b"}
    assert {r.key for r in point.pending("c", keys("a", "z", "q")).collect()} == {"z", "q"}


def test_checkpoint_documents(spark, folder):
    with open(folder + "/old.json", "w") as out:
        json.dump({"processed_keys": ["key1", "key2", "key3"], "last_updated": 1234567890.0}, out, indent=2)
    with open(folder + "/bad.json", "w") as out:
        out.write('{"processed_keys": ["ke')
    point = Checkpoint(spark, folder + "/points")
    point.import_json("c", folder + "/old.json")
    assert {r.key for r in point.keys("c").collect()} == {"key1", "key2", "key3"}
    assert read_key_documents(spark, folder + "/bad.json").count() == 0
    assert read_key_documents(spark, folder + "/none.json").count() == 0
    point.KEYS_PER_DOCUMENT = 2
    point.export_json("c", folder + "/export")
    lines = [json.loads(r.value) for r in spark.read.text(folder + "/export").collect()]
    assert sorted(k for d in lines for k in d["processed_keys"]) == ["key1", "key2", "key3"] and all(len(d["processed_keys"]) <= 2 for d in lines)
    assert {r.key for r in read_key_documents(spark, folder + "/export").collect()} == {"key1", "key2", "key3"}


# Ingestion


class Picky:
    """Refuses texts with the word bad."""

    def __call__(self):
        def embed(texts):
            if any("bad" in t for t in texts):
                raise OSError("refused")
            return [[float(len(t)), 1.0] for t in texts]

        return embed


def documents(spark, *rows):
    return spark.createDataFrame([(k, bytearray(c)) for k, c in rows], "key string, content binary")


def test_ingest(spark, folder):
    first, second = CollectionStore(spark, folder + "/1"), CollectionStore(spark, folder + "/2")
    point = Checkpoint(spark, folder + "/points")
    targets = {"first": Target(first, "d", 4), "second": Target(second, "d", 4)}
    batch = documents(spark, ("a.txt", b"fine"), ("b.txt", b"bad one"), ("c.txt", b"\xff"), ("d.txt", b"  "))
    report = ingest_documents(batch, "b", Picky(), targets, point, policy=EmbedPolicy(batch_size=1, max_batch=1))
    got = {r.key: (r.success, r.error_message) for r in report.results.collect()}
    assert got == {"a.txt": (True, ""), "b.txt": (False, "Embedding failed"), "c.txt": (False, "Failed to fetch or decode content"),
                   "d.txt": (False, "Text cannot be empty")}
    row = first.read("d").first()
    assert (row.s3_key, row.s3_bucket, row.s3_uri, row.text, row.vector) == ("a.txt", "b", "s3://b/a.txt", "fine", [4.0, 1.0])
    assert second.read("d").first().id == row.id
    assert report.summary.first().failed == 3 and report.sinks.count() == 2
    again = ingest_documents(batch, "b", Picky(), targets, point, policy=EmbedPolicy(batch_size=1, max_batch=1))
    assert {r.key for r in again.results.collect()} == {"b.txt", "c.txt", "d.txt"}


def test_ingesting_twice_gives_the_same_points(spark, folder):
    store = CollectionStore(spark, folder)
    for mode, count in (("deterministic", 2), ("random", 4)):
        for _ in range(2):
            ingest_documents(documents(spark, ("a", b"x"), ("b", b"y")), "b", Picky(), {"s": Target(store, mode, 2)}, id_mode=mode)
        assert store.count(mode) == count


@pytest.mark.parametrize("require, ok", [("any", True), ("all", False)])
def test_one_broken_store(spark, folder, require, ok):
    good, broken = CollectionStore(spark, folder + "/1"), CollectionStore(spark, folder + "/2")
    broken.upsert = lambda *a, **k: (_ for _ in ()).throw(OSError("full"))
    point = Checkpoint(spark, folder + "/points")
    report = ingest_documents(documents(spark, ("a", b"x")), "b", Picky(), {"g": Target(good, "d", 2), "x": Target(broken, "d", 2)},
                              point, require=require)
    assert [(r.success, r.error_message) for r in report.results.collect()] == [(ok, "" if ok else "Upsert failed")]
    assert point.keys("documents").count() == int(ok)
    assert {r.sink: r.error for r in report.sinks.collect()} == {"g": "", "x": "OSError: full"}


def test_nothing_to_ingest(spark, folder):
    report = ingest_documents(documents(spark, ("c", b"\xff")), "b", Picky(), {"s": Target(CollectionStore(spark, folder), "d")})
    assert report.summary.first().failed == 1 and report.sinks.first().success


def test_retry(spark, folder):
    store = CollectionStore(spark, folder)
    batch = documents(spark, ("a", b"one"), ("b", b"two"), ("c", b"three"))
    failures = spark.createDataFrame([("a", "SlowDown", None), ("b", "NoSuchKey", "500"), ("c", None, "503")],
                                     "key string, code string, http_status string")
    retry_failures(failures, batch, "b", Picky(), {"s": Target(store, "d", 2)})
    assert {r.s3_key for r in store.read("d").collect()} == {"a", "c"}


def test_ingest_images(spark, folder):
    store = CollectionStore(spark, folder)
    batch = documents(spark, ("a.jpg", jpeg(5, 5)), ("b.jpg", b"tiny"), ("c.jpg", b"?" * 200))
    report = ingest_images(batch, "b", "byte_histogram", {"s": Target(store, "i", 2)})
    assert {r.key for r in report.results.filter("success").collect()} == {"a.jpg"}
    assert store.read("i").first().format == "jpeg"


# Datasets


def test_image_dataset(spark, tables, folder):
    photos, observations, taxa, _ = tables
    images = spark.createDataFrame([(1, bytearray(b"abc")), (2, bytearray(b"")), (9, bytearray(b"x"))], "photo_id int, content binary")
    got = datasets.build_image_dataset(photos, observations, taxa, images, "byte_histogram", "h", folder + "/ds")
    assert got.schema == schemas.IMAGE_DATASET or [f.name for f in got.schema] == [f.name for f in schemas.IMAGE_DATASET]
    rows = [(r.id, r.img_url, r.file_name) for r in got.collect()]
    assert rows[0] == (1, "https://h/photos/1/medium.jpg", "photos/1/medium.jpg") and len(rows) == 2
    assert datasets.build_image_dataset(photos, observations, taxa, images, "byte_histogram", "h", limit=1).count() == 1
    whole, failed = datasets.image_dataset_and_failures(photos, observations, taxa, images, "byte_histogram", "h")
    said = {r.photo_id: r.error_message for r in failed.collect()}
    assert whole.count() == 2 and failed.count() == 2 and said[3] == datasets.NO_PICTURE and said[2] not in (None, datasets.NO_PICTURE)


def test_build_collection(spark, tables, folder):
    photos, observations, taxa, embeddings = tables
    store = CollectionStore(spark, folder)
    one = embeddings.filter("embedding[0] = 1.0")
    assert datasets.build_collection(store, "p", one, photos, observations, taxa, "h", 2, n_buckets=2) == 1
    row = store.read("p").first()
    assert (row.id, row.observation_uuid, row.location.lat, row.location.lon, row.species) == (1, "o2", None, 2.5, None)
    twice = embeddings.unionByName(embeddings.withColumn("embedding", F.transform("embedding", lambda x: x + 1)))
    assert datasets.build_collection(store, "q", twice, photos, observations, taxa, "h", 2, n_buckets=2) == store.read("q").select("id").distinct().count()
    found = search_batch(store.read("p"), spark.createDataFrame([(0, [1.0, 2.0])], "query_id bigint, vector array<double>"), 3)
    shaped = relational.image_response(store.read("p").join(found, "id")).first()
    assert (shaped.location.lat, shaped.location.lon, shaped.observed_on) == (0.0, 2.5, "")


def test_reembed(spark, folder):
    url = "https://h/photos/7/medium.jpg"
    dataset = spark.createDataFrame([(url, "f"), ("https://h/photos/8/medium.jpg", "g")], "img_url string, file_name string")
    images = spark.createDataFrame([(url, bytearray(jpeg(3, 3))), ("https://h/photos/8/medium.jpg", bytearray(b"?" * 50))], "img_url string, content binary")
    got = datasets.reembed_dataset(dataset, images, "byte_histogram", folder + "/out").collect()
    assert [(r.id, r.file_name, len(r.img_embedding)) for r in got] == [(7, "f", 64)]
    more = dataset.unionByName(spark.createDataFrame([("https://h/photos/9/medium.jpg", "i")], "img_url string, file_name string"))
    again, failed = datasets.reembedded_and_failures(more, images, "byte_histogram")
    assert again.count() == 1
    assert {r.img_url[-12:-11]: r.error_message for r in failed.collect()} == {"8": datasets.UNKNOWN_FORMAT, "9": datasets.NO_PICTURE}


def test_reembedded_pages_leaves_no_page_out(spark, folder):
    pages = spark.createDataFrame([(i, f"http{'s' if i != 27 else ''}://h/{i}", "<p>some text</p>") for i in range(1, 28)],
                                  "page_id bigint, url string, html string")
    pages.write.parquet(f"{folder}/pages.parquet")
    assert sorted(r.id for r in relations.reembedded_pages(spark, folder).collect()) == list(range(1, 27))
    failed = relations.reembedding_failures(spark, folder).collect()
    assert sorted(r.img_url.split("/")[4] for r in failed) == ["13", "26", "27"]


# Benchmarks


def test_benchmark(spark, folder):
    lines = spark.createDataFrame([(0, "red fox"), (2, "blue bird")], "query_id bigint, query string")
    queries = embed_queries(lines, "hashing")
    texts = [(i, " ".join(random.Random(i).choices("red fox blue bird moth tree".split(), k=6))) for i in range(40)]
    from larkspur.operators.embedding import embed_column
    points = embed_column(spark.createDataFrame(texts, "id bigint, text string"), "text", "hashing").select("id", "vector").cache()
    exact = search_batch(points, queries, 5)
    report = run_benchmark(queries, {"exact": lambda q: search_batch(points, q, 5)}, exact, 5, rounds=2, metrics_root=folder).first()
    assert report.recall == 1.0 and report.queries == 2 and 0 < report.lat_ms_p50 <= report.lat_ms_p95
    assert report.batch_ms_avg == pytest.approx(2 * report.lat_ms_avg)
    assert any(n.startswith("step-search-") for n in os.listdir(folder))


def test_update_benchmark(spark, folder):
    store = CollectionStore(spark, folder)
    vec = lambda i: [float(i), 1.0]
    store.load("v", spark.createDataFrame([(i, vec(i)) for i in range(30)], "id bigint, vector array<float>"), 2, "l2", 4)
    queries = spark.createDataFrame([(0, vec(3)), (1, vec(100))], "query_id bigint, vector array<double>")
    with pytest.raises(ValueError, match="no current index"):
        run_update_benchmark(store, "v", queries.limit(0).withColumnRenamed("query_id", "id"), queries.limit(0).selectExpr("query_id AS id"), queries)
    store.build_index("v", n_lists=3)
    report = run_update_benchmark(
        store, "v", spark.createDataFrame([(100, vec(100))], "id bigint, vector array<float>"), spark.createDataFrame([(3,)], "id bigint"),
        queries, k=1).first()
    assert (report.points, report.recall) == (30, 1.0)
    assert search(store.read("v"), vec(3), 1, "l2").first().id in (2, 4) and search(store.read("v"), vec(100), 1, "l2").first().id == 100


def test_metrics_files(spark, folder):
    path = write_metrics(spark.createDataFrame([(1.5,)], "x double"), folder, "embed")
    assert spark.read.json(path).first().x == 1.5


# Streams


def test_stream_in_steps_equals_one_batch(spark, folder):
    turns = spark.range(90).select((F.col("id") % 20).alias("id"), F.array(F.col("id").cast("float")).alias("vector"), F.col("id").alias("seq"))
    for lo in (0, 30, 60):
        turns.filter(F.col("seq").between(lo, lo + 29)).coalesce(1).write.mode("append").parquet(folder + "/in")
    stepwise, whole = CollectionStore(spark, folder + "/1"), CollectionStore(spark, folder + "/2")
    for store in (stepwise, whole):
        store.create("t", 1, "l2", 4)
    query = upsert_stream(point_stream(spark, folder + "/in", turns.schema, 1), stepwise, "t", folder + "/check", "seq")
    assert [(r.batch_id, r.rows) for r in stream_progress(query).orderBy("batch_id").collect()] == [(0, 30), (1, 30), (2, 30)]
    whole.upsert("t", turns, "seq")
    rows = lambda s: {r.id: r.seq for r in s.read("t").collect()}
    assert rows(stepwise) == rows(whole)
    assert stepwise.manifest("t").applied == {f"points:{query.id}": 2}
    version = stepwise.manifest("t").version
    upsert_stream(point_stream(spark, folder + "/in", turns.schema, 1), stepwise, "t", folder + "/check", "seq")
    assert stepwise.manifest("t").version == version
    # A fresh checkpoint is another stream: its batches are applied again and leave the same rows.
    other = upsert_stream(point_stream(spark, folder + "/in", turns.schema, 1), stepwise, "t", folder + "/check2", "seq")
    assert rows(stepwise) == rows(whole) and stepwise.manifest("t").version > version
    assert stepwise.manifest("t").applied == {f"points:{query.id}": 2, f"points:{other.id}": 2}


def test_object_stream(spark, folder):
    os.makedirs(folder + "/in")
    write = lambda name, text: open(f"{folder}/in/{name}", "w").write(text)
    write("a.txt", "one")
    store, seen = CollectionStore(spark, folder + "/store"), []
    run = lambda: ingest_stream(object_stream(spark, folder + "/in"), "b", Picky(), {"s": Target(store, "d", 2)}, folder + "/check",
                                on_report=lambda r, n: seen.append((n, r.summary.first().total)))
    run()
    write("b.txt", "two!")
    run()
    run()
    assert seen == [(0, 1), (1, 1), (2, 0)] and sorted(r.text for r in store.read("d").collect()) == ["one", "two!"]


def test_first_arrivals(spark, folder):
    spark.createDataFrame([("a", 1), ("b", 2), ("a", 3)], "key string, n int").write.parquet(folder + "/in")
    stream = first_arrivals(point_stream(spark, folder + "/in", spark.read.parquet(folder + "/in").schema))
    stream.writeStream.format("memory").queryName("arrivals").trigger(availableNow=True).option(
        "checkpointLocation", folder + "/check").start().awaitTermination()
    assert sorted(r.key for r in spark.table("arrivals").collect()) == ["a", "b"]


# Scratch folder


def test_scratch_is_kept_by_application(spark, folder, monkeypatch):
    configured = spark.conf.get(session.CHECKPOINT_KEY, None)
    assert configured is None or session.scratch_root(spark) == configured.rstrip("/")
    monkeypatch.setattr(session, "scratch_root", lambda spark: folder)
    assert session.stage(spark.range(3), "numbers").count() == 3
    assert os.listdir(folder + "/larkspur") == [spark.sparkContext.applicationId]
    session.clear_scratch(spark)
    assert os.listdir(folder + "/larkspur") == []


# Nothing is lost unseen


def two_sizes(texts):
    """Vectors of two coordinates, or of three where the text says so."""
    return [[1.0, float(len(t)), 0.5] if "odd" in t else [1.0, float(len(t))] for t in texts]


def test_refused_points_become_failed_keys(spark, folder):
    store = CollectionStore(spark, folder + "/store")
    objects = spark.createDataFrame([("a", "one"), ("b", "an odd one"), ("c", "three")], "key string, text string")
    checkpoint = Checkpoint(spark, folder + "/keys")
    report = ingest_documents(objects, "lake", lambda: two_sizes, {"main": Target(store, "c", 2)}, checkpoint)
    got = {r.key: (r.success, r.error_message, r.cause) for r in report.results.collect()}
    assert got["a"] == got["c"] == (True, "", None)
    assert got["b"] == (False, "Upsert failed", "vector has 3 dimensions, expected 2")
    status = report.sinks.first()
    assert not status.success and status.error == "refused 1 of 3 rows"
    assert sorted(r.key for r in checkpoint.keys("documents").collect()) == ["a", "c"] and store.count("c") == 2


def test_a_collection_of_another_size_stores_nothing(spark, folder):
    store = CollectionStore(spark, folder + "/store")
    store.create("c", 5)
    store.create("d", 2)
    objects = spark.createDataFrame([("a", "one"), ("b", "two")], "key string, text string")
    checkpoint = Checkpoint(spark, folder + "/keys")
    report = ingest_documents(objects, "lake", lambda: two_sizes, {"c": Target(store, "c")}, checkpoint)
    assert {(r.success, r.error_message) for r in report.results.collect()} == {(False, "Upsert failed")}
    assert store.count("c") == 0 and checkpoint.keys("documents").count() == 0
    both = {"c": Target(store, "c"), "d": Target(store, "d")}
    assert {r.success for r in ingest_documents(objects, "lake", lambda: two_sizes, both).results.collect()} == {True}
    assert {r.success for r in ingest_documents(objects, "lake", lambda: two_sizes, both, require="all").results.collect()} == {False}


def test_an_error_without_text_is_reported(spark):
    def fail(batch):
        raise ValueError()

    row = write_sinks(spark.range(2), {"x": fail}).first()
    assert (row.success, row.error) == (False, "ValueError")


def point_files(spark, path, *ids, dim=2):
    spark.createDataFrame([(i, [float(i)] * dim) for i in ids], "id bigint, vector array<float>").write.parquet(path)
    return point_stream(spark, path, spark.read.parquet(path).schema)


def test_two_streams_into_one_collection(spark, folder):
    store = CollectionStore(spark, folder + "/store")
    store.create("c", 2, n_buckets=2)
    for name, ids in (("x", (1, 2, 3)), ("y", (4, 5, 6))):
        upsert_stream(point_files(spark, f"{folder}/{name}", *ids), store, "c", f"{folder}/check-{name}")
    assert sorted(r.id for r in store.read("c").collect()) == [1, 2, 3, 4, 5, 6]


def test_a_stream_does_not_pass_over_refused_rows(spark, folder):
    store = CollectionStore(spark, folder + "/store")
    store.create("c", 2, n_buckets=2)
    reports = []
    upsert_stream(point_files(spark, f"{folder}/x", 1, dim=3), store, "c", f"{folder}/check-x",
                  on_report=lambda report, number: reports.append(report.rejected_rows))
    assert reports == [1]
    with pytest.raises(Exception, match="refused"):
        upsert_stream(point_files(spark, f"{folder}/y", 1, dim=3), store, "c", f"{folder}/check-y")
