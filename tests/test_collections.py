"""Versioned collections."""

import pytest
from pyspark.sql import functions as F

from larkspur import files
from larkspur.operators import collections as module
from larkspur.operators.collections import CollectionMissing, CollectionStore, ConflictError


def rows(spark, *items):
    return spark.createDataFrame([(i, [float(a), float(b)], t) for i, a, b, t in items], "id bigint, vector array<float>, tag string")


def state(store, name, version=None):
    return {r.id: (r.vector, r.tag) for r in store.read(name, version).collect()}


@pytest.fixture
def store(spark, folder):
    store = CollectionStore(spark, folder)
    store.create("c", 2, n_buckets=4)
    return store


@pytest.fixture(params=["broadcast", "shuffle"])
def either_way(request, spark):
    """Both joins that Spark may choose: with broadcast ids and with a shuffle."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    if request.param == "shuffle":
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_create_twice_changes_nothing(store):
    first = store.manifest("c")
    assert store.create("c", 99, "l2") == first
    assert store.exists("c") and store.names() == ["c"] and store.count("c") == 0


def test_missing(store):
    with pytest.raises(CollectionMissing):
        store.read("nothing")


def test_upsert_overwrites(spark, store, either_way):
    store.upsert("c", rows(spark, (1, 1, 1, "v1"), (2, 2, 2, "v1"), (3, 3, 3, "v1")))
    store.upsert("c", rows(spark, (2, 9, 9, "v2"), (4, 4, 4, "v2")))
    assert state(store, "c") == {1: ([1, 1], "v1"), 2: ([9, 9], "v2"), 3: ([3, 3], "v1"), 4: ([4, 4], "v2")}


def test_upsert_twice_is_once(spark, store, either_way):
    batch = rows(spark, *[(i, i, -i, "x") for i in range(50)])
    store.upsert("c", batch)
    once = state(store, "c")
    store.upsert("c", batch)
    assert state(store, "c") == once and len(once) == 50


def test_upsert_of_nothing(spark, store):
    before = store.manifest("c")
    assert store.upsert("c", spark.createDataFrame([], "id bigint, vector array<float>, tag string")).written == 0
    assert store.manifest("c") == before


def test_order_decides_inside_a_batch(spark, store):
    batch = rows(spark, (1, 1, 1, "a"), (1, 2, 2, "c"), (1, 3, 3, "b"))
    store.upsert("c", batch, order_by="tag")
    assert state(store, "c") == {1: ([2, 2], "c")}


def test_hot_id(spark, store, either_way):
    """A third of all rows share one id."""
    n = F.col("id")
    hot = spark.range(3000).select(
        F.when(n % 3 == 0, F.lit(7)).otherwise(n + 10_000).alias("id"), F.array(n.cast("float"), n.cast("float")).alias("vector"),
        n.alias("seq"))
    store.upsert("c", hot, order_by="seq")
    store.upsert("c", hot, order_by="seq")
    assert store.count("c") == 2001
    assert store.read("c").filter("id = 7").first().seq == 2997


def test_refused_rows(spark, store):
    bad = spark.createDataFrame([(1, [1.0, 2.0], "ok"), (2, [1.0], "short"), (3, None, "none"), (None, [1.0, 1.0], "id")],
                                "id bigint, vector array<float>, tag string")
    report = store.upsert("c", bad)
    assert (report.written, report.rejected_rows) == (1, 3)
    assert {(r.id, r.reason) for r in report.rejected.collect()} == {
        (2, "vector has 1 dimensions, expected 2"), (3, "vector is null"), (None, "id is null")}
    assert set(state(store, "c")) == {1}


def test_delete(spark, store, either_way):
    store.upsert("c", rows(spark, *[(i, i, i, "x") for i in range(20)]))
    store.delete("c", spark.createDataFrame([(3,), (4,), (99,), (3,)], "id bigint"))
    assert set(state(store, "c")) == set(range(20)) - {3, 4}
    store.delete("c", store.read("c").select("id"))
    assert state(store, "c") == {} and store.count("c") == 0
    store.upsert("c", rows(spark, (3, 1, 2, "back")))
    assert state(store, "c") == {3: ([1, 2], "back")}


def test_old_versions_stay_readable(spark, store):
    store.upsert("c", rows(spark, (1, 1, 1, "v1")))
    first = store.manifest("c").version
    reader = store.read("c")
    store.upsert("c", rows(spark, (1, 2, 2, "v2")))
    assert reader.first().tag == "v1" and state(store, "c", first) == {1: ([1, 1], "v1")}
    assert store.vacuum("c", keep=1) == []  # may belong to a write in progress
    assert store.vacuum("c", keep=1, older_than_hours=0)
    assert state(store, "c") == {1: ([2, 2], "v2")}


def test_only_touched_buckets_are_rewritten(spark, store):
    store.upsert("c", rows(spark, *[(i, i, i, "x") for i in range(100)]))
    before = store.manifest("c").folders
    store.upsert("c", rows(spark, (5, 0, 0, "y")))
    after = store.manifest("c").folders
    assert sum(before[b] != after[b] for b in before) == 1 and len(before) == 4


def test_new_columns_are_added(spark, store):
    store.upsert("c", rows(spark, (1, 1, 1, "x")))
    store.upsert("c", rows(spark, (2, 2, 2, "y")).withColumn("extra", F.lit(5)))
    assert {r.id: r.extra for r in store.read("c").collect()} == {1: None, 2: 5}


def test_conflicting_writers(spark, store):
    manifest = store.manifest("c")
    store.upsert("c", rows(spark, (1, 1, 1, "x")))
    with pytest.raises(ConflictError):
        store._publish(module.replace(manifest, version=manifest.version + 1))
    assert set(state(store, "c")) == {1}


def test_half_written_manifest_is_not_published(spark, store):
    store.upsert("c", rows(spark, (1, 1, 1, "x")))
    files.create(spark, f"{store.root}/c/manifests/00000099.json", '{"name": "c", "di')
    assert set(state(store, "c")) == {1}


def test_batches_apply_once(spark, store):
    store.upsert("c", rows(spark, (1, 1, 1, "first")), batch=("s", 0))
    store.upsert("c", rows(spark, (1, 2, 2, "again")), batch=("s", 0))
    store.upsert("c", rows(spark, (2, 2, 2, "next")), batch=("s", 1))
    store.upsert("c", rows(spark, (3, 3, 3, "other")), batch=("t", 0))
    assert {k: v[1] for k, v in state(store, "c").items()} == {1: "first", 2: "next", 3: "other"}


def test_drop_and_create_again(spark, store):
    store.upsert("c", rows(spark, (1, 1, 1, "x")))
    store.drop("c")
    assert not store.exists("c") and store.names() == []
    store.create("c", 3)
    assert store.manifest("c").dim == 3 and store.count("c") == 0


def test_copy_replaces(spark, store, folder):
    store.upsert("c", rows(spark, (1, 1, 1, "x"), (2, 2, 2, "y")))
    other = CollectionStore(spark, folder + "-other")
    other.create("c", 2)
    other.upsert("c", rows(spark, (9, 9, 9, "old")))
    assert store.copy("c", other) == 2
    assert state(other, "c") == state(store, "c")


def test_load_and_describe(spark, folder):
    store = CollectionStore(spark, folder)
    n = store.load("big", spark.range(500).select("id", F.array(F.col("id").cast("float"), F.lit(1.0)).alias("vector")), 2, "l2", 4)
    assert (n.written, n.rejected_rows) == (500, 0)
    row = store.describe("big").first()
    assert (row.points, row.min_dim, row.max_dim, row.null_vectors, row.index_status, row.metric) == (500, 2, 2, 0, "none", "l2")
    store.build_index("big", n_lists=4)
    assert store.describe("big").first().index_status == "indexed" and store.index("big").rows().count() == 500
    store.upsert("big", spark.range(1).select("id", F.array(F.lit(1.0), F.lit(1.0)).alias("vector")))
    assert store.describe("big").first().index_status == "indexed" and store.index("big").rows().count() == 500


def test_small_updates_do_not_shuffle_old_rows(spark, store):
    store.upsert("c", rows(spark, *[(i, i, i, "x") for i in range(100)]))
    old = store._read_buckets(store.manifest("c"), {0, 1, 2, 3})
    kept = old.join(F.broadcast(spark.createDataFrame([(1, 5)], "bucket int, id bigint")), ["bucket", "id"], "left_anti")
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan


def test_load_reports_refused_rows(spark, folder):
    store = CollectionStore(spark, folder)
    points = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0]), (3, None), (None, [1.0, 2.0])], "id bigint, vector array<float>")
    report = store.load("c", points, 2, n_buckets=4)
    assert (report.written, report.rejected_rows) == (1, 3)
    assert {r.id: r.reason for r in report.rejected.collect()} == {
        2: "vector has 1 dimensions, expected 2", 3: "vector is null", None: "id is null"}
    again = store.load("c", points, 2)
    assert (again.written, again.rejected_rows) == (1, 3)


def test_ids_of_another_integer_type(spark, store, either_way):
    ids = spark.range(100)
    with_vector = lambda df: df.select("id", F.array(F.col("id").cast("float"), F.lit(0.0)).alias("vector"))
    store.upsert("c", with_vector(ids))
    store.upsert("c", with_vector(ids.select(F.col("id").cast("int").alias("id"))))
    assert store.count("c") == 100 and store.read("c").schema["id"].dataType.simpleString() == "bigint"
    store.delete("c", ids.where("id < 90").select(F.col("id").cast("smallint").alias("id")))
    assert store.count("c") == 10
    with pytest.raises(ValueError):
        store.delete("c", ids.select(F.col("id").cast("string").alias("id")))


def test_ids_that_do_not_fit_are_refused(spark, folder):
    store = CollectionStore(spark, folder)
    narrow = spark.range(3).select(F.col("id").cast("int").alias("id"), F.array(F.lit(1.0)).alias("vector"))
    store.load("c", narrow, 1, n_buckets=2)
    wide = spark.createDataFrame([(2**40, [1.0]), (1, [2.0])], "id bigint, vector array<float>")
    report = store.upsert("c", wide)
    assert (report.written, report.rejected_rows) == (1, 1)
    assert report.rejected.first().reason == "id does not fit the type of the collection"
    store.delete("c", wide.select("id"))
    assert sorted(r.id for r in store.read("c").collect()) == [0, 2]


def test_replayed_batches_still_report_refusals(spark, store):
    bad = spark.createDataFrame([(1, [1.0])], "id bigint, vector array<float>")
    first, again = (store.upsert("c", bad, batch=("s", 0)) for _ in range(2))
    assert first.rejected_rows == again.rejected_rows == 1


def test_copy_keeps_the_target_until_the_end(spark, store, folder):
    store.upsert("c", rows(spark, (1, 1, 1, "x")))
    other = CollectionStore(spark, folder + "-other")
    other.load("c", rows(spark, (9, 9, 9, "old")), 2)
    reader = other.read("c")
    store.copy("c", other)
    assert [r.id for r in reader.collect()] == [9] and [r.id for r in other.read("c").collect()] == [1]
