"""Exact and approximate search."""

import datetime

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from larkspur.operators import search as search_module
from larkspur.operators.ivf import IvfIndex, LshIndex, PqModel, pq_encode, search_pq
from larkspur.operators.metrics import recall_at_k
from larkspur.operators.scoring import Scorer, TopK, score_rows
from larkspur.operators.search import (
    Layout, filter_condition, rank_results, result_page, search, search_batch, search_exact, with_payload, with_total,
)

METRICS = ("cosine", "ip", "l2", "l1")


def brute(rows: np.ndarray, queries: np.ndarray, metric: str) -> np.ndarray:
    if metric == "ip":
        return queries @ rows.T
    if metric == "cosine":
        norms = np.linalg.norm(queries, axis=1)[:, None] * np.linalg.norm(rows, axis=1)[None, :]
        return np.where(norms > 0, queries @ rows.T / np.where(norms > 0, norms, 1), 0.0)
    diff = queries[:, None, :] - rows[None, :, :]
    return -np.sqrt((diff ** 2).sum(-1)) if metric == "l2" else -np.abs(diff).sum(-1)


@pytest.fixture(scope="module")
def sample(spark):
    """256 points of 64 dimensions from 0 to 100, with copies, in several partitions."""
    rng = np.random.default_rng(42)
    data = rng.uniform(0, 100, (256, 64)).astype(np.float32)
    data[200:230] = data[7]
    days = [datetime.date(2024, 1, 1) + datetime.timedelta(days=int(i)) for i in range(256)]
    rows = [(int(i), data[i].tolist(), f"s{i % 5}", (float(i % 90), float(i % 180)), days[i]) for i in range(256)]
    frame = spark.createDataFrame(
        rows, "id bigint, vector array<float>, species string, location struct<lat:double,lon:double>, observed_on date")
    return frame.repartition(5).cache(), data.astype(np.float64)


def expected(data, queries, metric, k, allowed=None):
    scores = brute(data, queries, metric)
    out = []
    for q in range(len(queries)):
        ids = [i for i in range(len(data)) if allowed is None or allowed(q, i)]
        ids.sort(key=lambda i: (-round(scores[q, i], 9), i))
        out.append(ids[:k])
    return out


def found(results, n):
    rows = results.orderBy("query_id", "rank").collect()
    return [[r.id for r in rows if r.query_id == q] for q in range(n)]


def as_queries(spark, vectors, extra=None, schema=""):
    rows = [(i, [float(x) for x in v], *(extra[i] if extra else ())) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, f"query_id bigint, vector array<double>{schema}")


@pytest.mark.parametrize("metric", METRICS)
def test_batch_matches_brute_force(spark, sample, metric):
    frame, data = sample
    queries = data[[3, 7, 100, 255]] + 0.25
    got = search_batch(frame, as_queries(spark, queries), 10, metric)
    assert found(got, 4) == expected(data, queries, metric, 10)


@pytest.mark.parametrize("metric", METRICS)
def test_scores_are_exact(spark, sample, metric):
    frame, data = sample
    rows = search_exact(frame, data[11], 5, metric).collect()
    scores = brute(data, data[11:12], metric)[0]
    for r in rows:
        assert r.score == pytest.approx(scores[r.id], abs=1e-9)


def test_copies_come_in_id_order(spark, sample):
    frame, data = sample
    rows = search(frame, data[7], 40, "cosine").orderBy("rank").collect()
    assert [r.id for r in rows[:31]] == [7, *range(200, 230)]
    assert len({r.score for r in rows[:31]}) == 1


def test_stored_vector_finds_itself(spark, sample):
    frame, data = sample
    for i in (0, 50, 255):
        best = search_exact(frame, data[i], 1).first()
        assert best.id == i and best.score > 0.99


def test_fewer_rows_than_k(spark, sample):
    frame, data = sample
    assert search(frame.filter("id < 3"), data[0], 10).count() == 3
    assert search(frame.filter("id < 0"), data[0], 10).count() == 0


def test_no_queries(spark, sample):
    frame, data = sample
    assert search_batch(frame, as_queries(spark, data[:1]).limit(0), 5).count() == 0


def test_filters_of_one_query(spark, sample):
    frame, data = sample
    filters = {"species": "s2", "latitude_min": 0.0, "latitude_max": 60.0, "longitude_min": 0.0, "longitude_max": 100.0,
               "start_date": "2024-01-10", "months": ["Jan", "Mar"]}
    got = [r.id for r in search(frame, data[0], 50, "ip", filters).orderBy("rank").collect()]

    def allowed(_, i):
        day = datetime.date(2024, 1, 1) + datetime.timedelta(days=i)
        return i % 5 == 2 and i % 90 <= 60 and i % 180 <= 100 and day >= datetime.date(2024, 1, 10) and day.month in (1, 3)

    assert got == expected(data, data[:1], "ip", 50, allowed)[0] and got


def test_empty_filters_do_not_filter(spark, sample):
    frame, data = sample
    all_rows = search(frame, data[0], 256, "ip", {"species": "", "latitude_min": 1.0, "months": []})
    assert all_rows.count() == 256
    with pytest.raises(ValueError, match="unknown filters"):
        filter_condition(Layout(), {"colour": "red"})


def test_filters_of_each_query(spark, sample):
    frame, data = sample
    day = datetime.date
    extra = [
        ("s1", None, None, None, None, None, None, None),
        (None, 0.0, 30.0, 10.0, 50.0, None, None, None),
        ("s3", None, None, None, None, day(2024, 3, 1), day(2024, 6, 1), None),
        ("", None, None, None, None, None, None, ["Feb", "Aug"]),
        ("missing", None, None, None, None, None, None, None),
        (None, 0.0, 90.0, 100.0, 20.0, None, None, []),
    ]
    schema = (", species string, latitude_min double, latitude_max double, longitude_min double, longitude_max double,"
              " start_date date, end_date date, months array<string>")

    def allowed(q, i):
        when = day(2024, 1, 1) + datetime.timedelta(days=i)
        return [
            i % 5 == 1, i % 90 <= 30 and 10 <= i % 180 <= 50, i % 5 == 3 and day(2024, 3, 1) <= when <= day(2024, 6, 1),
            when.month in (2, 8), False, i % 180 >= 100 or i % 180 <= 20][q]

    got = search_batch(frame, as_queries(spark, data[:6], extra, schema), 8, "l2")
    assert found(got, 6) == expected(data, data[:6], "l2", 8, allowed)


def test_null_coordinates_match_no_box(spark):
    frame = spark.createDataFrame(
        [(1, [1.0], (None, None)), (2, [1.0], (0.0, 0.0))], "id bigint, vector array<float>, location struct<lat:double,lon:double>")
    extra, schema = [(-1.0, 1.0, -1.0, 1.0)], ", latitude_min double, latitude_max double, longitude_min double, longitude_max double"
    assert found(search_batch(frame, as_queries(spark, [[1.0]], extra, schema), 5, "ip"), 1) == [[2]]


def test_many_queries_go_block_by_block(spark, sample, monkeypatch):
    frame, data = sample
    monkeypatch.setattr(search_module, "MAX_BLOCK_QUERIES", 20)
    queries = data[:90] + 0.5
    got = search_batch(frame, as_queries(spark, queries), 3, "cosine")
    assert found(got, 90) == expected(data, queries, "cosine", 3)


def test_string_ids(spark, sample):
    frame, data = sample
    named = frame.withColumn("id", F.format_string("id-%04d", "id"))
    queries = as_queries(spark, data[:3]).withColumn("query_id", F.concat(F.lit("q"), F.col("query_id")))
    rows = search_batch(named, queries, 4, "ip").orderBy("query_id", "rank").collect()
    want = [f"id-{i:04d}" for part in expected(data, data[:3], "ip", 4) for i in part]
    assert [r.id for r in rows] == want and rows[0].query_id == "q0"


def test_zero_vectors_score_zero(spark):
    frame = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, [-1.0, 0.0])], "id bigint, vector array<float>")
    rows = search(frame, [2.0, 0.0], 3).orderBy("rank").collect()
    assert [(r.id, r.score) for r in rows] == [(2, 1.0), (1, 0.0), (3, -1.0)]


def test_unequal_dimensions_are_an_error(spark):
    frame = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0])], "id bigint, vector array<float>").coalesce(1)
    with pytest.raises(Exception, match="dimensions"):
        search(frame, [2.0, 0.0], 3).collect()


def test_payload_pages_and_totals(spark, sample):
    frame, data = sample
    results = search_batch(frame, as_queries(spark, data[:2]), 120, "ip")
    with_total_rows = with_total(results)
    assert {r.total for r in with_total_rows.select("total").distinct().collect()} == {120}
    page = result_page(with_total_rows, 2)
    assert page.count() == 40 and page.agg(F.min("rank")).first()[0] == 101
    rows = with_payload(results, frame, ["species"]).collect()
    assert len(rows) == 240 and all(r.species == f"s{r.id % 5}" for r in rows)


def test_plans(spark, sample, folder):
    """Filters and columns reach the scan; one shuffle by query; no pairs of rows."""
    frame, data = sample
    spark.conf.set("spark.sql.maxMetadataStringLength", 5000)
    frame.write.parquet(folder + "/points")
    stored = spark.read.parquet(folder + "/points")
    filtered = search(stored, data[0], 5, "cosine", {"species": "s1", "latitude_min": 0.0, "latitude_max": 9.0,
                                                     "longitude_min": 0.0, "longitude_max": 9.0})
    plan = filtered._jdf.queryExecution().toString()
    assert "EqualTo(species,s1)" in plan and "GreaterThanOrEqual(location.lat,0.0)" in plan
    plan = search_batch(stored, as_queries(spark, data[:2]), 5)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<id:bigint,vector:array<float>>" in plan
    assert plan.count("Exchange") == 1 and "WindowGroupLimit" in plan
    assert "Cartesian" not in plan and "NestedLoop" not in plan


@settings(max_examples=80, deadline=None)
@given(st.integers(1, 6), st.integers(1, 40), st.integers(1, 7), st.sampled_from(METRICS), st.integers(0, 2 ** 31), st.booleans())
def test_task_scorer_against_brute_force(dim, n, k, metric, seed, crowded):
    """The scorer alone, over several batches of small whole numbers, so that copies and ties are frequent."""
    rng = np.random.default_rng(seed)
    rows, queries = rng.integers(-2, 3, (n, dim)).astype(np.float32), rng.integers(-2, 3, (3, dim)).astype(float)
    scorer, top = Scorer(queries, metric), TopK(3, k)
    top.crowded = crowded
    for part in np.array_split(np.arange(n), 3):
        if len(part):
            scorer.prepare(rows[part])
            score_rows(scorer, top, part, np.arange(len(part)), np.arange(3))
    scores = brute(rows.astype(float), queries, metric)
    for q in range(3):
        got = top.score[top.query == q]
        want = np.sort(scores[q])[::-1][:k]
        assert np.allclose(got, want, atol=1e-9)
        order = sorted(range(n), key=lambda i: (-round(scores[q, i], 9), i))[:k]
        assert sorted(top.id[top.query == q]) == sorted(order)


def test_a_third_of_all_rows_are_copies(spark):
    rng = np.random.default_rng(3)
    data = rng.normal(size=(30_000, 8)).astype(np.float32)
    data[::3] = data[0]
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "id bigint, vector array<float>").repartition(4)
    queries = data[[0, 1, 2]].astype(np.float64)
    got = found(search_batch(frame, as_queries(spark, queries), 12), 3)
    model = PqModel.train(frame.limit(2000), 8, subspaces=2, n_codes=16, metric="cosine")
    rough = found(search_pq(pq_encode(frame, model).select("id", "code"), as_queries(spark, queries[:1]), model, 12), 1)
    assert len(rough[0]) == 12
    assert got[0] == list(range(0, 36, 3)) and got[1:] == expected(data.astype(np.float64), queries, "cosine", 12)[1:]


def test_ivf_full_probe_is_exact(spark, sample, folder):
    frame, data = sample
    index = IvfIndex.build(frame, folder + "/ivf", n_lists=8, metric="l2", filter_columns=["species"])
    assert index.rows().count() == 256
    queries = as_queries(spark, data[:5] + 1)
    assert found(index.search(queries, 10, index.n_lists), 5) == expected(data, data[:5] + 1, "l2", 10)
    reopened = IvfIndex.open(spark, folder + "/ivf")
    assert found(reopened.search(queries, 10, 99), 5) == expected(data, data[:5] + 1, "l2", 10)
    plan = index.search(queries.limit(1), 3, 1)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "ivf_list" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_ivf_recall_grows_with_probes(spark, sample, folder):
    frame, data = sample
    index = IvfIndex.build(frame, folder + "/ivf", n_lists=8)
    queries = as_queries(spark, data[:20])
    exact = search_batch(frame, queries, 5)
    recalls = [recall_at_k(index.search(queries, 5, n), exact, 5).first().recall for n in (1, 4, 8)]
    assert recalls == sorted(recalls) and recalls[-1] == 1.0 and all(0 <= r <= 1 for r in recalls)


def test_pq_refined_with_all_candidates_is_exact(spark, sample, folder):
    frame, data = sample
    PqModel.train(frame, 64, subspaces=4, n_codes=16, metric="ip").save(spark, folder + "/pq")
    model = PqModel.load(spark, folder + "/pq")
    coded = pq_encode(frame, model).select("id", "code")
    assert coded.filter(F.length("code") != 4).count() == 0
    queries = as_queries(spark, data[:4])
    got = search_pq(coded, queries, model, 8, 256 // 8, frame)
    assert found(got, 4) == expected(data, data[:4], "ip", 8)
    rough = search_pq(coded, queries, model, 8)
    assert rough.groupBy("query_id").count().filter("count <> 8").count() == 0


def test_codes_of_an_index(spark, sample, folder):
    frame, data = sample
    model = PqModel.train(frame, 64, subspaces=8, n_codes=32, metric="l2")
    IvfIndex.build(frame, folder + "/ivf", n_lists=6, metric="l2", filter_columns=["species"], pq=model)
    index = IvfIndex.open(spark, folder + "/ivf")
    queries = as_queries(spark, data[:6] + 1)
    assert found(index.search_codes(queries, 4, 6, refine=64), 6) == expected(data, data[:6] + 1, "l2", 4)
    rough = index.search_codes(queries, 4, 6, refine=0)
    assert rough.count() == 24
    plan = rough._jdf.queryExecution().executedPlan().toString()
    assert "vector" not in plan.split("ReadSchema: ")[1].split(">")[0]
    extra = [(f"s{i % 5}",) for i in range(6)]
    got = index.search_codes(as_queries(spark, data[:6], extra, ", species string"), 3, 6, refine=100)
    assert found(got, 6) == expected(data, data[:6], "l2", 3, lambda q, i: i % 5 == q % 5)
    plain = IvfIndex.build(frame, folder + "/plain", n_lists=2)
    with pytest.raises(ValueError, match="quantiser"):
        plain.search_codes(queries)


def test_named_vectors(spark):
    frame = spark.createDataFrame([(1, {"image": [1.0, 0.0], "text": [0.0, 1.0]}), (2, {"image": [0.0, 1.0]})],
                                  "id bigint, vectors map<string,array<float>>")
    assert search(frame, [0.0, 1.0], 1, layout=Layout(vector="vectors.image")).first().id == 2
    assert [r.id for r in search(frame, [0.0, 1.0], 5, layout=Layout(vector="vectors.text")).collect()] == [1]


@pytest.mark.parametrize("kwargs", [{"subspaces": 7}, {"n_codes": 300}, {"metric": "l1"}])
def test_pq_refuses(sample, kwargs):
    with pytest.raises(ValueError):
        PqModel.train(sample[0], 64, **kwargs)


def test_lsh_finds_itself_and_only_exact_scores(spark, sample, folder):
    frame, data = sample
    index = LshIndex.build(frame, folder + "/lsh", "cosine", tables=3, bits=3)
    rows = index.search(as_queries(spark, data[:10]), 3).collect()
    scores = brute(data, data[:10], "cosine")
    assert {r.query_id for r in rows if r.rank == 1 and scores[r.query_id, r.id] > 0.999} == set(range(10))
    assert all(r.score == pytest.approx(scores[r.query_id, r.id], abs=1e-6) for r in rows)


def test_rank_results_breaks_ties_by_id(spark):
    rows = spark.createDataFrame([(1, 9, 0.5), (1, 3, 0.5), (1, 4, 0.9)], "query_id int, id int, score double")
    assert [r.id for r in rank_results(rows, 2).orderBy("rank").collect()] == [4, 3]
