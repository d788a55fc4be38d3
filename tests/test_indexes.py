"""Indexes under writes, codes of residuals and turned vectors, trees of centroids, probing by filter and by bucket."""

import datetime
import random

import numpy as np
import pytest
from larkspur.operators.centroid_tree import CentroidTree
from larkspur.operators.collections import CollectionStore
from larkspur.operators.ivf import IvfIndex, PqModel, _plane, pq_encode, search_pq
from larkspur.operators.metrics import recall_at_k
from larkspur.operators.multiprobe import MultiProbeIndex
from larkspur.operators.scoring import QueryBlock
from larkspur.operators.search import Layout, search_batch
from tests.test_search import as_queries, expected, found


@pytest.fixture(scope="module")
def clustered():
    """4 000 points in 40 groups of 16 dimensions, more spread in some directions than in others."""
    rng = np.random.default_rng(11)
    centres = rng.normal(size=(40, 16)) * 4
    mixed = rng.normal(size=(16, 16))
    data = centres[np.arange(4000) % 40] + rng.normal(size=(4000, 16)) * np.geomspace(1.5, 0.05, 16) @ mixed
    return data.astype(np.float32)


def frame_of(spark, data, first=0):
    rows = [(first + i, v.tolist(), f"s{i % 7}") for i, v in enumerate(data)]
    return spark.createDataFrame(rows, "id bigint, vector array<float>, species string").repartition(3)


def state_of(index):
    return {r.id: (tuple(r.vector), r.species) for r in index.rows().collect()}


def test_index_follows_random_writes(spark, folder):
    rng, made = random.Random(3), np.random.default_rng(3)
    store, kept = CollectionStore(spark, folder), {}
    point = lambda i: (i, made.normal(size=4).astype(np.float32).tolist(), f"s{rng.randint(0, 2)}")
    schema = "id bigint, vector array<float>, species string"
    first = [point(i) for i in range(120)]
    store.load("c", spark.createDataFrame(first, schema), 4, "l2", n_buckets=4)
    store.build_index("c", n_lists=5, filter_columns=["species"], subspaces=2, n_codes=8)
    kept.update({r[0]: r for r in first})
    for step in range(6):
        if step == 3:
            assert store.fold_index("c") and not store.fold_index("c")
        if step % 2:
            gone = rng.sample(range(140), 25)
            store.delete("c", spark.createDataFrame([(i,) for i in gone], "id bigint"))
            for i in gone:
                kept.pop(i, None)
        else:
            new = [point(i) for i in rng.sample(range(140), 30)]
            store.upsert("c", spark.createDataFrame(new, schema))
            kept.update({r[0]: r for r in new})
        index = store.index("c")
        assert index is not None and store.describe("c").first().index_status == "indexed"
        assert state_of(index) == {i: (tuple(v), s) for i, v, s in kept.values()}
        assert index.rows().count() == len(kept)
    queries = as_queries(spark, made.normal(size=(5, 4)))
    exact = search_batch(store.read("c"), queries, 6, "l2")
    assert recall_at_k(index.search(queries, 6, 5), exact, 6).first().recall == 1.0
    assert recall_at_k(index.search_codes(queries, 6, 5, refine=30), exact, 6).first().recall == 1.0
    # A reader of an earlier version is not disturbed by later ones, nor by folding.
    version = store.manifest("c").version
    before = state_of(store.index("c", version))
    store.fold_index("c")
    store.delete("c", spark.range(200).selectExpr("id"))
    assert store.index("c").rows().count() == 0 and state_of(store.index("c", version)) == before


def test_folding_writes_lists_with_changes_only(spark, folder, clustered):
    store = CollectionStore(spark, folder)
    store.load("c", frame_of(spark, clustered[:800]), 16, "l2", n_buckets=2)
    store.build_index("c", n_lists=20)
    moved = frame_of(spark, clustered[:3], first=5000)
    store.upsert("c", moved)
    assert not store.fold_index("c", when=0.5)
    assert store.fold_index("c", when=0.001)
    state = store.index("c").state
    assert state["gone"] == [] and [p["folder"].split("-")[0] for p in state["parts"]] == ["lists", "folded"]
    assert 17 <= len(state["parts"][0]["lists"]) < 20 and store.index("c").rows().count() == 803
    plan = store.index("c").search(as_queries(spark, clustered[:1]), 3, 1)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "ivf_list" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_index_of_an_unchanged_batch(spark, folder, clustered):
    store = CollectionStore(spark, folder)
    store.load("c", frame_of(spark, clustered[:50]), 16, n_buckets=2)
    store.build_index("c", n_lists=3)
    store.upsert("c", frame_of(spark, clustered[:0]).limit(0), batch=("s", 0))
    assert store.index("c") is not None and store.manifest("c").applied == {"s": 0}
    with pytest.raises(ValueError, match="no current index"):
        store.create("d", 3)
        store.fold_index("d")


@pytest.mark.parametrize("metric", ["l2", "ip", "cosine"])
def test_codes_of_residuals_score_as_decoded(spark, folder, clustered, metric):
    frame = frame_of(spark, clustered[:600])
    plain = IvfIndex.build(frame, f"{folder}/plain", 6, metric)
    pq = PqModel.train(frame, 16, 4, 16, metric, centroids=plain.centroids, rotations=1)
    IvfIndex.build(frame, f"{folder}/coded", 6, metric, pq=pq, centroids=plain.centroids)
    index = IvfIndex.open(spark, f"{folder}/coded")
    assert index.pq.residual and np.allclose(index.pq.rotation, pq.rotation)
    rows = index.rows().select("id", "ivf_list", "code").collect()
    codes = np.array([list(r.code) for r in rows])
    decoded = index.centroids[[r.ivf_list for r in rows]] + index.pq.decode_matrix(codes)
    q = clustered[7].astype(float) + 0.1
    unit = q / np.linalg.norm(q) if metric == "cosine" else q
    scores = -((decoded - unit) ** 2).sum(1) if metric == "l2" else decoded @ unit
    best = sorted(zip(-np.round(scores, 4), [r.id for r in rows]))[:8]
    got = index.search_codes(as_queries(spark, [q]), 8, 6, refine=0).orderBy("rank").collect()
    assert np.allclose([r.score for r in got], [-b[0] for b in best], atol=2e-3)


def test_residuals_find_more(spark, folder, clustered):
    frame = frame_of(spark, clustered)
    base = IvfIndex.build(frame, f"{folder}/base", 24, "l2")
    queries = as_queries(spark, clustered[:200].astype(float) + 0.05)
    exact = search_batch(frame, queries, 10, "l2")
    recall = {}
    for name, kwargs in {"plain": {}, "residual": {"centroids": base.centroids}, "both": {"centroids": base.centroids, "rotations": 3}}.items():
        pq = PqModel.train(frame, 16, 4, 64, "l2", **kwargs)
        index = IvfIndex.build(frame, f"{folder}/{name}", 24, "l2", pq=pq, centroids=base.centroids)
        recall[name] = recall_at_k(index.search_codes(queries, 10, 8, refine=0), exact, 10).first().recall
    # All have four bytes a row.
    assert recall["residual"] > recall["plain"] + 0.05 and recall["both"] > 0.7305, recall


def test_rotation_finds_more(spark, folder):
    rng = np.random.default_rng(4)
    data = (rng.normal(size=(3000, 16)) * np.geomspace(3, 0.1, 16)).astype(np.float32)
    frame, queries = frame_of(spark, data), as_queries(spark, data[:150].astype(float))
    exact, recall = search_batch(frame, queries, 10, "l2"), {}
    for turns in (0, 1, 3):
        pq = PqModel.train(frame, 16, 4, 32, "l2", rotations=turns)
        if turns:
            assert np.allclose(pq.rotation @ pq.rotation.T, np.eye(16), atol=1e-9)
        coded = pq_encode(frame, pq).select("id", "code")
        recall[turns] = recall_at_k(search_pq(coded, queries, pq, 10), exact, 10).first().recall
    assert recall[1] > recall[0] + 0.05 and recall[3] > recall[0] + 0.05, recall


# Trees of centroids


def flat(points, centroids, n):
    apart = ((points[:, None, :] - centroids[None]) ** 2).sum(-1)
    return np.argsort(np.round(apart, 9), axis=1, kind="stable")[:, :n]


@pytest.mark.parametrize("n", [1, 5, 300])
@pytest.mark.parametrize("spread", [1, 20])
def test_tree_finds_what_a_scan_finds(n, spread):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(30, 16)) * spread
    draw = lambda k: centres[rng.integers(0, 30, k)] + rng.normal(size=(k, 16))
    leaves, points = draw(300), draw(200)
    leaves[10:14] = leaves[9]
    tree = CentroidTree(centres, leaves)
    assert (tree.nearest(points, n) == flat(points, leaves, n)).all()
    # Where centroids lie in groups, few of the groups are looked at.
    assert n > 5 or spread == 1 or tree.compared < 0.15 * len(points) * len(leaves)


def test_index_on_a_tree(spark, folder, clustered):
    frame = frame_of(spark, clustered[:2000])
    tree = CentroidTree.train(frame, 60, by_direction=False)
    assert 40 <= len(tree.leaves) <= 80 and len(tree.upper) == 7
    IvfIndex.build(frame, f"{folder}/t", metric="l2", tree=tree)
    index = IvfIndex.open(spark, f"{folder}/t")
    placed = {r.id: r.ivf_list for r in index.rows().collect()}
    own = flat(clustered[:2000].astype(float), tree.leaves, 1)[:, 0]
    assert [placed[i] for i in range(2000)] == own.tolist()
    queries = as_queries(spark, clustered[:30].astype(float) + 0.01)
    exact = search_batch(frame, queries, 5, "l2")
    assert recall_at_k(index.search(queries, 5, 99), exact, 5).first().recall == 1.0
    assert recall_at_k(index.search(queries, 5, 10), exact, 5).first().recall > 0.8


# Probing by filter


def test_lists_are_probed_until_enough_rows_pass(spark, folder, clustered):
    rows = [(i, v.tolist(), "rare" if i % 97 == 0 else "two" if i in (5, 800) else f"s{i % 3}", datetime.date(2024, 1 + i % 12, 1))
            for i, v in enumerate(clustered[:1500])]
    frame = spark.createDataFrame(rows, "id bigint, vector array<float>, species string, observed_on date").repartition(3)
    index = IvfIndex.build(frame, f"{folder}/i", 30, "l2", filter_columns=["species", "observed_on"])
    extra = [(s, m) for s in ("rare", "two", "none", "", "s1") for m in (None, ["Feb"])]
    vectors = clustered[[3, 3, 4, 4, 5, 5, 6, 6, 7, 7]].astype(float)
    queries = as_queries(spark, vectors, extra, ", species string, months array<string>")
    passes = lambda q, i: (not extra[q][0] or rows[i][2] == extra[q][0]) and (extra[q][1] is None or rows[i][3].month == 2)
    possible = [sum(passes(q, i) for i in range(1500)) for q in range(10)]
    fixed, filled = found(index.search(queries, 8, 2), 10), found(index.search_filled(queries, 8, 2), 10)
    assert any(len(a) < min(8, n) for a, n in zip(fixed, possible))
    assert [len(a) for a in filled] == [min(8, n) for n in possible]
    assert all(passes(q, i) for q in range(10) for i in filled[q])
    exact = expected(clustered[:1500].astype(float), vectors, "l2", 8, passes)
    assert found(index.search_filled(queries, 8, 30), 10) == exact
    # Few rows of a kind are all found, and only the lists that hold them are read.
    assert filled[2] == exact[2] and filled[4] == []
    counts = index._counts_of(QueryBlock(np.arange(1), vectors[:1], {"species": np.array(["two"], object)}), Layout())
    assert counts[2].sum() == 2


def test_filled_search_after_changes(spark, folder, clustered):
    store = CollectionStore(spark, folder)
    store.load("c", frame_of(spark, clustered[:300]), 16, "l2", n_buckets=2)
    store.build_index("c", n_lists=12, filter_columns=["species"])
    new = spark.createDataFrame([(9000 + i, clustered[i].tolist(), "new") for i in range(12)], "id bigint, vector array<float>, species string")
    store.upsert("c", new)
    queries = as_queries(spark, clustered[:1].astype(float), [("new",)], ", species string")
    for _ in range(2):
        assert sorted(found(store.index("c").search_filled(queries, 12, 1), 1)[0]) == list(range(9000, 9012))
        store.fold_index("c")
    assert store.index("c").state["synopsis"]


# Probing by bucket


def test_probes_come_in_order_of_their_cost(spark, folder, clustered):
    index = MultiProbeIndex.build(frame_of(spark, clustered[:500]), f"{folder}/m", "l2", bits=5)
    mean = clustered[:500].astype(float).mean(axis=0)
    planes = np.stack([_plane(42, 0, b, 16) for b in range(5)], axis=1)
    assert np.allclose(index.mean, mean)
    for v, probes in zip(clustered[:20].astype(float), index.probes(clustered[:20], 32)):
        p = (v - mean) @ planes
        cost = [sum(p[b] ** 2 for b in range(5) if (p[b] >= 0) != bool(n >> 4 - b & 1)) for n in range(32)]
        assert probes.tolist() == sorted(range(32), key=lambda n: (round(cost[n], 9), n)) and cost[probes[0]] == 0


def test_probing_buckets(spark, folder, clustered):
    frame = frame_of(spark, clustered)
    MultiProbeIndex.build(frame, f"{folder}/m", "cosine", bits=7, filter_columns=["species"])
    index = MultiProbeIndex(spark, f"{folder}/m")
    assert index.stored.count() == 4000
    queries = as_queries(spark, clustered[:100].astype(float) + 0.1)
    exact = search_batch(frame, queries, 10)
    recall = [recall_at_k(index.search(queries, 10, n), exact, 10).first().recall for n in (1, 19, 128)]
    assert recall[0] < recall[1] < recall[2] == 1.0 and recall[1] > 0.36
    one = as_queries(spark, clustered[:1].astype(float), [("s3",)], ", species string")
    assert all(i % 7 == 3 for i in found(index.search(one, 10, 128), 1)[0])
    plan = index.search(one, 3, 2)._jdf.queryExecution().executedPlan().toString()
    assert "ivf_list" in plan.split("PartitionFilters: [")[1].split("]")[0]
    with pytest.raises(ValueError):
        MultiProbeIndex.build(frame, f"{folder}/n", bits=30)
