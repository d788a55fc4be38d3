import numpy as np

from larkspur.llm.queries import op9_vector_neighbours
from larkspur.llm.vector_neighbours import near_vectors
from tests.llm.cases import tables, with_clashes


def crowd(seed=0, n=300, dim=32):
    rng = np.random.default_rng(seed)
    rows = rng.normal(size=(n, dim))
    for k in range(0, n, 3):
        rows[k] = rows[(k * 7) % n] + rng.normal(size=dim) * rng.choice([0.05, 0.2, 0.4])
    rows[::10] = rows[0]
    return rows.astype(np.float32)


def brute(rows, threshold):
    x = rows.astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= threshold
    np.fill_diagonal(near, False)
    label = np.arange(len(x))
    for _ in range(len(x)):
        low = np.minimum(label, np.where(near, label[None], len(x)).min(axis=1))
        if (low == label).all():
            break
        label = low
    return near.sum(axis=1), label


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")


def test_equals_brute_force(spark):
    rows = crowd()
    got = {r["id"]: r for r in near_vectors(frame(spark, [(k, v.tolist(), 0) for k, v in enumerate(rows)]), "vec_id", "embedding").collect()}
    links, label = brute(rows, 0.9)
    assert [got[k]["n_links"] for k in range(len(rows))] == links.tolist()
    assert [got[k]["component"] for k in range(len(rows))] == label.tolist()
    assert all(got[k]["kept"] == (label[k] == k) for k in range(len(rows)))


def test_recall_on_the_given_vectors(spark, data):
    found = {r["vec_id"]: r["n_links"] for r in op9_vector_neighbours(spark, data).collect()}
    table = spark.read.parquet(f"{data}/embeddings.parquet").collect()
    links, _ = brute(np.array([r["embedding"] for r in table]), 0.9)
    assert len(found) == len(table) and sum(found.values()) >= 0.9 * links.sum()
    assert all(found[r["vec_id"]] <= n for r, n in zip(table, links))


def test_a_crowd_of_near_copies_is_one_component(spark):
    rng = np.random.default_rng(1)
    rows = rng.normal(size=16) + rng.normal(size=(2500, 16)) * 0.05
    got = near_vectors(frame(spark, [(k, v.tolist(), 0) for k, v in enumerate(rows)]), "vec_id", "embedding").collect()
    assert {r["component"] for r in got} == {0} and min(r["n_links"] for r in got) > 0


def test_cases(spark, folder):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 0), (2, [2.0, 0.0], 1), (3, [1.0, 0.0], 2), (4, None, 0), (5, [], 0), (6, [0.0, 0.0], 0),
            (7, [0.0, 0.0], 0), (8, [1.0, None], 0), (9, [nan, 1.0], 0), (10, [inf, 1.0], 0), (None, [1.0, 0.0], 0),
            (11, [1.0], 0), (12, [1.0, 0.0, 0.0], 0), (13, [-1.0, 0.0], 0), (14, [0.0, -0.0], 0), (3, [1.0, 0.0], 2)]
    table = with_clashes(frame(spark, rows), ["id", "class", "vector", "component", "n_links"])
    got = op9_vector_neighbours(spark, tables(spark, f"{folder}/t", embeddings=table)).collect()
    assert len(got) == len(rows)
    links = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in got}
    assert links[1] == (3, 1, True) and links[2] == (3, 1, False) and links[3] == (3, 1, False)
    assert all(links[k] == (0, k, True) for k in (4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14)) and links[None] == (0, None, False)
    assert near_vectors(frame(spark, []), "vec_id", "embedding").count() == 0
    assert near_vectors(frame(spark, [(1, None, 0)]), "vec_id", "embedding").count() == 1
