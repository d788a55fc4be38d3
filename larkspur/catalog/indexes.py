"""Indexes that follow writes, codes of residuals, lists in two levels, probing by filter and by bucket."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from larkspur.catalog.search import _CODED, _label_means, _rounded, _unit_sql
from larkspur.catalog.tables import LABEL_QUERIES, label_queries, points, score_sql
from larkspur.operators.centroid_tree import CentroidTree
from larkspur.operators.collections import CollectionStore
from larkspur.operators.ivf import IvfIndex, PqModel
from larkspur.operators.multiprobe import MultiProbeIndex
from larkspur.plans.benchmark import run_update_benchmark
from larkspur.session import scratch_path


def _indexed(spark, sf_dir) -> CollectionStore:
    """The vectors with an index around the label means."""
    store = CollectionStore(spark, scratch_path(spark, "store"))
    store.load("vectors", points(spark, sf_dir), 64, n_buckets=8, distinct_ids=True)
    store.build_index("vectors", filter_columns=["species"], centroids=_label_means(spark, sf_dir))
    return store


def _written(spark, sf_dir) -> CollectionStore:
    """Every fifth vector turned round, every seventh deleted, turned ones doubled under new ids, some deleted again."""
    store, rows = _indexed(spark, sf_dir), points(spark, sf_dir)
    turned = rows.where("id % 5 = 0").withColumn("vector", F.transform("vector", lambda x: -x))
    store.upsert("vectors", turned)
    store.delete("vectors", rows.where("id % 7 = 0").select("id"))
    store.upsert("vectors", turned.withColumn("id", F.col("id") + 1_000_000))
    store.delete("vectors", rows.where("id % 11 = 0").select((F.col("id") + 1_000_000).alias("id")))
    store.upsert("vectors", rows.where("id % 35 = 0"))
    return store


def index_after_writes(spark, sf_dir):
    """Three lists probed after upserts and deletes, with the changes noted and with them folded into the lists."""
    store, queries = _written(spark, sf_dir), label_queries(spark, sf_dir)
    noted = _rounded(store.index("vectors").search(queries, 10, 3)).withColumn("folded", F.lit(False))
    store.fold_index("vectors")
    folded = _rounded(store.index("vectors").search(queries, 10, 3)).withColumn("folded", F.lit(True))
    return noted.unionByName(folded)


def index_rows_after_writes(spark, sf_dir):
    """Every row of the index after the same writes, with its list and its whole vector."""
    rows = _written(spark, sf_dir).index("vectors").rows()
    text = F.array_join(F.transform("vector", lambda x: F.round(x.cast("double") * 1000).cast("bigint").cast("string")), ",")
    return rows.select("id", "species", F.col("ivf_list").cast("bigint").alias("list"), F.md5(text).alias("vector_md5"))


def benchmark_update(spark, sf_dir):
    """Insert the label means, delete one label, search three lists of the index and compare with exact results."""
    store, rows, queries = _indexed(spark, sf_dir), points(spark, sf_dir), label_queries(spark, sf_dir)
    inserts = queries.select((F.col("query_id") + 10_000_000).alias("id"), F.col("vector").cast("array<float>").alias("vector"),
                             F.lit("mean").alias("species"))
    report = run_update_benchmark(store, "vectors", inserts, rows.filter("species = '3'").select("id"), queries,
                                  lambda current, q: store.index("vectors").search(q, 10, 3))
    return report.select("points", "queries", "hits", F.round("recall", 6).alias("recall"))


def residual_codes(spark, sf_dir):
    """Codes of what is left of vectors without their list's centroid; four candidates for each result scored again."""
    means = _label_means(spark, sf_dir)
    steps = means - np.roll(means, -1, axis=0)
    model = PqModel(np.split(steps, 8, axis=1), "cosine", residual=True)
    index = IvfIndex.build(points(spark, sf_dir), scratch_path(spark, "residual"), centroids=means, pq=model)
    return _rounded(index.search_codes(label_queries(spark, sf_dir), 10, 3, refine=4))


def lists_by_tree(spark, sf_dir):
    """The list of every vector among many centroids, found by way of an upper level."""
    rows = points(spark, sf_dir)
    leaves = np.array([r.vector for r in rows.where("id < 60").orderBy("id").collect()], np.float64)
    tree = CentroidTree(_label_means(spark, sf_dir), leaves)
    index = IvfIndex.build(rows, scratch_path(spark, "tree"), metric="l2", tree=tree)
    return index.rows().select("id", F.col("ivf_list").cast("bigint").alias("list"))


def _rare(rows):
    """Species that few rows have: the label of every fortieth row, and otherwise common."""
    return rows.withColumn("species", F.when(F.col("id") % 40 < 2, F.concat(F.lit("rare "), "species")).otherwise("common"))


def filled_probes(spark, sf_dir):
    """Lists are probed until five rows of a rare species are found, at least two of those that hold it."""
    index = IvfIndex.build(_rare(points(spark, sf_dir)), scratch_path(spark, "filled"), filter_columns=["species"],
                           centroids=_label_means(spark, sf_dir))
    queries = label_queries(spark, sf_dir)
    queries = queries.withColumn("species", F.concat(F.lit("rare "), F.pmod(F.col("query_id") + 3, F.lit(10)).cast("string")))
    return _rounded(index.search_filled(queries, 5, 2))


def multi_probe(spark, sf_dir):
    """One copy of the rows in 64 buckets, the ten nearest of them probed."""
    index = MultiProbeIndex.build(points(spark, sf_dir), scratch_path(spark, "buckets"), "cosine", bits=6)
    return _rounded(index.search(label_queries(spark, sf_dir), 10, 10))


QUERIES = {
    "index_after_writes": index_after_writes,
    "index_rows_after_writes": index_rows_after_writes,
    "benchmark_update": benchmark_update,
    "residual_codes": residual_codes,
    "lists_by_tree": lists_by_tree,
    "filled_probes": filled_probes,
    "multi_probe": multi_probe,
}

_CENTRES = "centres AS (SELECT query_id AS list, q AS c FROM label_queries)"
_NEAR = f"""
near AS (SELECT query_id, q, list, row_number() OVER (PARTITION BY query_id ORDER BY list_distance({_unit_sql('q')}, c)) AS place
         FROM label_queries, centres)"""
_WRITTEN = f"""{LABEL_QUERIES}, {_CENTRES},
before AS (SELECT vec_id AS id, label::VARCHAR AS species, embedding::DOUBLE[] AS v FROM embeddings),
turned AS (SELECT id, species, list_transform(v, lambda x: -x) AS v FROM before WHERE id % 5 = 0),
after_writes AS (
  SELECT * FROM before WHERE id % 5 <> 0 AND id % 7 <> 0
  UNION ALL SELECT * FROM turned WHERE id % 7 <> 0
  UNION ALL SELECT id + 1000000, species, v FROM turned WHERE id % 11 <> 0
  UNION ALL SELECT * FROM before WHERE id % 35 = 0),
placed AS (SELECT id, species, v, arg_min(list, list_distance({_unit_sql('v')}, c)) AS list FROM after_writes, centres GROUP BY id, species, v)"""


def _best(source: str, k: int, near: str = "near", columns: str = "") -> str:
    return f"""
SELECT query_id, rank, id, round(score, 6) AS score{columns} FROM (
  SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank
  FROM (SELECT query_id, id, {score_sql('cosine', 'v', 'q')} AS score FROM {source} JOIN {near} USING (list) WHERE place <= 3))
WHERE rank <= {k}"""


ORACLES = {
    "index_after_writes": f"""
WITH {_WRITTEN}, {_NEAR}, found AS ({_best('placed', 10)})
SELECT found.*, folded FROM found, (VALUES (false), (true)) f(folded)""",
    "index_rows_after_writes": f"""
WITH {_WRITTEN}
SELECT id, species, list, md5(array_to_string(list_transform(v, lambda x: round(x * 1000)::BIGINT::VARCHAR), ',')) AS vector_md5 FROM placed""",
    "benchmark_update": f"""
WITH {LABEL_QUERIES}, {_CENTRES}, {_NEAR},
rows AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings WHERE label <> 3
         UNION ALL SELECT query_id + 10000000, q::FLOAT[]::DOUBLE[] FROM label_queries),
placed AS (SELECT id, v, arg_min(list, list_distance({_unit_sql('v')}, c)) AS list FROM rows, centres GROUP BY id, v),
found AS ({_best('placed', 10)}),
exact AS (SELECT query_id, id FROM (
  SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY {score_sql('cosine', 'v', 'q')} DESC, id) AS rank
  FROM rows, label_queries) WHERE rank <= 10),
n AS (SELECT count(*) AS queries FROM label_queries)
SELECT (SELECT count(*) FROM rows) AS points, queries, (SELECT count(*) FROM exact JOIN found USING (query_id, id)) AS hits,
       round((SELECT count(*) FROM exact JOIN found USING (query_id, id)) / (queries * 10.0), 6) AS recall
FROM n""",
    "residual_codes": f"""
WITH {_CODED},
steps AS (SELECT a.list, list_transform(list_zip(a.c, b.c), lambda p: p[1] - p[2]) AS step
          FROM centres a JOIN centres b ON b.list = (a.list + 1) % (SELECT count(*) FROM centres)),
left_over AS (SELECT coded.id, coded.v, coded.list, centres.c,
                     list_transform(list_zip({_unit_sql('coded.v')}, centres.c), lambda p: p[1] - p[2]) AS r
              FROM coded JOIN centres USING (list)),
again AS (SELECT id, v, list_concat(
            {', '.join(f"(arg_min(step, list_distance(r[{8 * i + 1}:{8 * i + 8}], step[{8 * i + 1}:{8 * i + 8}])))[{8 * i + 1}:{8 * i + 8}]" for i in range(8))}) AS step,
            any_value(c) AS c, any_value(left_over.list) AS list
          FROM left_over, steps GROUP BY id, v),
whole AS (SELECT id, v, list, list_transform(list_zip(c, step), lambda p: p[1] + p[2]) AS decoded FROM again)
SELECT query_id, rank, id, round(score, 6) AS score FROM (
  SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank
  FROM (SELECT query_id, id, list_cosine_similarity(v, q) AS score FROM (
          SELECT query_id, id, v, row_number() OVER (PARTITION BY query_id ORDER BY list_inner_product(decoded, {_unit_sql('q')}) DESC, id) AS place
          FROM whole JOIN probes USING (list) JOIN label_queries USING (query_id)) JOIN label_queries USING (query_id) WHERE place <= 40))
WHERE rank <= 10""",
    "lists_by_tree": """
SELECT r.vec_id AS id, arg_min(c.vec_id, list_distance(r.embedding::DOUBLE[], c.embedding::DOUBLE[])) AS list
FROM embeddings r, embeddings c WHERE c.vec_id < 60 GROUP BY r.vec_id""",
    "filled_probes": f"""
WITH {LABEL_QUERIES}, {_CENTRES}, {_NEAR},
rows AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, label FROM embeddings WHERE vec_id % 40 < 2),
placed AS (SELECT id, v, label, arg_min(list, list_distance({_unit_sql('v')}, c)) AS list FROM rows, centres GROUP BY id, v, label),
holding AS (SELECT query_id, q, n.list, place, count(*) AS held FROM near n JOIN placed p ON p.list = n.list AND p.label = (query_id + 3) % 10
            GROUP BY query_id, q, n.list, place),
summed AS (SELECT *, row_number() OVER w - 1 AS lists, coalesce(sum(held) OVER (PARTITION BY query_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
           FROM holding WINDOW w AS (PARTITION BY query_id ORDER BY place)),
probed AS (SELECT query_id, q, list, 1 AS place FROM summed WHERE lists < 2 OR ahead < 5)
SELECT query_id, rank, id, round(score, 6) AS score FROM (
  SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank
  FROM (SELECT query_id, id, {score_sql('cosine', 'v', 'q')} AS score FROM placed JOIN probed USING (list) WHERE label = (query_id + 3) % 10))
WHERE rank <= 5""",
    "multi_probe": f"""
WITH {LABEL_QUERIES},
planes AS (SELECT b, list(('0x' || substr(md5('42:0:' || b || ':' || i), 1, 8))::BIGINT / 4294967296 - 0.5 ORDER BY i) AS p
           FROM range(6) y(b), range(64) z(i) GROUP BY b),
rows AS (SELECT vec_id AS id, v, {_unit_sql('v')} AS u FROM (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings)),
mean AS (SELECT list(m ORDER BY i) AS m FROM (
  SELECT i, avg(x) AS m FROM (SELECT unnest(u) AS x, generate_subscripts(u, 1) AS i FROM rows) GROUP BY i)),
hashed AS (SELECT id, v, sum(CASE WHEN list_inner_product(u, p) - list_inner_product(m, p) >= 0 THEN 1 << (5 - b) ELSE 0 END)::BIGINT AS bucket
           FROM rows, planes, mean GROUP BY id, v),
asked AS (SELECT query_id, q, n AS bucket, row_number() OVER (PARTITION BY query_id ORDER BY round(cost, 9), n) AS place
          FROM (SELECT query_id, q, n, sum(CASE WHEN (x >= 0) <> ((n >> (5 - b)) & 1 = 1) THEN x * x ELSE 0 END) AS cost
                FROM (SELECT query_id, q, b, list_inner_product({_unit_sql('q')}, p) - list_inner_product(m, p) AS x FROM label_queries, planes, mean),
                     range(64) r(n) GROUP BY query_id, q, n))
SELECT query_id, rank, id, round(score, 6) AS score FROM (
  SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank
  FROM (SELECT query_id, id, {score_sql('cosine', 'v', 'q')} AS score FROM hashed JOIN asked USING (bucket) WHERE place <= 10))
WHERE rank <= 10""",
}
