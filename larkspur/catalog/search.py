"""Search, similarity, index and evaluation queries over the embeddings table."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from larkspur.catalog.tables import (
    LABEL_QUERIES, PLACED, PLACED_SQL, embed_sql, label_queries, mean_vectors, over_all_cores, placed_vectors, points, score_sql,
    table, vectors,
)
from larkspur.functions.payload import FILTER_FIELDS, parse_filters
from larkspur.functions.vectors import l2_normalise, norm, pad_ids, raw_similarity, score01, to_score
from larkspur.operators.embedding import embed_column
from larkspur.operators.ivf import IvfIndex, LshIndex, PqModel, pq_encode, search_pq
from larkspur.operators.metrics import latency_stats, recall_at_k, result_ids
from larkspur.operators.search import Layout, result_page, search, search_batch, with_payload, with_total
from larkspur.operators.space import search_clustered, write_clustered
from larkspur.session import scratch_path, stage

PLAIN = Layout(id="vec_id", vector="embedding", species="label")


def _mean(spark: SparkSession, sf_dir: str) -> list[float]:
    """Mean of all vectors: the query of the single-query searches."""
    return mean_vectors(vectors(spark, sf_dir)).first().vector


def _rounded(results: DataFrame, *extra: str) -> DataFrame:
    return results.select(*[c for c in ("query_id",) if c in results.columns], "rank", "id",
                          F.round("score", 6).alias("score"), *extra)


def search_exact_cosine(spark, sf_dir):
    return _rounded(search(vectors(spark, sf_dir), _mean(spark, sf_dir), 10, "cosine", None, PLAIN))


def search_species(spark, sf_dir):
    return _rounded(search(vectors(spark, sf_dir), _mean(spark, sf_dir), 10, "cosine", {"species": "3"}, PLAIN))


_BOX_AND_DATES = {
    "latitude_min": -45.0, "latitude_max": 45.0, "longitude_min": 120.0, "longitude_max": -60.0,
    "start_date": "2024-02-01", "end_date": "2024-11-30", "months": ["Mar", "Apr", "Jul", "Oct"],
}


def search_box_dates(spark, sf_dir):
    return _rounded(search(placed_vectors(spark, sf_dir), _mean(spark, sf_dir), 10, "ip", _BOX_AND_DATES, PLACED))


def search_box_cells(spark, sf_dir):
    """The same search where rows are laid out by place and month, and only cells that meet the filters are opened."""
    path = scratch_path(spark, "cells")
    write_clustered(placed_vectors(spark, sf_dir), path, PLACED)
    return _rounded(search_clustered(spark, path, _mean(spark, sf_dir), 10, "ip", _BOX_AND_DATES, PLACED))


def _batch(metric):
    def run(spark, sf_dir):
        return _rounded(search_batch(vectors(spark, sf_dir), label_queries(spark, sf_dir), 10, metric, PLAIN))

    return run


def search_per_query_filters(spark, sf_dir):
    """Every query has its own species; some also have a box, dates or months."""
    n = F.col("query_id")
    queries = label_queries(spark, sf_dir).select(
        "query_id", "vector", n.cast("string").alias("species"),
        F.when(n >= 3, F.lit(-60.0)).alias("latitude_min"), F.when(n >= 3, F.lit(60.0)).alias("latitude_max"),
        F.when(n >= 3, F.lit(90.0)).alias("longitude_min"), F.when(n >= 3, F.lit(30.0)).alias("longitude_max"),
        F.when(n >= 5, F.lit("2024-03-01").cast("date")).alias("start_date"),
        F.lit(None).cast("date").alias("end_date"),
        F.when(n >= 7, F.array(F.lit("May"), F.lit("Jun"), F.lit("Sep"), F.lit("Dec"))).alias("months"),
    )
    return _rounded(search_batch(placed_vectors(spark, sf_dir), queries, 5, "cosine", PLACED))


def search_with_payload(spark, sf_dir):
    collection = placed_vectors(spark, sf_dir)
    found = search_batch(collection, label_queries(spark, sf_dir), 5, "cosine", PLACED)
    return _rounded(with_payload(found, collection, ["label", "day"], "vec_id"), "label", "day")


def search_pages(spark, sf_dir):
    """Second page of the results of each query, with the number of results."""
    found = search_batch(vectors(spark, sf_dir), label_queries(spark, sf_dir), 60, "cosine", PLAIN)
    return _rounded(result_page(with_total(found), 1), "total")


def similarity_metrics(spark, sf_dir):
    """Every vector against the mean of its label, in all four metrics."""
    rows = vectors(spark, sf_dir)
    means = mean_vectors(rows, "label")
    pairs = rows.join(means, "label")
    a, b = F.col("embedding"), F.col("vector")
    return pairs.select("vec_id", *[F.round(raw_similarity(a, b, m), 6).alias(m) for m in ("ip", "cosine", "l2", "l1")])


def normalised_vectors(spark, sf_dir):
    """Vectors stretched by their id, then normalised again."""
    stretched = vectors(spark, sf_dir).select(
        "vec_id", F.transform("embedding", lambda x: (x.cast("double") * F.col("vec_id")).cast("float")).alias("v"))
    unit = l2_normalise(F.col("v"))
    return stretched.select("vec_id", F.round(norm(unit), 5).alias("length"), F.round(F.try_element_at(unit, F.lit(1)).cast("double"), 5).alias("first"))


def score_mapping(spark, sf_dir):
    value = F.col("value")
    certainty = F.when(F.col("event_type") == "view", value / 1000)
    distance = F.when(F.col("event_type") != "error", value / 200)
    return table(spark, sf_dir, "events").select(
        "event_id", F.round(to_score(certainty, distance), 6).alias("score"),
        F.round(score01(value / 100 - 0.5), 6).alias("score01"))


def padded_result_ids(spark, sf_dir):
    """Ids of the results within the label of the query, padded to a fixed length."""
    found = search_batch(vectors(spark, sf_dir), label_queries(spark, sf_dir).withColumn(
        "species", F.col("query_id").cast("string")), 5, "l2", PLAIN)
    ids = result_ids(found, 5)
    return ids.select("query_id", F.array_join(pad_ids(F.col("ids"), 8).cast("array<string>"), ",").alias("ids"))


def recall_l1_vs_cosine(spark, sf_dir):
    queries = label_queries(spark, sf_dir)
    rows = vectors(spark, sf_dir)
    exact = search_batch(rows, queries, 10, "cosine", PLAIN)
    other = search_batch(rows, queries, 10, "l1", PLAIN)
    return recall_at_k(other, exact, 10).select("queries", "hits", F.round("recall", 6).alias("recall"))


def latency_by_type(spark, sf_dir):
    stats = latency_stats(table(spark, sf_dir, "events"), "value", ["event_type"])
    return stats.select("event_type", *[F.round(c, 4).alias(c) for c in ("lat_ms_avg", "lat_ms_p50", "lat_ms_p95")])


def _index(spark, sf_dir, n_lists=16):
    return IvfIndex.build(vectors(spark, sf_dir), scratch_path(spark, "ivf"), n_lists, "cosine",
                          "vec_id", "embedding", ["label"])


def ivf_full_probe(spark, sf_dir):
    """All lists probed: the same as the exact search."""
    index = _index(spark, sf_dir)
    return _rounded(index.search(label_queries(spark, sf_dir), 10, index.n_lists))


def ivf_species(spark, sf_dir):
    """All lists probed, filtered by the species of each query."""
    index = _index(spark, sf_dir)
    queries = label_queries(spark, sf_dir).withColumn("species", F.col("query_id").cast("string"))
    return _rounded(index.search(queries, 5, index.n_lists, Layout(species="label")))


def _label_means(spark, sf_dir) -> np.ndarray:
    """One row for each label: centroids and codes that SQL can repeat."""
    return np.array([r.vector for r in label_queries(spark, sf_dir).orderBy("query_id").collect()])


def ivf_partial_probe(spark, sf_dir):
    """Three of the lists around the label means probed."""
    index = IvfIndex.build(points(spark, sf_dir), scratch_path(spark, "ivf"), centroids=_label_means(spark, sf_dir))
    return _rounded(index.search(label_queries(spark, sf_dir), 10, 3))


def pq_refined(spark, sf_dir):
    """Codes from the slices of the label means; forty candidates by compressed score, ten by the true one."""
    rows, model = points(spark, sf_dir), PqModel.of_points(_label_means(spark, sf_dir), 8, "cosine")
    coded = stage(pq_encode(rows, model).select("id", "code"), "pq")
    return _rounded(search_pq(coded, label_queries(spark, sf_dir), model, 10, 4, rows))


def ivf_pq(spark, sf_dir):
    """Inverted file with codes: three lists probed under a filter, four candidates for each result scored again."""
    rows, means = points(spark, sf_dir), _label_means(spark, sf_dir)
    index = IvfIndex.build(rows, scratch_path(spark, "ivfpq"), filter_columns=["species"], centroids=means,
                           pq=PqModel.of_points(means, 8, "cosine"))
    queries = label_queries(spark, sf_dir).withColumn("species", F.col("query_id").cast("string"))
    return _rounded(index.search_codes(queries, 5, 3, refine=4))


def lsh_candidates(spark, sf_dir):
    """Five tables of five signs: the best of the rows that share a bucket with the query."""
    index = LshIndex.build(points(spark, sf_dir), scratch_path(spark, "lsh"), "cosine")
    return _rounded(index.search(label_queries(spark, sf_dir), 10))


def embedded_documents(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    embedded = embed_column(documents, "text", "hashing", policy=over_all_cores(documents))
    return embedded.filter("success").select(F.col("doc_id").alias("id"), "vector", F.col("lang").alias("species"))


def search_text(spark, sf_dir):
    """Benchmark texts as queries over the embedded documents."""
    items = embed_column(table(spark, sf_dir, "benchmark"), "text", "hashing").filter("success")
    queries = stage(items.select(F.col("item_id").alias("query_id"), "vector"), "queries")
    return _rounded(search_batch(embedded_documents(spark, sf_dir), queries, 10, "cosine"))


_FORM = """to_json(named_struct(
  'species', if(item_id % 3 = 0, cast(item_id % 10 as string), null),
  'location', if(item_id % 2 = 0, named_struct('latitudeMin', '-60', 'latitudeMax', '60', 'longitudeMin', '9e1', 'longitudeMax', '30.0'), null),
  'start_date', if(item_id % 4 = 0, '2024-03-01', null), 'end_date', if(item_id % 5 = 0, '2024-11-30', null),
  'months', if(item_id % 3 = 1, array('May', 'Jun', 'Sep', 'Dec', 'Jan'), null)))"""


def searched_forms(spark, sf_dir):
    """Search forms end to end: text and JSON filters to vector and typed filters, a filtered search, its response."""
    forms = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text", F.expr(_FORM).alias("form"))
    asked = embed_column(forms, "text", "hashing").filter("success")
    queries = stage(asked.select("query_id", "vector", parse_filters(F.col("form")).alias("f")).select("query_id", "vector", "f.*"), "queries")
    collection = placed_vectors(spark, sf_dir)
    found = with_payload(search_batch(collection, queries, 5, "cosine", PLACED), collection, ["label"], "vec_id")
    fields = queries.select("query_id", *FILTER_FIELDS).withColumn("months", F.array_join("months", " "))
    return _rounded(found, "label").join(fields, "query_id")


QUERIES = {
    "searched_forms": searched_forms,
    "search_exact": search_exact_cosine,
    "search_species": search_species,
    "search_box_dates": search_box_dates,
    "search_box_cells": search_box_cells,
    "search_batch_cosine": _batch("cosine"),
    "search_batch_ip": _batch("ip"),
    "search_batch_l2": _batch("l2"),
    "search_batch_l1": _batch("l1"),
    "search_per_query_filters": search_per_query_filters,
    "search_with_payload": search_with_payload,
    "search_pages": search_pages,
    "similarity_metrics": similarity_metrics,
    "normalised_vectors": normalised_vectors,
    "score_mapping": score_mapping,
    "padded_result_ids": padded_result_ids,
    "recall_l1_vs_cosine": recall_l1_vs_cosine,
    "latency_by_type": latency_by_type,
    "ivf_full_probe": ivf_full_probe,
    "ivf_species": ivf_species,
    "ivf_partial_probe": ivf_partial_probe,
    "pq_refined": pq_refined,
    "ivf_pq": ivf_pq,
    "lsh_candidates": lsh_candidates,
    "search_text": search_text,
}


def _top(metric: str, k: int, where: str = "TRUE", extra: str = "") -> str:
    return f"""
  (SELECT * FROM (
    SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank, id, score{extra}
    FROM (SELECT query_id, vec_id AS id, {score_sql(metric, 'v', 'q')} AS score{extra}
          FROM placed, label_queries WHERE {where}))
   WHERE rank <= {k})"""


def _label_search(metric: str, k: int, where: str = "TRUE", extra: str = "", tail: str = "") -> str:
    return (f"WITH {LABEL_QUERIES}, {PLACED_SQL} SELECT query_id, rank, id, round(score, 6) AS score{extra} "
            f"FROM {_top(metric, k, where, extra)} {tail}")


def _mean_search(metric: str, k: int, where: str) -> str:
    return f"""
WITH {PLACED_SQL},
mean AS (SELECT list(m ORDER BY i) AS q FROM (
  SELECT i, avg(x::DOUBLE) AS m
  FROM (SELECT unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY i))
SELECT row_number() OVER (ORDER BY score DESC, id) AS rank, id, round(score, 6) AS score
FROM (SELECT vec_id AS id, {score_sql(metric, 'v', 'q')} AS score FROM placed, mean WHERE {where})
QUALIFY rank <= {k}"""


_BOX = "lat BETWEEN {0} AND {1} AND (lon >= {2} OR lon <= {3})"

def _unit_sql(v: str) -> str:
    return f"list_transform({v}, lambda x: x / sqrt(list_inner_product({v}, {v})))"


# Rows with their list (nearest label mean) and their code (nearest slice of a unit label mean, in each of 8 slices).
_CODED = f"""{LABEL_QUERIES},
centres AS (SELECT query_id AS list, q AS c, {_unit_sql('q')} AS unit_c FROM label_queries),
unit_rows AS (SELECT vec_id AS id, label, v, {_unit_sql('v')} AS w FROM (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings)),
coded AS (SELECT id, label, v, arg_min(list, list_distance(w, c)) AS list,
                 list_concat({', '.join(f"(arg_min(unit_c, list_distance(w[{8 * i + 1}:{8 * i + 8}], unit_c[{8 * i + 1}:{8 * i + 8}])))[{8 * i + 1}:{8 * i + 8}]" for i in range(8))}) AS decoded
          FROM unit_rows, centres GROUP BY id, label, v),
probes AS (SELECT query_id, list FROM (
  SELECT query_id, list, row_number() OVER (PARTITION BY query_id ORDER BY list_distance({_unit_sql('q')}, c)) AS n
  FROM label_queries, centres) WHERE n <= 3)"""
_COMPRESSED = f"round(list_inner_product(decoded, {_unit_sql('q')}), 6)"

ORACLES = {
    "search_exact": _mean_search("cosine", 10, "TRUE"),
    "search_species": _mean_search("cosine", 10, "label = 3"),
    "search_box_dates": _mean_search(
        "ip", 10, _BOX.format(-45, 45, 120, -60)
        + " AND day BETWEEN DATE '2024-02-01' AND DATE '2024-11-30' AND month(day) IN (3, 4, 7, 10)"),
    **{f"search_batch_{m}": _label_search(m, 10) for m in ("cosine", "ip", "l2", "l1")},
    "search_per_query_filters": _label_search("cosine", 5, (
        "label = query_id AND (query_id < 3 OR " + _BOX.format(-60, 60, 90, 30) + ")"
        " AND (query_id < 5 OR day >= DATE '2024-03-01') AND (query_id < 7 OR month(day) IN (5, 6, 9, 12))")),
    "search_with_payload": _label_search("cosine", 5, extra=", label, day"),
    "search_pages": (f"WITH {LABEL_QUERIES}, {PLACED_SQL} SELECT query_id, rank, id, score, total FROM ("
                     "SELECT query_id, rank, id, round(score, 6) AS score, count(*) OVER (PARTITION BY query_id) AS total "
                     f"FROM {_top('cosine', 60)}) WHERE rank > 50"),
    "similarity_metrics": f"""
WITH {LABEL_QUERIES}, {PLACED_SQL}
SELECT vec_id, round({score_sql('ip', 'v', 'q')}, 6) AS ip, round({score_sql('cosine', 'v', 'q')}, 6) AS cosine,
       round(-({score_sql('l2', 'v', 'q')}), 6) AS l2, round(-({score_sql('l1', 'v', 'q')}), 6) AS l1
FROM placed JOIN label_queries ON query_id = label""",
    "normalised_vectors": """
WITH s AS (SELECT vec_id, list_transform(embedding, lambda x: (x::DOUBLE * vec_id)::FLOAT)::DOUBLE[] AS v FROM embeddings),
n AS (SELECT vec_id, v, greatest(sqrt(list_inner_product(v, v)), 1e-12) AS l FROM s),
u AS (SELECT vec_id, list_transform(v, lambda x: x / l)::FLOAT[]::DOUBLE[] AS w FROM n)
SELECT vec_id, round(sqrt(list_inner_product(w, w)), 5) AS length, round(w[1], 5) AS first FROM u""",
    "score_mapping": """
SELECT event_id,
       round(CASE WHEN event_type = 'view' THEN value / 1000
                  WHEN event_type <> 'error' THEN greatest(0.0, least(1.0, 1.0 - value / 200)) ELSE 0.0 END, 6) AS score,
       round(greatest(0.0, least(1.0, value / 100 - 0.5)), 6) AS score01
FROM events""",
    "padded_result_ids": (f"WITH {LABEL_QUERIES}, {PLACED_SQL} SELECT query_id, "
                          "array_to_string(list_resize(list(id ORDER BY rank), 8, -1), ',') AS ids "
                          f"FROM {_top('l2', 5, 'label = query_id')} GROUP BY query_id"),
    "recall_l1_vs_cosine": f"""
WITH {LABEL_QUERIES}, {PLACED_SQL}, a AS {_top('cosine', 10)}, b AS {_top('l1', 10)}
SELECT (SELECT count(DISTINCT query_id) FROM a) AS queries, count(*) AS hits,
       round(count(*) / ((SELECT count(DISTINCT query_id) FROM a) * 10.0), 6) AS recall
FROM a JOIN b USING (query_id, id)""",
    "latency_by_type": """
SELECT event_type, round(avg(value), 4) AS lat_ms_avg, round(quantile_cont(value, 0.5), 4) AS lat_ms_p50,
       round(quantile_cont(value, 0.95), 4) AS lat_ms_p95
FROM events GROUP BY event_type""",
    "ivf_full_probe": _label_search("cosine", 10),
    "ivf_species": _label_search("cosine", 5, "label = query_id"),
    "ivf_partial_probe": f"""
WITH {_CODED}
SELECT query_id, rank, id, round(score, 6) AS score FROM (
  SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank
  FROM (SELECT query_id, id, list_cosine_similarity(v, q) AS score
        FROM coded JOIN probes USING (list) JOIN label_queries USING (query_id)))
WHERE rank <= 10""",
    "lsh_candidates": f"""
WITH {LABEL_QUERIES},
planes AS (SELECT t, b, list(('0x' || substr(md5('42:' || t || ':' || b || ':' || i), 1, 8))::BIGINT / 4294967296 - 0.5 ORDER BY i) AS p
           FROM range(5) x(t), range(5) y(b), range(64) z(i) GROUP BY t, b),
points AS (SELECT 'row' AS kind, vec_id AS n, embedding::DOUBLE[] AS v FROM embeddings
           UNION ALL SELECT 'query', query_id, q FROM label_queries),
hashed AS (SELECT kind, n, v, t, string_agg(CASE WHEN list_inner_product(v, p) >= 0 THEN '1' ELSE '0' END, '' ORDER BY b) AS bucket
           FROM points, planes GROUP BY kind, n, v, t),
pairs AS (SELECT DISTINCT q.n AS query_id, r.n AS id, q.v AS q, r.v AS v FROM hashed q JOIN hashed r
          ON r.kind = 'row' AND q.kind = 'query' AND q.t = r.t AND q.bucket = r.bucket)
SELECT query_id, rank, id, round(score, 6) AS score FROM (
  SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank
  FROM (SELECT query_id, id, list_cosine_similarity(v, q) AS score FROM pairs))
WHERE rank <= 10""",
    "pq_refined": f"""
WITH {_CODED}
SELECT query_id, rank, id, round(score, 6) AS score FROM (
  SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank
  FROM (SELECT query_id, id, list_cosine_similarity(v, q) AS score FROM (
          SELECT query_id, id, v, row_number() OVER (PARTITION BY query_id ORDER BY {_COMPRESSED} DESC, id) AS place
          FROM coded, label_queries) JOIN label_queries USING (query_id) WHERE place <= 40))
WHERE rank <= 10""",
    "ivf_pq": f"""
WITH {_CODED}
SELECT query_id, rank, id, round(score, 6) AS score FROM (
  SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank
  FROM (SELECT query_id, id, list_cosine_similarity(v, q) AS score FROM (
          SELECT query_id, id, v, row_number() OVER (PARTITION BY query_id ORDER BY {_COMPRESSED} DESC, id) AS place
          FROM coded JOIN probes USING (list) JOIN label_queries USING (query_id) WHERE label = query_id)
        JOIN label_queries USING (query_id) WHERE place <= 20))
WHERE rank <= 5""",
    "searched_forms": f"""
WITH {PLACED_SQL}, b AS {embed_sql('benchmark', 'item_id', 'text')},
f AS (SELECT item_id AS query_id, v AS q, CASE WHEN item_id % 3 = 0 THEN (item_id % 10)::VARCHAR ELSE '' END AS species,
             CASE WHEN item_id % 2 = 0 THEN -60::DOUBLE END AS latitude_min, CASE WHEN item_id % 2 = 0 THEN 60::DOUBLE END AS latitude_max,
             CASE WHEN item_id % 2 = 0 THEN 90::DOUBLE END AS longitude_min, CASE WHEN item_id % 2 = 0 THEN 30::DOUBLE END AS longitude_max,
             CASE WHEN item_id % 4 = 0 THEN DATE '2024-03-01' END AS start_date,
             CASE WHEN item_id % 5 = 0 THEN DATE '2024-11-30' END AS end_date,
             CASE WHEN item_id % 3 = 1 THEN 'May Jun Sep Dec Jan' END AS months FROM b)
SELECT query_id, rank, id, round(score, 6) AS score, label, species, latitude_min, latitude_max, longitude_min, longitude_max,
       start_date, end_date, months
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank
      FROM (SELECT f.*, vec_id AS id, label, {score_sql('cosine', 'v', 'q')} AS score FROM placed JOIN f
            ON (species = '' OR label::VARCHAR = species)
               AND (latitude_min IS NULL OR lat BETWEEN latitude_min AND latitude_max AND (lon >= longitude_min OR lon <= longitude_max))
               AND (start_date IS NULL OR day >= start_date) AND (end_date IS NULL OR day <= end_date)
               AND (months IS NULL OR month(day) IN (5, 6, 9, 12, 1))))
WHERE rank <= 5""",
    "search_text": f"""
WITH d AS {embed_sql('documents', 'doc_id', 'text')}, b AS {embed_sql('benchmark', 'item_id', 'text')}
SELECT query_id, rank, id, round(score, 6) AS score FROM (
  SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank
  FROM (SELECT item_id AS query_id, doc_id AS id,
               CASE WHEN list_inner_product(d.v, d.v) = 0 THEN 0.0 ELSE list_cosine_similarity(d.v, b.v) END AS score
        FROM d, b))
WHERE rank <= 10""",
}
ORACLES["search_box_cells"] = ORACLES["search_box_dates"]
