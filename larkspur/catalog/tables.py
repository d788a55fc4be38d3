"""Access to the given tables and the columns derived from them."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession, functions as F

from larkspur.operators.embedding import EmbedPolicy
from larkspur.operators.search import Layout
from larkspur.session import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def over_all_cores(df: DataFrame) -> EmbedPolicy:
    """A policy that deals ``df`` to all cores where it comes in fewer splits, and leaves it in its own otherwise."""
    splits, cores = df.rdd.getNumPartitions(), df.sparkSession.sparkContext.defaultParallelism
    return EmbedPolicy(partitions=cores if splits < cores else None)


# The embeddings table as a collection, with coordinates and dates derived from the id.
PLACED = Layout(id="vec_id", vector="embedding", species="label", latitude="lat", longitude="lon", date="day")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings")


def placed_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("vec_id")
    return vectors(spark, sf_dir).select(
        "vec_id", "embedding", "label",
        (F.pmod(n * 37, F.lit(180)) - 90).cast("double").alias("lat"),
        (F.pmod(n * 73, F.lit(360)) - 180).cast("double").alias("lon"),
        F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(n, F.lit(366)).cast("int")).alias("day"),
    )


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embeddings table with the column names of a collection."""
    return vectors(spark, sf_dir).select(
        F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), F.col("label").cast("string").alias("species"))


def mean_vectors(rows: DataFrame, *by: str) -> DataFrame:
    """Mean embedding per group, added up inside each task before the shuffle."""
    mean = Summarizer.mean(array_to_vector(F.col("embedding").cast("array<double>")))
    grouped = rows.groupBy(*by).agg(mean.alias("_mean"))
    return grouped.select(*by, vector_to_array("_mean").alias("vector"))


def label_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One query per label: the mean of its vectors."""
    means = mean_vectors(vectors(spark, sf_dir), "label")
    return means.select(F.col("label").cast("bigint").alias("query_id"), "vector")


# SQL counterparts.

LABEL_QUERIES = """
label_queries AS (
  SELECT label::BIGINT AS query_id, list(m ORDER BY i) AS q
  FROM (SELECT label, i, avg(x::DOUBLE) AS m
        FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings)
        GROUP BY label, i)
  GROUP BY label)"""

PLACED_SQL = """
placed AS (
  SELECT vec_id, embedding::DOUBLE[] AS v, label,
         (vec_id * 37 % 180 - 90)::DOUBLE AS lat, (vec_id * 73 % 360 - 180)::DOUBLE AS lon,
         DATE '2024-01-01' + (vec_id % 366)::INTEGER AS day
  FROM embeddings)"""

SCORES = {
    "cosine": "list_cosine_similarity({a}, {b})",
    "ip": "list_inner_product({a}, {b})",
    "l2": "-list_distance({a}, {b})",
    "l1": "-list_sum(list_transform(list_zip({a}, {b}), lambda p: abs(p[1] - p[2])))",
}


def score_sql(metric: str, a: str, b: str) -> str:
    return SCORES[metric].format(a=a, b=b)


def embed_sql(source: str, key: str, text: str, dim: int = 64) -> str:
    """Vectors ``(key, v DOUBLE[])`` of the hashing embedder; a text without tokens has the zero vector."""
    return f"""
  (SELECT d.{key}, list(coalesce(c.n, 0) / greatest(sqrt(coalesce(z.s, 0)), 1e-12) ORDER BY d.i)::FLOAT[]::DOUBLE[] AS v
   FROM (SELECT {key}, unnest(range(0, {dim})) AS i FROM {source}) d
   LEFT JOIN (SELECT {key}, i, sum(g) AS n
              FROM (SELECT {key}, ('0x' || substr(h, 1, 8))::BIGINT % {dim} AS i,
                           CASE WHEN ('0x' || substr(h, 9, 1))::BIGINT < 8 THEN 1.0 ELSE -1.0 END AS g
                    FROM (SELECT {key}, md5(t) AS h
                          FROM (SELECT {key}, unnest(regexp_extract_all(lower({text}), '[a-z0-9]+')) AS t FROM {source})))
              GROUP BY ALL) c ON c.{key} = d.{key} AND c.i = d.i
   LEFT JOIN (SELECT {key}, sum(n * n) AS s
              FROM (SELECT {key}, i, sum(g) AS n
                    FROM (SELECT {key}, ('0x' || substr(h, 1, 8))::BIGINT % {dim} AS i,
                                 CASE WHEN ('0x' || substr(h, 9, 1))::BIGINT < 8 THEN 1.0 ELSE -1.0 END AS g
                          FROM (SELECT {key}, md5(t) AS h
                                FROM (SELECT {key}, unnest(regexp_extract_all(lower({text}), '[a-z0-9]+')) AS t FROM {source})))
                    GROUP BY ALL)
              GROUP BY {key}) z ON z.{key} = d.{key}
   GROUP BY d.{key})"""


def vector_md5(vector: str):
    """Checksum of a whole vector in millionths, as ``vector_md5_sql`` has it."""
    return F.md5(F.array_join(F.transform(vector, lambda x: F.round(x.cast("double") * 1_000_000).cast("bigint").cast("string")), ","))


def vector_md5_sql(vector: str) -> str:
    return f"md5(array_to_string(list_transform({vector}, lambda x: round(x::DOUBLE * 1000000)::BIGINT::VARCHAR), ','))"
