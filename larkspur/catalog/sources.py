"""Tables, a CSV dump, an embedding dataset, baseline results and metrics, written from the given tables and scanned."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspur import schemas
from larkspur.catalog.search import ORACLES as _SEARCH, PLAIN
from larkspur.catalog.tables import label_queries, table, vector_md5, vector_md5_sql, vectors
from larkspur.operators.relational import union_all
from larkspur.operators.search import search_batch
from larkspur.operators.sinks import write_dataset, write_metrics
from larkspur.session import scratch_path
from larkspur.sources.tables import read_baseline, read_embedding_dataset, read_photo_csv, read_tables


def _shaped(rows, to: str, **columns):
    """``rows`` in the fixed schema of a table, with nulls where no column is given."""
    return rows.select(*(columns.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in schemas.TABLES[to].fields))


def scanned_tables(spark, sf_dir):
    """Parts, orders, suppliers and customers stored as the four tables, read back and joined."""
    root, given = scratch_path(spark, "tables"), lambda name: table(spark, sf_dir, name)
    made = {
        "photos": _shaped(given("part"), "photos", photo_id=F.col("p_partkey"), observation_uuid=F.concat(F.lit("obs-"), F.col("p_partkey")),
                          observer_id=F.lit(1), width=F.col("p_size")),
        "observations": _shaped(given("orders"), "observations", observation_uuid=F.concat(F.lit("obs-"), F.col("o_orderkey")),
                                taxon_id=F.col("o_custkey"), observed_on=F.col("o_orderdate"), quality_grade=F.col("o_orderstatus")),
        "observers": _shaped(given("supplier"), "observers", observer_id=F.col("s_suppkey"), login=F.col("s_name")),
        "taxa": _shaped(given("customer"), "taxa", taxon_id=F.col("c_custkey"), name=F.col("c_name"), active=F.col("c_acctbal") > 0),
    }
    for name, rows in made.items():
        write_dataset(rows, f"{root}/{name}")
    read = read_tables(spark, root)
    seen = read["photos"].join(read["observations"], "observation_uuid").join(read["taxa"], "taxon_id")
    return seen.select("photo_id", F.col("width").cast("bigint").alias("width"), "quality_grade", "name", "active", "observed_on")


def scanned_csv(spark, sf_dir):
    """Parts as the photo file of the dump; every fiftieth line has no number for its width and keeps its text."""
    path, fields = scratch_path(spark, "csv"), schemas.PHOTOS_CSV.names
    given = {"photo_uuid": F.concat(F.lit("u-"), F.col("p_partkey")), "photo_id": F.col("p_partkey"), "observer_id": F.col("p_size"),
             "extension": F.lit("jpg"), "width": F.when(F.col("p_partkey") % 50 == 0, F.lit("wide")).otherwise(F.col("p_size").cast("string")),
             "height": F.lit(7), "position": F.lit(0)}
    rows = table(spark, sf_dir, "part").select(*(given.get(f, F.lit("x")).cast("string").alias(f) for f in fields))
    rows.write.option("sep", "\t").option("header", True).csv(path)
    read = read_photo_csv(spark, path)
    return read.select("photo_id", "photo_uuid", "extension", F.col("observer_id").cast("bigint").alias("observer_id"),
                       F.col("width").cast("bigint").alias("width"), F.col("_corrupt_record").isNotNull().alias("broken"))


def scanned_dataset(spark, sf_dir):
    """The embeddings exported as a dataset; two columns of it read back."""
    path = scratch_path(spark, "dataset")
    write_dataset(vectors(spark, sf_dir), path)
    return read_embedding_dataset(spark, path, ["vec_id", "embedding"]).select("vec_id", vector_md5("embedding").alias("vector_md5"))


def scanned_baseline(spark, sf_dir):
    """Exact results stored as a baseline, ten for each query, and read back."""
    path = scratch_path(spark, "baseline")
    write_dataset(search_batch(vectors(spark, sf_dir), label_queries(spark, sf_dir), 10, "l2", PLAIN), path)
    return read_baseline(spark, path, 10)


def stored_metrics(spark, sf_dir):
    """Figures of every type of event written as the metrics of a step and read back."""
    figures = table(spark, sf_dir, "events").groupBy("event_type").agg(
        F.count("*").alias("events"), F.round(F.max("value"), 3).alias("slowest"))
    read = spark.read.schema(figures.schema).json(write_metrics(figures, scratch_path(spark, "metrics"), "events"))
    return read.select("event_type", "events", "slowest")


def union_of_texts(spark, sf_dir):
    """Texts of three tables one below the other, those that are in several as often as they are there."""
    given = lambda name, key: table(spark, sf_dir, name).select(
        F.lit(name).alias("source"), F.col(key).cast("bigint").alias("key"), F.md5(F.col("text").cast("binary")).alias("text_md5"))
    return union_all([given("benchmark", "item_id"), given("conversations", "conv_id"), given("documents", "doc_id")])


QUERIES = {
    "scanned_tables": scanned_tables,
    "scanned_csv": scanned_csv,
    "scanned_dataset": scanned_dataset,
    "scanned_baseline": scanned_baseline,
    "stored_metrics": stored_metrics,
    "union_of_texts": union_of_texts,
}

ORACLES = {
    "scanned_tables": """
SELECT p_partkey::INTEGER AS photo_id, p_size::BIGINT AS width, o_orderstatus AS quality_grade, c_name AS name, c_acctbal > 0 AS active,
       o_orderdate::DATE AS observed_on
FROM part JOIN orders ON o_orderkey = p_partkey JOIN customer ON c_custkey = o_custkey""",
    "scanned_csv": """
SELECT p_partkey::INTEGER AS photo_id, 'u-' || p_partkey AS photo_uuid, 'jpg' AS extension, p_size::BIGINT AS observer_id,
       CASE WHEN p_partkey % 50 <> 0 THEN p_size END::BIGINT AS width, p_partkey % 50 = 0 AS broken
FROM part""",
    "scanned_dataset": f"SELECT vec_id, {vector_md5_sql('embedding')} AS vector_md5 FROM embeddings",
    "scanned_baseline": f"SELECT query_id, rank, id FROM ({_SEARCH['search_batch_l2']})",
    "stored_metrics": "SELECT event_type, count(*) AS events, round(max(value), 3) AS slowest FROM events GROUP BY event_type",
    "union_of_texts": """
SELECT 'benchmark' AS source, item_id::BIGINT AS key, md5(text) AS text_md5 FROM benchmark
UNION ALL SELECT 'conversations', conv_id, md5(text) FROM conversations
UNION ALL SELECT 'documents', doc_id, md5(text) FROM documents""",
}
