"""Relational tables, embedding datasets, query files and baseline results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from larkspur import schemas
from larkspur.functions.text import strip


def read_photo_csv(
    spark: SparkSession, path: str, table: str = "photos", sep: str = "\t", header: bool = True,
) -> DataFrame:
    """One file of the metadata dump, typed; unreadable lines keep their text in ``_corrupt_record``."""
    schema = schemas.PHOTOS_CSV if table == "photos" else schemas.TABLES[table]
    schema = T.StructType(schema.fields + [T.StructField("_corrupt_record", T.StringType())])
    return (
        spark.read.schema(schema)
        .option("sep", sep).option("header", header)
        .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record")
        .csv(path)
    )


def read_tables(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The four relational tables stored as Parquet below ``root``."""
    return {name: spark.read.schema(s).parquet(f"{root.rstrip('/')}/{name}") for name, s in schemas.TABLES.items()}


def read_jdbc_table(
    spark: SparkSession, url: str, table: str, column: str, lower: int, upper: int, partitions: int, **options,
) -> DataFrame:
    """A database table read in parallel ranges of a numeric key; filters are pushed to the database."""
    return (
        spark.read.format("jdbc")
        .options(url=url, dbtable=table, partitionColumn=column,
                 lowerBound=lower, upperBound=upper, numPartitions=partitions, **options)
        .load()
    )


def read_embedding_dataset(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """An embedding dataset; a missing path fails at once with Spark's own path error."""
    data = spark.read.parquet(path)
    return data.select(*columns) if columns else data


def query_lines(files: DataFrame, limit: int = -1, keep: list[str] | None = None) -> DataFrame:
    """``query_id, query`` from rows of whole query files in ``value``.

    Lines are stripped, blank ones dropped, the file order kept; a negative
    limit means all. ``keep`` names further columns of the file to keep.
    """
    kept = keep or []
    lines = files.select(*kept, F.posexplode(F.split("value", "\r\n|\n|\r")).alias("pos", "line"))
    stripped = lines.select(*kept, F.col("pos").cast("bigint").alias("query_id"), strip(F.col("line")).alias("query"))
    found = stripped.filter(F.col("query") != "")
    return found if limit < 0 else found.orderBy(*kept, "query_id").limit(limit)


def read_queries(spark: SparkSession, path: str, limit: int = -1) -> DataFrame:
    """Queries of a text file, one per line; ``query_id`` is the line number from 0."""
    return query_lines(spark.read.text(path, wholetext=True), limit)


def read_baseline(spark: SparkSession, path: str, k: int) -> DataFrame:
    """Exact results ``query_id, rank, id``; every query must have exactly ``k`` of them."""
    rows = spark.read.parquet(path).select("query_id", "rank", "id")
    wrong = rows.groupBy("query_id").count().filter(F.col("count") != k).limit(1).count()
    if wrong:
        raise ValueError(f"baseline results do not have {k} ids for every query")
    return rows
