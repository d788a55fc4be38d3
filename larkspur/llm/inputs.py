"""Helpers shared by the operators: reading tables and numbering rows."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import StructField, StructType

from larkspur.session import ship, stage

#: Narrow rows (ids, counts, labels) that one task writes.
TASK_ROWS = 100_000
#: Bytes of files that one task reads.
TASK_BYTES = 256 << 20
#: Rows numbered together; each chunk is one row of the table of offsets.
CHUNK_ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def stage_narrow(df: DataFrame, purpose: str, rows: int) -> DataFrame:
    """``df`` staged by about one task for every ``TASK_ROWS`` of at most ``rows`` narrow rows."""
    return stage(df.coalesce(max(1, -(-rows // TASK_ROWS))), purpose)


def numbered(df: DataFrame, by: str, name: str) -> DataFrame:
    """``df`` with a gapless number from 0 within each value of ``by``; which row gets which number is left open.

    Rows are staged once with a row id. A chunk of consecutive ids is counted and numbered alone, and a running total
    over the small table of chunks gives where its numbers begin, so a value that holds most rows is spread over tasks.
    A column called ``name`` is replaced.
    """
    rows = stage(df.select(
        F.struct(*(F.col(f"`{c}`") for c in df.columns if c != name)).alias("row"), F.col(by).alias("by"),
        F.monotonically_increasing_id().alias("at")), "numbered")
    rows = rows.withColumn("chunk", F.expr(f"at div {CHUNK_ROWS}"))
    counts = rows.groupBy("by", "chunk").agg(F.count("*").alias("n"))
    before = Window.partitionBy("by").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = stage(counts.select("by", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("begin")), "offsets")
    local = F.row_number().over(Window.partitionBy("by", "chunk").orderBy("at")) - 1
    placed = rows.withColumn("local", local).alias("r").join(
        offsets.alias("o"), F.col("r.by").eqNullSafe(F.col("o.by")) & (F.col("r.chunk") == F.col("o.chunk")))
    return placed.select("row.*", (F.col("begin") + F.col("local")).cast("bigint").alias(name))


def columns_of(df: DataFrame) -> list:
    """The columns of ``df`` by name, whatever characters a name holds."""
    return [F.col(f"`{c.replace('`', '``')}`") for c in df.columns]


def with_computed(df: DataFrame, fields: list[StructField], factory: Callable[[list[str]], Callable]) -> DataFrame:
    """``df`` and the columns ``fields``, which replace columns of these names.

    ``factory`` gets the names of the columns kept and returns, once for each task, a function from an Arrow batch of them
    to the arrays of ``fields``. Columns travel by position, so their names may hold any characters.
    """
    ship(df.sparkSession)
    added = {f.name for f in fields}
    names = [c for c in df.columns if c not in added]
    kept = df.select([c for c, name in zip(columns_of(df), df.columns) if name not in added])
    plain = [f"c{i}" for i in range(len(names) + len(fields))]

    def run(batches):
        compute = factory(names)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, *compute(batch)], plain)
        # The worker lives on, so memory that this task no longer needs goes back before the next one.
        del compute
        pa.default_memory_pool().release_unused()

    schema = StructType([StructField(n, f.dataType) for n, f in zip(plain, [*kept.schema.fields, *fields])])
    return kept.toDF(*plain[:len(names)]).mapInArrow(run, schema).toDF(*names, *(f.name for f in fields))


def spread_files(files: DataFrame) -> DataFrame:
    """``files``, which have a column ``bytes``, dealt so that all cores have some and a task about ``TASK_BYTES``."""
    n, size = files.agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    cores = files.sparkSession.sparkContext.defaultParallelism
    return files.repartition(max(1, min(n, 2 * cores), -(-size // TASK_BYTES)))
