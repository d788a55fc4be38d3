"""Near duplicates among vectors by sorted projection passes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from larkspur.llm.graph import connected_components
from larkspur.session import ship, stage

#: Hashes in a sort key and sign bits in a hash.
HASHES, BITS = 8, 8
#: Rows of a pass compared by one task.
BLOCK_ROWS = 1024


def _planes(seed: int, number: int, dim: int) -> np.ndarray:
    """The random hyperplanes of a pass."""
    return np.random.default_rng([seed, number, dim]).standard_normal((dim, HASHES * BITS))


def _matrix(vectors: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Flat components and row bounds of a list column without nulls."""
    offsets = vectors.offsets.to_numpy()
    return vectors.values.to_numpy(zero_copy_only=False), offsets


def sort_keys(vectors: np.ndarray, seed: int, passes: int) -> np.ndarray:
    """One row per vector, one 64-bit key per pass: the signs of its projections, hash after hash."""
    shifts = np.arange(HASHES * BITS - 1, -1, -1, dtype=np.uint64)
    keys = np.empty((len(vectors), passes), np.uint64)
    for p in range(passes):
        signs = (vectors @ _planes(seed, p, vectors.shape[1])) >= 0
        keys[:, p] = (signs.astype(np.uint64) << shifts).sum(axis=1, dtype=np.uint64)
    return keys


def _keyed(classes: DataFrame, seed: int, passes: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            flat, offsets = _matrix(batch.column(1))
            sizes = np.diff(offsets)
            order = np.arange(len(sizes))
            keys = np.empty((len(sizes), passes), np.uint64)
            for dim in np.unique(sizes).tolist():
                rows = order[sizes == dim]
                block = flat[offsets[rows][:, None] + np.arange(dim)].astype(np.float64)
                keys[rows] = sort_keys(block / np.abs(block).max(axis=1, keepdims=True), seed, passes)
            ids = batch.column(0).take(pa.array(np.repeat(order, passes)))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(np.repeat(sizes, passes).astype(np.int32)),
                 pa.array(np.tile(np.arange(passes, dtype=np.int32), len(sizes))),
                 pa.array((keys ^ np.uint64(1 << 63)).view(np.int64).ravel())], ["class", "dim", "pass", "key"])

    return classes.select("class", "vector").mapInArrow(run, "class binary, dim int, pass int, key bigint")


def _ranked(keyed: DataFrame) -> DataFrame:
    """Staged ``class``, ``run`` (dimension and pass), ``rank``: places in the order of all runs, keys and ids."""
    spark = keyed.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    order = ["dim", "pass", "key", "class"]
    rows = stage(keyed.repartitionByRange(parts, *order).sortWithinPartitions(*order)
                 .withColumn("at", F.monotonically_increasing_id()), "sorted")
    part = F.shiftright("at", 33)
    # One number per partition of the sort.
    sizes = sorted((r["part"], r["n"]) for r in rows.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())
    begins, total = [], 0
    for number, n in sizes:
        begins.append((number, total))
        total += n
    begin = F.broadcast(spark.createDataFrame(begins, "part bigint, begin bigint"))
    place = F.col("begin") + F.col("at").bitwiseAND((1 << 33) - 1)
    return stage(rows.withColumn("part", part).join(begin, "part").select(
        "class", F.struct("dim", "pass").alias("run"), place.alias("rank")), "ranked")


def _compared(window: int, threshold: float):
    def run(part: pa.Table) -> pa.Table:
        part = part.sort_by("rank").combine_chunks()
        rank = part.column("rank").to_numpy()
        dims, passes = (part.column(c).to_numpy() for c in ("dim", "pass"))
        flat, offsets = _matrix(part.column("vector").chunk(0))
        first, second = [], []
        begins = np.flatnonzero(np.concatenate(([True], (dims[1:] != dims[:-1]) | (passes[1:] != passes[:-1]))))
        for low, high in zip(begins, [*begins[1:], len(rank)]):
            rows = flat[offsets[low]:offsets[high]].reshape(high - low, -1).astype(np.float64)
            rows /= np.abs(rows).max(axis=1, keepdims=True)
            rows /= np.sqrt((rows * rows).sum(axis=1, keepdims=True))
            own = np.flatnonzero(rank[low:high] // BLOCK_ROWS == rank[0] // BLOCK_ROWS)
            for step in range(1, window + 1):
                i = own[own + step < len(rows)]
                near = (rows[i] * rows[i + step]).sum(axis=1) >= threshold
                first.append(low + i[near])
                second.append(low + i[near] + step)
        i, j = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (first, second))
        ids = part.column("class")
        return pa.table({"a": ids.take(pa.array(i)), "b": ids.take(pa.array(j))})
    return run


def neighbour_links(classes: DataFrame, threshold: float, passes: int, window: int, seed: int) -> DataFrame:
    """Staged distinct ``a``, ``b`` of ``class``, ``vector``: pairs found with a cosine of ``threshold`` or more.

    Each pass sorts the vectors by concatenated hashes of random projections and compares each with its ``window``
    successors, so a crowd of near copies costs a task no more than other rows. Only ids and keys are sorted; vectors
    move once for each pass, to blocks of the sorted order that also hold the first rows of the next.
    """
    ranked = _ranked(_keyed(classes, seed, passes))
    block = F.expr(f"rank div {BLOCK_ROWS}")
    back = F.when(F.expr(f"rank % {BLOCK_ROWS} < {window} AND rank >= {BLOCK_ROWS}"), F.array(block, block - 1)).otherwise(F.array(block))
    places = ranked.select("class", "run", "rank", F.explode(back).alias("block"))
    places = stage(places.groupBy("class").agg(F.collect_list(F.struct("run", "rank", "block")).alias("places")), "places")
    moved = classes.join(places, "class").select("class", "vector", F.explode("places").alias("p")).select(
        "class", "vector", "p.run.dim", "p.run.pass", "p.rank", "p.block")
    found = moved.groupBy("block").applyInArrow(_compared(window, threshold), "a binary, b binary")
    return stage(found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")


def near_vectors(rows: DataFrame, id_column: str, vector_column: str, threshold: float = 0.9, passes: int = 24,
                 window: int = 64, seed: int = 1) -> DataFrame:
    """``id``, ``n_links``, ``component``, ``kept`` of every vector.

    A vector that is null, empty, zero or holds a null or a non-finite component links with nothing; so do vectors of
    different length and rows with a null id, which have a null component. Equal vectors are one class and link with
    each other; a link of a class counts for all its rows. ``component`` is the smallest id reachable by links. The
    pairs found are those that come within ``window`` places in some pass; none below the threshold is linked.
    """
    ship(rows.sparkSession)
    rows = rows.select(F.col(id_column).alias("id"), F.col(vector_column).cast("array<double>").alias("vector"))
    usable = F.col("id").isNotNull() & (F.size("vector") > 0) \
        & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) \
        & F.exists("vector", lambda x: x != 0)
    rows = rows.withColumn("vector", F.when(F.coalesce(usable, F.lit(False)), F.transform("vector", lambda x: x + F.lit(0.0))))
    # Equal vectors are one class, named by a digest of their components.
    digest = F.substring(F.unhex(F.sha2(F.to_json("vector"), 256)), 1, 16)
    hashed = rows.withColumn("class", F.when(F.col("vector").isNotNull(), digest))
    members = stage(hashed.select("id", "class"), "members")
    classes = stage(hashed.where("class IS NOT NULL").groupBy("class").agg(
        F.min("id").alias("least"), F.count("*").alias("copies"), F.first("vector").alias("vector")), "classes")
    links = neighbour_links(classes, threshold, passes, window, seed)
    names = classes.select("class", "least", "copies")
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    degree = both.join(names.select(F.col("class").alias("b"), "copies"), "b").groupBy("a").agg(
        F.sum("copies").alias("others")).withColumnRenamed("a", "class")
    joined = connected_components(links).toDF("class", "group")
    about = names.join(degree, "class", "left").join(joined, "class", "left")
    about = stage(about.withColumn("group", F.coalesce("group", "class")), "about")
    least = stage(about.groupBy("group").agg(F.min("least").alias("component")), "least")
    about = stage(about.join(least, "group").select(
        "class", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), "component"), "about")
    out = members.join(about, "class", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return out.select("id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component"),
                      F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))
