"""Aggregates over runs, sinks, errors, latencies and search results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from larkspur.functions.errors import error_class
from larkspur.session import stage

# A sketch is off by at most 1 / _ACCURACY of the rows it saw; a band around a percentile is wider than that.
_ACCURACY = 10_000
_BAND = 5 / _ACCURACY
#: Different values of one band that are put in order together.
BAND_VALUES = 4096


def summarize_run(results: DataFrame, elapsed_seconds: float | Column, by: list[str] | None = None) -> DataFrame:
    """Successful, failed and total rows, elapsed seconds and rows per second."""
    elapsed = F.round(elapsed_seconds if isinstance(elapsed_seconds, Column) else F.lit(float(elapsed_seconds)), 2)
    counted = results.groupBy(*(by or [])).agg(
        F.count_if(F.col("success")).alias("successful"),
        F.count(F.lit(1)).alias("total"),
    )
    total = F.col("total")
    return counted.select(
        *(by or []), "successful", (total - F.col("successful")).alias("failed"), "total",
        elapsed.alias("elapsed_seconds"),
        F.when(elapsed > 0, F.round(total / elapsed, 2)).otherwise(F.lit(0.0)).alias("rate_per_sec"),
    )


def progress(results: DataFrame, total: int | Column, elapsed_seconds: float, by: list[str] | None = None) -> DataFrame:
    """Completed rows against the expected total: percent, rate and what is pending."""
    expected = total if isinstance(total, Column) else F.lit(total)
    elapsed = F.round(F.lit(float(elapsed_seconds)), 1)
    done = results.groupBy(*(by or [])).agg(F.count(F.col("success")).alias("completed"), F.max(expected).alias("total"))
    completed = F.col("completed")
    return done.select(
        *(by or []), "completed", F.col("total").cast("bigint").alias("total"),
        F.round(F.lit(100.0) * completed / F.col("total"), 1).alias("percent"),
        elapsed.alias("elapsed_seconds"),
        F.when(elapsed > 0, F.round(completed / elapsed, 1)).otherwise(F.lit(0.0)).alias("docs_per_second"),
        (F.col("total") - completed).cast("bigint").alias("pending"),
    )


def sink_rollup(status: DataFrame) -> DataFrame:
    """Whether any and whether all sinks accepted each batch."""
    return status.groupBy("batch_id").agg(
        F.bool_or("success").alias("any_success"),
        F.bool_and("success").alias("all_success"),
        F.max("batch_size").alias("batch_size"),
    )


def classify_errors(results: DataFrame, message: str = "error_message") -> DataFrame:
    """Number of failures per error class, by what caused them where ``cause`` says so, else by the message."""
    failures = results.filter(~F.col("success"))
    said = F.coalesce("cause", message) if "cause" in results.columns else F.col(message)
    return failures.groupBy(error_class(said).alias("error_class")).agg(F.count(F.lit(1)).alias("failures"))


def exact_percentiles(rows: DataFrame, value: str, probabilities: list[float], by: list[str]) -> DataFrame:
    """Linear-interpolated percentiles per group, exact however large a group is.

    A percentile lies between two order statistics. For each of them a band of values is narrowed: in every pass the rows
    of the band are counted and sketched with map-side aggregation, and the sketch bounds a band about a thousandth as
    wide around the statistic. Once no band has more than ``BAND_VALUES`` different values these are counted and put in
    order, so what one task orders is bounded by that number, and a group that holds most rows is spread like any other.
    Groups of all sizes are treated alike; nulls do not count.
    """
    data = rows.filter(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_v"))
    totals = data.groupBy(*by).agg(F.count(F.lit(1)).alias("_total"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    at = F.col("_p") * (F.col("_total") - 1)
    wanted = totals.select("*", F.explode(F.array(*(F.lit(float(p)) for p in probabilities))).alias("_p")).select(
        *by, "_p", (at - F.floor(at)).alias("_share"), "_lo", "_hi",
        F.explode(F.array_distinct(F.array(F.floor(at), F.ceil(at)))).alias("_pos"))
    # Rows below the band, and the place of the statistic among all rows of the group.
    bands = stage(wanted.withColumn("_below", F.lit(0).cast("bigint")), "bands")
    keys = [*by, "_p", "_pos"]
    while True:
        inside = _join(data, bands, by).filter((F.col("_v") >= F.col("_lo")) & (F.col("_v") <= F.col("_hi")))
        seen = inside.groupBy(*keys, "_share", "_below", "_lo", "_hi").agg(
            F.count(F.lit(1)).alias("_n"), F.approx_count_distinct("_v").alias("_distinct"),
            F.percentile_approx("_v", [i / 1000 for i in range(1001)], _ACCURACY).alias("_marks"))
        seen = stage(seen, "seen")
        widest = seen.agg(F.max("_distinct")).first()[0]
        if widest is None or widest <= BAND_VALUES:
            break
        # The marks on both sides of the statistic, farther apart than the sketch can be off.
        mark = (F.col("_pos") - F.col("_below")) / F.greatest(F.col("_n") - 1, F.lit(1)) * 1000
        low = F.get("_marks", F.greatest(F.floor(mark - 1000 * _BAND), F.lit(0)).cast("int"))
        high = F.get("_marks", F.least(F.ceil(mark + 1000 * _BAND), F.lit(1000)).cast("int"))
        # The sketch of the ends is off as well: the band's own ends stand for them.
        edged = seen.select(
            *keys, "_share",
            F.when(mark < 2, F.col("_lo")).otherwise(low).alias("_lo"), F.when(mark > 998, F.col("_hi")).otherwise(high).alias("_hi"))
        counted = _join(data, edged, by).groupBy(*keys, "_share", "_lo", "_hi").agg(
            F.count_if(F.col("_v") < F.col("_lo")).alias("_below"))
        bands = stage(counted.select(*by, "_p", "_share", "_lo", "_hi", "_pos", "_below"), "bands")
    values = inside.groupBy(*keys, "_share", "_below", "_v").agg(F.count(F.lit(1)).alias("_n"))
    ahead = Window.partitionBy(*keys).orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    first = F.col("_below") + F.coalesce(F.sum("_n").over(ahead), F.lit(0))
    found = values.withColumn("_first", first).filter(
        (F.col("_pos") >= F.col("_first")) & (F.col("_pos") < F.col("_first") + F.col("_n")))
    low, high = F.min_by("_v", "_pos"), F.max_by("_v", "_pos")
    each = found.groupBy(*by, "_p").agg((low + (high - low) * F.max("_share")).alias("_q"))
    columns = [F.max(F.when(F.col("_p") == float(p), F.col("_q"))).alias(f"p{p * 100:g}") for p in probabilities]
    return each.groupBy(*by).agg(*columns)


def _join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi join in which null keys match; the keys of the right side are dropped."""
    renamed = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    condition = F.lit(True)
    for key in keys:
        condition = condition & F.col(key).eqNullSafe(F.col(f"_right_{key}"))
    return left.join(renamed, condition, how).drop(*[f"_right_{k}" for k in keys])


def latency_stats(rows: DataFrame, value: str, by: list[str] | None = None, approximate: bool = False) -> DataFrame:
    """Mean, median and 95th percentile (linear interpolation) of a latency column."""
    keyed, keys = rows, by or ["_all"]
    if not by:
        keyed = rows.withColumn("_all", F.lit(0))
    mean = keyed.groupBy(*keys).agg(
        F.avg(value).alias("lat_ms_avg"),
        *([F.percentile_approx(value, [0.5, 0.95], 10000).alias("_q")] if approximate else []),
    )
    if approximate:
        out = mean.withColumn("p50", F.col("_q")[0]).withColumn("p95", F.col("_q")[1])
    else:
        quantiles = exact_percentiles(keyed, value, [0.5, 0.95], keys)
        out = _join(mean, quantiles, keys, "left")
    return out.select(*(by or []), "lat_ms_avg", F.col("p50").alias("lat_ms_p50"), F.col("p95").alias("lat_ms_p95"))


def hit_count(approx: Column, exact: Column, k: int) -> Column:
    """Ids found by both within the first ``k``, each counted once."""
    return F.size(F.array_intersect(F.slice(approx, 1, k), F.slice(exact, 1, k)))


def result_ids(results: DataFrame, k: int) -> DataFrame:
    """The ids of each query in rank order; at most ``k`` per query."""
    top = results.filter(F.col("rank") <= k).groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", "id"))).alias("_r"))
    return top.select("query_id", F.transform("_r", lambda x: x["id"]).alias("ids"))


def recall_at_k(approx: DataFrame, exact: DataFrame, k: int) -> DataFrame:
    """One row ``queries, hits, recall``: hits over ``queries * k``.

    Duplicates count once; the denominator stays ``k`` per query even when a
    query has fewer neighbours.
    """
    found = approx.filter(F.col("rank") <= k).select("query_id", "id").distinct()
    truth = exact.filter(F.col("rank") <= k).select("query_id", "id").distinct()
    hits = truth.join(found.withColumn("_hit", F.lit(1)), ["query_id", "id"], "left")
    per_query = hits.groupBy("query_id").agg(F.count("_hit").alias("hits"))
    return per_query.agg(
        F.count(F.lit(1)).alias("queries"),
        F.coalesce(F.sum("hits"), F.lit(0)).cast("bigint").alias("hits"),
        F.coalesce(F.sum("hits") / (F.count(F.lit(1)) * k), F.lit(0.0)).alias("recall"),
    )
