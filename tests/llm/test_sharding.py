import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from larkspur.llm.inputs import numbered
from larkspur.llm.queries import op5_sharding
from larkspur.llm.sharding import rendezvous, shard_rows, write_shards
from tests.llm.cases import documents, tables, with_clashes


def test_query(spark, folder):
    docs = documents(spark)
    rows = op5_sharding(spark, tables(spark, f"{folder}/t", documents=docs)).collect()
    assert sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in rows), key=repr) == sorted(
        ((r["doc_id"], len((r["text"] or "").encode()) + 16, zlib.crc32((r["text"] or "").encode()))
         for r in docs.collect()), key=repr)
    for shard in {r["shard"] for r in rows}:
        slots = sorted(r["slot"] for r in rows if r["shard"] == shard)
        assert slots == list(range(len(slots)))
    assert all(r["grown_shard"] in (r["shard"], 40) for r in rows)


def test_key_and_count_decide(spark):
    rows = spark.range(5000).select(F.col("id").alias("doc_id"), F.rand().alias("x"))
    a = {r["doc_id"]: r for r in shard_rows(rows, "doc_id", [1.0] * 10).collect()}
    b = {r["doc_id"]: r for r in shard_rows(rows.repartition(7), "doc_id", [1.0] * 11).collect()}
    assert all(a[k]["grown_shard"] == b[k]["shard"] for k in a)
    moved = [k for k in a if a[k]["shard"] != b[k]["shard"]]
    assert all(b[k]["shard"] == 10 for k in moved) and 300 < len(moved) < 620


def test_weights(spark):
    rows = spark.range(20_000).select(F.col("id").cast("string").alias("k"))
    counts = Counter(r["s"] for r in rows.select(rendezvous(F.col("k"), [1.0, 2.0, 5.0])[0].alias("s")).collect())
    assert abs(counts[0] - 2500) < 250 and abs(counts[1] - 5000) < 300 and abs(counts[2] - 12_500) < 350
    with pytest.raises(ValueError):
        rendezvous(F.col("k"), [])


def test_cases(spark, folder):
    docs = with_clashes(documents(spark), ["shard", "slot", "grown_shard", "by", "chunk", "row"])
    sharded = shard_rows(docs, "doc_id", [1.0] * 3, content="text")
    assert sharded.count() == 13 and sharded.columns.count("shard") == 1
    assert shard_rows(documents(spark, []), "doc_id", [1.0]).count() == 0
    write_shards(sharded, f"{folder}/out")
    assert spark.read.parquet(f"{folder}/out").count() == 13
    # Rows without a key are spread by what they hold.
    nulls = documents(spark, [(None, f"text {k}") for k in range(300)])
    assert shard_rows(nulls, "doc_id", [1.0] * 4, content="text").select("shard").distinct().count() == 4


def test_numbers_are_gapless(spark):
    rows = spark.range(5000).select((F.col("id") % 3 == 0).alias("hot"), F.lit(None).cast("int").alias("none"))
    for by in ("hot", "none"):
        groups = {}
        for r in numbered(rows, by, "n").collect():
            groups.setdefault(r[by], []).append(r["n"])
        assert all(sorted(g) == list(range(len(g))) for g in groups.values())
