"""The layout by place and time."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from larkspur.operators.search import Layout, filter_condition
from larkspur.operators.space import NOWHERE, cells_for, read_clustered, search_clustered, space_key, write_clustered

LAYOUT = Layout(species=None, latitude="lat", longitude="lon", date="day")


@pytest.fixture(scope="module")
def laid_out(spark, tmp_path_factory):
    rng = random.Random(2)
    rows = [(i, [float(i), 1.0], rng.choice((None, -90.0, 90.0, 95.0, rng.uniform(-90, 90))), rng.choice((-180.0, 180.0, rng.uniform(-180, 180))),
             rng.choice((None, datetime.date(2019, 1, 1) + datetime.timedelta(days=rng.randint(0, 4000))))) for i in range(3000)]
    frame = spark.createDataFrame(rows, "id bigint, vector array<float>, lat double, lon double, day date").cache()
    path = str(tmp_path_factory.mktemp("space") / "cells")
    write_clustered(frame, path, LAYOUT)
    return frame, path


def drawn_filters(rng):
    out = {}
    if rng.random() < 0.7:
        lats, lons = sorted(rng.uniform(-95, 95) for _ in range(2)), [rng.uniform(-180, 180) for _ in range(2)]
        out |= {"latitude_min": lats[0], "latitude_max": lats[1], "longitude_min": lons[0], "longitude_max": lons[1]}
    if rng.random() < 0.5:
        first = datetime.date(2019, 1, 1) + datetime.timedelta(days=rng.randint(0, 4000))
        out["start_date"] = str(first)
        if rng.random() < 0.8:
            out["end_date"] = str(first + datetime.timedelta(days=rng.choice((0, 20, 400, 4000))))
    if rng.random() < 0.4:
        out["months"] = rng.sample(["Jan", "May", "Jun", "Dec"], 2)
    return out


def test_the_same_rows_pass(spark, laid_out):
    frame, path = laid_out
    rng = random.Random(7)
    for _ in range(25):
        filters = drawn_filters(rng)
        got = {r.id for r in read_clustered(spark, path, filters, LAYOUT).select("id").collect()}
        assert got == {r.id for r in frame.filter(filter_condition(LAYOUT, filters)).select("id").collect()}, filters


def test_few_files_are_opened(spark, laid_out):
    frame, path = laid_out
    files = lambda cells: spark.read.parquet(path).filter(cells).select(F.input_file_name().alias("f")).distinct().count()
    every = files(F.lit(True))
    box = {"latitude_min": 10.0, "latitude_max": 15.0, "longitude_min": 170.0, "longitude_max": -175.0,
           "start_date": "2024-05-01", "end_date": "2024-05-31"}
    cells = cells_for(box)
    assert NOWHERE not in cells and len(cells) == 2 and files(F.col("cell").isin(cells)) <= 2 < every / 100
    found = search_clustered(spark, path, [1.0, 0.0], 3, "ip", box, LAYOUT)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "cell" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert cells_for({}) is None and NOWHERE in cells_for({"months": ["May"]})


def test_key_interleaves_the_bits(spark):
    rows = spark.createDataFrame([(-90.0, -180.0, datetime.date(2016, 1, 1)), (90.0, 180.0, datetime.date(2023, 12, 1)),
                                  (0.0, -180.0, datetime.date(2016, 1, 1)), (None, 0.0, None)], "a double, o double, d date")
    keys = [r[0] for r in rows.select(space_key(F.col("a"), F.col("o"), F.col("d"), 2)).collect()]
    # Four bits of place and seven of the month: 95 is 1011111.
    assert keys[0] == 0 and keys[3] is None
    assert keys[2] == 1 << 10 and keys[1] == int("111" + "110" + "11111", 2)
