"""Object folders, tables, query files and pictures."""

import os

import numpy as np
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from larkspur import schemas
from larkspur.operators.pictures import letterbox, read_pictures
from larkspur.sources import objects, tables
from tests.pictures import gif, jpeg, png, webp


def put(folder, name, data):
    path = os.path.join(folder, name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as out:
        out.write(data if isinstance(data, bytes) else data.encode())


def test_list_and_read_text(spark, folder):
    put(folder, "inputs/a.txt", "plain")
    put(folder, "inputs/deep/b.txt", "grün 🐦")
    put(folder, "inputs/bad.txt", b"\xff\xfe")
    put(folder, "other/c.txt", "no")
    keys = [r.key for r in objects.list_objects(spark, folder, "inputs/").orderBy("key").collect()]
    assert keys == ["inputs/a.txt", "inputs/bad.txt", "inputs/deep/b.txt"]
    good, failed = objects.split_outcomes(objects.read_text_objects(spark, folder, "inputs/"))
    assert {r.key: r.text for r in good.collect()} == {
        "inputs/a.txt": "plain", "inputs/deep/b.txt": "grün 🐦"}
    assert [(r.key, r.error_message) for r in failed.collect()] == [("inputs/bad.txt", objects.FETCH_FAILED)]


def test_listing_opens_no_file(spark, folder):
    put(folder, "a.txt", "x")
    plan = objects.list_objects(spark, folder)._jdf.queryExecution().optimizedPlan().toString()
    assert "content" not in plan.split("Relation")[0]


def test_image_objects(spark, folder):
    put(folder, "i/good.png", png(np.zeros((20, 30, 3))) + b"\0" * 100)
    put(folder, "i/tiny.gif", b"GIF89a")
    put(folder, "i/huge.jpg", jpeg(4, 4) + b"\0" * 5000)
    put(folder, "i/odd.webp", b"?" * 300)
    put(folder, "i/notes.txt", "x" * 300)
    rows = {r.key: r for r in objects.read_image_objects(spark, folder, "i/", max_bytes=2000, with_dimensions=True).collect()}
    assert set(rows) == {"i/good.png", "i/tiny.gif", "i/huge.jpg", "i/odd.webp"}
    assert (rows["i/good.png"].width, rows["i/good.png"].height, rows["i/good.png"].format) == (30, 20, "png")
    assert rows["i/tiny.gif"].reason == "only 6 bytes, at least 100 wanted"
    assert rows["i/huge.jpg"].reason.endswith(" allowed")
    assert rows["i/odd.webp"].reason == "not a known image format"
    assert all(r.error_message == objects.IMAGE_FETCH_FAILED for k, r in rows.items() if k != "i/good.png")


@pytest.mark.parametrize("data, size", [
    (png(np.zeros((7, 5))) + b"\0" * 80, (5, 7)), (gif(300, 2), (300, 2)), (jpeg(640, 480), (640, 480)),
    (jpeg(640, 480, 0xC2), (640, 480)), (webp(b"VP8 ", 1000, 70), (1000, 70)), (webp(b"VP8L", 16384, 9), (16384, 9)),
    (webp(b"VP8X", 70000, 3), (70000, 3)), (b"\xff\xd8\xff\xda" + b"\0" * 200, (None, None)), (b"\xff\xd8\xff\xe0\0\x10", (None, None)),
    (b"?" * 200, (None, None))])
def test_dimensions(spark, data, size):
    row = objects.check_images(spark.createDataFrame([(bytearray(data),)], "content binary"), min_bytes=1, with_dimensions=True).first()
    assert (row.width, row.height) == size


def test_validate_images(spark, folder):
    put(folder, "ok.png", png(np.full((3, 3, 3), 9)))
    put(folder, "cut.png", png(np.full((30, 30, 3), 9))[:40])
    put(folder, "ok.webp", webp(b"VP8 ", 5, 5))
    put(folder, "text.gif", "not a picture")
    got = {r.path.rsplit("/", 1)[1]: (r.is_valid, r.error) for r in objects.validate_images(spark, folder).collect()}
    assert got["ok.png"] == (True, "") and got["ok.webp"] == (True, "")
    assert not got["cut.png"][0] and got["text.gif"][1].startswith("Invalid image format")


def test_letterbox_pixels(spark, folder):
    rng = np.random.default_rng(1)
    colour, grey = rng.integers(0, 256, (4, 6, 3)), rng.integers(0, 256, (5, 3))
    alpha = np.dstack([colour, np.full((4, 6), 7)])
    wide = np.full((10, 40, 3), 200)
    for name, pixels in (("colour", colour), ("grey", grey), ("alpha", alpha), ("wide", wide)):
        put(folder, f"{name}.png", png(pixels))
    rows = letterbox(read_pictures(spark, folder), 8).collect()
    got = {r.path.rsplit("/", 1)[1][:-4]: np.frombuffer(bytes(r.data), np.uint8).reshape(8, 8, 3) for r in rows}
    frame = np.zeros((8, 8, 3), int)
    frame[2:6, 1:7] = colour
    assert (got["colour"] == frame).all() and (got["alpha"] == frame).all()
    frame = np.zeros((8, 8, 3), int)
    frame[1:6, 2:5] = grey[:, :, None]
    assert (got["grey"] == frame).all()
    assert (got["wide"][3:5] == 200).all() and (got["wide"][:3] == 0).all() and (got["wide"][5:] == 0).all()


def test_photo_csv(spark, folder):
    names = "\t".join(f.name for f in schemas.PHOTOS_CSV.fields)
    line = "8d6b2534\t21213\t7ae155fc\t516\tjpg\tCC-BY-NC\t584\t389\t0"
    put(folder, "photos.csv", f"{names}\n{line}\nx\tnot a number\ty\t1\tjpg\tCC0\t1\t1\t0\n")
    good, bad = tables.read_photo_csv(spark, folder + "/photos.csv").orderBy(F.col("_corrupt_record").isNotNull()).collect()
    assert (good.photo_id, good.extension, good.width, good.position) == (21213, "jpg", 584, 0)
    assert "not a number" in bad._corrupt_record


def test_tables(spark, folder):
    for name, schema in schemas.TABLES.items():
        spark.createDataFrame([], schema).write.parquet(f"{folder}/{name}")
    got = tables.read_tables(spark, folder)
    assert {n: d.count() for n, d in got.items()} == {n: 0 for n in schemas.TABLES}


def test_missing_dataset(spark, folder):
    with pytest.raises(AnalysisException, match="PATH_NOT_FOUND"):
        tables.read_embedding_dataset(spark, folder + "/none")


def test_queries(spark, folder):
    put(folder, "queries.txt", "red fox\n\n  a bird \r\n\t\nwhite moth")
    read = lambda limit: [(r.query_id, r["query"]) for r in tables.read_queries(spark, folder + "/queries.txt", limit).orderBy("query_id").collect()]
    assert read(-1) == [(0, "red fox"), (2, "a bird"), (4, "white moth")]
    assert read(2) == [(0, "red fox"), (2, "a bird")] and read(0) == []


def test_baseline_shape(spark, folder):
    rows = spark.createDataFrame([(q, r, q * 10 + r) for q in range(3) for r in (1, 2)], "query_id bigint, rank bigint, id bigint")
    rows.write.parquet(folder + "/base")
    assert tables.read_baseline(spark, folder + "/base", 2).count() == 6
    with pytest.raises(ValueError, match="3 ids"):
        tables.read_baseline(spark, folder + "/base", 3)
