"""Column functions against values worked out by hand."""

import datetime

import pytest
from pyspark.sql import functions as F

from larkspur.functions import errors, images, links, models, payload, predicates, text, vectors


def value(spark, column, **inputs):
    row = spark.range(1).select(*[v.alias(k) for k, v in inputs.items()]) if inputs else spark.range(1)
    return row.select(column.alias("v")).first().v


@pytest.mark.parametrize("args, want", [
    ({"extension": F.lit, "size": "medium"}, "https://h/photos/21213/medium.jpg"),
    ({}, "https://h/photos/21213/medium.jpeg"),
    ({"size": "large"}, "https://h/photos/21213/large.jpeg"),
])
def test_image_url(spark, args, want):
    extra = {k: (v("jpg") if k == "extension" else v) for k, v in args.items()}
    assert value(spark, links.image_url(F.lit(21213), "h", **extra)) == want


@pytest.mark.parametrize("url, want", [
    ("https://h/photos/21213/medium.jpg", 21213), ("medium.jpg", None), ("a/b/c", None), ("7/x", 7)])
def test_photo_id_from_url(spark, url, want):
    assert value(spark, links.photo_id_from_url(F.lit(url))) == want


@pytest.mark.parametrize("uri, bucket, key", [
    ("s3://b/path/to/f.json", "b", "path/to/f.json"), ("s3a://b/k", "b", "k"), ("s3://b", "b", ""), ("s3://b/", "b", "")])
def test_store_uri_parts(spark, uri, bucket, key):
    got = value(spark, links.store_uri_parts(F.lit(uri)))
    assert (got.bucket, got.key) == (bucket, key)
    assert value(spark, links.is_store_uri(F.lit(uri)))


def test_image_keys_keep_their_order(spark):
    keys = ["a.jpg", "b.txt", "c.PNG", "d", "e.jpeg", "f.gif", "g.webp", "h.json", "i.jpg\n", "j.tar.Jpg"]
    rows = spark.createDataFrame(list(enumerate(keys)), "n int, key string")
    kept = [r.key for r in rows.filter(links.is_image_key(F.col("key"))).orderBy("n").collect()]
    assert kept == ["a.jpg", "c.PNG", "e.jpeg", "f.gif", "g.webp", "j.tar.Jpg"]


@pytest.mark.parametrize("key, want", [("a.JPG", ".jpg"), ("a", ""), ("x.y/z", ".y/z"), ("a.b.C", ".c")])
def test_key_extension(spark, key, want):
    assert value(spark, links.key_extension(F.lit(key))) == want


def test_labels_and_links(spark):
    assert value(spark, links.taxon_label(F.lit("Corvus"), F.lit("Raven"))) == "Raven (Corvus)"
    assert value(spark, links.taxon_label(F.lit("Corvus"), F.lit(""))) == "Corvus"
    assert value(spark, links.taxon_label(F.lit("Corvus"), F.lit(None).cast("string"))) == "Corvus"
    assert value(spark, links.map_link(F.lit(1.5), F.lit(-2.0))) == "https://maps.google.com/?q=1.5,-2.0"
    assert value(spark, links.photo_page_link(F.lit(5), "https://s/")) == "https://s/photos/5"


def test_geo_point_fills_each_side(spark):
    got = value(spark, payload.geo_point(F.lit(None).cast("double"), F.lit(3.5)))
    assert (got.lat, got.lon) == (0.0, 3.5)


def test_dates(spark):
    assert value(spark, payload.rfc3339_date(F.lit(datetime.date(2020, 2, 9)))) == "2020-02-09"
    assert value(spark, payload.rfc3339_date(F.lit(None).cast("date"))) == ""


def test_point_ids(spark):
    one, two = (value(spark, payload.point_id(F.lit("s3://b/k"))) for _ in range(2))
    assert one == two and len(one) == 36
    assert value(spark, payload.point_id(F.lit("s3://b/k2"))) != one
    with pytest.raises(ValueError):
        payload.point_id(F.lit("x"), "serial")


@pytest.mark.parametrize("doc, want", [
    ('{}', ("", None, None, None, None)),
    ('{"species": "Corvus", "location": {"latitudeMin": "0", "latitudeMax": "1.5", "longitudeMin": "", "longitudeMax": null}}',
     ("Corvus", 0.0, 1.5, None, None)),
    ('{"location": {"latitudeMin": "north"}}', ("", None, None, None, None)),
    ('not json', ("", None, None, None, None)),
])
def test_parse_filters(spark, doc, want):
    got = value(spark, payload.parse_filters(F.lit(doc)))
    assert (got.species, got.latitude_min, got.latitude_max, got.longitude_min, got.longitude_max) == want


def test_parse_filters_dates(spark):
    got = value(spark, payload.parse_filters(F.lit('{"start_date": "2020-01-02", "end_date": "x", "months": ["Jan"]}')))
    assert (got.start_date, got.end_date, got.months) == (datetime.date(2020, 1, 2), None, ["Jan"])


@pytest.mark.parametrize("certainty, distance, want", [
    (0.95, None, 0.95), (None, 0.2, 0.8), (None, 1.7, 0.0), (None, -0.5, 1.0), (None, None, 0.0), (0.1, 0.2, 0.1)])
def test_to_score(spark, certainty, distance, want):
    got = value(spark, vectors.to_score(F.lit(certainty).cast("double"), F.lit(distance).cast("double")))
    assert got == pytest.approx(want)


def test_metric_names():
    assert vectors.resolve_metric("COSINE") == "cosine"
    with pytest.raises(ValueError, match="known metrics"):
        vectors.resolve_metric("hamming")


def test_similarities(spark):
    a, b = vectors.vector_literal([3.0, 4.0]), vectors.vector_literal([0.0, 2.0])
    got = {m: value(spark, vectors.similarity(a, b, m)) for m in vectors.METRICS}
    assert got == pytest.approx({"ip": 8.0, "cosine": 0.8, "l2": -(13 ** 0.5), "l1": -5.0})
    zero = vectors.vector_literal([0.0, 0.0])
    assert value(spark, vectors.cosine(a, zero)) == 0.0
    assert value(spark, vectors.l2_normalise(zero)) == [0.0, 0.0]


def test_pad_ids(spark):
    ids = F.array(*[F.lit(i).cast("bigint") for i in (5, 6)])
    assert value(spark, vectors.pad_ids(ids, 4)) == [5, 6, -1, -1]
    assert value(spark, vectors.pad_ids(ids, 1)) == [5]
    assert value(spark, vectors.pad_ids(F.lit(None).cast("array<bigint>"), 2)) == [-1, -1]


@pytest.mark.parametrize("model, want", [
    ("llava", 4096), ("LLaVA:13b", 5120), ("my/llava:34b-q4", 8192), ("bakllava", 4096),
    ("openai/clip-vit-base-patch16", 512), ("clip-vit-large-patch14-336", 768), ("unknown", 512)])
def test_image_model_size(spark, model, want):
    assert value(spark, models.image_model_size(F.lit(model))) == want
    assert value(spark, models.image_model_size(F.lit(model), F.lit(99))) == 99


@pytest.mark.parametrize("model, want", [("all-minilm", 384), ("qwen3-embedding:8b", 1024), ("All-MiniLM", 768)])
def test_text_model_size(spark, model, want):
    assert value(spark, models.text_model_size(F.lit(model))) == want


@pytest.mark.parametrize("code, status, want", [
    ("SlowDown", "400", True), ("InternalError", None, True), ("NoSuchKey", "503", False), ("404", "500", False),
    ("Other", "502", True), ("Other", "404", False), (None, None, False), (None, "500", True)])
def test_is_retriable(spark, code, status, want):
    got = value(spark, errors.is_retriable(F.lit(code).cast("string"), F.lit(status).cast("string")))
    assert got is want


@pytest.mark.parametrize("message, want", [
    ("Circuit Breaker open: upstream", "circuit_breaker"), ("UPSTREAM down", "upstream"), ("disk", "other"), (None, "other")])
def test_error_class(spark, message, want):
    assert value(spark, errors.error_class(F.lit(message).cast("string"))) == want


def test_box_crosses_the_antimeridian(spark):
    rows = spark.createDataFrame([(1, 0.0, 179.0), (2, 0.0, -179.0), (3, 0.0, 0.0), (4, None, None), (5, 10.0, 170.0)],
                                 "id int, lat double, lon double")
    box = predicates.in_box(F.col("lat"), F.col("lon"), -10.0, 10.0, 170.0, -170.0)
    assert {r.id for r in rows.filter(box).collect()} == {1, 2, 5}
    assert predicates.in_box(F.col("lat"), F.col("lon"), None, 1.0, 1.0, 1.0) is None
    zero = predicates.in_box(F.col("lat"), F.col("lon"), 0.0, 0.0, 0.0, 0.0)
    assert {r.id for r in rows.filter(zero).collect()} == {3}


def test_no_conditions_keep_everything(spark):
    assert spark.range(3).filter(predicates.all_of(None, None)).count() == 3
    with pytest.raises(ValueError):
        predicates.month_number("January")


def test_query_problems_are_rows(spark):
    asked = [("", 5), ("  \n", 5), (None, 5), ("x", 0), ("x", 101), ("x", None), (" red fox ", 100), ("x", 1)]
    frame = spark.createDataFrame(asked, "q string, n int")
    found = [r[0] for r in frame.select(predicates.query_problem(F.col("q"), F.col("n"))).collect()]
    assert found == ["the query has no text"] * 3 + ["the limit is not from 1 to 100"] * 3 + [None, None]


def test_strip_matches_python(spark):
    for raw in ("\u2003 a b\u00a0", "\x1c\x85x\u3000", " \t\n", ""):
        assert value(spark, text.strip(F.lit(raw))) == raw.strip()


@pytest.mark.parametrize("raw, want", [
    ("Preface\nCHAPTER 1\nIt began.\n\n\n\nIt went on.\nEnd of the Project Gutenberg EBook", "CHAPTER 1\nIt began.\n\nIt went on."),
    ("chapter i of all\nx\n \n End of Project Gutenberg's", "chapter i of all\nx"),
    ("Preface\nChapter 12\nx", "Preface\nChapter 12\nx"),
    ("no marks \n", "no marks"),
    ("see chapter 1 here\nchapter\u00a01\nbody", "chapter\u00a01\nbody"),
])
def test_clean_book_text(spark, raw, want):
    assert value(spark, text.clean_book_text(F.lit(raw))) == want


PNG = bytes.fromhex("89504E470D0A1A0A")


@pytest.mark.parametrize("data, want", [
    (b"\xff\xd8\xff" + b"x" * 9, "jpeg"), (PNG + b"xxxx", "png"), (b"GIF87a" + b"x" * 6, "gif"), (b"GIF89a" + b"x" * 6, "gif"),
    (b"RIFF1234WEBP", "webp"), (b"RIFF1234WAVE", None), (b"\xff\xd8\xff", None), (b"", None), (b"x" * 20, None)])
def test_detect_image_format(spark, data, want):
    got = spark.createDataFrame([(bytearray(data),)], "c binary").select(
        images.detect_image_format(F.col("c")).alias("f")).first().f
    assert got == want


@pytest.mark.parametrize("data, want", [
    (b"\x89PNG", "image/png"), (b"\xff\xd8\xff", "image/jpeg"), (b"GIF89a", "image/gif"), (b"RIFF12WEBP", "image/webp"),
    (b"RIFF123456789WEBP", "image/png"), (b"none", "image/png")])
def test_lenient_mime_type(spark, data, want):
    got = spark.createDataFrame([(bytearray(data),)], "c binary").select(
        images.lenient_mime_type(F.col("c")).alias("m")).first().m
    assert got == want


def test_base64_has_no_line_breaks(spark):
    import base64

    data = bytes(range(256)) * 3
    row = spark.createDataFrame([(bytearray(data),)], "c binary").select(
        images.base64_text(F.col("c")).alias("b"), images.data_url(F.col("c")).alias("u"), images.encode_error(F.col("c")).alias("e")).first()
    assert row.b == base64.b64encode(data).decode() and row.u == "data:image/png;base64," + row.b and row.e is None


@pytest.mark.parametrize("size, want", [
    (99, "only 99 bytes, at least 100 wanted"), (100, None), (200, None), (201, "201 bytes, at most 200 allowed")])
def test_image_error_limits_are_inclusive(spark, size, want):
    data = PNG + b"x" * (size - 8)
    got = spark.createDataFrame([(bytearray(data),)], "c binary").select(
        images.image_error(F.col("c"), 100, 200).alias("e")).first().e
    assert got == want


def test_image_error_unknown_format(spark):
    got = spark.createDataFrame([(bytearray(b"x" * 150),)], "c binary").select(images.image_error(F.col("c")).alias("e")).first().e
    assert got == "not a known image format"


@pytest.mark.parametrize("size, want", [
    ((448, 224), (224, 112, 0, 56)), ((100, 50), (100, 50, 62, 87)), ((224, 224), (224, 224, 0, 0)),
    ((300, 1000), (67, 224, 78, 0)), ((5000, 3), (224, 1, 0, 111)), ((3, 5000), (1, 224, 111, 0)), ((225, 225), (224, 224, 0, 0))])
def test_letterbox_geometry(spark, size, want):
    box = value(spark, images.letterbox_geometry(F.lit(size[0]), F.lit(size[1])))
    assert tuple(box) == want
