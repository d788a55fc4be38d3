"""Expressions over keys, URLs, payloads, image bytes, filters and errors."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from larkspur.catalog.tables import table
from larkspur.functions import images as img, links, models, payload, predicates
from larkspur.functions.errors import error_class, is_retriable
from larkspur.operators.pictures import letterbox
from larkspur.operators.relational import suggest_taxa
from larkspur.sources.objects import check_images

HOST = "images.example.org"
SITE = "https://photos.example.org"


def image_links(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    photo, ext = F.col("o_orderkey"), F.lower("o_orderstatus")
    url = links.image_url(photo, HOST, ext)
    lat, lon = (F.col("o_custkey") / 16).cast("double"), (F.col("o_orderkey") / 8).cast("double")
    return orders.select(
        photo.alias("id"), url.alias("img_url"), links.image_url(photo, HOST, size="large").alias("large_url"),
        links.image_file_name(photo, ext).alias("file_name"), links.photo_id_from_url(url).alias("back"),
        links.photo_page_link(photo, SITE).alias("page"),
        links.map_link(F.floor(lat), F.floor(lon)).alias("map"),
    )


def page_url_parts(spark, sf_dir):
    """Page addresses read as object URIs."""
    uri = F.regexp_replace("url", "^https?://", "s3a://")
    parts = links.store_uri_parts(uri)
    return table(spark, sf_dir, "pages").select(
        "page_id", links.is_store_uri(uri).alias("is_uri"), links.is_store_uri(F.col("url")).alias("was_uri"),
        parts["bucket"].alias("bucket"), parts["key"].alias("key"),
        links.key_extension(F.col("url")).alias("extension"), links.photo_id_from_url(F.col("url")).alias("photo_id"),
    )


def _object_key(number: Column) -> Column:
    names = F.array(*[F.lit(e) for e in (".jpg", ".TXT", ".PNG", ".webp", "", ".Jpeg", ".gif", ".json", ".jpg.bak")])
    return F.concat(F.lit("inputs/doc-"), number.cast("string"), F.get(names, F.pmod(number, F.lit(9)).cast("int")))


_OBJECT_KEY_SQL = ("'inputs/doc-' || doc_id || ['.jpg', '.TXT', '.PNG', '.webp', '', '.Jpeg', '.gif', '.json', "
                   "'.jpg.bak'][(doc_id % 9 + 1)::INTEGER]")


def image_key_filter(spark, sf_dir):
    keys = table(spark, sf_dir, "documents").select("doc_id", _object_key(F.col("doc_id")).alias("key"))
    return keys.filter(links.is_image_key(F.col("key")))


def geo_dates(spark, sf_dir):
    lat = F.when(F.col("o_orderstatus") != "F", F.col("o_custkey") / 100)
    lon = F.when(F.col("o_orderpriority") != "5-LOW", -F.col("o_custkey") / 50)
    point = payload.geo_point(lat, lon)
    date = F.when(F.col("o_totalprice") > 1000, F.col("o_orderdate").cast("date"))
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", point["lat"].alias("lat"), point["lon"].alias("lon"), payload.rfc3339_date(date).alias("observed_on"))


def text_points(spark, sf_dir):
    bucket, key = F.lit("archive"), F.concat(F.lit("inputs/doc-"), F.col("doc_id").cast("string"), F.lit(".txt"))
    p = payload.text_payload(bucket, key, F.col("text"))
    return table(spark, sf_dir, "documents").select(
        payload.point_id(p["s3_uri"]).alias("id"), p["s3_key"].alias("s3_key"), p["s3_bucket"].alias("s3_bucket"),
        p["s3_uri"].alias("s3_uri"), F.md5(p["text"].cast("binary")).alias("text_md5"))


def random_point_ids(spark, sf_dir):
    """Random ids: version 4 UUIDs, all different."""
    ids = table(spark, sf_dir, "documents").select(payload.point_id(F.col("doc_id"), "random").alias("id"))
    shape = F.rlike("id", F.lit("^[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$"))
    return ids.agg(F.count_distinct("id").alias("ids"), F.bool_and(shape).alias("well_formed"))


# Image bytes made from document texts: a format header followed by the text.
_HEADS = {
    0: "FFD8FFE000104A4649460001",
    1: "89504E470D0A1A0A0000000D49484452",
    2: "474946383761",
    3: "474946383961",
    4: "52494646000000005745425056503820",
    5: "5249464600005745425000",
    6: "89504E4700",
    7: "",
}


def _with_image(rows):
    head = F.unhex(F.get(F.array(*[F.lit(h) for h in _HEADS.values()]), F.pmod("doc_id", F.lit(8)).cast("int")))
    return rows.withColumn("content", F.concat(head, F.encode("text", "UTF-8")))


_IMAGE_SQL = ("images AS (SELECT doc_id, doc_id % 8 AS f, text, unhex(["
              + ", ".join(f"'{h}'" for h in _HEADS.values())
              + "][(doc_id % 8 + 1)::INTEGER]) || encode(text) AS content FROM documents)")


def image_verdicts(spark, sf_dir):
    checked = check_images(_with_image(table(spark, sf_dir, "documents")), min_bytes=300, max_bytes=9000)
    return checked.select(
        "doc_id", "format", "size_bytes", "success", "reason", "error_message",
        img.mime_type(F.col("format")).alias("mime"), img.lenient_mime_type(F.col("content")).alias("lenient_mime"))


def damaged_headers(spark, sf_dir):
    """PNG and lossless WebP headers whose sizes take all 32 bits: no image is so large, so the size is null."""
    number = F.pmod(F.col("o_orderkey") * 2_654_435_761, F.lit(1 << 32))
    digits = F.lpad(F.hex(number), 8, "0")
    turned = F.concat(*(F.substring(digits, at, 2) for at in (7, 5, 3, 1)))
    png = F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), digits, F.lit("00000010"))
    webp = F.concat(F.lit("52494646FFFFFFFF574542505650384C000000002F"), turned)
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.explode(F.array(
        F.struct(F.lit("png").alias("format"), F.unhex(png).alias("content")),
        F.struct(F.lit("webp").alias("format"), F.unhex(webp).alias("content")))).alias("i"))
    size = img.image_dimensions(F.col("i.content"))
    return rows.select("o_orderkey", "i.format", size.alias("s")).select(
        "o_orderkey", "format", F.col("s.width").cast("bigint").alias("width"), F.col("s.height").cast("bigint").alias("height"))


def image_base64(spark, sf_dir):
    content = F.col("content")
    rows = _with_image(table(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id", F.md5(img.base64_text(content).cast("binary")).alias("plain_md5"),
        F.length(img.data_url(content)).cast("bigint").alias("url_length"), img.encode_error(content).alias("error"))


def _be(value: Column, width: int) -> Column:
    return F.unhex(F.lpad(F.hex(value.cast("bigint")), width * 2, "0"))


def _le(value: Column, width: int) -> Column:
    digits = F.lpad(F.hex(value.cast("bigint")), width * 2, "0")
    return F.unhex(F.concat(*[F.substring(digits, 2 * (width - 1 - i) + 1, 2) for i in range(width)]))


def image_sizes(spark, sf_dir):
    """Width and height read back from image headers that were written from order columns."""
    n = F.col("o_orderkey")
    w, h = F.pmod(F.col("o_custkey"), F.lit(9000)) + 1, F.pmod(n, F.lit(7000)) + 1
    x = lambda text: F.unhex(F.lit(text))
    kinds = F.pmod(n, F.lit(7))
    packed = (w - 1) + (h - 1) * 16384
    tail = x("00" * 16)
    content = (
        F.when(kinds == 0, F.concat(x("89504E470D0A1A0A0000000D49484452"), _be(w, 4), _be(h, 4), tail))
        .when(kinds == 1, F.concat(x("474946383961"), _le(w, 2), _le(h, 2), tail))
        .when(kinds == 2, F.concat(x("524946460000000057454250565038200000000000000000"), x("9D01"), _le(w, 2), _le(h, 2), tail))
        .when(kinds == 3, F.concat(x("5249464600000000574542505650384C000000002F"), _le(packed, 4), tail))
        .when(kinds == 4, F.concat(x("52494646000000005745425056503858"), x("0A00000000000000"), _le(w - 1, 3), _le(h - 1, 3), tail))
        .when(kinds == 5, F.concat(x("FFD8FFE00010" + "00" * 14 + "FFDB0004" + "0000" + "FFC0001108"), _be(h, 2), _be(w, 2), tail))
        .otherwise(F.concat(x("FFD8FFE00010" + "00" * 14 + "FFDA0004"), tail))
    )
    return (
        table(spark, sf_dir, "orders").select("o_orderkey", content.alias("content"))
        .select("o_orderkey", img.image_dimensions(F.col("content")).alias("s"))
        .select("o_orderkey", F.col("s.width").cast("bigint").alias("width"), F.col("s.height").cast("bigint").alias("height"))
    )


def letterbox_boxes(spark, sf_dir):
    sizes = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        (F.col("l_partkey") + 1).alias("w"), (F.col("l_suppkey") * 9 + 1).alias("h"))
    boxed = sizes.withColumn("box", img.letterbox_geometry(F.col("w"), F.col("h"), 224))
    return boxed.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        *[F.col(f"box.{n}").cast("bigint").alias(n) for n in ("width", "height", "x_offset", "y_offset")])


def _vector_pictures(spark, sf_dir):
    """Each vector as an 8 x 8 grey picture."""
    grey = F.array_join(F.transform("embedding", lambda x: F.lpad(F.hex(
        F.floor((F.greatest(F.least(x.cast("double"), F.lit(1.0)), F.lit(-1.0)) + 1) * 127).cast("bigint")), 2, "0")), "")
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", F.lit(8).alias("width"), F.lit(8).alias("height"), F.lit(1).alias("channels"), F.unhex(grey).alias("data"))


def letterbox_small(spark, sf_dir):
    """Small pictures stay as they are in the middle of the square."""
    boxed = letterbox(_vector_pictures(spark, sf_dir), 12)
    pixel = lambda x, y: F.conv(F.hex(F.substring("data", (y * 12 + x) * 3 + 1, 1)), 16, 10).cast("bigint")
    return boxed.select("vec_id", F.length("data").cast("bigint").alias("bytes"), pixel(1, 1).alias("corner"),
                        pixel(2, 2).alias("first"), pixel(9, 9).alias("last"), pixel(10, 10).alias("far"))


def letterbox_shrunk(spark, sf_dir):
    """Pictures resampled to a smaller square."""
    boxed = letterbox(_vector_pictures(spark, sf_dir), 4)
    return boxed.select("vec_id", F.length("data").cast("bigint").alias("bytes"), F.md5("data").alias("pixels_md5"))


_FORM = """to_json(named_struct(
  'species', if(o_orderstatus = 'F', null, o_orderpriority),
  'location', if(o_orderstatus = 'P', null, named_struct(
      'latitudeMin', cast(o_custkey as string), 'latitudeMax', if(o_orderpriority = '1-URGENT', '', '45.5'),
      'longitudeMin', '-7e1', 'longitudeMax', if(o_orderpriority = '2-HIGH', 'east', '0')))))"""


def search_forms(spark, sf_dir):
    """Filter documents of a search form, parsed into typed columns."""
    parsed = payload.parse_filters(F.expr(_FORM))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", parsed.alias("f"))
    names = ("species", "latitude_min", "latitude_max", "longitude_min", "longitude_max")
    return rows.select("o_orderkey", *[F.col(f"f.{n}").alias(n) for n in names])


def event_props(spark, sf_dir):
    """The JSON properties of events as filter documents: no known entries, so nothing filters."""
    parsed = payload.parse_filters(F.col("props"))
    rows = table(spark, sf_dir, "events").select("event_id", parsed.alias("f"))
    return rows.select("event_id", F.col("f.species").alias("species"), F.col("f.latitude_min").alias("latitude_min"))


_MODELS = ("LLaVA:13b", "llava:34b-v1.6", "bakllava:latest", "openai/clip-vit-base-patch16", "CLIP-ViT-Large-Patch14",
           "siglip-so400m", "nomic-embed-text", "all-minilm:l6-v2", "Nomic-Embed-Text", "qwen3-embedding:4b")


def model_sizes(spark, sf_dir):
    name = F.get(F.array(*[F.lit(m) for m in _MODELS]), F.pmod("p_partkey", F.lit(len(_MODELS))).cast("int"))
    override = F.when(F.col("p_size") > 45, F.col("p_size"))
    return table(spark, sf_dir, "part").select(
        "p_partkey", name.alias("model"), models.image_model_size(name, override).cast("bigint").alias("image_size"),
        models.text_model_size(name, override).cast("bigint").alias("text_size"))


def response_shape(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    entries = F.create_map(F.lit("role"), F.col("role"), F.lit("turn"), F.col("turn").cast("string"),
                           F.when(F.col("role") == "user", F.lit("text")).otherwise(F.lit("note")), F.col("text"))
    meta = payload.response_metadata(entries)
    return turns.select(
        "conv_id", "turn", F.length(payload.response_text(entries)).cast("bigint").alias("text_length"),
        F.array_join(F.array_sort(F.map_keys(meta)), ",").alias("metadata_keys"))


def box_and_dates(spark, sf_dir):
    """Orders in a box across the antimeridian, in a date range and in some months."""
    lat = F.pmod("o_orderkey", F.lit(181)) - 90
    lon = F.when(F.col("o_orderstatus") != "P", F.pmod("o_custkey", F.lit(361)) - 180)
    day = F.col("o_orderdate").cast("date")
    condition = predicates.all_of(
        predicates.in_box(lat, lon, -30.0, 60.0, 100.0, -100.0),
        predicates.in_dates(day, "1993-01-01", None),
        predicates.in_dates(day, None, "1999-06-30"),
        predicates.in_months(day, ["Jan", "Feb", "Aug"]),
        predicates.species_is(F.col("o_orderpriority"), ""),
    )
    return table(spark, sf_dir, "orders").filter(condition).select("o_orderkey", day.alias("observed_on"))


def retriable_events(spark, sf_dir):
    codes = ("SlowDown", "InternalError", "NoSuchKey", "AccessDenied", "Weird", "404", "RequestTimeout")
    code = F.get(F.array(*[F.lit(c) for c in codes]), F.pmod("event_id", F.lit(7)).cast("int"))
    status = F.get(F.array(*[F.lit(s) for s in (500, 404, 503, 429, 200)]), F.pmod("user_id", F.lit(5)).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", is_retriable(code, status).alias("retriable"))


def error_counts(spark, sf_dir):
    message = F.when(F.col("event_type") == "error", F.lit("UpstreamError: no answer")) \
        .when(F.col("event_type") == "click", F.lit("Circuit Breaker open for upstream")).otherwise(F.col("event_type"))
    return table(spark, sf_dir, "events").groupBy(error_class(message).alias("error_class")).agg(
        F.count(F.lit(1)).alias("failures"))


def blank_turns(spark, sf_dir):
    """Turns that would be refused as a query: their text is blank once some are emptied."""
    text = F.when(F.col("role") == "assistant", F.regexp_replace("text", "[^ \n]", " ")).otherwise(F.col("text"))
    return table(spark, sf_dir, "conversations").groupBy("role").agg(
        F.count_if(predicates.is_blank(text)).alias("blank"), F.count(F.lit(1)).alias("turns"))


def taxon_suggestions(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select(F.col("p_name").alias("name"), "p_partkey")
    return suggest_taxa(parts, "  Red ", 20)


def taxon_labels(spark, sf_dir):
    common = F.when(F.col("p_size") > 25, F.col("p_type")).when(F.col("p_size") > 20, F.lit(""))
    return table(spark, sf_dir, "part").select("p_partkey", links.taxon_label(F.col("p_name"), common).alias("label"))


QUERIES = {
    "image_links": image_links,
    "page_url_parts": page_url_parts,
    "image_key_filter": image_key_filter,
    "geo_dates": geo_dates,
    "text_points": text_points,
    "random_point_ids": random_point_ids,
    "image_verdicts": image_verdicts,
    "damaged_headers": damaged_headers,
    "image_base64": image_base64,
    "image_sizes": image_sizes,
    "letterbox_boxes": letterbox_boxes,
    "letterbox_small": letterbox_small,
    "letterbox_shrunk": letterbox_shrunk,
    "search_forms": search_forms,
    "event_props": event_props,
    "model_sizes": model_sizes,
    "response_shape": response_shape,
    "box_and_dates": box_and_dates,
    "retriable_events": retriable_events,
    "error_counts": error_counts,
    "blank_turns": blank_turns,
    "taxon_suggestions": taxon_suggestions,
    "taxon_labels": taxon_labels,
}

_LENIENT_SQL = """CASE WHEN f IN (0) THEN 'image/jpeg' WHEN f IN (2, 3) THEN 'image/gif' WHEN f IN (4, 5) THEN 'image/webp'
     ELSE 'image/png' END"""
_FORMAT_SQL = "CASE f WHEN 0 THEN 'jpeg' WHEN 1 THEN 'png' WHEN 2 THEN 'gif' WHEN 3 THEN 'gif' WHEN 4 THEN 'webp' END"

ORACLES = {
    "image_links": f"""
SELECT o_orderkey AS id, 'https://{HOST}/photos/' || o_orderkey || '/medium.' || lower(o_orderstatus) AS img_url,
       'https://{HOST}/photos/' || o_orderkey || '/large.jpeg' AS large_url,
       'photos/' || o_orderkey || '/medium.' || lower(o_orderstatus) AS file_name, o_orderkey AS back,
       '{SITE}/photos/' || o_orderkey AS page,
       'https://maps.google.com/?q=' || (o_custkey // 16) || ',' || (o_orderkey // 8) AS map
FROM orders""",
    "page_url_parts": r"""
WITH p AS (SELECT page_id, url, regexp_replace(url, '^https?://', '') AS path FROM pages)
SELECT page_id, TRUE AS is_uri, FALSE AS was_uri, split_part(path, '/', 1) AS bucket,
       CASE WHEN contains(path, '/') THEN substr(path, length(split_part(path, '/', 1)) + 2) ELSE '' END AS key,
       lower(regexp_extract(url, '\.[^.]*$')) AS extension,
       TRY_CAST(list_extract(string_split(url, '/'), -2) AS BIGINT) AS photo_id
FROM p""",
    "image_key_filter": f"""
SELECT doc_id, key FROM (SELECT doc_id, {_OBJECT_KEY_SQL} AS key FROM documents)
WHERE lower(key) SIMILAR TO '.*\\.(jpg|jpeg|png|webp|gif)'""",
    "geo_dates": """
SELECT o_orderkey, coalesce(CASE WHEN o_orderstatus <> 'F' THEN o_custkey / 100 END, 0.0) AS lat,
       coalesce(CASE WHEN o_orderpriority <> '5-LOW' THEN -o_custkey / 50 END, 0.0) AS lon,
       coalesce(CASE WHEN o_totalprice > 1000 THEN strftime(o_orderdate, '%Y-%m-%d') END, '') AS observed_on
FROM orders""",
    "text_points": """
WITH k AS (SELECT 'inputs/doc-' || doc_id || '.txt' AS s3_key, text FROM documents),
u AS (SELECT s3_key, 's3://archive/' || s3_key AS s3_uri, md5('s3://archive/' || s3_key) AS h, text FROM k)
SELECT concat_ws('-', h[1:8], h[9:12], h[13:16], h[17:20], h[21:32]) AS id, s3_key, 'archive' AS s3_bucket, s3_uri,
       md5(text) AS text_md5
FROM u""",
    "random_point_ids": "SELECT count(*) AS ids, TRUE AS well_formed FROM documents",
    "image_verdicts": f"""
WITH {_IMAGE_SQL},
m AS (SELECT doc_id, f, octet_length(content) AS n FROM images),
v AS (SELECT doc_id, n AS size_bytes, {_FORMAT_SQL} AS format, {_LENIENT_SQL} AS lenient_mime FROM m),
r AS (SELECT *, CASE WHEN size_bytes < 300 THEN 'only ' || size_bytes || ' bytes, at least 300 wanted'
                     WHEN size_bytes > 9000 THEN size_bytes || ' bytes, at most 9000 allowed'
                     WHEN format IS NULL THEN 'not a known image format' END AS reason FROM v)
SELECT doc_id, format, size_bytes, reason IS NULL AS success, reason,
       CASE WHEN reason IS NOT NULL THEN 'Image fetch/validation failed' END AS error_message,
       CASE WHEN format IS NULL THEN 'application/octet-stream' ELSE 'image/' || format END AS mime, lenient_mime
FROM r""",
    "damaged_headers": """
WITH n AS (SELECT o_orderkey, (o_orderkey::HUGEINT * 2654435761 % 4294967296)::BIGINT AS n FROM orders)
SELECT o_orderkey, 'png' AS format, CASE WHEN n < 2147483648 THEN n END AS width, 16::BIGINT AS height FROM n
UNION ALL SELECT o_orderkey, 'webp', (n & 16383) + 1, ((n >> 14) & 16383) + 1 FROM n""",
    "image_base64": f"""
WITH {_IMAGE_SQL}, m AS (SELECT doc_id, f, to_base64(content) AS b FROM images)
SELECT doc_id, md5(b) AS plain_md5, length('data:' || {_LENIENT_SQL} || ';base64,' || b) AS url_length, NULL::VARCHAR AS error
FROM m""",
    "image_sizes": """
SELECT o_orderkey, CASE WHEN o_orderkey % 7 < 6 THEN o_custkey % 9000 + 1 END AS width,
       CASE WHEN o_orderkey % 7 < 6 THEN o_orderkey % 7000 + 1 END AS height
FROM orders""",
    "letterbox_boxes": """
WITH s AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_partkey + 1 AS w, l_suppkey * 9 + 1 AS h FROM lineitem),
a AS (SELECT *, w::DOUBLE / h AS aspect, w > 224 OR h > 224 AS shrink FROM s),
e AS (SELECT *, CASE WHEN aspect <= 1 THEN 224.0 * aspect ELSE 224.0 / aspect END AS exact FROM a),
f AS (SELECT *, floor(exact) AS lo, ceil(exact) AS hi FROM e),
m AS (SELECT *, CASE WHEN aspect <= 1 THEN abs(aspect - lo / 224.0) WHEN lo = 0 THEN 0 ELSE abs(aspect - 224.0 / lo) END AS mlo,
             CASE WHEN aspect <= 1 THEN abs(aspect - hi / 224.0) WHEN hi = 0 THEN 0 ELSE abs(aspect - 224.0 / hi) END AS mhi FROM f),
o AS (SELECT *, greatest(CASE WHEN mlo <= mhi THEN lo ELSE hi END, 1)::BIGINT AS other FROM m),
b AS (SELECT *, CASE WHEN NOT shrink THEN w WHEN aspect <= 1 THEN other ELSE 224 END AS width,
             CASE WHEN NOT shrink THEN h WHEN aspect <= 1 THEN 224 ELSE other END AS height FROM o)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, width, height,
       (224 - width) // 2 AS x_offset, (224 - height) // 2 AS y_offset
FROM b""",
    "letterbox_small": """
WITH g AS (SELECT vec_id, list_transform(embedding, lambda x:
             floor((greatest(least(x::DOUBLE, 1.0), -1.0) + 1) * 127)::BIGINT) AS p FROM embeddings)
SELECT vec_id, 432::BIGINT AS bytes, 0::BIGINT AS corner, p[1] AS first, p[64] AS last, 0::BIGINT AS far FROM g""",
    "search_forms": """
SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN '' ELSE o_orderpriority END AS species,
       CASE WHEN o_orderstatus <> 'P' THEN o_custkey::DOUBLE END AS latitude_min,
       CASE WHEN o_orderstatus <> 'P' AND o_orderpriority <> '1-URGENT' THEN 45.5::DOUBLE END AS latitude_max,
       CASE WHEN o_orderstatus <> 'P' THEN -70.0::DOUBLE END AS longitude_min,
       CASE WHEN o_orderstatus <> 'P' AND o_orderpriority <> '2-HIGH' THEN 0.0::DOUBLE END AS longitude_max
FROM orders""",
    "event_props": """
SELECT event_id, coalesce(props->>'$.species', '') AS species,
       TRY_CAST(nullif(props->>'$.location.latitudeMin', '') AS DOUBLE) AS latitude_min
FROM events""",
    "model_sizes": f"""
WITH m AS (SELECT p_partkey, p_size, [{', '.join(f"'{m}'" for m in _MODELS)}][(p_partkey % {len(_MODELS)} + 1)::INTEGER] AS model FROM part),
k(known, size) AS (VALUES {', '.join(f"('{n}', {s})" for n, s in models.IMAGE_MODEL_SIZES.items())}),
t(known, size) AS (VALUES {', '.join(f"('{n}', {s})" for n, s in models.TEXT_MODEL_SIZES.items())}),
i AS (SELECT p_partkey, arg_max(k.size, length(known)) AS size FROM m JOIN k ON contains(lower(model), known) GROUP BY p_partkey)
SELECT m.p_partkey, model,
       CASE WHEN p_size > 45 THEN p_size ELSE coalesce(i.size, {models.IMAGE_DEFAULT_SIZE}) END::BIGINT AS image_size,
       CASE WHEN p_size > 45 THEN p_size ELSE coalesce(t.size, {models.TEXT_DEFAULT_SIZE}) END::BIGINT AS text_size
FROM m LEFT JOIN i ON i.p_partkey = m.p_partkey LEFT JOIN t ON t.known = model""",
    "response_shape": """
SELECT conv_id, turn, CASE WHEN role = 'user' THEN length(text) ELSE 0 END AS text_length,
       CASE WHEN role = 'user' THEN 'role,turn' ELSE 'note,role,turn' END AS metadata_keys
FROM conversations""",
    "box_and_dates": """
SELECT o_orderkey, o_orderdate::DATE AS observed_on FROM orders
WHERE o_orderkey % 181 - 90 BETWEEN -30 AND 60 AND o_orderstatus <> 'P'
  AND (o_custkey % 361 - 180 >= 100 OR o_custkey % 361 - 180 <= -100)
  AND o_orderdate::DATE BETWEEN DATE '1993-01-01' AND DATE '1999-06-30' AND month(o_orderdate) IN (1, 2, 8)""",
    "retriable_events": """
SELECT event_id, CASE event_id % 7 WHEN 0 THEN TRUE WHEN 1 THEN TRUE WHEN 6 THEN TRUE
                                   WHEN 4 THEN user_id % 5 IN (0, 2) ELSE FALSE END AS retriable
FROM events""",
    "error_counts": """
SELECT CASE event_type WHEN 'error' THEN 'upstream' WHEN 'click' THEN 'circuit_breaker' ELSE 'other' END AS error_class,
       count(*) AS failures
FROM events GROUP BY 1""",
    "blank_turns": r"""
SELECT role, count(*) FILTER (WHERE role = 'assistant' OR regexp_replace(text, '\s', '', 'g') = '') AS blank, count(*) AS turns
FROM conversations GROUP BY role""",
    "taxon_suggestions": """
SELECT p_name AS name, p_partkey FROM part WHERE starts_with(lower(p_name), 'red') ORDER BY p_name, p_partkey LIMIT 20""",
    "taxon_labels": """
SELECT p_partkey, CASE WHEN p_size > 25 THEN p_type || ' (' || p_name || ')' ELSE p_name END AS label FROM part""",
}
