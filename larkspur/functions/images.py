"""Checks and header fields of encoded images held in binary columns."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

MIN_IMAGE_BYTES = 100
MAX_IMAGE_BYTES = 50 * 1024 * 1024

# Signatures of the supported formats.
JPEG_START = bytes.fromhex("FFD8FF")
PNG_START = bytes.fromhex("89504E470D0A1A0A")
GIF_STARTS = (b"GIF87a", b"GIF89a")

# MIME type by format name.
MIME_TYPES = {"jpeg": "image/jpeg", "png": "image/png", "webp": "image/webp", "gif": "image/gif"}


def _bytes(raw: bytes) -> Column:
    return F.lit(bytearray(raw))


def _starts(content: Column, raw: bytes) -> Column:
    return F.startswith(content, _bytes(raw))


def detect_image_format(content: Column) -> Column:
    """``jpeg``, ``png``, ``gif``, ``webp`` or null by the leading bytes (12 at least)."""
    tag = F.substring(content, 9, 4)
    return F.when(F.length(content) >= 12, (
        F.when(_starts(content, JPEG_START), "jpeg")
        .when(_starts(content, PNG_START), "png")
        .when(_starts(content, GIF_STARTS[0]) | _starts(content, GIF_STARTS[1]), "gif")
        .when(_starts(content, b"RIFF") & (tag == _bytes(b"WEBP")), "webp")
    ))


def mime_type(image_format: Column) -> Column:
    chain = F.when(F.lit(False), F.lit(""))
    for name, mime in MIME_TYPES.items():
        chain = chain.when(image_format == name, F.lit(mime))
    return chain.otherwise(F.lit("application/octet-stream"))


def lenient_mime_type(content: Column) -> Column:
    """MIME type by a shorter signature test, ``image/png`` when nothing fits."""
    head = F.hex(F.substring(content, 1, 12))
    # An even offset keeps the match on whole bytes.
    webp_inside = F.rlike(head, F.lit("^(?:..)*57454250"))
    return (
        F.when(_starts(content, PNG_START[:4]), MIME_TYPES["png"])
        .when(_starts(content, JPEG_START), MIME_TYPES["jpeg"])
        .when(_starts(content, GIF_STARTS[0]) | _starts(content, GIF_STARTS[1]), MIME_TYPES["gif"])
        .when(_starts(content, b"RIFF") & webp_inside, MIME_TYPES["webp"])
        .otherwise(MIME_TYPES["png"])
    )


def base64_text(content: Column) -> Column:
    """Base64 without line breaks; empty content is null (see ``encode_error``)."""
    return F.when(F.length(content) > 0, F.regexp_replace(F.base64(content), "[\r\n]", ""))


def data_url(content: Column) -> Column:
    return F.concat(F.lit("data:"), lenient_mime_type(content), F.lit(";base64,"), base64_text(content))


def encode_error(content: Column) -> Column:
    return F.when(content.isNull() | (F.length(content) == 0), F.lit("Image bytes cannot be empty"))


def image_error(content: Column, min_bytes: int = MIN_IMAGE_BYTES, max_bytes: int = MAX_IMAGE_BYTES) -> Column:
    """Reason to reject the image, null when it is acceptable; limits are inclusive."""
    size = F.length(content)
    text = size.cast("string")
    return (
        F.when(size < min_bytes, F.concat(F.lit("only "), text, F.lit(f" bytes, at least {min_bytes} wanted")))
        .when(size > max_bytes, F.concat(text, F.lit(f" bytes, at most {max_bytes} allowed")))
        .when(detect_image_format(content).isNull(), F.lit("not a known image format"))
    )


def _number(content: Column, offset: int, length: int, little: bool = False) -> Column:
    """Unsigned number stored at a byte offset, null where the bytes end before."""
    piece = F.substring(content, offset + 1, length)
    if not little:
        return F.when(F.length(piece) == length, F.conv(F.hex(piece), 16, 10).cast("bigint"))
    total = F.lit(0).cast("bigint")
    for i in range(length):
        byte = F.conv(F.hex(F.substring(content, offset + 1 + i, 1)), 16, 10).cast("bigint")
        total = total + byte * F.lit(1 << (8 * i)).cast("bigint")
    return F.when(F.length(piece) == length, total)


_SIZE = T.StructType([T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType())])


def _jpeg_frame_size(raw: bytes | None) -> tuple[int | None, int | None]:
    """Width and height from the first start-of-frame segment."""
    if not raw:
        return None, None
    pos, end = 2, len(raw)
    while pos + 9 <= end:
        if raw[pos] != 0xFF:
            return None, None
        marker = raw[pos + 1]
        if marker == 0xFF:  # fill byte
            pos += 1
        elif marker == 0x01 or 0xD0 <= marker <= 0xD8:  # segments without a length
            pos += 2
        elif 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            return int.from_bytes(raw[pos + 7:pos + 9], "big"), int.from_bytes(raw[pos + 5:pos + 7], "big")
        elif marker in (0xD9, 0xDA):  # end of image, start of scan
            return None, None
        else:
            pos += 2 + int.from_bytes(raw[pos + 2:pos + 4], "big")
    return None, None


@F.pandas_udf(_SIZE)
def _jpeg_size(content: pd.Series) -> pd.DataFrame:
    sizes = [_jpeg_frame_size(raw) for raw in content]
    return pd.DataFrame(sizes, columns=["width", "height"], dtype="Int32")


def image_dimensions(content: Column) -> Column:
    """``struct(width, height)`` from the header; nulls when it cannot be read.

    PNG, GIF and WebP keep their size at fixed offsets and are read by plain
    expressions; only JPEG bytes are sent to Python, because their size sits
    behind a chain of variable-length segments.
    """
    fmt = detect_image_format(content)
    jpeg = _jpeg_size(F.when(fmt == "jpeg", content))
    chunk = F.substring(content, 13, 4)
    lossy, lossless, extended = (chunk == _bytes(t) for t in (b"VP8 ", b"VP8L", b"VP8X"))
    packed = _number(content, 21, 4, little=True).cast("bigint")
    width = (
        F.when(fmt == "png", _number(content, 16, 4))
        .when(fmt == "gif", _number(content, 6, 2, little=True))
        .when((fmt == "webp") & lossy, _number(content, 26, 2, little=True).bitwiseAND(0x3FFF))
        .when((fmt == "webp") & lossless, packed.bitwiseAND(F.lit(0x3FFF)).cast("int") + 1)
        .when((fmt == "webp") & extended, _number(content, 24, 3, little=True) + 1)
        .when(fmt == "jpeg", jpeg["width"])
    )
    height = (
        F.when(fmt == "png", _number(content, 20, 4))
        .when(fmt == "gif", _number(content, 8, 2, little=True))
        .when((fmt == "webp") & lossy, _number(content, 28, 2, little=True).bitwiseAND(0x3FFF))
        .when((fmt == "webp") & lossless, F.shiftright(packed, 14).bitwiseAND(F.lit(0x3FFF)).cast("int") + 1)
        .when((fmt == "webp") & extended, _number(content, 27, 3, little=True) + 1)
        .when(fmt == "jpeg", jpeg["height"])
    )
    sizes = {"width": width, "height": height}
    # A damaged header can name a size that no image has.
    return F.struct(*(F.when(v.between(0, 2**31 - 1), v.cast("int")).alias(n) for n, v in sizes.items()))


def _fit_other_side(aspect: Column, max_size: int, wide: bool) -> Column:
    """Shorter side of a picture whose longer side becomes ``max_size``.

    Of the two whole numbers around the exact size, the one that keeps the
    aspect ratio better is taken, at least 1.
    """
    exact = F.lit(float(max_size)) / aspect if wide else F.lit(float(max_size)) * aspect
    low, high = F.floor(exact), F.ceil(exact)

    def miss(n: Column) -> Column:
        ratio = F.lit(float(max_size)) / n if wide else n / F.lit(float(max_size))
        return F.when(n == 0, F.lit(0.0) if wide else aspect).otherwise(F.abs(aspect - ratio))

    return F.greatest(F.when(miss(low) <= miss(high), low).otherwise(high), F.lit(1)).cast("int")


def letterbox_geometry(width: Column, height: Column, max_size: int = 224) -> Column:
    """``struct(width, height, x_offset, y_offset)`` of a picture fitted into a square.

    Larger pictures shrink to the square, smaller ones keep their size; both
    are centred with offsets rounded down.
    """
    aspect = width / height
    shrink = (width > max_size) | (height > max_size)
    tall_or_square = aspect <= 1
    w = F.when(~shrink, width).when(tall_or_square, _fit_other_side(aspect, max_size, wide=False)).otherwise(max_size)
    h = F.when(~shrink, height).when(tall_or_square, F.lit(max_size)).otherwise(
        _fit_other_side(aspect, max_size, wide=True))
    return F.struct(
        w.cast("int").alias("width"),
        h.cast("int").alias("height"),
        F.floor((F.lit(max_size) - w) / 2).cast("int").alias("x_offset"),
        F.floor((F.lit(max_size) - h) / 2).cast("int").alias("y_offset"),
    )
