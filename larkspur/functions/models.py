"""Vector size of an embedding model by name."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Vector sizes of image models.
IMAGE_MODEL_SIZES = {
    "llava": 4096,
    "llava:7b": 4096,
    "llava:13b": 5120,
    "llava:34b": 8192,
    "bakllava": 4096,
    "clip-vit-base-patch32": 512,
    "clip-vit-base-patch16": 512,
    "clip-vit-large-patch14": 768,
    "openclip-vit-h-14": 1024,
}
IMAGE_DEFAULT_SIZE = 512

# Vector sizes of text models.
TEXT_MODEL_SIZES = {
    "nomic-embed-text": 768,
    "nomic-embed-text-v1.5": 768,
    "all-minilm": 384,
    "all-minilm:l6-v2": 384,
    "all-minilm:l12-v2": 384,
    "mxbai-embed-large": 1024,
    "snowflake-arctic-embed": 1024,
    "snowflake-arctic-embed:s": 384,
    "snowflake-arctic-embed:m": 768,
    "snowflake-arctic-embed:l": 1024,
    "embeddinggemma": 768,
    "embeddinggemma:2b": 768,
    "qwen3-embedding": 1024,
    "qwen3-embedding:0.6b": 1024,
    "qwen3-embedding:4b": 1024,
    "qwen3-embedding:8b": 1024,
}
TEXT_DEFAULT_SIZE = 768


def image_model_size(model: Column, override: Column | None = None) -> Column:
    """Size of the longest known name contained in the model name, ignoring case.

    A known name contains itself, so an exact match is the longest one.
    """
    lowered = F.lower(model)
    by_length = sorted(IMAGE_MODEL_SIZES, key=len, reverse=True)
    hits = [F.when(F.contains(lowered, F.lit(n)), F.lit(IMAGE_MODEL_SIZES[n])) for n in by_length]
    return F.coalesce(*([override.cast("int")] if override is not None else []), *hits, F.lit(IMAGE_DEFAULT_SIZE))


def text_model_size(model: Column, override: Column | None = None) -> Column:
    """Size by exact name, 768 when unknown."""
    hits = [F.when(model == name, F.lit(size)) for name, size in TEXT_MODEL_SIZES.items()]
    return F.coalesce(*([override.cast("int")] if override is not None else []), *hits, F.lit(TEXT_DEFAULT_SIZE))
