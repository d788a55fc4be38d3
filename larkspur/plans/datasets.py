"""Building image datasets, collections and document sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from larkspur.functions.images import detect_image_format
from larkspur.functions.links import photo_id_from_url
from larkspur.functions.text import clean_book_text
from larkspur.operators.chunking import explode_chunks
from larkspur.operators.collections import CollectionStore
from larkspur.operators.embedding import IMAGE_POLICY, EmbedderFactory, EmbedPolicy, embed_images
from larkspur.operators.relational import (
    cycle_documents, first_rows, image_dataset, image_points, latest_per_key, photo_metadata, row_tiebreak, running_total,
    valid_embeddings,
)
from larkspur.operators.sinks import write_dataset, write_documents
from larkspur.session import stage


#: Why a photo is not in a dataset.
NO_PICTURE, UNKNOWN_FORMAT = "no picture", "not a known image format"


def build_image_dataset(
    photos: DataFrame, observations: DataFrame, taxa: DataFrame, images: DataFrame,
    embedder: str | EmbedderFactory, host: str, path: str | None = None, limit: int | None = None,
    policy: EmbedPolicy = IMAGE_POLICY,
) -> DataFrame:
    """Join the tables, embed the picture bytes (``photo_id, content``) and lay out the dataset.

    Each picture is embedded once even when several observations show it. See ``image_dataset_and_failures`` for the
    photos that are missing from the result.
    """
    return image_dataset_and_failures(photos, observations, taxa, images, embedder, host, path, limit, policy)[0]


def image_dataset_and_failures(
    photos: DataFrame, observations: DataFrame, taxa: DataFrame, images: DataFrame,
    embedder: str | EmbedderFactory, host: str, path: str | None = None, limit: int | None = None,
    policy: EmbedPolicy = IMAGE_POLICY,
) -> tuple[DataFrame, DataFrame]:
    """The dataset, and ``photo_id, error_message, cause`` of the photos that are not in it.

    A photo fails where it has no picture or its picture could not be embedded; one row for each.
    """
    rows = photo_metadata(photos, observations, taxa)
    if limit is not None:
        rows = first_rows(rows, limit)
    ids = stage(rows.select("photo_id").distinct(), "photo-ids")
    wanted = images.join(ids, "photo_id", "left_semi")
    vectors = stage(embed_images(wanted, "content", embedder, policy=policy).drop("content"), "image-vectors")
    ready = rows.join(vectors.filter("success").select("photo_id", "vector"), "photo_id")
    dataset = image_dataset(ready, "vector", host)
    if path:
        write_dataset(dataset, path)
        dataset = dataset.sparkSession.read.schema(dataset.schema).parquet(path)
    # A photo may have several pictures, of which one that works is enough.
    by_photo = vectors.groupBy("photo_id").agg(
        F.bool_or("success").alias("success"), F.min("error_message").alias("error_message"), F.min("cause").alias("cause"))
    failures = ids.join(by_photo, "photo_id", "left").filter("success IS NULL OR NOT success").select(
        "photo_id", F.coalesce("error_message", F.lit(NO_PICTURE)).alias("error_message"), "cause")
    return dataset, failures


def build_collection(
    store: CollectionStore, name: str, embeddings: DataFrame, photos: DataFrame, observations: DataFrame,
    taxa: DataFrame, host: str, dim: int, metric: str = "cosine", n_buckets: int = 64,
) -> int:
    """Collection of photo points from embeddings and metadata; returns the number of points.

    A photo with several observations keeps the one with the highest
    observation id.
    """
    # One row per photo before the vectors come in, so that no vector is multiplied.
    about = photo_metadata(photos, observations, taxa)
    about = latest_per_key(about, ["photo_id"], [F.desc("observation_uuid"), row_tiebreak(about, ["photo_id"]).desc()])
    rows = about.join(_one_vector_each(valid_embeddings(embeddings).select("photo_id", "embedding")), "photo_id")
    points = image_points(rows, "embedding", host)
    return store.load(name, points, dim, metric, n_buckets, distinct_ids=True).written


def _one_vector_each(vectors: DataFrame) -> DataFrame:
    """One row for each photo: of a photo with several vectors the one with the greatest checksum.

    Photos are counted by id and checksum alone, so vectors pass through no window and no sort; those of photos that come
    once, which is most, stay as they are.
    """
    marked = vectors.withColumn("_mark", F.xxhash64("embedding"))
    repeated = marked.groupBy("photo_id").agg(F.count("*").alias("n"), F.max("_mark").alias("_best")).filter("n > 1")
    repeated = stage(repeated.select("photo_id", "_best"), "repeated-photos")
    single = marked.join(repeated, "photo_id", "left_anti")
    chosen = marked.join(repeated, "photo_id").filter(F.col("_mark") == F.col("_best"))
    one = chosen.groupBy("photo_id").agg(F.first("embedding").alias("embedding"))
    return single.select("photo_id", "embedding").unionByName(one)


def reembed_dataset(
    dataset: DataFrame, images: DataFrame, embedder: str | EmbedderFactory, path: str | None = None,
    policy: EmbedPolicy = IMAGE_POLICY,
) -> DataFrame:
    """``id, img_url, file_name, img_embedding`` of a dataset with new vectors; see ``reembedded_and_failures``."""
    return reembedded_and_failures(dataset, images, embedder, path, policy)[0]


def reembedded_and_failures(
    dataset: DataFrame, images: DataFrame, embedder: str | EmbedderFactory, path: str | None = None,
    policy: EmbedPolicy = IMAGE_POLICY,
) -> tuple[DataFrame, DataFrame]:
    """The dataset with new vectors, and ``img_url, error_message, cause`` of its rows that got none.

    ``images`` has ``img_url, content``. A row fails where there is no picture, where it is none of the known formats and
    where it could not be embedded.
    """
    rows = dataset.select("img_url", "file_name").join(images.select("img_url", "content", F.lit(True).alias("_there")), "img_url", "left")
    readable = detect_image_format(F.col("content")).isNotNull()
    # A picture of no known format is given to the embedder as missing, which it refuses without a call.
    rows = rows.withColumn("_known", F.coalesce(readable, F.lit(False))).withColumn("content", F.when(F.col("_known"), F.col("content")))
    embedded = stage(embed_images(rows, "content", embedder, out="img_embedding", policy=policy).drop("content"), "reembedded")
    out = embedded.filter("success AND _known").select(
        photo_id_from_url(F.col("img_url")).alias("id"), "img_url", "file_name", "img_embedding")
    said = F.when(F.col("_there").isNull(), F.lit(NO_PICTURE)).when(~F.col("_known"), F.lit(UNKNOWN_FORMAT)).otherwise(F.col("error_message"))
    failures = embedded.filter("NOT (success AND _known)").select(
        "img_url", said.alias("error_message"), F.when(F.col("_known"), F.col("cause")).alias("cause"))
    if path:
        write_dataset(out, path)
        out = out.sparkSession.read.schema(out.schema).parquet(path)
    return out, failures


def book_chunks(books: DataFrame, chunk_size: int = 500, compat: bool = False) -> DataFrame:
    """Chunks of cleaned books ``book, text`` with a dense number over all books in order.

    Only one row per book takes part in the numbering, not every chunk.
    """
    cleaned = books.select("book", clean_book_text(F.col("text")).alias("text"))
    chunks = stage(explode_chunks(cleaned, "text", chunk_size, compat), "chunks")
    sizes = chunks.groupBy("book").agg(F.count(F.lit(1)).alias("n"))
    offsets = running_total(sizes, "book", F.col("n"), "first").select("book", "first")
    return chunks.join(offsets, "book").select(
        (F.col("first") + F.col("chunk_no")).alias("chunk_no"), "book", "text")


def make_documents(
    books: DataFrame, n_documents: int, chunk_size: int = 500, compat: bool = False, path: str | None = None,
) -> DataFrame:
    """``n_documents`` documents cut from books, going round the chunks as often as needed."""
    documents = cycle_documents(book_chunks(books, chunk_size, compat), n_documents)
    if path:
        write_documents(documents, path)
        return documents.sparkSession.read.schema(documents.schema).parquet(path)
    return documents
