"""Objects, chunking, document sets and embeddings of texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspur.catalog.tables import embed_sql, table
from larkspur.functions.text import clean_book_text
from larkspur.operators.chunking import SENTENCE_END, explode_chunks, register_chunks
from larkspur.operators.embedding import EmbedPolicy, embed_column, embed_image_text, embed_images
from larkspur.plans.datasets import make_documents
from larkspur.session import scratch_path
from larkspur.sources.objects import decode_text, list_objects, read_text_objects
from larkspur.sources.tables import query_lines


def text_objects(spark, sf_dir):
    """Documents written as text objects, one folder per language and source, then listed and read back."""
    path = scratch_path(spark, "objects")
    table(spark, sf_dir, "documents").select("lang", "source", "text").write.partitionBy("lang", "source").text(path)
    listed = list_objects(spark, path, prefix="lang=").select("key", "length")
    read = read_text_objects(spark, path, glob="*.txt").filter("success").join(listed, "key")
    parts = F.split("key", "[=/]")
    return read.groupBy(parts[1].alias("lang"), parts[3].alias("source")).agg(
        F.sum("length").alias("bytes"), F.sum(F.length("text")).alias("chars"))


def decoded_objects(spark, sf_dir):
    """Documents as bytes; Spanish ones are cut short by a broken character."""
    broken = F.when(F.col("lang") == "es", F.unhex(F.lit("C3"))).otherwise(F.unhex(F.lit("")))
    rows = table(spark, sf_dir, "documents").select(
        F.concat(F.lit("inputs/doc-"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("key"),
        F.concat(F.encode("text", "UTF-8"), broken).alias("content"))
    return decode_text(rows).select("key", "success", "error_message", F.length("text").cast("bigint").alias("n_chars"))


def benchmark_lines(spark, sf_dir):
    files = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("value"))
    return query_lines(files, keep=["item_id"])


def _chunks(compat):
    def run(spark, sf_dir):
        rows = explode_chunks(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", 500, compat)
        return rows.select("doc_id", *[F.col(c).cast("bigint").alias(c) for c in ("chunk_no", "start", "end")],
                           F.md5(F.col("text").cast("binary")).alias("text_md5"))

    return run


def chunk_table_function(spark, sf_dir):
    """The same chunks through the SQL table function."""
    register_chunks(spark)
    rows = spark.sql(
        "SELECT d.doc_id, c.chunk_no, c.text FROM {documents} d, LATERAL chunks(d.text, 500) c",
        documents=table(spark, sf_dir, "documents"))
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunks"), F.sum(F.length("text")).alias("chars"))


def _books(spark, sf_dir):
    """Documents wrapped like plain-text books, in five ways."""
    start = F.get(F.array(*[F.lit(s) for s in (
        "Front matter\n\nChapter  1\n", "chapter I. ", "Contents: chapter 1\nCHAPTER\nI\n\n\n\n", "chapter 12\n", "")]),
        F.pmod("doc_id", F.lit(5)).cast("int"))
    end = F.get(F.array(*[F.lit(s) for s in (
        "\n\n\n\nEnd of the Project Gutenberg EBook\nlicence", "\n  END OF PROJECT GUTENBERG", "\n\n\n", "end of project gutenberg", " ")]),
        F.pmod("doc_id", F.lit(5)).cast("int"))
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("book"), F.concat(start, F.col("text"), end).alias("text"))


def cleaned_books(spark, sf_dir):
    text = clean_book_text(F.col("text"))
    return _books(spark, sf_dir).select("book", F.length(text).cast("bigint").alias("n_chars"), F.md5(text.cast("binary")).alias("text_md5"))


def made_documents(spark, sf_dir):
    """Ten documents for every book, going round the chunks."""
    books = _books(spark, sf_dir)
    documents = make_documents(books, 10 * books.count(), compat=True, path=scratch_path(spark, "documents"))
    return documents.select("document_no", "name", F.md5(F.col("text").cast("binary")).alias("text_md5"))


def embedded_turns(spark, sf_dir):
    """Vectors of conversation turns; texts of system turns are blanked and fail."""
    text = F.when(F.col("role") == "system", F.lit(" \n ")).otherwise(F.col("text"))
    turns = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), text.alias("text"))
    rows = embed_column(turns, "text", "hashing")
    at = lambda i: F.round(F.coalesce(F.get("vector", F.lit(i)).cast("double"), F.lit(0.0)), 5)
    return rows.select("id", "success", "error_message", at(0).alias("x0"), at(17).alias("x17"), at(63).alias("x63"))


class FailsOnLongText:
    """Embedding function that refuses a batch with a text of more than ``limit`` characters."""

    def __init__(self, limit: int):
        self.limit = limit

    def __call__(self):
        def embed(texts):
            if any(len(t) > self.limit for t in texts):
                raise RuntimeError("upstream refused a long text")
            return [[float(len(t)), 1.0] for t in texts]

        return embed


def embedded_with_fallback(spark, sf_dir):
    """A refused batch is repeated text by text, so only the long texts fail."""
    policy = EmbedPolicy(batch_size=4, max_batch=12, adaptive=True, fallback_individual=True)
    rows = embed_column(table(spark, sf_dir, "documents"), "text", FailsOnLongText(3000), policy=policy)
    return rows.select("doc_id", "success", "error_message", "cause", F.get("vector", F.lit(0)).cast("double").alias("length"))


class PairLengths:
    """Lengths of the picture and of its text as a vector."""

    def __call__(self):
        return lambda images, texts: [[float(len(i)), float(len(t or ""))] for i, t in zip(images, texts)]


def embedded_pairs(spark, sf_dir):
    """Picture and text of one row; pages stand for pictures, Spanish pages are empty."""
    pages = table(spark, sf_dir, "pages").select(
        "page_id", "url", F.when(F.contains("url", F.lit("/es/")), F.unhex(F.lit(""))).otherwise(F.encode("html", "UTF-8")).alias("content"))
    rows = embed_image_text(pages, "content", "url", PairLengths())
    return rows.select("page_id", "success", "error_message", F.get("vector", F.lit(0)).cast("double").alias("bytes"),
                       F.get("vector", F.lit(1)).cast("double").alias("chars"))


def embedded_pictures(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", F.encode("url", "UTF-8").alias("content"))
    rows = embed_images(pages, "content", "byte_histogram")
    return rows.select("page_id", "success", F.round(F.get("vector", F.lit(ord("/") >> 2)).cast("double"), 5).alias("slash_group"))


QUERIES = {
    "text_objects": text_objects,
    "decoded_objects": decoded_objects,
    "benchmark_lines": benchmark_lines,
    "document_chunks": _chunks(False),
    "document_chunks_compat": _chunks(True),
    "chunk_table_function": chunk_table_function,
    "cleaned_books": cleaned_books,
    "made_documents": made_documents,
    "embedded_turns": embedded_turns,
    "embedded_with_fallback": embedded_with_fallback,
    "embedded_pairs": embedded_pairs,
    "embedded_pictures": embedded_pictures,
}

_WHITE = "chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ' || chr(133) || chr(160) || chr(8232)"


def _chunk_sql(source: str, compat: bool) -> str:
    """Recursive chunks ``(key, no, s, e, piece)`` of ``source(key, text)``."""
    if compat:
        found = rf"regexp_extract(w, '^((?s:.*?)(?:{SENTENCE_END}))', 1)"
    else:
        found = r"regexp_extract(w, '^((?s:.*?)[.!?])(?:\s+[A-Z]|\n)', 1)"

    def step(start: str) -> str:
        return f"""SELECT key, s, CASE WHEN s + 500 >= n THEN n WHEN {found} = '' THEN s + 500
                     ELSE s + 400 + length({found}) END AS e
              FROM (SELECT key, n, {start} AS s, substr(text, {start} + 401, 100) AS w FROM {{}})"""

    return f"""
t AS (SELECT key, text, length(text) AS n FROM {source}),
c(key, s, e) AS ({step('0::BIGINT').format("t WHERE n > 0")}
  UNION ALL {step('e').format("(SELECT c.key, e, n, text FROM c JOIN t ON t.key = c.key WHERE e < n)")}),
p AS (SELECT c.key, s, e, trim(substr(text, s + 1, e - s), {_WHITE}) AS piece FROM c JOIN t ON t.key = c.key),
chunks AS (SELECT key, row_number() OVER (PARTITION BY key ORDER BY s) - 1 AS no, s, e, piece FROM p WHERE piece <> '')"""


def _document_chunks_sql(compat: bool) -> str:
    return (f"WITH RECURSIVE src AS (SELECT doc_id AS key, text FROM documents), {_chunk_sql('src', compat)} "
            "SELECT key AS doc_id, no AS chunk_no, s AS start, e AS \"end\", md5(piece) AS text_md5 FROM chunks")


_BOOKS_SQL = r"""
books AS (SELECT doc_id AS book,
  [E'Front matter\n\nChapter  1\n', 'chapter I. ', E'Contents: chapter 1\nCHAPTER\nI\n\n\n\n', E'chapter 12\n', ''][(doc_id % 5 + 1)::INTEGER]
  || text ||
  [E'\n\n\n\nEnd of the Project Gutenberg EBook\nlicence', E'\n  END OF PROJECT GUTENBERG', E'\n\n\n', 'end of project gutenberg', ' '][(doc_id % 5 + 1)::INTEGER] AS text
  FROM documents),
started AS (SELECT book, regexp_replace(text, '(?is)^.*?((?:^|\n)(?:chapter\s+1|chapter\s+i)\b)', '\1') AS text FROM books),
ended AS (SELECT book, regexp_replace(text, '(?is)\n\s*end\s+of\s+(?:the\s+)?project\s+gutenberg.*$', '') AS text FROM started),
cleaned AS (SELECT book, trim(regexp_replace(text, '\n{3,}', E'\n\n', 'g'), """ + _WHITE + """) AS text FROM ended)"""

ORACLES = {
    "text_objects": """
SELECT lang, source, sum(octet_length(encode(text)) + 1)::BIGINT AS bytes, sum(length(text) + 1)::BIGINT AS chars
FROM documents GROUP BY lang, source""",
    "decoded_objects": """
SELECT 'inputs/doc-' || doc_id || '.txt' AS key, lang <> 'es' AS success,
       CASE WHEN lang = 'es' THEN 'Failed to fetch or decode content' END AS error_message,
       CASE WHEN lang <> 'es' THEN length(text) END AS n_chars
FROM documents""",
    "benchmark_lines": f"""
SELECT item_id, query_id, query FROM (
  SELECT item_id, generate_subscripts(l, 1) - 1 AS query_id, trim(unnest(l), {_WHITE}) AS query
  FROM (SELECT item_id, string_split_regex(text, '\\r\\n|\\n|\\r') AS l FROM benchmark))
WHERE query <> ''""",
    "document_chunks": _document_chunks_sql(False),
    "document_chunks_compat": _document_chunks_sql(True),
    "chunk_table_function": (
        f"WITH RECURSIVE src AS (SELECT doc_id AS key, text FROM documents), {_chunk_sql('src', False)} "
        "SELECT key AS doc_id, count(*) AS chunks, sum(length(piece))::BIGINT AS chars FROM chunks GROUP BY key"),
    "cleaned_books": f"WITH {_BOOKS_SQL} SELECT book, length(text) AS n_chars, md5(text) AS text_md5 FROM cleaned",
    "made_documents": f"""
WITH RECURSIVE {_BOOKS_SQL}, src AS (SELECT book AS key, text FROM cleaned), {_chunk_sql('src', True)},
numbered AS (SELECT row_number() OVER (ORDER BY key, no) - 1 AS chunk_no, piece FROM chunks),
total AS (SELECT count(*) AS n FROM numbered),
wanted AS (SELECT unnest(range(0, (SELECT 10 * count(*) FROM documents))) AS document_no)
SELECT document_no, format('doc-{{:05d}}.txt', document_no) AS name, md5(piece) AS text_md5
FROM wanted, total JOIN numbered ON chunk_no = document_no % n""",
    "embedded_turns": f"""
WITH src AS (SELECT conv_id * 1000 + turn AS id, text FROM conversations WHERE role <> 'system'
             AND regexp_replace(text, '\\s', '', 'g') <> ''),
v AS {embed_sql('src', 'id', 'text')}
SELECT c.conv_id * 1000 + c.turn AS id, v.id IS NOT NULL AS success,
       CASE WHEN v.id IS NULL THEN 'Text cannot be empty' END AS error_message,
       round(coalesce(v[1], 0.0), 5) AS x0, round(coalesce(v[18], 0.0), 5) AS x17, round(coalesce(v[64], 0.0), 5) AS x63
FROM conversations c LEFT JOIN v ON v.id = c.conv_id * 1000 + c.turn""",
    "embedded_with_fallback": """
SELECT doc_id, length(text) <= 3000 AS success, CASE WHEN length(text) > 3000 THEN 'Embedding failed' END AS error_message,
       CASE WHEN length(text) > 3000 THEN 'RuntimeError: upstream refused a long text' END AS cause,
       CASE WHEN length(text) <= 3000 THEN length(text)::DOUBLE END AS length
FROM documents""",
    "embedded_pairs": """
SELECT page_id, NOT contains(url, '/es/') AS success,
       CASE WHEN contains(url, '/es/') THEN 'Image bytes cannot be empty' END AS error_message,
       CASE WHEN NOT contains(url, '/es/') THEN octet_length(encode(html))::DOUBLE END AS bytes,
       CASE WHEN NOT contains(url, '/es/') THEN length(url)::DOUBLE END AS chars
FROM pages""",
    "embedded_pictures": """
WITH b AS (SELECT page_id, ascii(unnest(string_split(url, ''))) // 4 AS g FROM pages),
n AS (SELECT page_id, g, count(*) AS n FROM b GROUP BY ALL)
SELECT page_id, TRUE AS success, round((coalesce(max(n) FILTER (WHERE g = 11), 0) / sqrt(sum(n * n)))::FLOAT::DOUBLE, 5) AS slash_group
FROM n GROUP BY page_id""",
}
