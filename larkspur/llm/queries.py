"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from larkspur.llm.conversation_repair import repair_conversations
from larkspur.llm.inputs import table
from larkspur.llm.language import fit_network, predict_language
from larkspur.llm.ngram_join import ngram_join
from larkspur.llm.packing import best_fit_packing, token_pieces
from larkspur.llm.periodic_runs import find_runs
from larkspur.llm.pieces import decode_pieces, encode_pieces
from larkspur.llm.secret_spans import ADDED, KINDS, find_secrets, fit_field, listed
from larkspur.llm.sharding import shard_rows
from larkspur.llm.syncmers import aligned, anchors, digest, likeness, shared_shift, with_next
from larkspur.llm.token_files import read_documents, write_token_files
from larkspur.llm.toxicity import fit_chain, predict_categories
from larkspur.llm.vector_neighbours import near_vectors
from larkspur.llm.warc import read_archives, write_archives

#: Probability that a merge is skipped, and the seed of its draws.
DROPOUT, SEED = 0.1, 0
#: The end-of-document id and length of packed sequences.
END_ID, CAPACITY = 2, 1024
#: Shards of equal weight.
SHARDS = 40
#: Categories in the order of the chain, and the probability from which a document is toxic.
CATEGORIES, TOXIC_FROM = ("low_quality", "toxic"), 0.3


def scored_toxicity(docs: DataFrame, sf_dir: str) -> DataFrame:
    """``docs`` with the probabilities of the chain fitted on the labels table."""
    labels = table(docs.sparkSession, sf_dir, "labels").select(
        "doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic")
    return predict_categories(docs, fit_chain(docs, labels, CATEGORIES))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probabilities of the categories for every document, and whether it is toxic."""
    scored = scored_toxicity(table(spark, sf_dir, "documents").select("doc_id", "text"), sf_dir)
    return scored.select("doc_id", *(f"p_{c}" for c in CATEGORIES), (F.col("p_toxic") >= TOXIC_FROM).alias("toxic"))


def op2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded with merge-dropout and decoded again."""
    model = public_tokenizers.path("piece_bpe_32k.model")
    encoded = encode_pieces(table(spark, sf_dir, "documents").select("doc_id", "text"), model, DROPOUT, SEED)
    decoded = decode_pieces(encoded, model)
    return decoded.select(
        "doc_id", F.coalesce(F.size("ids"), F.lit(0)).cast("bigint").alias("n_pieces"), F.xxhash64("ids").alias("ids_hash"),
        F.sha2("decoded", 256).alias("decoded_sha256"), F.col("text").eqNullSafe(F.col("decoded")).alias("lossless"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as WARC records and read back."""
    archives = write_archives(table(spark, sf_dir, "pages"))
    records = read_archives(archives, with_payload=False)

    def number(column: str):
        return F.regexp_extract(column, "^urn:record:(-?[0-9]+)$", 1).try_cast("bigint")

    return records.select(
        number("record_id").alias("page_id"), F.col("payload_length").alias("payload_bytes"), "payload_digest",
        "record_type", number("refers_to").alias("refers_to"), "verified")


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose five-word shingle sets have a Jaccard similarity of 0.75 or more."""
    joined = ngram_join(table(spark, sf_dir, "documents"), "doc_id", "text", 5, (75, 100))
    return joined.select(F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents dealt to 40 shards by rendezvous hashing of their id."""
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("bigint").alias("size"),
        F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"))
    sharded = shard_rows(docs, "doc_id", [1.0] * SHARDS, content="text_crc32")
    return sharded.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from four fifths of the labelled ones."""
    held_out = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(5)) == 0
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", held_out.alias("held_out"))
    network = fit_network(docs.where(~F.col("held_out")))
    return predict_language(docs.select("doc_id", "held_out", "text"), network).drop("text")


def packed_documents(docs: DataFrame) -> DataFrame:
    """Pieces of at most 1024 tokens with their places in sequences of 1024."""
    pieces = token_pieces(docs, public_tokenizers.path("byte_bpe_50k.json"), END_ID, CAPACITY, content="crc32")
    packed = best_fit_packing(pieces, CAPACITY)
    return packed.select(
        F.col("id").alias("doc_id"), "piece", "start", "length", F.col("crc32").alias("ids_crc32"), "sequence_id", "offset")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents cut into pieces of at most 1024 tokens and packed into sequences of 1024."""
    return packed_documents(table(spark, sf_dir, "documents"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document: counts and digest of the base spans, and all spans."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_secrets(docs, fit_field(docs), field_column="by_field").select("doc_id", "spans", "by_field")
    base = F.filter("spans", lambda s: s["kind"] != ADDED)

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    counts = map(count, KINDS)
    return found.select(
        "doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"),
        listed(F.col("by_field")).alias("field_spans"))


def op9_vector_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of embeddings whose cosine is 0.9 or more."""
    found = near_vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 0.9)
    return found.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), "kept")


def op10_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of documents, of their edited texts, and how alike those and the next document's are."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    n = F.char_length("text")
    kept, taken = n - F.expr("char_length(text) div 3"), F.expr("char_length(text) div 3")
    docs = with_next(docs, anchors=anchors)
    edited = docs.select(
        "id", n.cast("bigint").alias("n_chars"), "anchors", "next_anchors",
        F.concat(F.left("text", kept), F.left("next_text", taken)).alias("edited"))
    own, following, changed = F.col("anchors"), F.col("next_anchors"), F.col("edited_anchors")
    printed = edited.select(
        "id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "anchors", "next_anchors",
        anchors(F.col("edited")).alias("edited_anchors"))
    # An edit of the end leaves places as they are; the next document may hold a passage elsewhere.
    moved = printed.withColumn("shift_next", shared_shift(own, following))
    shared = moved.select("*", aligned(own, changed, F.lit(0)).alias("shared_edited"),
                          aligned(own, following, F.col("shift_next")).alias("shared_next"))
    return shared.select(
        F.col("id").alias("doc_id"), "n_chars", "edited_sha256", digest(F.col("anchors.hash")).alias("fingerprint"),
        digest(F.col("edited_anchors.hash")).alias("edited_fingerprint"),
        likeness(own, changed, F.col("shared_edited")).alias("near_edited"),
        likeness(own, following, F.col("shared_next")).alias("near_next"),
        F.col("shared_edited").cast("bigint").alias("shared_edited"), F.col("shared_next").cast("bigint").alias("shared_next"),
        F.col("shift_next").cast("bigint").alias("shift_next"))


def damaged_conversations(turns: DataFrame) -> DataFrame:
    """Rows of conversations with faults put in by a checksum of conversation and turn; ``present`` is false for those dropped."""
    def filled(name: str):
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    rows = turns.select("conv_id", "turn", filled("role").alias("role"), filled("text").alias("text"),
                        (F.crc32(F.concat(filled("conv_id"), F.lit(":"), filled("turn"))) % 20).alias("damage"))
    text = F.when(F.col("damage") == 1, F.lit("")).when(F.col("damage") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("damage") == 4, F.lit("user")).otherwise(F.col("role"))
    times = F.when(F.col("damage") == 3, F.expr("array(0, 1)")).otherwise(F.expr("array(0)"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("damage") != 0).alias("present"),
                       F.explode(times).alias("copy")).drop("copy")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults of damaged conversations and their cheapest repair."""
    damaged = damaged_conversations(table(spark, sf_dir, "conversations"))
    found = repair_conversations(damaged, present_column="present").conversations()
    return found.withColumnsRenamed({"conv": "conv_id", "sha256": "repaired_sha256"})


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all documents written to files of directly addressable codes and read back."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    files = write_token_files(docs, public_tokenizers.path("word_bpe_49k.json"), END_ID)
    read = read_documents(files, docs.schema["doc_id"].dataType.simpleString(), content="crc32")
    return read.select(F.col("id").alias("doc_id"), "start", "n_tokens", F.col("crc32").alias("ids_crc32"))


def periodic_documents(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text``, where the words of one document in ten repeat from some place on."""
    rows = docs.select("doc_id", "text", F.crc32(F.col("doc_id").cast("string")).alias("h"), F.expr(
        r"CASE WHEN crc32(CAST(doc_id AS STRING)) % 10 = 0 THEN regexp_extract_all(text, r'[^\x20\x09-\x0D]+', 0) END").alias("w"))
    rows = rows.selectExpr("doc_id", "text", "w", "size(w) AS n", "h div 10 AS g").selectExpr(
        "*", "CASE WHEN n > 0 THEN CAST(g % n AS INT) END AS a").selectExpr(
        "*", "CAST(1 + (n - a) div (3 + g % 8) AS INT) AS p")
    repeated = F.expr("slice(flatten(array_repeat(slice(w, a + 1, p), CAST((n - a + p - 1) div p AS INT))), 1, n - a)")
    made = F.concat_ws(" ", F.expr("slice(w, 1, a)"), repeated)
    return rows.select("doc_id", F.when(F.col("a").isNotNull(), made).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of periodic words in every document, and its text without repetitions."""
    docs = periodic_documents(table(spark, sf_dir, "documents"))
    found = find_runs(docs).select("doc_id", "runs", "collapsed", F.array_min(F.transform("runs", lambda r: F.struct(
        (-r["length"]).alias("longest"), r["start"].alias("start"), r["period"].alias("period")))).alias("best"))
    line = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    length = -F.col("best.longest")
    return found.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), F.col("best.start").alias("start"), length.alias("length"),
        F.col("best.period").alias("period"), F.expr("1000 * -best.longest div best.period").alias("exponent_milli"),
        F.sha2(F.concat_ws("", F.transform(line, lambda x: F.concat(x, F.lit("\n")))), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"))


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_pieces": op2_pieces,
    "op3_warc": op3_warc,
    "op4_ngram_join": op4_ngram_join,
    "op5_sharding": op5_sharding,
    "op6_language": op6_language,
    "op7_packing": op7_packing,
    "op8_secrets": op8_secrets,
    "op9_vector_neighbours": op9_vector_neighbours,
    "op10_syncmers": op10_syncmers,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_token_files": op12_token_files,
    "op13_periodic_runs": op13_periodic_runs,
}

_SHINGLES = r"""
words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w
  FROM {docs}),
shingles AS (
  SELECT DISTINCT doc_id, list_aggregate(w[i:i + least(5, len(w)) - 1], 'string_agg', ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
links AS (
  SELECT x.doc_id AS a, y.doc_id AS b
  FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id <> y.doc_id
       JOIN sizes m ON m.doc_id = x.doc_id JOIN sizes n ON n.doc_id = y.doc_id
  GROUP BY x.doc_id, y.doc_id, m.n, n.n HAVING 100 * count(*) >= 75 * (m.n + n.n - count(*))),
reach AS (
  SELECT doc_id AS id, doc_id AS other FROM {docs}
  UNION
  SELECT reach.id, links.b FROM reach JOIN links ON links.a = reach.other)"""

# Backwards over the rows of a conversation for costs, then forwards along the least edit of a cheapest way.
_REPAIR = r"""WITH RECURSIVE
keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k
  FROM conversations),
summed AS (
  SELECT *, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(k, ''), lambda x: ascii(x)::BIGINT)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]),
      lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 20 AS damage
  FROM keyed),
damaged AS (
  SELECT conv_id, turn, CASE damage WHEN 4 THEN 'user' ELSE role END AS role,
         CASE damage WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM summed, range(CASE damage WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
         count(*) OVER (PARTITION BY conv_id) AS n, left(role, 1) AS c,
         regexp_extract_all(text, '[^\x20\x09-\x0D]') AS held
  FROM damaged),
judged AS (
  SELECT *, lag(c) OVER (PARTITION BY conv_id ORDER BY i) AS before,
         CASE WHEN len(held) = 0 THEN 'blank'
              WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
              WHEN NOT regexp_matches(held[-1], '[.!?]') THEN 'truncated' ELSE '' END AS fault
  FROM placed),
rows AS (
  SELECT conv_id, i, n, c, role, text, fault IN ('blank', 'duplicate') AS goes,
         CASE fault WHEN 'truncated' THEN 3 ELSE 0 END AS extra
  FROM judged),
base AS (
  SELECT conv_id, max(n) + 1 AS i, 0::BIGINT AS c0, 6::BIGINT AS c1, 3::BIGINT AS c2, 0::BIGINT AS c3 FROM rows GROUP BY conv_id),
back AS (
  SELECT * FROM base
  UNION ALL
  SELECT conv_id, i, least(b0, 3 + least(b2, 3 + b3)), least(b1, 3 + least(b2, 3 + b3)), least(b2, 3 + b3), least(b3, 3 + b2)
  FROM (
    SELECT r.conv_id, r.i,
      least(4 + c0, CASE WHEN NOT goes THEN extra + least(3 + c2, CASE c WHEN 's' THEN c1 WHEN 'u' THEN c2 ELSE 3 + c2 END) END) AS b0,
      least(4 + c1, CASE WHEN NOT goes THEN extra + least(3 + c2, CASE c WHEN 'u' THEN c2 ELSE 3 + c2 END) END) AS b1,
      least(4 + c2, CASE WHEN NOT goes THEN extra + least(3 + c3, CASE c WHEN 'a' THEN c3 ELSE 3 + c3 END) END) AS b2,
      least(4 + c3, CASE WHEN NOT goes THEN extra + least(3 + c2, CASE c WHEN 'u' THEN c2 ELSE 3 + c2 END) END) AS b3
    FROM back JOIN rows r ON r.conv_id IS NOT DISTINCT FROM back.conv_id AND r.i = back.i - 1)),
nodes AS (
  SELECT b.conv_id, b.i, s, CASE s WHEN 0 THEN c0 WHEN 1 THEN c1 WHEN 2 THEN c2 ELSE c3 END AS cost,
         CASE s WHEN 2 THEN 3 ELSE 2 END AS due, CASE s WHEN 2 THEN c3 ELSE c2 END AS due_cost
  FROM back b, range(4) t(s)),
arcs AS (
  SELECT x.conv_id, x.i, x.s, x.due, x.cost, r.role, r.text,
         CASE WHEN r.i IS NULL THEN CASE WHEN x.s IN (1, 2) THEN 'I' END
              WHEN x.cost = 4 + (SELECT y.cost FROM nodes y WHERE y.conv_id IS NOT DISTINCT FROM x.conv_id AND y.i = x.i + 1 AND y.s = x.s) THEN 'D'
              WHEN x.cost = 3 + x.due_cost THEN 'I'
              WHEN (CASE r.c WHEN 's' THEN x.s = 0 WHEN 'u' THEN x.s <> 2 WHEN 'a' THEN x.s = 2 ELSE false END) AND NOT r.goes
                   AND x.cost = r.extra + (SELECT y.cost FROM nodes y WHERE y.conv_id IS NOT DISTINCT FROM x.conv_id AND y.i = x.i + 1
                                           AND y.s = CASE r.c WHEN 's' THEN 1 ELSE x.due END) THEN 'K'
              ELSE 'R' END AS edit
  FROM nodes x LEFT JOIN rows r ON r.conv_id IS NOT DISTINCT FROM x.conv_id AND r.i = x.i),
walk AS (
  SELECT DISTINCT conv_id, 1::BIGINT AS i, 0::BIGINT AS s, '' AS audit, []::VARCHAR[] AS body, false AS done FROM base
  UNION ALL
  SELECT w.conv_id, w.i + CASE WHEN a.edit IN ('D', 'K', 'R') THEN 1 ELSE 0 END,
         CASE WHEN a.edit = 'D' OR a.edit IS NULL THEN w.s WHEN a.edit = 'K' AND left(a.role, 1) = 's' THEN 1 ELSE a.due END,
         w.audit || coalesce(a.edit, ''),
         CASE WHEN a.edit = 'K' THEN list_append(w.body, a.role || ':' || a.text)
              WHEN a.edit IN ('I', 'R') THEN list_append(w.body, CASE a.due WHEN 2 THEN 'user:' ELSE 'assistant:' END
                                                         || CASE a.edit WHEN 'R' THEN a.text ELSE '' END)
              ELSE w.body END,
         a.edit IS NULL
  FROM walk w JOIN arcs a ON a.conv_id IS NOT DISTINCT FROM w.conv_id AND a.i = w.i AND a.s = w.s
  WHERE NOT w.done),
counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
         count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (before IS NOT NULL AND before || c NOT IN ('su', 'ua', 'au')) AS illegal
  FROM judged GROUP BY conv_id)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
       coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(n.cost, 0)::BIGINT AS cost,
       coalesce(w.audit, '') AS audit, sha256(coalesce(array_to_string(w.body, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
     LEFT JOIN counted f ON f.conv_id IS NOT DISTINCT FROM o.conv_id
     LEFT JOIN nodes n ON n.conv_id IS NOT DISTINCT FROM o.conv_id AND n.i = 1 AND n.s = 0
     LEFT JOIN walk w ON w.conv_id IS NOT DISTINCT FROM o.conv_id AND w.done"""

ORACLES = {
    "op4_ngram_join": "WITH RECURSIVE" + _SHINGLES.format(docs="documents") + """
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, c.component AS component_id
FROM documents d LEFT JOIN sizes s USING (doc_id)
     JOIN (SELECT id, min(other) AS component FROM reach GROUP BY id) c ON c.id = d.doc_id""",
    "op11_conversation_repair": _REPAIR,
}
