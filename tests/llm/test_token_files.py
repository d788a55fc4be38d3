import io
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from larkspur.llm.queries import op12_token_files
from larkspur.llm.token_files import TokenFile, code_levels, file_sections, read_documents, tokens_at, write_token_files
from larkspur.llm.word_encoder import WordEncoder
from tests.llm.cases import LONG, documents, tables, with_clashes

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def file_of(labels, lengths, ids):
    return TokenFile(io.BytesIO(b"".join(file_sections(labels, lengths, np.asarray(ids, "<u4")))))


class Counting(io.BytesIO):
    """Counts the bytes read."""

    taken = 0

    def read(self, n=-1):
        found = super().read(n)
        self.taken += len(found)
        return found


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**17), st.integers(0, 2**32 - 1)), max_size=40), max_size=12),
       st.randoms())
def test_any_token_and_any_range(docs, rng):
    ids = [i for d in docs for i in d]
    labels = [rng.choice((None, "", "é", str(k))) for k in range(len(docs))]
    found = file_of(labels, [len(d) for d in docs], ids)
    assert found.labels() == labels and np.diff(found.starts()).tolist() == [len(d) for d in docs]
    assert [found.token(k) for k in range(len(ids))] == ids
    for _ in range(5):
        low = rng.randint(0, len(ids))
        high = rng.randint(low, len(ids))
        assert found.tokens(low, high).tolist() == ids[low:high]
    with pytest.raises(IndexError):
        found.token(len(ids))


def test_ranks_over_many_blocks():
    rng = np.random.default_rng(4)
    ids = np.where(rng.random(200_000) < 0.3, rng.integers(0, 256, 200_000), rng.integers(0, 1 << 24, 200_000)).astype("<u4")
    found = file_of(["x"], [len(ids)], ids)
    for at in rng.integers(0, len(ids), 300).tolist():
        assert found.token(at) == ids[at]
        assert (found.tokens(at, min(at + 700, len(ids))) == ids[at:at + 700]).all()
    levels = code_levels(ids)
    assert [len(c) for c, _, _ in levels] == [len(ids), int((ids > 255).sum()), int((ids > 65535).sum())]


def test_a_token_is_read_without_its_neighbours():
    ids = np.arange(1_000_000, dtype="<u4")
    source = Counting(b"".join(file_sections(["x"], [len(ids)], ids)))
    found = TokenFile(source)
    source.taken = 0
    assert found.token(777_777) == 777_777 and source.taken < 300


def test_damaged_files():
    body = b"".join(file_sections(["x"], [3], np.array([1, 2, 3], "<u4")))
    with pytest.raises(ValueError):
        TokenFile(io.BytesIO(b"other" + body[5:]))
    with pytest.raises(ValueError):
        TokenFile(io.BytesIO(body[:-8])).tokens(0, 3)


def test_words_equal_whole_texts(tokenizer):
    rng, encoder = random.Random(3), WordEncoder(PATH)
    parts = ["a", "The", "'s", "'ll", " ", "  ", "\n", "\t", ".", ",", "!", "\r\n", "É", "9", "<|endoftext|>", "漢", "'",
             "\x1c", "\x85", "x.y", "...", "😀", "ſ", "n't", ":", ";", "　", "\xa0", "é", "́", "​", "İ", "Σ", "ͅ"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 16))) for _ in range(5000)] + [LONG]
    for text in texts:
        ids = tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == ids, text[:50]


def check(rows, docs, tokenizer):
    """The rows against ids made at once, document after document."""
    at = 0
    by = {}
    for i, t in docs:
        by.setdefault(i, []).append(tokenizer.encode(t or "", add_special_tokens=False).ids + [2])
    rows = sorted(rows, key=lambda r: r["start"])
    order = [r["doc_id"] for r in rows]
    assert order == sorted(order, key=lambda i: (i is not None, i or 0)) and len(rows) == len(docs)
    for r in rows:
        of = {(len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for x in by[r["doc_id"]]}
        assert r["start"] == at and (r["n_tokens"], r["ids_crc32"]) in of
        at += r["n_tokens"]
    assert at == sum(len(x) for own in by.values() for x in own)


def test_query(spark, folder, tokenizer, data):
    docs = documents(spark)
    pairs = [(r["doc_id"], r["text"]) for r in docs.collect()]
    check(op12_token_files(spark, tables(spark, f"{folder}/t", documents=docs)).collect(), pairs, tokenizer)
    empty = tables(spark, f"{folder}/e", documents=documents(spark, []))
    assert op12_token_files(spark, empty).count() == 0
    pairs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    check(op12_token_files(spark, data).collect(), pairs, tokenizer)


def test_files_of_few_ids(spark, folder, tokenizer):
    docs = documents(spark, [(k * 7 % 500, f"Text number {k} of some words " * (k % 5)) for k in range(500)])
    docs = with_clashes(docs, ["id", "start", "a.b"])
    files = write_token_files(docs, PATH, 2, folder=f"file://{folder}/ids", file_ids=400).cache()
    assert files.count() > 10 and {r["documents"] > 0 for r in files.collect()} == {True}
    found = read_documents(files).collect()
    whole = [i for r in sorted(found, key=lambda r: r["start"]) for i in np.frombuffer(r["ids"], "<u4").tolist()]
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert whole == [i for k in sorted(texts) for i in tokenizer.encode(texts[k], add_special_tokens=False).ids + [2]]
    places = spark.createDataFrame([(p,) for p in [*range(0, len(whole), 37), 5, 5, -1, len(whole), None]], "place bigint")
    got = tokens_at(files, places).collect()
    assert len(got) == places.count()
    for r in got:
        inside = r["place"] is not None and 0 <= r["place"] < len(whole)
        assert r["token"] == (whole[r["place"]] if inside else None)


def test_one_id_for_many_rows(spark, folder, tokenizer):
    docs = documents(spark, [(7 if k % 3 else k, f"row {k}") for k in range(900)])
    rows = read_documents(write_token_files(docs, PATH, 2), content="crc32").withColumnsRenamed({"id": "doc_id", "crc32": "ids_crc32"})
    check(rows.collect(), [(r["doc_id"], r["text"]) for r in docs.collect()], tokenizer)


def test_ids_that_are_texts(spark):
    docs = spark.createDataFrame([("b", "two"), ("a", "one"), (None, "none"), ("ä", "three")], "doc_id string, text string")
    found = read_documents(write_token_files(docs, PATH, 2), "string", content="crc32").orderBy("start").collect()
    assert [r["id"] for r in found] == [None, "a", "b", "ä"]
