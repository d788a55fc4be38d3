import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from larkspur.llm.chunk_encoder import ChunkEncoder
from larkspur.llm.packing import best_fit, best_fit_packing, cuts, sequences, token_pieces
from larkspur.llm.queries import op7_packing
from tests.llm.cases import LONG, documents, tables, with_clashes

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def test_chunks_equal_whole_texts(tokenizer):
    rng, encoder = random.Random(3), ChunkEncoder(PATH)
    parts = ["a", "the", "'s", "'ll", " ", "  ", "\n", "\t", ".", ",", "!", "\r\n", "é", "9", "<|endoftext|>", "漢", "'",
             "\x1c", "\x85", "x.y", "...", "😀", "ſ", "n't", ":", ";", "　", "\xa0"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 16))) for _ in range(4000)] + [LONG]
    for text in texts:
        ids = tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == ids, text[:50]


def test_query(spark, folder, tokenizer):
    docs = documents(spark, [(i, t) for i, t in documents(spark).select("doc_id", "text").collect() if i != 2] + [(2, "twice")])
    rows = op7_packing(spark, tables(spark, f"{folder}/t", documents=docs)).collect()
    for doc_id, text in docs.where("doc_id IS NOT NULL").select("doc_id", "text").collect():
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        own = sorted((r for r in rows if r["doc_id"] == doc_id), key=lambda r: r["piece"])
        at = 0
        for k, r in enumerate(own):
            part = np.array(ids[at:at + r["length"]], "<u4")
            assert (r["piece"], r["start"], r["ids_crc32"]) == (k, at, zlib.crc32(part.tobytes()))
            assert r["length"] == 1024 or k == 0
            at += r["length"]
        assert at == len(ids) and len(own) == -(-at // 1024)
    check_slots(rows)


def check_slots(rows, capacity=1024):
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for slots in by.values():
        at = 0
        for offset, length in sorted(slots):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_plan_equals_best_fit_decreasing():
    rng = random.Random(1)
    for _ in range(60):
        capacity = rng.randint(1, 60)
        lengths = [rng.randint(1, capacity) for _ in range(rng.randint(0, 200))]
        rooms = []
        for n in sorted(lengths, reverse=True):
            fits = [k for k, room in enumerate(rooms) if room >= n]
            if fits:
                rooms[min(fits, key=lambda k: rooms[k])] -= n
            else:
                rooms.append(capacity - n)
        counts = {n: lengths.count(n) for n in lengths}
        plan = best_fit(counts.items(), capacity)
        used = {}
        for n, low, high, first, each, offset in plan:
            for rank in range(low, high):
                step = rank - low
                used.setdefault(first + step // each, []).append((offset + step % each * n, n))
        assert sum(map(len, used.values())) == len(lengths) and len(used) == len(rooms)
        for slots in used.values():
            at = 0
            for offset, n in sorted(slots):
                assert offset == at
                at += n
            assert at <= capacity


def test_cuts():
    assert cuts(1, 4) == [(0, 1)] and cuts(4, 4) == [(0, 4)] and cuts(9, 4) == [(0, 1), (1, 4), (5, 4)]


def test_packing_of_any_pieces(spark):
    rows = spark.range(3000).selectExpr("id", "1 + id % 7 AS length")
    rows = with_clashes(rows, ["sequence_id", "offset", "rank"])
    packed = best_fit_packing(rows, 7).collect()
    assert len(packed) == 3000 and check_slots(packed, 7) <= -(-sum(1 + k % 7 for k in range(3000)) // 7) + 2
    assert best_fit_packing(rows.where("id < 0"), 7).count() == 0
    with pytest.raises(ValueError):
        best_fit_packing(rows, 5)


def test_sequences_hold_the_ids(spark, tokenizer):
    docs = documents(spark, [(k, f"text number {k} " * (k % 9)) for k in range(60)])
    packed = best_fit_packing(token_pieces(docs, PATH, 2, 64), 64).cache()
    by = {r["sequence_id"]: np.frombuffer(r["ids"], "<u4").tolist() for r in sequences(packed).collect()}
    for r in packed.collect():
        whole = tokenizer.encode(f"text number {r['id']} " * (r["id"] % 9), add_special_tokens=False).ids + [2]
        assert by[r["sequence_id"]][r["offset"]:r["offset"] + r["length"]] == whole[r["start"]:r["start"] + r["length"]]
