import hashlib
import random
import re

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from larkspur.llm import pieces as P
from larkspur.llm.queries import op2_pieces
from tests.llm.cases import LONG, documents, tables, with_clashes

PATH = public_tokenizers.path("piece_bpe_32k.model")


def texts(n=3000):
    rng = random.Random(2)
    parts = ["a", "the", "'s", "ing", " ", "  ", "\n", "\t", ".", ",", "!", "é", "9", "Ω", "漢", "x.y", "😀", "ﬁ", "\x00", " ", "１", "Un"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(n)]


def ids(encoder, text, key=""):
    return np.frombuffer(encoder.encode(text, key), "<i4")


def test_without_dropout_as_the_processor(spark, data):
    model, encoder = sentencepiece.SentencePieceProcessor(model_file=PATH), P.PieceEncoder(PATH, 0.0, 0)
    given = [r["text"] for r in spark.read.parquet(f"{data}/documents.parquet").select("text").collect() if r["text"]]
    for text in [*texts(), *given]:
        assert ids(encoder, text).tolist() == model.encode(text)


def test_lossless_with_dropout():
    for dropout in (0.05, 0.3, 0.9):
        encoder = P.PieceEncoder(PATH, dropout, 7)
        for k, text in enumerate([*texts(800), "a▁b", "▁", "▁▁ x", " ▁ ", LONG]):
            assert P.decode_ids(ids(encoder, text, str(k)), encoder.vocabulary.bytes_of) == text


def test_varied_and_repeatable():
    a, b, c = (P.PieceEncoder(PATH, 0.3, seed) for seed in (1, 1, 2))
    text = "understanding segmentation of international considerations " * 6
    assert a.encode(text, "1") == b.encode(text, "1") and a.encode(text, "1") != c.encode(text, "1")
    assert len({a.encode("international", str(k)) for k in range(40)}) > 1
    plain = P.PieceEncoder(PATH, 0.0, 0)
    assert len(a.encode(text)) > len(plain.encode(text))


def slowly(encoder, text, key):
    """Pieces by looking through all pairs of neighbours for each candidate, with draws of their own."""
    vocabulary, mask, out, place = encoder.vocabulary, (1 << 64) - 1, [], 0
    row = int.from_bytes(hashlib.blake2b(f"{encoder.seed}:{key}".encode(), digest_size=8).digest(), "little")

    def skips(place, k):
        z = (row + place * 0x9E3779B97F4A7C15 + k // 4 * 0xC2B2AE3D27D4EB4F) & mask
        z = (z ^ z >> 31) * 0xBF58476D1CE4E5B9 & mask
        z = (z ^ z >> 29) * 0x94D049BB133111EB & mask
        return (z ^ z >> 32) >> 16 * (k % 4) & 65535 < encoder.limit

    for n, part in enumerate((" " + text).split("▁") if text else []):
        out += [vocabulary.byte_ids[b] for b in "▁".encode()] if n else []
        for word in re.findall("▁*[^▁]+|▁+", part.replace(" ", "▁")):
            parts, gone, k = list(word), set(), 0
            while True:
                starts = [sum(map(len, parts[:i])) for i in range(len(parts))]
                pairs = [(vocabulary.scores[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in vocabulary.scores
                         and (starts[i], len(a), len(b)) not in gone]
                if not pairs:
                    break
                i = min(pairs)[1]
                if skips(place, k):
                    gone.add((starts[i], len(parts[i]), len(parts[i + 1])))
                else:
                    parts[i:i + 2] = [parts[i] + parts[i + 1]]
                k += 1
            place += 1
            for p in parts:
                out += [vocabulary.ids[p]] if p in vocabulary.ids else [vocabulary.byte_ids[b] for b in p.encode()]
    return out


@pytest.mark.parametrize("dropout", [0.0, 0.1, 0.5, 0.95])
def test_equals_a_plain_agenda(dropout):
    encoder = P.PieceEncoder(PATH, dropout, 5)
    long = ["internationalization understandingly " * 9, "antidisestablishmentarianism" * 3, "a▁b ▁", "▁"]
    for k, text in enumerate([*texts(400), *long, *long]):
        assert ids(encoder, text, str(k)).tolist() == slowly(encoder, text, str(k)), text


def test_blocks_change_nothing(monkeypatch):
    many = [*texts(300), "understanding ▁ of international considerations " * 40, "", " ", "x" * 30]
    keys = [str(k) for k in range(len(many))]
    encoder = P.PieceEncoder(PATH, 0.2, 1)
    kept = [x.tolist() for x in encoder.encode_all(many, keys)]
    assert kept == [ids(encoder, t, k).tolist() for t, k in zip(many, keys)]
    monkeypatch.setattr(P, "BLOCK_WORDS", 7)
    monkeypatch.setattr(P, "BLOCK_CHARS", 50)
    assert kept == [x.tolist() for x in encoder.encode_all(many, keys)]


def test_every_occurrence_is_drawn():
    encoder = P.PieceEncoder(PATH, 0.1, 0)
    found = {encoder.encode("international considerations", str(k)) for k in range(5000)}
    assert len(found) > 25
    # Also within one text.
    assert len({encoder.encode("considerations " * k, "x")[-16:] for k in range(1, 400)}) > 10


def test_skipped_share_of_candidates():
    masks = P.draws(np.full(20_000, 12345, np.uint64), np.arange(20_000), round(0.1 * 65536))
    shares = [(masks >> k & 1).mean() for k in range(P.DRAWN)]
    assert max(abs(x - 0.1) for x in shares) < 0.01
    assert all(P.drawn(12345, place, k, 6554) == masks[place] >> k & 1 for place in range(50) for k in range(P.DRAWN))


def test_query(spark, folder):
    rows = op2_pieces(spark, tables(spark, f"{folder}/t", documents=documents(spark))).collect()
    assert len(rows) == 13 and all(r["lossless"] for r in rows)
    assert {r["n_pieces"] for r in rows if r["doc_id"] in (3, 4)} == {0}


def test_cases(spark):
    docs = with_clashes(documents(spark), ["ids", "decoded"])
    coded = P.decode_pieces(P.encode_pieces(docs, PATH, 0.1, 3), PATH)
    assert coded.columns.count("ids") == 1 and all(r["text"] == r["decoded"] for r in coded.collect())
    assert P.encode_pieces(documents(spark, []), PATH).count() == 0
    with pytest.raises(ValueError):
        P.encode_pieces(docs, PATH, 1.0)
