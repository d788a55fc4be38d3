"""Words of letters, encoded by the model alone, against the whole tokenizer."""

import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer, normalizers

from larkspur.llm.chunk_encoder import ChunkEncoder
from larkspur.llm.letter_words import _LETTERS, LetterWords
from larkspur.llm.word_encoder import WordEncoder

FILES = ["word_bpe_49k.json", "byte_bpe_50k.json"]


@pytest.mark.parametrize("before", ["", " "])
@pytest.mark.parametrize("file", FILES)
def test_words_as_the_tokenizer_encodes_them(file, before):
    tokenizer, draw = Tokenizer.from_file(public_tokenizers.path(file)), random.Random(3)
    words = LetterWords(tokenizer, before)
    for _ in range(3000):
        word = "".join(draw.choices(draw.choice([_LETTERS, "aeinrst", "aéßnÇÖ", "ſIi"]), k=draw.randint(1, 12)))
        if words.match(word):
            ids = tokenizer.encode(before + word, add_special_tokens=False).ids
            assert words.ids(word) == b"".join(i.to_bytes(4, "little") for i in ids), word
    assert words.match("Straße") and not any(map(words.match, ("", "a1", "a b", "it's", "漢", "e\u0301", "\u0130", "a\u0345")))


def test_a_tokenizer_that_treats_words_otherwise():
    tokenizer = Tokenizer.from_file(public_tokenizers.path(FILES[0]))
    tokenizer.add_tokens(["still"])
    assert not LetterWords(tokenizer).match("a")
    tokenizer = Tokenizer.from_file(public_tokenizers.path(FILES[0]))
    tokenizer.normalizer = normalizers.Prepend("x")
    assert not LetterWords(tokenizer).match("a")


@pytest.mark.parametrize("kind, file", [(WordEncoder, FILES[0]), (ChunkEncoder, FILES[1])])
def test_new_words_do_not_take_the_whole_way(kind, file):
    encoder, draw = kind(public_tokenizers.path(file)), random.Random(4)
    text = " ".join("".join(draw.choices("aeinrstÉñ", k=9)) + draw.choice(["", "", ",", "."]) for _ in range(2000))
    whole, calls = encoder.tokenizer, []

    class Counted:
        def encode(self, word, **options):
            calls.append(word)
            return whole.encode(word, **options)

    encoder.tokenizer = Counted()
    assert encoder.encode(text) == b"".join(i.to_bytes(4, "little") for i in whole.encode(text, add_special_tokens=False).ids)
    assert len(calls) <= 4
