"""Ids of texts under a BPE with word ends that drops white space, remembering the ids of repeated words."""

from __future__ import annotations

import functools

import numpy as np

from larkspur.llm.letter_words import LetterWords

#: Words remembered by a worker; more are encoded each time, which changes no result.
REMEMBERED = 200_000
_MARKS = b".,;:!?"


class WordEncoder(dict):
    """``encode`` gives the ids of a text as little-endian 32-bit numbers, equal to encoding it at once.

    Words are kept in UTF-8.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.letters = LetterWords(self.tokenizer)

    def __missing__(self, word: bytes) -> bytes:
        core = word.rstrip(_MARKS)
        if core != word:
            last = core[-1:].decode() if core.isascii() else core.decode()[-1]
            # A token also ends between a letter and a mark; these letters stay letters in lower case and normal form.
            if last.isalpha() and last < "\u0130":
                return self[core] + self[word[len(core):]]
        text = word.decode()
        if self.letters.match(text):
            found = self.letters.ids(text)
        else:
            found = np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if len(self) < REMEMBERED and len(word) < 64:
            self[word] = found
        return found

    def encode(self, text: str) -> bytes:
        # No token reaches over white space of ASCII, at which bytes are split, so what stands between is encoded alone.
        return b"".join(map(self.__getitem__, text.encode().split()))


@functools.lru_cache(maxsize=1)
def word_encoder(path: str) -> WordEncoder:
    """The encoder of a worker process: later tasks find the words of earlier ones."""
    return WordEncoder(path)
