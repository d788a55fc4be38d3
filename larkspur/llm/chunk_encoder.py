"""Byte-level BPE ids of texts, remembering the ids of repeated chunks."""

from __future__ import annotations

import functools
import re

import numpy as np

from larkspur.llm.letter_words import LetterWords

#: Chunks remembered by a worker; more are encoded each time, which changes no result.
REMEMBERED = 300_000
#: A space before a visible character always begins a new token, so chunks cut there are encoded alone.
_CUT = re.compile(r" (?=\S)")
_MARKS = ".,;:!?"


class _Odd(Exception):
    pass


class _Chunks(dict):
    """Ids of ``prefix`` and a part, made when first asked for.

    A token ends between a letter and a mark, and on both sides of a line break between visible characters, so parts are
    taken apart there and only words are remembered.
    """

    def __init__(self, encoder: ChunkEncoder, prefix: str):
        self.encoder, self.prefix = encoder, prefix
        self.letters = LetterWords(encoder.tokenizer, prefix)

    def __missing__(self, part: str) -> bytes:
        if self.letters.match(part):
            return self.remembered(part, self.letters.ids(part))
        if self.prefix and (not part or part[0].isspace()):
            raise _Odd
        if "\n" in part:
            lines = part.split("\n")
            if all(x and not x[0].isspace() and not x[-1].isspace() for x in lines):
                plain = self.encoder.first
                return self.encoder.line.join([self[lines[0]], *map(plain.__getitem__, lines[1:])])
        core = part.rstrip(_MARKS)
        if core and core != part and core[-1].isalpha():
            return self[core] + self.encoder.first[part[len(core):]]
        return self.remembered(part, self.encoder.direct(self.prefix + part))

    def remembered(self, part: str, found: bytes) -> bytes:
        if len(self) < REMEMBERED and len(part) < 64:
            self[part] = found
        return found


class ChunkEncoder:
    """``encode`` gives the ids of a text as little-endian 32-bit numbers, equal to encoding it at once."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.first, self.rest = _Chunks(self, ""), _Chunks(self, " ")
        self.line = self.direct("\n")

    def direct(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        parts = text.split(" ")
        try:
            return b"".join([self.first[parts[0]], *map(self.rest.__getitem__, parts[1:])])
        except _Odd:
            parts = _CUT.split(text)
            return b"".join([self.first[parts[0]], *map(self.rest.__getitem__, parts[1:])])


@functools.lru_cache(maxsize=1)
def chunk_encoder(path: str) -> ChunkEncoder:
    """The encoder of a worker process: later tasks find the chunks of earlier ones."""
    return ChunkEncoder(path)
