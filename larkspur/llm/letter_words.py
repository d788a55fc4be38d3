"""Ids of words of letters from the tokenizer's model alone, without the steps before it that leave such words whole."""

from __future__ import annotations

import re

#: Letters up to the first one whose lower case has more than one character.
_LETTERS = "".join(c for c in map(chr, range(0x130)) if c.isalpha())


class LetterWords:
    """``ids`` of a word of Latin letters, after ``before``, as little-endian 32-bit numbers.

    The normalizer and the pre-tokenizer are asked once what they make of each letter. They make the same of a letter in
    a word, and leave a word of letters whole: where one that holds all of them shows otherwise, or an added token could
    stand inside a word, ``match`` finds nothing and words take the whole way.
    """

    def __init__(self, tokenizer, before: str = ""):
        self.model = tokenizer.model
        self.before, self.table, sure = self._seen(tokenizer, before)
        added = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        sure = sure and all(re.search(r"[^\w\s]", content) for content in added)
        self.match = re.compile(f"[{_LETTERS}]+" if sure else r"(?!)").fullmatch
        self.bytes_of = [i.to_bytes(4, "little") for i in range(tokenizer.get_vocab_size())]

    @staticmethod
    def _seen(tokenizer, before: str) -> tuple[str, dict[int, str], bool]:
        def pieces(text: str) -> list[str]:
            if tokenizer.normalizer is not None:
                text = tokenizer.normalizer.normalize_str(text)
            return [text] if tokenizer.pre_tokenizer is None else [
                p for p, _ in tokenizer.pre_tokenizer.pre_tokenize_str(text)]

        table = {ord(c): "".join(pieces(c)) for c in _LETTERS}
        begin = "".join(pieces(before + "a")).removesuffix(table[ord("a")])
        words = (_LETTERS, _LETTERS[::-1], "still")
        return begin, table, all(pieces(before + w) == [begin + w.translate(table)] for w in words)

    def ids(self, word: str) -> bytes:
        found = self.model.tokenize(self.before + word.translate(self.table))
        return b"".join([self.bytes_of[token.id] for token in found])
