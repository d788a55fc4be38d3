"""SentencePiece encoding with seeded merge-dropout, and decoding."""

from __future__ import annotations

import functools
import hashlib
import heapq
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField

from larkspur.llm.inputs import with_computed

#: Words merged together, and the widths of the tables in which they are.
BLOCK_WORDS, WIDTHS = 65_536, (4, 6, 8, 11, 17)
#: Characters of texts that are cut into words together.
BLOCK_CHARS = 400_000
#: Candidates of a word whose draws are made with those of all words of a block; those after them are drawn one by one.
DRAWN = 16
_BLANK = "▁"
_MASK = (1 << 64) - 1
_NONE = np.int32(2**31 - 1)
_PLACE, _ORDER = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
_MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


class Vocabulary:
    """Pieces of a BPE model: scores of merges (the least comes first), ids and bytes."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.ids, self.scores, self.bytes_of = {}, {}, []
        self.coded = {}
        self.byte_ids = [0] * 256
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                value = int(piece[3:-1], 16)
                self.byte_ids[value] = i
                self.bytes_of.append(bytes([value]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                self.bytes_of.append(b"")
            else:
                self.ids[piece], self.scores[piece] = i, -model.get_score(i)
                self.coded[piece] = _id(i)
                self.bytes_of.append(piece.replace(_BLANK, " ").encode())

        self._tables()

    def _tables(self) -> None:
        """Numbers of single characters (that of their byte for other ASCII ones), and a hash table from two pieces to the rank and the number of their merger."""
        self.of_char = np.full(0x110000, -1, np.int32)
        self.of_char[:128] = self.byte_ids[:128]
        ranks = {score: k for k, score in enumerate(sorted(set(self.scores.values())))}
        pairs = {}
        for piece, number in self.ids.items():
            if len(piece) == 1:
                self.of_char[ord(piece)] = number
            for k in range(1, len(piece)):
                left, right = self.ids.get(piece[:k]), self.ids.get(piece[k:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = (ranks[self.scores[piece]], number)
        bits = max(4, (8 * len(pairs) + 1).bit_length())
        self.shift, places = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(places + 1, _MASK, np.uint64)
        self.merges = np.full((places + 1, 2), _NONE, np.int32)
        for key, made in pairs.items():
            at = key * _PLACE % (1 << 64) >> 64 - bits
            while self.keys[at] != np.uint64(_MASK):
                at = at + 1 & places
            self.keys[at], self.merges[at] = key, made

    def look_up(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank and number of the merger of each two pieces; the rank is ``_NONE`` where there is none."""
        key = left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)
        at = (key * np.uint64(_PLACE) >> self.shift).astype(np.int64)
        held = self.keys[at]
        out = self.merges[at]
        other = held != key
        out[other] = _NONE
        # Another pair may stand in the place: the next ones are looked at until one is free.
        left_over = np.flatnonzero(other & (held != np.uint64(_MASK)))
        while len(left_over):
            at[left_over] = at[left_over] + 1 & len(self.keys) - 1
            held = self.keys[at[left_over]]
            same = held == key[left_over]
            out[left_over[same]] = self.merges[at[left_over[same]]]
            left_over = left_over[~same & (held != np.uint64(_MASK))]
        return out

    def symbols(self, parts: list[str]) -> bytes:
        """Ids of final parts; a character that is no piece becomes its bytes."""
        coded = self.coded
        try:
            return b"".join([coded[p] for p in parts])
        except KeyError:
            return b"".join([coded.get(p) or b"".join([_id(self.byte_ids[b]) for b in p.encode()]) for p in parts])


def _id(number: int) -> bytes:
    return number.to_bytes(4, "little")


def draws(keys: np.ndarray, places: np.ndarray, limit: int) -> np.ndarray:
    """For words of texts with ``keys`` at ``places`` in them, bit ``k`` set where the word's ``k``-th candidate is skipped.

    Four candidates share a hash of the key, the place and their number; a candidate is skipped where its 16 bits of the
    hash are below ``limit``.
    """
    z = (places.astype(np.uint64) * np.uint64(_PLACE) + keys)[:, None] + np.arange(DRAWN // 4, dtype=np.uint64) * np.uint64(_ORDER)
    z = (z ^ (z >> np.uint64(31))) * np.uint64(_MIX[0])
    z = (z ^ (z >> np.uint64(29))) * np.uint64(_MIX[1])
    z ^= z >> np.uint64(32)
    return np.packbits(z.view(np.uint16) < limit, axis=1, bitorder="little").view(np.uint16).ravel()


def drawn(key: int, place: int, k: int, limit: int) -> bool:
    """Whether the ``k``-th candidate of the word at ``place`` is skipped."""
    z = (place * _PLACE + (k >> 2) * _ORDER + key) & _MASK
    z = (z ^ (z >> 31)) * _MIX[0] & _MASK
    z = (z ^ (z >> 29)) * _MIX[1] & _MASK
    return ((z ^ (z >> 32)) >> 16 * (k & 3)) & 0xFFFF < limit


def merged(word: str, scores: dict[str, float], skips: Callable[[int], bool]) -> list[str]:
    """The parts that agenda merging leaves of ``word``.

    The agenda holds the pairs of neighbours that form a piece, best score first, then leftmost. Each that comes up while
    both its parts still stand is a candidate, numbered from 0; where ``skips`` says so it is passed over and only comes
    back as part of a longer pair.
    """
    n, up = len(word), 0
    ends = list(range(1, n + 1))  # where the part that begins here ends; 0 once it is merged into another
    begins = list(range(-1, n - 1))  # where the part before begins
    agenda = [(score, i, i + 1, i + 2) for i in range(n - 1) if (score := scores.get(word[i:i + 2])) is not None]
    heapq.heapify(agenda)
    while agenda:
        _, left, middle, end = heapq.heappop(agenda)
        if ends[left] != middle or ends[middle] != end:
            continue
        up += 1
        if skips(up - 1):
            continue
        ends[left], ends[middle] = end, 0
        if end < n:
            begins[end] = left
            after = ends[end]
            score = scores.get(word[left:after])
            if score is not None:
                heapq.heappush(agenda, (score, left, end, after))
        before = begins[left]
        if before >= 0:
            score = scores.get(word[before:end])
            if score is not None:
                heapq.heappush(agenda, (score, before, left, end))
    return [word[i:ends[i]] for i in range(n) if ends[i]]


def merged_together(pieces: np.ndarray, lengths: np.ndarray, masks: np.ndarray, vocabulary: Vocabulary):
    """``merged`` for many short words at once: their pieces, which of these stand, and which words are not done.

    ``pieces`` has a word in each row, filled up to the width. The agenda of a word is its row of ranks, of which the
    least comes up; one candidate of every word is taken at a time. After ``DRAWN`` candidates a word is left to
    ``merged``.
    """
    n, width = pieces.shape
    sym = np.zeros((n, width + 1), np.int32)
    sym[:, :width] = pieces
    spots = np.arange(width + 1, dtype=np.int32)
    stands = spots[None, :] < lengths[:, None]
    ranks = np.full((n, width + 1), _NONE)
    mergers = np.zeros((n, width + 1), np.int32)
    row, col = np.nonzero(stands[:, 1:])
    found = vocabulary.look_up(sym[row, col], sym[row, col + 1])
    ranks[row, col], mergers[row, col] = found[:, 0], found[:, 1]
    # Where the next part begins, and the one before; the place after the last is the width, before the first -1.
    after = np.minimum(spots[None, :] + 1, lengths[:, None]).astype(np.int32)
    after[after == lengths[:, None]] = width
    before = np.broadcast_to(spots - 1, after.shape).copy()
    wide = width + 1
    sym, ranks, mergers, after, before, flat = (x.reshape(-1) for x in (sym, ranks, mergers, after, before, stands))
    active = np.arange(n)
    for turn in range(DRAWN):
        table = ranks.reshape(n, wide)[active]
        spot = table.argmin(axis=1)
        open_ = np.take_along_axis(table, spot[:, None], 1)[:, 0] != _NONE
        active, spot = active[open_], spot[open_]
        if not len(active):
            break
        base = active * wide
        at = base + spot
        skip = masks[active] >> turn & 1 == 1
        ranks[at[skip]] = _NONE
        base, at, spot = base[~skip], at[~skip], spot[~skip]
        gone = base + after[at]
        following = after[gone]
        sym[at] = mergers[at]
        after[at] = following
        flat[gone] = False
        ranks[gone] = _NONE
        more = following < width
        ranks[at] = _NONE
        here, there = at[more], (base + following)[more]
        before[there] = spot[more]
        found = vocabulary.look_up(sym[here], sym[there])
        ranks[here], mergers[here] = found[:, 0], found[:, 1]
        more = before[at] >= 0
        here = at[more]
        there = base[more] + before[here]
        found = vocabulary.look_up(sym[there], sym[here])
        ranks[there], mergers[there] = found[:, 0], found[:, 1]
    left = np.zeros(n, bool)
    left[active] = (ranks.reshape(n, wide)[active] != _NONE).any(axis=1)
    return sym.reshape(n, wide)[:, :width], flat.reshape(n, wide)[:, :width], left


class PieceEncoder:
    """Ids of whole texts. Without dropout they are those of the model's own processor.

    With it every word of every text has its own draws. Words of up to the greatest width are merged in blocks; those
    that are longer, hold a character that is no piece, or have many candidates are merged one by one.
    """

    def __init__(self, path: str, dropout: float, seed: int):
        self.vocabulary = Vocabulary(path)
        self.seed, self.limit = seed, round(dropout * 65536)

    def key_of(self, key: str) -> int:
        """What the draws of a row's text are made from, besides place and candidate."""
        return int.from_bytes(hashlib.blake2b(f"{self.seed}:{key}".encode(), digest_size=8).digest(), "little")

    def encode(self, text: str, key: str = "") -> bytes:
        """Little-endian 32-bit ids of one text."""
        return self.encode_all([text], [key])[0].tobytes()

    def encode_all(self, texts: list[str], keys: list[str]) -> list[np.ndarray]:
        """The ids of each text, whose ``key`` tells it from others in the draws."""
        out: list[np.ndarray] = []
        low, size = 0, 0
        for high, text in enumerate(texts, 1):
            size += len(text)
            if size >= BLOCK_CHARS or high == len(texts):
                out += self._block(texts[low:high], [self.key_of(k) for k in keys[low:high]])
                low, size = high, 0
        return out

    def _block(self, texts: list[str], keys: list[int]) -> list[np.ndarray]:
        # The mark for blanks itself is spelled in bytes, so it decodes as what it is; it stands between parts.
        parts, owner, firsts = [], [], []
        for k, text in enumerate(texts):
            for part in (" " + text).split(_BLANK) if text else ():
                parts.append(part)
                owner.append(k)
        chars = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        chars[chars == 32] = ord(_BLANK)
        blank = chars == ord(_BLANK)
        opens = blank.copy()
        opens[1:] &= ~blank[:-1]
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        begins = np.cumsum(sizes) - sizes
        opens[begins[sizes > 0]] = True
        starts = np.flatnonzero(opens)
        lengths = np.diff(np.append(starts, len(chars)))
        part_of = np.searchsorted(np.append(begins, len(chars)), starts, "right") - 1
        # Empty parts share their begin with the next one, to which its words belong.
        owner = np.array(owner, np.int64)
        text_of = owner[part_of] if len(starts) else np.zeros(0, np.int64)
        place = np.arange(len(starts)) - np.searchsorted(text_of, text_of, "left")
        ids, counts = self._words(chars, starts, lengths, text_of, place, keys)
        ends = np.append(0, np.cumsum(counts))
        word_bounds = np.searchsorted(text_of, np.arange(len(texts) + 1), "left")
        plain = [ids[ends[a]:ends[b]] for a, b in zip(word_bounds, word_bounds[1:])]
        if len(parts) == sum(map(bool, texts)):
            return plain
        literal = np.asarray([self.vocabulary.byte_ids[b] for b in _BLANK.encode()], "<i4")
        pieces: list[list[np.ndarray]] = [[] for _ in texts]
        low = np.searchsorted(part_of, np.arange(len(parts)), "left")
        high = np.searchsorted(part_of, np.arange(len(parts)), "right")
        for p, k in enumerate(owner.tolist()):
            pieces[k] += [literal] if pieces[k] else []
            pieces[k].append(ids[ends[low[p]]:ends[high[p]]])
        return [np.concatenate(x) if x else np.zeros(0, "<i4") for x in pieces]

    def _words(self, chars, starts, lengths, text_of, place, keys) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in order, and how many each has."""
        known, seeds = self.vocabulary.of_char[chars], np.array(keys, np.uint64)
        out, counts = [], []
        for low in range(0, len(starts), BLOCK_WORDS):
            cut = slice(low, low + BLOCK_WORDS)
            own, size = starts[cut], lengths[cut]
            masks = (draws(seeds[text_of[cut]], place[cut], self.limit) if self.limit else np.zeros(len(own), np.uint16)).astype(np.int64)
            odd = np.add.reduceat(known[own[0]:own[-1] + size[-1]] < 0, own - own[0]) > 0
            odd |= size > WIDTHS[-1]
            n, made, narrow = np.zeros(len(own), np.int64), [], 0
            for width in WIDTHS:
                rows = np.flatnonzero((size > narrow) & (size <= width) & ~odd)
                narrow = width
                if len(rows):
                    at = np.minimum(own[rows, None] + np.arange(width), len(known) - 1)
                    sym, stands, left = merged_together(known[at], size[rows], masks[rows], self.vocabulary)
                    odd[rows[left]] = True
                    stands &= ~left[:, None]
                    n[rows] = stands.sum(axis=1)
                    made.append((rows, sym, stands))
            alone = {}
            for w in np.flatnonzero(odd).tolist():
                word = chars[own[w]:own[w] + size[w]].astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
                alone[w] = self._alone(word, keys[text_of[low + w]], int(place[low + w]))
                n[w] = len(alone[w])
            ends = np.cumsum(n)
            ids = np.zeros(int(ends[-1]), "<i4")
            for rows, sym, stands in made:
                spot = (ends[rows] - n[rows])[:, None] + np.cumsum(stands, axis=1) - 1
                ids[spot[stands]] = sym[stands]
            for w, found in alone.items():
                ids[ends[w] - n[w]:ends[w]] = found
            out.append(ids)
            counts.append(n)
        return (np.concatenate(out) if out else np.zeros(0, "<i4")), (np.concatenate(counts) if counts else np.zeros(0, np.int64))

    def _alone(self, word: str, key: int, place: int) -> np.ndarray:
        limit = self.limit
        parts = merged(word, self.vocabulary.scores, lambda k: limit > 0 and drawn(key, place, k, limit))
        return np.frombuffer(self.vocabulary.symbols(parts), "<i4")


@functools.lru_cache(maxsize=2)
def piece_encoder(path: str, dropout: float, seed: int) -> PieceEncoder:
    """The encoder of a worker process, made once."""
    return PieceEncoder(path, dropout, seed)


@functools.lru_cache(maxsize=1)
def _vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def decode_ids(ids: np.ndarray, bytes_of: list[bytes]) -> str:
    """The text of ids; bytes that are no UTF-8 (of ids that no encoding gave) become replacement characters."""
    return b"".join(map(bytes_of.__getitem__, ids.tolist()))[1:].decode("utf-8", "replace")


def encode_pieces(docs: DataFrame, model_path: str, dropout: float = 0.1, seed: int = 0, id_column: str = "doc_id",
                  text_column: str = "text", ids_column: str = "ids") -> DataFrame:
    """``docs`` with ``ids_column``, an array of piece ids of the whole text; null for a null text, empty for an empty one.

    With ``dropout`` (in steps of 1 / 65 536) each candidate merge is skipped with that probability, drawn by a hash of
    ``seed``, the row's id, the place of the word in the text and the number of the candidate in the word. So every
    occurrence of a word is segmented anew, another seed gives other pieces, and a task that runs again the same ones.
    Rows of one id and text have the same pieces. A column called ``ids_column`` is replaced, other columns are passed on.
    """
    if not 0 <= dropout < 1:
        raise ValueError("dropout must be at least 0 and below 1")

    def factory(names):
        place, key = names.index(text_column), names.index(id_column)
        encoder = piece_encoder(model_path, dropout, seed)

        def compute(batch):
            keys = [k or "" for k in batch.column(key).cast(pa.string()).to_pylist()]
            texts = batch.column(place).to_pylist()
            found = encoder.encode_all([t or "" for t in texts], keys)
            values = pa.array(np.concatenate(found) if found else np.zeros(0, "<i4"))
            offsets = pa.array(np.concatenate(([0], np.cumsum([len(f) for f in found]))).astype(np.int32))
            return [pa.ListArray.from_arrays(offsets, values, mask=pa.array([t is None for t in texts]))]

        return compute

    return with_computed(docs, [StructField(ids_column, ArrayType(IntegerType()))], factory)


def decode_pieces(encoded: DataFrame, model_path: str, ids_column: str = "ids", text_column: str = "decoded") -> DataFrame:
    """``encoded`` with ``text_column``: the text of the ids, null for null. A column of that name is replaced."""

    def factory(names):
        place, bytes_of = names.index(ids_column), _vocabulary(model_path).bytes_of

        def compute(batch):
            ids = batch.column(place)
            texts = [None if not x.is_valid else decode_ids(x.values.to_numpy(zero_copy_only=False), bytes_of) for x in ids]
            return [pa.array(texts, pa.string())]

        return compute

    return with_computed(encoded, [StructField(text_column, StringType())], factory)
