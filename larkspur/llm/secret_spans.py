"""Secrets in texts: fixed patterns, and a linear-chain conditional random field that adds what they miss."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from larkspur.llm.inputs import columns_of, with_computed
from larkspur.session import ship

#: Expected number of texts whose windows the field is fitted on, and most windows.
TRAINING_TEXTS, TRAINING_WINDOWS = 20_000, 4_000
#: Tokens of a window, and before a secret in it.
WINDOW, LEAD = 24, 8
STEPS, RATE, RIDGE = 60, 0.15, 1e-3
BEGIN, INSIDE, OUTSIDE = 0, 1, 2
#: Score of an inside token that follows none of its secret.
_BROKEN = -12.0
#: Tokens, and kinds of tokens, whose scores a task remembers.
_REMEMBERED, _REMEMBERED_KINDS = 100_000, 20_000

# The base patterns and the least lengths of what they find.
_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]+")
KINDS = ("assign", "access", "hex")
ADDED = "crf"

_LONG_HEX = re.compile(r"[0-9a-f]{24}")
_NAMES = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_MARKED = bytes(1 if chr(i) in "0123456789abcdef" else 0 for i in range(256))
_RUN = b"\x01" * 24


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """``(start, kind, end)`` of the base patterns, leftmost and not overlapping within a kind, by start then kind."""
    data = text.encode("utf-8", "surrogatepass")
    found = []
    lowered = data.translate(_LOWER)
    if any(name in lowered for name in _NAMES):
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if b"AKIA" in data:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if len(m[0]) >= 20]
    if _RUN in data.translate(_MARKED):
        found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text) if len(m[0]) >= 24]
    return [(s, KINDS[k], e) for s, k, e in sorted(found)]


#: Kind of each byte of a token: letters become X or x, digits 0, marks stay.
_KIND = bytes(88 if 65 <= i <= 90 else 120 if 97 <= i <= 122 or i >= 128 else 48 if 48 <= i <= 57 else i for i in range(256))
_RUNS = re.compile(rb"X+|x+|0+|[^Xx0]+")
_HEX_ONLY = re.compile(r"[0-9a-f]+|[0-9A-F]+")
_EDGE = "\"'.,;:()[]{}<>"


def kinds_of(token: str) -> bytes:
    return token.encode().translate(_KIND)


def kind_features(kinds: bytes) -> list[str]:
    """Shape, length and make-up of a token, from the kinds of its bytes."""
    runs = _RUNS.findall(kinds)
    shape = b"".join(r[:1] for r in runs[:10]).decode()
    core = kinds.strip(_EDGE.encode())
    digits, letters = core.count(b"0"), core.count(b"x") + core.count(b"X")
    mix = "mixed" if digits and letters else "digits" if digits else "letters" if letters else "marks"
    return [
        f"shape {shape}", f"length {min(len(kinds) // 4, 12)}", f"{mix} {min(len(core) // 8, 6)}",
        f"runs {min(len(runs), 12)} {mix}", f"digits {min(digits, 12)} {mix}", f"assigns {b'=' in kinds}", "one"]


def letter_features(token: str, kinds: bytes) -> list[str]:
    """What else the characters of a token tell; nothing of a plain word."""
    out = []
    if b"0" in kinds:
        core = token.strip(_EDGE)
        if _HEX_ONLY.fullmatch(core):
            out.append(f"hex {min(len(core) // 8, 6)}")
        out.append(f"start {token[:4].lower()}")
    return out


def near_kind_features(kinds: bytes, side: str) -> list[str]:
    """What a token's kinds tell of its neighbour on the other side."""
    shape = b"".join(r[:1] for r in _RUNS.findall(kinds)[:6]).decode()
    return [f"{side} shape {shape}", f"{side} length {min(len(kinds) // 4, 4)}"]


def near_letter_features(token: str, side: str) -> list[str]:
    return [f"{side} mark {token}"] if len(token) <= 2 and not token.isalnum() else []


def file_features(text: str) -> list[str]:
    """Length of the text and how often it assigns."""
    n = len(text)
    return [f"file length {n.bit_length()}", f"file assigns {min((text.count('=') + text.count(':')) * 400 // (n + 1), 6)}"]


class Field:
    """Emission weights of features and transition weights between the three tags."""

    def __init__(self):
        self.index: dict[str, int] = {}
        self.emission = np.zeros((0, 3))
        self.step = np.zeros((3, 3))
        self.start = np.zeros(3)
        self.step[OUTSIDE, INSIDE] = self.start[INSIDE] = _BROKEN

    def score(self, features: list[str]) -> np.ndarray:
        rows = [self.index[f] for f in features if f in self.index]
        return self.emission[rows].sum(axis=0) if rows else np.zeros(3)

    def fit(self, windows: list[tuple[list[str], list[int], list[str]]]) -> None:
        """Maximum likelihood with a ridge, by Adam over all windows at once."""
        rows, owner, tags = [], [], np.full((len(windows), WINDOW), -1)
        for w, (tokens, labels, file) in enumerate(windows):
            for t, token in enumerate(tokens):
                kinds = kinds_of(token)
                features = kind_features(kinds) + letter_features(token, kinds) + file
                for at, side in ((t - 1, "before"), (t + 1, "after")):
                    near = tokens[at] if 0 <= at < len(tokens) else None
                    features += [f"{side} none"] if near is None else (
                        near_kind_features(kinds_of(near), side) + near_letter_features(near, side))
                rows += [self.index.setdefault(f, len(self.index)) for f in features]
                owner += [w * WINDOW + t] * len(features)
                tags[w, t] = labels[t]
        rows, owner = np.array(rows, np.int64), np.array(owner, np.int64)
        self.emission = np.zeros((len(self.index), 3))
        mask = tags >= 0
        weights = [self.emission, self.step, self.start]
        state = [(np.zeros_like(w), np.zeros_like(w)) for w in weights]
        for step in range(1, STEPS + 1):
            scores = np.stack([np.bincount(owner, self.emission[rows, k], tags.size) for k in range(3)], axis=1)
            grads = self._gradients(scores.reshape(*tags.shape, 3), tags, mask)
            per_token = grads[0].reshape(-1, 3)
            by_feature = np.stack([np.bincount(rows, per_token[owner, k], len(self.index)) for k in range(3)], axis=1)
            for w, g, (m, v) in zip(weights, [by_feature, *grads[1:]], state):
                g = g / len(windows) + RIDGE * w
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                w -= RATE * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8)
            self.step[OUTSIDE, INSIDE] = self.start[INSIDE] = _BROKEN

    def _gradients(self, scores, tags, mask):
        """Expected minus seen counts, by forward and backward sums in logarithms."""
        n, length, _ = scores.shape

        def total(x, axis):
            top = x.max(axis=axis, keepdims=True)
            return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))

        forward = np.empty_like(scores)
        backward = np.zeros_like(scores)
        forward[:, 0] = self.start + scores[:, 0]
        for t in range(1, length):
            moved = total(forward[:, t - 1, :, None] + self.step, 1) + scores[:, t]
            forward[:, t] = np.where(mask[:, t, None], moved, forward[:, t - 1])
        for t in range(length - 2, -1, -1):
            moved = total(self.step + (scores[:, t + 1] + backward[:, t + 1])[:, None], 2)
            backward[:, t] = np.where(mask[:, t + 1, None], moved, 0)
        whole = total(forward[:, -1], 1)
        expected = np.exp(forward + backward - whole[:, None, None]) * mask[:, :, None]
        seen = (tags[:, :, None] == np.arange(3)) & mask[:, :, None]
        step = np.zeros((3, 3))
        for t in range(1, length):
            pair = forward[:, t - 1, :, None] + self.step + (scores[:, t] + backward[:, t])[:, None] - whole[:, None, None]
            step += (np.exp(pair) * mask[:, t, None, None]).sum(axis=0)
            np.subtract.at(step, (tags[mask[:, t], t - 1], tags[mask[:, t], t]), 1)
        return [expected - seen, step, (expected[:, 0] - seen[:, 0]).sum(axis=0)]

    def margin(self) -> float:
        """A token whose outside score leads by more is outside on the best path, whatever its neighbours are."""
        before = np.vstack([self.step, self.start])
        after = np.hstack([self.step, np.zeros((3, 1))])
        gains = [(before[:, k, None] + after[None, k]) - (before[:, OUTSIDE, None] + after[None, OUTSIDE])
                 for k in (BEGIN, INSIDE)]
        return float(np.max(gains))

    def best_path(self, scores: np.ndarray, first: bool, last: bool) -> list[int]:
        """Viterbi over a run of tokens between outside ones, or the ends of the text."""
        value = scores[0] + (self.start if first else self.step[OUTSIDE])
        back = []
        for row in scores[1:]:
            options = value[:, None] + self.step
            back.append(options.argmax(axis=0))
            value = options.max(axis=0) + row
        if not last:
            value = value + self.step[:, OUTSIDE]
        path = [int(value.argmax())]
        for pointers in reversed(back):
            path.append(int(pointers[path[-1]]))
        return path[::-1]


class _Kinds(dict):
    """Scores of a token and of its neighbours by the kinds of its bytes."""

    def __init__(self, field: Field):
        self.field = field

    def __missing__(self, kinds: bytes) -> np.ndarray:
        score = self.field.score
        found = np.concatenate([
            score(kind_features(kinds)), score(near_kind_features(kinds, "before")), score(near_kind_features(kinds, "after"))])
        if len(self) < _REMEMBERED_KINDS:
            self[kinds] = found
        return found


class _Tokens(dict):
    """Number of each token; its row of nine scores is made when first asked for."""

    def __init__(self, field: Field, kinds: _Kinds):
        self.field, self.kinds = field, kinds
        self.rows = np.zeros((1 << 16, 9))

    def __missing__(self, token: str) -> int:
        n = len(self)
        if n == len(self.rows):
            self.rows = np.vstack([self.rows, np.zeros_like(self.rows)])
        kinds = kinds_of(token)
        self.rows[n] = self.kinds[kinds]
        letters = letter_features(token, kinds)
        if letters or len(token) <= 2:
            score = self.field.score
            self.rows[n] += np.concatenate([
                score(letters), score(near_letter_features(token, "before")), score(near_letter_features(token, "after"))])
        self[token] = n
        return n


class SpanFinder:
    """Base spans of a text and those that the field adds."""

    def __init__(self, field: Field | None):
        self.field = field
        if field is not None:
            self.kinds, self.lead = _Kinds(field), field.margin()
            self.tokens = _Tokens(field, self.kinds)
            self.no_before, self.no_after = field.score(["before none"]), field.score(["after none"])

    def spans(self, text: str) -> list[tuple[int, str, int]]:
        """Base spans, and spans of the field that meet none of them."""
        return self.both(text)[0]

    def both(self, text: str) -> tuple[list[tuple[int, str, int]], list[tuple[int, str, int]]]:
        """The spans, and all that the field finds by itself, without the patterns."""
        found, added = base_spans(text), []
        if self.field is not None:
            added = self.added(text)
            ends = [(s, e) for s, _, e in found]
            found += [(s, ADDED, e) for s, e in added if all(e <= x or y <= s for x, y in ends)]
            found.sort(key=lambda x: (x[0], (*KINDS, ADDED).index(x[1])))
        return found, [(s, ADDED, e) for s, e in added]

    def added(self, text: str) -> list[tuple[int, int]]:
        tokens = text.split()
        if not tokens:
            return []
        if len(self.tokens) > _REMEMBERED:
            self.tokens = _Tokens(self.field, self.kinds)
        ids = np.fromiter(map(self.tokens.__getitem__, tokens), np.int64, len(tokens))
        rows = self.tokens.rows[ids]
        scores = rows[:, :3] + self.field.score(file_features(text))
        scores[1:] += rows[:-1, 3:6]
        scores[:-1] += rows[1:, 6:]
        scores[0] += self.no_before
        scores[-1] += self.no_after
        open_ = np.flatnonzero(scores[:, OUTSIDE] - scores[:, :2].max(axis=1) <= self.lead)
        if not len(open_):
            return []
        marked = []
        for run in np.split(open_, np.flatnonzero(np.diff(open_) > 1) + 1):
            path = self.field.best_path(scores[run], run[0] == 0, run[-1] == len(tokens) - 1)
            for t, tag in zip(run.tolist(), path):
                if tag == BEGIN or tag == INSIDE and not (marked and marked[-1][1] == t):
                    marked.append([t, t + 1])
                elif tag == INSIDE:
                    marked[-1][1] = t + 1
        return _places(text, tokens, marked) if marked else []


def _places(text: str, tokens: list[str], marked: list[list[int]]) -> list[tuple[int, int]]:
    """Where marked runs of tokens stand in the text, without quotes and marks around them."""
    wanted = {t for run in marked for t in (run[0], run[1] - 1)}
    starts, at = {}, 0
    for t, token in enumerate(tokens):
        at = text.index(token, at)
        if t in wanted:
            starts[t] = at
        at += len(token)
    out = []
    for first, end in marked:
        low, high = starts[first], starts[end - 1] + len(tokens[end - 1])
        while low < high and text[low] in _EDGE:
            low += 1
        while low < high and text[high - 1] in _EDGE:
            high -= 1
        if low < high:
            out.append((low, high))
    return out


def _windows(text: str):
    """Tagged windows of the training texts: around the first four base spans, and one at a place that the text's length
    decides. Tokens are cut at 200 characters there."""
    spans = base_spans(text)
    places = [(m.start(), m.end()) for m in re.finditer(r"\S+", text)]
    if not places:
        return
    tags, last = [], None
    at = 0
    for low, high in places:
        while at < len(spans) and spans[at][2] <= low:
            at += 1
        hit, near = None, at
        while hit is None and near < len(spans) and spans[near][0] < high:
            hit = (spans[near][0], spans[near][2]) if low < spans[near][2] else None
            near += 1
        tags.append(OUTSIDE if hit is None else INSIDE if hit == last else BEGIN)
        last = hit
    begins = [t for t, tag in enumerate(tags) if tag == BEGIN][:4]
    for t in [*begins, (len(text) * 7919) % len(places)]:
        low = max(0, t - LEAD)
        high = min(len(places), low + WINDOW)
        if tags[low] == INSIDE:
            continue
        yield [text[s:e][:200] for s, e in places[low:high]], tags[low:high]


def fit_field(docs: DataFrame, text_column: str = "text", texts: int = TRAINING_TEXTS) -> Field | None:
    """A field fitted on windows of some ``texts`` texts, chosen by a hash of their row, with the base spans as tags.

    At most ``TRAINING_WINDOWS`` windows come to the driver. None where no window has a secret.
    """
    ship(docs.sparkSession)
    n = docs.count()
    draw = F.pmod(F.xxhash64(*(F.col(f"`{c}`") for c in docs.columns)), F.lit(1 << 30))
    chosen = docs.select(F.col(text_column).cast("string").alias("text"), draw.alias("draw"))
    chosen = chosen.where((F.col("draw") < int(min(1.0, texts / max(1, n)) * (1 << 30))) & F.col("text").isNotNull())

    def run(batches):
        for batch in batches:
            out = [[], [], [], []]
            for text, drawn in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                file = file_features(text)
                for tokens, tags in _windows(text):
                    for column, value in zip(out, (tokens, tags, file, drawn if BEGIN in tags else drawn + (1 << 31))):
                        column.append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[0], pa.list_(pa.string())), pa.array(out[1], pa.list_(pa.int32())),
                 pa.array(out[2], pa.list_(pa.string())), pa.array(out[3], pa.int64())], ["tokens", "tags", "file", "draw"])

    found = chosen.mapInArrow(run, "tokens array<string>, tags array<int>, file array<string>, draw bigint")
    with_secret = found.where(f"draw < {1 << 31}").orderBy("draw", "tokens").limit(TRAINING_WINDOWS // 2).collect()
    if not with_secret:
        return None
    without = found.where(f"draw >= {1 << 31}").orderBy("draw", "tokens").limit(TRAINING_WINDOWS // 2).collect()
    field = Field()
    field.fit([(r["tokens"], r["tags"], r["file"]) for r in [*with_secret, *without]])
    return field


SPANS = ArrayType(StructType([
    StructField("kind", StringType()), StructField("start", IntegerType()), StructField("end", IntegerType())]))


def find_secrets(docs: DataFrame, field: Field | None, text_column: str = "text", redact: str | None = None,
                 field_column: str | None = None) -> DataFrame:
    """``docs`` with ``spans``, and the text with every span replaced if ``redact`` is given.

    ``spans`` are kind, start and end (code points, end exclusive) of the base patterns and of what the field adds
    outside them, in the whole text; a null text counts as empty and stays null. Overlapping spans are replaced as one.
    ``field_column`` names a further column for all spans that the field finds by itself; it knows shapes, neighbours and
    the file, not the patterns or their words. A column ``spans`` of the input is replaced, other columns are passed on.
    """
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    source, added = text_column, [StructField(c, SPANS) for c in ("spans", field_column) if c]
    if redact is not None:
        # The text before stands under a name of its own while the new one is made.
        source = next(n for n in (f"text before {i}" for i in range(len(docs.columns) + 1)) if n not in docs.columns)
        added.append(StructField(text_column, StringType()))

    def listed_spans(spans):
        return pa.array([[{"kind": k, "start": s, "end": e} for s, k, e in f] for f in spans], arrow)

    def factory(names):
        place, finder = names.index(source), SpanFinder(field)

        def compute(batch):
            texts = batch.column(place).to_pylist()
            found = [finder.both(t or "") for t in texts]
            out = [listed_spans(f for f, _ in found)]
            if field_column:
                out.append(listed_spans(own for _, own in found))
            if redact is not None:
                out.append(pa.array([t if not f else _redacted(t, f, redact) for t, (f, _) in zip(texts, found)], pa.string()))
            return out

        return compute

    found = with_computed(docs.withColumnRenamed(text_column, source), added, factory)
    kept = docs.drop("spans", field_column) if field_column else docs.drop("spans")
    return found.select(columns_of(kept) + [F.col(f"`{c}`") for c in ("spans", field_column) if c])


def _redacted(text: str, spans: list[tuple[int, str, int]], mark: str) -> str:
    out, at = [], 0
    for start, _, end in sorted(spans):
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])


def listed(spans: Column) -> Column:
    """Spans as one string: ``kind:start:end``, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
