"""Toxicity categories by a classifier chain of linear models."""

from __future__ import annotations

import re
import zlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType, StructField

from larkspur.llm.inputs import with_computed
from larkspur.session import ship

#: Labelled rows that the chain is fitted on, words that a category selects, folds, ridge.
TRAINING_ROWS, WORDS, FOLDS, RIDGE = 12_000, 160, 5, 0.1
#: Labelled texts that share one of this many least shingle hashes count once.
SIGNATURES = 4
#: Words whose place a task remembers.
REMEMBERED = 100_000
_WORD = re.compile(r"[^\W\d_]+")
_CLASSES = [range(65, 91), range(97, 123), range(48, 58), [*range(33, 48), *range(58, 65)], [10], range(128, 256)]
_KINDS = np.zeros(256, np.int64)
for _k, _bytes in enumerate(_CLASSES, 1):
    _KINDS[list(_bytes)] = _k


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def shape_of(text: str, words: list[str], distinct: int) -> list[float]:
    """Length, repetition and shares of kinds of bytes."""
    data = np.frombuffer(text.encode(), np.uint8)
    kinds = np.bincount(_KINDS[data], minlength=len(_CLASSES) + 1)[1:] / max(1, len(data))
    return [np.log1p(len(words)), distinct / max(1, len(words)), *kinds.tolist()]


def _word_id(word: str) -> int:
    return zlib.crc32(word.encode())


def _signatures(words: list[str]) -> list[int]:
    """Least hashes of three-word runs under several seeds: near copies agree in some."""
    runs = [" ".join(words[i:i + 3]).encode() for i in range(max(1, len(words) - 2))]
    hashes = np.fromiter(map(zlib.crc32, runs), np.uint64, len(runs))
    out = []
    for seed in range(SIGNATURES):
        mixed = (hashes + np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15)
        out.append(int((mixed >> np.uint64(32)).min()))
    return out


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit_linear(x: np.ndarray, y: np.ndarray, ridge: float = RIDGE) -> np.ndarray:
    """Logistic regression by Newton steps; the last column of ``x`` is the constant and is not shrunk."""
    w = np.zeros(x.shape[1])
    shrink = np.full(x.shape[1], ridge)
    shrink[-1] = 1e-6
    for _ in range(12):
        p = _sigmoid(x @ w)
        curve = np.maximum(p * (1 - p), 1e-6)
        step = np.linalg.solve((x * curve[:, None]).T @ x + np.diag(shrink), x.T @ (p - y) + shrink * w)
        w -= step
        if np.abs(step).max() < 1e-4:
            break
    return w


class Chain:
    """Linear models in order; each sees the words it selected, the text's shape and the earlier probabilities."""

    def __init__(self, categories: Sequence[str]):
        self.categories = list(categories)
        self.words: dict[int, int] = {}
        self.columns: list[np.ndarray] = []
        self.weights: list[np.ndarray] = []

    def fit(self, words: list[np.ndarray], shapes: np.ndarray, labels: np.ndarray, folds: np.ndarray) -> None:
        """``words``: distinct word ids of each text; ``labels``: a column for each category, NaN where not known."""
        flat = np.concatenate(words) if words else np.empty(0, np.int64)
        ids, column = np.unique(flat, return_inverse=True)
        owner = np.repeat(np.arange(len(words)), [len(w) for w in words])
        # The texts that a model learns from: all but one fold each, then all. Its words come from these alone.
        parts = [folds != fold for fold in range(FOLDS)] + [np.ones(len(words), bool)]
        chosen = [[_selected(column, owner, np.where(part, labels[:, c], np.nan), len(ids)) for part in parts]
                  for c in range(labels.shape[1])]
        every = np.unique(np.concatenate([x for own in chosen for x in own])) if chosen else np.empty(0, np.int64)
        place = np.full(len(ids), -1)
        place[every] = np.arange(len(every))
        present = np.zeros((len(words), len(every)), np.uint8)
        known = place[column] >= 0
        present[owner[known], place[column[known]]] = 1
        kept = np.unique(np.concatenate([own[-1] for own in chosen])) if chosen else np.empty(0, np.int64)
        self.words = {int(ids[j]): k for k, j in enumerate(kept)}
        self.mean, self.spread = shapes.mean(axis=0), shapes.std(axis=0) + 1e-6
        earlier = np.empty((len(words), 0))
        for c in range(labels.shape[1]):
            y = labels[:, c]
            has = ~np.isnan(y)
            out_of_fold = np.empty(len(y))
            for fold in range(FOLDS):
                out, fit = folds == fold, has & parts[fold]
                words_used, fit = (chosen[c][fold], fit) if fit.any() else (chosen[c][-1], has)
                x = self._features(present[:, place[words_used]], shapes, earlier)
                out_of_fold[out] = _sigmoid(x[out] @ fit_linear(x[fit], y[fit]))
            x = self._features(present[:, place[chosen[c][-1]]], shapes, earlier)
            self.weights.append(fit_linear(x[has], y[has]))
            self.columns.append(np.searchsorted(kept, chosen[c][-1]))
            # Later models learn from what this one says of texts it has not seen.
            earlier = np.column_stack([earlier, out_of_fold])

    def _features(self, present, shapes, earlier):
        scaled = (shapes - self.mean) / self.spread
        return np.column_stack([present, scaled, earlier, np.ones(len(shapes))])

    def predict(self, present: np.ndarray, shapes: np.ndarray) -> np.ndarray:
        """A column of probabilities for each category."""
        earlier = np.empty((len(shapes), 0))
        for c, w in enumerate(self.weights):
            earlier = np.column_stack([earlier, _sigmoid(self._features(present[:, self.columns[c]], shapes, earlier) @ w)])
        return earlier


def _selected(column, owner, labels, n) -> np.ndarray:
    """The words most associated with a category, by their chi-square over texts."""
    has = ~np.isnan(labels)
    positive = np.bincount(column[(labels == 1)[owner]], minlength=n).astype(float)
    total = np.bincount(column[has[owner]], minlength=n).astype(float)
    rows, hits = has.sum(), (labels == 1).sum()
    expected = total * hits / max(1, rows)
    score = (positive - expected) ** 2 / np.maximum(expected * (1 - total / max(1, rows + 1)), 1e-9)
    score[total < 5] = 0
    return np.sort(np.argsort(-score, kind="stable")[:WORDS])


def fit_chain(docs: DataFrame, labels: DataFrame, categories: Sequence[str], id_column: str = "doc_id",
              text_column: str = "text", rows: int = TRAINING_ROWS) -> Chain:
    """A chain fitted on at most ``rows`` labelled texts, chosen by a hash of the id.

    ``labels`` has the id and a 0/1 column for each category, in the order of the chain; a null is a label not known.
    An id with several rows counts as labelled where any of them is; of its texts the one with the least hash is taken.
    Copies and near copies of a text count once, so that a crowd of them does not make its own words telling. A model
    selects at most ``WORDS`` words. With no labelled text every probability is 0.
    """
    ship(docs.sparkSession)
    known = labels.where(F.col(id_column).isNotNull()).groupBy(F.col(id_column).alias("_id")).agg(
        *(F.max(F.col(c).cast("double")).alias(f"_label{i}") for i, c in enumerate(categories)))
    # At most the documented number of rows, so small enough to broadcast.
    known = F.broadcast(known.orderBy(F.xxhash64("_id"), "_id").limit(rows))
    marks = [f"_label{i}" for i in range(len(categories))]
    texts = docs.select(F.col(id_column).alias("_id"), F.col(text_column).cast("string").alias("_text")).join(known, "_id")

    def run(batches):
        for batch in batches:
            out = [[], [], []]
            for text in batch.column(0).to_pylist():
                words = words_of(text)
                distinct = sorted({_word_id(w) for w in words})
                out[0].append(np.array(distinct, np.uint32).tobytes())
                out[1].append(shape_of(text, words, len(distinct)))
                out[2].append(_signatures(words))
            yield pa.RecordBatch.from_arrays(
                [batch.column(1).cast(pa.string()), pa.array(out[0], pa.binary()), pa.array(out[1], pa.list_(pa.float64())),
                 pa.array(out[2], pa.list_(pa.int64())), *batch.columns[2:]], ["id", "words", "shape", "signatures", *marks])

    schema = "id string, words binary, shape array<double>, signatures array<bigint>, " + ", ".join(f"{m} double" for m in marks)
    found = texts.where("_text IS NOT NULL").select("_text", "_id", *marks).mapInArrow(run, schema)
    # One row for each of the ids above, however often an id is repeated.
    own = [c for c in found.columns if c != "id"]
    found = found.groupBy("id").agg(F.min_by(F.struct(*own), F.xxhash64("words", "shape")).alias("r")).select("id", "r.*").collect()
    found.sort(key=lambda r: (zlib.crc32(r["id"].encode()), r["id"], bytes(r["words"])))
    seen: set = set()
    kept = []
    for r in found:
        own = set(enumerate(r["signatures"]))
        if not own & seen:
            kept.append(r)
        seen |= own
    chain = Chain(categories)
    if kept:
        chain.fit([np.frombuffer(r["words"], np.uint32).astype(np.int64) for r in kept],
                  np.array([r["shape"] for r in kept]),
                  np.array([[np.nan if r[m] is None else r[m] for m in marks] for r in kept], float),
                  np.array([zlib.crc32(r["id"].encode()) % FOLDS for r in kept]))
    return chain


class _Places(dict):
    """Word to its place among the selected words, remembered for the words of a task."""

    def __init__(self, words: dict[int, int]):
        self.selected = words

    def __missing__(self, word: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = found = self.selected.get(_word_id(word), -1)
        return found


def predict_categories(docs: DataFrame, chain: Chain, text_column: str = "text") -> DataFrame:
    """``docs`` with a probability ``p_<category>`` for each category of the chain, from the whole text.

    A null text counts as empty. Columns of the result's names are replaced, other columns are passed on.
    """
    names = [f"p_{c}" for c in chain.categories]

    def factory(kept):
        place, places = kept.index(text_column), _Places(chain.words)

        def compute(batch):
            texts = [t or "" for t in batch.column(place).cast(pa.string()).to_pylist()]
            p = np.zeros((len(texts), len(names)))
            if chain.weights and texts:
                present, shapes = np.zeros((len(texts), len(chain.words))), []
                for i, text in enumerate(texts):
                    words = words_of(text)
                    distinct = set(words)
                    found = set(map(places.__getitem__, distinct))
                    found.discard(-1)
                    present[i, list(found)] = 1
                    shapes.append(shape_of(text, words, len(distinct)))
                p = chain.predict(present, np.array(shapes))
            return [pa.array(p[:, c], pa.float64()) for c in range(len(names))]

        return compute

    return with_computed(docs, [StructField(n, DoubleType()) for n in names], factory)
