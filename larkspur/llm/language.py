"""Language identification with a byte convolutional network, trained and applied in numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import DoubleType, StringType, StructField

from larkspur.llm.inputs import with_computed
from larkspur.session import ship

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS, EMBEDDING = 8, 8
#: Labelled rows of a language, and windows of a row, that the network is fitted on.
ROWS_PER_LANGUAGE, WINDOWS_PER_ROW = 400, 3
#: Most languages that the network knows: the most frequent ones.
LANGUAGES = 256
#: Windows held by a task at a time.
BLOCK = 256
EPOCHS, BATCH, RATE = 12, 64, 0.01
UNKNOWN = "und"
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def has_letter(text: str) -> bool:
    """Whether any character is a letter: digits, other numbers, marks and signs are none."""
    return any(map(str.isalpha, text))


def windows_of(data: bytes) -> np.ndarray:
    """The whole text as rows of ``WINDOW`` bytes, A-Z folded to lower case, the last filled up with zeros."""
    n = max(1, -(-len(data) // WINDOW))
    out = np.zeros(n * WINDOW, np.uint8)
    out[:len(data)] = _FOLD[np.frombuffer(data, np.uint8)]
    return out.reshape(n, WINDOW)


class ByteNetwork:
    """Embedded bytes, filters of several widths, their largest response in the window, softmax."""

    def __init__(self, languages: list[str], seed: int = 0):
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.embedding = rng.normal(0, 0.5, (256, EMBEDDING)).astype(np.float32)
        self.embedding[0] = 0
        self.filters = [rng.normal(0, (w * EMBEDDING) ** -0.5, (w * EMBEDDING, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.bias = np.zeros(FILTERS * len(WIDTHS), np.float32)
        self.dense = rng.normal(0, 0.2, (FILTERS * len(WIDTHS), len(languages))).astype(np.float32)
        self.offset = np.zeros(len(languages), np.float32)

    def _weights(self) -> list[np.ndarray]:
        return [self.embedding, *self.filters, self.bias, self.dense, self.offset]

    def fit(self, rows: np.ndarray, labels: np.ndarray, seed: int = 0) -> None:
        """Adam on the cross-entropy; classes weigh the same. Only the winning place of a filter has a gradient."""
        rng = np.random.default_rng(seed)
        weight = (len(labels) / len(self.languages) / np.maximum(np.bincount(labels, minlength=len(self.languages)), 1))
        state = [(np.zeros_like(w), np.zeros_like(w)) for w in self._weights()]
        step = 0
        for _ in range(EPOCHS):
            order = rng.permutation(len(rows))
            for at in range(0, len(order), BATCH):
                step += 1
                pick = order[at:at + BATCH]
                grads = self._gradients(rows[pick], labels[pick], weight[labels[pick]])
                for w, g, (m, v) in zip(self._weights(), grads, state):
                    m += 0.1 * (g - m)
                    v += 0.01 * (g * g - v)
                    w -= RATE * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-6)
                self.embedding[0] = 0

    def _gradients(self, rows, labels, weight):
        embedded = self.embedding[rows]
        n = len(rows)
        flat, pooled, patches = embedded.reshape(n, -1), [], []
        for w, filters in zip(WIDTHS, self.filters):
            views = np.lib.stride_tricks.sliding_window_view(flat, w * EMBEDDING, axis=1)[:, ::EMBEDDING]
            response = views @ filters
            best = response.argmax(axis=1)
            pooled.append(np.take_along_axis(response, best[:, None], 1)[:, 0])
            patches.append((best, views[np.arange(n)[:, None], best]))
        hidden = np.concatenate(pooled, axis=1) + self.bias
        active = np.maximum(hidden, 0)
        logits = active @ self.dense + self.offset
        p = np.exp(logits - logits.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(n), labels] -= 1
        p *= (weight / n)[:, None].astype(np.float32)
        back = (p @ self.dense.T) * (hidden > 0)
        grad_embedding = np.zeros_like(self.embedding)
        grad_filters = []
        for k, (w, (best, patch)) in enumerate(zip(WIDTHS, patches)):
            part = back[:, k * FILTERS:(k + 1) * FILTERS]
            grad_filters.append(np.einsum("nf,nfp->pf", part, patch))
            to_bytes = (part[:, :, None] * self.filters[k].T).reshape(n, FILTERS, w, EMBEDDING)
            for j in range(w):
                at = rows[np.arange(n)[:, None], best + j]
                np.add.at(grad_embedding, at, to_bytes[:, :, j])
        return [grad_embedding, *grad_filters, back.sum(axis=0), active.T @ p, p.sum(axis=0)]

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Responses by byte pair and byte: a filter's response is a sum of two looked-up rows."""
        part = {w: f.reshape(w, EMBEDDING, FILTERS) for w, f in zip(WIDTHS, self.filters)}

        def pair(w: int, at: int) -> np.ndarray:
            first, second = self.embedding @ part[w][at], self.embedding @ part[w][at + 1]
            return (first[:, None] + second[None]).reshape(65536, FILTERS)

        return (np.concatenate([pair(w, 0) for w in WIDTHS], axis=1), self.embedding @ part[3][2], pair(4, 2))

    def predict(self, rows: np.ndarray, tables) -> np.ndarray:
        """Probabilities of the languages for every window."""
        first, third, last = tables
        wide = rows.astype(np.uint16)
        pairs = (wide[:, :-1] << 8) | wide[:, 1:]
        response = first[pairs]
        pooled = [response[:, :, :FILTERS].max(axis=1)]
        pooled.append((response[:, :-1, FILTERS:2 * FILTERS] + third[rows[:, 2:]]).max(axis=1))
        pooled.append((response[:, :-2, 2 * FILTERS:] + last[pairs[:, 2:]]).max(axis=1))
        logits = np.maximum(np.concatenate(pooled, axis=1) + self.bias, 0) @ self.dense + self.offset
        p = np.exp(logits - logits.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)


def _sample(labelled: DataFrame, per_language: int) -> list:
    """Rows of at most ``per_language`` texts of each language, chosen by a hash of id and text: language and windows."""
    counts = labelled.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()
    if not counts:
        return []
    # Somewhat more than is wanted pass the draw, so that few rows meet to be counted.
    enough = F.create_map(*(F.lit(x) for r in counts for x in (r["lang"], min(1.0, (1.5 * per_language + 50) / r["n"]))))
    draw = F.xxhash64("id", "text")
    drawn = labelled.where(F.pmod(draw, F.lit(1 << 30)) / float(1 << 30) < F.element_at(enough, F.col("lang")))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(draw, "id", "text"))
    chosen = drawn.withColumn("rank", rank).where(F.col("rank") <= per_language)

    def run(batches):
        for batch in batches:
            langs, found = [], []
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                data = text.encode()
                rng = np.random.default_rng(len(data))
                for k in range(WINDOWS_PER_ROW):
                    # Whole windows, and shorter ones so that short texts are known too.
                    n = WINDOW if k == 0 else int(rng.integers(24, WINDOW))
                    at = int(rng.integers(0, max(1, len(data) - n + 1)))
                    langs.append(lang)
                    found.append(windows_of(data[at:at + n])[0].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(found, pa.binary())], ["lang", "window"])

    return chosen.select("lang", "text").mapInArrow(run, "lang string, window binary").collect()


def fit_network(labelled: DataFrame, text_column: str = "text", lang_column: str = "lang", id_column: str = "doc_id",
                per_language: int = ROWS_PER_LANGUAGE) -> ByteNetwork:
    """A network fitted on at most ``per_language`` texts of each of the ``LANGUAGES`` most frequent values of ``lang_column``.

    The id only takes part in the draw of these rows, so copies of a text under several ids are drawn one by one and do
    not crowd out others. Rows without a language, text or letter are left out; with none left the network knows no
    language.
    """
    ship(labelled.sparkSession)
    rows = labelled.select(F.col(f"`{lang_column}`").cast("string").alias("lang"), F.col(f"`{text_column}`").cast("string").alias("text"),
                           F.col(f"`{id_column}`").cast("string").alias("id"))
    rows = _sample(rows.where("lang IS NOT NULL AND text RLIKE '\\\\p{L}'"), per_language)
    languages = sorted({r["lang"] for r in rows})
    network = ByteNetwork(languages)
    if languages:
        rows.sort(key=lambda r: (r["lang"], bytes(r["window"])))
        windows = np.stack([np.frombuffer(r["window"], np.uint8) for r in rows])
        network.fit(windows, np.array([languages.index(r["lang"]) for r in rows]))
    return network


def predict_language(docs: DataFrame, network: ByteNetwork, text_column: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``: the language of the whole text and its mean probability.

    Every window of the text is classified and counts by its bytes. A null text, one without a letter, and any text if
    the network knows no language, is ``und`` with score 0. Columns of the result's names are replaced; other columns
    are passed on as they are.
    """
    tables_of, languages = network.tables, network.languages

    def factory(names):
        place, tables = names.index(text_column), tables_of()

        def compute(batch):
            texts = [None if t is None or not has_letter(t) or not languages else t.encode()
                     for t in batch.column(place).cast(pa.string()).to_pylist()]
            totals = np.zeros((len(texts), max(1, len(languages))))
            held, owner, sizes = [], [], []

            def classify():
                if held:
                    p = network.predict(np.concatenate(held), tables)
                    np.add.at(totals, np.array(owner), p * np.array(sizes)[:, None])
                    held.clear(), owner.clear(), sizes.clear()

            for i, data in enumerate(texts):
                for at in range(0, len(data or b""), BLOCK * WINDOW):
                    rows = windows_of(data[at:at + BLOCK * WINDOW])
                    last = (len(data) - at) - (len(rows) - 1) * WINDOW
                    held.append(rows)
                    owner += [i] * len(rows)
                    sizes += [WINDOW] * (len(rows) - 1) + [min(last, WINDOW)]
                    if len(owner) >= BLOCK:
                        classify()
            classify()
            best = totals.argmax(axis=1)
            size = np.array([len(t or b"") for t in texts])
            score = totals[np.arange(len(texts)), best] / np.maximum(size, 1)
            found = [UNKNOWN if t is None else languages[b] for t, b in zip(texts, best)]
            return [pa.array(found, pa.string()), pa.array(np.clip(score, 0.0, 1.0), pa.float64())]

        return compute

    return with_computed(docs, [StructField("lang_pred", StringType()), StructField("score", DoubleType())], factory)
