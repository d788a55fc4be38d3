"""Running user-supplied batch embedding functions over columns.

An embedder is a factory: called once per task without arguments it returns a
function from a list of inputs to a list (or matrix) of vectors. Spark splits
the column into tasks and Arrow batches; the code here only decides how one
task calls that function: batch size, pace, retries and what to do on failure.
Failures become rows, never exceptions, unless ``on_error='raise'``.
"""

from __future__ import annotations

import hashlib
import re
import time
from collections import deque
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass, replace
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from larkspur.session import spread

BatchFunction = Callable[[Sequence], Sequence]
EmbedderFactory = Callable[[], BatchFunction]

EMBED_FAILED = "Embedding failed"
EMPTY_IMAGE = "Image bytes cannot be empty"
BREAKER_OPEN = "circuit breaker open"

RESULT_TYPE = "vector array<float>, success boolean, error_message string, cause string, batch_size int"
_RESULT = pa.schema([("vector", pa.list_(pa.float32())), ("success", pa.bool_()), ("error_message", pa.string()),
                     ("cause", pa.string()), ("batch_size", pa.int32())])

#: Outcomes that a task holds at a time.
BLOCK_ROWS = 256

# Errors of the program itself: another attempt cannot help.
NEVER_RETRIED = (TypeError, AttributeError, KeyError)


class UpstreamError(RuntimeError):
    """The embedding function returned something unusable."""


@dataclass(frozen=True)
class EmbedPolicy:
    """How one task calls the embedding function."""

    batch_size: int = 12
    min_batch: int = 1
    max_batch: int = 12
    adaptive: bool = False
    fallback_individual: bool = False
    attempts: int = 1
    wait_min: float = 2.0
    wait_max: float = 10.0
    multiplier: float = 1.0
    calls_per_second: float | None = None
    breaker_failures: int | None = None
    breaker_recovery_s: float = 30.0
    partitions: int | None = None  # of the input; rows of one partition share batches
    on_error: str = "capture"

    def __post_init__(self):
        if not 1 <= self.min_batch <= self.batch_size <= self.max_batch:
            raise ValueError("need 1 <= min_batch <= batch_size <= max_batch")
        if self.on_error not in ("capture", "raise"):
            raise ValueError("on_error must be 'capture' or 'raise'")


TEXT_POLICY = EmbedPolicy()
IMAGE_POLICY = EmbedPolicy(batch_size=8, max_batch=8)


def next_batch_size(current: int, ok: bool, policy: EmbedPolicy) -> int:
    """One more after a success, half after a failure, within the bounds."""
    if not policy.adaptive:
        return current
    return min(current + 1, policy.max_batch) if ok else max(current // 2, policy.min_batch)


class _Caller:
    """State of one task: pace, retry, breaker and current batch size."""

    def __init__(self, embed: BatchFunction, policy: EmbedPolicy, interval: float,
                 clock=time.monotonic, sleep=time.sleep):
        self.embed, self.policy, self.interval = embed, policy, interval
        self.clock, self.sleep = clock, sleep
        self.size = policy.batch_size
        self.next_call = 0.0
        self.failures = 0
        self.opened_at: float | None = None

    def _pace(self):
        if self.interval:
            now = self.clock()
            if now < self.next_call:
                self.sleep(self.next_call - now)
            self.next_call = max(now, self.next_call) + self.interval

    def _call(self, items: list) -> np.ndarray:
        self._pace()
        vectors = self.embed(items)
        if len(vectors) != len(items):
            raise UpstreamError(f"upstream returned {len(vectors)} vectors for {len(items)} inputs")
        return [np.asarray(v, dtype=np.float32) for v in vectors]

    def _call_with_retry(self, items: list):
        for attempt in range(1, self.policy.attempts + 1):
            try:
                return self._call(items)
            except NEVER_RETRIED:
                raise
            except Exception:
                if attempt == self.policy.attempts:
                    raise
                wait = self.policy.multiplier * 2 ** (attempt - 1)
                self.sleep(min(max(wait, self.policy.wait_min), self.policy.wait_max))

    def _blocked(self) -> bool:
        if self.opened_at is None:
            return False
        # After the recovery time one trial call is let through.
        return self.clock() - self.opened_at < self.policy.breaker_recovery_s

    def _record(self, ok: bool):
        if ok:
            self.failures, self.opened_at = 0, None
            return
        self.failures += 1
        limit = self.policy.breaker_failures
        if limit and self.failures >= limit:
            self.opened_at = self.clock()

    def _attempt(self, items: list) -> list[tuple]:
        if self._blocked():
            return [(None, EMBED_FAILED, BREAKER_OPEN)] * len(items)
        try:
            vectors = self._call_with_retry(items)
            self._record(True)
            return [(v, None, None) for v in vectors]
        except Exception as error:
            self._record(False)
            if self.policy.on_error == "raise":
                raise
            return [(None, EMBED_FAILED, f"{type(error).__name__}: {error}")] * len(items)

    def run(self, items: Iterable) -> list[tuple]:
        """``(vector, error_message, cause, batch_size)`` for each input."""
        return list(self.results(items))

    def results(self, items: Iterable) -> Iterator[tuple]:
        """The same one by one; inputs are taken call by call."""
        items = iter(items)
        while batch := list(islice(items, size := self.size)):
            relaxed = self.policy.fallback_individual and len(batch) > 1
            strict = self.policy
            if relaxed:
                self.policy = replace(strict, on_error="capture")
            rows = self._attempt(batch)
            self.policy = strict
            ok = rows[0][1] is None
            if not ok and self.policy.fallback_individual and len(batch) > 1:
                rows = [self._attempt([item])[0] for item in batch]
            self.size = next_batch_size(size, ok, self.policy)
            yield from ((*row, size) for row in rows)


def _outcomes(caller: _Caller, items: Iterable, invalid: Callable[[object], str | None]) -> Iterator[tuple]:
    """``RESULT_TYPE`` of each item, in order; no more items are held than one call takes, and invalid ones between."""
    problems: deque[str | None] = deque()

    def valid() -> Iterator:
        for item in items:
            problems.append(invalid(item))
            if problems[-1] is None:
                yield item

    for vector, message, cause, size in caller.results(valid()):
        while (problem := problems.popleft()) is not None:
            yield None, False, problem, None, None
        yield vector, message is None, message, cause, size
    for problem in problems:
        yield None, False, problem, None, None


def _run_batch(caller: _Caller, items: Iterable, invalid: Callable[[object], str | None]) -> Iterator[pa.StructArray]:
    """Outcomes of one Arrow batch, ``BLOCK_ROWS`` at a time."""
    rows = _outcomes(caller, items, invalid)
    while block := list(islice(rows, BLOCK_ROWS)):
        columns = [pa.array(column, field.type, from_pandas=True) for column, field in zip(zip(*block), _RESULT)]
        yield pa.StructArray.from_arrays(columns, fields=list(_RESULT))


def _blank_text(text) -> str | None:
    return "Text cannot be empty" if text is None or not text.strip() else None


def _empty_image(data) -> str | None:
    return EMPTY_IMAGE if data is None or len(data) == 0 else None


def _task_interval(spark: SparkSession, policy: EmbedPolicy) -> float:
    """Seconds between two calls of one task.

    Tasks share no clock, so each of the tasks that can run at a time gets an
    equal share of the rate: the total stays at or below the limit.
    """
    if not policy.calls_per_second:
        return 0.0
    return max(1, spark.sparkContext.defaultParallelism) / policy.calls_per_second


def _embed_struct(factory, policy, interval, invalid) -> Callable[..., Column]:
    @F.arrow_udf(RESULT_TYPE)
    def embed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        caller = _Caller(factory(), policy, interval)
        for batch in batches:
            yield from _run_batch(caller, (item.as_py() for item in batch), invalid)

    return embed.asNondeterministic()


def _embed_pair_struct(factory, policy, interval) -> Callable[..., Column]:
    @F.arrow_udf(RESULT_TYPE)
    def embed(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        function = factory()
        caller = _Caller(lambda pairs: function([p[0] for p in pairs], [p[1] for p in pairs]), policy, interval)
        for images, texts in batches:
            pairs = ((image.as_py(), text.as_py()) for image, text in zip(images, texts))
            yield from _run_batch(caller, pairs, lambda pair: _empty_image(pair[0]))

    return embed.asNondeterministic()


def _with_result(df: DataFrame, result: Column, out: str) -> DataFrame:
    fields = {
        out: F.col("_embedded.vector"),
        "success": F.col("_embedded.success"),
        "error_message": F.col("_embedded.error_message"),
        "cause": F.col("_embedded.cause"),
        "batch_size": F.col("_embedded.batch_size"),
    }
    return df.withColumn("_embedded", result).withColumns(fields).drop("_embedded")


def embed_column(
    df: DataFrame, column: str, embedder: str | EmbedderFactory, out: str = "vector",
    policy: EmbedPolicy = TEXT_POLICY,
) -> DataFrame:
    """Add a vector for each text, with ``success, error_message, cause, batch_size``.

    Only the text column travels to Python. Blank text is a failed row.
    Stage the result before deriving several outputs from it.
    """
    factory = get_embedder(embedder)
    udf = _embed_struct(factory, policy, _task_interval(df.sparkSession, policy), _blank_text)
    return _with_result(spread(df, policy.partitions), udf(F.col(column)), out)


def embed_images(
    df: DataFrame, column: str, embedder: str | EmbedderFactory, out: str = "vector",
    policy: EmbedPolicy = IMAGE_POLICY,
) -> DataFrame:
    """Add a vector for each image in a binary column; empty images are failed rows."""
    factory = get_embedder(embedder)
    udf = _embed_struct(factory, policy, _task_interval(df.sparkSession, policy), _empty_image)
    return _with_result(spread(df, policy.partitions), udf(F.col(column)), out)


def embed_image_text(
    df: DataFrame, image: str, text: str, embedder: str | EmbedderFactory, out: str = "vector",
    policy: EmbedPolicy = IMAGE_POLICY,
) -> DataFrame:
    """Add a vector for each image with its text; both come from one row, so they always pair up."""
    factory = get_embedder(embedder)
    udf = _embed_pair_struct(factory, policy, _task_interval(df.sparkSession, policy))
    return _with_result(spread(df, policy.partitions), udf(F.col(image), F.col(text)), out)


_registry: dict[str, EmbedderFactory] = {}


def register_embedder(name: str, factory: EmbedderFactory) -> None:
    _registry[name] = factory


def get_embedder(embedder: str | EmbedderFactory) -> EmbedderFactory:
    if callable(embedder):
        return embedder
    if embedder not in _registry:
        raise ValueError(f"unknown embedder {embedder!r}; registered: {', '.join(sorted(_registry)) or 'none'}")
    return _registry[embedder]


def register_sql_embedder(spark: SparkSession, name: str, embedder: str | EmbedderFactory,
                          policy: EmbedPolicy = TEXT_POLICY) -> None:
    """Make an embedder an SQL function from text to a struct with the vector and the outcome."""
    factory = get_embedder(embedder)
    spark.udf.register(name, _embed_struct(factory, policy, _task_interval(spark, policy), _blank_text))


def embedder_names() -> list[str]:
    return sorted(_registry)


# Deterministic embedder for tests and benchmarks -----------------------------

_token = re.compile(r"[a-z0-9]+")


def token_slot(token: str, dim: int) -> tuple[int, int]:
    """Position and sign of a token from its md5."""
    digest = hashlib.md5(token.encode()).hexdigest()
    return int(digest[:8], 16) % dim, 1 if int(digest[8], 16) < 8 else -1


class HashingEmbedder:
    """Signed token counts by hashed position, scaled to unit length.

    Tokens are runs of ASCII letters and digits of the lower-cased text. The
    result depends on the text alone and can be repeated in SQL.
    """

    def __init__(self, dim: int = 64):
        self.dim = dim

    def __call__(self) -> BatchFunction:
        dim = self.dim
        slots: dict[str, tuple[int, int]] = {}

        def embed(texts: Sequence[str]) -> np.ndarray:
            out = np.zeros((len(texts), dim))
            for row, text in enumerate(texts):
                positions, signs = [], []
                for token in _token.findall(text.lower()):
                    slot = slots.get(token)
                    if slot is None:
                        if len(slots) >= 200_000:
                            slots.clear()
                        slot = slots[token] = token_slot(token, dim)
                    positions.append(slot[0])
                    signs.append(slot[1])
                if positions:
                    out[row] = np.bincount(positions, weights=signs, minlength=dim)
            lengths = np.sqrt((out * out).sum(axis=1, keepdims=True))
            return (out / np.maximum(lengths, 1e-12)).astype(np.float32)

        return embed


def hashing_embedder(dim: int = 64) -> EmbedderFactory:
    return HashingEmbedder(dim)


class ByteHistogramEmbedder:
    """Share of each of the 64 highest-bit groups among the bytes: a stand-in for an image model."""

    def __call__(self) -> BatchFunction:
        def embed(images: Sequence[bytes]) -> np.ndarray:
            counts = np.stack([np.bincount(np.frombuffer(b, np.uint8) >> 2, minlength=64) for b in images])
            lengths = np.sqrt((counts.astype(float) ** 2).sum(axis=1, keepdims=True))
            return (counts / np.maximum(lengths, 1e-12)).astype(np.float32)

        return embed


register_embedder("hashing", hashing_embedder())
register_embedder("byte_histogram", ByteHistogramEmbedder())
