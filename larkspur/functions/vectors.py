"""Vector arithmetic on ``array<float>`` columns, accumulated in double."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Metric name -> True when a larger raw value means closer.
METRICS = {"ip": True, "cosine": True, "l2": False, "l1": False}


def resolve_metric(name: str) -> str:
    """Canonical metric name; the lookup ignores case."""
    key = str(name).lower()
    if key not in METRICS:
        raise ValueError(f"unknown metric {name!r}; known metrics: {', '.join(METRICS)}")
    return key


def vector_literal(values) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def _fold(left: Column, right: Column, term) -> Column:
    pairs = F.zip_with(left, right, lambda x, y: term(x.cast("double"), y.cast("double")))
    return F.aggregate(pairs, F.lit(0.0), lambda acc, x: acc + x)


def dot(left: Column, right: Column) -> Column:
    return _fold(left, right, lambda x, y: x * y)


def norm(vector: Column) -> Column:
    squares = F.aggregate(vector, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))
    return F.sqrt(squares)


def l2_normalise(vector: Column) -> Column:
    """Unit-length copy as ``array<float>``; the zero vector stays zero.

    The length is passed in through an array of one element, so that it is
    worked out once per vector and not once per coordinate.
    """
    length = F.array(F.greatest(norm(vector), F.lit(1e-12)))
    scaled = F.transform(length, lambda n: F.transform(vector, lambda x: (x.cast("double") / n).cast("float")))
    return scaled[0]


def cosine(left: Column, right: Column) -> Column:
    """Cosine similarity, 0.0 when either vector is zero."""
    scale = norm(left) * norm(right)
    return F.when(scale > 0, dot(left, right) / scale).otherwise(F.lit(0.0))


def raw_similarity(left: Column, right: Column, metric: str) -> Column:
    """The metric itself: a similarity for ip and cosine, a distance for l2 and l1."""
    metric = resolve_metric(metric)
    if metric == "ip":
        return dot(left, right)
    if metric == "cosine":
        return cosine(left, right)
    if metric == "l2":
        return F.sqrt(_fold(left, right, lambda x, y: (x - y) * (x - y)))
    return _fold(left, right, lambda x, y: F.abs(x - y))


def similarity(left: Column, right: Column, metric: str = "cosine") -> Column:
    """Ranking score, higher is better for every metric (distances are negated)."""
    raw = raw_similarity(left, right, metric)
    return raw if METRICS[resolve_metric(metric)] else -raw


def to_score(certainty: Column, distance: Column) -> Column:
    """Certainty if present, else ``1 - distance`` held in [0, 1], else 0.0."""
    held = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(1.0) - distance.cast("double")))
    return F.coalesce(certainty.cast("double"), F.when(distance.isNotNull(), held), F.lit(0.0))


def score01(score: Column) -> Column:
    """A raw cosine score held in the [0, 1] range of the response."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))


def pad_ids(ids: Column, k: int) -> Column:
    """The first ``k`` ids, padded at the end with -1."""
    filler = F.array_repeat(F.lit(-1).cast("bigint"), k)
    return F.slice(F.concat(F.coalesce(ids, F.array().cast("array<bigint>")), filler), 1, k)


def has_dimension(vector: Column, dim: int) -> Column:
    return vector.isNotNull() & (F.size(vector) == dim)
