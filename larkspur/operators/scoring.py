"""Top-k scoring of vector rows inside a task.

Spark partitions the collection and streams each partition through
``mapInArrow``. A task keeps, for each query, its best ``k`` rows, so at most
``k`` rows per query leave a task and one small shuffle by query merges them.
No pair of query and row is ever materialised as a row.

Scores are first estimated with a float32 matrix product. Rows whose estimate
lies within the rounding error of the k-th best are kept, and only those are
scored again in double, row by row, so equal vectors get equal scores and the
result does not depend on how rows were batched.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa

_ESTIMATE_CELLS = 4_000_000
_EXACT_CELLS = 8_000_000
_FLOAT32_STEP = 6e-8
# Candidates per query, as a multiple of k, from which a batch is searched for copies.
_CROWD = 8


@dataclass
class QueryBlock:
    """A bounded set of queries, shipped to the tasks as a broadcast value."""

    ids: np.ndarray
    vectors: np.ndarray
    columns: dict[str, np.ndarray] = field(default_factory=dict)

    def __len__(self) -> int:
        return len(self.ids)

    @property
    def dim(self) -> int:
        return self.vectors.shape[1]

    def take(self, chosen: np.ndarray) -> QueryBlock:
        """The chosen queries."""
        return QueryBlock(self.ids[chosen], self.vectors[chosen], {c: v[chosen] for c, v in self.columns.items()})


def matrix(column: pa.Array, dim: int | None = None) -> np.ndarray:
    """Rows of a non-null list column as a matrix, without copying the values.

    Rows must have the same length, ``dim`` when it is given.
    """
    lengths = np.diff(column.offsets.to_numpy())
    dim = dim if dim is not None else int(lengths[0]) if len(lengths) else 0
    if (lengths != dim).any():
        wrong = int(lengths[lengths != dim][0])
        raise ValueError(f"vector with {wrong} dimensions among vectors with {dim}")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim)


def sortable(column: pa.Array) -> np.ndarray:
    out = column.to_numpy(zero_copy_only=False)
    return out.astype(str) if out.dtype == object else out


def pair_scores(queries: np.ndarray, rows: np.ndarray, metric: str) -> np.ndarray:
    """Exact scores of matching rows of two matrices, each worked out by itself in double."""
    a, b = queries.astype(np.float64, copy=False), rows.astype(np.float64)
    if metric == "l2":
        return -np.sqrt(((a - b) ** 2).sum(axis=1))
    if metric == "l1":
        return -np.abs(a - b).sum(axis=1)
    product = (a * b).sum(axis=1)
    if metric == "ip":
        return product
    lengths = np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1))
    return np.where(lengths > 0, product / np.where(lengths > 0, lengths, 1.0), 0.0)


class Scorer:
    """Estimate and exact score of one metric; larger is better."""

    def __init__(self, queries: np.ndarray, metric: str):
        self.metric = metric
        self.exact_queries = np.asarray(queries, dtype=np.float64)
        self.query_norms = np.sqrt((self.exact_queries ** 2).sum(axis=1))
        self.dim = queries.shape[1]
        base = self.exact_queries
        if metric == "cosine":
            base = base / np.where(self.query_norms > 0, self.query_norms, 1.0)[:, None]
        self.fast_queries = np.ascontiguousarray(base.astype(np.float32))

    def prepare(self, rows: np.ndarray):
        wide = rows.astype(np.float64, copy=False)
        self.rows = rows
        self.row_norms = np.sqrt((wide * wide).sum(axis=1))
        if self.metric == "cosine":
            scale = np.where(self.row_norms > 0, self.row_norms, 1.0)
            self.fast_rows = (wide / scale[:, None]).astype(np.float32)
        else:
            self.fast_rows = rows.astype(np.float32, copy=False)

    def estimate(self, row_idx: np.ndarray | slice, query_idx: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Estimated scores ``(queries, rows)`` on a monotone scale and their error bound per query."""
        rows, queries = self.fast_rows[row_idx], self.fast_queries[query_idx]
        slack = (self.dim + 16) * _FLOAT32_STEP
        if self.metric == "l1":
            out = np.empty((len(queries), len(rows)), dtype=np.float32)
            for i, q in enumerate(queries):
                out[i] = -np.abs(rows - q).sum(axis=1)
            reach = np.abs(rows).sum(axis=1).max(initial=0.0) + np.abs(queries).sum(axis=1)
            return out, slack * reach
        product = queries @ rows.T
        if self.metric == "cosine":
            return product, np.full(len(queries), slack)
        norms = self.row_norms[row_idx]
        query_norms = self.query_norms[query_idx]
        if self.metric == "ip":
            return product, slack * query_norms * norms.max(initial=0.0)
        squared = (norms ** 2)[None, :] + (query_norms ** 2)[:, None] - 2.0 * product
        return -squared, 4 * slack * (query_norms ** 2 + norms.max(initial=0.0) ** 2)

    def scale(self, score: np.ndarray) -> np.ndarray:
        """Exact scores on the scale of the estimates."""
        return -(score ** 2) if self.metric == "l2" else score

    def exact(self, row_idx: np.ndarray, query_idx: np.ndarray) -> np.ndarray:
        out = np.empty(len(row_idx))
        step = max(1, _EXACT_CELLS // max(1, self.dim))
        for lo in range(0, len(row_idx), step):
            r, q = row_idx[lo:lo + step], query_idx[lo:lo + step]
            out[lo:lo + step] = pair_scores(self.exact_queries[q], self.rows[r], self.metric)
        return out


class TopK:
    """Best ``k`` rows per query seen so far by this task; ties go to the smaller id."""

    def __init__(self, n_queries: int, k: int):
        self.k = k
        self.query = np.empty(0, dtype=np.int64)
        self.score = np.empty(0)
        self.id: np.ndarray | None = None
        self.floor = np.full(n_queries, -np.inf)
        self.crowded = False

    def note_crowd(self, candidates: int, queries: int):
        """Remember that a block had far more candidates than results: many rows tie."""
        self.crowded = self.crowded or candidates > _CROWD * self.k * queries

    def add(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray):
        if len(query) == 0:
            return
        # Only the rows held for the same queries are sorted again.
        touched = np.zeros(len(self.floor), dtype=bool)
        touched[query] = True
        again = touched[self.query]
        rest = (self.query[~again], self.score[~again], None if self.id is None else self.id[~again])
        query = np.concatenate([self.query[again], query])
        score = np.concatenate([self.score[again], score])
        ids = ids if self.id is None else np.concatenate([self.id[again], ids])
        order = np.lexsort((ids, -score, query))
        query, score, ids = query[order], score[order], ids[order]
        place = _places(query)
        keep = place < self.k
        query, score, ids = query[keep], score[keep], ids[keep]
        last = place[keep] == self.k - 1
        self.floor[query[last]] = score[last]
        self.query, self.score = np.concatenate([rest[0], query]), np.concatenate([rest[1], score])
        self.id = ids if rest[2] is None else np.concatenate([rest[2], ids])

    def batches(self, query_ids: np.ndarray, query_type: pa.DataType, id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
        if self.id is None:
            return
        for lo in range(0, len(self.query), 65536):
            part = slice(lo, lo + 65536)
            yield pa.record_batch(
                [pa.array(query_ids[self.query[part]].tolist(), type=query_type),
                 pa.array(self.id[part].tolist(), type=id_type),
                 pa.array(self.score[part])],
                names=["query_id", "id", "score"],
            )


def _candidates(est: np.ndarray, err: np.ndarray, floor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions whose true score can be among the best ``k`` or above the floor."""
    n = est.shape[1]
    if n > k:
        bar = np.partition(est, n - k, axis=1)[:, n - k] - 2 * err
    else:
        bar = np.full(est.shape[0], -np.inf)
    bar = np.maximum(bar, floor - err)
    return np.nonzero((est >= bar[:, None]) & (est > -np.inf))


def score_rows(
    scorer: Scorer, top: TopK, ids: np.ndarray, row_idx: np.ndarray, query_idx: np.ndarray,
    allowed: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None,
):
    """Offer some rows to some queries; ``allowed`` gives the mask of permitted pairs of a block.

    Copies of one vector tie, and all of them can be candidates. Once a block
    was crowded, only the ``k`` smallest ids per distinct vector of a batch
    are offered: no other copy can be among the best ``k``.
    """
    if top.crowded and allowed is None:
        row_idx = without_spare_copies(scorer.rows, ids, row_idx, top.k)
    if len(row_idx) == 0 or len(query_idx) == 0:
        return
    step = max(1, _ESTIMATE_CELLS // len(row_idx))
    for lo in range(0, len(query_idx), step):
        block = query_idx[lo:lo + step]
        est, err = scorer.estimate(row_idx, block)
        if allowed is not None:
            est = np.where(allowed(row_idx, block), est, -np.inf)
        floor = top.floor[block]
        q, r = _candidates(est, err, np.where(np.isinf(floor), -np.inf, scorer.scale(floor)), top.k)
        top.note_crowd(len(q), len(block))
        if len(q):
            rows, queries = row_idx[r], block[q]
            top.add(queries, scorer.exact(rows, queries), ids[rows])


def without_spare_copies(rows: np.ndarray, ids: np.ndarray, row_idx: np.ndarray, k: int) -> np.ndarray:
    """The rows that are among the ``k`` smallest ids of their vector."""
    data = np.ascontiguousarray(rows[row_idx])
    _, group = np.unique(data.view(np.dtype((np.void, data.shape[1] * data.itemsize))).ravel(), return_inverse=True)
    order = np.lexsort((ids[row_idx], group))
    return row_idx[np.sort(order[_places(group[order]) < k])]


def _places(groups: np.ndarray) -> np.ndarray:
    """Position of each element within its run of equal values."""
    starts = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]])
    return np.arange(len(groups)) - np.repeat(starts, np.diff(np.r_[starts, len(groups)]))
