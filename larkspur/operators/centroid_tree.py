"""Centroids in two levels, so that very many lists need no scan of all centroids and no single k-means model."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, functions as F

from larkspur.functions.vectors import l2_normalise
from larkspur.operators.scoring import matrix
from larkspur.session import stage

#: Vectors for each list that the lower level is trained on.
SAMPLE_PER_LIST = 64
_STEPS = 10


class CentroidTree:
    """Centroids grouped around upper ones. ``nearest`` finds exactly what a scan of all centroids finds.

    A group whose upper centroid is farther away than the best centroids found so far, by more than the group's radius,
    cannot hold a better one and is left out.
    """

    def __init__(self, upper: np.ndarray, leaves: np.ndarray, groups: np.ndarray | None = None):
        self.upper, self.leaves = upper, leaves
        self.groups = _squared(leaves, upper).argmin(axis=1) if groups is None else groups
        apart = np.sqrt(((leaves - upper[self.groups]) ** 2).sum(axis=1))
        self.members = [np.flatnonzero(self.groups == g) for g in range(len(upper))]
        self.radius = np.array([apart[m].max() if len(m) else -np.inf for m in self.members])
        self.compared = 0  # pairs of a point and a centroid that were measured

    @classmethod
    def train(cls, rows: DataFrame, n_lists: int, vector: str = "vector", by_direction: bool = True, seed: int = 42) -> CentroidTree:
        """A tree of about ``n_lists`` centroids under the square root of that many upper ones.

        The upper level is one small k-means model over all rows. The lower level is trained group by group, on at most
        ``SAMPLE_PER_LIST`` vectors for each of its lists, drawn by a hash of the vector; groups get lists by their share
        of the rows.
        """
        usable = rows.filter(F.col(vector).isNotNull()).select(F.col(vector).alias("vector"))
        if by_direction:
            usable = usable.select(l2_normalise(F.col("vector")).alias("vector"))
        training = stage(usable, "training")  # read many times over
        total = training.count()
        n_upper = max(2, int(np.sqrt(n_lists)))
        features = training.select(array_to_vector(F.col("vector").cast("array<double>")).alias("features"))
        upper = np.array(KMeans(k=n_upper, seed=seed, maxIter=_STEPS, initSteps=2).fit(features).clusterCenters())
        shared = rows.sparkSession.sparkContext.broadcast(upper)

        @F.arrow_udf("int")
        def group_of(vectors: pa.Array) -> pa.Array:
            return pa.array(_squared(matrix(vectors).astype(np.float64), shared.value).argmin(axis=1).astype(np.int32))

        grouped = stage(training.select("vector", group_of("vector").alias("g")), "groups")
        # At most one row for each upper centroid.
        sizes = {r.g: r.n for r in grouped.groupBy("g").agg(F.count("*").alias("n")).collect()}
        lists = {g: max(1, round(n_lists * n / total)) for g, n in sizes.items()}
        share = F.create_map(*(F.lit(x) for g, n in sizes.items() for x in (g, min(1.0, 1.5 * SAMPLE_PER_LIST * lists[g] / n + 0.0))))
        draw = F.pmod(F.xxhash64("vector"), F.lit(1 << 30)) / float(1 << 30)
        drawn = grouped.where(draw < F.element_at(share, F.col("g")))

        def fit(table: pa.Table) -> pa.Table:
            group = table.column("g")[0].as_py()
            points = matrix(table.column("vector").combine_chunks()).astype(np.float64)
            points = points[np.lexsort(points.T[::-1])][:2 * SAMPLE_PER_LIST * lists[group]]
            found = _k_means(points, lists[group], seed + group)
            offsets = pa.array(np.arange(len(found) + 1, dtype=np.int32) * found.shape[1])
            return pa.table({"g": pa.array([group] * len(found), pa.int32()),
                             "centroid": pa.ListArray.from_arrays(offsets, pa.array(found.ravel()))})

        fitted = drawn.groupBy("g").applyInArrow(fit, "g int, centroid array<double>").orderBy("g", "centroid").toArrow()
        return cls(upper, matrix(fitted.column("centroid").combine_chunks()), fitted.column("g").to_numpy())

    def nearest(self, points: np.ndarray, n: int = 1) -> np.ndarray:
        """Numbers of the ``n`` nearest leaves of each point, nearest first, equal ones by number."""
        points = np.ascontiguousarray(points, np.float64)
        n = min(n, len(self.leaves))
        best = np.full((len(points), n), np.inf)
        which = np.full((len(points), n), len(self.leaves), np.int64)
        above = np.sqrt(np.maximum(_squared(points, self.upper), 0))
        least = above - self.radius
        order = np.argsort(least, axis=1, kind="stable")
        for turn in range(len(self.upper)):
            group = order[:, turn]
            bound = np.maximum(np.take_along_axis(least, group[:, None], 1)[:, 0], 0)
            # A margin for rounding, so that equal distances are compared and not left out.
            open_ = np.flatnonzero(bound ** 2 * (1 - 1e-9) - 1e-9 <= best[:, -1])
            if not len(open_):
                break
            for g in np.unique(group[open_]):
                rows = open_[group[open_] == g]
                members = self.members[g]
                if not len(members):
                    continue
                self.compared += len(rows) * len(members)
                both = np.concatenate([best[rows], _squared(points[rows], self.leaves[members])], axis=1)
                names = np.concatenate([which[rows], np.broadcast_to(members, (len(rows), len(members)))], axis=1)
                # Distances that differ by rounding only count as equal.
                chosen = np.lexsort((names, np.round(both, 12)), axis=1)[:, :n]
                best[rows], which[rows] = np.take_along_axis(both, chosen, 1), np.take_along_axis(names, chosen, 1)
        return which.astype(np.int32)


def _squared(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances, point by centroid."""
    return np.maximum((points ** 2).sum(axis=1)[:, None] + (centroids ** 2).sum(axis=1) - 2.0 * points @ centroids.T, 0)


def _k_means(points: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Centroids of a bounded set of points; fewer where there are fewer distinct ones."""
    distinct = np.unique(points, axis=0)
    if len(distinct) <= k:
        return distinct
    rng = np.random.default_rng(seed)
    centroids = distinct[rng.choice(len(distinct), k, replace=False)]
    for _ in range(_STEPS):
        own = _squared(points, centroids).argmin(axis=1)
        counts = np.bincount(own, minlength=k)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, points)
        centroids = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centroids)
    return centroids
