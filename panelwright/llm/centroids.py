"""Centroid clustering in whole numbers: k-means rounds whose candidates are filtered in PCA-rotated coordinates.

A vector is stored with its leading rotated coordinates and the norm of what the rotation leaves over. The
distance of the leading coordinates plus the squared difference of the two norms is never more than the
true squared distance, so a centroid whose bound is above an exact distance already known is out; the others are
verified on the integers. The rotation decides how many survive, never the result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import frozen, release

LIMIT = 1 << 27  #: components are clamped to this magnitude, so that a squared distance of 64 of them is a long
LEAD = 16  #: rotated coordinates stored of each vector
_LONG = (1 << 63) - 1


@dataclass(frozen=True)
class Rotation:
    """Orthonormal axes by falling variance, about ``mean``."""

    mean: np.ndarray
    axes: np.ndarray
    lead: int

    def __call__(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The leading coordinates of each row, and the norm of the others."""
        y = (x - self.mean) @ self.axes
        return y[:, : self.lead], np.sqrt((y[:, self.lead :] ** 2).sum(axis=1))


def _matrix(column: pa.Array, dims: int, kind) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(-1, dims)


def fit_rotation(points: DataFrame, dims: int, lead: int = LEAD) -> Rotation:
    """Principal axes of all ``points(x array<int>)``: each task adds up its moments, Spark adds up the tasks'."""

    def moments(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dims + 1, dims + 1))
        for frame in frames:
            x = _matrix(frame.column("x"), dims, np.float64)
            x = np.hstack([x, np.ones((len(x), 1))])
            total += x.T @ x
        yield pa.RecordBatch.from_pydict({"i": np.arange(total.size), "v": total.ravel()})

    total = np.zeros((dims + 1) ** 2)
    for i, v in points.select("x").mapInArrow(moments, "i long, v double").groupBy("i").agg(F.sum("v")).collect():
        total[i] = v
    total = total.reshape(dims + 1, dims + 1)
    n = max(total[-1, -1], 1.0)
    mean = total[-1, :-1] / n
    values, axes = np.linalg.eigh(total[:-1, :-1] / n - np.outer(mean, mean))
    return Rotation(mean, axes[:, np.argsort(-values)], min(lead, dims))


def nearest(x: np.ndarray, lead: np.ndarray, rest: np.ndarray, centroids: np.ndarray, rotation: Rotation) -> tuple[np.ndarray, np.ndarray, int]:
    """For integer rows with their rotated coordinates: the number of the nearest centroid (ties: the smaller), the squared distance, and how many distances were computed."""
    c_lead, c_rest = rotation(centroids.astype(np.float64))
    own, other = (lead**2).sum(axis=1), (c_lead**2).sum(axis=1)
    bound = own[:, None] + other - 2 * lead @ c_lead.T + (rest[:, None] - c_rest) ** 2
    bound -= 1e-9 * (own[:, None] + other + rest[:, None] ** 2 + c_rest**2) + 1e-6  # what rounding may add
    cluster = bound.argmin(axis=1)
    best = ((x - centroids[cluster]) ** 2).sum(axis=1)
    left = bound <= best[:, None]
    left[np.arange(len(x)), cluster] = False
    for c in range(len(centroids)):
        rows = np.flatnonzero(left[:, c])
        found = ((x[rows] - centroids[c]) ** 2).sum(axis=1)
        less = (found < best[rows]) | ((found == best[rows]) & (c < cluster[rows]))
        best[rows[less]], cluster[rows[less]] = found[less], c
    return cluster, best, len(x) + int(left.sum())


def _assigned(frame: pa.RecordBatch, centroids: np.ndarray, rotation: Rotation) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    x = _matrix(frame.column("x"), centroids.shape[1], np.int64)
    cluster, distance, _ = nearest(x, _matrix(frame.column("lead"), rotation.lead, np.float64), frame.column("rest").to_numpy(), centroids, rotation)
    return x, cluster, distance


def _moved(points: DataFrame, centroids: np.ndarray, rotation: Rotation) -> np.ndarray:
    """Every centroid that has vectors at the exact floor of their mean. Sums are combined in tasks, and then by Spark."""
    k, dims = centroids.shape

    def sums(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((k, dims), np.int64), np.zeros(k, np.int64)
        for frame in frames:
            x, cluster, _ = _assigned(frame, centroids, rotation)
            for c in range(k):
                mine = x[cluster == c]
                total[c] += mine.sum(axis=0)
                count[c] += len(mine)
        yield pa.RecordBatch.from_pydict({"i": np.arange(total.size), "total": total.ravel(), "n": np.repeat(count, dims)})

    out = centroids.copy()
    added = points.select("x", "lead", "rest").mapInArrow(sums, "i long, total long, n long").groupBy("i").agg(F.sum(F.col("total").cast("decimal(20,0)")), F.sum("n"))
    for i, total, n in added.collect():
        if n:
            out[i // dims, i % dims] = int(total) // n
    return out


def _hash_order(vec_id: Column, seed: int) -> Column:
    return F.sha2(F.encode(F.concat(F.lit(f"{seed}:"), vec_id.cast("string")), "UTF-8"), 256)


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64, seed: int = 1, lead: int = LEAD) -> DataFrame:
    """``vectors(vec_id, embedding)`` -> one row per vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Vectors of exactly ``dims`` components, none null or non-finite, are kept, each component as the integer floor(scale * x) (clamped to
    2**27 either way, sums of distances to a long). The ``k`` vectors whose ``seed:vec_id`` hashes least begin as
    centroids (ties by components; null ids last; fewer vectors: fewer centroids). Each round assigns all vectors and moves the
    centroids to the floor of the mean; ties go to the smaller number, empty centroids stay. Then vectors are assigned once more.

    A round is one pass without a shuffle of vectors: tasks send on k x dims sums, so copies and large clusters cost nothing more.
    Only sums and centroids reach the driver. Repeated rows count as rows of their own; other columns are ignored. An empty table gives an empty result.
    """
    e = F.col("embedding")
    fine = F.coalesce((F.size(e) == dims) & ~F.exists(e, lambda v: v.isNull() | F.isnan(v.cast("double")) | (F.abs(v.cast("double")) == float("inf"))), F.lit(False))
    whole = F.transform(e, lambda v: F.greatest(F.least(F.floor(v.cast("double") * scale), F.lit(LIMIT)), F.lit(-LIMIT)).cast("int"))
    kept = frozen(vectors.select("vec_id", "embedding").where(fine).select("vec_id", whole.alias("x")), "whole")
    first = kept.orderBy(_hash_order(F.col("vec_id"), seed).asc_nulls_last(), "x").limit(k).select("x").collect()
    schema = "cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not first:
        return kept.select("vec_id", *[F.lit(None).cast(field.split()[1]).alias(field.split()[0]) for field in schema.split(", ")])
    centroids = np.array([row.x for row in first], np.int64)
    rotation = fit_rotation(kept, dims, lead)

    def rotated(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            y, rest = rotation(_matrix(frame.column("x"), dims, np.float64))
            offsets = pa.array(np.arange(len(y) + 1, dtype=np.int32) * rotation.lead)
            yield pa.RecordBatch.from_arrays([frame.column("vec_id"), frame.column("x"), pa.ListArray.from_arrays(offsets, pa.array(y.ravel())), pa.array(rest)], ["vec_id", "x", "lead", "rest"])

    kind = kept.schema["vec_id"].dataType.simpleString()
    points = frozen(kept.mapInArrow(rotated, f"vec_id {kind}, x array<int>, lead array<double>, rest double"), "rotated")
    release(kept)
    for _ in range(rounds):
        centroids = _moved(points, centroids, rotation)

    def last(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            _, number, distance = _assigned(frame, centroids, rotation)
            yield pa.RecordBatch.from_arrays([frame.column("vec_id"), pa.array(number.astype(np.int32)), pa.array(distance)], ["vec_id", "cluster", "distance"])

    out = frozen(points.mapInArrow(last, f"vec_id {kind}, cluster int, distance long"), "clusters")
    release(points)
    inertia = dict.fromkeys(range(len(centroids)), 0) | {c: int(s) for c, s in out.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)"))).collect()}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    per = F.array(*[F.struct(F.lit(min(inertia[c], _LONG)).cast("long").alias("inertia"), F.lit(digest[c]).alias("sha")) for c in range(len(centroids))])
    mine = F.get(per, F.col("cluster"))
    return out.select("vec_id", "cluster", "distance", mine.inertia.alias("cluster_inertia"), F.lit(min(sum(inertia.values()), _LONG)).cast("long").alias("inertia"), mine.sha.alias("centroid_sha256"))
