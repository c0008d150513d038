"""Operator 11: centroid clustering in exact integers, by annulus search over centroids sorted by norm."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.vectors import usable

#: Up to this size of component all sums of a comparison are exact in doubles; larger ones are Python integers.
SMALL = 1 << 20
#: Centroids next to a vector's norm, on either side, whose distances bound its annulus.
PILOTS = 2
#: Sums that leave a long travel in parts of so many bits.
LIMB = 40
LONG = (1 << 63) - 1


class Ring:
    """Centroids in order of their norms."""

    def __init__(self, centroids: list[list[int]]) -> None:
        self.exact = centroids
        self.k = len(centroids)
        self.small = all(abs(c) <= SMALL for row in centroids for c in row)
        if self.small:
            rows = np.array(centroids, dtype=np.float64)
            squares = (rows**2).sum(axis=1)
            self.number = np.argsort(squares, kind="stable")
            self.rows, self.squares = rows[self.number], squares[self.number]
            self.norms = np.sqrt(self.squares)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number and squared distance of the nearest centroid of each row; ties go to the smaller number.

        The distances to a few centroids of about its norm bound each row's annulus; a binary search finds the centroids
        whose norms lie within it, boundary included, and rows with one range of candidates are compared with it at once.
        """
        squares = (x**2).sum(axis=1)
        norms = np.sqrt(squares)
        at = np.searchsorted(self.norms, norms)
        bound = np.full(len(x), np.inf)
        for step in range(-PILOTS, PILOTS):
            pilot = self.rows[np.clip(at + step, 0, self.k - 1)]
            bound = np.minimum(bound, ((x - pilot) ** 2).sum(axis=1))
        width = np.sqrt(bound) * (1 + 1e-9) + 1e-6
        low = np.searchsorted(self.norms, norms - width, "left")
        high = np.searchsorted(self.norms, norms + width, "right")
        best = np.empty(len(x), np.int64)
        code = low * (self.k + 1) + high
        order = np.argsort(code, kind="stable")
        for group in np.split(order, np.flatnonzero(np.diff(code[order])) + 1):
            a, b = low[group[0]], high[group[0]]
            apart = squares[group, None] + self.squares[a:b] - 2 * (x[group] @ self.rows[a:b].T)
            best[group] = (apart.astype(np.int64) * self.k + self.number[a:b]).min(axis=1)
        return best % self.k, best // self.k


def integers(row: Iterable[float], scale: int) -> list[int]:
    """floor(scale * x) of each component, of any size."""
    return [math.floor(Fraction(float(c)) * scale) for c in row]


def _exact(row: list[int], centroids: list[list[int]]) -> tuple[int, int]:
    """(squared distance, number) of the nearest centroid, in Python integers."""
    return min((sum((a - b) ** 2 for a, b in zip(row, c, strict=True)), j) for j, c in enumerate(centroids))


def _assigned(batch: pa.RecordBatch, ring: Ring, dims: int, scale: int) -> Iterator[tuple[np.ndarray, np.ndarray | list, np.ndarray | list]]:
    """(positions, clusters, distances, integer rows) of a batch: what is small in arrays, the rest one by one."""
    raw = batch.column(batch.schema.get_field_index("v")).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
    with np.errstate(over="ignore"):
        x = np.floor(scale * raw)
    easy = (np.abs(x) <= SMALL).all(axis=1) & ring.small
    if easy.any():
        some = np.flatnonzero(easy)
        cluster, apart = ring.nearest(x[some])
        yield some, cluster, apart, x[some]
    for i in np.flatnonzero(~easy):
        row = integers(raw[i], scale)
        apart, j = _exact(row, ring.exact)
        yield np.array([i]), [j], [apart], [row]


def _sums(centroids: list[list[int]], dims: int, scale: int):
    """A task's sums by cluster: components, distances and rows; a sum beyond a long in several limbs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ring = Ring(centroids)
        fast = np.zeros((ring.k, dims + 2), np.int64)
        slow: dict[int, list[int]] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            for _, cluster, apart, rows in _assigned(batch, ring, dims, scale):
                if isinstance(rows, list):
                    total = slow.setdefault(cluster[0], [0] * (dims + 2))
                    for i, v in enumerate([*rows[0], apart[0], 1]):
                        total[i] += v
                    continue
                whole = np.column_stack([rows.astype(np.int64), apart, np.ones(len(apart), np.int64)])
                order = np.argsort(cluster, kind="stable")
                starts = np.flatnonzero(np.diff(cluster[order], prepend=-1))
                fast[cluster[order][starts]] += np.add.reduceat(whole[order], starts, axis=0)
        out = []
        for j in range(ring.k):
            total = [int(v) + s for v, s in zip(fast[j], slow.get(j, [0] * (dims + 2)), strict=True)]
            limb = 0
            while total[-1] or any(total):
                fits = all(-(1 << 62) <= v < 1 << 62 for v in total)
                out.append((j, limb, total if fits else [v & ((1 << LIMB) - 1) for v in total]))
                total = [0] * (dims + 2) if fits else [v >> LIMB for v in total]
                limb += 1
        if out:
            j, limb, sums = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(j, pa.int32()), pa.array(limb, pa.int32()), pa.array(sums, pa.list_(pa.int64()))], ["cluster", "limb", "sums"])

    return run


def _totals(kept: DataFrame, centroids: list[list[int]], dims: int, scale: int) -> dict[int, list[int]]:
    """By cluster that has vectors: sums of components, sum of distances, number of vectors. Tasks add up before the shuffle."""
    parts = kept.select("v").mapInArrow(_sums(centroids, dims, scale), "cluster int, limb int, sums array<long>")
    wide = [F.sum(F.col("sums")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(dims + 2)]
    out: dict[int, list[int]] = {}
    # At most k clusters by a few limbs.
    for r in parts.groupBy("cluster", "limb").agg(*wide).collect():
        total = out.setdefault(r["cluster"], [0] * (dims + 2))
        for i in range(dims + 2):
            total[i] += int(r[f"s{i}"]) << (LIMB * r["limb"])
    return out


def _long(n: int) -> int | None:
    return n if n <= LONG else None


def _placed(centroids: list[list[int]], dims: int, scale: int, totals: dict[int, list[int]]):
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    inertia = _long(sum(t[-2] for t in totals.values()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ring = Ring(centroids)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            cluster, apart = [0] * n, [0] * n
            for at, some, far, _ in _assigned(batch, ring, dims, scale):
                for i, j, d in zip(at.tolist(), np.asarray(some).tolist(), far.tolist() if isinstance(far, np.ndarray) else far, strict=True):
                    cluster[i], apart[i] = j, _long(d)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(batch.schema.get_field_index("vec_id")),
                    pa.array(cluster, pa.int32()),
                    pa.array(apart, pa.int64()),
                    pa.array([_long(totals[j][-2]) for j in cluster], pa.int64()),
                    pa.array([inertia] * n, pa.int64()),
                    pa.array([digests[j] for j in cluster], pa.string()),
                ],
                ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"],
            )

    return run


def cluster_vectors(table: DataFrame, clusters: int = 40, rounds: int = 5, dims: int = 64, scale: int = 256, seed: int = 2) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256: one row per usable row of table.

    table has vec_id and embedding; other columns are ignored. Rows whose embedding is null, has not exactly `dims`
    components, or holds null or non-finite ones give no row. Components become floor(scale * x). Centroids start as the `clusters` rows with the
    smallest sha256 of `seed:vec_id` (all rows, if there are fewer; rows without vec_id last; ties by the embedding) and move
    `rounds` times to the floor of their rows' mean; a centroid without rows stays. Rows that repeat a vec_id, a null one too, count each,
    and of equal centroids the smaller number takes all. Distances and sums are exact whatever their size; those beyond a long are returned as null.
    An empty table gives an empty result.

    Each round is one job: tasks hold the centroids and hand on a row of sums for each of them, which only the driver's
    `clusters` totals outlive. Nothing else is kept between rounds, so that a lost executor costs its tasks' work and no more.
    """
    kept = table.select("vec_id", F.col("embedding").cast("array<double>").alias("v")).filter((F.size("v") == dims) & usable(F.col("v")))
    first = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    starts = kept.orderBy(first.asc_nulls_last(), "v").limit(clusters).collect()
    out = f"vec_id {kept.schema['vec_id'].dataType.simpleString()}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not starts:
        return kept.sparkSession.createDataFrame([], out)
    centroids = [integers(r["v"], scale) for r in starts]
    for _ in range(rounds):
        totals = _totals(kept, centroids, dims, scale)
        centroids = [[s // totals[j][-1] for s in totals[j][:dims]] if j in totals else c for j, c in enumerate(centroids)]
    totals = _totals(kept, centroids, dims, scale)
    return kept.mapInArrow(_placed(centroids, dims, scale, totals), out)
