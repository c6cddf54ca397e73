"""Centroid clustering in whole numbers, with centroids filtered by n-simplex bounds.

Some initial centroids that lie apart serve as pivots. The squared distances of every vector to them
are computed once and written with the vector. Distances to n pivots fix the apex of a simplex over
the pivots: n coordinates, whose first n - 1 lie in the pivots' own space and whose last is the
height above it. For the apexes of a vector and a centroid, the Euclidean distance is a lower bound
of their true distance, and the one with the centroid's height negated is an upper bound. In every
round only centroids whose lower bound is within the least upper bound are compared exactly, in
64-bit integers; the bounds are widened by what their floating point arithmetic can be wrong.

Rounds collect sums by cluster, never vectors: a row a cluster (and 40 bits of the sums) from every
task, added up before they reach the driver.

Defined cases: vectors of another length, with a null, a NaN or an infinite component are left out;
a null id is kept and is never an initial centroid unless there are too few others; rows that repeat
an id count once each, ties in the initial order go by the components; with fewer vectors than
centroids every vector is one; an empty cluster keeps its centroid; components beyond 2**27 are
worked out in Python's integers, and distances or sums that pass 64 bits are null; an empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .common import by_task

PIVOTS = 16
NARROW = 1 << 27  # components within it keep every distance of 64 of them within 64 bits
LIMB = 40
LONGEST = (1 << 63) - 1


@dataclass(frozen=True)
class Simplex:
    """Pivots and the base they span: ``inverse`` takes pivot distances to coordinates."""

    pivots: np.ndarray
    apart: np.ndarray  # squared distances of the first pivot to the others
    inverse: np.ndarray
    error: float  # of a bound, relative to the squared distances it is made of

    @classmethod
    def over(cls, points: np.ndarray, most: int = PIVOTS) -> Simplex:
        """The first points that are well apart from the space of those before them."""
        chosen = [0]
        while len(chosen) < most:
            heights = _heights(points, chosen)
            best = int(heights.argmax())
            if heights[best] <= 1e-3 * _spread(points):
                break
            chosen.append(best)
            if np.linalg.cond(_base(points[chosen])) > 1e3:
                chosen.pop()
                break
        base = _base(points[chosen])
        error = 1e-14 * (1 + (np.linalg.cond(base) if len(base) else 0.0)) ** 2 * points.shape[1]
        apart = ((points[chosen[1:]] - points[chosen[0]]) ** 2).sum(axis=1)
        inverse = np.linalg.inv(base) if len(base) else base
        return cls(points[chosen], apart.astype(float), inverse, error)

    def reach(self, points: np.ndarray) -> np.ndarray:
        """Squared distances of ``points`` to the pivots, exact."""
        return np.stack([((points - p) ** 2).sum(axis=1) for p in self.pivots], axis=1)

    def apexes(self, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Coordinates in the pivots' space, height above it, squared distance to the first pivot."""
        first = reach[:, 0].astype(float)
        flat = ((first[:, None] + self.apart - reach[:, 1:]) / 2) @ self.inverse.T
        return flat, np.sqrt(np.maximum(first - (flat**2).sum(axis=1), 0)), first

    def may_be_nearest(self, reach: np.ndarray, of_centroids: np.ndarray) -> np.ndarray:
        """Per vector and centroid, whether the bounds leave it in."""
        flat, height, first = self.apexes(reach)
        flat_c, height_c, first_c = self.apexes(of_centroids)
        sizes = first[:, None] + first_c
        lower = sizes - 2 * (flat @ flat_c.T + height[:, None] * height_c)
        upper = lower + 4 * height[:, None] * height_c
        wide = self.error * (sizes.max(axis=1, keepdims=True) + 1)
        return lower - wide <= (upper + wide).min(axis=1, keepdims=True)


def _base(pivots: np.ndarray) -> np.ndarray:
    """Coordinates of the pivots after the first, as a lower triangle."""
    sides = (pivots[1:] - pivots[0]).astype(float)
    return np.linalg.qr(sides.T, mode="r").T if len(sides) else np.zeros((0, 0))


def _spread(points: np.ndarray) -> float:
    return float(np.sqrt(((points - points[0]).astype(float) ** 2).sum(axis=1).max(initial=0)))


def _heights(points: np.ndarray, chosen: list[int]) -> np.ndarray:
    """Distance of every point to the space of the chosen ones."""
    rest = (points - points[chosen[0]]).astype(float)
    if len(chosen) > 1:
        axes, _ = np.linalg.qr(rest[chosen[1:]].T)
        rest = rest - (rest @ axes) @ axes.T
    return np.sqrt((rest**2).sum(axis=1))


@dataclass(frozen=True)
class Centroids:
    """Whole-number centroids; ``plain`` if one of them is too wide for 64-bit distances."""

    rows: list[list[int]]

    @property
    def plain(self) -> bool:
        return any(abs(x) > NARROW for row in self.rows for x in row)

    def nearest_plain(self, point: list[int]) -> tuple[int, int]:
        gaps = [sum((x - c) ** 2 for x, c in zip(point, row, strict=True)) for row in self.rows]
        least = min(gaps)
        return gaps.index(least), least

    def nearest(self, points: np.ndarray, reach: np.ndarray, base: Simplex) -> tuple[np.ndarray, np.ndarray]:
        """Number and squared distance of the nearest centroid, the smaller number on a tie."""
        centres = np.array(self.rows, dtype=np.int64)
        left = base.may_be_nearest(reach, base.reach(centres))
        number = np.zeros(len(points), dtype=np.int64)
        least = np.full(len(points), LONGEST)
        for j, centre in enumerate(centres):
            rows = np.flatnonzero(left[:, j])
            gap = ((points[rows] - centre) ** 2).sum(axis=1)
            nearer = gap < least[rows]
            number[rows[nearer]], least[rows[nearer]] = j, gap[nearer]
        return number, least


def whole_numbers(values: list[float], scale: int) -> list[int]:
    """floor(scale * x) of every component; ``scale`` is a power of two, so the product is exact."""
    return [int(x) * scale if abs(x) >= 1 << 53 else int(np.floor(scale * x)) for x in values]


def _of_batch(part: pa.RecordBatch, dims: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[list[int]]]:
    """Narrow rows and their reach, which rows they are, and the wide rows."""
    wide = part.column("wide").to_pylist()
    narrow = np.array([w is None for w in wide], dtype=bool)
    kept = part.filter(pa.array(narrow))
    points = kept.column("point").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims)
    reach = kept.column("reach").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    far = [[int(x) for x in w.split(",")] for w in wide if w is not None]
    return points, reach.reshape(len(points), -1), narrow, far


def _assigned(part: pa.RecordBatch, dims: int, centroids: Centroids, base: Simplex):
    """Points in whole numbers, their clusters and squared distances, narrow rows first."""
    points, reach, narrow, far = _of_batch(part, dims)
    if centroids.plain:
        near = [centroids.nearest_plain(p) for p in points.tolist()]
        number, least = np.array([j for j, _ in near], dtype=np.int64), [d for _, d in near]
    elif len(points):
        number, least = centroids.nearest(points, reach, base)
        least = least.tolist()
    else:
        number, least = np.zeros(0, dtype=np.int64), []
    return points, number, least, narrow, far, [centroids.nearest_plain(p) for p in far]


def prepared(vectors: DataFrame, base: Simplex, dims: int, scale: int) -> DataFrame:
    """(vec_id, point, reach, wide): every vector in whole numbers with its pivot distances."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[dict[str, object]]:
        for part in parts:
            values = part.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
            with np.errstate(over="ignore"):
                scaled = np.floor(scale * values.astype(float))
            narrow = (np.abs(scaled) <= NARROW).all(axis=1)
            points = np.where(narrow[:, None], scaled, 0).astype(np.int64)
            reach = base.reach(points)
            wide = [
                None if fits else ",".join(map(str, whole_numbers(row.tolist(), scale)))
                for fits, row in zip(narrow, values, strict=True)
            ]
            yield {
                "vec_id": part.column("vec_id"),
                "point": _lists(points.astype(np.int32), narrow, pa.int32()),
                "reach": _lists(reach, narrow, pa.int64()),
                "wide": wide,
            }

    return by_task(vectors, run, "vec_id long, point array<int>, reach array<long>, wide string")


def _lists(rows: np.ndarray, there: np.ndarray, kind: pa.DataType) -> pa.Array:
    """Rows as a list column, null where not ``there``."""
    stops = np.concatenate([[0], np.cumsum(np.where(there, rows.shape[1], 0))])
    offsets = pa.array(stops.astype(np.int32), mask=np.append(~there, False))
    return pa.ListArray.from_arrays(offsets, pa.array(rows[there].ravel(), type=kind))


def _limbs(value: int) -> dict[int, int]:
    """``value`` as signed parts of ``LIMB`` bits, by their place."""
    sign, value, out, place = (-1 if value < 0 else 1), abs(value), {}, 0
    while value:
        out[place] = sign * (value & ((1 << LIMB) - 1))
        value >>= LIMB
        place += 1
    return out


def moved(points: DataFrame, centroids: Centroids, base: Simplex, dims: int) -> Centroids:
    """Every centroid at the floored mean of the vectors nearest to it; empty ones stay."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[dict[str, object]]:
        sums = [[0] * dims for _ in centroids.rows]
        counts = [0] * len(centroids.rows)

        def add(j: int, n: int, total: list[int]) -> None:
            counts[j] += n
            sums[j] = [a + b for a, b in zip(sums[j], total, strict=True)]

        for part in parts:
            rows, number, _, _, far, far_near = _assigned(part, dims, centroids, base)
            for j in np.unique(number).tolist():
                own = rows[number == j]
                add(j, len(own), own.sum(axis=0).tolist())
            for point, (j, _) in zip(far, far_near, strict=True):
                add(j, 1, point)
        out: dict[str, list] = {c: [] for c in ("cluster", "limb", "n", "parts")}
        for j, n in enumerate(counts):
            split = [_limbs(x) for x in sums[j]]
            for limb in range(max([1, *[len(s) for s in split]]) if n else 0):
                out["cluster"].append(j)
                out["limb"].append(limb)
                out["n"].append(n if limb == 0 else 0)
                out["parts"].append([s.get(limb, 0) for s in split])
        yield out

    partial = by_task(points, run, "cluster int, limb int, n long, parts array<long>")
    total = (
        partial.groupBy("cluster", "limb")
        .agg(F.sum("n").alias("n"), *[F.sum(F.col("parts")[i]).alias(f"s{i}") for i in range(dims)])
        .collect()
    )  # at most a row a centroid and limb
    counts: dict[int, int] = {}
    sums: dict[int, list[int]] = {}
    for r in total:
        counts[r.cluster] = counts.get(r.cluster, 0) + r.n
        old = sums.get(r.cluster, [0] * dims)
        sums[r.cluster] = [s + (r[f"s{i}"] << (LIMB * r.limb)) for i, s in enumerate(old)]
    return Centroids(
        [[s // counts[j] for s in sums[j]] if counts.get(j) else row for j, row in enumerate(centroids.rows)]
    )


def assigned(points: DataFrame, centroids: Centroids, base: Simplex, dims: int) -> DataFrame:
    """(vec_id, cluster, distance) of every vector."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[dict[str, object]]:
        for part in parts:
            _, number, least, narrow, _, far_near = _assigned(part, dims, centroids, base)
            cluster = np.zeros(part.num_rows, dtype=np.int64)
            distance: list[int | None] = [None] * part.num_rows
            near = [*zip(number.tolist(), least, strict=True)]
            for at, (j, d) in zip(
                [*np.flatnonzero(narrow).tolist(), *np.flatnonzero(~narrow).tolist()],
                [*near, *far_near],
                strict=True,
            ):
                cluster[at], distance[at] = j, d if d <= LONGEST else None
            yield {"vec_id": part.column("vec_id"), "cluster": cluster.astype(np.int32), "distance": distance}

    return by_task(points, run, "vec_id long, cluster int, distance long")


def clusters(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    dims: int = 64,
    k: int = 40,
    rounds: int = 5,
    scale: int = 256,
    seed: str = "2:",
    pivots: int = PIVOTS,
) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every kept vector."""
    spark = vectors.sparkSession
    vector = vectors[vector_col]
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = vectors.where(vector.isNotNull() & (F.size(vector) == dims) & finite).select(
        vectors[id_col].cast("long").alias("vec_id"), vector.cast("array<double>").alias("vector")
    )
    order = F.sha2(F.concat(F.lit(seed), F.col("vec_id").cast("string")).cast("binary"), 256)
    first = kept.orderBy(order.asc_nulls_last(), "vector").limit(k).collect()  # at most k rows
    centroids = Centroids([whole_numbers(r.vector, scale) for r in first])
    narrow = [row for row in centroids.rows if all(abs(x) <= NARROW for x in row)]
    base = Simplex.over(np.array(narrow or [[0] * dims], dtype=np.int64), pivots)
    points = stage(prepared(kept, base, dims, scale), "points")
    if first:
        for _ in range(rounds):
            centroids = moved(points, centroids, base, dims)
        near = stage(assigned(points, centroids, base, dims), "clusters")
    else:
        near = points.selectExpr("vec_id", "0 AS cluster", "0L AS distance")
    held = F.sum(F.col("distance").cast("decimal(38,0)")).alias("held")
    totals = near.groupBy("cluster").agg(held, (F.count("distance") == F.count("*")).alias("all_there")).collect()
    by_cluster = {r.cluster: int(r.held) if r.all_there else None for r in totals}

    def fits(total: int | None) -> int | None:
        return total if total is not None and total <= LONGEST else None

    whole = fits(None if None in by_cluster.values() else sum(by_cluster.values()))
    named = spark.createDataFrame(
        [
            (j, fits(by_cluster.get(j, 0)), whole, hashlib.sha256(",".join(map(str, row)).encode()).hexdigest())
            for j, row in enumerate(centroids.rows)
        ],
        "cluster int, cluster_inertia long, inertia long, centroid_sha256 string",
    )
    # A row a centroid: broadcast.
    return near.join(F.broadcast(named), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )
