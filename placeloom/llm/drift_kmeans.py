"""Lloyd's clustering of integer vectors with bounds that drift tightly.

Each vector keeps an upper bound of the distance to its own centroid and a lower bound of
that to any other. When centroids move, the lower bound must give way by as much as some
other centroid can have come nearer. That is not its whole drift: all vectors of a cluster
lie in a sphere, and in the plane of the sphere's centre and the centroid's old and new
place, a point seen from the middle of the move at an angle t to it comes nearer by at most
the drift times the cosine of t. The least angle of the sphere gives the loosening for all
vectors of the cluster. A vector whose bounds do not cross keeps its cluster unread; the
others are held against all centroids in exact integers, so the result is Lloyd's own.

Vectors travel as blocks of rows in Parquet. A round is one narrow pass over the blocks,
which writes them anew with their bounds, and one small aggregate per cluster.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from placeloom.session import remove_path, scratch_path

BLOCK_ROWS = 4096
# Components up to this size: squared distances of the widest vectors stay below 2^63.
LARGEST = 1 << 27
_LONG = (1 << 63) - 1
_BLOCK = "ids array<bigint>, width int, vectors binary, cluster binary, upper binary, lower binary, clusters array<struct<cluster int, n bigint, radius double, inertia decimal(38,0), sums array<bigint>>>"  # noqa: E501


@dataclass(frozen=True)
class KMeansSettings:
    """``clusters`` centroids, ``rounds`` of moving them; seeds are the least hashes of ``salt`` and id."""

    clusters: int = 8
    rounds: int = 10
    dimensions: int = 64
    scale: int = 1024
    salt: str = "3:"


def kept_vectors(vectors: DataFrame, settings: KMeansSettings, vec_id: str, embedding: str) -> DataFrame:
    """vec_id, vector (whole numbers) of the rows that take part."""
    values = F.col(f"`{embedding}`").cast("array<double>")
    finite = F.forall(
        values, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) * settings.scale < float(LARGEST)), F.lit(False))
    )
    ints = F.transform(values, lambda x: F.floor(x * settings.scale).cast("bigint"))
    return vectors.where((F.size(values) == settings.dimensions) & finite).select(
        F.col(f"`{vec_id}`").cast("bigint").alias("vec_id"), ints.alias("vector")
    )


def first_centroids(kept: DataFrame, settings: KMeansSettings) -> np.ndarray:
    """The vectors with the least hashes, in ascending order: at most ``clusters`` rows."""
    number = F.sha2(F.concat(F.lit(settings.salt), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = kept.select("vector", number.alias("hash")).orderBy("hash", "vector").limit(settings.clusters).collect()
    return np.array([r.vector for r in rows], np.int64).reshape(len(rows), settings.dimensions)


def squared_distances(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of all vectors to all centroids, as integers."""
    largest = max(int(np.abs(vectors).max(initial=0)), int(np.abs(centroids).max(initial=0)))
    if 4 * vectors.shape[1] * largest * largest < 1 << 53:  # doubles hold every sum exactly
        x, c = vectors.astype(float), centroids.astype(float)
        return ((x * x).sum(axis=1)[:, None] - 2 * (x @ c.T) + (c * c).sum(axis=1)).astype(np.int64)
    return np.stack([((vectors - c) ** 2).sum(axis=1) for c in centroids], axis=1)


@dataclass(frozen=True)
class Drift:
    """What a move of the centroids does to the bounds of a cluster's vectors."""

    own: np.ndarray  # how far each centroid moved
    loosening: np.ndarray  # by how much any other can have come nearer to a vector of the cluster
    half_gap: np.ndarray  # half the distance to the nearest other centroid
    slack: float  # more than all rounding


def drift(old: np.ndarray, new: np.ndarray, radii: np.ndarray) -> Drift:
    """``radii``: of the sphere around each old centroid that holds its vectors."""
    k = len(old)
    moves = (new - old).astype(float)
    lengths = np.sqrt((moves * moves).sum(axis=1))
    middles = (old + new) / 2
    loosening = np.zeros(k)
    for i in range(k):
        for j in range(k):
            if i != j and lengths[j] > 0:
                loosening[i] = max(loosening[i], lengths[j] * _cosine(old[i] - middles[j], moves[j], lengths[j], radii[i]))
    gaps = np.sqrt(squared_distances(new, new).astype(float))
    np.fill_diagonal(gaps, np.inf)
    size = 1 + max(np.abs(old).max(initial=0), np.abs(new).max(initial=0)) * np.sqrt(old.shape[1]) + radii.max(initial=0)
    return Drift(lengths, loosening, gaps.min(axis=1, initial=np.inf) / 2, 1e-9 * float(size))


def _cosine(centre: np.ndarray, move: np.ndarray, length: float, radius: float) -> float:
    """The largest cosine, at least 0, between the move and a point of the sphere, seen from the move's middle."""
    away = float(np.sqrt((centre * centre).sum()))
    if away <= radius:
        return 1.0
    angle = np.arccos(np.clip((centre @ move) / (away * length), -1.0, 1.0)) - np.arcsin(radius / away)
    return float(max(0.0, np.cos(max(0.0, angle))))


def step(
    vectors: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, centroids: np.ndarray, moved: Drift
) -> int:
    """Move the bounds of a block and assign anew, in place, what they leave open; how many were scanned."""
    upper += moved.own[cluster]
    lower -= moved.loosening[cluster]
    safe = np.maximum(lower, moved.half_gap[cluster]) - moved.slack
    open_ = np.flatnonzero(upper >= safe)
    if len(open_):  # the upper bound itself may be loose
        own = vectors[open_] - centroids[cluster[open_]]
        upper[open_] = np.sqrt((own * own).sum(axis=1).astype(float))
        open_ = open_[upper[open_] >= safe[open_]]
    if len(open_):
        scan(vectors, cluster, upper, lower, centroids, open_)
    return len(open_)


def scan(
    vectors: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, centroids: np.ndarray, rows: np.ndarray
) -> None:
    """Assign ``rows`` exactly (of equal distances the smaller number) and set their bounds."""
    distances = squared_distances(vectors[rows], centroids)
    nearest = distances.argmin(axis=1)
    cluster[rows] = nearest
    upper[rows] = np.sqrt(distances[np.arange(len(rows)), nearest].astype(float))
    distances[np.arange(len(rows)), nearest] = _LONG
    lower[rows] = np.sqrt(distances.min(axis=1).astype(float)) if len(centroids) > 1 else np.inf


def _summary(vectors: np.ndarray, cluster: np.ndarray, upper: np.ndarray, centroids: np.ndarray) -> list[dict]:
    """Of each cluster in a block: vectors, farthest upper bound, sum of distances, sums of components."""
    order = np.argsort(cluster, kind="stable")
    present, starts = np.unique(cluster[order], return_index=True)
    own = vectors - centroids[cluster]
    far = (own * own).sum(axis=1)
    sums = np.add.reduceat(vectors[order], starts, axis=0)
    ends = np.append(starts[1:], len(order))
    return [
        {
            "cluster": int(c),
            "n": int(e - s),
            "radius": float(upper[order[s:e]].max()),
            "inertia": sum(far[order[s:e]].tolist()),
            "sums": total.tolist(),
        }
        for c, s, e, total in zip(present, starts, ends, sums)
    ]


def _blocks(dimensions: int, centroids: np.ndarray, schema: pa.Schema):
    """Rows to blocks, assigned to the first centroids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(start, BLOCK_ROWS)
                vectors = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dimensions).astype(np.int64)
                n = len(vectors)
                cluster, upper, lower = np.zeros(n, np.int32), np.zeros(n), np.zeros(n)
                scan(vectors, cluster, upper, lower, centroids, np.arange(n))
                width = 2 if np.abs(vectors).max() < 1 << 15 else 4
                row = {"ids": part.column(0).to_pylist(), "width": width, "vectors": vectors.astype(f"<i{width}").tobytes()}
                yield _row(row, vectors, cluster, upper, lower, centroids, schema)

    return run


def _row(
    row: dict, vectors: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, centroids: np.ndarray, schema: pa.Schema
) -> pa.RecordBatch:
    made = {
        "cluster": cluster.astype("<i4").tobytes(),
        "upper": upper.astype("<f8").tobytes(),
        "lower": lower.astype("<f8").tobytes(),
        "clusters": _summary(vectors, cluster, upper, centroids),
    }
    return pa.RecordBatch.from_pylist([row | made], schema=schema)


def _unpacked(row: dict, dimensions: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    vectors = np.frombuffer(row["vectors"], f"<i{row['width']}").reshape(-1, dimensions).astype(np.int64)
    bounds = [np.frombuffer(row[c], "<f8").copy() for c in ("upper", "lower")]
    return vectors, np.frombuffer(row["cluster"], "<i4").copy(), *bounds


def _round(dimensions: int, centroids: np.ndarray, moved: Drift, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                vectors, cluster, upper, lower = _unpacked(row, dimensions)
                step(vectors, cluster, upper, lower, centroids, moved)
                yield _row(row, vectors, cluster, upper, lower, centroids, schema)

    return run


def _members(dimensions: int, centroids: np.ndarray, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                vectors, cluster, _, _ = _unpacked(row, dimensions)
                own = vectors - centroids[cluster]
                columns = [row["ids"], cluster, (own * own).sum(axis=1)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)

    return run


def _totals(blocks: DataFrame, settings: KMeansSettings) -> dict:
    """Of each cluster its counts and sums over all blocks: at most ``clusters`` rows."""
    one = blocks.select(F.explode("clusters").alias("c")).select("c.*")
    sums = [F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(settings.dimensions)]
    rows = one.groupBy("cluster").agg(F.sum("n").alias("n"), F.max("radius").alias("radius"), F.sum("inertia").alias("inertia"), *sums)
    return {r.cluster: r for r in rows.collect()}


def _written(df: DataFrame) -> tuple[DataFrame, str]:
    path = scratch_path(df.sparkSession, "kmeans-blocks")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def cluster(
    vectors: DataFrame, settings: KMeansSettings = KMeansSettings(), vec_id: str = "vec_id", embedding: str = "embedding"
) -> tuple[DataFrame, DataFrame]:
    """Assignments (vec_id, cluster, distance) and centroids (cluster, n, inertia, centroid).

    ``distance`` is squared, ``inertia`` its sum over the cluster, null beyond a long.
    Vectors take part that have exactly ``dimensions`` components, none null, not finite,
    or so large that, scaled, it reaches 2^27; other rows are left out. With fewer than
    ``clusters`` vectors each seeds a cluster; no vectors give two empty tables. Rows with
    a null id take part. Repeated rows each count and are each returned. Of equally near
    centroids the one with the smaller number wins, and a cluster without vectors keeps
    its centroid. Other columns are not read, whatever their names.
    """
    spark: SparkSession = vectors.sparkSession
    kept = kept_vectors(vectors, settings, vec_id, embedding)
    members = T.StructType.fromDDL("vec_id bigint, cluster int, distance bigint")
    found = "cluster int, n bigint, inertia bigint, centroid array<bigint>"
    centroids = first_centroids(kept, settings)
    if not len(centroids):
        return spark.createDataFrame([], members), spark.createDataFrame([], found)
    dims, schema = settings.dimensions, T.StructType.fromDDL(_BLOCK)
    arrow = to_arrow_schema(schema)
    blocks, path = _written(kept.mapInArrow(_blocks(dims, centroids, arrow), schema))
    totals = _totals(blocks, settings)
    for _ in range(settings.rounds):
        old, centroids = centroids, centroids.copy()
        for c, r in totals.items():
            centroids[c] = [r[f"s{i}"] // r.n for i in range(dims)]
        radii = np.array([totals[c].radius if c in totals else 0.0 for c in range(len(old))])
        moved = drift(old, centroids, radii)
        before = path
        blocks, path = _written(blocks.mapInArrow(_round(dims, centroids, moved, arrow), schema))
        totals = _totals(blocks, settings)
        remove_path(spark, before)
    rows = [
        (c, r.n if r else 0, int(r.inertia) if r and r.inertia <= _LONG else None if r else 0, centroids[c].tolist())
        for c, r in ((c, totals.get(c)) for c in range(len(centroids)))
    ]
    assigned = blocks.select("ids", "width", "vectors", "cluster", "upper", "lower")
    return assigned.mapInArrow(_members(dims, centroids, to_arrow_schema(members)), members), spark.createDataFrame(rows, found)


def centroid_digest(centroid: Column) -> Column:
    """Lowercase hex sha256 of the components as decimal integers joined by commas."""
    return F.sha2(F.array_join(centroid.cast("array<string>"), ","), 256)

