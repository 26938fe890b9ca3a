"""Centroid clustering with Hamerly's bounds (operator 11), exact over integer vectors.

Each vector carries, from round to round, its centroid, one upper bound of the distance to it and one lower bound of the
distance to every other centroid. When centroids have moved, the upper bound grows by the move of the vector's own
centroid and the lower one falls by the largest move of the others. While the upper bound is below the lower one, or
below half the way from the own centroid to its nearest neighbour, the assignment cannot change. What is left is
measured against its own centroid, and only if that does not settle it against all of them, in 64-bit integers. Bounds
are doubles, rounded away from each other by more than their own error and compared strictly, so ties always reach the
integer scan, where the smaller number wins.

Scale: a round reads the table of vectors, writes it with its new bounds to the shared folder and adds up k x dims sums in
each task; only those are shuffled, and k x dims of them reach the driver. No vector is shuffled, so no cluster, however large,
meets in one task.

Defined results: rows whose vector is null, has another length, or a null, NaN or infinite component are left out;
a repeated row counts as often as it occurs; a null key is ranked as the empty string; vectors of equal rank are ordered by their
components; with fewer vectors than k there are fewer centroids; integers beyond +-2**27 count as +-2**27, so that
squared distances fit a long; a sum of distances that does not fit one is null. Other columns stay, but for those named
as the columns that are added. An empty table gives no row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.llm.common import cut, free_name

K, DIMS, SCALE, ROUNDS, SEED = 16, 64, 64, 3, "1"
#: Largest size of a component.
MOST = 1 << 27
#: More than the relative error of a square root and a few sums of doubles.
SLACK = 1e-12
ADDED = ("cluster", "distance", "scans")
STATE = "cluster int, distance long, scans int, upper double, lower double"

Batches = Iterator[pa.RecordBatch]


def integer_vectors(df: DataFrame, column: str, out: str, dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """The rows with a whole vector, and floor(scale * x) of its components as `out`."""
    x = F.col(column)
    whole = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < float("inf")))
    number = lambda v: F.floor(F.greatest(F.least(v.cast("double") * scale, F.lit(float(MOST))), F.lit(float(-MOST)))).cast("int")
    return df.where(x.isNotNull() & (F.size(x) == dims) & whole).withColumn(out, F.transform(x, number))


def first_centroids(vectors: DataFrame, key: str, vector: str, k: int = K, seed: str = SEED) -> np.ndarray:
    """The k vectors that come first by sha256 of seed:key; k x dims numbers."""
    rank = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256)
    rows = vectors.select(rank.alias("rank"), F.col(vector).alias("v")).orderBy("rank", "v").limit(k).collect()
    return np.array([r["v"] for r in rows], dtype=np.int64)


def squared(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows to all centers."""
    return (x * x).sum(1)[:, None] - 2 * (x @ centers.T) + (centers * centers).sum(1)[None, :]


def over(squares: np.ndarray) -> np.ndarray:
    return np.sqrt(squares.astype(np.float64)) * (1 + SLACK)


def under(squares: np.ndarray) -> np.ndarray:
    return np.sqrt(squares.astype(np.float64)) * (1 - SLACK)


def gaps(centers: np.ndarray) -> np.ndarray:
    """Half the distance of each centroid to the nearest other one, at most."""
    apart = under(squared(centers, centers))
    np.fill_diagonal(apart, np.inf)
    return apart.min(1) / 2 * (1 - SLACK)


def moves(old: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How far each centroid has moved at most, and the largest such move of the others."""
    own = over(((new - old) ** 2).sum(1))
    others = np.array([np.delete(own, j).max(initial=0.0) for j in range(len(own))])
    return own, others


def scan(x: np.ndarray, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest centroid, squared distance, and a lower bound for the others, by all distances."""
    d = squared(x, centers)
    nearest = d.argmin(1)
    best = d[np.arange(len(x)), nearest]
    if len(centers) == 1:
        return nearest, best, np.full(len(x), np.inf)
    d[np.arange(len(x)), nearest] = np.iinfo(np.int64).max
    return nearest, best, under(d.min(1))


def settle(x: np.ndarray, state: dict[str, np.ndarray], centers: np.ndarray, before: np.ndarray) -> dict[str, np.ndarray]:
    """The state of vectors after centroids went from `before` to `centers`."""
    own, others = moves(before, centers)
    a = state["cluster"].copy()
    scans = state["scans"].copy()
    upper = (state["upper"] + own[a]) * (1 + SLACK)
    lower = state["lower"] - others[a]
    lower = lower - np.abs(lower) * SLACK
    fence = np.maximum(gaps(centers)[a], lower)
    distance = ((x - centers[a]) ** 2).sum(1)
    open_ = np.flatnonzero(upper >= fence)
    upper[open_] = over(distance[open_])
    open_ = open_[upper[open_] >= fence[open_]]
    if len(open_):
        a[open_], distance[open_], lower[open_] = scan(x[open_], centers)
        upper[open_] = over(distance[open_])
        scans[open_] += 1
    return {"cluster": a, "distance": distance, "scans": scans, "upper": upper, "lower": lower}


def fresh(x: np.ndarray, centers: np.ndarray) -> dict[str, np.ndarray]:
    """The state of vectors that have none yet: all are scanned."""
    a, distance, lower = scan(x, centers)
    return {"cluster": a, "distance": distance, "scans": np.ones(len(x), np.int32), "upper": over(distance), "lower": lower}


def matrix(batch: pa.RecordBatch, vector: str, dims: int) -> np.ndarray:
    return batch.column(vector).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims)


def assigning(vector: str, dims: int, names: dict[str, str], centers: np.ndarray, before: np.ndarray | None) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        for batch in batches:
            x = matrix(batch, vector, dims)
            old = {c: batch.column(n).to_numpy(zero_copy_only=False) for c, n in names.items() if n in batch.schema.names}
            new = fresh(x, centers) if before is None else settle(x, old, centers, before)
            made = {names["cluster"]: pa.int32(), names["distance"]: pa.int64(), names["scans"]: pa.int32(), names["upper"]: pa.float64(), names["lower"]: pa.float64()}
            rest = [c for c in batch.schema.names if c not in made]
            columns = [batch.column(c) for c in rest] + [pa.array(new[c], made[n]) for c, n in names.items()]
            yield pa.RecordBatch.from_arrays(columns, names=[*rest, *names.values()])

    return run


def summing(vector: str, cluster: str, dims: int, k: int) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        sums, counts = np.zeros((k, dims), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            x, a = matrix(batch, vector, dims), batch.column(cluster).to_numpy(zero_copy_only=False)
            counts += np.bincount(a, minlength=k)
            for j in np.unique(a):
                sums[j] += x[a == j].sum(0)
        used = np.flatnonzero(counts)
        lists = pa.array(list(sums[used]), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(counts[used], pa.int64()), lists], names=["cluster", "count", "sums"])

    return run


def next_centroids(state: DataFrame, vector: str, cluster: str, centers: np.ndarray) -> np.ndarray:
    """floor(sum / count) of each cluster's vectors; a cluster without any keeps its centroid."""
    k, dims = centers.shape
    parts = state.select(vector, cluster).mapInArrow(summing(vector, cluster, dims, k), "cluster int, count long, sums array<long>")
    totals = parts.select("cluster", "count", F.posexplode("sums").alias("i", "v")).groupBy("cluster", "i").agg(F.sum("v").alias("v"), F.sum("count").alias("n"))
    new = centers.copy()
    for r in totals.collect():  # k x dims rows at most
        new[r["cluster"], r["i"]] = r["v"] // r["n"]
    return new


def cluster_vectors(
    df: DataFrame, key: str = "vec_id", column: str = "embedding", k: int = K, dims: int = DIMS, scale: int = SCALE, rounds: int = ROUNDS, seed: str = SEED
) -> tuple[DataFrame, np.ndarray]:
    """The rows with a whole vector with cluster, distance (squared) and scans (how often all distances were measured), and the final centroids."""
    df = df.drop(*ADDED)
    vector = free_name(df, "vector")
    vectors = integer_vectors(df, column, vector, dims, scale)
    centers = first_centroids(vectors, key, vector, k, seed)
    if not len(centers):
        return vectors.drop(vector).select("*", *[F.lit(None).cast(t).alias(c) for c, t in zip(ADDED, ("int", "long", "int"), strict=True)]), centers
    names = {c.split(" ")[0]: free_name(df, c.split(" ")[0]) for c in STATE.split(", ")}
    added = [T.StructField(names[f.name], f.dataType) for f in T.StructType.fromDDL(STATE)]
    state, before = vectors, None
    for n in range(rounds + 1):
        rest = [f for f in state.schema if f.name not in names.values()]
        state = cut(state.mapInArrow(assigning(vector, dims, names, centers, before), T.StructType(rest + added)), "vectors")
        if n < rounds:
            before, centers = centers, next_centroids(state, vector, names["cluster"], centers)
    kept = [c for c in state.columns if c not in (vector, *names.values())]
    return state.select(*kept, *[F.col(names[c]).alias(c) for c in ADDED]), centers


def fitting(total: Any) -> int | None:
    return int(total) if total is not None and int(total) < 1 << 63 else None


def clustered_vectors(embeddings: DataFrame) -> DataFrame:
    """Cluster and distance of each vector, with the sums over its cluster and over all and a digest of its centroid."""
    rows, centers = cluster_vectors(embeddings.select("vec_id", "embedding"))
    found = rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()  # k rows at most
    total = fitting(sum(r["d"] for r in found))
    digest = {j: hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for j, c in enumerate(centers.tolist())}
    known = [(r["cluster"], fitting(r["d"]), total, digest[r["cluster"]]) for r in found]
    about = df_of(rows, known)
    return rows.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def df_of(rows: DataFrame, known: list[tuple]) -> DataFrame:
    return rows.sparkSession.createDataFrame(known, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
