"""Centroid clustering of integer vectors: bit planes in 64-bit words, exact dot products by weighted AND-popcounts."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varloom.llm.common import written
from varloom.llm.int_vectors import first_vectors, moved, scaled, whole

#: Vectors that are compared in step.
BLOCK = 2048


def plane_weights(planes: int) -> np.ndarray:
    """What a set bit of each plane is worth: powers of two, the last plane (the sign of two's complement) a negative one."""
    w = np.int64(1) << np.arange(planes, dtype=np.int64)
    w[-1] = -w[-1]
    return w


def pack(x: np.ndarray) -> np.ndarray:
    """(rows, planes, words): bit planes of two's complement, 64 components a word, with as many planes as the values need."""
    rows, dims = x.shape
    most = int(np.maximum(x, ~x).max(initial=0))
    planes = most.bit_length() + 1
    bits = np.zeros((rows, planes, -(-dims // 64) * 64), np.uint8)
    bits[:, :, :dims] = (x[:, None, :] >> np.arange(planes)[None, :, None]) & 1
    return np.packbits(bits, axis=2, bitorder="little").view("<u8")


def unpack(planes: np.ndarray, dims: int) -> np.ndarray:
    """The integers that pack() packed."""
    bits = np.unpackbits(np.ascontiguousarray(planes).view(np.uint8), axis=2, bitorder="little")[:, :, :dims]
    return np.einsum("rpd,p->rd", bits, plane_weights(planes.shape[1]), dtype=np.int64)


def dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact dot product of each row of a (rows, planes, words) with b (planes, words): the population count of every pair of planes
    ANDed, weighted by both planes' values."""
    total = np.zeros(len(a), np.int64)
    own = plane_weights(a.shape[1])
    for weight, plane in zip(plane_weights(len(b)).tolist(), b, strict=True):
        if plane.any():
            total += weight * (np.bitwise_count(a & plane).sum(2, dtype=np.int64) @ own)
    return total


def squares(a: np.ndarray) -> np.ndarray:
    """The squared length of each row, by the same counts."""
    own, total = plane_weights(a.shape[1]), np.zeros(len(a), np.int64)
    for i, weight in enumerate(own.tolist()):
        total += weight * (np.bitwise_count(a & a[:, i : i + 1]).sum(2, dtype=np.int64) @ own)
    return total


def nearest(a: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number, squared distance) of the nearest centroid of each packed row; ties go to the smaller number."""
    packed, own = pack(centroids), squares(a)
    distance = np.stack([own - 2 * dots(a, p) + int(c @ c) for c, p in zip(centroids, packed, strict=True)], 1)
    best = distance.argmin(1)
    return best, distance[np.arange(len(a)), best]


def planes_of(vectors: DataFrame, id_col: str, vec_col: str, dims: int, scale: int) -> DataFrame:
    """(id, planes, packed): each vector's bit planes as one binary value, with its number of planes."""
    kind = vectors.select(F.col(id_col).alias("id")).schema["id"].dataType.simpleString()

    def packing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                a = pack(scaled(part["v"], dims, scale))
                held = pa.array([row.tobytes() for row in a], pa.binary())
                yield pa.RecordBatch.from_arrays([part["id"], pa.array(np.full(len(a), a.shape[1]), pa.int32()), held], ["id", "planes", "packed"])

    return vectors.select(F.col(id_col).alias("id"), F.col(vec_col).alias("v")).mapInArrow(packing, f"id {kind}, planes int, packed binary")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Rows that have the same number of planes, with their planes."""
    for batch in batches:
        counts = batch["planes"].to_numpy(zero_copy_only=False)
        for n in np.unique(counts):
            mine = np.flatnonzero(counts == n)
            for at in range(0, len(mine), BLOCK):
                part = batch.take(pa.array(mine[at : at + BLOCK]))
                yield part, np.frombuffer(b"".join(part["packed"].to_pylist()), "<u8").reshape(part.num_rows, n, -1)


def _sums(packed: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(cluster, n, s): what each task's vectors sum up to in each cluster."""
    dims = centroids.shape[1]

    def summing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64)
        for _, a in _blocks(batches):
            best, _ = nearest(a, centroids)
            n += np.bincount(best, minlength=len(n))
            np.add.at(s, best, unpack(a, dims))
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(n[used]), pa.array(s[used].tolist(), pa.list_(pa.int64()))], ["cluster", "n", "s"])

    return packed.mapInArrow(summing, "cluster int, n long, s array<bigint>")


def _assigned(packed: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(id, cluster, distance) of every vector."""

    def assigning(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, a in _blocks(batches):
            best, distance = nearest(a, centroids)
            yield pa.RecordBatch.from_arrays([part["id"], pa.array(best, pa.int32()), pa.array(distance)], ["id", "cluster", "distance"])

    kind = packed.schema["id"].dataType.simpleString()
    return packed.mapInArrow(assigning, f"id {kind}, cluster int, distance long")


def cluster(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", dims: int = 64, scale: int = 64, clusters: int = 16, rounds: int = 3, seed: int = 1) -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector with exactly `dims` components.

    Components become floor(scale * x). Centroids start as the `clusters` vectors with the smallest sha256 of `<seed>:<id>`; each round
    assigns every vector to the nearest one and moves each centroid to the floor of its vectors' mean, an empty one stays; a last
    assignment follows. All numbers are exact integers: distances come from weighted AND-popcounts of bit planes.

    Vectors that are NULL, of another length, or hold NULL or non-finite components have no row. Fewer vectors than `clusters` make fewer
    centroids, an empty table gives an empty one. Rows that repeat an id are vectors each for itself; where ids tie or are NULL, the
    start goes by the components, NULL ids last. Equal vectors share a cluster. A component so large that squared distances would leave 64 bits
    is an error, and so is an inertia beyond them. Other columns are not read. A pass sends one row a task and cluster; the vectors are packed and written once.
    """
    kept = vectors.where((F.size(F.col(vec_col)) == dims) & whole(F.col(vec_col)))
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")).cast("binary"), 256)
    centroids = first_vectors(kept, [name], clusters, id_col, vec_col, dims, scale)
    packed = written(planes_of(kept, id_col, vec_col, dims, scale), "bit-planes")
    for _ in range(rounds if len(centroids) else 0):
        for (at,), (_, mean) in moved(_sums(packed, centroids), ["cluster"], dims).items():
            centroids[at] = mean
    if not len(centroids):
        return _table(vectors.sparkSession, [], packed).limit(0)
    found = written(_assigned(packed, centroids), "clusters")
    inertia = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("own"))
    own = {r["cluster"]: int(r["own"]) for r in inertia.collect()}
    digest = lambda c: hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()
    rows = [(k, own[k], sum(own.values()), digest(c)) for k, c in enumerate(centroids) if k in own]
    return _table(vectors.sparkSession, rows, found)


def _table(spark, rows: list[tuple], found: DataFrame) -> DataFrame:
    """The assigned rows with what holds for their cluster: one small row for each of a fixed number of clusters."""
    about = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    if "cluster" not in found.columns:
        found = found.select("id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"))
    return found.join(F.broadcast(about), "cluster").select("id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
