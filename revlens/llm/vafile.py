"""Exact nearest neighbours by vector-approximation files."""

from __future__ import annotations

import functools
import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh_dir, hash_range, local_path, partitions

#: Neighbours of a query; queries are the vectors whose ids are divisible by this.
K, EVERY = 10, 50
#: Cells in each dimension; vectors of a shard, about; queries and approximations compared at once; vectors read at once.
CELLS, SHARD, QUERIES, BLOCK, READ = 256, 1 << 17, 512, 8192, 32


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, d)


def _stored(folder: str, name: str, values: np.ndarray) -> None:
    part = f"{folder}/.{name}-{uuid.uuid4().hex}"
    values.tofile(part)
    os.replace(part, f"{folder}/{name}")


def _ordered(distance: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, distance))[:k]


class Files:
    """The shards of vectors of one length: ids, cells, distances to the cells' centres, and exact vectors, all mapped."""

    def __init__(self, folder: str, d: int, shards: list[int], low: np.ndarray, width: np.ndarray):
        self.folder, self.d, self.shards, self.low, self.width = folder, d, shards, low, width
        self.shard = functools.cache(self._shard)

    def _shard(self, i: int):
        def array(name: str, kind: str) -> np.ndarray:
            return np.memmap(f"{self.folder}/{self.d}-{i}.{name}", kind, "r")

        return array("ids", "i8"), array("cells", "u1").reshape(-1, self.d), array("off", "f8"), array("exact", "f4").reshape(-1, self.d)

    def nearest(self, q: np.ndarray, own: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query, the ids and distances of the k nearest others, exact.

        First all cells are scanned: a vector is as far from the query as its cell's centre is, give or take its distance
        to the centre. What can't be nearer than the kth upper bound is out. Then the exact vectors of the rest are read in
        the order of their lower bounds, until the kth found is nearer than the next bound.
        """
        n, q = len(q), q.astype(np.float64)  # whose squares neither overflow nor vanish for any single-precision value
        bound = np.full((n, k), np.inf)
        kept: list[list[tuple[int, np.ndarray, np.ndarray]]] = [[] for _ in range(n)]
        q2 = (q * q).sum(axis=1)
        for s in self.shards:
            ids, cells, off, _ = self.shard(s)
            for a in range(0, len(ids), BLOCK):
                centre = self.low + (cells[a : a + BLOCK] + 0.5) * self.width
                both = q2[:, None] + (centre * centre).sum(axis=1)[None, :]
                square = both - 2 * (q @ centre.T)
                slack = 4e-16 * (self.d + 8) * both  # what rounding can do to the squares, at most
                r = off[a : a + BLOCK][None, :]
                upper = np.sqrt(np.maximum(square + slack, 0)) * (1 + 1e-12) + r
                same = ids[a : a + BLOCK][None, :] == own[:, None]
                upper[same] = np.inf
                best = np.partition(upper, min(k, upper.shape[1]) - 1, axis=1)[:, :k]
                bound = np.partition(np.concatenate((bound, best), axis=1), k - 1, axis=1)[:, :k]
                lower = np.sqrt(np.maximum(square - slack, 0)) * (1 - 1e-12) - r
                i, j = np.nonzero((lower <= bound.max(axis=1)[:, None]) & ~same)
                who, starts = np.unique(i, return_index=True)
                for x, at in zip(who, np.split(j, starts[1:])):
                    kept[x].append((s, at + a, lower[x, at]))
        out = []
        for x in range(n):
            if not kept[x]:
                out.append((np.zeros(0, np.int64), np.zeros(0)))
                continue
            shard = np.repeat([s for s, _, _ in kept[x]], [len(at) for _, at, _ in kept[x]])
            row = np.concatenate([at for _, at, _ in kept[x]])
            lower = np.concatenate([v for _, _, v in kept[x]])
            sel = np.flatnonzero(lower <= bound[x].max())
            sel = sel[np.argsort(lower[sel], kind="stable")]
            ids, distance = np.zeros(0, np.int64), np.zeros(0)
            for a in range(0, len(sel), READ):
                if len(distance) >= k and lower[sel[a]] > np.partition(distance, k - 1)[k - 1]:
                    break
                for s in np.unique(shard[sel[a : a + READ]]):
                    at = row[sel[a : a + READ][shard[sel[a : a + READ]] == s]]
                    have, _, _, exact = self.shard(int(s))
                    gap = exact[at].astype(np.float64) - q[x]
                    ids, distance = np.concatenate((ids, have[at])), np.concatenate((distance, np.sqrt((gap * gap).sum(axis=1))))
            order = _ordered(distance, ids, k)
            out.append((ids[order], distance[order]))
        return out


def neighbours(vectors: DataFrame, k: int = K, every: int = EVERY) -> DataFrame:
    """(vec_id, rank, neighbour_id, distance): of each query the k nearest other vectors of all by Euclidean distance, exact.

    Queries are the vectors whose vec_id is divisible by `every` (1: all). Ranks are from 1; ties go by neighbour_id. Distances are of double precision, rounded to 6 places. Rows without vec_id,
    and vectors that are null or empty, or hold a null or a value that isn't finite, are left out. Of rows with the same
    vec_id the least vector counts. Vectors are compared to those of the same length; where there are fewer than k others,
    all are given. Values may be as large as single precision goes. An empty table gives an empty result. Other columns
    are not read, whatever their names.

    The approximations, a byte for each dimension, and the vectors are files in the shared folder (which must be mounted);
    each task maps them and scans them for its share of the queries.
    """
    spark = vectors.sparkSession
    n = partitions(spark)
    clean = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<float>").alias("v"))
    clean = clean.where("vec_id IS NOT NULL AND size(v) > 0 AND forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < float('inf'))")
    clean = clean.groupBy("vec_id").agg(F.min("v").alias("v")).repartition(n, "vec_id")

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.diff(batch.column("v").offsets.to_numpy())
            for d in np.unique(size):
                x = _matrix(batch.column("v").filter(pa.array(size == d)), d)
                yield pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), pa.array([len(x)], pa.int64()), pa.array([x.min(axis=0).tolist()], pa.list_(pa.float32())), pa.array([x.max(axis=0).tolist()], pa.list_(pa.float32()))], names=["d", "n", "low", "high"])

    found: dict[int, tuple[int, np.ndarray, np.ndarray]] = {}
    spans = clean.mapInArrow(ranges, "d int, n bigint, low array<float>, high array<float>").selectExpr("d", "n", "posexplode(arrays_zip(low, high)) AS (j, b)")
    spans = spans.groupBy("d", "j").agg(F.sum("n").alias("n"), F.min("b.low").alias("low"), F.max("b.high").alias("high"))
    for row in spans.groupBy("d").agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("j", "low", "high"))).alias("b")).collect():  # a row for each length
        found[row["d"]] = row["n"], np.array([b["low"] for b in row["b"]]), np.array([b["high"] for b in row["b"]])

    folder = local_path(fresh_dir(spark, "vafile"))
    os.makedirs(folder)
    shards = max(1, -(-sum(x[0] for x in found.values()) // SHARD))
    grids = {d: (low, np.maximum((high - low) / CELLS, 1e-300)) for d, (_, low, high) in found.items()}

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[tuple[int, int], list[tuple[np.ndarray, np.ndarray]]] = {}
        for batch in batches:
            size = np.diff(batch.column("v").offsets.to_numpy())
            shard = batch.column("shard").to_numpy(zero_copy_only=False)
            for d, s in {*zip(size.tolist(), shard.tolist())}:
                at = pa.array((size == d) & (shard == s))
                parts.setdefault((d, s), []).append((batch.column("vec_id").filter(at).to_numpy(zero_copy_only=False), _matrix(batch.column("v").filter(at), d)))
        for (d, s), blocks in parts.items():
            ids, x = (np.concatenate(b) for b in zip(*blocks))
            low, width = grids[d]
            cells = np.clip((x - low) / width, 0, CELLS - 1).astype(np.uint8)
            gap = x.astype(np.float64) - (low + (cells + 0.5) * width)
            off = np.sqrt((gap * gap).sum(axis=1)) * (1 + 1e-12)
            for name, values in (("ids", ids.astype(np.int64)), ("cells", cells), ("off", off), ("exact", x)):
                _stored(folder, f"{d}-{s}.{name}", values)
            yield pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), pa.array([s], pa.int32())], names=["d", "s"])

    placed = clean.withColumn("shard", hash_range(F.xxhash64("vec_id"), shards)).repartitionById(shards, F.col("shard"))
    have: dict[int, list[int]] = {}
    for d, s in placed.mapInArrow(store, "d int, s int").collect():  # a row for each shard
        have.setdefault(d, []).append(s)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = {d: Files(folder, d, sorted(s), *grids[d]) for d, s in have.items()}
        for whole in batches:
            for start in range(0, whole.num_rows, QUERIES):
                batch = whole.slice(start, QUERIES)
                size = np.diff(batch.column("v").offsets.to_numpy())
                for d in np.unique(size):
                    at = pa.array(size == d)
                    own = batch.column("vec_id").filter(at).to_numpy(zero_copy_only=False)
                    rows = files[d].nearest(_matrix(batch.column("v").filter(at), d), own, k)
                    counts = [len(ids) for ids, _ in rows]
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(own, counts)), pa.array(np.concatenate([np.arange(1, c + 1) for c in counts]), pa.int32()), pa.array(np.concatenate([ids for ids, _ in rows])), pa.array(np.round(np.concatenate([x for _, x in rows]), 6))], names=["vec_id", "rank", "neighbour_id", "distance"])

    return clean.where(F.pmod("vec_id", F.lit(every)) == 0).mapInArrow(search, "vec_id bigint, rank int, neighbour_id bigint, distance double")


SQL = f"""
WITH v AS (SELECT vec_id, min(embedding) AS v FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0 GROUP BY vec_id),
pairs AS (
    SELECT a.vec_id, b.vec_id AS neighbour_id, list_distance(CAST(a.v AS DOUBLE[]), CAST(b.v AS DOUBLE[])) AS d
    FROM v a JOIN v b ON a.vec_id % {EVERY} = 0 AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
), ranked AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, neighbour_id) AS rank FROM pairs)
SELECT vec_id, CAST(rank AS INTEGER) AS rank, neighbour_id, round(d, 6) AS distance FROM ranked WHERE rank <= {K}
"""
