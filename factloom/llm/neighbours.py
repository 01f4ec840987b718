"""Approximate nearest neighbours: cross-polytope hashing with fast Hadamard pseudo-rotations.

A table turns unit vectors by three rounds of random signs and a Hadamard transform and hashes
each to its nearest signed axis. Vectors lie in one bucket a table; a query probes the buckets of
its PROBES nearest signed axes in each of TABLES tables and ranks what it finds by exact cosine.
Equal vectors are one point, and a bucket with many points is dealt to several tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Measured recall at 5 of the 51,282 test vectors: see the README.
TABLES, PROBES, K = 8, 14, 5
#: Points of a bucket that one task ranks.
CHUNK = 4096
ROUNDS = 3


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of rows; their length is a power of two."""
    n, h = x.shape[1], 1
    x = x.copy()
    while h < n:
        y = x.reshape(len(x), n // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], 2).reshape(len(x), n)
        h *= 2
    return x / np.sqrt(n)


def rotated(x: np.ndarray, number: int, seed: int) -> np.ndarray:
    """Rows under pseudo-rotation `number`, padded with zeros to a power of two."""
    size = 1 << max(0, (x.shape[1] - 1)).bit_length()
    out = np.zeros((len(x), size))
    out[:, : x.shape[1]] = x
    rng = np.random.default_rng([seed, number, size])
    for _ in range(ROUNDS):
        out = hadamard(out * rng.choice([-1.0, 1.0], size))
    return out


def nearest_axes(x: np.ndarray, count: int) -> np.ndarray:
    """The count nearest signed axes of each row, nearest first: axis i as 2i, its opposite as 2i + 1."""
    score = np.stack([x, -x], 2).reshape(len(x), -1)
    count = min(count, score.shape[1])
    top = np.argpartition(-score, count - 1, axis=1)[:, :count]
    order = np.argsort(-np.take_along_axis(score, top, 1), axis=1, kind="stable")
    return np.take_along_axis(top, order, 1)


def usable(v: Column) -> Column:
    """Whether a vector takes part: not null, every component finite, one of them not zero."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return v.isNotNull() & F.coalesce(F.forall(v, finite), F.lit(False)) & F.coalesce(F.exists(v, lambda x: x != 0), F.lit(False))


def points(df: DataFrame, id_col: str, vector_col: str, keep: int) -> DataFrame:
    """(v, dim, ids): equal vectors as one point with its keep smallest ids.

    The window keeps at most keep rows of a vector in each task before the shuffle.
    """
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where(F.col("id").isNotNull() & usable(F.col("v")))
    rows = rows.withColumn("v", F.transform("v", lambda x: x + F.lit(0.0)))
    rows = rows.withColumn("rn", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(F.col("rn") <= keep)
    return rows.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")).withColumn("dim", F.size("v"))


def _matrix(column, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _buckets(df: DataFrame, extra: dict[str, str], tables: int, probes: int, seed: int) -> DataFrame:
    """df (v, dim and extra columns) once for each table and probed bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch["dim"].to_numpy()
            for dim in np.unique(dims):
                some = batch.filter(pa.array(dims == dim))
                x = _matrix(some["v"], int(dim))
                x = x / np.abs(x).max(1, keepdims=True)
                x = x / np.sqrt((x * x).sum(1, keepdims=True))
                for t in range(tables):
                    near = nearest_axes(rotated(x, t, seed), probes)
                    at = np.repeat(np.arange(len(x)), near.shape[1])
                    own = some.take(pa.array(at))
                    yield pa.RecordBatch.from_arrays([*[own[c] for c in ["v", "dim", *extra]], pa.array(np.full(len(at), t, np.int32)), pa.array(near.reshape(-1).astype(np.int32))], names=["v", "dim", *extra, "t", "bucket"])

    schema = "v array<double>, dim int, " + "".join(f"{n} {k}, " for n, k in extra.items()) + "t int, bucket int"
    return df.select("v", "dim", *extra).mapInArrow(run, schema)


def _rank(data: pa.Table, queries: pa.Table, k: int) -> pa.Table:
    """The k nearest points of a bucket's part for each query that probes it, with their ids."""
    out_q, out_id, out_s = [], [], []
    if data.num_rows and queries.num_rows:
        dim = data["dim"][0].as_py()
        x, q = _matrix(data["v"], dim), _matrix(queries["v"], dim)
        ids = data["ids"].to_pylist()
        nx, nq = np.sqrt((x * x).sum(1)), np.sqrt((q * q).sum(1))
        for i, own in enumerate(queries["query_id"].to_pylist()):
            # The same sums in the same order, whichever task and probe finds the pair.
            score = (x * q[i]).sum(1) / (nx * nq[i])
            take = min(k + 1, len(score))
            edge = np.partition(-score, take - 1)[take - 1]
            found = [(-score[j], y) for j in np.flatnonzero(-score <= edge).tolist() for y in ids[j] if y != own]
            for s, y in sorted(found)[:k]:
                out_q.append(own)
                out_id.append(y)
                out_s.append(-float(s))
    return pa.table({"query_id": pa.array(out_q, pa.int64()), "vec_id": pa.array(out_id, pa.int64()), "score": pa.array(out_s, pa.float64())})


def nearest(df: DataFrame, queries: DataFrame, k: int = K, tables: int = TABLES, probes: int = PROBES, seed: int = 4, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found rows of df for each row of queries.

    score is the cosine in double precision on the vectors as given; the largest come first, ties
    go to the smaller id; a query's own id is not among its candidates. Null vectors, zero ones,
    those with null or non-finite components and rows with null ids take no part; vectors of
    another length than the query's are no candidates; an id given twice among queries is
    answered once; fewer than k candidates give fewer rows, and empty tables none.
    """
    common.bound_batches(df.sparkSession)
    data = points(df, id_col, vector_col, k + 1)
    data = _buckets(data, {"ids": "array<bigint>"}, tables, 1, seed)
    asked = queries.select(F.col(id_col).cast("long").alias("query_id"), F.col(vector_col).cast("array<double>").alias("v")).where(F.col("query_id").isNotNull() & usable(F.col("v")))
    asked = asked.dropDuplicates(["query_id"]).withColumn("v", F.transform("v", lambda x: x + F.lit(0.0))).withColumn("dim", F.size("v"))
    asked = _buckets(asked, {"query_id": "long"}, tables, probes, seed)
    # At most tables * 2 * length sizes, whatever the number of rows.
    sizes = data.groupBy("dim", "t", "bucket").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("chunks"))
    key = ["dim", "t", "bucket", "chunk"]
    data = data.join(F.broadcast(sizes), ["dim", "t", "bucket"]).withColumn("chunk", F.pmod(F.xxhash64("v"), F.col("chunks")).cast("int"))
    asked = asked.join(F.broadcast(sizes), ["dim", "t", "bucket"]).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    found = data.select(*key, "v", "ids").groupBy(*key).cogroup(asked.select(*key, "v", "query_id").groupBy(*key)).applyInArrow(lambda a, b: _rank(a, b, k), "query_id long, vec_id long, score double")
    best = found.distinct().withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return best.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def op4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = common.table(spark, sf_dir, "embeddings")
    return nearest(rows, rows.where("vec_id % 50 = 0"))
