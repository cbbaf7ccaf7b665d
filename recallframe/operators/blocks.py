"""Exact best rows of queries: blocks of rows meet blocks of queries as matrices, in Arrow batches.

A product of matrices finds which pairs can be among a query's best of the block (its rounding error allowed for); these alone are
scored again, summed in double precision in order of the components. Pairs without a score (a vector that is null, holds null or
has another length) come last, NaN first, ties by the smaller ordinal, as in Spark's own order.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows and queries of a block at most.
ROWS, QUERIES = 5000, 512


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows as blocks: a row with a list for each column."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            own = batch.slice(at, ROWS)
            ends = pa.array([0, own.num_rows], pa.int32())
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(ends, c) for c in own.columns], names=own.schema.names)


def _lengths(vectors: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(vectors), -1).to_numpy(zero_copy_only=False)


def _matrix(vectors: pa.Array, at: np.ndarray, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """The vectors at ``at``, all of length ``dim``, and which of them hold a null."""
    flat = vectors.take(pa.array(at)).flatten()
    null = pc.is_null(flat).to_numpy(zero_copy_only=False).reshape(len(at), dim).any(axis=1) if flat.null_count else np.zeros(len(at), bool)
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), dim), null


def _scored(x: np.ndarray, q: np.ndarray, k: int, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (query, row) that can be among a query's k best and reach its floor, with their scores."""
    plain, sound = np.isfinite(x).all(axis=1), np.isfinite(q).all(axis=1)
    near = q @ np.where(plain[:, None], x, 0).T
    near[:, ~plain] = -np.inf
    kth = np.partition(near, len(x) - k, axis=1)[:, len(x) - k] if len(x) > k else np.full(len(q), -np.inf)
    size = np.sqrt((x[plain] ** 2).sum(axis=1).max(initial=0)) * np.sqrt((q * q).sum(axis=1))
    slack = 8 * (x.shape[1] + 1) * np.finfo(float).eps * size
    least = np.maximum(kth, floor) - np.where(np.isfinite(slack), slack, np.inf)
    least = np.where(np.isnan(least) | ~sound, -np.inf, least)
    wanted = ~(near < least[:, None])
    wanted[:, ~plain] = True
    j, i = np.nonzero(wanted)
    score = np.zeros(len(j))
    for a, b in zip(np.ascontiguousarray(x.T), np.ascontiguousarray(q.T), strict=True):
        score += a[i] * b[j]
    kept = ~(score < floor[j])
    return j[kept], i[kept], score[kept]


def _meeting(k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For pairs of blocks: each query's k best rows of the block that reach its floor (null: no floor)."""

    def met(ids: pa.Array, ordinals: pa.Array, vectors: pa.Array, asked: pa.StructArray) -> pa.RecordBatch:
        order = pc.array_sort_indices(ordinals, null_placement="at_start")
        vectors, wanted = vectors.take(order), asked.field("q")
        floor = pc.fill_null(asked.field("floor"), -np.inf).to_numpy(zero_copy_only=False)
        rows, queries = _lengths(vectors), _lengths(wanted)
        parts: list[tuple[np.ndarray, ...]] = []
        have, others = np.zeros(len(queries), np.int64), {}
        for dim in np.unique(queries[queries >= 0]):
            qs, xs = np.flatnonzero(queries == dim), np.flatnonzero(rows == dim)
            q, q_null = _matrix(wanted, qs, dim)
            x, x_null = _matrix(vectors, xs, dim)
            qs, q, xs, x = qs[~q_null], q[~q_null], xs[~x_null], x[~x_null]
            have[qs], others[dim] = len(xs), np.setdiff1d(np.arange(len(rows)), xs)
            if len(qs) and len(xs):
                with np.errstate(all="ignore"):
                    j, i, score = _scored(x, q, k, floor[qs])
                parts.append((qs[j], xs[i], score, np.isnan(score) * 2))
        for j in np.flatnonzero((have < k) & (floor == -np.inf)):  # pairs without a score
            rest = (others[queries[j]] if have[j] else np.arange(len(rows)))[: k - have[j]]
            parts.append((np.full(len(rest), j), rest, np.full(len(rest), 0.0), np.full(len(rest), 1)))
        j, i, score, kind = (np.concatenate(c) for c in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))
        best = np.lexsort((i, -np.where(kind == 0, score, 0), np.array([1, 2, 0])[kind], j))
        j, i, score, kind = j[best], i[best], score[best], kind[best]
        kept = np.arange(len(j)) - np.searchsorted(j, j) < k
        at = pa.array(order.to_numpy()[i[kept]])
        return pa.RecordBatch.from_arrays([asked.field("query_id").take(pa.array(j[kept])), ids.take(at), ordinals.take(at), pa.array(score[kept], mask=kind[kept] == 1)], names=["query_id", "id", "ordinal", "score"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(batch.num_rows):
                yield met(*(batch.column(c)[n].values for c in ("id", "ordinal", "v", "asked")))

    return work


def best_in_blocks(rows: DataFrame, asked: DataFrame, k: int, most: int) -> DataFrame:
    """query_id, id, ordinal and score of pairs of all rows (id, ordinal, v) with all queries (query_id, q and floor, below which a score
    isn't wanted): among them the k best of each query, and k for each block of rows at most. Up to ``most``
    queries are broadcast, more meet the rows as a product of partitions."""
    spark = rows.sparkSession

    def numbers(df: DataFrame, c: str) -> DataFrame:
        return df if df.schema[c].dataType == T.ArrayType(T.FloatType(), df.schema[c].dataType.containsNull) else df.withColumn(c, F.col(c).cast("array<double>"))

    rows, asked = numbers(rows.select("id", "ordinal", "v"), "v"), numbers(asked.select("query_id", "q", "floor"), "q")
    count = asked.count()
    dealt = asked.groupBy(F.pmod(F.xxhash64("query_id"), F.lit(max(1, -(-count // QUERIES)))).alias("block")).agg(F.collect_list(F.struct("query_id", "q", F.col("floor").cast("double").alias("floor"))).alias("asked")).select("asked")
    dealt = F.broadcast(dealt) if count <= most else dealt.repartition(-(-count // most))
    listed = T.StructType([T.StructField(f.name, T.ArrayType(f.dataType)) for f in rows.schema])
    packed = rows.repartition(2 * spark.sparkContext.defaultParallelism).mapInArrow(_packed, listed)
    found = T.StructType([T.StructField("query_id", asked.schema["query_id"].dataType), *[T.StructField(c, rows.schema[c].dataType) for c in ("id", "ordinal")], T.StructField("score", T.DoubleType())])
    return packed.crossJoin(dealt).mapInArrow(_meeting(k), found)
