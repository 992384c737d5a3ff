"""Nearest neighbours by randomly rotated one-bit codes with error bounds.

A unit vector x, padded with zeros to at least BITS components and rotated at random, is stored as the signs of its
components, packed into bits, and the scalar f = <code, x>. For a rotated query q, <code, q> / f estimates <x, q> with an
error of at most EPSILON * sqrt((1 - f^2) / f^2) / sqrt(bits - 1), but for a tiny share of pairs. <code, q> comes from
the bits alone: the query is cut into PLANES bit planes, and set bits that a code shares with each are counted.

The index is a written table: codes, scalars and vectors, ordered by the nearest of a bounded sample of pivots, so
that a block of rows lies close together. A block is passed over by queries whose best score so far no vector within the
block's angle can reach. Of the others' rows only those whose upper bound reaches the query's k-th best exact score are
reranked, exactly. The sample gives each query a first k-th best score.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillscan.llm.common import bounded_batches, give_back, saved

#: Width of the error bound in standard deviations; least bits of a code; bit planes of a query.
EPSILON, BITS, PLANES = 3.5, 256, 4
#: Vectors of a block; queries that are held against it at once; bytes of queries a pass broadcasts; pivots at most (the documented bound of the sample).
ROWS, QUERIES, PASS_BYTES, PIVOTS = 2048, 64, 32 << 20, 1024
HIT = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("vec_id", T.LongType()), T.StructField("score", T.DoubleType())])


def code_bits(dim: int) -> int:
    """The bits of a code: a multiple of 64, at least the dimension and BITS."""
    return max(BITS, -(-dim // 64) * 64)


def rotation(dim: int, seed: int = 7) -> np.ndarray:
    """The first `dim` columns of a random orthogonal matrix of code_bits(dim) rows, the same for every worker."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((code_bits(dim), dim)))
    return q * np.sign(np.diag(r))


def encode(unit: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed sign bits of the rotated unit vectors (64-bit words), and their correction scalars."""
    turned = unit @ turn.T
    return np.packbits(turned > 0, axis=1).view(np.uint64), np.abs(turned).sum(1) / np.sqrt(turn.shape[0])


class Planes:
    """Rotated unit queries as bit planes: component i is about low + step * sum over j of 2^j * bit j."""

    def __init__(self, unit: np.ndarray, turn: np.ndarray):
        turned = unit @ turn.T
        self.bits, self.total, self.low = turned.shape[1], turned.sum(1), turned.min(1)
        self.step = np.maximum(np.ptp(turned, axis=1), 1e-12) / ((1 << PLANES) - 1)
        level = np.rint((turned - self.low[:, None]) / self.step[:, None]).astype(np.uint8)
        self.words = [np.packbits((level >> j) & 1, axis=1).view(np.uint64) for j in range(PLANES)]

    def estimate(self, codes: np.ndarray, scalar: np.ndarray, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Estimated cosines of some queries (rows) and coded vectors (columns), and their error bounds."""
        shared = np.zeros((len(some), len(codes)), np.uint16)
        for j, words in enumerate(self.words):
            for w in range(codes.shape[1]):
                shared += np.bitwise_count(words[some, w, None] & codes[None, :, w]).astype(np.uint16) << np.uint16(j)
        ones = np.bitwise_count(codes).sum(1).astype(np.float32)
        step, low, total = (x[some, None].astype(np.float32) for x in (self.step, self.low, self.total))
        scale = (np.sqrt(self.bits) * scalar).astype(np.float32)
        got = (2 * (low * ones + step * shared) - total) / scale
        spread = np.sqrt(np.maximum(1 - scalar**2, 0) / (self.bits - 1)) / scalar
        error = EPSILON * (spread[None, :] + self.step[some, None] / (np.sqrt(12) * scalar)[None, :]) + 1e-5
        return got, error.astype(np.float32)


def _norms(x: np.ndarray) -> np.ndarray:
    return np.sqrt(np.add.accumulate(x * x, axis=1)[:, -1])


def cosine(x: np.ndarray, norm: np.ndarray, q: np.ndarray, q_norm: float) -> np.ndarray:
    """Cosines of the rows of x with q in double precision, summed left to right: equal rows get equal values."""
    return np.add.accumulate(x * q, axis=1)[:, -1] / (norm * q_norm)


def _top(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, -scores))[:k]


def build(rows: DataFrame, dim: int, pivots: np.ndarray) -> DataFrame:
    """The index of vectors (vec_id, v) of one dimension: a written table of vec_id, v, code and scalar, rows of near pivots together.

    Every row is indexed. Ranges of (pivot, id) make its files, so a pivot of very many rows, or a vector that many
    rows repeat, is spread over several.
    """
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(pivots)
    schema = T.StructType([rows.schema["vec_id"], rows.schema["v"], T.StructField("code", T.BinaryType()), T.StructField("scalar", T.DoubleType()), T.StructField("pivot", T.IntegerType())])

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn, near = rotation(dim), shared.value
        for b in batches:
            x = _matrix(b.column(1), dim)
            unit = x / _norms(x)[:, None]
            codes, scalar = encode(unit, turn)
            raw = pa.FixedSizeBinaryArray.from_buffers(pa.binary(codes.shape[1] * 8), len(codes), [None, pa.py_buffer(np.ascontiguousarray(codes))]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), raw, pa.array(scalar), pa.array((unit @ near.T).argmax(1).astype(np.int32))], names=schema.names)
        give_back()

    coded = rows.mapInArrow(code, schema)
    ranged = coded.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "pivot", "vec_id").sortWithinPartitions("pivot")
    return saved(ranged.drop("pivot"), "codes")


def search(df: DataFrame, id_: str, vector: str, every: int, k: int) -> DataFrame:
    """The k nearest vectors by cosine of each vector whose id is divisible by `every`, among all others of its dimension.

    Columns query_id, rank (from 1), vec_id, score; other columns are not read. Ties go to the smaller id. Vectors that
    are null, empty, of zero length or that hold null or non-finite components take no part, nor do rows without an id.
    Of rows that repeat an id, each takes part; a query's own id is no candidate. Every pass over the index takes as
    many queries as PASS_BYTES hold, so work grows with queries times the rows that bounds can't pass over.
    """
    spark = df.sparkSession
    bounded_batches(spark)
    kept = F.col(vector) if df.schema[vector].dataType in (T.ArrayType(T.FloatType()), T.ArrayType(T.DoubleType())) else F.col(vector).cast("array<double>")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = df.select(F.col(id_).cast("long").alias("vec_id"), kept.alias("v")).where("vec_id is not null and v is not null").where(finite)
    parts = []
    for dim in sorted(r["dim"] for r in rows.select(F.size("v").alias("dim")).distinct().collect()):  # as a rule one
        parts += _search(spark, rows.where(F.size("v") == dim), dim, every, k)
    hits = reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], HIT)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _search(spark: SparkSession, rows: DataFrame, dim: int, every: int, k: int) -> list[DataFrame]:
    """The best hits of each task, pass for pass."""
    some = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(PIVOTS).collect()
    if not some:
        return []
    sample = np.array([r["vec_id"] for r in some]), np.array([r["v"] for r in some], float)
    pivots = sample[1][: max(1, int(np.sqrt(rows.count())))]
    index = build(rows, dim, pivots / _norms(pivots)[:, None])
    asked = index.where(F.col("vec_id") % every == 0).select("vec_id", "v")
    passes = max(1, -(-asked.count() * (dim + 1) * 8 // PASS_BYTES))
    parts = []
    for p in range(passes):
        block = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(passes)) == p).distinct().collect()  # about PASS_BYTES
        if block:
            qid, q = np.array([r[0] for r in block]), np.array([r[1] for r in block], float)
            found = index.mapInArrow(_scan(spark.sparkContext.broadcast((qid, q, _floor(qid, q, *sample, k))), dim, k), HIT)
            parts.append(saved(found, "hits") if passes > 1 else found)
    return parts


def _floor(qid: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> np.ndarray:
    """For each query the k-th best score among the sample, a little lowered: no vector below it is among the k nearest."""
    out, unit = np.full(len(q), -np.inf), x / _norms(x)[:, None]
    for i in range(0, len(q) if len(x) > k else 0, QUERIES):
        s = q[i : i + QUERIES] / _norms(q[i : i + QUERIES])[:, None] @ unit.T
        s[qid[i : i + QUERIES, None] == ids[None, :]] = -np.inf
        out[i : i + QUERIES] = np.partition(s, -k, axis=1)[:, -k] - 1e-9
    return out


def _scan(queries, dim: int, k: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qid, q, floor = queries.value
        turn, q_norm = rotation(dim), _norms(q)
        unit_q = q / q_norm[:, None]
        planes, floor = Planes(unit_q, turn), floor.copy()
        best = [(np.empty(0, np.int64), np.empty(0)) for _ in qid]  # the partition's best so far
        for ids, x, codes, scalar in _blocks(batches, dim):
            norm = _norms(x)
            unit = x / norm[:, None]
            centre = unit.sum(0)
            centre /= max(np.sqrt(centre @ centre), 1e-12)
            width = np.arccos(np.clip((unit @ centre).min(), -1, 1))  # no vector of the block is further from its centre
            reach = np.cos(np.maximum(np.arccos(np.clip(unit_q @ centre, -1, 1)) - width, 0)) + 1e-9
            asked = np.flatnonzero(reach >= floor)
            for i in range(0, len(asked), QUERIES):
                part = asked[i : i + QUERIES]
                near, error = planes.estimate(codes, scalar, part)
                near[ids[None, :] == qid[part, None]] = -np.inf
                first = np.argpartition(near, -k, axis=1)[:, -k:] if near.shape[1] > k else np.tile(np.arange(near.shape[1]), (len(part), 1))
                for row, at in enumerate(part.tolist()):
                    _rerank(best, floor, at, first[row][near[row, first[row]] > -np.inf], ids, x, norm, q, q_norm, k)
                wanted = near + error >= floor[part, None]
                np.put_along_axis(wanted, first, False, axis=1)
                for row in np.flatnonzero(wanted.any(1)).tolist():
                    _rerank(best, floor, part[row], np.flatnonzero(wanted[row]), ids, x, norm, q, q_norm, k)
        sizes = [len(i) for i, _ in best]
        if sum(sizes):
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(qid, sizes)), pa.array(np.concatenate([i for i, _ in best])), pa.array(np.concatenate([s for _, s in best]))], names=HIT.names)
        give_back()

    return scan


def _rerank(best: list, floor: np.ndarray, at: int, some: np.ndarray, ids: np.ndarray, x: np.ndarray, norm: np.ndarray, q: np.ndarray, q_norm: np.ndarray, k: int) -> None:
    """Takes the exact scores of some rows into a query's best; raises its floor to its k-th best."""
    i, s = np.append(best[at][0], ids[some]), np.append(best[at][1], cosine(x[some], norm[some], q[at], q_norm[at]))
    top = _top(i, s, k)
    best[at] = i[top], s[top]
    if len(top) == k:
        floor[at] = max(floor[at], s[top[-1]])


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, dim).astype(float)


def _blocks(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of about ROWS rows: ids, vectors, codes as 64-bit words, scalars."""
    held, n, words = [], 0, code_bits(dim) // 64
    for b in batches:
        held.append((b.column(0).to_numpy(), _matrix(b.column(1), dim), np.frombuffer(b"".join(b.column(2).to_pylist()), np.uint64).reshape(-1, words), b.column(3).to_numpy()))
        n += b.num_rows
        if n >= ROWS:
            yield tuple(np.concatenate(x) for x in zip(*held, strict=True))
            held, n = [], 0
    if n:
        yield tuple(np.concatenate(x) for x in zip(*held, strict=True))


def op7(spark, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding", 50, 5)


ORACLE = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
             AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
n AS (SELECT vec_id, v, sqrt(list_reduce(list_transform(v, lambda x: x * x), lambda a, b: a + b)) AS len FROM e),
p AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
             list_reduce(list_transform(list_zip(c.v, q.v), lambda z: z[1] * z[2]), lambda a, b: a + b) / (c.len * q.len) AS score
      FROM n q JOIN n c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS k FROM p)
SELECT query_id, CAST(k AS INTEGER) AS rank, vec_id, score FROM r WHERE k <= 5
"""
