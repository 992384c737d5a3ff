"""Compression of vectors to codes of 16 bytes: a codebook for each of 16 parts, fitted and searched exactly on integers.

Each part of a vector gets the index of its codebook's nearest entry by an exponion search: u being the distance to its
previous entry a, a nearer entry c has d(a, c) <= d(a, x) + d(x, c) <= 2 u, so only a's neighbour entries within 2 u are
scanned, nearest first. Distances are squared integers: c is within the radius if d^2(a, c) <= 4 u^2, and entries equally
near are told by their index. Codebooks (16 x 64 entries) are all that the driver holds; sums of a round are added up
in each task first.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillscan.llm.common import bounded_batches, give_back, saved

#: Parts of a vector, entries of a codebook, rounds of fitting, and the whole parts that a component is cut into.
PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Largest scaled component, so that squared distances of parts of up to 128 components stay within 63 bits; beyond it a component is held to it.
MOST = 1 << 27
#: Labels that are broadcast at most; rows that are searched at once.
MOST_SENT, SEARCHED = 100_000, 512
CODED = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("label", T.LongType()), T.StructField("v", T.BinaryType()), T.StructField("code", T.BinaryType()), T.StructField("error", T.LongType())])


class Codebooks:
    """The entries (parts, entries, components) and, for each, its neighbours nearest first."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        parts, n, _ = entries.shape
        apart = ((entries[:, :, None, :] - entries[:, None, :, :]) ** 2).sum(3)  # 64 x 64 a part
        self.order = np.argsort(apart, axis=2, kind="stable").astype(np.int32)
        self.near = np.take_along_axis(apart, self.order, 2)

    def search(self, x: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """The nearest entry of each row's parts (rows, parts, components), its squared distance, and how many distances that took; start: previous entries."""
        rows, parts, size = x.shape
        part = np.tile(np.arange(parts), rows)
        flat, a = x.reshape(-1, size), start.reshape(-1).astype(np.int64)
        u = ((flat - self.entries[part, a]) ** 2).sum(1)
        best, least, looked = a.copy(), u.copy(), len(a)
        within = np.minimum(4 * u.astype(object), np.iinfo(np.int64).max).astype(np.int64) if len(u) and u.max() >= 1 << 60 else 4 * u
        live = np.arange(len(a))
        for k in range(self.order.shape[2]):
            live = live[self.near[part[live], a[live], k] <= within[live]]
            if not len(live):
                break
            c = self.order[part[live], a[live], k]
            d = ((flat[live] - self.entries[part[live], c]) ** 2).sum(1)
            looked += len(live)
            closer = (d < least[live]) | ((d == least[live]) & (c < best[live]))
            best[live[closer]], least[live[closer]] = c[closer], d[closer]
        return best.reshape(rows, parts), least.reshape(rows, parts), looked

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.reshape(-1).tolist())).encode()).hexdigest()


def scaled(vector: str = "embedding") -> F.Column:
    """Components as whole numbers, floor(SCALE * x); null if the vector is null or holds a null or a component that isn't finite."""
    fine = F.forall(F.col(vector), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = lambda x: F.floor(F.greatest(F.least(x.cast("double") * SCALE, F.lit(float(MOST))), F.lit(float(-MOST)))).cast("long")
    return F.when(F.coalesce(fine, F.lit(False)), F.transform(vector, whole))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of equal width from lists, shorter ones ending with zeros."""
    out = np.zeros((len(column), width), np.int64)
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    out[np.arange(width) < lengths[:, None]] = flat
    return out


def assign(rows: DataFrame, books: Codebooks) -> DataFrame:
    """Rows (vec_id, label, v: integers as bytes, code, error) with the codes and errors by these codebooks; one pass, no shuffle."""
    shared = rows.sparkSession.sparkContext.broadcast(books)  # 16 x 64 entries and their order
    size = books.entries.shape[2]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for b in batches:
            for at in range(0, b.num_rows, SEARCHED):
                part = b.slice(at, SEARCHED)
                x = np.frombuffer(b"".join(part.column(2).to_pylist()), "<i8").reshape(part.num_rows, PARTS, size)
                before = np.frombuffer(b"".join(part.column(3).to_pylist()), np.uint8).reshape(-1, PARTS)
                code, error, _ = own.search(x, before)
                codes = [row.tobytes() for row in code.astype(np.uint8)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), pa.array(codes, pa.binary()), pa.array(error.sum(1), pa.int64())], names=CODED.names)
        give_back()

    return rows.mapInArrow(search, CODED)


def updated(rows: DataFrame, books: Codebooks) -> Codebooks:
    """Codebooks whose entries are their parts' means, rounded down; an entry without parts stays."""
    parts, n, size = books.entries.shape
    schema = "part int, entry int, k int, total long, n long"

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((parts, n, size), np.int64), np.zeros((parts, n), np.int64)

        def out() -> pa.RecordBatch:
            p, e, k = (x.reshape(-1).astype(np.int32) for x in np.indices(total.shape))
            return pa.RecordBatch.from_arrays([pa.array(x) for x in (p, e, k, total.reshape(-1), np.repeat(count.reshape(-1), size))], names=["part", "entry", "k", "total", "n"])

        held = 0
        for b in batches:
            x = np.frombuffer(b"".join(b.column(0).to_pylist()), "<i8").reshape(-1, parts, size)
            code = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint8).reshape(-1, parts).astype(np.int64)
            for p in range(parts):
                np.add.at(total[p], code[:, p], x[:, p])
                count[p] += np.bincount(code[:, p], minlength=n)
            held += len(x)
            if held >= 1 << 35:  # sums stay within 63 bits
                yield out()
                total[:], count[:], held = 0, 0, 0
        if held:
            yield out()
        give_back()

    sums = rows.select("v", "code").mapInArrow(add, schema).groupBy("part", "entry", "k").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n"))
    new = books.entries.copy()
    for r in sums.collect():  # a row for each component of an entry
        if r["n"]:
            new[r["part"], r["entry"], r["k"]] = int(r["total"]) // r["n"]
    return Codebooks(new)


def compressed(spark: SparkSession, vectors: DataFrame) -> tuple[DataFrame, Codebooks | None]:
    """Codes of vectors (vec_id, label, embedding) as rows vec_id, label, v, code, error, and the codebooks.

    Vectors that are null or hold null or non-finite components are dropped. Vectors shorter than the longest one, or
    than a multiple of PARTS, end with zeros. Codebooks start at the vectors of the ENTRIES smallest ids (of all, if
    there are fewer; of one id the smaller components first, rows without an id last). No rows: no codebooks.
    """
    bounded_batches(spark)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), scaled().alias("v")).where("v is not null")
    longest = rows.agg(F.max(F.size("v"))).first()[0]
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(ENTRIES).select("v").collect() if longest else []
    if not first:
        return spark.createDataFrame([], CODED), None
    width = -(-longest // PARTS) * PARTS
    start = np.zeros((len(first), width), np.int64)
    for row, r in zip(start, first, strict=True):
        row[: len(r["v"])] = r["v"]
    books = Codebooks(np.ascontiguousarray(start.reshape(len(first), PARTS, -1).transpose(1, 0, 2)))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column(2), width)
            n = len(x)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([r.tobytes() for r in x], pa.binary()), pa.array([bytes(PARTS)] * n, pa.binary()), pa.array(np.zeros(n, np.int64))], names=CODED.names)

    coded = rows.mapInArrow(pack, CODED)  # the search begins at entry 0
    for k in range(ROUNDS):
        coded = saved(assign(coded, books), f"codes-{k}")
        books = updated(coded, books)
    return saved(assign(coded, books), "codes"), books


def op12(spark, sf_dir: str) -> DataFrame:
    coded, books = compressed(spark, spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    per = saved(coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "_label"), "labels")
    met = coded.join(F.broadcast(per) if per.count() <= MOST_SENT else per, coded["label"].eqNullSafe(per["_label"]))
    return met.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(books.digest() if books else "").alias("codebooks_sha256"))


def _sql_round(k: int) -> str:
    """Assigning by codebook k, and codebook k + 1."""
    return f"""
d{k} AS MATERIALIZED (SELECT x.vec_id, x.part, b.entry, sum((x.c - b.c) * (x.c - b.c)) AS d FROM x JOIN b{k} b ON b.part = x.part AND b.k = x.k GROUP BY ALL),
a{k} AS MATERIALIZED (SELECT vec_id, part, arg_min(entry, d * 64 + entry) AS entry, min(d) AS d FROM d{k} GROUP BY ALL),
b{k + 1} AS MATERIALIZED (SELECT part, entry, k, coalesce(m, c) AS c FROM b{k} LEFT JOIN (SELECT part, entry, k, (s - ((s % n) + n) % n) // n AS m FROM (SELECT x.part, entry, k, sum(c)::HUGEINT AS s, count(*) AS n FROM x JOIN a{k} USING (vec_id, part) GROUP BY ALL)) USING (part, entry, k)),"""


ORACLE = f"""
WITH e AS (SELECT vec_id, label, embedding FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
x AS MATERIALIZED (SELECT vec_id, (i - 1) // (n // 16) AS part, (i - 1) % (n // 16) AS k, floor(256 * embedding[i]::DOUBLE)::BIGINT AS c FROM (SELECT vec_id, embedding, len(embedding) AS n, unnest(range(1, len(embedding) + 1)) AS i FROM e)),
b0 AS MATERIALIZED (SELECT part, entry, k, c FROM x JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM e QUALIFY entry < 64) USING (vec_id)),
{"".join(_sql_round(k) for k in range(3))}
c AS (SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a2 GROUP BY 1)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, (SELECT sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY part, entry, k)) FROM b2) AS codebooks_sha256
FROM c JOIN e USING (vec_id)
"""
