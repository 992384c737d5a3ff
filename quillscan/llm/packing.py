"""Packing of documents into sequences of bounded length by cutting-stock column generation.

Documents are tokenised once and cut into full pieces and a rest. A histogram of piece lengths, in classes of
GRAIN tokens, goes to the driver; its size does not depend on the data. There a linear program over patterns
(how many pieces of each class share a sequence) is solved by column generation from the first-fit plan on: a
knapsack dynamic program prices columns at smoothed duals until the bound that they prove is reached. Rounded-down
patterns and a first fit of the few pieces left over give a layout (the plain first fit where that is no worse),
which is applied to the pieces by their rank in their class. Ranks come from salted counts, so no class meets in a task.
"""

from __future__ import annotations

import contextlib
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillscan.llm.common import bounded_batches, give_back, saved
from quillscan.llm.token_counts import default_path, library

#: Tokens a length class spans, and pieces that one task ranks at most and at least.
GRAIN, RANKED, FEWEST = 2, 200_000, 100
#: Weight of the best bound's duals when columns are priced; rounds after which the inverse is computed anew.
SMOOTH, ANEW = 0.9, 50
PIECE = T.StructType([T.StructField(n, T.LongType()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")])


@cache
def engine(path: str):
    """A fast byte-level BPE engine over the vocabulary of a tokenizers file, and the file's special strings."""
    import json

    import tiktoken

    from quillscan.llm.bpe import PATTERN, byte_letters

    with open(path) as f:
        spec = json.load(f)
    letters, special = byte_letters(), [t["content"] for t in spec["added_tokens"]]
    ranks = {bytes(letters[c] for c in k): i for k, i in spec["model"]["vocab"].items() if k not in special}
    return tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), special


def token_ids(text: str, path: str) -> np.ndarray:
    """The library's ids of a text. Texts with special strings, and those that the fast engine gives up (very long runs of white space), go to the library."""
    enc, special = engine(path)
    if not any(s in text for s in special):
        with contextlib.suppress(ValueError):
            return enc.encode_to_numpy(text).astype("<u4", copy=False)
    return np.array(library(path).encode(text, add_special_tokens=False).ids, "<u4")


def pieces(df: DataFrame, size: int, path: str | None = None, end_id: int = 1) -> DataFrame:
    """The pieces of each document: of `size` tokens, and a rest; a document is its ids and then end_id."""
    bounded_batches(df.sparkSession)
    path = path or default_path()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            total, crcs = np.zeros(b.num_rows, np.int64), []
            for k, text in enumerate(b.column(1).to_pylist()):
                ids = np.append(token_ids(text or "", path), np.uint32(end_id)).astype("<u4")
                total[k] = len(ids)
                crcs += [zlib.crc32(ids[i : i + size]) for i in range(0, len(ids), size)]
            n = -(-total // size)
            owner = np.repeat(np.arange(len(total)), n)
            start = (np.arange(len(owner)) - (np.cumsum(n) - n)[owner]) * size
            of = total[owner]
            rest = [pa.array(x, pa.int64()) for x in (start, np.minimum(of - start, size), np.array(crcs, np.int64), of)]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()).take(pa.array(owner)), *rest], names=PIECE.names)
        give_back()

    return df.select("doc_id", "text").mapInArrow(cut, PIECE)


def price(duals: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The pattern of most worth: an unbounded knapsack by dynamic programming over the capacity."""
    best, took = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for w in range(1, capacity + 1):
        n = np.searchsorted(sizes, w, "right")
        best[w] = best[w - 1]
        if n:
            worth = best[w - sizes[:n]] + duals[:n]
            if worth[k := worth.argmax()] > best[w]:
                best[w], took[w] = worth[k], k
    pattern, w = np.zeros(len(sizes)), capacity
    while w > 0:
        if took[w] < 0:
            w -= 1
        else:
            pattern[took[w]] += 1
            w -= sizes[took[w]]
    return best[capacity], pattern


def first_fit(left: np.ndarray, sizes: np.ndarray, capacity: int, whole: bool = True) -> list[tuple[np.ndarray, float]]:
    """Patterns and their uses by first fit of the longest pieces first, a pattern as often as all its classes last.

    With whole=False uses are fractions, so that each pattern uses up a class: as many patterns as classes at most.
    """
    left, out = left.astype(float), []
    while (left > 0).any():
        pattern, room = np.zeros(len(sizes)), capacity
        for i in np.flatnonzero(left > 0)[::-1]:
            if sizes[i] <= room:
                pattern[i] = min(np.ceil(left[i]), room // sizes[i])
                room -= pattern[i] * sizes[i]
        lasts = np.divide(left, pattern, out=np.full(len(sizes), np.inf), where=pattern > 0)
        n = lasts.min()
        if whole:
            left -= (n := np.floor(n)) * pattern
        else:
            left -= n * pattern
            left[lasts <= n * (1 + 1e-12)] = 0
        out.append((pattern, n))
    return out


def _start(need: np.ndarray, sizes: np.ndarray, capacity: int) -> np.ndarray:
    """A basis: the fractional first fit's patterns, and a one-class pattern for each class that is used up together with another."""
    columns, left = [], need.copy()
    for pattern, n in first_fit(need, sizes, capacity, whole=False):
        gone = np.flatnonzero((pattern > 0) & (left <= n * pattern * (1 + 1e-12)))
        left = np.where(np.isin(np.arange(len(left)), gone), 0, left - n * pattern)
        columns.append(pattern)
        for i in gone[1:]:
            alone = np.zeros(len(sizes))
            alone[i] = capacity // sizes[i]
            columns.append(alone)
    return np.array(columns).T


def relax(need: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, float]:
    """The linear program's patterns (columns), their uses and a proven lower bound on the number of sequences.

    Duals d price a column at most worth(d); d / worth(d) is feasible, so d . need / worth(d) bounds the program from
    below. Columns enter until the plan is within half a sequence (or a millionth) of the best bound, or none improves it.
    """
    times = lambda m, v: np.einsum("ij,j->i", m, v)  # noqa: E731  a BLAS call would wake threads for each small product
    basis = _start(need, sizes, capacity)
    inverse = np.linalg.inv(basis)
    used, bound, centre, rounds = times(inverse, need), float(sizes @ need) / capacity, None, 0
    proven = 0.0
    while (now := used.sum()) - bound > max(0.5, 1e-6 * now):
        duals = inverse.sum(0)
        for d in (duals if centre is None else SMOOTH * centre + (1 - SMOOTH) * duals, duals):
            d = np.maximum(d, 0)
            worth, column = price(d, sizes, capacity)
            if (low := float(d @ need) / max(worth, 1)) > proven or centre is None:
                proven, centre = low, d / max(worth, 1)
            if duals @ column > 1 + 1e-9:
                break
        else:
            return basis, used, max(bound, min(now, proven))
        bound = max(bound, proven)
        step = times(inverse, column)
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(step > 1e-9, np.maximum(used, 0) / step, np.inf)
        out = ratio.argmin()
        basis[:, out] = column
        used = used - ratio[out] * step
        used[out] = ratio[out]
        row = inverse[out] / step[out]
        inverse -= np.outer(step, row)
        inverse[out] = row
        rounds += 1
        if rounds % ANEW == 0:
            inverse = np.linalg.inv(basis)
            used = times(inverse, need)
    return basis, used, bound


def plan(demand: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Patterns (class -> pieces) and how often each is used; every class's pieces are used up exactly.

    The better of the rounded linear program and the plain first fit: never more sequences than the latter.
    """
    sizes = np.array(sorted(c for c, n in demand.items() if n))
    if not len(sizes):
        return []
    need = np.array([demand[c] for c in sizes.tolist()], float)
    basis, used, _ = relax(need, sizes, capacity)
    rounded, left = [], need.copy()
    for k in np.argsort(-used):
        column = basis[:, k]
        if (n := min(np.floor(used[k] + 1e-6), np.floor((left[column > 0] / column[column > 0]).min()))) > 0:
            left -= n * column
            rounded.append((column, n))
    rounded += first_fit(left, sizes, capacity)
    plain = first_fit(need, sizes, capacity)
    best = min(rounded, plain, key=lambda p: sum(n for _, n in p))
    return [({int(sizes[i]): int(pattern[i]) for i in np.flatnonzero(pattern)}, int(n)) for pattern, n in best]


def layout(plans: list[tuple[dict[int, int], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each class: the first rank of each of its patterns, its pieces a sequence there, the first sequence id."""
    rows: dict[int, list[tuple[int, int, int]]] = {}
    at: Counter = Counter()
    first = 0
    for pattern, n in plans:
        for c, a in pattern.items():
            rows.setdefault(c, []).append((at[c], a, first))
            at[c] += a * n
        first += n
    return {c: tuple(np.array(x, np.int64) for x in zip(*r, strict=True)) for c, r in rows.items()}


def pack(df: DataFrame, size: int = 2048, path: str | None = None, end_id: int = 1) -> DataFrame:
    """Packs documents (doc_id, text) into sequences of at most `size` tokens; one row per piece.

    Null and empty texts hold end_id only. Rows that repeat a doc_id are packed as documents of their own.
    Columns: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset; other columns of df are not carried.
    """
    if size % GRAIN:
        raise ValueError(f"size must be a multiple of {GRAIN}")
    all_pieces = saved(pieces(df, size, path, end_id), "pieces").withColumn("class", F.ceil(F.col("length") / GRAIN).cast("int"))
    demand = {r["class"]: r["n"] for r in all_pieces.groupBy("class").agg(F.count("*").alias("n")).collect()}  # at most size / GRAIN rows
    where = layout(plan(demand, size // GRAIN))
    ranked_at_once = min(RANKED, max(FEWEST, sum(demand.values()) // 1024))
    several = [F.lit(x) for c, n in demand.items() if n > ranked_at_once for x in (c, -(-n // ranked_at_once))]
    salts = F.coalesce(F.try_element_at(F.create_map(*several), F.col("class")), F.lit(1)) if several else F.lit(1)
    salted = all_pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), salts))
    before = Window.partitionBy("class").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    counts = salted.groupBy("class", "salt").agg(F.count("*").alias("n")).select("class", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    if sum(-(-n // ranked_at_once) for n in demand.values()) <= 1_000_000:
        counts = F.broadcast(counts)
    own = Window.partitionBy("class", "salt").orderBy("doc_id", "start", "ids_crc32", "length", "doc_tokens")
    ranked = salted.withColumn("own", F.row_number().over(own) - 1).join(counts, ["class", "salt"]).withColumn("rank", F.col("first") + F.col("own"))

    @F.arrow_udf("long")
    def sequence(kinds: pa.Array, ranks: pa.Array) -> pa.Array:
        kind, rank = kinds.to_numpy(zero_copy_only=False), ranks.to_numpy(zero_copy_only=False)
        out = np.zeros(len(kind), np.int64)
        for c in np.unique(kind).tolist():
            here, (base, each, first) = kind == c, where[c]
            p = np.searchsorted(base, rank[here], "right") - 1
            out[here] = first[p] + (rank[here] - base[p]) // each[p]
        return pa.array(out)

    placed = ranked.withColumn("sequence_id", sequence("class", "rank"))
    ahead = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "class", "rank").rowsBetween(Window.unboundedPreceding, -1)
    alone, shared = placed.where(F.col("class") == size // GRAIN), placed.where(F.col("class") != size // GRAIN)  # nothing fits beside the largest class
    columns = [*PIECE.names, "sequence_id"]
    return alone.select(*columns, F.lit(0).cast("long").alias("offset")).unionByName(shared.select(*columns, F.coalesce(F.sum("length").over(ahead), F.lit(0)).cast("long").alias("offset")))


def op1(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
