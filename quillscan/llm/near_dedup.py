"""Near-duplicates by a signature-coordinate inverted join, confirmed on full shingle sets.

Documents of equal shingle sets (128-bit digests) form a class; only classes are compared. A class posts its MinHash
signature's coordinate-value pairs. A pair of similarity 0.75 shares fewer than MATCHES of COORDINATES values about
twice in a million, so pairs sharing at least that many are candidates. They share one of the COORDINATES - MATCHES + 1
rarest values of either (prefix), so only those are posted, in one global order by frequency: values of common passages
drop out, and values that no other class has are skipped. Groups of near copies are first contracted: each class
tries the hub of each of its posting lists, the class whose values are the most frequent ones, and takes those that
collide most. Then lists whose classes are in one component are skipped. The classes of the others post their rarest
shingles, as many as a linked pair can't avoid sharing, with their places: a class with many edits of its own meets
nobody. There every class outside a list's largest component meets classes of other components, long lists in blocks;
equal or linked copies are never expanded into pairs. Candidates whose signatures collide MATCHES times are confirmed
exactly, a hub's texts dealt over several tasks; components come from alternating star contraction.

What is counted a key is written before it is joined with the key's rows, so that a join has two plain inputs and AQE
can split a hot key, and no stage evaluates more than one Python function.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillscan.llm.common import bounded_batches, give_back, saved

#: Words of a shingle; similarity in hundredths; signature length; least collisions of a candidate.
WORDS, NEAR, COORDINATES, MATCHES = 5, 75, 48, 22
#: Leaders that a class is held against before others.
LEADERS = 4
#: Rows of a posting list that one task holds against the rest of it; pairs of a class that one task confirms.
BLOCK, PAIRS = 2000, 256
#: Words that a partition's memo keeps and their longest, in bytes; rows of a table that is broadcast at most.
MEMO, LONGEST, MOST_SENT = 100_000, 64, 100_000
_MIX, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95)
SIGNATURE = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_shingles", T.LongType()), T.StructField("digest", T.BinaryType()), T.StructField("signature", T.ArrayType(T.IntegerType()))])


class _Memo(dict):
    """Hashes of words; computed where missing."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < MEMO and len(word) <= LONGEST:
            self[word] = h
        return h


_memo = _Memo()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX
    x = (x ^ (x >> np.uint64(29))) * _STEP
    return x ^ (x >> np.uint64(32))


def shingles(text: str | None) -> np.ndarray:
    """The sorted distinct hashes of the text's shingles: of WORDS words, or of all if there are fewer; A-Z in lower case."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else ()  # bytes: only A-Z change, and exactly \\x20 \\x09-\\x0D split
    if not words:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(_memo.__getitem__, words), np.uint64, len(words))
    k = min(WORDS, len(w))
    h = np.full(len(w) - k + 1, k, np.uint64)
    for j in range(k):
        h = (h + w[j : len(w) - k + 1 + j]) * _STEP
        h ^= h >> np.uint64(31)
    h = np.sort(_mixed(h))
    return h[np.append(True, h[1:] != h[:-1])]


_A = np.random.default_rng(11).integers(1, 1 << 63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = np.random.default_rng(12).integers(0, 1 << 63, COORDINATES, dtype=np.uint64)


def signature(h: np.ndarray) -> np.ndarray:
    """For each coordinate, 32 bits of the hash of the shingle that its permutation puts first."""
    least = np.full(COORDINATES, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(h), 1024):
        x = h[i : i + 1024, None] * _A + _B
        np.minimum(least, (x ^ (x >> np.uint64(33))).min(0), out=least)
    return (_mixed(least) >> np.uint64(32)).astype(np.uint32).view(np.int32)


def digest_of(h: np.ndarray) -> bytes:
    """The 128-bit digest of a shingle set."""
    return xxhash.xxh3_128_digest(h.tobytes())


def done() -> None:
    """At a partition's end: the memo goes, and freed memory back to the system."""
    _memo.clear()
    give_back()


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, size and digest of the shingle set, and signature (null for an empty set)."""
    bounded_batches(docs.sparkSession)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles(x) for x in b.column(1).to_pylist()]
            sigs = [signature(h) if len(h) else None for h in sets]
            offsets = np.cumsum([0, *(COORDINATES if s is not None else 0 for s in sigs)])
            flat = np.concatenate([s for s in sigs if s is not None] or [np.empty(0, np.int32)])
            listed = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()), mask=pa.array([s is None for s in sigs], pa.bool_()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(h) for h in sets], pa.int64()), pa.array(map(digest_of, sets), pa.binary()), listed], names=SIGNATURE.names)
        done()

    return docs.select("doc_id", "text").mapInArrow(sign, SIGNATURE)


def counted(df: DataFrame, name: str) -> DataFrame:
    """df, written; broadcast where it has MOST_SENT rows at most."""
    out = saved(df, name)
    return F.broadcast(out) if out.count() <= MOST_SENT else out


def postings(classes: DataFrame) -> DataFrame:
    """For each class the values among its rarest that other classes have too, with the first class and the hub of each."""
    key = F.shiftleft(F.col("c").cast("long"), 32).bitwiseOR(F.col("v").cast("long").bitwiseAND(F.lit(0xFFFFFFFF).cast("long")))
    all_ = classes.select("set", F.posexplode("signature").alias("c", "v")).select("set", key.alias("key"))
    common = counted(all_.groupBy("key").agg(F.count("*").alias("n"), F.min("set").alias("first")).where("n > 1"), "common")
    shared = all_.join(common, "key").groupBy("set").agg(F.sort_array(F.collect_list(F.struct("n", "key", "first"))).alias("own"))  # at most COORDINATES
    prefix = COORDINATES - MATCHES + 1
    rare = F.slice("own", 1, F.greatest(F.lit(0), prefix - COORDINATES + F.size("own")))
    central = F.aggregate("own", F.lit(0).cast("long"), lambda x, y: x + y["n"])
    posts = saved(shared.select("set", central.alias("central"), F.explode(rare).alias("p")).select("set", "central", "p.key", "p.first"), "prefixes")
    hubs = counted(posts.groupBy("key").agg(F.max(F.struct("central", "set")).alias("hub")).select("key", F.col("hub.set").alias("hub")), "hubs")
    return posts.join(hubs, "key").select("set", "key", "first", "hub")


def prefixes(some: DataFrame, docs: DataFrame) -> DataFrame:
    """For some classes (set, root, rep, digest, n): their rarest shared shingles, enough that no linked pair shares none of them.

    Shingles are ordered by how many of these classes have them; those that one class alone has come first and are
    only counted. key is a shingle at place at (from 0) in its class's order, kept up to a quarter of the n shingles;
    a class whose own shingles reach further can have no partner and has no row.
    """
    sent = some.select("set", "digest", F.col("rep").alias("doc_id"))
    texts = docs.select("doc_id", "text").join(F.broadcast(sent) if sent.count() <= MOST_SENT else sent, "doc_id").select("set", "digest", "text")
    bounded_batches(docs.sparkSession)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for own, want, x in zip(*(c.to_pylist() for c in b.columns), strict=True):
                h = shingles(x)
                if digest_of(h) == want:  # else another text of a repeated id
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), own)), pa.array(h.view(np.int64))], names=["set", "key"])
        done()

    each = saved(texts.mapInArrow(spread, "set long, key long"), "shingles")
    common = counted(each.groupBy("key").agg(F.count("*").alias("df")).where("df > 1"), "frequencies")
    shared = each.join(common, "key").groupBy("set").agg(F.sort_array(F.collect_set(F.struct("df", "key"))).alias("own"))
    first = F.col("n") - F.size("own")
    kept = F.greatest(F.lit(0), F.floor(F.col("n") * (100 - NEAR) / 100) + 1 - first).cast("int")
    placed = shared.join(some.select("set", "root", "n"), "set").select("set", "root", "n", first.alias("first"), F.posexplode(F.slice("own", 1, kept)).alias("k", "x"))
    return placed.select("set", "root", "n", (F.col("first") + F.col("k")).alias("at"), "x.key")


def colliding(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Distinct pairs (a, b) of classes whose sizes allow a link and whose signatures collide at least MATCHES times, with the count, both representatives and digests."""
    of = lambda x: classes.select(F.col("set").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("signature", "rep", "digest", "n")])
    both = pairs.distinct().join(of("a"), "a").join(of("b"), "b").where(F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * NEAR)
    hits = F.size(F.filter(F.zip_with("signature_a", "signature_b", lambda x, y: x == y), lambda e: e))
    return both.withColumn("hits", hits).where(F.col("hits") >= MATCHES).select("a", "b", "rep_a", "rep_b", "digest_a", "digest_b", "hits")


def confirmed(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b, their representatives and digests) whose full shingle sets have a similarity of at least NEAR hundredths.

    A class b of many pairs is a hub: its text goes to a part for each PAIRS of them, so no task gets a hub's whole group.
    """
    pairs = saved(pairs, "pairs")
    parts = pairs.groupBy("b").agg(F.first("rep_b").alias("rep_b"), F.first("digest_b").alias("digest_b"), F.ceil(F.count("*") / PAIRS).alias("parts"))
    parts = saved(parts, "hubs")
    few = parts.count() <= MOST_SENT
    mine = pairs.join(F.broadcast(parts.select("b", "parts")) if few else parts.select("b", "parts"), "b").select("b", "a", F.col("rep_a").alias("doc_id"), "digest_a", F.pmod(F.xxhash64("a"), F.col("parts")).alias("part"))
    ids = parts.select("b", F.col("rep_b").alias("doc_id"), "digest_b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    if pairs.count() <= MOST_SENT:
        ids, mine = F.broadcast(ids), F.broadcast(mine)
    texts = docs.select("doc_id", "text")
    left = texts.join(mine, "doc_id").select("b", "part", "a", "digest_a", F.col("text").alias("text_a"))
    right = texts.join(ids, "doc_id").select("b", "part", "digest_b", F.col("text").alias("text_b"))
    bounded_batches(docs.sparkSession)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, q = (None, None), None  # a part's rows follow each other: its hub is taken apart once
        for batch in batches:
            links = []
            for a, b, da, db, x, y in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if last != (b, db) or q is None:
                    q = shingles(y)
                    last = (b, db)
                    if digest_of(q) != db:  # a repeated id may bring another text than the class's
                        q = None
                        continue
                p = shingles(x)
                same = len(p) + len(q) - len(np.union1d(p, q))
                if digest_of(p) == da and 100 * same >= NEAR * (len(p) + len(q) - same):
                    links.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], names=["a", "b"])
        done()

    met = left.join(right.hint("merge"), ["b", "part"]).select("a", "b", "digest_a", "digest_b", "text_a", "text_b")
    return met.mapInArrow(near, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """node, root: the smallest node of each component of edges (a, b), by alternating large and small stars."""
    edges = saved(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = counted(both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")), "least")
        large = saved(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "large")
        lower = counted(large.groupBy("u").agg(F.min("v").alias("m")), "lower")
        small = large.join(lower, "u").select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("e"))
        edges = saved(small.select("e.u", F.col("e.m").alias("v")).where("u <> v").distinct(), "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == state or not now[0]:
            break
        state = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _several(df: DataFrame) -> DataFrame:
    """The keys whose rows are of several components."""
    return df.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("key")


def _across(lists: DataFrame) -> DataFrame:
    """Pairs (a, b) of classes of different components that meet in a list (key, set, root, n, at): one of them is outside the list's largest component.

    Those outside a long list's largest component are dealt into blocks of about BLOCK, each with the whole list.
    """
    per = lists.groupBy("key", "root").agg(F.count("*").alias("n"))
    largest = per.groupBy("key").agg(F.max(F.struct("n", "root")).alias("most"), F.sum("n").alias("all"))
    blocks = F.ceil((F.col("all") - F.col("most.n")) / BLOCK)
    largest = counted(largest.select("key", F.col("most.root").alias("most"), blocks.alias("blocks")), "largest")
    known = lists.join(largest, "key")
    outside = known.where("root <> most").select("key", F.pmod(F.xxhash64("set"), F.col("blocks")).alias("block"), F.col("set").alias("a"), F.col("root").alias("ra"), F.col("n").alias("na"), F.col("at").alias("ia"), "most")
    inside = known.select("key", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), F.col("set").alias("b"), F.col("root").alias("rb"), F.col("n").alias("nb"), F.col("at").alias("ib"))
    # what stands behind a pair's first common shingle must be enough for the intersection that their sizes ask for
    fits = F.least(F.col("na") - F.col("ia"), F.col("nb") - F.col("ib")) * (100 + NEAR) >= (F.col("na") + F.col("nb")) * NEAR
    # of two classes outside the largest component, one order is enough
    once = (F.col("ra") != F.col("rb")) & ((F.col("rb") == F.col("most")) | (F.col("a") < F.col("b")))
    met = saved(outside, "outside").join(saved(inside, "inside"), ["key", "block"]).where(fits & once)
    return met.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))


def find(df: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each row of documents (doc_id, text); other columns are not read.

    Rows whose text is null or has no word are linked with nothing, nor are rows without an id (component_id null,
    kept). Rows that repeat an id and a text are one document; each of them has the flag kept.
    """
    docs = df.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = saved(signatures(docs), "signatures")
    named = signed.where("doc_id is not null and n_shingles > 0")
    classes = named.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("signature").alias("signature"), F.first("n_shingles").alias("n"), F.count("*").alias("copies"))
    classes = saved(classes.withColumn("set", F.monotonically_increasing_id()), "classes")  # numbered once: they are read from the written table
    posts = saved(postings(classes), "postings")

    tried = posts.select(F.col("set").alias("a"), F.explode(F.array("first", "hub")).alias("b")).where("a <> b")
    leaders = F.sort_array(F.collect_list(F.struct("hits", "b", "rep_a", "rep_b", "digest_a", "digest_b")), asc=False)  # of one class: two a list at most
    best = colliding(tried, classes).groupBy("a").agg(F.slice(leaders, 1, LEADERS).alias("x")).select("a", F.explode("x").alias("x")).select("a", "x.*").drop("hits")
    edges = saved(confirmed(best, docs), "links")
    roots = components(edges)

    label = F.coalesce("root", "set")
    placed = saved(posts.join(roots, posts["set"] == roots["node"], "left").select("set", "key", label.alias("root")), "placed")
    some = placed.join(counted(_several(placed), "several"), "key").select("set", "root").distinct()
    some = saved(some.join(classes.select("set", "rep", "digest", "n"), "set"), "some")
    lists = saved(prefixes(some, docs), "prefixes")
    lists = saved(lists.join(counted(_several(lists), "several"), "key"), "lists")
    more = saved(confirmed(colliding(_across(lists), classes).drop("hits"), docs), "links")
    if not more.isEmpty():
        roots = components(edges.unionByName(more))

    linked = saved(classes.join(roots, classes["set"] == roots["node"], "left").select("digest", "rep", "copies", label.alias("root")), "linked")
    smallest = counted(linked.groupBy("root").agg(F.min("rep").alias("component_id"), F.count("*").alias("n")).where("n > 1"), "smallest")
    known = linked.join(smallest, "root", "left").where("n is not null or copies > 1").select("digest", F.coalesce("component_id", "rep").alias("component_id"))
    known = counted(known, "known")
    out = signed.join(known, "digest", "left").withColumn("component_id", F.when(F.col("n_shingles") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id")))
    out = out.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.col("component_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def op6(spark, sf_dir: str) -> DataFrame:
    return find(spark.read.parquet(f"{sf_dir}/documents.parquet"))
