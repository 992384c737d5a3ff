"""Joins, windows and set operations over findings, intervals, events and edges."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quillscan.operators.chains import Chains
from quillscan.sources.shared import saved


def first_seen(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in order (nulls first).

    The least of (order, row) is aggregated in each task before anything moves, so a key of very many rows is one row a
    task; columns that can't be compared go through a window.
    """
    def comparable(kind: T.DataType) -> bool:
        inner = [f.dataType for f in kind.fields] if isinstance(kind, T.StructType) else [kind.elementType] if isinstance(kind, T.ArrayType) else []
        return not isinstance(kind, (T.MapType, T.VariantType)) and all(map(comparable, inner))

    rest = [c for c in df.columns if c not in keys and c not in order]
    if all(comparable(df.schema[c].dataType) for c in rest):
        least = F.min(F.struct(*order, *rest)).alias("_x")
        return df.groupBy(*keys).agg(least).select(*[c if c in keys else F.col(f"_x.`{c}`").alias(c) for c in df.columns])
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def drop_contained(df: DataFrame, keys: list[str], start: list[str], end: Column) -> DataFrame:
    """Intervals that no earlier interval of their key ends at or after; starts are unique within a key.

    A running maximum of ends: one sort a key, where comparing all pairs would be quadratic.
    """
    w = Window.partitionBy(*keys).orderBy(*start).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("_before", F.max(end).over(w)).where(F.col("_before").isNull() | (F.col("_before") < end)).drop("_before")


def suppress(findings: DataFrame, lined: DataFrame, word: str) -> DataFrame:
    """Findings (file, line, rule_id) but for those a directive covers: `word` on the line, `word`-next-line on the one before.

    A directive may list rules, in any case; a bare one covers all. lined: file, line_no, line.
    """
    rules = r"(?:\s+([A-Za-z]+-\d+(?:[\s,]+[A-Za-z]+-\d+)*))?"
    hits = lined.where(F.col("line").contains(word))
    following = F.regexp_replace("line", f"{word}-next-line", "")
    listed = lambda text, name: F.when(F.regexp_extract(text, f"{name}{rules}", 1) != "", F.split(F.upper(F.regexp_extract(text, f"{name}{rules}", 1)), r"[\s,]+"))
    same = hits.where(following.contains(word)).select("file", F.col("line_no").alias("line"), listed(following, word).alias("rules"))
    next_ = hits.where(F.col("line").contains(f"{word}-next-line")).select("file", (F.col("line_no") + 1).alias("line"), listed(F.col("line"), f"{word}-next-line").alias("rules"))
    d = same.unionByName(next_).withColumnsRenamed({"file": "_file", "line": "_line"})
    covers = d["rules"].isNull() | F.array_contains(d["rules"], F.upper(findings["rule_id"]))
    return findings.join(d, (findings["file"] == d["_file"]) & (findings["line"] == d["_line"]) & covers, "left_anti")


def sums_before(df: DataFrame, keys: list[str], order: list[str], values: dict[str, Column], part: str | None = None) -> DataFrame:
    """df with, for each of `values`, its sum over the rows of the same key before a row in order; no task gets all rows of a key.

    Rows are dealt by ranges of (keys, order) and written; within a range a window sums. What a key has in the ranges
    before is a number a range: a key that spans ranges has one row for each, and only those are summed up. order must be
    total within a key, or equal rows take any places. part: a name for the number of a row's range, which is kept then.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    inner = {name: f"_v{i}" for i, name in enumerate(values)}
    taken = df.withColumns({inner[name]: v for name, v in values.items()})
    ranged = saved(taken.repartitionByRange(parts, *keys, *order).withColumn("_part", F.spark_partition_id()), "ranked")
    sums = ranged.groupBy("_part", *keys).agg(*[F.sum(v).alias(v) for v in inner.values()])
    # a key of one range has no rows elsewhere; others are at most two a range
    split = sums.groupBy(*keys).agg(F.count("*").alias("_ranges")).where("_ranges > 1").drop("_ranges")
    named = [F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]
    same = lambda l, r: [l[k].eqNullSafe(r[f"_k{i}"]) for i, k in enumerate(keys)]  # noqa: E731, E741
    split = F.broadcast(saved(split.select(*named), "split"))  # under one key a range
    over = sums.join(split, same(sums, split), "left_semi")
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = saved(over.select(F.col("_part").alias("_p"), *named, *[F.sum(v).over(before).alias(f"{v}b") for v in inner.values()]), "bases")
    own = Window.partitionBy("_part", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    counted = ranged.withColumns({f"{v}o": F.coalesce(F.sum(v).over(own), F.lit(0)) for v in inner.values()})
    met = counted.join(F.broadcast(bases), [counted["_part"] == bases["_p"], *same(counted, bases)], "left")
    out = [(F.col(f"{v}o") + F.coalesce(f"{v}b", F.lit(0))).alias(name) for name, v in inner.items()]
    return met.select(*df.columns, *out, *([F.col("_part").alias(part)] if part else []))


def ranked(df: DataFrame, keys: list[str], order: list[str], out: str = "_rank", value: Column | None = None) -> DataFrame:
    """df with `out`: how many rows of its key come before a row in order or, with value, their sum."""
    return sums_before(df, keys, order, {out: F.lit(1).cast("long") if value is None else value})


def bag_difference(df: DataFrame, baseline: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Rows beyond the baseline's count of their key; the first ones in order are absorbed. baseline: key, cnt.

    Rows of keys that the baseline doesn't have pass by; the others are ranked over ranges, so a key of most rows is
    never one task's.
    """
    known = baseline.select(F.col(key).alias("_key"), "cnt").where("cnt > 0")
    known = saved(known, "baseline")
    new = df.join(known, df[key] == known["_key"], "left_anti")
    met = df.join(known, df[key] == known["_key"]).drop("_key")
    return new.unionByName(ranked(met, [key], order).where(F.col("_rank") >= F.col("cnt")).drop("_rank", "cnt"))


def touching(findings: DataFrame, changed: DataFrame) -> DataFrame:
    """Findings (file, s, e) that overlap a changed line (file, line)."""
    c = changed.withColumnsRenamed({"file": "_file", "line": "_line"})
    return findings.join(c, (findings["file"] == c["_file"]) & F.col("_line").between(F.col("s"), F.greatest("s", "e")), "left_semi")


def in_ranges(points: DataFrame, ranges: DataFrame) -> DataFrame:
    """Points (file, line) within a range (file, s, e) of their file; files without any range aren't filtered."""
    known = ranges.select(F.col("file").alias("_file")).distinct()
    r = ranges.withColumnsRenamed({"file": "_rf", "s": "_s", "e": "_e"})
    free = points.join(known, points["file"] == known["_file"], "left_anti")
    inside = points.join(r, (points["file"] == r["_rf"]) & F.col("line").between(F.col("_s"), F.col("_e")), "left_semi")
    return free.unionByName(inside)


def latest_before(df: DataFrame, key: str, order: list, is_source: Column, value: Column) -> Column:
    """As-of join as a window: the value of the last source row up to each row of its key."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return F.last(F.when(is_source, value), ignorenulls=True).over(w)


def _peeled(edges: DataFrame, starts: DataFrame | None = None) -> tuple[DataFrame, list[tuple[DataFrame, DataFrame]]]:
    """Edges (src, dst) by how soon they end: those left of all peels, and each peel, outermost first.

    A peel is the edges to nodes that nothing leads on from, as long as it takes a quarter of the edges; such a node is
    only ever the end of a path, so it needs no fixpoint. Each is in two parts: nodes with one edge to them, and others.
    A peel deals its edges by dst once, for all of this, and writes them once, by what they are. starts (column node):
    edges to these are left out.
    """
    left = edges.select("src", "dst").where("src is not null and dst is not null").repartition("dst")
    if starts is not None:
        left = left.join(starts.select(F.col("node").alias("dst")), "dst", "left_anti").select("src", "dst")
    left, n, peels = left.distinct(), None, []
    while n != 0:
        on = left.select(F.col("src").alias("dst")).distinct().withColumn("_on", F.lit(True))
        alone = F.count(F.lit(1)).over(Window.partitionBy("dst")) == 1
        kind = F.when(F.col("_on"), "inner").when(alone, "one").otherwise("more")
        told = saved(left.join(on, "dst", "left").select("src", "dst", kind.alias("kind")), "edges")
        n = told.count() if n is None else n
        inner, one, more = (told.where(F.col("kind") == k).select("src", "dst") for k in ("inner", "one", "more"))
        rest = inner.count()
        if n - rest < max(1, n // 4):
            return told.select("src", "dst"), peels
        left, n, peels = inner, rest, [*peels, (one, more)]
    return left, peels


def reached(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """node and hops (least number of edges, 0 for a start) of every node that a given start (column node) leads to.

    A frontier that is written at each step: the result has one row a node, where `closure` has one a pair. Nodes that
    only end paths are left to one join after it. Edges to starts are no way to anything nearer, and are left out first.
    """
    seen = front = saved(starts.select("node").where("node is not null").distinct().withColumn("hops", F.lit(0).cast("long")), "reached")
    inner, peels = _peeled(edges, front)
    k = 0
    while not front.isEmpty():
        k += 1
        step = front.select(F.col("node").alias("src")).join(inner, "src").select(F.col("dst").alias("node")).distinct()
        front = saved(step.join(seen.select("node"), "node", "left_anti").withColumn("hops", F.lit(k).cast("long")), "reached")
        seen = seen.unionByName(front)
        if not k % 8:  # a plan of few inputs
            seen = saved(seen, "reached")
    for k, (one, more) in enumerate(reversed(peels), 1):
        seen = seen if k == 1 else saved(seen, "reached")
        at = seen.select(F.col("node").alias("src"), (F.col("hops") + 1).alias("hops"))
        ends = at.join(one, "src").select(F.col("dst").alias("node"), "hops").unionByName(at.join(more, "src").groupBy(F.col("dst").alias("node")).agg(F.min("hops").alias("hops")))
        seen = seen.unionByName(ends)
    return seen


def _doubled(edges: DataFrame) -> DataFrame:
    """Pairs (src, dst, hops) with dst reached from src over any number of edges, by the least number.

    The reach doubles at each step: who is 2k edges away at most is k away, or reached from a node exactly k away. That
    is done for edges left of all peels. A node that only ends paths is then one edge beyond what leads to its source:
    with one source nothing is compared, and the pairs of the outermost peel, mostly the bulk, are neither dealt nor written.
    """
    whole, peels = _peeled(edges)
    seen = front = saved(whole.withColumn("hops", F.lit(1).cast("long")), "edges")
    k = 1
    while not front.isEmpty():
        far = seen.withColumnsRenamed({"src": "_m"})
        step = front.select("src", F.col("dst").alias("_m")).join(far, "_m").groupBy("src", "dst").agg((F.min("hops") + k).alias("hops"))
        new = saved(step.join(seen.select("src", "dst"), ["src", "dst"], "left_anti"), "closure")
        seen, k = seen.unionByName(new), 2 * k
        front = new.where(F.col("hops") == k)
    for n, (one, more) in enumerate(reversed(peels)):
        seen = saved(seen, "closure") if n else seen
        lead = seen.select("src", F.col("dst").alias("_m"), (F.col("hops") + 1).alias("hops")).where("src <> _m")  # around a cycle is no shorter
        next_ = lambda e: lead.join(e.withColumnRenamed("src", "_m"), "_m").select("src", "dst", "hops").unionByName(e.withColumn("hops", F.lit(1).cast("long")))  # noqa: B023, E731
        seen = seen.unionByName(next_(one)).unionByName(next_(more).groupBy("src", "dst").agg(F.min("hops").alias("hops")))
    return seen


def closure(edges: DataFrame) -> DataFrame:
    """Pairs (src, dst, hops) with dst reached from src over any number of edges, by the least number; edges without an end are none.

    What leads to a node over nodes of one source each is a chain: its pairs are never dealt, written or compared. Nodes
    of more sources, and all that they lead to, have their pairs by doubling; these are led on along the chains before them.
    """
    alone = F.count(F.lit(1)).over(Window.partitionBy("dst")) == 1
    known = edges.select("src", "dst").where("src is not null and dst is not null").repartition("dst").distinct()
    told = saved(known.withColumn("alone", alone), "edges")
    whole, more = told.select("src", "dst"), told.where("not alone").select(F.col("dst").alias("node")).distinct()
    if more.isEmpty():
        return Chains(whole).pairs(whole)
    mixed = saved(reached(whole, more).select("node"), "mixed")
    to = mixed.select(F.col("node").alias("dst"))
    plain, last = saved(whole.join(to, "dst", "left_anti").select("src", "dst"), "plain"), whole.join(to, "dst", "left_semi").select("src", "dst")
    chains, near = Chains(plain), saved(_doubled(last), "closure")
    before = last.select(F.col("src").alias("dst")).distinct()  # where chains end
    lead = chains.pairs(plain.join(before, "dst", "left_semi").select("src", "dst")).select(F.col("src").alias("_from"), F.col("dst").alias("src"), F.col("hops").alias("_more"))
    led = lead.join(near, "src").select(F.col("_from").alias("src"), "dst", (F.col("hops") + F.col("_more")).alias("hops"))
    return chains.pairs(plain).unionByName(near.unionByName(led).groupBy("src", "dst").agg(F.min("hops").alias("hops")))


def hash_sample(df: DataFrame, key: str, rate: float, seed: str) -> DataFrame:
    """The ceil(n * rate) rows, one at least, whose SHA-256 of seed and lower-case key ranks first; rate 0: none.

    Digests are spread evenly, so counts by their first 16 bits (at most 65,536 numbers) tell up to where all rows
    are taken; only the rows of one such bucket are ranked.
    """
    if not 0 <= rate <= 1:
        raise ValueError("rate must be within 0 and 1")
    if not rate:
        return df.limit(0)
    digest = F.sha2(F.concat_ws("\0", F.lit(seed), F.lower(key)), 256)
    rows = df.withColumn("_h", digest).withColumn("_b", F.conv(F.substring("_h", 1, 4), 16, 10).cast("int"))
    counts = {r["_b"]: r["count"] for r in rows.groupBy("_b").count().collect()}
    n = sum(counts.values())
    left, border = min(n, max(1, -int(-n * rate // 1))), -1
    for bucket in sorted(counts):
        if left <= counts[bucket]:
            border = bucket
            break
        left -= counts[bucket]
    edge = rows.where(F.col("_b") == border).withColumn("_n", F.row_number().over(Window.partitionBy("_b").orderBy("_h", key))).where(F.col("_n") <= left)
    return rows.where(F.col("_b") < border).drop("_h", "_b").unionByName(edge.drop("_h", "_b", "_n"))


def running(df: DataFrame, order: list, value: Column, out: str) -> DataFrame:
    """df with `out`: the sum of value over all rows before each one; order must be total.

    A prefix sum over ranges: rows are dealt by ranges of the order and written, sums of ranges (one row each) are
    added up, and a window runs within each range. No task gets all rows.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = saved(df.withColumn("_v", value).repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = ranged.groupBy("_part").agg(F.sum("_v").alias("_sum")).select("_part", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    own = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return ranged.join(F.broadcast(bases), "_part").withColumn(out, F.col("_base") + F.coalesce(F.sum("_v").over(own), F.lit(0))).drop("_v", "_part", "_base")


def within_budget(calls: DataFrame, order: str, cost: str, most: float, per: str | None = None) -> DataFrame:
    """Calls that begin before the costs of those ahead reach the budget; the one that crosses it is kept.

    Both are prefix sums over ranges: a budget for each `per`, however many calls one has, and one budget for all.
    """
    if per is None:
        return running(calls, [order], F.col(cost), "spent").withColumn("spent", F.col("spent").cast("double")).where(F.col("spent") < most)
    return ranked(calls, [per], [order], "spent", F.col(cost)).withColumn("spent", F.col("spent").cast("double")).where(F.col("spent") < most)


def distinct_in_order(df: DataFrame, key: str, order: Column) -> DataFrame:
    """key and first: each distinct key with the least order it has; sorting by first gives the order of first sight."""
    return df.groupBy(key).agg(F.min(order).alias("first"))


def innermost(points: DataFrame, spans: DataFrame) -> DataFrame:
    """Points (file, line) with the name of the enclosing span (file, name, s, e) that starts last; ties: least ord. Without one: null.

    A sweep: spans and points of a file are sorted together, and a heap of the open spans gives each point its answer.
    A file's work grows with its rows, not with its points times its spans; a file is one task's.
    """
    kind = spans.schema["name"].dataType.simpleString()
    key = points.schema["file"].dataType.simpleString()
    long = lambda c: F.col(c).cast("long").alias(c)
    opened = spans.where("e is not null").select("file", F.col("s").cast("long").alias("at"), F.lit(0).alias("what"), "name", long("e"), long("ord"))
    asked = points.select("file", F.col("line").cast("long").alias("at"), F.lit(1).alias("what"), F.lit(None).cast(kind).alias("name"), F.lit(None).cast("long").alias("e"), F.lit(None).cast("long").alias("ord"))
    events = opened.unionByName(asked.distinct()).repartition("file").sortWithinPartitions("file", "at", "what")
    names = T.StructType.fromDDL(f"file {key}, line long, name {kind}")

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, held = None, []  # open spans: latest start first, then least ord
        for b in batches:
            out: list[tuple] = []
            for k, (f, at, what, name, e, order) in enumerate(zip(*(c.to_pylist() for c in b.columns), strict=True)):
                if f != file:
                    file, held = f, []
                if what == 0:
                    heapq.heappush(held, (-at, order, e, k, name))
                    continue
                while held and held[0][2] < at:  # ended: points rise, so it never covers a later one
                    heapq.heappop(held)
                out.append((f, at, held[0][4] if held else None))
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True) if out else [[]] * 3, to_arrow_schema(names), strict=True)], schema=to_arrow_schema(names))

    line = points.schema["line"].dataType.simpleString()
    return events.mapInArrow(sweep, names).withColumn("line", F.col("line").cast(line))
