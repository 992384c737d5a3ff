"""Syntax trees as relations: nodes numbered in pre- and post-order, so that structure is a test of intervals.

y is below x in the same file if x.pre < y.pre and y.pre <= x.last. Parents, what encloses a node and sums over subtrees
are windows over these numbers within a file: linear but for sorting, one shuffle by path for any number of them, no join.
Rows without a number (files that failed) may stand among the nodes and get null, zero or false.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillscan.functions import lexer, tree
from quillscan.operators.parse import tabled

TREES = "path string, lang string, pre int, post int, last int, parent int, depth int, nth int, kind string, word string, sl int, sc int, el int, ec int, error string"


def trees(files: DataFrame, keep: Callable[[str, str | None], bool] | None = None) -> DataFrame:
    """All syntax nodes of files (path, lang, content), in pre-order (pre, from 0).

    post is a node's post-order number, last the greatest pre below it (its own, for a leaf), parent its parent's pre (-1
    for the file), nth its place among its siblings. word is an operator, the name that a node calls or defines, or a
    leaf's text; texts of inner nodes are not repeated, so rows grow with tokens, not with depth. Lines count from 1,
    columns from 0. Null and empty contents have the file's node alone; a file that can't be read gives a row with its error.
    keep(kind, word): only such nodes, with their numbers in the whole tree. What encloses a node, and sums over subtrees,
    are right over any nodes that hold all that count for them.
    """

    def read(path: str, lang: str, content: str | None) -> Iterator[tuple]:
        src = lexer.Source(content or "", lang)
        t = src.toks
        for x, pre, post, last, parent, depth, nth in tree.numbered(tree.parse(src)):
            if keep is not None and not keep(x.kind, x.word):
                continue
            (sl, sc), (el, ec) = (src.place(t[x.a].start), src.place(t[x.b].end)) if t else ((1, 0), (1, 0))
            yield path, lang, pre, post, last, parent, depth, nth, x.kind, x.word, sl, sc, el, ec, None

    return tabled(files, TREES, read, lambda path, lang, error: (path, lang, *[None] * 12, error))


def _dealt(nodes: DataFrame, *roles: tuple[Column, Column, Column]) -> DataFrame:
    """nodes once for each role (when it has it, its number, its place), as _role and _at; rows stay where they are."""
    made = F.array(*[F.when(has, F.struct(number.cast("int").alias("role"), place.cast("int").alias("at"))) for has, number, place in roles])
    rows = nodes.withColumn("_x", F.explode(F.array_compact(made)))
    return rows.select(*nodes.columns, F.col("_x.role").alias("_role"), F.col("_x.at").alias("_at"))


def with_parent(nodes: DataFrame) -> DataFrame:
    """nodes with parent_kind and parent_word, null for a file's own node. A parent meets its children in a window of their own."""
    rows = _dealt(nodes, (F.lit(True), F.lit(0), F.col("parent")), (F.col("last") > F.col("pre"), F.lit(1), F.col("pre")))
    up = F.max(F.when(F.col("_role") == 1, F.struct("kind", "word"))).over(Window.partitionBy("path", "_at"))
    return rows.withColumn("_up", up).where("_role = 0").select(*nodes.columns, F.col("_up.kind").alias("parent_kind"), F.col("_up.word").alias("parent_word"))


def above(nodes: DataFrame, which: Column, out: str) -> DataFrame:
    """nodes with `out`: how many nodes of which stand above: those that begin before it less those that end before it."""
    rows = _dealt(nodes, (F.lit(True), F.lit(0), F.col("pre")), (which, F.lit(1), F.col("last")))
    change = F.when(F.col("_role") == 1, -1).when(which, 1).otherwise(0)
    open_ = F.sum(change).over(Window.partitionBy("path").orderBy("_at", "_role").rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("_open", F.coalesce(open_, F.lit(0))).where("_role = 0").select(*nodes.columns, F.col("_open").alias(out))


def below(nodes: DataFrame, which: Column, out: str) -> DataFrame:
    """nodes with `out`: whether a node of which stands above.

    The nodes before one in pre-order that reach as far as it are those above it: a running maximum of `last`.
    """
    before = Window.partitionBy("path").orderBy("pre").rowsBetween(Window.unboundedPreceding, -1)
    return nodes.withColumn(out, F.coalesce(F.max(F.when(which, F.col("last"))).over(before) >= F.col("pre"), F.lit(False)))


def nearest(nodes: DataFrame, which: Column, out: str, value: Column | None = None) -> DataFrame:
    """nodes with `out`: value (or pre) of the closest node of which above, null without one.

    Under n nodes of which, the closest one is the last before it that stands under n - 1 itself.
    """
    rows = above(nodes, which, "_n")
    rows = _dealt(rows, (F.lit(True), F.lit(0), F.col("_n")), (which, F.lit(1), F.col("_n") + 1))
    told = F.when(F.col("_role") == 1, F.struct((F.col("pre") if value is None else value).alias("value")))
    last = F.last(told, ignorenulls=True).over(Window.partitionBy("path", "_at").orderBy("pre", "_role").rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("_told", last).where("_role = 0").select(*nodes.columns, F.col("_told.value").alias(out))


def subtree_sums(nodes: DataFrame, value: Column, out: str) -> DataFrame:
    """nodes with `out`: the sum of value over each node and all below it.

    A subtree is a range of numbers: its sum is the running sum at its end less that before it.
    """
    rows = _dealt(nodes.withColumn("_v", F.coalesce(value, F.lit(0))), (F.lit(True), F.lit(0), F.col("pre")), (F.lit(True), F.lit(1), F.col("last")))
    here = F.when(F.col("_role") == 0, F.col("_v")).otherwise(0)
    rows = rows.withColumn("_to", F.sum(here).over(Window.partitionBy("path").orderBy("_at", "_role").rowsBetween(Window.unboundedPreceding, 0)))
    end = F.max(F.when(F.col("_role") == 1, F.struct(F.lit(1), F.col("_to").alias("to")))).over(Window.partitionBy("path", "pre"))
    return rows.withColumn("_end", end["to"]).where("_role = 0").select(*nodes.columns, (F.col("_end") - F.col("_to") + F.col("_v")).alias(out))
