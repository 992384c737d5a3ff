"""Reachability where each node has one source at most: what leads to a node is one chain, kept in pieces that nodes share.

A chain is written once for one in `_APART[1]` nodes (anchors, chosen by digest), in pieces of few nodes for the others, so
what is dealt and written grows with nodes and not with pairs. Pairs come from laying pieces together, in the last step alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillscan.sources.shared import saved

#: One node in so many is an anchor of the first and of the second kind; the second divides by the first.
_APART = (4, 32)
#: Ends of one node that share a row at most.
_ENDS_A_ROW = 1000


def _on_cycles(up: DataFrame) -> DataFrame:
    """Nodes (node) of up (node, at: its source) that lead to themselves.

    Sources of sources, at doubled distances, of those nodes alone that are such sources: they get fewer until only cycles are left.
    """
    jump, last = up, None
    while True:
        left = saved(jump.select(F.col("at").alias("node")).distinct(), "sources")
        n = left.count()
        if n == last or not n:
            return left
        last = n
        to = jump.withColumnsRenamed({"node": "_n", "at": "_a"})
        # a source may have none itself
        jump = saved(left.join(jump, "node").join(to, F.col("at") == F.col("_n")).select("node", F.col("_a").alias("at")), "jumps")


def _cycles(up: DataFrame) -> DataFrame:
    """root and turn of each cycle of up (node, at): its least node, and its nodes from that one's source up to itself."""
    least = saved(up.withColumn("least", F.least("node", "at")), "cycles")
    while True:
        to = least.select(F.col("node").alias("_n"), F.col("at").alias("_a"), F.col("least").alias("_l"))
        next_ = saved(least.join(to, F.col("at") == F.col("_n")).select("node", F.col("_a").alias("at"), F.least("least", "_l").alias("least"), (F.col("_l") < F.col("least")).alias("new")), "cycles")
        if next_.where("new").isEmpty():
            break
        least = next_.drop("new")
    roots = next_.where("node = least").select("node", F.lit(True).alias("_root"))
    steps = up.join(roots.select(F.col("node").alias("at"), "_root"), "at", "left").select("node", F.array("at").alias("path"), "at", F.lit(1).alias("met"), F.col("_root").isNotNull().alias("done"))
    turns = _followed(steps, F.lit(False), steps.join(roots, "node").select("node"))
    return turns.select(F.col("node").alias("root"), F.col("path").alias("turn"))


def _followed(steps: DataFrame, stops: Column, whose: DataFrame | None = None) -> DataFrame:
    """steps (node, path, at: the path's end, met: a sum over it, done) with each path led on to where `stops` holds or no step goes on.

    Distances double. Paths that have ended are written once, and looked up by others; whose (node): only theirs are kept.
    """
    t = saved(steps.withColumn("done", F.col("done") | stops), "paths")
    ended, open_ = t.where("done").drop("done"), t.where("not done").drop("done")
    while not open_.isEmpty():
        every = ended.unionByName(open_.withColumn("done", F.lit(False)), allowMissingColumns=True).select(F.col("node").alias("_n"), F.col("path").alias("_p"), F.col("at").alias("_a"), F.col("met").alias("_m"), F.coalesce("done", F.lit(True)).alias("_d"))
        met = open_.join(every, F.col("at") == F.col("_n"), "left")
        t = saved(met.select("node", F.concat("path", F.coalesce("_p", F.slice("path", 1, 0))).alias("path"), F.coalesce("_a", "at").alias("at"), (F.col("met") + F.coalesce("_m", F.lit(0))).alias("met"), F.coalesce("_d", F.lit(True)).alias("done")), "paths")
        ended, open_ = ended.unionByName(t.where("done").drop("done")), t.where("not done").drop("done")
    return ended.join(whose, "node", "left_semi") if whose is not None else ended


class Chains:
    """The chains that lead to nodes by edges (src, dst), each dst once and no nulls."""

    def __init__(self, edges: DataFrame):
        first, second = (F.pmod(F.xxhash64("at"), F.lit(n)) == 0 for n in _APART)
        heads = edges.select(F.col("src").alias("node")).distinct()
        # who leads on, and its source
        up = saved(edges.select(F.col("dst").alias("node"), F.col("src").alias("at")).join(heads, "node"), "up")
        on = _on_cycles(up)
        turns = saved(_cycles(up.join(on, "node")), "turns") if not on.isEmpty() else None
        met = F.lit(0)
        if turns is not None:
            up = up.join(turns.select(F.col("root").alias("node")), "node", "left_anti")  # a cycle is cut at its root
            up, met = up.join(on.select(F.col("node").alias("at"), F.lit(1).alias("_on")), "at", "left"), F.coalesce("_on", F.lit(0))
        near = _followed(up.select("node", F.array("at").alias("path"), "at", met.alias("met"), F.lit(False).alias("done")), first)
        chosen = lambda t, n: t.where(F.pmod(F.xxhash64("node"), F.lit(n)) == 0).withColumn("done", F.lit(False))
        middle = _followed(chosen(near, _APART[0]), second)
        far = _followed(chosen(middle, _APART[1]), F.lit(False))
        far = far.select("node", "path", "at", "met")
        if turns is not None:
            # past its root a chain goes on around the cycle, until where it came onto it; met counts nodes of the cycle
            own = turns.select(F.col("root").alias("node"), F.slice("turn", 1, 0).alias("path"), F.col("root").alias("at"), F.lit(0).alias("met"))
            mine = on.select("node", F.lit(1).alias("_on"))
            whole = far.unionByName(own).join(mine, "node", "left").join(turns, F.col("at") == F.col("root"), "left")
            left = F.size("turn") - F.col("met") - F.coalesce("_on", F.lit(0))
            far = whole.select("node", F.when(F.col("turn").isNull(), F.col("path")).otherwise(F.concat("path", F.slice("turn", 1, F.greatest(left, F.lit(0))))).alias("path"), F.coalesce("_on", F.lit(0)).alias("on"))
        else:
            far = far.select("node", "path", F.lit(0).alias("on"))
        self.on = on.select(F.col("node").alias("_node"), F.lit(1).alias("_on")) if turns is not None else None
        self.near, self.middle, self.far = near, middle, saved(far, "chains")

    def pairs(self, ends: DataFrame) -> DataFrame:
        """src, dst, hops of each edge (src, dst) of ends and of what leads to its src; hops is long. Ends of a node share its chain."""
        counts = ends.groupBy(F.col("src").alias("_src")).agg(F.count(F.lit(1)).alias("_many")).where(F.col("_many") > _ENDS_A_ROW)
        dealt = ends.join(saved(counts, "many"), F.col("src") == F.col("_src"), "left")
        block = F.pmod(F.xxhash64("dst"), F.coalesce(F.ceil(F.col("_many") / _ENDS_A_ROW), F.lit(1)))
        rows = dealt.groupBy("src", block.alias("_block")).agg(F.collect_list("dst").alias("ends")).drop("_block")
        rows = rows.join(self.on, F.col("src") == F.col("_node"), "left").drop("_node") if self.on is not None else rows.withColumn("_on", F.lit(0))
        piece = lambda t, k: t.select(F.col("node").alias(f"_n{k}"), F.col("path").alias(f"_p{k}"), F.col("at").alias(f"_a{k}"), F.col("met").alias(f"_m{k}"))
        rows = rows.join(piece(self.near, 1), F.col("src") == F.col("_n1"), "left").withColumn("_a1", F.coalesce("_a1", "src"))
        rows = rows.join(piece(self.middle, 2), F.col("_a1") == F.col("_n2"), "left").withColumn("_a2", F.coalesce("_a2", "_a1"))
        none = F.slice(F.array("src"), 1, 0)
        rows = rows.select("ends", "_a2", F.concat(F.array("src"), F.coalesce("_p1", none), F.coalesce("_p2", none)).alias("path"), (F.coalesce("_on", F.lit(0)) + F.coalesce("_m1", F.lit(0)) + F.coalesce("_m2", F.lit(0))).alias("met"))
        far = self.far.select(F.col("node").alias("_n3"), F.col("path").alias("_p3"), F.col("on").alias("_on3"))
        rows = rows.join(far, F.col("_a2") == F.col("_n3"), "left")
        # nodes of the cycle that this chain has met since the anchor are left out at its end
        met = F.col("met") - F.col("_on3")
        whole = F.when(F.col("_p3").isNull(), F.col("path")).otherwise(F.concat("path", F.slice("_p3", 1, F.greatest(F.size("_p3") - met, F.lit(0)))))
        rows = rows.select(F.explode("ends").alias("dst"), whole.alias("path"))
        return rows.select("dst", F.posexplode("path").alias("_k", "src")).select("src", "dst", (F.col("_k") + 1).cast("long").alias("hops"))
