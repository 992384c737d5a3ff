"""Queries over syntax trees of programs that are made from rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillscan.operators import syntax, taint
from quillscan.sources.shared import dealt, saved
from quillscan.sources.tables import table

_Q, _O = {}, {}


def _query(sql: str):
    def add(f):
        _Q[f.__name__], _O[f.__name__] = f, sql
        return f

    return add


#: Ten operators by language, and how tightly each binds there, as their manuals say (greater is tighter).
_LANGS = ["javascript", "typescript", "java", "php", "python", "go"]
_OPS = ["+", "*", "<<", "&", "|", "^", "==", "<", "&&", "||"]
_TIGHT = {"javascript": [8, 9, 7, 3, 1, 2, 5, 6, 0, -1], "php": [8, 9, 7, 3, 1, 2, 5, 6, 0, -1], "python": [8, 9, 7, 6, 4, 5, 3, 3, 1, 0], "go": [4, 5, 5, 5, 4, 4, 3, 3, 2, 1]}
_TIGHT |= {"typescript": _TIGHT["javascript"], "java": _TIGHT["javascript"]}


def _trees(files: DataFrame, keep: Callable[[str, str | None], bool] | None = None) -> DataFrame:
    """The written trees of files (the nodes that are kept), dealt by path over as many tasks as their nodes need."""
    spread = files.repartition(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), "path")
    nodes = saved(syntax.trees(spread, keep), "trees")
    return dealt(nodes, "path", rows=nodes.count())


def _spelt(lang: str) -> list[str]:
    return [{"&&": "and", "||": "or"}.get(x, x) if lang == "python" else x for x in _OPS]


_LEVELS = ", ".join(f"({k}, {j}, '{op}', {_TIGHT[lang][j]})" for k, lang in enumerate(_LANGS) for j, op in enumerate(_spelt(lang)))


@_query(f"""WITH levels(lang, nr, op, tight) AS (VALUES {_LEVELS}),
p AS (SELECT p_partkey, p_size % 6 AS lang, unnest([1, 2, 3]) AS k, unnest([p_partkey % 10, p_partkey // 10 % 10, p_partkey // 100 % 10]) AS nr FROM part),
r AS (SELECT p_partkey, k, op, tight FROM p JOIN levels USING (lang, nr)),
e AS (SELECT a.p_partkey, a.k, a.op, coalesce(max(b.k) FILTER (b.k < a.k AND b.tight < a.tight), 0) AS lo, coalesce(min(b.k) FILTER (b.k > a.k AND b.tight <= a.tight), 4) AS hi
FROM r a JOIN r b USING (p_partkey) GROUP BY ALL)
SELECT p_partkey, op, CAST((10 ** k - 10 ** lo) / 9 AS BIGINT) AS left_operands, CAST((10 ** hi - 10 ** k) / 9 AS BIGINT) AS right_operands FROM e""")
def operator_structure(spark, sf: str) -> DataFrame:
    """An expression of three operators for each part, in six languages: what each operator takes on its left and right.

    Operand n counts 10^(n-1), so a sum over a subtree tells its operands.
    """
    ops = F.element_at(F.array(*[F.array(*map(F.lit, _spelt(lang))) for lang in _LANGS]), (F.col("p_size") % 6 + 1).cast("int"))
    op = lambda by: F.element_at(ops, (F.floor(F.col("p_partkey") / by) % 10 + 1).cast("int"))
    text = F.concat(F.lit("x = v1 "), op(1), F.lit(" v2 "), op(10), F.lit(" v3 "), op(100), F.lit(" v4\n"))
    lang = F.element_at(F.array(*map(F.lit, _LANGS)), (F.col("p_size") % 6 + 1).cast("int"))
    files = table(spark, sf, "part").select(F.col("p_partkey").alias("path"), lang.alias("lang"), F.when(F.col("p_size") % 6 == 3, F.concat(F.lit("<?php\n"), text)).otherwise(text).alias("content"))
    nodes = _trees(files.withColumn("path", F.col("path").cast("string")))
    each = F.when((F.col("kind") == "name") & F.col("word").startswith("v"), F.pow(F.lit(10), F.substring("word", 2, 1).cast("int") - 1).cast("long"))
    sides = syntax.with_parent(syntax.subtree_sums(nodes, each, "operands")).where("parent_kind = 'binary'")
    side = lambda n, out: F.sum(F.when(F.col("nth") == n, F.col("operands"))).alias(out)
    found = sides.groupBy("path", "parent", "parent_word").agg(side(0, "left_operands"), side(1, "right_operands"))
    return found.select(F.col("path").cast("long").alias("p_partkey"), F.col("parent_word").alias("op"), "left_operands", "right_operands")


@_query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'k' ELSE 'f' END || CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey ELSE o_custkey END AS inside, CAST(o_orderkey % 4 AS BIGINT) AS ifs,
CAST(CASE WHEN o_orderkey % 3 = 0 THEN 2 ELSE 1 END AS BIGINT) AS functions, CAST(1 + o_custkey % 3 AS BIGINT) AS calls FROM orders WHERE o_orderkey IS NOT NULL AND o_custkey IS NOT NULL""")
def call_enclosures(spark, sf: str) -> DataFrame:
    """A program for each order, in JavaScript or Python, with its call under some ifs and functions: what encloses the call, and how many calls it holds, itself included."""
    key = lambda c: F.col(c).cast("string")
    o = table(spark, sf, "orders").where("o_orderkey is not null and o_custkey is not null")
    call = F.concat(F.lit("g("), F.repeat(F.lit("h("), (F.col("o_custkey") % 3).cast("int")), F.lit("x"), F.repeat(F.lit(")"), (F.col("o_custkey") % 3).cast("int")), F.lit(")"))
    own, ifs = F.col("o_orderkey") % 3 == 0, (F.col("o_orderkey") % 4).cast("int")
    script = F.concat(
        F.lit("function f"), key("o_custkey"), F.lit("(x) {\n"), F.when(own, F.concat(F.lit("const k"), key("o_orderkey"), F.lit(" = 1;\nfunction k"), key("o_orderkey"), F.lit("(y) {\n"))).otherwise(""),
        F.repeat(F.lit("if (c) {\n"), ifs), call, F.lit(";\n"), F.repeat(F.lit("}\n"), ifs), F.when(own, F.lit("}\n")).otherwise(""), F.lit("}\n"),
    )
    deep = F.when(own, 2).otherwise(1)
    heads = F.concat_ws("", F.when(ifs > 0, F.transform(F.sequence(F.lit(0), ifs - 1), lambda j: F.concat(F.repeat(F.lit("    "), deep + j), F.lit("if c:\n")))).otherwise(F.array(F.lit(""))))
    python = F.concat(
        F.lit("def f"), key("o_custkey"), F.lit("(x):\n"), F.when(own, F.concat(F.lit("    def k"), key("o_orderkey"), F.lit("(y):\n"))).otherwise(""),
        heads, F.repeat(F.lit("    "), deep + ifs), call, F.lit("\n"),
    )
    even = F.col("o_custkey") % 2 == 0
    files = o.select(key("o_orderkey").alias("path"), F.when(even, "python").otherwise("javascript").alias("lang"), F.when(even, python).otherwise(script).alias("content"))
    nodes = _trees(files, lambda kind, word: kind in ("call", "function") or (kind == "statement" and word == "if"))  # no other counts or is asked about
    calls, fun = F.when(F.col("kind") == "call", 1), F.col("kind") == "function"
    rows = syntax.subtree_sums(nodes, calls, "calls")
    rows = syntax.above(syntax.above(rows, (F.col("kind") == "statement") & F.col("word").eqNullSafe("if"), "ifs"), fun, "functions")
    rows = syntax.nearest(rows, fun, "inside", F.col("word")).where("kind = 'call' and word = 'g'")
    return rows.select(F.col("path").cast("long").alias("o_orderkey"), "inside", "ifs", "functions", F.col("calls").cast("long").alias("calls"))



@_query("""WITH b AS (SELECT c_custkey, c_custkey % 4 AS n, c_nationkey % 3 + 1 AS m FROM customer WHERE c_custkey IS NOT NULL AND c_nationkey IS NOT NULL),
e AS (SELECT c_custkey, 'a' || c_custkey AS caller, unnest(['b', 'a', 'b']) || c_custkey AS callee, unnest([2, 2, 3]) AS line, n, unnest([1, 2, 3]) AS k FROM b
UNION ALL SELECT c_custkey, 'b' || c_custkey, 'a' || c_custkey, unnest(range(m)) + CASE WHEN n = 0 THEN 3 WHEN n < 3 THEN 4 ELSE 5 END, n, 0 FROM b)
SELECT c_custkey, caller, callee, CAST(line AS BIGINT) AS line, row_number() OVER (PARTITION BY c_custkey ORDER BY line, caller, callee) - 1 AS ord FROM e WHERE k <= n""")
def call_edge_order(spark, sf: str) -> DataFrame:
    """A program for each customer, of two functions that call each other some times: edges with their places."""
    key = lambda name: F.concat(F.lit(name), F.col("c_custkey").cast("string"))
    c = table(spark, sf, "customer").where("c_custkey is not null and c_nationkey is not null")
    n = F.col("c_custkey") % 4
    first = F.when(n == 1, F.concat(key("    b"), F.lit("(x)\n"))).when(n >= 2, F.concat(key("    b"), F.lit("("), key("a"), F.lit("(x))\n"))).otherwise("")
    text = F.concat(key("def a"), F.lit("(x):\n"), first, F.when(n == 3, F.concat(key("    b"), F.lit("(x)\n"))).otherwise(""), key("def b"), F.lit("(x):\n"), F.repeat(F.concat(key("    a"), F.lit("(x)\n")), (F.col("c_nationkey") % 3 + 1).cast("int")))
    files = c.select(F.col("c_custkey").cast("string").alias("path"), F.lit("python").alias("lang"), text.alias("content"))
    found = taint.call_edges(files.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path"))
    return found.select(F.col("path").cast("long").alias("c_custkey"), "caller", "callee", "line", "ord")


def queries() -> dict:
    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    return dict(_O)
