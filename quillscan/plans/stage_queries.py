"""Queries of single stages over the tables: rules of one's own, diff ranges, labels, explanations, the review cache."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillscan.operators import plugins, relations, review, taint, text_rules
from quillscan.sources import diffs, snippets
from quillscan.sources.shared import remove, saved, shared_dir
from quillscan.sources.tables import table

_Q, _O = {}, {}


def _query(sql: str):
    def add(f):
        _Q[f.__name__], _O[f.__name__] = f, sql
        return f

    return add


def _long(path: str, lang: str, content: str):
    n = content.count("\n")
    if n > 4:
        yield {"title": f"{n} lines", "severity": "info", "confidence": n / 100, "line": n, "tags": [lang, "size", lang]}


def _certain(path: str, lang: str, content: str):
    yield {"title": "too sure", "confidence": 1.0 + len(lang)}


_LENGTHS = snippets._sql(*((k, s.content.count("\n"), {".js": "javascript", ".ts": "typescript", ".py": "python"}.get(s.ext, s.ext[1:])) for k, s in enumerate(snippets.SNIPPETS) if s.ext != ".rb"))


@_query(f"""WITH f AS (SELECT {snippets._PATH} AS path, n, lang FROM {snippets._PARTS} JOIN {_LENGTHS} x(x_template, n, lang) ON x_template = template)
SELECT path, 'O-1' AS rule_id, n || ' lines' AS title, 'info' AS severity, n / 100.0::DOUBLE AS confidence, CAST(n AS BIGINT) AS line, array_to_string(list_sort([lang, 'size']), ',') AS tags, false AS failed FROM f WHERE n > 4
UNION ALL SELECT path, 'O-2', NULL, NULL, NULL, NULL, NULL, true FROM f""")
def own_rules_scan(spark, sf: str) -> DataFrame:
    """Rules as functions over the code corpus: one that tells of long files, and one whose findings are faulty everywhere."""
    found = plugins.evaluate(snippets.files(spark, sf), plugins.merged({"O-1": _long}, {"O-2": _certain}))
    return found.select("path", "rule_id", "title", "severity", "confidence", "line", F.array_join("tags", ",").alias("tags"), F.col("error").isNotNull().alias("failed"))


@_query("""SELECT l_orderkey AS diff, 's' || l_suppkey || '.py' AS file, l_partkey AS s, l_partkey + CAST(floor(l_quantity) AS BIGINT) % 4 - 1 AS e FROM lineitem WHERE CAST(floor(l_quantity) AS BIGINT) % 4 > 0""")
def diff_ranges_parse(spark, sf: str) -> DataFrame:
    """A diff for each order with a hunk for each line item: the ranges of the new file that hunks name, empty ones left out."""
    li = table(spark, sf, "lineitem").withColumn("n", F.floor("l_quantity") % 4)
    text = lambda *x: F.concat(*[F.lit(v) if isinstance(v, str) else v.cast("string") for v in x])
    hunk = F.array(text("+++ b/s", F.col("l_suppkey"), ".py"), text("@@ -1,2 +", F.col("l_partkey"), ",", F.col("n"), " @@"), F.lit("-gone"), F.lit("+new"))
    place = (F.col("l_linenumber") * 1_000_000 + F.col("l_partkey")) * 100_000 + F.col("l_suppkey")
    lined = li.select(F.col("l_orderkey").alias("diff"), place.alias("place"), F.posexplode(hunk).alias("at", "line"))
    return diffs.changed_ranges(lined.select("diff", (F.col("place") * 10 + F.col("at")).alias("line_no"), "line"), "diff").select("diff", "file", F.col("s").cast("long").alias("s"), F.col("e").cast("long").alias("e"))


def _told(prompt: str) -> str:
    """A model that names the dangerous call of the flow that it is asked about."""
    found = json.loads(prompt)
    return json.dumps({"explanation": f"{found['source']} gets to {found['sink']} at line {found['sink_line']}"})


@_query(snippets.expected("flows", "a, b, sink", "CAST(b AS INTEGER) AS sink_line, ' gets to ' || sink || ' at line ' || b AS explanation"))
def flow_explanations(spark, sf: str) -> DataFrame:
    """A sentence on each flow within a function, by a model that is asked about its facts alone."""
    rows = review.explained(taint.local_paths(snippets.files(spark, sf)), _told, ["path", "sink_line"])
    return rows.select("path", "sink_line", F.regexp_extract("explanation", "( gets to .*)$", 1).alias("explanation")).distinct()


@_query("""SELECT sha256(CAST(doc_id AS VARCHAR)) AS key_hash, max(CAST(doc_id AS BIGINT)) * 1000 + 2 AS cached_at, arg_max(toxic = 1, quality) AS confirmed FROM labels WHERE doc_id IS NOT NULL AND doc_id * 1000 + 2 >= 40000 GROUP BY 1""")
def review_cache_pruned(spark, sf: str) -> DataFrame:
    """Verdicts on every labelled document, asked for twice, written to a cache, and what a prune leaves of it: the newer one of each key, within its time to live."""
    path = f"{shared_dir(spark).rstrip('/')}/quillscan/cache-{uuid.uuid4().hex}"
    known = table(spark, sf, "labels").where("doc_id is not null").groupBy("doc_id").agg(F.max_by(F.col("toxic") == 1, "quality").alias("confirmed"))
    none = F.lit(None)
    rows = lambda later: known.select(
        F.sha2(F.col("doc_id").cast("string"), 256).alias("key_hash"), "confirmed", F.lit(0.5).alias("verdict_confidence"), F.lit("r").alias("reasoning"), none.cast("string").alias("fix_description"),
        none.cast("string").alias("fix_code"), none.cast("long").alias("tokens_in"), none.cast("long").alias("tokens_out"), (F.col("doc_id") * 1000 + later).alias("cached_at"), F.lit(review.VERSION).alias("schema_version"),
    )
    for later in (1, 2):
        review.write_cache(rows(later), path)
    top = 1_000_000_000
    review.prune(spark, path, top, (top - 40_000) // 1000)
    out = saved(review.read_cache(spark, path).select("key_hash", "cached_at", "confirmed"), "pruned")
    remove(spark, path)
    return out


@_query("""SELECT c_mktsegment AS segment, min(c_custkey) AS first FROM customer GROUP BY 1""")
def first_sight(spark, sf: str) -> DataFrame:
    """Distinct segments in the order of first sight."""
    found = relations.distinct_in_order(table(spark, sf, "customer"), "c_mktsegment", F.col("c_custkey"))
    return found.withColumnRenamed("c_mktsegment", "segment")


@_query("""WITH RECURSIVE e AS (SELECT DISTINCT o_custkey AS src, o_orderkey AS dst FROM orders WHERE o_custkey IS NOT NULL AND o_orderkey IS NOT NULL),
r(node, hops) USING KEY (node) AS (SELECT c_custkey, 0::BIGINT FROM customer WHERE c_mktsegment = 'MACHINERY'
UNION SELECT e.dst, r.hops + 1 FROM r JOIN e ON e.src = r.node LEFT JOIN recurring.r k ON k.node = e.dst WHERE k.node IS NULL)
SELECT node, hops FROM r""")
def call_reach_from(spark, sf: str) -> DataFrame:
    """Every order that calls from one segment's customers lead to, with the least number of steps: a row a node."""
    edges = table(spark, sf, "orders").select(F.col("o_custkey").alias("src"), F.col("o_orderkey").alias("dst"))
    return relations.reached(edges, table(spark, sf, "customer").where("c_mktsegment = 'MACHINERY'").select(F.col("c_custkey").alias("node")))


_LABELLED = "SELECT DISTINCT l_orderkey AS file, CAST(l_linenumber AS BIGINT) AS line, unnest(CASE WHEN l_partkey % 3 = 0 THEN ['CG-' || l_partkey % 7] WHEN l_partkey % 3 = 1 THEN ['CG-' || l_partkey % 7, 'AB-' || l_suppkey % 5] ELSE [] END) AS rule_id FROM lineitem"


def _labelled(spark, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    one, two = F.concat(F.lit("CG-"), F.col("l_partkey") % 7), F.concat(F.lit("ab-"), F.col("l_suppkey") % 5)
    said = F.when(F.col("l_partkey") % 3 == 0, F.concat(F.lit("  # scan-expect: "), one)).when(F.col("l_partkey") % 3 == 1, F.concat(F.lit("  # scan-expect "), one, F.lit(", "), two)).otherwise(F.lit("  # scan-expect nothing"))
    return li.select(F.col("l_orderkey").alias("file"), F.col("l_linenumber").cast("long").alias("line_no"), F.concat(F.lit("eval(x)"), said).alias("line"))


@_query(_LABELLED)
def expected_labels(spark, sf: str) -> DataFrame:
    """What comments of lines expect, a line for each line item."""
    return text_rules.expectations(_labelled(spark, sf), rows=table(spark, sf, "lineitem").count())


@_query(f"""WITH e AS ({_LABELLED}), f AS (SELECT DISTINCT l_orderkey AS file, CAST(l_linenumber AS BIGINT) AS line, 'CG-' || l_partkey % 7 AS rule_id FROM lineitem WHERE l_suppkey % 4 > 0),
b AS (SELECT f.file AS a, e.file AS b FROM f FULL JOIN e ON f.file = e.file AND f.line = e.line AND f.rule_id = e.rule_id),
n AS (SELECT count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) AS tp, count(*) FILTER (b IS NULL) AS fp, count(*) FILTER (a IS NULL) AS fn FROM b)
SELECT tp, fp, fn, round(tp / (tp + fp)::DOUBLE, 9) AS precision, round(tp / (tp + fn)::DOUBLE, 9) AS recall FROM n""")
def label_scores(spark, sf: str) -> DataFrame:
    """Findings of line items held against what comments expect, by file, line and rule."""
    li = table(spark, sf, "lineitem").where("l_suppkey % 4 > 0")
    found = li.select(F.col("l_orderkey").alias("file"), F.col("l_linenumber").cast("long").alias("line"), F.concat(F.lit("CG-"), F.col("l_partkey") % 7).alias("rule_id"))
    rows = table(spark, sf, "lineitem").count()
    n = text_rules.scores(found, text_rules.expectations(_labelled(spark, sf), rows=rows), rows)
    return n.withColumns({c: F.round(c, 9) for c in ("precision", "recall")})


@_query("""WITH v AS (SELECT l_orderkey AS file, l_linenumber AS line, 'CG-' || l_partkey % 7 AS rule_id, bool_or(l_suppkey % 3 = 0) AS yes FROM lineitem WHERE l_partkey % 5 > 0 GROUP BY ALL),
k AS (SELECT l_orderkey AS file, l_linenumber AS line, 'CG-' || l_partkey % 7 AS rule_id, bool_or(l_returnflag = 'R') AS is_real FROM lineitem WHERE l_suppkey % 4 > 0 GROUP BY ALL),
b AS (SELECT yes, is_real FROM v FULL JOIN k ON v.file IS NOT DISTINCT FROM k.file AND v.line IS NOT DISTINCT FROM k.line AND v.rule_id IS NOT DISTINCT FROM k.rule_id)
SELECT count(is_real) AS labelled, round(count(*) FILTER (is_real AND yes) / nullif(count(*) FILTER (is_real), 0)::DOUBLE, 9) AS confirm_recall,
round(count(*) FILTER (NOT is_real AND NOT yes) / nullif(count(*) FILTER (NOT is_real), 0)::DOUBLE, 9) AS dismiss_rate, round(count(*) FILTER (is_real = yes) / nullif(count(is_real), 0)::DOUBLE, 9) AS accuracy,
count(*) FILTER (is_real <> yes) AS wrong, count(*) FILTER (is_real IS NULL) AS unlabelled, count(*) FILTER (yes IS NULL) AS silent FROM b""")
def triage_scores(spark, sf: str) -> DataFrame:
    """Verdicts on places of line items against labels of others: rates, wrong ones, places without a label and labels without a verdict."""
    li = table(spark, sf, "lineitem")
    place = [F.col("l_orderkey").alias("file"), F.col("l_linenumber").alias("line"), F.concat(F.lit("CG-"), F.col("l_partkey") % 7).alias("rule_id")]
    found = text_rules.triage(li.where("l_partkey % 5 > 0").select(*place, (F.col("l_suppkey") % 3 == 0).alias("confirmed")), li.where("l_suppkey % 4 > 0").select(*place, (F.col("l_returnflag") == "R").alias("is_real")))
    return found.withColumns({c: F.round(c, 9) for c in ("confirm_recall", "dismiss_rate", "accuracy")})


def queries() -> dict:
    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    return dict(_O)
