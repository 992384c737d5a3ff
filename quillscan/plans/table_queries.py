"""Queries over the given tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillscan.operators import relations as R
from quillscan.operators import text_rules as X
from quillscan.operators.review import PRICES, cost_of
from quillscan.sources.shared import dealt
from quillscan.sources.tables import lines, table

_SQL_SECRET = X.SECRET.replace("'", "''")
_SQL_LINES = "SELECT doc_id, source, generate_subscripts(ls, 1) AS line_no, unnest(ls) AS line FROM (SELECT doc_id, source, string_split(text, chr(10)) AS ls FROM documents)"
_SQL_DUMMY = " OR ".join(f"contains(lower(line), '{w}')" for w in X.DUMMY)
_SQL_HITS = f"SELECT doc_id, source, line_no, line FROM ({_SQL_LINES}) WHERE regexp_matches(line, '{_SQL_SECRET}') AND NOT ({_SQL_DUMMY})"
_Q, _O = {}, {}


def _query(sql: str):
    def add(f):
        _Q[f.__name__] = f
        _O[f.__name__] = sql
        return f

    return add


def _secret_lines(spark, sf: str) -> DataFrame:
    return lines(table(spark, sf, "documents"), "doc_id", "source").where(X.is_secret(F.col("line")))


@_query(f"""SELECT doc_id, line_no, 'sec-' || substr(sha256(concat_ws(chr(0), 'CG-020', CAST(doc_id AS VARCHAR), CAST(line_no AS VARCHAR), line)), 1, 12) AS finding_id
FROM ({_SQL_HITS})""")
def secret_line_scan(spark, sf: str) -> DataFrame:
    hit = _secret_lines(spark, sf)
    return hit.select("doc_id", "line_no", X.finding_id(F.lit("sec"), F.lit("CG-020"), F.col("doc_id").cast("string"), F.col("line_no").cast("string"), F.col("line")).alias("finding_id"))


@_query(f"""SELECT source, 'high' AS severity, 798 AS cwe, count(h.doc_id) AS findings, count(DISTINCT h.doc_id) AS files
FROM (SELECT DISTINCT source FROM documents) s LEFT JOIN ({_SQL_HITS}) h USING (source) GROUP BY source""")
def secret_by_source_severity(spark, sf: str) -> DataFrame:
    every = table(spark, sf, "documents").select("source").distinct()
    n = _secret_lines(spark, sf).groupBy("source").agg(F.count("*").alias("findings"), F.countDistinct("doc_id").alias("files"))
    return every.join(n, "source", "left").select("source", F.lit("high").alias("severity"), F.lit(798).alias("cwe"), F.coalesce("findings", F.lit(0)).alias("findings"), F.coalesce("files", F.lit(0)).alias("files"))


@_query(f"""SELECT doc_id, line_no, context FROM (SELECT *, string_agg(line, chr(10)) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS context FROM ({_SQL_LINES}))
WHERE regexp_matches(line, '{_SQL_SECRET}') AND NOT ({_SQL_DUMMY})""")
def context_frame(spark, sf: str) -> DataFrame:
    lined = lines(table(spark, sf, "documents"), "doc_id")
    some = lined.join(_secret_lines(spark, sf).select("doc_id").distinct(), "doc_id", "left_semi")
    return X.context_frame(some, "doc_id", 2).where(X.is_secret(F.col("line"))).select("doc_id", "line_no", "context")


def _sql_any(column: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({column}, '{w}')" for w in words) + ")"


@_query(f"""SELECT page_id, {_sql_any("html", X.SINKS)} AS sink, {_sql_any("html", X.SOURCES)} AS source, {_sql_any("html", X.SINKS)} AND {_sql_any("html", X.SOURCES)} AS dom_xss, contains(html, '<script') AS script FROM pages""")
def html_sink_scan(spark, sf: str) -> DataFrame:
    sink, source = X.any_in(F.col("html"), X.SINKS), X.any_in(F.col("html"), X.SOURCES)
    return table(spark, sf, "pages").select("page_id", sink.alias("sink"), source.alias("source"), (sink & source).alias("dom_xss"), F.col("html").contains("<script").alias("script"))


@_query("""SELECT sha256(concat_ws(chr(0), 'DUP', lang, trim(regexp_replace(text, '\\s+', ' ', 'g')))) AS fingerprint, count(*) AS cnt FROM documents GROUP BY 1""")
def fingerprint_counts(spark, sf: str) -> DataFrame:
    return table(spark, sf, "documents").groupBy(X.fingerprint(F.lit("DUP"), F.col("lang"), F.col("text")).alias("fingerprint")).agg(F.count("*").alias("cnt"))


@_query("""WITH f AS (SELECT doc_id, sha256(concat_ws(chr(0), 'DUP', lang, trim(regexp_replace(text, '\\s+', ' ', 'g')))) AS fingerprint FROM documents),
b AS (SELECT fingerprint, count(*) AS cnt FROM f WHERE doc_id % 2 = 0 GROUP BY 1)
SELECT doc_id, fingerprint FROM (SELECT *, row_number() OVER (PARTITION BY fingerprint ORDER BY doc_id) AS n FROM f) LEFT JOIN b USING (fingerprint) WHERE n > coalesce(cnt, 0)""")
def baseline_bag_diff(spark, sf: str) -> DataFrame:
    """Findings beyond a baseline that knows those of every even document."""
    f = table(spark, sf, "documents").select("doc_id", X.fingerprint(F.lit("DUP"), F.col("lang"), F.col("text")).alias("fingerprint"))
    base = f.where("doc_id % 2 = 0").groupBy("fingerprint").agg(F.count("*").alias("cnt"))
    return R.bag_difference(f, base, "fingerprint", ["doc_id"]).select("doc_id", "fingerprint")


_SQL_SPANS = "SELECT l_orderkey AS file, l_linenumber AS s, max(l_linenumber + CAST(floor(l_quantity) AS INTEGER) % 4) AS e FROM lineitem GROUP BY 1, 2"


def _spans(spark, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    return li.groupBy(F.col("l_orderkey").alias("file"), F.col("l_linenumber").alias("s")).agg(F.max(F.col("l_linenumber") + F.floor("l_quantity").cast("int") % 4).alias("e"))


@_query(f"""WITH i AS ({_SQL_SPANS}) SELECT file, s, e FROM i WHERE NOT EXISTS (SELECT 1 FROM i o WHERE o.file = i.file AND o.s < i.s AND o.e >= i.e)""")
def containment_suppression(spark, sf: str) -> DataFrame:
    return R.drop_contained(_spans(spark, sf), ["file"], ["s"], F.col("e"))


@_query("""SELECT file, s, ord FROM (SELECT l_suppkey AS file, l_linenumber AS s, l_orderkey AS ord, row_number() OVER (PARTITION BY l_suppkey, l_linenumber ORDER BY l_orderkey, l_partkey) AS n FROM lineitem) WHERE n = 1""")
def first_seen_dedup(spark, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("file"), F.col("l_linenumber").alias("s"), F.col("l_orderkey").alias("ord"), "l_partkey")
    return R.first_seen(li, ["file", "s"], ["ord", "l_partkey"]).select("file", "s", "ord")


_SQL_CHANGED = "SELECT o_orderkey AS file, CAST(o_custkey % 7 + 1 AS INTEGER) AS line, o_orderstatus FROM orders"


def _changed(spark, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("file"), (F.col("o_custkey") % 7 + 1).cast("int").alias("line"), "o_orderstatus")


@_query(f"""WITH i AS ({_SQL_SPANS}), c AS ({_SQL_CHANGED}) SELECT file, s, e FROM i WHERE EXISTS (SELECT 1 FROM c WHERE c.file = i.file AND c.line BETWEEN i.s AND greatest(i.s, i.e))""")
def diff_semi_join(spark, sf: str) -> DataFrame:
    return R.touching(_spans(spark, sf), _changed(spark, sf).drop("o_orderstatus"))


@_query(f"""WITH p AS (SELECT DISTINCT l_orderkey AS file, l_linenumber AS line FROM lineitem), c AS (SELECT file, line AS s, line + 1 AS e FROM ({_SQL_CHANGED}) WHERE o_orderstatus <> 'P')
SELECT file, line FROM p WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.file = p.file) OR EXISTS (SELECT 1 FROM c WHERE c.file = p.file AND p.line BETWEEN c.s AND c.e)""")
def diff_range_nullable(spark, sf: str) -> DataFrame:
    """Orders that are under way have no ranges, and so no filter."""
    points = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("file"), F.col("l_linenumber").alias("line"))
    ranges = _changed(spark, sf).where("o_orderstatus <> 'P'").select("file", F.col("line").alias("s"), (F.col("line") + 1).alias("e"))
    rows = points.count()
    return R.in_ranges(dealt(points, "file", rows=rows).distinct(), dealt(ranges, "file", rows=rows))


@_query("""SELECT e.event_id, e.user_id, (SELECT max(c.ts) FROM events c WHERE c.user_id = e.user_id AND c.event_type = 'click' AND c.ts <= e.ts) AS source_ts FROM events e WHERE e.event_type = 'error'""")
def asof_nearest_source(spark, sf: str) -> DataFrame:
    """The last click at or before each error of a user; clicks come first among rows of one time."""
    ev = table(spark, sf, "events")
    click = F.col("event_type") == "click"
    found = ev.withColumn("source_ts", R.latest_before(ev, "user_id", ["ts", F.when(click, 0).otherwise(1)], click, F.col("ts")))
    return found.where("event_type = 'error'").select("event_id", "user_id", "source_ts")


@_query(f"""WITH s AS (SELECT file, s, e, 'f' || CAST(s AS VARCHAR) AS name FROM ({_SQL_SPANS})), p AS (SELECT DISTINCT l_orderkey AS file, l_linenumber AS line FROM lineitem)
SELECT p.file, p.line, arg_max(s.name, s.s) AS name FROM p LEFT JOIN s ON p.file = s.file AND p.line BETWEEN s.s AND s.e GROUP BY 1, 2""")
def innermost_span(spark, sf: str) -> DataFrame:
    spans = _spans(spark, sf).withColumn("name", F.concat(F.lit("f"), F.col("s").cast("string"))).withColumn("ord", F.col("s"))
    points = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("file"), F.col("l_linenumber").alias("line")).distinct()
    return R.innermost(points, spans)


@_query("""WITH RECURSIVE e AS (SELECT DISTINCT o_custkey AS src, o_orderkey AS dst FROM orders WHERE o_custkey IS NOT NULL AND o_orderkey IS NOT NULL),
r(src, dst, hops) USING KEY (src, dst) AS (SELECT src, dst, 1::BIGINT FROM e
UNION SELECT r.src, e.dst, r.hops + 1 FROM r JOIN e ON r.dst = e.src LEFT JOIN recurring.r AS k ON k.src = r.src AND k.dst = e.dst WHERE k.src IS NULL)
SELECT src, dst, hops FROM r""")
def call_reachability(spark, sf: str) -> DataFrame:
    """Every order's edge from its customer's key to its own, to the fixpoint, with the least number of steps."""
    return R.closure(table(spark, sf, "orders").select(F.col("o_custkey").alias("src"), F.col("o_orderkey").alias("dst")))


@_query("""SELECT path FROM (SELECT 'doc/' || doc_id || '.txt' AS path, row_number() OVER (ORDER BY sha256(concat_ws(chr(0), 'seed', lower('doc/' || doc_id || '.txt')))) AS n, count(*) OVER () AS total FROM documents) WHERE n <= greatest(1, ceil(total * 0.2))""")
def hash_sample(spark, sf: str) -> DataFrame:
    paths = table(spark, sf, "documents").select(F.concat(F.lit("doc/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"))
    return R.hash_sample(paths, "path", 0.2, "seed")


@_query("""SELECT o_orderkey, o_totalprice, round(spent, 2) AS spent FROM (SELECT *, coalesce(sum(o_totalprice) OVER (ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent FROM orders) WHERE spent < 50000000""")
def budget_cutoff_whole(spark, sf: str) -> DataFrame:
    """Calls that one budget for all lets begin, by a prefix sum over ranges."""
    return R.within_budget(table(spark, sf, "orders"), "o_orderkey", "o_totalprice", 50000000).select("o_orderkey", "o_totalprice", F.round("spent", 2).alias("spent"))


@_query("""SELECT o_orderkey, o_custkey, round(spent, 2) AS spent FROM (SELECT *, coalesce(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent FROM orders) WHERE spent < 500000""")
def budget_cutoff(spark, sf: str) -> DataFrame:
    """Calls of each project (customer) that its budget lets begin."""
    return R.within_budget(table(spark, sf, "orders"), "o_orderkey", "o_totalprice", 500000, "o_custkey").select("o_orderkey", "o_custkey", F.round("spent", 2).alias("spent"))


@_query("""SELECT d.doc_id, sha256('{"v":1,"rule":"CG-020","model":"m","doc":' || d.doc_id || '}') AS key_hash, l.toxic IS NOT NULL AND 1000 - d.doc_id % 1000 <= 600 AS hit, CASE WHEN 1000 - d.doc_id % 1000 <= 600 THEN l.toxic END AS verdict
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def cache_probe(spark, sf: str) -> DataFrame:
    """Cached verdicts by key; entries older than their time to live are misses."""
    d = table(spark, sf, "documents").select("doc_id")
    key = F.sha2(F.concat(F.lit('{"v":1,"rule":"CG-020","model":"m","doc":'), F.col("doc_id").cast("string"), F.lit("}")), 256)
    store = table(spark, sf, "labels").select("doc_id", F.col("toxic").alias("verdict"))
    fresh = 1000 - F.col("doc_id") % 1000 <= 600
    got = d.withColumn("key_hash", key).join(store, "doc_id", "left")
    return got.select("doc_id", "key_hash", (F.col("verdict").isNotNull() & fresh).alias("hit"), F.when(fresh, F.col("verdict")).alias("verdict"))


@_query(f"""WITH p AS (SELECT DISTINCT doc_id FROM ({_SQL_HITS})), t AS (SELECT doc_id FROM labels WHERE quality = 0)
SELECT count(*) FILTER (p.doc_id IS NOT NULL AND t.doc_id IS NOT NULL) AS tp, count(*) FILTER (t.doc_id IS NULL) AS fp, count(*) FILTER (p.doc_id IS NULL) AS fn,
round(count(*) FILTER (p.doc_id IS NOT NULL AND t.doc_id IS NOT NULL) / nullif(count(p.doc_id), 0)::DOUBLE, 9) AS prec, round(count(*) FILTER (p.doc_id IS NOT NULL AND t.doc_id IS NOT NULL) / nullif(count(t.doc_id), 0)::DOUBLE, 9) AS recall
FROM p FULL JOIN t ON p.doc_id = t.doc_id""")
def precision_recall(spark, sf: str) -> DataFrame:
    p = _secret_lines(spark, sf).select(F.col("doc_id").alias("p")).distinct()
    t = table(spark, sf, "labels").where("quality = 0").select(F.col("doc_id").alias("t"))
    both = F.col("p").isNotNull() & F.col("t").isNotNull()
    n = p.join(t, p["p"] == t["t"], "full").agg(F.count_if(both).alias("tp"), F.count_if(F.col("t").isNull()).alias("fp"), F.count_if(F.col("p").isNull()).alias("fn"), F.count("p").alias("np"), F.count("t").alias("nt"))
    share = lambda x: F.round(F.col("tp") / F.nullif(F.col(x), F.lit(0)), 9)
    return n.select("tp", "fp", "fn", share("np").alias("prec"), share("nt").alias("recall"))


@_query("""WITH v AS (SELECT l.doc_id, toxic = 1 AS is_real, ('0x' || substr(sha256(CAST(l.doc_id AS VARCHAR)), 1, 1))::INTEGER < 8 AS confirmed FROM labels l)
SELECT count(*) AS labelled, round(count(*) FILTER (is_real AND confirmed) / nullif(count(*) FILTER (is_real), 0)::DOUBLE, 9) AS confirm_recall,
round(count(*) FILTER (NOT is_real AND NOT confirmed) / nullif(count(*) FILTER (NOT is_real), 0)::DOUBLE, 9) AS dismiss_rate, round(count(*) FILTER (is_real = confirmed) / count(*)::DOUBLE, 9) AS accuracy,
(SELECT count(*) FROM documents ANTI JOIN labels USING (doc_id)) AS unlabelled FROM v""")
def triage_metrics(spark, sf: str) -> DataFrame:
    lab = table(spark, sf, "labels")
    real, yes = F.col("toxic") == 1, F.conv(F.substring(F.sha2(F.col("doc_id").cast("string"), 256), 1, 1), 16, 10).cast("int") < 8
    share = lambda a, b: F.round(F.count_if(a) / F.nullif(F.count_if(b), F.lit(0)), 9)
    m = lab.agg(F.count("*").alias("labelled"), share(real & yes, real).alias("confirm_recall"), share(~real & ~yes, ~real).alias("dismiss_rate"), share(real == yes, F.lit(True)).alias("accuracy"))
    un = table(spark, sf, "documents").join(lab, "doc_id", "left_anti").agg(F.count("*").alias("unlabelled"))
    return m.join(F.broadcast(un))  # one row each


MODELS = ["claude-opus-x", "claude-sonnet-x", "claude-mini-haiku", "gpt-4o-mini", "gpt-4o", "gpt-4-x", "other"]


def _sql_price(k: int) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches(model, '{r[1]}') THEN {r[k]!r}::DOUBLE" for r in PRICES) + " END"


@_query(f"""WITH c AS (SELECT p_partkey, [{", ".join(repr(m) for m in MODELS)}][p_partkey % {len(MODELS)} + 1] AS model FROM part)
SELECT p_partkey, model, round(p_partkey / 1e6::DOUBLE * {_sql_price(2)} + 600 / 1e6::DOUBLE * {_sql_price(3)}, 9) AS cost FROM c""")
def pricing_first_match(spark, sf: str) -> DataFrame:
    """The cost of a call by the first price whose pattern its model has; none: null."""
    names = F.array(*[F.lit(m) for m in MODELS])
    calls = table(spark, sf, "part").select("p_partkey", F.element_at(names, (F.col("p_partkey") % len(MODELS) + 1).cast("int")).alias("model"))
    return calls.withColumn("cost", F.round(cost_of(F.col("model"), F.col("p_partkey"), F.lit(600)), 9))


def queries() -> dict:
    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    return dict(_O)
