"""Queries over the derived code corpus, held against hand-written labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillscan.operators import custom_rules, enrich, parse, review, rules, taint, text_rules
from quillscan.plans import report, scan
from quillscan.sources import diffs, snippets
from quillscan.sources.shared import dealt, saved

_Q, _O = {}, {}


def _query(sql: str):
    def add(f):
        _Q[f.__name__], _O[f.__name__] = f, sql
        return f

    return add


def _found(spark, sf: str) -> DataFrame:
    return scan.findings(snippets.files(spark, sf), scan.Options(directive=snippets.DIRECTIVE))


_LABELS = snippets.expected("findings", "rule_id, line", "rule_id, line, CAST(regexp_extract(ext, '[a-z]+') AS VARCHAR) AS ext")
_META = "(VALUES " + ", ".join(f"('{id_}', '{severity}', {cwe}, '{name}')" for id_, name, severity, cwe in rules.META) + ") m(rule_id, severity, cwe, name)"


@_query(f"SELECT path, rule_id, CAST(line AS BIGINT) AS line FROM ({_LABELS})")
def rule_scan_all(spark, sf: str) -> DataFrame:
    return _found(spark, sf).select("path", "rule_id", "line")


@_query(f"""SELECT CASE ext WHEN 'js' THEN 'javascript' WHEN 'ts' THEN 'typescript' WHEN 'py' THEN 'python' ELSE ext END AS lang, rule_id, count(*) AS findings FROM ({_LABELS}) GROUP BY 1, 2""")
def rule_scan_by_language(spark, sf: str) -> DataFrame:
    return _found(spark, sf).groupBy("lang", "rule_id").agg(F.count("*").alias("findings"))


@_query(f"""SELECT CASE ext WHEN '.js' THEN 'javascript' WHEN '.ts' THEN 'typescript' WHEN '.py' THEN 'python' WHEN '.rb' THEN NULL ELSE substr(ext, 2) END AS lang, count(*) AS files FROM {snippets._PARTS} GROUP BY 1""")
def language_partition_counts(spark, sf: str) -> DataFrame:
    return snippets.files(spark, sf).groupBy("lang").agg(F.count("*").alias("files"))


@_query(f"SELECT {snippets._PATH} AS path, 'unsupported language' AS reason FROM {snippets._PARTS} WHERE ext = '.rb'")
def skipped_files(spark, sf: str) -> DataFrame:
    return scan.skipped(snippets.files(spark, sf))


@_query(f"SELECT path, line, rule_id FROM (SELECT path, CAST(line AS BIGINT) AS line, rule_id FROM ({_LABELS})) JOIN {_META} USING (rule_id) WHERE severity IN ('high', 'critical')")
def min_severity_filter(spark, sf: str) -> DataFrame:
    return scan.findings(snippets.files(spark, sf), scan.Options(severity="high", directive=snippets.DIRECTIVE)).select("path", "line", "rule_id")


@_query(f"SELECT CAST(max(CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END) AS INTEGER) AS top_rank, max(CASE severity WHEN 'critical' THEN 4 ELSE 0 END) >= 3 AS fails FROM ({_LABELS}) JOIN {_META} USING (rule_id)")
def severity_gate(spark, sf: str) -> DataFrame:
    return report.fails(_found(spark, sf), "high", rules.RANK)


@_query(f"""SELECT rule_id, name, CASE WHEN severity = 'medium' THEN 'warning' ELSE 'error' END AS level, CASE severity WHEN 'critical' THEN '9.0' WHEN 'high' THEN '7.0' ELSE '4.0' END AS score,
'external/cwe/cwe-' || cwe AS tag, 'https://cwe.mitre.org/data/definitions/' || cwe || '.html' AS help_uri, count(*) AS findings FROM ({_LABELS}) JOIN {_META} USING (rule_id) GROUP BY ALL""")
def sarif_rule_descriptors(spark, sf: str) -> DataFrame:
    return report.sarif_rules(_found(spark, sf))


@_query(f"SELECT rule_id, CASE WHEN severity = 'medium' THEN 'warning' ELSE 'error' END AS level, path AS file, CAST(line AS INTEGER) AS start_line FROM ({_LABELS}) JOIN {_META} USING (rule_id)")
def sarif_result_rows(spark, sf: str) -> DataFrame:
    return report.sarif_results(_found(spark, sf)).select("rule_id", "level", "file", "start_line")


@_query(f"SELECT path AS file, CAST(line AS BIGINT) AS line, rule_id, upper(severity) AS head, true AS fenced FROM ({_LABELS}) JOIN {_META} USING (rule_id)")
def review_comments(spark, sf: str) -> DataFrame:
    rows = report.review_comments(_found(spark, sf))
    return rows.select("file", "line", "rule_id", F.regexp_extract("body", r"^\*\*([A-Z]+)\*\* ", 1).alias("head"), F.col("body").rlike("(?s)\n(`{3,})\n.*\n\\1$").alias("fenced"))


@_query(f"""SELECT (SELECT count(*) FROM part) AS files, (SELECT count(*) FROM {snippets._PARTS} WHERE ext <> '.rb') AS scanned, (SELECT count(*) FROM {snippets._PARTS} WHERE ext = '.rb') AS skipped,
count(*) AS findings, count(*) FILTER (severity = 'low') AS low, count(*) FILTER (severity = 'medium') AS medium, count(*) FILTER (severity = 'high') AS high, count(*) FILTER (severity = 'critical') AS critical,
count(*) + 2 * (SELECT count(*) FROM part WHERE p_partkey % {len(snippets.SNIPPETS)} = 19) AS candidates, 2 * (SELECT count(*) FROM part WHERE p_partkey % {len(snippets.SNIPPETS)} = 19) AS filtered
FROM ({_LABELS}) JOIN {_META} USING (rule_id)""")
def counters_summary(spark, sf: str) -> DataFrame:
    files, options = snippets.files(spark, sf), scan.Options(directive=snippets.DIRECTIVE)
    n = scan.counters(files, scan.stages(files, options, saved(scan.candidates(files, options, counted=True), "candidates")))
    return n.withColumn("filtered", F.col("candidates") - F.col("findings")).select("files", "scanned", "skipped", "findings", *rules.RANK, "candidates", "filtered")


@_query(f"""SELECT path, rule_id, CAST(line AS BIGINT) AS line, false AS suppressed FROM ({_LABELS})
UNION ALL SELECT {snippets._PATH}, 'CG-002', CAST(hidden AS BIGINT), true FROM {snippets._PARTS}, (VALUES (5), (7)) h(hidden) WHERE template = 19""")
def inline_suppression(spark, sf: str) -> DataFrame:
    """Every candidate, and whether a directive covers it."""
    options = scan.Options(directive=snippets.DIRECTIVE)
    files = snippets.files(spark, sf)
    steps = scan.stages(files, options, saved(scan.candidates(files, options), "candidates"))
    key = ["path", "rule_id", "line"]
    left = steps["suspicious"].select(*key)
    return left.withColumn("suppressed", F.lit(False)).unionByName(steps["candidates"].select(*key).exceptAll(left).withColumn("suppressed", F.lit(True)))


@_query(snippets.expected("flows", "a, b, sink", "CAST(a AS INTEGER) AS source_line, CAST(b AS INTEGER) AS sink_line, sink"))
def taint_paths_intra(spark, sf: str) -> DataFrame:
    return taint.local_paths(snippets.files(spark, sf)).select("path", "source_line", "sink_line", "sink").distinct()


@_query(snippets.expected("chains", "a, b, n", "CAST(a AS INTEGER) AS source_line, CAST(b AS INTEGER) AS sink_line, CAST(n AS INTEGER) AS n_calls"))
def taint_paths_inter(spark, sf: str) -> DataFrame:
    return taint.cross_paths(snippets.files(spark, sf)).select("path", "source_line", "sink_line", F.size("calls").alias("n_calls")).distinct()


@_query(snippets.expected("edges", "caller, callee, line", "replace(caller, '{k}', CAST(p_partkey AS VARCHAR)) AS caller, callee, CAST(line AS BIGINT) AS line"))
def call_graph_edges(spark, sf: str) -> DataFrame:
    return taint.call_edges(snippets.files(spark, sf)).drop("ord")


@_query(snippets.expected("pairs", "a, b", "CAST(a AS BIGINT) AS source_line, CAST(b AS BIGINT) AS sink_line"))
def cooccurrence_heuristic(spark, sf: str) -> DataFrame:
    return taint.nearest_sources(snippets.files(spark, sf)).select("path", "source_line", "sink_line")


_RECEIVERS = ["userDb", "db_pool", "feedback", "self.conn", "$pdo->x", "get_db()", "photos", "appdb", "DB::link", "a[0].client", "XMLHttpDb", "dbg"]
_SQL_WORDS = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(seg, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '([A-Z])([A-Z][a-z])', '\\1 \\2', 'g'), '[^A-Za-z0-9]+', ' ', 'g'), ' +', ' ', 'g')"


@_query(f"""WITH r AS (SELECT p_partkey, [{", ".join("'" + x + "'" for x in _RECEIVERS)}][p_partkey % {len(_RECEIVERS)} + 1] AS receiver FROM part),
s AS (SELECT p_partkey, receiver, unnest(string_split(replace(replace(receiver, '->', '.'), '::', '.'), '.')) AS seg0 FROM r),
c AS (SELECT p_partkey, receiver, trim(regexp_replace(regexp_replace(regexp_replace(seg0, '\\(.*$', ''), '\\[[^\\]]*\\]', '', 'g'), '^\\$', '')) AS seg FROM s),
w AS (SELECT p_partkey, receiver, lower(seg) AS part, unnest(string_split(lower(trim({_SQL_WORDS})), ' ')) AS word FROM c)
SELECT p_partkey, receiver, bool_or(part IN ('db', 'conn', 'pool', 'client', 'pdo', 'link') OR word IN ('db', 'conn', 'pool', 'client', 'pdo', 'link') OR (length(word) > 2 AND ends_with(word, 'db'))) AS named FROM w GROUP BY 1, 2""")
def receiver_word_match(spark, sf: str) -> DataFrame:
    part = spark.read.parquet(f"{sf}/part.parquet")
    r = part.select("p_partkey", F.element_at(F.lit(_RECEIVERS), (F.col("p_partkey") % len(_RECEIVERS) + 1).cast("int")).alias("receiver"))
    return r.withColumn("named", rules.names_any(F.col("receiver"), ["db", "conn", "pool", "client", "pdo", "link"], ["db"]))


_LINES = f"SELECT {snippets._PATH} AS path, generate_subscripts(ls, 1) AS line_no, unnest(ls) AS line FROM (SELECT p_size, p_partkey, ext, string_split(replace(body, '{{k}}', CAST(p_partkey AS VARCHAR)), chr(10)) AS ls FROM part JOIN {snippets._sql(*((k, s.ext, s.content) for k, s in enumerate(snippets.SNIPPETS)))} t(template, ext, body) ON p_partkey % {len(snippets.SNIPPETS)} = template)"


def _code_lines(spark, sf: str) -> DataFrame:
    files = snippets.files(spark, sf)
    return files.select("path", F.posexplode(F.split("content", "\n")).alias("_n", "line")).select("path", (F.col("_n") + 1).cast("long").alias("line_no"), "line")


_SQL_STRIP = "regexp_replace(line, '" + text_rules.LITERAL.replace("'", "''") + "', '\uffff', 'g')"


@_query(f"SELECT path, line_no, {_SQL_STRIP} AS stripped, regexp_matches({_SQL_STRIP}, '[\\p{{L}}\\p{{N}}_$]') AS dynamic FROM ({_LINES}) WHERE contains(line, '+')")
def literal_strip_dynamic_concat(spark, sf: str) -> DataFrame:
    plus = _code_lines(spark, sf).where(F.col("line").contains("+"))
    return plus.select("path", "line_no", text_rules.strip_literals(F.col("line")).alias("stripped"), text_rules.has_dynamic_part(F.col("line")).alias("dynamic"))


_SQL_CASE = "CASE " + " ".join("WHEN regexp_matches(line, '" + p.replace("'", "''") + "') THEN '" + n + "'" for p, n in text_rules.MISCONFIGURED) + " END"


@_query(f"SELECT path, line_no, {_SQL_CASE} AS misconfiguration FROM ({_LINES}) WHERE {_SQL_CASE} IS NOT NULL")
def misconfig_first_pattern(spark, sf: str) -> DataFrame:
    return _code_lines(spark, sf).select("path", "line_no", text_rules.misconfiguration(F.col("line")).alias("misconfiguration")).where("misconfiguration is not null")


@_query(f"SELECT path, line_no FROM ({_LINES}) WHERE regexp_matches(line, '{text_rules.SLOW_PATTERN}')")
def redos_scan(spark, sf: str) -> DataFrame:
    return _code_lines(spark, sf).where(F.col("line").rlike(text_rules.SLOW_PATTERN)).select("path", "line_no")


YAML_RULES = [
    {"id": "X-001", "name": "Shell", "severity": "high", "category": "injection", "languages": ["python", "java"], "description": "-", "patterns": [{"function": {"match": ["system", "exec"], "on": ["os", "untime"]}, "arguments": [{"type": "string_concat", "hasExpressions": True}]}], "exclude": [{"function": {"match": ["exec"], "on": ["getRuntime"]}, "hasExpressions": False}]},
    {"id": "X-002", "name": "Template", "severity": "low", "category": "data", "languages": ["javascript"], "description": "-", "patterns": [{"type": "template_string", "hasExpressions": True}]},
]
_X = [(8, "X-001", 5), (0, "X-002", 3), (15, "X-001", 4), (19, "X-001", 5), (19, "X-001", 7), (19, "X-001", 8), (20, "X-002", 6)]


@_query(f"SELECT {snippets._PATH} AS path, rule_id, CAST(line AS BIGINT) AS line FROM {snippets._PARTS} JOIN {snippets._sql(*_X)} x(x_template, rule_id, line) ON x_template = template")
def yaml_rule_scan(spark, sf: str) -> DataFrame:
    custom = custom_rules.compile_rules([custom_rules.validate(d, "-") for d in YAML_RULES])
    return scan.findings(snippets.files(spark, sf), scan.Options(preset="none", custom=custom, directive=None)).select("path", "rule_id", "line")


#: Rules of the query below.
MANY = 5000


def many_rules() -> list[dict]:
    """Rules M-k: calls of fn{k}; with even k those that are given a concatenation, with k of fives none on what is named own; and ten that tell by the receiver alone."""
    some = []
    for k in range(MANY):
        pattern = {"function": {"match": [f"fn{k}", f"other{k}"]}} | ({"arguments": [{"type": "string_concat"}]} if k % 2 == 0 else {})
        if k % 500 == 7:
            pattern = {"function": {"on": [f"box{k}_"]}}
        some.append({"id": f"M-{k}", "name": "-", "severity": "low", "category": "data", "languages": ["python"], "description": "-", "patterns": [pattern]} | ({"exclude": [{"function": {"on": ["own"]}}]} if k % 5 == 0 else {}))
    return some


@_query(f"""WITH c AS (SELECT p_partkey, 'r' || p_partkey || '.py' AS path, unnest([1, 2, 3, 4]) AS line FROM part),
f AS (SELECT path, line, CASE line WHEN 1 THEN p_partkey % {MANY} WHEN 2 THEN p_partkey * 3 % {MANY} WHEN 3 THEN p_partkey * 7 % {MANY} ELSE p_partkey * 11 % {MANY} END AS k,
  line IN (1, 3) AS joined, CASE WHEN line = 3 THEN 'myown' WHEN line = 4 THEN 'box' || (p_partkey % 5000) || '_' END AS receiver, p_partkey % {MANY} AS b FROM c)
SELECT path, 'M-' || k AS rule_id, CAST(line AS BIGINT) AS line FROM f WHERE k % 500 <> 7 AND (k % 2 = 1 OR joined) AND NOT (k % 5 = 0 AND coalesce(contains(receiver, 'own'), false))
UNION ALL SELECT path, 'M-' || b, CAST(line AS BIGINT) FROM f WHERE line = 4 AND b % 500 = 7""")
def many_rules_scan(spark, sf: str) -> DataFrame:
    """MANY rules at once over a file of calls for each part."""
    p = F.col("p_partkey")
    name = lambda n: F.concat(F.lit("fn"), (p * n % MANY).cast("string"))
    text = F.concat(name(1), F.lit("('a' + x)\n"), name(3), F.lit("('b')\nmyown."), name(7), F.lit("(x + 'c')\nbox"), (p % MANY).cast("string"), F.lit("_."), name(11), F.lit("(y)\n"))
    part = spark.read.parquet(f"{sf}/part.parquet").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "p_partkey")
    files = part.select(F.concat(F.lit("r"), p.cast("string"), F.lit(".py")).alias("path"), F.lit("python").alias("lang"), text.alias("content"))
    docs = [custom_rules.validate(d, "-") for d in many_rules()]
    return scan.findings(files, scan.Options(preset="none", documents=docs, directive=None)).select("path", "rule_id", "line")


_CALLS = [(k, line, name, obj, len(args)) for k, calls in snippets.CALLS.items() for line, name, obj, *args in calls]


@_query(f"SELECT {snippets._PATH} AS path, CAST(line AS INTEGER) AS line, name, object, CAST(n AS INTEGER) AS n_args FROM {snippets._PARTS} JOIN {snippets._sql(*_CALLS)} x(x_template, line, name, object, n) ON x_template = template")
def call_info_extract(spark, sf: str) -> DataFrame:
    """Receiver, name and number of arguments of every call."""
    calls = parse.nodes(snippets.files(spark, sf)).where("kind = 'function_call'")
    return calls.select("path", F.col("sl").alias("line"), "name", "object", F.size("args").alias("n_args"))


_ARGS = [(k, line, pos, arg) for k, calls in snippets.CALLS.items() for line, _, _, *args in calls for pos, arg in enumerate(args)]


@_query(f"SELECT {snippets._PATH} AS path, CAST(line AS INTEGER) AS line, CAST(pos AS INTEGER) AS pos, replace(arg, '{{k}}', CAST(p_partkey AS VARCHAR)) AS arg FROM {snippets._PARTS} JOIN {snippets._sql(*_ARGS)} x(x_template, line, pos, arg) ON x_template = template")
def split_top_level_args(spark, sf: str) -> DataFrame:
    calls = parse.nodes(snippets.files(spark, sf)).where("kind = 'function_call'")
    return calls.select("path", F.col("sl").alias("line"), F.posexplode("args").alias("pos", "arg"))


@_query(snippets.expected("findings", "rule_id, line", "rule_id, CAST(line AS INTEGER) AS line").replace("SELECT", "SELECT * FROM (SELECT", 1) + ") WHERE rule_id = 'CG-031'")
def assigned_from_lookup(spark, sf: str) -> DataFrame:
    """File access whose argument is, or was assigned from, user input."""
    hits = rules.match(parse.nodes(snippets.files(spark, sf)), [r for r in rules.load() if r.id == "CG-031"])
    return hits.select("path", "rule_id", F.col("sl").alias("line"))


_DIFF = "diff --git a/x b/x\n--- a/f{k}.py\n+++ b/f{k}.py\t2024\n@@ -1,3 +1,4 @@\n a\n-b\n+++ c\n+d\n e\n@@ -9 +11,2 @@\n-x\n+y\n+z\n--- a/gone\n+++ /dev/null\n@@ -1 +0,0 @@\n-q\n"


@_query("SELECT p_partkey, 'f' || p_partkey || '.py' AS file, unnest([2, 3, 11, 12]) :: BIGINT AS line FROM part")
def unified_diff_parse(spark, sf: str) -> DataFrame:
    """Added lines of diffs whose bodies hold lines that look like heads."""
    part = spark.read.parquet(f"{sf}/part.parquet")
    return diffs.changed_lines(part.select("p_partkey", F.replace(F.lit(_DIFF), F.lit("{k}"), F.col("p_partkey").cast("string")).alias("diff")), "p_partkey")


@_query("""SELECT l_returnflag AS diff, 's' || l_suppkey || '.py' AS file, l_partkey + unnest(range(1, 2 + q % 3)) AS line FROM (SELECT l_returnflag, min(l_suppkey) AS l_suppkey, l_partkey, l_orderkey, l_linenumber, CAST(floor(l_quantity) AS BIGINT) AS q FROM lineitem GROUP BY ALL)""")
def long_diffs_parse(spark, sf: str) -> DataFrame:
    """Three diffs, one for each return flag, with a hunk for each line item: added lines of diffs that no task could hold."""
    items = spark.read.parquet(f"{sf}/lineitem.parquet").withColumn("q", F.floor("l_quantity"))
    n = items.count()
    li = dealt(items.select("l_returnflag", "l_partkey", "l_orderkey", "l_linenumber", "q", "l_suppkey"), "l_orderkey", rows=n).groupBy("l_returnflag", "l_partkey", "l_orderkey", "l_linenumber", "q").agg(F.min("l_suppkey").alias("l_suppkey"))
    text, more = lambda *x: F.concat(*[F.lit(v) if isinstance(v, str) else v.cast("string") for v in x]), (F.col("q") % 3).cast("int")
    body = F.transform(F.sequence(F.lit(0), more), lambda i: F.when(i == 0, "+++ b/no.py").otherwise("+new"))
    hunk = F.concat(F.array(text("+++ b/s", F.col("l_suppkey"), ".py"), text("@@ -1 +", F.col("l_partkey"), ",", more + 2, " @@"), F.lit(" same")), body)
    place = (F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 1_000_000_000 + F.col("l_partkey") * 100 + F.col("q")
    lined = li.select(F.col("l_returnflag").alias("diff"), place.alias("place"), F.posexplode(hunk).alias("at", "line"))
    return diffs.added_lines(lined.select("diff", (F.col("place") * 10 + F.col("at")).alias("line_no"), "line"), "diff", n * 6)  # six lines an item at most


_VERDICT = "('0x' || substr(sha256(path || rule_id || line), 1, 1))::INTEGER"


@_query(f"SELECT path, rule_id, CAST(line AS BIGINT) AS line, CASE WHEN {_VERDICT} < 2 THEN 'kept' WHEN {_VERDICT} < 9 THEN 'confirmed' ELSE 'dismissed' END AS outcome FROM ({_LABELS})")
def verdict_partition(spark, sf: str) -> DataFrame:
    """Outcomes under a stub model that decides by a digest and sometimes fails."""
    return _reviewed(spark, sf).select("path", "rule_id", "line", "outcome")


def _stub(prompt: str) -> str:
    """A model that decides by a digest and sometimes fails."""
    import hashlib

    n = int(hashlib.sha256(prompt.encode()).hexdigest()[0], 16)
    return "no json" if n < 2 else '{"confirmed": %s, "confidence": 2, "reasoning": "stub"}' % ("true" if n < 9 else "false")


def _reviewed(spark, sf: str, selected=None) -> DataFrame:
    found = _found(spark, sf).select("path", "rule_id", "line").withColumn("prompt", F.concat("path", "rule_id", F.col("line").cast("string")))
    return review.run(found.withColumn("key_hash", enrich.cache_key(F.col("prompt"))), _stub, ["path", "line", "rule_id"], selected=selected)


@_query(f"""SELECT count(*) AS total, count(*) FILTER (s) AS reviewed, count(*) FILTER (s AND v < 9) AS confirmed, count(*) FILTER (s AND v >= 9) AS dismissed, count(*) FILTER (NOT s) AS rule_only
FROM (SELECT rule_id IN ('CG-001', 'CG-002', 'CG-031') AS s, {_VERDICT} AS v FROM ({_LABELS}))""")
def dual_channel_stats(spark, sf: str) -> DataFrame:
    """The model is asked about the selected rules' matches only."""
    picked = F.col("rule_id").isin("CG-001", "CG-002", "CG-031")
    return enrich.channel_stats(_reviewed(spark, sf, picked), picked)


def queries() -> dict:
    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    return dict(_O)
