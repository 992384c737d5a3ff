"""Queries over what a scan makes of its matches: counters, numbers, report rows, findings of flows, reviews, chosen files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillscan.operators import review, taint
from quillscan.plans import report, scan
from quillscan.plans.code_queries import _LABELS, _META, _found
from quillscan.sources import discovery, snippets
from quillscan.sources.shared import saved

_Q, _O = {}, {}


def _query(sql: str):
    def add(f):
        _Q[f.__name__], _O[f.__name__] = f, sql
        return f

    return add


_N = len(snippets.SNIPPETS)
_EVEN = f"SELECT count(*) FROM ({_LABELS}) WHERE CAST(regexp_extract(path, '/f([0-9]+)', 1) AS BIGINT) % 2 = 0"
_SHUT = f"2 * (SELECT count(*) FROM part WHERE p_partkey % {_N} = 19)"


@_query(f"""SELECT n + {_SHUT} AS candidates, {_SHUT} AS suppressed, n AS suspicious, ({_EVEN}) AS baselined, 0::BIGINT AS diff_filtered, n - ({_EVEN}) AS findings FROM (SELECT count(*) AS n FROM ({_LABELS}))""")
def scan_counters(spark, sf: str) -> DataFrame:
    """What each filter leaves, with a baseline that knows the findings of every second file."""
    files, options = snippets.files(spark, sf), scan.Options(directive=snippets.DIRECTIVE)
    found = saved(scan.candidates(files, options, counted=True), "candidates")
    known = scan.stages(files, options, found)["findings"].where("cast(regexp_extract(path, '/f([0-9]+)', 1) as long) % 2 = 0")
    options.baseline = report.baseline(known)
    counts = scan.Counts()
    return scan.counters(files, scan.stages(files, options, found, counts), counts=counts).select("candidates", "suppressed", "suspicious", "baselined", "diff_filtered", "findings")


@_query(f"SELECT path, rule_id, CAST(line AS BIGINT) AS line, row_number() OVER (ORDER BY path, line, rule_id) AS finding_no FROM ({_LABELS})")
def finding_numbers(spark, sf: str) -> DataFrame:
    """Numbers of findings over the whole report, by a prefix sum over ranges."""
    return scan.numbered(_found(spark, sf), whole=True).select("path", "rule_id", "line", F.col("finding_no").cast("long").alias("finding_no"))


@_query(f"""SELECT path AS file, CAST(line AS BIGINT) AS line, rule_id, 'CWE-' || cwe AS cwe, 'https://cwe.mitre.org/data/definitions/' || cwe || '.html' AS cwe_uri, severity, name AS title,
name || ' in ' || path || ' at line ' || line || '.' AS description, true AS unfixed, CAST(line AS INTEGER) AS start_line FROM ({_LABELS}) JOIN {_META} USING (rule_id)""")
def json_report_rows(spark, sf: str) -> DataFrame:
    rows = report.json_findings(_found(spark, sf))
    return rows.select("file", "line", "rule_id", "cwe", "cwe_uri", "severity", "title", "description", (F.col("fix").isNull() & F.col("review").isNull()).alias("unfixed"), F.col("location.start.line").alias("start_line"))


@_query(f"""SELECT count(*) || ' findings (' || concat_ws(', ', CASE WHEN c > 0 THEN c || ' critical' END, CASE WHEN h > 0 THEN h || ' high' END, CASE WHEN m > 0 THEN m || ' medium' END, CASE WHEN l > 0 THEN l || ' low' END) || ')' AS summary
FROM (SELECT *, count(*) FILTER (severity = 'critical') OVER () AS c, count(*) FILTER (severity = 'high') OVER () AS h, count(*) FILTER (severity = 'medium') OVER () AS m, count(*) FILTER (severity = 'low') OVER () AS l FROM ({_LABELS}) JOIN {_META} USING (rule_id)) GROUP BY c, h, m, l""")
def report_summary(spark, sf: str) -> DataFrame:
    return report.summary_line(_found(spark, sf))


_SPANS = [(k, f, c) for k, (f, c) in snippets.SPANS.items()]


@_query(f"""WITH f AS (SELECT {snippets._PATH} AS path, CASE ext WHEN '.js' THEN 'javascript' WHEN '.ts' THEN 'typescript' WHEN '.py' THEN 'python' ELSE substr(ext, 2) END AS lang, functions, classes
FROM {snippets._PARTS} JOIN {snippets._sql(*_SPANS)} x(x_template, functions, classes) ON x_template = template)
SELECT CAST(count(*) AS BIGINT) AS files, CAST(sum(functions) AS BIGINT) AS functions, CAST(sum(classes) AS BIGINT) AS classes, (SELECT string_agg(lang, ',' ORDER BY first) FROM (SELECT lang, min(lower(path)) AS first FROM f GROUP BY lang)) AS languages FROM f""")
def scan_summary(spark, sf: str) -> DataFrame:
    """Files, functions, classes, and languages in the order of first sight."""
    return scan.summary(snippets.files(spark, sf)).withColumn("languages", F.array_join("languages", ","))


@_query(snippets.expected("flows", "a, b, sink", "'TF-001' AS rule_id, CASE WHEN regexp_matches(lower(sink), 'eval|exec|system|popen|command') THEN 'critical' ELSE 'high' END AS severity, 0.9::DOUBLE AS confidence, 'Tainted data reaches ' || sink AS title, CAST(b AS BIGINT) AS line"))
def taint_findings(spark, sf: str) -> DataFrame:
    return taint.local_findings(snippets.files(spark, sf)).select(F.col("file").alias("path"), "rule_id", "severity", "confidence", "title", "line")


@_query(snippets.expected("flows", "a, b, sink", "'TF-001' AS rule_id, 'high' AS severity, 0.85::DOUBLE AS confidence, CAST(b AS BIGINT) AS line, 1::INTEGER AS facts"))
def flow_findings(spark, sf: str) -> DataFrame:
    """Given paths as findings of one fact each."""
    return taint.flow_findings(taint.local_paths(snippets.files(spark, sf))).select(F.col("file").alias("path"), "rule_id", "severity", "confidence", "line", F.size("evidence").alias("facts"))


@_query("SELECT path, rule_id, severity, confidence, line, calls FROM (" + snippets.expected("chains", "a, b, n", "'TF-002' AS rule_id, 'critical' AS severity, 0.92::DOUBLE AS confidence, CAST(b AS BIGINT) AS line, CAST(n AS INTEGER) AS calls") + ") WHERE calls > 0")
def cross_findings(spark, sf: str) -> DataFrame:
    """Only paths that cross a call; how many calls their evidence names."""
    rows = taint.cross_findings(snippets.files(spark, sf))
    return rows.select(F.col("file").alias("path"), "rule_id", "severity", "confidence", "line", F.size(F.filter("evidence", lambda e: e.startswith("call "))).alias("calls"))


@_query(snippets.expected("pairs", "a, b", "'TF-003' AS rule_id, 'medium' AS severity, 0.5::DOUBLE AS confidence, CAST(b AS BIGINT) AS line"))
def near_findings(spark, sf: str) -> DataFrame:
    return taint.near_findings(snippets.files(spark, sf)).select(F.col("file").alias("path"), "rule_id", "severity", "confidence", "line")


_DIGIT = "('0x' || substr(sha256(path || rule_id || line), 1, 1))::INTEGER"


@_query(f"""WITH v AS (SELECT {_DIGIT} AS d FROM ({_LABELS}))
SELECT count(*) FILTER (d >= 4) AS llm_calls, round(sum(CASE WHEN d >= 4 THEN round((1000 + 10 * d) / 1e6::DOUBLE * 3 + 100 / 1e6::DOUBLE * 15, 6) END), 6) AS cost, count(*) FILTER (d < 4) AS cache_hits,
count(*) FILTER (d < 4 OR d BETWEEN 6 AND 10) AS confirmed, count(*) FILTER (d > 10) AS dismissed, count(*) FILTER (d BETWEEN 4 AND 5) AS kept FROM v""")
def review_costs(spark, sf: str) -> DataFrame:
    """Calls, cost and cache hits of a review whose cache knows a quarter of the keys and whose model fails on some."""

    def ask(prompt: str) -> review.Reply:
        import hashlib

        n = int(hashlib.sha256(prompt.encode()).hexdigest()[0], 16)
        text = "down" if n < 6 else '{"confirmed": %s, "confidence": "0.75", "reasoning": "stub"}' % ("true" if n <= 10 else "false")
        return review.Reply(text, 1000 + 10 * n, 100, "claude-sonnet-x")

    found = _found(spark, sf).select("path", "rule_id", "line").withColumn("prompt", F.concat("path", "rule_id", F.col("line").cast("string")))
    found = saved(found.withColumn("key_hash", F.sha2("prompt", 256)), "found")  # the cache is made of it too: files are scanned once
    known = found.where("conv(substring(key_hash, 1, 1), 16, 10) < 4").select("key_hash")
    store = known.withColumns({"confirmed": F.lit(True), "verdict_confidence": F.lit(0.9), "reasoning": F.lit("known"), "fix_description": F.lit(None).cast("string"), "fix_code": F.lit(None).cast("string"), "tokens_in": F.lit(1).cast("long"), "tokens_out": F.lit(1).cast("long"), "cached_at": F.lit(1000).cast("long"), "schema_version": F.lit(review.VERSION)})
    rows = saved(review.run(found, ask, ["path", "line", "rule_id"], model="claude-sonnet-x", store=store, now_ms=2000), "reviewed")
    outcomes = rows.agg(*[F.count_if(F.col("outcome") == x).alias(x) for x in ("confirmed", "dismissed", "kept")])
    return review.costs(rows).join(F.broadcast(outcomes))  # one row each


_NAMES = ["src/m{k}.py", "a/node_modules/b{k}.js", ".hidden/c{k}.py", "src/d{k}.test.ts", "lib/e{k}.min.js", "src/F{k}.PY", "dist/g{k}.go", "src/deep/er/h{k}.java", "src/i{k}.rb", "src/.j{k}.py", "web/k{k}.tsx", "web/l{k}.php"]


def _names(spark, sf: str) -> DataFrame:
    part = spark.read.parquet(f"{sf}/part.parquet")
    name = F.element_at(F.lit(_NAMES), (F.col("p_partkey") % len(_NAMES) + 1).cast("int"))
    return part.select(F.replace(name, F.lit("{k}"), F.col("p_partkey").cast("string")).alias("path"), "p_partkey")


def _sql_names(*kept: tuple[int, str]) -> str:
    rows = snippets._sql(*((n, _NAMES[n], lang) for n, lang in kept))
    return f"SELECT replace(name, '{{k}}', CAST(p_partkey AS VARCHAR)) AS path, lang FROM part JOIN {rows} x(n, name, lang) ON p_partkey % {len(_NAMES)} = n"


@_query(_sql_names((0, "python"), (7, "java"), (11, "php")))
def file_selection(spark, sf: str) -> DataFrame:
    """Files that the default globs take and no exclusion drops."""
    return discovery.chosen(_names(spark, sf), discovery.INCLUDE, discovery.EXCLUDE).select("path", "lang")


@_query(_sql_names((0, "python"), (2, "python"), (3, "typescript"), (5, "python"), (9, "python"), (10, "typescript")) + " WHERE p_size % 5 <> 0")
def file_selection_by_list(spark, sf: str) -> DataFrame:
    """Python and TypeScript files of a given list, in any case of their extensions."""
    part = spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", "p_size")
    names = _names(spark, sf)
    only = names.join(part.where("p_size % 5 <> 0"), "p_partkey", "left_semi").select(F.translate("path", "/", "\\").alias("path"))
    return discovery.chosen(names, exclude=["node_modules", "dist"], languages=["py", "TS"], only=only, any_case=True, dotted=True).select("path", "lang")


@_query("""WITH c AS (SELECT p_partkey AS k, CASE p_partkey % 5 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE 'F' || p_partkey END AS id, CASE p_partkey % 4 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'low' WHEN 2 THEN NULL ELSE 'odd' END AS severity,
CASE WHEN p_partkey % 6 <> 0 THEN (p_partkey % 10) / 10.0 END AS confidence, CASE WHEN p_partkey % 11 <> 0 THEN 'title' END AS title, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE 'text' END AS description,
CASE WHEN p_partkey % 2 = 1 THEN 'story' END AS narrative, CASE WHEN p_partkey % 3 <> 1 THEN 'h/' || p_partkey END AS host, CASE p_partkey % 3 WHEN 1 THEN '' WHEN 2 THEN 'R1' END AS rule_id,
CASE p_partkey % 4 WHEN 0 THEN 'a/b.py' WHEN 1 THEN '' END AS relative_path, p_partkey % 7 - 2 AS line, p_partkey % 5 AS end_line FROM part)
SELECT k, coalesce(nullif(rule_id, ''), nullif(id, ''), 'unknown-rule') AS rule_id, CASE lower(coalesce(severity, 'medium')) WHEN 'high' THEN 'error' WHEN 'low' THEN 'note' ELSE 'warning' END AS level,
coalesce(narrative, nullif(description, ''), title, 'Finding') AS message, coalesce(nullif(relative_path, ''), host, 'unknown') AS file, CASE WHEN line > 0 THEN line ELSE 1 END AS start_line, 1::BIGINT AS start_column,
CASE WHEN end_line > 0 THEN end_line WHEN line > 0 THEN line ELSE 1 END AS end_line, coalesce(confidence, 0.5)::DOUBLE AS confidence, coalesce(id, '') AS finding_id FROM c""")
def contract_sarif_rows(spark, sf: str) -> DataFrame:
    """Report rows of findings of other tools, whose fields may be null, empty or odd."""
    k = F.col("p_partkey")
    key = k.cast("string")
    rows = spark.read.parquet(f"{sf}/part.parquet").select(
        k, F.when(k % 5 == 1, "").when(k % 5 > 1, F.concat(F.lit("F"), key)).alias("id"), F.when(k % 4 == 0, "HIGH").when(k % 4 == 1, "low").when(k % 4 == 3, "odd").alias("severity"), F.when(k % 6 != 0, (k % 10) / 10).alias("confidence"),
        F.when(k % 11 != 0, "title").alias("title"), F.when(k % 3 == 0, "").otherwise("text").alias("description"), F.when(k % 2 == 1, "story").alias("narrative"), F.when(k % 3 != 1, F.concat(F.lit("h/"), key)).alias("host"), F.lit(None).cast("string").alias("cve"),
        F.when(k % 3 == 1, "").when(k % 3 == 2, "R1").alias("rule_id"), F.when(k % 4 == 0, "a\\b.py").when(k % 4 == 1, "").alias("relative_path"), (k % 7 - 2).alias("line"), F.lit(None).cast("long").alias("column"), (k % 5).alias("end_line"), F.lit(0).cast("long").alias("end_column"),
    )
    out = report.contract_results(rows, "p_partkey")
    return out.select(F.col("p_partkey").alias("k"), "rule_id", "level", "message", "file", "start_line", F.col("start_column").cast("long").alias("start_column"), "end_line", "confidence", "finding_id")


def queries() -> dict:
    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    return dict(_O)
