"""Taint paths and call edges of source files: one pass over files, each analysed alone on its executor."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillscan.functions import flow, lexer
from quillscan.operators import relations
from quillscan.operators.parse import tabled

PATHS = (
    "path string, function string, source_line int, source string, sink_line int, sink string, variable string, severity string,"
    " steps array<struct<kind string, name string, line int>>, calls array<struct<caller string, callee string, line int>>, lang string, error string"
)


def _paths(files: DataFrame, cross: bool) -> DataFrame:
    find = flow.cross_flows if cross else flow.local_flows
    names = ["function", "source_line", "source", "sink_line", "sink", "variable", "severity", "steps", "calls"]

    def read(path: str, lang: str, content: str) -> Iterator[tuple]:
        for found in find(content or "", lang):
            yield path, *(found[n] for n in names), lang, None

    return tabled(files.where(F.col("lang").isin(*flow.LANGUAGES)), PATHS, read, lambda path, lang, error: (path, *[None] * 9, lang, error))


def failed(paths: DataFrame) -> DataFrame:
    """path and reason of files that couldn't be analysed."""
    return paths.where("error is not null").select("path", F.col("error").alias("reason"))


def local_paths(files: DataFrame) -> DataFrame:
    """Paths within single functions."""
    return _paths(files, False).where("error is null")


def cross_paths(files: DataFrame) -> DataFrame:
    """Paths along calls of a file's own functions; size(calls) tells how many."""
    return _paths(files, True).where("error is null")


def call_edges(files: DataFrame) -> DataFrame:
    """path, caller, callee, line: calls between functions of a file, and ord, their place in it by line, caller and callee.

    Sorting by path and ord gives edges in the order of the text.
    """

    def read(path: str, lang: str, content: str) -> Iterator[tuple]:
        for k, (caller, callee, line) in enumerate(sorted(flow.edges(content or "", lang), key=lambda e: (e[2], e[0], e[1]))):
            yield path, caller, callee, line, k, None

    rows = tabled(files.where(F.col("lang").isin(*flow.LANGUAGES)), "path string, caller string, callee string, line long, ord long, error string", read, lambda path, lang, error: (path, *[None] * 4, error))
    return rows.where("error is null").drop("error")


#: Rules over flows: id, severity (null: that of the sink) and confidence.
FLOW_RULES = {"local": ("TF-001", None, 0.9), "flow": ("TF-001", "high", 0.85), "cross": ("TF-002", "critical", 0.92), "near": ("TF-003", "medium", 0.5)}


def rendered(kind: Column, name: Column, line: Column) -> Column:
    """A step as text."""
    return F.concat(kind, F.lit(" "), name, F.lit(" at line "), line.cast("string"))


def _finding(rows: DataFrame, kind: str, severity: Column, title: Column, description: Column, line: Column, evidence: Column, tags: list[str]) -> DataFrame:
    rule, fixed, confidence = FLOW_RULES[kind]
    id_ = F.concat(F.lit("code-"), F.substring("lang", 1, 2), F.lit("-"), F.substring(F.sha2(F.concat_ws("\0", "path", F.lit(rule), line.cast("string"), title), 256), 1, 12))
    tagged = F.sort_array(F.array(*map(F.lit, tags), "lang"))
    return rows.select(
        id_.alias("id"), F.lit(rule).alias("rule_id"), (F.lit(fixed) if fixed else severity).alias("severity"), F.lit(confidence).alias("confidence"), title.alias("title"), description.alias("description"),
        F.col("path").alias("file"), line.cast("long").alias("line"), evidence.alias("evidence"), tagged.alias("tags"), F.col("lang"),
    )


def _steps() -> Column:
    return F.transform("steps", lambda s: rendered(s["kind"], s["name"], s["line"]))


def place_of_path(sink_line: Column, steps: Column) -> Column:
    """A path's line: that of its sink, else of its last step, else 1."""
    return F.coalesce(sink_line, F.try_element_at(F.filter(F.transform(steps, lambda s: s["line"]), lambda x: x.isNotNull()), F.lit(-1)), F.lit(1))


def local_findings(files: DataFrame) -> DataFrame:
    """A finding for each path within a function; critical where the sink runs code or commands."""
    rows = local_paths(files).withColumn("line", place_of_path(F.col("sink_line"), F.col("steps")))
    text = F.concat(F.lit("User-controlled value "), "variable", F.lit(" flows from "), "source", F.lit(" to "), "sink", F.lit("."))
    return _finding(rows, "local", F.col("severity"), F.concat(F.lit("Tainted data reaches "), "sink"), text, F.col("line"), _steps(), ["taint"])


def flow_findings(paths: DataFrame) -> DataFrame:
    """A finding for each given path, as one fact: always high, the path itself as its evidence."""
    rows = paths.withColumn("line", place_of_path(F.col("sink_line"), F.col("steps")))
    fact = F.to_json(F.struct("function", "source_line", "source", "sink_line", "sink", "variable", "steps"))
    return _finding(rows, "flow", F.lit("high"), F.concat(F.lit("Taint flow in "), "path"), F.lit(""), F.col("line"), F.array(fact), ["taint"])


def cross_findings(files: DataFrame) -> DataFrame:
    """A finding for each path that crosses at least one call; its evidence is the steps and the calls."""
    rows = cross_paths(files).where(F.size("calls") > 0).withColumn("line", place_of_path(F.col("sink_line"), F.col("steps")))
    calls = F.transform("calls", lambda c: F.concat(F.lit("call "), c["caller"], F.lit(" -> "), c["callee"], F.lit(" at line "), c["line"].cast("string")))
    text = F.concat("variable", F.lit(" crosses "), F.size("calls").cast("string"), F.lit(" calls before it reaches "), "sink", F.lit("."))
    return _finding(rows, "cross", F.lit("critical"), F.concat(F.lit("Cross-function taint reaches "), "sink"), text, F.col("line"), F.concat(_steps(), calls), ["dataflow", "taint"])


def near_findings(files: DataFrame) -> DataFrame:
    """A finding for each dangerous line with input at or above it; by lines alone."""
    rows = nearest_sources(files).join(files.select("path", "lang"), "path")
    evidence = F.array(rendered(F.lit("source"), F.lit("input"), F.col("source_line")), rendered(F.lit("sink"), F.lit("call"), F.col("sink_line")))
    return _finding(rows, "near", F.lit("medium"), F.lit("Input near a dangerous call"), F.lit("Lines alone tell of it; no flow is proven."), F.col("sink_line"), evidence, ["heuristic"])


#: What reads input and what is dangerous, by lines alone.
SOURCE_LINE = r"(?i)\b(?:argv|cin|FormValue|getParameter|getline|input)\b|(?:req|request)\.(?:body|params|query)"
SINK_LINE = r"(?i)\b(?:Command|eval|exec|execute|executeQuery|popen|query|system)\s*\("


def nearest_sources(files: DataFrame) -> DataFrame:
    """path, sink_line, source_line: for each dangerous line the nearest input at or above it, in its function or outside any.

    By lines with literals and comments blanked; no proof of a flow. One row a line and file is kept with its
    innermost function, and an as-of window does the rest: no join of sources with sinks.
    """

    def read(path: str, lang: str, content: str) -> Iterator[tuple]:
        src = lexer.Source(content or "", lang)
        rows = lexer.masked(content or "", lang).split("\n")
        inner = [(0, -1)] * len(rows)  # start line and number of the innermost function of each line
        for k, (_, _, a, b) in enumerate(src.functions()):
            first = src.place(a)[0]
            for n in range(first - 1, min(src.place(b)[0], len(rows))):
                inner[n] = max(inner[n], (first, k))
        for n, line in enumerate(rows):
            yield path, n + 1, line, inner[n][1], None

    lined = tabled(files, "path string, line_no long, line string, scope int, error string", read, lambda path, lang, error: (path, 0, "", -1, error)).where("error is null")
    source = F.col("line").rlike(SOURCE_LINE)
    own = relations.latest_before(lined, "_key", ["line_no"], source, F.col("line_no"))
    module = relations.latest_before(lined, "path", ["line_no"], source & (F.col("scope") < 0), F.col("line_no"))
    keyed = lined.where(source | F.col("line").rlike(SINK_LINE)).withColumn("_key", F.struct("path", "scope"))
    near = keyed.withColumn("_own", own).withColumn("_module", module).where(F.col("line").rlike(SINK_LINE))
    return near.select("path", F.col("line_no").alias("sink_line"), F.greatest("_own", "_module").alias("source_line")).where("source_line is not null")
