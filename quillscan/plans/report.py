"""Reports: rows of SARIF, JSON, text and review output, built as columns."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Report level and score of each severity.
LEVEL = {"critical": "error", "high": "error", "medium": "warning", "low": "note"}
SCORE = {"critical": "9.0", "high": "7.0", "medium": "4.0", "low": "2.0"}


def of(table: dict[str, str], key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


#: What a finding may hold beside its match; null where a plan didn't add it.
OPTIONAL = {"description": "string", "fix_description": "string", "fix_code": "string", "confirmed": "boolean", "verdict_confidence": "double", "reasoning": "string"}


def detailed(found: DataFrame) -> DataFrame:
    """Findings with every column that reports show: a description, the weakness's label and address, and null for what no second stage added."""
    for name, kind in OPTIONAL.items():
        if name not in found.columns:
            found = found.withColumn(name, F.lit(None).cast(kind))
    cwe = F.col("cwe").cast("string")
    known = F.col("cwe") > 0
    said = F.concat("rule_name", F.lit(" in "), "file", F.lit(" at line "), F.col("line").cast("string"), F.lit("."))
    return found.withColumns({"description": F.coalesce("description", said), "cwe_label": F.when(known, F.concat(F.lit("CWE-"), cwe)), "cwe_uri": F.when(known, F.concat(F.lit("https://cwe.mitre.org/data/definitions/"), cwe, F.lit(".html")))})


def ordered(found: DataFrame) -> DataFrame:
    """Findings by file, line, rule and place; a sort that Spark distributes."""
    return found.orderBy("file", "line", "rule_id", "ord")


def percent(share: Column) -> Column:
    return F.concat(F.round(share * 100).cast("int").cast("string"), F.lit("%"))


def sarif_rules(found: DataFrame) -> DataFrame:
    """A descriptor for each rule that has findings, from its first one by file and place."""
    first = found.groupBy("rule_id").agg(F.min_by(F.struct("rule_name", "severity", "cwe"), F.struct("file", "line", "ord")).alias("r"), F.count("*").alias("findings"))
    cwe = F.col("r.cwe").cast("string")
    return first.select("rule_id", F.col("r.rule_name").alias("name"), of(LEVEL, F.col("r.severity")).alias("level"), of(SCORE, F.col("r.severity")).alias("score"), F.concat(F.lit("external/cwe/cwe-"), cwe).alias("tag"), F.concat(F.lit("https://cwe.mitre.org/data/definitions/"), cwe, F.lit(".html")).alias("help_uri"), "findings")


def sarif_results(found: DataFrame) -> DataFrame:
    """A result row for each finding; columns count from 1 here. markdown where a model has judged it, fix_* where it has a fix."""
    found = detailed(found)
    judged = F.concat(F.lit("**"), "rule_name", F.lit("**\n\n"), "description", F.lit("\n\nConfidence: "), percent(F.col("verdict_confidence")), F.lit("\n\n"), "reasoning")
    return found.select(
        "rule_id", of(LEVEL, F.col("severity")).alias("level"), F.regexp_replace("file", r"\\", "/").alias("file"), F.col("sl").alias("start_line"), (F.col("sc") + 1).alias("start_column"), F.col("el").alias("end_line"),
        (F.col("ec") + 1).alias("end_column"), "fingerprint", F.col("description").alias("message"), judged.alias("markdown"), F.col("text").alias("snippet"), "fix_description", "fix_code", "line", "ord",
    )


#: Version and schema of the report format.
SARIF_VERSION, SARIF_SCHEMA = "2.1.0", "https://json.schemastore.org/sarif-2.1.0.json"


#: What a document must hold, from its root down: a name, or a list's items.
SARIF_NEEDS = (("version", "$schema", "runs"), ("runs", "tool", "results"), ("runs", "tool", "driver", "name", "version"), ("runs", "results", "ruleId", "level", "message", "locations"))


def write_sarif(found: DataFrame, out, version: str = "1") -> None:
    """Writes one report document to a text stream: rules first, then results by file and place as they come from the cluster."""
    rules = [
        {"id": r["rule_id"], "name": re.sub(r"\s+", "", r["name"]), "shortDescription": {"text": r["name"]}, "defaultConfiguration": {"level": r["level"]}, **({"helpUri": r["help_uri"]} if not r["tag"].endswith("-0") else {}), "properties": {"tags": ["security", *([r["tag"]] if not r["tag"].endswith("-0") else [])], "security-severity": r["score"]}}
        for r in sarif_rules(found).orderBy("rule_id").collect()  # one row a rule
    ]
    _head(out, version, rules)
    for k, r in enumerate(sarif_results(found).orderBy("file", "line", "rule_id", "ord").toLocalIterator()):
        out.write((", " if k else "") + json.dumps(sarif_result(r.asDict())))
    out.write("]}]}\n")


def write_empty_sarif(out, version: str = "1") -> None:
    """A report of nothing, for a stage that didn't run."""
    _head(out, version, [])
    out.write("]}]}\n")


def _head(out, version: str, rules: list[dict]) -> None:
    driver = {"name": "quillscan", "version": version, "rules": rules}
    out.write('{"version": %s, "$schema": %s, "runs": [{"tool": {"driver": %s}, "results": [' % tuple(map(json.dumps, (SARIF_VERSION, SARIF_SCHEMA, driver))))


def sarif_result(r: dict) -> dict:
    region = {"startLine": r["start_line"], "startColumn": r["start_column"], "endLine": r["end_line"], "endColumn": r["end_column"], "snippet": {"text": r["snippet"]}}
    uri = {"uri": r["file"], "uriBaseId": "%SRCROOT%"}
    message = {"text": r["message"]} | ({"markdown": r["markdown"]} if r["markdown"] else {})
    row = {"ruleId": r["rule_id"], "level": r["level"], "message": message, "locations": [{"physicalLocation": {"artifactLocation": uri, "region": region}}], "partialFingerprints": {"primary": r["fingerprint"]}}
    if r["fix_code"]:
        change = {"deletedRegion": {"startLine": r["start_line"], "endLine": r["end_line"]}, "insertedContent": {"text": r["fix_code"]}}
        row["fixes"] = [{"description": {"text": r["fix_description"]}, "artifactChanges": [{"artifactLocation": {"uri": r["file"]}, "replacements": [change]}]}]
    return row


def check_sarif(document: dict) -> None:
    """Raises ValueError unless the document holds what a reader of it needs."""

    def at(part, path: tuple[str, ...], names: tuple[str, ...], where: str) -> None:
        if isinstance(part, list):
            for k, x in enumerate(part):
                at(x, path, names, f"{where}[{k}]")
        elif not isinstance(part, dict):
            raise ValueError(f"{where}: not an object")
        elif path:
            if path[0] not in part:
                raise ValueError(f"{where}.{path[0]}: missing")
            at(part[path[0]], path[1:], names, f"{where}.{path[0]}")
        elif odd := [n for n in names if n not in part]:
            raise ValueError(f"{where}: {', '.join(odd)} missing")

    at(document, (), SARIF_NEEDS[0], "document")
    if document["version"] != SARIF_VERSION or document["$schema"] != SARIF_SCHEMA:
        raise ValueError("document: another version or schema")
    if not isinstance(document["runs"], list) or not document["runs"]:
        raise ValueError("document.runs: empty")
    at(document, ("runs",), ("tool", "results"), "document")
    at(document, ("runs", "tool", "driver"), ("name", "version"), "document")
    at(document, ("runs", "results"), SARIF_NEEDS[3][2:], "document")


#: Report level of a contract finding's severity.
CONTRACT_LEVEL = {"critical": "error", "high": "error", "medium": "warning", "low": "note", "info": "note"}


def contract_results(rows: DataFrame, *keys: str) -> DataFrame:
    """Report rows of findings of other tools: id, severity, confidence, title, description, narrative, host, cve, rule_id, relative_path, line, column, end_line, end_column, any of them null or empty. keys are carried along."""
    said = lambda *names: F.coalesce(*[F.nullif(F.col(n), F.lit("")) for n in names])
    whole = lambda name, default: F.when(F.col(name) > 0, F.col(name)).otherwise(default)
    severity = F.lower(F.coalesce("severity", F.lit("medium")))
    line, column = whole("line", F.lit(1)), whole("column", F.lit(1))
    return rows.select(
        *keys, F.coalesce(said("rule_id", "id"), F.lit("unknown-rule")).alias("rule_id"), F.coalesce(of(CONTRACT_LEVEL, severity), F.lit("warning")).alias("level"), F.coalesce(said("narrative", "description", "title"), F.lit("Finding")).alias("message"),
        F.coalesce(F.regexp_replace(said("relative_path"), r"\\", "/"), F.regexp_replace(said("host"), r"\\", "/"), F.lit("unknown")).alias("file"),
        line.alias("start_line"), column.alias("start_column"), whole("end_line", line).alias("end_line"), whole("end_column", column).alias("end_column"),
        F.coalesce(F.col("confidence").cast("double"), F.lit(0.5)).alias("confidence"), severity.alias("severity"), F.col("cve"), F.coalesce("id", F.lit("")).alias("finding_id"),
    )


def write_contract_sarif(rows: DataFrame, out, version: str = "1") -> None:
    """Writes contract findings as one report document."""
    _head(out, version, [])
    for k, r in enumerate(contract_results(rows).orderBy("file", "start_line", "rule_id").toLocalIterator()):
        region = {"startLine": r["start_line"], "startColumn": r["start_column"], "endLine": r["end_line"], "endColumn": r["end_column"]}
        place = {"physicalLocation": {"artifactLocation": {"uri": r["file"], "uriBaseId": "%SRCROOT%"}, "region": region}}
        more = {"confidence": r["confidence"], "severity": r["severity"], "cve": r["cve"], "finding-id": r["finding_id"]}
        out.write((", " if k else "") + json.dumps({"ruleId": r["rule_id"], "level": r["level"], "message": {"text": r["message"]}, "locations": [place], "properties": more}))
    out.write("]}]}\n")


def write_envelope(findings: DataFrame, out, summary: dict, warnings: list[str]) -> None:
    """Writes findings, summary and warnings as one JSON object, findings by file, line and rule."""
    out.write('{"findings": [')
    for k, r in enumerate(findings.orderBy("file", "line", "rule_id", "id").toLocalIterator()):
        out.write((", " if k else "") + json.dumps(r.asDict(recursive=True), ensure_ascii=False))
    out.write('], "summary": %s, "warnings": %s}\n' % (json.dumps(summary, ensure_ascii=False), json.dumps(warnings, ensure_ascii=False)))


def fence(code: Column) -> Column:
    """A code fence longer than any run of backticks in the code."""
    runs = F.transform(F.regexp_extract_all(code, F.lit("(`+)"), F.lit(1)), F.length)
    return F.repeat(F.lit("`"), F.greatest(F.lit(3), F.coalesce(F.array_max(runs), F.lit(0)) + 1))


def comment_body(found: DataFrame) -> Column:
    """A review comment: severity, rule, confidence in percent, the snippet in a fence, and a model's reasons and fix."""
    head = F.concat(F.lit("**"), F.upper("severity"), F.lit("** "), F.col("rule_id"), F.lit(" ("), percent(F.col("confidence")), F.lit(")"))
    mark = fence(F.col("text"))
    parts = [head, F.lit("\n"), mark, F.lit("\n"), F.col("text"), F.lit("\n"), mark]
    if "reasoning" in found.columns:
        parts.append(F.when(F.col("reasoning").isNotNull(), F.concat(F.lit("\n\n> "), percent(F.col("verdict_confidence")), F.lit(": "), F.col("reasoning"))).otherwise(F.lit("")))
    if "fix_code" in found.columns:
        own = fence(F.col("fix_code"))
        parts.append(F.when(F.col("fix_code").isNotNull(), F.concat(F.lit("\n\n"), F.col("fix_description"), F.lit("\n"), own, F.lit("\n"), F.col("fix_code"), F.lit("\n"), own)).otherwise(F.lit("")))
    return F.concat(*parts)


def review_comments(found: DataFrame) -> DataFrame:
    """A review comment for each finding."""
    return found.select("file", "line", "rule_id", comment_body(found).alias("body"))


def write_review(found: DataFrame, out) -> None:
    """Writes a review for a pull request: a summary and a comment for each finding."""
    out.write('{"event": "COMMENT", "body": %s, "comments": [' % json.dumps(summary_line(found).first()["summary"]))
    rows = found.withColumn("_body", comment_body(found)).select("file", "line", "rule_id", "ord", F.col("_body").alias("body"))
    for k, r in enumerate(rows.orderBy("file", "line", "rule_id", "ord").toLocalIterator()):
        out.write((", " if k else "") + json.dumps({"path": r["file"], "line": r["line"], "side": "RIGHT", "body": r["body"]}))
    out.write("]}\n")


def summary_line(found: DataFrame) -> DataFrame:
    """One row: how many findings there are and of which severities, those without any left out."""
    counts = [F.count_if(F.col("severity") == s) for s in ("critical", "high", "medium", "low")]
    said = [F.when(n > 0, F.concat(n.cast("string"), F.lit(f" {s}"))) for n, s in zip(counts, ("critical", "high", "medium", "low"), strict=True)]
    n = F.count("*")
    return found.agg(F.when(n == 0, F.lit("No findings")).otherwise(F.concat(n.cast("string"), F.lit(" findings ("), F.concat_ws(", ", *said), F.lit(")"))).alias("summary"))


def text_blocks(found: DataFrame) -> DataFrame:
    """A text block for each finding: five lines of the snippet at most and how many more there are, three lines of a fix, a model's reasons."""
    found = detailed(found)
    rows = F.split("text", "\n")
    more = F.when(F.size(rows) > 5, F.concat(F.lit("\n  ... "), (F.size(rows) - 5).cast("string"), F.lit(" more lines"))).otherwise(F.lit(""))
    fix = F.when(F.col("fix_code").isNotNull(), F.concat(F.lit("\n  Fix: "), F.col("fix_description"), F.lit("\n  "), F.array_join(F.slice(F.split("fix_code", "\n"), 1, 3), "\n  "))).otherwise(F.lit(""))
    why = F.when(F.col("reasoning").isNotNull(), F.concat(F.lit("\n  Confidence: "), percent(F.col("verdict_confidence")), F.lit(", "), F.col("reasoning"))).otherwise(F.lit(""))
    return found.select("file", "line", "rule_id", F.concat(F.lit("["), F.upper("severity"), F.lit("] "), F.col("rule_name"), F.lit("\n  "), F.array_join(F.slice(rows, 1, 5), "\n  "), more, fix, why).alias("block"))


def json_lines(found: DataFrame) -> DataFrame:
    """Findings as JSON documents, one a row; written by any text sink."""
    return found.select(F.to_json(F.struct("file", "line", "rule_id", "severity", "cwe", "confidence", F.col("text").alias("snippet"), "fingerprint")).alias("value"))


def json_findings(found: DataFrame) -> DataFrame:
    """Findings in the full layout of the JSON report, with the columns that order them."""
    found = detailed(found)
    at = lambda line, column: F.struct(F.col(line).alias("line"), F.col(column).alias("column"))
    fix = F.when(F.col("fix_code").isNotNull(), F.struct(F.col("fix_description").alias("description"), F.col("fix_code").alias("code")))
    judged = F.when(F.col("confirmed").isNotNull(), F.struct("confirmed", F.col("verdict_confidence").alias("confidence"), "reasoning"))
    id_ = F.concat(F.lit("f-"), F.substring("fingerprint", 1, 12))
    return found.select(
        "file", "line", "ord", "rule_id", id_.alias("id"), F.col("cwe_label").alias("cwe"), "cwe_uri", "severity", F.col("rule_name").alias("title"), "description",
        F.struct(at("sl", "sc").alias("start"), at("el", "ec").alias("end")).alias("location"), F.col("text").alias("snippet"), fix.alias("fix"), judged.alias("review"),
    )


def write_json(found: DataFrame, out, counters: dict, dismissed: DataFrame | None = None, skipped: DataFrame | None = None, version: str = "1") -> None:
    """Writes the full report: version, counters of the scan, findings, dismissed ones, skipped files."""
    out.write('{"version": %s, "scan": %s' % (json.dumps(version), json.dumps(counters)))
    for name, rows in (("findings", found), ("dismissed", dismissed)):
        out.write(f', "{name}": [')
        if rows is not None:
            for k, r in enumerate(json_findings(rows).orderBy("file", "line", "rule_id", "ord").drop("ord").toLocalIterator()):
                out.write((", " if k else "") + json.dumps(r.asDict(recursive=True)))
        out.write("]")
    out.write(', "skipped": [')
    if skipped is not None:
        for k, r in enumerate(skipped.orderBy("path").toLocalIterator()):
            out.write((", " if k else "") + json.dumps({"file": r["path"], "reason": r["reason"]}))
    out.write("]}\n")


def snapshot(found: DataFrame, dismissed: DataFrame) -> DataFrame:
    """What a baseline knows: findings and those that the second stage dismissed."""
    return found.select("fingerprint").unionByName(dismissed.select("fingerprint"))


def baseline(found: DataFrame) -> DataFrame:
    return found.groupBy("fingerprint").agg(F.count("*").alias("cnt"))


def fails(found: DataFrame, threshold: str, rank: dict[str, int]) -> DataFrame:
    """One row: the highest rank found and whether it reaches the threshold; `none` never fails."""
    top = F.coalesce(F.max(of({k: str(v) for k, v in rank.items()}, F.col("severity")).cast("int")), F.lit(0))
    return found.agg(top.alias("top_rank")).withColumn("fails", F.col("top_rank") >= rank.get(threshold, 99))
