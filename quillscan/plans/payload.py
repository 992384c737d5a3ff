"""Scans asked for by a JSON object: findings of flows, or of lines, as one envelope."""

from __future__ import annotations

import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillscan.functions import flow
from quillscan.operators import relations, taint
from quillscan.plans import report, scan
from quillscan.sources import diffs, discovery, repository
from quillscan.sources.shared import mounted, saved
from quillscan.sources.tables import EXCLUDED

#: Rules that a payload may name, by id or alias.
RULES = {"tf-001": "TF-001", "tf-002": "TF-002", "taint": "TF-001", "dataflow": "TF-002"}
#: Languages whose flows are followed.
FLOWS = {".py": "python", ".go": "go", ".java": "java"}
#: Languages whose lines are read, by extension in any case.
LINES = FLOWS | discovery.HEURISTIC | {".ts": "typescript", ".tsx": "typescript"}


class PayloadError(ValueError):
    pass


def load(raw: str | None, repo_path: str | None = None, git_url: str | None = None) -> dict:
    """The payload of a text or, without one, of the input stream, unless flags alone say enough; flags win."""
    if raw is None and (repo_path or git_url):
        payload = {}
    else:
        text = sys.stdin.read() if raw is None else raw
        if not text.strip():
            raise PayloadError("expected a JSON object")
        try:
            payload = json.loads(text)
        except json.JSONDecodeError as e:
            raise PayloadError(str(e)) from e
    if not isinstance(payload, dict):
        raise PayloadError("the payload must be a JSON object")
    return payload | ({"repo_path": repo_path} if repo_path else {}) | ({"git_url": git_url} if git_url else {})


def picked_rules(payload: dict) -> tuple[list[str], list[str]]:
    """The distinct rules that a payload names, in order, and warnings on unknown ones."""
    named = payload.get("rules", ["taint", "dataflow"])
    if not isinstance(named, list) or not all(isinstance(n, str) for n in named):
        raise PayloadError("rules must be a list of strings")
    low = list(dict.fromkeys(n.lower() for n in named))
    odd = [n for n in low if n not in RULES]
    return list(dict.fromkeys(RULES[n] for n in low if n in RULES)), [f"unknown rules ignored: {', '.join(odd)}"] if odd else []


def flows(files: DataFrame, rules: list[str]) -> DataFrame:
    """Findings of the picked rules over flows: those within functions, also as plain facts, and those across calls."""
    parts = []
    if "TF-001" in rules:
        parts += [taint.local_findings(files), taint.flow_findings(taint.local_paths(files))]
    if "TF-002" in rules:
        parts.append(taint.cross_findings(files))
    if not parts:
        return taint.local_findings(files).limit(0)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def answer(spark: SparkSession, payload: dict, out, lines: bool = False) -> None:
    """Writes the envelope of a payload (repo_path, git_url, languages, rules, diff) to a text stream.

    Flows are followed in three languages; unknown languages and rules are warnings. With lines=True dangerous lines near
    input are told, in any known language; an unknown language is an error, and `diff` ({base, head}) narrows the scan.
    """
    diff = payload.get("diff")
    if diff is not None and not (isinstance(diff, dict) and all(isinstance(diff.get(k), str) and diff[k] for k in ("base", "head"))):
        raise PayloadError("diff must be an object with base and head")
    known = LINES if lines else FLOWS
    langs, odd_langs = discovery.resolve(payload.get("languages"), known, strict=lines)
    rules, odd_rules = picked_rules(payload)
    with repository.checkout(payload.get("repo_path"), payload.get("git_url"), mounted(spark) if payload.get("git_url") else None) as (folder, warnings):
        files = discovery.read(spark, [folder], None, EXCLUDED, known=known, any_case=True, dotted=True, languages=langs).where(F.col("lang").isin(*langs))
        files = saved(files, "files")  # read once, and a clone goes
        if diff and lines:
            files, rows = _narrowed(spark, files, repository.diff(folder, diff["base"], diff["head"]))
        found = taint.near_findings(files) if lines else flows(files, rules)
        if diff and lines:
            found = relations.in_ranges(found, rows)
        summary = {"repo_path": folder, "repository_source": "git-diff" if diff and lines else "git" if payload.get("git_url") and not warnings else "local"}
        if lines:
            n = scan.summary(files).first()
            summary |= {"files_scanned": n["files"], "languages": list(n["languages"]), "functions": n["functions"], "classes": n["classes"]}
        else:
            summary |= {"files_scanned": files.count(), "languages": langs, "rules": rules}
        report.write_envelope(found, out, summary, [*warnings, *odd_langs, *([] if lines else odd_rules)])


def _narrowed(spark: SparkSession, files: DataFrame, text: str) -> tuple[DataFrame, DataFrame]:
    """The files that a diff names, and the ranges of its added lines."""
    rows = spark.createDataFrame(diffs.parse(text), "file string, line long").select("file", F.col("line").alias("s"), F.col("line").alias("e"))
    names = rows.select(F.col("file").alias("path")).distinct()
    return files.join(F.broadcast(names), "path", "left_semi"), rows  # a diff that the driver has read
