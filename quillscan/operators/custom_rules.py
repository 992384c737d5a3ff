"""Declarative rules: documents checked once on the driver and compiled to columns over nodes."""

from __future__ import annotations

from functools import reduce
from pathlib import Path

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillscan.operators.rules import META, RANK, Rule

#: What a document may name.
CATEGORIES = ["injection", "xss", "auth", "path", "data", "config", "ssrf"]
LANGUAGES = ["javascript", "typescript", "python", "go", "java", "php"]
TYPES = ["function_call", "template_string", "string_concat", "assignment", "unknown", "variable_declaration", "member_access", "string_literal", "identifier", "binary_expression", "import", "program"]


class RuleError(ValueError):
    """A rule document that can't be used; a scan doesn't start with it."""


def _pattern_ok(p: dict, where: str) -> None:
    if not isinstance(p, dict) or not any(k in p for k in ("type", "function", "arguments", "operator", "hasExpressions")):
        raise RuleError(f"{where}: a pattern must constrain something")
    if p.get("type") not in (None, *TYPES):
        raise RuleError(f"{where}: unknown type {p['type']!r}")
    for a in p.get("arguments") or ():
        _pattern_ok(a, where)


def validate(doc: dict, where: str) -> dict:
    for key in ("id", "name", "severity", "category", "languages", "description", "patterns"):
        if not doc.get(key):
            raise RuleError(f"{where}: {key} is missing")
    if doc["severity"] not in RANK or doc["category"] not in CATEGORIES or not set(doc["languages"]) <= set(LANGUAGES):
        raise RuleError(f"{where}: unknown severity, category or language")
    for p in [*doc["patterns"], *(doc.get("exclude") or ())]:
        _pattern_ok(p, where)
    return doc


def documents(path: str) -> list[dict]:
    """The rule documents of a file or, sorted, of a folder's .yml and .yaml files; one, a list, or under `rules`."""
    import yaml

    root = Path(path)
    if not root.exists():
        raise RuleError(f"{path}: not found")
    files = sorted(p for p in root.rglob("*") if p.suffix in (".yml", ".yaml")) if root.is_dir() else [root]
    if not files:
        raise RuleError(f"{path}: no rule files")
    out = []
    for f in files:
        try:
            doc = yaml.safe_load(f.read_text())
        except yaml.YAMLError as e:
            raise RuleError(f"{f}: {e}") from e
        found = doc.get("rules") if isinstance(doc, dict) and "rules" in doc else doc if isinstance(doc, list) else [doc]
        if not found or not all(isinstance(d, dict) for d in found):
            raise RuleError(f"{f}: no rule documents")
        out += [validate(d, str(f)) for d in found]
    ids = [d["id"] for d in out] + [m[0] for m in META]
    if repeated := sorted({i for i in ids if ids.count(i) > 1}):
        raise RuleError(f"{path}: ids repeat: {', '.join(repeated)}")
    return out


def _any(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def _dynamic(kind: Column, text: Column) -> Column:
    """Whether a string node holds expressions: concatenations always, python by braces, php always, others by ${."""
    template = F.when(F.col("lang") == "python", text.rlike(r"\{[^{}]")).when(F.col("lang") == "php", F.lit(True)).otherwise(text.contains("${"))
    return (kind == "string_concat") | ((kind == "template_string") & template)


def compile_pattern(p: dict) -> Column:
    kind, text, test = F.col("kind"), F.col("text"), F.lit(True)
    if "type" in p:
        test = test & (kind == p["type"])
    if fn := p.get("function"):
        test = test & (kind == "function_call")
        if fn.get("match"):
            test = test & F.col("name").isin(*fn["match"])
        if fn.get("on"):
            test = test & F.coalesce(_any([F.col("object").contains(x) for x in fn["on"]]), F.lit(False))
    for a in p.get("arguments") or ():
        test = test & _some_child(a)
    if "operator" in p:
        test = test & (kind == "string_concat") & F.lit(p["operator"] == "+")
    if "hasExpressions" in p:
        own = _dynamic(kind, text) | ((kind == "function_call") & F.exists("children", lambda x: _dynamic(x["kind"], x["text"])))
        test = test & (own == F.lit(bool(p["hasExpressions"])))
    return test


def _some_child(a: dict) -> Column:
    def fits(x: Column) -> Column:
        test = F.lit(True)
        if "type" in a:
            test = test & (x["kind"] == a["type"])
        if "operator" in a:
            test = test & (x["kind"] == "string_concat") & F.lit(a["operator"] == "+")
        if "hasExpressions" in a:
            test = test & (_dynamic(x["kind"], x["text"]) == F.lit(bool(a["hasExpressions"])))
        return test & F.lit("function" not in a)

    return F.exists("children", fits)


def compile_rules(docs: list[dict]) -> list[Rule]:
    """Rules from documents: some pattern fits and no exclusion does; confidence 0.7."""
    return [Rule(d["id"], d["name"], d["severity"], 0, 0.7, d["category"], tuple(d["languages"]), _any([compile_pattern(p) for p in d["patterns"]]) & ~_any([compile_pattern(p) for p in d.get("exclude") or ()])) for d in docs]
