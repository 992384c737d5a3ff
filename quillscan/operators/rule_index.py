"""Thousands of declarative rules at once: an index from what nodes are to the rules that could fit, tested only where it hits.

A rule document is data here, not a column: its patterns are rows of arrays, and one expression tests any of them. Each
pattern has keys of which a fitting node has one: a callee's name, a part of a receiver, or a node's kind. Nodes meet the
index by a hash join on keys, broadcast behind a count; parts of receivers are found by one automaton over all of them.
The plan is the same for one rule and for any number of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillscan.sources.shared import saved

_ARGUMENT = "type string, operator string, expressions boolean, function boolean"
_PATTERN = f"type string, called boolean, names array<string>, on array<string>, operator string, expressions boolean, arguments array<struct<{_ARGUMENT}>>"
#: A rule with its patterns, those that exclude, and its keys.
RULES = f"rule_id string, rule_ord int, rule_name string, severity string, languages array<string>, patterns array<struct<{_PATTERN}>>, exclude array<struct<{_PATTERN}>>, keys array<string>"
#: Rows of the index (a key of a rule) that are broadcast at most; confidence of a match.
MOST_SENT, CONFIDENCE = 200_000, 0.7


def _argument(a: dict) -> dict:
    return {"type": a.get("type"), "operator": a.get("operator"), "expressions": a.get("hasExpressions"), "function": "function" in a}


def _pattern(p: dict) -> dict:
    fn = p.get("function") or {}
    return {
        "type": p.get("type"), "called": bool(fn), "names": list(fn.get("match") or ()), "on": list(fn.get("on") or ()), "operator": p.get("operator"),
        "expressions": p.get("hasExpressions"), "arguments": [_argument(a) for a in p.get("arguments") or ()],
    }


def _keys(p: dict, lang: str) -> list[str]:
    """Keys of which a node of the language that fits the pattern has one at least."""
    if p["names"]:
        return [f"{lang} call {n}" for n in p["names"]]
    if p["on"]:
        return [f"{lang} on {x}" for x in p["on"]]
    kind = "function_call" if p["called"] else p["type"] or ("string_concat" if p["operator"] else None)
    return [f"{lang} kind {kind}" if kind else f"{lang} any"]


def table_of(spark, docs: list[dict], first: int = 0) -> DataFrame:
    """Checked rule documents as rows of RULES, numbered from `first`, written."""
    rows = []
    for k, d in enumerate(docs):
        patterns, exclude = [_pattern(p) for p in d["patterns"]], [_pattern(p) for p in d.get("exclude") or ()]
        keys = sorted({x for p in patterns for lang in d["languages"] for x in _keys(p, lang)})
        rows.append((d["id"], first + k, d["name"], d["severity"], list(d["languages"]), patterns, exclude, keys))
    return saved(spark.createDataFrame(rows, RULES), "rules")


def _dynamic(kind: Column, text: Column) -> Column:
    """Whether a string node holds expressions: concatenations always, python by braces, php always, others by ${."""
    template = F.when(F.col("lang") == "python", text.rlike(r"\{[^{}]")).when(F.col("lang") == "php", F.lit(True)).otherwise(text.contains("${"))
    return (kind == "string_concat") | ((kind == "template_string") & template)


def _child(a: Column, x: Column) -> Column:
    """Whether a child x of a call is as an argument's pattern asks."""
    kind = a["type"].isNull() | (x["kind"] == a["type"])
    operator = a["operator"].isNull() | ((x["kind"] == "string_concat") & (a["operator"] == "+"))
    return kind & operator & (a["expressions"].isNull() | (_dynamic(x["kind"], x["text"]) == a["expressions"])) & ~a["function"]


def fits(p: Column) -> Column:
    """Whether a node (columns of parse.NODES) is as a pattern asks."""
    kind, text, call = F.col("kind"), F.col("text"), F.col("kind") == "function_call"
    receiver = F.coalesce(F.exists(p["on"], lambda s: F.col("object").contains(s)), F.lit(False))
    named = (F.size(p["names"]) == 0) | F.array_contains(p["names"], F.coalesce("name", F.lit("")))
    function = ~p["called"] | (call & named & ((F.size(p["on"]) == 0) | receiver))
    operator = p["operator"].isNull() | ((kind == "string_concat") & (p["operator"] == "+"))
    own = _dynamic(kind, text) | (call & F.exists("children", lambda x: _dynamic(x["kind"], x["text"])))
    arguments = F.forall(p["arguments"], lambda a: F.exists("children", lambda x: _child(a, x)))
    return (p["type"].isNull() | (kind == p["type"])) & function & operator & (p["expressions"].isNull() | (own == p["expressions"])) & arguments


def _parts(words: list[str]):
    """A function of receivers: which of the words stand in each, by one automaton."""

    @F.arrow_udf("array<string>")
    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        automaton = ahocorasick.Automaton()
        for w in words:
            automaton.add_word(w, w)
        automaton.make_automaton()
        for b in batches:
            yield pa.array([sorted({w for _, w in automaton.iter(x)}) if x else [] for x in b.to_pylist()], pa.list_(pa.string()))

    return found


def match(nodes: DataFrame, rules: DataFrame) -> DataFrame:
    """One row for each node and rule (of table_of) that it meets, with the columns of rules.match.

    A rule that a node reaches by several keys is tested once, at the least of them.
    """
    index = saved(rules.withColumn("key", F.explode("keys")), "index")
    size = index.count()
    words = [r["w"] for r in index.where("key like '% on %'").select(F.regexp_extract("key", r"(?s)^\S+ on (.*)$", 1).alias("w")).distinct().orderBy("w").collect()]  # words of rules, which the driver made
    some = nodes.where("error is null")
    lang = F.col("lang")
    keys = [F.concat(lang, F.lit(" kind "), "kind"), F.concat(lang, F.lit(" any"))]
    called = F.when(F.col("kind") == "function_call", F.array(F.concat(lang, F.lit(" call "), F.coalesce("name", F.lit(""))))).otherwise(F.array().cast("array<string>"))
    some = some.withColumn("_on", _parts(words)(F.when(F.col("kind") == "function_call", F.col("object"))) if words else F.array().cast("array<string>"))
    some = some.withColumn("_keys", F.concat(F.array(*keys), called, F.transform("_on", lambda w: F.concat(lang, F.lit(" on "), w))))
    met = some.withColumn("key", F.explode("_keys")).join(F.broadcast(index) if size <= MOST_SENT else index, "key")
    met = met.where(F.array_contains("languages", lang) & (F.array_min(F.array_intersect("keys", "_keys")) == F.col("key")))
    met = met.where(F.exists("patterns", fits) & ~F.exists("exclude", fits))
    place = ["path", "lang", "ord", "kind", "text", "sl", "sc", "el", "ec", "name", "object", "context2", "context3"]
    return met.select(*place, "rule_id", "rule_ord", "rule_name", "severity", F.lit(0).alias("cwe"), F.lit(CONFIDENCE).alias("confidence"))
