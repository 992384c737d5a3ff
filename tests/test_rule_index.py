"""Rules by the index against the same rules as columns."""

import random

from quillscan.operators import custom_rules, parse, rule_index, rules
from quillscan.plans import code_queries, scan
from quillscan.sources import snippets

NAMES = ["query", "system", "exec", "eval", "readFile", "get", "print", "find", "nothing"]
PARTS = ["db", "os", "o", "un", "time", "cursor", "us", "$pdo"]


def _pattern(r):
    out = {}
    if r.random() < 0.4:
        out["type"] = r.choice(["function_call", "template_string", "string_concat", "assignment"])
    if r.random() < 0.6:
        fn = {}
        if r.random() < 0.6:
            fn["match"] = r.sample(NAMES, 2)
        if r.random() < 0.5:
            fn["on"] = r.sample(PARTS, r.randrange(1, 3))
        out["function"] = fn
    if r.random() < 0.3:
        out["arguments"] = [{k: v for k, v in (("type", r.choice(["string_concat", "template_string"])), ("hasExpressions", r.random() < 0.5), ("operator", "+")) if r.random() < 0.6} or {"operator": "+"}]
    if r.random() < 0.2:
        out["operator"] = r.choice(["+", "-"])
    if r.random() < 0.3:
        out["hasExpressions"] = r.random() < 0.5
    return out or {"type": "function_call"}


def test_the_index_finds_what_columns_find(spark, tmp_path):
    r = random.Random(2)
    docs = [
        {"id": f"R-{k}", "name": "n", "severity": "low", "category": "data", "languages": r.sample(custom_rules.LANGUAGES, r.randrange(1, 7)), "description": "-", "patterns": [_pattern(r) for _ in range(r.randrange(1, 4))]}
        | ({"exclude": [_pattern(r)]} if r.random() < 0.4 else {})
        for k in range(70)
    ]
    spark.createDataFrame([(k, 1 + k % 3) for k in range(63)], "p_partkey long, p_size int").write.parquet(str(tmp_path / "part.parquet"))
    files = snippets.files(spark, str(tmp_path))
    nodes = parse.nodes_of(parse.parsed(files))
    columns = rules.match(nodes, custom_rules.compile_rules(docs))
    index = rule_index.match(nodes, rule_index.table_of(spark, docs))
    assert index.columns == columns.columns
    rows = lambda df: sorted((x["path"], x["ord"], x["rule_id"], x["rule_ord"], x["confidence"]) for x in df.collect())
    got = rows(index)
    assert got == rows(columns) and len({x[2] for x in got}) > 30 and len(set(got)) == len(got)


def test_rules_of_the_index_in_a_scan(spark):
    files = spark.createDataFrame([("a.py", "python", "eval(x)\nfn1('a' + b)\nown.fn0('a' + b)\nfn2('a')\nbox7_.z()\n")], "path string, lang string, content string")
    docs = code_queries.many_rules()[:10]
    found = scan.findings(files, scan.Options(documents=docs, disable=["M-3"])).select("rule_id", "line").collect()
    assert sorted(map(tuple, found)) == [("CG-003", 1), ("M-1", 2), ("M-7", 5)]
    assert scan.findings(files, scan.Options(preset="none", documents=docs, disable=[d["id"] for d in docs])).count() == 0


def test_the_plan_does_not_grow_with_rules(spark):
    nodes = parse.nodes(spark.createDataFrame([], "path string, lang string, content string"))
    size = lambda n: len(rule_index.match(nodes, rule_index.table_of(spark, code_queries.many_rules()[:n]))._jdf.queryExecution().optimizedPlan().toString())
    assert size(5000) < 1.5 * size(10)
