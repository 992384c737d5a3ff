"""Second stage, findings of flows, discovery, full reports, plug-ins, long lines, whole-table plans."""

import hashlib
import io
import json
import random
import re
import sys

import pytest
from pyspark.sql import functions as F

from quillscan import cli
from quillscan.functions import lexer
from quillscan.operators import enrich, parse, plugins, relations, review, rules, taint
from quillscan.plans import ci, payload, report, scan
from quillscan.sources import diffs, discovery


def _files(spark, *rows):
    return spark.createDataFrame(rows, "path string, lang string, content string")


def test_positions_and_contexts_of_one_long_line(spark):
    text = "x = 1; " * 200_000 + "eval(a); " + "y = 2; " * 200_000 + "eval(b)\neval(c)\n"
    found = scan.findings(_files(spark, ("a.js", "javascript", text))).where("rule_id = 'CG-003'")
    rows = sorted((r["sl"], r["sc"], len(r["context3"])) for r in found.collect())
    assert [r[:2] for r in rows] == [(1, 1_400_000), (1, 2_800_009), (2, 0)]
    assert all(r[2] <= 2 * parse.REACH + 20 for r in rows)


def test_contexts_of_short_lines_are_whole(spark):
    text = "\n".join(f"line{k}()" for k in range(12))
    rows = {r["sl"]: (r["context2"], r["context3"]) for r in parse.nodes(_files(spark, ("a.py", "python", text))).collect()}
    lined = text.split("\n")
    for n, near in rows.items():
        assert near == tuple("\n".join(lined[max(0, n - 1 - r) : n + r]) for r in (2, 3))


def test_rules_ask_whole_lines_however_long(spark):
    """The telling word stands far outside the context that is shown, on the same minified line."""
    far = "a=b+1;" * 900  # 5,400 characters
    texts = {
        "CG-022": f"var token=1;{far}x=Math.random();",
        "CG-030": f"{far}fs.readFile('/d/'+name,f);",  # and nothing near makes it safe
        "CG-031": f"p=req.params.file;{far}fs.readFile(p,f);",
    }
    safe = {"CG-022": f"var plain=1;{far}x=Math.random();", "CG-030": f"q=path.resolve(d);{far}q.startsWith(d);fs.readFile('/d/'+name,f);", "CG-031": f"p=fixed;{far}p=req.params.file;fs.readFile(p,f);"}
    rows = [(f"{k}{i}.js", "javascript", t) for i, some in enumerate((texts, safe)) for k, t in some.items()]
    rows += [("w1.java", "java", f"class A {{ void f() {{ w = resp.getWriter();{far} w.print(x); }} }}"), ("w0.java", "java", f"class A {{ void f() {{ w = other();{far} w.print(x); }} }}")]
    rows += [("s.php", "php", f"<?php $p = $_GET['f'];{far} fopen($p, 'r');"), ("t.php", "php", "<?php $pp = $_GET['f']; fopen($p, 'r');")]
    got = {(r["path"], r["rule_id"]) for r in scan.findings(_files(spark, *rows)).select("path", "rule_id").collect()}
    assert {x for x in got if x[1] in texts} == {*((f"{k}0.js", k) for k in texts), ("s.php", "CG-031")}
    assert ("w1.java", "CG-010") in got and ("w0.java", "CG-010") not in got


def test_a_line_of_very_many_calls_is_searched_once(spark):
    text = "".join(f"v{k}=req.query.x;fs.open(v{k});Math.random();" for k in range(20_000))
    rows = scan.findings(_files(spark, ("a.js", "javascript", text + "token=1"))).groupBy("rule_id").count().collect()
    assert {r["rule_id"]: r["count"] for r in rows} == {"CG-031": 20_000, "CG-022": 20_000}


def test_each_file_is_read_once_for_everything(spark, tmp_path):
    log = tmp_path / "read"

    def reader(text):
        with open(log, "a") as f:
            f.write("x\n")
        if "fail" in text:
            raise ValueError("no")
        return lexer.Source(text, "python")

    files = _files(spark, *((f"f{k}.toy", "toy", "def f(a):\n    eval(a)\n") for k in range(9)), ("bad.toy", "toy", "fail"), ("x.rb", None, ""))
    options = scan.Options(adapters={"toy": reader})
    read = parse.parsed(files, options.adapters)
    nodes = parse.nodes_of(read)
    assert nodes.where("error is null").count() == 9 and nodes.columns == parse.nodes(files).columns
    assert parse.spans_of(read).where("kind = 'function'").count() == 9 and parse.spans_of(read).columns == parse.spans(files).columns
    assert sorted(r["reason"] for r in scan.skipped(files, parsed=read).collect()) == ["ValueError: no", "unsupported language"]
    assert scan.summary(files, parsed=read).first()["functions"] == 9
    scan.candidates(files, options, read).count()
    assert len(log.read_text().split()) == 10
    plan = parse.spans_of(read)._jdf.queryExecution().toString()
    assert "PartitionFilters: [what" in plan and "ReadSchema: struct<span" in plan


def test_a_file_that_fails_is_a_row(spark, monkeypatch):
    deep = "def f(a):\n    return " + "f(" * 5000 + "a" + ")" * 5000 + "\n"
    files = _files(spark, ("deep.py", "python", deep), ("ok.py", "python", "def f(request):\n    a = input()\n    eval(a)\n"), ("x.rb", None, "x"))
    assert {r["path"] for r in taint.local_paths(files).collect()} == {"ok.py"}
    assert taint.cross_paths(files).count() >= 1 and taint.call_edges(files).count() >= 0 and parse.spans(files).where("name = 'f'").count() == 2

    class Broken:
        def __init__(self, text):
            raise RecursionError("too deep")

    rows = scan.skipped(files, {"python": Broken}).collect()
    assert {(r["path"], r["reason"].split(":")[0]) for r in rows} == {("deep.py", "RecursionError"), ("ok.py", "RecursionError"), ("x.rb", "unsupported language")}


def test_a_language_of_ones_own(spark):
    class Shouting(lexer.Source):
        def __init__(self, text):
            super().__init__(text.lower(), "python")

    files = _files(spark, ("a.loud", "loud", "EVAL(X)\n"))
    assert [r["name"] for r in parse.nodes(files, {"loud": Shouting}).collect()] == ["eval"]


def test_names_that_are_words_of_other_languages():
    calls = lambda text, lang: [(n.name, n.object) for n in lexer.Source(text, lang).calls()]
    assert calls("re.match(p, s)\nlist(x)\nif (a): pass\n", "python") == [("match", "re"), ("list", None)]
    assert [f[0] for f in lexer.Source("class A { void go(int n) { run(n); } }", "java").functions()] == ["go"]
    assert calls("<?php if (isset($a)) { f(list($b) = g()); }", "php") == [("f", None), ("g", None)]
    assert calls("go func() { defer close(c) }()", "go")[0] == ("close", None)


def test_spans_of_functions_and_classes():
    src = lexer.Source("class Box { put(x) { return x } }\nconst add = async (a, b = 2) => { return a }\nlist.map(v => v + 1);\ninterface Some { a: number }\n", "typescript")
    assert [(f[0], f[1]) for f in src.functions()] == [("put", ["x"]), ("add", ["a", "b"]), ("<anonymous>", ["v"])]
    assert [c[0] for c in src.classes()] == ["Box", "Some"]
    assert [c[0] for c in lexer.Source("class A(B):\n    x = 1\nclass C:\n    pass\n", "python").classes()] == ["A", "C"]
    assert [c[0] for c in lexer.Source("package p\ntype T struct { a int }\n", "go").classes()] == ["T"]
    cpp = lexer.Source("struct S { int a; };\nvoid find(Database& db) {\n  std::cin >> owner;\n  db.execute(\"x\" + owner);\n}\n", "cpp")
    assert [f[0] for f in cpp.functions()] == ["find"] and [c[0] for c in cpp.classes()] == ["S"]


def _reply(prompt):
    if "bad" in prompt:
        raise RuntimeError("down")
    yes = "yes" in prompt
    return review.Reply('{"confirmed": %s, "confidence": 0.8, "reasoning": "r", "fixDescription": "d", "fixCode": "c"}' % ("true" if yes else "false"), 1_000_000, 0, "gpt-4o")  # 2.5 dollars


def _candidates(spark, *names):
    return spark.createDataFrame([(k, n, f"k-{n}", f"{n} {k}") for k, n in enumerate(names)], "n int, name string, key_hash string, prompt string")


def test_review_of_everything(spark):
    rows = review.run(_candidates(spark, "yes1", "no", "bad", "yes1"), _reply, ["n"], model="gpt-4o")
    got = {r["n"]: r for r in rows.collect()}
    assert [got[k]["outcome"] for k in range(4)] == ["confirmed", "dismissed", "kept", "confirmed"]
    assert (got[0]["fix_description"], got[0]["fix_code"], got[1]["fix_code"]) == ("d", "c", None)
    assert [got[k]["asked"] for k in range(4)] == [True, True, True, False]  # one call a key
    assert review.costs(rows).first().asDict() == {"llm_calls": 3, "cost": 5.0, "cache_hits": 0}


def test_review_asks_about_selected_rows_only(spark):
    rows = review.run(_candidates(spark, "yes1", "bad", "no"), _reply, ["n"], selected=F.col("n") > 1).collect()
    assert {r["n"]: (r["channel"], r["outcome"]) for r in rows} == {0: ("rule", "kept"), 1: ("rule", "kept"), 2: ("review", "dismissed")}


@pytest.mark.parametrize("most, calls", [(0.1, 1), (2.5, 1), (2.6, 2), (7.5, 3), (100.0, 6)])
def test_a_budget_stops_new_calls(spark, most, calls):
    rows = review.run(_candidates(spark, *[f"yes{k}" for k in range(6)]), _reply, ["n"], model="gpt-4o", max_cost=most, lanes=1).collect()
    assert sorted(r["n"] for r in rows if r["asked"]) == list(range(calls))
    assert all(r["outcome"] == "kept" and r["channel"] == "budget" for r in rows if not r["asked"])


def test_a_budget_needs_a_price(spark):
    with pytest.raises(ValueError, match="price"):
        review.run(_candidates(spark, "yes1"), _reply, ["n"], model="unknown", max_cost=1.0)


def test_cache_round_trip_and_prune(spark, tmp_path):
    path = str(tmp_path / "cache")
    assert review.read_cache(spark, path).count() == 0 and review.prune(spark, path, 0, 10) == 0
    first = review.run(_candidates(spark, "yes1", "bad", "no"), _reply, ["n"], model="gpt-4o", store=review.read_cache(spark, path), now_ms=1000)
    review.write_cache(review.cache_rows(first, 1000), path)
    again = review.run(_candidates(spark, "yes1", "bad", "no"), _reply, ["n"], model="gpt-4o", store=review.read_cache(spark, path), now_ms=2000, ttl_s=86_400)
    assert review.costs(again).first().asDict() == {"llm_calls": 1, "cost": 0.0, "cache_hits": 2}  # what failed is asked again
    said = {r["name"]: r["d"] for r in again.withColumn("d", review.noted(F.lit("It is."))).collect()}
    assert said == {"yes1": "It is. Confirmed by Stage 2 analysis (cached).", "no": "It is. Dismissed by Stage 2 analysis (cached).", "bad": "It is."}
    late = review.run(_candidates(spark, "yes1"), _reply, ["n"], store=review.read_cache(spark, path), now_ms=10**9, ttl_s=5)
    assert late.first()["channel"] == "review"
    review.write_cache(review.cache_rows(late, 10**9), path)
    assert review.prune(spark, path, 10**9, 5) == 2
    assert [(r["key_hash"], r["cached_at"]) for r in review.read_cache(spark, path).collect()] == [("k-yes1", 10**9)]


@pytest.mark.parametrize("step", ["write", "commit", "remove", "none"])
def test_a_prune_that_is_killed_loses_nothing(spark, tmp_path, monkeypatch, step):
    path = str(tmp_path / "cache")
    row = lambda k, at: (k, True, 0.5, f"r{at}", None, None, None, None, at, review.VERSION)
    store = lambda *rows: spark.createDataFrame(rows, review.CACHED)
    review.write_cache(store(row("aa1", 1), row("bb1", 9_000_000)), path)
    review.write_cache(store(row("aa1", 9_000_001), row("cc1", 2)), path)
    whole = {("aa1", 9_000_001), ("bb1", 9_000_000)}
    read = lambda: {(r["key_hash"], r["cached_at"]) for r in review.fresh(review.read_cache(spark, path), 9_000_002, 10).collect()}
    assert read() == whole

    def killed(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        if step == "write":
            m.setattr(review, "fresh", killed)
        elif step == "commit":
            m.setattr(review, "_commit", killed)
        elif step == "remove":
            live, n = review._live, iter(range(9))
            m.setattr(review, "_live", lambda *x: killed() if next(n) == 2 else live(*x))  # of prune, of its commit, then before folders go
        if step != "none":
            with pytest.raises(KeyboardInterrupt):
                review.prune(spark, path, 9_000_002, 10)
    assert read() == whole
    review.prune(spark, path, 9_000_002, 10)
    assert {(r["key_hash"], r["cached_at"]) for r in review.read_cache(spark, path).collect()} == whole
    assert len([x for x in (tmp_path / "cache").iterdir() if x.name.startswith("manifest")]) == 1
    assert step == "commit" or len([x for x in (tmp_path / "cache").iterdir() if x.name.startswith("entries")]) == 1


def test_a_cache_of_the_older_layout_is_read_and_pruned(spark, tmp_path):
    path = str(tmp_path / "cache")
    rows = spark.createDataFrame([("aa1", True, 0.5, "r", None, None, None, None, 5_000, review.VERSION), ("bb1", True, 0.5, "r", None, None, None, None, 1, review.VERSION)], review.CACHED)
    rows.withColumn("shard", F.substring("key_hash", 1, 2)).write.partitionBy("shard").parquet(path)
    assert review.read_cache(spark, path).count() == 2
    assert review.prune(spark, path, 6_000, 2) == 1
    assert [r["key_hash"] for r in review.read_cache(spark, path).collect()] == ["aa1"] and not list((tmp_path / "cache").glob("shard=*"))


def test_replies():
    assert enrich.parse_reply('```json\n{"confirmed": true, "confidence": "0.25", "reasoning": " r "}\n```') == {"confirmed": True, "confidence": 0.25, "reasoning": "r"}
    assert enrich.parse_reply('x {"confirmed": 1, "confidence": null, "reasoning": "r", "fixDescription": "d", "fixCode": "c"} y') == {"confirmed": False, "confidence": 0.5, "reasoning": "r"}
    assert review.strict_reply('{"confirmed": true, "confidence": 4, "reasoning": "r"}')["confidence"] == 1.0
    for text in ("{}", '{"reasoning": " "}', "none"):
        with pytest.raises(ValueError):
            enrich.parse_reply(text)
        with pytest.raises(ValueError):
            review.strict_reply(text)
    with pytest.raises(ValueError):
        review.strict_reply('```{"reasoning": "r"}```')


def test_a_model_behind_a_command(spark):
    code = "import json,sys; r=json.load(sys.stdin); print(json.dumps({'text': json.dumps({'confirmed': True, 'confidence': 1, 'reasoning': r['prompt']}), 'tokens_in': 3, 'tokens_out': 4, 'model': 'm'}))"
    got = review.Command([sys.executable, "-c", code])("hello")
    assert (json.loads(got.text)["reasoning"], got.tokens_in, got.tokens_out, got.model) == ("hello", 3, 4, "m")


def test_explanations_keep_their_order_and_are_not_made_up(spark):
    files = _files(spark, ("a.py", "python", "def f():\n    a = input()\n    eval(a)\n    os.system(a)\n"))
    paths = taint.local_paths(files)
    rows = review.explained(paths, lambda p: json.dumps({"explanation": f" {json.loads(p)['sink']} "}), ["path", "sink_line"]).collect()
    assert [r["explanation"] for r in rows] == ["eval", "os.system"]
    with pytest.raises(Exception, match="no explanation"):
        review.explained(paths, lambda p: "{}", ["path"]).collect()


def test_findings_of_flows(spark):
    text = "def read():\n    return input()\ndef run():\n    v = read()\n    os.system(v)\ndef one():\n    q = input()\n    db.query(q)\n"
    files = _files(spark, ("a.py", "python", text))
    local = taint.local_findings(files).collect()
    assert [(r["severity"], r["confidence"], r["line"], r["title"]) for r in local] == [("high", 0.9, 8, "Tainted data reaches db.query")]
    assert local[0]["evidence"][0] == "source input at line 7" and local[0]["tags"] == ["python", "taint"]
    cross = taint.cross_findings(files).collect()
    assert [(r["severity"], r["confidence"], r["line"]) for r in cross] == [("critical", 0.92, 5)]
    fact = taint.flow_findings(taint.local_paths(files)).first()
    assert (fact["severity"], fact["rule_id"], json.loads(fact["evidence"][0])["sink"]) == ("high", local[0]["rule_id"], "db.query")
    empty = spark.createDataFrame([(None, [("s", 3)]), (None, [])], "l int, steps array<struct<name string, line int>>")
    assert [r[0] for r in empty.select(taint.place_of_path(F.col("l"), F.col("steps"))).collect()] == [3, 1]


GLOBS = [("**/*.{ts,js}", "a/b/c.ts", True), ("**/*.{ts,js}", "c.js", True), ("**/*.{ts,js}", "c.py", False), ("*.py", "a/b.py", False), ("src/**", "src/a/b", True), ("node_modules", "a/node_modules/x.js", True), ("node_modules", "a/node_modules2/x.js", False), ("**/*.test.*", "a/x.test.js", True), ("f[0-9].go", "f7.go", True), ("f[!0-9].go", "f7.go", False), ("a?c", "abc", True), ("a?c", "a/c", False), ("dist", "dist/a", True)]


@pytest.mark.parametrize("glob, path, want", GLOBS, ids=[f"{g} {p}" for g, p, _ in GLOBS])
def test_globs(glob, path, want):
    import re

    assert bool(re.match(discovery.pattern(glob), path)) == want


def test_discovery_of_roots(spark, tmp_path):
    for name in ("one/a.py", "one/.hidden/b.py", "one/node_modules/c.js", "one/d.test.ts", "two/E.PY", "two/f.go"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x")
    paths = lambda *roots, **how: sorted(r["path"].removeprefix(str(tmp_path)) for r in discovery.read(spark, [str(tmp_path / r) for r in roots], **how).collect())
    assert paths("one", include=discovery.INCLUDE, exclude=discovery.EXCLUDE) == ["a.py"]
    assert paths("one", "two/f.go") == ["/one/a.py", "/one/d.test.ts", "/two/f.go"]
    assert paths("two", languages=["py"], any_case=True) == ["E.PY"] and paths("two", languages=["py"]) == []
    assert paths("tw*/*.go") == ["two/f.go"]
    for bad in (["none"], []):
        with pytest.raises(discovery.DiscoveryError):
            discovery.read(spark, [str(tmp_path / b) for b in bad])
    with pytest.raises(discovery.DiscoveryError, match="cobol"):
        discovery.resolve(["py", "cobol"])
    assert discovery.resolve(["TS", "cobol", "ts", "Go"], strict=False) == (["typescript", "go"], ["unsupported languages ignored: cobol"])


def test_full_reports(spark):
    files = _files(spark, ("b.py", "python", "eval(x)\n"), ("a\\c.py", "python", "hashlib.new('md5')\n"), ("x.rb", None, ""))
    found = scan.findings(files)
    judged = found.withColumns({"confirmed": F.lit(True), "verdict_confidence": F.lit(0.75), "reasoning": F.lit("why"), "fix_description": F.lit("use it"), "fix_code": F.lit("a\nb\nc\nd")})
    out = io.StringIO()
    report.write_sarif(judged, out)
    document = json.loads(out.getvalue())
    report.check_sarif(document)
    result = document["runs"][0]["results"][0]
    assert result["fixes"][0]["artifactChanges"][0]["replacements"][0]["insertedContent"]["text"] == "a\nb\nc\nd" and "Confidence: 75%" in result["message"]["markdown"]
    assert [r["locations"][0]["physicalLocation"]["artifactLocation"]["uri"] for r in document["runs"][0]["results"]] == ["a/c.py", "b.py"]
    for path in (("version",), ("runs",)):
        broken = {k: v for k, v in document.items() if k not in path}
        with pytest.raises(ValueError):
            report.check_sarif(broken)
    with pytest.raises(ValueError, match="locations"):
        del result["locations"]
        report.check_sarif(document)
    out = io.StringIO()
    report.write_json(judged, out, {"files": 3}, judged.limit(0), scan.skipped(files))
    full = json.loads(out.getvalue())
    assert [f["rule_id"] for f in full["findings"]] == ["CG-021", "CG-003"] and full["skipped"] == [{"file": "x.rb", "reason": "unsupported language"}]
    assert full["findings"][0]["review"]["confidence"] == 0.75 and full["findings"][1]["cwe"] == "CWE-95"
    out = io.StringIO()
    report.write_review(judged, out)
    posted = json.loads(out.getvalue())
    assert posted["body"] == "2 findings (1 critical, 1 medium)" and "use it" in posted["comments"][0]["body"]
    assert "Fix: use it\n  a\n  b\n  c" in report.text_blocks(judged).first()["block"] and "\n  d" not in report.text_blocks(judged).first()["block"]
    assert report.summary_line(found.limit(0)).first()["summary"] == "No findings"
    out = io.StringIO()
    report.write_empty_sarif(out)
    report.check_sarif(json.loads(out.getvalue()))


def test_counters_with_a_review(spark):
    files = _files(spark, ("a.py", "python", "eval(x)  # scan-ignore\neval(y)\nos.system('a' + b)\n"))
    steps = scan.stages(files)
    rows = ci.reviewed(steps["findings"], lambda p: review.Reply('{"confirmed": true, "confidence": 1, "reasoning": "r"}', 1000, 0, "gpt-4o"), "gpt-4o")
    n = scan.counters(files, steps, rows).first()
    assert (n["candidates"], n["suppressed"], n["findings"], n["llm_calls"], n["cost"]) == (3, 1, 2, 2, 0.005)


@pytest.mark.parametrize("text", ["eval(x)  # scan-ignore\neval(y)\neval(y)\nos.system('a' + b)\nrandom.randint(token)\n", "x = 1\n"], ids=["some", "none"])
def test_counts_noted_while_stages_are_written(spark, text):
    files = _files(spark, ("a.py", "python", text), ("b.rb", None, ""))
    base = report.baseline(scan.findings(_files(spark, ("a.py", "python", "eval(y)\n"))))
    for how in ({}, {"baseline": base}, {"severity": "critical", "changed": spark.createDataFrame([("a.py", 4)], "file string, line long")}, {"changed": spark.createDataFrame([], "file string, line long"), "directive": None}):
        options, counts = scan.Options(**how), scan.Counts()
        plain = scan.counters(files, scan.stages(files, options)).first().asDict()
        steps = scan.stages(files, options, counts=counts)
        assert scan.counters(files, steps, counts=counts).first().asDict() == plain, how
        assert steps["findings"].count() == plain["findings"]


def test_rules_are_compiled_and_evaluated_once(spark):
    files = _files(spark, ("a.py", "python", "eval(x)\nos.system('a' + b)\nprint(1)\n"))
    plan = rules.match(parse.nodes(files), rules.load())._jdf.queryExecution().optimizedPlan().toString().split("\n")
    assert [x for x in plan if "Generate explode" in x and "CASE WHEN" not in x]
    assert len([x for x in plan if "CASE WHEN" in x]) == 1  # in no generator and no filter inferred from one


def test_counted_candidates_are_narrow_and_give_the_same_numbers(spark):
    text = "eval(x)  # scan-ignore\neval(y)\neval(y)\nos.system('a' + b)\nos.system('a' + os.popen('b' + c))\nrandom.randint(token)\n"
    files = _files(spark, ("a.py", "python", text), ("c.py", "python", text), ("b.rb", None, ""))
    base = report.baseline(scan.findings(_files(spark, ("a.py", "python", "eval(y)\n"))))
    options = scan.Options(baseline=base, changed=spark.createDataFrame([("a.py", 3), ("a.py", 4)], "file string, line long"))
    narrow, wide = scan.candidates(files, options, counted=True), scan.candidates(files, options)
    assert narrow.columns == [*scan.COUNTED, "fingerprint"]
    assert sorted(narrow.select(*scan.COUNTED).collect()) == sorted(wide.select(*scan.COUNTED).collect())
    steps = [scan.stages(files, options, x) for x in (narrow, wide)]
    assert scan.counters(files, steps[0]).first() == scan.counters(files, steps[1]).first()
    assert {r["fingerprint"] for r in steps[0]["findings"].collect()} == {r["fingerprint"] for r in steps[1]["findings"].collect()}
    plan = narrow._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "SortAggregate" not in plan and "context3" not in plan.split("Exchange")[0]


@pytest.mark.parametrize("text", ["$a = 1;\nb\n = $a;\nc := d\n$$b=2\n", "\n\nx\n=\n1\n", "PATH.RESOLVE path.resolve startsWith\nTo\u212aen = 1\nAPI-key HasPrefix\n", "none\n"], ids=["sigils", "blank", "hints", "none"])
def test_surroundings_are_those_of_a_plain_search(text):
    found, starts = parse.Surroundings(text), [0, *(m.end() for m in re.finditer("\n", text))]
    for low in starts:
        for high in (x - 1 for x in starts if x > low):
            assert found.near(low, high) == [k for k, p in parse.HINTS.items() if re.compile(p).search(text, low, high)]
            for name in ("$a", "a", "b", "$b", "$$b", "c", "x", "d"):
                m = next((m for m in re.compile(r"([\w$]+)\s*:?=").finditer(text, low, high) if m[1] == name or m[1].endswith("$" + name)), None)
                assert found.assigned(low, high, name) == (re.compile(r"[^;\n]*").match(text, m.end(), high)[0] if m else None), (low, high, name)


def _length(path, lang, content):
    yield {"severity": "low", "title": f"{len(content)} characters", "tags": ["b", "a", "b"]}


def _unsure(path, lang, content):
    return [{"title": "never", "confidence": 7.0}, {"title": "x", "severity": "awful"}, {"severity": "low"}, {"title": "nan", "confidence": float("nan")}]


def _failing(path, lang, content):
    raise RuntimeError("not this file")


def test_rules_as_functions(spark):
    files = _files(spark, ("a.py", "python", "abc"), ("b.rb", None, ""), ("c.go", "go", None))
    rules = plugins.merged({"L-1": _length, "L-2": _unsure}, {"L-3": _failing})
    rows = plugins.evaluate(files, rules).where("path = 'a.py'").collect()
    assert sorted((r["rule_id"], r["title"], r["error"]) for r in rows if r["rule_id"] != "L-2") == [("L-1", "3 characters", None), ("L-3", None, "RuntimeError: not this file")]
    wrong = [r for r in rows if r["rule_id"] == "L-2"]
    assert len(wrong) == 4 and all(r["error"] and r["title"] is None and r["severity"] is None for r in wrong)
    first = plugins.evaluate(files, rules, ["L-1"]).where("path = 'a.py'").first()
    assert (first["tags"], first["confidence"], first["line"], first["evidence"], first["severity"]) == (["a", "b"], 0.5, 1, [], "low")
    assert {r["path"] for r in plugins.evaluate(files, rules, ["L-1"]).collect()} == {"a.py", "c.go"}
    with pytest.raises(ValueError):
        plugins.merged(rules, {"L-1": _unsure})
    with pytest.raises(KeyError):
        plugins.evaluate(files, rules, ["L-9"])


def test_samples_and_running_sums_equal_brute_force(spark):
    r = random.Random(3)
    keys = [f"p{k % 700}" for k in range(900)]
    df = spark.createDataFrame([(k, i, r.randrange(100)) for i, k in enumerate(keys)], "path string, n int, v int").repartition(7)
    for rate in (0.001, 0.2, 0.5, 0.999):
        want = sorted(sorted(keys, key=lambda k: (hashlib.sha256(f"s\0{k}".encode()).hexdigest(), k))[: max(1, -int(-len(keys) * rate // 1))])
        assert sorted(x["path"] for x in relations.hash_sample(df, "path", rate, "s").collect()) == want
    rows = {x["n"]: (x["v"], x["ahead"]) for x in relations.running(df, ["n"], F.col("v"), "ahead").collect()}
    total = 0
    for n in range(900):
        assert rows[n][1] == total
        total += rows[n][0]


def test_random_diffs_equal_a_line_by_line_reading():
    import re

    def plain(text):
        out, file, left, at = [], None, [0, 0], 0
        for line in text.split("\n"):
            if max(left) > 0:
                mark = line[:1]
                if mark == "\\":
                    continue
                if mark != "+":
                    left[0] -= 1
                if mark != "-":
                    if mark == "+" and file:
                        out.append((file, at))
                    left[1], at = left[1] - 1, at + 1
            elif line.startswith("+++ "):
                file = line[6:] if line.startswith("+++ b/") else None
            elif m := re.match(r"@@ -\d+,(\d+) \+(\d+),(\d+) @@", line):
                left, at = [int(m[1]), int(m[3])], int(m[2])
        return out

    r = random.Random(8)
    for _ in range(500):
        rows = ["+++ b/x"] + [r.choice(["+a", "-b", " c", "\\ No", "+++ b/y", "@@ -1,%d +%d,%d @@" % (r.randrange(4), r.randrange(9), r.randrange(4)), "+++ /dev/null"]) for _ in range(r.randrange(14))]
        assert diffs.parse("\n".join(rows)) == plain("\n".join(rows)), rows


def test_diffs_of_any_length_equal_the_reading_of_a_text(spark):
    r = random.Random(5)
    choices = ["+a", "-b", " c", "\\ No", "", "+++ b/y\t2024", "@@ -9 +11,2 @@", "+++ /dev/null", "--- a/z", "++"]
    line = lambda: r.choice([*choices, "@@ -1,%d +%d,%d @@" % (r.randrange(5), r.randrange(90), r.randrange(5))])
    texts = {f"d{k}": "\n".join(["+++ b/x", *(line() for _ in range(r.randrange(20)))]) for k in range(60)}
    texts["long"] = "\n".join(["+++ b/x", *(line() for _ in range(4000)), "@@ -0,0 +1,3000 @@", *(["+z", "+++ b/inside"] * 1500), "+++ b/last", "@@ -1 +7,3 @@", "+q", " w", "+e"])
    texts |= {"blank": " \n\n", "empty": ""}
    rows = [(k, n, x) for k, t in texts.items() for n, x in enumerate(t.split("\n"), 1)]
    r.shuffle(rows)
    lined = spark.createDataFrame(rows, "id string, line_no long, line string")
    got = sorted(map(tuple, diffs.added_lines(lined, "id").collect()))
    assert got == sorted((k, f, n) for k, t in texts.items() for f, n in diffs.parse(t))
    with pytest.raises(ValueError, match="not a unified diff"):
        diffs.added_lines(spark.createDataFrame([("a", 1, "text")], "id string, line_no long, line string"), "id")


def test_payloads(spark, tmp_path):
    (tmp_path / "a.py").write_text("def f():\n    a = input()\n    eval(a)\n")
    (tmp_path / "b.cpp").write_text("void f(D& db) {\n  std::cin >> x;\n  db.execute(x);\n}\n")
    out = io.StringIO()
    payload.answer(spark, {"repo_path": str(tmp_path), "languages": ["Python", "cobol"], "rules": ["taint", "other"]}, out)
    got = json.loads(out.getvalue())
    assert [(f["rule_id"], f["line"]) for f in got["findings"]] == [("TF-001", 3), ("TF-001", 3)] and len(got["warnings"]) == 2
    assert got["summary"]["rules"] == ["TF-001"] and got["summary"]["files_scanned"] == 1
    out = io.StringIO()
    payload.answer(spark, {"repo_path": str(tmp_path)}, out, lines=True)
    got = json.loads(out.getvalue())
    assert [(f["file"], f["line"]) for f in got["findings"]] == [("a.py", 3), ("b.cpp", 3)]
    assert (got["summary"]["functions"], got["summary"]["languages"]) == (2, ["python", "cpp"])
    for bad in ("", "[]", "{"):
        with pytest.raises(payload.PayloadError):
            payload.load(bad)
    assert payload.load('{"a": 1}', "x") == {"a": 1, "repo_path": "x"} and payload.load(None, None, "u") == {"git_url": "u"}
    with pytest.raises(payload.PayloadError):
        payload.picked_rules({"rules": "taint"})


def test_commands(spark, tmp_path, capsys):
    src = tmp_path / "src"
    src.mkdir()
    (src / "a.py").write_text("eval(x)\n")
    (src / "b.py").write_text("def f():\n    a = input()\n    os.system(a)\n")
    assert cli.main(["flows", "--repo-path", str(src)]) == 0
    assert json.loads(capsys.readouterr().out)["summary"]["files_scanned"] == 2
    assert cli.main(["lines", "--input", '{"repo_path": "%s", "languages": ["cobol"]}' % src]) == 2
    assert "cobol" in json.loads(capsys.readouterr().out)["error"]
    assert cli.main(["ci", "--root", str(src), "--artifacts", str(tmp_path / "out"), "--sample-rate", "0.5"]) == 0
    assert json.loads((tmp_path / "out/summary.json").read_text())["sampled_files"] == 1
    report.check_sarif(json.loads((tmp_path / "out/rules.sarif").read_text()))
    assert json.loads((tmp_path / "out/sample.sarif").read_text())["runs"][0]["results"] == []
    capsys.readouterr()
    judge = f"""{sys.executable} -c "import json,sys; sys.stdin.read(); print(json.dumps({{'text': json.dumps({{'confirmed': False, 'confidence': 1, 'reasoning': 'r'}})}}))" """
    (src / "quillscan.json").write_text(json.dumps({"cache": str(tmp_path / "cache"), "lanes": 2, "model": "m"}))
    assert cli.main(["scan", str(src), "--review", judge, "--output", "json-report"]) == 0
    full = json.loads(capsys.readouterr().out)
    assert full["findings"] == [] and len(full["dismissed"]) == 1 and full["scan"]["llm_calls"] == 1
    assert cli.main(["scan", str(src), "--review", "false", "--output", "json-report"]) == 0  # the cache knows
    assert json.loads(capsys.readouterr().out)["scan"]["cache_hits"] == 1
    assert cli.main(["scan", str(src), "--dry-run", "--review", judge]) == 1
    assert capsys.readouterr().out.endswith("1 findings (1 critical)\n")
    assert cli.main(["prune", str(tmp_path / "cache"), "--ttl", "0"]) == 0 and capsys.readouterr().out == "0\n"
    (tmp_path / "notes.txt").write_text("mine")
    for target in (str(tmp_path), str(tmp_path / "notes.txt")):
        assert cli.main(["scan", str(src), "--write-baseline", target]) == 2
    assert (tmp_path / "notes.txt").read_text() == "mine"
