"""Scanner, scan plan, filters, reports, sources and command line."""

import json
import random
import subprocess

import pytest

from quillscan import cli, config
from quillscan.functions import flow, lexer
from quillscan.operators import custom_rules, enrich, relations, rules
from quillscan.plans import report, scan, table_queries
from quillscan.sources import diffs, repository
from quillscan.sources.tables import source_files


def _files(spark, *rows):
    return spark.createDataFrame(rows, "path string, lang string, content string")


def test_broken_text_never_stops_the_scan(spark):
    texts = ["foo(", "'open\nnext(`", "((((]]}})", "f'{", "\r\nx(1)\r\n", "名(提示 + 'a')", '"""', "/* open", "<?php \"$a{", None, ""]
    rows = [(f"{k}{lang}", lang, t) for k, t in enumerate(texts) for lang in ("javascript", "python", "go", "java", "php")]
    assert scan.findings(_files(spark, *rows)).count() >= 0
    for t in texts:
        for lang in ("javascript", "python", "go", "java", "php"):
            lexer.Source(t or "", lang).nodes()


def test_arguments_split_at_top_level():
    assert lexer.split_args("a, f(b, c), 'x,y', [1, {k: 2}]") == ["a", "f(b, c)", "'x,y'", "[1, {k: 2}]"]
    assert lexer.split_args("  ") == []


def test_masking_keeps_offsets():
    text = "a = 'x' # no\nb"
    assert lexer.masked(text, "python") == "a =         \nb"[:12] + "\nb" and len(lexer.masked(text, "python")) == len(text)


def test_nested_matches_are_reported_once(spark):
    files = _files(spark, ("a.js", "javascript", "db.query(`a ${db.query(`b ${c}`)}`)\ndb.query(`c ${d}`)"))
    rows = [r for r in scan.findings(files).collect() if r["rule_id"] == "CG-001"]
    assert [(r["line"], r["sc"]) for r in sorted(rows, key=lambda r: r["line"])] == [(1, 0), (2, 0)]


def test_blank_lines_keep_fingerprints_and_directives_remove_one(spark):
    one = _files(spark, ("a.py", "python", "eval(x)\nos.system('a' + b)\n"))
    two = _files(spark, ("a.py", "python", "\n\neval(x)\nos.system('a' + b)\n"))
    three = _files(spark, ("a.py", "python", "eval(x)  # scan-ignore\nos.system('a' + b)\n"))
    prints = lambda f: sorted(r["fingerprint"] for r in scan.findings(f).collect())
    assert prints(one) == prints(two) and len(prints(three)) == len(prints(one)) - 1


def test_baseline_of_itself_leaves_nothing_and_counts_copies(spark):
    text = "eval(x)\neval(x)\n"
    once = scan.findings(_files(spark, ("a.py", "python", text)))
    base = report.baseline(once)
    assert base.first()["cnt"] == 2
    assert scan.findings(_files(spark, ("a.py", "python", text)), scan.Options(baseline=base)).count() == 0
    assert scan.findings(_files(spark, ("a.py", "python", text + "eval(x)\n")), scan.Options(baseline=base)).count() == 1


def test_changed_lines(spark):
    files = _files(spark, ("a.py", "python", "eval(x)\neval(y)\n"))
    line = lambda n: spark.createDataFrame(n, "file string, line long")
    assert [r["line"] for r in scan.findings(files, scan.Options(changed=line([("a.py", 2)]))).collect()] == [2]
    assert scan.findings(files, scan.Options(changed=line([]))).count() == 0
    assert scan.findings(files, scan.Options(changed=line([("a.py", 1), ("a.py", 2)]))).count() == 2


def test_severity(spark):
    files = _files(spark, ("a.py", "python", "eval(x)\nhashlib.new('md5')\n"))
    assert {r["rule_id"] for r in scan.findings(files, scan.Options(severity="high")).collect()} == {"CG-003"}
    with pytest.raises(ValueError):
        scan.findings(files, scan.Options(severity="huge"))


def test_ranges_of_unknown_files_filter_nothing(spark):
    points = spark.createDataFrame([("a", 1), ("a", 5), ("b", 9)], "file string, line int")
    ranges = spark.createDataFrame([("a", 4, 6)], "file string, s int, e int")
    assert sorted(map(tuple, relations.in_ranges(points, ranges).collect())) == [("a", 5), ("b", 9)]


def _closure(edges):
    after, out = {}, {}
    for a, b in edges:
        after.setdefault(a, set()).add(b)
    for src in after:
        front, hops = after[src], 0
        while front:
            hops += 1
            out |= {(src, x): hops for x in front}
            front = {y for x in front for y in after.get(x, ()) if (src, y) not in out}
    return out


def test_reachability_over_all_edges_to_the_fixpoint(spark, tmp_path):
    r = random.Random(4)
    edges = [(k, k + 1) for k in range(1, 40)] + [(40, 1), (7, 7), (7, 7), (500, 40)]  # longer than any fixed number of steps
    edges += [(r.randrange(100, 160), r.randrange(100, 160)) for _ in range(75)]
    spark.createDataFrame([*edges, (None, 3), (3, None)], "o_custkey long, o_orderkey long").write.parquet(str(tmp_path / "orders.parquet"))
    rows = table_queries.queries()["call_reachability"](spark, str(tmp_path)).collect()
    want = _closure(edges)
    assert len(rows) == len(want) and {(x["src"], x["dst"]): x["hops"] for x in rows} == want
    assert max(want.values()) == 40


def test_reachability_ends_on_cycles(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "src string, dst string")
    assert relations.closure(e).count() == 9
    got = {r["node"]: r["hops"] for r in relations.reached(e, spark.createDataFrame([("b",), ("b",), (None,)], "node string")).collect()}
    assert got == {"b": 0, "c": 1, "a": 2}


def test_hash_sample(spark):
    df = spark.createDataFrame([(f"p{k}",) for k in range(11)], "path string")
    assert relations.hash_sample(df, "path", 0.2, "s").count() == 3
    assert relations.hash_sample(df, "path", 0.0, "s").count() == 0
    assert relations.hash_sample(df, "path", 1.0, "s").count() == 11
    with pytest.raises(ValueError):
        relations.hash_sample(df, "path", 1.1, "s")


def test_budget_keeps_the_crossing_call(spark):
    df = spark.createDataFrame([(k, 4.0) for k in range(5)], "n int, cost double")
    assert sorted(r["n"] for r in relations.within_budget(df, "n", "cost", 10.0).collect()) == [0, 1, 2]


def test_diff_bodies_that_look_like_heads():
    assert diffs.parse("--- a/x\n+++ b/x\tnow\n@@ -1,2 +1,2 @@\n-a\n+++ y\n z\n\\ No newline\n") == [("x", 1)]
    assert diffs.parse("") == []
    with pytest.raises(ValueError):
        diffs.parse("hello")


def test_diff_ranges(spark):
    text = "+++ b/x\n@@ -1 +3,2 @@\n@@ -5,2 +9,0 @@\n+++ b/y\n@@ -1 +7 @@\n"
    df = spark.createDataFrame([("d", k, t) for k, t in enumerate(text.split("\n"))], "id string, line_no int, line string")
    assert sorted(map(tuple, diffs.changed_ranges(df, "id").collect())) == [("d", "x", 3, 4), ("d", "y", 7, 7)]


def test_two_readings_of_flow():
    clean = "def f():\n    a = input()\n    a = 'x'\n    os.system(a)\n"
    assert len(flow.local_flows(clean, "python")) == 1 and flow.cross_flows(clean, "python") == []
    back = "def f():\n    return os.system(input())\n"
    assert len(flow.local_flows(back, "python")) == 1 and flow.cross_flows(back, "python") == []
    loop = "def f(a):\n    g(a)\ndef g(b):\n    f(b)\n    eval(b)\ndef h():\n    f(input())\n"
    assert [len(p["calls"]) for p in flow.cross_flows(loop, "python")] == [2]
    assert flow.edges(loop, "python") == [("f", "g", 2), ("g", "f", 4), ("h", "f", 7)]
    ret = "def read():\n    return input()\ndef run():\n    v = read()\n    os.system(v)\n"
    assert [(p["source_line"], p["sink_line"], len(p["calls"])) for p in flow.cross_flows(ret, "python")] == [(2, 5, 1)]


def test_review_fails_open_and_cache_expires(spark):
    df = spark.createDataFrame([("yes", "k1"), ("bad", "k2"), ("no", "k3")], "prompt string, key_hash string")

    def ask(p):
        if p == "bad":
            raise RuntimeError("down")
        return "```json\n{\"confirmed\": %s, \"confidence\": 7, \"reasoning\": \"r\"}\n```" % ("true" if p == "yes" else "false")

    got = {r["prompt"]: (r["outcome"], r["verdict_confidence"]) for r in enrich.partition(enrich.review(df, ask)).collect()}
    assert got == {"yes": ("confirmed", 1.0), "bad": ("kept", None), "no": ("dismissed", 1.0)}
    store = spark.createDataFrame([("k1", True, 900_000, 1), ("k2", True, 0, 1), ("k3", True, 999_000, 0)], "key_hash string, confirmed boolean, cached_at long, schema_version int")
    hit, miss = enrich.through_cache(df, store, 1_000_000, 500, 1)
    assert [r["key_hash"] for r in hit.collect()] == ["k1"] and {r["key_hash"] for r in miss.collect()} == {"k2", "k3"}
    assert enrich.through_cache(df, store, 10**12, 0, 1)[0].count() == 2


def test_reports(spark):
    found = scan.findings(_files(spark, ("a.py", "python", "eval(```x```)\n")))
    body = report.review_comments(found).first()["body"]
    assert body.startswith("**CRITICAL** CG-003 (60%)") and "````\n" in body
    assert json.loads(report.json_lines(found).first()["value"])["cwe"] == 95
    row = report.sarif_results(found).first()
    assert (row["start_line"], row["start_column"], row["level"]) == (1, 1, "error")
    assert report.fails(found, "none", rules.RANK).first()["fails"] is False


def test_rule_documents(spark, tmp_path):
    (tmp_path / "a.yml").write_text(config.RULE_SCAFFOLD)
    docs = custom_rules.documents(str(tmp_path))
    files = _files(spark, ("a.py", "python", "run('a' + b)\nrun('c')\n"))
    assert [r["line"] for r in scan.findings(files, scan.Options("none", custom_rules.compile_rules(docs))).collect()] == [1]
    (tmp_path / "b.yaml").write_text(config.RULE_SCAFFOLD)
    with pytest.raises(custom_rules.RuleError, match="repeat"):
        custom_rules.documents(str(tmp_path))
    for text in ("a: [", "id: X-9\n", config.RULE_SCAFFOLD.replace("medium", "dire"), config.RULE_SCAFFOLD.split("patterns")[0] + "patterns: [{}]\n"):
        (tmp_path / "c.yml").write_text(text)
        with pytest.raises(custom_rules.RuleError):
            custom_rules.documents(str(tmp_path / "c.yml"))
    with pytest.raises(custom_rules.RuleError):
        custom_rules.documents(str(tmp_path / "none"))


def test_settings(tmp_path):
    assert config.load(str(tmp_path), env={}).lanes == 5
    config.scaffold(str(tmp_path / ".quillscan.yml"))
    assert config.load(str(tmp_path), env={"QUILLSCAN_MAX_COST": "2.5"}).max_cost == 2.5
    with pytest.raises(config.ConfigError):
        config.scaffold(str(tmp_path / ".quillscan.yml"))
    (tmp_path / "x.json").write_text('{"lanes": 99}')
    with pytest.raises(config.ConfigError):
        config.load(path=str(tmp_path / "x.json"), env={})


def test_addresses(monkeypatch):
    kinds = {"https://a/b": "https", "git@h:a/b": "ssh", "ext::sh": "ext", "/a/b": "file", "FILE:///a": "file"}
    assert {u: repository.scheme(u) for u in kinds} == kinds
    assert not repository.allowed("/a/b")
    monkeypatch.setenv("QUILLSCAN_GIT_SCHEMES", "file")
    assert repository.allowed("/a/b") and not repository.allowed("https://a/b")
    assert repository.safe_ref("main~1") and not repository.safe_ref("--output=x") and not repository.safe_ref("a..b")


def test_command_line(spark, tmp_path, capsys):
    src = tmp_path / "src"
    (src / "node_modules").mkdir(parents=True)
    (src / "a.py").write_text("eval(x)\n")
    (src / "b.rb").write_text("eval(x)\n")
    (src / "node_modules/c.js").write_text("eval(x)\n")
    assert {r["path"]: r["lang"] for r in source_files(spark, str(src)).collect()} == {"a.py": "python", "b.rb": None}
    assert cli.main(["scan", str(src), "--output", "json"]) == 1
    assert json.loads(capsys.readouterr().out)["file"] == "a.py"
    assert cli.main(["scan", str(src), "--fail-on", "none"]) == 0
    base = str(tmp_path / "base.json")
    assert cli.main(["scan", str(src), "--write-baseline", base]) == 0
    assert cli.main(["scan", str(src), "--baseline", base]) == 0
    assert cli.main(["scan", str(src), "--baseline", base, "--write-baseline", base]) == 2
    assert cli.main(["scan", str(tmp_path / "none")]) == 2
    (tmp_path / "odd.json").write_text('{"version": 2}')
    assert cli.main(["scan", str(src), "--baseline", str(tmp_path / "odd.json")]) == 2
    assert "CG-001" in cli.rule_table()


def test_git_diff_scopes_a_scan(spark, tmp_path, capsys):
    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=t", "-c", "user.email=t@example.com", *a], check=True, capture_output=True)
    git("init", "-q", "-b", "main")
    (tmp_path / "a.py").write_text("eval(x)\n")
    git("add", ".")
    git("commit", "-qm", "one")
    (tmp_path / "a.py").write_text("eval(x)\neval(y)\n")
    git("commit", "-qam", "two")
    text = repository.diff(str(tmp_path), "main~1", "main")
    assert diffs.parse(text) == [("a.py", 2)]
    (tmp_path / "d.diff").write_text(text)
    cli.main(["scan", str(tmp_path), "--diff", str(tmp_path / "d.diff"), "--output", "json"])
    assert [json.loads(x)["line"] for x in capsys.readouterr().out.splitlines()] == [2]


def test_watch(spark, tmp_path):
    from quillscan.streaming import watch

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.py").write_text("eval(x)\n")
    watch.watch(watch.arriving(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    (tmp_path / "in/b.py").write_text("eval(y)\neval(z)\n")
    watch.watch(watch.arriving(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3


def test_sarif_document_and_expectations(spark, tmp_path, capsys):
    from quillscan.operators import text_rules

    text = "eval(x)  # scan-expect CG-003\nos.system('a' + b)  # scan-expect CG-002, CG-001\n"
    files = _files(spark, ("a.py", "python", text))
    lined = spark.createDataFrame([("a.py", k, t) for k, t in enumerate(text.split("\n"), 1)], "file string, line_no long, line string")
    row = text_rules.scores(scan.findings(files), text_rules.expectations(lined)).first()
    assert (row["tp"], row["fp"], row["fn"], row["precision"]) == (2, 0, 1, 1.0)
    (tmp_path / "a.py").write_text(text)
    assert cli.main(["scan", str(tmp_path), "--output", "sarif"]) == 1
    run = json.loads(capsys.readouterr().out)["runs"][0]
    assert [r["id"] for r in run["tool"]["driver"]["rules"]] == ["CG-002", "CG-003"] and len(run["results"]) == 2
