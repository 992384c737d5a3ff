"""Joins, ranks and sweeps with a key that has most of the rows, against brute force."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from quillscan.operators import relations
from quillscan.sources.shared import saved


@pytest.fixture(scope="module")
def hot(spark):
    r = random.Random(3)
    rows = [("hot" if r.random() < 0.9 else r.choice(["a", "b", None, "c"]), k, r.randrange(100)) for k in range(4000)]
    return rows, spark.createDataFrame(rows, "key string, n int, v long").repartition(5)


@pytest.mark.parametrize("by", ["rows", "values"])
def test_ranks_within_a_hot_key(hot, by):
    rows, df = hot
    got = relations.ranked(df, ["key"], ["n"], "rank", None if by == "rows" else F.col("v"))
    seen, want = defaultdict(int), {}
    for key, n, v in sorted(rows, key=lambda x: x[1]):
        want[n] = seen[key]
        seen[key] += 1 if by == "rows" else v
    assert {r["n"]: r["rank"] for r in got.collect()} == want


def test_ranges_of_a_hot_key_are_of_one_size(spark, hot):
    """The rows that a window takes at once: no task has over twice the median."""
    saved = relations.saved
    sizes = []

    def spy(df, name):
        out = saved(df, name)
        if name == "ranked":
            sizes.extend(r["count"] for r in out.groupBy("_part").count().collect())
        return out

    relations.saved = spy
    try:
        relations.ranked(hot[1], ["key"], ["n"]).count()
    finally:
        relations.saved = saved
    assert len(sizes) == 4 and max(sizes) <= 2 * sorted(sizes)[len(sizes) // 2]


def test_bag_difference_with_a_hot_fingerprint(spark, hot):
    rows, df = hot
    base = {"hot": 1234, "a": 3, "b": 10**6, "other": 5, "c": 0}
    got = relations.bag_difference(df, spark.createDataFrame(list(base.items()), "key string, cnt long"), "key", ["n"])
    assert sorted(got.columns) == ["key", "n", "v"]
    seen, want = defaultdict(int), set()
    for key, n, _ in sorted(rows, key=lambda x: x[1]):
        seen[key] += 1
        if seen[key] > base.get(key, 0):
            want.add(n)
    assert {r["n"] for r in got.collect()} == want


def test_first_seen_with_a_hot_key(spark, hot):
    rows, df = hot
    df = df.withColumns({"list": F.array("n"), "map": F.create_map(F.lit("k"), "n")})
    want = {}
    for key, n, v in rows:
        if key not in want or (v, n) < want[key]:
            want[key] = v, n
    for some in (df, df.drop("map")):  # a map can't be compared
        got = relations.first_seen(some, ["key"], ["v", "n"])
        assert got.columns == some.columns and {r["key"]: (r["v"], r["n"]) for r in got.collect()} == want
    plan = relations.first_seen(df.drop("map"), ["key"], ["v", "n"])._jdf.queryExecution().toString()
    assert "Window" not in plan and "partial_min" in plan


def test_a_budget_of_a_hot_project(spark, hot):
    rows, df = hot
    seen, want = defaultdict(int), set()
    for key, n, v in sorted(rows, key=lambda x: x[1]):
        if seen[key] < 5000:
            want.add(n)
        seen[key] += v
    got = relations.within_budget(df.where("key is not null"), "n", "v", 5000, "key")
    assert {r["n"] for r in got.collect()} == {n for n in want if rows[n][0] is not None}


def test_innermost_spans_equal_brute_force(spark):
    r = random.Random(8)
    spans = [(r.choice("ab"), f"f{k}", s := r.randrange(1, 200), s + r.randrange(0, 60), k) for k in range(150)] + [("c", "only", 5, 5, 0), ("a", None, 3, 500, 999), ("a", "open", 3, None, 0)]
    points = [(f, n) for f in "abcd" for n in range(1, 230)] + [("a", 7)] * 3
    got = relations.innermost(spark.createDataFrame(points, "file string, line int"), spark.createDataFrame(spans, "file string, name string, s int, e int, ord int")).collect()

    def best(f, n):
        over = [(s, -k, name) for g, name, s, e, k in spans if g == f and e is not None and s <= n <= e]
        return max(over, key=lambda x: x[:2])[2] if over else None

    assert {(x["file"], x["line"]): x["name"] for x in got} == {p: best(*p) for p in points} and len(got) == len(set(points))


def test_a_file_of_very_many_lines_is_swept_in_one_pass(spark):
    n = 100_000
    points = spark.range(1, n + 1).select(F.lit("f").alias("file"), F.col("id").alias("line"))
    spans = spark.range(0, n, 2).select(F.lit("f").alias("file"), F.col("id").cast("string").alias("name"), F.col("id").alias("s"), F.greatest(F.col("id") + 1, F.when(F.col("id") % 1000 == 0, F.col("id") + 999)).alias("e"), F.col("id").alias("ord"))
    got = relations.innermost(points, spans)
    assert got.where("name is null").count() == 1 and got.where(F.col("name") == (F.col("line") - F.col("line") % 2).cast("string")).count() == n - 1


def test_triage_counts_wrong_unlabelled_and_silent(spark):
    from quillscan.operators import text_rules

    keys = "file string, line long, rule_id string"
    verdicts = spark.createDataFrame([("a", 1, "R", True), ("a", 1, "R", False), ("a", 2, "R", False), ("b", 1, "R", True), (None, 3, "R", True), ("c", 9, "R", None), ("d", 1, "R", True)], f"{keys}, confirmed boolean")
    labels = spark.createDataFrame([("a", 1, "R", True), ("a", 2, "R", False), ("b", 1, "R", False), (None, 3, "R", True), ("c", 9, "R", True), ("e", 1, "R", None)], f"{keys}, is_real boolean")
    assert text_rules.triage(verdicts, labels).first().asDict() == {"labelled": 5, "confirm_recall": 2 / 3, "dismiss_rate": 0.5, "accuracy": 0.6, "wrong": 1, "unlabelled": 1, "silent": 1}
    assert text_rules.triage(verdicts.limit(0), labels.limit(0)).first().asDict() == {"labelled": 0, "confirm_recall": None, "dismiss_rate": None, "accuracy": None, "wrong": 0, "unlabelled": 0, "silent": 0}


def test_edges_tell_their_order(spark):
    from quillscan.operators import taint

    text = "def z(x):\n    b(a(x))\ndef a(x):\n    z(x)\n    b(x)\ndef b(x):\n    pass\n"
    rows = taint.call_edges(spark.createDataFrame([("f", "python", text)], "path string, lang string, content string")).orderBy("path", "ord").collect()
    assert [(r["line"], r["caller"], r["callee"], r["ord"]) for r in rows] == [(2, "z", "a", 0), (2, "z", "b", 1), (4, "a", "z", 2), (5, "a", "b", 3)]


def test_closure_deals_only_what_the_last_peel_leaves(spark, monkeypatch):
    """A cycle with tails, fans of ends and ends of two sources: pairs and hops by search, and no pair of an outermost end is written."""
    edges = [(0, 1), (1, 2), (2, 0), (2, 3), (3, 4)] + [(k, 100 + 50 * k + j) for k in range(5) for j in range(50)] + [(k, 900) for k in (1, 4)] + [(7, 8), (8, 9)]
    after = defaultdict(set)
    for a, b in edges:
        after[a].add(b)

    written = {}
    saved = relations.saved

    def spy(df, name):
        out = saved(df, name)
        written[name] = written.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(relations, "saved", spy)
    df = spark.createDataFrame([*edges, edges[0]], "src long, dst long")
    rows = [tuple(r) for r in relations.closure(df).collect()]
    want = {}
    for a in list(after):
        seen, front, n = {}, after[a], 0
        while front:
            n += 1
            seen |= dict.fromkeys(front, n)
            front = {y for x in front for y in after.get(x, ()) if y not in seen}
        want |= {(a, b): k for b, k in seen.items()}
    assert len(rows) == len(want) and {(a, b): n for a, b, n in rows} == want
    assert written["closure"] < len(want) / 4
    got = {r["node"]: r["hops"] for r in relations.reached(df, spark.createDataFrame([(4,), (7,), (900,), (55,)], "node long")).collect()}
    assert got == {4: 0, 7: 0, 900: 0, 55: 0, 8: 1, 9: 2} | {300 + j: 1 for j in range(50)}


def test_a_peel_writes_its_edges_once(spark, monkeypatch):
    written = []
    monkeypatch.setattr(relations, "saved", lambda df, name: written.append(name) or saved(df, name))
    pairs = [(0, k) for k in range(1, 40)] + [(1, k) for k in range(30, 50)] + [(2, 0), (2, 3), (2, 3), (60, 2), (3, 60), (None, 4), (4, None), (70, 71)]
    edges = spark.createDataFrame(pairs, "src long, dst long")
    for starts in ([0], [2, 60], [70], [5], []):
        hops, front, k = {s: 0 for s in starts}, set(starts), 0
        while front:
            k, front = k + 1, {b for a, b in pairs if a in front and b is not None} - set(hops)
            hops |= dict.fromkeys(front, k)
        got = relations.reached(edges, spark.createDataFrame([(s,) for s in [*starts, *starts, None]], "node long"))
        assert sorted(map(tuple, got.collect())) == sorted(hops.items()), starts
    written.clear()
    whole, peels = relations._peeled(edges)
    assert len(peels) == 2 and written == ["edges"] * 3  # one for each peel tried
    assert {tuple(r) for r in whole.collect()} == {(0, 2), (0, 3), (2, 0), (2, 3), (60, 2), (3, 60)}
    assert {tuple(r) for r in peels[0][1].collect()} >= {(0, 30), (1, 30)} and (70, 71) in {tuple(r) for r in peels[0][0].collect()}
    assert [tuple(r) for r in peels[1][0].collect()] == [(0, 1)]
