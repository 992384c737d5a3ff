"""What tasks hold doesn't grow with the input: tasks follow rows, batches are bounded, files are scanned once."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillscan.sources import shared


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def small(monkeypatch):
    """Tasks of 50 rows: 1000 rows are dealt over 20."""
    monkeypatch.setattr(shared, "ROWS_A_TASK", 50)


def test_tasks_of_ranges_follow_rows(spark, small, tmp_path):
    from quillscan.plans import table_queries

    spark.range(1000).select((F.col("id") % 300).alias("l_orderkey"), (F.col("id") % 7 + 1).cast("int").alias("l_linenumber")).write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.range(200).select(F.col("id").alias("o_orderkey"), F.col("id").alias("o_custkey"), F.when(F.col("id") % 2 == 0, "P").otherwise("F").alias("o_orderstatus")).write.parquet(str(tmp_path / "orders.parquet"))
    out = table_queries.diff_range_nullable(spark, str(tmp_path))
    assert "hashpartitioning(file" in _plan(out) and ", 20)" in _plan(out)
    points = {(k % 300, k % 7 + 1) for k in range(1000)}
    assert {tuple(r) for r in out.collect()} == {(f, n) for f, n in points if f >= 200 or f % 2 == 0 or f % 7 + 1 <= n <= f % 7 + 2}


def test_a_review_scans_files_once(spark, monkeypatch, tmp_path):
    from quillscan.plans import finding_queries

    spark.range(60).select(F.col("id").alias("p_partkey"), F.lit(1).alias("p_size")).write.parquet(str(tmp_path / "part.parquet"))
    seen = []
    run = finding_queries.review.run
    monkeypatch.setattr(finding_queries.review, "run", lambda found, *a, store, **k: seen.extend([_plan(found), _plan(store)]) or run(found, *a, store=store, **k))
    assert finding_queries.review_costs(spark, str(tmp_path)).count() == 1
    assert len(seen) == 2 and not any("MapInArrow" in x for x in seen)


def test_tasks_of_scores_follow_rows(spark, small):
    from quillscan.operators import text_rules

    lined = spark.range(1000).select(F.col("id").alias("file"), F.lit(1).alias("line_no"), F.lit("x  # scan-expect: CG-1").alias("line"))
    found = spark.range(500, 1500).select(F.col("id").alias("file"), F.lit(1).alias("line"), F.lit("CG-1").alias("rule_id"))
    out = text_rules.scores(found, text_rules.expectations(lined, rows=1000), 1000)
    assert _plan(out).count(", 20), ") == 2  # each side is dealt once
    assert out.first().asDict() == {"tp": 500, "fp": 500, "fn": 500, "precision": 0.5, "recall": 0.5}


def test_tasks_of_trees_follow_nodes(spark, small):
    from quillscan.operators import syntax
    from quillscan.plans import syntax_queries

    files = spark.range(100).select(F.col("id").cast("string").alias("path"), F.lit("python").alias("lang"), F.lit("f(x)\n").alias("content"))
    nodes = syntax_queries._trees(files)
    n = nodes.count()
    assert n > 300 and nodes.rdd.getNumPartitions() == -(-n // 50)
    sums = syntax.subtree_sums(nodes, F.lit(1), "all")
    assert _plan(sums).count("Exchange") == 1  # the windows need no dealing of their own
    assert sums.where("pre = 0 and all <> last + 1").count() == 0


def test_rows_of_files_are_given_in_bounded_batches():
    from quillscan.operators import parse

    class Files:
        columns = ("path", "lang", "content")

        def where(self, *_):
            return self

        select = where

        def mapInArrow(self, work, _):
            return work

    taken = []

    def read(path, lang, content):
        taken.append(path)
        if path == "p7":
            raise ValueError("odd")
        for k in range(3):
            yield path, k

    work = parse.tabled(Files(), "path string, n long", read, lambda path, lang, error: (path, -1))
    files = pa.RecordBatch.from_pydict({"path": [f"p{k}" for k in range(10_000)], "lang": ["x"] * 10_000, "content": [""] * 10_000})
    batches = work(iter([files]))
    first = next(batches)
    assert len(taken) < 1000  # the first rows are given long before the last file is read
    sizes = [first.num_rows, *(b.num_rows for b in batches)]
    assert max(sizes) < parse.ROWS_AT_ONCE + 3 and sum(sizes) == 3 * 9_999 + 1 and len(taken) == 10_000


def test_heads_of_one_long_diff_are_read_by_many_tasks(spark, small, monkeypatch):
    """A diff over many ranges, with bodies that last over ranges and hold lines like heads, is read as by parse; no task has half of its heads."""
    import random

    from quillscan.sources import diffs

    r, text = random.Random(5), []
    for k in range(120):
        if r.random() < 0.6:
            text.append("+++ " + r.choice([f"b/f{k}.py", f"b/f{k}.py\t2024", "/dev/null"]))
        old, new = r.choice([(0, 3), (2, 2), (5, 9), (80, 130)] if k % 9 == 0 else [(0, 3), (2, 2), (5, 9)])
        text.append(f"@@ -1,{old} +{10 * k},{new} @@")
        while old or new:
            if old and (not new or r.random() < 0.5):
                x = r.choice([" a", "@@ -1,2 +5,60 @@"]) if new else "-x"
                old, new = old - 1, new - (x[0] != "-")
            else:
                x, new = r.choice(["+x", "+++ b/not.py", "+++ c"]), new - 1
            text.append(x)
    assert len(text) > 1000
    tasks, saved = [], diffs.saved

    def spy(df, name):
        out = saved(df, name)
        if name == "heads" and not tasks:
            tasks.extend(x["count"] for x in out.groupBy(F.input_file_name()).count().collect())
        return out

    monkeypatch.setattr(diffs, "saved", spy)
    lined = spark.createDataFrame([("d", k, x) for k, x in enumerate(text)], "id string, line_no long, line string")
    got = sorted((x["file"], x["line"]) for x in diffs.added_lines(lined, "id").collect())
    assert got == sorted(diffs.parse("\n".join(text)))
    assert max(tasks) < sum(tasks) / 2


def test_lines_of_a_long_diff_are_dealt_and_written_once(spark, small, monkeypatch):
    """Tables hold a row for many lines, the result deals none, and rows whose heads stand in bodies from rows before are read as by parse."""
    import random

    from quillscan.sources import diffs

    r, text = random.Random(11), []
    for k in range(150):
        text += ["+++ b/f.py", "@@ -1,%d +%d,%d @@" % (n := r.choice([0, 0, 3, 70]), k, n + 30), *r.choices([" a", "+b", "@@ -1,90 +4,90 @@", "+++ b/g.py", "-c"], k=r.choice([5, 40, 80]))]
    written = []

    def counted(df, name, _saved=diffs.saved):
        out = _saved(df, name)
        written.append((name, out.count()))
        return out

    monkeypatch.setattr(diffs, "saved", counted)
    monkeypatch.setattr(diffs, "LINES_A_ROW", 25)
    lined = spark.createDataFrame([("d", k, x) for k, x in enumerate(text)], "id string, line_no long, line string").repartition(3)
    found = diffs.added_lines(lined, "id")
    assert "Exchange hashpartitioning" not in _plan(found) and max(n for _, n in written) < len(text) / 10
    assert sorted((x["file"], x["line"]) for x in found.collect()) == sorted(diffs.parse("\n".join(text)))
