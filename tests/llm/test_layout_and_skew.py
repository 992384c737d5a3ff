"""The same rows in other files, hot keys, clashing columns and empty tables."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillscan.llm import language, near_dedup, toxicity, warc
from tests.llm.test_filters import _rows

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def dealt(spark, tmp_path_factory):
    """The same documents and labels in one file, and shuffled over fifty."""
    docs, labels = _rows(400, seed=6)
    out = []
    for files in (1, 50):
        path = tmp_path_factory.mktemp("dealt")
        random.Random(files).shuffle(docs)
        random.Random(files).shuffle(labels)
        spark.createDataFrame(docs, DOCS).repartition(files).write.parquet(str(path / "documents.parquet"))
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int").repartition(files).write.parquet(str(path / "labels.parquet"))
        out.append(str(path))
    return out


@pytest.mark.parametrize("op", [toxicity.op3, language.op4])
def test_predictions_do_not_depend_on_files(spark, dealt, op):
    one, fifty = (sorted(map(tuple, op(spark, path).collect())) for path in dealt)
    assert one == fifty


def test_the_limit_of_rejection_is_calibrated(spark, dealt):
    models = [language.fit(spark.read.parquet(f"{path}/documents.parquet")) for path in dealt]
    assert models[0].reject == models[1].reject > 0 and models[0].rates == models[1].rates
    assert models[0].rates["known"] <= language.REFUSED and models[0].rates["noise"] > 0.5


def test_components_of_a_hub_of_most_edges(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "MOST_SENT", 0)  # joins, not broadcasts
    edges = [(0, k) for k in range(1, 3000)] + [(k, k + 1) for k in range(5000, 5200)] + [(9000, 9001), (9001, 9000), (9002, 9002)]
    got = {r["node"]: r["root"] for r in near_dedup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[k] for k in range(1, 3000)} == {0} and {got[k] for k in range(5001, 5201)} == {5000} and got[9001] == 9000 and 9002 not in got


def test_a_giant_group_of_near_copies_without_broadcasts(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "MOST_SENT", 0)
    r = random.Random(4)
    base = [f"w{r.randrange(300)}" for _ in range(100)]
    texts = [" ".join([*base[:k], f"x{k}", *base[k:]]) for k in range(100)] + [" ".join(f"y{r.randrange(300)}" for _ in range(60)) for _ in range(8)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x["doc_id"]: x["component_id"] for x in near_dedup.find(df).collect()}
    assert got == {i: 0 if i < 100 else i for i in range(108)}


@pytest.mark.parametrize("most", [warc.MOST_COPIES, 0])
def test_archive_of_a_payload_that_most_pages_share(spark, tmp_path, monkeypatch, most):
    monkeypatch.setattr(warc, "MOST_COPIES", most)
    rows = [(i, f"http://h/{i}", "<p>same</p>" * 200 if i % 10 else f"<p>{i}</p>", "a", b"b", "c", 1) for i in range(600)]
    spark.createDataFrame(rows, "page_id long, url string, html string, id string, payload binary, sha256 string, size int").repartition(7).write.parquet(str(tmp_path / "pages.parquet"))
    got = warc.op8(spark, str(tmp_path)).collect()
    assert Counter((r["record_type"], r["refers_to"]) for r in got) == {("revisit", 599): 539, ("response", None): 61}
    for r in got:
        assert r["payload_bytes"] == len(rows[r["page_id"]][2])


CLASHING = ["_row", "_text", "score", "predicted", "lang_pred", "_language", "component_id", "kept", "held_out"]


def test_stages_keep_clashing_columns(spark, dealt):
    import corpus_pipeline

    docs = spark.read.parquet(f"{dealt[0]}/documents.parquet").withColumns({c: F.concat(F.lit(f"{c} of "), F.col("doc_id")) for c in CLASHING})
    twice = docs.where("doc_id < 5").withColumn("text", F.lit("another text of a known id, with words of its own, that nobody else has at all"))
    docs = docs.unionByName(twice.where("doc_id = 3"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, dealt[0])
        rows = docs.collect()
        assert rows and all(r[c] == f"{c} of {r['doc_id']}" for r in rows for c in CLASHING)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, dealt[0]).count() >= len(rows)


def test_the_pipeline_over_empty_tables(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([], DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
