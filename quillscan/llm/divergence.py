"""Audit of how far the sources of a language diverge in their words, by SQL in shards.

A task counts its documents' terms with DuckDB, batch by batch, and adds them up before anything moves. Counts are dealt
by (lang, term), so a shard of one DuckDB query has all counts of its terms and tells which ones are frequent enough.
The kept terms of a language are dealt into shards again, by their hash; each shard meets its language's list of sources
and gives sums for every pair of sources and its own ten most telling terms a source. Both add up over shards: Spark
merges the sums and ranks them. All arithmetic is on integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillscan.llm.common import bounded_batches, give_back, saved

#: Documents of a language that a kept term is in at least; what is added to a term's count; the whole that shares are parts of; ranks of terms that are reported.
DOCUMENTS, ADDED, WHOLE, TOP = 10, 2, 1_000_000_000, 10
#: Bytes of text that one query takes apart; counted rows that a task holds before it adds them up; counts that one shard gets.
PIECE, HELD, SHARD = 1 << 20, 600_000, 100_000
#: Bytes of terms: A-Z in lower case, all of code points beyond ASCII; the others part terms.
_BYTES = bytes(c if c >= 0x80 or chr(c).islower() else ord(chr(c).lower()) if chr(c).isupper() else 0x20 for c in range(256))
COUNTS = "lang string, source string, term string, n long, docs long"
RESULT = "source string, part string, item string, value long"


def _database() -> duckdb.DuckDBPyConnection:
    """A database in memory of one thread, without files."""
    return duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "400MB", "temp_directory": ""})


def _pieces(texts: list[str]) -> Iterator[pa.Table]:
    """The numbers of rows and their terms, parted by spaces, in tables of about PIECE bytes; longer texts are cut between terms."""
    rows, parts, size = [], [], 0
    for row, text in enumerate(texts):
        data, at = text.encode("utf-8").translate(_BYTES), 0
        while at < len(data):
            end = at + PIECE
            end = len(data) if end >= len(data) or (cut := data.find(b" ", end)) < 0 else cut
            rows.append(row)
            parts.append(data[at:end])
            size += end - at
            at = end
            if size >= PIECE:
                yield pa.table({"row": rows, "terms": pa.array(parts, pa.binary()).cast(pa.string())})
                rows, parts, size = [], [], 0
    if rows:
        yield pa.table({"row": rows, "terms": pa.array(parts, pa.binary()).cast(pa.string())})


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of a task's documents (text, lang, source)."""
    groups: dict[tuple[str, str], int] = {}

    def out(db: duckdb.DuckDBPyConnection) -> Iterator[pa.RecordBatch]:
        names = pa.table({"g": pa.array(groups.values(), pa.int64()), "lang": pa.array([k for k, _ in groups], pa.string()), "source": pa.array([k for _, k in groups], pa.string())})
        db.register("names", names)
        yield from db.sql("SELECT lang, source, term, n, docs FROM mine JOIN names USING (g)").to_arrow_reader(10_000)
        db.unregister("names")

    with _database() as db:
        db.execute("CREATE TABLE mine (g BIGINT, term VARCHAR, n BIGINT, docs BIGINT)")
        size = lambda: db.sql("SELECT count(*) FROM mine").fetchall()[0][0]
        for batch in batches:
            of = [groups.setdefault(k, len(groups)) for k in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            db.register("of_", pa.table({"row": np.arange(len(of)), "g": pa.array(of, pa.int64())}))
            db.execute("CREATE OR REPLACE TABLE here (row BIGINT, term VARCHAR, n BIGINT)")
            for piece in _pieces(batch.column(0).to_pylist()):
                db.register("piece", piece)
                db.execute("INSERT INTO here SELECT row, term, count(*) FROM (SELECT row, unnest(string_split(terms, ' ')) AS term FROM piece) WHERE term <> '' GROUP BY ALL")
                db.unregister("piece")
            # pieces of one text may repeat a term: a document counts once
            db.execute("INSERT INTO mine SELECT g, term, sum(n), count(DISTINCT row) FROM here JOIN of_ USING (row) GROUP BY ALL")
            if size() > HELD:
                db.execute("CREATE OR REPLACE TABLE mine AS SELECT g, term, sum(n)::BIGINT AS n, sum(docs)::BIGINT AS docs FROM mine GROUP BY ALL")
                if size() > HELD // 2:
                    yield from out(db)
                    db.execute("DELETE FROM mine")
        db.execute("CREATE OR REPLACE TABLE mine AS SELECT g, term, sum(n)::BIGINT AS n, sum(docs)::BIGINT AS docs FROM mine GROUP BY ALL")
        yield from out(db)
    give_back()


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a shard's counts, added up, those of terms that enough documents of the language have."""
    with _database() as db:
        db.execute("CREATE TABLE mine (lang VARCHAR, source VARCHAR, term VARCHAR, n BIGINT, docs BIGINT)")
        for batch in batches:
            db.register("piece", pa.Table.from_batches([batch]))
            db.execute("INSERT INTO mine SELECT * FROM piece")
            db.unregister("piece")
        yield from db.sql(
            f"""WITH c AS (SELECT lang, source, term, sum(n)::BIGINT AS n, sum(docs)::BIGINT AS docs FROM mine GROUP BY ALL)
            SELECT lang, source, term, n, docs FROM c SEMI JOIN (SELECT lang, term FROM c GROUP BY ALL HAVING sum(docs) >= {DOCUMENTS}) USING (lang, term)"""
        ).to_arrow_reader(10_000)
    give_back()


#: p: share of a term in whole parts; f: how far two shares are apart.
_MACROS = f"""
CREATE MACRO share(n, total, v) AS (1 + ({WHOLE}::HUGEINT * (n + {ADDED})) // (total + {ADDED} * v))::BIGINT;
CREATE MACRO apart(p, q) AS ((p - q) * (p - q)) // (p + q);
"""
#: Of one shard: own, the sources' shares of terms that they have; met, for each ordered pair of sources the sums over the first one's terms.
_PAIRS = """
WITH met AS (
  SELECT e.source AS a, h.source AS b, sum(apart(e.p, coalesce(o.p, h.base))) AS mine,
         sum(CASE WHEN o.p IS NOT NULL THEN apart(e.p, o.p) ELSE 0 END) AS both_, count(o.p) AS shared
  FROM own e JOIN sources h ON h.source <> e.source LEFT JOIN own o ON o.term = e.term AND o.source = h.source GROUP BY ALL),
has AS (SELECT source, base, count(term) AS terms FROM sources LEFT JOIN own USING (source) GROUP BY ALL),
every AS (SELECT x.source AS a, y.source AS b, x.base AS p, y.base AS q, (SELECT count(DISTINCT term) FROM own) - x.terms - y.terms AS neither FROM has x JOIN has y ON x.source <> y.source)
SELECT a AS source, 'pair' AS part, b AS item,
       (coalesce(i.mine, 0) + coalesce(j.mine, 0) - coalesce(i.both_, 0) + (neither + coalesce(i.shared, 0)) * coalesce(apart(p, q), 0))::BIGINT AS value
FROM every LEFT JOIN met i USING (a, b) LEFT JOIN met j ON j.a = every.b AND j.b = every.a
"""
_TERMS = f"""
WITH whole AS (SELECT term, share(sum(n), any_value(s.lang_total), any_value(s.v)) AS q FROM own JOIN sources s USING (source) GROUP BY term)
SELECT source, 'term' AS part, term AS item, apart(p, q) AS value FROM own JOIN whole USING (term) WHERE p > q
QUALIFY row_number() OVER (PARTITION BY source ORDER BY value DESC, item) <= {TOP}
"""


def _shard(key, terms: pa.Table, sources: pa.Table) -> pa.Table:
    """Partial sums of pairs, and the most telling terms, of one shard of a language."""
    with _database() as db:
        db.execute(_MACROS)
        db.register("terms_", terms)
        db.register("sources_", sources)
        db.execute("CREATE TABLE sources AS SELECT source, total, lang_total, v, CASE WHEN v > 0 THEN share(0, total, v) END AS base FROM sources_")
        db.execute("CREATE TABLE own AS SELECT t.source, t.term, t.n, share(t.n, s.total, s.v) AS p FROM terms_ t JOIN sources s USING (source)")
        out = pa.concat_tables([db.sql(_PAIRS).to_arrow_table(), db.sql(_TERMS).to_arrow_table()])
    lang = pa.array([key[0].as_py()] * out.num_rows, pa.string())
    return out.add_column(0, "lang", lang).cast(pa.schema([("lang", pa.string()), ("source", pa.string()), ("part", pa.string()), ("item", pa.string()), ("value", pa.int64())]))


def audit(docs: DataFrame) -> DataFrame:
    """lang, source, part, item, value and rank for documents (text, lang, source); nulls are '', other columns are not read.

    Part `pair`: the divergence of a source from each other one of its language, over all kept terms (0 if there are
    none). Part `term`: its terms that stand out from the language most, TOP at most. Ties go to the item that is first
    in UTF-8. Repeated rows are documents of their own; an empty table gives no rows.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    clean = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")])
    groups = saved(clean.select("lang", "source").distinct(), "groups")
    counts = clean.mapInArrow(_counted, COUNTS).repartition("lang", "term")  # rows of one key: one a task and source, so none is hot
    kept = saved(counts.mapInArrow(_kept, COUNTS).drop("docs"), "terms")

    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("rows"))
    v = kept.select("lang", "term").distinct().groupBy("lang").agg(F.count("*").alias("v"))
    per = totals.groupBy("lang").agg(F.sum("total").alias("lang_total"), F.greatest(F.lit(1), F.ceil(F.sum("rows") / SHARD)).cast("int").alias("shards"))
    langs = saved(per.join(v, "lang"), "langs")
    known = groups.join(totals.drop("rows"), ["lang", "source"], "left").join(langs, "lang", "left")
    known = known.select("lang", "source", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("total", "lang_total", "v")], F.coalesce("shards", F.lit(1)).alias("shards"))
    sent = known.withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1))).drop("shards")
    dealt = kept.join(langs.select("lang", "shards"), "lang").select("lang", F.pmod(F.xxhash64("term"), F.col("shards")).cast("int").alias("shard"), "source", "term", "n")
    partial = saved(dealt.groupBy("lang", "shard").cogroup(sent.groupBy("lang", "shard")).applyInArrow(_shard, "lang string, " + RESULT), "partial")

    sums = partial.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    # a term is in one shard only
    found = sums.unionByName(partial.where("part = 'term'"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranked = found.withColumn("rank", F.row_number().over(order))
    return ranked.where((F.col("part") == "pair") | (F.col("rank") <= TOP))


def op11(spark, sf_dir: str) -> DataFrame:
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = """
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, lang, source, translate(unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d),
k AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN k USING (lang, term) GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
grid AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n FROM g JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
p AS (SELECT lang, source, term, n, 1 + (1000000000::HUGEINT * (n + 2)) // (sum(n) OVER (PARTITION BY lang, source) + 2 * v) AS p FROM grid JOIN v USING (lang)),
l AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (n + 2)) // (sum(n) OVER (PARTITION BY lang) + 2 * v) AS q FROM (SELECT lang, term, sum(n) AS n FROM c GROUP BY ALL) JOIN v USING (lang)),
pairs AS (SELECT g.lang, g.source, 'pair' AS part, o.source AS item, coalesce(x.value, 0) AS value
  FROM g JOIN g o ON o.lang = g.lang AND o.source <> g.source
  LEFT JOIN (SELECT a.lang, a.source, b.source AS other, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL) x
  ON x.lang = g.lang AND x.source = g.source AND x.other = o.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q)) // (p + q) AS value FROM p JOIN l USING (lang, term) WHERE n > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
WHERE part = 'pair' OR rank <= 10
"""
