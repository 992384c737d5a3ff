"""A content-addressed archive of WARC records.

Payload bytes are stored once under their SHA-256, which is verified when they are read. Exact record headers
are kept apart, one row each. Records come back through a join of headers and payloads. A record of a payload
that another record holds is a revisit: its WARC block has HTTP headers only and refers to the holder.
"""

from __future__ import annotations

import atexit
import datetime
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillscan.llm.common import remove, shared_dir

#: Payloads of fewer bytes are never revisited; copies' ids are broadcast up to this count.
LEAST_BYTES, MOST_COPIES = 1000, 2_000_000
CRLF = "\r\n"


def _http(size: Column) -> Column:
    return F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), size.cast("string"), F.lit(CRLF * 2))


def _urn(id_: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(id_.cast("string"), F.lit("null")), F.lit(">"))


def headers_of(type_: Column, id_: Column, url: Column, size: Column, sha1: Column, sha256: Column, refers_to: Column, date: Column) -> Column:
    """The exact bytes of a record before its payload: WARC headers and the HTTP headers of its block, as text."""
    http = _http(size)
    block = F.octet_length(http) + F.when(type_ == "revisit", F.lit(0)).otherwise(size)
    line = lambda k, v: F.concat(F.lit(f"{k}: "), v, F.lit(CRLF))
    clean = F.regexp_replace(F.coalesce(url, F.lit("")), "[\\r\\n]", "%0A")
    return F.concat(
        F.lit(f"WARC/1.1{CRLF}"), line("WARC-Type", type_), line("WARC-Record-ID", _urn(id_)), line("WARC-Date", date), line("WARC-Target-URI", clean),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), sha1)), line("X-Payload-SHA256", sha256),
        F.when(refers_to.isNotNull(), F.concat(line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), line("WARC-Refers-To", _urn(refers_to)))).otherwise(F.lit("")),
        line("Content-Type", F.lit("application/http; msgtype=response")), line("Content-Length", block.cast("string")), F.lit(CRLF), http,
    )


def write_archive(pages: DataFrame, path: str, id_: str = "page_id", url: str = "url", html: str = "html") -> None:
    """Writes `path`/headers (id, header, sha256; one row for each page), `path`/payloads (sha256, payload; once each) and `path`/info (the archive's warcinfo record).

    The records' WARC-Date is the time of writing, one for the archive. A null html is an empty payload; other columns
    are not kept. Of pages with equal payloads the largest id holds the bytes. Rows that repeat an id give a record
    each; only payloads held by repeated ids, or by pages without an id, are shuffled by digest. Pages without an id get
    records of their own and hold a payload only if no page with an id has it.
    """
    spark = pages.sparkSession
    payload = F.coalesce(F.col(html), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_).cast("long").alias("id"), F.col(url).cast("string").alias("url"), payload.alias("payload"))
    digests = rows.select("id", "url", F.octet_length("payload").cast("long").alias("size"), F.sha1("payload").alias("sha1"), F.sha2("payload", 256).alias("sha256"))
    digests.write.parquet(f"{path}/digests")
    digests = spark.read.parquet(f"{path}/digests")
    digests.groupBy("sha256").agg(F.max("id").alias("holder"), F.count("*").alias("n")).write.parquet(f"{path}/holders")
    same = spark.read.parquet(f"{path}/holders")  # a plain input of the joins, so that a payload of very many pages can be split
    shared = same.where("n > 1")
    shared = F.broadcast(shared) if shared.count() <= MOST_COPIES // 20 else shared
    joined = digests.join(shared, "sha256", "left").withColumn("holder", F.coalesce("holder", "id"))
    revisit = (F.col("size") >= LEAST_BYTES) & (F.col("n") > 1) & F.coalesce(F.col("id") != F.col("holder"), F.col("holder").isNotNull())
    typed = joined.withColumn("type", F.when(revisit, "revisit").otherwise("response")).withColumn("refers_to", F.when(revisit, F.col("holder")))
    now = datetime.datetime.now(datetime.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    header = headers_of(*(F.col(c) for c in ("type", "id", "url", "size", "sha1", "sha256", "refers_to")), F.lit(now))
    typed.select("id", header.alias("header"), "sha256").write.parquet(f"{path}/headers")
    spark.createDataFrame([(info_record(now),)], "record string").coalesce(1).write.parquet(f"{path}/info")

    digest = F.sha2("payload", 256).alias("sha256")
    odd = digests.groupBy("id").agg(F.count("*").alias("times")).where("times > 1 or id is null").select("id")
    copies = joined.where((F.col("n") > 1) & (F.col("id") != F.col("holder"))).select("id")
    aside = copies.unionByName(odd.where("id is not null")).distinct()
    sent = lambda df: F.broadcast(df) if df.count() <= MOST_COPIES else df
    once = rows.where("id is not null").join(sent(aside), "id", "left_anti").select(digest, "payload")
    if not odd.isEmpty():  # ids that don't tell a row: of the payloads that they hold, one row each
        held = _held(same, odd)
        some = rows.join(sent(odd.withColumnRenamed("id", "_odd")), F.col("id").eqNullSafe(F.col("_odd")), "left_semi").select("id", digest, "payload")
        mine = some.join(held, (some["sha256"] == held["_sha256"]) & some["id"].eqNullSafe(held["_holder"]), "left_semi")
        once = once.unionByName(mine.dropDuplicates(["sha256"]).select("sha256", "payload"))
    once.write.parquet(f"{path}/payloads")
    for name in ("digests", "holders"):
        remove(spark, f"{path}/{name}")


def _held(same: DataFrame, odd: DataFrame) -> DataFrame:
    """Digests whose holder is one of the odd ids."""
    odd = odd.withColumnRenamed("id", "_odd")
    return same.join(odd, same["holder"].eqNullSafe(odd["_odd"]), "left_semi").select(F.col("sha256").alias("_sha256"), F.col("holder").alias("_holder"))


def info_record(date: str) -> str:
    """The archive's warcinfo record: it describes the records that follow it in a file."""
    block = f"software: quillscan{CRLF}format: WARC File Format 1.1{CRLF}"
    head = [f"WARC/1.1{CRLF}WARC-Type: warcinfo", f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>", f"WARC-Date: {date}", "Content-Type: application/warc-fields", f"Content-Length: {len(block)}"]
    return CRLF.join(head) + CRLF * 2 + block


def record_of(header: Column, payload: Column) -> Column:
    """A record's bytes: its headers, the payload unless it is a revisit, and two line ends."""
    body = F.when(header.contains(f"{CRLF}WARC-Type: revisit{CRLF}"), F.lit(b"")).otherwise(payload)
    return F.concat(header.cast("binary"), body, F.lit((CRLF * 2).encode()))


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """The records: id, header (text), payload (binary, whole also for revisits), verified.

    Each record's bytes are rebuilt and parsed: headers to their empty line, the block by Content-Length, its HTTP
    headers, the payload behind them (a revisit's is the holder's). verified is false if that has another digest than
    its key, or if the record doesn't end where its length says; of a missing payload it is null.
    """
    payloads = spark.read.parquet(f"{path}/payloads")
    rows = spark.read.parquet(f"{path}/headers").join(payloads, "sha256", "left")
    rows = rows.withColumn("_record", record_of(F.col("header"), F.col("payload")))
    part = lambda c, at, n: F.substring(c, at, n)
    end = lambda c: F.instr(F.decode(c, "ISO-8859-1"), CRLF * 2) + 3  # noqa: E731  (one character a byte)
    rows = rows.withColumn("_head", end("_record"))
    rows = rows.withColumn("_warc", F.decode(part("_record", F.lit(1), F.col("_head")), "UTF-8"))
    rows = rows.withColumn("_length", field("Content-Length", "_warc").cast("int"))
    rows = rows.withColumn("_block", part("_record", F.col("_head") + 1, F.col("_length")))
    rows = rows.withColumn("_http", end("_block"))
    whole = part("_record", F.col("_head") + F.col("_length") + 1, F.octet_length("_record")) == F.lit((CRLF * 2).encode())
    found = F.when(field("WARC-Type", "_warc") == "revisit", F.col("payload")).otherwise(part("_block", F.col("_http") + 1, F.octet_length("_block")))
    header = F.concat("_warc", F.decode(part("_block", F.lit(1), F.col("_http")), "UTF-8"))
    rows = rows.select("id", F.coalesce(header, "header").alias("header"), found.alias("payload"), whole.alias("_whole"), "sha256")
    return rows.select("id", "header", "payload", (F.col("_whole") & (F.sha2("payload", 256) == F.col("sha256"))).alias("verified"))


def field(name: str, of: str = "header") -> Column:
    """A WARC header's value in a column, or null."""
    got = F.regexp_extract(of, f"\\r\\n{name}: ([^\\r]*)\\r\\n", 1)
    return F.when(got != "", got)


def export_warc(records: DataFrame, path: str, info: DataFrame, files: int = 16) -> None:
    """Writes records as WARC files of `path`, in `files` parts each led by the archive's warcinfo record (`path`/info of the archive); two line ends close each record.

    Revisits have HTTP headers only there. Payloads must be UTF-8 text, as those of pages are. One shuffle.
    """
    body = F.when(field("WARC-Type") == "revisit", F.lit("")).otherwise(F.decode("payload", "UTF-8"))
    rows = records.select(F.pmod(F.xxhash64("header"), F.lit(files)).cast("int").alias("part"), F.lit(1).alias("place"), F.concat("header", body).alias("value"))
    heads = info.select(F.explode(F.sequence(F.lit(0), F.lit(files - 1))).alias("part"), F.lit(0).alias("place"), F.col("record").alias("value"))
    rows.unionByName(heads).repartition("part").sortWithinPartitions("part", "place").select("value").write.option("lineSep", CRLF * 2).text(path)


def op8(spark, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark).rstrip('/')}/quillscan/warc-{uuid.uuid4().hex}"
    write_archive(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    atexit.register(remove, spark, path)
    urn = lambda name: F.regexp_extract("header", f"\\r\\n{name}: <urn:page:(-?[0-9]+)>", 1).try_cast("long")
    read = read_archive(spark, path).where(F.coalesce(F.col("verified"), F.raise_error(F.lit("a payload is missing or has another digest")).cast("boolean")))
    got = read.withColumn("real", F.sha1("payload"))
    return got.select(
        urn("WARC-Record-ID").alias("page_id"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.when(F.concat(F.lit("sha1:"), "real") == field("WARC-Payload-Digest"), F.col("real")).alias("payload_digest"),
        field("WARC-Type").alias("record_type"),
        urn("WARC-Refers-To").alias("refers_to"),
    )


ORACLE = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
h AS (SELECT page_id, octet_length(payload) AS n, sha1(payload) AS d,
             max(page_id) OVER (PARTITION BY payload) AS top FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
       CASE WHEN n >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id <> top THEN top END AS refers_to
FROM h
"""
