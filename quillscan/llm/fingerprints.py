"""Document fingerprints by closed syncmers, with DataFrame functions only.

A text of any length is a sequence of units: the pieces of up to PIECE code points, from the left, of its white-space
words; in scripts without spaces each code point is a unit. Each run of K units whose least hashed inner run of S units
lies at one of its two edges is an anchor: about 2 of K - S + 1 runs, and one of any K - S + 1 in a row at least. Whether
a run is an anchor depends on its own units alone, so equal passages have equal anchors wherever they stand. K - 1 edge
units stand before each text; inner runs of them alone hash highest, so the run that ends with the text's first unit is
always an anchor, and a text with any unit has one. The fingerprint is the anchors' hashes of 32 bits in text order, in
base 64.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Units of an anchor and of its inner runs, K - S + 1 = 4 of them.
K, S = 5, 2
#: Code points of a unit at most, and the units: code points of scripts without spaces, pieces of words.
PIECE = 4
_DENSE = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}"
# ASCII is told first, as scripts are looked up far more slowly; the scripts begin at U+0E00
UNITS = rf"[\x00-\x08\x0E-\x1F\x21-\x7F[^\x00-\x7F{_DENSE}]]{{1,{PIECE}}}|[\x{{0E00}}-\x{{10FFFF}}&&[{_DENSE}]]"
#: Rows that one task orders, and buckets at most (a power of two): their first places, 17 bytes each, are a constant of the plan.
ROWS, MOST_BUCKETS = 20_000, 1 << 15


def anchors(df: DataFrame, text: str, out: str) -> DataFrame:
    """df with `out`: the anchors of each text, an array of (position, hash), positions counted in units from 0; edge units have those below.

    A null or empty text, or one of white space only, has none. Intermediate arrays are columns of their own, so each is
    computed once a row.
    """
    u, h, s = (f"_{out}_{x}" for x in "uhs")
    df = df.withColumn(u, F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(UNITS), F.lit(0)))
    edge = F.array_repeat(F.lit(0).cast("long"), K - 1)
    df = df.withColumn(h, F.when(F.size(u) > 0, F.concat(edge, F.transform(u, lambda x: F.xxhash64(x)))).otherwise(F.slice(edge, 1, 0))).drop(u)
    at = lambda array, i: F.get(F.col(array), i)
    # hashes of the runs of S = 2 units by their place; those of edge units alone are never the least
    df = df.withColumn(s, F.transform(h, lambda x, i: F.when(i < K - S, F.lit((1 << 63) - 1)).otherwise(F.xxhash64(x, at(h, i + 1)))))

    def closed(i: Column) -> Column:
        """Whether the least of the inner runs of the run at i is its first or its last."""
        return F.least(at(s, i), at(s, i + K - S)) <= F.least(*[at(s, i + d) for d in range(1, K - S)])

    # a run of K = 5 units is hashed as 2 + 2 + 1
    run = lambda i: F.struct((i - (K - 1)).alias("position"), F.xxhash64(at(s, i), at(s, i + 2), at(h, i + 4)).alias("hash"))
    n = F.size(h)
    chosen = F.transform(F.filter(F.sequence(F.lit(0), n - K), closed), run)
    none = F.slice(F.array(F.struct(F.lit(0).alias("position"), F.lit(0).cast("long").alias("hash"))), 1, 0)
    return df.withColumn(out, F.when(n > 0, chosen).otherwise(none)).drop(h, s)


def fingerprint(anchor: Column) -> Column:
    """The anchors' hashes, cut to 32 bits, in text order, in base 64."""
    words = F.array_join(F.transform(anchor, lambda a: F.lpad(F.hex(F.shiftrightunsigned(a["hash"], 32)), 8, "0")), "")
    return F.replace(F.base64(F.unhex(words)), F.lit("\r\n"), F.lit(""))


def hashes(anchor: Column) -> Column:
    return F.array_distinct(F.transform(anchor, lambda a: F.shiftrightunsigned(a["hash"], 32)))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays of distinct hashes; two empty ones are alike, an empty one and another aren't."""
    both = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b) - both
    return F.when(either == 0, F.lit(1.0)).otherwise(both / either)


def _cuts(places: DataFrame, buckets: int) -> str:
    """The first place of each of about `buckets` ranges of equal numbers of rows, as a JSON array; Spark samples the ranges."""
    ranged = places.repartitionByRange(buckets, "place").groupBy(F.spark_partition_id().alias("part")).agg(F.min("place").alias("place"))
    return ranged.agg(F.to_json(F.sort_array(F.collect_list("place"))).alias("cuts")).first()["cuts"]  # MOST_BUCKETS at most


def in_order(df: DataFrame, key: str, tie: Column) -> DataFrame:
    """df with buckets of consecutive keys, descending, each with a copy of the row after its last one.

    Adds _place (sorts by key descending, null keys last, then by tie), _bucket and _ghost (the copy: it only serves as
    its predecessor's next row). Buckets hold equal numbers of rows by a sample of places, whatever the keys' values and
    repeats are; only rows equal in key and tie can't be parted. After the last row comes the first. One shuffle of
    places; the rows themselves aren't moved here.
    """
    spark = df.sparkSession
    # ~key falls where key rises and never overflows
    place = F.struct(F.col(key).isNull().alias("none"), F.coalesce(F.bitwise_not(F.col(key)), F.lit(0).cast("long")).alias("key"), tie.alias("tie"))
    rows = df.withColumn("_place", place)
    n = df.count()
    buckets = min(MOST_BUCKETS, max(1, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")), n // ROWS))
    cuts = F.from_json(F.lit(_cuts(rows.select(F.col("_place").alias("place")), buckets) if n else "[]"), "array<struct<none boolean, key bigint, tie bigint>>")
    steps = F.lit([1 << k for k in reversed(range(MOST_BUCKETS.bit_length() - 1))])
    # the last cut that is not behind the row: a binary search
    at = F.aggregate(steps, F.lit(0), lambda i, step: F.when(F.coalesce(F.get(cuts, i + step) <= F.col("_place"), F.lit(False)), i + step).otherwise(i))
    rows = rows.withColumn("_bucket", at)
    # rows that share a bucket's first place all offer a copy; only the first in order is ever next
    before = F.when(F.col("_bucket") > 0, F.col("_bucket") - 1).otherwise(F.size(cuts) - 1)
    own, copy = F.struct(F.col("_bucket").alias("b"), F.lit(False).alias("g")), F.struct(before.alias("b"), F.lit(True).alias("g"))
    to = F.explode(F.when(F.get(cuts, F.col("_bucket")) == F.col("_place"), F.array(own, copy)).otherwise(F.array(own)))
    return rows.withColumn("_to", to).select(*df.columns, "_place", F.col("_to.b").alias("_bucket"), F.col("_to.g").alias("_ghost"))


def with_next(df: DataFrame) -> DataFrame:
    """Documents (doc_id, text; null text: empty) with anchors of the text, of its edited text and of the next document.

    Rows of one id follow each other by their text's hash, rows without an id come last; other columns are not read.
    """
    docs = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    rows = in_order(docs, "doc_id", F.xxhash64("text"))
    order = Window.partitionBy("_bucket").orderBy("_ghost", "_place")
    n = F.char_length("text")
    rows = rows.withColumn("_next", F.lead("text").over(order)).withColumn("n_chars", n.cast("long"))
    half = F.floor(n / 2).cast("int")
    rows = rows.withColumn("edited", F.concat(F.col("text").substr(F.lit(1), n - half), F.coalesce(F.col("_next"), F.lit("")).substr(F.lit(1), half))).drop("_next")
    rows = anchors(rows, "text", "own").drop("text")
    rows = rows.withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256))
    rows = anchors(rows, "edited", "changed").drop("edited")
    rows = rows.withColumn("_own", hashes(F.col("own"))).withColumn("_changed", hashes(F.col("changed")))
    return rows.withColumn("_follower", F.lead("_own").over(order)).where(~F.col("_ghost"))


def op5(spark, sf_dir: str) -> DataFrame:
    rows = with_next(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", fingerprint(F.col("own")).alias("fingerprint"), fingerprint(F.col("changed")).alias("edited_fingerprint"),
        likeness(F.col("_own"), F.col("_changed")).alias("near_edited"), likeness(F.col("_own"), F.col("_follower")).alias("near_next"),
    )
