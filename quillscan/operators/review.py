"""The second stage as one operator: cache, budget, calls, costs, verdicts, and the cache that they fill.

Each distinct key is asked once; which calls a budget lets begin follows from a prefix sum of what they may cost at
most, so calls are made in waves that the rest of the budget pays for. Any error keeps its candidate.
"""

from __future__ import annotations

import json
import math
import re
import subprocess
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillscan.operators import enrich, relations
from quillscan.sources.shared import saved

#: Model name patterns in order and their dollars a million tokens in and out.
PRICES = [(1, "^claude-opus", 15.0, 75.0), (2, "^claude-sonnet", 3.0, 15.0), (3, "^claude-.*haiku", 0.8, 4.0), (4, "^gpt-4o-mini", 0.15, 0.6), (5, "^gpt-4o", 2.5, 10.0), (6, "^gpt-4", 2.0, 8.0)]
#: Most tokens of a reply, of an explanation; lanes that call at once at most.
REPLY_TOKENS, EXPLANATION_TOKENS, MOST_LANES = 600, 300, 20
#: What a cached verdict holds, and the version of its layout.
CACHED = "key_hash string, confirmed boolean, verdict_confidence double, reasoning string, fix_description string, fix_code string, tokens_in long, tokens_out long, cached_at long, schema_version int"
VERSION = 1
ANSWER = "key_hash string, confirmed boolean, verdict_confidence double, reasoning string, fix_description string, fix_code string, tokens_in long, tokens_out long, answered_by string, failed string"


@dataclass(frozen=True)
class Reply:
    """What a model answered; tokens and model where they are known."""

    text: str
    tokens_in: int = 0
    tokens_out: int = 0
    model: str | None = None


class Command:
    """A model behind a command: the request as JSON on its input, {"text", "tokens_in", "tokens_out", "model"} on its output."""

    def __init__(self, argv: list[str], tokens: int = REPLY_TOKENS, seconds: float = 120):
        self.argv, self.tokens, self.seconds = argv, tokens, seconds

    def __call__(self, prompt: str) -> Reply:
        request = json.dumps({"prompt": prompt, "max_tokens": self.tokens, "temperature": 0})
        done = subprocess.run(self.argv, input=request, capture_output=True, text=True, timeout=self.seconds, check=True)
        found = json.loads(done.stdout)
        return Reply(str(found["text"]), int(found.get("tokens_in") or 0), int(found.get("tokens_out") or 0), found.get("model"))


def price_of(model: Column) -> Column:
    """The first price whose pattern a model's name has: a struct of inp and outp, or null."""
    return F.coalesce(*[F.when(model.rlike(pattern), F.struct(F.lit(a).alias("inp"), F.lit(b).alias("outp"))) for _, pattern, a, b in PRICES])


def cost_of(model: Column, tokens_in: Column, tokens_out: Column) -> Column:
    """Dollars of a call; null where the model has no price."""
    price = price_of(model)
    return tokens_in / 1e6 * price["inp"] + tokens_out / 1e6 * price["outp"]


def priced(spark: SparkSession, model: str) -> bool:
    return spark.range(1).select(price_of(F.lit(model)).isNotNull()).first()[0]


def asked(rows: DataFrame, ask: Callable[[str], str | Reply], lanes: int = 5, parse: Callable[[str], dict] = enrich.parse_reply, tries: int = 1) -> DataFrame:
    """Answers to prompts (key_hash, prompt): ANSWER. A call or reply that fails `tries` times has `failed` and no verdict. `lanes` partitions call at once."""
    if not 1 <= lanes <= MOST_LANES:
        raise ValueError(f"lanes must be within 1 and {MOST_LANES}")
    names = [x.split()[0] for x in ANSWER.split(", ")]

    def one(key: str, prompt: str) -> tuple:
        used = (None, None, None)
        for left in reversed(range(tries)):
            try:
                got = ask(prompt)
                got = got if isinstance(got, Reply) else Reply(got)
                used = got.tokens_in, got.tokens_out, got.model
                v = parse(got.text)
                fix = v.get("fix") or (None, None)
                return key, v["confirmed"], v["confidence"], v["reasoning"], *fix, *used, None
            except Exception as e:  # fail open
                if not left:
                    return key, *[None] * 5, *used, f"{type(e).__name__}: {e}"[:200]
        raise AssertionError

    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([one(k, p) for k, p in zip(b["key_hash"], b["prompt"], strict=True)], columns=names, dtype=object)

    return rows.select("key_hash", "prompt").repartition(lanes).mapInPandas(call, ANSWER)


def _waves(rows: DataFrame, ask, model: str, most: float, lanes: int, **how) -> list[DataFrame]:
    """Answers in the order of rows (key_hash, prompt, order _first) until costs reach `most`.

    The first wave is `lanes` calls. Each later one is what the rest pays for if every reply is as long as can be, and
    by as much dearer as calls so far were than that, or `lanes` calls.
    """
    most_cost = cost_of(F.lit(model), F.length("prompt").cast("double"), F.lit(REPLY_TOKENS))  # a character is a token at most, as a rule
    rows = saved(relations.running(rows.withColumn("_most", most_cost), ["_first"], F.col("_most"), "_ahead"), "asked")
    rows = saved(relations.running(rows, ["_first"], F.lit(1), "_no"), "asked")
    n, at, base, spent, out = rows.count(), 0, 0.0, 0.0, []
    while at < n and spent < most:
        dearer = max(1.0, spent / base) if base else 1.0
        paid = (F.col("_ahead") - base) * dearer < most - spent if at else F.lit(False)
        wave = rows.where((F.col("_no") >= at) & (paid | (F.col("_no") < at + lanes)))
        took, ends = wave.agg(F.count("*"), F.max(F.col("_ahead") + F.col("_most"))).first()
        answers = saved(asked(wave, ask, lanes, **how).withColumn("cost", F.round(cost_of(F.coalesce("answered_by", F.lit(model)), F.col("tokens_in"), F.col("tokens_out")), 6)), "answers")
        spent = round(spent + (answers.agg(F.sum("cost")).first()[0] or 0.0), 6)
        at, base = at + took, ends
        out.append(answers)
    return out


def run(
    candidates: DataFrame, ask: Callable[[str], str | Reply], order: list[str], *, model: str = "", store: DataFrame | None = None, now_ms: int = 0, ttl_s: int = 86_400,
    max_cost: float | None = None, lanes: int = 5, selected: Column | None = None, parse: Callable[[str], dict] = enrich.parse_reply, tries: int = 1,
) -> DataFrame:
    """candidates (key_hash, prompt) with the second stage's verdict on each.

    Adds confirmed, verdict_confidence, reasoning, fix_description, fix_code, cost, failed; channel (rule only, cache,
    review, or budget where none was left), asked (true on the row that a call was made for) and outcome (confirmed,
    dismissed, or kept). Only selected rows are reviewed. Fresh verdicts of `store` cost nothing. Of one key the first
    row in `order` is asked. With max_cost, calls stop once costs reach it; the call that crosses it is kept, and up to
    lanes - 1 more may be under way.
    """
    spark = candidates.sparkSession
    if max_cost is not None and not priced(spark, model):
        raise ValueError(f"a budget needs a price, and {model!r} has none")
    rows = saved(candidates.withColumn("_first", F.struct(*order)).withColumn("_pick", F.coalesce(selected, F.lit(False)) if selected is not None else F.lit(True)), "candidates")
    verdict = [x.split()[0] for x in ANSWER.split(", ")[1:6]]
    known = spark.createDataFrame([], CACHED) if store is None else fresh(store, now_ms, ttl_s)
    known = known.select("key_hash", *verdict)
    picked = rows.where("_pick").groupBy("key_hash").agg(F.min_by("prompt", "_first").alias("prompt"), F.min("_first").alias("_first"))
    missing = picked.join(known.select("key_hash"), "key_hash", "left_anti")
    how = {"parse": parse, "tries": tries}
    if max_cost is None:
        cost = F.round(cost_of(F.coalesce("answered_by", F.lit(model)), F.col("tokens_in"), F.col("tokens_out")), 6)
        parts = [saved(asked(missing, ask, lanes, **how).withColumn("cost", cost), "answers")]
    else:
        parts = _waves(missing, ask, model, max_cost, lanes, **how)
    answers = spark.createDataFrame([], f"{ANSWER}, cost double")
    for part in parts:
        answers = answers.unionByName(part)
    both = answers.select("key_hash", *verdict, "tokens_in", "tokens_out", "cost", "failed", F.lit("review").alias("_by"))
    both = both.unionByName(known.withColumns({"tokens_in": F.lit(None).cast("long"), "tokens_out": F.lit(None).cast("long"), "cost": F.lit(None).cast("double"), "failed": F.lit(None).cast("string"), "_by": F.lit("cache")}))
    firsts = picked.select("key_hash", F.col("_first").alias("_of"))
    out = rows.join(both, "key_hash", "left").join(firsts, "key_hash", "left")
    out = out.withColumn("channel", F.when(~F.col("_pick"), "rule").otherwise(F.coalesce("_by", F.lit("budget"))))
    out = out.withColumn("asked", (F.col("channel") == "review") & (F.col("_first") == F.col("_of")))
    for name in (*verdict, "tokens_in", "tokens_out", "failed"):
        out = out.withColumn(name, F.when(F.col("_pick"), F.col(name)))
    out = out.withColumn("cost", F.when(F.col("asked"), F.col("cost")))
    return enrich.partition(out).drop("_pick", "_by", "_first", "_of")


def noted(description: Column) -> Column:
    """A description with a sentence on its verdict, another one where the cache had it."""
    cached = F.when(F.col("channel") == "cache", F.lit(" (cached)")).otherwise(F.lit(""))
    said = F.when(F.col("outcome") == "confirmed", F.lit("Confirmed by Stage 2 analysis")).when(F.col("outcome") == "dismissed", F.lit("Dismissed by Stage 2 analysis"))
    return F.when(said.isNull(), description).otherwise(F.concat(description, F.lit(" "), said, cached, F.lit(".")))


def costs(reviewed: DataFrame) -> DataFrame:
    """One row: llm_calls, cost (rounded to 6 places) and cache_hits."""
    return reviewed.agg(F.count_if("asked").alias("llm_calls"), F.coalesce(F.round(F.sum("cost"), 6), F.lit(0.0)).alias("cost"), F.count_if(F.col("channel") == "cache").alias("cache_hits"))


def fresh(store: DataFrame, now_ms: int, ttl_s: int, version: int = VERSION) -> DataFrame:
    """The newest entry of each key that is of this layout and not older than its time to live; 0 or less never ends."""
    known = F.col("schema_version") == version
    if ttl_s > 0:
        known = known & (F.lit(now_ms) - F.col("cached_at") <= ttl_s * 1000)
    newest = Window.partitionBy("key_hash").orderBy(F.desc("cached_at"), "reasoning")
    return store.where(known & F.col("key_hash").isNotNull()).withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n")


def cache_rows(reviewed: DataFrame, now_ms: int) -> DataFrame:
    """What a review adds to the cache: the verdicts that it asked for and got."""
    names = [x.split()[0] for x in CACHED.split(", ")[:-2]]
    return reviewed.where(F.col("asked") & F.col("confirmed").isNotNull()).select(*names, F.lit(now_ms).cast("long").alias("cached_at"), F.lit(VERSION).alias("schema_version"))


#: Name of a cache's manifests: the readable one of the highest number tells which folders are live.
_MANIFEST = re.compile(r"manifest-(\d{12})\.json")


def _files(spark: SparkSession, path: str):
    """The file system of a path, and a function from names to its paths there."""
    to = spark._jvm.org.apache.hadoop.fs.Path
    return to(path).getFileSystem(spark._jsc.hadoopConfiguration()), lambda *names: to("/".join([path.rstrip("/"), *names]))


def _live(spark: SparkSession, path: str) -> tuple[int, list[str]]:
    """The number of a cache's manifest and the folders that it lists; 0 and the cache's own folder where there is none yet."""
    fs, at = _files(spark, path)
    if not fs.exists(at()):
        return 0, []
    names = sorted((x.getPath().getName() for x in fs.listStatus(at())), reverse=True)
    for name in names:
        if m := _MANIFEST.fullmatch(name):
            stream = fs.open(at(name))
            try:
                text = bytes(stream.readAllBytes()).decode()
            finally:
                stream.close()
            try:
                return int(m[1]), list(json.loads(text)["folders"])
            except (ValueError, KeyError, TypeError):
                continue
    return 0, [""] if any(n.startswith("shard=") for n in names) else []


def _commit(spark: SparkSession, path: str, change: Callable[[list[str]], list[str]]) -> list[str]:
    """Makes a list of folders the live one by one rename; gives the list before. Whoever commits second begins anew from the first one's list."""
    fs, at = _files(spark, path)
    for _ in range(100):
        number, before = _live(spark, path)
        beside, target = at(f".{uuid.uuid4().hex}"), at(f"manifest-{number + 1:012}.json")
        stream = fs.create(beside, True)
        try:
            stream.write(bytearray(json.dumps({"folders": change(before)}).encode()))
        finally:
            stream.close()
        if not fs.exists(target) and fs.rename(beside, target):
            return before
        fs.delete(beside, False)
    raise OSError(f"{path}: the cache is written to all the time")


def write_cache(rows: DataFrame, path: str) -> None:
    """Adds verdicts to the cache: a folder of their own, by the first two digits of their key, which is live once it is whole."""
    spark, name = rows.sparkSession, f"entries-{uuid.uuid4().hex}"
    rows.withColumn("shard", F.substring("key_hash", 1, 2)).write.partitionBy("shard").parquet(f"{path.rstrip('/')}/{name}")
    _commit(spark, path, lambda before: [*before, name])


def _entries(spark: SparkSession, path: str, folders: list[str]) -> DataFrame:
    """The rows of a cache's folders; one that is missing or can't be read holds none."""
    out = spark.createDataFrame([], CACHED)
    for name in folders:
        try:
            out = out.unionByName(spark.read.option("ignoreCorruptFiles", True).schema(CACHED + ", shard string").parquet(f"{path.rstrip('/')}/{name}".rstrip("/")).drop("shard"))
        except AnalysisException:
            continue
    return out


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """The cache's rows; one that is missing or can't be read holds none."""
    return _entries(spark, path, _live(spark, path)[1])


def prune(spark: SparkSession, path: str, now_ms: int, ttl_s: int) -> int:
    """Rewrites the cache without expired, outdated, unreadable and superseded entries; returns how many went.

    What stays is written to a folder of its own, which one rename makes the only live one but for those that others
    added meanwhile; then the replaced folders go. A run that ends at any point loses no entry: before the rename the old
    folders are live, after it the new one is, and folders that it left are removed by the next.
    """
    number, folders = _live(spark, path)
    before = _entries(spark, path, folders)
    n = before.count()
    fs, at = _files(spark, path)
    if n:
        kept, name = saved(fresh(before, now_ms, ttl_s), "kept"), f"entries-{uuid.uuid4().hex}"
        kept.withColumn("shard", F.substring("key_hash", 1, 2)).write.partitionBy("shard").parquet(f"{path.rstrip('/')}/{name}")
        _commit(spark, path, lambda now: [name, *(x for x in now if x not in folders)])
        n -= kept.count()
    if number or n:
        number, live = _live(spark, path)
        # what no manifest lists and an older one did, or what stood here before there was any
        for x in fs.listStatus(at()) if number else []:
            old = x.getPath().getName()
            if (old in folders and old not in live) or ("" in folders and old.startswith("shard=")) or ((m := _MANIFEST.fullmatch(old)) and int(m[1]) < number):
                if m := _MANIFEST.fullmatch(old):
                    stream = fs.open(at(old))
                    try:
                        listed = re.findall(r"entries-[0-9a-f]{32}", bytes(stream.readAllBytes()).decode("utf-8", "replace"))
                    finally:
                        stream.close()
                    for gone in set(listed) - set(live):
                        fs.delete(at(gone), True)
                fs.delete(at(old), True)
    return n


def explained(paths: DataFrame, ask: Callable[[str], str | Reply], order: list[str]) -> DataFrame:
    """paths with `explanation`: a sentence on each flow, from its steps alone. Rows keep their order columns; a reply without one is an error, as nothing else would tell."""
    facts = F.to_json(F.struct(F.lit(enrich.GUARD).alias("guard"), F.lit("Explain this verified flow in one sentence. Add no step. Answer as JSON: {\"explanation\": string}").alias("task"), "lang", "variable", "source", "source_line", "steps", "calls", "sink", "sink_line"))
    rows = paths.withColumn("_prompt", facts)

    @F.pandas_udf("string")
    def explain(prompts: pd.Series) -> pd.Series:
        out = []
        for p in prompts:
            got = ask(p)
            said = json.loads(got.text if isinstance(got, Reply) else got).get("explanation")
            if not isinstance(said, str) or not said.strip():
                raise ValueError("the reply has no explanation")
            out.append(said.strip())
        return pd.Series(out, dtype=object)

    return rows.withColumn("explanation", explain("_prompt")).drop("_prompt").orderBy(*order)


def strict_reply(text: str) -> dict:
    """A verdict that is one JSON object and nothing else; a confidence within 0 and 1, 0.5 without one."""
    found = json.loads(text)
    reasoning = str(found.get("reasoning", "")).strip()
    if not reasoning:
        raise ValueError("no reasoning")
    sure = float(found.get("confidence", 0.5))
    return {"confirmed": found.get("confirmed") is True, "confidence": min(1.0, max(0.0, 0.5 if math.isnan(sure) else sure)), "reasoning": reasoning}
