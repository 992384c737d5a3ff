"""The scan: files to nodes, matches, filters, numbered findings and reports, as one lazy plan."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from quillscan.operators import parse, relations, review, rule_index, rules, text_rules
from quillscan.sources.shared import saved
from quillscan.sources.tables import skipped as unsupported


@dataclass
class Options:
    """What a scan is asked for. Sizes follow the data; nothing here limits rows."""

    preset: str = "all"
    custom: list = field(default_factory=list)
    documents: list[dict] = field(default_factory=list)  # checked rule documents, any number: they go through an index
    disable: list[str] = field(default_factory=list)
    severity: str | None = None
    directive: str | None = "scan-ignore"
    baseline: DataFrame | None = None  # fingerprint, cnt
    changed: DataFrame | None = None  # file, line
    adapters: dict | None = None  # language -> reader, see parse.Adapter


def place(line: str, column: str):
    """A position that sorts by line and then by column, however long a line is."""
    return F.struct(F.col(line), F.col(column))


#: What the filters after `candidates` and `counters` ask of a match, besides its fingerprint.
COUNTED = ["path", "ord", "sl", "el", "rule_id", "rule_ord", "severity"]


def candidates(files: DataFrame, options: Options, parsed: DataFrame | None = None, counted: bool = False) -> DataFrame:
    """Matches of all rules, first seen at each start, without those inside another match of their rule.

    Matches are dealt by file once; both steps run within that, by one sort. parsed: the written rows of `parse.parsed`,
    so that files are read once for this and for what else is asked of them. counted: matches are told apart and counted,
    but not shown, so that nothing but COUNTED and their fingerprints is dealt, sorted and given.
    """
    nodes = parse.nodes(files, options.adapters) if parsed is None else parse.nodes_of(parsed)
    loaded = rules.load(options.preset, options.custom, options.disable)
    hits = rules.match(nodes, loaded)
    if docs := [d for d in options.documents if d["id"] not in set(options.disable)]:
        hits = hits.unionByName(rule_index.match(nodes, rule_index.table_of(files.sparkSession, docs, len(loaded))))
    if counted:
        hits = hits.select(*COUNTED, "sc", "ec", text_rules.fingerprint(F.col("rule_id"), F.col("path"), F.col("text")).alias("fingerprint"))
    hits = hits.repartition("path")
    rest = [F.col(c) for c in hits.columns if c not in ("path", "rule_id", "sl", "sc", "ord")]
    nth = F.row_number().over(Window.partitionBy("path", "rule_id", "sl", "sc").orderBy("ord", *rest))
    first = hits.withColumn("_n", nth).where("_n = 1").drop("_n")
    found = relations.drop_contained(first, ["path", "rule_id"], ["sl", "sc"], place("el", "ec"))
    return found.drop("sc", "ec") if counted else found


#: What a scan leaves after each of its filters, in order.
STAGES = ("candidates", "suspicious", "unknown", "changed", "findings")


class Counts:
    """Numbers of a scan's stages, observed while each of them is written: no stage is read to be counted, and no filter runs twice."""

    def __init__(self) -> None:
        self.stages: dict[str, dict[str, int]] = {}

    def __call__(self, df: DataFrame, name: str) -> DataFrame:
        """df, written; its rows and its rows of each severity are noted."""
        seen = Observation()
        per = [F.count_if(F.col("severity") == s).alias(s) for s in rules.RANK]
        out = saved(df.observe(seen, F.count(F.lit(1)).alias("rows"), *per), name)
        self.stages[name] = {k: int(v or 0) for k, v in seen.get.items()}
        return out


def stages(files: DataFrame, options: Options | None = None, found: DataFrame | None = None, counts: Counts | None = None) -> dict[str, DataFrame]:
    """The scan after each filter: candidates; suspicious (without suppressed ones); unknown (beyond the baseline); changed (on changed lines); findings (of at least the severity).

    found: candidates that were made before, such as a written table, so that files are parsed once; they may have their
    fingerprints already. counts: writes what each filter leaves and notes its numbers, for `counters`.
    """
    kept = counts or (lambda df, name: df)
    options = options or Options()
    if options.severity is not None and options.severity not in rules.RANK:
        raise ValueError(f"unknown severity {options.severity!r}")
    found = candidates(files, options) if found is None else found
    found = found.withColumn("file", F.col("path")).withColumn("line", F.col("sl").cast("long"))
    if "fingerprint" not in found.columns:
        found = found.withColumn("fingerprint", text_rules.fingerprint(F.col("rule_id"), F.col("file"), F.col("text")))
    out = {"candidates": (found := kept(found, "candidates"))}
    if options.directive:
        lined = files.where(F.col("content").contains(options.directive)).select(F.col("path").alias("file"), F.posexplode(F.split("content", "\n")).alias("_n", "line")).select("file", (F.col("_n") + 1).cast("long").alias("line_no"), "line")
        found = kept(relations.suppress(found, lined, options.directive), "suspicious")
    out["suspicious"] = found
    if options.baseline is not None:
        found = kept(relations.bag_difference(found, options.baseline, "fingerprint", ["file", "line", "ord"]), "unknown")
    out["unknown"] = found
    if options.changed is not None:
        found = kept(relations.touching(found.withColumn("s", F.col("sl")).withColumn("e", F.col("el")), options.changed).drop("s", "e"), "changed")
    out["changed"] = found
    if options.severity:
        found = kept(found.where(F.create_map(*[F.lit(x) for kv in rules.RANK.items() for x in kv])[F.col("severity")] >= rules.RANK[options.severity]), "findings")
    return out | {"findings": found}


def findings(files: DataFrame, options: Options | None = None) -> DataFrame:
    """Findings: candidates without suppressed, baselined, unchanged and minor ones."""
    return stages(files, options)["findings"]


def numbered(found: DataFrame, whole: bool = False) -> DataFrame:
    """Findings with finding_no: their number within their file or, with whole=True, in the report, by file and place.

    Number before a baseline or a diff filters, and the gaps tell what they left out.
    """
    if whole:
        return relations.running(found, ["file", "ord", "rule_ord"], F.lit(1), "finding_no").withColumn("finding_no", F.col("finding_no") + 1)
    return found.withColumn("finding_no", F.row_number().over(Window.partitionBy("file").orderBy("ord", "rule_ord")))


def skipped(files: DataFrame, adapters: dict | None = None, parsed: DataFrame | None = None) -> DataFrame:
    """path and reason of files that no parser takes, that couldn't be opened (a column unreadable tells) or that couldn't be read.

    parsed: the written rows of `parse.parsed`, so that no file is parsed again.
    """
    rows = parse.nodes(files, adapters) if parsed is None else parse.nodes_of(parsed)
    failed = rows.where("error is not null").select("path", F.col("error").alias("reason"))
    if "unreadable" not in files.columns:
        return unsupported(files).unionByName(failed)
    shut = files.where("unreadable is not null").select("path", F.col("unreadable").alias("reason"))
    return unsupported(files.where("unreadable is null")).unionByName(failed).unionByName(shut)


def summary(files: DataFrame, adapters: dict | None = None, parsed: DataFrame | None = None) -> DataFrame:
    """One row: files with a language, functions, classes and languages, these in the order of the first file (by lower-case path) that has them."""
    known = files.where("lang is not null")
    spans = (parse.spans(known, adapters) if parsed is None else parse.spans_of(parsed)).agg(F.count_if(F.col("kind") == "function").alias("functions"), F.count_if(F.col("kind") == "class").alias("classes"))
    counted = known.groupBy("lang").agg(F.count("*").alias("n"), F.min(F.lower("path")).alias("first"))
    listed = counted.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("files"), F.transform(F.array_sort(F.collect_list(F.struct("first", "lang"))), lambda x: x["lang"]).alias("languages"))  # a row a language
    return listed.join(F.broadcast(spans))  # one row each


def counters(files: DataFrame, steps: dict[str, DataFrame], reviewed: DataFrame | None = None, counts: Counts | None = None) -> DataFrame:
    """One row: files, scanned, skipped; candidates, suppressed, suspicious, baselined, outside the diff, findings, findings a severity; and calls, cost and cache hits of a review.

    counts: what was noted when the stages were written; without it each stage is counted by an aggregate of its own.
    """
    f = files.agg(F.count("*").alias("files"), F.count("lang").alias("scanned"), F.count_if(F.col("lang").isNull()).alias("skipped"))
    if counts is None:
        out = f
        for name in STAGES[:-1]:
            out = out.join(F.broadcast(steps[name].agg(F.count("*").alias(name))))
        last = steps["findings"].agg(F.count("*").alias("findings"), *[F.count_if(F.col("severity") == s).alias(s) for s in rules.RANK])
        out = out.join(F.broadcast(last))
    else:
        seen: dict[str, int] = {}
        for name in STAGES:  # a filter that isn't asked for leaves what the one before it left
            seen = counts.stages.get(name, seen)
            f = f.withColumn(name, F.lit(seen["rows"]).cast("long"))
        out = f.withColumns({s: F.lit(seen[s]).cast("long") for s in rules.RANK})
    out = out.withColumn("suppressed", F.col("candidates") - F.col("suspicious")).withColumn("baselined", F.col("suspicious") - F.col("unknown")).withColumn("diff_filtered", F.col("unknown") - F.col("changed")).drop("unknown", "changed")
    if reviewed is None:
        return out.withColumns({"llm_calls": F.lit(0).cast("long"), "cost": F.lit(0.0), "cache_hits": F.lit(0).cast("long")})
    return out.join(F.broadcast(review.costs(reviewed)))
