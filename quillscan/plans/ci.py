"""A continuous-integration run: every file by rules, a sample of files by the second stage, and a summary of both."""

from __future__ import annotations

import json
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillscan.operators import enrich, relations, review
from quillscan.plans import report, scan
from quillscan.sources import discovery
from quillscan.sources.shared import saved


class RunError(ValueError):
    pass


def reviewed(found: DataFrame, ask: Callable, model: str, **how) -> DataFrame:
    """Findings after the second stage, with a sentence on the verdict in their description."""
    rows = report.detailed(found)
    prompt = enrich.prompt(F.col("rule_id"), F.col("text"), F.col("context3"), title=F.col("rule_name"), severity=F.col("severity"), file=F.col("file"), line=F.col("line"), language=F.col("lang"))
    key = enrich.cache_key(F.col("rule_id").alias("rule"), F.lit(model).alias("model"), F.col("text").alias("snippet"), F.col("context3").alias("context"))
    asked = rows.drop("fix_description", "fix_code", "confirmed", "verdict_confidence", "reasoning", "cwe_label", "cwe_uri").withColumns({"prompt": prompt, "key_hash": key})
    out = review.run(asked, ask, ["file", "line", "rule_id", "ord"], model=model, **how)
    return out.withColumn("description", review.noted(F.col("description")))


def run(files: DataFrame, folder: str, rate: float = 0.2, seed: str = "quillscan-ci-1", ask: Callable | None = None, model: str = "", **how) -> dict:
    """Writes rules.sarif (all files), sample.sarif (the second stage on a sample of files; empty without a model) and summary.json to folder; returns the summary.

    Files without any supported source are an error. Every file is read once: its matches are written, and both reports
    are made of them.
    """
    sources = saved(files.where("lang is not null"), "sources")
    paths = saved(sources.select("path"), "paths")
    total = paths.count()
    if not total:
        raise RunError("no supported source files")
    sampled = saved(relations.hash_sample(paths, "path", rate, seed), "sample")
    options = scan.Options()
    matches = saved(scan.candidates(sources, options), "candidates")
    found = saved(scan.stages(sources, options, matches)["findings"], "findings")
    target = Path(folder)
    target.mkdir(parents=True, exist_ok=True)
    with open(target / "rules.sarif", "w") as out:
        report.write_sarif(found, out)
    with open(target / "sample.sarif", "w") as out:
        if ask is None:
            report.write_empty_sarif(out)
        else:
            report.write_sarif(reviewed(found.join(sampled, "path", "left_semi"), ask, model, **how).where("outcome <> 'dismissed'"), out)
    names = [r["path"] for r in discovery.in_order(sampled).toLocalIterator()]
    summary = {"total_files": total, "sampled_files": len(names), "sample_rate": rate, "reviewed": ask is not None, "sample": names}
    (target / "summary.json").write_text(json.dumps(summary, indent=1))
    return summary
