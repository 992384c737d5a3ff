"""Command line: scan folders or repositories, answer payloads, run in CI, list and check rules, prune caches, write scaffolds."""

from __future__ import annotations

import argparse
import contextlib
import json
import os
import shlex
import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillscan import config
from quillscan.operators import custom_rules, parse, review, rules
from quillscan.plans import ci, payload, report, scan
from quillscan.sources import diffs, discovery, repository
from quillscan.sources.shared import mounted, saved
from quillscan.sources.tables import EXCLUDED


def read_baseline(spark: SparkSession, path: str) -> DataFrame:
    """fingerprint and cnt of a baseline document: version 1 and whole counts."""
    with open(path) as f:
        doc = json.load(f)
    if not isinstance(doc, dict) or doc.get("version") != 1:
        raise ValueError(f"{path}: not a baseline of version 1")
    rows = list(doc.get("fingerprints", {}).items())
    if not all(isinstance(n, int) and not isinstance(n, bool) and n >= 0 for _, n in rows):
        raise ValueError(f"{path}: counts must be whole numbers")
    return spark.createDataFrame(rows, "fingerprint string, cnt long")


def write_baseline(found: DataFrame, path: str) -> None:
    """Writes what findings are known by, with their counts; never over a folder or a file that is no baseline."""
    if os.path.isdir(path):
        raise ValueError(f"{path}: a folder")
    if os.path.exists(path):
        try:
            with open(path) as f:
                known = json.load(f)
        except ValueError as e:
            raise ValueError(f"{path}: not a baseline, not overwritten") from e
        if not isinstance(known, dict) or "fingerprints" not in known:
            raise ValueError(f"{path}: not a baseline, not overwritten")
    rows = report.baseline(found).orderBy("fingerprint").toLocalIterator()
    with open(path, "w") as f:
        json.dump({"version": 1, "fingerprints": {r["fingerprint"]: r["cnt"] for r in rows}}, f, indent=1)


def rule_table(custom: list[rules.Rule] | None = None) -> str:
    rows = [(r.id, r.severity, ",".join(r.languages), r.name) for r in rules.load(custom=custom)]
    width = [max(len(r[k]) for r in rows) for k in range(3)]
    return "\n".join("  ".join(x.ljust(w) for x, w in zip(r, [*width, 0], strict=True)) for r in rows)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quillscan")
    sub = p.add_subparsers(dest="command", required=True)
    s = sub.add_parser("scan")
    s.add_argument("path", nargs="*")
    s.add_argument("--git-url")
    s.add_argument("--output", choices=config.FORMATS)
    s.add_argument("--output-file")
    s.add_argument("--config")
    s.add_argument("--severity", choices=list(rules.RANK))
    s.add_argument("--fail-on", choices=[*rules.RANK, "none"], default="high")
    s.add_argument("--no-inline-suppression", action="store_true")
    s.add_argument("--baseline")
    s.add_argument("--write-baseline")
    s.add_argument("--diff", help="a unified diff file; only changed lines are reported")
    s.add_argument("--diff-refs", nargs=2, metavar=("BASE", "HEAD"), help="references of the scanned repository; only lines changed between them are reported")
    s.add_argument("--dry-run", action="store_true", help="rules only, even if a review command is set")
    s.add_argument("--review", help="a command that judges findings: a JSON request in, a JSON reply out")
    for name, about in (("flows", "findings of flows as an envelope"), ("lines", "findings of lines as an envelope")):
        f = sub.add_parser(name, help=about)
        f.add_argument("--input", help="a JSON payload; without it and without flags one is read from the input")
        f.add_argument("--repo-path")
        f.add_argument("--git-url")
        f.add_argument("--output-file")
    c = sub.add_parser("ci", help="all files by rules, a sample by the review command, and a summary")
    c.add_argument("--root", default=".")
    c.add_argument("--artifacts", default="artifacts")
    c.add_argument("--sample-rate", type=float, default=0.2)
    c.add_argument("--seed", default="quillscan-ci-1")
    c.add_argument("--review")
    k = sub.add_parser("prune", help="drops expired entries of a cache")
    k.add_argument("path")
    k.add_argument("--ttl", type=int, default=86_400)
    r = sub.add_parser("rules")
    r.add_argument("action", choices=["list", "validate", "create"])
    r.add_argument("path", nargs="?")
    i = sub.add_parser("init")
    i.add_argument("--force", action="store_true")
    return p


def render(found: DataFrame, form: str) -> DataFrame:
    """A one-column DataFrame of the report's rows, by file and line."""
    found = report.ordered(found)
    if form == "json":
        return report.json_lines(found)
    return report.text_blocks(found).select(F.concat("file", F.lit(":"), F.col("line").cast("string"), F.lit(" "), "block").alias("value"))


def _second_stage(spark: SparkSession, found: DataFrame, conf: config.Config, command: str | None) -> DataFrame:
    """Findings judged by the review command, through the cache."""
    now = int(time.time() * 1000)
    store = review.read_cache(spark, conf.cache) if conf.cache else None
    ask = review.Command(shlex.split(command) if command else conf.review)
    rows = ci.reviewed(found, ask, conf.model or "", store=store, now_ms=now, ttl_s=conf.cache_ttl, max_cost=conf.max_cost, lanes=conf.lanes)
    rows = saved(rows, "reviewed")
    if conf.cache:
        review.write_cache(review.cache_rows(rows, now), conf.cache)
    return rows


def run_scan(spark: SparkSession, args: argparse.Namespace) -> int:
    if args.write_baseline and (args.baseline or args.severity or args.diff or args.diff_refs):
        print("--write-baseline can't be combined with --baseline, --severity, --diff or --diff-refs", file=sys.stderr)
        return 2
    paths = args.path or []
    first = next((p for p in paths if os.path.isdir(p)), None)
    with contextlib.ExitStack() as stack:
        folder, warnings = stack.enter_context(repository.checkout(first, args.git_url, mounted(spark) if args.git_url else None)) if args.git_url or first or not paths else (os.getcwd(), [])
        for w in warnings:
            print(w, file=sys.stderr)
        conf = config.load(folder, args.config)
        documents = custom_rules.documents(conf.custom) if conf.custom else []
        options = scan.Options("none" if conf.preset == "none" else "all", [], documents, conf.disable, args.severity, None if args.no_inline_suppression else conf.directive)
        if args.baseline:
            options.baseline = read_baseline(spark, args.baseline)
        if args.diff or args.diff_refs:
            with open(args.diff) if args.diff else contextlib.nullcontext() as f:
                text = f.read() if f else repository.diff(folder, *args.diff_refs)
            options.changed = spark.createDataFrame(diffs.parse(text), "file string, line long")
        files = discovery.read(spark, paths if paths and not args.git_url else [folder], conf.include, [*EXCLUDED, *conf.exclude])
        files = saved(files, "files")  # read once; a clone may go
        read = parse.parsed(files)
        counts = scan.Counts()
        steps = scan.stages(files, options, scan.candidates(files, options, read), counts)
        found, judged = steps["findings"], None
        if (args.review or conf.review) and not args.dry_run:
            judged = _second_stage(spark, found, conf, args.review)
            found = judged.where("outcome <> 'dismissed'")
        dismissed = judged.where("outcome = 'dismissed'") if judged is not None else None
        if args.write_baseline:
            write_baseline(found if dismissed is None else report.snapshot(found, dismissed), args.write_baseline)
            return 0
        form = args.output or conf.output
        if form in ("sarif", "github", "json-report"):
            with open(args.output_file, "w") if args.output_file else contextlib.nullcontext(sys.stdout) as out:
                if form == "sarif":
                    report.write_sarif(found, out)
                elif form == "github":
                    report.write_review(found, out)
                else:
                    report.write_json(found, out, scan.counters(files, steps, judged, counts).first().asDict(), dismissed, scan.skipped(files, parsed=read))
            return int(report.fails(found, args.fail_on, rules.RANK).first()["fails"])
        rows = render(found, form)
        if args.output_file:
            rows.write.mode("overwrite").text(args.output_file)
        else:
            for r in rows.toLocalIterator():
                print(r["value"])
            if form == "text":
                print(report.summary_line(found).first()["summary"])
        return int(report.fails(found, args.fail_on, rules.RANK).first()["fails"])


def run_payload(spark: SparkSession, args: argparse.Namespace) -> int:
    """Flows or lines by a payload; an input error is an envelope as well, and ends with 2."""
    with open(args.output_file, "w") if args.output_file else contextlib.nullcontext(sys.stdout) as out:
        try:
            payload.answer(spark, payload.load(args.input, args.repo_path, args.git_url), out, lines=args.command == "lines")
        except ValueError as e:
            out.write(json.dumps({"findings": [], "error": str(e), "warnings": []}, ensure_ascii=False) + "\n")
            return 2
    return 0


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        if args.command == "init":
            config.scaffold(config.NAMES[0], force=args.force)
            return 0
        if args.command == "rules" and args.action == "create":
            config.scaffold(args.path or "rule.yml", config.RULE_SCAFFOLD)
            return 0
        spark = SparkSession.builder.getOrCreate()
        if args.command == "rules":
            docs = custom_rules.documents(args.path) if args.path else []
            if args.action == "list":
                print(rule_table(custom_rules.compile_rules(docs)))
            return 0
        if args.command in ("flows", "lines"):
            return run_payload(spark, args)
        if args.command == "prune":
            print(review.prune(spark, args.path, int(time.time() * 1000), args.ttl))
            return 0
        if args.command == "ci":
            files = discovery.read(spark, [args.root], None, EXCLUDED, any_case=True)
            ask = review.Command(shlex.split(args.review)) if args.review else None
            print(json.dumps(ci.run(files, args.artifacts, args.sample_rate, args.seed, ask)))
            return 0
        return run_scan(spark, args)
    except (ValueError, OSError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
