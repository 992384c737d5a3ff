"""Rules of one's own: functions over files, run where the files are; what they give is checked by columns of the result.

A rule is a function of a file's path, language and content that gives mappings of FIELDS, all but title optional. A
set of rules is a mapping of ids to functions, so a scan's rules can be put together with `merged` and picked by id.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillscan.operators.parse import tabled
from quillscan.operators.rules import RANK

Rule = Callable[[str, str, str], Iterable[Mapping]]
#: What a finding may tell.
FIELDS = "severity string, confidence double, title string, description string, line long, evidence array<string>, tags array<string>"
_NAMES = [f.split()[0] for f in FIELDS.split(", ")]
#: Severities of such rules: those of the built-in ones, and one below them.
SEVERITIES = ("info", *RANK)


def merged(*sets: Mapping[str, Rule]) -> dict[str, Rule]:
    """One set of several; an id that two of them have is an error."""
    out: dict[str, Rule] = {}
    for rules in sets:
        if twice := sorted(out.keys() & rules.keys()):
            raise ValueError(f"two rules for {', '.join(twice)}")
        out |= rules
    return out


def _fault() -> Column:
    """What is wrong with a row that a rule gave, or null."""
    shares = F.col("confidence").between(0, 1)  # never true of nan
    return (
        F.when(F.col("error").isNotNull(), F.col("error"))
        .when(F.col("title").isNull(), "a finding has no title")
        .when(F.col("confidence").isNotNull() & ~shares, F.concat(F.lit("confidence is not a share: "), F.col("confidence").cast("string")))
        .when(F.col("severity").isNotNull() & ~F.col("severity").isin(*SEVERITIES), F.concat(F.lit("no such severity: "), "severity"))
    )


def evaluate(files: DataFrame, rules: Mapping[str, Rule], only: list[str] | None = None) -> DataFrame:
    """path, rule_id, FIELDS and error: the findings of some rules (all, in their order) over files (path, lang, content).

    A rule that fails on a file, or whose finding is faulty, gives a row with the error and nothing else; the others go
    on. Missing fields: medium, 0.5, line 1, empty lists. Tags are distinct and sorted.
    """
    if unknown := [i for i in only or () if i not in rules]:
        raise KeyError(f"no rules {', '.join(unknown)}")
    some = [(i, rules[i]) for i in (rules if only is None else only)]

    def read(path: str, lang: str, content: str) -> Iterator[tuple]:
        for id_, rule in some:
            try:
                rows = [(path, id_, *(x.get(n) for n in _NAMES), None) for x in rule(path, lang, content or "")]
            except Exception as e:
                rows = [(path, id_, *[None] * len(_NAMES), f"{type(e).__name__}: {e}"[:200])]
            yield from rows

    rows = tabled(files, f"path string, rule_id string, {FIELDS}, error string", read, lambda path, lang, error: (path, *[None] * (len(_NAMES) + 1), error))
    rows = rows.withColumn("error", _fault())
    usual = {"severity": F.lit("medium"), "confidence": F.lit(0.5), "description": F.lit(""), "line": F.lit(1).cast("long"), "evidence": F.array().cast("array<string>"), "tags": F.array().cast("array<string>")}
    filled = {n: F.coalesce(n, usual[n]) if n in usual else F.col(n) for n in _NAMES} | {"tags": F.array_sort(F.array_distinct(F.coalesce("tags", usual["tags"])))}
    return rows.select("path", "rule_id", *[F.when(F.col("error").isNull(), filled[n]).alias(n) for n in _NAMES], "error")
