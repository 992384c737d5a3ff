"""Table functions: files to syntax nodes, function and class spans, and masked lines."""

from __future__ import annotations

import bisect
import re
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quillscan.functions import lexer
from quillscan.sources.shared import saved

NODES = (
    "path string, lang string, ord long, kind string, raw string, text string, sl int, sc int, el int, ec int, name string, object string,"
    " args array<string>, args_text string, children array<struct<kind string, text string, at int>>, context2 string, context3 string,"
    " near array<string>, from_object string, from_arg string, error string"
)
SPANS = "path string, lang string, kind string, name string, params array<string>, s int, e int, sc int, ec int, ord int, error string"
_NODE_NAMES, _SPAN_NAMES = (re.findall(r"(?:^|, )([a-z0-9_]+) (?=string|long|int|array)", re.sub(r"struct<.*?>", "string", x)) for x in (NODES, SPANS))
#: Characters on either side of its node of a context that is shown: on lines as short as people write, all of the lines. What rules ask of lines is asked of whole ones.
REACH = 2000
#: What rules look for in the lines within 3 of a node, by name.
HINTS = {
    "secret": r"(?i)token|session|password|passwd|secret|otp|api[_-]?key|reset|nonce|csrf",
    "resolve": r"path\.resolve", "starts": "startsWith", "clean": r"filepath\.Clean", "prefix": "HasPrefix", "normal": "normalize|getCanonicalPath",
}

_HINTS = {k: re.compile(v) for k, v in HINTS.items()}
#: What each hint needs, in lower case: a text of ASCII without any of it has no such hint.
_NEEDS = {
    "secret": ("token", "session", "passw", "secret", "otp", "api", "reset", "nonce", "csrf"),
    "resolve": ("path.resolve",), "starts": ("startswith",), "clean": ("filepath.clean",), "prefix": ("hasprefix",), "normal": ("normalize", "getcanonicalpath"),
}
_NAMED = re.compile(r"\$?[A-Za-z_][A-Za-z0-9_]*")
_ASSIGNED = re.compile(r"([\w$]+)\s*:?=")
_WORD, _VALUE = re.compile(r"[\w$]+"), re.compile(r"[^;\n]*")


class Surroundings:
    """What stands in the whole lines around nodes; offsets are those of lines' beginnings and ends. A range of lines is searched for hints once, however many nodes it has, and the text once for assignments."""

    def __init__(self, text: str):
        self.text = text
        low = text.lower() if text.isascii() else None
        self.some = {k: p for k, p in _HINTS.items() if (p.search(text) if low is None else any([x in low for x in _NEEDS[k]]))}  # what the text has nowhere, no range has
        self.hints: dict[tuple[int, int], list[str]] = {}
        self.names: dict[str, tuple[list[int], list[int]]] | None = None if "=" in text else {}
        self.other: dict[tuple[int, int, str], int] = {}

    def near(self, low: int, high: int) -> list[str]:
        """The hints within two offsets."""
        if not self.some:
            return []
        if (low, high) not in self.hints:
            self.hints[low, high] = [k for k, p in self.some.items() if p.search(self.text, low, high)]
        return self.hints[low, high]

    def _assignments(self) -> dict[str, tuple[list[int], list[int]]]:
        """Where each name is assigned to: its beginnings, and the ends of the signs behind it."""
        found: dict[str, tuple[list[int], list[int]]] = {}
        for m in _ASSIGNED.finditer(self.text):
            token = m[1]
            for k in (0, *(k + 1 for k, x in enumerate(token[:-1]) if x == "$")) if "$" in token else (0,):  # a name may begin behind a sigil
                starts, ends = found.setdefault(token[k:], ([], []))
                starts.append(m.start())
                ends.append(m.end())
        return found

    def assigned(self, low: int, high: int, name: str | None) -> str | None:
        """The right-hand side, to a semicolon or the line's end, of the first assignment to name."""
        if not name:
            return None
        if _WORD.fullmatch(name):
            if self.names is None:
                self.names = self._assignments()
            if name not in self.names:
                return None
            starts, ends = self.names[name]
            k = bisect.bisect_left(starts, low)
            at = ends[k] if k < len(ends) and ends[k] <= high else -1
        else:
            key = low, high, name
            if key not in self.other:
                m = re.compile((r"\b" if re.match(r"\w", name) else "") + re.escape(name) + r"\s*:?=").search(self.text, low, high)
                self.other[key] = m.end() if m else -1
            at = self.other[key]
        return _VALUE.match(self.text, at, high)[0] if at >= 0 else None


#: What reads a language: a function from a text to an object like lexer.Source (text, nodes, functions, classes, place).
Adapter = Callable[[str], lexer.Source]


def _source(content: str | None, lang: str, adapters: dict[str, Adapter] | None) -> lexer.Source:
    return adapters[lang](content or "") if adapters and lang in adapters else lexer.Source(content or "", lang)


#: Files whose contents and rows that Python holds at once; a file's own rows stay together.
FILES_AT_ONCE, ROWS_AT_ONCE = 256, 2000


def tabled(files: DataFrame, schema: str, read: Callable[[str, str, str], Iterator[tuple]], failed: Callable[[str, str, str], tuple]) -> DataFrame:
    """Rows of `read` for each file with a language; a file that can't be read gives the row of `failed`, and never stops the scan."""
    struct = T.StructType.fromDDL(schema)
    arrow = to_arrow_schema(struct)

    def given(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for k in range(0, batch.num_rows, FILES_AT_ONCE):
                for file in zip(*(c.to_pylist() for c in batch.slice(k, FILES_AT_ONCE).columns), strict=True):
                    try:
                        rows += list(read(*file))
                    except Exception as e:
                        rows.append(failed(file[0], file[1], f"{type(e).__name__}: {e}"[:200]))
                    if len(rows) >= ROWS_AT_ONCE:
                        yield given(rows)
                        rows = []
            if rows:
                yield given(rows)

    some = files.where("lang is not null") if "unreadable" not in files.columns else files.where("lang is not null and unreadable is null")
    return some.select("path", "lang", "content").mapInArrow(work, struct)


def _nodes(src: lexer.Source, lang: str) -> Iterator[tuple]:
    """Fields of NODES from ord on, without the error."""
    starts, size, around = src.starts, len(src.text), Surroundings(src.text)
    for k, n in enumerate(src.nodes()):
        (sl, sc), (el, ec) = src.place(n.start), src.place(n.end)
        shown = []
        for r in (2, 3):
            low = starts[max(0, sl - 1 - r)]
            high = starts[el + r] - 1 if el + r < len(starts) else size
            shown.append(src.text[max(low, n.start - REACH) : min(high, n.end + REACH)])
        first = (n.args_text or "").partition(",")[0].strip(" ")
        near = around.near(low, high) if n.kind == "function_call" else []
        from_object = around.assigned(low, high, n.object) if lang == "java" else None
        from_arg = around.assigned(low, high, first) if _NAMED.fullmatch(first) else None
        children = [{"kind": a, "text": b, "at": c - n.start} for a, b, c in n.children]
        yield k, n.kind, n.raw, src.text[n.start : n.end], sl, sc, el, ec, n.name, n.object, n.args, n.args_text, children, *shown, near, from_object, from_arg


def _spans(src: lexer.Source) -> Iterator[tuple]:
    """Fields of SPANS from kind on, without the error."""
    found = [("function", *f) for f in src.functions()] + [("class", name, [], a, b) for name, a, b in src.classes()]
    for k, (kind, name, params, a, b) in enumerate(sorted(found, key=lambda x: x[3])):
        (s, sc), (e, ec) = src.place(a), src.place(b)
        yield kind, name, params, s, e, sc, ec, k


def nodes(files: DataFrame, adapters: dict[str, Adapter] | None = None) -> DataFrame:
    """The syntax nodes of files (path, lang, content), in text order (ord); calls carry name, receiver and arguments.

    context2 and context3 are the lines within 2 and 3 of the node, up to REACH characters before and after it, so that
    a file of one long line doesn't repeat itself for each node. What rules ask of the lines within 3 is found in the
    whole lines: near has the HINTS that stand there, from_object and from_arg what a call's receiver (in Java) and
    first argument were first assigned. A file that can't be read gives one row with its error and no node. adapters
    read other languages, or one's own way. One pass over the files, no shuffle; filter files before, not nodes after.
    """

    def read(path: str, lang: str, content: str) -> Iterator[tuple]:
        for row in _nodes(_source(content, lang, adapters), lang):
            yield path, lang, *row, None

    return tabled(files, NODES, read, lambda path, lang, error: (path, lang, -1, *[None] * 17, error))


def spans(files: DataFrame, adapters: dict[str, Adapter] | None = None) -> DataFrame:
    """path, lang, kind (function or class), name, params, s, e (lines), sc, ec (columns) and ord of each function with a body and of each class.

    A file that can't be read gives one row with its error and no name.
    """

    def read(path: str, lang: str, content: str) -> Iterator[tuple]:
        for row in _spans(_source(content, lang, adapters)):
            yield path, lang, *row, None

    return tabled(files, SPANS, read, lambda path, lang, error: (path, lang, *[None] * 8, error))


#: Rows of both kinds in one table.
_TWO = f"what string, path string, node struct<{NODES}>, span struct<{SPANS}>"


def parsed(files: DataFrame, adapters: dict[str, Adapter] | None = None) -> DataFrame:
    """Nodes and spans of files by one reading of each, written apart by what they are: readers of one kind read no other.

    `nodes_of` and `spans_of` give them as `nodes` and `spans` do.
    """

    def read(path: str, lang: str, content: str) -> Iterator[tuple]:
        src = _source(content, lang, adapters)
        for row in _nodes(src, lang):
            yield "node", path, dict(zip(_NODE_NAMES, (path, lang, *row, None), strict=True)), None
        for row in _spans(src):
            yield "span", path, None, dict(zip(_SPAN_NAMES, (path, lang, *row, None), strict=True))

    def failed(path: str, lang: str, error: str) -> tuple:
        return "error", path, dict.fromkeys(_NODE_NAMES) | {"path": path, "lang": lang, "ord": -1, "error": error}, dict.fromkeys(_SPAN_NAMES) | {"path": path, "lang": lang, "error": error}

    return saved(tabled(files, _TWO, read, failed), "parsed", by="what")


def nodes_of(rows: DataFrame) -> DataFrame:
    return rows.where("what in ('node', 'error')").select("node.*")


def spans_of(rows: DataFrame) -> DataFrame:
    return rows.where("what in ('span', 'error')").select("span.*")


def mask_literals(content: Column, lang: Column) -> Column:
    """Contents with comments and strings blanked; offsets and lines stay."""

    @F.pandas_udf("string")
    def mask(contents: pd.Series, langs: pd.Series) -> pd.Series:
        return pd.Series([lexer.masked(c or "", x or "") for c, x in zip(contents, langs, strict=True)])

    return mask(content, lang)
