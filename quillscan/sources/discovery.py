"""Which files a scan takes: roots, globs, exclusions, languages and lists of paths, as filters on a DataFrame of paths."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quillscan.operators.relations import running
from quillscan.sources.shared import saved
from quillscan.sources.tables import EXCLUDED, EXTENSIONS

#: Extensions beside the scanner's that the line heuristics read.
HEURISTIC = {".cpp": "cpp", ".hpp": "cpp", ".cc": "cpp", ".cxx": "cpp", ".hxx": "cpp"}
#: Other names of languages.
ALIASES = {"c++": "cpp", "ts": "typescript", "js": "javascript", "py": "python", "golang": "go"}
#: Default globs of files that are taken, and of those that aren't.
INCLUDE, EXCLUDE = ["**/*.{ts,js,py,go,java,php}"], ["node_modules", "**/*.test.*", "**/*.spec.*", "**/*.min.js", "dist", "build"]


class DiscoveryError(ValueError):
    pass


def resolve(names: list[str] | None, known: dict[str, str] | None = None, strict: bool = True) -> tuple[list[str], list[str]]:
    """The distinct languages that names or aliases stand for, in order, and warnings; an unknown one is an error if strict."""
    langs = list(dict.fromkeys((known or EXTENSIONS | HEURISTIC).values()))
    if names is None:
        return langs, []
    if not isinstance(names, list) or not all(isinstance(n, str) for n in names):
        raise DiscoveryError("languages must be a list of strings")
    low = list(dict.fromkeys(ALIASES.get(n.lower(), n.lower()) for n in names))
    odd = [n for n in low if n not in langs]
    if odd and strict:
        raise DiscoveryError(f"unsupported language: {', '.join(odd)}")
    return [n for n in low if n in langs], [f"unsupported languages ignored: {', '.join(odd)}"] if odd else []


def pattern(glob: str) -> str:
    """The regular expression of a glob over relative paths: ** any folders, * and ? within a name, [set], {one,other}. A glob without a mark names a folder or a file with all below it."""
    if not re.search(r"[*?\[{]", glob):
        return f"^(?:.*/)?{re.escape(glob.strip('/'))}(?:/.*)?$"
    out, i, depth = "", 0, 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i):
            out, i = out + "(?:[^/]+/)*", i + 3
            continue
        if glob.startswith("**", i):
            out, i = out + ".*", i + 2
            continue
        if c == "[" and (end := glob.find("]", i + 2)) > 0:
            out, i = out + "[" + glob[i + 1 : end].replace("!", "^", 1).replace("\\", "\\\\") + "]", end + 1
            continue
        if c in "{}":
            depth += 1 if c == "{" else -1
            out += "(?:" if c == "{" else ")"
        elif c == "," and depth:
            out += "|"
        else:
            out += {"*": "[^/]*", "?": "[^/]"}.get(c, re.escape(c))
        i += 1
    return f"^{out}$"


def extension_of(path: Column, any_case: bool) -> Column:
    """A path's extension, after the last dot of its name; lower-cased with any_case."""
    ext = F.regexp_extract(path, r"(\.[^./]*)$", 1)
    return F.lower(ext) if any_case else ext


def language(path: Column, known: dict[str, str] | None = None, any_case: bool = False) -> Column:
    pairs = [F.lit(x) for kv in (known or EXTENSIONS).items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), extension_of(path, any_case))


def chosen(
    files: DataFrame, include: list[str] | None = None, exclude: list[str] | None = None, languages: list[str] | None = None, only: DataFrame | None = None,
    known: dict[str, str] | None = None, any_case: bool = False, dotted: bool = False, path: str = "path",
) -> DataFrame:
    """files whose path (relative, with /) a glob of `include` takes and none of `exclude` does, in one of `languages`.

    only: a DataFrame of paths (column path); others go. Names that begin with a dot go unless dotted. known: languages
    by extension, told apart by case unless any_case. `lang` is set. Only filters on paths: no content is read for them.
    """
    p = F.regexp_replace(F.col(path), r"\\", "/")
    kept = F.lit(True) if dotted else ~p.rlike(r"(?:^|/)\.[^/]")
    if include is not None:
        kept = kept & (p.rlike("|".join(map(pattern, include))) if include else F.lit(False))
    if exclude:
        kept = kept & ~p.rlike("|".join(map(pattern, exclude)))
    out = files.where(kept).withColumn("lang", language(p, known, any_case))
    if languages is not None:
        out = out.where(F.col("lang").isin(*resolve(languages, known)[0]))
    if only is not None:
        keys = only.select(F.regexp_replace(F.regexp_replace("path", r"\\", "/"), r"^\./", "").alias("_key")).distinct()
        out = out.join(keys, p == F.col("_key"), "left_semi")
    return out


def in_order(files: DataFrame, path: str = "path") -> DataFrame:
    """files by lower-case path; a sort that Spark distributes."""
    return files.orderBy(F.lower(path), path)


#: Rows of the listing: kind is folder or file; error tells of a folder that can't be listed.
_LISTED = "root string, path string, kind string, size long, error string"
#: Bytes of files that one task reads about, those of an Arrow batch, and empty files that count as much as such a part.
PART_BYTES, BATCH_BYTES, PART_FILES = 64 << 20, 8 << 20, 2048
#: Rows of the listing, and files that are read, that Python holds at once.
ROWS_AT_ONCE = 10_000


def filesystem(place: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI (file, hdfs, s3, gs, abfs) and the path there."""
    if "://" not in place and not place.startswith("file:"):
        return fs.LocalFileSystem(), str(Path(place).resolve())
    if re.match("file:/+", place):
        return fs.LocalFileSystem(), "/" + re.sub("^file:/+", "", place)
    try:
        return fs.FileSystem.from_uri(place)
    except (pa.ArrowInvalid, OSError) as e:
        raise DiscoveryError(f"{place}: {e}") from e


def _below(place: str) -> Iterator[tuple[str, str, int]]:
    """Name, kind and size of what a folder holds; linked folders aren't entered, so no walk goes round."""
    system, path = filesystem(place)
    if isinstance(system, fs.LocalFileSystem):
        with os.scandir(path) as entries:
            for e in entries:
                if e.is_dir(follow_symlinks=False):
                    yield e.name, "folder", 0
                elif e.is_file():
                    yield e.name, "file", e.stat().st_size
        return
    for info in system.get_file_info(fs.FileSelector(path)):
        if info.type in (fs.FileType.Directory, fs.FileType.File):
            yield info.base_name, "folder" if info.type == fs.FileType.Directory else "file", info.size or 0


def _closed(exclude: list[str]) -> re.Pattern | None:
    """What the relative path of a folder looks like that nothing below is taken of."""
    whole = [pattern(g) for g in exclude if not re.search(r"[*?\[{]", g)]
    deep = [pattern(g[:-3]) for g in exclude if g.endswith("/**")]
    return re.compile("|".join(whole + deep)) if whole or deep else None


def listing(spark: SparkSession, roots: list[str], exclude: list[str] | None = None, dotted: bool = False) -> DataFrame:
    """root, path (relative to it) and size of every file below some folders; error instead for a folder that can't be listed.

    Folders are listed by tasks, level by level; those that `exclude` takes whole, and dotted ones, are never entered.
    Each level is a written table. Nothing is opened.
    """
    shut = _closed(exclude or [])
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    schema = to_arrow_schema(T.StructType.fromDDL(_LISTED))

    def given(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True) if rows else [[]] * 5, schema, strict=True)], schema=schema)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for root, folder in zip(*(c.to_pylist() for c in b.columns), strict=True):
                rows: list[tuple] = []
                try:
                    for name, kind, size in _below(f"{root.rstrip('/')}/{folder}" if folder else root):
                        path = f"{folder}/{name}" if folder else name
                        hidden = name.startswith(".") and not dotted
                        if not hidden and not (kind == "folder" and shut and shut.match(path)):
                            rows.append((root, path, kind, size, None))
                        if len(rows) >= ROWS_AT_ONCE:
                            yield given(rows)
                            rows = []
                except (OSError, DiscoveryError) as e:
                    rows.append((root, folder, "error", 0, f"{type(e).__name__}: {e}"[:200]))
                yield given(rows)

    level = spark.createDataFrame([(r, "") for r in dict.fromkeys(roots)], "root string, path string")
    found, out = 1, None
    while found:
        here = saved(level.repartition(max(1, min(found, 4 * parts))).mapInArrow(walk, _LISTED), "listing")
        files = here.where("kind <> 'folder'").select("root", "path", "size", "error")
        out = files if out is None else out.unionByName(files)
        level = here.where("kind = 'folder'").select("root", "path")
        found = level.count()
    return out


def contents(files: DataFrame) -> DataFrame:
    """files (root, path, size and others) with content, read as UTF-8 (odd bytes become marks), and unreadable, its error.

    Files are dealt to tasks by their bytes, and a PART_FILES-th of a part for opening each: of these in order of paths,
    each PART_BYTES make a part, so that many small files are read by many tasks.
    """
    before = running(files, ["root", "path"], F.col("size") + PART_BYTES // PART_FILES, "_before").withColumn("_part", F.floor(F.col("_before") / PART_BYTES))
    total = before.agg(F.max("_part")).first()[0]
    dealt = before.repartitionByRange(total + 1 if total is not None else 1, "_part").drop("_before", "_part")
    schema = T.StructType([*dealt.schema.fields, T.StructField("content", T.StringType()), T.StructField("unreadable", T.StringType())])
    arrow = to_arrow_schema(schema)
    root, path = dealt.columns.index("root"), dealt.columns.index("path")

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True) if rows else [[]] * len(arrow), arrow, strict=True)], schema=arrow)

        roots: dict[str, tuple[fs.FileSystem, str]] = {}
        for b in batches:
            rows, held = [], 0
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                try:
                    if row[root] not in roots:
                        roots[row[root]] = filesystem(row[root])
                    system, place = roots[row[root]]
                    with system.open_input_stream(f"{place.rstrip('/')}/{row[path]}") as f:
                        data = f.read()
                    rows.append((*row, data.decode("utf-8", "replace"), None))
                    held += len(data)
                except (OSError, DiscoveryError) as e:
                    rows.append((*row, None, f"{type(e).__name__}: {e}"[:200]))
                if held > BATCH_BYTES or len(rows) >= ROWS_AT_ONCE:
                    yield out(rows)
                    rows, held = [], 0
            yield out(rows)

    return dealt.mapInArrow(fetch, schema)


def _kind(place: str) -> str:
    """folder, file or none."""
    system, path = filesystem(place)
    kind = system.get_file_info(path).type
    return "folder" if kind == fs.FileType.Directory else "file" if kind == fs.FileType.File else "none"


def read(spark: SparkSession, paths: list[str], include: list[str] | None = None, exclude: list[str] | None = None, **how) -> DataFrame:
    """path, lang, content and unreadable (an error) of the files of several roots: files, folders (crossed with `include`) and globs.

    Paths are relative to their root, those of several roots begin with it. Files without a language stay, with a null
    lang. Folders are listed first, without those that `exclude` takes whole; only files that all filters leave are
    opened. A root is a path that all executors see, or a URI.
    """
    shut = EXCLUDED if exclude is None else exclude
    rows = None
    for root in paths:
        kind, own = _kind(root), include
        folder, taken = root.rstrip("/") or "/", None
        if kind == "file":
            folder, _, name = root.rpartition("/")
            folder = folder or "."
            system, place = filesystem(root)
            taken = spark.createDataFrame([(folder, name, system.get_file_info(place).size, None)], "root string, path string, size long, error string")
            own = None
        elif kind == "none":
            fixed = re.split(r"[*?\[{]", root, maxsplit=1)[0].rpartition("/")[0]
            if not re.search(r"[*?\[{]", root) or _kind(fixed or ".") != "folder":
                raise DiscoveryError(f"{root}: not found")
            folder, own = fixed or ".", [root[len(fixed) + 1 :] if fixed else root]
        listed = listing(spark, [folder], shut, how.get("dotted", False)) if taken is None else taken
        some = chosen(listed.where("error is null"), own, shut, **how)
        lost = listed.where("error is not null").withColumn("lang", F.lit(None).cast("string"))
        got = contents(some.select("root", "path", "size", "lang")).select("path", "lang", "content", "unreadable")
        got = got.unionByName(lost.select("path", "lang", F.lit(None).cast("string").alias("content"), F.col("error").alias("unreadable")))
        if len(paths) > 1:
            got = got.withColumn("path", F.concat(F.lit(folder.rstrip("/") + "/"), "path"))
        rows = got if rows is None else rows.unionByName(got)
    if rows is None:
        raise DiscoveryError("no paths")
    return rows.dropDuplicates(["path"]) if len(paths) > 1 else rows
