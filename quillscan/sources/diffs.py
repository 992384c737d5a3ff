"""Unified diffs as rows of changed lines or ranges."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quillscan.sources.shared import saved, tasks_for

_HUNK = re.compile(r"@@ -\d+(?:,(?P<old>\d+))? \+(?P<at>\d+)(?:,(?P<new>\d+))? @@")


def parse(text: str) -> list[tuple[str, int]]:
    """File and new line number of each added line. A hunk's body is as long as its head counts, whatever its lines look like.

    Every line is counted once for the old and once for the new file; where a body ends, and the number of a line in
    it, are differences of these running counts. Text that isn't empty and names no new file is an error. A deleted
    file contributes nothing.
    """
    rows = text.split("\n")
    sign = np.array([x[:1] for x in rows])
    counted = [np.concatenate([[0], np.cumsum((sign != other) & (sign != "\\"))]) for other in ("+", "-")]  # old, new
    heads = [(k, m) for k, x in enumerate(rows) if (m := _HUNK.match(x))]
    names = [(k, None if (name := x[4:].split("\t")[0].strip()) == "/dev/null" else name.removeprefix("b/")) for k, x in enumerate(rows) if x.startswith("+++ ")]
    out, free, file, named = [], 0, None, False
    for k, found in sorted([*heads, *names], key=lambda x: x[0]):
        if k < free:  # within a body
            continue
        if not isinstance(found, re.Match):
            file, named = found, True
            continue
        first = k + 1
        ends = [np.searchsorted(c, c[first] + int(found[side] or 1)) if found[side] != "0" else first for c, side in zip(counted, ("old", "new"), strict=True)]
        free = min(max(ends), len(rows))
        if file:
            added = first + np.flatnonzero(sign[first:free] == "+")
            out += [(file, n) for n in (int(found["at"]) + counted[1][added] - counted[1][first]).tolist()]
    if text.strip() and not named:
        raise ValueError("not a unified diff: no new file is named")
    return out


def changed_lines(diffs: DataFrame, key: str, text: str = "diff") -> DataFrame:
    """key, file and line (long) of each added line of diffs, one text a row."""
    schema = diffs.select(key).schema[0]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(k, f, n) for k, t in b.itertuples(index=False) for f, n in parse(t or "")], columns=[key, "file", "line"])

    return diffs.select(key, text).mapInPandas(read, f"{key} {schema.dataType.simpleString()}, file string, line long")


#: Lines of a diff that are kept in one row.
LINES_A_ROW = 1000
#: Rows that are broadcast at most.
MOST_SENT = 100_000
#: A hunk: its file (null: none, or that of the rows before if not `named`), its new number, the counts of new lines before its body, and of both where it ends.
_HUNK_DDL = "struct<file string, named boolean, at long, new long, old_end long, new_end long>"
#: What heads of a row say, with counts from its beginning: counts before the first and the last line like a head, the last hunk, the last file named; read as if a body before ended at used_old and used_new.
_SUMMARY = f"first struct<old long, new long>, last struct<old long, new long>, hunk {_HUNK_DDL}, told struct<file string>, used_old long, used_new long"
#: What a row begins with, in counts of its diff: lines before, the last hunk, the current file. again: its heads must be read under that.
_STATE = f"key string, part long, base_old long, base_new long, carry {_HUNK_DDL}, file string, said boolean, named boolean, again boolean"


def _packed(rows: DataFrame, parts: int) -> DataFrame:
    """rows (key, line_no, line) dealt once by ranges, in order, and written as rows of up to LINES_A_ROW: key, part (the first line_no), lines, old and new (their counts), said."""
    ranged = rows.repartitionByRange(parts, "key", "line_no").sortWithinPartitions("key", "line_no")
    sign = F.substring("line", 1, 1)
    told = ranged.withColumns({"old": (~sign.isin("+", "\\")).cast("int"), "new": (~sign.isin("-", "\\")).cast("int"), "said": (F.trim("line") != "").cast("int")})
    kind = rows.schema["key"].dataType.simpleString()
    schema = T.StructType.fromDDL(f"key {kind}, part long, lines array<string>, old long, new long, said boolean")
    arrow = to_arrow_schema(schema)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            codes = b.column("key").dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
            at = np.arange(b.num_rows)
            begins = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
            own = at - np.repeat(begins, np.diff(np.append(begins, b.num_rows)))
            starts = np.flatnonzero(own % LINES_A_ROW == 0)
            lines = pa.ListArray.from_arrays(pa.array(np.append(starts, b.num_rows), pa.int32()), b.column("line"))
            sums = [np.add.reduceat(b.column(c).to_numpy(zero_copy_only=False).astype("int64"), starts) for c in ("old", "new", "said")]
            columns = [b.column("key").take(pa.array(starts)), b.column("line_no").take(pa.array(starts)), lines, sums[0], sums[1], sums[2] > 0]
            yield pa.RecordBatch.from_arrays([(x if isinstance(x, pa.Array) else pa.array(x)).cast(f.type) for x, f in zip(columns, arrow, strict=True)], schema=arrow)

    return saved(told.mapInArrow(pack, schema), "diff")


def _read(lines: pa.Array, old_end: int, new_end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[int, int, int]], list[tuple[int, tuple]]]:
    """Of one row's lines, where a body lasts until both counts: which lines are added, counts of old and of new lines before each line, lines like heads (place, counts before it), and heads that stand in no body."""
    sign = pc.utf8_slice_codeunits(lines, 0, 1)
    signs = {x: pc.equal(sign, x).to_numpy(zero_copy_only=False) for x in "+-\\"}
    old, new = (np.concatenate([[0], np.cumsum(~(signs[x] | signs["\\"]))]) for x in ("+", "-"))
    like = np.flatnonzero(pc.or_(pc.starts_with(lines, "+++ "), pc.starts_with(lines, "@@ ")).to_numpy(zero_copy_only=False))
    heads, file, named = [], None, False
    for k, o, n, line in zip(like.tolist(), old[like].tolist(), new[like].tolist(), lines.take(pa.array(like)).to_pylist(), strict=True):
        if o < old_end or n < new_end:  # within a body
            continue
        if line.startswith("+++ "):
            name = line[4:].split("\t")[0].strip()
            file, named = None if name == "/dev/null" else name.removeprefix("b/"), True
            heads.append((k, (file,)))
        elif m := _HUNK.match(line):
            # the head's own line is counted as well: its body begins behind it
            old_end, new_end = o + 1 + int(m["old"] or 1), n + 1 + int(m["new"] or 1)
            heads.append((k, (file, named, int(m["at"]), n + 1, old_end, new_end)))
    return signs["+"], old, new, [(k, int(old[k]), int(new[k])) for k in (like[[0, -1]].tolist() if len(like) else [])], heads


def _summarised(given: DataFrame) -> DataFrame:
    """key, part, old, new, said and _SUMMARY of packed rows with _from_old and _from_new: where the body before them ends, in their own counts."""
    kind = given.schema["key"].dataType.simpleString()
    schema = T.StructType.fromDDL(f"key {kind}, part long, old long, new long, said boolean, {_SUMMARY}")
    arrow, same = to_arrow_schema(schema), ["key", "part", "old", "new", "said"]
    hunk = [f.name for f in T.StructType.fromDDL(f"hunk {_HUNK_DDL}")["hunk"].dataType]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for lines, old, new in zip(b.column("lines"), b.column("_from_old").to_pylist(), b.column("_from_new").to_pylist(), strict=True):
                *_, like, heads = _read(lines.values, old, new)
                hunks, names = [h for _, h in heads if len(h) > 1], [h for _, h in heads if len(h) == 1]
                ends = [{"old": o, "new": n} for _, o, n in like] or [None, None]
                out.append((ends[0], ends[1], dict(zip(hunk, hunks[-1], strict=True)) if hunks else None, {"file": names[-1][0]} if names else None, old, new))
            told = [pa.array(x, f.type) for x, f in zip(zip(*out, strict=True) if out else [[]] * 6, list(arrow)[5:], strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(c).cast(arrow.field(c).type) for c in same), *told], schema=arrow)

    return saved(given.mapInArrow(read, schema), "heads")


def _begun(summaries: DataFrame) -> DataFrame:
    """_STATE of each packed row, by its diff's rows in order; one row of summary stands for up to LINES_A_ROW lines.

    A row's heads count as they were read unless the body before reaches beyond the first one. Where it reaches beyond the
    last one there are none; else the row is to be read again.
    """
    kind = summaries.schema["key"].dataType.simpleString()
    schema = T.StructType.fromDDL(_STATE.replace("key string", f"key {kind}"))
    arrow = to_arrow_schema(schema)

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, old, new, carry, file, named = object(), 0, 0, None, None, False
        for b in batches:
            out = []
            for r in b.to_pylist():
                if r["key"] != key:
                    key, old, new, carry, file, named = r["key"], 0, 0, None, None, False
                first, last, again, counts = r["first"], r["last"], False, True
                state = (r["key"], r["part"], old, new, carry, file, r["said"])
                if first is not None:
                    ends = (carry["old_end"] - old, carry["new_end"] - new) if carry else (0, 0)
                    used = (r["used_old"], r["used_new"])
                    inside = lambda x, to: x["old"] < to[0] or x["new"] < to[1]
                    counts = not inside(last, ends)
                    again = counts and (used != ends if inside(first, ends) else inside(first, used))
                if counts and (h := r["hunk"]):
                    whose = h["file"] if h["named"] else file
                    carry = {"file": whose, "named": True, "at": h["at"], "new": h["new"] + new, "old_end": h["old_end"] + old, "new_end": h["new_end"] + new}
                if counts and r["told"]:
                    file, named = r["told"]["file"], True
                old, new = old + r["old"], new + r["new"]
                out.append((*state, named, again))
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True) if out else [[]] * len(arrow), arrow, strict=True)], schema=arrow)

    return saved(summaries.repartition("key").sortWithinPartitions("key", "part").mapInArrow(sweep, schema), "begins")


def _met(packed: DataFrame, state: DataFrame) -> DataFrame:
    """Packed rows with their state (one row for each key and part); without nulls in what they are joined by, few are broadcast."""
    state = state.withColumnsRenamed({"key": "_k", "part": "_p"})
    state = F.broadcast(state) if state.count() <= MOST_SENT else state
    return packed.join(state, packed["key"].eqNullSafe(state["_k"]) & (packed["part"] == state["_p"])).drop("_k", "_p")


def _placed(rows: DataFrame, key: str) -> DataFrame:
    """key, file and line of the added lines of packed rows with their state."""
    schema = T.StructType([T.StructField(key, rows.schema["key"].dataType), *T.StructType.fromDDL("file string, line long")])
    arrow = to_arrow_schema(schema)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for one, lines, base_old, base_new, carry, file in zip(b.column("key"), b.column("lines"), *(b.column(c).to_pylist() for c in ("base_old", "base_new", "carry", "file")), strict=True):
                begun = (carry["file"], carry["at"], carry["new"] - base_new, carry["old_end"] - base_old, carry["new_end"] - base_new) if carry else (None, 0, 0, 0, 0)
                added, old, new, _, heads = _read(lines.values, begun[3], begun[4])
                hunks = [(-1, begun), *((k, (h[0] if h[1] else file, *h[2:])) for k, h in heads if len(h) > 1)]
                files = pa.array([h[0] for _, h in hunks], pa.string())
                at, first, old_end, new_end = (np.array([h[x] for _, h in hunks], "int64") for x in range(1, 5))
                of = np.searchsorted(np.array([k for k, _ in hunks]), np.arange(len(added)), "right") - 1
                has = files.is_valid().to_numpy(zero_copy_only=False)[of]
                got = np.flatnonzero(added & has & ((old[:-1] < old_end[of]) | (new[:-1] < new_end[of])))
                if len(got):
                    of = of[got]
                    yield pa.RecordBatch.from_arrays([pa.repeat(one, len(got)).cast(arrow[0].type), files.take(pa.array(of)), pa.array(at[of] + new[got] - first[of])], schema=arrow)

    return rows.select("key", "lines", "base_old", "base_new", "carry", "file").mapInArrow(place, schema)


def added_lines(lined: DataFrame, key: str, n: int | None = None) -> DataFrame:
    """key, file and line (long) of each added line of diffs given by lines (key, line_no, line), however long one is; read as by `parse`.

    Lines are dealt once by ranges and written once, many in a row. A row's heads are read as if no body reached into it.
    A sweep over the rows' summaries, not their lines, tells what each begins with: the counts of old and new lines before
    it, the current file, and the last hunk, whose body lasts until both counts have grown by what its head says. Where that
    ends among lines like heads a row is read again, until no beginning changes. Then each row gives its lines, which are
    never dealt again. A diff that isn't blank and names no new file is an error. No task has all lines, or all heads, of a
    diff. n: about how many lines there are, which ranges follow; counted otherwise.
    """
    text = F.coalesce("line", F.lit(""))
    # of a line that is no head its sign is enough, and whether it says anything
    short = F.when(text.startswith("+++ ") | text.startswith("@@ "), text).otherwise(F.concat(F.substring(text, 1, 1), F.when(F.trim(text) != "", ".").otherwise("")))
    rows = lined.select(F.col(key).alias("key"), F.col("line_no").cast("long").alias("line_no"), short.alias("line"))
    n = rows.count() if n is None else n
    packed = _packed(rows, tasks_for(rows.sparkSession, n))
    none = F.lit(0).cast("long")
    found = _summarised(packed.withColumns({"_from_old": none, "_from_new": none}))
    while True:
        state = _begun(found)
        again = state.where("again").select("key", "part", *[F.coalesce(F.col(f"carry.{x}_end") - F.col(f"base_{x}"), none).alias(f"_{x}") for x in ("old", "new")])
        if again.isEmpty():
            break
        again = saved(again, "again")
        redone = _summarised(_met(packed, again.withColumnsRenamed({"_old": "_from_old", "_new": "_from_new"})))
        was = again.select(F.col("key").alias("_k"), F.col("part").alias("_p"))
        found = saved(found.join(was, found["key"].eqNullSafe(was["_k"]) & (found["part"] == was["_p"]), "left_anti").unionByName(redone), "heads")
    if odd := state.groupBy("key").agg(F.max("said").alias("said"), F.max("named").alias("named")).where("said and not named").first():
        raise ValueError(f"not a unified diff: no new file is named ({odd['key']})")
    return _placed(_met(packed, state.drop("said", "named", "again")), key)


def changed_ranges(lined: DataFrame, key: str) -> DataFrame:
    """key, file, s and e of each hunk of diff lines (key, line_no, line), by their heads; empty ones are left out.

    The current file is carried forward by a window; a body line that looks like a head counts as one here.
    """
    w = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    name = F.when(F.col("line").startswith("+++ b/"), F.regexp_extract("line", r"^\+\+\+ b/([^\t]*)", 1)).when(F.col("line").startswith("+++ "), F.lit(""))
    head = lined.withColumn("file", F.last(name, ignorenulls=True).over(w)).where(F.col("line").startswith("@@"))
    got = lambda k: F.regexp_extract("line", r"^@@ -\d+(?:,\d+)? \+(\d+)(?:,(\d+))? @@", k)
    count = F.when(got(2) == "", F.lit(1)).otherwise(F.expr("try_cast(regexp_extract(line, '^@@ -[0-9]+(?:,[0-9]+)? [+]([0-9]+)(?:,([0-9]+))? @@', 2) as int)"))
    hunks = head.select(key, "file", got(1).try_cast("long").alias("s"), count.alias("n"))
    return hunks.where("file <> '' and n > 0").select(key, "file", "s", (F.col("s") + F.col("n") - 1).alias("e"))
