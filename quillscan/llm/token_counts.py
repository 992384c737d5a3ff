"""Token counts by batch encoding in Arrow functions that return lengths only.

A batch of rows holds bounded bytes (common.BATCH_BYTES). Texts of a byte-level BPE are split at safe
boundaries: before a single space between two non-blanks, where no token of such a vocabulary's
pre-tokeniser can cross, so a text's count is the sum over its chunks. Equal chunks are encoded once a
worker, in calls of the library over CALL_BYTES each, and a memo of bounded size keeps their lengths.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillscan.llm.common import bounded_batches

#: Bytes of text that one call of the library gets; chunks that a worker's memo keeps, and their longest.
CALL_BYTES, MEMO, LONGEST = 1 << 20, 200_000, 256
#: White space, as any of the libraries sees it, that is no plain space or line feed.
_ODD = re.compile("[\t\r\x0b\x0c\x1c-\x1f\x85\xa0 ᠎ -‏ -  ⁠　﻿]")
_SAFE = re.compile(r"(?<=\S) (?=\S)")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@cache
def library(path: str):
    """The tokenizers object of a .json file, without truncation and padding."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return tok


@cache
def byte_level(path: str) -> tuple[bool, tuple[str, ...]]:
    """Whether chunks at safe boundaries may be encoded alone, and the special strings inside texts."""
    import json

    with open(path) as f:
        model = json.load(f)
    pre = model.get("pre_tokenizer") or {}
    plain = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not model.get("normalizer")
    return bool(plain), tuple(t["content"] for t in model.get("added_tokens", ()))


def chunks(text: str, special: tuple[str, ...]) -> list[str]:
    """The text cut at safe boundaries; chunks after the first begin with their space. One chunk if special strings occur."""
    if any(s in text for s in special):
        return [text]
    if "  " in text or " \n" in text or "\n " in text or text[:1] == " " or text[-1:] == " " or _ODD.search(text):
        head, *rest = _SAFE.split(text)
        return [head, *(" " + x for x in rest)]
    head, *rest = text.split(" ")
    return [head, *map(" ".__add__, rest)]


class Counter:
    """Token counts of texts by one library file; the memo of chunk lengths starts anew when it is full."""

    def __init__(self, path: str):
        self.path, self.memo = path, {}
        if path.endswith(".model"):
            import sentencepiece

            self.piece = sentencepiece.SentencePieceProcessor(model_file=path)

    def lengths(self, texts: list[str]) -> list[int]:
        if self.path.endswith(".model"):
            return [len(x) for part in _calls(texts) for x in self.piece.encode(part, num_threads=1)]
        tok, out = library(self.path), []
        for part in _calls(texts):
            out += [len(x) for x in tok.encode_batch_fast(part, add_special_tokens=False)]
        return out

    def __call__(self, texts: list[str]) -> list[int]:
        split, special = (False, ()) if self.path.endswith(".model") else byte_level(self.path)
        if not split:
            return self.lengths(texts)
        cut = [chunks(x, special) for x in texts]
        memo = self.memo
        if len(memo) > MEMO:
            memo.clear()
        new = list({c for cs in cut for c in cs} - memo.keys())
        memo.update(zip(new, self.lengths(new), strict=True))
        out = [sum(map(memo.__getitem__, cs)) for cs in cut]
        for c in new:
            if len(c) > LONGEST:
                del memo[c]
        return out


def _calls(texts: list[str]) -> Iterator[list[str]]:
    """Runs of texts of about CALL_BYTES each."""
    part, size = [], 0
    for x in texts:
        part.append(x)
        size += len(x)
        if size >= CALL_BYTES:
            yield part
            part, size = [], 0
    if part:
        yield part


@cache
def _counter(path: str) -> Counter:
    return Counter(path)


def count_tokens(df: DataFrame, text: str = "text", path: str | None = None, out: str = "n_tokens") -> DataFrame:
    """df with a long column `out`: the tokens that the library of `path` gives each text, without added specials.

    A null text counts as empty and has no tokens; an existing column `out` is replaced. One pass, no shuffle.
    """
    bounded_batches(df.sparkSession)
    path = path or default_path()

    @F.arrow_udf("long")
    def lengths(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        count = _counter(path)
        for part in parts:
            yield pa.array(count([x or "" for x in part.to_pylist()]), pa.int64())

    return df.withColumn(out, lengths(F.col(text)))


def op9(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    counted = count_tokens(docs)
    return counted.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"))
