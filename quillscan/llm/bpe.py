"""Byte-level BPE by speculation: greedy longest-match tokens, kept where every adjacent pair is compatible.

A word's tokens are its exact BPE if each token is its own encoding and each adjacent pair (a, b) encodes to
(a, b): a wrong split would show as a merge across one of the borders that comes before the merges that
built the two sides. The pair test walks down the inner edges of both merge trees and is run on whole
arrays of pairs. Words with a failing pair are merged exactly, lowest rank first.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillscan.llm.common import bounded_batches
from quillscan.llm.token_counts import default_path, library

#: Words that a worker's memo keeps, and their longest; it starts anew when full.
MEMO, LONGEST = 200_000, 256
#: Bytes of a word that is merged by scans.
SHORT = 32
#: The pre-tokeniser's pattern of the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: From this code point on, the regex module and the library may hold different Unicode classes; such texts are cut by the library.
_NEWER = re.compile("[^\x00-՗]")


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in the vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Codec:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str):
        import regex

        with open(path) as f:
            spec = json.load(f)
        letters, vocab, self.path = byte_letters(), spec["model"]["vocab"], path
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        raw = {k: bytes(letters[c] for c in k) for k in vocab if k not in self.special}
        self.ids = {raw[k]: i for k, i in vocab.items() if k in raw}
        self.bytes = {i: raw[k] for k, i in vocab.items() if k in raw} | {i: s.encode() for s, i in self.special.items()}
        self.longest = max(map(len, self.ids))
        size = max(self.bytes) + 1
        # rank of the merge that makes a token (-1 for bytes) and the two tokens that it joins
        self.rank, self.left, self.right = np.full(size, -1, np.int64), np.arange(size), np.arange(size)
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        keys = np.empty(len(spec["model"]["merges"]), np.int64)
        for r, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            a, b, c = vocab[a], vocab[b], vocab[a + b]
            self.rank[c], self.left[c], self.right[c] = r, a, b
            self.merge[a, b] = r, c
            keys[r] = a << 32 | b
        self.pair_rank = np.argsort(keys)
        self.pair_keys = keys[self.pair_rank]
        sizes: dict[bytes, set[int]] = {}  # lengths of the tokens that begin with these four bytes
        for x in self.ids:
            if len(x) > 3:
                sizes.setdefault(x[:4], set()).add(len(x))
        self.sizes = {k: (*sorted(v, reverse=True), 3, 2, 1) for k, v in sizes.items()}
        self.ranks = {pair: r for pair, (r, _) in self.merge.items()}
        self.made = [c for _, c in sorted(self.merge.values())]  # by rank
        self.single = [self.ids[bytes([b])] for b in range(256)]
        self.words, self.memo = regex.compile(PATTERN), {}
        self.split = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None

    def greedy(self, word: bytes) -> list[int]:
        get, sizes, out, i, n = self.ids.get, self.sizes.get, [], 0, len(word)
        while i < n:
            for size in sizes(word[i : i + 4], (3, 2, 1)):
                piece = word[i : i + size]
                if (t := get(piece)) is not None:
                    break
            out.append(t)
            i += len(piece)
        return out

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For each pair, whether its two tokens stay apart when their bytes are encoded together.

        The later of the two merges is undone first: until then the side's edge token was what could join
        the other side. A pair fails if such an edge pair merges before the later merge takes place.
        """
        ok, at = np.ones(len(a), bool), np.arange(len(a))
        limit = np.full(len(a), np.iinfo(np.int64).max)
        equal = np.zeros(len(a), bool)  # whether a merge of rank `limit` itself would still come first
        while len(at):
            key = a << 32 | b
            k = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
            r = np.where(self.pair_keys[k] == key, self.pair_rank[k], np.iinfo(np.int64).max)
            bad = (r < limit) | (equal & (r == limit))
            ok[at[bad]] = False
            ra, rb = self.rank[a], self.rank[b]
            undo_a = (ra > rb) | (rb < 0)  # on equal ranks the left one came first, so the right one is undone first
            top = np.maximum(ra, rb)
            keep = ~bad & (top >= 0)
            limit, equal = top, ~undo_a  # a pair across the border starts left of a right-hand merge of equal rank, so it comes first
            a, b = np.where(undo_a, self.right[a], a), np.where(undo_a, b, self.left[b])
            at, a, b, limit, equal = at[keep], a[keep], b[keep], limit[keep], equal[keep]
        return ok

    def exact(self, word: bytes) -> list[int]:
        """Merges lowest rank first, leftmost on ties: short words by scans, others by a heap over a linked list, n log n for any length."""
        tok = [self.single[b] for b in word]
        if len(tok) <= SHORT:
            return self._scan(tok)
        after, before, heap = [*range(1, len(tok)), -1], [*range(-1, len(tok) - 1)], []
        for i in range(len(tok) - 1):
            if m := self.merge.get((tok[i], tok[i + 1])):
                heap.append((m[0], i, tok[i], tok[i + 1]))
        heapq.heapify(heap)
        while heap:
            _, i, x, y = heapq.heappop(heap)
            j = after[i]
            if tok[i] != x or j < 0 or tok[j] != y:
                continue
            tok[i], tok[j], after[i] = self.merge[x, y][1], -1, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for p, q in ((before[i], i), (i, after[i])):
                if p >= 0 and q >= 0 and (m := self.merge.get((tok[p], tok[q]))):
                    heapq.heappush(heap, (m[0], p, tok[p], tok[q]))
        return [t for t in tok if t >= 0]

    def _scan(self, tok: list[int]) -> list[int]:
        get, made, none = self.ranks.get, self.made, len(self.made)
        ranks = [get(pair, none) for pair in zip(tok, tok[1:], strict=False)]
        while (r := min(ranks, default=none)) < none:
            at = ranks.index(r)
            tok[at : at + 2] = (made[r],)
            del ranks[at]
            if at:
                ranks[at - 1] = get((tok[at - 1], tok[at]), none)
            if at < len(ranks):
                ranks[at] = get((tok[at], tok[at + 1]), none)
        return tok

    def learn(self, words: list[str]) -> None:
        """Puts each word's ids, as little-endian bytes, into the memo."""
        raw = [w.encode() for w in words]
        tokens = [self.greedy(w) for w in raw]
        lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
        flat = np.fromiter((t for x in tokens for t in x), np.int64, int(lengths.sum()))
        owner = np.repeat(np.arange(len(tokens)), lengths)
        inner = owner[:-1] == owner[1:]
        pairs, back = np.unique((flat[:-1] << 32 | flat[1:])[inner], return_inverse=True)
        good = self.compatible(pairs >> 32, pairs & 0xFFFFFFFF)
        ends = np.cumsum(lengths) * 4
        data = flat.astype("<u4").tobytes()
        self.memo.update((w, data[a:b]) for w, a, b in zip(words, (ends - lengths * 4).tolist(), ends.tolist(), strict=True))
        for w in np.unique(owner[:-1][inner][~good[back]]).tolist():
            self.memo[words[w]] = np.array(self.exact(raw[w]), "<u4").tobytes()

    def pieces(self, text: str) -> list[str]:
        """The words of a text; special strings stand alone."""
        if self.split and any(s in text for s in self.special):
            return [w for x in self.split.split(text) for w in ([x] if x in self.special else self.pieces(x))]
        if _NEWER.search(text):
            return [text[a:b] for _, (a, b) in library(self.path).pre_tokenizer.pre_tokenize_str(text)]
        return self.words.findall(text)

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        cut = [self.pieces(x) for x in texts]
        memo = self.memo
        if len(memo) > MEMO:
            memo.clear()
        new = set()
        for x in cut:
            new.update(x)
        new -= memo.keys()
        for s in new & self.special.keys():
            memo[s] = self.special[s].to_bytes(4, "little")
            new.discard(s)
        if new:
            self.learn(list(new))
        out = [b"".join(map(memo.__getitem__, x)) for x in cut]
        for w in new:
            if len(w) > LONGEST:
                del memo[w]
        return out

    def decode(self, ids: bytes) -> str:
        get = self.bytes.__getitem__
        return b"".join(map(get, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


@cache
def codec(path: str) -> Codec:
    return Codec(path)


def encode(df: DataFrame, text: str = "text", path: str | None = None, out: str = "ids") -> DataFrame:
    """df with a binary column `out`: the ids of each whole text as little-endian unsigned 32-bit integers.

    Null and empty texts get no ids (empty, never null). An existing column `out` is replaced. One pass, no shuffle.
    """
    bounded_batches(df.sparkSession)
    path = path or default_path()

    @F.arrow_udf("binary")
    def ids(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in parts:
            yield pa.array(codec(path).encode_batch([x or "" for x in part.to_pylist()]), pa.binary())

    return df.withColumn(out, ids(F.col(text)))


def decode(df: DataFrame, ids: str = "ids", path: str | None = None, out: str = "decoded") -> DataFrame:
    """df with a string column `out`: the text of each id sequence; null ids give an empty text."""
    bounded_batches(df.sparkSession)
    path = path or default_path()

    @F.arrow_udf("string")
    def text(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in parts:
            yield pa.array([codec(path).decode(x or b"") for x in part.to_pylist()], pa.string())

    return df.withColumn(out, text(F.col(ids)))


def op2(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    coded = decode(encode(docs).drop("text"))
    return coded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
