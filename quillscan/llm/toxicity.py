"""Toxicity by a support vector machine over a gap-weighted subsequence string kernel with Nystroem landmarks.

The kernel compares words by their subsequences of three characters within SPAN, each weighted DECAY for every
character skipped, so insults with gaps or inserted characters stay close to the plain ones. The machine learns from
sentences of labelled documents, each a bag of words: a toxic sentence is held by its most telling word; clean
documents' words are the other side, those that the machine holds for worst joining it round by round. The
landmarks' kernel matrix maps words to a space where a linear machine is trained; as every kernel value is a sum
over subsequences, its decision is one table of weights of the landmarks' hashed subsequences, which scores a word with
a few lookups, in any script. A document is judged by its worst word and by the sum and rate of its words' evidence, which a second
linear machine weighs, calibrated to 0..1.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillscan.llm.common import bounded_batches, give_back, held_out

#: Kernel: the widest subsequence and the weight of a skipped character. Words longer than WINDOW are scored in overlapping windows.
SPAN, DECAY, WINDOW = 6, 0.6, 24
#: Bound of the training sample: toxic and clean documents, and the characters of the longest one (longer ones are scored, whole, but not learned from).
SAMPLE, CLEAN, LONGEST = 800, 2000, 50_000
#: Landmarks of each label; words that a partition's memo keeps, and their longest.
LANDMARKS, MEMO, MEMO_WORD = 256, 100_000, 256
#: Toxic documents in the sample from which a part of it is set aside for the calibration.
ENOUGH = 200
#: Words, or windows of long words, that are taken apart at once.
PART = 1000
#: Slots of the table of subsequences (a power of two).
SLOTS = 1 << 20
#: From this score on a document is toxic.
LIMIT = 0.3
#: Log-likelihood ratio from which a run of letters tells the labels apart, and the least share of toxic documents that have it; rounds in which clean words that score high join the training.
TELLING, LEAST, ROUNDS = 25.0, 0.015, 5
_PATTERNS = [(a, b) for b in range(2, SPAN) for a in range(1, b)]
_SENTENCE = re.compile(r"[.!?]\s|\n")
_MARKS = re.compile(r"[\W\d_]+")
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")


def normal(word: str) -> str:
    """Lower case, without marks at its ends, unless nothing else is left."""
    return _EDGE.sub("", word.lower())


def words_of(sentence: str) -> list[str]:
    """White-space words; a run of three or more single characters is one word as well."""
    ws = sentence.split()
    size = np.fromiter(map(len, ws), np.int64, len(ws)) == 1
    if size.sum() >= 3:
        edge = np.flatnonzero(np.diff(np.concatenate([[0], size.view(np.int8), [0]])))
        ws += ["".join(ws[a:b]) for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True) if b - a >= 3]
    return ws


def views(word: str) -> list[str]:
    """What is scored of a word: it, and its letters alone if marks or digits stand between them."""
    w = normal(word)
    if not w.isalpha() and len(letters := _MARKS.sub("", w)) >= 3 and letters != w:
        return windows(w) + windows(letters)
    return windows(w)


def inserted(words: list[str]) -> list[str]:
    """Each word with one strange letter put in, for training: at each place in turn over the words; letters are rare ones of other words, so of their scripts."""
    often = Counter(x for w in words for x in set(w) if x.isalpha())
    rare = sorted(often, key=lambda x: (often[x], x))[: max(6, len(often) // 4)] or ["x"]
    return [w[: (p := 1 + i % max(1, len(w) - 1))] + rare[i % len(rare)] + w[p:] for i, w in enumerate(words)]


def windows(word: str) -> list[str]:
    return [word] if len(word) <= WINDOW else [word[i : i + WINDOW] for i in range(0, len(word) - WINDOW // 2, WINDOW // 2)]


def _mixed(x: np.ndarray, y: np.ndarray, z: np.ndarray) -> np.ndarray:
    """32-bit hashes of triples of code points."""
    h = x * np.uint64(0x9E3779B97F4A7C15) ^ y * np.uint64(0xC2B2AE3D27D4EB4F) ^ z * np.uint64(0x165667B19E3779F9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xD1342543DE82EF95)
    return (h >> np.uint64(32)).astype(np.int64)


def subsequences(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owner, hash and normalised weight of each subsequence of the words; a word's ends are characters as well."""
    words = [f"^{w}$" for w in words]
    size = np.fromiter(map(len, words), np.int64, len(words))
    code = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), size)
    left = (np.cumsum(size)[owner] - 1 - np.arange(len(code))) if len(code) else np.empty(0, np.int64)  # characters after it in its word
    owners, codes, weights, norm = [], [], [], np.zeros(len(words))
    for a, b in _PATTERNS:
        norm += np.maximum(size - b, 0) * DECAY ** (2 * (b - 2))
        i = np.flatnonzero(left >= b)
        owners.append(owner[i])
        codes.append(_mixed(code[i], code[i + a], code[i + b]))
        weights.append(np.full(len(i), DECAY ** (b - 2)))
    o = np.concatenate(owners)
    return o, np.concatenate(codes), np.concatenate(weights) / np.sqrt(np.maximum(norm, 1e-12))[o]


class Features:
    """The subsequences that landmarks have, in a table by the low bits of their hash; the high bits tell them from others."""

    def __init__(self, hashes: np.ndarray):
        hashes = np.unique(hashes)
        self.slots, first = np.unique(hashes & (SLOTS - 1), return_index=True)
        self.tag = np.full(SLOTS, -1, np.int16)
        self.tag[self.slots] = hashes[first] >> SLOTS.bit_length() - 1

    def known(self, hashes: np.ndarray) -> np.ndarray:
        return self.tag[hashes & (SLOTS - 1)] == hashes >> SLOTS.bit_length() - 1


class Machine:
    """A trained scorer: a weight for each subsequence of the landmarks, a bias, the weights of documents' evidence and the calibration of their scores."""

    def __init__(self, features: Features | None, table: np.ndarray, bias: float, steps: tuple[np.ndarray, np.ndarray]):
        self.features, self.table, self.bias, self.steps = features, table, bias, steps
        self.weights = np.array([1.0, 0.0, 0.0])

    def decide(self, words: list[str]) -> np.ndarray:
        """The machine's decision for each word; that of a word without letters is the bias."""
        if self.features is None or not words:
            return np.zeros(len(words))
        cut = [views(w) for w in words]
        flat = [x for c in cut for x in c]
        got = np.concatenate([self._decide(flat[i : i + PART]) for i in range(0, len(flat), PART)])
        out = np.full(len(words), -np.inf)
        np.maximum.at(out, np.repeat(np.arange(len(words)), [len(c) for c in cut]), got)
        return out

    def _decide(self, part: list[str]) -> np.ndarray:
        o, hashes, weights = subsequences(part)
        seen = np.flatnonzero(self.features.known(hashes))
        return np.bincount(o[seen], self.table[hashes[seen] & (SLOTS - 1)] * weights[seen], len(part)) + self.bias

    def evidence(self, values: list[np.ndarray] | np.ndarray) -> np.ndarray:
        """A row for each document from its words' decisions (a number is a document of one word): the worst word, sum and rate of what lies above zero."""
        out = np.array([[self.bias, 0.0, 0.0]] * len(values)).reshape(-1, 3)
        for row, v in zip(out, map(np.atleast_1d, values), strict=True):
            if len(v):
                total = float(np.clip(v, 0, 1).sum())
                row[:] = v.max(), np.log1p(total), np.sqrt(total / len(v))
        out[:, 0] = np.clip(out[:, 0], -2, 2)
        return out

    def score(self, values: list[np.ndarray] | np.ndarray) -> np.ndarray:
        """Documents' scores from their words' decisions."""
        at, level = self.steps
        return level[np.maximum(np.searchsorted(at, self.evidence(values) @ self.weights, "right") - 1, 0)]


FLAT = np.array([0.0]), np.array([0.0])
NOTHING = Machine(None, np.zeros(1, np.float32), 0.0, FLAT)


def _runs(word: str) -> set[str]:
    """Runs of four letters; the word's start counts as a letter of its own."""
    return {word[i : i + 4] for i in range(max(1, len(word) - 3))} | {f"^{word[:4]}"}


def _mark(text: str) -> tuple[int, ...]:
    """What near copies have in common: the least four hashes of three words in a row."""
    w = text.lower().split()
    return tuple(sorted({zlib.crc32(" ".join(w[i : i + 3]).encode()) for i in range(max(1, len(w) - 2))})[:4])


def train(texts: list[str], toxic: list[int], prior: float) -> Machine:
    """A machine from labelled texts; prior is the share of toxic ones in the whole, for the calibration."""
    y = np.array(toxic)
    if not 0 < y.sum() < len(y):
        return NOTHING
    once: dict[str, str] = {}  # each word is kept in memory once
    sentences, bags = [], []
    for text, label in zip(texts, toxic, strict=True):
        cut = [{once.setdefault(w, w) for x in words_of(s) if len(w := normal(x)) <= WINDOW and w} for s in _SENTENCE.split(text)]
        bags.append(Counter(once.setdefault(w, w) for x in words_of(text) if len(w := normal(x)) <= WINDOW and w))
        sentences.append(cut if label else [])
    # of near copies one tells, else their rare words look like a sign of the label
    alone = list({(label, _mark(text)): k for k, (text, label) in enumerate(zip(texts, y.tolist(), strict=True))}.values())
    # a quarter is set aside to calibrate on words that the training hasn't seen, if that leaves enough toxic documents
    apart = [k for i, k in enumerate(alone) if i % 4 == 0] if y[alone].sum() >= ENOUGH else []
    alone = sorted(set(alone) - set(apart))
    held = apart or alone
    held_words, held_y = [words_of(texts[k]) for k in held], y[held]
    sentences, bags, y = [sentences[k] for k in alone], [bags[k] for k in alone], y[alone]
    # a word's suspicion: the most telling of its runs of four letters, by documents of either label that have it, or have it again
    once_in, again_in = (Counter(), Counter()), (Counter(), Counter())  # clean, toxic
    for bag, label in zip(bags, y.tolist(), strict=True):
        runs: Counter = Counter()
        for w, n in bag.items():
            runs.update(dict.fromkeys(_runs(w), n))
        once_in[label].update(runs.keys())
        again_in[label].update(g for g, n in runs.items() if n > 1)
    bad, good = y.sum(), len(y) - y.sum()
    tell: dict[str, float] = {}
    for clean, hits in (once_in, again_in):
        for g, n in hits.items():
            if n >= LEAST * bad and n / bad > 4 * clean[g] / good and (v := _likelihood(n, clean[g], bad, good)) > TELLING:
                tell[g] = max(v, tell.get(g, 0.0))
    suspicion = lambda w: max(tell.get(g, 0.0) for g in _runs(w))
    seen_toxic = Counter(w for bag, label in zip(bags, y, strict=True) if label for w in bag)
    seen_clean = Counter(w for bag, label in zip(bags, y, strict=True) if not label for w in bag)
    # what of a word's occurrences is toxic, at equal numbers of documents of either label
    share = lambda w: (a := seen_toxic[w] / bad) / (a + seen_clean[w] / good)
    witness: Counter = Counter()
    for d, label in zip(sentences, y, strict=True):
        if label:
            for s in d:
                if known := [(suspicion(w) * share(w), w) for w in s]:
                    top = max(known)
                    if top[0] > 0 and share(top[1]) > 0.5:
                        witness[top[1]] += share(top[1])
    if not witness:
        return NOTHING
    positive = [w for w, _ in witness.most_common(2000)]
    good_words = sorted(seen_clean)
    # the most frequent clean words, and those that look most like the witnesses; later those that score highest join
    rare = sorted(seen_clean, key=lambda w: (-suspicion(w), w))[:1000]
    negative = list(dict.fromkeys([w for w, _ in seen_clean.most_common(2000)] + rare))
    if not negative:
        return NOTHING
    variants = inserted(positive)
    weigh = np.sqrt([witness[w] for w in positive])
    hard, machine = rare, NOTHING
    for _ in range(ROUNDS):
        marks = list(dict.fromkeys(positive[:LANDMARKS] + [w for w, _ in seen_clean.most_common(LANDMARKS // 4)] + hard[:LANDMARKS]))
        often = np.sqrt([seen_clean[x] for x in negative])  # a word that many documents have does more harm
        cost = np.concatenate([0.4 * weigh / weigh.sum(), 0.1 * weigh / weigh.sum(), 0.5 * often / often.sum()])
        t = np.concatenate([np.ones(2 * len(positive)), -np.ones(len(negative))])
        features, table, b = _nystroem(marks, positive + variants + negative, t, cost)
        machine = Machine(features, table, b, FLAT)
        value = machine.decide(good_words)
        hard = [good_words[i] for i in np.argsort(-value)[:1000]]
        negative = list(dict.fromkeys(negative + hard))
    flat = sorted({w for ws in held_words for w in ws})
    value = dict(zip(flat, machine.decide(flat).tolist(), strict=True))
    seen = machine.evidence([np.array([value[w] for w in ws]) for ws in held_words])
    toxic_n, clean_n = max(held_y.sum(), 1), max(len(held_y) - held_y.sum(), 1)
    machine.weights = _rising(seen, np.where(held_y == 1, 1.0, -1.0), np.where(held_y == 1, 0.5 / toxic_n, 0.5 / clean_n))
    machine.steps = _calibrate(seen @ machine.weights, held_y, np.where(held_y == 1, prior / toxic_n, (1 - prior) / clean_n))
    return machine


def _nystroem(marks: list[str], words: list[str], t: np.ndarray, cost: np.ndarray) -> tuple[Features, np.ndarray, float]:
    """The landmarks' subsequences, their weights and a bias: a linear machine in the landmarks' space, folded back."""
    o, hashes, weights = subsequences(marks)
    features = Features(hashes)
    spot = np.zeros(SLOTS, np.int32)
    spot[features.slots] = np.arange(len(features.slots))
    basis = np.zeros((len(marks), len(features.slots)))
    own = features.known(hashes)
    np.add.at(basis, (o[own], spot[hashes[own] & (SLOTS - 1)]), weights[own])

    def kernel(some: list[str]) -> np.ndarray:
        out = []
        for i in range(0, len(some), 250):
            part = some[i : i + 250]
            o, hashes, weights = subsequences(part)
            seen = np.flatnonzero(features.known(hashes))
            dense = np.bincount(o[seen] * basis.shape[1] + spot[hashes[seen] & (SLOTS - 1)], weights[seen], len(part) * basis.shape[1])
            out.append((dense.reshape(len(part), -1) @ basis.T).astype(np.float32))
        return np.concatenate(out)

    values, vectors = np.linalg.eigh(kernel(marks))
    kept = values > 1e-5 * values.max()
    root = vectors[:, kept] / np.sqrt(values[kept])
    w, b = _hinge(kernel(words) @ root.astype(np.float32), t, cost)
    table = np.zeros(SLOTS, np.float32)
    table[features.slots] = (root @ w) @ basis
    return features, table, b


def _likelihood(n: int, c: int, bad: int, good: int) -> float:
    """Twice the log-likelihood ratio of n of bad and c of good documents against one common rate."""
    part = lambda x, of: x * np.log(x / of) if x else 0.0
    rate = lambda x, of: part(x, of) + part(of - x, of)
    return 2 * (rate(n, bad) + rate(c, good) - rate(n + c, bad + good))


def _hinge(x: np.ndarray, t: np.ndarray, cost: np.ndarray, reg: float = 1e-5, rounds: int = 50) -> tuple[np.ndarray, float]:
    """A linear machine for the squared hinge loss by Newton steps over the examples inside the margin."""
    z = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    v = np.zeros(z.shape[1])
    inside = np.ones(len(z), bool)
    for _ in range(rounds):
        a, own = z[inside], cost[inside]
        square, target = reg * np.eye(len(v)), (own * t[inside]) @ a
        for i in range(0, len(a), 1000):
            part = a[i : i + 1000].astype(float)
            square += (part * own[i : i + 1000, None]).T @ part
        v = np.linalg.solve(square, target)
        new = t * (z @ v) < 1
        if (new == inside).all():
            break
        inside = new
    return v[:-1], float(v[-1])


def _rising(x: np.ndarray, t: np.ndarray, cost: np.ndarray) -> np.ndarray:
    """Weights of a linear machine in which no kind of evidence speaks against its label; the first kind alone if none is left."""
    out, kept = np.zeros(x.shape[1]), np.arange(x.shape[1])
    while len(kept):
        w = _hinge(x[:, kept], t, cost)[0]
        if (w >= 0).all() and w.any():
            out[kept] = w
            return out
        kept = kept[w > 0]
    out[0] = 1.0
    return out


def _calibrate(f: np.ndarray, y: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Decisions and the share of toxic documents there: the rising step curve of least squares; a decision between two levels takes the nearer one."""
    blocks: list[list[float]] = []  # weight, toxic weight, lowest and highest decision
    for k in np.argsort(f, kind="stable"):
        blocks.append([share[k], share[k] * y[k], f[k], f[k]])
        while len(blocks) > 1 and (blocks[-2][2] == blocks[-1][3] or blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]):
            w, p, _, top = blocks.pop()
            blocks[-1] = [blocks[-1][0] + w, blocks[-1][1] + p, blocks[-1][2], top]
    least = share.min()
    level = [(p + 0.1 * least) / (w + 0.2 * least) for w, p, _, _ in blocks]
    at = [b[2] if k == 0 else (blocks[k - 1][3] + b[2]) / 2 for k, b in enumerate(blocks)]
    return np.array(at), np.maximum.accumulate(level)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, clean: int = CLEAN) -> Machine:
    """A machine from labels (doc_id, toxic) of documents (doc_id, text) that aren't held out.

    About `sample` toxic and `clean` other documents of up to LONGEST characters are drawn by a hash of their id; that is the classifier's documented bound.
    """
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)").where(~held_out(F.col("doc_id")))
    counts = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    if len(counts) < 2:
        return NOTHING
    drawn = F.pmod(F.xxhash64(F.lit("toxicity"), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    picked = known.where(drawn < F.when(F.col("toxic") == 1, min(1.0, sample / counts[1])).otherwise(min(1.0, clean / counts[0])))
    picked = picked.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))  # about sample + clean rows
    rows = docs.where(F.col("text").isNotNull() & (F.length("text") <= LONGEST)).select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("doc_id", "text", "toxic").collect()
    rows.sort()  # by id: files' order tells nothing
    return train([r["text"] for r in rows], [r["toxic"] for r in rows], counts[1] / (counts[0] + counts[1]))


def score(df: DataFrame, machine: Machine, text: str = "text") -> DataFrame:
    """df with `score` (0 to 1) of each whole text and `predicted` (1 from LIMIT on); such columns are replaced.

    A null or empty text has the score of a text without any telling word.
    """
    bounded_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(machine)

    @F.arrow_udf("double")
    def worst(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own, memo = shared.value, {}
        for part in parts:
            cut = [words_of(x) if x else [] for x in part.to_pylist()]
            if len(memo) > MEMO:
                memo.clear()
            new = set()
            for ws in cut:
                new.update(ws)
            fresh = [w for w in new if w not in memo]
            for i in range(0, len(fresh), 20_000):
                some = fresh[i : i + 20_000]
                memo.update(zip(some, own.decide(some).tolist(), strict=True))
            get = memo.__getitem__
            yield pa.array(own.score([np.fromiter(map(get, ws), float, len(ws)) for ws in cut]), pa.float64())
            for w in fresh:
                if len(w) > MEMO_WORD:
                    del memo[w]
        memo = cut = fresh = new = part = get = None  # noqa: F841
        give_back()

    return df.withColumn("score", worst(F.col(text))).withColumn("predicted", (F.col("score") >= LIMIT).cast("int"))


def op3(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    machine = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, machine).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
