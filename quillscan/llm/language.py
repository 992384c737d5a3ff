"""Language identification by interpolated Kneser-Ney character models, one for each language.

A model predicts each letter of a word, and the word's end, from up to ORDER - 1 letters before it. All models
share sorted arrays of 64-bit n-gram hashes with a column of probabilities or back-off weights a language. The
language of lowest cross-entropy a letter wins. Its lead over the others and its entropy, held against the usual one of
that language, give the score; what is usual, the weight of letters and the score below which a document is rejected
are fitted on documents set aside, against what they score without their own language and as noise. The limit of
rejection is a quantile of the set-aside scores, and the models tell what it refuses of either side. Words are scored
once a partition's memo.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillscan.llm.common import bounded_batches, give_back, held_out, unused

#: Letters of a longest n-gram; bound of the classifier's sample: documents a language, and characters of the longest one learned from.
ORDER, SAMPLE, LONGEST = 4, 400, 50_000
#: One document in so many of the sample, by order of ids, is set aside for the calibration, if a language has twice as many; fewer serve both.
ASIDE = 4
#: Share of documents of known languages that a limit of rejection may refuse, and how far below that share's score the limit lies: documents that mix languages score low and should stay.
REFUSED, BELOW = 0.005, 10
#: Words that a partition's memo keeps, and their longest; letters of a run beyond which it counts as several words; letters that are scored at once.
MEMO, MEMO_WORD, RUN, LETTERS = 100_000, 256, 4096, 100_000
#: Symbols that an unseen letter shares its probability with.
SYMBOLS = 65536
_LETTERS = re.compile(r"[^\W\d_]+")
_FACTOR, _SEED = np.uint64(0x9E3779B97F4A7C15), 1469598103934665603
PREDICTION = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])


class Grams:
    """N-gram hashes of words: for each order, at each letter's place, the hash of the n-gram that ends there."""

    def __init__(self, words: list[str]):
        size = np.fromiter(map(len, words), np.int64, len(words)) + 2
        letters = np.frombuffer(("\x02" + "\x03\x02".join(words) + "\x03").encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) if words else np.empty(0, np.uint64)
        self.word = np.repeat(np.arange(len(words)), size)
        first = np.cumsum(size) - size
        self.place = np.arange(len(letters)) - first[self.word]
        self.hash = []
        for k in range(1, ORDER + 1):
            h = np.full(len(letters), _SEED + k, np.uint64)
            for j in range(k - 1, -1, -1):
                h[j:] = (h[j:] ^ letters[: len(letters) - j]) * _FACTOR
                h ^= h >> np.uint64(29)
            self.hash.append(h)

    def at(self, k: int) -> np.ndarray:
        """Where an n-gram of order k ends that predicts a letter or a word's end."""
        return np.flatnonzero(self.place >= max(k - 1, 1))


def estimate(words: list[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each order: n-grams and their discounted probabilities, contexts and their back-off weights."""
    g, out = Grams(words), []
    for k in range(1, ORDER + 1):
        at = g.at(k)
        if k == ORDER:
            ends, counts = _counted(g.hash[k - 1][at], at)
        else:  # distinct letters before it; counts where nothing comes before
            _, longer = np.unique(g.hash[k][g.at(k + 1)], return_index=True)
            starts = at[g.place[at] == k - 1]
            ends, counts = _counted(np.append(g.hash[k - 1][g.at(k + 1)[longer]], g.hash[k - 1][starts]), np.append(g.at(k + 1)[longer], starts))
        ones, twos = (counts == 1).sum(), (counts == 2).sum()
        discount = ones / (ones + 2 * twos) if ones else 0.5
        discount = min(max(discount, 0.1), 0.9)
        context = g.hash[k - 2][ends - 1] if k > 1 else np.zeros(len(ends), np.uint64)
        keys, of = np.unique(context, return_inverse=True)
        total, kinds = np.bincount(of, counts), np.bincount(of)
        gram = g.hash[k - 1][ends]
        order = np.argsort(gram)
        out.append((gram[order], (np.maximum(counts - discount, 0) / total[of])[order], keys, discount * kinds / total))
    return out


def _counted(keys: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    _, first, counts = np.unique(keys, return_index=True, return_counts=True)
    return at[first], counts.astype(float)


class Models:
    """The models of all languages in shared sorted arrays, and their calibration."""

    def __init__(self, texts: dict[str, list[str]]):
        self.langs = sorted(texts)
        some = {k: [t for t in texts[k] if _LETTERS.search(t)] for k in self.langs}
        aside = {k: v[::ASIDE] if len(v) >= 2 * ASIDE else v for k, v in some.items()}
        learned = {k: [t for i, t in enumerate(v) if i % ASIDE] if len(v) >= 2 * ASIDE else v for k, v in some.items()}
        per = [estimate([w for t in learned[k] for w in _runs(t)] or ["a"]) for k in self.langs]
        self.grams, self.contexts = [], []
        for k in range(ORDER if per else 0):
            for to, key, value, least in ((self.grams, 0, 1, 0.0), (self.contexts, 2, 3, 1.0)):
                keys = np.unique(np.concatenate([p[k][key] for p in per]))
                table = np.full((len(keys) + 1, len(per)), least, np.float32)  # the last row is for what no language has
                for i, p in enumerate(per):
                    table[np.searchsorted(keys, p[k][key]), i] = p[k][value]
                to.append((keys, table))
        # entropy that is usual in a language: middle, spread of long documents, and what few letters add to its square
        self.mean, self.spread, self.noise = np.zeros(len(per)), np.ones(len(per)), np.ones(len(per))
        self.weight, self.curve, self.reject = 50.0, (0.0, 0.0), 0.0
        #: Shares of set-aside documents under the limit: of known languages, of the same ones where their language isn't known, of their letters in another order.
        self.rates: dict[str, float] = {}
        if per:
            self._calibrate([aside[k] for k in self.langs])

    def _calibrate(self, aside: list[list[str]]) -> None:
        own = np.concatenate([np.full(len(t), i) for i, t in enumerate(aside)]).astype(int)
        if not len(own):
            return
        sums = self.words([t for ts in aside for t in ts]).astype(float)
        letters, h = sums[:, -1], -sums[:, :-1] / sums[:, -1:]
        for i in range(len(self.langs)):
            if (own == i).any():
                e, n = h[own == i, i], letters[own == i]
                self.mean[i] = np.median(e)
                off, long = np.abs(e - self.mean[i]) * 1.4826, n >= np.median(n)
                self.spread[i] = max(np.median(off[long]), 0.02)
                short = ~long if (~long).any() else long
                self.noise[i] = max(np.median(off[short]) ** 2 - self.spread[i] ** 2, 0.0) * np.median(n[short]) + 1.0
        # letters of one text depend on each other: the lead counts for as many as foretell the right language best
        self.weight = float(min((5.0, 10.0, 20.0, 50.0, 100.0), key=lambda w: self._loss(h, letters, own, w)))
        # strangers: the same documents where their own language isn't known, and the same letters in another order
        best = np.where(np.arange(len(self.langs)) == own[:, None], np.inf, h).argmin(1)
        rng = np.random.default_rng(1)
        mixed = self.words([_mixed(t, rng) for ts in aside for t in ts]).astype(float)
        wild = -mixed[:, :-1] / np.maximum(mixed[:, -1:], 1)
        z = [self._over(h[np.arange(len(own)), own], own, letters), self._over(wild.min(1), wild.argmin(1), mixed[:, -1])]
        if len(self.langs) > 1:
            z.append(self._over(h[np.arange(len(own)), best], best, letters))
        self.curve = _logistic(z[0], np.concatenate(z[1:]))
        known = np.sort([x for (name, x), k in zip(self.predict(sums), own.tolist(), strict=True) if name == self.langs[k]])
        if not len(known):
            return
        self.reject = float(known[int(REFUSED * len(known))]) / BELOW
        left = sums.copy()
        left[np.arange(len(own)), own] = -np.inf  # their own language isn't known
        others = {"known": known, "unknown": np.array([x for _, x in self.predict(left)]) if len(self.langs) > 1 else np.empty(0), "noise": np.array([x for _, x in self.predict(mixed)])}
        self.rates = {k: float((v < self.reject).mean()) if len(v) else 0.0 for k, v in others.items()}

    def _over(self, h: np.ndarray, lang: np.ndarray, letters: np.ndarray) -> np.ndarray:
        """How far entropies lie above a language's usual one, in spreads of texts of so many letters."""
        return np.clip((h - self.mean[lang]) / np.sqrt(self.spread[lang] ** 2 + self.noise[lang] / np.maximum(letters, 1)), -200, 200)

    def _loss(self, h: np.ndarray, letters: np.ndarray, own: np.ndarray, weight: float) -> float:
        lead = -(h - h.min(1, keepdims=True)) * np.minimum(letters, weight)[:, None]
        return float((np.log(np.exp(lead).sum(1)) - lead[np.arange(len(own)), own]).mean())

    @staticmethod
    def _find(keys: np.ndarray, table: np.ndarray, want: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
        return table[np.where(keys[at] == want, at, len(keys))]

    def words(self, words: list[str]) -> np.ndarray:
        """For each word (or text), its log probability in each language and, last, how many letters and ends that is for."""
        out = np.zeros((len(words), len(self.langs) + 1))
        runs, owner, n = [], [], 0
        for i, w in enumerate(words):
            for r in _runs(w):
                runs.append(r)
                owner.append(i)
                n += len(r)
                if n >= LETTERS:
                    self._add(out, runs, owner)
                    runs, owner, n = [], [], 0
        if runs:
            self._add(out, runs, owner)
        return out.astype(np.float32)

    def _add(self, out: np.ndarray, runs: list[str], owner: list[int]) -> None:
        g = Grams(runs)
        at = g.at(1)
        _, table = self.contexts[0]
        p = table[0] / SYMBOLS + self._find(*self.grams[0], g.hash[0][at])
        for k in range(2, ORDER + 1):
            deep = np.flatnonzero(g.place[at] >= k - 1)
            ends = at[deep]
            p[deep] = self._find(*self.grams[k - 1], g.hash[k - 1][ends]) + self._find(*self.contexts[k - 1], g.hash[k - 2][ends - 1]) * p[deep]
        low = owner[0]  # owners rise
        word = np.array(owner)[g.word[at]] - low
        for i in range(len(self.langs)):
            got = np.bincount(word, np.log(p[:, i]))
            out[low : low + len(got), i] += got
        count = np.bincount(word)
        out[low : low + len(count), -1] += count

    def entropy(self, text: str) -> np.ndarray | None:
        total = self.words([text]).astype(float)[0]
        return -total[:-1] / total[-1] if total[-1] else None

    def predict(self, sums: np.ndarray) -> list[tuple[str, float]]:
        """Language and score of each row of summed log probabilities."""
        out = [("und", 0.0)] * len(sums)
        some = np.flatnonzero(sums[:, -1]) if self.langs else []
        if len(some):
            letters = sums[some, -1]
            h = -sums[some, :-1] / letters[:, None]
            best = h.argmin(1)  # ties: the first name
            lead = 1 / np.exp(-(h - h.min(1, keepdims=True)) * np.minimum(letters, self.weight)[:, None]).sum(1)
            a, b = self.curve
            score = lead / (1 + np.exp(np.clip(a + b * self._over(h[np.arange(len(h)), best], best, letters), -50, 50)))
            for k, i, x in zip(some.tolist(), best.tolist(), score.tolist(), strict=True):
                out[k] = self.langs[i], x
        return out


def _runs(text: str) -> list[str]:
    """The runs of letters of a text, in lower case; longer ones are cut."""
    text = text.lower()
    bare = text.strip(".,;:!?")
    if bare.isalpha() and len(bare) <= RUN:  # one word: as below, but sooner
        return [bare]
    runs = _LETTERS.findall(text)
    return [p for r in runs for p in ([r] if len(r) <= RUN else [r[i : i + RUN] for i in range(0, len(r), RUN)])]


def _mixed(text: str, rng: np.random.Generator) -> str:
    """The text's letters in another order, in words of the same lengths."""
    runs = _runs(text)
    letters = np.array(list("".join(runs)))
    rng.shuffle(letters)
    ends = np.cumsum([len(r) for r in runs])
    return " ".join("".join(letters[e - len(r) : e]) for e, r in zip(ends.tolist(), runs, strict=True))


def _logistic(own: np.ndarray, strange: np.ndarray, reg: float = 1e-2) -> tuple[float, float]:
    """a and b of 1 / (1 + exp(a + b z)), the chance that a distance z is one's own language's: both sides weigh the same; Newton steps."""
    z = np.concatenate([own, strange])
    t = np.concatenate([np.zeros(len(own)), np.ones(len(strange))])
    weight = np.concatenate([np.full(len(own), 0.5 / len(own)), np.full(len(strange), 0.5 / len(strange))])
    x, v = np.stack([np.ones_like(z), z], 1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ v, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + reg * np.eye(2), x.T @ (weight * (t - p)) - reg * v)
        v = v + step
        if np.abs(step).max() < 1e-9:
            break
    return float(v[0]), max(float(v[1]), 0.0)


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", sample: int = SAMPLE) -> Models:
    """Models of the languages of docs, from about `sample` documents each, drawn by a hash of the id.

    Rows with a null text, lang or held-out id aren't learned from, nor are texts of more than LONGEST characters. The
    sample is the classifier's documented bound.
    """
    known = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & (F.length(text) <= LONGEST) & F.col(doc_id).isNotNull() & ~held_out(F.col(doc_id)))
    share = {r[0]: min(1.0, sample / r[1]) for r in known.groupBy(lang).count().collect()}  # one row a language
    if not share:
        return Models({})
    drawn = F.pmod(F.xxhash64(F.lit("language"), F.col(doc_id)), F.lit(1 << 30)) / float(1 << 30)
    limit = F.create_map(*[F.lit(x) for kv in share.items() for x in kv])
    texts: dict[str, list[tuple]] = {k: [] for k in share}
    for x, i, t in known.where(drawn < F.element_at(limit, F.col(lang))).select(lang, doc_id, text).toLocalIterator():
        texts[x].append((i, t))
    return Models({k: [t for _, t in sorted(v)] for k, v in texts.items()})  # by id: files' order tells nothing


def identify(df: DataFrame, models: Models, text: str = "text") -> DataFrame:
    """df with lang_pred and score (0 to 1) of each whole text; columns of these names are replaced.

    `und` with score 0 for a null text, one without letters, or where nothing could be learned.
    """
    bounded_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(models)

    @F.arrow_udf(PREDICTION)
    def predict(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own, memo = shared.value, {}
        table = np.zeros((0, len(own.langs) + 1), np.float32)
        for part in parts:
            cut = [x.split() if x else [] for x in part.to_pylist()]
            new = set()
            for ws in cut:
                new.update(ws)
            if len(memo) > MEMO:
                memo, table = {}, table[:0]
            fresh = [w for w in new if w not in memo]
            if fresh and own.langs:
                memo.update(zip(fresh, range(len(table), len(table) + len(fresh)), strict=True))
                table = np.concatenate([table, own.words(fresh)])
            get = memo.__getitem__
            sums = np.zeros((len(cut), len(own.langs) + 1))
            if own.langs:
                for i, ws in enumerate(cut):
                    if ws:
                        sums[i] = table[np.fromiter(map(get, ws), np.int64, len(ws))].sum(0, dtype=np.float64)
            lang, score = zip(*own.predict(sums), strict=True) if cut else ((), ())
            for w in fresh:
                if len(w) > MEMO_WORD:
                    memo.pop(w, None)
            yield pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=PREDICTION.names)
        memo = table = cut = fresh = new = part = get = None  # noqa: F841
        give_back()

    new = unused(df, "_language")
    got = df.drop("lang_pred", "score").withColumn(new, predict(F.col(text)))
    return got.select(*[c for c in got.columns if c != new], f"{new}.lang_pred", f"{new}.score")


def op4(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    found = identify(docs.select("doc_id", "text"), fit(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
