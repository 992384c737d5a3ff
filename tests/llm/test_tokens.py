"""Tokens: counts, encoding and packing against the library."""

import hashlib
import random
import zlib

import numpy as np
import pytest

pytest.importorskip("tokenizers")
pytest.importorskip("public_tokenizers")

from quillscan.llm import bpe, packing, token_counts  # noqa: E402

TEXTS = [None, "", " ", "a", "Hello world's  end\n\n\tx ", "naïve café 中文 🙂", "<|endoftext|> x<|endoftext|>", "ab" * 3000, " " * 500, "a\x1cb c\x85d e", "same", "same", "x " * 4000, "՘ԯ ᲊ"]


def _docs(spark, texts=TEXTS):
    return spark.createDataFrame([(i, t, "keep") for i, t in enumerate(texts)], "doc_id long, text string, ids string")


@pytest.fixture(scope="module")
def library():
    return token_counts.library(token_counts.default_path())


def _ids(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_counts_equal_the_library(spark, library):
    rows = token_counts.count_tokens(_docs(spark)).collect()
    assert {r["doc_id"]: r["n_tokens"] for r in rows} == {i: len(_ids(library, t)) for i, t in enumerate(TEXTS)}
    assert rows[0].asDict().keys() == {"doc_id", "text", "ids", "n_tokens"}


def test_counts_of_piece_models(spark):
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    rows = token_counts.count_tokens(_docs(spark, ["a b", None, "x  y"]), path=path).collect()
    assert {r["doc_id"]: r["n_tokens"] for r in rows} == {i: len(sp.encode(t)) for i, t in enumerate(["a b", "", "x  y"])}


def test_encoding_equals_the_library(library):
    codec = bpe.codec(token_counts.default_path())
    r = random.Random(5)
    parts = ["a", "th", "er", " ", "  ", "\n", "'s", "1", "é", "中", "🙂", "----", "<|endoftext|>", "ing", "\x00", "İ", "՘"]
    texts = [t or "" for t in TEXTS] + ["".join(r.choices(parts, k=r.randrange(40))) for _ in range(800)]
    for text, got in zip(texts, codec.encode_batch(texts), strict=True):
        ids = np.frombuffer(got, "<u4").tolist()
        assert ids == _ids(library, text), text
        assert codec.decode(got) == library.decode(ids, skip_special_tokens=False)


def test_pairs_are_compatible_where_the_exact_merge_keeps_them():
    codec = bpe.codec(token_counts.default_path())
    rng = np.random.default_rng(1)
    short = np.array([i for i in range(50256) if len(codec.bytes[i]) <= 4])
    a, b = rng.choice(short, 5000), rng.choice(short, 5000)
    want = [codec.exact(codec.bytes[x] + codec.bytes[y]) == [x, y] for x, y in zip(a.tolist(), b.tolist(), strict=True)]
    assert codec.compatible(a, b).tolist() == want


def test_round_trip_through_spark(spark):
    rows = bpe.decode(bpe.encode(_docs(spark))).collect()
    assert {r["doc_id"]: r["decoded"] for r in rows} == {i: t or "" for i, t in enumerate(TEXTS)}


def _check_packing(rows, texts, library, size=2048):
    per, seqs = {}, {}
    for r in rows:
        per.setdefault(r["doc_id"], []).append(r)
        seqs.setdefault(r["sequence_id"], []).append(r)
    assert per.keys() == set(range(len(texts)))
    for i, t in enumerate(texts):
        ids, at = np.array([*_ids(library, t), 1], "<u4"), 0
        for r in sorted(per[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    for s in seqs.values():
        at = 0
        for r in sorted(s, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= size
    return 1 - sum(r["length"] for r in rows) / (size * len(seqs))


def test_packing_is_whole_and_gapless(spark, library):
    r = random.Random(2)
    texts = TEXTS + [" ".join(r.choices(["word", "another", "tion"], k=r.randrange(1, 1500))) for _ in range(150)] + ["copy " * 300] * 60
    rows = packing.pack(_docs(spark, texts)).collect()
    assert _check_packing(rows, texts, library) < 0.03


def test_packing_of_nothing(spark):
    assert packing.pack(_docs(spark, [])).collect() == []


def _first_fit(demand, capacity):
    """Bins of a best fit of decreasing sizes, by counts of bins with each room left."""
    room = [0] * (capacity + 1)
    for c in sorted(demand, reverse=True):
        for _ in range(demand[c]):
            at = next((r for r in range(c, capacity) if room[r]), None)
            if at is not None:
                room[at] -= 1
            room[(capacity if at is None else at) - c] += 1
    return sum(room)


_RANDOM = random.Random(4)
DEMANDS = {
    "even": {c: _RANDOM.randrange(0, 400) for c in range(1, 257)},
    "thirds": {c: _RANDOM.randrange(200, 400) for c in range(70, 100)},
    "few": {c: 1 for c in (256, 200, 199, 57, 3)},
    "one": {129: 1000},
    "huge": {c: 10**9 + c for c in (255, 128, 127, 85, 1)},
}


@pytest.mark.parametrize("name", DEMANDS)
def test_plan_uses_up_the_demand(name):
    demand = DEMANDS[name]
    plans, used = packing.plan(demand, 256), {}
    for pattern, n in plans:
        assert sum(c * a for c, a in pattern.items()) <= 256
        for c, a in pattern.items():
            used[c] = used.get(c, 0) + a * n
    assert used == {c: n for c, n in demand.items() if n}
    if name != "huge":
        assert sum(n for _, n in plans) <= _first_fit(demand, 256)


def test_column_generation_beats_first_fit_and_proves_its_bound():
    demand = DEMANDS["thirds"]
    sizes, need = np.array(sorted(demand)), np.array([demand[c] for c in sorted(demand)], float)
    _, used, bound = packing.relax(need, sizes, 256)
    plans = sum(n for _, n in packing.plan(demand, 256))
    assert used.sum() - bound <= 0.5 + 1e-6 and bound <= plans <= used.sum() + len(sizes)
    assert plans < 0.97 * _first_fit(demand, 256)


LONG = {"blanks": " " * 2_000_000, "tabs": "\t" * 2_000_000, "line feeds": "\n" * 2_000_000, "one letter": "a" * 2_000_000, "inside": "x " + " " * 1_500_000 + "y", "mixed": " \n" * 800_000}


@pytest.mark.parametrize("name", LONG)
def test_very_long_runs(name, library):
    """Texts that the fast engine gives up go to the library; all three operators agree with it."""
    text, path = LONG[name], token_counts.default_path()
    want = _ids(library, text)
    assert packing.token_ids(text, path).tolist() == want
    assert np.frombuffer(bpe.codec(path).encode_batch([text])[0], "<u4").tolist() == want
    assert token_counts.Counter(path)([text]) == [len(want)]


def test_packing_of_very_long_runs_and_odd_rows(spark, library):
    rows = [(None, LONG["blanks"]), (None, LONG["tabs"]), (7, "copy"), (7, "copy"), (7, None)]
    got = packing.pack(spark.createDataFrame([(i, t, 1, "x", 2) for i, t in rows], "doc_id long, text string, start int, class string, salt int")).collect()
    assert sorted((r["doc_id"] or 0, r["doc_tokens"]) for r in got if not r["start"]) == sorted((i or 0, len(_ids(library, t)) + 1) for i, t in rows)
    places = sorted((r["sequence_id"], r["offset"], r["length"]) for r in got)
    assert all(a[0] != b[0] or a[1] + a[2] == b[1] for a, b in zip(places, places[1:], strict=False))


@pytest.mark.parametrize("op", [lambda df: token_counts.count_tokens(df), lambda df: bpe.decode(bpe.encode(df))], ids=["counts", "bpe"])
def test_empty_tables_and_repeated_ids(spark, op):
    assert op(_docs(spark, [])).collect() == []
    twice = spark.createDataFrame([(1, "a b", 0, 0, "x"), (1, "c", 0, 0, "y"), (None, None, 0, 0, None)], "doc_id long, text string, n_tokens int, decoded int, other string")
    rows = op(twice).collect()
    assert sorted((r["text"] or "") for r in rows) == ["", "a b", "c"] and sorted(str(r["other"]) for r in rows) == ["None", "x", "y"]


def test_digests_of_the_query(spark, tmp_path, library):
    _docs(spark).drop("ids").write.parquet(str(tmp_path / "documents.parquet"))
    for r in bpe.op2(spark, str(tmp_path)).collect():
        ids = _ids(library, TEXTS[r["doc_id"]])
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((TEXTS[r["doc_id"]] or "").encode()).hexdigest()
