"""Near-duplicates, fingerprints and neighbours against brute force."""

import base64
import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quillscan.llm import fingerprints, near_dedup, neighbours


def _words(r, n):
    return " ".join("w%d" % r.randrange(400) for _ in range(n))


def _edited(r, text, n):
    w = text.split()
    for _ in range(n):
        w[r.randrange(len(w))] = "e%d" % r.randrange(10**6)
    return " ".join(w)


def _set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def _components(texts):
    sets, root = {i: _set(t) for i, t in texts}, {i: i for i, _ in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            n = len(sets[a] & sets[b])
            if a < b and sets[a] and sets[b] and 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_components_equal_brute_force(spark):
    r = random.Random(8)
    base, passage = _words(r, 120), _words(r, 60)
    texts = [None, "", " \t\n", "one", "ONE", "two words", "a b c d e", "A b C d e", "a b c d e"]
    texts += [_edited(r, base, r.randrange(12)) for _ in range(60)]  # a group of near copies around 0.75
    texts += [passage + " " + _words(r, r.randrange(10, 60)) for _ in range(30)]  # a passage that many share
    texts += [base] * 20 + [_words(r, 50) for _ in range(20)]
    docs = list(enumerate(texts))
    r.shuffle(docs)
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in docs], "doc_id long, text string, kept int, component_id int")
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in near_dedup.find(df).collect()}
    assert got == _components(docs)


def test_chain_of_near_copies_is_one_component(spark):
    r = random.Random(3)
    w = [f"c{k}" for k in range(200)]
    texts = []
    for k in range(12):
        texts.append((k, " ".join(w)))
        w[(k * 15) % 190 : (k * 15) % 190 + 10] = [f"n{k}_{j}" for j in range(10)]
    r.shuffle(texts)
    got = {x["doc_id"]: x["component_id"] for x in near_dedup.find(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert got == {i: c for i, (_, c) in _components(texts).items()}


def test_near_duplicates_of_odd_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert near_dedup.find(empty).collect() == []
    rows = near_dedup.find(spark.createDataFrame([(None, "a b c d e"), (1, "a b c d e"), (1, "a b c d e"), (2, "A B C D E")], "doc_id long, text string")).collect()
    assert sorted((x["doc_id"] or -1, x["component_id"] or -1, x["kept"]) for x in rows) == [(-1, -1, True), (1, 1, True), (1, 1, True), (2, 1, False)]


def test_signature_collisions_follow_similarity():
    r = random.Random(1)
    base = _words(r, 300)
    for n in (0, 3, 8):
        a, b = near_dedup.shingles(base), near_dedup.shingles(_edited(r, base, n))
        same = len(np.intersect1d(a, b))
        hits = (near_dedup.signature(a) == near_dedup.signature(b)).mean()
        assert abs(hits - same / (len(a) + len(b) - same)) < 0.25




def test_fingerprints_and_edits(spark, tmp_path):
    r = random.Random(6)
    shared = _words(r, 80)
    texts = [None, "", "  ", "x", "short text", "🙂" * 40, _words(r, 200), _words(r, 30) + " " + shared, shared + " " + _words(r, 30), "z" * 5000]
    texts += [texts[6], _words(r, 23), _words(r, 24), _words(r, 3000)]
    ids = [3 * i - 4 for i in range(len(texts))]
    spark.createDataFrame([(i, t, t) for i, t in zip(ids, texts, strict=True)], "doc_id long, text string, edited string").write.parquet(str(tmp_path / "documents.parquet"))
    rows = {x["doc_id"]: x for x in fingerprints.op5(spark, str(tmp_path)).collect()}
    assert rows.keys() == set(ids)
    order = sorted(zip(ids, texts, strict=True), reverse=True)
    for k, (i, t) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        half = len(t) // 2
        assert rows[i]["n_chars"] == len(t)
        assert rows[i]["edited_sha256"] == hashlib.sha256((t[: len(t) - half] + after[:half]).encode()).hexdigest()
        assert 0 <= rows[i]["near_edited"] <= 1 and 0 <= rows[i]["near_next"] <= 1
    assert rows[ids[6]]["fingerprint"] == rows[ids[10]]["fingerprint"] != ""
    assert 0.1 < rows[ids[13]]["near_edited"] < 0.6


def _op5(spark, tmp_path, rows):
    spark.createDataFrame(rows, "doc_id long, text string, fingerprint string, _bucket int").write.parquet(str(tmp_path / "documents.parquet"))
    return fingerprints.op5(spark, str(tmp_path))


IDS = {
    "one far id": [*range(60), 2**50],
    "both ends": [-(2**62), -1, 0, 5, 2**62, 2**63 - 1, -(2**63)],
    "without ids": [None] * 40 + [1, 2],
    "one id": [7] * 50 + [8],
    "one row": [3],
    "none": [],
}


@pytest.mark.parametrize("name", IDS)
def test_the_next_document_of_odd_ids(spark, tmp_path, name):
    r = random.Random(4)
    rows = [(i, f"text {k} " + _words(r, 12), "f", 9) for k, i in enumerate(IDS[name])]
    digests = dict(spark.createDataFrame([(x[1],) for x in rows] or [("",)], "t string").selectExpr("t", "xxhash64(t)").collect())
    order = sorted(rows, key=lambda x: (x[0] is None, -(x[0] or 0), digests[x[1]]))
    want = []
    for k, (i, t, *_) in enumerate(order):
        half, after = len(t) // 2, order[(k + 1) % len(order)][1]
        want.append((str(i), len(t), hashlib.sha256((t[: len(t) - half] + after[:half]).encode()).hexdigest()))
    got = [(str(x["doc_id"]), x["n_chars"], x["edited_sha256"]) for x in _op5(spark, tmp_path, rows).collect()]
    assert sorted(got) == sorted(want)


def test_buckets_hold_equal_numbers_of_rows(spark):
    ids = [None] * 500 + [7] * 500 + [*range(1000), *(2**50 + k for k in range(10))]
    df = spark.createDataFrame([(i, k) for k, i in enumerate(ids)], "doc_id long, k long")
    rows = fingerprints.in_order(df, "doc_id", F.xxhash64("k")).where("not _ghost").groupBy("_bucket").count().collect()
    assert len(rows) >= 12 and max(r["count"] for r in rows) <= 3 * len(ids) / len(rows)


def _hash(*values):
    """The hash of a text, or of numbers in turn, by its published definition."""
    seed = 42
    for v in values:
        seed = xxhash.xxh64_intdigest(v.encode() if isinstance(v, str) else v.to_bytes(8, "little", signed=True), seed)
    return seed - ((seed >> 63) << 64)


def _selected(inner, k, s):
    """Runs of k units whose least inner run of s units stands first or last."""
    n = k - s + 1
    return [i for i in range(len(inner) - n + 1) if min(inner[i : i + n]) in (inner[i], inner[i + n - 1])]


def _units(text):
    return re.findall(rf"[\u4e00-\u9fff]|[^\x20\x09-\x0D\u4e00-\u9fff]{{1,{fingerprints.PIECE}}}", text)


def _anchors(text, selected=_selected):
    """Positions and hashes of the closed syncmers of a text, by plain Python."""
    k, s = fingerprints.K, fingerprints.S
    if not (units := _units(text)):
        return []
    h = [0] * (k - 1) + [_hash(u) for u in units]
    inner = [2**63 - 1 if i < k - s else _hash(h[i], h[i + 1]) for i in range(len(h) - 1)]
    return [(i - (k - 1), _hash(inner[i], inner[i + 2], h[i + 4])) for i in selected(inner, k, s)]


def _written(anchors):
    return base64.b64encode(b"".join(((x >> 32) & 0xFFFFFFFF).to_bytes(4, "big") for _, x in anchors)).decode()


def test_fingerprints_and_likeness_equal_brute_force(spark, tmp_path):
    r = random.Random(12)
    shared = _words(r, 30)
    texts = ["", "x", "two words", _words(r, 9), shared + " " + _words(r, 9), _words(r, 5) + " " + shared, shared, shared, "中文字 some words 漢字漢字", "z" * 90, " \n"]
    rows = {x["doc_id"]: x for x in _op5(spark, tmp_path, [(i, t, None, None) for i, t in enumerate(texts)]).collect()}
    own = [_anchors(t) for t in texts]

    def like(a, b):
        a, b = ({x >> 32 for _, x in y} for y in (a, b))
        return 1.0 if not a and not b else len(a & b) / len(a | b)

    for i, t in enumerate(texts):
        k = (i - 1) % len(texts)  # descending ids
        half = len(t) // 2
        edited = _anchors(t[: len(t) - half] + texts[k][:half])
        assert rows[i]["fingerprint"] == _written(own[i]), t
        assert rows[i]["edited_fingerprint"] == _written(edited)
        assert abs(rows[i]["near_edited"] - like(own[i], edited)) < 1e-12 and abs(rows[i]["near_next"] - like(own[i], own[k])) < 1e-12


def test_halves_of_short_texts_keep_anchors(spark, tmp_path):
    """An edited text has the first half of its own, whatever follows and however many words each has."""
    r = random.Random(11)
    word = lambda n: "".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=n))
    texts = [" ".join(word(6) for _ in range(n)) for n in (*range(8, 50), 300)]
    texts = [t for x in texts for t in (x, word(2000))]  # wide words follow: the edited text has fewer words
    texts += ["".join(chr(0x4E00 + r.randrange(5000)) for _ in range(30)), word(40)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    for x in fingerprints.op5(spark, str(tmp_path)).collect():
        assert x["near_edited"] > x["near_next"], x


def test_anchors_do_not_depend_on_context(spark):
    r = random.Random(7)
    shared = _words(r, 120)
    df = spark.createDataFrame([(0, _words(r, 40) + " " + shared), (1, shared + " " + _words(r, 55)), (2, _words(r, 150))], "doc_id long, text string")
    got = {x["doc_id"]: {a["hash"] for a in x["a"]} for x in fingerprints.anchors(df, "text", "a").collect()}
    inside = {x for _, x in _anchors(shared)}
    assert len(got[0] & got[1]) >= len(inside) - 6 and not got[0] & got[2]  # but for runs over its start
    places = fingerprints.anchors(df, "text", "a").first()["a"]
    assert [a["position"] for a in places] == sorted({a["position"] for a in places})


def test_anchors_are_a_choice_of_runs(spark):
    """Closed syncmers and nothing else: of another rule's choice, or of every run, this test fails."""
    text = _words(random.Random(9), 600)
    got = [(a["position"], a["hash"]) for a in fingerprints.anchors(spark.createDataFrame([(0, text)], "doc_id long, text string"), "text", "a").first()["a"]]
    assert got == _anchors(text)
    every = lambda inner, k, s: [i for i in range(len(inner) - k + s)]
    openly = lambda inner, k, s: [i for i in every(inner, k, s) if min(inner[i : i + k - s + 1]) == inner[i]]
    modulo = lambda inner, k, s: [i for i in every(inner, k, s) if inner[i] % 2 == 0]
    assert all(got != _anchors(text, other) for other in (every, openly, modulo))
    runs, inner = len(_units(text)), fingerprints.K - fingerprints.S + 1
    assert inner >= 4 and 0.9 * 2 / inner < len(got) / runs < 1.15 * 2 / inner  # their density
    positions = [p for p, _ in got]
    assert max(b - a for a, b in zip(positions, positions[1:])) <= inner - 1  # noqa: B905  (their window guarantee)
    assert len(_written(got)) < len(text)


def test_every_text_with_a_unit_has_an_anchor(spark):
    texts = [None, "", "\t ", "a", "ab cd", "字", "a b c", "x" * 17]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x["doc_id"]: [a["hash"] for a in x["a"]] for x in fingerprints.anchors(df, "text", "a").collect()}
    for i, t in enumerate(texts):
        assert got[i] == [x for _, x in _anchors(t or "")] and bool(got[i]) == bool((t or "").strip()), t


def _nearest(rows, every, k):
    good = {i: np.array(v, float) for i, v in rows if v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    out = {}
    for q, a in good.items():
        if q % every == 0:
            s = sorted((-round(float(a @ b / np.sqrt(a @ a) / np.sqrt(b @ b)), 12), i) for i, b in good.items() if i != q)
            out[q] = [i for _, i in s[:k]]
    return out


def test_neighbours_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    v = rng.standard_normal((400, 16)).astype(np.float32)
    v[50:120] = v[50]  # one common vector: ties go to smaller ids
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    rows[7], rows[8], rows[9], rows[10] = (7, None), (8, [0.0] * 16), (9, [float("nan")] * 16), (10, [None] * 16)
    df = spark.createDataFrame([(i, x, 1) for i, x in rows], "vec_id long, embedding array<float>, rank int").repartition(5)
    got = {}
    for r in sorted(neighbours.search(df, "vec_id", "embedding", 50, 5).collect(), key=lambda r: r["rank"]):
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    want = _nearest(rows, 50, 5)
    hits = sum(len(set(got[q]) & set(want[q])) for q in want)
    assert got.keys() == want.keys() and hits >= 0.98 * sum(map(len, want.values()))
    assert got[50] == [51, 52, 53, 54, 55]


def test_neighbours_of_few_and_none(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (50, None)], "vec_id long, embedding array<float>")
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in neighbours.search(few, "vec_id", "embedding", 50, 5).collect()] == [(0, 1, 1)]
    assert neighbours.search(few.where("vec_id > 60"), "vec_id", "embedding", 50, 5).collect() == []


@pytest.mark.parametrize("dim", [2, 32, 64, 300])
def test_estimates_stay_within_their_bounds(dim):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((500, dim))
    x /= np.linalg.norm(x, axis=1)[:, None]
    turn = neighbours.rotation(dim)
    codes, scalar = neighbours.encode(x, turn)
    assert codes.dtype == np.uint64 and codes.shape == (500, neighbours.code_bits(dim) // 64)
    got, error = neighbours.Planes(x[:40], turn).estimate(codes, scalar, np.arange(40))
    assert (np.abs(got - x[:40] @ x.T) <= error).mean() > 0.999
    signs = np.where(x @ turn.T > 0, 1, -1)  # the bits give the plain estimate, but for the queries' rounding
    plain = (x[:40] @ turn.T) @ signs.T / np.sqrt(turn.shape[0]) / scalar
    assert np.abs(got - plain).max() < 0.1


def test_blocks_of_clustered_vectors_are_passed_over(spark, monkeypatch):
    rng = np.random.default_rng(9)
    centres = rng.standard_normal((20, 32))
    rows = [(i, (centres[i % 20] + 0.05 * rng.standard_normal(32)).tolist()) for i in range(1200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in neighbours.search(df, "vec_id", "embedding", 50, 5).orderBy("rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert got == _nearest(rows, 50, 5)


def test_neighbours_of_several_dimensions_and_repeated_ids(spark):
    rows = [(0, [1.0, 0.0], 1, 1), (1, [0.5, 0.5], 1, 1), (2, [1.0, 0.0, 0.0], 1, 1), (50, [0.9, 0.1, 0.0], 1, 1), (50, [0.9, 0.2, 0.0], 1, 1), (3, [], 1, 1), (None, [1.0, 0.0], 1, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int, code int")
    got = sorted((r["query_id"], r["rank"], r["vec_id"]) for r in neighbours.search(df, "vec_id", "embedding", 50, 2).collect())
    assert got == [(0, 1, 1), (50, 1, 2), (50, 2, 2)]


def test_passes_over_query_blocks(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "PASS_BYTES", 400)
    rng = np.random.default_rng(5)
    rows = [(i, x.tolist()) for i, x in enumerate(rng.standard_normal((300, 8)))]
    got = {}
    for r in neighbours.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id", "embedding", 50, 3).orderBy("rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert got == _nearest(rows, 50, 3)
