"""Toxicity, language, sharding, archive and the pipeline."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from quillscan.llm import language, sharding, toxicity, warc

ENGLISH = "the quick ring of thing and other shore with that winter thorn either shine then gather".split()
GERMAN = "der schöne ring und nicht über straße können zwischen werden sicht lüge mögen".split()
INSULTS = ["gnarlwit", "bozzlehead"]


def _rows(n=240, seed=1):
    r, docs, labels = random.Random(seed), [], []
    for i in range(n):
        words = r.choices(ENGLISH if i % 3 else GERMAN, k=r.randrange(20, 60))
        bad = i % 5 == 0
        if bad:
            for w in r.sample(INSULTS, r.randrange(1, 3)):
                words.insert(r.randrange(len(words)), w)
        docs.append((i, " ".join(words) + ".", "en" if i % 3 else "de", "s", 1))
        labels.append((i, 1, int(bad)))
    return docs, labels


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    docs, labels = _rows()
    docs += [(1000, None, "en", "s", 0), (1001, "", "de", "s", 0), (1002, "12 34 !!", "en", "s", 8), (None, "the other ring", None, None, None), (1003, "gnarlwit " * 3000, "en", "s", 1)]
    docs += [(3000 + k, "the winter shore and " + " ".join(ENGLISH) + " other thing", "en", "s", 9) for k in range(4)]
    path = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(path / "documents.parquet"))
    spark.createDataFrame(labels + [(None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int").write.parquet(str(path / "labels.parquet"))
    return str(path)


def test_toxicity_on_held_out_documents(spark, tables):
    rows = {r["doc_id"]: r for r in toxicity.op3(spark, tables).collect()}
    for i in range(240):
        assert rows[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2)
        assert rows[i]["predicted"] == int(rows[i]["score"] >= 0.3) == int(i % 5 == 0), i
    assert rows[1003]["predicted"] == 1 and rows[None]["held_out"] is False
    assert rows[1000]["score"] == rows[1001]["score"] < 0.3


def test_insults_with_gaps_and_strange_letters():
    docs, labels = _rows()
    m = toxicity.train([d[1] for d in docs], [x[2] for x in labels], 0.2)
    words = ["gnarlwit", "g.n.a.r.l.w.i.t", "gnarxlwit", "Gnarl-wit!", "bozzlehhead"]
    assert (m.score(m.decide(words)) >= 0.3).all()
    assert (m.score(m.decide(ENGLISH + GERMAN)) < 0.3).all()
    assert "gnarl" in toxicity.words_of("you g n a r l you")


def test_words_that_tell_only_by_their_rate():
    """Words with a common start that toxic documents repeat and clean ones have once, each in another form; the start's letters stand inside clean words as well."""
    r = random.Random(5)
    tail = lambda: "".join(r.choices(["che", "en", "ung", "be", "zu", "ge", "st"], k=3))

    def document(n):
        words = [tail() + ("achlich" if r.random() < 0.1 else "") + tail() for _ in range(60)]
        for _ in range(n):
            words.insert(r.randrange(len(words)), "achlich" + tail())
        return " ".join(words) + "."

    some = lambda bad: document(r.randrange(3, 8) if bad else int(r.random() < 0.25))
    y = [int(i % 6 == 0) for i in range(900)]
    m = toxicity.train([some(t) for t in y], y, 1 / 6)
    words = lambda x: m.decide(toxicity.words_of(x))
    bad, good = (m.score([words(some(t)) for _ in range(200)]) for t in (1, 0))
    assert (bad >= toxicity.LIMIT).mean() > 0.8 and (good >= toxicity.LIMIT).mean() < 0.1


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "some text"), (2, None)], "doc_id long, text string")
    m = toxicity.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r["score"] for r in toxicity.score(docs, m).collect()} == {0.0}


def test_language_on_held_out_documents(spark, tables):
    rows = {r["doc_id"]: r for r in language.op4(spark, tables).collect()}
    for i in range(240):
        assert rows[i]["lang_pred"] == ("en" if i % 3 else "de") and 0 <= rows[i]["score"] <= 1
    assert {rows[i]["lang_pred"] for i in (1000, 1001, 1002)} == {"und"} and rows[None]["lang_pred"] == "en"


def test_probabilities_sum_to_one():
    m = language.Models({"en": [" ".join(ENGLISH)] * 3, "de": [" ".join(GERMAN)] * 3})
    letters = sorted({c for w in ENGLISH + GERMAN for c in w})
    for start in ("th", "sch", "x"):
        # log p(start + c + end) less the shared start leaves what follows it; the end's own share is in m.words(start)
        shared = _log(m, start, end=False)
        total = np.exp(_log(m, start, end=True) - shared) + sum(np.exp(_log(m, start + c, end=False) - shared) for c in letters)
        total += (language.SYMBOLS - len(letters) - 1) * np.exp(_log(m, start + "ž", end=False) - shared)  # every other symbol
        assert ((total > 0.999) & (total <= 1.001)).all(), total


def _log(m, word, end):
    """Log probabilities of a word's letters, with or without its end."""
    whole = m.words([word]).astype(float)[0, :-1]
    if end:
        return whole
    g = language.Grams([word])
    at = g.at(1)
    p = m.contexts[0][1][0] / language.SYMBOLS + m._find(*m.grams[0], g.hash[0][at])
    for k in range(2, language.ORDER + 1):
        deep = np.flatnonzero(g.place[at] >= k - 1)
        p[deep] = m._find(*m.grams[k - 1], g.hash[k - 1][at[deep]]) + m._find(*m.contexts[k - 1], g.hash[k - 2][at[deep] - 1]) * p[deep]
    return np.log(p[:-1]).sum(0)


def _kneser_ney(words, order=4):
    """Interpolated Kneser-Ney by dictionaries: a function from a word to the log probability of its letters and end."""
    tables = []
    padded = [f"\x02{w}\x03" for w in words]
    for k in range(1, order + 1):
        count = {}
        grams = [(w, i) for w in padded for i in range(max(k - 1, 1), len(w))]  # (word, place of the last letter)
        if k == order:
            for w, i in grams:
                count[w[i - k + 1 : i + 1]] = count.get(w[i - k + 1 : i + 1], 0) + 1
        else:
            for longer in {w[i - k : i + 1] for w, i in ((w, i) for w in padded for i in range(max(k, 1), len(w)))}:
                count[longer[1:]] = count.get(longer[1:], 0) + 1
            for w, i in grams:
                if i == k - 1:
                    count[w[: i + 1]] = count.get(w[: i + 1], 0) + 1
        ones, twos = (sum(c == n for c in count.values()) for n in (1, 2))
        d = min(max(ones / (ones + 2 * twos) if ones else 0.5, 0.1), 0.9)
        total, kinds = {}, {}
        for g, c in count.items():
            total[g[:-1]] = total.get(g[:-1], 0) + c
            kinds[g[:-1]] = kinds.get(g[:-1], 0) + 1
        tables.append(({g: max(c - d, 0) / total[g[:-1]] for g, c in count.items()}, {x: d * kinds[x] / total[x] for x in total}))

    def score(word):
        w, out = f"\x02{word}\x03", 0.0
        for i in range(1, len(w)):
            p = tables[0][1][""] / language.SYMBOLS + tables[0][0].get(w[i], 0.0)
            for k in range(2, order + 1):
                if i >= k - 1:
                    p = tables[k - 1][0].get(w[i - k + 1 : i + 1], 0.0) + tables[k - 1][1].get(w[i - k + 1 : i], 1.0) * p
            out += np.log(p)
        return out

    return score


def test_models_equal_a_plain_kneser_ney():
    texts = {"en": [" ".join(ENGLISH), "then the thing"], "de": [" ".join(GERMAN)]}  # too few to set any aside
    m = language.Models(texts)
    words = ["the", "thorn", "straße", "q", "rings", "zzz", "mögen"]
    got = m.words(words)
    for k, lang in enumerate(m.langs):
        plain = _kneser_ney([w for t in texts[lang] for w in t.split()])
        assert np.allclose(got[:, k], [plain(w) for w in words], rtol=1e-4), lang
    assert got[:, -1].tolist() == [len(w) + 1 for w in words]


def test_strange_texts_are_rejected():
    r = random.Random(2)
    text = lambda words: " ".join(r.choices(words, k=60))
    m = language.Models({"en": [text(ENGLISH) for _ in range(60)], "de": [text(GERMAN) for _ in range(60)]})
    score = lambda texts: np.array([x for _, x in m.predict(m.words(texts).astype(float))])
    noise = ["".join(r.choices("abcdefghijklmnopqrstuvwxyz  ", k=300)) for _ in range(50)]
    foreign = [text("кольцо берег зима собрать другой вещь блеск терн".split()) for _ in range(50)]
    assert (score([text(ENGLISH) for _ in range(100)] + [text(GERMAN) for _ in range(100)]) >= m.reject).all()
    assert (score(noise) < m.reject).all() and (score(foreign) < m.reject).all()


def test_long_runs_of_letters_are_cut():
    m = language.Models({"en": [" ".join(ENGLISH)] * 3, "de": [" ".join(GERMAN)] * 3})
    text = "ring" * 300_000
    got = m.words([text, "ring"])
    assert got[0, -1] == 1_200_000 + -(-1_200_000 // language.RUN)
    assert m.predict(got.astype(float))[0][0] in ("en", "de")


@pytest.mark.parametrize("rows", [[], [(1, "the other ring", "en", "old", "old", "old")], [(1, "the other ring", "en", "old", "old", "old"), (1, None, None, None, None, None)]], ids=["empty", "one", "repeated id"])
def test_classifiers_on_odd_tables(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string, predicted string, lang_pred string")
    found = language.identify(df, language.fit(df)).collect()
    assert len(found) == len(rows) and all(0 <= r["score"] <= 1 for r in found)
    assert {r["lang_pred"] for r in found} <= {"en", "und"}
    m = toxicity.fit(df, spark.createDataFrame([(1, 1)], "doc_id long, toxic int"))
    assert sorted((r["score"], r["predicted"]) for r in toxicity.score(df, m).collect()) == [(0.0, 0)] * len(rows)


def test_insults_in_another_script():
    other = str.maketrans("abcdefghijklmnopqrstuvwxyz", "абцдефгхийклмнопярстувщхыз")
    docs, labels = _rows()
    m = toxicity.train([d[1].translate(other) for d in docs], [x[2] for x in labels], 0.2)
    bad = [w.translate(other) for w in ("gnarlwit", "gnarxlwit", "bozzlehhead")]
    assert (m.score(m.decide(bad)) >= 0.3).all() and (m.score(m.decide([w.translate(other) for w in ENGLISH])) < 0.3).all()
    assert m.decide(["gnarl" * 400_000]).shape == (1,)  # a text without blanks is taken apart in parts


def test_calibration_is_a_rising_step_curve():
    f, y = np.array([0.0, 1.0, 2.0, 3.0, 4.0, 5.0]), np.array([0, 0, 1, 0, 1, 1])
    at, level = toxicity._calibrate(f, y, np.full(6, 1 / 6))
    assert at.tolist() == [0.0, 1.5, 3.5] and (np.diff(level) > 0).all() and abs(level[1] - 0.5) < 0.01


def test_language_without_training(spark):
    docs = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    assert [tuple(r)[-2:] for r in language.identify(docs, language.fit(docs)).collect()] == [("und", 0.0)]


def test_shares_differ_by_one_slot_and_moves_are_few():
    names = sharding.shard_names(12)
    a, b = sharding.fill(names, 1009), sharding.fill(names[:-1], 1009)
    counts = np.bincount(a)
    assert counts.max() - counts.min() <= 1
    moved = sum(names[x] != names[y] for x, y in zip(a.tolist(), b.tolist(), strict=True))
    assert moved < 2.5 * 1009 / 12
    with pytest.raises(ValueError):
        sharding.fill(names, 1000)


def test_placement_of_odd_keys(spark):
    df = spark.createDataFrame([(None, 1), ("a", 2), ("a", 3), ("", 4)], "k string, slot int")
    rows = sharding.place(df, "k", sharding.shard_names(4), 101).collect()
    assert len(rows) == 4 and rows[0].asDict().keys() == {"slot", "k", "shard"}
    assert len({r["shard"] for r in rows if r["k"] == "a"}) == 1
    assert len({r["slot"] for r in rows if not r["k"]}) == 1


def test_keys_named_like_the_result(spark):
    df = spark.createDataFrame([("a", "b", 1), ("c", "b", 2)], "slot string, shard string, `x.y` int")
    want = {r["k"]: r["shard"] for r in sharding.place(spark.createDataFrame([("a",), ("c",), ("b",)], "k string"), "k", sharding.shard_names(4), 101).collect()}
    assert [r["shard"] for r in sharding.place(df, "slot", sharding.shard_names(4), 101).orderBy("`x.y`").collect()] == [want["a"], want["c"]]
    assert {r["shard"] for r in sharding.place(df, "shard", sharding.shard_names(4), 101).collect()} == {want["b"]}
    assert sharding.place(df.limit(0), "slot", sharding.shard_names(4), 101).collect() == []


def test_archive_round_trip(spark, tmp_path):
    big = "<p>é</p>" * 200
    rows = [(1, "http://a", big), (2, "http://b\r\nX: y", big), (3, None, "small"), (4, "c", "small"), (5, "d", None), (6, "e", big + "x"), (7, "f", "WARC/1.1\r\n\r\n" * 100)]
    pages = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, header string")
    warc.write_archive(pages, str(tmp_path / "w"))
    got = {r["id"]: r for r in warc.read_archive(spark, str(tmp_path / "w")).collect()}
    assert {i: bytes(r["payload"]).decode() for i, r in got.items()} == {i: h or "" for i, _, h in rows}
    assert all(r["verified"] for r in got.values())
    assert spark.read.parquet(str(tmp_path / "w/payloads")).count() == 5  # each once
    assert "WARC-Type: revisit" in got[1]["header"] and "<urn:page:2>" in got[1]["header"] and "X: y" not in got[2]["header"].split("\r\n")


def _parsed(data):
    """The records of WARC bytes by a strict reading of the format; anything else is an error."""
    out, at = [], 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        first, *lines = data[at:end].split(b"\r\n")
        assert first == b"WARC/1.1", first
        fields = dict(x.split(b": ", 1) for x in lines)
        assert len(fields) == len(lines) and {b"WARC-Type", b"WARC-Record-ID", b"WARC-Date", b"Content-Length"} <= fields.keys()
        assert re.fullmatch(rb"<[a-z]+:[^>]+>", fields[b"WARC-Record-ID"]) and re.fullmatch(rb"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ", fields[b"WARC-Date"])
        size = int(fields[b"Content-Length"])
        block = data[end + 4 : end + 4 + size]
        at = end + 4 + size + 4
        assert len(block) == size and data[at - 4 : at] == b"\r\n\r\n"
        out.append((fields, block))
    return out


def test_exported_files_are_read_by_a_strict_parser(spark, tmp_path):
    big = "<p>é</p>\r\n\r\nWARC/1.1\r\n" * 90
    rows = [(1, "http://a", big), (2, "http://b\r\nX: y", big), (3, None, "small"), (4, "c", "small"), (5, "d", None), (6, "e", big + "x"), (None, "f", big)]
    warc.write_archive(spark.createDataFrame([(*r, "z", b"q", 1) for r in rows], "page_id long, url string, html string, header string, payload binary, sha256 int"), str(tmp_path / "w"))
    warc.export_warc(warc.read_archive(spark, str(tmp_path / "w")), str(tmp_path / "text"), spark.read.parquet(str(tmp_path / "w/info")), files=3)
    infos, got = 0, {}
    for file in (tmp_path / "text").glob("part-*"):
        records = _parsed(file.read_bytes())
        assert not records or records[0][0][b"WARC-Type"] == b"warcinfo"
        for fields, block in records:
            if fields[b"WARC-Type"] == b"warcinfo":
                infos += 1
                continue
            http, _, payload = block.partition(b"\r\n\r\n")
            assert http.startswith(b"HTTP/1.1 200 OK\r\n")
            got[fields[b"WARC-Record-ID"]] = fields, payload
    assert infos == 3 and len(got) == len(rows)
    for i, url, html in rows:
        fields, payload = got[b"<urn:page:%s>" % (b"null" if i is None else str(i).encode())]
        whole = (html or "").encode()
        assert fields[b"WARC-Payload-Digest"] == b"sha1:" + hashlib.sha1(whole).hexdigest().encode()
        assert fields[b"WARC-Target-URI"] == (url or "").replace("\r", "%0A").replace("\n", "%0A").encode()
        if fields[b"WARC-Type"] == b"revisit":
            assert payload == b"" and fields[b"WARC-Refers-To"] == b"<urn:page:2>" and i in (1, None)
        else:
            assert payload == whole and i not in (1, None)


def test_payloads_held_by_repeated_ids_are_stored_once(spark, tmp_path):
    a, b, c = "a" * 1200, "b" * 1200, "c" * 1200
    rows = [(9, a), (9, b), (9, a), (3, a), (4, b), (7, c), (None, c), (None, "only"), (None, "only"), (2, "only two"), (9, "nine")]
    warc.write_archive(spark.createDataFrame([(i, "u", t) for i, t in rows], "page_id long, url string, html string"), str(tmp_path / "w"))
    held = [bytes(r["payload"]).decode() for r in spark.read.parquet(str(tmp_path / "w/payloads")).collect()]
    assert sorted(held) == sorted({t for _, t in rows})
    got = warc.read_archive(spark, str(tmp_path / "w")).collect()
    assert all(r["verified"] for r in got)
    assert sorted((str(r["id"]), bytes(r["payload"]).decode()) for r in got) == sorted((str(i), t) for i, t in rows)


def test_archive_of_repeated_and_null_ids(spark, tmp_path):
    big = "y" * 1500
    pages = spark.createDataFrame([(1, "a", big), (1, "a", big), (None, "b", big), (1, "c", "other"), (2, "d", "other")], "page_id long, url string, html string")
    pages.write.parquet(str(tmp_path / "pages.parquet"))
    rows = sorted((r["page_id"] or -1, r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.op8(spark, str(tmp_path)).collect())
    assert rows == [(-1, 1500, "revisit", 1), (1, 5, "response", None), (1, 1500, "response", None), (1, 1500, "response", None), (2, 5, "response", None)]


def test_damaged_payloads_are_told(spark, tmp_path):
    warc.write_archive(spark.createDataFrame([(1, "u", "text")], "page_id long, url string, html string"), str(tmp_path / "w"))
    spark.createDataFrame([(r["sha256"], bytearray(b"texT")) for r in spark.read.parquet(str(tmp_path / "w/payloads")).collect()], "sha256 string, payload binary").write.mode("overwrite").parquet(str(tmp_path / "w2/payloads"))
    spark.read.parquet(str(tmp_path / "w/headers")).write.parquet(str(tmp_path / "w2/headers"))
    assert [r["verified"] for r in warc.read_archive(spark, str(tmp_path / "w2")).collect()] == [False]


def test_records_are_dated_and_parsed_by_their_lengths(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://é", "é text\r\n\r\nmore"), (2, "u", "other")], "page_id long, url string, html string")
    warc.write_archive(pages, str(tmp_path / "w"))
    got = {r["id"]: r for r in warc.read_archive(spark, str(tmp_path / "w")).collect()}
    assert all(r["verified"] and re.search(r"\r\nWARC-Date: \d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ\r\n", r["header"]) for r in got.values())
    assert bytes(got[1]["payload"]).decode() == "é text\r\n\r\nmore" and "http://é" in got[1]["header"]
    wrong = spark.read.parquet(str(tmp_path / "w/headers"))  # a length that isn't the block's
    wrong.selectExpr("id", "regexp_replace(header, 'response\\r\\nContent-Length: [0-9]+', 'response\\r\\nContent-Length: 9') AS header", "sha256").write.parquet(str(tmp_path / "w2/headers"))
    spark.read.parquet(str(tmp_path / "w/payloads")).write.parquet(str(tmp_path / "w2/payloads"))
    assert [r["verified"] for r in warc.read_archive(spark, str(tmp_path / "w2")).collect()] == [False, False]


def test_empty_pages(spark, tmp_path):
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    assert warc.op8(spark, str(tmp_path)).collect() == []


def test_other_texts_of_a_repeated_id_stay(spark):
    import corpus_pipeline

    rows = [(5, "a b c d e f"), (5, "quite another text of five words"), (5, "quite another text of five words"), (3, "A B C D E F"), (9, "x y z x y z"), (2, ""), (2, ""), (None, "a b c d e f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(r) for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()]
    assert sorted(got, key=str) == sorted([(5, rows[1][1]), (3, "A B C D E F"), (9, "x y z x y z"), (2, ""), (None, "a b c d e f")], key=str)
    pieces = corpus_pipeline.pack(spark, spark.createDataFrame(got, docs.schema), "").where("doc_id = 5").count()
    assert pieces == 1


def test_pipeline_against_brute_force(spark, tables):
    import corpus_pipeline
    from tests.llm.test_near import _components

    docs = spark.read.parquet(f"{tables}/documents.parquet")
    names = docs.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = stage(spark, docs, tables)
        assert docs.columns == names
        kept, had = [(r["doc_id"], r["text"]) for r in docs.collect()], [(r["doc_id"], r["text"]) for r in before.collect()]
        assert set(kept) <= set(had)
        if stage is corpus_pipeline.drop_toxic:
            assert {i for i, _ in set(had) - set(kept)} == {i for i in range(240) if i % 5 == 0} | {1003}
        elif stage is corpus_pipeline.drop_unknown_language:
            assert {i for i, _ in set(had) - set(kept)} == {1000, 1001, 1002}
        else:
            want = {i for i, (_, c) in _components([x for x in had if x[0] is not None]).items() if i == c}
            assert {i for i, _ in kept if i is not None} == want
    whole = {i for i, _ in kept}
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, tables).collect()} == whole
