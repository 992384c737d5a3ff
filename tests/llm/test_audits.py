"""Source divergence, vector codes and url filters against brute force, and their odd rows."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillscan.llm import divergence, url_filters, vector_codes

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _divergence(rows):
    """The contract word by word: dense, on Python's integers."""
    docs = [((t or "").translate(LOWER), lang or "", s or "") for t, lang, s in rows]
    groups, counts, within = {(lang, s) for _, lang, s in docs}, defaultdict(Counter), defaultdict(Counter)
    for text, lang, s in docs:
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text)
        counts[lang, s].update(terms)
        within[lang].update(set(terms))
    kept = {lang: sorted(t for t, n in c.items() if n >= 10) for lang, c in within.items()}
    share = lambda n, total, v: 1 + 10**9 * (n + 2) // (total + 2 * v)
    out = []
    for lang, s in groups:
        terms = kept.get(lang, [])
        of = lambda c: {t: share(c[t], sum(c[x] for x in terms), len(terms)) for t in terms}
        p = of(counts[lang, s])
        for part in ("pair", "term"):
            found = []
            if part == "pair":
                for other in (x for lang2, x in groups if lang2 == lang and x != s):
                    q = of(counts[lang, other])
                    found.append((sum((p[t] - q[t]) ** 2 // (p[t] + q[t]) for t in terms), other))
            else:
                q = of(sum((c for (lang2, _), c in counts.items() if lang2 == lang), Counter()))
                found = [((p[t] - q[t]) ** 2 // (p[t] + q[t]), t) for t in terms if counts[lang, s][t] and p[t] > q[t]]
            found.sort(key=lambda x: (-x[0], x[1].encode()))
            out += [(lang, s, part, item, v, k + 1) for k, (v, item) in enumerate(found) if part == "pair" or k < 10]
    return sorted(out)


def _words(seed, n, odd=""):
    rng = np.random.default_rng(seed)
    return " ".join([*("w" + "abcdefghijklmnopqrstuvwxyz"[i] for i in np.minimum(rng.geometric(0.15, n), 25)), odd])


ODD = [
    (None, None, None), ("", "en", "a"), (None, "en", "b"), ("1234 !?", "fr", "solo"), ("Ünder ÜNDER ünder naïve 漢字", "de", None), ("x" * 3000, "en", "a"),
    ("a_b`c{d}e@f[g\\h]", "en", "c"),
]


@pytest.fixture(scope="module")
def divergence_rows():
    rows = [(_words(i, 60, "Ärger" if i % 3 else "ÄRGER"), ["en", "de", None][i % 3], ["a", "b", "c", "d"][i % 4]) for i in range(150)]
    return rows + ODD + [("same words here", "en", "a")] * 30


def test_divergence_is_that_of_brute_force(spark, divergence_rows):
    # extra columns with names of the result and of the steps
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in divergence_rows], "text string, lang string, source string, n long, rank int, value int").repartition(5)
    got = divergence.audit(df)
    assert [f.dataType.simpleString() for f in got.schema][-2:] == ["bigint", "int"]
    assert sorted(map(tuple, got.collect())) == _divergence(divergence_rows)


def test_divergence_over_many_shards(spark, divergence_rows, monkeypatch):
    monkeypatch.setattr(divergence, "SHARD", 7)
    monkeypatch.setattr(divergence, "HELD", 20)
    df = spark.createDataFrame(divergence_rows, "text string, lang string, source string").repartition(3)
    assert sorted(map(tuple, divergence.audit(df).collect())) == _divergence(divergence_rows)


def test_divergence_of_long_texts_and_of_nothing(spark, monkeypatch):
    rows = [(_words(1, 3000), "en", "a"), (_words(2, 2000), "en", "b")] + [(_words(i, 30), "en", "b") for i in range(12)]
    want = _divergence(rows)
    from quillscan.llm import divergence as module

    parts = list(module._pieces(["ab " * 1_000_000, "cd"]))
    assert len(parts) > 2 and sum(len(t.split()) for p in parts for t in p["terms"].to_pylist()) == 1_000_001
    df = spark.createDataFrame(rows, "text string, lang string, source string")
    assert sorted(map(tuple, divergence.audit(df).collect())) == want
    assert divergence.audit(df.where("false")).collect() == []
    few = [("one two", "en", "a"), ("one", "en", "b"), (None, "fr", "a")]  # no term is kept
    assert sorted(map(tuple, divergence.audit(spark.createDataFrame(few, "text string, lang string, source string")).collect())) == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]


def _codes(rows):
    """All distances of all entries, on Python's integers."""
    kept = [(i, label, [math.floor(256 * float(np.float32(x))) for x in v]) for i, label, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0], r[2]))
    size = len(kept[0][2]) // 16
    cut = [[v[p * size : (p + 1) * size] for p in range(16)] for _, _, v in kept]
    books = [[cut[e][p] for e in range(min(64, len(kept)))] for p in range(16)]
    apart = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    for k in range(3):
        best = [[min((apart(x, c), e) for e, c in enumerate(books[p])) for p, x in enumerate(v)] for v in cut]
        if k < 2:
            for p in range(16):
                for e in range(len(books[p])):
                    if own := [v[p] for v, b in zip(cut, best, strict=True) if b[p][1] == e]:
                        books[p][e] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    error = [sum(d for d, _ in b) for b in best]
    by_label = Counter()
    for (_, label, _), e in zip(kept, error, strict=True):
        by_label[label] += e
    digest = hashlib.sha256(",".join(str(x) for book in books for entry in book for x in entry).encode()).hexdigest()
    return [(i, "".join(f"{e:02x}" for _, e in b), e, by_label[label], digest) for (i, label, _), b, e in zip(kept, best, error, strict=True)]


KEY = lambda r: (r[0] is None, r[0] or 0, r[1])


def _coded(spark, tmp_path, rows, schema="vec_id long, label int, embedding array<float>"):
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(str(tmp_path / "embeddings.parquet"))
    got = vector_codes.op12(spark, str(tmp_path))
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    return sorted(map(tuple, got.collect()), key=KEY)


def test_vector_codes_are_those_of_brute_force(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [(i, int(i % 3) if i % 7 else None, [float(x) for x in rng.normal(size=32)]) for i in range(150)]
    rows += [(200 + i, 1, [0.5] * 32) for i in range(40)]  # a hot vector: its entries all tie
    rows += [(None, 1, [0.25] * 32), (300, 1, None), (301, 1, [float("nan")] * 32), (302, 1, [None] + [0.0] * 31), (303, 2, [float("inf")] * 32), (7, 2, [0.125] * 32)]
    assert _coded(spark, tmp_path, rows) == sorted(_codes(rows), key=KEY)


def test_vector_codes_of_few_rows_and_of_none(spark, tmp_path):
    few = [(i, None, [float(i)] * 16) for i in range(3)]
    assert _coded(spark, tmp_path / "few", few) == sorted(_codes(few), key=KEY)
    assert _coded(spark, tmp_path / "none", [(1, 1, None)]) == []
    extra = spark.createDataFrame([(1, [1.0] * 17, 1, "v", "code", 5)], "vec_id long, embedding array<float>, label int, v string, code string, error int")
    coded, books = vector_codes.compressed(spark, extra)  # 17 components end with zeros; columns of the steps' names aren't read
    assert books.entries.shape == (16, 1, 2) and coded.count() == 1


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 64), st.integers(1, 5), st.sampled_from([2, 50, 1 << 27]))
def test_the_search_finds_what_looking_at_every_entry_finds(seed, entries, size, most):
    rng = np.random.default_rng(seed)
    books = vector_codes.Codebooks(rng.integers(-most, most + 1, (3, entries, size)))
    x, start = rng.integers(-most, most + 1, (20, 3, size)), rng.integers(0, entries, (20, 3))
    code, least, looked = books.search(x, start)
    d = ((x[:, :, None, :] - books.entries[None]) ** 2).sum(3)
    assert (code == d.argmin(2)).all() and (least == d.min(2)).all()  # argmin: the lower index of a tie


def test_the_search_looks_at_few_entries_of_near_vectors():
    rng = np.random.default_rng(1)
    centres = rng.integers(-10_000, 10_000, (16, 64, 4))
    own = rng.integers(0, 64, (500, 16))
    x = centres[np.arange(16), own] + rng.integers(-50, 50, (500, 16, 4))
    code, _, looked = vector_codes.Codebooks(centres).search(x, own)
    assert (code == own).all() and looked < 3 * own.size  # of 64 entries a part


URLS = [
    ("http://Shop.Example.ORG/en/1?x", "shop.example.org", "/en/1", "example.org/en/1", "block"),
    ("https://a.example.org/en/2", "a.example.org", "/en/2", "org/", "allow"),
    ("https://example.org/es/", "example.org", "/es/", "example.org/es/", "block"),
    ("https://notexample.org/es/x", "notexample.org", "/es/x", "org/", "allow"),
    ("http://x.com/fr/1#top", "x.com", "/fr/1", "com/fr/", "allow"),
    ("http://x.com/de/1", "x.com", "/de/1", "com/de/", "block"),
    ("http://org", "org", "", None, None),
    ("http://org/", "org", "/", "org/", "allow"),
    ("//x.org/a", "", "", None, None),
    ("", "", "", None, None),
    (None, "", "", None, None),
    ("http://a.net?u=http://b.org/", "a.net", "", None, None),
    ("x://y://z.org/", "y:", "//z.org/", None, None),
    ("http://ÄB.com/fr", "Äb.com", "/fr", None, None),
    ("http://a.org\n/b", "a.org\n", "/b", None, None),
]


def test_rules_fit_hosts_subdomains_and_paths(spark):
    df = spark.createDataFrame([(i, u[0], "h", "p") for i, u in enumerate(URLS)], "page_id long, url string, host string, path string")
    got = {r["page_id"]: r for r in url_filters.judged(df).collect()}
    for i, (_, host, path, rule, verdict) in enumerate(URLS):
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule), URLS[i]
        assert got[i]["verdict"] == (verdict or "allow") or (rule is None and got[i]["verdict"] == "block"), URLS[i]
    assert url_filters.judged(df.where("false")).collect() == []


def test_registered_domains(spark):
    hosts = {
        "a.b.example.com": ("com", "example.com"), "example.com": ("com", "example.com"), "com": ("com", "com"), "x.y.co.uk": ("co.uk", "y.co.uk"), "co.uk": ("uk", "co.uk"),
        "u@www.example.org:8080": ("org", "example.org"), "10.0.0.1": ("", "10.0.0.1"), "10.0.0.1:80": ("", "10.0.0.1"), "[::1]:80": ("", "[::1]"), "": ("", ""), "a.com.": ("com", "a.com"),
    }
    df = spark.createDataFrame([(h,) for h in hosts], "host string").withColumn("d", url_filters.domain_of(F.col("host")))
    assert {r["host"]: tuple(r["d"]) for r in df.collect()} == hosts


def _reputation(hosts, domain):
    """The same posteriors, level by level, on Python's numbers."""
    def level(rows, key):
        out = defaultdict(lambda: [0, 0])
        for name, (bad, n) in rows.items():
            out[key(name)][0] += bad
            out[key(name)][1] += n
        return out

    def strength(rows, key):
        per = defaultdict(list)
        for name, (bad, n) in rows.items():
            if n:
                per[key(name)].append((bad, n))
        among = most = 0.0
        for members in per.values():
            k, s = sum(b for b, _ in members), sum(n for _, n in members)
            p = k / s
            among += sum(n * (b / n - p) ** 2 for b, n in members) - p * (1 - p) * (len(members) - 1)
            most += p * (1 - p) * (s - sum(n * n for _, n in members) / s - (len(members) - 1))
        rho = min(max(among / most, 0.001), 0.9) if most > 0 else 0.1
        return 1 / rho - 1

    domains = level(hosts, lambda h: domain[h])
    suffixes = level(domains, lambda d: d[0])
    k, n = (sum(x[i] for x in suffixes.values()) for i in (0, 1))
    rate = (k + 1) / (n + 2)
    s1, s2, s3 = strength(suffixes, lambda _: 0), strength(domains, lambda d: d[0]), strength(hosts, lambda h: domain[h])
    ms = {s: (b + s1 * rate) / (n + s1) for s, (b, n) in suffixes.items()}
    md = {d: (b + s2 * ms[d[0]]) / (n + s2) for d, (b, n) in domains.items()}
    out = {}
    for h, (b, n) in hosts.items():
        mean = (b + s3 * md[domain[h]]) / (n + s3)
        out[h] = mean, mean - 3 * math.sqrt(mean * (1 - mean) / (n + s3 + 1))
    return out


def test_reputations_shrink_hosts_toward_their_domains(spark):
    rng = np.random.default_rng(5)
    hosts, domain = {}, {}
    for d, rate in (("bad.com", 0.95), ("good.com", 0.05), ("mixed.net", 0.5)):
        for i in range(12):
            n = int(rng.integers(0, 60))
            hosts[f"h{i}.{d}"] = (int(rng.binomial(n, rate)), n)
    hosts |= {"new.bad.com": (0, 0), "new.good.com": (0, 0), "new.fresh.org": (0, 0), "": (0, 0)}
    for h in hosts:
        domain[h] = (h.split(".")[-1], ".".join(h.split(".")[-2:]))
    df = spark.createDataFrame([(h, b, n) for h, (b, n) in hosts.items()], "host string, bad long, n long")
    got = {r["host"]: (r["mean"], r["lower"]) for r in url_filters.reputations(df).collect()}
    want = _reputation(hosts, domain)
    assert got.keys() == want.keys()
    for h in want:
        assert got[h] == pytest.approx(want[h], abs=1e-8), h
    assert got["new.bad.com"][0] > 0.7 > 0.4 > got["new.good.com"][0]  # no page of their own: their domain's rate
    assert got["new.good.com"][0] < got["new.fresh.org"][0] < got["new.bad.com"][0]


def test_url_verdicts_with_a_hot_host(spark):
    rows = [(i, f"http://spam.com/{'de' if i % 3 else 'en'}/{i}") for i in range(900)] + [(1000 + i, f"http://h{i}.net/en/{i}") for i in range(50)] + [(2000 + i, f"http://ok{i % 5}.org/en/{i}") for i in range(200)]
    got = url_filters.judged(spark.createDataFrame(rows, "page_id long, url string").repartition(4))
    by = Counter((r["host"].split(".")[-1], r["rule"], r["verdict"]) for r in got.collect())
    assert by == {("com", "com/de/", "block"): 600, ("com", None, "block"): 300, ("net", None, "allow"): 50, ("org", "org/", "allow"): 200}
