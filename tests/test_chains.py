"""Chains that lead to nodes, against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from quillscan.operators import chains, relations


def _pairs(edges):
    after, out = {}, {}
    for a, b in edges:
        after.setdefault(a, set()).add(b)
    for src in after:
        front, hops = after[src], 0
        while front:
            hops += 1
            out |= {(src, x): hops for x in front}
            front = {y for x in front for y in after.get(x, ()) if (src, y) not in out}
    return out


def _single(r, n):
    """Edges of n nodes with one source each: cycles of any length with trees on them, a line, a cycle of its own, a loop, a star."""
    edges = {k: r.randrange(n) for k in range(n)}
    edges |= {n + k: n + k - 1 for k in range(1, 70)} | {1000 + k: 1000 + (k + 1) % 40 for k in range(40)} | {2000: 2000, 2001: 2000}
    return [(src, dst) for dst, src in (edges | {3000 + k: 1007 for k in range(30)}).items()]


@pytest.mark.parametrize("seed", range(3))
def test_chains_are_those_of_a_walk(spark, monkeypatch, seed):
    monkeypatch.setattr(chains, "_ENDS_A_ROW", 7)
    monkeypatch.setattr(chains, "_APART", [(4, 32), (2, 4), (1, 1)][seed])
    edges = _single(random.Random(seed), 150)
    rows = relations.closure(spark.createDataFrame(edges, "src long, dst long")).collect()
    want = _pairs(edges)
    assert len(rows) == len(want) and {(x["src"], x["dst"]): x["hops"] for x in rows} == want


def test_nodes_of_more_sources_are_led_to_along_chains(spark):
    r = random.Random(9)
    edges = _single(r, 100) + [(3, 400), (1005, 400), (400, 401), (401, 402), (402, 400), (60, 500), (400, 500), (500, 501), (None, 3), (3, None), (60, 500)]
    rows = relations.closure(spark.createDataFrame(edges, "src long, dst long")).collect()
    want = _pairs([e for e in edges if None not in e])
    assert len(rows) == len(want) and {(x["src"], x["dst"]): x["hops"] for x in rows} == want


def test_pairs_of_chains_are_not_written(spark, monkeypatch):
    """Rows written for a graph whose pairs are many times its nodes."""
    edges = [(k // 2 if k > 1 else 1, k) for k in range(1, 200)] + [(200 + k, 201 + k) for k in range(300)]
    rows = []

    def counted(df, name, _saved=relations.saved):
        out = _saved(df, name)
        rows.append(out.count())
        return out

    for module in (chains, relations):
        monkeypatch.setattr(module, "saved", counted)
    out = relations.closure(spark.createDataFrame(edges, "src long, dst long"))
    n = out.agg(F.count("*")).first()[0]
    assert n == len(_pairs(edges)) > 45_000
    assert max(rows) <= len(edges) and sum(rows) < n / 4
