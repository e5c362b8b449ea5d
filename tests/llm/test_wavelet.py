"""Ranked search on wavelet trees against SQL and brute force, and its edges."""

from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.held import connection, same
from tidewell.llm import registry, wavelet

SF = "/root/testdata/sf0.001"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def split(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, k=10):
    """Sorted (item, rank, doc, score) of (id, text) lists."""
    counts = [(i, Counter(split(t))) for i, t in docs if i is not None]
    counts = [(i, c) for i, c in counts if c]
    n_docs, n_terms = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c in counts:
            m = 25 + (75 * sum(c.values()) * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in split(text) if t in c)
            scores.append((-score, i))
        out += [(item, r + 1, i, -s) for r, (s, i) in enumerate(sorted(x for x in scores if x[0] < 0)[:k])]
    return sorted(out)


def test_op11_sql(spark):
    same(registry.queries()["op11_dual_sorted_wavelet"](spark, SF), connection(SF), registry.oracle_sql()["op11_dual_sorted_wavelet"])


@given(st.lists(st.text(alphabet="aB1 é.\x00ß日_@[`{", max_size=20), max_size=5))
def test_terms_are_those_of_the_pattern(texts):
    found, doc = wavelet.terms([t.encode() for t in texts])
    got = defaultdict(list)
    for t, d in zip(found.to_pylist(), doc.tolist(), strict=True):
        got[d].append(t.decode())
    assert [got[i] for i in range(len(texts))] == [split(t) for t in texts]


@settings(deadline=None, max_examples=60)
@given(st.integers(1, 70), st.integers(1, 12), st.integers(0, 10**6), st.integers(1, 12))
def test_tree_finds_the_best(n_docs, n_terms, seed, k):
    """Random shards, many ties among them: the k best of each query are those of adding up all postings; the tree comes back from its bytes."""
    rng = np.random.default_rng(seed)
    pairs = np.unique(rng.integers(0, n_terms * n_docs, size=3 * n_docs))
    term, doc = pairs // n_docs, pairs % n_docs
    tf, m = rng.integers(1, 4, size=len(pairs)), rng.choice([40, 100, 300], size=n_docs)
    tree = wavelet.Tree.unpack(wavelet.Tree.pack(np.arange(n_docs) * 7, m, term, doc, tf))
    lists = np.bincount(term, minlength=n_terms)
    starts = np.cumsum(lists) - lists
    for t in range(n_terms):  # lists by falling impact, in the tree as given
        own = tree.impact[0][starts[t] : starts[t] + lists[t]]
        assert sorted(own.tolist(), reverse=True) == own.tolist() == sorted(wavelet.impacts(tf[term == t], m[doc[term == t]]).tolist(), reverse=True)
    queries = [np.flatnonzero((rng.random(n_terms) < 0.5) & (lists > 0)) for _ in range(40)]
    q = np.repeat(np.arange(40), [len(x) for x in queries])
    t = np.concatenate(queries)
    w = rng.integers(1, 4, size=len(t))
    got = defaultdict(list)
    for a, d, s in zip(*tree.search(q, starts[t], lists[t], w, k), strict=True):
        got[int(a)].append((-int(s), int(d)))
    for i in range(40):
        score = np.zeros(n_docs, dtype=np.int64)
        for x, weight in zip(t[q == i], w[q == i], strict=True):
            score[doc[term == x]] += weight * wavelet.impacts(tf[term == x], m[doc[term == x]])
        assert sorted(got[i]) == sorted((-int(s), d) for d, s in enumerate(score) if s > 0)[:k]


def test_bounds_prune():
    """One document has all terms of the query, and thousands one common term each: few nodes are opened."""
    n = 4096
    term = np.repeat(np.arange(8), n // 8)
    doc = np.arange(n)
    term, doc = np.concatenate((term, np.arange(8))), np.concatenate((doc, np.full(8, 100)))
    pairs = np.unique(term * n + doc)
    term, doc = pairs // n, pairs % n
    tree = wavelet.Tree.unpack(wavelet.Tree.pack(np.arange(n), np.full(n, 100), term, doc, np.ones(len(term), dtype=np.int64)))
    lists = np.bincount(term)
    opened = []
    expand = tree._expand
    tree._expand = lambda nodes, pool, top: opened.append(len(nodes[0])) or expand(nodes, pool, top)
    q, found, score = tree.search(np.zeros(8, dtype=np.int64), np.cumsum(lists) - lists, lists, np.ones(8, dtype=np.int64), 1)
    assert found.tolist() == [100] and sum(opened) < 120


def test_index_of_many_shards(spark):
    """Tiny shards, ties, copies, repeated ids, items with repeats: as by brute force."""
    rng = random.Random(5)
    words = ["alpha", "Beta", "gamma", "δέλτα", "x1", "of", "the", "日本", "qq"]
    docs = [(rng.randint(0, 150), " ".join(rng.choices(words, [1, 2, 3, 1, 1, 9, 9, 1, 2], k=rng.randint(0, 30)))) for _ in range(160)] + [(999, "the of"), (1000, "the of"), (1001, "the of")]
    items = [(i, " ".join(rng.choices([*words, "unknown"], k=rng.randint(0, 8)))) for i in range(70)]
    index = wavelet.write_index(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), shard_bytes=300)
    assert index.lexicon.select("shard").distinct().count() > 20
    got = wavelet.search(index, spark.createDataFrame(items, "item_id long, text string"), 7)
    assert sorted(map(tuple, got.collect())) == brute(docs, items, 7)


def test_blocks_of_queries(spark, monkeypatch):
    monkeypatch.setattr(wavelet, "BLOCK", 3)
    docs = [(i, f"a{i % 7} b{i % 3} c") for i in range(60)]
    items = [(i, f"a{i % 9} b{i % 4} c c") for i in range(20)]
    got = wavelet.search(wavelet.write_index(spark.createDataFrame(docs, "doc_id long, text string")), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(map(tuple, got.collect())) == brute(docs, items)


def test_search_edges(spark):
    docs = [(1, None), (2, ""), (3, " .,-"), (None, "apple"), (4, "apple pie " * 40_000), (5, "APPLE"), (5, "apple"), (6, "Äpfel")]
    clash = spark.createDataFrame([(*d, "s", 1, "f") for d in docs], "doc_id long, text string, shard string, score int, file string")
    items = [(1, "Apple"), (2, None), (3, "nothing here"), (None, "apple"), (4, "äpfel"), (7, "pie"), (7, "apple")]
    asked = spark.createDataFrame([(*i, 3, "q") for i in items], "item_id long, text string, rank int, query string")
    index = wavelet.write_index(clash)
    got = wavelet.search(index, asked).collect()
    assert sorted(map(tuple, got)) == brute(docs, [i for i in items if i[0] is not None])
    assert [r["doc_id"] for r in got if r["item_id"] == 1 and r["rank"] > 1] == [5, 5]  # equal scores, a row each
    none = wavelet.write_index(spark.createDataFrame([], "doc_id long, text string"))
    assert wavelet.search(none, asked).collect() == [] and (none.n_docs, none.n_terms) == (0, 0)
    assert wavelet.search(index, spark.createDataFrame([], "item_id long, text string")).collect() == []


@pytest.mark.parametrize(("n", "n_docs"), [(10, 10), (10**9, 10**9)])
def test_lengths_beyond_64_bits(n, n_docs):
    assert wavelet.length_parts(np.array([n]), n_docs, 1000 * n_docs).tolist() == [25 + 75 * n // 1000]
