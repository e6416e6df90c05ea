import hashlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from plumbline.llm import decontamination as d

from .conftest import tokens

ITEMS = [(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"), (2, "one two"), (2, "first TAIL two"), (None, "omega"), (3, None), (4, "..."), (10, "psi omega first tail one")]


def brute(items, text, window=10):
    ws, hit, found = tokens(text), set(), set()
    for i, t in items:
        if i is None:
            continue
        s = tokens(t)
        k = min(window, len(s))
        for j in range(len(s) - k + 1 if k else 0):
            for a in range(len(ws) - k + 1):
                if ws[a : a + k] == s[j : j + k]:
                    hit.update(range(a, a + k))
                    found.add(str(i))
    return len(ws), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=60), st.lists(st.lists(st.integers(1, 3), min_size=3, max_size=3), min_size=1, max_size=5, unique_by=tuple))
def test_index_against_scan(s, windows):
    s = np.array([*s, 0])
    w = np.array(windows)
    index = d.FMIndex(s, 3)
    got = {}
    for which, lo, hi in zip(*index.search(w), strict=True):
        got[which] = sorted(index.locate(np.arange(lo, hi)).tolist())
    want = {i: at for i, x in enumerate(windows) if (at := [j for j in range(len(s) - 2) if s[j : j + 3].tolist() == x])}
    assert got == want


def test_report(spark, edge, none):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    want = sorted(((r["doc_id"] or -1, *brute(ITEMS, r["text"])) for r in edge.collect()))
    for size in (d.BLOCK_BYTES, 20):
        got = d.report(edge.select("doc_id", "text"), bench, block_bytes=size).collect()
        assert sorted((r[0] or -1, *r[1:]) for r in got) == want
    assert d.report(none, bench).count() == 0
    assert {r["n_hit"] for r in d.report(edge, bench.limit(0)).collect()} == {0}


def test_blocks_of_items_give_the_same(spark, documents, sf):
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    one = sorted(map(tuple, d.report(documents, bench).collect()))
    many = sorted(map(tuple, d.report(documents, bench, block_bytes=2000).collect()))
    assert one == many and any(r[5] for r in one)


def test_corpus_against_brute_force(spark, documents, sf):
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    windows = {}
    for i, t in items:
        s = tokens(t)
        k = min(10, len(s))
        for j in range(len(s) - k + 1 if k else 0):
            windows.setdefault(tuple(s[j : j + k]), set()).add(str(i))
    sizes = {len(k) for k in windows}
    got = {r["doc_id"]: r for r in d.report(documents, spark.createDataFrame(items, "item_id long, text string")).collect()}
    for r in documents.collect():
        ws, hit, found = tokens(r["text"]), set(), set()
        for k in sizes:
            for a in range(len(ws) - k + 1):
                if names := windows.get(tuple(ws[a : a + k])):
                    hit.update(range(a, a + k))
                    found |= names
        assert (got[r["doc_id"]]["n_words"], got[r["doc_id"]]["n_hit"], got[r["doc_id"]]["n_items"]) == (len(ws), len(hit), len(found))


def test_clean(spark, clashing):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    out = d.clean(clashing, bench)
    assert out.columns == clashing.columns
    left = out.collect()
    key = lambda rows: sorted((str(r["doc_id"]), r["text"] or "") for r in rows)
    assert key(left) == key(d.clean(clashing, bench, block_bytes=20).collect())
    assert not any(r["contaminated"] for r in d.report(out, bench).collect())
    kept = {r["doc_id"]: r["text"] for r in left}
    assert kept[4] is None and kept[12].startswith("dup line") and 9 not in kept and "nu xi" in kept[1] and "alpha" not in kept[1]
