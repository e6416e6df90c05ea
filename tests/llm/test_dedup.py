import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from plumbline.llm import minhash_dedup as m
from plumbline.llm import substring_dedup as s
from plumbline.llm.components import components

from .conftest import LOW, words


def sets_of(rows, k=4):
    out = {}
    for i, text in rows:
        ws = words((text or "").translate(LOW))
        out[i] = {tuple(ws[j : j + k]) for j in range(len(ws) - k + 1)} if len(ws) >= k else ({tuple(ws)} if ws else set())
    return out


def brute_groups(rows, k=4, percent=80):
    sets, inverted, parent = sets_of(rows, k), defaultdict(list), {}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in sorted(sets):
        for g in sets[i]:
            inverted[g].append(i)
    for i in sorted(sets):
        for j, n in Counter(j for g in sets[i] for j in inverted[g] if j < i).items():
            if 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), root(i), root(i) == i) for i in sets}


def test_groups(spark, documents):
    rows = [(r[0], r[1]) for r in documents.select("doc_id", "text").collect()]
    got = {r[0]: tuple(r)[1:] for r in m.group(documents).collect()}
    assert got == brute_groups(rows)


def test_groups_of_edge_rows(spark, edge, none, clashing):
    rows = [(r[0], r[1]) for r in edge.select("doc_id", "text").collect() if r[0] is not None]
    got = m.group(edge).collect()
    assert len(got) == edge.count()
    want = brute_groups(rows)
    for r in got:
        assert (r["n_shingles"], r["component_id"], r["kept"]) == want[r["doc_id"]] if r["doc_id"] is not None else (r["component_id"] is None and r["kept"])
    assert m.group(none).count() == 0
    kept = m.keep(clashing)
    ids = [r["doc_id"] for r in kept.collect()]
    assert kept.columns == clashing.columns and sorted(i for i in ids if i is not None) == sorted(i for i, w in want.items() if w[2])


def test_chains_across_components(spark):
    """Texts each near the next but not near the first: links between later ones must not be lost."""
    base = [f"t{i}" for i in range(120)]
    rows = []
    for i in range(40):
        ws = list(base)
        for j in range(i):
            ws[j * 3] = f"n{j}"
        rows.append((100 + i, " ".join(ws)))
    rows += [(i, " ".join([*base[:90], *(f"p{i}q{j}" for j in range(40))])) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for settings in (m.Settings(), m.Settings(block=8)):
        assert {r[0]: tuple(r)[1:] for r in m.group(docs, settings).collect()} == brute_groups(rows)


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(3)
    both, only = rng.integers(0, 2**63, 400, dtype=np.int64), rng.integers(0, 2**63, 100, dtype=np.int64)
    for n in (4, 40, 400):
        a, b = both[:n], np.concatenate([both[: n - n // 4], only[: n // 4]])
        row = np.repeat([0, 1], [len(a), len(b)])
        sig = m.superminhash(row, np.concatenate([np.sort(a.astype(np.uint64)), np.sort(b.astype(np.uint64))]), 2, 256)
        j = (n - n // 4) / (n + n // 4)
        assert abs((sig[0] == sig[1]).mean() - j) < 0.13
        # slots hold the elements' steps in [0, m), each filled
        assert (sig >> np.uint64(48)).max() < 256


@pytest.mark.parametrize("n", [1, 60])
def test_components_of_paths_and_stars(spark, n):
    links = [(i, i + 1) for i in range(n)] + [(1000, 1000 + i) for i in range(1, n + 1)] + [(5000, 5000)]
    got = {r[0]: r[1] for r in components(spark.createDataFrame(links, "a long, b long").repartition(4)).collect()}
    assert got == {i: 0 for i in range(n + 1)} | {1000 + i: 1000 for i in range(n + 1)}


def brute_spans(rows, window=50):
    seen, out = {}, []
    for i, text in rows:
        ws = words(text)
        for j in range(len(ws) - window + 1) if i is not None else ():
            k = tuple(ws[j : j + window])
            seen[k] = min(seen.get(k, i), i)
    for i, text in rows:
        ws, gone = words(text), set()
        for j in range(len(ws) - window + 1) if i is not None else ():
            if seen[tuple(ws[j : j + window])] < i:
                gone.update(range(j, j + window))
        out.append((i, len(ws), len(gone), hashlib.sha256(" ".join(x for j, x in enumerate(ws) if j not in gone).encode()).hexdigest()))
    return sorted(out, key=str)


def test_spans(spark, documents):
    rows = [(r[0], r[1]) for r in documents.select("doc_id", "text").collect()]
    got = sorted(map(tuple, s.dedup_spans(documents).collect()), key=str)
    assert got == brute_spans(rows) and any(r[2] for r in got)


def test_spans_of_edge_rows(spark, edge, none, clashing):
    rows = [(r[0], r[1]) for r in edge.select("doc_id", "text").collect()]
    assert sorted(map(tuple, s.dedup_spans(edge).collect()), key=str) == brute_spans(rows)
    assert s.dedup_spans(none).count() == 0
    out = s.remove(clashing)
    assert out.columns == clashing.columns and out.count() == clashing.count()
    # the one removed copy keeps what no other has: its last window holds the word more
    assert words({r["doc_id"]: r["text"] for r in out.collect()}[8]) == ["more"]


def check_factors(rows, factors, window=50):
    """Factors are copies of a smaller document's words, in order, without overlap, and cover what brute force removes."""
    texts, gone = {}, defaultdict(set)
    for i, t in rows:
        texts.setdefault(i, []).append(words(t))
    for doc, start, length, source, place in factors:
        assert source < doc and length > 0
        own_, there = (texts[k] for k in (doc, source))
        assert any(a[start : start + length] == b[place : place + length] and len(a) >= start + length for a in own_ for b in there)
        assert not gone[doc] & {*range(start, start + length)}
        gone[doc] |= {*range(start, start + length)}
    assert {i: n for i, _, n, _ in brute_spans(rows, window) if n} == {i: len(g) for i, g in gone.items()}


def test_factors(spark, documents):
    rows = [(r[0], r[1]) for r in documents.select("doc_id", "text").collect()]
    got = [tuple(r) for r in s.parse(documents).collect()]
    check_factors(rows, got)
    # a factor shorter than a window only stands where another one ends
    ends = {(d, a + n) for d, a, n, _, _ in got}
    assert all(n >= 50 or (d, a) in ends for d, a, n, _, _ in got)


def test_greedy_parse_against_all_matches():
    """The longest match that covers a word, word by word."""
    rng = np.random.default_rng(11)
    for _ in range(200):
        m = int(rng.integers(0, 9))
        start, size, source, shift = rng.integers(0, 60, m), rng.integers(1, 20, m), rng.integers(0, 3, m), rng.integers(0, 2, m)
        found = s.matches(start, size, source, start + shift)
        covers = lambda i: [x for x in found if x[0] <= i < x[1]]
        got, at = [], 0
        while at < 100:
            if c := covers(at):
                end = max(x[1] for x in c)
                got.append((at, end - at))
                at = end
            else:
                at += 1
        parsed = s.factors(found)
        assert [p[:2] for p in parsed] == got
        assert all(any(x[2] == src and x[0] <= a and a + k <= x[1] and x[3] + a - x[0] == place for x in found) for a, k, src, place in parsed)
        cells = {(int(c), int(d), int(i)) for a, b, c, d in zip(start, size, source, shift, strict=True) for i in range(a, a + b)}
        assert cells == {(x[2], x[3] - x[0], i) for x in found for i in range(x[0], x[1])}


def test_long_copies_are_one_factor(spark):
    text = [f"v{i}" for i in range(700)]
    rows = [(1, " ".join(text)), (2, " ".join(["x", "y", *text[100:650], "z"])), (3, " ".join([*text[300:], *text[:200]]))]
    got = sorted(tuple(r) for r in s.parse(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(2, 2, 550, 1, 100), (3, 0, 400, 1, 300), (3, 400, 200, 1, 0)]


def test_hot_passages(spark, monkeypatch):
    """One passage in most documents, joined through the hot keys' own way."""
    from plumbline.llm import shared

    monkeypatch.setattr(shared, "HOT", 10**9)
    passage = [f"s{i}" for i in range(90)]
    rows = [(d, " ".join([f"a{d}_{i}" for i in range(d % 40)] + passage[: 60 + d % 31] + [f"b{d % 7}_{i}" for i in range(d % 60)])) for d in range(2500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(map(tuple, s.dedup_spans(docs).collect()), key=str) == brute_spans(rows)


def test_passages_at_all_offsets(spark):
    """Passages of 49 to 53 words shared in different surroundings, and by more than two documents."""
    rows = []
    for n, size in enumerate((49, 50, 51, 53)):
        passage = [f"s{size}_{i}" for i in range(size)]
        for d in range(4):
            rows.append((100 * n + d, " ".join([f"a{n}_{d}_{i}" for i in range(d * 13)] + passage + [f"b{n}_{d}_{i}" for i in range(d * 7)])))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(map(tuple, s.dedup_spans(docs).collect()), key=str) == brute_spans(rows)
