import math
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from plumbline.llm import quality_rules as q
from plumbline.llm import token_counts as t

from .conftest import words


def brute(text):
    ws = words(text)
    lines = [x for x in (text or "").split("\n") if words(x)]
    seen = Counter(tuple(ws[i : i + 8]) for i in range(len(ws) - 7))
    again = {j for i in range(len(ws) - 7) if seen[tuple(ws[i : i + 8])] > 1 for j in range(i, i + 8)}
    return len(ws), sum(map(len, ws)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(again)


def check(spark, docs):
    labels = spark.createDataFrame([(1, 1, 0), (7, 0, 0), (None, 1, 0), (2, None, 0)], "doc_id long, quality int, toxic int")
    rows = q.assess(docs, labels).join(docs.select("doc_id", "text").distinct(), "doc_id").collect()
    for r in rows:
        s = r["quality_stats"]
        want = brute(r["text"])
        assert (s["n_words"], s["word_chars"], s["n_symbols"], s["n_dup_lines"], s["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (r["base_failed"] and r["kept"])
    return rows


def test_statistics(spark, edge, documents):
    assert check(spark, edge)
    assert len(check(spark, documents)) == documents.count()


def test_binomial_against_sums():
    for n, p in ((1, 0.3), (17, 0.01), (400, 0.05)):
        got = q.binomial_cdf(np.arange(min(n, 12)), n, p)
        want = np.cumsum([math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(min(n, 12))])
        assert np.allclose(got, want)


def brute_cutoffs(rows, labels, policy):
    """Cutoffs and verdicts in plain Python, with sums of binomial terms. rows: (id, text, lang)."""
    tail = lambda k, n: sum(math.comb(n, i) * policy.alpha**i * (1 - policy.alpha) ** (n - i) for i in range(k + 1))
    value = {}
    for i, text, _ in rows:
        ws, t = words(text), text or ""
        n_words, chars, symbols, dup, again = brute(text)
        lines = [x for x in t.split("\n") if words(x)]
        upper, letters = sum("A" <= c <= "Z" for c in t), sum("A" <= c <= "Z" or "a" <= c <= "z" for c in t)
        share = lambda a, b: a / max(b, 1)
        value[i] = {"symbol_share": share(symbols, chars), "bang_share": share(t.count("!"), len(ws)), "upper_share": share(upper, letters), "dup_line_share": share(dup, len(lines)), "repeat_share": share(again, n_words), "digit_share": share(sum(c in "0123456789" for c in t), chars), "word_length": share(chars, n_words)}
    bad = {}
    for i, quality in labels:
        if i is not None and quality is not None:
            bad[i] = bad.get(i, False) or quality != 1
    lang = {i: g for i, _, g in rows}
    held = [i for i, _, _ in rows if i in bad]
    strata = {lang[i] for i in held}
    enough = math.log(policy.delta / (len(strata) * len(policy.rules))) / math.log(1 - policy.alpha)
    pool = {g for g in strata if sum(lang[i] == g and not bad[i] for i in held) < enough}
    groups = [{g} for g in strata - pool] + ([pool] if pool else [])
    limits = {}
    for group in groups:
        good_ids, bad_ids = ([i for i in held if lang[i] in group and bad[i] is b] for b in (False, True))
        chains = {}
        for r in policy.rules:
            lost, caught = ([sum(value[i][r.name] > c for i in ids) for c in r.grid] for ids in (good_ids, bad_ids))
            if caught[-1]:
                chains[r.name] = (r.grid, lost, caught)
        weight, done = {k: policy.delta / len(groups) / len(chains) for k in chains}, {}
        while True:
            done = {k: next((j for j, x in enumerate(chains[k][1]) if not good_ids or tail(x, len(good_ids)) > weight[k]), len(chains[k][0])) for k in weight}
            ended, open_ = ([k for k in weight if (done[k] == len(chains[k][0])) is e] for e in (True, False))
            passing = [k for k in ended if weight[k] < 1]
            if not passing or not open_:
                break
            free = sum(weight[k] for k in passing)
            for k in passing:
                weight[k] = 1.0  # stays certified
            for k in open_:
                weight[k] += free / len(open_)
        use = {}
        for k, m in done.items():
            grid, lost, caught = chains[k]
            gains = [caught[j] / len(bad_ids) - policy.loss * lost[j] / len(good_ids) for j in range(m)]
            if gains and max(gains) > 0:
                use[k] = grid[gains.index(max(gains))]
        limits |= {g: use for g in group}
    base = {i: brute(t) for i, t, _ in rows}
    failed = {i: n[0] < 20 or 100 * n[4] > 30 * n[0] for i, n in base.items()}
    return limits, {i: not failed[i] and not any(value[i][k] > c for k, c in limits.get(lang[i], {}).items()) for i, _, _ in rows}


def test_cutoffs_and_verdicts_against_brute_force(spark):
    """Production parameters, all of sf0.01: four languages, each too small for a test of its own."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows, told = [tuple(r) for r in docs.collect()], [(r["doc_id"], r["quality"]) for r in labels.collect()]
    limits, kept = brute_cutoffs(rows, told, q.Policy())
    got = q.assess(docs, labels).collect()
    assert {r["doc_id"]: r["kept"] for r in got} == kept
    # the certified cutoffs reject what the base rule lets pass
    assert any(not r["kept"] and not r["base_failed"] for r in got)
    found = {(r["stratum"][1:], r["rule"]): r["cutoff"] for r in q.report(docs, labels).collect()}
    assert {k: v for k, v in found.items() if v is not None} == {(g, k): c for g, use in limits.items() for k, c in use.items()}


def test_strata_of_their_own_and_pooled(spark):
    """One large stratum, two small ones and null, with cutoffs that differ."""
    rng = np.random.default_rng(4)
    rows, labels = [], []
    for i in range(1100):
        lang = ["en", "en", "en", "en", "de", "", None][int(rng.integers(0, 7))]
        bad = bool(rng.random() < 0.2)
        mark = int(rng.integers(20, 40)) if bad else int(rng.integers(0, 3 if lang == "en" else 2))
        rows.append((i, " ".join(f"w{i}x{j}" + ("#$" if j < mark else "") for j in range(40)), lang))
        labels.append((i, int(not bad)))
    docs, told = spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int")
    policy = q.Policy(alpha=0.03, delta=0.2)
    limits, kept = brute_cutoffs(rows, labels, policy)
    assert limits["de"] == limits[None] == limits[""] != limits["en"] and limits["en"]
    got = q.assess(docs, told, policy).collect()
    assert {r["doc_id"]: r["kept"] for r in got} == kept
    assert {(r["lang"], r["pooled"]) for r in got} == {("en", False), ("de", True), ("", True), (None, True)}


def test_step_down():
    p = [np.array([0.001, 0.02]), np.array([0.001, 0.001]), np.array([0.0, 0.3])]
    assert q.certified(p, [True] * 3, 0.03) == [1, 2, 1]
    assert q.certified(p, [True] * 3, 0.04) == [2, 2, 1]  # the second hands its part on
    assert q.certified(p, [True, False, True], 0.04) == [2, 0, 1]
    # a cutoff behind one that fails is never certified
    assert q.certified([np.array([0.0, 0.9, 0.0])], [True], 0.05) == [1]


def test_rejects_what_labels_call_bad(spark):
    good = [(i, " ".join(f"word{j}" for j in range(i, i + 40)), "en") for i in range(1500)]
    bad = [(i, " ".join(f"w{j}***###" for j in range(i, i + 40)), "en") for i in range(5000, 5400)]
    docs = spark.createDataFrame(good + bad, "doc_id long, text string, lang string").repartition(4)
    labels = docs.select("doc_id", (F.col("doc_id") < 5000).cast("int").alias("quality"))
    kept = {r[0] for r in q.keep(docs, labels).select("doc_id").collect()}
    assert kept == {g[0] for g in good}


def test_edges_of_quality(spark, clashing, none):
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    out = q.keep(clashing, labels)
    assert out.columns == clashing.columns and {r["kept"] for r in out.collect()} == {"own"}
    assert q.assess(none, labels).count() == 0 and q.assess(clashing.select("doc_id", "text", "lang"), labels.limit(0)).count() == clashing.count()


def test_counts_are_the_librarys(spark, edge, documents, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    odd = ["<|endoftext|>", "a<|endoftext|>b <|endoftext|> <|ENDOFTEXT|>", "it's  we'LL\r\n\n x\t\t", "İK ½² ́e‍", "\x00\x7f\x85", "你好 мир　x", "'s't'RE", "   ", "\n \n"]
    extra = spark.createDataFrame([(10_000 + i, s) for i, s in enumerate(odd)], "doc_id long, text string")
    docs = documents.select("doc_id", "text").union(edge.select(F.coalesce(F.col("doc_id") + 20_000, F.lit(30_000)).alias("doc_id"), "text")).union(extra)
    texts = {r[0]: r[1] for r in docs.collect()}
    cache = f"file://{tmp_path}/cache"
    for _ in range(2):  # the second time from the cache
        got = t.count_tokens(docs, "byte_bpe_50k.json", cache).collect()
        assert len(got) == docs.count()
        for r in got:
            s = texts[r["doc_id"]] or ""
            n = len(lib.encode(s, add_special_tokens=False).ids)
            assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(s.encode()), n, n > 1024)
    stored = spark.read.parquet(cache)
    assert stored.count() == len({v or "" for v in texts.values()})


def test_one_text_in_most_rows(spark):
    rows = [(i, "the same text" if i % 3 else f"text {i % 40}") for i in range(9000)]
    got = t.count_tokens(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), "byte_bpe_50k.json").collect()
    count = dict(zip(texts := sorted({r[1] for r in rows}), t.counter("byte_bpe_50k.json")(texts), strict=True))
    assert sorted((r["doc_id"], r["n_tokens"]) for r in got) == [(i, count[x]) for i, x in rows]


def test_warm_cache(spark, documents, tmp_path, monkeypatch):
    """Stored counts are used as they are; only new texts are encoded; many misses go by another join."""
    cache = f"file://{tmp_path}/cache"
    docs = documents.select("doc_id", "text")
    t.fill(docs, "byte_bpe_50k.json", cache)
    n = spark.read.parquet(cache).count()
    new = spark.createDataFrame([(900_001, "quite a new text"), (900_001, "quite a new text"), (900_002, "another"), (None, "another")], "doc_id long, text string")
    t.fill(docs.unionByName(new), "byte_bpe_50k.json", cache)
    assert spark.read.parquet(cache).select("content").distinct().count() == n + 2
    marked = f"file://{tmp_path}/marked"
    spark.read.parquet(cache).withColumn("n_tokens", F.col("n_tokens") + 5000).write.parquet(marked)
    plain = {r[0]: r["n_tokens"] for r in t.count_tokens(docs, "byte_bpe_50k.json", cache).collect()}
    assert {r[0]: r["n_tokens"] for r in t.count_tokens(docs, "byte_bpe_50k.json", marked).collect()} == {k: v + 5000 for k, v in plain.items()}
    monkeypatch.setattr(t, "BROADCAST_ROWS", 0)
    assert {r[0]: r["n_tokens"] for r in t.count_tokens(docs, "byte_bpe_50k.json").collect()} == plain
    # another file or library version shares nothing
    assert t.tokenizer_digest("byte_bpe_50k.json") != t.tokenizer_digest("word_bpe_49k.json")


def test_other_vocabularies(spark, edge, none):
    for name in ("piece_bpe_32k.model", "word_bpe_49k.json", "byte_bpe_multi_50k.tiktoken"):
        count = t.counter(name)
        small = edge.where("length(text) < 500 or text is null")
        got = {r["doc_id"]: r["n_tokens"] for r in t.count_tokens(small, name).collect()}
        assert all(got[r["doc_id"]] == count([r["text"] or ""])[0] for r in small.collect())
    assert t.count_tokens(none, "byte_bpe_50k.json").count() == 0

