import hashlib
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest

from plumbline.llm import mixing, queries, sharding

from .conftest import words


def brute_mix(rows, mix):
    """rows: (doc_id, text, lang, source)."""
    def domain(source):
        return f"d{int(hashlib.md5((source or '').encode()).hexdigest()[:4], 16) % 4}"

    leaf = defaultdict(list)
    for r in rows:
        leaf[(domain(r[3]), r[2] or "", r[3] or "")].append((r[0], len(words(r[1])), hashlib.md5((r[1] or "").encode()).hexdigest()))
    tokens = {k: sum(x[1] for x in v) for k, v in leaf.items()}

    def deal(budget, children):
        """children: name -> (capacity, weight)."""
        order = sorted(children, key=lambda c: (children[c][0] / children[c][1], c))
        given, full = {}, 0
        for n, c in enumerate(order):
            cap, w = children[c]
            left = sum(children[x][1] for x in order[n:])
            if cap * left <= (budget - full) * w:
                given[c], full = cap, full + cap
            else:
                return given | {x: (budget - full) * children[x][1] // left for x in order[n:]}
        return given

    caps = Counter()
    for k, n in tokens.items():
        for i in range(4):
            caps[k[:i]] += n * mix.max_epochs
    weights = ({}, mix.domains, mix.languages, mix.sources)
    given = {(): min(sum(tokens.values()) * mix.percent // 100, caps[()])}
    for level in (1, 2, 3):
        for parent in {k[: level - 1] for k in tokens}:
            children = {k[:level] for k in tokens if k[: level - 1] == parent}
            given |= deal(given[parent], {c: (caps[c], weights[level].get(c[-1], 1)) for c in children})
    out = []
    for k, docs in leaf.items():
        epoch, rest = divmod(given[k], tokens[k]) if tokens[k] else (0, 0)
        key = lambda x: (hashlib.md5(f"{mix.seed}|{epoch}|{'' if x[0] is None else x[0]}".encode()).hexdigest(), x[0] is not None, x[0] or 0, x[2])  # noqa: E731, B023
        used = 0
        for x in sorted(docs, key=key):
            used += x[1]
            n = epoch + (used <= rest)
            if n:
                out.append((x[0], k[0], x[1], n))
    return sorted(out, key=str)


@pytest.mark.parametrize("mix", [mixing.Mix(), mixing.Mix(percent=170, seed=3), mixing.Mix(percent=500)])
def test_mix(spark, documents, edge, mix):
    for docs in (documents, edge):
        rows = [tuple(r) for r in docs.select("doc_id", "text", "lang", "source").collect()]
        got = sorted((tuple(r) for r in mixing.mix_sources(docs, mix).select("doc_id", "domain", "n_tokens", "copies").collect()), key=str)
        assert got == brute_mix(rows, mix)


def test_mix_against_sql(spark, sf, documents):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf}/documents.parquet'")
    got = sorted(map(tuple, mixing.mix_sources(documents).select("doc_id", "domain", "lang", "source", "n_tokens", "copies").collect()))
    assert got == sorted(con.sql(mixing.ORACLE_SQL).fetchall())


def test_buckets_of_any_number_give_the_same(spark, documents, monkeypatch):
    rows = [tuple(r) for r in documents.select("doc_id", "text", "lang", "source").collect()]
    for most in (1, 3):
        monkeypatch.setattr(mixing, "BUCKET_ROWS", most)
        got = sorted(((r["doc_id"], r["domain"], r["n_tokens"], r["copies"]) for r in mixing.mix_sources(documents).collect()), key=str)
        assert got == brute_mix(rows, mixing.Mix())


def test_mix_edges(clashing, none):
    out = mixing.take(clashing)
    assert out.columns == clashing.columns
    assert mixing.take(none).count() == 0


@pytest.mark.parametrize("mix", [mixing.Mix(), mixing.Mix(percent=170, seed=3)])
def test_mix_of_counted_rows(spark, edge, mix):
    docs = edge.unionByName(spark.createDataFrame([(1, "one id, another text", "en", "a"), (2, None, "en", "a"), (2, "two words", "en", "a")], edge.schema))
    rows = [tuple(r) for r in docs.select("doc_id", "text", "lang", "source").collect()]
    got = sorted((tuple(r) for r in mixing.mix_sources(mixing.counted(docs), mix).select("doc_id", "domain", "n_tokens", "copies").collect()), key=str)
    assert got == brute_mix(rows, mix)
    assert mixing.mix_sources(mixing.counted(docs.limit(0)), mix).count() == 0


def test_query_reads_texts_once(spark, documents, tmp_path):
    documents.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        pieces = spark.read.parquet(f"{tmp_path}/documents.parquet").rdd.getNumPartitions()
        out = queries.op4_mixing(spark, str(tmp_path))
        assert out.inputFiles() == [] and out.rdd.getNumPartitions() <= 12 < pieces
        rows = [tuple(r) for r in documents.select("doc_id", "text", "lang", "source").collect()]
        assert sorted((tuple(r) for r in out.select("doc_id", "domain", "n_tokens", "copies").collect()), key=str) == brute_mix(rows, mixing.Mix())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def brute_order(rows):
    return sorted(rows, key=lambda r: (hashlib.md5((r[1] or "").encode()).hexdigest(), r[0] is not None, r[0] or 0))


@pytest.mark.parametrize("law", ["bytes", "rows", "key"])
def test_shards(spark, documents, edge, law):
    for docs in (documents, edge):
        rows = [(r[0], r[1]) for r in docs.select("doc_id", "text").collect()]
        got = sharding.shard(docs, law).collect()
        assert sorted((r["doc_id"] or -1, r["size"], r["text_crc32"]) for r in got) == sorted((i or -1, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
        slots = defaultdict(list)
        for r in got:
            slots[r["shard"]].append(r["slot"])
            assert 0 <= r["shard"] < 16 and r["law"] == law
        assert all(sorted(x) == list(range(len(x))) for x in slots.values())
        if law == "rows":
            sizes = [len(slots[s]) for s in range(16)]
            assert max(sizes) - min(sizes) <= 1
        if law == "key":
            assert all(r["grown_shard"] in (r["shard"], 16) for r in got)
            again = {r["doc_id"]: r["shard"] for r in sharding.shard(docs.where("doc_id % 3 = 0"), law).collect()}
            assert all(again[r["doc_id"]] == r["shard"] for r in got if r["doc_id"] in again)
        if law == "bytes":
            total, at = 2 * sum(len((t or "").encode()) + 1 for _, t in rows), 0
            want = []
            for i, t in brute_order(rows):
                size = len((t or "").encode()) + 1
                want.append((i or -1, (2 * at + size) * 16 // total))
                at += size
            assert sorted((r["doc_id"] or -1, r["shard"]) for r in got) == sorted(want)


def test_subdivided_ranges(spark, monkeypatch):
    monkeypatch.setattr(sharding, "OVERFULL", 0.5)
    rows = [(i, "same text" if i % 3 else f"text {i}") for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sharding.shard(docs, "rows").collect()
    assert Counter(Counter(r["shard"] for r in got).values()) == {56: 12, 57: 4}


def test_shard_edges(clashing, none):
    out = sharding.shard(clashing)
    assert out.columns[: len(clashing.columns)] == clashing.columns and {"_size", "_shard", "_slot", "_law"} <= set(out.columns)
    assert sharding.shard(none).count() == 0 and sharding.shard(none, "key").count() == 0
    with pytest.raises(ValueError):
        sharding.shard(none, "size")

