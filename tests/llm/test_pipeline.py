import corpus_pipeline
import __spark_entry__ as entry
from plumbline.llm import queries

from .conftest import tokens
from .test_dedup import brute_groups
from .test_mix_shard import brute_mix, brute_order
from .test_quality_tokens import brute as quality


def test_pipeline_against_brute_force(spark, sf, documents):
    from plumbline.llm.mixing import Mix

    rows = [tuple(r) for r in documents.select("doc_id", "text", "lang", "source").collect()]
    # 87 labels certify no cutoff at this size: only the base rule rejects
    kept = [r for r in rows if not (quality(r[1])[0] < 20 or 100 * quality(r[1])[4] > 30 * quality(r[1])[0])]
    groups = brute_groups([(r[0], r[1]) for r in kept], k=5)
    kept = [r for r in kept if groups[r[0]][2]]
    windows = set()
    for _, t in spark.read.parquet(f"{sf}/benchmark.parquet").collect():
        s = tokens(t)
        windows |= {tuple(s[j : j + min(10, len(s))]) for j in range(len(s) - min(10, len(s)) + 1 if s else 0)}
    dirty = {r[0] for r in kept if any(tuple(tokens(r[1])[a : a + k]) in windows for k in {len(x) for x in windows} for a in range(len(tokens(r[1])) - k + 1))}
    out = corpus_pipeline.run(spark, sf)
    got = out.collect()
    assert set(documents.columns) <= set(out.columns)
    texts = {r["doc_id"]: r["text"] for r in got}
    for i, t in texts.items():
        ws = tokens(t)
        assert not any(tuple(ws[a : a + k]) in windows for k in {len(x) for x in windows} for a in range(len(ws) - k + 1))
    original = {r[0]: r[1] for r in rows}
    assert all(texts[i] == original[i] for i in texts if i not in dirty)
    stage = corpus_pipeline.decontaminate(spark, spark.createDataFrame(kept, "doc_id long, text string, lang string, source string"), sf).collect()
    assert {r["doc_id"] for r in stage} >= {r[0] for r in kept if r[0] not in dirty}
    mixed = brute_mix([(r["doc_id"], r["text"], r["lang"], r["source"]) for r in stage], Mix())
    want = sorted(i for i, _, _, n in mixed for _ in range(n))
    assert sorted(r["doc_id"] for r in got) == want
    sizes = [(r["doc_id"], r["text"]) for r in got]
    total, at, shards = 2 * sum(len(t.encode()) + 1 for _, t in sizes), 0, []
    for i, t in brute_order(sizes):
        shards.append((i, (2 * at + len(t.encode()) + 1) * 16 // total))
        at += len(t.encode()) + 1
    assert sorted((r["doc_id"], r["shard"]) for r in got) == sorted(shards)


def test_pipeline_of_edge_tables(spark, clashing, none, tmp_path):
    """Nulls in any column, empty and long texts, repeated rows, clashing names and empty tables."""
    from pyspark.sql import functions as F

    labels = spark.createDataFrame([(1, 1, 0), (None, None, None)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, "first tail one"), (None, "x"), (2, None)], "item_id long, text string")
    empty = clashing.limit(0)
    for name, docs, l, b in (("full", clashing, labels, bench), ("no documents", empty, labels, bench), ("only documents", clashing, labels.limit(0), bench.limit(0))):
        for table, df in (("documents", docs), ("labels", l), ("benchmark", b)):
            df.write.parquet(f"{tmp_path}/{name}/{table}.parquet")
        out = corpus_pipeline.run(spark, f"{tmp_path}/{name}")
        got = out.collect()
        assert out.columns[: len(clashing.columns)] == clashing.columns and len(out.columns) == len(clashing.columns) + 6
        assert {r["kept"] for r in got} <= {"own"}
        if name == "no documents":
            assert not got
    # stage by stage: the base rule leaves 1, 2 (twice), 3, a null id, and the long texts
    sf_dir = f"{tmp_path}/full"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    ids = lambda df: sorted(str(r["doc_id"]) for r in df.select("doc_id").collect())
    good = corpus_pipeline.quality(spark, docs, sf_dir)
    assert ids(good) == sorted(["1", "2", "2", "3", "7", "8", "None"])
    near = corpus_pipeline.near_dedup(spark, good, sf_dir)
    assert ids(near) == sorted(["1", "7", "None"])
    clean = corpus_pipeline.decontaminate(spark, near, sf_dir)
    assert ids(clean) == ids(near) and not clean.where(F.col("text").contains("tail")).count()
    mixed = corpus_pipeline.mixed(spark, clean, sf_dir)
    assert mixed.columns == docs.columns and set(ids(mixed)) <= set(ids(clean))


def test_registered():
    names = entry.queries()
    assert {f"op{i}_" for i in range(1, 11)} <= {n.split("_")[0] + "_" for n in names} and "pipeline" in names
    assert set(queries.ORACLE) <= set(names) and 4 <= len(corpus_pipeline.STAGES) <= 5

