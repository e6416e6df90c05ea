import re
import zlib

from pyspark.sql import functions as F

from plumbline.llm import language_id as li
from plumbline.llm import license_scan as m

from .conftest import tokens

ODD = ["MIT License, mit-license MIT  licence", "Licensed under the GNU General Public License version 3 or gnu LESSER general public license v2.1", "cc-by-sa 4.0 and CC BY", "SPDX-License-Identifier: Apache-2.0", "xmit license mitt license",
       "GPL gpl All Rights Reserved © public domain é", "cc by cc by cc by", "Creative Commons Attribution ShareAlike 3.0 license", "the apache license", "neither the name of the firm nor theirs may be used to endorse or promote products"]


def brute(text, compiled):
    ws = tokens(text)
    norm = " " + "  ".join(ws) + " "
    starts, base = [], set()
    for phrase, label in m.BASE:
        p = phrase.split(" ")
        at = [j for j in range(len(ws) - len(p) + 1) if ws[j : j + len(p)] == p]
        starts += at
        if at:
            base.add(label)
    label = lambda r, x: f"{r.label}-{v[1].replace('  ', '.')}" if r.versioned and (v := re.search(r"  v?([0-9]+(?:  [0-9]+)*) $", x[0])) else r.label
    found = [(x.start(), -x.end(), -r.priority, r.confidence, label(r, x)) for r, c in compiled for x in c.finditer(norm)]
    left = [d for d in found if not any(e < d and e[0] <= d[0] and e[1] <= d[1] and e[2] <= d[2] for e in found)]
    labels = base | {d[4] for d in left}
    score = max([d[3] for d in left] + ([85] if base else [0])) / 100
    return len(ws), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score


def test_scan(spark, documents, edge, none):
    assert len(m.RULES) > 300 and len({r.pattern for r in m.RULES}) == len(m.RULES)
    odd = spark.createDataFrame(list(enumerate(ODD, 50_000)), "doc_id long, text string")
    docs = documents.select("doc_id", "text").union(odd).union(edge.select(F.col("doc_id") + 60_000, "text"))
    compiled = [(r, re.compile(r.pattern)) for r in m.RULES]
    texts = {r[0]: r[1] for r in docs.collect()}
    got = m.scan(docs).collect()
    assert len(got) == docs.count()
    for r in got:
        assert tuple(r)[1:] == brute(texts[r["doc_id"]], compiled)
    assert m.scan(none).count() == 0


def test_every_match_holds_a_keyword():
    """Rules are only run where a keyword is among the words: texts made from the expressions must hold one."""
    import random

    rnd = random.Random(2)
    for r in m.RULES:
        for _ in range(30):
            text = sample(r.pattern, rnd)
            assert re.fullmatch(r.pattern, text) and {*r.keyword.split("|")} & {*text.split()}, (r, text)


def sample(pattern, rnd):
    """A text that an expression of groups, alternatives, `?`, classes and counts matches."""
    from re import _parser

    def make(parsed):
        out = ""
        for op, arg in parsed:
            name = str(op)
            if name == "LITERAL":
                out += chr(arg)
            elif name == "BRANCH":
                out += make(rnd.choice(arg[1]))
            elif name == "SUBPATTERN":
                out += make(arg[3])
            elif name in ("MAX_REPEAT", "MIN_REPEAT"):
                for _ in range(rnd.randint(arg[0], min(arg[1], arg[0] + 2))):
                    out += make(arg[2])
            elif name == "IN":
                out += next((chr(v if str(kind) == "LITERAL" else v[0]) for kind, v in arg))
            elif name == "NOT_LITERAL":
                out += "y"
            else:
                raise AssertionError(name)
        return out

    return make(_parser.parse(pattern))


def test_language(spark, documents, edge, none):
    got = li.identify(documents).join(documents.select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == documents.count()
    held = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    assert sum(r["lang"] == r["lang_pred"] for r in held) / len(held) > 0.9
    assert all(0 <= r["score"] <= 1 for r in got)
    model = li.train(documents)
    out = {r["doc_id"]: r for r in li.identify(edge, model).collect()}
    assert out[4]["lang_pred"] == out[5]["lang_pred"] == out[6]["lang_pred"] == "und" and out[4]["score"] == 0 and out[11]["lang_pred"] != "und"
    assert li.identify(none).count() == 0
    unlabelled = edge.withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in li.identify(unlabelled).collect()} == {"und"}


def test_prediction_against_brute_force(spark, documents, edge):
    """Document frequencies, vectors, cosines, distances and rejection in plain Python, for the model's own centroids."""
    import math

    model = li.train(documents)
    fold = lambda b: [(32 if c < 128 and not chr(c).isalpha() else c | 32 if c < 128 else c) for c in b]

    def grams(text):
        b, out = fold((text or "").encode()), {}
        for x, y, z in zip(b, b[1:], b[2:], strict=False):
            if (x, y, z) != (32, 32, 32):
                k = (((x | y << 8 | z << 16) * 2654435761) & 0xFFFFFFFF) >> 20
                out[k] = out.get(k, 0) + 1
        return out

    rows = [r for r in documents.collect() if r["text"] is not None and r["lang"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 != 1]
    df = {}
    for r in rows:
        for k in grams(r["text"]):
            df[k] = df.get(k, 0) + 1
    idf = [math.log((1 + len(rows)) / (1 + df.get(k, 0))) + 0.1 for k in range(li.DIMENSIONS)]
    assert max(abs(a - b) for a, b in zip(idf, model.idf, strict=True)) < 1e-9
    docs = documents.select("doc_id", "text").union(edge.select(F.col("doc_id") + 70_000, "text"))
    got = {r["doc_id"]: r for r in li.identify(docs, model).collect()}
    for i, text in docs.collect():
        v = {k: n * idf[k] for k, n in grams(text).items()}
        length = math.sqrt(sum(x * x for x in v.values())) or 1
        near = [sum(x / length * float(c[k]) for k, x in v.items()) for c in model.centroids]
        best = max(range(len(near)), key=lambda j: near[j])
        r = got[i]
        if not any(c.isalpha() for c in text or ""):
            assert (r["lang_pred"], r["score"], r["rejected"]) == ("und", 0.0, True)
            continue
        assert abs(r["score"] - min(1, max(0, near[best]))) < 1e-4
        close = [model.languages[j] for j, x in enumerate(near) if x > near[best] - 1e-5] if near[best] > 0 else [model.usual]
        assert r["lang_pred"] in close
        if abs(1 - near[best] - model.radius[best]) > 1e-4 and len(close) == 1:
            assert r["rejected"] == (1 - near[best] > model.radius[best])


def test_centroids_are_their_members_means():
    import numpy as np

    rng = np.random.default_rng(1)
    x = np.abs(rng.normal(0, 1, (60, 8))) + 5 * np.eye(8)[rng.integers(0, 3, 60)]
    x /= np.linalg.norm(x, axis=1)[:, None]
    c, place = li.cluster(x, 3)
    assert np.allclose(np.linalg.norm(c, axis=1), 1) and (place == (x @ c.T).argmax(axis=1)).all()
    for j in range(3):
        mean = x[place == j].sum(axis=0)
        assert np.allclose(c[j], mean / np.linalg.norm(mean), atol=1e-3)


def test_junk_languages_do_not_grow_the_model(spark, documents, monkeypatch):
    junk = documents.withColumn("lang", F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("x"), F.col("doc_id").cast("string"))).otherwise(F.col("lang")))
    monkeypatch.setattr(li, "LANGUAGES", 3)
    assert len(set(li.train(junk).languages)) == 3


def test_vectors_stay_inside_a_text():
    import numpy as np

    data = np.frombuffer(b"abcd", np.uint8)
    assert li.counts(data, np.array([0, 2, 4])).sum() == 0 and li.counts(data, np.array([0, 4])).sum() == 2
