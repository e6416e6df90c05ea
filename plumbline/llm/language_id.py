"""Language identification by nearest centroids of TF-IDF n-gram vectors.

A text's vector counts its byte trigrams (ASCII letters lower-cased, all other
ASCII a blank), hashed to `DIMENSIONS`, times the inverse document frequency over
all training rows, of length 1. Each language has up to `CENTROIDS` centroids from
spherical k-means; a text gets the language of the centroid of greatest cosine.
A text farther from it than the centroid's own radius (`RADIUS` quantile of the
training distances, with a margin) is marked as rejected.

Document frequencies cover every training row. Only the clustering uses a bounded
sample: `PER_LANGUAGE` rows of each language and `SAMPLE` in all, expected, chosen
by a hash of their id, so its size does not grow with the input. Languages are learned while they are among the `LANGUAGES`
most frequent, so junk values in lang do not grow the model.

Defined results: training rows have a text, a lang and crc32(doc_id as text) mod 3
other than 1; null text, or one without a letter, is `und` with score 0 and
rejected; so is everything when there is nothing to learn from; a text of letters
without a trigram gets the most frequent language with score 0; a null doc_id is held out;
ties go to the first language in order; very long texts are read whole; repeated rows each get a row; no documents
give no rows; extra columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words as w

DIMENSIONS = 4096
CENTROIDS = 3
#: Languages that are learned at most: the most frequent ones.
LANGUAGES = 512
PER_LANGUAGE = 400
SAMPLE = 4_000
RADIUS, MARGIN = 0.99, 1.25
_ROWS = 256  # texts whose dense counts are held at once


def _letters() -> np.ndarray:
    out = np.arange(256, dtype=np.uint32)
    out[:128] = 32
    for c in range(ord("a"), ord("z") + 1):
        out[c] = out[c - 32] = c
    return out


_FOLD = _letters()


def _grams(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and bucket of every trigram inside a text."""
    if len(data) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    x = _FOLD[data]
    code = x[:-2] | (x[1:-1] << np.uint32(8)) | (x[2:] << np.uint32(16))
    row = np.repeat(np.arange(len(off) - 1), np.diff(off))
    ok = (row[:-2] == row[2:]) & (code != 0x202020)
    bucket = ((code[ok] * np.uint32(2654435761)) >> np.uint32(20)).astype(np.int64)
    return row[:-2][ok], bucket


def counts(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Trigram counts, a row a text."""
    row, bucket = _grams(data, off)
    n = len(off) - 1
    return np.bincount(row * DIMENSIONS + bucket, minlength=n * DIMENSIONS).reshape(n, DIMENSIONS)


def vectors(data: np.ndarray, off: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = counts(data, off) * idf
    length = np.linalg.norm(x, axis=1)
    return (x / np.where(length > 0, length, 1)[:, None]).astype(np.float32)


def _cut(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for part, data, off in w.pieces(batches, text, 1 << 20):
        for lo in range(0, len(part), _ROWS):
            hi = min(len(part), lo + _ROWS)
            yield part.slice(lo, hi - lo), data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]


@dataclass
class Model:
    languages: list[str]  # of each centroid
    centroids: np.ndarray
    radius: np.ndarray
    idf: np.ndarray
    usual: str

    def predict(self, data: np.ndarray, off: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
        x = vectors(data, off, self.idf)
        near = x @ self.centroids.T
        best = near.argmax(axis=1)
        score = np.clip(near[np.arange(len(x)), best], 0.0, 1.0)
        names = [self.languages[b] if s > 0 else self.usual for b, s in zip(best.tolist(), score.tolist(), strict=True)]
        return names, score.astype(float), 1 - score > self.radius[best]


def cluster(x: np.ndarray, k: int, rounds: int = 20) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means from farthest-first seeds; centroids and the place of each row."""
    seeds = [int((x @ x.mean(axis=0)).argmax())]
    while len(seeds) < min(k, len(x)):
        near = (x @ x[seeds].T).max(axis=1)
        seeds.append(int(near.argmin()))
    c = x[seeds]
    for _ in range(rounds):
        place = (x @ c.T).argmax(axis=1)
        new = np.stack([x[place == j].sum(axis=0) if (place == j).any() else c[j] for j in range(len(c))])
        new /= np.maximum(np.linalg.norm(new, axis=1), 1e-12)[:, None]
        if np.allclose(new, c, atol=1e-6):
            break
        c = new
    return c, (x @ c.T).argmax(axis=1)


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(True))


def train(docs: DataFrame) -> Model | None:
    rows = docs.where("text is not null and lang is not null").where(~held_out()).select("doc_id", "lang", "text")
    sizes = {r[0]: r[1] for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect()}
    if not sizes:
        return None

    def frequency(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(DIMENSIONS + 1, np.int64), 0
        for part, data, off in _cut(batches, "text"):
            df[:DIMENSIONS] += (counts(data, off) > 0).sum(axis=0)
            n += len(part)
        df[DIMENSIONS] = n
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(DIMENSIONS + 1)), pa.array(df)], names=["d", "n"])

    df = np.zeros(DIMENSIONS + 1)
    for d, n in rows.select("text").mapInArrow(frequency, "d long, n long").groupBy("d").agg(F.sum("n")).collect():
        df[d] = n
    idf = np.log((1 + df[DIMENSIONS]) / (1 + df[:DIMENSIONS])) + 0.1

    each = max(1, min(PER_LANGUAGE, SAMPLE // len(sizes)))
    share = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, each / n))])
    u = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("sample")), F.lit(1 << 30)) / float(1 << 30)

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, off in _cut(batches, "text"):
            x = vectors(data, off, idf)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([v.tobytes() for v in x.astype(np.float16)], pa.binary())], names=["doc_id", "lang", "x"])

    kind = dict(rows.dtypes)["doc_id"]
    picked = sorted((r["lang"], str(r["doc_id"]), bytes(r["x"])) for r in rows.where(u < share[F.col("lang")]).mapInArrow(sampled, f"doc_id {kind}, lang string, x binary").collect())
    languages, centroids, radius = [], [], []
    for lang in sorted({p[0] for p in picked}):
        x = np.stack([np.frombuffer(v, np.float16) for name, _, v in picked if name == lang]).astype(np.float32)
        x = x[np.linalg.norm(x, axis=1) > 0]
        if not len(x):
            continue
        c, place = cluster(x, CENTROIDS)
        away = 1 - (x * c[place]).sum(axis=1)
        languages += [lang] * len(c)
        centroids += list(c)
        radius += [MARGIN * float(np.quantile(away[place == j], RADIUS)) if (place == j).any() else 0.0 for j in range(len(c))]
    if not languages:
        return None
    return Model(languages, np.stack(centroids), np.array(radius), idf, min(sizes, key=lambda s: (-sizes[s], s)))


def has_letter(text: str | None) -> bool:
    return any(c.isalpha() for c in text or "")


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected of every document; the model sees nothing but the text."""
    model = model or train(docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for part, data, off in _cut(batches, "text"):
            none = np.array([not has_letter(t.as_py()) for t in part.column(2)], bool)
            names, score, far = m.predict(data, off) if m else ([], np.zeros(len(part)), np.ones(len(part), bool))
            if m is None:
                none[:] = True
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(["und" if x else names[i] for i, x in enumerate(none)], pa.string()), pa.array(np.where(none, 0.0, score)), pa.array(none | far)], names=["doc_id", "held_out", "lang_pred", "score", "rejected"])

    picked = docs.select("doc_id", held_out().alias("held_out"), "text")
    return picked.mapInArrow(run, f"doc_id {dict(picked.dtypes)['doc_id']}, held_out boolean, lang_pred string, score double, rejected boolean")
